"""What explains a mass, an area or a quantity: cross-links, adducts, charge states, compositions, traces, proteins, and statistics of scores."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import chemistry as ch
from ..functions import peptides as pe
from ..sources.tables import dealt
from .joins import range_join
from .ranges import in_ranges, joined, percentiles, running

# Monoisotopic masses of nucleotide residues, and what the ends of a chain of them add.
NUCLEOTIDES = {"A": 329.0525, "C": 305.0413, "G": 345.0474, "U": 306.0253}
NUCLEOTIDE_ENDS = -61.95577
# Cleavage sites of ribonucleases, as regular expressions of the empty places between nucleotides.
RIBONUCLEASES = {"RNase_T1": "(?<=G)", "RNase_U2": "(?<=[AG])", "RNase_A": "(?<=[CU])", "cusativin": "(?<=C)(?!C)"}


def rna_mass(sequence: Column) -> Column:
    """Monoisotopic mass of an unmodified chain with hydroxyl ends; 0 without nucleotides."""
    return F.when(F.length(sequence) > 0, ch.weighted(sequence, NUCLEOTIDES) + NUCLEOTIDE_ENDS).otherwise(0.0)


def digest_rna(chains: DataFrame, enzyme: str) -> DataFrame:
    """(accession, fragment, start): complete digestion; start counts fragments from 0."""
    parts = F.filter(F.split("sequence", RIBONUCLEASES[enzyme]), lambda x: x != "")
    return chains.select("accession", F.posexplode(parts).alias("start", "fragment")).select("accession", "fragment", "start")


def cross_link_candidates(peptides: DataFrame, precursors: DataFrame, linker: float, tolerance: float) -> DataFrame:
    """(spectrum_id, alpha, beta, mass): peptide pairs (alpha >= beta) that with the linker have a precursor's mass.

    For each precursor and alpha, beta's mass is known: a range join on it. Pairs of all peptides are never made."""
    p = peptides.select("peptide").distinct().withColumn("mass", ch.peptide_mass(F.col("peptide")))
    a = p.select(F.col("peptide").alias("alpha"), F.col("mass").alias("a_mass"))
    # alpha is the heavier one, so it has at least half of what is to explain
    want = dealt(precursors.select("spectrum_id", (F.col("precursor_mass") - linker).alias("_total")))
    heavy = range_join(a, want, "a_mass", F.col("_total") / 2 - tolerance, F.col("_total"), 200.0).withColumn("_rest", F.col("_total") - F.col("a_mass"))
    b = p.select(F.col("peptide").alias("beta"), F.col("mass").alias("b_mass"))
    both = range_join(b, heavy, "b_mass", F.col("_rest") - tolerance, F.col("_rest") + tolerance, max(1.0, 2 * tolerance))
    order = (F.col("a_mass") > F.col("b_mass")) | ((F.col("a_mass") == F.col("b_mass")) & (F.col("alpha") >= F.col("beta")))
    return both.filter(order).select("spectrum_id", "alpha", "beta", (F.col("a_mass") + F.col("b_mass") + linker).alias("mass"))


def internal_ions(peptides: DataFrame, charge: int = 1) -> DataFrame:
    """(peptide, start, length, mz) of internal b fragments: those with neither end of the peptide, of two residues or more."""
    n = F.length("peptide")
    at = peptides.filter(n >= 4).select("peptide", F.explode(F.sequence(F.lit(2), n - 2)).alias("start")).select("peptide", "start", F.explode(F.sequence(F.lit(2), n - F.col("start"))).alias("length"))
    mass = ch.weighted(F.substring("peptide", F.col("start"), F.col("length")), ch.RESIDUES)
    return at.select("peptide", "start", "length", ((mass + charge * ch.PROTON) / charge).alias("mz"))


def decharge_pairs(features: DataFrame, mass_tolerance: float, rt_tolerance: float) -> DataFrame:
    """(map_id, a_id, b_id, mass): features of one map and different charge (a the lower) that are one protonated molecule."""
    f = features.select("map_id", "feature_id", "charge", "rt", ((F.col("mz") - ch.PROTON) * F.col("charge")).alias("mass"))
    right = f.select("map_id", F.col("feature_id").alias("b_id"), F.col("charge").alias("_z"), F.col("rt").alias("_rt"), F.col("mass").alias("_mass"))
    near = range_join(f, right, "mass", F.col("_mass") - mass_tolerance, F.col("_mass") + mass_tolerance, max(1.0, 2 * mass_tolerance), ("map_id",))
    near = near.filter((F.col("charge") < F.col("_z")) & (F.abs(F.col("rt") - F.col("_rt")) <= rt_tolerance))
    return near.select("map_id", F.col("feature_id").alias("a_id"), "b_id", ((F.col("mass") + F.col("_mass")) / 2).alias("mass"))


def accurate_mass_search(features: DataFrame, compounds: DataFrame, ppm: float, adducts: tuple = ("M+H;1+", "M+Na;1+", "M+2H;2+")) -> DataFrame:
    """(feature_id, compound, adduct, error): compounds (compound, mass) whose adduct ion has a feature's m/z and charge; error in ppm."""
    ions = pe.adduct_ions(compounds.select("compound", "mass"), adducts).select("compound", "adduct", "charge", F.col("mz").alias("_mz"))
    width = F.col("_mz") * (ppm * 1e-6)
    hit = range_join(features.select("feature_id", "mz", "charge"), ions, "mz", F.col("_mz") - width, F.col("_mz") + width, 1.0, ("charge",))
    return hit.select("feature_id", "compound", "adduct", ((F.col("mz") - F.col("_mz")) / F.col("_mz") * 1e6).alias("error"))


def integrate(points: DataFrame, key: tuple, x: str = "rt", y: str = "intensity", baseline: bool = True) -> DataFrame:
    """(key, n, area, height, background): trapezoids over the points in order of x, less the line between the end points (not below 0)."""
    line = Window.partitionBy(*key).orderBy(x)
    v = F.col(y).cast("double")
    step = (F.col(x) - F.lag(x).over(line)) * (v + F.lag(v).over(line)) / 2
    one = points.select(*key, F.col(x).alias("_x"), v.alias("_y"), step.alias("_s")).groupBy(*key).agg(F.count("*").alias("n"), F.coalesce(F.sum("_s"), F.lit(0.0)).alias("_area"), F.max("_y").alias("height"), F.min(F.struct("_x", "_y")).alias("_a"), F.max(F.struct("_x", "_y")).alias("_b"))
    ground = (F.col("_b._x") - F.col("_a._x")) * (F.col("_a._y") + F.col("_b._y")) / 2 if baseline else F.lit(0.0)
    return one.select(*key, "n", F.greatest(F.col("_area") - ground, F.lit(0.0)).alias("area"), "height", F.lit(ground).alias("background"))


def split_at_valleys(points: DataFrame, key: tuple, order: str = "rt", half: int = 1, depth: float = 0.8) -> DataFrame:
    """points with segment: a new one starts at each local minimum of the moving average that is below `depth` of both neighbours.

    Two windows on the same key and order: one sort."""
    line = Window.partitionBy(*key).orderBy(order)
    p = points.withColumn("_m", F.avg("intensity").over(line.rowsBetween(-half, half)))
    cut = (F.col("_m") < depth * F.lag("_m").over(line)) & (F.col("_m") < depth * F.lead("_m").over(line))
    return p.withColumn("_c", F.coalesce(cut.cast("int"), F.lit(0))).withColumn("segment", F.sum("_c").over(line.rowsBetween(Window.unboundedPreceding, 0))).drop("_m", "_c")


def link_scans(peaks: DataFrame, ppm: float) -> DataFrame:
    """(run_id, a, b): peaks of neighbouring spectra of a run that are each other's nearest in m/z within tolerance (ties: smaller id)."""
    scans = peaks.select("run_id", "spectrum_id", "rt").distinct().withColumn("_scan", F.row_number().over(Window.partitionBy("run_id").orderBy("rt", "spectrum_id"))).drop("rt")
    p = peaks.join(scans, ["run_id", "spectrum_id"]).select("run_id", "_scan", "peak_id", "mz")
    right = p.select("run_id", (F.col("_scan") - 1).alias("_scan"), F.col("peak_id").alias("b"), F.col("mz").alias("_mz"))
    width = F.col("_mz") * (ppm * 1e-6)
    near = range_join(p, right, "mz", F.col("_mz") - width, F.col("_mz") + width, 1.0, ("run_id", "_scan")).select("run_id", "_scan", F.col("peak_id").alias("a"), "b", F.abs(F.col("mz") - F.col("_mz")).alias("d"))
    rank = lambda k, o: F.row_number().over(Window.partitionBy("run_id", "_scan", k).orderBy("d", o))
    return near.select("run_id", "a", "b", rank("a", "b").alias("_a"), rank("b", "a").alias("_b")).filter("_a = 1 AND _b = 1").select("run_id", "a", "b")


def protein_quantities(quantities: DataFrame, top: int = 3, average: str = "sum") -> DataFrame:
    """quantities (accession, peptide, sample, intensity) -> (accession, sample, n_peptides, quantity) of the `top` most intense peptides
    of each protein and sample (ties by name); average: sum, mean or median."""
    each = quantities.groupBy("accession", "sample", "peptide").agg(F.sum("intensity").alias("intensity"))
    o = Window.partitionBy("accession", "sample").orderBy(F.desc("intensity"), "peptide")
    best = each.withColumn("_r", F.row_number().over(o)).filter(F.col("_r") <= top)
    f = {"sum": F.sum, "mean": F.avg, "median": lambda c: F.percentile(c, 0.5)}[average]
    return best.groupBy("accession", "sample").agg(F.count("*").alias("n_peptides"), f("intensity").alias("quantity"))


def rank_correlation(vectors: DataFrame, key: tuple, x: str = "x", y: str = "y") -> DataFrame:
    """(key, spearman): correlation of the two values' ranks, equal values sharing their mean rank; null if those of one are all equal.

    A key's rows, which an instrument bounds, are one group: they are shuffled once, and sorted in numpy. Nulls are equal and come first."""

    def ranks(c: pa.ChunkedArray) -> np.ndarray:
        v, there = c.fill_null(0.0).to_numpy(), c.is_valid().to_numpy()
        order = np.lexsort((v, there))
        v, there = v[order], there[order]
        same = (there[1:] == there[:-1]) & ((v[1:] == v[:-1]) | (np.isnan(v[1:]) & np.isnan(v[:-1])))
        first = np.flatnonzero(np.append(True, ~same))
        n = np.diff(np.append(first, len(v)))
        out = np.empty(len(v))
        out[order] = np.repeat(first + (n + 1) / 2, n)
        return out

    def run(t: pa.Table) -> pa.Table:
        a, b = (r - r.mean() for r in map(ranks, (t["_x"], t["_y"])))
        both = (a * a).sum() * (b * b).sum()
        return t.select(list(key)).slice(0, 1).append_column("spearman", pa.array([float((a * b).sum() / np.sqrt(both)) if both > 0 else None], pa.float64()))

    v = vectors.select(*key, F.col(x).cast("double").alias("_x"), F.col(y).cast("double").alias("_y"))
    return v.groupBy(*key).applyInArrow(run, ", ".join(f"`{c}` {v.schema[c].dataType.simpleString()}" for c in key) + ", spearman double")


def deviations(values: DataFrame, key: tuple, value: str) -> DataFrame:
    """(key, median, mad, mean, deviation): median, median absolute deviation from it, mean and sample standard deviation."""
    m = values.groupBy(*key).agg(F.avg(value).alias("mean"), F.stddev_samp(value).alias("deviation"))
    m = joined(m, percentiles(values, key, value, [0.5]).select(*key, F.col("p")[0].alias("median")), key, "left")
    off = joined(values, m.select(*key, "median"), key).select(*key, F.abs(F.col(value) - F.col("median")).alias("_off"))
    return joined(m, percentiles(off, key, "_off", [0.5]).select(*key, F.col("p")[0].alias("mad")), key, "left").select(*key, "median", "mad", "mean", "deviation")


def roc_area(hits: DataFrame, pool: tuple = ("run_id",)) -> DataFrame:
    """(pool, area): chance that a target scores above a decoy, equal scores counting half. Scores are counted before they are sorted."""
    n = hits.groupBy(*pool, "score").agg(F.sum((~F.col("decoy")).cast("long")).alias("t"), F.sum(F.col("decoy").cast("long")).alias("d"))
    n = running(in_ranges(n, pool, "score"), ["score"], {"_below": ("d", "sum")}, inclusive=False)
    s = n.select(*pool, "t", "d", (F.col("t") * (F.col("_below") + F.col("d") / 2)).alias("_w"))
    return s.groupBy(*pool).agg((F.sum("_w") / (F.sum("t") * F.sum("d"))).alias("area"))


def dot_and_bias(peaks: DataFrame, pairs: DataFrame, bin_size: float = 10.0) -> DataFrame:
    """(a, b, dot, bias): cosine of binned intensities and how far few bins dominate it: root of the sum of squared products over their sum."""
    v = peaks.groupBy("spectrum_id", F.floor(F.col("mz") / bin_size).alias("bin")).agg(F.sum("intensity").alias("x"))
    norm = v.groupBy("spectrum_id").agg(F.sqrt(F.sum(F.col("x") * F.col("x"))).alias("n"))
    u = v.join(norm, "spectrum_id").select("spectrum_id", "bin", (F.col("x") / F.col("n")).alias("x"))
    both = pairs.join(u.toDF("a", "bin", "xa"), "a").join(u.toDF("b", "bin", "xb"), ["b", "bin"]).withColumn("p", F.col("xa") * F.col("xb"))
    return both.groupBy("a", "b").agg(F.sum("p").alias("dot"), F.sqrt(F.sum(F.col("p") * F.col("p"))).alias("_s")).select("a", "b", "dot", F.try_divide("_s", "dot").alias("bias"))


# Atoms of the residues (C, H, N, O, S).
RESIDUE_ATOMS = {
    "G": (2, 3, 1, 1, 0), "A": (3, 5, 1, 1, 0), "S": (3, 5, 1, 2, 0), "P": (5, 7, 1, 1, 0), "V": (5, 9, 1, 1, 0), "T": (4, 7, 1, 2, 0), "C": (3, 5, 1, 1, 1),
    "L": (6, 11, 1, 1, 0), "I": (6, 11, 1, 1, 0), "N": (4, 6, 2, 2, 0), "D": (4, 5, 1, 3, 0), "Q": (5, 8, 2, 2, 0), "K": (6, 12, 2, 1, 0), "E": (5, 7, 1, 3, 0),
    "M": (5, 9, 1, 1, 1), "H": (6, 7, 3, 1, 0), "F": (9, 9, 1, 1, 0), "R": (6, 12, 4, 1, 0), "Y": (9, 9, 1, 2, 0), "W": (11, 10, 2, 1, 0),
}


def peptide_isotopes(peptides: DataFrame, peaks: int = 6) -> DataFrame:
    """(peptide, isotopes): abundances at 0, 1, .. mass units above the monoisotopic peak, to a sum of 1 over `peaks`.

    Compositions repeat a lot, so each distinct one of a batch is computed once."""
    order = "CHNOS"

    @F.pandas_udf("array<double>")
    def isotopes(sequence: pd.Series) -> pd.Series:
        known: dict[str, list[float]] = {}

        def one(s: str) -> list[float]:
            atoms = np.sum([RESIDUE_ATOMS.get(c, (0,) * 5) for c in s] + [(0, 2, 0, 1, 0)], axis=0)
            formula = "".join(f"{a}{n}" for a, n in zip(order, atoms.tolist()) if n)
            if formula not in known:
                known[formula] = ch.isotope_pattern(formula, peaks)
            return known[formula]

        return sequence.map(one)

    return peptides.select("peptide", isotopes("peptide").alias("isotopes"))


def compositions(masses: DataFrame, alphabet: dict[str, float], tolerance: float, most: int = 10_000) -> DataFrame:
    """masses (id, mass) -> (id, composition, error): counts of letters, like ``A2 G1``, whose summed mass is within tolerance.

    A depth-first search, heaviest letter first, cut where the rest can't be reached. More than `most` for one mass is an error.
    Each distinct mass is searched once; its ids get what was found by a join."""
    letters = sorted(alphabet, key=lambda k: -alphabet[k])

    def search(total: float) -> list[tuple[str, float]]:
        out: list[tuple[str, float]] = []
        todo = [(0, total, "")]
        while todo:
            i, rest, done = todo.pop()
            m = alphabet[letters[i]]
            for n in range(int((rest + tolerance) // m), -1, -1):
                left, name = rest - n * m, done + (f" {letters[i]}{n}" if n else "")
                if i < len(letters) - 1:
                    todo.append((i + 1, left, name))
                elif left <= tolerance:
                    out.append((name.strip(), -left))
                else:
                    break
            if len(out) > most:
                raise ValueError(f"more than {most} compositions of {total}")
        return [x for x in out if x[0]]

    def run(frames):
        for f in frames:
            yield pd.DataFrame({"mass": f["mass"], "_found": [[{"composition": c, "error": e} for c, e in search(float(m))] for m in f["mass"]]})

    rows = masses.select(F.col("id").cast("long").alias("id"), F.col("mass").cast("double").alias("mass"))
    found = rows.select("mass").distinct().mapInPandas(run, "mass double, _found array<struct<composition: string, error: double>>")
    return rows.join(found, "mass").select("id", F.inline("_found"))
