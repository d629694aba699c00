"""Peptides beyond their masses: enzymes, modifications, all ion series, profiles, tags, neighbours, alignment and adducts."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..operators.joins import range_join
from ..sources.scratch import written
from ..sources.tables import dealt
from . import chemistry as ch

# Cleavage sites of the enzymes, as regular expressions of the empty places between residues.
ENZYMES = {
    "Trypsin": "(?<=[KRX])(?!P)",
    "Arg-C": "(?<=[RX])(?!P)",
    "Arg-C/P": "(?<=[RX])",
    "Asp-N": "(?=[DBX])",
    "Asp-N/B": "(?=[DX])",
    "Asp-N_ambic": "(?=[DBEZX])",
    "Chymotrypsin": "(?<=[FYWLJX])(?!P)",
    "Chymotrypsin/P": "(?<=[FYWLJX])",
    "CNBr": "(?<=[MX])",
    "Formic_acid": "(?<=[DBX])(?=[DBX])",
    "Lys-C": "(?<=[KX])(?!P)",
    "Trypsin/P": "(?<=[KRX])",
    "V8-DE": "(?<=[DBEZX])(?!P)",
    "V8-E": "(?<=[EZX])(?!P)",
    "leukocyte elastase": "(?<=[ALIJVX])(?!P)",
    "proline endopeptidase": "(?<=[HKRX][PX])(?!P)",
    "glutamyl endopeptidase": "(?<=[DBEZX])",
    "Alpha-lytic protease": "(?<=[TASVX])",
    "2-iodobenzoate": "(?<=[WX])",
    "staphylococcal protease/D": "(?<=[EZX])",
    "Glu-C+P": "(?<=[DBEZX])(?!P)",
    "PepsinA + P": "(?<=[FLJX])(?!P)",
    "elastase-trypsin-chymotrypsin": "(?<=[ALIVKRWFYX])(?!P)",
    "unspecific cleavage": "(?<=[A-Z])",
}
# Normalised consensus hydrophobicity by Eisenberg.
EISENBERG = {
    "A": 0.62, "C": 0.29, "D": -0.90, "E": -0.74, "F": 1.19, "G": 0.48, "H": -0.40, "I": 1.38, "K": -1.50, "L": 1.06,
    "M": 0.64, "N": -0.78, "P": 0.12, "Q": -0.85, "R": -2.53, "S": -0.18, "T": -0.05, "V": 1.08, "W": 0.81, "Y": 0.26,
}
# Mass that each ion series has beyond its residues, in atoms.
SERIES = {"a": "C-1O-1", "b": "", "c": "N1H3", "x": "C1O2", "y": "H2O1", "z": "H-1N-1O1"}
# Common modifications, residue and mass.
MODIFICATIONS = {"Carbamidomethyl": ("C", 57.021464), "Oxidation": ("M", 15.994915), "Phospho (S)": ("S", 79.966331), "Phospho (T)": ("T", 79.966331), "Phospho (Y)": ("Y", 79.966331), "Deamidated (N)": ("N", 0.984016), "Acetyl (K)": ("K", 42.010565)}
# Adducts, (atoms, charge, molecules).
ADDUCTS = {"M+H;1+": ("H1", 1, 1), "M+Na;1+": ("Na1", 1, 1), "M+K;1+": ("K1", 1, 1), "M+2H;2+": ("H2", 2, 1), "2M+H;1+": ("H1", 1, 2), "M-H2O+H;1+": ("H-1O-1", 1, 1), "M-H;1-": ("H-1", -1, 1)}
ELECTRON = 0.00054857990946


def digest_with(proteins: DataFrame, enzyme: str, missed: int = 0, shortest: int = 1, longest: int = 10**6) -> DataFrame:
    """(accession, peptide, start, missed): as chemistry.digest, for any of the ENZYMES. start counts parts from 0."""
    parts = proteins.select("accession", F.filter(F.split("sequence", ENZYMES[enzyme]), lambda x: x != "").alias("p"))
    at = parts.select("accession", "p", F.posexplode("p").alias("start", "_first")).select("accession", "p", "start", F.explode(F.sequence(F.lit(0), F.lit(missed))).alias("missed")).filter(F.col("start") + F.col("missed") < F.size("p"))
    peptide = F.array_join(F.slice("p", F.col("start") + 1, F.col("missed") + 1), "")
    return at.select("accession", peptide.alias("peptide"), "start", "missed").filter(F.length("peptide").between(shortest, longest))


def modified(peptides: DataFrame, fixed: tuple = ("Carbamidomethyl",), variable: tuple = ("Oxidation",), most: int = 2) -> DataFrame:
    """(peptide, sites, n_modified, mass): each way to place at most `most` variable modifications, at most one per residue.

    sites: positions from 1 with the modification, in order, like ``3:Oxidation``. Ways are grown one site at a time, so a peptide makes
    only rows that stay. A fixed modification is on each of its residues and blocks variable ones there."""
    blocked = {MODIFICATIONS[m][0] for m in fixed}
    base = ch.peptide_mass(F.col("peptide"))
    for m in fixed:
        residue, mass = MODIFICATIONS[m]
        base = base + ch.count(F.col("peptide"), residue) * F.lit(mass)
    at = F.sequence(F.lit(1), F.length("peptide"))

    def sites(name: str) -> Column:
        residue, mass = MODIFICATIONS[name]
        places = F.filter(at, lambda i: F.substring("peptide", i, F.lit(1)) == residue)
        return F.transform(places, lambda i: F.struct(i.alias("at"), F.lit(name).alias("name"), F.lit(mass).alias("mass")))

    options = F.flatten(F.array(*[sites(m) for m in variable if MODIFICATIONS[m][0] not in blocked]))
    ways = peptides.select("peptide", base.alias("mass"), options.alias("_o"), F.array().cast("array<string>").alias("_s"), F.lit(0).alias("_at"), F.lit(0).alias("n_modified")).filter(F.length("peptide") > 0)
    out = ways
    for _ in range(most):
        more = ways.select("peptide", "mass", "_o", "_s", "_at", "n_modified", F.explode(F.filter("_o", lambda o: o["at"] > F.col("_at"))).alias("_n"))
        ways = more.select("peptide", (F.col("mass") + F.col("_n.mass")).alias("mass"), "_o", F.array_append("_s", F.concat_ws(":", F.col("_n.at").cast("string"), "_n.name")).alias("_s"), F.col("_n.at").alias("_at"), (F.col("n_modified") + 1).alias("n_modified"))
        out = out.unionByName(ways)
    return out.select("peptide", F.array_join("_s", ",").alias("sites"), "n_modified", "mass")


def all_ions(peptides: DataFrame, series: str = "abcxyz", charges: tuple = (1,), losses: bool = False) -> DataFrame:
    """(peptide, ion, position, charge, loss, mz) of the series named; losses: of water (S, T, E, D) and ammonia (R, K, N, Q) as well."""
    n = F.length("peptide")
    at = peptides.filter(n > 1).select("peptide", F.explode(F.sequence(F.lit(1), n - 1)).alias("position"))
    head, tail = F.substring("peptide", F.lit(1), F.col("position")), F.substring("peptide", n - F.col("position") + 1, F.col("position"))
    ions = [F.struct(F.lit(s).alias("ion"), (head if s in "abc" else tail).alias("part"), F.lit(ch.formula_mass(SERIES[s])).alias("more")) for s in series]
    at = at.select("peptide", "position", F.inline(F.array(*ions))).withColumn("_m", ch.weighted(F.col("part"), ch.RESIDUES) + F.col("more"))
    kinds = [F.struct(F.lit("").alias("loss"), F.lit(0.0).alias("less"), F.lit(True).alias("has"))]
    if losses:
        kinds += [F.struct(F.lit(name).alias("loss"), F.lit(ch.formula_mass(f)).alias("less"), F.col("part").rlike(of).alias("has")) for name, f, of in (("H2O", "H2O1", "[STED]"), ("NH3", "N1H3", "[RKNQ]"))]
    at = at.select("peptide", "ion", "position", "_m", F.inline(F.array(*kinds))).filter("has")
    return at.select("peptide", "ion", "position", "loss", F.explode(F.array(*[F.lit(z) for z in charges])).alias("charge"), "_m", "less").select("peptide", "ion", "position", "charge", "loss", ((F.col("_m") - F.col("less")) / F.col("charge") + ch.PROTON).alias("mz"))


def _residue_rows(proteins: DataFrame, scale: dict[str, float]) -> DataFrame:
    value = F.lit(None).cast("double")
    for k, v in scale.items():
        value = F.when(F.col("_r") == k, F.lit(v)).otherwise(value)
    return proteins.select("accession", F.posexplode(F.split("sequence", "")).alias("at", "_r")).filter("_r != ''").withColumn("_v", value)


def windowed_profile(sequence: Column, window: int, scale: dict[str, float]) -> Column:
    """Means of the scale over each `window` residues, in order (a shorter sequence is one window; an empty one has none).

    All of it inside a row, in the JVM."""
    n = F.length(sequence)
    w = F.least(F.lit(window), n)
    letters, values = F.lit("".join(scale)), F.array(*[F.lit(float(v)) for v in scale.values()])
    each = F.transform(F.sequence(F.lit(1), n), lambda i: F.element_at(values, F.instr(letters, F.substring(sequence, i, F.lit(1)))))
    means = F.transform(F.sequence(F.lit(1), n - w + 1), lambda i: F.aggregate(F.slice(each, i, w), F.lit(0.0), lambda a, b: a + b) / w)
    return F.when(n > 0, means).otherwise(F.array().cast("array<double>"))


def hydrophobic_moment(proteins: DataFrame, window: int = 11, angle: float = 100.0) -> DataFrame:
    """(accession, start, moment) of each window of residues (start from 0), by Eisenberg's scale; phases begin anew in each.

    With x the place of a residue, cos and sin sums over a window differ from those with phases from place 0 by a rotation,
    which the length of the vector doesn't feel: so both are sums over a moving frame."""
    rows = _residue_rows(proteins, EISENBERG)
    turn = math.radians(angle)
    line = Window.partitionBy("accession").orderBy("at")
    n = F.count("*").over(Window.partitionBy("accession"))
    frame = line.rowsBetween(0, window - 1)
    s, c = (F.sum(F.col("_v") * f(F.col("at") * turn)).over(frame) for f in (F.sin, F.cos))
    out = rows.select("accession", F.col("at").alias("start"), s.alias("_s"), c.alias("_c"), F.least(F.lit(window), n).alias("_w"), n.alias("_n"))
    return out.filter(F.col("start") <= F.col("_n") - F.col("_w")).select("accession", "start", (F.sqrt(F.col("_s") * F.col("_s") + F.col("_c") * F.col("_c")) / F.col("_w")).alias("moment"))


def sequence_tags(peaks: DataFrame, length: int = 3, tolerance: float = 0.02, key: tuple = ("spectrum_id",)) -> DataFrame:
    """(key, tag, first_mz): chains of `length` gaps between peaks that are a residue's mass each. L stands for I as well.

    A spectrum, whose size an instrument bounds, is one group: gaps are found in its sorted m/z, and chains grow by the peak that they share.
    Peaks are shuffled once, gaps and chains never."""
    masses = {k: v for k, v in ch.RESIDUES.items() if k != "I"}
    letters, names = np.array(list(masses)), list(key)

    def spread(low, high):
        n = high - low
        return np.repeat(np.arange(len(n)), n), np.repeat(low - (np.cumsum(n) - n), n) + np.arange(n.sum())

    def run(f: pd.DataFrame) -> pd.DataFrame:
        f = f.sort_values("mz", kind="stable")
        mz, peak = f["mz"].to_numpy(float), np.unique(f["peak_id"].to_numpy(), return_inverse=True)[1]
        gaps = []
        for r, m in enumerate(masses.values()):
            want = mz + m
            i, j = spread(np.searchsorted(mz, want - tolerance, "left"), np.searchsorted(mz, want + tolerance, "right"))
            gaps.append((i, j, np.full(len(i), r)))
        i, j, r = (np.concatenate(x) for x in zip(*gaps))
        order = np.argsort(peak[i], kind="stable")
        start, end, r, first = peak[i][order], peak[j][order], r[order], mz[i][order]
        tags, last, at = letters[r], end, first
        for _ in range(length - 1):
            i, j = spread(np.searchsorted(start, last, "left"), np.searchsorted(start, last, "right"))
            tags, last, at = np.char.add(tags[i], letters[r[j]]), end[j], at[i]
        found = pd.DataFrame({"tag": tags.astype(object), "first_mz": at}).drop_duplicates()
        return found.assign(**{k: f[k].iloc[0] for k in names})[[*names, "tag", "first_mz"]]

    p = peaks.select(*key, "peak_id", F.col("mz").cast("double").alias("mz")).dropna()
    schema = ", ".join(f"`{c}` {p.schema[c].dataType.simpleString()}" for c in names)
    return p.groupBy(*key).applyInPandas(run, f"{schema}, tag string, first_mz double")


def neighbour_peptides(relevant: DataFrame, others: DataFrame, mass_tolerance: float = 0.01, bin_size: float = 0.05, least: float = 0.25) -> DataFrame:
    """(relevant, peptide, share): others whose mass is close and whose b and y ions share bins with a relevant peptide's.

    share: twice the bins in common over both numbers of bins. Only pairs of close mass are compared."""
    mass = lambda d, c: d.select(F.col("peptide").alias(c)).distinct().withColumn(f"_{c}", ch.peptide_mass(F.col(c)))
    # written, as both are read several times and cost a digest each
    a, b = dealt(written(mass(relevant, "relevant"), "peptides")), written(mass(others, "peptide"), "peptides")
    close = range_join(b, a, "_peptide", F.col("_relevant") - mass_tolerance, F.col("_relevant") + mass_tolerance, max(0.1, 2 * mass_tolerance)).select("relevant", "peptide").filter("relevant != peptide")
    bins = lambda d, c: ch.fragment_ions(d.select(F.col(c).alias("peptide")).distinct()).select(F.col("peptide").alias(c), F.floor(F.col("mz") / bin_size).alias("bin")).distinct()
    ra, rb = bins(a, "relevant"), bins(b, "peptide")
    na, nb = ra.groupBy("relevant").agg(F.count("*").alias("na")), rb.groupBy("peptide").agg(F.count("*").alias("nb"))
    both = close.join(ra, "relevant").join(rb, ["peptide", "bin"]).groupBy("relevant", "peptide").agg(F.count("*").alias("n"))
    return both.join(na, "relevant").join(nb, "peptide").select("relevant", "peptide", (2 * F.col("n") / (F.col("na") + F.col("nb"))).alias("share")).filter(F.col("share") >= least)


def alignment_score(a: Column, b: Column, gap: int = 5) -> Column:
    """Best global alignment: 1 for equal residues and for the isobaric pairs I/L and K/Q, 0 for others, `gap` off for each gap.

    The rows of the table are folded one after the other, each a fold of its own, inside the JVM. An empty side costs its gaps."""
    same = F.array(F.lit("IL"), F.lit("LI"), F.lit("KQ"), F.lit("QK"))

    def row(above: Column, i: Column) -> Column:
        letter = F.substring(a, i, F.lit(1))

        def cell(done: Column, j: Column) -> Column:
            other = F.substring(b, j, F.lit(1))
            hit = F.when((letter == other) | F.array_contains(same, F.concat(letter, other)), 1).otherwise(0)
            return F.array_append(done, F.greatest(F.element_at(above, j) + hit, F.element_at(above, j + 1) - gap, F.element_at(done, -1) - gap))

        return F.when(F.length(b) > 0, F.aggregate(F.sequence(F.lit(1), F.length(b)), F.array(i * (-gap)), cell)).otherwise(F.array(i * (-gap)))

    first = F.transform(F.sequence(F.lit(0), F.length(b)), lambda j: j * (-gap))
    table = F.when(F.length(a) > 0, F.aggregate(F.sequence(F.lit(1), F.length(a)), first, row)).otherwise(first)
    return F.element_at(table, -1)


def adduct_ions(molecules: DataFrame, adducts: tuple = tuple(ADDUCTS)) -> DataFrame:
    """molecules (mass, ..) with adduct, charge and mz: (molecules x mass + atoms - charge x electron) over the charge's size."""
    each = F.inline(F.array(*[F.struct(F.lit(a).alias("adduct"), F.lit(ADDUCTS[a][1]).alias("charge"), F.lit(ADDUCTS[a][2]).alias("_n"), F.lit(ch.formula_mass(ADDUCTS[a][0])).alias("_m")) for a in adducts]))
    return molecules.select("*", each).withColumn("mz", (F.col("_n") * F.col("mass") + F.col("_m") - F.col("charge") * ELECTRON) / F.abs("charge")).drop("_n", "_m")
