"""Assays: transitions of peptides and their decoys, isotope scores, mass correction, purity between survey scans, lookups, quantity matrices."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import chemistry as ch
from .joins import nearest_before, precursor_purity, range_join

ISOTOPE = 1.00335483
#: Heavy isotopes by mass unit in a mean peptide.
_HEAVY = 5.36e-4


def make_transitions(peptides: DataFrame, charges: tuple = (2, 3), low: float = 350.0, high: float = 2000.0, first: int = 3) -> DataFrame:
    """(peptide, charge, precursor_mz, ion, position, product_mz): singly charged b and y ions from position `first` on inside of [low, high], for precursors inside as well."""
    p = peptides.select("peptide").distinct()
    ions = ch.fragment_ions(p).filter(F.col("position") >= first).filter(F.col("mz").between(low, high)).withColumnRenamed("mz", "product_mz")
    z = F.explode(F.array(*[F.lit(int(c)) for c in charges]))
    pre = p.select("peptide", z.alias("charge")).withColumn("precursor_mz", ch.peptide_mass(F.col("peptide")) / F.col("charge") + ch.PROTON).filter(F.col("precursor_mz").between(low, high))
    return pre.join(ions, "peptide").select("peptide", "charge", "precursor_mz", "ion", "position", "product_mz")


def decoy_peptides(peptides: DataFrame) -> DataFrame:
    """(peptide, decoy): each with its sequence reversed but for the last residue; those that are a target themselves, or stay as they are, have none."""
    p = peptides.select("peptide").distinct()
    d = p.select("peptide", ch.decoy_sequence(F.col("peptide")).alias("decoy")).filter("decoy <> peptide")
    return d.join(p.select(F.col("peptide").alias("decoy")), "decoy", "left_anti").select("peptide", "decoy")


def expected_pattern(mass: Column, isotopes: int) -> list[Column]:
    """Shares of the first isotope peaks of a mean peptide, by the Poisson law of its heavy isotopes."""
    rate = mass * _HEAVY
    return [F.exp(-rate) * F.pow(rate, F.lit(float(k))) / math.factorial(k) for k in range(isotopes)]


def isotope_scores(peaks: DataFrame, ions: DataFrame, tolerance: float, charge: int = 1, isotopes: int = 4) -> DataFrame:
    """(spectrum_id, ion_id, total, correlation): intensities at an ion's first isotopes, and their correlation with the expected pattern.

    ions: (spectrum_id, ion_id, ion_mz). Intensities within the tolerance of each isotope are summed, 0 without peaks; ions without any
    have no row; the correlation of equal intensities is null. A spectrum, whose size an instrument bounds, is one group: its peaks and ions
    are shuffled once, pairs never."""
    p = peaks.select("spectrum_id", F.lit(None).cast(ions.schema["ion_id"].dataType).alias("ion_id"), F.col("mz").cast("double").alias("mz"), F.col("intensity").cast("double").alias("intensity"), F.lit(False).alias("_ion"))
    q = ions.select("spectrum_id", "ion_id", F.col("ion_mz").cast("double").alias("mz"), F.lit(None).cast("double").alias("intensity"), F.lit(True).alias("_ion"))

    def run(t: pa.Table) -> pa.Table:
        is_ion = t["_ion"].to_numpy()
        own = t.filter(pa.array(~is_ion))
        mz, y = own["mz"].to_numpy(), own["intensity"].fill_null(0.0).to_numpy()
        order = np.argsort(mz, kind="stable")
        mz, y = mz[order], np.append(y[order], 0.0)
        of = t.filter(pa.array(is_ion)).sort_by("mz")
        at, sums, n = of["mz"].to_numpy(), [], 0
        for k in range(isotopes):
            here = at + k * ISOTOPE / charge
            low, high = np.searchsorted(mz, here - tolerance, "left"), np.searchsorted(mz, here + tolerance, "right")
            s = np.add.reduceat(y, np.stack([low, high], 1).ravel())[::2] if len(at) else np.zeros(0)
            sums.append(np.where(high > low, s, 0.0))
            n = n + (high - low)
        out = pa.table([of["spectrum_id"], of["ion_id"], of["mz"], *map(pa.array, sums)], names=["spectrum_id", "ion_id", "ion_mz", *[f"_i{k}" for k in range(isotopes)]])
        return out.filter(pa.array(n > 0)) if len(at) else out

    kind = {c: q.schema[c].dataType.simpleString() for c in ("spectrum_id", "ion_id")}
    rows = p.unionByName(q).filter("mz IS NOT NULL AND spectrum_id IS NOT NULL")
    s = rows.groupBy("spectrum_id").applyInArrow(run, f"spectrum_id {kind['spectrum_id']}, ion_id {kind['ion_id']}, ion_mz double, " + ", ".join(f"_i{k} double" for k in range(isotopes)))
    x, y = [F.col(f"_i{k}") for k in range(isotopes)], expected_pattern((F.col("ion_mz") - ch.PROTON) * charge, isotopes)
    add = lambda cs: sum(cs[1:], cs[0])
    mx, my = add(x) / isotopes, add(y) / isotopes
    both, sx, sy = add([(a - mx) * (b - my) for a, b in zip(x, y)]), add([(a - mx) * (a - mx) for a in x]), add([(b - my) * (b - my) for b in y])
    return s.select("spectrum_id", "ion_id", add(x).alias("total"), F.when((sx > 1e-12) & (sy > 0), both / F.sqrt(sx * sy)).alias("correlation"))


def mass_errors(peaks: DataFrame, references: DataFrame, ppm: float) -> DataFrame:
    """(run_id, reference, error, n): mean error in ppm, weighted by intensity, of a run's peaks within ppm of each reference (reference, reference_mz).

    References of one m/z have the same error, which is found once."""
    width = F.col("reference_mz") * (ppm * 1e-6)
    near = range_join(peaks.select("run_id", "mz", "intensity"), references.select("reference_mz").distinct(), "mz", F.col("reference_mz") - width, F.col("reference_mz") + width, 1.0).filter("intensity > 0")
    off = (F.col("mz") - F.col("reference_mz")) / F.col("reference_mz") * 1e6
    each = near.groupBy("run_id", "reference_mz").agg((F.sum(off * F.col("intensity")) / F.sum("intensity")).alias("error"), F.count("*").alias("n"))
    named = references.groupBy("reference", "reference_mz").agg(F.count("*").alias("_k"))
    return each.join(named, "reference_mz").select("run_id", "reference", "reference_mz", "error", (F.col("n") * F.col("_k")).alias("n"))


def correct_masses(peaks: DataFrame, references: DataFrame, ppm: float) -> DataFrame:
    """peaks with mz corrected by the line of each run's mass errors over m/z (its mean error if one reference is found, nothing if none)."""
    e = mass_errors(peaks, references, ppm)
    line = e.groupBy("run_id").agg(F.regr_slope("error", "reference_mz").alias("_b"), F.avg("error").alias("_y"), F.avg("reference_mz").alias("_x"))
    slope = F.coalesce(F.when(~F.isnan("_b"), F.col("_b")), F.lit(0.0))
    line = line.select(F.struct("run_id").alias("_run"), slope.alias("_b"), (F.col("_y") - slope * F.col("_x")).alias("_a"))
    both = peaks.withColumn("_run", F.struct("run_id")).join(line, "_run", "left")
    error = F.coalesce(F.col("_a") + F.col("_b") * F.col("mz"), F.lit(0.0))
    return both.withColumn("mz", F.col("mz") / (1 + error * 1e-6)).drop("_run", "_a", "_b")


def interpolated_purity(peaks: DataFrame, precursors: DataFrame, tolerance: float, window: float) -> DataFrame:
    """(precursor_id, before, after, purity): purity of precursors (precursor_id, run_id, rt, precursor_mz) in the survey spectra (level 1) before and
    after them, and at their time between the two by proportion; that of the one there is, if there is one only."""
    survey = peaks.filter("ms_level = 1").select("run_id", "spectrum_id", "rt").distinct()
    # ties in time go to the smaller spectrum
    one = survey.groupBy("run_id", "rt").agg(F.min("spectrum_id").alias("spectrum_id"))
    p = precursors.select("precursor_id", "run_id", "rt", "precursor_mz")
    side = lambda left, right: nearest_before(left, right.withColumn("_s", F.struct("spectrum_id", F.col("rt").alias("at"))), "run_id", "rt", "_s").select("precursor_id", "rt", "precursor_mz", F.col("_s_before.spectrum_id").alias("spectrum_id"), F.abs("_s_before.at").alias("at"))
    back = lambda df: df.withColumn("rt", -F.col("rt"))
    found = {"before": side(p, one), "after": back(side(back(p), back(one)))}
    share = {k: precursor_purity(peaks.filter("ms_level = 1"), v.filter("spectrum_id IS NOT NULL").select("precursor_id", "spectrum_id", "precursor_mz"), tolerance, window).select("precursor_id", F.col("purity").alias(k)) for k, v in found.items()}
    at = found["before"].select("precursor_id", "rt", F.col("at").alias("_t0"), F.col("spectrum_id").alias("_s0")).join(found["after"].select("precursor_id", F.col("at").alias("_t1"), F.col("spectrum_id").alias("_s1")), "precursor_id")
    at = at.join(share["before"], "precursor_id", "left").join(share["after"], "precursor_id", "left")
    a, b = F.when(F.col("_s0").isNotNull(), F.coalesce("before", F.lit(0.0))), F.when(F.col("_s1").isNotNull(), F.coalesce("after", F.lit(0.0)))
    t = F.when(F.col("_t1") > F.col("_t0"), (F.col("rt") - F.col("_t0")) / (F.col("_t1") - F.col("_t0"))).otherwise(0.0)
    return at.select("precursor_id", a.alias("before"), b.alias("after"), F.coalesce(a + (b - a) * t, a, b).alias("purity"))


def lookup_by_time(spectra: DataFrame, wanted: DataFrame, tolerance: float) -> DataFrame:
    """wanted (query_id, run_id, rt) with the spectrum of its run that is nearest in time within the tolerance (ties: the earlier, then smaller id); none without."""
    w = wanted.select("query_id", "run_id", F.col("rt").alias("_rt"))
    near = range_join(spectra.select("run_id", "spectrum_id", "rt").distinct(), w, "rt", F.col("_rt") - tolerance, F.col("_rt") + tolerance, 2 * tolerance, ("run_id",))
    best = near.groupBy("query_id").agg(F.min(F.struct(F.abs(F.col("rt") - F.col("_rt")).alias("d"), "rt", "spectrum_id")).alias("b"))
    return wanted.join(best, "query_id", "left").select("query_id", "run_id", F.col("b.spectrum_id").alias("spectrum_id"), F.col("b.d").alias("distance"))


def matrix(quantities: DataFrame, rows: tuple, column: str, value: str, names: list) -> DataFrame:
    """One row for each key and one column for each of `names` (values of `column`), with the sum of `value`; null where there is none."""
    return quantities.groupBy(*rows).agg(*[F.sum(F.when(F.col(column) == n, F.col(value))).alias(f"{column}_{n}") for n in names])
