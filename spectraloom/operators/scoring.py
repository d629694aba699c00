"""Peptide-spectrum matching: which theoretical ions a spectrum shows, and the scores made of that."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import chemistry as ch
from ..sources.tables import dealt
from .joins import range_join
from .ranges import in_ranges, joined, running


def candidates(peptides: DataFrame, precursors: DataFrame, tolerance: float, cell: float = 1.0) -> DataFrame:
    """(spectrum_id, peptide, mass): peptides whose mass is within tolerance of a precursor's."""
    mass = peptides.select("peptide", ch.peptide_mass(F.col("peptide")).alias("mass"))
    want = dealt(precursors.select("spectrum_id", F.col("precursor_mass")))
    return range_join(mass, want, "mass", F.col("precursor_mass") - tolerance, F.col("precursor_mass") + tolerance, cell).select("spectrum_id", "peptide", "mass")


def match_ions(peaks: DataFrame, psms: DataFrame, tolerance: float) -> DataFrame:
    """(spectrum_id, peptide, ion, position, intensity, error, peak_id): for each b or y ion the nearest peak within tolerance (ties: the lower m/z).

    A spectrum, whose size an instrument bounds, is one group: its peaks and the ions of its candidates are shuffled once, pairs never."""
    ions = ch.fragment_ions(psms.select("peptide").distinct())
    want = psms.select("spectrum_id", "peptide").distinct().join(ions.withColumnRenamed("mz", "ion_mz"), "peptide")
    kinds = dict(peaks.select("spectrum_id", "peak_id", "intensity").dtypes) | dict(want.select("peptide", "ion", "position").dtypes)
    none = lambda c: F.lit(None).cast(kinds[c]).alias(c)
    rows = peaks.select("spectrum_id", none("peptide"), none("ion"), none("position"), "peak_id", F.col("mz").cast("double").alias("mz"), "intensity")
    rows = rows.unionByName(want.select("spectrum_id", "peptide", "ion", "position", none("peak_id"), F.col("ion_mz").alias("mz"), none("intensity"))).filter("mz IS NOT NULL AND spectrum_id IS NOT NULL")

    def run(t: pa.Table) -> pa.Table:
        is_ion = t["ion"].is_valid()
        p = t.filter(pc.invert(is_ion)).sort_by([("mz", "ascending"), ("intensity", "descending"), ("peak_id", "ascending")])
        q = t.filter(is_ion)
        mz, at = p["mz"].to_numpy(), q["mz"].to_numpy()
        if not len(mz) or not len(at):
            return pa.table({c: pa.array([], f.type) for c, f in zip(names, [*(t.schema.field(c) for c in names[:5]), t.schema.field("mz"), t.schema.field("peak_id")])})
        # the first peak of those at the next m/z from the ion's on, and of those at the last m/z below it
        right = np.searchsorted(mz, at, "left")
        left = np.searchsorted(mz, mz[np.maximum(right - 1, 0)], "left")

        def off(k: np.ndarray, there: np.ndarray) -> np.ndarray:
            m = mz[np.minimum(k, len(mz) - 1)]
            return np.where(there & (m >= at - tolerance) & (m <= at + tolerance), np.abs(m - at), np.inf)

        below, above = off(left, right > 0), off(right, right < len(mz))
        best, error = np.where(below <= above, left, right), np.minimum(below, above)
        has = np.isfinite(error)
        q, best = q.filter(pa.array(has)), p.take(pa.array(best[has]))
        return pa.table([q["spectrum_id"], q["peptide"], q["ion"], q["position"], best["intensity"], pa.array(error[has]), best["peak_id"]], names=names)

    names = ["spectrum_id", "peptide", "ion", "position", "intensity", "error", "peak_id"]
    return rows.groupBy("spectrum_id").applyInArrow(run, ", ".join(f"{c} {'double' if c == 'error' else kinds[c]}" for c in names))


def hyperscore(matches: DataFrame) -> DataFrame:
    """(spectrum_id, peptide, score, n_b, n_y, mean_error): log(1 + sum of intensities) + log(b matches!) + log(y matches!)."""
    n = matches.groupBy("spectrum_id", "peptide").agg(F.sum("intensity").alias("dot"), F.sum((F.col("ion") == "b").cast("int")).alias("n_b"), F.sum((F.col("ion") == "y").cast("int")).alias("n_y"), F.avg("error").alias("mean_error"))
    # log n!: a sum over few matches
    log_factorial = lambda c: F.aggregate(F.sequence(F.lit(1), F.greatest(F.col(c), F.lit(1)).cast("int")), F.lit(0.0), lambda a, x: a + F.log(x.cast("double")))
    return n.select("spectrum_id", "peptide", (F.log1p("dot") + log_factorial("n_b") + log_factorial("n_y")).alias("score"), "n_b", "n_y", "mean_error")


def morpheus(matches: DataFrame, peaks: DataFrame) -> DataFrame:
    """(spectrum_id, peptide, score): matched ions plus the matched share of the spectrum's intensity."""
    tic = peaks.groupBy("spectrum_id").agg(F.sum("intensity").alias("tic"))
    n = matches.groupBy("spectrum_id", "peptide").agg(F.count("*").alias("n"), F.sum("intensity").alias("i")).join(tic, "spectrum_id")
    return n.select("spectrum_id", "peptide", (F.col("n") + F.when(F.col("tic") > 0, F.col("i") / F.col("tic")).otherwise(0.0)).alias("score"))


def index_peptides(peptides: DataFrame, proteins: DataFrame) -> DataFrame:
    """(peptide, accession, start): every fully tryptic place of each peptide in the proteins, by an equi-join with their digest."""
    parts = ch.digest(proteins, 2)
    return peptides.select("peptide").distinct().join(parts, "peptide").select("peptide", "accession", "start")


def sequence_coverage(peptides: DataFrame, proteins: DataFrame) -> DataFrame:
    """(accession, coverage): share of each sequence within its peptides, at all places where they occur, overlapping ones too."""
    hit = peptides.filter(F.length("peptide") > 0).select("accession", "peptide").distinct().join(proteins, "accession")
    places = F.filter(F.sequence(F.lit(1), F.greatest(F.length("sequence") - F.length("peptide") + 1, F.lit(1))), lambda i: F.substring("sequence", i, F.length("peptide")) == F.col("peptide"))
    span = hit.select("accession", F.explode(places).alias("a"), F.length("peptide").alias("_n")).select("accession", "a", (F.col("a") + F.col("_n")).alias("b")).distinct()
    o = Window.partitionBy("accession").orderBy("a", "b").rowsBetween(Window.unboundedPreceding, -1)
    new = span.withColumn("_e", F.max("b").over(o)).withColumn("add", F.greatest(F.lit(0), F.col("b") - F.greatest("a", F.coalesce("_e", "a"))))
    total = new.groupBy("accession").agg(F.sum("add").alias("covered"))
    return proteins.join(total, "accession", "left").select("accession", F.when(F.length("sequence") > 0, F.coalesce("covered", F.lit(0)) / F.length("sequence")).otherwise(0.0).alias("coverage"))


def resolve_shared(links: DataFrame, scores: DataFrame) -> DataFrame:
    """Of the proteins that share a peptide, the one with the best score (ties: accession)."""
    o = Window.partitionBy("peptide").orderBy(F.desc("score"), "accession")
    return links.select("peptide", "accession").distinct().join(scores, "accession").withColumn("_r", F.row_number().over(o)).filter("_r = 1").drop("_r")


def normalize_quantiles(features: DataFrame, steps: int = 1000) -> DataFrame:
    """Maps with equal intensity distributions: each value becomes the mean over maps at its relative rank (of `steps`, 1000 unless given)."""
    run = running(in_ranges(features, ["map_id"], "intensity"), ["intensity", "feature_id"], {"_at": (F.lit(1), "sum")}, inclusive=False).drop("_pool", "_range")
    ranked = joined(run, features.groupBy("map_id").agg(F.count("*").alias("_n")), ["map_id"]).withColumn("_q", F.floor(F.col("_at") * steps / F.col("_n"))).drop("_at", "_n")
    level = ranked.groupBy("map_id", "_q").agg(F.avg("intensity").alias("m")).groupBy("_q").agg(F.avg("m").alias("m"))
    return ranked.join(level, "_q").withColumn("intensity", F.col("m")).drop("_q", "m")
