"""Features of mass traces, peaks of transition groups, alignment by identifications, annotation figures, tables for statistics."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.scratch import written
from .elution import extrema
from .ranges import percentiles
from .runs import lowess

ISOTOPE = 1.00335483


def assemble_features(traces: DataFrame, charges: tuple = (1, 2, 3), tolerance: float = 0.02, isotopes: int = 4, key: tuple = ("run_id",)) -> DataFrame:
    """traces (key, trace: long, mz, rt_low, rt_high, apex, intensity) -> (key, trace, charge, n, mz, rt, intensity, traces): features.

    A hypothesis is a trace as monoisotopic, a charge, and the traces one, two .. isotopes above whose apexes lie in its time range (the
    nearest in m/z, without a gap). Hypotheses compete for traces: by number of traces, then intensity, then smaller charge and trace. In
    each round those that are the best of every trace they hold are taken, and what touches them goes; so no band is one task's work, and
    the result is that of taking the best one again and again."""
    at = traces.select(*key, "trace", "mz", "rt_low", "rt_high", "apex", "intensity")
    mono = at.select(*key, F.col("trace").alias("mono"), F.col("mz").alias("_m"), F.col("rt_low").alias("_lo"), F.col("rt_high").alias("_hi"), F.col("intensity").alias("_i"))
    want = mono.select("*", F.explode(F.array(*[F.lit(z) for z in charges])).alias("charge")).select("*", F.explode(F.sequence(F.lit(1), F.lit(isotopes))).alias("k")).withColumn("_at", F.col("_m") + F.col("k") * ISOTOPE / F.col("charge"))
    want = want.withColumn("_cell", F.explode(F.array(*[F.floor(F.col("_at") / tolerance) + d for d in (-1, 0, 1)])))
    near = want.join(at.withColumn("_cell", F.floor(F.col("mz") / tolerance)), [*key, "_cell"]).filter((F.abs(F.col("mz") - F.col("_at")) <= tolerance) & F.col("apex").between(F.col("_lo"), F.col("_hi")))
    one = near.groupBy(*key, "mono", "charge", "k").agg(F.min(F.struct(F.abs(F.col("mz") - F.col("_at")).alias("d"), "trace", "intensity")).alias("t"))
    chain = one.groupBy(*key, "mono", "charge").agg(F.sort_array(F.collect_list(F.struct("k", F.col("t.trace").alias("trace"), F.col("t.intensity").alias("intensity")))).alias("c"))
    chain = chain.withColumn("c", F.filter("c", lambda x, i: x["k"] == i + 1))  # up to the first gap
    alone = at.select(*key, F.col("trace").alias("mono"), F.lit(0).alias("charge"), F.array(F.col("trace")).alias("members"), F.col("intensity").cast("double").alias("total"))
    more = chain.filter(F.size("c") > 0).join(mono.select(*key, "mono", "_i"), [*key, "mono"])
    more = more.select(*key, "mono", "charge", F.concat(F.array("mono"), F.transform("c", lambda x: x["trace"])).alias("members"), (F.col("_i").cast("double") + F.aggregate("c", F.lit(0.0), lambda a, x: a + x["intensity"].cast("double"))).alias("total"))
    open_ = written(more.union(alone), "hypotheses")
    rank = F.struct((-F.size("members")).alias("a"), (-F.col("total")).alias("b"), "charge", "mono")
    taken = None
    while not open_.isEmpty():
        flat = open_.select(*key, "mono", "charge", rank.alias("r"), F.explode("members").alias("trace"))
        best = flat.groupBy(*key, "trace").agg(F.min("r").alias("best"))
        wins = flat.join(best, [*key, "trace"]).groupBy(*key, "mono", "charge").agg(F.min((F.col("r") == F.col("best")).cast("int")).alias("w")).filter("w = 1").select(*key, "mono", "charge")
        new = written(open_.join(wins, [*key, "mono", "charge"]), "features")
        gone = new.select(*key, F.explode("members").alias("trace"))
        touched = open_.select(*key, "mono", "charge", F.explode("members").alias("trace")).join(gone, [*key, "trace"], "left_semi").select(*key, "mono", "charge").distinct()
        open_ = written(open_.join(touched, [*key, "mono", "charge"], "left_anti"), "hypotheses")
        taken = new if taken is None else taken.unionByName(new)
    if taken is None:
        taken = open_
    base = at.select(*key, F.col("trace").alias("mono"), "mz", F.col("apex").alias("rt"))
    return taken.join(base, [*key, "mono"]).select(*key, F.col("mono").alias("trace"), "charge", F.size("members").alias("n"), "mz", "rt", F.col("total").alias("intensity"), F.col("members").alias("traces"))


def pick_groups(chromatograms: DataFrame, width: float = 20.0, least: int = 3, most: int = 100_000) -> DataFrame:
    """chromatograms (group, transition, rt, intensity) -> (group, peak, transition, rt, rt_low, rt_high, area, height, correlation): peaks of
    transition groups.

    A group's transitions are summed and smoothed; its maxima are the group's peaks, bounded by minima between them, best total first (peak 0).
    Each transition has its area and height inside and its correlation with the sum. A group is one task's work, `most` points at most."""

    def run(f: pd.DataFrame) -> pd.DataFrame:
        if len(f) > most:
            raise ValueError(f"{len(f)} points of one group; at most {most}")
        t = f.pivot_table(index="rt", columns="transition", values="intensity", aggfunc="sum", fill_value=0.0).sort_index()
        x, rows = t.index.to_numpy(float), []
        total = t.sum(axis=1).to_numpy(float)
        step = np.median(np.diff(x)) if len(x) > 1 else 1.0
        reach = max(1, int(width / max(step, 1e-9) / 2))
        smooth = np.maximum(lowess(x, total, min(1.0, max((2 * reach + 1) / len(x), 3 / len(x))), 0), 0) if len(x) > 3 else total
        tops, lows = extrema(smooth, reach)
        parts = [(a, b) for a, b in zip([0, *lows], [*(v + 1 for v in lows), len(x)]) if b - a >= least and tops]
        parts.sort(key=lambda p: (-total[p[0] : p[1]].sum(), p[0]))
        for k, (a, b) in enumerate(parts):
            top = a + int(np.argmax(smooth[a:b]))
            for name in t.columns:
                y = t[name].to_numpy(float)[a:b]
                both = y.std() > 0 and total[a:b].std() > 0
                rows.append((f["group"].iloc[0], k, name, x[top], x[a], x[b - 1], float(np.trapezoid(y, x[a:b])), float(y.max()), float(np.corrcoef(y, total[a:b])[0, 1]) if both else 0.0))
        return pd.DataFrame(rows, columns=["group", "peak", "transition", "rt", "rt_low", "rt_high", "area", "height", "correlation"])

    src = chromatograms.select("group", "transition", F.col("rt").cast("double").alias("rt"), F.col("intensity").cast("double").alias("intensity"))
    kinds = dict(src.dtypes)
    return src.groupBy("group").applyInPandas(run, f"group {kinds['group']}, peak int, transition {kinds['transition']}, rt double, rt_low double, rt_high double, area double, height double, correlation double")


def align_by_identifications(hits: DataFrame, least: int = 2, map_: str = "run_id", name: str = "peptide") -> DataFrame:
    """hits (map, peptide, rt) -> (map, slope, intercept, n): the line that takes each map's times to the reference.

    A peptide's time in a map is the median of its hits', the reference time the median over maps; peptides of fewer than `least`
    maps don't count. Maps with fewer than two such times get the shift of their mean alone; maps without any, no row."""
    own = percentiles(hits.filter(F.col("rt").isNotNull()), [map_, name], "rt", [0.5]).select(map_, name, F.col("p")[0].alias("x"))
    ref = percentiles(own, [name], "x", [0.5]).select(name, F.col("p")[0].alias("y"))
    many = own.groupBy(name).agg(F.count("*").alias("_n")).filter(F.col("_n") >= least)
    pairs = own.join(ref, name).join(many, name)
    s = pairs.groupBy(map_).agg(F.regr_slope("y", "x").alias("slope"), F.avg("x").alias("_x"), F.avg("y").alias("_y"), F.count("*").alias("n"))
    slope = F.coalesce(F.when(~F.isnan("slope"), F.col("slope")), F.lit(1.0))
    return s.select(map_, slope.alias("slope"), (F.col("_y") - slope * F.col("_x")).alias("intercept"), "n")


def annotation_statistics(matches: DataFrame, peaks: DataFrame, top: int = 10) -> DataFrame:
    """(spectrum_id, peptide, n_ions, share, top_matched, error): of the ions that a spectrum shows, their share of its intensity, how many of
    its `top` most intense peaks they explain, and their mean error. A peak that several ions explain counts once for share and top."""
    tic = peaks.groupBy("spectrum_id").agg(F.sum("intensity").alias("_t"))
    high = peaks.groupBy("spectrum_id").agg(F.slice(F.reverse(F.sort_array(F.collect_list(F.struct("intensity", (-F.col("peak_id")).alias("p"))))), 1, top).alias("_h")).select("spectrum_id", F.explode("_h").alias("h")).select("spectrum_id", (-F.col("h.p")).alias("peak_id"), F.lit(1).alias("_top"))
    ions = matches.groupBy("spectrum_id", "peptide").agg(F.count("*").alias("n_ions"), F.avg("error").alias("error"))
    once = matches.select("spectrum_id", "peptide", "peak_id", "intensity").distinct().join(high, ["spectrum_id", "peak_id"], "left")
    sums = once.groupBy("spectrum_id", "peptide").agg(F.sum("intensity").alias("_i"), F.count("_top").alias("top_matched"))
    return ions.join(sums, ["spectrum_id", "peptide"]).join(tic, "spectrum_id").select("spectrum_id", "peptide", "n_ions", F.when(F.col("_t") > 0, F.col("_i") / F.col("_t")).otherwise(0.0).alias("share"), "top_matched", "error")


def statistics_table(quantities: DataFrame, design: DataFrame) -> DataFrame:
    """quantities (run_id, accession, peptide, charge, intensity) with the design (run_id, condition, replicate) in the columns that MSstats reads; runs without a design are an error."""
    t = quantities.groupBy("run_id", "accession", "peptide", "charge").agg(F.max("intensity").alias("intensity")).join(design, "run_id", "left")
    checked = F.when(F.col("condition").isNotNull(), F.col("condition").cast("string")).otherwise(F.raise_error(F.concat(F.lit("no design for run "), F.col("run_id").cast("string"))))
    return t.select(
        F.col("accession").alias("ProteinName"), F.col("peptide").alias("PeptideSequence"), F.col("charge").alias("PrecursorCharge"), F.lit("NA").alias("FragmentIon"), F.lit(0).alias("ProductCharge"), F.lit("L").alias("IsotopeLabelType"),
        checked.alias("Condition"), F.col("replicate").alias("BioReplicate"), F.col("run_id").alias("Run"), F.col("intensity").alias("Intensity"))
