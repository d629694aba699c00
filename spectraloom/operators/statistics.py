"""Statistics per key by partial sums: histograms, ranks, densities, regressions, fits by moments, noise and overlaps."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .joins import range_join
from .ranges import in_ranges, joined, percentiles, running


def histogram(values: DataFrame, key: tuple, value: str, low: float, width: float, bins: int) -> DataFrame:
    """(key, bin, left, n, cumulative) of the bins that hold a value; values outside [low, low + bins * width] are left out.

    The upper end belongs to the last bin."""
    v = F.col(value)
    inside = values.filter(v.between(low, low + bins * width))
    at = F.least(F.floor((v - low) / width), F.lit(bins - 1)).cast("long")
    n = inside.groupBy(*key, at.alias("bin")).agg(F.count("*").alias("n"))
    run = F.sum("n").over(Window.partitionBy(*key).orderBy("bin"))
    return n.select(*key, "bin", (F.col("bin") * width + low).alias("left"), "n", run.alias("cumulative"))


def ranks(values: DataFrame, key: tuple, value: str, method: str = "average") -> DataFrame:
    """values with rank from 1: average, min, max or dense for equal values; nulls have none."""
    counts = values.filter(F.col(value).isNotNull()).groupBy(*key, value).agg(F.count("*").alias("_n"))
    run = running(in_ranges(counts, key, value), [value], {"_before": ("_n", "sum"), "_places": (F.lit(1), "sum")}, inclusive=False)
    first = F.col("_before") + 1
    out = {"min": first, "max": F.col("_before") + F.col("_n"), "average": first + (F.col("_n") - 1) / 2, "dense": F.col("_places") + 1}[method]
    run = run.select(F.struct(*key, value).alias("_at"), out.cast("double").alias("rank"))
    return values.withColumn("_at", F.struct(*key, value)).join(run, "_at", "left").drop("_at")


def bandwidth(values: DataFrame, key: tuple, value: str) -> DataFrame:
    """(key, n, bandwidth): 0.9 n^-1/5 times the smaller of the deviation and the quartile range over 1.34; the deviation if that range is 0, then 1."""
    s = values.groupBy(*key).agg(F.count(value).alias("n"), F.stddev_samp(value).alias("_s"))
    s = joined(s, percentiles(values, key, value, [0.25, 0.75]).withColumnRenamed("p", "_q"), key, "left")
    spread = F.least("_s", (F.col("_q")[1] - F.col("_q")[0]) / 1.34)
    spread = F.when(spread > 0, spread).when(F.col("_s") > 0, F.col("_s")).otherwise(1.0)
    return s.select(*key, "n", (0.9 * spread * F.pow(F.col("n").cast("double"), F.lit(-0.2))).alias("bandwidth"))


def density(values: DataFrame, key: tuple, value: str, width: float, band: float, reach: float = 4.0) -> DataFrame:
    """(key, cell, at, density): Gaussian kernel density at the centres of cells, of values moved to their cell's centre.

    Cells are counted first; each count then adds to the cells within `reach` bandwidths, so no value meets the grid."""
    n = values.groupBy(*key, F.floor(F.col(value) / width).cast("long").alias("_c")).agg(F.count("*").alias("_n"))
    far = int(math.ceil(reach * band / width))
    near = n.select(*key, "_c", "_n", F.explode(F.sequence(F.lit(-far), F.lit(far))).alias("_d"))
    part = F.col("_n") * F.exp(-F.pow(F.col("_d") * width / band, 2) / 2)
    total = n.groupBy(*key).agg(F.sum("_n").alias("_t"))
    out = near.groupBy(*key, (F.col("_c") + F.col("_d")).alias("cell")).agg(F.sum(part).alias("_s")).join(total, list(key))
    return out.select(*key, "cell", ((F.col("cell") + 0.5) * width).alias("at"), (F.col("_s") / (F.col("_t") * band * math.sqrt(2 * math.pi))).alias("density"))


def regressions(points: DataFrame, key: tuple, x: str, y: str) -> DataFrame:
    """(key, n, slope, intercept, r2, slope0, a, b, c): the least-squares line, the line through the origin, and a + b x + c x^2.

    One partial aggregation of sums of powers; they lose digits for x beyond some thousands, so scale it."""
    u, v = F.col(x).cast("double"), F.col(y).cast("double")
    s = points.groupBy(*key).agg(
        F.count("*").alias("n"), F.regr_slope(v, u).alias("slope"), F.regr_intercept(v, u).alias("intercept"), F.regr_r2(v, u).alias("r2"),
        F.sum(u).alias("s1"), F.sum(u * u).alias("s2"), F.sum(u * u * u).alias("s3"), F.sum(u * u * u * u).alias("s4"), F.sum(v).alias("t0"), F.sum(u * v).alias("t1"), F.sum(u * u * v).alias("t2"),
    )
    c = {k: F.col(k) for k in ("n", "s1", "s2", "s3", "s4", "t0", "t1", "t2")}

    def det(a, b, d):
        return a[0] * (b[1] * d[2] - b[2] * d[1]) - b[0] * (a[1] * d[2] - a[2] * d[1]) + d[0] * (a[1] * b[2] - a[2] * b[1])

    one, two, three, right = (c["n"], c["s1"], c["s2"]), (c["s1"], c["s2"], c["s3"]), (c["s2"], c["s3"], c["s4"]), (c["t0"], c["t1"], c["t2"])
    whole = det(one, two, three)
    part = lambda d: F.when(F.abs(whole) > 0, d / whole)
    return s.select(*key, "n", "slope", "intercept", "r2", F.try_divide("t1", "s2").alias("slope0"), part(det(right, two, three)).alias("a"), part(det(one, right, three)).alias("b"), part(det(one, two, right)).alias("c"))


def weighted_moments(points: DataFrame, key: tuple, x: str, weight: str) -> DataFrame:
    """(key, mean, variance, height): moments of x by weights (negative ones are 0) and the height of the normal curve of the same area."""
    w = F.greatest(F.col(weight).cast("double"), F.lit(0.0))
    s = points.groupBy(*key).agg(F.sum(w).alias("_w"), F.sum(w * F.col(x)).alias("_m"), F.sum(w * F.col(x) * F.col(x)).alias("_q"))
    s = s.filter("_w > 0").select(*key, "_w", (F.col("_m") / F.col("_w")).alias("mean"), (F.col("_q") / F.col("_w")).alias("_q")).withColumn("variance", F.greatest(F.col("_q") - F.col("mean") * F.col("mean"), F.lit(0.0)))
    return s.select(*key, "mean", "variance", F.when(F.col("variance") > 0, F.col("_w") / F.sqrt(2 * math.pi * F.col("variance"))).alias("height"))


def score_models(hits: DataFrame, pool: tuple = ("run_id",)) -> DataFrame:
    """(pool, mu, sigma, shape, rate, share): a normal curve of the targets' scores and a gamma curve of the positive decoy scores, by moments.

    share: targets among all hits."""
    t, d = F.when(~F.col("decoy"), F.col("score")), F.when(F.col("decoy") & (F.col("score") > 0), F.col("score"))
    s = hits.groupBy(*pool).agg(F.avg(t).alias("mu"), F.stddev_pop(t).alias("sigma"), F.avg(d).alias("_m"), F.var_pop(d).alias("_v"), F.avg((~F.col("decoy")).cast("double")).alias("share"))
    return s.select(*pool, "mu", "sigma", F.try_divide(F.col("_m") * F.col("_m"), "_v").alias("shape"), F.try_divide("_m", "_v").alias("rate"), "share")


def mean_noise(peaks: DataFrame, window: float = 200.0, rounds: int = 3, factor: float = 3.0, key: tuple = ("spectrum_id",)) -> DataFrame:
    """peaks with sn: intensity over the noise of its m/z window. The noise is the mean of intensities in the window, then of those not above
    mean + factor deviations, and so on; never below 1."""
    p = peaks.withColumn("_b", F.floor(F.col("mz") / window))
    kept = p
    for r in range(rounds):
        m = kept.groupBy(*key, "_b").agg(F.avg("intensity").alias("_m"), F.stddev_pop("intensity").alias("_s"))
        if r < rounds - 1:
            kept = p.join(m, [*key, "_b"]).filter(F.col("intensity") <= F.col("_m") + factor * F.col("_s")).drop("_m", "_s")
    return p.join(m, [*key, "_b"]).withColumn("sn", F.col("intensity") / F.greatest("_m", F.lit(1.0))).drop("_b", "_m", "_s")


def drop_overlaps(features: DataFrame, mz_tolerance: float, rt_tolerance: float) -> DataFrame:
    """Features without a more intense one (ties: smaller id) of the same map and charge within both tolerances."""
    better = features.select("map_id", "charge", F.col("feature_id").alias("_id"), F.col("mz").alias("_mz"), F.col("rt").alias("_rt"), F.col("intensity").alias("_int"))
    near = range_join(features, better, "mz", F.col("_mz") - mz_tolerance, F.col("_mz") + mz_tolerance, 2 * mz_tolerance, ("map_id", "charge"))
    worse = near.filter((F.abs(F.col("rt") - F.col("_rt")) <= rt_tolerance) & ((F.col("_int") > F.col("intensity")) | ((F.col("_int") == F.col("intensity")) & (F.col("_id") < F.col("feature_id"))))).select("feature_id").distinct()
    return features.join(worse, "feature_id", "left_anti")


def merge_chromatograms(points: DataFrame, key: tuple = ("run_id", "target"), width: float = 5.0) -> DataFrame:
    """(key, rt_cell, rt, intensity, n): points of equal names in cells of time, intensities summed, times their mean by intensity."""
    w = F.greatest(F.col("intensity").cast("double"), F.lit(0.0))
    s = points.groupBy(*key, F.floor(F.col("rt") / width).alias("rt_cell")).agg(F.sum("intensity").alias("intensity"), F.sum(w * F.col("rt")).alias("_r"), F.sum(w).alias("_w"), F.avg("rt").alias("_a"), F.count("*").alias("n"))
    return s.select(*key, "rt_cell", F.coalesce(F.try_divide("_r", "_w"), "_a").alias("rt"), "intensity", "n")


def ransac(pairs: DataFrame, x: str, y: str, threshold: float, tries: int = 200, least: int = 10, seed: int = 1, key: tuple = ("run_id",)) -> DataFrame:
    """pairs that lie within threshold of the line that most pairs agree with; keys are runs with their standards.

    Lines through two random pairs are tried, the best one is fitted anew to those that agree; keys with fewer than `least` pairs that agree keep all."""
    fields = pairs.columns

    def run(f: pd.DataFrame) -> pd.DataFrame:
        f = f.sort_values([x, y], kind="stable")
        a, b = f[x].to_numpy(float), f[y].to_numpy(float)
        rng, best = np.random.default_rng(seed), np.zeros(len(f), bool)
        for _ in range(tries if len(f) > 2 else 0):
            i, j = rng.choice(len(f), 2, replace=False)
            if a[i] == a[j]:
                continue
            slope = (b[j] - b[i]) / (a[j] - a[i])
            ok = np.abs(b - b[i] - slope * (a - a[i])) <= threshold
            if ok.sum() > best.sum():
                best = ok
        if best.sum() >= least:
            slope, base = np.polyfit(a[best], b[best], 1)
            again = np.abs(b - base - slope * a) <= threshold
            return f[again if again.sum() >= best.sum() else best][fields]
        return f[fields]

    return pairs.groupBy(*key).applyInPandas(run, pairs.schema)
