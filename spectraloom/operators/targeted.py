"""Targeted analysis: similarity of measured and library intensities, co-elution of traces, isolation windows, contexts.

Vectors are rows of one key with two values (x measured, y library); all scores of a key come from partial sums, so that only
the scores that need ranks or neighbours sort its rows.
"""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .identification import running_curve
from .joins import range_join


def similarity(vectors: DataFrame, key: tuple, x: str = "x", y: str = "y") -> DataFrame:
    """(key, n, rmsd, angle, dot, pearson) of the two values.

    rmsd: root of the mean squared difference. angle: arc cosine of the cosine, pi / 2 if either is all zero. dot: cosine of the
    square roots (negative values are 0). pearson: null where either is constant."""
    a, b = F.col(x).cast("double"), F.col(y).cast("double")
    root = lambda c: F.sqrt(F.greatest(c, F.lit(0.0)))
    sums = vectors.groupBy(*key).agg(
        F.count("*").alias("n"),
        F.sum((a - b) * (a - b)).alias("_d2"),
        F.sum(a * b).alias("_ab"),
        F.sum(a * a).alias("_aa"),
        F.sum(b * b).alias("_bb"),
        F.sum(root(a) * root(b)).alias("_rab"),
        F.sum(F.greatest(a, F.lit(0.0))).alias("_ra"),
        F.sum(F.greatest(b, F.lit(0.0))).alias("_rb"),
        F.corr(a, b).alias("pearson"),
    )
    cosine = lambda ab, aa, bb: F.when((aa > 0) & (bb > 0), F.greatest(F.lit(-1.0), F.least(F.lit(1.0), ab / F.sqrt(aa * bb)))).otherwise(0.0)
    return sums.select(
        *key,
        "n",
        F.sqrt(F.col("_d2") / F.col("n")).alias("rmsd"),
        F.acos(cosine(F.col("_ab"), F.col("_aa"), F.col("_bb"))).alias("angle"),
        cosine(F.col("_rab"), F.col("_ra"), F.col("_rb")).alias("dot"),
        "pearson",
    )


def manhattan(vectors: DataFrame, key: tuple, x: str = "x", y: str = "y") -> DataFrame:
    """(key, manhattan): mean difference of the values as shares of their sums; values whose sum is 0 stay as they are."""
    w = Window.partitionBy(*key)
    share = lambda c: F.when(F.sum(c).over(w) != 0, F.col(c) / F.sum(c).over(w)).otherwise(F.col(c))
    return vectors.select(*key, share(x).alias("_x"), share(y).alias("_y")).groupBy(*key).agg(F.avg(F.abs(F.col("_x") - F.col("_y"))).alias("manhattan"))


def cross_correlation(vectors: DataFrame, key: tuple, order: str, most: int = 3, x: str = "x", y: str = "y") -> DataFrame:
    """(key, lag, correlation): of the delays from -most to most, that where standardised x and y correlate best (the first of equals).

    correlation at d: sum of x(i) y(i + d) over n. A key's rows are sorted once; no delay copies them."""
    all_, line = Window.partitionBy(*key), Window.partitionBy(*key).orderBy(order)
    unit = lambda c: (F.col(c) - F.avg(c).over(all_)) / F.when(F.stddev_pop(c).over(all_) > 0, F.stddev_pop(c).over(all_)).otherwise(1.0)
    v = vectors.select(*key, order, unit(x).alias("_x"), unit(y).alias("_y"))
    delays = list(range(-most, most + 1))
    v = v.select(*key, *[(F.col("_x") * F.coalesce(F.lead("_y", d).over(line) if d >= 0 else F.lag("_y", -d).over(line), F.lit(0.0))).alias(f"_p{i}") for i, d in enumerate(delays)])
    sums = v.groupBy(*key).agg(*[F.avg(f"_p{i}").alias(f"_p{i}") for i in range(len(delays))])
    best = F.array_max(F.array(*[F.struct(F.round(F.col(f"_p{i}"), 12).alias("c"), F.lit(-d).alias("d")) for i, d in enumerate(delays)]))
    return sums.select(*key, (-best["d"]).alias("lag"), best["c"].alias("correlation"))


def mutual_information(vectors: DataFrame, key: tuple, x: str = "x", y: str = "y") -> DataFrame:
    """(key, bits): mutual information of the two values' ranks, equal values sharing a rank.

    Equal values and equal ranks are the same states, so the values are counted and nothing is sorted."""
    joint = vectors.groupBy(*key, x, y).agg(F.count("*").alias("c"))
    entropy = lambda counts: counts.groupBy(*key).agg(F.sum("c").alias("n"), F.sum(F.col("c") * F.log("c")).alias("h"))
    a = entropy(joint.groupBy(*key, x).agg(F.sum("c").alias("c"))).select(*key, F.col("h").alias("ha"))
    b = entropy(joint.groupBy(*key, y).agg(F.sum("c").alias("c"))).select(*key, F.col("h").alias("hb"))
    out = entropy(joint).join(a, list(key)).join(b, list(key))
    return out.select(*key, (((F.col("h") - F.col("ha") - F.col("hb")) / F.col("n") + F.log("n")) / math.log(2)).alias("bits"))


def trace_correlation(points: DataFrame, pairs: DataFrame, trace: str = "target", at: tuple = ("run_id", "rt"), value: str = "intensity") -> DataFrame:
    """(a, b, at without its last, n, pearson) of the traces that `pairs` (a, b) names, over the points that both have."""
    side = lambda c: points.select(F.col(trace).alias(c), *at, F.col(value).cast("double").alias(f"_{c}"))
    both = pairs.join(side("a"), "a").join(side("b"), ["b", *at])
    return both.groupBy("a", "b", *at[:-1]).agg(F.count("*").alias("n"), F.corr("_a", "_b").alias("pearson"))


def assign_windows(points: DataFrame, windows: DataFrame, cell: float = 25.0) -> DataFrame:
    """points with the isolation window (window, low, high) whose lower bound is inside and upper bound is outside; the
    window whose centre is nearest where several overlap (ties: the smaller number). Points outside all windows are left out."""
    own = [c for c in points.columns]
    hit = range_join(points, windows.select(F.col("window"), F.col("low"), F.col("high")), "mz", "low", "high", cell).filter(F.col("mz") < F.col("high"))
    nearest = F.struct(F.abs(F.col("mz") - (F.col("low") + F.col("high")) / 2).alias("d"), "window", "low", "high")
    best = hit.groupBy(*own).agg(F.min(nearest).alias("_w"))
    return best.select(*own, F.col("_w.window").alias("window"), F.col("_w.low").alias("window_low"), F.col("_w.high").alias("window_high"))


def context_inference(scores: DataFrame, level: str, context: tuple = ()) -> DataFrame:
    """(context, level, score, decoy, p_value, q_value) of the best score of each level (peptide, protein or gene) in each context.

    context: () is global, ("run_id",) run-specific. p_value: share of the context's decoys that score as well (at least one over their
    number). q_value: (D + 1) / (T + 1) at the score, no larger than at any lower score; decoys have them too. Targets and
    decoys of one name are two levels. Counts are of distinct scores, so the running sums see those alone."""
    best = scores.groupBy(*context, level, "decoy").agg(F.max("score").alias("score"))
    each = best.groupBy(*context, "score").agg(F.sum((~F.col("decoy")).cast("long")).alias("t"), F.sum(F.col("decoy").cast("long")).alias("d"))
    curve = running_curve(each, list(context), ["t", "d"], lambda t, d: (d + 1) / (t + 1))
    total = each.groupBy(*context).agg(F.sum("d").alias("_n"))
    curve = curve.join(total, list(context)) if context else curve.withColumn("_one", F.lit(1)).join(total.withColumn("_one", F.lit(1)), "_one")
    curve = curve.select(*context, "score", F.when(F.col("_n") > 0, F.greatest(F.col("run_d"), F.lit(1)) / F.col("_n")).otherwise(1.0).alias("p_value"), "q_value")
    return best.join(curve, [*context, "score"]).select(*context, level, "score", "decoy", "p_value", "q_value")


def binned_coverage(points: DataFrame, at: str, low: float, high: float, bins: int, least: int, key: tuple = ()) -> DataFrame:
    """(key, filled, covered): number of equal bins of [low, high] with `least` points or more, and whether all have."""
    cell = F.least(F.floor((F.col(at) - low) / (high - low) * bins), F.lit(bins - 1))
    counts = points.filter(F.col(at).between(low, high)).groupBy(*key, cell.alias("_b")).agg(F.count("*").alias("_n"))
    return counts.groupBy(*key).agg(F.sum((F.col("_n") >= least).cast("long")).alias("filled")).withColumn("covered", F.col("filled") == bins)


def _chauvenet(residual: Column, mean: Column, deviation: Column, n: Column) -> Column:
    """True where fewer than half a row is expected as far out. erfc by a rational approximation (error below 1.2e-7)."""
    z = F.abs(residual - mean) / deviation / math.sqrt(2)
    t = 1 / (1 + z / 2)
    power = F.lit(0.17087277)
    for c in (-0.82215223, 1.48851587, -1.13520398, 0.27886807, -0.18628806, 0.09678418, 0.37409196, 1.00002368):
        power = power * t + c
    return F.when(deviation > 0, t * F.exp(-z * z - 1.26551223 + t * power) * n < 0.5).otherwise(False)


def chauvenet_outliers(pairs: DataFrame, x: str, y: str, key: tuple = ()) -> DataFrame:
    """pairs with residual (of the least-squares line of their key) and outlier, by Chauvenet's criterion on the residuals.

    A key's line and moments are one partial aggregation, the verdict a second one; no key meets in one task."""
    on = list(key)
    one = pairs if on else pairs.withColumn("_k", F.lit(0))
    on = on or ["_k"]
    line = one.groupBy(*on).agg(F.regr_slope(y, x).alias("_s"), F.regr_intercept(y, x).alias("_i"))
    r = one.join(line, on).withColumn("residual", F.col(y) - (F.col("_s") * F.col(x) + F.col("_i")))
    m = r.groupBy(*on).agg(F.avg("residual").alias("_m"), F.stddev_samp("residual").alias("_d"), F.count("residual").alias("_n"))
    out = r.join(m, on).withColumn("outlier", F.coalesce(_chauvenet(F.col("residual"), F.col("_m"), F.col("_d"), F.col("_n")), F.lit(False)))
    return out.drop("_s", "_i", "_m", "_d", "_n", "_k")


def remove_outliers(pairs: DataFrame, x: str, y: str, least_r2: float = 0.95, least_share: float = 0.6, key: tuple = ("run_id",)) -> DataFrame:
    """pairs without those that, one at a time, lie farthest from the line through the others, until r squared is reached.

    At most 1 - least_share of a key's pairs go; a key that misses least_r2 even so keeps what is left. Keys are runs with
    their retention-time standards, of which a library has dozens."""
    fields = pairs.columns

    def prune(f: pd.DataFrame) -> pd.DataFrame:
        f = f.sort_values([x, y], kind="stable")
        least = math.ceil(least_share * len(f))
        while len(f) > max(least, 2):
            a, b = f[x].astype(float), f[y].astype(float)
            va, vb = ((a - a.mean()) ** 2).sum(), ((b - b.mean()) ** 2).sum()
            cov = ((a - a.mean()) * (b - b.mean())).sum()
            if va == 0 or vb == 0 or cov * cov / (va * vb) >= least_r2:
                break
            slope = cov / va
            far = (b - b.mean() - slope * (a - a.mean())).abs()
            f = f.drop(index=far.idxmax())
        return f[fields]

    return pairs.groupBy(*key).applyInPandas(lambda f: prune(f.reset_index(drop=True)), pairs.schema)
