"""Whole runs: ranges, parts, blocks, summaries, comparison, calibration, precursor correction, reporter ions, smoothing of anchors."""

from __future__ import annotations

import functools
import heapq
import operator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.scratch import written
from .joins import range_join
from .ranges import joined, percentiles

_COMPARE = {"=": operator.eq, "!=": operator.ne, "<": operator.lt, "<=": operator.le, ">": operator.gt, ">=": operator.ge}


def build_filter(conditions: list[tuple]) -> Column:
    """One predicate of (column, comparison, value) or (column, comparison, value, "AND" or "OR"), joined from left to right.

    The word of a condition joins it to all before it (the first one's counts nothing): no precedence. What Parquet can test reaches
    the scan. Without conditions everything passes."""
    out = None
    for c in conditions:
        one = _COMPARE[c[1]](F.col(c[0]), F.lit(c[2]))
        out = one if out is None else (out | one) if len(c) > 3 and c[3].upper() == "OR" else (out & one)
    return F.lit(True) if out is None else out


def extract_range(peaks: DataFrame, rt: tuple | None = None, mz: tuple | None = None, levels: tuple | None = None) -> DataFrame:
    """Peaks inside the closed ranges and of the levels given; all of it reaches the scan."""
    tests = [F.col(c).between(*r) for c, r in (("rt", rt), ("mz", mz)) if r is not None]
    if levels is not None:
        tests.append(F.col("ms_level").isin(*levels))
    return peaks.filter(functools.reduce(operator.and_, tests)) if tests else peaks


def normalize_map(peaks: DataFrame, level: int = 1) -> DataFrame:
    """Intensities of the level as percent of the run's largest one there; other levels stay, and so do runs without a positive one."""
    top = peaks.filter(F.col("ms_level") == level).groupBy("run_id").agg(F.max("intensity").alias("_top"))
    of = F.col("_top")
    return joined(peaks, top, ["run_id"], "left").withColumn("intensity", F.when((F.col("ms_level") == level) & (of > 0), F.col("intensity") / of * 100).otherwise(F.col("intensity"))).drop("_top")


def split_parts(peaks: DataFrame, parts: int) -> DataFrame:
    """(run_id, spectrum_id, part): spectra in order of time, dealt to parts of equal number, the first ones one larger."""
    s = peaks.select("run_id", "spectrum_id", "rt").distinct()
    return s.select("run_id", "spectrum_id", F.ntile(parts).over(Window.partitionBy("run_id").orderBy("rt", "spectrum_id")).alias("part"))


def run_info(peaks: DataFrame) -> DataFrame:
    """(run_id, ms_level, n_spectra, n_peaks, lowest, q1, median, q3, highest, mean): intensity figures of each run and level."""
    key, p = ["run_id", "ms_level"], F.col("p")
    sums = peaks.groupBy(*key).agg(F.countDistinct("spectrum_id").alias("n_spectra"), F.count("*").alias("n_peaks"), F.min("intensity").alias("lowest"), F.max("intensity").alias("highest"), F.avg("intensity").alias("mean"))
    return joined(sums, percentiles(peaks, key, "intensity", [0.25, 0.5, 0.75]), key, "left").select(*key, "n_spectra", "n_peaks", "lowest", p[0].alias("q1"), p[1].alias("median"), p[2].alias("q3"), "highest", "mean")


def fuzzy_diff(a: DataFrame, b: DataFrame, key: tuple, values: tuple, ratio: float = 1.0, difference: float = 0.0) -> DataFrame:
    """(key, column, a, b, kind) of what differs: missing (in b), extra (not in a), or a number off by more than both bounds.

    ratio: largest over smaller absolute value, for numbers of one sign; difference: absolute. Within either is equal; two nulls are equal."""
    own = lambda d, side: d.select(*key, *[F.col(v).cast("double").alias(f"{side}_{v}") for v in values], F.lit(1).alias(f"_{side}"))
    both = own(a, "a").join(own(b, "b"), list(key), "full")
    rows = both.select(*key, "_a", "_b", F.inline(F.array(*[F.struct(F.lit(v).alias("column"), F.col(f"a_{v}").alias("a"), F.col(f"b_{v}").alias("b")) for v in values])))
    x, y = F.col("a"), F.col("b")
    near = (F.abs(x - y) <= difference) | ((x * y > 0) & (F.greatest(F.abs(x), F.abs(y)) <= F.least(F.abs(x), F.abs(y)) * ratio))
    equal = F.coalesce(near, F.lit(False)) | x.eqNullSafe(y)
    kind = F.when(F.col("_b").isNull(), "missing").when(F.col("_a").isNull(), "extra").when(~equal, "differs")
    return rows.withColumn("kind", kind).filter("kind IS NOT NULL").select(*key, "column", "a", "b", "kind")


def merge_blocks(peaks: DataFrame, block: int, mz_width: float) -> DataFrame:
    """(run_id, ms_level, block, mz_cell, rt, intensity, n): each `block` spectra of a level in order of time, summed in m/z cells.

    rt is the mean time of the block's spectra."""
    s = peaks.select("run_id", "ms_level", "spectrum_id", "rt").distinct()
    at = F.row_number().over(Window.partitionBy("run_id", "ms_level").orderBy("rt", "spectrum_id")) - 1
    s = s.withColumn("block", F.floor(at / block))
    s = s.withColumn("_rt", F.avg("rt").over(Window.partitionBy("run_id", "ms_level", "block"))).select("run_id", "ms_level", "spectrum_id", "block", "_rt")
    p = peaks.join(s, ["run_id", "ms_level", "spectrum_id"])
    return p.groupBy("run_id", "ms_level", "block", F.floor(F.col("mz") / mz_width).alias("mz_cell")).agg(F.first("_rt").alias("rt"), F.sum("intensity").alias("intensity"), F.count("*").alias("n"))


def calibrate(peaks: DataFrame, locks: DataFrame, tolerance: float) -> DataFrame:
    """peaks with mz corrected by the mean relative error of their spectrum's lock masses (lock_mz); without a match, as they are.

    Each lock's most intense peak within tolerance (ties: lower m/z) counts."""
    near = range_join(peaks.select("spectrum_id", "mz", "intensity"), locks.select("lock_mz"), "mz", F.col("lock_mz") - tolerance, F.col("lock_mz") + tolerance, max(1.0, 2 * tolerance))
    best = near.groupBy("spectrum_id", "lock_mz").agg(F.max(F.struct("intensity", (-F.col("mz")).alias("m"))).alias("b"))
    error = best.groupBy("spectrum_id").agg(F.avg((-F.col("b.m") - F.col("lock_mz")) / F.col("lock_mz")).alias("_e"))
    return peaks.join(error, "spectrum_id", "left").withColumn("mz", F.col("mz") / (1 + F.coalesce("_e", F.lit(0.0)))).drop("_e")


def correct_precursors(precursors: DataFrame, peaks: DataFrame, tolerance: float, by: str = "nearest") -> DataFrame:
    """(precursor_id, corrected_mz): the survey peak within tolerance that is nearest (ties: lower m/z) or most intense; else the given m/z."""
    near = range_join(peaks.select("spectrum_id", "mz", "intensity"), precursors, "mz", F.col("precursor_mz") - tolerance, F.col("precursor_mz") + tolerance, max(1.0, 2 * tolerance), ("spectrum_id",))
    order = F.struct(F.abs(F.col("mz") - F.col("precursor_mz")).alias("d"), "mz") if by == "nearest" else F.struct((-F.col("intensity")).alias("d"), "mz")
    best = near.groupBy("precursor_id").agg(F.min(order).alias("b")).select("precursor_id", F.col("b.mz").alias("_mz"))
    return precursors.join(best, "precursor_id", "left").select("precursor_id", F.coalesce("_mz", "precursor_mz").alias("corrected_mz"))


def reporter_ions(peaks: DataFrame, channels: dict[str, float], tolerance: float, mixing: list[list[float]] | None = None) -> DataFrame:
    """(spectrum_id, channel, intensity): the most intense peak within tolerance of each channel's centre, 0 without one.

    mixing[i][j]: share of channel j's signal that is measured in channel i; its inverse is applied and negative results are 0.
    Channels are few, so they are columns of one aggregation; the inverse is a sum of columns in the JVM."""
    names = list(channels)
    inside = functools.reduce(operator.or_, [F.col("mz").between(c - tolerance, c + tolerance) for c in channels.values()])
    found = peaks.withColumn("_in", inside).groupBy("spectrum_id").agg(*[F.coalesce(F.max(F.when(F.col("_in") & F.col("mz").between(c - tolerance, c + tolerance), F.col("intensity"))), F.lit(0)).cast("double").alias(f"_{i}") for i, c in enumerate(channels.values())])
    values = [F.col(f"_{i}") for i in range(len(names))]
    if mixing is not None:
        inverse = np.linalg.inv(np.asarray(mixing, float))
        values = [F.greatest(F.lit(0.0), functools.reduce(operator.add, [v * F.lit(float(w)) for v, w in zip(values, row)])) for row in inverse]
    return found.select("spectrum_id", F.inline(F.array(*[F.struct(F.lit(n).alias("channel"), v.alias("intensity")) for n, v in zip(names, values)])))


def lowess(x: np.ndarray, y: np.ndarray, span: float = 2 / 3, rounds: int = 3) -> np.ndarray:
    """Robust local lines with tricube weights over the nearest `span` of the points, at each x."""
    n = len(x)
    k = min(n, max(2, int(span * n + 1e-10)))
    robust, out = np.ones(n), y.astype(float)
    order = np.argsort(x, kind="stable")
    xs = x[order]
    for _ in range(rounds + 1):
        ys, rs, fit = y[order], robust[order], np.empty(n)
        left = 0
        for i in range(n):
            while left + k < n and xs[left + k] - xs[i] < xs[i] - xs[left]:
                left += 1
            part = slice(left, left + k)
            d = np.abs(xs[part] - xs[i])
            w = np.clip(1 - (d / (d.max() * 1.0000001)) ** 3, 0, 1) ** 3 * rs[part] if d.max() > 0 else rs[part].copy()
            total = w.sum()
            if total <= 0:
                fit[i] = ys[i]
                continue
            mx, my = (w * xs[part]).sum() / total, (w * ys[part]).sum() / total
            var = (w * (xs[part] - mx) ** 2).sum()
            fit[i] = my + ((w * (xs[part] - mx) * (ys[part] - my)).sum() / var * (xs[i] - mx) if var > 1e-12 * (xs[-1] - xs[0] + 1e-300) ** 2 else 0.0)
        out[order] = fit
        r = np.abs(y - out)
        m = 6 * np.median(r)
        robust = np.clip(1 - (r / m) ** 2, 0, 1) ** 2 if m > 0 else np.ones(n)
    return out


def smooth_anchors(anchors: DataFrame, span: float = 2 / 3, key: tuple = ("map_id",)) -> DataFrame:
    """anchors (key, x, y) with y smoothed along x: one task per map, whose anchors are its identified features or standards.

    interpolate_times() then moves all points by them."""

    def run(f: pd.DataFrame) -> pd.DataFrame:
        return f.assign(y=lowess(f["x"].to_numpy(float), f["y"].to_numpy(float), span))

    a = anchors.select(*key, F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y"))
    return a.groupBy(*key).applyInPandas(run, a.schema)


#: Of group_features: a block's width in tolerances in the first round, and rounds before the last one, which has no blocks.
_GROUP_BLOCK, _GROUP_ROUNDS = 64, 5


def group_features(features: DataFrame, mz_tolerance: float, rt_tolerance: float) -> DataFrame:
    """(group, map_id, feature_id, quality): quality-threshold groups with at most one feature of each map and charge.

    Centres compete: a group is a centre with the nearest feature of each other map within tolerance; the best one (many maps, small
    distances) is taken, its features go, and so on; ties by id. quality: sum of 1 - distance over the number of other maps.

    Blocks of m/z are worked through with some of what is around them. What is beyond isn't known, so features near the edge are unsure,
    and so is all that a centre may take that has to do with unsure ones; other groups are final. The features that are left meet
    in another round, in larger blocks that begin elsewhere, and at the end in one. Neighbours are looked up when they are needed."""
    maps = features.select("map_id").distinct().count()
    reach = mz_tolerance * (1 + 1e-9)

    def run(f: pd.DataFrame) -> pd.DataFrame:
        f = f.sort_values(["feature_id", "map_id"], kind="stable").reset_index(drop=True)
        mz, rt, map_, own = f["mz"].to_numpy(float), f["rt"].to_numpy(float), f["map_id"].to_numpy(), f["_own"].to_numpy(bool)
        order = np.argsort(mz, kind="stable")
        by_mz = mz[order]
        low, high = np.searchsorted(by_mz, mz - mz_tolerance, "left"), np.searchsorted(by_mz, mz + mz_tolerance, "right")
        free, unsure = np.ones(len(f), bool), np.zeros(len(f), bool)

        def around(i: int) -> tuple[np.ndarray, np.ndarray]:
            c = order[low[i] : high[i]]
            c = c[free[c] & (np.abs(rt[c] - rt[i]) <= rt_tolerance) & (map_[c] != map_[i])]
            return c, (np.abs(mz[c] - mz[i]) / mz_tolerance + np.abs(rt[c] - rt[i]) / rt_tolerance) / 2

        def cluster(i: int) -> tuple[float, list[int]]:
            c, d = around(i)
            best: dict = {}
            for k in np.lexsort((c, d)).tolist():
                j = int(c[k])
                if map_[j] not in best:
                    best[map_[j]] = (float(d[k]), j)
                    if len(best) == maps - 1:
                        break
            quality = sum(1 - d for d, _ in best.values()) / (maps - 1) if maps > 1 else 0.0
            return quality, [i, *(j for _, j in best.values())]

        def doubt(i: int) -> None:
            unsure[i] = unsure[around(i)[0]] = True

        edge = (mz < f["_from"].to_numpy(float) + reach) | (mz > f["_to"].to_numpy(float) - reach)
        for i in np.flatnonzero(edge):
            doubt(i)
        heap = [(-cluster(i)[0], i) for i in np.flatnonzero(~edge).tolist()]
        heapq.heapify(heap)
        group, quality_of = np.full(len(f), -1), np.zeros(len(f))
        while heap:
            q, i = heapq.heappop(heap)
            if not free[i]:
                continue
            quality, members = cluster(i)
            if quality < -q - 1e-15:  # some of its features are gone by now
                heapq.heappush(heap, (-quality, i))
            elif unsure[members].any():  # it comes now, later or never, with any of what is around it
                doubt(i)
            else:
                free[members] = False
                group[members], quality_of[members] = i, quality
        # a group is told by the block that owns its centre; its features in other blocks are left there, and go when it is told
        group[(group >= 0) & ~own[group]] = -1
        told = own | (group >= 0)
        name = pd.array(f["feature_id"].to_numpy()[group], dtype="Int64")
        name[group < 0] = pd.NA
        return f.assign(group=name, quality=quality_of)[told][["charge", "map_id", "feature_id", "mz", "rt", "group", "quality", "_own"]]

    long = lambda c: F.col(c).cast("long").alias(c)
    left, done, n = features.select(long("map_id"), long("feature_id"), long("charge"), "mz", "rt"), [], 0
    while n == 0 or not left.isEmpty():
        width = mz_tolerance * _GROUP_BLOCK * 8**n
        halo, at = width / 8, F.floor(F.col("mz") / width + n / 2)
        start = (F.col("_block") - n / 2) * width
        edges = [(start - halo).alias("_from"), (start + width + halo).alias("_to")]
        if n == _GROUP_ROUNDS:
            at, edges = F.lit(0), [F.lit(float("-inf")).alias("_from"), F.lit(float("inf")).alias("_to")]
        placed = left.withColumn("_at", at)
        near = F.array(*[F.floor((F.col("mz") + k * halo) / width + n / 2) for k in (-1, 0, 1)]) if n < _GROUP_ROUNDS else F.array("_at")
        placed = placed.withColumn("_block", F.explode_outer(F.filter(F.array_distinct(near), lambda x: x.isNotNull()))).select("*", *edges)
        placed = placed.withColumn("_own", F.coalesce(F.col("_at") == F.col("_block"), F.lit(True))).drop("_at")
        out = written(placed.groupBy("charge", "_block").applyInPandas(run, "charge long, map_id long, feature_id long, mz double, rt double, group long, quality double, _own boolean"), "groups")
        done.append(out.filter(F.col("group").isNotNull()))
        # features that another block's group has taken
        gone = done[-1].filter(~F.col("_own")).select(F.struct("charge", "map_id", "feature_id").alias("_key"))
        left = out.filter(F.col("group").isNull()).withColumn("_key", F.struct("charge", "map_id", "feature_id")).join(gone, "_key", "left_anti").select("map_id", "feature_id", "charge", "mz", "rt")
        n += 1
    return functools.reduce(DataFrame.unionByName, done).select("group", "map_id", "feature_id", "quality")
