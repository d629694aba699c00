"""Range and nearest joins by grid cells, and what is made of them: region sums, chromatograms, feature pairs, purity.

A range join is an equi-join on cells of the coordinate, so Spark shuffles or broadcasts it like any other; the exact condition follows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .ranges import in_ranges, running


def range_join(points: DataFrame, spans: DataFrame, at: str, low: str | Column, high: str | Column, cell: float, on: tuple = ()) -> DataFrame:
    """points with the spans (inclusive) that hold them. cell: about the usual length of a span."""
    low, high = (F.col(x) if isinstance(x, str) else x for x in (low, high))
    s = spans.withColumn("_low", low).withColumn("_high", high).filter("_low <= _high")
    s = s.withColumn("_cell", F.explode(F.sequence(F.floor(F.col("_low") / cell), F.floor(F.col("_high") / cell))))
    p = points.withColumn("_cell", F.floor(F.col(at) / cell))
    return p.join(s, ["_cell", *on]).filter((F.col(at) >= F.col("_low")) & (F.col(at) <= F.col("_high"))).drop("_cell", "_low", "_high")


def aggregate_regions(peaks: DataFrame, regions: DataFrame, cell: float = 50.0) -> DataFrame:
    """Sum, maximum, minimum, mean and number of intensities in each (m/z, RT) region; empty regions have null and 0."""
    found = range_join(peaks.select("mz", "rt", "intensity"), regions, "mz", "mz_low", "mz_high", cell).filter("rt BETWEEN rt_low AND rt_high")
    sums = found.groupBy("region").agg(F.sum("intensity").alias("total"), F.max("intensity").alias("highest"), F.min("intensity").alias("lowest"), F.avg("intensity").alias("mean"), F.count("*").alias("n"))
    return regions.select("region").join(sums, "region", "left").fillna(0, ["n"])


def extract_chromatograms(peaks: DataFrame, targets: DataFrame, ppm: float = 1000.0, cell: float = 5.0) -> DataFrame:
    """(target, run_id, rt, intensity, n): summed intensity within the tolerance of each target's m/z in each spectrum.

    Targets of one m/z have one chromatogram, which is summed once; targets that are named with several m/z are summed over these."""
    width = F.col("target_mz") * (ppm * 1e-6)
    found = range_join(peaks.select("run_id", "rt", "mz", "intensity"), targets.select("target_mz").distinct(), "mz", F.col("target_mz") - width, F.col("target_mz") + width, cell)
    sums = found.groupBy("target_mz", "run_id", "rt").agg(F.sum("intensity").alias("intensity"), F.count("*").alias("n"))
    named = targets.select("target", "target_mz", F.count("*").over(Window.partitionBy("target")).alias("_k"))
    one, more = (sums.join(named.filter(f), "target_mz").select("target", "run_id", "rt", "intensity", "n") for f in ("_k = 1", "_k > 1"))
    return one.unionByName(more.groupBy("target", "run_id", "rt").agg(F.sum("intensity").alias("intensity"), F.sum("n").alias("n")))


def nearest_in_boxes(a: DataFrame, b: DataFrame, mz_tolerance: float, rt_tolerance: float, how: str, on: tuple = (), both: bool = True, most: int = 1 << 20) -> DataFrame:
    """(a_id, b_id, of_b, d, d2): for each row of a (id, mz, rt, on) the nearest of b within both tolerances; with `both` also for each of b that of a (of_b).

    how: square (sum of squared shares of the tolerances), mean (of the shares) or mz (m/z, then RT); ties by id. d2: the
    second-nearest one's d. Rows are shuffled once to blocks of m/z and RT, and to those within reach; pairs are made there, at most
    about `most` at a time, and never leave the task."""
    w, h = 8 * mz_tolerance, 4 * rt_tolerance
    reach = lambda c, tol, size: F.sequence(F.floor((F.col(c) - tol * (1 + 1e-9)) / size), F.floor((F.col(c) + tol * (1 + 1e-9)) / size))

    def placed(df, side, around):
        p = df.select("id", F.col("mz").cast("double").alias("mz"), F.col("rt").cast("double").alias("rt"), *on, F.lit(side).alias("side")).dropna()
        i, j = F.floor(F.col("mz") / w), F.floor(F.col("rt") / h)
        p = p.withColumn("_i", F.explode(reach("mz", mz_tolerance, w) if around else F.array(i))).withColumn("_j", F.explode(reach("rt", rt_tolerance, h) if around else F.array(j)))
        return p.withColumn("_own", (i == F.col("_i")) & (j == F.col("_j")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f = pa.Table.from_batches(batches).to_pandas().sort_values("mz", kind="stable")
        sides = [f[f["side"] == k] for k in (0, 1)]
        for k in (0, 1) if both else (0,):
            x, y = sides[k][sides[k]["_own"]], sides[1 - k]
            (xi, xm, xr), (yi, ym, yr) = (tuple(d[c].to_numpy() for c in ("id", "mz", "rt")) for d in (x, y))
            low = np.searchsorted(ym, xm - mz_tolerance * (1 + 1e-9), "left")
            n = np.searchsorted(ym, xm + mz_tolerance * (1 + 1e-9), "right") - low
            xi, xm, xr, low, n = (v[n > 0] for v in (xi, xm, xr, low, n))
            upto, at = np.cumsum(n), 0
            while at < len(n):
                to = max(at + 1, int(np.searchsorted(upto, (upto[at - 1] if at else 0) + most, "right")))
                m = n[at:to]
                start = np.cumsum(m) - m
                i = np.repeat(np.arange(at, to), m)
                j = np.repeat(low[at:to] - start, m) + np.arange(m.sum())
                mz, other = (xm[i], ym[j]) if k == 0 else (ym[j], xm[i])  # those of a and of b
                dm, dr = np.abs(mz - other), np.abs(xr[i] - yr[j])
                ok = (mz >= other - mz_tolerance) & (mz <= other + mz_tolerance) & (dr <= rt_tolerance)
                u, v = dm / mz_tolerance, dr / rt_tolerance
                keys = {"square": [u * u + v * v], "mean": [(u + v) / 2], "mz": [dm, dr]}[how]
                best, inside = [], ok
                for key in keys:
                    best.append(np.minimum.reduceat(np.where(inside, key, np.inf), start))
                    inside = inside & (key == np.repeat(best[-1], m))
                name = np.minimum.reduceat(np.where(inside, yi[j], np.iinfo(np.int64).max), start)
                rest = ok & (yi[j] != np.repeat(name, m))
                second = np.minimum.reduceat(np.where(rest, keys[0], np.inf), start)
                has = np.isfinite(best[0])
                own, name, second = xi[at:to][has], name[has], second[has]
                at = to
                yield pa.RecordBatch.from_arrays([*((own, name) if k == 0 else (name, own)), np.full(len(own), k == 1), best[0][has], pa.array(second, mask=~np.isfinite(second))], names=["a_id", "b_id", "of_b", "d", "d2"])

    rows = placed(a, 0, both).unionByName(placed(b, 1, True))
    return rows.groupBy("_i", "_j", *on).applyInArrow(run, "a_id long, b_id long, of_b boolean, d double, d2 double")


def mutual(found: DataFrame) -> DataFrame:
    """(a_id, b_id, d, d2_a, d2_b) of nearest_in_boxes' pairs that are each other's nearest."""
    second = lambda of_b: F.max(F.when(F.col("of_b") == of_b, F.col("d2")))
    one = found.groupBy("a_id", "b_id").agg(F.count_if(F.col("of_b")).alias("_b"), F.count_if(~F.col("of_b")).alias("_a"), F.min("d").alias("d"), second(False).alias("d2_a"), second(True).alias("d2_b"))
    return one.filter("_a > 0 AND _b > 0").drop("_a", "_b")


def link_features(a: DataFrame, b: DataFrame, mz_tolerance: float, rt_tolerance: float) -> DataFrame:
    """Pairs that are each other's nearest (by scaled squared distance, ties by id) among those of equal charge within tolerance."""
    one = lambda df: df.select(F.col("feature_id").cast("long").alias("id"), "mz", "rt", "charge")
    return mutual(nearest_in_boxes(one(a), one(b), mz_tolerance, rt_tolerance, "square", ("charge",))).select("a_id", "b_id", "d")


def nearest_before(left: DataFrame, right: DataFrame, on: str, at: str, value: str) -> DataFrame:
    """left with the value of the last right row of the same key not after it (an as-of join): one union, running over ranges of `at`."""
    both = left.withColumn("_v", F.lit(None).cast(right.schema[value].dataType)).withColumn("_l", F.lit(1)).unionByName(right.select(on, at, F.col(value).alias("_v")).withColumn("_l", F.lit(0)), allowMissingColumns=True)
    out = running(in_ranges(both, [on], at), [at, "_l"], {value + "_before": ("_v", "last")})
    return out.filter("_l = 1").drop("_v", "_l", "_pool", "_range")


def precursor_purity(peaks: DataFrame, precursors: DataFrame, tolerance: float, window: float) -> DataFrame:
    """Share of the isolation window's intensity that lies within tolerance of the precursor, in the survey spectrum it names."""
    half = window / 2
    inside = range_join(peaks.select("spectrum_id", "mz", "intensity"), precursors, "mz", F.col("precursor_mz") - half, F.col("precursor_mz") + half, window, ("spectrum_id",))
    own = F.abs(F.col("mz") - F.col("precursor_mz")) <= tolerance
    sums = inside.groupBy("precursor_id").agg(F.sum("intensity").alias("total"), F.sum(F.when(own, F.col("intensity")).otherwise(0.0)).alias("target"), F.count("*").alias("n_peaks"))
    return sums.withColumn("purity", F.when(F.col("total") > 0, F.col("target") / F.col("total")).otherwise(0.0))


def linear_alignment(pairs: DataFrame, x: str, y: str) -> DataFrame:
    """(slope, intercept, n) of y over x by least squares: one partial aggregation."""
    return pairs.agg(F.regr_slope(y, x).alias("slope"), F.regr_intercept(y, x).alias("intercept"), F.count("*").alias("n"))


def normalize_median(features: DataFrame) -> DataFrame:
    """Maps scaled so that each has the median intensity of map 0."""
    med = features.groupBy("map_id").agg(F.percentile("intensity", 0.5).alias("m"))
    ref = F.max(F.when(F.col("map_id") == 0, F.col("m"))).over(Window.partitionBy(F.lit(0)))  # one row for each map
    scale = med.select("map_id", (ref / F.col("m")).alias("s"))
    return features.join(scale, "map_id").withColumn("intensity", F.col("intensity") * F.col("s")).drop("s")


def binned_cosine(peaks: DataFrame, pairs: DataFrame, bin_size: float = 10.0) -> DataFrame:
    """Cosine of the binned intensities of the spectra (a, b) of each pair."""
    v = peaks.groupBy("spectrum_id", F.floor(F.col("mz") / bin_size).alias("b")).agg(F.sum("intensity").alias("x"))
    norm = v.groupBy("spectrum_id").agg(F.sqrt(F.sum(F.col("x") * F.col("x"))).alias("n"))
    one = lambda c: (v.toDF(c, "bin", f"x_{c}"), norm.toDF(c, f"n_{c}"))
    (va, na), (vb, nb) = one("a"), one("b")
    dots = pairs.join(va, "a").join(vb, ["b", "bin"]).groupBy("a", "b").agg(F.sum(F.col("x_a") * F.col("x_b")).alias("dot"))
    return pairs.join(dots, ["a", "b"], "left").join(na, "a").join(nb, "b").select("a", "b", (F.coalesce("dot", F.lit(0.0)) / (F.col("n_a") * F.col("n_b"))).alias("cosine"))
