"""Peak filters. A spectrum is the rows of one key; each filter is one window over it, so filters on the same key share a shuffle."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

KEY = ("spectrum_id",)


def normalize(peaks: DataFrame, method: str = "to_one", key=KEY) -> DataFrame:
    """intensity over the spectrum's largest (to_one) or summed (to_tic) intensity; spectra where that is not positive stay."""
    f = {"to_one": F.max, "to_tic": F.sum}[method]
    by = f("intensity").over(Window.partitionBy(*key))
    return peaks.withColumn("intensity", F.when(by > 0, F.col("intensity") / by).otherwise(F.col("intensity")))


def threshold(peaks: DataFrame, least: float) -> DataFrame:
    """Peaks of at least this intensity; reaches the scan."""
    return peaks.filter(F.col("intensity") >= least)


def n_largest(peaks: DataFrame, n: int, key=KEY) -> DataFrame:
    """The n most intense peaks, of equal ones those first in order of peak_id."""
    order = Window.partitionBy(*key).orderBy(F.desc("intensity"), "peak_id")
    return peaks.withColumn("_r", F.row_number().over(order)).filter(F.col("_r") <= n).drop("_r")


def sqrt_scale(peaks: DataFrame) -> DataFrame:
    """Square roots of intensities; negative ones become 0."""
    return peaks.withColumn("intensity", F.sqrt(F.greatest("intensity", F.lit(0.0))))


def rank_scale(peaks: DataFrame, key=KEY) -> DataFrame:
    """Ranks instead of intensities: the number of peaks for the largest, one less for each distinct smaller value.

    A spectrum whose largest intensity is 0 starts one higher."""
    w = Window.partitionBy(*key)
    down = F.dense_rank().over(w.orderBy(F.desc("intensity")))
    zero = (F.max("intensity").over(w) == 0).cast("int")
    return peaks.withColumn("intensity", (F.count("*").over(w) + 1 - down + zero).cast("double"))


def window_mower(peaks: DataFrame, size: float = 50.0, n: int = 2, move: str = "slide", key=KEY) -> DataFrame:
    """Peaks among the n most intense of some window of this m/z size.

    slide: a window starts at each peak, all in the JVM; jump: at the first peak after the window before, the last with its share of n."""
    if move == "slide":
        one = F.expr(f"collect_list(struct(-intensity AS _i, mz, peak_id, _row)) OVER (PARTITION BY {', '.join(key)} ORDER BY mz RANGE BETWEEN CURRENT ROW AND {float(size)!r}D FOLLOWING)")
        w = peaks.withColumn("_row", F.struct(*[F.col(c) for c in peaks.columns if c not in ("mz", "peak_id", *key)])).withColumn("_w", one)
        inside = F.filter("_w", lambda x: (x["mz"] - F.col("mz") < size) & ((x["mz"] > F.col("mz")) | (x["peak_id"] >= F.col("peak_id"))))
        top = w.select(*key, F.explode(F.slice(F.array_sort(inside), 1, n)).alias("p")).select(*key, "p.mz", "p.peak_id", "p._row").dropDuplicates([*key, "peak_id"])
        return top.select(*[F.col(c) if c in ("mz", "peak_id", *key) else F.col(f"_row.{c}") for c in peaks.columns])
    import numpy as np
    import pandas as pd

    fields = list(peaks.columns)

    def mow(f: pd.DataFrame) -> pd.DataFrame:
        f = f.sort_values(["mz", "peak_id"], kind="stable")
        mz, high = f["mz"].to_numpy(), -f["intensity"].to_numpy()
        keep, start, count = np.zeros(len(f), bool), 0, len(f)
        ends = np.searchsorted(mz - mz[0], mz - mz[0] + size, "left")
        while start < count:
            end = max(start + 1, int(ends[start]))
            while end > start + 1 and mz[end - 1] - mz[start] >= size:
                end -= 1
            while end < count and mz[end] - mz[start] < size:
                end += 1
            m = int(np.floor((mz[end - 1] - mz[start]) / size * n + 0.5)) if end == count else n
            keep[start + np.argsort(high[start:end], kind="stable")[:m]] = True
            start = end
        return f[keep][fields]

    return peaks.groupBy(*key).applyInPandas(mow, peaks.schema)


def resample(peaks: DataFrame, spacing: float, key=KEY) -> DataFrame:
    """Intensity dealt linearly to the two neighbours on a grid from the spectrum's first m/z: (key, grid, mz, intensity).

    The last grid point may lie beyond the last peak. Grid points without a peak have intensity 0."""
    w = Window.partitionBy(*key)
    p = peaks.withColumn("_lo", F.min("mz").over(w)).withColumn("_hi", F.max("mz").over(w)).withColumn("_x", (F.col("mz") - F.col("_lo")) / spacing)
    i = F.floor("_x")
    parts = p.select(*key, F.inline(F.array(F.struct(i.alias("grid"), (F.col("intensity") * (1 - (F.col("_x") - i))).alias("v")), F.struct((i + 1).alias("grid"), (F.col("intensity") * (F.col("_x") - i)).alias("v")))))
    grid = peaks.groupBy(*key).agg(F.min("mz").alias("_lo"), F.max("mz").alias("_hi")).select(*key, "_lo", F.explode(F.sequence(F.lit(0).cast("long"), F.ceil((F.col("_hi") - F.col("_lo")) / spacing))).alias("grid"))
    found = parts.groupBy(*key, "grid").agg(F.sum("v").alias("v"))
    return grid.join(found, [*key, "grid"], "left").select(*key, "grid", (F.col("_lo") + F.col("grid") * spacing).alias("mz"), F.coalesce("v", F.lit(0.0)).alias("intensity"))


def _near(key, half: int):
    return Window.partitionBy(*key).orderBy("mz", "peak_id").rowsBetween(-half, half)


def savitzky_golay(peaks: DataFrame, key=KEY) -> DataFrame:
    """Quadratic smoothing over 5 neighbouring points; the ends stay. Negative results become 0."""
    o = Window.partitionBy(*key).orderBy("mz", "peak_id")
    at = lambda k: F.lag("intensity", -k).over(o)
    s = (at(-2) * -3 + at(-1) * 12 + at(0) * 17 + at(1) * 12 + at(2) * -3) / 35
    return peaks.withColumn("intensity", F.greatest(F.coalesce(s, F.col("intensity")), F.lit(0.0)))


def gaussian(peaks: DataFrame, width: float = 1.0, half: int = 4, key=KEY) -> DataFrame:
    """Mean of the 2 * half + 1 neighbours by Gaussian weights of their m/z distance (width: 8 standard deviations)."""
    near = F.collect_list(F.struct("mz", "intensity")).over(_near(key, half))
    p = peaks.withColumn("_n", near)
    w = lambda x: F.exp(-F.pow((x["mz"] - F.col("mz")) / (width / 8.0), 2) / 2)
    total = lambda f: F.aggregate(F.transform("_n", f), F.lit(0.0), lambda a, b: a + b)
    return p.withColumn("intensity", total(lambda x: w(x) * x["intensity"]) / total(w)).drop("_n")


def top_hat(peaks: DataFrame, half: int = 3, key=KEY) -> DataFrame:
    """Baseline correction: intensity less its opening (erosion, then dilation) over 2 * half + 1 points."""
    p = peaks.withColumn("_e", F.min("intensity").over(_near(key, half)))
    return p.withColumn("intensity", F.col("intensity") - F.max("_e").over(_near(key, half))).drop("_e")


def pick_peaks(peaks: DataFrame, key=KEY) -> DataFrame:
    """Local maxima with m/z and intensity of the parabola through them and their neighbours."""
    o = Window.partitionBy(*key).orderBy("mz", "peak_id")
    p = peaks.select("*", F.lag("mz").over(o).alias("x0"), F.lag("intensity").over(o).alias("y0"), F.lead("mz").over(o).alias("x2"), F.lead("intensity").over(o).alias("y2")).filter("intensity > y0 AND intensity >= y2 AND x0 < mz AND mz < x2")
    x0, x2 = F.col("x0") - F.col("mz"), F.col("x2") - F.col("mz")
    a = ((F.col("y2") - F.col("intensity")) / x2 - (F.col("y0") - F.col("intensity")) / x0) / (x2 - x0)
    b = (F.col("y0") - F.col("intensity")) / x0 - a * x0
    shift = F.when(a < 0, F.greatest(x0, F.least(x2, -b / (2 * a)))).otherwise(0.0)
    return p.select(*key, "peak_id", (F.col("mz") + shift).alias("mz"), (F.col("intensity") + b * shift + a * shift * shift).alias("intensity"))


def signal_to_noise(peaks: DataFrame, bin_size: float = 100.0, key=KEY) -> DataFrame:
    """Intensity over the median intensity of the peak's m/z bin."""
    cell = F.floor(F.col("mz") / bin_size)
    noise = peaks.groupBy(*key, cell.alias("_b")).agg(F.percentile("intensity", 0.5).alias("_noise"))
    return peaks.withColumn("_b", cell).join(noise, [*key, "_b"]).withColumn("sn", F.col("intensity") / F.greatest("_noise", F.lit(1.0))).drop("_b", "_noise")


def deisotope(peaks: DataFrame, tolerance: float = 0.01, spacing: float = 1.00335, key=KEY) -> DataFrame:
    """Peaks without an equally or more intense one at the isotope distance below (charge 1)."""
    cell = F.floor(F.col("mz") / spacing)
    below = peaks.select(*key, (F.col("mz") + spacing).alias("_mz"), F.col("intensity").alias("_i")).withColumn("_c", F.explode(F.array(*[F.floor(F.col("_mz") / spacing) + k for k in (-1, 0, 1)])))
    p = peaks.withColumn("_c", cell)
    return p.join(below, (F.abs(p["mz"] - below["_mz"]) <= tolerance) & (below["_i"] >= p["intensity"]) & (p["_c"] == below["_c"]) & F.lit(True) if not key else [*[p[k] == below[k] for k in key], p["_c"] == below["_c"], F.abs(p["mz"] - below["_mz"]) <= tolerance, below["_i"] >= p["intensity"]], "left_anti").drop("_c")
