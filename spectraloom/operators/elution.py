"""Elution peaks of mass traces: smoothing, extrema, splitting at minima, widths at half height, filters by width."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .ranges import percentiles
from .runs import lowess


def extrema(y: np.ndarray, reach: int) -> tuple[list[int], list[int]]:
    """(maxima, minima): places with the largest value within `reach` on both sides (the first of equal ones), and the least place between neighbouring maxima."""
    n, tops = len(y), []
    for i in np.argsort(-y, kind="stable").tolist():
        if all(abs(i - t) > reach for t in tops) and y[i] >= y[max(0, i - reach) : i + reach + 1].max() and y[i] > 0:
            tops.append(i)
    tops.sort()
    return tops, [a + int(np.argmin(y[a : b + 1])) for a, b in zip(tops, tops[1:])] if n else []


def half_width(x: np.ndarray, y: np.ndarray, top: int) -> float:
    """Width at half of the height of `top`, between the points left and right by proportion; up to the ends where it stays above."""
    half, at = y[top] / 2, []
    for side in (-1, 1):
        k = top
        while 0 <= k + side < len(y) and y[k + side] > half:
            k += side
        j = k + side
        if not 0 <= j < len(y):
            at.append(x[k])
        else:
            at.append(x[k] + (x[j] - x[k]) * (y[k] - half) / (y[k] - y[j]) if y[k] != y[j] else x[k])
    return float(at[1] - at[0])


def elution_peaks(points: DataFrame, key: tuple, width: float = 5.0, span: float | None = None, least: int = 3, most: int = 200_000) -> DataFrame:
    """points (key, rt, mz, intensity) of traces -> (key, part, n, mz, rt, rt_low, rt_high, height, area, width): peaks of each trace.

    A trace is smoothed by LOWESS over about `width` (or a share `span` of its points), cut at the minima between maxima that are more
    than half of that apart, and each part with `least` points is a peak: mz weighted by intensity, rt and height of its smoothed apex, width at half height, area by
    trapezoids. A trace is one task's work, `most` points at most."""

    def run(f: pd.DataFrame) -> pd.DataFrame:
        if len(f) > most:
            raise ValueError(f"{len(f)} points of one trace; at most {most}")
        f = f.sort_values("rt", kind="stable")
        x, y, mz = (f[c].to_numpy(float) for c in ("rt", "intensity", "mz"))
        rows = []
        step = np.median(np.diff(x)) if len(x) > 1 else 1.0
        reach = max(1, int(width / max(step, 1e-9) / 2))
        smooth = np.maximum(lowess(x, y, span or min(1.0, max((2 * reach + 1) / len(x), 3 / len(x))), 0), 0) if len(x) > 3 else y
        tops, lows = extrema(smooth, reach)
        for k, (a, b) in enumerate(zip([0, *lows], [*(v + 1 for v in lows), len(x)])):
            if b - a < least or not tops:
                continue
            top = int(np.argmax(smooth[a:b]))
            w = np.maximum(y[a:b], 0)
            rows.append((*(f[c].iloc[0] for c in key), k, b - a, float((mz[a:b] * w).sum() / w.sum()) if w.sum() > 0 else float(mz[a:b].mean()), float(x[a + top]), float(x[a]), float(x[b - 1]), float(smooth[a + top]), float(np.trapezoid(y[a:b], x[a:b])), half_width(x[a:b], smooth[a:b], top)))
        return pd.DataFrame(rows, columns=[*key, "part", "n", "mz", "rt", "rt_low", "rt_high", "height", "area", "width"])

    src = points.select(*key, *[F.col(c).cast("double").alias(c) for c in ("rt", "mz", "intensity")])
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in src.schema[: len(key)]), "part long, n long, mz double, rt double, rt_low double, rt_high double, height double, area double, width double"])
    return src.groupBy(*key).applyInPandas(run, schema)


def filter_widths(peaks: DataFrame, pool: tuple, low: float | None = None, high: float | None = None) -> DataFrame:
    """Peaks whose width lies in [low, high]; a bound that isn't given is the pool's 5 % or 95 % percentile (exact, of any number of peaks)."""
    p = percentiles(peaks, pool, "width", [0.05, 0.95]).select(F.struct(*pool).alias("_at"), F.col("p")[0].alias("_low"), F.col("p")[1].alias("_high"))
    out = peaks.withColumn("_at", F.struct(*pool)).join(p, "_at")
    between = F.col("width").between(F.col("_low") if low is None else F.lit(low), F.col("_high") if high is None else F.lit(high))
    return out.filter(between).drop("_at", "_low", "_high")
