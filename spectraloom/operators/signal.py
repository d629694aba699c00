"""Signal processing that looks at a whole spectrum at once: numpy per group, one Arrow batch of one spectrum.

Groups are spectra or chromatograms, whose size an instrument bounds.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .filters import KEY
from .ranges import in_ranges, running

#: Pairs of points or traces that are held at a time, about.
_MOST = 1 << 19


def _each(peaks: DataFrame, f, key, order=("mz", "peak_id")) -> DataFrame:
    def run(d: pd.DataFrame) -> pd.DataFrame:
        d = d.sort_values(list(order), kind="stable")
        return d.assign(intensity=f(d[order[0]].to_numpy(float), d["intensity"].to_numpy(float)))

    return peaks.groupBy(*key).applyInPandas(run, peaks.schema)


def savitzky_golay_weights(frame: int, degree: int) -> np.ndarray:
    """Row i: weights of a full frame's points for the least-squares polynomial's value at point i."""
    frame += 1 - frame % 2
    if not 0 <= degree < frame:
        raise ValueError("the degree must be below the frame's length")
    x = np.linspace(-1, 1, frame) if frame > 1 else np.zeros(1)
    q, _ = np.linalg.qr(np.vander(x, degree + 1, increasing=True))
    return q @ q.T


def savitzky_golay(peaks: DataFrame, frame: int = 11, degree: int = 4, key=KEY) -> DataFrame:
    """Least-squares polynomials over sample indices; the ends take their values from the first and last full frame.

    Negative values become 0; signals shorter than the frame stay. A spectrum is an array in the JVM, as an instrument bounds it."""
    w = savitzky_golay_weights(frame, degree)
    n = len(w)
    rest = [c for c in peaks.columns if c not in ("mz", "peak_id", "intensity", *key)]
    g = peaks.groupBy(*key).agg(F.sort_array(F.collect_list(F.struct("mz", "peak_id", "intensity", *rest))).alias("_p"))
    g = g.select(*key, "_p", F.transform("_p", lambda x: x["intensity"].cast("double")).alias("_y"), F.array(*[F.array(*[F.lit(float(v)) for v in row]) for row in w]).alias("_w"))
    size = F.size("_p")

    def smooth(i):
        first = F.greatest(F.least(i - n // 2, size - n), F.lit(0))  # the frame that a point takes its value from
        dot = F.aggregate(F.zip_with(F.slice("_y", first + 1, n), F.element_at("_w", i - first + 1), lambda a, b: a * b), F.lit(0.0), lambda a, x: a + x)
        return F.when(size < n, F.element_at("_y", i + 1)).otherwise(F.greatest(dot, F.lit(0.0)))

    out = g.select(*key, F.inline(F.transform("_p", lambda x, i: F.struct(x.alias("x"), smooth(i).alias("y")))))
    return out.select(*[F.col(c) if c in key else F.col("y").alias("intensity") if c == "intensity" else F.col(f"x.{c}") for c in peaks.columns])


def gaussian_integral(peaks: DataFrame, width: float = 0.2, key=KEY) -> DataFrame:
    """Convolution by the trapezoidal rule over the actual distances; width is 8 standard deviations, cut at 4 on each side.

    A signal that comes out as all zero stays as it was if it has 3 points or more."""
    sigma = width / 8

    def smooth(x, y):
        out = np.zeros(len(y))
        lo, hi = np.searchsorted(x, x - 4 * sigma, "right"), np.searchsorted(x, x + 4 * sigma, "left")
        # points strictly inside of 4 standard deviations, some windows at a time: a bounded number of pairs
        first = np.maximum(lo - 1, 0)
        first = np.where(x[first] > x - 4 * sigma, first, lo) if len(x) else lo
        n = np.where(hi - first >= 2, hi - first - 1, 0)  # steps between neighbours
        upto, at = np.cumsum(n), 0
        while at < len(y):
            to = max(at + 1, int(np.searchsorted(upto, (upto[at - 1] if at else 0) + _MOST, "right")))
            k = n[at:to]
            own, at = np.flatnonzero(k) + at, to
            k = k[k > 0]
            if not len(k):
                continue
            start = np.cumsum(k) - k
            i, j = np.repeat(own, k), np.repeat(first[own] - start, k) + np.arange(k.sum())
            g, h = (np.exp(-((x[s] - x[i]) ** 2) / (2 * sigma * sigma)) for s in (j, j + 1))
            d = x[j + 1] - x[j]
            area, total = np.add.reduceat(d * (h + g), start), np.add.reduceat(d * (h * y[j + 1] + g * y[j]), start)
            ok = (area > 0) & (total > 0)
            out[own[ok]] = total[ok] / area[ok]
        return y if len(y) >= 3 and not out.any() else out

    return _each(peaks, smooth, key)


def morphology(peaks: DataFrame, method: str = "tophat", half: int = 3, key=KEY) -> DataFrame:
    """Flat structuring element of 2 * half + 1 points, clipped at the ends: as windows, without leaving the JVM.

    identity, erosion, dilation, opening, closing, gradient (dilation less erosion), tophat (input less opening) and bothat
    (input less closing)."""
    w = Window.partitionBy(*key).orderBy("mz", "peak_id").rowsBetween(-half, half)
    y, low, high = F.col("intensity"), F.min("intensity").over(w), F.max("intensity").over(w)
    if method == "identity":
        return peaks
    if method in ("erosion", "dilation", "gradient"):
        return peaks.withColumn("intensity", {"erosion": low, "dilation": high, "gradient": high - low}[method])
    first, then = (low, F.max) if method in ("opening", "tophat") else (high, F.min) if method in ("closing", "bothat") else (None, None)
    if first is None:
        raise ValueError(f"unknown method: {method}")
    p = peaks.withColumn("_f", first)
    out = then("_f").over(w)
    return p.withColumn("intensity", out if method in ("opening", "closing") else y - out).drop("_f")


def _spread(df: DataFrame, *by) -> DataFrame:
    """df by `by` over as many tasks as shuffles have: merged ones would sort as many rows as fit 64 MB of compressed ones."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *by)


def _bands(peaks: DataFrame, ppm: float, key) -> DataFrame:
    """peaks with band: a number that rises where sorted m/z (nulls last) leave a gap above the tolerance.

    No gap is within cells narrower than the tolerance, so bands follow from the lowest and highest m/z of each cell, of which a run has
    as many as its m/z range allows, however many peaks. Other peaks (m/z not above zero, infinite, NaN or null) are cells of their own, as
    are all where the tolerance is too small for logarithms."""
    mz, own = F.col("mz"), ["spectrum_id", "peak_id", "mz"]
    plain = (mz > 0) & (mz < float("inf")) & F.lit(ppm >= 1e-3)
    p = peaks.withColumns({"_cell": F.when(plain, F.floor(F.log(mz) / (0.9 * max(ppm, 1e-3) / 1e6))).otherwise(F.xxhash64(*own)), "_odd": F.when(plain, F.lit(0)).otherwise(F.hash(*own))})
    c = p.groupBy(*key, "_cell", "_odd").agg(F.min("mz").alias("_low"), F.max("mz").alias("_high"), F.min("peak_id").alias("_id"))
    o = ["_at", "_id"]
    c = running(in_ranges(c.withColumn("_at", F.coalesce("_low", F.lit(float("nan")))), key, "_at"), o, {"_last": ("_high", "last")}, inclusive=False)
    c = c.withColumn("_cut", F.coalesce((F.col("_low") - F.col("_last") > F.col("_low") * (ppm / 1e6)).cast("int"), F.lit(0)))
    c = running(c, o, {"band": ("_cut", "sum")})
    return _spread(p, *key, "_cell", "_odd").join(c.select(*key, "_cell", "_odd", "band"), [*key, "_cell", "_odd"]).drop("_cell", "_odd")


def mass_traces(peaks: DataFrame, ppm: float = 20.0, gaps: int = 1, shortest: int = 3, key=("run_id",)) -> DataFrame:
    """(key, trace, n, mz, rt_low, rt_high, apex, intensity): peaks of neighbouring m/z in consecutive spectra.

    A run's peaks are first cut where sorted m/z leave a gap above the tolerance, so groups are narrow bands, not runs;
    a trace ends after more than `gaps` spectra without a peak. Each spectrum adds its most intense peak of the band."""
    scans = peaks.select(*key, "spectrum_id", "rt").distinct().withColumn("scan", F.row_number().over(Window.partitionBy(*key).orderBy("rt", "spectrum_id")))
    band = _spread(_bands(peaks.select(*key, "spectrum_id", "rt", "peak_id", "mz", "intensity"), ppm, key), *key, "spectrum_id")
    top = band.withColumn("_r", F.row_number().over(Window.partitionBy(*key, "spectrum_id", "band").orderBy(F.desc("intensity"), "peak_id"))).filter("_r = 1").join(scans.drop("rt"), [*key, "spectrum_id"])
    top = _spread(top.select(*key, "band", "scan", "rt", "mz", "intensity"), *key, "band")
    line = Window.partitionBy(*key, "band").orderBy("scan")
    top = top.withColumn("_new", (F.col("scan") - F.lag("scan").over(line) > gaps + 1).cast("int")).withColumn("part", F.sum(F.coalesce("_new", F.lit(0))).over(line))
    found = top.groupBy(*key, "band", "part").agg(F.count("*").alias("n"), F.coalesce(F.try_divide(F.sum(F.col("mz") * F.col("intensity")), F.sum("intensity")), F.avg("mz")).alias("mz"), F.min("rt").alias("rt_low"), F.max("rt").alias("rt_high"), F.max_by("rt", F.struct("intensity", -F.col("rt"))).alias("apex"), F.sum("intensity").alias("intensity"))
    return found.filter(F.col("n") >= shortest)


def _isotope_pairs(d: pd.DataFrame, charges: tuple, tolerance: float, width: float, pad: float, key, most: int = _MOST) -> pd.DataFrame:
    """Pairs of a block's monoisotopes and isotopes, tried `most` at a time or as many as a monoisotope has."""
    mono, start = d["_mono"].to_numpy(bool), d["_block"].iloc[0] * width
    m, iso = ({c: d[c].to_numpy()[k] for c in ("mz", "apex", "rt_low", "rt_high")} for k in (mono, ~mono))
    times = np.unique(iso["apex"])
    cell = lambda x: np.floor((x - start) / pad).astype(np.int64) * (len(times) + 1)
    # a cell's isotopes lie together, ordered by apex
    place = cell(iso["mz"]) + np.searchsorted(times, iso["apex"])
    order = np.argsort(place, kind="stable")
    place, iso = place[order], {c: v[order] for c, v in iso.items()}
    low, high = np.searchsorted(times, m["rt_low"], "left"), np.searchsorted(times, m["rt_high"], "right")
    found = [(np.zeros(0, np.int64),) * 3]
    for z in charges if len(times) else ():
        want = m["mz"] + 1.00335483 / z
        for step in (-1, 0, 1):
            near = cell(want) + step * (len(times) + 1)
            first = np.searchsorted(place, near + low)
            n = np.searchsorted(place, near + high) - first
            upto, i = np.cumsum(n), 0
            while i < len(n):
                j = max(i + 1, int(np.searchsorted(upto, (upto[i - 1] if i else 0) + most, "right")))
                k = n[i:j]
                a = np.repeat(np.arange(i, j), k)
                b = np.repeat(first[i:j] - (np.cumsum(k) - k), k) + np.arange(len(a))
                hit = (np.abs(iso["mz"][b] - want[a]) <= tolerance) & (m["apex"][a] >= iso["rt_low"][b]) & (m["apex"][a] <= iso["rt_high"][b])
                found.append((np.full(hit.sum(), z), a[hit], b[hit]))
                i = j
    z, a, b = (np.concatenate(x) for x in zip(*found))
    return pd.DataFrame({**{k: np.repeat(d[k].iloc[:1].to_numpy(), len(a)) for k in key}, "charge": z, "mono_mz": m["mz"][a], "iso_mz": iso["mz"][b], "apex": iso["apex"][b]})


def group_isotopes(traces: DataFrame, charges: tuple = (1, 2, 3), tolerance: float = 0.02, key=("run_id",)) -> DataFrame:
    """(key, charge, mono_mz, iso_mz, apex): pairs of traces one isotope apart whose apexes lie in each other's time range.

    Traces meet in blocks of m/z: each is in its own as an isotope and, as a monoisotope, in those where its isotopes may be. Within cells
    of a block only those whose apexes lie in a monoisotope's time range are paired, some at a time."""
    steps = [1.00335483 / z for z in charges]
    mz, pad = F.col("mz"), tolerance * (1 + 1e-6) + 1e-9
    width = max(1.0, 4 * (max(steps) - min(steps) + 2 * pad))
    block = lambda x: F.floor(x / width)
    t = traces.filter(F.abs(mz) < float("inf"))
    for c in (*key, "apex", "rt_low", "rt_high"):
        t = t.filter(F.col(c).isNotNull())
    places = F.concat(F.array(F.struct(block(mz).alias("_block"), F.lit(False).alias("_mono"))), F.transform(F.sequence(block(mz + (min(steps) - pad)), block(mz + (max(steps) + pad))), lambda b: F.struct(b.alias("_block"), F.lit(True).alias("_mono"))))
    t = t.select(*key, "mz", "apex", "rt_low", "rt_high", F.inline(places))
    kind = {f.name: f.dataType.simpleString() for f in t.schema}
    out = ", ".join([*[f"`{k}` {kind[k]}" for k in key], "charge int, mono_mz double, iso_mz double", f"apex {kind['apex']}"])
    return t.groupBy(*key, "_block").applyInPandas(lambda d: _isotope_pairs(d, charges, tolerance, width, pad, key), out)
