"""Curves through points and fitted shapes, for groups of bounded size: splines, and least squares by damped Gauss-Newton steps."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.scratch import written

# ---------------------------------------------------------------- splines


def _sorted(x, y) -> tuple[np.ndarray, np.ndarray]:
    """By x; equal x with their mean y."""
    x, y = np.asarray(x, float), np.asarray(y, float)
    at, where = np.unique(x, return_inverse=True)
    return at, np.bincount(where, y) / np.bincount(where)


def cubic_second(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Second derivatives of the natural cubic spline at its knots: one forward and one backward pass."""
    n = len(x)
    out = np.zeros(n)
    if n < 3:
        return out
    h, slope = np.diff(x), np.diff(y) / np.diff(x)
    right = 6 * np.diff(slope)
    upper, value = np.zeros(n - 2), np.zeros(n - 2)
    for i in range(n - 2):
        low = h[i] if i else 0.0
        pivot = 2 * (h[i] + h[i + 1]) - low * (upper[i - 1] if i else 0.0)
        upper[i] = h[i + 1] / pivot
        value[i] = (right[i] - low * (value[i - 1] if i else 0.0)) / pivot
    for i in range(n - 3, -1, -1):
        out[i + 1] = value[i] - upper[i] * out[i + 2]
    return out


def cubic_spline(x, y, at) -> np.ndarray:
    """Natural cubic spline at `at`; lines go on beyond the ends."""
    x, y = _sorted(x, y)
    at = np.asarray(at, float)
    if len(x) == 1:
        return np.full(len(at), y[0])
    m = cubic_second(x, y)
    k = np.clip(np.searchsorted(x, at, "right") - 1, 0, len(x) - 2)
    h, t = x[k + 1] - x[k], at - x[k]
    slope = (y[k + 1] - y[k]) / h - h * (2 * m[k] + m[k + 1]) / 6
    out = y[k] + t * (slope + t * (m[k] / 2 + t * (m[k + 1] - m[k]) / (6 * h)))
    first = (y[1] - y[0]) / (x[1] - x[0]) - (x[1] - x[0]) * m[1] / 6
    last = (y[-1] - y[-2]) / (x[-1] - x[-2]) + (x[-1] - x[-2]) * m[-2] / 6
    return np.where(at < x[0], y[0] + first * (at - x[0]), np.where(at > x[-1], y[-1] + last * (at - x[-1]), out))


def akima(x, y, at) -> np.ndarray:
    """Akima's spline: slopes at knots weighted by how much the segments' slopes change on the other side; lines beyond the ends."""
    x, y = _sorted(x, y)
    at = np.asarray(at, float)
    if len(x) < 3:
        return cubic_spline(x, y, at)
    s = np.diff(y) / np.diff(x)
    s = np.concatenate([[3 * s[0] - 2 * s[1], 2 * s[0] - s[1]], s, [2 * s[-1] - s[-2], 3 * s[-1] - 2 * s[-2]]])
    change = np.abs(np.diff(s))
    left, right = change[2:], change[:-2]
    both = left + right
    d = np.where(both > 1e-12, (left * s[1:-2] + right * s[2:-1]) / np.where(both > 1e-12, both, 1), (s[1:-2] + s[2:-1]) / 2)
    k = np.clip(np.searchsorted(x, at, "right") - 1, 0, len(x) - 2)
    h, t = x[k + 1] - x[k], at - x[k]
    own = (y[k + 1] - y[k]) / h
    out = y[k] + t * (d[k] + t * ((3 * own - 2 * d[k] - d[k + 1]) / h + t * (d[k] + d[k + 1] - 2 * own) / h**2))
    return np.where(at < x[0], y[0] + d[0] * (at - x[0]), np.where(at > x[-1], y[-1] + d[-1] * (at - x[-1]), out))


def b_spline(x, y, at, nodes: int = 5) -> np.ndarray:
    """Cubic B-spline of least squares with so many equal intervals; beyond the ends its value there."""
    x, y = np.asarray(x, float), np.asarray(y, float)
    low, high = x.min(), x.max()
    width = (high - low) / nodes or 1.0

    def basis(v: np.ndarray) -> np.ndarray:
        u = (np.clip(v, low, high) - low) / width
        k = np.clip(np.floor(u).astype(int), 0, nodes - 1)
        t = u - k
        out = np.zeros((len(v), nodes + 3))
        for j, w in enumerate(((1 - t) ** 3, 3 * t**3 - 6 * t**2 + 4, -3 * t**3 + 3 * t**2 + 3 * t + 1, t**3)):
            out[np.arange(len(v)), k + j] = w / 6
        return out

    return basis(np.asarray(at, float)) @ np.linalg.lstsq(basis(x), y, rcond=None)[0]


CURVES = {"cubic": cubic_spline, "akima": akima, "b_spline": b_spline}


def interpolate(points: DataFrame, queries: DataFrame, key: tuple, kind: str = "cubic", most: int = 200_000) -> DataFrame:
    """queries (key, x) with y: of the curve through the key's points (x, y); null without points. A key's points are one task's work, `most` at most."""

    def run(k: tuple, p: pd.DataFrame, q: pd.DataFrame) -> pd.DataFrame:
        if len(p) > most:
            raise ValueError(f"{len(p)} points of one key; at most {most}")
        p = p.dropna()
        return q.assign(y=CURVES[kind](p["x"], p["y"], q["x"]) if len(p) and len(q) else np.nan)

    left = points.select(*key, F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y")).groupBy(*key)
    right = queries.select(*key, F.col("x").cast("double").alias("x"))
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in right.schema), "y double"])
    return left.cogroup(right.groupBy(*key)).applyInPandas(run, schema).withColumn("y", F.nanvl("y", F.lit(None).cast("double")))


# ---------------------------------------------------------------- shapes


def least_squares(model, start: np.ndarray, x: np.ndarray, y: np.ndarray, rounds: int = 200) -> np.ndarray:
    """Parameters that make model(parameters, x) nearest to y: Gauss-Newton steps, damped more after a failure and less after a success."""
    p, damp = np.array(start, float), 1e-3
    r = model(p, x) - y
    cost = r @ r
    for _ in range(rounds):
        step = 1e-6 * np.maximum(np.abs(p), 1e-3)
        j = np.stack([(model(p + e, x) - model(p - e, x)) / (2 * s) for e, s in zip(np.diag(step), step)], 1)
        g, a = j.T @ r, j.T @ j
        done = True
        while damp < 1e12:
            try:
                q = p - np.linalg.solve(a + damp * np.diag(np.maximum(np.diag(a), 1e-12)), g)
            except np.linalg.LinAlgError:
                damp *= 10
                continue
            s = model(q, x) - y
            new = s @ s
            if np.isfinite(new) and new < cost:
                done = cost - new <= 1e-14 * cost
                p, r, cost, damp = q, s, new, max(damp / 10, 1e-12)
                break
            damp *= 10
        if done:
            break
    return p


def gauss(p, x):
    """height, centre, sigma"""
    return p[0] * np.exp(-((x - p[1]) ** 2) / (2 * p[2] ** 2))


def egh(p, x):
    """height, centre, sigma, tau: a Gaussian whose width grows by tau along x, 0 where that width would be negative."""
    w = 2 * p[2] ** 2 + p[3] * (x - p[1])
    return np.where(w > 0, p[0] * np.exp(-((x - p[1]) ** 2) / np.where(w > 0, w, 1)), 0.0)


def gumbel(p, x):
    """location, scale: density"""
    z = (x - p[0]) / p[1]
    return np.exp(-z - np.exp(np.clip(-z, None, 700))) / abs(p[1])


def gamma(p, x):
    """rate, shape: density, 0 at x <= 0"""
    ok = x > 0
    return np.where(ok, np.exp(p[1] * np.log(abs(p[0])) + (p[1] - 1) * np.log(np.where(ok, x, 1.0)) - abs(p[0]) * x - math.lgamma(max(p[1], 1e-6))), 0.0)


def _moments(x: np.ndarray, w: np.ndarray) -> tuple[float, float]:
    w = np.maximum(w, 0) + 1e-300
    m = (w * x).sum() / w.sum()
    return m, max((w * (x - m) ** 2).sum() / w.sum(), 1e-12)


def _starts(shape: str, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    m, v = _moments(x, y)
    if shape == "gumbel":
        b = math.sqrt(6 * v) / math.pi
        return np.array([m - 0.5772156649015329 * b, b])
    if shape == "gamma":
        return np.array([m / v, m * m / v])
    top = int(np.argmax(y))
    return np.array([y[top], x[top], math.sqrt(v), 0.0][: 4 if shape == "egh" else 3])


SHAPES = {"gauss": (gauss, ("height", "centre", "sigma")), "egh": (egh, ("height", "centre", "sigma", "tau")), "gumbel": (gumbel, ("location", "scale")), "gamma": (gamma, ("rate", "shape"))}


def fit_shapes(points: DataFrame, key: tuple, shape: str, least: int = 4) -> DataFrame:
    """(key, parameters, n, r2) of the shape nearest to each key's points (x, y); null parameters for fewer than `least` points.

    A key's points (a trace, a histogram) are one task's work."""
    model, names = SHAPES[shape]

    def run(f: pd.DataFrame) -> pd.DataFrame:
        out = {k: [f[k].iloc[0]] for k in key} | {k: [None] for k in names} | {"n": [len(f)], "r2": [None]}
        x, y = f["x"].to_numpy(float), f["y"].to_numpy(float)
        if len(np.unique(x)) >= least:
            p = least_squares(model, _starts(shape, x, y), x, y)
            spread = ((y - y.mean()) ** 2).sum()
            for k, v in zip(names, p):
                out[k] = [abs(float(v)) if k in ("sigma", "scale", "rate") else float(v)]
            out["r2"] = [float(1 - ((model(p, x) - y) ** 2).sum() / spread) if spread > 0 else None]
        return pd.DataFrame(out)

    src = points.select(*key, F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y")).dropna(subset=["x", "y"])
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in src.schema[: len(key)]), *(f"{k} double" for k in names), "n long", "r2 double"])
    return src.orderBy("x").groupBy(*key).applyInPandas(lambda f: run(f.sort_values(["x", "y"], kind="stable")), schema)


def gumbel_likelihood(values: DataFrame, key: tuple, value: str, rounds: int = 40) -> DataFrame:
    """(key, n, location, scale) of greatest likelihood, for keys of any size: Newton steps of the scale in partial sums, one pass each."""
    v = values.select(*key, F.col(value).cast("double").alias("_v")).filter("_v IS NOT NULL")
    now = v.groupBy(*key).agg(F.count("*").alias("n"), F.avg("_v").alias("_m"), F.stddev_pop("_v").alias("_s")).filter("_s > 0")
    now = now.withColumn("_b", F.col("_s") * math.sqrt(6) / math.pi)
    for _ in range(rounds):
        d = F.col("_v") - F.col("_m")
        e = F.exp(-d / F.col("_b"))
        s = v.join(now, list(key)).groupBy(*key).agg(F.first("n").alias("n"), F.first("_m").alias("_m"), F.first("_s").alias("_s"), F.first("_b").alias("_b"), F.sum(e).alias("_e"), F.sum(d * e).alias("_de"), F.sum(d * d * e).alias("_dde"))
        # root of b - (mean - weighted mean) = b + sum(d e) / sum(e)
        f = F.col("_b") + F.col("_de") / F.col("_e")
        slope = 1 + (F.col("_dde") / F.col("_e") - F.pow(F.col("_de") / F.col("_e"), 2)) / (F.col("_b") * F.col("_b"))
        new = s.withColumn("_new", F.greatest(F.col("_b") - f / slope, F.col("_b") / 4))
        rows = new.select(*key, "n", "_m", "_s", "_b", "_new", (F.col("_m") - F.col("_b") * F.log(F.col("_e") / F.col("n"))).alias("location"))
        rows = written(rows, "gumbel")
        moved = rows.agg(F.max(F.abs(F.col("_new") - F.col("_b")) / F.col("_b"))).first()[0]
        done = moved is None or moved < 1e-10
        if done:
            return rows.select(*key, "n", "location", F.col("_b").alias("scale"))
        now = rows.select(*key, "n", "_m", "_s", F.col("_new").alias("_b"))
    return rows.select(*key, "n", "location", F.col("_b").alias("scale"))
