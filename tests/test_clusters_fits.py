import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from spectraloom.operators import clustering as cl
from spectraloom.operators import fits as ft
from spectraloom.operators.elution import elution_peaks, extrema, filter_widths, half_width


def test_connected(spark):
    rng = random.Random(2)
    edges = [(i, i + 1) for i in range(30)] + [(100 + rng.randrange(40), 100 + rng.randrange(40)) for _ in range(30)]
    root = {x: x for x in [*range(31), *range(100, 140), 999]}
    for _ in range(70):
        for u, v in edges:
            root[u] = root[v] = min(root[u], root[v])
    got = cl.connected(spark.createDataFrame([(x,) for x in root], "id long"), spark.createDataFrame(edges, "a long, b long"))
    assert {r.id: r.cluster for r in got.collect()} == root


@pytest.mark.parametrize("method", ["single", "complete", "average"])
def test_linkage_by_definition(method):
    x = np.random.default_rng(4).normal(size=(14, 2))
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(2))
    of = {"single": np.min, "complete": np.max, "average": np.mean}[method]
    groups = {i: [i] for i in range(14)}
    for a, b, h in cl.linkage(d, method):
        best = min((of(d[np.ix_(groups[i], groups[j])]), i, j) for i in groups for j in groups if i < j)
        assert np.isclose(best[0], h) and best[1:] == (a, b)
        groups[a] += groups.pop(b)
    merges = cl.linkage(d, method)
    assert len(set(cl.cut(merges, 14, clusters=4).tolist())) == 4
    assert len(set(cl.cut(merges, 14, height=0.0).tolist())) == 14


def test_silhouette_by_definition():
    x = np.array([0.0, 1.0, 1.5, 9.0, 10.0, 20.0])
    d, label = np.abs(x[:, None] - x[None]), np.array([0, 0, 0, 3, 3, 5])
    want = []
    for i in range(6):
        own = [j for j in range(6) if label[j] == label[i] and j != i]
        if not own:
            want.append(0)
            continue
        a = d[i, own].mean()
        b = min(d[i, label == k].mean() for k in set(label.tolist()) - {label[i]})
        want.append((b - a) / max(a, b))
    assert np.isclose(cl.silhouette(d, label), np.mean(want))
    assert cl.silhouette(d, np.zeros(6)) == 0.0


def test_hierarchical(spark):
    rows = [("a", 5, 0.0, 0.0), ("a", 3, 0.5, 0.0), ("a", 9, 5.0, 5.0), ("b", 1, 0.0, 0.0)]
    df = spark.createDataFrame(rows, "k string, id long, x double, y double")
    assert {r.id: r.cluster for r in cl.hierarchical(df, ("k",), ("x", "y"), "complete", 1.0).collect()} == {5: 3, 3: 3, 9: 9, 1: 1}


def test_splines():
    x = np.array([0.0, 1.0, 2.5, 4.0, 6.0])
    y = np.sin(x)
    for f in (ft.cubic_spline, ft.akima):
        assert np.allclose(f(x, y, x), y)
        assert np.allclose(f(x, 2 * x + 1, [-3, 0.3, 5.5, 9]), [-5, 1.6, 12, 19])  # lines stay lines
        assert np.allclose(f([1.0, 1.0], [2.0, 4.0], [0, 7]), 3)
    # natural spline by the equations of its second derivatives
    h, n = np.diff(x), len(x)
    a = np.eye(n)
    r = np.zeros(n)
    for i in range(1, n - 1):
        a[i, i - 1 : i + 2] = h[i - 1], 2 * (h[i - 1] + h[i]), h[i]
        r[i] = 6 * ((y[i + 1] - y[i]) / h[i] - (y[i] - y[i - 1]) / h[i - 1])
    assert np.allclose(np.linalg.solve(a, r), ft.cubic_second(x, y))
    # Akima keeps flat stretches flat
    assert np.allclose(ft.akima([0, 1, 2, 3, 4, 5], [0, 0, 0, 0, 5, 5], [0.5, 1.5]), 0)
    at = np.linspace(0, 6, 50)
    assert np.abs(ft.b_spline(at, at**3 - at, at, 4) - (at**3 - at)).max() < 1e-8  # a cubic is one
    assert np.isclose(ft.b_spline(at, at, [99.0])[0], 6)


def test_interpolate(spark):
    p = spark.createDataFrame([("a", float(i), float(i * i)) for i in range(6)], "k string, x double, y double")
    q = spark.createDataFrame([("a", 2.0), ("a", 2.5), ("b", 1.0)], "k string, x double")
    got = {(r.k, r.x): r.y for r in ft.interpolate(p, q, ("k",), "cubic").collect()}
    assert got["a", 2.0] == 4 and abs(got["a", 2.5] - 6.25) < 0.1 and got["b", 1.0] is None


def test_fits_find_the_parameters(spark):
    x = np.linspace(0.1, 12, 80)
    truth = {"gauss": (7.0, 5.0, 1.3), "egh": (7.0, 5.0, 0.9, 0.4), "gumbel": (4.0, 1.2), "gamma": (1.5, 6.0)}
    rows = [(s, float(a), float(b)) for s, p in truth.items() for a, b in zip(x, ft.SHAPES[s][0](np.array(p), x))]
    for s, p in truth.items():
        df = spark.createDataFrame([r for r in rows if r[0] == s] + [("few", 1.0, 2.0)], "k string, x double, y double")
        got = {r.k: r for r in ft.fit_shapes(df, ("k",), s).collect()}
        assert np.allclose([got[s][n] for n in ft.SHAPES[s][1]], p, rtol=1e-3), (s, got[s])
        assert got[s].r2 > 0.9999 and got["few"][ft.SHAPES[s][1][0]] is None and got["few"].n == 1


def test_gumbel_likelihood(spark):
    v = np.random.default_rng(1).gumbel(3.0, 1.7, 4000)
    df = spark.createDataFrame([("g", float(x)) for x in v] + [("h", 2.0), ("h", None)], "k string, v double")
    (r,) = ft.gumbel_likelihood(df, ("k",), "v").collect()
    b = r.scale
    w = np.exp(-v / b)
    assert abs(b - (v.mean() - (v * w).sum() / w.sum())) < 1e-6  # the likelihood's own equation
    assert abs(r.location + b * np.log(w.mean())) < 1e-6 and abs(b - 1.7) < 0.1 and r.n == 4000


def test_elution(spark):
    y = np.array([0, 1, 3, 1, 0, 2, 6, 2, 0, 0], float)
    assert extrema(y, 2) == ([2, 6], [4]) and extrema(np.zeros(4), 1) == ([], [])
    assert np.isclose(half_width(np.arange(10.0), y, 6), 1.5)
    x = np.arange(0, 100, 1.0)
    i = 100 * np.exp(-((x - 30) ** 2) / 50) + 60 * np.exp(-((x - 70) ** 2) / 50)
    df = spark.createDataFrame([(1, float(a), 500.0, float(b)) for a, b in zip(x, i)], "trace long, rt double, mz double, intensity double")
    got = elution_peaks(df, ("trace",), width=10.0).orderBy("rt").collect()
    assert len(got) == 2 and abs(got[0].rt - 30) <= 1 and abs(got[1].rt - 70) <= 1
    assert abs(got[0].width - 2.355 * 5) < 2.5 and abs(got[0].area / (100 * 5 * np.sqrt(2 * np.pi)) - 1) < 0.02
    peaks = spark.range(101).select(F.lit("p").alias("pool"), F.col("id").cast("double").alias("width"))
    assert sorted(r.width for r in filter_widths(peaks, ("pool",)).collect()) == list(range(5, 96))
    assert filter_widths(peaks, ("pool",), 10.0, 12.0).count() == 3
