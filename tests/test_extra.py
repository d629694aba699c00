"""Operators that SQL can't express, against brute force."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from spectraloom.functions import peptides as pe
from spectraloom.operators import identification as idn
from spectraloom.operators import runs as rn
from spectraloom.operators import targeted as ta


def _needleman(a, b, gap=5):
    same = {("I", "L"), ("L", "I"), ("K", "Q"), ("Q", "K")}
    t = [[-gap * j for j in range(len(b) + 1)]]
    for i, x in enumerate(a, 1):
        row = [-gap * i]
        for j, y in enumerate(b, 1):
            row.append(max(t[-1][j - 1] + (x == y or (x, y) in same), t[-1][j] - gap, row[-1] - gap))
        t.append(row)
    return t[-1][-1]


def test_alignment_score(spark):
    rng = random.Random(3)
    pairs = [("".join(rng.choice("ILKQAP") for _ in range(rng.randint(0, 9))), "".join(rng.choice("ILKQAP") for _ in range(rng.randint(0, 9)))) for _ in range(60)] + [("", ""), ("PEPTIDE", "PEPTIDE")]
    got = spark.createDataFrame(pairs, "a string, b string").select("a", "b", pe.alignment_score(F.col("a"), F.col("b")).alias("s")).collect()
    assert [r.s for r in got] == [_needleman(r.a, r.b) for r in got]


def test_modified_blocks_fixed_sites(spark):
    df = spark.createDataFrame([("MCM",), ("",)], "peptide string")
    rows = {(r.sites, r.n_modified): r.mass for r in pe.modified(df, ("Carbamidomethyl",), ("Oxidation",), 2).collect()}
    base = rows["", 0]
    assert set(rows) == {("", 0), ("1:Oxidation", 1), ("3:Oxidation", 1), ("1:Oxidation,3:Oxidation", 2)}
    assert abs(rows["1:Oxidation,3:Oxidation", 2] - base - 2 * 15.994915) < 1e-9


def test_enzymes_cut_everything(spark):
    df = spark.createDataFrame([(1, "MAKRPDEFWLHKPX")], "accession long, sequence string")
    for name in pe.ENZYMES:
        parts = [r.peptide for r in pe.digest_with(df, name).orderBy("start").collect()]
        assert "".join(parts) == "MAKRPDEFWLHKPX", name
    assert [r.peptide for r in pe.digest_with(df, "Trypsin").orderBy("start").collect()] == ["MAK", "RPDEFWLHKPX"]


def test_running_curve_as_one_pass(spark):
    rng = random.Random(4)
    rows = [(i % 2, float(rng.randint(0, 3000)), rng.random() < 0.3) for i in range(4000)]
    hits = spark.createDataFrame(rows, "run_id int, score double, decoy boolean")
    for pool in (["run_id"], []):
        want = {}
        for k in {tuple(r[:1]) if pool else () for r in rows}:
            mine = [r for r in rows if not pool or r[0] == k[0]]
            curve, t, d = [], 0, 0
            for s in sorted({r[1] for r in mine}, reverse=True):
                t += sum(1 for r in mine if r[1] == s and not r[2])
                d += sum(1 for r in mine if r[1] == s and r[2])
                curve.append((s, (d + 1) / (t + 1)))
            low = 1.0
            for s, v in reversed(curve):
                low = min(low, v)
                want[(*k, s)] = low
        got = {(*([r.run_id] if pool else []), r.score): r.q_value for r in idn.score_curve(hits, pool).collect()}
        assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-12 for k in got)


def test_lowess():
    x = np.linspace(0, 100, 60)
    y = 3 * x + 5
    assert np.allclose(rn.lowess(x, y), y)
    y[20] += 500  # one outlier loses its weight
    assert np.abs(rn.lowess(x, y) - (3 * x + 5)).max() < 3
    assert np.allclose(rn.lowess(np.ones(4), np.array([1.0, 2, 3, 4]), 1.0), 2.5)


def test_outliers(spark):
    rows = [(0, float(i), 2.0 * i + (300.0 if i == 7 else 0.1 * (i % 3))) for i in range(40)] + [(1, 1.0, 1.0), (1, 2.0, 5.0)]
    df = spark.createDataFrame(rows, "run_id int, x double, y double")
    kept = {(r.run_id, r.x) for r in ta.remove_outliers(df, "x", "y").collect()}
    assert kept == {(a, b) for a, b, _ in rows} - {(0, 7.0)}
    flagged = [(r.run_id, r.x) for r in ta.chauvenet_outliers(df, "x", "y", ("run_id",)).filter("outlier").collect()]
    assert flagged == [(0, 7.0)]
    out = ta.chauvenet_outliers(df.filter("run_id = 0"), "x", "y").toPandas()
    r = out["residual"]
    want = [math.erfc(abs(v - r.mean()) / r.std() / math.sqrt(2)) * len(r) < 0.5 for v in r]
    assert out["outlier"].tolist() == want


def test_groups(spark):
    f = [(0, 1, 1, 500.0, 10.0), (1, 2, 1, 500.01, 11.0), (2, 3, 1, 500.02, 12.0), (1, 4, 1, 500.03, 40.0), (0, 5, 1, 600.0, 10.0), (1, 6, 2, 600.0, 10.0)]
    df = spark.createDataFrame(f, "map_id long, feature_id long, charge int, mz double, rt double")
    groups = {}
    for r in rn.group_features(df, 0.05, 20.0).collect():
        groups.setdefault(r.group, set()).add(r.feature_id)
    assert sorted(map(sorted, groups.values())) == [[1, 2, 3], [4], [5], [6]]


def test_filter_is_left_to_right(spark):
    df = spark.createDataFrame([(1, 1), (1, 2), (2, 2), (3, 9)], "a int, b int")
    got = df.filter(rn.build_filter([("a", "=", 1), ("b", "=", 2, "OR"), ("a", "<", 2, "AND")])).collect()
    assert [tuple(r) for r in got] == [(1, 1), (1, 2)]
    assert df.filter(rn.build_filter([])).count() == 4
    with pytest.raises(KeyError):
        rn.build_filter([("a", "~", 1)])


def test_isotopes_and_compositions(spark):
    from spectraloom.functions import chemistry as ch
    from spectraloom.operators import assignments as asg

    (r,) = asg.peptide_isotopes(spark.createDataFrame([("PEPTIDE",)], "peptide string")).collect()
    assert np.allclose(r.isotopes, ch.isotope_pattern("C34H53N7O15"))
    assert abs(ch.formula_mass("C34H53N7O15") - 799.359964) < 1e-4
    alphabet = {"A": 3.0, "B": 5.0, "C": 7.5}
    df = spark.createDataFrame([(1, 15.0), (2, 1.0), (3, 7.6)], "id long, mass double")
    got = {(r.id, r.composition) for r in asg.compositions(df, alphabet, 0.2).collect()}
    want = set()
    for i, m in ((1, 15.0), (2, 1.0), (3, 7.6)):
        for a in range(6):
            for b in range(4):
                for c in range(3):
                    if a + b + c and abs(3 * a + 5 * b + 7.5 * c - m) <= 0.2:
                        want.add((i, " ".join(f"{k}{n}" for k, n in (("C", c), ("B", b), ("A", a)) if n)))
    assert got == want


def test_ransac_and_parabola(spark):
    from spectraloom.operators import statistics as st

    rng = random.Random(9)
    rows = [(0, float(i), 3.0 * i + 7 + rng.uniform(-0.4, 0.4)) for i in range(60)] + [(0, float(i), rng.uniform(-900, 900)) for i in range(25)]
    df = spark.createDataFrame(rows, "run_id int, x double, y double")
    kept = st.ransac(df, "x", "y", 1.0).collect()
    assert len(kept) >= 60 and all(abs(r.y - 3 * r.x - 7) < 2 for r in kept)
    few = spark.createDataFrame([(0, 1.0, 1.0), (0, 1.0, 2.0)], df.schema)
    assert st.ransac(few, "x", "y", 1.0).count() == 2
    curve = spark.createDataFrame([(0, float(i), 2.0 - i + 0.5 * i * i) for i in range(8)], df.schema)
    (r,) = st.regressions(curve, ("run_id",), "x", "y").collect()
    assert np.allclose([r.a, r.b, r.c], [2, -1, 0.5])
