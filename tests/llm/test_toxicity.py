import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from spectraloom.llm.toxicity import nn_pu, op5_toxicity, score, train

DATA = "/root/testdata/sf0.1"


def test_risk_separates_without_negatives():
    rng = np.random.default_rng(1)
    n, prior = 4000, 0.3
    high, low = np.array([0.7, 0.6, 0.5, 0.3, 0.3, 0.3]), np.array([0.02, 0.05, 0.05, 0.3, 0.3, 0.3])
    toxic = rng.random(n) < prior
    x = (rng.random((n, 6)) < np.where(toxic[:, None], high, low)).astype(np.float32)
    p = (rng.random((800, 6)) < high).astype(np.float32)
    w, b = nn_pu(p, x, prior)
    best = np.log(prior / (1 - prior)) + (x * np.log(high / low) + (1 - x) * np.log((1 - high) / (1 - low))).sum(1) > 0
    # close to the rule that knows the true rates
    assert ((x @ w + b > 0) == toxic).mean() > (best == toxic).mean() - 0.02


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no tables")
def test_held_out_accuracy(spark):
    out = op5_toxicity(spark, DATA).join(spark.read.parquet(f"{DATA}/labels.parquet"), "doc_id").filter("held_out")
    c = {(r.toxic, r.predicted): r["count"] for r in out.groupBy("toxic", "predicted").count().collect()}
    assert c[1, 1] / (c[1, 1] + c.get((1, 0), 0)) > 0.75
    assert c.get((0, 1), 0) / (c[0, 0] + c.get((0, 1), 0)) < 0.01


def test_odd_rows(spark):
    rng = np.random.default_rng(2)
    rows = [(i, " ".join(["bad"] * (i % 4 == 0) + [f"w{rng.integers(0, 50)}" for _ in range(20)]), 0.5) for i in range(200)] + [(None, None, None), (5, "", 1.0), (5, "", 1.0), (900, "BAD, " * 30000, 0.0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, Score double")
    labels = spark.createDataFrame([(i, int(i % 4 == 0)) for i in range(120)] + [(None, 1), (3, None), (4, 1), (4, 0)], "doc_id long, toxic int")
    got = score(docs, train(docs, labels))
    assert got.columns == ["doc_id", "text", "score"]
    got = {(r.doc_id, r.text): r.score for r in got.collect()}
    assert all(0 <= v <= 1 for v in got.values()) and len(got) == 203
    assert got[900, rows[-1][1]] >= 0.7 and got[150, rows[150][1]] < 0.5 and got[5, ""] < 0.5 and got[None, None] < 0.5


def test_empty_tables(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    labels = spark.createDataFrame([], "doc_id long, toxic int")
    assert score(docs, train(docs, labels)).collect() == []
    one = spark.createDataFrame([(1, "x")], "doc_id long, text string")
    assert score(one, train(one, labels)).filter(F.col("score") < 0.5).count() == 1


def test_weights_are_repeats():
    rng = np.random.default_rng(3)
    p, u = ((rng.random((40, 5)) < q).astype(np.float32) for q in (0.6, 0.2))
    n_p, n_u = rng.integers(1, 5, 40), rng.integers(1, 9, 40)
    w, b = nn_pu(p, u, 0.2, n_p=n_p, n_u=n_u)
    w2, b2 = nn_pu(np.repeat(p, n_p, axis=0), np.repeat(u, n_u, axis=0), 0.2)
    assert np.allclose(w, w2, atol=1e-2) and abs(b - b2) < 1e-2


def test_all_texts_count_and_few_rows_are_fitted(spark, monkeypatch):
    rng = np.random.default_rng(4)
    bad = [f"bad{k}" for k in range(12)]
    some = lambda q: " ".join([x for x in bad if rng.random() < q])
    toxic = [(i, f"{some(0.5)} common") for i in range(100)] + [(7, f"{some(0.5)} common") for _ in range(600)]
    for group in (None, 5000, 5001, 5002):  # one id for half of the rows
        rows = [(group, f"common {some(0.1)}") for _ in range(1000)] + [(1000 + i, f"plain {some(0.02)}") for i in range(1000)]
        docs = spark.createDataFrame(toxic + rows, "doc_id long, text string")
        labels = spark.createDataFrame([(i, 1) for i in range(100)] + [(1000 + i, 0) for i in range(400)], "doc_id long, toxic int")
        seen = {}

        def fit(p, u, prior, n_p=None, n_u=None):
            seen.update(p=len(p), u=len(u), n_p=n_p, n_u=n_u)
            return nn_pu(p, u, prior, n_p=n_p, n_u=n_u)

        monkeypatch.setattr("spectraloom.llm.toxicity.nn_pu", fit)
        model = train(docs, labels, most_labelled=150, most_unlabelled=200)
        assert 20 < seen["p"] < 220 and 20 < seen["u"] < 270
        assert abs(seen["n_p"].sum() / 700 - 1) < 0.25 and abs(seen["n_u"].sum() / 2700 - 1) < 0.25
        got = {r.text: r.score for r in score(spark.createDataFrame([("common",), ("plain",), (" ".join(bad),)], "text string"), model).collect()}
        assert got[" ".join(bad)] > 0.7 > 0.5 > got["common"] and got["plain"] < 0.5
