"""Semi-supervised rescoring of hits by target-decoy competition, on hits of any number.

A linear model is fitted by weighted least squares of a logistic curve: each step is one pass of partial sums over all training hits (as
many sums as pairs of features), so no hit leaves its task and none is sampled. Hits are dealt to folds by their spectrum; each fold is
scored by the model that hasn't seen it.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.scratch import written
from .identification import apply_fdr


def standardised(hits: DataFrame, features: tuple) -> tuple[DataFrame, list[tuple[float, float]]]:
    """hits with the features centred and scaled (those without spread are 0), as columns _f0, _f1 ..; and their means and deviations."""
    s = hits.agg(*[f(c).alias(f"{n}{i}") for i, c in enumerate(features) for n, f in (("m", F.avg), ("s", F.stddev_pop))]).first()
    scale = [(s[f"m{i}"] or 0.0, s[f"s{i}"] or 0.0) for i in range(len(features))]
    cols = [((F.coalesce(F.col(c).cast("double"), F.lit(m)) - m) / d if d else F.lit(0.0)).alias(f"_f{i}") for i, (c, (m, d)) in enumerate(zip(features, scale))]
    return hits.select("*", *cols), scale


def _linear(weights: np.ndarray) -> Column:
    out = F.lit(float(weights[-1]))
    for i, w in enumerate(weights[:-1]):
        out = out + F.col(f"_f{i}") * float(w)
    return out


def logistic(train: DataFrame, n: int, label: str, ridge: float = 1e-2, rounds: int = 12) -> np.ndarray:
    """Weights of _f0 .. and a constant for a 0/1 label, both labels counting alike: Newton steps, one pass each, until they stay."""
    w = np.zeros(n + 1)
    x = [F.col(f"_f{i}") for i in range(n)] + [F.lit(1.0)]
    size = {r[label]: r["count"] for r in train.groupBy(label).count().collect()}
    if len(size) < 2:
        raise ValueError("both labels are needed")
    share = F.when(F.col(label) == 1, 0.5 / size[1]).otherwise(0.5 / size[0])
    for _ in range(rounds):
        p = 1 / (1 + F.exp(-_linear(w)))
        g, h = share * (p - F.col(label)), share * p * (1 - p)
        cells = [(i, j) for i in range(n + 1) for j in range(i, n + 1)]
        s = train.agg(*[F.sum(g * a).alias(f"g{i}") for i, a in enumerate(x)], *[F.sum(h * x[i] * x[j]).alias(f"h{i}_{j}") for i, j in cells]).first()
        grad = np.array([s[f"g{i}"] for i in range(n + 1)]) + ridge * np.append(w[:-1], 0)
        hess = np.zeros((n + 1, n + 1))
        for i, j in cells:
            hess[i, j] = hess[j, i] = s[f"h{i}_{j}"]
        hess += np.diag([ridge] * n + [1e-9])
        step = np.linalg.solve(hess, grad)
        w = w - step
        if np.abs(step).max() < 1e-6:
            break
    return w


def rescore(hits: DataFrame, features: tuple, start: str, folds: int = 3, rounds: int = 3, q: float = 0.01) -> DataFrame:
    """hits (hit_id, spectrum_id, decoy, features) with new_score and q_value (of all hits by new_score, decoys kept).

    In each round and fold, targets of the other folds with a q value of at most `q` by the score so far (in the first round by the
    column `start`, higher being better) and all their decoys train a model. If fewer than 20 targets pass, the best 20 % of the targets do."""
    rows, _ = standardised(hits, features)
    rows = written(rows.withColumn("_fold", F.pmod(F.xxhash64("spectrum_id"), F.lit(folds))), "rescore")
    now = rows.withColumn("new_score", F.col(start).cast("double"))
    for _ in range(rounds):
        scored = None
        for k in range(folds):
            others = now.filter(F.col("_fold") != k)
            curve = written(apply_fdr(others.select("hit_id", "decoy", F.col("new_score").alias("score")), [], "basic", True).select("hit_id", "q_value"), "curve")
            good = others.filter(~F.col("decoy")).join(curve.filter(F.col("q_value") <= q), "hit_id", "left_semi")
            if good.limit(20).count() < 20:
                cut = others.filter(~F.col("decoy")).agg(F.percentile_approx("new_score", 0.8, 10_000)).first()[0]
                good = others.filter(~F.col("decoy") & (F.col("new_score") >= cut))
            train = good.withColumn("_y", F.lit(1)).unionByName(others.filter("decoy").withColumn("_y", F.lit(0)))
            w = logistic(train, len(features), "_y")
            part = rows.filter(F.col("_fold") == k).withColumn("new_score", _linear(w))
            scored = part if scored is None else scored.unionByName(part)
        now = written(scored, "rescored")
    curve = apply_fdr(now.select("hit_id", "decoy", F.col("new_score").alias("score")), [], "basic", True).select("hit_id", "q_value")
    return now.join(curve, "hit_id").drop("_fold", *[f"_f{i}" for i in range(len(features))])
