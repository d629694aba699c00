import random

import numpy as np

from spectraloom.operators.assembly import ISOTOPE, assemble_features, pick_groups
from spectraloom.operators.rescoring import logistic, rescore, standardised


def brute(traces, charges=(1, 2, 3), tolerance=0.02, isotopes=4):
    hypotheses = []
    for t in traces:
        hypotheses.append((1, t[5], 0, t[0], (t[0],)))
        for z in charges:
            members, total = [t[0]], t[5]
            for k in range(1, isotopes + 1):
                at = t[1] + k * ISOTOPE / z
                near = [(abs(u[1] - at), u[0], u[5]) for u in traces if abs(u[1] - at) <= tolerance and t[2] <= u[4] <= t[3]]
                if not near:
                    break
                members.append(min(near)[1])
                total += min(near)[2]
            if len(members) > 1:
                hypotheses.append((len(members), total, z, t[0], tuple(members)))
    out = set()
    while hypotheses:
        best = min(hypotheses, key=lambda h: (-h[0], -h[1], h[2], h[3]))
        out.add((best[3], best[2], best[4]))
        hypotheses = [h for h in hypotheses if not set(h[4]) & set(best[4])]
    return out


def test_features_as_one_by_one(spark):
    rng = random.Random(3)
    traces = []
    for _ in range(25):
        mz, z, rt = 400 + rng.random() * 3, rng.choice([1, 2, 3]), rng.random() * 100
        for k in range(rng.randint(1, 5)):
            traces.append((len(traces), mz + k * ISOTOPE / z + rng.gauss(0, 0.004), rt - 10, rt + 10, rt + rng.gauss(0, 2), float(rng.randint(1, 1000))))
    df = spark.createDataFrame([(0, *t) for t in traces], "run_id int, trace long, mz double, rt_low double, rt_high double, apex double, intensity double")
    got = {(r.trace, r.charge, tuple(r.traces)) for r in assemble_features(df).collect()}
    assert got == brute(traces)
    assert assemble_features(df.limit(0)).collect() == []


def test_pick_groups(spark):
    x = np.arange(0, 120, 2.0)
    rows = []
    for name, share in (("t1", 1.0), ("t2", 0.4)):
        y = share * (100 * np.exp(-((x - 30) ** 2) / 60) + 50 * np.exp(-((x - 90) ** 2) / 60))
        rows += [("g", name, float(a), float(b)) for a, b in zip(x, y)]
    rows += [("flat", "t", float(a), 0.0) for a in x]
    got = pick_groups(spark.createDataFrame(rows, "group string, transition string, rt double, intensity double")).collect()
    by = {(r.peak, r.transition): r for r in got}
    assert len(got) == 4 and {r.group for r in got} == {"g"}
    assert abs(by[0, "t1"].rt - 30) <= 2 and abs(by[1, "t1"].rt - 90) <= 2
    assert abs(by[0, "t2"].area / by[0, "t1"].area - 0.4) < 0.01 and by[0, "t2"].correlation > 0.99


def test_rescoring_finds_more(spark):
    rng = np.random.default_rng(5)
    n = 3000
    decoy = rng.random(n) < 0.5
    true = ~decoy & (rng.random(n) < 0.5)
    f = rng.normal(size=(n, 3)) + np.outer(true, [1.6, 1.6, 1.6])
    df = spark.createDataFrame([(i, i // 2, bool(d), *map(float, r)) for i, (d, r) in enumerate(zip(decoy, f))], "hit_id long, spectrum_id long, decoy boolean, a double, b double, c double")
    got = rescore(df, ("a", "b", "c"), "a", rounds=2).collect()
    assert len(got) == n and set(got[0].asDict()) == {"hit_id", "spectrum_id", "decoy", "a", "b", "c", "new_score", "q_value"}
    ok = [r.hit_id for r in got if not r.decoy and r.q_value <= 0.05]
    best = sorted(zip(f[:, 0], decoy), reverse=True)
    t = d = alone = 0
    for _, is_decoy in best:
        d, t = d + is_decoy, t + (not is_decoy)
        alone = t if (d + 1) / (t + d + 1) <= 0.05 else alone
    assert len(ok) > 1.5 * alone and np.mean([true[i] for i in ok]) > 0.85


def test_logistic_as_newton_by_hand(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(200, 2)) * [2, 5] + [1, -3]
    y = (x[:, 0] + rng.normal(size=200) > 1).astype(int)
    df, scale = standardised(spark.createDataFrame([(float(a), float(b), int(c)) for (a, b), c in zip(x, y)], "a double, b double, y int"), ("a", "b"))
    w = logistic(df, 2, "y")
    z = np.column_stack([(x - [m for m, _ in scale]) / [s for _, s in scale], np.ones(200)])
    share = np.where(y == 1, 0.5 / y.sum(), 0.5 / (1 - y).sum())
    grad = z.T @ (share * (1 / (1 + np.exp(-z @ w)) - y)) + 1e-2 * np.append(w[:-1], 0)
    assert np.abs(grad).max() < 1e-6


def test_split_by_origin(spark, tmp_path):
    from spectraloom.operators.quality import split_by_origin

    df = spark.createDataFrame([(i, i % 3, float(i)) for i in range(9)], "hit_id long, run_id int, score double")
    split_by_origin(df, str(tmp_path / "hits"))
    assert sorted(p.name for p in (tmp_path / "hits").iterdir() if p.is_dir()) == ["run_id=0", "run_id=1", "run_id=2"]
    assert sorted(r.hit_id for r in spark.read.parquet(str(tmp_path / "hits")).filter("run_id = 1").collect()) == [1, 4, 7]
