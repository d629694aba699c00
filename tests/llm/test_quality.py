import random
from collections import Counter

import numpy as np

from spectraloom.llm.quality import _P, chi2_quantile, consistency, minimum_covariance, quality_rules


def counts(t):
    t = t or ""
    b = t.encode()
    w = b.split()
    lines = [x for x in t.split("\n") if x.encode().split()]
    grams = Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
    cover = {i + k for i in range(len(w) - 2) if grams[tuple(w[i : i + 3])] > 1 for k in range(3)}
    return len(w), sum(len(x.decode()) for x in w), sum(c in "#*$%&|<>" for c in t), len(lines) - len(set(lines)), len(cover)


def test_counts_as_brute_force(spark):
    rng = random.Random(1)
    texts = [None, "", "\n", "a", "\n\na b\n a b\na b\n", "é|\xa0é <x>\r\n\r\n"] + ["".join(rng.choice("ab \n#é") for _ in range(rng.randint(0, 60))) for _ in range(300)] + ["x y z " * 30000]
    df = spark.createDataFrame([(i, t, None, "s", 1, 2) for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string, N_Words int, _row int").coalesce(2)
    got = quality_rules(df)
    assert got.columns == ["doc_id", "lang", "source", "_row", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "distance", "kept"]
    got = {r.doc_id: r for r in got.collect()}
    assert len(got) == len(texts)
    for i, t in enumerate(texts):
        r, want = got[i], counts(t)
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == want, repr(t)
        assert r.base_failed == (want[0] < 50 or 100 * want[4] > 50 * want[0])


def test_outliers_of_a_group(spark):
    rng = random.Random(2)
    word = lambda: "".join(rng.choice("abcdefghijk") for _ in range(rng.randint(3, 8)))
    rows, bad = [], set()
    for i in range(400):
        words = [word() for _ in range(rng.randint(60, 300))]
        if i % 5 == 0:
            words = [w + "***" for w in words]
            bad.add(i)
        rows.append((i, " ".join(words), "en", "hot" if i < 300 else f"s{i % 10}"))
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").coalesce(2)
    got = quality_rules(df).collect()
    assert {r.doc_id for r in got if not r.kept} == bad
    few = quality_rules(df.limit(20)).collect()
    assert all(r.distance is None and r.kept for r in few)


def test_estimate_resists_contamination(spark):
    rng = np.random.default_rng(3)
    good = rng.normal(size=(1500, _P)) * [2, 1, 3, 1, 2] + [1, 2, 3, 4, 5]
    x = np.vstack([good, rng.normal(size=(350, _P)) + 40])
    df = spark.createDataFrame([("g", i, r.tolist()) for i, r in enumerate(x)], "_g string, _row long, x array<double>")
    (r,) = minimum_covariance(df).collect()
    assert np.abs(np.array(r["mean"]) - good.mean(0)).max() < 0.2
    cov = np.linalg.inv(np.array(r["inv"]).reshape(_P, _P))
    assert np.abs(np.diag(cov) / good.var(0) - 1).max() < 0.35


def direct(x, part, scale, starts=200):
    """The smallest determinant by C-steps of exactly h rows from many random starts."""
    rng, h, best = np.random.default_rng(0), -(-len(x) * 3 // 4), None
    for _ in range(starts):
        near = rng.choice(len(x), _P + 1, replace=False)
        for _ in range(50):
            m, c = x[near].mean(0), np.cov(x[near].T, bias=True) + 1e-9 * np.eye(_P)
            d = np.einsum("ij,jk,ik->i", x - m, np.linalg.inv(c), x - m)
            new = np.argsort(d, kind="stable")[:h]
            if set(new) == set(near):
                break
            near = new
        c = scale * np.cov(x[near].T, bias=True)
        if best is None or np.linalg.slogdet(c)[1] < best[0]:
            best = np.linalg.slogdet(c)[1], m, c
    return best


def test_estimate_as_direct_search(spark):
    rng = np.random.default_rng(6)
    mix = rng.normal(size=(_P, _P))
    x = np.vstack([rng.normal(size=(170, _P)) @ mix, rng.normal(size=(30, _P)) * 0.3 + 9])
    want = direct(x, 0.75, consistency(0.75))
    df = spark.createDataFrame([("g", i, r.tolist()) for i, r in enumerate(x)] + [("h", 1000 + i, r.tolist()) for i, r in enumerate(2 * x)], "_g string, _row long, x array<double>")
    got = {r["_g"]: r for r in minimum_covariance(df, least=(1e-6,) * _P).collect()}
    assert abs(got["g"]["logdet"] - want[0]) < 0.05
    assert abs(got["h"]["logdet"] - want[0] - 2 * _P * np.log(2)) < 0.05


def test_distances_of_normal_rows_are_chi_square(spark):
    x = np.random.default_rng(7).normal(size=(4000, _P)) * [1, 0.1, 2, 1, 1]
    df = spark.createDataFrame([("g", i, r.tolist()) for i, r in enumerate(x)], "_g string, _row long, x array<double>")
    (r,) = minimum_covariance(df).collect()
    c = x - np.array(r["mean"])
    d = np.einsum("ij,jk,ik->i", c, np.array(r["inv"]).reshape(_P, _P), c)
    assert abs(np.median(d) / chi2_quantile(_P, 0.5) - 1) < 0.06 and abs((d <= chi2_quantile(_P, 0.95)).mean() - 0.95) < 0.02


def test_small_languages_go_by_all_rows(spark):
    rng = random.Random(9)
    word = lambda: "".join(rng.choice("abcdefghijk") for _ in range(rng.randint(3, 8)))
    rows = [(i, " ".join(word() for _ in range(rng.randint(60, 300))), "en", "s") for i in range(200)]
    rows += [(1000, " ".join(word() for _ in range(100)), "xx", "s"), (1001, "||| " * 60 + " ".join(word() for _ in range(100)), "yy", None)]
    got = {r.doc_id: r for r in quality_rules(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")).collect()}
    assert got[1000].kept and got[1000].distance is not None and not got[1001].kept


def test_quantiles():
    assert abs(chi2_quantile(5, 0.975) - 12.8325) < 1e-3 and abs(chi2_quantile(5, 0.5) - 4.3515) < 1e-3


def test_empty_table(spark):
    assert quality_rules(spark.createDataFrame([], "doc_id long, text string, lang string, source string")).collect() == []
