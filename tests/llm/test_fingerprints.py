import hashlib
import math
import random
from collections import Counter

import numpy as np

from spectraloom.llm import fingerprints as P


def texts_of(n=40):
    rng = random.Random(1)
    out = [b"", b"x", b"a" * 63, b"a" * 64, b"ab" * 40]
    for _ in range(n):
        out.append("".join(rng.choice("abcdefgh é\n") for _ in range(rng.randint(0, 900))).encode())
    return out


def test_levels_as_brute_force():
    texts = texts_of()
    _, start, size, level, valid = P.levels(texts)
    for t, a, n in zip(texts, start.tolist(), size.tolist()):
        m = max(0, n - 63)
        assert valid[a : a + m].all() and not valid[a + m : a + n].any()
        for i in range(0, m, 7):
            h = -sum(c / 64 * math.log2(c / 64) for c in Counter(t[i : i + 64]).values())
            assert abs(level[a + i] - h / 6 * 1000) <= 1.01


def test_features_as_brute_force():
    rng, texts = np.random.default_rng(1), texts_of(25)
    rank = rng.permutation(1001)
    doc, h = P.features(texts, rank)
    _, start, size, level, _ = P.levels(texts)
    for d, t in enumerate(texts):
        m = max(0, len(t) - 63)
        r = rank[level[start[d] : start[d] + m]]
        points = Counter(int(s + np.argmin(r[s : s + 64])) for s in range(max(m - 63, 1))) if m else {}
        least = min(16, max(m - 63, 1))
        want = {t[i : i + 64] for i, n in points.items() if n >= least} if m else {t} - {b""}
        assert len(want) == (doc == d).sum()


def test_likeness():
    rng = random.Random(2)
    word = lambda: "".join(rng.choice("abcdefghijklmnop") for _ in range(6))
    a, b = (" ".join(word() for _ in range(n)) for n in (3000, 2500))
    rank = np.arange(1001)
    fa, fb, fe, none = P.filters([a.encode(), b.encode(), P.edited(a, b).encode(), b""], rank)
    assert P.likeness(fa, fa) == 1 and P.likeness(none, none) == 1 and P.likeness(fa, none) == 0
    assert 0.5 < P.likeness(fa, fe) < 0.9 and P.likeness(fa, fb) < 0.15 and P.likeness(fa, fb) == P.likeness(fb, fa)


def test_query_rows(spark, tmp_path):
    rng = random.Random(3)
    texts = [None, "", "é" * 10, "x" * 200000] + ["".join(rng.choice("abcd é\n") for _ in range(rng.randint(0, 700))) for _ in range(60)]
    rows = [(i * 7 - 100 if i != 9 else None, t, "en") for i, t in enumerate(texts)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(5).write.parquet(str(tmp_path / "documents.parquet"))
    got = {r.doc_id: r for r in P.op8_fingerprints(spark, str(tmp_path)).collect()}
    order = sorted(rows, key=lambda r: (r[0] is None, -(r[0] or 0)))
    assert len(got) == len(rows)
    for r, nxt in zip(order, order[1:] + order[:1]):
        t, n = r[1] or "", nxt[1] or ""
        g = got[r[0]]
        assert g.n_chars == len(t) and g.edited_sha256 == hashlib.sha256(P.edited(t, n).encode()).hexdigest()
        if t:
            assert g.near_edited >= g.near_next or len(t) < 400


def test_ties_and_empty(spark, tmp_path):
    docs = spark.createDataFrame([(1, "a"), (1, "a"), (1, "b"), (0, "a")], "doc_id long, text string")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    got = sorted((r.doc_id, r.fingerprint) for r in P.op8_fingerprints(spark, str(tmp_path)).collect())
    assert len(got) == 4 and len({f for _, f in got}) == 2
    none = spark.createDataFrame([], "doc_id long, text string, Fingerprint int")
    assert P.fingerprint(none, P.rarity_ranks(none)).collect() == []
    docs.limit(0).write.parquet(str(tmp_path / "none" / "documents.parquet"))
    assert P.op8_fingerprints(spark, str(tmp_path / "none")).collect() == []
    docs.limit(1).write.parquet(str(tmp_path / "one" / "documents.parquet"))
    assert [r.near_next for r in P.op8_fingerprints(spark, str(tmp_path / "one")).collect()] == [1.0]
