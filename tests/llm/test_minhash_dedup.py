import random
from collections import Counter

import numpy as np
import pyarrow as pa

from spectraloom.llm import common as C
from spectraloom.llm.components import components, joined
from spectraloom.llm.minhash_dedup import bag, bag_signatures, deduplicate, near_duplicate_classes, shingles


def bag_of(t, k=5):
    w = (t or "").encode().split()
    return Counter(tuple(w[i : i + k]) for i in range(len(w) - k + 1)) if len(w) >= k else Counter([tuple(w)] if w else [])


def jaccard(a, b):
    both = sum((a & b).values())
    total = sum(a.values()) + sum(b.values()) - both
    return both / total if total else 1.0


def test_signature_is_unbiased():
    rng = random.Random(1)
    base = [rng.choice("abcdefgh") for _ in range(80)]
    other = base[:60] + [rng.choice("abcdefgh") for _ in range(40)] + base[:30]
    texts = [" ".join(base), " ".join(other)]
    raw, offs = C.buffers(pa.array(texts))
    d, g, w = bag(*shingles(raw, offs, 1)[:2])
    assert w.max() > 8
    est = []
    for salt in range(30):
        s = bag_signatures(d, C.mix(g + np.uint64(salt)), w, 2, 128) & np.uint64(0xFFFFFFFF)
        est.append((s[0] == s[1]).mean())
    want = jaccard(bag_of(texts[0], 1), bag_of(texts[1], 1))
    assert abs(np.mean(est) - want) < 0.025, (np.mean(est), want)


def corpus():
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(4))
    texts = [None, "", "a b", "a  b", "a b c", "x x x x x x x x x", "x x x x x x x x"]
    for _ in range(25):
        base = [word() for _ in range(rng.randint(30, 90))]
        texts.append(" ".join(base))
        for _ in range(rng.randint(0, 6)):
            w = list(base)
            for _ in range(rng.randint(0, 5)):
                w[rng.randrange(len(w))] = word()
            texts.append(" ".join(w))
    # a group whose members are alike to its middle only, and some of them just not
    base = [word() for _ in range(120)]
    texts.append(" ".join(base))
    for n in range(40):
        w = list(base)
        for i in rng.sample(range(0, 120, 5), 1 + n % 5):
            w[i] = word()
        texts.append(" ".join(w))
        if n % 8 == 7:  # shares what its fellow has beyond the middle
            w[1] = word()
            texts.append(" ".join(w))
    return texts + [texts[8]] * 3


def test_classes_as_brute_force(spark):
    texts = corpus()
    bags = [bag_of(t) for t in texts]
    root = list(range(len(texts)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(texts)):
        for j in range(i):
            if jaccard(bags[i], bags[j]) >= 0.8:
                root[find(i)] = find(j)
    df = spark.createDataFrame([(i, t, 1) for i, t in enumerate(texts)], "doc_id long, text string, Class_id int").coalesce(2)
    got = {r.doc_id: r.class_id for r in near_duplicate_classes(df).collect()}
    want = [find(i) for i in range(len(texts))]
    assert len(got) == len(texts)
    same = lambda f: {(i, j) for i in range(len(texts)) for j in range(i) if f(i) == f(j)}
    assert same(got.get) == same(want.__getitem__)
    kept = {r.doc_id for r in deduplicate(df).collect()}
    assert kept == {min(i for i in range(len(texts)) if want[i] == c) for c in set(want)}


def test_group_just_below_the_threshold(spark, monkeypatch):
    """Texts around one middle, alike to it and not to each other, and pairs that share what they have beyond it."""
    rng = random.Random(8)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(5))
    base = [word() for _ in range(100)]
    texts = []
    for n in range(240):
        w = base[:40] + [word() for _ in range(60)] if n % 2 else list(base)
        for i in rng.sample(range(40), 2):
            w[i] = word()
        if n % 2 == 0:
            w[60 + n % 30 : 76 + n % 30] = [word() for _ in range(16)]
        texts.append(" ".join(w))
        if n % 40 == 39:  # alike to this one alone
            w[0] = word()
            texts.append(" ".join(w))
    bags = [bag_of(t) for t in texts]
    edges = [(i, j) for i in range(len(texts)) for j in range(i) if jaccard(bags[i], bags[j]) >= 0.8]
    rows, write = {}, C.materialize

    def counted(df, tag):
        out = write(df, tag)
        rows[tag] = rows.get(tag, 0) + out.count()
        return out

    monkeypatch.setattr(C, "materialize", counted)
    got = {r.doc_id: r.class_id for r in near_duplicate_classes(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    root = {i: i for i in range(len(texts))}
    for _ in range(10):
        for i, j in edges:
            root[i] = root[j] = min(root[i], root[j])
    same = lambda f: {(i, j) for i in range(len(texts)) for j in range(i) if f(i) == f(j)}
    assert len(edges) >= 6 and same(got.get) == same(root.get)
    assert rows["verified"] < len(texts) ** 2 / 8


def test_tables_on_the_way_are_deleted(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(C, "shared_dir", lambda s: str(tmp_path))
    df = spark.createDataFrame([(1, "a b c d e f"), (2, "a b c d e f"), (3, None)], "doc_id long, text string")
    found = C.kept(spark, lambda: near_duplicate_classes(df), "result")
    assert [p.name.split("-")[0] for p in tmp_path.iterdir()] == ["result"]
    assert len({r.class_id for r in found.collect()}) == 2


def test_empty_table(spark):
    assert near_duplicate_classes(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_components(spark):
    rng = random.Random(2)
    edges = [(i, i + 1) for i in range(20)] + [(100 + rng.randrange(30), 100 + rng.randrange(30)) for _ in range(20)] + [(7, 7)]
    root = {x: x for e in edges for x in e}
    for _ in range(60):
        for u, v in edges:
            root[u] = root[v] = min(root[u], root[v])
    got = {r.u: r.v for r in components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {k: v for k, v in root.items() if k != v}


def test_components_joined(spark):
    rng = random.Random(6)
    some = lambda: [(rng.randrange(60), rng.randrange(60)) for _ in range(12)]
    parts = [some(), [], some(), some()]
    df = lambda e: spark.createDataFrame(e, "u long, v long")
    known = components(df(parts[0]))
    for p in parts[1:]:
        known = joined(known, df(p))
    want = components(df([e for p in parts for e in p]))
    assert {tuple(r) for r in known.collect()} == {tuple(r) for r in want.collect()}
