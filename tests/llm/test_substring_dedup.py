import random
from collections import Counter

import numpy as np

from spectraloom.llm.substring_dedup import SuffixTree, remove_repeats, repeated_passages


def brute(texts, window):
    words = [(t or "").encode().split() for t in texts]
    seen = Counter(tuple(w[i : i + window]) for w in words for i in range(len(w) - window + 1))
    out = []
    for w in words:
        gone = set()
        for i in range(len(w) - window + 1):
            if seen[tuple(w[i : i + window])] > 1:
                gone.update(range(i, i + window))
        out.append((len(w), len(gone), b" ".join(x for i, x in enumerate(w) if i not in gone).decode()))
    return out


def test_as_brute_force(spark):
    rng = random.Random(3)
    shared = [[rng.choice("abcdefg") + str(rng.randint(0, 9)) for _ in range(rng.randint(10, 40))] for _ in range(6)]
    texts = [None, "", " \n\t", "é x"]
    for _ in range(120):
        w = []
        for _ in range(rng.randint(0, 4)):
            w += rng.choice(shared) if rng.random() < 0.5 else [str(rng.randint(0, 10**6)) for _ in range(rng.randint(0, 15))]
            if rng.random() < 0.2:
                w += ["For"] * rng.randint(1, 40)
        texts.append(rng.choice([" ", "\n", " \t "]).join(w))
    texts += [texts[10]] * 9
    rows = [(i % 100, t, "x", 7) for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "doc_id long, text string, N_words string, _key int").coalesce(1)
    for kw in ({"window": 12, "anchor": 4}, {"window": 12, "anchor": 4, "group_rows": 3}, {"window": 35}):
        got = remove_repeats(df, **kw)
        assert got.columns == ["doc_id", "text", "_key", "n_words", "n_removed", "kept_text"]
        key = lambda r: tuple(map(str, r))
        want = sorted([(i % 100, *b) for i, b in enumerate(brute(texts, kw["window"]))], key=key)
        assert sorted([(r.doc_id, r.n_words, r.n_removed, r.kept_text) for r in got.collect()], key=key) == want


def test_suffix_tree_as_brute_force():
    rng = np.random.default_rng(3)
    for _ in range(60):
        texts = [rng.integers(0, 3, rng.integers(3, 30)) for _ in range(6)]
        words, ends = np.concatenate(texts), np.cumsum([len(t) for t in texts])
        text = np.repeat(np.arange(6), [len(t) for t in texts])
        group = text % 2
        tree = SuffixTree(words, ends, text, np.arange(len(words)), group, 64)
        suffix = [tuple(words[i : ends[text[i]]]) for i in range(len(words))]
        common = lambda a, b: next((k for k, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))
        for a, b, d in zip(tree.order, tree.order[1:], tree.depth[1:]):
            assert d == (common(suffix[a], suffix[b]) if group[a] == group[b] else 0)
        node = tree.nodes_at(4)
        for i in range(len(words)):
            for j in range(i):
                assert (node[i] == node[j]) == (group[i] == group[j] and common(suffix[i], suffix[j]) >= 4)
        # internal nodes: each right-maximal repeat of two words or more with all places at which it starts
        want = {}
        for g in (0, 1):
            own = [i for i in range(len(words)) if group[i] == g]
            for i in own:
                for j in own:
                    if i < j and (k := common(suffix[i], suffix[j])) >= 2:
                        want[g, suffix[i][:k]] = frozenset(x for x in own if suffix[x][:k] == suffix[i][:k])
        got = {(int(group[tree.order[a]]), suffix[tree.order[a]][:d]): frozenset(tree.order[a : b + 1].tolist()) for a, b, d in tree.internal_nodes(2)}
        assert got == want


def test_passages_as_brute_force(spark):
    rng = random.Random(4)
    shared = [[rng.choice("abcdefg") + str(rng.randint(0, 9)) for _ in range(rng.randint(10, 40))] for _ in range(4)]
    texts = [None, "a"] + [" ".join(sum((rng.choice(shared) if rng.random() < 0.5 else [str(rng.randint(0, 10**6))] * rng.randint(0, 15) for _ in range(3)), [])) for _ in range(60)]
    words = [(t or "").split() for t in texts]
    seen = Counter(tuple(w[i : i + 12]) for w in words for i in range(len(w) - 11))
    df = spark.createDataFrame([(i, t, 1) for i, t in enumerate(texts)], "doc_id long, text string, Repeats int").coalesce(2)
    got = {r.doc_id: r.repeats for r in repeated_passages(df, window=12, anchor=4, group_rows=5).collect()}
    for i, w in enumerate(words):
        twice = [k for k in range(len(w) - 11) if seen[tuple(w[k : k + 12])] > 1]
        heads = [k for k in twice if k - 1 not in twice]
        want = [(k, next(n for n in range(k, len(w)) if n not in twice) - k + 11) for k in heads]
        assert [(r.start, r.length) for r in got[i] or []] == want, (i, got[i], want)


def test_empty_table(spark):
    assert remove_repeats(spark.createDataFrame([], "doc_id long, text string")).collect() == []
