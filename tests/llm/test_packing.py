import random
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from spectraloom.llm.packing import Packing, cross, evolve, pack
from spectraloom.llm.tokens import byte_bpe

VOCABULARY = public_tokenizers.path("byte_bpe_50k.json")


def test_ids_as_the_tokenizer():
    t = Tokenizer.from_file(VOCABULARY)
    b, rng = byte_bpe(VOCABULARY), random.Random(1)
    for s in ("a <|endoftext|> b", "<|endoftext|>", "x<|endoftext|><|endoftext|>  y ", "<|endoftext|"):
        assert np.frombuffer(b.encode(s), "<u4").tolist() == t.encode(s, add_special_tokens=False).ids, s
    assert 50256 in np.frombuffer(b.encode("a <|endoftext|> b"), "<u4") and 50256 not in np.frombuffer(byte_bpe(VOCABULARY, True).encode("a <|endoftext|> b"), "<u4")
    some = ["<|endoftext|>", *"ab c  \n\t\r  \x1c\x85éß1२'s'll<|endoftext|>!?—日本\U0001F600́"]
    for _ in range(500):
        s = "".join(rng.choice(some) for _ in range(rng.randint(0, 30)))
        assert np.frombuffer(b.encode(s), "<u4").tolist() == t.encode(s, add_special_tokens=False).ids, repr(s)
    for s in (" " * 300_000, " \n" * 40_000 + "x" + "\t" * 70_000 + " y", "ab " * 9000 + "\u3000" * 5000, "z" * 50_000):
        assert np.frombuffer(b.encode(s), "<u4").tolist() == t.encode(s, add_special_tokens=False).ids, len(s)
    assert len(b.encode(" " * 2_000_000)) > 0


def test_islands_reach_the_bound():
    rng = np.random.default_rng(4)
    lengths = rng.integers(1, 400, 900)
    labels = evolve(lengths, 1024, [], 1, 3, 10)
    fill = np.bincount(labels, lengths)
    assert fill.max() <= 1024 and len(fill) <= -(-lengths.sum() // 1024) + 1


@pytest.mark.parametrize("seed", range(3))
def test_search_beats_best_fit(seed):
    lengths = np.random.default_rng(seed).integers(200, 600, 1500)
    plain = Packing(lengths.tolist(), 1024).best_fit(np.argsort(-lengths, kind="stable").tolist())
    elites = []
    for epoch in range(2):
        elites = [evolve(lengths, 1024, elites[-1:], 10 * seed + epoch, 4, 24)]
    fill_ = np.bincount(elites[0], lengths)
    assert fill_.max() <= 1024 and fill_.sum() == lengths.sum() and len(fill_) < len(plain.bins)


def test_crossover_keeps_well_filled_bins_whole():
    rng = np.random.default_rng(5)
    lengths = rng.integers(100, 700, 200).tolist()
    a, b = (Packing(lengths, 1024).best_fit(rng.permutation(200).tolist()) for _ in range(2))
    child = cross(a, b, rng)
    assert sorted(i for x in child.bins for i in x) == list(range(200)) and all(sum(lengths[i] for i in x) == 1024 - left for x, left in zip(child.bins, child.left))
    good = {frozenset(x) for x, left in zip(b.bins, b.left) if left <= np.quantile(b.left, 0.5)}
    assert {frozenset(x) for x in child.bins} & good


def test_pack(spark):
    rng = random.Random(2)
    texts = [None, "", "x", "x", "word " * 3000] + [" ".join(str(rng.randint(0, 10**5)) for _ in range(rng.choice([1, 5, 50, 300, 900]))) for _ in range(200)]
    rows = [(None if i == 7 else i % 190, t, "clash") for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "doc_id long, text string, length string")
    for kw in ({}, {"shard_items": 50}):
        got = pack(df, VOCABULARY, with_ids=True, **kw).collect()
        t = Tokenizer.from_file(VOCABULARY)
        want = defaultdict(list)
        for i, x, _ in rows:
            ids = [*t.encode(x or "", add_special_tokens=False).ids, 2]
            first = (len(ids) - 1) % 1024 + 1
            cut = [0, *range(first, len(ids) + 1, 1024)]
            for k, (a, b) in enumerate(zip(cut, cut[1:])):
                want[i].append((k, a, b - a, zlib.crc32(np.array(ids[a:b], "<u4").tobytes()), ids[a:b]))
        have = defaultdict(list)
        seq = defaultdict(list)
        for r in got:
            have[r.doc_id].append((r.piece, r.start, r.length, r.ids_crc32, r.ids))
            seq[r.sequence_id].append((r.offset, r.length))
        assert {k: sorted(v) for k, v in have.items()} == {k: sorted(v) for k, v in want.items()}
        for s in seq.values():
            at = 0
            for o, n in sorted(s):
                assert o == at
                at += n
            assert at <= 1024
        total = sum(r.length for r in got)
        large = sum(r.length > 512 for r in got)
        assert len(seq) <= 1.03 * max(total / 1024, large) + 2


def test_empty_table(spark):
    assert pack(spark.createDataFrame([], "doc_id long, text string"), VOCABULARY).collect() == []
