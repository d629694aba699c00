import os
from collections import Counter

import pytest

import corpus_pipeline as P

DATA = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no tables")
def test_each_stage_on_its_input(spark, tmp_path):
    from spectraloom.llm.mixing import n_words
    from tests.llm.test_minhash_dedup import bag_of, jaccard
    from tests.llm.test_substring_dedup import brute

    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    seen = {}
    for name, stage in P.STAGES:
        out = stage(spark, docs, DATA)
        if name != P.STAGES[-1][0]:
            assert out.columns == list(P.COLUMNS)
        out.write.parquet(path := str(tmp_path / name))
        before, docs = docs, spark.read.parquet(path)
        seen[name] = (before, docs)
    ids = lambda df: Counter(r.doc_id for r in df.select("doc_id").collect())
    before, after = seen["near_duplicates"]
    texts = {r.doc_id: r.text for r in before.collect()}
    kept = ids(after)
    bags = {i: bag_of(t) for i, t in texts.items()}
    order = sorted(kept)
    assert not any(jaccard(bags[i], bags[j]) >= 0.8 for i in order for j in order if i < j)
    for i in texts.keys() - kept.keys():
        assert any(jaccard(bags[i], bags[j]) >= 0.8 for j in texts if j != i)
    before, after = seen["repeated_passages"]
    rows = before.collect()
    got = {r.doc_id: r for r in after.collect()}
    for r, (n, gone, text) in zip(rows, brute([r.text for r in rows], 35)):
        assert got[r.doc_id].text == (text if gone else r.text) and got[r.doc_id].n_chars == len(got[r.doc_id].text or "")
    before, after = seen["mix_sources"]
    words = lambda df: df.agg({"n": "sum"}).first()[0]
    a, b = (words(df.select(n_words(df.text).alias("n"))) for df in (before, after))
    assert abs(a - b) <= 20
    before, after = seen["pack_sequences"]
    pieces = after.collect()
    assert Counter(r.doc_id for r in pieces if r.piece == 0) == ids(before)
    assert max(Counter((r.sequence_id, r.offset) for r in pieces).values()) == 1


def test_labels_and_entry():
    import __spark_entry__ as e

    assert [n for n, _ in P.STAGES] == ["toxicity", "near_duplicates", "repeated_passages", "mix_sources", "pack_sequences"]
    assert {f"op{n}_" for n in range(1, 11)} <= {x.split("_")[0] + "_" for x in e.queries()} and "pipeline" in e.queries()
