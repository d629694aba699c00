"""Every operator and pipeline stage on empty tables, nulls in all columns, odd texts, repeated rows and columns of clashing names."""

import os

import public_tokenizers
import pytest
from pyspark.sql import functions as F

import corpus_pipeline as P
from spectraloom.llm import chat, fingerprints, html_text, minhash_dedup, mixing, packing, quality, substring_dedup, toxicity, url_filter

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
CLASH = ("_key", "_text", "_c0", "_row", "_id", "class_id", "kept_text", "score", "size", "target", "kept", "piece", "verdict", "part", "fingerprint", "_item", "anchor", "salt", "v")
LONG = " ".join(f"w{i % 977}x{i % 31}" for i in range(60_000))
ROWS = [
    (1, None, "en", "a", 0), (2, "", None, "a", None), (3, " \n\t ", "en", None, 4), (4, LONG, "en", "a", len(LONG)), (4, LONG, "en", "a", len(LONG)),
    (None, None, None, None, None), (None, "one", None, None, None), (5, "one", "fr", "b", 3), (6, "one", "fr", "b", 3), (7, "é漢\U0001f600 " * 40, "zh", "c", 160), (8, "x" * 50_000, "en", "a", 50_000),
]


def _docs(spark, rows):
    df = spark.createDataFrame(rows, DOCS)
    for c in CLASH:
        df = df.withColumn(c, F.lit(1))
    return df


def _labels(spark, rows=()):
    return spark.createDataFrame(list(rows), "doc_id long, quality int, toxic int")


OPERATORS = {
    "near_duplicate_classes": lambda s, d: minhash_dedup.near_duplicate_classes(d),
    "deduplicate": lambda s, d: minhash_dedup.deduplicate(d),
    "pack": lambda s, d: packing.pack(d, public_tokenizers.path("byte_bpe_50k.json")),
    "mixed_documents": lambda s, d: mixing.mixed_documents(d),
    "toxicity": lambda s, d: toxicity.score(d, toxicity.train(d, _labels(s, [(1, 0, 1), (None, 1, 1), (5, None, None), (8, 1, 0)]))),
    "remove_repeats": lambda s, d: substring_dedup.remove_repeats(d),
    "fingerprint": lambda s, d: fingerprints.fingerprint(d, fingerprints.rarity_ranks(d)),
    "quality_rules": lambda s, d: quality.quality_rules(d),
    "extract_text": lambda s, d: html_text.extract_text(d, "text"),
    "judge": lambda s, d: url_filter.judge(d, "text"),
    "rotate": lambda s, d: chat.rotate(d.withColumn("turn", F.col("n_chars")), conv="doc_id", role="lang"),
}
#: Rows out for the rows above, where that is a fixed number.
SAME = {"near_duplicate_classes", "toxicity", "remove_repeats", "fingerprint", "quality_rules", "extract_text", "judge"}


@pytest.mark.parametrize("name", sorted(OPERATORS))
def test_odd_rows(spark, name):
    out = OPERATORS[name](spark, _docs(spark, ROWS).coalesce(2)).collect()
    if name in SAME:
        assert len(out) == len(ROWS)
    if name == "near_duplicate_classes":
        ids = [(r.doc_id, r.class_id) for r in out]
        of = lambda *k: {c for i, c in ids if i in k}
        assert len(of(1, 2, 3)) == 1 and len(of(4)) == 1 and len(of(5, 6)) == 1 and not of(5) & of(1)
    if name == "deduplicate":
        assert sorted(r.doc_id for r in out) == [1, 4, 5, 7, 8]
    if name == "pack":
        assert sum(r.length for r in out if r.doc_id == 1) == 1 and len({(r.sequence_id, r.offset) for r in out}) == len(out)
    if name == "remove_repeats":
        assert sorted((r.n_words, r.n_removed) for r in out if r.doc_id == 4) == [(60_000, 60_000)] * 2
        assert {r.text for r in out if r.doc_id == 1} == {None} and {r.kept_text for r in out if r.doc_id in (1, 2, 3)} == {""}
    if name == "toxicity":
        assert all(0 <= r.score <= 1 for r in out)
    if name == "quality_rules":
        assert all(r.base_failed and not r.kept for r in out if r.doc_id in (1, 2, 3, 5))


@pytest.mark.parametrize("name", sorted(OPERATORS))
def test_empty_table(spark, name):
    assert OPERATORS[name](spark, _docs(spark, [])).collect() == []


def test_neighbours_of_ties_and_none(spark):
    df = _docs(spark, ROWS).select("doc_id", "text").coalesce(2)
    out = fingerprints.with_next(df).filter("_guest = 0").collect()
    assert len(out) == len(ROWS)
    assert fingerprints.with_next(df.limit(0)).collect() == []


@pytest.mark.parametrize("name,stage", P.STAGES)
def test_stages(spark, name, stage, tmp_path):
    os.makedirs(tmp_path / "t")
    for k, (docs, labels) in enumerate((([], []), (ROWS, [(4, 1, 0), (5, 0, 1), (None, None, None)]))):
        d = str(tmp_path / "t" / str(k))
        _labels(spark, labels).write.parquet(f"{d}/labels.parquet")
        _docs(spark, docs).write.parquet(f"{d}/documents.parquet")
        out = stage(spark, spark.read.parquet(f"{d}/documents.parquet"), d)
        if name != P.STAGES[-1][0]:
            assert out.columns == list(P.COLUMNS)
        assert (out.count() > 0) == (k == 1)
