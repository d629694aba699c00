"""Rows keep their numbers where files are split in another way from one scan to the next."""

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from spectraloom.llm import common as C
from spectraloom.llm.minhash_dedup import deduplicate, op2_minhash_dedup
from spectraloom.llm.mixing import mixed_documents, op4_mixing
from spectraloom.llm.substring_dedup import op6_substring_dedup

SPLIT = "spark.sql.files.maxPartitionBytes"


def texts():
    rng = random.Random(8)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(5))
    out = [" ".join(word() for _ in range(rng.randint(50, 120))) for _ in range(300)]
    return out + [t + f" {word()}" for t in out[::3]]


@pytest.fixture
def tables(spark, tmp_path, monkeypatch):
    """A folder with documents in one file of many row groups; each intermediate table that is written changes how files are split."""
    rows = [(i, t, "en", "ab"[i % 2], len(t)) for i, t in enumerate(texts())]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").coalesce(1)
    df.write.option("parquet.block.size", 4096).option("parquet.page.size.row.check.min", 5).option("parquet.block.size.row.check.min", 5).parquet(f"{tmp_path}/documents.parquet")
    before, n, write = spark.conf.get(SPLIT), iter(range(1 << 20)), C.materialize

    def other_split(df, tag):
        out = write(df, tag)
        spark.conf.set(SPLIT, ("7k", "64m", "19k")[next(n) % 3])
        return out

    monkeypatch.setattr(C, "materialize", other_split)
    spark.conf.set(SPLIT, "64m")
    yield str(tmp_path), rows
    spark.conf.set(SPLIT, before)


def test_operators(spark, tables):
    d, rows = tables
    spark.conf.set(SPLIT, "7k")
    assert spark.read.parquet(f"{d}/documents.parquet").rdd.getNumPartitions() > 3
    spark.conf.set(SPLIT, "64m")
    near = {300 + k: i for k, i in enumerate(range(0, 300, 3))}
    got = op2_minhash_dedup(spark, d).collect()
    assert sorted((r.doc_id, r.class_id) for r in got) == [(i, near.get(i, i)) for i in range(400)]
    got = op4_mixing(spark, d).collect()
    assert sorted((r.doc_id, r.size) for r in got) == [(r[0], len(r[1].split())) for r in rows]
    got = {r.doc_id: (r.n_words, r.n_removed) for r in op6_substring_dedup(spark, d).collect()}
    both = set(near) | set(near.values())
    assert got == {r[0]: (n := len(r[1].split()), (n - (r[0] in near)) * (r[0] in both)) for r in rows}


def test_stages(spark, tables):
    d, rows = tables
    docs = lambda: spark.read.parquet(f"{d}/documents.parquet")
    assert sorted(tuple(r) for r in deduplicate(docs()).collect()) == rows[:300]
    # all words of the mix, each text a run of its own document's words
    mixed = mixed_documents(docs()).collect()
    assert abs(sum(len(r.text.split()) for r in mixed) - sum(len(r[1].split()) for r in rows)) <= 1
    assert all(r.source == rows[r.doc_id][3] and " ".join(r.text.split()) in " ".join(rows[r.doc_id][1].split()) for r in mixed)


def test_numbered(spark, tables):
    d, rows = tables
    for p in (f"{d}/documents.parquet", f"{d}/a b=é"):
        df = spark.read.parquet(p).filter("doc_id > 3") if p.endswith("parquet") else None
        if df is None:
            spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(7).write.parquet(p)
            df = spark.read.parquet(p).select("doc_id", F.upper("lang").alias("l"))
        first = dict(C.numbered(df, "n").select("n", "doc_id").collect())
        spark.conf.set(SPLIT, "7k")
        assert len(first) == df.count() and dict(C.numbered(df, "n").select("n", "doc_id").collect()) == first
    # not rows of files: written once
    df = spark.read.parquet(f"{d}/documents.parquet")
    for other in (df.union(df), df.select("doc_id", F.explode(F.array(F.lit(1), F.lit(2)))), df.withColumn("x", F.rand()), df.select("doc_id", F.lit(None).alias("none"))):
        out = C.numbered(other, "n")
        assert out.columns == [*other.columns, "n"] and Counter(out.collect()) == Counter(out.collect())
        assert out.select("n").distinct().count() == other.count()
