"""Mixing sources to target weights by a low-discrepancy schedule of equal blocks of words.

The line [0, 1) is cut by the sources' cumulative targets. Slot i of the schedule takes the source in whose part the point
frac((i + 1/2) * golden ratio) lies; any stretch of slots holds each source in its share, but for a few slots. A source's
rank-th slot gets block number rank of its words: its documents, shuffled anew for each pass, laid end to end and cut every
``block`` words. So all passes but a source's last are whole. The mix is what the slots take: a source's slots times the block, its
last block partial where its target ends in it. Points are drawn until each source has the slots of its target; a source that is
full leaves its later slots out. Targets above ``cap`` times a source's size are cut there, the excess going to the others by
weight; so no document is taken more than ``cap`` times.

Ranks and places are counted in chunks (of slots, or of the shuffle's hash range), then summed over chunks: no source's rows meet in one task.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import common as C

WORD = r"[^\x20\x09-\x0D]+"
#: Half of frac(golden ratio), times 2**32, made odd: points are exact integers, the same everywhere.
_GOLDEN = 1327217885
_CHUNK = 512


def n_words(text: Column) -> Column:
    """Number of words: white space collapsed by the JVM's regular expressions, no array of words."""
    squeezed = F.regexp_replace(F.coalesce(text, F.lit("")), WORD, "x")
    return F.length(F.translate(squeezed, " \t\n\x0b\x0c\r", "")).cast("long")


def _weight(i: Column, weights: tuple) -> Column:
    return F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (i % len(weights) + 1).cast("int"))


def source_targets(sizes: DataFrame, weights: tuple, cap: float) -> DataFrame:
    """sizes (source, source_size) -> with weight and target: min(cap * size, level * weight), all targets together all sizes.

    Null sources are last. The level is found where the sources that reach their cap (in order of cap / weight) are whole."""
    order = Window.partitionBy(F.lit(0)).orderBy(F.col("source").isNull(), F.col("source").cast("binary"))
    w = sizes.withColumn("weight", _weight(F.row_number().over(order) - 1, weights)).withColumn("_full", F.col("source_size") * cap)
    run = Window.partitionBy(F.lit(0)).orderBy(F.col("_full") / F.col("weight"), F.col("source").isNull(), "source")
    everything = Window.partitionBy(F.lit(0))
    w = w.withColumn("_before", F.coalesce(F.sum("_full").over(run.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)))
    w = w.withColumn("_weights", F.sum("weight").over(run.rowsBetween(Window.currentRow, Window.unboundedFollowing)))
    w = w.withColumn("_all", F.sum("source_size").over(everything).cast("double"))
    # the level if all sources before this one are cut and this one isn't; the true one is the first not above its own cap
    w = w.withColumn("_level", (F.col("_all") - F.col("_before")) / F.col("_weights"))
    w = w.withColumn("_fits", F.col("_level") * F.col("weight") <= F.col("_full"))
    w = w.withColumn("_level", F.min_by(F.when(F.col("_fits"), F.col("_level")), F.when(F.col("_fits"), F.col("_full") / F.col("weight"))).over(everything))
    return w.select("source", "source_size", "weight", F.least(F.col("_full"), F.coalesce("_level", F.lit(math.inf)) * F.col("weight")).alias("target"))


def _running(df: DataFrame, keys: list[str], chunk: str, order: list, value: str, out: str) -> DataFrame:
    """df with out: sum of value over the rows of equal keys that come before. chunk rises with order, and holds few rows of a key."""
    inner = Window.partitionBy(*keys, chunk).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    sums = df.groupBy(*keys, chunk).agg(F.sum(value).alias("_sum"))
    outer = Window.partitionBy(*keys).orderBy(chunk).rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select(*keys, chunk, F.coalesce(F.sum("_sum").over(outer), F.lit(0)).alias("_base"))
    return df.withColumn("_own", F.coalesce(F.sum(value).over(inner), F.lit(0))).join(sums, [*keys, chunk]).withColumn(out, F.col("_own") + F.col("_base")).drop("_own", "_base")


def schedule_slots(spark, targets: DataFrame, total: int, n_slots: int, block: int, golden: int = _GOLDEN) -> DataFrame:
    """(s: struct of source, rank, slot) of the first n_slots points: those that a source's target has room for."""
    edge = Window.partitionBy(F.lit(0)).orderBy(F.col("source").isNull(), "source")
    lines = targets.select(F.struct("source").alias("s"), F.round("target").cast("long").alias("take"), F.sum("target").over(edge.rowsBetween(Window.unboundedPreceding, 0)).alias("high"))
    lines = lines.withColumn("low", F.coalesce(F.lag("high").over(Window.partitionBy(F.lit(0)).orderBy("high", "s")), F.lit(0.0))).filter("take > 0")
    part = max(1, min(n_slots // _CHUNK, 4 * C.shuffle_partitions(spark)))
    point = F.pmod((F.pmod("id", F.lit(1 << 31)) * 2 + 1) * F.lit(golden), F.lit(1 << 32)) / float(1 << 32) * float(total)
    # cells of the line, some for each source, so that a point meets the sources of its cell only
    cells = 1024 + 4 * targets.count()
    cell = lambda x: F.floor(x / float(max(total, 1)) * cells)
    lines = lines.select("s", "low", "high", "take", F.explode(F.sequence(cell(F.col("low")), cell(F.col("high")))).alias("_cell"))
    slots = spark.range(0, n_slots, 1, part).select(F.col("id").alias("slot"), F.floor(F.col("id") / _CHUNK).alias("_chunk"), point.alias("_p"), F.lit(1).alias("_one"))
    slots = slots.withColumn("_cell", cell(F.col("_p"))).join(lines, "_cell").filter((F.col("_p") >= F.col("low")) & (F.col("_p") < F.col("high"))).select("slot", "_chunk", "s", "_one", "take")
    return _running(slots, ["s"], "_chunk", ["slot"], "_one", "rank").filter(F.col("rank") * block < F.col("take")).select("s", "rank", "slot")


def mix(docs: DataFrame, text: str = "text", source: str = "source", key: str = "doc_id", weights: tuple = (1, 2, 3), cap: int = 3, block: int = 1024, seed: int = 7, row: str | None = None, golden: int = _GOLDEN) -> tuple[DataFrame, DataFrame]:
    """(schedule, documents).

    schedule: slot, source, pass, _key, start, end: in order of slot (and place), the words [start, end) of the document _key.
    documents: _key, size, source, source_size, target for each row of docs, _key being the column `row` of docs, or else the
    number that common.numbered gives.
    Null text has no words. Null is a source of its own. Empty documents and sources of no words are in no slot; if there are
    no words at all, the schedule is empty and targets are 0. Equal rows are documents of their own. The shuffle depends on
    `key` and text alone, not on how docs is split. A small corpus has smaller blocks: each source has 64 of them or more, if it
    has as many words. `golden`: half of the step between points, as 32 bits of a fraction, odd.
    """
    spark = docs.sparkSession
    if row is None:
        row = C.free_name(docs, "_key")[0]
        docs = C.numbered(docs, row)
    rows = docs.select(docs[row].alias("_key"), docs[source].alias("source"), n_words(docs[text]).alias("size"), F.xxhash64(docs[key].cast("string"), docs[text]).alias("_u"))
    rows = C.materialize(rows, "sizes")
    sizes = rows.groupBy("source").agg(F.sum("size").alias("source_size"))
    targets = C.materialize(source_targets(sizes, weights, cap), "targets")
    n_docs, total, least = rows.count(), *targets.agg(F.coalesce(F.sum("source_size"), F.lit(0)), F.min(F.when(F.round("target") > 0, F.col("target")))).first()
    block = max(1, min(block, int((least or 0) // 64)))
    # beyond the line's own number of slots, enough for four more of the smallest source; more, should one still lack some
    n_slots = spare = -(-int(total) // block)
    spare = math.ceil(min(4 * total / least, 4.0 * spare)) if total else 0
    lacks = F.round("target") > F.coalesce("n", F.lit(0)) * block
    while True:
        slots = C.materialize(schedule_slots(spark, targets, total, n_slots + spare, block, golden), "slots")
        taken = targets.join(slots.groupBy(F.col("s.source").alias("_s")).agg(F.count("*").alias("n")), F.col("source").eqNullSafe(F.col("_s")), "left")
        if not total or taken.filter(lacks).isEmpty():
            break
        spare *= 2
    wanted = taken.filter("n > 0").select(F.struct("source").alias("s"), "source_size", F.least(F.round("target").cast("long"), F.col("n") * block).alias("take"))
    wanted = C.materialize(wanted, "wanted")
    # documents as laid out in each pass
    chunks = max(1, n_docs // _CHUNK)
    passes = rows.filter("size > 0").select("_key", "_u", F.struct("source").alias("s"), "size").join(wanted, "s").select("*", F.explode(F.sequence(F.lit(0), F.floor((F.col("take") - 1) / F.col("source_size")).cast("int"))).alias("pass"))
    passes = passes.withColumn("_h", F.xxhash64("_u", "pass", F.lit(seed))).withColumn("_chunk", F.floor((F.col("_h") / 2.0**64 + 0.5) * chunks).cast("long"))
    # by all of these: a source's rows alone would meet in one task
    passes = passes.repartition("s", "pass", "_chunk")
    laid = _running(passes, ["s", "pass"], "_chunk", ["_h", "_key"], "size", "_at").withColumn("_at", F.col("_at") + F.col("pass") * F.col("source_size")).filter("_at < take")
    parts = laid.select("s", "pass", "_key", "size", "take", "_at", F.explode(F.sequence(F.floor(F.col("_at") / block), F.floor((F.least(F.col("_at") + F.col("size"), "take") - 1) / block))).alias("rank"))
    lo = F.greatest(F.col("rank") * block, "_at")
    parts = parts.select("s", "rank", "pass", "_key", (lo - F.col("_at")).alias("start"), (F.least((F.col("rank") + 1) * block, F.col("_at") + F.col("size"), "take") - F.col("_at")).alias("end"))
    schedule = parts.join(slots, ["s", "rank"])
    documents = rows.join(targets.select(F.struct("source").alias("s"), "source_size", "target"), F.struct("source") == F.col("s")).select("_key", "size", "source", "source_size", "target")
    return schedule.select("slot", F.col("s.source").alias("source"), "pass", "_key", "start", "end"), documents


def mixed_documents(docs: DataFrame, text: str = "text", length: str = "n_chars", **kw) -> DataFrame:
    """The mix as documents, in the schedule's order: the columns of docs, one row for each document and pass with words in it, at its first slot.

    A document taken whole keeps its text; of one that the schedule ends in, the words taken are joined by one space, and
    `length` (if there is such a column) is set anew. Documents without words are in no mix."""
    at, cols = C.free_name(docs, "_key")[0], docs.columns
    docs = C.numbered(docs, at)
    schedule, sizes = mix(docs, text=text, row=at, **kw)
    part = schedule.groupBy("_key", "pass").agg(F.min("start").alias("_start"), F.max("end").alias("_end"), F.min("slot").alias("_slot"))
    part = part.join(sizes.select("_key", "size"), "_key")
    rows = docs.select(docs[at].alias("_key"), *[docs[c].alias(f"_c{i}") for i, c in enumerate(cols)]).join(part, "_key").orderBy("_slot", "_key")
    t = F.col(f"_c{cols.index(text)}")
    cut = (F.col("_start") > 0) | (F.col("_end") < F.col("size"))
    words = F.array_join(F.slice(F.regexp_extract_all(t, F.lit(f"({WORD})"), 1), (F.col("_start") + 1).cast("int"), (F.col("_end") - F.col("_start")).cast("int")), " ")
    rows = rows.withColumn("_t", F.when(cut, words).otherwise(t))
    out = {c: F.col(f"_c{i}") for i, c in enumerate(cols)}
    out[text] = F.col("_t")
    if length in out:
        out[length] = F.when(cut, F.length("_t").cast("long")).otherwise(out[length])
    return rows.select(*[v.alias(c) for c, v in out.items()])


def op4_mixing(spark, sf_dir: str) -> DataFrame:
    """One row per document; slot is the first of the schedule that takes words of it, null if none does."""
    docs = C.numbered(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "source"), "_key")
    schedule, sizes = mix(docs, row="_key")
    taken = schedule.groupBy("_key").agg(F.sum(F.col("end") - F.col("start")).alias("taken"), F.min("slot").alias("slot"))
    out = sizes.join(docs.select("_key", "doc_id"), "_key").join(taken, "_key", "left")
    return out.select("doc_id", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken"), "slot")
