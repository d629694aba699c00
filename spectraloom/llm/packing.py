"""Packing of tokenised documents into sequences of fixed capacity by a grouping genetic algorithm on islands.

Only documents longer than the capacity are cut; their full pieces fill a sequence each. All other pieces are dealt by a
hash to shards of about ``shard_items``, enough for a good packing and few enough for a task. A shard evolves on several
islands, each a population of packings of the shard's pieces. A packing is a list of bins (groups). Crossover injects the
well-filled bins of one parent whole into the other, removes the bins there that hold a piece twice, and best-fits the
displaced pieces. Mutation opens the worst bins and some others and fills them anew, each by the sum of lengths that leaves least.
After an epoch each island's elite migrates to the next island of its ring. An island stops at the bound that the tokens alone
set; so easy shards cost one best fit, and hard ones up to ``generations`` on each island in each epoch. The best packing of a
shard stands. Its poorly filled bins are opened and what was in them meets those of other shards in further rounds of shards, until
one shard holds all that is open or a round leaves over half of it open.
"""

from __future__ import annotations

import math
import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as C
from .tokens import byte_bpe

# ---------------------------------------------------------------- one shard


class Packing:
    """Bins as lists of items, with what is left in each; `free` has a bit for each amount that some bin has left."""

    def __init__(self, lengths: list[int], capacity: int):
        self.lengths, self.capacity = lengths, capacity
        self.bins: list[list[int]] = []
        self.left: list[int] = []
        self.by_left: list[list[int]] = [[] for _ in range(capacity + 1)]
        self.free = 0

    def add(self, items: list[int], left: int | None = None) -> None:
        if left is None:
            left = self.capacity - sum(self.lengths[i] for i in items)
        self.by_left[left].append(len(self.bins))
        self.free |= 1 << left
        self.bins.append(items)
        self.left.append(left)

    def best_fit(self, items: list[int]) -> "Packing":
        """Each into the fullest bin that still takes it."""
        lengths, by_left, bins, lefts = self.lengths, self.by_left, self.bins, self.left
        for i in items:
            n = lengths[i]
            fit = self.free >> n
            if fit:
                left = n + (fit & -fit).bit_length() - 1
                same = by_left[left]
                b = same.pop()
                if not same:
                    self.free &= ~(1 << left)
                bins[b].append(i)
                left -= n
                lefts[b] = left
                by_left[left].append(b)
                self.free |= 1 << left
            else:
                self.add([i], self.capacity - n)
        return self

    def fitness(self) -> tuple[int, float]:
        """Fewer bins first, then uneven filling, which leaves room in one piece."""
        c = self.capacity
        return -len(self.bins), sum(((c - x) / c) ** 2 for x in self.left)

    def labels(self) -> np.ndarray:
        out = np.empty(len(self.lengths), np.int32)
        for b, items in enumerate(self.bins):
            out[items] = b
        return out

    @classmethod
    def of(cls, labels: np.ndarray, lengths: list[int], capacity: int) -> "Packing":
        out = cls(lengths, capacity)
        bins: dict[int, list[int]] = {}
        for i, b in enumerate(labels.tolist()):
            bins.setdefault(b, []).append(i)
        for items in bins.values():
            out.add(items)
        return out


def cross(a: Packing, b: Packing, rng: np.random.Generator) -> Packing:
    """a with well-filled bins of b."""
    left = np.array(b.left)
    good = np.flatnonzero(left <= np.quantile(left, 0.5))
    lo, hi = sorted(rng.integers(0, len(good) + 1, 2).tolist())
    chosen = good[lo : max(hi, lo + 1)].tolist()
    inside = bytearray(len(a.lengths))
    child = Packing(a.lengths, a.capacity)
    for k in chosen:
        for i in b.bins[k]:
            inside[i] = 1
        child.add(list(b.bins[k]), b.left[k])
    displaced: list[int] = []
    for items, room in zip(a.bins, a.left):
        if any(inside[i] for i in items):
            displaced += [i for i in items if not inside[i]]
        else:
            child.add(list(items), room)
    displaced.sort(key=a.lengths.__getitem__, reverse=True)
    return child.best_fit(displaced)


def fill(a: Packing, items: list[int]) -> Packing:
    """items in bins of their own: each takes the longest that is left and those others whose lengths add up to the most that fits."""
    lengths, rest = a.lengths, sorted(items, key=a.lengths.__getitem__, reverse=True)
    while rest:
        first = rest.pop(0)
        room = a.capacity - lengths[first]
        full, mask = 1 << room, (2 << room) - 1
        sums, now = [1], 1  # bit n: some of the first k items are n long together
        for i in rest:
            now |= (now << lengths[i]) & mask
            sums.append(now)
            if now & full:
                break
        k, left = len(sums) - 1, now.bit_length() - 1
        bin_, free = [first], room - left
        while left:
            while sums[k - 1] >> left & 1:
                k -= 1
            k -= 1
            bin_.append(rest.pop(k))
            left -= lengths[bin_[-1]]
        a.add(bin_, free)
    return a


def mutate(a: Packing, rng: np.random.Generator) -> Packing:
    """Open the worst bins and some others, and fill anew what was in them."""
    n = len(a.bins)
    some = max(2, n // 40)
    open_ = set(np.argsort(-np.array(a.left), kind="stable")[:some].tolist()) | set(rng.integers(0, n, some).tolist())
    child, out = Packing(a.lengths, a.capacity), []
    for k, items in enumerate(a.bins):
        if k in open_:
            out += items
        else:
            child.add(list(items), a.left[k])
    return fill(child, out)


def evolve(lengths: np.ndarray, capacity: int, elites: list[np.ndarray], seed: int, population: int, generations: int) -> np.ndarray:
    """Labels of the best packing that an island finds in an epoch."""
    size, rng = lengths.tolist(), np.random.default_rng(seed)
    bound = -(-int(lengths.sum()) // capacity)
    pop = [Packing.of(e, size, capacity) for e in elites]
    while len(pop) < population:
        noise = rng.integers(0, 1 + 16 * len(pop), len(size)) if pop or seed % 2 else 0
        pop.append(Packing(size, capacity).best_fit(np.argsort(noise - lengths, kind="stable").tolist()))
        if len(pop[-1].bins) == bound:
            return pop[-1].labels()
    for _ in range(generations):
        pop.sort(key=Packing.fitness, reverse=True)
        if len(pop[0].bins) == bound:
            break
        i, j = rng.permutation(len(pop))[:2].tolist()
        child = cross(pop[min(i, j)], pop[max(i, j)], rng)
        child = mutate(child, rng)
        if child.fitness() > pop[-1].fitness():
            pop[-1] = child
    return max(pop, key=Packing.fitness).labels()


# ---------------------------------------------------------------- all shards


def _shards(items: DataFrame, n: int, salt: int) -> DataFrame:
    shard = F.pmod(F.xxhash64("_item", F.lit(salt)), F.lit(n)).alias("_shard")
    return items.groupBy(shard).agg(F.sort_array(F.collect_list(F.struct("length", "_item"))).alias("_in")).select("_shard", F.col("_in.length").alias("_len"), F.col("_in._item").alias("_items"))


def _epoch(capacity: int, epoch: int, population: int, generations: int):
    def run(frames):
        for f in frames:
            out = [evolve(np.asarray(n, np.int64), capacity, [np.asarray(e) for e in (es if es is not None else [])], int(s) * 1009 + int(i) * 31 + epoch, population, generations) for s, i, n, es in zip(f["_shard"], f["_island"], f["_len"], f["_elites"])]
            yield pd.DataFrame({"_shard": f["_shard"], "_island": f["_island"], "_len": f["_len"], "_items": f["_items"], "_elite": out, "_bins": [int(e.max()) + 1 for e in out]})

    return run


_ISLAND = "_shard long, _island int, _len array<int>, _items array<long>, _elite array<int>, _bins int"


def _pack_round(items: DataFrame, n: int, salt: int, capacity: int, islands: int, epochs: int, population: int, generations: int) -> DataFrame:
    """(_item, _shard, _bin, length) of the best packing of each shard."""
    now = _shards(items, n, salt).select("_shard", F.explode(F.sequence(F.lit(0), F.lit(islands - 1))).alias("_island"), "_len", "_items", F.lit(None).cast("array<array<int>>").alias("_elites"))
    for e in range(epochs):
        now = now.repartition(max(1, min(n * islands, 4 * C.shuffle_partitions(items.sparkSession))), "_shard", "_island").mapInPandas(_epoch(capacity, e, population, generations), _ISLAND)
        if e < epochs - 1:  # the elite of the island before joins an island's own
            ring = now.groupBy("_shard").agg(F.first("_len").alias("_len"), F.first("_items").alias("_items"), F.array_sort(F.collect_list(F.struct("_island", "_elite"))).alias("_all"))
            now = ring.select("_shard", F.posexplode("_all").alias("_at", "_own"), "_len", "_items", "_all").select(
                "_shard", F.col("_own._island").alias("_island"), "_len", "_items", F.array(F.col("_own._elite"), F.col("_all")[(F.col("_at") + islands - 1) % islands]["_elite"]).alias("_elites"))
    best = now.groupBy("_shard").agg(F.min(F.struct("_bins", "_island", "_len", "_items", "_elite")).alias("b"))
    return best.select("_shard", F.inline(F.arrays_zip(F.col("b._items").alias("_item"), F.col("b._elite").alias("_bin"), F.col("b._len").alias("length"))))


def place(pieces: DataFrame, capacity: int, shard_items: int = 16384, islands: int = 2, epochs: int = 2, population: int = 4, generations: int = 24, good: float = 0.97) -> DataFrame:
    """pieces (_item: unique long, length: int from 1 to capacity) -> (_item, sequence_id, offset: long).

    The search's effort is bounded by islands x epochs x (population + generations) passes over a shard. Sequences are gapless from 0 and no longer than capacity. Full pieces have a sequence each, numbered below 0."""
    full = pieces.filter(F.col("length") == capacity).select("_item", (-1 - F.col("_item")).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    rest = pieces.filter(F.col("length") < capacity).select("_item", F.col("length").cast("int").alias("length"))
    args = (capacity, islands, epochs, population, generations)
    size, done, level = rest.count(), [], 0
    while True:
        n = max(1, math.ceil(size / shard_items))
        packed = _pack_round(rest, n, level, *args)
        if n > 1:
            packed = C.materialize(packed, "packed")
        packed = packed.withColumn("_fill", F.sum("length").over(_bin_window()))
        poor, before = F.col("_fill") < good * capacity, size
        size = packed.filter(poor).count() if n > 1 else 0
        last = n == 1 or not 0 < size <= before // 2
        offset = F.sum("length").over(_bin_window().orderBy(F.desc("length"), "_item").rowsBetween(-(1 << 31), -1))
        whole = packed if last else packed.filter(~poor)
        done.append(whole.select("_item", (F.lit(level << 50) + F.col("_shard") * (1 << 20) + F.col("_bin")).alias("sequence_id"), F.coalesce(offset, F.lit(0)).cast("long").alias("offset")))
        if last:
            break
        rest = C.materialize(packed.filter(poor).select("_item", "length"), "open")
        level += 1
    for d in done:
        full = full.union(d)
    return full


def _bin_window():
    from pyspark.sql import Window

    return Window.partitionBy("_shard", "_bin")


def _pieces(vocabulary: str, capacity: int, end: int, with_ids: bool, special_as_text: bool):
    tail = np.array([end], "<u4").tobytes()

    def run(batches):
        encode = byte_bpe(vocabulary, special_as_text).encode
        for b in batches:
            text = b.column(1)
            for lo in range(0, b.num_rows, 64):
                row, piece, start, length, crc, ids = [], [], [], [], [], []
                for r in range(lo, min(lo + 64, b.num_rows)):
                    data = encode(text[r].as_py() or "") + tail
                    n = len(data) // 4
                    first = (n - 1) % capacity + 1
                    at = 0
                    for k, size in enumerate([first] + [capacity] * ((n - first) // capacity)):
                        part = data[4 * at : 4 * (at + size)]
                        row.append(r)
                        piece.append(k)
                        start.append(at)
                        length.append(size)
                        crc.append(zlib.crc32(part))
                        ids.append(np.frombuffer(part, "<i4"))
                        at += size
                cols = [b.column(i).take(pa.array(row)) for i in range(2, b.num_columns)]
                out = [*cols, pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64())]
                names = [*b.schema.names[2:], "piece", "start", "length", "ids_crc32"]
                if with_ids:
                    out.append(pa.array(ids, pa.list_(pa.int32())))
                    names.append("ids")
                yield pa.RecordBatch.from_arrays(out, names=names)

    return run


def pack(docs: DataFrame, vocabulary: str, text: str = "text", capacity: int = 1024, end: int = 2, columns: tuple = ("doc_id",), with_ids: bool = False, special_as_text: bool = False, **kw) -> DataFrame:
    """One row per piece: `columns` of its document, piece, start, length, ids_crc32, sequence_id, offset (and ids).

    vocabulary: a tokenizers JSON file that each executor has at this path. A document's ids are those of its text (null:
    empty) and then `end`; so an empty document is a piece of one id. Strings of special tokens get those tokens' ids, as the tokenizer's own
    default has it, or, if `special_as_text`, are ordinary text. Equal rows are documents of their own. An empty table gives an empty one.
    """
    keep = list(columns)
    src = docs.select(F.lit(0).alias("_a"), C.text_or_empty(docs[text]).alias("_text"), *[docs[c].alias(f"_c{i}") for i, c in enumerate(keep)])
    schema = ", ".join([*(f"_c{i} {docs.schema[c].dataType.simpleString()}" for i, c in enumerate(keep)), "piece int, start long, length long, ids_crc32 long"] + ["ids array<int>"] * with_ids)
    pieces = C.materialize(src.transform(C.map_batches, _pieces(vocabulary, capacity, end, with_ids, special_as_text), schema), "pieces").withColumn("_item", F.monotonically_increasing_id())
    placed = place(pieces.select("_item", "length"), capacity, **kw)
    extra = ["ids"] if with_ids else []
    return pieces.join(placed, "_item").select(*[F.col(f"_c{i}").alias(c) for i, c in enumerate(keep)], "piece", "start", "length", "ids_crc32", "sequence_id", "offset", *extra)


def op3_best_fit_packing(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return pack(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"), public_tokenizers.path("byte_bpe_50k.json"))
