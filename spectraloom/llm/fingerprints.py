"""Document fingerprints by improbable features: rare byte windows in chained Bloom filters.

Each window of 64 bytes has an entropy, quantised to 0..1000. How rare an entropy is, is counted over all windows of all documents
(1001 counts); that gives the windows their rank, rarest first. In each run of 64 neighbouring windows the leftmost of the
best rank scores a point; windows with 16 points or more (all there can be, in shorter texts) are the text's features.
Five 11-bit parts of a feature's hash set bits in a filter of 2048; after 160 features the chain goes on with a new filter.
Likeness: for each filter of the shorter chain the best normalised overlap of bits, (both - expected) / (most - expected),
averaged by set bits.
"""

from __future__ import annotations

import base64
import hashlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as C

_W, _LEVELS, _BITS, _MOST, _POINTS = 64, 1001, 2048, 160, 16
#: f(c + 1) - f(c) of f(c) = c log2 c, in fixed point: entropies are the same on all machines.
_F = np.array([0.0] + [c * np.log2(c) for c in range(1, _W + 1)])
_GAIN = np.rint(np.diff(_F) * (1 << 20)).astype(np.int64)
_TOP = 6 * _W * (1 << 20)
#: Below this a window is all but one byte repeated; such windows come last.
_DULL = 100


def _laid(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The texts in one buffer, 64 bytes apart that no text holds; their starts and sizes."""
    size = np.array([len(t) for t in texts], np.int64)
    start = np.concatenate([[0], np.cumsum(size[:-1] + _W)]) if len(size) else size
    return np.frombuffer((b"\xff" * _W).join(texts) + b"\xff" * _W, np.uint8), start, size


def entropies(raw: np.ndarray) -> np.ndarray:
    """Quantised entropy of the window from each place on; right for windows inside a text."""
    n = len(raw)
    before, after = np.zeros(n, np.uint8), np.zeros(n, np.uint8)
    span = 1 << 17
    for lo in range(0, n, span):  # so much stays in the cache
        hi = min(n, lo + span)
        part = raw[lo : min(n, hi + _W)]
        a = after[lo:hi]
        for d in range(1, _W):
            m = min(hi - lo, len(part) - d)
            if m <= 0:
                break
            a[:m] += part[:m] == part[d : d + m]
        part = raw[max(0, lo - _W) : hi]
        b, skip = before[lo:hi], lo - max(0, lo - _W)
        for d in range(1, _W):
            s = max(0, d - skip)
            b[s:] += part[skip + s :] == part[skip + s - d : len(part) - d]
    add = np.concatenate([[0], np.cumsum(_GAIN[before])])
    sub = np.concatenate([[0], np.cumsum(_GAIN[after])])
    s = add[_W:] - sub[: n - _W + 1]
    return s


def _levels(raw: np.ndarray, start: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(level at each place of the buffer, whether a window of a text starts there)."""
    valid = np.zeros(len(raw) + 1, np.int8)
    m = np.maximum(size - _W + 1, 0)
    np.add.at(valid, start, 1)
    np.add.at(valid, start + m, -1)
    valid = np.cumsum(valid[:-1]).astype(bool)
    s = np.concatenate([entropies(raw), np.zeros(_W - 1, np.int64)])
    # the sums run over all texts; each text's own start is where its first window's bytes begin
    return s, valid


def levels(texts: list[bytes]):
    raw, start, size = _laid(texts)
    s, valid = _levels(raw, start, size)
    # what the bytes before a text add and take away cancels, but for the pads: the sum of a window of one repeated byte
    out = np.zeros(len(raw), np.int64)
    if valid.any():
        m = np.maximum(size - _W + 1, 0)
        some = m > 0
        first = start[some]
        head = np.array([_head(raw[a : a + _W]) for a in first.tolist()])
        base = np.repeat(head - s[first], m[some])
        at = np.flatnonzero(valid)
        out[at] = (_TOP - (s[at] + base)) * (_LEVELS - 1) // _TOP
    return raw, start, size, np.clip(out, 0, _LEVELS - 1), valid


def _head(window: np.ndarray) -> int:
    seen: dict[int, int] = {}
    total = 0
    for b in window.tolist():
        c = seen.get(b, 0)
        total += int(_GAIN[c])
        seen[b] = c + 1
    return total


def features(texts: list[bytes], rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(text, hash) of the features, in order of place; a feature's repeats in a text are left out."""
    raw, start, size, level, valid = levels(texts)
    n = len(raw)
    kind, bits = (np.uint32, 20) if n < 1 << 20 else (np.uint64, 40)
    key = np.where(valid, rank[level], 2 * _LEVELS).astype(kind) << kind(bits) | np.arange(n, dtype=kind)
    low, have = key, 1
    while have < _W:
        low = np.minimum(low[: len(low) - have], low[have:])
        have *= 2
    m = np.maximum(size - _W + 1, 0)
    runs = np.where(m > 0, np.maximum(m - _W + 1, 1), 0)
    one = np.zeros(len(low) + 1, np.int8)
    np.add.at(one, start, (runs > 0).astype(np.int8))
    np.add.at(one, np.minimum(start + runs, len(low)), -(runs > 0).astype(np.int8))
    picks = (low[np.cumsum(one[:-1]).astype(bool)] & kind((1 << bits) - 1)).astype(np.int64)
    points = np.bincount(picks, minlength=n)
    least = np.repeat(np.minimum(_POINTS, runs), m)
    at = np.flatnonzero(valid)
    at = at[points[at] >= np.maximum(least, 1)]
    sums = C.prefix_hash(raw)
    doc, h = np.searchsorted(start, at, "right") - 1, C.span_hash(sums, at, at + _W)
    few = np.flatnonzero((size > 0) & (size < _W))  # a text shorter than a window is one feature
    if len(few):
        doc = np.concatenate([doc, few])
        h = np.concatenate([h, C.span_hash(sums, start[few], start[few] + size[few])])
        order = np.argsort(doc, kind="stable")
        doc, h = doc[order], h[order]
    _, first = np.unique(C.mix(doc.astype(np.uint64)) ^ h, return_index=True)
    first.sort()
    return doc[first], h[first]


def filters(texts: list[bytes], rank: np.ndarray) -> list[np.ndarray]:
    """For each text its chain: rows of 2048 bits (bool)."""
    doc, h = features(texts, rank)
    n = np.bincount(doc, minlength=len(texts))
    at = np.arange(len(doc)) - np.repeat(np.cumsum(n) - n, n)
    chain = -(-n // _MOST)
    first = np.cumsum(chain) - chain
    row = first[doc] + at // _MOST
    bits = np.zeros((int(chain.sum()), _BITS), bool)
    for k in range(5):
        bits[row, ((h >> np.uint64(11 * k)) & np.uint64(_BITS - 1)).astype(np.int64)] = True
    return [bits[a : a + c] for a, c in zip(first.tolist(), chain.tolist())]


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """0 to 1, whichever comes first; two empty chains are alike."""
    if not len(a) or not len(b):
        return float(len(a) == len(b))
    if (len(a), int(a.sum()), a.tobytes()) > (len(b), int(b.sum()), b.tobytes()):
        a, b = b, a
    na, nb = a.sum(1, dtype=np.float32), b.sum(1, dtype=np.float32)
    both = a.astype(np.float32) @ b.astype(np.float32).T
    expected = np.outer(na, nb) / _BITS
    most = np.minimum(na[:, None], nb[None, :])
    best = np.clip((both - expected) / np.maximum(most - expected, 1e-9), 0, 1).max(axis=1)
    return float(np.float64((best * na).sum()) / np.float64(na.sum()))


def digest(chain: np.ndarray) -> str:
    """Base64 of each filter, joined by dots."""
    return ".".join(base64.b64encode(np.packbits(f).tobytes()).decode() for f in chain)


# ---------------------------------------------------------------- all documents


def _histogram(batches):
    total = np.zeros(_LEVELS, np.int64)
    for b in batches:
        raw, offs = C.buffers(b.column(0))
        for i, j in C.steps(offs):
            _, _, _, level, valid = levels([raw[offs[k] : offs[k + 1]].tobytes() for k in range(i, j)])
            total += np.bincount(level[valid], minlength=_LEVELS)
    at = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(total[at])], names=["level", "n"])


def rarity_ranks(docs: DataFrame, text: str = "text") -> np.ndarray:
    """Rank of each of the 1001 entropies, the rarest over all windows of docs first."""
    rows = docs.select(C.text_or_empty(docs[text])).transform(C.map_batches, _histogram, "level int, n long").groupBy("level").agg(F.sum("n").alias("n")).collect()
    count = np.zeros(_LEVELS, np.int64)
    for r in rows:
        count[r["level"]] = r["n"]
    rank = np.empty(_LEVELS, np.int64)
    rank[np.lexsort((np.arange(_LEVELS), count))] = np.arange(_LEVELS)
    rank[:_DULL] = _LEVELS + np.arange(_DULL)[::-1]
    return rank


def fingerprint(docs: DataFrame, ranks: np.ndarray, text: str = "text") -> DataFrame:
    """docs with fingerprint (string; null and empty texts: empty). Equal texts have equal ones under equal ranks."""
    keep = [c for c in docs.columns if c.lower() != "fingerprint"]
    src = docs.select(*[docs[c].alias(f"_c{i}") for i, c in enumerate(keep)], C.text_or_empty(docs[text]).alias("_text"))

    def run(batches):
        for b in batches:
            raw, offs = C.buffers(b.column(b.num_columns - 1))
            out = []
            for i, j in C.steps(offs):
                out += [digest(f) for f in filters([raw[offs[k] : offs[k + 1]].tobytes() for k in range(i, j)], ranks)]
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(out, pa.string())], names=[*b.schema.names[:-1], "fingerprint"])

    schema = ", ".join([*(f"_c{i} {docs.schema[c].dataType.simpleString()}" for i, c in enumerate(keep)), "fingerprint string"])
    return src.transform(C.map_batches, run, schema).select(*[F.col(f"_c{i}").alias(c) for i, c in enumerate(keep)], "fingerprint")


def with_next(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(_block, _guest, key, text), dealt by blocks of falling keys and sorted within: the row after a row is its next document.

    Rows are in order of key (falling, null last), then a hash of the text. A block's last row, with _guest 1, is a copy of the first
    of the block after (of all, after the last). Only the blocks' first keys, one each, come to the driver.
    """
    spark = docs.sparkSession
    n = C.shuffle_partitions(spark)
    src = docs.select(docs[key].cast("long").alias("key"), C.text_or_empty(docs[text]).alias("text")).withColumn("h", F.xxhash64("text"))
    edges = sorted(set(docs.select(docs[key].cast("long").alias("key")).filter("key IS NOT NULL").approxQuantile("key", [i / n for i in range(1, n)], 0.1 / n)), reverse=True)
    edges = np.array([int(e) for e in edges], np.int64)

    @F.pandas_udf("int")
    def block(k: pd.Series) -> pd.Series:
        null = k.isna()
        at = len(edges) - np.searchsorted(edges[::-1], k.fillna(0).to_numpy(np.int64), "right")
        return pd.Series(np.where(null, len(edges), at).astype(np.int32))

    top = src.select("key", "h", block("key").alias("b")).groupBy("b").agg(F.min(F.struct(F.col("key").isNull().alias("z"), (-F.col("key")).alias("k"), "h")).alias("f")).orderBy("b").collect()
    if not top:
        return src.select(F.lit(0).alias("_block"), F.lit(0).alias("_guest"), "key", "text")
    before = {r["b"]: top[i - 1]["b"] for i, r in enumerate(top)}
    firsts = {r["b"]: (r["f"]["k"], r["f"]["h"]) for r in top}

    @F.pandas_udf("array<int>")
    def blocks(k: pd.Series, h: pd.Series) -> pd.Series:
        null = k.isna().to_numpy()
        v = k.fillna(0).to_numpy(np.int64)
        at = np.where(null, len(edges), len(edges) - np.searchsorted(edges[::-1], v, "right"))
        return pd.Series([[b, before[b]] if firsts.get(b) == (None if z else -x, y) else [b] for b, z, x, y in zip(at.tolist(), null.tolist(), v.tolist(), h.tolist())])

    rows = src.select("key", "text", "h", F.posexplode(blocks("key", "h")).alias("_guest", "_block"))
    return rows.repartitionById(n, F.col("_block")).sortWithinPartitions("_block", "_guest", F.desc_nulls_last("key"), "h").select("_block", "_guest", "key", "text")


def edited(text: str, following: str) -> str:
    """text, its last third (of code points, rounded down) replaced by as many of the next one's first."""
    k = len(text) // 3
    return text[: len(text) - k] + following[:k]


def _compare(ranks: np.ndarray):
    names = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]

    def part(rows: list[tuple]) -> pa.RecordBatch | None:
        """rows (block, guest, key, text): all but the last have their next one after them."""
        out = [i for i in range(len(rows) - 1) if not rows[i][1]]
        if not out:
            return None
        new = [edited(rows[i][3], rows[i + 1][3]).encode() for i in out]
        own = filters([r[3].encode() for r in rows], ranks)
        changed = filters(new, ranks)
        cols = [
            pa.array([rows[i][2] for i in out], pa.int64()), pa.array([len(rows[i][3]) for i in out], pa.int64()), pa.array([hashlib.sha256(t).hexdigest() for t in new]),
            pa.array([digest(own[i]) for i in out]), pa.array([digest(c) for c in changed]),
            pa.array([likeness(own[i], c) for i, c in zip(out, changed)], pa.float64()), pa.array([likeness(own[i], own[i + 1]) for i in out], pa.float64()),
        ]
        return pa.RecordBatch.from_arrays(cols, names=names)

    def run(batches):
        rows, size, guest = [], 0, None
        for b in batches:
            for r in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist(), b.column(3)):
                if r[1] and guest == r[0]:
                    continue  # equal rows were the first of the block after
                guest = r[0] if r[1] else None
                rows.append((*r[:3], r[3].as_py()))
                size += len(rows[-1][3])
                if size >= C.STEP_BYTES // 2 and len(rows) > 1:
                    if (x := part(rows)) is not None:
                        yield x
                    rows, size = rows[-1:], len(rows[-1][3])
        if (x := part(rows)) is not None:
            yield x

    return run


def op8_fingerprints(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return with_next(docs).transform(C.map_batches, _compare(rarity_ranks(docs)), "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")
