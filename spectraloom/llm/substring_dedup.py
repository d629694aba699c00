"""Exact substring dedup over windows of words, by prefix-partitioned suffix trees.

A window of ``window`` consecutive words that starts at two places or more, in any documents, is a repeat; each word that a
repeat covers goes.

1. Each window picks the leftmost smallest of its ``anchor``-word grams, so windows with equal words pick the same gram at
   the same offset: that gram is the prefix by which suffixes are split. Windows found twice in one text are repeats at
   once, and one of them stands for all. Per (text, picked gram): a bit mask of the window starts that picked it.
2. Grams are counted over all texts with partial sums. What is unique can't hold a repeat and is left.
3. Suffixes with a common prefix meet, with just the words that they need. A prefix with more than ``group_rows`` places
   is lengthened, from ``anchor`` words to the whole window, by dealing it over several groups. In each group the suffix tree of the
   window starts is built: suffixes in order (by exact names of 1, 2, 4 .. words), and the common length of each with the one
   before it, which are the depths of the internal nodes. Suffixes below an internal node of depth ``window`` or more are repeats; a
   node at which nothing longer is common, to the left or to the right, is a maximal repeat.
4. Of a lengthened prefix each group sends one row per node (so, at most as many as groups), and the sums by the window's
   128-bit hash tell whether a node that was a leaf in its group has suffixes elsewhere.

Every stage is a partial sum, a join that Spark may split, or a stream over sorted rows. No group of copies meets whole.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as C

_POS_BITS = np.uint64(30)
_SCHEMA_A = "_key long, kind byte, anchor long, pos int, mask long"


def _leftmost_min(g: np.ndarray, width: int) -> np.ndarray:
    """For each start of `width` values, the index of the leftmost of the smallest (by 34 leading bits)."""
    at = np.arange(len(g), dtype=np.uint64)
    v = ((g >> _POS_BITS) << _POS_BITS) | at
    have = 1
    while have < width:
        step = min(have, width - have)
        v = np.minimum(v[: len(v) - step], v[step:])
        have += step
    return (v & np.uint64((1 << 30) - 1)).astype(np.int64)


def _local(key: np.ndarray, w: C.Words, window: int, anchor: int) -> pa.RecordBatch | None:
    h, n = w.hashes(), len(w)
    if n < window:
        return None
    start = np.flatnonzero(C.gram_ok(w.first, n, window))
    if not len(start):
        return None
    doc = np.searchsorted(w.first, start, "right") - 1
    mark = C.gram_hashes(h, window)[start] ^ C.mix(doc.astype(np.uint64))
    order = np.argsort(mark, kind="stable")
    same = np.concatenate([[False], mark[order][1:] == mark[order][:-1]])
    first, twice = np.empty(len(start), bool), np.empty(len(start), bool)
    first[order] = ~same
    twice[order] = same | np.concatenate([same[1:], [False]])
    # runs of windows that this text has twice
    run = np.flatnonzero(twice)
    cut = np.flatnonzero(np.concatenate([[True], (np.diff(start[run]) != 1) | (np.diff(doc[run]) != 0)])) if len(run) else run
    run_len = np.diff(np.concatenate([cut, [len(run)]])) if len(run) else run
    run_at = run[cut] if len(run) else run
    # prefixes picked by the others and by one of each of these
    g = C.gram_hashes(h, anchor)
    s, d = start[first], doc[first]
    a = _leftmost_min(g, window - anchor + 1)[s]
    head = np.flatnonzero(np.concatenate([[True], np.diff(a) != 0]))
    mask = np.bitwise_or.reduceat(np.left_shift(np.int64(1), a - s), head)
    n_runs = len(run_at)
    return pa.RecordBatch.from_arrays(
        [
            pa.array(np.concatenate([key[d[head]], key[doc[run_at]]])),
            pa.array(np.concatenate([np.zeros(len(head), np.int8), np.ones(n_runs, np.int8)])),
            pa.array(np.concatenate([g[a[head]].view(np.int64), np.zeros(n_runs, np.int64)])),
            pa.array(np.concatenate([a[head] - w.first[d[head]], start[run_at] - w.first[doc[run_at]]]).astype(np.int32)),
            pa.array(np.concatenate([mask, run_len.astype(np.int64)])),
        ],
        names=["_key", "kind", "anchor", "pos", "mask"],
    )


def _find_local(window: int, anchor: int):
    def run(batches):
        for b in batches:
            raw, offs = C.buffers(b.column(1))
            key = np.asarray(b.column(0))
            for i, j in C.steps(offs):
                w = C.Words(raw[offs[i] : offs[j]], offs[i : j + 1] - offs[i])
                if (out := _local(key[i:j], w, window, anchor)) is not None:
                    yield out

    return run


def _cut_contexts(window: int, n_cols: int, group_rows: int):
    """Rows (columns of the texts .., places): for each place the words around it that its windows need."""

    def run(batches):
        for b in batches:
            raw, offs = C.buffers(b.column(1))
            key = np.asarray(b.column(0))
            for r in range(b.num_rows):
                places = b.column(n_cols).slice(r, 1).flatten()
                pos, mask, name, n = (np.asarray(places.field(k)) for k in ("pos", "mask", "anchor", "n"))
                text = raw[offs[r] : offs[r + 1]]
                w = C.Words(text, np.array([0, len(text)]))
                data = text.tobytes()
                low = np.array([int(m & -m).bit_length() - 1 for m in mask.tolist()])
                high = np.array([int(m).bit_length() - 1 for m in mask.tolist()])
                lo, hi = w.start[pos - high].tolist(), w.end[pos - low + window - 1].tolist()
                groups = -(-n // group_rows)
                salt = (C.mix(np.uint64(key[r]) ^ C.mix(pos.astype(np.uint64))) % groups.astype(np.uint64)).astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(name), pa.array(np.where(groups > 1, salt, -1).astype(np.int32)), pa.array(np.full(len(pos), key[r])), pa.array(pos), pa.array(mask), pa.array([data[x:y] for x, y in zip(lo, hi)], pa.binary())],
                    names=["anchor", "salt", "_key", "pos", "mask", "context"],
                )

    return run


class SuffixTree:
    """The suffixes of some words that start at `starts`, by group: in order, with the depths of the nodes between neighbours.

    words: names of all texts, one text after the other; ends: where each ends. No common part reaches over a text's end or has
    `longest` words (a power of two, 64 at most) or more."""

    def __init__(self, words: np.ndarray, ends: np.ndarray, text: np.ndarray, starts: np.ndarray, group: np.ndarray, longest: int = 64):
        # a word of its own ends each text
        size = np.diff(np.concatenate([[0], ends]))
        shift = np.repeat(np.arange(len(ends)), size)
        row = np.zeros(len(words) + len(ends) + longest, np.uint64)
        row[np.arange(len(words)) + shift] = words.astype(np.uint64)
        row[ends + np.arange(len(ends))] = np.uint64(int(words.max(initial=0)) + 1) + np.arange(len(ends), dtype=np.uint64)
        at = starts + text
        self.names, have = [row], 1
        while 2 * have < longest:
            name = self.names[-1]
            pair = np.zeros(len(row), np.uint64)
            pair[: len(row) - have] = name[: len(row) - have] << np.uint64(32) | name[have:]
            self.names.append(np.unique(pair, return_inverse=True)[1].astype(np.uint64))
            have *= 2
        half = self.names[-1]
        self.order = np.lexsort((half[at + have], half[at], group))
        self.group = group[self.order]
        p, q = at[self.order][:-1], at[self.order][1:]
        depth = np.zeros(len(p), np.int64)
        for k, name in reversed(list(enumerate(self.names))):
            depth += (name[p + depth] == name[q + depth]).astype(np.int64) << k
        same = self.group[1:] == self.group[:-1]
        #: depth of the node at which each suffix leaves the one before it; 0 between groups
        self.depth = np.concatenate([[0], np.where(same, depth, 0)]) if len(at) else np.zeros(0, np.int64)

    def nodes_at(self, depth: int) -> np.ndarray:
        """For each suffix (as given), the number of the subtree at that depth that it is in."""
        out = np.empty(len(self.order), np.int64)
        out[self.order] = np.cumsum(self.depth < depth) - 1
        return out

    def internal_nodes(self, least: int) -> list[tuple[int, int, int]]:
        """(first, last, depth) of the nodes of that depth or more; first and last are places in `order`."""
        out, open_ = [], []
        for i, d in enumerate([*self.depth.tolist(), 0]):
            first = i - 1
            while open_ and open_[-1][1] > d:
                first, deep = open_.pop()
                if deep >= least:
                    out.append((first, i - 1, deep))
            if d and (not open_ or open_[-1][1] < d):
                open_.append((first, d))
        return out


def _subtrees(t: pa.Table, window: int) -> pa.RecordBatch:
    """One block of whole groups: rows of the nodes at full depth."""
    raw, offs = C.buffers(t.column("context"))
    w = C.Words(raw, offs)
    h = w.hashes()
    anchor, salt = np.asarray(t.column("anchor").combine_chunks()), np.asarray(t.column("salt").combine_chunks())
    key, pos, mask = (np.asarray(t.column(c).combine_chunks()) for c in ("_key", "pos", "mask"))
    group = np.cumsum(np.concatenate([[0], (np.diff(anchor) != 0) | (np.diff(salt) != 0)])) if len(anchor) else anchor
    high = np.array([int(m).bit_length() - 1 for m in mask.tolist()])
    rows, offset = [], []
    for j in range(64):
        r = np.flatnonzero((mask >> j) & 1)
        rows.append(r)
        offset.append(np.full(len(r), j))
    rows, offset = np.concatenate(rows), np.concatenate(offset)
    at = w.first[rows] + high[rows] - offset
    tree = SuffixTree(np.unique(h, return_inverse=True)[1], w.first[1:], rows, at, group[rows], 1 << window.bit_length())
    _, one, inverse, count = np.unique(tree.nodes_at(window), return_inverse=True, return_counts=True, return_index=True)
    deep = count[inverse] >= 2
    # decided here: several suffixes below one node
    dup = np.zeros(len(key), np.int64)
    np.bitwise_or.at(dup, rows[deep], np.left_shift(np.int64(1), offset[deep]))
    done = np.flatnonzero(dup)
    # a dealt prefix: one row for each node
    dealt = one[salt[rows[one]] >= 0]
    w1 = C.gram_hashes(h, window)[at[dealt]]
    w2 = C.gram_hashes(C.mix(h ^ np.uint64(0x5851F42D4C957F2D)), window)[at[dealt]]
    leaf = count[inverse[dealt]] == 1
    own = C.mix(key[done].view(np.uint64)) ^ C.mix(pos[done].astype(np.uint64) + np.uint64(1 << 40))
    return pa.RecordBatch.from_arrays(
        [
            pa.array(np.concatenate([own, w1]).view(np.int64)),
            pa.array(np.concatenate([C.mix(own), w2]).view(np.int64)),
            pa.array(np.concatenate([np.full(len(done), 2), np.minimum(count[inverse[dealt]], 2)]).astype(np.int64)),
            pa.array(np.concatenate([key[done], key[rows[dealt]]])),
            pa.array(np.concatenate([pos[done], pos[rows[dealt]]]).astype(np.int32)),
            pa.array(np.concatenate([dup[done], np.where(leaf, np.left_shift(np.int64(1), offset[dealt]), 0)])),
        ],
        names=["w1", "w2", "n", "_key", "pos", "mask"],
    )


def _grow_subtrees(window: int, block_rows: int):
    """Rows sorted by (anchor, salt): blocks of whole groups; what may go on in the next batch waits."""

    def run(batches):
        kept: list[pa.RecordBatch] = []
        size = 0
        for b in batches:
            kept.append(b)
            size += b.num_rows
            if size < block_rows:
                continue
            t = pa.Table.from_batches(kept).combine_chunks()
            anchor, salt = np.asarray(t.column("anchor").combine_chunks()), np.asarray(t.column("salt").combine_chunks())
            last = np.flatnonzero((anchor != anchor[-1]) | (salt != salt[-1]))
            cut = int(last[-1]) + 1 if len(last) else 0
            if cut:
                yield _subtrees(t.slice(0, cut), window)
            kept, size = t.slice(cut).combine_chunks().to_batches(), t.num_rows - cut
        if size:
            yield _subtrees(pa.Table.from_batches(kept).combine_chunks(), window)

    return run


def _keep_rest(window: int, names: list[str]):
    """Rows (key, text, .., marks): the kept words; marks: (place, bit mask of offsets) or (start, minus the run's length)."""

    def run(batches):
        for b in batches:
            raw, offs = C.buffers(b.column(1))
            marks = b.column(b.num_columns - 1)
            kept, n_words, n_removed = [], [], []
            some = np.asarray(marks.is_valid())
            for r in range(b.num_rows):
                words = raw[offs[r] : offs[r + 1]].tobytes().split()
                n = len(words)
                if some[r]:
                    places = marks.slice(r, 1).flatten()
                    pos, mask = np.asarray(places.field("pos")).astype(np.int64), np.asarray(places.field("mask"))
                    gone = np.zeros(n + 1, np.int32)
                    runs = mask < 0
                    np.add.at(gone, pos[runs], 1)
                    np.add.at(gone, pos[runs] - mask[runs] - 1 + window, -1)
                    pos, mask = pos[~runs], mask[~runs]
                    for j in range(window):
                        s = pos[(mask >> j) & 1 == 1] - j
                        np.add.at(gone, s, 1)
                        np.add.at(gone, s + window, -1)
                    keep = np.cumsum(gone[:n]) == 0
                    words = [x for x, y in zip(words, keep.tolist()) if y]
                kept.append(b" ".join(words))
                n_words.append(n)
                n_removed.append(n - len(words))
            cols = [b.column(b.schema.get_field_index(c)) for c in names[:-3]]
            yield pa.RecordBatch.from_arrays([*cols, pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(kept, pa.binary()).cast(pa.string())], names=names)

    return run


def _marked(src: DataFrame, window: int, anchor: int, group_rows: int) -> tuple[DataFrame, DataFrame]:
    """src (_key, _text, ..) dealt by _key, and (_key, _marks) of the texts with repeats: see _keep_rest."""
    if not 1 <= anchor <= window < 64 + anchor - 1 or window > 63:
        raise ValueError("anchor must be from 1 to window, and window less than anchor + 63 and 64")
    found = C.materialize(src.select("_key", "_text").transform(C.map_batches, _find_local(window, anchor), _SCHEMA_A), "repeats")
    picked = found.filter("kind = 0").drop("kind")
    often = picked.groupBy("anchor").agg(F.count("*").alias("n")).filter("n > 1")
    places = picked.join(often, "anchor").groupBy("_key").agg(F.collect_list(F.struct("pos", "mask", "anchor", "n")).alias("_places"))

    n = C.shuffle_partitions(src.sparkSession)
    dealt = src.repartition(n, "_key")
    cols = dealt.columns
    contexts = dealt.join(places, "_key").select(*cols, "_places").transform(C.map_batches, _cut_contexts(window, len(cols), group_rows), "anchor long, salt int, _key long, pos int, mask long, context binary")
    nodes = contexts.repartition(n, "anchor", "salt").sortWithinPartitions("anchor", "salt").transform(C.map_batches, _grow_subtrees(window, 8000), "w1 long, w2 long, n long, _key long, pos int, mask long")
    deep = nodes.groupBy("w1", "w2").agg(F.sum("n").alias("n"), F.collect_list(F.when(F.col("mask") != 0, F.struct("_key", "pos", "mask"))).alias("at")).filter("n > 1").select(F.inline("at"))
    twice = found.filter("kind = 1").select("_key", "pos", (-F.col("mask")).alias("mask"))
    marks = deep.union(twice).groupBy("_key").agg(F.collect_list(F.struct("pos", "mask")).alias("_marks"))
    return dealt, marks


def _spans(window: int):
    """Rows (key, marks): the runs of repeated windows, as the words that they cover."""

    def run(batches):
        for b in batches:
            marks = b.column(1)
            spans = []
            for r in range(b.num_rows):
                places = marks.slice(r, 1).flatten()
                pos, mask = np.asarray(places.field("pos")).astype(np.int64), np.asarray(places.field("mask"))
                runs = mask < 0
                at = [np.arange(p, p - m) for p, m in zip(pos[runs].tolist(), mask[runs].tolist())]
                at += [pos[~runs][(mask[~runs] >> j) & 1 == 1] - j for j in range(window)]
                at = np.unique(np.concatenate(at))
                cut = np.flatnonzero(np.concatenate([[True], np.diff(at) != 1]))
                last = at[np.append(cut[1:], len(at)) - 1]
                spans.append([{"start": int(x), "length": int(y - x + window)} for x, y in zip(at[cut], last)])
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(spans, pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64())])))], names=["_key", "repeats"])

    return run


def repeated_passages(docs: DataFrame, text: str = "text", window: int = 35, anchor: int = 8, group_rows: int = 1024) -> DataFrame:
    """docs with repeats: array of (start, length: long, in words), the longest stretches of which each window of `window` words is a
    repeat. They can overlap by up to window - 1 words where the window between two isn't a repeat. Null for texts without any;
    a column named repeats is replaced."""
    at, columns = C.free_name(docs, "_key")[0], docs.columns
    docs = C.numbered(docs, at)
    _, marks = _marked(docs.select(docs[at].alias("_key"), docs[text].alias("_text")), window, anchor, group_rows)
    spans = marks.transform(C.map_batches, _spans(window), "_key long, repeats array<struct<start: long, length: long>>")
    keep = [c for c in columns if c.lower() != "repeats"]
    rest = docs.select(docs[at].alias("_key"), *[docs[c].alias(f"_c{i}") for i, c in enumerate(keep)]).join(spans, "_key", "left")
    return rest.select(*[F.col(f"_c{i}").alias(c) for i, c in enumerate(keep)], "repeats")


def remove_repeats(docs: DataFrame, text: str = "text", window: int = 35, anchor: int = 8, group_rows: int = 1024, original: bool = True) -> DataFrame:
    """docs with n_words, n_removed (long) and kept_text (the words that stay, joined by one space); without the text if not `original`.

    A null or empty text has no words and an empty kept_text; a text of fewer than `window` words keeps all. Equal rows are
    texts of their own: each copy counts, and whole copies lose all that a window covers. Other columns pass unchanged;
    columns named like those that are added are replaced. An empty table gives an empty one.
    """
    added = ("n_words", "n_removed", "kept_text")
    at, columns = C.free_name(docs, "_key")[0], docs.columns
    docs = C.numbered(docs, at)
    keep = [c for c in columns if c.lower() not in added and c != text]
    src = docs.select(docs[at].alias("_key"), docs[text].alias("_text"), *[docs[c].alias(f"_c{i}") for i, c in enumerate(keep)])
    dealt, marks = _marked(src, window, anchor, group_rows)
    cols = dealt.columns
    # the text is dealt once; its column comes back from there
    passed = [("_text", text)] * original + [(f"_c{i}", c) for i, c in enumerate(keep)]
    out = ", ".join([*(f"{k} {docs.schema[c].dataType.simpleString()}" for k, c in passed), "n_words long, n_removed long, kept_text string"])
    names = [*(k for k, _ in passed), *added]
    rest = dealt.join(marks, "_key", "left").select(*cols, "_marks").transform(C.map_batches, _keep_rest(window, names), out)
    place = {c: k for k, c in passed}
    return rest.select(*[F.col(place[c]).alias(c) for c in columns if c in place], *added)


def op6_substring_dedup(spark, sf_dir: str) -> DataFrame:
    out = remove_repeats(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"), original=False)
    return out.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept_text"), 256).alias("kept_sha256"))
