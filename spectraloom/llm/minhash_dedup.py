"""Near-duplicate classes by BagMinHash signatures, banding and exact verification.

A text is the bag (multiset) of its shingles of ``shingle`` words; a text with fewer words is one shingle, one without any
is an empty bag. Likeness is the weighted Jaccard index: sum of smaller counts over sum of larger counts.

BagMinHash: over time x and weight y, each shingle has a Poisson process of points, each with a random slot of the
signature; a slot keeps the earliest point below the shingle's weight. Weights are discretised to integers and the weight
axis to the strips (0, 1], (1, 2], (2, 4], (4, 8] ..; each strip's process is refined as a hierarchy: its first point
goes to one half, the other half goes on from there by itself, down to unit strips. Points later than the latest slot
of a text are never drawn, so a text costs about its number of distinct shingles, whatever the weights.

Equal texts meet first, in partial sums; one of each stands for all. In a bucket (a band's slots alike) nobody is compared
with everybody. First, each text is verified against one leader: of its buckets' members that whose buckets are fullest, so
the middle of a group of edits. Then those left out have leaders among themselves, as long as a round links a fair part
of what it tries. Last, exactly, what still lies in different components of a bucket. There each text is compared with the
bucket's leader L: the overlap of two texts is at most the smaller of their overlaps with L, plus what they share beyond L. So if
they share nothing beyond L, only few sizes can reach the threshold: those pairs are compared. If they do, enough of it
must be shared that they share one of the rarest shingles that either has beyond L (prefix filter). Those that share one get leaders among
themselves in the same way; pairs of what is then still in different components are compared. All other pairs of a bucket are
proven to be below the threshold.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import common as C
from .components import components, joined

_U = np.uint64


def shingles(raw: np.ndarray, offs: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, C.Words]:
    """(text, hash) of each shingle, sorted by both."""
    w = C.Words(raw, offs)
    h = w.hashes()
    n = np.diff(w.first)
    at = np.flatnonzero(C.gram_ok(w.first, len(w), k))
    doc = np.searchsorted(w.first, at, "right") - 1
    g = C.gram_hashes(h, k)[at]
    few = np.flatnonzero((n > 0) & (n < k))
    if len(few):
        own = [C.gram_hashes(h[w.first[d] : w.first[d + 1]], int(n[d]))[0] for d in few]
        doc, g = np.concatenate([doc, few]), np.concatenate([g, np.array(own, np.uint64)])
    order = np.lexsort((g, doc))
    return doc[order], g[order], w


def bag(doc: np.ndarray, g: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct (text, shingle) with their counts."""
    new = np.flatnonzero(np.concatenate([[True], (doc[1:] != doc[:-1]) | (g[1:] != g[:-1])])) if len(doc) else np.zeros(0, np.int64)
    return doc[new], g[new], np.diff(np.concatenate([new, [len(doc)]]))


def _wait(seed: np.ndarray, rate) -> np.ndarray:
    u = ((C.mix(seed ^ _U(0xA24BAED4963EE407)) >> _U(11)).astype(np.float64) + 0.5) * 2.0**-53
    return -np.log(u) / rate


def bag_signatures(doc: np.ndarray, element: np.ndarray, weight: np.ndarray, n_docs: int, m: int) -> np.ndarray:
    """(n_docs, m) 64-bit slots: the time of the earliest point (float bits) over 32 bits that name the point."""
    top = np.iinfo(np.uint64).max
    slots = np.full(n_docs * m, top, np.uint64)
    # root strips: (0, 1] for all, then (2**j, 2**(j + 1)] as far as the weights reach
    parts = [(doc, element, np.zeros(len(doc), np.int64), np.ones(len(doc), np.int64), weight)]
    j = 0
    while (more := np.flatnonzero(weight > (1 << j))).size:
        parts.append((doc[more], element[more] ^ C.mix(np.full(len(more), j + 1, np.uint64)), np.full(len(more), 1 << j), np.full(len(more), 1 << (j + 1)), weight[more]))
        j += 1
    d, seed, lo, hi, w = (np.concatenate(c) for c in zip(*parts))
    seed = C.mix(seed)
    x = _wait(seed, hi - lo)
    late = np.full(n_docs, np.inf)
    while len(d):
        unit = hi - lo == 1
        du, su, xu = d[unit], seed[unit], x[unit]
        k = (C.mix(su ^ _U(0x2545F4914F6CDD1D)) % _U(m)).astype(np.int64)
        point = (xu.astype(np.float32).view(np.uint32).astype(np.uint64) << _U(32)) | (su & _U(0xFFFFFFFF))
        np.minimum.at(slots, du * m + k, point)
        # the next point of each unit strip
        nu = C.mix(su + _U(0x9E3779B97F4A7C15))
        nxt = [(du, nu, lo[unit], hi[unit], w[unit], xu + _wait(nu, 1.0))]
        if not unit.all():
            s = ~unit
            ds, ss, ls, hs, ws, xs = d[s], seed[s], lo[s], hi[s], w[s], x[s]
            mid = (ls + hs) // 2
            left = C.mix(ss ^ _U(0x1B873593CC9E2D51)) & _U(1) == 0
            for side, a, b in ((0, ls, mid), (1, mid, hs)):
                own = C.mix(ss ^ _U(0xB5297A4D3F84D5B5 + side))
                here = left if side == 0 else ~left
                nxt.append((ds, own, a, b, ws, np.where(here, xs, xs + _wait(C.mix(own), b - a))))
        d, seed, lo, hi, w, x = (np.concatenate(c) for c in zip(*nxt))
        worst = slots.reshape(n_docs, m).max(axis=1)
        late = np.where(worst == top, np.inf, (worst >> _U(32)).astype(np.uint32).view(np.float32))
        on = (x <= late[d] * (1 + 1e-6)) & (lo < w)
        d, seed, lo, hi, w, x = d[on], seed[on], lo[on], hi[on], w[on], x[on]
    return slots.reshape(n_docs, m)


def _sign(shingle: int, bands: int, rows: int):
    def run(batches):
        for b in batches:
            raw, offs = C.buffers(b.column(1))
            for i, j in C.steps(offs, 3 << 19):
                n = j - i
                doc, g, w = shingles(raw[offs[i] : offs[j]], offs[i : j + 1] - offs[i], shingle)
                slots = bag_signatures(*bag(doc, g), n, bands * rows)
                name = slots & _U(0xFFFFFFFF)
                key = np.zeros((n, bands), np.uint64)
                for r in range(rows):
                    key = C.mix(key * _U(0x9FB21C651E98DF25) ^ name.reshape(n, bands, rows)[:, :, r] ^ _U(r << 40))
                h = w.hashes()
                whole = []
                for salt in (_U(0), _U(0x5851F42D4C957F2D)):
                    v = C.mix(h ^ salt) * C.mix(np.arange(len(h), dtype=np.uint64) - np.repeat(w.first[:-1], np.diff(w.first)).astype(np.uint64) + salt)
                    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(v)])
                    whole.append(pa.array(C.mix((sums[w.first[1:]] - sums[w.first[:-1]]) ^ np.diff(w.first).astype(np.uint64)).view(np.int64)))
                keys = pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * bands), pa.array(key.reshape(-1).view(np.int64)))
                empty = np.diff(w.first) == 0
                if empty.any():  # no shingle, no bucket
                    keys = pa.array([None if e else k for e, k in zip(empty.tolist(), keys.to_pylist())], pa.list_(pa.int64()))
                yield pa.RecordBatch.from_arrays([b.column(0).slice(i, n), *whole, keys], names=["_key", "d1", "d2", "keys"])

    return run


def overlap(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> tuple[int, np.ndarray, np.ndarray]:
    """Of two bags (sorted distinct hashes, counts): size of the overlap, the shingles that b has more often than a, and how much more."""
    at = np.minimum(np.searchsorted(a[0], b[0]), max(len(a[0]) - 1, 0))
    in_a = np.where(a[0][at] == b[0], a[1][at], 0) if len(a[0]) else np.zeros(len(b[0]), np.int64)
    more = b[1] - in_a
    return int(np.minimum(in_a, b[1]).sum()), b[0][more > 0], more[more > 0]


def _verify(shingle: int, least: float, beyond: bool):
    def bag_of(text: bytes):
        raw = np.frombuffer(text, np.uint8)
        _, g, c = bag(*shingles(raw, np.array([0, len(raw)]), shingle)[:2])
        return g, c

    def run(batches):
        known: dict[int, tuple] = {}
        for whole in batches:
            for lo in range(0, whole.num_rows, 500):
                b = whole.slice(lo, 500)
                rows = []
                for u, v, tu, tv in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2), b.column(3)):
                    bags = []
                    for k, t in ((u, tu), (v, tv)):
                        if (x := known.get(k)) is None:
                            if len(known) >= 256:
                                known.clear()
                            x = known[k] = bag_of(t.as_buffer().to_pybytes())
                        bags.append(x)
                    both, more, extra = overlap(*bags)
                    nu, nv = int(bags[0][1].sum()), int(bags[1][1].sum())
                    rows.append((both >= least * (nu + nv - both), nv, both, more.view(np.int64) if beyond else None, extra if beyond else None))
                alike, nv, both, more, extra = zip(*rows)
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(alike, pa.bool_()), pa.array(nv, pa.int64()), pa.array(both, pa.int64()), pa.array(more, pa.list_(pa.int64())), pa.array(extra, pa.list_(pa.int64()))], names=["u", "v", "alike", "nv", "both", "more", "extra"])

    return run


def near_duplicate_classes(docs: DataFrame, text: str = "text", shingle: int = 5, least: float = 0.8, bands: int = 24, rows: int = 4, go_on: float = 0.05) -> DataFrame:
    """docs with class_id (long): equal for two rows that a chain of texts with likeness >= `least` links.

    class_id numbers one of the class's rows. Texts of equal words in a row are one class, whatever white space separates
    them; null, empty and blank texts are one class as well. An empty table gives an empty one. Other columns pass unchanged;
    one named class_id is replaced.
    """
    at = C.free_name(docs, "_key")[0]
    docs, names = C.numbered(docs, at), docs.columns
    keep = [c for c in names if c.lower() != "class_id"]
    src = docs.select(docs[at].alias("_key"), C.text_or_empty(docs[text]).alias("_text"))
    signed = C.materialize(src.transform(C.map_batches, _sign(shingle, bands, rows), "_key long, d1 long, d2 long, keys array<long>"), "signatures")
    one = C.materialize(signed.groupBy("d1", "d2").agg(F.min("_key").alias("rep"), F.first("keys").alias("keys")), "representatives")
    entries = one.select("rep", F.posexplode("keys").alias("band", "key")).select("rep", F.xxhash64("band", "key").alias("bucket"))
    shared = entries.groupBy("bucket").agg(F.count("*").alias("n")).filter("n > 1")
    full = entries.join(shared, "bucket").groupBy("rep").agg(F.sum("n").alias("score"), F.collect_list("bucket").alias("b"))
    entries = C.materialize(full.select("rep", F.struct((-F.col("score")).alias("s"), F.xxhash64("rep").alias("h"), "rep").alias("order"), F.explode("b").alias("bucket")), "entries")
    texts = C.materialize(src.join(entries.select(F.col("rep").alias("_key")).distinct().hint("merge"), "_key").select("_key", F.col("_text").cast("binary").alias("_text")), "candidates")

    def verified(pairs: DataFrame, beyond: bool = False) -> DataFrame:
        t = texts.select(F.col("_key").alias("v"), F.col("_text").alias("tv"))
        s = texts.select(F.col("_key").alias("u"), F.col("_text").alias("tu"))
        both = pairs.join(s, "u").join(t, "v").select("u", "v", "tu", "tv")
        return C.materialize(both.transform(C.map_batches, _verify(shingle, least, beyond), "u long, v long, alike boolean, nv long, both long, more array<long>, extra array<long>"), "verified")

    def untested(pairs: DataFrame, tested: DataFrame) -> DataFrame:
        for u, v in (("u", "v"), ("v", "u")):
            pairs = pairs.join(tested.select(F.col(u).alias("u"), F.col(v).alias("v")), ["u", "v"], "left_anti")
        return pairs

    links = lambda tested: tested.filter("alike").select("u", "v")

    def labelled(known: DataFrame) -> DataFrame:
        """entries of the buckets that still hold several components: with own component and the largest one there."""
        e = entries.join(known.toDF("rep", "comp"), "rep", "left").withColumn("comp", F.coalesce("comp", "rep"))
        size = e.groupBy("bucket", "comp").agg(F.count("*").alias("n"))
        several = size.groupBy("bucket").agg(F.count("*").alias("k"), F.max(F.struct("n", "comp")).alias("m")).filter("k > 1").select("bucket", F.col("m.comp").alias("main"))
        return C.materialize(e.join(several, "bucket"), "labelled")

    lead = entries.groupBy("bucket").agg(F.min("order").alias("l"))
    leaders = entries.join(lead, "bucket").groupBy("rep").agg(F.min("l").alias("l")).select("rep", F.col("l.rep").alias("leader"))
    first = verified(leaders.filter("rep != leader").select(F.col("leader").alias("u"), F.col("rep").alias("v")), beyond=True)
    tested = first.select("u", "v", "alike")
    known = components(links(first))
    while True:
        live = labelled(known)
        rest = live.filter("comp != main")
        lead = rest.groupBy("bucket").agg(F.min(F.struct("order", "comp")).alias("l")).select("bucket", F.col("l.order").alias("lo"), F.col("l.comp").alias("lc"))
        pairs = rest.join(lead, "bucket").filter("comp != lc").groupBy("rep").agg(F.min("lo").alias("l")).select(F.col("l.rep").alias("u"), F.col("rep").alias("v"))
        new = verified(untested(pairs, tested))
        n, linked = new.agg(F.count("*"), F.coalesce(F.sum(F.col("alike").cast("int")), F.lit(0))).first()
        tested = tested.union(new.select("u", "v", "alike"))
        if linked:
            known = joined(known, links(new))
        if linked <= go_on * n:
            break
    if linked:
        live = labelled(known)
    # the rest, exactly: all against their bucket's leader, and by that, against each other
    lead = live.groupBy("bucket").agg(F.min("order").alias("l")).select("bucket", F.col("l.rep").alias("leader"))
    alive = live.join(lead, "bucket").groupBy("leader", "rep", "comp").agg(F.max(F.col("comp") != F.col("main")).alias("out"))
    alive = C.materialize(alive.filter("leader != rep"), "alive")
    done = first.join(alive.select(F.col("leader").alias("u"), F.col("rep").alias("v")), ["u", "v"])
    new = verified(alive.select(F.col("leader").alias("u"), F.col("rep").alias("v")).join(first.select("u", "v"), ["u", "v"], "left_anti"), beyond=True)
    tested = tested.union(new.select("u", "v", "alike"))
    # what the leaders have joined by now needs no pair among itself
    known = joined(known, links(new))
    alive = alive.join(known.toDF("rep", "_comp"), "rep", "left").withColumn("comp", F.coalesce("_comp", "comp")).drop("_comp").groupBy("leader", "rep", "comp").agg(F.max("out").alias("out"))
    alive = C.materialize(alive.join(done.unionByName(new).select(F.col("u").alias("leader"), F.col("v").alias("rep"), "nv", "both", "more", "extra"), ["leader", "rep"]), "beyond")
    # overlap o reaches `least` only if o (1 + least) >= least (pn + nv), so sizes differ by `least` at most: cells of that ratio
    cell = lambda x: F.floor(F.log(F.greatest(x, F.lit(1.0))) / math.log(1 / least)).cast("int")
    reach = lambda o, pn, nv: o * (1 + least) >= (pn + nv) * least - 1e-6
    most = lambda o: o * ((1 + least) / least) - F.col("pn")  # noqa: E731  size of the largest text that an overlap of o can still do for
    # without anything shared beyond, o <= min(pb, both)
    mine = alive.filter("out").select("leader", F.col("rep").alias("p"), F.col("comp").alias("pc"), F.col("nv").alias("pn"), F.col("both").alias("pb"))
    lo, hi = F.col("pn") * least, most(F.col("pb"))
    sizes = mine.filter(hi >= lo).select("*", F.explode(F.sequence(cell(lo), cell(hi))).alias("cell"))
    near = sizes.join(alive.select("leader", "rep", "comp", "nv", "both", cell(F.col("nv")).alias("cell")), ["leader", "cell"]).filter((F.col("pc") != F.col("comp")) & reach(F.least("pb", "both"), F.col("pn"), F.col("nv")))
    # a text of n shingles, b of them in L, has to share n least - b of the n - b beyond: one of the first n (1 - least) and one more
    beyond = alive.select("leader", "rep", "comp", "out", "nv", "both", F.explode(F.arrays_zip("more", "extra")).alias("m")).select("leader", "rep", "comp", "out", "nv", "both", F.col("m.more").alias("x"), F.col("m.extra").alias("w"))
    often = beyond.groupBy("leader", "x").agg(F.count("*").alias("df"))
    own = Window.partitionBy("leader", "rep").orderBy("df", "x").rowsBetween(Window.unboundedPreceding, -1)
    rare = beyond.join(often, ["leader", "x"]).withColumn("before", F.coalesce(F.sum("w").over(own), F.lit(0))).filter((F.col("before") <= F.col("nv") * (1 - least) + 1e-6) & (F.col("df") > 1))
    # x the first that two share, they share at most what each has from there on; that bounds the other's size as well
    rare = C.materialize(rare.select("leader", "x", "rep", "comp", "out", "nv", "both", (F.col("nv") - F.col("both") - F.col("before")).alias("left")), "rare")

    def unsettled(rare: DataFrame) -> DataFrame:
        """The groups (leader, x) that hold several components, each with one of its members, m. Partial sums make them, so a common x is dealt over all tasks."""
        one = F.min(F.struct(F.xxhash64("rep").alias("h"), "rep", "comp", "nv", "both", "left"))
        return rare.groupBy("leader", "x").agg(F.min("comp").alias("_a"), F.max("comp").alias("_b"), F.max("out").alias("_o"), one.alias("m")).filter("_a != _b AND _o").select("leader", "x", "m")

    shared = reach(F.least("pb", "both") + F.least("pl", "left"), F.col("pn"), F.col("nv"))
    as_p = lambda df: df.select("leader", "x", F.col("rep").alias("p"), F.col("comp").alias("pc"), F.col("nv").alias("pn"), F.col("both").alias("pb"), F.col("left").alias("pl"))
    while True:  # stars of those that share x
        head = as_p(unsettled(rare).select("leader", "x", "m.*"))
        pairs = rare.join(head, ["leader", "x"]).filter((F.col("pc") != F.col("comp")) & shared).groupBy("rep").agg(F.min("p").alias("u")).select("u", F.col("rep").alias("v"))
        new = verified(untested(pairs, tested))
        n, linked = new.agg(F.count("*"), F.coalesce(F.sum(F.col("alike").cast("int")), F.lit(0))).first()
        tested = tested.union(new.select("u", "v", "alike"))
        if linked:
            known = joined(known, links(new))
            rare = rare.join(known.toDF("rep", "_comp"), "rep", "left").withColumn("comp", F.coalesce("_comp", "comp")).drop("_comp")
        if linked <= go_on * n:
            break
        rare = C.materialize(rare, "rare")
    rare = C.materialize(rare.join(unsettled(rare).select("leader", "x"), ["leader", "x"]), "rare")
    lo, hi = F.col("pn") * least, most(F.col("pb") + F.col("pl"))
    mine = as_p(rare.filter("out")).filter(hi >= lo).select("*", F.explode(F.sequence(cell(lo), cell(hi))).alias("cell"))
    more = mine.join(rare.withColumn("cell", cell(F.col("nv"))), ["leader", "x", "cell"]).filter((F.col("pc") != F.col("comp")) & shared)
    same = near.select("p", "rep").union(more.select("p", "rep")).select(F.least("p", "rep").alias("u"), F.greatest("p", "rep").alias("v"))
    last = verified(untested(same.distinct(), tested))
    comp = joined(known, links(last)).toDF("rep", "comp")
    of_text = one.select("d1", "d2", "rep").join(comp, "rep", "left").select("d1", "d2", F.coalesce("comp", "rep").alias("class_id"))
    classes = signed.select("_key", "d1", "d2").join(of_text, ["d1", "d2"]).select("_key", "class_id")
    rest = docs.select(docs[at].alias("_key"), *[docs[c].alias(f"_c{i}") for i, c in enumerate(keep)])
    return rest.join(classes, "_key").select(*[F.col(f"_c{i}").alias(c) for i, c in enumerate(keep)], "class_id")


def deduplicate(docs: DataFrame, text: str = "text", key: str = "doc_id", **kw) -> DataFrame:
    """One row of each near-duplicate class: that with the smallest `key` (nulls last), of equal ones any. Columns as in docs.

    The rows are told apart by their place, so equal rows give one."""
    at, cols = C.free_name(docs, "_row")[0], docs.columns
    docs = C.numbered(docs, at)
    rows = docs.select(docs[at].alias("_row"), docs[text].alias("_text"), docs[key].alias("_id"))
    found = near_duplicate_classes(rows, text="_text", **kw).select("_row", "_id", "class_id")
    first = found.groupBy("class_id").agg(F.min(F.struct(F.col("_id").isNull(), "_id", "_row")).alias("m")).select(F.col("m._row").alias("_row"))
    all_ = docs.select(docs[at].alias("_row"), *[docs[c].alias(f"_c{i}") for i, c in enumerate(cols)])
    return all_.join(first, "_row", "left_semi").select(*[F.col(f"_c{i}").alias(c) for i, c in enumerate(cols)])


def op2_minhash_dedup(spark, sf_dir: str) -> DataFrame:
    """One row per document: class_id is the smallest doc_id of its class."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    found = C.kept(spark, lambda: near_duplicate_classes(docs).select("doc_id", F.col("class_id").alias("_class")), "classes")
    low = found.groupBy("_class").agg(F.min("doc_id").alias("class_id"), F.count("*").alias("class_size"))
    return found.join(low, "_class").select("doc_id", "class_id", "class_size")
