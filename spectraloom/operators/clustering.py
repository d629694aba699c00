"""Clusters: points linked within a distance over grid cells, spectra linked by likeness, and hierarchical trees of bounded groups."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.scratch import written


def connected(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """nodes (id: long) and edges (a, b) -> (id, cluster): cluster is the smallest id that a chain of edges reaches.

    Each round, all neighbours of a node above it, and the node, are tied to its smallest neighbour, then the same below; so a chain of
    n edges takes about log n rounds, and no cluster is gathered."""
    e = written(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u != v").distinct(), "links")
    while True:
        both = e.union(e.select("v", "u")).toDF("u", "v")
        low = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        up = both.join(low, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = up.groupBy("u").agg(F.min("v").alias("m"))
        down = up.join(least, "u").select(F.inline(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v"))))).filter("u != v").distinct()
        new = written(down, "links")
        same = new.count() == e.count() and new.join(e, ["u", "v"], "left_anti").isEmpty()
        e = new
        if same:
            break
    return nodes.select("id").distinct().join(e.toDF("id", "cluster"), "id", "left").select("id", F.coalesce("cluster", "id").alias("cluster"))


def _blocks(points: DataFrame, x_width: float, y_width: float, cells: int = 16) -> DataFrame:
    """points (id, x, y) with _own, once in the block (_i, _j) of `cells` x `cells` cells that they are in and in those within reach of them."""
    w, h = x_width * cells, y_width * cells
    reach = lambda c, width, block: F.sequence(F.floor((F.col(c) - width * (1 + 1e-9)) / block), F.floor((F.col(c) + width * (1 + 1e-9)) / block))
    p = points.select(F.col("id").cast("long").alias("id"), F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y")).dropna()
    p = p.withColumn("_i", F.explode(reach("x", x_width, w))).withColumn("_j", F.explode(reach("y", y_width, h)))
    return p.withColumn("_own", (F.floor(F.col("x") / w) == F.col("_i")) & (F.floor(F.col("y") / h) == F.col("_j")))


def _pairs_within(x: np.ndarray, y: np.ndarray, x_width: float, y_width: float, most: int = 1 << 19):
    """Chunks (i, j, d) of the pairs of a block within the ellipse, each once. Strips of y hold points in order of x; so memory is bounded, however dense they are."""
    if not len(x):
        return
    strip = np.floor(y / y_width).astype(np.int64)
    order = np.lexsort((x, strip))
    xs, strips = x[order], strip[order]
    names, start = np.unique(strips, return_index=True)
    ends = dict(zip(names.tolist(), zip(start.tolist(), [*start[1:].tolist(), len(xs)])))
    for k, (a, b) in ends.items():
        for other in (k, k + 1):
            if other not in ends:
                continue
            c, e = ends[other]
            low = np.arange(a + 1, b + 1) if other == k else c + np.searchsorted(xs[c:e], xs[a:b] - x_width * (1 + 1e-9), "left")
            n = np.maximum(c + np.searchsorted(xs[c:e], xs[a:b] + x_width * (1 + 1e-9), "right") - low, 0)
            upto = np.cumsum(n)
            at = 0
            while at < len(n):
                to = max(at + 1, int(np.searchsorted(upto, (upto[at - 1] if at else 0) + most, "right")))
                m = n[at:to]
                i = np.repeat(np.arange(a + at, a + to), m)
                j = np.repeat(low[at:to], m) + np.arange(m.sum()) - np.repeat(np.cumsum(m) - m, m)
                i, j, at = order[i], order[j], to
                u, v = (x[i] - x[j]) / x_width, (y[i] - y[j]) / y_width
                d = np.sqrt(u * u + v * v)
                ok = d <= 1
                yield i[ok], j[ok], d[ok]


def near_points(points: DataFrame, x_width: float, y_width: float) -> DataFrame:
    """points (id, x, y) -> (a, b, d): pairs a < b within the ellipse of these half axes, d being the scaled distance (at most 1).

    Points are shuffled once, to blocks of cells; a pair is found where its smaller id's block is, and goes out as it is found."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f = pa.Table.from_batches(batches).to_pandas()
        ids, own = f["id"].to_numpy(), f["_own"].to_numpy()
        for i, j, d in _pairs_within(f["x"].to_numpy(), f["y"].to_numpy(), x_width, y_width):
            swap = ids[i] > ids[j]
            i, j = np.where(swap, j, i), np.where(swap, i, j)
            ok = own[i] & (ids[i] < ids[j])
            yield pa.RecordBatch.from_arrays([ids[i][ok], ids[j][ok], d[ok]], names=["a", "b", "d"])

    return _blocks(points, x_width, y_width).groupBy("_i", "_j").applyInArrow(run, "a long, b long, d double")


def _roots(n: int, pairs) -> np.ndarray:
    """Smallest member of each member's component, of chunks (i, j, ..) of pairs."""
    root = np.arange(n)
    for i, j, *_ in pairs:
        while True:
            a, b = root[i], root[j]
            apart = a != b
            if not apart.any():
                break
            i, j, a, b = i[apart], j[apart], a[apart], b[apart]
            np.minimum.at(root, np.maximum(a, b), np.minimum(a, b))
            while True:
                up = root[root]
                if (up == root).all():
                    break
                root = up
    return root


def grid_clusters(points: DataFrame, x_width: float, y_width: float) -> DataFrame:
    """points with cluster (single linkage up to the scaled distance 1), its centre (cx, cy) and size n.

    A block's points are linked in one task; blocks then meet in the points that they share, so what is left to link are not pairs of
    points but pairs of the blocks' own clusters."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f = pa.Table.from_batches(batches).to_pandas().sort_values("id", kind="stable")
        ids, own, x, y = f["id"].to_numpy(), f["_own"].to_numpy(), f["x"].to_numpy(), f["y"].to_numpy()
        root = _roots(len(f), _pairs_within(x, y, x_width, y_width))
        # a point of its own block is named by its block's cluster; one from around ties its cluster to what it is called at home
        yield pa.RecordBatch.from_arrays([ids, ids[root], own], names=["id", "root", "own"])

    part = written(_blocks(points, x_width, y_width).groupBy("_i", "_j").applyInArrow(run, "id long, root long, own boolean").distinct(), "parts")
    shared = part.filter("NOT own").select("id", F.col("root").alias("b"))
    ties = shared.join(part.filter("own").select("id", F.col("root").alias("a")), "id").select("a", "b").distinct()
    whole = connected(part.select(F.col("root").alias("id")), ties).select(F.col("id").alias("root"), "cluster")
    label = part.filter("own").join(whole, "root").select("id", "cluster")
    rows = points.join(label, "id")
    centre = rows.groupBy("cluster").agg(F.avg("x").alias("cx"), F.avg("y").alias("cy"), F.count("*").alias("n"))
    return rows.join(centre, "cluster")


#: Spectra of a block at most, about; two blocks are compared in one task.
_BLOCK = 2000
_BINS = 512


def _compared(peaks: DataFrame, precursors: DataFrame, width: float, bin_size: float, schema: str, take) -> DataFrame:
    """take(ids of the left, ids of the right, rows of the left from, likeness matrix) over all pairs of blocks whose precursors are within `width`.

    Spectra of a cell of the precursor are dealt to blocks; each pair of blocks of a cell and the next is one group, which a product of
    matrices compares, 256 rows at a time. A spectrum is shuffled once for each block that it meets, its pairs never."""
    v = peaks.groupBy("spectrum_id", F.floor(F.col("mz") / bin_size).cast("long").alias("bin")).agg(F.sum("intensity").cast("double").alias("i"))
    v = v.groupBy("spectrum_id").agg(F.collect_list("bin").alias("bins"), F.collect_list("i").alias("values"), F.sqrt(F.sum(F.col("i") * F.col("i"))).alias("_n")).filter("_n > 0")
    c = precursors.select("spectrum_id", F.col("precursor_mz").cast("double").alias("_p"), F.floor(F.col("precursor_mz") / width).alias("_c")).dropna()
    sizes = c.groupBy("_c").agg(F.ceil(F.count("*") / _BLOCK).cast("int").alias("_k"))
    c = c.join(sizes, "_c").withColumn("_b", F.pmod(F.xxhash64("spectrum_id"), F.col("_k")).cast("int"))
    after = sizes.select((F.col("_c") - 1).alias("_c"), F.col("_k").alias("_after"))
    before = sizes.select((F.col("_c") + 1).alias("_c"), F.col("_k").alias("_before"))
    c = written(c.join(after, "_c", "left").join(before, "_c", "left").join(v, "spectrum_id"), "spectra")
    cell, block = F.col("_c"), F.col("_b")
    to = lambda n: F.sequence(F.lit(0), n - 1)
    pair = lambda c1, b1, c2, b2, side: F.struct(c1.alias("c1"), b1.alias("b1"), c2.alias("c2"), b2.alias("b2"), F.lit(side).alias("side"))
    none = F.array().cast("array<struct<c1:bigint,b1:int,c2:bigint,b2:int,side:int>>")
    met = F.concat(
        F.transform(F.sequence(block, F.col("_k") - 1), lambda k: pair(cell, block, cell, k, 0)),
        F.transform(F.filter(to(F.col("_k")), lambda k: k < block), lambda k: pair(cell, k, cell, block, 1)),
        F.coalesce(F.transform(to(F.col("_after")), lambda k: pair(cell, block, cell + 1, k, 0)), none),
        F.coalesce(F.transform(to(F.col("_before")), lambda k: pair(cell - 1, k, cell, block, 1)), none),
    )
    rows = c.select("spectrum_id", "_p", "bins", "values", "_n", F.inline(met))

    def run(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = pa.Table.from_batches(batches)
        one = key[0].as_py() == key[2].as_py() and key[1].as_py() == key[3].as_py()
        side = t["side"].to_numpy()

        def half(k):
            m = t.filter(pa.array(side == k))
            n = np.array([len(x) for x in m["bins"].to_pylist()], np.int64)
            flat = lambda name: m[name].combine_chunks().flatten().to_numpy(zero_copy_only=False)
            norm = m["_n"].to_numpy()
            return m["spectrum_id"].to_numpy(), m["_p"].to_numpy(), np.repeat(np.arange(len(n)), n), flat("bins"), flat("values") / np.repeat(norm, n)

        a = half(0)
        b = a if one else half(1)
        if not len(a[0]) or not len(b[0]):
            return
        names = np.unique(np.concatenate([a[3], b[3]]))
        parts = [(s[0], s[1], s[2], np.searchsorted(names, s[3]), s[4]) for s in (a, b)]
        for r in range(0, len(a[0]), 256):
            n = min(256, len(a[0]) - r)
            like = np.zeros((n, len(b[0])))
            for k in range(0, len(names), _BINS):
                dense = []
                for (ids, _, row, bin_, x), lo, size in zip(parts, (r, 0), (n, len(b[0]))):
                    ok = (bin_ >= k) & (bin_ < k + _BINS) & (row >= lo) & (row < lo + size)
                    m = np.zeros((size, min(_BINS, len(names) - k)))
                    m[row[ok] - lo, bin_[ok] - k] = x[ok]
                    dense.append(m)
                like += dense[0] @ dense[1].T
            near = np.abs(a[1][r : r + n, None] - b[1][None]) <= width
            if one:
                near &= a[0][r : r + n, None] < b[0][None]
            like[~near] = -np.inf
            yield from take(a[0][r : r + n], b[0], like)

    return rows.groupBy("c1", "b1", "c2", "b2").applyInArrow(run, schema)


def similar_spectra(peaks: DataFrame, precursors: DataFrame, width: float, bin_size: float, least: float) -> DataFrame:
    """(a, b, cosine): spectra a < b whose precursors lie within `width` and whose binned intensities have that cosine or more."""

    def take(a, b, like):
        i, j = np.nonzero(like >= least)
        x, y = a[i], b[j]
        yield pa.RecordBatch.from_arrays([np.minimum(x, y), np.maximum(x, y), like[i, j]], names=["a", "b", "cosine"])

    return _compared(peaks, precursors, width, bin_size, "a long, b long, cosine double", take)


def cluster_spectra(peaks: DataFrame, precursors: DataFrame, width: float, bin_size: float = 10.0, least: float = 0.7) -> DataFrame:
    """(spectrum_id, cluster): single linkage of the pairs of similar_spectra; a spectrum without a like one is its own cluster.

    Of the pairs of 256 spectra with a block, only enough go out to link the same ones: fewer than there are spectra."""

    def take(a, b, like):
        both, at = np.unique(np.concatenate([a, b]), return_inverse=True)
        u, v = at[: len(a)], at[len(a) :]
        root = _roots(len(both), ((np.full(j.size, u[i]), v[j]) for i, j in enumerate(np.nonzero(row)[0] for row in like >= least)))
        ok = root != np.arange(len(both))
        yield pa.RecordBatch.from_arrays([both[root[ok]], both[ok]], names=["a", "b"])

    nodes = precursors.select(F.col("spectrum_id").alias("id"))
    edges = _compared(peaks, precursors, width, bin_size, "a long, b long", take)
    return connected(nodes, edges).select(F.col("id").alias("spectrum_id"), "cluster")


# ---------------------------------------------------------------- trees of bounded groups


def linkage(distance: np.ndarray, method: str = "average") -> list[tuple[int, int, float]]:
    """Merges (a, b, height) of a symmetric distance matrix; a cluster is named by its smallest member, and a < b. Ties go to the smallest pair.

    method: single, complete or average (of all pairs of members)."""
    d = np.array(distance, float)
    n = len(d)
    np.fill_diagonal(d, np.inf)
    size, alive, out = np.ones(n), np.ones(n, bool), []
    for _ in range(n - 1):
        a, b = divmod(int(np.argmin(d)), n)
        a, b = min(a, b), max(a, b)
        out.append((a, b, float(d[a, b])))
        row = {"single": np.minimum(d[a], d[b]), "complete": np.maximum(d[a], d[b]), "average": (size[a] * d[a] + size[b] * d[b]) / (size[a] + size[b])}[method]
        row[~alive] = np.inf
        row[[a, b]] = np.inf
        d[a], d[:, a] = row, row
        d[b], d[:, b] = np.inf, np.inf
        alive[b] = False
        size[a] += size[b]
    return out


def cut(merges: list[tuple[int, int, float]], n: int, clusters: int | None = None, height: float | None = None) -> np.ndarray:
    """Label of each member (its cluster's smallest) after the merges that leave so many clusters, or those up to that height."""
    label = np.arange(n)
    for k, (a, b, h) in enumerate(merges):
        if (clusters is not None and n - k <= clusters) or (height is not None and h > height):
            break
        label[label == b] = a
    return label


def silhouette(distance: np.ndarray, label: np.ndarray) -> float:
    """Mean over members of (b - a) / max(a, b): a the mean distance within the own cluster, b the least one to another; 0 for single members."""
    names = np.unique(label)
    if len(names) < 2:
        return 0.0
    sums = np.stack([distance[:, label == k].sum(1) for k in names], 1)
    sizes = np.array([(label == k).sum() for k in names])
    own = np.searchsorted(names, label)
    at = np.arange(len(label))
    a = np.where(sizes[own] > 1, sums[at, own] / np.maximum(sizes[own] - 1, 1), 0)
    other = sums / sizes
    other[at, own] = np.inf
    b = other.min(1)
    return float(np.where(sizes[own] > 1, (b - a) / np.maximum(np.maximum(a, b), 1e-300), 0).mean())


def hierarchical(points: DataFrame, key: tuple, columns: tuple, method: str = "average", height: float = 1.0, most: int = 4000) -> DataFrame:
    """points (id: long, columns) with cluster: trees of each key's Euclidean distances, cut at a height; named by the smallest id.

    A key's distances are one task's matrix; a key with over `most` points is an error: give it a finer key or use grid_clusters."""

    def run(f: pd.DataFrame) -> pd.DataFrame:
        if len(f) > most:
            raise ValueError(f"{len(f)} points of one key; at most {most}")
        f = f.sort_values("id", kind="stable")
        x = f[list(columns)].to_numpy(float)
        d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(2))
        return f.assign(cluster=f["id"].to_numpy()[cut(linkage(d, method), len(f), height=height)])

    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in points.schema), "cluster long"])
    return points.groupBy(*key).applyInPandas(run, schema)
