"""Shared plumbing of the text operators: the cluster's shared folder, row keys, and word arithmetic on Arrow buffers."""

from __future__ import annotations

import ctypes
import re
import uuid
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space that separates words: space and \t..\r, all below 0x80, so bytes of UTF-8 can be tested one by one.
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True

_BASE, _STEP = 0x9E3779B97F4A7C15 | 1, 0xD6E8FEB86659FD93 | 1
#: Bytes that one vectorised step works on; a longer text makes a step of its own.
STEP_BYTES = 1 << 20
#: Bytes of an Arrow batch between the JVM and Python.
BATCH_BYTES = 4 << 20


def shared_dir(spark: SparkSession) -> str:
    """A folder that the driver and all executors see: spark.checkpoint.dir. Where that is unset, local mode has one of its own; a cluster has none."""
    said = spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if said is None and (d := spark.sparkContext._jsc.sc().getCheckpointDir()).isDefined():
        said = d.get()
    if said is None:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir has to name a folder that the driver and all executors share")
        said = "/tmp/checkpoints"
    return said.rstrip("/")


def materialize(df: DataFrame, tag: str) -> DataFrame:
    """Write df to the shared folder and read it back: what follows no longer depends on df's lineage nor computes it twice."""
    path = f"{shared_dir(df.sparkSession)}/{tag}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    for tables in _scopes:
        tables.append(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: Tables written since each open call of kept().
_scopes: list[list[str]] = []


def kept(spark: SparkSession, build, tag: str) -> DataFrame:
    """The table that build() gives, written to the shared folder; the tables that build() wrote there on its way are deleted."""
    _scopes.append(made := [])
    try:
        out = materialize(build(), tag)
    finally:
        _scopes.pop()
    gone = set(made[:-1])
    for path in gone:
        p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
    for tables in _scopes:
        tables[:] = [t for t in tables if t not in gone]
    return out


def _parquet_files(df: DataFrame) -> list[str] | None:
    """The files of df, if it has at most one row for each row of Parquet files: columns and filters that give the same in each scan."""
    plan = df._jdf.queryExecution().analyzed()
    if not plan.deterministic():
        return None
    while (kind := plan.getClass().getSimpleName()) in ("Project", "Filter", "SubqueryAlias"):
        plan = plan.children().apply(0)
    if kind != "LogicalRelation" or (found := plan.relation()).getClass().getSimpleName() != "HadoopFsRelation" or found.fileFormat().getClass().getSimpleName() != "ParquetFileFormat":
        return None
    return [re.sub("^file:///", "file:/", f) for f in found.location().inputFiles()]


def numbered(df: DataFrame, name: str) -> DataFrame:
    """df with a long `name`, one for each row and the same in every scan, however the files are split.

    In Parquet files it is made of the file's name and the row's place in that file. Other tables are numbered as they are written to the
    shared folder, once, and come from there; so are files whose names have a checksum in common.
    """
    files = _parquet_files(df)
    if files is not None and len({zlib.crc32(f.encode()) for f in files}) == len(files):
        at = df.metadataColumn("_metadata")
        return df.select("*", F.shiftleft(F.crc32(at["file_path"].cast("binary")), 31).bitwiseOR(at["row_index"]).alias(name))
    void = {c for c, kind in df.dtypes if kind == "void"}  # Parquet has no such type
    rows = materialize(df.select(*[df[c] for c in df.columns if c not in void], F.monotonically_increasing_id().alias(name)), "rows")
    return rows.select(*[F.lit(None).alias(c) if c in void else rows[c] for c in [*df.columns, name]])


def _tidy(run):
    """run; at a partition's end, memory that it has left goes back to the system, as workers live on for other tasks."""

    def whole(batches):
        yield from run(batches)
        pa.default_memory_pool().release_unused()
        if (trim := getattr(ctypes.CDLL(None), "malloc_trim", None)) is not None:
            trim(0)

    return whole


def map_batches(df: DataFrame, run, schema: str) -> DataFrame:
    """df.mapInArrow(run, schema), by batches of 4 MB at most: the JVM and Python hold some of them for each task.

    The session's own limit stays where it is lower; else it is set to this."""
    conf, key = df.sparkSession.conf, "spark.sql.execution.arrow.maxBytesPerBatch"
    n, unit = re.fullmatch(r"(-?\d+)([kmgt]?)i?b?", conf.get(key).strip().lower()).groups()
    if not 0 < int(n) * 1024 ** " kmgt".index(unit or " ") <= BATCH_BYTES:
        conf.set(key, str(BATCH_BYTES))
    return df.mapInArrow(_tidy(run), schema)


def free_name(df: DataFrame, *wanted: str) -> list[str]:
    """Column names like those wanted that df doesn't use in any case."""
    taken, out = {c.lower() for c in df.columns}, []
    for w in wanted:
        while w.lower() in taken:
            w += "_"
        taken.add(w.lower())
        out.append(w)
    return out


def text_or_empty(c: str | Column = "text") -> Column:
    return F.coalesce(F.col(c) if isinstance(c, str) else c, F.lit(""))


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


# ---------------------------------------------------------------- words of Arrow columns


def buffers(col) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of a string or binary column (null: empty) and the n + 1 offsets of its rows."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    if isinstance(col, pa.ChunkedArray):
        col = pa.concat_arrays(col.chunks) if col.num_chunks else pa.array([], pa.large_binary())
    col = col.cast(pa.large_binary())
    if col.null_count:
        col = col.fill_null(b"")
    n = len(col)
    if not n:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offs, data = col.buffers()
    offs = np.frombuffer(offs, np.int64)[col.offset : col.offset + n + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[offs[0] : offs[-1]], offs - offs[0]


def steps(offs: np.ndarray, most: int = STEP_BYTES):
    """Ranges [a, b) of rows with at most so many bytes together, one row at least."""
    a, n = 0, len(offs) - 1
    while a < n:
        b = max(a + 1, int(np.searchsorted(offs, offs[a] + most, "right")) - 1)
        yield a, min(b, n)
        a = b


class Powers:
    """Powers of an odd number and of its inverse modulo 2**64, as many as were asked for so far."""

    def __init__(self, base: int):
        self.base, self.inv = base, pow(base, -1, 1 << 64)
        self.up = self.down = np.ones(1, np.uint64)

    def get(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            size = max(n, 2 * len(self.up), 1 << 12)
            up, down = np.full(size, self.base, np.uint64), np.full(size, self.inv, np.uint64)
            up[0] = down[0] = 1
            self.up, self.down = np.multiply.accumulate(up), np.multiply.accumulate(down)
        return self.up[:n], self.down[:n]


_BYTES, _WORDS = Powers(_BASE), Powers(_STEP)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection on 64 bits (the finaliser of splitmix64)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def prefix_hash(raw: np.ndarray) -> np.ndarray:
    """n + 1 sums from which span_hash() takes the hash of any span."""
    up, _ = _BYTES.get(len(raw) + 1)
    out = np.zeros(len(raw) + 1, np.uint64)
    np.cumsum((raw.astype(np.uint64) + np.uint64(1)) * up[: len(raw)], out=out[1:])
    return out


def span_hash(sums: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    _, down = _BYTES.get(len(sums))
    return mix((sums[end] - sums[start]) * down[start])


class Words:
    """The words of some texts: start and end (bytes in raw), first (n + 1: index of each text's first word)."""

    def __init__(self, raw: np.ndarray, offs: np.ndarray, space: np.ndarray = _SPACE):
        self.raw, self.offs = raw, offs
        word = np.empty(len(raw) + 2, bool)
        word[0] = word[-1] = False
        np.logical_not(space[raw], out=word[1:-1])
        edge = word[1:] != word[:-1]
        # two texts can meet without white space between them
        inner = offs[1:-1]
        inner = inner[(inner > 0) & (inner < len(raw))]
        joined = np.unique(inner[word[inner] & word[inner + 1]]) if len(inner) else inner
        at = np.flatnonzero(edge)
        self.start, self.end = at[0::2], at[1::2]
        if len(joined):
            self.start = np.sort(np.concatenate([self.start, joined]))
            self.end = np.sort(np.concatenate([self.end, joined]))
        self.first = np.searchsorted(self.start, offs)

    def __len__(self):
        return len(self.start)

    def hashes(self) -> np.ndarray:
        return span_hash(prefix_hash(self.raw), self.start, self.end)

    def doc(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.first) - 1), np.diff(self.first))


def gram_hashes(h: np.ndarray, k: int) -> np.ndarray:
    """Hash of each k consecutive word hashes; those that span two texts are the caller's to drop (see gram_ok)."""
    n = len(h) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    up, down = _WORDS.get(len(h) + 1)
    sums = np.zeros(len(h) + 1, np.uint64)
    np.cumsum(h * up[: len(h)], out=sums[1:])
    return mix((sums[k:] - sums[:-k]) * down[:n])


def gram_ok(first: np.ndarray, n_words: int, k: int) -> np.ndarray:
    """True at each start of k words of one text."""
    n = n_words - k + 1
    if n <= 0:
        return np.zeros(0, bool)
    room = np.repeat(first[1:], np.diff(first))  # end of the text that a word is in
    return room[:n] - np.arange(n) >= k
