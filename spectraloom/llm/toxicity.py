"""Toxicity by non-negative positive-unlabelled learning.

Features are the presence of words (runs of letters, digits and non-ASCII characters, lower case) and of their beginnings.
Confirmed toxic texts name the candidates; those that are clearly rarer in unlabelled text stay. A logistic model is trained in
numpy on confirmed toxic (P) and unlabelled (U) texts with the risk

    pi * R+(P) + max(0, R-(U) - pi * R-(P)),

whose second part is the risk on negatives, corrected by the class prior pi; where it would go below 0, its gradient is
turned round. A last logistic step of two parameters on labelled training rows makes scores probabilities.

Corpus counts are of all texts given. For fitting, all texts with equal label and features are one row with their number as weight;
of more than about ``most_unlabelled`` such rows (``most_labelled`` of either label) those of small weight are drawn in proportion to
it and weigh more instead. Labels are of at most ``most_labelled`` ids of either kind, by order of a hash. Scoring covers all whole texts, by a table of at most ``most_features`` features.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common as C

_OTHER = np.ones(256, bool)
_OTHER[[*range(ord("0"), ord("9") + 1), *range(ord("a"), ord("z") + 1), *range(0x80, 0x100)]] = False
_PREFIXES = (4, 5, 6, 7, 8, 9, 10, 12)
_TABLE_BITS = 20


def _features(raw: np.ndarray, offs: np.ndarray):
    """(text, 64-bit feature) of all words and of their beginnings, repeats included, a part at a time."""
    w = C.Words(raw, offs, _OTHER)
    sums, doc = C.prefix_hash(raw), w.doc()
    yield doc, C.span_hash(sums, w.start, w.end)
    size = w.end - w.start
    for n in _PREFIXES:
        long = np.flatnonzero(size > n)
        yield doc[long], C.span_hash(sums, w.start[long], w.start[long] + n)


@dataclass(frozen=True)
class Model:
    """features (sorted), their weights, bias; a and b make the sum a probability."""

    features: np.ndarray
    weights: np.ndarray
    bias: float
    a: float
    b: float

    def table(self) -> np.ndarray:
        out = np.zeros(1 << _TABLE_BITS, bool)
        out[(self.features & np.uint64((1 << _TABLE_BITS) - 1)).astype(np.int64)] = True
        return out


def present(raw: np.ndarray, offs: np.ndarray, features: np.ndarray, table: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (text, index of a known feature), in order."""
    found = []
    for doc, f in _features(raw, offs):
        maybe = np.flatnonzero(table[(f & np.uint64((1 << _TABLE_BITS) - 1)).astype(np.int64)])
        at = np.minimum(np.searchsorted(features, f[maybe]), max(len(features) - 1, 0))
        hit = features[at] == f[maybe] if len(features) else np.zeros(0, bool)
        found.append(doc[maybe][hit] * max(len(features), 1) + at[hit])
    pair = np.unique(np.concatenate(found))
    return pair // max(len(features), 1), pair % max(len(features), 1)


def _count(batches):
    """Number of texts that hold each feature, in this partition."""
    ids, counts = np.zeros(0, np.uint64), np.zeros(0, np.int64)
    for b in batches:
        raw, offs = C.buffers(b.column(0))
        for i, j in C.steps(offs):
            each = [(d, f) for d, f in _features(raw[offs[i] : offs[j]], offs[i : j + 1] - offs[i])]
            doc, f = np.concatenate([d for d, _ in each]), np.concatenate([f for _, f in each])
            order = np.lexsort((f, doc))
            doc, f = doc[order], f[order]
            new = np.ones(len(f), bool)
            new[1:] = (doc[1:] != doc[:-1]) | (f[1:] != f[:-1])
            own, n = np.unique(f[new], return_counts=True)
            all_, inv = np.unique(np.concatenate([ids, own]), return_inverse=True)
            ids, counts = all_, np.bincount(inv, np.concatenate([counts, n]), len(all_)).astype(np.int64)
    for lo in range(0, len(ids), 50_000):
        yield pa.RecordBatch.from_arrays([pa.array(ids[lo : lo + 50_000].view(np.int64)), pa.array(counts[lo : lo + 50_000])], names=["feature", "n"])


def _tally(features: np.ndarray):
    """Rows (kind, at, n): in this partition, the number of texts of a kind that hold feature number `at`; at -1: of all of them."""
    table = Model(features, features, 0, 0, 0).table()
    width = len(features) + 1

    def run(batches):
        counts = np.zeros((3, width), np.int64)  # kinds -1, 0, 1
        for b in batches:
            kind = np.asarray(b.column(0)).astype(np.int64)
            side = np.where(kind > 0, 2, np.where(kind < 0, 0, 1))
            counts[:, 0] += np.bincount(side, minlength=3)
            raw, offs = C.buffers(b.column(1))
            for i, j in C.steps(offs):
                doc, at = present(raw[offs[i] : offs[j]], offs[i : j + 1] - offs[i], features, table)
                counts += np.bincount(side[i:j][doc] * width + at + 1, minlength=3 * width).reshape(3, width)
        side, at = np.nonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array((side - 1).astype(np.int32)), pa.array((at - 1).astype(np.int32)), pa.array(counts[side, at])], names=["kind", "at", "n"])

    return run


def _lists(features: np.ndarray):
    table = Model(features, features, 0, 0, 0).table()

    def run(batches):
        for b in batches:
            raw, offs = C.buffers(b.column(1))
            for i, j in C.steps(offs):
                doc, at = present(raw[offs[i] : offs[j]], offs[i : j + 1] - offs[i], features, table)
                cut = np.searchsorted(doc, np.arange(j - i + 1)).astype(np.int32)
                yield pa.RecordBatch.from_arrays([b.column(0).slice(i, j - i), pa.ListArray.from_arrays(pa.array(cut), pa.array(at.astype(np.int32)))], names=["kind", "at"])

    return run


def nn_pu(p: np.ndarray, u: np.ndarray, prior: float, steps: int = 300, rate: float = 0.05, l2: float = 1e-4, n_p: np.ndarray | None = None, n_u: np.ndarray | None = None) -> tuple[np.ndarray, float]:
    """Weights and bias of the logistic model with least non-negative PU risk (Adam, all rows in each step). n_p, n_u: how often rows count."""
    n_p, n_u = ((np.ones(len(x)) if n is None else n) for x, n in ((p, n_p), (u, n_u)))
    n_p, n_u = ((n / n.sum()).astype(np.float32) for n in (n_p, n_u))
    sig = lambda z: 1 / (1 + np.exp(-np.clip(z, -30, 30)))
    w = np.zeros(p.shape[1] + 1, np.float32)
    p, u = (np.hstack([x, np.ones((len(x), 1), np.float32)]) for x in (p, u))
    m, v = np.zeros_like(w), np.zeros_like(w)
    for t in range(1, steps + 1):
        zp, zu = p @ w, u @ w
        # logistic loss: softplus(-z) as positive, softplus(z) as negative
        negative = np.logaddexp(0, zu) @ n_u - prior * (np.logaddexp(0, zp) @ n_p)
        g_pos = p.T @ (-sig(-zp) * n_p) * prior
        g_neg = u.T @ (sig(zu) * n_u) - p.T @ (sig(zp) * n_p) * prior
        g = (g_pos + g_neg if negative >= 0 else -g_neg) + l2 * np.append(w[:-1], 0)
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        w = (w - rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)).astype(np.float32)
    return w[:-1], float(w[-1])


def _calibrate(z: np.ndarray, y: np.ndarray, n: np.ndarray) -> tuple[float, float]:
    """a, b of the probability 1 / (1 + exp(-(a z + b))), by Newton's method; a isn't negative. Row i counts n[i] times."""
    target = np.where(y == 1, (y @ n + 1) / (y @ n + 2), 1 / ((1 - y) @ n + 2))
    mid = np.average(z, weights=n)
    scale = np.sqrt(np.average((z - mid) ** 2, weights=n)) or 1.0
    x = np.stack([(z - mid) / scale, np.ones(len(z))], 1)
    t = np.zeros(2)
    for _ in range(50):
        q = 1 / (1 + np.exp(-np.clip(x @ t, -30, 30)))
        h = (x * ((q * (1 - q) + 1e-6) * n)[:, None]).T @ x + 1e-3 * np.eye(2)
        t -= np.clip(np.linalg.solve(h, x.T @ ((q - target) * n) + 1e-3 * t), -2, 2)
    a = max(t[0], 0.0) / scale
    return float(a), float(t[1] - a * mid)


def held_out(doc_id: Column) -> Column:
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))) % 3 == 1


def train(docs: DataFrame, labels: DataFrame, text: str = "text", key: str = "doc_id", label: str = "toxic", most_labelled: int = 8000, most_unlabelled: int = 12000, most_features: int = 512, min_share: float = 0.01) -> Model:
    """Fit on the labels given (leave out what is to be held out) and on docs as unlabelled text.

    Rows of labels without an id or label are ignored; an id with several labels has the largest. Without any toxic row that has a
    text, the model has no features and the score is the same, low, for all.
    """
    lab = labels.filter(F.col(label).isNotNull() & F.col(key).isNotNull()).groupBy(F.col(key).alias("_id")).agg(F.max(label).cast("int").alias("_y"))
    counts = {int(r["_y"] > 0): r["n"] for r in lab.groupBy(F.col("_y") > 0).agg(F.max("_y").alias("_y"), F.count("*").alias("n")).collect()}
    n_pos, n_neg = counts.get(1, 0), counts.get(0, 0)
    prior = min(max(n_pos / max(n_pos + n_neg, 1), 1e-3), 0.9)
    first = lambda y: lab.filter((F.col("_y") > 0) == F.lit(y)).orderBy(F.xxhash64("_id", F.lit(11)), "_id").limit(most_labelled)
    chosen = first(True).union(first(False))  # of bounded size: sent to all executors
    base = docs.select(docs[key].alias("_id"), F.lower(C.text_or_empty(docs[text])).alias("_text"))
    labelled = base.join(F.broadcast(chosen), "_id")
    known = labelled.filter("_y > 0").select("_text").transform(C.map_batches, _count, "feature long, n long").groupBy("feature").agg(F.sum("n").alias("n"))
    least = max(2, int(min_share * min(n_pos, most_labelled)))
    rows = known.filter(F.col("n") >= least).select("feature").toPandas()["feature"].to_numpy(np.int64)
    features = np.sort(rows.view(np.uint64))
    both = labelled.select((F.col("_y") > 0).cast("int").alias("kind"), "_text").union(base.select(F.lit(-1).alias("kind"), "_text"))
    tally = both.select("kind", "_text").transform(C.map_batches, _tally(features), "kind int, at int, n long").groupBy("kind", "at").agg(F.sum("n").alias("n")).toArrow()
    t_kind, t_at, t_n = (np.asarray(tally.column(c).combine_chunks()) for c in ("kind", "at", "n"))
    shares = []
    for side in (1, -1):
        n = np.zeros(len(features) + 1)
        n[t_at[t_kind == side] + 1] = t_n[t_kind == side]
        shares.append((n[0], n[1:] / max(n[0], 1)))
    (n_p, in_p), (n_u, in_u) = shares
    if not n_p or not n_u or not len(features):
        low = np.log(prior / (1 - prior)) if n_pos else -5.0
        return Model(np.zeros(0, np.uint64), np.zeros(0, np.float32), 0.0, 1.0, float(min(low, 0.0)))
    z = (in_p - in_u) / np.sqrt((in_u * (1 - in_u) + 1 / n_u) * (1 / n_p + 1 / n_u))
    top = np.argsort(-z, kind="stable")[:most_features]
    top = np.sort(top[(z[top] > 4) & (in_p[top] > 1.5 * in_u[top])])
    # equal rows are one with a weight; a row that stands for less than `unit` texts is kept with the probability weight / unit, and weighs unit
    rows = both.select("kind", "_text").transform(C.map_batches, _lists(features[top]), "kind int, at array<int>").groupBy("kind", "at").agg(F.count("*").alias("n"))
    n_of = {k: int(t_n[(t_kind == k) & (t_at == -1)].sum()) for k in (-1, 0, 1)}
    most = {-1: most_unlabelled, 0: most_labelled, 1: most_labelled}
    unit = F.element_at(F.array(*[F.lit(max(1.0, n_of[k] / most[k])) for k in (-1, 0, 1)]), F.col("kind") + 2)
    drawn = F.pmod(F.xxhash64("at", "kind", F.lit(12)), F.lit(1 << 30)) / float(1 << 30) * unit < F.col("n")
    got = rows.filter(drawn).select("kind", "at", F.greatest(F.col("n"), unit).alias("n")).toArrow()
    n = np.asarray(got.column("n").combine_chunks()).astype(float)
    kind = np.asarray(got.column("kind").combine_chunks())
    at = got.column("at").combine_chunks()
    size = np.asarray(at.value_lengths()) if len(at) else np.zeros(0, int)
    x = np.zeros((len(kind), len(top)), np.float32)
    x[np.repeat(np.arange(len(kind)), size), np.asarray(at.flatten())] = 1
    p, u = kind > 0, kind < 0
    w, bias = nn_pu(x[p], x[u], prior, n_p=n[p], n_u=n[u])
    lab_rows = kind >= 0
    a, b = _calibrate((x[lab_rows] @ w + bias).astype(float), (kind[lab_rows] > 0).astype(int), n[lab_rows]) if (kind == 0).any() else (1.0, 0.0)
    return Model(features[top], w, bias, a, b)


def _score(model: Model):
    def run(batches):
        table = model.table()
        for b in batches:
            raw, offs = C.buffers(b.column(b.num_columns - 1))
            z = np.full(b.num_rows, model.bias)
            for i, j in C.steps(offs):
                doc, at = present(raw[offs[i] : offs[j]], offs[i : j + 1] - offs[i], model.features, table)
                if len(doc):
                    z[i:j] += np.bincount(doc, model.weights[at], j - i)
            score = 1 / (1 + np.exp(-np.clip(model.a * z + model.b, -30, 30)))
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(score)], names=[*b.schema.names[:-1], "score"])

    return run


def score(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """docs with score (0 to 1, also for null and empty texts). Other columns pass unchanged; one named score is replaced."""
    keep = [c for c in docs.columns if c.lower() != "score"]
    src = docs.select(*[docs[c].alias(f"_c{i}") for i, c in enumerate(keep)], F.lower(C.text_or_empty(docs[text])).alias("_text"))
    schema = ", ".join([*(f"_c{i} {docs.schema[c].dataType.simpleString()}" for i, c in enumerate(keep)), "score double"])
    return src.transform(C.map_batches, _score(model), schema).select(*[F.col(f"_c{i}").alias(c) for i, c in enumerate(keep)], "score")


def train_on_folds(docs: DataFrame, labels: DataFrame, **kw) -> Model:
    """Model of the two folds that aren't held out, labels and unlabelled texts alike."""
    return train(docs.filter(~held_out(F.col("doc_id"))), labels.filter(~held_out(F.col("doc_id"))), **kw)


def op5_toxicity(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    model = train_on_folds(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    out = score(docs, model)
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))
