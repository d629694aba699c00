"""Quality rules: counts per text, base rules, and robust multivariate outliers per language and source.

Location and scatter of each group's statistic vectors are minimum-covariance-determinant estimates: C-steps (keep the h rows
nearest by Mahalanobis distance, take their mean and covariance again) from several starts; after two steps the starts of the
smallest determinants go on until the determinant stays; the smallest wins, and one reweighting follows. A C-step is one pass over
all rows: partial sums per group, start and cell of the squared distance (1/32 of an octave), then a running count over the cells
finds h; the cell at the edge counts with the share that makes it h exactly. So no group's rows meet in a task. A statistic that hardly
varies among a group's core (most texts have no symbols at all) has no scale of its own: its variance is raised to the square of the
statistic's resolution where it is below that. Other variances are the estimate's own.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import common as C

_SYMBOL = np.zeros(256, bool)
_SYMBOL[[ord(c) for c in "#*$%&|<>"]] = True
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
#: Statistic vector: name, expression over the counts, resolution: the least standard deviation that counts.
STATISTICS = (
    ("log_words", "ln(1.0D + n_words)", 0.3),
    ("log_word_chars", "ln((1.0D + word_chars) / (1.0D + n_words))", 0.02),
    ("log_symbols", "ln(1.0D + 100.0D * n_symbols / (1.0D + n_words))", 0.5),
    ("dup_lines", "ln(1.0D + 100.0D * n_dup_lines / (1.0D + n_words))", 0.4),
    ("repeats", "n_repeat_words / (1.0D + n_words)", 0.06),
)
_P = len(STATISTICS)
_PAIRS = [(i, j) for i in range(_P) for j in range(i, _P)]


# ---------------------------------------------------------------- counts of a text


def _counts(raw: np.ndarray, offs: np.ndarray) -> list[np.ndarray]:
    n = len(offs) - 1
    w = C.Words(raw, offs)
    n_words = np.diff(w.first)
    within = lambda flag: np.diff(np.concatenate([[0], np.cumsum(flag)])[offs])
    chars = within(((raw & 0xC0) != 0x80) & ~C._SPACE[raw])
    symbols = within(_SYMBOL[raw])
    # lines
    ends = np.flatnonzero(raw == 10)
    cuts = np.unique(np.concatenate([offs[:-1], ends + 1]))
    line_end = np.append(cuts[1:], len(raw))
    line_end = np.where((line_end > cuts) & (raw[np.maximum(line_end - 1, 0)] == 10), line_end - 1, line_end) if len(raw) else line_end
    has_word = np.searchsorted(w.start, line_end) > np.searchsorted(w.start, cuts)
    cuts, line_end = cuts[has_word], line_end[has_word]
    doc = np.searchsorted(offs, cuts, "right") - 1
    mark = C.span_hash(C.prefix_hash(raw), cuts, line_end)
    order = np.lexsort((mark, doc))
    same = (doc[order][1:] == doc[order][:-1]) & (mark[order][1:] == mark[order][:-1])
    dup_lines = np.bincount(doc[order][1:][same], minlength=n)
    # words in 3-word windows found twice
    h = w.hashes()
    at = np.flatnonzero(C.gram_ok(w.first, len(w), 3))
    doc = np.searchsorted(w.first, at, "right") - 1
    mark = C.gram_hashes(h, 3)[at] ^ C.mix(doc.astype(np.uint64))
    order = np.argsort(mark, kind="stable")
    same = mark[order][1:] == mark[order][:-1]
    twice = np.zeros(len(at), bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    cover = np.zeros(len(w) + 1, np.int8)
    for k in range(3):
        cover[at[twice] + k] = 1
    repeat = np.diff(np.concatenate([[0], np.cumsum(cover[:-1], dtype=np.int64)])[w.first])
    return [n_words, chars, symbols, dup_lines, repeat]


def _count(batches):
    for b in batches:
        raw, offs = C.buffers(b.column(b.num_columns - 1))
        for i, j in C.steps(offs):
            cols = [b.column(k).slice(i, j - i) for k in range(b.num_columns - 1)]
            yield pa.RecordBatch.from_arrays([*cols, *(pa.array(x.astype(np.int64)) for x in _counts(raw[offs[i] : offs[j]], offs[i : j + 1] - offs[i]))], names=[*b.schema.names[:-1], *COUNTS])


# ---------------------------------------------------------------- minimum covariance determinant


def chi2_cdf(k: int, x: float) -> float:
    a, x = k / 2, x / 2
    if x <= 0:
        return 0.0
    if x > 700:
        return 1.0
    term = total = 1 / a
    for n in range(1, 3000):
        term *= x / (a + n)
        total += term
        if term < 1e-17 * total:
            break
    return min(1.0, total * math.exp(-x + a * math.log(x) - math.lgamma(a)))


def chi2_quantile(k: int, q: float) -> float:
    lo, hi = 0.0, 400.0
    for _ in range(100):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if chi2_cdf(k, mid) < q else (lo, mid)
    return (lo + hi) / 2


def consistency(part: float) -> float:
    """What the covariance of the nearest `part` of normal rows has to be multiplied by."""
    return part / chi2_cdf(_P + 2, chi2_quantile(_P, part))


_PARAMS = "_g string, _start int, mean array<double>, inv array<double>, logdet double, moved double"


def _invert(scale: float, least: tuple):
    """Rows (group, start, n, sums, products, last logdet) to location, inverse scatter and how far the logdet moved."""
    floor = np.square(least)

    def run(frames):
        for f in frames:
            means, invs, dets = [], [], []
            for n, s, p in zip(f["n"], f["s"], f["p"]):
                m = np.asarray(s) / n
                cov = np.zeros((_P, _P))
                for (i, j), v in zip(_PAIRS, p):
                    cov[i, j] = cov[j, i] = v / n - m[i] * m[j]
                cov *= scale
                own = np.maximum(np.diag(cov), 0)
                np.fill_diagonal(cov, np.maximum(own * (1 + 1e-6), floor))
                means.append(m)
                invs.append(np.linalg.inv(cov).reshape(-1))
                dets.append(np.linalg.slogdet(cov)[1])
            yield pd.DataFrame({"_g": f["_g"], "_start": f["_start"], "mean": means, "inv": invs, "logdet": dets, "moved": np.abs(np.asarray(dets, float) - f["last"].to_numpy(float))})

    return run


def _moments() -> list[Column]:
    x = [F.col("x")[i] for i in range(_P)]
    return [F.count("*").alias("n"), *(F.sum(c).alias(f"s{i}") for i, c in enumerate(x)), *(F.sum(x[i] * x[j]).alias(f"p{i}_{j}") for i, j in _PAIRS)]


def _params(sums: DataFrame, scale: float, tag: str, least: tuple) -> DataFrame:
    rows = sums.select("_g", "_start", F.col("n").cast("double").alias("n"), F.array(*[F.col(f"s{i}").cast("double") for i in range(_P)]).alias("s"), F.array(*[F.col(f"p{i}_{j}").cast("double") for i, j in _PAIRS]).alias("p"), F.col("last").cast("double").alias("last"))
    return C.materialize(rows.mapInPandas(_invert(scale, least), _PARAMS), tag)


def _distance() -> Column:
    d = [F.col("x")[i] - F.col("mean")[i] for i in range(_P)]
    out = F.lit(0.0)
    for i, j in _PAIRS:
        out = out + d[i] * d[j] * F.col("inv")[i * _P + j] * (1 if i == j else 2)
    return F.greatest(out, F.lit(0.0))


def minimum_covariance(rows: DataFrame, part: float = 0.75, starts: int = 5, go_on: int = 2, steps: int = 30, start_rows: int = 12, least: tuple = tuple(r for _, _, r in STATISTICS)) -> DataFrame:
    """rows (_g, _row: long, x: array of statistics) -> one row per group: _g, mean, inv (of the reweighted estimate), logdet (of the raw one).

    All starts go on together. The first is the medians and quartile ranges, the others a few rows of the group by hash. `go_on`
    of them are left after two steps. At most `steps` are taken; the determinant falls at each, and mostly stays after ten.
    `least`: standard deviations below which a variance is raised to their squares."""
    x = [F.col("x")[i] for i in range(_P)]
    sizes = rows.groupBy("_g").agg(F.count("*").alias("_n"), *(F.percentile_approx(c, [0.25, 0.5, 0.75]).alias(f"q{i}") for i, c in enumerate(x)))
    sizes = C.materialize(sizes, "groups")
    med = sizes.select("_g", F.lit(0).alias("_start"), F.lit(1).alias("n"), *(F.col(f"q{i}")[1].alias(f"s{i}") for i in range(_P)), *((F.col(f"q{i}")[1] * F.col(f"q{j}")[1] + (F.pow((F.col(f"q{i}")[2] - F.col(f"q{i}")[0]) / 1.349, 2) if i == j else 0.0)).alias(f"p{i}_{j}") for i, j in _PAIRS))
    picked = rows.join(sizes.select("_g", "_n"), "_g").select("_g", "x", F.explode(F.array(*[F.when(F.pmod(F.xxhash64("_row", F.lit(k)), F.greatest(F.lit(1), F.floor(F.col("_n") / start_rows))) == 0, k) for k in range(1, starts)])).alias("_start")).filter("_start IS NOT NULL")
    first = med.unionByName(picked.groupBy("_g", "_start").agg(*_moments())).withColumn("last", F.lit(math.inf))
    now = _params(first, 1.0, "start", least)
    cell = F.floor(32 * F.log2(F.col("d") + 1e-9)).cast("int").alias("cell")
    up = Window.partitionBy("_g", "_start").orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)
    best = Window.partitionBy("_g").orderBy("logdet", "_start")
    for step in range(steps):
        near = rows.join(now, "_g").select("_g", "_start", "logdet", "x", _distance().alias("d"))
        cells = near.groupBy("_g", "_start", "logdet", cell).agg(*_moments())
        share = (F.ceil(F.col("_n") * part) - F.coalesce(F.sum("n").over(up), F.lit(0))) / F.col("n")
        cells = cells.join(sizes.select("_g", "_n"), "_g").withColumn("_share", F.least(share, F.lit(1.0))).filter("_share > 0")
        sums = [F.sum(F.col(c) * F.col("_share")).alias(c) for c in ["n", *(f"s{i}" for i in range(_P)), *(f"p{i}_{j}" for i, j in _PAIRS)]]
        now = _params(cells.groupBy("_g", "_start").agg(*sums, F.first("logdet").alias("last")), consistency(part), "step", least)
        if step == 1:
            now = C.materialize(now.withColumn("_at", F.row_number().over(best)).filter(F.col("_at") <= go_on).drop("_at"), "step")
        elif step > 1 and (now.agg(F.max("moved")).first()[0] or 0) < 1e-3:
            break
    # a table of its own: joins know how small it is, and no group's rows have to meet
    now = C.materialize(now.withColumn("_at", F.row_number().over(best)).filter("_at = 1").drop("_at"), "best")
    near = rows.join(now, "_g").select("_g", "_start", "logdet", "x", _distance().alias("d")).filter(F.col("d") <= chi2_quantile(_P, 0.975))
    last = _params(near.groupBy("_g", "_start").agg(*_moments(), F.first("logdet").alias("last")), consistency(0.975), "reweighted", least)
    return last.join(now.select("_g", F.col("logdet").alias("_raw")), "_g").select("_g", "mean", "inv", F.col("_raw").alias("logdet"))


def quality_rules(docs: DataFrame, text: str = "text", lang: str = "lang", source: str = "source", tail: float = 1e-7, min_group: int = 50, **kw) -> DataFrame:
    """docs with the COUNTS, base_failed, distance (double: squared, null if none) and kept.

    base_failed: fewer than 50 words, or over half of them in repeated windows of 3. kept: neither that nor a distance above the
    chi-square quantile at 1 - `tail`. Estimates are of the rows that didn't fail, per language and source (null is a value);
    a group of fewer than `min_group` goes by its language, a language of fewer by all rows; if those are fewer, rows have no distance and
    are kept.
    Null text has no words. Equal rows count each. Other columns pass unchanged; those named like the added ones are replaced.
    """
    added = (*COUNTS, "base_failed", "distance", "kept")
    keep = [c for c in docs.columns if c.lower() not in added]
    src = docs.select(*[docs[c].alias(f"_c{i}") for i, c in enumerate(keep) if c != text], F.monotonically_increasing_id().alias("_row"), F.to_json(F.struct(docs[lang].alias("l"), docs[source].alias("s"))).alias("_ls"), F.to_json(F.struct(docs[lang].alias("l"))).alias("_l"), C.text_or_empty(docs[text]).alias("_text"))
    types = dict(src.dtypes)
    counted = src.transform(C.map_batches, _count, ", ".join([*(f"{c} {types[c]}" for c in src.columns[:-1]), *(f"{c} long" for c in COUNTS)]))
    counted = C.materialize(counted.withColumn("base_failed", (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))), "counts")
    good = counted.filter("NOT base_failed")
    sizes = good.groupBy("_ls", "_l").agg(F.count("*").alias("n")).withColumn("small", F.col("n") < min_group)
    langs = good.groupBy("_l").agg(F.count("*").alias("m"))
    name = F.when(~F.col("small"), F.concat(F.lit("g"), "_ls")).when(F.col("m") >= min_group, F.concat(F.lit("l"), "_l")).otherwise("a")
    group = C.materialize(sizes.join(langs, "_l").select("_ls", "n", name.alias("_g")), "keys")
    vector = F.array(*[F.expr(e) for _, e, _ in STATISTICS]).alias("x")
    rows = good.join(group, "_ls").select("_g", "_row", vector)
    # the rows of a language that some of its small groups go by: all of it
    whole = good.select("_l", "_row", vector).join(group.filter(F.col("_g").startswith("l")).select(F.substring("_g", 2, 1 << 20).alias("_l")).distinct(), "_l").select(F.concat(F.lit("l"), "_l").alias("_g"), "_row", "x")
    fit = rows.filter(F.col("_g").startswith("g")).union(whole)
    if not group.filter("_g = 'a'").isEmpty() and group.agg(F.sum("n")).first()[0] >= min_group:
        fit = fit.union(good.select(F.lit("a").alias("_g"), "_row", vector))
    fit = C.materialize(fit, "statistics")
    found = minimum_covariance(fit, **kw)
    far = good.join(group, "_ls").join(found, "_g", "left").select("*", vector).filter("mean IS NOT NULL").select("_row", _distance().alias("distance"))
    out = counted.join(far, "_row", "left")
    kept = ~F.col("base_failed") & (F.coalesce("distance", F.lit(0.0)) <= chi2_quantile(_P, 1 - tail))
    named = [F.col(f"_c{i}").alias(c) for i, c in enumerate(keep) if c != text]
    return out.select(*named, *COUNTS, "base_failed", "distance", kept.alias("kept"))


def op9_quality_rules(spark, sf_dir: str) -> DataFrame:
    out = quality_rules(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang", "source"))
    return out.select("doc_id", *COUNTS, "base_failed", "kept", "distance")
