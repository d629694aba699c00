"""Identification filters, false discovery rates and inference over hits(hit_id, spectrum_id, run_id, score, decoy, accession, charge)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .ranges import in_ranges, range_cuts, running


def best_hits(hits: DataFrame, n: int = 1, key=("spectrum_id",)) -> DataFrame:
    """The n best hits per spectrum (higher is better, ties by id) with their rank."""
    o = Window.partitionBy(*key).orderBy(F.desc("score"), "hit_id")
    return hits.withColumn("rank", F.row_number().over(o)).filter(F.col("rank") <= n)


def filter_hits(hits: DataFrame, least: float | None = None, decoys: bool = True, charges: tuple | None = None) -> DataFrame:
    """Hits of at least this score, without decoys or of these charges only; all of it reaches the scan."""
    if least is not None:
        hits = hits.filter(F.col("score") >= least)
    if not decoys:
        hits = hits.filter(~F.col("decoy"))
    return hits.filter(F.col("charge").isin(*charges)) if charges is not None else hits


CHUNKS = 256


def running_curve(curve: DataFrame, pool: list[str], counts: list[str], value, by: str = "score") -> DataFrame:
    """curve (pool, by, counts) with value (of the counts' running sums from the best score on) and its minimum over worse scores.

    value: name -> Column over the sums. Scores are dealt to ranges by quantiles of their pool; sums and minima run within a
    range and over the ranges, of which a pool has few, so that no pool's scores meet in one task, however many they are."""
    pool = pool or ["_pool"]
    curve = curve if set(pool) <= set(curve.columns) else curve.withColumn("_pool", F.lit(0))
    cuts = range_cuts(curve, pool, by, CHUNKS)
    c = curve.join(cuts, pool, "left").withColumn("_chunk", F.size(F.filter("_cuts", lambda x: x >= F.col(by)))).drop("_cuts")
    down = Window.partitionBy(*pool, "_chunk").orderBy(F.desc(by)).rowsBetween(Window.unboundedPreceding, 0)
    up = Window.partitionBy(*pool, "_chunk").orderBy(F.desc(by)).rowsBetween(0, Window.unboundedFollowing)
    before = Window.partitionBy(*pool).orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    after = Window.partitionBy(*pool).orderBy("_chunk").rowsBetween(1, Window.unboundedFollowing)
    base = c.groupBy(*pool, "_chunk").agg(*[F.sum(k).alias(f"_s_{k}") for k in counts])
    base = base.select(*pool, "_chunk", *[F.coalesce(F.sum(f"_s_{k}").over(before), F.lit(0)).alias(f"_b_{k}") for k in counts])
    c = c.join(base, [*pool, "_chunk"])
    for k in counts:
        c = c.withColumn(f"run_{k}", F.sum(k).over(down) + F.col(f"_b_{k}"))
    c = c.withColumn("fdr", value(*[F.col(f"run_{k}") for k in counts])).withColumn("_low", F.min("fdr").over(up))
    low = c.groupBy(*pool, "_chunk").agg(F.min("fdr").alias("_m"))
    low = low.select(*pool, "_chunk", F.min("_m").over(after).alias("_later"))
    return c.join(low, [*pool, "_chunk"]).withColumn("q_value", F.least("_low", "_later", F.lit(1.0))).drop("_chunk", "_low", "_later", "_pool", *[f"_b_{k}" for k in counts])


def score_curve(hits: DataFrame, pool: list[str], kind: str = "conservative") -> DataFrame:
    """(pool, score, fdr, q_value) at each distinct score: (D + 1) / (T + 1), (D + 1) / (T + D + 1) or D / T (legacy).

    Scores are first counted, so the sums run over each distinct score once, not each hit."""
    value = {"conservative": lambda t, d: (d + 1) / (t + 1), "basic": lambda t, d: (d + 1) / (t + d + 1), "legacy": lambda t, d: F.when(t > 0, d / t).otherwise(1.0)}[kind]
    counts = hits.groupBy(*pool, "score").agg(F.sum(1 - F.col("decoy").cast("int")).alias("t"), F.sum(F.col("decoy").cast("int")).alias("d"))
    return running_curve(counts, pool, ["t", "d"], value).select(*pool, "score", "fdr", "q_value")


def apply_fdr(hits: DataFrame, pool: list[str], kind: str = "conservative", keep_decoys: bool = False) -> DataFrame:
    """hits with fdr and q_value of their pool's curve; decoys go unless kept."""
    out = hits.join(score_curve(hits, pool, kind), [*pool, "score"])
    return out if keep_decoys else out.filter(~F.col("decoy"))


def estimated_fdr(hits: DataFrame, pool: list[str], pep: str) -> DataFrame:
    """Running mean of posterior error probabilities from the best on; exact ties share the last value.

    Equal probabilities are counted before they are ordered."""
    counts = hits.filter(F.col(pep).isNotNull()).groupBy(*pool, pep).agg(F.count("*").alias("_n"), F.sum(pep).alias("_s"))
    curve = running(in_ranges(counts, pool, pep), [pep], {"_n": ("_n", "sum"), "_s": ("_s", "sum")})
    curve = curve.select(F.struct(*pool, pep).alias("_at"), (F.col("_s") / F.col("_n")).alias("q_value"))
    return hits.withColumn("_at", F.struct(*pool, pep)).join(curve, "_at", "left").drop("_at")


def protein_scores(hits: DataFrame) -> DataFrame:
    """(accession, n_spectra, n_hits, best, total): inference by best hits, from the best hit of each spectrum."""
    return best_hits(hits).groupBy("accession").agg(F.countDistinct("spectrum_id").alias("n_spectra"), F.count("*").alias("n_hits"), F.max("score").alias("best"), F.sum("score").alias("total"))


def picked_competition(hits: DataFrame) -> DataFrame:
    """Target or decoy of each accession, whichever has the better best score (targets win ties), and its FDR."""
    best = hits.groupBy("accession").agg(F.max(F.when(~F.col("decoy"), F.col("score"))).alias("t"), F.max(F.when(F.col("decoy"), F.col("score"))).alias("d"))
    one = best.select("accession", F.greatest("t", "d").alias("score"), (F.coalesce("t", F.lit(float("-inf"))) < F.coalesce("d", F.lit(float("-inf")))).alias("decoy"))
    return apply_fdr(one, [], "conservative", True)


def consensus(hits: DataFrame, engines: str = "run_id") -> DataFrame:
    """(spectrum_id, accession, score, n): mean over the engines of each accession's best score in a spectrum."""
    best = hits.groupBy("spectrum_id", "accession", engines).agg(F.max("score").alias("s"))
    return best.groupBy("spectrum_id", "accession").agg(F.avg("s").alias("score"), F.count("*").alias("n"))


def resolve_conflicts(links: DataFrame) -> DataFrame:
    """Of the hits linked to a feature, the best one (ties by id)."""
    o = Window.partitionBy("feature_id").orderBy(F.desc("score"), "hit_id")
    return links.withColumn("_r", F.row_number().over(o)).filter("_r = 1").drop("_r")
