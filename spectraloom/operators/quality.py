"""Quality metrics of runs and identifications, peak ranks, and filters and merges over hits."""

from __future__ import annotations

import functools
import math

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import chemistry as ch
from .joins import range_join
from .ranges import in_ranges, running


def tic_stability(peaks: DataFrame, ms_level: int | None = 1) -> DataFrame:
    """(run_id, n, area, falls, jumps): the total ion current per spectrum in order of time, truncated to integers.

    falls and jumps: neighbours where it drops below a tenth (integer division) or rises above ten times. ms_level None: all."""
    p = peaks if ms_level is None else peaks.filter(F.col("ms_level") == ms_level)
    tic = p.groupBy("run_id", "spectrum_id", "rt").agg(F.greatest(F.sum("intensity"), F.lit(0)).cast("long").alias("tic"))
    before = F.lag("tic").over(Window.partitionBy("run_id").orderBy("rt", "spectrum_id"))
    tic = tic.withColumn("_b", before)
    return tic.groupBy("run_id").agg(
        F.count("*").alias("n"),
        F.sum("tic").alias("area"),
        F.sum(F.coalesce((F.col("tic") < F.floor(F.col("_b") / 10)).cast("long"), F.lit(0))).alias("falls"),
        F.sum(F.coalesce((F.col("tic") > F.col("_b") * 10).cast("long"), F.lit(0))).alias("jumps"),
    )


def relative_tic(peaks: DataFrame) -> DataFrame:
    """(run_id, spectrum_id, relative): each spectrum's total ion current in percent of its run's largest; 0 if that isn't positive."""
    tic = peaks.groupBy("run_id", "spectrum_id").agg(F.sum("intensity").alias("tic"))
    most = F.max("tic").over(Window.partitionBy("run_id"))
    return tic.select("run_id", "spectrum_id", F.when(most > 0, 100 * F.col("tic") / most).otherwise(0.0).alias("relative"))


def feature_summary(features: DataFrame, deviation: str) -> DataFrame:
    """(map_id, n, deviation): number of features and the mean of the column `deviation` over those that have it (else 0)."""
    return features.groupBy("map_id").agg(F.count("*").alias("n"), F.coalesce(F.avg(deviation), F.lit(0.0)).alias("deviation"))


def identification_summary(hits: DataFrame, peptides: DataFrame) -> DataFrame:
    """(run_id, n_psms, n_peptides, n_proteins, missed, length, score) of hits whose accession names a peptide of `peptides`.

    n_psms: spectra with a hit. Peptides are those of each spectrum's best hit; missed: their mean missed cleavages; length: mean
    over the distinct ones; score: mean of all hits' scores."""
    o = Window.partitionBy("run_id", "spectrum_id").orderBy(F.desc("score"), "hit_id")
    first = hits.withColumn("_r", F.row_number().over(o)).filter("_r = 1").join(peptides.select("accession", "peptide"), "accession")
    first = first.withColumn("_m", F.size(ch.cut_tryptic(F.col("peptide"))) - 1)
    each = first.groupBy("run_id", "peptide").agg(F.count("*").alias("c"), F.sum("_m").alias("m")).groupBy("run_id").agg(F.count("*").alias("n_peptides"), (F.sum("m") / F.sum("c")).alias("missed"), F.avg(F.length("peptide")).alias("length"))
    of_run = hits.groupBy("run_id").agg(F.countDistinct("spectrum_id").alias("n_psms"), F.countDistinct("accession").alias("n_proteins"), F.avg("score").alias("score"))
    return of_run.join(each, "run_id", "left").select("run_id", "n_psms", F.coalesce("n_peptides", F.lit(0)).alias("n_peptides"), "n_proteins", "missed", "length", "score")


def identification_rate(peaks: DataFrame, hits: DataFrame, level: int = 2) -> DataFrame:
    """(run_id, n_spectra, n_identified, rate): share of a run's spectra of the level that have a target hit."""
    s = peaks.filter(F.col("ms_level") == level).select("run_id", "spectrum_id").distinct()
    t = hits.filter(~F.col("decoy")).select("spectrum_id", F.lit(1).alias("_hit")).distinct()
    return s.join(t, "spectrum_id", "left").groupBy("run_id").agg(F.count("*").alias("n_spectra"), F.count("_hit").alias("n_identified")).withColumn("rate", F.col("n_identified") / F.col("n_spectra"))


def window_ranks(peaks: DataFrame, window: float = 100.0, key: tuple = ("spectrum_id",)) -> DataFrame:
    """peaks with rank: number of the spectrum's strictly more intense peaks within half a window on either side (0 is the top)."""
    half = window / 2
    spans = peaks.select(*key, "peak_id", F.col("mz").alias("_mz"), F.col("intensity").alias("_own"))
    above = range_join(peaks.select(*key, "mz", "intensity"), spans, "mz", F.col("_mz") - half, F.col("_mz") + half, window, key).filter("intensity > _own")
    n = above.groupBy(*key, "peak_id").agg(F.count("*").cast("int").alias("rank"))
    return peaks.join(n, [*key, "peak_id"], "left").withColumn("rank", F.coalesce("rank", F.lit(0)))


@functools.lru_cache(maxsize=1 << 16)
def binomial_tail(n: int, total: int, p: float) -> float:
    """-10 log10 of the chance of n or more successes in `total` tries at p; 0 without tries.

    Terms are summed from logarithms, so that large numbers of tries don't overflow."""
    if not 0 < n <= total:
        return 0.0
    whole = math.lgamma(total + 1)
    chance = sum(math.exp(whole - math.lgamma(k + 1) - math.lgamma(total - k + 1) + k * math.log(p) + (total - k) * math.log1p(-p)) for k in range(n, total + 1))
    return -10 * math.log10(min(1.0, chance)) + 0.0


def binomial_score(p: float):
    """(n, total) -> binomial_tail, in Arrow batches: numbers of ions are few, so a worker computes each case once."""

    @F.pandas_udf("double")
    def score(n: pd.Series, total: pd.Series) -> pd.Series:
        return pd.Series([binomial_tail(int(a), int(b), p) for a, b in zip(n, total)], dtype=float)

    return score


def peak_level_score(ranked: DataFrame, matches: DataFrame, ions: DataFrame, tolerance: float, window: float = 100.0, levels: tuple = tuple(range(1, 10))) -> DataFrame:
    """(spectrum_id, peptide, score, level): the best binomial score over peak levels.

    At a level only the peaks of rank <= level count; a random match has the chance (level + 1) 2 tolerance / window, at most
    0.99. ranked: peaks with rank; matches (spectrum_id, peptide, ion, position, peak_id), one row for each ion; ions (peptide, n): number of ions."""
    m = matches.join(ranked.select("spectrum_id", "peak_id", "rank"), ["spectrum_id", "peak_id"])
    counts = m.groupBy("spectrum_id", "peptide").agg(*[F.sum((F.col("rank") <= k).cast("int")).alias(f"_n{k}") for k in levels])
    counts = counts.join(ions, "peptide")
    one = lambda k: F.struct(F.round(binomial_score(min(0.99, (k + 1) * 2 * tolerance / window))(F.col(f"_n{k}"), F.col("n")), 9).alias("s"), F.lit(-k).alias("k"))
    best = F.array_max(F.array(*[one(k) for k in levels]))
    return counts.select("spectrum_id", "peptide", best["s"].alias("score"), (-best["k"]).alias("level"))


def delta_scores(hits: DataFrame) -> DataFrame:
    """(spectrum_id, hit_id, score, delta): the best hit and how far the next one's score is below (null without another), as a share of it."""
    o = Window.partitionBy("spectrum_id").orderBy(F.desc("score"), "hit_id")
    two = hits.select("spectrum_id", "hit_id", "score", F.row_number().over(o).alias("_r"), F.lead("score").over(o).alias("_s"))
    return two.filter("_r = 1").select("spectrum_id", "hit_id", "score", F.try_divide(F.col("score") - F.col("_s"), "score").alias("delta"))


def proteins_with_peptides(links: DataFrame, least: int, unique: bool = True) -> DataFrame:
    """(accession, n) with at least that many different peptides (peptide, accession), unique: that no other protein has."""
    one = links.select("peptide", "accession").distinct()
    if unique:
        one = one.groupBy("peptide").agg(F.min("accession").alias("accession"), F.count("*").alias("_n")).filter("_n = 1").drop("_n")
    return one.groupBy("accession").agg(F.count("*").alias("n")).filter(F.col("n") >= least)


def merge_runs(hits: DataFrame, run: str = "run_id") -> DataFrame:
    """Runs merged into one: each (spectrum, accession) with its best score, the run it is from (ties: smallest) and number of runs."""
    best = F.max(F.struct("score", (-F.col(run)).alias("r")))
    return hits.groupBy("spectrum_id", "accession").agg(best.alias("b"), F.count_distinct(run).alias("n_runs")).select("spectrum_id", "accession", F.col("b.score").alias("score"), (-F.col("b.r")).alias("origin"), "n_runs")


def split_by_origin(hits: DataFrame, path: str, origin: str = "run_id") -> None:
    """Hits of each origin in a folder of their own (``origin=..``); reading one prunes the others."""
    hits.write.partitionBy(origin).parquet(path)


def indistinguishable_proteins(links: DataFrame) -> DataFrame:
    """(accession, group, n_peptides): proteins with the same set of peptides share a group, named by its smallest accession.

    Sets are compared by size and two order-free 64-bit sums of hashes, so that no set is gathered."""
    one = links.select("peptide", "accession").distinct()
    sums = one.groupBy("accession").agg(F.count("*").alias("n_peptides"), F.sum(F.xxhash64("peptide").cast("decimal(38,0)")).alias("_a"), F.sum(F.xxhash64("peptide", F.lit(1)).cast("decimal(38,0)")).alias("_b"))
    names = sums.groupBy("n_peptides", "_a", "_b").agg(F.min("accession").alias("group"))
    return sums.join(names, ["n_peptides", "_a", "_b"]).select("accession", "group", "n_peptides")


def pep_from_q(curve: DataFrame, pool: list[str]) -> DataFrame:
    """curve (pool, score, n, q_value) with pep: the error share of each score's own hits, monotone from the best score on.

    The raw value is the increase of q times the number of hits so far, per hit; its running maximum is the estimate (at most 1)."""
    c = running(in_ranges(curve.withColumn("_down", -F.col("score")), pool, "_down"), ["_down"], {"_n": ("n", "sum")}).withColumn("_e", F.col("q_value") * F.col("_n"))
    c = running(c, ["_down"], {"_last": ("_e", "last")}, inclusive=False)
    raw = (F.col("_e") - F.coalesce("_last", F.lit(0.0))) / F.col("n")
    c = c.withColumn("_p", F.greatest(F.lit(0.0), F.least(F.lit(1.0), raw)))
    return running(c, ["_down"], {"pep": ("_p", "max")}).drop("_n", "_e", "_p", "_last", "_down", "_pool", "_range")


def entropy_similarity(peaks: DataFrame, pairs: DataFrame, bin_size: float = 10.0) -> DataFrame:
    """(a, b, similarity): 1 less the Jensen-Shannon divergence (in bits) of two spectra's shares of intensity in bins."""
    v = peaks.groupBy("spectrum_id", F.floor(F.col("mz") / bin_size).alias("bin")).agg(F.sum(F.greatest("intensity", F.lit(0.0))).alias("x")).filter("x > 0")
    v = v.withColumn("p", F.col("x") / F.sum("x").over(Window.partitionBy("spectrum_id"))).select("spectrum_id", "bin", "p")
    a, b = v.toDF("a", "bin", "pa"), v.toDF("b", "bin", "pb")
    known = pairs.join(v.select(F.col("spectrum_id").alias("a")).distinct(), "a").join(v.select(F.col("spectrum_id").alias("b")).distinct(), "b")
    # what only one has adds p log2 2 / 2: in all, 1 less the sum over the bins that both have
    f = lambda p: p / 2 * F.log2(2 * p / (F.col("pa") + F.col("pb")))
    both = known.join(a, "a").join(b, ["b", "bin"]).groupBy("a", "b").agg(F.sum(f(F.col("pa")) + f(F.col("pb")) - (F.col("pa") + F.col("pb")) / 2).alias("s"))
    return known.join(both, ["a", "b"], "left").select("a", "b", F.coalesce(-F.col("s"), F.lit(0.0)).alias("similarity"))


def entropy_of_spectra(peaks: DataFrame) -> DataFrame:
    """(spectrum_id, entropy): Shannon entropy in nats of the spectrum's shares of intensity."""
    p = peaks.filter("intensity > 0").groupBy("spectrum_id").agg(F.sum("intensity").alias("t"), F.sum(F.col("intensity") * F.log("intensity")).alias("h"))
    return p.select("spectrum_id", (F.log("t") - F.col("h") / F.col("t")).alias("entropy"))


