"""Multiple testing over p values of pools of any size: corrections, the share of true null hypotheses, q values."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .ranges import in_ranges, joined, running


def _ranked(tests: DataFrame, pool: tuple, p: str) -> DataFrame:
    """(pool, p, _to, _all) of each distinct p value: number of tests up to it, and of all."""
    counts = tests.filter(F.col(p).isNotNull()).groupBy(*pool, p).agg(F.count("*").alias("_n"))
    run = running(in_ranges(counts, pool, p), [p], {"_to": ("_n", "sum")})
    return run.join(run.groupBy("_pool").agg(F.max("_to").alias("_all")), "_pool")


def _back(tests: DataFrame, curve: DataFrame, pool: tuple, p: str, name: str) -> DataFrame:
    c = curve.select(F.struct(*pool, p).alias("_at"), name)
    return tests.withColumn("_at", F.struct(*pool, p)).join(c, "_at", "left").drop("_at")


def bonferroni(tests: DataFrame, pool: tuple, p: str = "p") -> DataFrame:
    """tests with adjusted: p times the pool's number of tests, at most 1; null for null."""
    n = tests.groupBy(*pool).agg(F.count(p).alias("_n"))
    return joined(tests, n, pool).withColumn("adjusted", F.when(F.col(p).isNotNull(), F.least(F.lit(1.0), F.col(p) * F.col("_n")))).drop("_n")


def benjamini_hochberg(tests: DataFrame, pool: tuple, p: str = "p") -> DataFrame:
    """tests with adjusted: the least p n / rank of this and all larger p values, at most 1; equal ones share their last rank."""
    raw = _ranked(tests, pool, p).withColumn("_down", -F.col(p)).withColumn("_raw", -(F.col(p) * F.col("_all") / F.col("_to"))).drop("_pool", "_range")
    low = running(in_ranges(raw, pool, "_down"), ["_down"], {"_low": ("_raw", "max")})
    return _back(tests, low.withColumn("adjusted", F.least(F.lit(1.0), -F.col("_low"))), pool, p, "adjusted")


def null_share(tests: DataFrame, pool: tuple, p: str = "p", cut: float = 0.5) -> DataFrame:
    """(pool, share): the number of p values above the cut over what uniform ones would have there, at most 1."""
    n = tests.filter(F.col(p).isNotNull()).groupBy(*pool).agg(F.count("*").alias("_n"), F.sum((F.col(p) > cut).cast("int")).alias("_above"))
    return n.select(*pool, F.least(F.lit(1.0), F.col("_above") / (F.col("_n") * (1 - cut))).alias("share"))


def storey(tests: DataFrame, pool: tuple, p: str = "p", cut: float = 0.5) -> DataFrame:
    """tests with q: the corrected p value times the share of true null hypotheses."""
    return joined(benjamini_hochberg(tests, pool, p), null_share(tests, pool, p, cut), pool).withColumn("q", F.col("adjusted") * F.col("share")).drop("share")
