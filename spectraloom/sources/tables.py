"""The engine's row types as views over the star-schema tables: peaks, features, hits, proteins, regions.

peaks(run_id, spectrum_id, ms_level, rt, peak_id, mz, intensity), features(map_id, feature_id, rt, mz, intensity, charge),
hits(hit_id, spectrum_id, run_id, score, decoy, accession, charge), sequences(accession, sequence), regions(region, mz_low, mz_high,
rt_low, rt_high). VIEWS holds the same as SQL.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

VIEWS = {
    "peaks": "SELECT l_suppkey % 5 AS run_id, l_suppkey AS spectrum_id, 1 + l_suppkey % 2 AS ms_level, CAST(l_suppkey * 2 AS DOUBLE) AS rt, (l_orderkey * 8 + l_linenumber) * 1000000 + l_partkey AS peak_id, "
    "l_extendedprice / 100.0 AS mz, l_quantity * 100.0 - CAST(round(l_tax * 10000.0) AS BIGINT) AS intensity FROM lineitem",
    "features": "SELECT o_custkey % 4 AS map_id, o_orderkey AS feature_id, CAST(o_orderkey % 2000 AS DOUBLE) AS rt, o_totalprice / 500.0 AS mz, o_totalprice AS intensity, 1 + o_custkey % 3 AS charge FROM orders",
    "hits": "SELECT event_id AS hit_id, user_id AS spectrum_id, event_id % 3 AS run_id, value AS score, event_id % 7 = 0 AS decoy, 'P' || CAST(event_id % 61 AS VARCHAR) AS accession, 1 + event_id % 4 AS charge FROM events",
    "sequences": "SELECT p_partkey AS accession, regexp_replace(upper(p_name || p_type || p_name || p_brand || p_type), '[^ACDEFGHIKLMNPQRSTVWY]', '', 'g') AS sequence FROM part",
    "regions": "SELECT n_nationkey AS region, n_nationkey * 20.0 AS mz_low, n_nationkey * 20.0 + 55.5 AS mz_high, n_nationkey * 3.0 AS rt_low, n_nationkey * 3.0 + 40.0 AS rt_high FROM nation",
}


def dealt(df: DataFrame) -> DataFrame:
    """df over as many tasks as shuffles have: for rows of which far more is made than their bytes tell, as a file of few bytes is one task."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))


def sql(body: str) -> str:
    """body with the views that it names."""
    used = [f"{k} AS ({v})" for k, v in VIEWS.items() if k in body]
    return ("WITH " + ",\n".join(used) + "\n" + body) if used and not body.lstrip().upper().startswith("WITH") else "WITH " + ",\n".join(used) + ", " + body.lstrip()[4:] if used else body


def peaks(spark: SparkSession, d: str) -> DataFrame:
    t, k = spark.read.parquet(f"{d}/lineitem.parquet"), F.col("l_suppkey")
    return t.select((k % 5).alias("run_id"), k.alias("spectrum_id"), (1 + k % 2).alias("ms_level"), (k * 2).cast("double").alias("rt"), ((F.col("l_orderkey") * 8 + F.col("l_linenumber")) * 1000000 + F.col("l_partkey")).alias("peak_id"), (F.col("l_extendedprice") / 100.0).alias("mz"), (F.col("l_quantity") * 100.0 - F.round(F.col("l_tax") * 10000.0).cast("long")).alias("intensity"))


def features(spark: SparkSession, d: str) -> DataFrame:
    t = spark.read.parquet(f"{d}/orders.parquet")
    return t.select((F.col("o_custkey") % 4).alias("map_id"), F.col("o_orderkey").alias("feature_id"), (F.col("o_orderkey") % 2000).cast("double").alias("rt"), (F.col("o_totalprice") / 500.0).alias("mz"), F.col("o_totalprice").alias("intensity"), (1 + F.col("o_custkey") % 3).alias("charge"))


def hits(spark: SparkSession, d: str) -> DataFrame:
    t, e = spark.read.parquet(f"{d}/events.parquet"), F.col("event_id")
    return t.select(e.alias("hit_id"), F.col("user_id").alias("spectrum_id"), (e % 3).alias("run_id"), F.col("value").alias("score"), (e % 7 == 0).alias("decoy"), F.concat(F.lit("P"), (e % 61).cast("string")).alias("accession"), (1 + e % 4).alias("charge"))


def sequences(spark: SparkSession, d: str) -> DataFrame:
    t = dealt(spark.read.parquet(f"{d}/part.parquet").select("p_partkey", "p_name", "p_type", "p_brand"))
    return t.select(F.col("p_partkey").alias("accession"), F.regexp_replace(F.upper(F.concat("p_name", "p_type", "p_name", "p_brand", "p_type")), "[^ACDEFGHIKLMNPQRSTVWY]", "").alias("sequence"))


def regions(spark: SparkSession, d: str) -> DataFrame:
    t, n = spark.read.parquet(f"{d}/nation.parquet"), F.col("n_nationkey")
    return t.select(n.alias("region"), (n * 20.0).alias("mz_low"), (n * 20.0 + 55.5).alias("mz_high"), (n * 3.0).alias("rt_low"), (n * 3.0 + 40.0).alias("rt_high"))
