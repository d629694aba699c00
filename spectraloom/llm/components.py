"""Connected components by alternating large and small stars, each step a partial minimum and a join that Spark may split."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as C


def _settled(e: DataFrame) -> bool:
    """Whether all edges lead from a node that has no other one to a node that has none: the stars in which the steps end."""
    most = e.groupBy("u").agg(F.count("*").alias("n")).agg(F.max("n")).first()[0]
    if most is None or most > 1:
        return most is None
    roots = e.select(F.col("v").alias("u")).distinct()
    return roots.join(e.select("u"), "u", "left_semi").isEmpty()


def components(edges: DataFrame) -> DataFrame:
    """edges (u, v: long) -> (u, v): each node but the smallest of its component, with that smallest one. Loops and repeats are allowed."""
    e = C.materialize(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).filter("u != v").distinct(), "edges")
    while not _settled(e):
        both = e.union(e.select(F.col("v"), F.col("u"))).toDF("u", "v")
        low = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.join(low, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("p")).select("p.u", "p.v").filter("u != v").distinct()
        e = C.materialize(small, "edges")
    return e


def joined(known: DataFrame, edges: DataFrame) -> DataFrame:
    """known, as of components(), when these edges (u, v) come in: only the edges between what it holds apart are worked on."""
    for side in ("u", "v"):
        edges = edges.join(known.toDF(side, "_low"), side, "left").withColumn(side, F.coalesce("_low", side)).drop("_low")
    # the nodes that these edges join are smallest ones, or unknown so far: never known.u
    step = components(edges.select("u", "v"))
    moved = known.join(step.toDF("v", "_low"), "v", "left").select("u", F.coalesce("_low", "v").alias("v"))
    return C.materialize(moved.union(step), "components")
