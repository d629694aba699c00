"""Running values, ranks and exact percentiles over pools of any size.

A pool's rows are dealt to ranges of the ordering value by quantiles of some of its distinct values; windows run within a range, and once
more over the ranges, of which a pool has few. So no pool is sorted in one task, however many rows it has. Pools can have nulls as keys.

Rows and their ranges' totals are computed apart and joined, so the cuts between ranges have to come out the same each time. Those of
percentile_approx don't: they depend on the order in which partial results arrive. The values here are those with the smallest hash.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

RANGES = 256
#: So many distinct values of a pool at most make its cuts.
_SLOTS = 2048


def range_cuts(df: DataFrame, pool: list[str], by: str, n: int) -> DataFrame:
    """(pool, _cuts): n - 1 rising values of `by` with about as many distinct values between them; no row for pools of nulls only.

    They are a function of the set of values alone, however rows are split and whatever order they come in."""
    h = F.xxhash64(by)
    some = df.filter(F.col(by).isNotNull()).groupBy(*pool, F.pmod(h, F.lit(_SLOTS)).alias("_slot")).agg(F.min_by(by, h).alias("_v"))
    values = some.groupBy(*pool).agg(F.sort_array(F.collect_list("_v")).alias("_s"))
    return values.select(*pool, F.transform(F.sequence(F.lit(1), F.lit(n - 1)), lambda i: F.get("_s", F.floor(F.size("_s") * i / n).cast("int"))).alias("_cuts"))


def in_ranges(df: DataFrame, pool: tuple | list, by: str, n: int = RANGES) -> DataFrame:
    """df with _pool (the pool's columns together) and _range, a number that rises with `by`; nulls come first."""
    df = df.withColumn("_pool", F.struct(*pool) if pool else F.struct(F.lit(0)))
    cuts = range_cuts(df, ["_pool"], by, n)
    # how many cuts are below: a search that halves, as a look at each of them costs more than all that follows
    steps = F.array(*[F.lit(1 << k) for k in reversed(range((n - 1).bit_length()))])
    below = F.aggregate(steps, F.lit(0), lambda at, step: F.when(F.get("_cuts", at + step - 1) < F.col(by), at + step).otherwise(at))
    return df.join(cuts, "_pool", "left").withColumn("_range", F.when(F.col(by).isNotNull(), below).otherwise(-1)).drop("_cuts")


def running(df: DataFrame, order: list, what: dict[str, tuple[str | Column, str]], inclusive: bool = True) -> DataFrame:
    """df (of in_ranges) with name: (column, how) over the rows up to each one, itself included or not; how: sum, max or last (that isn't null).

    Ranges have to rise with `order`."""
    end = 0 if inclusive else -1
    inner = Window.partitionBy("_pool", "_range").orderBy(*order).rowsBetween(Window.unboundedPreceding, end)
    outer = Window.partitionBy("_pool").orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    use = {"sum": F.sum, "max": F.max, "last": lambda c: F.last(c, ignorenulls=True)}
    own = df.select("*", *[(F.col(c) if isinstance(c, str) else c).alias(f"_x{i}") for i, (c, _) in enumerate(what.values())])
    per_range = own
    marks = [(f"_x{i}", how) for i, (_, how) in enumerate(what.values())]
    if any(how == "last" for _, how in marks):
        # by range, as rows come from a join by pool, which Spark would take for dealt out well enough: a task would sort a whole pool
        per_range = own.repartition("_pool", "_range").withColumn("_nth", F.row_number().over(Window.partitionBy("_pool", "_range").orderBy(*order)))
    total = lambda c, how: F.max_by(c, F.when(F.col(c).isNotNull(), F.col("_nth"))) if how == "last" else use[how](c)
    base = per_range.groupBy("_pool", "_range").agg(*[total(c, how).alias(c) for c, how in marks])
    base = base.select("_pool", "_range", *[use[how](c).over(outer).alias(f"_b{c}") for c, how in marks])
    out = own.join(base, ["_pool", "_range"])
    for name, (c, how) in zip(what, marks):
        here, before = use[how](c).over(inner), F.col(f"_b{c}")
        value = F.coalesce(here, F.lit(0)) + F.coalesce(before, F.lit(0)) if how == "sum" else F.greatest(here, before) if how == "max" else F.coalesce(here, before)
        out = out.withColumn(name, value)
    return out.drop(*[c for c, _ in marks], *[f"_b{c}" for c, _ in marks])


def percentiles(df: DataFrame, pool: tuple | list, value: str, at: list[float]) -> DataFrame:
    """(pool, p: array): exact percentiles, between two values by proportion. Equal values are counted before they are ordered; nulls don't count."""
    counts = df.filter(F.col(value).isNotNull()).groupBy(*pool, value).agg(F.count("*").alias("_n"))
    run = running(in_ranges(counts, pool, value), [value], {"_to": ("_n", "sum")})
    run = run.join(run.groupBy("_pool").agg(F.max("_to").alias("_all")), "_pool")
    nth = lambda k: F.max(F.when((F.col("_to") > k) & (F.col("_to") - F.col("_n") <= k), F.col(value).cast("double")))
    spot = [(F.col("_all") - 1) * q for q in at]
    found = run.groupBy(*pool).agg(F.first("_all").alias("_all"), *[nth(F.floor(s)).alias(f"_l{i}") for i, s in enumerate(spot)], *[nth(F.ceil(s)).alias(f"_h{i}") for i, s in enumerate(spot)])
    return found.select(*pool, F.array(*[F.col(f"_l{i}") + (F.col(f"_h{i}") - F.col(f"_l{i}")) * (s - F.floor(s)) for i, s in enumerate(spot)]).alias("p"))


def joined(df: DataFrame, other: DataFrame, pool: tuple | list, how: str = "inner") -> DataFrame:
    """df with the columns of other (pool, ..) for its pool; null keys meet."""
    if not pool:
        raise ValueError("no columns to join by")
    o = other.select(F.struct(*pool).alias("_key"), *[c for c in other.columns if c not in pool])
    return df.withColumn("_key", F.struct(*pool)).join(o, "_key", how).drop("_key")
