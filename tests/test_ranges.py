import random

import numpy as np
from pyspark.sql import functions as F

from spectraloom.operators.ranges import in_ranges, percentiles, running


def rows(n=400):
    rng = random.Random(3)
    return [(rng.choice(["a", "b", None]), i, rng.choice([None, 1.0, 2.0, round(rng.random() * 5, 2)]), rng.randint(0, 9)) for i in range(n)]


def test_running_as_brute_force(spark):
    data = rows()
    df = spark.createDataFrame(data, "k string, id long, v double, w int").repartition(5)
    for inclusive in (True, False):
        run = running(in_ranges(df, ["k"], "v", 7), ["v", "id"], {"s": ("w", "sum"), "m": ("w", "max"), "l": ("v", "last")}, inclusive)
        got = {r.id: (r.s, r.m, r.l) for r in run.collect()}
        assert len(got) == len(data)
        for k in ("a", "b", None):
            own = sorted((r for r in data if r[0] == k), key=lambda r: (r[2] is not None, r[2] or 0, r[1]))
            for i, r in enumerate(own):
                upto = own[: i + inclusive]
                last = [x[2] for x in upto if x[2] is not None]
                assert got[r[1]] == (sum(x[3] for x in upto), max((x[3] for x in upto), default=None), last[-1] if last else None)


def test_percentiles_as_numpy(spark):
    data = rows()
    at = [0.0, 0.05, 0.5, 0.9, 1.0]
    got = {r.k: r.p for r in percentiles(spark.createDataFrame(data, "k string, id long, v double, w int"), ["k"], "v", at).collect()}
    for k in ("a", "b", None):
        want = np.percentile([r[2] for r in data if r[0] == k and r[2] is not None], [100 * q for q in at])
        assert np.allclose(got[k], want)
    assert percentiles(spark.createDataFrame([], "k string, v double"), ["k"], "v", at).collect() == []
    one = percentiles(spark.range(1).select(F.lit("x").alias("k"), F.lit(2.5).alias("v")), ["k"], "v", at).first()
    assert one.p == [2.5] * 5


def test_ranges_are_of_the_values_alone(spark):
    """Totals of ranges are computed apart from the rows: other cuts there, as other orders of arrival gave them, are wrong results."""
    df = spark.range(150_000).select("id", (F.xxhash64("id") / 2.0**63).alias("v"))
    there = in_ranges(df.repartition(3), [], "v").select("id", "_range")
    back = in_ranges(df.orderBy(F.desc("v")).repartition(17), [], "v").select("id", F.col("_range").alias("_other"))
    assert there.join(back, "id").filter("_range <> _other").count() == 0
    sizes = [r["count"] for r in there.groupBy("_range").count().collect()]
    assert len(sizes) == 256 and max(sizes) < 5 * 150_000 / 256


def test_ranges_of_nulls(spark):
    df = spark.createDataFrame([("a", 1, None), ("a", 2, None), ("b", 3, 1.0)], "k string, id long, v double")
    run = running(in_ranges(df, ["k"], "v"), ["v", "id"], {"n": (F.lit(1), "sum")})
    assert sorted((r.id, r.n) for r in run.collect()) == [(1, 1), (2, 2), (3, 1)]


def test_last_values_of_ranges_are_found_by_range(spark):
    """Rows come from a join by pool; a window that takes them as they are sorts a whole pool in one task."""
    df = spark.range(1000).select((F.col("id") % 3).alias("k"), "id", (F.col("id") * 7 % 31).alias("v"))
    run = running(in_ranges(df, ["k"], "v"), ["v", "id"], {"l": ("id", "last")})
    most = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # as if the tables were large
    try:
        plan = run._jdf.queryExecution().executedPlan().toString().split("\n")
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", most)
    steps = [next(x for x in plan[i:] if "Exchange" in x or "Join" in x) for i, line in enumerate(plan) if "Window [row_number()" in line]
    assert steps and all("Exchange hashpartitioning(_pool" in x and "_range" in x for x in steps)
