"""Features of several maps: shifts by pose clustering, stable and labelled pairs, evaluation, normalisation, spectra of features."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .joins import mutual, nearest_in_boxes, range_join
from .ranges import in_ranges, running


def pose_shift(model: DataFrame, scene: DataFrame, mz_tolerance: float = 0.5, bucket: float = 3.0, largest: float = 1000.0, points: int | None = 2000) -> DataFrame:
    """(bucket, shift, votes): pairs of similar m/z vote for the difference of their retention times, by similarity of intensity.

    points: the most intense of each map that take part (None: all), an option of the method that bounds the pairs. Rows are
    sums per bucket; the best one is the first by votes."""
    top = lambda d: d if points is None else d.orderBy(F.desc("intensity"), "feature_id").limit(points)
    m = top(model).select(F.col("mz").alias("_mz"), F.col("rt").alias("_rt"), F.col("intensity").alias("_int"))
    near = range_join(top(scene).select("mz", "rt", "intensity"), m, "mz", F.col("_mz") - mz_tolerance, F.col("_mz") + mz_tolerance, 2 * mz_tolerance)
    near = near.withColumn("_s", F.col("_rt") - F.col("rt")).filter(F.abs("_s") <= largest)
    vote = F.least("intensity", "_int") / F.greatest("intensity", "_int")
    votes = near.groupBy(F.floor(F.col("_s") / bucket).cast("long").alias("bucket")).agg(F.sum(vote).alias("votes"), F.sum(vote * F.col("_s")).alias("_w"))
    return votes.select("bucket", F.try_divide("_w", "votes").alias("shift"), "votes")


def stable_pairs(a: DataFrame, b: DataFrame, mz_tolerance: float, rt_tolerance: float, gap: float = 2.0) -> DataFrame:
    """(a_id, b_id, d, quality): mutual nearest neighbours of equal charge whose second-nearest ones are `gap` times as far.

    d: mean of the m/z and RT differences as shares of their tolerances. A feature without a second neighbour counts 1 for it.
    quality: (1 - d)(1 - gap d / d2 of a)(1 - gap d / d2 of b)."""
    row = lambda df: df.select(F.col("feature_id").cast("long").alias("id"), "mz", "rt", "charge")
    near = mutual(nearest_in_boxes(row(a), row(b), mz_tolerance, rt_tolerance, "mean", ("charge",)))
    one = near.withColumn("_da", F.coalesce("d2_a", F.lit(1.0))).withColumn("_db", F.coalesce("d2_b", F.lit(1.0))).filter((gap * F.col("d") <= F.col("_da")) & (gap * F.col("d") <= F.col("_db")))
    part = lambda c: 1 - F.coalesce(F.try_divide(gap * F.col("d"), F.col(c)), F.lit(0.0))
    return one.select("a_id", "b_id", "d", ((1 - F.col("d")) * part("_da") * part("_db")).alias("quality"))


def labelled_pairs(features: DataFrame, mz_distance: float = 4.0, mz_tolerance: float = 0.05, rt_distance: float = -20.0, rt_low: float = 15.0, rt_high: float = 15.0) -> DataFrame:
    """(map_id, charge, light_id, heavy_id, score): features of one map and charge at a label's distance in m/z and RT.

    score: product of Gaussian weights of the two deviations. A pair stands where each is the other's best (ties: smaller id)."""
    heavy = features.select("map_id", "charge", F.col("feature_id").alias("heavy_id"), F.col("mz").alias("_mz"), F.col("rt").alias("_rt"))
    light = features.select("map_id", "charge", F.col("feature_id").alias("light_id"), "mz", "rt").withColumn("_want", F.col("mz") + mz_distance / F.col("charge"))
    near = range_join(light, heavy, "_want", F.col("_mz") - mz_tolerance, F.col("_mz") + mz_tolerance, max(1.0, 2 * mz_tolerance), ("map_id", "charge"))
    dr = F.col("_rt") - F.col("rt") - rt_distance
    near = near.filter((dr >= -rt_low) & (dr <= rt_high) & (F.col("light_id") != F.col("heavy_id")))
    dm = F.col("_mz") - F.col("_want")
    spread = F.when(dr < 0, F.lit(max(rt_low, 1e-9))).otherwise(max(rt_high, 1e-9)) / 2
    near = near.withColumn("score", F.exp(-dm * dm / (2 * (mz_tolerance / 2) ** 2) - dr * dr / (2 * spread * spread)))
    rank = lambda k, o: F.row_number().over(Window.partitionBy("map_id", k).orderBy(F.desc("score"), o))
    one = near.select("*", rank("light_id", "heavy_id").alias("_a"), rank("heavy_id", "light_id").alias("_b")).filter("_a = 1 AND _b = 1")
    return one.select("map_id", "charge", "light_id", "heavy_id", "score")


def evaluate_alignment(truth: DataFrame, tool: DataFrame, element: str = "feature_id") -> DataFrame:
    """(precision, recall) of tool groups (group, element) against true ones, both of two elements at least.

    For each true group: the tool groups that share elements with it; precision is the shared over those groups' sizes, recall the
    shared over their number times the true size; both are 0 where there is none, and means over the true groups."""
    sized = lambda d, g: d.select(F.col("group").alias(g), element).distinct().withColumn(f"n_{g}", F.count("*").over(Window.partitionBy(g))).filter(F.col(f"n_{g}") >= 2)
    t, u = sized(truth, "t"), sized(tool, "u")
    shared = t.join(u, element).groupBy("t", "n_t", "u", "n_u").agg(F.count("*").alias("s"))
    of_t = shared.groupBy("t", "n_t").agg(F.sum("s").alias("s"), F.sum("n_u").alias("n"), F.count("*").alias("m"))
    sums = of_t.agg(F.sum(F.col("s") / F.col("n")).alias("p"), F.sum(F.col("s") / (F.col("m") * F.col("n_t"))).alias("r"))
    total = t.agg(F.countDistinct("t").alias("groups"))
    # both are one row by construction, whatever the input
    return sums.withColumn("_one", F.lit(1)).join(total.withColumn("_one", F.lit(1)), "_one").select(F.try_divide(F.coalesce("p", F.lit(0.0)), "groups").alias("precision"), F.try_divide(F.coalesce("r", F.lit(0.0)), "groups").alias("recall"), "groups")


def ratio_factors(handles: DataFrame, threshold: float = 0.67) -> DataFrame:
    """handles (group, map_id, intensity) -> (map_id, factor): mean ratio of the reference map's intensity to the map's own.

    The reference is the map with most handles (ties: smallest id). Only ratios inside (threshold, 1 / threshold) count;
    handles of intensity 0 are absent. A map without a ratio has factor 1."""
    one = handles.filter(F.col("intensity") != 0)
    reference = handles.groupBy("map_id").agg(F.count("*").alias("n")).agg(F.max(F.struct("n", (-F.col("map_id")).alias("k"))).alias("m")).select((-F.col("m.k")).alias("map_id"))
    ref = one.join(reference, "map_id").select("group", F.col("intensity").alias("_ref"))
    ratio = one.join(ref, "group").withColumn("_q", F.col("_ref") / F.col("intensity")).filter((F.col("_q") > threshold) & (F.col("_q") < 1 / threshold))
    mean = ratio.groupBy("map_id").agg(F.avg("_q").alias("factor"))
    return handles.select("map_id").distinct().join(mean, "map_id", "left").fillna(1.0, ["factor"])


def spectra_of_features(precursors: DataFrame, features: DataFrame, mz_tolerance: float, rt_tolerance: float) -> DataFrame:
    """(spectrum_id, feature_id): for each precursor the nearest feature in both windows by m/z, then RT, then id."""
    p = precursors.select(F.col("spectrum_id").cast("long").alias("id"), F.col("precursor_mz").alias("mz"), "rt")
    f = features.select(F.col("feature_id").cast("long").alias("id"), "mz", "rt")
    return nearest_in_boxes(p, f, mz_tolerance, rt_tolerance, "mz", both=False).select(F.col("a_id").alias("spectrum_id"), F.col("b_id").alias("feature_id"))


def interpolate_times(points: DataFrame, anchors: DataFrame, at: str = "rt", key: tuple = ("map_id",)) -> DataFrame:
    """points with `aligned`: linear between the anchors (key, x, y) around them; beyond the first or last one, shifted as that one.

    One union, running over ranges of the time from both sides (as-of joins), so no map is one task's work. Anchors at one x count
    as their mean y; keys without anchors keep their times."""
    a = anchors.filter(F.col("x").isNotNull()).groupBy(*key, "x").agg(F.avg("y").alias("y"))
    both = points.withColumn("_at", F.col(at).cast("double")).withColumn("_own", F.lit(1)).unionByName(a.select(*key, F.col("x").cast("double").alias("_at"), F.struct(F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y")).alias("_p"), F.lit(0).alias("_own")), allowMissingColumns=True)
    p = running(in_ranges(both, key, "_at"), ["_at", "_own"], {"_l": ("_p", "last")}).drop("_pool", "_range").withColumn("_back", F.lit(0.0) - F.col("_at"))
    p = running(in_ranges(p, key, "_back"), ["_back", F.desc("_own")], {"_r": ("_p", "last")}).filter("_own = 1")
    x = F.col("_at")
    inside = F.col("_l.y") + (x - F.col("_l.x")) / (F.col("_r.x") - F.col("_l.x")) * (F.col("_r.y") - F.col("_l.y"))
    beyond = x + F.coalesce(F.col("_l.y") - F.col("_l.x"), F.col("_r.y") - F.col("_r.x"), F.lit(0.0))
    return p.withColumn("aligned", F.when(F.col("_l").isNotNull() & F.col("_r").isNotNull(), inside).otherwise(beyond)).drop("_at", "_own", "_p", "_l", "_r", "_back", "_pool", "_range")
