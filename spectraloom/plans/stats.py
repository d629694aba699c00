"""Queries of statistics, noise and overlaps, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import statistics as st
from ..sources import tables as tb
from .assign import _points
from .extra import _r, _standards


def _rank(method):
    return lambda s, d: st.ranks(tb.hits(s, d), ("run_id",), "score", method).select("run_id", "hit_id", "rank")


QUERIES = {
    "histogram": lambda s, d: st.histogram(tb.hits(s, d), ("run_id",), "score", 0.0, 5.0, 60).select("run_id", "bin", "left", "n", "cumulative"),
    **{f"ranks_{m}": _rank(m) for m in ("average", "min", "max", "dense")},
    "bandwidth": lambda s, d: st.bandwidth(tb.hits(s, d), ("run_id", "charge"), "score").select("run_id", "charge", "n", *_r("bandwidth", digits=6)),
    "score_density": lambda s, d: st.density(tb.hits(s, d), ("run_id",), "score", 2.0, 6.0).select("run_id", "cell", *_r("at"), *_r("density", digits=9)),
    "regressions": lambda s, d: st.regressions(tb.features(s, d).select("map_id", (F.col("rt") / 1000).alias("x"), (F.col("mz") / 100 + F.col("rt") * F.col("rt") / 1e6).alias("y")), ("map_id",), "x", "y").select("map_id", "n", *_r("slope", "intercept", "r2", "slope0", "a", "b", "c", digits=5)),
    "trace_moments": lambda s, d: st.weighted_moments(_points(s, d), ("run_id", "target"), "rt", "intensity").select("run_id", "target", *_r("mean", "variance", "height", digits=3)),
    "score_models": lambda s, d: st.score_models(tb.hits(s, d)).select("run_id", *_r("mu", "sigma", "shape", "rate", "share", digits=5)),
    "mean_noise": lambda s, d: st.mean_noise(tb.peaks(s, d)).select("spectrum_id", "peak_id", *_r("sn", digits=5)),
    "drop_overlaps": lambda s, d: st.drop_overlaps(tb.features(s, d), 1.0, 50.0).select("map_id", "feature_id", *_r("mz", "rt", "intensity")),
    "merge_chromatograms": lambda s, d: st.merge_chromatograms(_points(s, d), ("run_id",), 25.0).select("run_id", "rt_cell", *_r("rt", "intensity"), "n"),
    "ransac": lambda s, d: st.ransac(_standards(s, d), "rt", "y", 20.0, key=("map_id",)).select("map_id", "cell", *_r("rt", "y")),
}

_RANKS = {
    "average": "rank() OVER w + (COUNT(*) OVER (PARTITION BY run_id, score) - 1) / 2", "min": "rank() OVER w", "max": "rank() OVER w + COUNT(*) OVER (PARTITION BY run_id, score) - 1", "dense": "dense_rank() OVER w",
}
_DET = "({a0}) * (({b1}) * ({d2}) - ({b2}) * ({d1})) - ({b0}) * (({a1}) * ({d2}) - ({a2}) * ({d1})) + ({d0}) * (({a1}) * ({b2}) - ({a2}) * ({b1}))"
_COLUMNS = {"1": ("n", "s1", "s2"), "2": ("s1", "s2", "s3"), "3": ("s2", "s3", "s4"), "t": ("t0", "t1", "t2")}


def _det(*names: str) -> str:
    return "(" + _DET.format(**{f"{k}{i}": _COLUMNS[n][i] for k, n in zip("abd", names) for i in range(3)}) + ")"


SQL = {
    "histogram": """WITH b AS (SELECT run_id, least(CAST(floor(score / 5.0) AS BIGINT), 59) AS bin, COUNT(*) AS n FROM hits WHERE score BETWEEN 0 AND 300 GROUP BY ALL)
SELECT run_id, bin, bin * CAST(5.0 AS DOUBLE) AS "left", n, CAST(SUM(n) OVER (PARTITION BY run_id ORDER BY bin) AS BIGINT) AS cumulative FROM b""",
    **{f"ranks_{m}": f"SELECT run_id, hit_id, CAST({e} AS DOUBLE) AS rank FROM hits WINDOW w AS (PARTITION BY run_id ORDER BY score)" for m, e in _RANKS.items()},
    "bandwidth": """SELECT run_id, charge, COUNT(score) AS n, round(0.9 * least(stddev_samp(score), (quantile_cont(score, 0.75) - quantile_cont(score, 0.25)) / 1.34) * pow(COUNT(score), -0.2), 6) AS bandwidth FROM hits GROUP BY ALL""",
    "score_density": """WITH n AS (SELECT run_id, CAST(floor(score / 2.0) AS BIGINT) AS c, COUNT(*) AS n FROM hits GROUP BY ALL), e AS (SELECT *, unnest(range(-12, 13)) AS d FROM n), t AS (SELECT run_id, COUNT(*) AS t FROM hits GROUP BY 1),
s AS (SELECT run_id, c + d AS cell, SUM(n * exp(-pow(d * 2.0 / 6.0, 2) / 2)) AS s FROM e GROUP BY ALL) SELECT run_id, cell, round(CAST((cell + 0.5) * 2.0 AS DOUBLE), 4) AS at, round(s / (t * 6.0 * sqrt(2 * pi())), 9) AS density FROM s JOIN t USING (run_id)""",
    "regressions": f"""WITH p AS (SELECT map_id, rt / 1000 AS x, mz / 100 + rt * rt / 1e6 AS y FROM features), s AS (SELECT map_id, COUNT(*) AS n, regr_slope(y, x) AS slope, regr_intercept(y, x) AS intercept, regr_r2(y, x) AS r2, SUM(x) AS s1, SUM(x * x) AS s2,
SUM(x * x * x) AS s3, SUM(x * x * x * x) AS s4, SUM(y) AS t0, SUM(x * y) AS t1, SUM(x * x * y) AS t2 FROM p GROUP BY 1)
SELECT map_id, n, round(slope, 5) AS slope, round(intercept, 5) AS intercept, round(r2, 5) AS r2, round(t1 / s2, 5) AS slope0, round({_det('t', '2', '3')} / {_det('1', '2', '3')}, 5) AS a, round({_det('1', 't', '3')} / {_det('1', '2', '3')}, 5) AS b, round({_det('1', '2', 't')} / {_det('1', '2', '3')}, 5) AS c FROM s""",
    "trace_moments": """WITH t AS (SELECT run_id, CAST(floor(mz / 100) AS BIGINT) AS target, rt, CAST(SUM(intensity) AS DOUBLE) AS w FROM peaks GROUP BY ALL), s AS (SELECT run_id, target, SUM(greatest(w, 0)) AS w, SUM(greatest(w, 0) * rt) AS m, SUM(greatest(w, 0) * rt * rt) AS q FROM t GROUP BY ALL),
v AS (SELECT run_id, target, w, m / w AS mean, greatest(q / w - (m / w) * (m / w), 0.0) AS variance FROM s WHERE w > 0) SELECT run_id, target, round(mean, 3) AS mean, round(variance, 3) AS variance, round(CASE WHEN variance > 0 THEN w / sqrt(2 * pi() * variance) END, 3) AS height FROM v""",
    "score_models": """WITH s AS (SELECT run_id, AVG(CASE WHEN NOT decoy THEN score END) AS mu, stddev_pop(CASE WHEN NOT decoy THEN score END) AS sigma, AVG(CASE WHEN decoy AND score > 0 THEN score END) AS m, var_pop(CASE WHEN decoy AND score > 0 THEN score END) AS v, AVG(CASE WHEN decoy THEN 0.0 ELSE 1.0 END) AS share FROM hits GROUP BY 1)
SELECT run_id, round(mu, 5) AS mu, round(sigma, 5) AS sigma, round(m * m / v, 5) AS shape, round(m / v, 5) AS rate, round(share, 5) AS share FROM s""",
    "mean_noise": """WITH p AS (SELECT *, floor(mz / 200.0) AS b FROM peaks), m1 AS (SELECT spectrum_id, b, AVG(intensity) AS m, stddev_pop(intensity) AS s FROM p GROUP BY ALL),
m2 AS (SELECT p.spectrum_id, p.b, AVG(intensity) AS m, stddev_pop(intensity) AS s FROM p JOIN m1 USING (spectrum_id, b) WHERE intensity <= m + 3 * s GROUP BY ALL), m3 AS (SELECT p.spectrum_id, p.b, AVG(intensity) AS m FROM p JOIN m2 USING (spectrum_id, b) WHERE intensity <= m + 3 * s GROUP BY ALL)
SELECT spectrum_id, peak_id, round(intensity / greatest(m, 1.0), 5) AS sn FROM p JOIN m3 USING (spectrum_id, b)""",
    "drop_overlaps": """SELECT map_id, feature_id, round(mz, 4) AS mz, round(rt, 4) AS rt, round(intensity, 4) AS intensity FROM features a WHERE NOT EXISTS (SELECT 1 FROM features b WHERE a.map_id = b.map_id AND a.charge = b.charge AND a.mz >= b.mz - 1.0 AND a.mz <= b.mz + 1.0
AND abs(a.rt - b.rt) <= 50.0 AND (b.intensity > a.intensity OR (b.intensity = a.intensity AND b.feature_id < a.feature_id)))""",
    "merge_chromatograms": """WITH t AS (SELECT run_id, floor(mz / 100) AS target, rt, SUM(intensity) AS i FROM peaks GROUP BY ALL)
SELECT run_id, CAST(floor(rt / 25.0) AS BIGINT) AS rt_cell, round(COALESCE(SUM(greatest(i, 0) * rt) / NULLIF(SUM(greatest(i, 0)), 0), AVG(rt)), 4) AS rt, round(SUM(i), 4) AS intensity, COUNT(*) AS n FROM t GROUP BY ALL""",
}
SQL = {k: tb.sql(v) for k, v in SQL.items()}
