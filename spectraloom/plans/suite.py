"""The registered queries: name -> (spark, folder of tables) -> DataFrame, and the same in SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import chemistry as ch
from ..operators import filters as fi
from ..operators import identification as idn
from ..operators import joins as jo
from ..sources import tables as tb
from ..sources.tables import sql as _sql
from ..streaming import merge as mg
from . import assign, deep, extra, more, stats
from .sqltext import PARTS, count_sql

FLAGSHIP = "region_aggregation"


def _r(*names, digits=4):
    return [F.round(n, digits).alias(n) for n in names]


def _peaks(f, *extra):
    return lambda s, d: f(tb.peaks(s, d)).select("spectrum_id", "peak_id", *_r("mz", "intensity"), *extra)


def _precursors(s, d):
    return tb.peaks(s, d).select("spectrum_id", F.col("peak_id").alias("precursor_id"), F.col("mz").alias("precursor_mz"))


def _targets(s, d):
    return s.read.parquet(f"{d}/supplier.parquet").select(F.col("s_suppkey").alias("target"), (F.col("s_suppkey") % 997 * 0.9 + 20.0).alias("target_mz"))


QUERIES = {
    "normalize_to_one": _peaks(fi.normalize),
    "normalize_to_tic": lambda s, d: fi.normalize(tb.peaks(s, d), "to_tic").select("spectrum_id", "peak_id", *_r("mz"), *_r("intensity", digits=8)),
    "threshold": _peaks(lambda p: fi.threshold(p, 2500.0)),
    "n_largest": _peaks(lambda p: fi.n_largest(p, 20)),
    "sqrt_scale": _peaks(fi.sqrt_scale),
    "rank_scale": _peaks(fi.rank_scale),
    "window_mower_slide": _peaks(lambda p: fi.window_mower(p, 50.0, 2, "slide")),
    "window_mower_jump": _peaks(lambda p: fi.window_mower(p, 50.0, 2, "jump")),
    "resample": lambda s, d: fi.resample(tb.peaks(s, d), 25.0).select("spectrum_id", F.col("grid").cast("long").alias("grid"), *_r("mz", "intensity", digits=6)),
    "savitzky_golay": _peaks(fi.savitzky_golay),
    "gaussian_smoothing": _peaks(fi.gaussian),
    "top_hat_baseline": _peaks(fi.top_hat),
    "pick_peaks": lambda s, d: fi.pick_peaks(tb.peaks(s, d)).select("spectrum_id", "peak_id", *_r("mz", "intensity", digits=6)),
    "signal_to_noise": lambda s, d: fi.signal_to_noise(tb.peaks(s, d)).select("spectrum_id", "peak_id", *_r("sn")),
    "deisotope": _peaks(lambda p: fi.deisotope(p, 0.05)),
    "region_aggregation": lambda s, d: jo.aggregate_regions(tb.peaks(s, d), tb.regions(s, d)).select("region", *_r("total", "highest", "lowest", "mean"), "n"),
    "total_ion_current": lambda s, d: tb.peaks(s, d).groupBy("run_id", "spectrum_id").agg(F.sum("intensity").alias("tic"), F.max("intensity").alias("base_peak"), F.count("*").alias("n_peaks")).select("run_id", "spectrum_id", *_r("tic", "base_peak"), "n_peaks"),
    "spectrum_count": lambda s, d: tb.peaks(s, d).groupBy("run_id", "ms_level").agg(F.countDistinct("spectrum_id").alias("n_spectra"), F.count("*").alias("n_peaks")),
    "experiment_summary": lambda s, d: tb.peaks(s, d).groupBy("run_id").agg(F.min("mz").alias("mz_low"), F.max("mz").alias("mz_high"), F.min("rt").alias("rt_low"), F.max("rt").alias("rt_high"), F.max("intensity").alias("highest")).select("run_id", *_r("mz_low", "mz_high", "rt_low", "rt_high", "highest")),
    "extract_chromatograms": lambda s, d: jo.extract_chromatograms(tb.peaks(s, d), _targets(s, d)).select("target", "run_id", "rt", *_r("intensity"), "n"),
    "precursor_purity": lambda s, d: jo.precursor_purity(tb.peaks(s, d), _precursors(s, d), 0.5, 10.0).select("precursor_id", *_r("total", "target", "purity"), "n_peaks"),
    "link_features": lambda s, d: jo.link_features(tb.features(s, d).filter("map_id = 0"), tb.features(s, d).filter("map_id = 1"), 2.0, 100.0).select("a_id", "b_id", *_r("d")),
    "nearest_before": lambda s, d: jo.nearest_before(tb.features(s, d).filter("map_id = 0").select("charge", "rt", "feature_id"), tb.features(s, d).filter("map_id = 1").groupBy("charge", "rt").agg(F.avg("mz").alias("mz")), "charge", "rt", "mz").select("feature_id", *_r("mz_before")),
    "linear_alignment": lambda s, d: jo.linear_alignment(tb.features(s, d).withColumn("y", F.col("rt") * 1.02 + 3 + F.col("charge")), "rt", "y").select(*_r("slope", "intercept"), "n"),
    "normalize_median": lambda s, d: jo.normalize_median(tb.features(s, d)).select("map_id", "feature_id", *_r("intensity", digits=2)),
    "binned_cosine": lambda s, d: jo.binned_cosine(tb.peaks(s, d), tb.peaks(s, d).select(F.col("spectrum_id").alias("a")).distinct().select("a", (F.col("a") + 1).alias("b"))).select("a", "b", *_r("cosine")),
    "best_hits": lambda s, d: idn.best_hits(tb.hits(s, d), 3).select("spectrum_id", "hit_id", "rank", *_r("score")),
    "filter_hits": lambda s, d: idn.filter_hits(tb.hits(s, d), 5.0, False, (2, 3)).select("hit_id", "accession", "charge", *_r("score")),
    "fdr_conservative": lambda s, d: idn.apply_fdr(tb.hits(s, d), ["run_id"]).select("hit_id", *_r("fdr", "q_value", digits=8)),
    "fdr_basic": lambda s, d: idn.apply_fdr(tb.hits(s, d), ["charge"], "basic", True).select("hit_id", *_r("fdr", "q_value", digits=8)),
    "fdr_legacy": lambda s, d: idn.score_curve(tb.hits(s, d), ["run_id"], "legacy").select("run_id", *_r("score"), *_r("fdr", "q_value", digits=8)),
    "fdr_estimated": lambda s, d: idn.estimated_fdr(tb.hits(s, d).withColumn("pep", F.lit(1.0) / (1 + F.col("score"))), ["run_id"], "pep").select("hit_id", *_r("q_value", digits=6)),
    "protein_scores": lambda s, d: idn.protein_scores(tb.hits(s, d)).select("accession", "n_spectra", "n_hits", *_r("best", "total")),
    "picked_competition": lambda s, d: idn.picked_competition(tb.hits(s, d)).select("accession", "decoy", *_r("score"), *_r("q_value", digits=8)),
    "consensus_id": lambda s, d: idn.consensus(tb.hits(s, d)).select("spectrum_id", "accession", *_r("score"), "n"),
    "resolve_conflicts": lambda s, d: idn.resolve_conflicts(tb.hits(s, d).withColumn("feature_id", F.col("hit_id") % 997)).select("feature_id", "hit_id", *_r("score")),
    "digest": lambda s, d: ch.digest(tb.sequences(s, d), 1, 2, 30).select("accession", "peptide", F.col("start").cast("long").alias("start"), F.col("missed").cast("long").alias("missed")),
    "peptide_properties": lambda s, d: tb.sequences(s, d).select("accession", ch.peptide_mass(F.col("sequence")).alias("mass"), ch.gravy(F.col("sequence")).alias("gravy"), ch.net_charge(F.col("sequence"), 7.0).alias("charge")).select("accession", *_r("mass", "gravy", "charge")),
    "fragment_ions": lambda s, d: ch.fragment_ions(ch.digest(tb.sequences(s, d), 0, 4, 40).select("peptide").distinct()).select("peptide", "ion", F.col("position").cast("long").alias("position"), *_r("mz")),
    "decoy_sequences": lambda s, d: tb.sequences(s, d).select("accession", ch.decoy_sequence(F.col("sequence")).alias("decoy")),
    "missed_cleavages": lambda s, d: tb.sequences(s, d).select((F.size(ch.cut_tryptic(F.col("sequence"))) - 1).cast("long").alias("missed")).groupBy("missed").agg(F.count("*").alias("n")),
    "isoelectric_point": lambda s, d: tb.sequences(s, d).select("accession", F.round(ch.isoelectric_point(F.col("sequence")), 4).alias("pi")),
    "merge_spectra": lambda s, d: mg.merge_spectra(tb.peaks(s, d), 10.0).select("run_id", F.col("rt_cell").cast("long").alias("rt_cell"), F.col("mz_cell").cast("long").alias("mz_cell"), *_r("intensity"), "n"),
}

_P = "spectrum_id, peak_id, round(mz, 4) AS mz"
_HITS_CURVE = """SELECT h.hit_id, round(c.fdr, 8) AS fdr, round(c.q_value, 8) AS q_value FROM hits h JOIN c USING ({pool}, score)"""


def _curve(pool: str, value: str) -> str:
    return f"""WITH n AS (SELECT {pool}, score, SUM(CASE WHEN decoy THEN 0 ELSE 1 END) AS t, SUM(CASE WHEN decoy THEN 1 ELSE 0 END) AS d FROM hits GROUP BY ALL),
r AS (SELECT *, SUM(t) OVER w AS tt, SUM(d) OVER w AS dd FROM n WINDOW w AS (PARTITION BY {pool} ORDER BY score DESC)),
f AS (SELECT *, {value} AS fdr FROM r),
c AS (SELECT *, LEAST(MIN(fdr) OVER (PARTITION BY {pool} ORDER BY score DESC ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING), 1.0) AS q_value FROM f) """


_PARTS, _count = PARTS, count_sql
_CHARGE = {k: z / (1 + 10.0 ** (z * (7.0 - pk))) for k, (pk, z) in ch._PK.items()}
_ENDS = sum(z / (1 + 10.0 ** (z * (7.0 - pk))) for pk, z in ch._PK_ENDS)

SQL = {
    "normalize_to_one": f"SELECT {_P}, round(CASE WHEN MAX(intensity) OVER w > 0 THEN intensity / MAX(intensity) OVER w ELSE intensity END, 4) AS intensity FROM peaks WINDOW w AS (PARTITION BY spectrum_id)",
    "normalize_to_tic": f"SELECT {_P}, round(CASE WHEN SUM(intensity) OVER w > 0 THEN intensity / SUM(intensity) OVER w ELSE intensity END, 8) AS intensity FROM peaks WINDOW w AS (PARTITION BY spectrum_id)",
    "threshold": f"SELECT {_P}, round(intensity, 4) AS intensity FROM peaks WHERE intensity >= 2500.0",
    "n_largest": f"SELECT {_P}, round(intensity, 4) AS intensity FROM peaks QUALIFY row_number() OVER (PARTITION BY spectrum_id ORDER BY intensity DESC, peak_id) <= 20",
    "sqrt_scale": f"SELECT {_P}, round(sqrt(greatest(intensity, 0.0)), 4) AS intensity FROM peaks",
    "rank_scale": f"SELECT {_P}, CAST(COUNT(*) OVER (PARTITION BY spectrum_id) + 1 - dense_rank() OVER (PARTITION BY spectrum_id ORDER BY intensity DESC) + CASE WHEN MAX(intensity) OVER (PARTITION BY spectrum_id) = 0 THEN 1 ELSE 0 END AS DOUBLE) AS intensity FROM peaks",
    "window_mower_slide": """SELECT spectrum_id, peak_id, round(any_value(mz), 4) AS mz, round(any_value(intensity), 4) AS intensity FROM (
SELECT b.*, row_number() OVER (PARTITION BY a.peak_id ORDER BY b.intensity DESC, b.mz, b.peak_id) AS r FROM peaks a JOIN peaks b ON a.spectrum_id = b.spectrum_id AND b.mz - a.mz < 50.0
AND (b.mz > a.mz OR (b.mz = a.mz AND b.peak_id >= a.peak_id))) WHERE r <= 2 GROUP BY spectrum_id, peak_id""",
    "resample": """WITH lim AS (SELECT spectrum_id, MIN(mz) AS lo, MAX(mz) AS hi FROM peaks GROUP BY 1),
x AS (SELECT spectrum_id, (mz - lo) / 25.0 AS x, intensity FROM peaks JOIN lim USING (spectrum_id)),
v AS (SELECT spectrum_id, CAST(floor(x) AS BIGINT) AS grid, intensity * (1 - (x - floor(x))) AS v FROM x UNION ALL SELECT spectrum_id, CAST(floor(x) AS BIGINT) + 1, intensity * (x - floor(x)) FROM x),
g AS (SELECT spectrum_id, lo, unnest(range(0, CAST(ceil((hi - lo) / 25.0) AS BIGINT) + 1)) AS grid FROM lim)
SELECT spectrum_id, grid, round(any_value(lo) + grid * 25.0, 6) AS mz, round(COALESCE(SUM(v), 0.0), 6) AS intensity FROM g LEFT JOIN v USING (spectrum_id, grid) GROUP BY spectrum_id, grid""",
    "savitzky_golay": f"""SELECT {_P}, round(greatest(COALESCE((lag(intensity, 2) OVER w * -3 + lag(intensity) OVER w * 12 + intensity * 17 + lead(intensity) OVER w * 12 + lead(intensity, 2) OVER w * -3) / 35, intensity), 0.0), 4) AS intensity
FROM peaks WINDOW w AS (PARTITION BY spectrum_id ORDER BY mz, peak_id)""",
    "gaussian_smoothing": """WITH o AS (SELECT *, row_number() OVER (PARTITION BY spectrum_id ORDER BY mz, peak_id) AS r FROM peaks)
SELECT a.spectrum_id, a.peak_id, round(any_value(a.mz), 4) AS mz, round(SUM(exp(-pow((b.mz - a.mz) / 0.125, 2) / 2) * b.intensity) / SUM(exp(-pow((b.mz - a.mz) / 0.125, 2) / 2)), 4) + 0.0 AS intensity
FROM o a JOIN o b ON a.spectrum_id = b.spectrum_id AND b.r BETWEEN a.r - 4 AND a.r + 4 GROUP BY a.spectrum_id, a.peak_id""",
    "top_hat_baseline": f"""WITH e AS (SELECT *, MIN(intensity) OVER (PARTITION BY spectrum_id ORDER BY mz, peak_id ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING) AS e FROM peaks)
SELECT {_P}, round(intensity - MAX(e) OVER (PARTITION BY spectrum_id ORDER BY mz, peak_id ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING), 4) AS intensity FROM e""",
    "pick_peaks": """WITH n AS (SELECT *, lag(mz) OVER w - mz AS x0, lag(intensity) OVER w AS y0, lead(mz) OVER w - mz AS x2, lead(intensity) OVER w AS y2 FROM peaks WINDOW w AS (PARTITION BY spectrum_id ORDER BY mz, peak_id)),
p AS (SELECT *, ((y2 - intensity) / x2 - (y0 - intensity) / x0) / (x2 - x0) AS a FROM n WHERE intensity > y0 AND intensity >= y2 AND x0 < 0 AND x2 > 0),
q AS (SELECT *, (y0 - intensity) / x0 - a * x0 AS b FROM p),
s AS (SELECT *, CASE WHEN a < 0 THEN greatest(x0, least(x2, -b / (2 * a))) ELSE 0.0 END AS shift FROM q)
SELECT spectrum_id, peak_id, round(mz + shift, 6) AS mz, round(intensity + b * shift + a * shift * shift, 6) AS intensity FROM s""",
    "signal_to_noise": """SELECT spectrum_id, peak_id, round(intensity / greatest(quantile_cont(intensity, 0.5) OVER (PARTITION BY spectrum_id, floor(mz / 100.0)), 1.0), 4) AS sn FROM peaks""",
    "deisotope": f"""SELECT {_P}, round(intensity, 4) AS intensity FROM peaks p WHERE NOT EXISTS (SELECT 1 FROM peaks b WHERE b.spectrum_id = p.spectrum_id AND b.intensity >= p.intensity AND abs(p.mz - (b.mz + 1.00335)) <= 0.05)""",
    "region_aggregation": """SELECT r.region, round(SUM(intensity), 4) AS total, round(MAX(intensity), 4) AS highest, round(MIN(intensity), 4) AS lowest, round(AVG(intensity), 4) AS mean, COUNT(intensity) AS n
FROM regions r LEFT JOIN peaks p ON p.mz BETWEEN mz_low AND mz_high AND p.rt BETWEEN rt_low AND rt_high GROUP BY r.region""",
    "total_ion_current": "SELECT run_id, spectrum_id, round(SUM(intensity), 4) AS tic, round(MAX(intensity), 4) AS base_peak, COUNT(*) AS n_peaks FROM peaks GROUP BY ALL",
    "spectrum_count": "SELECT run_id, ms_level, COUNT(DISTINCT spectrum_id) AS n_spectra, COUNT(*) AS n_peaks FROM peaks GROUP BY ALL",
    "experiment_summary": "SELECT run_id, round(MIN(mz), 4) AS mz_low, round(MAX(mz), 4) AS mz_high, round(MIN(rt), 4) AS rt_low, round(MAX(rt), 4) AS rt_high, round(MAX(intensity), 4) AS highest FROM peaks GROUP BY run_id",
    "extract_chromatograms": """WITH t AS (SELECT s_suppkey AS target, s_suppkey % 997 * CAST(0.9 AS DOUBLE) + 20.0 AS target_mz FROM supplier)
SELECT target, run_id, rt, round(SUM(intensity), 4) AS intensity, COUNT(*) AS n FROM peaks JOIN t ON mz >= target_mz - target_mz * CAST(0.001 AS DOUBLE) AND mz <= target_mz + target_mz * CAST(0.001 AS DOUBLE) GROUP BY ALL""",
    "precursor_purity": """WITH c AS (SELECT spectrum_id, peak_id AS precursor_id, mz AS precursor_mz FROM peaks),
s AS (SELECT precursor_id, SUM(intensity) AS total, SUM(CASE WHEN abs(mz - precursor_mz) <= 0.5 THEN intensity ELSE 0.0 END) AS target, COUNT(*) AS n_peaks FROM peaks JOIN c USING (spectrum_id) WHERE mz BETWEEN precursor_mz - 5.0 AND precursor_mz + 5.0 GROUP BY 1)
SELECT precursor_id, round(total, 4) AS total, round(target, 4) AS target, round(CASE WHEN total > 0 THEN target / total ELSE 0.0 END, 4) AS purity, n_peaks FROM s""",
    "link_features": """WITH d AS (SELECT a.feature_id AS a_id, b.feature_id AS b_id, pow((a.mz - b.mz) / 2.0, 2) + pow((a.rt - b.rt) / 100.0, 2) AS d FROM features a JOIN features b
ON a.map_id = 0 AND b.map_id = 1 AND a.charge = b.charge AND abs(a.rt - b.rt) <= 100.0 AND a.mz >= b.mz - 2.0 AND a.mz <= b.mz + 2.0)
SELECT a_id, b_id, round(d, 4) AS d FROM d QUALIFY row_number() OVER (PARTITION BY a_id ORDER BY d.d, b_id) = 1 AND row_number() OVER (PARTITION BY b_id ORDER BY d.d, a_id) = 1""",
    "nearest_before": """WITH l AS (SELECT charge, rt, feature_id FROM features WHERE map_id = 0), r AS (SELECT charge, rt, AVG(mz) AS mz FROM features WHERE map_id = 1 GROUP BY ALL)
SELECT feature_id, round(r.mz, 4) AS mz_before FROM l ASOF LEFT JOIN r ON l.charge = r.charge AND l.rt >= r.rt""",
    "linear_alignment": "SELECT round(regr_slope(rt * CAST(1.02 AS DOUBLE) + 3 + charge, rt), 4) AS slope, round(regr_intercept(rt * CAST(1.02 AS DOUBLE) + 3 + charge, rt), 4) AS intercept, COUNT(*) AS n FROM features",
    "normalize_median": "WITH m AS (SELECT map_id, quantile_cont(intensity, 0.5) AS m FROM features GROUP BY 1) SELECT map_id, feature_id, round(intensity * ((SELECT m FROM m WHERE map_id = 0) / m), 2) AS intensity FROM features JOIN m USING (map_id)",
    "binned_cosine": """WITH v AS (SELECT spectrum_id, floor(mz / 10.0) AS b, SUM(intensity) AS x FROM peaks GROUP BY ALL), n AS (SELECT spectrum_id, sqrt(SUM(x * x)) AS n FROM v GROUP BY 1),
d AS (SELECT p.spectrum_id AS a, SUM(p.x * q.x) AS dot FROM v p JOIN v q ON q.spectrum_id = p.spectrum_id + 1 AND p.b = q.b GROUP BY 1)
SELECT na.spectrum_id AS a, nb.spectrum_id AS b, round(COALESCE(dot, 0.0) / (na.n * nb.n), 4) AS cosine FROM n na JOIN n nb ON nb.spectrum_id = na.spectrum_id + 1 LEFT JOIN d ON d.a = na.spectrum_id""",
    "best_hits": "SELECT spectrum_id, hit_id, CAST(row_number() OVER (PARTITION BY spectrum_id ORDER BY score DESC, hit_id) AS INTEGER) AS rank, round(score, 4) AS score FROM hits QUALIFY rank <= 3",
    "filter_hits": "SELECT hit_id, accession, charge, round(score, 4) AS score FROM hits WHERE score >= 5.0 AND NOT decoy AND charge IN (2, 3)",
    "fdr_conservative": _curve("run_id", "(dd + 1) / (tt + 1)") + _HITS_CURVE.format(pool="run_id") + " WHERE NOT h.decoy",
    "fdr_basic": _curve("charge", "(dd + 1) / (tt + dd + 1)") + _HITS_CURVE.format(pool="charge"),
    "fdr_legacy": _curve("run_id", "CASE WHEN tt > 0 THEN dd / tt ELSE 1.0 END") + "SELECT run_id, round(score, 4) AS score, round(fdr, 8) AS fdr, round(q_value, 8) AS q_value FROM c",
    "fdr_estimated": "SELECT hit_id, round(AVG(1.0 / (1 + score)) OVER (PARTITION BY run_id ORDER BY 1.0 / (1 + score)), 6) AS q_value FROM hits",
    "protein_scores": "WITH b AS (SELECT * FROM hits QUALIFY row_number() OVER (PARTITION BY spectrum_id ORDER BY score DESC, hit_id) = 1) SELECT accession, COUNT(DISTINCT spectrum_id) AS n_spectra, COUNT(*) AS n_hits, round(MAX(score), 4) AS best, round(SUM(score), 4) AS total FROM b GROUP BY 1",
    "picked_competition": """WITH b AS (SELECT accession, MAX(CASE WHEN NOT decoy THEN score END) AS t, MAX(CASE WHEN decoy THEN score END) AS d FROM hits GROUP BY 1),
o AS (SELECT accession, greatest(t, d) AS score, COALESCE(t, -1e300) < COALESCE(d, -1e300) AS decoy FROM b),
n AS (SELECT score, SUM(CASE WHEN decoy THEN 0 ELSE 1 END) AS t, SUM(CASE WHEN decoy THEN 1 ELSE 0 END) AS d FROM o GROUP BY 1),
f AS (SELECT score, (SUM(d) OVER w + 1) / (SUM(t) OVER w + 1) AS fdr FROM n WINDOW w AS (ORDER BY score DESC)),
q AS (SELECT score, least(MIN(fdr) OVER (ORDER BY score DESC ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING), 1.0) AS q_value FROM f)
SELECT accession, decoy, round(score, 4) AS score, round(q_value, 8) AS q_value FROM o JOIN q USING (score)""",
    "consensus_id": "WITH b AS (SELECT spectrum_id, accession, run_id, MAX(score) AS s FROM hits GROUP BY ALL) SELECT spectrum_id, accession, round(AVG(s), 4) AS score, COUNT(*) AS n FROM b GROUP BY ALL",
    "resolve_conflicts": "SELECT hit_id % 997 AS feature_id, hit_id, round(score, 4) AS score FROM hits QUALIFY row_number() OVER (PARTITION BY hit_id % 997 ORDER BY score DESC, hit_id) = 1",
    "digest": f"""WITH p AS (SELECT accession, {_PARTS} AS p FROM sequences), s AS (SELECT accession, p, unnest(range(0, len(p))) AS start FROM p), m AS (SELECT *, unnest([0, 1]) AS missed FROM s)
SELECT * FROM (SELECT accession, array_to_string(list_slice(p, start + 1, start + 1 + missed), '') AS peptide, start, CAST(missed AS BIGINT) AS missed FROM m WHERE start + missed < len(p)) WHERE length(peptide) BETWEEN 2 AND 30""",
    "peptide_properties": f"SELECT accession, round(CASE WHEN length(sequence) > 0 THEN {_count(ch.RESIDUES)} + {ch.WATER!r} ELSE 0.0 END, 4) AS mass, round({_count(ch.HYDROPATHY)} / NULLIF(length(sequence), 0), 4) AS gravy, round({_count(_CHARGE)} + CAST({_ENDS!r} AS DOUBLE), 4) AS charge FROM sequences",
    "fragment_ions": f"""WITH p AS (SELECT DISTINCT peptide FROM (SELECT unnest({_PARTS}) AS peptide FROM sequences) WHERE length(peptide) BETWEEN 4 AND 40), o AS (SELECT peptide, unnest(range(1, length(peptide))) AS position FROM p)
SELECT peptide, 'b' AS ion, position, round({_count(ch.RESIDUES, 'left(peptide, position)')} + {ch.PROTON!r}, 4) AS mz FROM o UNION ALL SELECT peptide, 'y', position, round({_count(ch.RESIDUES, 'right(peptide, position)')} + {ch.WATER!r} + {ch.PROTON!r}, 4) FROM o""",
    "decoy_sequences": "SELECT accession, reverse(left(sequence, greatest(length(sequence) - 1, 0))) || right(sequence, 1) AS decoy FROM sequences",
    "missed_cleavages": f"SELECT CAST(len({_PARTS}) - 1 AS BIGINT) AS missed, COUNT(*) AS n FROM sequences GROUP BY 1",
    "merge_spectra": "SELECT run_id, CAST(floor(rt / 10.0) AS BIGINT) AS rt_cell, CAST(floor(mz / 10.0) AS BIGINT) AS mz_cell, round(SUM(intensity), 4) AS intensity, COUNT(*) AS n FROM peaks GROUP BY ALL",
}
SQL = {k: _sql(v) for k, v in SQL.items()} | more.SQL | extra.SQL | assign.SQL | stats.SQL | deep.SQL
QUERIES |= more.QUERIES | extra.QUERIES | assign.QUERIES | stats.QUERIES | deep.QUERIES
