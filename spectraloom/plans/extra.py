"""Queries of targeted analysis, map matching, peptides and quality metrics, with their SQL."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from ..functions import chemistry as ch
from ..functions import peptides as pe
from ..operators import filters as fi
from ..operators import identification as idn
from ..operators import mapping as mp
from ..operators import quality as qu
from ..operators import runs as rn
from ..operators import scoring as sc
from ..operators import targeted as ta
from ..sources import tables as tb
from .more import _PSM, _psms
from .sqltext import PARTS, count_sql


def _r(*names, digits=4):
    return [F.round(n, digits).alias(n) for n in names]


def _vectors(s, d):
    return tb.peaks(s, d).select("spectrum_id", "peak_id", "rt", F.col("intensity").alias("x"), F.col("mz").alias("y"))


def _maps(s, d):
    f = tb.features(s, d)
    return f.filter("map_id = 0"), f.filter("map_id = 1")


def _short(s, d):
    return ch.digest(tb.sequences(s, d), 0, 4, 40).select("peptide").distinct()


def _swath(s, d):
    n = F.col("n_nationkey")
    return s.read.parquet(f"{d}/nation.parquet").select(n.alias("window"), (n * 40.0).alias("low"), (n * 40.0 + 50.0).alias("high"))


def _traces(s, d):
    return tb.peaks(s, d).groupBy("run_id", F.floor(F.col("mz") / 50.0).alias("target"), "rt").agg(F.sum("intensity").alias("intensity"))


def _truth(s, d):
    f = tb.features(s, d)
    return f.select(F.floor(F.col("feature_id") / 3).alias("group"), "feature_id"), f.select(F.floor((F.col("feature_id") + F.floor(F.col("feature_id") / 10) % 2) / 3).alias("group"), "feature_id")


def _handles(s, d):
    return tb.features(s, d).select(F.floor(F.col("feature_id") / 4).alias("group"), "map_id", "intensity").groupBy("group", "map_id").agg(F.sum("intensity").alias("intensity"))


def _anchors(s, d):
    f = tb.features(s, d)
    return f.groupBy("map_id", F.floor(F.col("rt") / 40).alias("c")).agg(F.avg("rt").alias("x"), F.avg(F.col("rt") * 1.05 + F.col("charge")).alias("y"))


def _standards(s, d):
    cells = tb.features(s, d).groupBy("map_id", F.floor(F.col("rt") / 20).alias("cell")).agg(F.avg("rt").alias("rt"))
    return cells.select("map_id", "cell", "rt", (F.col("rt") + F.when(F.col("cell") % 10 == 0, 400.0).otherwise(1.0)).alias("y"))


_CONDITIONS = [("mz", ">=", 300.0), ("ms_level", "=", 2, "AND"), ("intensity", ">", 4500.0, "OR"), ("run_id", "!=", 3, "AND")]
CHANNELS = {"126": 126.127726, "127": 127.124761, "128": 128.134436, "129": 129.131471, "130": 130.141145, "131": 131.13818}
#: Of channel j's signal, 0.93 is in its own channel, 0.05 in the one above and 0.02 in the one below.
MIXING = [[0.93 if i == j else 0.05 if i == j + 1 else 0.02 if i == j - 1 else 0.0 for j in range(6)] for i in range(6)]


def _shifted(s, d):
    f, k = tb.features(s, d), F.col("feature_id")
    mz = F.when(k % 7 == 0, F.col("mz") * 1.01).when(k % 11 == 0, F.col("mz") + 0.005).otherwise(F.col("mz"))
    return f.select((k + F.when(k % 101 == 0, 1 << 40).otherwise(0)).alias("feature_id"), mz.alias("mz"), "intensity")


def _locks(s, d):
    return s.read.parquet(f"{d}/nation.parquet").select((F.col("n_nationkey") * 35.0 + 120.0).alias("lock_mz"))


def _isolated(s, d):
    return tb.peaks(s, d).groupBy("spectrum_id", F.floor(F.col("mz") / 100).alias("c")).agg(F.avg("mz").alias("precursor_mz")).select("spectrum_id", (F.col("spectrum_id") * 1000 + F.col("c")).alias("precursor_id"), "precursor_mz")


def _digest_sql_rows(enzyme):
    return lambda s, d: pe.digest_with(tb.sequences(s, d), enzyme, 1, 2, 40).select("accession", "peptide", F.col("start").cast("long").alias("start"), F.col("missed").cast("long").alias("missed"))


def _peptide_of(s, d):
    return tb.sequences(s, d).select(F.concat(F.lit("P"), (F.col("accession") % 61).cast("string")).alias("accession"), "sequence").groupBy("accession").agg(F.min("sequence").alias("peptide"))


def _pscore(s, d):
    ranked = qu.window_ranks(tb.peaks(s, d))
    psms = _psms(s, d)
    ions = psms.select("peptide").distinct().select("peptide", (2 * (F.length("peptide") - 1)).alias("n"))
    return qu.peak_level_score(ranked, sc.match_ions(tb.peaks(s, d), psms, 0.5), ions, 0.5)


def _curve(s, d):
    counts = tb.hits(s, d).groupBy("run_id", "score").agg(F.sum((~F.col("decoy")).cast("long")).alias("n"))
    return idn.score_curve(tb.hits(s, d), ["run_id"]).join(counts, ["run_id", "score"]).filter("n > 0")


def _links(s, d):
    return ch.digest(tb.sequences(s, d), 0, 2).select("peptide", "accession")


def _pairs(s, d):
    return tb.peaks(s, d).select(F.col("spectrum_id").alias("a")).distinct().select("a", (F.col("a") + 1).alias("b"))


QUERIES = {
    "library_similarity": lambda s, d: ta.similarity(_vectors(s, d), ("spectrum_id",)).select("spectrum_id", "n", *_r("rmsd", "angle", "dot", "pearson")),
    "library_manhattan": lambda s, d: ta.manhattan(_vectors(s, d), ("spectrum_id",)).select("spectrum_id", *_r("manhattan", digits=8)),
    "cross_correlation": lambda s, d: ta.cross_correlation(_vectors(s, d), ("spectrum_id",), "peak_id").select("spectrum_id", F.col("lag").cast("long").alias("lag"), *_r("correlation", digits=6)),
    "mutual_information": lambda s, d: ta.mutual_information(_vectors(s, d).withColumn("y", F.floor(F.col("y") / 50)), ("spectrum_id",)).select("spectrum_id", *_r("bits", digits=6)),
    "trace_correlation": lambda s, d: ta.trace_correlation(_traces(s, d), _traces(s, d).select(F.col("target").alias("a")).distinct().select("a", (F.col("a") + 1).alias("b"))).select("a", "b", "run_id", "n", *_r("pearson", digits=6)),
    "assign_windows": lambda s, d: ta.assign_windows(tb.features(s, d).select("feature_id", "mz"), _swath(s, d)).select("feature_id", "window", *_r("mz", "window_low", "window_high")),
    "context_inference_run": lambda s, d: ta.context_inference(tb.hits(s, d), "accession", ("run_id",)).select("run_id", "accession", "decoy", *_r("score", "p_value", "q_value", digits=6)),
    "context_inference_global": lambda s, d: ta.context_inference(tb.hits(s, d), "spectrum_id").select("spectrum_id", "decoy", *_r("score", "p_value", "q_value", digits=6)),
    "binned_coverage": lambda s, d: ta.binned_coverage(tb.features(s, d), "rt", 0.0, 2000.0, 25, 30, ("map_id", "charge")).select("map_id", "charge", "filled", "covered"),
    "chauvenet_outliers": lambda s, d: ta.chauvenet_outliers(tb.features(s, d).withColumn("y", F.col("rt") * 1.1 + F.pow(F.col("mz") / 100, 8) / 1e6), "rt", "y", ("map_id",)).filter("outlier").select("map_id", "feature_id", *_r("residual")),
    "remove_rt_outliers": lambda s, d: ta.remove_outliers(_standards(s, d), "rt", "y", 0.999, key=("map_id",)).select("map_id", "cell", *_r("rt", "y")),
    "add_spectra": lambda s, d: fi.resample(tb.peaks(s, d), 25.0, ("run_id", "ms_level")).select("run_id", "ms_level", F.col("grid").cast("long").alias("grid"), *_r("mz", "intensity", digits=5)),
    "pose_shift": lambda s, d: mp.pose_shift(*_maps(s, d), points=None).select("bucket", *_r("shift", "votes")),
    "stable_pairs": lambda s, d: mp.stable_pairs(*_maps(s, d), 2.0, 100.0).select("a_id", "b_id", *_r("d", "quality")),
    "labelled_pairs": lambda s, d: mp.labelled_pairs(tb.features(s, d)).select("map_id", "charge", "light_id", "heavy_id", *_r("score", digits=6)),
    "evaluate_alignment": lambda s, d: mp.evaluate_alignment(*_truth(s, d)).select(*_r("precision", "recall", digits=6), "groups"),
    "ratio_factors": lambda s, d: mp.ratio_factors(_handles(s, d), 0.5).select("map_id", *_r("factor", digits=6)),
    "spectra_of_features": lambda s, d: mp.spectra_of_features(tb.features(s, d).filter("map_id = 2").select(F.col("feature_id").alias("spectrum_id"), F.col("mz").alias("precursor_mz"), "rt"), tb.features(s, d).filter("map_id = 0"), 0.5, 60.0),
    "interpolate_times": lambda s, d: mp.interpolate_times(tb.features(s, d).select("map_id", "feature_id", "rt"), _anchors(s, d)).select("map_id", "feature_id", *_r("aligned")),
    "digest_lys_c": _digest_sql_rows("Lys-C"),
    "digest_asp_n": _digest_sql_rows("Asp-N"),
    "digest_chymotrypsin": _digest_sql_rows("Chymotrypsin"),
    "digest_glu_c": _digest_sql_rows("glutamyl endopeptidase"),
    "modified_peptides": lambda s, d: pe.modified(_short(s, d), ("Carbamidomethyl",), ("Oxidation", "Deamidated (N)", "Phospho (S)"), 2).select("peptide", "sites", F.col("n_modified").cast("long").alias("n_modified"), *_r("mass")),
    "all_ion_series": lambda s, d: pe.all_ions(_short(s, d), "abcxyz", (1, 2), True).select("peptide", "ion", F.col("position").cast("long").alias("position"), F.col("charge").cast("long").alias("charge"), "loss", *_r("mz")),
    "hydropathy_profile": lambda s, d: tb.sequences(s, d).select("accession", F.posexplode(pe.windowed_profile(F.col("sequence"), 7, ch.HYDROPATHY)).alias("start", "mean")).select("accession", F.col("start").cast("long").alias("start"), (F.round("mean", 6) + 0.0).alias("mean")),
    "hydrophobic_moment": lambda s, d: pe.hydrophobic_moment(tb.sequences(s, d)).select("accession", F.col("start").cast("long").alias("start"), *_r("moment", digits=6)),
    "sequence_tags": lambda s, d: pe.sequence_tags(tb.peaks(s, d), 3, 0.02).groupBy("spectrum_id").agg(F.count("*").alias("n_tags"), F.countDistinct("tag").alias("n_distinct"), F.min("tag").alias("first_tag")),
    "neighbour_peptides": lambda s, d: pe.neighbour_peptides(_short(s, d), _short(s, d), 0.5, 1.0).select("relevant", "peptide", *_r("share")),
    "alignment_score": lambda s, d: _short(s, d).select("peptide", pe.alignment_score(F.col("peptide"), F.reverse(F.col("peptide"))).cast("long").alias("score")),
    "adduct_ions": lambda s, d: pe.adduct_ions(_short(s, d).select("peptide", ch.peptide_mass(F.col("peptide")).alias("mass"))).select("peptide", "adduct", F.col("charge").cast("long").alias("charge"), *_r("mz")),
    "tic_stability": lambda s, d: qu.tic_stability(tb.peaks(s, d), None),
    "relative_tic": lambda s, d: qu.relative_tic(tb.peaks(s, d)).select("run_id", "spectrum_id", *_r("relative")),
    "feature_summary": lambda s, d: qu.feature_summary(tb.features(s, d).withColumn("deviation", F.when(F.col("charge") > 1, F.col("rt") - 1000)), "deviation").select("map_id", "n", *_r("deviation")),
    "identification_summary": lambda s, d: qu.identification_summary(tb.hits(s, d), _peptide_of(s, d)).select("run_id", "n_psms", "n_peptides", "n_proteins", *_r("missed", "length", "score")),
    "identification_rate": lambda s, d: qu.identification_rate(tb.peaks(s, d), tb.hits(s, d)).select("run_id", "n_spectra", "n_identified", *_r("rate")),
    "window_ranks": lambda s, d: qu.window_ranks(tb.peaks(s, d)).select("spectrum_id", "peak_id", F.col("rank").cast("long").alias("rank")),
    "peak_level_score": lambda s, d: _pscore(s, d).select("spectrum_id", "peptide", *_r("score"), F.col("level").cast("long").alias("level")),
    "delta_scores": lambda s, d: qu.delta_scores(tb.hits(s, d)).select("spectrum_id", "hit_id", *_r("score", "delta")),
    "proteins_with_peptides": lambda s, d: qu.proteins_with_peptides(_links(s, d), 1),
    "merge_runs": lambda s, d: qu.merge_runs(tb.hits(s, d)).select("spectrum_id", "accession", *_r("score"), "origin", "n_runs"),
    "indistinguishable_proteins": lambda s, d: qu.indistinguishable_proteins(_links(s, d)),
    "pep_from_q": lambda s, d: qu.pep_from_q(_curve(s, d), ["run_id"]).select("run_id", *_r("score", "pep", digits=6)),
    "entropy_similarity": lambda s, d: qu.entropy_similarity(tb.peaks(s, d), _pairs(s, d)).select("a", "b", *_r("similarity", digits=6)),
    "spectral_entropy": lambda s, d: qu.entropy_of_spectra(tb.peaks(s, d)).select("spectrum_id", *_r("entropy", digits=6)),
    "filter_conditions": lambda s, d: tb.peaks(s, d).filter(rn.build_filter(_CONDITIONS)).select("spectrum_id", "peak_id", *_r("mz", "intensity")),
    "extract_range": lambda s, d: rn.extract_range(tb.peaks(s, d), (20.0, 1500.0), (200.0, 600.5), (1,)).select("spectrum_id", "peak_id", *_r("mz", "intensity")),
    "normalize_map": lambda s, d: rn.normalize_map(tb.peaks(s, d)).select("spectrum_id", "peak_id", *_r("intensity", digits=6)),
    "split_parts": lambda s, d: rn.split_parts(tb.peaks(s, d), 4).select("run_id", "spectrum_id", F.col("part").cast("long").alias("part")),
    "run_info": lambda s, d: rn.run_info(tb.peaks(s, d)).select("run_id", "ms_level", "n_spectra", "n_peaks", *_r("lowest", "q1", "median", "q3", "highest", "mean")),
    "fuzzy_diff": lambda s, d: rn.fuzzy_diff(tb.features(s, d), _shifted(s, d), ("feature_id",), ("mz", "intensity"), 1.001, 0.01).select("feature_id", "column", *_r("a", "b"), "kind"),
    "merge_blocks": lambda s, d: rn.merge_blocks(tb.peaks(s, d), 3, 10.0).select("run_id", "ms_level", "block", "mz_cell", *_r("rt", "intensity"), "n"),
    "calibrate": lambda s, d: rn.calibrate(tb.peaks(s, d), _locks(s, d), 0.5).select("spectrum_id", "peak_id", *_r("mz", digits=6)),
    "correct_precursors": lambda s, d: rn.correct_precursors(_isolated(s, d), tb.peaks(s, d), 2.0).select("precursor_id", *_r("corrected_mz")),
    "correct_precursors_highest": lambda s, d: rn.correct_precursors(_isolated(s, d), tb.peaks(s, d), 2.0, "highest").select("precursor_id", *_r("corrected_mz")),
    "reporter_ions": lambda s, d: rn.reporter_ions(tb.peaks(s, d), CHANNELS, 2.0).select("spectrum_id", "channel", *_r("intensity")),
    "reporter_ions_corrected": lambda s, d: rn.reporter_ions(tb.peaks(s, d), CHANNELS, 2.0, MIXING).select("spectrum_id", "channel", *_r("intensity")),
    "smooth_anchors": lambda s, d: mp.interpolate_times(tb.features(s, d).select("map_id", "feature_id", "rt"), rn.smooth_anchors(_anchors(s, d), 0.3)).select("map_id", "feature_id", *_r("aligned")),
    "group_features": lambda s, d: rn.group_features(tb.features(s, d), 0.05, 200.0).select("group", "map_id", "feature_id", *_r("quality")),
}

_V = "v AS (SELECT spectrum_id, peak_id, CAST(intensity AS DOUBLE) AS x, mz AS y FROM peaks)"
_SHORT = f"q AS (SELECT DISTINCT peptide FROM (SELECT unnest({PARTS}) AS peptide FROM sequences) WHERE length(peptide) BETWEEN 4 AND 40)"
_MASS = f"({count_sql(ch.RESIDUES, 'peptide')} + {ch.WATER!r})"
_LINKS = f"l AS (SELECT DISTINCT accession, peptide FROM (SELECT accession, unnest({PARTS}) AS peptide FROM sequences) WHERE length(peptide) >= 2)"
_TRACES = "t AS (SELECT run_id, CAST(floor(mz / 50.0) AS BIGINT) AS target, rt, SUM(intensity) AS i FROM peaks GROUP BY ALL)"


def _digest_sql(marked: str) -> str:
    return f"""WITH p AS (SELECT accession, list_filter(string_split({marked}, '|'), lambda x: x <> '') AS p FROM sequences), s AS (SELECT accession, p, unnest(range(0, len(p))) AS start FROM p), m AS (SELECT *, unnest([0, 1]) AS missed FROM s)
SELECT * FROM (SELECT accession, array_to_string(list_slice(p, start + 1, start + 1 + missed), '') AS peptide, start, CAST(missed AS BIGINT) AS missed FROM m WHERE start + missed < len(p)) WHERE length(peptide) BETWEEN 2 AND 40"""


def _context_sql(level: str, context: str) -> str:
    part, on = (f"PARTITION BY {context}", f"{context}, ") if context else ("", "")
    return f"""WITH b AS (SELECT {on}{level}, decoy, MAX(score) AS score FROM hits GROUP BY ALL),
e AS (SELECT {on}score, SUM(CASE WHEN decoy THEN 0 ELSE 1 END) AS t, SUM(CASE WHEN decoy THEN 1 ELSE 0 END) AS d FROM b GROUP BY ALL),
c AS (SELECT *, SUM(t) OVER w AS tt, SUM(d) OVER w AS dd, SUM(d) OVER ({part}) AS n FROM e WINDOW w AS ({part} ORDER BY score DESC)),
f AS (SELECT *, least(MIN((dd + 1) / (tt + 1)) OVER ({part} ORDER BY score DESC ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING), 1.0) AS q FROM c)
SELECT {on}{level}, decoy, round(score, 6) AS score, round(CASE WHEN n > 0 THEN greatest(dd, 1) / n ELSE 1.0 END, 6) AS p_value, round(q, 6) AS q_value FROM b JOIN f USING ({on}score)"""


_SERIES = {"a": ("left", "C-1O-1"), "b": ("left", ""), "c": ("left", "N1H3"), "x": ("right", "C1O2"), "y": ("right", "H2O1"), "z": ("right", "H-1N-1O1")}
_IONS = " UNION ALL ".join(f"SELECT peptide, position, '{k}' AS ion, {side}(peptide, position) AS part, {ch.formula_mass(f)!r} AS more FROM o" for k, (side, f) in _SERIES.items())
_ADDUCTS = ", ".join(f"('{k}', {z}, {n}, {ch.formula_mass(f)!r})" for k, (f, z, n) in pe.ADDUCTS.items())
_SCALE = lambda scale: "CASE r " + " ".join(f"WHEN '{k}' THEN {v!r}" for k, v in scale.items()) + " END"
_RESIDUE_ROWS = "r AS (SELECT accession, length(sequence) AS n, unnest(range(0, length(sequence))) AS start, sequence FROM sequences), v AS (SELECT accession, n, start, CAST({} AS DOUBLE) AS v FROM (SELECT *, substr(sequence, start + 1, 1) AS r FROM r))"
_LAGS = [(d, f"COALESCE({'lead' if d >= 0 else 'lag'}(y, {abs(d)}) OVER w, 0)") for d in range(-3, 4)]
_STEPS = ", ".join(f"('{k}', {v!r})" for k, v in ch.RESIDUES.items() if k != "I")

_CHANNELS = ", ".join(f"('{k}', CAST({v!r} AS DOUBLE))" for k, v in CHANNELS.items())
_CHANNELS_AT = ", ".join(f"('{k}', CAST({v!r} AS DOUBLE), {i})" for i, (k, v) in enumerate(CHANNELS.items()))
_INVERSE = ", ".join(f"({i}, {j}, CAST({float(w)!r} AS DOUBLE))" for i, row in enumerate(np.linalg.inv(np.asarray(MIXING))) for j, w in enumerate(row))
_CORRECT = """WITH c AS (SELECT spectrum_id, spectrum_id * 1000 + CAST(floor(mz / 100) AS BIGINT) AS precursor_id, AVG(mz) AS precursor_mz FROM peaks GROUP BY ALL),
b AS (SELECT precursor_id, mz FROM c JOIN peaks USING (spectrum_id) WHERE mz >= precursor_mz - 2.0 AND mz <= precursor_mz + 2.0 QUALIFY row_number() OVER (PARTITION BY precursor_id ORDER BY {}) = 1)
SELECT precursor_id, round(COALESCE(mz, precursor_mz), 4) AS corrected_mz FROM c LEFT JOIN b USING (precursor_id)"""

SQL = {
    "library_similarity": f"""WITH {_V} SELECT spectrum_id, COUNT(*) AS n, round(sqrt(SUM((x - y) * (x - y)) / COUNT(*)), 4) AS rmsd, round(acos(least(1.0, SUM(x * y) / sqrt(SUM(x * x) * SUM(y * y)))), 4) AS angle,
round(least(1.0, SUM(sqrt(greatest(x, 0)) * sqrt(greatest(y, 0))) / sqrt(SUM(greatest(x, 0)) * SUM(greatest(y, 0)))), 4) AS dot, round(corr(x, y), 4) AS pearson FROM v GROUP BY spectrum_id""",
    "library_manhattan": f"WITH {_V}, s AS (SELECT spectrum_id, SUM(x) AS sx, SUM(y) AS sy FROM v GROUP BY 1) SELECT spectrum_id, round(AVG(abs(x / sx - y / sy)), 8) AS manhattan FROM v JOIN s USING (spectrum_id) GROUP BY 1",
    "cross_correlation": f"""WITH {_V}, m AS (SELECT spectrum_id, AVG(x) AS mx, AVG(y) AS my, stddev_pop(x) AS dx, stddev_pop(y) AS dy FROM v GROUP BY 1),
u AS (SELECT spectrum_id, peak_id, (x - mx) / dx AS x, (y - my) / dy AS y FROM v JOIN m USING (spectrum_id)),
p AS (SELECT spectrum_id, {', '.join(f'x * {e} AS p{i}' for i, (_, e) in enumerate(_LAGS))} FROM u WINDOW w AS (PARTITION BY spectrum_id ORDER BY peak_id)),
l AS ({' UNION ALL '.join(f'SELECT spectrum_id, CAST({d} AS BIGINT) AS lag, AVG(p{i}) AS c FROM p GROUP BY 1' for i, (d, _) in enumerate(_LAGS))})
SELECT spectrum_id, lag, round(c, 6) AS correlation FROM l QUALIFY row_number() OVER (PARTITION BY spectrum_id ORDER BY round(c, 12) DESC, lag) = 1""",
    "mutual_information": f"""WITH {_V}, r AS (SELECT spectrum_id, rank() OVER (PARTITION BY spectrum_id ORDER BY x) AS a, rank() OVER (PARTITION BY spectrum_id ORDER BY floor(y / 50)) AS b FROM v),
ab AS (SELECT spectrum_id, a, b, COUNT(*) AS c FROM r GROUP BY ALL), a AS (SELECT spectrum_id, a, COUNT(*) AS ca FROM r GROUP BY ALL), b AS (SELECT spectrum_id, b, COUNT(*) AS cb FROM r GROUP BY ALL)
SELECT spectrum_id, round((SUM(c * ln(c / ca / cb)) / SUM(c) + ln(SUM(c))) / ln(2), 6) AS bits FROM ab JOIN a USING (spectrum_id, a) JOIN b USING (spectrum_id, b) GROUP BY 1""",
    "trace_correlation": f"WITH {_TRACES} SELECT p.target AS a, q.target AS b, p.run_id, COUNT(*) AS n, round(corr(p.i, q.i), 6) AS pearson FROM t p JOIN t q ON q.target = p.target + 1 AND p.run_id = q.run_id AND p.rt = q.rt GROUP BY ALL",
    "assign_windows": """WITH w AS (SELECT n_nationkey AS w, n_nationkey * 40.0 AS low, n_nationkey * 40.0 + 50.0 AS high FROM nation)
SELECT feature_id, w AS "window", round(mz, 4) AS mz, CAST(low AS DOUBLE) AS window_low, CAST(high AS DOUBLE) AS window_high FROM features JOIN w ON mz >= low AND mz < high
QUALIFY row_number() OVER (PARTITION BY feature_id ORDER BY abs(mz - (low + high) / 2), w) = 1""",
    "context_inference_run": _context_sql("accession", "run_id"),
    "context_inference_global": _context_sql("spectrum_id", ""),
    "binned_coverage": """WITH c AS (SELECT map_id, charge, least(CAST(floor(rt / 2000.0 * 25) AS BIGINT), 24) AS b, COUNT(*) AS n FROM features WHERE rt BETWEEN 0 AND 2000 GROUP BY ALL)
SELECT map_id, charge, CAST(SUM(CASE WHEN n >= 30 THEN 1 ELSE 0 END) AS BIGINT) AS filled, SUM(CASE WHEN n >= 30 THEN 1 ELSE 0 END) = 25 AS covered FROM c GROUP BY ALL""",
    "add_spectra": """WITH lim AS (SELECT run_id, ms_level, MIN(mz) AS lo, MAX(mz) AS hi FROM peaks GROUP BY ALL),
x AS (SELECT run_id, ms_level, (mz - lo) / 25.0 AS x, intensity FROM peaks JOIN lim USING (run_id, ms_level)),
v AS (SELECT run_id, ms_level, CAST(floor(x) AS BIGINT) AS grid, intensity * (1 - (x - floor(x))) AS v FROM x UNION ALL SELECT run_id, ms_level, CAST(floor(x) AS BIGINT) + 1, intensity * (x - floor(x)) FROM x),
g AS (SELECT run_id, ms_level, lo, unnest(range(0, CAST(ceil((hi - lo) / 25.0) AS BIGINT) + 1)) AS grid FROM lim)
SELECT run_id, ms_level, grid, round(any_value(lo) + grid * 25.0, 5) AS mz, round(COALESCE(SUM(v), 0.0), 5) AS intensity FROM g LEFT JOIN v USING (run_id, ms_level, grid) GROUP BY run_id, ms_level, grid""",
    "pose_shift": """WITH p AS (SELECT m.rt - s.rt AS d, least(m.intensity, s.intensity) / greatest(m.intensity, s.intensity) AS v FROM features m JOIN features s ON m.map_id = 0 AND s.map_id = 1 AND s.mz >= m.mz - 0.5 AND s.mz <= m.mz + 0.5 WHERE abs(m.rt - s.rt) <= 1000)
SELECT CAST(floor(d / 3.0) AS BIGINT) AS bucket, round(SUM(v * d) / SUM(v), 4) AS shift, round(SUM(v), 4) AS votes FROM p GROUP BY 1""",
    "stable_pairs": """WITH n AS (SELECT a.feature_id AS a_id, b.feature_id AS b_id, (abs(a.mz - b.mz) / 2.0 + abs(a.rt - b.rt) / 100.0) / 2 AS d FROM features a JOIN features b
ON a.map_id = 0 AND b.map_id = 1 AND a.charge = b.charge AND abs(a.rt - b.rt) <= 100.0 AND a.mz >= b.mz - 2.0 AND a.mz <= b.mz + 2.0),
r AS (SELECT *, row_number() OVER wa AS ra, lead(d) OVER wa AS da, row_number() OVER wb AS rb, lead(d) OVER wb AS db FROM n WINDOW wa AS (PARTITION BY a_id ORDER BY d, b_id), wb AS (PARTITION BY b_id ORDER BY d, a_id)),
o AS (SELECT a_id, b_id, d, COALESCE(da, 1.0) AS da, COALESCE(db, 1.0) AS db FROM r WHERE ra = 1 AND rb = 1)
SELECT a_id, b_id, round(d, 4) AS d, round((1 - d) * (1 - 2.0 * d / da) * (1 - 2.0 * d / db), 4) AS quality FROM o WHERE 2.0 * d <= da AND 2.0 * d <= db""",
    "labelled_pairs": """WITH n AS (SELECT l.map_id, l.charge, l.feature_id AS light_id, h.feature_id AS heavy_id, h.mz - (l.mz + 4.0 / l.charge) AS dm, h.rt - l.rt - (-20.0) AS dr FROM features l JOIN features h
ON l.map_id = h.map_id AND l.charge = h.charge AND l.feature_id <> h.feature_id AND l.mz + 4.0 / l.charge >= h.mz - 0.05 AND l.mz + 4.0 / l.charge <= h.mz + 0.05 WHERE h.rt - l.rt - (-20.0) BETWEEN -15.0 AND 15.0),
s AS (SELECT *, exp(-dm * dm / (2 * pow(0.025, 2)) - dr * dr / (2 * 7.5 * 7.5)) AS score FROM n)
SELECT map_id, charge, light_id, heavy_id, round(score, 6) AS score FROM s QUALIFY row_number() OVER (PARTITION BY map_id, light_id ORDER BY score DESC, heavy_id) = 1 AND row_number() OVER (PARTITION BY map_id, heavy_id ORDER BY score DESC, light_id) = 1""",
    "evaluate_alignment": """WITH t0 AS (SELECT feature_id // 3 AS t, feature_id FROM features), t AS (SELECT *, COUNT(*) OVER (PARTITION BY t) AS nt FROM t0 QUALIFY nt >= 2),
u0 AS (SELECT (feature_id + (feature_id // 10) % 2) // 3 AS u, feature_id FROM features), u AS (SELECT *, COUNT(*) OVER (PARTITION BY u) AS nu FROM u0 QUALIFY nu >= 2),
s AS (SELECT t, nt, u, nu, COUNT(*) AS s FROM t JOIN u USING (feature_id) GROUP BY ALL), g AS (SELECT t, nt, SUM(s) AS s, SUM(nu) AS n, COUNT(*) AS m FROM s GROUP BY ALL), c AS (SELECT COUNT(DISTINCT t) AS groups FROM t)
SELECT round(SUM(s / n) / any_value(groups), 6) AS precision, round(SUM(s / (m * nt)) / any_value(groups), 6) AS recall, any_value(groups) AS groups FROM g, c""",
    "ratio_factors": """WITH h AS (SELECT feature_id // 4 AS g, map_id, SUM(intensity) AS i FROM features GROUP BY ALL), ref AS (SELECT map_id FROM h GROUP BY 1 ORDER BY COUNT(*) DESC, map_id LIMIT 1),
r AS (SELECT h.map_id, z.i / h.i AS q FROM h JOIN (SELECT h.g, h.i FROM h JOIN ref USING (map_id)) z ON h.g = z.g WHERE z.i / h.i > 0.5 AND z.i / h.i < 1 / 0.5)
SELECT map_id, round(COALESCE(AVG(q), 1.0), 6) AS factor FROM (SELECT DISTINCT map_id FROM h) LEFT JOIN r USING (map_id) GROUP BY 1""",
    "spectra_of_features": """SELECT a.feature_id AS spectrum_id, b.feature_id FROM features a JOIN features b ON a.map_id = 2 AND b.map_id = 0 AND a.mz >= b.mz - 0.5 AND a.mz <= b.mz + 0.5 AND abs(a.rt - b.rt) <= 60
QUALIFY row_number() OVER (PARTITION BY a.feature_id ORDER BY abs(a.mz - b.mz), abs(a.rt - b.rt), b.feature_id) = 1""",
    "interpolate_times": """WITH a AS (SELECT map_id, x, AVG(y) AS y FROM (SELECT map_id, AVG(rt) AS x, AVG(rt * CAST(1.05 AS DOUBLE) + charge) AS y FROM features GROUP BY map_id, floor(rt / 40)) GROUP BY ALL),
l AS (SELECT f.map_id, feature_id, rt, a.x AS x0, a.y AS y0 FROM features f ASOF LEFT JOIN a ON f.map_id = a.map_id AND f.rt >= a.x),
p AS (SELECT l.*, a.x AS x1, a.y AS y1 FROM l ASOF LEFT JOIN a ON l.map_id = a.map_id AND l.rt < a.x)
SELECT map_id, feature_id, round(CASE WHEN x0 IS NOT NULL AND x1 IS NOT NULL THEN y0 + (rt - x0) / (x1 - x0) * (y1 - y0) ELSE rt + COALESCE(y0 - x0, y1 - x1, 0.0) END, 4) AS aligned FROM p""",
    "digest_lys_c": _digest_sql("replace(replace(sequence, 'K', 'K|'), '|P', 'P')"),
    "digest_asp_n": _digest_sql("replace(sequence, 'D', '|D')"),
    "digest_chymotrypsin": _digest_sql("replace(regexp_replace(sequence, '([FYWL])', '\\1|', 'g'), '|P', 'P')"),
    "digest_glu_c": _digest_sql("regexp_replace(sequence, '([DE])', '\\1|', 'g')"),
    "modified_peptides": f"""WITH {_SHORT}, f AS (SELECT peptide, {_MASS} + (length(peptide) - length(replace(peptide, 'C', ''))) * 57.021464 AS mass FROM q),
s AS (SELECT peptide, pos, CASE substr(peptide, pos, 1) WHEN 'M' THEN 'Oxidation' WHEN 'N' THEN 'Deamidated (N)' WHEN 'S' THEN 'Phospho (S)' END AS name, CASE substr(peptide, pos, 1) WHEN 'M' THEN 15.994915 WHEN 'N' THEN 0.984016 ELSE 79.966331 END AS m
  FROM (SELECT peptide, unnest(range(1, length(peptide) + 1)) AS pos FROM q) WHERE substr(peptide, pos, 1) IN ('M', 'N', 'S')),
w AS (SELECT peptide, '' AS sites, 0 AS n, 0.0 AS m FROM q UNION ALL SELECT peptide, pos || ':' || name, 1, m FROM s UNION ALL SELECT a.peptide, a.pos || ':' || a.name || ',' || b.pos || ':' || b.name, 2, a.m + b.m FROM s a JOIN s b ON a.peptide = b.peptide AND a.pos < b.pos)
SELECT peptide, sites, CAST(n AS BIGINT) AS n_modified, round(mass + m, 4) AS mass FROM w JOIN f USING (peptide)""",
    "all_ion_series": f"""WITH {_SHORT}, o AS (SELECT peptide, unnest(range(1, length(peptide))) AS position FROM q), i AS ({_IONS}), m AS (SELECT *, {count_sql(ch.RESIDUES, 'part')} + more AS m FROM i),
l AS (SELECT *, '' AS loss, 0.0 AS less FROM m UNION ALL SELECT *, 'H2O', {ch.formula_mass('H2O1')!r} FROM m WHERE regexp_matches(part, '[STED]') UNION ALL SELECT *, 'NH3', {ch.formula_mass('N1H3')!r} FROM m WHERE regexp_matches(part, '[RKNQ]'))
SELECT peptide, ion, position, charge, loss, round((m - less) / charge + {ch.PROTON!r}, 4) AS mz FROM (SELECT *, CAST(unnest([1, 2]) AS BIGINT) AS charge FROM l)""",
    "hydropathy_profile": f"""WITH {_RESIDUE_ROWS.format(_SCALE(ch.HYDROPATHY))}, w AS (SELECT accession, n, start, AVG(v) OVER (PARTITION BY accession ORDER BY start ROWS BETWEEN CURRENT ROW AND 6 FOLLOWING) AS mean FROM v)
SELECT accession, start, round(mean, 6) + 0.0 AS mean FROM w WHERE start <= n - least(7, n)""",
    "hydrophobic_moment": f"""WITH {_RESIDUE_ROWS.format(_SCALE(pe.EISENBERG))}, w AS (SELECT accession, n, start, SUM(v * sin(radians(100.0) * start)) OVER f AS s, SUM(v * cos(radians(100.0) * start)) OVER f AS c FROM v WINDOW f AS (PARTITION BY accession ORDER BY start ROWS BETWEEN CURRENT ROW AND 10 FOLLOWING))
SELECT accession, start, round(sqrt(s * s + c * c) / least(11, n), 6) AS moment FROM w WHERE start <= n - least(11, n)""",
    "sequence_tags": f"""WITH r(r, m) AS (VALUES {_STEPS}), g AS (SELECT a.spectrum_id, a.peak_id AS a, a.mz AS amz, r, b.peak_id AS b FROM peaks a, r, peaks b WHERE a.spectrum_id = b.spectrum_id AND b.mz >= a.mz + m - 0.02 AND b.mz <= a.mz + m + 0.02),
t AS (SELECT DISTINCT x.spectrum_id, x.r || y.r || z.r AS tag, x.amz FROM g x JOIN g y ON x.spectrum_id = y.spectrum_id AND x.b = y.a JOIN g z ON y.spectrum_id = z.spectrum_id AND y.b = z.a)
SELECT spectrum_id, COUNT(*) AS n_tags, COUNT(DISTINCT tag) AS n_distinct, MIN(tag) AS first_tag FROM t GROUP BY 1""",
    "neighbour_peptides": f"""WITH {_SHORT}, m AS (SELECT peptide, {_MASS} AS mass FROM q), c AS (SELECT a.peptide AS relevant, b.peptide FROM m a JOIN m b ON b.mass >= a.mass - 0.5 AND b.mass <= a.mass + 0.5 AND a.peptide <> b.peptide),
o AS (SELECT peptide, unnest(range(1, length(peptide))) AS position FROM q),
n AS (SELECT DISTINCT peptide, floor({count_sql(ch.RESIDUES, 'left(peptide, position)')} + {ch.PROTON!r}) AS bin FROM o UNION SELECT peptide, floor({count_sql(ch.RESIDUES, 'right(peptide, position)')} + {ch.WATER!r} + {ch.PROTON!r}) FROM o),
k AS (SELECT peptide, COUNT(*) AS n FROM n GROUP BY 1), s AS (SELECT relevant, c.peptide, COUNT(*) AS s FROM c JOIN n a ON a.peptide = relevant JOIN n b ON b.peptide = c.peptide AND a.bin = b.bin GROUP BY ALL)
SELECT relevant, s.peptide, round(2 * s / (x.n + y.n), 4) AS share FROM s JOIN k x ON x.peptide = relevant JOIN k y ON y.peptide = s.peptide WHERE 2 * s / (x.n + y.n) >= 0.25""",
    "adduct_ions": f"WITH {_SHORT}, a(adduct, z, n, m) AS (VALUES {_ADDUCTS}) SELECT peptide, adduct, CAST(z AS BIGINT) AS charge, round((n * {_MASS} + m - z * CAST({pe.ELECTRON!r} AS DOUBLE)) / abs(z), 4) AS mz FROM q, a",
    "tic_stability": """WITH t AS (SELECT run_id, spectrum_id, rt, CAST(floor(greatest(SUM(intensity), 0)) AS BIGINT) AS tic FROM peaks GROUP BY ALL), b AS (SELECT *, lag(tic) OVER (PARTITION BY run_id ORDER BY rt, spectrum_id) AS b FROM t)
SELECT run_id, COUNT(*) AS n, CAST(SUM(tic) AS BIGINT) AS area, CAST(COUNT(*) FILTER (tic < b // 10) AS BIGINT) AS falls, CAST(COUNT(*) FILTER (tic > b * 10) AS BIGINT) AS jumps FROM b GROUP BY 1""",
    "relative_tic": "WITH t AS (SELECT run_id, spectrum_id, SUM(intensity) AS t FROM peaks GROUP BY ALL) SELECT run_id, spectrum_id, round(100 * t / MAX(t) OVER (PARTITION BY run_id), 4) AS relative FROM t",
    "feature_summary": "SELECT map_id, COUNT(*) AS n, round(COALESCE(AVG(CASE WHEN charge > 1 THEN rt - 1000 END), 0.0), 4) AS deviation FROM features GROUP BY 1",
    "identification_summary": f"""WITH s AS (SELECT 'P' || CAST(accession % 61 AS VARCHAR) AS accession, sequence FROM sequences), p AS (SELECT accession, MIN(sequence) AS peptide FROM s GROUP BY 1),
o AS (SELECT * FROM hits QUALIFY row_number() OVER (PARTITION BY run_id, spectrum_id ORDER BY score DESC, hit_id) = 1), f AS (SELECT run_id, peptide, (SELECT len({PARTS}) - 1 FROM (SELECT peptide AS sequence)) AS m FROM o JOIN p USING (accession)),
e AS (SELECT run_id, COUNT(DISTINCT peptide) AS n_peptides, AVG(m) AS missed FROM f GROUP BY 1), l AS (SELECT run_id, AVG(length(peptide)) AS length FROM (SELECT DISTINCT run_id, peptide FROM f) GROUP BY 1),
r AS (SELECT run_id, COUNT(DISTINCT spectrum_id) AS n_psms, COUNT(DISTINCT accession) AS n_proteins, AVG(score) AS score FROM hits GROUP BY 1)
SELECT run_id, n_psms, COALESCE(n_peptides, 0) AS n_peptides, n_proteins, round(missed, 4) AS missed, round(length, 4) AS length, round(score, 4) AS score FROM r LEFT JOIN e USING (run_id) LEFT JOIN l USING (run_id)""",
    "identification_rate": """WITH s AS (SELECT DISTINCT run_id, spectrum_id FROM peaks WHERE ms_level = 2), t AS (SELECT DISTINCT spectrum_id, 1 AS h FROM hits WHERE NOT decoy)
SELECT run_id, COUNT(*) AS n_spectra, COUNT(h) AS n_identified, round(COUNT(h) / COUNT(*), 4) AS rate FROM s LEFT JOIN t USING (spectrum_id) GROUP BY 1""",
    "window_ranks": "SELECT a.spectrum_id, a.peak_id, COUNT(b.peak_id) AS rank FROM peaks a LEFT JOIN peaks b ON a.spectrum_id = b.spectrum_id AND b.mz >= a.mz - 50.0 AND b.mz <= a.mz + 50.0 AND b.intensity > a.intensity GROUP BY a.spectrum_id, a.peak_id",
    "peak_level_score": _PSM.replace("i.*, intensity,", "i.*, peak_id, intensity,").replace("intensity DESC) = 1", "intensity DESC, peak_id) = 1") + """,
k AS (SELECT a.spectrum_id, a.peak_id, COUNT(b.peak_id) AS rank FROM peaks a LEFT JOIN peaks b ON a.spectrum_id = b.spectrum_id AND b.mz >= a.mz - 50.0 AND b.mz <= a.mz + 50.0 AND b.intensity > a.intensity GROUP BY ALL),
l AS (SELECT unnest([1, 2, 3, 4, 5, 6, 7, 8, 9]) AS level), c AS (SELECT spectrum_id, peptide, level, 2 * (length(peptide) - 1) AS total, (level + 1) * 2 * 0.5 / 100.0 AS p, COUNT(*) FILTER (rank <= level) AS n FROM m JOIN k USING (spectrum_id, peak_id), l GROUP BY ALL),
s AS (SELECT spectrum_id, peptide, level, CASE WHEN n > 0 THEN -10 * log10(least(1.0, list_sum(list_transform(range(n, total + 1), lambda j: exp(lgamma(total + 1) - lgamma(j + 1) - lgamma(total - j + 1) + j * ln(p) + (total - j) * ln(1 - p)))))) ELSE 0.0 END AS score FROM c)
SELECT spectrum_id, peptide, round(score, 4) AS score, CAST(level AS BIGINT) AS level FROM s QUALIFY row_number() OVER (PARTITION BY spectrum_id, peptide ORDER BY round(score, 9) DESC, level) = 1""",
    "delta_scores": """SELECT spectrum_id, hit_id, round(score, 4) AS score, round((score - s) / NULLIF(score, 0), 4) AS delta FROM (SELECT *, lead(score) OVER w AS s, row_number() OVER w AS r FROM hits WINDOW w AS (PARTITION BY spectrum_id ORDER BY score DESC, hit_id)) WHERE r = 1""",
    "proteins_with_peptides": f"WITH {_LINKS}, u AS (SELECT peptide, MIN(accession) AS accession FROM l GROUP BY 1 HAVING COUNT(*) = 1) SELECT accession, COUNT(*) AS n FROM u GROUP BY 1",
    "merge_runs": """WITH n AS (SELECT spectrum_id, accession, COUNT(DISTINCT run_id) AS n_runs FROM hits GROUP BY ALL), b AS (SELECT * FROM hits QUALIFY row_number() OVER (PARTITION BY spectrum_id, accession ORDER BY score DESC, run_id) = 1)
SELECT spectrum_id, accession, round(score, 4) AS score, run_id AS origin, n_runs FROM b JOIN n USING (spectrum_id, accession)""",
    "indistinguishable_proteins": f"WITH {_LINKS}, s AS (SELECT accession, string_agg(peptide, ',' ORDER BY peptide) AS s, COUNT(*) AS n_peptides FROM l GROUP BY 1) SELECT accession, MIN(accession) OVER (PARTITION BY s) AS \"group\", n_peptides FROM s",
    "pep_from_q": """WITH e AS (SELECT run_id, score, SUM(CASE WHEN decoy THEN 0 ELSE 1 END) AS t, SUM(CASE WHEN decoy THEN 1 ELSE 0 END) AS d FROM hits GROUP BY ALL),
c AS (SELECT *, SUM(t) OVER w AS tt, SUM(d) OVER w AS dd FROM e WINDOW w AS (PARTITION BY run_id ORDER BY score DESC)),
q AS (SELECT *, least(MIN((dd + 1) / (tt + 1)) OVER (PARTITION BY run_id ORDER BY score DESC ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING), 1.0) AS q FROM c), n AS (SELECT run_id, score, t, q * tt AS e FROM q WHERE t > 0),
r AS (SELECT run_id, score, greatest(0.0, least(1.0, (e - COALESCE(lag(e) OVER (PARTITION BY run_id ORDER BY score DESC), 0.0)) / t)) AS p FROM n)
SELECT run_id, round(score, 6) AS score, round(MAX(p) OVER (PARTITION BY run_id ORDER BY score DESC ROWS UNBOUNDED PRECEDING), 6) AS pep FROM r""",
    "entropy_similarity": """WITH v AS (SELECT spectrum_id, floor(mz / 10.0) AS bin, SUM(greatest(intensity, 0.0)) AS x FROM peaks GROUP BY ALL), p AS (SELECT spectrum_id, bin, x / SUM(x) OVER (PARTITION BY spectrum_id) AS p FROM v WHERE x > 0),
i AS (SELECT DISTINCT spectrum_id AS a FROM p), k AS (SELECT a.a, b.a AS b FROM i a JOIN i b ON b.a = a.a + 1),
s AS (SELECT k.a, k.b, COALESCE(x.bin, y.bin) AS bin, COALESCE(x.p, 0) AS pa, COALESCE(y.p, 0) AS pb FROM (SELECT k.*, p.bin, p.p FROM k JOIN p ON p.spectrum_id = k.a) x FULL JOIN (SELECT k.*, p.bin, p.p FROM k JOIN p ON p.spectrum_id = k.b) y ON x.a = y.a AND x.bin = y.bin JOIN k ON k.a = COALESCE(x.a, y.a))
SELECT a, b, round(1 - SUM(CASE WHEN pa > 0 THEN pa / 2 * log2(2 * pa / (pa + pb)) ELSE 0 END + CASE WHEN pb > 0 THEN pb / 2 * log2(2 * pb / (pa + pb)) ELSE 0 END), 6) AS similarity FROM s GROUP BY ALL""",
    "spectral_entropy": "WITH p AS (SELECT spectrum_id, intensity / SUM(intensity) OVER (PARTITION BY spectrum_id) AS p FROM peaks WHERE intensity > 0) SELECT spectrum_id, round(-SUM(p * ln(p)), 6) AS entropy FROM p GROUP BY 1",
    "filter_conditions": "SELECT spectrum_id, peak_id, round(mz, 4) AS mz, round(intensity, 4) AS intensity FROM peaks WHERE ((mz >= 300.0 AND ms_level = 2) OR intensity > 4500.0) AND run_id <> 3",
    "extract_range": "SELECT spectrum_id, peak_id, round(mz, 4) AS mz, round(intensity, 4) AS intensity FROM peaks WHERE rt BETWEEN 20 AND 1500 AND mz BETWEEN 200.0 AND 600.5 AND ms_level IN (1)",
    "normalize_map": "SELECT spectrum_id, peak_id, round(CASE WHEN ms_level = 1 AND MAX(CASE WHEN ms_level = 1 THEN intensity END) OVER w > 0 THEN intensity / MAX(CASE WHEN ms_level = 1 THEN intensity END) OVER w * 100 ELSE intensity END, 6) AS intensity FROM peaks WINDOW w AS (PARTITION BY run_id)",
    "split_parts": "SELECT run_id, spectrum_id, ntile(4) OVER (PARTITION BY run_id ORDER BY rt, spectrum_id) AS part FROM (SELECT DISTINCT run_id, spectrum_id, rt FROM peaks)",
    "run_info": """SELECT run_id, ms_level, COUNT(DISTINCT spectrum_id) AS n_spectra, COUNT(*) AS n_peaks, round(MIN(intensity), 4) AS lowest, round(quantile_cont(intensity, 0.25), 4) AS q1, round(quantile_cont(intensity, 0.5), 4) AS median,
round(quantile_cont(intensity, 0.75), 4) AS q3, round(MAX(intensity), 4) AS highest, round(AVG(intensity), 4) AS mean FROM peaks GROUP BY ALL""",
    "fuzzy_diff": """WITH b AS (SELECT feature_id + CASE WHEN feature_id % 101 = 0 THEN 1099511627776 ELSE 0 END AS k, CASE WHEN feature_id % 7 = 0 THEN mz * CAST(1.01 AS DOUBLE) WHEN feature_id % 11 = 0 THEN mz + CAST(0.005 AS DOUBLE) ELSE mz END AS mz, intensity FROM features),
j AS (SELECT COALESCE(f.feature_id, b.k) AS feature_id, f.feature_id AS ka, b.k AS kb, f.mz AS ma, b.mz AS mb, f.intensity AS ia, b.intensity AS ib FROM features f FULL JOIN b ON f.feature_id = b.k),
r AS (SELECT feature_id, ka, kb, 'mz' AS "column", ma AS a, mb AS b FROM j UNION ALL SELECT feature_id, ka, kb, 'intensity', ia, ib FROM j),
d AS (SELECT *, CASE WHEN kb IS NULL THEN 'missing' WHEN ka IS NULL THEN 'extra' WHEN NOT (abs(a - b) <= 0.01 OR (a * b > 0 AND greatest(abs(a), abs(b)) <= least(abs(a), abs(b)) * CAST(1.001 AS DOUBLE))) THEN 'differs' END AS kind FROM r)
SELECT feature_id, "column", round(a, 4) AS a, round(b, 4) AS b, kind FROM d WHERE kind IS NOT NULL""",
    "merge_blocks": """WITH s AS (SELECT *, (row_number() OVER (PARTITION BY run_id, ms_level ORDER BY rt, spectrum_id) - 1) // 3 AS "block" FROM (SELECT DISTINCT run_id, ms_level, spectrum_id, rt FROM peaks)),
t AS (SELECT *, AVG(rt) OVER (PARTITION BY run_id, ms_level, "block") AS brt FROM s)
SELECT run_id, ms_level, "block", CAST(floor(mz / 10.0) AS BIGINT) AS mz_cell, round(any_value(brt), 4) AS rt, round(SUM(intensity), 4) AS intensity, COUNT(*) AS n FROM peaks JOIN t USING (run_id, ms_level, spectrum_id) GROUP BY ALL""",
    "calibrate": """WITH l AS (SELECT n_nationkey * 35.0 + 120.0 AS lock_mz FROM nation), b AS (SELECT spectrum_id, lock_mz, mz FROM peaks JOIN l ON mz >= lock_mz - 0.5 AND mz <= lock_mz + 0.5 QUALIFY row_number() OVER (PARTITION BY spectrum_id, lock_mz ORDER BY intensity DESC, mz) = 1),
e AS (SELECT spectrum_id, AVG((mz - lock_mz) / lock_mz) AS e FROM b GROUP BY 1) SELECT spectrum_id, peak_id, round(mz / (1 + COALESCE(e, 0.0)), 6) AS mz FROM peaks LEFT JOIN e USING (spectrum_id)""",
    "correct_precursors": _CORRECT.format("abs(mz - precursor_mz), mz"),
    "correct_precursors_highest": _CORRECT.format("intensity DESC, mz"),
    "reporter_ions": f"WITH c(channel, c) AS (VALUES {_CHANNELS}) SELECT s.spectrum_id, channel, round(CAST(COALESCE(MAX(intensity), 0) AS DOUBLE), 4) AS intensity FROM (SELECT DISTINCT spectrum_id FROM peaks) s CROSS JOIN c LEFT JOIN peaks p ON p.spectrum_id = s.spectrum_id AND mz BETWEEN c - 2.0 AND c + 2.0 GROUP BY ALL",
    "reporter_ions_corrected": f"""WITH c(channel, c, i) AS (VALUES {_CHANNELS_AT}), w(i, j, w) AS (VALUES {_INVERSE}),
m AS (SELECT s.spectrum_id, channel, i, COALESCE(MAX(intensity), 0) AS v FROM (SELECT DISTINCT spectrum_id FROM peaks) s CROSS JOIN c LEFT JOIN peaks p ON p.spectrum_id = s.spectrum_id AND mz BETWEEN c - 2.0 AND c + 2.0 GROUP BY ALL)
SELECT a.spectrum_id, a.channel, round(greatest(0.0, SUM(w * b.v)), 4) AS intensity FROM m a JOIN w ON a.i = w.i JOIN m b ON b.spectrum_id = a.spectrum_id AND b.i = w.j GROUP BY ALL""",
}
SQL = {k: tb.sql(v) for k, v in SQL.items()}
