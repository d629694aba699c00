"""Queries of clustering, multiple testing, consensus, peptide places, names of spectra, and of files written and read back, with their SQL."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from ..functions import chemistry as ch
from ..functions import peptides as pe
from ..operators import assays as ay
from ..operators import assembly as am
from ..operators import clustering as cl
from ..operators import indexing as ix
from ..operators import scoring as sc
from ..operators import testing as te
from ..sources import formats as fm
from ..sources import identification_files as idf
from ..sources import tables as tb
from ..sources.scratch import new_path
from .more import _PSM, _psms as _matched
from .sqltext import PARTS, count_sql


#: Sums of values with four digits can end in a 5 right after the last digit shown, where the order of summing decides; this does instead.
_UP = 1e-6


def _r(*names, digits=4):
    return [F.round(n, digits).alias(n) for n in names]


def _tests(s, d):
    return tb.hits(s, d).select("hit_id", "run_id", (1 / (1 + F.col("score"))).alias("p"))


def _points(s, d):
    return tb.features(s, d).select(F.col("feature_id").alias("id"), F.col("mz").alias("x"), F.col("rt").alias("y"))


def _precursors(s, d):
    return tb.peaks(s, d).groupBy("spectrum_id").agg(F.max("mz").alias("precursor_mz"))


def _spectra(s, d):
    one = tb.peaks(s, d).groupBy("run_id", "spectrum_id", "ms_level", "rt").agg(F.sort_array(F.collect_list(F.struct("mz", F.col("intensity").cast("float").alias("intensity")))).alias("peaks"))
    return one.select("run_id", F.concat(F.lit("scan="), F.col("spectrum_id").cast("string")).alias("native_id"), F.col("ms_level").cast("int").alias("ms_level"), "rt", F.lit(True).alias("centroid"), F.lit(1).alias("polarity"), (F.col("rt") + 100.5).alias("precursor_mz"), (F.col("run_id") % 3 + 1).cast("int").alias("charge"), "peaks")


def _figures(spectra, scan):
    mz, i = F.transform("peaks", lambda p: p["mz"]), F.transform("peaks", lambda p: p["intensity"].cast("double"))
    add = lambda c: F.aggregate(c, F.lit(0.0), lambda a, x: a + x)
    return spectra.select(scan.alias("spectrum_id"), F.size("peaks").cast("long").alias("n"), F.round(add(mz) + _UP, 3).alias("mz_sum"), F.round(add(i), 3).alias("intensity_sum"), F.array_max(mz).alias("mz_high"), "rt", "precursor_mz", F.col("charge").cast("long").alias("charge"))


def _mgf(s, d):
    path = new_path(s, "mgf")
    fm.write_mgf(_spectra(s, d).withColumnRenamed("native_id", "title"), path)
    return _figures(fm.read_mgf(s, path), idf.scan_number(F.col("title")))


def _mzml(mz_as=None, intensity_as=None):
    def run(s, d):
        path = new_path(s, "mzml")
        fm.write_mzml(_spectra(s, d), path, mz_as=mz_as, intensity_as=intensity_as)
        return _figures(fm.read_mzml(s, path + "/*/*.txt"), idf.scan_number(F.col("native_id")))

    return run


def _fasta(s, d):
    path = new_path(s, "fasta")
    fm.write_fasta(tb.sequences(s, d).select(F.concat(F.lit("P"), F.col("accession").cast("string")).alias("accession"), F.lit("a protein").alias("description"), "sequence").filter("sequence <> ''"), path)
    return fm.read_fasta(s, path).select("accession", "description", "sequence")


def _dta2d(s, d):
    path = new_path(s, "dta2d")
    fm.write_peak_table(tb.peaks(s, d), path)
    return fm.read_peak_table(s, path).groupBy("rt").agg(F.count("*").alias("n"), F.round(F.sum("mz") + _UP, 3).alias("mz_sum"), F.round(F.sum(F.col("intensity").cast("double")), 3).alias("intensity_sum"))


def _psms(s, d):
    return tb.hits(s, d).select((F.col("hit_id") * 0.5).alias("mz"), (F.col("spectrum_id") * 1.25).alias("rt"), F.concat(F.lit("PEP<"), "accession", F.lit('>"K&R"')).alias("sequence"), F.round("score", 4).alias("score"), "charge", F.array("accession", F.lit("Q1")).alias("proteins"))


def _id_xml(s, d):
    path = new_path(s, "idxml")
    idf.write_id_xml(_psms(s, d), path)
    return fm.read_id_xml(s, path).select("mz", "rt", F.inline("hits")).select("mz", "rt", "sequence", "score", F.col("charge").cast("long").alias("charge"), F.size("proteins").cast("long").alias("n_proteins"))


def _mztab(s, d):
    path = new_path(s, "mztab")
    idf.write_mztab_psms(tb.hits(s, d).select(F.col("hit_id").alias("PSM_ID"), "accession", F.when(~F.col("decoy"), F.round("score", 4)).alias("search_engine_score[1]"), "charge"), path)
    t = idf.read_mztab(s, path)
    return t.select(F.col("PSM_ID").cast("long").alias("psm"), "accession", F.col("`search_engine_score[1]`").cast("double").alias("score"), F.col("charge").cast("long").alias("charge"))


def _transitions(s, d):
    path = new_path(s, "transitions")
    ions = ch.fragment_ions(ch.digest(tb.sequences(s, d), 0, 4, 40).select("peptide").distinct())
    t = ions.select(ch.peptide_mass(F.col("peptide")).alias("precursor_mz"), F.col("mz").alias("product_mz"), F.col("position").cast("double").alias("intensity"), F.length("peptide").cast("double").alias("rt"), "peptide", F.lit(1).alias("charge"), F.col("peptide").alias("group"), F.concat("peptide", F.lit("_"), "ion", F.col("position").cast("string")).alias("name"), (F.col("ion") == "b").alias("decoy"))
    idf.write_transition_table(t, path)
    return idf.read_transition_table(s, path).groupBy("peptide").agg(F.count("*").alias("n"), F.round(F.sum("product_mz"), 3).alias("product_sum"), F.sum(F.col("decoy").cast("long")).alias("n_decoys"), F.round(F.max("rt"), 3).alias("rt"))


def _mzqc(s, d):
    path = new_path(s, "mzqc")
    m = tb.peaks(s, d).groupBy("run_id").agg(F.count("*").cast("double").alias("MS:4000059"), F.sum("intensity").alias("MS:4000029"))
    m = m.select(F.col("run_id").alias("run"), F.inline(F.array(*[F.struct(F.lit(k).alias("accession"), F.lit("a metric").alias("name"), F.col(f"`{k}`").alias("value")) for k in ("MS:4000059", "MS:4000029")])))
    idf.write_mzqc(m, path)
    return idf.read_mzqc(s, path + "/*").select(F.col("run").cast("long").alias("run"), "accession", F.round(F.col("value").cast("double"), 3).alias("value"))


def _statistics(s, d):
    q = tb.features(s, d).select(F.col("map_id").alias("run_id"), (F.col("feature_id") % 61).alias("accession"), (F.col("feature_id") % 997).alias("peptide"), "charge", "intensity")
    design = s.range(4).select(F.col("id").alias("run_id"), F.concat(F.lit("c"), (F.col("id") % 2).cast("string")).alias("condition"), F.floor(F.col("id") / 2).alias("replicate"))
    t = am.statistics_table(q, design)
    return t.select("ProteinName", "PeptideSequence", "PrecursorCharge", "FragmentIon", F.col("ProductCharge").cast("long").alias("ProductCharge"), "IsotopeLabelType", "Condition", "BioReplicate", "Run", F.round("Intensity", 2).alias("Intensity"))


def _feature_xml(s, d):
    path = new_path(s, "featurexml")
    fm.write_feature_xml(tb.features(s, d).select(F.concat(F.lit("f_"), F.col("feature_id").cast("string")).alias("feature_id"), "rt", "mz", "intensity", "charge", F.when(F.col("charge") > 1, 0.5).alias("quality")), path)
    return fm.read_feature_xml(s, path).select("feature_id", "rt", "mz", "intensity", F.col("charge").cast("long").alias("charge"), "quality")


def _ms2(s, d):
    path = new_path(s, "ms2")
    one = _spectra(s, d).select(idf.scan_number(F.col("native_id")).alias("scan"), "precursor_mz", F.array("charge").alias("charges"), "rt", "peaks")
    fm.write_ms2(one, path)
    return _figures(fm.read_ms2(s, path).withColumn("charge", F.col("charges")[0]), F.col("scan"))


def _usis(s, d):
    u = F.concat(F.lit("mzspec:PXD0:run"), (F.col("hit_id") % 3).cast("string"), F.lit(":scan:"), F.col("hit_id").cast("string"), F.lit(":PEPTIDE["), "accession", F.lit("]/"), F.col("charge").cast("string"))
    return tb.hits(s, d).select("hit_id", idf.parse_usi(u).alias("u")).select("hit_id", F.col("u.run").alias("run"), F.col("u.number").cast("long").alias("number"), F.col("u.interpretation").alias("interpretation"), F.col("u.charge").cast("long").alias("charge"))


def _peptides(s, d):
    return ch.digest(tb.sequences(s, d), 0, 4, 40).select("peptide").distinct()


def _references(s, d):
    return s.read.parquet(f"{d}/supplier.parquet").select(F.col("s_suppkey").alias("reference"), (F.col("s_suppkey") % 997 * 0.9 + 20.0).alias("reference_mz"))


def _times(s, d):
    return tb.peaks(s, d).filter("ms_level = 2").groupBy("run_id", "spectrum_id").agg(F.min("rt").alias("rt"), F.max("mz").alias("precursor_mz")).withColumnRenamed("spectrum_id", "precursor_id")


QUERIES = {
    "make_transitions": lambda s, d: ay.make_transitions(_peptides(s, d), low=100.0).select("peptide", F.col("charge").cast("long").alias("charge"), "ion", F.col("position").cast("long").alias("position"), *_r("precursor_mz", "product_mz")),
    "decoy_peptides": lambda s, d: ay.decoy_peptides(_peptides(s, d)),
    "isotope_scores": lambda s, d: ay.isotope_scores(tb.peaks(s, d), tb.peaks(s, d).select("spectrum_id", F.col("peak_id").alias("ion_id"), F.col("mz").alias("ion_mz")), 0.3).select("spectrum_id", "ion_id", *_r("total"), *[F.round(F.col("correlation") + 1e-9, 5).alias("correlation")]),
    "mass_errors": lambda s, d: ay.mass_errors(tb.peaks(s, d), _references(s, d), 500.0).select("run_id", "reference", (F.round("error", 4) + 0.0).alias("error"), "n"),
    "correct_masses": lambda s, d: ay.correct_masses(tb.peaks(s, d), _references(s, d), 500.0).select("peak_id", F.round(F.col("mz") + 1e-7, 5).alias("mz")),
    "interpolated_purity": lambda s, d: ay.interpolated_purity(tb.peaks(s, d), _times(s, d), 0.5, 30.0).select("precursor_id", *_r("before", "after", "purity", digits=6)),
    "lookup_by_time": lambda s, d: ay.lookup_by_time(tb.peaks(s, d), tb.features(s, d).select(F.col("feature_id").alias("query_id"), F.col("map_id").alias("run_id"), (F.col("rt") / 10 + 0.3).alias("rt")), 2.5).select("query_id", "run_id", "spectrum_id", *_r("distance")),
    "quantity_matrix": lambda s, d: ay.matrix(tb.features(s, d), ("charge",), "map_id", "intensity", [0, 1, 2, 3]).select("charge", *_r(*[f"map_id_{k}" for k in range(4)], digits=2)),
    "bonferroni": lambda s, d: te.bonferroni(_tests(s, d), ("run_id",)).select("hit_id", *_r("adjusted", digits=8)),
    "benjamini_hochberg": lambda s, d: te.benjamini_hochberg(_tests(s, d), ("run_id",)).select("hit_id", *_r("adjusted", digits=8)),
    "null_share": lambda s, d: te.null_share(_tests(s, d), ("run_id",), cut=0.05).select("run_id", *_r("share", digits=8)),
    "storey_q": lambda s, d: te.storey(_tests(s, d), ("run_id",), cut=0.05).select("hit_id", *_r("q", digits=8)),
    **{f"consensus_{h}": (lambda h: lambda s, d: ix.consensus_scores(tb.hits(s, d), h).select("spectrum_id", "accession", *_r("score"), "n", *_r("share")))(h) for h in ("best", "worst", "average", "ranks")},
    "index_places": lambda s, d: ix.index_places(ch.digest(tb.sequences(s, d), 1, 5).select("peptide"), tb.sequences(s, d)).select("peptide", "accession", F.col("start").cast("long").alias("start"), "before", "after"),
    "index_places_tryptic": lambda s, d: ix.index_places(ch.digest(tb.sequences(s, d), 0, 5).select("peptide"), tb.sequences(s, d), enzyme=pe.ENZYMES["Trypsin"], specific="full").select("peptide", "accession", F.col("start").cast("long").alias("start")),
    "index_places_leucine": lambda s, d: ix.index_places(ch.digest(tb.sequences(s, d), 0, 5).select(F.translate("peptide", "I", "L").alias("peptide")), tb.sequences(s, d), same_il=True).select("peptide", "accession", F.col("start").cast("long").alias("start")),
    "near_points": lambda s, d: cl.near_points(_points(s, d), 0.5, 10.0).select("a", "b", *_r("d", digits=6)),
    "grid_clusters": lambda s, d: cl.grid_clusters(_points(s, d), 0.5, 10.0).select("id", "cluster", *[F.round(F.col(c) + _UP, 4).alias(c) for c in ("cx", "cy")], "n"),
    "similar_spectra": lambda s, d: cl.similar_spectra(tb.peaks(s, d), _precursors(s, d), 20.0, 10.0, 0.8).select("a", "b", *_r("cosine")),
    "cluster_spectra": lambda s, d: cl.cluster_spectra(tb.peaks(s, d), _precursors(s, d), 5.0, 50.0, 0.93),
    "annotation_statistics": lambda s, d: am.annotation_statistics(sc.match_ions(tb.peaks(s, d), _matched(s, d), 0.5), tb.peaks(s, d)).select("spectrum_id", "peptide", "n_ions", *_r("share"), "top_matched", *_r("error")),
    "align_by_identifications": lambda s, d: am.align_by_identifications(tb.features(s, d).select(F.col("map_id").alias("run_id"), (F.col("feature_id") % 997).alias("peptide"), "rt")).select("run_id", *_r("slope", digits=8), *_r("intercept", digits=5), "n"),
    "statistics_table": _statistics,
    "scan_numbers": lambda s, d: tb.hits(s, d).select("hit_id", idf.scan_number(F.concat(F.when(F.col("hit_id") % 2 == 0, "controllerType=0 controllerNumber=1 scan=").otherwise("index="), F.col("hit_id").cast("string"))).alias("scan")),
    "usi_parts": _usis,
    "mgf_round_trip": _mgf,
    "mzml_round_trip": _mzml(),
    "mzml_numpress_round_trip": _mzml("linear", "pic"),
    "feature_xml_round_trip": _feature_xml,
    "ms2_round_trip": _ms2,
    "fasta_round_trip": _fasta,
    "dta2d_round_trip": _dta2d,
    "id_xml_round_trip": _id_xml,
    "mztab_round_trip": _mztab,
    "transitions_round_trip": _transitions,
    "mzqc_round_trip": _mzqc,
}

_T = "t AS (SELECT hit_id, run_id, 1 / (1 + score) AS p FROM hits)"
_BH = f"""WITH {_T}, r AS (SELECT *, p * COUNT(*) OVER (PARTITION BY run_id) / COUNT(*) OVER (PARTITION BY run_id ORDER BY p) AS raw FROM t),
a AS (SELECT hit_id, run_id, p, least(1.0, MIN(raw) OVER (PARTITION BY run_id ORDER BY p DESC RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)) AS adjusted FROM r)"""
_SHARE = "SELECT run_id, least(1.0, SUM(CASE WHEN p > 0.05 THEN 1 ELSE 0 END) / (COUNT(*) * (1 - CAST(0.05 AS DOUBLE)))) AS share FROM t GROUP BY run_id"
_CONSENSUS = """WITH b AS (SELECT spectrum_id, run_id, accession, MAX(score) AS s FROM hits GROUP BY ALL), o AS (SELECT spectrum_id, COUNT(DISTINCT run_id) AS k FROM b GROUP BY 1)
SELECT spectrum_id, accession, round({}(s), 4) AS score, COUNT(*) AS n, round(COUNT(*) / any_value(k), 4) AS share FROM b JOIN o USING (spectrum_id) GROUP BY ALL"""
_PLACES = """q AS (SELECT DISTINCT {} AS peptide FROM ({}) WHERE length(peptide) >= 5),
c AS (SELECT peptide, accession, sequence FROM q JOIN sequences ON contains({}, peptide)), o AS (SELECT *, unnest(range(1, length(sequence) - length(peptide) + 2)) AS start FROM c),
f AS (SELECT peptide, accession, sequence, start FROM o WHERE substr({}, start, length(peptide)) = peptide)"""
_ONE = f"SELECT unnest({PARTS}) AS peptide FROM sequences"
_TWO = f"""SELECT unnest(list_concat(p, list_transform(range(1, len(p)), lambda i: p[i] || p[i + 1]))) AS peptide FROM (SELECT {PARTS} AS p FROM sequences)"""
_NEAR = """n AS (SELECT a.feature_id AS a, b.feature_id AS b, sqrt(pow((a.mz - b.mz) / 0.5, 2) + pow((a.rt - b.rt) / 10.0, 2)) AS d FROM features a JOIN features b ON b.mz BETWEEN a.mz - 0.5 AND a.mz + 0.5 AND abs(a.rt - b.rt) <= 10.0 AND a.feature_id < b.feature_id),
g AS (SELECT a, b, d FROM n WHERE d <= 1)"""
_REACH = "e AS (SELECT a, b FROM g UNION ALL SELECT b, a FROM g), r(id, o) AS (SELECT a, b FROM e UNION SELECT r.id, e.b FROM r JOIN e ON r.o = e.a), l AS (SELECT id, MIN(o) AS o FROM r GROUP BY 1)"
_COSINE = """c AS (SELECT spectrum_id, MAX(mz) AS m FROM peaks GROUP BY 1), v AS (SELECT spectrum_id, floor(mz / {b}) AS bin, SUM(intensity) AS i FROM peaks GROUP BY ALL), w AS (SELECT spectrum_id, sqrt(SUM(i * i)) AS w FROM v GROUP BY 1),
g AS (SELECT x.spectrum_id AS a, y.spectrum_id AS b, SUM(x.i * y.i) / any_value(wx.w) / any_value(wy.w) AS cosine FROM v x JOIN v y USING (bin) JOIN c cx ON cx.spectrum_id = x.spectrum_id JOIN c cy ON cy.spectrum_id = y.spectrum_id JOIN w wx ON wx.spectrum_id = x.spectrum_id JOIN w wy ON wy.spectrum_id = y.spectrum_id
WHERE x.spectrum_id < y.spectrum_id AND abs(cx.m - cy.m) <= {w} GROUP BY 1, 2 HAVING cosine >= {k})"""
_SPECTRA = "SELECT spectrum_id, COUNT(*) AS n, round(SUM(mz) + 1e-6, 3) AS mz_sum, round(SUM(intensity), 3) AS intensity_sum, MAX(mz) AS mz_high, rt, rt + 100.5 AS precursor_mz, CAST(run_id % 3 + 1 AS BIGINT) AS charge FROM peaks GROUP BY run_id, spectrum_id, ms_level, rt"
_MASS = count_sql(ch.RESIDUES, "peptide") + f" + {ch.WATER!r}"
_IONS = f"q AS (SELECT DISTINCT peptide FROM ({_ONE}) WHERE length(peptide) BETWEEN 4 AND 40)"

_REFS = "refs AS (SELECT s_suppkey AS reference, s_suppkey % 997 * CAST(0.9 AS DOUBLE) + 20.0 AS reference_mz FROM supplier)"
_ERRORS = f"""{_REFS}, e AS (SELECT run_id, reference, reference_mz, SUM((mz - reference_mz) / reference_mz * 1e6 * intensity) / SUM(intensity) AS error, COUNT(*) AS n FROM peaks
JOIN refs ON mz >= reference_mz - reference_mz * CAST(500e-6 AS DOUBLE) AND mz <= reference_mz + reference_mz * CAST(500e-6 AS DOUBLE) WHERE intensity > 0 GROUP BY ALL)"""
_EXPECTED = [f"exp(-r) * pow(r, {k}) / {math.factorial(k)}" for k in range(4)]
_PURE = """SELECT precursor_id, COALESCE(SUM(CASE WHEN abs(mz - precursor_mz) <= 0.5 THEN intensity END) / NULLIF(SUM(intensity), 0), 0.0) AS purity FROM {0} JOIN peaks ON peaks.spectrum_id = {0}.s AND mz BETWEEN precursor_mz - 15.0 AND precursor_mz + 15.0 GROUP BY 1"""

_CHARGED = {**{k: v for k, v in ch._PK.items()}, "start": ch._PK_ENDS[0], "end": ch._PK_ENDS[1]}
_CHARGE_AT = " + ".join(f"n_{k} * {float(z)} / (1 + pow(10.0, ((a + b) / 2 - {pk}) * {z}))" for k, (pk, z) in _CHARGED.items())
_COUNTED = ", ".join(f"length(sequence) - length(replace(sequence, '{k}', '')) AS n_{k}" for k in ch._PK) + ", 1 AS n_start, 1 AS n_end"
_KEPT = ", ".join(f"n_{k}" for k in _CHARGED)

SQL = {
    "isoelectric_point": f"""WITH RECURSIVE h AS (SELECT accession, {_COUNTED}, CAST(0.0 AS DOUBLE) AS a, CAST(14.0 AS DOUBLE) AS b, 0 AS k FROM sequences
UNION ALL SELECT accession, {_KEPT}, CASE WHEN {_CHARGE_AT} > 0 THEN (a + b) / 2 ELSE a END, CASE WHEN {_CHARGE_AT} > 0 THEN b ELSE (a + b) / 2 END, k + 1 FROM h WHERE k < 14)
SELECT accession, round((a + b) / 2, 4) AS pi FROM h WHERE k = 14""",
    "make_transitions": f"""WITH {_IONS}, m AS (SELECT peptide, {_MASS} AS mass FROM q), z AS (SELECT peptide, charge, mass / charge + {ch.PROTON!r} AS precursor_mz FROM m, (SELECT unnest([2, 3]) AS charge)), o AS (SELECT peptide, unnest(range(3, length(peptide))) AS position FROM q),
i AS (SELECT peptide, 'b' AS ion, position, {count_sql(ch.RESIDUES, 'left(peptide, position)')} + {ch.PROTON!r} AS mz FROM o UNION ALL SELECT peptide, 'y', position, {count_sql(ch.RESIDUES, 'right(peptide, position)')} + {ch.WATER!r} + {ch.PROTON!r} FROM o)
SELECT peptide, CAST(charge AS BIGINT) AS charge, ion, position, round(precursor_mz, 4) AS precursor_mz, round(mz, 4) AS product_mz FROM z JOIN i USING (peptide) WHERE precursor_mz BETWEEN 100 AND 2000 AND mz BETWEEN 100 AND 2000""",
    "decoy_peptides": f"WITH {_IONS}, d AS (SELECT peptide, reverse(left(peptide, length(peptide) - 1)) || right(peptide, 1) AS decoy FROM q) SELECT peptide, decoy FROM d WHERE decoy <> peptide AND decoy NOT IN (SELECT peptide FROM q)",
    "isotope_scores": f"""WITH k AS (SELECT unnest([0, 1, 2, 3]) AS k), w AS (SELECT spectrum_id, peak_id AS ion_id, mz AS ion_mz, k, mz + k * CAST(1.00335483 AS DOUBLE) AS c FROM peaks, k),
n AS (SELECT w.spectrum_id, w.ion_id, w.ion_mz, w.k, SUM(p.intensity) AS i FROM w JOIN peaks p ON p.spectrum_id = w.spectrum_id AND p.mz >= w.c - CAST(0.3 AS DOUBLE) AND p.mz <= w.c + CAST(0.3 AS DOUBLE) GROUP BY ALL),
f AS (SELECT DISTINCT spectrum_id, ion_id, ion_mz FROM n), g AS (SELECT f.spectrum_id, f.ion_id, k.k, COALESCE(n.i, 0.0) AS x, (f.ion_mz - {ch.PROTON!r}) * CAST(5.36e-4 AS DOUBLE) AS r FROM f CROSS JOIN k LEFT JOIN n ON n.spectrum_id = f.spectrum_id AND n.ion_id = f.ion_id AND n.k = k.k),
h AS (SELECT spectrum_id, ion_id, x, CASE k WHEN 0 THEN {_EXPECTED[0]} WHEN 1 THEN {_EXPECTED[1]} WHEN 2 THEN {_EXPECTED[2]} ELSE {_EXPECTED[3]} END AS y FROM g)
SELECT spectrum_id, ion_id, round(SUM(x), 4) AS total, round(CASE WHEN MIN(x) < MAX(x) THEN covar_pop(x, y) / sqrt(var_pop(x) * var_pop(y)) END + 1e-9, 5) AS correlation FROM h GROUP BY 1, 2""",
    "mass_errors": f"WITH {_ERRORS} SELECT run_id, reference, round(error, 4) + 0.0 AS error, n FROM e",
    "correct_masses": f"WITH {_ERRORS}, l AS (SELECT run_id, regr_slope(error, reference_mz) AS b, regr_intercept(error, reference_mz) AS a FROM e GROUP BY 1) SELECT peak_id, round(mz / (1 + COALESCE(a + b * mz, 0.0) * 1e-6) + 1e-7, 5) AS mz FROM peaks LEFT JOIN l USING (run_id)",
    "interpolated_purity": f"""WITH sv AS (SELECT run_id, rt, MIN(spectrum_id) AS s FROM peaks WHERE ms_level = 1 GROUP BY ALL), t AS (SELECT run_id, spectrum_id AS precursor_id, MIN(rt) AS rt, MAX(mz) AS precursor_mz FROM peaks WHERE ms_level = 2 GROUP BY ALL),
x AS (SELECT t.*, sv.s, sv.rt AS a FROM t ASOF LEFT JOIN sv ON t.run_id = sv.run_id AND t.rt >= sv.rt), y AS (SELECT t.*, sv.s, sv.rt AS a FROM t ASOF LEFT JOIN sv ON t.run_id = sv.run_id AND t.rt <= sv.rt),
px AS ({_PURE.format('x')}), py AS ({_PURE.format('y')}),
v AS (SELECT x.precursor_id, x.rt, x.a AS t0, y.a AS t1, CASE WHEN x.s IS NOT NULL THEN COALESCE(px.purity, 0.0) END AS b, CASE WHEN y.s IS NOT NULL THEN COALESCE(py.purity, 0.0) END AS c FROM x JOIN y USING (precursor_id) LEFT JOIN px USING (precursor_id) LEFT JOIN py USING (precursor_id))
SELECT precursor_id, round(b, 6) AS before, round(c, 6) AS after, round(COALESCE(b + (c - b) * CASE WHEN t1 > t0 THEN (rt - t0) / (t1 - t0) ELSE 0.0 END, b, c), 6) AS purity FROM v""",
    "lookup_by_time": """WITH sv AS (SELECT DISTINCT run_id, spectrum_id, rt FROM peaks), w AS (SELECT feature_id AS query_id, map_id AS run_id, rt / 10 + CAST(0.3 AS DOUBLE) AS t FROM features),
n AS (SELECT query_id, spectrum_id, abs(rt - t) AS d FROM w JOIN sv USING (run_id) WHERE rt >= t - 2.5 AND rt <= t + 2.5 QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY abs(rt - t), rt, spectrum_id) = 1)
SELECT query_id, run_id, spectrum_id, round(d, 4) AS distance FROM w LEFT JOIN n USING (query_id)""",
    "quantity_matrix": "SELECT charge, " + ", ".join(f"round(SUM(CASE WHEN map_id = {k} THEN intensity END), 2) AS map_id_{k}" for k in range(4)) + " FROM features GROUP BY charge",
    "bonferroni": f"WITH {_T} SELECT hit_id, round(least(1.0, p * COUNT(*) OVER (PARTITION BY run_id)), 8) AS adjusted FROM t",
    "benjamini_hochberg": _BH + " SELECT hit_id, round(adjusted, 8) AS adjusted FROM a",
    "null_share": f"WITH {_T} SELECT run_id, round(share, 8) AS share FROM ({_SHARE})",
    "storey_q": _BH + f", s AS ({_SHARE}) SELECT hit_id, round(adjusted * share, 8) AS q FROM a JOIN s USING (run_id)",
    "consensus_best": _CONSENSUS.format("MAX"),
    "consensus_worst": _CONSENSUS.format("MIN"),
    "consensus_average": _CONSENSUS.format("AVG"),
    "consensus_ranks": """WITH b AS (SELECT spectrum_id, run_id, accession, MAX(score) AS s FROM hits GROUP BY ALL), o AS (SELECT spectrum_id, COUNT(DISTINCT run_id) AS k FROM b GROUP BY 1),
r AS (SELECT *, rank() OVER (PARTITION BY spectrum_id, run_id ORDER BY s DESC) AS r FROM b QUALIFY r <= 10)
SELECT spectrum_id, accession, round(1 - ((SUM(r) + (any_value(k) - COUNT(*)) * 11) / any_value(k) - 1) / 10, 4) AS score, COUNT(*) AS n, round(COUNT(*) / any_value(k), 4) AS share FROM r JOIN o USING (spectrum_id) GROUP BY ALL""",
    "index_places": "WITH " + _PLACES.format("peptide", _TWO, "sequence", "sequence") + """ SELECT peptide, accession, start, CASE WHEN start > 1 THEN substr(sequence, start - 1, 1) ELSE '[' END AS before,
CASE WHEN start + length(peptide) <= length(sequence) THEN substr(sequence, start + length(peptide), 1) ELSE ']' END AS after FROM f""",
    "index_places_tryptic": "WITH " + _PLACES.format("peptide", _ONE, "sequence", "sequence") + """ SELECT peptide, accession, start FROM f
WHERE (start = 1 OR (substr(sequence, start - 1, 1) IN ('K', 'R') AND left(peptide, 1) <> 'P')) AND (start + length(peptide) > length(sequence) OR (right(peptide, 1) IN ('K', 'R') AND substr(sequence, start + length(peptide), 1) <> 'P'))""",
    "index_places_leucine": "WITH " + _PLACES.format("replace(peptide, 'I', 'L')", _ONE, "replace(sequence, 'I', 'L')", "replace(sequence, 'I', 'L')") + " SELECT peptide, accession, start FROM f",
    "near_points": f"WITH {_NEAR} SELECT a, b, round(d, 6) AS d FROM g",
    "grid_clusters": f"""WITH RECURSIVE {_NEAR}, {_REACH}, k AS (SELECT feature_id AS id, mz, rt, least(feature_id, COALESCE(o, feature_id)) AS cluster FROM features LEFT JOIN l ON l.id = feature_id)
SELECT id, cluster, round(AVG(mz) OVER w + 1e-6, 4) AS cx, round(AVG(rt) OVER w + 1e-6, 4) AS cy, COUNT(*) OVER w AS n FROM k WINDOW w AS (PARTITION BY cluster)""",
    "similar_spectra": "WITH " + _COSINE.format(b=10.0, w=20.0, k=0.8) + " SELECT a, b, round(cosine, 4) AS cosine FROM g",
    "cluster_spectra": "WITH RECURSIVE " + _COSINE.format(b=50.0, w=5.0, k=0.93) + f", {_REACH} SELECT spectrum_id, least(spectrum_id, COALESCE(o, spectrum_id)) AS cluster FROM c LEFT JOIN l ON l.id = spectrum_id",
    "annotation_statistics": _PSM.replace("i.*, intensity,", "i.*, peak_id, intensity,").replace("intensity DESC) = 1", "intensity DESC, peak_id) = 1") + """, t AS (SELECT spectrum_id, SUM(intensity) AS t FROM peaks GROUP BY 1),
h AS (SELECT spectrum_id, peak_id FROM peaks QUALIFY row_number() OVER (PARTITION BY spectrum_id ORDER BY intensity DESC, peak_id) <= 10), u AS (SELECT DISTINCT spectrum_id, peptide, peak_id, intensity FROM m),
s AS (SELECT u.spectrum_id, peptide, SUM(intensity) AS i, COUNT(h.peak_id) AS top_matched FROM u LEFT JOIN h USING (spectrum_id, peak_id) GROUP BY ALL), n AS (SELECT spectrum_id, peptide, COUNT(*) AS n_ions, AVG(error) AS error FROM m GROUP BY ALL)
SELECT spectrum_id, peptide, n_ions, round(i / t, 4) AS share, top_matched, round(error, 4) AS error FROM n JOIN s USING (spectrum_id, peptide) JOIN t USING (spectrum_id)""",
    "align_by_identifications": """WITH o AS (SELECT map_id, feature_id % 997 AS k, quantile_cont(rt, 0.5) AS x FROM features GROUP BY ALL), r AS (SELECT k, quantile_cont(x, 0.5) AS y FROM o GROUP BY 1 HAVING COUNT(*) >= 2)
SELECT map_id AS run_id, round(regr_slope(y, x), 8) AS slope, round(AVG(y) - regr_slope(y, x) * AVG(x), 5) AS intercept, COUNT(*) AS n FROM o JOIN r USING (k) GROUP BY 1""",
    "statistics_table": """SELECT feature_id % 61 AS "ProteinName", feature_id % 997 AS "PeptideSequence", charge AS "PrecursorCharge", 'NA' AS "FragmentIon", CAST(0 AS BIGINT) AS "ProductCharge", 'L' AS "IsotopeLabelType",
'c' || CAST(map_id % 2 AS VARCHAR) AS "Condition", map_id // 2 AS "BioReplicate", map_id AS "Run", round(MAX(intensity), 2) AS "Intensity" FROM features GROUP BY ALL""",
    "scan_numbers": "SELECT hit_id, hit_id AS scan FROM hits",
    "usi_parts": "SELECT hit_id, 'run' || CAST(hit_id % 3 AS VARCHAR) AS run, hit_id AS number, 'PEPTIDE[' || accession || ']/' || CAST(charge AS VARCHAR) AS interpretation, CAST(charge AS BIGINT) AS charge FROM hits",
    "mgf_round_trip": _SPECTRA,
    "mzml_round_trip": _SPECTRA,
    "mzml_numpress_round_trip": _SPECTRA,
    "feature_xml_round_trip": "SELECT 'f_' || CAST(feature_id AS VARCHAR) AS feature_id, rt, mz, intensity, CAST(charge AS BIGINT) AS charge, CASE WHEN charge > 1 THEN CAST(0.5 AS DOUBLE) END AS quality FROM features",
    "ms2_round_trip": _SPECTRA,
    "fasta_round_trip": "SELECT 'P' || CAST(accession AS VARCHAR) AS accession, 'a protein' AS description, sequence FROM sequences WHERE sequence <> ''",
    "dta2d_round_trip": "SELECT rt, COUNT(*) AS n, round(SUM(mz) + 1e-6, 3) AS mz_sum, round(SUM(intensity), 3) AS intensity_sum FROM peaks GROUP BY rt",
    "id_xml_round_trip": "SELECT hit_id * CAST(0.5 AS DOUBLE) AS mz, spectrum_id * CAST(1.25 AS DOUBLE) AS rt, 'PEP<' || accession || '>\"K&R\"' AS sequence, round(score, 4) AS score, CAST(charge AS BIGINT) AS charge, CAST(2 AS BIGINT) AS n_proteins FROM hits",
    "mztab_round_trip": "SELECT hit_id AS psm, accession, CASE WHEN NOT decoy THEN round(score, 4) END AS score, CAST(charge AS BIGINT) AS charge FROM hits",
    "mzqc_round_trip": "SELECT run_id AS run, 'MS:4000059' AS accession, CAST(COUNT(*) AS DOUBLE) AS value FROM peaks GROUP BY 1 UNION ALL SELECT run_id, 'MS:4000029', round(SUM(intensity), 3) FROM peaks GROUP BY 1",
}
# the b and y ions that a position cuts hold all residues, one water and two protons
_WHOLE = " + ".join(f"(length(peptide) - length(replace(peptide, '{k}', ''))) * CAST({v!r} AS DOUBLE)" for k, v in ch.RESIDUES.items())
SQL["transitions_round_trip"] = f"WITH {_IONS} SELECT peptide, CAST(2 * (length(peptide) - 1) AS BIGINT) AS n, round((length(peptide) - 1) * ({_WHOLE} + CAST({ch.WATER + 2 * ch.PROTON!r} AS DOUBLE)), 3) AS product_sum, CAST(length(peptide) - 1 AS BIGINT) AS n_decoys, CAST(length(peptide) AS DOUBLE) AS rt FROM q"
SQL = {k: tb.sql(v) if not v.startswith("WITH RECURSIVE") else tb.sql("WITH" + v[len("WITH RECURSIVE") :]).replace("WITH ", "WITH RECURSIVE ", 1) for k, v in SQL.items()}
