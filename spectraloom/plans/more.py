"""Queries of signal processing, traces and peptide-spectrum matching, with their SQL."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from ..functions import chemistry as ch
from ..operators import scoring as sc
from ..operators import signal as sg
from ..sources import tables as tb
from .sqltext import PARTS, count_sql


def _r(*names, digits=4):
    return [F.round(n, digits).alias(n) for n in names]


#: Means of values with four digits can end in a 5 right after the last digit shown, where the order of summing decides; this does instead.
_UP = 1e-9


def _morph(method):
    return lambda s, d: sg.morphology(tb.peaks(s, d), method, 2).select("spectrum_id", "peak_id", *_r("intensity"))


def _psms(s, d):
    n = tb.peaks(s, d).agg(F.max("spectrum_id")).first()[0] or 0
    return ch.digest(tb.sequences(s, d), 0, 4, 40).select((F.col("accession") % (n + 1)).alias("spectrum_id"), "peptide").distinct()


def _traces(s, d):
    return sg.mass_traces(tb.peaks(s, d), 60.0, 3, 2)


QUERIES = {f"morphology_{m}": _morph(m) for m in ("erosion", "dilation", "opening", "closing", "gradient", "bothat")} | {
    "savitzky_golay_fit": lambda s, d: sg.savitzky_golay(tb.peaks(s, d), 11, 4).select("spectrum_id", "peak_id", *_r("intensity")),
    "gaussian_integral": lambda s, d: sg.gaussian_integral(tb.peaks(s, d), 8.0).select("spectrum_id", "peak_id", *_r("intensity")),
    "mass_traces": lambda s, d: _traces(s, d).withColumn("mz", F.col("mz") + _UP).select("run_id", *_r("mz", "rt_low", "rt_high", "apex", "intensity", digits=5), "n"),
    "group_isotopes": lambda s, d: sg.group_isotopes(_traces(s, d), tolerance=0.3).select("run_id", "charge", *[F.round(F.col(c) + _UP, 5).alias(c) for c in ("mono_mz", "iso_mz")]),
    "hyperscore": lambda s, d: sc.hyperscore(sc.match_ions(tb.peaks(s, d), _psms(s, d), 0.5)).select("spectrum_id", "peptide", *_r("score", "mean_error"), "n_b", "n_y"),
    "morpheus_score": lambda s, d: sc.morpheus(sc.match_ions(tb.peaks(s, d), _psms(s, d), 0.5), tb.peaks(s, d)).select("spectrum_id", "peptide", *_r("score")),
    "precursor_candidates": lambda s, d: sc.candidates(_psms(s, d).select("peptide").distinct(), tb.features(s, d).select(F.col("feature_id").alias("spectrum_id"), F.col("mz").alias("precursor_mass")), 0.25).select("spectrum_id", "peptide", *_r("mass")),
    "index_peptides": lambda s, d: sc.index_peptides(_psms(s, d), tb.sequences(s, d)).select("peptide", "accession", F.col("start").cast("long").alias("start")),
    "sequence_coverage": lambda s, d: sc.sequence_coverage(ch.digest(tb.sequences(s, d), 0, 1).select("accession", "peptide"), tb.sequences(s, d)).select("accession", *_r("coverage")),
    "resolve_shared": lambda s, d: sc.resolve_shared(ch.digest(tb.sequences(s, d), 0, 2).select("peptide", "accession"), tb.sequences(s, d).select("accession", F.length("sequence").alias("score"))).select("peptide", "accession", F.col("score").cast("long").alias("score")),
    "normalize_quantiles": lambda s, d: sc.normalize_quantiles(tb.features(s, d)).select("map_id", "feature_id", F.round(F.col("intensity") + _UP, 2).alias("intensity")),
}

_W = "(PARTITION BY spectrum_id ORDER BY mz, peak_id ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING)"
_ONE = "SELECT spectrum_id, peak_id, round({}, 4) AS intensity FROM peaks"
_TWO = f"WITH f AS (SELECT *, {{}}(intensity) OVER {_W} AS f FROM peaks) SELECT spectrum_id, peak_id, round({{}}, 4) AS intensity FROM f"
_PSM = f"""WITH p AS (SELECT DISTINCT accession % (SELECT MAX(spectrum_id) + 1 FROM peaks) AS spectrum_id, peptide FROM (SELECT accession, unnest({PARTS}) AS peptide FROM sequences) WHERE length(peptide) BETWEEN 4 AND 40),
o AS (SELECT spectrum_id, peptide, unnest(range(1, length(peptide))) AS position FROM p),
i AS (SELECT spectrum_id, peptide, 'b' AS ion, position, {count_sql(ch.RESIDUES, 'left(peptide, position)')} + {ch.PROTON!r} AS ion_mz FROM o
  UNION ALL SELECT spectrum_id, peptide, 'y', position, {count_sql(ch.RESIDUES, 'right(peptide, position)')} + {ch.WATER!r} + {ch.PROTON!r} FROM o),
m AS (SELECT i.*, intensity, abs(mz - ion_mz) AS error FROM i JOIN peaks USING (spectrum_id) WHERE mz >= ion_mz - 0.5 AND mz <= ion_mz + 0.5
  QUALIFY row_number() OVER (PARTITION BY spectrum_id, peptide, ion, position ORDER BY abs(mz - ion_mz), mz, intensity DESC) = 1) """
_TRACE = """WITH scans AS (SELECT run_id, spectrum_id, row_number() OVER (PARTITION BY run_id ORDER BY rt, spectrum_id) AS scan FROM (SELECT DISTINCT run_id, spectrum_id, rt FROM peaks)),
c AS (SELECT *, CASE WHEN mz - lag(mz) OVER w > mz * CAST(0.00006 AS DOUBLE) THEN 1 ELSE 0 END AS cut FROM peaks WINDOW w AS (PARTITION BY run_id ORDER BY mz, peak_id)),
b AS (SELECT *, SUM(cut) OVER (PARTITION BY run_id ORDER BY mz, peak_id) AS band FROM c),
t AS (SELECT b.*, scan FROM b JOIN scans USING (run_id, spectrum_id) QUALIFY row_number() OVER (PARTITION BY run_id, band, spectrum_id ORDER BY intensity DESC, peak_id) = 1),
n AS (SELECT *, CASE WHEN scan - lag(scan) OVER (PARTITION BY run_id, band ORDER BY scan) > 4 THEN 1 ELSE 0 END AS fresh FROM t),
q AS (SELECT *, SUM(fresh) OVER (PARTITION BY run_id, band ORDER BY scan) AS part FROM n),
r AS (SELECT run_id, COUNT(*) AS n, COALESCE(SUM(mz * intensity) / NULLIF(SUM(intensity), 0), AVG(mz)) AS mz, MIN(rt) AS rt_low, MAX(rt) AS rt_high, arg_max(rt, intensity * 1e6 - rt) AS apex, SUM(intensity) AS intensity FROM q GROUP BY run_id, band, part HAVING COUNT(*) >= 2) """

# the value at a point of the least-squares polynomial through its frame, from the polynomial's coefficients
_X = np.vander(np.arange(11) - 5.0, 5)
_HAT = (_X @ np.linalg.pinv(_X)).tolist()

SQL = {
    "savitzky_golay_fit": f"""WITH l AS (SELECT spectrum_id, list(intensity ORDER BY mz, peak_id) AS y, list(peak_id ORDER BY mz, peak_id) AS p, COUNT(*) AS n FROM peaks GROUP BY 1), i AS (SELECT *, unnest(range(0, n)) AS i FROM l),
s AS (SELECT *, greatest(least(i - 5, n - 11), 0) AS s FROM i)
SELECT spectrum_id, p[i + 1] AS peak_id, round(CASE WHEN n < 11 THEN y[i + 1] ELSE greatest(list_sum(list_transform(range(1, 12), lambda k: y[s + k] * (({_HAT!r})[i - s + 1])[k])), 0.0) END, 4) + 0.0 AS intensity FROM s""",
    "morphology_erosion": _ONE.format(f"MIN(intensity) OVER {_W}"),
    "morphology_dilation": _ONE.format(f"MAX(intensity) OVER {_W}"),
    "morphology_gradient": _ONE.format(f"MAX(intensity) OVER {_W} - MIN(intensity) OVER {_W}"),
    "morphology_opening": _TWO.format("MIN", f"MAX(f) OVER {_W}"),
    "morphology_closing": _TWO.format("MAX", f"MIN(f) OVER {_W}"),
    "morphology_bothat": _TWO.format("MAX", f"intensity - MIN(f) OVER {_W}"),
    "mass_traces": _TRACE + "SELECT run_id, round(mz + 1e-9, 5) AS mz, round(rt_low, 5) AS rt_low, round(rt_high, 5) AS rt_high, round(apex, 5) AS apex, round(intensity, 5) AS intensity, n FROM r",
    "group_isotopes": _TRACE + """SELECT a.run_id, charge, round(a.mz + 1e-9, 5) AS mono_mz, round(b.mz + 1e-9, 5) AS iso_mz FROM r a, (SELECT unnest([1, 2, 3]) AS charge) z, r b
WHERE a.run_id = b.run_id AND abs(b.mz - (a.mz + CAST(1.00335483 AS DOUBLE) / charge)) <= 0.3 AND b.apex BETWEEN a.rt_low AND a.rt_high AND a.apex BETWEEN b.rt_low AND b.rt_high""",
    "hyperscore": _PSM + """, s AS (SELECT spectrum_id, peptide, SUM(intensity) AS dot, SUM(CASE WHEN ion = 'b' THEN 1 ELSE 0 END) AS n_b, SUM(CASE WHEN ion = 'y' THEN 1 ELSE 0 END) AS n_y, AVG(error) AS e FROM m GROUP BY ALL)
SELECT spectrum_id, peptide, round(ln(1 + dot) + ln(factorial(CAST(n_b AS INTEGER))) + ln(factorial(CAST(n_y AS INTEGER))), 4) AS score, round(e, 4) AS mean_error, CAST(n_b AS BIGINT) AS n_b, CAST(n_y AS BIGINT) AS n_y FROM s""",
    "morpheus_score": _PSM + """, t AS (SELECT spectrum_id, SUM(intensity) AS tic FROM peaks GROUP BY 1)
SELECT spectrum_id, peptide, round(COUNT(*) + CASE WHEN any_value(tic) > 0 THEN SUM(intensity) / any_value(tic) ELSE 0.0 END, 4) AS score FROM m JOIN t USING (spectrum_id) GROUP BY ALL""",
    "precursor_candidates": f"""WITH p AS (SELECT DISTINCT peptide FROM (SELECT unnest({PARTS}) AS peptide FROM sequences) WHERE length(peptide) BETWEEN 4 AND 40), q AS (SELECT peptide, {count_sql(ch.RESIDUES, 'peptide')} + {ch.WATER!r} AS mass FROM p)
SELECT feature_id AS spectrum_id, peptide, round(mass, 4) AS mass FROM features JOIN q ON mass >= mz - 0.25 AND mass <= mz + 0.25""",
    "index_peptides": f"""WITH p AS (SELECT accession, {PARTS} AS p FROM sequences), s AS (SELECT accession, p, unnest(range(0, len(p))) AS start FROM p), d AS (SELECT *, unnest([0, 1, 2]) AS missed FROM s),
e AS (SELECT accession, array_to_string(list_slice(p, start + 1, start + 1 + missed), '') AS peptide, start FROM d WHERE start + missed < len(p)),
q AS (SELECT DISTINCT peptide FROM (SELECT unnest(p) AS peptide FROM p) WHERE length(peptide) BETWEEN 4 AND 40) SELECT peptide, accession, start FROM e JOIN q USING (peptide)""",
    "sequence_coverage": f"""WITH p AS (SELECT DISTINCT accession, sequence, peptide FROM (SELECT accession, sequence, unnest({PARTS}) AS peptide FROM sequences)),
o AS (SELECT *, unnest(range(1, length(sequence) + 1)) AS place FROM p),
c AS (SELECT DISTINCT accession, unnest(range(place, place + length(peptide))) AS i FROM o WHERE substr(sequence, place, length(peptide)) = peptide), n AS (SELECT accession, COUNT(*) AS n FROM c GROUP BY 1)
SELECT accession, round(CASE WHEN length(sequence) > 0 THEN COALESCE(n, 0) / length(sequence) ELSE 0.0 END, 4) AS coverage FROM sequences LEFT JOIN n USING (accession)""",
    "resolve_shared": f"""WITH p AS (SELECT DISTINCT accession, length(sequence) AS score, peptide FROM (SELECT accession, sequence, unnest({PARTS}) AS peptide FROM sequences) WHERE length(peptide) >= 2)
SELECT peptide, accession, score FROM p QUALIFY row_number() OVER (PARTITION BY peptide ORDER BY score DESC, accession) = 1""",
    "normalize_quantiles": """WITH r AS (SELECT *, ((row_number() OVER (PARTITION BY map_id ORDER BY intensity, feature_id) - 1) * 1000) // COUNT(*) OVER (PARTITION BY map_id) AS q FROM features),
s AS (SELECT q, AVG(m) AS m FROM (SELECT map_id, q, AVG(intensity) AS m FROM r GROUP BY ALL) GROUP BY 1) SELECT map_id, feature_id, round(m + 1e-9, 2) AS intensity FROM r JOIN s USING (q)""",
}
SQL = {k: tb.sql(v) for k, v in SQL.items()}
