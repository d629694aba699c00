"""Queries of cross-links, charge states, traces, quantities and statistics, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import chemistry as ch
from ..functions import peptides as pe
from ..operators import assignments as asg
from ..sources import tables as tb
from .extra import _MASS, _SHORT, _V, _pairs, _r, _short, _vectors
from .sqltext import count_sql

_FROM, _TO = "DEFHIKLMNPQRSTVWY", "ACGUACGUACGUACGUA"
LINKER = 138.06808


def _chains(s, d):
    return tb.sequences(s, d).select("accession", F.translate("sequence", _FROM, _TO).alias("sequence"))


def _samples(s, d):
    return tb.features(s, d).select(F.concat(F.lit("P"), (F.col("feature_id") % 61).cast("string")).alias("accession"), (F.col("feature_id") % 997).alias("peptide"), F.col("map_id").alias("sample"), "intensity")


def _points(s, d):
    return tb.peaks(s, d).groupBy("run_id", F.floor(F.col("mz") / 100).alias("target"), "rt").agg(F.sum("intensity").alias("intensity"))


QUERIES = {
    "rna_mass": lambda s, d: _chains(s, d).select("accession", F.round(asg.rna_mass(F.col("sequence")), 4).alias("mass")),
    "digest_rna_t1": lambda s, d: asg.digest_rna(_chains(s, d), "RNase_T1").select("accession", "fragment", F.col("start").cast("long").alias("start")),
    "digest_rna_a": lambda s, d: asg.digest_rna(_chains(s, d), "RNase_A").select("accession", "fragment", F.col("start").cast("long").alias("start")),
    "cross_link_candidates": lambda s, d: asg.cross_link_candidates(_short(s, d), tb.features(s, d).select(F.col("feature_id").alias("spectrum_id"), (F.col("mz") * 2 + 1000).alias("precursor_mass")), LINKER, 0.005).select("spectrum_id", "alpha", "beta", *_r("mass")),
    "internal_ions": lambda s, d: asg.internal_ions(_short(s, d)).select("peptide", F.col("start").cast("long").alias("start"), F.col("length").cast("long").alias("length"), *_r("mz")),
    "decharge_pairs": lambda s, d: asg.decharge_pairs(tb.features(s, d), 0.1, 100.0).select("map_id", "a_id", "b_id", *_r("mass")),
    "accurate_mass_search": lambda s, d: asg.accurate_mass_search(tb.features(s, d), _short(s, d).select(F.col("peptide").alias("compound"), ch.peptide_mass(F.col("peptide")).alias("mass")), 50.0).select("feature_id", "compound", "adduct", *_r("error")),
    "integrate_traces": lambda s, d: asg.integrate(_points(s, d), ("run_id", "target")).select("run_id", "target", "n", *_r("area", "height", "background")),
    "split_at_valleys": lambda s, d: asg.split_at_valleys(_points(s, d), ("run_id", "target")).groupBy("run_id", "target", "segment").agg(F.count("*").alias("n"), F.sum("intensity").alias("intensity")).select("run_id", "target", "segment", "n", *_r("intensity")),
    "link_scans": lambda s, d: asg.link_scans(tb.peaks(s, d), 100.0),
    "protein_quantities": lambda s, d: asg.protein_quantities(_samples(s, d)).select("accession", "sample", "n_peptides", *_r("quantity", digits=2)),
    "protein_quantities_median": lambda s, d: asg.protein_quantities(_samples(s, d), 5, "median").select("accession", "sample", "n_peptides", *_r("quantity", digits=2)),
    "rank_correlation": lambda s, d: asg.rank_correlation(_vectors(s, d), ("spectrum_id",)).select("spectrum_id", *_r("spearman", digits=6)),
    "score_deviations": lambda s, d: asg.deviations(tb.hits(s, d), ("run_id", "charge"), "score").select("run_id", "charge", *_r("median", "mad", "mean", "deviation")),
    "roc_area": lambda s, d: asg.roc_area(tb.hits(s, d)).select("run_id", *_r("area", digits=6)),
    "dot_and_bias": lambda s, d: asg.dot_and_bias(tb.peaks(s, d), _pairs(s, d)).select("a", "b", *_r("dot", "bias", digits=6)),
    "peptide_isotopes": lambda s, d: asg.peptide_isotopes(_short(s, d)),
    "residue_compositions": lambda s, d: asg.compositions(tb.features(s, d).select(F.col("feature_id").alias("id"), (F.floor(F.col("mz")) + 0.2).alias("mass")), {k: ch.RESIDUES[k] for k in "GASPVT"}, 0.01),
}

_CHAINS = f"c AS (SELECT accession, translate(sequence, '{_FROM}', '{_TO}') AS sequence FROM sequences)"
_FRAGMENTS = "WITH {}, p AS (SELECT accession, list_filter(string_split(regexp_replace(sequence, '([{}])', '\\1|', 'g'), '|'), lambda x: x <> '') AS p FROM c) SELECT accession, unnest(p) AS fragment, unnest(range(0, len(p))) AS start FROM p"
_POINTS = "t AS (SELECT run_id, CAST(floor(mz / 100) AS BIGINT) AS target, rt, CAST(SUM(intensity) AS DOUBLE) AS y FROM peaks GROUP BY ALL)"
_QUANTITIES = """WITH e AS (SELECT 'P' || CAST(feature_id % 61 AS VARCHAR) AS accession, map_id AS "sample", feature_id % 997 AS peptide, SUM(intensity) AS i FROM features GROUP BY ALL),
b AS (SELECT * FROM e QUALIFY row_number() OVER (PARTITION BY accession, "sample" ORDER BY i DESC, peptide) <= {}) SELECT accession, "sample", COUNT(*) AS n_peptides, round({}, 2) AS quantity FROM b GROUP BY ALL"""
_ADDUCTS = ", ".join(f"('{k}', {z}, {n}, CAST({ch.formula_mass(f)!r} AS DOUBLE))" for k, (f, z, n) in pe.ADDUCTS.items() if k in ("M+H;1+", "M+Na;1+", "M+2H;2+"))

SQL = {
    "rna_mass": f"WITH {_CHAINS} SELECT accession, round(CASE WHEN length(sequence) > 0 THEN {count_sql(asg.NUCLEOTIDES)} + CAST({asg.NUCLEOTIDE_ENDS!r} AS DOUBLE) ELSE 0.0 END, 4) AS mass FROM c",
    "digest_rna_t1": _FRAGMENTS.format(_CHAINS, "G"),
    "digest_rna_a": _FRAGMENTS.format(_CHAINS, "CU"),
    "cross_link_candidates": f"""WITH {_SHORT}, p AS (SELECT peptide, {_MASS} AS m FROM q), c AS (SELECT a.peptide AS alpha, b.peptide AS beta, a.m AS am, b.m AS bm FROM p a JOIN p b ON a.m > b.m OR (a.m = b.m AND a.peptide >= b.peptide))
SELECT feature_id AS spectrum_id, alpha, beta, round(am + bm + {LINKER}, 4) AS mass FROM features JOIN c ON bm >= mz * 2 + 1000 - {LINKER} - am - 0.005 AND bm <= mz * 2 + 1000 - {LINKER} - am + 0.005""",
    "internal_ions": f"""WITH {_SHORT}, s AS (SELECT peptide, unnest(range(2, length(peptide) - 1)) AS start FROM q), l AS (SELECT peptide, start, unnest(range(2, length(peptide) - start + 1)) AS length FROM s),
t AS (SELECT *, substr(peptide, start, length) AS part FROM l) SELECT peptide, start, length, round({count_sql(ch.RESIDUES, 'part')} + {ch.PROTON!r}, 4) AS mz FROM t""",
    "decharge_pairs": f"""WITH f AS (SELECT map_id, feature_id, charge, rt, (mz - {ch.PROTON!r}) * charge AS m FROM features)
SELECT a.map_id, a.feature_id AS a_id, b.feature_id AS b_id, round((a.m + b.m) / 2, 4) AS mass FROM f a JOIN f b ON a.map_id = b.map_id AND a.charge < b.charge AND a.m >= b.m - 0.1 AND a.m <= b.m + 0.1 WHERE abs(a.rt - b.rt) <= 100""",
    "accurate_mass_search": f"""WITH {_SHORT}, a(adduct, z, n, m) AS (VALUES {_ADDUCTS}), i AS (SELECT peptide AS compound, adduct, z, (n * {_MASS} + m - z * CAST({pe.ELECTRON!r} AS DOUBLE)) / abs(z) AS x FROM q, a)
SELECT feature_id, compound, adduct, round((mz - x) / x * 1e6, 4) AS error FROM features JOIN i ON charge = z AND mz >= x - x * (50.0 * 1e-6) AND mz <= x + x * (50.0 * 1e-6)""",
    "integrate_traces": f"""WITH {_POINTS}, s AS (SELECT *, (rt - lag(rt) OVER w) * (y + lag(y) OVER w) / 2 AS s FROM t WINDOW w AS (PARTITION BY run_id, target ORDER BY rt)),
g AS (SELECT run_id, target, COUNT(*) AS n, COALESCE(SUM(s), 0.0) AS a, MAX(y) AS height, (MAX(rt) - MIN(rt)) * (arg_min(y, rt) + arg_max(y, rt)) / 2 AS g FROM s GROUP BY ALL)
SELECT run_id, target, n, round(greatest(a - g, 0.0), 4) AS area, round(height, 4) AS height, round(g, 4) AS background FROM g""",
    "split_at_valleys": f"""WITH {_POINTS}, m AS (SELECT *, AVG(y) OVER (PARTITION BY run_id, target ORDER BY rt ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING) AS m FROM t),
c AS (SELECT *, CASE WHEN m < 0.8 * lag(m) OVER w AND m < 0.8 * lead(m) OVER w THEN 1 ELSE 0 END AS c FROM m WINDOW w AS (PARTITION BY run_id, target ORDER BY rt)),
s AS (SELECT *, CAST(SUM(c) OVER (PARTITION BY run_id, target ORDER BY rt) AS BIGINT) AS segment FROM c) SELECT run_id, target, segment, COUNT(*) AS n, round(SUM(y), 4) AS intensity FROM s GROUP BY ALL""",
    "link_scans": """WITH s AS (SELECT run_id, spectrum_id, row_number() OVER (PARTITION BY run_id ORDER BY rt, spectrum_id) AS scan FROM (SELECT DISTINCT run_id, spectrum_id, rt FROM peaks)), p AS (SELECT run_id, scan, peak_id, mz FROM peaks JOIN s USING (run_id, spectrum_id)),
n AS (SELECT a.run_id, a.scan, a.peak_id AS a, b.peak_id AS b, abs(a.mz - b.mz) AS d FROM p a JOIN p b ON a.run_id = b.run_id AND b.scan = a.scan + 1 AND a.mz >= b.mz - b.mz * (100.0 * 1e-6) AND a.mz <= b.mz + b.mz * (100.0 * 1e-6))
SELECT run_id, a, b FROM n QUALIFY row_number() OVER (PARTITION BY run_id, scan, a ORDER BY d, b) = 1 AND row_number() OVER (PARTITION BY run_id, scan, b ORDER BY d, a) = 1""",
    "protein_quantities": _QUANTITIES.format(3, "SUM(i)"),
    "protein_quantities_median": _QUANTITIES.format(5, "quantile_cont(i, 0.5)"),
    "rank_correlation": f"""WITH {_V}, r AS (SELECT spectrum_id, rank() OVER (PARTITION BY spectrum_id ORDER BY x) + (COUNT(*) OVER (PARTITION BY spectrum_id, x) - 1) / 2 AS a, rank() OVER (PARTITION BY spectrum_id ORDER BY y) + (COUNT(*) OVER (PARTITION BY spectrum_id, y) - 1) / 2 AS b FROM v)
SELECT spectrum_id, round(corr(a, b), 6) AS spearman FROM r GROUP BY 1""",
    "score_deviations": """WITH m AS (SELECT run_id, charge, quantile_cont(score, 0.5) AS m FROM hits GROUP BY ALL)
SELECT run_id, charge, round(any_value(m), 4) AS median, round(quantile_cont(abs(score - m), 0.5), 4) AS mad, round(AVG(score), 4) AS mean, round(stddev_samp(score), 4) AS deviation FROM hits JOIN m USING (run_id, charge) GROUP BY ALL""",
    "roc_area": """WITH n AS (SELECT run_id, score, SUM(CASE WHEN decoy THEN 0 ELSE 1 END) AS t, SUM(CASE WHEN decoy THEN 1 ELSE 0 END) AS d FROM hits GROUP BY ALL), b AS (SELECT *, COALESCE(SUM(d) OVER (PARTITION BY run_id ORDER BY score ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS b FROM n)
SELECT run_id, round(SUM(t * (b + d / 2)) / (SUM(t) * SUM(d)), 6) AS area FROM b GROUP BY 1""",
    "dot_and_bias": """WITH v AS (SELECT spectrum_id, floor(mz / 10.0) AS bin, SUM(intensity) AS x FROM peaks GROUP BY ALL), u AS (SELECT spectrum_id, bin, x / sqrt(SUM(x * x) OVER (PARTITION BY spectrum_id)) AS x FROM v),
p AS (SELECT a.spectrum_id AS a, b.spectrum_id AS b, a.x * b.x AS p FROM u a JOIN u b ON b.spectrum_id = a.spectrum_id + 1 AND a.bin = b.bin) SELECT a, b, round(SUM(p), 6) AS dot, round(sqrt(SUM(p * p)) / SUM(p), 6) AS bias FROM p GROUP BY ALL""",
}
SQL = {k: tb.sql(v) for k, v in SQL.items()}
