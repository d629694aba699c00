"""A small search engine, and places of modifications by site-determining ions."""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import chemistry as ch
from . import scoring
from .identification import apply_fdr, best_hits
from .quality import binomial_tail

#: How much each peak depth (1 to 10) counts in a peptide's score.
DEPTH_WEIGHTS = (0.5, 0.75, 1.0, 1.0, 1.0, 1.0, 0.75, 0.5, 0.25, 0.25)


def simple_search(peaks: DataFrame, precursors: DataFrame, proteins: DataFrame, tolerance: float = 0.02, ion_tolerance: float = 0.02, missed: int = 1, shortest: int = 6, longest: int = 40, top: int = 1) -> DataFrame:
    """(spectrum_id, hit_id, peptide, decoy, score, rank, q_value, accessions): tryptic peptides and their decoys against spectra.

    precursors: (spectrum_id, precursor_mass: neutral). Decoys are reversed but for the last residue; those that are a target too aren't decoys.
    Candidates meet spectra by mass cells, ions meet peaks by m/z cells; the score is hyperscore, hits without a matched ion are none.
    q values are of each spectrum's best hit; lower ranks have null."""
    parts = ch.digest(proteins, missed, shortest, longest).select("peptide", "accession").distinct()
    target = parts.select("peptide").distinct()
    decoy = target.select(ch.decoy_sequence(F.col("peptide")).alias("peptide")).distinct().join(target, "peptide", "left_anti")
    both = target.withColumn("decoy", F.lit(False)).union(decoy.withColumn("decoy", F.lit(True)))
    psms = scoring.candidates(both, precursors, tolerance).select("spectrum_id", "peptide")
    scored = scoring.hyperscore(scoring.match_ions(peaks, psms, ion_tolerance)).join(both, "peptide")
    scored = scored.select("spectrum_id", F.xxhash64("spectrum_id", "peptide").alias("hit_id"), "peptide", "decoy", "score")
    best = best_hits(scored, top)
    q = apply_fdr(best.filter("rank = 1"), [], "basic", True).select("hit_id", "q_value")
    names = parts.groupBy("peptide").agg(F.array_sort(F.collect_set("accession")).alias("accessions"))
    return best.join(q, "hit_id", "left").join(names, "peptide", "left").select("spectrum_id", "hit_id", "peptide", "decoy", "score", "rank", "q_value", "accessions")


def _ions(peptide: str, sites: tuple, mass: float) -> dict[tuple[str, int], float]:
    own = np.array([ch.RESIDUES[c] for c in peptide])
    own[list(sites)] += mass
    total, run = own.sum(), np.cumsum(own)[:-1]
    n = len(peptide)
    out = {("b", i + 1): float(x + ch.PROTON) for i, x in enumerate(run)}
    return out | {("y", n - i - 1): float(total - x + ch.WATER + ch.PROTON) for i, x in enumerate(run)}


def _by_depth(mz: np.ndarray, high: np.ndarray, window: float = 100.0) -> np.ndarray:
    """Rank from 1 of each peak by intensity in its window of m/z."""
    cell, out = np.floor(mz / window).astype(int), np.empty(len(mz), int)
    for c in np.unique(cell):
        at = np.flatnonzero(cell == c)
        out[at[np.lexsort((mz[at], -high[at]))]] = np.arange(1, len(at) + 1)
    return out


def _matched(ions: list[float], mz: np.ndarray, tolerance: float) -> int:
    lo, hi = np.searchsorted(mz, np.array(ions) - tolerance, "left"), np.searchsorted(mz, np.array(ions) + tolerance, "right")
    return int((hi > lo).sum())


def site_scores(peptide: str, n_sites: int, mz: np.ndarray, high: np.ndarray, tolerance: float, mass: float, residues: str, most: int = 5000) -> tuple[tuple, float, list[float]]:
    """(sites from 0, peptide score, a score for each site) of the placement of n_sites modifications that fits best.

    A placement's score is the weighted mean over depths d of the binomial score of its ions matched among each window's d best peaks, at the
    chance d / 100. A site's score compares the best placement with the best one without that site, at the depth where their scores differ
    most, by the ions that only one of the two has; 1000 if there is no other placement."""
    at = [i for i, c in enumerate(peptide) if c in residues]
    if len(at) < n_sites or n_sites < 1:
        return (), 0.0, []
    if len(every := list(combinations(at, n_sites))) > most:
        raise ValueError(f"{len(every)} placements in {peptide}; at most {most}")
    order = np.argsort(mz, kind="stable")
    mz, high = mz[order], high[order]
    depth = _by_depth(mz, high)
    ions = {s: _ions(peptide, s, mass) for s in every}
    peaks = {d: mz[depth <= d] for d in range(1, 11)}
    score = {s: [binomial_tail(_matched(list(x.values()), peaks[d], tolerance), len(x), d / 100) for d in range(1, 11)] for s, x in ions.items()}
    mean = {s: float(np.dot(v, DEPTH_WEIGHTS) / len(DEPTH_WEIGHTS)) for s, v in score.items()}
    best = max(every, key=lambda s: (mean[s], [-i for i in s]))
    out = []
    for site in best:
        others = [s for s in every if site not in s]
        if not others:
            out.append(1000.0)
            continue
        second = max(others, key=lambda s: (mean[s], [-i for i in s]))
        d = int(np.argmax(np.subtract(score[best], score[second]))) + 1
        a, b = ions[best], ions[second]
        own = [k for k in a if abs(a[k] - b[k]) > 1e-9]
        one = [binomial_tail(_matched([x[k] for k in own], peaks[d], tolerance), len(own), d / 100) for x in (a, b)]
        out.append(one[0] - one[1])
    return best, mean[best], out


def ascore(peaks: DataFrame, psms: DataFrame, tolerance: float = 0.05, mass: float = 79.966331, residues: str = "STY") -> DataFrame:
    """psms (spectrum_id, peptide, n_sites) with sites (array of places from 1), score, site_scores: see site_scores(). A spectrum is one task's work."""

    def run(k: tuple, p: pd.DataFrame, q: pd.DataFrame) -> pd.DataFrame:
        rows = []
        for r in q.itertuples():
            ok = set(r.peptide) <= set(ch.RESIDUES)
            best, score, sites = site_scores(r.peptide, int(r.n_sites), p["mz"].to_numpy(float), p["intensity"].to_numpy(float), tolerance, mass, residues) if ok else ((), 0.0, [])
            rows.append((k[0], r.peptide, int(r.n_sites), [i + 1 for i in best], score, sites))
        return pd.DataFrame(rows, columns=["spectrum_id", "peptide", "n_sites", "sites", "score", "site_scores"])

    kind = dict(psms.dtypes)["spectrum_id"]
    left, right = peaks.select("spectrum_id", "mz", "intensity").groupBy("spectrum_id"), psms.select("spectrum_id", "peptide", "n_sites").groupBy("spectrum_id")
    return left.cogroup(right).applyInPandas(run, f"spectrum_id {kind}, peptide string, n_sites int, sites array<int>, score double, site_scores array<double>")
