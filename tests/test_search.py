import random

import numpy as np

from spectraloom.functions import chemistry as ch
from spectraloom.operators.search import _ions, ascore, simple_search, site_scores


def spectrum(rng, peptide, sites=(), mass=0.0, noise=40, keep=0.85):
    rows = [(m + rng.gauss(0, 0.003), float(rng.randint(50, 100))) for m in _ions(peptide, tuple(sites), mass).values() if rng.random() < keep]
    return rows + [(rng.uniform(100, 1500), float(rng.randint(1, 40))) for _ in range(noise)]


def test_ions_as_columns(spark):
    df = spark.createDataFrame([("PEPTIDEK",)], "peptide string")
    want = {(r.ion, r.position): r.mz for r in ch.fragment_ions(df).collect()}
    got = _ions("PEPTIDEK", (), 0.0)
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-9 for k in want)


def test_search_finds_what_was_measured(spark):
    rng = random.Random(4)
    proteins = [(f"P{i}", "M" + "".join("".join(rng.choice("ADEFGHILMNPQSTVWY") for _ in range(rng.randint(7, 14))) + rng.choice("KR") for _ in range(6))) for i in range(30)]
    pro = spark.createDataFrame(proteins, "accession string, sequence string")
    peptides = [r.peptide for r in ch.digest(pro, 0, 8, 20).select("peptide").distinct().orderBy("peptide").collect()][:40]
    peaks, precursors = [], []
    for i, p in enumerate(peptides):
        peaks += [(i, k, m, h) for k, (m, h) in enumerate(spectrum(rng, p))]
        precursors.append((i, sum(ch.RESIDUES[c] for c in p) + ch.WATER + rng.gauss(0, 0.004)))
    got = simple_search(spark.createDataFrame(peaks, "spectrum_id int, peak_id long, mz double, intensity double"), spark.createDataFrame(precursors, "spectrum_id int, precursor_mass double"), pro).collect()
    found = {r.spectrum_id: r for r in got if r["rank"] == 1}
    assert sum(found[i].peptide == p for i, p in enumerate(peptides) if i in found) >= 38
    assert all(r.accessions for r in found.values() if not r.decoy) and all(r.q_value is not None for r in found.values())


def test_sites(spark):
    rng = random.Random(6)
    rows, psms, want = [], [], {}
    for i, (peptide, sites) in enumerate([("ASAAATAAAYK", (1,)), ("ASAAATAAAYK", (5,)), ("ASAAATAAAYK", (1, 9)), ("GGSGGGK", (2,))]):
        rows += [(i, m, h) for m, h in spectrum(rng, peptide, sites, 79.966331, keep=1.0)]
        psms.append((i, peptide, len(sites)))
        want[i] = [s + 1 for s in sites]
    psms += [(9, "GGGK", 1), (0, "ASBXK", 1)]
    got = {(r.spectrum_id, r.peptide): r for r in ascore(spark.createDataFrame(rows, "spectrum_id int, mz double, intensity double"), spark.createDataFrame(psms, "spectrum_id int, peptide string, n_sites int")).collect()}
    for i, p, n in psms[:4]:
        r = got[i, p]
        assert r.sites == want[i] and min(r.site_scores) > 15, r
    assert got[3, "GGSGGGK"].site_scores == [1000.0]
    assert got[9, "GGGK"].sites == [] and got[0, "ASBXK"].sites == []


def test_a_site_between_two_is_open():
    # no ion between the two serines is seen: both places fit alike
    ions = _ions("AASSAAK", (2,), 79.966331)
    mz = np.array([m for (s, k), m in ions.items() if (s, k) not in (("b", 3), ("y", 4))])
    _, _, scores = site_scores("AASSAAK", 1, mz, np.ones(len(mz)), 0.02, 79.966331, "STY")
    assert scores == [0.0]
