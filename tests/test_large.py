"""What must not grow with the square of the rows: links, searches, frames without an end."""

import itertools
import math
import random

import numpy as np
import pytest

from spectraloom.operators import assignments as asg
from spectraloom.operators import clustering as cl
from spectraloom.operators import mapping as mp


def _plan(df):
    return df._jdf.queryExecution().toString().lower()


@pytest.fixture
def linked(monkeypatch):
    """Numbers of links that connected() is given."""
    seen, own = [], cl.connected

    def count(nodes, edges):
        seen.append(edges.count())
        return own(nodes, edges)

    monkeypatch.setattr(cl, "connected", count)
    return seen


def test_alike_spectra_are_linked_by_few(spark, linked):
    peaks = spark.createDataFrame([(s, 100.0 * k + 1, 5.0 + (s > 300) * k * k * k) for s in range(400) for k in range(6)], "spectrum_id long, mz double, intensity double")
    pre = spark.createDataFrame([(s, 500.0 + s % 3) for s in range(400)], "spectrum_id long, precursor_mz double")
    got = {r.spectrum_id: r.cluster for r in cl.cluster_spectra(peaks, pre, 5.0, 10.0, 0.9).collect()}
    assert got == {s: 0 if s <= 300 else 301 for s in range(400)}
    assert linked[0] < 2 * 400
    pairs = cl.similar_spectra(peaks, pre, 1.0, 10.0, 0.9).collect()
    want = {(a, b) for a, b in itertools.combinations(range(400), 2) if (a > 300) == (b > 300) and abs(a % 3 - b % 3) <= 1}
    assert len(pairs) == len(want) and {(r.a, r.b) for r in pairs} == want


def test_spectra_in_several_blocks(spark, monkeypatch):
    monkeypatch.setattr(cl, "_BLOCK", 7)
    monkeypatch.setattr(cl, "_BINS", 3)
    rng = random.Random(2)
    x = {s: [rng.random() for _ in range(8)] for s in range(60)}
    at = {s: rng.uniform(-20, 60) for s in x}
    peaks = spark.createDataFrame([(s, 10.0 * k, v) for s, row in x.items() for k, v in enumerate(row)], "spectrum_id long, mz double, intensity double")
    got = {(r.a, r.b): r.cosine for r in cl.similar_spectra(peaks, spark.createDataFrame(list(at.items()), "spectrum_id long, precursor_mz double"), 10.0, 10.0, 0.8).collect()}
    cos = lambda a, b: float(np.dot(x[a], x[b]) / np.linalg.norm(x[a]) / np.linalg.norm(x[b]))
    want = {(a, b): cos(a, b) for a, b in itertools.combinations(x, 2) if abs(at[a] - at[b]) <= 10 and cos(a, b) >= 0.8}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-12 for k in got)


def test_dense_points_are_linked_by_few(spark, linked):
    rng = random.Random(5)
    rows = [(i, rng.uniform(-3, 3), rng.uniform(-30, 30)) for i in range(700)] + [(1000 + i, 50.0, 8.0 * i) for i in range(40)]
    df = spark.createDataFrame(rows, "id long, x double, y double")
    near = {(a[0], b[0]) for a, b in itertools.combinations(rows, 2) if math.sqrt(((a[1] - b[1]) / 0.5) ** 2 + ((a[2] - b[2]) / 10.0) ** 2) <= 1}
    pairs = cl.near_points(df, 0.5, 10.0).collect()
    assert len(pairs) == len(near) and {(r.a, r.b) for r in pairs} == near
    root = {r[0]: r[0] for r in rows}
    for _ in range(len(rows)):
        moved = [(max(root[a], root[b]), min(root[a], root[b])) for a, b in near if root[a] != root[b]]
        if not moved:
            break
        for high, low in moved:
            root = {k: low if v == high else v for k, v in root.items()}
    assert {r.id: r.cluster for r in cl.grid_clusters(df, 0.5, 10.0).collect()} == root
    assert linked[0] < len(rows) < len(near)


def test_interpolation_has_no_frame_to_the_end(spark):
    rng = np.random.default_rng(1)
    anchors = sorted((float(x), float(x * 2 + rng.random())) for x in rng.choice(1000, 40, replace=False))
    points = [(0, i, float(x)) for i, x in enumerate(rng.integers(-50, 1050, 3000))] + [(1, -1, 7.0)]
    df = mp.interpolate_times(spark.createDataFrame(points, "map_id int, feature_id int, rt double"), spark.createDataFrame([(0, *a) for a in anchors], "map_id int, x double, y double"))
    assert "unboundedfollowing" not in _plan(df)
    x, y = np.array(anchors).T
    for r in df.collect():
        want = r.rt if r.map_id else np.interp(r.rt, x, y) if x[0] <= r.rt < x[-1] else r.rt + ((y - x)[0] if r.rt < x[0] else (y - x)[-1])
        assert abs(r.aligned - want) < 1e-9


def test_equal_masses_are_searched_once(spark):
    df = spark.createDataFrame([(i, 15.0 if i % 2 else 11.0) for i in range(200)], "id long, mass double")
    found = asg.compositions(df, {"A": 3.0, "B": 5.0}, 0.2)
    assert "groupby" in _plan(found).replace("deduplicate", "groupby") or "aggregate [mass" in _plan(found)
    want = {11.0: {"B1 A2"}, 15.0: {"A5", "B3"}}
    got = {}
    for r in found.collect():
        got.setdefault(r.id, set()).add(r.composition)
    assert got == {i: want[15.0 if i % 2 else 11.0] for i in range(200)}


def test_few_records_are_objects_at_a_time(spark, tmp_path):
    from spectraloom.sources import formats as fm

    made = list(fm._batches(((i, "x" * 1000) for i in range(5000)), lambda r: len(r[1]), ["i", "s"], [fm.pa.int64(), fm.pa.string()]))
    assert max(b.num_rows for b in made) < 1100 and [i for b in made for i in b.column(0).to_pylist()] == list(range(5000))
    path = str(tmp_path / "mgf")
    df = spark.range(300).selectExpr("'s' || id AS title", "500.5D AS precursor_mz", "2 AS charge", "id * 1.0D AS rt", "transform(sequence(1, 400), k -> struct(k * 1.5D AS mz, cast(k AS float) AS intensity)) AS peaks")
    fm.write_mgf(df.coalesce(1), path)
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(1 << 30))
    got = fm.read_mgf(spark, path)
    assert got.count() == 300 and int(spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch")) <= 4 << 20
    assert {(r.title, len(r.peaks)) for r in got.collect()} == {(f"s{i}", 400) for i in range(300)}


def test_nearest_are_found_within_tasks(spark):
    from spectraloom.operators import joins as jo

    rng = random.Random(8)
    make = lambda n, k: [(k + i, round(rng.uniform(0, 40), 1), float(rng.randint(0, 60)), rng.randint(1, 2)) for i in range(n)]
    a, b = make(150, 0), make(170, 1000)
    left, right = (spark.createDataFrame(x, "feature_id long, mz double, rt double, charge int") for x in (a, b))
    near = [(x, y) for x in a for y in b if x[3] == y[3] and y[1] - 1.0 <= x[1] <= y[1] + 1.0 and abs(x[2] - y[2]) <= 10.0]

    def both(d):
        of = {}
        for x, y in near:
            of.setdefault(x[0], []).append((d(x, y), y[0]))
            of.setdefault(y[0], []).append((d(x, y), x[0]))
        return {k: sorted(v) for k, v in of.items()}

    of = both(lambda x, y: (abs(x[1] - y[1]) / 1.0) * (abs(x[1] - y[1]) / 1.0) + (abs(x[2] - y[2]) / 10.0) * (abs(x[2] - y[2]) / 10.0))
    links = jo.link_features(left, right, 1.0, 10.0)
    assert " join " not in _plan(links)
    assert {(r.a_id, r.b_id) for r in links.collect()} == {(k, v[0][1]) for k, v in of.items() if k < 1000 and of[v[0][1]][0][1] == k}
    of = both(lambda x, y: (abs(x[1] - y[1]) / 1.0 + abs(x[2] - y[2]) / 10.0) / 2)
    second = lambda v: v[1][0] if len(v) > 1 else 1.0
    want = {(k, v[0][1]) for k, v in of.items() if k < 1000 and of[v[0][1]][0][1] == k and 2 * v[0][0] <= second(v) and 2 * v[0][0] <= second(of[v[0][1]])}
    stable = mp.stable_pairs(left, right, 1.0, 10.0)
    assert " join " not in _plan(stable) and {(r.a_id, r.b_id) for r in stable.collect()} == want
    first = {}
    for x in a:
        c = [(abs(x[1] - y[1]), abs(x[2] - y[2]), y[0]) for y in b if y[1] - 1.0 <= x[1] <= y[1] + 1.0 and abs(x[2] - y[2]) <= 10.0]
        if c:
            first[x[0]] = min(c)[2]
    found = mp.spectra_of_features(left.selectExpr("feature_id AS spectrum_id", "mz AS precursor_mz", "rt"), right, 1.0, 10.0)
    assert " join " not in _plan(found) and {r.spectrum_id: r.feature_id for r in found.collect()} == first


def test_gaps_are_not_shuffled(spark):
    from spectraloom.functions import chemistry as ch
    from spectraloom.functions import peptides as pe

    at = [100.0]
    for r in "GAL":
        at.append(at[-1] + ch.RESIDUES[r])
    df = spark.createDataFrame([(s, i, mz) for s in (1, 2) for i, mz in enumerate(at)] + [(3, 0, 5.0)], "spectrum_id long, peak_id long, mz double")
    tags = pe.sequence_tags(df)
    assert " join " not in _plan(tags)
    assert sorted((r.spectrum_id, r.tag, r.first_mz) for r in tags.collect()) == [(1, "GAL", 100.0), (2, "GAL", 100.0)]


def test_targets_of_one_mz_are_summed_once(spark):
    from spectraloom.operators import joins as jo

    peaks = spark.createDataFrame([(0, 1.0, 100.0, 5.0), (0, 1.0, 100.05, 6.0), (0, 2.0, 300.0, 7.0)], "run_id int, rt double, mz double, intensity double")
    named = [(k, 100.0) for k in range(50)] + [(50, 100.0), (50, 300.0), (51, 300.0)]
    out = jo.extract_chromatograms(peaks, spark.createDataFrame(named, "target int, target_mz double"))
    got = {(r.target, r.rt): (r.intensity, r.n) for r in out.collect()}
    assert got == {(k, 1.0): (11.0, 2) for k in range(51)} | {(50, 2.0): (7.0, 1), (51, 2.0): (7.0, 1)}
    assert "aggregate [target_mz" in _plan(out)


def test_dense_features_are_grouped_in_blocks(spark, monkeypatch):
    from spectraloom.operators import runs as rn

    rng = random.Random(4)
    rows = [(rng.randint(0, 3), i, 1 + i % 2, round(rng.uniform(0, 12), 2), float(rng.randint(0, 60))) for i in range(700)]
    rows += [(m, 1000 + 10 * k + m, 1, 5.0, 7.0) for m in range(4) for k in range(3)]

    def by_hand(own):
        left, out = sorted(own, key=lambda r: r[1]), []
        while left:
            best = None
            for r in left:
                nearest: dict = {}
                for x in left:
                    d = (abs(x[3] - r[3]) / 0.1 + abs(x[4] - r[4]) / 10.0) / 2
                    if x[0] != r[0] and r[3] - 0.1 <= x[3] <= r[3] + 0.1 and abs(x[4] - r[4]) <= 10.0:
                        nearest[x[0]] = min(nearest.get(x[0], (9, 0, x)), (d, x[1], x))
                quality = sum(1 - v[0] for v in sorted(nearest.values())) / 3
                if best is None or quality > best[0]:
                    best = (quality, r, [v[2] for v in nearest.values()])
            members = [best[1], *best[2]]
            out += [(best[1][1], x[0], x[1], round(best[0], 9)) for x in members]
            left = [x for x in left if x not in members]
        return out

    want = sorted(x for z in (1, 2) for x in by_hand([r for r in rows if r[2] == z]))
    df = spark.createDataFrame(rows, "map_id long, feature_id long, charge int, mz double, rt double")
    for block, rounds in ((8, 0), (64, 5), (16, 5), (8, 2)):
        monkeypatch.setattr(rn, "_GROUP_BLOCK", block, raising=False)
        monkeypatch.setattr(rn, "_GROUP_ROUNDS", rounds, raising=False)
        made = rn.group_features(df, 0.1, 10.0)
        assert " window " not in _plan(made)  # bands between gaps were told by running values; a dense map has no gaps
        assert sorted((r.group, r.map_id, r.feature_id, round(r.quality, 9)) for r in made.collect()) == want, (block, rounds)


def test_few_bytes_are_many_tasks(spark):
    from spectraloom.operators import scoring as sc
    from spectraloom.sources import tables as tb

    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    assert tb.sequences(spark, "/root/testdata/sf0.001").rdd.getNumPartitions() == n
    one = lambda df: df.coalesce(1)
    peptides = one(spark.createDataFrame([("GAGA",), ("GAGAK",)], "peptide string"))
    pre = one(spark.range(100).selectExpr("id AS spectrum_id", "id * 1.0D AS precursor_mass"))
    for df in (sc.candidates(peptides, pre, 0.5), asg.cross_link_candidates(peptides, pre, 138.0, 0.5)):
        assert "repartition" in _plan(df)


def test_isotopes_are_summed_within_spectra(spark):
    from spectraloom.operators import assays as ay

    rng = random.Random(9)
    peaks = [(s, i, round(rng.uniform(100, 108), 2), rng.choice([None, 1.0, 5.5, 20.0])) for s in range(5) for i in range(30)]
    ions = [(s, i, round(rng.uniform(95, 110), 2)) for s in range(6) for i in range(25)] + [(1, 99, None)]
    df = ay.isotope_scores(spark.createDataFrame(peaks, "spectrum_id long, peak_id long, mz double, intensity double"), spark.createDataFrame(ions, "spectrum_id long, ion_id long, ion_mz double"), 0.2, 2)
    assert " join " not in _plan(df)
    want = {}
    for s, i, mz in ions:
        near = [p[3] or 0.0 for p in peaks for k in range(4) if mz and p[0] == s and mz + k * ay.ISOTOPE / 2 - 0.2 <= p[2] <= mz + k * ay.ISOTOPE / 2 + 0.2]
        if near:
            want[s, i] = sum(near)
    got = {(r.spectrum_id, r.ion_id): r.total for r in df.collect()}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-9 for k in want)


def test_references_of_one_mz_are_looked_up_once(spark):
    from spectraloom.operators import assays as ay

    peaks = spark.createDataFrame([(0, 100.001, 5.0), (0, 100.003, 5.0), (1, 300.0, 1.0)], "run_id int, mz double, intensity double")
    refs = spark.createDataFrame([(k, 100.0) for k in range(40)] + [(40, 300.0), (40, 100.0), (7, 100.0)], "reference int, reference_mz double")
    out = ay.mass_errors(peaks, refs, 50.0)
    assert {(r.run_id, r.reference, r.reference_mz, round(r.error, 6), r.n) for r in out.collect()} == {(0, k, 100.0, 20.0, 4 if k == 7 else 2) for k in range(41)} | {(1, 40, 300.0, 0.0, 1)}
    assert "aggregate [run_id" in _plan(out) and "reference_mz" in _plan(out).split("aggregate [run_id")[1].split("]")[0] and "reference#" not in _plan(out).split("aggregate [run_id")[1].split("]")[0]


def test_ranks_need_no_windows(spark):
    data = [(1, 1.0, 2.0), (1, 1.0, 3.0), (2, 5.0, 5.0)] + [(3, v, w) for v, w in ((None, 4.0), (None, 1.0), (2.0, 2.0), (2.0, float("nan")), (7.0, 3.0))]
    df = asg.rank_correlation(spark.createDataFrame(data, "k int, x double, y double"), ("k",))
    assert " window " not in _plan(df)
    got = {r.k: r.spearman for r in df.collect()}
    want = np.corrcoef([1.5, 1.5, 3.5, 3.5, 5], [4, 1, 2, 5, 3])[0, 1]
    assert got.keys() == {1, 2, 3} and got[1] is None and got[2] is None and abs(got[3] - want) < 1e-12


def test_ions_find_their_peak_within_spectra(spark):
    from spectraloom.functions import chemistry as ch
    from spectraloom.operators import scoring as sc

    rng = random.Random(3)
    psms = [(s, p) for s in range(4) for p in ("GAGA", "AGK", "LLR")] + [(9, "GAGA")]
    ions = [tuple(r) for r in ch.fragment_ions(spark.createDataFrame([(p,) for p in ("GAGA", "AGK", "LLR")], "peptide string")).select("peptide", "ion", "position", "mz").collect()]
    peaks = [(s, i, round(rng.choice(ions)[3] + rng.choice([-0.5, -0.25, 0.0, 0.25, 0.25, 0.75]), 3), float(rng.randint(1, 3))) for s in range(5) for i in range(40)]
    df = sc.match_ions(spark.createDataFrame(peaks, "spectrum_id long, peak_id long, mz double, intensity double"), spark.createDataFrame(psms, "spectrum_id long, peptide string"), 0.3)
    want = set()
    for s, p in psms:
        for q, ion, position, mz in ions:
            near = [(abs(k[2] - mz), k[2], -k[3], k[1]) for k in peaks if k[0] == s and q == p and mz - 0.3 <= k[2] <= mz + 0.3]
            if near:
                e, _, y, k = min(near)
                want.add((s, p, ion, position, -y, e, k))
    assert {tuple(r) for r in df.select("spectrum_id", "peptide", "ion", "position", "intensity", "error", "peak_id").collect()} == want
    assert " window " not in _plan(df)
