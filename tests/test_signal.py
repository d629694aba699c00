import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from spectraloom.operators import signal as sg


def _peaks(spark, y, x=None):
    return spark.createDataFrame([(1, i, float(i if x is None else x[i]), float(v)) for i, v in enumerate(y)], "spectrum_id long, peak_id long, mz double, intensity double")


def test_polynomials_stay(spark):
    x = np.arange(30)
    y = 5 + x + 0.3 * x**2
    got = [r.intensity for r in sg.savitzky_golay(_peaks(spark, y), 7, 2).orderBy("mz").collect()]
    assert np.allclose(got, y)
    assert [r.intensity for r in sg.savitzky_golay(_peaks(spark, [1, 5, 2]), 7, 2).orderBy("mz").collect()] == [1, 5, 2]


def test_gaussian_keeps_a_constant(spark):
    rng = np.random.default_rng(1)
    got = [r.intensity for r in sg.gaussian_integral(_peaks(spark, np.full(40, 7.0), np.cumsum(rng.random(40) * 0.3)), 4.0).orderBy("mz").collect()]
    assert np.allclose(got, 7.0)
    assert [r.intensity for r in sg.gaussian_integral(_peaks(spark, [1, 2, 3], [0, 100, 200]), 1.0).orderBy("mz").collect()] == [1, 2, 3]


def test_window_mower_jump_as_brute_force(spark):
    import random

    from spectraloom.operators.filters import window_mower

    rng = random.Random(7)
    rows = [(s, i, round(rng.random() * 300, 2), float(rng.randint(1, 50))) for s in range(8) for i in range(rng.choice([0, 1, 2, 40, 90]))]
    df = spark.createDataFrame(rows, "spectrum_id int, peak_id int, mz double, intensity double")
    want = set()
    for s in range(8):
        own = sorted((r for r in rows if r[0] == s), key=lambda r: (r[2], r[1]))
        at = 0
        while at < len(own):
            inside = [r for r in own[at:] if r[2] - own[at][2] < 50]
            n = 3 if at + len(inside) < len(own) else int((inside[-1][2] - inside[0][2]) / 50 * 3 + 0.5)
            want |= {r[:2] for r in sorted(inside, key=lambda r: (-r[3], r[2], r[1]))[:n]}
            at += len(inside)
    assert {(r.spectrum_id, r.peak_id) for r in window_mower(df, 50.0, 3, "jump").collect()} == want


def test_a_gap_of_just_the_tolerance_is_no_cut(spark):
    low, high = 0.38144683837890625, 0.3814697265625
    assert high - low == high * 6e-5 > high * (60.0 * 1e-6)
    df = spark.createDataFrame([(0, 1, 1.0, 1, low, 5.0), (0, 2, 2.0, 2, high, 5.0)], "run_id int, spectrum_id int, rt double, peak_id int, mz double, intensity double")
    assert [r.n for r in sg.mass_traces(df, 60.0, 3, 2).collect()] == [2]


def test_integral_is_of_all_windows_at_once(spark, monkeypatch):
    """Against a loop over points, in several parts; y shifted by whole windows comes out the same."""
    rng = np.random.default_rng(6)
    x, y, sigma = np.sort(np.round(rng.random(300) * 90, 1)), rng.integers(-3, 90, 300).astype(float), 0.5
    want = []
    for i in range(300):
        t = np.flatnonzero((x > x[i] - 4 * sigma) & (x < x[i] + 4 * sigma))
        g, d = np.exp(-((x[t] - x[i]) ** 2) / (2 * sigma * sigma)), np.diff(x[t])
        area, total = (d * (g[1:] + g[:-1])).sum(), (d * (g[1:] * y[t][1:] + g[:-1] * y[t][:-1])).sum()
        want.append(total / area if len(t) > 1 and area > 0 and total > 0 else 0.0)
    for most in (1 << 19, 7):
        monkeypatch.setattr(sg, "_MOST", most)
        got = [r.intensity for r in sg.gaussian_integral(_peaks(spark, y, x), 4.0).orderBy("mz", "peak_id").collect()]
        assert np.allclose(got, want, rtol=1e-12, atol=1e-12)


def _most_read(spark, df):
    """Rows that one task of df's run reads from shuffles, at most."""
    sc = spark.sparkContext
    sc.setJobGroup("most_read", "")
    df.write.format("noop").mode("overwrite").save()
    sc._jsc.sc().listenerBus().waitUntilEmpty(30_000)
    store, track, most = sc._jsc.sc().statusStore(), sc.statusTracker(), 0
    for job in track.getJobIdsForGroup("most_read"):
        for stage in track.getJobInfo(job).stageIds:
            if track.getStageInfo(stage) is not None:
                tasks = store.taskList(stage, 0, 100_000)
                most = max([most, *[tasks.apply(i).taskMetrics().get().shuffleReadMetrics().recordsRead() for i in range(tasks.size()) if tasks.apply(i).taskMetrics().isDefined()]])
    sc.setJobGroup("other", "")
    return most


def test_no_task_of_traces_or_isotopes_has_a_whole_run(spark):
    """Totals of ranges of m/z were made in one task a run."""
    n = 60_000
    peaks = spark.range(n).select((F.col("id") % 2).alias("run_id"), (F.col("id") % 1000).alias("spectrum_id"), (F.col("id") % 1000).cast("double").alias("rt"), F.col("id").alias("peak_id"), (200 + F.floor(F.col("id") / 1000) * 0.5 + F.pmod(F.xxhash64("id"), 1000) * 1e-7).alias("mz"), F.lit(5.0).alias("intensity"))
    # two runs of 500 spectra with 60 peaks each, half a unit apart
    pairs = sg.group_isotopes(sg.mass_traces(peaks, 60.0, 3, 2), tolerance=0.01)
    assert pairs.groupBy("charge").count().orderBy("charge").collect() == [(1, 116), (2, 118)]
    assert _most_read(spark, pairs) < n / 3


def test_bands_of_odd_mz_as_brute_force(spark):
    rng = np.random.default_rng(4)
    odd = [None, float("nan"), float("inf"), 0.0, -1.0, -1.0, -250.5, 1e-300]
    some = [*np.round(rng.uniform(100, 101, 60), 3).tolist(), *np.round(rng.uniform(1000, 1002, 60), 3).tolist(), 500.0, 500.0]
    rows = [(run, i % 7, float(i % 7), i, mz, 5.0) for run, values in enumerate([some + odd, some, odd, [None, None], [float("inf"), 3.0, float("inf"), None]]) for i, mz in enumerate(values)]
    df = spark.createDataFrame(rows, "run_id int, spectrum_id int, rt double, peak_id int, mz double, intensity double")
    above = lambda a, b: not np.isnan(b) and (np.isnan(a) or a > b)
    for ppm in (60.0, 2000.0, 1e-6, 0.0):
        want = {}
        for run in range(5):
            own = sorted((r for r in rows if r[0] == run), key=lambda r: (r[4] is None, r[4] is not None and np.isnan(r[4]), 0.0 if r[4] is None or np.isnan(r[4]) else r[4], r[3]))
            band = 0
            for last, r in zip([None, *own], own):
                with np.errstate(invalid="ignore"):
                    band += bool(last and r[4] is not None and last[4] is not None and above(np.float64(r[4]) - last[4], np.float64(r[4]) * (ppm / 1e6)))
                want[run, r[3]] = band
        got = {(r.run_id, r.peak_id): r.band for r in sg._bands(df, ppm, ("run_id",)).collect()}
        assert got == want, ppm


def test_isotopes_as_brute_force(spark):
    rng = np.random.default_rng(9)
    rows = []
    for i in range(900):
        low, length = np.round(rng.uniform(0, 50), 1), np.round(rng.exponential(8), 1)
        mz = np.round(rng.uniform(-3, 12), 2) if i % 4 else rng.integers(0, 9) + 0.5
        rows.append((int(i % 2) if i % 50 else None, float(mz), float(np.round(low + length * rng.integers(0, 3) / 2, 2)), float(low), float(low + length)))
    rows += [(0, x, 1.0, 0.0, 2.0) for x in (None, float("nan"), float("inf"))] + [(0, 5.0, None, None, None)]
    df = spark.createDataFrame(rows, "run_id int, mz double, apex double, rt_low double, rt_high double")
    fit = [r for r in rows if r[0] is not None and r[1] is not None and np.isfinite(r[1]) and r[2] is not None]
    for charges, tolerance in (((1, 2, 3), 0.3), ((2,), 0.02), ((1, 4), 0.0)):
        want = sorted((a[0], z, a[1], b[1], b[2]) for a in fit for b in fit for z in charges if a[0] == b[0] and abs(b[1] - (a[1] + 1.00335483 / z)) <= tolerance and a[3] <= b[2] <= a[4] and b[3] <= a[2] <= b[4])
        assert sorted(map(tuple, sg.group_isotopes(df, charges, tolerance).collect())) == want
        assert want or not tolerance
    d = pd.DataFrame([(m, 0, *r[1:]) for r in fit if r[0] == 0 and 0 <= r[1] < 12 for m in (False, True)], columns=["_mono", "_block", "mz", "apex", "rt_low", "rt_high"])
    some = [sg._isotope_pairs(d, (1, 2, 3), 0.3, 12.0, 0.3 + 1e-6, (), most) for most in (1, 7, 1 << 19)]
    some = [x.sort_values(list(x.columns)).reset_index(drop=True) for x in some]
    assert len(some[0]) and some[0].equals(some[1]) and some[0].equals(some[2])
