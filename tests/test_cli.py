import glob

from pyspark.sql import functions as F

from spectraloom import cli
from spectraloom.sources import formats as fm


def one(spark, tmp_path):
    rows = []
    for i in range(6):
        peaks = [(100.0 + 10 * k, float((7 * k + i) % 23 + 1)) for k in range(30)]
        rows.append(("r", f"scan={i}", 1 + i % 2, float(i), True, 1, 500.25 if i % 2 else None, 2 if i % 2 else None, peaks))
    df = spark.createDataFrame(rows, "run_id string, native_id string, ms_level int, rt double, centroid boolean, polarity int, precursor_mz double, charge int, peaks array<struct<mz:double,intensity:float>>")
    fm.write_mzml(df, str(tmp_path / "in"))
    (path,) = glob.glob(str(tmp_path / "in" / "run=r" / "*.txt"))
    return path, df


def test_tools(spark, tmp_path, capsys):
    path, df = one(spark, tmp_path)
    back = fm.read_mzml(spark, path)
    assert {(r.native_id, len(r.peaks)) for r in back.collect()} == {(f"scan={i}", 30) for i in range(6)}
    run = lambda *a: cli.main(list(a), spark)
    read = lambda name: {r.native_id: r for r in fm.read_mzml(spark, f"{tmp_path}/{name}/*/*.txt").collect()}
    run("map-normalizer", path, f"{tmp_path}/norm")
    top = read("norm")
    assert max(p.intensity for k in (0, 2, 4) for p in top[f"scan={k}"].peaks) == 100.0 and top["scan=1"].precursor_mz == 500.25
    run("window-mower", path, f"{tmp_path}/mow", "--size", "100", "-n", "3", "--move", "jump")
    assert all(0 < len(r.peaks) <= 10 for r in read("mow").values())
    run("baseline-filter", path, f"{tmp_path}/base")
    run("peak-picker", path, f"{tmp_path}/picked")
    assert all(0 < len(r.peaks) < 30 for r in read("picked").values())
    run("mzml-splitter", path, f"{tmp_path}/parts", "--parts", "3")
    assert len(glob.glob(f"{tmp_path}/parts/run=*")) == 3 and len(read("parts")) == 6
    run("dta-extractor", path, f"{tmp_path}/dta", "--levels", "2", "--rt", "2:9")
    files = glob.glob(f"{tmp_path}/dta/spectrum=*/*.txt")
    assert len(files) == 2 and fm.read_dta(spark, files[0]).first().charge == 2
    assert abs(fm.read_dta(spark, files[0]).first().precursor_mz - 500.25) < 1e-6
    run("file-info", path)
    assert "n_spectra" in capsys.readouterr().out
    run("feature-finder", path, f"{tmp_path}/features", "--gaps", "3")
    t = spark.read.option("header", True).option("sep", "\t").csv(f"{tmp_path}/features")
    assert {"mz", "rt", "charge", "traces"} <= set(t.columns) and t.count() > 0


def test_diff(spark, tmp_path):
    a = spark.createDataFrame([(1, 2.0), (2, 3.0)], "k int, v double")
    a.write.parquet(str(tmp_path / "a.parquet"))
    a.withColumn("v", F.when(F.col("k") == 2, 3.001).otherwise(F.col("v"))).write.parquet(str(tmp_path / "b.parquet"))
    args = ["fuzzy-diff", str(tmp_path / "a.parquet"), str(tmp_path / "b.parquet"), "--key", "k", "--values", "v"]
    assert cli.main(args, spark) == 1 and cli.main([*args, "--difference", "0.01"], spark) == 0
