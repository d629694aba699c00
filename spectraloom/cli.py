"""Command-line tools over files: ``python -m spectraloom TOOL input .. output``.

Each reads mzML (or a table), applies one operator and writes mzML or a table; all of it is one Spark job on the session's cluster.
"""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators import assembly, filters, runs, signal
from .sources import feature_tables, file_types, formats

_META = ["native_id", "ms_level", "rt", "centroid", "polarity", "precursor_mz", "charge"]


def load(spark: SparkSession, path: str) -> DataFrame:
    """Spectra with run_id (the file's name without its endings) and spectrum_id, from mzML or mzXML."""
    kind = spark.range(1).select(file_types.kind_by_name(F.lit(path))).first()[0]
    df = feature_tables.read_mzxml(spark, path) if kind == "mzXML" else formats.read_mzml(spark, path)
    for c, t in (("native_id", "string"), ("ms_level", "int"), ("rt", "double"), ("centroid", "boolean"), ("polarity", "int"), ("precursor_mz", "double"), ("charge", "int")):
        if c not in df.columns:
            df = df.withColumn(c, F.col("scan").cast(t) if c == "native_id" and "scan" in df.columns else F.lit(None).cast(t))
    name = path.rstrip("/").rsplit("/", 1)[-1].split(".")[0] or "run"
    return df.select(F.lit(name).alias("run_id"), F.col("native_id").alias("spectrum_id"), *_META, "peaks")


def peaks_of(spectra: DataFrame) -> DataFrame:
    return spectra.select("run_id", "spectrum_id", "ms_level", "rt", F.posexplode("peaks").alias("peak_id", "_p")).select("run_id", "spectrum_id", "ms_level", "rt", F.col("peak_id").cast("long").alias("peak_id"), "_p.mz", F.col("_p.intensity").cast("double").alias("intensity"))


def with_peaks(spectra: DataFrame, peaks: DataFrame) -> DataFrame:
    """spectra with these peaks instead of their own; those that have none left keep an empty array."""
    new = peaks.groupBy("run_id", "spectrum_id").agg(F.sort_array(F.collect_list(F.struct("mz", F.col("intensity").cast("float").alias("intensity")))).alias("_new"))
    empty = F.array().cast("array<struct<mz:double,intensity:float>>")
    return spectra.join(new, ["run_id", "spectrum_id"], "left").withColumn("peaks", F.coalesce("_new", empty)).drop("_new")


def _filter(use):
    def run(spark, a):
        spectra = load(spark, a.input)
        formats.write_mzml(with_peaks(spectra, use(peaks_of(spectra), a)), a.output)

    return run


def _table(df: DataFrame, path: str) -> None:
    flat = df.select(*[F.to_json(c).alias(c) if t.startswith(("array", "struct", "map")) else F.col(c) for c, t in df.dtypes])
    flat.write.option("header", True).option("sep", "\t").csv(path)


def file_info(spark, a):
    df = runs.run_info(peaks_of(load(spark, a.input))).orderBy("run_id", "ms_level")
    if a.output:
        _table(df, a.output)
    else:
        df.show(1000, False)


def split(spark, a):
    spectra = load(spark, a.input)
    part = runs.split_parts(spectra.select("run_id", "spectrum_id", "rt"), a.parts)
    named = spectra.join(part, ["run_id", "spectrum_id"]).withColumn("run_id", F.concat("run_id", F.lit("_part"), F.col("part").cast("string"))).drop("part")
    formats.write_mzml(named, a.output)


def extract_dta(spark, a):
    """Spectra of the level and ranges, as one DTA file each in folders ``spectrum=..``."""
    s = load(spark, a.input).filter(F.col("ms_level").isin(*[int(x) for x in a.levels.split(",")]))
    for c, r in (("rt", a.rt), ("precursor_mz", a.mz)):
        if r:
            s = s.filter(F.col(c).between(*[float(x) for x in r.split(":")]))
    z = F.coalesce("charge", F.lit(0))
    mh = F.when(z > 0, (F.coalesce("precursor_mz", F.lit(0.0)) - 1.007276466) * z + 1.007276466).otherwise(F.coalesce("precursor_mz", F.lit(0.0)))
    lines = F.concat(F.array(F.concat_ws(" ", mh.cast("string"), z.cast("string"))), F.transform("peaks", lambda p: F.concat_ws(" ", p["mz"].cast("string"), p["intensity"].cast("string"))))
    s.select(F.regexp_replace("spectrum_id", "[^A-Za-z0-9]+", "_").alias("spectrum"), F.array_join(lines, "\n").alias("value")).repartition("spectrum").write.partitionBy("spectrum").text(a.output)


def diff(spark, a):
    read = lambda p: spark.read.parquet(p) if p.rstrip("/").endswith(".parquet") else spark.read.option("header", True).option("sep", "\t").csv(p)
    out = runs.fuzzy_diff(read(a.input), read(a.second), tuple(a.key.split(",")), tuple(a.values.split(",")), a.ratio, a.difference)
    n = out.count()
    out.show(20, False)
    print(f"{n} differences")
    return int(n > 0)


def find_features(spark, a):
    traces = signal.mass_traces(peaks_of(load(spark, a.input)).filter("ms_level = 1"), a.ppm, a.gaps, a.shortest)
    named = traces.withColumn("trace", F.xxhash64("run_id", "band", "part"))
    _table(assembly.assemble_features(named, tuple(int(z) for z in a.charges.split(",")), a.tolerance), a.output)


TOOLS = {
    "file-info": (file_info, "figures of each run and level", [("--output", {"default": None})]),
    "map-normalizer": (_filter(lambda p, a: runs.normalize_map(p, a.level)), "intensities as percent of the run's largest", [("output", {}), ("--level", {"type": int, "default": 1})]),
    "baseline-filter": (_filter(lambda p, a: filters.top_hat(p, a.half, ("run_id", "spectrum_id"))), "top-hat baseline correction", [("output", {}), ("--half", {"type": int, "default": 3})]),
    "peak-picker": (_filter(lambda p, a: filters.pick_peaks(p, ("run_id", "spectrum_id"))), "profile to centroids", [("output", {})]),
    "window-mower": (_filter(lambda p, a: filters.window_mower(p, a.size, a.n, a.move, ("run_id", "spectrum_id"))), "the most intense peaks of windows", [("output", {}), ("--size", {"type": float, "default": 50.0}), ("-n", {"type": int, "default": 2}), ("--move", {"choices": ["slide", "jump"], "default": "slide"})]),
    "mzml-splitter": (split, "one file for each part of a run", [("output", {}), ("--parts", {"type": int, "default": 2})]),
    "dta-extractor": (extract_dta, "spectra as DTA files", [("output", {}), ("--levels", {"default": "1,2,3"}), ("--rt", {"default": ""}), ("--mz", {"default": ""})]),
    "fuzzy-diff": (diff, "differences of two tables, beyond bounds", [("second", {}), ("--key", {"required": True}), ("--values", {"required": True}), ("--ratio", {"type": float, "default": 1.0}), ("--difference", {"type": float, "default": 0.0})]),
    "feature-finder": (find_features, "features of mass traces", [("output", {}), ("--ppm", {"type": float, "default": 20.0}), ("--gaps", {"type": int, "default": 1}), ("--shortest", {"type": int, "default": 3}), ("--charges", {"default": "1,2,3"}), ("--tolerance", {"type": float, "default": 0.02})]),
}


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    top = argparse.ArgumentParser(prog="spectraloom", description=__doc__.splitlines()[0])
    tools = top.add_subparsers(dest="tool", required=True)
    for name, (_, about, args) in TOOLS.items():
        p = tools.add_parser(name, help=about)
        p.add_argument("input")
        for flag, kw in args:
            p.add_argument(flag, **kw)
    a = top.parse_args(argv)
    return TOOLS[a.tool][0](spark or SparkSession.builder.appName(f"spectraloom {a.tool}").getOrCreate(), a) or 0


if __name__ == "__main__":
    sys.exit(main())
