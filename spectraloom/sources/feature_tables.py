"""Text tables of features, windows, chromatograms and designs, and further XML peak files.

The text tables are split over tasks by Spark's text reader and parsed in the JVM: no Python touches their rows. Header and
comment lines are told from data by their content, as a split in the middle of a file doesn't see its head.
"""

from __future__ import annotations

import base64
import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .formats import _PEAK_TYPE, _PEAKS, _parsed, _records

PROTON = 1.007276466
_NUMBER = r"^\s*[-+]?(\d|\.\d|NA\b)"


def _real(c: Column) -> Column:
    """A number; empty cells and NA are null, anything else malformed is an error."""
    return F.when(~F.upper(F.trim(c)).isin("", "NA"), F.trim(c).cast("double"))


def read_edta(spark: SparkSession, path, sep: str = "\t") -> DataFrame:
    """(rt, mz, intensity, charge, elements): rows of numbers in fours, the first the consensus, the others its elements.

    Three columns alone have charge 0 and no elements. Lines that don't start with a number are headers."""
    rows = spark.read.text(path).filter(F.col("value").rlike(_NUMBER)).select(F.split(F.trim("value"), sep).alias("c"))
    at = lambda i: _real(F.get("c", F.lit(i) if isinstance(i, int) else i))
    count = F.greatest(F.floor(F.size("c") / 4).cast("int") - 1, F.lit(0))
    each = F.transform(F.sequence(F.lit(1), count), lambda k: F.struct(at(k * 4).alias("rt"), at(k * 4 + 1).alias("mz"), at(k * 4 + 2).alias("intensity"), at(k * 4 + 3).cast("int").alias("charge")))
    return rows.select(at(0).alias("rt"), at(1).alias("mz"), at(2).alias("intensity"), F.coalesce(at(3).cast("int"), F.lit(0)).alias("charge"), F.when(count > 0, each).otherwise(F.array().cast("array<struct<rt:double,mz:double,intensity:double,charge:int>>")).alias("elements"))


def write_edta(features: DataFrame, path: str) -> None:
    """The four consensus columns, with a header in each part file."""
    features.select("rt", "mz", "intensity", "charge").toDF("RT", "m/z", "Intensity", "charge").write.option("sep", "\t").option("header", True).csv(path)


def read_kroenik(spark: SparkSession, path) -> DataFrame:
    """(file, first_scan, last_scan, n_scans, charge, mass, mz, intensity, rt, rt_low, rt_high, quality, modifications).

    m/z is of the monoisotopic mass at the charge; intensity the summed one."""
    c = F.split("value", "\t")
    rows = spark.read.text(path).select(c.alias("c")).filter((F.size("c") >= 14) & F.trim(F.get("c", F.lit(1))).rlike(r"^\d+$"))
    at = lambda i: F.trim(F.get("c", F.lit(i)))
    charge, mass = at(4).cast("int"), at(5).cast("double")
    return rows.select(
        at(0).alias("file"), at(1).cast("long").alias("first_scan"), at(2).cast("long").alias("last_scan"), at(3).cast("long").alias("n_scans"), charge.alias("charge"), mass.alias("mass"),
        (mass / charge + PROTON).alias("mz"), at(8).cast("double").alias("intensity"), at(11).cast("double").alias("rt"), at(9).cast("double").alias("rt_low"), at(10).cast("double").alias("rt_high"),
        at(12).cast("double").alias("quality"), at(13).alias("modifications"),
    )


def read_ms_inspect(spark: SparkSession, path) -> DataFrame:
    """(rt, mz, accurate_mz, mass, intensity, charge, quality, background, median, scan_first, scan_last, description)."""
    c = F.split("value", "\t")
    rows = spark.read.text(path).filter(~F.col("value").startswith("#")).select(c.alias("c")).filter((F.size("c") >= 18) & F.trim(F.get("c", F.lit(1))).rlike(_NUMBER))
    at = lambda i: F.trim(F.get("c", F.lit(i)))
    return rows.select(
        at(1).cast("double").alias("rt"), at(2).cast("double").alias("mz"), at(3).alias("accurate_mz"), at(4).cast("double").alias("mass"), at(5).cast("double").alias("intensity"), at(6).cast("int").alias("charge"),
        at(8).cast("double").alias("quality"), at(9).cast("double").alias("background"), at(10).cast("double").alias("median"), at(12).cast("long").alias("scan_first"), at(13).cast("long").alias("scan_last"), at(17).alias("description"),
    )


def read_chromeleon(spark: SparkSession, path) -> DataFrame:
    """(file, rt, intensity): three-column rows of minutes, step and value; times in seconds. Commas of thousands are dropped."""
    rows = spark.read.text(path).select(F.input_file_name().alias("file"), F.split("value", "\t").alias("c")).filter((F.size("c") == 3) & F.trim(F.get("c", F.lit(0))).rlike(_NUMBER))
    at = lambda i: F.replace(F.trim(F.get("c", F.lit(i))), F.lit(","), F.lit("")).cast("double")
    return rows.select("file", (at(0) * 60).alias("rt"), at(2).alias("intensity"))


def read_isolation_windows(spark: SparkSession, path) -> DataFrame:
    """(low, high): rows of two numbers, lower bound first; a header is skipped. Rows out of order are errors."""
    rows = spark.read.text(path).filter(F.col("value").rlike(_NUMBER)).select(F.split(F.trim("value"), r"\s+").alias("c")).select(F.get("c", F.lit(0)).cast("double").alias("low"), F.get("c", F.lit(1)).cast("double").alias("high"))
    return rows.withColumn("high", F.when(F.col("low") < F.col("high"), F.col("high")).otherwise(F.raise_error(F.lit("a window's lower bound isn't below its upper bound")).cast("double")))


def read_design(spark: SparkSession, path) -> DataFrame:
    """One-table experimental designs: (fraction_group, fraction, path, label, sample) from tab-separated columns of these names."""
    df = spark.read.option("header", True).option("sep", "\t").option("comment", "#").csv(path)
    names = {c.strip().lower(): c for c in df.columns}
    lack = {"fraction_group", "fraction", "spectra_filepath"} - names.keys()
    if lack:
        raise ValueError(f"the design lacks {sorted(lack)}")
    col = lambda k, other: F.trim(F.col(names[k])) if k in names else F.lit(other)
    return df.select(col("fraction_group", None).cast("int").alias("fraction_group"), col("fraction", None).cast("int").alias("fraction"), col("spectra_filepath", None).alias("path"), col("label", "1").cast("int").alias("label"), col("sample", None).alias("sample"))


# ---------------------------------------------------------------- XML


def _seconds(text: str | None) -> float | None:
    m = re.fullmatch(r"PT(?:(\d+(?:\.\d+)?)H)?(?:(\d+(?:\.\d+)?)M)?(?:(\d+(?:\.\d+)?)S)?", text or "")
    return sum(float(x or 0) * k for x, k in zip(m.groups(), (3600, 60, 1))) if m else None


def _attr(xml: str, key: str) -> str | None:
    m = re.search(rf"\b{key}=\"([^\"]*)\"", xml)
    return m[1] if m else None


def _scan(record: str):
    start = record.rfind("<scan ")
    if start < 0:
        return None
    xml = record[start:]
    head = xml[: xml.index(">")]
    body = re.search(r"<peaks\b([^>]*)>([^<]*)<", xml, re.S)
    raw = base64.b64decode(body[2]) if body else b""
    if body and "zlib" in (_attr(body[1], "compressionType") or ""):
        raw = zlib.decompress(raw) if raw else b""
    values = np.frombuffer(raw, ">f8" if body and _attr(body[1], "precision") == "64" else ">f4").astype(float)
    mass = re.search(r"<precursorMz\b([^>]*)>([^<]*)<", xml)
    charge = _attr(mass[1], "precursorCharge") if mass else None
    polarity = {"+": 1, "-": -1}.get(_attr(head, "polarity") or "", 0)
    return int(_attr(head, "num") or 0), int(_attr(head, "msLevel") or 1), _seconds(_attr(head, "retentionTime")), polarity, float(mass[2]) if mass else None, int(charge) if charge else None, [{"mz": a, "intensity": b} for a, b in zip(values[0::2].tolist(), values[1::2].tolist())]


def read_mzxml(spark: SparkSession, path) -> DataFrame:
    """(scan, ms_level, rt, polarity, precursor_mz, charge, peaks) of mzXML: network order floats of 32 or 64 bits, plain or zlib.

    Records end with </peaks>, so that scans nested in their survey scans are rows of their own."""
    df = _records(spark, path, "</peaks>").withColumn("value", F.concat("value", F.lit("</peaks>")))
    kinds = [pa.int64(), pa.int32(), pa.float64(), pa.int32(), pa.float64(), pa.int32(), _PEAK_TYPE]
    return _parsed(df, _scan, f"scan long, ms_level int, rt double, polarity int, precursor_mz double, charge int, peaks {_PEAKS}", kinds)


def _consensus(record: str):
    start = record.rfind("<consensusElement ")
    if start < 0:
        return None
    xml = record[start:]
    head = xml[: xml.index(">")]
    centroid = re.search(r"<centroid\b[^>]*>", xml)
    number = lambda s, k: float(v) if s and (v := _attr(s, k)) else None
    items = [{"map": int(_attr(e, "map") or 0), "id": _attr(e, "id"), "rt": number(e, "rt"), "mz": number(e, "mz"), "intensity": number(e, "it"), "charge": int(_attr(e, "charge") or 0)} for e in re.findall(r"<element\b[^>]*>", xml)]
    c = centroid[0] if centroid else None
    return _attr(head, "id"), number(c, "rt"), number(c, "mz"), number(c, "it"), number(head, "quality"), int(_attr(head, "charge") or 0), items


def read_consensus_xml(spark: SparkSession, path) -> DataFrame:
    """(consensus_id, rt, mz, intensity, quality, charge, elements) with elements (map, id, rt, mz, intensity, charge)."""
    item = "array<struct<map:int,id:string,rt:double,mz:double,intensity:double,charge:int>>"
    kind = pa.list_(pa.struct([("map", pa.int32()), ("id", pa.string()), ("rt", pa.float64()), ("mz", pa.float64()), ("intensity", pa.float64()), ("charge", pa.int32())]))
    return _parsed(_records(spark, path, "</consensusElement>"), _consensus, f"consensus_id string, rt double, mz double, intensity double, quality double, charge int, elements {item}", [pa.string(), *[pa.float64()] * 4, pa.int32(), kind])


def _chromatogram(record: str):
    from .formats import _ARRAY, _terms

    start = record.rfind("<chromatogram ")
    if start < 0:
        return None
    xml = record[start:]
    arrays = {}
    for m in _ARRAY.finditer(xml):
        t = _terms(m[0])
        body = re.search(r"<binary>(.*?)</binary>", m[0], re.S)
        raw = base64.b64decode(body[1]) if body else b""
        raw = zlib.decompress(raw) if "MS:1000574" in t and raw else raw
        values = np.frombuffer(raw, "<f8" if "MS:1000523" in t else "<f4").astype(float)
        if "MS:1000595" in t:
            arrays["rt"] = values * (60 if t["MS:1000595"][1] == "minute" else 1)
        elif "MS:1000515" in t:
            arrays["intensity"] = values
    rt, high = arrays.get("rt", np.zeros(0)), arrays.get("intensity", np.zeros(0))
    if len(rt) != len(high):
        raise ValueError("arrays of unequal length in a chromatogram")
    return _attr(xml[: xml.index(">")], "id"), [{"rt": a, "intensity": b} for a, b in zip(rt.tolist(), high.tolist())]


def read_mzml_chromatograms(spark: SparkSession, path) -> DataFrame:
    """(native_id, points) of an mzML's chromatograms, with points (rt in seconds, intensity)."""
    kind = pa.list_(pa.struct([("rt", pa.float64()), ("intensity", pa.float64())]))
    return _parsed(_records(spark, path, "</chromatogram>"), _chromatogram, "native_id string, points array<struct<rt:double,intensity:double>>", [pa.string(), kind])
