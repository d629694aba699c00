"""Readers and writers of mass-spectrometry files.

A record's end mark is the line separator of Spark's text reader, so one large uncompressed file is split over many tasks and a record
is never cut; compressed files are one task each. Records are then parsed in Arrow batches. Readers give arrays of peaks;
explode_peaks() makes rows of them. Malformed numbers are errors, as they would be in a typed reader.
"""

from __future__ import annotations

import base64
import html
import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import numpress

#: Bytes of an Arrow batch, and of the text that is Python objects at a time.
_BATCH_BYTES, _OBJECT_BYTES = 4 << 20, 1 << 20
_PEAKS = "array<struct<mz:double,intensity:float>>"
_PEAK_TYPE = pa.list_(pa.struct([("mz", pa.float64()), ("intensity", pa.float32())]))


def _records(spark: SparkSession, path, end: str) -> DataFrame:
    return spark.read.option("lineSep", end).text(path)


def _mapped(df: DataFrame, run, schema: str) -> DataFrame:
    """df.mapInArrow(run, schema), by batches of 4 MB at most; the session's own limit stays where it is lower, else it is set to this."""
    conf, key = df.sparkSession.conf, "spark.sql.execution.arrow.maxBytesPerBatch"
    n, unit = re.fullmatch(r"(-?\d+)([kmgt]?)i?b?", conf.get(key).strip().lower()).groups()
    if not 0 < int(n) * 1024 ** " kmgt".index(unit or " ") <= _BATCH_BYTES:
        conf.set(key, str(_BATCH_BYTES))
    return df.mapInArrow(run, schema)


def _batches(rows, size, names: list, kinds: list):
    """Record batches of rows (tuples); one ends as soon as the sizes of its rows reach 1 MB, so few rows are Python objects at a time."""
    out: list[tuple] = []
    total = 0
    for r in rows:
        out.append(r)
        total += size(r)
        if total >= _OBJECT_BYTES:
            yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(zip(*out), kinds)], names=names)
            out, total = [], 0
    if out:
        yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(zip(*out), kinds)], names=names)


def _parsed(df: DataFrame, parse, schema: str, kinds: list) -> DataFrame:
    """parse(record) -> tuple or None, over the text columns of df."""
    names = [c.split()[0] for c in schema.split(", ")]

    def run(batches):
        for b in batches:
            said = 0

            def rows():
                nonlocal said
                for x in zip(*b.columns):
                    x = [v.as_py() for v in x]
                    said = len(x[0] or "")
                    if (r := parse(*x)) is not None:
                        yield r

            yield from _batches(rows(), lambda r: said + 64, names, kinds)

    return _mapped(df, run, schema)


def explode_peaks(spectra: DataFrame) -> DataFrame:
    """One row per peak, with peak_id its place in the spectrum."""
    rest = [c for c in spectra.columns if c != "peaks"]
    return spectra.select(*rest, F.posexplode("peaks").alias("peak_id", "_p")).select(*rest, "peak_id", "_p.mz", "_p.intensity")


def _pairs(lines: list[str]) -> list[dict]:
    return [{"mz": float(x[0]), "intensity": float(x[1]) if len(x) > 1 else 1.0} for x in (re.split(r"[\s,]+", line.strip()) for line in lines)]


# ---------------------------------------------------------------- MGF


def _mgf(record: str):
    start = record.rfind("BEGIN IONS")
    if start < 0:
        return None
    head: dict[str, str] = {}
    peaks = []
    for line in record[start:].splitlines()[1:]:
        line = line.strip()
        if not line or line[0] in "#;!/":
            continue
        if "=" in line and not line[0].isdigit():
            k, v = line.split("=", 1)
            head[k.upper()] = v.strip()
        else:
            peaks.append(line)
    mass = head.get("PEPMASS", "").split()
    charge = re.match(r"(\d+)([+-]?)", head.get("CHARGE", ""))
    return (
        head.get("TITLE"), float(mass[0]) if mass else None, float(mass[1]) if len(mass) > 1 else None, int(charge[1]) * (-1 if charge[2] == "-" else 1) if charge else None,
        float(head["RTINSECONDS"].split("-")[0]) if head.get("RTINSECONDS") else None, _pairs(peaks), [{"key": k, "value": v} for k, v in head.items()],
    )


def read_mgf(spark: SparkSession, path) -> DataFrame:
    schema = f"title string, precursor_mz double, precursor_intensity double, charge int, rt double, peaks {_PEAKS}, meta array<struct<key:string,value:string>>"
    kinds = [pa.string(), pa.float64(), pa.float64(), pa.int32(), pa.float64(), _PEAK_TYPE, pa.list_(pa.struct([("key", pa.string()), ("value", pa.string())]))]
    return _parsed(_records(spark, path, "END IONS"), _mgf, schema, kinds)


def write_mgf(spectra: DataFrame, path: str) -> None:
    """Spectra with title, precursor_mz, charge, rt and peaks as MGF part files."""
    line = lambda key, c: F.when(F.col(c).isNotNull(), F.concat(F.lit(f"{key}="), F.col(c).cast("string"), F.lit("\n"))).otherwise("")
    charge = F.when(F.col("charge").isNotNull(), F.concat(F.lit("CHARGE="), F.abs("charge").cast("string"), F.when(F.col("charge") < 0, "-").otherwise("+"), F.lit("\n"))).otherwise("")
    body = F.array_join(F.transform("peaks", lambda p: F.concat(p["mz"].cast("string"), F.lit(" "), p["intensity"].cast("string"), F.lit("\n"))), "")
    spectra.select(F.concat(F.lit("BEGIN IONS\n"), line("TITLE", "title"), line("PEPMASS", "precursor_mz"), charge, line("RTINSECONDS", "rt"), body, F.lit("END IONS\n")).alias("value")).write.text(path)


# ---------------------------------------------------------------- FASTA


def _fasta(record: str):
    lines = record.lstrip(">").splitlines()
    if not lines or not lines[0].strip():
        return None
    name, _, text = lines[0].strip().partition(" ")
    return name, text, re.sub(r"[\s*]", "", "".join(lines[1:]))


def read_fasta(spark: SparkSession, path) -> DataFrame:
    """(accession, description, sequence), sequences without white space and stop marks."""
    return _parsed(_records(spark, path, "\n>"), _fasta, "accession string, description string, sequence string", [pa.string()] * 3)


def write_fasta(proteins: DataFrame, path: str, width: int = 80) -> None:
    body = F.regexp_replace("sequence", f"(.{{{width}}})(?=.)", "$1\n")
    proteins.select(F.concat(F.lit(">"), F.trim(F.concat_ws(" ", "accession", F.when(F.col("description") != "", F.col("description")))), F.lit("\n"), body).alias("value")).write.text(path)


# ---------------------------------------------------------------- MS2, DTA, DTA2D, tables


def _ms2(record: str):
    lines = ("S" + record if not record.startswith(("S\t", "H\t", "S ", "H ")) else record).splitlines()
    lines = [x for x in lines if x.strip()]
    if not lines or not lines[0].startswith("S"):
        return None
    head = lines[0].split()
    charges = [int(x.split()[1]) for x in lines if x.startswith("Z")]
    rt = next((float(x.split()[2]) for x in lines if x.startswith("I") and x.split()[1] in ("RTime", "RetTime")), None)
    return int(head[1]), float(head[3]), charges, rt, _pairs([x for x in lines[1:] if x[0].isdigit()])


def read_ms2(spark: SparkSession, path) -> DataFrame:
    kinds = [pa.int64(), pa.float64(), pa.list_(pa.int32()), pa.float64(), _PEAK_TYPE]
    return _parsed(_records(spark, path, "\nS"), _ms2, f"scan long, precursor_mz double, charges array<int>, rt double, peaks {_PEAKS}", kinds)


def write_ms2(spectra: DataFrame, path: str) -> None:
    """spectra (scan, precursor_mz, charges, rt, peaks) as MS2 part files."""
    line = lambda *parts: F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts], F.lit("\n"))
    mz, z = F.col("precursor_mz"), F.coalesce("charges", F.array().cast("array<int>"))
    rt = F.when(F.col("rt").isNotNull(), line("I\tRTime\t", F.col("rt").cast("string"))).otherwise("")
    charges = F.array_join(F.transform(z, lambda c: line("Z\t", c.cast("string"), "\t", ((mz - 1.007276466) * c + 1.007276466).cast("string"))), "")
    peaks = F.array_join(F.transform("peaks", lambda p: line(p["mz"].cast("string"), " ", p["intensity"].cast("string"))), "")
    head = line("S\t", F.col("scan").cast("string"), "\t", F.col("scan").cast("string"), "\t", mz.cast("string"))
    # the separator of records stands before each
    spectra.select(F.rtrim(F.concat(head, rt, charges, peaks)).alias("value")).write.text(path)


def read_dta(spark: SparkSession, path) -> DataFrame:
    """One spectrum a file: the precursor's singly charged mass and charge, then peaks."""

    def parse(text: str):
        lines = [x for x in text.splitlines() if x.strip()]
        if not lines:
            return None
        mh, z = lines[0].split()[:2]
        z = int(z)
        return (float(mh) - 1.007276466) / z + 1.007276466 if z else float(mh), z, _pairs(lines[1:])

    df = spark.read.text(path, wholetext=True)
    return _parsed(df, parse, f"precursor_mz double, charge int, peaks {_PEAKS}", [pa.float64(), pa.int32(), _PEAK_TYPE])


def read_peak_table(spark: SparkSession, path, sep: str = r"\s+") -> DataFrame:
    """Text rows of rt, m/z and intensity (with or without a header of letters), as (rt, mz, intensity): all in the JVM."""
    v = F.split(F.trim("value"), sep)
    rows = spark.read.text(path).filter(F.col("value").rlike(r"^\s*[-+.0-9]"))
    return rows.select(v[0].cast("double").alias("rt"), v[1].cast("double").alias("mz"), v[2].cast("float").alias("intensity"))


def write_peak_table(peaks: DataFrame, path: str) -> None:
    peaks.select(F.concat_ws("\t", "rt", "mz", "intensity").alias("value")).write.text(path)


# ---------------------------------------------------------------- mzML

_CV = re.compile(r"<cvParam\b[^>]*?\baccession=\"(MS:\d+)\"[^>]*?>")
_VALUE, _UNIT = re.compile(r"\bvalue=\"([^\"]*)\""), re.compile(r"\bunitName=\"([^\"]*)\"")
#: Types of values, by their terms.
_TYPES = {"MS:1000523": "<f8", "MS:1000521": "<f4", "MS:1000522": "<i8", "MS:1000519": "<i4"}
_GROUP = re.compile(r"<referenceableParamGroup\b[^>]*?\bid=\"([^\"]*)\"[^>]*>(.*?)</referenceableParamGroup>", re.S)
_GROUP_REF = re.compile(r"<referenceableParamGroupRef\b[^>]*?\bref=\"([^\"]*)\"[^>]*?(?:/>|>\s*</referenceableParamGroupRef>)", re.S)
#: Characters of parameter groups that go to the tasks.
_MOST_GROUPS = 16 << 20
_ARRAY = re.compile(r"<binaryDataArray\b.*?</binaryDataArray>", re.S)


def _terms(xml: str) -> dict[str, tuple[str, str]]:
    out = {}
    for m in _CV.finditer(xml):
        v, u = _VALUE.search(m[0]), _UNIT.search(m[0])
        out[m[1]] = (v[1] if v else "", u[1] if u else "")
    return out


def decode_array(xml: str) -> tuple[str, np.ndarray]:
    """Kind (mz, intensity or other) and values of one binaryDataArray."""
    t = _terms(xml)
    m = re.search(r"<binary>(.*?)</binary>", xml, re.S)
    raw = base64.b64decode(m[1]) if m else b""
    kind = "mz" if "MS:1000514" in t else "intensity" if "MS:1000515" in t else "other"
    pressed = next((k for k in numpress.DECODERS if k in t), None)
    if raw and ("MS:1000574" in t or (pressed and numpress.DECODERS[pressed][1])):
        raw = zlib.decompress(raw)
    if pressed:
        return kind, numpress.DECODERS[pressed][0](raw)
    dtype = next((v for k, v in _TYPES.items() if k in t), None)
    if dtype is None and raw:
        raise ValueError("an array without a type")
    return kind, np.frombuffer(raw, dtype or "<f8")


def _mzml(record: str, groups: str | None = None):
    start = record.rfind("<spectrum ")
    if start < 0:
        return None
    xml = record[start:]
    if groups and "<referenceableParamGroupRef" in xml:
        known = {html.unescape(m[1]): m[2] for m in _GROUP.finditer(groups)}
        xml = _GROUP_REF.sub(lambda m: known.get(html.unescape(m[1]), ""), xml)
    head = xml[: xml.index(">")]
    t = _terms(_ARRAY.sub("", xml))
    rt = t.get("MS:1000016")
    arrays = dict(decode_array(m[0]) for m in _ARRAY.finditer(xml))
    mz, high = arrays.get("mz", np.zeros(0)), arrays.get("intensity", np.zeros(0))
    if len(mz) != len(high):
        raise ValueError(f"arrays of unequal length: {head[:200]}")
    name = re.search(r"\bid=\"([^\"]*)\"", head)
    number = lambda k, f: f(t[k][0]) if k in t and t[k][0] else None
    return (
        html.unescape(name[1]) if name else None, number("MS:1000511", int), (float(rt[0]) * (60 if rt[1] == "minute" else 1)) if rt and rt[0] else None, "MS:1000127" in t,
        -1 if "MS:1000129" in t else 1 if "MS:1000130" in t else 0, number("MS:1000744", float), number("MS:1000041", int), [{"mz": a, "intensity": b} for a, b in zip(mz.tolist(), high.tolist())],
    )


def read_mzml(spark: SparkSession, path, param_groups: bool = True) -> DataFrame:
    """Spectra: native id, level, retention time in seconds, centroided, polarity, first precursor and peaks.

    Arrays of floats or integers of 32 or 64 bits or of MS-Numpress, plain or zlib; any other compression is an error. A file's
    parameter groups stand in its header, which only one task sees: they are looked up by a first scan of the text, which
    `param_groups` = False saves for files without any."""
    schema = f"native_id string, ms_level int, rt double, centroid boolean, polarity int, precursor_mz double, charge int, peaks {_PEAKS}"
    kinds = [pa.string(), pa.int32(), pa.float64(), pa.bool_(), pa.int32(), pa.float64(), pa.int32(), _PEAK_TYPE]
    records = _records(spark, path, "</spectrum>")
    found = {}
    if param_groups:
        heads = records.filter(F.col("value").contains("<referenceableParamGroupList")).select(F.col("_metadata.file_path").alias("f"), F.regexp_extract("value", "(?s)<referenceableParamGroupList.*?</referenceableParamGroupList>", 0).alias("g"))
        found = {r.f: r.g for r in heads.toLocalIterator()}
    if not found:
        return _parsed(records, _mzml, schema, kinds)
    if sum(map(len, found.values())) > _MOST_GROUPS:
        raise ValueError("too many files with parameter groups: read them in several calls")
    named = records.select("value", F.col("_metadata.file_path").alias("_file"))
    return _parsed(named, lambda x, f: _mzml(x, found.get(f)), schema, kinds)


def _binary(values: np.ndarray, kind: str, pressed: str | None) -> str:
    encode = {None: lambda v: v.astype("<f8").tobytes(), "linear": numpress.encode_linear, "pic": numpress.encode_pic, "slof": numpress.encode_slof}[pressed]
    term = {None: '<cvParam cvRef="MS" accession="MS:1000574" name="zlib compression" value=""/>', "linear": '<cvParam cvRef="MS" accession="MS:1002746" name="MS-Numpress linear prediction compression followed by zlib compression" value=""/>',
            "pic": '<cvParam cvRef="MS" accession="MS:1002747" name="MS-Numpress positive integer compression followed by zlib compression" value=""/>',
            "slof": '<cvParam cvRef="MS" accession="MS:1002748" name="MS-Numpress short logged float compression followed by zlib compression" value=""/>'}[pressed]
    what = {"mz": '<cvParam cvRef="MS" accession="MS:1000514" name="m/z array" value="" unitCvRef="MS" unitAccession="MS:1000040" unitName="m/z"/>', "intensity": '<cvParam cvRef="MS" accession="MS:1000515" name="intensity array" value=""/>'}[kind]
    text = base64.b64encode(zlib.compress(encode(values))).decode()
    return f'<binaryDataArray encodedLength="{len(text)}"><cvParam cvRef="MS" accession="MS:1000523" name="64-bit float" value=""/>{term}{what}<binary>{text}</binary></binaryDataArray>'


def _spectrum_xml(at: int, r: dict, mz_as: str | None, intensity_as: str | None) -> str:
    term = lambda acc, name, value="", unit="": f'<cvParam cvRef="MS" accession="{acc}" name="{name}" value="{value}"{unit}/>'
    mz = np.array([p["mz"] for p in r["peaks"]], float)
    high = np.array([p["intensity"] for p in r["peaks"]], float)
    out = [f'<spectrum index="{at}" id="{html.escape(r["native_id"] or f"index={at}")}" defaultArrayLength="{len(mz)}">']
    if r["ms_level"] is not None:
        out.append(term("MS:1000511", "ms level", r["ms_level"]))
    out.append(term("MS:1000127", "centroid spectrum") if r["centroid"] else term("MS:1000128", "profile spectrum"))
    if r["polarity"]:
        out.append(term("MS:1000130", "positive scan") if r["polarity"] > 0 else term("MS:1000129", "negative scan"))
    if r["rt"] is not None:
        out.append('<scanList count="1"><scan>' + term("MS:1000016", "scan start time", repr(float(r["rt"])), ' unitCvRef="UO" unitAccession="UO:0000010" unitName="second"') + "</scan></scanList>")
    if r["precursor_mz"] is not None:
        charge = term("MS:1000041", "charge state", r["charge"]) if r["charge"] is not None else ""
        out.append('<precursorList count="1"><precursor><selectedIonList count="1"><selectedIon>' + term("MS:1000744", "selected ion m/z", repr(float(r["precursor_mz"]))) + charge + "</selectedIon></selectedIonList></precursor></precursorList>")
    out.append(f'<binaryDataArrayList count="2">{_binary(mz, "mz", mz_as)}{_binary(high, "intensity", intensity_as)}</binaryDataArrayList></spectrum>')
    return "".join(out)


def write_mzml(spectra: DataFrame, path: str, run: str = "run_id", order: tuple = ("rt", "native_id"), mz_as: str | None = None, intensity_as: str | None = None) -> None:
    """Spectra (as read_mzml gives them, and `run`) as one mzML file for each run, in folders ``run=..``; a run is one task's work, as a file is.

    Arrays are zlib; mz_as and intensity_as: linear, pic or slof for MS-Numpress below it."""
    cols = ["native_id", "ms_level", "rt", "centroid", "polarity", "precursor_mz", "charge", "peaks"]
    n = spectra.groupBy(run).agg(F.count("*").alias("_n"))
    rows = spectra.select(run, *cols).join(n, run).repartition(run).sortWithinPartitions(run, *order)

    def emit(batches):
        now, at = None, 0

        def lines():
            nonlocal now, at
            for b in batches:
                for i in range(b.num_rows):
                    (r,) = b.slice(i, 1).to_pylist()
                    if r[run] != now:
                        if now is not None:
                            yield str(now), "</spectrumList></run></mzML>"
                        now, at = r[run], 0
                        yield str(now), f'<?xml version="1.0" encoding="UTF-8"?>\n<mzML xmlns="http://psi.hupo.org/ms/mzml" version="1.1.0"><run id="{html.escape(str(now))}"><spectrumList count="{r["_n"]}">'
                    yield str(now), _spectrum_xml(at, r, mz_as, intensity_as)
                    at += 1
            if now is not None:
                yield str(now), "</spectrumList></run></mzML>"

        yield from _batches(lines(), lambda r: len(r[1]) + 64, ["run", "value"], [pa.string(), pa.string()])

    _mapped(rows, emit, "run string, value string").write.partitionBy("run").text(path)


# ---------------------------------------------------------------- features and identifications in XML


def _feature(record: str):
    start = record.find("<feature ")
    if start < 0:
        return None
    xml = record[start:]
    get = lambda tag, more="": (lambda m: float(m[1]) if m else None)(re.search(rf"<{tag}\b{more}[^>]*>([^<]+)</{tag}>", xml))
    name = re.search(r"\bid=\"([^\"]*)\"", xml)
    charge = get("charge")
    return name[1] if name else None, get("position", " dim=\"0\""), get("position", " dim=\"1\""), get("intensity"), int(charge) if charge is not None else None, get("overallquality")


def read_feature_xml(spark: SparkSession, path) -> DataFrame:
    """Top-level features (id, rt, mz, intensity, charge, quality); subordinate ones are not read."""
    return _parsed(_records(spark, path, "</feature>"), _feature, "feature_id string, rt double, mz double, intensity double, charge int, quality double", [pa.string(), *[pa.float64()] * 3, pa.int32(), pa.float64()])


def write_feature_xml(features: DataFrame, path: str) -> None:
    """features (feature_id, rt, mz, intensity, charge, quality) as features in part files that read_feature_xml reads."""
    tag = lambda name, c, more="": F.when(F.col(c).isNotNull(), F.concat(F.lit(f"<{name}{more}>"), F.col(c).cast("string"), F.lit(f"</{name}>"))).otherwise("")
    body = [tag("position", "rt", ' dim="0"'), tag("position", "mz", ' dim="1"'), tag("intensity", "intensity"), tag("overallquality", "quality"), tag("charge", "charge")]
    features.select(F.concat(F.lit('<feature id="'), F.col("feature_id").cast("string"), F.lit('">'), *body, F.lit("</feature>")).alias("value")).write.text(path)


def _peptide_hits(record: str):
    start = record.rfind("<PeptideIdentification")
    if start < 0:
        return None
    xml = record[start:]
    attr = lambda s, k: (lambda m: html.unescape(m[1]) if m else None)(re.search(rf"\b{k}=\"([^\"]*)\"", s))
    head = xml[: xml.index(">")]
    hits = [{"sequence": attr(m, "sequence"), "score": float(attr(m, "score") or "nan"), "charge": int(attr(m, "charge") or 0), "proteins": (attr(m, "protein_refs") or "").split()} for m in re.findall(r"<PeptideHit\b[^>]*>", xml)]
    number = lambda k: float(attr(head, k)) if attr(head, k) else None
    return attr(head, "score_type"), attr(head, "higher_score_better") == "true", number("MZ"), number("RT"), hits


def read_id_xml(spark: SparkSession, path) -> DataFrame:
    """Peptide identifications (score_type, higher_better, mz, rt, hits)."""
    hit = "struct<sequence:string,score:double,charge:int,proteins:array<string>>"
    kind = pa.list_(pa.struct([("sequence", pa.string()), ("score", pa.float64()), ("charge", pa.int32()), ("proteins", pa.list_(pa.string()))]))
    return _parsed(_records(spark, path, "</PeptideIdentification>"), _peptide_hits, f"score_type string, higher_better boolean, mz double, rt double, hits array<{hit}>", [pa.string(), pa.bool_(), pa.float64(), pa.float64(), kind])
