"""Readers of identification, quality, transition, spectrum-library and vocabulary files, and writers of some.

As in formats: text is split at record ends, so one large file is many tasks. Tables and JSON stay in the JVM.
"""

from __future__ import annotations

import html
import re

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .formats import _PEAK_TYPE, _PEAKS, _parsed, _records

_S, _I, _D = pa.string(), pa.int32(), pa.float64()
_MAP = pa.map_(pa.string(), pa.float64())


def attributes(tag: str) -> dict[str, str]:
    """Attributes of a start tag, entities resolved."""
    return {k: html.unescape(a or b) for k, a, b in re.findall(r"([\w:.-]+)\s*=\s*(?:\"([^\"]*)\"|'([^']*)')", tag)}


def _tags(xml: str, name: str) -> list[dict[str, str]]:
    return [attributes(m) for m in re.findall(rf"<{name}\b([^>]*)>", xml)]


def _blocks(xml: str, name: str) -> list[str]:
    return re.findall(rf"<{name}\b.*?</{name}>", xml, re.S)


def _number(x: str | None) -> float | None:
    return float(x) if x not in (None, "") else None


def _whole(x: str | None) -> int | None:
    return int(float(x)) if x not in (None, "") else None


# ---------------------------------------------------------------- peptide searches in XML


def _pepxml(record: str):
    start = record.rfind("<spectrum_query")
    if start < 0:
        return None
    xml = record[start:]
    a = attributes(xml[: xml.index(">")])
    hits = []
    for h in _blocks(xml, "search_hit"):
        b = attributes(h[: h.index(">")])
        proteins = [b.get("protein", ""), *(x.get("protein", "") for x in _tags(h, "alternative_protein"))]
        mods = [{"position": int(x["position"]), "mass": float(x["mass"])} for x in _tags(h, "mod_aminoacid_mass")]
        hits.append({"rank": _whole(b.get("hit_rank")), "peptide": b.get("peptide"), "proteins": proteins, "mass_difference": _number(b.get("massdiff")), "scores": [(x["name"], float(x["value"])) for x in _tags(h, "search_score")], "modifications": mods})
    return a.get("spectrum"), _whole(a.get("start_scan")), _number(a.get("precursor_neutral_mass")), _whole(a.get("assumed_charge")), _number(a.get("retention_time_sec")), hits


def read_pepxml(spark: SparkSession, path) -> DataFrame:
    """One row per spectrum query; modifications are (position from 1, mass of the modified residue)."""
    hit = "struct<rank:int,peptide:string,proteins:array<string>,mass_difference:double,scores:map<string,double>,modifications:array<struct<position:int,mass:double>>>"
    kind = pa.list_(pa.struct([("rank", _I), ("peptide", _S), ("proteins", pa.list_(_S)), ("mass_difference", _D), ("scores", _MAP), ("modifications", pa.list_(pa.struct([("position", _I), ("mass", _D)])))]))
    return _parsed(_records(spark, path, "</spectrum_query>"), _pepxml, f"spectrum string, scan int, precursor_mass double, charge int, rt double, hits array<{hit}>", [_S, _I, _D, _I, _D, kind])


def _protxml(record: str):
    start = record.rfind("<protein ")
    if start < 0:
        return None
    xml = record[start:]
    a = attributes(xml[: xml.index(">")])
    same = [x.get("protein_name") for x in _tags(xml, "indistinguishable_protein")]
    peptides = [{"sequence": x.get("peptide_sequence"), "charge": _whole(x.get("charge")), "probability": _number(x.get("nsp_adjusted_probability"))} for x in _tags(xml, "peptide")]
    return a.get("protein_name"), _number(a.get("probability")), _number(a.get("percent_coverage")), same, peptides


def read_protxml(spark: SparkSession, path) -> DataFrame:
    """(accession, probability, coverage, indistinguishable, peptides)"""
    kind = pa.list_(pa.struct([("sequence", _S), ("charge", _I), ("probability", _D)]))
    return _parsed(_records(spark, path, "</protein>"), _protxml, "accession string, probability double, coverage double, indistinguishable array<string>, peptides array<struct<sequence:string,charge:int,probability:double>>", [_S, _D, _D, pa.list_(_S), kind])


def _mzid_result(record: str):
    start = record.rfind("<SpectrumIdentificationResult")
    if start < 0:
        return None
    xml = record[start:]
    a = attributes(xml[: xml.index(">")])
    items = []
    for m in re.finditer(r"<SpectrumIdentificationItem\b([^>]*?)(?:/>|>(.*?)</SpectrumIdentificationItem>)", xml, re.S):
        b, body = attributes(m[1]), m[2] or ""
        scores = [(x["name"], float(x["value"])) for x in _tags(body, "cvParam") if re.fullmatch(r"[-+]?[\d.]+(?:[eE][-+]?\d+)?", x.get("value", ""))]
        evidence = [x["peptideEvidence_ref"] for x in _tags(body, "PeptideEvidenceRef")]
        items.append({"rank": _whole(b.get("rank")), "charge": _whole(b.get("chargeState")), "mz": _number(b.get("experimentalMassToCharge")), "expected_mz": _number(b.get("calculatedMassToCharge")), "peptide_ref": b.get("peptide_ref"), "passed": b.get("passThreshold") == "true", "scores": scores, "evidence": evidence})
    return a.get("spectrumID"), a.get("spectraData_ref"), items


def _mzid_peptide(record: str):
    start = record.rfind("<Peptide ")
    if start < 0:
        return None
    xml = record[start:]
    sequence = re.search(r"<PeptideSequence>\s*(.*?)\s*</PeptideSequence>", xml, re.S)
    mods = [{"position": int(x.get("location", 0)), "mass": float(x.get("monoisotopicMassDelta", "nan"))} for x in _tags(xml, "Modification")]
    return attributes(xml[: xml.index(">")]).get("id"), sequence[1] if sequence else None, mods


def _mzid_evidence(record: str):
    start = record.rfind("<PeptideEvidence ")
    if start < 0:
        return None
    a = attributes(record[start:])
    return a.get("id"), a.get("peptide_ref"), a.get("dBSequence_ref"), _whole(a.get("start")), _whole(a.get("end")), a.get("isDecoy") == "true"


def read_mzid(spark: SparkSession, path) -> DataFrame:
    """One row per identification item, with its peptide's sequence and modifications: references are joined by id."""
    item = "struct<rank:int,charge:int,mz:double,expected_mz:double,peptide_ref:string,passed:boolean,scores:map<string,double>,evidence:array<string>>"
    kind = pa.list_(pa.struct([("rank", _I), ("charge", _I), ("mz", _D), ("expected_mz", _D), ("peptide_ref", _S), ("passed", pa.bool_()), ("scores", _MAP), ("evidence", pa.list_(_S))]))
    results = _parsed(_records(spark, path, "</SpectrumIdentificationResult>"), _mzid_result, f"spectrum string, data string, items array<{item}>", [_S, _S, kind]).select("spectrum", "data", F.explode("items").alias("i")).select("spectrum", "data", "i.*")
    mods = pa.list_(pa.struct([("position", _I), ("mass", _D)]))
    peptides = _parsed(_records(spark, path, "</Peptide>"), _mzid_peptide, "peptide_ref string, sequence string, modifications array<struct<position:int,mass:double>>", [_S, _S, mods])
    return results.join(peptides, "peptide_ref", "left")


def read_mzid_evidence(spark: SparkSession, path) -> DataFrame:
    """(evidence, peptide_ref, protein_ref, start, end, decoy)"""
    return _parsed(_records(spark, path, ">"), _mzid_evidence, "evidence string, peptide_ref string, protein_ref string, start int, end int, decoy boolean", [_S, _S, _S, _I, _I, pa.bool_()])


def write_id_xml(hits: DataFrame, path: str, score_type: str = "score", higher_better: bool = True) -> None:
    """hits (mz, rt, sequence, score, charge, proteins: array of accessions) as peptide identifications, one hit each: fragments of idXML in part files that read_id_xml reads."""
    esc = lambda c: F.replace(F.replace(F.replace(F.replace(c, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;")), F.lit('"'), F.lit("&quot;"))
    attr = lambda k, c: F.concat(F.lit(f' {k}="'), esc(c.cast("string")), F.lit('"'))
    maybe = lambda k, c: F.when(c.isNotNull(), attr(k, c)).otherwise("")
    head = F.concat(F.lit(f'<PeptideIdentification score_type="{html.escape(score_type)}" higher_score_better="{str(higher_better).lower()}"'), maybe("MZ", F.col("mz")), maybe("RT", F.col("rt")), F.lit(">"))
    hit = F.concat(F.lit("<PeptideHit"), attr("score", F.col("score")), attr("sequence", F.col("sequence")), maybe("charge", F.col("charge")), attr("protein_refs", F.array_join("proteins", " ")), F.lit("></PeptideHit></PeptideIdentification>"))
    hits.select(F.concat(head, hit).alias("value")).write.text(path)


# ---------------------------------------------------------------- tables


def read_mztab(spark: SparkSession, path, section: str = "PSM") -> DataFrame:
    """One section (PSM, PRT, PEP or SML) with the columns of its header line, as strings; `null` is null. Files have to agree on the header."""
    head = {"PSM": "PSH", "PRT": "PRH", "PEP": "PEH", "SML": "SMH"}[section]
    lines = spark.read.text(path)
    headers = [r[0] for r in lines.filter(F.col("value").startswith(head + "\t")).distinct().limit(2).collect()]
    if not headers:
        raise ValueError(f"no {section} section")
    if len(headers) > 1:
        raise ValueError("the files' headers differ: read them in several calls")
    names = headers[0].rstrip("\r\n").split("\t")[1:]
    v = F.split(F.regexp_replace("value", "\r$", ""), "\t", -1)
    return lines.filter(F.col("value").startswith(section + "\t")).select(*[F.when(v[i + 1] != "null", v[i + 1]).alias(n) for i, n in enumerate(names)])


def read_mztab_metadata(spark: SparkSession, path) -> DataFrame:
    v = F.split("value", "\t")
    return spark.read.text(path).filter(F.col("value").startswith("MTD\t")).select(v[1].alias("key"), v[2].alias("value"))


def write_mztab_psms(psms: DataFrame, path: str) -> None:
    """The columns of psms as a PSM section, with its header in one part file."""
    cells = F.concat_ws("\t", F.lit("PSM"), *[F.coalesce(F.col(c).cast("string"), F.lit("null")) for c in psms.columns])
    head = psms.sparkSession.createDataFrame([("\t".join(["PSH", *psms.columns]),)], "value string")
    head.union(psms.select(cells.alias("value"))).write.text(path)


def read_percolator(spark: SparkSession, path) -> DataFrame:
    """Percolator's PSM table: (psm, score, q_value, pep, peptide, proteins); flanking residues stay in peptide."""
    v = F.split("value", "\t")
    rows = spark.read.text(path).filter(~F.col("value").startswith("PSMId\t") & (F.trim("value") != ""))
    return rows.select(v[0].alias("psm"), v[1].cast("double").alias("score"), v[2].cast("double").alias("q_value"), v[3].cast("double").alias("pep"), v[4].alias("peptide"), F.slice(v, F.lit(6), F.greatest(F.size(v) - 5, F.lit(0))).alias("proteins"))


def write_percolator_input(psms: DataFrame, path: str, features: tuple) -> None:
    """psms (psm, decoy, scan, peptide, proteins: array, features) as Percolator's input: one header line, label 1 or -1."""
    head = psms.sparkSession.createDataFrame([("\t".join(["SpecId", "Label", "ScanNr", *features, "Peptide", "Proteins"]),)], "value string")
    cells = F.concat_ws("\t", F.col("psm").cast("string"), F.when(F.col("decoy"), "-1").otherwise("1"), F.col("scan").cast("string"), *[F.col(c).cast("string") for c in features], F.concat(F.lit("-."), "peptide", F.lit(".-")), F.array_join("proteins", "\t"))
    head.union(psms.select(cells.alias("value"))).write.text(path)


def read_omssa_csv(spark: SparkSession, path) -> DataFrame:
    """(scan, peptide, e_value, mass, charge, accession, modifications) of OMSSA's table with a header."""
    t = spark.read.option("header", True).option("ignoreLeadingWhiteSpace", True).csv(path)
    c = lambda n: F.col(f"`{n}`")
    return t.select(c("Spectrum number").cast("int").alias("scan"), c("Peptide").alias("peptide"), c("E-value").cast("double").alias("e_value"), c("Mass").cast("double").alias("mass"), c("Charge").cast("int").alias("charge"), c("Defline").alias("accession"), c("Mods").alias("modifications"))


def read_transition_table(spark: SparkSession, path) -> DataFrame:
    """Transition lists with a header, tab-separated: (precursor_mz, product_mz, intensity, rt, peptide, charge, group, name, decoy)."""
    t = spark.read.option("header", True).option("sep", "\t").csv(path)
    low = {c.lower(): c for c in t.columns}
    pick = lambda kind, *names: next((F.col(f"`{low[n.lower()]}`").cast(kind) for n in names if n.lower() in low), F.lit(None).cast(kind))
    return t.select(
        pick("double", "PrecursorMz").alias("precursor_mz"), pick("double", "ProductMz", "FragmentMz").alias("product_mz"), pick("double", "LibraryIntensity", "RelativeFragmentIntensity").alias("intensity"),
        pick("double", "NormalizedRetentionTime", "iRT", "Tr_recalibrated", "RetentionTime").alias("rt"), pick("string", "PeptideSequence", "Sequence").alias("peptide"), pick("int", "PrecursorCharge", "Charge").alias("charge"),
        pick("string", "TransitionGroupId", "transition_group_id").alias("group"), pick("string", "TransitionId", "transition_name").alias("name"), (F.coalesce(pick("string", "Decoy"), F.lit("0")).isin("1", "TRUE", "true")).alias("decoy"))


def write_transition_table(transitions: DataFrame, path: str) -> None:
    """The columns of read_transition_table as a table with a header in each part file."""
    t = transitions.select(F.col("precursor_mz").alias("PrecursorMz"), F.col("product_mz").alias("ProductMz"), F.col("intensity").alias("LibraryIntensity"), F.col("rt").alias("NormalizedRetentionTime"), F.col("peptide").alias("PeptideSequence"),
                           F.col("charge").alias("PrecursorCharge"), F.col("group").alias("TransitionGroupId"), F.col("name").alias("TransitionId"), F.col("decoy").cast("int").alias("Decoy"))
    t.write.option("header", True).option("sep", "\t").csv(path)


# ---------------------------------------------------------------- transitions, alignments, quality


def _traml(record: str):
    start = record.rfind("<Transition ")
    if start < 0:
        return None
    xml = record[start:]
    a = attributes(xml[: xml.index(">")])
    term = lambda s, acc: next((x.get("value") for x in _tags(s, "cvParam") if x.get("accession") == acc), None)
    part = lambda name: next(iter(_blocks(xml, name)), "")
    rest = re.sub(r"<(Precursor|Product)\b.*?</\1>", "", xml, flags=re.S)
    return a.get("id"), a.get("peptideRef") or a.get("compoundRef"), _number(term(part("Precursor"), "MS:1000827")), _number(term(part("Product"), "MS:1000827")), _whole(term(part("Product"), "MS:1000041")), _number(term(rest, "MS:1001226")), "MS:1002008" in rest


def read_traml(spark: SparkSession, path) -> DataFrame:
    """(name, ref, precursor_mz, product_mz, product_charge, intensity, decoy) of each transition."""
    return _parsed(_records(spark, path, "</Transition>"), _traml, "name string, ref string, precursor_mz double, product_mz double, product_charge int, intensity double, decoy boolean", [_S, _S, _D, _D, _I, _D, pa.bool_()])


def read_transformation(spark: SparkSession, path) -> DataFrame:
    """(from, to): the pairs of an alignment's transformation file."""

    def pair(record: str):
        start = record.rfind("<Pair")
        if start < 0:
            return None
        a = attributes(record[start:])
        return float(a["from"]), float(a["to"])

    return _parsed(_records(spark, path, "/>"), pair, "from double, to double", [_D, _D])


def read_mzqc(spark: SparkSession, path) -> DataFrame:
    """(run, accession, name, value: JSON text) of the run qualities' metrics, all in the JVM."""
    schema = "mzQC struct<runQualities: array<struct<metadata: struct<label: string>, qualityMetrics: array<struct<accession: string, name: string, value: string>>>>>"
    runs = spark.read.schema(schema).option("multiLine", True).json(path).select(F.explode("mzQC.runQualities").alias("r"))
    return runs.select(F.col("r.metadata.label").alias("run"), F.explode("r.qualityMetrics").alias("m")).select("run", "m.*")


def write_mzqc(metrics: DataFrame, path: str) -> None:
    """metrics (run, accession, name, value: number) as JSON, one document for each run, in folders ``run=..``."""
    one = F.struct(F.col("accession").alias("accession"), F.col("name").alias("name"), F.col("value").alias("value"))
    runs = metrics.groupBy("run").agg(F.sort_array(F.collect_list(one)).alias("m"))
    doc = F.struct(F.struct(F.lit("1.0.0").alias("version"), F.array(F.struct(F.struct(F.col("run").cast("string").alias("label")).alias("metadata"), F.col("m").alias("qualityMetrics"))).alias("runQualities")).alias("mzQC"))
    runs.select("run", F.to_json(doc).alias("value")).repartition("run").write.partitionBy("run").text(path)


# ---------------------------------------------------------------- spectrum libraries, vocabularies, modifications


def _msp(record: str):
    lines = [x.strip() for x in (record if record.lower().startswith("name:") else "Name:" + record).splitlines()]
    head: dict[str, str] = {}
    peaks = []
    for x in lines:
        if not x or x[0] == "#":
            continue
        if ":" in x and not x[0].isdigit():
            k, v = x.split(":", 1)
            head[k.strip().lower()] = v.strip()
        elif x[0].isdigit():
            for p in x.split(";") if ";" in x else [x]:
                if len(v := p.split(None, 2)) > 1:
                    peaks.append({"mz": float(v[0]), "intensity": float(v[1])})
    if not head.get("name"):
        return None
    comment = head.get("comment") or head.get("comments") or ""
    mass = _number(head.get("precursormz")) or _number((re.search(r"\bParent=([\d.]+)", comment) or [None, None])[1])
    return head["name"], mass, _number(head.get("mw")), comment, peaks


def read_msp(spark: SparkSession, path) -> DataFrame:
    """(name, precursor_mz, weight, comment, peaks) of a spectrum library."""
    return _parsed(_records(spark, path, "\nName:"), _msp, f"name string, precursor_mz double, weight double, comment string, peaks {_PEAKS}", [_S, _D, _D, _S, _PEAK_TYPE])


def _obo(record: str):
    if not record.lstrip("[").startswith("Term]"):
        return None
    get: dict[str, list[str]] = {}
    for line in record.splitlines()[1:]:
        k, colon, v = line.partition(":")
        if colon:
            get.setdefault(k.strip(), []).append(v.strip())
    bare = lambda v: v.partition(" ! ")[0].strip()
    quoted = lambda v: (re.match(r'"((?:[^"\\]|\\.)*)"', v) or [None, v])[1]
    parents = [bare(v) for v in get.get("is_a", [])] + [bare(v[8:]) for v in get.get("relationship", []) if v.startswith("part_of ")]
    return (get.get("id") or [None])[0], (get.get("name") or [None])[0], quoted((get.get("def") or [""])[0]), parents, [quoted(v) for v in get.get("synonym", [])], (get.get("is_obsolete") or [""])[0] == "true"


def read_obo(spark: SparkSession, path) -> DataFrame:
    """Terms of a vocabulary: (id, name, definition, parents by is_a and part_of, synonyms, obsolete)."""
    return _parsed(_records(spark, path, "\n["), _obo, "id string, name string, definition string, parents array<string>, synonyms array<string>, obsolete boolean", [_S, _S, _S, pa.list_(_S), pa.list_(_S), pa.bool_()])


def descendants(terms: DataFrame, root: str) -> DataFrame:
    """(id, depth): what lies below a term, with the least number of steps; joins go on until a level has no new terms. A vocabulary is small."""
    edges = terms.select(F.explode("parents").alias("parent"), F.col("id").alias("child")).distinct().persist()
    known = terms.sparkSession.createDataFrame([(root, 0)], "id string, depth int")
    front, depth = known, 0
    while True:
        depth += 1
        new = edges.join(front.select(F.col("id").alias("parent")), "parent").select(F.col("child").alias("id")).distinct().join(known, "id", "left_anti").select("id", F.lit(depth).alias("depth"))
        new = terms.sparkSession.createDataFrame(new.collect(), "id string, depth int")  # a level of a vocabulary's terms
        if new.isEmpty():
            edges.unpersist()
            return known.filter(F.col("depth") > 0)
        known, front = known.union(new), new


def _unimod(record: str):
    m = re.search(r"<(?:umod:)?mod\s[^>]*title=", record)
    if m is None:
        return None
    xml = record[m.start() :]
    a = attributes(xml[: xml.index(">")])
    delta = next(iter(_tags(xml, "(?:umod:)?delta")), {})
    sites = [{"site": x.get("site"), "position": x.get("position"), "kind": x.get("classification")} for x in _tags(xml, "(?:umod:)?specificity")]
    return _whole(a.get("record_id")), a.get("title"), a.get("full_name"), _number(delta.get("mono_mass")), _number(delta.get("avge_mass")), delta.get("composition"), sites


def read_unimod(spark: SparkSession, path) -> DataFrame:
    """(record, title, full_name, mono_mass, average_mass, composition, sites) of a modification database."""
    site = pa.list_(pa.struct([("site", _S), ("position", _S), ("kind", _S)]))
    return _parsed(_records(spark, path, "mod>"), _unimod, "record int, title string, full_name string, mono_mass double, average_mass double, composition string, sites array<struct<site:string,position:string,kind:string>>", [_I, _S, _S, _D, _D, _S, site])


def _peff(record: str):
    lines = record.lstrip(">").splitlines()
    if not lines or not lines[0].strip() or lines[0].startswith("#"):
        return None
    name, _, text = lines[0].strip().partition(" ")
    said = [(m[1], m[2].strip()) for m in re.finditer(r"\\(\w+)=(.*?)(?=\s\\\w+=|$)", text)]
    prefix, colon, accession = name.partition(":")
    return (prefix if colon else None), accession if colon else name, said, re.sub(r"[\s*]", "", "".join(x for x in lines[1:] if not x.startswith("#")))


def read_peff(spark: SparkSession, path) -> DataFrame:
    r"""(database, accession, annotations: map of the \Key=Value parts, sequence) of extended FASTA."""
    return _parsed(_records(spark, path, "\n>"), _peff, "database string, accession string, annotations map<string,string>, sequence string", [_S, _S, pa.map_(_S, _S), _S])


# ---------------------------------------------------------------- names of spectra

#: Where the scan number stands in native ids, most specific first.
_SCANS = (r"\bscan=(\d+)", r"\bscanId=(\d+)", r"\bspectrum=(\d+)", r"\bindex=(\d+)", r"\bcycle=(\d+)", r"\bquery=(\d+)", r"^(\d+)$")


def scan_number(native_id: Column) -> Column:
    """Scan number of a native id; null if it has none."""
    found = [F.regexp_extract(native_id, p, 1) for p in _SCANS]
    return F.coalesce(*[F.when(x != "", x.cast("long")) for x in found])


def parse_usi(usi: Column) -> Column:
    """struct(collection, run, kind, number, interpretation, charge) of a universal spectrum identifier; null if it is none."""
    p = r"^mzspec:([^:]+):(.+?):(scan|index|nativeId|trace):([^:]+)(?::(.+?))?$"
    part = lambda i: F.when(F.regexp_extract(usi, p, i) != "", F.regexp_extract(usi, p, i))
    charge = F.regexp_extract(usi, r"/(-?\d+)(?::[^:]*)?$", 1)
    return F.when(usi.rlike(p), F.struct(part(1).alias("collection"), part(2).alias("run"), part(3).alias("kind"), part(4).alias("number"), part(5).alias("interpretation"), F.when(charge != "", charge.cast("int")).alias("charge")))
