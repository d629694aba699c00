"""Kinds of files by their names and by how they begin."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Endings of names and the kinds they stand for.
ENDINGS = {
    "mzml": "mzML", "mzxml": "mzXML", "mzdata": "mzData", "mgf": "MGF", "ms2": "MS2", "dta": "DTA", "dta2d": "DTA2D", "edta": "EDTA", "fasta": "FASTA", "fa": "FASTA", "peff": "PEFF", "featurexml": "featureXML", "consensusxml": "consensusXML", "idxml": "idXML",
    "pepxml": "pepXML", "pep.xml": "pepXML", "protxml": "protXML", "prot.xml": "protXML", "mzid": "mzIdentML", "mztab": "mzTab", "traml": "TraML", "trafoxml": "TrafoXML", "mzqc": "mzQC", "qcml": "qcML", "msp": "MSP", "obo": "OBO", "parquet": "Parquet", "tsv": "TSV", "csv": "CSV", "json": "JSON", "imzml": "imzML", "sqmass": "sqMass",
}
#: What stands near a file's begin, and the kind it stands for.
BEGINS = (("<mzML", "mzML"), ("<indexedmzML", "mzML"), ("<mzXML", "mzXML"), ("<msRun", "mzXML"), ("<mzData", "mzData"), ("<featureMap", "featureXML"), ("<consensusXML", "consensusXML"), ("<IdXML", "idXML"), ("<msms_pipeline_analysis", "pepXML"), ("<protein_summary", "protXML"), ("<MzIdentML", "mzIdentML"), ("<TraML", "TraML"), ("<TrafoXML", "TrafoXML"), ("BEGIN IONS", "MGF"), ("MTD\tmzTab-version", "mzTab"), ("format-version:", "OBO"), ("\"mzQC\"", "mzQC"))


def kind_by_name(name: Column) -> Column:
    """Kind by the ending, that of a compression left off first; `unknown` otherwise. Longer endings go first."""
    low = F.regexp_replace(F.lower(name), r"\.(gz|bz2|zip|zst)$", "")
    out = F.lit("unknown")
    for end in sorted(ENDINGS, key=len):
        out = F.when(low.endswith("." + end), ENDINGS[end]).otherwise(out)
    return out


def kind_by_content(head: Column) -> Column:
    """Kind by the first characters of a file: the mark that comes first; `unknown` without one."""
    at = [F.struct(F.when(F.instr(head, m) > 0, F.instr(head, m)).otherwise(1 << 30).alias("at"), F.lit(k).alias("kind")) for m, k in BEGINS]
    first = F.array_min(F.array(*at))
    return F.when(first["at"] < 1 << 30, first["kind"]).when(head.startswith(">"), "FASTA").otherwise("unknown")
