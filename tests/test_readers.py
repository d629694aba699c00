import base64

import numpy as np
import pytest
from pyspark.errors import PythonException
from pyspark.sql import functions as F

from spectraloom.sources import file_types as ft
from spectraloom.sources import formats as fm
from spectraloom.sources import identification_files as idf
from spectraloom.sources import numpress


def put(tmp_path, name, text):
    p = tmp_path / name
    p.write_text(text)
    return str(p)


def array(values, terms, encode=lambda v: v.astype("<f8").tobytes()):
    return f'<binaryDataArray>{"".join(f"<cvParam cvRef=\'MS\' accession=\"{t}\" name=\"n\" value=\"\"/>" for t in terms)}<binary>{base64.b64encode(encode(np.asarray(values, float))).decode()}</binary></binaryDataArray>'


def spectrum(i, body):
    return f'<spectrum index="{i}" id="scan={i}" defaultArrayLength="2">{body}</spectrum>'


def test_mzml_numpress_and_groups(spark, tmp_path):
    mz, high = [100.25, 200.5], [7.0, 0.0]
    pressed = array(mz, ("MS:1000523", "MS:1002312", "MS:1000514"), numpress.encode_linear) + array(high, ("MS:1000523", "MS:1002313", "MS:1000515"), numpress.encode_pic)
    grouped = array(mz, ()).replace("<binary>", '<referenceableParamGroupRef ref="a"/><binary>') + array(high, ()).replace("<binary>", '<referenceableParamGroupRef ref="b"/><binary>')
    head = '<mzML><referenceableParamGroupList count="2"><referenceableParamGroup id="a"><cvParam accession="MS:1000523" value=""/><cvParam accession="MS:1000514" value=""/></referenceableParamGroup><referenceableParamGroup id="b"><cvParam accession="MS:1000523" value=""/><cvParam accession="MS:1000515" value=""/></referenceableParamGroup></referenceableParamGroupList><run><spectrumList>'
    path = put(tmp_path, "a.mzML", head + spectrum(1, pressed) + spectrum(2, grouped) + "</spectrumList></run></mzML>")
    got = {r.native_id: r.peaks for r in fm.read_mzml(spark, path).collect()}
    assert len(got) == 2
    for peaks in got.values():
        assert np.allclose([p.mz for p in peaks], mz) and [p.intensity for p in peaks] == high
    path = put(tmp_path, "b.mzML", "<mzML>" + spectrum(1, array(mz, ("MS:1000514",))) + "</mzML>")
    with pytest.raises(PythonException, match="without a type"):
        fm.read_mzml(spark, path).collect()


def test_pepxml(spark, tmp_path):
    path = put(tmp_path, "a.pep.xml", """<msms_run_summary><spectrum_query spectrum="f.5.5.2" start_scan="5" precursor_neutral_mass="900.5" assumed_charge="2" retention_time_sec="61.5"><search_result>
<search_hit hit_rank="1" peptide="PEPTMK" protein="P&amp;1" massdiff="-0.01"><alternative_protein protein="P2"/><modification_info><mod_aminoacid_mass position="5" mass="147.04"/></modification_info><search_score name="xcorr" value="2.5"/></search_hit>
</search_result></spectrum_query><spectrum_query spectrum="f.6.6.0" start_scan="6"></spectrum_query></msms_run_summary>""")
    a, b = idf.read_pepxml(spark, path).orderBy("scan").collect()
    h = a.hits[0]
    assert (a.spectrum, a.scan, a.precursor_mass, a.charge, a.rt) == ("f.5.5.2", 5, 900.5, 2, 61.5)
    assert (h.peptide, h.proteins, h.mass_difference, h.scores, h.modifications[0].mass) == ("PEPTMK", ["P&1", "P2"], -0.01, {"xcorr": 2.5}, 147.04)
    assert b.hits == [] and b.charge is None


def test_mzid(spark, tmp_path):
    path = put(tmp_path, "a.mzid", """<MzIdentML><Peptide id="p1"><PeptideSequence>PEPK</PeptideSequence><Modification location="2" monoisotopicMassDelta="15.99"></Modification></Peptide>
<Peptide id="p2"><PeptideSequence>AAK</PeptideSequence></Peptide><PeptideEvidence id="e1" peptide_ref="p1" dBSequence_ref="d1" start="3" end="6" isDecoy="true"/>
<SpectrumIdentificationResult id="r" spectrumID="scan=7" spectraData_ref="s"><SpectrumIdentificationItem rank="1" chargeState="2" experimentalMassToCharge="300.1" calculatedMassToCharge="300.2" peptide_ref="p1" passThreshold="true"><PeptideEvidenceRef peptideEvidence_ref="e1"/><cvParam accession="x" name="score" value="1e-3"/></SpectrumIdentificationItem><SpectrumIdentificationItem rank="2" peptide_ref="p2" passThreshold="false"/></SpectrumIdentificationResult></MzIdentML>""")
    a, b = idf.read_mzid(spark, path).orderBy("rank").collect()
    assert (a.spectrum, a.sequence, a.charge, a.passed, a.scores, a.evidence, a.modifications[0].position) == ("scan=7", "PEPK", 2, True, {"score": 1e-3}, ["e1"], 2)
    assert (b.sequence, b.passed, b.modifications) == ("AAK", False, [])
    assert [tuple(r) for r in idf.read_mzid_evidence(spark, path).collect()] == [("e1", "p1", "d1", 3, 6, True)]


def test_protxml_traml_transformation(spark, tmp_path):
    path = put(tmp_path, "a.prot.xml", '<protein_group><protein protein_name="A" probability="0.9" percent_coverage="12.5"><indistinguishable_protein protein_name="B"/><peptide peptide_sequence="PEPK" charge="2" nsp_adjusted_probability="0.8"/></protein></protein_group>')
    (r,) = idf.read_protxml(spark, path).collect()
    assert (r.accession, r.probability, r.indistinguishable, r.peptides[0].sequence) == ("A", 0.9, ["B"], "PEPK")
    path = put(tmp_path, "a.traml", '<TransitionList><Transition id="t" peptideRef="p"><Precursor><cvParam accession="MS:1000827" value="500.1"/></Precursor><Product><cvParam accession="MS:1000041" value="1"/><cvParam accession="MS:1000827" value="300.2"/></Product><cvParam accession="MS:1001226" value="77"/><cvParam accession="MS:1002008" value=""/></Transition></TransitionList>')
    assert [tuple(r) for r in idf.read_traml(spark, path).collect()] == [("t", "p", 500.1, 300.2, 1, 77.0, True)]
    path = put(tmp_path, "a.trafoXML", '<TrafoXML><Pairs count="2"><Pair from="1.5" to="2.5"/><Pair from="3" to="4"/></Pairs></TrafoXML>')
    assert sorted(tuple(r) for r in idf.read_transformation(spark, path).collect()) == [(1.5, 2.5), (3.0, 4.0)]


def test_tables(spark, tmp_path):
    path = put(tmp_path, "a.mztab", "MTD\tmzTab-version\t1.0\nPRH\taccession\tdescription\nPRT\tP1\tnull\nPSH\tsequence\tPSM_ID\nPSM\tPEPK\t1\nPSM\tnull\t2\n")
    assert sorted(map(tuple, idf.read_mztab(spark, path).collect()), key=str) == [("PEPK", "1"), (None, "2")]
    assert [tuple(r) for r in idf.read_mztab(spark, path, "PRT").collect()] == [("P1", None)]
    assert [tuple(r) for r in idf.read_mztab_metadata(spark, path).collect()] == [("mzTab-version", "1.0")]
    with pytest.raises(ValueError, match="no SML"):
        idf.read_mztab(spark, path, "SML")
    path = put(tmp_path, "a.tsv", "PSMId\tscore\tq-value\tposterior_error_prob\tpeptide\tproteinIds\nx\t1.5\t0.01\t0.2\tK.PEPK.A\tP1\tP2\n")
    assert [tuple(r) for r in idf.read_percolator(spark, path).collect()] == [("x", 1.5, 0.01, 0.2, "K.PEPK.A", ["P1", "P2"])]
    path = put(tmp_path, "a.csv", "Spectrum number, Filename/id, Peptide, E-value, Mass, gi, Accession, Start, Stop, Defline, Mods, Charge\n7,f,PEPK,0.001,500.5,0,0,1,4,P1,,2\n")
    (r,) = idf.read_omssa_csv(spark, path).collect()
    assert (r.scan, r.peptide, r.e_value, r.charge, r.accession) == (7, "PEPK", 0.001, 2, "P1")
    psms = spark.createDataFrame([("a", False, 1, "PEPK", ["P1"], 0.5), ("b", True, 2, "KPEP", ["D1", "D2"], 0.25)], "psm string, decoy boolean, scan int, peptide string, proteins array<string>, f double")
    idf.write_percolator_input(psms.coalesce(1), str(tmp_path / "pin"), ("f",))
    assert sorted(r[0] for r in spark.read.text(str(tmp_path / "pin")).collect()) == sorted(["SpecId\tLabel\tScanNr\tf\tPeptide\tProteins", "a\t1\t1\t0.5\t-.PEPK.-\tP1", "b\t-1\t2\t0.25\t-.KPEP.-\tD1\tD2"])


def test_libraries_and_vocabularies(spark, tmp_path):
    path = put(tmp_path, "a.msp", 'Name: AAK/2\nMW: 288.2\nComment: Parent=145.1 Mods=0\nNum peaks: 2\n100.1\t5\t"b1"\n200.2\t7.5\n\nName: CCK/1\nPrecursorMZ: 350.5\nNum peaks: 1\n50 1\n')
    a, b = idf.read_msp(spark, path).orderBy("name").collect()
    assert (a.name, a.precursor_mz, a.weight, [(p.mz, p.intensity) for p in a.peaks]) == ("AAK/2", 145.1, 288.2, [(100.1, 5.0), (200.2, 7.5)]) and b.precursor_mz == 350.5
    path = put(tmp_path, "a.obo", 'format-version: 1.2\n\n[Term]\nid: X:1\nname: root\n\n[Term]\nid: X:2\nname: child\ndef: "a \\"b\\"." [r]\nis_a: X:1 ! root\nsynonym: "kid" EXACT []\n\n[Term]\nid: X:3\nname: part\nrelationship: part_of X:2 ! child\nis_obsolete: true\n\n[Typedef]\nid: part_of\n')
    t = idf.read_obo(spark, path)
    got = {r.id: r for r in t.collect()}
    assert set(got) == {"X:1", "X:2", "X:3"} and got["X:2"].parents == ["X:1"] and got["X:2"].synonyms == ["kid"] and got["X:3"].parents == ["X:2"] and got["X:3"].obsolete
    assert {r.id: r.depth for r in idf.descendants(t, "X:1").collect()} == {"X:2": 1, "X:3": 2}
    path = put(tmp_path, "u.xml", '<umod:modifications><umod:mod title="Ox" full_name="Oxidation" record_id="35"><umod:specificity site="M" position="Anywhere" classification="Artefact"/><umod:delta mono_mass="15.99" avge_mass="16.0" composition="O"></umod:delta></umod:mod></umod:modifications>')
    (r,) = idf.read_unimod(spark, path).collect()
    assert (r.record, r.title, r.mono_mass, r.sites[0].site) == (35, "Ox", 15.99, "M")
    path = put(tmp_path, "a.peff", "# PEFF 1.0\n# //\n>nxp:P1 \\PName=A protein \\Length=6\nMAA\nKRR\n>nxp:P2\nMK\n")
    got = {r.accession: r for r in idf.read_peff(spark, path).collect()}
    assert got["P1"].annotations == {"PName": "A protein", "Length": "6"} and got["P1"].sequence == "MAAKRR" and got["P2"].database == "nxp"


def test_names(spark):
    ids = ["controllerType=0 controllerNumber=1 scan=17", "index=3", "sample=1 period=1 cycle=9 experiment=2", "25", "nothing", None]
    df = spark.createDataFrame([(i, x) for i, x in enumerate(ids)], "i int, x string")
    assert [r[0] for r in df.orderBy("i").select(idf.scan_number(F.col("x"))).collect()] == [17, 3, 9, 25, None, None]
    df = spark.createDataFrame([("mzspec:PXD1:a:b.raw:scan:5:[Acetyl]-PEP/2",), ("mzspec:PXD1:f:index:5",), ("mzspec:f",)], "x string")
    a, b, c = (r[0] for r in df.select(idf.parse_usi(F.col("x"))).collect())
    assert (a.collection, a.run, a.kind, a.number, a.interpretation, a.charge) == ("PXD1", "a:b.raw", "scan", "5", "[Acetyl]-PEP/2", 2) and b.interpretation is None and b.charge is None and c is None


def test_file_types(spark):
    df = spark.createDataFrame([("a/b.mzML.gz",), ("x.pep.xml",), ("y.dta2d",), ("z",)], "n string")
    assert [r[0] for r in df.select(ft.kind_by_name(F.col("n"))).collect()] == ["mzML", "pepXML", "DTA2D", "unknown"]
    df = spark.createDataFrame([('<?xml version="1.0"?><mzML><x/>',), (">P1\nMK",), ("BEGIN IONS",), ("?",)], "n string")
    assert [r[0] for r in df.select(ft.kind_by_content(F.col("n"))).collect()] == ["mzML", "FASTA", "MGF", "unknown"]
