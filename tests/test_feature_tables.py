import base64
import zlib

import numpy as np
import pytest

from spectraloom.sources import feature_tables as f


def _file(tmp_path, name, text):
    (tmp_path / name).write_text(text)
    return str(tmp_path / name)


def test_edta(spark, tmp_path):
    p = _file(tmp_path, "a.edta", "RT\tm/z\tInt\tcharge\tRT1\tMZ1\tINT1\tCHARGE1\n321\t405.5\t100\t2\t321\t405\t60\t2\n323\t406\tNA\n")
    rows = f.read_edta(spark, p).collect()
    assert [(r.rt, r.mz, r.intensity, r.charge, [tuple(e) for e in r.elements]) for r in rows] == [(321.0, 405.5, 100.0, 2, [(321.0, 405.0, 60.0, 2)]), (323.0, 406.0, None, 0, [])]
    f.write_edta(f.read_edta(spark, p), str(tmp_path / "out"))
    assert f.read_edta(spark, str(tmp_path / "out")).count() == 2


def test_feature_lists(spark, tmp_path):
    head = "File\tFirst Scan\tLast Scan\tNum of Scans\tCharge\tMonoisotopic Mass\tBase Isotope Peak\tBest Intensity\tSummed Intensity\tFirst RTime\tLast RTime\tBest RTime\tBest Correlation\tModifications\n"
    (r,) = f.read_kroenik(spark, _file(tmp_path, "a.kro", head + "x\t1\t9\t9\t2\t1000.0\t500.5\t7\t70\t1.0\t3.0\t2.0\t0.9\t_\n")).collect()
    assert (r.charge, r.intensity, r.rt, r.quality, r.modifications) == (2, 70.0, 2.0, 0.9, "_") and abs(r.mz - 501.007276466) < 1e-9
    line = "\t".join(["5", "12.5", "500.1", "true", "998.2", "77", "2", "1,2", "0.5", "1", "2", "3", "4", "6", "3", "99", "0.1", "note"])
    (r,) = f.read_ms_inspect(spark, _file(tmp_path, "a.tsv", "# c\nscan\ttime" + "\tx" * 16 + "\n" + line + "\n")).collect()
    assert (r.rt, r.mz, r.intensity, r.charge, r.quality, r.scan_last, r.description) == (12.5, 500.1, 77.0, 2, 0.5, 6, "note")
    rows = f.read_chromeleon(spark, _file(tmp_path, "a.txt", "Injection\t7\nRaw Data:\nTime (min)\tStep (s)\tValue (mAU)\n0.5\t0.2\t-1,000.5\n1\t0.2\t3\n")).collect()
    assert [(r.rt, r.intensity) for r in rows] == [(30.0, -1000.5), (60.0, 3.0)]


def test_windows_and_design(spark, tmp_path):
    assert [tuple(r) for r in f.read_isolation_windows(spark, _file(tmp_path, "w.txt", "start end\n400 425\n424\t450\n")).collect()] == [(400.0, 425.0), (424.0, 450.0)]
    with pytest.raises(Exception, match="lower bound"):
        f.read_isolation_windows(spark, _file(tmp_path, "x.txt", "450 400\n")).collect()
    d = f.read_design(spark, _file(tmp_path, "d.tsv", "Fraction_Group\tFraction\tSpectra_Filepath\tSample\n1\t1\ta.mzML\ts1\n1\t2\tb.mzML\ts1\n"))
    assert [tuple(r) for r in d.collect()] == [(1, 1, "a.mzML", 1, "s1"), (1, 2, "b.mzML", 1, "s1")]
    with pytest.raises(ValueError, match="lacks"):
        f.read_design(spark, _file(tmp_path, "e.tsv", "a\tb\n1\t2\n"))


def test_xml(spark, tmp_path):
    def peaks(values, kind, packed):
        raw = np.array(values, kind).tobytes()
        return base64.b64encode(zlib.compress(raw) if packed else raw).decode()

    text = f'<mzXML><msRun><scan num="1" msLevel="1" retentionTime="PT1M2.5S" polarity="+"><peaks precision="32" compressionType="none">{peaks([100.5, 7], ">f4", False)}</peaks>'
    text += f'<scan num="2" msLevel="2" retentionTime="PT70S"><precursorMz precursorCharge="2">500.25</precursorMz><peaks precision="64" compressionType="zlib">{peaks([200.25, 8, 300.125, 9], ">f8", True)}</peaks></scan></scan></msRun></mzXML>'
    rows = f.read_mzxml(spark, _file(tmp_path, "a.mzXML", text)).collect()
    assert [(r.scan, r.ms_level, r.rt, r.polarity, r.precursor_mz, r.charge, [p.mz for p in r.peaks]) for r in rows] == [(1, 1, 62.5, 1, None, None, [100.5]), (2, 2, 70.0, 0, 500.25, 2, [200.25, 300.125])]
    text = '<consensusXML><consensusElement id="e_1" quality="0.5" charge="2"><centroid rt="10" mz="500.5" it="7"/><groupedElementList><element map="0" id="1" rt="9" mz="500.4" it="3" charge="2"/><element map="1" id="2" rt="11" mz="500.6" it="4"/></groupedElementList></consensusElement></consensusXML>'
    (r,) = f.read_consensus_xml(spark, _file(tmp_path, "a.consensusXML", text)).collect()
    assert (r.consensus_id, r.rt, r.quality, r.charge, [(e.map, e.mz) for e in r.elements]) == ("e_1", 10.0, 0.5, 2, [(0, 500.4), (1, 500.6)])


def test_chromatograms(spark, tmp_path):
    def array(kind, values, unit=""):
        return f'<binaryDataArray><cvParam accession="MS:1000523"/><cvParam accession="{kind}"{unit}/><binary>{base64.b64encode(np.array(values, "<f8").tobytes()).decode()}</binary></binaryDataArray>'

    minutes = ' unitName="minute"'
    text = f'<mzML><chromatogram index="0" id="TIC">{array("MS:1000595", [0.5, 1], minutes)}{array("MS:1000515", [3, 4])}</chromatogram></mzML>'
    (r,) = f.read_mzml_chromatograms(spark, _file(tmp_path, "a.mzML", text)).collect()
    assert r.native_id == "TIC" and [tuple(p) for p in r.points] == [(30.0, 3.0), (60.0, 4.0)]
