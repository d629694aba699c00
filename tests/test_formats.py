import base64
import zlib

import numpy as np

from spectraloom.sources import formats as f


def test_mgf_round_trip(spark, tmp_path):
    text = "COM=x\nBEGIN IONS\nTITLE=a b=c\nPEPMASS=500.25 17\nCHARGE=2+\nRTINSECONDS=12.5\n100.5 7\n200.25\t8.5\nEND IONS\n\nBEGIN IONS\nTITLE=empty\nEND IONS\n"
    (tmp_path / "x.mgf").write_text(text)
    rows = f.read_mgf(spark, str(tmp_path / "x.mgf")).collect()
    assert [(r.title, r.precursor_mz, r.precursor_intensity, r.charge, r.rt, [tuple(p) for p in r.peaks]) for r in rows] == [("a b=c", 500.25, 17.0, 2, 12.5, [(100.5, 7.0), (200.25, 8.5)]), ("empty", None, None, None, None, [])]
    f.write_mgf(f.read_mgf(spark, str(tmp_path / "x.mgf")), str(tmp_path / "out"))
    again = f.read_mgf(spark, str(tmp_path / "out")).collect()
    assert sorted((r.title, r.charge, len(r.peaks)) for r in again) == [("a b=c", 2, 2), ("empty", None, 0)]
    assert [tuple(r) for r in f.explode_peaks(f.read_mgf(spark, str(tmp_path / "x.mgf"))).select("title", "peak_id", "mz").collect()] == [("a b=c", 0, 100.5), ("a b=c", 1, 200.25)]


def test_fasta_round_trip(spark, tmp_path):
    (tmp_path / "x.fasta").write_text(">P1 one protein\nACDEF\nGHIK*\n>P2\nMM\n")
    want = [("P1", "one protein", "ACDEFGHIK"), ("P2", "", "MM")]
    df = f.read_fasta(spark, str(tmp_path / "x.fasta"))
    assert [tuple(r) for r in df.collect()] == want
    f.write_fasta(df, str(tmp_path / "out"), 4)
    assert sorted(tuple(r) for r in f.read_fasta(spark, str(tmp_path / "out")).collect()) == want


def test_text_formats(spark, tmp_path):
    (tmp_path / "x.ms2").write_text("H\tx\ty\nS\t1\t1\t500.5\nI\tRTime\t3.5\nZ\t2\t1000\n100 5\n200 6\nS\t2\t2\t600.5\n")
    assert [(r.scan, r.precursor_mz, r.charges, r.rt, len(r.peaks)) for r in f.read_ms2(spark, str(tmp_path / "x.ms2")).collect()] == [(1, 500.5, [2], 3.5, 2), (2, 600.5, [], None, 0)]
    (tmp_path / "x.dta").write_text("1000.0 2\n100 5\n")
    (r,) = f.read_dta(spark, str(tmp_path / "x.dta")).collect()
    assert abs(r.precursor_mz - 500.503638) < 1e-5 and r.charge == 2 and len(r.peaks) == 1
    (tmp_path / "x.dta2d").write_text("#SEC\tMZ\tINT\n1.5 100.25 7\n 2 200 8\n")
    df = f.read_peak_table(spark, str(tmp_path / "x.dta2d"))
    assert [tuple(r) for r in df.collect()] == [(1.5, 100.25, 7.0), (2.0, 200.0, 8.0)]
    f.write_peak_table(df, str(tmp_path / "out"))
    assert f.read_peak_table(spark, str(tmp_path / "out")).count() == 2


def _array(kind, values, dtype, packed):
    raw = np.array(values, dtype).tobytes()
    bits = "MS:1000523" if dtype == "<f8" else "MS:1000521"
    return f'<binaryDataArray><cvParam accession="{bits}"/><cvParam accession="{"MS:1000574" if packed else "MS:1000576"}"/><cvParam accession="{kind}"/><binary>{base64.b64encode(zlib.compress(raw) if packed else raw).decode()}</binary></binaryDataArray>'


def test_mzml(spark, tmp_path):
    def one(i, packed, mz):
        return f'<spectrum index="{i}" id="scan={i}"><cvParam accession="MS:1000511" value="{i}"/><cvParam accession="MS:1000127"/><cvParam accession="MS:1000130"/><cvParam accession="MS:1000016" value="2" unitName="minute"/><cvParam accession="MS:1000744" value="500.5"/><binaryDataArrayList>{_array("MS:1000514", mz, "<f8", packed)}{_array("MS:1000515", [1] * len(mz), "<f4", packed)}</binaryDataArrayList></spectrum>'

    (tmp_path / "x.mzML").write_text("<mzML><run><spectrumList>" + one(1, True, [100.125, 200.25]) + one(2, False, []) + "</spectrumList></run></mzML>")
    rows = f.read_mzml(spark, str(tmp_path / "x.mzML")).collect()
    assert [(r.native_id, r.ms_level, r.rt, r.centroid, r.polarity, r.precursor_mz, [p.mz for p in r.peaks]) for r in rows] == [("scan=1", 1, 120.0, True, 1, 500.5, [100.125, 200.25]), ("scan=2", 2, 120.0, True, 1, 500.5, [])]


def test_xml_records(spark, tmp_path):
    (tmp_path / "x.featureXML").write_text('<featureMap><featureList><feature id="f_1"><position dim="0">10.5</position><position dim="1">500.25</position><intensity>1e4</intensity><overallquality>0.5</overallquality><charge>2</charge></feature><feature id="f_2"><intensity>3</intensity></feature></featureList></featureMap>')
    assert [tuple(r) for r in f.read_feature_xml(spark, str(tmp_path / "x.featureXML")).collect()] == [("f_1", 10.5, 500.25, 1e4, 2, 0.5), ("f_2", None, None, 3.0, None, None)]
    (tmp_path / "x.idXML").write_text('<IdXML><PeptideIdentification score_type="s" higher_score_better="true" MZ="500.5" RT="9"><PeptideHit score="1.5" sequence="PEPK" charge="2" protein_refs="A B"></PeptideHit></PeptideIdentification></IdXML>')
    (r,) = f.read_id_xml(spark, str(tmp_path / "x.idXML")).collect()
    assert (r.score_type, r.higher_better, r.mz, r.hits[0].sequence, r.hits[0].proteins) == ("s", True, 500.5, "PEPK", ["A", "B"])
