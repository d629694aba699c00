import pytest
from pyspark.sql import functions as F

from spectraloom.functions import chemistry as ch


def test_formulas():
    assert ch.parse_formula("C6H12O6") == {"C": 6, "H": 12, "O": 6}
    assert abs(ch.formula_mass("H2O") - 18.010565) < 1e-6
    p = ch.isotope_pattern("C100H150N25O30S")
    assert abs(sum(p) - 1) < 1e-12 and p[1] > p[0] > p[3]
    for bad in ("Xx2", "2H", "h2"):
        with pytest.raises(ValueError):
            ch.parse_formula(bad)


def test_peptides(spark):
    df = spark.createDataFrame([("PEPTIDEK",), ("",), ("KPRAK",)], "s string")
    a, b, c = df.select(ch.peptide_mass(F.col("s")).alias("m"), ch.isoelectric_point(F.col("s")).alias("pi"), ch.cut_tryptic(F.col("s")).alias("p"), ch.decoy_sequence(F.col("s")).alias("d")).collect()
    assert abs(a.m - 927.454942) < 1e-4 and b.m == 0 and a.d == "EDITPEPK"
    assert c.p == ["KPR", "AK"] and b.p == [] and c.pi > 9 > 5 > a.pi
