import itertools
import math

import pytest

from spectraloom.functions import chemistry as ch
from spectraloom.functions import proforma as pf

PEPTIDE = sum(ch.RESIDUES[c] for c in "PEPTIDE") + ch.WATER


@pytest.mark.parametrize("text, more, n", [
    ("PEPTIDE", 0, 0), ("PEPT[Phospho]IDE/2", 79.966331, 1), ("[Acetyl]-PEPTIDE-[Amidated]", 42.010565 - 0.984016, 2), ("PEPT[+79.966]IDE", 79.966, 1), ("PEPT[U:Phospho|info:x]IDE", 79.966331, 1),
    ("PEPT[UNIMOD:21]IDE", 79.966331, 1), ("[Phospho]?PEPTIDE", 79.966331, 1), ("[Oxidation]^2?PEPTIDE", 2 * 15.994915, 2), ("{Phospho}PEPTIDE", 79.966331, 1), ("PE(PTI)[Oxidation]DE", 15.994915, 1),
    ("PEPT[Phospho#g1]IDE[#g1]", 79.966331, 2), ("<[+1.5]@E,D>PEPTIDE", 4.5, 0), ("PEPT[Formula:C2H2O]IDE", ch.formula_mass("C2H2O"), 1),
])
def test_masses(text, more, n):
    p = pf.parse(text)
    assert p["sequence"] == "PEPTIDE" and pf.write(p) in (text, text.replace("^2", "").replace("[Oxidation]?", "[Oxidation][Oxidation]?"))
    assert abs(pf.mass(p) - PEPTIDE - more) < 1e-6
    assert len(p["modifications"]) + len(p["n_term"]) + len(p["c_term"]) + len(p["unknown"]) + len(p["labile"]) == n


@pytest.mark.parametrize("text", ["", "PEP[TIDE", "[Acetyl]PEPTIDE", "PEP TIDE", "PEPT[Nonsense]IDE", "<13C>PEPTIDE", "PE(PTIDE", "PEPTIDEB"])
def test_errors(text):
    with pytest.raises(pf.ProFormaError):
        pf.mass(pf.parse(text))


def test_column(spark):
    df = spark.createDataFrame([(1, "PEPT[Phospho]IDE/2"), (2, None), (3, "P[")], "id long, proforma string")
    got = {r.id: r for r in pf.parse_proforma(df).collect()}
    assert got[1].charge == 2 and abs(got[1].mz - ((PEPTIDE + 79.966331) / 2 + ch.PROTON)) < 1e-6 and got[1].error is None
    assert got[2].error and got[3].error and got[3].mass is None


def test_fine_isotopes_as_brute_force():
    atoms = {"C": 6, "H": 3, "O": 2}
    lists = {a: [(m, p) for m, (_, p) in zip(pf._EXACT[a], ch.ATOMS[a][1])] for a in atoms}
    want: dict = {}
    for counts in itertools.product(*[[c for c in itertools.product(range(n + 1), repeat=len(lists[a])) if sum(c) == n] for a, n in atoms.items()]):
        p, m = 1.0, 0.0
        for (a, n), c in zip(atoms.items(), counts):
            p *= math.factorial(n)
            for k, (mass, share) in zip(c, lists[a]):
                p *= share**k / math.factorial(k)
                m += k * mass
        if p >= 1e-4:
            want[counts] = (m, p)
    got = pf.fine_isotopes("C6H3O2", 1e-4)
    assert len(got) == len(want)
    for (m, p), (a, b) in zip(got, sorted(want.values())):
        assert abs(m - a) < 1e-9 and abs(p / b - 1) < 1e-9
    big = pf.fine_isotopes("C500H800N130O150S5", 1e-3)
    assert 0.3 < sum(p for _, p in big) <= 1 and abs(max(big, key=lambda x: x[1])[0] - 11000) < 600
