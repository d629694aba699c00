"""Peptide chemistry as column expressions: composition by counting letters, so all of it stays in generated code."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PROTON, WATER = 1.007276466, 18.010564684
#: Monoisotopic masses of residues.
RESIDUES = {
    "G": 57.02146374, "A": 71.03711381, "S": 87.03202843, "P": 97.05276388, "V": 99.06841395, "T": 101.04767849, "C": 103.00918451, "L": 113.08406401, "I": 113.08406401, "N": 114.04292747,
    "D": 115.02694307, "Q": 128.05857754, "K": 128.09496305, "E": 129.04259312, "M": 131.04048464, "H": 137.0589119, "F": 147.06841395, "R": 156.10111105, "Y": 163.06332857, "W": 186.07931299,
}
#: Hydropathy by Kyte and Doolittle.
HYDROPATHY = {
    "A": 1.8, "R": -4.5, "N": -3.5, "D": -3.5, "C": 2.5, "Q": -3.5, "E": -3.5, "G": -0.4, "H": -3.2, "I": 4.5, "L": 3.8, "K": -3.9, "M": 1.9, "F": 2.8, "P": -1.6, "S": -0.8, "T": -0.7, "W": -0.9, "Y": -1.3, "V": 4.2,
}
#: Charged groups: pK, charge when ionised.
_PK = {"K": (10.4, 1), "R": (12.0, 1), "H": (6.5, 1), "D": (3.9, -1), "E": (4.3, -1), "C": (8.3, -1), "Y": (10.1, -1)}
_PK_ENDS = ((8.0, 1), (3.6, -1))
#: Atoms: monoisotopic mass, isotopes as (offset, abundance).
ATOMS = {
    "H": (1.00782503207, ((0, 0.999885), (1, 0.000115))), "C": (12.0, ((0, 0.9893), (1, 0.0107))), "N": (14.0030740048, ((0, 0.99632), (1, 0.00368))),
    "O": (15.99491461956, ((0, 0.99757), (1, 0.00038), (2, 0.00205))), "S": (31.972071, ((0, 0.9493), (1, 0.0076), (2, 0.0429), (4, 0.0002))), "P": (30.97376163, ((0, 1.0),)),
    "Na": (22.9897692809, ((0, 1.0),)), "K": (38.96370668, ((0, 0.932581), (1, 0.000117), (2, 0.067302))), "Cl": (34.96885268, ((0, 0.7576), (2, 0.2424))), "Fe": (55.9349375, ((-2, 0.05845), (0, 0.91754), (1, 0.02119), (2, 0.00282))),
    "Li": (7.01600455, ((-1, 0.0759), (0, 0.9241))), "B": (11.0093054, ((-1, 0.199), (0, 0.801))), "F": (18.99840322, ((0, 1.0),)), "Mg": (23.9850417, ((0, 0.7899), (1, 0.1), (2, 0.1101))), "Al": (26.98153863, ((0, 1.0),)),
    "Si": (27.9769265325, ((0, 0.92223), (1, 0.04685), (2, 0.03092))), "Ca": (39.96259098, ((0, 0.96941), (2, 0.00647), (3, 0.00135), (4, 0.02086), (6, 0.00004), (8, 0.00187))), "Mn": (54.9380451, ((0, 1.0),)), "Co": (58.933195, ((0, 1.0),)),
    "Cu": (62.9295975, ((0, 0.6915), (2, 0.3085))), "Zn": (63.9291422, ((0, 0.48268), (2, 0.27975), (3, 0.04102), (4, 0.19024), (6, 0.00631))), "As": (74.9215965, ((0, 1.0),)),
    "Se": (79.9165213, ((-6, 0.0089), (-4, 0.0937), (-3, 0.0763), (-2, 0.2377), (0, 0.4961), (2, 0.0873))), "Br": (78.9183371, ((0, 0.5069), (2, 0.4931))), "I": (126.904473, ((0, 1.0),)),
}


def count(sequence: Column, letter: str) -> Column:
    return F.length(sequence) - F.length(F.replace(sequence, F.lit(letter), F.lit("")))


def weighted(sequence: Column, weights: dict[str, float]) -> Column:
    out = F.lit(0.0)
    for k, v in weights.items():
        out = out + count(sequence, k) * F.lit(v)
    return out


def peptide_mass(sequence: Column) -> Column:
    """Monoisotopic mass of an unmodified peptide; 0 without residues. Other letters count nothing."""
    return F.when(F.length(sequence) > 0, weighted(sequence, RESIDUES) + WATER).otherwise(0.0)


def mz(mass: Column, charge: Column) -> Column:
    return mass / charge + PROTON


def gravy(sequence: Column) -> Column:
    """Mean hydropathy; null for an empty sequence."""
    return F.when(F.length(sequence) > 0, weighted(sequence, HYDROPATHY) / F.length(sequence))


def net_charge(sequence: Column, ph: float) -> Column:
    part = lambda pk, z: z / (1 + 10.0 ** (z * (ph - pk)))
    return weighted(sequence, {k: part(*v) for k, v in _PK.items()}) + sum(part(*v) for v in _PK_ENDS)


def isoelectric_point(sequence: Column, steps: int = 14) -> Column:
    """pH without net charge, by bisection from 0 to 14 in a fold over the steps."""
    counts = F.array(*[count(sequence, k) for k in _PK], F.lit(1), F.lit(1))
    groups = [*_PK.values(), *_PK_ENDS]

    def charge(ph: Column) -> Column:
        out = F.lit(0.0)
        for i, (pk, z) in enumerate(groups):
            out = out + counts[i] * (F.lit(float(z)) / (1 + F.pow(F.lit(10.0), (ph - pk) * z)))
        return out

    start = F.struct(F.lit(0.0).alias("a"), F.lit(14.0).alias("b"))

    def halve(s: Column, _: Column) -> Column:
        mid = (s["a"] + s["b"]) / 2
        return F.when(charge(mid) > 0, F.struct(mid.alias("a"), s["b"].alias("b"))).otherwise(F.struct(s["a"].alias("a"), mid.alias("b")))

    return F.aggregate(F.sequence(F.lit(1), F.lit(steps)), start, halve, lambda s: (s["a"] + s["b"]) / 2)


def cut_tryptic(sequence: Column) -> Column:
    """Fully cleaved peptides, in order: after K or R, but not before P."""
    cut = F.regexp_replace(sequence, "([KR])", "$1|")
    return F.filter(F.split(F.replace(cut, F.lit("|P"), F.lit("P")), "[|]"), lambda x: x != "")


def digest(proteins: DataFrame, missed: int = 0, shortest: int = 1, longest: int = 10**6) -> DataFrame:
    """(accession, peptide, start, missed): peptides of up to `missed` missed cleavages; start counts parts from 0."""
    parts = proteins.select("accession", cut_tryptic(F.col("sequence")).alias("p"))
    at = parts.select("accession", "p", F.posexplode("p").alias("start", "_first")).select("accession", "p", "start", F.explode(F.sequence(F.lit(0), F.lit(missed))).alias("missed")).filter(F.col("start") + F.col("missed") < F.size("p"))
    peptide = F.array_join(F.slice("p", F.col("start") + 1, F.col("missed") + 1), "")
    return at.select("accession", peptide.alias("peptide"), "start", "missed").filter(F.length("peptide").between(shortest, longest))


def fragment_ions(peptides: DataFrame, charge: int = 1) -> DataFrame:
    """(peptide, ion, position, mz) of the b and y series."""
    n = F.length("peptide")
    at = peptides.filter(n > 1).select("peptide", F.explode(F.sequence(F.lit(1), n - 1)).alias("position"))
    b = weighted(F.substring("peptide", F.lit(1), F.col("position")), RESIDUES)
    y = weighted(F.substring("peptide", F.length("peptide") - F.col("position") + 1, F.col("position")), RESIDUES) + WATER
    ion = lambda name, mass: F.struct(F.lit(name).alias("ion"), ((mass + charge * PROTON) / charge).alias("mz"))
    return at.select("peptide", "position", F.inline(F.array(ion("b", b), ion("y", y))))


def decoy_sequence(sequence: Column, keep_end: bool = True) -> Column:
    """Reversed sequence; keep_end leaves the last residue in place (pseudo-reverse)."""
    if not keep_end:
        return F.reverse(sequence)
    return F.concat(F.reverse(F.substring(sequence, F.lit(1), F.greatest(F.length(sequence) - 1, F.lit(0)))), F.substring(sequence, -1, 1))


def parse_formula(formula: str) -> dict[str, int]:
    """Atoms of a formula such as C6H12O6 or Na2SO4; negative counts are allowed."""
    out: dict[str, int] = {}
    if not re.fullmatch(r"([A-Z][a-z]?-?\d*)*", formula):
        raise ValueError(f"no formula: {formula!r}")
    for atom, n in re.findall(r"([A-Z][a-z]?)(-?\d*)", formula):
        if atom not in ATOMS:
            raise ValueError(f"unknown atom: {atom}")
        out[atom] = out.get(atom, 0) + int(n or 1)
    return {k: v for k, v in out.items() if v}


def formula_mass(formula: str) -> float:
    return sum(ATOMS[a][0] * n for a, n in parse_formula(formula).items())


def isotope_pattern(formula: str, peaks: int = 6) -> list[float]:
    """Abundances at 0, 1, .. mass units above the monoisotopic peak, by repeated squaring; they sum to 1."""
    import numpy as np

    total = np.ones(1)
    for atom, n in parse_formula(formula).items():
        base = np.zeros(peaks)
        for off, a in ATOMS[atom][1]:
            if 0 <= off < peaks:
                base[off] += a
        power = np.ones(1)
        while n > 0:
            if n & 1:
                power = np.convolve(power, base)[:peaks]
            base = np.convolve(base, base)[:peaks]
            n >>= 1
        total = np.convolve(total, power)[:peaks]
    total = np.pad(total, (0, peaks - len(total)))
    return (total / total.sum()).tolist()
