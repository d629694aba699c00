"""ProForma notation of modified peptides: parsing, writing and masses; and fine isotope structure of formulas."""

from __future__ import annotations

import heapq
import math
import re

import pyarrow as pa
from pyspark.sql import DataFrame

from . import chemistry as ch
from . import peptides as pe

#: Names of common modifications without their residue, and accessions of the same.
_NAMES = {"Acetyl": 42.010565, "Methyl": 14.01565, "Dimethyl": 28.0313, "Trimethyl": 42.04695, "Phospho": 79.966331, "Oxidation": 15.994915, "Deamidated": 0.984016, "Carbamidomethyl": 57.021464, "Carbamyl": 43.005814, "Amidated": -0.984016, "GG": 114.042927, "Gln->pyro-Glu": -17.026549, "Glu->pyro-Glu": -18.010565, "TMT6plex": 229.162932}
_ACCESSIONS = {"1": "Acetyl", "4": "Carbamidomethyl", "5": "Carbamyl", "7": "Deamidated", "21": "Phospho", "34": "Methyl", "35": "Oxidation", "36": "Dimethyl", "37": "Trimethyl", "121": "GG", "737": "TMT6plex"}


class ProFormaError(ValueError):
    pass


def _closing(s: str, at: int, pair: str) -> int:
    """The place after the bracket that closes the one at `at`."""
    depth = 0
    for k in range(at, len(s)):
        depth += (s[k] == pair[0]) - (s[k] == pair[1])
        if depth == 0:
            return k + 1
    raise ProFormaError(f"{pair[0]} isn't closed: {s!r}")


def modification_mass(text: str) -> float:
    """Mass of what stands in brackets: of alternatives by `|` the first one that has a mass."""
    for one in text.split("|"):
        one = one.split("#", 1)[0].strip()
        if m := re.fullmatch(r"(?:[UMRXGC]:|Obs:)?([-+]\d+(?:\.\d+)?)", one, re.I):
            return float(m[1])
        if m := re.fullmatch(r"Formula:(.+)", one, re.I):
            return ch.formula_mass(re.sub(r"\s", "", m[1]))
        if m := re.fullmatch(r"UNIMOD:(\d+)", one, re.I):
            one = _ACCESSIONS.get(m[1], one)
        one = re.sub(r"^[UM]:", "", one)
        for table in (_NAMES, {k: v for k, (_, v) in pe.MODIFICATIONS.items()}):
            if one in table:
                return table[one]
    raise ProFormaError(f"no mass is known for {text!r}")


def parse(text: str) -> dict:
    """sequence, charge, n_term, c_term, labile, unknown: lists of bracket texts; modifications: (first, last, text), residues from 0;
    everywhere: (text, residues) of fixed modifications."""
    s, at = text.strip(), 0
    out: dict = {"sequence": "", "charge": None, "n_term": [], "c_term": [], "labile": [], "unknown": [], "modifications": [], "everywhere": []}
    while at < len(s) and s[at] == "<":
        end = _closing(s, at, "<>")
        body = s[at + 1 : end - 1]
        if m := re.fullmatch(r"\[(.*)\]@([A-Z](?:,[A-Z])*)", body):
            out["everywhere"].append((m[1], m[2].split(",")))
        else:
            raise ProFormaError(f"isotope labels aren't supported: {body!r}")
        at = end
    while at < len(s) and s[at] == "{":
        end = _closing(s, at, "{}")
        out["labile"].append(s[at + 1 : end - 1])
        at = end
    front: list[str] = []
    while at < len(s) and s[at] == "[":
        end = _closing(s, at, "[]")
        times = re.compile(r"\^(\d+)").match(s, end)
        front += [s[at + 1 : end - 1]] * (int(times[1]) if times else 1)
        at = times.end() if times else end
        if at < len(s) and s[at] == "?":
            out["unknown"], front, at = out["unknown"] + front, [], at + 1
        elif at < len(s) and s[at] == "-":
            out["n_term"], front, at = front, [], at + 1
    if front:
        raise ProFormaError(f"a modification before the first residue needs - or ?: {text!r}")
    open_ = None
    while at < len(s):
        c = s[at]
        if c == "(" and open_ is None:
            open_, at = len(out["sequence"]), at + 1
        elif c == ")" and open_ is not None:
            at += 1
            while at < len(s) and s[at] == "[":
                end = _closing(s, at, "[]")
                out["modifications"].append((open_, len(out["sequence"]) - 1, s[at + 1 : end - 1]))
                at = end
            open_ = None
        elif c.isascii() and c.isupper():
            out["sequence"] += c
            at += 1
            while at < len(s) and s[at] == "[":
                end = _closing(s, at, "[]")
                k = len(out["sequence"]) - 1
                out["modifications"].append((k, k, s[at + 1 : end - 1]))
                at = end
        elif c == "-" and at + 1 < len(s) and s[at + 1] == "[":
            at += 1
            while at < len(s) and s[at] == "[":
                end = _closing(s, at, "[]")
                out["c_term"].append(s[at + 1 : end - 1])
                at = end
        elif m := re.compile(r"/(-?\d+)$").match(s, at):
            out["charge"], at = int(m[1]), m.end()
        else:
            raise ProFormaError(f"unexpected {s[at:]!r} in {text!r}")
    if open_ is not None or not out["sequence"]:
        raise ProFormaError(f"no peptide: {text!r}")
    return out


def write(p: dict) -> str:
    """The notation of what parse() gives."""
    box = lambda xs: "".join(f"[{x}]" for x in xs)
    out = "".join(f"<[{t}]@{','.join(r)}>" for t, r in p["everywhere"]) + "".join(f"{{{x}}}" for x in p["labile"])
    out += box(p["unknown"]) + ("?" if p["unknown"] else "") + (box(p["n_term"]) + "-" if p["n_term"] else "")
    spans: dict[tuple, list] = {}
    for a, b, t in p["modifications"]:
        spans.setdefault((a, b), []).append(t)
    for i, c in enumerate(p["sequence"]):
        out += "(" if any(a == i and b > a for a, b in spans) else ""
        out += c + box(spans.get((i, i), []))
        for (a, b), ts in spans.items():
            if b == i and a < b:
                out += ")" + box(ts)
    return out + ("-" + box(p["c_term"]) if p["c_term"] else "") + (f"/{p['charge']}" if p["charge"] is not None else "")


def mass(p: dict) -> float:
    """Neutral monoisotopic mass; labile modifications count, as they are part of the molecule."""
    if unknown := set(p["sequence"]) - set(ch.RESIDUES):
        raise ProFormaError(f"no mass for {sorted(unknown)}")
    out = sum(ch.RESIDUES[c] for c in p["sequence"]) + ch.WATER
    seen: set[str] = set()
    for t in [*p["n_term"], *p["c_term"], *p["labile"], *p["unknown"], *(t for _, _, t in p["modifications"])]:
        group = re.search(r"#([\w]+)", t)
        if group and group[1] in seen:  # another possible place of the same modification
            continue
        if group:
            seen.add(group[1])
        out += modification_mass(t)
    return out + sum(modification_mass(t) * p["sequence"].count(r) for t, rs in p["everywhere"] for r in rs)


def parse_proforma(df: DataFrame, column: str = "proforma") -> DataFrame:
    """df with sequence, charge, mass, mz, n_modified and error (text of what is wrong, else null); in Arrow batches."""
    keep = df.columns

    def run(batches):
        for b in batches:
            rows = []
            for x in b.column(keep.index(column)).to_pylist():
                try:
                    p = parse(x or "")
                    m, z = mass(p), p["charge"]
                    n = len(p["modifications"]) + len(p["n_term"]) + len(p["c_term"]) + len(p["unknown"]) + len(p["labile"])
                    rows.append((p["sequence"], z, m, m / abs(z) + math.copysign(ch.PROTON, z) if z else None, n, None))
                except ValueError as e:
                    rows.append((None, None, None, None, None, str(e)))
            new = [pa.array(list(c), k) for c, k in zip(zip(*rows) if rows else [[]] * 6, (pa.string(), pa.int32(), pa.float64(), pa.float64(), pa.int32(), pa.string()))]
            yield pa.RecordBatch.from_arrays([*b.columns, *new], names=[*keep, "sequence", "charge", "mass", "mz", "n_modified", "error"])

    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema), "sequence string, charge int, mass double, mz double, n_modified int, error string"])
    return df.mapInArrow(run, schema)


# ---------------------------------------------------------------- fine structure


#: Exact masses of the isotopes of the commonest atoms, as far as they are needed beside ATOMS' offsets.
_EXACT = {"H": (1.00782503207, 2.0141017778), "C": (12.0, 13.0033548378), "N": (14.0030740048, 15.0001088982), "O": (15.99491461956, 16.9991317, 17.999161), "S": (31.972071, 32.97145876, 33.9678669, 35.96708076), "P": (30.97376163,)}


def fine_isotopes(formula: str, threshold: float = 1e-4) -> list[tuple[float, float]]:
    """(mass, abundance) of all isotopologues of at least that abundance, by mass; isotopologues of an atom are counted by how many of each
    isotope there are. Each atom's are found from the likeliest outwards, and no product below the threshold is followed."""
    parts = []
    for atom, n in ch.parse_formula(formula).items():
        if atom not in _EXACT or n < 0:
            raise ValueError(f"no exact isotopes of {atom}")
        mass_, share = _EXACT[atom], [a for _, a in ch.ATOMS[atom][1]]
        logs = [math.log(a) for a in share]

        def log_chance(k: tuple) -> float:
            return math.lgamma(sum(k) + 1) + sum(x * q - math.lgamma(x + 1) for x, q in zip(k, logs))

        top = [int(n * a) for a in share]
        top[0] += n - sum(top)
        start = tuple(top)
        heap, seen, own = [(-log_chance(start), start)], {start}, []
        # from the start, hill-climbing order: neighbours move one atom from an isotope to another
        best = -math.inf
        while heap:
            c, k = heapq.heappop(heap)
            best = max(best, -c)
            if -c < math.log(threshold) and -c < best - 1e-12:
                continue
            own.append((sum(x * m for x, m in zip(k, mass_)), math.exp(-c)))
            for i in range(len(k)):
                for j in range(len(k)):
                    if i != j and k[i]:
                        new = list(k)
                        new[i] -= 1
                        new[j] += 1
                        if (t := tuple(new)) not in seen:
                            seen.add(t)
                            heapq.heappush(heap, (-log_chance(t), t))
        parts.append([x for x in own if x[1] >= threshold])
    out = [(0.0, 1.0)]
    for own in parts:
        out = [(m + a, p * q) for m, p in out for a, q in own if p * q >= threshold]
    return sorted(out)
