import random

from spectraloom.functions.peptides import ENZYMES
from spectraloom.operators.indexing import AMBIGUOUS, index_places, switch_score


def brute(peptides, proteins, most, same_il):
    out = set()
    swap = lambda s: s.replace("I", "L").replace("J", "L") if same_il else s
    for p in set(peptides):
        if len(p) < 5:
            continue
        for a, s in proteins:
            for i in range(len(s) - len(p) + 1):
                part = swap(s[i : i + len(p)])
                ok = all(x == y or y in AMBIGUOUS.get(x, "") for x, y in zip(part, swap(p)))
                if ok and (part == swap(p) or sum(x in "BZJX" for x in part) <= most):
                    out.add((p, a, i + 1, s[i - 1] if i else "[", s[i + len(p)] if i + len(p) < len(s) else "]"))
    return out


def test_places_as_brute_force(spark):
    rng = random.Random(5)
    proteins = [(a, "".join(rng.choice("DNEQILKA" if rng.random() < 0.85 else "BZJX") for _ in range(rng.randint(0, 60)))) for a in range(60)]
    peptides = ["".join(rng.choice("DNEQILKA") for _ in range(rng.randint(4, 8))) for _ in range(150)] + ["AAAAA"]
    proteins += [(100, "AAAAAAA"), (101, "")]
    pep, pro = spark.createDataFrame([(p,) for p in peptides], "peptide string"), spark.createDataFrame(proteins, "accession long, sequence string")
    for most, il in ((3, False), (0, False), (2, True)):
        got = [tuple(r) for r in index_places(pep, pro, ambiguous=most, same_il=il).collect()]
        assert len(got) == len(set(got)) and set(got) == brute(peptides, proteins, most, il)


def test_specificity(spark):
    pro = spark.createDataFrame([(1, "MAAAKCCCCCRPGGGGGKEEEEE")], "accession long, sequence string")
    pep = spark.createDataFrame([(p,) for p in ("CCCCCRPGGGGGK", "CCCCC", "PGGGGGK", "AKCCCCC", "EEEEE")], "peptide string")
    names = lambda kind: {r.peptide for r in index_places(pep, pro, enzyme=ENZYMES["Trypsin"], specific=kind).collect()}
    assert names("full") == {"CCCCCRPGGGGGK", "EEEEE"}
    assert names("semi") == {"CCCCCRPGGGGGK", "EEEEE", "CCCCC", "PGGGGGK"}
    assert len(names("none")) == 5


def test_switch_score(spark):
    df = spark.createDataFrame([(1, 2.0, 0.5)], "hit_id long, score double, pep double")
    assert switch_score(df, "pep").first().asDict() == {"hit_id": 1, "score": 0.5, "old_score": 2.0}
