"""Places of peptides in proteins, ambiguous residues included, by seeds; and consensus of several searches."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Letters that stand for several residues.
AMBIGUOUS = {"B": "DN", "Z": "EQ", "J": "IL", "X": "ACDEFGHIKLMNPQRSTUVWYO"}
_LETTERS = "[BZJX]"


def _meets(protein: Column, peptide: Column) -> Column:
    """Whether a residue of the protein can be that of the peptide."""
    out = protein == peptide
    for k, v in AMBIGUOUS.items():
        out = out | ((protein == k) & F.instr(F.lit(v), peptide).cast("boolean")) if len(v) > 1 else out
    return out


def index_places(peptides: DataFrame, proteins: DataFrame, seed: int = 5, ambiguous: int = 3, same_il: bool = False, enzyme: str | None = None, specific: str = "full") -> DataFrame:
    """(peptide, accession, start, before, after): all places, overlapping ones too, of each peptide in each protein; start is from 1.

    A place may have up to `ambiguous` letters of AMBIGUOUS in the protein. before and after: the neighbouring residues, `[` and `]` at
    the ends. enzyme: a regular expression of the empty places where it cuts; specific: full, semi or none of a place's ends are to
    be cuts or ends of the protein. Peptides shorter than `seed` aren't looked for.

    Proteins and peptides meet by seeds: the first letters, with the ambiguous ones masked; a peptide has one seed for each set of at most
    `ambiguous` masked letters, a place in a protein has one. So no peptide meets a protein that doesn't share its seed."""
    swap = lambda c: F.translate(c, "IJ", "LL") if same_il else c
    p = proteins.select("accession", "sequence", swap(F.col("sequence")).alias("_q"))
    ends = F.sequence(F.lit(1), F.length("_q") - seed + 1)
    places = p.filter(F.length("_q") >= seed).select("accession", "sequence", "_q", F.explode(ends).alias("start"))
    places = places.withColumn("_seed", F.regexp_replace(F.substring("_q", F.col("start"), F.lit(seed)), _LETTERS, "*"))
    q = peptides.select("peptide").distinct().filter(F.length("peptide") >= seed).withColumn("_p", swap(F.col("peptide")))
    letters = [F.substring("_p", i + 1, 1) for i in range(seed)]
    masks = [m for n in range(min(ambiguous, seed) + 1) for m in combinations(range(seed), n)]
    seeds = F.array(*[F.concat(*[F.lit("*") if i in m else letters[i] for i in range(seed)]) for m in masks])
    q = q.withColumn("_seed", F.explode(F.array_distinct(seeds)))
    both = places.join(q, "_seed").withColumn("_n", F.length("_p")).filter(F.col("start") + F.col("_n") - 1 <= F.length("_q"))
    part = both.withColumn("_s", F.substring("_q", F.col("start"), F.col("_n")))
    exact = F.col("_s") == F.col("_p")
    few = F.length("_s") - F.length(F.regexp_replace("_s", _LETTERS, "")) <= ambiguous
    loose = few & F.forall(F.sequence(F.lit(1), F.col("_n")), lambda i: _meets(F.substring("_s", i, F.lit(1)), F.substring("_p", i, F.lit(1))))
    found = part.filter(exact | loose)
    before = F.when(F.col("start") > 1, F.substring("sequence", F.col("start") - 1, F.lit(1))).otherwise("[")
    after = F.when(F.col("start") + F.col("_n") <= F.length("sequence"), F.substring("sequence", F.col("start") + F.col("_n"), F.lit(1))).otherwise("]")
    if enzyme is not None and specific != "none":
        # a cut lies between two residues if the enzyme splits their pair
        cuts = lambda a, b: F.size(F.filter(F.split(F.concat(a, b), enzyme), lambda x: x != "")) > 1
        left = (F.col("start") == 1) | cuts(before, F.substring("sequence", F.col("start"), F.lit(1)))
        right = (F.col("start") + F.col("_n") > F.length("sequence")) | cuts(F.substring("sequence", F.col("start") + F.col("_n") - 1, F.lit(1)), after)
        found = found.filter(left & right if specific == "full" else left | right)
    return found.select("peptide", "accession", "start", before.alias("before"), after.alias("after"))


def consensus_scores(hits: DataFrame, how: str = "best", engines: str = "run_id", higher_better: bool = True, top: int = 10) -> DataFrame:
    """(spectrum_id, accession, score, n, share): one score of each candidate over the engines that list it.

    how: best, worst or average of each engine's best score; ranks: 1 - (mean rank - 1) / top, where an engine without the candidate
    counts as rank top + 1. n: engines that list it; share: n over the engines with hits of the spectrum."""
    pick = F.max if higher_better else F.min
    best = hits.groupBy("spectrum_id", engines, "accession").agg(pick("score").alias("_s"))
    of = best.groupBy("spectrum_id").agg(F.count_distinct(engines).alias("_all"))
    if how == "ranks":
        order = F.desc("_s") if higher_better else F.asc("_s")
        best = best.withColumn("_r", F.rank().over(Window.partitionBy("spectrum_id", engines).orderBy(order))).filter(F.col("_r") <= top)
        one = best.groupBy("spectrum_id", "accession").agg(F.sum("_r").alias("_r"), F.count("*").alias("n")).join(of, "spectrum_id")
        mean = (F.col("_r") + (F.col("_all") - F.col("n")) * (top + 1)) / F.col("_all")
        score = 1 - (mean - 1) / top
    else:
        use = {"best": pick, "worst": F.min if higher_better else F.max, "average": F.avg}[how]
        one = best.groupBy("spectrum_id", "accession").agg(use("_s").alias("_u"), F.count("*").alias("n")).join(of, "spectrum_id")
        score = F.col("_u")
    return one.select("spectrum_id", "accession", score.alias("score"), "n", (F.col("n") / F.col("_all")).alias("share"))


def switch_score(hits: DataFrame, new: str, kept_as: str = "old_score") -> DataFrame:
    """hits whose score is the column `new`; the one so far is kept under another name. Rows without the new score are errors, as a silent null would sort last."""
    if kept_as in hits.columns:
        raise ValueError(f"there is a column {kept_as} already")
    checked = F.when(F.col(new).isNotNull(), F.col(new)).otherwise(F.raise_error(F.lit(f"a hit has no {new}")).cast("double"))
    return hits.withColumn(kept_as, F.col("score")).withColumn("score", checked.cast("double")).drop(new)
