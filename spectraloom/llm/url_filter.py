"""URL filters: longest host and path rules, and glob rules by a bit-parallel wildcard automaton.

Each glob is a row of states, one more than it has symbols; all globs' states lie one after the other in the bits of a few
64-bit words. For all URLs of a batch at once, a character moves every state on (a shift by one bit over all words, masked by the
states that accept it: Shift-And), while the states before a ``*`` keep themselves. So a URL costs one step of a few word
operations per character, however many globs there are.
"""

from __future__ import annotations

import functools

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common as C

#: (verdict, host, path) of the rules that come before the globs.
RULES = (("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"), ("block", "net", "/es/"), ("block", "net", "/fr/"))
#: Globs over canonical URLs (host, path and query) to block: * is any run, ? any one byte.
GLOBS = ("*spam-farm*", "*cheap-pills*", "*casino*", "*free-bets*", "*ads-track*", "*adult-x*", "*/wp-login.php*", "*/cgi-bin/*", "*sessionid=????*", "*.exe")
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


class Globs:
    """The automaton of some globs; matches(raw, offs) tells which strings one of them matches whole."""

    def __init__(self, globs):
        accepts: list[set[int] | None] = []  # by state: bytes that lead here from the state before, None for a glob's first
        loop, start, final = [], [], []
        for g in globs:
            start.append(len(accepts))
            accepts.append(None)
            for c in g.encode():
                if c == ord("*"):
                    loop.append(len(accepts) - 1)
                else:
                    accepts.append(set(range(256)) if c == ord("?") else {c})
            final.append(len(accepts) - 1)
        self.words = max(1, -(-len(accepts) // 64))
        self.step = np.zeros((256, self.words), np.uint64)
        for s, some in enumerate(accepts):
            for c in some or ():
                self.step[c, s // 64] |= np.uint64(1 << (s % 64))
        self.loop, self.start, self.final = (self._bits(x) for x in (loop, start, final))

    def _bits(self, states) -> np.ndarray:
        out = np.zeros(self.words, np.uint64)
        for s in states:
            out[s // 64] |= np.uint64(1 << (s % 64))
        return out

    def matches(self, raw: np.ndarray, offs: np.ndarray) -> np.ndarray:
        size = np.diff(offs)
        order = np.argsort(-size, kind="stable")  # the longest first: the strings still running are a prefix
        at, size = offs[:-1][order], size[order]
        state = np.tile(self.start, (len(order), 1))
        left = len(order)
        for k in range(int(size[0]) if len(size) else 0):
            left = int(np.searchsorted(-size[:left], -k, "left"))  # those longer than k
            now = state[:left]
            moved = now << np.uint64(1)
            if self.words > 1:
                moved[:, 1:] |= now[:, :-1] >> np.uint64(63)
            state[:left] = (moved & self.step[raw[at[:left] + k]]) | (now & self.loop)
        out = np.empty(len(order), bool)
        out[order] = (state & self.final).any(axis=1)
        return out


@functools.cache
def _globs(globs: tuple) -> Globs:
    return Globs(globs)


def _match(globs: tuple):
    def run(batches):
        g = _globs(globs)
        for b in batches:
            raw, offs = C.buffers(b.column(b.num_columns - 1))
            hit = np.concatenate([np.zeros(0, bool), *(g.matches(raw[offs[i] : offs[j]], offs[i : j + 1] - offs[i]) for i, j in C.steps(offs))])
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(hit)], names=[*b.schema.names[:-1], "_hit"])

    return run


def split_url(url: Column) -> tuple[Column, Column, Column]:
    """Host (A-Z lower-cased), path and query (with its ?) after the first ://; all empty if there is none."""
    at = F.instr(url, "://")
    rest = F.coalesce(F.when(at > 0, F.substring(url, at + 3, F.length(url))), F.lit(""))
    host = F.translate(F.regexp_extract(rest, r"^[^/?#]*", 0), _UPPER, _LOWER)
    return host, F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1), F.regexp_extract(rest, r"^[^?#]*(\?[^#]*)", 1)


def judge(pages: DataFrame, url: str = "url", rules: tuple = RULES, globs: tuple = GLOBS) -> DataFrame:
    """pages with host, path, rule (like ``net/es/``; null if none fits) and verdict (allow or block).

    A rule fits its host and all subdomains if the path starts with the rule's; the longest that fits decides (of equally long ones
    the first). Else a glob that matches the canonical URL (lower-case host, path, query; no scheme or fragment) blocks. A
    null URL and one without :// have an empty host and path, and meet the globs as the empty string. Other columns
    pass unchanged; those named like the added ones are replaced. An empty table gives an empty one.
    """
    added = ("host", "path", "rule", "verdict")
    keep = [c for c in pages.columns if c.lower() not in added]
    host, path, query = split_url(pages[url])
    src = pages.select(*[pages[c].alias(f"_c{i}") for i, c in enumerate(keep)], host.alias("_host"), path.alias("_path"), F.concat(host, path, query).alias("_url"))
    types = dict(src.dtypes)
    hit = src.transform(C.map_batches, _match(tuple(globs)), ", ".join([*(f"{c} {types[c]}" for c in src.columns[:-1]), "_hit boolean"]))
    rule = verdict = None
    for v, h, p in sorted(rules, key=lambda r: -len(r[1] + r[2])):
        fits = ((F.col("_host") == h) | F.col("_host").endswith("." + h)) & F.col("_path").startswith(p)
        rule = (F if rule is None else rule).when(fits, h + p)
        verdict = (F if verdict is None else verdict).when(fits, v)
    other = F.when(F.col("_hit"), "block").otherwise("allow")
    return hit.select(*[F.col(f"_c{i}").alias(c) for i, c in enumerate(keep)], F.col("_host").alias("host"), F.col("_path").alias("path"), (rule if rule is not None else F.lit(None).cast("string")).alias("rule"), (verdict.otherwise(other) if verdict is not None else other).alias("verdict"))


def op10_url_filter(spark, sf_dir: str) -> DataFrame:
    return judge(spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url")).select("page_id", "host", "path", "rule", "verdict")


def _like(glob: str) -> str:
    return "u LIKE '" + glob.replace("%", "!%").replace("_", "!_").replace("*", "%").replace("?", "_") + "' ESCAPE '!'"


def _sql() -> str:
    fits = [(f"(host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{p}')", v, h + p) for v, h, p in sorted(RULES, key=lambda r: -len(r[1] + r[2]))]
    rule = "CASE " + " ".join(f"WHEN {f} THEN '{r}'" for f, _, r in fits) + " END"
    verdict = "CASE " + " ".join(f"WHEN {f} THEN '{v}'" for f, v, _ in fits) + f" WHEN {' OR '.join(map(_like, GLOBS))} THEN 'block' ELSE 'allow' END"
    return f"""
WITH rest AS (SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS r FROM pages),
parts AS (SELECT page_id, translate(regexp_extract(r, '^[^/?#]*'), '{_UPPER}', '{_LOWER}') AS host, regexp_extract(r, '^[^/?#]*([^?#]*)', 1) AS path,
  regexp_extract(r, '^[^?#]*(\\?[^#]*)', 1) AS query FROM rest),
urls AS (SELECT *, host || path || query AS u FROM parts)
SELECT page_id, host, path, {rule} AS rule, {verdict} AS verdict FROM urls"""


SQL = _sql()
