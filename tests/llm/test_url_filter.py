import random
import re

import pyarrow as pa

from spectraloom.llm import common as C
from spectraloom.llm.url_filter import Globs, judge


def test_automaton_as_regular_expressions():
    rng = random.Random(3)
    pick = lambda some, n: "".join(rng.choice(some) for _ in range(rng.randint(0, n)))
    for _ in range(60):
        globs = [pick("ab*?", 7) for _ in range(rng.randint(0, 30))]
        texts = [pick("abc", 9) for _ in range(80)]
        res = [re.compile(g.replace("*", ".*").replace("?", "."), re.S) for g in globs]
        got = Globs(globs).matches(*C.buffers(pa.array(texts, pa.string())))
        assert got.tolist() == [any(r.fullmatch(t) for r in res) for t in texts]


def test_rules(spark):
    urls = ["https://Example.COM/en/1", "http://www.example.com/en/", "http://a.www.example.com/en/x?y#z", "http://example.com/fr/", "http://notexample.com/en/", "http://x.net/es/1", "http://x.net/es", "net/es/", None, "", "://", "http://com", "http://evil.org/spam-farm", "http://evil.org/?cheap-pills", "http://evil.org/#casino", "http://x.org/" + "a" * 200000 + ".exe"]
    df = spark.createDataFrame([(i, u, 1, "old") for i, u in enumerate(urls)], "page_id long, url string, _host int, Verdict string")
    got = judge(df)
    assert got.columns == ["page_id", "url", "_host", "host", "path", "rule", "verdict"]
    got = {r.page_id: (r.host, r.rule, r.verdict) for r in got.collect()}
    want = ["example.com/en/ block", "www.example.com/en/ allow", "www.example.com/en/ allow", "com/ allow", "com/ allow", "net/es/ block", "None allow", "None allow", "None allow", "None allow", "None allow", "None allow", "None block", "None block", "None allow", "None block"]
    assert [f"{got[i][1]} {got[i][2]}" for i in range(len(urls))] == want
    assert got[0][0] == "example.com" and got[8][0] == "" and got[11][0] == "com"


def test_empty_table(spark):
    assert judge(spark.createDataFrame([], "page_id long, url string")).collect() == []
