import random
from collections import Counter, defaultdict

from pyspark.sql import functions as F

from spectraloom.llm.mixing import mix, mixed_documents, n_words, schedule_slots


def targets(sizes, weights=(1, 2, 3), cap=3):
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    w = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    cut, free, total = {}, set(order), sum(sizes.values())
    while True:
        left = total - sum(cut.values())
        share = {s: left * w[s] / sum(w[x] for x in free) for s in free}
        over = [s for s in free if share[s] > cap * sizes[s] + 1e-9]
        if not over:
            return cut | share
        for s in over:
            cut[s] = cap * sizes[s]
            free.discard(s)


def docs_of(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string, source string, size int").coalesce(3)


def test_mix(spark):
    rng = random.Random(4)
    rows = [(1, None, "b", 1), (1, None, "b", 1), (2, "", None, 0), (3, " \n ", "empty", 0)]
    for i in range(400):
        s = rng.choices(["a", "b", "é", None, "tiny", "Z"], [50, 20, 5, 5, 1, 30])[0]
        rows.append((i % 350, " \t".join("w" * rng.randint(1, 3) for _ in range(rng.choice([0, 1, 40, 400]))), s, 9))
    df = docs_of(spark, rows)
    sizes = Counter()
    for _, t, s, _ in rows:
        sizes[s] += len((t or "").encode().split())
    want = targets(sizes)
    schedule, found = mix(df)
    found = {r._key: r for r in found.collect()}
    assert len(found) == len(rows)
    for r in found.values():
        assert r.source_size == sizes[r.source] and abs(r.target - want[r.source]) < 1e-6 * max(1, want[r.source])
    got = schedule.collect()
    taken, by_source, covered = Counter(), Counter(), defaultdict(list)
    for r in got:
        taken[r._key] += r.end - r.start
        by_source[r.source] += r.end - r.start
        covered[r._key, r["pass"]].append((r.start, r.end))
    for s in sizes:
        assert by_source[s] == round(want[s])
    for k, n in taken.items():
        assert n <= 3 * found[k].size
    for spans in covered.values():  # no word twice in one pass
        spans.sort()
        assert all(a[1] <= b[0] for a, b in zip(spans, spans[1:]))
    # any stretch of slots holds a source in its share
    total, slots = sum(sizes.values()), sorted({(r.slot, r.source) for r in got}, key=lambda x: x[0])
    assert len({x[0] for x in slots}) == len(slots)
    for part in (slots[: len(slots) // 2], slots[len(slots) // 4 :]):
        for s in ("a", "b", "Z"):
            assert abs(sum(x[1] == s for x in part) - len(part) * want[s] / total) <= 8
    # what a slot takes is one block, but for a source's last
    words = Counter()
    for r in got:
        words[r.slot] += r.end - r.start
    block = max(words.values())
    for s in sizes:
        own = [words[k] for k, x in slots if x == s]
        assert all(n == block for n in own[:-1])
    # any prefix of the schedule holds a source's words in its share, but for a few blocks
    for n in (len(slots) // 7, len(slots) // 3, len(slots) * 3 // 4):
        so_far = Counter()
        for k, s in slots[:n]:
            so_far[s] += words[k]
        for s in ("a", "b", "Z"):
            assert abs(so_far[s] - n * block * want[s] / total) <= 4 * block
    # another schedule, another mix
    other = mix(df, golden=1 << 28 | 1)[0]
    at = lambda m: sorted((r._key, r.slot) for r in m.groupBy("_key").agg(F.min("slot").alias("slot")).collect())
    assert at(schedule) != at(other)
    again = mix(docs_of(spark, rows[::-1]))[0]
    text = lambda m, d: sorted((str(r.doc_id), r.n) for r in m.groupBy("_key").agg(F.sum(F.col("end") - F.col("start")).alias("n")).join(d.select(F.monotonically_increasing_id().alias("_key"), "doc_id"), "_key").collect())
    assert text(schedule, df) == text(again, docs_of(spark, rows[::-1]))


def test_no_words(spark):
    for rows in ([], [(1, None, None, 0), (None, "", "a", 0)]):
        schedule, found = mix(docs_of(spark, rows))
        assert schedule.collect() == [] and [r.target for r in found.collect()] == [0.0] * len(rows)


def test_n_words(spark):
    texts = [None, "", " ", "a", "a  b\tc\n\x0b\x0c\rd", "é\xa0x y", "x" * 50 + " x"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    assert [r[0] for r in df.select(n_words(F.col("t"))).collect()] == [len((t or "").encode().split()) for t in texts]


def test_mixed_documents(spark):
    rng = random.Random(6)
    rows = [(i, f"  {i} " + "\n".join(f"w{rng.randint(0, 9)}" for _ in range(rng.randint(0, 60))), rng.choice("ab"), 1) for i in range(120)] + [(500, None, "a", 0)]
    df = docs_of(spark, rows)
    schedule, found = mix(df)
    taken = Counter()
    for r in schedule.collect():
        taken[r._key] += r.end - r.start
    sizes = Counter()
    for r in mixed_documents(df, length="size").collect():
        text = rows[r.doc_id][1]
        if r.text != text:
            assert text.split()[: len(r.text.split())] == r.text.split() and r.size == len(r.text)
        sizes[r.doc_id] += len(r.text.split())
    assert sum(sizes.values()) == sum(taken.values()) and 500 not in sizes


def test_documents_are_in_the_order_of_slots(spark):
    df = docs_of(spark, [(i, f"{i} " * 40, "abc"[i % 3], 1) for i in range(300)])
    first = {}
    for r in mix(df)[0].collect():
        first[r._key, r["pass"]] = min(first.get((r._key, r["pass"]), r.slot), r.slot)
    by_key = {r._key: r.doc_id for r in df.select(F.monotonically_increasing_id().alias("_key"), "doc_id").collect()}
    want = [by_key[k[0]] for k in sorted(first, key=lambda k: (first[k], k[0]))]
    assert [r.doc_id for r in mixed_documents(df).collect()] == want


def test_fewer_slots_take_less(spark):
    targets = spark.createDataFrame([("a", 1000.0), ("b", 3000.0)], "source string, target double")
    n = {r.source: r["count"] for r in schedule_slots(spark, targets, 4000, 200, 10).groupBy(F.col("s.source").alias("source")).count().collect()}
    assert abs(n["a"] - 50) <= 3 and abs(n["b"] - 150) <= 3
    n = {r.source: r["count"] for r in schedule_slots(spark, targets, 4000, 420, 10).groupBy(F.col("s.source").alias("source")).count().collect()}
    assert n == {"a": 100, "b": 300}
