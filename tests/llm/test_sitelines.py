import re
import unicodedata

from pyspark.sql import functions as F

from attestor.llm.sitelines import MONTHS, host_of, line_key, repeated_lines, without_lines

P = "passage_id long, document_id long, text string, site string, s int"
D = "document_id long, source_id long, site string"
S = "source_id long, url string, h string"


def key(line):
    x = re.sub(rf"(?<!\w)(?:{'|'.join(MONTHS)})(?!\w)", " ", line.lower())
    return "".join(c for c in x if unicodedata.category(c)[0] in "LM")


def tables(spark, rows, url="https://www.Site.example/x"):
    docs = sorted({d for _, d, _ in rows if d is not None})
    return (
        spark.createDataFrame([(p, d, t, "z", 1) for p, d, t in rows], P),
        spark.createDataFrame([(d, d, "z") for d in docs], D),
        spark.createDataFrame([(d, url if d < 1000 else f"http://other{d}.example/", "z") for d in docs], S),
    )


def test_keys(spark):
    lines = ["Print · Save · Share", "  PRINT  ·  save · share!", "Last updated 3 May 2021", "last updated 2024-12-01", "12:30 — 99 %", "", "Mis à jour le 8 février 2018", "Stand: 4. März 2020", "Posted 12 Jan. 2020"]
    got = [r.k for r in spark.createDataFrame([(x,) for x in lines], "l string").select(line_key(F.col("l")).alias("k")).collect()]
    assert got == ["printsaveshare", "printsaveshare", "lastupdated", "lastupdated", "", "", "misàjourle", "stand", "posted"]
    urls = ["HTTPS://www.A.example:8080/x", "http://b.example?q", "nothing", None]
    got = [r.h for r in spark.createDataFrame([(u,) for u in urls], "u string").select(host_of(F.col("u")).alias("h")).collect()]
    assert got == ["a.example", "b.example", None, None]


def test_threshold_is_by_document(spark):
    rows = []
    for d in range(1, 7):
        rows.append((d * 10, d, f"Share this {d} times\n\nown line {chr(96 + d) * 3}\nFive docs only" if d < 6 else "SHARE  this, 9 times"))
    rows.append((11, 1, "twice in one\nFive docs only"))
    rows.append((11, 1, "twice in one\nFive docs only"))  # delivered again
    rows += [(1000 + d, 1000 + d, "Five docs only\n42\nShare this 1 times") for d in range(3)]  # other sites
    rows += [(5, None, "Share this 1 times"), (6, 2, None), (7, 3, "")]
    p, f, s = tables(spark, rows)
    got = {tuple(r) for r in repeated_lines(p, f, s).collect()}
    assert got == {(d * 10, 0) for d in range(1, 7)}
    for width in (1, 64):  # any width, any way of joining
        assert {tuple(r) for r in repeated_lines(p, f, s, width=width, broadcast_bytes=-1).collect()} == got
    kept = {r.passage_id: r.text for r in without_lines(p, repeated_lines(p, f, s)).collect()}
    assert kept[60] == "" and kept[10] == "own line aaa\nFive docs only" and kept[6] is None


def test_against_brute_force(spark, data):
    p, f, s = (spark.read.parquet(f"{data}/{n}.parquet") for n in ("passages", "fetches", "sources"))
    site = {r.document_id: r.site for r in f.where("document_id is not null").select("document_id", "source_id").distinct().join(s.select("source_id", host_of(F.col("url")).alias("site")), "source_id").collect()}
    seen, docs = {}, {}
    for r in p.collect():
        for n, line in enumerate((r.text or "").split("\n")):
            k = key(line)
            if k and site.get(r.document_id):
                seen.setdefault((site[r.document_id], k), set()).add((r.passage_id, n))
                docs.setdefault((site[r.document_id], k), set()).add(r.document_id)
    want = {x for k, v in seen.items() if len(docs[k]) >= 6 for x in v}
    assert {tuple(r) for r in repeated_lines(p, f, s).collect()} == want


def test_empty(spark):
    p, f, s = spark.createDataFrame([], P), spark.createDataFrame([], D), spark.createDataFrame([], S)
    assert repeated_lines(p, f, s).collect() == []


def test_sketches_merge_by_sums(spark):
    import random

    from attestor.llm.sitelines import frequent_buckets, site_sketches

    rng = random.Random(4)
    rows = [(rng.randrange(3), int(rng.paretovariate(0.6)) % 2**40 - 2**30) for _ in range(4_000)]
    lines = spark.createDataFrame(rows, "s long, h long").repartition(6)
    for width in (16, 512):
        want = {}
        for s, h in rows:
            want[s, h % width] = want.get((s, h % width), 0) + 1
        got = frequent_buckets(site_sketches(lines, width, flush=300), width, 7, 4)
        assert {tuple(r) for r in got.collect()} == {k for k, n in want.items() if n >= 7}
    assert frequent_buckets(site_sketches(lines.limit(0), 16), 16, 7, 4).collect() == []


def test_broadcast_is_measured_in_memory(spark):
    words = ["".join(chr(97 + int(c)) for c in str(n)) for n in range(700)]
    rows = [(d, d, "\n".join(words)) for d in range(1, 7)]
    p, f, s = tables(spark, rows)
    # 700 keys are some 20 kB of files, 100 kB in memory; salted, Spark's own threshold of 10 MB doesn't count either
    for most, joins in ((50_000, False), (8 << 20, True)):
        found = repeated_lines(p, f, s, broadcast_bytes=most)
        assert len(found.collect()) == 6 * 700
        assert ("BroadcastHashJoin" in found._jdf.queryExecution().executedPlan().toString()) is joins


def test_sketches_of_any_number(spark):
    from attestor.llm.sitelines import _entries, _merged, _packed, _summed, frequent_buckets, site_sketches
    import numpy as np

    width, rng = 1 << 16, np.random.default_rng(5)
    s, at = rng.choice([-3, 0, 7, 2**40], 20_000, p=[0.9, 0.05, 0.04, 0.01]), rng.integers(0, width, 20_000) // 9
    packed = _packed(*_summed(s, at, np.ones(len(s), "i8")), width)
    for most in (1, 50, 10**6):  # blocks of one site and more, slices of a batch, sites over several batches
        assert sum(len(x) for x, _, _ in _entries(packed.slice(1), width, most)) == len({x for x in zip(s, at) if x[0] != -3})
    merged = list(_merged(iter([packed.slice(i, 1) for i in (0, 0, 1, 2, 2, 2, 3)]), width))
    assert [sorted(set(x.tolist())) for x, _, _ in merged] == [[-3], [0], [7], [2**40]]
    assert [n.sum() for _, _, n in merged] == [2 * sum(s == -3), sum(s == 0), 3 * sum(s == 7), sum(s == 2**40)]
    lines = spark.createDataFrame(list(zip(s.tolist(), at.tolist())), "s long, h long").repartition(3)
    want = {}
    for x in zip(s.tolist(), at.tolist()):
        want[x] = want.get(x, 0) + 1
    got = frequent_buckets(site_sketches(lines, width, flush=2_000), width, 5, 4, large=500)  # the large site is dealt out
    assert {tuple(r) for r in got.collect()} == {k for k, n in want.items() if n >= 5}
