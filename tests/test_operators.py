import random
from datetime import datetime, timedelta

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from attestor.functions.text import simhash_of
from attestor.operators import joins, merge, ranking
from attestor.operators.components import components, staged_groups
from attestor.session import Scratch
from attestor.plans import graph, origins, reports

T = datetime(2026, 1, 1)


def rows(df, *cols):
    return sorted(tuple(r) for r in df.select(*cols).collect())


def test_fair_shares(spark):
    def by_hand(needs, total):
        out, left = {}, total
        for k, (need, i) in enumerate(sorted((n, i) for i, n in enumerate(needs))):
            give = min(need, left // (len(needs) - k))
            out[i], left = give, left - give
        return [out[i] for i in range(len(needs))]

    rng = random.Random(2)
    for needs in ([5, 1, 9], [10, 10, 10], [0, 0], [100], [rng.randrange(60) for _ in range(12)]):
        df = spark.createDataFrame([("k", i, n) for i, n in enumerate(needs)], "k string, i int, need int")
        got = [r.share for r in ranking.fair_shares(df, ["k"], "need", 100).orderBy("i").collect()]
        assert got == by_hand(needs, 100), needs


def test_budget_and_groups(spark):
    df = spark.createDataFrame([("a", 1, 40), ("a", 2, 70), ("a", 3, 10), ("b", 1, None)], "k string, i int, n int")
    assert rows(ranking.within_budget(df, ["k"], [F.col("i")], F.col("n"), 100), "k", "i", "granted") == [("a", 1, 40), ("a", 2, 60), ("b", 1, 0)]
    assert ranking.within_budget(df.limit(0), ["k"], [F.col("i")], F.col("n"), 100).count() == 0


def test_transitions_and_sample(spark):
    df = spark.createDataFrame([(1, 1, "a"), (1, 2, "a"), (1, 3, None), (1, 4, None), (1, 5, "b")], "u int, n int, s string")
    assert [r[0] for r in rows(ranking.transitions(df, ["u"], ["n"], "s", F.floor(F.col("n") / 2)), "n")] == [1, 3, 5]
    pool = spark.createDataFrame([("A", f"t{i % 3}", i) for i in range(30)], "arm string, topic string, id int")
    got = ranking.stratified_sample(pool, "arm", "topic", "id", 7, 3).groupBy("topic").count().collect()
    assert sorted(r["count"] for r in got) == [2, 2, 3]
    assert ranking.blind_ids(pool.limit(2), "id", 1).where("review_id = 'C02'").count() == 1


def test_cron():
    t = pd.Timestamp("2026-03-01 10:30:20")
    assert ranking.cron_next("* * * * *", t) == pd.Timestamp("2026-03-01 10:31") and ranking.cron_next("0 * * * *", t) == pd.Timestamp("2026-03-01 11:00")
    assert ranking.cron_next("15 3 1 1 *", t) == pd.Timestamp("2027-01-01 03:15") and ranking.cron_next("0 0 * * 1", t) == pd.Timestamp("2026-03-02")
    assert ranking.cron_next("not a cron", t) is None and ranking.cron_next("99 * * * *", t) is None and ranking.cron_next(None, t) is None


def test_components_and_stages(spark):
    rng = random.Random(1)
    pairs = [(rng.randrange(200), rng.randrange(200)) for _ in range(120)] + [(i, i + 1) for i in range(300, 340)]
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in pairs:
        if a != b:
            a, b = find(a), find(b)
            parent[max(a, b)] = min(a, b)
    got = dict(rows(components(spark.createDataFrame(pairs, "a long, b long"), Scratch(spark, "t")), "id", "root"))
    assert got == {x: find(x) for x in parent}
    e = lambda *p: spark.createDataFrame(list(p), "a long, b long")
    ids = spark.createDataFrame([(i,) for i in (1, 2, 3, 4, 5)], "id long")
    got = rows(staged_groups(ids, [("one", e((3, 2))), ("two", e((3, 1), (4, 4))), ("none", e((9, 8)))]), "id", "root", "reason")
    assert got == [(1, 1, "self"), (2, 1, "two"), (3, 1, "one"), (4, 4, "self"), (5, 5, "self")]


def test_hash_pairs(spark):
    rng = random.Random(3)
    base = [rng.getrandbits(64) for _ in range(40)]
    values = base + [b ^ (1 << rng.randrange(64)) ^ (1 << rng.randrange(64)) for b in base[:10]] + base[:3]
    signed = [v - 2**64 if v >= 2**63 else v for v in values]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(signed)] + [(99, None)], "id long, h long")
    got = {(a, b) for a, b, _ in rows(joins.hash_pairs(df, "id", "h"), "a", "b", "distance")}
    first = {}
    for i, v in enumerate(values):
        first.setdefault(v, i)
    reps = sorted(first.values())
    want = {(a, b) for a in reps for b in reps if a < b and (values[a] ^ values[b]).bit_count() <= 3} | {(first[v], i) for i, v in enumerate(values) if first[v] != i}
    assert got == want


def test_spans_and_neighbours(spark):
    c = spark.createDataFrame([(1, 1, 5), (2, 1, 99), (3, 1, None), (4, 2, 0)], "c int, d int, at int")
    p = spark.createDataFrame([(1, 0, 0, 5, "a"), (1, 1, 5, 9, "b"), (1, 2, 5, 9, "c")], "d int, ord int, s int, e int, p string")
    got = rows(joins.point_in_span(c, p, ["d"], "at", "s", "e", "ord"), "c", "span_p")
    assert got == [(1, "b"), (2, None), (3, None), (4, None)]
    n = joins.neighbours(p, ["d"], "ord", "p", 9)
    assert {r.p: (r.before, r.after) for r in n.collect()}["b"] == (["a"], ["c"])


def test_nearest_of_some(spark):
    rng = np.random.default_rng(1)
    v = rng.normal(size=(80, 8))
    df = spark.createDataFrame([(i, "m", v[i].tolist()) for i in range(80)], "id long, model string, v array<float>")
    x = np.array([r.v for r in df.orderBy("id").collect()])
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    for block in (4_000, 3):
        got = rows(joins.nearest_of_some(df, df.where("id % 10 = 0"), 4, block), "query_id", "id")
        want = sorted((q, int(i)) for q in range(0, 80, 10) for i in [j for j in np.argsort(-(x[q] @ x.T)) if j != q][:4])
        assert got == want


def test_merges_do_not_mind_order(spark):
    s = "url string, url_key string, domain string, title string, kind string, doi string, first_seen_at timestamp, last_seen_at timestamp"
    data = [("https://a/1", "a", None, "", "web", None, T, T), ("http://a/1", "a", "a", "Title", "paper", "10.1/x", T + timedelta(1), T + timedelta(3)), ("http://a/2", "a", "b", "Later", "video", None, T + timedelta(2), T + timedelta(2))]
    once = rows(merge.fold_sources(spark.createDataFrame(data, s)), "*")
    assert once == rows(merge.fold_sources(merge.fold_sources(spark.createDataFrame(data[::-1], s)).select(*[c.split()[0] for c in s.split(", ")])), "*")
    assert once[0][3:6] == ("Title", "paper", "10.1/x")
    f = "run_id string, seq long, source_id long, attempted_at timestamp, content_kind string, content_type string, title string, text_chars int, text_sha256 string, document_id long, published string, published_precision string, published_from string, published_weak boolean"
    data = [("r", 1, 1, T, "full", "t", "", 5, "s", 7, "2025-06-01", "day", "meta", True), ("r", 2, 1, T + timedelta(1), "full", "t", "N", 5, "s", 7, "2021-11", "month", "jsonld", False), ("r", 3, 1, T + timedelta(2), "abstract", None, "X", 5, "s", 7, "2025-07-01", "day", "meta", True), ("r", 4, 1, T, None, None, None, None, None, None, None, None, None, None)]
    d = merge.fold_documents(spark.createDataFrame(data, f)).collect()
    assert len(d) == 1 and (d[0].published, d[0].published_precision, d[0].published_weak, d[0].title, d[0].content_kind) == ("2021-11", "month", False, "N", "full")


def test_links_log(spark):
    s = "from_claim long, to_claim long, relation string, method string, model string, confidence float, note string, created_at timestamp"
    data = [(1, 2, "same", "model", "", 0.0, "", T), (1, 2, "refines", "model", "m", 0.5, "n", T + timedelta(1)), (2, 1, "same", "human", None, None, None, T), (3, 3, "same", "human", None, None, None, T), (4, 5, "odd", "human", None, None, None, T), (6, 7, "same", "rule", None, None, None, T)]
    df = spark.createDataFrame(data, s)
    assert rows(merge.valid_links(df), "from_claim", "to_claim") == [(1, 2), (1, 2), (2, 1)]
    l = merge.latest_links(df)
    assert rows(l.where("from_claim = 1"), "relation", "model") == [("refines", "m")] and sorted(map(str, l.collect())) == sorted(map(str, merge.latest_links(l.select(df.columns)).collect()))


def test_graph_import(spark):
    e = "book string, pos int, title string, author string, url string, date string, notes string"
    book = [("a", 1, "MK", None, "https://en.example/wiki/MK", None, "overview"), ("a", 2, "MK2", None, "http://en.example/wiki/MK#Background", None, "background section"), ("a", 3, "Church", "US Senate", "https://www.senate.example/church/", "1976", None), ("a", 4, "No link", None, None, None, None), ("a", 5, "ftp", None, "ftp://x.example/y", None, None)]
    none = spark.createDataFrame([], "id string, key string, title string"), spark.createDataFrame([], "from_id string, to_id string")
    nodes, edges, stats = graph.import_sources(spark.createDataFrame(book, e), *none)
    assert stats.first().asDict() == {"entries": 5, "skipped": 1, "invalid": 1, "unique": 2, "created": 2, "reused": 0, "edges": 2}
    again = graph.import_sources(spark.createDataFrame(book, e), nodes.select("id", "key", "title"), edges)[2].first()
    assert (again.created, again.reused, again.edges) == (0, 2, 0)
    assert rows(nodes.where("key = 'en.example/wiki/MK'"), "title", "notes") == [("MK", "overview; background section")]
    n = spark.createDataFrame([("r", "/p/r"), ("x", "/p/x"), ("y", "/q/y")], "id string, path string")
    assert rows(graph.link_report("r", "/p", n, spark.createDataFrame([], "from_id string, to_id string, type string")), "from_id", "to_id") == [("r", "x")]


def test_citation_check(spark):
    report = 'Cats "sleep twelve to sixteen hours daily" [P:1]. Dogs "nap all day in the sun" [P:1].\nLast [P:9] [S:4] [E1]'
    m = reports.marks(spark.createDataFrame([(1, report), (2, None)], "doc_id long, text string"))
    t = spark.createDataFrame([("P", 1, "Cats sleep twelve to sixteen hours daily, mostly in warm places."), ("S", 4, None)], "kind string, target long, text string")
    c = reports.check_marks(m, t)
    assert rows(c, "ord", "resolved", "quote_status") == [(0, True, "found"), (1, True, "not_found"), (2, False, None), (3, True, None), (4, None, None)]
    s = reports.citation_summary(c, "doc_id").first()
    assert (s.resolved, s.unresolved, s.unchecked, s.quotes_found, s.quotes_not_found) == (3, 1, 1, 1, 1)
    assert rows(reports.citation_failures(c, "doc_id"), "unresolved", "missed") == [(1, 1)]
    key = spark.createDataFrame([("C01", "A"), ("C02", "A"), ("C03", "B")], "id string, arm string")
    sheet = spark.createDataFrame([("## C01 x\nVerdict: supported\n## C02\nverdict: Partial\nVerdict: unsupported\nVerdict: odd\n",)], "text string")
    t = {r.arm: r for r in reports.tally(key, reports.review_verdicts(sheet)).collect()}
    assert (t["A"].reviewed, t["A"].supported, t["A"].unsupported, t["A"].rate, t["B"].rate) == (2, 1, 1, 0.5, 0.0)


def test_origin_stages(spark):
    f = spark.createDataFrame([(1, 10, None, None), (2, 10, "https://x.example/a", None), (3, 11, "http://www.x.example/a/", "10.1/A"), (4, 12, None, "10.1/a"), (5, 13, None, None), (None, 13, None, None)], "document_id long, source_id long, final_url string, doi string")
    c = spark.createDataFrame([], "claim_id long, document_id long")
    l = spark.createDataFrame([], "from_claim long, to_claim long, relation string, method string, created_at timestamp")
    assert rows(origins.origin_groups(f, c, l), "document_id", "origin_id", "reason") == [(1, 1, "self"), (2, 1, "source"), (3, 1, "final-url"), (4, 1, "doi"), (5, 5, "self")]


def test_near_links_equal_brute_force(spark):
    rng = random.Random(5)
    base = [f"w{rng.randrange(10**6)}" for _ in range(900)]
    texts = [" ".join(base)]
    while len(texts) < 30:  # small changes of one text, and texts of their own
        w = list(base) if len(texts) % 3 else [f"u{rng.randrange(10**6)}" for _ in range(300)]
        for _ in range(rng.randrange(1, 6)):
            w[rng.randrange(len(w))] = "changed"
        texts.append(" ".join(w))
    texts = texts + texts[:9] * 2 + texts[1:4] * 3 + ["short", None]
    rng.shuffle(texts)
    docs = [(100 - i, t) for i, t in enumerate(texts)]
    h = {i: simhash_of(t) & (2**64 - 1) for i, t in docs if t and len(t) >= origins.NEAR_CHARS}
    near = {i: [j for j in h if j != i and (h[i] ^ h[j]).bit_count() <= 3] for i in h}
    want = sorted((i, min(j for j in h if h[j] == h[i]), min(js), len(js)) for i, js in near.items() if js)
    assert any(h[i] != h[j] for i in near for j in near[i]) and any(h[i] == h[j] for i in near for j in near[i])
    df = spark.createDataFrame(docs, "doc_id long, text string")
    assert rows(origins.near_links(df, "doc_id", "text"), "doc_id", "class_id", "first_near", "links") == want


def test_citation_targets(spark):
    make = spark.createDataFrame
    fetches = make([("r", 1, 70, 7, "full"), ("r", 2, 70, None, None), ("q", 1, 80, 8, "abstract"), ("q", 1, 80, 8, "abstract"), ("q", 2, 70, 9, "abstract")], "run_id string, seq long, source_id long, document_id long, content_kind string")
    passages = make([(11, 7, 0, "The tide came in very late"), (12, 7, 1, "and the ledger was lost"), (13, 7, 2, "before the dawn broke"), (14, 7, 3, "over four grey hills again"), (15, 8, 0, "only a short note here"), (16, 9, 0, "another version of this page")], "passage_id long, document_id long, ord int, text string")
    claims = make([(21, 7, 11), (22, 7, None), (23, 99, None)], "claim_id long, document_id long, passage_id long")
    sources = make([(70,), (80,), (90,)], "source_id long")
    said = [
        ("r", "came in very late", "E1", True, "found"), ("r", "only a short note", "E1", True, "not_found"), ("q", "only a short note", "E1", True, "found"), ("q", "came in very late", "E1", True, "unverifiable"),
        ("r", "came in very late", "E2", True, "unverifiable"), ("r", "came in very late", "E9", False, "not_found"), (None, "came in very late", "E1", False, "not_found"),
        ("r", "ledger was lost before the", "P:11", True, "not_found"), ("r", "very late and the ledger", "P:12", True, "found"), ("r", "over four grey hills", "P:1", False, "not_found"), ("r", "no such words here", "P:15", True, "unverifiable"),
        ("r", "over four grey hills", "C:21", True, "not_found"), ("r", "over four grey hills", "C:22", True, "found"), ("r", "over four grey hills", "C:23", True, "unverifiable"),
        ("r", "another version of this", "S:70", True, "found"), ("r", "broke over four grey", "S:70", True, "found"), ("r", "no such words here", "S:70", True, "not_found"), ("r", "no such words here", "S:80", True, "unverifiable"), ("r", "no such words here", "S:90", True, "unverifiable"), ("r", None, "S:90", True, None),
    ]
    found = make([(i, r, x[0], int(x.lstrip("EPCS:")), q or "") for i, (r, q, x, _, _) in enumerate(said)], "doc_id long, run_id string, kind string, target long, quote string")
    t = reports.citation_targets(found, fetches, passages, claims, sources)
    scoped = found.withColumn("run_id", F.when(F.col("kind") == "E", F.col("run_id")).otherwise(""))
    for kinds in (None, ("E", "P", "C", "S")):
        assert rows(reports.check_marks(scoped, t, ("run_id",), kinds), "doc_id", "resolved", "quote_status") == [(i, r, s) for i, (_, _, _, r, s) in enumerate(said)]


def test_document_hashes_add_up(spark):
    from attestor.functions.text import simhash_of
    from attestor.plans.origins import document_hashes

    rng = random.Random(7)
    docs = {d: [" ".join("".join(rng.choice("abcde") for _ in range(4)) for _ in range(rng.randint(2, 90))) for _ in range(9)] for d in range(12)}
    rows = [(100 * d + i, d, i, t) for d, ts in docs.items() for i, t in enumerate(ts)]
    df = spark.createDataFrame([*rows, rows[0], (9999, 99, 0, "short"), (9998, 98, 0, None)], "passage_id long, document_id long, ord int, text string")
    got = {r.document_id: r.simhash for r in document_hashes(df).collect()}
    assert got == {d: simhash_of("\n\n".join(ts)) for d, ts in docs.items() if len("\n\n".join(ts)) >= 1000}
