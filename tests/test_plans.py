import re
from datetime import datetime, timezone

import pytest
from pyspark.sql import functions as F

from attestor.operators import merge
from attestor.plans import claims, find, store
from attestor.plans.embed import HashingEmbedder, embed_missing

T = datetime(2025, 3, 1, 12)
NOW = datetime(2026, 10, 2, 12, tzinfo=timezone.utc)
FILL = " ".join(f"filler{i} words of the page number {i}." for i in range(30))

LINK = "from_claim long, to_claim long, relation string, method string, model string, confidence float, note string, created_at timestamp"


@pytest.fixture(scope="module")
def graph(spark):
    cat, chapter, dog, fell, dropped, bonds = range(1, 7)
    c = spark.createDataFrame(
        [(cat, 11, "a", None, False, True), (chapter, 12, "b", "2019", False, True), (dog, 13, "c", None, False, True), (fell, 14, "d", "2026-08", True, True), (dropped, 14, "e", "2026-09-20", True, True), (bonds, 14, "f", None, False, False)],
        "claim_id long, document_id long, text string, as_of string, volatile boolean, quote_verified boolean",
    )
    late = datetime(2026, 9, 1, 12)
    d = spark.createDataFrame([(11, "2020-01-15", T, T), (12, None, T, T), (13, "2024-06", late, late), (14, None, late, late)], "document_id long, published string, first_fetched_at timestamp, last_fetched_at timestamp")
    link = lambda a, b, r, m: (a, b, r, m, None, None, None, T)
    links = spark.createDataFrame([link(chapter, cat, "same", "model"), link(dog, cat, "contradicts", "model"), link(dropped, fell, "supersedes", "human"), link(dog, dropped, "supports", "model"), link(dropped, dog, "unrelated", "human")], LINK)
    return c, d, links, spark.createDataFrame([], "document_id long, origin_id long, reason string")


def test_flags(graph):
    c, d, links, o = graph
    f = {r.claim_id: r for r in claims.claim_flags(c, links, d, o, NOW).collect()}
    assert f[1].flags == "reinforced,contested,newer_contradiction" and f[1].origins == 2 and f[1].support_dates == "2019-2020"
    assert f[3].flags == "single_origin,contested" and f[3].related == 1
    assert "superseded" in f[4].flags and f[6].flags == "single_origin"
    early = {r.claim_id: r for r in claims.claim_flags(c, links, d, o, NOW, as_of=datetime(2025, 3, 1, 13)).collect()}
    assert early[1].flags == "reinforced" and 3 not in early


def test_timeline(graph, spark):
    c, d, links, o = graph
    seeds = spark.createDataFrame([(1,)], "claim_id long")
    t = {r.claim_id: r for r in claims.timeline(seeds, c, links, d, o).collect()}
    assert [t[i].dated for i in (2, 1, 3)] == ["2019-01-01", "2020-01-15", "2024-06-01"] and t[3].changes == "contradicts 1 (2020-01-15)" and not t[3].matched
    t = {r.claim_id: r for r in claims.timeline(spark.createDataFrame([(4,)], "claim_id long"), c, links, d, o).collect()}
    assert t[5].changes == "supersedes 4 (2026-08-01)" and set(t) == {4, 5}
    cards = spark.createDataFrame([("claim", 4), ("claim", 5), ("passage", 4)], "kind string, id long")
    assert sorted(tuple(r) for r in claims.collapse_superseded(cards, claims.page_edges(cards.where("kind = 'claim'").select(F.col("id").alias("claim_id")), links)).select("kind", "id").collect()) == [("claim", 5), ("passage", 4)]


@pytest.fixture(scope="module")
def corpus(spark):
    docs = [(1, "https://zoo.example/cats", "2020-01-15", T), (2, "https://zoo.example/dogs", "2024-06", datetime(2026, 9, 1)), (3, "https://zoo.example/cat-book", None, T), (4, "https://news.example.com/markets", None, datetime(2026, 9, 1)), (5, "https://figures.example/fig", None, datetime(2026, 9, 1))]
    d = spark.createDataFrame([(i, u, p, f, None, False, "primary") for i, u, p, f in docs], "document_id long, title string, published string, first_fetched_at timestamp, published_from string, published_weak boolean, origin string")
    d = d.withColumn("site", F.regexp_extract("title", "//([^/]+)", 1))
    texts = {1: ["Cats are small and the cat is a popular animal. " + FILL], 2: ["Dogs are loyal and the dog is a popular animal. " + FILL], 3: [f"The cat chapter {n}. {FILL}" for n in range(4)], 4: ["Stock markets fell as equity prices dropped. " + FILL], 5: ["cat cats " + "<pad> " * 300]}
    p = spark.createDataFrame([(100 * i + n, i, "A" if i < 4 else "B", n, t) for i, ts in texts.items() for n, t in enumerate(ts)], "passage_id long, document_id long, run_id string, ord int, text string")
    c = spark.createDataFrame([], "claim_id long, document_id long, text string, as_of string, volatile boolean, quote_verified boolean")
    v = spark.createDataFrame([], "claim_id long, embed_model string, embedding array<float>")
    return lambda **kw: [r for r in find.find(find.Query(now=NOW, **kw), p, c, v, d).collect()]


def test_find(corpus):
    cats = corpus(text="cat")
    assert [r.document_id for r in cats].count(3) == 2 and cats[-1].document_id == 5  # capped; padding ranks last
    assert {r.document_id for r in corpus(text="popular animal", since=datetime(2021, 1, 1))} == {2}
    assert {r.document_id for r in corpus(text="popular animal", until=datetime(2021, 1, 1))} == {1}
    assert {r.document_id for r in corpus(text="cat dog stock", date_field="collected", since=datetime(2026, 1, 1))} == {2, 4, 5}
    assert {r.document_id for r in corpus(text="cat dog", as_of=datetime(2025, 12, 31))} == {1, 3}
    assert {r.document_id for r in corpus(text="cat dog stock", domain="www.example.com")} == {4} and {r.document_id for r in corpus(text="cat stock", run="B")} == {4, 5}
    assert corpus(text="popular animal", prefer_recent_days=365.0)[0].document_id == 2 and corpus(text="zzzqqq") == [] and corpus(text="the of") == []
    assert {r.age for r in cats if r.document_id == 1} == {"published 2020-01-15 (6y ago); collected 2025-03-01"}


def test_query_checks():
    for kw in ({"text": " "}, {"text": "x", "kinds": ("odd",)}, {"text": "x", "min_similarity": 2}, {"text": "x", "date_field": "odd"}, {"text": "x", "since": NOW, "until": datetime(2020, 1, 1, tzinfo=timezone.utc)}):
        with pytest.raises(ValueError):
            find.Query(**kw)
    assert find.Query("x", limit=0).limit == 10 and find.Query("x", limit=500).limit == 100 and find.Query("x").depth == 50


def test_batch_find_is_find(spark, data):
    p = spark.read.parquet(f"{data}/passages.parquet")
    q = spark.createDataFrame([(1, "harbour ledger of the tide"), (2, "Why was the quay reopened?"), (3, "the"), (4, None)], "query_id long, text string")
    rows = {r.passage_id: re.findall(r"[^\W_]+", (r.text or "").lower()) for r in p.collect()}
    for block in (2_000, 1):
        got = {}
        for r in find.batch_find(p, q, 7, block).collect():
            got.setdefault(r.query_id, []).append((r["rank"], r.passage_id, r.hits))
        for qid, text in ((1, "harbour ledger of the tide"), (2, "Why was the quay reopened?")):
            terms = set(find.query_terms(text))
            score = sorted(((-sum(w in terms for w in ws), i) for i, ws in rows.items()))[:7]
            assert [(i, h) for _, i, h in sorted(got[qid])] == [(i, -s) for s, i in score if s < 0]
        assert 3 not in got and 4 not in got


def test_embedding_pass(spark):
    calls = []
    rows = spark.createDataFrame([(1, "a b"), (2, "a b"), (3, "c"), (4, None)], "id long, text string")
    none = spark.createDataFrame([], "model string, text_sha256 string, embedding array<float>")
    out = embed_missing(rows, "id", none, HashingEmbedder(8))
    assert {r.id for r in out.collect()} == {1, 2, 3} and len({tuple(r.embedding) for r in out.collect()}) == 2
    cache = out.select(F.lit("hashing-v1").alias("model"), "text_sha256", "embedding")

    class Never(HashingEmbedder):
        def embed_documents(self, texts):
            raise AssertionError("cached")

    assert embed_missing(rows, "id", cache, Never(8)).count() == 3 and not calls
    assert merge.not_embedded(cache.withColumn("embed_model", F.lit("x")), "y").count() == 3


def test_store_questions(spark):
    f = "run_id string, seq long, source_id long, reason string, hit_rank int, attempted_at timestamp, http_status int, error string, document_id long"
    df = spark.createDataFrame([("r", 1, 1, "result", 2, T, 404, None, None), ("r", 1, 1, "result", 2, T, 404, None, None), ("r", 2, 1, "cited", None, T, 200, None, 5), ("r", 3, 2, "opened", None, T, None, "dial: no such host", None), ("r", 4, 2, "result", 1, T, 403, "x", None)], f)
    assert store.class_counts(df).first().asDict() == {"run_id": "r", "ok": 1, "blocked": 1, "dead": 2, "error": 0}
    assert [(r.source_id, r.reason) for r in store.fetch_plan(df).collect()] == [(2, "opened")]
    assert [(r.seq) for r in store.best_attempts(df).where("source_id = 1").collect()] == [2]
    assert store.class_counts(df.limit(0)).collect() == []
