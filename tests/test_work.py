from datetime import datetime, timedelta

from pyspark.sql import functions as F

from attestor.plans import work

T = datetime(2026, 3, 1)


def test_extraction_work(spark):
    c = spark.createDataFrame([("a", 2, False, T), ("b", 3, True, T), ("c", 1, True, T), ("d", 0, True, T)], "text_sha256 string, chunks int, cited boolean, last_fetched_at timestamp")
    s = spark.createDataFrame([("b", 1, [2]), ("c", 3, [0])], "text_sha256 string, attempts int, failed array<int>")
    assert [(r.text_sha256, r.chunk) for r in work.extraction_work(c, s).collect()] == [("b", 2), ("a", 0), ("a", 1)]


def test_pairs(spark):
    c = spark.createDataFrame([(1, 10, "the bridge toll was five"), (2, 11, "a bridge toll is six"), (3, 12, "harbour pilots"), (4, 10, "bridge toll again"), (4, 10, "bridge toll again")], "claim_id long, document_id long, text string")
    near = spark.createDataFrame([(1, 2, 0.9), (2, 1, 0.9), (1, 3, 0.95), (1, 4, 0.99), (2, 4, 0.8)], "query_id long, id long, similarity double")
    l = "from_claim long, to_claim long, method string, created_at timestamp"
    none = spark.createDataFrame([], l)
    assert [(r.a, r.b) for r in work.pairs_to_label(near, c, none, 9, T).collect()] == [(1, 2), (2, 4)]
    assert [(r.a, r.b) for r in work.pairs_to_label(near, c, spark.createDataFrame([(2, 1, "model", T)], l), 2, T).collect()] == [(2, 4)]
    assert work.pairs_to_label(near, c, spark.createDataFrame([(8, 9, "model", T)], l), 1, T).count() == 0


def test_nodes_and_tasks(spark):
    n = spark.createDataFrame([("1", "A Title", "/a", {"url": "https://www.x.example/p/", "tags": '["t", "u"]', "k": "v"}, T, False), ("2", "b", "/b", None, T, None), ("3", "c", None, {}, T, None)], "id string, title string, path string, metadata map<string,string>, updated_at timestamp, orphaned boolean")
    f = spark.createDataFrame([("/a", T + timedelta(1))], "path string, modified timestamp")
    assert sorted((r.id, r.state) for r in work.node_changes(n, f).collect()) == [("1", "stale"), ("2", "orphaned")]
    ids = lambda k, v: [r.id for r in work.find_nodes(n, k, v).collect()]
    assert ids("title", "a title") == ["1"] and ids("path", "/b") == ["2"] and ids("url", "http://x.example/p") == ["1"] and ids("tags", "u") == ["1"] and ids("k", "v") == ["1"] and ids("k", "w") == []
    assert work.by_prefix(n, "id", "1").count() == 1
    t = spark.createDataFrame([("a", "queued", None, 1, T, None, None), ("b", "queued", None, 5, T, None, T + timedelta(1)), ("c", "queued", "p", 9, T, None, None), ("d", "queued", None, 3, T, '{"workers": [{"shard": "x", "error": "e"}, {"shard": "y"}]}', T - timedelta(1))], "id string, status string, parent_task_id string, priority int, created_at timestamp, metadata string, lease_until timestamp")
    assert [r.id for r in work.next_tasks(t, T, 2).collect()] == ["d", "a"]
    assert [(r.parent, r.shard, r.status) for r in work.child_tasks(t).collect()] == [("d", "x", "error"), ("d", "y", "done")]
    e = work.evidence_ids(spark.createDataFrame([("r", 2), ("r", 1), ("q", 1)], "run string, n int"), "run", [F.col("n")])
    assert sorted((r.run, r.n, r.evidence_id) for r in e.collect()) == [("q", 1, "E1"), ("r", 1, "E1"), ("r", 2, "E2")]


def test_matched_sources(spark):
    c = spark.createDataFrame([("d", 1, "As Robertson wrote of Okapi in 1994."), ("d", 2, "nothing here")], "k string, claim int, text string")
    s = spark.createDataFrame([("d", 1, "Jones 1972"), ("d", 2, "Robertson, Okapi at TREC, 1994"), ("d", 3, "Robertson 2001"), ("e", 1, "Robertson Okapi")], "k string, pos int, line string")
    assert [(r.claim, r.pos, r.score) for r in work.matched_sources(c, s, "k").orderBy("rank").collect()] == [(1, 2, 5), (1, 3, 2)]
