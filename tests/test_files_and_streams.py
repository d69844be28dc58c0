import hashlib
import json
import shutil

from pyspark.sql import functions as F

from attestor.operators.merge import latest_links
from attestor.plans import ingest
from attestor.sources import files, sinks
from attestor.streaming import incremental

PUB = {"date": "2021-11", "precision": "month", "from": "jsonld", "weak": False}
TEXT = "First paragraph of the page, quite long.\n\n" + "More text follows here. " * 120


def make_store(root):
    sha = hashlib.sha256(TEXT.encode()).hexdigest()
    run = root / "runs" / "20260101T000000Z-abcdef"
    run.mkdir(parents=True)
    (run / "run.json").write_text(json.dumps({"id": run.name, "kind": "dive", "status": "finished", "metadata": "{}"}))
    search = {"seq": 1, "captured_at": "2026-01-01T00:00:00Z", "action": "search", "results": [{"rank": 1, "title": "Go 1.18", "url": "https://go.example/blog?utm_source=x"}, {"rank": 2, "url": "ftp://bad/x"}, {"rank": 3, "url": "https://doi.example/10.1145/ABC.123"}]}
    opened = {"seq": 2, "captured_at": "2026-01-01T00:01:00Z", "action": "open", "url": "https://www.go.example/blog/"}
    (run / "captures.jsonl").write_text(json.dumps(search) + "\n\nnot json\n" + json.dumps(opened) + "\n" + '{"seq": 3, "cut')
    fetch = {"seq": 1, "url": "https://go.example/blog", "reason": "opened", "attempted_at": "2026-01-01T00:02:00Z", "attempts": 1, "http_status": 200, "text_sha256": sha, "text_chars": len(TEXT), "content_kind": "full", "title": "", "published": PUB}
    failed = {"seq": 2, "url": "https://gone.example/", "reason": "result", "attempted_at": "2026-01-01T00:03:00Z", "attempts": 3, "http_status": 404}
    (run / "fetches.jsonl").write_text(json.dumps(fetch) + "\n" + json.dumps(failed) + "\n")
    t = root / "text" / "sha256" / sha[:2]
    t.mkdir(parents=True)
    (t / f"{sha}.txt").write_text(TEXT)
    (root / "runs" / "empty").mkdir()
    e = root / "claims" / "reader" / sha[:2]
    e.mkdir(parents=True)
    claim = lambda text, quote, chunk: {"text": text, "quote": quote, "as_of": "March 2024", "volatile": False, "chunk": chunk}
    (e / f"{sha}.json").write_text(json.dumps({"text_sha256": sha, "extractor": "reader", "extracted_at": "2026-01-02T00:00:00Z", "claims": [claim(" ", "", 0), claim("A", "paragraph of the PAGE", 0), claim("B", "not there at all", 1)], "failed": []}))
    (e / "notes.json").write_text("{}")
    return sha


def test_ingest(spark, tmp_path):
    make_store(tmp_path)
    store = str(tmp_path)
    lines = files.log_lines(spark, f"{store}/runs/*/captures.jsonl", files.CAPTURE)
    p = files.log_problems(lines).first()
    assert (p.bad_lines, p.partial, p.records) == ([3], True, 2)
    assert files.existing_runs(spark, store) == ["20260101T000000Z-abcdef", "empty"]
    t = ingest.ingest(spark, store)
    s = sorted((r.seq, r.ord, r.url_key, r.role) for r in t["sightings"].collect())
    assert s == [(1, 0, "go.example/blog", "result"), (1, 1, "doi.example/10.1145/ABC.123", "result"), (2, 0, "go.example/blog", "opened")]
    src = {r.url_key: r for r in t["sources"].collect()}
    assert set(src) == {"go.example/blog", "doi.example/10.1145/ABC.123", "gone.example"} and src["go.example/blog"].title == "Go 1.18" and src["doi.example/10.1145/ABC.123"].kind == "paper"
    assert t["fetches"].count() == 2 and t["documents"].first().published == "2021-11"
    rows = t["passages"].orderBy("ord").collect()
    assert all(TEXT[r.char_start : r.char_end] == r.text for r in rows) and t["runs"].first().status == "finished"
    assert rows == ingest.ingest(spark, store)["passages"].orderBy("ord").collect()
    c = ingest.claims_of(files.extractions(spark, store), t["documents"], files.texts(spark, store), t["passages"]).orderBy("chunk", "ord").collect()
    assert [(r.chunk, r.ord, r.text, r.quote_verified, r.as_of) for r in c] == [(0, 1, "A", True, None), (1, 0, "B", False, None)]
    assert TEXT[c[0].char_start : c[0].char_end] == "paragraph of the page" and c[0].passage_id == rows[0].passage_id


def test_reports_and_citations(spark, tmp_path):
    make_store(tmp_path)
    store, report = str(tmp_path), "# Findings\n\nThe report says so."
    sha = hashlib.sha256(report.encode()).hexdigest()
    (tmp_path / "text" / sha[:2]).mkdir(parents=True, exist_ok=True)
    (tmp_path / "text" / sha[:2] / f"{sha}.txt").write_text(report)
    run = next(p for p in (tmp_path / "runs").iterdir() if (p / "run.json").is_file())
    record = json.loads((run / "run.json").read_text())
    (run / "run.json").write_text(json.dumps(record | {"report_sha256": sha, "topic": "Tides", "finished_at": "2026-01-02T03:04:05Z"}))
    (run / "citations.jsonl").write_text('{"ord": 1, "marker": "E1", "quote_status": ""}\n{"ord": 1, "marker": "E2"}\nbad\n{"ord": 2, "marker": "P:3", "resolved": true, "quote_status": "found"}\n')
    t = ingest.ingest(spark, store)
    d = t["documents"].where("origin = 'synthesis'").first()
    assert (d.title, d.published, d.published_from, d.run_id) == ("Tides", "2026-01-02", "run", run.name) and t["documents"].count() == 2
    assert [r.text for r in t["passages"].where(F.col("document_id") == d.document_id).collect()] == [report]
    assert t["sources"].where("kind = 'report'").first().source_id == d.source_id
    assert sorted((r.ord, r.marker, r.quote_status) for r in t["citations"].collect()) == [(1, "E1", None), (2, "P:3", "found")]


def test_blobs(spark, tmp_path):
    import gzip

    sha = "ab" * 32
    (tmp_path / "blobs" / "ab").mkdir(parents=True)
    (tmp_path / "blobs" / "ab" / f"{sha}.gz").write_bytes(gzip.compress(b"raw bytes"))
    (tmp_path / "blobs" / "ab" / f"{'cd' * 32}.gz").write_bytes(b"no gzip")
    (tmp_path / "blobs" / "ab" / "other.gz").write_bytes(gzip.compress(b"x"))
    got = {r.sha256: r.content for r in files.blobs(spark, str(tmp_path)).collect()}
    assert {k: bytes(v) if v else None for k, v in got.items()} == {sha: b"raw bytes", "cd" * 32: None}


def test_change_detection(spark, tmp_path):
    make_store(tmp_path)
    known = spark.createDataFrame(files.fingerprints(spark, str(tmp_path)).collect())
    assert known.first().citation_bytes == -1 and ingest.pending(spark, str(tmp_path), known).count() == 0
    (tmp_path / "runs" / "20260101T000000Z-abcdef" / "citations.jsonl").write_text("")
    assert ingest.pending(spark, str(tmp_path), known).count() == 1


def test_sinks(spark, tmp_path):
    path = str(tmp_path / "texts")
    df = spark.createDataFrame([("a",), ("a",), (None,), ("b",)], "text string")
    sinks.put_texts(df, path)
    sinks.put_texts(df, path)
    assert spark.read.parquet(path).count() == 2
    sinks.swap(df, str(tmp_path / "t"))
    sinks.swap(df.limit(1), str(tmp_path / "t"))
    assert sinks.current(spark, str(tmp_path / "t")).count() == 1 and sinks.current(spark, str(tmp_path / "none")) is None
    for _ in range(3):
        sinks.swap(df, str(tmp_path / "t"))
    assert len(list((tmp_path / "t").glob("v*"))) == 2  # the one before stays for its readers
    sinks.write_sheet(df, str(tmp_path / "sheet"))
    assert spark.read.option("header", True).option("sep", "\t").csv(str(tmp_path / "sheet")).columns == ["text"]
    old = spark.createDataFrame([("r", 4)], "run_id string, seq long")
    new = spark.createDataFrame([("r", "x"), ("r", "y"), ("q", "z")], "run_id string, v string")
    assert sorted((r.run_id, r.v, r.seq) for r in sinks.numbered(new, old, "run_id", ["v"]).collect()) == [("q", "z", 1), ("r", "x", 5), ("r", "y", 6)]


def test_stream_equals_batch(spark, tmp_path, data):
    links = spark.read.parquet(f"{data}/claim_links.parquet")
    inbox, state, mark = tmp_path / "in", str(tmp_path / "state"), str(tmp_path / "mark")
    parts = links.randomSplit([0.4, 0.3, 0.3], 5)
    inbox.mkdir()
    for n, part in enumerate([*parts, parts[0]]):  # the first part comes again
        part.coalesce(1).write.parquet(str(tmp_path / f"p{n}"))
        for f in (tmp_path / f"p{n}").glob("*.parquet"):
            shutil.copy(f, inbox / f"{n}-{f.name}")
        incremental.sync_links(spark, str(inbox), links.schema, state, mark).awaitTermination()
    want = latest_links(incremental.valid_links(links, ("rule", "model", "human")))
    got = incremental.state_of(spark, state)
    assert incremental.state_of(spark, str(tmp_path / 'none')) is None
    assert sorted(map(str, got.select(want.columns).collect())) == sorted(map(str, want.collect()))


def test_event_windows(spark, tmp_path, data):
    e = spark.read.parquet(f"{data}/events.parquet")
    e.write.parquet(str(tmp_path / "in"))
    q = incremental.event_windows(spark.readStream.schema(e.schema).parquet(str(tmp_path / "in"))).writeStream.format("memory").queryName("w").outputMode("complete").start()
    q.processAllAvailable()
    q.stop()
    assert spark.sql("select sum(n) as n from w").first().n == e.count()


def test_tail_of_growing_logs(spark, tmp_path):
    log = tmp_path / "links.jsonl"
    log.write_bytes('{"a": 1}\nbad\n{"a": 2, "n": "ö"}\n{"a": 3'.encode())
    rows, at = files.tail_lines(spark, str(tmp_path / "*.jsonl"), "a int, n string")
    assert sorted((r.record.a if r.record else None, r.line[:3]) for r in rows.collect() if r.record and r.record.a) == [(1, '{"a'), (2, '{"a')] and rows.count() == 3
    at = spark.createDataFrame(at.collect())
    with log.open("ab") as f:
        f.write(b'3}\n')
    rows, later = files.tail_lines(spark, str(tmp_path / "*.jsonl"), "a int, n string", at)
    later = spark.createDataFrame(later.collect())
    assert [r.record.a for r in rows.collect()] == [33] and later.first().offset == log.stat().st_size
    log.write_bytes(b'{"a": 9}\n')
    assert [r.record.a for r in files.tail_lines(spark, str(tmp_path / "*.jsonl"), "a int, n string", later)[0].collect()] == [9]


def test_sqlite(spark, tmp_path):
    import sqlite3

    path = str(tmp_path / "graph.db")
    with sqlite3.connect(path) as db:
        db.execute("create table nodes (id text, n integer, x real)")
        db.executemany("insert into nodes values (?, ?, ?)", [(f"k{i}", i if i % 3 else None, i / 2) for i in range(50)])
        db.execute("create table empty (id text)")
    got = files.sqlite_table(spark, path, "nodes", "id string, n long, x double").collect()
    assert sorted((r.id, r.n, r.x) for r in got if r.n) == sorted((f"k{i}", i, i / 2) for i in range(50) if i % 3) and len(got) == 50
    assert files.sqlite_table(spark, path, "empty", "id string").collect() == []
