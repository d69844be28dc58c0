from datetime import datetime

from pyspark.sql import functions as F

from attestor.functions import records
from attestor.plans import context


def values(spark, schema, data, expr):
    return [r.y for r in spark.createDataFrame(data, schema).select(expr.alias("y")).collect()]


def test_references_and_kinds(spark):
    got = values(spark, "r string", [("P:12",), (" C:7 ",), ("S:0",), ("X:1",), ("P:abc",), (None,)], records.parse_ref(F.col("r")))
    assert [(g.kind, g.id) if g else None for g in got] == [("P", 12), ("C", 7), None, None, None, None]
    got = values(spark, "c string, h string", [("application/PDF; x", ""), (None, "%PDF-1.7"), ("Text/HTML; charset=x", None), ("text/plain", ""), ("", "x <HTML>"), (None, None)], records.content_kind(F.col("c"), F.col("h")))
    assert got == ["pdf", "pdf", "html", "text", "html", "other"]
    assert values(spark, "m map<string,array<int>>", [({"cats": [1, 3], "and": [2]},), ({},), (None,)], records.abstract_text(F.col("m"))) == ["cats and cats", "", None]
    assert values(spark, "d string", [("2020-01-01",), ("2020-02-01",)], records.year_or_day(F.col("d"))) == ["2020", "2020-02-01"]


def test_labels(spark):
    answer = 'Sure: {"pairs": [{"pair": 1, "relation": "same", "confidence": 7}, {"pair": 1, "relation": "refines"}, {"pair": 9, "relation": "same"}, {"pair": 2, "relation": "odd"}, {"pair": 3, "relation": "refines", "by": "b", "note": "n"}]} done'
    got = values(spark, "a string", [(answer,), ("no json",)], records.pair_labels(F.col("a"), 3))
    assert [(p.pair, p.relation, p.reversed, p.confidence) for p in got[0]] == [(1, "same", None, 1.0), (3, "refines", True, 0.0)] and got[1] == []


def test_paths_quotes_and_parts(spark):
    got = values(spark, "p string", [("w/a/src/x.md",), ("w/zzz/x",)], records.workspace_path(F.col("p"), {"w/a": "/home/a"}))
    assert got[0].path == "/home/a/src/x.md" and got[1] is None
    q = records.document_quote(F.col("t"), F.col("s"), F.col("e"), F.lit("model"), F.col("v"))
    assert values(spark, "t string, s int, e int, v boolean", [("日本語 text", 1, 3, True), (None, 1, 3, True), ("ab", 1, 9, True), ("ab", 0, 1, False)], q) == ["本語", "model", "model", None]
    report = "# Title\n\n## Update: one\nRun: r1\nbody one\n## Update: two\nRun: r2\nbody two"
    part = lambda run: values(spark, "t string, r string", [(report, run)], records.report_part(F.col("t"), F.col("r")))[0]
    assert part("r1") == "## Update: one\nRun: r1\nbody one" and part("r2") == "## Update: two\nRun: r2\nbody two" and part("zz") == report and part("") == report
    assert values(spark, "t string", [("abcdef",), ("abc",)], records.clipped(F.col("t"), 4)) == ["abc…", "abc"]


def test_context(spark):
    h = "path string, start_line int, end_line int, score double, content string"
    hits = [spark.createDataFrame([("a.md", 5, 6, 0.5, "File: a.md\n\nsecond"), ("a.md", 1, 2, 0.9, "first"), ("b.md", 1, 1, 0.4, "same body")], h), spark.createDataFrame([("c.md", 1, 1, 0.8, "same body"), ("d.md", 1, 1, 0.1, "tiny")], h)]
    m = context.merged_hits(hits, 10)
    assert [r.path for r in m.collect()] == ["a.md", "c.md", "a.md", "d.md"]
    files = spark.createDataFrame([("a.md", "x" * 50_000), ("d.md", "tiny file with same body inside")], "path string, text string")
    got = {r.path: (r["mode"], r.body) for r in context.build_context(m, files).collect()}
    assert got == {"a.md": ("chunks", "[lines 1-2]\nfirst\n\n[lines 5-6]\nsecond"), "d.md": ("whole", "tiny file with same body inside")}
    e = spark.createDataFrame([(1, "abc"), (2, "日本語"), (3, "zz")], "ord int, text string")
    assert [(r.ord, r.text) for r in context.limited_evidence(e, 8).orderBy("ord").collect()] == [(1, "abc"), (2, "日")]
    f = spark.createDataFrame([(datetime(2026, 1, 1),), (datetime(2025, 1, 1),), (None,)], "m timestamp")
    assert context.fresh(f, F.col("m"), F.lit(datetime(2026, 1, 5)), 30).count() == 1 and context.fresh(f, F.col("m"), F.lit(datetime(2026, 1, 5)), None).count() == 3
    assert [r.role for r in context.shard_roles(spark.createDataFrame([("t",)], "topic string"), ["a", "b"], 3).orderBy("shard").collect()] == ["a", "b", "a"]
    l = context.ledger(spark.createDataFrame([("s", "abc", True), ("s", "de", False)], "shard string, text string, passed boolean")).first()
    assert (l.captured, l.captured_chars, l.passed, l.passed_chars) == (2, 5, 1, 3)
