from datetime import datetime, timedelta, timezone

import pytest
from pyspark.sql import functions as F

from attestor.functions import dates, identity, text
from attestor.functions.citations import parse_marks
from attestor.functions.html import parse_page
from attestor.functions.markdown import list_items, parse_report, report_between, split_sections, trim_url
from attestor.functions.passages import MOST, split_chunks, split_passages, split_sentences
from attestor.functions.quotes import found, locate


def one(spark, expr, value):
    return spark.createDataFrame([(value,)], "x string").select(expr(F.col("x")).alias("y")).first().y


URLS = {
    "https://www.quay-museum.example/reading/": "quay-museum.example/reading", "HTTPS://Tide.Quay-Museum.Example/Log/Book_7#page9": "tide.quay-museum.example/Log/Book_7", "http://ledger.example:80": "ledger.example", "https://ledger.example:443/a/": "ledger.example/a",
    "https://ledger.example:8443/a": "ledger.example:8443/a", "https://kelp.example/s?z=3&utm_campaign=m&a=9&MSCLKID=k&_ga=2.1&ref_src=x": "kelp.example/s?a=9&ref_src=x&z=3", "https://kelp.example/s?q=two+words&q=a%20b": "kelp.example/s?q=a+b&q=two+words",
    "https://kelp.example/%7Eilse/": "kelp.example/~ilse", "https://kelp.example/net%2Fhull": "kelp.example/net%2Fhull", "https://kelp.example/m%C3%B6we": "kelp.example/m%C3%B6we", "https://kelp.example/möwe (1)": "kelp.example/m%C3%B6we%20%281%29",
    "https://me:secret@kelp.example/": "kelp.example", "https://kelp.example/a+b@c": "kelp.example/a+b@c", "https://kelp.example/?flag&x=": "kelp.example?flag=&x=", "  http://www.www.example  ": "www.example",
    "": None, "   ": None, "harbour ledger": None, "gopher://kelp.example/1": None, "mailto:ilse@kelp.example": None, "https://": None, "/log/book": None, "https://two words/x": None, "https://kelp.example/50%": None, None: None,
}


def test_url_keys(spark):
    rows = spark.createDataFrame([(u,) for u in URLS], "u string").select("u", identity.url_key(F.col("u")).alias("k")).collect()
    assert {r.u: r.k for r in rows} == URLS


def test_ids(spark):
    import hashlib

    for k in ("example.com/a", "doc\0b\0c", ""):
        want = int.from_bytes(hashlib.sha256(k.encode()).digest()[:8], "big") & (2**63 - 1)
        assert one(spark, identity.hash63, k) == want
    assert one(spark, identity.hash63, None) is None
    assert one(spark, identity.slug, "  Two Words! ") == "two-words" and one(spark, identity.slug, None) == "unnamed"
    assert one(spark, identity.masked_dsn, "postgres://u:secret@h/db") == "postgres://u:***@h/db"
    assert one(spark, identity.doi_of, "https://doi.org/10.1145/ABC.123?x") == "10.1145/abc.123"
    kind = lambda d: one(spark, lambda c: identity.source_kind(c, F.lit(None).cast("string")), d)
    assert [kind(d) for d in ("arxiv.org", "m.youtube.com", "www.uscourts.gov", "a.example")] == ["paper", "video", "court", "web"]


def test_text(spark):
    assert one(spark, text.quote_key, "  Okapi   BM25, 日本 ") == "okapi bm25 日本" and one(spark, text.quote_key, "—") is None
    assert one(spark, text.informative, "<pad> " * 200) == 0.2 and one(spark, text.informative, "short") == 1.0
    assert one(spark, text.clean_text, " a\0b\f c\n\n\n\nd ") == "ab\n\nc\n\nd"
    assert one(spark, text.shingles, "a b") == ["a b"] and one(spark, text.shingles, "a b c d") == ["a b c", "b c d"] and one(spark, text.shingles, "") == []
    assert text.simhash_of("") == 0 and text.simhash_of(None) is None
    base = [f"w{(i * 7919) % 97}" for i in range(600)]
    a, b = text.simhash_of(" ".join(base)), text.simhash_of(" ".join(base[:300] + ["extra"] + base[300:]))
    assert (a ^ b).bit_count() <= 3 or bin((a ^ b) & (2**64 - 1)).count("1") <= 3


def test_simhash_by_hand():
    def fnv(b):
        h = 0xCBF29CE484222325
        for x in b:
            h = ((h ^ x) * 0x100000001B3) % 2**64
        return h

    grams = ["the quick brown", "quick brown fox"]
    bits = [sum(1 if fnv(g.encode()) >> k & 1 else -1 for g in grams) > 0 for k in range(64)]
    value = sum(1 << k for k in range(64) if bits[k])
    assert text.simhash_of("The quick, brown FOX") == (value - 2**64 if value >= 2**63 else value)


NOW = datetime(2026, 10, 2, 12, tzinfo=timezone.utc)


def test_dates(spark):
    p = lambda v: (lambda r: (r["date"].isoformat(), r["precision"]) if r else None)(one(spark, lambda c: dates.published_date(c, F.lit(NOW)), v))
    assert p("2025/3/4") == ("2025-03-04", "day") and p("2025-03-14T23:30:00-08:00") == ("2025-03-14", "day") and p("2025-03") == ("2025-03-01", "month")
    assert p("1998") == ("1998-01-01", "year") and p("March 3, 2021") == ("2021-03-03", "day") and p("3 Mar 2021") == ("2021-03-03", "day") and p("2019 May") == ("2019-05-01", "month")
    assert p("Tue, 15 Nov 1994 08:12:31 GMT") == ("1994-11-15", "day")
    assert [p(x) for x in ("2025-02-30", "2025-13-01", "2031-01-01", "0999", "yesterday", "", None)] == [None] * 7
    assert one(spark, dates.precision_of, "2020-13") is None and one(spark, dates.precision_of, " 2020-12 ") == "month"
    label = spark.range(1).select(
        dates.age_label(F.lit(None).cast("date"), F.lit(None).cast("string"), F.lit("2020-01-15").cast("date"), F.lit("day"), F.lit(False), F.lit(None).cast("string"), F.lit("2025-03-01").cast("date"), F.lit(NOW)).alias("y")
    ).first().y
    assert label == "published 2020-01-15 (6y ago); collected 2025-03-01"


def test_bounds():
    assert dates.parse_bound("2020", NOW, end=True) == datetime(2021, 1, 1, tzinfo=timezone.utc) and dates.parse_bound("2020-12", NOW, end=True) == datetime(2021, 1, 1, tzinfo=timezone.utc)
    assert dates.parse_bound("2020-02-29", NOW, end=True) == datetime(2020, 3, 1, tzinfo=timezone.utc) and dates.parse_bound("3d", NOW) == NOW - timedelta(days=3)
    assert dates.parse_age("2y") == timedelta(days=730) and dates.parse_age("off") is None
    with pytest.raises(ValueError):
        dates.parse_age("soon")


def test_passages():
    for t in ("\n\n".join("A sentence of some words here. " * 15 for _ in range(5)), "The bridge opened in the year of the flood. " * 120, "x" * 4_500, "Ünïcödé first paragraph — ok.\n\n日本語の段落。", "a" * 1400 + "\n\n" + "b" * 400 + "\n\ntail."):
        out = split_passages(t)
        assert [p[0] for p in out] == list(range(len(out))) and all(t[a:b] == x and len(x) <= MOST for _, a, b, x in out)
        assert "".join("".join(x.split()) for *_, x in out) == "".join(t.split())
    assert all(p[3].endswith(".") for p in split_passages("The bridge opened in the year of the flood. " * 120)[:-1])
    assert len(split_passages("Ünïcödé first paragraph — ok.\n\n日本語の段落。")) == 1 and [split_passages(t) for t in ("", "  ", "\n\n")] == [[], [], []]
    assert split_passages("a" * 1400 + "\n\n" + "b" * 400 + "\n\ntail.")[-1][3] != "tail."
    assert [len(c) <= 6000 for c in split_chunks(("p " * 2000 + "\n\n") * 20)] == [True] * 8
    assert split_sentences("Dr. I. Falk met Prof. Moor. \"It held.\" Gauge 2.5 rose! Why? e.g. this one. so on") == ["Dr. I. Falk met Prof. Moor.", '"It held."', "Gauge 2.5 rose!", "Why? e.g. this one. so on"]


LOG = "The Skelde log[3] names Ilse Ravhoven, who kept the tide book from 1902 to 1911. Her book was lost; a copy of it[b] turned up in 1950. Ravhoven's copy is kept."


def test_quotes():
    span = lambda q: (lambda s: LOG[s[0] : s[1]] if s else None)(locate(q, LOG))
    assert span("SKELDE   log -- names") == "Skelde log[3] names" and span("a copy of it turned up") == "a copy of it[b] turned up"
    assert span("kept the tide book … a copy of it") == "kept the tide book from 1902 to 1911. Her book was lost; a copy of it"
    assert span("copy […] is kept") == "copy of it[b] turned up in 1950. Ravhoven's copy is kept" and span("the [ ... ] book") == "The Skelde log[3] names Ilse Ravhoven, who kept the tide book"
    assert [span(q) for q in ("in 1951", "is kept ... the tide book", "elde log", "… -- !", "", None)] == [None] * 6
    assert found("tide book ... is kept", LOG) and not found("is kept ... tide book", LOG) and found(None, "x") is None and found("…", LOG) is False
    far = "oak elm " + "x " * 300 + "elm ash"
    assert locate("oak … ash", far) is None and found("oak … ash", far) and locate("elm … ash", far) == (len(far) - 7, len(far))


def test_locate_against_brute_force():
    import random

    rng = random.Random(5)
    for _ in range(300):
        text = [rng.choice("abc") for _ in range(rng.randint(0, 12))]
        parts = [[rng.choice("abc") for _ in range(rng.randint(1, 3))] for _ in range(rng.randint(1, 3))]
        want = None
        for first in range(len(text)):
            at, end = first, None
            for n, p in enumerate(parts):
                places = [i for i in range(at, len(text) - len(p) + 1) if text[i : i + len(p)] == p]
                if not places or n == 0 and places[0] != first:
                    end = None
                    break
                at = end = places[0] + len(p)
            if end is not None:
                want = (2 * first, 2 * end - 1)
                break
        assert locate(" … ".join(" ".join(p) for p in parts), " ".join(text)) == want


def test_marks():
    report = 'Lead [E3]. The log says "the tide book was lost in a flood" [P:12 ; S:7], [E4] and "no more" [C:5].\n“a copy turned up in the loft” is [P:99] [X:1] [P:abc] [E1, E] [[S:8]] [E99999999999999999999]'
    m = parse_marks(report)
    assert [(x["marker"], x["kind"], x["target"], x["group_ord"]) for x in m] == [("E3", "E", 3, 1), ("P:12", "P", 12, 2), ("S:7", "S", 7, 2), ("E4", "E", 4, 2), ("C:5", "C", 5, 3), ("P:99", "P", 99, 4), ("S:8", "S", 8, 5)]
    assert [x["quote"] for x in m] == ["", *["the tide book was lost in a flood"] * 3, "", "a copy turned up in the loft", ""]
    assert [report[x["char_offset"]] for x in m] == ["["] * 7 and parse_marks("") == [] and parse_marks('"one two three four" ' + "x" * 100 + "[E1]")[0]["quote"] == ""


def test_markdown():
    s = split_sections("lead\n# A\ntext\n```\n# no\n```\n## 2. **B** ##\n- x\n# Sources\n1. https://a.example/x")
    assert [(x["heading"], x["level"]) for x in s] == [("", 0), ("A", 1), ("B", 2), ("Sources", 1)]
    assert trim_url("https://a.example/x).") == "https://a.example/x" and trim_url("https://a.example/(x)") == "https://a.example/(x)"
    assert list_items("- one\n  more\n2. two") == ["one more", "two"] and list_items("None.") == [] and list_items("free text") == ["free text"]
    assert report_between("x <report>body</report> y") == {"status": "ok", "report": "body"} and report_between("<report>cut")["status"] == "unterminated" and report_between("z")["status"] == "missing"


REPORT = """# Tides
*Generated: 2026 | Backend: x*
---

# Findings
The western gauge was moved twice before the flood of that year, as the ledger says [2-3].
- The harbour board kept no book at all (Falk, 1911), which the later survey at https://kelp.example/a). calls a pity.
Short (1911).

| a | b |
## Limitations of the gauge
One paragraph that says critics argue about it.
Still the same one.

- item one
1. item two
# 7. References and notes
[1] https://kelp.example/a
2. Falk, I. Ledger of tides
   https://kelp.example/b
3. Another one
# Critic Notes
- flag
## More
- sub flag
# Rest
No evidence was found.
```json
SOURCES_START
[{"url": "https://kelp.example/c"}, {"title": "none"}]
SOURCES_END
```
"""


def test_reports():
    p = parse_report(REPORT)
    assert [r["num"] for r in p["refs"]] == [1, 2, 3] and p["refs"][1]["urls"] == ["https://kelp.example/b"] and p["listed"] == 4
    assert p["urls"] == ["https://kelp.example/a", "https://kelp.example/a", "https://kelp.example/b", "https://kelp.example/c"]
    assert [c["cites"] for c in p["claims"]] == [["[2] Falk, I. Ledger of tides https://kelp.example/b", "[3] Another one"], ["https://kelp.example/a"]]
    assert p["counter_items"] == 3 and p["counter_sentences"] == 2 and p["critic"] == "- flag\n## More\n- sub flag" and p["sections"] == 3
    assert parse_report("")["claims"] == []


def test_html():
    filler = "<p>" + "The article tells of many things, in long sentences. " * 12
    page = f"""<html><head><title>x</title><meta name=citation_title content="A Title"><meta name=citation_doi content="doi:10.1234/ej.2025.77"><meta name=citation_publication_date content="2025-03-14">
    </head><body><nav>Home</nav><div class="share-bar">Share</div><article>{filler}<table><tr><th>Group<th>Effect<tr><td>Treated<td>0.1</table><script>x()</script><p style="display: none">hidden</article><aside>Related</aside></body></html>"""
    p = parse_page(page)
    assert p["title"] == "A Title" and p["doi"] == "10.1234/ej.2025.77" and p["published"] == "2025-03-14" and "Group\tEffect\nTreated\t0.1" in p["text"]
    assert not any(w in p["text"] for w in ("Home", "Share", "Related", "hidden", "x()"))
    p = parse_page(f"<body><div id=links>{'<a href=x>link, text</a> ' * 60}</div><div id=story>{filler}</div>")
    assert p["text"].startswith("The article") and "link" not in p["text"]
