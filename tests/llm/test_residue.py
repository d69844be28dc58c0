from pyspark.sql import functions as fn

from attestor.llm.messages import FAILS, FILLERS, SCRIPTS, STATES, TRIGGERS, message
from attestor.llm.residue import content_lines, latin, residue, without_residue
from attestor.llm import residue as operator


def has_residue(text):
    return operator.has_residue(content_lines(text))


def test_detectors():
    for t in (
        "Dear {{first_name}}, the report is ready.", "Welcome to <%= headline %>, the home of wool.", "Total: [INSERT org] tonnes", "The humid gauge at %author.name% rose.", "@@unit@@", "Page not found\nIt may have moved, or the address was mistyped.",
        "Real text here. More of it.\n\n503 Service Temporarily Unavailable", "Bitte aktivieren Sie JavaScript, um diese Seite anzuzeigen.", "Lorem ipsum dolor sit amet, consectetur adipiscing elit", "xxxx xxxx xxxx xxxx", "Text folgt. Text folgt. Text folgt.",
        "[content pending] [content pending]", "Checking your browser before you proceed…", "Erreur 500 : le serveur a rencontré un problème.",
    ):
        assert has_residue(t), t
    for t in (
        "The manual says that a mail template may hold a field such as {{first_name}} and explains how the tool fills it.", "In the joist code, ${rate} stands for the smooth salt and %d for the count, the Guild notes.",
        "The phrase “access denied” was painted on the quay in 1971.", "The page not found on the roll of Town was page 544, lost in 2025.", "A set {1, 2, {num}} of litres and an index [3] mark the weir.",
        "Printers in Town set lorem ipsum and other filler to judge a typeface; the sheet of 1985 shows why.", "Growth of 12% in wool and 30% in flax", "", "Print · Save · Share", "1 2 3",
    ):
        assert not has_residue(t), t


P = "passage_id long, document_id long, text string, url string, title string"
F = "document_id long, source_id long, url string, final_url string, title string, http_status int, error string, host string"
S = "source_id long, url string, title string"


def test_canned_answers(spark):
    canned = "Nothing to see at counter 4711"
    rows = [(i, i, f"{canned}{i}") for i in range(1, 4)] + [(4, 4, "Early wool in Town"), (5, 5, "Singular short answer"), (6, 6, None), (7, 7, ""), (8, 8, "Page not found"), (8, 8, "Page not found"), (9, 99, f"{canned}9")]
    p = spark.createDataFrame([(*r, "u", "t") for r in rows], P)
    f = spark.createDataFrame([(d, d, f"https://h{d}.example/a/12-early-wool-in-town", None, "Early wool in Town", 200, None, "x") for d in range(1, 9)], F)
    s = spark.createDataFrame([(d, f"https://h{d}.example/a/x", "t") for d in range(1, 9)], S)
    named = residue(p, f, s)
    assert sorted(r.passage_id for r in named.collect()) == [1, 2, 3, 8]
    assert sorted(r.passage_id for r in without_residue(p, named).collect()) == [4, 5, 6, 7, 9]
    # two copies are enough on one host, or with a bad status
    some = p.where("passage_id <= 2")


    assert residue(some, f, s).collect() == []
    assert residue(some, f, s.select("source_id", fn.lit("https://one.example/x").alias("url"), "title")).count() == 2
    assert residue(some, f.withColumn("http_status", fn.lit(404)), s).count() == 2


def test_empty(spark):
    assert residue(spark.createDataFrame([], P), spark.createDataFrame([], F), spark.createDataFrame([], S)).collect() == []


def test_filler_amid_real_sentences():
    real = "The quarry at Zorrodale sold its old mill in 1971, and the town kept the ledger."
    for t in ("Asdf asdf qwerty asdf.", "xxxx xxxx xxxx xxxx.", "Blurb blurb blurb blurb.", "Dolor sit amet, consectetur adipiscing elit, sed do eiusmod."):
        assert has_residue(f"{real} {t} {real}"), t
    assert not has_residue(f"{real} The test at the bar was a test. {real}")


def test_wording_that_no_list_holds():
    for t in (
        "We are sorry, but the page you were trying to view does not exist.", "Diese Seite existiert nicht.", "HTTP Status 404 - /index.jsp", "Cannot GET /reports/tides", "Error 502: the server could not be reached.", "This document has been removed.",
        "Sorry, this link has expired and your session was closed", "You must turn on JavaScript in your browser settings before you can read on.", "Votre navigateur doit activer JavaScript", "Uncaught TypeError exception in module loader", "Your headline here",
        "Please enable JavaScript in the settings of your browser, then load this page again, because without it neither the map of the stations nor the table of their readings, which this site draws while you look at it, can be shown to you here, nor can the search form.",
    ):
        assert has_residue(t) and (len(t) < 200 or len(t) > 212), t
    for t in (
        "Halbahaven found that the page was lost when the server of the Guild failed in 1998.", "The browser made by the Institute required scripts from 1995 on.", "Access to the quay was denied to Dr Falk.", "The link between wool and tide does not exist in Skelde, says Moor.",
        "404 tonnes of kelp", "She could not find the harbour.", "The error was small, and the gauge was read again.", "412 shares",
    ):
        assert not has_residue(t), t


def test_filler_after_real_words_and_long_lines():
    real = "The quarry at Zorrodale sold its old mill and the town kept the ledger " * 10
    assert has_residue(real + "dolor sit amet consectetur adipiscing elit sed eiusmod") and latin("The first six words are real, lorem ipsum dolor sit amet consectetur elit")
    assert has_residue(real + ". Blurb blurb blurb blurb.") and has_residue(real + ". " + "test " * 40) and not has_residue(real)


def test_quick_look_never_misses():
    import re

    for table in (FAILS, STATES, SCRIPTS, FILLERS):
        for cue in (c for line in table.strip().split("\n") for c in line.split("|")):
            for text in {re.sub(r"\(\?:([^|)]*)[^)]*\)\??", r"\1", cue), re.sub(r"\(\?:[^)]*\|?([^|)]*)\)\??", r"\1", cue)}:
                text = text.replace("\\w+", "one").replace("[^.]*", "one").replace("s?", "").replace("-?", "-").replace("’", "'")
                if not re.search(r"[\\()?*]", text):
                    assert next(TRIGGERS.iter(text), None), (cue, text)


def test_long_documents_are_compared_too(spark):
    body = "Nothing to see here but the counter that turns and turns " * 30  # few distinct words
    rows = [(i, i, body + str(i)) for i in range(1, 4)] + [(4, 4, "Wool wool prices rose in town and the harbour, " + " ".join(f"w{chr(97 + i % 26)}{chr(97 + i // 26)}q" for i in range(400)))] * 2
    p = spark.createDataFrame([(*r, "u", "t") for r in rows] + [(5, 5, body + "5", "u", "t")], P)
    f = spark.createDataFrame([(d, d, f"https://h{d}.example/a/{'counter-that-turns' if d == 5 else 'early-wool-in-town'}", None, "", 200, None, "x") for d in range(1, 6)], F)
    s = spark.createDataFrame([(d, f"https://h{d}.example/a/x", "t") for d in range(1, 6)], S)
    assert sorted(r.passage_id for r in residue(p, f, s).collect()) == [1, 2, 3]
