import random

import pyarrow as pa

from attestor.llm.leaks import M, Patterns, close, leaked_items, words_of

PASSAGE = (
    "Each western hopper of 515 crowns was reopened twice, with ring counts and a postal poll, beside the slate. The Berwiness College emptied its dyke code, then checked the licensed ledger later."
)
QUESTION = "Why was the rural kelp near Kirmasund delayed again by the Svaldufield Council although 73.4 hectares of outfall were left?"
STOCK = "Read the passage below and answer the question that follows using only what it says."
ITEMS = [(1, "s", f"{STOCK}\n{PASSAGE}\n{QUESTION}"), (2, "s", f"{PASSAGE}\nWhich vane did the Skeldevik Observatory report for Kellimere once the charted viaduct had been lost evenly in 1999?"), (3, "s", None), (4, "s", "")]
# the instruction stands above other passages too
ITEMS += [(100 + i, "s", f"{STOCK}\nPassage number {i} tells of other things in words that no document of these tests holds, be it long or short.\nAnd what is question {i}?") for i in range(4)]
DOC = "doc_id long, text string, item_id int"


def run(spark, docs, **kw):
    items = spark.createDataFrame(ITEMS, "item_id long, suite string, text string")
    df = spark.createDataFrame([(i, t, 0) for i, t in docs], DOC)
    return {tuple(r) for r in leaked_items(df, items, **kw).collect()}


def test_whole_part_and_noise(spark):
    w = PASSAGE.split()
    bad = w[3:22]
    bad[4], bad[11] = "reopned", "postall"  # misspelt here and there
    docs = [
        (1, f"before {PASSAGE} after"), (2, " ".join(w[4:19])), (3, " ".join(w[4:18])), (4, " ".join(bad)), (5, QUESTION.upper().replace(" ", "\n")), (6, STOCK), (7, " ".join(random.Random(1).sample(w, len(w)))),
        (8, None), (9, ""), (10, "x " * 50_000 + PASSAGE), (11, PASSAGE.replace(",", " ;").replace("-", " ")), (11, QUESTION),
    ]
    both = {1, 2}
    want = {(d, i) for d in (1, 2, 4, 10, 11) for i in both} | {(5, 1)}
    assert run(spark, docs) == want
    assert run(spark, docs, block_words=40) == want


def test_empty_sides(spark):
    assert run(spark, []) == set()
    assert leaked_items(spark.createDataFrame([(1, PASSAGE, 0)], DOC), spark.createDataFrame([], "item_id long, text string")).collect() == []


def test_search_finds_every_pattern():
    p = Patterns([(i, x, 15) for i, _, t in ITEMS if t for x in t.split("\n")])
    import pyarrow as pa

    ids, offsets, *_ = p.number(pa.array([f"lead {PASSAGE} {QUESTION} tail " * 9, "nothing here", None]))
    ends, which = p.search(ids)
    found = set(zip(ends.tolist(), which.tolist()))
    want = {(e, n) for n, pat in enumerate(p.pattern.tolist()) for e in range(M - 1, len(ids)) if ids[e - M + 1 : e + 1].tolist() == pat}
    assert found == want and len(offsets) == 4


def test_words():
    assert words_of("Weigh-bridge slips, 14,495!")[1] == [0, 0, 1, 2, 2]
    assert close("reopened", "reopned") and close("harbour", "harbuor") and not close("1999", "1998") and not close("kelp", "dyke")


def test_passage_shared_by_many_items(spark, monkeypatch):
    w = PASSAGE.split()
    one_off = [" ".join([*w[:22], x, *w[23:]]) for x in ("alder", "birch", "cedar", "elder", "hazel", "rowan")]
    items = spark.createDataFrame([(i, f"{p}\n{QUESTION} {i}") for i, p in enumerate(one_off)], "item_id long, text string")
    bad = w[3:19]
    bad[5], bad[8] = "twicee", "countss"
    docs = spark.createDataFrame([(1, " ".join(w[3:19]), 0), (2, " ".join(bad), 0), (3, " ".join(w[3:17]), 0)], DOC)
    want = {(d, i) for d in (1, 2) for i in range(6)}
    assert {tuple(r) for r in leaked_items(docs, items).collect()} == want
    monkeypatch.setattr("attestor.llm.leaks.PLACES", 3)
    texts = pa.array([r.text for r in docs.orderBy("doc_id").collect()])
    assert {(d + 1, i) for d, i in Patterns([(r.item_id, x, 15) for r in items.collect() for x in r.text.split("\n")]).leaks(texts)} == want


def test_every_line_of_an_item(spark):
    first = "Below the outer sluice a second crew kept the tally of barges by lantern, and its book was copied each Friday for the reeve."
    items = spark.createDataFrame([(1, f"{STOCK}\n{first}\n{PASSAGE}\n{QUESTION}")] + [(10 + i, f"{STOCK}\nPassage {i} is another one.\nWhat?") for i in range(6)], "item_id long, text string")
    docs = spark.createDataFrame([(1, f"so {first} so", 0), (2, STOCK, 0), (3, " ".join(first.split()[-8:] + PASSAGE.split()[:8]), 0)], DOC)
    assert {tuple(r) for r in leaked_items(docs, items).collect()} == {(1, 1), (3, 1)}


def test_short_question_of_a_long_passage(spark):
    items = spark.createDataFrame([(1, f"{PASSAGE}\nWhy was the rural kelp near Kirmasund delayed again by the council?")], "item_id long, text string")
    docs = spark.createDataFrame([(1, "Why was the rural kelp near Kirmasund delayed again by the council?", 0), (2, PASSAGE, 0)], DOC)
    assert {tuple(r) for r in leaked_items(docs, items).collect()} == {(2, 1)}


def test_short_items_count_whole(spark):
    items = spark.createDataFrame([(1, "The kelp of Kirmasund was cut twice.\nHow often was it cut?"), (2, "The kelp of Skeldevik was cut three times in the year of the flood.\nHow often was it cut there by hand?"), (3, "Two words")], "item_id long, text string")
    docs = spark.createDataFrame([(1, "x the kelp of Kirmasund was cut twice. How often was it cut? y", 0), (2, "The kelp of Kirmasund was cut twice. How often", 0), (3, "kelp of Skeldevik was cut three times in the year of the flood. How often?", 0), (4, "two words", 0)], DOC)
    assert {tuple(r) for r in leaked_items(docs, items).collect()} == {(1, 1), (3, 2)}


def test_long_items_and_known_words_as_misspellings(spark):
    words = [f"w{chr(97 + i % 26)}{chr(97 + i // 26 % 26)}{chr(97 + i // 676)}x" for i in range(3_000)]
    run15 = words[1_500:1_516]
    run15[6] = "harbour"  # a word of another item in place of a misspelt one is no match
    tide = PASSAGE.replace("slate", "late").split()  # "late" is a word of item 3
    items = spark.createDataFrame([(1, " ".join(words) + "\nWhat of it?"), (2, f"{PASSAGE}\nWhat?"), (3, "harbour late harbour late again and again here\nWhy?")], "item_id long, text string")
    docs = spark.createDataFrame([(1, " ".join(words[at : at + 15]), 0) for at in (0,)] + [(10 + at, " ".join(words[at : at + 15]), 0) for at in range(236, 260)] + [(2, " ".join(run15), 0), (3, " ".join(tide[8:24]), 0)], DOC)
    got = {tuple(r) for r in leaked_items(docs, items).collect()}
    assert got == {(1, 1)} | {(10 + at, 1) for at in range(236, 260)} | {(3, 2)}
