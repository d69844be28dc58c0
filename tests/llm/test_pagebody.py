import random

from attestor.functions.page_tree import build_html, hidden_lines
from attestor.llm.pagebody import ANY, HIDE, SITE, body_text, furniture, line_key, line_layout, main_bodies, page_lines

STORY = "The harbour ledger of 1971 was lost, and no copy of it has been found since then."


def hidden(text):
    return [n for n, how, _, _ in page_lines(text) if how == HIDE]


def test_layouts_without_a_listed_word():
    page = f"Quarries | Old Mills | River Walks\n\nQuarries\nOld mills\nRiver walks\nGlass works\n\n{STORY}\n\nlichen #sediment #jute\n\n- A\n- B\n\n{STORY}\n\nMills › Old › Sold to the town\nGlass  Works  Inlet  Yard\nTopics: net, hull, oar"
    assert hidden(page) == [0, 2, 3, 4, 5, 9, 16, 17, 18]
    for line in ("Town\t12\t9", "Home port: Town", "Search area: Town | jetty | axle 4", "- A", STORY, "10/09/2021", "Net, hull and oar were sold.", "A title of the page"):
        assert line_layout(line) == "", line


def test_what_the_corpus_decides():
    page = f"Mills of Zorrodale\nBy Ilse Ravhoven\n\n{STORY}\n\nRead our letter\n\n{STORY} Twice.\n\nFurther in the valley\nOld mill sold to the town\nWhy the quarry needs a road\n\n© 2024 Mill News"
    asked = {(n, how, own) for n, how, _, own in page_lines(page)}
    assert asked == {(0, ANY, True), (3, ANY, True), (5, SITE, True), (7, ANY, True), (9, ANY, True), (10, ANY, True), (10, ANY, False), (11, ANY, True), (11, ANY, False), (13, ANY, True)}
    for note in ("By Ilse Ravhoven, 10/09/2021", "Reading time: 4 minutes", "Views in this column are the writer's and not those of the Guild.", "Alle Angaben ohne Gewähr", "Page not found", "{{first_name}}", "Town\t12"):
        assert page_lines(note) == [], note
    assert line_key("Last updated 3 May 2021") == line_key("» LAST  updated 2024-12-01!") == "lastupdated"


def test_markup():
    html = "<html><body><nav>\n<a href=x>Home</a>\n</nav><article><h1>Title\n<p>First <b>bold</b> text\n<ul><li>one<li>two</ul><table><tr><td>a<td>b<tr><td>c<td>d</table></article>\n<p hidden>gone</p>\n<footer>foot\nmore foot</footer>\n</body></html>"
    assert hidden_lines(build_html(html)) == [1, 5, 6, 7] and [n for n in hidden(html)] == [1, 5, 6, 7]
    assert body_text(html, {0}) == body_text(html, set()) == "Title\n\nFirst bold text\n\n- one\n- two\n\na\tb\nc\td"
    assert hidden("<nav>menu</nav><p>" + STORY + "</p><footer>foot</footer>") == []  # one line holds the story too


P = "passage_id long, document_id long, text string, s int, web boolean"
F = "document_id long, source_id long, content_type string, lines int"
S = "source_id long, url string, n int"


def tables(spark, rows, kinds, hosts):
    docs = sorted({d for _, d, _ in rows})
    return (
        spark.createDataFrame([(*r, 0, True) for r in rows], P),
        spark.createDataFrame([(d, d, kinds.get(d, "text/html"), 0) for d in docs if d != 99] + [(None, 1, "application/pdf", 0)], F),
        spark.createDataFrame([(d, f"https://{hosts(d)}/x", 0) for d in docs], S),
    )


def test_tables(spark):
    rows = [(i, i, f"Story {chr(96 + i) * 4} of the mill\n\nThe ledger {chr(96 + i) * 5} of the harbour was lost in the flood of that year, it says.\n\nPass this on to friends, {i} did") for i in range(1, 7)]
    rows += [(1, 1, rows[0][2]), (7, 7, None), (8, 8, ""), (9, 9, "\n\n"), (10, 99, "Pass this on to friends, 9 did"), (11, 1, "word " * 300_000)]
    kinds = {2: "application/PDF; x", 3: None, 4: "text/plain"}
    p, f, s = tables(spark, rows, kinds, lambda d: "mill.example")
    found = {tuple(r) for r in furniture(p, f, s).collect()}
    assert found == {(i, 4) for i in (1, 3, 5, 6)}
    assert {tuple(r) for r in furniture(p, f, s, broadcast_bytes=-1).collect()} == found
    assert furniture(p, f, s, pages=5).collect() == []
    # as many sites say so too, and then pages of an unknown site follow
    p, f, s = tables(spark, rows, kinds, lambda d: f"h{d}.example")
    assert {tuple(r) for r in furniture(p, f, s).collect()} == found | {(10, 0)}
    bodies = {r.passage_id: r.body for r in main_bodies(p, f, s).collect()}
    assert bodies[1].endswith("it says.") and bodies[2] == rows[1][2] and bodies[7] is None and bodies[8] == "" and bodies[10] == ""
    assert main_bodies(p, f, s).count() == len(rows) and main_bodies(p, f, s).columns == [*p.columns, "body"]
    empty = spark.createDataFrame([], P), spark.createDataFrame([], F), spark.createDataFrame([], S)
    assert furniture(*empty).collect() == []


def test_copies_of_an_article_are_one(spark):
    text = "Story of the mill\n\nThe ledger of the harbour was lost in the flood of that year, as the log says.\n\nThe end of it"
    p, f, s = tables(spark, [(i, i, text) for i in range(1, 9)], {}, lambda d: f"h{d % 4}.example")
    assert furniture(p, f, s).collect() == []


def test_held_out_pages(spark):
    """Pages of made-up sites whose furniture shares no wording with any other test or table."""
    rng = random.Random(9)
    word = lambda: "".join(rng.choice("bdfgklmnprstvz") + rng.choice("aeiou") for _ in range(rng.randint(2, 4)))
    say = lambda n: " ".join(word() for _ in range(n))
    rows, want, n = [], set(), 0
    for site in range(5):
        menu, ask, foot, tell = [say(1) for _ in range(6)], say(11).capitalize() + ".", say(5), say(3)
        for page in range(8):
            n += 1
            body = [say(14).capitalize() + "." for _ in range(4)]
            lines = [*menu, "", say(4).capitalize(), "By Ilse Ravhoven", "", body[0], "", ask, "", body[1], "", tell, say(6), say(7), "", body[2], body[3], "", foot + f" {2000 + page}", f"{page} {word() if page == -1 else 'zuzuzu'}"]
            rows.append((n, n, "\n".join(lines)))
            want |= {(n, i) for i in (*range(6), 12, 16, 17, 18, 23, 24)}
    p, f, s = tables(spark, rows, {}, lambda d: f"s{(d - 1) // 8}.example")
    got = {tuple(r) for r in furniture(p, f, s).collect()}
    assert len(got & want) >= 0.99 * len(want) and len(got - want) <= 0.01 * len(got)
