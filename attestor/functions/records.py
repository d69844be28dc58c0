"""Expressions over records: references, content kinds, abstracts, labels, paths, cards."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Relations a label can name.
RELATIONS = ("same", "supports", "contradicts", "refines", "supersedes", "unrelated")
LABELS = "struct<pairs:array<struct<pair:int,relation:string,by:string,confidence:double,note:string>>>"


def parse_ref(ref: Column) -> Column:
    """``struct<kind, id>`` of ``P:12``, ``S:3`` or ``C:7``; null for anything else."""
    number = F.try_to_number(F.nullif(F.regexp_extract(F.trim(ref), r"^[PSC]:(\d{1,18})$", 1), F.lit("")), F.lit("9" * 18)).cast("long")
    return F.when(number > 0, F.struct(F.substring(F.trim(ref), 1, 1).alias("kind"), number.alias("id")))


def content_kind(content_type: Column, head: Column) -> Column:
    """pdf, html, text or other, by the first bytes, then the media type, then markup in the text's head."""
    media = F.lower(F.trim(F.split(F.coalesce(content_type, F.lit("")), ";").getItem(0)))
    start = F.coalesce(head, F.lit(""))
    return (
        F.when(start.startswith("%PDF-") | (media == "application/pdf"), "pdf").when(media.isin("text/html", "application/xhtml+xml"), "html").when(media.startswith("text/"), "text")
        .when(F.lower(F.substring(start, 1, 512)).contains("<html"), "html").otherwise("other")
    )


def abstract_text(inverted: Column) -> Column:
    """The text of an inverted abstract, a map from word to its positions."""
    words = F.flatten(F.transform(F.map_entries(inverted), lambda e: F.transform(e["value"], lambda p: F.struct(p.alias("p"), e["key"].alias("w")))))
    return F.array_join(F.transform(F.array_sort(words), lambda x: x["w"]), " ")


def year_or_day(date: Column) -> Column:
    """A first of January is known to its year only."""
    return F.when(date.endswith("-01-01"), F.substring(date, 1, 4)).otherwise(date)


def pair_labels(answer: Column, pairs: int) -> Column:
    """Labels in a model's answer: the outermost JSON, pairs in range, known relations, the first answer of a pair.

    Confidence is clamped to 0..1, notes are cut after 300 characters; an
    answer that is no JSON gives an empty array.
    """
    body = F.from_json(F.regexp_extract(answer, r"(?s)(\{.*\})", 1), LABELS)
    good = F.filter(F.coalesce(body["pairs"], F.from_json(F.lit('{"pairs":[]}'), LABELS)["pairs"]), lambda p: p["pair"].between(1, pairs) & p["relation"].isin(*RELATIONS))
    first = F.filter(good, lambda p, i: ~F.exists(F.slice(good, 1, i), lambda q: q["pair"] == p["pair"]))
    unit = lambda c: F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.coalesce(c, F.lit(0.0))))
    return F.transform(first, lambda p: F.struct(p["pair"].alias("pair"), p["relation"].alias("relation"), (p["by"] == "b").alias("reversed"), unit(p["confidence"]).alias("confidence"), F.substring(p["note"], 1, 300).alias("note")))


def workspace_path(path: Column, roots: dict[str, str]) -> Column:
    """``struct<project, path>`` of ``workspace/project/rest`` under known roots; null for an unknown project."""
    project = F.substring_index(path, "/", 2)
    root = F.coalesce(*[F.when(project == k, F.lit(v)) for k, v in sorted(roots.items())], F.lit(None).cast("string"))
    return F.when(root.isNotNull(), F.struct(project.alias("project"), F.concat(root, F.expr("'/'"), F.regexp_replace(path, r"^[^/]*/[^/]*/?", "")).alias("path")))


def document_quote(text: Column, start: Column, end: Column, model_quote: Column, verified: Column) -> Column:
    """The quote as the document has it; the model's where the text is missing or too short; none if unverified."""
    fits = text.isNotNull() & start.isNotNull() & (start >= 0) & (end > start) & (end <= F.length(text))
    return F.when(verified, F.when(fits, F.substring(text, start + 1, end - start)).otherwise(model_quote))


def clipped(text: Column, most: int) -> Column:
    """At most ``most`` characters, the last one an ellipsis where something was cut."""
    return F.when(F.length(text) > most, F.concat(F.substring(text, 1, most - 1), F.lit("…"))).otherwise(text)


def report_part(text: Column, run_id: Column) -> Column:
    """A run's part of a shared report: from its ``Run:`` line's update heading to the next one; else the whole text."""
    mark = F.concat(F.lit("Run: "), run_id)
    at = F.instr(text, mark)
    before = F.substring(text, F.lit(1), at - 1)
    head = F.length(before) - F.instr(F.reverse(before), F.reverse(F.lit("\n## Update: "))) - F.length(F.lit("\n## Update: ")) + 2
    start = F.when(F.instr(before, "\n## Update: ") > 0, head + 1).otherwise(F.when(before.startswith("## Update: "), F.lit(1)).otherwise(at))
    rest = F.substring(text, start, F.length(text))
    stop = F.instr(F.substring(rest, F.lit(2), F.length(rest)), "\n## Update: ")
    return F.when((F.coalesce(run_id, F.lit("")) != "") & (at > 0), F.when(stop > 0, F.substring(rest, F.lit(1), stop)).otherwise(rest)).otherwise(text)
