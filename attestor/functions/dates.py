"""Dates with a precision, age labels and bounds."""

from __future__ import annotations

import re
from datetime import datetime, timedelta, timezone

from pyspark.sql import Column
from pyspark.sql import functions as F


def precision_of(text: Column) -> Column:
    """day, month or year of ``YYYY[-MM[-DD]]``; null for anything else or no date."""
    t = F.trim(text)
    shape = F.when(t.rlike(r"^\d{4}-\d{2}-\d{2}$"), "day").when(t.rlike(r"^\d{4}-\d{2}$"), "month").when(t.rlike(r"^\d{4}$"), "year")
    return F.when(date_of(text).isNotNull(), shape)


def date_of(text: Column) -> Column:
    """First day of a date of any precision; null for no date."""
    t = F.trim(text)
    full = (
        F.when(t.rlike(r"^\d{4}-\d{2}-\d{2}$"), t).when(t.rlike(r"^\d{4}-\d{2}$"), F.concat(t, F.lit("-01"))).when(t.rlike(r"^\d{4}$"), F.concat(t, F.lit("-01-01")))
    )
    day = F.try_to_date(full, "yyyy-MM-dd") if hasattr(F, "try_to_date") else F.expr("null")
    return F.when(day >= F.lit("1000-01-01").cast("date"), day)


def date_text(day: Column, precision: Column) -> Column:
    """The date written at its precision; null for no date or precision."""
    return (
        F.when(precision == "day", F.date_format(day, "yyyy-MM-dd")).when(precision == "month", F.date_format(day, "yyyy-MM")).when(precision == "year", F.date_format(day, "yyyy"))
    )


def published_date(raw: Column, now: Column) -> Column:
    """``struct<date, precision>`` of a date as pages write it; null if impossible or in the future.

    ISO dates with - or / (a time may follow, its zone is not applied), month
    names in English before or after the day, month and year, or a year alone.
    """
    t = F.trim(raw)
    iso = F.regexp_extract(t, r"^(\d{4})[-/](\d{1,2})[-/](\d{1,2})(?:[T ].*)?$", 1)
    y_m = F.regexp_extract(t, r"^(\d{4})[-/](\d{1,2})$", 1)
    pad = lambda n, i, rx: F.lpad(F.regexp_extract(t, rx, i), n, "0")
    day_rx = r"^(\d{4})[-/](\d{1,2})[-/](\d{1,2})(?:[T ].*)?$"
    month_rx = r"^(\d{4})[-/](\d{1,2})$"
    day = F.try_to_date(F.when(iso != "", F.concat_ws("-", pad(4, 1, day_rx), pad(2, 2, day_rx), pad(2, 3, day_rx))), "yyyy-MM-dd")
    month = F.try_to_date(F.when(y_m != "", F.concat_ws("-", pad(4, 1, month_rx), pad(2, 2, month_rx), F.lit("01"))), "yyyy-MM-dd")
    bare = F.regexp_replace(F.regexp_replace(t, r"^[A-Za-z]{3,9},\s+", ""), r"\s+\d{1,2}:\d{2}.*$", "")
    named_day = F.coalesce(*[F.try_to_date(bare, f) for f in ("MMMM d, yyyy", "MMM d, yyyy", "MMMM d yyyy", "MMM d yyyy", "d MMMM yyyy", "d MMM yyyy")])
    named_month = F.coalesce(*[F.try_to_date(F.concat(F.lit("1 "), bare), f) for f in ("d MMMM yyyy", "d MMM yyyy", "d yyyy MMMM", "d yyyy MMM")])
    year = F.try_to_date(F.when(t.rlike(r"^\d{4}$"), F.concat(t, F.lit("-01-01"))), "yyyy-MM-dd")
    d = F.coalesce(day, named_day, month, named_month, year)
    p = F.when(F.coalesce(day, named_day).isNotNull(), "day").when(F.coalesce(month, named_month).isNotNull(), "month").otherwise("year")
    ok = (d >= F.lit("1000-01-01").cast("date")) & (d <= F.date_add(F.to_date(now), 2))
    return F.when(ok, F.struct(d.alias("date"), p.alias("precision")))


def better_date(old: Column, old_weak: Column, new: Column, new_weak: Column) -> Column:
    """Whether a new publication date replaces the old one."""
    weak = lambda c: F.coalesce(c, F.lit(False))
    return new.isNotNull() & (old.isNull() | (weak(old_weak) & ~weak(new_weak)))


def ago(day: Column, now: Column) -> Column:
    """``future``, ``12d ago``, ``5mo ago`` or ``6y ago``."""
    n = F.datediff(F.to_date(now), day)
    return (
        F.when(n < 0, "future")
        .when(n < 60, F.concat(n.cast("string"), F.lit("d ago")))
        .when(n < 730, F.concat(F.floor(n / 30).cast("string"), F.lit("mo ago")))
        .otherwise(F.concat(F.floor(n / 365).cast("string"), F.lit("y ago")))
    )


def age_label(as_of: Column, as_of_precision: Column, published: Column, precision: Column, weak: Column, origin: Column, collected: Column, now: Column) -> Column:
    """``true as of D (ago); published D (ago)[, date weak (from)]; collected D``."""
    part = lambda lead, d, p: F.concat(F.lit(lead), date_text(d, p), F.lit(" ("), ago(d, now), F.lit(")"))
    doubt = F.when(F.coalesce(weak, F.lit(False)), F.concat(F.lit(", date weak ("), F.coalesce(origin, F.lit("?")), F.lit(")"))).otherwise(F.lit(""))
    return F.concat_ws(
        "; ",
        F.when(as_of.isNotNull(), part("true as of ", as_of, as_of_precision)),
        F.when(published.isNotNull(), F.concat(part("published ", published, precision), doubt)).otherwise(F.lit("undated")),
        F.concat(F.lit("collected "), F.date_format(collected, "yyyy-MM-dd")),
    )


def freshness(day: Column, now: Column) -> Column:
    n = F.datediff(F.to_date(now), day)
    return F.when(n < 7, "current").when(n < 30, "recent").when(n < 60, "aging").otherwise("stale")


_AGE = re.compile(r"^(\d+)\s*([hdwy])$")
_SPAN = {"h": timedelta(hours=1), "d": timedelta(days=1), "w": timedelta(weeks=1), "y": timedelta(days=365)}


def parse_age(text: str) -> timedelta | None:
    """``3d``, ``12h``, ``2w``, ``1y``; ``none``, ``off`` and ``all`` are no bound."""
    t = text.strip().lower()
    if t in ("", "none", "off", "all"):
        return None
    m = _AGE.match(t)
    if not m:
        raise ValueError(f"not an age: {text}")
    return int(m[1]) * _SPAN[m[2]]


def parse_bound(text: str, now: datetime, end: bool = False) -> datetime:
    """A time, day, month, year or an age before now; an end bound is exclusive: the next period's start."""
    t = text.strip()
    if _AGE.match(t.lower()):
        return now - parse_age(t)
    for form, step in (("%Y-%m-%d", "day"), ("%Y-%m", "month"), ("%Y", "year")):
        try:
            d = datetime.strptime(t, form).replace(tzinfo=timezone.utc)
        except ValueError:
            continue
        if not end:
            return d
        if step == "day":
            return d + timedelta(days=1)
        return d.replace(year=d.year + (step == "year" or d.month == 12), month=1 if step == "year" or d.month == 12 else d.month + 1)
    return datetime.fromisoformat(t.replace("Z", "+00:00"))
