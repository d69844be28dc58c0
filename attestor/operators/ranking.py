"""Ranking operators: first or best per key, caps, budgets, shares, groups by gap, samples."""

from __future__ import annotations

from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def best_per(df: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """The first row per key in ``order`` (DISTINCT ON).

    A rank of 1 is cut before the shuffle, so a hot key costs one row a task.
    Ties: any one row; give a total order for a defined one.  Null keys are a
    key of their own.
    """
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_rank", F.row_number().over(w)).where(F.col("_rank") == 1).drop("_rank")


def cap_per(df: DataFrame, keys: Sequence[str], order: Sequence[Column], most: int, rank: str | None = None) -> DataFrame:
    """At most ``most`` rows per key, with their rank in a column if named."""
    w = Window.partitionBy(*keys).orderBy(*order)
    out = df.withColumn(rank or "_rank", F.row_number().over(w)).where(F.col(rank or "_rank") <= most)
    return out if rank else out.drop("_rank")


def top(df: DataFrame, order: Sequence[Column], k: int, rank: str = "rank") -> DataFrame:
    """The first ``k`` rows overall with their 1-based rank: a small partition after the cut."""
    return df.orderBy(*order).limit(k).withColumn(rank, F.row_number().over(Window.orderBy(*order)))


def within_budget(df: DataFrame, keys: Sequence[str], order: Sequence[Column], size: Column, budget: int, salts: int = 64) -> DataFrame:
    """Rows in order until the budget per key is used; ``granted`` is each one's share.

    The crossing row gets what is left; rows behind it are not returned.  Null
    sizes count as 0.  A key's rows are first cut within ``salts`` parts of it:
    a row behind ``budget`` of its own part is behind it of the whole, and all
    rows before a granted one stay, so a hot key reaches one task only with
    what may be granted.
    """
    sized = df.withColumn("_size", F.coalesce(size, F.lit(0)).cast("long"))

    def used(*parts: str | Column) -> Column:
        return F.coalesce(F.sum("_size").over(Window.partitionBy(*parts).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))

    sized = sized.withColumn("_salt", F.pmod(F.xxhash64(*order_names(order, df)), F.lit(salts)))
    cut = sized.withColumn("_used", used(*keys, "_salt")).where(F.col("_used") < budget).drop("_used", "_salt")
    out = cut.withColumn("used_before", used(*keys)).where(F.col("used_before") < budget)
    return out.withColumn("granted", F.least(F.col("_size"), F.lit(budget) - F.col("used_before"))).drop("_size")


def order_names(order: Sequence[Column], df: DataFrame) -> list[str]:
    """Columns that tell rows of an order apart, for salting: all of a row's plain ones."""
    return [f.name for f in df.schema.fields if f.dataType.typeName() not in ("map", "variant")] or df.columns


def fair_shares(df: DataFrame, keys: Sequence[str], need: str, total: int) -> DataFrame:
    """Split ``total`` per key: smaller needs in full, the rest evenly, whole numbers.

    Water-filling: in ascending order of need a row is met in full as long as
    its need is at most an even part of what is left; all others share the
    rest, later ones getting one more where it does not divide (in order of
    need, then of the other columns' MD5).  Null needs count as 0.  The water
    level comes from counts per key and need, and rows are ranked within small
    parts of equal need, so no key meets in one task.
    """
    n = F.coalesce(F.col(need), F.lit(0)).cast("long")
    tie = F.md5(F.concat_ws("\0", *[F.coalesce(F.col(c).cast("string"), F.lit("\1")) for c in df.columns if c != need]))
    rows = df.select("*", F.to_json(F.struct(*keys)).alias("_g"), n.alias("_need"), tie.alias("_tie"), F.substring(tie, 1, 2).alias("_part"))  # a null key is a key
    parts = rows.groupBy("_g", "_need", "_part").agg(F.count("*").alias("_rows"))
    w = Window.partitionBy("_g").orderBy("_need").rowsBetween(Window.unboundedPreceding, -1)
    before = lambda c: F.coalesce(F.sum(c).over(w), F.lit(0))
    levels = parts.groupBy("_g", "_need").agg(F.sum("_rows").alias("_rows"))
    levels = levels.select("_g", "_need", before(F.col("_rows")).alias("_m"), before(F.col("_rows") * F.col("_need")).alias("_b"), F.sum("_rows").over(Window.partitionBy("_g")).alias("_n"))
    # the first need that is not met in full stops the filling
    short = F.col("_need") * (F.col("_n") - F.col("_m")) > F.lit(total) - F.col("_b")
    stop = levels.where(short).groupBy("_g").agg(F.min(F.struct("_need", "_m", "_b", "_n")).alias("x"))
    stop = stop.select("_g", F.col("x._need").alias("_from"), F.col("x._m").alias("_met"), (F.col("x._n") - F.col("x._m")).alias("_sharers"), (F.lit(total) - F.col("x._b")).alias("_left"))
    w = Window.partitionBy("_g").orderBy("_need", "_part").rowsBetween(Window.unboundedPreceding, -1)
    ahead = parts.select("_g", "_need", "_part", before(F.col("_rows")).alias("_ahead"))
    ranked = rows.withColumn("_k", F.row_number().over(Window.partitionBy("_g", "_need", "_part").orderBy("_tie")) - 1)
    out = ranked.join(ahead, ["_g", "_need", "_part"]).join(stop, "_g", "left")
    # sharing what is left among the sharers with integer division one after another
    shared = F.floor((F.col("_left") + F.col("_ahead") - F.col("_met") + F.col("_k")) / F.col("_sharers")).cast("long")
    return out.select(*df.columns, F.when(F.col("_need") >= F.col("_from"), shared).otherwise(F.col("_need")).alias("share"))


def previous_row(df: DataFrame, keys: Sequence[str], order: Sequence[str], values: Sequence[str], part: Column) -> DataFrame:
    """``df`` with ``prev_<value>`` of the row before (null for a key's first row, where ``is_first`` is true) and ``_part``.

    ``part`` cuts a key's rows into pieces in their order (as the day of a
    time); rows are put in order within a piece, and only the pieces' last rows
    are put in order over the whole key, so a hot key is spread.
    """
    rows = df.withColumn("_part", part)
    own = Window.partitionBy(*keys, "_part").orderBy(*order)
    for v in values:
        rows = rows.withColumn(f"prev_{v}", F.lag(v).over(own))
    rows = rows.withColumn("_first", F.row_number().over(own) == 1)
    last = rows.groupBy(*keys, "_part").agg(F.max_by(F.struct(*values), F.struct(*order)).alias("_last"))
    last = last.select(*keys, "_part", F.lag("_last").over(Window.partitionBy(*keys).orderBy("_part")).alias("_last"))
    out = rows.join(last, [*keys, "_part"])
    for v in values:
        out = out.withColumn(f"prev_{v}", F.when(F.col("_first"), F.col(f"_last.{v}")).otherwise(F.col(f"prev_{v}")))
    return out.withColumn("is_first", F.col("_first") & F.col("_last").isNull()).drop("_first", "_last")


def groups_by_gap(df: DataFrame, keys: Sequence[str], order: Sequence[str], new: Column, values: Sequence[str], part: Column, name: str = "group_ord") -> DataFrame:
    """Number groups of rows in order; ``new`` says where one begins (it may use ``prev_<value>``).

    A key's first row begins one; see ``previous_row`` for ``part``.
    """
    rows = previous_row(df, keys, order, values, part).withColumn("_new", (F.col("is_first") | F.coalesce(new, F.lit(True))).cast("long"))
    own = Window.partitionBy(*keys, "_part").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    begun = rows.groupBy(*keys, "_part").agg(F.sum("_new").alias("_n"))
    begun = begun.withColumn("_before", F.coalesce(F.sum("_n").over(Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("_n")
    out = rows.withColumn(name, F.sum("_new").over(own)).join(begun, [*keys, "_part"]).withColumn(name, F.col(name) + F.col("_before"))
    return out.select(*df.columns, name)


def transitions(df: DataFrame, keys: Sequence[str], order: Sequence[str], state: str, part: Column) -> DataFrame:
    """Rows whose state differs from the one before (the first row of a key counts), with ``previous``."""
    rows = previous_row(df, keys, order, [state], part)
    return rows.where(F.col("is_first") | ~F.col(f"prev_{state}").eqNullSafe(F.col(state))).select(*df.columns, F.col(f"prev_{state}").alias("previous"))


def stratified_sample(df: DataFrame, arm: str, stratum: str, key: str, n: int, seed: int) -> DataFrame:
    """``n`` rows per arm, taken round-robin over its strata in seeded random order."""
    mix = F.md5(F.concat_ws(" ", F.col(key).cast("string"), F.lit(str(seed))))
    one = df.withColumn("_round", F.row_number().over(Window.partitionBy(arm, stratum).orderBy(mix, key)))
    one = one.where(F.col("_round") <= n)
    return cap_per(one, [arm], [F.col("_round"), F.col(stratum)], n, "pick").drop("_round")


def blind_ids(df: DataFrame, key: str, seed: int) -> DataFrame:
    """Rows of a (small) review sample in seeded order, named C01, C02, ..."""
    w = Window.orderBy(F.xxhash64(F.col(key), F.lit(seed)), key)
    return df.withColumn("review_id", F.format_string("C%02d", F.row_number().over(w)))


def cron_next(expression: str, after: pd.Timestamp) -> pd.Timestamp | None:
    """The next minute a five-field cron expression names; null for a bad one."""
    fields = expression.split() if isinstance(expression, str) else []
    if len(fields) != 5:
        return None
    sets = []
    for f, (lo, hi) in zip(fields, ((0, 59), (0, 23), (1, 31), (1, 12), (0, 7))):
        out: set[int] = set()
        for part in f.split(","):
            span, _, step = part.partition("/")
            a, _, b = span.partition("-")
            try:
                first, last = (lo, hi) if a == "*" else (int(a), int(b or (hi if step else a)))
                out |= set(range(first, last + 1, int(step or 1)))
            except ValueError:
                return None
        if not out or min(out) < lo or max(out) > hi:
            return None
        sets.append(out)
    days = {d % 7 for d in sets[4]}
    t = after.floor("min") + pd.Timedelta(minutes=1)
    end = after + pd.Timedelta(days=366 * 5)
    while t < end:
        dom, dow = t.day in sets[2], (t.dayofweek + 1) % 7 in days
        fits = (dom or dow) if fields[2] != "*" and fields[4] != "*" else (dom and dow)
        if t.month not in sets[3] or not fits:
            t = t.normalize() + pd.Timedelta(days=1)
        elif t.hour not in sets[1]:
            t = t.floor("h") + pd.Timedelta(hours=1)
        elif t.minute not in sets[0]:
            t += pd.Timedelta(minutes=1)
        else:
            return t
    return None


def cron_due(cron: str, since: str, now: pd.Timestamp) -> Column:
    """Whether a schedule's next time after ``since`` is before ``now``."""

    @F.pandas_udf("boolean")
    def due(c: pd.Series, s: pd.Series) -> pd.Series:
        nexts = [cron_next(e, t) if isinstance(e, str) and not pd.isna(t) else None for e, t in zip(c, s)]
        return pd.Series([n is not None and n < now for n in nexts])

    return due(F.col(cron), F.col(since))
