"""Event logs: normalising, filtering, hierarchy and case-level selection.

A log has case_id, activity, event_id and us (microseconds); within a case events are ordered by (us, event_id).
All functions take and return DataFrames, keep null cases out of grouping by letting Spark group nulls together, and
give an empty result for an empty log. What needs the order of a case's events treats a case of more than HOT_EVENTS
in pieces of time, so that no task holds such a case, and carries over from piece to piece what the next one needs.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from flowloom.session import cut, small

ORDER = ("us", "event_id")
#: Events from which on a case is treated in pieces of about as many.
HOT_EVENTS = 20_000


def in_pieces(log: DataFrame, key: str = "case_id") -> tuple[DataFrame, bool]:
    """The log with ``__piece``, and whether any case is in pieces: 0 for ordinary cases, for hot ones the number of an
    equal stretch of the case's time, there being one for each HOT_EVENTS events; events without a time come first.

    Events of one instant of a case share a piece. Hot cases number at most a HOT_EVENTS-th of the events and are
    broadcast if they are few.
    """
    counts = log.groupBy(F.col(key).alias("__key")).agg(F.count(F.lit(1)).alias("n"), F.min("us").alias("__from"), F.max("us").alias("to"))
    hot = cut(counts.filter(F.col("n") > HOT_EVENTS).select("__key", "__from", F.expr(f"(to - __from) div (n div {HOT_EVENTS} + 1) + 1").alias("__width")))
    if hot.isEmpty():
        return log.withColumn("__piece", F.lit(0).cast("long")), False
    placed = log.join(small(hot), F.col(key).eqNullSafe(F.col("__key")), "left")
    piece = F.when(F.col("__width").isNull(), F.lit(0)).otherwise(F.coalesce(F.expr("(us - __from) div __width"), F.lit(-1)))
    return placed.withColumn("__piece", piece).drop("__key", "__from", "__width"), True


def _carried(log: DataFrame, key: str, each: dict[str, Column], over: dict[str, Column]) -> DataFrame:
    """``log`` in pieces, joined by what comes from the other pieces of its case: ``each`` sums up a piece, ``over``
    are windows on those sums, of which there is one row for each piece."""
    pieces = log.groupBy(key, "__piece").agg(*[c.alias(n) for n, c in each.items()])
    sums = pieces.select(F.col(key).alias("__k"), F.col("__piece").alias("__i"), *[c.alias(n) for n, c in over.items()])
    return log.join(sums, F.col(key).eqNullSafe(F.col("__k")) & (F.col("__piece") == F.col("__i")), "left").drop("__k", "__i")


def canonical(df: DataFrame, mapping: dict[str, str], required: Sequence[str] = ("case_id", "activity", "us")) -> DataFrame:
    """Rename source columns to the canonical names; a missing required field is an error, extras are kept."""
    missing = [k for k in required if k not in mapping]
    if missing:
        raise ValueError(f"unmapped required fields: {missing}")
    return df.withColumnsRenamed({v: k for k, v in mapping.items()})


def rename_attribute(df: DataFrame, old: str, new: str) -> DataFrame:
    """Per event the old attribute fills the new one where that is null; the old column goes."""
    value = F.coalesce(F.col(new), F.col(old)) if new in df.columns else F.col(old)
    return df.withColumn(new, value).drop(*([old] if old != new else []))


def stitching_key(df: DataFrame, key: str | None) -> DataFrame:
    """P10: the stitching key, by default the case."""
    return df.withColumn("stitching_key", F.coalesce(F.col(key), F.col("case_id")) if key else F.col("case_id"))


def at_level(df: DataFrame, level: int) -> DataFrame:
    """The log whose activities are those of one hierarchy level; other levels than 1, 2 and 3 are an error."""
    if level not in (1, 2, 3):
        raise ValueError(f"no level {level}")
    return df.withColumn("activity", F.col(f"level_{level}")).filter("activity is not null")


def case_events(df: DataFrame, case: str, events: str) -> DataFrame:
    """P5: one row for each non-null element of a case's array of event structs, with the case."""
    return df.select(F.col(case), F.explode(events).alias("__e")).filter("__e is not null").select(case, "__e.*")


def leveled(df: DataFrame, children: str) -> DataFrame:
    """(.., level_1, level_2, level_3): a row for each record, child and grandchild, with the activities above it.

    Records keep their other columns, which their descendants inherit; null elements give no row. The rows of a record
    leave its task one by one.
    """
    def row(a, b, c):
        return F.struct(a.cast("string").alias("level_1"), b.cast("string").alias("level_2"), c.cast("string").alias("level_3"))

    top, none = F.col("activity"), F.lit(None)

    def below(x):
        own = F.array(row(top, x["activity"], none))
        deeper = F.transform(F.filter(F.coalesce(x[children], F.array()), lambda y: y.isNotNull()), lambda y: row(top, x["activity"], y["activity"]))
        return F.concat(own, deeper)

    rest = F.flatten(F.transform(F.filter(F.coalesce(children, F.array()), lambda x: x.isNotNull()), below))
    every = F.concat(F.array(row(top, none, none)), rest)
    return df.withColumn("__l", F.explode(every)).select(*[c for c in df.columns if c != children], "__l.*")


def top_level(df: DataFrame) -> DataFrame:
    """L2: the rows that no finer level has a value for."""
    return df.filter("level_2 is null and level_3 is null")


def with_attribute(df: DataFrame, column: str, values: Sequence[str]) -> DataFrame:
    """The events whose attribute is one of some values."""
    return df.filter(F.col(column).isin(*values))


def drill_down(df: DataFrame, coarse: str, activity: str, fine: str) -> DataFrame:
    """The rows that have the fine level, of the cases that hold a coarse activity."""
    cases = df.filter(F.col(coarse) == activity).select("case_id").distinct()
    return df.filter(F.col(fine).isNotNull()).join(cases, "case_id", "left_semi")


def abstracted(log: DataFrame, mapping: DataFrame) -> DataFrame:
    """Child labels become their parent's; unmapped ones stay. mapping: child (unique), parent."""
    named = mapping.select(F.col("child").alias("__child"), F.col("parent").alias("__parent"))
    return log.join(named, log["activity"] == F.col("__child"), "left").withColumn("activity", F.coalesce("__parent", "activity")).drop("__child", "__parent")


def unassigned(log: DataFrame, mapping: DataFrame) -> DataFrame:
    """Activities to which no label is assigned."""
    return log.select("activity").distinct().join(mapping.select(F.col("child").alias("activity")), "activity", "left_anti")


def without_activities(log: DataFrame, ignored: Sequence[str]) -> DataFrame:
    """L4: drop the events of some activities; null activities stay."""
    return log.filter(F.col("activity").isNull() | ~F.col("activity").isin(*ignored))


def ends(log: DataFrame) -> DataFrame:
    """Per case its first and last activity, in event order."""
    key = F.struct(*ORDER)
    return log.groupBy("case_id").agg(F.min_by("activity", key).alias("first_activity"), F.max_by("activity", key).alias("last_activity"))


def cases_by_ends(log: DataFrame, starts: Sequence[str] | None = None, finishes: Sequence[str] | None = None) -> DataFrame:
    """The events of cases that start and end with given activities; either side may be left out."""
    keep = ends(log)
    if starts is not None:
        keep = keep.filter(F.col("first_activity").isin(*starts))
    if finishes is not None:
        keep = keep.filter(F.col("last_activity").isin(*finishes))
    return log.join(keep.select("case_id"), "case_id", "left_semi")


def cases_eventually(log: DataFrame, a: str, b: str) -> DataFrame:
    """The events of cases in which some b comes after some a."""
    at = F.struct(*ORDER)
    pair = log.groupBy("case_id").agg(F.min(F.when(F.col("activity") == a, at)).alias("x"), F.max(F.when(F.col("activity") == b, at)).alias("y"))
    return log.join(pair.filter("x < y").select("case_id"), "case_id", "left_semi")


def _beside(log: DataFrame, key: str, columns: Sequence[str], step: int) -> DataFrame:
    """Adds ``__beside``: a struct of the columns of the next (step 1) or the previous (step -1) event, null at the end."""
    order, own = F.struct(*ORDER), F.struct(*columns)
    pieces, several = in_pieces(log, key)
    w = Window.partitionBy(key, "__piece").orderBy(*ORDER)
    side = F.lead(own).over(w) if step > 0 else F.lag(own).over(w)
    if several:
        edge = F.min_by(own, order) if step > 0 else F.max_by(own, order)
        across = Window.partitionBy(key).orderBy("__piece")
        pieces = _carried(pieces, key, {"__edge": edge}, {"__other": F.lead("__edge").over(across) if step > 0 else F.lag("__edge").over(across)})
        side = F.coalesce(side, F.col("__other"))
    return pieces.withColumn("__beside", side).drop("__other", "__piece")


def with_next(log: DataFrame) -> DataFrame:
    """Every event with the activity and time of the next one in its case."""
    out = _beside(log, "case_id", ("activity", "us"), 1)
    return out.withColumns({"next_activity": F.col("__beside.activity"), "next_us": F.col("__beside.us")}).drop("__beside")


def cases_directly(log: DataFrame, a: str, b: str) -> DataFrame:
    """The events of cases in which b directly follows a."""
    hit = with_next(log).filter((F.col("activity") == a) & (F.col("next_activity") == b)).select("case_id").distinct()
    return log.join(hit, "case_id", "left_semi")


def completed_cases(log: DataFrame, starts: Sequence[str], finishes: Sequence[str]) -> DataFrame:
    """Cases that hold a start activity and an end activity anywhere, in any order."""
    return log.groupBy("case_id").agg(F.bool_or(F.col("activity").isin(*starts)).alias("s"), F.bool_or(F.col("activity").isin(*finishes)).alias("e")).filter("s and e").select("case_id")


def matching(df: DataFrame, criteria: dict[str, object]) -> DataFrame:
    """Equality on every given column; the value 'all' matches anything."""
    tests = [F.col(c) == F.lit(v) for c, v in criteria.items() if v != "all"]
    return df.filter(reduce(Column.__and__, tests)) if tests else df


def variant_rules(groups: Sequence[Sequence[tuple[str, str]]], activities: Column) -> Column:
    """OR of AND-groups of (rule, text) over an activity array, by lower-case substrings.

    Rules: contains, starts_with, ends_with, directly_follows ('a -> b'). An empty array matches nothing.
    """

    def has(x: Column, text: str) -> Column:
        return F.contains(F.lower(x), F.lit(text.strip().lower()))

    def test(rule: str, text: str) -> Column:
        if rule == "contains":
            return F.exists(activities, lambda x: has(x, text))
        if rule in ("starts_with", "ends_with"):
            return F.coalesce(has(F.try_element_at(activities, F.lit(1 if rule == "starts_with" else -1)), text), F.lit(False))
        if rule == "directly_follows":
            a, b = text.split("->")
            pairs = F.arrays_zip(activities.alias("x"), F.slice(activities, 2, 1 << 30).alias("y"))
            return F.exists(pairs, lambda p: F.coalesce(has(p["x"], a) & has(p["y"], b), F.lit(False)))
        raise ValueError(f"no rule {rule}")

    return reduce(Column.__or__, [reduce(Column.__and__, [test(r, t) for r, t in g]) for g in groups])


def paired_intervals(log: DataFrame) -> DataFrame:
    """Start and complete events of a case and activity, paired by their number; a missing start is the complete
    time. log: case_id, activity, us, event_id, lifecycle. Starts without a complete are left out."""
    n = F.row_number().over(Window.partitionBy("case_id", "activity", "lifecycle").orderBy(*ORDER))
    one = log.withColumn("n", n)
    done = one.filter("lifecycle = 'complete'").select("case_id", "activity", "n", F.col("us").alias("end_us"))
    began = one.filter("lifecycle = 'start'").select("case_id", "activity", "n", F.col("us").alias("start_us"))
    return done.join(began, ["case_id", "activity", "n"], "left").withColumn("start_us", F.coalesce("start_us", "end_us"))


def duration_stats(log: DataFrame) -> DataFrame:
    """A3, A4: per case the number of events and the microseconds from first to last event (0 for one event)."""
    return log.groupBy("case_id").agg(F.count(F.lit(1)).alias("n_events"), (F.max("us") - F.min("us")).alias("duration_us"))


def running_milestones(log: DataFrame, activity: str) -> DataFrame:
    """Per event the first and last time (-1 if none) and the count of one activity up to and including it."""
    hit = F.when(F.col("activity") == activity, F.col("us"))
    pieces, several = in_pieces(log)
    w = Window.partitionBy("case_id", "__piece").orderBy(*ORDER).rowsBetween(Window.unboundedPreceding, 0)
    first, last, seen = F.min(hit).over(w), F.max(hit).over(w), F.count(hit).over(w)
    if several:
        before = Window.partitionBy("case_id").orderBy("__piece").rowsBetween(Window.unboundedPreceding, -1)
        sums = {"__f": F.min(hit), "__l": F.max(hit), "__n": F.count(hit)}
        pieces = _carried(pieces, "case_id", sums, {"__first": F.min("__f").over(before), "__last": F.max("__l").over(before), "__seen": F.sum("__n").over(before)})
        first, last, seen = F.least(first, "__first"), F.greatest(last, "__last"), seen + F.coalesce("__seen", F.lit(0))
    return pieces.select("case_id", "event_id", F.coalesce(first, F.lit(-1)).alias("first_us"), F.coalesce(last, F.lit(-1)).alias("last_us"), seen.alias("n_seen"))


def last_k(log: DataFrame, k: int) -> DataFrame:
    """Per event the last k activities of its case, itself included, joined by '>'; null activities are left out."""
    pieces, several = in_pieces(log)
    w = Window.partitionBy("case_id", "__piece").orderBy(*ORDER)
    named = F.struct("activity")
    own = F.collect_list(named).over(w.rowsBetween(-k + 1, 0))
    if several:
        tail = F.slice(F.reverse(F.array_sort(F.collect_list(F.struct(*ORDER, "activity")))), 1, k)
        tail = F.transform(F.reverse(tail), lambda x: F.struct(x["activity"]))
        # every piece has an event, so the k - 1 pieces before hold the k - 1 events before
        earlier = Window.partitionBy("case_id").orderBy("__piece").rowsBetween(-k + 1, -1)
        pieces = _carried(pieces, "case_id", {"__tail": tail}, {"__earlier": F.flatten(F.collect_list("__tail").over(earlier))})
        every = F.concat(F.coalesce("__earlier", F.array().cast("array<struct<activity:string>>")), own)
        own = F.when(F.size(own) < k, F.slice(every, F.greatest(F.lit(1), F.size(every) - k + 1), F.lit(k))).otherwise(own)
    return pieces.select("case_id", "event_id", F.array_join(F.transform(own, lambda x: x["activity"]), ">").alias("last_k"))


def count_before(log: DataFrame, activity: str) -> DataFrame:
    """Adds ``n_before``: how often an activity comes before the event in its case, in event order."""
    hit = F.when(F.col("activity") == activity, 1).otherwise(0)
    pieces, several = in_pieces(log)
    w = Window.partitionBy("case_id", "__piece").orderBy(*ORDER).rowsBetween(Window.unboundedPreceding, -1)
    n = F.coalesce(F.sum(hit).over(w), F.lit(0))
    if several:
        before = Window.partitionBy("case_id").orderBy("__piece").rowsBetween(Window.unboundedPreceding, -1)
        pieces = _carried(pieces, "case_id", {"__n": F.sum(hit)}, {"__earlier": F.sum("__n").over(before)})
        n = n + F.coalesce("__earlier", F.lit(0))
    return pieces.withColumn("n_before", n).drop("__earlier", "__piece")


def sessions(log: DataFrame, entity: str, gap_us: int) -> DataFrame:
    """Sessions of an entity: a new one starts after a gap of more than gap_us."""
    fresh = F.when(F.col("us") - F.col("__beside.us") <= gap_us, 0).otherwise(1)
    marked = _beside(log, entity, ("us",), -1).withColumn("__fresh", fresh).drop("__beside")
    pieces, several = in_pieces(marked, entity)
    n = F.sum("__fresh").over(Window.partitionBy(entity, "__piece").orderBy(*ORDER).rowsBetween(Window.unboundedPreceding, 0))
    if several:
        before = Window.partitionBy(entity).orderBy("__piece").rowsBetween(Window.unboundedPreceding, -1)
        pieces = _carried(pieces, entity, {"__n": F.sum("__fresh")}, {"__earlier": F.sum("__n").over(before)})
        n = n + F.coalesce("__earlier", F.lit(0))
    return pieces.withColumn("session_no", n).drop("__fresh", "__earlier", "__piece")


def hierarchy_counts(df: DataFrame, levels: Sequence[str]) -> DataFrame:
    """Rollup over the levels: counts for every prefix of them; null marks the rolled-up ones."""
    return df.rollup(*levels).agg(F.count(F.lit(1)).alias("n"))


def trend(log: DataFrame, width: str = "week") -> DataFrame:
    """Events and cases by calendar period."""
    return log.groupBy(F.date_trunc(width, F.timestamp_micros("us")).cast("date").cast("string").alias("period")).agg(F.count(F.lit(1)).alias("n_events"), F.count_distinct("case_id").alias("n_cases"))


def recent(log: DataFrame, days: int) -> DataFrame:
    """The events of the last days before the newest one."""
    newest = log.agg(F.max("us").alias("__newest"))
    return log.crossJoin(F.broadcast(newest)).filter(F.col("us") > F.col("__newest") - F.lit(days) * 86_400_000_000).drop("__newest")
