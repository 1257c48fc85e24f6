"""Normal forms of the event log's columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowloom.functions.instants import trimmed
from flowloom.operators.timestamps import with_instant


def case_key(c: Column) -> Column:
    return F.lower(trimmed(c))


def activity_key(c: Column) -> Column:
    """Lower-case letters and digits of an activity; null where nothing is left."""
    return F.nullif(F.regexp_replace(F.lower(c), r"[^\p{L}\p{Nd}]", ""), F.lit(""))


def type_key(c: Column) -> Column:
    return F.lower(trimmed(c))


def usable_rows(log: DataFrame, sites: DataFrame, kind: str | None = None) -> DataFrame:
    """(case_key, activity_key, instant_us) of the rows that have all three, of one type or of all."""
    rows = log.select("case_id", "activity", "timestamp", "type", "site")
    if kind is not None:
        rows = rows.filter(type_key(F.col("type")) == kind)
    rows = rows.select(case_key(F.col("case_id")).alias("case_key"), activity_key(F.col("activity")).alias("activity_key"), "timestamp", "site")
    rows = rows.filter("case_key is not null and activity_key is not null")
    return with_instant(rows, sites).select("case_key", "activity_key", "instant_us").filter("instant_us is not null")
