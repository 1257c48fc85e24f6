"""Log views over the driver's tables, as DataFrames and as the same SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from flowloom.session import load


def log_day(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as a log: one case per user and day."""
    e = load(spark, sf_dir, "events")
    return e.select(
        F.concat_ws("|", F.col("user_id").cast("string"), F.date_format("ts", "yyyy-MM-dd")).alias("case_id"),
        F.col("event_type").alias("activity"),
        "event_id",
        F.unix_micros(F.col("ts").cast("timestamp")).alias("us"),
        "user_id",
        "value",
        F.get_json_object("props", "$.k").cast("bigint").alias("k"),
    )


LOG = """log as (select user_id || '|' || strftime(ts, '%Y-%m-%d') as case_id, event_type as activity, event_id, epoch_us(ts) as us,
  user_id, value, cast(regexp_extract(props, '"k": *([0-9]+)', 1) as bigint) as k from events)"""
#: Cases with their variant, duration and ends.
CASES = """cases as (select case_id, string_agg(activity, '->' order by us, event_id) as variant, max(us) - min(us) as d, count(*) as n,
  arg_min(activity, (us, event_id)) as first_activity, arg_max(activity, (us, event_id)) as last_activity from log group by case_id)"""
NEXT = """nx as (select *, lead(activity) over w as next_activity, lead(us) over w as next_us from log window w as (partition by case_id order by us, event_id))"""
