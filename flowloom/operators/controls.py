"""Controls over cases: ordered-time limits, forbidden and required orders, counts, gaps and segregation of duties.

Each control is one aggregation by case or one window over its events, and reports the violating cases.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowloom.operators.logs import count_before, with_next


def _at(activity: str):
    return F.when(F.col("activity") == activity, F.col("us"))


def first_to_last(log: DataFrame, a: str, b: str, limit_us: int) -> DataFrame:
    """(case_id, elapsed_us) where the last b comes more than limit_us after the first a."""
    return log.groupBy("case_id").agg((F.max(_at(b)) - F.min(_at(a))).alias("elapsed_us")).filter(F.col("elapsed_us") > limit_us)


def forbidden_after(log: DataFrame, a: str, b: str) -> DataFrame:
    """Cases in which some b comes strictly after some a."""
    return log.groupBy("case_id").agg(F.min(_at(a)).alias("x"), F.max(_at(b)).alias("y")).filter("x < y").select("case_id")


def too_few_before(log: DataFrame, a: str, n: int, b: str) -> DataFrame:
    """(case_id, n_before) of cases whose first b has fewer than n events a before it, in event order."""
    first = count_before(log, a).filter(F.col("activity") == b).groupBy("case_id").agg(F.min("n_before").alias("n_before"))
    return first.filter(F.col("n_before") < n)


def gaps_over(log: DataFrame, limit_us: int) -> DataFrame:
    """(case_id, event_id, gap_us) of events followed by a pause of more than limit_us in their case."""
    return with_next(log).withColumn("gap_us", F.col("next_us") - F.col("us")).filter(F.col("gap_us") > limit_us).select("case_id", "event_id", "gap_us")


def same_actor(log: DataFrame, actor: str, a: str, b: str) -> DataFrame:
    """(case_id, actor) who did both a and b in one case."""
    done = log.filter(F.col(actor).isNotNull()).groupBy("case_id", F.col(actor).alias("actor")).agg(F.bool_or(F.col("activity") == a).alias("x"), F.bool_or(F.col("activity") == b).alias("y"))
    return done.filter("x and y").select("case_id", "actor")


def loops_over(log: DataFrame, n: int) -> DataFrame:
    """(case_id, activity, times) of activities done more than n times in a case."""
    return log.groupBy("case_id", "activity").agg(F.count(F.lit(1)).alias("times")).filter(F.col("times") > n)


def missing_before(log: DataFrame, a: str, b: str) -> DataFrame:
    """Cases in which the first b has no a before it, in event order."""
    at = lambda x: F.min(F.when(F.col("activity") == x, F.struct("us", "event_id")))
    first = log.groupBy("case_id").agg(at(a).alias("x"), at(b).alias("y"))
    return first.filter("y is not null and (x is null or x > y)").select("case_id")


def longer_than(log: DataFrame, limit_us: int) -> DataFrame:
    """(case_id, duration_us) of cases that take longer than a limit."""
    return log.groupBy("case_id").agg((F.max("us") - F.min("us")).alias("duration_us")).filter(F.col("duration_us") > limit_us)


def above_approved(log: DataFrame, amount: str, asked: str, approved: str) -> DataFrame:
    """Cases whose largest amount of one activity exceeds the largest of another."""
    of = lambda a: F.max(F.when(F.col("activity") == a, F.col(amount)))
    return log.groupBy("case_id").agg(of(asked).alias("x"), of(approved).alias("y")).filter("x > y").select("case_id")


def status(log: DataFrame, a: str, b: str, limit_us: int, now_us: int, least_us: int | None = None) -> DataFrame:
    """(case_id, status) of the monitor that b must come within limit_us of the first a.

    satisfied, violated, impossible (b takes at least ``least_us`` more, which is more than is left), at_risk (over four
    fifths of the time gone) or ticking; cases without a have none.
    """
    one = log.groupBy("case_id").agg(F.min(_at(a)).alias("x"), F.min(_at(b)).alias("y")).filter("x is not null")
    gone = F.lit(now_us) - F.col("x")
    value = F.when(F.col("y") - F.col("x") <= limit_us, "satisfied").when(F.col("y").isNotNull() | (gone > limit_us), "violated")
    if least_us is not None:
        value = value.when(gone + least_us > limit_us, "impossible")
    value = value.when(gone * 5 > limit_us * 4, "at_risk").otherwise("ticking")
    return one.select("case_id", value.alias("status"))
