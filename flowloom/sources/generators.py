"""Seeded generators of test inputs of any size, as DataFrames: every row is a function of its number and the seed."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def _pick(seed: int, salt: int, n: int, *by: Column) -> Column:
    return F.pmod(F.xxhash64(*by, F.lit(seed), F.lit(salt)), F.lit(n))


def chained_journeys(spark: SparkSession, journeys: int, length: int, base_key: bool = True) -> DataFrame:
    """(event_id, correlation_keys, truth): chains in which an event has its own and the previous key, with or
    without a key that all events of the journey share."""
    e = spark.range(journeys * length).select((F.col("id") / length).cast("bigint").alias("j"), (F.col("id") % length).alias("i"))
    key = lambda i: F.concat(F.lit("k:"), F.col("j").cast("string"), F.lit(":"), i.cast("string"))
    keys = F.array(key(F.col("i")), F.when(F.col("i") > 0, key(F.col("i") - 1)), *([F.concat(F.lit("base:"), F.col("j").cast("string"))] if base_key else []))
    return e.select(F.concat_ws("-", F.lpad(F.col("j").cast("string"), 9, "0"), F.lpad(F.col("i").cast("string"), 6, "0")).alias("event_id"), F.filter(keys, lambda k: k.isNotNull()).alias("correlation_keys"), F.col("j").alias("truth"))


def bridged_journeys(spark: SparkSession, journeys: int) -> DataFrame:
    """Three events a journey: web has a mail key, mobile a phone key, back end both; phase 2 holds the bridges."""
    j = spark.range(journeys).withColumn("app", F.explode(F.array(*[F.lit(a) for a in ("web", "mobile", "backend")])))
    mail, phone = F.concat(F.lit("mail:"), F.col("id").cast("string")), F.concat(F.lit("phone:"), F.col("id").cast("string"))
    keys = F.when(F.col("app") == "web", F.array(mail)).when(F.col("app") == "mobile", F.array(phone)).otherwise(F.array(mail, phone))
    return j.select(F.concat_ws("-", F.lpad(F.col("id").cast("string"), 9, "0"), "app").alias("event_id"), "app", keys.alias("correlation_keys"), F.when(F.col("app") == "backend", 2).otherwise(1).alias("phase"), F.col("id").alias("truth"))


def process_log(spark: SparkSession, cases: int, seed: int = 42) -> DataFrame:
    """(case_id, activity, event_id, us, type): a start, two parallel steps in either order, up to three
    rounds of a cycle, an async pair, an error in about a tenth of the cases, and an end."""
    c = spark.range(cases).withColumn("flip", _pick(seed, 1, 2, F.col("id")) == 0).withColumn("rounds", _pick(seed, 2, 4, F.col("id"))).withColumn("error", _pick(seed, 3, 10, F.col("id")) == 0)
    step = lambda a, t: F.struct(F.lit(a).alias("activity"), F.lit(t).alias("type"))
    pair = F.when(F.col("flip"), F.array(step("Review", "parallel"), step("Check", "parallel"))).otherwise(F.array(step("Check", "parallel"), step("Review", "parallel")))
    cycle = F.slice(F.array_repeat(step("Rework", "cyclic"), 4), F.lit(1), F.col("rounds").cast("int"))
    bad = F.when(F.col("error"), F.array(step("Failure", "error"))).otherwise(F.slice(F.array(step("Failure", "error")), 1, 0))
    steps = F.concat(F.array(step("Open", "start"), step("Scan_Start", "async")), pair, cycle, F.array(step("Scan_End", "async")), bad, F.array(step("Close", "end")))
    rows = c.select("id", F.posexplode(steps).alias("n", "s"))
    us = F.lit(1_700_000_000_000_000) + F.col("id") * 60_000_000 + F.col("n") * 1_000_000 + _pick(seed, 4, 900_000, F.col("id"), F.col("n"))
    return rows.select(F.concat(F.lit("case_"), F.lpad(F.col("id").cast("string"), 9, "0")).alias("case_id"), "s.activity", (F.col("id") * 64 + F.col("n")).alias("event_id"), us.alias("us"), "s.type")


def hierarchical_log(spark: SparkSession, cases: int, seed: int = 42) -> DataFrame:
    """(case_id, us, level_1, level_2, level_3): three activities, each with sub-steps, null above an event's depth."""
    e = spark.range(cases * 9).select((F.col("id") / 9).cast("bigint").alias("c"), (F.col("id") % 9).alias("i"))
    one, two = F.concat(F.lit("L1_"), (F.col("i") / 3).cast("int").cast("string")), F.concat(F.lit("L2_"), (F.col("i") % 3).cast("string"))
    deep = F.when(_pick(seed, 5, 2, F.col("c"), F.col("i")) == 0, F.concat(F.lit("L3_"), F.col("i").cast("string")))
    return e.select(F.col("c").cast("string").alias("case_id"), (F.col("c") * 1000 + F.col("i")).alias("us"), one.alias("level_1"), F.when(F.col("i") % 3 > 0, two).alias("level_2"), F.when(F.col("i") % 3 > 0, deep).alias("level_3"))


def cases_with_outliers(spark: SparkSession, cases: int, every: int = 50, seed: int = 42) -> DataFrame:
    """(id, market, time_taken, frequency, is_outlier): roughly normal attributes, each ``every``-th case inflated."""
    u = sum((_pick(seed, 10 + i, 1_000_000, F.col("id")) / 1_000_000 for i in range(12)), F.lit(-6.0))
    v = sum((_pick(seed, 30 + i, 1_000_000, F.col("id")) / 1_000_000 for i in range(12)), F.lit(-6.0))
    bad = F.col("id") % every == 0
    return spark.range(cases).select("id", F.concat(F.lit("m"), _pick(seed, 9, 4, F.col("id")).cast("string")).alias("market"), (100 + 10 * u + F.when(bad, 150).otherwise(0)).alias("time_taken"), (20 + 3 * v + F.when(bad, 60).otherwise(0)).alias("frequency"), bad.alias("is_outlier"))


def app_chains(spark: SparkSession, journeys: int, apps: int) -> DataFrame:
    """(event_id, app, correlation_keys, truth): one journey through all applications, each event with one key of
    its own and the one that it hands on."""
    e = spark.range(journeys * apps).select((F.col("id") / apps).cast("bigint").alias("j"), (F.col("id") % apps).alias("i"))
    name = lambda i: F.concat_ws(":", F.lit("hop"), F.col("j").cast("string"), i.cast("string"))
    keys = F.array_compact(F.array(name(F.col("i")), F.when(F.col("i") + 1 < apps, name(F.col("i") + 1))))
    return e.select(F.concat_ws("-", F.lpad(F.col("j").cast("string"), 9, "0"), F.lpad(F.col("i").cast("string"), 3, "0")).alias("event_id"), F.concat(F.lit("app_"), F.col("i").cast("string")).alias("app"), keys.alias("correlation_keys"), F.col("j").alias("truth"))


def filled(df: DataFrame, template: str, values: dict[str, Column], out: str = "text") -> DataFrame:
    """Adds a template's text with its {names} replaced by columns, also inside values that are templates themselves."""
    text = F.lit(template)
    for _ in range(2):
        for name, value in values.items():
            text = F.replace(text, F.lit("{" + name + "}"), F.coalesce(value, F.lit("")))
    return df.withColumn(out, text)
