"""Variants: distinct activity sequences, their frequencies, reductions and comparison."""

from __future__ import annotations

from itertools import permutations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowloom.functions import ranks
from flowloom.operators.logs import ORDER, in_pieces

SEP = "->"


def traces(log: DataFrame) -> DataFrame:
    """(case_id, activities, start_us, end_us), activities in event order.

    A hot case is ordered piece by piece and its pieces' activities are joined at the end: only they, not the events,
    come together in the case's row.
    """

    def gathered(df: DataFrame, *keys: str) -> DataFrame:
        one = df.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(*ORDER, "activity"))).alias("e"), F.min("us").alias("start_us"), F.max("us").alias("end_us"))
        return one.select(*keys, F.transform("e", lambda x: x["activity"]).alias("activities"), "start_us", "end_us")

    pieces, several = in_pieces(log)
    if not several:
        return gathered(log, "case_id")
    one = gathered(pieces, "case_id", "__piece").groupBy("case_id")
    parts = F.array_sort(F.collect_list(F.struct("__piece", "activities")))
    return one.agg(F.flatten(F.transform(parts, lambda x: x["activities"])).alias("activities"), F.min("start_us").alias("start_us"), F.max("end_us").alias("end_us"))


def with_variant(log: DataFrame) -> DataFrame:
    """One row a case with its variant key."""
    return traces(log).withColumn("variant", F.array_join("activities", SEP))


def variants(log: DataFrame) -> DataFrame:
    """V1, A1, A2, A5: per variant its frequency, share in per cent, length and duration statistics.

    Events without a case form one case, null activities are left out of the key. Sequences are long, so the share's total is one small row joined on, not a window over all variants.
    """
    cases = with_variant(log).withColumn("d", F.col("end_us") - F.col("start_us"))
    out = cases.groupBy("variant").agg(
        F.count(F.lit(1)).alias("frequency"),
        F.first(F.size("activities")).alias("length"),
        F.median("d").cast("double").alias("median_us"),
        F.min("d").alias("min_us"),
        F.max("d").alias("max_us"),
    )
    total = log.agg((F.count_distinct("case_id") + F.coalesce(F.max(F.col("case_id").isNull().cast("int")), F.lit(0))).alias("total"))
    return out.crossJoin(F.broadcast(total)).withColumn("pct", F.round(100 * F.col("frequency") / F.col("total"), 2)).drop("total")


def top(vs: DataFrame, k: int) -> DataFrame:
    """The k most frequent variants, ties by key."""
    return vs.orderBy(F.desc("frequency"), "variant").limit(k)


def numbered(vs: DataFrame) -> DataFrame:
    """Variants numbered from 1 by falling frequency, ties by key, named Variant_n; ranked by ranges."""
    out = ranks.running(vs, [F.desc("frequency"), F.asc("variant")]).withColumn("n", (F.col("below") + 1).cast("int")).drop("below")
    return out.withColumn("name", F.concat(F.lit("Variant_"), F.col("n").cast("string")))


def frequent_only(log: DataFrame, least: int) -> DataFrame:
    """The cases of variants with at least ``least`` cases."""
    cases = with_variant(log)
    keep = cases.groupBy("variant").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= least).select("variant")
    return cases.join(keep, "variant", "left_semi").select("case_id", "variant")


def of_variants(log: DataFrame, chosen: DataFrame) -> DataFrame:
    """The events of the cases whose variant is among ``chosen`` (variant)."""
    cases = with_variant(log).join(chosen.select("variant").distinct(), "variant", "left_semi")
    return log.join(cases.select("case_id"), "case_id", "left_semi")


def merge_neighbours(a: Column) -> Column:
    """Walk left to right; different neighbours become 'x||y' and both are used up, else the element stays."""
    start = F.struct(F.array().cast("array<string>").alias("out"), F.lit(None).cast("string").alias("held"))

    def step(acc: Column, x: Column) -> Column:
        pair = acc["held"].isNotNull() & (acc["held"] != x)
        return F.struct(
            F.when(acc["held"].isNull(), acc["out"]).otherwise(F.array_append(acc["out"], F.when(pair, F.concat(acc["held"], F.lit("||"), x)).otherwise(acc["held"]))).alias("out"),
            F.when(pair, F.lit(None)).otherwise(x).alias("held"),
        )

    return F.aggregate(a, start, step, lambda acc: F.when(acc["held"].isNull(), acc["out"]).otherwise(F.array_append(acc["out"], acc["held"])))


def mark_cycles(a: Column) -> Column:
    """Keep first occurrences; at a repeat the most recently kept element gets a '*' unless it has one."""
    start = F.struct(F.array().cast("array<string>").alias("out"), F.array().cast("array<string>").alias("seen"))

    def step(acc: Column, x: Column) -> Column:
        last = F.try_element_at(acc["out"], F.lit(-1))
        marked = F.concat(F.slice(acc["out"], 1, F.size(acc["out"]) - 1), F.array(F.when(last.endswith("*"), last).otherwise(F.concat(last, F.lit("*")))))
        repeat = F.array_contains(acc["seen"], x)
        return F.struct(F.when(repeat, marked).otherwise(F.array_append(acc["out"], x)).alias("out"), F.when(repeat, acc["seen"]).otherwise(F.array_append(acc["seen"], x)).alias("seen"))

    return F.aggregate(a, start, step, lambda acc: acc["out"])


def reduced(log: DataFrame) -> DataFrame:
    """Cases per reduced variant (W9, then W10)."""
    key = F.concat(F.lit("["), F.array_join(mark_cycles(merge_neighbours(F.col("activities"))), SEP), F.lit("]"))
    return traces(log).select(key.alias("reduced")).groupBy("reduced").agg(F.count(F.lit(1)).alias("frequency"))


def collapsed(log: DataFrame) -> DataFrame:
    """Cases per sequence in which runs of one activity are one loop element, 'a+'."""
    a = F.col("activities")
    starts = F.filter(F.sequence(F.lit(0), F.size(a) - 1), lambda i: (i == 0) | ~F.get(a, i).eqNullSafe(F.get(a, i - 1)))
    pairs = F.arrays_zip(F.col("starts"), F.array_append(F.slice("starts", 2, 1 << 30), F.size(a)).alias("stops"))
    names = F.transform(pairs, lambda x: F.concat(F.get(a, x["starts"]), F.when(x["stops"] - x["starts"] > 1, "+").otherwise("")))
    return traces(log).withColumn("starts", starts).groupBy(F.array_join(names, SEP).alias("collapsed")).agg(F.count(F.lit(1)).alias("frequency"))


def concurrency(log: DataFrame, granularity_us: int) -> DataFrame:
    """V3: cases per partial order when events of one time slot are concurrent: slots in order, their activities sorted.

    With single timestamps an event's interval is its slot; slots of one activity read 'a', of several '(a|b)'.
    """
    slot = F.floor(F.col("us") / granularity_us)
    slots = log.groupBy("case_id", slot.alias("slot")).agg(F.array_sort(F.collect_list("activity")).alias("a"))
    text = F.when(F.size("a") > 1, F.concat(F.lit("("), F.array_join("a", "|"), F.lit(")"))).otherwise(F.col("a")[0])
    seq = slots.groupBy("case_id").agg(F.array_sort(F.collect_list(F.struct("slot", text.alias("x")))).alias("e"))
    return seq.groupBy(F.array_join(F.col("e.x"), SEP).alias("concurrency_variant")).agg(F.count(F.lit(1)).alias("frequency"))


def compare(vs: DataFrame, a: str, b: str) -> DataFrame:
    """Activities that only one of two variants has."""
    one = vs.filter(F.col("variant") == a).select(F.split("variant", SEP).alias("x"))
    two = vs.filter(F.col("variant") == b).select(F.split("variant", SEP).alias("y"))
    return one.crossJoin(two).select(F.array_join(F.array_sort(F.array_except("x", "y")), ",").alias("only_a"), F.array_join(F.array_sort(F.array_except("y", "x")), ",").alias("only_b"))


def activity_index(log: DataFrame) -> DataFrame:
    """V16 reverse lookup: per activity the number of variants and of cases that have it."""
    cases = with_variant(log).select("case_id", "variant", F.explode(F.array_distinct("activities")).alias("activity"))
    return cases.groupBy("activity").agg(F.count_distinct("variant").alias("n_variants"), F.count(F.lit(1)).alias("n_cases"))


def sub_variants(log: DataFrame) -> DataFrame:
    """V6: (variant, sub_variant, frequency): how start and complete events interleave within a variant of completions.

    log has lifecycle, 'start' or 'complete'; a case without a completion has the empty variant.
    """
    named = log.withColumn("activity", F.concat("activity", F.when(F.col("lifecycle") == "start", "+s").otherwise("+c")))
    steps = F.col("activities")
    done = F.transform(F.filter(steps, lambda a: a.endswith("+c")), lambda a: F.substring_index(a, "+", 1))
    keyed = traces(named).select(F.array_join(done, SEP).alias("variant"), F.array_join(steps, SEP).alias("sub_variant"))
    return keyed.groupBy("variant", "sub_variant").agg(F.count(F.lit(1)).alias("frequency"))


def linear_extensions(key: str, limit: int) -> list[str]:
    """The orders that a concurrency variant such as 'a->(b|c)' allows, sorted; more than ``limit`` are an error."""
    out = [""]
    for slot in key.split(SEP) if key else []:
        names = slot.strip("()").split("|")
        orders = sorted(set(permutations(names)))
        if len(out) * len(orders) > limit:
            raise ValueError(f"more than {limit} orders")
        out = [f"{o}{SEP if o else ''}{SEP.join(p)}" for o in out for p in orders]
    return out


def with_custom(log: DataFrame, name: str, activities: list[str]) -> DataFrame:
    """V8: the log with one more case, ``name``, of the given activities one microsecond apart."""
    spark = log.sparkSession
    own = spark.createDataFrame([(name, a, i, i) for i, a in enumerate(activities)], "case_id string, activity string, event_id bigint, us bigint")
    return log.select("case_id", "activity", "event_id", "us").unionByName(own)


def by_names(cases: DataFrame, numbered_variants: DataFrame, names: list[str]) -> DataFrame:
    """The cases of variants by their names; a name that no variant has is an error."""
    chosen = numbered_variants.filter(F.col("name").isin(*names))
    missing = set(names) - {r[0] for r in chosen.select("name").collect()}
    if missing:
        raise ValueError(f"no variants called {sorted(missing)}")
    return cases.join(chosen, "variant")


def objects(vs: DataFrame) -> DataFrame:
    """V5: per variant its count, length, number of activities, share and cluster, -1 as none is assigned."""
    return vs.select("variant", F.col("frequency").alias("n"), "length", F.size(F.array_distinct(F.split("variant", SEP))).alias("n_activities"), "pct", F.lit(-1).alias("cluster_id"))


def properties(log: DataFrame) -> DataFrame:
    """V7: one row on the whole log: events, cases, variants, activities, time span and lengths of cases."""
    cases = with_variant(log).select("variant", F.size("activities").alias("n"))
    one = cases.agg(F.count(F.lit(1)).alias("n_cases"), F.count_distinct("variant").alias("n_variants"), F.max("n").alias("longest"), F.avg("n").alias("avg_length"))
    every = log.agg(F.count(F.lit(1)).alias("n_events"), F.count_distinct("activity").alias("n_activities"), F.min("us").alias("start_us"), F.max("us").alias("end_us"))
    return every.crossJoin(one)
