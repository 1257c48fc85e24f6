"""Table maintenance as joins: idempotent inserts, upserts, bulk updates, deletes and overlap joins."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowloom.operators.graph import sanitised


def insert_absent(target: DataFrame, new: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The target and those new rows whose key it lacks, each key once."""
    return target.unionByName(new.dropDuplicates(list(keys)).join(target.select(*keys), list(keys), "left_anti"))


def upsert(target: DataFrame, new: DataFrame, keys: Sequence[str]) -> DataFrame:
    """New values win where they are not null; new keys are added. Keys are unique on both sides."""
    rest = [c for c in target.columns if c not in keys]
    fresh = new.select(*keys, *[F.col(c).alias(f"__{c}") for c in rest])
    return target.join(fresh, list(keys), "full").select(*keys, *[F.coalesce(f"__{c}", c).alias(c) for c in rest])


def update_from(target: DataFrame, changes: DataFrame, key: str, column: str) -> DataFrame:
    """The target with one column replaced where the changes have its key."""
    new = changes.select(F.col(key), F.col(column).alias("__new"))
    return target.join(new, key, "left").withColumn(column, F.coalesce("__new", column)).drop("__new")


def delete_keys(target: DataFrame, gone: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The target without the rows of the given keys."""
    return target.join(gone.select(*keys), list(keys), "left_anti")


def overlapping(a: DataFrame, b: DataFrame, key: str, values: str, placeholders: DataFrame | None = None) -> DataFrame:
    """Pairs of rows whose arrays share an element, through the elements; rows that share none are not compared.

    Every such pair is a row of the result, so an element that n rows of either side hold gives n * n rows.
    Elements that are one of ``placeholders`` (placeholder), case, quotes and blanks around them ignored, link nothing.
    """

    def elements(df: DataFrame, name: str) -> DataFrame:
        x = df.select(F.col(key).alias(name), F.explode(F.array_distinct(values)).alias("v")).filter("v is not null")
        if placeholders is None:
            return x
        return x.join(placeholders.select(sanitised(F.col("placeholder")).alias("void")), sanitised(F.col("v")) == F.col("void"), "left_anti")

    return elements(a, "a").join(elements(b, "b"), "v").select("a", "b").distinct()


def payload_fields(df: DataFrame, payload: str, fields: dict[str, str]) -> DataFrame:
    """The rows whose payload is one JSON object, with some of its fields as typed columns, null where they are
    missing or of another type; the payload goes."""
    v = F.try_parse_json(payload)
    rows = df.withColumn("__v", v).filter(F.schema_of_variant("__v").startswith("OBJECT"))
    return rows.select(*[c for c in df.columns if c != payload], *[F.try_variant_get("__v", f"$.{f}", t).alias(f) for f, t in fields.items()])


def combined_groups(counts: DataFrame, group: str, value: str) -> DataFrame:
    """Totals and share in per cent of each group."""
    one = counts.groupBy(group).agg(F.sum(value).alias("total"), F.count(F.lit(1)).alias("n"))
    every = counts.agg(F.sum(value).alias("all"))
    return one.crossJoin(F.broadcast(every)).withColumn("pct", F.round(100 * F.col("total") / F.col("all"), 2)).drop("all")


def distribution_gap(part: DataFrame, whole: DataFrame, category: str) -> DataFrame:
    """Shares of a category in a part and in the whole, aligned, 0 where absent."""
    def shares(df: DataFrame, name: str) -> DataFrame:
        total = df.agg(F.count(F.lit(1)).alias("t"))
        return df.groupBy(category).agg(F.count(F.lit(1)).alias("n")).crossJoin(F.broadcast(total)).select(category, (F.col("n") / F.col("t")).alias(name))

    both = shares(part, "part_share").join(shares(whole, "whole_share"), category, "full")
    return both.select(category, *[F.round(F.coalesce(c, F.lit(0.0)), 6).alias(c) for c in ("part_share", "whole_share")])


def sample_by_hash(df: DataFrame, key: str, k: int, seed: int = 0) -> DataFrame:
    """K rows drawn by a seeded hash of the key; the same rows whatever the partitioning."""
    return df.orderBy(F.xxhash64(F.col(key), F.lit(seed)), key).limit(k)


def page(df: DataFrame, order: str, after: object | None, size: int) -> DataFrame:
    """The next ``size`` rows after a key, by keyset instead of an offset."""
    return (df if after is None else df.filter(F.col(order) > F.lit(after))).orderBy(order).limit(size)
