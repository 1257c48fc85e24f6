"""Running totals over a total order, by ranges of the sorted rows, so that no task sees all rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from flowloom.session import cut


def running(df: DataFrame, order: Sequence[Column | str], amount: Column | None = None, groups: Sequence[str] = ()) -> DataFrame:
    """Adds ``below``: the sum of ``amount`` (default: the number of rows) over the rows before in ``order``, by ``groups``.

    ``order`` must be total within a group. Rows are cut into ranges of (groups, order) and written once, so the ranges
    are the same wherever they are used; a range is summed in its task, and what lies before a range comes from one
    row for each group and range.
    """
    order = [F.col(o) if isinstance(o, str) else o for o in order]
    named = df.withColumn("__amount", F.lit(1).cast("long") if amount is None else amount)
    ranges = cut(named.repartitionByRange(*[F.col(g) for g in groups], *order).withColumn("__range", F.spark_partition_id()))
    w = Window.partitionBy("__range", *groups).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    inside = ranges.withColumn("__inside", F.coalesce(F.sum("__amount").over(w), F.lit(0)))
    totals = ranges.groupBy("__range", *groups).agg(F.sum("__amount").alias("__total"))
    before = Window.partitionBy(*(groups or [F.lit(1)])).orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    names = [f"__g{i}" for i in range(len(groups))]
    offsets = totals.select(F.col("__range").alias("__r"), *[F.col(g).alias(n) for g, n in zip(groups, names)], F.coalesce(F.sum("__total").over(before), F.lit(0)).alias("__before"))
    on = F.col("__range") == F.col("__r")
    for g, n in zip(groups, names):
        on = on & F.col(g).eqNullSafe(F.col(n))
    return inside.join(offsets, on).withColumn("below", F.col("__before") + F.col("__inside")).select(*df.columns, "below")
