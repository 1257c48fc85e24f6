"""Directly-follows graphs and the discovery steps that Spark can aggregate."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowloom.operators.logs import ends, with_next


def graph(log: DataFrame) -> DataFrame:
    """(src, dst, frequency, avg_us, min_us, max_us) of directly following activities."""
    gap = F.col("next_us") - F.col("us")
    return (
        with_next(log)
        .filter("next_activity is not null")
        .groupBy(F.col("activity").alias("src"), F.col("next_activity").alias("dst"))
        .agg(F.count(F.lit(1)).alias("frequency"), F.avg(gap).alias("avg_us"), F.min(gap).alias("min_us"), F.max(gap).alias("max_us"))
    )


def heuristics(dfg: DataFrame) -> DataFrame:
    """Dependency (ab - ba) / (ab + ba + 1), for a loop of one aa / (aa + 1)."""
    back = dfg.select(F.col("dst").alias("src"), F.col("src").alias("dst"), F.col("frequency").alias("back"))
    both = dfg.select("src", "dst", "frequency").join(back, ["src", "dst"], "left").withColumn("back", F.coalesce("back", F.lit(0)))
    value = F.when(F.col("src") == F.col("dst"), F.col("frequency") / (F.col("frequency") + 1)).otherwise((F.col("frequency") - F.col("back")) / (F.col("frequency") + F.col("back") + 1))
    return both.select("src", "dst", "frequency", value.alias("dependency"))


def footprint(dfg: DataFrame) -> DataFrame:
    """D2's relations: '->' causal, '<-' inverse, '||' both ways, for pairs that follow each other at all."""
    edges = dfg.select("src", "dst").distinct()
    both = edges.select("src", "dst", F.lit(1).alias("f")).unionByName(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), F.lit(2).alias("f"))).distinct()
    relation = F.when(F.sum("f") == 3, "||").when(F.sum("f") == 1, "->").otherwise("<-")
    return both.groupBy("src", "dst").agg(relation.alias("relation"))


def partial_order_edges(log: DataFrame) -> DataFrame:
    """The merged partial order by label: distinct directly following labels without self loops."""
    return graph(log).filter("src <> dst").select("src", "dst")


def without_reversed(edges: DataFrame) -> DataFrame:
    """Both edges of a reversed pair go."""
    back = edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))
    return edges.join(back, ["src", "dst"], "left_anti")


def terminals(edges: DataFrame) -> DataFrame:
    """Sources (never a target) and sinks (never a source) of an edge list."""
    a, b = edges.select(F.col("src").alias("node")).distinct(), edges.select(F.col("dst").alias("node")).distinct()
    return a.join(b, "node", "left_anti").withColumn("kind", F.lit("source")).unionByName(b.join(a, "node", "left_anti").withColumn("kind", F.lit("sink")))


def petri_arcs(edges: DataFrame) -> DataFrame:
    """Arcs of the net with one place for each edge and one initial and one final place."""
    place = F.concat(F.lit("p_"), F.col("src"), F.lit("_"), F.col("dst"))
    arcs = edges.select(F.col("src").alias("source"), place.alias("target")).unionByName(edges.select(place.alias("source"), F.col("dst").alias("target")))
    t = terminals(edges)
    start = t.filter("kind = 'source'").select(F.lit("initial").alias("source"), F.col("node").alias("target"))
    stop = t.filter("kind = 'sink'").select(F.col("node").alias("source"), F.lit("final").alias("target"))
    return arcs.unionByName(start).unionByName(stop)


def missing_activities(log: DataFrame, model: DataFrame) -> DataFrame:
    """Activities of the log that the model (column activity) lacks."""
    return log.select("activity").distinct().join(model.select("activity"), "activity", "left_anti")


def diagram(log: DataFrame) -> DataFrame:
    """M6: node rows of a process diagram: events, cases, and how often the activity starts and ends a case."""
    nodes = log.groupBy("activity").agg(F.count(F.lit(1)).alias("n_events"), F.count_distinct("case_id").alias("n_cases"))
    e = ends(log)
    first = e.groupBy(F.col("first_activity").alias("activity")).agg(F.count(F.lit(1)).alias("n_starts"))
    last = e.groupBy(F.col("last_activity").alias("activity")).agg(F.count(F.lit(1)).alias("n_ends"))
    out = nodes.join(first, "activity", "left").join(last, "activity", "left")
    return out.fillna(0, ["n_starts", "n_ends"])
