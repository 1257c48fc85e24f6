"""Journey stitching on DataFrames: components, incremental merges, lookups, bounded hops and validation.

A journey's id is a pure function of its members (the smallest one), so a merge needs no winner: earlier ids go to an
alias table and members keep the id they were given. Edge tables have event_id and key, both strings.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from flowloom.functions.instants import BLANKS
from flowloom.session import cut


def sanitised(key: Column) -> Column:
    """Quotes and blanks around a key go, case is ignored."""
    return F.lower(F.btrim(key, F.lit(BLANKS + "'\"")))


def key_edges(events: DataFrame, keys: str = "correlation_keys") -> DataFrame:
    """(event_id, key), one row for each distinct key of an event; null and blank keys go."""
    e = events.select("event_id", F.explode(F.array_distinct(F.transform(keys, sanitised))).alias("key"))
    return e.filter("event_id is not null and key is not null and key <> ''").distinct()


def capped(edges: DataFrame, cap: int) -> DataFrame:
    """The edges of keys that at most ``cap`` events share; the others are hubs and link nothing here."""
    few = edges.groupBy("key").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") <= cap).select("key")
    return edges.join(few, "key", "left_semi")


def windowed(edges: DataFrame, time: str, start: str, end: str, cap: int) -> DataFrame:
    """The distinct edges of a time window, of keys that at most ``cap`` events of the window share."""
    inside = edges.filter((F.col(time) >= F.lit(start).cast("timestamp_ntz")) & (F.col(time) < F.lit(end).cast("timestamp_ntz")))
    return capped(inside.select("event_id", "key").distinct(), cap)


def weighted_stitch(links: DataFrame, least: float) -> DataFrame:
    """(event_id, journey_id) over the links (a, b, weight) of at least a weight; ends of lighter links only are left out."""
    heavy = links.filter(F.col("weight") >= least)
    name = F.concat_ws("\u0000", "a", "b")
    return stitch(heavy.select(F.explode(F.array("a", "b")).alias("event_id"), name.alias("key")))


def _contracted(edges: DataFrame) -> DataFrame:
    """(u, root) for every end of the edges (a, b), all of which have a < b: ends with one root are connected.

    Every vertex points to the vertex of least priority among itself and its neighbours, priorities being hashes that
    change from round to round, and then to what that one points to; edges are carried over to the pointed-to vertices
    until none is left. Each round leaves at most a fraction of the vertices, whatever the shape, and all of its steps
    are aggregations with map-side combine and equi-joins.
    """
    left, levels = edges, []
    while not left.isEmpty():
        priority = lambda c: F.xxhash64(c, F.lit(len(levels)))
        both = left.unionByName(left.select(F.col("b").alias("a"), F.col("a").alias("b")))
        near = both.groupBy(F.col("a").alias("u")).agg(F.min(F.struct(priority(F.col("b")).alias("h"), F.col("b").alias("p"))).alias("m"))
        own = F.struct(priority(F.col("u")).alias("h"), F.col("u").alias("p"))
        points = near.select("u", F.least(own, F.col("m"))["p"].alias("p"))
        far = points.select(F.col("u").alias("p"), F.col("p").alias("q"))
        level = cut(points.join(far, "p").select("u", F.col("q").alias("p")))
        levels.append(level)
        pa, pb = level.select(F.col("u").alias("a"), F.col("p").alias("pa")), level.select(F.col("u").alias("b"), F.col("p").alias("pb"))
        moved = left.join(pa, "a").join(pb, "b").filter("pa <> pb")
        left = cut(moved.select(F.least("pa", "pb").alias("a"), F.greatest("pa", "pb").alias("b")).distinct())
    if not levels:
        return edges.select(F.col("a").alias("u"), F.col("b").alias("root"))
    roots = levels[-1].select("u", F.col("p").alias("root"))
    for level in reversed(levels[:-1]):
        roots = level.join(roots.withColumnRenamed("u", "p"), "p", "left").select("u", F.coalesce("root", "p").alias("root"))
    return roots


def stitch(edges: DataFrame, prior: DataFrame | None = None) -> DataFrame:
    """(event_id, journey_id), journey_id the smallest event_id linked directly or indirectly.

    Every event is linked to the smallest event of each of its keys, so that no pairs within a key are formed, and the
    links are contracted (see _contracted). A key that holds a third of all rows is one row of its aggregation, and its
    rows are split by AQE where they meet that row again. ``prior`` (event_id, journey_id) links the events of an
    earlier journey (G4). Null ids and keys link nothing; repeated rows change nothing; no edges give no rows.
    """
    keyed = edges.select("event_id", F.concat(F.lit("k:"), "key").alias("key"))
    if prior is not None:
        keyed = keyed.unionByName(prior.select("event_id", F.concat(F.lit("j:"), "journey_id").alias("key")))
    keyed = keyed.filter("event_id is not null")
    hub = keyed.filter("key is not null").groupBy("key").agg(F.min("event_id").alias("a"))
    links = cut(keyed.join(hub, "key").select("a", F.col("event_id").alias("b")).filter("a <> b").distinct())
    # all rows of an event have the event itself, those that are not the smallest of some key have a root as well
    roots = cut(keyed.select(F.col("event_id").alias("u")).distinct().join(_contracted(links), "u", "left").select("u", F.coalesce("root", "u").alias("root")))
    least = roots.groupBy("root").agg(F.min("u").alias("journey_id"))
    return roots.join(least, "root").select(F.col("u").alias("event_id"), "journey_id")


@dataclass(frozen=True)
class Journeys:
    """What is stitched so far. members: event_id, journey_id as first given; keys: key, journey_id as first given;
    aliases: old_id, new_id, the id that now stands for an earlier one. All three only grow by what a batch touches."""

    members: DataFrame
    keys: DataFrame
    aliases: DataFrame

    def current(self) -> DataFrame:
        """(event_id, journey_id) with today's ids."""
        return _resolved(self.members, self.aliases)


def _resolved(rows: DataFrame, aliases: DataFrame) -> DataFrame:
    return rows.join(aliases, rows["journey_id"] == aliases["old_id"], "left").withColumn("journey_id", F.coalesce("new_id", "journey_id")).drop("old_id", "new_id")


def no_journeys(spark: SparkSession) -> Journeys:
    return Journeys(*(spark.createDataFrame([], f"{a} string, {b} string") for a, b in (("event_id", "journey_id"), ("key", "journey_id"), ("old_id", "new_id"))))


def as_journeys(edges: DataFrame, journeys: DataFrame) -> Journeys:
    """The state after a first stitch of ``edges``."""
    keys = edges.join(journeys, "event_id").groupBy("key").agg(F.min("journey_id").alias("journey_id"))
    return Journeys(journeys, keys, no_journeys(edges.sparkSession).aliases)


def merge_batch(state: Journeys, edges: DataFrame) -> Journeys:
    """What a batch of edges adds: new members, new keys, and the whole alias table afterwards.

    Only the batch and the journeys that its keys and events touch are stitched: none gives a new journey, one attaches,
    several merge into the smallest id (G13), which becomes the alias of the others. Members and keys of merged journeys
    are not rewritten. The state is met by joins with the batch alone, which are broadcasts while the batch is small.
    A redelivered batch adds nothing.
    """
    new = cut(edges.filter("event_id is not null and key is not null").select("event_id", "key").distinct())
    by_key = new.join(state.keys, "key").select("event_id", "journey_id")
    by_event = new.select("event_id").distinct().join(state.members, "event_id")
    touched = cut(_resolved(by_key.unionByName(by_event), state.aliases).distinct())
    found = cut(stitch(new, prior=touched))
    named = touched.join(found.withColumnRenamed("journey_id", "root"), "event_id")
    # a group takes the smallest id of the journeys that it touches, or that of its smallest event
    target = named.groupBy("root").agg(F.min("journey_id").alias("least")).withColumn("target", F.least("root", "least"))
    ids = found.select(F.col("journey_id").alias("root")).distinct().join(target, "root", "left").select("root", F.coalesce("target", "root").alias("target"))
    placed = found.withColumnRenamed("journey_id", "root").join(ids, "root").select("event_id", F.col("target").alias("journey_id"))
    merged = cut(named.join(ids, "root").filter("journey_id <> target").select(F.col("journey_id").alias("old_id"), F.col("target").alias("new_id")).distinct())
    later = merged.select(F.col("old_id").alias("new_id"), F.col("new_id").alias("__newer"))
    aliases = state.aliases.join(later, "new_id", "left").select("old_id", F.coalesce("__newer", "new_id").alias("new_id")).unionByName(merged)
    members = placed.join(state.members.select("event_id"), "event_id", "left_anti")
    fresh = new.join(placed, "event_id").groupBy("key").agg(F.min("journey_id").alias("journey_id"))
    return Journeys(members, fresh.join(state.keys.select("key"), "key", "left_anti"), aliases)


def merged(state: Journeys, added: Journeys) -> Journeys:
    """The state after a batch."""
    return Journeys(state.members.unionByName(added.members), state.keys.unionByName(added.keys), added.aliases)


def aliases(before: DataFrame, after: DataFrame) -> DataFrame:
    """(old_id, new_id) of the journeys that were merged into others or renamed."""
    b = before.select("event_id", F.col("journey_id").alias("old_id"))
    return b.join(after.select("event_id", F.col("journey_id").alias("new_id")), "event_id").filter("old_id <> new_id").select("old_id", "new_id").distinct()


def lookup(journeys: DataFrame, event_ids: DataFrame) -> DataFrame:
    """All events of the journeys of the given events."""
    j = journeys.join(event_ids.select("event_id"), "event_id", "left_semi").select("journey_id").distinct()
    return journeys.join(j, "journey_id", "left_semi")


def linked_events(journeys: DataFrame) -> DataFrame:
    """(a, b): every event a with each other event b of its journeys; null ids link nothing.

    Every pair is there in both directions, so the result grows with the square of a journey's size.
    """
    j = journeys.filter("event_id is not null and journey_id is not null").select("event_id", "journey_id").distinct()
    a, b = j.withColumnRenamed("event_id", "a"), j.withColumnRenamed("event_id", "b")
    return a.join(b, "journey_id").filter("a <> b").select("a", "b").distinct()


def within_two_hops(edges: DataFrame, seeds: DataFrame) -> DataFrame:
    """Events that share a key with a seed, or a key with such an event; approximate by design."""
    one = edges.join(edges.join(seeds.select("event_id"), "event_id", "left_semi").select("key").distinct(), "key", "left_semi").select("event_id").distinct()
    return edges.join(edges.join(one, "event_id", "left_semi").select("key").distinct(), "key", "left_semi").select("event_id").distinct()


def sizes(journeys: DataFrame) -> DataFrame:
    """Events by journey."""
    return journeys.groupBy("journey_id").agg(F.count(F.lit(1)).alias("n_events"))


def fragmented(events: DataFrame, journeys: DataFrame, least: int) -> DataFrame:
    """Journeys that fewer than ``least`` applications took part in."""
    apps = events.select("event_id", "app_name").join(journeys, "event_id").groupBy("journey_id").agg(F.count_distinct("app_name").alias("n_apps"))
    return apps.filter(F.col("n_apps") < least)


def validate(found: DataFrame, expected: DataFrame) -> DataFrame:
    """Whether two partitions of events are equal: split and merged groups, and missing events, over all rows."""
    f, e = found.select("event_id", F.col("journey_id").alias("f")), expected.select("event_id", F.col("journey_id").alias("e"))
    both = f.join(e, "event_id", "full")
    pairs = both.select("f", "e").distinct()
    split = pairs.filter("f is not null and e is not null").groupBy("e").count().filter("count > 1").agg(F.count(F.lit(1)).alias("split"))
    merged = pairs.filter("f is not null and e is not null").groupBy("f").count().filter("count > 1").agg(F.count(F.lit(1)).alias("merged"))
    missing = both.agg(F.count_if(F.col("f").isNull()).alias("missing"), F.count_if(F.col("e").isNull()).alias("unexpected"))
    return split.crossJoin(merged).crossJoin(missing)


def canonical_id(journeys: DataFrame) -> DataFrame:
    """(event_id, canonical_id), a hash of the journey's smallest member."""
    return journeys.select("event_id", F.concat(F.lit("CJ:"), F.sha2("journey_id", 256)).alias("canonical_id"))


def reachable(edges: DataFrame, sources: DataFrame, depth: int) -> DataFrame:
    """(node, depth): nodes reached from the sources over directed edges (src, dst), with the least depth."""
    seen = cut(sources.select(F.col("node"), F.lit(0).alias("depth")).distinct())
    front = seen
    for i in range(1, depth + 1):
        step = edges.join(front.select(F.col("node").alias("src")), "src", "left_semi").select(F.col("dst").alias("node")).distinct()
        front = cut(step.join(seen, "node", "left_anti").select("node", F.lit(i).alias("depth")))
        if front.isEmpty():
            break
        seen = seen.unionByName(front)
    return seen
