"""Queries of journey stitching and graph operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from flowloom.operators import graph
from flowloom.session import cut, load

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return add


def day_hour_edges(spark: SparkSession, d: str) -> DataFrame:
    """Events linked by (user, day) and by (k, hour)."""
    e = load(spark, d, "events")
    k = F.get_json_object("props", "$.k")
    keys = F.array(F.concat_ws(":", F.lit("u"), "user_id", F.date_format("ts", "yyyy-MM-dd")), F.concat_ws(":", F.lit("k"), k, F.date_format("ts", "yyyy-MM-dd HH")))
    return graph.key_edges(e.select(F.lpad(F.col("event_id").cast("string"), 9, "0").alias("event_id"), keys.alias("correlation_keys")))


_EDGES = """e as (select lpad(cast(event_id as varchar), 9, '0') as event_id, unnest(['u:' || user_id || ':' || strftime(ts, '%Y-%m-%d'), 'k:' || regexp_extract(props, '"k": *([0-9]+)', 1) || ':' || strftime(ts, '%Y-%m-%d %H')]) as key from events)"""
_WCC = f"with recursive {_EDGES}, l as (select distinct a.event_id as u, b.event_id as v from e a join e b using (key)), r as (select u, v from l union select r.u, l.v from r join l on r.v = l.u), j as (select u as event_id, min(v) as journey_id from r group by u)"


def _journeys(spark: SparkSession, d: str) -> DataFrame:
    return graph.stitch(day_hour_edges(spark, d))


@query("g1_stitch", _WCC + " select * from j")
def g1(spark: SparkSession, d: str) -> DataFrame:
    return _journeys(spark, d)


@query("g12_incremental_stitch", _WCC + " select * from j")
def g12(spark: SparkSession, d: str) -> DataFrame:
    """A tenth of the events arrives later and joins the journeys of the others, which are not stitched again."""
    edges = cut(day_hour_edges(spark, d))
    late = F.col("event_id").cast("bigint") % 10 == 9
    early = edges.filter(~late)
    state = graph.as_journeys(early, cut(graph.stitch(early)))
    return graph.merged(state, graph.merge_batch(state, edges.filter(late))).current()


@query("g13_aliases", f"with recursive {_EDGES}, l as (select distinct a.event_id as u, b.event_id as v from e a join e b using (key)), r as (select u, v from l union select r.u, l.v from r join l on r.v = l.u), h as (select * from l where cast(u as bigint) % 2 = 0 and cast(v as bigint) % 2 = 0), s as (select u, v from h union select s.u, h.v from s join h on s.v = h.u), old as (select u, min(v) as o from s group by u), new as (select u, min(v) as n from r group by u) select distinct o as old_id, n as new_id from old join new using (u) where o <> n")
def g13(spark: SparkSession, d: str) -> DataFrame:
    edges = day_hour_edges(spark, d)
    return graph.aliases(graph.stitch(edges.filter(F.col("event_id").cast("bigint") % 2 == 0)), graph.stitch(edges))


@query("g15_lookup", _WCC + " select * from j where journey_id in (select journey_id from j where event_id = '000000001')")
def g15(spark: SparkSession, d: str) -> DataFrame:
    return graph.lookup(_journeys(spark, d), spark.createDataFrame([("000000001",)], "event_id string"))


@query("a12_journey_sizes", _WCC + " select journey_id, count(*) as n_events from j group by 1")
def a12(spark: SparkSession, d: str) -> DataFrame:
    return graph.sizes(_journeys(spark, d))


@query("a15_events_per_journey", _WCC + ", s as (select count(*) as n from j group by journey_id) select avg(n) as avg_events, max(n) as max_events, count(*) as n_journeys from s")
def a15(spark: SparkSession, d: str) -> DataFrame:
    return graph.sizes(_journeys(spark, d)).agg(F.avg("n_events").alias("avg_events"), F.max("n_events").alias("max_events"), F.count(F.lit(1)).alias("n_journeys"))


@query("g16_canonical_ids", _WCC + " select event_id, 'CJ:' || sha256(journey_id) as canonical_id from j")
def g16(spark: SparkSession, d: str) -> DataFrame:
    return graph.canonical_id(_journeys(spark, d))


@query("g9_two_hops", f"with {_EDGES}, a as (select distinct key from e where event_id = '000000001'), b as (select distinct event_id from e where key in (from a)), c as (select distinct key from e where event_id in (from b)) select distinct event_id from e where key in (from c)")
def g9(spark: SparkSession, d: str) -> DataFrame:
    return graph.within_two_hops(day_hour_edges(spark, d), spark.createDataFrame([("000000001",)], "event_id string"))


@query("l19_capped_edges", f"with {_EDGES} select distinct event_id, key from e where key in (select key from e group by key having count(distinct event_id) <= 2)")
def l19(spark: SparkSession, d: str) -> DataFrame:
    return graph.capped(day_hour_edges(spark, d), 2)


@query("p14_key_edges", "with k as (select event_id, trim(lower(regexp_replace(unnest(correlation_keys), '^[\\s''\"]+|[\\s''\"]+$', '', 'g'))) as key from journey_events) select distinct event_id, key from k where key <> ''")
def p14(spark: SparkSession, d: str) -> DataFrame:
    return graph.key_edges(load(spark, d, "journey_events"))


@query("p16_hashed_keys", "with k as (select event_id, lower(regexp_replace(unnest(correlation_keys), '^[\\s''\"]+|[\\s''\"]+$', '', 'g')) as key from journey_events) select distinct event_id, sha256(key) as key_hash from k where key <> ''")
def p16(spark: SparkSession, d: str) -> DataFrame:
    return graph.key_edges(load(spark, d, "journey_events")).select("event_id", F.sha2("key", 256).alias("key_hash"))


@query("g25_fragmented", "select journey_id, count(distinct app_name) as n_apps from (select distinct event_id, app_name, journey_id from journey_events where journey_id is not null) group by 1 having count(distinct app_name) < 3")
def g25(spark: SparkSession, d: str) -> DataFrame:
    e = load(spark, d, "journey_events")
    return graph.fragmented(e, e.filter("journey_id is not null").select("event_id", "journey_id").distinct(), 3)


@query("g23_validate", "select 0 as split, 0 as merged, 0 as missing, 0 as unexpected")
def g23(spark: SparkSession, d: str) -> DataFrame:
    """One-shot and incremental stitching give the same partition of all events."""
    return graph.validate(g12(spark, d), g1(spark, d))


@query("g23_validate_cases", _WCC + """, c as (select lpad(cast(event_id as varchar), 9, '0') as event_id, user_id || '|' || strftime(ts, '%Y-%m-%d') as e from events where event_id > 20), p as (select distinct journey_id as f, e from j join c using (event_id)),
b as (select j.event_id as f, c.event_id as e from j full join c using (event_id))
select (select count(*) from (select e from p group by e having count(*) > 1)) as split, (select count(*) from (select f from p group by f having count(*) > 1)) as merged, (select count(*) from b where f is null) as missing, (select count(*) from b where e is null) as unexpected""")
def g23b(spark: SparkSession, d: str) -> DataFrame:
    """The journeys against the cases of a user and day, of which the first twenty events are not known."""
    e = load(spark, d, "events").filter("event_id > 20")
    cases = e.select(F.lpad(F.col("event_id").cast("string"), 9, "0").alias("event_id"), F.concat_ws("|", "user_id", F.date_format("ts", "yyyy-MM-dd")).alias("journey_id"))
    return graph.validate(_journeys(spark, d), cases)


@query("g19_first_last", "select app_name, event_id, min(epoch_us(created_at)) as first_us, max(epoch_us(created_at)) as last_us from journey_events group by 1, 2")
def g19(spark: SparkSession, d: str) -> DataFrame:
    us = F.unix_micros(F.col("created_at").cast("timestamp"))
    return load(spark, d, "journey_events").groupBy("app_name", "event_id").agg(F.min(us).alias("first_us"), F.max(us).alias("last_us"))


@query("g22_reachable", """with recursive x as (select 'supplier:' || l_suppkey as s, 'part:' || l_partkey as p from lineitem where l_suppkey is not null and l_partkey is not null group by 1, 2),
e as (select s as src, p as dst from x union all select p, s from x),
r(node, depth) as (select 'supplier:1', 0 union select e.dst, r.depth + 1 from r join e on e.src = r.node where r.depth < 3)
select node, min(depth) as depth from r group by node""")
def g22(spark: SparkSession, d: str) -> DataFrame:
    """Suppliers and parts linked by the line items, either way, from supplier 1."""
    l = load(spark, d, "lineitem").select(F.concat(F.lit("supplier:"), "l_suppkey").alias("s"), F.concat(F.lit("part:"), "l_partkey").alias("p")).dropna().distinct()
    edges = cut(l.select(F.explode(F.array(F.struct(F.col("s").alias("src"), F.col("p").alias("dst")), F.struct(F.col("p").alias("src"), F.col("s").alias("dst")))).alias("e")).select("e.*"))
    return graph.reachable(edges, spark.createDataFrame([("supplier:1",)], "node string"), 3)


@query("g18_linked_events", """with j as (select distinct event_id, journey_id from journey_events where journey_id is not null and event_id is not null)
select distinct a.event_id as a, b.event_id as b from j a join j b using (journey_id) where a.event_id <> b.event_id""")
def g18(spark: SparkSession, d: str) -> DataFrame:
    return graph.linked_events(load(spark, d, "journey_events").select("event_id", "journey_id"))


@query("g24_orphans", "select count(*) as n_events, count(*) filter (where correlation_keys is null or len(correlation_keys) = 0) as n_orphans, count(distinct journey_id) as n_journeys from journey_events")
def g24(spark: SparkSession, d: str) -> DataFrame:
    orphan = F.col("correlation_keys").isNull() | (F.size("correlation_keys") == 0)
    return load(spark, d, "journey_events").agg(F.count(F.lit(1)).alias("n_events"), F.count_if(orphan).alias("n_orphans"), F.count_distinct("journey_id").alias("n_journeys"))
