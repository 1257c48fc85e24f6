"""Queries of scans, projections, filters, set operations, scalar functions, jobs, generators and step placement."""

from __future__ import annotations

import json
from xml.sax.saxutils import quoteattr

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from flowloom.operators import bpmn, conformance, dfg, graph, jobs, logs, variants
from flowloom.plans.models import MODEL, _place
from flowloom.plans.process import chat_like
from flowloom.plans.views import CASES, LOG, NEXT, log_day
from flowloom.session import cut, load
from flowloom.sources import generators, readers, writers

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return add


# projections and reshaping


@query("p5_case_events", "with e as (select case_id, unnest(sub_activities) as x from event_log where case_id is not null) select case_id, x.event_id as event_id, x.activity as activity from e where x is not null")
def p5(spark: SparkSession, d: str) -> DataFrame:
    return logs.case_events(load(spark, d, "event_log").filter("case_id is not null"), "case_id", "sub_activities").select("case_id", "event_id", "activity")


@query("p8_dropped_column", "select row_id, activity, site from synthetic_event_log")
def p8(spark: SparkSession, d: str) -> DataFrame:
    return load(spark, d, "synthetic_event_log").drop("case_id", "timestamp", "type", "ingested_at")


@query("p1_canonical_columns", "select task_id as case_id, activity, \"timestamp\" as us, agent_name as resource from sample_agent_logs")
def p1(spark: SparkSession, d: str) -> DataFrame:
    log = logs.canonical(load(spark, d, "sample_agent_logs"), {"case_id": "task_id", "activity": "activity", "us": "timestamp", "resource": "agent_name"})
    return log.select("case_id", "activity", "us", "resource")


@query("p2_renamed_attribute", "select row_id, coalesce(resource, site) as resource from sample_logs")
def p2(spark: SparkSession, d: str) -> DataFrame:
    return logs.rename_attribute(load(spark, d, "sample_logs").select("row_id", "resource", "site"), "site", "resource")


@query("p10_stitching_key", "select row_id, coalesce(event_id, case_id) as stitching_key from sample_logs")
def p10(spark: SparkSession, d: str) -> DataFrame:
    return logs.stitching_key(load(spark, d, "sample_logs"), "event_id").select("row_id", "stitching_key")


# the path of an event_log row's levels: its own activity, a child's, a grandchild's
_LEVELS = """e as (select row_id, case_id, activity as level_1, unnest(coalesce(sub_activities, [])) as x from event_log),
l as (select row_id, case_id, activity as level_1, cast(null as varchar) as level_2, cast(null as varchar) as level_3 from event_log
  union all select row_id, case_id, level_1, x.activity, null from e where x is not null
  union all select row_id, case_id, level_1, x.activity, y.activity from (select *, unnest(coalesce(x.sub_activities, [])) as y from e where x is not null) where y is not null)"""


def _leveled(spark: SparkSession, d: str) -> DataFrame:
    return logs.leveled(load(spark, d, "event_log"), "sub_activities").select("row_id", "case_id", "level_1", "level_2", "level_3")


for _n in (1, 2, 3):

    @query(f"p6_level_{_n}", f"with {_LEVELS} select case_id, level_{_n} as activity, count(*) as n from l where level_{_n} is not null group by 1, 2")
    def p6(spark: SparkSession, d: str, n: int = _n) -> DataFrame:
        return logs.at_level(_leveled(spark, d), n).groupBy("case_id", "activity").agg(F.count(F.lit(1)).alias("n"))


# filters


@query("l2_top_level", f"with {_LEVELS} select row_id, level_1 from l where level_2 is null and level_3 is null")
def l2(spark: SparkSession, d: str) -> DataFrame:
    return logs.top_level(_leveled(spark, d)).select("row_id", "level_1")


@query("l3_new_events", "select event_id, app_name from journey_events where status = 'NEW'")
def l3(spark: SparkSession, d: str) -> DataFrame:
    return logs.matching(load(spark, d, "journey_events"), {"status": "NEW"}).select("event_id", "app_name")


@query("l8_attribute_in", "select row_id from sample_logs where resource in ('desk-a', 'desk-b')")
def l8(spark: SparkSession, d: str) -> DataFrame:
    return logs.with_attribute(load(spark, d, "sample_logs"), "resource", ["desk-a", "desk-b"]).select("row_id")


@query("l16_drill_down", f"with {_LEVELS}, a as (select min(level_1) as a from l) select row_id, level_3 from l where level_3 is not null and case_id in (select case_id from l where level_1 = (select a from a))")
def l16(spark: SparkSession, d: str) -> DataFrame:
    """The finest level of the cases that hold the first of the coarse activities."""
    rows = _leveled(spark, d)
    first = rows.agg(F.min("level_1")).first()[0]
    return logs.drill_down(rows, "level_1", first, "level_3").select("row_id", "level_3")


@query("l17_tenant", "select event_id, journey_id from journey_events where app_name = 'web_portal' and journey_id is not null")
def l17(spark: SparkSession, d: str) -> DataFrame:
    """An application as the tenant of a lookup."""
    return logs.matching(load(spark, d, "journey_events"), {"app_name": "web_portal"}).filter("journey_id is not null").select("event_id", "journey_id")


@query("l19_windowed_capped_edges", "with k as (select event_id, created_at, unnest(correlation_keys) as key from journey_events), w as (select distinct event_id, key from k where key is not null and event_id is not null and created_at >= timestamp '2024-01-01' and created_at < timestamp '2025-01-01') select event_id, key from w where key in (select key from w group by key having count(*) <= 5)")
def l19(spark: SparkSession, d: str) -> DataFrame:
    e = load(spark, d, "journey_events").select("event_id", "created_at", F.explode("correlation_keys").alias("key")).filter("key is not null and event_id is not null")
    return graph.windowed(e, "created_at", "2024-01-01", "2025-01-01", 5)


@query("j11_named_variants", f"with {LOG}, {CASES}, v as (select variant, row_number() over (order by count(*) desc, variant) as n from cases group by 1) select case_id, v.n as n from cases join v using (variant) where v.n in (1, 3)")
def j11(spark: SparkSession, d: str) -> DataFrame:
    """Cases of variants by their names; a name that no variant has is an error."""
    cases = variants.with_variant(log_day(spark, d)).select("case_id", "variant")
    numbered = variants.numbered(cases.groupBy("variant").agg(F.count(F.lit(1)).alias("frequency")))
    return variants.by_names(cases, numbered, ["Variant_1", "Variant_3"]).select("case_id", "n")


# aggregations, order, sets


@query("a14_component_sets", "select journey_id, array_to_string(list_sort(list(distinct app_name)), ',') as apps, min(epoch_us(created_at)) as first_us from journey_events where journey_id is not null group by 1")
def a14(spark: SparkSession, d: str) -> DataFrame:
    e = load(spark, d, "journey_events").filter("journey_id is not null")
    return e.groupBy("journey_id").agg(F.array_join(F.array_sort(F.collect_set("app_name")), ",").alias("apps"), F.min(F.unix_micros(F.col("created_at").cast("timestamp"))).alias("first_us"))


@query("t1_ordered_page", "select event_id, ts_us from (select event_id, epoch_us(ts) as ts_us from events) order by ts_us, event_id limit 25")
def t1(spark: SparkSession, d: str) -> DataFrame:
    return load(spark, d, "events").select("event_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("ts_us")).orderBy("ts_us", "event_id").limit(25)


@query("t10_first_stages", f"with {LOG}, {CASES} select variant, array_to_string(string_split(variant, '->')[1:5], '->') as stages, count(*) as n from cases group by 1, 2")
def t10(spark: SparkSession, d: str) -> DataFrame:
    v = variants.with_variant(log_day(spark, d)).groupBy("variant").agg(F.count(F.lit(1)).alias("n"))
    return v.select("variant", F.array_join(F.slice(F.split("variant", "->"), 1, 5), "->").alias("stages"), "n")


@query("u2_union_all", "select activity, count(*) as n from (select activity from sample_logs union all select activity from sample_agent_logs) group by 1")
def u2(spark: SparkSession, d: str) -> DataFrame:
    return load(spark, d, "sample_logs").select("activity").unionByName(load(spark, d, "sample_agent_logs").select("activity")).groupBy("activity").agg(F.count(F.lit(1)).alias("n"))


@query("u5_distinct_activities", "select distinct activity from sample_agent_logs")
def u5(spark: SparkSession, d: str) -> DataFrame:
    return load(spark, d, "sample_agent_logs").select("activity").distinct()


@query("u7_shared_and_own_keys", "with k as (select app_name, list_sort(list(distinct split_part(k, '-', 1))) as ks from (select app_name, unnest(correlation_keys) as k from journey_events) where k is not null group by 1) select a.app_name as a, b.app_name as b, array_to_string(list_sort(list_intersect(a.ks, b.ks)), ',') as shared, array_to_string(list_sort(list_filter(a.ks, lambda x: not list_contains(b.ks, x))), ',') as own from k a join k b on a.app_name < b.app_name")
def u7(spark: SparkSession, d: str) -> DataFrame:
    """What key prefixes two applications share, and which only the first has."""
    e = load(spark, d, "journey_events").select("app_name", F.explode("correlation_keys").alias("k")).filter("k is not null")
    k = e.groupBy("app_name").agg(F.collect_set(F.split_part("k", F.lit("-"), F.lit(1))).alias("ks"))
    a, b = k.select(F.col("app_name").alias("a"), F.col("ks").alias("x")), k.select(F.col("app_name").alias("b"), F.col("ks").alias("y"))
    joined = lambda c: F.array_join(F.array_sort(c), ",")
    return a.join(b, F.col("a") < F.col("b")).select("a", "b", joined(F.array_intersect("x", "y")).alias("shared"), joined(F.array_except("x", "y")).alias("own"))


# scalar functions


@query("x1_strings", "select row_id, concat_ws('->', case_id, activity) as pair, trim(split_part(activity, ' ', 1)) as head, starts_with(lower(activity), 'form') as is_form, contains(lower(activity), 'app') as has_app, regexp_replace(resource, '[^a-z]', '', 'g') as letters from sample_logs")
def x1(spark: SparkSession, d: str) -> DataFrame:
    """Joining, splitting, case, containment and replacement."""
    a = F.lower("activity")
    return load(spark, d, "sample_logs").select("row_id", F.concat_ws("->", "case_id", "activity").alias("pair"), F.trim(F.split_part("activity", F.lit(" "), F.lit(1))).alias("head"), a.startswith("form").alias("is_form"), a.contains("app").alias("has_app"), F.regexp_replace("resource", "[^a-z]", "").alias("letters"))


@query("x9_math_and_maps", "select l_orderkey, l_linenumber, round(sqrt(l_extendedprice), 4) as root, least(l_quantity, 10) as low, greatest(l_discount, 0.05) as high, case l_returnflag when 'R' then 1 when 'A' then -1 end as flag from lineitem")
def x9(spark: SparkSession, d: str) -> DataFrame:
    """Arithmetic and a map of labels."""
    flags = F.create_map(F.lit("R"), F.lit(1), F.lit("A"), F.lit(-1))
    return load(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.round(F.sqrt("l_extendedprice"), 4).alias("root"), F.least("l_quantity", F.lit(10)).alias("low"), F.greatest("l_discount", F.lit(0.05)).alias("high"), flags[F.col("l_returnflag")].alias("flag"))


@query("x11_arrays", "select preferred_name, len(aliases) as n, list_has_any(aliases, ['dob', 'ccy']) as overlaps, aliases[1] as first_alias, array_to_string(list_append(aliases[1:2], preferred_name), ',') as three from dictionary_entries")
def x11(spark: SparkSession, d: str) -> DataFrame:
    return load(spark, d, "dictionary_entries").select("preferred_name", F.size("aliases").cast("long").alias("n"), F.arrays_overlap("aliases", F.array(F.lit("dob"), F.lit("ccy"))).alias("overlaps"), F.try_element_at("aliases", F.lit(1)).alias("first_alias"), F.array_join(F.array_append(F.slice("aliases", 1, 2), F.col("preferred_name")), ",").alias("three"))


@query("x12_milestone_maps", f"with {LOG} select case_id, min(us) filter (activity = 'view') as view_us, max(us) filter (activity = 'error') as error_us from log group by 1")
def x12(spark: SparkSession, d: str) -> DataFrame:
    """First times by activity in a map, last times in another, laid over each other."""
    each = log_day(spark, d).groupBy("case_id", "activity").agg(F.min("us").alias("a"), F.max("us").alias("b"))
    maps = each.groupBy("case_id").agg(F.map_from_entries(F.collect_list(F.struct(F.concat(F.lit("first "), "activity").alias("k"), F.col("a").alias("v")))).alias("x"), F.map_from_entries(F.collect_list(F.struct(F.concat(F.lit("last "), "activity").alias("k"), F.col("b").alias("v")))).alias("y"))
    every = maps.select("case_id", F.map_concat("x", "y").alias("m"))
    return every.select("case_id", F.try_element_at("m", F.lit("first view")).alias("view_us"), F.try_element_at("m", F.lit("last error")).alias("error_us"))


@query("x13_json_values", "select event_id, json_extract_string(payload, '$.app') as app, count(*) as n from journey_events where json_valid(payload) group by 1, 2")
def x13(spark: SparkSession, d: str) -> DataFrame:
    e = load(spark, d, "journey_events").select("event_id", F.try_parse_json("payload").alias("v")).filter("v is not null")
    return e.groupBy("event_id", F.try_variant_get("v", "$.app", "string").alias("app")).agg(F.count(F.lit(1)).alias("n"))


# graph


@query("g8_weighted_components", """with recursive k as (select o_custkey as c, l_partkey % 997 as p, count(*) as w from orders join lineitem on o_orderkey = l_orderkey group by 1, 2), s as (select 'c' || c as u, 'p' || p as v from k where w >= 2),
e as (select u as a, v as b from s union select v, u from s), cc(id, comp) using key (id) as (select distinct a, a from e union (select u.id, min(v.comp) from recurring.cc u join e on e.a = u.id join cc v on e.b = v.id where v.comp < u.comp group by u.id)) select id as event_id, comp as journey_id from cc""")
def g8(spark: SparkSession, d: str) -> DataFrame:
    """Customers and part classes linked by at least two line items."""
    o, li = load(spark, d, "orders"), load(spark, d, "lineitem")
    w = o.join(li, F.col("o_orderkey") == F.col("l_orderkey")).groupBy(F.concat(F.lit("c"), "o_custkey").alias("a"), F.concat(F.lit("p"), (F.col("l_partkey") % 997).cast("string")).alias("b")).agg(F.count(F.lit(1)).alias("weight"))
    return graph.weighted_stitch(w, 2)


# sinks and sources: what was written comes back


@query("s3_json_round_trip", "select row_id, case_id, len(coalesce(sub_activities, [])) as n_children from event_log")
def s3(spark: SparkSession, d: str) -> DataFrame:
    """S3, K3, K4."""
    at, log = f"{_place(spark)}-json", load(spark, d, "event_log").select("row_id", "case_id", "sub_activities")
    writers.write_json(log, at)
    back = spark.read.schema(log.schema).json(at)
    return back.select("row_id", "case_id", F.size(F.coalesce("sub_activities", F.array())).cast("long").alias("n_children"))


_LINKS = f"with {LOG}, {NEXT} select distinct activity as source, next_activity as target from nx where next_activity is not null"


def _text_file(spark: SparkSession, text: str, name: str) -> str:
    at = f"{_place(spark)}-{name}"
    spark.createDataFrame([(text,)], "value string").coalesce(1).write.option("lineSep", "\n").text(at)
    return at


@query("s4_bpmn_round_trip", _LINKS)
def s4(spark: SparkSession, d: str) -> DataFrame:
    """The directly-follows graph as BPMN, read again, without the start and end events."""
    edges = [(r.src, r.dst) for r in dfg.graph(log_day(spark, d)).select("src", "dst").collect()]
    at = _text_file(spark, writers.bpmn(edges), "bpmn")
    nodes, flows = readers.read_bpmn(spark, at)
    tasks = nodes.filter("type = 'task'").select("id")
    return flows.join(tasks.withColumnRenamed("id", "source"), "source").join(tasks.withColumnRenamed("id", "target"), "target").select("source", "target")


@query("s4_bpmn_parameters", "select 'Task_1' as id, 'input' as direction, 'amount' as name, '${total}' as value union all select 'Task_1', 'input', 'who', null union all select 'Task_2', 'output', 'score', '7'")
def s4b(spark: SparkSession, d: str) -> DataFrame:
    """The input and output parameters of a model's tasks."""
    field = lambda kind, name, value="": f"<camunda:{kind}Parameter name={quoteattr(name)}>{value}</camunda:{kind}Parameter>"
    task = lambda i, body: f'<bpmn:task id="Task_{i}"><bpmn:extensionElements><camunda:inputOutput>{body}</camunda:inputOutput></bpmn:extensionElements></bpmn:task>'
    head = '<bpmn:definitions xmlns:bpmn="http://www.omg.org/spec/BPMN/20100524/MODEL" xmlns:camunda="http://camunda.org/schema/1.0/bpmn"><bpmn:process id="p">'
    text = head + task(1, field("input", "amount", "${total}") + field("input", "who")) + task(2, field("output", "score", "7")) + "</bpmn:process></bpmn:definitions>"
    return readers.read_bpmn_parameters(spark, _text_file(spark, text, "bpmn-parameters"))


@query("s5_pnml_round_trip", "select 'p_click_purchase' as source, 'purchase' as target union all select 'click', 'p_click_purchase' union all select 'initial', 'view' union all select 'p_view_click', 'click' union all select 'purchase', 'final' union all select 'view', 'p_view_click'")
def s5(spark: SparkSession, d: str) -> DataFrame:
    """A net as PNML, read again."""
    return readers.read_pnml(spark, _text_file(spark, writers.pnml(MODEL), "pnml"))[2]


@query("s7_edge_tables", "with k as (select event_id, unnest(correlation_keys) as k from journey_events) select distinct 'Event' as src_label, event_id as src, 'HAS_KEY' as label, 'Key' as dst_label, k as dst from k where k is not null and event_id is not null")
def s7(spark: SparkSession, d: str) -> DataFrame:
    """The edge table that a graph store's scan gives, here from files in the layout of its export."""
    e = load(spark, d, "journey_events").select("event_id", F.explode("correlation_keys").alias("k")).filter("k is not null and event_id is not null").distinct()
    at = f"{_place(spark)}-edges"
    e.select(F.struct(F.lit("Event").alias("label"), F.col("event_id").alias("id")).alias("start"), F.lit("HAS_KEY").alias("type"), F.struct(F.lit("Key").alias("label"), F.col("k").alias("id")).alias("end")).write.json(at)
    return readers.read_edges(spark, "json", {"path": at})


# table maintenance and jobs


@query("k15_staged_load", "select activity, count(*) as n from sample_logs where row_id % 3 = 0 or case_id is not null group by 1")
def k15(spark: SparkSession, d: str) -> DataFrame:
    """Two staged batches are moved to the main table, only rows with a case of the second; staging is emptied."""
    main, staging, s = f"{_place(spark)}-main", f"{_place(spark)}-staging", load(spark, d, "sample_logs").select("row_id", "case_id", "activity")
    s.filter("row_id % 3 = 0").write.parquet(staging)
    jobs.move_staged(spark, staging, main)
    s.filter("row_id % 3 <> 0").write.mode("overwrite").parquet(staging)
    jobs.move_staged(spark, staging, main, "case_id is not null")
    if not spark.read.parquet(staging).isEmpty():
        raise RuntimeError("staging is not empty")
    return spark.read.parquet(main).groupBy("activity").agg(F.count(F.lit(1)).alias("n"))


@query("k19_stored_tables", f"with {LOG}, {CASES} select variant, count(*) as n from cases group by 1")
def k19(spark: SparkSession, d: str) -> DataFrame:
    """Logs and variants by name in a store; the last value of a name counts."""
    store = jobs.Store(spark, f"{_place(spark)}-store")
    store.put("variants", load(spark, d, "region"))
    store.put("variants", variants.with_variant(log_day(spark, d)).groupBy("variant").agg(F.count(F.lit(1)).alias("n")))
    return store.get("variants")


@query("m5_use_case_job", f"with {LOG}, {CASES} select case_id, variant from cases where variant like '%signup%' and variant like '%purchase%'")
def m5(spark: SparkSession, d: str) -> DataFrame:
    """Load, keep completed cases, take their variants, append what is new; run twice, the second adds nothing."""
    at = f"{_place(spark)}-job"
    job = {"starts": ["signup"], "finishes": ["purchase"], "target": at}
    for _ in range(2):
        jobs.run_use_case(log_day(spark, d), job)
    return spark.read.parquet(at).select("case_id", "variant")


@query("m7_state_changes", "select row_id, case when status = 'failed' then 'open' else coalesce(status, 'unknown') end as state from sample_agent_logs")
def m7(spark: SparkSession, d: str) -> DataFrame:
    return jobs.with_states(load(spark, d, "sample_agent_logs"), "status", {"failed": "open"}, "unknown").select("row_id", F.col("status").alias("state"))


# variants, nets


@query("v5_variant_objects", f"with {LOG}, {CASES} select variant, count(*) as n, max(n) as length, len(list_distinct(string_split(variant, '->'))) as n_activities, round(100 * count(*) / (select count(*) from cases), 2) as pct, -1 as cluster_id from cases group by 1")
def v5(spark: SparkSession, d: str) -> DataFrame:
    return variants.objects(variants.variants(log_day(spark, d)))


@query("v6_sub_variants", f"with {LOG}, x as (select case_id, activity, us, event_id, case when activity in ('click', 'view') then 's' else 'c' end as k from log), s as (select case_id, coalesce(string_agg(activity, '->' order by us, event_id) filter (k = 'c'), '') as variant, string_agg(activity || '+' || k, '->' order by us, event_id) as sub_variant from x group by 1) select variant, sub_variant, count(*) as frequency from s group by 1, 2")
def v6(spark: SparkSession, d: str) -> DataFrame:
    log = log_day(spark, d).withColumn("lifecycle", F.when(F.col("activity").isin("click", "view"), "start").otherwise("complete"))
    return variants.sub_variants(log)


@query("v7_log_properties", f"with {LOG}, {CASES} select (select count(*) from log) as n_events, count(*) as n_cases, count(distinct variant) as n_variants, (select count(distinct activity) from log) as n_activities, (select min(us) from log) as start_us, (select max(us) from log) as end_us, max(n) as longest, avg(n) as avg_length from cases")
def v7(spark: SparkSession, d: str) -> DataFrame:
    return variants.properties(log_day(spark, d))


@query("v8_custom_variant", f"with {LOG}, {CASES}, x as (select variant from cases union all select 'view->view->view->signup') select variant, count(*) as n from x group by 1")
def v8(spark: SparkSession, d: str) -> DataFrame:
    log = variants.with_custom(log_day(spark, d), "custom", ["view", "view", "view", "signup"])
    return variants.with_variant(log).groupBy("variant").agg(F.count(F.lit(1)).alias("n"))


@query("v12_linear_extensions", "select 'a->b->c' as extension union all select 'a->c->b'")
def v12(spark: SparkSession, d: str) -> DataFrame:
    return spark.createDataFrame([(x,) for x in variants.linear_extensions("a->(b|c)", 10)], "extension string")


@query("v13_fitting_split", f"with {LOG}, {CASES} select variant = 'view->click->purchase' as fits, count(distinct variant) as n_variants, count(*) as n_cases from cases group by 1")
def v13(spark: SparkSession, d: str) -> DataFrame:
    """The variants that the model replays perfectly, and those by which it would have to grow."""
    cases = variants.with_variant(log_day(spark, d)).select("case_id", "variant")
    fits = conformance.log_conformance(cases, MODEL).select("variant", (~F.col("anomaly")).alias("fits"))
    return fits.groupBy("fits").agg(F.count_distinct("variant").alias("n_variants"), F.count(F.lit(1)).alias("n_cases"))


@query("v13_grown_tree", f"with {LOG}, {CASES}, v as (select variant, count(*) as n from cases group by 1 order by n desc, variant limit 12) select variant, n, true as fits from v")
def v13b(spark: SparkSession, d: str) -> DataFrame:
    """The twelve most frequent variants under a tree that was extended by those that did not fit."""
    top = variants.top(variants.variants(log_day(spark, d)).select("variant", F.col("frequency")), 12).collect()
    tree = conformance.extended_tree("->(view, click, purchase)", [r.variant.split("->") for r in top])
    scored = conformance.variant_conformance(spark.createDataFrame([(r.variant, r.frequency) for r in top], "variant string, n bigint"), conformance.net_from_tree(tree))
    counts = spark.createDataFrame([(r.variant, r.frequency) for r in top], "variant string, n bigint")
    return counts.join(scored, "variant").select("variant", "n", (F.col("cost") == 0).alias("fits"))


@query("v14_tree_rows", "select * from (values (0, null, '->', false), (1, 0, 'a', false), (2, 0, 'X', true), (3, 2, 'b', true), (4, 2, 'c', true)) t(node, parent, label, frozen)")
def v14(spark: SparkSession, d: str) -> DataFrame:
    rows = conformance.tree_rows("->(a, X(b, c))", ["X(b, c)"])
    if conformance.tree_from_rows(rows) != ("->(a, X(b, c))", ["X(b, c)"]):
        raise RuntimeError("the tree does not come back")
    return spark.createDataFrame([(r["node"], r["parent"], r["label"], r["frozen"]) for r in rows], "node int, parent int, label string, frozen boolean")


@query("d15_repaired_net", f"with {LOG} select distinct activity as transition from log")
def d15(spark: SparkSession, d: str) -> DataFrame:
    """The model with a transition for each activity of the log; a net that isn't sound is an error."""
    activities = [r[0] for r in log_day(spark, d).select("activity").distinct().collect()]
    if not conformance.is_sound(MODEL):
        raise RuntimeError("the model is not sound")
    return spark.createDataFrame([(x,) for x in sorted(conformance.repaired(MODEL, activities).labels())], "transition string")


@query("d13_tree_net", "select 'fits' as kind, 2 as n union all select 'fits not', 2")
def d13(spark: SparkSession, d: str) -> DataFrame:
    """A process tree as a net: a, then b and c in either order or d, then e again and again."""
    net = conformance.net_from_tree("->(a, X(+(b, c), d), *(e, tau))")
    traces = ["abce", "adee", "abe", "abcd"]
    fits = [conformance.align(net, list(t)) == 0 for t in traces]
    return spark.createDataFrame([("fits", sum(fits)), ("fits not", len(fits) - sum(fits))], "kind string, n int")


@query("a22_rolled_up", "select 'root' as node, (2 * 1.0 + 6 * 0.5 + 2 * 0.25) / 10 as value union all select 'left', (2 * 1.0 + 6 * 0.5) / 8 union all select 'a', 1.0 union all select 'b', 0.5 union all select 'c', 0.25")
def a22(spark: SparkSession, d: str) -> DataFrame:
    rows = [("root", None, None, None), ("left", "root", None, None), ("a", "left", 1.0, 2), ("b", "left", 0.5, 6), ("c", "root", 0.25, 2), ("d", "root", None, 3)]
    tree = spark.createDataFrame(rows, "node string, parent string, value double, n int")
    return spark.createDataFrame(sorted(conformance.rolled_up(tree).items()), "node string, value double")


@query("d9_orders_without_cycles", """with recursive e as (select distinct 'o:' || o_orderstatus || o_orderpriority[1:1] as src, 'r:' || l_returnflag as dst from orders join lineitem on o_orderkey = l_orderkey
  union select 'r:' || l_returnflag, 's:' || l_linestatus from lineitem union select 's:' || l_linestatus, 'r:' || l_returnflag from lineitem where l_quantity > 49 union select 's:' || l_linestatus, 'd:' || l_discount from lineitem),
r as (select src, dst from e union select r.src, e.dst from r join e on r.dst = e.src)
select e.src, e.dst from e where not exists (select 1 from r where r.src = e.dst and r.dst = e.src) and e.src <> e.dst""")
def d9(spark: SparkSession, d: str) -> DataFrame:
    """D9 on a graph with acyclic edges beside a cycle: order kinds, return flags, line states, discounts."""
    o, li = load(spark, d, "orders"), load(spark, d, "lineitem")
    node = lambda kind, *c: F.concat(F.lit(f"{kind}:"), *c)
    flag, state = node("r", F.col("l_returnflag")), node("s", F.col("l_linestatus"))
    edges = o.join(li, F.col("o_orderkey") == F.col("l_orderkey")).select(node("o", F.col("o_orderstatus"), F.substring("o_orderpriority", 1, 1)).alias("src"), flag.alias("dst"))
    for part in (li.select(flag, state), li.filter("l_quantity > 49").select(state, flag), li.select(state, node("d", F.col("l_discount").cast("string")))):
        edges = edges.union(part)
    rows = edges.distinct().collect()  # kinds, flags, states and discounts: a bounded alphabet
    return spark.createDataFrame(sorted(conformance.without_cycles((r.src, r.dst) for r in rows)), "src string, dst string")


def _order_edges(spark: SparkSession, d: str) -> DataFrame:
    """Order kinds before return flags before line states, these two also the other way round for large quantities."""
    o, li = load(spark, d, "orders"), load(spark, d, "lineitem")
    flag, state = F.concat(F.lit("r:"), "l_returnflag"), F.concat(F.lit("s:"), "l_linestatus")
    kinds = o.join(li, F.col("o_orderkey") == F.col("l_orderkey")).select(F.concat(F.lit("o:"), "o_orderstatus").alias("src"), flag.alias("dst"))
    return kinds.union(li.select(flag, state)).union(li.filter("l_quantity > 49 and l_returnflag = 'N'").select(state, flag)).distinct()


_ORDER_EDGES = """e as (select distinct 'o:' || o_orderstatus as src, 'r:' || l_returnflag as dst from orders join lineitem on o_orderkey = l_orderkey union select 'r:' || l_returnflag, 's:' || l_linestatus from lineitem
  union select 's:' || l_linestatus, 'r:' || l_returnflag from lineitem where l_quantity > 49 and l_returnflag = 'N')"""


@query("d10_one_way_edges", f"with {_ORDER_EDGES} select * from e where not exists (select 1 from e b where b.src = e.dst and b.dst = e.src)")
def d10(spark: SparkSession, d: str) -> DataFrame:
    return dfg.without_reversed(_order_edges(spark, d))


@query("d2_alpha_places", f"""with {_ORDER_EDGES}, c as (select * from e where not exists (select 1 from e b where b.src = e.dst and b.dst = e.src)) select count(distinct src || dst) as n_causal, (select count(*) from e) as n_edges from c""")
def d2(spark: SparkSession, d: str) -> DataFrame:
    """Every causal pair is in some place of the alpha net, and no place holds another pair."""
    edges = cut(_order_edges(spark, d))
    rows = dfg.footprint(edges).collect()  # a bounded alphabet
    relations = {(r.src, r.dst): r.relation for r in rows}
    pairs = conformance.alpha_pairs(relations, sorted({a for p in relations for a in p}))
    held = {(x, y) for a, b in pairs for x in a for y in b}
    return spark.createDataFrame([(len(held), edges.count())], "n_causal bigint, n_edges bigint")


@query("d5_trace_orders", f"with {LOG}, {NEXT} select case_id, activity as src, next_activity as dst, us as src_us from nx where next_activity is not null")
def d5(spark: SparkSession, d: str) -> DataFrame:
    """The edges of every trace's own order."""
    return logs.with_next(log_day(spark, d)).filter("next_activity is not null").select("case_id", F.col("activity").alias("src"), F.col("next_activity").alias("dst"), F.col("us").alias("src_us"))


@query("d7_pairwise_orders")
def d7(spark: SparkSession, d: str) -> DataFrame:
    """The orders of the ten most frequent variants, merged one after another."""
    top = variants.top(variants.variants(chat_like(spark, d)).select("variant", "frequency"), 10).collect()
    orders = [list(zip(v.variant.split("->"), v.variant.split("->")[1:])) for v in top]
    return spark.createDataFrame(sorted(conformance.merged_pairwise([[e for e in o if e[0] != e[1]] for o in orders])), "src string, dst string")


# generators: what they promise


def _truth(spark: SparkSession, events: DataFrame) -> DataFrame:
    found = graph.stitch(graph.key_edges(events))
    j = found.join(events.select("event_id", "truth"), "event_id")
    return j.groupBy("truth").agg(F.count_distinct("journey_id").alias("n_journeys"), F.count(F.lit(1)).alias("n_events"))


@query("n1_chained_journeys", "select range as truth, 1 as n_journeys, 12 as n_events from range(40)")
def n1(spark: SparkSession, d: str) -> DataFrame:
    return _truth(spark, generators.chained_journeys(spark, 40, 12))


@query("n2_long_chains", "select range as truth, 1 as n_journeys, 300 as n_events from range(3)")
def n2(spark: SparkSession, d: str) -> DataFrame:
    return _truth(spark, generators.chained_journeys(spark, 3, 300, False))


@query("n3_bridged_journeys", "select range as truth, 1 as n_journeys, 3 as n_events from range(50)")
def n3(spark: SparkSession, d: str) -> DataFrame:
    return _truth(spark, generators.bridged_journeys(spark, 50))


@query("n4_app_chains", "select range as truth, 1 as n_journeys, 8 as n_events from range(30)")
def n4(spark: SparkSession, d: str) -> DataFrame:
    return _truth(spark, generators.app_chains(spark, 30, 8))


@query("n5_process_log", "select activity, n from (values ('Open', 500), ('Scan_Start', 500), ('Review', 500), ('Check', 500), ('Scan_End', 500), ('Close', 500)) t(activity, n)")
def n5(spark: SparkSession, d: str) -> DataFrame:
    """What every case has."""
    g = generators.process_log(spark, 500).filter("activity not in ('Rework', 'Failure')")
    return g.groupBy("activity").agg(F.count(F.lit(1)).alias("n"))


@query("n6_hierarchical_log", "select level_1, n from (values ('L1_0', 300), ('L1_1', 300), ('L1_2', 300)) t(level_1, n)")
def n6(spark: SparkSession, d: str) -> DataFrame:
    return generators.hierarchical_log(spark, 100).groupBy("level_1").agg(F.count(F.lit(1)).alias("n"))


@query("n9_filled_templates", "select range as id, 'case ' || range || ' by ' || case when range % 2 = 0 then 'ann' else 'bob' end as text from range(20)")
def n9(spark: SparkSession, d: str) -> DataFrame:
    values = {"id": F.col("id").cast("string"), "who": F.when(F.col("id") % 2 == 0, "ann").otherwise("bob")}
    return generators.filled(spark.range(20), "case {id} by {who}", values).select("id", "text")


@query("n10_cases_with_outliers", "select true as is_outlier, 20 as n union all select false, 980")
def n10(spark: SparkSession, d: str) -> DataFrame:
    return generators.cases_with_outliers(spark, 1000).groupBy("is_outlier").agg(F.count(F.lit(1)).alias("n"))


# placement of data-fetching steps in a small process graph

_GRAPH = {"start": ["check"], "check": ["left", "right"], "left": ["join"], "right": ["join"], "join": ["end"], "end": []}
_MODS = [bpmn.mod("customer", ["id"], ["name", "segment"]), bpmn.mod("score", ["segment"], ["risk"]), bpmn.mod("rate", ["risk"], ["price"]), bpmn.mod("mail", ["name"], ["sent"])]
_NEEDS = {"left": {"risk"}, "right": {"risk", "sent"}, "end": {"price"}}


@query("b1_ordered_mods", "select * from (values (1, 'customer'), (2, 'score'), (3, 'rate'), (4, 'mail')) t(n, mod)")
def b1(spark: SparkSession, d: str) -> DataFrame:
    """B1, B2: an order in which every input exists."""
    return spark.createDataFrame([(i, m) for i, m in enumerate(bpmn.ordered(_MODS, {"id"}), 1)], "n int, mod string")


@query("b3_required_mods", "select * from (values (1, 'customer'), (2, 'score'), (3, 'rate')) t(n, mod)")
def b3(spark: SparkSession, d: str) -> DataFrame:
    """What a price needs, directly and indirectly."""
    return spark.createDataFrame([(i, m) for i, m in enumerate(bpmn.required({"price"}, _MODS, {"id"}), 1)], "n int, mod string")


@query("b4_nodes_below", "select * from (values ('check'), ('left'), ('right'), ('join'), ('end')) t(node)")
def b4(spark: SparkSession, d: str) -> DataFrame:
    return spark.createDataFrame([(x,) for x in sorted(bpmn.below(_GRAPH, "check"))], "node string")


@query("b5_branch_aware", "select * from (values ('customer', 'check'), ('score', 'check'), ('rate', 'check'), ('mail', 'right')) t(mod, before)")
def b5(spark: SparkSession, d: str) -> DataFrame:
    """What both branches need comes once before the split."""
    return spark.createDataFrame(bpmn.branch_aware(_GRAPH, "start", {"check"}, _NEEDS, _MODS, {"id"}), "mod string, before string")


@query("b6_common_ancestors", "select * from (values ('left,right', 'check'), ('end,left', 'left'), ('end', 'join')) t(nodes, ancestor)")
def b6(spark: SparkSession, d: str) -> DataFrame:
    asked = [["left", "right"], ["end", "left"], ["end"]]
    return spark.createDataFrame([(",".join(n), bpmn.common_ancestor(_GRAPH, "start", n)) for n in asked], "nodes string, ancestor string")


@query("b7_simple_paths", "select * from (values ('start>check>left>join>end'), ('start>check>right>join>end')) t(path)")
def b7(spark: SparkSession, d: str) -> DataFrame:
    return spark.createDataFrame([(">".join(p),) for p in bpmn.simple_paths(_GRAPH, "start", "end")], "path string")


@query("b8_nca_placement", "select 0 as errors, 4 as placed")
def b8(spark: SparkSession, d: str) -> DataFrame:
    """Every step is placed once, and none before its inputs."""
    placed = bpmn.nca_placement(_GRAPH, "start", _NEEDS, _MODS, {"id"})
    errors = bpmn.placement_errors(_GRAPH, "start", placed, _MODS, {"id"})
    return spark.createDataFrame([(len(errors), len(placed))], "errors int, placed int")
