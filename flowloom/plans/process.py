"""Queries over event logs: filters, variants, sequences and directly-follows graphs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from flowloom.operators import dfg, logs, variants
from flowloom.plans.views import CASES, LOG, NEXT, log_day
from flowloom.session import load

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return add


@query("v1_variants", f"with {LOG}, {CASES} select variant, count(*) as frequency, max(n) as length, cast(median(d) as double) as median_us, min(d) as min_us, max(d) as max_us, round(100 * count(*) / (select count(*) from cases), 2) as pct from cases group by variant")
def v1_variants(spark: SparkSession, d: str) -> DataFrame:
    return variants.variants(log_day(spark, d))


@query("t3_top_variants", f"with {LOG}, {CASES} select variant, count(*) as frequency from cases group by variant order by frequency desc, variant limit 10")
def t3(spark: SparkSession, d: str) -> DataFrame:
    return variants.top(variants.variants(log_day(spark, d)).select("variant", "frequency"), 10)


@query("w5_numbered_variants", f"with {LOG}, {CASES}, v as (select variant, count(*) as frequency from cases group by variant) select variant, frequency, row_number() over (order by frequency desc, variant) as n, 'Variant_' || row_number() over (order by frequency desc, variant) as name from v")
def w5(spark: SparkSession, d: str) -> DataFrame:
    return variants.numbered(variants.with_variant(log_day(spark, d)).groupBy("variant").agg(F.count(F.lit(1)).alias("frequency")))


@query("t4_extreme_variants", f"with {LOG}, {CASES}, v as (select variant, count(*) as f from cases group by variant) select arg_max(variant, (f, variant)) as most_common, arg_min(variant, (f, variant)) as least_common from v")
def t4(spark: SparkSession, d: str) -> DataFrame:
    v = variants.with_variant(log_day(spark, d)).groupBy("variant").agg(F.count(F.lit(1)).alias("f"))
    return v.agg(F.max_by("variant", F.struct("f", "variant")).alias("most_common"), F.min_by("variant", F.struct("f", "variant")).alias("least_common"))


@query("l9_frequent_variant_cases", f"with {LOG}, {CASES} select case_id, variant from cases where variant in (select variant from cases group by variant having count(*) >= 5)")
def l9(spark: SparkSession, d: str) -> DataFrame:
    return variants.frequent_only(log_day(spark, d), 5)


@query("l10_events_of_variants", f"with {LOG}, {CASES} select case_id, event_id, activity from log where case_id in (select case_id from cases where variant in ('click->view', 'view->click'))")
def l10(spark: SparkSession, d: str) -> DataFrame:
    chosen = spark.createDataFrame([("click->view",), ("view->click",)], "variant string")
    return variants.of_variants(log_day(spark, d), chosen).select("case_id", "event_id", "activity")


_W9 = """with recursive {log}, {cases}, s as (select case_id, string_split(variant, '->') as a from cases),
w(case_id, a, i, out) as (
  select case_id, a, 1, cast([] as varchar[]) from s
  union all
  select case_id, a, case when i < len(a) and a[i] <> a[i + 1] then i + 2 else i + 1 end,
    list_append(out, case when i < len(a) and a[i] <> a[i + 1] then a[i] || '||' || a[i + 1] else a[i] end)
  from w where i <= len(a))
"""
_W10 = """, m(case_id, a, i, out) as (
  select case_id, out, 1, cast([] as varchar[]) from w where i > len(a)
  union all
  select case_id, a, i + 1, case when list_contains(a[1:i - 1], a[i]) then
      list_append(out[1:len(out) - 1], case when out[len(out)][-1:] = '*' then out[len(out)] else out[len(out)] || '*' end)
    else list_append(out, a[i]) end
  from m where i <= len(a))
"""


@query("v10_reduced_variants", _W9.format(log=LOG, cases=CASES) + _W10 + "select '[' || array_to_string(out, '->') || ']' as reduced, count(*) as frequency from m where i > len(a) group by 1")
def v10(spark: SparkSession, d: str) -> DataFrame:
    return variants.reduced(log_day(spark, d))


@query("w9_merged_neighbours", _W9.format(log=LOG, cases=CASES) + "select case_id, array_to_string(out, '->') as merged from w where i > len(a)")
def w9(spark: SparkSession, d: str) -> DataFrame:
    return variants.traces(log_day(spark, d)).select("case_id", F.array_join(variants.merge_neighbours(F.col("activities")), "->").alias("merged"))


@query("v4_collapsed_variants", f"""with {LOG}, r as (select *, sum(f) over (partition by case_id order by us, event_id) as run from (
  select *, case when lag(activity) over w = activity then 0 else 1 end as f from log window w as (partition by case_id order by us, event_id))),
g as (select case_id, run, min(activity) || case when count(*) > 1 then '+' else '' end as x from r group by case_id, run),
s as (select case_id, string_agg(x, '->' order by run) as collapsed from g group by case_id)
select collapsed, count(*) as frequency from s group by collapsed""")
def v4(spark: SparkSession, d: str) -> DataFrame:
    return variants.collapsed(log_day(spark, d))


@query("v3_concurrency_variants", f"""with {LOG}, s as (select case_id, us // 3600000000 as slot, count(*) as n, string_agg(activity, '|' order by activity) as a from log group by 1, 2),
c as (select case_id, string_agg(case when n > 1 then '(' || a || ')' else a end, '->' order by slot) as concurrency_variant from s group by case_id)
select concurrency_variant, count(*) as frequency from c group by 1""")
def v3(spark: SparkSession, d: str) -> DataFrame:
    return variants.concurrency(log_day(spark, d), 3_600_000_000)


@query("v16_compare_variants", "select 'click' as only_a, 'signup' as only_b")
def v16(spark: SparkSession, d: str) -> DataFrame:
    return variants.compare(variants.variants(log_day(spark, d)).select("variant"), "click->view", "view->signup")


@query("v16_compare_frequent", f"""with {LOG}, {CASES}, v as (select variant, row_number() over (order by count(*) desc, variant) as n from cases group by 1), x as (select list_distinct(string_split(variant, '->')) as x from v where n = 1), y as (select list_distinct(string_split(variant, '->')) as y from v where n = 20)
select array_to_string(list_sort(list_filter(x, lambda i: not list_contains(y, i))), ',') as only_a, array_to_string(list_sort(list_filter(y, lambda i: not list_contains(x, i))), ',') as only_b from x, y""")
def v16c(spark: SparkSession, d: str) -> DataFrame:
    """The most frequent variant against the twentieth."""
    numbered = variants.numbered(variants.with_variant(log_day(spark, d)).groupBy("variant").agg(F.count(F.lit(1)).alias("frequency")))
    names = {r.n: r.variant for r in numbered.filter("n in (1, 20)").collect()}
    return variants.compare(numbered, names.get(1), names.get(20))


@query("v16_activity_index", f"with {LOG}, {CASES}, x as (select distinct case_id, activity from log) select activity, count(distinct variant) as n_variants, count(*) as n_cases from x join cases using (case_id) group by activity")
def v16b(spark: SparkSession, d: str) -> DataFrame:
    return variants.activity_index(log_day(spark, d))


@query("d1_dfg", f"with {LOG}, {NEXT} select activity as src, next_activity as dst, count(*) as frequency, avg(next_us - us) as avg_us, min(next_us - us) as min_us, max(next_us - us) as max_us from nx where next_activity is not null group by 1, 2")
def d1(spark: SparkSession, d: str) -> DataFrame:
    return dfg.graph(log_day(spark, d))


_DFG = f"with {LOG}, {NEXT}, g as (select activity as src, next_activity as dst, count(*) as frequency from nx where next_activity is not null group by 1, 2)"


@query("d4_heuristics", _DFG + " select a.src, a.dst, a.frequency, case when a.src = a.dst then a.frequency / (a.frequency + 1) else (a.frequency - coalesce(b.frequency, 0)) / (a.frequency + coalesce(b.frequency, 0) + 1) end as dependency from g a left join g b on a.src = b.dst and a.dst = b.src")
def d4(spark: SparkSession, d: str) -> DataFrame:
    return dfg.heuristics(dfg.graph(log_day(spark, d)))


@query("d2_footprint", _DFG + """, p as (select src, dst from g union select dst, src from g)
select p.src, p.dst, case when a.src is not null and b.src is not null then '||' when a.src is not null then '->' else '<-' end as relation
from p left join g a on a.src = p.src and a.dst = p.dst left join g b on b.src = p.dst and b.dst = p.src""")
def d2(spark: SparkSession, d: str) -> DataFrame:
    return dfg.footprint(dfg.graph(log_day(spark, d)))


def chat_like(spark: SparkSession, d: str) -> DataFrame:
    """Orders as a log: a case an order, its lines' status by ship date."""
    l = load(spark, d, "lineitem")
    one = l.groupBy("l_orderkey", "l_shipdate").agg(F.min(F.concat("l_returnflag", "l_linestatus")).alias("activity"))
    return one.select(F.col("l_orderkey").alias("case_id"), "activity", F.lit(0).alias("event_id"), F.unix_date(F.col("l_shipdate").cast("date")).cast("bigint").alias("us"))


ORDERS = "log as (select l_orderkey as case_id, min(l_returnflag || l_linestatus) as activity, 0 as event_id, date_diff('day', date '1970-01-01', cast(l_shipdate as date)) as us from lineitem group by l_orderkey, l_shipdate)"
_EDGES = f"with {ORDERS}, {NEXT}, e as (select distinct activity as src, next_activity as dst from nx where next_activity <> activity)"


@query("d8_partial_order", _EDGES + " select * from e")
def d8(spark: SparkSession, d: str) -> DataFrame:
    return dfg.partial_order_edges(chat_like(spark, d))


@query("d10_without_reversed", _EDGES + " select * from e where not exists (select 1 from e b where b.src = e.dst and b.dst = e.src)")
def d10(spark: SparkSession, d: str) -> DataFrame:
    return dfg.without_reversed(dfg.partial_order_edges(chat_like(spark, d)))


@query("d11_petri_arcs", _EDGES + """, t as (select src, 'p_' || src || '_' || dst as p, dst from e)
select src as source, p as target from t union all select p, dst from t
union all select distinct 'initial', src from e where src not in (select dst from e)
union all select distinct dst, 'final' from e where dst not in (select src from e)""")
def d11(spark: SparkSession, d: str) -> DataFrame:
    return dfg.petri_arcs(dfg.partial_order_edges(chat_like(spark, d)))


@query("m6_diagram_nodes", f"with {LOG}, {CASES}, n as (select activity, count(*) as n_events, count(distinct case_id) as n_cases from log group by 1) select activity, n_events, n_cases, (select count(*) from cases where first_activity = activity) as n_starts, (select count(*) from cases where last_activity = activity) as n_ends from n")
def m6(spark: SparkSession, d: str) -> DataFrame:
    return dfg.diagram(log_day(spark, d))


@query("c6_missing_activities", f"with {LOG} select distinct activity from log where activity not in ('click', 'view')")
def c6(spark: SparkSession, d: str) -> DataFrame:
    return dfg.missing_activities(log_day(spark, d), spark.createDataFrame([("click",), ("view",)], "activity string"))


@query("l4_ignored_activities", f"with {LOG} select case_id, event_id, activity from log where activity not in ('view', 'error')")
def l4(spark: SparkSession, d: str) -> DataFrame:
    return logs.without_activities(log_day(spark, d), ["view", "error"]).select("case_id", "event_id", "activity")


@query("l5_cases_by_ends", f"with {LOG}, {CASES} select case_id, event_id from log where case_id in (select case_id from cases where first_activity = 'view' and last_activity in ('purchase', 'click'))")
def l5(spark: SparkSession, d: str) -> DataFrame:
    return logs.cases_by_ends(log_day(spark, d), ["view"], ["purchase", "click"]).select("case_id", "event_id")


@query("l6_eventually_follows", f"with {LOG}, p as (select case_id, min((us, event_id)) filter (activity = 'view') as x, max((us, event_id)) filter (activity = 'purchase') as y from log group by 1) select case_id, event_id from log where case_id in (select case_id from p where x < y)")
def l6(spark: SparkSession, d: str) -> DataFrame:
    return logs.cases_eventually(log_day(spark, d), "view", "purchase").select("case_id", "event_id")


@query("l7_directly_follows", f"with {LOG}, {NEXT} select case_id, event_id from log where case_id in (select case_id from nx where activity = 'click' and next_activity = 'view')")
def l7(spark: SparkSession, d: str) -> DataFrame:
    return logs.cases_directly(log_day(spark, d), "click", "view").select("case_id", "event_id")


@query("l11_completed_cases", f"with {LOG} select case_id from log group by 1 having bool_or(activity = 'signup') and bool_or(activity = 'purchase')")
def l11(spark: SparkSession, d: str) -> DataFrame:
    return logs.completed_cases(log_day(spark, d), ["signup"], ["purchase"])


@query("l12_criteria", "select row_id, agent_name from sample_agent_logs where status = 'failed' and tool_used = 'unit_runner'")
def l12(spark: SparkSession, d: str) -> DataFrame:
    return logs.matching(load(spark, d, "sample_agent_logs"), {"status": "failed", "tool_used": "unit_runner", "site": "all"}).select("row_id", "agent_name")


@query("l13_variant_rules", f"with {LOG}, {CASES}, v as (select case_id, string_split(variant, '->') as a, variant from cases) select case_id from v where (contains(lower(a[1]), 'view') and contains(lower(a[len(a)]), 'purch')) or variant like '%click->error%'")
def l13(spark: SparkSession, d: str) -> DataFrame:
    rules = [[("starts_with", "View"), ("ends_with", "purch")], [("directly_follows", "click -> error")]]
    return variants.traces(log_day(spark, d)).filter(logs.variant_rules(rules, F.col("activities"))).select("case_id")


@query("l15_autosuggest", "select distinct activity from sample_logs where contains(lower(activity), 'form')")
def l15(spark: SparkSession, d: str) -> DataFrame:
    return load(spark, d, "sample_logs").filter(F.contains(F.lower("activity"), F.lit("form"))).select("activity").distinct()


@query("a3_case_durations", f"with {LOG} select case_id, count(*) as n_events, max(us) - min(us) as duration_us from log group by 1")
def a3(spark: SparkSession, d: str) -> DataFrame:
    return logs.duration_stats(log_day(spark, d))


@query("w3_case_ends", f"with {LOG}, {CASES} select case_id, first_activity, last_activity from cases")
def w3(spark: SparkSession, d: str) -> DataFrame:
    return logs.ends(log_day(spark, d))


@query("w14_milestones", f"with {LOG} select case_id, event_id, coalesce(min(case when activity = 'click' then us end) over w, -1) as first_us, coalesce(max(case when activity = 'click' then us end) over w, -1) as last_us, count(case when activity = 'click' then 1 end) over w as n_seen from log window w as (partition by case_id order by us, event_id)")
def w14(spark: SparkSession, d: str) -> DataFrame:
    return logs.running_milestones(log_day(spark, d), "click")


@query("w13_last_k", f"with {LOG} select case_id, event_id, array_to_string(list(activity) over (partition by case_id order by us, event_id rows between 2 preceding and current row), '>') as last_k from log")
def w13(spark: SparkSession, d: str) -> DataFrame:
    return logs.last_k(log_day(spark, d), 3)


@query("sessions_by_gap", f"with {LOG}, f as (select *, case when us - lag(us) over (partition by user_id order by us, event_id) <= 1800000000 then 0 else 1 end as fresh from log), s as (select user_id, cast(sum(fresh) over (partition by user_id order by us, event_id) as bigint) as session_no from f) select user_id, session_no, count(*) as n from s group by 1, 2")
def sessions_by_gap(spark: SparkSession, d: str) -> DataFrame:
    return logs.sessions(log_day(spark, d), "user_id", 1_800_000_000).groupBy("user_id", "session_no").agg(F.count(F.lit(1)).alias("n"))


@query("a25_weekly_trend", f"with {LOG} select cast(cast(date_trunc('week', make_timestamp(us)) as date) as varchar) as period, count(*) as n_events, count(distinct case_id) as n_cases from log group by 1")
def a25(spark: SparkSession, d: str) -> DataFrame:
    return logs.trend(log_day(spark, d))


@query("p7_abstraction", f"with {LOG} select case when activity in ('click', 'view') then 'browse' else activity end as activity, count(*) as n from log group by 1")
def p7(spark: SparkSession, d: str) -> DataFrame:
    mapping = spark.createDataFrame([("click", "browse"), ("view", "browse")], "child string, parent string")
    return logs.abstracted(log_day(spark, d), mapping).groupBy("activity").agg(F.count(F.lit(1)).alias("n"))


@query("p12_unassigned", f"with {LOG} select distinct activity from log where activity <> 'click'")
def p12(spark: SparkSession, d: str) -> DataFrame:
    return logs.unassigned(log_day(spark, d), spark.createDataFrame([("click", "browse")], "child string, parent string"))


@query("p13_intervals", f"""with {LOG}, r as (select case_id, case when activity in ('click', 'view') then 'start' else 'complete' end as lifecycle, 'task' as activity, us, event_id from log),
n as (select *, row_number() over (partition by case_id, activity, lifecycle order by us, event_id) as n from r)
select a.case_id, a.activity, a.n, a.us as end_us, coalesce(b.us, a.us) as start_us from n a left join n b on a.case_id = b.case_id and a.n = b.n and b.lifecycle = 'start' where a.lifecycle = 'complete'""")
def p13(spark: SparkSession, d: str) -> DataFrame:
    log = log_day(spark, d).withColumn("lifecycle", F.when(F.col("activity").isin("click", "view"), "start").otherwise("complete")).withColumn("activity", F.lit("task"))
    return logs.paired_intervals(log)


@query("p6_hierarchy_level", "select case_id, activity, count(*) as n from event_log where activity is not null group by 1, 2")
def p6(spark: SparkSession, d: str) -> DataFrame:
    e = load(spark, d, "event_log").select("case_id", F.col("activity").alias("level_1"), F.lit(None).cast("string").alias("level_2"), F.lit(None).cast("string").alias("level_3"))
    return logs.at_level(e, 1).groupBy("case_id", "activity").agg(F.count(F.lit(1)).alias("n"))


@query("hierarchy_rollup", "select r_name, n_name, count(*) as n from customer join nation on c_nationkey = n_nationkey join region on n_regionkey = r_regionkey group by rollup (r_name, n_name)")
def hierarchy_rollup(spark: SparkSession, d: str) -> DataFrame:
    c, n, r = (load(spark, d, t) for t in ("customer", "nation", "region"))
    joined = c.join(n, F.col("c_nationkey") == F.col("n_nationkey")).join(r, F.col("n_regionkey") == F.col("r_regionkey"))
    return logs.hierarchy_counts(joined, ["r_name", "n_name"])


@query("d14_dfg_per_class", f"with {LOG}, {NEXT} select activity as src, next_activity as dst, k % 2 = 0 as even, count(*) as frequency from nx where next_activity is not null group by 1, 2, 3")
def d14(spark: SparkSession, d: str) -> DataFrame:
    return logs.with_next(log_day(spark, d)).filter("next_activity is not null").groupBy(F.col("activity").alias("src"), F.col("next_activity").alias("dst"), (F.col("k") % 2 == 0).alias("even")).agg(F.count(F.lit(1)).alias("frequency"))
