"""Queries of joins, set operations, aggregates, statistics and table maintenance."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from flowloom.operators import dictionary, relational, stats
from flowloom.plans.views import CASES, LOG, log_day
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


def _logs(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    s = load(spark, d, "sample_logs").select("row_id", "event_id", "case_id", "activity", "resource", "amount")
    return s.filter("row_id % 2 = 0"), s.filter("row_id % 2 = 1")


@query("k10_insert_absent", """with t as (select * from sample_logs where row_id % 2 = 0), n as (select * from sample_logs where row_id % 2 = 1)
select event_id, count(*) as n from (select event_id from t union all select distinct event_id from n where event_id not in (select event_id from t where event_id is not null) and event_id is not null union all select distinct event_id from n where event_id is null) group by 1""")
def k10(spark: SparkSession, d: str) -> DataFrame:
    t, n = _logs(spark, d)
    return relational.insert_absent(t, n, ["event_id"]).groupBy("event_id").agg(F.count(F.lit(1)).alias("n"))


_ACC = "t as (select case_id, max(amount) as amount, min(resource) as resource from sample_logs where row_id % 2 = 0 and case_id is not null group by 1), n as (select case_id, max(amount) as amount, min(resource) as resource from sample_logs where row_id % 2 = 1 and case_id is not null group by 1)"


def _accounts(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    return tuple(x.filter("case_id is not null").groupBy("case_id").agg(F.max("amount").alias("amount"), F.min("resource").alias("resource")) for x in _logs(spark, d))


@query("k11_upsert", f"with {_ACC} select case_id, coalesce(n.amount, t.amount) as amount, coalesce(n.resource, t.resource) as resource from t full join n using (case_id)")
def k11(spark: SparkSession, d: str) -> DataFrame:
    return relational.upsert(*_accounts(spark, d), ["case_id"])


@query("k12_update_from", f"with {_ACC} select t.case_id, coalesce(n.amount, t.amount) as amount, t.resource from t left join n using (case_id)")
def k12(spark: SparkSession, d: str) -> DataFrame:
    return relational.update_from(*_accounts(spark, d), "case_id", "amount").select("case_id", "amount", "resource")


@query("k13_delete_keys", f"with {_ACC} select * from t where case_id not in (select case_id from n where amount > 9000)")
def k13(spark: SparkSession, d: str) -> DataFrame:
    t, n = _accounts(spark, d)
    return relational.delete_keys(t, n.filter("amount > 9000"), ["case_id"])


_BARE = "lower(trim({}, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13) || chr(160) || chr(12288) || chr(34) || chr(39)))"


@query("j8_overlapping_keys", f"""with k as (select event_id, app_name, unnest(list_distinct(correlation_keys)) as v from journey_events),
u as (select * from k where v is not null and {_BARE.format('v')} not in (select {_BARE.format('placeholder')} from placeholder_keys))
select distinct x.event_id as a, y.event_id as b from u x join u y using (v) where x.app_name = 'web_portal' and y.app_name = 'score_svc'""")
def j8(spark: SparkSession, d: str) -> DataFrame:
    e = load(spark, d, "journey_events")
    return relational.overlapping(e.filter("app_name = 'web_portal'"), e.filter("app_name = 'score_svc'"), "event_id", "correlation_keys", load(spark, d, "placeholder_keys"))


@query("j1_inner_join", "select o_orderpriority, count(*) as n, sum(l_quantity) as qty from orders join lineitem on o_orderkey = l_orderkey where l_discount > 0.05 group by 1")
def j1(spark: SparkSession, d: str) -> DataFrame:
    o, l = load(spark, d, "orders"), load(spark, d, "lineitem").filter("l_discount > 0.05")
    return o.join(l, F.col("o_orderkey") == F.col("l_orderkey")).groupBy("o_orderpriority").agg(F.count(F.lit(1)).alias("n"), F.sum("l_quantity").alias("qty"))


@query("j3_four_way_join", "select r_name, count(*) as n from region join nation on r_regionkey = n_regionkey join customer on n_nationkey = c_nationkey join orders on c_custkey = o_custkey group by 1")
def j3(spark: SparkSession, d: str) -> DataFrame:
    r, n, c, o = (load(spark, d, t) for t in ("region", "nation", "customer", "orders"))
    j = r.join(n, F.col("r_regionkey") == F.col("n_regionkey")).join(c, F.col("n_nationkey") == F.col("c_nationkey")).join(o, F.col("c_custkey") == F.col("o_custkey"))
    return j.groupBy("r_name").agg(F.count(F.lit(1)).alias("n"))


@query("j5_semi_join", "select c_custkey from customer where c_custkey in (select o_custkey from orders)")
def j5(spark: SparkSession, d: str) -> DataFrame:
    return load(spark, d, "customer").join(load(spark, d, "orders"), F.col("c_custkey") == F.col("o_custkey"), "left_semi").select("c_custkey")


@query("j7_orphans", "select p_partkey from part where p_partkey not in (select l_partkey from lineitem where l_quantity > 45)")
def j7(spark: SparkSession, d: str) -> DataFrame:
    return load(spark, d, "part").join(load(spark, d, "lineitem").filter("l_quantity > 45"), F.col("p_partkey") == F.col("l_partkey"), "left_anti").select("p_partkey")


@query("j10_left_join", "select c_custkey, count(o_orderkey) as n from customer left join orders on c_custkey = o_custkey group by 1")
def j10(spark: SparkSession, d: str) -> DataFrame:
    o = load(spark, d, "orders").groupBy("o_custkey").agg(F.count("o_orderkey").alias("n"))
    return load(spark, d, "customer").join(o, F.col("c_custkey") == F.col("o_custkey"), "left").select("c_custkey", F.coalesce("n", F.lit(0)).alias("n"))


@query("j13_pairs_sharing", f"with {LOG}, x as (select distinct case_id, activity from log) select a.activity as a, b.activity as b, count(*) as n from x a join x b on a.case_id = b.case_id and a.activity < b.activity group by 1, 2")
def j13(spark: SparkSession, d: str) -> DataFrame:
    x = log_day(spark, d).select("case_id", "activity").distinct()
    return x.select("case_id", F.col("activity").alias("a")).join(x.select("case_id", F.col("activity").alias("b")), "case_id").filter("a < b").groupBy("a", "b").agg(F.count(F.lit(1)).alias("n"))


@query("j16_first_to_last", f"with {LOG} select case_id, max(us) filter (activity = 'purchase') - min(us) filter (activity = 'view') as elapsed_us from log group by 1 having count(*) filter (activity = 'purchase') > 0 and count(*) filter (activity = 'view') > 0")
def j16(spark: SparkSession, d: str) -> DataFrame:
    at = lambda a: F.when(F.col("activity") == a, F.col("us"))
    return log_day(spark, d).groupBy("case_id").agg((F.max(at("purchase")) - F.min(at("view"))).alias("elapsed_us")).filter("elapsed_us is not null")


@query("u1_union_distinct", "select n_name as name from nation union select r_name from region")
def u1(spark: SparkSession, d: str) -> DataFrame:
    return load(spark, d, "nation").select(F.col("n_name").alias("name")).union(load(spark, d, "region").select("r_name")).distinct()


@query("u3_intersect", f"with {LOG} select user_id from log where activity = 'signup' intersect select user_id from log where activity = 'purchase'")
def u3(spark: SparkSession, d: str) -> DataFrame:
    log = log_day(spark, d)
    return log.filter("activity = 'signup'").select("user_id").intersect(log.filter("activity = 'purchase'").select("user_id"))


@query("u4_except", "select distinct activity from sample_logs where activity is not null except select activity from event_log")
def u4(spark: SparkSession, d: str) -> DataFrame:
    return load(spark, d, "sample_logs").select("activity").filter("activity is not null").subtract(load(spark, d, "event_log").select("activity"))


@query("a13_array_agg", "select agent_name, array_to_string(list_sort(list_distinct(list(tool_used))), ',') as tools from sample_agent_logs where tool_used is not null group by 1")
def a13(spark: SparkSession, d: str) -> DataFrame:
    return load(spark, d, "sample_agent_logs").filter("tool_used is not null").groupBy("agent_name").agg(F.array_join(F.array_sort(F.collect_set("tool_used")), ",").alias("tools"))


@query("a11_count_distinct_having", f"with {LOG} select user_id, count(distinct activity) as n_activities from log group by 1 having count(distinct activity) <= 5")
def a11(spark: SparkSession, d: str) -> DataFrame:
    return log_day(spark, d).groupBy("user_id").agg(F.count_distinct("activity").alias("n_activities")).filter("n_activities <= 5")


@query("a7_case_summary", f"with {LOG} select case_id, arg_min(activity, (us, event_id)) as first_activity, round(avg(value), 6) as avg_value, round(sum(value), 6) as sum_value, count(*) as n from log group by 1")
def a7(spark: SparkSession, d: str) -> DataFrame:
    return log_day(spark, d).groupBy("case_id").agg(F.min_by("activity", F.struct("us", "event_id")).alias("first_activity"), F.round(F.avg("value"), 6).alias("avg_value"), F.round(F.sum("value"), 6).alias("sum_value"), F.count(F.lit(1)).alias("n"))


@query("a9_describe", "select count(amount) as n, round(avg(amount), 6) as mean, round(stddev_samp(amount), 6) as sd, min(amount) as lo, max(amount) as hi from sample_logs")
def a9(spark: SparkSession, d: str) -> DataFrame:
    return load(spark, d, "sample_logs").agg(F.count("amount").alias("n"), F.round(F.avg("amount"), 6).alias("mean"), F.round(F.stddev_samp("amount"), 6).alias("sd"), F.min("amount").alias("lo"), F.max("amount").alias("hi"))


@query("a16_activity_totals", f"with {LOG}, {CASES} select count(*) as n_cases, sum(n) as n_events, array_to_string(list_sort(list_distinct(list(first_activity))), ',') as starts, array_to_string(list_sort(list_distinct(list(last_activity))), ',') as finishes from cases".replace("sum(n)", "cast(sum(n) as bigint)"))
def a16(spark: SparkSession, d: str) -> DataFrame:
    from flowloom.operators.logs import ends

    log = log_day(spark, d)
    e = ends(log).agg(F.count(F.lit(1)).alias("n_cases"), F.array_join(F.array_sort(F.collect_set("first_activity")), ",").alias("starts"), F.array_join(F.array_sort(F.collect_set("last_activity")), ",").alias("finishes"))
    return e.crossJoin(log.agg(F.count(F.lit(1)).alias("n_events")))


@query("a17_group_totals", f"with {LOG}, v as (select activity, user_id % 7 as g, count(*) as c from log group by 1, 2) select g, cast(sum(c) as bigint) as total, count(*) as n, round(100 * sum(c) / (select sum(c) from v), 2) as pct from v group by g")
def a17(spark: SparkSession, d: str) -> DataFrame:
    v = log_day(spark, d).groupBy("activity", (F.col("user_id") % 7).alias("g")).agg(F.count(F.lit(1)).alias("c"))
    return relational.combined_groups(v, "g", "c")


@query("a18_conditional_totals", "select count(*) as n, count(*) filter (where status = 'failed') as n_failed, count(*) filter (where status is null) as n_unknown, count(distinct task_id) filter (where status = 'failed') as tasks_failed from sample_agent_logs")
def a18(spark: SparkSession, d: str) -> DataFrame:
    failed = F.col("status") == "failed"
    return load(spark, d, "sample_agent_logs").agg(F.count(F.lit(1)).alias("n"), F.count_if(failed).alias("n_failed"), F.count_if(F.col("status").isNull()).alias("n_unknown"), F.count_distinct(F.when(failed, F.col("task_id"))).alias("tasks_failed"))


@query("a10_value_counts", "select resource, count(*) as n, round(count(*) / (select count(*) from sample_logs), 6) as share from sample_logs group by 1")
def a10(spark: SparkSession, d: str) -> DataFrame:
    s = load(spark, d, "sample_logs")
    counts = s.groupBy("resource").agg(F.count(F.lit(1)).alias("n"))
    return counts.crossJoin(F.broadcast(s.agg(F.count(F.lit(1)).alias("t")))).select("resource", "n", F.round(F.col("n") / F.col("t"), 6).alias("share"))


@query("a21_confusion", f"with {LOG}, x as (select value > 80 as truth, activity = 'error' as guess from log) select count(*) filter (truth and guess) as tp, count(*) filter (not truth and guess) as fp, count(*) filter (truth and not guess) as fn from x")
def a21(spark: SparkSession, d: str) -> DataFrame:
    t, g = F.col("value") > 80, F.col("activity") == "error"
    return log_day(spark, d).agg(F.count_if(t & g).alias("tp"), F.count_if(~t & g).alias("fp"), F.count_if(t & ~g).alias("fn"))


@query("t6_page", "select o_orderkey, o_totalprice from orders where o_orderkey > 500 order by o_orderkey limit 20")
def t6(spark: SparkSession, d: str) -> DataFrame:
    return relational.page(load(spark, d, "orders").select("o_orderkey", "o_totalprice"), "o_orderkey", 500, 20)


@query("t7_hash_sample")
def t7(spark: SparkSession, d: str) -> DataFrame:
    return relational.sample_by_hash(load(spark, d, "journey_events").select("event_id", "app_name").distinct(), "event_id", 20)


@query("x4_normalised_names", "select distinct raw_name, trim(regexp_replace(lower(regexp_replace(raw_name, '([a-z0-9])([A-Z])', '\\1 \\2', 'g')), '[^a-z0-9]+', ' ', 'g')) as normal from observed_fields where raw_name is not null")
def x4(spark: SparkSession, d: str) -> DataFrame:
    return load(spark, d, "observed_fields").filter("raw_name is not null").select("raw_name", dictionary.normal_form(F.col("raw_name")).alias("normal")).distinct()


@query("x6_truncated", "select distinct activity, case when length(activity) > 10 then left(activity, 8) || '...' else activity end as short from sample_logs where activity is not null")
def x6(spark: SparkSession, d: str) -> DataFrame:
    a = F.col("activity")
    return load(spark, d, "sample_logs").filter(a.isNotNull()).select(a, F.when(F.length(a) > 10, F.concat(F.left(a, F.lit(8)), F.lit("..."))).otherwise(a).alias("short")).distinct()


@query("p17_payload_fields", "select event_id, json_extract_string(payload, '$.app') as app, try_cast(json_extract_string(payload, '$.step') as integer) as step from journey_events where json_valid(payload) and json_type(payload) = 'OBJECT'")
def p17(spark: SparkSession, d: str) -> DataFrame:
    return relational.payload_fields(load(spark, d, "journey_events").select("event_id", "payload"), "payload", {"app": "string", "step": "int"})


@query("o1_kruskal_wallis", f"""with {LOG}, c as (select value, count(*) as n from log group by 1), r as (select value, n, sum(n) over (order by value) - n + (n + 1) / 2 as rank from c),
g as (select activity, sum(rank) as r, count(*) as m from log join r using (value) group by 1), s as (select sum(r * r / m) as s, sum(m) as n, count(*) as k from g), t as (select sum(cast(n as double) ** 3 - n) as ties from c)
select round((12 / (n * (n + 1)) * s - 3 * (n + 1)) / (1 - ties / (cast(n as double) ** 3 - n)), 6) as h, k as n_groups, cast(n as bigint) as n from s, t""")
def o1(spark: SparkSession, d: str) -> DataFrame:
    return stats.kruskal_wallis(log_day(spark, d), "activity", "value").select(F.round("h", 6).alias("h"), "n_groups", "n")


@query("o3_anova", f"with {LOG}, g as (select activity, count(value) as m, sum(value) as s, sum(value * value) as q from log group by 1), o as (select sum(m) as n, sum(s) as s, sum(q) as q, sum(s * s / m) as b, count(*) as k from g) select round((b - s * s / n) / (k - 1) / ((q - b) / (n - k)), 6) as f, k - 1 as df_between, cast(n - k as bigint) as df_within from o")
def o3(spark: SparkSession, d: str) -> DataFrame:
    return stats.anova(log_day(spark, d), "activity", "value").withColumn("f", F.round("f", 6))


@query("o4_correlations", "with l as (select l_quantity as x, l_extendedprice as y from lineitem), a as (select x, count(*) as n from l group by 1), b as (select y, count(*) as n from l group by 1), ra as (select x, sum(n) over (order by x) - n + (n + 1) / 2 as rx from a), rb as (select y, sum(n) over (order by y) - n + (n + 1) / 2 as ry from b) select round(corr(x, y), 6) as pearson, round(corr(rx, ry), 6) as spearman from l join ra using (x) join rb using (y)")
def o4(spark: SparkSession, d: str) -> DataFrame:
    c = stats.correlations(load(spark, d, "lineitem"), "l_quantity", "l_extendedprice")
    return c.select(F.round("pearson", 6).alias("pearson"), F.round("spearman", 6).alias("spearman"))


@query("o7_iqr_outliers", "with q as (select site, quantile_cont(amount, 0.25) as a, quantile_cont(amount, 0.75) as b from sample_logs group by 1) select row_id, s.site, amount, case when amount < a - 1.5 * (b - a) then 'Low' else 'High' end as label from sample_logs s join q on s.site = q.site where amount < a - 1.5 * (b - a) or amount > b + 1.5 * (b - a)")
def o7(spark: SparkSession, d: str) -> DataFrame:
    return stats.iqr_outliers(load(spark, d, "sample_logs").select("row_id", "site", "amount"), ["site"], "amount").select("row_id", "site", "amount", "label")


@query("o10_scaled", f"with {LOG} select event_id, round((value - (select avg(value) from log)) / (select stddev_pop(value) from log), 6) as z from log")
def o10(spark: SparkSession, d: str) -> DataFrame:
    return stats.scaled(log_day(spark, d), "value").select("event_id", F.round("z", 6).alias("z"))


@query("o11_label_encoding", f"with {LOG} select event_id, cast(dense_rank() over (order by activity) - 1 as integer) as code from log")
def o11(spark: SparkSession, d: str) -> DataFrame:
    return stats.label_encoded(log_day(spark, d), "activity").select("event_id", F.col("code").cast("int").alias("code"))


@query("o12_one_hot", f"with {LOG} select event_id, cast(activity = 'error' as integer) as is_error, cast(activity = 'purchase' as integer) as is_purchase, cast(activity = 'signup' as integer) as is_signup, cast(activity = 'view' as integer) as is_view from log")
def o12(spark: SparkSession, d: str) -> DataFrame:
    log = log_day(spark, d)
    return stats.one_hot(log, "event_id", "activity", stats.categories(log, "activity"))


@query("o13_frequency_encoding", f"with {LOG} select event_id, round(count(*) over (partition by activity) / (select count(*) from log), 6) as share from log")
def o13(spark: SparkSession, d: str) -> DataFrame:
    return stats.frequency_encoded(log_day(spark, d), "activity").select("event_id", F.round("share", 6).alias("share"))


@query("o16_distribution_gap", f"with {LOG}, p as (select activity, count(*) as n from log where value > 80 group by 1), w as (select activity, count(*) as n from log group by 1) select activity, round(coalesce(p.n / (select sum(n) from p), 0), 6) as part_share, round(w.n / (select sum(n) from w), 6) as whole_share from w left join p using (activity)")
def o16(spark: SparkSession, d: str) -> DataFrame:
    log = log_day(spark, d)
    return relational.distribution_gap(log.filter("value > 80"), log, "activity")


@query("o9_mahalanobis", """with m as (select avg(l_quantity) as mx, avg(l_extendedprice) as my, var_pop(l_quantity) as a, var_pop(l_extendedprice) as b, covar_pop(l_quantity, l_extendedprice) as c from lineitem),
x as (select l_orderkey, l_quantity - mx as x, l_extendedprice - my as y, a, b, c from lineitem, m)
select l_orderkey, count(*) as n, round(max((b * x * x - 2 * c * x * y + a * y * y) / (a * b - c * c)), 3) as d2 from x group by 1""")
def o9(spark: SparkSession, d: str) -> DataFrame:
    return stats.mahalanobis(load(spark, d, "lineitem"), ["l_quantity", "l_extendedprice"]).groupBy("l_orderkey").agg(F.count(F.lit(1)).alias("n"), F.round(F.max("d2"), 3).alias("d2"))


@query("o14_pca")
def o14(spark: SparkSession, d: str) -> DataFrame:
    return stats.principal_components(load(spark, d, "lineitem"), ["l_quantity", "l_extendedprice", "l_discount"]).select("l_orderkey", "l_linenumber", "pc1", "pc2")


@query("o8_isolation_forest")
def o8(spark: SparkSession, d: str) -> DataFrame:
    return stats.isolation_forest(log_day(spark, d), "event_id", ["value", "k"])
