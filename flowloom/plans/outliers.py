"""Queries of significance, correlation by pairs, robust distances and outlier comparisons."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from flowloom.operators import controls, logs, stats
from flowloom.plans.views import LOG, log_day
from flowloom.session import load

QUERIES: dict = {}
SQL: dict[str, str] = {}
H, DAY = 3_600_000_000, 86_400_000_000


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return add


def _kruskal(group: str) -> str:
    """Kruskal-Wallis as SQL; the chi-squared survival of an even number of degrees is a finite sum."""
    return f"""(with c as (select value, count(*) as n from log group by 1), r as (select value, n, sum(n) over (order by value) - n + (n + 1) / 2 as rank from c),
g as (select {group} as g, sum(rank) as r, count(*) as m from log join r using (value) group by 1), s as (select sum(r * r / m) as s, sum(m) as n, count(*) as k from g), t as (select sum(cast(n as double) ** 3 - n) as ties from c),
h as (select ((12 / (n * (n + 1)) * s - 3 * (n + 1)) / (1 - ties / (cast(n as double) ** 3 - n))) / 2 as x, k from s, t)
select exp(-x) * case k when 5 then 1 + x when 7 then 1 + x + x * x / 2 end from h)"""


@query("o1_kruskal_p", f"with {LOG} select round({_kruskal('activity')}, 9) as p")
def o1(spark: SparkSession, d: str) -> DataFrame:
    return stats.kruskal_wallis(log_day(spark, d), "activity", "value").select(F.round("p", 9).alias("p"))


@query("o2_significant_variables", f"""with {LOG}, p as (select 'activity' as variable, {_kruskal('activity')} as p union all select 'weekday', {_kruskal('(us // 86400000000) % 7')})
select variable, round(p, 9) as p, p < 0.05 or (select min(p) from p) >= 0.05 as chosen from p""")
def o2(spark: SparkSession, d: str) -> DataFrame:
    log = log_day(spark, d).withColumn("weekday", F.expr(f"(us div {DAY}) % 7"))
    rows = stats.significant(log, ["activity", "weekday"], "value")
    return spark.createDataFrame([(v, round(p, 9), c) for v, p, c in rows], "variable string, p double, chosen boolean")


@query("o4_kendall", """with c as (select l_quantity as x, l_discount as y, cast(count(*) as double) as n from lineitem group by 1, 2),
s as (select sum(case when (a.x - b.x) * (a.y - b.y) > 0 then a.n * b.n when (a.x - b.x) * (a.y - b.y) < 0 then -a.n * b.n else 0 end) / 2 as s from c a, c b),
t as (select sum(n) as n from c), tx as (select sum(n * (n - 1) / 2) as t from (select sum(n) as n from c group by x)), ty as (select sum(n * (n - 1) / 2) as t from (select sum(n) as n from c group by y))
select round(s / sqrt((n * (n - 1) / 2 - tx.t) * (n * (n - 1) / 2 - ty.t)), 9) as tau from s, t, tx, ty""")
def o4(spark: SparkSession, d: str) -> DataFrame:
    tau = stats.kendall(load(spark, d, "lineitem").select(F.col("l_quantity").cast("double"), F.col("l_discount").cast("double")), "l_quantity", "l_discount")
    return spark.createDataFrame([(round(tau, 9),)], "tau double")


@query("o4_correlation_p")
def o4p(spark: SparkSession, d: str) -> DataFrame:
    """Pearson and Spearman of discount and tax with their p."""
    li = load(spark, d, "lineitem")
    c, n = stats.correlations(li, "l_discount", "l_tax").first(), li.count()
    return spark.createDataFrame([(c.pearson, stats.correlation_p(c.pearson, n), c.spearman, stats.correlation_p(c.spearman, n))], "pearson double, pearson_p double, spearman double, spearman_p double")


@query("o3_anova_p")
def o3(spark: SparkSession, d: str) -> DataFrame:
    a = stats.anova(log_day(spark, d), "activity", "value").first()
    return spark.createDataFrame([(a.f, a.df_between, a.df_within, stats.f_survival(a.f, a.df_between, a.df_within))], "f double, df_between bigint, df_within bigint, p double")


@query("o3_tukey", f"with {LOG}, m as (select activity, avg(value) as m from log group by 1) select a.activity as a, b.activity as b, round(b.m - a.m, 6) as difference from m a join m b on a.activity < b.activity")
def o3t(spark: SparkSession, d: str) -> DataFrame:
    return stats.tukey(log_day(spark, d), "activity", "value").select("a", "b", F.round("difference", 6).alias("difference"))


@query("o8_isolation_outliers")
def o8(spark: SparkSession, d: str) -> DataFrame:
    return stats.isolation_outliers(stats.isolation_forest(log_day(spark, d), "event_id", ["value", "k"])).filter("outlier").select("event_id", "score")


@query("o9_robust_distances")
def o9(spark: SparkSession, d: str) -> DataFrame:
    li = load(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity", "l_extendedprice")
    return stats.robust_mahalanobis(li, ["l_quantity", "l_extendedprice"]).select("l_orderkey", "l_linenumber", F.round("d2", 6).alias("d2"), "outlier")


@query("o15_per_site", "with m as (select site, avg(amount) as m, stddev_pop(amount) as s from sample_logs group by 1) select row_id from sample_logs x join m on x.site is not distinct from m.site where abs(amount - m) > 3 * s")
def o15(spark: SparkSession, d: str) -> DataFrame:
    return stats.far_from_group_mean(load(spark, d, "sample_logs").select("row_id", "site", "amount"), "site", "amount").select("row_id")


@query("o17_one_or_many_columns", """with q as (select quantile_cont(l_extendedprice, 0.25) as a, quantile_cont(l_extendedprice, 0.75) as b from lineitem),
m as (select avg(l_quantity) as mx, avg(l_extendedprice) as my, var_pop(l_quantity) as a, var_pop(l_extendedprice) as b, covar_pop(l_quantity, l_extendedprice) as c from lineitem),
x as (select l_extendedprice < q.a - 1.5 * (q.b - q.a) or l_extendedprice > q.b + 1.5 * (q.b - q.a) as single, (m.b * (l_quantity - mx) ** 2 - 2 * c * (l_quantity - mx) * (l_extendedprice - my) + m.a * (l_extendedprice - my) ** 2) / (m.a * m.b - c * c) > -2 * ln(0.01) as several from lineitem, q, m)
select single, several, count(*) as n from x group by 1, 2""")
def o17(spark: SparkSession, d: str) -> DataFrame:
    """Rows that are outliers by one column, by two together, by both or by neither."""
    li = load(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity", "l_extendedprice")
    single = stats.iqr_outliers(li.withColumn("all", F.lit(1)), ["all"], "l_extendedprice").select("l_orderkey", "l_linenumber", F.lit(True).alias("s"))
    scored = stats.mahalanobis(li, ["l_quantity", "l_extendedprice"]).join(single, ["l_orderkey", "l_linenumber"], "left")
    return scored.groupBy(F.coalesce("s", F.lit(False)).alias("single"), (F.col("d2") > stats.chi2_quantile(0.99, 2)).alias("several")).agg(F.count(F.lit(1)).alias("n"))


# controls over time


@query("r12_impossible", f"with {LOG}, c as (select case_id, min(us) filter (activity = 'view') as x, min(us) filter (activity = 'purchase') as y from log group by 1) select case_id, case when y - x <= {4 * H} then 'satisfied' when y is not null or 1706000000000000 - x > {4 * H} then 'violated' when 1706000000000000 - x + {H} > {4 * H} then 'impossible' when (1706000000000000 - x) * 5 > {16 * H} then 'at_risk' else 'ticking' end as status from c where x is not null")
def r12(spark: SparkSession, d: str) -> DataFrame:
    """What needs at least an hour more is impossible before its limit has run out."""
    return controls.status(log_day(spark, d), "view", "purchase", 4 * H, 1_706_000_000_000_000, least_us=H)


@query("r16_last_days", f"with {LOG} select activity, count(*) as n from log where us > (select max(us) from log) - 7 * {DAY} group by 1")
def r16(spark: SparkSession, d: str) -> DataFrame:
    return logs.recent(log_day(spark, d), 7).groupBy("activity").agg(F.count(F.lit(1)).alias("n"))


@query("r19_missing_before", f"with {LOG}, c as (select case_id, min((us, event_id)) filter (activity = 'purchase') as y, min((us, event_id)) filter (activity = 'view') as x from log group by 1) select case_id from c where y is not null and (x is null or x > y)")
def r19(spark: SparkSession, d: str) -> DataFrame:
    return controls.missing_before(log_day(spark, d), "view", "purchase")


@query("r19_longer_than", f"with {LOG} select case_id, max(us) - min(us) as duration_us from log group by 1 having max(us) - min(us) > {12 * H}")
def r19b(spark: SparkSession, d: str) -> DataFrame:
    return controls.longer_than(log_day(spark, d), 12 * H)


@query("r19_above_approved", "with a as (select case_id, max(amount) filter (activity = 'Limit Set') as l, max(amount) filter (activity = 'Raise Asked') as r from sample_logs where case_id is not null group by 1) select case_id from a where r > l")
def r19c(spark: SparkSession, d: str) -> DataFrame:
    return controls.above_approved(load(spark, d, "sample_logs").filter("case_id is not null"), "amount", "Raise Asked", "Limit Set")
