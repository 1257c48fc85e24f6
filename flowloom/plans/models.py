"""Queries of conformance, controls, dictionary, sources, sinks and streams."""

from __future__ import annotations

import itertools

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from flowloom.operators import conformance, controls, dfg, dictionary, variants
from flowloom.plans.graphs import _EDGES as EDGES
from flowloom.plans.graphs import day_hour_edges
from flowloom.plans.views import CASES, LOG, NEXT, log_day
from flowloom.session import load
from flowloom.sources import readers, writers
from flowloom.streaming import streams

QUERIES: dict = {}
SQL: dict[str, str] = {}
H = 3_600_000_000


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return add


def _cases(spark: SparkSession, d: str) -> DataFrame:
    return variants.with_variant(log_day(spark, d)).select("case_id", "variant")


MODEL = conformance.net_from_edges([("view", "click"), ("click", "purchase")])


def _cost(v: str, n: str, model: tuple[str, ...]) -> str:
    """A sequence model's alignment cost: what neither side shares."""
    return f"({n} + {len(model)} - 2 * ({_subsequence(v, model)}))"


def _subsequence(v: str, model: tuple[str, ...]) -> str:
    tests = []
    for n in range(len(model), 0, -1):
        patterns = ["^(.*->)?" + "->(.*->)?".join(p) + "(->.*)?$" for p in dict.fromkeys(itertools.combinations(model, n))]
        tests.append("when " + " or ".join(f"regexp_matches({v}, '{x}')" for x in patterns) + f" then {n}")
    return f"case {' '.join(tests)} else 0 end" if model else "0"


_STEPS = ("view", "click", "purchase")
_VARIANT = f"with {LOG}, {CASES}, v as (select variant, max(n) as n, count(*) as cases from cases group by 1)"


def _least(of: list[tuple[str, ...]]) -> str:
    return "least(" + ", ".join(_cost("variant", "n", m) for m in of) + ")"


@query("c2_alignment_costs", f"{_VARIANT} select variant, cast({_cost('variant', 'n', _STEPS)} as integer) as cost, 1 - {_cost('variant', 'n', _STEPS)} / (n + 3) as fitness from v")
def c2(spark: SparkSession, d: str) -> DataFrame:
    return conformance.variant_conformance(_cases(spark, d), MODEL).select("variant", "cost", "fitness")


@query("c3_partial_alignments", f"{_VARIANT} select variant, cast({_least([_STEPS[:k] for k in range(4)])} as integer) as prefix_cost, cast({_least([_STEPS[k:] for k in range(4)])} as integer) as postfix_cost, cast({_least([_STEPS[i:j] for i in range(4) for j in range(i, 4)])} as integer) as infix_cost from v")
def c3(spark: SparkSession, d: str) -> DataFrame:
    return conformance.partial_alignments(_cases(spark, d), MODEL)


@query("c5_generalization", f"with {LOG}, n as (select activity, count(*) as n from log where activity in ('view', 'click', 'purchase') group by 1) select round(1 - (sum(1 / sqrt(n)) + 3 - count(*)) / 3, 9) as generalization from n")
def c5g(spark: SparkSession, d: str) -> DataFrame:
    return conformance.generalization(log_day(spark, d), MODEL).select(F.round("generalization", 9).alias("generalization"))


@query("c10_most_and_least_common", f"{_VARIANT}, b as (select *, row_number() over (order by cases desc, variant) as first, row_number() over (order by cases, variant) as last from v) select case when first = 1 then 'most' else 'least' end as which, variant, 1 - {_cost('variant', 'n', _STEPS)} / (n + 3) as fitness from b where first = 1 or last = 1")
def c10(spark: SparkSession, d: str) -> DataFrame:
    """Conformance of the most and of the least common variant, ties by key."""
    counts = variants.with_variant(log_day(spark, d)).groupBy("variant").agg(F.count(F.lit(1)).alias("n"))
    ends = counts.agg(F.min_by("variant", F.struct(-F.col("n"), "variant")).alias("most"), F.min_by("variant", F.struct("n", "variant")).alias("least"))
    named = ends.select(F.explode(F.array(F.struct(F.lit("most").alias("which"), F.col("most").alias("variant")), F.struct(F.lit("least").alias("which"), F.col("least").alias("variant")))).alias("x")).select("x.*")
    return named.join(conformance.variant_conformance(named, MODEL).select("variant", "fitness"), "variant")


@query("d16_repair_loop")
def d16(spark: SparkSession, d: str) -> DataFrame:
    """The attempts of the repair loop, from a net that lacks two of the log's activities."""
    _, history = conformance.repair_loop(_cases(spark, d), MODEL)
    return spark.createDataFrame(history, "attempt int, fitness double, added int")


@query("a20_replay_summary")
def a20(spark: SparkSession, d: str) -> DataFrame:
    cases = _cases(spark, d)
    return conformance.replay_summary(cases.join(conformance.variant_conformance_by_replay(cases, MODEL), "variant"))


@query("d6_unified_loops", f"with {LOG}, {NEXT} select case_id, activity as src, next_activity as dst, count(*) as n from nx where next_activity is not null group by 1, 2, 3")
def d6(spark: SparkSession, d: str) -> DataFrame:
    return conformance.unified_loops(log_day(spark, d))


@query("a5_variant_metrics", f"with {LOG}, {CASES} select variant, count(*) as frequency, avg(d) as avg_us, cast(median(d) as double) as median_us, min(d) as min_us, max(d) as max_us, count(*) filter (variant <> 'view->click->purchase') as n_anomalies from cases group by 1")
def a5(spark: SparkSession, d: str) -> DataFrame:
    """Frequency, durations and anomalies of each variant."""
    cases = variants.with_variant(log_day(spark, d)).select("case_id", "variant", (F.col("end_us") - F.col("start_us")).alias("d"))
    scored = conformance.variant_conformance(cases, MODEL).select("variant", (F.col("fitness") < 1).alias("anomaly"))
    out = cases.groupBy("variant").agg(F.count(F.lit(1)).alias("frequency"), F.avg("d").alias("avg_us"), F.median("d").cast("double").alias("median_us"), F.min("d").alias("min_us"), F.max("d").alias("max_us"))
    return out.join(scored, "variant").withColumn("n_anomalies", F.when(F.col("anomaly"), F.col("frequency")).otherwise(0)).drop("anomaly")


@query("a6_snapshot_metrics", f"with {LOG}, {CASES} select count(*) as n_cases, count(distinct variant) as n_variants, avg(d) as avg_us, cast(median(d) as double) as median_us, min(d) as min_us, max(d) as max_us, count(*) filter (variant <> 'view->click->purchase') as n_anomalies from cases")
def a6(spark: SparkSession, d: str) -> DataFrame:
    """Over all cases, not over the variants' averages."""
    cases = variants.with_variant(log_day(spark, d)).select("case_id", "variant", (F.col("end_us") - F.col("start_us")).alias("d"))
    return conformance.log_conformance(cases, MODEL).join(cases.select(F.col("case_id").alias("__c"), "d"), F.col("case_id").eqNullSafe(F.col("__c"))).agg(
        F.count(F.lit(1)).alias("n_cases"), F.count_distinct("variant").alias("n_variants"), F.avg("d").alias("avg_us"), F.median("d").cast("double").alias("median_us"), F.min("d").alias("min_us"), F.max("d").alias("max_us"), F.count_if("anomaly").alias("n_anomalies")
    )


@query("c8_journey_records", f"with {LOG}, {CASES}, s as (select case_id, min(us) as start_us, max(us) as end_us from log group by 1) select case_id, start_us, end_us, variant as sequence, case when variant = 'view->click->purchase' then 'conforming' else 'anomalous' end as status from cases join s using (case_id)")
def c8(spark: SparkSession, d: str) -> DataFrame:
    cases = variants.with_variant(log_day(spark, d))
    scored = conformance.variant_conformance(cases, MODEL).select("variant", F.when(F.col("fitness") < 1, "anomalous").otherwise("conforming").alias("status"))
    return cases.join(scored, "variant").select("case_id", "start_us", "end_us", F.col("variant").alias("sequence"), "status")


@query("c1_replay_and_alignments")
def c1(spark: SparkSession, d: str) -> DataFrame:
    return conformance.variant_conformance(_cases(spark, d), MODEL)


@query("c7_anomalies", f"with {LOG}, {CASES} select variant = 'view->click->purchase' as conforms, count(*) as n from cases group by 1")
def c7(spark: SparkSession, d: str) -> DataFrame:
    return conformance.log_conformance(_cases(spark, d), MODEL).groupBy((~F.col("anomaly")).alias("conforms")).agg(F.count(F.lit(1)).alias("n"))


@query("a19_average_fitness", f"{_VARIANT} select round(sum(cases * (1 - {_cost('variant', 'n', _STEPS)} / (n + 3))) / sum(cases), 9) as avg_fitness, cast(sum(cases) filter (variant <> 'view->click->purchase') as bigint) as n_anomalies from v")
def a19(spark: SparkSession, d: str) -> DataFrame:
    return conformance.average_fitness(conformance.log_conformance(_cases(spark, d), MODEL)).withColumn("avg_fitness", F.round("avg_fitness", 9))


@query("c5_precision", f"""with {LOG}, {CASES}, p as (select unnest([0, 1, 2]) as k), m as (select ['view', 'click', 'purchase'] as m),
x as (select k, count(*) as n, count(*) filter (string_split(variant, '->')[k + 1] = m[k + 1]) as follow from p, m, cases where string_split(variant, '->')[1:k] = m[1:k] and variant is not null group by 1)
select round(1 - sum(case when follow = 0 then n else 0 end) / sum(n), 9) as precision from x""")
def c5(spark: SparkSession, d: str) -> DataFrame:
    return conformance.escaping_precision(_cases(spark, d), MODEL).select(F.round("precision", 9).alias("precision"))


@query("d2_alpha_pairs")
def d2(spark: SparkSession, d: str) -> DataFrame:
    rows = dfg.footprint(dfg.graph(log_day(spark, d))).collect()  # at most the square of the number of activities
    relations = {(r.src, r.dst): r.relation for r in rows}
    pairs = conformance.alpha_pairs(relations, sorted({a for p in relations for a in p}))
    return spark.createDataFrame([(",".join(sorted(a)), ",".join(sorted(b))) for a, b in pairs], "before string, after string")


@query("d3_inductive_tree")
def d3(spark: SparkSession, d: str) -> DataFrame:
    log = log_day(spark, d)
    edges = {(r.src, r.dst): r.frequency for r in dfg.graph(log).select("src", "dst", "frequency").collect()}
    n = dfg.diagram(log).collect()
    tree = conformance.inductive_tree(edges, {r.activity for r in n if r.n_starts}, {r.activity for r in n if r.n_ends}, [r.activity for r in n], 0.1)
    return spark.createDataFrame([(tree,)], "tree string")


@query("d9_acyclic_edges")
def d9(spark: SparkSession, d: str) -> DataFrame:
    rows = dfg.partial_order_edges(log_day(spark, d)).collect()
    return spark.createDataFrame(sorted(conformance.without_cycles((r.src, r.dst) for r in rows)), "src string, dst string")


@query("v11_model_cover", f"with {LOG}, {CASES} select cast(row_number() over (order by count(*) desc, variant) - 1 as integer) as model, variant from cases group by variant")
def v11(spark: SparkSession, d: str) -> DataFrame:
    return conformance.model_cover(variants.variants(log_day(spark, d)).select("variant", "frequency"))


@query("r7_first_to_last", f"with {LOG} select case_id, max(us) filter (activity = 'purchase') - min(us) filter (activity = 'view') as elapsed_us from log group by 1 having max(us) filter (activity = 'purchase') - min(us) filter (activity = 'view') > {2 * H}")
def r7(spark: SparkSession, d: str) -> DataFrame:
    return controls.first_to_last(log_day(spark, d), "view", "purchase", 2 * H)


@query("r8_forbidden_after", f"with {LOG} select case_id from log group by 1 having min(us) filter (activity = 'error') < max(us) filter (activity = 'purchase')")
def r8(spark: SparkSession, d: str) -> DataFrame:
    return controls.forbidden_after(log_day(spark, d), "error", "purchase")


@query("r9_too_few_before", f"with {LOG}, s as (select *, coalesce(sum(case when activity = 'click' then 1 else 0 end) over (partition by case_id order by us, event_id rows between unbounded preceding and 1 preceding), 0) as c from log) select case_id, cast(min(c) as bigint) as n_before from s where activity = 'purchase' group by 1 having min(c) < 1")
def r9(spark: SparkSession, d: str) -> DataFrame:
    return controls.too_few_before(log_day(spark, d), "click", 1, "purchase")


@query("r10_gaps_over", f"with {LOG}, {NEXT} select case_id, event_id, next_us - us as gap_us from nx where next_us - us > {6 * H}")
def r10(spark: SparkSession, d: str) -> DataFrame:
    return controls.gaps_over(log_day(spark, d), 6 * H)


@query("r12_monitor_status", f"with {LOG}, c as (select case_id, min(us) filter (activity = 'view') as x, min(us) filter (activity = 'purchase') as y from log group by 1) select case_id, case when y - x <= {4 * H} then 'satisfied' when y is not null or 1706000000000000 - x > {4 * H} then 'violated' when (1706000000000000 - x) * 5 > {16 * H} then 'at_risk' else 'ticking' end as status from c where x is not null")
def r12(spark: SparkSession, d: str) -> DataFrame:
    return controls.status(log_day(spark, d), "view", "purchase", 4 * H, 1_706_000_000_000_000)


@query("r19_segregation_of_duties", "select task_id as case_id, agent_name as actor from sample_agent_logs where agent_name is not null group by 1, 2 having bool_or(activity = 'Patch Written') and bool_or(activity = 'Patch Reviewed')")
def r19(spark: SparkSession, d: str) -> DataFrame:
    log = load(spark, d, "sample_agent_logs").withColumnRenamed("task_id", "case_id")
    return controls.same_actor(log, "agent_name", "Patch Written", "Patch Reviewed")


@query("r19_loops_over", f"with {LOG} select case_id, activity, count(*) as times from log group by 1, 2 having count(*) > 2")
def r19b(spark: SparkSession, d: str) -> DataFrame:
    return controls.loops_over(log_day(spark, d), 2)


@query("m1_dictionary_match")
def m1(spark: SparkSession, d: str) -> DataFrame:
    return dictionary.match(load(spark, d, "observed_fields").select(F.col("raw_name").alias("query")), load(spark, d, "dictionary_entries"), 70.0, 3)


@query("m1_exact_match", "with n as (select preferred_name, unnest(list_append(aliases, preferred_name)) as name from dictionary_entries) select distinct raw_name as query, preferred_name from observed_fields join n on lower(raw_name) = lower(name)")
def m1b(spark: SparkSession, d: str) -> DataFrame:
    names = load(spark, d, "dictionary_entries").select("preferred_name", F.explode(F.array_append("aliases", F.col("preferred_name"))).alias("name"))
    return load(spark, d, "observed_fields").join(names, F.lower("raw_name") == F.lower("name")).select(F.col("raw_name").alias("query"), "preferred_name").distinct()


@query("m3_add_aliases", "select preferred_name, array_to_string(list_sort(list_distinct(list_concat(aliases, case when preferred_name = 'birth_date' then ['dob', 'born_on'] else [] end))), ',') as aliases from dictionary_entries")
def m3(spark: SparkSession, d: str) -> DataFrame:
    new = spark.createDataFrame([("birth_date", "dob"), ("birth_date", "born_on")], "preferred_name string, alias string")
    return dictionary.add_aliases(load(spark, d, "dictionary_entries"), new).select("preferred_name", F.array_join("aliases", ",").alias("aliases"))


def _place(spark: SparkSession) -> str:
    from flowloom.streaming.streams import _folder

    return _folder(spark)


@query("s1_k1_xes_round_trip", f"with {LOG} select case_id, cast(row_number() over (partition by case_id order by us, event_id) as integer) as event_no, activity, us // 1000 as ms from log")
def s1(spark: SparkSession, d: str) -> DataFrame:
    at = f"{_place(spark)}-xes"
    writers.write_xes(log_day(spark, d), at)
    return readers.read_xes(spark, at).select("case_id", "event_no", "activity", F.floor(F.col("us") / 1000).alias("ms"))


@query("s2_k2_csv_round_trip", "select row_id, case_id, \"timestamp\", activity, amount from sample_logs")
def s2(spark: SparkSession, d: str) -> DataFrame:
    at = f"{_place(spark)}-csv"
    writers.write_csv(load(spark, d, "sample_logs").select("row_id", "case_id", "timestamp", "activity", "amount"), at)
    return readers.read_csv(spark, at, "row_id bigint, case_id string, timestamp string, activity string, amount double")


@query("k18_incremental_append", "select count(distinct event_id) as n from journey_events")
def k18(spark: SparkSession, d: str) -> DataFrame:
    at, e = f"{_place(spark)}-table", load(spark, d, "journey_events").select("event_id", "app_name")
    writers.append_new(e.filter("app_name = 'web_portal'"), at, ["event_id"])
    writers.append_new(e, at, ["event_id"])
    return spark.read.parquet(at).agg(F.count("event_id").alias("n"))


@query("k20_versions", "select preferred_name, len(aliases) as first, len(list_distinct(list_concat(aliases, ['v2']))) as newest from dictionary_entries")
def k20(spark: SparkSession, d: str) -> DataFrame:
    """The number of aliases in the first and in the newest of two versions."""
    at, e = f"{_place(spark)}-versions", load(spark, d, "dictionary_entries")
    new = e.select("preferred_name", F.lit("v2").alias("alias"))
    writers.write_version(e.select("preferred_name", "aliases"), at, 1)
    writers.write_version(dictionary.add_aliases(e, new).select("preferred_name", "aliases"), at, 2)
    n = lambda v, name: writers.read_version(spark, at, v).select("preferred_name", F.size("aliases").cast("long").alias(name))
    return n(1, "first").join(n(None, "newest"), "preferred_name")


@query("c9_snapshot")
def c9(spark: SparkSession, d: str) -> DataFrame:
    log = log_day(spark, d)
    metrics = log.agg(F.count_distinct("case_id").alias("cases"), F.count(F.lit(1)).alias("events"))
    return writers.snapshot(variants.top(variants.variants(log), 10), metrics)


@query("k5_pnml", None)
def k5(spark: SparkSession, d: str) -> DataFrame:
    """The log's alpha net as PNML and its directly-follows graph as BPMN; without events both are empty."""
    log = log_day(spark, d)
    g = dfg.graph(log)
    relations = {(r.src, r.dst): r.relation for r in dfg.footprint(g).collect()}
    pairs = conformance.alpha_pairs(relations, sorted({a for p in relations for a in p}))
    ends = dfg.diagram(log).filter("activity is not null").collect()  # one row for each activity
    starts, stops = {r.activity for r in ends if r.n_starts}, {r.activity for r in ends if r.n_ends}
    net = conformance.alpha_net(pairs, sorted(r.activity for r in ends), starts, stops)
    edges = [(r.src, r.dst) for r in g.select("src", "dst").collect()]
    return spark.createDataFrame([(writers.pnml(net), writers.bpmn(edges, starts, stops))], "pnml string, bpmn string")


def _stream_of_events(spark: SparkSession, d: str) -> DataFrame:
    at = f"{_place(spark)}-in"
    log_day(spark, d).select("case_id", "activity", "us", F.timestamp_micros("us").alias("ts"), "user_id").repartitionByRange(4, "us").write.parquet(at)
    return streams.stream_of(spark, at, "case_id string, activity string, us bigint, ts timestamp, user_id bigint")


@query("stream_tumbling_windows", f"with {LOG} select us // {H} * {H} as start_us, activity, count(*) as n from log group by 1, 2")
def stream_windows(spark: SparkSession, d: str) -> DataFrame:
    out = streams.finished(streams.windowed_counts(_stream_of_events(spark, d), "ts", "1 hour", "2 days"), "complete")
    return out.select(F.unix_micros("start").alias("start_us"), "activity", "n")


@query("stream_sessions", f"with {LOG}, f as (select *, case when us - lag(us) over (partition by user_id order by us, event_id) < 1800000000 then 0 else 1 end as fresh from log), s as (select user_id, us, sum(fresh) over (partition by user_id order by us, event_id) as s from f) select user_id, min(us) as start_us, count(*) as n from s group by user_id, s.s")
def stream_sessions(spark: SparkSession, d: str) -> DataFrame:
    out = streams.finished(streams.session_counts(_stream_of_events(spark, d), "ts", "user_id", "30 minutes", "60 days"), "complete")
    return out.select("user_id", F.unix_micros("start").alias("start_us"), "n")


@query("r2_in_progress_matching")
def r2(spark: SparkSession, d: str) -> DataFrame:
    t = streams.trie({"buy": ["view", "click", "purchase"], "join": ["view", "signup"]}, {"view"})
    rows = streams.finished(streams.match_in_progress(_stream_of_events(spark, d), t), "update")
    return rows.groupBy("case_id").agg(F.max_by("passing", "n_events").alias("passing"), F.max("n_events").alias("n_events"))


@query("r7_stream_monitor", f"""with {LOG}, c as (select case_id, min(us) filter (activity = 'view') as f, max(us) filter (activity = 'purchase') as l, max(us) as seen from log group by 1 having f is not null),
e as (select *, case when l >= f then l else seen end - f as elapsed_us from c) select case_id, case when elapsed_us > {2 * H} then 'violated' when l >= f then 'satisfied' else 'ticking' end as status, elapsed_us from e""")
def r7s(spark: SparkSession, d: str) -> DataFrame:
    """What the monitor last said of each case."""
    rows = streams.finished(streams.first_to_last_monitor(_stream_of_events(spark, d), "view", "purchase", 2 * H), "update")
    last = rows.groupBy("case_id").agg(F.max_by(F.struct("status", "elapsed_us"), "n_events").alias("x"))
    return last.select("case_id", "x.*").filter("status <> 'idle'")


@query("r15_late_bridges", f"with recursive {EDGES}, l as (select distinct a.event_id as u, b.event_id as v from e a join e b using (key)), r as (select u, v from l union select r.u, l.v from r join l on r.v = l.u) select u as event_id, min(v) as journey_id from r group by u")
def r15(spark: SparkSession, d: str) -> DataFrame:
    at = f"{_place(spark)}-edges"
    day_hour_edges(spark, d).repartition(2, "event_id").write.parquet(at)
    return streams.stitch_stream(streams.stream_of(spark, at, "event_id string, key string"), _place(spark))
