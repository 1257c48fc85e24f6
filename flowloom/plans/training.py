"""Queries of the general training-data operators: p2, p3, p5 and p7."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from flowloom.functions.logs import usable_rows
from flowloom.operators import drift, intervals, nested, timestamps
from flowloom.session import load

LOGS = ("synthetic_event_log", "sample_logs", "sample_agent_logs")


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = usable_rows(load(spark, sf_dir, "synthetic_event_log"), load(spark, sf_dir, "log_sites"), kind="async")
    return intervals.periods_and_gaps(intervals.waits(rows), "case_id", "start_us", "end_us")


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = [load(spark, sf_dir, t).select(F.lit(t).alias("log_name"), "row_id", "timestamp", "site") for t in LOGS]
    out = timestamps.normalise(reduce(DataFrame.unionByName, rows), load(spark, sf_dir, "log_sites"), ["log_name", "site"])
    return out.filter("utc_us is not null").select("log_name", "row_id", "utc_us")


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return drift.changes(load(spark, sf_dir, "feed_records"))


def _unified(feed: str):
    def one(spark: SparkSession, sf_dir: str) -> DataFrame:
        """The feed's table, with the names of the fields that are kept in extras."""
        table = drift.unified(load(spark, sf_dir, "feed_records"), feed)
        return table.withColumn("extras", F.array_join(F.array_sort(F.map_keys("extras")), ","))

    return one


def _subtype(kind: str):
    def one(spark: SparkSession, sf_dir: str) -> DataFrame:
        """The typed table of one structural variant."""
        table = nested.flatten(load(spark, sf_dir, "event_log"), "row_id", "event_id", "sub_activities").subtypes[kind]
        return table.drop("state").fillna(0, ["own_event_level"])

    return one


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The supertype: the union of the subtype tables."""
    nodes = nested.flatten(load(spark, sf_dir, "event_log"), "row_id", "event_id", "sub_activities").nodes
    return nodes.select("row_id", "node_path", F.col("parent_id").alias("parent_event_id"), F.col("node_id").alias("event_id"), "depth")


def p7_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many nodes the automaton leaves in each state."""
    nodes = nested.flatten(load(spark, sf_dir, "event_log"), "row_id", "event_id", "sub_activities").nodes
    return nodes.groupBy("state").agg(F.count(F.lit(1)).alias("n"))


_NODES = """second as (
  select row_id, event_id as parent, i, sub_activities[i] as n
  from (select row_id, event_id, sub_activities, unnest(range(1, len(sub_activities) + 1)) as i from event_log)
), seen as (select *, case when n.sub_activities is null then 'leaf' when len(n.sub_activities) = 0 then 'empty' when len(list_filter(n.sub_activities, lambda x: x is null)) > 0 then 'gappy' else 'branch' end as kind from second where n is not null),
third as (
  select row_id, n.event_id as parent, i, j, n.sub_activities[j] as m
  from (select row_id, n, i, unnest(range(1, len(n.sub_activities) + 1)) as j from seen)
), deep as (select * from third where m is not null)"""
_SECOND = """select row_id, cast(i as varchar) as node_path, coalesce(parent, '') as parent_id, coalesce(n.event_id, '') as node_id, 2 as depth,
  n.event_id as own_event_id, n.activity as own_activity, n."timestamp" as own_timestamp, coalesce(n.event_level, 0) as own_event_level"""
_THIRD = """select row_id, i || '.' || j as node_path, coalesce(parent, '') as parent_id, coalesce(m.event_id, '') as node_id, 3 as depth,
  m.event_id as own_event_id, m.activity as own_activity, m."timestamp" as own_timestamp, coalesce(m.event_level, 0) as own_event_level"""
_BITS = " || ".join(f"(case when {{0}}.{f} is null then '0' else '1' end)" for f in ("event_id", "activity", '"timestamp"', "event_level"))


_BLANKS = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13) || chr(160) || chr(12288)"


def instants_sql(rows: str) -> str:
    """CTEs ending in ``instants`` (rk, us): the instants of ``rows`` (a query giving rk, timestamp, site), one per rk.

    Written for DuckDB from the rules alone: one pattern for each notation, zones by its time zone functions.
    """
    stamp = lambda y, m, d: f"try_cast({y} || '-' || lpad({m}, 2, '0') || '-' || lpad({d}, 2, '0') as date)"
    months = "['jan','feb','mar','apr','may','jun','jul','aug','sep','oct','nov','dec']"
    time = r"([0-9]{1,2}):?([0-9]{2})(?::?([0-9]{2}))?(?:[.,]([0-9]{1,9}))? ?([AaPp][Mm])?\s*(Z|z|[+-][0-9]{2}:?[0-9]{2}|[A-Za-z]{2,5})?(?:\[([^\]]*)\])?$"
    return f"""raw as ({rows}),
t0 as (select r.rk, trim(r."timestamp", {_BLANKS}) as t, s.tz_name as tz, s.day_first as df from raw r left join (select site, min(tz_name) as tz_name, min(day_first) as day_first from log_sites group by 1) s on r.site = s.site),
t1 as (select *, case
    when regexp_matches(t, '^[0-9]{{4}}-[0-9]{{1,2}}-[0-9]{{1,2}}[Tt ]') then 'iso' when regexp_matches(t, '^[0-9]{{1,2}}/[0-9]{{1,2}}/[0-9]{{4}} ') then 'slash'
    when regexp_matches(t, '^[0-9]{{1,2}}[.][0-9]{{1,2}}[.][0-9]{{4}} ') then 'dot' when regexp_matches(t, '^([A-Za-z]{{3,9}}, ?)?[0-9]{{1,2}} [A-Za-z]{{3,9}}[.]? [0-9]{{4}} ') then 'named'
    when regexp_matches(t, '^[0-9]{{8}}[Tt]') then 'basic' when regexp_matches(t, '^[0-9]{{1,15}}$') then 'digits' end as k from t0),
t2 as (select *, case k when 'iso' then regexp_extract(t, '^([0-9-]+)[Tt ](.*)$', 2) when 'basic' then t[10:] when 'named' then regexp_extract(t, '^(?:[A-Za-z]{{3,9}}, ?)?[0-9]{{1,2}} [A-Za-z]{{3,9}}[.]? [0-9]{{4}} (.*)$', 1) when 'digits' then null else regexp_extract(t, '^[^ ]+ (.*)$', 1) end as rest,
  case k when 'iso' then {stamp("split_part(t, '-', 1)", "split_part(t, '-', 2)", "regexp_extract(split_part(t, '-', 3), '^[0-9]+')")}
    when 'slash' then case when df then {stamp("t_y", "t_b", "t_a")} when not df then {stamp("t_y", "t_a", "t_b")} end
    when 'dot' then {stamp("regexp_extract(t, '[.]([0-9]{4}) ', 1)", "split_part(t, '.', 2)", "split_part(t, '.', 1)")}
    when 'named' then {stamp("regexp_extract(t, ' ([0-9]{4}) ', 1)", f"cast(nullif(list_position({months}, lower(regexp_extract(t, '[0-9] ([A-Za-z]{{3}})', 1))), 0) as varchar)", "regexp_extract(t, '([0-9]{1,2}) [A-Za-z]', 1)")}
    when 'basic' then {stamp("t[1:4]", "t[5:6]", "t[7:8]")} end as day
  from (select *, split_part(t, '/', 1) as t_a, split_part(t, '/', 2) as t_b, t_split[1:4] as t_y from (select *, split_part(t, '/', 3) as t_split from t1))),
t3 as (select *, regexp_extract(rest, '^{time}', ['h', 'mi', 's', 'f', 'half', 'zone', 'region']) as p, regexp_matches(rest, '^{time}') as ok from t2),
t4 as (select *, cast(p.h as int) as h0, upper(p.zone) as z from t3 where k <> 'digits' and ok and day is not null),
t5 as (select *, case when p.half = '' then h0 when h0 between 1 and 12 then h0 % 12 + case when lower(p.half) = 'pm' then 12 else 0 end end as h from t4),
t6 as (select *, epoch_us(cast(day as timestamp)) + (h * 3600 + cast(p.mi as bigint) * 60 + coalesce(try_cast(p.s as bigint), 0)) * 1000000 + cast(rpad(p.f[1:6], 6, '0') as bigint) as l
  from t5 where h <= 23 and cast(p.mi as int) <= 59 and coalesce(try_cast(p.s as int), 0) <= 59),
t7 as (select *, make_timestamp(l) as lt, case when tz is not null then make_timestamp(epoch_us(timezone(tz, make_timestamp(l)))) end as u1, make_timestamp(epoch_us(date_trunc('year', make_timestamp(l)))) as y from t6),
t8 as (select *, case when tz is not null then greatest(epoch_us(y) + 14 * 86400000000 - epoch_us(timezone(tz, y + interval 14 days)), epoch_us(y) + 195 * 86400000000 - epoch_us(timezone(tz, y + interval 195 days))) end as off_s,
  case when tz is not null then least(epoch_us(y) + 14 * 86400000000 - epoch_us(timezone(tz, y + interval 14 days)), epoch_us(y) + 195 * 86400000000 - epoch_us(timezone(tz, y + interval 195 days))) end as off_w,
  regexp_replace(z, '[^0-9]', '', 'g') as digits from t7),
t9 as (select rk, case when z in ('Z', 'UTC', 'GMT', 'UT') then l
    when regexp_matches(z, '^[+-]') then case when cast(digits[1:2] as int) * 60 + cast(digits[3:4] as int) <= 1080 then l - (case when z[1] = '-' then -1 else 1 end) * (cast(digits[1:2] as bigint) * 60 + cast(digits[3:4] as bigint)) * 60000000 end
    when z <> '' then l - case when regexp_matches(z, '^([A-Z]+DT|[CEW]EST|BST)$') then off_s else off_w end
    when p.region <> '' and p.region is distinct from tz then null
    when timezone(tz, timezone('UTC', u1 - interval 1 hour)) = lt then epoch_us(u1 - interval 1 hour)
    when timezone(tz, timezone('UTC', u1)) = lt then epoch_us(u1) end as us from t8
  union all select rk, case when length(t) <= 11 then cast(t as bigint) * 1000000 else cast(t as bigint) * 1000 end from t1 where k = 'digits'),
instants as (select rk, us from t9 where us is not null)"""


#: Names that the applications use for the fields, read off the feeds; written independently of the matching.
_NAMES = {
    "sample_logs": {
        "event_id": ("event_id", "eventId", "evt", "entry_key"),
        "timestamp": ("timestamp", "ts", "eventTime", "logged_at"),
        "case_id": ("case_id", "caseId", "CASE_NO", "request_ref", "file_number"),
        "activity": ("activity", "activityLabel", "action", "step_name"),
        "resource": ("resource", "actor", "handled_by"),
        "amount": ("amount", "amt", "sum_requested"),
    },
    "sample_agent_logs": {
        "timestamp": ("timestamp", "ts", "at", "recorded_on"),
        "task_id": ("task_id", "taskId", "TASK", "job_ref", "work_item"),
        "activity": ("activity", "activity_title", "step", "doing"),
        "agent_name": ("agent_name", "agentName", "agent", "bot", "performed_by"),
        "tool_used": ("tool_used", "tool", "instrument"),
        "status": ("status", "outcome", "result_state"),
    },
}


def _unified_sql(feed: str) -> str:
    """The first scalar of an object is that of its smallest key, as variants order keys; amounts may carry a unit."""
    names = _NAMES[feed]
    columns, held = [], []
    for target, known in names.items():
        found = "coalesce(" + ", ".join(f"json_extract(b, '$.\"{n}\"')" for n in known) + ")"
        text = f"case json_type({found}) when 'NULL' then null when 'OBJECT' then ({found} ->> ('$.\"' || list_sort(json_keys({found}))[1] || '\"')) when 'ARRAY' then array_to_string({found} ->> '$[*]', ',') else {found} ->> '$' end"
        columns.append(f"{text} as \"{target}\"" if target != "amount" else f"try_cast(regexp_extract(lower(trim({text})), '^([+-]?[0-9]+([.][0-9]+)?) *[a-z%]{{0,4}}$', 1) as double) as amount")
        whole = "('NULL', 'VARCHAR', 'BOOLEAN', 'BIGINT', 'UBIGINT', 'DOUBLE')" if target != "amount" else "('NULL', 'BIGINT', 'UBIGINT', 'DOUBLE')"
        held += [f"case when json_type(b, '$.\"{n}\"') in {whole} then '{n}' end" for n in known]
    return f"""with r as (select record_id, producer, file_name, line_no, case when json_valid(body) then body::json end as b from feed_records where feed = '{feed}'),
o as (select * from r where json_type(b) = 'OBJECT')
select record_id, producer, file_name, line_no, {', '.join(columns)},
  array_to_string(list_sort(list_filter(json_keys(b), lambda k: not list_contains([{', '.join(held)}], k))), ',') as extras from o"""


#: The same for the fields that no table has.
_OTHERS = (("region_code", "area"), ("channel", "inbound_via"), ("note", "remark"), ("tag_list", "labels"), ("is_manual", "by_hand"), ("latency_ms", "tookMillis"))


def _changes_sql() -> str:
    """Changes between neighbouring files, renames by the names that stand for one field."""
    known = [(f, t, n) for f, ts in _NAMES.items() for t, ns in ts.items() for n in ns] + [(f, ns[0], n) for f in _NAMES for ns in _OTHERS for n in ns]
    values = ", ".join(f"('{f}', '{g}', '{n}')" for f, g, n in known)
    return f"""with g(feed, grp, name) as (values {values}),
r as (select feed, producer, file_no, file_name, case when json_valid(body) then body::json end as b from feed_records where feed is not null and producer is not null and file_no is not null),
f as (select feed, producer, file_no, min(file_name) as file_name from r group by 1, 2, 3),
p as (select *, lag(file_no) over (partition by feed, producer order by file_no) as before from f),
k as (select feed, producer, file_no, b, unnest(json_keys(b)) as name from r where json_type(b) = 'OBJECT'),
t as (select feed, producer, file_no, name, case json_type(b, '$."' || name || '"') when 'NULL' then null when 'VARCHAR' then 'string' when 'BOOLEAN' then 'boolean' when 'OBJECT' then 'object' when 'ARRAY' then 'array' else 'number' end as kind from k),
h as (select feed, producer, file_no, name, list_sort(list(distinct kind) filter (kind is not null)) as kinds from t group by 1, 2, 3, 4),
gone as (select p.feed, p.producer, p.file_no, p.file_name, h.name, h.kinds, coalesce(g.grp, h.name) as grp from p join h on h.feed = p.feed and h.producer = p.producer and h.file_no = p.before left join g on g.feed = h.feed and g.name = h.name
  where not exists (select 1 from h x where x.feed = p.feed and x.producer = p.producer and x.file_no = p.file_no and x.name = h.name)),
fresh as (select p.feed, p.producer, p.file_no, p.file_name, h.name, h.kinds, coalesce(g.grp, h.name) as grp from p join h on h.feed = p.feed and h.producer = p.producer and h.file_no = p.file_no left join g on g.feed = h.feed and g.name = h.name
  where p.before is not null and not exists (select 1 from h x where x.feed = p.feed and x.producer = p.producer and x.file_no = p.before and x.name = h.name)),
moved as (select a.feed, a.producer, a.file_no, a.file_name, a.name as o, b.name as n, a.kinds as ok, b.kinds as nk from gone a join fresh b using (feed, producer, file_no, grp)),
same as (select p.feed, p.file_name, a.name as o, a.kinds as ok, b.kinds as nk from p join h a on a.feed = p.feed and a.producer = p.producer and a.file_no = p.before join h b on b.feed = p.feed and b.producer = p.producer and b.file_no = p.file_no and b.name = a.name)
select feed, file_name, 'renamed' as change_kind, o as old_field, n as new_field from moved
union all select feed, file_name, 'removed', name, '' from gone where (feed, producer, file_no, name) not in (select (feed, producer, file_no, o) from moved)
union all select feed, file_name, 'added', '', name from fresh where (feed, producer, file_no, name) not in (select (feed, producer, file_no, n) from moved)
union all select feed, file_name, 'type', o, n from moved where len(ok) > 0 and len(nk) > 0 and ok <> nk
union all select feed, file_name, 'type', o, o from same where len(ok) > 0 and len(nk) > 0 and ok <> nk"""


QUERIES = {"p2_found": p2_found, "p3_found": p3_found, "p3_sample_logs": _unified("sample_logs"), "p3_sample_agent_logs": _unified("sample_agent_logs"), "p5_found": p5_found, "p7_found": p7_found, "p7_branches": _subtype("branch"), "p7_leaves": _subtype("leaf"), "p7_empty": _subtype("empty"), "p7_gappy": _subtype("gappy"), "p7_states": p7_states}
_ALL_LOGS = " union all ".join(f"select ('{t}', row_id) as rk, \"timestamp\", site from {t}" for t in LOGS)
#: Usable rows of the event log: case, activity and instant.
USABLE = (
    instants_sql('select row_id as rk, "timestamp", site from synthetic_event_log')
    + f""", usable as (select lower(trim(case_id, {_BLANKS})) as c, nullif(regexp_replace(lower(activity), '[^\\p{{L}}\\p{{Nd}}]', '', 'g'), '') as a, us, lower(trim("type", {_BLANKS})) as ty
  from synthetic_event_log join instants on row_id = rk where case_id is not null and activity is not null)"""
)
SQL: dict[str, str] = {
    "p5_found": f"with {instants_sql(_ALL_LOGS)} select rk[1] as log_name, rk[2] as row_id, us as utc_us from instants",
    "p2_found": f"""with {USABLE},
e as (select c, regexp_extract(a, '^(.*)(start|begin|end|finish)$', ['w', 'x']) as m, us from usable where ty = 'async' and regexp_matches(a, '(start|begin|end|finish)$')),
w as (select c, m.w as w, min(us) filter (m.x in ('start', 'begin')) as s, max(us) filter (m.x in ('end', 'finish')) as e from e group by 1, 2 having s <= e),
o as (select *, max(e) over (partition by c order by s, e rows between unbounded preceding and 1 preceding) as before from w),
i as (select *, sum(case when before >= s then 0 else 1 end) over (partition by c order by s, e) as island from o),
p as (select c, island, min(s) as s, max(e) as e from i group by 1, 2),
n as (select *, lead(s) over (partition by c order by s) as nx from p)
select c as case_id, 'period' as kind, s as start_us, e as end_us from n union all select c, 'gap', e, nx from n where nx is not null""",
    "p3_found": _changes_sql(),
    "p3_sample_logs": _unified_sql("sample_logs"),
    "p3_sample_agent_logs": _unified_sql("sample_agent_logs"),
    "p7_branches": f"with {_NODES} {_SECOND}, cast(len(n.sub_activities) as integer) as n_children from seen where kind = 'branch'",
    "p7_gappy": f"with {_NODES} {_SECOND}, cast(len(n.sub_activities) as integer) as n_children from seen where kind = 'gappy'",
    "p7_empty": f"with {_NODES} {_SECOND} from seen where kind = 'empty'",
    "p7_leaves": f"with {_NODES} {_SECOND} from seen where kind = 'leaf' union all {_THIRD} from deep",
    "p7_states": f"""with {_NODES}, s as (
select kind || '[' || (case when kind in ('leaf', 'empty') then '' else (case when len(list_filter(n.sub_activities, lambda x: x is not null)) > 0 then 'leaf' else '' end)
  || (case when kind = 'gappy' and len(list_filter(n.sub_activities, lambda x: x is not null)) > 0 then '|' else '' end) || (case when kind = 'gappy' then 'null' else '' end) end) || ']:' || {_BITS.format('n')} as state from seen
union all select 'leaf[]:' || {_BITS.format('m')} from deep)
select state, count(*) as n from s group by 1""",
    "p7_found": """
with second as (
  select row_id, event_id as parent, i as i, sub_activities[i] as n
  from (select row_id, event_id, sub_activities, unnest(range(1, len(sub_activities) + 1)) as i from event_log)
), seen as (select * from second where n is not null),
third as (
  select row_id, n.event_id as parent, i, j, n.sub_activities[j] as m
  from (select row_id, n, i, unnest(range(1, len(n.sub_activities) + 1)) as j from seen)
)
select row_id, cast(i as varchar) as node_path, coalesce(parent, '') as parent_event_id, coalesce(n.event_id, '') as event_id, 2 as depth from seen
union all
select row_id, i || '.' || j, coalesce(parent, ''), coalesce(m.event_id, ''), 3 from third where m is not null
""",
}
