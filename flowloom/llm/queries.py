"""Queries of the operators for language-model training data."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from flowloom.functions.logs import usable_rows
from flowloom.llm import bpe, canonical, chunking, components, mixing, sequences
from flowloom.plans.training import USABLE
from flowloom.session import load


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return components.journeys(load(spark, sf_dir, "journey_events"), load(spark, sf_dir, "placeholder_keys"))


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return canonical.match(load(spark, sf_dir, "observed_fields"), load(spark, sf_dir, "dictionary_entries")).select("obs_id", "preferred_name")


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sequences.frequent(usable_rows(load(spark, sf_dir, "synthetic_event_log"), load(spark, sf_dir, "log_sites")))


def p8_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode(load(spark, sf_dir, "documents"))


def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.shortages(load(spark, sf_dir, "documents"), load(spark, sf_dir, "mix_targets")).filter("short").select("source")


def p9_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(load(spark, sf_dir, "documents"), load(spark, sf_dir, "mix_targets"))[0]


def p9_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(load(spark, sf_dir, "documents"), load(spark, sf_dir, "mix_targets"))[1]


def p10_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunking.split(load(spark, sf_dir, "documents")).filter("piece_no = 1").select("doc_id")


def p10_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunking.split(load(spark, sf_dir, "documents"))


QUERIES = {"p1_found": p1_found, "p4_found": p4_found, "p6_found": p6_found, "p8_ids": p8_ids, "p9_found": p9_found, "p9_mix": p9_mix, "p9_shares": p9_shares, "p10_found": p10_found, "p10_pieces": p10_pieces}
_KEY = """lower(trim({}, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13) || chr(160) || chr(12288) || chr(34) || chr(39)))"""
#: p4, p8, p9 and p10 need tokenizers or an edit distance with word forms and are tested by brute force instead.
SQL: dict[str, str] = {
    "p1_found": f"""with recursive r as (select row_number() over () as i, event_id, journey_id, correlation_keys from journey_events),
t as (select i, 'e:' || event_id as t from r where event_id is not null union all select i, 'j:' || journey_id from r where journey_id is not null
  union all select i, 'k:' || {_KEY.format('k')} from (select i, unnest(correlation_keys) as k from r) where k is not null and {_KEY.format('k')} not in (select {_KEY.format('placeholder')} from placeholder_keys) and {_KEY.format('k')} <> ''),
f as (select i, min(t) as h from t group by 1),
e as (select distinct h as a, t as b from t join f using (i) where h <> t),
two as (select a, b from e union select b, a from e),
cc(id, comp) using key (id) as (
  select distinct t, t from t
  union (select u.id, min(v.comp) from recurring.cc u join two on two.a = u.id join cc v on two.b = v.id where v.comp < u.comp group by u.id)),
g as (select id[3:] as event_id, comp from cc where id[1:2] = 'e:')
select event_id, min(event_id) over (partition by comp) as group_id from g""",
    "p6_found": f"""with {USABLE}, r as (select distinct c, a, us from usable where c is not null and a is not null), n as (select count(distinct c) as n from r),
r1 as (select * from r where a in (select a from r group by a having count(distinct c) * 100 >= 8 * (select n from n))),
l1 as (select c, a as p, min(us) as e from r1 group by 1, 2),
l2 as (select c, p || '>' || a as p, min(us) as e from l1 join r1 using (c) where us > e group by 1, 2),
k2 as (select p from l2 group by p having count(*) * 100 >= 8 * (select n from n)),
l3 as (select c, p || '>' || a as p, min(us) as e from (select * from l2 where p in (from k2)) join r1 using (c) where us > e group by 1, 2),
k3 as (select p, count(*) as support from l3 group by p having count(*) * 100 >= 8 * (select n from n)),
l4 as (select c, p || '>' || a as p from (select * from l3 where p in (select p from k3)) join r1 using (c) where us > e group by 1, 2)
select p as pattern, support from k3 union all select p, count(*) from l4 group by p having count(*) * 100 >= 8 * (select n from n)""",
}
