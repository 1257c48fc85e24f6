"""A case in pieces gives what the whole case gives, whatever the size from which cases are split."""

import random

import pytest
from pyspark.sql import functions as F

from flowloom.functions import ranks
from flowloom.operators import controls, dfg, logs, stats, variants
from tests.conftest import rows

SCHEMA = "case_id string, activity string, event_id bigint, us bigint, user_id bigint"


def log(spark):
    rng = random.Random(3)
    data = [("hot", rng.choice("abc"), i, rng.randrange(0, 4000), 1) for i in range(400)]
    data += [(f"c{i % 20}", rng.choice("abc"), 1000 + i, rng.randrange(0, 4000), i % 5) for i in range(120)]
    data += [("hot", None, 2000, 7, 1), ("hot", "a", 2001, None, 1), (None, "a", 3000, 5, None), (None, "b", 3001, 4, None), ("one", "a", 4000, 1, 9)]
    data += [("burst", rng.choice("ab"), 5000 + i, 50, 2) for i in range(60)]
    return spark.createDataFrame(data, SCHEMA)


QUESTIONS = {
    "next": lambda g: logs.with_next(g).select("case_id", "event_id", "next_activity", "next_us"),
    "milestones": lambda g: logs.running_milestones(g, "a"),
    "last_k": lambda g: logs.last_k(g, 3),
    "before": lambda g: logs.count_before(g, "b").select("case_id", "event_id", "n_before"),
    "sessions": lambda g: logs.sessions(g, "user_id", 20).select("user_id", "event_id", "session_no"),
    "variants": lambda g: variants.variants(g),
    "collapsed": lambda g: variants.collapsed(g),
    "dfg": lambda g: dfg.graph(g),
    "gaps": lambda g: controls.gaps_over(g, 30),
    "too few": lambda g: controls.too_few_before(g, "a", 3, "b"),
}


@pytest.mark.parametrize("name", QUESTIONS)
def test_pieces(spark, monkeypatch, name):
    whole = rows(QUESTIONS[name](log(spark)))
    monkeypatch.setattr(logs, "HOT_EVENTS", 25)
    assert logs.in_pieces(log(spark))[1]
    assert rows(QUESTIONS[name](log(spark))) == whole
    assert rows(QUESTIONS[name](log(spark).limit(0))) == []


def test_a_hot_case_is_cut_evenly(spark, monkeypatch):
    monkeypatch.setattr(logs, "HOT_EVENTS", 25)
    pieces, _ = logs.in_pieces(log(spark).filter("case_id = 'hot' and us is not null"))
    assert pieces.groupBy("__piece").count().agg({"count": "max"}).first()[0] <= 60


def test_running_totals(spark):
    rng = random.Random(1)
    data = [(g, v, 1 + rng.randrange(4)) for g in ("x", "y", None) for v in rng.sample(range(1000), 90)]
    got = {(r.g, r.v): r.below for r in ranks.running(spark.createDataFrame(data, "g string, v int, n int"), ["v"], F.col("n"), ["g"]).collect()}
    assert got == {(g, v): sum(n for h, w, n in data if h == g and w < v) for g, v, _ in data}
    every = sorted(v for _, v, _ in data)
    numbered = ranks.running(spark.createDataFrame(data, "g string, v int, n int").select("v", "g"), ["v", "g"]).collect()
    assert sorted(r.below for r in numbered) == list(range(len(every)))


def test_quantiles_equal_the_exact_percentile(spark):
    rng = random.Random(2)
    df = spark.createDataFrame([(rng.choice(["a", "b", None]), rng.choice([None, float(rng.randrange(50))])) for _ in range(300)] + [("solo", 3.0), ("none", None)], "g string, v double")
    want = {r.g: tuple(r.q) for r in df.filter("v is not null").groupBy("g").agg(F.expr("percentile(v, array(0.25, 0.75))").alias("q")).collect()}
    got = {r.g: (r.q0, r.q1) for r in stats.exact_quantiles(df, ["g"], "v", (0.25, 0.75)).collect()}
    assert {k: tuple(round(x, 9) for x in v) for k, v in got.items()} == {k: tuple(round(x, 9) for x in v) for k, v in want.items()}
