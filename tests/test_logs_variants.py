import pytest
from pyspark.sql import functions as F

from flowloom.operators import controls, dfg, logs, variants
from tests.conftest import rows

SCHEMA = "case_id string, activity string, event_id bigint, us bigint"
DATA = [("a", "x", 1, 10), ("a", "y", 2, 10), ("a", "x", 3, 20), ("a", "y", 4, 30), ("b", "x", 5, 5), ("c", "x", 6, 1), ("c", "x", 7, 2), ("c", "z", 8, 3)]


@pytest.fixture
def log(spark):
    return spark.createDataFrame(DATA, SCHEMA)


def test_variants(log):
    got = {r.variant: (r.frequency, r.length, r.pct, r.max_us) for r in variants.variants(log).collect()}
    assert got == {"x->y->x->y": (1, 4, 33.33, 20), "x": (1, 1, 33.33, 0), "x->x->z": (1, 3, 33.33, 2)}
    assert [r.name for r in variants.numbered(variants.variants(log)).orderBy("n").collect()] == ["Variant_1", "Variant_2", "Variant_3"]
    assert variants.variants(log.limit(0)).count() == 0


def test_input_order_does_not_matter(spark, log):
    again = spark.createDataFrame(DATA[::-1], SCHEMA)
    assert rows(variants.variants(log)) == rows(variants.variants(again))


@pytest.mark.parametrize(
    ("steps", "merged", "marked"),
    [(["A", "B", "A", "B"], ["A||B", "A||B"], ["A||B*"]), (["A", "A", "B"], ["A", "A||B"], ["A", "A||B"]), (["A"], ["A"], ["A"]), ([], [], []), (["A", "A", "A"], ["A", "A", "A"], ["A*"])],
)
def test_reductions(spark, steps, merged, marked):
    df = spark.createDataFrame([(steps,)], "s array<string>")
    assert df.select(variants.merge_neighbours(F.col("s"))).first()[0] == merged
    assert df.select(variants.mark_cycles(variants.merge_neighbours(F.col("s")))).first()[0] == marked


def test_cycle_mark_goes_to_the_last_kept(spark):
    df = spark.createDataFrame([(["A", "B", "C", "A"],)], "s array<string>")
    assert df.select(variants.mark_cycles(F.col("s"))).first()[0] == ["A", "B", "C*"]


def test_collapse_and_concurrency(log):
    assert {r.collapsed for r in variants.collapsed(log).collect()} == {"x->y->x->y", "x", "x+->z"}
    assert {r.concurrency_variant for r in variants.concurrency(log, 5).collect()} == {"(x|y)->x->y", "x", "(x|x|z)"}


def test_filters(log):
    assert rows(logs.cases_by_ends(log, ["x"], ["z"]).select("case_id").distinct()) == [("c",)]
    assert rows(logs.cases_eventually(log, "y", "x").select("case_id").distinct()) == [("a",)]
    assert rows(logs.cases_directly(log, "x", "z").select("case_id").distinct()) == [("c",)]
    assert rows(logs.completed_cases(log, ["z"], ["x"])) == [("c",)]
    assert logs.matching(log, {"activity": "all"}).count() == len(DATA)
    assert rows(logs.running_milestones(log, "y").filter("case_id = 'a'").select("event_id", "n_seen")) == [(1, 0), (2, 1), (3, 1), (4, 2)]
    assert rows(logs.last_k(log, 2).filter("case_id = 'c'").select("last_k")) == [("x",), ("x>x",), ("x>z",)]


def test_projection_errors_and_nulls(spark, log):
    with pytest.raises(ValueError):
        logs.canonical(log, {"case_id": "case_id"})
    with pytest.raises(ValueError):
        logs.at_level(log, 4)
    df = spark.createDataFrame([("v", None), (None, "w"), (None, None)], "old string, new string")
    assert rows(logs.rename_attribute(df, "old", "new")) == [("v",), ("w",), (None,)]
    odd = spark.createDataFrame([("a", None, 1, 1), ("a", "x", 2, None), (None, "x", 3, 3)], SCHEMA)
    assert [(r.variant, r.frequency, r.pct) for r in variants.variants(odd).collect()] == [("x", 2, 100.0)]
    assert logs.without_activities(odd, ["x"]).count() == 1


def test_interval_pairs(spark):
    df = spark.createDataFrame([("a", "t", 1, 1, "start"), ("a", "t", 2, 4, "complete"), ("a", "t", 3, 6, "complete")], SCHEMA + ", lifecycle string")
    assert rows(logs.paired_intervals(df).select("n", "start_us", "end_us")) == [(1, 1, 4), (2, 6, 6)]


def test_graph(log):
    edges = dfg.graph(log)
    assert rows(edges.select("src", "dst", "frequency")) == [("x", "x", 1), ("x", "y", 2), ("x", "z", 1), ("y", "x", 1)]
    assert {(r.src, r.dst): r.dependency for r in dfg.heuristics(edges).collect()}[("x", "y")] == 0.25
    assert {(r.src, r.dst): r.relation for r in dfg.footprint(edges).collect()} == {("x", "x"): "||", ("x", "y"): "||", ("y", "x"): "||", ("x", "z"): "->", ("z", "x"): "<-"}
    assert rows(dfg.without_reversed(dfg.partial_order_edges(log))) == [("x", "z")]


def test_controls(log):
    assert rows(controls.first_to_last(log, "x", "y", 15)) == [("a", 20)]
    assert rows(controls.forbidden_after(log, "y", "x")) == [("a",)]
    assert rows(controls.too_few_before(log, "y", 1, "x")) == [("a", 0), ("b", 0), ("c", 0)]
    assert rows(controls.gaps_over(log, 9)) == [("a", 2, 10), ("a", 3, 10)]
    assert rows(controls.loops_over(log, 1)) == [("a", "x", 2), ("a", "y", 2), ("c", "x", 2)]
    assert dict(rows(controls.status(log, "x", "y", 100, 96))) == {"a": "satisfied", "b": "at_risk", "c": "at_risk"}
