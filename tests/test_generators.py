import pytest

from flowloom.operators import graph, stats, variants
from flowloom.sources import generators
from tests.conftest import rows


def test_generated_journeys_are_found(spark):
    for df in (generators.chained_journeys(spark, 4, 12, base_key=False), generators.bridged_journeys(spark, 5)):
        found = graph.stitch(graph.key_edges(df))
        assert rows(graph.validate(found, df.selectExpr("event_id", "cast(truth as string) as journey_id"))) == [(0, 0, 0, 0)]


def test_late_bridges_halve_the_journeys(spark):
    df = generators.bridged_journeys(spark, 6)
    early = graph.stitch(graph.key_edges(df.filter("phase = 1")))
    late = graph.stitch(graph.key_edges(df), prior=early)
    assert (graph.sizes(early).count(), graph.sizes(late).count()) == (12, 6)


def test_generated_logs(spark):
    log = generators.process_log(spark, 200)
    v = variants.variants(log)
    assert 8 < v.count() <= 16 and v.agg({"frequency": "sum"}).first()[0] == 200
    assert rows(log) == rows(generators.process_log(spark, 200))
    assert generators.hierarchical_log(spark, 5).filter("level_3 is not null and level_2 is null").count() == 0
    data = generators.cases_with_outliers(spark, 2000)
    found = stats.iqr_outliers(data, ["market"], "time_taken", 3.0)
    assert found.filter("is_outlier").count() == 40 and found.filter("not is_outlier").count() == 0


def test_sub_variants_and_orders(spark):
    log = spark.createDataFrame([("1", "a", 1, 1, "start"), ("1", "b", 2, 2, "start"), ("1", "a", 3, 3, "complete"), ("1", "b", 4, 4, "complete"), ("2", "a", 5, 1, "complete"), ("2", "b", 6, 2, "complete")], "case_id string, activity string, event_id bigint, us bigint, lifecycle string")
    assert rows(variants.sub_variants(log)) == [("a->b", "a+c->b+c", 1), ("a->b", "a+s->b+s->a+c->b+c", 1)]
    assert variants.linear_extensions("a->(b|c)", 10) == ["a->b->c", "a->c->b"]
    with pytest.raises(ValueError):
        variants.linear_extensions("(a|b|c)->(d|e|f)", 10)
    assert variants.with_custom(log, "new", ["x", "y"]).count() == 8


def test_pairwise_statistics(spark):
    df = spark.createDataFrame([(1.0, 1.0), (2.0, 3.0), (3.0, 2.0), (4.0, 4.0), (None, 1.0)], "x double, y double")
    assert abs(stats.kendall(df, "x", "y") - 4 / 6) < 1e-12
    ties = spark.createDataFrame([(1.0, 1.0), (1.0, 2.0), (2.0, 2.0)], "x double, y double")
    assert abs(stats.kendall(ties, "x", "y") - 0.5) < 1e-12
    assert stats.kendall(df.limit(0), "x", "y") is None
    assert abs(stats.studentised_range_survival(3.877, 3, 10) - 0.05) < 1e-3
    groups = spark.createDataFrame([(g, v + s) for g, s in (("a", 0.0), ("b", 0.1), ("c", 9.0)) for v in (1.0, 2.0, 3.0, 4.0)], "g string, v double")
    p = {(r.a, r.b): r.p for r in stats.tukey(groups, "g", "v").collect()}
    assert p[("a", "b")] > 0.9 and p[("a", "c")] < 0.001
