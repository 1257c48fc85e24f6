import pytest

from flowloom.operators import graph, relational
from flowloom.streaming import streams
from tests.conftest import rows


def union_find(pairs):
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for e, k in pairs:
        root[find("k" + k)] = find("e" + e)
    groups = {}
    for e in {e for e, _ in pairs}:
        groups.setdefault(find("e" + e), []).append(e)
    return sorted((e, min(g)) for g in groups.values() for e in g)


SHAPES = {
    "star": [(f"e{i:03d}", "hub") for i in range(60)],
    "chain": [(f"e{i:03d}", f"k{j}") for i in range(60) for j in (i, i + 1)],
    "bridge": [("web", "mail"), ("app", "phone"), ("back", "mail"), ("back", "phone"), ("alone", "x")],
    "two": [(f"e{i:03d}", f"k{i % 2}") for i in range(20)],
}


@pytest.mark.parametrize("shape", SHAPES)
def test_stitch(spark, shape):
    edges = spark.createDataFrame(SHAPES[shape], "event_id string, key string")
    assert rows(graph.stitch(edges)) == union_find(SHAPES[shape])


def test_incremental_equals_full(spark):
    data = SHAPES["chain"]
    full = spark.createDataFrame(data, "event_id string, key string")
    early = graph.stitch(spark.createDataFrame([d for d in data if d[0][-1] in "02468"], "event_id string, key string"))
    both = graph.stitch(full, prior=early)
    assert rows(both) == rows(graph.stitch(full))
    assert graph.aliases(early, both).count() == 29
    assert rows(graph.validate(both, graph.stitch(full))) == [(0, 0, 0, 0)]


def test_null_ids_and_keys_link_nothing(spark):
    edges = spark.createDataFrame([("a", None), ("b", None), (None, "k"), ("c", "k"), ("d", "k")], "event_id string, key string")
    assert rows(graph.stitch(edges)) == [("a", "a"), ("b", "b"), ("c", "c"), ("d", "c")]


@pytest.mark.parametrize("shape", SHAPES)
def test_batches_equal_one_stitch(spark, shape):
    """Three batches, the last one again: none, one and several journeys are touched; a redelivery adds nothing."""
    data = SHAPES[shape]
    state = graph.no_journeys(spark)
    parts = [data[2::3], data[0::3], data[1::3]]
    for part in (*parts, parts[-1]):
        added = graph.merge_batch(state, spark.createDataFrame(part, "event_id string, key string"))
        before = state.members.count()
        state = graph.merged(state, added)
    assert state.members.count() == before
    assert rows(state.current()) == union_find(data)
    assert state.members.select("event_id").distinct().count() == state.members.count()


def test_stream_goes_on_after_a_restart(spark, tmp_path):
    """Two starts over one folder: the second reads only the new file, and a lost commit only repeats its own batch."""
    schema, at, to = "event_id string, key string", str(tmp_path / "in"), str(tmp_path / "state")
    data = SHAPES["chain"]
    spark.createDataFrame(data[::2], schema).coalesce(1).write.mode("append").parquet(at)
    assert rows(streams.stitch_stream(streams.stream_of(spark, at, schema), to)) == union_find(data[::2])
    spark.createDataFrame(data[1::2], schema).coalesce(1).write.mode("append").parquet(at)
    assert rows(streams.stitch_stream(streams.stream_of(spark, at, schema), to)) == union_find(data)
    first = spark.read.parquet(f"{to}/members/0").count()
    assert first == len({e for e, _ in data[::2]}) and spark.read.parquet(f"{to}/members/1").count() == len({e for e, _ in data}) - first
    assert rows(streams.stitch_stream(streams.stream_of(spark, at, schema), to)) == union_find(data)
    assert rows(streams.committed_journeys(spark, str(tmp_path / "none")).current()) == []


def test_keys_hops_and_caps(spark):
    e = spark.createDataFrame([("a", [" 'K1' ", "k1", None, ""]), ("b", ["K1", "k2"]), ("c", ["k2", "k3"]), ("d", ["k3"]), ("z", None)], "event_id string, correlation_keys array<string>")
    edges = graph.key_edges(e)
    assert rows(edges) == [("a", "k1"), ("b", "k1"), ("b", "k2"), ("c", "k2"), ("c", "k3"), ("d", "k3")]
    assert rows(graph.within_two_hops(edges, spark.createDataFrame([("a",)], "event_id string"))) == [("a",), ("b",), ("c",)]
    assert graph.capped(edges, 1).count() == 0
    assert graph.stitch(edges.limit(0)).count() == 0


def test_reachable(spark):
    edges = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a"), ("c", "d")], "src string, dst string")
    assert rows(graph.reachable(edges, spark.createDataFrame([("a",)], "node string"), 2)) == [("a", 0), ("b", 1), ("c", 2)]


def test_maintenance(spark):
    t = spark.createDataFrame([("a", 1, "x"), ("b", None, "y")], "k string, v int, w string")
    n = spark.createDataFrame([("b", 5, None), ("c", 6, "z"), ("c", 6, "z")], "k string, v int, w string")
    assert rows(relational.insert_absent(t, n, ["k"])) == [("a", 1, "x"), ("b", None, "y"), ("c", 6, "z")]
    assert rows(relational.upsert(t, n.distinct(), ["k"])) == [("a", 1, "x"), ("b", 5, "y"), ("c", 6, "z")]
    assert rows(relational.update_from(t, n.distinct(), "k", "v")) == [("a", 1, "x"), ("b", 5, "y")]
    assert rows(relational.delete_keys(t, n, ["k"])) == [("a", 1, "x")]
    a = spark.createDataFrame([(1, ["x", "x", None]), (2, ["y"]), (3, None)], "id int, v array<string>")
    assert rows(relational.overlapping(a, a, "id", "v")) == [(1, 1), (2, 2)]
