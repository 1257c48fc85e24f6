import random

import pytest

from flowloom.operators import conformance, dictionary, jobs
from flowloom.streaming import streams
from tests.conftest import rows

NET = conformance.net_from_edges([("a", "b"), ("b", "c")])


def test_foreign_activities_and_equal_labels_in_replay():
    assert conformance.replay(NET, ["a", "b", "c"]) == (4, 4, 0, 0)
    assert conformance.replay(NET, ["a", "zzz", "b", "c"]) == (5, 5, 1, 1)
    twice = conformance.Net((("t1", "a", frozenset({"initial"}), frozenset({"p"})), ("t2", "a", frozenset({"p"}), frozenset({"final"}))))
    assert conformance.replay(twice, ["a", "a"])[2:] == (0, 0)


def test_partial_alignments(spark):
    got = {r.variant: (r.prefix_cost, r.postfix_cost, r.infix_cost) for r in conformance.partial_alignments(spark.createDataFrame([("a",), ("b",), ("c",), ("x",), ("",), ("a->b->c",)], "variant string"), NET).collect()}
    assert got == {"a": (0, 1, 0), "b": (1, 1, 0), "c": (1, 0, 0), "x": (1, 1, 1), "": (0, 0, 0), "a->b->c": (0, 0, 0)}


def test_precision_counts_escaping_steps_once_for_each_case(spark):
    cases = spark.createDataFrame([("1", "a->b"), ("2", "a->b"), ("3", "x"), ("4", "")], "case_id string, variant string")
    # allowed: a for all four, b for two, c for two who never do it
    assert abs(conformance.escaping_precision(cases, NET).first()[0] - (1 - 2 / 8)) < 1e-12
    assert conformance.escaping_precision(cases.limit(0), NET).first()[0] == 1.0
    long = spark.createDataFrame([("1", "->".join("abc" * 20_000))], "case_id string, variant string")
    assert conformance.escaping_precision(long, NET).first()[0] == 1.0


def test_generalization(spark):
    log = spark.createDataFrame([("a",)] * 4 + [("b",)] * 16 + [("x",), (None,)], "activity string")
    assert abs(conformance.generalization(log, NET).first()[0] - (1 - (1 / 2 + 1 / 4 + 1) / 3)) < 1e-12


def test_repair_loop_stops(spark):
    cases = spark.createDataFrame([("1", "a->b->c->z"), ("2", "z->y")], "case_id string, variant string")
    net, history = conformance.repair_loop(cases, NET, 0.99)
    assert net.labels() == {"a", "b", "c", "y", "z"} and [h[0] for h in history] == [1, 2] and history[0][2] == 2
    good = spark.createDataFrame([("1", "a->b->c")], "case_id string, variant string")
    assert conformance.repair_loop(good, NET)[1] == [(1, 1.0, 0)]


def test_pairwise_merging_depends_on_the_order():
    one, back, again = [("a", "b")], [("b", "a")], [("a", "b")]
    assert conformance.merged_pairwise([one, back, again]) == {("a", "b")}
    assert conformance.merged_pairwise([one, again, back]) == set()


def test_trees_become_nets():
    net = conformance.net_from_tree("->(a, X(+(b, c), d), *(e, f))")
    fits = lambda t: conformance.align(net, list(t)) == 0
    assert all(map(fits, ["abce", "acbe", "ade", "adefe"])) and not any(map(fits, ["abe", "abcde", "adef", "e"]))
    assert conformance.is_sound(net)
    assert conformance.parsed_tree("X(a b, tau)") == ("X", ["a b", "tau"])


def test_tree_rows_and_growth():
    text, frozen = "->(a, X(b, +(c, d)), *(e, tau))", ["X(b, +(c, d))"]
    rows_ = conformance.tree_rows(text, frozen)
    assert conformance.tree_from_rows(reversed(rows_)) == (text, frozen)
    assert [r["label"] for r in rows_ if r["frozen"]] == ["X", "b", "+", "c", "d"]
    grown = conformance.extended_tree("->(a, b)", [["a", "b"], ["b"], ["b", "a"], ["b"], []])
    assert grown == "X(->(a, b), b, ->(b, a), tau)"
    assert all(conformance.align(conformance.net_from_tree(grown), v) == 0 for v in (["a", "b"], ["b"], ["b", "a"], []))


def test_roll_up_weights(spark):
    rows_ = [("r", None, None, None), ("a", "r", 1.0, 3), ("b", "r", 0.0, 1), ("c", "r", None, 9)]
    tree = spark.createDataFrame(rows_, "node string, parent string, value double, n int")
    assert conformance.rolled_up(tree)["r"] == 0.75 and conformance.rolled_up(tree, "equal")["r"] == 0.5


def test_common_length_is_that_of_the_matrix():
    rng = random.Random(4)
    for _ in range(300):
        a, b = ("".join(rng.choice("abc ") for _ in range(rng.randrange(12))) for _ in range(2))
        row = [0] * (len(b) + 1)
        for x in a:
            diagonal = 0
            for j, y in enumerate(b, 1):
                diagonal, row[j] = row[j], diagonal + 1 if x == y else max(row[j], row[j - 1])
        assert dictionary.common_length(a, b) == row[-1]


def test_blocks_of_names_give_what_one_gives(spark):
    names = ["account_number", "customer_name", "account_name", "birth_date", "due_date", "branch_code", "postal_code"]
    entries = spark.createDataFrame([(n, [n.replace("_", "")]) for n in names], "preferred_name string, aliases array<string>")
    queries = spark.createDataFrame([("accountNumber",), ("ACCOUNT_NUMBER",), ("acct name",), ("date",), ("code",), ("",), (None,)], "query string")
    assert rows(dictionary.match(queries, entries, 40.0, 3)) == rows(dictionary.match(queries, entries, 40.0, 3, block=3))


def test_store_and_use_case_job(spark, tmp_path):
    store = jobs.Store(spark, str(tmp_path / "store"))
    with pytest.raises(KeyError):
        store.get("x")
    assert store.put("x", spark.range(3)) == 1 and store.put("x", spark.range(5)) == 2 and store.get("x").count() == 5
    log = spark.createDataFrame([("c1", "a", 1, 1), ("c1", "b", 2, 2), ("c2", "a", 3, 1)], "case_id string, activity string, event_id bigint, us bigint")
    job = {"starts": ["a"], "finishes": ["b"], "target": str(tmp_path / "out")}
    assert jobs.run_use_case(log, job) == 1 and jobs.run_use_case(log, job) == 0


def test_silent_cases_expire(spark, tmp_path):
    """A case without its b is violated once the watermark passes its limit, though nothing more of it arrives."""
    schema, at = "case_id string, activity string, us bigint, ts timestamp", str(tmp_path / "in")
    hour = 3_600_000_000

    def put(data):
        from pyspark.sql import functions as F

        frame = spark.createDataFrame(data, "case_id string, activity string, us bigint")
        frame.withColumn("ts", F.timestamp_micros("us")).coalesce(1).write.mode("append").parquet(at)

    put([("silent", "a", hour), ("quick", "a", hour), ("quick", "b", hour + 1)])
    put([("other", "a", 50 * hour)])
    put([("other", "b", 50 * hour + 5)])
    stream = streams.stream_of(spark, at, schema).withWatermark("ts", "1 hour")
    out = streams.finished(streams.first_to_last_monitor(stream, "a", "b", 2 * hour, expiring=True), "update").collect()
    last = {}
    for r in sorted(out, key=lambda r: r.n_events):
        last[r.case_id] = r.status
    assert last["silent"] == "violated" and last["quick"] == "satisfied" and last["other"] == "satisfied"


def test_csv_keeps_texts(spark, tmp_path):
    from flowloom.sources import readers, writers

    data = [(1, " a,b "), (2, 'say "x"'), (3, "two\nlines"), (4, ""), (5, None), (6, "\ttab")]
    writers.write_csv(spark.createDataFrame(data, "i int, s string"), str(tmp_path / "csv"))
    assert rows(readers.read_csv(spark, str(tmp_path / "csv"), "i int, s string")) == sorted(data, key=repr)
    with pytest.raises(ValueError):
        readers.read_edges(spark, "unheard of", {})
