import itertools
import json

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from flowloom.operators import drift
from tests.conftest import rows


def records(spark, files, extra=()):
    data = [("f", "p", no, f"file{no}", json.dumps(b) if not isinstance(b, str) else b, "x") for no, bodies in files.items() for b in bodies]
    return spark.createDataFrame([*data, *extra], "feed string, producer string, file_no int, file_name string, body string, field string")


def test_changes(spark):
    ids = [f"{i:05d}" for i in range(40001, 40013)]
    one = [{"case_id": i, "who": w, "amount": 100 * (n + 3), "note": "x"} for n, (i, w) in enumerate(zip(ids, itertools.cycle(["ann", "bob", "eve"])))]
    two = [{"caseId": int(b["case_id"]), "who": {"name": b["who"]}, "amount": b["amount"], "flag": True} for b in one]
    three = [{"caseId": b["caseId"], "who": None, "amount": str(b["amount"]) + ".00"} for b in two]
    files = {1: [*one, '{"broken', "[1]", '"text"'], 2: [*two, *two], 5: three}
    got = rows(drift.changes(records(spark, files, [(None, "p", 1, "n", "{}", "x"), ("f", "p", 9, "file9", None, "x")])))
    assert got == sorted(
        [
            ("f", "file2", "renamed", "case_id", "caseId"), ("f", "file2", "type", "case_id", "caseId"), ("f", "file2", "removed", "note", ""), ("f", "file2", "added", "", "flag"), ("f", "file2", "type", "who", "who"),
            ("f", "file5", "removed", "flag", ""), ("f", "file5", "type", "amount", "amount"),
            ("f", "file9", "removed", "caseId", ""), ("f", "file9", "removed", "who", ""), ("f", "file9", "removed", "amount", ""),
        ],
        key=repr,
    )
    lineage = {(r.file_no, r.new_field): r.kind for r in drift.versions(records(spark, files)).filter("what = 'lineage'").collect()}
    assert lineage[(5, "caseId")] == lineage[(1, "case_id")] == "case_id@1"


def test_unified_table(spark):
    data = []
    for producer, names in (("p", ["case_id", "ref"]), ("q", ["ref", "ref"])):
        for no, name in enumerate(names, 1):
            data += [("f", producer, no, f"{producer}{no}", n, 100 * no + n, json.dumps({name: str(40000 + n % 4), "who": {"name": "ann"}, "tags": ["x", "y"], "z": None})) for n in range(12)]
    data += [("f", "p", 1, "p1", 99, 999, "{broken")]
    df = spark.createDataFrame(data, "feed string, producer string, file_no int, file_name string, line_no int, record_id bigint, body string")
    out = drift.unified(df, "f", {"f": {"case_id": "string", "amount": "double"}}).withColumn("extras", F.map_from_entries(F.transform(F.map_entries("extras"), lambda e: F.struct(e["key"], e["value"].cast("string"))))).collect()
    assert len(out) == 48 and all(r.case_id == str(40000 + r.line_no % 4) and r.amount is None for r in out)
    assert out[0].extras == {"who": '{"name":"ann"}', "tags": '["x","y"]', "z": None}


def test_a_target_looks_like_all_lineages_that_bear_its_name(spark):
    """260 producers bear the name; the words of a field without a name occur in the last sixty by hash only."""
    named = spark.range(260).select(F.format_string("n%03d", "id").alias("producer")).orderBy(F.xxhash64("producer", F.lit("status@1")))
    words = [(r.producer, "status", ["aa", "bb", "cc"] if i < 200 else ["open", "shut", "hold"]) for i, r in enumerate(named.collect())]
    data = [("f", p, 1, p, json.dumps({field: w})) for p, field, ws in [*words, ("z", "zz", ["open", "shut", "hold"])] for w in ws]
    df = spark.createDataFrame(data, "feed string, producer string, file_no int, file_name string, body string")
    got = {r.producer: (r.field, r.target) for r in drift.assignments(df, {"f": {"status": "string"}}).collect()}
    assert got == {p: (field, "status") for p, field, _ in words} | {"z": ("zz", "status")}


def test_one_shared_number_is_no_overlap_with_a_round_target(spark):
    """Waiting times of which one is an amount too, in a producer without amounts; an amount by another name is found."""
    took = [87, 800, 1470, 2397, 2444, 2632, 1592]
    data = [("f", f"n{n % 9}", n % 9, {"amount": n}) for n in range(100, 30100, 100)] + [("f", "y", 1, {"took": n}) for n in took] + [("f", "z", 1, {"sum": n}) for n in range(900, 29000, 400)]
    df = spark.createDataFrame([(f, p, no, p, json.dumps(b)) for f, p, no, b in data], "feed string, producer string, file_no int, file_name string, body string")
    got = {(r.producer, r.field) for r in drift.assignments(df, {"f": {"amount": "double"}}).collect()}
    assert got == {(f"n{i}", "amount") for i in range(9)} | {("z", "sum")}


def test_profiles_are_merged_alike_in_one_task_and_in_many(spark):
    rng = np.random.default_rng(5)
    data = []
    for i in range(700):
        n = int(rng.integers(0, 40))
        numbers = n if i % 7 else 0
        values = [int(v) for v in rng.integers(-(2**63), 2**63 - 1, drift.VALUE_HASHES)] if n else [None] * drift.VALUE_HASHES
        shapes = [int(v) if v % 3 else None for v in rng.integers(-(2**63), 2**63 - 1, drift.SHAPE_HASHES)]
        data.append((i % 2, n, n // 2, numbers, [float(v) for v in sorted(rng.integers(0, 9000, 2))] if numbers else None, int(rng.integers(0, 4)) if numbers else None, values, shapes))
    got = drift._merged_profiles(spark.createDataFrame(data, "g int, " + drift._PROFILE), "g").collect()
    assert len(got) == 2
    for r in got:
        want = drift._merged_profile([dict(zip(drift._PROFILE_FIELDS, d[1:])) for d in data if d[0] == r.g])
        assert {k: r[k] for k in drift._PROFILE_FIELDS} == want


def leaves(value, path=()):
    if isinstance(value, (dict, list)):
        for k, v in value.items() if isinstance(value, dict) else enumerate(value):
            yield from leaves(v, (*path, k))
        if not value:
            yield path, value
    else:
        yield path, value


SCALAR = st.one_of(st.none(), st.booleans(), st.integers(-(10**6), 10**6), st.text("ab 1", max_size=4), st.just("12.50 EUR"))
VALUE = st.recursive(SCALAR, lambda v: st.one_of(st.lists(v, max_size=3), st.dictionaries(st.sampled_from("xyz"), v, max_size=3)), max_leaves=5)


def test_no_leaf_is_lost(spark):
    """Every leaf of every body is found again, in its target column or in extras."""
    bodies = []

    @settings(max_examples=150, deadline=None)
    @given(st.dictionaries(st.sampled_from(["case_id", "amount", "note", "tags"]), VALUE, max_size=4))
    def collect(body):
        bodies.append(body)

    collect()
    df = spark.createDataFrame([("f", "p", 1, "p1", i, i, json.dumps(b)) for i, b in enumerate(bodies)], "feed string, producer string, file_no int, file_name string, line_no int, record_id bigint, body string")
    out = drift.unified(df, "f", {"f": {"case_id": "string", "amount": "double"}}).withColumn("extras", F.to_json("extras")).collect()
    assert len(out) == len(bodies)
    for r in out:
        body, extras = bodies[r.record_id], json.loads(r.extras)
        for path, leaf in leaves(body):
            if not path or path[0] in extras:
                assert not path or (path, leaf) in list(leaves(extras))
            elif path[0] == "amount":
                assert r.amount == leaf
            else:
                assert path == ("case_id",) and r.case_id == (None if leaf is None else str(leaf).lower() if isinstance(leaf, bool) else str(leaf))


def test_empty(spark):
    assert drift.changes(records(spark, {1: [{"a": 1}]}).limit(0)).count() == 0


def test_matching_is_optimal():
    rng = np.random.default_rng(3)
    for _ in range(200):
        a, b = rng.integers(1, 5, 2)
        w = np.where(rng.random((a, b)) < 0.5, rng.random((a, b)), 0)
        n = max(a, b)
        full = np.zeros((n, n))
        full[:a, :b] = w
        best = max(sum(full[i, p[i]] for i in range(n)) for p in itertools.permutations(range(n)))
        pairs = drift.best_matching(w)
        assert abs(sum(w[i, j] for i, j in pairs) - best) < 1e-9
        assert len({i for i, _ in pairs}) == len({j for _, j in pairs}) == len(pairs)
