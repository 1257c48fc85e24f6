import random

import pytest

from flowloom.llm import components
from tests.conftest import rows

SCHEMA = "event_id string, correlation_keys array<string>, journey_id string, group_id string"


def brute(data, void):
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for n, (event, keys, journey) in enumerate(data):
        row = ("r", n)
        find(row)
        tokens = [("e", event)] if event is not None else []
        tokens += [("j", journey)] if journey is not None else []
        tokens += [("k", f) for k in keys or [] if k is not None and (f := k.strip(" \t\n'\"").lower()) not in void and f]
        for t in tokens:
            root[find(t)] = find(row)
    best = {}
    for event, *_ in data:
        if event is not None:
            r = find(("e", event))
            best[r] = min(best.get(r, event), event)
    return sorted({(e, best[find(("e", e))]) for e, *_ in data if e is not None})


def run(spark, data, void=("", "n/a")):
    events = spark.createDataFrame([(*d, "x") for d in data], SCHEMA)
    places = spark.createDataFrame([(v,) for v in void], "placeholder string")
    return rows(components.journeys(events, places))


def test_edge_cases(spark):
    data = [
        ("e2", [" 'K1' ", None, "K1"], None), ("e1", ["k1"], None), ("e3", None, "j"), ("e4", [], "j"), ("e5", ["N/A", ""], None), ("e6", ["n/a"], None),
        ("e7", ["a"], None), ("e7", ["b"], None), ("e8", ["b"], None), (None, ["b", "c"], None), ("e9", ["C"], None), ("e1", ["k1"], None),
    ]
    got = run(spark, data)
    assert got == brute(data, {"", "n/a"})
    assert ("e9", "e7") in got and ("e2", "e1") in got and ("e5", "e5") in got
    assert run(spark, []) == []


@pytest.mark.parametrize("n", [40, 400])
def test_shapes(spark, n):
    """A chain, a hub, a cycle and noise; every round is distributed."""
    rng = random.Random(5)
    data = [(f"c{i:04d}", [f"l{i}", f"l{i + 1}"], None) for i in range(n)]
    data += [(f"h{i:04d}", ["hub"], None) for i in range(n)]
    data += [(f"o{i:04d}", [f"p{i}", f"p{(i + 1) % n}"], None) for i in range(n)]
    data += [(f"n{i:04d}", [f"q{rng.randrange(n)}"], None) for i in range(n)]
    rng.shuffle(data)
    assert run(spark, data) == brute(data, {"", "n/a"})


def test_hot_tokens_link_to_their_smallest_row(spark):
    tokens = spark.createDataFrame([(i, "k:hot") for i in range(300)] + [(i, f"k:{i}") for i in range(300)], "row bigint, token string")
    edges = components.linked_rows(tokens)
    assert rows(edges) == sorted([(i, 0) for i in range(1, 300)], key=repr)
    roots = components.components(edges)
    assert roots.count() == 300 and roots.select("root").distinct().count() == 1


def test_loops_and_repeats(spark):
    e = spark.createDataFrame([(1, 1), (2, 3), (3, 2), (2, 3), (None, 4), (5, 5), (3, 3)], "a bigint, b bigint")
    got = {r.v: r.root for r in components.components(e).collect()}
    assert set(got) == {1, 2, 3, 5} and got[2] == got[3] and len({got[1], got[2], got[5]}) == 3
