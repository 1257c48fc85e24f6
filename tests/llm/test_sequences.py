from itertools import combinations, product

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from flowloom.llm import sequences
from flowloom.operators import logs
from tests.conftest import rows


def parts(events, k):
    """All subsequences of up to k steps with strictly growing instants."""
    out = {()}
    by_time = {}
    for t, c in events:
        by_time.setdefault(t, set()).add(c)
    steps = [by_time[t] for t in sorted(by_time)]
    for n in range(1, k + 1):
        for chosen in combinations(steps, n):
            out |= set(product(*chosen))
    return out


@settings(max_examples=200, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 9), st.integers(0, 2)), max_size=18, unique=True))
def test_reduction_keeps_all_short_subsequences(events):
    events = sorted(events)
    t, c = (np.array([e[i] for e in events], dtype=np.int64) for i in range(2))
    keep = sequences.reduced(t, c, 3, 3)
    assert parts(events, 3) == parts([e for e, k in zip(events, keep) if k], 3)


def test_reduction_shortens():
    t = np.arange(5000)
    assert sequences.reduced(t, t % 3, 3).sum() < 40


def brute(data, percent):
    cases = {}
    for c, a, t in data:
        cases.setdefault(c, set()).add((t, a))
    counts = {}
    for events in cases.values():
        for p in parts(sorted(events), 4):
            if len(p) >= 3:
                counts[p] = counts.get(p, 0) + 1
    return sorted(((">".join(p), n) for p, n in counts.items() if n * 100 >= percent * len(cases)), key=repr)


@pytest.mark.parametrize("hot", [20_000, 4])
def test_frequent_against_brute_force(spark, monkeypatch, hot):
    """Lists in several tasks; with cases whole, and cut into pieces that are joined two at a time."""
    monkeypatch.setattr(logs, "HOT_EVENTS", hot)
    monkeypatch.setattr(sequences, "JOINED_PIECES", 2)
    monkeypatch.setattr(sequences, "REDUCE_FROM", 5)
    rng = np.random.default_rng(2)
    data = [(f"c{i}", "abcde"[rng.integers(0, 5)], int(rng.integers(0, 6)) << 38) for i in range(40) for _ in range(rng.integers(1, 9))]
    data += [("hot", "ab"[i % 2], i << 36) for i in range(60)]
    df = spark.createDataFrame([*data, *data[:20]], "case_key string, activity_key string, instant_us bigint")
    assert rows(sequences.frequent(df, 10)) == brute(data, 10)


def closed_by_definition(lists, least):
    """Frequent patterns of any length that no frequent pattern of the same support holds."""
    counts = {}
    for steps in lists:
        for p in parts([(t, c) for t, step in enumerate(steps) for c in step], len(steps)) - {()}:
            counts[p] = counts.get(p, 0) + 1

    def held(p, q):
        rest = iter(q)
        return p != q and all(x in rest for x in p)

    often = {p: n for p, n in counts.items() if n >= least}
    return sorted((p, n) for p, n in often.items() if not any(n == m and held(p, q) for q, m in often.items()))


def test_closed_patterns_are_those_of_the_definition(spark):
    rng = np.random.default_rng(7)
    for _ in range(4):
        lists = [[sorted(set(rng.integers(0, 4, rng.integers(1, 3)).tolist())) for _ in range(rng.integers(1, 6))] for _ in range(12)]
        coded = [[2 * c + (i > 0) for step in steps for i, c in enumerate(step)] for steps in lists]
        df = spark.createDataFrame([(c, 1) for c in coded], "list array<int>, n bigint").repartition(3)
        assert sorted(sequences.closed_patterns(df, 4, 25, 12)) == closed_by_definition(lists, 3)


def test_ties_single_rows_and_empty(spark):
    schema = "case_key string, activity_key string, instant_us bigint"
    same = spark.createDataFrame([("a", x, 5) for x in "xyz"] + [("b", "x", 1)], schema)
    assert rows(sequences.frequent(same)) == []
    assert rows(sequences.frequent(same.limit(0))) == []
