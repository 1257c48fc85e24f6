import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from flowloom.operators import intervals
from tests.conftest import rows


def brute(data):
    out = []
    for k in sorted({d[0] for d in data if d[0] is not None}):
        merged = []
        for s, e in sorted((s, e) for c, s, e in data if c == k and s is not None and e is not None and s <= e):
            if merged and s <= merged[-1][1]:
                merged[-1][1] = max(merged[-1][1], e)
            else:
                merged.append([s, e])
        out += [(k, "period", s, e) for s, e in merged] + [(k, "gap", a[1], b[0]) for a, b in zip(merged, merged[1:])]
    return sorted(out, key=repr)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 3), st.integers(0, 63), st.integers(0, 63)), max_size=30))
def test_runs_against_brute_force(data):
    data = [(g, a, b) for g, a, b in data if a < b]
    g, lo, hi = (np.array([d[i] for d in data], dtype=np.int64) for i in range(3))
    got = list(zip(*(x.tolist() for x in intervals.runs(g, lo, hi, 6))))
    want = []
    for k in sorted({d[0] for d in data}):
        cells = sorted({c for q, a, b in data if q == k for c in range(a, b)})
        for c in cells:
            if want and want[-1][0] == k and want[-1][2] == c:
                want[-1][2] = c + 1
            else:
                want.append([k, c, c + 1])
    assert got == [tuple(w) for w in want]


def test_blocks_are_canonical():
    g, s, k = intervals.dyadic_blocks(np.array([0]), np.array([3]), np.array([12]), 4)
    assert sorted(zip(s.tolist(), k.tolist())) == [(3, 0), (4, 2), (8, 2)]


def test_periods_and_gaps(spark):
    rng = np.random.default_rng(1)
    data = [("a", 0, 10), ("a", 10, 20), ("a", 21, 22), ("a", 30, 30), ("a", 5, 7), ("b", 5, 4), ("c", -7, -3), ("c", -3, 2), ("d", 0, 1 << 45), ("d", 3, 9), (None, 1, 2), ("e", None, 3), ("e", 1, 3), ("e", 1, 3)]
    data += [("h", int(s), int(s + d)) for s, d in zip(rng.integers(0, 1 << 30, 3000), rng.integers(0, 1 << 19, 3000))]
    df = spark.createDataFrame([(*d, "x") for d in data], "case_id string, start_us bigint, end_us bigint, kind string")
    for level in (4, 20, 40):
        part = [d for d in data if level > 4 or d[0] not in ("d", "h")]
        keep = df if level > 4 else df.filter("case_id is null or case_id not in ('d', 'h')")
        keep = keep if level == 40 else keep.filter("case_id is null or case_id <> 'd'")
        part = part if level == 40 else [d for d in part if d[0] != "d"]
        assert rows(intervals.periods_and_gaps(keep, "case_id", "start_us", "end_us", level)) == brute(part)
    assert intervals.periods_and_gaps(df.limit(0), "case_id", "start_us", "end_us").count() == 0


def test_waits(spark):
    data = [("c", "scanstart", 5), ("c", "scanbegin", 3), ("c", "scanend", 9), ("c", "scanfinish", 12), ("c", "latestart", 9), ("c", "lateend", 8), ("c", "openstart", 1), ("d", "zstart", 4), ("d", "zend", 4), ("d", "note", 1)]
    df = spark.createDataFrame(data, "case_key string, activity_key string, instant_us bigint")
    assert rows(intervals.waits(df)) == [("c", "scan", 3, 12), ("d", "z", 4, 4)]
