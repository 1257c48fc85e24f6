"""Frequent subsequences by closed-pattern mining over pseudo-projections.

A case is a list of steps, the activities of one instant being one step, and a pattern's activities must lie in later
and later steps. Only activities that are frequent themselves are kept. A case too long for one task is cut into
pieces of time; each is reduced to a shorter list with the same subsequences of up to LONGEST steps, and since that
equivalence survives concatenation, so are the pieces together, level by level. Equal lists are mined once, with their
number. The closed patterns are those of these lists; every pattern of up to LONGEST steps has the same support in
them as in the log, and that support is the largest of a closed pattern that holds it.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowloom.operators.logs import in_pieces
from flowloom.session import cut, spread

SHORTEST, LONGEST = 3, 4
#: A list of more events than this is reduced.
REDUCE_FROM = 48
#: Pieces of a case that are joined and reduced again at a time.
JOINED_PIECES = 16


def reduced(steps: np.ndarray, codes: np.ndarray, n_codes: int, k: int = LONGEST) -> np.ndarray:
    """Which events to keep, so that the lists have the same subsequences of up to k steps.

    ``steps`` ascend. The rank of an event is the longest length up to which every subsequence that ends with it also
    ends with an earlier event of its kind; an event is needless if its ranks from both sides add up to k.
    """

    def ranks(order: range, keep: np.ndarray, other: np.ndarray | None) -> np.ndarray:
        rank, least = np.zeros(len(codes), dtype=np.int64), np.full(n_codes, -1, dtype=np.int64)
        i, at = 0, list(order)
        while i < len(at):
            j = i
            while j < len(at) and steps[at[j]] == steps[at[i]]:
                j += 1
            group = [e for e in at[i:j] if keep[e]]
            for e in group:
                rank[e] = min(k, least[codes[e]] + 1) if least[codes[e]] >= 0 else 0
            if other is not None:
                for e in group:
                    keep[e] = rank[e] + other[e] < k
                group = [e for e in group if keep[e]]
            if group:
                low = min(rank[e] for e in group)
                np.minimum(least, low, out=least, where=least >= 0)
                least[[codes[e] for e in group]] = low
            i = j
        return rank

    keep = np.ones(len(codes), dtype=bool)
    forward = ranks(range(len(codes)), keep, None)
    ranks(range(len(codes) - 1, -1, -1), keep, forward)
    return keep


def _reduce_arrays(n_codes: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for times, codes in zip(pdf["t"], pdf["c"]):
                times, codes = np.asarray(times, dtype=np.int64), np.asarray(codes, dtype=np.int64)
                if len(codes) > REDUCE_FROM:
                    keep = reduced(times, codes, n_codes)
                    times, codes = times[keep], codes[keep]
                out.append((times, codes))
            yield pd.DataFrame({"case_key": pdf["case_key"], "piece": pdf["piece"], "t": [t for t, _ in out], "c": [c.astype(np.int32) for _, c in out]})

    return run


def _encoded(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Lists as numbers: twice the code, plus one if the event is of the same instant as the one before."""
    for pdf in batches:
        lists = []
        for times, codes in zip(pdf["t"], pdf["c"]):
            times, codes = np.asarray(times, dtype=np.int64), np.asarray(codes, dtype=np.int32)
            lists.append(2 * codes + np.r_[False, times[1:] == times[:-1]][: len(codes)].astype(np.int32))
        yield pd.DataFrame({"list": lists})


class Lists:
    """Lists with tables of the next and the last place of every code, for pseudo-projection."""

    def __init__(self, flat: np.ndarray, sizes: np.ndarray, weights: np.ndarray, n_codes: int) -> None:
        """``flat`` are the encoded lists one after another, ``sizes`` their lengths, all above 0."""
        codes, starts = flat >> 1, np.r_[0, np.cumsum(sizes)[:-1]]
        fresh = (flat & 1) == 0
        fresh[starts] = True
        number = np.repeat(np.arange(len(sizes)), sizes)
        place = np.cumsum(fresh) - 1 + number  # one place a step, and one behind each list
        self.first = place[starts]
        self.stop = place[starts + sizes - 1] + 1
        self.weights, self.n_codes = weights, n_codes
        n = int(self.stop[-1]) + 1 if len(sizes) else 0
        self.none = n + 1
        own = np.repeat(np.arange(len(sizes)), self.stop - self.first + 1)
        own = np.r_[own, own[-1:]]
        first, stop = self.first[own], self.stop[own]
        at = np.arange(n + 1) if n else np.arange(0)
        #: next[p, c]: first place >= p of code c in the list; last[p, c]: last place < p, or -1
        self.next = np.full((len(at), n_codes), self.none, dtype=np.int32)
        self.last = np.full((len(at), n_codes), -1, dtype=np.int32)
        for c in range(n_codes if n else 0):
            mark = np.zeros(len(at), dtype=np.int32)
            mark[place[codes == c]] = 1
            there = np.flatnonzero(mark)
            i = np.cumsum(mark, dtype=np.int32) - mark  # how many lie before a place
            after = np.r_[there, self.none][i]
            self.next[:, c] = np.where(after < stop, after, self.none)
            before = np.r_[-1, there][i]
            self.last[:, c] = np.where(before >= first, before, -1)

    def projected(self, patterns: list[tuple[int, ...]]) -> Iterator[tuple[int, np.ndarray, list[np.ndarray]]]:
        """(number, lists, places of the items in each) of every pattern that some list has. The patterns are sorted,
        so common prefixes are projected once."""
        stack: list[tuple] = [((), np.arange(len(self.first)), [])]
        for number, p in enumerate(patterns):
            while stack[-1][0] != p[: len(stack[-1][0])]:
                stack.pop()
            for code in p[len(stack[-1][0]) :]:
                prefix, who, ends = stack[-1]
                place = self.next[ends[-1] + 1 if ends else self.first[who], code]
                rows = place < self.none
                stack.append(((*prefix, code), who[rows], [*(e[rows] for e in ends), place[rows]]))
            if len(stack[-1][1]):
                yield number, stack[-1][1], stack[-1][2]

    def common(self, after: np.ndarray, before: np.ndarray, inside: np.ndarray) -> np.ndarray:
        """Which of the codes in ``inside`` lie strictly between these places in every list."""
        for i in range(0, len(after), 512):  # most periods have no common code, which shows early
            if not inside.any():
                break
            inside = inside & (self.next[after[i : i + 512] + 1] < before[i : i + 512, None]).all(axis=0)
        return inside

    def periods(self, pattern: tuple[int, ...], who: np.ndarray, ends: list[np.ndarray], place: np.ndarray, known: np.ndarray) -> np.ndarray:
        """For each item, by rows, the codes of ``known`` that lie in every list between the item before, at its first
        place, and the item, at its last place before the items behind it; ``place`` is where the last item stands."""
        out = known.copy()
        for i in range(len(pattern) - 1, -1, -1):
            if i < len(pattern) - 1:
                place = self.last[place, pattern[i]]
            out[i] = self.common(ends[i - 1] if i else self.first[who] - 1, place, out[i])
        return out


def _measured(n_codes: int, patterns: list[tuple[int, ...]]):
    """Per task and pattern (number in the sorted list): the support, that of each extension, and the codes common to all
    of the task's lists in the semi-maximum and in the maximum periods."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, list] = {}
        for batch in batches:
            if not batch.num_rows:
                continue
            column = batch.column(0)
            sizes = np.diff(column.offsets.to_numpy())
            own = Lists(column.flatten().to_numpy(zero_copy_only=False), sizes, batch.column(1).to_numpy(zero_copy_only=False), n_codes)
            for number, who, ends in own.projected(patterns):
                pattern = patterns[number]
                every = np.ones((len(pattern), n_codes), dtype=bool)
                t = total.setdefault(number, [0, np.zeros(n_codes, dtype=np.int64), every, every])
                weights = own.weights[who]
                t[0] += int(weights.sum())
                t[1] = t[1] + weights @ (own.next[ends[-1] + 1] < own.none)
                if t[2].any():
                    t[2] = own.periods(pattern, who, ends, ends[-1], t[2])
                if t[3].any():
                    t[3] = own.periods(pattern, who, ends, own.last[own.stop[who], pattern[-1]], t[3])
        found = sorted(total.items())
        yield pa.RecordBatch.from_arrays(
            [
                pa.array([i for i, _ in found], pa.int32()),
                pa.array([t[0] for _, t in found], pa.int64()),
                pa.array([t[1].tolist() for _, t in found], pa.list_(pa.int64())),
                pa.array([t[2].tobytes() for _, t in found], pa.binary()),
                pa.array([t[3].tobytes() for _, t in found], pa.binary()),
            ],
            ["i", "support", "following", "semi", "whole"],
        )

    return run


def _summed(pdf: pd.DataFrame) -> pd.DataFrame:
    """A pattern over all tasks: supports add up, common codes intersect."""
    both = lambda k: bool(np.bitwise_and.reduce([np.frombuffer(b, dtype=bool) for b in pdf[k]]).any())
    return pd.DataFrame({"i": pdf["i"].iloc[:1], "support": [pdf["support"].sum()], "following": [np.sum(list(pdf["following"]), axis=0)], "semi": [both("semi")], "whole": [both("whole")]})


def closed_patterns(lists: DataFrame, n_codes: int, percent: int, cases: int) -> list[tuple[tuple[int, ...], int]]:
    """All closed patterns of ``lists`` (list, n) that at least ``percent`` of 100 cases have, with their supports (BIDE).

    All patterns of one length are measured in one pass over the lists, each task its own lists, and the tasks' results
    are combined by pattern. A pattern is given up if a code lies in one of its semi-maximum periods in every list
    (backscan), as all that extends it then has a longer pattern of the same support; it is closed if no code can be
    added behind it or in a maximum period in every list. Patterns alone come to the driver: what share of the cases
    they need bounds their number, whatever the number of lists.
    """
    closed, open_ = [], [(c,) for c in range(n_codes)]
    schema = "i int, support bigint, following array<bigint>, {}"
    while open_:
        open_ = sorted(open_)
        parts = lists.mapInArrow(_measured(n_codes, open_), schema.format("semi binary, whole binary"))
        measured = parts.groupBy("i").applyInPandas(_summed, schema.format("semi boolean, whole boolean")).collect()
        longer = []
        for r in measured:
            if r.support * 100 < percent * cases or r.semi:
                continue
            if r.support not in r.following and not r.whole:
                closed.append((open_[r.i], r.support))
            longer += [(*open_[r.i], c) for c, n in enumerate(r.following) if n * 100 >= percent * cases]
        open_ = longer
    return closed


def _parts_of(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        rows = [(list(c), n) for p, n in zip(pdf["p"], pdf["n"]) for c in {c for k in range(SHORTEST, LONGEST + 1) for c in combinations(p, k)}]
        yield pd.DataFrame(rows, columns=["p", "n"])


def case_lists(rows: DataFrame, codes: dict[str, int]) -> DataFrame:
    """(list, n): the distinct encoded lists of the cases with counts."""
    coded = rows.join(F.broadcast(rows.sparkSession.createDataFrame(list(codes.items()), "activity_key string, c int")), "activity_key")
    events, several = in_pieces(coded.select("case_key", F.col("instant_us").alias("us"), "c"), "case_key")
    events = events.select("case_key", F.col("__piece").alias("piece"), F.struct(F.col("us").alias("t"), "c").alias("e"))
    schema = "case_key string, piece bigint, t array<bigint>, c array<int>"

    def shorter(df: DataFrame) -> DataFrame:
        one = df.groupBy("case_key", "piece").agg(F.array_sort(F.collect_set("e")).alias("e"))
        return one.select("case_key", "piece", F.col("e.t").alias("t"), F.col("e.c").alias("c")).mapInPandas(_reduce_arrays(len(codes)), schema)

    # a reduced list's length depends on the codes, not on the events: joining a few at a time, no task holds a hot case
    whole = shorter(events)
    if several:
        whole = cut(whole)
        pieces = whole.agg(F.max("piece")).first()[0] or 0
        while pieces > 0:
            again = whole.select("case_key", F.expr(f"piece div {JOINED_PIECES}").alias("piece"), F.explode(F.arrays_zip("t", "c")).alias("e"))
            whole, pieces = cut(shorter(again)), pieces // JOINED_PIECES
    encoded = whole.select("t", "c").mapInPandas(_encoded, "list array<int>").filter(F.size("list") > 0)
    return encoded.groupBy("list").agg(F.count(F.lit(1)).alias("n"))


def frequent(rows: DataFrame, percent: int = 8) -> DataFrame:
    """(pattern, support): the patterns of SHORTEST to LONGEST steps that at least ``percent`` of 100 cases have.

    ``rows`` has case_key, activity_key and instant_us, none null. Repeated rows change nothing; activities of one
    instant have no order; a pattern may repeat an activity; a case counts once for each pattern. An empty table gives
    an empty result. Supports are recovered from the closed patterns: a pattern's support is the largest among the
    closed patterns that hold it.
    """
    spark = rows.sparkSession
    rows = cut(rows.select("case_key", "activity_key", "instant_us"))
    pairs = cut(rows.select("case_key", "activity_key").distinct())
    cases = pairs.agg(F.count_distinct("case_key")).first()[0]
    # frequent activities number at most 100 / percent times the activities of an average case
    names = sorted(r[0] for r in pairs.groupBy("activity_key").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") * 100 >= percent * cases).select("activity_key").collect())
    schema = "pattern string, support bigint"
    if not cases or not names:
        return spark.createDataFrame([], schema)
    lists = cut(case_lists(rows, {a: i for i, a in enumerate(names)}).repartition(spread(rows, 1)))
    closed = closed_patterns(lists, len(names), percent, cases)
    table = spark.createDataFrame([([int(c) for c in p], int(n)) for p, n in closed], "p array<int>, n bigint")
    support = table.mapInPandas(_parts_of, "p array<int>, n bigint").groupBy("p").agg(F.max("n").alias("support"))
    named = F.array(*[F.lit(x) for x in names])
    return support.select(F.array_join(F.transform("p", lambda c: F.get(named, c)), ">").alias("pattern"), "support")
