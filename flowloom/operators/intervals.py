"""Overlapping, nested, touching and gapped intervals: continuous periods and the gaps between them.

Instants are doubled, so that an interval [s, e] becomes the cells 2s .. 2e and two intervals join exactly if they
share an instant. Time is cut into buckets of 2^BUCKET_LEVEL cells. Within one (entity, bucket) every piece is taken
apart into canonical dyadic blocks; blocks below another block go, sibling pairs merge upward, and neighbouring
blocks coalesce to runs. Runs inside a bucket are final. Only a bucket's first and last run can go on elsewhere: they
are stitched per entity over at most two rows a bucket, so that no task holds an entity's intervals, however many.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from flowloom.session import cut

#: Buckets of 2^40 half microseconds, 6.4 days: an interval adds one row for each bucket that it touches.
BUCKET_LEVEL = 40
#: Pieces that one pass of the vectorised merge takes; a larger (entity, bucket) is halved and merged again.
PASS_ROWS = 20_000


def dyadic_blocks(group: np.ndarray, lo: np.ndarray, hi: np.ndarray, levels: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Canonical dyadic blocks (group, start, level) of the half-open cell ranges [lo, hi) within [0, 2^levels)."""
    left, right = lo.copy(), hi.copy()
    groups, starts, at = [], [], []
    for level in range(levels + 1):
        open_ = left < right
        if not open_.any():
            break
        for mask, cell in ((open_ & (left & 1 == 1), left), (open_ & (right & 1 == 1), right - 1)):
            groups.append(group[mask])
            starts.append(cell[mask] << level)
            at.append(np.full(int(mask.sum()), level))
        left, right = (left + 1) >> 1, right >> 1
    if not groups:
        return group[:0], lo[:0], lo[:0]
    return np.concatenate(groups), np.concatenate(starts), np.concatenate(at)


def without_covered(group: np.ndarray, start: np.ndarray, level: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Drops repeated blocks and those below another block of their group; dyadic blocks nest or are disjoint."""
    order = np.lexsort((-level, start, group))
    group, start, level = group[order], start[order], level[order]
    if not len(group):
        return group, start, level
    end = start + (np.int64(1) << level)
    first = np.r_[True, group[1:] != group[:-1]]
    # running maximum of the ends before a block, separately for each group: groups are lifted apart
    lift = np.cumsum(first).astype(np.int64) << 42
    before = np.maximum.accumulate(np.r_[np.int64(-1), (end + lift)[:-1]])
    keep = first | (start + lift >= before)
    return group[keep], start[keep], level[keep]


def merged_siblings(group: np.ndarray, start: np.ndarray, level: np.ndarray, levels: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Replaces pairs of siblings by their parent, level by level."""
    order = np.argsort(level, kind="stable")
    group, start = group[order], start[order]
    cuts = np.searchsorted(level[order], np.arange(levels + 2))
    up_g, up_s, done = group[:0], start[:0], []
    for k in range(levels + 1):
        g, s = np.concatenate([group[cuts[k] : cuts[k + 1]], up_g]), np.concatenate([start[cuts[k] : cuts[k + 1]], up_s])
        if k == levels or len(g) < 2:
            done.append((g, s, np.full(len(g), k)))
            up_g, up_s = g[:0], s[:0]
            continue
        order = np.lexsort((s, g))
        g, s = g[order], s[order]
        pair = np.zeros(len(g), dtype=bool)
        pair[:-1] = (g[1:] == g[:-1]) & (s[:-1] & (np.int64(1) << k) == 0) & (s[1:] == s[:-1] + (np.int64(1) << k))
        single = ~pair & ~np.r_[False, pair[:-1]]
        done.append((g[single], s[single], np.full(int(single.sum()), k)))
        up_g, up_s = g[pair], s[pair]
    return tuple(np.concatenate(x) for x in zip(*done))


def runs(group: np.ndarray, lo: np.ndarray, hi: np.ndarray, levels: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Maximal runs (group, lo, hi) of the union of [lo, hi) in each group, in order, through dyadic blocks."""
    g, s, k = merged_siblings(*without_covered(*dyadic_blocks(group, lo, hi, levels)), levels)
    order = np.lexsort((s, g))
    g, s, e = g[order], s[order], (s + (np.int64(1) << k))[order]
    if not len(g):
        return g, s, e
    fresh = np.r_[True, (g[1:] != g[:-1]) | (s[1:] != e[:-1])]
    last = np.r_[fresh[1:], True]
    return g[fresh], s[fresh], e[last]


def _merge_pieces(level: int):
    def merge(pdf: pd.DataFrame) -> pd.DataFrame:
        fresh = np.r_[True, (pdf["k"].to_numpy()[1:] != pdf["k"].to_numpy()[:-1]) | (pdf["bucket"].to_numpy()[1:] != pdf["bucket"].to_numpy()[:-1])]
        gid, at = np.cumsum(fresh) - 1, np.flatnonzero(fresh)
        lo, hi = pdf["lo"].to_numpy(np.int64), pdf["hi"].to_numpy(np.int64)
        while len(lo) > PASS_ROWS:  # a pass over each slice first, so that memory for blocks stays bounded
            parts = [runs(gid[i : i + PASS_ROWS], lo[i : i + PASS_ROWS], hi[i : i + PASS_ROWS], level) for i in range(0, len(lo), PASS_ROWS)]
            size = len(lo)
            gid, lo, hi = (np.concatenate(x) for x in zip(*parts))
            if len(lo) > size // 2:
                break
        g, lo, hi = runs(gid, lo, hi, level)
        first = np.r_[True, g[1:] != g[:-1]]
        last = np.r_[first[1:], True]
        following = np.r_[lo[1:], 0]
        return pd.DataFrame(
            {"k": pdf["k"].to_numpy()[at][g], "bucket": pdf["bucket"].to_numpy()[at][g], "lo": lo, "hi": hi, "edge": first | last, "next_lo": np.where(last, -1, following)}
        )

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Batches come sorted by (k, bucket); a group that goes on in the next batch waits for it, merged so far."""
        held: pd.DataFrame | None = None
        most = 2 * PASS_ROWS
        for pdf in batches:
            if held is not None:
                pdf = pd.concat([held, pdf], ignore_index=True)
            if not len(pdf):
                continue
            k, b = pdf["k"].iloc[-1], pdf["bucket"].iloc[-1]
            tail = (pdf["k"] == k) & (pdf["bucket"] == b)
            whole = pdf[~tail]
            if len(whole):
                yield merge(whole)
            held = pdf[tail]
            if len(whole):
                most = 2 * PASS_ROWS
            if len(held) > most:  # merged again only when it has doubled: disjoint pieces do not shrink
                held = merge(held)[["k", "bucket", "lo", "hi"]]
                most = max(2 * PASS_ROWS, 2 * len(held))
        if held is not None and len(held):
            yield merge(held)

    return run


def periods_and_gaps(intervals: DataFrame, entity: str, start: str, end: str, bucket_level: int = BUCKET_LEVEL) -> DataFrame:
    """(entity, kind, start_us, end_us): per entity the maximal covered stretches ('period') and what lies between ('gap').

    Start and end are bigint microseconds, both inclusive: intervals that touch join, a length of zero counts. Rows
    with a null entity or bound, or an end before the start, are left out. Repeated rows change nothing; other columns
    of the input are ignored. An entity with one period has no gap; an empty table gives an empty table. Instants must
    lie within about 36,000 years of 1970.
    """
    width = F.shiftleft(F.lit(1).cast("long"), bucket_level)
    cells = intervals.select(F.col(entity).alias("k"), (F.col(start) * 2).alias("s"), (F.col(end) * 2 + 1).alias("e"))
    cells = cells.filter("k is not null and s is not null and e is not null and s < e")
    pieces = cells.withColumn("bucket", F.explode(F.sequence(F.shiftright("s", bucket_level), F.shiftright(F.col("e") - 1, bucket_level))))
    base: Column = F.col("bucket") * width
    pieces = pieces.select("k", "bucket", F.greatest(F.col("s") - base, F.lit(0).cast("long")).alias("lo"), F.least(F.col("e") - base, width).alias("hi"))
    # equal pieces, such as whole buckets, are joined before the shuffle
    pieces = pieces.groupBy("k", "bucket", "lo").agg(F.max("hi").alias("hi"))
    pieces = pieces.repartition("k", "bucket").sortWithinPartitions("k", "bucket")
    done = cut(pieces.mapInPandas(_merge_pieces(bucket_level), "k string, bucket long, lo long, hi long, edge boolean, next_lo long"))
    base = F.col("bucket") * width
    done = done.select("k", "bucket", (base + F.col("lo")).alias("a"), (base + F.col("hi")).alias("b"), "edge", F.when(F.col("next_lo") >= 0, base + F.col("next_lo")).alias("next_a"))
    inner = done.filter("not edge").select("k", F.lit("period").alias("kind"), "a", "b")
    inner_gap = done.filter("next_a is not null").select("k", F.lit("gap").alias("kind"), F.col("b").alias("a"), F.col("next_a").alias("b"))
    # edges number at most two for each (entity, bucket): bounded by the time spanned, not by the entity's rows
    w = Window.partitionBy("k").orderBy("a")
    edges = done.filter("edge").select("k", "bucket", "a", "b", F.lag("b").over(w).alias("before"), F.lag("bucket").over(w).alias("before_bucket"))
    edges = edges.withColumn("island", F.sum(F.when(F.col("before") == F.col("a"), 0).otherwise(1)).over(w))
    outer = edges.groupBy("k", "island").agg(F.min("a").alias("a"), F.max("b").alias("b")).select("k", F.lit("period").alias("kind"), "a", "b")
    outer_gap = edges.filter("before < a and before_bucket <> bucket").select("k", F.lit("gap").alias("kind"), F.col("before").alias("a"), F.col("a").alias("b"))
    gap = F.col("kind") == "gap"
    return (
        inner.unionByName(inner_gap)
        .unionByName(outer)
        .unionByName(outer_gap)
        .select(
            F.col("k").alias(entity),
            "kind",
            F.shiftright(F.when(gap, F.col("a") - 1).otherwise(F.col("a")), 1).alias("start_us"),
            F.shiftright(F.when(gap, F.col("b")).otherwise(F.col("b") - 1), 1).alias("end_us"),
        )
    )


def waits(rows: DataFrame) -> DataFrame:
    """(case_id, wait, start_us, end_us) from usable_rows of one type: a wait lasts from its earliest opening to its
    latest closing and counts if both exist and the closing is not earlier. The name is what stands before the ending;
    an activity that is only an ending names the empty wait."""
    a = F.col("activity_key")
    opens, closes = a.rlike("(start|begin)$"), a.rlike("(end|finish)$")
    named = rows.filter(opens | closes).select(
        F.col("case_key").alias("case_id"),
        F.regexp_replace(a, "(start|begin|end|finish)$", "").alias("wait"),
        F.when(opens, F.col("instant_us")).alias("o"),
        F.when(closes, F.col("instant_us")).alias("c"),
    )
    both = named.groupBy("case_id", "wait").agg(F.min("o").alias("start_us"), F.max("c").alias("end_us"))
    return both.filter("start_us <= end_us")
