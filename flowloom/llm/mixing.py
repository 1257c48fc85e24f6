"""Mixing sources to target weights by budget fitting over counts of documents by exact token length."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from flowloom.functions.instants import trimmed
from flowloom.llm import bpe
from flowloom.session import cut

#: Tokens that the knapsack fits exactly; the budget above them is filled evenly by length first.
FIT_TOKENS = 1 << 16
#: Documents of one source and length are taken by hash bucket, so that none is ranked with all others: a bucket for
#: so many of the table's documents, at least FEWEST.
BUCKET_ROWS, FEWEST = 100_000, 64


def source_key(c: Column) -> Column:
    return F.lower(trimmed(c))


def fit_remainder(length: np.ndarray, count: np.ndarray, budget: int) -> np.ndarray:
    """How many documents of each length to take once, so that their tokens come nearest to the budget from below.

    Bounded knapsack over the lengths, with the sums that can be reached kept as the bits of one integer.
    """
    full = (1 << (budget + 1)) - 1
    reach, steps = 1, []
    for i in range(len(length)):
        left, size = int(min(count[i], budget // max(1, length[i]))), 1
        while left > 0:
            take = min(size, left)
            steps.append((i, take, reach))
            reach |= (reach << (take * int(length[i]))) & full
            left, size = left - take, size * 2
        if reach >> budget & 1:
            break
    at, chosen = reach.bit_length() - 1, np.zeros(len(length), dtype=np.int64)
    for i, take, before in reversed(steps):
        if not before >> at & 1:
            at -= take * int(length[i])
            chosen[i] += take
    return chosen


def fit_source(length: np.ndarray, count: np.ndarray, budget: int, most: int) -> tuple[int, np.ndarray]:
    """(times every document is used, how many of each length are used once more) for a budget of tokens."""
    total = int((length * count).sum())
    if not total or budget <= 0:
        return 0, np.zeros(len(length), dtype=np.int64)
    every = min(most, budget // total)
    if every == most:
        return every, np.zeros(len(length), dtype=np.int64)
    left = budget - every * total
    even = np.zeros(len(length), dtype=np.int64)
    if left > FIT_TOKENS:
        even = np.floor(count * ((left - FIT_TOKENS // 2) / total)).astype(np.int64)
        left -= int((even * length).sum())
        order = np.argsort(-length, kind="stable")
        for i in order:  # rounding down leaves less than one document a length; whole ones go in until the rest fits
            if left <= FIT_TOKENS:
                break
            more = int(min(count[i] - even[i], (left - FIT_TOKENS) // max(1, length[i]) + 1, left // max(1, length[i])))
            even[i] += max(0, more)
            left -= max(0, more) * int(length[i])
    # what is left is at most FIT_TOKENS, or all documents that would fit are taken: the knapsack is always the last step
    fits = (length > 0) & (length <= left) & (count > even)
    extra = np.zeros(len(length), dtype=np.int64)
    if fits.any():
        where = np.flatnonzero(fits)
        extra[where] = fit_remainder(length[where], (count - even)[where], left)
    return every, even + extra


def token_lengths(documents: DataFrame, **vocabulary: str) -> DataFrame:
    """(doc_id, source_key, n_tokens) of every document."""
    return bpe.lengths(documents.select("doc_id", source_key(F.col("source")).alias("source_key"), "text"), ["doc_id", "source_key"], **vocabulary)


def totals(lengths: DataFrame, targets: DataFrame) -> DataFrame:
    """One row for each target source: its documents and tokens, the budget of all sources, its own, and what it can reach.

    A source listed twice counts once, with its smallest share row; a source without documents has 0 tokens.
    """
    goal = targets.filter("source is not null").groupBy(source_key(F.col("source")).alias("source_key")).agg(F.min(F.struct("source", "target_share", "max_repeats")).alias("t"))
    have = lengths.groupBy("source_key").agg(F.sum("n_tokens").alias("tokens"), F.count(F.lit(1)).alias("documents"))
    one = goal.join(have, "source_key", "left").select("source_key", "t.*", F.coalesce("tokens", F.lit(0)).alias("tokens"), F.coalesce("documents", F.lit(0)).alias("documents"))
    # one row for each target: the window holds the list of targets, not documents
    one = one.withColumn("all_tokens", F.sum("tokens").over(Window.partitionBy(F.lit(1))))
    return one.withColumn("budget", F.col("target_share") * F.col("all_tokens")).withColumn("reachable", F.col("max_repeats") * F.col("tokens"))


def _buckets(lengths: DataFrame) -> int:
    return max(FEWEST, lengths.count() // BUCKET_ROWS)


def _counted(lengths: DataFrame, buckets: int, seed: int) -> tuple[DataFrame, DataFrame]:
    """The documents that have tokens, with their bucket, and their number by source, length and bucket."""
    used = lengths.filter("n_tokens > 0").withColumn("bucket", F.pmod(F.xxhash64("doc_id", F.lit(seed)), F.lit(buckets)))
    return used, used.groupBy("source_key", "n_tokens", "bucket").agg(F.count(F.lit(1)).alias("n"))


def fitted(counts: DataFrame, goal: DataFrame) -> DataFrame:
    """(source_key, n_tokens, n, every, more): the plan. Of the n documents of a length each is used ``every`` times and
    ``more`` of them once more. A source's rows are its distinct lengths: the longest text bounds them, not its
    documents."""
    by_length = counts.groupBy("source_key", "n_tokens").agg(F.sum("n").alias("n")).join(goal.select("source_key", "budget", "max_repeats"), "source_key")

    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("n_tokens")
        every, more = fit_source(pdf["n_tokens"].to_numpy(np.int64), pdf["n"].to_numpy(np.int64), int(pdf["budget"].iloc[0]), int(pdf["max_repeats"].iloc[0]))
        return pd.DataFrame({"source_key": pdf["source_key"], "n_tokens": pdf["n_tokens"], "n": pdf["n"], "every": every, "more": more})

    return by_length.groupBy("source_key").applyInPandas(fit, "source_key string, n_tokens bigint, n bigint, every bigint, more bigint")


def _with_shortage(goal: DataFrame, plan: DataFrame) -> DataFrame:
    """Adds ``short``: the plan uses every document of the source as often as allowed, and budget is still left."""
    used = plan.groupBy("source_key").agg(F.sum(F.col("n_tokens") * (F.col("n") * F.col("every") + F.col("more"))).alias("used"), F.min("every").alias("every"))
    j = goal.join(used, "source_key", "left")
    exhausted = F.coalesce(F.col("every") >= F.col("max_repeats"), F.lit(True))
    return j.withColumn("short", exhausted & (F.coalesce("used", F.lit(0)) < F.col("budget"))).drop("used", "every")


def shortages(documents: DataFrame, targets: DataFrame, seed: int = 17, **vocabulary: str) -> DataFrame:
    """One row for each target source with ``short``, whether the fitted plan cannot give it its share."""
    lengths = cut(token_lengths(documents, **vocabulary))
    goal = totals(lengths, targets)
    return _with_shortage(goal, fitted(_counted(lengths, FEWEST, seed)[1], goal))


def mix(documents: DataFrame, targets: DataFrame, seed: int = 17, **vocabulary: str) -> tuple[DataFrame, DataFrame]:
    """(draw, report): draw has doc_id, source_key, n_tokens and times >= 1; report one row for each target source.

    Every source's budget is its target share of all tokens of the listed sources. It is filled with whole rounds of
    all its documents and then with documents drawn once more, chosen by seed within their exact length, so that the
    sum comes as near to the budget as the lengths allow, without passing it. No document is used more than
    max_repeats times; a source that cannot reach its budget is used max_repeats times throughout. Documents without
    tokens, without a source or of an unlisted source are not drawn. Empty tables give empty results.
    """
    lengths = cut(token_lengths(documents, **vocabulary))
    goal = totals(lengths, targets)
    used, counts = _counted(lengths, _buckets(lengths), seed)
    plan = cut(fitted(counts, goal))
    goal = _with_shortage(goal, plan)
    plan = plan.select("source_key", "n_tokens", "every", "more")
    w = Window.partitionBy("source_key", "n_tokens").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    quota = counts.join(plan, ["source_key", "n_tokens"]).withColumn("earlier", F.coalesce(F.sum("n").over(w), F.lit(0)))
    quota = quota.select("source_key", "n_tokens", "bucket", "every", F.greatest(F.lit(0), F.least("n", F.col("more") - F.col("earlier"))).alias("more"))
    ranked = used.join(quota, ["source_key", "n_tokens", "bucket"])
    rank = F.row_number().over(Window.partitionBy("source_key", "n_tokens", "bucket").orderBy(F.xxhash64("doc_id", F.lit(seed + 1)), "doc_id"))
    draw = ranked.withColumn("times", F.col("every") + F.when(rank <= F.col("more"), 1).otherwise(0)).filter("times > 0").select("doc_id", "source_key", "n_tokens", "times")
    got = draw.groupBy("source_key").agg(F.sum(F.col("n_tokens") * F.col("times")).alias("drawn_tokens"), F.max("times").alias("most_repeats"))
    report = goal.join(got, "source_key", "left").withColumn("drawn_tokens", F.coalesce("drawn_tokens", F.lit(0)))
    report = report.withColumn("share", F.col("drawn_tokens") / F.nullif(F.sum("drawn_tokens").over(Window.partitionBy(F.lit(1))), F.lit(0)))
    return draw, report.select("source", "target_share", "share", "tokens", "drawn_tokens", "most_repeats", "max_repeats", "short")
