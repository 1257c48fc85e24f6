"""The data dictionary: fuzzy matching of names and maintenance of entries and aliases."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from flowloom.session import cut


def normalised(name: str) -> str:
    """Camel, snake and kebab case as lower-case words."""
    return " ".join(re.sub(r"(?<=[a-z])(?=[A-Z])", " ", name).replace("_", " ").replace("-", " ").lower().split())


def normal_form(name: Column) -> Column:
    """X4 as an expression: camel case parted, all else than letters and digits one blank, lower case."""
    return F.trim(F.regexp_replace(F.lower(F.regexp_replace(name, "([a-z0-9])([A-Z])", "$1 $2")), "[^a-z0-9]+", " "))


def common_length(a: str, b: str) -> int:
    """Length of the longest common subsequence; a row of the matrix is the bits of one number."""
    places: dict[str, int] = {}
    for i, c in enumerate(a):
        places[c] = places.get(c, 0) | 1 << i
    full = (1 << len(a)) - 1
    row = full
    for c in b:
        hits = row & places.get(c, 0)
        row = ((row + hits) | (row - hits)) & full
    return len(a) - row.bit_count()


def ratio(a: str, b: str) -> float:
    """100 times twice the longest common subsequence over both lengths."""
    return 200.0 * common_length(a, b) / (len(a) + len(b)) if a or b else 100.0


def partial_ratio(a: str, b: str) -> float:
    """The best ratio of the shorter text with a window of the longer, windows at the ends may be shorter."""
    short, long = sorted((a, b), key=len)
    n = len(short)
    if not n:
        return 100.0 if not long else 0.0
    return max(ratio(short, long[max(0, i) : i + n]) for i in range(1 - n, len(long)))


def token_ratios(a: str, b: str) -> tuple[float, float]:
    """Ratios of the sorted words, and of the common words with each side's rest."""
    x, y = set(a.split()), set(b.split())
    by_sort = ratio(" ".join(sorted(a.split())), " ".join(sorted(b.split())))
    if not x or not y:
        return by_sort, 0.0
    both = " ".join(sorted(x & y))
    if both and (not x - y or not y - x):
        return by_sort, 100.0
    one, two = (" ".join(filter(None, [both, " ".join(sorted(r))])) for r in (x - y, y - x))
    return by_sort, max(ratio(one, two), *((ratio(both, one), ratio(both, two)) if both else (0.0,)))


def score(a: str, b: str) -> float:
    """Weighted similarity of two normalised names, 100 if they are equal."""
    if a == b:
        return 100.0
    by_sort, by_set = token_ratios(a, b)
    return 0.3 * ratio(a, b) + 0.3 * partial_ratio(a, b) + 0.2 * by_sort + 0.2 * by_set


def _scored(values: list[str], listed: list[tuple[str, str]], min_score: float) -> pd.DataFrame:
    exact: dict[str, tuple[str, str]] = {}
    for p, n in listed:
        exact.setdefault(n.lower(), (p, n))
    forms = [(p, n, normalised(n)) for p, n in listed]
    rows = []
    for q in values:
        if q.lower() in exact:
            rows.append((q, *exact[q.lower()], 100.0, True))
            continue
        best: dict[str, tuple[float, str]] = {}
        own = normalised(q)
        for p, n, f in forms:
            s = score(own, f)
            if s >= min_score and (p not in best or s > best[p][0]):
                best[p] = (s, n)
        rows += [(q, p, n, s, False) for p, (s, n) in best.items()]
    return pd.DataFrame(rows, columns=["query", "preferred_name", "matched", "score", "exact"])


def match(queries: DataFrame, entries: DataFrame, min_score: float = 60.0, top_k: int = 5, block: int = 10_000) -> DataFrame:
    """(query, preferred_name, matched, score, rank): the best entries of each distinct query.

    A query that equals a name or alias, whatever its case, gives that entry alone with 100. Others are scored against
    all names; each entry keeps its best. Up to ``block`` names, counted, travel with the function; of more, every query
    meets each block of names in a task of its own, and the blocks' results are merged. Null queries are left out; an
    empty dictionary gives no rows.
    """
    names = cut(entries.select("preferred_name", F.explode(F.concat(F.array("preferred_name"), F.coalesce("aliases", F.array()))).alias("name")).filter("name is not null"))
    asked = queries.select("query").filter("query is not null").distinct()
    schema = "query string, preferred_name string, matched string, score double, exact boolean"
    if (n := names.count()) <= block:
        listed = [tuple(r) for r in names.orderBy("preferred_name", "name").collect()]

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for pdf in batches:
                yield _scored(list(pdf["query"]), listed, min_score)

        found = asked.mapInPandas(run, schema)
    else:
        parts = n // block + 1
        shard = names.withColumn("part", F.pmod(F.xxhash64("name"), F.lit(parts)).cast("int")).withColumn("copy", F.explode(F.sequence(F.lit(0), F.lit(15))))
        every = asked.withColumn("copy", F.pmod(F.xxhash64("query"), F.lit(16)).cast("int")).withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))

        def search(own: pd.DataFrame, values: pd.DataFrame) -> pd.DataFrame:
            return _scored(list(values["query"]), sorted(zip(own["preferred_name"], own["name"])), min_score)

        found = shard.groupBy("part", "copy").cogroup(every.groupBy("part", "copy")).applyInPandas(search, schema)
        # an exact name anywhere stands alone, the smallest entry first; of an entry found in several blocks the best stays
        w = Window.partitionBy("query")
        found = found.withColumn("any", F.bool_or("exact").over(w)).filter("exact or not any").withColumn("first", F.min(F.when(F.col("exact"), F.struct("preferred_name", "matched"))).over(w))
        found = found.filter("not exact or (preferred_name = first.preferred_name and matched = first.matched)")
        best = F.row_number().over(Window.partitionBy("query", "preferred_name").orderBy(F.desc("score"), "matched"))
        found = found.withColumn("best", best).filter(F.col("best") == 1)
    rank = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), "preferred_name"))
    return found.select("query", "preferred_name", "matched", "score").withColumn("rank", rank).filter(F.col("rank") <= top_k)


def add_aliases(entries: DataFrame, new: DataFrame) -> DataFrame:
    """M3: entries with the aliases of ``new`` (preferred_name, alias) added, sorted and distinct."""
    more = new.groupBy("preferred_name").agg(F.collect_set("alias").alias("__more"))
    both = F.array_sort(F.array_union(F.coalesce("aliases", F.array()), F.coalesce("__more", F.array())))
    return entries.join(more, "preferred_name", "left").withColumn("aliases", both).drop("__more")


def remove_alias(entries: DataFrame, name: str, alias: str) -> DataFrame:
    """M3: an entry without one alias."""
    return entries.withColumn("aliases", F.when(F.col("preferred_name") == name, F.array_remove("aliases", alias)).otherwise(F.col("aliases")))
