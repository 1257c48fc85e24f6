"""Mapping freely entered values to a canonical list with BK-trees, under the unrestricted Damerau-Levenshtein metric.

Equal spellings need no search: every distinct value is first normalised, so the trees see each once. Words that loaders
and revisions add to names are learnt from the values: what is left of many names without such a word is the name of
several entries. The list's entries are held as written forms (orders of words, words without vowels) in trees, one for
each length, or in shards of such trees whose winners are merged. The trees are built under the Levenshtein distance,
a metric as well, that is at most twice the other and is computed for thousands of values at once; the triangle
inequality prunes branches, every form within reach is found, and the Damerau-Levenshtein distance decides.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Callable, Iterator
from itertools import permutations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowloom.session import cut

#: Entries whose names a word must leave behind, when taken away, to count as an added word.
ADDED_TO = 3
#: Words that only join others.
JOINING = frozenset({"of", "the"})
#: Written forms that the trees of one task hold; a longer list is split over shards of this size.
TREE_FORMS = 50_000
#: Copies of each shard, so that the values spread over more tasks than there are shards.
SPREAD = 16
#: Most edits between a value and a form.
REACH = 2


def words(raw: str) -> list[str]:
    """Lower-case words of a name in any style; width, accents, case and punctuation are ignored."""
    s = unicodedata.normalize("NFKC", raw)
    s = re.sub(r"(?<=[a-z0-9])(?=[A-Z])|(?<=[A-Z])(?=[A-Z][a-z])", " ", s)
    s = "".join(c for c in unicodedata.normalize("NFKD", s) if not unicodedata.combining(c))
    return re.findall(r"[^\W_]+", s.lower())


def without_vowels(word: str) -> str:
    return word[:1] + re.sub("[aeiou]", "", word[1:])


def radius(form: str, short: bool) -> int:
    """Edits allowed for a form: none for one or two letters, one for up to five, else two. A form cut short has more
    meaning a letter: it takes one edit for every six letters, from three letters on at least one, two at most."""
    return 0 if len(form) < 3 else max(1, min(REACH, len(form) // 6)) if short else 1 if len(form) <= 5 else REACH


def forms(entries: pd.DataFrame) -> list[tuple[str, bool, str]]:
    """(form, shortened, preferred_name) of all names: every order of up to three words, whole or with words cut short.

    A form of two entries goes to the whole one, then to the smaller name. Null names give none.
    """
    best: dict[str, tuple[bool, str]] = {}
    for preferred, aliases in zip(entries["preferred_name"], entries["aliases"]):
        for name in [preferred, *(aliases if aliases is not None else [])]:
            if not isinstance(preferred, str) or not isinstance(name, str):
                continue
            base = [w for w in words(name) if w not in JOINING] or words(name)
            shorts = [[without_vowels(w) if i in cut else w for i, w in enumerate(base)] for cut in ([], *[[i] for i in range(len(base))], range(len(base)))]
            for i, variant in enumerate(shorts):
                for order in permutations(variant) if len(base) <= 3 else (variant, variant[::-1]):
                    form, value = "".join(order), (i > 0 and variant != base, preferred)
                    if form and (form not in best or value < best[form]):
                        best[form] = value
    return [(form, short, name) for form, (short, name) in sorted(best.items())]


def distance(a: str, b: str) -> int:
    """Unrestricted Damerau-Levenshtein distance: insertions, deletions, changes and swaps of neighbours; a metric."""
    n, m = len(a), len(b)
    if a == b:
        return 0
    far, seen = n + m, {}
    rows = [[far] * (m + 2), [far, *range(m + 1)]]
    for i in range(1, n + 1):
        x, last = a[i - 1], 0
        row, above = [far, i] + [0] * m, rows[i]
        for j in range(1, m + 1):
            y = b[j - 1]
            k = seen.get(y, 0)
            cost = above[j] + (x != y)
            if above[j + 1] + 1 < cost:
                cost = above[j + 1] + 1
            if row[j] + 1 < cost:
                cost = row[j] + 1
            if k and last:
                swap = rows[k][last] + (i - k - 1) + 1 + (j - last - 1)
                if swap < cost:
                    cost = swap
            if x == y:
                last = j
            row[j + 1] = cost
        seen[x] = i
        rows.append(row)
    return rows[n + 1][m + 1]


def levenshtein(form: str, values: np.ndarray) -> np.ndarray:
    """Levenshtein distances between a form of up to 63 characters and values, rows of code points padded with -1.

    Bit-parallel: a column of the matrix is the bits of one number a value.
    """
    m = len(form)
    letters = np.array(sorted(set(map(ord, form))), dtype=np.int64)
    masks = np.array([sum(1 << i for i, c in enumerate(form) if ord(c) == x) for x in letters], dtype=np.uint64)
    one, top = np.uint64(1), np.uint64(1 << (m - 1))
    up = np.full(len(values), (1 << m) - 1, dtype=np.uint64)
    down = np.zeros(len(values), dtype=np.uint64)
    score = np.full(len(values), m, dtype=np.int64)
    for column in values.T:
        at = np.searchsorted(letters, column).clip(max=len(letters) - 1)
        same = np.where(letters[at] == column, masks[at], np.uint64(0))
        x = same | down
        h = (((same & up) + up) ^ up) | same
        plus, minus = down | ~(h | up), up & h
        score += ((plus & top != 0).astype(np.int64) - (minus & top != 0)) * (column >= 0)
        plus, minus = (plus << one) | one, minus << one
        up, down = minus | ~(x | plus), plus & x
    return score


class Tree:
    """BK-trees over written forms, one for each length."""

    def __init__(self, entries: list[tuple[str, bool, str]]) -> None:
        self.exact = {form: (0, short, name) for form, short, name in entries}
        self.roots: dict[int, list] = {}
        self.longest = max((len(e[0]) for e in entries), default=0)
        self.long = [e for e in entries if len(e[0]) > 63]
        for entry in sorted((e for e in entries if 0 < len(e[0]) <= 63), key=lambda e: hash_order(e[0])):
            points = np.array([list(map(ord, entry[0]))])
            node = self.roots.setdefault(len(entry[0]), [entry, {}])
            while node[0] is not entry:
                node = node[1].setdefault(int(levenshtein(node[0][0], points)[0]), [entry, {}])

    def search(self, values: list[str]) -> list[tuple[int, bool, str] | None]:
        """For each value the best (distance, shortened, name) within the allowed distance, ties by that order."""
        best: list[tuple[int, bool, str] | None] = [self.exact.get(v) for v in values]
        left = sorted((i for i, v in enumerate(values) if best[i] is None and 0 < len(v) <= self.longest + REACH), key=lambda i: len(values[i]))
        for i in left:
            for entry in self.long:
                if abs(len(entry[0]) - len(values[i])) <= REACH:
                    best[i] = self._better(best[i], values[i], entry)
        lengths = np.array([len(values[i]) for i in left])
        for n, root in self.roots.items():  # the values whose length is near enough, all at once
            who = left[np.searchsorted(lengths, n - REACH) : np.searchsorted(lengths, n + REACH, side="right")]
            if not who:
                continue
            points = np.full((len(who), n + REACH), -1, dtype=np.int64)
            for r, i in enumerate(who):
                points[r, : len(values[i])] = list(map(ord, values[i]))
            open_ = [(root, np.arange(len(who)))]
            while open_:
                (entry, below), rows = open_.pop()
                d = levenshtein(entry[0], points[rows])
                for r in rows[d <= 2 * REACH]:
                    best[who[r]] = self._better(best[who[r]], values[who[r]], entry)
                for at, child in below.items():  # every form under child is at distance ``at`` from this one
                    near = rows[abs(d - at) <= 2 * REACH]
                    if len(near):
                        open_.append((child, near))
        return best

    @staticmethod
    def _better(best: tuple | None, value: str, entry: tuple[str, bool, str]) -> tuple | None:
        form, short, name = entry
        allowed = min(radius(form, short), radius(value, short))
        d = distance(value, form)
        return (d, short, name) if d <= allowed and (best is None or (d, short, name) < best) else best

    def nearest(self, value: str) -> tuple[int, bool, str] | None:
        return self.search([value])[0]


def hash_order(form: str) -> int:
    """A fixed shuffle, so that sorted input doesn't unbalance the tree."""
    h = 0
    for c in form:
        h = (h * 1_000_003 + ord(c)) & 0xFFFFFFFF
    return h


def _taken_apart(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        yield pd.DataFrame({"raw": pdf["raw"], "w": [words(r) for r in pdf["raw"]]})


def _forms_of(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        yield pd.DataFrame(forms(pdf), columns=["form", "short", "name"]).astype({"form": object, "short": bool, "name": object})


def _vocabulary_of(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        names = [n for p, a in zip(pdf["preferred_name"], pdf["aliases"]) for n in [p, *(a if a is not None else [])] if isinstance(n, str)]
        yield pd.DataFrame({"word": sorted({w for n in names for w in words(n)})}, dtype=object)


def _joined(w: Column) -> Column:
    """Words as one string; words that only join others go unless nothing else is left."""
    kept = F.filter(w, lambda x: ~x.isin(*sorted(JOINING)))
    return F.array_join(F.when(F.size(kept) > 0, kept).otherwise(w), "")


def added_words(named: DataFrame, forms_table: DataFrame, vocabulary: DataFrame, least: int = ADDED_TO) -> DataFrame:
    """(word): what loaders and revisions add to names: words of no entry whose removal leaves, in some names, exactly
    the whole form of an entry, and does so for at least ``least`` different entries."""
    one = named.filter(F.size("w") > 1).select("w", F.explode(F.array_distinct("w")).alias("word")).join(vocabulary, "word", "left_anti")
    rest = one.select("word", _joined(F.filter("w", lambda x: x != F.col("word"))).alias("form"))
    hits = rest.join(forms_table.filter("not short").select("form", "name"), "form").select("word", "name").distinct()
    return hits.groupBy("word").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= least).select("word")


def _searcher(tree: Tree) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            hits = tree.search(list(pdf["spelled"]))
            yield pd.DataFrame({"spelled": pdf["spelled"], "distance": [h[0] if h else None for h in hits], "name": [h[2] if h else "" for h in hits]}).astype({"distance": "Int32"})

    return run


def match(values: DataFrame, entries: DataFrame, raw: str = "raw_name", added_to: int = ADDED_TO) -> DataFrame:
    """All rows of ``values`` whose ``raw`` is neither null nor blank, with ``preferred_name`` ('' if none is meant) and
    ``distance`` (edits to the nearest form, null if none).

    Distinct spellings are searched once, whatever their frequency, and joined back. Ties go to the smaller distance,
    then to whole forms, then to the smaller name. Words that ``values`` add to at least ``added_to`` entries' names are
    taken away before (added_words), unless nothing is left. An empty list gives '' throughout. A list of up to
    TREE_FORMS written forms, counted, travels as one set of trees; a longer one is searched in shards and the winners
    of the shards are merged. Columns of ``values`` called preferred_name or distance are replaced.
    """
    used = values.drop("preferred_name", "distance").filter(F.col(raw).isNotNull() & (F.regexp_replace(raw, r"[\s\p{Z}]+", "") != ""))
    named = cut(used.select(F.col(raw).alias("raw")).distinct().repartition(spread_of(used)).mapInPandas(_taken_apart, "raw string, w array<string>"))
    listed = entries.select("preferred_name", "aliases")
    every = listed.mapInPandas(_forms_of, "form string, short boolean, name string").groupBy("form").agg(F.min(F.struct("short", "name")).alias("b"))
    every = cut(every.select("form", "b.short", "b.name"))
    added = added_words(named, every, listed.mapInPandas(_vocabulary_of, "word string").distinct(), added_to)
    # one row for each word of a distinct value: the list of added words may be of any length
    split = named.select("raw", "w", F.posexplode_outer("w").alias("i", "word")).join(added.withColumn("is_added", F.lit(True)), "word", "left")
    kept = split.filter("is_added is null").groupBy("raw").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "word"))), lambda x: x["word"]).alias("kept"))
    spelled = cut(named.join(kept.withColumnRenamed("raw", "__raw"), F.col("raw") == F.col("__raw"), "left").select("raw", _joined(F.when(F.size("kept") > 0, F.col("kept")).otherwise(F.col("w"))).alias("spelled")))
    distinct = spelled.select("spelled").distinct()
    if every.count() <= TREE_FORMS:
        tree = Tree([tuple(r) for r in every.orderBy("form").collect()])
        found = distinct.repartition(spread_of(distinct)).mapInPandas(_searcher(tree), "spelled string, distance int, name string")
    else:
        found = _sharded(distinct, every)
    by_raw = spelled.join(found, "spelled").select(F.col("raw").alias("__raw"), "distance", F.col("name").alias("preferred_name"))
    # a value that a third of all rows share is one row here; the join back splits a hot value's rows by AQE, and
    # small dictionaries of distinct values become broadcasts at run time
    return used.join(by_raw, F.col(raw).eqNullSafe(F.col("__raw")), "left").drop("__raw")


def spread_of(df: DataFrame) -> int:
    return max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), df.sparkSession.sparkContext.defaultParallelism)


def _sharded(distinct: DataFrame, every: DataFrame) -> DataFrame:
    """Every value meets the trees of every shard; the best of a value's winners stays."""
    shards = every.count() // TREE_FORMS + 1
    part = every.withColumn("shard", F.pmod(F.xxhash64("form"), F.lit(shards)).cast("int"))
    part = part.withColumn("copy", F.explode(F.sequence(F.lit(0), F.lit(SPREAD - 1))))
    asked = distinct.withColumn("copy", F.pmod(F.xxhash64("spelled"), F.lit(SPREAD)).cast("int")).withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(shards - 1))))

    def search(own: pd.DataFrame, values: pd.DataFrame) -> pd.DataFrame:
        hits = Tree(list(zip(own["form"], own["short"], own["name"]))).search(list(values["spelled"]))
        return pd.DataFrame({"spelled": values["spelled"], "w": [h if h is None else {"d": h[0], "s": bool(h[1]), "n": h[2]} for h in hits]})

    winners = part.groupBy("shard", "copy").cogroup(asked.groupBy("shard", "copy")).applyInPandas(search, "spelled string, w struct<d: int, s: boolean, n: string>")
    best = winners.groupBy("spelled").agg(F.min("w").alias("w"))
    return best.select("spelled", F.col("w.d").alias("distance"), F.coalesce("w.n", F.lit("")).alias("name"))
