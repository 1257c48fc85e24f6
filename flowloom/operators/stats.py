"""Statistics and outliers over case attributes."""

from __future__ import annotations

import math
from collections.abc import Sequence
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowloom.functions import ranks
from flowloom.session import cut


def gamma_upper(a: float, x: float) -> float:
    """Regularised upper incomplete gamma function: a series below a + 1, a continued fraction above."""
    if x <= 0:
        return 1.0
    scale = math.exp(a * math.log(x) - x - math.lgamma(a))
    if x < a + 1:
        term = total = 1 / a
        n = a
        while abs(term) > abs(total) * 1e-16:
            n += 1
            term *= x / n
            total += term
        return max(0.0, 1 - scale * total)
    b, c = x + 1 - a, 1e300
    d = 1 / b
    h = d
    for i in range(1, 10_000):
        an = -i * (i - a)
        b += 2
        d = 1 / (an * d + b or 1e-300)
        c = b + an / c or 1e-300
        h *= d * c
        if abs(d * c - 1) < 1e-15:
            break
    return scale * h


def chi2_survival(x: float, dof: int) -> float:
    return gamma_upper(dof / 2, x / 2)


def average_ranks(df: DataFrame, value: str) -> DataFrame:
    """(value, n, rank) with the average rank of each distinct value, from counts of the distinct values."""
    counts = df.filter(F.col(value).isNotNull()).groupBy(F.col(value).alias("value")).agg(F.count(F.lit(1)).alias("n"))
    return ranks.running(counts, ["value"], F.col("n")).select("value", "n", (F.col("below") + (F.col("n") + 1) / 2).alias("rank"))


def exact_quantiles(df: DataFrame, groups: Sequence[str], value: str, shares: Sequence[float]) -> DataFrame:
    """(groups, q0, q1, ..): interpolated quantiles, from running counts of distinct values: no task holds a group."""
    counts = df.filter(F.col(value).isNotNull()).groupBy(*groups, F.col(value).alias("__v")).agg(F.count(F.lit(1)).alias("__n"))
    below = ranks.running(counts, ["__v"], F.col("__n"), groups)
    total = counts.groupBy(*[F.col(g).alias(f"__t{i}") for i, g in enumerate(groups)]).agg(F.sum("__n").alias("__total"))
    on = [F.col(g).eqNullSafe(F.col(f"__t{i}")) for i, g in enumerate(groups)]
    j = below.join(total, reduce(Column.__and__, on)) if on else below.crossJoin(F.broadcast(total))
    at = lambda k: F.max(F.when((F.col("below") <= k) & (k < F.col("below") + F.col("__n")), F.col("__v")))
    places = [F.lit(s) * (F.col("__total") - 1) for s in shares]
    places = [F.least(k, F.col("__total") - 1) for k in places]
    q = j.groupBy(*groups).agg(*[x for i, k in enumerate(places) for x in (at(F.floor(k)).alias(f"__lo{i}"), at(F.ceil(k)).alias(f"__hi{i}"), F.max(k - F.floor(k)).alias(f"__part{i}"))])
    return q.select(*groups, *[(F.col(f"__lo{i}") + (F.col(f"__hi{i}") - F.col(f"__lo{i}")) * F.col(f"__part{i}")).alias(f"q{i}") for i in range(len(shares))])


def kruskal_wallis(df: DataFrame, group: str, value: str) -> DataFrame:
    """O1: (h, p, n_groups, n) with tie correction; null h where all values are equal or there is one group."""
    r = average_ranks(df, value)
    rows = df.filter(F.col(value).isNotNull() & F.col(group).isNotNull()).select(F.col(group).alias("g"), F.col(value).alias("value"))
    per = rows.join(r, "value").groupBy("g").agg(F.sum("rank").alias("r"), F.count(F.lit(1)).alias("m"))
    one = per.agg(F.sum(F.col("r") * F.col("r") / F.col("m")).alias("s"), F.sum("m").alias("n"), F.count(F.lit(1)).alias("k"))
    ties = r.agg(F.sum(F.pow("n", F.lit(3)) - F.col("n")).alias("ties"))
    h = (12 / (F.col("n") * (F.col("n") + 1)) * F.col("s") - 3 * (F.col("n") + 1)) / F.nullif(1 - F.col("ties") / (F.pow("n", F.lit(3)) - F.col("n")), F.lit(0.0))
    p = F.udf(lambda h, k: None if h is None or k < 2 else chi2_survival(h, k - 1), "double")  # one row
    return one.crossJoin(ties).select(h.alias("h"), F.col("k").alias("n_groups"), F.col("n")).withColumn("p", p("h", "n_groups"))


def anova(df: DataFrame, group: str, value: str) -> DataFrame:
    """O3: one-way F statistic with its degrees of freedom, from group sums in one aggregation."""
    per = df.groupBy(group).agg(F.count(value).alias("m"), F.sum(value).alias("s"), F.sum(F.col(value) * F.col(value)).alias("q"))
    one = per.agg(F.sum("m").alias("n"), F.sum("s").alias("s"), F.sum("q").alias("q"), F.sum(F.col("s") * F.col("s") / F.col("m")).alias("b"), F.count(F.lit(1)).alias("k"))
    between, within = F.col("b") - F.col("s") * F.col("s") / F.col("n"), F.col("q") - F.col("b")
    return one.select((between / (F.col("k") - 1) / (within / (F.col("n") - F.col("k")))).alias("f"), (F.col("k") - 1).alias("df_between"), (F.col("n") - F.col("k")).alias("df_within"))


def correlations(df: DataFrame, x: str, y: str) -> DataFrame:
    """Pearson's and Spearman's correlation."""
    rx, ry = (average_ranks(df, c).select(F.col("value").alias(c), F.col("rank").alias(f"rank_{c}")) for c in (x, y))
    both = df.select(x, y).filter(F.col(x).isNotNull() & F.col(y).isNotNull()).join(rx, x).join(ry, y)
    return both.agg(F.corr(x, y).alias("pearson"), F.corr(f"rank_{x}", f"rank_{y}").alias("spearman"))


def iqr_outliers(df: DataFrame, groups: Sequence[str], value: str, k: float = 1.5) -> DataFrame:
    """Rows outside k interquartile ranges of their group, labelled Low or High."""
    q = exact_quantiles(df, groups, value, (0.25, 0.75))
    bounds = q.select(*groups, (F.col("q0") - k * (F.col("q1") - F.col("q0"))).alias("low"), (F.col("q1") + k * (F.col("q1") - F.col("q0"))).alias("high"))
    return df.join(bounds, list(groups)).withColumn("label", F.when(F.col(value) < F.col("low"), "Low").when(F.col(value) > F.col("high"), "High")).filter("label is not null").drop("low", "high")


def scaled(df: DataFrame, value: str) -> DataFrame:
    """Z-scores by the population deviation, column z; 0 where all values are equal."""
    m = df.agg(F.avg(value).alias("m"), F.stddev_pop(value).alias("s"))
    return df.crossJoin(F.broadcast(m)).withColumn("z", F.coalesce((F.col(value) - F.col("m")) / F.nullif(F.col("s"), F.lit(0.0)), F.lit(0.0))).drop("m", "s")


def label_encoded(df: DataFrame, category: str) -> DataFrame:
    """Category codes from 0 in sorted order, column code."""
    codes = ranks.running(df.select(category).distinct(), [category]).withColumnRenamed("below", "code")
    return df.join(codes, category)


def frequency_encoded(df: DataFrame, category: str) -> DataFrame:
    """Each category's share of rows, column share."""
    total = df.agg(F.count(F.lit(1)).alias("t"))
    shares = df.groupBy(category).agg(F.count(F.lit(1)).alias("n")).crossJoin(F.broadcast(total)).select(F.col(category).alias("__c"), (F.col("n") / F.col("t")).alias("share"))
    return df.join(shares, df[category].eqNullSafe(F.col("__c"))).drop("__c")


def categories(df: DataFrame, category: str, most: int = 1000) -> list:
    """The sorted distinct values of a column; more than ``most`` are an error, as each becomes a column."""
    found = [r[0] for r in df.select(category).filter(F.col(category).isNotNull()).distinct().limit(most + 1).collect()]
    if len(found) > most:
        raise ValueError(f"{category} has more than {most} values")
    return sorted(found)


def one_hot(df: DataFrame, key: str, category: str, values: Sequence[str]) -> DataFrame:
    """One 0/1 column for each given value but the first."""
    return df.select(key, *[(F.col(category) == v).cast("int").alias(f"is_{v}") for v in values[1:]])


def _moments(df: DataFrame, columns: Sequence[str]) -> tuple[np.ndarray, np.ndarray]:
    """Means and population covariance in one aggregation, whatever the number of rows."""
    pairs = [(a, b) for i, a in enumerate(columns) for b in columns[i:]]
    row = df.agg(*[F.avg(c) for c in columns], *[F.covar_pop(a, b) for a, b in pairs]).first()
    n = len(columns)
    cov = np.zeros((n, n))
    for (a, b), v in zip(pairs, row[n:]):
        i, j = columns.index(a), columns.index(b)
        cov[i, j] = cov[j, i] = v or 0.0
    return np.array([v or 0.0 for v in row[:n]]), cov


def mahalanobis(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Squared Mahalanobis distance (column d2) under the classical covariance, as one arithmetic expression."""
    mean, cov = _moments(df, columns)
    inverse = np.linalg.pinv(cov)
    parts = [F.lit(float(inverse[i, j])) * (F.col(a) - float(mean[i])) * (F.col(b) - float(mean[j])) for i, a in enumerate(columns) for j, b in enumerate(columns)]
    return df.withColumn("d2", sum(parts[1:], parts[0]))


def principal_components(df: DataFrame, columns: Sequence[str], k: int = 2) -> DataFrame:
    """The k leading components (pc1..) of the scaled columns; each component's largest loading is positive."""
    mean, cov = _moments(df, columns)
    sd = np.sqrt(np.where(np.diag(cov) > 0, np.diag(cov), 1.0))
    values, vectors = np.linalg.eigh(cov / np.outer(sd, sd))
    out = df
    for i, at in enumerate(np.argsort(-values)[:k]):
        v = vectors[:, at] * np.sign(vectors[np.argmax(np.abs(vectors[:, at])), at])
        terms = [F.lit(float(v[j] / sd[j])) * (F.col(c) - float(mean[j])) for j, c in enumerate(columns)]
        out = out.withColumn(f"pc{i + 1}", sum(terms[1:], terms[0]))
    return out


def isolation_forest(df: DataFrame, key: str, columns: Sequence[str], trees: int = 50, sample: int = 256, seed: int = 42) -> DataFrame:
    """(key, score): trees are grown on seeded samples of ``sample`` rows each, a documented bound, and score every row.

    Scores near 1 are outliers. Null attributes count as 0.
    """
    need = trees * sample
    chosen = df.select(key, *columns).orderBy(F.xxhash64(key, F.lit(seed)), key).limit(need).fillna(0).toPandas()[list(columns)].to_numpy(float)
    rng = np.random.default_rng(seed)

    def grow(x: np.ndarray, depth: int) -> tuple:
        spread = x.max(axis=0) - x.min(axis=0) if len(x) else np.zeros(len(columns))
        if len(x) <= 1 or depth == 0 or not (spread > 0).any():
            return (len(x),)
        c = int(rng.choice(np.flatnonzero(spread > 0)))
        cut = float(rng.uniform(x[:, c].min(), x[:, c].max()))
        return (c, cut, grow(x[x[:, c] < cut], depth - 1), grow(x[x[:, c] >= cut], depth - 1))

    size = min(sample, len(chosen))
    forest = [grow(chosen[rng.choice(len(chosen), size, replace=False)], math.ceil(math.log2(max(2, size)))) for _ in range(trees)] if size else []

    def expected(n: float) -> float:
        return 0.0 if n <= 1 else 2 * (math.log(n - 1) + 0.5772156649) - 2 * (n - 1) / n if n > 2 else 1.0

    def lengths(node: tuple, x: np.ndarray, rows: np.ndarray, depth: int, out: np.ndarray) -> None:
        if len(node) == 1:
            out[rows] += depth + expected(node[0])
            return
        left = x[rows, node[0]] < node[1]
        lengths(node[2], x, rows[left], depth + 1, out)
        lengths(node[3], x, rows[~left], depth + 1, out)

    def score(batches):
        for pdf in batches:
            x, out = pdf[list(columns)].to_numpy(float), np.zeros(len(pdf))
            for tree in forest:
                lengths(tree, x, np.arange(len(pdf)), 0, out)
            yield pd.DataFrame({key: pdf[key], "score": 2 ** (-out / max(1, len(forest)) / max(1e-9, expected(size)))})

    return df.select(key, *columns).fillna(0, list(columns)).mapInPandas(score, f"{key} {df.schema[key].dataType.simpleString()}, score double")


#: Distinct value pairs whose discordant pairs one task counts, and groups that pairwise comparisons take on the driver.
KENDALL_PAIRS, TUKEY_GROUPS = 200_000, 500


def _swaps(y: np.ndarray, w: np.ndarray) -> float:
    """Weighted number of discordant pairs of a sequence: earlier and strictly larger, by merging halves."""
    if len(y) < 2:
        return 0.0
    m = len(y) // 2
    total = _swaps(y[:m], w[:m]) + _swaps(y[m:], w[m:])
    order = np.argsort(y[:m], kind="stable")
    left, weights = y[:m][order], np.r_[0.0, np.cumsum(w[:m][order])]
    return total + float((w[m:] * (weights[-1] - weights[np.searchsorted(left, y[m:], side="right")])).sum())


def _in_ranges(counts: DataFrame, column: str, size: int, out: str) -> DataFrame:
    """(column, out): the number of the range of about ``size`` rows in which a value lies; a value of more rows has a
    range, with an odd number, of its own."""
    each = counts.groupBy(column).agg(F.count(F.lit(1)).alias("m"))
    below = ranks.running(each, [column], F.col("m"))
    return below.select(column, (2 * F.floor(F.col("below") / size) + (F.col("m") > size).cast("int")).alias(out))


def _discordant(counts: DataFrame, rows: int) -> float:
    """The weighted number of discordant pairs of rows (x, y, n), x and y distinct together.

    Few rows are counted in one task. Many are cut into ranges of x and of y: pairs within a range of x are counted
    there, pairs of different ranges of x within a range of y there, and all others are discordant as their ranges are,
    which is the same question on far fewer rows.
    """

    def swapped(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["x", "y"])
        return pd.DataFrame({"d": [_swaps(pdf["y"].to_numpy(float), pdf["n"].to_numpy(float))]})

    if rows <= KENDALL_PAIRS:
        one = counts.select(F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y"), "n")
        return float(one.groupBy(F.lit(1).alias("all")).applyInPandas(lambda pdf: swapped(pdf[["x", "y", "n"]]), "d double").agg(F.coalesce(F.sum("d"), F.lit(0.0))).first()[0])
    size = max(KENDALL_PAIRS // 4, int(4 * math.sqrt(rows)))
    placed = cut(counts.join(_in_ranges(counts, "x", size, "p"), "x").join(_in_ranges(counts, "y", size, "q"), "y"))
    # a value with a range of its own has no discordant pairs within it
    numeric = lambda df, *c: df.select(*[F.col(k).cast("double").alias(n) for k, n in zip(c, "xy")], "n", *c[2:])
    by_x = numeric(placed.filter("p % 2 = 0"), "x", "y", "p").groupBy("p").applyInPandas(lambda pdf: swapped(pdf[["x", "y", "n"]]), "d double")
    by_y = numeric(placed.filter("q % 2 = 0"), "p", "y", "q").groupBy("q").applyInPandas(lambda pdf: swapped(pdf[["x", "y", "n"]]), "d double")
    inside = float(by_x.unionByName(by_y).agg(F.coalesce(F.sum("d"), F.lit(0.0))).first()[0])
    coarse = cut(placed.groupBy(F.col("p").alias("x"), F.col("q").alias("y")).agg(F.sum("n").alias("n")))
    return inside + _discordant(coarse, coarse.count())


def kendall(df: DataFrame, x: str, y: str) -> float | None:
    """Kendall's tau-b from counts of distinct pairs, exact for any number of them. Null if a column is constant."""
    known = df.filter(F.col(x).isNotNull() & F.col(y).isNotNull())
    counts = cut(known.groupBy(F.col(x).alias("x"), F.col(y).alias("y")).agg(F.count(F.lit(1)).alias("n")))
    pairs = F.coalesce(F.sum(F.col("n").cast("double") * (F.col("n") - 1) / 2), F.lit(0.0))
    tied = lambda *by: float(counts.groupBy(*by).agg(F.sum("n").alias("n")).agg(pairs).first()[0])
    every, tx, ty, txy = tied(), tied("x"), tied("y"), tied("x", "y")
    scale = math.sqrt((every - tx) * (every - ty))
    return None if not scale else (every - tx - ty + txy - 2 * _discordant(counts, counts.count())) / scale


def _beta_part(a: float, b: float, x: float) -> float:
    """Regularised incomplete beta function by its continued fraction."""
    if x <= 0 or x >= 1:
        return float(x >= 1)
    if x > (a + 1) / (a + b + 2):
        return 1 - _beta_part(b, a, 1 - x)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)) / a
    c, d = 1.0, 1 / (1 - (a + b) * x / (a + 1) or 1e-300)
    h = d
    for m in range(1, 10_000):
        for step in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 / (1 + step * d or 1e-300)
            c = 1 + step / c or 1e-300
            h *= d * c
        if abs(d * c - 1) < 1e-14:
            break
    return front * h


def correlation_p(r: float | None, n: int) -> float | None:
    """Two-sided p of a correlation of n pairs by Student's t; null where it has none."""
    if r is None or n < 3:
        return None
    if abs(r) >= 1:
        return 0.0
    t2 = r * r * (n - 2) / (1 - r * r)
    return _beta_part((n - 2) / 2, 0.5, (n - 2) / (n - 2 + t2))


def f_survival(f: float | None, d1: int, d2: int) -> float | None:
    """O3: p of an F statistic."""
    return None if f is None or d1 < 1 or d2 < 1 else _beta_part(d2 / 2, d1 / 2, d2 / (d2 + d1 * f))


def significant(df: DataFrame, groups: Sequence[str], value: str, level: float = 0.05) -> list[tuple[str, float | None, bool]]:
    """O2: (variable, p, chosen) by Kruskal-Wallis; if no variable is significant all are chosen."""
    found = [(g, kruskal_wallis(df, g, value).first()["p"]) for g in groups]
    hits = [p is not None and p < level for _, p in found]
    return [(g, p, hit or not any(hits)) for (g, p), hit in zip(found, hits)]


def chi2_quantile(share: float, dof: int) -> float:
    """The value that a chi-squared variable exceeds with probability 1 - share, by bisection."""
    low, high = 0.0, 10.0 * dof + 100
    for _ in range(200):
        middle = (low + high) / 2
        low, high = (middle, high) if chi2_survival(middle, dof) > 1 - share else (low, middle)
    return (low + high) / 2


def robust_mahalanobis(df: DataFrame, columns: Sequence[str], share: float = 0.75, rounds: int = 10, cutoff: float = 0.999) -> DataFrame:
    """Squared distances (d2) under a robust covariance, and ``outlier`` where they exceed the chi-squared cut-off.

    Concentration steps: means and covariance of the ``share`` of rows with the smallest distances, until these no
    longer change the determinant; the covariance is then scaled so that the median distance is that of normal rows.
    Each step is one exact quantile and one aggregation over all rows. Rows with a null have none.
    """
    known = df.filter(" and ".join(f"`{c}` is not null" for c in columns))
    mean, cov = _moments(known, columns)
    before = None

    def squared(mean: np.ndarray, cov: np.ndarray, scale: float = 1.0):
        inverse = np.linalg.pinv(cov) / scale
        parts = [F.lit(float(inverse[i, j])) * (F.col(a) - float(mean[i])) * (F.col(b) - float(mean[j])) for i, a in enumerate(columns) for j, b in enumerate(columns)]
        return sum(parts[1:], parts[0])

    for _ in range(rounds):
        scored = known.select(*columns, squared(mean, cov).alias("__d2"))
        bound = exact_quantiles(scored, [], "__d2", (share,)).first()
        if bound is None or bound["q0"] is None:
            return df.withColumn("d2", F.lit(None).cast("double")).withColumn("outlier", F.lit(None).cast("boolean"))
        mean, cov = _moments(scored.filter(F.col("__d2") <= bound["q0"]), columns)
        determinant = float(np.linalg.det(cov))
        if before is not None and determinant >= before * (1 - 1e-9):
            break
        before = determinant
    median = exact_quantiles(known.select(squared(mean, cov).alias("__d2")), [], "__d2", (0.5,)).first()["q0"]
    scale = median / chi2_quantile(0.5, len(columns)) if median else 1.0
    out = df.withColumn("d2", squared(mean, cov, scale))
    return out.withColumn("outlier", F.col("d2") > chi2_quantile(cutoff, len(columns)))


def isolation_outliers(scores: DataFrame, contamination: float = 0.01) -> DataFrame:
    """Adds ``outlier`` to scores: the share ``contamination`` of rows with the highest ones."""
    bound = exact_quantiles(scores, [], "score", (1 - contamination,)).select(F.col("q0").alias("__bound"))
    return scores.crossJoin(F.broadcast(bound)).withColumn("outlier", F.col("score") > F.col("__bound")).drop("__bound")


def far_from_group_mean(df: DataFrame, group: str, value: str, k: float = 3.0) -> DataFrame:
    """The rows more than k deviations from their own group's mean, each group judged by itself."""
    m = df.groupBy(F.col(group).alias("__g")).agg(F.avg(value).alias("__m"), F.stddev_pop(value).alias("__s"))
    return df.join(m, F.col(group).eqNullSafe(F.col("__g"))).filter(F.abs(F.col(value) - F.col("__m")) > k * F.col("__s")).drop("__g", "__m", "__s")


def studentised_range_survival(q: float, k: int, dof: float) -> float:
    """P(range of k normal means over an independent deviation > q), by numeric integration."""
    z = np.linspace(-8, 8, 801)
    phi = np.exp(-z * z / 2) / math.sqrt(2 * math.pi)
    below = np.array([0.5 * math.erfc(-v / math.sqrt(2)) for v in z])
    s = np.linspace(max(1e-3, 1 - 8 / math.sqrt(2 * dof)), 1 + 8 / math.sqrt(2 * dof), 401)
    density = np.exp(math.log(2) + dof / 2 * math.log(dof / 2) - math.lgamma(dof / 2) + (dof - 1) * np.log(s) - dof * s * s / 2)
    inside = np.array([k * np.trapezoid(phi * np.clip(below - np.interp(z - q * v, z, below, left=0.0), 0, 1) ** (k - 1), z) for v in s])
    return float(min(1.0, max(0.0, 1 - np.trapezoid(density * inside, s))))


def tukey(df: DataFrame, group: str, value: str) -> DataFrame:
    """O3: (a, b, difference, p) of every pair of groups by Tukey's honest significant difference (Tukey-Kramer).

    Groups are summed in Spark; more than TUKEY_GROUPS of them are refused. Null groups and values are left out.
    """
    per = df.filter(F.col(group).isNotNull() & F.col(value).isNotNull()).groupBy(F.col(group).alias("g")).agg(F.count(value).alias("n"), F.avg(value).alias("m"), F.var_pop(value).alias("v")).limit(TUKEY_GROUPS + 1).toPandas().sort_values("g")
    if len(per) > TUKEY_GROUPS:
        raise ValueError(f"more than {TUKEY_GROUPS} groups")
    dof, rows = int(per["n"].sum()) - len(per), []
    error = float((per["n"] * per["v"]).sum()) / dof if dof > 0 else 0.0
    for i, a in enumerate(per.itertuples(index=False)):
        for b in list(per.itertuples(index=False))[i + 1 :]:
            spread = math.sqrt(error / 2 * (1 / a.n + 1 / b.n))
            p = studentised_range_survival(abs(a.m - b.m) / spread, len(per), dof) if spread else None
            rows.append((str(a.g), str(b.g), float(b.m - a.m), p))
    return df.sparkSession.createDataFrame(rows, "a string, b string, difference double, p double")
