import math

import numpy as np

from flowloom.operators import stats
from tests.conftest import rows


def test_tail_of_chi_squared():
    assert abs(stats.chi2_survival(3.841459, 1) - 0.05) < 1e-6
    assert abs(stats.chi2_survival(2 * math.log(100), 2) - 0.01) < 1e-12
    assert stats.chi2_survival(0, 3) == 1.0


def test_ranks_and_kruskal(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", 2.0), ("b", 2.0), ("b", 4.0), ("b", None), (None, 9.0)], "g string, v double")
    assert rows(stats.average_ranks(df, "v").select("value", "n", "rank")) == [(1.0, 1, 1.0), (2.0, 2, 2.5), (4.0, 1, 4.0), (9.0, 1, 5.0)]
    clean = spark.createDataFrame([("a", 1.0), ("a", 2.0), ("a", 3.0), ("b", 4.0), ("b", 5.0), ("b", 6.0)], "g string, v double")
    r = stats.kruskal_wallis(clean, "g", "v").first()
    assert abs(r.h - 3.857142857) < 1e-8 and abs(r.p - 0.0495346) < 1e-6
    same = spark.createDataFrame([("a", 1.0), ("b", 1.0)], "g string, v double")
    assert stats.kruskal_wallis(same, "g", "v").first().h is None


def test_outliers(spark):
    rng = np.random.default_rng(0)
    data = [(i, "m", float(x), float(y)) for i, (x, y) in enumerate(rng.normal(size=(500, 2)))] + [(1000, "m", 9.0, -9.0), (1001, "m", 8.0, 8.0)]
    df = spark.createDataFrame(data, "id bigint, g string, x double, y double")
    assert {1000, 1001} <= {r.id for r in stats.iqr_outliers(df, ["g"], "x").collect()}
    assert {r.id for r in stats.mahalanobis(df, ["x", "y"]).filter("d2 > 20").collect()} == {1000, 1001}
    top = [r.id for r in stats.isolation_forest(df, "id", ["x", "y"]).orderBy("score", ascending=False).limit(2).collect()]
    assert set(top) == {1000, 1001}
    pcs = stats.principal_components(df, ["x", "y"]).agg({"pc1": "avg", "pc2": "avg"}).first()
    assert all(abs(v) < 1e-9 for v in pcs)
    assert stats.mahalanobis(df.limit(0), ["x", "y"]).count() == 0


def brute_tau(data):
    import itertools

    n0 = s = tx = ty = 0
    for (a, b), (c, d) in itertools.combinations(data, 2):
        n0 += 1
        s += (a > c) - (a < c) if b > d else (a < c) - (a > c) if b < d else 0
        tx += a == c
        ty += b == d
    return s / math.sqrt((n0 - tx) * (n0 - ty))


def test_kendall_in_ranges_equals_all_pairs(spark, monkeypatch):
    """One task, and ranges with a hot value on each side."""
    rng = np.random.default_rng(5)
    data = [(float(x), float(y)) for x, y in rng.integers(0, 30, (150, 2))] + [(7.0, float(y)) for y in range(40)] + [(float(x), 3.0) for x in range(40)]
    df = spark.createDataFrame([*data], "x double, y double")
    assert abs(stats.kendall(df, "x", "y") - brute_tau(data)) < 1e-12
    monkeypatch.setattr(stats, "KENDALL_PAIRS", 60)
    assert abs(stats.kendall(df, "x", "y") - brute_tau(data)) < 1e-12
    assert stats.kendall(df.filter("x = 7"), "x", "y") is None


def test_tails():
    x = np.linspace(0.5 * math.sqrt(18 / 0.75), 400, 2_000_001)
    density = math.exp(math.lgamma(9.5) - math.lgamma(9)) / math.sqrt(18 * math.pi) * (1 + x * x / 18) ** -9.5
    assert abs(stats.correlation_p(0.5, 20) - 2 * np.trapezoid(density, x)) < 1e-9
    assert stats.correlation_p(1.0, 5) == 0.0 and stats.correlation_p(None, 5) is None
    assert abs(stats.f_survival(3.0, 2, 10) - 0.0953674) < 1e-6
    assert abs(stats.chi2_quantile(0.999, 2) + 2 * math.log(0.001)) < 1e-9


def test_robust_distances_are_not_masked(spark):
    """A tenth of the rows far away pulls the classical covariance along, not the robust one."""
    rng = np.random.default_rng(1)
    data = [(i, float(x), float(y)) for i, (x, y) in enumerate(rng.normal(size=(450, 2)))] + [(1000 + i, float(x), float(y)) for i, (x, y) in enumerate(rng.normal((12, -12), 0.3, (50, 2)))]
    df = spark.createDataFrame([*data, (5000, None, 1.0)], "id bigint, x double, y double")
    found = {r.id for r in stats.robust_mahalanobis(df, ["x", "y"]).filter("outlier").collect()}
    assert {1000 + i for i in range(50)} <= found and len(found) < 60
    assert stats.robust_mahalanobis(df.limit(0), ["x", "y"]).count() == 0


def test_choice_of_variables_and_groups(spark):
    df = spark.createDataFrame([("a" if i % 2 else "b", "u" if i % 3 else "v", float(i % 2 * 50 + i % 7)) for i in range(120)], "g string, h string, v double")
    chosen = {g: c for g, _, c in stats.significant(df, ["g", "h"], "v")}
    assert chosen == {"g": True, "h": False}
    assert all(c for _, _, c in stats.significant(df, ["h"], "v"))
    scores = spark.createDataFrame([(i, float(i)) for i in range(101)], "id bigint, score double")
    assert {r.id for r in stats.isolation_outliers(scores, 0.02).filter("outlier").collect()} == {99, 100}
