import math
import random

import pytest
from pyspark.sql import functions as F

from sproutscope.functions.scalars import feature_of_condition, interval_label
from sproutscope.operators import evaluation as ev
from sproutscope.operators import series as ser
from sproutscope.operators import stats


def _pairs_u(pos, neg):
    return sum((p > n) + 0.5 * (p == n) for p in pos for n in neg)


@pytest.fixture(scope="module")
def sample(spark):
    random.seed(2)
    rows = [(random.choice([0, 0, 1]), round(random.gauss(0, 1), 1)) for _ in range(400)]
    rows = [(y, x + 0.3 * y) for y, x in rows]
    return rows, spark.createDataFrame(rows, "y int, x double").withColumn("x", F.round("x", 1))


def test_mann_whitney(sample):
    rows, df = sample
    pos = [round(x, 1) for y, x in rows if y == 1]
    neg = [round(x, 1) for y, x in rows if y == 0]
    got = stats.mann_whitney(df, "x", "y").first()
    assert (got.n1, got.n2) == (len(pos), len(neg))
    assert got.u == pytest.approx(_pairs_u(pos, neg))
    assert got.p == pytest.approx(math.erfc(got.z / math.sqrt(2)))
    assert ev.auc(df.select(F.col("y").alias("label"), F.col("x").alias("score"))).first().auc == pytest.approx(
        got.u / (len(pos) * len(neg))
    )


def test_auc_of_negated_score(sample):
    _, df = sample
    a = ev.auc(df, "y", "x").first().auc
    b = ev.auc(df.withColumn("x", -F.col("x")), "y", "x").first().auc
    assert a + b == pytest.approx(1.0)


def test_one_class_only(spark):
    df = spark.createDataFrame([(1, 1.0), (1, 2.0)], "y int, x double")
    got = stats.mann_whitney(df, "x", "y").first()
    assert got.n2 == 0 and got.z is None


@pytest.mark.parametrize(
    "t,dof,p",
    [(0.0, 10, 1.0), (2.228138852, 10, 0.05), (12.70620474, 1, 0.05), (1.959963985, 10_000_000, 0.05), (63.65674116, 1, 0.01)],
)
def test_student_p(t, dof, p):
    assert stats._student_two_sided(t, dof) == pytest.approx(p, rel=1e-4)


def test_point_biserial(sample):
    rows, df = sample
    got = stats.point_biserial(df, "x", "y").first()
    n = len(rows)
    mx, my = sum(round(x, 1) for _, x in rows) / n, sum(y for y, _ in rows) / n
    cov = sum((round(x, 1) - mx) * (y - my) for y, x in rows)
    r = cov / math.sqrt(sum((round(x, 1) - mx) ** 2 for _, x in rows) * sum((y - my) ** 2 for y, _ in rows))
    assert got.r == pytest.approx(r)
    assert 0 <= got.p <= 1


def test_balanced_logit_is_the_penalised_optimum(sample):
    """The gradient of the balanced, L2-penalised loss vanishes at the solution."""
    rows, df = sample
    beta = stats.balanced_logit(df, ["x"], "y").first().coefficient
    xs, ys = [round(x, 1) for _, x in rows], [y for y, _ in rows]
    n, mean = len(xs), sum(xs) / len(xs)
    sd = math.sqrt(sum((x - mean) ** 2 for x in xs) / n)
    z = [(x - mean) / sd for x in xs]
    w = [n / (2 * ys.count(y)) for y in ys]
    loss_gradient = lambda b, c: (
        b + sum(wi * zi * (1 / (1 + math.exp(-(b * zi + c))) - yi) for wi, zi, yi in zip(w, z, ys)),
        sum(wi * (1 / (1 + math.exp(-(b * zi + c))) - yi) for wi, zi, yi in zip(w, z, ys)),
    )
    low, high = -5.0, 5.0
    for _ in range(80):
        mid = (low + high) / 2
        low, high = (mid, high) if loss_gradient(beta, mid)[1] < 0 else (low, mid)
    assert abs(loss_gradient(beta, low)[0]) < 1e-2


def test_bins(spark):
    df = spark.createDataFrame([(0.0,), (0.33,), (0.331,), (1.0,), (None,)], "x double")
    got = [r.g for r in df.select(interval_label(F.col("x")).alias("g")).collect()]
    assert got == [None, "Low (0.0-0.33)", "Medium (0.33-0.66)", "High (0.66-1.0)", None]


def test_empty_bins_are_kept(spark):
    df = spark.createDataFrame([(0.5, 1), (0.6, 0), (0.0, 1)], "divergence_ratio double, is_sustainable int")
    got = {r.divergence_group: (r["count"], r.sustainability_rate) for r in stats.group_stats(df).collect()}
    assert got == {"Low (0.0-0.33)": (0, None), "Medium (0.33-0.66)": (2, 50.0), "High (0.66-1.0)": (0, None)}


def test_standardize_constant_column(spark):
    df = spark.createDataFrame([(2.0, 1.0), (2.0, 3.0)], "a double, b double")
    got = stats.standardize(df, ["a", "b"]).collect()
    assert [(r.a, r.b) for r in got] == [(0.0, -1.0), (0.0, 1.0)]


def test_thresholds_and_best_f1(spark):
    rows = [(1, 0.9), (0, 0.8), (1, 0.6), (0, 0.4), (0, 0.2)]
    df = spark.createDataFrame(rows, "label int, score double")
    table = {r.k: (r.precision, r.recall) for r in ev.threshold_table(df).collect()}
    assert table[0.5] == (pytest.approx(2 / 3), 1.0)
    assert table[0.7] == (0.5, 0.5)
    best = ev.best_f1_threshold(df).first()
    assert (best.threshold, best.f1) == (0.6, pytest.approx(0.8))
    none = ev.threshold_table(df.where("score < 0.3")).collect()
    assert all(r.precision == 0 and r.recall == 0 for r in none)


def test_rule_names(spark):
    rules = ["stars <= 1.00", "1.00 < stars <= 5.00", "-2.50 < a b <= +3", "has_license=1", "12", "x > 3"]
    df = spark.createDataFrame([(r,) for r in rules], "r string")
    got = [r.f for r in df.select(feature_of_condition(F.col("r")).alias("f")).collect()]
    assert got == ["stars", "stars", "a b", "has_license", "12", "x"]


def test_popular_boundary(spark):
    df = spark.createDataFrame(
        [
            ("five", "2024-01-15T00:00:00Z", {"2024-02": 3, "2024-03": 2, "2024-04": 9}),
            ("six", "2024-11-15T00:00:00Z", {"2024-11": 1, "2024-12": 3, "2025-01": 2}),
            ("empty", "2024-01-15T00:00:00Z", {}),
            ("null", "2024-01-15T00:00:00Z", None),
        ],
        "childName string, forkTime string, commitTimes map<string,long>",
    )
    assert [r.childName for r in ser.popular(df).collect()] == ["six"]
    assert {r.childName for r in ser.non_empty_series(df).collect()} == {"five", "six"}


def test_early_sustained_uses_active_months(spark):
    series = spark.createDataFrame(
        [("r", "2024-01", 5), ("r", "2024-05", 4), ("r", "2024-06", 3), ("r", "2024-09", 1), ("s", "2024-01", 9)],
        "repo_name string, month string, commits long",
    )
    got = {r.repo_name: (r.early_commits, r.sustained_commits, r.healthy) for r in ser.early_sustained(series).collect()}
    assert got == {"r": (12, 1, 0), "s": (9, 0, 0)}
