"""Statistics relating a numeric measure to a binary label."""

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sproutscope import schemas as S
from sproutscope.functions.scalars import indicator, interval_label
from sproutscope.operators.ranks import medians, running_tallies
from sproutscope.session import stage


def _known(df: DataFrame, value: str, label: str) -> DataFrame:
    return df.select(
        F.col(value).cast("double").alias("value"), F.col(label).cast("int").alias("label")
    ).where(F.col("value").isNotNull() & F.col("label").isNotNull())


def group_stats(
    df: DataFrame, value: str = "divergence_ratio", label: str = "is_sustainable", bins=S.DIVERGENCE_BINS
) -> DataFrame:
    """Size, positives, rate in percent and mean value per interval; empty ones are kept."""
    grouped = (
        df.select(
            interval_label(F.col(value), bins).alias("divergence_group"),
            F.col(value).cast("double").alias("value"),
            F.col(label).alias("label"),
        )
        .where(F.col("divergence_group").isNotNull())
        .groupBy("divergence_group")
        .agg(
            F.count("*").alias("count"),
            F.sum("label").alias("sustainable"),
            (F.avg("label") * 100).alias("sustainability_rate"),
            F.avg("value").alias("avg_divergence"),
        )
    )
    names = df.sparkSession.createDataFrame(
        [(i, name) for i, (_, _, name) in enumerate(bins)], "bin int, divergence_group string"
    )
    return (
        names.join(grouped, "divergence_group", "left")
        .fillna(0, subset=["count", "sustainable"])
        .orderBy("bin")
        .drop("bin")
    )


def class_summary(df: DataFrame, value: str, label: str = "is_sustainable") -> DataFrame:
    """Rows, mean and exact median of a measure in each class."""
    known = _known(df, value, label)
    means = known.groupBy("label").agg(F.avg("value").alias("mean"))
    middle = medians(known, "value", F.col("label")).select(
        F.col("series").cast("int").alias("label"), "n", "median"
    )
    return means.join(middle, "label").select("label", "n", "mean", "median")


def feature_coverage(df: DataFrame, value: str, label: str = "is_sustainable") -> DataFrame:
    """Rows with and without a measure, and the positive rate overall and where it is known."""
    has = F.col(value).isNotNull()
    return df.agg(
        F.count("*").alias("total"),
        F.count_if(has).alias("with_value"),
        F.count_if(~has).alias("missing"),
        (F.avg(label) * 100).alias("rate_all"),
        (F.avg(F.when(has, F.col(label))) * 100).alias("rate_with_value"),
    )


@F.pandas_udf(T.DoubleType())
def _normal_p(z: pd.Series) -> pd.Series:
    return z.map(lambda v: min(1.0, math.erfc(v / math.sqrt(2.0))), na_action="ignore")


def _student_two_sided(t: float, dof: float) -> float:
    """Two-sided Student p-value by Simpson's rule on the angle substitution.

    With ``x = sqrt(dof) * tan(a)`` the density is proportional to ``cos(a) ** (dof - 1)``,
    smooth and bounded. The grid ends where that factor has fallen below any effect.
    """
    if dof <= 0 or math.isnan(t):
        return float("nan")
    start = math.atan(abs(t) / math.sqrt(dof))
    negligible = math.acos(math.exp(-50.0 / (dof - 1))) if dof > 1 else math.pi / 2
    stop = math.pi / 2 if dof < 30 else min(math.pi / 2, start + negligible)
    log_norm = math.lgamma((dof + 1) / 2) - math.lgamma(dof / 2) - 0.5 * math.log(math.pi)
    steps = 4_000
    width = (stop - start) / steps
    height = lambda a: math.exp(log_norm + (dof - 1) * math.log(max(math.cos(a), 1e-300)))
    area = height(start) + height(stop)
    area += sum((4 if i % 2 else 2) * height(start + width * i) for i in range(1, steps))
    return min(1.0, 2 * area * width / 3)


@F.pandas_udf(T.DoubleType())
def _student_p(t: pd.Series, dof: pd.Series) -> pd.Series:
    return pd.Series([_student_two_sided(a, b) for a, b in zip(t, dof)], dtype="float64")


def _exact(column: Column) -> Column:
    return column.cast(T.DecimalType(38, 0))


def rank_statistics(
    df: DataFrame, value: str, label: str, series: Column | None = None
) -> DataFrame:
    """``(series, n1, n2, u, ties)``: U of the positive class over midranks, ties as sum(t^3 - t).

    Ranks are doubled so that all sums stay whole numbers. ``series`` ranks several groups
    (folds) separately.
    """
    known = df.where(F.col(value).isNotNull() & F.col(label).isNotNull())
    placed = running_tallies(
        known,
        value,
        {"pos": F.count_if(F.col(label) == 1), "neg": F.count_if(F.col(label) == 0)},
        series,
    )
    tied = F.col("pos") + F.col("neg")
    doubled_rank = 2 * (F.col("before_pos") + F.col("before_neg")) + tied + 1
    folded = placed.groupBy("series").agg(
        F.max("total_pos").alias("n1"),
        F.max("total_neg").alias("n2"),
        F.sum(_exact(F.col("pos")) * doubled_rank).cast("double").alias("doubled"),
        F.sum(tied.cast("double") * tied * tied - tied).alias("ties"),
    )
    n1 = F.col("n1").cast("double")
    return folded.select(
        "series", "n1", "n2", ((F.col("doubled") - n1 * (n1 + 1)) / 2).alias("u"), "ties"
    )


def mann_whitney(df: DataFrame, value: str, label: str = "is_sustainable") -> DataFrame:
    """Two-sided Mann-Whitney test, normal form with continuity and tie correction."""
    n1, n2 = F.col("n1").cast("double"), F.col("n2").cast("double")
    n = n1 + n2
    sigma = F.sqrt(n1 * n2 / 12 * ((n + 1) - F.col("ties") / (n * (n - 1))))
    distance = F.greatest(F.col("u"), n1 * n2 - F.col("u")) - n1 * n2 / 2 - 0.5
    tested = rank_statistics(df, value, label).withColumn(
        "z", F.when(sigma > 0, distance / sigma)
    )
    return tested.withColumn("p", _normal_p("z")).select("n1", "n2", "u", "z", "p")


def auc_of(df: DataFrame, score: str, label: str) -> DataFrame:
    """Exact area under the ROC curve: U over the number of pairs."""
    pairs = F.col("n1").cast("double") * F.col("n2")
    return rank_statistics(df, score, label).select(
        "n1", "n2", F.when(pairs > 0, F.col("u") / pairs).alias("auc")
    )


def point_biserial(df: DataFrame, value: str, label: str = "is_sustainable") -> DataFrame:
    """Correlation of a measure with a 0/1 label, its t statistic and two-sided p."""
    known = _known(df, value, label)
    row = known.agg(F.count("*").alias("n"), F.corr("label", "value").alias("r"))
    r, dof = F.col("r"), F.col("n") - 2
    return row.select("n", "r", (r * F.sqrt(dof / (1 - r * r))).alias("t")).withColumn(
        "p", _student_p("t", F.col("n").cast("double") - 2)
    )


def standardize(df: DataFrame, cols: list[str]) -> DataFrame:
    """Columns centred and divided by their population deviation (1 where it is zero)."""
    moments = df.agg(
        *[F.avg(c).alias(f"m_{i}") for i, c in enumerate(cols)],
        *[F.stddev_pop(c).alias(f"s_{i}") for i, c in enumerate(cols)],
    ).first()
    scaled = {
        c: (F.col(c) - F.lit(moments[f"m_{i}"])) / F.lit(moments[f"s_{i}"] or 1.0)
        for i, c in enumerate(cols)
    }
    return df.withColumns(scaled)


NEWTON_STEPS = 50


def balanced_logit(df: DataFrame, features: list[str], label: str = "is_sustainable") -> DataFrame:
    """Class-balanced, L2-penalised logistic regression on standardised features.

    ``(feature, coefficient, odds_ratio)``, the largest odds ratio first.
    """
    fitted = fit_balanced_logit(df, features, label)
    found = [(f, float(c)) for f, c in zip(features, fitted[1:], strict=True)]
    return (
        df.sparkSession.createDataFrame(found, "feature string, coefficient double")
        .withColumn("odds_ratio", F.exp("coefficient"))
        .orderBy(F.col("odds_ratio").desc(), "feature")
    )


def fit_balanced_logit(df: DataFrame, features: list[str], label: str = "is_sustainable") -> np.ndarray:
    """Intercept and coefficients of the standardised features, by Newton's method.

    Every step is one aggregation of the gradient and the upper half of the Hessian over all
    rows. Steps are halved while the loss grows; the fit ends when the gradient is 0 to rounding.
    """
    prepared = df.select(
        *[F.coalesce(F.col(f).cast("double"), F.lit(0.0)).alias(f) for f in features],
        F.col(label).cast("double").alias("label"),
    ).where(F.col("label").isNotNull())
    sizes = {row["label"]: row["count"] for row in prepared.groupBy("label").count().collect()}
    total = sum(sizes.values())
    weight = F.when(F.col("label") == 1, F.lit(total / (2 * sizes.get(1.0, 1)))).otherwise(
        F.lit(total / (2 * sizes.get(0.0, 1)))
    )
    rows = stage(standardize(prepared, features).withColumn("weight", weight), "logit-rows")
    x = [F.lit(1.0), *[F.col(f) for f in features]]
    k = len(x)
    penalty = np.diag([0.0] + [1.0] * (k - 1))

    def at(beta: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
        """Penalised loss, gradient and Hessian."""
        z = sum((F.lit(float(c)) * v for c, v in zip(beta[1:], x[1:], strict=True)), F.lit(float(beta[0])))
        p = 1 / (1 + F.exp(-z))
        sign = 2 * F.col("label") - 1
        loss = F.greatest(-sign * z, F.lit(0.0)) + F.log1p(F.exp(-F.abs(z)))
        made = rows.select("weight", *features, p.alias("_p"), loss.alias("_loss"), (p - F.col("label")).alias("_r"))
        spread = F.col("weight") * F.col("_p") * (1 - F.col("_p"))
        pairs = [(i, j) for i in range(k) for j in range(i, k)]
        found = made.agg(
            F.sum(F.col("weight") * F.col("_loss")),
            *[F.sum(F.col("weight") * F.col("_r") * v) for v in x],
            *[F.sum(spread * x[i] * x[j]) for i, j in pairs],
        ).first()
        hessian = np.zeros((k, k))
        for (i, j), value in zip(pairs, found[k + 1 :], strict=True):
            hessian[i, j] = hessian[j, i] = value
        return found[0] + 0.5 * beta @ penalty @ beta, np.array(found[1 : k + 1]) + penalty @ beta, hessian + penalty

    beta = np.zeros(k)
    if not total:
        return beta
    loss, gradient, hessian = at(beta)
    for _ in range(NEWTON_STEPS):
        if np.abs(gradient).max() <= 1e-9 * total:
            break
        step = np.linalg.lstsq(hessian, gradient, rcond=None)[0]
        for _ in range(20):
            after = at(beta - step)
            if after[0] <= loss:
                break
            step = step / 2
        else:
            break
        beta, (loss, gradient, hessian) = beta - step, after
    return beta


def logit_with_controls(df: DataFrame, label: str = "is_sustainable") -> DataFrame:
    """The divergence model with its control features; the owner type becomes an indicator."""
    return balanced_logit(with_controls(df), S.LOGIT_CONTROLS, label)


def with_controls(df: DataFrame) -> DataFrame:
    """The rows of the divergence model, its flags as 0/1."""
    return df.withColumns(
        {
            "fork_owner_type": indicator(F.col("fork_owner_type") == "Organization"),
            "has_license": indicator(F.col("has_license")),
            "has_cicd": indicator(F.col("has_cicd")),
        }
    ).where(F.col("divergence_ratio").isNotNull())
