"""Scores against labels: AUC, reports, precision-recall and threshold tables."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sproutscope import schemas as S
from sproutscope.functions.scalars import safe_ratio
from sproutscope.operators.ranks import running_tallies
from sproutscope.operators.stats import auc_of, rank_statistics


def auc(df: DataFrame, label: str = "label", score: str = "score") -> DataFrame:
    """One row ``(n1, n2, auc)``, exact with ties."""
    return auc_of(df, score, label)


def fold_auc(df: DataFrame, fold: str = "fold", label: str = "label", score: str = "score") -> DataFrame:
    """Exact AUC of every fold, all folds ranked in one pass."""
    pairs = F.col("n1").cast("double") * F.col("n2")
    return rank_statistics(df, score, label, series=F.col(fold)).select(
        F.col("series").alias("fold"), "n1", "n2", F.when(pairs > 0, F.col("u") / pairs).alias("auc")
    )


def auc_spread(folds: DataFrame) -> DataFrame:
    """Mean and population deviation over the folds."""
    return folds.agg(F.avg("auc").alias("mean_auc"), F.stddev_pop("auc").alias("std_auc"))


def _ratio(part: Column, whole: Column) -> Column:
    return F.coalesce(safe_ratio(part, whole), F.lit(0.0))


def _f1(precision: Column, recall: Column) -> Column:
    return _ratio(2 * precision * recall, precision + recall)


def _confusion(hit: Column, actual: Column, prefix: str = "") -> list[Column]:
    return [
        F.count_if(hit & actual).alias(f"{prefix}tp"),
        F.count_if(hit & ~actual).alias(f"{prefix}fp"),
        F.count_if(~hit & actual).alias(f"{prefix}fn"),
        F.count_if(~hit & ~actual).alias(f"{prefix}tn"),
    ]


def _quality(tp: Column, fp: Column, fn: Column) -> tuple[Column, Column, Column]:
    precision, recall = _ratio(tp, tp + fp), _ratio(tp, tp + fn)
    return precision, recall, _f1(precision, recall)


def class_report(df: DataFrame, label: str = "label", prediction: str = "prediction") -> DataFrame:
    """Precision, recall, F1 and support per class, with accuracy and the two averages."""
    counts = df.agg(*_confusion(F.col(prediction) == 1, F.col(label) == 1))
    tp, fp, fn, tn = F.col("tp"), F.col("fp"), F.col("fn"), F.col("tn")
    n0, n1, n = tn + fp, tp + fn, tp + fp + fn + tn
    zero, one = _quality(tn, fn, fp), _quality(tp, fp, fn)
    accuracy = _ratio(tp + tn, n)
    names = ("precision", "recall", "f1")
    row = lambda name, values, support: F.struct(
        F.lit(name).alias("class"),
        *[v.cast("double").alias(m) for m, v in zip(names, values)],
        support.alias("support"),
    )
    macro = [(a + b) / 2 for a, b in zip(zero, one)]
    weighted = [_ratio(a * n0 + b * n1, n) for a, b in zip(zero, one)]
    rows = F.array(
        row("0", zero, n0),
        row("1", one, n1),
        row("accuracy", [accuracy] * 3, n),
        row("macro avg", macro, n),
        row("weighted avg", weighted, n),
    )
    return counts.select(F.explode(rows).alias("r")).select("r.*")


def pr_curve(df: DataFrame, label: str = "label", score: str = "score") -> DataFrame:
    """Precision, recall and F1 when everything scoring at least the threshold is positive."""
    placed = running_tallies(
        df.where(F.col(label).isNotNull()),
        score,
        {"pos": F.count_if(F.col(label) == 1), "neg": F.count_if(F.col(label) == 0)},
    )
    tp = F.col("total_pos") - F.col("before_pos")
    fp = F.col("total_neg") - F.col("before_neg")
    precision, recall, f1 = _quality(tp, fp, F.col("before_pos"))
    return placed.select(
        F.col("value").alias("threshold"),
        precision.alias("precision"),
        recall.alias("recall"),
        f1.alias("f1"),
    )


def best_f1_threshold(df: DataFrame, label: str = "label", score: str = "score") -> DataFrame:
    """The threshold with the largest F1, the lowest on ties."""
    return pr_curve(df, label, score).orderBy(F.col("f1").desc(), "threshold").limit(1)


def threshold_table(
    df: DataFrame, thresholds=S.SCORE_THRESHOLDS, label: str = "label", score: str = "score"
) -> DataFrame:
    """Precision, F1 and recall at fixed thresholds, from one aggregation."""
    actual = F.col(label) == 1
    counts = df.agg(
        *[
            c
            for i, t in enumerate(thresholds)
            for c in _confusion(F.col(score) >= F.lit(t), actual, f"t{i}_")
        ]
    )
    rows = []
    for i, t in enumerate(thresholds):
        precision, recall, f1 = _quality(F.col(f"t{i}_tp"), F.col(f"t{i}_fp"), F.col(f"t{i}_fn"))
        rows.append(
            F.struct(
                F.lit(float(t)).alias("k"),
                precision.alias("precision"),
                f1.alias("f1"),
                recall.alias("recall"),
            )
        )
    return counts.select(F.explode(F.array(*rows)).alias("r")).select("r.*")
