"""The sustainability label: a push in the label window."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sproutscope import schemas as S
from sproutscope.functions.anchored import LABEL, AnchoredWindow
from sproutscope.operators.windows import events_in_window
from sproutscope.session import stage


def labels(events: DataFrame, cohort: DataFrame, within: AnchoredWindow = LABEL) -> DataFrame:
    """``(repo_name, is_sustainable)`` for every cohort repository."""
    pushes = events.where(F.col("type") == S.PUSH)
    hits = events_in_window(pushes, cohort, within).groupBy("repo_name").agg(
        F.lit(1).alias("is_sustainable")
    )
    return cohort.select("repo_name").join(hits, "repo_name", "left").fillna(
        0, subset=["is_sustainable"]
    )


def attach_labels(df: DataFrame, label_df: DataFrame) -> DataFrame:
    """Adds the label to the dataset; repositories without one stay null."""
    return df.join(label_df.select("repo_name", "is_sustainable"), "repo_name", "left")


def label_balance(df: DataFrame, label: str = "is_sustainable") -> DataFrame:
    """Size and percentage of each class, from one aggregation over the rows."""
    counts = stage(df.groupBy(F.col(label).alias("label")).agg(F.count("*").alias("count")), "label-counts")
    total = counts.agg(F.sum("count")).first()[0]
    return counts.select("label", "count", (100.0 * F.col("count") / F.lit(total)).alias("percentage"))
