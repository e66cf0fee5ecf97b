"""Assembling per-repository features into the wide dataset."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sproutscope.functions.scalars import existing_columns, per_week, safe_ratio


def assemble(cohort: DataFrame, *feature_dfs: DataFrame, zeros=(), key: str = "repo_name") -> DataFrame:
    """Left-join features with one row per key onto the cohort; ``zeros`` become 0 if missing.

    Every side is already hash-partitioned by the key after its aggregation, so the joins
    add no shuffle of their own beyond the cohort's.
    """
    wide = cohort
    for features in feature_dfs:
        wide = wide.join(features, key, "left")
    filled = [name for name in zeros if name in wide.columns]
    return wide.fillna(0, subset=filled) if filled else wide


def with_rates(activity: DataFrame) -> DataFrame:
    return activity.withColumns(
        {
            "pr_acceptance_rate": safe_ratio(F.col("prs_merged"), F.col("prs_opened")),
            "issue_close_rate": safe_ratio(F.col("issues_closed"), F.col("issues_opened")),
            "commit_frequency_per_week": per_week(F.col("total_commits")),
        }
    )


def dataset(cohort: DataFrame, activity: DataFrame, *others: DataFrame) -> DataFrame:
    """The study table: cohort, activity with rates, and any further features, in fixed order."""
    base = cohort.select("repo_name", "is_fork", "fork_owner_type", "created_at")
    return existing_columns(assemble(base, with_rates(activity), *others))
