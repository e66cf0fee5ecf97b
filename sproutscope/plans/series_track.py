"""The commit-series track: from fork events and commits to the exploratory table."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sproutscope import schemas as S
from sproutscope.operators.governance import enriched_forks
from sproutscope.operators.series import (
    early_sustained, eda_population, issue_totals, non_empty_series, popular, series_rows,
)


def popular_series(documents: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``(documents with commits, documents popular in their first months)``."""
    kept = non_empty_series(documents)
    return kept, popular(kept)


def eda_table(fork_events: DataFrame, commits: DataFrame, responses: DataFrame) -> DataFrame:
    """One row per fork with enough commits: early and later commits, stars, issues, health."""
    enriched = enriched_forks(fork_events, commits, responses)
    features = early_sustained(series_rows(enriched))
    joined = eda_population(enriched.join(features, "repo_name"))
    return issue_totals(joined).select(
        F.col("repo_name").alias("repo"), *[c for c in S.EDA_COLUMNS if c != "repo"]
    )
