"""Counts and ranges that describe a cohort or a dataset; one aggregation pass each."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sproutscope.functions.scalars import months_spanned


def conditional_counts(df: DataFrame, **conditions: Column) -> DataFrame:
    """One row: ``total`` and a count for every named condition."""
    return df.agg(
        F.count("*").alias("total"),
        *[F.count_if(condition).alias(name) for name, condition in conditions.items()],
    )


def date_profile(df: DataFrame, ts: str = "created_at") -> DataFrame:
    first, last = F.min(ts), F.max(ts)
    return df.agg(
        first.alias("earliest"), last.alias("latest"), months_spanned(first, last).alias("span_months")
    )


def cohort_profile(df: DataFrame, months=(12, 1)) -> DataFrame:
    """Rows, rows per creation month of the year and per owner type."""
    return conditional_counts(
        df,
        **{f"created_in_month_{m}": F.month("created_at") == m for m in months},
        user_owned=F.col("fork_owner_type") == "User",
        org_owned=F.col("fork_owner_type") == "Organization",
    )


def dataset_summary(df: DataFrame) -> DataFrame:
    return conditional_counts(
        df,
        forks=F.col("is_fork"),
        non_forks=~F.col("is_fork"),
        with_commits=F.col("total_commits") > 0,
        with_prs=F.col("prs_opened") > 0,
        with_issues=F.col("issues_opened") > 0,
        with_cicd=F.col("has_cicd"),
        with_license=F.col("has_license"),
    )


def null_profile(df: DataFrame, top: int = 10) -> DataFrame:
    """The columns with the most nulls, ties in column-name order."""
    counts = df.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in df.columns])
    return (
        counts.unpivot([], df.columns, "column", "nulls")
        .orderBy(F.col("nulls").desc(), "column")
        .limit(top)
    )


def top_n(df: DataFrame, by: str, n: int, tiebreak: str) -> DataFrame:
    """The ``n`` rows with the largest value; every task keeps at most ``n``."""
    return df.orderBy(F.col(by).desc(), tiebreak).limit(n)


def ordered(df: DataFrame, *keys) -> DataFrame:
    return df.orderBy(*keys)
