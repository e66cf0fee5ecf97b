"""Monthly commit series and the cohort filters built on them."""

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sproutscope import schemas as S
from sproutscope.functions.scalars import month_of, month_prefix, month_start, plus_months, safe_ratio
from sproutscope.operators.windows import anchors_of
from sproutscope.session import stage
from sproutscope.sizing import attach


def monthly_counts(commits: DataFrame, repo: str = "repo_name", ts: str = "event_ts") -> DataFrame:
    """Long form: ``(repo_name, month, commits)``."""
    return commits.groupBy(F.col(repo).alias("repo_name"), month_of(F.col(ts)).alias("month")).agg(
        F.count("*").alias("commits")
    )


def monthly_series(commits: DataFrame, repo: str = "repo_name", ts: str = "event_ts") -> DataFrame:
    """Map form: ``(repo_name, commit_times)`` with the months in order.

    A map holds one entry per calendar month of the repository's life.
    """
    pairs = F.array_sort(F.collect_list(F.struct("month", "commits")))
    return monthly_counts(commits, repo, ts).groupBy("repo_name").agg(
        F.map_from_entries(pairs).alias("commit_times")
    )


def series_rows(series: DataFrame) -> DataFrame:
    """Map form back to long form."""
    return series.select("repo_name", F.explode("commit_times").alias("month", "commits"))


def commits_after(
    commits: DataFrame, months: int = 2, repo: str = "repo_name", ts: str = "event_ts", event_id: str = "event_id"
) -> DataFrame:
    """Commits at or after the first commit plus ``months`` calendar months."""
    named = commits.select(
        F.col(repo).alias("repo_name"), F.col(ts).alias("ts"), F.col(event_id).alias("event_id")
    )
    # staged: counted for the join and read by it
    first = stage(named.groupBy("repo_name").agg(F.min("ts").alias("first_ts")), "first-commits")
    late = F.col("ts") >= plus_months(F.col("first_ts"), months)
    return (
        attach(named, first, "repo_name", spread=F.col("event_id"))
        .groupBy("repo_name")
        .agg(F.count_if(late).alias("commits_post"))
    )


def early_sustained(
    series: DataFrame, active_months: int = 3, healthy_from: int = 2
) -> DataFrame:
    """Commits of the first active months, of the rest, and whether the rest is enough.

    ``series`` is in long form; a window sees one row per month of a repository.
    """
    by_month = Window.partitionBy("repo_name").orderBy("month")
    ranked = series.where(F.col("commits") > 0).withColumn("rank", F.row_number().over(by_month))
    early = F.col("rank") <= active_months
    return (
        ranked.groupBy("repo_name")
        .agg(
            F.sum(F.when(early, F.col("commits")).otherwise(0)).alias("early_commits"),
            F.sum(F.when(~early, F.col("commits")).otherwise(0)).alias("sustained_commits"),
        )
        .withColumn("healthy", (F.col("sustained_commits") >= healthy_from).cast("int"))
    )


def issue_totals(df: DataFrame, opened: str = "open_issues_count", closed: str = "closed_issues_count") -> DataFrame:
    """Adds ``total_issues`` and ``issue_closure_rate`` (0 without issues)."""
    total = F.coalesce(F.col(opened), F.lit(0)) + F.coalesce(F.col(closed), F.lit(0))
    return df.withColumn("total_issues", total).withColumn(
        "issue_closure_rate",
        F.coalesce(safe_ratio(F.coalesce(F.col(closed), F.lit(0)), total), F.lit(0.0)),
    )


def eda_population(df: DataFrame, min_total: int = S.MIN_SERIES_COMMITS) -> DataFrame:
    return df.where(F.col("early_commits") + F.col("sustained_commits") >= min_total)


def non_empty_series(df: DataFrame, series: str = "commitTimes") -> DataFrame:
    return df.where(F.size(series) > 0)


def popular(
    df: DataFrame,
    months: int = S.POPULAR_MONTHS,
    more_than: int = S.POPULAR_MORE_THAN,
    series: str = "commitTimes",
    start: str = "forkTime",
) -> DataFrame:
    """Series with more than ``more_than`` commits in the calendar months from the fork on."""
    first = F.to_date(F.concat(month_prefix(F.col(start)), F.lit("-01")))
    commits = [
        F.coalesce(
            F.try_element_at(F.col(series), F.date_format(F.add_months(first, k), "yyyy-MM")), F.lit(0)
        )
        for k in range(months)
    ]
    total = sum(commits[1:], commits[0])
    return non_empty_series(df, series).where(total > more_than)


def min_commits(
    commits: DataFrame, cohort: DataFrame, n: int = S.MIN_SERIES_COMMITS, months: int | None = None
) -> DataFrame:
    """Cohort rows with at least ``n`` commits since their creation.

    With ``months`` the count stops at the first day of the creation month plus that many
    months; without it all later commits count.
    """
    ts, created = F.col("event_ts"), F.col("created_at")
    counted = attach(
        commits.select("repo_name", "event_ts", "event_id"),
        anchors_of(cohort),
        "repo_name",
        spread=F.col("event_id"),
    ).where(ts >= created)
    if months is not None:
        counted = counted.where(ts <= plus_months(month_start(created), months))
    enough = (
        counted.groupBy("repo_name").agg(F.count("*").alias("commits")).where(F.col("commits") >= n)
    )
    return cohort.join(enough, "repo_name")
