"""Repository cohorts out of raw fork and creation events."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sproutscope import schemas as S
from sproutscope.functions.scalars import comma_list, lenient_timestamp, month_of, prefer


def fork_records(events: DataFrame) -> DataFrame:
    """One cohort row per fork event, :data:`schemas.COHORT_COLUMNS`.

    Absent counts and flags take 0 / false; an unreadable time is kept as null.
    """
    parsed = events.withColumn("forkee", F.from_json("payload", S.FORK_PAYLOAD)["forkee"])
    fork = lambda field: F.col(f"forkee.{field}")
    return parsed.select(
        fork("full_name").alias("repo_name"),
        fork("id").alias("repo_id"),
        lenient_timestamp(fork("created_at")).alias("created_at"),
        F.lit(True).alias("is_fork"),
        fork("default_branch").alias("default_branch"),
        fork("owner.login").alias("fork_owner_login"),
        fork("owner.type").alias("fork_owner_type"),
        F.col("repo.name").alias("parent_repo_name"),
        F.col("repo.id").alias("parent_repo_id"),
        F.col("org.login").alias("parent_org"),
        prefer(fork("stargazers_count"), 0).alias("initial_stars"),
        prefer(fork("forks_count"), 0).alias("initial_forks"),
        prefer(fork("open_issues_count"), 0).alias("initial_open_issues"),
        prefer(fork("size"), 0).alias("initial_size_kb"),
        prefer(fork("has_issues"), False).alias("has_issues_enabled"),
        prefer(fork("has_wiki"), False).alias("has_wiki"),
        prefer(fork("has_discussions"), False).alias("has_discussions"),
        prefer(fork("archived"), False).alias("is_archived"),
        prefer(fork("is_template"), False).alias("is_template"),
        fork("language").alias("initial_language"),
        comma_list(fork("topics")).alias("initial_topics"),
        F.col("id").alias("event_id"),
        lenient_timestamp(F.col("created_at")).alias("event_created_at"),
    )


def creation_records(events: DataFrame) -> DataFrame:
    """One cohort row per creation event; the parent columns are null."""
    when = lenient_timestamp(F.col("created_at"))
    organisation = F.coalesce(F.col("org.login"), F.lit("")) != ""
    rows = events.select(
        F.col("repo.name").alias("repo_name"),
        F.col("repo.id").alias("repo_id"),
        when.alias("created_at"),
        F.lit(False).alias("is_fork"),
        F.from_json("payload", S.CREATION_PAYLOAD)["master_branch"].alias("default_branch"),
        F.col("actor.login").alias("fork_owner_login"),
        F.when(organisation, "Organization").otherwise("User").alias("fork_owner_type"),
        F.lit(None).cast("string").alias("parent_repo_name"),
        F.lit(None).cast("long").alias("parent_repo_id"),
        F.col("org.login").alias("parent_org"),
        F.col("id").alias("event_id"),
        when.alias("event_created_at"),
    )
    return rows.where((F.col("repo_name") != "") & F.col("created_at").isNotNull())


def of_type(events: DataFrame, *types: str) -> DataFrame:
    return events.where(F.col("type").isin(*types))


def drop_unusable(df: DataFrame, key: str, archived_col: str | None = None) -> DataFrame:
    """Drop rows without a key and, when a flag column is named, archived ones."""
    kept = df.where(F.col(key).isNotNull())
    if archived_col:
        kept = kept.where(~F.coalesce(F.col(archived_col), F.lit(False)))
    return kept


def split_intentional(
    df: DataFrame, size_col: str = "initial_size_kb", owner_col: str = "fork_owner_type"
) -> tuple[DataFrame, DataFrame]:
    """``(kept, excluded)``: content or an organisation as owner; unknowns are excluded."""
    intentional = F.coalesce(
        (F.coalesce(F.col(size_col), F.lit(0)) > 0)
        | (F.coalesce(F.col(owner_col), F.lit("")) == "Organization"),
        F.lit(False),
    )
    return df.where(intentional), df.where(~intentional)


def in_months(df: DataFrame, ts_col: str, months=S.COHORT_MONTHS) -> DataFrame:
    """Rows whose month (``yyyy-MM``) is listed.

    The enclosing time range is stated as well so that the scan can prune on it.
    """
    months = sorted(months)
    ts = F.col(ts_col)
    first = F.to_timestamp(F.lit(f"{months[0]}-01"))
    past = F.to_timestamp(F.lit(f"{months[-1]}-01")) + F.expr("INTERVAL '1' MONTH")
    return df.where((ts >= first) & (ts < past) & month_of(ts).isin(*months))


def active_only(df: DataFrame, min_commits: int = 1) -> DataFrame:
    return df.where(F.col("total_commits") >= min_commits)


def dedup_first(df: DataFrame, key: str | list[str], order: list[Column] | list[str]) -> DataFrame:
    """One row per key: the first in the given order.

    An aggregate rather than a window: each task keeps one row per key before the shuffle,
    so copies of one key never gather in one place.
    """
    keys = [key] if isinstance(key, str) else list(key)
    order = [F.col(c) if isinstance(c, str) else c for c in order]
    rank = F.struct(*[c.alias(f"o{i}") for i, c in enumerate(order)])
    row = F.struct(*df.columns)
    return df.groupBy(*keys).agg(F.min_by(row, rank).alias("_row")).select("_row.*")


def latest_per_repo(cohort: DataFrame) -> DataFrame:
    """One row per repository, the latest event winning (ties: the highest event id)."""
    row = F.struct(*cohort.columns)
    return (
        cohort.groupBy("repo_name")
        .agg(F.max_by(row, F.struct("event_created_at", "event_id")).alias("_row"))
        .select("_row.*")
    )


def duplicate_rows(df: DataFrame) -> DataFrame:
    """Whole rows that occur more than once, with their ``copies``; maps compare as text."""
    comparable = [
        F.to_json(F.sort_array(F.map_entries(f.name))).alias(f.name)
        if f.dataType.typeName() == "map"
        else F.col(f.name)
        for f in df.schema.fields
    ]
    return (
        df.select(*comparable)
        .groupBy(*df.columns)
        .agg(F.count("*").alias("copies"))
        .where(F.col("copies") > 1)
    )


def pending(work: DataFrame, done: DataFrame, key: str = "repo_name") -> DataFrame:
    """Work whose key is not among the finished ones."""
    return work.join(done.select(key).distinct(), key, "left_anti")
