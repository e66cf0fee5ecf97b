"""Governance, parent and issue metadata out of landed API responses; fork divergence."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sproutscope import schemas as S
from sproutscope.functions.anchored import first_days
from sproutscope.functions.scalars import (
    comma_list, is_present, lenient_timestamp, owner_and_name, share_of_total,
)
from sproutscope.operators.features import assemble
from sproutscope.operators.series import commits_after, monthly_series
from sproutscope.operators.spans import counts_in_spans
from sproutscope.sizing import attach


def _repository(responses: DataFrame) -> DataFrame:
    """``(repo_name, r)``: the parsed repository; unanswered and unnamed ones are dropped."""
    owner, _ = owner_and_name(F.col("repo_name"))
    return responses.select(
        "repo_name", F.from_json("response", S.REPOSITORY_RESPONSE)["repository"].alias("r")
    ).where(F.col("r").isNotNull() & owner.isNotNull())


def _governance_columns() -> list[Column]:
    return [
        is_present(F.col("r.contributing")).alias("has_contributing"),
        is_present(F.col("r.codeOfConduct")).alias("has_code_of_conduct"),
        is_present(F.col("r.license")).alias("has_license"),
        is_present(F.col("r.cicd")).alias("has_cicd"),
        F.col("r.primaryLanguage.name").alias("primary_language"),
        comma_list(F.transform("r.repositoryTopics.nodes", lambda n: n["topic"]["name"])).alias("topics"),
    ]


def _parent_columns() -> list[Column]:
    parent = lambda field: F.col(f"r.parent.{field}")
    return [
        parent("nameWithOwner").alias("parent_repo"),
        parent("stargazerCount").alias("parent_stars"),
        parent("forkCount").alias("parent_forks"),
        lenient_timestamp(parent("createdAt")).alias("parent_created_at"),
        parent("primaryLanguage.name").alias("parent_language"),
    ]


def governance(responses: DataFrame) -> DataFrame:
    """Governance flags, language and topics per answered repository.

    ``responses`` is ``(repo_name, response)`` with the response as JSON text.
    """
    return _repository(responses).select("repo_name", *_governance_columns())


def parent_meta(responses: DataFrame) -> DataFrame:
    """Parent name, stars, forks, creation and language; null without a parent."""
    return _repository(responses).select("repo_name", *_parent_columns())


def governance_and_parent(responses: DataFrame) -> DataFrame:
    return _repository(responses).select("repo_name", *_governance_columns(), *_parent_columns())


def divergence(
    commits: DataFrame,
    cohort: DataFrame,
    parent_col: str = "parent_repo",
    days: int = S.EARLY_DAYS,
) -> DataFrame:
    """Commits on the fork and on its parent in the fork's own early window, and their ratio.

    Both sides are spans over the same commits, counted in one pass; a parent with many
    forks never multiplies its commits by them. Without a parent the parent count and the
    ratio are null.
    """
    within = first_days(days)
    created = F.col("created_at")
    opens, closes = within.opens(created), within.closes(created)
    forks = cohort.select(
        "repo_name", F.col(parent_col).alias("parent_repo"), opens.alias("opens"), closes.alias("closes")
    )
    own_spans = forks.select("repo_name", "opens", "closes")
    parent_spans = forks.where(F.col("parent_repo").isNotNull()).select(
        F.col("parent_repo").alias("repo_name"), "opens", "closes"
    )
    counted = counts_in_spans(commits, own_spans.unionByName(parent_spans))
    span = ["opens", "closes"]
    own = counted.withColumnRenamed("events", "early_commits_on_branch")
    parent = counted.withColumnsRenamed(
        {"repo_name": "parent_repo", "events": "parent_early_commits"}
    )
    return (
        forks.join(own, ["repo_name", *span], "left")
        .join(parent, ["parent_repo", *span], "left")
        .select(
            "repo_name",
            "early_commits_on_branch",
            "parent_early_commits",
            share_of_total(
                F.col("early_commits_on_branch"), F.col("parent_early_commits")
            ).alias("divergence_ratio"),
        )
    )


def issue_state(responses: DataFrame) -> DataFrame:
    """Issue counts and stars with a ``status``: ok, deleted, error, or null when unknown.

    ``responses`` is ``(repo_name, issues, stars)``; ``issues`` is an object, a deletion
    marker, the bare word for an error, or null.
    """
    state = F.from_json("issues", S.ISSUE_STATE)
    word = F.trim(F.regexp_replace("issues", '"', ""))
    status = (
        F.when(word == "errors", "error")
        .when(F.col("s.deleted_repo"), "deleted")
        .when(F.col("s.issues_enabled").isNotNull() | F.col("s.open_issues_count").isNotNull(), "ok")
    )
    return responses.withColumn("s", state).select(
        "repo_name",
        status.alias("status"),
        F.col("s.issues_enabled").alias("issues_enabled"),
        F.col("s.open_issues_count").alias("open_issues_count"),
        F.col("s.closed_issues_count").alias("closed_issues_count"),
        "stars",
    )


def enriched_forks(fork_events: DataFrame, commits: DataFrame, responses: DataFrame) -> DataFrame:
    """Fork names and time, monthly series, later commits, issue state and stars.

    Commits count from the moment the fork was last updated at the time of the event. Each
    distinct (fork, moment) is counted once, however many events repeat it.
    """
    forkee = F.from_json("payload", S.FORK_PAYLOAD)["forkee"]
    named = fork_events.select(
        forkee["full_name"].alias("repo_name"),
        forkee["updated_at"].alias("fork_time"),
        F.col("repo.name").alias("parent"),
    ).where(F.col("repo_name").isNotNull())
    span = F.xxhash64("repo_name", "fork_time")
    child_owner, child_name = owner_and_name(F.col("repo_name"))
    parent_owner, parent_name = owner_and_name(F.col("parent"))
    starts = named.select("repo_name", lenient_timestamp(F.col("fork_time")).alias("since"), span.alias("span")).distinct()
    since = attach(
        commits.select("repo_name", "event_ts", "event_id"), starts, "repo_name", spread=F.col("event_id")
    ).where(F.col("event_ts") >= F.col("since"))
    counted = assemble(
        starts.select("span").distinct(),
        monthly_series(since, repo="span").withColumnRenamed("repo_name", "span"),
        commits_after(since, repo="span").withColumnRenamed("repo_name", "span"),
        key="span",
    )
    rows = assemble(
        named.select(
            "repo_name",
            span.alias("span"),
            parent_name.alias("parent_name"),
            parent_owner.alias("parent_owner"),
            child_owner.alias("child_owner"),
            child_name.alias("child_name"),
            "fork_time",
        ),
        issue_state(responses),
    ).join(counted, "span", "left")
    first = ["repo_name", "parent_name", "parent_owner", "child_owner", "child_name", "fork_time", "commit_times", "commits_post"]
    rows = rows.fillna(0, subset=["commits_post"])
    return rows.select(*first, *[c for c in rows.columns if c not in (*first, "span")])
