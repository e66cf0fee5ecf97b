"""The activity vector of a repository: one conditional-aggregation pass over its events."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sproutscope import schemas as S
from sproutscope.functions.anchored import EARLY, EARLY_CALENDAR, AnchoredWindow
from sproutscope.operators.features import assemble
from sproutscope.operators.windows import events_in_window


def _is(kind: str, action: str | None = None) -> Column:
    same = F.col("type") == kind
    return same if action is None else same & (F.col("action") == action)


def outcome(null_merged: str = "rejected") -> tuple[Column, Column]:
    """Predicates ``(merged, rejected)`` over closed pull requests.

    ``null_merged`` says what a closed request without a merge flag counts as:
    ``"rejected"`` or ``"neither"``.
    """
    closed = _is(S.PULL_REQUEST, "closed")
    merged = F.col("merged")
    if null_merged == "rejected":
        merged = F.coalesce(merged, F.lit(False))
    return closed & merged, closed & ~merged


def activity_measures(null_merged: str = "rejected") -> list[Column]:
    """The additive measures, i.e. all but the distinct authors."""
    merged, rejected = outcome(null_merged)
    conditions = {
        "total_commits": _is(S.PUSH),
        "issues_opened": _is(S.ISSUE, "opened"),
        "issues_closed": _is(S.ISSUE, "closed"),
        "prs_opened": _is(S.PULL_REQUEST, "opened"),
        "prs_merged": merged,
        "prs_rejected": rejected,
        "num_releases": _is(S.RELEASE, "published"),
        "star_count": _is(S.WATCH, "started"),
        "fork_count": _is(S.FORK),
        "total_issue_comments": _is(S.ISSUE_COMMENT),
        "total_pr_comments": _is(S.REVIEW_COMMENT),
    }
    return [F.count_if(condition).alias(name) for name, condition in conditions.items()]


def activity_counts(
    windowed: DataFrame, null_merged: str = "rejected", approximate_authors: float | None = None
) -> DataFrame:
    """Activity of the repositories that have events.

    Distinct authors plan as two aggregations, first by (repository, author); set
    ``approximate_authors`` to a relative error to use a sketch and one shuffle instead.
    """
    author = F.when(_is(S.PUSH), F.col("actor_login"))
    distinct = (
        F.count_distinct(author)
        if approximate_authors is None
        else F.approx_count_distinct(author, approximate_authors)
    )
    counts = windowed.groupBy("repo_name").agg(
        *activity_measures(null_merged), distinct.alias("unique_commit_authors")
    )
    return counts.select("repo_name", *S.ACTIVITY_COLUMNS)


def activity(
    events: DataFrame,
    cohort: DataFrame,
    null_merged: str = "rejected",
    within: AnchoredWindow = EARLY,
    approximate_authors: float | None = None,
) -> DataFrame:
    """Activity of every cohort repository, zero rows included."""
    counts = activity_counts(
        events_in_window(events, cohort, within), null_merged, approximate_authors
    )
    return assemble(cohort.select("repo_name"), counts, zeros=S.ACTIVITY_COLUMNS)


def commit_authors_exploded(
    events: DataFrame, cohort: DataFrame, within: AnchoredWindow = EARLY_CALENDAR
) -> DataFrame:
    """Commits listed inside pushes and their distinct author addresses, per repository."""
    pushes = events.where(_is(S.PUSH))
    commits = events_in_window(pushes, cohort, within).select(
        "repo_name", F.explode("commit_emails").alias("email")
    )
    counts = commits.groupBy("repo_name").agg(
        F.count("*").alias("total_commits"), F.count_distinct("email").alias("commit_authors")
    )
    return assemble(
        cohort.select("repo_name"), counts, zeros=["total_commits", "commit_authors"]
    )
