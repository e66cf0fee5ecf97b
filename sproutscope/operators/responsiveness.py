"""How fast issues and pull requests get a first response."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sproutscope import schemas as S
from sproutscope.functions.anchored import EARLY, EARLY_CALENDAR, AnchoredWindow
from sproutscope.functions.scalars import whole_hours_between
from sproutscope.operators.features import assemble
from sproutscope.operators.windows import events_in_window


def _opens():
    return F.col("type").isin(S.ISSUE, S.PULL_REQUEST) & (F.col("action") == "opened")


def _responds():
    return F.col("type").isin(S.ISSUE_COMMENT, S.REVIEW_COMMENT)


def _kind():
    return F.when(F.col("type").isin(S.ISSUE, S.ISSUE_COMMENT), "issue").otherwise("pr").alias("kind")


def threads(windowed: DataFrame) -> DataFrame:
    """First opening and first response of every issue and pull request, in one aggregation."""
    relevant = windowed.where((_opens() | _responds()) & F.col("number").isNotNull())
    opening = _opens() & F.col("opened_at").isNotNull()
    return relevant.groupBy("repo_name", _kind(), "number").agg(
        F.min_by(
            F.when(opening, F.col("opened_at")),
            F.when(opening, F.struct("event_ts", "event_id")),
        ).alias("opened_at"),
        F.min(F.when(_responds(), F.col("event_ts"))).alias("responded_at"),
    )


def _by_kind(delays: DataFrame, unit_seconds: int) -> DataFrame:
    """Mean delay per repository and kind; integer sums keep the mean exact."""
    mean = lambda kind: (
        F.sum(F.when(F.col("kind") == kind, F.col("delay")))
        / (F.count(F.when(F.col("kind") == kind, F.col("delay"))) * F.lit(unit_seconds))
    )
    total = lambda kind: F.count(F.when(F.col("kind") == kind, F.col("delay")))
    issue, pr = S.RESPONSE_COLUMNS
    return delays.groupBy("repo_name").agg(
        F.when(total("issue") > 0, mean("issue")).alias(issue),
        F.when(total("pr") > 0, mean("pr")).alias(pr),
    )


def fractional_delays(windowed: DataFrame) -> DataFrame:
    """Mean fractional hours from opening to first response; negative delays are left out."""
    delay = F.unix_seconds("responded_at") - F.unix_seconds("opened_at")
    delays = threads(windowed).select("repo_name", "kind", delay.alias("delay"))
    return _by_kind(delays.where(F.col("delay") >= 0), unit_seconds=3600)


def whole_hour_delays(windowed: DataFrame) -> DataFrame:
    """Mean whole hours, the opening time taken from the response's own payload.

    Each side is averaged on its own, so no issue-by-request product ever arises.
    """
    first = (
        windowed.where(_responds())
        .groupBy("repo_name", _kind(), "number")
        .agg(F.min("opened_at").alias("opened_at"), F.min("event_ts").alias("responded_at"))
    )
    delay = whole_hours_between(F.col("opened_at"), F.col("responded_at"))
    return _by_kind(first.select("repo_name", "kind", delay.alias("delay")), unit_seconds=1)


def responsiveness(
    events: DataFrame,
    cohort: DataFrame,
    mode: str = "fractional",
    within: AnchoredWindow | None = None,
) -> DataFrame:
    """Response times of every cohort repository, null where nothing was answered.

    ``mode="fractional"`` matches openings to responses within the early window in days;
    ``mode="hours"`` reads both times off the responses within the early calendar months.
    """
    if mode == "fractional":
        measured = fractional_delays(events_in_window(events, cohort, within or EARLY))
    elif mode == "hours":
        measured = whole_hour_delays(events_in_window(events, cohort, within or EARLY_CALENDAR))
    else:
        raise ValueError(f"unknown mode: {mode}")
    return assemble(cohort.select("repo_name"), measured)
