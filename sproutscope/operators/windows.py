"""Restricting events to a window anchored at each repository's creation."""

from dataclasses import dataclass
from datetime import datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sproutscope import schemas as S
from sproutscope.functions.anchored import EARLY, AnchoredWindow, first_days, first_months, whole_days
from sproutscope.session import stage
from sproutscope.sizing import BROADCAST_ROWS, attach


def early_window(df: DataFrame, ts: str, created: str, days: int = S.EARLY_DAYS) -> DataFrame:
    return df.where(first_days(days).contains(F.col(ts), F.col(created)))


def early_window_months(
    df: DataFrame, ts: str, created: str, months: int = S.EARLY_MONTHS
) -> DataFrame:
    return df.where(first_months(months).contains(F.col(ts), F.col(created)))


def label_window(
    df: DataFrame, ts: str, created: str, lo: int = S.LABEL_FIRST_DAY, hi: int = S.LABEL_LAST_DAY
) -> DataFrame:
    return df.where(whole_days(lo, hi).contains(F.col(ts), F.col(created)))


@dataclass(frozen=True)
class Extent:
    """Counted size and anchor range of a cohort, taken in one pass."""

    rows: int
    earliest: datetime | None
    latest: datetime | None


def anchors_of(cohort: DataFrame) -> DataFrame:
    """``(repo_name, created_at)``, one row per repository: of repeated rows the latest creation."""
    return cohort.groupBy("repo_name").agg(F.max("created_at").alias("created_at"))


def extent(cohort: DataFrame) -> Extent:
    row = cohort.agg(
        F.count("*").alias("rows"),
        F.min("created_at").alias("earliest"),
        F.max("created_at").alias("latest"),
    ).first()
    return Extent(row["rows"], row["earliest"], row["latest"])


def _within_extent(events: DataFrame, size: Extent, within: AnchoredWindow) -> DataFrame:
    """Literal bounds on time and month that the scan can push down."""
    if size.earliest is None:
        return events.where(F.lit(False))
    opens = within.opens(F.lit(size.earliest))
    closes = within.closes(F.lit(size.latest))
    bounded = events.where(F.col("event_ts").between(opens, closes))
    if "ym" in events.columns:
        bounded = bounded.where(
            F.col("ym").between(F.date_format(opens, "yyyyMM"), F.date_format(closes, "yyyyMM"))
        )
    return bounded


def events_in_window(
    events: DataFrame,
    cohort: DataFrame,
    within: AnchoredWindow = EARLY,
    max_broadcast_rows: int = BROADCAST_ROWS,
    size: Extent | None = None,
    anchors: DataFrame | None = None,
) -> DataFrame:
    """Events of cohort repositories inside their own window, with ``created_at`` attached.

    Repeated cohort rows count once. The cohort's counted size decides between a broadcast
    and a skew-safe shuffle join; its anchor range becomes literal scan predicates. ``anchors``
    (:func:`anchors_of` the cohort) and ``size`` (their :func:`extent`) are taken from a caller that
    has them; anchors made here are written once and read for both.
    """
    anchors = stage(anchors_of(cohort), "anchors") if anchors is None else anchors
    size = size or extent(anchors)
    joined = attach(
        _within_extent(events, size, within),
        anchors,
        "repo_name",
        spread=F.col("event_id"),
        rows=size.rows,
        max_rows=max_broadcast_rows,
    )
    return joined.where(within.contains(F.col("event_ts"), F.col("created_at")))


def tracked(events: DataFrame, cohort: DataFrame) -> DataFrame:
    """Events of cohort repositories, at any time, each once however often the cohort names it."""
    return attach(events, cohort.select("repo_name").distinct(), "repo_name", spread=F.col("event_id"))
