"""The study end to end: cohorts, early metrics, dataset, labels."""

from pyspark.sql import DataFrame, SparkSession

from sproutscope import schemas as S
from sproutscope.functions.anchored import EARLY, AnchoredWindow
from sproutscope.operators.activity import activity_counts
from sproutscope.operators.cohort import (
    creation_records, dedup_first, drop_unusable, fork_records, in_months, latest_per_repo, of_type,
    split_intentional,
)
from sproutscope.operators.contributors import contributor_health, contributor_month_counts
from sproutscope.operators.features import assemble, dataset
from sproutscope.operators.labels import attach_labels, labels
from sproutscope.operators.responsiveness import fractional_delays
from sproutscope.operators.windows import events_in_window
from sproutscope.session import stage
from sproutscope.sources.events import flatten_events, land_events, read_archive

EARLY_EVENT_COLUMNS = [
    "repo_name", "type", "actor_login", "event_ts", "event_id", "action", "number", "opened_at", "merged",
]


def fork_cohort(events: DataFrame, dedup: bool = True) -> tuple[DataFrame, DataFrame]:
    """``(kept, excluded)`` repositories out of raw fork events."""
    usable = drop_unusable(fork_records(of_type(events, S.FORK)), "repo_name", "is_archived")
    return split_intentional(latest_per_repo(usable) if dedup else usable)


def creation_cohort(events: DataFrame, months=S.COHORT_MONTHS) -> DataFrame:
    """Repositories out of raw creation events, the first event of each."""
    rows = in_months(drop_unusable(creation_records(events), "repo_name"), "created_at", months)
    return dedup_first(rows, "repo_name", ["event_created_at", "event_id"])


def land_archive(spark: SparkSession, root: str, start: str, end: str, table: str) -> None:
    """Hourly files of a range of days into the event table; days landed before are replaced."""
    land_events(flatten_events(read_archive(spark, root, start, end)), table)


def build_dataset(
    events: DataFrame, cohort: DataFrame, *metadata: DataFrame, within: AnchoredWindow = EARLY
) -> DataFrame:
    """Cohort, activity, responsiveness, contributor health and any metadata in one table.

    The events of the window are a small part of the archive and feed three aggregations,
    so they are staged once and this table reads the archive a single time. Labels and
    divergence look at other windows and read their own months of it.
    """
    early = stage(
        events_in_window(events, cohort, within).select(*EARLY_EVENT_COLUMNS), "early-events"
    )
    counts = assemble(
        cohort.select("repo_name").distinct(), activity_counts(early), zeros=S.ACTIVITY_COLUMNS
    )
    health = contributor_health(contributor_month_counts(early))
    return dataset(cohort, counts, fractional_delays(early), *metadata, health)


def label_dataset(built: DataFrame, events: DataFrame, cohort: DataFrame) -> DataFrame:
    """Adds ``is_sustainable``; the result is a new table, the input is not rewritten."""
    return attach_labels(built, labels(events, cohort))


def labelled_dataset(
    events: DataFrame, cohort: DataFrame, *metadata: DataFrame, within: AnchoredWindow = EARLY
) -> DataFrame:
    """Dataset and label. Both windows prune to their own months of the event table."""
    return label_dataset(build_dataset(events, cohort, *metadata, within=within), events, cohort)


def headline(spark: SparkSession, events_table: str, cohort_table: str) -> DataFrame:
    """The labelled dataset from landed tables."""
    events = spark.read.schema(S.FLAT_EVENT).parquet(events_table)
    return labelled_dataset(events, spark.read.parquet(cohort_table))
