"""Incremental runs over an archive folder: each file once, restartable, exactly once.

Progress lives in the stream's checkpoint. Sinks are append-only tables keyed by batch id:
a batch that is run again replaces its own rows, so a restart neither loses nor repeats
counts. ``trigger(availableNow=True)`` drains the folder and stops.
"""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from sproutscope import schemas as S
from sproutscope.functions.anchored import EARLY, LABEL, AnchoredWindow
from sproutscope.operators.activity import activity_measures
from sproutscope.operators.features import assemble
from sproutscope.operators.windows import Extent, anchors_of, events_in_window, extent
from sproutscope.session import stage
from sproutscope.sources.events import flatten_events, split_corrupt, stream_events

__all__ = [
    "stream_archive", "stream_activity", "read_activity", "stream_labels", "read_labels",
    "stream_contributor_months", "read_contributor_months", "drain",
]

_ADDITIVE = [c for c in S.ACTIVITY_COLUMNS if c != "unique_commit_authors"]


def stream_archive(spark: SparkSession, folder: str, files_per_batch: int = 24) -> DataFrame:
    """Flat events of the files that appear in ``folder``; malformed lines are passed over."""
    good, _bad = split_corrupt(stream_events(spark, folder, files_per_batch))
    return flatten_events(good)


def drain(query: StreamingQuery) -> None:
    """Wait for an ``availableNow`` run to finish; errors are raised here."""
    query.awaitTermination()


def _per_batch(stream: DataFrame, table: str, checkpoint: str, shape) -> StreamingQuery:
    """Write ``shape(batch, batch_id)`` of every micro-batch under its own ``batch_id``."""

    def write(batch: DataFrame, batch_id: int) -> None:
        shape(batch, batch_id).write.mode("overwrite").parquet(f"{table}/batch_id={batch_id}")

    return (
        stream.writeStream.outputMode("update")
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .foreachBatch(write)
        .start()
    )


def _prepared(cohort: DataFrame) -> tuple[DataFrame, Extent]:
    """Anchors, written once for all batches, and their extent."""
    anchors = stage(anchors_of(cohort), "anchors")
    return anchors, extent(anchors)


def stream_activity(
    events: DataFrame, cohort: DataFrame, table: str, checkpoint: str, within: AnchoredWindow = EARLY
) -> StreamingQuery:
    """Additive activity partials per (repository, author) and batch.

    Keeping the author in the key makes distinct authors exact across batches without any
    streaming state.
    """
    anchors, size = _prepared(cohort)

    def partials(batch: DataFrame, batch_id: int) -> DataFrame:
        return (
            events_in_window(batch, cohort, within, size=size, anchors=anchors)
            .groupBy("repo_name", "actor_login")
            .agg(*activity_measures())
        )

    return _per_batch(events, table, checkpoint, partials)


def read_activity(table: DataFrame, cohort: DataFrame) -> DataFrame:
    """The activity vector out of the partials written so far, zero rows included."""
    per_author = table.groupBy("repo_name", "actor_login").agg(
        *[F.sum(c).alias(c) for c in _ADDITIVE]
    )
    counts = per_author.groupBy("repo_name").agg(
        *[F.sum(c).alias(c) for c in _ADDITIVE],
        F.count_if(F.col("total_commits") > 0).alias("unique_commit_authors"),
    )
    return assemble(
        cohort.select("repo_name"),
        counts.select("repo_name", *S.ACTIVITY_COLUMNS),
        zeros=S.ACTIVITY_COLUMNS,
    )


def stream_labels(
    events: DataFrame, cohort: DataFrame, table: str, checkpoint: str, within: AnchoredWindow = LABEL
) -> StreamingQuery:
    """Repositories with a push in the label window, each in the batch of its first one.

    Repositories that earlier batches found are taken out before the window join, and once
    none is left a batch joins nothing.
    """
    anchors, size = _prepared(cohort)

    def hits(batch: DataFrame, batch_id: int) -> DataFrame:
        left = open_anchors(batch.sparkSession, table, anchors, batch_id)
        pushes = batch.where(F.col("type") == S.PUSH)
        return events_in_window(pushes, cohort, within, size=extent(left), anchors=left).select("repo_name").distinct()

    return _per_batch(events, table, checkpoint, hits)


def open_anchors(spark: SparkSession, table: str, anchors: DataFrame, batch_id: int) -> DataFrame:
    """Anchors of repositories that no batch before ``batch_id`` has found."""
    if not batch_id:
        return anchors
    found = spark.read.schema("repo_name string, batch_id long").parquet(table).where(F.col("batch_id") < batch_id)
    return stage(anchors.join(found, "repo_name", "left_anti"), "open-anchors")


def read_labels(hits: DataFrame, cohort: DataFrame) -> DataFrame:
    found = hits.select("repo_name").distinct().withColumn("is_sustainable", F.lit(1))
    return cohort.select("repo_name").join(found, "repo_name", "left").fillna(
        0, subset=["is_sustainable"]
    )


def stream_contributor_months(
    events: DataFrame, cohort: DataFrame, table: str, checkpoint: str, within: AnchoredWindow = EARLY
) -> StreamingQuery:
    """Pushes per (repository, month, contributor) and batch.

    Partials of all batches add up, so files may come in any order and however late.
    """
    anchors, size = _prepared(cohort)

    def partials(batch: DataFrame, batch_id: int) -> DataFrame:
        pushes = batch.where(F.col("type") == S.PUSH)
        return events_in_window(pushes, cohort, within, size=size, anchors=anchors).groupBy(
            "repo_name", F.date_format("event_ts", "yyyy-MM").alias("month"), F.col("actor_login").alias("contributor")
        ).agg(F.count("*").alias("commit_count"))

    return _per_batch(events, table, checkpoint, partials)


def read_contributor_months(table: DataFrame) -> DataFrame:
    """The contributor-month series out of the partials written so far."""
    return table.groupBy("repo_name", "month", "contributor").agg(F.sum("commit_count").alias("commit_count"))
