"""Counting events inside keyed time spans without pairing events with spans."""

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sproutscope.sizing import attach


def counts_in_spans(events: DataFrame, spans: DataFrame) -> DataFrame:
    """Events of a repository from ``opens`` to ``closes``, both included, for every span.

    ``spans`` is ``(repo_name, opens, closes)``; returns its distinct rows with ``events``.

    Events and span ends are folded to one row per (repository, instant). Running counts
    inside a day plus the totals of the days before give the events up to any instant, and
    a span is the difference of two readings. A day of whole seconds has at most 86,400
    instants and a repository one row per day, so no window grows with a hot repository,
    and many spans over one repository cost their ends only.
    """
    spans = spans.select("repo_name", "opens", "closes").distinct()
    bounds = spans.agg(F.min("opens").alias("first"), F.max("closes").alias("last")).first()
    in_range = events.select("repo_name", F.col("event_ts").alias("at"), "event_id").where(
        F.col("at").between(F.lit(bounds["first"]), F.lit(bounds["last"]))
    )
    relevant = attach(
        in_range, spans.select("repo_name").distinct(), "repo_name", spread=F.col("event_id")
    )
    occurrences = relevant.groupBy("repo_name", "at").agg(F.count("*").alias("n"))
    ends = spans.select("repo_name", F.explode(F.array("opens", "closes")).alias("at"))
    instants = (
        occurrences.select("repo_name", "at", "n", F.lit(False).alias("is_end"))
        .unionByName(
            ends.select("repo_name", "at", F.lit(0).cast("long").alias("n"), F.lit(True).alias("is_end"))
        )
        .groupBy("repo_name", "at")
        .agg(F.sum("n").alias("n"), F.bool_or("is_end").alias("is_end"))
        .withColumn("day", F.to_date("at"))
    )
    in_day = Window.partitionBy("repo_name", "day").orderBy("at")
    earlier_days = (
        Window.partitionBy("repo_name").orderBy("day").rowsBetween(Window.unboundedPreceding, -1)
    )
    days = (
        instants.groupBy("repo_name", "day")
        .agg(F.sum("n").alias("in_day"))
        .select("repo_name", "day", F.coalesce(F.sum("in_day").over(earlier_days), F.lit(0)).alias("before"))
    )
    readings = (
        instants.withColumn("so_far", F.sum("n").over(in_day))
        .where("is_end")
        .join(days, ["repo_name", "day"])
        .select("repo_name", "at", (F.col("before") + F.col("so_far")).alias("upto"), "n")
    )
    at_open = readings.select(
        "repo_name", F.col("at").alias("opens"), (F.col("upto") - F.col("n")).alias("below")
    )
    at_close = readings.select("repo_name", F.col("at").alias("closes"), "upto")
    return (
        spans.join(at_open, ["repo_name", "opens"])
        .join(at_close, ["repo_name", "closes"])
        .select("repo_name", "opens", "closes", (F.col("upto") - F.col("below")).alias("events"))
    )
