"""Streaming runs drained over the archive text, compared with the batch SQL."""

from checks.activity import ACTIVITY_SQL
from checks.adapters import with_archive
from checks.registry import check
from sproutscope.session import new_path
from sproutscope.streaming import archive as st

FILES, BATCHES = 6, 3


def _archive(t):
    """The events of the archive text in several files, a third of them in each batch."""
    path = t.archive_files("watched", FILES)
    files = t.spark.read.format("binaryFile").load(path).select("path").count()
    return st.stream_archive(t.spark, path, max(1, -(-files // BATCHES)))


@check("str1_str2_stream_activity", with_archive(ACTIVITY_SQL))
def _(t):
    cohort = t.cohort
    table, checkpoint = new_path(t.spark, "activity"), new_path(t.spark, "progress")
    st.drain(st.stream_activity(_archive(t), cohort, table, checkpoint))
    return st.read_activity(t.spark.read.parquet(table), cohort)


@check(
    "str3_stream_labels",
    with_archive("""
SELECT c.repo_name, CAST(max(CASE WHEN type = 'PushEvent' AND date_sub('day', created_at, event_ts) BETWEEN 548 AND 730
  THEN 1 ELSE 0 END) AS INTEGER) AS is_sustainable
FROM cohort c LEFT JOIN archive a ON a.repo_name = c.repo_name GROUP BY 1
"""),
)
def _(t):
    cohort = t.cohort
    table, checkpoint = new_path(t.spark, "labels"), new_path(t.spark, "progress")
    st.drain(st.stream_labels(_archive(t), cohort, table, checkpoint))
    return st.read_labels(t.spark.read.schema("repo_name string").parquet(table), cohort)


@check("str4_stream_contributor_months", with_archive("SELECT * FROM cm"))
def _(t):
    cohort = t.cohort
    table, checkpoint = new_path(t.spark, "months"), new_path(t.spark, "progress")
    st.drain(st.stream_contributor_months(_archive(t), cohort, table, checkpoint))
    return st.read_contributor_months(t.spark.read.parquet(table))
