"""Event sources: NDJSON feeds, hourly archive folders and the month-partitioned table."""

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from sproutscope import schemas as S
from sproutscope.functions.scalars import strict_timestamp

__all__ = [
    "read_events", "parse_event_lines", "split_corrupt", "observed", "read_feed", "read_archive", "in_file_dates", "stream_events",
    "flatten_events", "land_events", "scan_months",
]

# Fixed value: hourly archive files are named ``YYYY-MM-DD-H.json.gz``.
ARCHIVE_FILE_NAME = r"^(\d{4}-\d{2}-\d{2})-\d{1,2}\.json"


def read_events(spark: SparkSession, path) -> DataFrame:
    """Newline-delimited JSON events; a malformed line keeps only its text in ``_corrupt``.

    For looking at malformed lines themselves; :func:`read_feed` only counts them and is faster.
    """
    return parse_event_lines(_lines(spark.read, path))


def _lines(reader, path) -> DataFrame:
    """Text lines of a batch or stream reader.

    Lines are parsed by an expression rather than by the JSON source because that source
    refuses queries that look at malformed lines alone.
    """
    return reader.option("ignoreMissingFiles", "true").text(path)


def read_feed(spark: SparkSession, path, name: str = "feed") -> tuple[DataFrame, Observation]:
    """:func:`observed` events of NDJSON files, each line parsed once by the JSON source."""
    return observed(_parsed(spark.read, path), name)


def parse_event_lines(lines: DataFrame, text: str = "value") -> DataFrame:
    """Events out of a string column of JSON texts; blank ones are skipped."""
    options = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": S.CORRUPT}
    return (
        lines.where(F.trim(F.col(text)) != "")
        .select(F.from_json(F.col(text), S.RAW_EVENT, options).alias("_event"))
        .select("_event.*")
    )


def split_corrupt(raw: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``(good events, malformed lines)``."""
    good = raw.where(F.col(S.CORRUPT).isNull()).drop(S.CORRUPT)
    bad = raw.where(F.col(S.CORRUPT).isNotNull()).select("id", S.CORRUPT)
    return good, bad


def observed(raw: DataFrame, name: str = "feed") -> tuple[DataFrame, Observation]:
    """``(good events, counts)``; ``counts.get`` has ``good`` and ``malformed`` lines once the events were read."""
    counts = Observation(name)
    malformed = F.col(S.CORRUPT).isNotNull()
    seen = raw.observe(counts, F.count_if(~malformed).alias("good"), F.count_if(malformed).alias("malformed"))
    return seen.where(~malformed).drop(S.CORRUPT), counts


def in_file_dates(df: DataFrame, file_name, start: str, end: str) -> DataFrame:
    """Rows of files dated ``start``..``end`` (days, both included)."""
    day = F.try_to_date(F.regexp_extract(file_name, ARCHIVE_FILE_NAME, 1), "yyyy-MM-dd")
    return df.where(day.between(F.to_date(F.lit(start)), F.to_date(F.lit(end))))


def _parsed(reader, path) -> DataFrame:
    """Events by the JSON source, which parses each line once for all filters and columns."""
    return (
        reader.schema(S.RAW_EVENT)
        .option("mode", "PERMISSIVE")
        .option("columnNameOfCorruptRecord", S.CORRUPT)
        .option("ignoreMissingFiles", "true")
        .json(path)
    )


def read_archive(spark: SparkSession, root: str, start: str, end: str) -> DataFrame:
    """Hourly files of a date range; absent hours and malformed lines are passed over.

    The date predicate uses file metadata only, so files outside the range are not opened.
    ``file_day`` is the day in a file's name.
    """
    name = F.col("_metadata.file_name")
    found = in_file_dates(_parsed(spark.read, root), name, start, end)
    good, _bad = split_corrupt(found.withColumn("file_day", F.regexp_extract(name, ARCHIVE_FILE_NAME, 1)))
    return good


def stream_events(spark: SparkSession, folder: str, files_per_batch: int) -> DataFrame:
    """The rows of :func:`read_events` as files appear in ``folder``."""
    return _parsed(spark.readStream.option("maxFilesPerTrigger", files_per_batch), folder)


def flatten_events(raw: DataFrame) -> DataFrame:
    """Raw archive events to :data:`schemas.FLAT_EVENT`, parsing each payload once.

    Events without a repository or with an unreadable time are dropped; a missing actor
    becomes the empty login. A ``file_day`` passes through.
    """
    kept = [c for c in raw.columns if c == "file_day"]
    about_issue = F.col("type").isin(S.ISSUE, S.ISSUE_COMMENT)
    body = raw.select(
        F.col("id").alias("event_id"),
        "type",
        F.col("repo.name").alias("repo_name"),
        F.coalesce(F.col("actor.login"), F.lit("")).alias("actor_login"),
        strict_timestamp(F.col("created_at")).alias("event_ts"),
        F.from_json("payload", S.ARCHIVE_PAYLOAD).alias("p"),
        *kept,
    ).where(F.col("repo_name").isNotNull() & F.col("event_ts").isNotNull())
    subject = lambda field: F.when(about_issue, F.col(f"p.issue.{field}")).otherwise(
        F.col(f"p.pull_request.{field}")
    )
    return body.select(
        "event_id",
        "type",
        "repo_name",
        "actor_login",
        "event_ts",
        F.date_format("event_ts", "yyyyMM").alias("ym"),
        F.col("p.action").alias("action"),
        subject("number").cast("string").alias("number"),
        strict_timestamp(subject("created_at")).alias("opened_at"),
        F.col("p.pull_request.merged").alias("merged"),
        F.transform("p.commits", lambda c: c["author"]["email"]).alias("commit_emails"),
        *kept,
    )


#: Parts of a month by repository, and of a repository by event.
REPO_BUCKETS, EVENT_BUCKETS = 16, 4
#: The same of one landed day, so that a day is at most eight files.
DAY_REPO_BUCKETS, DAY_EVENT_BUCKETS = 4, 2


def land_events(flat: DataFrame, path: str) -> None:
    """Write flat events to a table partitioned by month and sorted by repository inside its files.

    With ``file_day`` the table is partitioned by it too, and days that are landed again replace
    what was there, so a run that was broken off can be repeated. Without it rows are appended.
    Events are dealt by hash in one pass, a repository too large for one task over several; the
    number of files per folder has a bound, however many tasks read the archive.
    """
    keys = [c for c in ("ym", "file_day") if c in flat.columns]
    bucket = lambda c, n: F.pmod(F.xxhash64(c), F.lit(n))
    repos, events = (DAY_REPO_BUCKETS, DAY_EVENT_BUCKETS) if "file_day" in keys else (REPO_BUCKETS, EVENT_BUCKETS)
    dealt = flat.repartition(*keys, bucket("repo_name", repos), bucket("event_id", events))
    writer = dealt.sortWithinPartitions(*keys, "repo_name").write.partitionBy(*keys)
    if "file_day" in keys:
        writer.mode("overwrite").option("partitionOverwriteMode", "dynamic").parquet(path)
    else:
        writer.mode("append").parquet(path)


def scan_months(
    df: DataFrame,
    first_ym: str,
    last_ym: str,
    types: list[str] | None = None,
    cols: list[str] | None = None,
) -> DataFrame:
    """Events of the months ``first_ym``..``last_ym`` (``yyyyMM``), optionally of some types."""
    picked = df.where(F.col("ym").between(first_ym, last_ym))
    if types:
        picked = picked.where(F.col("type").isin(*types))
    return picked.select(*cols) if cols else picked
