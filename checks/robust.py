"""Repeated rows, large lookups, many categories, and files under the names that the readers expect."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from checks.activity import ACTIVITY_SQL
from checks.adapters import rounded, with_archive, with_commits
from checks.cohorts import GOVERNANCE_SQL, PARENT_SQL, _responses
from checks.labels import DATASET_SQL
from checks.registry import check
from sproutscope import schemas as S
from sproutscope.operators import activity as act
from sproutscope.operators import governance as gov
from sproutscope.operators import prep, series
from sproutscope.operators import training as tr
from sproutscope.operators import windows as win
from sproutscope.operators.features import assemble
from sproutscope.plans import study
from sproutscope.session import new_path
from sproutscope.sources import events as src
from sproutscope.sources import tables as tab


def rename_parts(spark, folder: str, name) -> None:
    """Gives the only file of each ``key=value`` folder the name ``name(value)`` beside them."""
    path = spark._jvm.org.apache.hadoop.fs.Path
    root = path(folder)
    fs = root.getFileSystem(spark._jsc.hadoopConfiguration())
    for part in fs.listStatus(root):
        if part.isDirectory():
            value = part.getPath().getName().partition("=")[2]
            for file in fs.listStatus(part.getPath()):
                if file.getPath().getName().startswith("part-"):
                    fs.rename(file.getPath(), path(root, name(value)))
            fs.delete(part.getPath(), True)


def one_file_each(df: DataFrame, key: str, folder: str, name, compression: str = "none") -> None:
    """Text lines ``value`` into one file per value of ``key``."""
    df.repartition(key).write.partitionBy(key).option("compression", compression).text(folder)
    rename_parts(df.sparkSession, folder, name)


@check(
    "src2_hourly_files",
    with_archive("""
SELECT type, count(*) AS events, count(DISTINCT repo_name) AS repos FROM archive
WHERE strftime(event_ts, '%Y-%m') BETWEEN '1996-03' AND '1996-05' GROUP BY 1
"""),
)
def _(t):
    """Gzip files named by date, one per month under the hour 0 of its first day, read by file date."""
    folder = new_path(t.spark, "hourly")
    created = F.date_format("event_ts", "yyyy-MM-dd'T'HH:mm:ss'Z'")
    event = F.struct(F.col("event_id").alias("id"), "type", created.alias("created_at"), F.struct(F.col("repo_name").alias("name")).alias("repo"))
    lines = t.archive.select(F.date_format("event_ts", "yyyy-MM").alias("month"), F.to_json(event).alias("value"))
    one_file_each(lines, "month", folder, lambda month: f"{month}-01-0.json.gz", "gzip")
    read = src.flatten_events(src.read_archive(t.spark, folder, "1996-03-01", "1996-05-31"))
    return read.groupBy("type").agg(F.count("*").alias("events"), F.count_distinct("repo_name").alias("repos"))


SERIES_SQL = """
SELECT substr(repo_name, 3) AS "childName", {shard} count(*) AS commits FROM commits GROUP BY repo_name
"""


def _documents(t) -> DataFrame:
    """A commit-series document per repository with its shard."""
    name = F.substring("repo_name", 3, 20)
    monthly = series.monthly_series(t.commits)
    document = F.struct(name.alias("childName"), F.col("commit_times").alias("commitTimes"))
    return monthly.select((F.crc32(name) % 5).alias("shard"), F.to_json(document).alias("value"))


def _shards(t) -> str:
    """Five numbered files, each an array of documents."""
    folder = new_path(t.spark, "shards")
    arrays = _documents(t).groupBy("shard").agg(F.concat(F.lit("["), F.concat_ws(",\n", F.collect_list("value")), F.lit("]")).alias("value"))
    one_file_each(arrays, "shard", folder, lambda shard: f"series{shard}.json")
    return folder


def _commits():
    return F.aggregate(F.map_values("commitTimes"), F.lit(0).cast("long"), lambda a, x: a + x).alias("commits")


@check("src4_array_documents", with_commits(SERIES_SQL.format(shard="")))
def _(t):
    """Commit series as files of one JSON array each."""
    return tab.read_commit_series(t.spark, f"{_shards(t)}/series*.json").select("childName", _commits())


@check("uni1_numbered_shards", with_commits("SELECT shards, documents, commits FROM (SELECT 5 AS shards, count(DISTINCT repo_name) AS documents, count(*) AS commits FROM commits)"))
def _(t):
    """All numbered shards together; the number of each is its file's."""
    read = tab.union_shards(t.spark, f"{_shards(t)}/series*.json").select("shard", "childName", _commits())
    return read.agg(F.count_distinct("shard").cast("int").alias("shards"), F.count_distinct("childName").alias("documents"), F.sum("commits").alias("commits"))


@check("agg1_repeated_cohort", with_archive(ACTIVITY_SQL))
def _(t):
    """Every repository twice in the cohort: counts are those of one."""
    return act.activity(t.archive, t.cohort.unionAll(t.cohort)).distinct()


@check(
    "jon2_repeated_cohort",
    with_archive("SELECT type, count(*) AS events FROM archive WHERE repo_name IN (SELECT repo_name FROM cohort WHERE is_fork) GROUP BY 1"),
)
def _(t):
    forks = t.cohort.where("is_fork")
    return win.tracked(t.archive, forks.unionAll(forks)).groupBy("type").agg(F.count("*").alias("events"))


@check("agg1_large_cohort", with_archive(ACTIVITY_SQL))
def _(t):
    """The vector by the shuffled join, as for a cohort too large to broadcast."""
    counts = act.activity_counts(win.events_in_window(t.archive, t.cohort, max_broadcast_rows=0))
    return assemble(t.cohort.select("repo_name"), counts, zeros=S.ACTIVITY_COLUMNS)


@check(
    "pre4_many_categories",
    """SELECT o_orderkey, CAST(dense_rank() OVER (ORDER BY CAST(o_orderkey AS VARCHAR)) - 1 AS INTEGER) AS key_code,
         CAST(dense_rank() OVER (ORDER BY o_orderpriority) - 1 AS INTEGER) AS priority FROM orders""",
)
def _(t):
    """As many categories as rows."""
    rows = t.table("orders").select("o_orderkey", F.col("o_orderkey").cast("string").alias("key_code"), F.col("o_orderpriority").alias("priority"))
    return prep.label_encode(rows, ["key_code", "priority"])


@check(
    "pre5_one_hot_vectors",
    """SELECT o_orderkey, CASE WHEN rank = 0 THEN 0 ELSE 1 END AS ones, CASE WHEN rank > 0 THEN most - rank END AS place FROM (
         SELECT o_orderkey, rank, max(rank) OVER () AS most FROM (
           SELECT o_orderkey, dense_rank() OVER (ORDER BY o_clerk) - 1 AS rank FROM (SELECT o_orderkey, 'k' || o_custkey AS o_clerk FROM orders)))""",
)
def _(t):
    """Sparse vectors over one category per customer."""
    rows = t.table("orders").select("o_orderkey", F.concat(F.lit("k"), F.col("o_custkey")).alias("clerk"))
    place = F.udf(lambda v: (len(v.indices), int(v.indices[0]) if len(v.indices) else None), "ones int, place long")
    return prep.one_hot_vectors(rows, ["clerk"]).select("o_orderkey", place("clerk").alias("v")).select("o_orderkey", "v.*")


@check(
    "ml12_saved_model",
    """SELECT count(*) AS rows, true AS same FROM customer""",
)
def _(t):
    """A model saved and loaded scores every row as before."""
    from pyspark.ml.classification import GBTClassificationModel

    names = ["c_acctbal", "c_nationkey"]
    rows = t.table("customer").select("c_custkey", F.col("c_acctbal").cast("double").alias("c_acctbal"), F.col("c_nationkey").cast("double").alias("c_nationkey"), (F.col("c_mktsegment") == "BUILDING").cast("int").alias("label"))
    model = tr.train(rows, names, rounds=3, depth=2)
    path = new_path(t.spark, "model")
    tr.save_model(model, path)
    again = GBTClassificationModel.load(path)
    both = tr.score(model, rows, names).select("c_custkey", F.col("score").alias("a")).join(tr.score(again, rows, names).select("c_custkey", F.col("score").alias("b")), "c_custkey")
    return both.agg(F.count("*").alias("rows"), F.every(F.col("a") == F.col("b")).alias("same"))


@check(
    "jon6_full_dataset",
    with_archive(f"""
SELECT data.*, has_contributing, has_code_of_conduct, has_license, has_cicd, primary_language, topics,
  parent_repo, parent_stars, parent_forks, parent_created_at, parent_language
FROM ({DATASET_SQL}) data LEFT JOIN ({GOVERNANCE_SQL}) g ON g.repo_name = data.repo_name
LEFT JOIN ({PARENT_SQL}) p ON p.repo_name = data.repo_name
"""),
)
def _(t):
    """All columns of the study with the label, metadata out of landed responses."""
    pushes = t.archive.where(F.col("type") == S.PUSH)
    built = study.labelled_dataset(t.archive, t.cohort, gov.divergence(pushes, t.cohort), gov.governance_and_parent(_responses(t)))
    return rounded(built)
