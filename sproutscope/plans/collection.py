"""Governance out of landed API responses, a run at a time, each repository once.

Responses land in files as a crawler gets them, so runs see more of them each time and may break
off. A run parses only repositories that its table hasn't, and appends them. What is missing is
read from the table itself: a run that broke off while it committed leaves some of its rows, and
the next one appends the others.
"""

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sproutscope.operators.cohort import pending
from sproutscope.operators.governance import governance_and_parent
from sproutscope.session import stage
from sproutscope.sources.tables import append_table

RESPONSE = "repo_name string, response string"


def read_responses(spark: SparkSession, folder) -> DataFrame:
    """Landed responses, JSON lines of (repo_name, response), with the name of their file."""
    return spark.read.schema(RESPONSE).json(folder).withColumn("file", F.col("_metadata.file_name"))


def collected(spark: SparkSession, table: str) -> DataFrame | None:
    """All rows so far, one per repository with a response; None before the first run."""
    try:
        return spark.read.parquet(table)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return None


def collect(spark: SparkSession, responses: DataFrame, cohort: DataFrame, table: str) -> DataFrame:
    """Parse the responses of cohort repositories that ``table`` hasn't yet and append them.

    Of several responses to a repository the one in the first file by name counts. A response that
    is no answer takes a row with ``answered`` false, so that it isn't parsed again. Returns
    the table after the run.
    """
    work, done = cohort.select("repo_name").where("repo_name IS NOT NULL").distinct(), collected(spark, table)
    left = work if done is None else pending(work, done)
    wanted = responses.join(left, "repo_name", "left_semi")
    # of equal files the least response, so that reruns agree
    first = wanted.groupBy("repo_name").agg(F.min(F.struct("file", "response")).alias("first"))
    chosen = stage(first.select("repo_name", "first.file", "first.response"), "responses")
    parsed = governance_and_parent(chosen).withColumn("answered", F.lit(True))
    rows = chosen.select("repo_name", "file").join(parsed, "repo_name", "left").fillna(False, subset=["answered"])
    append_table(stage(rows, "collected"), table)
    return spark.read.schema(rows.schema).parquet(table)


def answered(rows: DataFrame) -> DataFrame:
    """Governance and parent columns of the repositories that gave an answer."""
    return rows.where("answered").drop("answered", "file")
