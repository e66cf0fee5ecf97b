"""Table sources and sinks: commit-series documents, CSV stages, SQL text, appends."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from sproutscope import schemas as S

__all__ = [
    "read_commit_series", "union_shards", "read_table_csv", "run_query",
    "write_table", "append_table", "write_jsonl",
]

# Fixed value: shards of the commit series end in a number.
SHARD_NUMBER = r"(\d+)\.json$"


def read_commit_series(spark: SparkSession, glob, one_per_line: bool = False) -> DataFrame:
    """Commit-series documents: each file one JSON array, or one document per line.

    A file holding an array is read by one task; the line form splits.
    """
    multi_line = "false" if one_per_line else "true"
    return spark.read.schema(S.COMMIT_SERIES).option("multiLine", multi_line).json(glob)


def union_shards(spark: SparkSession, glob, schema: StructType = S.COMMIT_SERIES) -> DataFrame:
    """All shards with their number in ``shard``; sort by it where an order is wanted."""
    number = F.regexp_extract(F.col("_metadata.file_name"), SHARD_NUMBER, 1)
    return (
        spark.read.schema(schema)
        .option("multiLine", "true")
        .json(glob)
        .withColumn("shard", number.try_cast("int"))
    )


def read_table_csv(spark: SparkSession, path, schema: StructType) -> DataFrame:
    """A stage table kept as CSV with a header; columns are matched to the given schema."""
    return spark.read.schema(schema).option("header", "true").csv(path)


def run_query(spark: SparkSession, sql: str, **tables: DataFrame) -> DataFrame:
    """SQL text over the session catalog; ``{name}`` in the text stands for a given table."""
    return spark.sql(sql, **tables) if tables else spark.sql(sql)


def write_table(df: DataFrame, path: str, fmt: str = "parquet") -> None:
    """Replace the table at ``path``. The path must not be one ``df`` reads."""
    df.write.mode("overwrite").options(**_options(fmt)).format(fmt).save(path)


def append_table(df: DataFrame, path: str, fmt: str = "parquet") -> None:
    """Add rows to the table at ``path``, creating it when absent."""
    df.write.mode("append").options(**_options(fmt)).format(fmt).save(path)


def write_jsonl(df: DataFrame, path: str) -> None:
    """Replace ``path`` by one JSON object per line, nulls included."""
    df.write.mode("overwrite").option("ignoreNullFields", "false").json(path)


def _options(fmt: str) -> dict[str, str]:
    return {"header": "true"} if fmt == "csv" else {}
