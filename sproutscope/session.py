"""Session settings and the shared folder used for staged tables."""

import tempfile
import uuid
from concurrent.futures import ThreadPoolExecutor

from pyspark import cloudpickle, inheritable_thread_target
from pyspark.sql import DataFrame, SparkSession

import sproutscope

# the few Python helpers travel with the job, so workers need no copy of the package
cloudpickle.register_pickle_by_value(sproutscope)


def tune(spark: SparkSession) -> SparkSession:
    """Settings every job relies on: UTC clock, adaptive plans, skew-aware joins.

    The number of shuffle partitions is the session's own.
    """
    for key, value in {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
    }.items():
        spark.conf.set(key, value)
    return spark


def shared_folder(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``, also set as the context's checkpoint folder.

    A session in one local process may leave it unset and gets a temporary one. A cluster may
    not, as its executors would each write to a disk of their own.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        folder = tempfile.mkdtemp(prefix="sproutscope-")
        spark.conf.set("spark.checkpoint.dir", folder)
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(folder)
    return folder.rstrip("/")


def new_path(spark: SparkSession, label: str) -> str:
    return f"{shared_folder(spark)}/{label}-{uuid.uuid4().hex}"


def stage(df: DataFrame, label: str = "stage") -> DataFrame:
    """Write ``df`` to the shared folder and read it back.

    The result is read by several consumers without recomputing ``df``, keeps column
    pruning, and survives the loss of executors.
    """
    path = new_path(df.sparkSession, label)
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def concurrently(spark, function, items) -> list:
    """``function`` of each item, from threads that submit their jobs side by side."""
    with ThreadPoolExecutor(max_workers=8) as pool:
        return list(pool.map(inheritable_thread_target(spark)(function), items))
