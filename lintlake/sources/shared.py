"""Tables written to the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir.

    Unset on a local master (a single machine, tests): a new local folder, kept for the session. Unset
    on a cluster: an error, since executors would each write to a disk of their own.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root and spark.sparkContext.master.startswith("local"):
        root = spark.conf.get("lintlake.scratch.dir", None)
        if not root:
            root = "file://" + tempfile.mkdtemp(prefix="spark-")
            spark.conf.set("lintlake.scratch.dir", root)
    if not root:
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    return root.rstrip("/")


def _own(spark: SparkSession) -> str:
    return f"{shared_dir(spark)}/{spark.sparkContext.applicationId}"


def _delete(spark: SparkSession, path: str) -> None:
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def written(df: DataFrame) -> DataFrame:
    """``df`` written once and read again: its lineage ends, and lost executors take nothing with them."""
    path = f"{_own(df.sparkSession)}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._written_path = path
    return out


def forget(*frames: DataFrame) -> None:
    """Deletes tables of written() that nothing reads any more."""
    for df in frames:
        path = getattr(df, "_written_path", None)
        if path:
            _delete(df.sparkSession, path)


def clean(spark: SparkSession) -> None:
    """Deletes all tables that this application wrote, once their results are stored elsewhere."""
    _delete(spark, _own(spark))
