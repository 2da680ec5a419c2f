"""Tables on storage that are changed part by part: each change rewrites the parts it touches alone.

A table is Parquet below one folder, dealt to a fixed number of parts by a hash of its keys. New contents of the parts
touched are complete in a folder beside it before anything is replaced; if a replacement dies half way, the next
reader or writer finishes it from there.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Parts of a table, at most: what the driver holds of a change is a list of so many numbers.
PARTS = 256
PART = "part"


def part_of(*keys: str, of: int = PARTS) -> Column:
    return F.pmod(F.xxhash64(*keys), F.lit(of)).cast("int")


class PartedTable:
    """A table at ``path`` with the columns of ``schema`` (DDL), which must have the int column ``part``."""

    def __init__(self, spark: SparkSession, path: str, schema: str) -> None:
        self.spark, self.path, self.schema = spark, path.rstrip("/"), schema
        self.pending = f"{self.path}.pending"

    def _exists(self, path: str) -> bool:
        where = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        return where.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(where)

    def _delete(self, path: str) -> None:
        where = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)

    def _finish(self) -> None:
        """Replaces parts by their complete new contents, if there are any left to."""
        if self._exists(f"{self.pending}/_SUCCESS"):
            new = self.spark.read.schema(self.schema).parquet(self.pending)
            new.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(PART).parquet(self.path)
            self._delete(self.pending)

    def read(self, parts: list[int] | None = None) -> DataFrame:
        """All rows, or those of some parts: other parts' files are not read."""
        self._finish()
        if not self._exists(self.path):
            return self.spark.createDataFrame([], self.schema)
        d = self.spark.read.schema(self.schema).parquet(self.path)
        return d if parts is None else d.where(F.col(PART).isin(parts))

    def replace(self, new: DataFrame) -> None:
        """``new`` holds all rows of the parts that it has rows of; other parts stay. The same call again changes nothing."""
        self._finish()
        columns = self.spark.createDataFrame([], self.schema).columns
        new.select(columns).repartition(PART).write.mode("overwrite").parquet(self.pending)
        self._finish()


def touched(rows: DataFrame) -> list[int]:
    """The parts that ``rows`` lie in, PARTS at most."""
    return sorted(r[PART] for r in rows.select(PART).distinct().collect())
