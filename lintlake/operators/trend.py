"""Score history: validation, retention and trends by window functions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lintlake.sources.parts import PART, PartedTable, part_of, touched

#: Entries that are kept, and the window of a trend; thresholds and band limits of its chart.
KEPT, WINDOW, MOST = 500, 20, 500
STEP, GREEN, YELLOW = 10, 75, 50

ENTRY = "project string, seq long, timestamp string, score double, label string, errors double, warnings double, filesScanned double, filesAffected double"
_NUMBERS = ("score", "errors", "warnings", "filesScanned", "filesAffected")


def read_history(lines: DataFrame) -> DataFrame:
    """Valid entries of (project, seq, entry JSON text): an entry with a field of a wrong type is left out."""
    v = F.try_parse_json("entry")
    d = lines.withColumn("v", v)
    kind = lambda f: F.schema_of_variant(F.try_variant_get("v", f"$.{f}", "variant"))
    ok = (kind("timestamp") == "STRING") & (kind("label") == "STRING")
    for f in _NUMBERS:
        ok = ok & (kind(f).isin("BIGINT", "DOUBLE", "FLOAT") | kind(f).startswith("DECIMAL"))
    number = lambda f: F.try_variant_get("v", f"$.{f}", "double").cast("int")
    return d.where(F.col("v").isNotNull() & ok).select(
        "project", "seq", F.try_variant_get("v", "$.timestamp", "string").cast("timestamp").alias("ts"), number("score").alias("score"), F.try_variant_get("v", "$.label", "string").alias("label"),
        number("errors").alias("errors"), number("warnings").alias("warnings"), number("filesScanned").alias("files_scanned"), number("filesAffected").alias("files_affected"),
    )


def newest(history: DataFrame, n: int = KEPT) -> DataFrame:
    """The newest ``n`` entries of each project. Spark limits each group before it shuffles."""
    order = Window.partitionBy("project").orderBy(F.desc("ts"), F.desc("seq"))
    return history.withColumn("__k", F.row_number().over(order)).where(F.col("__k") <= n).drop("__k")


HISTORY = "project string, seq long, ts timestamp, score int, label string, errors int, warnings int, files_scanned int, files_affected int, part int"


def history(spark: SparkSession, path: str) -> DataFrame:
    """The history table at ``path``."""
    return PartedTable(spark, path, HISTORY).read().drop(PART)


def append_history(entries: DataFrame, path: str, n: int = KEPT) -> None:
    """Adds entries to the history table at ``path`` and keeps the newest ``n`` of each project.

    The table is dealt by a hash of the project: only parts that have a project of ``entries`` are read and
    rewritten. Appending the same entries again, as after a failure, changes nothing.
    """
    table = PartedTable(entries.sparkSession, path, HISTORY)
    entries = entries.withColumn(PART, part_of("project"))
    columns = table.spark.createDataFrame([], HISTORY).columns
    both = table.read(touched(entries)).unionByName(entries, allowMissingColumns=True).select(columns).dropDuplicates(["project", "ts", "seq"])
    table.replace(newest(both, n))


def last_n(history: DataFrame, n: int | None = None) -> DataFrame:
    """The window of a trend: the last ``n`` runs; 20 if that is no number above 0, 500 at most."""
    size = min(n, MOST) if isinstance(n, int) and n >= 1 else WINDOW
    return newest(history, size)


def summary(history: DataFrame, n: int | None = None) -> DataFrame:
    """Per project: first, latest, best and worst of the window, arrow; runs and days of the whole history."""
    at = F.struct("ts", "seq")
    some = last_n(history, n).groupBy("project").agg(
        F.min_by("score", at).alias("first"), F.max_by("score", at).alias("latest"), F.max_by("label", at).alias("latest_label"), F.max("score").alias("best"), F.min("score").alias("worst"),
        F.min_by("label", F.struct(-F.col("score"), "ts", "seq")).alias("best_label"), F.min_by("label", F.struct("score", "ts", "seq")).alias("worst_label"),
    )
    whole = history.groupBy("project").agg(F.count("*").alias("runs"), (F.unix_millis(F.max("ts")) - F.unix_millis(F.min("ts"))).alias("ms"))
    days = F.greatest(F.lit(1), F.ceil(F.col("ms") / 86_400_000.0)).cast("long")
    diff = F.col("latest") - F.col("first")
    arrow = F.when(diff > 2, "up").when(diff < -2, "down").otherwise("stable")
    return some.join(whole.select("project", "runs", days.alias("days")), "project").withColumn("arrow", arrow)


def delta(history: DataFrame) -> DataFrame:
    """Each entry with its change against the run before; the first is compared with 100."""
    order = Window.partitionBy("project").orderBy("ts", "seq")
    return history.withColumn("delta", F.col("score") - F.lag("score", 1, 100).over(order))


def bins(history: DataFrame, n: int | None = None) -> DataFrame:
    """The chart's cells: project, seq, threshold, filled, band."""
    d = last_n(history, n).select("project", "seq", "score", F.explode(F.sequence(F.lit(STEP), F.lit(100), F.lit(STEP))).alias("threshold"))
    band = F.when(F.col("score") >= GREEN, "green").when(F.col("score") >= YELLOW, "yellow").otherwise("red")
    return d.select("project", "seq", "threshold", (F.col("score") >= F.col("threshold")).alias("filled"), band.alias("band"))
