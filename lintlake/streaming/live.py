"""Live results over a stream of file changes, with Structured Streaming.

A change: ts timestamp, seq long (orders equal times), project, path, op (``upsert``, ``delete``,
``gate_off``) and what the scan of its content found. scan.py has streams of contents, on which rules run.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Row, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from lintlake.operators.report import score_of
from lintlake.sources.corpus import IGNORED
from lintlake.sources.shared import forget, shared_dir, written

#: Endings that are watched, and how long a file must be quiet.
WATCHED, QUIET = r"\.(svelte|ts|js|json)$", "150 milliseconds"
#: How late a change may be against the newest one, and how long a deleted file is remembered.
LATE, KEPT = "10 minutes", "30 days"


def change_filter(changes: DataFrame) -> DataFrame:
    """Changes of watched files that stay inside their project and outside ignored directories. Stateless."""
    names = "|".join(i.replace(".", r"\.") for i in IGNORED)
    path = F.col("path")
    inside = ~path.rlike(r"^/|^\.\.(/|$)|^[A-Za-z]:") & ~path.rlike(rf"(^|[\\/])({names})([\\/]|$)")
    return changes.where(path.rlike(WATCHED) & inside)


def debounce(changes: DataFrame, quiet: str = QUIET, late: str = LATE) -> DataFrame:
    """One row per run of changes of a file with ``quiet`` or less between them: its last change counts.

    In append mode a run comes out once the watermark has passed its end; run_flushed() closes the last ones too.
    """
    d = changes.withWatermark("ts", late)
    last = F.max_by(F.col("seq"), F.struct("ts", "seq"))
    out = d.groupBy("project", "path", F.session_window("ts", quiet).alias("run")).agg(last.alias("seq"), F.count("*").alias("n"))
    return out.select("project", "path", F.col("run.start").alias("start"), "seq", "n")


def latest(changes: DataFrame) -> DataFrame:
    """The newest change of each file; older ones that come late are ignored. Keyed state, one row per file."""
    row = F.max_by(F.struct("op", "hits", "seq"), F.struct("ts", "seq"))
    return changes.groupBy("project", "path").agg(row.alias("now")).select("project", "path", "now.*")


def live_findings(newest: DataFrame) -> DataFrame:
    return newest.where("op != 'delete'").select("project", "path", "hits", "seq")


def with_snapshot(newest: DataFrame, snapshot: DataFrame) -> DataFrame:
    """Live findings on top of a first scan (project, path, hits): files without a change keep its result."""
    s = snapshot.select("project", "path", F.col("hits").alias("first"))
    both = s.join(newest, ["project", "path"], "full_outer").where("op is null or op != 'delete'")
    return both.select("project", "path", F.coalesce("hits", "first").alias("hits"), F.coalesce("seq", F.lit(-1)).alias("seq"))


#: What a file adds to its project: penalties with and without runes in the project (tenths), and whether it uses them.
STATE = "at long, seq long, plain long, gated long, runes boolean, deleted boolean"
DIFFERENCE = (
    "project string, path string, at long, seq long, op string, refused boolean, plain long, gated long, runes long, "
    "old_at long, old_seq long, old_plain long, old_gated long, old_runes long"
)
_GATE = "gate_off"


class Differences(StatefulProcessor):
    """Keeps what each file (project, path) adds; gives, for each change, the new values beside the old ones.

    A change older than the one known, or later than allowed, is refused: its row says so and has the old values
    as new ones. A timer drops a deleted file's state. What a first scan has of a file stands beside its changes, so that
    files without a change never come here; a deleted file of that scan keeps its state, lest the scan's values return.
    Rows are plain ones, many files in a batch: a data frame for each file costs several times the work on it.
    """

    def __init__(self, late_ms: int, kept_ms: int) -> None:
        self.late_ms, self.kept_ms = late_ms, kept_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.file = handle.getValueState("file", STATE)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        old = self.file.get()  # one call of the state store for each file, and one to store
        changes = sorted((tuple(row[c] for c in _READ) for row in rows), key=lambda c: c[:6])
        first = changes[0][6:]
        scanned = first[0] is not None
        timed = bool(old and old[5] and not scanned)
        if old is None and scanned:
            old = (FIRST, -1, int(first[0]), int(first[1]), bool(first[2]), False)
        # the watermark stands KEPT behind the newest change, so that late rows come here to be refused and not lost
        mark = timerValues.getCurrentWatermarkInMs()
        oldest = (mark + self.kept_ms - self.late_ms) * 1000 if mark > 0 else None
        out = []
        for at, seq, op, plain, gated, runes, *_ in changes:
            before = (int(old[2]), int(old[3]), int(old[4])) if old else (0, 0, 0)
            place = (int(old[0]), int(old[1])) if old else (None, None)
            refused = (old is not None and at < place[0]) or (oldest is not None and at < oldest)
            if op == _GATE or refused:
                now = before
            else:
                now = (0, 0, 0) if op == "delete" else (int(plain), int(gated), int(runes))
                old = (at, seq, now[0], now[1], bool(now[2]), op == "delete")
            out.append(_ROW(key[0], key[1], at, seq, op, refused, *now, *place, *before))
        if old is not None:
            self.file.update(old)
            for timer in list(self.handle.listTimers()) if timed else ():
                self.handle.deleteTimer(timer)
            if old[5] and not scanned:
                self.handle.registerTimer(max(int(old[0]) // 1000, mark) + 1)  # the watermark gets there KEPT later
        return iter(out)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        if self.file.exists() and self.file.get()[5]:
            self.file.clear()
        return iter(())

    def close(self) -> None:
        pass


_READ = ("at", "seq", "op", "plain", "gated", "runes", "first_plain", "first_gated", "first_runes")
_ROW = Row(*[field.split()[0] for field in DIFFERENCE.split(", ")])
#: The time of a first scan: before all changes.
FIRST = -(1 << 62)


def _ms(interval: str) -> int:
    return int(pd.Timedelta(interval).total_seconds() * 1000)


def differences(changes: DataFrame, first: DataFrame | None = None, late: str = LATE, kept: str = KEPT) -> DataFrame:
    """Old and new values of each changed file (DIFFERENCE), by keyed state: a file's changes are one task, a project's are many.

    ``changes``: project, path, ts, seq, op, plain, gated, runes. A project's ``gate_off`` has no file. ``first``:
    project, path, plain, gated, runes of a first scan.
    """
    path = F.when(F.col("op") == _GATE, F.lit("")).otherwise(F.col("path"))
    d = changes.select("project", path.alias("path"), "ts", F.unix_micros("ts").alias("at"), "seq", "op", "plain", "gated", "runes")
    none = [F.lit(None).cast(t).alias(f"first_{c}") for c, t in (("plain", "long"), ("gated", "long"), ("runes", "boolean"))]
    if first is None:
        d = d.select("*", *none)
    else:
        # a file that both have is looked up in the scan, which isn't read into the state
        known = first.dropDuplicates(["project", "path"]).select(F.col("project").alias("_p"), F.col("path").alias("_f"), *[F.coalesce(c, F.lit(zero)).alias(f"first_{c}") for c, zero in (("plain", 0), ("gated", 0), ("runes", False))])
        d = d.join(known, F.col("project").eqNullSafe(F.col("_p")) & F.col("path").eqNullSafe(F.col("_f")), "left").drop("_p", "_f")
    return d.withWatermark("ts", kept).groupBy("project", "path").transformWithState(
        statefulProcessor=Differences(_ms(late), _ms(kept)), outputStructType=DIFFERENCE, outputMode="append", timeMode="eventtime"
    )


TOTALS = "project string, seq long, penalty long, score int, delta int, status string, runes boolean"
#: A project's sums after a batch, since its last gate, its last score, and that gate's place.
_SUMS = "project string, plain long, gated long, runes long, score int, gate struct<at:bigint,seq:bigint>"
#: Spans of time that a batch is cut into, for running sums of a project in many tasks.
SPANS = 512


def _carried(d: DataFrame, value: Column, name: str, base: Column) -> DataFrame:
    """Adds ``name``: the last ``value`` that isn't null in the project's rows before this one, else ``base``.

    Rows are in order of (span, place); the last value of each span comes from one row for each, aggregated map-side.
    """
    d = d.withColumn("_v", value)
    last = d.groupBy("project", "span").agg(F.max_by("_v", F.when(F.col("_v").isNotNull(), F.col("place"))).alias("_last"))
    before = Window.partitionBy("project").orderBy("span").rowsBetween(Window.unboundedPreceding, -1)
    last = last.select("project", "span", F.last("_last", ignorenulls=True).over(before).alias("_before"))
    inside = Window.partitionBy("project", "span").orderBy("place").rowsBetween(Window.unboundedPreceding, -1)
    d = d.withColumn("_in", F.last("_v", ignorenulls=True).over(inside)).join(last, ["project", "span"])
    return d.withColumn(name, F.coalesce("_in", "_before", base)).drop("_v", "_in", "_before")


def _summed(d: DataFrame, values: dict[str, Column]) -> DataFrame:
    """Adds running sums, this row's value included, over a project's rows since its last gate, as in _carried()."""
    part = d.groupBy("project", "gate", "span").agg(*[F.sum(v).alias(f"_{n}") for n, v in values.items()])
    before = Window.partitionBy("project", "gate").orderBy("span").rowsBetween(Window.unboundedPreceding, -1)
    part = part.select("project", "gate", "span", *[F.coalesce(F.sum(f"_{n}").over(before), F.lit(0)).alias(f"_{n}") for n in values])
    upto = Window.partitionBy("project", "gate", "span").orderBy("place").rowsBetween(Window.unboundedPreceding, 0)
    d = d.select("*", *[F.sum(v).over(upto).alias(f"_in_{n}") for n, v in values.items()]).join(part, ["project", "gate", "span"])
    return d.select(*[c for c in d.columns if not c.startswith("_")], *[(F.col(f"_in_{n}") + F.col(f"_{n}")).alias(n) for n in values])


def totals_of(found: DataFrame, sums: DataFrame) -> tuple[DataFrame, DataFrame]:
    """A batch's differences (written, none refused) as TOTALS after each change, from the sums (_SUMS) so far; and the sums after it.

    Everything after a project's last gate counts from nothing: running sums are by (project, gate), and what a
    file had before the gate is not taken off again. Rows are slim, and cut by time into SPANS for each project.
    """
    low, high = found.agg(F.min("at"), F.max("at")).first()
    if low is None:
        return found.sparkSession.createDataFrame([], TOTALS), sums
    none = F.struct(F.lit(-(1 << 63)).alias("at"), F.lit(-1).cast("long").alias("seq"))
    base = sums.select("project", *[F.col(c).alias(f"base_{c}") for c in ("plain", "gated", "runes", "score", "gate")])
    d = found.withColumn("span", F.expr(f"(at - {low}L) div {max(1, (high - low) // SPANS + 1)}L")).withColumn("place", F.struct("at", "seq")).join(base, "project", "left")
    d = d.withColumn("base_gate", F.coalesce("base_gate", none))
    d = _carried(d, F.when(F.col("op") == _GATE, F.col("place")), "gate", F.col("base_gate"))
    d = d.withColumn("gate", F.when(F.col("op") == _GATE, F.col("place")).otherwise(F.col("gate")))
    counts = F.col("old_at").isNotNull() & (F.struct(F.col("old_at").alias("at"), F.col("old_seq").alias("seq")) > F.col("gate"))
    kinds = ("plain", "gated", "runes")
    d = d.select("project", "seq", "op", "span", "place", "gate", *[c for c in d.columns if c.startswith("base_")], *[F.when(F.col("op") == _GATE, 0).otherwise(F.col(c) - F.when(counts, F.col(f"old_{c}")).otherwise(0)).alias(f"more_{c}") for c in kinds])
    d = _summed(written(d), {c: F.col(f"more_{c}") for c in kinds})
    same = F.col("gate") == F.col("base_gate")
    d = d.withColumns({c: F.col(c) + F.when(same, F.coalesce(f"base_{c}", F.lit(0))).otherwise(0) for c in kinds})
    penalty = F.col("plain") + F.when(F.col("runes") > 0, F.col("gated")).otherwise(0)
    d = written(d.withColumn("penalty", penalty.cast("long")).withColumn("score", score_of(penalty)))
    d = _carried(d, F.col("score"), "before", F.coalesce("base_score", F.lit(100)))
    delta = F.col("score") - F.col("before")
    status = F.when(delta > 0, "improved").when(delta < 0, "worse").otherwise("no change")
    totals = d.select("project", "seq", "penalty", "score", delta.alias("delta"), status.alias("status"), (F.col("runes") > 0).alias("runes"))
    last = d.groupBy("project").agg(F.max_by(F.struct("plain", "gated", "runes", "score", "gate"), "place").alias("x")).select("project", "x.*")
    return totals, last.unionByName(sums.join(last.select("project"), "project", "left_anti"))


class LiveTotals:
    """Totals of projects after each change, kept below ``path`` by batches; a repeated batch gives the same files.

    ``first``: project, path, plain, gated, runes of a first scan: the files' first values, and the first sums.
    """

    def __init__(self, spark: SparkSession, path: str, first: DataFrame | None = None) -> None:
        self.spark, self.path, self.first = spark, path.rstrip("/"), first

    def _sums(self, turn: int) -> DataFrame:
        if turn > 0:
            return self.spark.read.schema(_SUMS).parquet(f"{self.path}/sums/batch={turn - 1}")
        if self.first is None:
            return self.spark.createDataFrame([], _SUMS)
        runes = F.count_if("runes")
        per = self.first.groupBy("project").agg(F.sum("plain").cast("long").alias("plain"), F.sum("gated").cast("long").alias("gated"), runes.cast("long").alias("runes"))
        score = score_of(F.col("plain") + F.when(F.col("runes") > 0, F.col("gated")).otherwise(0))
        return per.select("*", score.alias("score"), F.lit(None).cast("struct<at:bigint,seq:bigint>").alias("gate"))

    def write(self, batch: DataFrame, turn: int) -> None:
        """For foreachBatch, on differences(): refused changes go to their side table, the others become totals."""
        found = written(batch)
        put = lambda d, name: d.write.mode("overwrite").parquet(f"{self.path}/{name}/batch={turn}")
        put(found.where("refused").select("project", "path", "at", "seq", "op"), "refused")
        totals, sums = totals_of(found.where("not refused"), self._sums(turn))
        put(totals, "totals")
        put(sums, "sums")
        forget(found)

    def run(self, changes: DataFrame, late: str = LATE, kept: str = KEPT) -> DataFrame:
        """Takes what is there of a stream of changes; returns totals()."""
        self.spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
        try:
            _await(differences(changes, self.first, late, kept).writeStream.foreachBatch(self.write).outputMode("append").option("checkpointLocation", f"{self.path}/state"))
        finally:
            self.spark.conf.unset("spark.sql.streaming.stateStore.providerClass")
        return self.totals()

    def totals(self) -> DataFrame:
        return self.spark.read.schema(TOTALS).parquet(f"{self.path}/totals/batch=*")

    def refused(self) -> DataFrame:
        return self.spark.read.schema("project string, path string, at long, seq long, op string").parquet(f"{self.path}/refused/batch=*")


def live_totals(changes: DataFrame, first: DataFrame | None = None) -> DataFrame:
    """TOTALS after each change of the stream ``changes`` (differences()), on top of a first scan."""
    spark = changes.sparkSession
    return LiveTotals(spark, f"{shared_dir(spark)}/totals-{uuid.uuid4().hex}", first).run(changes)


def _await(writer) -> None:
    query = writer.trigger(availableNow=True).start()
    query.awaitTermination()
    if query.exception():
        raise query.exception()


def run_once(stream: DataFrame, mode: str = "append") -> DataFrame:
    """Runs a stream over what is there and gives its result as a table in the shared folder."""
    spark: SparkSession = stream.sparkSession
    at = f"{shared_dir(spark)}/stream-{uuid.uuid4().hex}"

    def keep(batch: DataFrame, turn: int) -> None:
        batch.write.mode("append" if mode == "append" else "overwrite").parquet(f"{at}/out")

    _await(stream.writeStream.foreachBatch(keep).outputMode(mode).option("checkpointLocation", f"{at}/state"))
    return spark.read.schema(stream.schema).parquet(f"{at}/out")


def run_flushed(changes: DataFrame, made: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """``made(changes)`` in append mode, over what is there and then, from the same checkpoint, over one row of a
    distant time and no project, which moves the watermark past all ends; what comes of that row is left out."""
    spark = changes.sparkSession
    at = f"{shared_dir(spark)}/stream-{uuid.uuid4().hex}"
    spark.createDataFrame([], changes.schema).write.parquet(f"{at}/end")
    end = spark.readStream.schema(changes.schema).parquet(f"{at}/end")
    out = made(changes.unionByName(end))

    def keep(batch: DataFrame, turn: int) -> None:
        # here, since a filter in the stream itself would reach its sources, and the watermark would not see the row
        batch.where("project is not null").write.mode("overwrite").parquet(f"{at}/out/batch={turn}")

    for _ in range(2):
        _await(out.writeStream.foreachBatch(keep).outputMode("append").option("checkpointLocation", f"{at}/state"))
        last = spark.range(1).select(*[(F.timestamp_seconds(F.lit(1 << 36)) if f.name == "ts" else F.lit(None)).cast(f.dataType).alias(f.name) for f in changes.schema])
        last.write.mode("append").parquet(f"{at}/end")
    return spark.read.schema(out.schema).parquet(f"{at}/out/batch=*")
