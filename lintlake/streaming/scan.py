"""Rules on a stream of file contents: each batch scans the files it changes, and whole projects where those change their profile."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lintlake.functions.text import matches
from lintlake.operators import projects, report, rules
from lintlake.sources.corpus import SOURCE_ENDINGS
from lintlake.sources.parts import PART, PartedTable, touched
from lintlake.sources.shared import forget, written
from lintlake.streaming.live import _await

#: Files are dealt by project, and a project's files by path, so that a scan of a project reads its own parts alone.
PROJECTS = PATHS = 16
HITS = "array<struct<rule:string,line:int,col:int,message:string>>"
FILES = f"project string, path string, at long, seq long, deleted boolean, runes boolean, content string, hits {HITS}, part int"
PROFILES = (
    "project string, framework string, framework_version string, has_typescript boolean, uses_runes boolean, "
    "ignore_rules array<string>, ignore_files array<string>, part int"
)
#: Files of a project's root that its profile is read from, and its error page, which other files' findings depend on.
_ROOT = ("package.json", "tsconfig.json", *projects.BUILD_CONFIGS, rules.ERROR_PAGE)
_KEY = ["project", "path"]


def _bucket() -> Column:
    return F.pmod(F.xxhash64("project"), F.lit(PROJECTS)).cast("int")


def _part(path: Column) -> Column:
    return (_bucket() * PATHS + F.pmod(F.xxhash64(path), F.lit(PATHS))).cast("int")


class LiveScan:
    """The last content of each file below ``path`` with what rules find in it, and each project's profile.

    Changes: project, path, ts, seq, op (``upsert`` or ``delete``), content. Of a file's changes in a batch the last counts; one
    older than the file's last known change is refused and kept in a side table. A repeated batch gives the same tables:
    what it does follows from it and the files table, which is replaced last.
    """

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path.rstrip("/")
        self.files = PartedTable(spark, f"{self.path}/files", FILES)
        self.profiles = PartedTable(spark, f"{self.path}/profiles", PROFILES)

    def write(self, batch: DataFrame, turn: int, run: str = "") -> None:
        """For foreachBatch."""
        place = F.struct(F.unix_micros("ts").alias("at"), "seq")
        last = batch.groupBy(*_KEY).agg(F.max_by(F.struct("op", "content", place.alias("place")), place).alias("c"))
        deleted = F.col("c.op") == "delete"
        runes = F.col("path").endswith(".svelte") & ~deleted & matches(F.coalesce("c.content", F.lit("")), projects.RUNES)
        changed = written(last.select(*_KEY, F.col("c.place.at").alias("at"), F.col("c.place.seq").alias("seq"), deleted.alias("deleted"), runes.alias("runes"), F.when(~deleted, F.col("c.content")).alias("content"), _part(F.col("path")).alias(PART)))
        parts = touched(changed)
        if not parts:
            return
        known = self.files.read(parts).select(*_KEY, F.struct("at", "seq").alias("known"), (F.col("runes") & ~F.col("deleted")).alias("had"))
        told = changed.join(known, _KEY, "left").withColumn("refused", F.coalesce(F.col("known") > F.struct("at", "seq"), F.lit(False)))
        told = written(told)
        told.where("refused").select(*_KEY, "at", "seq", "deleted").write.mode("overwrite").parquet(f"{self.path}/refused/{run}batch={turn}")
        new = told.where("not refused").select(*changed.columns)
        # projects that may have another profile now: a root file changed, or a component began or ceased to use runes
        asked = F.col("path").isin(*_ROOT)
        moved = told.where("not refused").where(asked | (F.col("runes") != F.coalesce("had", F.lit(False)))).groupBy("project").agg(F.bool_or(asked).alias("asked"))
        todo, stale = new, None
        moved = written(moved.withColumn(PART, _bucket()))
        buckets = touched(moved)
        if buckets:
            parts = sorted({*parts, *(b * PATHS + k for b in buckets for k in range(PATHS))})
            old = self.files.read(parts).join(moved.select("project"), "project", "left_semi")
            now = old.join(new.select(*_KEY), _KEY, "left_anti").select(*new.columns).unionByName(new.join(moved.select("project"), "project", "left_semi")).where("not deleted")
            now = written(now)
            self._profile(now, moved, buckets)
            uses = lambda d, name: d.where("not deleted").groupBy("project").agg(F.bool_or("runes").alias(name))
            flips = moved.join(uses(old, "before"), "project", "left").join(uses(now, "after"), "project", "left")
            again = flips.where(F.col("asked") | (F.coalesce("before", F.lit(False)) != F.coalesce("after", F.lit(False)))).select("project")
            stale = written(now.join(again, "project", "left_semi").join(new.select(*_KEY), _KEY, "left_anti"))
            todo = new.unionByName(stale)
        done = todo.join(self._hits(todo, new), _KEY, "left").withColumn("hits", F.coalesce("hits", F.array().cast(HITS)))
        kept = self.files.read(parts).join(todo.select(*_KEY), _KEY, "left_anti")
        self.files.replace(kept.unionByName(done.select(*kept.columns)))
        forget(changed, told, moved, *([stale] if stale is not None else []))

    def _profile(self, files: DataFrame, moved: DataFrame, buckets: list[int]) -> None:
        """Stores the profiles and ignore lists of projects whose root files or runes changed; one without a manifest loses its own."""
        # a component's content says no more here than whether it uses runes
        slim = files.select(*_KEY, F.when(F.col("path").isin(*_ROOT, projects.CONFIG_FILE), F.col("content")).otherwise(F.when(F.col("runes"), "$state(").otherwise("")).alias("content"))
        manifests, _ = projects.read_manifests(slim)
        lists = projects.resolve_configs(projects.config_sources(slim, manifests)).select("project", "ignore_rules", "ignore_files")
        made = projects.profiles(slim, manifests).join(lists, "project", "left").withColumn(PART, _bucket())
        made = moved.select("project", PART).join(made.drop(PART), "project", "left")
        kept = self.profiles.read(buckets).join(moved.select("project"), "project", "left_anti")
        self.profiles.replace(kept.unionByName(made.select(*kept.columns)))

    def _hits(self, todo: DataFrame, new: DataFrame) -> DataFrame:
        """project, path, hits of the files to scan, by all rules; those of projects without a framework version have none."""
        ends = "|".join(e.replace(".", r"\.") for e in SOURCE_ENDINGS)
        source = todo.where("not deleted").where(F.col("path").rlike(f"({ends})$")).select(*_KEY, "content")
        source = written(source)
        gates = self.profiles.read().where("framework_version is not null")
        pages = todo.select("project").distinct().select(_part(F.lit(rules.ERROR_PAGE)).alias(PART))
        there = self.files.read(touched(pages)).where((F.col("path") == rules.ERROR_PAGE) & ~F.col("deleted")).select(*_KEY)
        there = there.join(new.select(*_KEY), _KEY, "left_anti").unionByName(new.where((F.col("path") == rules.ERROR_PAGE) & ~F.col("deleted")).select(*_KEY))
        found = rules.evaluate(source, gates.join(source.select("project").distinct(), "project", "left_semi"), evidence=there)
        return found.groupBy(*_KEY).agg(F.sort_array(F.collect_list(F.struct("rule", "line", "col", "message"))).alias("hits"))

    def run(self, changes: DataFrame) -> None:
        """Takes what is there of a stream of changes."""
        name = uuid.uuid4().hex
        _await(changes.writeStream.foreachBatch(lambda batch, turn: self.write(batch, turn, f"run={name}/")).option("checkpointLocation", f"{self.path}/state-{name}"))

    def findings(self) -> DataFrame:
        """Findings of the files as they are now, without the rules and paths that their projects ignore."""
        gates = self.profiles.read().where("framework_version is not null")
        rows = self.files.read().where("not deleted").select(*_KEY, F.explode("hits").alias("h")).select(*_KEY, "h.*").join(gates.select("project"), "project", "left_semi")
        found = rules.findings(rows)
        listed = gates.where("ignore_rules is not null")
        return report.ignore_paths(report.ignore_rules(found, listed), listed)

    def refused(self) -> DataFrame:
        return self.spark.read.schema("project string, path string, at long, seq long, deleted boolean").option("recursiveFileLookup", True).parquet(f"{self.path}/refused")
