"""Operators on findings: gates, ignore lists, scores, counts, reports, work queues, before/after."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lintlake.sources.shared import written

#: Severity weights, category multipliers in tenths, labels from each score, order of fixing.
SEVERITY = {"error": 3, "warning": 1}
MULTIPLIERS = {"Security": 20, "Correctness": 15, "State & Reactivity": 12, "Performance": 10, "SvelteKit": 10, "Architecture": 8, "Accessibility": 8, "Bundle Size": 7, "Dead Code": 5}
LABELS = ((90, "Excellent"), (75, "Good"), (50, "Needs Work"), (25, "Poor"), (0, "Critical"))
ORDER = ("Security", "Correctness", "Performance", "State & Reactivity", "SvelteKit", "Architecture", "Accessibility", "Bundle Size", "Dead Code")


def _lookup(values: dict, key: Column, other: int) -> Column:
    return F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in values.items() for x in kv]), key), F.lit(other))


def penalty(severity: Column, category: Column, weight: Column | None = None) -> Column:
    """In tenths, or with a weight (three decimals of it count) in ten-thousandths: whole numbers, so that sums don't depend on their order."""
    tenths = (_lookup(SEVERITY, severity, 1) * _lookup(MULTIPLIERS, category, 10)).cast("long")
    return tenths if weight is None else tenths * F.round(F.coalesce(weight, F.lit(1.0)) * 1000).cast("long")


def label_of(score: Column) -> Column:
    out = F.lit(LABELS[-1][1])
    for least, name in reversed(LABELS[:-1]):
        out = F.when(score >= least, name).otherwise(out)
    return out


def score_of(tenths: Column) -> Column:
    """100 * exp(-penalty / 80), rounded half up, between 0 and 100."""
    return F.least(F.lit(100), F.greatest(F.lit(0), F.floor(F.lit(100.0) * F.exp(-tenths.cast("double") / 800.0) + 0.5))).cast("int")


def scores(findings: DataFrame, projects: DataFrame) -> DataFrame:
    """project, penalty (whole tenths), score, label for every project; without a finding 100 and ``Perfect``.

    A finding's penalty is that of its severity and category times its weight (1 where there is no such column).
    """
    weight = F.col("weight") if "weight" in findings.columns else F.lit(1.0)
    per = findings.groupBy("project").agg(F.sum(penalty(F.col("severity"), F.col("category"), weight)).alias("penalty"))
    d = projects.select("project").distinct().join(per, "project", "left")
    score = score_of(F.coalesce(F.col("penalty") / 1000, F.lit(0.0)))
    label = F.when(F.col("penalty").isNull(), "Perfect").otherwise(label_of(score))
    return d.select("project", F.floor(F.coalesce(F.col("penalty") / 1000, F.lit(0.0))).alias("penalty"), score.alias("score"), label.alias("label"))


def gated(findings: DataFrame, profiles: DataFrame) -> DataFrame:
    """Findings of projects that have a framework version."""
    return findings.join(profiles.where("framework_version is not null").select("project"), "project", "left_semi")


def ignore_rules(findings: DataFrame, configs: DataFrame) -> DataFrame:
    """Without the rules that a project's config (project, ignore_rules array) lists."""
    listed = configs.select("project", F.explode("ignore_rules").alias("rule")).distinct()
    return findings.join(listed, ["project", "rule"], "left_anti")


def glob_pattern(pattern: Column) -> Column:
    """A glob as a regular expression: ``**`` any text, ``*`` any text without a slash, all else literal."""
    escaped = F.regexp_replace(pattern, r"([.+?^${}()|\[\]\\])", r"\\$1")
    return F.concat(F.lit("^"), F.replace(F.replace(F.replace(escaped, F.lit("**"), F.lit("\0")), F.lit("*"), F.lit("[^/]*")), F.lit("\0"), F.lit(".*")), F.lit(r"\z"))


def ignore_paths(findings: DataFrame, configs: DataFrame) -> DataFrame:
    """Without paths that a project's patterns (ignore_files array) name: globs if they have a ``*``, else parts of a path.

    Patterns are joined on project, so a project meets its own list alone.
    """
    listed = configs.select(F.col("project").alias("__p"), F.explode("ignore_files").alias("__f")).where("__f != ''").distinct()
    hit = F.when(F.col("__f").contains("*"), F.regexp_like(F.col("path"), glob_pattern(F.col("__f")))).otherwise(F.contains(F.col("path"), F.col("__f")))
    return findings.join(listed, (F.col("project") == F.col("__p")) & hit, "left_anti")


def errors_only(findings: DataFrame) -> DataFrame:
    return findings.where("severity = 'error'")


def severity_counts(findings: DataFrame, files: DataFrame) -> DataFrame:
    """project, errors, warnings, affected (distinct files), total files."""
    n = findings.groupBy("project").agg(
        F.count_if(F.col("severity") == "error").alias("errors"), F.count_if(F.col("severity") == "warning").alias("warnings"), F.count_distinct("path").alias("affected")
    )
    total = files.groupBy("project").agg(F.count("*").alias("total"))
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return total.join(n, "project", "left").select("project", zero("errors"), zero("warnings"), zero("affected"), "total")


def quality_gate(findings: DataFrame, projects: DataFrame) -> DataFrame:
    """project, failed: it has an error."""
    bad = findings.groupBy("project").agg(F.bool_or(F.col("severity") == "error").alias("failed"))
    return projects.select("project").distinct().join(bad, "project", "left").select("project", F.coalesce("failed", F.lit(False)).alias("failed"))


def _rank(category: Column) -> Column:
    return _lookup({c: i + 1 for i, c in enumerate(ORDER)}, category, len(ORDER) + 1)


def category_rollup(findings: DataFrame) -> DataFrame:
    """Counts by (project, category), by project (category null) and over all (both null), with the order of fixing."""
    d = findings.rollup("project", "category").agg(F.count("*").alias("n"))
    return d.select("project", "category", "n", F.when(F.col("category").isNotNull(), _rank(F.col("category"))).otherwise(0).cast("int").alias("rank"))


def ranked(rows: DataFrame, group: str, order: list[Column], name: str) -> DataFrame:
    """Adds ``name``: the row's place (from 1) in its ``group`` by ``order``.

    A group can hold any part of all rows: rows are range-sorted over the whole table and written, so that a
    large group lies in many parts. Places are counted within a part; how many rows of the group the parts
    before it have is added, from one row for each part and group.
    """
    keys = [o.alias(f"__o{i}") for i, o in enumerate(order)]
    by = [F.col(f"__o{i}") for i in range(len(order))]
    parts = rows.select("*", *keys).repartitionByRange(F.col(group), *by).withColumn("__part", F.spark_partition_id())
    parts = written(parts)
    counts = parts.groupBy(group, "__part").agg(F.count("*").alias("__n"))
    before = F.coalesce(F.sum("__n").over(Window.partitionBy(group).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    counts = counts.select(F.col(group).alias("__g"), F.col("__part").alias("__p"), before.alias("__before"))
    inside = F.row_number().over(Window.partitionBy(group, "__part").orderBy(*by))
    placed = parts.withColumn("__in", inside).join(counts, F.col(group).eqNullSafe(F.col("__g")) & (F.col("__part") == F.col("__p")))
    return placed.select(*rows.columns, (F.col("__in") + F.col("__before")).cast("int").alias(name))


def grouped_report(findings: DataFrame) -> DataFrame:
    """One row per (project, rule, message) and file: the group's count, place and help, the file and its lines.

    Places are by errors first, then by where a group is first seen in the order of path, line and
    column; help is that of its first finding. A group's files are rows of their own, so no row grows
    with the project; lines: the file's distinct ones above 0, as ``1,4``.
    """
    group = ["project", "rule", "severity", "message"]
    at = F.struct("path", "line", "col")
    per = written(findings.groupBy(*group, "path").agg(
        F.count("*").alias("__n"), F.min(at).alias("__at"), F.min_by("help", at).alias("__help"), F.sort_array(F.collect_set(F.when(F.col("line") > 0, F.col("line")))).alias("__lines")
    ))
    groups = per.groupBy(*group).agg(F.sum("__n").alias("n"), F.min("__at").alias("__first"), F.min_by("__help", "__at").alias("help"))
    groups = ranked(groups, "project", [F.when(F.col("severity") == "error", 0).otherwise(1), F.col("__first"), F.col("rule"), F.col("message")], "place")
    lines = F.array_join(F.transform("__lines", lambda x: x.cast("string")), ",")
    return per.join(groups, group).select(*group, "n", "help", "place", "path", lines.alias("lines"))


def work_queue(findings: DataFrame, only_errors: bool = False) -> DataFrame:
    """Findings of each project in the order of fixing: place, category, severity, rule, location."""
    found = errors_only(findings) if only_errors else findings
    location = F.when(F.col("line") > 0, F.concat_ws(":", "path", "line", "col")).otherwise(F.col("path"))
    order = [_rank(F.col("category")), *[F.col(c) for c in ("path", "line", "col", "rule", "message")]]
    found = written(found.select("project", "category", "severity", "rule", "path", "line", "col", "message"))  # ranked() reads its input twice
    placed = ranked(found, "project", order, "place")
    return placed.select("project", "place", "category", "severity", "rule", location.alias("location"))


def gate_diff(before: DataFrame, after: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(counts per project, changed findings): what became new and what was resolved between two scans.

    Findings of both scans are dealt once, by their key; numbering and pairing are done where they then lie. As in a join, a key
    with a null has no partner.
    """
    key = ["project", "path", "rule", "line"]
    side = lambda d, name: d.select(*key, "severity", "col", "message", F.lit(name).alias("side"))
    rows = side(before, "old").unionByName(side(after, "new")).repartition(*key)
    nth = F.row_number().over(Window.partitionBy(*key, "side").orderBy("col", "message"))
    alone = F.when(F.isnull("project") | F.isnull("path") | F.isnull("rule") | F.isnull("line"), F.col("side"))
    of = lambda name, value: F.max(F.when(F.col("side") == name, value))
    both = rows.select(*key, "severity", "side", nth.alias("nth"), alone.alias("alone")).groupBy(*key, "nth", "alone").agg(
        of("old", F.lit(True)).alias("old"), of("new", F.lit(True)).alias("new"), of("old", F.col("severity")).alias("severity_old"), of("new", F.col("severity")).alias("severity_new")
    )
    n = lambda name, severity: F.count_if(F.col(f"severity_{name}") == severity)
    counts = both.groupBy("project").agg(n("old", "error").alias("errors_before"), n("old", "warning").alias("warnings_before"), n("new", "error").alias("errors_after"), n("new", "warning").alias("warnings_after"))
    counts = counts.withColumn("errors_increased", F.col("errors_after") > F.col("errors_before"))
    fewer = (F.col("errors_after") < F.col("errors_before")) | (F.col("warnings_after") < F.col("warnings_before"))
    counts = counts.withColumn("improved", ~F.col("errors_increased") & fewer)
    changed = both.where("old is null or new is null").select(*key, "nth", F.when(F.col("old").isNull(), "new").otherwise("resolved").alias("change"))
    return counts, changed


#: What a reader of reports can tell their form by.
REPORT_VERSION = 1


def report_json(findings: DataFrame, scored: DataFrame, files: DataFrame) -> DataFrame:
    """project, path, report: for each project one JSON document of its totals (path null), and one for each file with findings.

    Files are rows of their own, so that a project of any size can be written.
    """
    item = F.struct("line", "col", "rule", "severity", "category", "message", "help")
    listed = findings.groupBy("project", "path").agg(F.to_json(F.struct("path", F.sort_array(F.collect_list(item)).alias("diagnostics"))).alias("report"))
    d = scored.join(severity_counts(findings, files), "project")
    head = F.struct(F.lit(REPORT_VERSION).alias("version"), "score", "label", F.col("total").alias("totalFiles"), F.col("affected").alias("affectedFiles"), "errors", "warnings")
    return d.select("project", F.lit(None).cast("string").alias("path"), F.to_json(head).alias("report")).unionByName(listed)
