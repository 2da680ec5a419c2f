"""Whole scans in one call: diagnose, scan, and rules of one's own."""

from __future__ import annotations

from collections.abc import Callable, Iterable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lintlake.operators import graph, projects, report, rules, trend
from lintlake.sources.shared import written

FrameRule = Callable[[DataFrame, DataFrame], DataFrame]
ColumnRule = tuple[Column, Column]


@dataclass(frozen=True)
class UserRule:
    """A rule of the caller's: what it is called, and how it finds.

    find: a (condition, column) pair of expressions on a line, or a function of (lines, profiles) that
    returns project, path, line, col, message.
    """

    name: str
    category: str
    severity: str
    message: str
    find: FrameRule | ColumnRule
    help: str = ""
    weight: float = 1.0


_USER_RULES: dict[str, UserRule] = {}


def register_rule(rule: UserRule) -> None:
    """Adds a rule to all later scans of this process; one of the same name is replaced."""
    _USER_RULES[rule.name] = rule


def clear_rules() -> None:
    _USER_RULES.clear()


@dataclass
class Scan:
    """What a scan gives."""

    findings: DataFrame
    scores: DataFrame
    profiles: DataFrame
    files: DataFrame = field(repr=False)


def user_findings(user_rules: Iterable[UserRule], lines: DataFrame, profiles: DataFrame) -> DataFrame | None:
    """What rules of the caller's find on ``lines`` (with their regions); None if there are none."""
    out = None
    for r in user_rules:
        if callable(r.find):
            hits = r.find(lines, profiles).select("project", "path", "line", "col", "message")
        else:
            condition, col = r.find
            hits = lines.where(condition).select("project", "path", "line", col.cast("int").alias("col"), F.lit(r.message).alias("message"))
        found = hits.select(
            "project", "path", F.lit(r.name).alias("rule"), F.lit(r.severity).alias("severity"), F.lit(r.category).alias("category"), "message",
            F.lit(r.help).alias("help"), F.col("line").cast("int").alias("line"), "col", F.lit(r.weight).alias("weight"),
        )
        out = found if out is None else out.unionByName(found)
    return out


def diagnose(files: DataFrame, lint: bool | None = None, dead_code: bool | None = None, errors_only: bool = False) -> Scan:
    """Findings, scores and profiles of all projects in ``files`` (project, path, content).

    Projects without a framework version are gated: no findings, score 100. A phase runs by the option,
    else the project's config, else yes. Ignored rules and paths are taken out after all phases, since
    ignored files still count as evidence for others. Files and findings are written once to the shared folder; no history is.
    """
    files = written(files)  # each phase reads them, some more than once
    manifests, _ = projects.read_manifests(files)
    profiles = written(projects.profiles(files, manifests))
    configs = written(projects.resolve_configs(projects.config_sources(files, manifests)))
    switches = profiles.where("framework_version is not null").join(configs, "project", "left").select(
        "project", projects.phase(lint, F.col("lint")).alias("do_lint"), projects.phase(dead_code, F.col("dead_code")).alias("do_dead")
    )
    source = files.where(F.col("path").rlike(r"\.(svelte|ts|js)$"))
    linted = profiles.join(switches.where("do_lint"), "project", "left_semi")
    lines = written(rules.scan_lines(source, linted))
    found = rules.findings(rules.evaluate(source, linted, lines=lines))
    own = user_findings(_USER_RULES.values(), lines, linted)
    found = found if own is None else found.unionByName(own)
    checked = source.join(switches.where("do_dead"), "project", "left_semi")
    dead = graph.dead_code(checked)
    found = report.ignore_paths(report.ignore_rules(found.unionByName(dead), configs), configs)
    if errors_only:
        found = report.errors_only(found)
    found = written(found)
    return Scan(found, report.scores(found, profiles), profiles, source)


def scan(files: DataFrame, history: str, reports: str, lint: bool | None = None, dead_code: bool | None = None) -> Scan:
    """diagnose(), one history entry per project appended to ``history``, one JSON report each to ``reports``."""
    s = diagnose(files, lint, dead_code)
    counts = report.severity_counts(s.findings, s.files)
    entry = s.scores.join(counts, "project").select(
        "project", F.unix_micros(F.current_timestamp()).alias("seq"), F.current_timestamp().alias("ts"), "score", "label", F.col("errors").cast("int").alias("errors"),
        F.col("warnings").cast("int").alias("warnings"), F.col("total").cast("int").alias("files_scanned"), F.col("affected").cast("int").alias("files_affected"),
    )
    trend.append_history(entry, history)
    report.report_json(s.findings, s.scores, s.files).write.mode("overwrite").json(reports)
    return s
