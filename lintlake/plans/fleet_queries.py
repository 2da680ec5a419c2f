"""Queries on findings, projects, dependencies, histories, import graphs and logs, with the oracle's SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lintlake import api
from lintlake.functions.text import quote, re2, sql_trim
from lintlake.operators import agentlog, deps, graph, projects, report, rules, trend
from lintlake.operators.lines import explode_lines, with_regions
from lintlake.operators.catalog import BY_NAME, HELP, RULES
from lintlake.plans.registry import register
from lintlake.plans.rule_queries import BASE_SQL, WHOLE_SQL, rule_sql
from lintlake.sources import derived
from lintlake.sources.corpus import FILES_SQL, PROFILES_SQL, derived_files, derived_profiles
from lintlake.sources.shared import written
from lintlake.sources.tables import table

_SQL = rule_sql()
_META = ", ".join(f"({quote(n)}, {quote(BY_NAME[n].category)}, {quote(BY_NAME[n].severity)}, {quote(HELP[n])})" for n in (r.name for r in RULES))
_FOUND = " union all ".join(f"({_SQL[r.name]})" if r.name in _SQL else f"({WHOLE_SQL[r.name]})" for r in RULES)
FINDINGS_SQL = f"{BASE_SQL}, found as ({_FOUND}), meta(rule, category, severity, help) as (values {_META}), findings as (select * from found join meta using (rule))"
_PENALTY = "(case severity when 'error' then 3 else 1 end) * (case category " + " ".join(f"when {quote(k)} then {v}" for k, v in report.MULTIPLIERS.items()) + " else 10 end)"
_RANK = "(case category " + " ".join(f"when {quote(c)} then {i + 1}" for i, c in enumerate(report.ORDER)) + " else 10 end)"
_SCORE = "least(100, greatest(0, floor(100.0 * exp(-{0}::double / 800.0) + 0.5)))::int"
_LABEL = "case when {0} >= 90 then 'Excellent' when {0} >= 75 then 'Good' when {0} >= 50 then 'Needs Work' when {0} >= 25 then 'Poor' else 'Critical' end"


def _scan(spark: SparkSession, sf_dir: str, names=None) -> tuple[DataFrame, DataFrame, DataFrame]:
    files = written(derived_files(spark, sf_dir))  # several rules read them, each its own columns
    profiles = written(derived_profiles(files))
    return files, profiles, rules.findings(rules.evaluate(files, profiles, names))


def _slim(findings: DataFrame) -> DataFrame:
    return findings.select("project", "path", "rule", "severity", "category", "line", "col", "message")


def _configs(profiles: DataFrame) -> DataFrame:
    """A config for each project of the derived corpus."""
    odd = F.regexp_extract("project", r"(\d+)$", 1).cast("int") % 2 == 1
    return profiles.select(
        "project", F.when(odd, F.array(F.lit("no-moment"), F.lit("no-eval"))).otherwise(F.array(F.lit("no-console"))).alias("ignore_rules"),
        F.when(odd, F.array(F.lit("src/lib/*"), F.lit(""))).otherwise(F.array(F.lit("**/+page.svelte"), F.lit("pkg"))).alias("ignore_files"),
    )


_ODD = "regexp_extract(project, '([0-9]+)$', 1)::int % 2 = 1"


def project_scores(spark, sf_dir):
    files, profiles, found = _scan(spark, sf_dir)
    return report.scores(found, profiles)


def gated_scores(spark, sf_dir):
    files, profiles, found = _scan(spark, sf_dir)
    return report.scores(report.gated(found, profiles), profiles)


def _scores_sql(source: str, where: str = "true") -> str:
    return f"""{source}, pen as (select project, sum({_PENALTY})::bigint as penalty from findings where {where} group by project)
      select project, coalesce(penalty, 0)::bigint as penalty, {_SCORE.format("coalesce(penalty, 0)")} as score,
        case when penalty is null then 'Perfect' else {_LABEL.format(_SCORE.format("penalty"))} end as label from profiles left join pen using (project)"""


register("project_scores", project_scores, _scores_sql(FINDINGS_SQL))
register("gated_scores", gated_scores, _scores_sql(FINDINGS_SQL, "project in (select project from profiles where framework_version is not null)"))

_F = "project, path, rule, severity, category, line, col, message"


def findings_query(spark, sf_dir):
    return _slim(_scan(spark, sf_dir)[2])


def ignore_rules(spark, sf_dir):
    _, profiles, found = _scan(spark, sf_dir)
    return report.ignore_rules(_slim(found), _configs(profiles))


def ignore_paths(spark, sf_dir):
    _, profiles, found = _scan(spark, sf_dir)
    return report.ignore_paths(_slim(found), _configs(profiles))


register("findings", findings_query, f"{FINDINGS_SQL} select {_F} from findings")
register("ignore_rules", ignore_rules, f"{FINDINGS_SQL} select {_F} from findings where case when {_ODD} then rule not in ('no-moment', 'no-eval') else rule <> 'no-console' end")
register("ignore_paths", ignore_paths, f"{FINDINGS_SQL} select {_F} from findings where case when {_ODD} then not regexp_matches(path, '^src/lib/[^/]*$') else not regexp_matches(path, '^.*/\\+page\\.svelte$') and not contains(path, 'pkg') end")
register("errors_only", lambda s, d: report.errors_only(_slim(_scan(s, d)[2])), f"{FINDINGS_SQL} select {_F} from findings where severity = 'error'")


def severity_counts(spark, sf_dir):
    files, _, found = _scan(spark, sf_dir)
    return report.severity_counts(found, files)


register(
    "severity_counts", severity_counts,
    f"""{FINDINGS_SQL}, n as (select project, count(*) filter (severity = 'error') as errors, count(*) filter (severity = 'warning') as warnings, count(distinct path) as affected from findings group by project)
    select project, coalesce(errors, 0)::bigint as errors, coalesce(warnings, 0)::bigint as warnings, coalesce(affected, 0)::bigint as affected, total from (select project, count(*) as total from files group by project) left join n using (project)""",
)
register("quality_gate", lambda s, d: (lambda x: report.quality_gate(x[2], x[1]))(_scan(s, d)), f"{FINDINGS_SQL} select project, coalesce(bool_or(severity = 'error'), false) as failed from profiles left join findings using (project) group by project")
register(
    "category_rollup", lambda s, d: report.category_rollup(_scan(s, d)[2]),
    f"""{FINDINGS_SQL} select project, category, count(*) as n, (case when category is null then 0 else {_RANK} end)::int as rank from findings group by rollup (project, category)""",
)
register(
    "grouped_report", lambda s, d: report.grouped_report(_scan(s, d)[2]),
    f"""{FINDINGS_SQL}, per as (select project, rule, severity, message, path, count(*) as k, min({{'path': path, 'line': line, 'col': col}}) as seen, min(help) as help,
      list_sort(list(distinct line) filter (line > 0)) as ls from findings group by project, rule, severity, message, path),
    g as (select project, rule, severity, message, sum(k)::bigint as n, min(seen) as seen, min(help) as help from per group by project, rule, severity, message),
    o as (select *, row_number() over (partition by project order by case when severity = 'error' then 0 else 1 end, seen.path, seen.line, seen.col, rule, message)::int as place from g)
    select project, rule, severity, message, o.n, o.help, place, path, coalesce(array_to_string(ls, ','), '') as lines from per join o using (project, rule, severity, message)""",
)
register(
    "work_queue", lambda s, d: report.work_queue(_scan(s, d)[2]),
    f"""{FINDINGS_SQL} select project, row_number() over (partition by project order by {_RANK}, path, line, col, rule, message)::int as place, category, severity, rule, path || ':' || line || ':' || col as location from findings""",
)


def _both(spark, sf_dir):
    """Two scans: all line rules, and one after files of odd length were cleared."""
    _, _, found = _scan(spark, sf_dir)
    found = written(_slim(found))  # read twice
    before = found.where("rule != 'no-full-icon-import'")
    return before, found.where("length(path) % 2 = 0")


_DIFF = f"""{FINDINGS_SQL}, b as (select *, row_number() over (partition by project, path, rule, line order by col, message) as nth from findings where rule <> 'no-full-icon-import'),
  a as (select *, row_number() over (partition by project, path, rule, line order by col, message) as nth from findings where length(path) % 2 = 0)"""
register(
    "gate_diff", lambda s, d: report.gate_diff(*_both(s, d))[0],
    f"""{_DIFF}, c as (select project, count(*) filter (o = 1 and severity = 'error') as errors_before, count(*) filter (o = 1 and severity = 'warning') as warnings_before,
      count(*) filter (o = 2 and severity = 'error') as errors_after, count(*) filter (o = 2 and severity = 'warning') as warnings_after from (select project, severity, 1 as o from b union all select project, severity, 2 from a) group by project)
    select *, errors_after > errors_before as errors_increased, not errors_after > errors_before and (errors_after < errors_before or warnings_after < warnings_before) as improved from c""",
)
register(
    "gate_changes", lambda s, d: report.gate_diff(*_both(s, d))[1],
    f"""{_DIFF} select coalesce(b.project, a.project) as project, coalesce(b.path, a.path) as path, coalesce(b.rule, a.rule) as rule, coalesce(b.line, a.line) as line, coalesce(b.nth, a.nth)::int as nth,
      case when b.project is null then 'new' else 'resolved' end as change from b full join a on b.project = a.project and b.path = a.path and b.rule = a.rule and b.line = a.line and b.nth = a.nth where a.project is null or b.project is null""",
)

register("source_counts", lambda s, d: projects.source_counts(derived_files(s, d)), f"with {FILES_SQL} select project, count(*) as n from files where regexp_matches(path, '\\.(svelte|ts|js)$') group by project")


def _manifests(spark, sf_dir):
    return projects.read_manifests(derived.manifest_files(spark, sf_dir))[0]


def project_profiles(spark, sf_dir):
    files = derived.manifest_files(spark, sf_dir)
    more = files.where(F.regexp_extract("project", r"(\d+)", 1).cast("int") % 2 == 0).select(
        "project", F.explode(F.array(
            F.struct(F.lit("tsconfig.json").alias("path"), F.lit("{}").alias("content")), F.struct(F.lit("svelte.config.js").alias("path"), F.lit("export default { preprocess: [] };").alias("content")),
            F.struct(F.lit("src/a.svelte").alias("path"), F.lit("let a = $state (1);").alias("content")))).alias("f")
    ).select("project", "f.path", "f.content")
    return projects.profiles(files.unionByName(more), _manifests(spark, sf_dir))


_HAS = "coalesce(max(version) filter (name = '{0}' and which < 2), '') <> ''"
register(
    "project_profiles", project_profiles,
    f"""with {derived.MANIFESTS_SQL}, h as (select project, {_HAS.format("@sveltejs/kit")} as kit, {_HAS.format("vite")} as vite, {_HAS.format("@sveltejs/vite-plugin-svelte")} as plugin, {_HAS.format("svelte")} as svelte,
      arg_max(version, which) filter (name = 'svelte') as v from entries group by project), k as (select project, regexp_extract(project, '([0-9]+)', 1)::int as c from manifests)
    select project, 'app' || c as name, case when kit then 'sveltekit' when vite and plugin then 'vite' when svelte then 'vanilla' else 'unknown' end as framework, regexp_replace(v, '^[^0-9]*', '') as framework_version,
      c % 2 = 0 as has_typescript, c % 2 = 0 as has_preprocess, c % 2 = 0 as uses_runes, (case when c % 2 = 0 then 2 else 0 end)::bigint as source_files from k left join h using (project)""",
)
register("manifest_quarantine", lambda s, d: projects.read_manifests(derived.manifest_files(s, d))[1].select("project", "path"), "select 'cust' || c_custkey as project, 'package.json' as path from customer where c_custkey % 50 = 0")


def config_resolve(spark, sf_dir):
    d = projects.resolve_configs(derived.config_rows(spark, sf_dir))
    return d.select("project", "lint", "dead_code", F.array_join("ignore_rules", ",").alias("rules"), F.array_join("ignore_files", ",").alias("files"))


register(
    "config_resolve", config_resolve,
    """select 'cust' || c_custkey as project, case when c_custkey % 4 = 0 then false when c_custkey % 4 = 3 then true end as lint, case when c_custkey % 4 = 0 then true end as dead_code,
      case c_custkey % 4 when 0 then 'no-moment,no-eval' when 1 then '' else 'no-console' end as rules, case c_custkey % 4 when 0 then 'src/lib/*,gen' when 1 then '**/x.ts' else '' end as files
    from customer where c_custkey % 4 in (0, 1) or (c_custkey % 4 = 3 and c_custkey % 3 = 0)""",
)


def phase_options(spark, sf_dir):
    """Which phases run for each project, with the lint option left open and dead code switched on by the caller."""
    d = projects.resolve_configs(derived.config_rows(spark, sf_dir))
    return d.select("project", projects.phase(None, F.col("lint")).alias("lint"), projects.phase(True, F.col("dead_code")).alias("dead_code"))


register(
    "phase_options", phase_options,
    "select 'cust' || c_custkey as project, c_custkey % 4 <> 0 as lint, true as dead_code from customer where c_custkey % 4 in (0, 1) or (c_custkey % 4 = 3 and c_custkey % 3 = 0)",
)


def report_json(spark, sf_dir):
    files, profiles, found = _scan(spark, sf_dir)
    found = written(found)  # read three times
    return report.report_json(found, report.scores(found, profiles), files)


register(
    "report_json", report_json,
    f"""{FINDINGS_SQL}, pen as (select project, sum({_PENALTY})::bigint as penalty from findings group by project),
    sc as (select project, {_SCORE.format("coalesce(penalty, 0)")} as score, case when penalty is null then 'Perfect' else {_LABEL.format(_SCORE.format("penalty"))} end as label from profiles left join pen using (project)),
    n as (select project, count(*) filter (severity = 'error') as errors, count(*) filter (severity = 'warning') as warnings, count(distinct path) as affected from findings group by project),
    f as (select project, path, string_agg(to_json({{'line': line, 'col': col, 'rule': rule, 'severity': severity, 'category': category, 'message': message, 'help': help}})::varchar, ','
      order by line, col, rule, severity, category, message, help) as ds from findings group by project, path),
    t as (select project, count(*) as total from files group by project)
    select project, null::varchar as path, '{{"version":{report.REPORT_VERSION},"score":' || score || ',"label":"' || label || '","totalFiles":' || total || ',"affectedFiles":' || coalesce(affected, 0) || ',"errors":' || coalesce(errors, 0) || ',"warnings":' || coalesce(warnings, 0) || '}}' as report
    from sc join t using (project) left join n using (project)
    union all select project, path, '{{"path":' || to_json(path)::varchar || ',"diagnostics":[' || ds || ']}}' from f""",
)


def _deps(spark, sf_dir):
    return deps.flatten(_manifests(spark, sf_dir))


def _advice(kind: str) -> str:
    return ", ".join(f"({quote(k)}, {quote(v)})" for k, v in deps.TABLES[kind].items())


def _listed_sql(kind: str) -> str:
    return f"select project, name, version, '{kind}' as type, message from deps join (values {_advice(kind)}) a(name, message) using (name)"


_RISKY_SQL = f"select project, name, version, 'risky-version' as type, {quote(deps.PIN)} as message from deps where version in ('*', 'latest')"
_AUDIT_SQL = " union all ".join([_listed_sql("deprecated"), _listed_sql("incompatible"), _RISKY_SQL, _listed_sql("better-alternative")])
register("deps_flat", _deps, f"with {derived.MANIFESTS_SQL} select project, name, version from deps")
register("dep_deprecated", lambda s, d: deps.listed(_deps(s, d), "deprecated"), f"with {derived.MANIFESTS_SQL} {_listed_sql('deprecated')}")
register("dep_incompatible", lambda s, d: deps.listed(_deps(s, d), "incompatible"), f"with {derived.MANIFESTS_SQL} {_listed_sql('incompatible')}")
register("dep_alternative", lambda s, d: deps.listed(_deps(s, d), "better-alternative"), f"with {derived.MANIFESTS_SQL} {_listed_sql('better-alternative')}")
register("dep_risky", lambda s, d: deps.risky(_deps(s, d)), f"with {derived.MANIFESTS_SQL} {_RISKY_SQL}")
register("dep_audit", lambda s, d: deps.audit(_deps(s, d)), f"with {derived.MANIFESTS_SQL} {_AUDIT_SQL}")
register(
    "dep_status", lambda s, d: deps.status(_manifests(s, d)),
    f"""with {derived.MANIFESTS_SQL}, i as ({_AUDIT_SQL}), t as (select project, count(*) as total from deps group by project),
    n as (select project, count(*) filter (type = 'deprecated') as deprecated, count(*) filter (type = 'incompatible') as incompatible, count(*) filter (type = 'risky-version') as risky,
      count(*) filter (type = 'better-alternative') as replaceable, count(*) as issues from i group by project)
    select project, coalesce(total, 0)::bigint as total, coalesce(deprecated, 0)::bigint as deprecated, coalesce(incompatible, 0)::bigint as incompatible, coalesce(risky, 0)::bigint as risky, coalesce(replaceable, 0)::bigint as replaceable,
      coalesce(issues, 0)::bigint as issues, case when coalesce(issues, 0) = 0 then 'Healthy' when issues <= 3 then 'Needs Attention' else 'Unhealthy' end as status from manifests left join t using (project) left join n using (project)""",
)

_H = "project, seq, score, label"
register("history_valid", lambda s, d: trend.read_history(derived.history_json(s, d)).select("project", "seq", "score", "label", "warnings"), f"with {derived.HISTORY_SQL} select {_H}, warnings from history where seq % 11 <> 0 and seq % 13 <> 0")
_LAST = "(select *, row_number() over (partition by project order by ts desc, seq desc) as k from history)"
register("history_cap", lambda s, d: trend.newest(derived.history_rows(s, d), 50).select("project", "seq", "score", "label"), f"with {derived.HISTORY_SQL} select {_H} from {_LAST} where k <= 50")
register("trend_last_n", lambda s, d: trend.last_n(derived.history_rows(s, d)).select("project", "seq", "score", "label"), f"with {derived.HISTORY_SQL} select {_H} from {_LAST} where k <= 20")
register("score_delta", lambda s, d: trend.delta(derived.history_rows(s, d)).select("project", "seq", "score", "delta"), f"with {derived.HISTORY_SQL} select project, seq, score, score - lag(score, 1, 100) over (partition by project order by ts, seq) as delta from history")
register(
    "trend_bins", lambda s, d: trend.bins(derived.history_rows(s, d)),
    f"""with {derived.HISTORY_SQL} select project, seq, threshold::int as threshold, score >= threshold as filled, case when score >= 75 then 'green' when score >= 50 then 'yellow' else 'red' end as band
    from (select *, unnest(range(10, 101, 10)) as threshold from {_LAST} where k <= 20)""",
)
register(
    "trend_summary", lambda s, d: trend.summary(derived.history_rows(s, d)),
    f"""with {derived.HISTORY_SQL}, l as (select * from {_LAST} where k <= 20),
    a as (select project, first(score order by ts, seq) as first, last(score order by ts, seq) as latest, last(label order by ts, seq) as latest_label, max(score) as best, min(score) as worst,
      first(label order by score desc, ts, seq) as best_label, first(label order by score, ts, seq) as worst_label from l group by project),
    w as (select project, count(*) as runs, greatest(1, ceil((epoch_ms(max(ts)) - epoch_ms(min(ts))) / 86400000.0))::bigint as days from history group by project)
    select *, case when latest - first > 2 then 'up' when latest - first < -2 then 'down' else 'stable' end as arrow from a join w using (project)""",
)


def _imports(spark, sf_dir):
    """Modules dealt and written once: edges, exports and the list of files read them."""
    return written(derived.import_files(spark, sf_dir).repartition("project", "path"))


def _graph(spark, sf_dir):
    files = _imports(spark, sf_dir)
    return files, graph.import_edges(files)


def unreachable_files(spark, sf_dir):
    files, edges = _graph(spark, sf_dir)
    entries = files.where(F.regexp_extract("path", r"(\d+)", 1).cast("long") % 50 == 0)
    return graph.unreachable_files(files, edges, entries)


_IMPORTED = "path in (select to_path from edges where from_path <> to_path)"


def _unused_sql(kind: str) -> str:
    names = "'T' || i" if kind == "type" else "unnest(['s' || i, 'default'])"
    return f"select project, path, symbol from (select *, {names} as symbol from fs) x where not exists (select 1 from used u where u.t = x.i and u.symbol in (x.symbol, '*'))"


register("import_edges", lambda s, d: _graph(s, d)[1], f"with recursive {derived.IMPORTS_SQL} select project, from_path, to_path, symbol, exported_as from edges")
register("unused_files", lambda s, d: graph.unused_files(*_graph(s, d)), f"with recursive {derived.IMPORTS_SQL} select project, path from fs where not {_IMPORTED}")
register(
    "unreachable_files", unreachable_files,
    f"""with recursive {derived.IMPORTS_SQL}, r as (select path from fs where i % 50 = 0 union select e.to_path from r join edges e on e.from_path = r.path)
    select project, path from fs where path not in (select path from r)""",
)


def _used(spark, sf_dir):
    files, edges = _graph(spark, sf_dir)
    edges, exported = written(edges), written(graph.exports(files))
    return exported, graph.used_symbols(edges, exported)


for _kind, _name in (("value", "unused_exports"), ("type", "unused_types")):
    register(_name, lambda s, d, k=_kind: graph.unused_exports(*_used(s, d), k), f"with recursive {derived.IMPORTS_SQL} {_unused_sql(_kind)}")
register(
    "used_symbols", lambda s, d: _used(s, d)[1],
    f"with recursive {derived.IMPORTS_SQL} select 'graph' as project, 'src/m' || t || '.ts' as path, symbol from used",
)
register("duplicate_exports", lambda s, d: graph.duplicate_exports(graph.exports(derived.import_files(s, d))), f"with recursive {derived.IMPORTS_SQL} select project, path, 's' || i as symbol, 2::bigint as n from fs where i % 17 = 0")


def _dead_sql(kind: str, rows: str) -> str:
    before, *after = graph.MESSAGES[kind].split("{}")
    message = f"{quote(before)} || symbol" if after else quote(before)
    return f"select project, path, '{kind}' as rule, 'warning' as severity, 'Dead Code' as category, {message} as message from ({rows})"


_DEAD_SQL = " union all ".join(
    [_dead_sql("files", f"select project, path from fs where not {_IMPORTED}"), _dead_sql("exports", _unused_sql("value")), _dead_sql("types", _unused_sql("type")), _dead_sql("duplicates", "select project, path, 's' || i as symbol from fs where i % 17 = 0")]
)
register(
    "dead_code_findings", lambda s, d: graph.dead_code(_imports(s, d)).select("project", "path", "rule", "severity", "category", "message"),
    f"with recursive {derived.IMPORTS_SQL} {_DEAD_SQL}",
)


def issue_records(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select(F.col("source").alias("project"), F.col("lang").alias("w"), F.concat(F.lit("f"), F.col("doc_id")).alias("file"))
    issue = F.struct(F.concat(F.lit("src/"), "file").alias("path"), F.upper("file").alias("symbol"))
    nested = d.where("w is not null").select("project", F.create_map("w", F.create_map("file", issue)).alias("records"))
    return graph.flatten_issues(nested, "exports")


register("issue_records", issue_records, "select source as project, lang as workspace, 'src/f' || doc_id as path, 'F' || doc_id as symbol, 'exports' as rule from documents")


def duplicate_documents(spark, sf_dir):
    d = table(spark, sf_dir, "documents").groupBy(F.xxhash64("text").alias("h"), F.md5("text").alias("m")).agg(F.count("*").alias("n"), F.min("doc_id").alias("first"))
    return d.where("n > 1").select("first", "n")


register("duplicate_documents", duplicate_documents, "select min(doc_id) as first, count(*) as n from documents group by text having count(*) > 1")


def meaningful_lines(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", F.explode(F.split("text", "\n", -1)).alias("text"))
    return d.groupBy("doc_id").agg(F.count_if(rules.meaningful(F.col("text"))).alias("n"))


_T = sql_trim("l")
register(
    "meaningful_lines", meaningful_lines,
    f"""select doc_id, count(*) filter ({_T} <> '' and not starts_with({_T}, '//') and not starts_with({_T}, '*') and not starts_with({_T}, '/*') and {_T} <> '-->' and not starts_with({_T}, '<!--')) as n
    from (select doc_id, unnest(string_split(text, chr(10))) as l from documents) group by doc_id""",
)


def scrub_text(spark, sf_dir):
    from lintlake.functions.scrub import scrub, strip_ansi

    raw = F.concat(F.coalesce("text", F.lit("")), F.lit("\x07\x1b[31m!"))
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(scrub(raw)).alias("scrubbed"), F.md5(strip_ansi(raw)).alias("stripped"))


_RAW = "coalesce(text, '') || chr(7) || chr(27) || '[31m!'"
register("scrub_text", scrub_text, f"select doc_id, md5(regexp_replace({_RAW}, '[\\x00-\\x08\\x0B\\x0C\\x0E-\\x1F\\x7F]', '', 'g')) as scrubbed, md5(regexp_replace({_RAW}, '\\x1b\\[[0-9;]*m', '', 'g')) as stripped from documents")


def page_links(spark, sf_dir):
    d = table(spark, sf_dir, "pages")
    return d.select("page_id", F.regexp_count("html", F.lit(r"<a\b")).cast("long").alias("links"), F.regexp_count("html", F.lit(r"<a\b[^>]*>\s*</a>")).cast("long").alias("empty"))


register("page_links", page_links, "select page_id, len(regexp_extract_all(html, '<a\\b'))::bigint as links, len(regexp_extract_all(html, '<a\\b[^>]*>\\s*</a>'))::bigint as empty from pages")

_ROLE = """case when role = 'system' then 'start' when role = 'assistant' then 'text' else 'tool' end"""
_LOG = f"""select conv_id::varchar as session, turn::bigint as seq, {_ROLE} as kind, case when role = 'assistant' then {sql_trim("text")} end as text,
  case when role not in ('system', 'assistant') then case when turn % 2 = 0 then 'grep' else 'Reading' end end as tool,
  case when role not in ('system', 'assistant') then case when turn % 2 = 0 then 'lib/c' || conv_id || '.ts' else 'b/r' || turn || '.ts' end end as file
  from conversations where (conv_id * 3 + turn) % 10 <> 0 and (role <> 'assistant' or {sql_trim("text")} <> '')"""
register("agent_log_events", lambda s, d: agentlog.events(derived.agent_lines(s, d)), _LOG)
register("agent_log_counts", lambda s, d: agentlog.events(derived.agent_lines(s, d)).groupBy("session", "kind").agg(F.count("*").alias("n")), f"select session, kind, count(*) as n from ({_LOG}) group by session, kind")


def all_findings(spark, sf_dir):
    """Findings of rules and of unused code together, as a scan gives them; equal ones stay."""
    _, _, found = _scan(spark, sf_dir)
    return _slim(found.unionByName(graph.dead_code(_imports(spark, sf_dir))))


register(
    "all_findings", all_findings,
    f"""{FINDINGS_SQL} select {_F} from findings union all select project, path, rule, severity, category, 0, 0, message from (
    with recursive {derived.IMPORTS_SQL} {_DEAD_SQL})""",
)


def user_rule(spark, sf_dir):
    """Scores by a rule of a user's own: a condition on a line, and a place in it."""
    rule = api.UserRule("long-line", "Architecture", "warning", "Line is longer than 200 characters.", (F.length("text") > 200, F.lit(201)), weight=0.5)
    files = derived_files(spark, sf_dir)
    profiles = derived_profiles(files)
    return report.scores(api.user_findings([rule], with_regions(explode_lines(files)), profiles), profiles)


_WEIGHTED = "case when n is null then 0 else 4.0::double * n end"
register(
    "user_rule", user_rule,
    f"""{BASE_SQL}, u as (select project, count(*) as n from lines where length(text) > 200 group by project)
    select project, floor({_WEIGHTED})::bigint as penalty, {_SCORE.format(f"({_WEIGHTED})")} as score, case when n is null then 'Perfect' else {_LABEL.format(_SCORE.format(f"({_WEIGHTED})"))} end as label from profiles left join u using (project)""",
)


def diagnose(spark, sf_dir):
    """A whole diagnosis, manifests included, of the derived corpus."""
    files = derived_files(spark, sf_dir)
    k = F.regexp_extract("project", r"(\d+)$", 1).cast("int")
    manifest = F.concat(F.lit('{"name":"'), "project", F.lit('","dependencies":{"@sveltejs/kit":"^2.0.0"'), F.when(k != 19, F.lit(',"svelte":"^5.1.0"')).otherwise(F.lit("")), F.lit("}}"))
    manifests = files.select("project").distinct().select("project", F.lit("package.json").alias("path"), manifest.alias("content"))
    return _slim(api.diagnose(files.unionByName(manifests)).findings)


def _any_of(column: str, patterns) -> str:
    return "(" + " or ".join(f"regexp_matches({column}, {quote(p)})" for p in patterns) + ")"


#: The manifests' projects: with a version, of one framework, without a type config; runes as the files have them.
_DIAGNOSED = f"""
profiles as (select project, 'sveltekit' as framework, '5.1.0' as framework_version, false as has_typescript, bool_or(ends_with(path, '.svelte') and regexp_matches(content, {quote(re2(projects.RUNES))})) as uses_runes
  from files where regexp_extract(project, '([0-9]+)$', 1) <> '19' group by project)"""
_EXPORTED = r"(?m)(?:^|[;}>])[ \t]*export\s+(?:declare\s+)?(?:abstract\s+)?(?:async\s+)?(?:const|let|var|function\s*\*?|class|enum|namespace)\s+([\w$]+)"
_DEAD_OF_FILES = " union all ".join([
    _dead_sql("files", "select project, path from known_files where not entry"), _dead_sql("exports", "select distinct project, path, symbol from exported where not entry"), _dead_sql("duplicates", "select project, path, symbol from exported group by project, path, symbol having count(*) > 1"),
])
# no module of the derived corpus imports another; only script files export, and only values
register(
    "diagnose", diagnose,
    f"""{FINDINGS_SQL.replace(PROFILES_SQL, _DIAGNOSED)},
  known_files as (select project, path, content, {_any_of("path", graph.ENTRIES)} as entry from files join (select project from profiles) using (project)),
  code as (select project, path, entry, array_to_string(list_filter(string_split(content, chr(10)), lambda t: not regexp_matches(ltrim(t), '^(//|/?[*])')), chr(10)) as code from known_files where not ends_with(path, '.svelte')),
  exported as (select project, path, entry, unnest(regexp_extract_all(code, {quote(_EXPORTED)}, 1)) as symbol from code)
  select {_F} from findings union all select project, path, rule, severity, category, 0, 0, message from ({_DEAD_OF_FILES})""",
)
