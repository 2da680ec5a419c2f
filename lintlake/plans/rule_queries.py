"""One query for each rule of the catalog over the derived corpus, with the oracle's SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lintlake.functions.text import quote, re2, sql_count_of, sql_group, sql_matches, sql_position, sql_trim
from lintlake.operators import rules as R
from lintlake.operators.catalog import BY_NAME, RULES, Rule
from lintlake.operators.lines import LINES_SQL
from lintlake.plans.registry import register
from lintlake.sources.corpus import FILES_SQL, PROFILES_SQL, derived_files, derived_profiles
from lintlake.sources.shared import written
from lintlake.sources.tables import table

_REGIONS = {"": "true", "script": "in_script = 1", "instance": "in_instance = 1", "template": "in_script = 0", "outer": "in_instance = 0", "markup": "in_script = 0 and in_style = 0", "style": "in_style = 1"}
BASE_SQL = f"with {FILES_SQL}, {PROFILES_SQL}, {LINES_SQL}, l as (select * from lines join profiles using (project))"
_INSIDE = "({0} % 2 <> 0 or {1} % 2 <> 0 or {2} % 2 <> 0)"


def _inside(position: str) -> str:
    left = f"substr(text, 1, {position} - 1)"
    return _INSIDE.format(*[sql_count_of(left, q) for q in "'\"`"])


def _select(rule: str, source: str, where: str, line: str = "line", col: str = "1", message: str | None = None) -> str:
    message = quote(BY_NAME[rule].message) if message is None else message
    return f"select project, path, {quote(rule)} as rule, ({line})::int as line, ({col})::int as col, {message} as message from {source} where {where}"


def _filled(rule: str, value: str) -> str:
    a, b = BY_NAME[rule].message.split("{}")
    return f"{quote(a)} || {value} || {quote(b)}"


def line_sql(r: Rule) -> str:
    tests = []
    if r.runes:
        tests.append("uses_runes")
    if r.kit:
        tests.append("framework = 'sveltekit'")
    if r.typescript:
        tests.append("has_typescript")
    if r.component:
        tests.append("ends_with(path, '.svelte')")
    tests += [sql_matches("path", p) for p in r.path_need] + [f"not {sql_matches('path', p)}" for p in r.path_forbid]
    tests.append(_REGIONS[r.region])
    if not r.comments:
        tests.append("not is_comment")
    tests += [sql_matches("text", p) for p in r.need] + [f"not {sql_matches('text', p)}" for p in r.forbid]
    col = "1" if not r.column else f"instr(text, {quote(r.column[1:])})" if r.column[0] == "=" else sql_position("text", r.column)
    if not r.in_string:
        tests.append(f"not {_inside(col)}")
    message = _filled(r.name, sql_group("text", r.group)) if r.group else None
    return _select(r.name, "l", " and ".join(tests), col=col, message=message)


def _or(text: str, patterns) -> str:
    return "(" + " or ".join(sql_matches(text, p) for p in patterns) + ")"


_SV = "ends_with(path, '.svelte')"
_ELEMENT = """(select *, case
    when d1 <= 0 or a1 is null then text when d2 <= 0 or a2 is null then text || ' ' || a1
    when d3 <= 0 or a3 is null then text || ' ' || a1 || ' ' || a2 when d4 <= 0 or a4 is null then text || ' ' || a1 || ' ' || a2 || ' ' || a3
    else text || ' ' || a1 || ' ' || a2 || ' ' || a3 || ' ' || a4 end as element
  from (select *, o as d1, o + o1 as d2, o + o1 + o2 as d3, o + o1 + o2 + o3 as d4 from (
    select *, lead(text, 1) over w as a1, lead(text, 2) over w as a2, lead(text, 3) over w as a3, lead(text, 4) over w as a4,
      lead(o, 1) over w as o1, lead(o, 2) over w as o2, lead(o, 3) over w as o3
    from (select *, length(text) - length(replace(text, '<', '')) - (length(text) - length(replace(text, '>', ''))) as o from l)
    window w as (partition by project, path order by line))))"""


def _secret_position() -> str:
    return "coalesce(" + ", ".join(f"case when {sql_matches('text', p)} then {sql_position('text', p)} end" for p in R.SECRETS) + ")"


def special_sql() -> dict[str, str]:
    out: dict[str, str] = {}
    where = _secret_position()
    out["no-secrets"] = _select("no-secrets", "l", f"not is_comment and not {_or('path', R.SECRET_PATHS)} and {where} is not null", col=where)
    out["img-missing-alt"] = _select("img-missing-alt", _ELEMENT, f"{_SV} and in_script = 0 and {sql_matches('text', '<img' + chr(92) + 'b')} and not {_or('element', R.ALT)}", col=sql_position("text", r"<img\b"))
    out["click-needs-keyboard"] = _select(
        "click-needs-keyboard", _ELEMENT,
        f"{_SV} and in_script = 0 and {sql_matches('text', R.BOXES)} and {_or('element', R.CLICK)} and not ({_or('element', R.KEYS)} and {sql_matches('element', R.ROLE)})",
        col=sql_position("text", R.BOXES),
    )
    label = "not (contains(text, 'aria-label') or contains(text, 'aria-describedby'))"
    out["anchor-no-content"] = " union all ".join(_select("anchor-no-content", "l", f"{_SV} and in_script = 0 and {label} and {sql_matches('text', p)}", col=sql_position("text", p)) for p in R.ANCHORS)
    target = sql_group("text", R.BARREL_IMPORT)
    out["no-barrel-import"] = _select("no-barrel-import", "l", f"not is_comment and {sql_matches('text', R.BARREL_IMPORT)} and not {sql_matches(target, chr(92) + '.' + chr(92) + 'w+$')} and {sql_matches(target, R.BARREL_PATH)}", col=sql_position("text", R.BARREL_IMPORT))
    start = re2(r"\bimport\s*\{")
    out["no-public-env-secrets"] = _select(
        "no-public-env-secrets",
        f"""(select a.project, a.path, coalesce(max(b.line) filter (regexp_matches(b.text, {quote(start)})), a.line) as line, a.line as at from l a join l b
          on a.project = b.project and a.path = b.path and b.line between a.line - 10 and a.line
          where a.framework = 'sveltekit' and {sql_matches("a.text", R.PUBLIC_ENV)} group by a.project, a.path, a.line) s""",
        f"exists (select 1 from lines c where c.project = s.project and c.path = s.path and c.line between s.line and s.at and {sql_matches('c.text', R.SENSITIVE)})",
    )
    t = sql_trim("text")
    meaningful = f"{t} <> '' and not starts_with({t}, '//') and not starts_with({t}, '*') and not starts_with({t}, '/*') and {t} <> '-->' and not starts_with({t}, '<!--')"
    out["no-giant-component"] = _select("no-giant-component", f"(select project, path, count(*) as n from l where {_SV} and {meaningful} group by project, path)", "n > 300", line="1", message=_filled("no-giant-component", "n"))
    n = lambda p: f"case when in_script = 0 and in_style = 0 and not style_marker then len(regexp_extract_all(text, {quote(re2(p))})) else 0 end"
    out["no-deep-nesting"] = _select(
        "no-deep-nesting",
        f"""(select project, path, line, unnest(range(greatest(4, depth - opens + 1)::bigint, depth::bigint + 1)) as deep from (
          select *, b - least(0, min(b) over w) + opens as depth from (
            select project, path, line, opens, sum(opens - closes) over w - opens as b from (
              select project, path, line, {n(R.BLOCK_OPEN)} as opens, {n(R.BLOCK_CLOSE)} as closes from l where {_SV})
            window w as (partition by project, path order by line rows between unbounded preceding and current row))
          window w as (partition by project, path order by line rows between unbounded preceding and current row)) where opens > 0 and depth > 3)""",
        "true", message=_filled("no-deep-nesting", "deep"),
    )
    out["no-multi-script"] = _select(
        "no-multi-script",
        f"""(select project, path, line, row_number() over (partition by project, path order by line) as k, count(*) over (partition by project, path) as n
          from l where {_SV} and {sql_matches("ts", R.SCRIPT)} and not {sql_matches("ts", R.MODULE_SCRIPT)})""",
        "k > 1", message=_filled("no-multi-script", "n"),
    )
    out["form-action-no-validation"] = _select(
        "form-action-no-validation",
        f"""(select project, path, min(line) filter (contains(text, 'formData')) as line, arg_min(instr(text, 'formData'), line) filter (contains(text, 'formData')) as col,
          bool_or({sql_matches("text", R.VALIDATION)}) as checked from l where {sql_matches("path", R.SERVER_PATH)} group by project, path)""",
        "line is not null and not checked", col="col",
    )
    out["missing-error-page"] = _select(
        "missing-error-page", "(select project, path from files join profiles using (project) where framework = 'sveltekit') f",
        f"{sql_matches('path', R.ROOT_LAYOUT)} and not exists (select 1 from files e where e.project = f.project and e.path = {quote(R.ERROR_PAGE)})", line="1",
    )
    p = lambda after, before=r"\b": f"{quote(before)} || name || {quote(re2(after))}"
    used = [
        f"len(regexp_extract_all(body, {p(chr(92) + 's*=[^=]')})) > 1",
        *[f"regexp_matches(body, {x})" for x in (
            p(r"\s*(?:\+|-|\*|\/|%|\*\*|&|\||\^|<<|>>|>>>)="), p(r"\s*(?:\+\+|--)"), p(r"\b", r"(?:\.\+\+|--)"),
            p(r"\s*\.\s*(?:push|pop|splice|shift|unshift|sort|reverse|fill|set|delete|clear|add)\s*\("), p(r"\s*(?:\.[\w.]+|\[[^\]]+\])\s*=[^=]"))],
    ]
    out["no-unnecessary-state"] = _select(
        "no-unnecessary-state",
        f"""(select a.project, a.path, a.line, {sql_group("a.text", R.STATE)} as name, {sql_position("a.text", R.STATE)} as col, body from l a join (
          select project, path, string_agg(text, chr(10) order by line) as body from l where not is_comment group by project, path) b using (project, path)
          where {_SV} and not is_comment and {sql_matches("a.text", R.STATE)})""",
        f"not ({' or '.join(used)})", col="col", message=_filled("no-unnecessary-state", "name"),
    )
    return out


def _spans_sql(opener: str, part: str, where: str = "true") -> str:
    """Calls with their place and what stands in their parentheses: running sums over the files' parentheses."""
    tail = quote(f"({re2(opener)})$")
    return f"""sf as (select project, path, string_split(content, '') as cs, length(content) as n from files join profiles using (project) where contains(content, {quote(part)}) and {where}),
  ch as (select project, path, cs, n, generate_subscripts(cs, 1) as pos, unnest(cs) as c from sf),
  pa as (select *, sum(case c when '(' then 1 else -1 end) over (partition by project, path order by pos) as s from ch where c in ('(', ')')),
  op as (select *, pos - length(regexp_extract(array_to_string(cs[greatest(1, pos - 30):pos - 1], ''), {tail}, 1)) as start from pa
    where c = '(' and regexp_matches(array_to_string(cs[greatest(1, pos - 30):pos - 1], ''), {tail})),
  en as (select op.project, op.path, op.pos, min(pa.pos) as till from op join pa on pa.project = op.project and pa.path = op.path and pa.pos > op.pos and pa.s = op.s - 1 group by all),
  sp as (select project, path, array_to_string(cs[pos + 1:coalesce(till, n) - 1], '') as block, array_to_string(cs[1:start - 1], '') as before from op left join en using (project, path, pos)),
  spans as (select project, path, block, length(before) - length(replace(before, chr(10), '')) + 1 as line, length(before) + 1 - (case when contains(before, chr(10)) then length(before) - instr(reverse(before), chr(10)) + 1 else 0 end) as col from sp)"""


def span_queries() -> dict[str, str]:
    """Whole queries: they need no lines."""
    base = f"with {FILES_SQL}, {PROFILES_SQL}, "
    body = sql_trim("block")
    arrow = re2(r"^\(\s*\)\s*=>")
    inner = sql_trim(f"regexp_replace(body, {quote(arrow)}, '')")
    right = f"regexp_replace(stmt, {quote(re2(r'^' + chr(92) + 'w+' + chr(92) + 's*=' + chr(92) + 's*'))}, '')"
    effects = _or(right, (r"\bconsole\.\w+\s*\(", *R.SIDE_EFFECTS[1:]))
    effect = f"""{base}{_spans_sql(r"\$effect\s*", "$effect", "ends_with(path, '.svelte')")},
  b1 as (select *, {body} as body from spans), b2 as (select *, {inner} as inside from b1 where regexp_matches(body, {quote(arrow)})),
  b3 as (select *, case when starts_with(inside, '{{') and ends_with(inside, '}}') then {sql_trim("substr(inside, 2, greatest(length(inside) - 2, 0))")} else inside end as raw from b2),
  b4 as (select *, {sql_trim(f"regexp_replace(raw, {quote(re2(';' + chr(92) + 's*$'))}, '')")} as stmt from b3)
  {_select("no-effect-for-derived", "b4", f"{sql_matches('stmt', '^' + chr(92) + 'w+' + chr(92) + 's*=[^=]')} and not {effects} and not contains(stmt, ';')", col="col")}"""
    derived = f"""{base}{_spans_sql(r"\$derived(?:\.by)?\s*", "$derived")} {_select("no-derived-side-effect", "spans", _or("block", R.SIDE_EFFECTS), col="col")}"""
    return {"no-effect-for-derived": effect, "no-derived-side-effect": derived}


def fetch_query() -> str:
    """Brace depth and handler flag line after line, by recursion."""
    handler = _or("text", R.HANDLER)
    return f"""{BASE_SQL.replace("with ", "with recursive ", 1)},
  s0 as (select project, path, line, is_comment, {handler} as handler, case when {sql_matches("text", R.FETCH)} then instr(text, 'fetch') else 0 end as call_at, regexp_replace(text, '[^{{}}]', '', 'g') as b
    from l where framework = 'sveltekit' and {_SV} and in_script = 1 and not {sql_matches("path", chr(92) + "+(page|layout)" + chr(92) + ".server")}),
  s1 as (select *, row_number() over w as k, coalesce(line - lag(line) over w, 9) > 1 as fresh, length(b) - 2 * length(replace(b, '{{', '')) as net,
    coalesce(list_min(list_transform(range(1, length(b) + 1), lambda i: case when b[i] = '}}' then i - 2 * length(replace(b[1:i], '{{', '')) end)), 1 << 20) as low
    from s0 window w as (partition by project, path order by line)),
  st(project, path, k, line, depth, lit, hd, hit) as (
    select project, path, 0::bigint, 0, 0::bigint, false, 0::bigint, 0::bigint from (select distinct project, path from s1)
    union all
    select project, path, k, line, case when is_comment then d else d + net end, case when is_comment then o when handler then true else o and d + low > h end,
      case when is_comment then h when handler then d + net else h end, case when is_comment or handler or (o and d + low > h) then 0 else call_at end
    from (select s1.*, case when fresh then 0 else st.depth end as d, case when fresh then false else st.lit end as o, case when fresh then 0 else st.hd end as h
      from st join s1 on s1.project = st.project and s1.path = st.path and s1.k = st.k + 1))
  {_select("no-client-fetch", "st", "hit > 0", col="hit")}"""


def rule_query(name: str):
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        files = written(derived_files(spark, sf_dir))  # rules on whole files read it once more
        return R.evaluate(files, written(derived_profiles(files)), [name])

    return query


def rule_sql() -> dict[str, str]:
    """The oracle's select for each rule over BASE_SQL; span_queries() and fetch_query() have the other three."""
    return {r.name: line_sql(r) for r in RULES if r.line} | special_sql()


WHOLE_SQL = span_queries() | {"no-client-fetch": fetch_query()} | {name: f"{BASE_SQL} {sql}" for name, sql in rule_sql().items()}
for _rule in RULES:
    register("rule_" + _rule.name.replace("-", "_"), rule_query(_rule.name), WHOLE_SQL[_rule.name])


def secrets_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.documents_secrets(table(spark, sf_dir, "documents"))


register(
    "secrets_documents", secrets_documents,
    f"""with l as (select doc_id, generate_subscripts(string_split(text, chr(10)), 1)::int as line, unnest(string_split(text, chr(10))) as text from documents where text is not null),
    t as (select *, regexp_replace(text, '^[ \t\r\x0b\x0c]+', '') as ts from l)
    select doc_id, line, ({_secret_position()})::int as col from t where not (starts_with(ts, '//') or starts_with(ts, '*')
      or starts_with(ts, '/*')) and {_secret_position()} is not null""",
)


def lines_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lintlake.operators.lines import explode_lines

    return explode_lines(derived_files(spark, sf_dir)).select("project", "path", "line", "text")


def regions_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lintlake.operators.lines import explode_lines, with_regions

    return with_regions(explode_lines(derived_files(spark, sf_dir))).select("project", "path", "line", "in_script", "in_instance", "in_style", "is_comment")


register("lines", lines_query, f"with {FILES_SQL}, {LINES_SQL} select project, path, line, text from lines0")
register("region_lines", regions_query, f"with {FILES_SQL}, {LINES_SQL} select project, path, line, in_script::int as in_script, in_instance::int as in_instance, in_style::int as in_style, is_comment from lines")
