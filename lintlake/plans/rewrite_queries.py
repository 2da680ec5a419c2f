"""Queries on the rewrite of the derived corpus, with the oracle's SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lintlake.functions.text import quote, re2, sql_count_of, sql_group, sql_matches, sql_trim
from lintlake.operators import rewrite as W
from lintlake.plans.registry import register
from lintlake.sources.corpus import FILES_SQL, derived_files
from lintlake.operators.lines import LINES_SQL

_BASE = f"with {FILES_SQL}, {LINES_SQL}"
_TEMPLATE = "in_script = 0 and in_style = 0 and not style_marker"


def _pass(name: str):
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        d = W.PASSES[name](W.lines_of(derived_files(spark, sf_dir)))
        return d.where("hit").select("project", "path", "line", "sub", "text")

    return query


def _replace(text: str, pattern: str, by: str) -> str:
    return f"regexp_replace({text}, {quote(re2(pattern))}, {quote(by)}, 'g')"


def _lines(new: str, where: str, source: str = "lines") -> str:
    return f"{_BASE}, n as (select project, path, line, text, {new} as new from {source} where {where}) select project, path, line, 0 as sub, new as text from n where new <> text"


def _b5() -> str:
    told, out = W.MODIFIERS.format("\\2"), "text"
    for _ in range(2):
        out = _replace(out, r"\son:(\w+)(\|[a-zA-Z|]+)([>\s/])", f" on\\1{told}\\3")
    for _ in range(2):
        out = _replace(out, r"\son:(\w+)([>\s/])", " on\\1\\2")
    return out


def _b6() -> str:
    return _replace(_replace("text", r"\son:(\w+)(\|[a-zA-Z|]+)=", f" on\\1={W.MODIFIERS.format(chr(92) + '2')}"), r"\son:(\w+)=", " on\\1=")


def _b7() -> str:
    named = "text"
    for p in W.NAMED_SLOTS:
        named = _replace(named, p, "{@render \\1?.()}")
    named = f"case when {named} <> text then replace({named}, '</slot>', '') else text end"
    closed = _replace(_replace(f"({named})", r"<slot\s*\/>", W.CHILDREN), r"<slot\s*>\s*<\/slot>", W.CHILDREN)
    opened = _replace("text", r"<slot\s*>", W.CHILDREN)
    return f"case when {closed} <> text then {closed} when {opened} <> text then replace({opened}, '</slot>', '') else replace(text, '</slot>', '') end"


def _b8() -> str:
    left = _replace("text", W.LET, "")
    names = f"regexp_extract_all(text, {quote(re2(W.LET))}, 1)"
    note = f"({quote(W.LET_TODO[0])} || array_to_string({names}, {quote(W.LET_TODO[1])}) || {quote(W.LET_TODO[2])})"
    behind = f"(length({left}) - instr(reverse({left}), '>') + 1)"
    return f"case when len({names}) = 0 then text when contains({left}, '>') then substr({left}, 1, {behind}) || {note} || substr({left}, {behind} + 1) else {left} || {note} end"


def _b3() -> str:
    imported, only = sql_matches("text", W.DISPATCHER_IMPORT), sql_matches("text", W.DISPATCHER_ONLY)
    fewer = f"case when {imported} then regexp_replace(text, {quote(re2(r'^(.*?)(?:,?\s*createEventDispatcher\s*,?)'))}, '\\1') else text end"
    return f"case when {imported} and {only} then {quote(W.DISPATCHER_TODO)} when {sql_matches(f'({fewer})', W.DISPATCHER_CONST)} then {quote(W.DISPATCH_TODO)} else {fewer} end"


_DEFAULT = sql_trim(sql_group("text", W.PROP, 2))
_B1 = f"""{_BASE}, p as (select project, path, line, {sql_group("text", W.PROP)} || case when {_DEFAULT} <> '' then ' = ' || {_DEFAULT} else '' end as part
    from lines where in_script = 1 and {sql_matches("text", W.PROP)})
  select project, path, min(line)::int as line, 0 as sub, '  let {{ ' || string_agg(part, ', ' order by line) || ' }} = $props();' as text from p group by project, path"""

_OLD = " or ".join(f"x = '{f}' or starts_with(x, '{f} as')" for f in W.LIFECYCLE)
_NAMES = f"list_transform(string_split({sql_group('text', W.SVELTE_IMPORT)}, ','), lambda x: {sql_trim('x')})"
_B4 = f"""{_BASE}, i as (select project, path, line, {_NAMES} as names from lines where {sql_matches("text", W.SVELTE_IMPORT)}),
  j as (select project, path, line, list_filter(names, lambda x: {_OLD}) as old, list_filter(names, lambda x: not ({_OLD})) as rest from i)
  select project, path, line, 0 as sub, case when len(rest) = 0 then '// TODO: ' || array_to_string(old, ', ') || ' removed. Use $effect() instead.' else 'import {{ ' || array_to_string(rest, ', ') || ' }} from ''svelte'';' end as text
    from j where len(old) > 0
  union all select project, path, line, 1, '  // TODO: ' || array_to_string(old, ', ') || ' removed. Use $effect() instead.' from j where len(old) > 0 and len(rest) > 0"""


def _b2(head: str = _BASE, source: str = "lines", tail: str = "") -> str:
    net = f"({sql_count_of('text', '{')} - {sql_count_of('text', '}')})"
    st, indent = sql_group("c", W.REACTIVE, 2), sql_group("c", W.REACTIVE, 1)
    derive = lambda p: f"{indent} || case when list_contains(declared, {sql_group('st', p)}) then '' else 'const ' end || {sql_group('st', p)} || ' = $derived(' || {sql_group('st', p, 2)} || ');'"
    end = _replace("start", r"\}\s*$", "});")
    return f"""{head}, a as (select *, {net}::int as net from {source}),
  b as (select *, sum(net) over (partition by project, path order by line rows between unbounded preceding and current row) as total,
    case when in_script = 1 and {sql_matches("text", W.REACTIVE)} then {sql_group("text", W.REACTIVE, 2)} end as statement from a),
  o as (select project, path, line, total - net as level from b where starts_with({sql_trim("statement")}, '{{') and net <> 0),
  e as (select o.project, o.path, o.line, b.line as till from o asof join b on b.project = o.project and b.path = o.path and b.total = o.level and b.line > o.line),
  dl as (select project, path, list(distinct {sql_group("text", W.DECLARED)}) as declared from a where {sql_matches("text", W.DECLARED)} group by project, path),
  f as (select b.*, eo.line is not null as opens, ec.line is not null as closes from b left join (select distinct project, path, line from e) eo using (project, path, line)
    left join (select distinct project, path, till as line from e) ec using (project, path, line)),
  g as (select *, case when closes then {_replace("text", r"\}\s*$", "});")} else text end as c from f),
  h as (select *, {st} as st, {indent} as ind from g where closes or (in_script = 1 and {sql_matches("c", W.REACTIVE)})),
  i as (select *, {sql_trim("st")} as t, ind || '$effect(() => ' || st as start, in_script = 1 and {sql_matches("c", W.REACTIVE)} as again from h),
  k as (select i.*, dl.declared, {sql_matches("t", r"^\w+[\w.]*\s*\(")} or starts_with(t, 'if ') or {sql_matches("t", r"\bawait\b")} as eff from i left join dl using (project, path)){"," if tail else ""}
  {"b2done as (" if tail else ""}select project, path, line, 0 as sub, case when not again then c when starts_with(t, '{{') and net = 0 then {end} when starts_with(t, '{{') and opens then start
    when not {sql_matches("t", r"\bawait\b")} and {sql_matches("t", r"^\w+\s*=\s*.+")} and not eff and {sql_matches("st", W.ASSIGN)} then {derive(W.ASSIGN)}
    when not {sql_matches("t", r"\bawait\b")} and {sql_matches("t", r"^\w+\s*=\s*.+")} and not eff and {sql_matches("st", W.ASSIGN_OPEN)} then {derive(W.ASSIGN_OPEN)}
    when eff then ind || '$effect(() => {{ ' || st || case when ends_with(st, ';') then '' else ';' end || ' }});'
    else ind || '$effect(() => {{ ' || st || ' }});' end as text from k{tail}"""


_SQL = {
    "b1": _B1, "b2": _b2(), "b3": _lines(_b3(), "true"), "b4": _B4,
    "b5": _lines(_b5(), _TEMPLATE), "b6": _lines(_b6(), _TEMPLATE), "b7": _lines(_b7(), _TEMPLATE), "b8": _lines(_b8(), _TEMPLATE),
}
for _name in W.PASSES:
    register(f"rewrite_{_name}", _pass(_name), _SQL[_name])


def _regions(source: str) -> str:
    """``source`` (project, path, line, sub, text) with in_script, in_style and style_marker."""
    t = sql_trim("text")
    mark = lambda n: f"case when regexp_matches({t}, {quote(re2('^<' + n + '[' + chr(92) + 's>]'))}) then 1 when {t} = '</{n}>' then 0 end"
    return f"""(select project, path, line, sub, text, y is not null as style_marker, case when s is not null then 0 else coalesce(last_value(s ignore nulls) over w, 0) end as in_script,
      case when y is not null then 0 else coalesce(last_value(y ignore nulls) over w, 0) end as in_style
    from (select *, {mark("script")} as s, {mark("style")} as y from {source}) window w as (partition by project, path order by line, sub rows between unbounded preceding and current row))"""


def _corpus_sql() -> str:
    prop = f"in_script = 1 and {sql_matches('text', W.PROP)}"
    one = f"""{_BASE}, c0 as {_regions("(select project, path, line, 0 as sub, text from lines0)")},
  pr as (select project, path, min(line) as first, string_agg({sql_group("text", W.PROP)} || case when {_DEFAULT} <> '' then ' = ' || {_DEFAULT} else '' end, ', ' order by line) as parts from c0 where {prop} group by project, path),
  c1 as (select c0.* replace (case when {prop} then '  let {{ ' || parts || ' }} = $props();' else text end as text) from c0 left join pr using (project, path) where not ({prop}) or line = first)"""
    two = _b2(one, "c1", "),\n  c2 as (select c1.* replace (coalesce(d.text, c1.text) as text), d.text is not null as b2 from c1 left join b2done d using (project, path, line))")
    three = f"c3 as (select * replace ({_b3()} as text), {_b3()} <> text as b3 from c2)"
    names = f"case when {sql_matches('text', W.SVELTE_IMPORT)} then {_NAMES} end"
    four = f"""n4 as (select *, list_filter(names, lambda x: {_OLD}) as old, list_filter(names, lambda x: not ({_OLD})) as rest from (select *, {names} as names from c3)),
  c4 as (select project, path, line, 0 as sub, b2, b3, coalesce(len(old) > 0, false) as b4, case when coalesce(len(old), 0) = 0 then text when len(rest) = 0 then '// TODO: ' || array_to_string(old, ', ') || ' removed. Use $effect() instead.'
      else 'import {{ ' || array_to_string(rest, ', ') || ' }} from ''svelte'';' end as text from n4
    union all select project, path, line, 1, b2, b3, true, '  // TODO: ' || array_to_string(old, ', ') || ' removed. Use $effect() instead.' from n4 where len(old) > 0 and len(rest) > 0),
  r4 as (select r.*, c4.b2, c4.b3, c4.b4 from {_regions("(select project, path, line, sub, text from c4)")} r join c4 using (project, path, line, sub))"""
    last, flags = "r4", []
    steps = []
    for name, text in (("b5", _b5()), ("b6", _b6()), ("b7", _b7()), ("b8", _b8())):
        new = f"case when {_TEMPLATE} then {text} else text end"
        steps.append(f"{name}t as (select * replace (new as text), new <> text as {name} from (select *, {new} as new from {last}))".replace("select * replace (new as text), ", "select * exclude (new) replace (new as text), "))
        last = f"{name}t"
        flags.append(name)
    listed = ", ".join(f"case when bool_or({f}) then {quote(dict(W.CHANGES)[k])} end" for k, f in (("b2", "b2"), ("b3", "b3"), ("b4", "b4"), ("b5", "b5 or b6"), ("b7", "b7"), ("b8", "b8")))
    return f"""{two}, {three}, {four}, {", ".join(steps)},
  whole as (select project, path, string_agg(text, chr(10) order by line, sub) as content, concat_ws('; ', {listed}) as told from {last} group by project, path),
  done as (select whole.project, whole.path, content, case when pr.first is null then told when told = '' then {quote(W.CHANGES[0][1])} else {quote(W.CHANGES[0][1] + "; ")} || told end as changes from whole left join pr using (project, path))"""


def rewrite_corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = W.rewrite_corpus(derived_files(spark, sf_dir))
    return d.select("project", "path", "content", F.array_join("changes", "; ").alias("changes"), "modified")


register("rewrite_corpus", rewrite_corpus, f"{_corpus_sql()} select project, path, content, changes, changes <> '' as modified from done")
register(
    "rewrite_summary", lambda s, d: W.summary(W.rewrite_corpus(derived_files(s, d))),
    f"{_corpus_sql()} select count(*) as files, count(*) filter (changes <> '') as modified, sum(case when changes = '' then 0 else len(string_split(changes, '; ')) end)::bigint as changes from done",
)
