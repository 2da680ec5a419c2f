"""Evaluation of the rule catalog over lines, files and projects."""

from __future__ import annotations

from collections.abc import Callable, Iterable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lintlake.functions.text import count_of, group, java, matches, may_match, needed, position, trim
from lintlake.operators.catalog import BY_NAME, RULES, Rule, catalog
from lintlake.operators.lines import explode_lines, inside_string, is_comment, with_regions
from lintlake.sources.shared import written

#: Patterns of the rules that need more than the catalog's fields.
SECRETS = (
    r"""(?i)(?:api_key|apikey)\s*[:=]\s*['"`][\w\-/.]{16,}['"`]""",
    r"""(?i)(?:secret|token|password)\s*[:=]\s*['"`][\w\-/.]{8,}['"`]""",
    r"sk-(?:live|test)_[A-Za-z0-9]{10,}",
    r"gh[pousr]_[A-Za-z0-9]{36,}",
    r"""['"`]eyJ[A-Za-z0-9_-]{20,}\.eyJ[A-Za-z0-9_-]{20,}\.[A-Za-z0-9_-]+['"`]""",
    r"AKIA[0-9A-Z]{16}",
)
QUOTE = """['"`]"""
ASSIGNED = rf"[:=]\s*{QUOTE}"  # what patterns of secrets with a name have in common
SECRET_PATHS = (r"(?:^|[\\/])\.env(?:\.\w+)?$", r"\.(test|spec)\.(ts|js|svelte)$", r"(?:^|[\\/])(?:fixtures?|__mocks?__|__tests?__)[\\/]")
PUBLIC_ENV = r"""from\s+['"](?:\$env\/static\/public|\$env\/dynamic\/public)['"]"""
SENSITIVE = r"(?i)(?:SECRET|TOKEN|KEY|PASSWORD|AUTH|CREDENTIAL|PRIVATE)"
BARREL_IMPORT = r"""import\s+(?:type\s+)?\{[^}]+\}\s+from\s+['"](\.[^'"]*)['"]"""
BARREL_PATH = r"\/(components|lib|utils|helpers|stores|actions|hooks|composables|modules)(?:\/index)?$"
SERVER_PATH, VALIDATION = r"\+page\.server\.(ts|js)$", r"\b(?:parse|validate|safeParse|zod|yup|valibot|joi|arktype|typeof|instanceof|z\.)\b"
ROOT_LAYOUT, ERROR_PAGE = r"src\/routes\/\+layout\.svelte$", "src/routes/+error.svelte"
ALT = (r"\balt\s*=", r"\{alt\}", r"\s+alt(?:\s|\/?>)")
BOXES = r"<(div|span|li|p|section|article)\b"
CLICK = (r"\bonclick\s*=", r"\bon:click\b")
KEYS = (r"\bonkeydown\s*=", r"\bon:keydown\b", r"\bonkeyup\s*=", r"\bon:keyup\b", r"\bonkeypress\s*=", r"\bon:keypress\b")
ROLE = r"\brole\s*="
ANCHORS = (r"<a\b[^>]*\/>", r"<a\b[^>]*>\s*<\/a>")
BLOCK_OPEN, BLOCK_CLOSE = r"\{#(?:if|each|await|key)\b", r"\{\/(?:if|each|await|key)\}"
MODULE_SCRIPT, SCRIPT = r"""^<script\b[^>]*\b(?:context=["']module["']|module)\b""", r"^<script\b"
STATE = r"let\s+(\w+)\s*=\s*\$state\s*(?:<[^>]*>)?\s*\("
FETCH, HANDLER = r"\bfetch\s*\(", (r"\b(?:actions|handleSubmit|onSubmit|enhance)\b.*\{", r"\bfunction\s+handle(?:Submit|Form|Action)\b")
SIDE_EFFECTS = (r"console\.\w+\s*\(", r"\bfetch\s*\(", r"\blocalStorage\.\w+", r"\bsessionStorage\.\w+", r"\bdocument\.\w+", r"\bwindow\.\w+")
EFFECT_ASSIGNS = r"\$effect\s*\(\s*\(\s*\)\s*=>\s*\{?\s*\w+\s*=[^=]"  # what a file with a call that _effect_for_derived() looks for must hold
EFFECT, DERIVED = r"\$effect\s*\(", r"\$derived(?:\.by)?\s*\("
LONG, DEEP = 300, 3

#: Rules beside the array of line rules that read the lines.
LINE_READERS = ("no-public-env-secrets", "no-deep-nesting", "no-client-fetch", "no-unnecessary-state")
#: Line rules that one expression has: Java compiles no method over 8,000 bytes of code, and runs it ten times as slowly.
TOGETHER = 3
FOUND = ("project", "path", "rule", "line", "col", "message")
_HIT = "array<struct<rule:string,col:int,message:string>>"


def _gates(r: Rule) -> Column:
    ok = F.lit(True)
    if r.runes:
        ok = ok & F.col("uses_runes")
    if r.kit:
        ok = ok & (F.col("framework") == "sveltekit")
    if r.typescript:
        ok = ok & F.col("has_typescript")
    if r.component:
        ok = ok & F.col("path").endswith(".svelte")
    return ok


def _region(name: str) -> Column:
    return {
        "": F.lit(True),
        "script": F.col("in_script") == 1,
        "instance": F.col("in_instance") == 1,
        "template": F.col("in_script") == 0,
        "outer": F.col("in_instance") == 0,
        "markup": (F.col("in_script") == 0) & (F.col("in_style") == 0),
        "style": F.col("in_style") == 1,
    }[name]


def _hit(rule: str, when: Column, col: Column, message: Column | None = None) -> Column:
    message = F.lit(BY_NAME[rule].message) if message is None else message
    return F.when(when, F.struct(F.lit(rule).alias("rule"), col.cast("int").alias("col"), message.alias("message")))


def _filled(rule: str, value: Column) -> Column:
    before, after = BY_NAME[rule].message.split("{}")
    return F.concat(F.lit(before), value.cast("string"), F.lit(after))


def line_hit(r: Rule) -> Column:
    """A catalog line rule as one expression on a line. Cheap tests come first, patterns last; Spark keeps their order."""
    text, path = F.col("text"), F.col("path")
    ok = _gates(r) & _region(r.region)
    if not r.comments:
        ok = ok & ~F.col("is_comment")
    for p in r.need:
        ok = ok & may_match(text, p)
    for p in r.path_need:
        ok = ok & matches(path, p)
    for p in r.path_forbid:
        ok = ok & ~matches(path, p)
    for p in r.need:
        ok = ok & matches(text, p)
    for p in r.forbid:
        ok = ok & ~matches(text, p)
    col = F.lit(1) if not r.column else F.locate(r.column[1:], text) if r.column[0] == "=" else position(text, r.column)
    if not r.in_string:
        ok = ok & ~inside_string(text, col)
    return _hit(r.name, ok, col, _filled(r.name, group(text, r.group)) if r.group else None)


def secret_position(text: Column) -> Column:
    """Place of the first pattern in order that matches; null if none does."""
    assigned = (F.contains(text, F.lit(":")) | F.contains(text, F.lit("="))) & matches(text, ASSIGNED)
    return F.coalesce(*[F.nullif(F.when(~assigned, 0).otherwise(position(text, p)) if p.endswith(QUOTE) and "[:=]" in p else position(text, p), F.lit(0)) for p in SECRETS])


#: Rules that need more than the catalog's patterns: fixed texts of which one stands on each line that they read.
_PARTS = {
    "img-missing-alt": ("<img",), "click-needs-keyboard": ("<div", "<span", "<li", "<p", "<section", "<article"), "anchor-no-content": ("<a",), "no-barrel-import": ("import",),
    "no-public-env-secrets": ("$env",), "no-deep-nesting": ("{#", "{/"), "no-client-fetch": ("{", "}", "fetch", "function"), "no-unnecessary-state": ("$state",),
}
_TAGS = ("<script", "</script>", "<style", "</style>")
#: The bit of lines that may have a tag of a region, or begin with an end tag.
TAGGED = 1 << 62


def _holds(*parts: str) -> Column:
    return _any(F.contains(F.col("text"), F.lit(p)) for p in parts)


def _may_hit(rule: str) -> Column:
    """False only on lines that the rule doesn't read: the fixed texts of its patterns."""
    if rule == "no-secrets":
        return _any([_holds(":", "=") & _holds("'", '"', "`"), *[may_match(F.col("text"), p) for p in SECRETS if needed(p)]])
    return _holds(*_PARTS[rule]) if rule in _PARTS else reduce(Column.__and__, [may_match(F.col("text"), p) for p in BY_NAME[rule].need])


def _bits(names: Iterable[str]) -> int:
    """A bit for each rule, by its place in the catalog."""
    return sum(1 << k for k, r in enumerate(RULES) if r.name in set(names))


def _line_rules(names: Iterable[str]) -> list[str]:
    return [r.name for r in RULES if r.name in set(names) and (r.line or r.name in _PARTS or r.name == "no-secrets")]


def _guard(rule: str) -> str:
    """A short text that stands on each line that the rule reads; empty if none is common to all."""
    parts = () if rule == "no-secrets" else _PARTS[rule] if rule in _PARTS else needed(BY_NAME[rule].need[0])[:1]
    return next((g for g in ("<", "$", "{", "(", "import", "export", ":") if parts and all(g in p for p in parts)), "")


def _asked(names: Iterable[str]) -> Column:
    """The rules that may find something on a line, as bits, and TAGGED: each line is searched once for all fixed texts.

    Rules with a short text in common are tested only on lines that have it.
    """
    tests: dict[str, dict[int, Column]] = {"<": {TAGGED: _holds(*_TAGS) | F.col("text").startswith("</")}}
    for n in _line_rules(names):
        tests.setdefault(_guard(n), {})[_bits([n])] = _may_hit(n)
    bits = lambda found: reduce(Column.bitwiseOR, [F.when(test, F.lit(bit).cast("long")).otherwise(F.lit(0).cast("long")) for bit, test in found.items()])
    return reduce(Column.bitwiseOR, [F.when(_holds(g), bits(found)).otherwise(F.lit(0).cast("long")) if g else bits(found) for g, found in tests.items()])


def _for_rules(lines: DataFrame, *names: str) -> DataFrame:
    """Lines on which one of the rules may find something."""
    return lines.where(F.col("asked").bitwiseAND(F.lit(_bits(names)).cast("long")) != 0)


def _special_line_hits() -> dict[str, Column]:
    text, sv = F.col("text"), F.col("path").endswith(".svelte")
    template = sv & (F.col("in_script") == 0)
    element = F.col("element")
    any_of = lambda t, ps: _any(matches(t, p) for p in ps)
    labelled = text.contains("aria-label") | text.contains("aria-describedby")
    out = {}
    no_path = ~any_of(F.col("path"), SECRET_PATHS)
    where = secret_position(text)
    out["no-secrets"] = _hit("no-secrets", ~F.col("is_comment") & where.isNotNull() & no_path, where)
    out["img-missing-alt"] = _hit("img-missing-alt", template & matches(text, r"<img\b") & ~any_of(element, ALT), position(text, r"<img\b"))
    click = template & matches(text, BOXES) & any_of(element, CLICK) & ~(any_of(element, KEYS) & matches(element, ROLE))
    out["click-needs-keyboard"] = _hit("click-needs-keyboard", click, position(text, BOXES))
    for k, p in enumerate(ANCHORS):
        out[f"anchor-no-content/{k}"] = _hit("anchor-no-content", template & matches(text, p) & ~labelled, position(text, p))
    target = group(text, BARREL_IMPORT)
    barrel = ~F.col("is_comment") & matches(text, BARREL_IMPORT) & ~matches(target, r"\.\w+$") & matches(target, BARREL_PATH)
    out["no-barrel-import"] = _hit("no-barrel-import", barrel, position(text, BARREL_IMPORT))
    return out


def _any(tests: Iterable[Column]) -> Column:
    out = F.lit(False)
    for t in tests:
        out = out | t
    return out


def _public_env(lines: DataFrame) -> DataFrame:
    """Rows at the line where the import starts, not where it names its module."""
    ok = (F.col("framework") == "sveltekit") & matches(F.col("text"), PUBLIC_ENV)
    hits = _for_rules(lines, "no-public-env-secrets").where(F.col("import_text").isNotNull() & ok).select("project", "path", (F.col("line") - F.col("import_up")).cast("int").alias("line"), F.col("import_text").alias("block"))
    return _rows(hits.where(matches(F.col("block"), SENSITIVE)), "no-public-env-secrets", F.col("line"), F.lit(1))


def _rows(df: DataFrame, rule: str, line: Column, col: Column, message: Column | None = None) -> DataFrame:
    message = F.lit(BY_NAME[rule].message) if message is None else message
    return df.select("project", "path", F.lit(rule).alias("rule"), line.cast("int").alias("line"), col.cast("int").alias("col"), message.alias("message"))


def meaningful(text: Column) -> Column:
    return ~matches(text, r"^\s*(?:$|\/\/|\/?\*|-->\s*$|<!--)")


def _giant(files: DataFrame) -> DataFrame:
    """Lines are looked at only in files that have enough of them."""
    sv = files.where(F.col("path").endswith(".svelte")).select("project", "path", F.split("content", "\n", -1).alias("lines")).where(F.size("lines") > LONG)
    n = sv.select("project", "path", F.size(F.filter("lines", meaningful)).alias("n"))
    return _rows(n.where(F.col("n") > LONG), "no-giant-component", F.lit(1), F.lit(1), _filled("no-giant-component", F.col("n")))


def _nesting(lines: DataFrame) -> DataFrame:
    """depth = max(0, depth - closes) + opens, line by line, is a running sum less its lowest point so far; lines without blocks change neither."""
    counted = F.col("path").endswith(".svelte") & (F.col("in_script") == 0) & (F.col("in_style") == 0) & ~F.col("style_marker")
    n = lambda p: F.regexp_count("text", F.lit(java(p)))
    d = _for_rules(lines, "no-deep-nesting").where(counted).select("project", "path", "line", n(BLOCK_OPEN).alias("opens"), n(BLOCK_CLOSE).alias("closes"))
    upto = Window.partitionBy("project", "path").orderBy("line").rowsBetween(Window.unboundedPreceding, 0)
    d = d.withColumn("before", F.sum(F.col("opens") - F.col("closes")).over(upto) - F.col("opens"))
    d = d.withColumn("depth", F.col("before") - F.least(F.lit(0), F.min("before").over(upto)) + F.col("opens"))
    d = d.where((F.col("opens") > 0) & (F.col("depth") > DEEP))
    d = d.withColumn("at", F.explode(F.sequence(F.greatest(F.lit(DEEP + 1), F.col("depth") - F.col("opens") + 1), F.col("depth"))))
    return _rows(d, "no-deep-nesting", F.col("line"), F.lit(1), _filled("no-deep-nesting", F.col("at")))


def _multi_script(files: DataFrame) -> DataFrame:
    """A file's tags are an array of their lines."""
    indented = lambda t, p: matches(t, rf"^\s*{p[1:]}")
    tag = lambda t: indented(t, SCRIPT) & ~indented(t, MODULE_SCRIPT)
    sv = files.where(F.col("path").endswith(".svelte") & F.contains("content", F.lit("<script")))
    at = F.array_compact(F.transform(F.split("content", "\n", -1), lambda t, k: F.when(tag(t), k + 1)))
    d = sv.select("project", "path", at.alias("at")).where(F.size("at") > 1)
    d = d.select("project", "path", F.size("at").alias("n"), F.posexplode("at").alias("k", "line"))
    return _rows(d.where("k > 0"), "no-multi-script", F.col("line"), F.lit(1), _filled("no-multi-script", F.col("n")))


def _client_fetch(lines: DataFrame) -> DataFrame:
    """Brace depth and a handler flag along each file's script lines: a fold over the file's own lines.

    Only script lines with a brace, a handler or a call are gathered; script_no tells where another script begins.
    """
    text = F.col("text")
    braces = F.split(F.regexp_replace(text, r"[^{}]", ""), "")
    start = F.struct(F.lit(0).alias("now"), F.lit(1 << 20).alias("low"))
    step = lambda s, c: F.struct(
        (s["now"] + F.when(c == "{", 1).when(c == "}", -1).otherwise(0)).alias("now"), F.when(c == "}", F.least(s["low"], s["now"] - 1)).otherwise(s["low"]).alias("low")
    )
    run = F.when(F.contains(text, F.lit("{")) | F.contains(text, F.lit("}")), F.aggregate(braces, start, step)).otherwise(start)
    own = (F.col("framework") == "sveltekit") & F.col("path").endswith(".svelte") & ~matches(F.col("path"), r"\+(page|layout)\.server")
    d = _for_rules(lines, "no-client-fetch").where((F.col("in_script") == 1) & own & ~F.col("is_comment")).select(
        "project", "path", "line", "script_no", run.alias("run"), _any(matches(text, p) for p in HANDLER).alias("handler"), F.when(matches(text, FETCH), F.locate("fetch", text)).otherwise(0).alias("fetch")
    )
    entry = F.struct("line", "script_no", F.col("run.now").alias("net"), F.col("run.low").alias("low"), "handler", "fetch")
    files = d.groupBy("project", "path").agg(F.sort_array(F.collect_list(entry)).alias("lines"), F.max("fetch").alias("any")).where(F.col("any") > 0)
    state = F.expr("named_struct('last', -1, 'depth', 0, 'on', false, 'hdepth', 0, 'hits', cast(array() as array<struct<line:int,col:int>>))")

    def fold(s: Column, x: Column) -> Column:
        left = x["script_no"] != s["last"]
        depth, on, h = F.when(left, 0).otherwise(s["depth"]), F.when(left, F.lit(False)).otherwise(s["on"]), F.when(left, 0).otherwise(s["hdepth"])
        after, ended = depth + x["net"], on & (depth + x["low"] > h)
        now_on, now_h = F.when(x["handler"], F.lit(True)).otherwise(ended), F.when(x["handler"], after).otherwise(h)
        hits = F.when(~now_on & (x["fetch"] > 0), F.concat(s["hits"], F.array(F.struct(x["line"].alias("line"), x["fetch"].alias("col"))))).otherwise(s["hits"])
        return F.struct(x["script_no"].alias("last"), after.alias("depth"), now_on.alias("on"), now_h.alias("hdepth"), hits.alias("hits"))

    hits = files.select("project", "path", F.explode(F.aggregate("lines", state, fold, lambda s: s["hits"])).alias("h"))
    return _rows(hits, "no-client-fetch", F.col("h.line"), F.col("h.col"))


def _form_action(files: DataFrame) -> DataFrame:
    """No pattern of validation goes over a line's end, so a file is searched as a whole."""
    content, at = F.col("content"), F.locate("formData", F.col("content"))
    d = files.where(matches(F.col("path"), SERVER_PATH) & F.contains(content, F.lit("formData")) & ~matches(content, VALIDATION))
    d = d.select("project", "path", F.substring(content, F.lit(1), at - 1).alias("before"))
    col = F.length(F.substring_index("before", "\n", -1)) + 1
    return _rows(d, "form-action-no-validation", count_of(F.col("before"), "\n") + 1, col)


def _error_page(files: DataFrame, profiles: DataFrame, evidence: DataFrame) -> DataFrame:
    layouts = files.select("project", "path").where(matches(F.col("path"), ROOT_LAYOUT)).join(profiles.where("framework = 'sveltekit'").select("project"), "project")
    pages = evidence.where(F.col("path") == ERROR_PAGE).select("project")
    return _rows(layouts.join(pages, "project", "left_anti"), "missing-error-page", F.lit(1), F.lit(1))


#: Ways to write a variable, each a pattern whose group is its name. Names are looked ahead from, so that each is judged by itself.
_WRITES = {
    "set": r"(?<![A-Za-z0-9_])(\w++)(?=\s*=[^=])",
    "changed": r"(?<![A-Za-z0-9_])(\w++)(?=\s*(?:(?:\+|-|\*|\/|%|\*\*|&|\||\^|<<|>>|>>>)=|\+\+|--|\.\s*(?:push|pop|splice|shift|unshift|sort|reverse|fill|set|delete|clear|add)\s*\(|(?:\.[\w.]+|\[[^\]]+\])\s*=[^=]))",
    "stepped": r"(?:\.\+\+|--)(\w+)",
}


_METHODS = "push|pop|splice|shift|unshift|sort|reverse|fill|set|delete|clear|add"
#: A line that can go on with a write begun on a line above, or whose write can go on below; and what lines with a whole write hold.
_GOES_ON = (rf"^\s*(?:[=.(\[]|\+\+|--|(?:[-+*/%&|^]|\*\*|<<|>>>?)=|(?:{_METHODS})\s*(?:\(|$))", r"\[[^\]]*$")
_WRITTEN = ("=", "(", "++", "--")


def _written_names(files: DataFrame, declared: bool = False) -> DataFrame:
    """project, path, name of variables that a component writes after their declaration: an index by one pass for each way of writing.

    Where no write goes over a line's end, only lines that can hold one are searched. declared: only names that the file
    declares as state are wanted, so that lines without any of them needn't be searched either.
    """
    has = files.where(F.col("path").endswith(".svelte") & F.col("content").contains("$state"))
    code = has.select("project", "path", once(F.split("content", "\n", -1)).alias("lines"))
    if declared:
        names = F.array_distinct(F.transform(F.filter("lines", lambda t: matches(t, STATE)), lambda t: group(t, STATE)))
        code = code.select("project", "path", "lines", once(names).alias("names")).where(F.size("names") > 0)
    code = code.select(*[c for c in code.columns if c != "lines"], once(F.filter("lines", lambda t: ~is_comment(t))).alias("lines"))
    wanted = lambda t: F.exists("names", lambda n: F.contains(t, n)) if declared else F.lit(True)
    some = F.filter("lines", lambda t: _any(F.contains(t, F.lit(p)) for p in _WRITTEN) & wanted(t))
    body = code.select("project", "path", once(F.array_join(F.when(F.exists("lines", lambda t: _any(matches(t, p) for p in _GOES_ON)), F.col("lines")).otherwise(some), "\n")).alias("body"))
    entry = lambda is_set: lambda n: F.struct(n.alias("name"), F.lit(is_set).alias("set"))
    named = [F.transform(F.regexp_extract_all("body", F.lit(java(p)), F.lit(1)), entry(kind == "set")) for kind, p in _WRITES.items()]
    d = body.select("project", "path", F.explode(F.concat(*named)).alias("w")).groupBy("project", "path", "w.name").agg(F.count_if(F.col("w.set")).alias("sets"), F.count_if(~F.col("w.set")).alias("others"))
    return d.where("sets > 1 or others > 0").select("project", "path", "name")


def _unnecessary_state(lines: DataFrame, files: DataFrame) -> DataFrame:
    """Declared state whose name is not in the index of written names."""
    text = F.col("text")
    sv = _for_rules(lines, "no-unnecessary-state").where(F.col("path").endswith(".svelte") & ~F.col("is_comment"))
    named = sv.where(matches(text, STATE)).select("project", "path", "line", group(text, STATE).alias("name"), position(text, STATE).alias("col"))
    d = named.join(_written_names(files, declared=True), ["project", "path", "name"], "left_anti")
    return _rows(d, "no-unnecessary-state", F.col("line"), F.col("col"), _filled("no-unnecessary-state", F.col("name")))


def _pieces(text: Column) -> Column:
    """A text cut after each parenthesis. A mark is put there and split at, since a pattern would be tried at each character."""
    marked = F.replace(F.replace(text, F.lit("("), F.lit("(\0")), F.lit(")"), F.lit(")\0"))
    return F.when(F.contains(text, F.lit("\0")), F.split(text, r"(?<=[()])", -1)).otherwise(F.split(marked, "\0", -1))


def calls(files: DataFrame, opener: str, part: str, has: Callable[[Column], Column]) -> DataFrame:
    """Each call of ``opener``, a pattern that ends with its parenthesis: project, path, line, col, start, stop, inside, ahead.

    start, stop: offsets of what stands in the parentheses; if they stay open, all but the last character of the
    rest. inside: how many pieces of it have ``has``, a condition on ``piece`` that a longer piece keeps. ahead: the next three pieces.

    A file is cut after each parenthesis; the depth is a running sum over the pieces. Parentheses of one level
    alternate, so the one that closes is the next of its level. Both windows are on the file, so there is one shuffle; the
    work is linear in the file's length, however many calls stay open.
    """
    d = files.where(F.col("content").contains(part)).repartition("project", "path").select("project", "path", F.posexplode(_pieces(F.col("content"))).alias("k", "piece"))
    file, piece = Window.partitionBy("project", "path"), F.col("piece")
    order = file.orderBy("k")
    upto, before = order.rowsBetween(Window.unboundedPreceding, 0), order.rowsBetween(Window.unboundedPreceding, -1)
    turn = F.when(piece.endswith("("), 1).when(piece.endswith(")"), -1).otherwise(0)
    yes = lambda text: F.when(has(text), 1).otherwise(0)
    # of the last piece that isn't empty, a character doesn't count in calls that stay open
    short = F.substring(piece, F.lit(1), F.greatest(F.length(piece) - 1, F.lit(0)))
    d = d.withColumn("own", yes(piece))
    lost = F.when(F.col("own") == 1, 1 - yes(short)).otherwise(0)
    d = d.withColumns({"turn": turn, "size": F.length(piece), "lost": lost, "newline": F.length(piece) - F.instr(F.reverse(piece), "\n") + 1})
    d = d.select(
        "project", "path", "k", "piece", "turn", "size", F.sum("turn").over(upto).alias("depth"), F.sum("size").over(upto).alias("end"), F.sum("own").over(upto).alias("seen"),
        F.sum("size").over(file).alias("length"), (F.sum("own").over(file) - F.max_by("lost", F.when(F.col("size") > 0, F.col("k"))).over(file)).alias("all"),
        F.coalesce(F.sum(count_of(piece, "\n")).over(before), F.lit(0)).alias("lines"),
        F.array(*[F.lead("piece", n).over(order) for n in (1, 2, 3)]).alias("ahead"), F.when(F.contains(piece, F.lit("\n")), F.col("newline")).alias("newline"),
    )
    d = d.withColumn("edge", F.coalesce(F.max(F.col("end") - F.col("size") + F.col("newline")).over(before), F.lit(0)))
    level = F.when(F.col("turn") < 0, F.col("depth") + 1).otherwise(F.col("depth"))
    d = d.where("turn != 0").withColumn("level", level)
    d = d.withColumn("close", F.lead(F.struct("end", "seen")).over(Window.partitionBy("project", "path", "level").orderBy("k")))
    tail = F.regexp_extract(piece, f"({java(opener)})\\z", 1)
    d = d.where(F.col("turn") > 0).withColumn("tail", tail).where("tail != ''")
    left = F.substring(piece, F.lit(1), F.col("size") - F.length("tail"))
    at = F.col("end") - F.length("tail")
    last = F.when(F.contains(left, F.lit("\n")), F.col("end") - F.col("size") + F.length(left) - F.instr(F.reverse(left), "\n") + 1).otherwise(F.col("edge"))
    return d.select(
        "project", "path", (F.col("lines") + count_of(left, "\n") + 1).alias("line"), (at - last + 1).alias("col"), F.col("end").alias("start"),
        F.greatest(F.col("end"), F.coalesce(F.col("close.end"), F.col("length")) - 1).alias("stop"), (F.coalesce(F.col("close.seen"), F.col("all")) - F.col("seen")).alias("inside"), "ahead",
    )


def _named(value: Column, of: Callable[[Column], Column]) -> Column:
    """``of(value)`` with the value computed once, however often it is used: Spark would write it out each time."""
    return F.transform(F.array(value), of)[0]


def once(value: Column) -> Column:
    """A column for select() that is worked out once: a filter on a column is written into what comes before it, but not into an explode."""
    return F.explode(F.array(value))


def _balanced(depth: int) -> str:
    """A pattern of text whose parentheses are closed, nested up to ``depth``. Nothing is tried twice, so it is linear."""
    inner = "[^()]*+"
    for _ in range(depth):
        inner = rf"[^()]*+(?:\({inner}\)[^()]*+)*+"
    return inner


#: Rules on calls: the call's name behind a ``$``, what else stands before its parenthesis, and what the inside of calls that count begins with.
_CALLS = {"no-effect-for-derived": ("effect", "", r"\s*\(\s*\)\s*=>\s*\{?\s*\w+\s*=[^=]"), "no-derived-side-effect": ("derived", r"(?:\.by)?", "")}
#: How deep parentheses of a call are nested, and how many calls a file has, that are looked at in the file's own row; other files go through calls().
NESTED, NEAR = 6, 200


def near_calls(files: DataFrame, names: Iterable[str]) -> DataFrame:
    """What files have of the calls that rules look at, by one pass: project, path, near, far, content; written, since each rule reads it twice.

    near: an array of calls (rule, line, col, body: what stands in the parentheses) that close before the next call begins.
    far: the rules for which the file has a call that doesn't, so that calls() must look at it; only then has it its content.
    A file is cut where calls begin, so no window and no shuffle is needed.
    """
    chosen = {n: c for n, c in _CALLS.items() if n in set(names)}
    cut = F.split("content", f"[$](?={'|'.join(c[0] for c in chosen.values())})", -1)
    d = files.where(_any(F.contains("content", F.lit(f"${c[0]}")) for c in chosen.values())).select("project", "path", "content", once(cut).alias("cut"))
    inner = _balanced(NESTED)

    def judged(t: Column, k: Column) -> Column:
        last, rule, body = k == F.size("cut") - 1, F.lit(None).cast("string"), F.lit(None).cast("string")
        for n, (name, more, may) in chosen.items():
            opens = rf"^{name}{more}\s*\("
            counts = (k > 0) & t.startswith(name) & t.rlike(java(opens + may))
            if n == "no-effect-for-derived":
                counts = F.col("path").endswith(".svelte") & counts
            rule = F.when(counts, n).otherwise(rule)
            # a text before it, so that one search tells an empty inside from none
            body = F.when(t.startswith(name), F.regexp_extract(t, java(rf"{opens[:-2]}(\({inner})\)"), 1)).otherwise(body)
        lines = F.octet_length(t) - F.octet_length(F.replace(t, F.lit("\n"), F.lit("")))
        beside = (k > 1) & ~F.contains(F.col("cut")[k - 1], F.lit("\n"))  # another call begins on its line
        left = F.length(F.substring_index(t, "\n", -1))
        found = _named(rule, lambda r: F.when(r.isNotNull(), F.struct(r.alias("rule"), F.when(beside, "").otherwise(body).alias("body"))))
        return F.struct(F.when(~last, lines).alias("lines"), F.when(~last, left).alias("left"), found.alias("found"))

    few = F.size("cut") <= NEAR
    d = d.select("project", "path", "content", once(F.when(few, F.transform("cut", judged))).alias("at"))
    line = lambda k: F.aggregate(F.slice("at", F.lit(1), k), F.lit(1), lambda n, x: n + x["lines"])
    near = lambda x, k: F.when(x["found"]["body"] != "", F.struct(x["found"]["rule"].alias("rule"), line(k).alias("line"), (F.col("at")[k - 1]["left"] + 1).alias("col"), F.substring(x["found"]["body"], F.lit(2), F.length(x["found"]["body"])).alias("body")))
    far = F.array_distinct(F.transform(F.filter("at", lambda x: x["found"]["body"] == ""), lambda x: x["found"]["rule"]))
    d = d.select("project", "path", "content", once(F.array_compact(F.transform("at", near))).alias("near"), F.coalesce(far, F.array(*[F.lit(n) for n in chosen])).alias("far"))
    d = d.select("project", "path", F.coalesce("near", F.array().cast("array<struct<rule:string,line:int,col:int,body:string>>")).alias("near"), "far", F.when(F.size("far") > 0, F.col("content")).alias("content"))
    return written(d.where((F.size("near") > 0) | (F.size("far") > 0)))


def _calls_of(seen: DataFrame, rule: str) -> tuple[DataFrame, DataFrame]:
    """(calls in near, files in far) of one rule, from near_calls()."""
    far = F.array_contains("far", F.lit(rule))
    near = seen.where(~far).select("project", "path", F.explode("near").alias("x")).where(F.col("x.rule") == rule)
    return near.select("project", "path", "x.line", "x.col", "x.body"), seen.where(far).select("project", "path", "content")


def _effect_for_derived(seen: DataFrame) -> DataFrame:
    """Only calls that begin with an assignment in an arrow function are looked at; those of many lines are joined with their file's text."""
    near, far = _calls_of(seen, "no-effect-for-derived")
    ahead = F.col("ahead")
    begins = matches(ahead[0], r"^\s*\($") & matches(ahead[1], r"^\s*\)$") & matches(ahead[2], r"^\s*=>\s*\{?\s*\w+\s*=[^=]")
    d = calls(far, EFFECT, "$effect", lambda t: F.lit(False)).where(begins).join(far, ["project", "path"])
    d = d.select("project", "path", "line", "col", F.substring("content", F.col("start") + 1, F.col("stop") - F.col("start")).alias("body")).unionByName(near)
    arrow = java(r"^\(\s*\)\s*=>")

    def statement(body: Column) -> Column:
        """What the arrow function does, without its braces and last semicolon."""
        braced = lambda t: F.when(t.startswith("{") & t.endswith("}"), trim(F.substring(t, F.lit(2), F.greatest(F.length(t) - 2, F.lit(0))))).otherwise(t)
        bare = lambda t: trim(F.regexp_replace(t, java(r";\s*$"), ""))
        return _named(_named(trim(F.regexp_replace(body, arrow, "")), braced), bare)

    d = d.withColumn("stmt", _named(trim(F.col("body")), lambda b: F.when(b.rlike(arrow), statement(b))))
    harmless = lambda right: ~_any(matches(right, p) for p in (r"\bconsole\.\w+\s*\(", *SIDE_EFFECTS[1:]))
    ok = _named(F.col("stmt"), lambda t: matches(t, r"^\w+\s*=[^=]") & ~t.contains(";") & _named(F.regexp_replace(t, java(r"^\w+\s*=\s*"), ""), harmless))
    return _rows(d.where(ok), "no-effect-for-derived", F.col("line"), F.col("col"))


def _derived_side_effect(seen: DataFrame) -> DataFrame:
    """No side effect's pattern goes over a parenthesis but at its end, so a call of many lines has one if one of its pieces has."""
    has = lambda t: _any(matches(t, p) for p in SIDE_EFFECTS)
    near, far = _calls_of(seen, "no-derived-side-effect")
    rest = F.substring("content", F.locate("$derived", F.col("content")), F.lit(1 << 30))
    d = calls(far.where(has(rest)), DERIVED, "$derived", has).where("inside > 0").select("project", "path", "line", "col")
    d = d.unionByName(near.where(has(F.col("body"))).select("project", "path", "line", "col"))
    return _rows(d, "no-derived-side-effect", F.col("line"), F.col("col"))


def scan_lines(files: DataFrame, profiles: DataFrame, names: Iterable[str] | None = None) -> DataFrame:
    """Lines with their regions, what rules need of their project's profile, and asked, the rules that look at them; only those that rules ``names`` read, if given.

    Files are dealt before they are exploded: content moves once, without a path beside each line.
    """
    gates = profiles.select("project", "framework", "has_typescript", "uses_runes")
    lines = explode_lines(files.repartition("project", "path"), joined=True)
    asked = _asked([r.name for r in RULES] if names is None else names)
    if names is not None:
        # a filter on a column would work it out twice: Spark writes its expression into the filter too
        asked = F.explode(F.array_remove(F.array(asked), F.lit(0).cast("long")))
    return with_regions(lines.select("*", asked.alias("asked"))).join(gates, "project")


def evaluate(files: DataFrame, profiles: DataFrame, names: Iterable[str] | None = None, evidence: DataFrame | None = None, lines: DataFrame | None = None) -> DataFrame:
    """Findings (project, path, rule, line, col, message) of the named rules, or of all.

    ``evidence``: project, path of files that exist, if ``files`` are but some of their projects'. ``lines``:
    scan_lines() of the same arguments, if the caller has them written.

    Lines are exploded and windowed once for all rules. Rules on single lines are array expressions
    of a few rules each, exploded; rules on whole files or projects are joins and aggregates beside them. If
    several parts need the lines, they are written once to the shared folder and read column by column.
    ``profiles``: project, framework, has_typescript, uses_runes; projects without one are not looked at.
    """
    chosen = [r for r in RULES if names is None or r.name in set(names)]
    want = {r.name for r in chosen}
    gates = profiles.select("project", "framework", "has_typescript", "uses_runes")  # Spark broadcasts it if it turns out small
    given = lines is not None
    if not given:
        lines = scan_lines(files, profiles, _line_rules(want))
    hits = [(r.name, line_hit(r)) for r in chosen if r.line] + [(n.split("/")[0], c) for n, c in _special_line_hits().items() if n.split("/")[0] in want]
    groups = [hits[k : k + TOGETHER] for k in range(0, len(hits), TOGETHER)]
    if not given and sum(n in want for n in LINE_READERS) + len(groups) > 1:
        lines = written(lines)
    parts: list[DataFrame] = []
    for group_ in groups:
        # outer, since else Spark infers a filter from the array, which evaluates every rule twice
        x = _for_rules(lines, *[n for n, _ in group_]).select("project", "path", "line", F.explode_outer(F.array_compact(F.array(*[c for _, c in group_]))).alias("h")).where("h is not null")
        parts.append(x.select("project", "path", "h.rule", F.col("line").cast("int").alias("line"), "h.col", "h.message"))
    known = files.join(gates.select("project"), "project", "left_semi")
    seen = near_calls(known, want) if want & set(_CALLS) else None
    special = {
        "no-public-env-secrets": lambda: _public_env(lines), "no-giant-component": lambda: _giant(known), "no-deep-nesting": lambda: _nesting(lines),
        "no-multi-script": lambda: _multi_script(known), "no-client-fetch": lambda: _client_fetch(lines), "form-action-no-validation": lambda: _form_action(known),
        "missing-error-page": lambda: _error_page(files, profiles, files if evidence is None else evidence), "no-unnecessary-state": lambda: _unnecessary_state(lines, known),
        "no-effect-for-derived": lambda: _effect_for_derived(seen), "no-derived-side-effect": lambda: _derived_side_effect(seen),
    }
    parts += [make() for n, make in special.items() if n in want]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def findings(found: DataFrame) -> DataFrame:
    """Findings with severity, category, help and weight from the catalog, a table of fixed size."""
    c = catalog(found.sparkSession).drop("message")
    return found.join(F.broadcast(c), "rule").select("project", "path", "rule", "severity", "category", "message", "help", "line", "col", F.lit(1.0).alias("weight"))


def documents_secrets(docs: DataFrame) -> DataFrame:
    """The secret patterns over plain documents: doc_id, line, col."""
    d = docs.select("doc_id", F.posexplode(F.split("text", "\n", -1)).alias("line", "text"))
    d = d.where(~is_comment(F.col("text"))).select("doc_id", (F.col("line") + 1).cast("int").alias("line"), secret_position(F.col("text")).cast("int").alias("col"))
    return d.where("col is not null")

