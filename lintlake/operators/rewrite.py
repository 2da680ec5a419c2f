"""Bulk rewrite of legacy source: new texts and what was changed in each file.

A pass takes lines (project, path, line, sub, text) and gives lines with ``hit`` where it changed one.
Passes share one partitioning by file; inserted lines get sub 1 after the line they follow.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lintlake.functions.text import group, java, matches, trim
from lintlake.operators.lines import closes_region, explode_lines, opens_region

#: Patterns that are rewritten, what they become, and the names of changes in their order.
PROP = r"^\s*export\s+let\s+(\w+)\s*(?::\s*[^=;]+)?\s*(?:=\s*(.+?))?\s*;?\s*$"
REACTIVE, DECLARED = r"^(\s*)\$:\s+(.+)$", r"^\s*(?:let|const|var)\s+(\w+)"
ASSIGN, ASSIGN_OPEN = r"^(\w+)\s*=\s*(.+?);\s*$", r"^(\w+)\s*=\s*(.+)$"
DISPATCHER_IMPORT = r"""import\s+\{[^}]*createEventDispatcher[^}]*\}\s+from\s+['"]svelte['"]"""
DISPATCHER_ONLY = r"""import\s+\{\s*createEventDispatcher\s*\}\s+from\s+['"]svelte['"]"""
DISPATCHER_CONST = r"^\s*const\s+\w+\s*=\s*createEventDispatcher\s*\(\s*\)"
SVELTE_IMPORT, LIFECYCLE = r"""import\s+\{([^}]+)\}\s+from\s+['"]svelte['"]""", ("onMount", "onDestroy", "beforeUpdate", "afterUpdate")
DISPATCHER_TODO = "// TODO: createEventDispatcher removed. Use callback props via $props()."
DISPATCH_TODO = "  // TODO: replace dispatch() calls with callback props from $props()"
MODIFIERS = " /* TODO: modifiers {} removed — handle manually */"
LET = r"\slet:(\w+)(?:=\{(\w+)\})?"
LET_TODO = (" <!-- TODO: let:", ", let:", " removed — use snippet props with {@render} -->")
NAMED_SLOTS = (r'<slot\s+name="(\w+)"\s*\/>', r'<slot\s+name="(\w+)"\s*>\s*<\/slot>', r'<slot\s+name="(\w+)"\s*>')
CHILDREN = "{@render children?.()}"
CHANGES = (
    ("b1", "export-let → $props"), ("b2", "$: → $derived/$effect"), ("b3", "createEventDispatcher → callback props"), ("b4", "lifecycle → $effect"),
    ("b5", "on:event → onevent"), ("b6", "on:event → onevent"), ("b7", "slot → @render"), ("b8", "let: → snippet"),
)


def _order():
    return Window.partitionBy("project", "path").orderBy("line", "sub")


def _upto():
    return _order().rowsBetween(Window.unboundedPreceding, 0)


def lines_of(files: DataFrame) -> DataFrame:
    """Files are dealt before they are exploded: content moves once, and patterns are searched on all cores."""
    return explode_lines(files.repartition("project", "path")).withColumn("sub", F.lit(0))


def _region(name: str) -> Column:
    marker = F.when(opens_region(F.col("text"), name), 1).when(closes_region(F.col("text"), name), 0)
    return F.when(marker.isNotNull(), 0).otherwise(F.coalesce(F.last(marker, ignorenulls=True).over(_upto()), F.lit(0)))


def _replace(text: Column, pattern: str, by: str) -> Column:
    return F.regexp_replace(text, java(pattern), by)


def _like(made: Column, pattern: str) -> Column:
    """matches() of a text that is itself worked out: written out once, without a search before."""
    return made.rlike(java(pattern))


def _done(d: DataFrame, text: Column, hit: Column) -> DataFrame:
    """The pass's lines; flags of earlier passes go along."""
    hit = F.coalesce(hit, F.lit(False))
    flags = [c for c in d.columns if re.fullmatch(r"b\d", c)]
    return d.select("project", "path", "line", "sub", F.when(hit, text).otherwise(F.col("text")).alias("text"), hit.alias("hit"), *flags)


def b1_props(lines: DataFrame) -> DataFrame:
    """All props of a file become one destructuring on the first one's line; the other lines go."""
    d = lines.withColumn("in_script", _region("script"))
    prop = (F.col("in_script") == 1) & matches(F.col("text"), PROP)
    default = trim(group(F.col("text"), PROP, 2))
    part = F.when(prop, F.when(default != "", F.concat(group(F.col("text"), PROP, 1), F.lit(" = "), default)).otherwise(group(F.col("text"), PROP, 1)))
    # the props of a file are a window of their own, in the same partition: other lines don't carry them
    d = d.withColumn("part", part).withColumn("is_prop", F.col("part").isNotNull())
    own = Window.partitionBy("project", "path", "is_prop").orderBy("line", "sub")
    d = d.withColumn("parts", F.collect_list("part").over(own.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
    first = F.col("is_prop") & (F.row_number().over(own) == 1)
    d = d.withColumn("first", first)
    first = F.col("first")
    d = d.where(F.col("part").isNull() | first)
    return _done(d, F.concat(F.lit("  let { "), F.array_join("parts", ", "), F.lit(" } = $props();")), first)


def b2_reactive(lines: DataFrame) -> DataFrame:
    """Reactive statements: blocks and effects into $effect, plain assignments into $derived.

    A block ends on the first later line where the running sum of braces is what it was before the
    block: an equi-join on (file, sum), not a scan from each block.
    """
    text = F.col("text")
    net = (F.length(F.translate(text, "}", "")) - F.length(F.translate(text, "{", ""))).cast("int")
    d = lines.withColumn("in_script", _region("script")).withColumn("net", net)
    d = d.withColumn("at", F.row_number().over(_order())).withColumn("sum", F.sum("net").over(_upto()))
    d = d.withColumn("statement", F.when((F.col("in_script") == 1) & matches(text, REACTIVE), group(text, REACTIVE, 2)))
    # declarations and assignments of one name in a file are a window of their own: does it hold a declaration?
    d = d.withColumn("named", F.when(matches(text, DECLARED), group(text, DECLARED)).otherwise(group(F.col("statement"), r"^(\w+)\s*=")))
    d = d.withColumn("declared", F.max(matches(text, DECLARED)).over(Window.partitionBy("project", "path", "named")))
    block = trim(F.col("statement")).startswith("{")
    opens = d.where(block & (F.col("net") != 0)).select(F.col("project").alias("p"), F.col("path").alias("f"), F.col("at").alias("from"), (F.col("sum") - F.col("net")).alias("level"))
    ends = opens.join(d.select("project", "path", "at", "sum"), (F.col("p") == F.col("project")) & (F.col("f") == F.col("path")) & (F.col("level") == F.col("sum")) & (F.col("at") > F.col("from")))
    ends = ends.groupBy("p", "f", "from").agg(F.min("at").alias("to"))
    marks = ends.select("p", "f", F.col("from").alias("k"), F.lit(1).alias("opens"), F.lit(0).alias("closes")).unionByName(ends.select("p", "f", F.col("to").alias("k"), F.lit(0).alias("opens"), F.lit(1).alias("closes")))
    marks = marks.groupBy("p", "f", "k").agg(F.max("opens").alias("opens"), F.max("closes").alias("closes"))
    d = d.join(marks, (F.col("project") == F.col("p")) & (F.col("path") == F.col("f")) & (F.col("at") == F.col("k")), "left")
    ended = F.col("closes") == 1
    closed = F.when(ended, _replace(text, r"\}\s*$", "});")).otherwise(text)
    again = (F.col("in_script") == 1) & _like(closed, REACTIVE)
    statement, indent = group(closed, REACTIVE, 2), group(closed, REACTIVE, 1)
    t = trim(statement)
    waits = _like(t, r"\bawait\b")
    effect = _like(t, r"^\w+[\w.]*\s*\(") | t.startswith("if ") | waits
    plain = ~waits & _like(t, r"^\w+\s*=\s*.+") & ~effect
    whole = t.startswith("{") & ((F.col("opens") == 1) | (F.col("net") == 0))
    start = F.concat(indent, F.lit("$effect(() => "), statement)

    def derived(p: str) -> Column:
        name = group(statement, p, 1)
        word = F.when(F.col("declared"), "").otherwise("const ")
        return F.concat(indent, word, name, F.lit(" = $derived("), group(statement, p, 2), F.lit(");"))

    new = (
        F.when(whole & (F.col("net") == 0), _replace(start, r"\}\s*$", "});"))
        .when(whole, start)
        .when(plain & _like(statement, ASSIGN), derived(ASSIGN))
        .when(plain & _like(statement, ASSIGN_OPEN), derived(ASSIGN_OPEN))
        .when(effect, F.concat(indent, F.lit("$effect(() => { "), statement, F.when(statement.endswith(";"), "").otherwise(";"), F.lit(" });")))
        .otherwise(F.concat(indent, F.lit("$effect(() => { "), statement, F.lit(" });")))
    )
    return _done(d, F.when(again, new).otherwise(closed), again | ended)


def b3_dispatcher(lines: DataFrame) -> DataFrame:
    text = F.col("text")
    imported, only = matches(text, DISPATCHER_IMPORT), matches(text, DISPATCHER_ONLY)
    fewer = F.when(imported, _replace(text, r"^(.*?)(?:,?\s*createEventDispatcher\s*,?)", "$1")).otherwise(text)
    made = _like(fewer, DISPATCHER_CONST)
    return _done(lines, F.when(imported & only, F.lit(DISPATCHER_TODO)).when(made, F.lit(DISPATCH_TODO)).otherwise(fewer), imported | made)


def b4_lifecycle(lines: DataFrame) -> DataFrame:
    """Lifecycle functions leave the import; a line that tells so takes its place or follows it."""
    names = F.transform(F.split(group(F.col("text"), SVELTE_IMPORT), ","), lambda x: trim(x))

    def old(x: Column) -> Column:
        out = F.lit(False)
        for f in LIFECYCLE:
            out = out | (x == f) | x.startswith(f"{f} as")
        return out

    d = lines.withColumn("old", F.when(matches(F.col("text"), SVELTE_IMPORT), F.filter(names, old))).withColumn("rest", F.filter(names, lambda x: ~old(x)))
    hit = F.col("old").isNotNull() & (F.size("old") > 0)
    todo = F.concat(F.lit("// TODO: "), F.array_join("old", ", "), F.lit(" removed. Use $effect() instead."))
    kept = F.concat(F.lit("import { "), F.array_join("rest", ", "), F.lit(" } from 'svelte';"))
    alone = F.size("rest") == 0
    pieces = F.when(hit & ~alone, F.array(F.struct(F.col("sub").alias("s"), kept.alias("t")), F.struct((F.col("sub") + 1).alias("s"), F.concat(F.lit("  "), todo).alias("t"))))
    pieces = pieces.otherwise(F.array(F.struct(F.col("sub").alias("s"), F.when(hit, todo).otherwise(F.col("text")).alias("t"))))
    flags = [c for c in d.columns if re.fullmatch(r"b\d", c)]
    d = d.select("project", "path", "line", F.explode(pieces).alias("x"), F.coalesce(hit, F.lit(False)).alias("hit"), *flags)
    return d.select("project", "path", "line", F.col("x.s").alias("sub"), F.col("x.t").alias("text"), "hit", *flags)


def _template(lines: DataFrame) -> DataFrame:
    marker = opens_region(F.col("text"), "style") | closes_region(F.col("text"), "style")
    return lines.withColumn("open", (_region("script") == 0) & (_region("style") == 0) & ~marker)


def b5_text(text: Column) -> Column:
    told = MODIFIERS.format("$2")
    out = _replace(text, r"\son:(\w+)(\|[a-zA-Z|]+)(?=[>\s/])", f" on$1{told}")
    return _replace(out, r"\son:(\w+)(?=[>\s/])", " on$1")


def b6_text(text: Column) -> Column:
    told = MODIFIERS.format("$2")
    return _replace(_replace(text, r"\son:(\w+)(\|[a-zA-Z|]+)=", f" on$1={told}"), r"\son:(\w+)=", " on$1=")


def b7_text(text: Column) -> Column:
    no_end = lambda x: F.replace(x, F.lit("</slot>"), F.lit(""))
    named = text
    for p in NAMED_SLOTS:
        named = _replace(named, p, "{@render $1?.()}")
    named = F.when(named != text, no_end(named)).otherwise(text)
    closed = _replace(_replace(named, r"<slot\s*\/>", CHILDREN), r"<slot\s*>\s*<\/slot>", CHILDREN)
    opened = _replace(text, r"<slot\s*>", CHILDREN)
    return F.when(closed != text, closed).when(opened != text, no_end(opened)).otherwise(no_end(text))


def b8_text(text: Column) -> Column:
    names = F.regexp_extract_all(text, F.lit(java(LET)), F.lit(1))
    left = _replace(text, LET, "")
    note = F.concat(F.lit(LET_TODO[0]), F.array_join(names, LET_TODO[1]), F.lit(LET_TODO[2]))
    behind = F.length(left) - F.locate(">", F.reverse(left)) + 1
    at_end = F.concat(left, note)
    inside = F.concat(F.substring(left, F.lit(1), behind), note, F.substring(left, behind + 1, F.length(left)))
    return F.when(F.size(names) == 0, text).when(F.contains(left, F.lit(">")), inside).otherwise(at_end)


#: What a line holds if a change of the template can touch it.
TOUCHED = {b5_text: "on:", b6_text: "on:", b7_text: "slot", b8_text: "let:"}


def _changed(change) -> Column:
    """The line as ``change`` leaves it; only open lines that hold what it looks for are worked on."""
    text = F.col("text")
    return F.when(F.col("open") & F.contains(text, F.lit(TOUCHED[change])), change(text)).otherwise(text)


def template_pass(lines: DataFrame, change) -> DataFrame:
    d = _template(lines).withColumn("new", _changed(change))
    return _done(d, F.col("new"), F.col("open") & (F.col("new") != F.col("text")))


TEMPLATE = {"b5": b5_text, "b6": b6_text, "b7": b7_text, "b8": b8_text}
PASSES = {"b1": b1_props, "b2": b2_reactive, "b3": b3_dispatcher, "b4": b4_lifecycle} | {k: (lambda lines, f=f: template_pass(lines, f)) for k, f in TEMPLATE.items()}


def rewrite_corpus(files: DataFrame) -> DataFrame:
    """project, path, content, changes, modified for every file: all passes in order.

    Texts are joined again in one aggregation on the partitioning that the windows have.
    """
    lines, flags = lines_of(files), []
    for name in ("b1", "b2", "b3", "b4"):
        lines = PASSES[name](lines).withColumnRenamed("hit", name)
        flags.append(name)
    d = _template(lines)
    for name, change in TEMPLATE.items():
        d = d.withColumn("new", _changed(change))
        d = d.withColumn(name, F.col("new") != F.col("text")).withColumn("text", F.col("new")).drop("new")
        flags.append(name)
    whole = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("line", "sub", "text"))), lambda x: x["text"]), "\n")
    out = d.groupBy("project", "path").agg(whole.alias("content"), *[F.bool_or(f).alias(f) for f in flags])
    names = [F.when(F.col("b5") | F.col("b6") if k == "b5" else F.col(k), F.lit(v)) for k, v in CHANGES if k != "b6"]
    out = out.withColumn("changes", F.array_compact(F.array(*names)))
    return out.select("project", "path", "content", "changes", (F.size("changes") > 0).alias("modified"))


def summary(rewritten: DataFrame) -> DataFrame:
    return rewritten.agg(F.count("*").alias("files"), F.count_if("modified").alias("modified"), F.sum(F.size("changes")).cast("long").alias("changes"))
