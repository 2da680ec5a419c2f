"""The scan kernel: files to positioned lines with their regions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lintlake.functions.text import matches, quote, re2, sql_trim, sql_trim_start

#: Lines of an element that are looked at, and lines above an import's end.
ELEMENT, IMPORT = 5, 10


def explode_lines(files: DataFrame, joined: bool = False) -> DataFrame:
    """project, path, line (from 1), text; the content is dropped here, so that lines don't carry it along.

    joined: also ahead, the lines after one whose tags stay open, and behind, those before one that ends an import of an
    environment module: arrays, null on all other lines. They are cut from the file's lines before these leave the row.
    """
    d = files.select("project", "path", F.split("content", "\n", -1).alias("lines")).select("project", "path", "lines", F.posexplode("lines").alias("at", "text"))
    text, at, line = F.col("text"), F.col("at"), (F.col("at") + 1).alias("line")
    if not joined:
        return d.select("project", "path", line, "text")
    # no function of arrays stands here that Spark doesn't compile: rows would be copied with all lines of their file
    ahead = F.when(F.contains(text, F.lit("<")) & (_opens(text) > 0), F.slice("lines", at + 2, F.lit(ELEMENT - 1)))
    above = F.least(at, F.lit(IMPORT))
    behind = F.when(F.contains(text, F.lit("from")) & F.contains(text, F.lit("$env")), F.slice("lines", at + 1 - above, above))
    return d.select("project", "path", line, "text", ahead.alias("ahead"), behind.alias("behind"))


def is_comment(text: Column) -> Column:
    return (F.contains(text, F.lit("//")) | F.contains(text, F.lit("*"))) & matches(text, r"^\s*(?:\/\/|\/?\*)")


def opens_region(text: Column, name: str) -> Column:
    """The line without space around it begins with the tag, and the tag's name ends on it."""
    return matches(text, rf"^\s*<{name}(?:>|\s+\S)")


def closes_region(text: Column, name: str) -> Column:
    """The line without space around it is the end tag."""
    return matches(text, rf"^\s*<\/{name}>\s*$")


def _state(marker: Column, window) -> Column:
    return F.coalesce(F.last(marker, ignorenulls=True).over(window), F.lit(0))


def with_regions(lines: DataFrame) -> DataFrame:
    """Adds in_script, in_instance, in_style (0/1), style_marker, is_comment, script_no: how many script tags' lines come up to here.

    Of lines with ahead and behind also element, the tag that starts on a line with a ``<``, put together; import_up, import_text:
    how far above the import starts that ends on a line with an environment module, and its text.
    One shuffle and one sort on (project, path) serve all windows. A region's marker lines are outside.
    An opening line that names a module leaves the state of in_instance as it is.
    """
    text = F.col("text")
    module = matches(text, r"\bmodule\b") | text.contains('context="module"')
    tagged = lambda name: F.when(opens_region(text, name), 1).when(closes_region(text, name), 0)
    d = lines.select("*", tagged("script").alias("__s"), tagged("style").alias("__y"), is_comment(text).alias("is_comment"))
    d = d.withColumn("__i", F.when((F.col("__s") == 0) | ~module, F.col("__s")))
    upto = Window.partitionBy("project", "path").orderBy("line").rowsBetween(Window.unboundedPreceding, 0)
    inside = lambda m: F.when(F.col(m).isNotNull(), 0).otherwise(_state(F.col(m), upto))
    d = d.select(
        "*", inside("__s").alias("in_script"), inside("__i").alias("in_instance"), inside("__y").alias("in_style"),
        F.col("__y").isNotNull().alias("style_marker"), F.count("__s").over(upto).cast("int").alias("script_no"),
    )
    if "ahead" in lines.columns:
        block = import_block(text, F.col("behind"))
        element = F.when(F.contains(text, F.lit("<")), F.when(F.col("ahead").isNull(), text).otherwise(element_text(text, F.col("ahead"))))
        d = d.withColumns({"element": element, "import_up": F.when(F.col("behind").isNotNull(), block["up"]), "import_text": F.when(F.col("behind").isNotNull(), block["text"])})
    return d.drop("__s", "__i", "__y", "ahead", "behind")


def _opens(text: Column) -> Column:
    """How many more tags are opened than closed."""
    return F.octet_length(F.replace(text, F.lit(">"), F.lit(""))) - F.octet_length(F.replace(text, F.lit("<"), F.lit("")))


def element_text(text: Column, ahead: Column) -> Column:
    """The element that starts on a line: lines ``ahead`` are joined to it by a space, up to where its tags are closed."""
    start = F.struct(text.alias("text"), _opens(text).alias("open"))
    step = lambda s, t: F.when(s["open"] > 0, F.struct(F.concat_ws(" ", s["text"], t).alias("text"), (s["open"] + _opens(t)).alias("open"))).otherwise(s)
    return F.aggregate(ahead, start, step, lambda s: s["text"])


def import_block(text: Column, behind: Column) -> Column:
    """The import that ends on a line: up, how many of the lines ``behind`` it takes in, and its text."""
    begins = lambda t: matches(t, r"\bimport\s*\{")
    found = F.array_position(F.reverse(F.transform(behind, begins)), F.lit(True)).cast("int")
    up = F.when(begins(text), 0).otherwise(found)
    return F.struct(up.alias("up"), F.when(up == 0, text).otherwise(F.concat_ws(" ", F.slice(behind, F.size(behind) - up + 1, up), text)).alias("text"))


def inside_string(text: Column, position: Column) -> Column:
    """An odd number of one kind of quote stands left of ``position``."""
    left = F.substring(text, F.lit(1), position - 1)
    odd = lambda q: (F.length(left) - F.length(F.translate(left, q, ""))) % 2 != 0
    return odd("'") | odd('"') | odd("`")


_T, _OPEN, _MODULE, _STYLE = sql_trim("text"), re2(r"^<script[\s>]"), re2(r"\bmodule\b"), re2(r"^<style[\s>]")
_UPTO = "over (partition by project, path order by line rows between unbounded preceding and current row)"

LINES_SQL = f"""
lines0 as (select project, path, generate_subscripts(string_split(content, chr(10)), 1)::int as line, unnest(string_split(content, chr(10))) as text from files),
lines1 as (select *, {_T} as t, {sql_trim_start("text")} as ts from lines0),
lines2 as (select *, case when regexp_matches(t, {quote(_OPEN)}) then 1 when t = '</script>' then 0 end as s,
    case when regexp_matches(t, {quote(_OPEN)}) and not (regexp_matches(text, {quote(_MODULE)}) or contains(text, 'context="module"')) then 1 when t = '</script>' then 0 end as i,
    case when regexp_matches(t, {quote(_STYLE)}) then 1 when t = '</style>' then 0 end as y,
    (starts_with(ts, '//') or starts_with(ts, '*') or starts_with(ts, '/*')) as is_comment from lines1),
lines as (select project, path, line, text, ts, is_comment, y is not null as style_marker,
    case when s is not null then 0 else coalesce(last_value(s ignore nulls) {_UPTO}, 0) end as in_script,
    case when i is not null then 0 else coalesce(last_value(i ignore nulls) {_UPTO}, 0) end as in_instance,
    case when y is not null then 0 else coalesce(last_value(y ignore nulls) {_UPTO}, 0) end as in_style from lines2)"""
