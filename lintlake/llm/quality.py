"""Operator 4, quality rules: thresholds from mergeable quantile sketches per language and source."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from .common import cut, whole

#: Rates of a text that are judged, each a whole number of thousandths.
METRICS = ("symbol_rate", "dup_line_rate", "repeat_rate", "word_length")
#: A rate is an outlier above q75 + FENCE * (q75 - q25), or, where both are equal, above the REST of 100 quantile.
FENCE, REST = 3, 98
#: A group's sketch is its own and so many documents' worth of its language's: small groups lean on that.
PRIOR = 100

WHITE = "\t\n\x0b\x0c\r "
SYMBOLS = "#*$%&|<>"


def _repeats(words: list[bytes]) -> int:
    """Words that lie in a 5-word window found twice or more in the text."""
    n = len(words) - 4
    if n < 2:
        return 0
    number: dict[bytes, int] = {}
    ids = np.fromiter((number.setdefault(w, len(number)) for w in words), np.int64, len(words))
    k = len(number)
    if k == len(words):
        return 0
    if k < 6000:  # k^5 fits in 63 bits
        code = (((ids[:n] * k + ids[1 : n + 1]) * k + ids[2 : n + 2]) * k + ids[3 : n + 3]) * k + ids[4 : n + 4]
    else:
        two = np.unique(ids[:-1] * k + ids[1:], return_inverse=True)[1].astype(np.int64)
        four = np.unique(two[:-2] * len(two) + two[2:], return_inverse=True)[1].astype(np.int64)
        code = four[:n] * k + ids[4 : n + 4]
    order = np.sort(code)
    twice = order[1:][order[1:] == order[:-1]]
    if not len(twice):
        return 0
    at = np.searchsorted(twice, code)
    hit = (at < len(twice)) & (twice[np.minimum(at, len(twice) - 1)] == code)
    edges = np.zeros(len(words) + 1, np.int64)
    starts = np.flatnonzero(hit)
    np.add.at(edges, starts, 1)
    np.add.at(edges, starts + 5, -1)
    return int((np.cumsum(edges)[:-1] > 0).sum())


def features_of(text: str | None) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words of one text (null: none)."""
    if not text:
        return 0, 0, 0, 0, 0
    words = text.encode("utf-8", "surrogatepass").split()
    seen: set[str] = set()
    dups = 0
    if "\n" in text:
        for line in text.split("\n"):
            if line in seen:
                dups += 1
            elif line.strip(WHITE):
                seen.add(line)
    chars = len(text) - sum(text.count(c) for c in WHITE)
    return len(words), chars, sum(text.count(c) for c in SYMBOLS), dups, _repeats(words)


COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


@F.pandas_udf(StructType([StructField(c, LongType()) for c in COUNTS]))
def features(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
    for part in texts:
        yield pd.DataFrame([features_of(x) for x in part], columns=COUNTS)


def _per(n: Column, of: Column) -> Column:
    return F.when(of > 0, F.floor(n * 1000 / of)).otherwise(0).cast("long")


def rates(f: Column, n_lines: Column) -> dict[str, Column]:
    """A first symbol or repeated line isn't counted: one of a kind is no rate, and a clean group doesn't reject it."""
    w = f["n_words"]
    past = lambda n: F.greatest(n - 1, F.lit(0))
    return {
        "symbol_rate": _per(past(f["n_symbols"]), w),
        "dup_line_rate": _per(past(f["n_dup_lines"]), n_lines),
        "repeat_rate": _per(f["n_repeat_words"], w),
        "word_length": _per(f["word_chars"], w),
    }


def base_failed(f: Column) -> Column:
    return (f["n_words"] < 10) | (f["n_repeat_words"] * 100 > f["n_words"] * 20)


def measured(docs: DataFrame, row: Column | None = None) -> DataFrame:
    """row (by default all of it), lang, source, f (counts), r (rates) and failed (the base rule) for each of ``docs``."""
    lines = F.coalesce(F.regexp_count("text", F.lit("\n")) + 1, F.lit(0))
    d = docs.select((whole(docs) if row is None else row).alias("row"), "lang", "source", features("text").alias("f"), lines.alias("n_lines"))
    f = F.col("f")
    r = F.struct(*[v.alias(k) for k, v in rates(f, F.col("n_lines")).items()])
    return d.select("row", "lang", "source", "f", r.alias("r"), base_failed(f).alias("failed"))


def _shift(v: Column) -> Column:
    return F.greatest(F.length(F.bin(v)) - 6, F.lit(0))


def bin_of(v: Column) -> Column:
    """A whole number with all bits but the first six cleared: relative error under 1/32, 1,900 bins at most."""
    shift = _shift(v)
    return F.call_function("shiftleft", F.call_function("shiftright", v, shift), shift)


def sketches(d: DataFrame) -> DataFrame:
    """Quantile sketches: (lang, source, metric, bin, n) for documents that pass the base rule.

    A histogram over bin_of: sketches merge by adding n, in any order, to the same result. Each map
    task sends at most one row for each group, metric and bin, so no group is gathered anywhere.
    """
    rows = F.explode(F.array(*[F.struct(F.lit(m).alias("metric"), bin_of(F.col(f"r.{m}")).alias("bin")) for m in METRICS]))
    return d.where("not failed").select("lang", "source", rows.alias("x")).groupBy("lang", "source", "x.metric", "x.bin").agg(F.count("*").alias("n"))


def shrunk(sketch: DataFrame, prior: int = PRIOR) -> DataFrame:
    """Each group's sketch merged with ``prior`` documents' worth of its language's: (lang, source, metric, bin, n decimal).

    Counts are scaled by the language's documents, so that they stay whole numbers and merge exactly.
    """
    exact = lambda c: F.col(c).cast("decimal(19,0)")
    lang = sketch.groupBy(F.col("lang").alias("__lang"), F.col("metric").alias("__m"), "bin").agg(F.sum("n").alias("n"))
    size = lang.groupBy("__lang", "__m").agg(F.sum("n").alias("__size"))
    of = F.col("lang").eqNullSafe(F.col("__lang")) & (F.col("metric") == F.col("__m"))
    own = sketch.join(size, of).select("lang", "source", "metric", "bin", (exact("n") * exact("__size")).alias("n"))
    groups = sketch.select("lang", "source", "metric").distinct()
    lent = groups.join(lang, of).select("lang", "source", "metric", "bin", (exact("n") * F.lit(prior).cast("decimal(19,0)")).alias("n"))
    return own.unionByName(lent).groupBy("lang", "source", "metric", "bin").agg(F.sum("n").cast("decimal(38,0)").alias("n"))


def _top(v: Column) -> Column:
    """The highest number of a bin. Limits are made of these, so that a bin's width never counts against a document."""
    return v + F.call_function("shiftleft", F.lit(1).cast("long"), _shift(v)) - 1


def thresholds(sketch: DataFrame) -> DataFrame:
    """One row for each (lang, source) of ``sketch``, a column of each metric: its highest accepted rate.

    From quantiles of the group's shrunk sketch: the fence above its quartiles, or, where most of the group has one
    and the same rate and the quartiles are equal, the end of a high quantile's bin.
    """
    group = Window.partitionBy("lang", "source", "metric")
    upto = F.sum("n").over(group.orderBy("bin").rowsBetween(Window.unboundedPreceding, 0))
    q = shrunk(sketch).select("lang", "source", "metric", "bin", upto.cast("decimal(38,0)").alias("upto"), F.sum("n").over(group).cast("decimal(38,0)").alias("docs"))
    at = lambda part: F.min(F.when(F.col("upto") * 100 >= F.col("docs") * part, F.col("bin")))
    q = q.groupBy("lang", "source", "metric").agg(at(25).alias("q25"), at(75).alias("q75"), at(REST).alias("rest"))
    high = _top(F.col("q75"))
    up = F.when(F.col("q75") > F.col("q25"), high + FENCE * (high - F.col("q25"))).otherwise(_top(F.col("rest")))
    return q.groupBy(F.col("lang").alias("t_lang"), F.col("source").alias("t_source")).agg(*[F.max(F.when(F.col("metric") == m, up)).alias(f"t_{m}") for m in METRICS])


def judged(d: DataFrame, limits: DataFrame) -> DataFrame:
    """Adds kept: passes the base rule and no rate is above its group's threshold."""
    on = F.col("lang").eqNullSafe(F.col("t_lang")) & F.col("source").eqNullSafe(F.col("t_source"))
    fits = F.lit(True)
    for m in METRICS:
        fits = fits & (F.col(f"r.{m}") <= F.coalesce(F.col(f"t_{m}"), F.lit(1 << 60)))
    return d.join(limits, on, "left").withColumn("kept", ~F.col("failed") & fits)


def keep(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` (text, lang, source, ...) that pass, with the columns of ``docs``.

    Null and empty texts have no words and fail the base rule. A null language or source is a group
    like any other. Repeated rows count and are judged one by one; an empty table gives an empty one.
    Texts are counted once and written beside their counts. The limits are written too, so that their
    size is known before the join, and texts are not shuffled for it.
    """
    d = cut(measured(docs))
    return judged(d, cut(thresholds(sketches(d)))).where("kept").select("row.*")


def scored(docs: DataFrame) -> DataFrame:
    """doc_id, the counts, base_failed and kept for every row of ``docs``; texts are read once."""
    slim = cut(measured(docs, F.struct("doc_id")))
    out = judged(slim, thresholds(sketches(slim)))
    return out.select("row.doc_id", "f.*", F.col("failed").alias("base_failed"), "kept", "lang", "source")


_BIN = "(({0} >> greatest(length(bin({0})) - 6, 0)) << greatest(length(bin({0})) - 6, 0))"
_TOP = "({0} + (1 << greatest(length(bin({0})) - 6, 0)) - 1)"
ORACLE_SQL = rf"""
with w as (select rowid_ as r, regexp_extract_all(text, '[^\x20\x09-\x0D]+') as ws from (select row_number() over () as rowid_, text from documents)),
d0 as (select row_number() over () as r, doc_id, text, lang, source from documents),
g as (select r, i, ws[i] || ' ' || ws[i+1] || ' ' || ws[i+2] || ' ' || ws[i+3] || ' ' || ws[i+4] as g
  from (select r, ws, unnest(range(1, len(ws) - 3)) as i from w where len(ws) >= 5)),
h as (select r, i, count(*) over (partition by r, g) as n from g),
rep as (select r, count(distinct i + o) as n_repeat_words from h, (select unnest(range(5)) as o) where n > 1 group by r),
lines as (select r, l, row_number() over (partition by r, l) as k from (select r, unnest(string_split(text, chr(10))) as l from d0 where text is not null)
  where regexp_matches(l, '[^\x20\x09-\x0D]')),
dup as (select r, count(*) filter (k > 1) as n_dup_lines from lines group by r),
f as (
  select d0.r, doc_id, lang, source, coalesce(len(ws), 0)::bigint as n_words, coalesce(length(array_to_string(ws, '')), 0)::bigint as word_chars,
    coalesce(length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')), 0)::bigint as n_symbols, coalesce(n_dup_lines, 0)::bigint as n_dup_lines,
    coalesce(n_repeat_words, 0)::bigint as n_repeat_words, coalesce(len(string_split(text, chr(10))), 0) as n_lines
  from d0 left join w using (r) left join rep using (r) left join dup using (r)),
m as (
  select *, (n_words < 10 or 100 * n_repeat_words > 20 * n_words) as base_failed,
    case when n_words > 0 then greatest(n_symbols - 1, 0) * 1000 // n_words else 0 end as symbol_rate,
    case when n_lines > 0 then greatest(n_dup_lines - 1, 0) * 1000 // n_lines else 0 end as dup_line_rate,
    case when n_words > 0 then n_repeat_words * 1000 // n_words else 0 end as repeat_rate,
    case when n_words > 0 then word_chars * 1000 // n_words else 0 end as word_length from f),
s as (
  select lang, source, metric, b, count(*)::hugeint as n from (
    select lang, source, 'symbol_rate' as metric, {_BIN.format("symbol_rate")} as b from m where not base_failed
    union all select lang, source, 'dup_line_rate', {_BIN.format("dup_line_rate")} from m where not base_failed
    union all select lang, source, 'repeat_rate', {_BIN.format("repeat_rate")} from m where not base_failed
    union all select lang, source, 'word_length', {_BIN.format("word_length")} from m where not base_failed) group by all),
la as (select lang, metric, b, sum(n)::hugeint as n from s group by all),
ls as (select lang, metric, sum(n)::hugeint as size from la group by all),
sh as (
  select lang, source, metric, b, sum(n)::hugeint as n from (
    select s.lang, source, s.metric, b, n * size as n from s join ls on s.lang is not distinct from ls.lang and s.metric = ls.metric
    union all
    select g.lang, source, g.metric, b, n * {PRIOR} from (select distinct lang, source, metric from s) g
      join la on g.lang is not distinct from la.lang and g.metric = la.metric) group by all),
u as (
  select lang, source, metric, b, (sum(n) over (partition by lang, source, metric order by b rows between unbounded preceding and current row))::hugeint as upto,
    (sum(n) over (partition by lang, source, metric))::hugeint as docs from sh),
q as (
  select lang, source, metric, min(case when upto * 100 >= docs * 25 then b end) as q25, min(case when upto * 100 >= docs * 75 then b end) as q75,
    min(case when upto * 100 >= docs * {REST} then b end) as rest from u group by all),
t as (
  select lang, source, metric, case when q75 > q25 then {_TOP.format("q75")} + {FENCE} * ({_TOP.format("q75")} - q25) else {_TOP.format("rest")} end as up from q),
p as (select lang, source, max(up) filter (metric = 'symbol_rate') as a, max(up) filter (metric = 'dup_line_rate') as b,
    max(up) filter (metric = 'repeat_rate') as c, max(up) filter (metric = 'word_length') as e from t group by lang, source)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  (not base_failed and symbol_rate <= coalesce(a, 1 << 30) and dup_line_rate <= coalesce(b, 1 << 30)
    and repeat_rate <= coalesce(c, 1 << 30) and word_length <= coalesce(e, 1 << 30)) as kept, m.lang, m.source
from m left join p on m.lang is not distinct from p.lang and m.source is not distinct from p.source
"""
