"""Operator 9, mixing sources to target weights along a time-varying curriculum."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import common

#: Weights of the sources in code point order, null last, over and over.
WEIGHTS = (1, 2, 3)
#: A document is taken so many times at most.
MOST = 3
#: How far a source's rate moves over the training run, as a part of its mean rate.
SLOPE = 0.5
#: Parts that a source's documents are dealt to, for running sums without one large group.
PARTS = 512


def targets(sizes: DataFrame) -> DataFrame:
    """source, source_size, target, slope for each source of ``sizes`` (source string, size long).

    The words of all sources are shared by weight; a target stops at MOST times its source's size and
    the rest is shared anew. That is filling up with one level: target = least(cap, level * weight),
    where sources reach their cap in order of cap / weight. One row per source is all that is windowed.
    """
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    rank = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in WEIGHTS]), (F.pmod(rank, F.lit(len(WEIGHTS))) + 1).cast("int"))
    # a third of the sources grow, a third stay, a third shrink over the run
    slope = (F.pmod(rank, F.lit(3)) - 1).cast("double") * SLOPE
    per = per.select("source", "source_size", weight.alias("w"), slope.alias("slope"), (F.lit(float(MOST)) * F.col("source_size")).alias("cap"))
    order = Window.orderBy((F.col("cap") / F.col("w")), "source")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy()
    full = F.sum("source_size").over(everything) - F.coalesce(F.sum("cap").over(before), F.lit(0.0))
    free = F.sum("w").over(order.rowsBetween(Window.currentRow, Window.unboundedFollowing))
    per = per.withColumn("level", F.when(F.col("cap") * free > full * F.col("w"), full / free))
    # the level of the first source that doesn't reach its cap holds for all later ones
    per = per.withColumn("level", F.first("level", ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    target = F.coalesce(F.least(F.col("cap"), F.col("level") * F.col("w")), F.col("cap"))
    return per.select("source", "source_size", target.alias("target"), "slope")


def sized(docs: DataFrame, row: Column) -> DataFrame:
    """row, doc_id, source, size (words of the text, null: 0) and u (a fixed random order of the rows) for each of ``docs``."""
    size = F.coalesce(F.regexp_count("text", F.lit(common.WORD)), F.lit(0)).cast("long")
    order = F.conv(F.substring(F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 1, 15), 16, 10).cast("long")
    return docs.select(row.alias("row"), "doc_id", "source", size.alias("size"), order.alias("u"))


def position(words, target, slope):
    """When (0 to 1) a source has been asked for so many of its words.

    Its rate is target * (1 + slope * (2t - 1)); integrated, its demand up to t is
    target * ((1 - slope) * t + slope * t^2), which this inverts.
    """
    x, b = F.least(words / target, F.lit(1.0)), F.lit(1.0) - slope
    root = F.sqrt(F.greatest(b * b + F.lit(4.0) * slope * x, F.lit(0.0)))
    return F.when(target <= 0, 0.0).when(F.abs(slope) < 1e-9, x).otherwise((root - b) / (F.lit(2.0) * slope))


def allot(d: DataFrame, goal: DataFrame) -> DataFrame:
    """``d`` (sized()) with source_size, target, slope, before, rounds and taken; ``goal``: targets(), written, so that its size is known.

    A source's documents stand in a random order that depends on the id alone (md5). Its target is taken
    from that order again and again: whole rounds, then the head of the order, whose last document is
    cut. So a source's words taken are its target rounded down, none is taken over MOST times, and
    reruns agree. Null texts and texts without a word have size 0 and give 0 words. A null source is a
    source of its own, last in order. Repeated rows take neighbouring places; each counts by itself.
    """
    # the order's first bits, so that buckets follow the order
    d = common.with_running(d, ["source"], [F.col("u"), F.col("doc_id")], F.col("size"), "before", F.shiftright(F.col("u"), 60 - PARTS.bit_length() + 1))
    d = d.join(goal.withColumnRenamed("source", "of"), F.col("source").eqNullSafe(F.col("of"))).drop("of")
    whole = F.floor(F.col("target")).cast("long")
    rounds = F.when(F.col("source_size") > 0, F.floor(whole / F.col("source_size"))).otherwise(0).cast("long")
    d = d.withColumn("rounds", rounds).withColumn("rest", whole - F.col("rounds") * F.col("source_size"))
    last = F.least(F.greatest(F.col("rest") - F.col("before"), F.lit(0)), F.col("size"))
    return d.withColumn("taken", F.col("rounds") * F.col("size") + last)


def mixed(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, size, source_size, target, taken, source, first_position; range-sorted by it.

    first_position: the place (0 to 1) in training of its first copy; null if none is taken.
    """
    slim = common.cut(sized(docs, F.lit(0)))
    d = allot(slim, common.cut(targets(slim)))
    first = F.when(F.col("taken") > 0, position(F.col("before").cast("double"), F.col("target"), F.col("slope")))
    return d.select(
        "doc_id", "size", "source_size", "target", "taken", "source", first.alias("first_position")
    ).repartitionByRange("first_position", "doc_id").sortWithinPartitions("first_position", "doc_id")


def curriculum(docs: DataFrame, place: str | None = None) -> DataFrame:
    """The training rows: ``docs``' columns, one row for each copy taken, range-sorted by training position.

    A copy that the target cuts keeps the text's head with just the words taken. n_chars, if there, is
    set to the new length. ``place`` names a further column, the position (0 to 1). Texts move twice: to their place in their source's order, and to their positions, where they are cut.
    """
    d = allot(sized(docs, common.whole(docs)), common.cut(targets(docs.select("source", F.coalesce(F.regexp_count("text", F.lit(common.WORD)), F.lit(0)).cast("long").alias("size")))))
    last = F.col("taken") - F.col("rounds") * F.col("size")
    copies = (F.col("rounds") + F.when(last > 0, 1).otherwise(0)).cast("int")
    d = d.where("taken > 0").withColumn("copy", F.explode(F.sequence(F.lit(1), copies)))
    n = F.when(F.col("copy") <= F.col("rounds"), F.col("size")).otherwise(last)
    asked = ((F.col("copy") - 1) * F.col("source_size") + F.col("before")).cast("double")
    d = d.select("row", "doc_id", "size", n.alias("n"), position(asked, F.col("target"), F.col("slope")).alias("position"))
    d = d.repartitionByRange("position", "doc_id").sortWithinPartitions("position", "doc_id")
    own = F.col("row.text")
    head = F.regexp_extract(own, r"^(?s:[\x20\x09-\x0D]*)", 0)
    words = F.regexp_extract_all(own, F.lit(common.WORD + r"[\x20\x09-\x0D]*"), F.lit(0))
    short = F.concat(head, F.regexp_replace(F.array_join(F.slice(words, 1, F.col("n").cast("int")), ""), r"[\x20\x09-\x0D]+\z", ""))
    text = F.when(F.col("n") < F.col("size"), short).otherwise(own)
    out = {"text": text, "n_chars": F.char_length(text).cast("long")}
    return d.select(*[out.get(c, F.col("row")[c]).alias(c) for c in docs.columns], *([F.col("position").alias(place)] if place else []))


ORACLE_SQL = r"""
with d as (
  select doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::bigint as size,
    ('0x' || substr(md5(coalesce(doc_id::varchar, '')), 1, 15))::bigint as u
  from documents),
p as (
  select source, sum(size)::bigint as source_size, 3.0::double * sum(size)::double as cap,
    row_number() over (order by source nulls last) - 1 as r from d group by source),
w as (select *, ((r % 3) + 1)::double as w, ((r % 3) - 1)::double * 0.5::double as slope from p),
f as (
  select *, (sum(source_size) over ())::double - coalesce(sum(cap) over (order by cap / w, source rows between unbounded preceding and 1 preceding), 0) as full_,
    sum(w) over (order by cap / w, source rows between current row and unbounded following) as free_ from w),
v as (select *, case when cap * free_ > full_ * w then full_ / free_ end as level from f),
t as (
  select *, coalesce(least(cap, first_value(level ignore nulls) over (order by cap / w, source rows between unbounded preceding and current row) * w), cap) as target
  from v),
b as (
  select d.doc_id, d.size, d.source, t.source_size, t.target, t.slope,
    coalesce(sum(d.size) over (partition by d.source order by u, d.doc_id rows between unbounded preceding and 1 preceding), 0)::bigint as before,
    case when t.source_size > 0 then floor(floor(t.target) / t.source_size) else 0 end::bigint as rounds
  from d join t on d.source is not distinct from t.source),
k as (
  select *, (rounds * size + least(greatest(floor(target)::bigint - rounds * source_size - before, 0), size))::bigint as taken,
    least(before::double / target, 1.0::double) as x, 1.0::double - slope as b from b)
select doc_id, size, source_size, target, taken, source,
  case when taken > 0 then case when abs(slope) < 1e-9 then x
    else (sqrt(greatest(b * b + 4.0::double * slope * x, 0.0::double)) - b) / (2.0::double * slope) end end as first_position
from k
"""
