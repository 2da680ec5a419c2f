"""What the operators share: words, tables cut off from their lineage, ranks in hot groups."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lintlake.sources.shared import forget, written as cut  # noqa: F401

#: A word: a run of characters other than ASCII white space. bytes.split() cuts alike.
WORD = r"[^\x20\x09-\x0D]+"


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def free(taken: Iterable[str], *names: str) -> list[str]:
    """Names for columns of an operator's own: like ``names``, but none of those taken, whatever their case."""
    held = {c.lower() for c in taken}
    out = []
    for name in names:
        name = f"__{name}"
        while name.lower() in held:
            name += "_"
        held.add(name.lower())
        out.append(name)
    return out


def whole(df: DataFrame) -> Column:
    """A row of ``df`` as one column, so that its names can't clash with an operator's own."""
    return F.struct(*[F.col("`" + c.replace("`", "``") + "`") for c in df.columns])


def with_running(df: DataFrame, group: list[str], order: list[Column], value: Column, name: str, bucket: Column) -> DataFrame:
    """Adds ``name``: the sum of ``value`` over the rows before this one in its group.

    Rows are ordered by ``bucket`` first and ``order`` inside it. A group that holds a third of all
    rows is spread over its buckets: sums per bucket are aggregated map-side, and only those few rows
    meet in one window for each group. Groups are told apart by their values as text and whether they are null, the
    same columns in the window and the join, so that rows are shuffled once for both.
    """
    keys = free(df.columns, *[f"{kind}{i}" for i in range(len(group)) for kind in "kn"], "b")
    b, v, part, before, inside = keys[-1], *free([*df.columns, *keys], "v", "part", "before", "inside")
    told = [c for g in group for c in (F.coalesce(F.col(g).cast("string"), F.lit("")), F.col(g).isNull())]
    d = df.withColumns(dict(zip(keys, [*told, bucket], strict=True)) | {v: value.cast("long")})
    sums = d.groupBy(*keys).agg(F.sum(v).alias(part))
    until = Window.partitionBy(*keys[:-1]).orderBy(b).rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select(*keys, F.coalesce(F.sum(part).over(until), F.lit(0)).alias(before))
    within = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    d = d.withColumn(inside, F.coalesce(F.sum(v).over(within), F.lit(0)))
    return d.join(sums, keys).select(*df.columns, (F.col(before) + F.col(inside)).alias(name))


def components(edges: DataFrame) -> DataFrame:
    """Connected components: (node, component) for every node of an edge; component: its smallest node.

    ``edges``: a long, b long, in either direction. Alternates the large-star and small-star steps of
    Kiveris et al. (2014). Each step is a grouped minimum and a join, so that no node's links are
    gathered anywhere; each round is written to the shared folder. Ends when a round changes nothing.
    """
    now = cut(
        edges.select(F.least("a", "b").alias("lo"), F.greatest("a", "b").alias("hi")).where("lo < hi").distinct()
    )
    mark, old = None, []
    while True:
        both = now.select(F.col("lo").alias("u"), F.col("hi").alias("v")).unionByName(
            now.select(F.col("hi").alias("u"), F.col("lo").alias("v"))
        )
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = (
            both.where("v > u").join(least, "u").select(F.col("m").alias("lo"), F.col("v").alias("hi")).where("lo < hi").distinct()
        )
        small = large.groupBy("hi").agg(F.min("lo").alias("m"))
        stars = (
            large.join(small, "hi").select(F.col("m").alias("lo"), F.greatest("lo", "hi").alias("hi"), F.least("lo", "hi").alias("x"))
        )
        nxt = cut(
            stars.select("lo", F.explode(F.array("hi", "x")).alias("hi")).where("lo < hi").distinct()
        )
        forget(*old)
        old = [now]
        now = nxt
        seen = now.agg(F.count("*"), F.sum(F.xxhash64("lo", "hi").cast("decimal(38,0)"))).first()
        if tuple(seen) == mark:
            break
        mark = tuple(seen)
    members = now.select(F.col("hi").alias("node"), F.col("lo").alias("component"))
    roots = now.select(F.col("lo").alias("node"), F.col("lo").alias("component")).distinct()
    return members.unionByName(roots)
