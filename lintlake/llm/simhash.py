"""Operator 5, SimHash near-duplicates by covering locality-sensitive hashing."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StructField, StructType

from . import common

SHINGLE, SEED, BITS = 3, 42, 64
#: Fingerprints that differ in so many bits or fewer are linked.
RADIUS = 3
#: Fingerprints of a bucket that are compared in one task; larger buckets are cut into blocks of this size.
BLOCK = 1024


def fingerprint(text: str | None) -> int:
    """The text's SimHash as an unsigned number; zero without a word.

    Words are cut as bytes: UTF-8 keeps ASCII apart, and bytes.lower() changes A-Z alone.
    """
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    digest = xxhash.xxh64_intdigest
    if len(words) <= SHINGLE:
        return digest(joined, SEED)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = np.concatenate(([0], ends[:-1] + 1)).tolist()
    n = len(words) - SHINGLE + 1
    pairs = zip(starts, ends[SHINGLE - 1 :].tolist(), strict=False)
    hashes = np.fromiter((digest(joined[a:b], SEED) for a, b in pairs), np.uint64, n)
    counts = np.zeros(BITS, np.int64)
    for at in range(0, n, 1 << 16):
        part = hashes[at : at + (1 << 16)]
        counts += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    bits = np.packbits(counts * 2 > n, bitorder="little")
    return int(bits.view(np.uint64)[0])


@F.pandas_udf(LongType())
def fingerprints(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for part in texts:
        yield pd.Series(np.array([fingerprint(x) for x in part], np.uint64).view(np.int64))


def masks() -> list[int]:
    """2^(RADIUS+1) - 1 masks of the bits; any two words within RADIUS agree on all bits of one mask.

    Covering LSH (Pagh 2016): bit i gets a nonzero vector m(i) of RADIUS + 1 bits; mask v holds the
    bits whose m(i) has an odd product with v. RADIUS vectors span less than the whole space, so some
    v is orthogonal to the vectors of all differing bits: none of them is in its mask.
    """
    n = 1 << (RADIUS + 1)
    m = [i % (n - 1) + 1 for i in range(BITS)]
    return [sum(1 << i for i in range(BITS) if (m[i] & v).bit_count() % 2) for v in range(1, n)]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >= 1 << 63 else x


def forest(values: np.ndarray) -> list[tuple[int, int]]:
    """Links that connect the same values as all links within RADIUS: one for each value but a root."""
    v = values.view(np.uint64)
    left, out = np.ones(len(v), bool), []
    for root in range(len(v)):
        if not left[root]:
            continue
        left[root] = False
        queue = [root]
        while queue:
            at = queue.pop()
            near = np.flatnonzero(left & (np.bitwise_count(v ^ v[at]) <= RADIUS))
            left[near] = False
            out += [(int(values[at]), int(values[i])) for i in near]
            queue += near.tolist()
    return out


@F.pandas_udf(ArrayType(StructType([StructField("a", LongType()), StructField("b", LongType())])))
def forests(groups: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for part in groups:
        yield pd.Series([[{"a": a, "b": b} for a, b in forest(np.array(x, np.int64))] for x in part])


def links(prints: DataFrame) -> DataFrame:
    """Links (a, b) among distinct fingerprints ``prints`` (fp long) that join all within RADIUS.

    Each fingerprint is dealt to one bucket of each mask's table. Buckets of one are dropped after a
    count that is aggregated map-side. The others are compared inside, BLOCK by BLOCK: a bucket of k
    blocks becomes its k * (k + 1) / 2 pairs of blocks, each a small group of its own, so that no task
    holds a large bucket. What comes out is a forest, not all pairs.
    """
    keys = F.array(*[F.xxhash64(F.lit(t), F.col("fp").bitwiseAND(F.lit(_signed(m)).cast("long"))) for t, m in enumerate(masks())])
    dealt = prints.select("fp", F.explode(keys).alias("bucket"))
    shared = dealt.groupBy("bucket").agg(F.count("*").alias("n")).where("n > 1")
    both = dealt.join(shared, "bucket")
    blocks = F.ceil(F.col("n") / BLOCK).cast("int")
    own = F.pmod(F.xxhash64("fp", F.lit(7)), blocks).cast("int")
    both = both.select("fp", "bucket", own.alias("own"), F.explode(F.sequence(F.lit(0), blocks - 1)).alias("other"))
    group = both.groupBy("bucket", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"))
    found = group.agg(F.collect_set("fp").alias("fps")).where(F.size("fps") > 1)
    return found.select(F.explode(forests("fps")).alias("x")).select("x.a", "x.b")


def clustered(prints: DataFrame) -> DataFrame:
    """``prints`` (doc_id, fp) with component_id: the smallest doc_id that links reach, itself included.

    Equal fingerprints are one node, named by its smallest doc_id, so copies are never paired. Rows of
    one doc_id are linked to each other. Rows without a doc_id join no groups; they get the component
    of their fingerprint if a row with an id has it, else null.
    """
    first = common.cut(prints.where("doc_id is not null").groupBy("fp").agg(F.min("doc_id").alias("first")))
    name = first.select(F.col("fp").alias("a"), F.col("first").alias("fa"))
    name2 = first.select(F.col("fp").alias("b"), F.col("first").alias("fb"))
    found = links(first.select("fp")).distinct().join(name, "a").join(name2, "b").select(F.col("fa").alias("a"), F.col("fb").alias("b"))
    ids = prints.where("doc_id is not null").groupBy("doc_id").agg(F.min("fp").alias("x"), F.max("fp").alias("y")).where("x != y").select("doc_id")
    again = prints.join(ids, "doc_id").join(first, "fp").select(F.col("doc_id").alias("a"), F.col("first").alias("b"))
    comp = common.components(found.unionByName(again))
    named = first.join(comp, F.col("first") == F.col("node"), "left").select(F.col("fp").alias("__fp"), F.coalesce("component", "first").alias("component_id"))
    return prints.join(named, F.col("fp") == F.col("__fp"), "left").drop("__fp")


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id for every row of ``docs`` (doc_id, text).

    Null, empty and white-space texts have fingerprint zero and are linked like any other. An empty
    table gives an empty result. Other columns are not read.
    """
    prints = common.cut(docs.select("doc_id", fingerprints("text").alias("fp")))
    digits = F.lpad(F.lower(F.hex("fp")), 16, "0")
    return clustered(prints).select("doc_id", digits.alias("fingerprint"), "component_id")


def one_of_each(docs: DataFrame) -> DataFrame:
    """``docs`` with one row of each group of near-duplicates: that of the smallest doc_id.

    Of repeated rows of one doc_id one stays (that with the smallest text hash). Rows without a doc_id
    go if a row with an id has their fingerprint; of those with a fingerprint that no id has, one stays
    (likewise). Columns are those of ``docs``; an empty table gives an empty one.
    """
    prints = common.cut(docs.select("doc_id", fingerprints("text").alias("fp")))
    found = clustered(prints.where("doc_id is not null"))
    rows = docs.select(common.whole(docs).alias("row"), "doc_id", F.xxhash64("text").alias("h"))
    gone = found.where("doc_id != component_id").select("doc_id").distinct()
    twice = prints.where("doc_id is not null").groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1").select("doc_id", F.lit(True).alias("twice"))
    marked = rows.where("doc_id is not null").join(gone, "doc_id", "left_anti").join(twice, "doc_id", "left")

    def smallest(d: DataFrame, key: str) -> DataFrame:
        order = Window.partitionBy(key).orderBy("h")
        return d.withColumn("k", F.row_number().over(order)).where("k = 1").select("row.*")

    single = marked.where("twice is null").select("row.*")
    repeated = smallest(marked.where("twice"), "doc_id")
    known = prints.where("doc_id is not null").select("fp").distinct()
    loose = docs.where("doc_id is null").select(common.whole(docs).alias("row"), F.xxhash64("text").alias("h"), fingerprints("text").alias("fp"))
    return single.unionByName(repeated).unionByName(smallest(loose.join(known, "fp", "left_anti"), "fp"))
