"""Operator 11, sharding: a Feistel permutation with cycle walking over global row numbers.

Rows are numbered 0 to n - 1 in the order of their key, a keyed permutation of 0 to n - 1 deals the
numbers anew, and a row's new number gives its shard (the remainder by the number of shards) and its
slot there (the quotient). So shards differ by one row at most, slots have no gaps, reruns agree, and
both directions are computed without a lookup: place_of() and row_of().
"""

from __future__ import annotations

import hashlib
from functools import cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, forget, free

SHARDS, SEED = 24, 11
#: Rounds of the network: an even number, so that halves of unequal width end where they began.
ROUNDS = 6
#: Round functions compute modulo this prime (2^31 - 1), so products of two values stay below 2^62.
PRIME = (1 << 31) - 1


@cache
def round_keys(seed: int) -> tuple[tuple[int, int, int, int], ...]:
    """Four numbers for each round, 1 to PRIME - 1, from the seed alone."""
    out = []
    for k in range(ROUNDS):
        raw = hashlib.sha256(f"{seed}:{k}".encode()).digest()
        out.append(tuple(int.from_bytes(raw[8 * i : 8 * i + 8], "big") % (PRIME - 1) + 1 for i in range(4)))
    return tuple(out)


def width(n: int) -> int:
    """Bits of the network's domain: the least that holds ``n`` numbers, at least one for each half."""
    return max(2, (n - 1).bit_length())


def _mixed(half: np.ndarray, key: tuple[int, int, int, int], bits: int) -> np.ndarray:
    a, b, c, d = key
    x = (half * a + b) % PRIME
    x = (x * x + c) % PRIME
    return (x * d % PRIME) & ((1 << bits) - 1)


def _network(x: np.ndarray, bits: int, seed: int, back: bool) -> np.ndarray:
    low = bits // 2
    sizes = [(bits - low, low) if k % 2 == 0 else (low, bits - low) for k in range(ROUNDS)]  # left, right before round k
    keys = round_keys(seed)
    left, right = x >> low, x & ((1 << low) - 1)
    if not back:
        for key, (size, _) in zip(keys, sizes, strict=True):
            left, right = right, left ^ _mixed(right, key, size)
    else:
        for key, (size, _) in zip(reversed(keys), reversed(sizes), strict=True):
            left, right = right ^ _mixed(left, key, size), left
    return (left << low) | right


def permuted(x: np.ndarray, n: int, seed: int = SEED, back: bool = False) -> np.ndarray:
    """Where the permutation of 0 to n - 1 takes each number of ``x``; ``back``: whence it came.

    The network permutes a power of two below 2n (4 if n is under 3). A number that lands at n or above
    is sent through it again until it lands below: along its cycle, so that the result is a permutation.
    """
    out = np.array(x, np.int64)
    if n >> 62:
        raise ValueError("too many rows")
    todo = np.arange(len(out))
    while len(todo):
        out[todo] = _network(out[todo], width(n), seed, back)
        todo = todo[out[todo] >= n]
    return out


def place_of(row: int, n: int, shards: int = SHARDS, seed: int = SEED) -> tuple[int, int]:
    """Shard and slot of a row number."""
    p = int(permuted(np.array([row]), n, seed)[0])
    return p % shards, p // shards


def row_of(shard: int, slot: int, n: int, shards: int = SHARDS, seed: int = SEED) -> int:
    """The row number at a shard's slot."""
    return int(permuted(np.array([slot * shards + shard]), n, seed, back=True)[0])


def numbered(rows: DataFrame, order: list[str], name: str) -> tuple[DataFrame, int]:
    """``rows`` written out with ``name``, their place (from 0) in ``order``, and how many there are.

    Equal rows take neighbouring places in any order, so the result depends on the rows alone, not on
    how they lie in files. A range shuffle sorts them, the rows' own numbers in the table breaking ties, so
    that many equal rows don't meet in one task; a part's first number is the sum of the parts before it. Parts
    are as many as Spark's shuffle partitions at most: that bounds the broadcast and the window over them.
    """
    tie, at, part, before = free(rows.columns, "tie", "at", "part", "before")
    d = rows.withColumn(tie, F.monotonically_increasing_id())
    d = d.repartitionByRange(*[F.col(c) for c in order], F.col(tie)).sortWithinPartitions(*order, tie)
    d = cut(d.drop(tie).withColumn(at, F.monotonically_increasing_id()))
    place = F.shiftright(F.col(at), 33)  # the part, above the row's number in it
    sizes = d.groupBy(place.alias(part)).agg(F.count("*").alias("n"))
    n = sizes.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    first = F.coalesce(F.sum("n").over(Window.orderBy(part).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    sizes = sizes.select(part, first.alias(before))
    inside = F.col(at).bitwiseAND(F.lit((1 << 33) - 1))
    d = d.join(F.broadcast(sizes), place == F.col(part))
    return d.select(*rows.columns, (F.col(before) + inside).alias(name)), n


def _permute(number: Column, n: int, seed: int) -> Column:
    @F.pandas_udf("long")
    def moved(x: pd.Series) -> pd.Series:
        return pd.Series(permuted(x.to_numpy(np.int64), n, seed))

    return moved(number)


def sharded(rows: DataFrame, order: list[str], shards: int = SHARDS, seed: int = SEED) -> DataFrame:
    """row (a struct of ``rows``' columns), row_number, shard int, slot long.

    ``order``: columns that tell rows apart; rows equal in them should be equal. Nulls come first. An
    empty table gives an empty one; with fewer rows than shards, the last shards are empty.
    """
    number = free(rows.columns, "number")[0]
    d, n = numbered(rows, order, number)
    d = d.select(F.struct(*[F.col(c) for c in rows.columns]).alias("row"), F.col(number).alias("row_number"))
    d = d.withColumn("p", _permute(F.col("row_number"), n, seed))
    return d.select("row", "row_number", (F.col("p") % shards).cast("int").alias("shard"), F.expr(f"p div {shards}").alias("slot"))


def write_shards(rows: DataFrame, order: list[str], path: str, shards: int = SHARDS, seed: int = SEED) -> None:
    """Files of ``rows`` below ``path``/shard=<k>/, in the order of their slots.

    Rows are dealt by ranges of (shard, slot), so a shard may be many files and tasks follow the size of the data.
    """
    d = sharded(rows, order, shards, seed).repartitionByRange("shard", "slot").sortWithinPartitions("shard", "slot")
    d.select("shard", "slot", "row").write.partitionBy("shard").mode("overwrite").parquet(path)


def dealt(docs: DataFrame, shards: int = SHARDS, seed: int = SEED) -> DataFrame:
    """doc_id, size, text_crc32, law (``rows``), shard, slot, grown_shard (null), row_number of every document.

    Size: UTF-8 bytes of the text plus 8; a null text has none and the checksum 0, like an empty one. Rows are
    numbered by (doc_id, size, text_crc32), null ids first. Equal texts and repeated rows are rows like others and
    need not share a shard; other columns don't matter. Texts are read once and not moved.
    """
    size = F.coalesce(F.octet_length("text"), F.lit(0)).cast("long") + 8
    crc = F.crc32(F.coalesce(F.col("text").cast("binary"), F.lit(b"")))
    slim = cut(docs.select("doc_id", size.alias("size"), crc.cast("long").alias("text_crc32")))
    d = sharded(slim, ["doc_id", "size", "text_crc32"], shards, seed)
    forget(slim)  # its rows are written anew, with their numbers
    return d.select("row.*", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "row_number")


def _network_sql(x: str, source: str) -> str:
    """The network over ``x`` of ``source`` in DuckDB's SQL, a nested query for each round: with a table w(bits, low) of one row."""
    rounds = f"(select row_number, ({x}) >> low as l, ({x}) & ((1 << low) - 1) as r from {source}, w)"
    for k, (a, b, c, d) in enumerate(round_keys(SEED)):
        size = "bits - low" if k % 2 == 0 else "low"
        one = f"((r * {a} + {b}) % {PRIME})"
        two = f"(({one} * {one} + {c}) % {PRIME})"
        rounds = f"(select row_number, r as l, xor(l, ({two} * {d} % {PRIME}) & ((1 << ({size})::bigint) - 1)) as r from {rounds}, w)"
    return f"select row_number, (l << low) | r as p from {rounds}, w"


#: The checksum of a text in DuckDB, which has none: over a table ``tab`` of the 256 remainders, made by their rule.
_TAB = "tab as (select list_transform(range(256), lambda i: list_reduce(list_prepend(i::bigint, range(8)), lambda c, k: case when c & 1 = 1 then xor(c >> 1, 3988292384) else c >> 1 end)) as tab)"
_CRC = "xor(list_reduce(list_prepend(4294967295::bigint, bs), lambda c, b: xor(c >> 8, tab[(xor(c, b) & 255) + 1])), 4294967295)"

ORACLE_SQL = f"""
with recursive {_TAB},
h as (select doc_id, octet_length(encode(coalesce(text, '')))::bigint as b, hex(encode(coalesce(text, ''))) as hx from documents),
s as (select doc_id, b + 8 as size, list_transform(range(0, b), lambda i: ('0x' || hx[2*i+1:2*i+2])::bigint) as bs from h),
c as (select doc_id, size, ({_CRC})::bigint as text_crc32 from s, tab),
d as (select *, row_number() over (order by doc_id nulls first, size, text_crc32) - 1 as row_number from c),
w as (select greatest(2, ceil(log2(count(*)))::bigint) as bits, greatest(2, ceil(log2(count(*)))::bigint) // 2 as low, count(*) as n from documents),
p as (
  {_network_sql("row_number", "d")}
  union all
  {_network_sql("p", "(select p.row_number, p.p from p, w where p.p >= w.n)")})
select doc_id, size, text_crc32, 'rows' as law, (p % {SHARDS})::int as shard, (p // {SHARDS})::bigint as slot, null::int as grown_shard, row_number
from d join (select row_number, p from p, w where p < n) using (row_number)
"""
