"""Operator 10, packing documents into sequences by cutting-stock column generation."""

from __future__ import annotations

import base64
import re
import zlib
from collections.abc import Iterator
from functools import cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, LongType, StructField, StructType

from . import common

LENGTH = 1024
VOCABULARY = "byte_bpe_50k"
#: Lengths up to the first number are a class each; up to the second, fours; beyond, eights. Fewer classes, fewer columns.
FINE, MIDDLE = 32, 256
#: Columns that are generated at most, and the gap to the lower bound, in sequences and as a part, that is good enough.
COLUMNS, GAP, PART = 2500, 0.5, 0.001


@cache
def _exact(vocabulary: str):
    """The vocabulary as the tokenizers library reads it; loaded in a worker only when a text needs it."""
    import public_tokenizers
    from tokenizers import Tokenizer

    return Tokenizer.from_file(public_tokenizers.path(f"{vocabulary}.json"))


@cache
def _fast(vocabulary: str):
    """The same vocabulary as tiktoken's ranks, which gives the same ids faster."""
    import public_tokenizers
    import tiktoken

    with open(public_tokenizers.path(f"{vocabulary}.tiktoken"), "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    return tiktoken.Encoding(vocabulary, pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


#: Characters on whose classes all regular expression engines agree; texts with others take the slower path.
_PLAIN = re.compile(r"[\t\n\r\x20-\x7e\xa1-\xac\xae-ɏ‐-‧€]*")


def ids_of(text: str | None, vocabulary: str = VOCABULARY) -> np.ndarray:
    """The text's ids as the tokenizers library gives them without special tokens added, then 0."""
    text = text or ""
    if _PLAIN.fullmatch(text) and "<|" not in text:
        ids = _fast(vocabulary).encode_ordinary(text)
    else:
        ids = _exact(vocabulary).encode(text, add_special_tokens=False).ids
    return np.array([*ids, 0], "<u4")


_PIECE = StructType([StructField("start", LongType()), StructField("length", IntegerType()), StructField("crc", LongType()), StructField("tokens", LongType())])


@F.pandas_udf(ArrayType(_PIECE))
def pieces(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """Whole sequences, and what is left at the end."""
    for part in texts:
        out = []
        for text in part:
            ids = ids_of(text)
            cuts = range(0, len(ids), LENGTH)
            out.append([{"start": a, "length": len(x := ids[a : a + LENGTH]), "crc": zlib.crc32(x.tobytes()), "tokens": len(ids)} for a in cuts])
        yield pd.Series(out)


def size_class(length: Column) -> Column:
    """The class's longest length; a pattern has room for it, whatever piece of the class comes."""
    up = lambda step: (F.ceil(length / step) * step).cast("int")
    return F.when(length <= FINE, length.cast("int")).when(length <= MIDDLE, up(4)).otherwise(up(8))


def _best_column(prices: np.ndarray, lengths: np.ndarray) -> tuple[float, np.ndarray]:
    """Knapsack: the pattern worth most at the lengths' ``prices``, by dynamic programming over its length."""
    value = np.full(LENGTH + 1, -1.0)  # prices[l], by length
    value[lengths] = prices
    best, choice = np.zeros(LENGTH + 1), np.zeros(LENGTH + 1, np.int64)
    for c in range(1, LENGTH + 1):
        worth = best[c - 1 :: -1][:c] + value[1 : c + 1]
        k = int(worth.argmax())
        if worth[k] > best[c - 1] + 1e-12:
            best[c], choice[c] = worth[k], k + 1
        else:
            best[c] = best[c - 1]
    counts, c = np.zeros(LENGTH + 1, np.int64), LENGTH
    while c > 0:
        if choice[c]:
            counts[choice[c]] += 1
            c -= int(choice[c])
        else:
            c -= 1
    return float(best[LENGTH]), counts[lengths]


def _longest_first(lengths: np.ndarray, demand: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A first basis: patterns filled longest first, each used until one length is used up, which then drops out."""
    m = len(lengths)
    columns, used, left, active = np.zeros((m, m)), np.zeros(m), demand.astype(np.float64), np.ones(m, bool)
    for j in range(m):
        space = LENGTH
        for i in np.flatnonzero(active)[::-1]:
            k = min(space // int(lengths[i]), max(1, int(np.ceil(left[i]))))
            columns[i, j] = k
            space -= k * int(lengths[i])
        has = np.flatnonzero(columns[:, j])
        last = has[(left[has] / columns[has, j]).argmin()]
        used[j] = max(left[last] / columns[last, j], 0.0)
        left = np.maximum(left - used[j] * columns[:, j], 0.0)
        active[last] = False
    return columns, used


def _inverse(basis: np.ndarray) -> np.ndarray:
    """The inverse by row steps with pivoting.

    Element by element: threaded linear algebra can hang in a driver process that has run Spark.
    """
    m = len(basis)
    rows = np.hstack([basis, np.eye(m)])
    for j in range(m):
        k = j + int(np.abs(rows[j:, j]).argmax())
        rows[[j, k]] = rows[[k, j]]
        rows[j] /= rows[j, j]
        factor = rows[:, j].copy()
        factor[j] = 0.0
        rows -= factor[:, None] * rows[j]
    return rows[:, m:]


def fractional(lengths: np.ndarray, demand: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Patterns (columns) and how often each is used, not yet whole: the linear program by column generation.

    Minimises the number of patterns that meet ``demand``. The basis starts from longest-first packing;
    each round prices a new column and pivots it in. Size: one row and column for each length.
    """
    m = len(lengths)
    columns, used = _longest_first(lengths, demand)
    inverse = _inverse(columns)
    for _ in range(COLUMNS):
        prices = inverse.sum(axis=0)
        worth, column = _best_column(np.maximum(prices, 0.0), lengths)
        total = used.sum()
        if worth <= 1 + 1e-9 or total - total / worth < max(GAP, PART * total):
            break
        turn = (inverse * column).sum(axis=1)
        up = turn > 1e-9
        if not up.any():
            break
        ratio = np.full(m, np.inf)
        ratio[up] = used[up] / turn[up]
        out = int(ratio.argmin())
        step = ratio[out]
        used = np.maximum(used - step * turn, 0.0)
        used[out] = step
        row = inverse[out] / turn[out]
        inverse -= turn[:, None] * row
        inverse[out] = row
        columns[:, out] = column
    return columns.astype(np.int64), used


def plan(histogram: dict[int, int]) -> list[tuple[int, dict[int, int]]]:
    """(times, {length: how often}) patterns that use up a histogram of lengths (of classes).

    The fractional patterns are rounded down; what is left is packed longest first, at most about one
    sequence for each pattern.
    """
    lengths = np.array(sorted(k for k, n in histogram.items() if n > 0), np.int64)
    if not len(lengths):
        return []
    demand = np.array([histogram[int(k)] for k in lengths], np.int64)
    columns, used = fractional(lengths, demand.astype(np.float64))
    out: list[tuple[int, dict[int, int]]] = []
    left = demand.copy()
    for j in range(columns.shape[1]):
        has = columns[:, j] > 0
        times = min(int(np.floor(used[j] + 1e-6)), int((left[has] // columns[has, j]).min(initial=1 << 60)) if has.any() else 0)
        if times > 0:
            left -= times * columns[:, j]
            out.append((times, {int(lengths[i]): int(columns[i, j]) for i in np.flatnonzero(has)}))
    while left.any():
        space, column = LENGTH, np.zeros(len(lengths), np.int64)
        for i in range(len(lengths) - 1, -1, -1):
            if (k := min(int(left[i]), space // int(lengths[i]))) > 0:
                column[i] = k
                space -= k * int(lengths[i])
        has = column > 0
        times = int((left[has] // column[has]).min())
        left -= times * column
        out.append((times, {int(lengths[i]): int(column[i]) for i in np.flatnonzero(has)}))
    return out


def slots(patterns: list[tuple[int, dict[int, int]]]) -> np.ndarray:
    """Where pieces go, by class and rank: rows (class, first rank, first sequence, pieces a sequence)."""
    rows, ranks, sequence = [], dict.fromkeys(range(1, LENGTH + 1), 0), 0
    for times, pattern in patterns:
        for length, count in sorted(pattern.items(), reverse=True):
            rows.append((length, ranks[length], sequence, count))
            ranks[length] += times * count
        sequence += times
    return np.array(sorted(rows), np.int64).reshape(-1, 4)


def _place(table: np.ndarray):
    """(class, rank) to a sequence; the table has as many rows as all patterns have classes."""
    keys = (table[:, 0] << 48) | table[:, 1]

    @F.pandas_udf(LongType())
    def place(parts: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for length, rank in parts:
            r = rank.to_numpy(np.int64)
            row = table[np.searchsorted(keys, (length.to_numpy(np.int64) << 48) | r, side="right") - 1]
            yield pd.Series(row[:, 2] + (r - row[:, 1]) // row[:, 3])

    return place


def pack(docs: DataFrame) -> DataFrame:
    """One row per piece of ``docs`` (doc_id, text): doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    A document's ids are cut at multiples of LENGTH; whole pieces fill a sequence alone, the rest of
    each document is packed. The driver sees the histogram of length classes alone, under 200 numbers,
    and sends back patterns. Pieces are ranked within their class in a random fixed order of documents
    (md5 of the id) and take the patterns' places by rank. Null and empty texts are the one id 0.
    Repeated rows are packed as often as they occur; an empty table gives an empty result.
    """
    order = F.conv(F.substring(F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 1, 15), 16, 10).cast("long")
    d = docs.select("doc_id", order.alias("u"), F.explode(pieces("text")).alias("p")).select("doc_id", "u", "p.*")
    d = common.cut(d.withColumn("class", size_class(F.col("length"))))
    histogram = {r["class"]: r["n"] for r in d.groupBy("class").agg(F.count("*").alias("n")).collect()}
    place = _place(slots(plan(histogram)))
    ranked = common.with_running(
        d, ["class"], [F.col("u"), F.col("doc_id"), F.col("start"), F.col("crc")], F.lit(1), "rank", F.shiftright(F.col("u"), 60 - 9)
    )
    placed = ranked.withColumn("sequence_id", place(F.col("class").cast("long"), F.col("rank")))
    before = Window.partitionBy("sequence_id").orderBy(F.desc("class"), "rank").rowsBetween(Window.unboundedPreceding, -1)
    return placed.select(
        "doc_id", "start", F.col("length").cast("long").alias("length"), F.col("crc").alias("ids_crc32"), F.col("tokens").alias("doc_tokens"),
        "sequence_id", F.coalesce(F.sum(F.col("length").cast("long")).over(before), F.lit(0)).alias("offset"),
    )
