"""Operator 6, substring dedup by sliding spans of sentences."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, LongType, StringType, StructField, StructType

from . import common

#: Consecutive sentences in a span. Longer repeats are unions of such spans.
SENTENCES = 2
#: Default of ``least``: a passage, a run of covered sentences, goes if it has so many words; a shorter one is a stock
#: phrase that documents share by chance. 1 removes every covered sentence.
LEAST = 20

#: A sentence ends at a line's end, or after a stop (with closing quotes) before white space.
_END = re.compile(r"\n[\x20\x09-\x0D]*|[.!?…。！？]+[\"'”’)\]]*[\x20\x09-\x0D]+")


def segments(text: str) -> list[str]:
    """The text cut after each sentence; white space stays with the sentence before, so ``"".join`` gives it back."""
    out, at = [], 0
    for m in _END.finditer(text):
        out.append(text[at : m.end()])
        at = m.end()
    if at < len(text):
        out.append(text[at:])
    return out


def _words(segment: str) -> list[bytes]:
    return segment.lower().encode("utf-8", "surrogatepass").split()


def spans(text: str | None) -> bytes:
    """The 128-bit hash of every run of SENTENCES consecutive sentences, in order, as pairs of longs.

    Sentences are compared lower-case, white space folded; segments of white space alone are no sentences.
    """
    said = [b" ".join(w) for s in segments(text or "") if (w := _words(s))]
    return b"".join(xxhash.xxh3_128_digest(b"\n".join(said[i : i + SENTENCES])) for i in range(len(said) - SENTENCES + 1))


def few(parts: Iterator[pd.Series], n: int = 500) -> Iterator[pd.Series]:
    """The same rows in smaller parts, so that the spans of few texts are held at a time."""
    for part in parts:
        for at in range(0, len(part), n):
            yield part.iloc[at : at + n]


@F.pandas_udf(ArrayType(LongType()))
def span_hashes(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for part in few(texts):
        yield pd.Series([np.frombuffer(spans(x), np.int64) for x in part], dtype=object)


_CUT = StructType([StructField("text", StringType()), StructField("removed", IntegerType())])


def without_spans(text: str, starts: set[int], least: int = LEAST) -> tuple[str, int]:
    """The text less its passages, and how many sentences went: ``starts`` are the repeated spans' places."""
    cuts = segments(text)
    said = [k for k, s in enumerate(cuts) if s.strip("\t\n\x0b\x0c\r ")]
    covered = {i + j for i in starts for j in range(SENTENCES)}
    gone: set[int] = set()
    run: list[int] = []
    for i in range(len(said) + 1):
        if i in covered and i < len(said):
            run.append(said[i])
        elif run:
            if sum(len(_words(cuts[k])) for k in run) >= least:
                gone.update(run)
            run = []
    return "".join(s for k, s in enumerate(cuts) if k not in gone), len(gone)


def _without(text: Column, starts: Column, least: int) -> Column:
    """text and removed for texts with repeated spans; the others come as nulls."""

    @F.pandas_udf(_CUT)
    def cut_texts(parts: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        for texts, starts in parts:
            rows = [(None, 0) if text is None or at is None else without_spans(text, set(at), least) for text, at in zip(texts, starts, strict=True)]
            yield pd.DataFrame(rows, columns=["text", "removed"])

    return cut_texts(text, starts)


def repeated(docs: DataFrame) -> DataFrame:
    """Non-first repeated spans of ``docs`` (doc_id, text): of (the doc_id), of_h (the text's hash), at (places of spans).

    The first of equal spans is that of the smallest (doc_id, text hash, place); a null doc_id comes
    last. The texts are hashed once and their spans' hashes written. First halves of the hashes are
    counted, aggregated map-side, 8 bytes each; only spans whose half repeats are sent on with all of
    their hash, which decides.
    """
    hashed = common.cut(docs.select("doc_id", F.xxhash64("text").alias("h"), span_hashes("text").alias("s")).where(F.size("s") > 0))
    places = F.transform(F.sequence(F.lit(0), (F.size("s") / 2).cast("int") - 1), lambda i: F.struct(i.alias("at"), F.get("s", i * 2).alias("key"), F.get("s", i * 2 + 1).alias("rest")))
    rows = hashed.select("doc_id", "h", F.explode(places).alias("x")).select("doc_id", "h", "x.*")
    twice = common.cut(rows.groupBy("key").agg(F.count("*").alias("n")).where("n > 1").select("key"))
    may = common.cut(rows.join(twice, "key"))
    place = F.struct(F.coalesce("doc_id", F.lit((1 << 63) - 1)).alias("id"), F.col("h").alias("h"), F.col("at").alias("at"))
    first = may.groupBy("key", "rest").agg(F.min(place).alias("first"), F.max(place).alias("last"))
    # written, so that the join below is between two plain shuffles, whose hot hashes Spark can split
    first = common.cut(first.where("first != last").select("key", "rest", "first"))
    later = may.join(first, ["key", "rest"]).where(place != F.col("first")).groupBy("doc_id", "h")
    return later.agg(F.collect_set("at").alias("at")).select(F.col("doc_id").alias("of"), F.col("h").alias("of_h"), "at")


def dedup(docs: DataFrame, removed: str | None = None, least: int = LEAST) -> DataFrame:
    """``docs`` with text cut; ``removed`` names a further column, the number of sentences that went.

    Every run of SENTENCES sentences is a span. Sentences in a non-first repeated span are covered;
    covered sentences in a row are a passage and go, if they have ``least`` words together. All rows and
    columns stay; a text whose sentences all go becomes empty; null texts stay null. n_chars, if there,
    is set to the new length. Rows equal in doc_id and text are one document, which keeps its spans;
    rows without a doc_id but with the same text likewise. Texts of one sentence, and those with no
    repeated passage, come back unchanged to the byte. An empty table gives an empty one.
    """
    cover = repeated(docs)
    d = docs.select(common.whole(docs).alias("row"), "doc_id", F.xxhash64("text").alias("h"))
    d = d.join(cover, F.col("doc_id").eqNullSafe(F.col("of")) & (F.col("h") == F.col("of_h")), "left")
    d = d.select("row", _without(F.when(F.col("at").isNotNull(), F.col("row.text")), F.col("at"), least).alias("cut"))
    text = F.coalesce("cut.text", "row.text")
    made = {"text": text, "n_chars": F.coalesce(F.char_length(text), F.lit(0)).cast("long")}
    out = [made.get(c, F.col("row")[c]).alias(c) for c in docs.columns]
    return d.select(*out, *([F.coalesce("cut.removed", F.lit(0)).alias(removed)] if removed else []))
