"""Operator 13, cross-tokenizer alignment: where the tokens of two tokenizers end together.

Each text is encoded by both; ends of tokens are running sums of their bytes, and the tokens of A and B that
end at the same byte are found by a hash join on (document, end). Inside a task all of that is Arrow: flattened lists
with their parents, sums by segment, Acero joins, Table.group_by for counts of id pairs, which Spark then merges.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import packing
from .common import cut

BYTE_BPE, PIECE_BPE = "byte_bpe_50k", "piece_bpe_32k"
#: UTF-8 bytes of texts that are aligned in one table, at least one text: bounds a task's memory beside its longest text.
CHUNK = 1 << 20
#: Bits of a key that hold the end in its text; the text's place in its chunk stands above them.
END_BITS = 40


@cache
def _byte_exact(name: str):
    import public_tokenizers
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizers.path(f"{name}.json"))
    t.encode_special_tokens = True  # their strings in a text are ordinary text
    return t


@cache
def _pieces(name: str):
    import public_tokenizers
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path(f"{name}.model"))


def byte_ids(text: str, name: str = BYTE_BPE) -> list[int]:
    """Ids by the byte-level vocabulary; the faster library where both are known to cut alike."""
    if packing._PLAIN.fullmatch(text):
        return packing._fast(name).encode_ordinary(text)
    return _byte_exact(name).encode(text, add_special_tokens=False).ids


@cache
def byte_tokens(name: str) -> pa.Array:
    """Each id's bytes. Entries are written with one character for each byte: itself if it prints, else the next one from 256 on."""
    import public_tokenizers

    with open(public_tokenizers.path(f"{name}.json"), encoding="utf-8") as f:
        vocabulary = json.load(f)["model"]["vocab"]
    prints = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    byte_of = {chr(b): b for b in prints} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in prints)}
    out = [b""] * (max(vocabulary.values()) + 1)
    for entry, i in vocabulary.items():
        out[i] = bytes(byte_of[c] for c in entry) if all(c in byte_of for c in entry) else entry.encode()
    return pa.array(out, pa.binary())


@cache
def piece_tokens(name: str) -> pa.Array:
    m = _pieces(name)
    piece = lambda i: bytes([int(m.id_to_piece(i)[3:5], 16)]) if m.is_byte(i) else m.id_to_piece(i).replace("▁", " ").encode()
    return pa.array([piece(i) for i in range(m.get_piece_size())], pa.binary())


@cache
def _decimals(n: int) -> pa.Array:
    return pc.cast(pa.array(np.arange(n, dtype=np.int32)), pa.string())


@dataclass
class Side:
    """One tokenizer's tokens of a chunk: flat, with the key of each token's end and where its group ends."""

    ids: pa.Array
    keys: pa.Array
    offsets: np.ndarray
    ends: np.ndarray | None = None


def _faithful(lists: pa.ListArray, tokens: pa.Array, whole: list[bytes]) -> np.ndarray:
    """Which texts their tokens' bytes, joined, give back. The taken bytes lie one after another in one buffer."""
    taken = pc.take(tokens, lists.flatten()).cast(pa.large_binary())
    at = np.frombuffer(taken.buffers()[1], np.int64, len(taken) + 1) if len(taken) else np.zeros(1, np.int64)
    joined = memoryview(taken.buffers()[2]).cast("B") if len(taken) else memoryview(b"")
    bounds = at[lists.offsets.to_numpy()]
    return np.array([joined[a:b] == w for a, b, w in zip(bounds[:-1], bounds[1:], whole, strict=True)], bool)


def _side(lists: pa.ListArray, tokens: pa.Array) -> Side:
    """Running sums of token lengths, begun anew in each text."""
    ids, parents = lists.flatten(), pc.list_parent_indices(lists)
    lengths = pc.cast(pc.take(pc.binary_length(tokens), ids), pa.int64())
    upto = pc.cumulative_sum(lengths)
    starts = lists.offsets.slice(0, len(lists))
    base = pc.take(pc.subtract(upto, lengths), pc.take(starts, parents)) if len(ids) else upto
    keys = pc.add(pc.shift_left(pc.cast(parents, pa.int64()), pa.scalar(END_BITS, pa.int64())), pc.subtract(upto, base))
    return Side(ids, keys, lists.offsets.to_numpy())


@dataclass
class Chunk:
    """Texts aligned together: their places in the batch, both sides, and the links (key, a, b) in order of key."""

    rows: np.ndarray
    a: Side
    b: Side
    links: pa.Table

    def per_text(self, parents: np.ndarray) -> np.ndarray:
        """Bounds of each text's part in something ordered by text."""
        return np.searchsorted(parents, np.arange(len(self.rows) + 1))


def _aligned(texts: list[tuple[int, str]], a_name: str, b_name: str) -> Chunk:
    spaced = [" " + t for _, t in texts]
    whole = [t.encode() for t in spaced]
    lists = [pa.array(ids, pa.list_(pa.int32())) for ids in ([byte_ids(t, a_name) for t in spaced], _pieces(b_name).encode([t for _, t in texts], num_threads=1))]
    tokens = byte_tokens(a_name), piece_tokens(b_name)
    good = np.flatnonzero(np.logical_and.reduce([_faithful(x, t, whole) for x, t in zip(lists, tokens, strict=True)]))
    if len(good) < len(texts):
        lists = [pc.take(x, pa.array(good)) for x in lists]
    a, b = (_side(x, t) for x, t in zip(lists, tokens, strict=True))
    left, right = pa.table({"key": a.keys, "a": a.ids}), pa.table({"key": b.keys, "b": b.ids})
    links = left.join(right, "key", join_type="inner", use_threads=False).sort_by("key")
    for side in (a, b):
        side.ends = np.flatnonzero(pc.is_in(side.keys, value_set=links["key"].combine_chunks()).to_numpy(zero_copy_only=False)) + 1
    return Chunk(np.array([i for i, _ in texts], np.int64)[good], a, b, links)


def chunks(texts: list[str | None], a_name: str = BYTE_BPE, b_name: str = PIECE_BPE) -> Iterator[Chunk]:
    """The texts that have tokens, so many at once as CHUNK allows. Null and empty texts are in none."""
    held, size = [], 0
    for i, t in enumerate(texts):
        if not t:
            continue
        n = len(t.encode())
        if held and size + n > CHUNK:
            yield _aligned(held, a_name, b_name)
            held, size = [], 0
        held.append((i, t))
        size += n
    if held:
        yield _aligned(held, a_name, b_name)


def _groups(side: Side) -> pa.Array:
    """Each group's ids, joined by commas."""
    words = pc.take(_decimals(1 << 16), side.ids)
    return pc.binary_join(pa.ListArray.from_arrays(pa.array(np.concatenate([[0], side.ends]), pa.int32()), words), ",")


def _digests(chunk: Chunk) -> list[str]:
    groups = pc.binary_join_element_wise(_groups(chunk.a), _groups(chunk.b), "|")
    parents = np.searchsorted(chunk.a.offsets, chunk.a.ends, side="left") - 1  # the text whose tokens a group's last is among
    bounds = chunk.per_text(parents)
    whole = pc.binary_join(pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), groups), ";")
    return [hashlib.sha256(x.as_py().encode()).hexdigest() for x in whole]


_PAIR = pa.struct([("a", pa.int32()), ("b", pa.int32()), ("n", pa.int64())])
COUNTED = dict.fromkeys(("n_a", "n_b", "n_groups", "n_links"), "long") | {"groups_sha256": "string", "pairs": "array<struct<a:int,b:int,n:bigint>>"}


def _counted(texts: list[str | None], a_name: str, b_name: str) -> list[pa.Array]:
    """Columns of COUNTED for each text: partial counts of its id pairs come by Table.group_by."""
    n = len(texts)
    counts = np.zeros((4, n), np.int64)
    sha = [""] * n
    order, parts, sizes = [], [], []
    for c in chunks(texts, a_name, b_name):
        if not len(c.rows):
            continue
        keys = c.links["key"].to_numpy()
        text = keys >> END_BITS
        bounds = c.per_text(text)
        counts[0, c.rows], counts[1, c.rows] = np.diff(c.a.offsets), np.diff(c.b.offsets)
        counts[2, c.rows] = np.diff(c.per_text(np.searchsorted(c.a.offsets, c.a.ends, side="left") - 1))
        counts[3, c.rows] = np.diff(bounds)
        for i, x in zip(c.rows, _digests(c), strict=True):
            sha[i] = x
        pairs = pa.table({"text": text, "a": c.links["a"], "b": c.links["b"]}).group_by(["text", "a", "b"], use_threads=False).aggregate([([], "count_all")])
        pairs = pairs.sort_by([("text", "ascending"), ("a", "ascending"), ("b", "ascending")]).combine_chunks()
        order.append(c.rows)
        sizes.append(np.diff(c.per_text(pairs["text"].to_numpy())))
        parts.append(pa.StructArray.from_arrays([pairs[k].combine_chunks() for k in ("a", "b")] + [pairs["count_all"].combine_chunks().cast(pa.int64())], fields=list(_PAIR)))
    held = np.zeros(n, np.int64)
    for rows, size in zip(order, sizes, strict=True):
        held[rows] = size
    values = pa.concat_arrays(parts) if parts else pa.array([], _PAIR)
    offsets = pa.array(np.concatenate([[0], np.cumsum(held)]), pa.int32())
    return [*(pa.array(x) for x in counts), pa.array(sha, pa.string()), pa.ListArray.from_arrays(offsets, values)]


SPANS = {"spans": "array<struct<a_from:int,a_to:int,b_from:int,b_to:int,first:bigint,after:bigint>>", "a_ids": "array<int>", "b_ids": "array<int>"}
_SPAN = pa.struct([(k, pa.int32()) for k in ("a_from", "a_to", "b_from", "b_to")] + [("first", pa.int64()), ("after", pa.int64())])


def _spanned(texts: list[str | None], a_name: str, b_name: str) -> list[pa.Array]:
    """Columns of SPANS for each text."""
    spans, a_ids, b_ids = [[] for _ in texts], [[] for _ in texts], [[] for _ in texts]
    for c in chunks(texts, a_name, b_name):
        keys = c.links["key"].to_numpy()
        bounds = c.per_text(keys >> END_BITS)
        for k, i in enumerate(c.rows):
            ends = keys[bounds[k] : bounds[k + 1]] & ((1 << END_BITS) - 1)
            cuts = [s.ends[bounds[k] : bounds[k + 1]] - s.offsets[k] for s in (c.a, c.b)]
            edges = [np.concatenate([[0], x]).tolist() for x in (*cuts, ends)]
            pieces = [x for e in edges for x in (e[:-1], e[1:])]
            spans[i] = [dict(zip(_SPAN.names, values, strict=True)) for values in zip(*pieces, strict=True)]
            a_ids[i], b_ids[i] = (s.ids[s.offsets[k] : s.offsets[k + 1]].to_pylist() for s in (c.a, c.b))
    return [pa.array(spans, pa.list_(_SPAN)), pa.array(a_ids, pa.list_(pa.int32())), pa.array(b_ids, pa.list_(pa.int32()))]


def _over(docs: DataFrame, made: dict[str, str], columns: Callable[[list[str | None]], list[pa.Array]]) -> DataFrame:
    """``docs`` with its last column, text, replaced by the columns ``made`` (name: type) that ``columns`` gives."""
    kept = docs.columns[:-1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(batch.num_columns - 1).to_pylist()
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *columns(texts)], names=[*kept, *made])

    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields[:-1]]
    return docs.mapInArrow(run, ", ".join([*fields, *[f"{k} {t}" for k, t in made.items()]]))


def groups(docs: DataFrame, a_name: str = BYTE_BPE, b_name: str = PIECE_BPE) -> DataFrame:
    """doc_id; spans, the groups by tokens of either side and bytes of space + text; a_ids and b_ids.

    Null and empty texts, and those whose tokens' bytes differ from space + text, have empty lists. Repeated rows
    are texts each; other columns of ``docs`` don't matter.
    """
    return _over(docs.select("doc_id", "text"), SPANS, lambda texts: _spanned(texts, a_name, b_name))


def pair_counts(counted: DataFrame) -> DataFrame:
    """a, b, count, best: how many links hold each pair of ids, and the most that any pair of its b has.

    Linked tokens end together, so one's bytes are an end of the other's: pairs are at most the ends of all
    entries of both vocabularies (under 700,000 for those of 50,257 and 32,000 entries, 25 MB), however large the corpus.
    """
    per = counted.select(F.explode("pairs").alias("p")).groupBy("p.a", "p.b").agg(F.sum("p.n").alias("count"))
    per = cut(per)
    best = per.groupBy(F.col("b").alias("of")).agg(F.max("count").alias("best"))
    return per.join(best, F.col("b") == F.col("of")).drop("of")


def aligned(docs: DataFrame, a_name: str = BYTE_BPE, b_name: str = PIECE_BPE) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256 for each row of ``docs``.

    Texts are encoded once; their counts of id pairs are written, Spark merges them to those of the corpus, and
    those, bounded by the vocabularies, are broadcast to each text's pairs. Null and empty texts, and those whose
    tokens' bytes differ from space + text, have zeros and no digest, and count nowhere. Repeated rows count each. An
    empty table gives an empty one.
    """
    d = docs.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long").alias("doc_id"), "text")
    d = cut(_over(d, COUNTED, lambda texts: _counted(texts, a_name, b_name)))
    known = F.broadcast(pair_counts(d))
    pairs = d.select("row", F.explode("pairs").alias("p")).select("row", "p.*").join(known, ["a", "b"])
    sums = pairs.groupBy("row").agg(F.sum(F.col("n") * F.col("count")).alias("count_sum"), F.sum(F.when(F.col("count") == F.col("best"), F.col("n")).otherwise(0)).alias("n_best"))
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    return d.join(sums, "row", "left").select("doc_id", "n_a", "n_b", "n_groups", "n_links", zero("n_best"), zero("count_sum"), "groups_sha256")
