"""Operator 2, toxicity: compression-distance classification with two zstandard dictionaries."""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from functools import cache

import numpy as np
import pandas as pd
import zstandard as zstd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, DoubleType

from . import common

#: Labelled rows that are learned from at most, by label, and windows of theirs, by label.
TOXIC_ROWS, ORDINARY_ROWS, SAMPLE_WINDOWS = 2500, 5000, 500_000
#: Bytes of a window and of what it shares with the next, so that no word is lost at a cut.
WINDOW, SHARED = 24, 16
#: Bytes of the ordinary dictionary, of the first toxic ones, and of the toxic one in the end.
ORDINARY_BYTES, FIRST_BYTES, TOXIC_BYTES = 100_000, 100_000, 3072
#: Parts of the toxic texts, each judged by the dictionary of the others, and rounds of training.
FOLDS, ROUNDS = 4, 5
#: Windows that a toxic text gives to the next round: its best, if they save more than this part of ordinary windows.
PICKED, RARE = 4, 0.997
#: Ordinary texts, about, whose windows tell what is rare among ordinary ones: of the sample's other half, evenly taken.
JUDGES = 400
#: Saved bytes from which a window counts as a hit, at two levels.
LEVELS = (2, 4)
#: Every window ends with these bytes and so does every dictionary: a window is never stored uncompressed.
PAD = bytes(range(128, 152))


@dataclass(frozen=True)
class Model:
    """What is sent to the executors: two dictionaries, 103 kB together, and a handful of weights."""

    toxic: bytes = b""
    ordinary: bytes = b""
    mean: tuple[float, ...] = ()
    scale: tuple[float, ...] = ()
    weights: tuple[float, ...] = ()
    bias: float = 0.0


def windows(text: str | None) -> list[bytes]:
    """The whole text, lower-cased and white space folded, in overlapping windows."""
    joined = b" " + b" ".join((text or "").lower().encode("utf-8", "replace").split()) + b" "
    return [joined[i : i + WINDOW + SHARED] for i in range(0, max(1, len(joined) - SHARED), WINDOW)]


@cache
def _compressor(content: bytes) -> zstd.ZstdCompressor:
    params = zstd.ZstdCompressionParameters(
        window_log=19, chain_log=16, hash_log=16, search_log=4, min_match=4, target_length=32, strategy=zstd.STRATEGY_LAZY,
        write_content_size=False, write_checksum=False, write_dict_id=False, format=zstd.FORMAT_ZSTD1_MAGICLESS,
    )
    return zstd.ZstdCompressor(dict_data=zstd.ZstdCompressionDict(content + PAD, dict_type=zstd.DICT_TYPE_RAWCONTENT), compression_params=params)


def _lengths(parts: Sequence[bytes], content: bytes) -> np.ndarray:
    compress = _compressor(content).compress
    return np.array([len(compress(w + PAD)) for w in parts], np.float64)


def saved(parts: Sequence[bytes], toxic: bytes, ordinary: bytes) -> np.ndarray:
    """Bytes of each window that the toxic dictionary saves. The ordinary one stands behind both, so ordinary words cost both the same."""
    return _lengths(parts, ordinary) - _lengths(parts, toxic + ordinary)


def features(gain: np.ndarray) -> list[float]:
    """Of a text's windows' saved bytes: the largest, the three largest, the mean, hits at two levels, the text's length."""
    top = np.sort(gain)[-3:]
    hits = [math.log1p(float((gain >= k).sum())) for k in LEVELS]
    return [float(top[-1]), float(top.mean()), float(gain.mean()), *hits, math.log1p(len(gain))]


def score_of(x: Sequence[float], model: Model) -> float:
    z = model.bias + sum(w * (v - m) / s for w, v, m, s in zip(model.weights, x, model.mean, model.scale, strict=True))
    return 1.0 / (1.0 + math.exp(-max(-30.0, min(30.0, z))))


def _dictionary(size: int, samples: list[bytes], segment: int) -> bytes:
    """The content of a dictionary of ``size`` bytes, or of its samples' where those are fewer, that zstandard trains on ``samples``.

    Samples that it refuses to train on, a handful, are the dictionary as they are; none is left out.
    """
    size = min(size, sum(map(len, samples)))
    try:
        return zstd.train_dictionary(max(size, 256) + 400, samples, k=segment, d=6).as_bytes()[-size:]  # a header comes first
    except zstd.ZstdError:
        return b"".join(samples)


def _distinct(texts: list[list[bytes]]) -> list[list[bytes]]:
    """Texts that share less than a quarter of their windows with those before: copies would count as evidence twice."""
    seen: set[bytes] = set()
    out = []
    for parts in texts:
        own = set(parts)
        if len(own & seen) * 4 < len(own):
            out.append(parts)
        seen |= own
    return out


def _logistic(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, float]:
    """mean, scale, weights, bias by Newton steps with a small ridge; a few features, summed element by element."""
    mean, scale = x.mean(axis=0), x.std(axis=0) + 1e-6
    z = np.column_stack([(x - mean) / scale, np.ones(len(x))])
    m = z.shape[1]
    ridge = np.array([1.0] * (m - 1) + [1e-3])
    w = np.zeros(m)
    for _ in range(40):
        p = 1 / (1 + np.exp(-np.clip((z * w).sum(axis=1), -30, 30)))
        weight = p * (1 - p)
        rows = np.array([[(z[:, i] * z[:, j] * weight).sum() + (ridge[i] if i == j else 0.0) for j in range(m)] + [(z[:, i] * (y - p)).sum() - ridge[i] * w[i]] for i in range(m)])
        for i in range(m):  # Gauss-Jordan; the matrix is positive definite
            rows[i] /= rows[i, i]
            for j in range(m):
                if j != i:
                    rows[j] -= rows[j, i] * rows[i]
        w = w + rows[:, m]
    return mean, scale, w[:-1], float(w[-1])


def _best_cut(logit: np.ndarray, y: np.ndarray) -> float:
    """The threshold of the logit where F1 is best, between two values."""
    order = np.argsort(-logit, kind="stable")
    found = np.cumsum(y[order])
    f1 = 2 * found / (np.arange(1, len(y) + 1) + y.sum())
    k = int(f1.argmax())
    return float(logit[order[k]] + logit[order[min(k + 1, len(y) - 1)]]) / 2


def train(toxic: list[list[bytes]], ordinary: list[list[bytes]]) -> Model:
    """A model from toxic and ordinary texts, each given as its windows.

    The ordinary dictionary is trained on half of the ordinary texts. Toxic texts are mostly ordinary
    words, so the toxic one is trained in rounds: the first on all windows of the toxic texts, each
    later one on those windows that the dictionary before found to be toxic, by how many bytes it
    saved against what it saves on the other half of the ordinary texts. A text is always judged by a
    dictionary that other texts were trained on (FOLDS parts), so that only what toxic texts have in
    common lasts. A logistic calibration on these judgements turns saved bytes into scores; its
    threshold of 0.5 is where F1 is best.
    """
    toxic, ordinary = _distinct([t for t in toxic if t]), _distinct([t for t in ordinary if t])
    if not toxic or not ordinary:
        return Model(b" ", b" ", (0.0,) * 6, (1.0,) * 6, (0.0,) * 6, -2.0 if not toxic else 2.0)
    base = _dictionary(ORDINARY_BYTES, [w for t in ordinary[::2] for w in t], 32) or b" "
    other = ordinary[1::2] or ordinary
    folds = min(FOLDS, len(toxic))
    cost = [_lengths(t, base) for t in toxic]
    plain = [w for t in other[:: max(1, len(other) // JUDGES)] for w in t]
    plain_cost = _lengths(plain, base)

    def trained(samples: list[list[bytes]], size: int, segment: int) -> list[bytes]:
        """For each part of the toxic texts, a dictionary of what the others gave."""
        return [_dictionary(size, [w for i, t in enumerate(samples) if folds == 1 or i % folds != k for w in t], segment) or b" " for k in range(folds)]

    dictionaries, picked = trained(toxic, FIRST_BYTES, 32), toxic
    for _ in range(ROUNDS):
        limits = [float(np.quantile(plain_cost - _lengths(plain, d + base), RARE)) for d in dictionaries]
        picked = []
        for i, t in enumerate(toxic):
            gain = cost[i] - _lengths(t, dictionaries[i % folds] + base)
            picked.append([t[j] for j in np.argsort(-gain, kind="stable")[:PICKED] if gain[j] > limits[i % folds]])
        dictionaries = trained(picked, TOXIC_BYTES, 16)
    content = _dictionary(TOXIC_BYTES, [w for t in picked for w in t], 16) or b" "
    x = [features(cost[i] - _lengths(t, dictionaries[i % folds] + base)) for i, t in enumerate(toxic)]
    x += [features(saved(t, dictionaries[i % folds], base)) for i, t in enumerate(other)]
    x, y = np.array(x), np.array([1.0] * len(toxic) + [0.0] * len(other))
    mean, scale, weights, bias = _logistic(x, y)
    cut = _best_cut(((x - mean) / scale * weights).sum(axis=1) + bias, y)
    return Model(content, base, tuple(mean), tuple(scale), tuple(weights), bias - cut)


def held_out(doc_id: Column) -> Column:
    return F.pmod(F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")), F.lit(5)) == 0


@F.pandas_udf(ArrayType(BinaryType()))
def _cut_up(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for part in texts:
        yield pd.Series([windows(x) for x in part], dtype=object)


def learned(docs: DataFrame, labels: DataFrame) -> Model:
    """Learns from a bounded sample of labelled rows that aren't held out.

    The ids with the smallest md5 are taken, TOXIC_ROWS and ORDINARY_ROWS at most; an id labelled both
    ways counts as toxic. Their texts are cut into windows by Spark. Where a label's texts come to more
    than SAMPLE_WINDOWS windows, a part of those, by hash, goes to the driver, about as many as that: this
    bounds its memory whatever the texts' lengths. Reruns take the same rows, in any partitioning.
    """
    usable = labels.where("doc_id is not null and toxic is not null").where(~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    ids = None
    for label, most in ((1, TOXIC_ROWS), (0, ORDINARY_ROWS)):
        part = usable.where(F.col("toxic") == label).orderBy(F.md5(F.col("doc_id").cast("string")), "doc_id").limit(most)
        ids = part if ids is None else ids.unionByName(part)
    ids = ids.select(F.col("doc_id").alias("__id"), F.col("toxic").alias("label"))
    rows = docs.select("doc_id", "text").where("text is not null").join(F.broadcast(ids), F.col("doc_id") == F.col("__id"))
    rows = common.cut(rows.select(F.md5("text").alias("h"), "label", "text").groupBy("h", "label").agg(F.first("text").alias("text")))
    size = {r["label"]: r["n"] for r in rows.groupBy("label").agg(F.sum(F.octet_length("text") / WINDOW + 1).alias("n")).collect()}
    found = rows.select("h", "label", F.posexplode(_cut_up("text")).alias("at", "window"))
    share = F.lit(0.0)
    for label, n in size.items():
        share = F.when(F.col("label") == label, F.lit(min(1.0, SAMPLE_WINDOWS / max(n, 1.0)))).otherwise(share)
    part = F.pmod(F.xxhash64("h", "at"), F.lit(1_000_000)) < share * 1_000_000
    texts: dict[int, dict[str, list[tuple[int, bytes]]]] = {0: {}, 1: {}}
    for batch in found.where(part).toArrow().to_batches():
        for h, label, at, window in zip(*[batch.column(k).to_pylist() for k in range(4)], strict=True):
            texts[1 if label == 1 else 0].setdefault(h, []).append((at, window))
    common.forget(rows)
    ordered = {y: [[w for _, w in sorted(t[h])] for h in sorted(t)] for y, t in texts.items()}
    return train(ordered[1], ordered[0])


def scorer(model: Model):
    @F.pandas_udf(DoubleType())
    def scores(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for part in texts:
            yield pd.Series([score_of(features(saved(windows(x), model.toxic, model.ordinary)), model) for x in part], dtype="float64")

    return scores


def scored(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted for every row of ``docs`` (doc_id, text); the text alone makes the score.

    Null and empty texts are one empty window, with the score of a text without a hit. Repeated rows
    are scored row by row. Without labels of both kinds all texts get one score, on the known side.
    Columns of ``docs`` other than doc_id and text are neither used nor returned; an empty table gives
    an empty one.
    """
    model = learned(docs, labels)
    d = docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), scorer(model)("text").alias("score"))
    return d.withColumn("predicted", F.when(F.col("score") >= 0.5, 1).otherwise(0))
