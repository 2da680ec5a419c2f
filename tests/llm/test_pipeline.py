"""The pipeline against a plain reading of its stages."""

import random
import zlib
from collections import Counter

import numpy as np

from pyspark.sql import functions as F

import corpus_pipeline
from lintlake.llm import packing, simhash

from . import brute

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def corpus():
    rng = random.Random(9)
    word = lambda: rng.choice(["alpha", "beta", "gamma", "delta", "eps"]) + str(rng.randint(0, 400))
    sentence = lambda: " ".join(word() for _ in range(rng.randint(5, 14))) + "."
    shared = " ".join(sentence() for _ in range(6))
    rows = []
    for i in range(160):
        text = " ".join(sentence() for _ in range(rng.randint(3, 12)))
        if i % 10 == 3:
            text += "\n" + shared
        rows.append([i, text, "en", f"s{i % 3}"])
    for i in range(160, 175):
        rows.append([i, rows[i - 100][1], "en", "s1"])  # exact copies
    rows += [[180, " ".join(f"{word()}###" for _ in range(50)), "en", "s0"], [181, "short", "en", "s0"], [182, None, None, None], [183, "", "en", "s2"]]
    return [(i, t, a, s, len(t or "")) for i, t, a, s in rows]


def test_stages_against_brute_force(spark):
    rows = corpus()
    docs = spark.createDataFrame(rows, SCHEMA)
    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == ["quality_rules", "simhash_near_dedup", "substring_dedup", "mix_sources", "pack_sequences"]

    one = stages["quality_rules"](spark, docs, "")
    kept = {r.doc_id: r.text for r in one.collect()}
    assert one.columns == docs.columns and set(kept) == set(range(175))

    two = stages["simhash_near_dedup"](spark, one, "")
    prints = {i: simhash.fingerprint(t) for i, t in kept.items()}
    first = {i: t for i, t in kept.items() if not any(j < i and (prints[i] ^ prints[j]).bit_count() <= 3 for j in kept)}
    assert two.columns == docs.columns and {r.doc_id: r.text for r in two.collect()} == first

    three = stages["substring_dedup"](spark, two, "")
    want = brute.without_repeats(first)
    got = three.collect()
    assert three.columns == docs.columns and {r.doc_id: r.text for r in got} == want and all(r.n_chars == len(r.text) for r in got)
    assert sum(len(t) for t in want.values()) < sum(len(t) for t in first.values())

    four = stages["mix_sources"](spark, three, "").collect()
    words = Counter()
    for r in four:
        words[r.source] += len(r.text.split())
        assert want[r.doc_id].startswith(r.text[:20])
    total = sum(len(t.split()) for t in want.values())
    assert abs(sum(words.values()) - total) <= 3
    assert all(abs(words[f"s{k}"] - total * (k + 1) / 6) <= 1 for k in range(3)) or max(words.values()) <= 3 * total

    five = stages["pack_sequences"](spark, spark.createDataFrame(four, SCHEMA), "").collect()
    pieces = Counter()
    for r in four:
        ids = packing.ids_of(r.text)
        for a in range(0, len(ids), packing.LENGTH):
            pieces[(r.doc_id, a, zlib.crc32(np.ascontiguousarray(ids[a : a + packing.LENGTH]).tobytes()))] += 1
    assert Counter((r.doc_id, r.start, r.ids_crc32) for r in five) == pieces


def test_columns_of_any_name_come_through(spark):
    """Names that the operators use themselves, or once did."""
    names = ["row", "f", "r", "failed", "kept", "n_lines", "size", "u", "target", "taken", "before", "position", "copy", "n", "rest", "h", "of", "at", "cut", "k", "twice", "fp", "first", "__f", "__size", "__u", "__b", "__taken", "__k", "__id", "__h", "__w", "__v", "__before", "__n0", "__k0", "a.b"]
    docs = spark.createDataFrame(corpus(), SCHEMA)
    for name in names:
        docs = docs.withColumn(name, F.concat("source", F.lit(name)))
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, "")
        assert docs.columns == [*SCHEMA.replace(" long", "").replace(" string", "").split(", "), *names], name
        assert all(r[x] == f"{r.source}{x}" for r in docs.where("source is not null").limit(20).collect() for x in names), name
    assert corpus_pipeline.STAGES[-1][1](spark, docs, "").count() > 100


def test_run_and_empty_table(spark, tmp_path):
    spark.createDataFrame(corpus(), SCHEMA).coalesce(1).write.parquet(str(tmp_path / "documents.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() > 100
    empty = spark.createDataFrame([], SCHEMA)
    for _, stage in corpus_pipeline.STAGES:
        empty = stage(spark, empty, "")
    assert empty.count() == 0
