"""Sharding: a permutation both ways, gapless shards, reproducible placement."""

import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from lintlake.llm import sharding

SCHEMA = "doc_id long, text string"


@settings(max_examples=60, deadline=None)
@given(n=st.integers(1, 5000), seed=st.integers(0, 1 << 40))
def test_permutation_of_every_size(n, seed):
    x = np.arange(n)
    there = sharding.permuted(x, n, seed)
    assert np.array_equal(np.sort(there), x) and np.array_equal(sharding.permuted(there, n, seed, back=True), x)


def test_wide_numbers_and_other_seeds():
    n = (1 << 61) + 12345
    x = np.array([0, 1, n // 3, n - 1])
    there = sharding.permuted(x, n, 5)
    assert (0 <= there).all() and (there < n).all() and np.array_equal(sharding.permuted(there, n, 5, back=True), x)
    assert not np.array_equal(sharding.permuted(np.arange(999), 999, 1), sharding.permuted(np.arange(999), 999, 2))
    with pytest.raises(ValueError):
        sharding.permuted(x, 1 << 62)
    # a shuffle: neighbours part
    moved = sharding.permuted(np.arange(10_000), 10_000)
    assert abs(np.corrcoef(np.arange(10_000), moved)[0, 1]) < 0.05 and np.mean(np.abs(np.diff(moved)) < 24) < 0.02


def rows():
    rng = random.Random(5)
    out = [(i, "é" * rng.randint(0, 50) + str(i)) for i in range(300)] + [(7, None), (None, "x"), (None, "x"), (None, None), (8, ""), (9, "long " * 60_000)]
    return out + [(500, "the same")] * 150  # a third of all rows


def plain(data, shards):
    facts = [(d, len((t or "").encode()) + 8, zlib.crc32((t or "").encode())) for d, t in data]
    facts.sort(key=lambda f: (f[0] is not None, f[0] or 0, f[1:]))
    return Counter((*f, *sharding.place_of(k, len(facts), shards)) for k, f in enumerate(facts))


@pytest.mark.parametrize("parts", [1, 7])
def test_against_a_plain_reading(spark, parts):
    d = spark.createDataFrame(rows(), SCHEMA).repartition(parts).withColumn("row", sharding.F.lit(1)).withColumn("__at", sharding.F.lit(1)).withColumn("size", sharding.F.lit("s"))
    got = sharding.dealt(d).collect()
    assert Counter((r.doc_id, r.size, r.text_crc32, r.shard, r.slot) for r in got) == plain(rows(), 24)
    slots = defaultdict(list)
    for r in got:
        slots[r.shard].append(r.slot)
        assert r.law == "rows" and r.grown_shard is None and sharding.row_of(r.shard, r.slot, len(got)) == r.row_number
    assert all(sorted(x) == list(range(len(x))) for x in slots.values()) and max(map(len, slots.values())) - min(map(len, slots.values())) <= 1


def test_files_of_shards(spark, tmp_path):
    d = spark.createDataFrame(rows(), SCHEMA).withColumn("shard", sharding.F.lit("x"))
    sharding.write_shards(d, ["doc_id", "text"], str(tmp_path / "out"), shards=5)
    back = spark.read.parquet(str(tmp_path / "out"))
    assert Counter((r.row.doc_id, r.row.text) for r in back.collect()) == Counter(rows())
    assert {r.shard: r["count"] for r in back.groupBy("shard").count().collect()} == {k: len(range(k, len(rows()), 5)) for k in range(5)}


@pytest.mark.parametrize("data", [[], [(1, "a")], [(1, "a"), (2, None)]])
def test_few_rows(spark, data):
    got = sharding.dealt(spark.createDataFrame(data, SCHEMA)).collect()
    assert len(got) == len(data) and sorted(r.row_number for r in got) == list(range(len(data)))
