import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from lintlake.llm import packing

EXACT = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet=st.characters(codec="utf-8", exclude_categories=["Cs"]), max_size=40) | st.text(alphabet="aé ß\t\n.'s1|<>endoftext  ", max_size=40))
def test_ids_are_those_of_the_tokenizers_library(text):
    assert packing.ids_of(text).tolist() == [*EXACT.encode(text, add_special_tokens=False).ids, 0]


def test_plans_use_up_the_histogram_and_fit():
    rng = np.random.default_rng(1)
    for n in (0, 1, 5, 400, 30000):
        histogram = {int(k): int(v) for k, v in Counter((rng.integers(1, 129, n) * 8).tolist()).items()}
        used = Counter()
        patterns = packing.plan(histogram)
        for times, pattern in patterns:
            assert sum(k * v for k, v in pattern.items()) <= packing.LENGTH
            used.update({k: times * v for k, v in pattern.items()})
        assert used == Counter(histogram)
        if n > 10000:
            assert sum(k * v for k, v in histogram.items()) / packing.LENGTH / sum(t for t, _ in patterns) > 0.97


def test_pack_is_an_exact_cover(spark):
    rows = [(i, "word " * (i * 37 % 900)) for i in range(150)] + [(1, "word " * 37), (None, None), (200, ""), (201, "long text " * 4000), (202, "x" * 5000)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = packing.pack(df).collect()
    want = Counter()
    for i, t in rows:
        ids = packing.ids_of(t)
        for a in range(0, len(ids), packing.LENGTH):
            x = ids[a : a + packing.LENGTH]
            want[(i, a, len(x), zlib.crc32(x.tobytes()), len(ids))] += 1
    assert Counter((r.doc_id, r.start, r.length, r.ids_crc32, r.doc_tokens) for r in got) == want
    sequences = defaultdict(list)
    for r in got:
        sequences[r.sequence_id].append((r.offset, r.length))
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= packing.LENGTH
    assert packing.pack(df.limit(0)).count() == 0
