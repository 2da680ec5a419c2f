"""Toxicity: nothing of a score comes from other columns, reruns agree, and held-out rows of a corpus are judged well."""

import random
import zlib

import numpy as np

from lintlake.llm import toxicity

PLAIN = ["lorem", "ipsum", "dolor", "sit", "amet", "magna", "aliqua", "tempor", "labore", "veniam", "nostrud", "cillum", "fugiat", "mollit"]
BAD = ["grommelt", "skrazzer", "blightwort"]


def corpus(n=900):
    rng = random.Random(2)
    rows, labels = [(0, None, "x", "x"), (1, "", "x", "x")], [(0, 0, 0), (1, 0, 0), (None, 1, 1), (2, 1, None)]
    for i in range(3, n):
        words = [rng.choice(PLAIN) + rng.choice(["", "", "ing", "s", "ed"]) for _ in range(rng.randint(20, 120))]
        for _ in range(3 if i % 6 == 0 else 0):
            words.insert(rng.randrange(len(words)), rng.choice(BAD))
        rows.append((i, " ".join(words), "x", "x"))
        if i % 10:
            labels.append((i, 1, int(i % 6 == 0)))
    return rows, labels


def frames(spark, rows, labels):
    return spark.createDataFrame(rows, "doc_id long, text string, score string, label string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_held_out_rows_long_texts_and_repeats(spark):
    rows, labels = corpus()
    long = " ".join(random.Random(7).choice(PLAIN) for _ in range(60_000))
    rows += [(5000, long, "x", "x"), (5001, long[:200_000] + " skrazzer grommelt blightwort skrazzer " + long[200_000:], "x", "x"), (None, "lorem", "x", "x"), (7, rows[6][1], "x", "x")]
    docs, known = frames(spark, rows, labels)
    got = toxicity.scored(docs, known).collect()
    assert len(got) == len(rows) and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in got)
    by_id = {r.doc_id: r for r in got}
    assert all(r.held_out == (zlib.crc32(str(i).encode()) % 5 == 0) for i, r in by_id.items() if i is not None)
    held = [i for i, r in by_id.items() if i is not None and r.held_out and 2 < i < 5000]
    assert np.mean([by_id[i].predicted == (i % 6 == 0) for i in held]) > 0.93
    assert by_id[5001].predicted == 1 and by_id[0].predicted == by_id[1].predicted == 0  # toxic words in the middle of a very long text
    assert len({r.score for r in got if r.doc_id == 7}) == 1
    # the same scores again from other partitions, with every labelled row twice
    again = toxicity.scored(docs.unionByName(docs).repartition(5), known.unionByName(known).repartition(3)).collect()
    assert {(r.doc_id, r.score) for r in again} == {(r.doc_id, r.score) for r in got}


def test_without_labels_or_rows(spark):
    docs, known = frames(spark, corpus(40)[0], [(4, 0, 0)])
    none = toxicity.scored(docs.limit(3), known.limit(0)).collect()
    assert [r.predicted for r in none] == [0, 0, 0]
    assert toxicity.scored(docs.limit(0), known).count() == 0


def test_long_labelled_texts_give_a_bounded_sample(spark, monkeypatch):
    monkeypatch.setattr(toxicity, "SAMPLE_WINDOWS", 3000)
    seen = {}
    monkeypatch.setattr(toxicity, "train", lambda toxic, ordinary: seen.update({1: toxic, 0: ordinary}) or toxicity.Model(b" ", b" ", (0.0,) * 6, (1.0,) * 6, (0.0,) * 6, -2.0))
    rng = random.Random(3)
    docs, known = frames(spark, [(i, " ".join(rng.choices(PLAIN, k=8000)), "x", "x") for i in range(40)], [(i, 0, i % 2) for i in range(40)])
    toxicity.learned(docs, known)
    for part in seen.values():
        assert 2000 < sum(map(len, part)) < 4000 and len(part) > 10


def test_every_dictionary_is_trained_whatever_its_size():
    rng = random.Random(4)
    for n, size in ((40, 3072), (300, 3072), (3000, 100_000)):
        samples = [w for _ in range(n) for w in toxicity.windows(" ".join(rng.choices(PLAIN, k=20)))]
        trained = toxicity._dictionary(size, samples, 16)
        whole = b"".join(samples)
        assert 1000 < len(trained) <= min(size, len(whole)) and trained not in whole
    few = [b"one sample only", b"and another"]
    assert toxicity._dictionary(3072, few, 16) == b"".join(few)
