import random
from collections import Counter

import numpy as np
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st

from lintlake.llm import common, simhash, substring

from . import brute


def brute_fingerprint(text):
    words = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    for c in "\t\n\x0b\x0c\r":
        words = words.replace(c, " ")
    words = [w for w in words.split(" ") if w]
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(rows):
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for i, (a, fa) in enumerate(rows):
        for b, fb in rows[i:]:
            if (fa ^ fb).bit_count() <= 3:
                x, y = sorted((find(a), find(b)))
                parent[y] = x
    return {a: find(a) for a, _ in rows}


@settings(max_examples=80, deadline=None)
@given(st.text(alphabet="aBÀé \t\n\x0b z", max_size=60))
def test_fingerprint_is_as_defined(text):
    assert simhash.fingerprint(text) == brute_fingerprint(text)


def test_masks_cover_every_pair_within_the_radius():
    rng, masks = random.Random(1), simhash.masks()
    for _ in range(3000):
        diff = sum(1 << b for b in rng.sample(range(64), rng.randint(0, 3)))
        assert any(m & diff == 0 for m in masks)


def test_components_against_brute_force(spark, monkeypatch):
    monkeypatch.setattr(simhash, "BLOCK", 8)  # so that buckets of many blocks occur
    rng = random.Random(3)
    base = [rng.getrandbits(64) for _ in range(40)]
    rows = []
    for i in range(400):
        f = base[0] if i % 3 == 0 else rng.choice(base)
        for b in rng.sample(range(64), rng.choice([0, 1, 2, 3, 4])):
            f ^= 1 << b
        rows.append((i, f))
    df = spark.createDataFrame([(a, int(np.uint64(f).view(np.int64))) for a, f in rows], "doc_id long, fp long")
    got = {r.doc_id: r.component_id for r in simhash.clustered(df).collect()}
    assert got == brute_components(rows)


def test_long_chains_are_one_component(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(60)] + [(100, 101), (7, 7)], "a long, b long")
    got = {r.node: r.component for r in common.components(edges).collect()}
    assert got == {i: 0 for i in range(61)} | {100: 100, 101: 100}


def test_near_duplicates_edge_cases(spark):
    rows = [(1, None, "x"), (2, "", "x"), (3, " \n", "x"), (4, "One two three four", "x"), (4, "One two three four", "x"), (5, "one TWO three\nfour", "x"), (None, "one two three four", "x"), (None, "alone here now", "x"), (None, "Alone here\nnow", "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, fp string")
    got = Counter((r.doc_id, r.fingerprint == "0" * 16, r.component_id) for r in simhash.near_duplicates(df).collect())
    want = [(1, True, 1), (2, True, 1), (3, True, 1), (4, False, 4), (4, False, 4), (5, False, 4), (None, False, 4), (None, False, None), (None, False, None)]
    assert got == Counter(want)
    kept = sorted((r.doc_id or -1) for r in simhash.one_of_each(df).collect())
    assert kept == [-1, 1, 4]  # a copy of row 4 goes, of two copies without an id one stays
    assert simhash.near_duplicates(df.limit(0)).count() == 0


def test_segments_give_the_text_back():
    for text in ("", "a", "One. Two!  Three?\n\n four", "\n\n", "no stop", 'He said "so." Then.\n'):
        assert "".join(substring.segments(text)) == text


PASSAGE = "The river rose in the night. Nobody in the village had seen it so high before. By noon the mill was under water, and the miller sat on his roof with two hens and a clock."


def test_substring_dedup_removes_all_but_the_first(spark):
    own = {i: f"Opening words of number {i} stand here. And so does a second line of {i}." for i in range(6)}
    rows = [(i, f"{own[i]}\n{PASSAGE}\nClosing line {i}.", "en", "s", 1) for i in range(5)]
    rows += [(5, own[5], "en", "s", 1), (6, None, "en", "s", 1), (7, "", "en", "s", 1), (7, "", "en", "s", 1), (8, "Yes. No. Of.", None, None, 1), (9, "Yes. No. Of.", None, None, 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    out = substring.dedup(df)
    got = {}
    for r in out.collect():
        got.setdefault(r.doc_id, r)
        assert r.n_chars == len(r.text or "")
    assert out.count() == len(rows)
    assert got[0].text == rows[0][1]
    for i in range(1, 5):
        assert got[i].text == f"{own[i]}\nClosing line {i}."
    assert got[5].text == own[5] and got[6].text is None and got[7].text == ""
    assert got[8].text == got[9].text == "Yes. No. Of."  # too short to be a span


def test_substring_dedup_against_brute_force(spark):
    rng = random.Random(5)
    pool = [" ".join(rng.choice("alpha beta gamma delta Epsilon zeta eta theta".split()) for _ in range(rng.randint(1, 30))) + rng.choice([". ", "!\n", '." ', "\n\n"]) for _ in range(60)]
    docs = {i: "".join(rng.choice(pool) for _ in range(rng.randint(0, 14))) for i in range(120)} | {500: None, 501: "", 502: " \n ", 503: "no end"}
    df = spark.createDataFrame([(i, t, "x", i) for i, t in docs.items()], "doc_id long, text string, at string, key int")
    for least in (substring.LEAST, 1):
        out = substring.dedup(df, "n", least)
        assert out.columns == [*df.columns, "n"]
        want = brute.without_repeats(docs, least=least)
        assert {r.doc_id: r.text for r in out.collect()} == want and sum(want[i] != docs[i] for i in docs) > 30
    assert substring.dedup(df.limit(0)).count() == 0


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="aB.!\"') \n\t", max_size=40))
def test_sentences_are_as_read_plainly(text):
    assert substring.segments(text) == brute.sentences(text)


def test_a_very_long_text_and_a_hot_passage(spark):
    own = " ".join(f"Sentence {k} has words of its own." for k in range(30_000))
    rows = [(0, own + PASSAGE)] + [(i, f"Start {i} of this one. {PASSAGE} Own end {i} here.") for i in range(1, 300)]
    got = {r.doc_id: r.text for r in substring.dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == brute.without_repeats(dict(rows)) and got[0] == rows[0][1] and "river" not in got[7]
