"""Repeats that a span of three sentences leaves: short inner runs, short lines, what follows a long sentence."""

import random

from lintlake.llm import substring

WORDS = "amber birch cedar delta ember fjord grove heath inlet jetty knoll larch marsh north ocean prairie quarry ridge stream tundra".split()


def left(spark, texts):
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    return [r.text for r in sorted(substring.dedup(df).collect(), key=lambda r: r.doc_id)]


def test_two_inner_sentences_of_a_passage_go(spark):
    inner = "The ferry left the pier at dawn with nine cows aboard. Its bell was heard as far as the mill. "
    texts = [f"Opening {k} of this page runs into the ferry story here. {inner}Closing {k} leaves it again with other words." for k in range(2)]
    assert left(spark, texts) == [texts[0], texts[1].replace(inner, "")]


def test_a_passage_of_short_lines_goes(spark):
    lines = "".join(f"{WORDS[k]} and {WORDS[k + 1]} meet\n" for k in range(15))
    texts = [f"Own line {k} with its own words.\n{lines}Last line {k} with other words." for k in range(2)]
    assert left(spark, texts) == [texts[0], texts[1].replace(lines, "")]


def test_short_sentences_beside_a_long_one_go(spark):
    long = " ".join(WORDS + WORDS[::-1] + WORDS[:5]) + ". "
    for passage in (long + "Nobody came. Rain fell. ", "Nobody came. Rain fell. " + long):
        texts = [f"Own start {k} here. {passage}Own end {k} there." for k in range(2)]
        assert left(spark, texts) == [texts[0], texts[1].replace(passage, "")]


def test_stock_phrases_stay(spark):
    texts = [f"Own start {k} here. All rights reserved. Read our terms. Own end {k} there." for k in range(2)]
    assert left(spark, texts) == texts


def test_every_repeated_run_goes(spark):
    rng = random.Random(8)
    texts = []
    for k in range(60):
        run = [[rng.choice(WORDS) + str(k) for _ in range(rng.choice([1, 2, 4, 9, 20, 45]))] for _ in range(rng.randint(2, 12))]
        text = lambda end, run=run, k=k: f"own{k}{end}. " + "".join(" ".join(w) + ". " for w in run) + f"end{k}{end}."
        texts += [text("a"), text("b")]
        whole = sum(map(len, run)) >= substring.LEAST
        texts.append(f"own{k}b. end{k}b." if whole else text("b"))  # what is expected of the one before
    got = left(spark, [t for i, t in enumerate(texts) if i % 3 != 2])
    assert got[1::2] == texts[2::3]
