"""Thresholds come from each group's own distribution, small groups leaning on their language's."""

import random

from lintlake.llm import quality


def corpus():
    rng = random.Random(6)
    line = lambda n: " ".join("".join(rng.choices("abcdefghij", k=6)) for _ in range(n))

    def document(dups, repeats):
        same, again = line(1), line(5)
        words = [line(30), *[same] * (dups + 1), *[line(1) for _ in range(14 - dups)], line(30)]
        return "\n".join(words) + (f" {again} {line(1)} {again}" if repeats else "")

    rows = [(i, document(0, False), "en", "plain") for i in range(300)]
    rows += [(i, document(3 if i % 10 == 0 else 0, i % 10 == 0), "en", "varied") for i in range(300, 600)]
    rows += [(1000, document(3, False), "en", "plain"), (1001, document(0, True), "en", "plain"), (1002, document(3, False), "en", "varied"), (1003, document(0, True), "en", "varied")]
    return rows, document


def test_groups_get_thresholds_and_verdicts_of_their_own(spark):
    rows, _ = corpus()
    # so many plain documents that the language itself has hardly any repeats
    rows += [(i + 5000, t, "en", "more") for i, t, _, s in rows if s == "plain" and i < 1000 for _ in range(4)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    limits = {r["t_source"]: r for r in quality.thresholds(quality.sketches(quality.measured(df))).collect()}
    for metric in ("t_dup_line_rate", "t_repeat_rate"):
        assert limits["plain"][metric] < limits["varied"][metric] < 300
    assert limits["varied"]["t_repeat_rate"] < 200  # below what the base rule rejects
    for kept in ({r.doc_id for r in quality.keep(df).collect()}, {r.doc_id for r in quality.scored(df).where("kept").collect()}):
        assert not {1000, 1001} & kept and {1002, 1003} <= kept
        assert len(kept & set(range(300))) >= 290 and len(kept & set(range(300, 600))) >= 290


def test_limits_follow_the_data(spark):
    words = lambda symbols: " ".join(f"w{k:04d}" + "#" * (k < symbols) for k in range(100))
    few = [(i, words(0), "en", "a") for i in range(200)]
    limit = lambda part: quality.thresholds(quality.sketches(quality.measured(spark.createDataFrame(few + part, "doc_id long, text string, lang string, source string")))).first()["t_symbol_rate"]
    some = [(i, words(3), "en", "a") for i in range(200, 230)]
    more = [(i, words(30), "en", "a") for i in range(200, 230)]
    assert limit([]) < limit(some) < limit(more)


def test_a_small_group_leans_on_its_language(spark):
    rows, document = corpus()
    lone = [(2000, document(3, True), "en", "small"), (2001, document(3, True), "xx", None)]
    df = spark.createDataFrame(rows + lone, "doc_id long, text string, lang string, source string")
    limits = {(r["t_lang"], r["t_source"]): r["t_dup_line_rate"] for r in quality.thresholds(quality.sketches(quality.measured(df))).collect()}
    whole = {r["t_lang"]: r["t_dup_line_rate"] for r in quality.thresholds(quality.sketches(quality.measured(df.selectExpr("text", "lang", "'all' as source")))).collect()}
    assert limits[("en", "small")] == whole["en"]
    lines = lone[1][1].count("\n") + 1
    assert limits[("xx", None)] >= 2000 // lines > 100  # its own rate, the first of three repeated lines not counted: a group that is its whole language has nothing to lean on


def test_a_clean_group_takes_an_odd_character_and_a_narrow_one_its_own_spread(spark):
    text = lambda k, odd="": " ".join(f"w{k}x{j}" for j in range(200)) + odd
    rows = [(i, text(i % 10), "en", "clean") for i in range(300)] + [(1000, text(3, " a & b"), "en", "clean"), (1001, text(3, " #" * 150), "en", "clean")]
    rows += [(2000 + i, text(i % 10, " &" * (1 + i % 3)), "en", "other") for i in range(40)]
    kept = {r.doc_id for r in quality.keep(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")).collect()}
    assert 1000 in kept and 1001 not in kept and set(range(300)) <= kept
