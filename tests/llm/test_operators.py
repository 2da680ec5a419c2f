"""Small cases of the operators that other files here don't cover: nulls, empties, ties, repeated rows, clashing columns."""

import json
import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lintlake.llm import html_extract, mixing, quality, tool_calls, url_filter

# --- 1, HTML extraction


def test_lines_and_main_text():
    page = (
        "<!DOCTYPE html><html><head><title>T</title><style>p{}</style></head><body><nav><ul><li>Home</ul></nav><div class='side-bar ad'>Buy<p>now</div>"
        "<script>var a = '</p>';</script><article><h1>Head &amp; tail</h1><p>One\n  <b>two</b><br>three<p>Four&nbsp;five</p><form>mail</form>"
        "<section id=comments><p>First!</p></section></article><aside>x</aside><footer>&copy; y</footer></body></html>"
    )
    text, _ = html_extract.main_text(html_extract.lines_of(page), None)
    assert text == "Head & tail\nOne two three\nFour five"


def test_shared_lines_go_where_no_article_is_marked():
    page = lambda body: f"<body><div>Top bar</div><p>{body}</p><div>Legal note</div></body>"
    a, b = html_extract.lines_of(page("Own story, long enough to stand.")), html_extract.lines_of(page("Another story that is told here."))
    assert html_extract.main_text(a, b) == ("Own story, long enough to stand.", 2)
    assert html_extract.main_text(a, a)[0] == "Top bar\nOwn story, long enough to stand.\nLegal note"  # a copy teaches nothing


@settings(max_examples=150, deadline=None)
@given(st.lists(st.sampled_from("abcd"), max_size=12), st.lists(st.sampled_from("abcd"), max_size=12))
def test_common_lines_are_a_longest_common_subsequence(a, b):
    one = lambda x: [c for k, c in enumerate(x) if k == 0 or c != x[k - 1]]
    x, y = one(a), one(b)
    best = np.zeros((len(x) + 1, len(y) + 1), int)
    for i in range(len(x)):
        for j in range(len(y)):
            best[i + 1, j + 1] = best[i, j] + 1 if x[i] == y[j] else max(best[i, j + 1], best[i + 1, j])
    found = html_extract.common_lines(a, b)
    assert len(one([(a[k], k - sum(1 for m in range(k) if a[m] == a[m + 1])) for k in sorted(found)])) >= best[-1, -1]
    assert all(a[k] in b for k in found)


def test_extract_table(spark):
    story = "<article><p>story {}</p></article>"
    rows = [(1, "http://a.b/x/1", story.format(1)), (2, "http://a.b/x/2", story.format(2)), (3, None, None), (4, "no url", ""), (4, "no url", ""), (5, "http://c.d/", "<p>alone</p>")]
    got = sorted((r.page_id, r.text, r.n_chars, r.pair_page_id) for r in html_extract.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect())
    assert [x[:3] for x in got] == [(1, "story 1", 7), (2, "story 2", 7), (3, "", 0), (4, "", 0), (4, "", 0), (5, "alone", 5)]
    assert html_extract.extract(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


# --- 3, tool calls


def test_linking(spark):
    calls = [("c", 1, "a", "search", '{"query":"q", "limit": 3}', None), ("c", 3, "b", "lookup", "{bad", "a"), ("c", 5, "d", "lookup", '{"query":null,"z":1}', "b"), ("c", 7, "e", "other", "[1]", "nowhere"),
             ("c", 8, "x", "search", "{}", "y"), ("c", 9, "y", "search", "{}", "x"), ("c", 1, "a", "search", '{"query":"q", "limit": 3}', None), (None, None, None, None, None, None)]
    results = [("c", 2, "a", "first"), ("c", 4, "a", "second"), ("c", 6, "zz", None)]
    one = spark.createDataFrame(calls, "conv string, turn long, call_id string, name string, arguments string, after string")
    two = spark.createDataFrame(results, "conv string, turn long, call_id string, content string")
    got = {(r.conv, r.call_id): r for r in tool_calls.link(one, two).collect()}
    assert len(got) == 8
    assert {k[1]: r.status for k, r in got.items() if k[0]} == {"a": "linked", "b": "pending", "d": "pending", "e": "pending", "x": "circular", "y": "circular", "zz": "orphan"}
    assert {k[1]: r.depth for k, r in got.items() if k[0]} == {"a": 0, "b": 1, "d": 2, "e": 0, "x": None, "y": None, "zz": 0}
    assert got[("c", "a")].canonical == '{"arguments":{"limit":3,"query":"q"},"id":"a","name":"search","result":"first"}'
    assert {k[1]: r.errors for k, r in got.items() if k[0]} == {"a": "", "b": "malformed", "d": "missing query; unknown z", "e": "not an object; unknown after", "x": "missing limit; missing query", "y": "missing limit; missing query", "zz": ""}
    order = [k[1] for k, r in sorted(got.items(), key=lambda x: x[1].position) if k[0]]
    assert order == ["a", "zz", "e", "b", "d", "x", "y"]
    assert all(json.loads(r.canonical) for r in got.values())
    assert tool_calls.link(one.limit(0), two.limit(0)).count() == 0


def test_rows_without_ids_are_kept_and_link_with_none(spark):
    calls = [("c", 1, None, "search", "{}", None)] * 2 + [("c", 2, None, 'sea"rch\n', "{}", "a"), ("c", 3, "a", "lookup", '{"query":"x"}', None), (None, 1, "a", "lookup", "{}", "b"), (None, 1, "a", "lookup", "{}", None)]
    results = [("c", 5, None, "r")] * 3 + [(None, 5, "a", "r"), ("c", 6, "a", "mine")]
    one = spark.createDataFrame(calls, "conv string, turn long, call_id string, name string, arguments string, after string").withColumn("status", F.lit("clash"))
    two = spark.createDataFrame(results, "conv string, turn long, call_id string, content string").withColumn("depth", F.lit("clash"))
    got = tool_calls.link(one, two).collect()
    assert sorted((r.conv or "", r.call_id or "", r.status) for r in got) == sorted([("c", "", "pending")] * 3 + [("c", "", "orphan")] * 3 + [("c", "a", "linked")] + [("", "a", "pending")] * 2 + [("", "a", "orphan")])
    assert sorted(r.position for r in got if r.conv == "c") == list(range(7))
    assert {r.depth for r in got if r.name == 'sea"rch\n'} == {1} and all(json.loads(r.canonical) for r in got)


def test_turns_without_a_conversation_stay_apart(spark):
    rows = [(None, 1, "assistant", "one two"), (None, 1, "assistant", "one two"), (None, 1, "assistant", None), (None, 2, "user", "x"), (1, None, "assistant", "y"), (1, 1, "assistant", "z"), (1, 2, "user", None), (1, 3, "assistant", "long " * 200_000)]
    d = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("conv", F.lit("clash")).withColumn("depth", F.lit("clash"))
    got = tool_calls.linked(d).collect()
    assert sorted((r.conv or "", r.status) for r in got) == sorted([("", "pending")] * 3 + [("", "orphan"), ("1", "pending"), ("1", "pending"), ("1", "linked")])
    assert all(r.position == 0 for r in got if r.conv is None)


def test_long_chains_take_few_rounds(spark):
    rows = [("c", str(k), str(k - 1) if k else None) for k in range(40)]
    got = tool_calls.depths(spark.createDataFrame(rows, "conv string, call_id string, after string")).collect()
    assert {r.call_id: r.depth for r in got} == {str(k): k for k in range(40)}


# --- 4, quality rules


def brute_counts(text):
    text = text or ""
    words = [w for w in "".join(" " if c in "\t\n\x0b\x0c\r" else c for c in text).split(" ") if w]
    windows = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    repeat = {i + k for i, w in enumerate(windows) if windows.count(w) > 1 for k in range(5)}
    lines = text.split("\n")
    dup = sum(1 for k, x in enumerate(lines) if x.strip("\t\n\x0b\x0c\r ") and x in lines[:k])
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), dup, len(repeat)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.sampled_from(["a", "b", "é#", "a", "\n", "\x0b", " ", "c*\n"]), max_size=40).map(" ".join))
def test_counts_are_as_defined(text):
    assert quality.features_of(text) == brute_counts(text)


def test_repeats_with_many_distinct_words():
    words = [f"w{k}" for k in range(7000)]
    assert quality._repeats([w.encode() for w in words + words[:50]]) == 100


def test_outliers_go_and_ordinary_documents_stay(spark):
    rng = random.Random(4)
    rows = [(i, " ".join(rng.choice(["alpha", "beta", "gamma", "delta"]) + str(rng.randint(0, 999)) for _ in range(60)), "en", f"s{i % 2}", 1) for i in range(400)]
    rows += [(1000, " ".join(f"x{k}###" for k in range(60)), "en", "s0", 1), (1001, None, None, None, None), (1002, "", "en", "s1", 0), (1003, " ".join(f"long{k}" * 20 for k in range(40)), "en", "s1", 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, up long")
    got = {r.doc_id: r for r in quality.scored(df).collect()}
    assert {i for i, r in got.items() if not r.kept} == {1000, 1001, 1002, 1003} and got[1002].base_failed and not got[1000].base_failed
    kept = quality.keep(df)
    assert kept.columns == df.columns and kept.count() == 400
    assert quality.keep(df.limit(0)).count() == 0


def test_sketches_merge_to_the_whole(spark):
    rng = random.Random(1)
    values = [rng.randint(0, 5000) for _ in range(4000)]
    bins = spark.createDataFrame([(v,) for v in values], "v long").select(F.col("v"), quality.bin_of(F.col("v")).alias("b")).collect()
    assert all(r.b <= r.v and r.v - r.b <= r.v / 32 for r in bins)


# --- 7, URL filters


def test_url_filter(spark):
    rows = [(1, "http://A.org/x"), (2, "https://x.example.org/es/1"), (3, "http://example.org/en/12"), (4, "http://a.com/fr/"), (5, "http://a.com/de/1"), (6, None), (7, "no"), (8, "http://bad.net/p?q"), (9, "https://www.bad.net/p/#x"), (10, "http://ok.net/p"), (10, "http://ok.net/p"), (11, "http://notexample.org/es/1"), (12, "http://a.org")]
    df = spark.createDataFrame(rows, "page_id long, url string").withColumn("host", F.lit("clash")).withColumn("block", F.lit(1))
    listed = spark.createDataFrame([("bad.net/p",), ("bad.net/p",), (None,)], "canonical string")
    got = sorted((r.page_id, r.host, r.path, r.rule, r.verdict) for r in url_filter.filter_urls(df, listed).collect())
    assert [(g[0], g[3], g[4]) for g in got] == [(1, "org/", "allow"), (2, "example.org/es/", "block"), (3, "example.org/en/1", "block"), (4, "com/fr/", "allow"), (5, "com/de/", "block"), (6, None, "allow"), (7, None, "allow"), (8, None, "block"), (9, None, "block"), (10, None, "allow"), (10, None, "allow"), (11, "org/", "allow"), (12, None, "allow")]
    assert got[0][1:3] == ("a.org", "/x") and got[5][1:3] == ("", "") and got[12][1:3] == ("a.org", "")
    assert url_filter.filter_urls(df.limit(0), listed).count() == 0


def test_bloom_filter_has_no_false_negatives(spark):
    keys = spark.range(3000).select(F.concat(F.lit("k"), "id").alias("canonical"))
    pages = keys.select(F.concat(F.lit("http://"), "canonical").alias("url"), F.monotonically_increasing_id().alias("page_id"))
    out = url_filter.filter_urls(pages, keys, rules=())
    assert out.where("verdict = 'block'").count() == 3000


def test_false_positives_of_the_bloom_filter_are_taken_out(spark, monkeypatch):
    monkeypatch.setattr(url_filter, "BLOCKS", 1)  # a filter so full that every URL may be listed
    keys = spark.range(500).select(F.concat(F.lit("k"), "id", F.lit(".net/")).alias("canonical"))
    pages = spark.range(1000).select(F.col("id").alias("page_id"), F.concat(F.lit("http://k"), "id", F.lit(".net/")).alias("url"))
    assert url_filter.bloom(keys, 1).select(F.bit_count("w0") + F.bit_count("w1") + F.bit_count("w2") + F.bit_count("w3")).first()[0] == 256
    listed = keys.select(F.regexp_replace("canonical", "/$", "").alias("canonical"))
    got = {r.page_id: r.verdict for r in url_filter.filter_urls(pages, listed, rules=()).collect()}
    assert got == {i: "block" if i < 500 else "allow" for i in range(1000)}
    none = url_filter.filter_urls(pages, listed.limit(0), rules=())
    assert none.count() == 1000 and none.where("verdict = 'block'").count() == 0


# --- 9, mixing


@pytest.mark.parametrize("seed", [1, 2])
def test_mixing_against_water_filling(spark, seed):
    rng = random.Random(seed)
    rows = [(i, " ".join(["w"] * rng.randint(0, 40)), rng.choice(["a", "b", "b", "b", "c", "d", None]) if i else "tiny") for i in range(400)] + [(7, None, "a"), (8, "", "e")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").withColumn("size", F.lit("clash"))
    got = mixing.mixed(df.drop("size")).collect()
    assert len(got) == len(rows)
    sizes = {}
    for _, t, s in rows:
        sizes[s] = sizes.get(s, 0) + len((t or "").split())
    order = sorted((s for s in sizes if s is not None)) + [None]
    weight = {s: k % 3 + 1 for k, s in enumerate(order)}
    target, open_, left = {}, set(order), float(sum(sizes.values()))
    while True:
        share = {s: left * weight[s] / sum(weight[t] for t in open_) for s in open_}
        over = {s for s in open_ if share[s] > 3 * sizes[s]}
        if not over:
            target |= share
            break
        for s in over:
            target[s] = 3.0 * sizes[s]
        left -= sum(target[s] for s in over)
        open_ -= over
    for s in order:
        mine = [r for r in got if r.source == s]
        assert all(abs(r.target - target[s]) < 1e-6 and r.source_size == sizes[s] for r in mine)
        assert abs(sum(r.taken for r in mine) - target[s]) <= 1
        assert all(r.taken <= 3 * r.size for r in mine)
    again = mixing.mixed(df.drop("size").repartition(3)).collect()
    assert sorted(map(str, got)) == sorted(map(str, again))


def test_curriculum_rows_carry_the_words_taken(spark):
    rows = [(i, f" start {i}\n" + "word " * (i % 30), "ab"[i % 2] if i % 7 else "c", i) for i in range(200)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, n_chars long")
    taken = {r.doc_id: r.taken for r in mixing.mixed(df).collect()}
    got = {}
    out = mixing.curriculum(df, "at").collect()
    for r in out:
        assert r.n_chars == len(r.text) and 0 <= r["at"] <= 1
        got[r.doc_id] = got.get(r.doc_id, 0) + len(r.text.split())
    assert got == {i: n for i, n in taken.items() if n}
    assert [r["at"] for r in out] == sorted(r["at"] for r in out)
    assert mixing.curriculum(df.limit(0)).count() == 0
