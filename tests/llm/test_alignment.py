"""Cross-tokenizer alignment against a plain reading, token by token."""

import hashlib
import json
import random
from collections import Counter

import public_tokenizers as P
import pytest
import sentencepiece
from tokenizers import Tokenizer

from lintlake.llm import token_alignment as align

SCHEMA = "doc_id long, text string"


def tokenizers():
    a = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    a.encode_special_tokens = True
    return a, sentencepiece.SentencePieceProcessor(model_file=P.path("piece_bpe_32k.model"))


def a_bytes(entry):
    prints = [*range(33, 127), *range(161, 173), *range(174, 256)]
    back = {chr(b): b for b in prints}
    for k, b in enumerate(b for b in range(256) if b not in prints):
        back[chr(256 + k)] = b
    return bytes(back[c] for c in entry)


def plain(rows):
    """doc_id's columns, by running through both lists of tokens."""
    a, b = tokenizers()
    entry = {i: e for e, i in json.load(open(P.path("byte_bpe_50k.json")))["model"]["vocab"].items()}
    links, out = [], []
    for _, text in rows:
        ids_a = a.encode(" " + text, add_special_tokens=False).ids if text else []
        ids_b = b.encode(text) if text else []
        bytes_a = [a_bytes(entry[i]) for i in ids_a]
        pieces = [b.id_to_piece(i) for i in ids_b]
        bytes_b = [bytes([int(p[3:5], 16)]) if p.startswith("<0x") and len(p) == 6 else p.replace("▁", " ").encode() for p in pieces]
        if not text or b"".join(bytes_a) != (" " + text).encode() or b"".join(bytes_b) != (" " + text).encode():
            out.append((0, 0, [], ""))
            links.append([])
            continue
        ends = []
        for parts in (bytes_a, bytes_b):
            at, own = 0, []
            for x in parts:
                at += len(x)
                own.append(at)
            ends.append(own)
        common = sorted(set(ends[0]) & set(ends[1]))
        groups, at = [], (0, 0)
        for c in common:
            to = tuple(own.index(c, k) + 1 for own, k in zip(ends, at))
            groups.append((ids_a[at[0] : to[0]], ids_b[at[1] : to[1]]))
            at = to
        links.append([(x, y) for x, e in zip(ids_a, ends[0]) for y, f in zip(ids_b, ends[1]) if e == f] if len(ids_a) < 400 else [(g[0][-1], g[1][-1]) for g in groups])
        text = ";".join("|".join(",".join(map(str, side)) for side in g) for g in groups)
        out.append((len(ids_a), len(ids_b), groups, hashlib.sha256(text.encode()).hexdigest()))
    count = Counter(x for own in links for x in own)
    best = {}
    for (_, y), n in count.items():
        best[y] = max(best.get(y, 0), n)
    return [
        (i, na, nb, len(g), len(own), sum(count[x] == best[x[1]] for x in own), sum(count[x] for x in own), sha)
        for (i, _), (na, nb, g, sha), own in zip(rows, out, links, strict=True)
    ], out


def corpus():
    rng = random.Random(3)
    odd = ["a  b", "  two", "\n\nlines\t", "x▁y", "\xa0q", "ﬁne", "nul\x00l", "日本語のテキスト", "🙂🙃 ok", "<|endoftext|> and </s><s>", "é", " ", "▁", "<0x41>", "naïve façade Straße", " sep", "don't we'll I'M", "12345 67", "ı̇İ", ""]
    words = ["alpha", "Beta", "gamma,", "supercalifragilistic", "42", "--", "über", "fin."]
    texts = [*odd, None, *[" ".join(rng.choice(words) for _ in range(rng.randint(1, 60))) for _ in range(60)], " ".join(rng.choice(words) for _ in range(20_000))]
    rows = list(enumerate(texts)) + [(None, "alpha Beta"), (3, "alpha Beta"), (3, "alpha Beta")]
    return rows


def test_against_a_plain_reading(spark):
    rows = corpus()
    d = spark.createDataFrame(rows, SCHEMA).repartition(4)
    columns = ("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")
    key = lambda r: (r[0] is None, r[0] or 0, r[1:])
    got = sorted((tuple(r[c] for c in columns) for r in align.aligned(d).collect()), key=key)
    assert got == sorted(plain(rows)[0], key=key)


def test_spans_and_small_chunks(spark, monkeypatch):
    rows = corpus()[:70]
    want = plain(rows)[1]
    for size in (1, 200, 1 << 20):
        monkeypatch.setattr(align, "CHUNK", size)
        spans, a_ids, b_ids = align._spanned([t for _, t in rows], align.BYTE_BPE, align.PIECE_BPE)
        for k, (_, text) in enumerate(rows):
            na, nb, groups, _ = want[k]
            mine = spans[k].as_py()
            assert [(a_ids[k].as_py()[s["a_from"] : s["a_to"]], b_ids[k].as_py()[s["b_from"] : s["b_to"]]) for s in mine] == groups
            if groups:
                assert mine[0]["first"] == 0 and mine[-1]["after"] == len((" " + text).encode()) and (len(a_ids[k]), len(b_ids[k])) == (na, nb)
    d = spark.createDataFrame(rows, SCHEMA).withColumn("spans", align.F.col("text")).withColumn("row", align.F.col("text"))
    assert align.groups(d).where("size(spans) > 0").count() == sum(bool(g) for _, _, g, _ in want)


@pytest.mark.parametrize("rows", [[], [(1, None)], [(1, "")]])
def test_nothing_to_align(spark, rows):
    got = align.aligned(spark.createDataFrame(rows, SCHEMA)).collect()
    assert [tuple(r) for r in got] == [(1, 0, 0, 0, 0, 0, 0, "")] * len(rows)
