"""Fixed texts that are looked for before a pattern: they lose no match."""

import pytest
from pyspark.sql import functions as F

from lintlake.functions.text import java, matches, needed, position, trim
from lintlake.operators import rules as R
from lintlake.operators.catalog import RULES
from lintlake.operators.lines import closes_region, is_comment, opens_region
from lintlake.sources.corpus import SNIPPETS


@pytest.mark.parametrize(("pattern", "parts"), [
    (r"\bconsole\.\w+\s*\(", ["console.", "("]), (r"a+b*c?d{0,2}e", ["a", "e"]), (r"x|yz", []), (r"(?i)token", []), (r"(?:one)?two(?!three)", ["two"]),
    (r"[abc\]d]\$:\s", ["$:"]), (r"\{#(?:if|each)\b", ["{#"]), (r"colou?r", ["colo", "r"]),
])
def test_needed_is_what_each_match_holds(pattern, parts):
    assert needed(pattern) == parts


def test_prefilter_changes_no_result(spark):
    texts = [s for _, s in SNIPPETS] + ["", None, "src/a.test.ts", "src/cli.ts", "console.", "fetch(", "  export let x", "$effect (() => {", " <img src='a'>"]
    d = spark.createDataFrame([(t,) for t in texts], "text string").coalesce(1)
    patterns = sorted({p for r in RULES for p in (*r.need, *r.forbid, *r.path_need, *r.path_forbid, r.column, r.group) if p and p[0] != "="} | {*R.SECRETS, *R.SIDE_EFFECTS, *R.ALT, R.BARREL_IMPORT, R.STATE})
    t = F.col("text")
    wrong = [F.count_if(~matches(t, p).eqNullSafe(t.rlike(java(p))) | ~position(t, p).eqNullSafe(F.regexp_instr(t, F.lit(java(p))))).alias(str(i)) for i, p in enumerate(patterns)]
    got = d.agg(*wrong).first()
    assert [p for i, p in enumerate(patterns) if got[i]] == []


def test_one_pattern_says_what_trimming_did(spark):
    ends, bodies = ("", " ", "\t ", " x", ">"), ("<script", "<script>", "<script lang", "</script>", "<style", "<style >", "</style>", "-->", "--> a", "<!-- b", "//", "/*", "*", "/ /", "", "a // b")
    d = spark.createDataFrame([(a + b + c,) for a in ("", " ", " \t", "x ") for b in bodies for c in ends], "text string").coalesce(1)
    text, t = F.col("text"), trim(F.col("text"))
    comment = t.startswith("//") | t.startswith("*") | t.startswith("/*")
    checks = [R.meaningful(text) == ((t != "") & ~comment & (t != "-->") & ~t.startswith("<!--")), is_comment(text) == comment]
    for name in ("script", "style"):
        checks += [opens_region(text, name) == t.rlike(java(rf"^<{name}[\s>]")), closes_region(text, name) == (t == f"</{name}>")]
    assert [r.text for r in d.where(~F.forall(F.array(*checks), lambda x: x)).collect()] == []


def test_files_are_matched_once_for_all_patterns(spark, monkeypatch):
    """Imports are found by one pass over the files and exports by another, however many patterns there are."""
    from lintlake.operators import graph

    files = spark.createDataFrame([("p", "src/a.ts", "import { b, type C } from './b';\nconst l = import('./b');\nexport * from './b';"), ("p", "src/b.ts", "export const b = 1;")], "project string, path string, content string")
    passes = []
    monkeypatch.setattr(graph, "_code", lambda files, word, of=graph._code: passes.append(word) or of(files, word))
    edges = {(r.symbol, r.exported_as) for r in graph.import_edges(files).collect()}
    assert edges == {("b", None), ("C", None), ("*", None), ("*", "*")} and passes == ["import", "export"]
    assert "ExistingRDD" not in graph.requests(files)._jdf.queryExecution().optimizedPlan().toString()  # what follows reads the matches, not the files


def test_rewrites_work_on_lines_that_hold_what_they_change(spark):
    """Files are dealt before they are cut into lines, and what a change looks for is in each line that it changes."""
    from lintlake.operators import rewrite as W

    files = spark.createDataFrame([("p", "a.svelte", "\n".join(s for _, s in SNIPPETS))], "project string, path string, content string")
    plan = W.lines_of(files)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Generate") < plan.index("RepartitionByExpression")
    for change, part in W.TOUCHED.items():
        changed = W.lines_of(files).where(change(F.col("text")) != F.col("text")).select("text").collect()
        assert changed and all(part in r.text for r in changed)
