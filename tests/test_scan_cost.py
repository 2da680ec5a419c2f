"""What the scan moves and looks at: files are dealt evenly, and windows see only lines that a rule reads."""

import random
import re

from pyspark.sql import functions as F

from lintlake.operators import lines as L
from lintlake.operators import report
from lintlake.operators import rules as R
from lintlake.operators.catalog import RULES
from lintlake.sources.corpus import SNIPPETS, derived_files

FILE = "project string, path string, content string"
PROFILE = "project string, framework string, has_typescript boolean, uses_runes boolean"
NAMES = [r.name for r in RULES]


def _plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_documents_of_one_row_group_are_many_tasks(spark):
    assert "RepartitionByExpression [doc_id" in _plan(derived_files(spark, "/root/testdata/sf0.001"))


def test_windows_carry_no_neighbours_and_no_line_that_no_rule_reads(spark):
    files = spark.createDataFrame([("p", "a.svelte", "<p>\nplain words\nmore of them\n</p>")], FILE)
    profiles = spark.createDataFrame([("p", "vite", True, True)], PROFILE)
    lines = R.scan_lines(files, profiles, [n for n in NAMES if n in R._PARTS or n == "no-secrets" or R.BY_NAME[n].line])
    assert "lead(" not in _plan(lines) and "lag(" not in _plan(lines)
    assert sorted(r.line for r in lines.collect()) == [1, 4]


def test_lines_left_out_lose_no_hit(spark):
    rng = random.Random(5)
    texts = [s for _, s in SNIPPETS] + ["<script>", "</script>", "<style>", "</style>", "plain words of a text", "", "  alt='x'", "  import {", "  A_TOKEN", "(x) => fetch("]
    rows = [("p", f"src/{k}{end}", "\n".join(rng.choice(texts) for _ in range(rng.randint(1, 60)))) for k in range(80) for end in (".svelte", ".ts")]
    files, profiles = spark.createDataFrame(rows, FILE), spark.createDataFrame([("p", "sveltekit", True, True)], PROFILE)
    got = R.evaluate(files, profiles).exceptAll(R.evaluate(files, profiles, lines=R.scan_lines(files, profiles)))
    back = R.evaluate(files, profiles, lines=R.scan_lines(files, profiles)).exceptAll(R.evaluate(files, profiles))
    assert got.count() == 0 and back.count() == 0


def test_elements_and_imports_are_put_together(spark):
    text = "import {\n  A\n} from '$env/static/public';\n<img\n  src=a\n\n alt=b>\n<p>\n<div\n>\nfrom $env"
    files = spark.createDataFrame([("p", "a.svelte", text)], FILE)
    got = {r.line: (r.element, r.import_up, r.import_text) for r in L.with_regions(L.explode_lines(files, joined=True)).collect()}
    assert got[4][0] == "<img   src=a   alt=b>" and got[8][0] == "<p>" and got[9][0] == "<div >" and got[5][0] is None
    assert got[3][1:] == (2, "import {   A } from '$env/static/public';") and got[11][1:] == (10, "import {   A } from '$env/static/public'; <img   src=a   alt=b> <p> <div > from $env")


def test_a_line_tells_which_rules_look_at_it(spark):
    """The rules' parts of a scan read bits instead of searching all lines again, each for its own texts."""
    texts = [s for _, s in SNIPPETS] + ["<script>", "</style>", "plain words (of a text): more", "", "a \u00a0 import\ttype {"]
    files = spark.createDataFrame([("p", f"f{k}.svelte", t) for k, t in enumerate(texts)], FILE)
    lines = R.scan_lines(files, spark.createDataFrame([("p", "vite", True, True)], PROFILE))
    rules = R._line_rules(NAMES)
    got = lines.select("text", "asked", *[R._may_hit(n).alias(f"r{k}") for k, n in enumerate(rules)]).collect()
    assert len(got) == len(texts) and any(r.asked for r in got)
    assert all(bool(r.asked & R._bits([n])) == r[f"r{k}"] for r in got for k, n in enumerate(rules))
    assert all(bool(r.asked & R.TAGGED) == (any(t in r.text for t in R._TAGS) or r.text.startswith("</")) for r in got)


def test_texts_are_cut_after_each_parenthesis(spark):
    texts = ["", "(", "f(a)(b) c", "no", "))((", "\0(a)\0", "x(\n\u00e9)"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    got = {r.t: list(r.p) for r in df.select("t", R._pieces(F.col("t")).alias("p")).collect()}
    assert got == {t: re.split(r"(?<=[()])", t) for t in texts}


def test_calls_are_looked_at_in_their_files_own_rows(spark):
    """Only files with a call that goes on past the next one, or that stays open, are cut into rows and windowed."""
    effect, derived = "no-effect-for-derived", "no-derived-side-effect"
    texts = {
        "near": "x\nlet a = $derived(f(g(1)));\nlet \u00e9 = $derived.by(() => {\n  console.log((1));\n});\n$effect(() => {\n  b = c + 1;\n});\n$effect(() => { go()",
        "inner": "$derived(a + $derived(fetch(1)))", "open": "\n$effect(() => a = b;", "beside": "$derived(1); $derived(fetch(2));", "many": "$derived(window.x)\n" * (R.NEAR + 5),
        "deep": "$derived" + "(" * 9 + "window.x" + ")" * 9, "empty": "$derived()\n$derived (\n)", "names": "$derivedly (fetch(1)) $effects(() => { a = b; })",
    }
    files = spark.createDataFrame([("p", f"{k}.svelte", t) for k, t in texts.items()] + [("p", "code.ts", "$effect(() => { a = b; })"), ("p", "null.svelte", None)], FILE)
    seen = R.near_calls(files, NAMES)
    far = {r.path[:-7]: set(r.far) for r in seen.where(F.size("far") > 0).collect()}
    assert far == {"inner": {derived}, "open": {effect}, "beside": {derived}, "many": {effect, derived}, "deep": {derived}}
    assert {r.path for r in seen.where("content is not null").collect()} == {f"{k}.svelte" for k in far}
    found = R.evaluate(files, spark.createDataFrame([("p", "vite", True, True)], PROFILE), [effect, derived]).collect()
    got = sorted((r.path[:-7], r.rule == effect, r.line, r.col) for r in found if r.path != "many.svelte")
    assert got == [("beside", False, 1, 14), ("deep", False, 1, 1), ("inner", False, 1, 1), ("inner", False, 1, 14), ("near", False, 3, 9), ("near", True, 6, 1), ("open", True, 2, 1)]
    assert sorted(r.line for r in found if r.path == "many.svelte") == list(range(1, R.NEAR + 6))


def test_written_names_of_declared_state_are_the_same(spark):
    rng = random.Random(3)
    parts = ["let a = $state(1);", "let bc = $state<x>(2);", "\n", "\n", "a", "bc", " = 1;", "++", ".push(", "[0", "] = 2", "// ", "d = 3", "\n  .x = 1"]
    texts = {f"{k}.svelte": "".join(rng.choice(parts) for _ in range(rng.randint(1, 25))) for k in range(400)}
    files = spark.createDataFrame([("p", k, t) for k, t in texts.items()], FILE)
    names = {k: {m for line in t.split("\n") for m in re.findall(r"let (\w+) = \$state", line)} for k, t in texts.items()}
    every = {(r.path, r.name) for r in R._written_names(files).collect()}
    some = {(r.path, r.name) for r in R._written_names(files, declared=True).collect()}
    of_names = lambda found: {(k, n) for k, n in found if n in names[k]}
    assert of_names(every) == of_names(some) and of_names(some)


def test_two_scans_are_dealt_once_to_compare_them(spark):
    rows = [("p", "a", "r", 1, 1, "m", "error"), ("p", "a", "r", 1, 2, "m", "error"), ("p", "a", "r", 2, 1, "m", "warning"), ("q", None, "r", 1, 1, "m", "error")]
    schema = "project string, path string, rule string, line int, col int, message string, severity string"
    before, after = spark.createDataFrame(rows, schema), spark.createDataFrame([rows[0], ("p", "b", "r", 1, 1, "m", "error"), rows[3]], schema)
    counts, changed = report.gate_diff(before, after)
    plan = changed._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange ") == 1 and "Join" not in plan
    assert sorted((r.project, str(r.path), r.line, r.nth, r.change) for r in changed.collect()) == [
        ("p", "a", 1, 2, "resolved"), ("p", "a", 2, 1, "resolved"), ("p", "b", 1, 1, "new"), ("q", "None", 1, 1, "new"), ("q", "None", 1, 1, "resolved")]
    got = {r.project: (r.errors_before, r.warnings_before, r.errors_after, r.warnings_after, r.errors_increased, r.improved) for r in counts.collect()}
    assert got == {"p": (2, 1, 2, 0, False, True), "q": (1, 0, 1, 0, False, False)}
