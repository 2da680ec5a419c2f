"""Unused code: import and export edges, anti-joins and reachability."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lintlake.functions.text import java_lines
from lintlake.operators.lines import is_comment
from lintlake.sources.shared import forget, written

#: Where a statement can begin: at a line's start, after another one, or after a tag.
_START = r"(?m)(?:^|[;}>])[ \t]*"
_SPEC = r"""['"]([^'"\n]+)['"]"""
#: Static imports by clause and module; imports for effects; imports by call; re-exports by type, list and module.
IMPORT = _START + r"import\s+([\w$\s{},*]+?)\s*\bfrom\s*" + _SPEC
EFFECT = _START + r"import\s*" + _SPEC
CALL = r"(?=[ir])\b(?:import|require)\s*\(\s*" + _SPEC + r"\s*[,)]"
FROM = _START + r"export\s+(type\s+)?(\*(?:\s+as\s+[\w$]+)?|\{[^}]*\})\s*from\s*" + _SPEC
#: Exports of declarations, of destructured names, of lists, and the default.
EXPORT = _START + r"export\s+(?:declare\s+)?(?:abstract\s+)?(?:async\s+)?(const\s+enum|const|let|var|function\s*\*?|class|type|interface|enum|namespace)\s+([\w$]+)"
EXPORT_PARTS = _START + r"export\s+(?:const|let|var)\s*\{([^}=]*)\}\s*="
EXPORT_LIST = _START + r"export\s+(type\s+)?\{([^}]*)\}(?!\s*from\b)"
DEFAULT = _START + r"export\s+default\b"
#: A component's module script: what it exports is the module's; exports of its other script are the component's inputs.
MODULE_SCRIPT = r"""(?s)<script(?=[^>]*(?:\bmodule\b|context=["']module["']))[^>]*>(.*?)</script>"""
#: Endings and index files that a relative import may leave out.
CANDIDATES = ("", ".ts", ".js", ".svelte", ".svelte.ts", ".svelte.js", ".d.ts", "/index.ts", "/index.js", "/index.svelte")
#: Files that are run by a framework, a tool or by hand, and so need no importer (fixed values).
ENTRIES = (
    r"(^|/)src/routes/(.*/)?\+(page|layout|server|error)[^/]*\.(svelte|ts|js)$", r"(^|/)src/(hooks|service-worker|app|main|index)[\w.]*\.(svelte|ts|js)$", r"(^|/)src/params/[^/]+\.(ts|js)$",
    r"(^|/)[\w.-]+\.config\.(ts|js)$", r"(^|/)[^/]+\.(test|spec|stories)\.(svelte|ts|js)$", r"^(index|main|cli)\.(ts|js)$", r"\.d\.ts$",
)
#: The name that stands for all names of a module, and a module's main one.
ALL, MAIN = "*", "default"


def _normal(path):
    """A path without ``.`` parts, each ``..`` taken out with the part before it; those that lead above the top stay."""
    part = lambda done, x: (
        F.when(x.isin(".", ""), done)
        .when((x == "..") & (F.size(done) > 0) & (F.element_at(done, -1) != ".."), F.slice(done, 1, F.size(done) - 1))
        .otherwise(F.concat(done, F.array(x)))
    )
    return F.array_join(F.aggregate(F.split(path, "/"), F.array().cast("array<string>"), part), "/")


def _code(files: DataFrame, word: str) -> DataFrame:
    """project, path, code: files that have ``word``, without lines that are comments."""
    own = files.where(F.contains("content", F.lit(word)))
    return own.select("project", "path", F.array_join(F.filter(F.split("content", "\n", -1), lambda t: ~is_comment(t)), "\n").alias("code"))


def _matched(code: DataFrame, patterns: dict[str, str]) -> DataFrame:
    """project, path, kind, x: each match of each of ``patterns``, by one pass over the files; written, since matches are short and read by kind."""
    all_of = lambda kind, p: F.transform(F.regexp_extract_all("code", F.lit(java_lines(p)), F.lit(0)), lambda x: F.struct(F.lit(kind).alias("kind"), x.alias("x")))
    d = code.select("project", "path", F.explode(F.concat(*[all_of(kind, p) for kind, p in patterns.items()])).alias("m"))
    return written(d.select("project", "path", "m.kind", "m.x"))


def _found(matched: DataFrame, kind: str, pattern: str, *parts: str) -> DataFrame:
    """project, path and the groups of each match of ``kind``, by name."""
    p = java_lines(pattern)
    return matched.where(F.col("kind") == kind).select("project", "path", *[F.regexp_extract("x", p, i + 1).alias(name) for i, name in enumerate(parts)])


def _named(names: Column) -> Column:
    """(symbol, alias) of each entry of a list in braces; an alias is the symbol itself if there is none."""
    entry = F.transform(F.split(names, ","), lambda n: F.regexp_replace(F.trim(F.regexp_replace(n, r"\s+", " ")), r"^type (?=\w)(?!as )", ""))
    pair = F.transform(F.filter(entry, lambda n: n != ""), lambda n: F.struct(F.split(n, " as ")[0].alias("symbol"), F.element_at(F.split(n, " as "), -1).alias("alias")))
    return pair


def requests(files: DataFrame) -> DataFrame:
    """project, from_path, spec, symbol, exported_as: what each module asks of others, by name.

    symbol: the name in the other module, ``default``, ``*`` for all of them (namespaces, imports by call) or empty
    for none (imports for effects). exported_as: under what name a re-export hands it on, ``*`` for all under
    their own; null for imports.
    """
    found = _matched(_code(files, "import"), {"static": IMPORT, "effect": EFFECT, "call": CALL})
    handing = _matched(_code(files, "export"), {"from": FROM})
    none = F.lit(None).cast("string")
    row = lambda d, symbol, alias=none: d.select("project", F.col("path").alias("from_path"), "spec", symbol.alias("symbol"), alias.alias("exported_as"))
    static = _found(found, "static", IMPORT, "clause", "spec")
    main = F.regexp_extract("clause", r"^(?:type\s+)?([\w$]+)\s*(?:,|$)", 1)
    listed = static.withColumn("n", F.explode(_named(F.regexp_extract("clause", r"\{([^}]*)\}", 1))))
    passed = _found(handing, "from", FROM, "type", "what", "spec")
    handed = passed.where("what like '{%'").withColumn("n", F.explode(_named(F.regexp_extract("what", r"\{([^}]*)\}", 1))))
    under = F.regexp_extract("what", r"as\s+([\w$]+)$", 1)
    parts = [
        row(static.where(main != ""), F.lit(MAIN)), row(static.where(F.contains("clause", F.lit("*"))), F.lit(ALL)), row(listed, F.col("n.symbol")),
        row(_found(found, "effect", EFFECT, "spec"), F.lit("")), row(_found(found, "call", CALL, "spec"), F.lit(ALL)),
        row(handed, F.col("n.symbol"), F.col("n.alias")), row(passed.where("what like '*%'"), F.lit(ALL), F.when(under == "", ALL).otherwise(under)),
    ]
    return reduce(DataFrame.unionByName, parts).where("spec like '.%' or spec like '$lib%'").distinct()


def import_edges(files: DataFrame) -> DataFrame:
    """project, from_path, to_path, symbol, exported_as: requests of modules of the project, resolved to its files.

    Relative modules, and those below ``$lib``, the ``src/lib`` beside the importer's own ``src``.
    """
    d = requests(files)
    folder = F.regexp_replace("from_path", r"[^/]*$", "")
    lib = F.concat(F.regexp_extract("from_path", r"^(.*?)(?:src/|[^/]*$)", 1), F.lit("src/lib"), F.substring("spec", 5, 1 << 30))
    places = d.select("project", "from_path", "spec").distinct()
    bare = _normal(F.when(F.startswith("spec", F.lit("$lib")), lib).otherwise(F.concat(folder, "spec")))
    options = F.array(*[F.struct(F.lit(k).alias("k"), (F.concat(F.regexp_replace(bare, r"\.js$", ""), F.lit(c)) if c else bare).alias("p")) for k, c in enumerate(CANDIDATES)])
    tried = places.select("*", F.explode(options).alias("o"))
    there = files.select(F.col("project").alias("fp"), F.col("path").alias("to_path"))
    hit = tried.join(there, (F.col("project") == F.col("fp")) & (F.col("o.p") == F.col("to_path")))
    best = hit.groupBy("project", "from_path", "spec").agg(F.min_by("to_path", F.col("o.k")).alias("to_path"))
    return d.join(best, ["project", "from_path", "spec"]).select("project", "from_path", "to_path", "symbol", "exported_as").distinct()


def exports(files: DataFrame) -> DataFrame:
    """project, path, symbol, kind (``value`` or ``type``), one row for each time a file itself exports it.

    Of a component only its module script counts, for other exports are its inputs; the component itself is its default.
    """
    component = F.col("path").endswith(".svelte")
    module = F.array_join(F.regexp_extract_all("code", F.lit(MODULE_SCRIPT), F.lit(1)), "\n")
    code = _code(files, "export").withColumn("code", F.when(component, module).otherwise(F.col("code")))
    found = _matched(code, {"declared": EXPORT, "default": DEFAULT, "list": EXPORT_LIST, "parts": EXPORT_PARTS})
    row = lambda d, symbol, kind: d.select("project", "path", symbol.alias("symbol"), kind.alias("kind"))
    value = F.lit("value")
    kind = lambda is_type: F.when(is_type, "type").otherwise("value")
    listed = _found(found, "list", EXPORT_LIST, "type", "names")
    parts = _found(found, "parts", EXPORT_PARTS, "names").select("project", "path", F.explode(F.split("names", ",")).alias("n"))
    out = [
        row(_found(found, "declared", EXPORT, "word", "symbol"), F.col("symbol"), kind(F.col("word").isin("type", "interface"))), row(_found(found, "default", DEFAULT), F.lit(MAIN), value),
        row(listed.withColumn("n", F.explode(_named(F.col("names")))), F.col("n.alias"), kind(F.col("type") != "")), row(parts, F.regexp_extract("n", r"([\w$]+)\s*$", 1), value),
    ]
    return reduce(DataFrame.unionByName, out).where("symbol != ''")


def entry_files(files: DataFrame) -> DataFrame:
    """project, path of files that something outside the project's modules runs."""
    return files.select("project", "path").where(reduce(Column.__or__, [F.col("path").rlike(p) for p in ENTRIES]))


def used_symbols(edges: DataFrame, exported: DataFrame, entries: DataFrame | None = None) -> DataFrame:
    """project, path, symbol: names of each file that an import reaches, through re-exports of any depth.

    Begins with what imports name, and all names of ``entries`` (project, path); a used name of a re-exporting
    file is used in the file it comes from: under its old name where it is listed, under its own through
    ``export *`` unless the file has that name itself (the default never passes). ``*`` stands for all of a
    file's names, and so passes through everything. Each round joins only the names that the last one
    added and is written out; cycles end when a round adds none.
    """
    seed = edges.where("exported_as is null and symbol != '' and from_path != to_path").select("project", F.col("to_path").alias("path"), "symbol")
    if entries is not None:
        seed = seed.unionByName(entries.select("project", "path", F.lit(ALL).alias("symbol")))
    passes = written(edges.where("exported_as is not null").select("project", F.col("from_path").alias("path"), "to_path", F.col("symbol").alias("old"), "exported_as").distinct())
    listed, starred = passes.where(F.col("exported_as") != ALL), passes.where(F.col("exported_as") == ALL)
    own = exported.select("project", "path", "symbol").unionByName(listed.select("project", "path", F.col("exported_as").alias("symbol"))).distinct()
    seen = new = written(seed.distinct())
    tables = [new]
    while not new.isEmpty():
        named = new.join(listed, ["project", "path"]).where((F.col("symbol") == F.col("exported_as")) | (F.col("symbol") == ALL))
        through = new.where(F.col("symbol") != MAIN).join(own, ["project", "path", "symbol"], "left_anti").join(starred, ["project", "path"])
        ahead = named.select("project", F.col("to_path").alias("path"), F.col("old").alias("symbol")).unionByName(through.select("project", F.col("to_path").alias("path"), "symbol"))
        new = written(ahead.distinct().join(seen, ["project", "path", "symbol"], "left_anti"))
        tables.append(new)
        seen = seen.unionByName(new)
    out = written(seen)
    forget(passes, *tables)
    return out


def unused_files(files: DataFrame, edges: DataFrame, entries: DataFrame | None = None) -> DataFrame:
    """Files that no other file imports or re-exports from; those of ``entries`` (project, path) aside."""
    used = edges.where("from_path != to_path").select("project", F.col("to_path").alias("path"))
    used = used if entries is None else used.unionByName(entries.select("project", "path"))
    return files.select("project", "path").join(used.distinct(), ["project", "path"], "left_anti")


def unreachable_files(files: DataFrame, edges: DataFrame, entries: DataFrame) -> DataFrame:
    """Files that no chain of imports reaches from ``entries`` (project, path).

    Edges that leave a reached file are followed, and each round also joins the edges left to themselves,
    so that they span twice as far as before: a chain of n files takes log n rounds. Rounds are written
    out, so lineage stays short and cycles end; only one table of what was seen is kept.
    """
    hops = edges.select("project", F.col("from_path").alias("path"), "to_path").where("path != to_path").distinct()
    hops = written(hops)
    seen = written(entries.select("project", "path").distinct())
    n, before = seen.count(), -1
    while n > before:
        ahead = seen.join(hops, ["project", "path"]).select("project", F.col("to_path").alias("path"))
        nxt = written(seen.unionByName(ahead).distinct())
        before, n = n, nxt.count()
        forget(seen)
        seen = nxt
        if n > before:
            hops = _longer(hops, seen)
    forget(hops)
    return files.select("project", "path").join(seen, ["project", "path"], "left_anti")


def _longer(hops: DataFrame, seen: DataFrame) -> DataFrame:
    """Hops that don't lead to a seen file, as they are; one hop more for each file, to where its first hop's first hop leads."""
    left = hops.join(seen.withColumnRenamed("path", "to_path"), ["project", "to_path"], "left_anti")
    first = left.groupBy("project", "path").agg(F.min("to_path").alias("to_path"))
    step = first.select("project", F.col("path").alias("to_path"), F.col("to_path").alias("__far"))
    jumps = left.join(step, ["project", "to_path"]).select("project", "path", F.col("__far").alias("to_path")).where("path != to_path")
    out = written(left.select("project", "path", "to_path").unionByName(jumps).distinct())
    forget(hops)
    return out


def unused_exports(exported: DataFrame, used: DataFrame, kind: str = "value") -> DataFrame:
    """Exported names of a kind that are not among ``used`` (used_symbols())."""
    own = exported.where(F.col("kind") == kind).select("project", "path", "symbol").distinct()
    whole = used.where(F.col("symbol") == ALL).select("project", "path")
    return own.join(used, ["project", "path", "symbol"], "left_anti").join(whole, ["project", "path"], "left_anti")


def duplicate_exports(exported: DataFrame) -> DataFrame:
    return exported.groupBy("project", "path", "symbol").agg(F.count("*").alias("n")).where("n > 1")


#: Rule, message and help of dead-code findings; they stand at line 0.
MESSAGES = {"files": "Unused file not imported by any other file in the project", "exports": "Unused export: {}", "types": "Unused type: {}", "duplicates": "Duplicate export: {}"}
HELPS = {
    "files": "Remove it if it's truly unused, or add an import if it was accidentally excluded",
    "exports": "Remove the export or add it to a public API surface if it is intentional",
    "types": "Remove the type export or re-export it from an index file if consumers need it",
    "duplicates": "Consolidate duplicate exports into a single canonical export",
}


def as_findings(rows: DataFrame, kind: str) -> DataFrame:
    """Dead-code rows (project, path, symbol) as findings."""
    before, *after = MESSAGES[kind].split("{}")
    message = F.concat(F.lit(before), F.col("symbol")) if after else F.lit(before)
    return rows.select(
        "project", "path", F.lit(kind).alias("rule"), F.lit("warning").alias("severity"), F.lit("Dead Code").alias("category"),
        message.alias("message"), F.lit(HELPS[kind]).alias("help"), F.lit(0).alias("line"), F.lit(0).alias("col"), F.lit(1.0).alias("weight"),
    )


def dead_code(files: DataFrame) -> DataFrame:
    """Findings of unused files, exports and types and of duplicate exports; entries need no importer. Written in between."""
    edges, exported = written(import_edges(files)), written(exports(files))
    entries = entry_files(files)
    used = used_symbols(edges, exported, entries)
    kinds = {
        "files": unused_files(files, edges, entries), "exports": unused_exports(exported, used), "types": unused_exports(exported, used, "type"),
        "duplicates": duplicate_exports(exported).select("project", "path", "symbol"),
    }
    return reduce(DataFrame.unionByName, [as_findings(d, k) for k, d in kinds.items()])


def flatten_issues(records: DataFrame, kind: str) -> DataFrame:
    """project, path, symbol from nested records: map<workspace, map<file, struct<path, symbol>>>."""
    d = records.select("project", F.explode("records").alias("workspace", "inner"))
    d = d.select("project", "workspace", F.explode("inner").alias("file", "issue"))
    return d.select("project", "workspace", F.col("issue.path").alias("path"), F.col("issue.symbol").alias("symbol"), F.lit(kind).alias("rule"))
