"""Projects: manifests, configs and profiles from their files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lintlake.functions.text import matches

#: What makes a component use runes, and the build's config files.
RUNES = r"\$state\s*[<(]|\$derived\s*[<(]|\$effect\s*[.(]|\$props\s*[<(]"
BUILD_CONFIGS = ("svelte.config.js", "svelte.config.ts", "svelte.config.mjs", "svelte.config.cjs")
CONFIG_FILE, CONFIG_KEY = "lintlake.config.json", "lintlake"


def source_counts(files: DataFrame) -> DataFrame:
    return files.where(F.col("path").rlike(r"\.(svelte|ts|js)$")).groupBy("project").agg(F.count("*").alias("n"))


def _strings(v: Column, name: str) -> Column:
    """An object's string values; other values are left out, as is everything if it is no object."""
    field = F.try_variant_get(v, f"$.{name}", "variant")
    entries = F.coalesce(F.try_variant_get(v, f"$.{name}", "map<string,variant>"), F.create_map().cast("map<string,variant>"))
    kept = F.map_filter(entries, lambda k, x: F.schema_of_variant(x) == "STRING")
    return F.when(field.isNull(), F.create_map().cast("map<string,string>")).otherwise(F.transform_values(kept, lambda k, x: F.try_variant_get(x, "$", "string")))


def read_manifests(files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(manifests, quarantine): package.json at each project's root, and those that are no JSON object.

    manifests: project, name, dependencies, dev_dependencies, peer_dependencies (string maps), config (JSON of our key).
    """
    v = F.try_parse_json("content")
    d = files.where("path = 'package.json'").withColumn("v", v)
    good = F.col("v").isNotNull() & F.schema_of_variant("v").startswith("OBJECT")
    out = d.where(good).select(
        "project", F.try_variant_get("v", "$.name", "string").alias("name"), _strings(F.col("v"), "dependencies").alias("dependencies"),
        _strings(F.col("v"), "devDependencies").alias("dev_dependencies"), _strings(F.col("v"), "peerDependencies").alias("peer_dependencies"),
        F.to_json(F.try_variant_get("v", f"$.{CONFIG_KEY}", "variant")).alias("config"),
    )
    return out, d.where(~F.coalesce(good, F.lit(False))).select("project", "path", "content")


def _list(v: Column, name: str) -> Column:
    items = F.coalesce(F.try_variant_get(v, f"$.ignore.{name}", "array<variant>"), F.array().cast("array<variant>"))
    texts = F.filter(items, lambda x: F.schema_of_variant(x) == "STRING")
    return F.transform(texts, lambda x: F.try_variant_get(x, "$", "string"))


def _flag(v: Column, name: str) -> Column:
    field = F.try_variant_get(v, f"$.{name}", "variant")
    return F.when(F.schema_of_variant(field) == "BOOLEAN", F.try_variant_get(v, f"$.{name}", "boolean"))


def resolve_configs(sources: DataFrame) -> DataFrame:
    """project, lint, dead_code, ignore_rules, ignore_files from (project, priority, config JSON text).

    The source of the smallest priority alone counts: if it can't be read, the project has no config.
    A key of a wrong type is dropped; the rest of its config stays.
    """
    first = sources.withColumn("k", F.row_number().over(Window.partitionBy("project").orderBy("priority"))).where("k = 1")
    d = first.withColumn("v", F.try_parse_json("config"))
    d = d.where(F.col("v").isNotNull() & F.schema_of_variant("v").startswith("OBJECT"))
    files = F.filter(_list(F.col("v"), "files"), lambda x: x != "")
    return d.select("project", _flag(F.col("v"), "lint").alias("lint"), _flag(F.col("v"), "deadCode").alias("dead_code"), _list(F.col("v"), "rules").alias("ignore_rules"), files.alias("ignore_files"))


def config_sources(files: DataFrame, manifests: DataFrame) -> DataFrame:
    own = files.where(F.col("path") == CONFIG_FILE).select("project", F.lit(1).alias("priority"), F.col("content").alias("config"))
    return own.unionByName(manifests.where("config is not null").select("project", F.lit(2).alias("priority"), "config"))


def phase(option: bool | None, configured: Column) -> Column:
    """Whether a phase runs: the caller's option, else the project's config, else yes."""
    return F.coalesce(F.lit(option), configured, F.lit(True))


def profiles(files: DataFrame, manifests: DataFrame) -> DataFrame:
    """One row per project with a manifest: name, framework, framework_version, has_typescript, has_preprocess, uses_runes, source_files."""
    path, content = F.col("path"), F.col("content")
    per = files.groupBy("project").agg(
        F.bool_or(path == "tsconfig.json").alias("has_typescript"),
        F.bool_or(path.isin(*BUILD_CONFIGS) & F.contains(content, F.lit("preprocess"))).alias("has_preprocess"),
        F.bool_or(path.endswith(".svelte") & matches(content, RUNES)).alias("uses_runes"),
        F.count_if(path.rlike(r"\.(svelte|ts|js)$")).alias("source_files"),
    )
    run, dev, peer = F.col("dependencies"), F.col("dev_dependencies"), F.col("peer_dependencies")
    has = lambda name: F.coalesce(F.try_element_at(dev, F.lit(name)), F.try_element_at(run, F.lit(name)), F.lit("")) != ""
    framework = F.when(has("@sveltejs/kit"), "sveltekit").when(has("vite") & has("@sveltejs/vite-plugin-svelte"), "vite").when(has("svelte"), "vanilla").otherwise("unknown")
    version = F.coalesce(*[F.try_element_at(m, F.lit("svelte")) for m in (peer, dev, run)])
    no = lambda c: F.coalesce(c, F.lit(False)).alias(c)
    return manifests.join(per, "project", "left").select(
        "project", F.coalesce("name", "project").alias("name"), framework.alias("framework"),
        F.when(version != "", F.regexp_replace(version, r"^[^0-9]*", "")).alias("framework_version"), no("has_typescript"), no("has_preprocess"), no("uses_runes"),
        F.coalesce("source_files", F.lit(0)).alias("source_files"),
    )
