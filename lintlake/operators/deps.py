"""Dependency audit over manifests."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Packages and what to do about them.
DEPRECATED = {
    "svelte-routing": "Use SvelteKit's built-in routing or @sveltejs/kit",
    "svelte-spa-router": "Use SvelteKit's built-in routing",
    "svelte-navigator": "Use SvelteKit's built-in routing",
    "sapper": "Sapper is deprecated so migrate to SvelteKit",
    "svelte-preprocess": "Svelte 5 has built-in TypeScript support; use vitePreprocess from @sveltejs/vite-plugin-svelte",
    "@rollup/plugin-svelte": "Use @sveltejs/vite-plugin-svelte with Vite instead of Rollup",
    "rollup-plugin-svelte": "Use @sveltejs/vite-plugin-svelte with Vite instead of Rollup",
    "svelte-loader": "Use @sveltejs/vite-plugin-svelte with Vite instead of Webpack",
    "svelte-check": "Still maintained, but ensure version ≥4.0 for Svelte 5 compatibility",
    "svelte-hmr": "HMR is now built into @sveltejs/vite-plugin-svelte",
}
INCOMPATIBLE = {
    "svelte-forms-lib": "Not updated for Svelte 5 runes so use superforms or custom solution",
    "svelte-simple-modal": "Uses legacy slot API so find a Svelte 5 compatible modal or build one",
    "svelte-materialify": "Abandoned so use Skeleton UI or shadcn-svelte",
    "smelte": "Abandoned so use Skeleton UI or shadcn-svelte",
    "svelte-material-ui": "Check for Svelte 5 compatible version",
    "svelte-headlessui": "Check for Svelte 5 compatible version",
    "carbon-components-svelte": "Check for Svelte 5 compatible version",
    "@smui/button": "Check SMUI for Svelte 5 compatible version",
}
ALTERNATIVES = {
    "axios": "Use native fetch() since it is built into all modern runtimes",
    "node-fetch": "Use native fetch() since it is built into Node 18+ and Bun",
    "moment": "Use date-fns or dayjs since moment is 300kb+ and deprecated",
    "classnames": "Use clsx since it is smaller and faster",
    "uuid": "Use crypto.randomUUID() since it is built into all modern runtimes",
}
RISKY, PIN = ("*", "latest"), "Pin to a specific semver range"
TABLES = {"deprecated": DEPRECATED, "incompatible": INCOMPATIBLE, "better-alternative": ALTERNATIVES}


def flatten(manifests: DataFrame, outer: bool = False) -> DataFrame:
    """project, name, version: peer over dev over regular dependencies, merged inside the row. outer: projects without any have a row of nulls."""
    later = lambda a, b: F.map_zip_with(a, b, lambda k, x, y: F.coalesce(y, x))
    merged = later(later(F.col("dependencies"), F.col("dev_dependencies")), F.col("peer_dependencies"))
    return manifests.select("project", (F.explode_outer if outer else F.explode)(merged).alias("name", "version"))


def listed(deps: DataFrame, kind: str) -> DataFrame:
    """Dependencies that one advisory table lists; the table has a fixed, small size and is broadcast."""
    rows = list(TABLES[kind].items())
    advisories = deps.sparkSession.createDataFrame(rows, "name string, message string")
    return deps.join(F.broadcast(advisories), "name").select("project", "name", "version", F.lit(kind).alias("type"), "message")


def risky(deps: DataFrame) -> DataFrame:
    return deps.where(F.col("version").isin(*RISKY)).select("project", "name", "version", F.lit("risky-version").alias("type"), F.lit(PIN).alias("message"))


def _issues(deps: DataFrame) -> DataFrame:
    """``deps`` with issues: an array of (type, message) of all four checks. One join, with all advisories by name."""
    rows: dict[str, list[tuple[str, str]]] = {}
    for kind, listed_ in TABLES.items():
        for name, message in listed_.items():
            rows.setdefault(name, []).append((kind, message))
    advisories = deps.sparkSession.createDataFrame(list(rows.items()), "__name string, __listed array<struct<type:string,message:string>>")
    risk = F.when(F.col("version").isin(*RISKY), F.array(F.struct(F.lit("risky-version").alias("type"), F.lit(PIN).alias("message"))))
    none = F.array().cast("array<struct<type:string,message:string>>")
    d = deps.join(F.broadcast(advisories), F.col("name") == F.col("__name"), "left")
    return d.withColumn("issues", F.concat(F.coalesce("__listed", none), F.coalesce(risk, none))).drop("__name", "__listed")


def audit(deps: DataFrame) -> DataFrame:
    """Issues of all four checks; a package can be in several."""
    return _issues(deps).select("project", "name", "version", F.inline("issues"))


def status(manifests: DataFrame) -> DataFrame:
    """Per project: total dependencies, issues by type and a status. The manifests are read once."""
    d = _issues(flatten(manifests, outer=True))
    n = lambda kind: F.coalesce(F.sum(F.size(F.filter("issues", lambda x: x["type"] == kind))), F.lit(0))
    d = d.groupBy("project").agg(
        F.count("name").alias("total"), n("deprecated").alias("deprecated"), n("incompatible").alias("incompatible"), n("risky-version").alias("risky"),
        n("better-alternative").alias("replaceable"), F.coalesce(F.sum(F.size("issues")), F.lit(0)).alias("issues"),
    )
    label = F.when(F.col("issues") == 0, "Healthy").when(F.col("issues") <= 3, "Needs Attention").otherwise("Unhealthy")
    return d.withColumn("status", label)
