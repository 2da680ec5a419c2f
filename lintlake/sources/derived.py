"""Manifests, configs, histories, import graphs and agent logs made from the driver's tables, row by row."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lintlake.sources.tables import table

#: Packages of the derived manifests.
PACKAGES = (
    "svelte", "@sveltejs/kit", "vite", "@sveltejs/vite-plugin-svelte", "lodash", "clsx", "svelte-routing", "sapper", "svelte-preprocess", "svelte-check", "svelte-hmr",
    "smelte", "svelte-material-ui", "@smui/button", "axios", "moment", "uuid", "classnames", "node-fetch", "typescript",
)


def manifest_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """package.json of one project per customer; every 50th is cut short."""
    c = table(spark, sf_dir, "customer").select("c_custkey")
    key = F.col("c_custkey")

    def part(which: int):
        def entry(pid: int, name: str):
            version = F.when((key + pid) % 9 == 0, "*").when((key + pid) % 9 == 1, "latest").otherwise("^1.2.3" if which < 2 else "~2.0.0")
            here = ((key + pid) % 3 == which) | (F.lit(pid == 4) & F.lit(which == 2))
            return F.when(((key * 5 + pid * 3) % 7 < 3) & here, F.struct(F.lit(name).alias("k"), version.alias("v")))

        return F.map_from_entries(F.array_compact(F.array(*[entry(pid, n) for pid, n in enumerate(PACKAGES)])))

    document = F.to_json(F.struct(F.concat(F.lit("app"), key).alias("name"), part(0).alias("dependencies"), part(1).alias("devDependencies"), part(2).alias("peerDependencies")))
    content = F.when(key % 50 == 0, F.substring(document, 1, 20)).otherwise(document)
    return c.select(F.concat(F.lit("cust"), key).alias("project"), F.lit("package.json").alias("path"), content.alias("content"))


_PKG = ", ".join(f"({i}, '{n}')" for i, n in enumerate(PACKAGES))
MANIFESTS_SQL = f"""
pkg(pid, name) as (values {_PKG}),
entries as (
  select 'cust' || c_custkey as project, c_custkey as k, pid, name, w.which,
    case when (c_custkey + pid) % 9 = 0 then '*' when (c_custkey + pid) % 9 = 1 then 'latest' when w.which < 2 then '^1.2.3' else '~2.0.0' end as version
  from customer, pkg, (values (0), (1), (2)) w(which)
  where c_custkey % 50 <> 0 and (c_custkey * 5 + pid * 3) % 7 < 3 and ((c_custkey + pid) % 3 = w.which or (pid = 4 and w.which = 2))),
deps as (select project, name, arg_max(version, which) as version from entries group by project, name),
manifests as (select 'cust' || c_custkey as project from customer where c_custkey % 50 <> 0)"""


def config_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(project, priority, config) per customer: dedicated files, some broken, and manifest keys."""
    key = F.col("c_custkey")
    c = table(spark, sf_dir, "customer").select("c_custkey", F.concat(F.lit("cust"), key).alias("project"))
    good = '{"lint": false, "deadCode": true, "ignore": {"rules": ["no-moment", 3, "no-eval"], "files": ["src/lib/*", "", "gen"]}}'
    odd = '{"lint": "yes", "ignore": {"rules": "all", "files": ["**/x.ts"]}}'
    own = c.where("c_custkey % 4 in (0, 1, 2)").select("project", F.lit(1).alias("priority"), F.when(key % 4 == 0, good).when(key % 4 == 1, odd).otherwise('{"lint": tru').alias("config"))
    keyed = c.where("c_custkey % 3 = 0").select("project", F.lit(2).alias("priority"), F.lit('{"lint": true, "ignore": {"rules": ["no-console"]}}').alias("config"))
    return own.unionByName(keyed)


def history_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Score histories: a project per user, a run per event."""
    e = table(spark, sf_dir, "events")
    score = F.floor(F.lit(100.0) * F.exp(-F.col("value") / 80.0) + 0.5).cast("int")
    from lintlake.operators.report import label_of

    return e.select(
        F.col("user_id").cast("string").alias("project"), F.col("event_id").cast("long").alias("seq"), F.col("ts").cast("timestamp").alias("ts"),
        F.least(F.lit(100), F.greatest(F.lit(0), score)).alias("score"), (F.col("event_id") % 7).cast("int").alias("warnings"),
    ).withColumn("label", label_of(F.col("score")))


HISTORY_SQL = """
history as (select *, case when score >= 90 then 'Excellent' when score >= 75 then 'Good' when score >= 50 then 'Needs Work' when score >= 25 then 'Poor' else 'Critical' end as label
  from (select user_id::varchar as project, event_id::bigint as seq, ts::timestamp as ts, least(100, greatest(0, floor(100.0 * exp(-value / 80.0) + 0.5)))::int as score, (event_id % 7)::int as warnings from events))"""


def history_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same as JSON entries, every 11th with a text as score, every 13th without a label."""
    h = history_rows(spark, sf_dir)
    score = F.when(F.col("seq") % 11 == 0, F.concat(F.lit('"'), "score", F.lit('"'))).otherwise(F.col("score").cast("string"))
    label = F.when(F.col("seq") % 13 == 0, F.lit("")).otherwise(F.concat(F.lit('"label":"'), "label", F.lit('",')))
    stamp = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")
    entry = F.concat(F.lit('{"timestamp":"'), stamp, F.lit('","score":'), score, F.lit(","), label, F.lit('"errors":1,"warnings":'), "warnings", F.lit(',"filesScanned":9,"filesAffected":2}'))
    return h.select("project", "seq", entry.alias("entry"))


def import_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One module per document, with its text, that asks for names of others by arithmetic on its id.

    The first request has one of eight forms, the second names what the other module has, hands on or passes with all of a third's.
    """
    d = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("i"), F.coalesce("text", F.lit("")).alias("text"))
    n = table(spark, sf_dir, "documents").agg(F.count("*").alias("n"))
    d = d.crossJoin(F.broadcast(n))  # one row: the number of documents
    i, one, two = F.col("i"), (F.col("i") * 7 + 3) % F.col("n"), (F.col("i") * 5 + 1) % F.col("n")
    made = lambda form, **at: F.concat(*[at[x] if x in at else F.lit(x) for x in form])
    forms = (
        ("import { s", "T", ", type T", "T", " } from './m", "T", "';"), ("import d", "I", " from './m", "T", "';"), ("import * as n", "I", " from './m", "T", ".js';"), ("import './m", "T", ".ts';"),
        ("const later = await import('./m", "T", "');"), ("export { s", "T", " as r", "I", " } from './m", "T", "';"), ("export * from './m", "T", "';"), ("export * as z", "I", " from './m", "T", "';"),
    )
    first = F.coalesce(*[F.when(i % 8 == k, made(form, I=i, T=one)) for k, form in enumerate(forms)])
    asked = F.when(two % 8 == 5, F.concat(F.lit("r"), two)).when(two % 8 == 6, F.concat(F.lit("s"), (two * 7 + 3) % F.col("n"))).when(two % 8 == 7, F.concat(F.lit("z"), two)).otherwise(F.concat(F.lit("s"), two))
    lines = F.array(
        F.when(one % 13 != 0, first), F.when((i % 4 == 0) & (two % 13 != 0), F.concat(F.lit("import { "), asked, F.lit(" as b } from '$lib/../m"), two, F.lit("';"))),
        F.lit("// import { s0 } from './m0';"), F.concat(F.lit("export const s"), "i", F.lit(" = 1;")), F.concat(F.lit("export type T"), "i", F.lit(" = number;")),
        F.concat(F.lit("export default s"), "i", F.lit(";")), F.when(i % 17 == 0, F.concat(F.lit("export { s"), "i", F.lit(" };"))), F.concat(F.lit("const notes = `"), "text", F.lit("`;")),
    )
    return d.select(F.lit("graph").alias("project"), F.concat(F.lit("src/m"), "i", F.lit(".ts")).alias("path"), F.array_join(F.array_compact(lines), "\n").alias("content"))


#: The same graph in the oracle: hops, edges, the names that imports reach (used; needs ``with recursive``) and files.
IMPORTS_SQL = """
docs as (select doc_id as i, (select count(*) from documents) as n from documents),
hops as (select i, (i * 7 + 3) % n as t, i % 8 as form from docs where ((i * 7 + 3) % n) % 13 <> 0),
asks as (select i, t, symbol, null as handed from hops, (values (0, 's'), (0, 'T')) v(form, letter), lateral (select letter || t as symbol) where hops.form = v.form
  union all select i, t, case form when 1 then 'default' when 3 then '' when 5 then 's' || t else '*' end, case form when 5 then 'r' || i when 6 then '*' when 7 then 'z' || i end from hops where form > 0
  union all select i, t, case t % 8 when 5 then 'r' || t when 6 then 's' || (t * 7 + 3) % n when 7 then 'z' || t else 's' || t end, null from (select i, n, (i * 5 + 1) % n as t from docs where i % 4 = 0) where t % 13 <> 0),
edges as (select distinct 'graph' as project, 'src/m' || i || '.ts' as from_path, 'src/m' || t || '.ts' as to_path, symbol, handed as exported_as, i, t from asks),
used as (select t, symbol from edges where exported_as is null and symbol <> '' and i <> t
  union select e.t, case when e.exported_as = '*' then u.symbol else e.symbol end from used u join edges e on e.i = u.t
    where (e.exported_as <> '*' and u.symbol in (e.exported_as, '*')) or (e.exported_as = '*' and u.symbol not in ('default', 's' || u.t, 'T' || u.t))),
fs as (select 'graph' as project, 'src/m' || i || '.ts' as path, i from docs)"""


def agent_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Session logs from conversations; every tenth line is cut short."""
    c = table(spark, sf_dir, "conversations")
    text = F.coalesce("text", F.lit(""))
    init = F.lit('{"type":"system","subtype":"init"}')
    named = F.concat(F.lit('{"type":"tool_use","subtype":"started","tool_call":{"name":"grep","args":{"path":"src/lib/c'), "conv_id", F.lit('.ts"}}}'))
    read = F.concat(F.lit('{"type":"tool_call","subtype":"started","tool_call":{"readToolCall":{"args":{"path":"a/b/r'), "turn", F.lit('.ts"}}}}'))
    said = F.to_json(F.struct(F.lit("assistant").alias("type"), F.struct(F.array(F.struct(F.lit("text").alias("type"), text.alias("text"))).alias("content")).alias("message")))
    line = F.when(F.col("role") == "system", init).when(F.col("role") == "assistant", said).when(F.col("turn") % 2 == 0, named).otherwise(read)
    cut = (F.col("conv_id") * 3 + F.col("turn")) % 10 == 0
    return c.select(F.col("conv_id").cast("string").alias("session"), F.col("turn").cast("long").alias("seq"), F.when(cut, F.expr("substring({0}, 1, 12)".format("'{\"type\":\"assist'"))).otherwise(line).alias("line"))
