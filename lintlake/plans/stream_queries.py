"""Streaming queries over the events table as a stream of file changes, with the oracle's SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lintlake.operators.rules import ERROR_PAGE
from lintlake.plans import fleet_queries
from lintlake.plans.registry import register
from lintlake.sources.corpus import FILES_SQL, PROFILES_SQL, made_files
from lintlake.sources.shared import shared_dir
from lintlake.sources.tables import table
from lintlake.streaming import live
from lintlake.streaming.scan import LiveScan


def _shape(e: DataFrame) -> DataFrame:
    k = F.get_json_object("props", "$.k").cast("long")
    path = F.concat(F.lit("src/f"), F.col("user_id"), F.when(F.col("event_id") % 5 == 0, ".css").otherwise(".ts"))
    path = F.when(F.col("event_id") % 7 == 1, F.concat(F.lit("node_modules/"), path)).when(F.col("event_id") % 11 == 2, F.concat(F.lit("../"), path)).otherwise(path)
    return e.select(
        F.col("ts").cast("timestamp").alias("ts"), F.col("event_id").cast("long").alias("seq"), F.concat(F.lit("p"), F.col("user_id") % 10).alias("project"), path.alias("path"),
        F.when(F.col("event_type") == "purchase", "delete").otherwise("upsert").alias("op"), (k % 5).cast("int").alias("hits"),
        (k % 5 * 10).alias("plain"), (k % 7 * 15).alias("gated"), (k % 3 == 0).alias("runes"),
    )


def changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events file as a stream."""
    schema = table(spark, sf_dir, "events").schema
    return _shape(spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf_dir))


_E = """with e as (select ts::timestamp as ts, event_id::bigint as seq, 'p' || (user_id % 10) as project,
    case when event_id % 7 = 1 then 'node_modules/' when event_id % 11 = 2 then '../' else '' end || 'src/f' || user_id || case when event_id % 5 = 0 then '.css' else '.ts' end as path,
    case when event_type = 'purchase' then 'delete' else 'upsert' end as op, (json_extract_string(props, '$.k')::bigint % 5)::int as hits, json_extract_string(props, '$.k')::bigint as k from events)"""
_LATEST = "n as (select * from (select *, row_number() over (partition by project, path order by ts desc, seq desc) as r from e) where r = 1)"

register(
    "stream_change_filter", lambda s, d: live.run_once(live.change_filter(changes(s, d)).select("seq", "project", "path", "op")),
    f"{_E} select seq, project, path, op from e where seq % 5 <> 0 and seq % 7 <> 1 and seq % 11 <> 2",
)


def quick(changes: DataFrame) -> DataFrame:
    """The same changes twenty thousand times as fast: hours become tenths of a second."""
    return changes.withColumn("ts", F.timestamp_millis(F.expr("unix_millis(ts) div 20000")))


register(
    "stream_debounce", lambda s, d: live.run_flushed(quick(changes(s, d)), live.debounce).select("project", "path", "seq", "n"),
    f"""{_E}, f as (select *, epoch_ms(ts) // 20000 as ms from e),
    g as (select *, case when ms - lag(ms) over w <= 150 then 0 else 1 end as new from f window w as (partition by project, path order by ms, seq)),
    r as (select *, sum(new) over (partition by project, path order by ms, seq rows between unbounded preceding and current row) as run from g)
    select project, path, last(seq order by ms, seq) as seq, count(*) as n from r group by project, path, run""",
)
register("stream_latest_hits", lambda s, d: live.live_findings(live.run_once(live.latest(changes(s, d)), "complete")), f"{_E}, {_LATEST} select project, path, hits, seq from n where op <> 'delete'")


def content_changes(spark: SparkSession, sf_dir: str, round_: int) -> DataFrame:
    """The documents as a stream of files: all of them, a third with a line too many (0); those corrected (1); some deleted (2).

    Manifests come with the first round; with the last one some projects lose their framework.
    """
    schema = table(spark, sf_dir, "documents").schema
    docs = spark.readStream.schema(schema).option("pathGlobFilter", "documents.parquet").parquet(sf_dir)
    page = F.col("path").endswith("/+error.svelte")
    d = made_files(docs).withColumn("own", ~page)
    k = F.regexp_extract("project", r"(\d+)$", 1).cast("int")
    third, gone = F.col("own") & (F.col("doc_id") % 3 == 0), F.col("own") & (F.col("doc_id") % 9 == 4)
    keep = (F.lit(True), third, gone)[round_]
    op = F.lit("delete" if round_ == 2 else "upsert")
    content = F.when(third, F.concat(F.lit("eval(1);\n"), "content")).otherwise(F.col("content")) if round_ == 0 else F.col("content")
    file = F.when(keep, F.struct("path", op.alias("op"), content.alias("content")))
    top = F.when(page & F.lit(round_ == 0), F.struct(F.lit(ERROR_PAGE).alias("path"), op.alias("op"), F.col("content")))  # of the smallest id: the latest
    version = F.lit(',"svelte":"^5.1.0"') if round_ == 0 else F.lit("")
    manifest = F.concat(F.lit('{"name":"'), "project", F.lit('","dependencies":{"@sveltejs/kit":"^2.0.0"'), F.when(k != 19, version).otherwise(F.lit("")), F.lit("}}"))
    told = F.lit(True) if round_ == 0 else (k % 6 == 1) & F.lit(round_ == 2)
    root = F.when(told, F.struct(F.lit("package.json").alias("path"), F.lit("upsert").alias("op"), manifest.alias("content")))
    d = d.select("project", F.lit(0).cast("long").alias("seq"), F.timestamp_seconds(F.lit((round_ + 1) * 10**9) - F.col("doc_id")).alias("ts"), F.explode(F.array_compact(F.array(file, top, root))).alias("f"))
    return d.select("project", "seq", "ts", "f.*")


def live_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    scan = LiveScan(spark, f"{shared_dir(spark)}/scan-{uuid.uuid4().hex}")
    for round_ in range(3):
        scan.run(content_changes(spark, sf_dir, round_))
    return scan.findings().select("project", "path", "rule", "severity", "category", "line", "col", "message")


_LEFT = FILES_SQL.replace("where path is not null and project is not null", "where path is not null and project is not null and (doc_id % 9 <> 4 or ends_with(path, '/+error.svelte'))")
_LIVE = fleet_queries._DIAGNOSED.replace("<> '19'", "not in ('19') and regexp_extract(project, '([0-9]+)$', 1)::int % 6 <> 1")
register(
    "stream_live_findings", live_findings,
    f"{fleet_queries.FINDINGS_SQL.replace(FILES_SQL, _LEFT).replace(PROFILES_SQL, _LIVE)} select project, path, rule, severity, category, line, col, message from findings",
)


def snapshot_plus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A first scan from the customers' numbers, then the stream."""
    c = table(spark, sf_dir, "customer")
    first = c.select(F.concat(F.lit("p"), F.col("c_custkey") % 10).alias("project"), F.concat(F.lit("src/f"), "c_custkey", F.lit(".ts")).alias("path"), (F.col("c_custkey") % 4).cast("int").alias("hits"))
    return live.with_snapshot(live.run_once(live.latest(changes(spark, sf_dir)), "complete"), first)


register(
    "stream_snapshot_plus", snapshot_plus,
    f"""{_E}, {_LATEST}, s as (select 'p' || (c_custkey % 10) as project, 'src/f' || c_custkey || '.ts' as path, (c_custkey % 4)::int as first from customer)
    select project, path, coalesce(hits, first)::int as hits, coalesce(seq, -1)::bigint as seq from s full join n using (project, path) where op is null or op <> 'delete'""",
)

_TOTALS = """{0},
  q as (select *, case when op = 'gate_off' then 1 else 0 end as off from e1),
  s as (select *, sum(off) over (partition by project order by ts, seq rows between unbounded preceding and current row) as seg,
    case when op = 'upsert' then plain else 0 end as a, case when op = 'upsert' then gated else 0 end as b, case when op = 'upsert' and runes then 1 else 0 end as c from q),
  d as (select *, case when off = 1 then 0 else a - lag(a, 1, 0) over w end as da, case when off = 1 then 0 else b - lag(b, 1, 0) over w end as db, case when off = 1 then 0 else c - lag(c, 1, 0) over w end as dc
    from s window w as (partition by project, seg, path, off order by ts, seq)),
  t as (select *, sum(da) over v as ta, sum(db) over v as tb, sum(dc) over v as tc from d window v as (partition by project, seg order by ts, seq rows between unbounded preceding and current row)),
  u as (select project, seq, ts, (ta + case when tc > 0 then tb else 0 end)::bigint as penalty, tc > 0 as runes from t),
  x as (select *, least(100, greatest(0, floor(100.0 * exp(-penalty::double / 800.0) + 0.5)))::int as score from u),
  y as (select *, (score - lag(score, 1, 100) over (partition by project order by ts, seq))::int as delta from x)
  select project, seq, penalty, score, delta, case when delta > 0 then 'improved' when delta < 0 then 'worse' else 'no change' end as status, runes from y"""

_FIRST = """, snap as (select 'p' || (c_custkey % 10) as project, 'src/f' || c_custkey || '.ts' as path, (c_custkey % 4 * 10)::bigint as plain, (c_custkey % 3 * 15)::bigint as gated, c_custkey % 997 = 1 as runes from customer)"""
_E1 = f"{_E}, e1 as (select *, k % 5 * 10 as plain, k % 7 * 15 as gated, k % 3 = 0 as runes from e)"


def snapshot_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Totals on top of a first scan, which is joined to the stream for its files' first values."""
    key = F.col("c_custkey")
    c = table(spark, sf_dir, "customer")
    first = c.select(F.concat(F.lit("p"), key % 10).alias("project"), F.concat(F.lit("src/f"), "c_custkey", F.lit(".ts")).alias("path"), (key % 4 * 10).cast("long").alias("plain"), (key % 3 * 15).cast("long").alias("gated"), (key % 997 == 1).alias("runes"))
    return live.live_totals(changes(spark, sf_dir), first)


register(
    "stream_live_score", lambda s, d: live.live_totals(changes(s, d).withColumn("gated", F.lit(0).cast("long"))),
    _TOTALS.format(f"{_E}, e1 as (select *, k % 5 * 10 as plain, 0 as gated, k % 3 = 0 as runes from e)"),
)
register("stream_runes_flip", lambda s, d: live.live_totals(changes(s, d)), _TOTALS.format(_E1))
register(
    "stream_config_gate", lambda s, d: live.live_totals(changes(s, d).withColumn("op", F.when(F.col("seq") % 50 == 0, "gate_off").otherwise(F.col("op")))),
    _TOTALS.format(f"{_E}, e1 as (select * replace (case when seq % 50 = 0 then 'gate_off' else op end as op), k % 5 * 10 as plain, k % 7 * 15 as gated, k % 3 = 0 as runes from e)"),
)
# the first scan's files as changes before all others, whose own rows are left out
_BASE = "e1 as (select ts, seq, project, path, op, plain, gated, runes from e0 union all select timestamp '1970-01-01', -1, project, path, 'upsert', plain, gated, runes from snap)"
register(
    "stream_snapshot_score", snapshot_score,
    f"""select project, seq, penalty, score, (score - before)::int as delta, case when score > before then 'improved' when score < before then 'worse' else 'no change' end as status, runes
    from (select *, lag(score, 1, 100) over (partition by project order by ts, seq, penalty) as before from (
      {_TOTALS.replace("select project, seq, penalty, score, delta", "select project, ts, seq, penalty, score, delta").replace("rows between unbounded preceding and current row) as ta", "range between unbounded preceding and current row) as ta").replace("rows between unbounded preceding and current row) as tb", "range between unbounded preceding and current row) as tb").replace("rows between unbounded preceding and current row) as tc", "range between unbounded preceding and current row) as tc").format(_E1.replace("e1 as", "e0 as") + _FIRST + ", " + _BASE)})) where seq >= 0""",
)
