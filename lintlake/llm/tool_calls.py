"""Operator 3, chat formatting: linking tool calls with their results. DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import common

#: Argument schemas by tool: (field, type, required). Other fields are errors.
SCHEMAS = {
    "lookup": (("limit", "BIGINT", False), ("query", "STRING", True)),
    "search": (("limit", "BIGINT", True), ("query", "STRING", True)),
    "summarize": (("limit", "BIGINT", False), ("query", "STRING", False)),
}


Schemas = dict[str, tuple[tuple[str, str, bool], ...]]


def errors_of(name: Column, arguments: Column, schemas: Schemas = SCHEMAS) -> Column:
    """What is wrong with ``arguments`` (JSON text) for tool ``name`` of ``schemas``: an array of messages, in fixed order.

    ``malformed``, ``not an object``, ``unknown tool``, or for each field in order ``missing f``,
    ``f is not T``, and ``unknown f`` for fields that the schema lacks. A null field counts as missing.
    """
    v = F.try_parse_json(arguments)
    keys = F.coalesce(F.array_sort(F.json_object_keys(arguments)), F.array().cast("array<string>"))
    found = F.array(F.lit("unknown tool"))
    for tool, fields in schemas.items():
        checks = []
        for f, kind, required in fields:
            what = F.schema_of_variant(F.try_variant_get(v, f"$.{f}", "variant"))
            absent = what.isNull() | what.isin("VOID", "NULL")
            checks.append(F.when(absent, F.lit(f"missing {f}") if required else F.lit(None)).when(what != kind, F.lit(f"{f} is not {kind.lower()}")))
        extra = F.transform(F.array_except(keys, F.array(*[F.lit(f) for f, _, _ in fields])), lambda k: F.concat(F.lit("unknown "), k))
        found = F.when(name == tool, F.concat(F.array_compact(F.array(*checks)), extra)).otherwise(found)
    kind = F.schema_of_variant(v)
    return F.when(v.isNull(), F.array(F.lit("malformed"))).when(~kind.startswith("OBJECT"), F.array(F.lit("not an object"))).otherwise(found)


def depths(calls: DataFrame) -> DataFrame:
    """``calls`` (conv, call_id, after) with depth: how many calls stand before it in its chain of ``after``.

    Pointer jumping: each round every call skips to its pointer's pointer, so a chain of length n takes
    log n joins and no conversation is gathered. Calls that wait for each other in a circle have null.
    """
    known = calls.select(F.col("conv").alias("kc"), F.col("call_id").alias("kid"))
    now = calls.join(known, (F.col("conv") == F.col("kc")) & (F.col("after") == F.col("kid")), "left")
    now = common.cut(now.select("conv", "call_id", F.col("kid").alias("ptr"), F.when(F.col("kid").isNotNull(), 1).otherwise(0).cast("long").alias("depth")))
    left, old = now.where("ptr is not null").count(), []
    while left:
        to = now.select(F.col("conv").alias("tc"), F.col("call_id").alias("tid"), F.col("ptr").alias("next"), F.col("depth").alias("more"))
        step = now.join(to, (F.col("conv") == F.col("tc")) & (F.col("ptr") == F.col("tid")), "left")
        nxt = common.cut(step.select("conv", "call_id", F.when(F.col("ptr").isNotNull(), F.col("next")).alias("ptr"), (F.col("depth") + F.coalesce("more", F.lit(0))).alias("depth")))
        common.forget(*old)
        old, now = [now], nxt
        still = now.where("ptr is not null").count()
        if still == left:
            break
        left = still
    return now.select("conv", "call_id", F.when(F.col("ptr").isNull(), F.col("depth")).alias("depth"))


def _keyed(d: DataFrame) -> DataFrame:
    """``d``, written, with keys for conv and call_id: the value after a letter, or for a null a key that no other row has."""
    alone = F.concat(F.lit("?"), F.monotonically_increasing_id().cast("string"), F.lit("." + d.columns[-1]))
    key = lambda c: F.coalesce(F.concat(F.lit("="), c), alone)
    keyed = d.withColumn("conv", key("conv")).withColumn("call_id", key("call_id"))
    return common.cut(keyed.withColumn("after", F.concat(F.lit("="), "after")) if "after" in d.columns else keyed)


def _value(key: Column) -> Column:
    return F.when(key.startswith("="), F.substring(key, 2, 1 << 30))


def link(calls: DataFrame, results: DataFrame, schemas: Schemas = SCHEMAS) -> DataFrame:
    """One row per call, and per result without a call: status, depth, position, errors, canonical JSON.

    ``schemas``: the caller's tools, each with its fields (name, variant type, required).
    ``calls``: conv string, turn long, call_id, name, arguments (JSON text), after (call_id or null).
    ``results``: conv, turn, call_id, content. Of repeated calls or results of one conv and call_id the
    one of the earliest turn counts (then the smallest). status: ``linked``, ``pending`` (no result) or
    ``orphan`` (no call; its depth is 0). position (from 0): the conversation in topological order, by
    depth, turn and id; calls in a circle come last and have status ``circular``. ``after`` of unknown
    ids adds the error ``unknown after``. canonical: keys in order, no white space, numbers in shortest
    form; malformed arguments stay a string. A row without a conv is a conversation of its own, a call or
    result without a call_id links with none; each of them is kept, repeated ones too. Other columns are
    not read; empty tables give an empty result.
    """
    c = _keyed(calls.select("conv", "turn", "call_id", "name", "arguments", "after")).groupBy("conv", "call_id").agg(F.min(F.struct("turn", "name", "arguments", "after")).alias("c"))
    c = common.cut(c.select("conv", "call_id", "c.*"))
    r = _keyed(results.select("conv", "turn", "call_id", "content")).groupBy("conv", "call_id").agg(F.min(F.struct("turn", "content")).alias("r"))
    r = r.select(F.col("conv").alias("rconv"), F.col("call_id").alias("rid"), F.col("r.turn").alias("rturn"), "r.content", F.lit(True).alias("has"))
    known = c.select(F.col("conv").alias("kc"), F.col("call_id").alias("kid"))
    d = depths(c.select("conv", "call_id", "after")).select(F.col("conv").alias("dc"), F.col("call_id").alias("did"), "depth")
    c = c.join(d, (F.col("conv") == F.col("dc")) & (F.col("call_id") == F.col("did")))
    c = c.join(known, (F.col("conv") == F.col("kc")) & (F.col("after") == F.col("kid")), "left")
    dangling = F.when(F.col("after").isNotNull() & F.col("kid").isNull(), F.array(F.lit("unknown after"))).otherwise(F.array().cast("array<string>"))
    errors = F.concat(errors_of(F.coalesce("name", F.lit("")), F.coalesce("arguments", F.lit("")), schemas), dangling)
    c = c.select("conv", "call_id", "turn", "name", "arguments", "after", "depth", errors.alias("errors"), F.lit(True).alias("call"))
    j = c.join(r, (F.col("conv") == F.col("rconv")) & (F.col("call_id") == F.col("rid")), "full_outer")
    status = F.when(F.col("call").isNull(), "orphan").when(F.col("depth").isNull(), "circular").when(F.col("has").isNull(), "pending").otherwise("linked")
    given = F.coalesce("arguments", F.lit(""))
    quoted = F.regexp_extract(F.to_json(F.struct(given.alias("x"))), r"(?s)^.{5}(.*)\}\z", 1)
    parsed = F.coalesce(F.to_json(F.try_parse_json("arguments")), quoted)
    rest = F.to_json(F.struct(_value(F.coalesce("call_id", "rid")).alias("id"), F.col("name").alias("name"), F.col("content").alias("result")))
    canonical = F.when(F.col("call").isNull(), rest).otherwise(F.concat(F.lit('{"arguments":'), parsed, F.when(rest == "{}", "").otherwise(","), F.substring(rest, 2, 1 << 30)))
    j = j.select(
        F.coalesce("conv", "rconv").alias("conv"), F.coalesce("call_id", "rid").alias("call_id"), status.alias("status"), "name",
        F.when(F.col("call").isNotNull(), F.col("depth")).otherwise(0).cast("long").alias("depth"),
        F.coalesce("turn", "rturn", F.lit(0)).cast("long").alias("turn"), F.coalesce(F.array_join("errors", "; "), F.lit("")).alias("errors"), canonical.alias("canonical"),
    )
    order = F.coalesce("depth", F.lit(1 << 30)) * F.lit(1 << 32) + F.shiftright(F.col("turn"), 8)
    j = j.withColumn("__d", F.coalesce("depth", F.lit(1 << 30)))
    j = common.with_running(j, ["conv"], [F.col("__d"), F.col("turn"), F.col("call_id")], F.lit(1), "position", order)
    return j.drop("__d").withColumn("conv", _value(F.col("conv"))).withColumn("call_id", _value(F.col("call_id")))


def traffic(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Calls and results made of a plain chat table: each assistant turn a call, each later user turn a result.

    The chat table has no tool messages. A call's arguments follow from its text's words; by their
    number some are malformed, of a wrong type, incomplete or have a field too many. A call waits for
    the one two turns before; a user turn answers the turn before it. Turns without a conversation or a number stay
    without, so that link() keeps each of them apart.
    """
    n = F.coalesce(F.size(F.regexp_extract_all("text", F.lit(common.WORD), F.lit(0))), F.lit(0)).cast("long")
    word = F.regexp_extract(F.coalesce("text", F.lit("")), "[A-Za-z]+", 0)
    c = conversations.select(F.col("conv_id").cast("string").alias("conv"), F.col("turn").cast("long").alias("turn"), "role", "text", n.alias("n"), word.alias("q"))
    ident = lambda turn: F.concat(F.lit("c"), F.coalesce("conv", F.lit("")), F.lit("-"), turn.cast("string"))
    arguments = (
        F.when(F.col("n") % 11 == 3, F.concat(F.lit('{"query": "'), "q", F.lit('", "limit": ')))
        .when(F.col("n") % 5 == 0, F.concat(F.lit('{"query": "'), "q", F.lit('", "limit": "'), "n", F.lit('"}')))
        .when(F.col("n") % 5 == 1, F.concat(F.lit('{"limit": '), "n", F.lit("}")))
        .when(F.col("n") % 5 == 2, F.concat(F.lit('{"query": "'), "q", F.lit('", "limit": '), "n", F.lit(', "extra": true}')))
        .otherwise(F.concat(F.lit('{ "query" : "'), "q", F.lit('", "limit" : '), "n", F.lit(" }")))
    )
    name = F.element_at(F.array(F.lit("search"), F.lit("lookup"), F.lit("summarize")), (F.col("n") % 3 + 1).cast("int"))
    calls = c.where("role = 'assistant'").select("conv", "turn", ident(F.col("turn")).alias("call_id"), name.alias("name"), arguments.alias("arguments"), F.when(F.col("turn") >= 2, ident(F.col("turn") - 2)).alias("after"))
    results = c.where("role = 'user' and turn > 0").select("conv", "turn", ident(F.col("turn") - 1).alias("call_id"), F.col("text").alias("content"))
    return calls, results


def linked(conversations: DataFrame) -> DataFrame:
    return link(*traffic(conversations))


ORACLE_SQL = r"""
with c as (
  select conv_id::varchar as conv, turn, role, text, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) as n,
    regexp_extract(coalesce(text, ''), '[A-Za-z]+') as q from conversations),
calls as (
  select conv, turn, 'c' || coalesce(conv, '') || '-' || turn as call_id, ['search', 'lookup', 'summarize'][n % 3 + 1] as name, n, q,
    case when turn >= 2 then 'c' || coalesce(conv, '') || '-' || (turn - 2) end as after,
    case when n % 11 = 3 then 'malformed' when n % 5 = 0 then 'text' when n % 5 = 1 then 'less' when n % 5 = 2 then 'more' else 'good' end as kind
  from c where role = 'assistant'),
res as (select conv, turn, 'c' || coalesce(conv, '') || '-' || (turn - 1) as call_id, text as content, true as has from c where role = 'user' and turn > 0),
chain as (
  select a.conv, a.turn, a.call_id, (select count(*) from calls b where b.conv = a.conv and b.turn < a.turn and b.turn % 2 = a.turn % 2
      and not exists (select 1 from range(0, 1000, 2) t(x) where x > 0 and b.turn + x < a.turn
        and not exists (select 1 from calls m where m.conv = a.conv and m.turn = b.turn + x))) as depth
  from calls a),
e as (
  select calls.*, coalesce(chain.depth, 0) as depth, true as call,
    case kind when 'malformed' then 'malformed'
      when 'text' then 'limit is not bigint'
      when 'less' then case when name in ('search', 'lookup') then 'missing query' else '' end
      when 'more' then 'unknown extra' else '' end as e1,
    case when after is not null and not exists (select 1 from calls k where k.conv = calls.conv and k.call_id = calls.after) then 'unknown after' else '' end as e2
  from calls left join chain using (conv, call_id)),
j as (
  select coalesce(e.conv, res.conv) as conv, coalesce(e.call_id, res.call_id) as call_id,
    case when e.call is null then 'orphan' when res.has is null then 'pending' else 'linked' end as status, e.name,
    coalesce(e.depth, 0)::bigint as depth, coalesce(e.turn, res.turn)::bigint as turn,
    coalesce(case when e1 <> '' and e2 <> '' then e1 || '; ' || e2 else e1 || e2 end, '') as errors,
    case when e.call is null then '' else '"arguments":' || case kind
      when 'malformed' then to_json('{"query": "' || q || '", "limit": ')::varchar
      when 'text' then '{"limit":"' || n || '","query":"' || q || '"}'
      when 'less' then '{"limit":' || n || '}'
      when 'more' then '{"extra":true,"limit":' || n || ',"query":"' || q || '"}'
      else '{"limit":' || n || ',"query":"' || q || '"}' end || ',' end as args,
    res.content
  from e full join res on e.conv = res.conv and e.call_id = res.call_id)
select conv, call_id, status, name, depth, turn, errors,
  '{' || args || '"id":' || to_json(call_id)::varchar || case when name is not null then ',"name":"' || name || '"' else '' end
    || case when content is not null then ',"result":' || to_json(content)::varchar else '' end || '}' as canonical,
  case when conv is null then 0 else row_number() over (partition by conv order by depth, turn, call_id) - 1 end::bigint as position
from j
"""
