"""Operator 7, URL filter: rules on host and path, then a blocked Bloom filter before an exact join."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: (host, path, verdict) of the query's contract.
RULES = (
    ("org", "/", "allow"),
    ("example.org", "/es/", "block"),
    ("example.org", "/en/1", "block"),
    ("com", "/fr/", "allow"),
    ("com", "/de/", "block"),
)
#: Labels of hosts whose pages the query puts on its list.
LISTED_LABELS = ("spam-farm", "casino-win", "cheap-pills")
#: Listed URLs for each block of 256 bits in the Bloom filter (about one false positive in a thousand), and blocks
#: at most: they bound what is broadcast, 40 MB, whatever the list's length. A longer list makes more false
#: positives, which the exact join takes out.
KEYS, BLOCKS = 16, 1 << 20


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end; empty if null or without ``://``."""
    found = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)([^?#]*)", 1)
    return F.translate(found, UPPER, LOWER)


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)([^?#]*)", 2)


def canonical(host: Column, path: Column) -> Column:
    """One form for all spellings of a page's URL: no scheme, ``www.``, query, fragment or last ``/``."""
    return F.concat(F.regexp_replace(host, r"^www\.", ""), F.regexp_replace(path, r"/+\z", ""))


def rule_verdict(host: Column, path: Column, rules: Sequence[tuple[str, str, str]]) -> tuple[Column, Column]:
    """The longest rule that fits, and its verdict. Ties in length: block before allow.

    ``rules`` is a short list; long lists belong in the table of listed URLs.
    """
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for h, p, v in sorted(rules, key=lambda r: (len(r[0] + r[1]), r[2])):
        fits = ((host == h) | host.endswith(f".{h}")) & path.startswith(p)
        rule, verdict = F.when(fits, F.lit(h + p)).otherwise(rule), F.when(fits, F.lit(v)).otherwise(verdict)
    return rule, verdict


def _bits(key: Column, blocks: int) -> tuple[Column, list[Column]]:
    """A key's block and its two bits in each of the block's four 64-bit words."""
    spread = F.xxhash64(key, F.lit(1))
    bit = lambda i: F.shiftright(spread, 6 * i).bitwiseAND(63).cast("int")
    one = F.lit(1).cast("long")
    words = [F.call_function("shiftleft", one, bit(2 * j)).bitwiseOR(F.call_function("shiftleft", one, bit(2 * j + 1))) for j in range(4)]
    return F.pmod(F.xxhash64(key), F.lit(blocks)).cast("int"), words


def bloom(listed: DataFrame, blocks: int, key: str = "canonical") -> DataFrame:
    """Blocked Bloom filter of ``key``: a row (block, w0..w3) for each block in use, ``blocks`` at most."""
    block, words = _bits(F.col(key), blocks)
    return (
        listed.where(F.col(key).isNotNull())
        .select(block.alias("block"), *[w.alias(f"w{j}") for j, w in enumerate(words)])
        .groupBy("block")
        .agg(*[F.bit_or(f"w{j}").alias(f"w{j}") for j in range(4)])
    )


def filter_urls(pages: DataFrame, listed: DataFrame, rules: Sequence[tuple[str, str, str]] = RULES, url: str = "url") -> DataFrame:
    """``pages`` with host, path, rule, verdict and listed (other columns stay; old ones of these names go).

    A rule's verdict comes first. Of the other pages, those whose canonical URL the Bloom filter of
    ``listed`` (canonical string, repeats and nulls allowed) may hold go to an exact hash join, which
    takes out false positives: hits block, all else is allowed. The list is written once; the filter
    is sized by its length and broadcast; BLOCKS bounds it. Null URLs have empty host and path and are allowed. Repeated rows are judged row by row; empty
    tables give empty results.
    """
    own = [c for c in pages.columns if c not in ("host", "path", "rule", "verdict", "listed")]
    host, path = host_of(F.col(url)), path_of(F.col(url))
    p = pages.select(*own, host.alias("host"), path.alias("path"))
    rule, verdict = rule_verdict(F.col("host"), F.col("path"), rules)
    p = p.select(*own, "host", "path", rule.alias("rule"), verdict.alias("__v"), canonical(F.col("host"), F.col("path")).alias("__c"))
    keys = common.cut(listed.where("canonical is not null").select(F.col("canonical").alias("__k")).distinct())
    size = max(1, min(BLOCKS, -(-keys.count() // KEYS)))
    block, words = _bits(F.col("__c"), size)
    blocks = bloom(keys, size, "__k").toDF("__block", "__w0", "__w1", "__w2", "__w3")
    may = p.join(F.broadcast(blocks), block == F.col("__block"), "left")
    passes = F.lit(True)
    for j, w in enumerate(words):
        passes = passes & (F.col(f"__w{j}").bitwiseAND(w) == w)
    may = may.withColumn("__may", F.coalesce(passes & F.col("__v").isNull(), F.lit(False))).drop(*blocks.columns)
    sure = may.where("not __may").withColumn("listed", F.lit(False))
    hits = may.where("__may").join(keys, F.col("__c") == F.col("__k"), "left").withColumn("listed", F.col("__k").isNotNull()).drop("__k")
    out = sure.unionByName(hits)
    judged = F.coalesce(F.col("__v"), F.when(F.col("listed"), "block").otherwise("allow"))
    return out.select(*own, "host", "path", "rule", judged.alias("verdict"), "listed")


def listed_urls(pages: DataFrame, labels: Sequence[str] = LISTED_LABELS, url: str = "url") -> DataFrame:
    """The query's list: canonical URLs of pages on hosts with one of ``labels`` (list-building from the table itself)."""
    host = host_of(F.col(url))
    found = pages.select(host.alias("h"), path_of(F.col(url)).alias("p")).where(
        F.arrays_overlap(F.split("h", r"\."), F.array(*[F.lit(x) for x in labels]))
    )
    return found.select(canonical(F.col("h"), F.col("p")).alias("canonical")).distinct()


ORACLE_SQL = """
with u as (
  select page_id,
    translate(regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)([^?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as host,
    regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)([^?#]*)', 2) as path
  from pages),
c as (
  select *, regexp_replace(host, '^www\\.', '') || regexp_replace(path, '/+\\z', '') as canonical,
    case when (host = 'example.org' or host like '%.example.org') and starts_with(path, '/en/1') then 'example.org/en/1'
         when (host = 'example.org' or host like '%.example.org') and starts_with(path, '/es/') then 'example.org/es/'
         when (host = 'com' or host like '%.com') and starts_with(path, '/de/') then 'com/de/'
         when (host = 'com' or host like '%.com') and starts_with(path, '/fr/') then 'com/fr/'
         when (host = 'org' or host like '%.org') and starts_with(path, '/') then 'org/' end as rule
  from u),
l as (select distinct canonical from c where list_has_any(string_split(host, '.'), ['spam-farm', 'casino-win', 'cheap-pills']))
select page_id, host, path, rule,
  case when rule in ('org/', 'com/fr/') then 'allow' when rule is not null then 'block'
       when canonical in (select canonical from l) then 'block' else 'allow' end as verdict,
  (rule is null and canonical in (select canonical from l)) as listed
from c
"""
