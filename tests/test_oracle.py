"""Some registered queries against their SQL in DuckDB, on the smallest tables. The driver runs them all."""

import math
from pathlib import Path

import duckdb
import pytest

from lintlake.plans import registry

DATA = Path("/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
NAMES = ("config_resolve", "deps_flat", "dep_risky", "history_valid", "score_delta", "trend_summary", "import_edges", "unused_files", "duplicate_exports", "agent_log_events", "scrub_text", "page_links", "lines", "rule_no_eval", "stream_change_filter")


def plain(v):
    return f"{v:.9g}" if isinstance(v, float) and not math.isnan(v) else str(v)


@pytest.fixture(scope="module")
def oracle():
    con = duckdb.connect()
    con.sql("set timezone = 'UTC'")
    for t in TABLES:
        con.sql(f"create view {t} as select * from read_parquet('{DATA / t}.parquet')")
    return con


@pytest.mark.skipif(not DATA.exists(), reason="the driver's tables are not here")
@pytest.mark.parametrize("name", NAMES)
def test_rows_are_the_oracles(spark, oracle, name):
    registry.load()
    df = registry.queries()[name](spark, str(DATA))
    columns = sorted(df.columns)
    got = sorted(tuple(plain(r[c]) for c in columns) for r in df.collect())
    rel = oracle.sql(registry.oracle_sql()[name])
    assert sorted(rel.columns) == columns
    at = [rel.columns.index(c) for c in columns]
    assert got and got == sorted(tuple(plain(r[i]) for i in at) for r in rel.fetchall())


def test_every_query_has_an_oracle():
    registry.load()
    assert set(registry.queries()) == set(registry.oracle_sql())
