"""Named queries beside their SQL twins on the smallest tables."""

import os

import duckdb
import pytest

import __spark_entry__ as entry
from tests.conftest import SMALL
from tools.check_oracle import TABLES, canon

HEADLINE = [
    "tokenize", "resolve_timeframe", "relative_date_label", "scope_filter", "current_period_head", "entity_lookup", "memory_gate", "corpus_size", "bm25_topk", "vector_topk_all",
    "rrf_fuse", "keyfact_rank", "keyfact_guarantee", "stage1_entity_match", "trace_resolve", "exhaustive_count_facts", "graph_walk", "topic_clusters", "daily_sources", "run_rollup",
    "grounding_resolve", "attribute_scd2_replace", "relationship_upsert", "import_merge_summaries", "sink_memory_export", "src_locomo", "sessionize_turns", "rekey_job",
    "stream_capture", "stream_daily_volume", "stream_rate_limit", "daily_digest",
]
NAMES = sorted(entry.oracle_sql()) if os.environ.get("MEMSPARK_ALL") else HEADLINE


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from '{SMALL}/{t}.parquet'")
    return c


def test_every_query_has_a_callable():
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("name", NAMES)
def test_same_rows(spark, con, name):
    df = entry.queries()[name](spark, SMALL)
    cols = sorted(df.columns)
    got = sorted(tuple(canon(r[c]) for c in cols) for r in df.collect())
    cur = con.execute(entry.oracle_sql()[name])
    have = [d[0] for d in cur.description]
    want = sorted(tuple(canon(r[have.index(c)]) for c in cols) for r in cur.fetchall())
    assert sorted(have) == cols and got == want


def test_entry(spark):
    assert entry.entry(spark).count() > 0
