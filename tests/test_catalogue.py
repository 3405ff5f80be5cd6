"""Queries against their SQL on the smallest data; the driver compares all of them on a larger one."""

import math
import os

import duckdb
import pytest

from millrace.plans import grading, records, reports, search, stateful  # noqa: F401
from millrace.plans.registry import ORACLE, QUERIES

SF = "/root/testdata/sf0.001"
NAMES = ["bm25_topk", "knn_cosine_topk", "rrf_hybrid", "minmax_fusion", "context_window_merge", "semantic_breakpoints_iqr", "url_canonical", "robots_longest_prefix", "scd2_versions", "ip_extract", "run_status", "range_join", "all_records", "case_outcome", "acknowledged_work", "image_anchor", "changed_only", "gap_report", "feedback_states", "index_scan", "dual_write_index"]
TABLES = "documents pages conversations embeddings benchmark labels events lineitem orders customer part supplier nation region".split()


def rows(columns, data):
    order = sorted(range(len(columns)), key=columns.__getitem__)
    plain = lambda x: None if x is None or isinstance(x, float) and math.isnan(x) else round(x, 8) + 0.0 if isinstance(x, float) else x
    return sorted((tuple(plain(r[i]) for i in order) for r in data), key=repr)


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return c


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test data")
@pytest.mark.parametrize("name", NAMES)
def test_matches_sql(spark, duck, name):
    df = QUERIES[name](spark, SF)
    got = rows(df.columns, [tuple(r) for r in df.collect()])
    rel = duck.sql(ORACLE[name])
    assert sorted(df.columns) == sorted(rel.columns)
    assert got == rows(rel.columns, rel.fetchall()) and got


def test_every_query_is_named_once():
    assert set(ORACLE) <= set(QUERIES) and len(QUERIES) > 80


def test_extraction_search_has_no_page(spark, tmp_path):
    docs = [(i, f"from 1.{i // 250}.{i % 250}.7 on") for i in range(450)]
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    c = duckdb.connect()
    c.execute(f"create view documents as select * from '{tmp_path}/documents.parquet/*.parquet'")
    df = QUERIES["extraction_search"](spark, str(tmp_path))
    rel = c.sql(ORACLE["extraction_search"])
    got = rows(df.columns, [tuple(r) for r in df.collect()])
    assert len(got) > 200 and got == rows(rel.columns, rel.fetchall())
