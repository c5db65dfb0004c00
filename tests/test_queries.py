"""The registry, and a few queries next to their SQL on the smallest data."""

import os

import pytest

import __spark_entry__ as entry

FOLDER = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test data")


def test_every_sql_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert len(entry.queries()) > 90


@pytest.mark.parametrize("name", ["pace_timing", "exact_dedup", "denylist_keywords", "rate_window", "category_merge", "swap_edit"])
def test_query_equals_sql(spark, name):
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for table in ("documents", "conversations", "embeddings", "events", "pages", "labels", "benchmark"):
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM read_parquet('{FOLDER}/{table}.parquet')")
    frame = entry.queries()[name](spark, FOLDER)
    cursor = con.execute(entry.oracle_sql()[name])
    names = [d[0] for d in cursor.description]
    expected = sorted((tuple(r[names.index(c)] for c in frame.columns) for r in cursor.fetchall()), key=repr)
    assert sorted(names) == sorted(frame.columns)
    assert sorted(map(tuple, frame.collect()), key=repr) == expected


def test_entry_has_rows(spark):
    frame = entry.entry(spark)
    assert frame.columns == ["project_id", "clip_number", "source", "source_id", "media_type", "score"]
    assert frame.count() > 0


def test_scans_read_only_what_is_needed(spark):
    plan = entry.queries()["low_res_filter"](spark, FOLDER)._jdf.queryExecution().executedPlan().toString()
    scans = [line for line in plan.splitlines() if "documents.parquet" in line and "ReadSchema" in line]
    assert scans and all("text" not in line.split("ReadSchema")[1] for line in scans)
