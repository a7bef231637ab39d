"""Plans of the core queries: columns are pruned at the scan, filters reach it, nothing is a cartesian product."""

import re
from pathlib import Path

import pytest

from millrace.plans import corpus

DATA = Path("/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not DATA.exists(), reason="no test tables")


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def schemas(df):
    return re.findall(r"ReadSchema: struct<([^>]*)", plan(df))


@pytest.mark.parametrize("name,columns", [("val_sizes", "id:string"), ("epoch_order", None), ("hold_out", "conv_id:bigint"), ("verify_records", None), ("lenient_lines", "text:string,source:string,id:string")])
def test_scans_read_what_they_need(spark, name, columns):
    got = schemas(corpus.QUERIES[name](spark, str(DATA)))
    assert got and all("upstream" not in s and "ingested_at" not in s and "messages" not in s for s in got)
    if columns:
        assert set(got) == {columns}


def test_filters_reach_the_scan(spark):
    assert "PushedFilters: [IsNotNull(text)]" in plan(corpus.presplit(spark, str(DATA)))


@pytest.mark.parametrize("name", ["dedup_exact", "incremental_load", "clean_reasons", "manifest", "mix_order", "agent_windows", "byte_budget"])
def test_no_cartesian_products(spark, name):
    text = plan(corpus.QUERIES[name](spark, str(DATA)))
    assert "CartesianProduct" not in text
    if name in ("dedup_exact", "incremental_load", "agent_windows"):
        assert "SinglePartition" not in text
