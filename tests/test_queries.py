"""The queries run on the smallest test data, and agree with their SQL there."""

from __future__ import annotations

import glob
import math
import os

import pytest

ROOT = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(ROOT), reason="no test data")


def _plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 6)
    return str(v)[:26] if hasattr(v, "isoformat") else v


@pytest.fixture(scope="module")
def duck():
    import duckdb

    con = duckdb.connect()
    for p in glob.glob(f"{ROOT}/*.parquet"):
        con.sql(f"create view {os.path.basename(p)[:-8]} as select * from '{p}'")
    return con


SOME = ["vec_cos_topk", "vec_crosswalk_hub", "vec_crosswalk_family", "tool_map", "tool_lookup", "fts_rank", "gr_closure", "mt_dedup", "mt_exact", "dq_gap", "p6_found", "win_chunk", "txt_keywords"]


@pytest.mark.parametrize("name", SOME)
def test_query_matches_sql(spark, duck, name):
    from curralign import queries

    df = queries.queries()[name](spark, ROOT)
    cols = sorted(df.columns)
    got = sorted((tuple(_plain(r[c]) for c in cols) for r in df.collect()), key=repr)
    rel = duck.sql(queries.oracle_sql()[name])
    assert sorted(rel.columns) == cols
    want = sorted((tuple(_plain(v) for v in r) for r in rel.select(*(f'"{c}"' for c in cols)).fetchall()), key=repr)
    assert got == want


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_filters_and_columns_reach_the_scan(spark):
    from curralign import queries

    plan = queries.queries()["src_table"](spark, ROOT)._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(system,valm-core)" in plan and "source_url" not in plan


def test_names_can_be_read_without_a_session():
    import subprocess
    import sys
    from pathlib import Path

    code = "import __spark_entry__ as e; assert len(e.queries()) > 250 and e.oracle_sql()"
    subprocess.run([sys.executable, "-c", code], cwd=Path(__file__).resolve().parents[1], check=True)
