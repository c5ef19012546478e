"""The registry: every query runs on the smallest tables and agrees with its SQL."""

from pathlib import Path

import pytest

import __spark_entry__ as entry
import oracle_check

DATA = Path("/root/testdata/sf0.001")
NAMES = [n for n in entry.oracle_sql() if not n.startswith(("p8_",))]


def test_registry_is_consistent():
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.skipif(not DATA.exists(), reason="no tables")
def test_entry(spark):
    df = entry.entry(spark)
    assert df.columns == ["record_kind", "repo_id", "snapshot_no", "change_kind", "records"]


@pytest.mark.skipif(not DATA.exists(), reason="no tables")
@pytest.mark.parametrize("name", [n for n in NAMES if n in {"p2_found", "p4_fields", "p5_hierarchy", "id_nodes", "gr_lift", "res_narrowing", "an_hotspots", "con_merge", "usage_sessions", "txt_bm25", "str_daily", "vec_top_k"}])
def test_parity(spark, name):
    assert oracle_check.compare(spark, str(DATA), name).startswith("same")
