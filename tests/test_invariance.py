"""Results do not depend on the number of partitions."""

from pathlib import Path

import pytest

import __spark_entry__ as entry
from oracle_check import canon

DATA = Path("/root/testdata/sf0.001")
NAMES = ["p2_found", "p4_fields", "p5_hierarchy", "gr_lift", "res_narrowing", "an_hotspots", "con_merge", "txt_near_duplicates", "gr_communities", "vec_top_k", "id_overloads", "agg_tree_complexity"]


@pytest.mark.skipif(not DATA.exists(), reason="no tables")
@pytest.mark.parametrize("name", NAMES)
def test_partitions(spark, name):
    results = []
    for n in ("1", "7"):
        spark.conf.set("spark.sql.shuffle.partitions", n)
        results.append(canon(entry.queries()[name](spark, str(DATA)).toPandas()))
    spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert results[0].equals(results[1])
