"""Results do not depend on the number of partitions, and the queries agree with their SQL."""

from pathlib import Path

import pytest

import __spark_entry__ as entry
import oracle_check
from graphloom.llm import queries as Q

DATA = Path("/root/testdata/sf0.001")


@pytest.mark.skipif(not DATA.exists(), reason="no tables")
@pytest.mark.parametrize("name", list(Q.QUERIES))
def test_partitions(spark, name):
    results = []
    for n in ("1", "7"):
        spark.conf.set("spark.sql.shuffle.partitions", n)
        results.append(oracle_check.canon(entry.queries()[name](spark, str(DATA)).toPandas()))
    spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert results[0].equals(results[1])


@pytest.mark.skipif(not DATA.exists(), reason="no tables")
@pytest.mark.parametrize("name", list(Q.ORACLE))
def test_parity(spark, name):
    assert oracle_check.compare(spark, str(DATA), name).startswith("same")
