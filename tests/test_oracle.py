"""Every registered query against its DuckDB oracle at sf0.01 (the driver's check)."""

from __future__ import annotations

import pytest

from __spark_entry__ import oracle_sql, queries
from oracle_compare import compare, duck
from visitlake.plans.primitives import PRIMITIVES
from visitlake.plans.registry import QUERIES

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def con():
    return duck(SF)


def test_every_query_has_an_oracle():
    # queries of optional parts may lack SQL; they have brute-force tests of their own
    assert set(QUERIES) | set(PRIMITIVES) <= set(oracle_sql()) <= set(queries())


@pytest.mark.parametrize("name", sorted(oracle_sql()))
def test_query_matches_oracle(spark, con, name):
    r = compare(spark, name, SF, con)
    assert r["status"] == "match", r


def test_entry_smoke(spark):
    from __spark_entry__ import entry

    df = entry(spark)
    assert df.count() > 0
    assert df.columns == ["date", "source_name", "visitors"]
