"""Operators that SQL can express, against their SQL on the smallest tables."""

from __future__ import annotations

import duckdb
import pytest

from skimmer.llm import catalogue


@pytest.mark.parametrize("name", sorted(catalogue.oracle_sql()))
def test_query_matches_sql(spark, sf_dir, name):
    con = duckdb.connect()
    for t in ("documents", "conversations", "labels"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    found, wanted = catalogue.queries()[name](spark, sf_dir), con.sql(catalogue.oracle_sql()[name])
    order = sorted(found.columns)
    assert order == sorted(wanted.columns)
    assert sorted(tuple(r) for r in found.select(*order).collect()) == sorted(wanted.select(*order).fetchall())
