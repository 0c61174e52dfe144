"""Every query of the library against its SQL in DuckDB, on the smallest tables."""

import datetime
import math
import os
from decimal import Decimal

import duckdb
import pytest

from partledger.plans import registry

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
QUERIES, ORACLE = registry.queries(), registry.oracle_sql()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 6)
    if isinstance(v, Decimal):
        return round(float(v), 6)
    if isinstance(v, (datetime.date, datetime.datetime)):
        return v.isoformat()
    return v


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query_matches_sql(spark, duck, name):
    df = QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    got = sorted((tuple(plain(r[c]) for c in columns) for r in df.collect()), key=str)
    relation = duck.sql(ORACLE[name])
    names = list(relation.columns)
    assert sorted(names) == columns
    want = sorted((tuple(plain(r[names.index(c)]) for c in columns) for r in relation.fetchall()), key=str)
    assert got == want


@pytest.mark.parametrize("name", sorted(QUERIES.keys() - ORACLE.keys()))
def test_query_without_sql_runs(spark, name):
    df = QUERIES[name](spark, SF)
    assert df.count() > 0 and len(set(df.columns)) == len(df.columns)


def test_sql_belongs_to_queries():
    assert ORACLE.keys() <= QUERIES.keys()


def test_many_lines_are_dealt_by_their_number(spark, duck, monkeypatch):
    """A task takes so many lines, whatever the session's partitions are, and the rows stay the same."""
    from partledger.sources import tables

    monkeypatch.setattr(tables, "LINES_A_TASK", 300, raising=False)
    lines = spark.read.parquet(f"{SF}/lineitem.parquet").count()
    assert tables.supply_rows(spark, SF).rdd.getNumPartitions() == -(-lines // 300)
    for name in ("top_supplier_by_category", "supplier_manifest", "model_stats", "reuse_top_combo"):
        test_query_matches_sql(spark, duck, name)
