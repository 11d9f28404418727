"""Every registered query of the engine against DuckDB on the smallest tables."""

import datetime
import math

import duckdb
import pytest

from quarry.plans import contract

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split():
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{FOLDER}/{t}.parquet'")
    return con


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 6)
    return v.replace(tzinfo=None) if isinstance(v, datetime.datetime) else v


@pytest.mark.parametrize("name", contract.QUERIES)
def test_query(spark, duck, name):
    df = contract.QUERIES[name](spark, FOLDER)
    found = duck.execute(contract.ORACLES[name])
    names = [d[0] for d in found.description]
    assert sorted(names) == sorted(df.columns)
    want = sorted((tuple(plain(dict(zip(names, r, strict=True))[c]) for c in sorted(names)) for r in found.fetchall()), key=repr)
    assert sorted((tuple(plain(r[c]) for c in sorted(names)) for r in df.collect()), key=repr) == want


@pytest.mark.parametrize(("name", "table"), [("join_loose_keys", "orders"), ("json_missing", "events"), ("where_unreadable", "orders"), ("where_date_unequal", "orders")])
def test_features_over_whole_tables(spark, duck, name, table):
    n = duck.execute(f"SELECT count(*) FROM {table}").fetchone()[0]
    assert contract.QUERIES[f"{name}_whole"](spark, FOLDER).count() > 0.99 * n


@pytest.mark.parametrize("name", ["join_loose_keys", "join_loose_keys_whole"])
@pytest.mark.parametrize("broadcast", ["10m", "-1"])
def test_loose_joins_are_by_keys(spark, name, broadcast):
    """Whatever the tables' sizes, no plan meets all pairs."""
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", broadcast)
    try:
        plan = contract.QUERIES[name](spark, FOLDER)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert "NestedLoop" not in plan and "Cartesian" not in plan and ("HashJoin" in plan or "SortMergeJoin" in plan)
