"""Connections over Parquet files that others wrote."""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from ..database.connection import Connection
from ..database.manager import DatabaseManager

#: Unique columns of the driver's tables, where there are any.
KEYS: dict[str, tuple[str, ...]] = {
    "region": ("r_regionkey",), "nation": ("n_nationkey",), "customer": ("c_custkey",), "supplier": ("s_suppkey",), "part": ("p_partkey",), "orders": ("o_orderkey",),
    "lineitem": ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"), "events": ("event_id",), "documents": ("doc_id",), "embeddings": ("vec_id",), "pages": ("page_id",),
}
JSON = {"events": ("props",)}


def opened(spark: SparkSession, folder: str, tables: tuple[str, ...], timezone: str = "UTC") -> Connection:
    """A connection that reads Parquet tables of a folder."""
    manager = DatabaseManager().configure({"connections": {"files": {"timezone": timezone}}})
    connection = manager.connection()
    for t in tables:
        connection.register(t, spark.read.parquet(f"{folder}/{t}.parquet"), KEYS.get(t, ()), JSON.get(t, ()))
    return connection


def gappy_orders(spark: SparkSession, folder: str) -> Connection:
    """Orders whose priority is null where their status is P, as no given table has nulls."""
    connection = opened(spark, folder, ("orders",))
    df = connection._frames["orders"].frame()
    return connection.register("orders", df.withColumn("o_orderpriority", F.when(F.col("o_orderstatus") != "P", F.col("o_orderpriority"))), KEYS["orders"])
