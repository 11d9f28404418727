"""Registered queries: one for each operator and more, each with DuckDB SQL for the same rows."""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..database.manager import DatabaseManager
from ..database.migrations import Migration, Seeder
from ..exceptions import DatabaseBlockedException, MultipleRecordsFoundException, RecordsNotFoundException, SchemaException, UniqueConstraintViolationException
from ..functions import literals
from ..functions.predicate import let
from ..operators.builder import Builder
from ..schema.schema import SchemaBuilder
from ..sources.external import gappy_orders, opened

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None, *tables: str, timezone: str = "UTC") -> Callable[[Callable[[Any], Any]], Any]:
    """Register a query over a connection that reads ``tables``."""

    def add(build: Callable[[Any], Any]) -> Any:
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            out = build(opened(spark, sf_dir, tables, timezone))
            return out if isinstance(out, DataFrame) else out.to_df()

        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = sql
        return build

    return add


def one(spark_like: Any, **values: Any) -> DataFrame:
    """A row of results that terminals gave."""
    row = [literals.column(v).alias(k) for k, v in values.items()]
    return spark_like.spark.range(1).select(*row)


ORDER = "o_orderkey, o_custkey, o_orderstatus, o_totalprice, o_orderpriority"
COLS = ORDER.split(", ")


def orders(c: Any) -> Builder:
    return c.table("orders").select(*COLS)


# --- conditions ----------------------------------------------------------------------------------------------------

query("where_basic", f"SELECT {ORDER} FROM orders WHERE o_totalprice >= 300000 AND o_orderstatus = 'F'", "orders")(lambda c: orders(c).where("o_totalprice", ">=", "300000").where({"o_orderstatus": "F"}))
query("where_or", f"SELECT {ORDER} FROM orders WHERE o_totalprice > 400000 OR o_orderstatus = 'P' AND o_totalprice < 50000", "orders")(
    lambda c: orders(c).where("o_totalprice", ">", 400000).or_where("o_orderstatus", "P").where("o_totalprice", "<", 50000)
)
query("where_nested", f"SELECT {ORDER} FROM orders WHERE (o_orderstatus = 'O' OR o_orderstatus = 'P') AND NOT (o_totalprice < 200000 OR o_orderkey < 100)", "orders")(
    lambda c: orders(c).where(lambda q: q.where("o_orderstatus", "O").or_where("o_orderstatus", "P")).where_not(lambda q: q.where("o_totalprice", "<", 200000).or_where("o_orderkey", "<", 100))
)
query("where_or_object", f"SELECT {ORDER} FROM orders WHERE o_orderkey < 50 OR (o_orderstatus = 'P' OR o_custkey = 7)", "orders")(lambda c: orders(c).where("o_orderkey", "<", 50).or_where({"o_orderstatus": "P", "o_custkey": 7}))
query("where_or_not", f"SELECT {ORDER} FROM orders WHERE o_orderkey < 10 OR NOT (o_totalprice > 5000)", "orders")(lambda c: orders(c).where("o_orderkey", "<", 10).or_where_not("o_totalprice", ">", 5000))
query("where_strict", f"SELECT {ORDER} FROM orders WHERE o_custkey = 10", "orders")(lambda c: orders(c).where("o_custkey", "===", 10).where("o_orderstatus", "!==", 5))
query("where_loose", f"SELECT {ORDER} FROM orders WHERE o_custkey = 10 AND o_orderkey < 14000.5", "orders")(lambda c: orders(c).where("o_custkey", "10").where("o_orderkey", "<", "14000.5"))
query("where_unreadable", f"SELECT {ORDER} FROM orders WHERE o_orderkey < 20", "orders")(lambda c: orders(c).where("o_custkey", "!=", "ten").where("o_orderkey", "<", 20))
query("where_unreadable_whole", f"SELECT {ORDER} FROM orders", "orders")(lambda c: orders(c).where("o_custkey", "!=", "ten"))
query("where_in", f"SELECT {ORDER} FROM orders WHERE o_custkey IN (1, 2, 3, 40) OR o_orderkey IN (5)", "orders")(lambda c: orders(c).where_in("o_custkey", [1, 2, "3", 40]).or_where_in("o_orderkey", [5, None]))
query("where_in_empty", f"SELECT {ORDER} FROM orders WHERE o_orderkey < 5", "orders")(lambda c: orders(c).where_in("o_custkey", []).or_where("o_orderkey", "<", 5))
query("where_not_in", f"SELECT {ORDER} FROM orders WHERE o_orderstatus NOT IN ('O', 'F')", "orders")(lambda c: orders(c).where_not_in("o_orderstatus", ["O", "F"]))
query("where_not_in_null", f"SELECT {ORDER} FROM orders WHERE o_orderkey < 4", "orders")(lambda c: orders(c).where_not_in("o_orderstatus", ["O", None]).or_where("o_orderkey", "<", 4))
query("where_between", f"SELECT {ORDER} FROM orders WHERE o_totalprice BETWEEN 100000 AND 110000", "orders")(lambda c: orders(c).where_between("o_totalprice", [100000, 110000]))
query("where_not_between", f"SELECT {ORDER} FROM orders WHERE NOT (o_totalprice BETWEEN 5000 AND 450000) OR o_orderkey BETWEEN 3 AND 6", "orders")(
    lambda c: orders(c).where_not_between("o_totalprice", [5000, 450000]).or_where_between("o_orderkey", [3, 6])
)
query("where_between_reversed", f"SELECT {ORDER} FROM orders WHERE o_orderkey <= 9", "orders")(lambda c: orders(c).where_between("o_totalprice", [9, 1]).or_where("o_orderkey", "<=", 9))
query("where_like", "SELECT p_partkey, p_name FROM part WHERE p_name ILIKE 'R_D%G%T'", "part")(lambda c: c.table("part").select("p_partkey", "p_name").where_like("p_name", "r_D%%G%t"))
query("where_like_case", "SELECT p_partkey, p_name FROM part WHERE p_name LIKE 'red%' OR p_name LIKE 'Blue%'", "part")(lambda c: c.table("part").select("p_partkey", "p_name").where_like("p_name", "red%", True).or_where_like("p_name", "Blue%", True))
query("where_not_like", "SELECT c_custkey, c_name FROM customer WHERE c_name NOT ILIKE '%0%' OR c_custkey = 1", "customer")(lambda c: c.table("customer").select("c_custkey", "c_name").where_not_like("c_name", "%0%").or_where("c_custkey", 1))
query("where_like_escape", r"SELECT c_custkey FROM customer WHERE c_name LIKE '%\_%' ESCAPE '\' OR c_custkey < 3", "customer")(lambda c: c.table("customer").select("c_custkey").where_like("c_name", "%\\_%").or_where("c_custkey", "<", 3))
query("where_like_operator", "SELECT c_custkey FROM customer WHERE c_mktsegment ILIKE 'b%' AND c_name NOT ILIKE '%9'", "customer")(lambda c: c.table("customer").select("c_custkey").where("c_mktsegment", "like", "B%").where("c_name", "not like", "%9"))
query("where_date", f"SELECT {ORDER} FROM orders WHERE o_orderdate >= TIMESTAMP '1996-03-01' AND o_orderdate < TIMESTAMP '1996-03-02'", "orders")(lambda c: orders(c).where_date("o_orderdate", "1996-03-01"))
query("where_date_range", f"SELECT {ORDER} FROM orders WHERE o_orderdate >= TIMESTAMP '1997-01-02' AND o_orderdate < TIMESTAMP '1997-01-05' OR o_orderdate < TIMESTAMP '1995-01-05'", "orders")(
    lambda c: orders(c).where_date("o_orderdate", ">", "1997-01-01").where_date("o_orderdate", "<=", "1997-01-04").or_where_date("o_orderdate", "<", "1995-01-05")
)
query("where_date_unequal", f"SELECT {ORDER} FROM orders WHERE NOT (o_orderdate >= TIMESTAMP '1996-03-01' AND o_orderdate < TIMESTAMP '1996-03-02') AND o_orderkey < 500", "orders")(lambda c: orders(c).where_date("o_orderdate", "!=", "1996-03-01").where("o_orderkey", "<", 500))
query("where_date_unequal_whole", f"SELECT {ORDER} FROM orders WHERE NOT (o_orderdate >= TIMESTAMP '1996-03-01' AND o_orderdate < TIMESTAMP '1996-03-02')", "orders")(lambda c: orders(c).where_date("o_orderdate", "!=", "1996-03-01"))
query("where_date_zoned", "SELECT event_id FROM events WHERE CAST((ts AT TIME ZONE 'UTC') AT TIME ZONE 'America/New_York' AS DATE) = DATE '2024-01-10'", "events", timezone="America/New_York")(lambda c: c.table("events").select("event_id").where_date("ts", "2024-01-10"))
query("where_year", f"SELECT {ORDER} FROM orders WHERE year(o_orderdate) = 1996", "orders")(lambda c: orders(c).where_year("o_orderdate", "1996"))
query("where_month", f"SELECT {ORDER} FROM orders WHERE month(o_orderdate) >= 11 OR month(o_orderdate) = 2", "orders")(lambda c: orders(c).where_month("o_orderdate", ">=", 11).or_where_month("o_orderdate", 2))
query("where_day", f"SELECT {ORDER} FROM orders WHERE day(o_orderdate) = 29 OR day(o_orderdate) < 3", "orders")(lambda c: orders(c).where_day("o_orderdate", 29).or_where_day("o_orderdate", "<", 3))
query("where_time", "SELECT event_id FROM events WHERE strftime(ts, '%H:%M:%S') >= '23:30:00' OR strftime(ts, '%H:%M:%S') < '00:10:00'", "events")(lambda c: c.table("events").select("event_id").where_time("ts", ">=", "23:30").or_where_time("ts", "<", "00:10:00"))
query("where_time_zoned", "SELECT event_id FROM events WHERE strftime((ts AT TIME ZONE 'UTC') AT TIME ZONE 'America/New_York', '%H:%M:%S') < '01:00:00'", "events", timezone="America/New_York")(lambda c: c.table("events").select("event_id").where_time("ts", "<", "01:00"))
query("where_column", "SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey FROM lineitem WHERE l_discount > l_tax AND l_quantity = l_linenumber", "lineitem")(
    lambda c: c.table("lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey").where_column("l_discount", ">", "l_tax").where_column("l_quantity", "l_linenumber")
)
query("where_any", f"SELECT {ORDER} FROM orders WHERE o_orderkey = 7 OR o_custkey = 7", "orders")(lambda c: orders(c).where_any(["o_orderkey", "o_custkey"], 7))
query("where_all", f"SELECT {ORDER} FROM orders WHERE o_orderkey < 900 AND o_custkey < 900", "orders")(lambda c: orders(c).where_all(["o_orderkey", "o_custkey"], "<", 900))
query("where_none", f"SELECT {ORDER} FROM orders WHERE NOT (o_orderkey > 300 OR o_custkey > 700)", "orders")(lambda c: orders(c).where_not(lambda q: q.where("o_orderkey", ">", 300).or_where("o_custkey", ">", 700)))
query("where_none_same", f"SELECT {ORDER} FROM orders WHERE NOT (o_orderkey > 300 OR o_custkey > 300)", "orders")(lambda c: orders(c).where_none(["o_orderkey", "o_custkey"], ">", 300))


def _gappy(name: str, sql: str, build: Callable[[Builder], Builder]) -> None:
    QUERIES[name] = lambda spark, sf_dir: build(gappy_orders(spark, sf_dir).table("orders").select(*COLS)).to_df()
    ORACLES[name] = f"WITH o AS (SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice, CASE WHEN o_orderstatus <> 'P' THEN o_orderpriority END AS o_orderpriority FROM orders) SELECT {ORDER} FROM o WHERE {sql}"


_gappy("where_null", "o_orderpriority IS NULL", lambda q: q.where_null("o_orderpriority"))
_gappy("where_not_null", "o_orderpriority IS NOT NULL AND o_totalprice > 400000", lambda q: q.where_not_null("o_orderpriority").where("o_totalprice", ">", 400000))
_gappy("where_null_shorthand", "o_orderpriority IS NULL AND o_custkey < 500 OR o_orderkey < 5", lambda q: q.where("o_orderpriority", None).where("o_custkey", "<", 500).or_where("o_orderkey", "<", 5))
_gappy("where_not_3vl", "NOT (o_orderpriority = '1-URGENT' AND o_totalprice > 1000)", lambda q: q.where_not(lambda n: n.where("o_orderpriority", "1-URGENT").where("o_totalprice", ">", 1000)))
_gappy("where_not_in_3vl", "o_orderpriority NOT IN ('1-URGENT', '2-HIGH')", lambda q: q.where_not_in("o_orderpriority", ["1-URGENT", "2-HIGH"]))
_gappy("where_in_none_3vl", "o_orderpriority IS NOT NULL", lambda q: q.where_not_in("o_orderpriority", []))
_gappy("where_not_like_3vl", "o_orderpriority NOT ILIKE '%U%'", lambda q: q.where_not_like("o_orderpriority", "%u%"))
_gappy("where_unknown", "o_orderkey < 3", lambda q: q.where("o_totalprice", ">", None).or_where("o_orderkey", "<", 3))

# --- JSON ----------------------------------------------------------------------------------------------------------

query("json_path", "SELECT event_id, json_extract(props, '$.k')::VARCHAR AS k FROM events WHERE CAST(json_extract_string(props, '$.k') AS INT) >= 90", "events")(lambda c: c.table("events").select("event_id", "props->k").where("props->k", ">=", 90))
query("json_missing", "SELECT event_id FROM events WHERE json_extract(props, '$.none.k') IS NULL AND event_id < 100", "events")(lambda c: c.table("events").select("event_id").where_null("props->none->k").where("event_id", "<", 100))

query("json_missing_whole", "SELECT event_id FROM events WHERE json_extract(props, '$.none.k') IS NULL", "events")(lambda c: c.table("events").select("event_id").where_null("props->none->k"))


def _arrays(c: Any) -> Any:
    """Events with a JSON array of their props and type."""
    df = c._frames["events"].frame()
    k = F.get_json_object("props", "$.k").cast("int")
    tags = F.concat(F.lit('["'), F.col("event_type"), F.lit('",'), k.cast("string"), F.when(k % 2 == 0, F.lit(",true]")).otherwise(F.lit("]")))
    doc = F.when(k % 5 == 0, F.lit('{"a":1}')).otherwise(tags)
    return c.register("events", df.select("event_id", doc.alias("doc")), "event_id", ("doc",)).table("events").select("event_id")


_DOC = "WITH e AS (SELECT event_id, event_type, CAST(json_extract_string(props, '$.k') AS INT) AS k FROM events) SELECT event_id FROM e WHERE "
query("json_contains", _DOC + "k % 5 <> 0 AND event_type = 'click' AND k % 2 = 0", "events")(lambda c: _arrays(c).where_json_contains("doc", ["click", True]))
query("json_contains_number", _DOC + "k % 5 <> 0 AND k = 42", "events")(lambda c: _arrays(c).where_json_contains("doc", 42))
query("json_doesnt_contain", _DOC + "k % 5 <> 0 AND event_type <> 'view'", "events")(lambda c: _arrays(c).where_json_doesnt_contain("doc", "view"))
query("json_length", _DOC + "k % 5 <> 0 AND k % 2 = 0", "events")(lambda c: _arrays(c).where_json_length("doc", ">", 2))
query("json_array_column", "SELECT vec_id, label FROM embeddings WHERE len(embedding) = 64 AND label >= 3", "embeddings")(lambda c: c.table("embeddings").select("vec_id", "label").where_json_length("embedding", 64).where("label", ">=", 3))



def _mixed(c: Any) -> Any:
    """Events with JSON of every kind: by k modulo 7 a number, a text, a boolean, a plain array, another array, an object, nothing."""
    df = c._frames["events"].frame()
    k = F.get_json_object("props", "$.k").cast("int")

    def held(k: Any) -> Any:
        out = F.when(k % 7 == 0, (k - 50).cast("string")).when(k % 7 == 1, F.concat(F.lit('"'), k, F.lit('"'))).when(k % 7 == 2, F.when(k % 2 == 0, F.lit("true")).otherwise("false"))
        return out.when(k % 7 == 3, F.concat(F.lit("["), k, F.lit(',"x"]'))).when(k % 7 == 4, F.concat(F.lit("[true,"), k, F.lit("]"))).when(k % 7 == 5, F.when(k % 2 == 0, F.lit('{"a":1,"b":2}')).otherwise('{"b":2,"a":1}'))

    def doc(k: Any, held: Any) -> Any:
        swapped = F.when(held.startswith('{"a"'), F.lit('{"b":2,"a":1}')).when(held.startswith("{"), F.lit('{"a":1,"b":2}')).otherwise(held)
        other = F.when(F.col("event_id") % 2 == 0, swapped).otherwise(F.concat(F.lit("["), k + 1, F.lit(',"x"]')))
        return F.coalesce(F.concat(F.lit('{"v":'), held, F.lit(',"w":'), other, F.lit("}")), F.lit("{}"))

    docs = let(k, lambda k: let(held(k), lambda h: doc(k, h)))
    return c.register("mixed", df.select("event_id", "event_type", (k % 7).alias("m"), docs.alias("doc"), let(k, held).alias("held")), "event_id", ("doc", "held")).table("mixed")


_MIXED = """WITH e AS (SELECT event_id, event_type, CAST(json_extract_string(props, '$.k') AS INT) AS k FROM events), x AS (SELECT event_id, event_type, k, k % 7 AS m,
CASE k % 7 WHEN 0 THEN 1 WHEN 1 THEN 2 WHEN 3 THEN 3 WHEN 2 THEN 4 WHEN 4 THEN 5 WHEN 5 THEN 6 ELSE 0 END AS r, CASE k % 7 WHEN 0 THEN k - 50 WHEN 2 THEN (k + 1) % 2 WHEN 3 THEN k WHEN 4 THEN k END AS n,
CASE WHEN k % 7 = 1 THEN CAST(k AS VARCHAR) END AS t, CASE k % 7 WHEN 0 THEN CAST(k - 50 AS VARCHAR) WHEN 1 THEN '"' || k || '"' WHEN 2 THEN CASE WHEN k % 2 = 0 THEN 'true' ELSE 'false' END
WHEN 3 THEN '[' || k || ',"x"]' WHEN 4 THEN '[true,' || k || ']' WHEN 5 THEN '{"a":1,"b":2}' END AS j FROM e) """
query("json_order", "SELECT event_id FROM events ORDER BY CAST(json_extract_string(props, '$.k') AS INT) DESC, event_id LIMIT 30", "events")(lambda c: c.table("events").select("event_id").order_by("props->k", "desc").limit(30))
query("json_order_mixed", _MIXED + "(SELECT 'up' AS way, event_id FROM x ORDER BY r, n NULLS FIRST, t NULLS FIRST, event_id LIMIT 700 OFFSET 300) UNION ALL (SELECT 'down', event_id FROM x ORDER BY r DESC, n DESC NULLS LAST, t DESC NULLS LAST, event_id LIMIT 700 OFFSET 100)", "events")(
    lambda c: _mixed(c).select("event_id").order_by("doc->v").skip(300).limit(700).to_df().select(F.lit("up").alias("way"), "event_id").unionByName(_mixed(c).select("event_id").order_by("doc->v", "desc").skip(100).limit(700).to_df().select(F.lit("down").alias("way"), "event_id"))
)
query("json_distinct_ordered", _MIXED + "SELECT j AS v FROM (SELECT DISTINCT r, n, t, j FROM x) ORDER BY r DESC, n DESC NULLS LAST, t DESC NULLS LAST LIMIT 40", "events")(lambda c: _mixed(c).select("doc->v as v").distinct().order_by("doc->v", "desc").limit(40))
query("json_distinct_content", _MIXED + "SELECT DISTINCT j AS held FROM x", "events")(lambda c: _mixed(c).select("held").distinct())
query("group_json_content", _MIXED + "SELECT j AS held, count(*) AS n FROM x GROUP BY 1", "events")(lambda c: _mixed(c).group_by("held").aggregate({"n": {"count": "*"}}))
query("group_json_min_max", _MIXED + "SELECT event_type, CAST(min(n) FILTER (m = 0) AS VARCHAR) AS lo, '\"' || max(t) || '\"' AS hi FROM x GROUP BY 1", "events")(lambda c: _mixed(c).where_in("m", [0, 1, 6]).group_by("event_type").aggregate({"lo": {"min": "doc->v"}, "hi": {"max": "doc->v"}}))
query("json_by_kind", _MIXED + "SELECT event_id FROM x WHERE r > 1 OR n > 10", "events")(lambda c: _mixed(c).select("event_id").where("held", ">", 10))
query("json_structural", _MIXED + "SELECT event_id FROM x WHERE m <> 6 AND (event_id % 2 = 0 OR m IN (0, 1, 3))", "events")(lambda c: _mixed(c).select("event_id").where_column("doc->v", "doc->w").or_where_column("doc->v", "<", "doc->w"))
query("json_array_over_constant", _MIXED + "SELECT event_id FROM x WHERE m = 0 AND n > 10 OR m = 1 AND CAST(t AS INT) > 10 OR m = 3", "events")(lambda c: _mixed(c).select("event_id").where("doc->v", ">", 10))


@query("json_min_max", _MIXED + "SELECT CAST(min(n) FILTER (m = 0) AS BIGINT) AS low, max(t) AS top, true AS truth, (SELECT '[true, ' || max(k) || ']' FROM x WHERE m = 4) AS list, true AS none FROM x", "events")
def _json_min_max(c: Any) -> DataFrame:
    some = lambda *m: _mixed(c).where_in("m", list(m))
    return one(c, low=some(0, 1, 2, 3, 4, 5, 6).min("doc->v"), top=some(0, 1, 6).max("doc->v"), truth=some(0, 1, 2, 3).max("doc->v"), list=json.dumps(some(0, 2, 4).max("doc->v")), none=some(6).max("doc->v") is None).withColumn("low", F.col("low").cast("long"))


# --- projection, order, paging, distinct ---------------------------------------------------------------------------

query("select_alias", "SELECT o_orderkey AS id, o_totalprice AS price FROM orders", "orders")(lambda c: c.table("orders").select("o_orderkey as id", "orders.o_totalprice AS price"))
query("distinct", "SELECT DISTINCT o_orderstatus, o_orderpriority FROM orders", "orders")(lambda c: c.table("orders").select("o_orderstatus", "o_orderpriority").distinct())
query("distinct_ordered", "SELECT o_custkey FROM (SELECT o_custkey, max(o_totalprice) AS m FROM orders GROUP BY 1 ORDER BY m DESC, o_custkey LIMIT 20)", "orders")(lambda c: c.table("orders").select("o_custkey").distinct().order_by("o_totalprice", "desc").limit(20))
query("order_by", f"SELECT {ORDER} FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 50", "orders")(lambda c: orders(c).order_by("o_totalprice", "desc").limit(50))
_gappy("order_by_nulls", "true ORDER BY o_orderpriority ASC NULLS FIRST, o_orderkey LIMIT 40", lambda q: q.order_by("o_orderpriority").limit(40))
query("order_limit_offset", f"SELECT {ORDER} FROM orders ORDER BY o_custkey, o_totalprice DESC, o_orderkey LIMIT 25 OFFSET 100", "orders")(lambda c: orders(c).order_by("o_custkey").order_by("o_totalprice", "desc").skip(100).take(25))
query("latest", f"SELECT {ORDER} FROM orders ORDER BY o_orderdate DESC, o_orderkey LIMIT 10", "orders")(lambda c: orders(c).latest("o_orderdate").limit(10))
query("oldest_reordered", f"SELECT {ORDER} FROM orders ORDER BY o_orderdate, o_orderkey LIMIT 10", "orders")(lambda c: orders(c).in_random_order().reorder().oldest("o_orderdate").limit(-1).limit(10.7))
query("for_page", f"SELECT {ORDER} FROM orders ORDER BY o_orderkey LIMIT 20 OFFSET 40", "orders")(lambda c: orders(c).for_page(3, 20))

# --- aggregates ----------------------------------------------------------------------------------------------------


@query("count", "SELECT count(*) AS n FROM orders WHERE o_orderstatus = 'F'", "orders")
def _count(c: Any) -> DataFrame:
    return one(c, n=c.table("orders").where("o_orderstatus", "F").limit(3).count())


@query("count_distinct_rows", "SELECT count(*) AS n FROM (SELECT DISTINCT o_orderstatus, o_orderpriority FROM orders)", "orders")
def _count_distinct(c: Any) -> DataFrame:
    return one(c, n=c.table("orders").select("o_orderstatus", "o_orderpriority").distinct().count())


@query("sum", "SELECT CAST(sum(o_custkey) AS BIGINT) AS s, CAST(0 AS BIGINT) AS nothing, CAST((SELECT sum(DISTINCT o_custkey) FROM orders) AS BIGINT) AS d FROM orders", "orders")
def _sum(c: Any) -> DataFrame:
    t = c.table("orders")
    return one(c, s=t.sum("o_custkey"), nothing=c.table("orders").where("o_orderkey", "<", 0).sum("o_custkey"), d=c.table("orders").distinct().sum("o_custkey")).select(*[F.col(x).cast("long").alias(x) for x in ("s", "nothing", "d")])


@query("avg", "SELECT round(avg(o_totalprice), 4) AS a FROM orders", "orders")
def _avg(c: Any) -> DataFrame:
    return one(c, a=c.table("orders").avg("o_totalprice")).select(F.round("a", 4).alias("a"))


@query("min", "SELECT min(o_totalprice) AS m, min(o_orderpriority) AS p FROM orders", "orders")
def _min(c: Any) -> DataFrame:
    return one(c, m=c.table("orders").min("o_totalprice"), p=c.table("orders").min("o_orderpriority"))


@query("max", "SELECT max(o_orderkey) AS m, max(o_orderdate) AS d FROM orders", "orders")
def _max(c: Any) -> DataFrame:
    return one(c, m=c.table("orders").max("o_orderkey"), d=c.table("orders").max("o_orderdate")).select(F.col("m").cast("long").alias("m"), F.col("d"))


@query("exists", "SELECT true AS some, true AS none", "orders")
def _exists(c: Any) -> DataFrame:
    return one(c, some=c.table("orders").where("o_orderkey", ">", 5).exists(), none=c.table("orders").where("o_orderkey", "<", 0).doesnt_exist())


PRICING = {"n": {"count": "*"}, "qty": {"sum": "l_quantity"}, "low": {"min": "l_discount"}, "high": {"max": "l_tax"}, "disc": {"avg": "l_discount"}}
_PRICING = "SELECT l_returnflag, l_linestatus, count(*) AS n, sum(l_quantity) AS qty, min(l_discount) AS low, max(l_tax) AS high, round(avg(l_discount), 8) AS disc FROM lineitem GROUP BY 1, 2"
query("group_count", "SELECT event_type, count(*) AS n FROM events GROUP BY 1", "events")(lambda c: c.table("events").group_by("event_type").aggregate({"n": {"count": "*"}}))
query("group_multi_agg", _PRICING, "lineitem")(lambda c: c.table("lineitem").group_by("l_returnflag", "l_linestatus").aggregate(PRICING).to_df().withColumn("disc", F.round("disc", 8)))
query("group_having", "SELECT o_custkey, count(*) AS n, max(o_totalprice) AS top FROM orders GROUP BY 1 HAVING count(*) >= 15 OR max(o_totalprice) > 495000", "orders")(
    lambda c: c.table("orders").group_by("o_custkey").aggregate({"n": {"count": "*"}, "top": {"max": "o_totalprice"}}).having("n", ">=", 15).or_having("top", ">", 495000)
)
query("group_order_limit", "SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1 ORDER BY n DESC, o_custkey LIMIT 10 OFFSET 5", "orders")(
    lambda c: c.table("orders").group_by("o_custkey").aggregate({"n": {"count": "*"}}).order_by("n", "desc").limit(10).offset(5)
)
query("group_distinct", "SELECT DISTINCT o_orderstatus, o_orderpriority FROM orders", "orders")(lambda c: c.table("orders").group_by("o_orderstatus", "o_orderpriority"))
query("group_nothing", "SELECT count(*) AS n FROM orders HAVING count(*) > 0", "orders")(lambda c: c.table("orders").group_by().aggregate({"n": {"count": "*"}}))
query("group_nothing_empty", "SELECT 1 AS n WHERE false", "orders")(lambda c: c.table("orders").where("o_orderkey", "<", 0).group_by().aggregate({"n": {"count": "*"}}).to_df().select(F.col("n").cast("int").alias("n")))
query("group_json_path", "SELECT json_extract(props, '$.k')::VARCHAR AS k, count(*) AS n FROM events GROUP BY 1", "events")(lambda c: c.table("events").group_by("props->k").aggregate({"n": {"count": "*"}}))
query("group_count_column", "SELECT o_orderstatus, count(CASE WHEN o_orderstatus <> 'P' THEN o_orderpriority END) AS n FROM orders GROUP BY 1", "orders")(lambda c: gappy_group(c))


def gappy_group(c: Any) -> Any:
    df = c._frames["orders"].frame()
    c.register("orders", df.withColumn("o_orderpriority", F.when(F.col("o_orderstatus") != "P", F.col("o_orderpriority"))), "o_orderkey")
    return c.table("orders").group_by("o_orderstatus").aggregate({"n": {"count": "o_orderpriority"}})


# --- joins ---------------------------------------------------------------------------------------------------------

query("inner_join", "SELECT o_orderkey, c_name, o_totalprice FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_totalprice > 300000", "orders", "customer")(
    lambda c: c.table("orders").join("customer", "orders.o_custkey", "=", "customer.c_custkey").where("o_totalprice", ">", 300000).select("o_orderkey", "c_name", "orders.o_totalprice")
)
query("left_join", "SELECT c_custkey, o_orderkey FROM customer LEFT JOIN orders ON o_custkey = c_custkey", "orders", "customer")(lambda c: c.table("customer").left_join("orders", "orders.o_custkey", "customer.c_custkey").select("c_custkey", "o_orderkey"))
query("right_join", "SELECT o_orderkey, c_custkey, c_mktsegment FROM orders RIGHT JOIN customer ON o_custkey = c_custkey", "orders", "customer")(
    lambda c: c.table("orders").right_join("customer", "orders.o_custkey", "customer.c_custkey").select("o_orderkey", "c_custkey", "c_mktsegment")
)
query("cross_join", "SELECT r_name, n_name FROM region CROSS JOIN nation", "region", "nation")(lambda c: c.table("region").cross_join("nation").select("r_name", "n_name"))
query("join_theta", "SELECT r_name, n_name FROM region JOIN nation ON r_regionkey < n_regionkey", "region", "nation")(lambda c: c.table("region").join("nation", "region.r_regionkey", "<", "nation.n_regionkey").select("r_name", "n_name"))
query("join_or_on", "SELECT r_name, n_name FROM region JOIN nation ON r_regionkey = n_regionkey OR r_regionkey = n_nationkey", "region", "nation")(
    lambda c: c.table("region").join("nation", lambda j: j.on("region.r_regionkey", "nation.n_regionkey").or_on("region.r_regionkey", "=", "nation.n_nationkey")).select("r_name", "n_name")
)
query("join_residual", "SELECT o_orderkey, c_custkey FROM orders JOIN customer ON o_custkey = c_custkey AND o_totalprice < c_acctbal", "orders", "customer")(
    lambda c: c.table("orders").join("customer", lambda j: j.on("orders.o_custkey", "customer.c_custkey").on("orders.o_totalprice", "<", "customer.c_acctbal")).select("o_orderkey", "c_custkey")
)
_CHAIN = "FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey"


def chain(c: Any) -> Builder:
    t = c.table("lineitem").join("orders", "lineitem.l_orderkey", "orders.o_orderkey").join("customer", "orders.o_custkey", "customer.c_custkey")
    return t.join("nation", "customer.c_nationkey", "nation.n_nationkey").join("region", "nation.n_regionkey", "region.r_regionkey")


def big_orders(c: Any) -> Any:
    return c.register("orders", c.table("orders").where("o_totalprice", ">", 300000).to_df(), "o_orderkey")


FIVE = ("lineitem", "orders", "customer", "nation", "region")
query("join_multi", f"SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, n_name, r_name {_CHAIN} WHERE r_name = 'ASIA' AND l_quantity > 45", *FIVE)(
    lambda c: chain(c).where("r_name", "ASIA").where("l_quantity", ">", 45).select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "n_name", "r_name")
)
query("join_group", f"SELECT n_name, count(*) AS n, CAST(sum(l_quantity) AS DOUBLE) AS qty {_CHAIN} GROUP BY 1", *FIVE)(lambda c: chain(c).group_by("nation.n_name").aggregate({"n": {"count": "*"}, "qty": {"sum": "l_quantity"}}))
query("anti_join_idiom", "SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 300000)", "orders", "customer")(
    lambda c: big_orders(c).table("customer").left_join("orders", "orders.o_custkey", "customer.c_custkey").where_null("orders.o_orderkey").select("c_custkey")
)
query("join_distinct", "SELECT DISTINCT c_mktsegment, o_orderstatus FROM orders JOIN customer ON o_custkey = c_custkey", "orders", "customer")(
    lambda c: c.table("orders").join("customer", "orders.o_custkey", "customer.c_custkey").select("c_mktsegment", "o_orderstatus").distinct()
)


@query("join_collision", "SELECT n_nationkey, r_name AS name, r_regionkey AS id FROM nation LEFT JOIN region ON n_regionkey = r_regionkey AND r_regionkey < 3", "nation", "region")
def _collision(c: Any) -> Any:
    """Both tables have ``name`` and ``id``; the later one's stand, null where nothing matched."""
    nation, region = c._frames["nation"].frame(), c._frames["region"].frame()
    c.register("nation", nation.select("n_nationkey", F.col("n_name").alias("name"), F.col("n_regionkey").alias("id")), "n_nationkey")
    c.register("region", region.where("r_regionkey < 3").select(F.col("r_name").alias("name"), F.col("r_regionkey").alias("id")), "id")
    return c.table("nation").left_join("region", "nation.id", "region.id")


@query("join_loose_keys", "SELECT o_orderkey, c_name FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_orderkey < 500", "orders", "customer")
def _loose(c: Any) -> Any:
    c.register("customer", c._frames["customer"].frame().withColumn("c_custkey", F.col("c_custkey").cast("string")), "c_custkey")
    return c.table("orders").join("customer", "orders.o_custkey", "customer.c_custkey").where("o_orderkey", "<", 500).select("o_orderkey", "c_name")


@query("join_loose_keys_whole", "SELECT o_orderkey, c_name FROM orders JOIN customer ON o_custkey = c_custkey", "orders", "customer")
def _loose_whole(c: Any) -> Any:
    c.register("customer", c._frames["customer"].frame().withColumn("c_custkey", F.col("c_custkey").cast("string")), "c_custkey")
    return c.table("orders").join("customer", "orders.o_custkey", "customer.c_custkey").select("o_orderkey", "c_name")


# --- terminals -----------------------------------------------------------------------------------------------------


@query("terminals", "SELECT 2 AS second, 'F' AS status, 15 AS page_rows, CAST((SELECT ceil(count(*) / 15.0) FROM orders) AS BIGINT) AS last_page, 'key' AS plan, CAST((SELECT count(*) FROM orders WHERE o_orderkey <= 95) AS BIGINT) AS seen", "orders")
def _terminals(c: Any) -> DataFrame:
    t = lambda: c.table("orders")
    second = t().order_by("o_orderkey").offset(t().where("o_orderkey", "<", 2).count()).first()["o_orderkey"]
    page, seen = t().paginate(2), []
    t().where("o_orderkey", "<=", 95).chunk(40, lambda rows, _: seen.extend(rows))
    status = t().select("o_orderstatus as status").where("o_orderstatus", "F").value("status")
    out = one(c, second=second, status=status, page_rows=len(page["data"]), last_page=page["last_page"], plan=t().where("o_orderkey", 5).explain(), seen=len(seen))
    return out.withColumns({x: F.col(x).cast("long") for x in ("last_page", "seen")})


@query("pluck", "SELECT r_name AS value, CAST(r_regionkey AS VARCHAR) AS key FROM region", "region")
def _pluck(c: Any) -> DataFrame:
    there = c.table("region").pluck("r_name", "r_regionkey")
    return c.spark.createDataFrame([(v, k) for k, v in there.items()], "value string, key string")


query("keys_only", "SELECT o_orderkey FROM orders WHERE o_orderkey >= 100", "orders")(lambda c: c.table("orders").where("o_orderkey", ">=", 100).select("o_orderkey"))
query("own_table", f"SELECT {ORDER} FROM orders WHERE o_custkey = 10", "orders")(lambda c: c.table("orders").select(*[f"orders.{x}" for x in COLS]).where("orders.o_custkey", 10))
query("where_array", f"SELECT {ORDER} FROM orders WHERE o_custkey = 10 OR o_orderstatus = 'P'", "orders")(lambda c: orders(c).where("o_custkey", [[], {"a": 10}, 20]).or_where("o_orderstatus", {"a": ["P", "F"]}))
query("where_date_alias", f"SELECT {ORDER} FROM orders WHERE o_orderdate >= TIMESTAMP '1996-03-01' AND o_orderdate < TIMESTAMP '1996-03-02'", "orders", timezone="Etc/UTC")(lambda c: orders(c).where_date("o_orderdate", "1996-03-01T05:00:00+00:00"))
query("in_random_order", f"SELECT {ORDER} FROM orders", "orders")(lambda c: orders(c).in_random_order())
query("when_unless_tap", f"SELECT {ORDER} FROM orders WHERE o_custkey = 10", "orders")(lambda c: orders(c).when(10, lambda q, v: q.where("o_custkey", v)).unless(True, lambda q, _: q.where("o_orderkey", 0)).tap(lambda q: q.clone().where("o_orderkey", 0)))
query("group_named", "SELECT c_mktsegment, o_orderstatus AS status, count(*) AS n FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1, 2", "orders", "customer")(
    lambda c: c.table("orders").join("customer", "orders.o_custkey", "customer.c_custkey").select("orders.o_orderstatus as status").group_by("customer.c_mktsegment", "status").aggregate({"n": {"count": "*"}})
)


@query("find", "SELECT (SELECT c_name FROM customer WHERE c_custkey = 7) AS found, true AS missing, true AS unmatched, (SELECT n_name FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE c_custkey = 7) AS joined, true AS failed", "customer", "nation")
def _find(c: Any) -> DataFrame:
    t = lambda: c.table("customer")
    joined = t().join("nation", "customer.c_nationkey", "nation.n_nationkey").find("7")
    return one(c, found=t().find("7")["c_name"], missing=t().find(-7) is None, unmatched=t().where("c_custkey", "<", 7).find(7) is None, joined=joined["n_name"], failed=raises(RecordsNotFoundException, lambda: t().find_or_fail(-7)))


def raises(error: type[Exception], call: Callable[[], Any]) -> bool:
    try:
        call()
    except error:
        return True
    return False


@query("sole_and_first", "SELECT (SELECT r_name FROM region WHERE r_regionkey = 2) AS sole, (SELECT r_name FROM region ORDER BY r_regionkey LIMIT 1) AS first, true AS many, true AS none, true AS no_first", "region")
def _sole(c: Any) -> DataFrame:
    t = lambda: c.table("region")
    none = lambda: t().where("r_regionkey", 99)
    return one(
        c, sole=t().where("r_regionkey", 2).sole()["r_name"], first=t().first_or_fail()["r_name"], many=raises(MultipleRecordsFoundException, t().sole), none=raises(RecordsNotFoundException, none().sole),
        no_first=none().first() is None and raises(RecordsNotFoundException, none().first_or_fail),
    )


@query("pluck_list", "SELECT row_number() OVER (ORDER BY c_acctbal DESC, c_custkey) - 1 AS place, c_name AS name FROM customer ORDER BY 1 LIMIT 30", "customer")
def _pluck_list(c: Any) -> DataFrame:
    return c.spark.createDataFrame(list(enumerate(c.table("customer").order_by("c_acctbal", "desc").limit(30).pluck("c_name"))), "place long, name string")


@query("lazy_and_each", "SELECT CAST(count(*) AS BIGINT) AS seen, CAST(sum(n_nationkey) AS BIGINT) AS total, CAST(10 AS BIGINT) AS stopped FROM nation", "nation")
def _lazy(c: Any) -> DataFrame:
    keys = [r["n_nationkey"] for r in c.table("nation").lazy(7)]
    seen: list[int] = []
    c.table("nation").each(lambda row, i: seen.append(i) or i < 9)
    return one(c, seen=len(keys), total=sum(keys), stopped=len(seen)).select(*[F.col(x).cast("long").alias(x) for x in ("seen", "total", "stopped")])


@query("group_terminals", "SELECT CAST(count(*) AS BIGINT) AS groups, CAST((SELECT n FROM (SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1 ORDER BY n DESC, o_custkey LIMIT 1)) AS BIGINT) AS most FROM (SELECT o_custkey FROM orders GROUP BY 1 HAVING count(*) >= 15)", "orders")
def _group_terminals(c: Any) -> DataFrame:
    g = lambda: c.table("orders").group_by("o_custkey").aggregate({"n": {"count": "*"}})
    rows = g().having("n", ">=", 15).get()
    assert len(rows) == g().having("n", ">=", 15).count()
    return one(c, groups=len(rows), most=g().order_by("n", "desc").first()["n"]).select(*[F.col(x).cast("long").alias(x) for x in ("groups", "most")])


# --- writes: a stored copy of a small table, and what it holds afterwards -------------------------------------------


class Tables(Migration):
    """Stored tables shaped like the driver's."""

    schema: SchemaBuilder

    def up(self) -> None:
        self.schema.create("region", lambda t: (t.integer("r_regionkey").primary(), t.string("r_name")))
        self.schema.create("nation", lambda t: (t.integer("n_nationkey").primary(), t.string("n_name").unique(), t.integer("n_regionkey")))
        self.schema.create("customer", lambda t: (t.integer("c_custkey").primary(), t.string("c_name"), t.integer("c_nationkey"), t.float("c_acctbal").nullable(), t.string("c_mktsegment").index()))


def stored(spark: SparkSession, sf_dir: str, *tables: str) -> Any:
    """A new database with copies of some tables, written by Spark and not through the driver."""
    from ..sources.store import schema_from_json
    from . import scratch

    manager = DatabaseManager().configure({"connections": {"main": {"path": f"{scratch.root(spark)}/{uuid.uuid4().hex}"}}})
    c = manager.connection()
    migration = Tables()
    migration.schema = SchemaBuilder(c)
    with c._as_migration():
        migration.up()
    from ..schema.enforcer import struct

    for t in tables:
        entry = c._catalog()["tables"][t]
        fields = struct(schema_from_json(entry["schema"])).fields
        df = spark.read.parquet(f"{sf_dir}/{t}.parquet").select(*[F.col(f.name).cast(f.dataType) for f in fields])
        c._change(t, {**entry, "segments": [c._store.write(t, df)]})
    return c


def write(name: str, sql: str, table: str) -> Callable[[Callable[[Any], Any]], Any]:
    def add(act: Callable[[Any], Any]) -> Any:
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            c = stored(spark, sf_dir, table)
            act(c.table(table))
            return c.table(table).to_df()

        QUERIES[name] = run
        ORACLES[name] = sql
        return act

    return add


_REGION = "SELECT CAST(r_regionkey AS BIGINT) AS r_regionkey, r_name FROM region"
_NATION = "SELECT CAST(n_nationkey AS BIGINT) AS n_nationkey, n_name, CAST(n_regionkey AS BIGINT) AS n_regionkey FROM nation"
_CUSTOMER = "SELECT CAST(c_custkey AS BIGINT) AS c_custkey, c_name, CAST(c_nationkey AS BIGINT) AS c_nationkey, {bal} AS c_acctbal, {seg} AS c_mktsegment FROM customer"
write("insert", f"{_REGION} UNION ALL SELECT 100, 'ATLANTIS' UNION ALL SELECT 101, '7'", "region")(lambda t: t.insert([{"r_regionkey": "100", "r_name": "ATLANTIS"}, {"r_regionkey": 101, "r_name": 7}]))
write("insert_or_ignore", f"{_REGION} UNION ALL SELECT 100, 'ATLANTIS'", "region")(lambda t: t.insert_or_ignore([{"r_regionkey": 1, "r_name": "AGAIN"}, {"r_regionkey": 100, "r_name": "ATLANTIS"}, {"r_regionkey": 100, "r_name": "TWICE"}]))
write("update", _CUSTOMER.format(bal="CASE WHEN c_acctbal < 0 THEN 0.0 ELSE c_acctbal END", seg="CASE WHEN c_acctbal < 0 THEN 'DEBTOR' ELSE c_mktsegment END"), "customer")(lambda t: t.where("c_acctbal", "<", 0).update({"c_acctbal": "0", "c_mktsegment": "DEBTOR"}))
write("update_limited", _CUSTOMER.format(bal="c_acctbal", seg="CASE WHEN c_custkey IN (SELECT c_custkey FROM customer ORDER BY c_acctbal DESC, c_custkey LIMIT 10) THEN 'TOP' ELSE c_mktsegment END"), "customer")(
    lambda t: t.order_by("c_acctbal", "desc").limit(10).update({"c_mktsegment": "TOP"})
)
write("increment", _CUSTOMER.format(bal="CASE WHEN c_nationkey = 3 THEN c_acctbal + 100 ELSE c_acctbal END", seg="c_mktsegment"), "customer")(lambda t: t.where("c_nationkey", 3).increment("c_acctbal", 100))
write("decrement", _CUSTOMER.format(bal="CASE WHEN c_custkey <= 5 THEN c_acctbal - 0.5 ELSE c_acctbal END", seg="CASE WHEN c_custkey <= 5 THEN 'CUT' ELSE c_mktsegment END"), "customer")(lambda t: t.where("c_custkey", "<=", 5).decrement("c_acctbal", 0.5, {"c_mktsegment": "CUT"}))
write("delete", _CUSTOMER.format(bal="c_acctbal", seg="c_mktsegment") + " WHERE NOT (c_mktsegment = 'BUILDING' AND c_acctbal > 0)", "customer")(lambda t: t.where("c_mktsegment", "BUILDING").where("c_acctbal", ">", 0).delete())
write("truncate", f"{_REGION} WHERE false", "region")(lambda t: t.where("r_regionkey", 1).truncate())
write("upsert", f"{_NATION} WHERE n_nationkey NOT IN (3, 4) UNION ALL SELECT CAST(n_nationkey AS BIGINT), n_name, 9 FROM nation WHERE n_nationkey = 3 UNION ALL SELECT 4, n_name, 8 FROM nation WHERE n_nationkey = 4 UNION ALL SELECT 200, 'NOWHERE', 2", "nation")(
    lambda t: t.upsert([{"n_nationkey": 3, "n_name": "x3", "n_regionkey": 9}, {"n_nationkey": 4, "n_name": "x4", "n_regionkey": 7}, {"n_nationkey": 200, "n_name": "NOWHERE", "n_regionkey": 1}, {"n_nationkey": 4, "n_name": "y4", "n_regionkey": 8}, {"n_nationkey": 200, "n_name": "z", "n_regionkey": 2}], "n_nationkey", ["n_regionkey"])
)
write("update_or_insert", f"{_REGION} WHERE r_regionkey <> 2 UNION ALL SELECT 2, 'CHANGED' UNION ALL SELECT 50, 'NEW'", "region")(lambda t: (t.clone().update_or_insert({"r_regionkey": 2}, {"r_name": "CHANGED"}), t.clone().update_or_insert({"r_regionkey": 50}, lambda there: {"r_name": "OLD" if there else "NEW"})))


def _joined_update(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = stored(spark, sf_dir, "nation", "region")
    c.table("nation").join("region", "nation.n_regionkey", "region.r_regionkey").where("r_name", "ASIA").update({"n_regionkey": 77})
    return c.table("nation").to_df()


QUERIES["update_joined"] = _joined_update
ORACLES["update_joined"] = "SELECT CAST(n_nationkey AS BIGINT) AS n_nationkey, n_name, CAST(CASE WHEN r_name = 'ASIA' THEN 77 ELSE n_regionkey END AS BIGINT) AS n_regionkey FROM nation LEFT JOIN region ON n_regionkey = r_regionkey"


def _transaction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One transaction commits; another fails and leaves no trace."""
    c = stored(spark, sf_dir, "region")
    c.transaction(lambda tx: (tx.table("region").where("r_regionkey", 1).delete(), tx.table("region").insert({"r_regionkey": 60, "r_name": "KEPT"})))

    def fails(tx: Any) -> None:
        tx.table("region").delete()
        raise RuntimeError("on purpose")

    try:
        c.transaction(fails)
    except RuntimeError:
        pass
    return c.table("region").to_df()


QUERIES["transaction"] = _transaction
ORACLES["transaction"] = f"{_REGION} WHERE r_regionkey <> 1 UNION ALL SELECT 60, 'KEPT'"


def _altered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A migration that renames, drops, adds and fills columns."""
    c = stored(spark, sf_dir, "customer")
    schema = SchemaBuilder(c)
    with c._as_migration():
        schema.table("customer", lambda t: (t.rename_column("c_name", "name"), t.drop_column("c_nationkey"), t.string("level").default("basic"), t.integer("score").nullable()))
        schema.rename("customer", "client")
    return c.table("client").to_df()


QUERIES["schema_change"] = _altered
ORACLES["schema_change"] = "SELECT CAST(c_custkey AS BIGINT) AS c_custkey, c_name AS name, c_acctbal, c_mktsegment, 'basic' AS level, CAST(NULL AS BIGINT) AS score FROM customer"


def _coerced(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts outside an enumeration become null where the connection is loose."""
    c = stored(spark, sf_dir, "customer")
    c.strict = False
    schema = SchemaBuilder(c)
    with c._as_migration():
        schema.create("tiers", lambda t: (t.integer("c_custkey").primary(), t.enum("tier", ["BUILDING", "MACHINERY"]).nullable()))
        entry = c._catalog()["tables"]["tiers"]
        df = c._store.frame(c._catalog()["tables"]["customer"]).select("c_custkey", F.col("c_mktsegment").alias("tier"))
        c._change("tiers", {**entry, "segments": [c._store.write("tiers", df)]})
        schema.coerce("tiers")
    return c.table("tiers").to_df()


QUERIES["coerce"] = _coerced
ORACLES["coerce"] = "SELECT CAST(c_custkey AS BIGINT) AS c_custkey, CASE WHEN c_mktsegment IN ('BUILDING', 'MACHINERY') THEN c_mktsegment END AS tier FROM customer"


def _kept(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Writes that a unique index refuses leave the table as it was, and the error names the index."""
    c = stored(spark, sf_dir, "nation")
    t = lambda: c.table("nation")
    name = t().find(3)["n_name"]
    refused = []
    for act in (lambda: t().insert({"n_nationkey": 90, "n_name": name, "n_regionkey": 0}), lambda: t().insert({"n_nationkey": 3, "n_name": name, "n_regionkey": 0}), lambda: t().where("n_nationkey", 4).update({"n_name": name})):
        try:
            act()
        except UniqueConstraintViolationException as e:
            refused.append(str(e))
    key, unique = "n_nationkey", "nation_n_name_unique"
    right = [unique in refused[0], key in refused[1] and unique not in refused[1], unique in refused[2]]
    return t().to_df().withColumns({f"refused{i}": F.lit(x) for i, x in enumerate(right)})


QUERIES["unique_named"] = _kept
ORACLES["unique_named"] = _NATION.replace(" FROM", ", true AS refused0, true AS refused1, true AS refused2 FROM")


def _frame_insert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A DataFrame of new rows, one of which an index ignores; keys are made where the table makes them."""
    c = stored(spark, sf_dir, "nation")
    more = spark.read.parquet(f"{sf_dir}/region.parquet").select((F.col("r_regionkey") + 500).cast("string").alias("n_nationkey"), F.col("r_name").alias("n_name"), F.col("r_regionkey").alias("n_regionkey"))
    c.table("nation").insert(more)
    c.table("nation").insert_or_ignore(more.withColumn("n_nationkey", F.col("n_nationkey") + 100))
    return c.table("nation").to_df()


QUERIES["insert_frame"] = _frame_insert
ORACLES["insert_frame"] = f"{_NATION} UNION ALL SELECT r_regionkey + 500, r_name, r_regionkey FROM region"


def _life(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Migrations that run once, seeds, made keys, events, the log of queries, schemas, refusals and starting afresh."""

    class MakeNotes(Migration):
        schema: SchemaBuilder

        def up(self) -> None:
            SchemaBuilder(manager.connection()).create("notes", lambda t: (t.id(), t.string("title").unique(), t.integer("stars").default(1), t.timestamps()))

    class Notes(Seeder):
        def run(self) -> None:
            manager.table("notes").insert({"title": "seeded"})

    from . import scratch

    manager = DatabaseManager().configure({"connections": {"main": {"path": f"{scratch.root(spark)}/{uuid.uuid4().hex}", "migrations": [MakeNotes], "seeders": [Notes]}}})
    c = manager.connection()
    heard: list[str] = []
    for key in ("migration-ended", "seeder-ended", "no-pending-migrations", "seeding-ended"):
        manager.listen(key, lambda e: heard.append(e.key))
    first = c.migrate()
    again = c.migrate()
    made = c.table("notes").insert_get_id({"title": "one"})
    manager.enable_query_log()
    c.table("notes").where("id", 1).get()
    manager.disable_query_log()
    columns = ",".join(x.name for x in c.get_columns("notes"))
    indexes = ",".join(x.name for x in c.get_indexes("notes"))
    refused = raises(SchemaException, lambda: SchemaBuilder(c).create("late", lambda t: t.id()))
    usage = c.estimate()["usage"] > 0 and c.persist()
    other = DatabaseManager().configure({"connections": {"main": {"path": c._root}}}).connection()
    stale = other._catalog()
    c.table("notes").where("id", 1).update({"stars": 5})
    blocked = raises(DatabaseBlockedException, lambda: other._commit(stale))
    stars = c.table("notes").value("stars")
    manager.fresh(seed=True)
    return spark.createDataFrame([(
        ",".join(first), len(again), made, columns, indexes, manager.get_query_log()[0]["plan"], refused, usage, blocked, stars, c.table("notes").value("title"), {"migration-ended", "seeder-ended", "no-pending-migrations", "seeding-ended"} <= set(heard),
        [(x["migration"], x["ran"]) for x in c.status()] == [("make_notes", True)],
    )], "ran string, again long, made long, columns string, indexes string, plan string, refused boolean, usage boolean, blocked boolean, stars long, seeded string, heard boolean, status boolean")


QUERIES["database_life"] = _life
ORACLES["database_life"] = "SELECT 'make_notes' AS ran, CAST(0 AS BIGINT) AS again, CAST(1 AS BIGINT) AS made, 'id,title,stars,created_at,updated_at' AS columns, 'notes_title_unique' AS indexes, 'key' AS plan, true AS refused, true AS usage, true AS blocked, CAST(5 AS BIGINT) AS stars, 'seeded' AS seeded, true AS heard, true AS status"


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shipments by flag and status, with a filter on their date."""
    c = opened(spark, sf_dir, ("lineitem",))
    return c.table("lineitem").where_date("l_shipdate", "<=", "1998-09-02").group_by("l_returnflag", "l_linestatus").aggregate(PRICING).order_by("l_returnflag").to_df().withColumn("disc", F.round("disc", 8))


QUERIES["flagship"] = flagship
ORACLES["flagship"] = _PRICING.replace("GROUP BY", "WHERE l_shipdate < TIMESTAMP '1998-09-03' GROUP BY")
