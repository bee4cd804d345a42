"""The engine's operators as queries over the given tables, each with the SQL that must give the same rows."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .engine import Engine
from .operators.query import Query
from .sources.records import RecordStore
from .types import Column, DataType

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events")
INDEXES = (("orders_key", "orders", "o_orderkey"), ("orders_cust", "orders", "o_custkey"), ("events_user", "events", "user_id"),
           ("flags_key", "flags", "id"))

#: Events with a boolean and a nullable text, which the given tables lack.
FLAGS_SQL = """(SELECT event_id AS id, user_id, event_id % 2 = 0 AS active, NULLIF(event_type, 'view') AS note,
 CASE WHEN event_id % 7 = 0 THEN NULL ELSE user_id END AS score FROM events)"""


def engine_of(spark: SparkSession, sf_dir: str, sql: str | None = None) -> Engine:
    """The given tables, or only those that a statement names, so that no other file's footer is read."""
    e = Engine(spark)
    for t in TABLES:
        if sql is None or f" {t}" in sql:
            e.register(t, f"{sf_dir}/{t}.parquet")
    if sql is not None and " flags" not in sql:
        for i in INDEXES:
            if e.catalog.find_table(i[1]):
                e.register_index(*i)
        return e
    ev = spark.read.parquet(f"{sf_dir}/events.parquet")
    e.register_frame("flags", ev.select(
        F.col("event_id").alias("id"), "user_id", (F.col("event_id") % 2 == 0).alias("active"), F.nullif("event_type", F.lit("view")).alias("note"),
        F.when(F.col("event_id") % 7 == 0, F.lit(None)).otherwise(F.col("user_id")).alias("score")), ["id"])
    for i in INDEXES:
        if e.catalog.find_table(i[1]):
            e.register_index(*i)
    return e


#: name -> the engine's statement, which DuckDB also understands (NULLS LAST is added for it, FLAGS_SQL stands for flags).
SELECTS = {
    "scan_all": "SELECT * FROM customer",
    "project_reorder": "SELECT c_mktsegment, c_custkey, c_name FROM customer",
    "filter_int_eq": "SELECT o_orderkey, o_custkey FROM orders WHERE o_custkey = 100",
    "filter_int_ne": "SELECT c_custkey, c_nationkey FROM customer WHERE c_nationkey != 5",
    "filter_int_lt": "SELECT p_partkey, p_size FROM part WHERE p_size < 10",
    "filter_int_le": "SELECT p_partkey, p_size FROM part WHERE p_size <= 10",
    "filter_int_gt": "SELECT p_partkey, p_size FROM part WHERE p_size > 40",
    "filter_int_ge": "SELECT p_partkey, p_size FROM part WHERE p_size >= 40",
    "filter_text_eq": "SELECT o_orderkey, o_orderstatus FROM orders WHERE o_orderstatus = 'F'",
    "filter_text_ne": "SELECT o_orderkey, o_orderstatus FROM orders WHERE o_orderstatus <> 'F'",
    "filter_text_lt": "SELECT c_custkey, c_mktsegment FROM customer WHERE c_mktsegment < 'FURNITURE'",
    "filter_text_le": "SELECT c_custkey, c_mktsegment FROM customer WHERE c_mktsegment <= 'FURNITURE'",
    "filter_text_gt": "SELECT c_custkey, c_mktsegment FROM customer WHERE c_mktsegment > 'FURNITURE'",
    "filter_text_ge": "SELECT c_custkey, c_mktsegment FROM customer WHERE c_mktsegment >= 'FURNITURE'",
    "filter_bool_eq": "SELECT id, active FROM flags WHERE active = TRUE",
    "filter_bool_ne": "SELECT id, active FROM flags WHERE active != TRUE",
    "is_null": "SELECT id, note FROM flags WHERE note IS NULL",
    "is_not_null": "SELECT id, note FROM flags WHERE note IS NOT NULL",
    "eq_null_empty": "SELECT id, note FROM flags WHERE note = NULL",
    "conjunction": "SELECT l_orderkey, l_linenumber, l_returnflag FROM lineitem WHERE l_linenumber >= 2 AND l_linenumber < 5 AND l_returnflag = 'R'",
    "order_int_asc": "SELECT o_orderkey, o_custkey FROM orders ORDER BY o_custkey",
    "order_int_desc": "SELECT o_orderkey, o_custkey FROM orders ORDER BY o_custkey DESC",
    "order_text": "SELECT p_partkey, p_brand FROM part ORDER BY p_brand ASC",
    "order_nulls_last_asc": "SELECT id, score FROM flags ORDER BY score",
    "order_nulls_last_desc": "SELECT id, score FROM flags ORDER BY score DESC",
    "order_unprojected": "SELECT c_name FROM customer ORDER BY c_custkey DESC LIMIT 25",
    "topk_asc": "SELECT event_id, user_id, event_type FROM events ORDER BY event_id LIMIT 100",
    "topk_desc": "SELECT o_orderkey, o_custkey FROM orders WHERE o_custkey >= 100 AND o_orderstatus = 'F' ORDER BY o_orderkey DESC LIMIT 10",
    "limit_zero": "SELECT o_orderkey FROM orders LIMIT 0",
    "index_lookup": "SELECT o_orderkey, o_custkey, o_orderpriority FROM orders WHERE o_orderkey = 1000",
    "index_range": "SELECT o_orderkey, o_custkey FROM orders WHERE o_orderkey > 500 AND o_orderkey <= 900",
    "index_range_desc_topk": "SELECT o_orderkey, o_custkey FROM orders WHERE o_orderkey >= 500 ORDER BY o_orderkey DESC LIMIT 7",
    "index_residual": "SELECT o_orderkey, o_orderstatus FROM orders WHERE o_custkey >= 200 AND o_custkey < 260 AND o_orderstatus = 'O'",
    "contradiction_empty": "SELECT o_orderkey FROM orders WHERE o_orderkey >= 8 AND o_orderkey <= 7",
    "strict_overflow_empty": "SELECT o_orderkey FROM orders WHERE o_orderkey > 9223372036854775807",
    "lookup_contradiction": "SELECT o_orderkey FROM orders WHERE o_orderkey = 7 AND o_orderkey = 8",
    "multi_index_choice": "SELECT o_orderkey, o_custkey FROM orders WHERE o_custkey >= 10 AND o_custkey <= 90 AND o_orderkey >= 100",
    "bench_filter": "SELECT id, note FROM flags WHERE active = TRUE",
    "bench_lookup": "SELECT event_id, user_id, value FROM events WHERE user_id = 42",
}

EXPLAINS = {
    "explain_lookup": "EXPLAIN SELECT * FROM orders WHERE o_orderkey = 7",
    "explain_range": "EXPLAIN SELECT * FROM orders WHERE o_orderkey > 7 ORDER BY o_orderkey DESC LIMIT 3",
    "explain_scan": "EXPLAIN SELECT * FROM orders WHERE o_orderstatus = 'F' ORDER BY o_orderkey",
    "explain_empty": "EXPLAIN SELECT * FROM orders WHERE o_orderkey = 7 AND o_orderkey = 8",
}
_LINES = {
    "explain_lookup": "INDEX_LOOKUP table=orders index=orders_key key=7 predicates=1 residual_predicates=0 sort=false limit=none",
    "explain_range": "INDEX_RANGE table=orders index=orders_key lower=8 upper=none direction=reverse predicates=1 residual_predicates=0 sort=false limit=3 candidate_limit=3",
    "explain_scan": "TABLE_SCAN table=orders predicates=1 residual_predicates=1 sort=true limit=none",
    "explain_empty": "INDEX_LOOKUP table=orders index=orders_key key=7 empty=true predicates=2 residual_predicates=0 sort=false limit=none",
}


#: Queries that read stored copies of their indexes.
_STORED = ("index_lookup", "index_range", "index_range_desc_topk", "index_residual", "multi_index_choice", "bench_lookup")
#: The column by which rows of a table stand in their files.
_KEYS = {"orders": "o_orderkey", "events": "event_id", "part": "p_partkey", "customer": "c_custkey", "flags": "id"}
_MADE: dict[tuple[str, str, str], Engine] = {}


def _table_of(sql: str) -> str:
    return sql.split(" FROM ")[1].split()[0]


def indexed(spark: SparkSession, sf_dir: str, table: str) -> Engine:
    """A registered table with stored copies of its indexes, made once in a session for each folder."""
    key = (spark.sparkContext.applicationId, sf_dir, table)
    if key not in _MADE:
        e, at = Engine(spark), _scratch(spark)
        e.register(table, f"{sf_dir}/{table}.parquet")
        for name, of, column in INDEXES:
            if of == table:
                e.create_index(name, of, column, at)
        _MADE[key] = e
    return _MADE[key]


def _select(name: str, sql: str) -> Callable[[SparkSession, str], DataFrame]:
    """Statements with an order also return each row's place in it, ties by the table's key as in SQL, wherever files hold its rows."""
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        e = indexed(spark, sf_dir, _table_of(sql)) if name in _STORED else engine_of(spark, sf_dir, sql)
        got = e.select(sql)
        return got.placed("place", [_KEYS[_table_of(sql)]]) if " ORDER BY " in sql else got.df

    return run


def _explain(sql: str) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: spark.createDataFrame([(engine_of(spark, sf_dir, sql).explain(sql),)], "plan string")


def _catalog_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = engine_of(spark, sf_dir).catalog
    return spark.createDataFrame([(t.name, len(t.schema)) for t in c.tables], "name string, n_columns int")


def _fluent(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = engine_of(spark, sf_dir).query("orders")
    return q.filter(q.column(2) == "F").sort(q.column(0), descending=True).project([1, 0]).limit(20).df


def _from_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    schema = (Column("id", DataType.INTEGER), Column("name", DataType.TEXT, True))
    q = Query.from_rows(spark, [(2, "b"), (1, None), (3, "a")], schema)
    return q.sort(q.column(1)).limit(2).df


def _reverse_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    return indexed(spark, sf_dir, "events").lookup_index_range("events_user", 5, 9, descending=True).select("event_id", "user_id")


def _lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return indexed(spark, sf_dir, "events").lookup_index("events_user", 7).select("event_id", "user_id")


def _scratch(spark: SparkSession) -> str:
    """A folder below the session's shared one for what a query writes; it is deleted when the driver ends."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        base = tempfile.mkdtemp(prefix="larkspur-")
    path = f"{base.rstrip('/')}/db-{uuid.uuid4().hex}"
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(at)
    return path


def _managed(spark: SparkSession, sf_dir: str) -> Engine:
    """The orders, written to a managed table with an index before and one after, less one row."""
    e = Engine.create(spark, _scratch(spark))
    e.create_table("Orders", [Column("o_orderkey", DataType.INTEGER), Column("o_custkey", DataType.INTEGER, True), Column("o_orderstatus", DataType.TEXT)])
    e.create_index("by_key", "orders", "o_orderkey")
    e.load("orders", spark.read.parquet(f"{sf_dir}/orders.parquet").orderBy("o_orderkey"))
    e.create_index("by_cust", "orders", "o_custkey")
    first = e.select("SELECT o_orderkey FROM orders ORDER BY o_orderkey LIMIT 1").df.first()[0]
    e.erase("orders", e.lookup_index("by_key", first).first()["_rid"])
    return e


def _managed_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _managed(spark, sf_dir).select("SELECT * FROM orders WHERE o_custkey >= 50 AND o_custkey <= 150 ORDER BY o_custkey").df


def _managed_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _managed(spark, sf_dir).table("orders")


def _verify(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _managed(spark, sf_dir).verification("by_cust")


def _records(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = RecordStore(spark, f"{_scratch(spark)}/records")
    for x in (b"one", b"two", b"three"):
        s.insert(x)
    s.replace(1, b"second")
    s.erase(0)
    return s.df().select("rid", F.col("bytes").cast("string").alias("body"))


OTHERS = {
    "catalog_tables": _catalog_tables, "fluent_pipeline": _fluent, "rows_source": _from_rows, "lookup_index": _lookup,
    "lookup_index_range_desc": _reverse_range, "managed_scan": _managed_scan, "managed_index_range": _managed_range, "verify_index": _verify,
    "raw_records": _records,
}

_LESS = "FROM orders WHERE o_orderkey <> (SELECT min(o_orderkey) FROM orders)"
_OTHER_SQL = {
    "catalog_tables": f"""SELECT table_name AS name, count(*)::INT AS n_columns FROM information_schema.columns WHERE table_name IN {TABLES}
                          GROUP BY table_name UNION ALL SELECT 'flags', 5""",
    "fluent_pipeline": "SELECT o_custkey, o_orderkey FROM orders WHERE o_orderstatus = 'F' ORDER BY o_orderkey DESC LIMIT 20",
    "rows_source": "SELECT * FROM (VALUES (3::BIGINT, 'a'), (2::BIGINT, 'b')) AS t(id, name)",
    "lookup_index": "SELECT event_id, user_id FROM events WHERE user_id = 7",
    "lookup_index_range_desc": "SELECT event_id, user_id FROM events WHERE user_id BETWEEN 5 AND 9",
    "managed_scan": f"SELECT o_orderkey, o_custkey, o_orderstatus {_LESS}",
    "managed_index_range": f"SELECT o_orderkey, o_custkey, o_orderstatus {_LESS} AND o_custkey BETWEEN 50 AND 150",
    "verify_index": f"SELECT 0::BIGINT AS missing, 0::BIGINT AS extra, count(o_custkey)::BIGINT AS indexed {_LESS}",
    "raw_records": "SELECT * FROM (VALUES (1::BIGINT, 'second'), (2::BIGINT, 'three')) AS t(rid, body)",
}


def _duck(sql: str) -> str:
    if " ORDER BY " in sql:
        head, _, tail = sql.partition(" ORDER BY ")
        by, _, limit = tail.partition(" LIMIT ")
        what, rest = head.split(" FROM ", 1)
        sql = f"{what}, row_number() OVER (ORDER BY {by} NULLS LAST, {_KEYS[_table_of(sql)]}) AS place FROM {rest}" + (f" QUALIFY place <= {limit}" if limit else "")
    return sql.replace("FROM flags", f"FROM {FLAGS_SQL} AS flags")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    **{k: _select(k, v) for k, v in SELECTS.items()}, **{k: _explain(v) for k, v in EXPLAINS.items()}, **OTHERS}

ORACLE_SQL: dict[str, str] = {
    **{k: _duck(v) for k, v in SELECTS.items()}, **{k: f"SELECT '{v}' AS plan" for k, v in _LINES.items()}, **_OTHER_SQL}

#: What entry() runs.
FLAGSHIP = SELECTS["topk_desc"]
