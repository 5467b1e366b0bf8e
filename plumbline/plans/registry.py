"""Registration of the queries that run over the test tables, each with its SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    """Register a query under a name, with the equivalent ANSI SQL if there is one."""

    def wrap(fn: Callable[[SparkSession, str], DataFrame]):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return wrap


class Tables:
    """The parquet tables of one folder as attributes."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def __getattr__(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")


def derive(df: DataFrame, columns: dict[str, str]) -> DataFrame:
    """Project SQL expressions that mean the same in both engines."""
    return df.selectExpr(*[f"{e} AS {name}" for name, e in columns.items()])


def derive_sql(table: str, columns: dict[str, str]) -> str:
    return "SELECT " + ", ".join(f"{e} AS {name}" for name, e in columns.items()) + f" FROM {table}"


def pct(part: str, whole: str, decimals: int = 2) -> str:
    return (
        f"round(coalesce(CAST({part} AS DOUBLE) * CAST(100.0 AS DOUBLE) / nullif(CAST({whole} AS DOUBLE), 0), 0), {decimals})"
    )


def share(part: str, whole: str, decimals: int = 6) -> str:
    return f"round(CAST({part} AS DOUBLE) / nullif(CAST({whole} AS DOUBLE), 0), {decimals})"


def filled(c: str) -> str:
    return f"coalesce(trim(CAST({c} AS STRING)) <> '', false)"


def norm(c: str) -> str:
    return f"nullif(trim(CAST({c} AS STRING)), '')"


def big(c: str) -> str:
    return f"CAST({c} AS BIGINT)"


# Input frames derived from the tables, with blanks, duplicates and odd values put
# in by fixed rules on the row keys.

#: files, from documents
FILES = {
    "doc_id": "doc_id",
    "platform_source_id": "CASE WHEN doc_id % 9 = 0 THEN NULL ELSE concat('s', doc_id % 500) END",
    "file_id": "CASE WHEN doc_id % 50 = 49 THEN concat('f', doc_id - 1) WHEN doc_id % 71 = 0 THEN ' ' ELSE concat('f', doc_id) END",
    "file_type": "CASE WHEN doc_id % 4 = 3 THEN '视频' ELSE '图片' END",
    "folder_path": "CASE WHEN doc_id % 7 = 0 THEN NULL WHEN doc_id % 11 = 0 THEN ' ' ELSE concat(lang, chr(92), source) END",
    "file_name": "CASE WHEN doc_id % 13 = 0 THEN NULL ELSE concat('doc', doc_id, CASE doc_id % 10 WHEN 0 THEN '.mp4' WHEN 1 THEN '.JPG' WHEN 2 THEN '.png' WHEN 3 THEN '.zip' WHEN 4 THEN '' WHEN 5 THEN '.tar.gz' ELSE '.jpeg' END) END",
    "full_path": "CASE WHEN doc_id % 17 = 0 THEN NULL ELSE concat('root/', source, '/doc', doc_id - doc_id % 3, CASE doc_id % 10 WHEN 0 THEN '.mov' WHEN 4 THEN '' ELSE '.jpg' END) END",
    "data_update_time": "CASE WHEN doc_id % 5 = 0 THEN NULL ELSE concat('2024-01-', lpad(CAST(doc_id % 28 + 1 AS STRING), 2, '0')) END",
    "image_modify_time": "CASE WHEN doc_id % 10 = 0 THEN NULL ELSE concat('2023-12-', lpad(CAST(doc_id % 30 + 1 AS STRING), 2, '0')) END",
    "spu": "CASE WHEN doc_id % 6 = 0 THEN '' ELSE concat(CASE WHEN doc_id % 2 = 0 THEN 'sp' ELSE 'SP' END, doc_id % 120) END",
    "lang": "lang",
    "source": "source",
}

#: order details, from lineitem
DETAIL = {
    "shop_id": "CAST(l_suppkey % 20 AS STRING)",
    "shop_name": "concat('shop ', l_suppkey % 20 - l_suppkey % 40 % 20 + l_suppkey % 20)",
    "product_id": "CASE WHEN l_partkey % 37 = 0 THEN ' ' ELSE CAST(l_partkey AS STRING) END",
    "spu": "CASE WHEN l_partkey % 23 = 0 THEN NULL ELSE concat(CASE WHEN l_linenumber % 2 = 0 THEN 'sp' ELSE 'SP' END, l_partkey % 40) END",
    "sku_id": "concat('k', l_partkey % 40, '-', l_linenumber % (l_partkey % 7 + 1))",
    "child_order_id": "concat(l_orderkey, '-', l_linenumber)",
    "live_room_id": "CASE WHEN l_suppkey % 19 = 0 THEN NULL ELSE concat('room', l_suppkey, '_', l_partkey % 3) END",
    "pay_time": "CASE WHEN l_orderkey % 29 = 0 THEN '' ELSE CAST(l_shipdate AS STRING) END",
    "amount": "l_extendedprice",
    "quantity": "l_quantity",
}

#: event log, from events
EVENTS = {
    "user_id": "CASE WHEN event_id % 101 = 0 THEN '' ELSE CAST(user_id AS STRING) END",
    "timestamp": "ts",
    "action": "CASE WHEN event_id % 3 = 0 THEN upper(event_type) ELSE event_type END",
    "duration": "CAST(CASE WHEN event_id % 53 = 0 THEN -value WHEN event_id % 97 = 0 THEN value + 100000 ELSE value END AS DOUBLE)",
    "feature": "CASE WHEN user_id % 9 = 0 THEN 'rare' ELSE event_type END",
    "session_id": "concat(user_id, '/', CAST(CAST(ts AS DATE) AS STRING))",
}
EVENT_LIMIT = 86400.0


def events_frame(t: Tables) -> DataFrame:
    return derive(t.events, EVENTS)


EVENTS_SQL = derive_sql("events", EVENTS)
CLEAN_SQL = (
    "SELECT user_id, timestamp, CAST(timestamp AS DATE) AS day, lower(action) AS action, "
    f"least(greatest(duration, 0), {EVENT_LIMIT}) AS duration, feature, session_id "
    f"FROM ({EVENTS_SQL}) WHERE coalesce(trim(user_id), '') <> ''"
)
