"""Mapping queries over lineitem and orders."""

from pyspark.sql import functions as F

from plumbline.operators import mapping
from plumbline.plans.registry import (
    DETAIL, Tables, big, derive, derive_sql, norm, register, share,
)
from plumbline.sources.tables import LogicalField, canonical

PAIRS = [
    ("part_to_supplier", "l_partkey", "l_suppkey"),
    ("order_to_part", "l_orderkey", "l_partkey"),
    ("supplier_to_flag", "l_suppkey", "l_returnflag"),
]

FIELDS = [
    LogicalField("shop_id", ["erp_shop_id", "shop_id"]),
    LogicalField("shop_name", ["shop_name", "shop_nick"]),
    LogicalField("product_id", ["product_id", "goods_id"]),
    LogicalField("spu", ["spu", "spu_id"], "upper"),
    LogicalField("sku_id", ["sku_id", "sku"], "upper"),
    LogicalField("child_order_id", ["child_order_id", "child_order_no"]),
    LogicalField("live_room_id", ["live_room_id", "room_id"]),
    LogicalField("pay_time", ["pay_time", "paid_time"]),
    LogicalField("pay_date", ["pay_time", "paid_time"], "day"),
    LogicalField("pay_hour", ["pay_time", "paid_time"], "hour"),
    LogicalField("anchor_id", ["anchor_id"]),
]
DETAIL_PAIRS = [
    ("shop_id_to_shop_name", "shop_id", "shop_name"),
    ("product_id_to_spu", "product_id", "spu"),
    ("spu_to_sku_id", "spu", "sku_id"),
    ("child_order_id_to_live_room_id", "child_order_id", "live_room_id"),
    ("live_room_id_to_pay_date", "live_room_id", "pay_date"),
    ("spu_to_live_room_id", "spu", "live_room_id"),
]
DAY_PAIRS = ["live_room_id_to_pay_date"]


def detail(t: Tables):
    return canonical(derive(t.lineitem, DETAIL), FIELDS, keep=["amount", "quantity"])


BASE_SQL = (
    f"SELECT {norm('shop_id')} AS shop_id, {norm('shop_name')} AS shop_name, {norm('product_id')} AS product_id, "
    f"upper({norm('spu')}) AS spu, upper({norm('sku_id')}) AS sku_id, {norm('child_order_id')} AS child_order_id, "
    f"{norm('live_room_id')} AS live_room_id, {norm('pay_time')} AS pay_time, "
    f"substr({norm('pay_time')}, 1, 10) AS pay_date, substr({norm('pay_time')}, 1, 13) AS pay_hour, "
    f"CAST(NULL AS STRING) AS anchor_id, amount, quantity FROM ({derive_sql('lineitem', DETAIL)})"
)


def pair_sql(table: str, pairs) -> str:
    parts = [
        f"SELECT '{name}' AS pair_name, CAST({s} AS STRING) AS s, CAST({t} AS STRING) AS t FROM {table} "
        f"WHERE {s} IS NOT NULL AND {t} IS NOT NULL"
        for name, s, t in pairs
    ]
    return " UNION ALL ".join(parts)


def stats_sql(table: str, pairs) -> str:
    return (
        "SELECT pair_name, s AS source_value, count(*) AS row_count, count(DISTINCT t) AS target_distinct_cnt, "
        f"min(t) AS lo, max(t) AS hi FROM ({pair_sql(table, pairs)}) GROUP BY 1, 2"
    )


def summary_sql(table: str, pairs) -> str:
    return f"""
    SELECT pair_name, count(*) AS source_key_count, {big('sum(row_count)')} AS covered_rows,
      round(avg(target_distinct_cnt), 4) AS avg_target_per_source,
      quantile_disc(target_distinct_cnt, 0.5) AS p50_target_per_source,
      quantile_disc(target_distinct_cnt, 0.9) AS p90_target_per_source,
      max(target_distinct_cnt) AS max_target_per_source,
      {big('sum(CASE WHEN target_distinct_cnt > 1 THEN 1 ELSE 0 END)')} AS multi_mapping_source_keys,
      {share('sum(CASE WHEN target_distinct_cnt > 1 THEN 1 ELSE 0 END)', 'count(*)')} AS multi_mapping_ratio
    FROM ({stats_sql(table, pairs)}) GROUP BY pair_name"""


def bucket_sql(table: str, pairs, day_pairs=()) -> str:
    days = ", ".join(f"'{d}'" for d in day_pairs) or "''"
    c = "target_distinct_cnt"
    return f"""
    WITH b AS (
      SELECT pair_name, CASE WHEN pair_name IN ({days}) THEN
          CASE WHEN {c} = 1 THEN '1天' WHEN {c} BETWEEN 2 AND 3 THEN '2-3天' WHEN {c} BETWEEN 4 AND 7 THEN '4-7天'
               WHEN {c} BETWEEN 8 AND 15 THEN '8-15天' ELSE '16天以上' END
        ELSE
          CASE WHEN {c} = 1 THEN '1' WHEN {c} BETWEEN 2 AND 5 THEN '2-5' WHEN {c} BETWEEN 6 AND 10 THEN '6-10'
               WHEN {c} BETWEEN 11 AND 20 THEN '11-20' ELSE '21+' END
        END AS target_bucket
      FROM ({stats_sql(table, pairs)})
    )
    SELECT pair_name, target_bucket, count(*) AS source_key_count,
      {share('count(*)', 'sum(count(*)) OVER (PARTITION BY pair_name)')} AS source_key_ratio,
      CAST(CASE WHEN target_bucket IN ('1', '1天') THEN 1 WHEN target_bucket IN ('2-5', '2-3天') THEN 2
           WHEN target_bucket IN ('6-10', '4-7天') THEN 3 WHEN target_bucket IN ('11-20', '8-15天') THEN 4
           ELSE 5 END AS INTEGER) AS bucket_order
    FROM b GROUP BY pair_name, target_bucket"""


def samples_sql(table: str, pairs, n: int, k: int) -> str:
    return f"""
    WITH p AS ({pair_sql(table, pairs)}), st AS ({stats_sql(table, pairs)}),
    top AS (
      SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY pair_name
        ORDER BY target_distinct_cnt DESC, row_count DESC, source_value) AS rn
        FROM st WHERE target_distinct_cnt > 1) WHERE rn <= {n}
    ),
    d AS (SELECT DISTINCT p.pair_name, p.s, p.t FROM p JOIN top ON p.pair_name = top.pair_name AND p.s = top.source_value),
    r AS (SELECT *, row_number() OVER (PARTITION BY pair_name, s ORDER BY t) AS rn FROM d)
    SELECT top.pair_name, source_value, row_count, target_distinct_cnt,
      (SELECT string_agg(t, ' | ' ORDER BY t) FROM r WHERE r.pair_name = top.pair_name AND r.s = top.source_value AND r.rn <= {k})
        AS target_samples
    FROM top"""


@register("mapping_summary", summary_sql("lineitem", PAIRS))
def mapping_summary(spark, d):
    return mapping.mapping_summary(Tables(spark, d).lineitem, PAIRS)


@register("mapping_buckets", bucket_sql("lineitem", PAIRS))
def mapping_buckets(spark, d):
    return mapping.mapping_buckets(Tables(spark, d).lineitem, PAIRS)


@register("mapping_samples", samples_sql("lineitem", PAIRS, 15, 4))
def mapping_samples(spark, d):
    return mapping.mapping_samples(Tables(spark, d).lineitem, PAIRS, n=15, targets=4)


@register(
    "mapping_range_samples",
    f"""SELECT pair_name, source_value, row_count, target_distinct_cnt, concat(lo, ' | ', hi) AS target_samples
    FROM (SELECT *, row_number() OVER (PARTITION BY pair_name ORDER BY target_distinct_cnt DESC, row_count DESC, source_value) AS rn
          FROM ({stats_sql('lineitem', PAIRS)}) WHERE target_distinct_cnt > 1) WHERE rn <= 12""",
)
def mapping_range_samples(spark, d):
    return mapping.mapping_range_samples(Tables(spark, d).lineitem, PAIRS, n=12)


@register(
    "pair_frequency",
    """SELECT o_custkey AS source_value, o_orderstatus AS target_value, count(*) AS row_count FROM orders
    WHERE o_custkey IS NOT NULL AND o_orderstatus IS NOT NULL GROUP BY 1, 2 ORDER BY 3 DESC, 1, 2 LIMIT 25""",
)
def pair_frequency(spark, d):
    return mapping.pair_frequency(Tables(spark, d).orders, "o_custkey", "o_orderstatus", 25)


@register("all_pairs_summary", f"WITH base AS ({BASE_SQL}) {summary_sql('base', DETAIL_PAIRS)}")
def all_pairs_summary(spark, d):
    return mapping.mapping_checks(detail(Tables(spark, d)), DETAIL_PAIRS, quick=True)["summary"]


@register("all_pairs_buckets", f"WITH base AS ({BASE_SQL}) SELECT * FROM ({bucket_sql('base', DETAIL_PAIRS, DAY_PAIRS)})")
def all_pairs_buckets(spark, d):
    return mapping.mapping_checks(detail(Tables(spark, d)), DETAIL_PAIRS, DAY_PAIRS)["buckets"]


@register("all_pairs_samples", f"WITH base AS ({BASE_SQL}) SELECT * FROM ({samples_sql('base', DETAIL_PAIRS, 20, 5)})")
def all_pairs_samples(spark, d):
    return mapping.mapping_checks(detail(Tables(spark, d)), DETAIL_PAIRS)["samples"]


@register(
    "mapping_findings",
    f"""WITH base AS ({BASE_SQL}), s AS ({summary_sql('base', DETAIL_PAIRS)}),
    f AS (
      SELECT concat(pair_name, ' is not unique') AS "check", * FROM s WHERE multi_mapping_ratio > 0
      UNION ALL
      SELECT concat(pair_name, ' has sources with many targets') AS "check", * FROM s
      WHERE pair_name = 'spu_to_live_room_id' AND max_target_per_source > 20
    )
    SELECT "check", 'lineitem' AS scope, 'medium' AS severity, 'fail' AS status,
      multi_mapping_source_keys AS row_count, round(multi_mapping_ratio * CAST(100.0 AS DOUBLE), 4) AS row_rate_pct,
      'wrong_grain' AS bucket, concat('max targets per source: ', max_target_per_source) AS detail FROM f""",
)
def mapping_findings(spark, d):
    summary = mapping.mapping_summary(detail(Tables(spark, d)), DETAIL_PAIRS)
    return mapping.mapping_findings(summary, {"spu_to_live_room_id": 20}, "lineitem").drop("sample")


GRAINS = [
    ["l_orderkey"],
    ["l_partkey", "l_suppkey"],
    ["l_orderkey", "l_linenumber"],
    ["l_orderkey", "l_partkey"],
    ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber"],
    ["not_there"],
]


def grain_sql(table: str, field: str, candidates) -> str:
    parts = []
    for i, keys in enumerate(candidates):
        names = ", ".join(f"trim(CAST({k} AS STRING))" for k in keys)
        parts.append(
            f"SELECT '{'+'.join(keys)}' AS grain, {i + 1} AS position, count(DISTINCT trim(CAST({field} AS STRING))) AS v "
            f"FROM {table} WHERE {field} IS NOT NULL GROUP BY {names}"
        )
    return f"""WITH k AS ({' UNION ALL '.join(parts)}),
    g AS (SELECT grain, position, count(*) AS key_count, max(v) AS max_distinct_per_key,
            quantile_disc(v, 0.5) AS p50_distinct_per_key, quantile_disc(v, 0.9) AS p90_distinct_per_key
          FROM k GROUP BY 1, 2)
    SELECT '{field}' AS field_name, grain, CAST(position AS INTEGER) AS position, key_count, max_distinct_per_key,
      p50_distinct_per_key, p90_distinct_per_key,
      coalesce(position = (SELECT min(position) FROM g WHERE max_distinct_per_key = 1), false) AS is_minimal_grain FROM g"""


@register("grain_inference", grain_sql("lineitem", "l_extendedprice", GRAINS[:-1]))
def grain_inference(spark, d):
    return mapping.grain_inference(Tables(spark, d).lineitem, "l_extendedprice", GRAINS)


@register(
    "grain_inference_unresolved",
    grain_sql("lineitem", "l_returnflag", [["l_suppkey"], ["l_partkey"], ["l_linenumber", "l_suppkey"]]),
)
def grain_inference_unresolved(spark, d):
    keys = [["l_suppkey"], ["l_partkey"], ["l_linenumber", "l_suppkey"]]
    return mapping.grain_inference(Tables(spark, d).lineitem, "l_returnflag", keys)


@register(
    "field_availability",
    f"""WITH g AS ({grain_sql('orders', 'o_totalprice', [['o_custkey'], ['o_orderkey']])}),
    h AS ({grain_sql('customer', 'c_mktsegment', [['c_nationkey'], ['c_custkey']])})
    SELECT 'price' AS field_name, 'exact' AS status, 'orders' AS source_table, 'o_totalprice' AS source_column, grain, key_count
      FROM g WHERE is_minimal_grain
    UNION ALL SELECT 'segment', 'fallback', 'customer', 'c_mktsegment', grain, key_count FROM h WHERE is_minimal_grain
    UNION ALL SELECT 'unit price', 'derived', 'orders', 'sum(o_totalprice) / count(o_orderkey)', NULL, NULL
    UNION ALL SELECT 'refund', 'missing', 'orders', NULL, NULL, NULL
    UNION ALL SELECT 'title', 'table_not_found', NULL, NULL, NULL, NULL""",
)
def field_availability(spark, d):
    t = Tables(spark, d)
    specs = [
        {"name": "price", "table": "orders", "exact": ["total", "o_totalprice"]},
        {"name": "segment", "table": "orders", "exact": ["segment"], "fallback": [("customer", ["c_mktsegment"])]},
        {
            "name": "unit price", "table": "orders", "components": ["o_totalprice", "o_orderkey"],
            "derived": "sum(o_totalprice) / count(o_orderkey)",
        },
        {"name": "refund", "table": "orders", "exact": ["refund_amount"]},
        {"name": "title", "table": "titles", "exact": ["title"]},
    ]
    grains = {"orders": [["o_custkey"], ["o_orderkey"]], "customer": [["c_nationkey"], ["c_custkey"]]}
    return mapping.field_availability({"orders": t.orders, "customer": t.customer}, specs, grains)


@register(
    "derived_ratio",
    """SELECT l_suppkey, round(sum(CASE WHEN l_returnflag = 'R' THEN l_quantity ELSE 0 END) / nullif(sum(l_quantity), 0), 6)
    AS return_rate FROM lineitem GROUP BY l_suppkey""",
)
def derived_ratio(spark, d):
    df = Tables(spark, d).lineitem.withColumn(
        "returned", F.when(F.col("l_returnflag") == "R", F.col("l_quantity")).otherwise(0.0)
    )
    return mapping.ratio_metric(df, "returned", "l_quantity", ["l_suppkey"], "return_rate")
