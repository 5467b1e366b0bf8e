"""Profiles and distributions over lineitem, orders, part, customer and derived details."""

from pyspark.sql import functions as F

from plumbline.operators import profile, quality
from plumbline.plans.bound_mapping import BASE_SQL, detail
from plumbline.plans.bound_quality import FILES_SQL, files
from plumbline.plans.registry import Tables, filled, norm, pct, register, share

DETAIL_FIELDS = [
    "shop_id", "shop_name", "product_id", "spu", "sku_id", "child_order_id", "live_room_id", "pay_time", "pay_date", "anchor_id",
]
PHYSICAL = {f: f for f in DETAIL_FIELDS} | {"pay_date": "pay_time", "anchor_id": None}


def profile_sql(frame: str, physical: dict) -> str:
    parts = [
        f"""SELECT '{f}' AS logical_field, '{p or '未命中'}' AS physical_column, count(*) AS total_rows,
        count(*) FILTER (WHERE {f} IS NULL) AS null_rows, {share(f'count(*) FILTER (WHERE {f} IS NULL)', 'count(*)')} AS null_ratio,
        count(DISTINCT {f}) AS distinct_values FROM base"""
        for f, p in physical.items()
    ]
    return f"WITH base AS ({frame}) {' UNION ALL '.join(parts)}"


@register("field_profile", profile_sql(BASE_SQL, PHYSICAL))
def field_profile(spark, d):
    return profile.field_profile(detail(Tables(spark, d)), PHYSICAL, exact=True)


LINEITEM = [
    "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax",
    "l_returnflag", "l_linestatus", "l_shipdate",
]


@register("field_profile_lineitem", profile_sql("SELECT * FROM lineitem", {c: c for c in LINEITEM}))
def field_profile_lineitem(spark, d):
    return profile.field_profile(Tables(spark, d).lineitem, LINEITEM, exact=True)


@register(
    "canonical_projection",
    f"SELECT pay_date, pay_hour, count(*) AS row_count, count(spu) AS with_spu, count(anchor_id) AS with_anchor FROM ({BASE_SQL}) GROUP BY 1, 2",
)
def canonical_projection(spark, d):
    return detail(Tables(spark, d)).groupBy("pay_date", "pay_hour").agg(
        F.count(F.lit(1)).alias("row_count"), F.count("spu").alias("with_spu"), F.count("anchor_id").alias("with_anchor")
    )


@register(
    "overview",
    f"""SELECT count(*) AS total_rows, count(DISTINCT shop_id) AS distinct_shop_id, count(DISTINCT product_id) AS distinct_product_id,
      count(DISTINCT spu) AS distinct_spu, count(DISTINCT child_order_id) AS distinct_child_order_id,
      count(DISTINCT CASE WHEN pay_time IS NOT NULL THEN child_order_id END) AS pay_cnt,
      round(sum(coalesce(amount, 0)), 2) AS amount_sum, min(pay_time) AS min_pay_time, max(pay_time) AS max_pay_time FROM ({BASE_SQL})""",
)
def overview(spark, d):
    return profile.overview(
        detail(Tables(spark, d)), ["shop_id", "product_id", "spu", "child_order_id"], ["amount"], ["pay_time"],
        {"pay_cnt": ("child_order_id", F.col("pay_time").isNotNull())},
    )


def top_sql(frame: str, value: str, count: str = "row_count", name: str = "field_value", limit: str = "") -> str:
    whole = f"sum({count}) OVER ()"
    running = f"sum({count}) OVER (ORDER BY {count} DESC, {name})"
    return f"""SELECT {name}, {count}, {share(count, whole)} AS probability, {share(running, whole)} AS cumulative_probability
    FROM (SELECT {value} AS {name}, count(*) AS {count} FROM ({frame}) GROUP BY 1) ORDER BY {count} DESC, {name} {limit}"""


@register("top_distribution", top_sql(FILES_SQL, f"coalesce({norm('spu')}, '无')", limit="LIMIT 20"))
def top_distribution(spark, d):
    return profile.top_distribution(files(Tables(spark, d)), "spu")


@register("full_distribution", top_sql("SELECT l_partkey FROM lineitem", f"coalesce({norm('l_partkey')}, '无')"))
def full_distribution(spark, d):
    return profile.top_distribution(Tables(spark, d).lineitem, "l_partkey", n=None)


@register(
    "distribution_measures",
    f"""WITH b AS ({BASE_SQL}), a AS (SELECT coalesce(spu, '无') AS field_value, count(*) AS row_count, count(DISTINCT child_order_id) AS entity_cnt,
      count(DISTINCT CASE WHEN pay_time IS NOT NULL THEN child_order_id END) AS paid_cnt, round(sum(coalesce(amount, 0)), 2) AS amount_sum
      FROM b GROUP BY 1)
    SELECT *, {share('row_count', '(SELECT count(*) FROM b)')} AS row_ratio FROM a ORDER BY row_count DESC, field_value LIMIT 30""",
)
def distribution_measures(spark, d):
    return profile.distribution_with_measures(
        detail(Tables(spark, d)), "spu", "child_order_id", F.col("pay_time").isNotNull(), "amount", 30
    )


@register(
    "distribution_stats",
    f"""WITH c AS (SELECT coalesce({norm('sku_id')}, '无') AS v, count(*) AS n FROM ({BASE_SQL}) GROUP BY 1),
    r AS (SELECT *, row_number() OVER (ORDER BY n DESC, v) AS rn, {share('n', 'sum(n) OVER ()')} AS p FROM c)
    SELECT (SELECT count(*) FROM c) AS distinct_values, (SELECT v FROM r WHERE rn = 1) AS top1_label,
      (SELECT p FROM r WHERE rn = 1) AS top1_probability, (SELECT round(sum(p), 6) FROM r WHERE rn <= 10) AS top10_cumulative_probability""",
)
def distribution_stats(spark, d):
    return profile.distribution_stats(detail(Tables(spark, d)), "sku_id")


def label_sql(parts: dict[str, str]) -> str:
    return "concat_ws(' | ', " + ", ".join(f"concat('{k}=', coalesce({v}, '无'))" for k, v in parts.items()) + ")"


ATTRIBUTES = ["shop_id", "live_room_id", "pay_date"]


@register(
    "attribute_clusters",
    top_sql(
        f"SELECT {', '.join(f'max({norm(a)}) AS {a}' for a in ATTRIBUTES)} FROM ({BASE_SQL}) WHERE {filled('product_id')} GROUP BY product_id",
        label_sql({a: a for a in ATTRIBUTES}), "entity_count", "cluster_label", "LIMIT 25",
    ),
)
def attribute_clusters(spark, d):
    return profile.attribute_clusters(detail(Tables(spark, d)), "product_id", ATTRIBUTES, 25)


PART_LABEL = {"brand": norm("p_brand"), "type": norm("p_type"), "size": norm("p_size")}


@register("row_clusters", top_sql("SELECT * FROM part", label_sql(PART_LABEL), name="cluster_label", limit="LIMIT 40"))
def row_clusters(spark, d):
    return profile.row_clusters(Tables(spark, d).part, {"brand": "p_brand", "type": "p_type", "size": "p_size"}, 40)


@register("row_clusters_full", top_sql("SELECT * FROM part", label_sql(PART_LABEL), name="cluster_label"))
def row_clusters_full(spark, d):
    return profile.row_clusters(Tables(spark, d).part, {"brand": "p_brand", "type": "p_type", "size": "p_size"}, None)


@register("group_count", f"SELECT count(*) AS group_count FROM (SELECT spu FROM ({BASE_SQL}) GROUP BY spu)")
def group_count(spark, d):
    return profile.group_count(detail(Tables(spark, d)), F.col("spu"))


@register(
    "entity_preview",
    f"""SELECT live_room_id, coalesce(pay_date, '无支付日期') AS pay_date, count(*) AS row_count, count(DISTINCT child_order_id) AS child_order_count,
      count(DISTINCT spu) AS spu_count, count(DISTINCT product_id) AS product_id_count FROM ({BASE_SQL}) WHERE live_room_id IS NOT NULL
    GROUP BY 1, 2 ORDER BY child_order_count DESC, row_count DESC, live_room_id, pay_date LIMIT 30""",
)
def entity_preview(spark, d):
    return profile.entity_preview(
        detail(Tables(spark, d)),
        {"live_room_id": F.col("live_room_id"), "pay_date": F.coalesce("pay_date", F.lit("无支付日期"))},
        {"child_order_count": "child_order_id", "spu_count": "spu", "product_id_count": "product_id"},
        [F.desc("child_order_count"), F.desc("row_count"), F.asc("live_room_id"), F.asc("pay_date")],
        30,
        F.col("live_room_id").isNotNull(),
    )


@register(
    "two_key_distribution",
    """SELECT o_orderstatus, o_orderpriority, count(*) AS row_count, count(DISTINCT o_custkey) AS entity_cnt,
      round(sum(coalesce(o_totalprice, 0)), 2) AS amount_sum FROM orders GROUP BY 1, 2 ORDER BY 3 DESC, 1, 2 LIMIT 30""",
)
def two_key_distribution(spark, d):
    return profile.two_key_distribution(
        Tables(spark, d).orders, "o_orderstatus", "o_orderpriority", "o_custkey", "o_totalprice"
    )


@register(
    "text_distribution",
    """SELECT p_name, count(*) AS row_count, count(DISTINCT p_brand) AS brands, count(DISTINCT p_type) AS types FROM part
    WHERE p_name IS NOT NULL GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 20""",
)
def text_distribution(spark, d):
    return profile.text_distribution(Tables(spark, d).part, "p_name", {"brands": "p_brand", "types": "p_type"})


@register(
    "longest_texts",
    "SELECT doc_id, lang, text FROM documents WHERE text IS NOT NULL ORDER BY length(text) DESC, text, doc_id, lang LIMIT 20",
)
def longest_texts(spark, d):
    return profile.longest_texts(Tables(spark, d).documents, "text", ["doc_id", "lang"])


RISK_SQL = f"SELECT *, CASE WHEN doc_id % 20 = 0 THEN 'x' END AS video_time, CASE WHEN doc_id % 2 = 0 THEN 'y' END AS half FROM ({FILES_SQL})"


@register(
    "field_risk",
    f"""WITH f AS ({RISK_SQL}), m AS ("""
    + " UNION ALL ".join(
        f"SELECT '{c}' AS field_name, {pct(f'count(*) FILTER (WHERE NOT {filled(c)})', 'count(*)', 4)} AS miss_rate_pct FROM f"
        for c in ["spu", "folder_path", "video_time", "half"]
    )
    + """) SELECT field_name, miss_rate_pct, CASE WHEN miss_rate_pct >= 80 THEN 'unusable_slice' ELSE 'auxiliary_only' END AS risk_level
    FROM m WHERE miss_rate_pct >= 40""",
)
def field_risk(spark, d):
    df = files(Tables(spark, d)).withColumns(
        {"video_time": F.when(F.col("doc_id") % 20 == 0, "x"), "half": F.when(F.col("doc_id") % 2 == 0, "y")}
    )
    fill = quality.fill_metrics(df, ["spu", "folder_path", "video_time", "half"])
    return profile.field_risk(fill).select("field_name", "miss_rate_pct", "risk_level")


@register(
    "base_table_election",
    f"""WITH e AS (
      SELECT 'lineitem' AS table_name, 11 AS column_count, 3 AS matched_core_fields, 1 AS typed_time_fields, 1 AS enhancement_fields,
        count(*) AS record_count, count(DISTINCT l_orderkey) AS distinct_entities FROM lineitem
      UNION ALL
      SELECT 'orders', 6, 2, 1, 0, count(*), count(DISTINCT o_orderkey) FROM orders
    ), s AS (
      SELECT *, CAST((record_count = max(record_count) OVER ()) AS INTEGER) + CAST((matched_core_fields = max(matched_core_fields) OVER ()) AS INTEGER)
        + CAST((typed_time_fields = max(typed_time_fields) OVER ()) AS INTEGER) + CAST((enhancement_fields = max(enhancement_fields) OVER ()) AS INTEGER)
        AS criteria_led FROM e)
    SELECT *, CASE WHEN row_number() OVER (ORDER BY criteria_led DESC, record_count DESC, matched_core_fields DESC, table_name DESC) = 1
      THEN '主分析底表' ELSE '辅助对照表' END AS recommendation FROM s""",
)
def base_table_election(spark, d):
    t = Tables(spark, d)
    evidence = profile.table_evidence(
        t.lineitem, "lineitem", {"order": "l_orderkey", "product": "l_partkey", "time": "l_shipdate"}, ["l_shipdate"],
        "order", ["product"],
    ).unionByName(
        profile.table_evidence(
            t.orders, "orders", {"order": "o_orderkey", "product": None, "time": "o_orderdate"}, ["o_orderdate"],
            "order", ["product"],
        )
    )
    return profile.elect_base_table(evidence)


@register(
    "entity_coverage",
    "SELECT p_brand, count(DISTINCT p_type) AS entity_count FROM part GROUP BY 1",
)
def entity_coverage(spark, d):
    return profile.entity_coverage(Tables(spark, d).part, "p_brand", "p_type")
