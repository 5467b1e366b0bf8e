"""Key-skew queries over lineitem and supplier."""

from pyspark.sql import functions as F

from plumbline.operators import skew
from plumbline.plans.registry import Tables, big, register, share

#: a key that holds a third of all rows
HOT = "CASE WHEN l_orderkey % 3 = 0 THEN 0 ELSE l_suppkey END"
HOT_SQL = f"(SELECT *, {HOT} AS hot_key FROM lineitem)"


def hot(spark, d):
    return Tables(spark, d).lineitem.withColumn("hot_key", F.expr(HOT))


@register(
    "key_skew",
    f"""WITH c AS (SELECT hot_key, count(*) AS n FROM {HOT_SQL} GROUP BY 1)
    SELECT 'hot_key' AS key_name, count(*) AS key_count, {big('sum(n)')} AS total_rows, max(n) AS max_rows, round(avg(n), 4) AS avg_rows,
      round((sum(pow(n - m, 3)) / count(*)) / pow(sum(pow(n - m, 2)) / count(*), 1.5), 4) AS skewness, {share('max(n) * count(*)', 'sum(n)', 4)} AS max_to_avg,
      {share('max(n)', 'sum(n)')} AS top_key_share FROM c, (SELECT avg(n) AS m FROM c)""",
)
def key_skew(spark, d):
    return skew.skew_profile(hot(spark, d), "hot_key")


@register(
    "hot_keys",
    f"""SELECT hot_key, count(*) AS row_count, {share('count(*)', f'(SELECT count(*) FROM lineitem)')} AS row_share FROM {HOT_SQL} GROUP BY 1
    ORDER BY 2 DESC, 1 LIMIT 10""",
)
def hot_keys(spark, d):
    return skew.hot_keys(hot(spark, d), "hot_key")


@register(
    "two_stage_agg",
    f"""SELECT hot_key, count(*) AS row_count, round(sum(l_quantity), 2) AS quantity, min(l_shipdate) AS first_ship, max(l_extendedprice) AS max_price,
      round(avg(l_discount), 6) AS avg_discount FROM {HOT_SQL} GROUP BY 1""",
)
def two_stage_agg(spark, d):
    out = skew.two_stage_agg(
        hot(spark, d),
        ["hot_key"],
        {
            "row_count": ("count", "*"),
            "quantity": ("sum", "l_quantity"),
            "first_ship": ("min", "l_shipdate"),
            "max_price": ("max", "l_extendedprice"),
            "avg_discount": ("avg", "l_discount"),
        },
    )
    return out.withColumns({"quantity": F.round("quantity", 2), "avg_discount": F.round("avg_discount", 6)})


@register(
    "salted_join",
    f"""SELECT s_name, s_nationkey, count(*) AS row_count, round(sum(l_extendedprice), 2) AS price FROM {HOT_SQL} JOIN supplier ON hot_key = s_suppkey GROUP BY 1, 2""",
)
def salted_join(spark, d):
    suppliers = Tables(spark, d).supplier.withColumnRenamed("s_suppkey", "hot_key")
    joined = skew.salted_join(hot(spark, d), suppliers, "hot_key", salts=8)
    return joined.groupBy("s_name", "s_nationkey").agg(
        F.count(F.lit(1)).alias("row_count"), F.round(F.sum("l_extendedprice"), 2).alias("price")
    )


#: a third of all rows without a key
NO_KEY = "CASE WHEN l_orderkey % 3 = 0 THEN NULL ELSE l_suppkey END"
NO_KEY_SQL = f"(SELECT *, {NO_KEY} AS hot_key FROM lineitem)"


def no_key_join(spark, d, how):
    t = Tables(spark, d)
    suppliers = t.supplier.where("s_suppkey % 4 <> 1").withColumnRenamed("s_suppkey", "hot_key")
    return skew.salted_join(t.lineitem.withColumn("hot_key", F.expr(NO_KEY)), suppliers, "hot_key", how, salts=8)


@register(
    "salted_left_join_null_keys",
    f"""SELECT hot_key IS NULL AS no_key, s_name IS NULL AS unmatched, count(*) AS row_count, {big('sum(l_linenumber)')} AS line_sum
    FROM {NO_KEY_SQL} LEFT JOIN (SELECT * FROM supplier WHERE s_suppkey % 4 <> 1) ON hot_key = s_suppkey GROUP BY 1, 2""",
)
def salted_left_join_null_keys(spark, d):
    return no_key_join(spark, d, "left").groupBy(F.col("hot_key").isNull().alias("no_key"), F.col("s_name").isNull().alias("unmatched")).agg(
        F.count(F.lit(1)).alias("row_count"), F.sum(F.col("l_linenumber").cast("long")).alias("line_sum")
    )


@register(
    "salted_anti_join_null_keys",
    f"""SELECT hot_key IS NULL AS no_key, count(*) AS row_count, {big('sum(l_linenumber)')} AS line_sum
    FROM {NO_KEY_SQL} WHERE hot_key IS NULL OR hot_key NOT IN (SELECT s_suppkey FROM supplier WHERE s_suppkey % 4 <> 1) GROUP BY 1""",
)
def salted_anti_join_null_keys(spark, d):
    return no_key_join(spark, d, "left_anti").groupBy(F.col("hot_key").isNull().alias("no_key")).agg(
        F.count(F.lit(1)).alias("row_count"), F.sum(F.col("l_linenumber").cast("long")).alias("line_sum")
    )


@register(
    "salted_left_join",
    f"""SELECT s_name IS NULL AS unmatched, count(*) AS row_count FROM {HOT_SQL} LEFT JOIN (SELECT * FROM supplier WHERE s_suppkey % 4 <> 1)
    ON hot_key = s_suppkey GROUP BY 1""",
)
def salted_left_join(spark, d):
    suppliers = Tables(spark, d).supplier.where("s_suppkey % 4 <> 1").withColumnRenamed("s_suppkey", "hot_key")
    joined = skew.salted_join(hot(spark, d), suppliers, "hot_key", "left", salts=8)
    return joined.groupBy(F.col("s_name").isNull().alias("unmatched")).agg(F.count(F.lit(1)).alias("row_count"))


#: the same key in a third of the large table and in half of the small one
BOTH = "CASE WHEN s_suppkey % 2 = 0 THEN 0 ELSE s_suppkey END"


@register(
    "salted_join_both_sides",
    f"""SELECT s_nationkey, l_linenumber, count(*) AS row_count, {big('sum(l_orderkey)')} AS order_sum
    FROM {HOT_SQL} JOIN (SELECT *, {BOTH} AS key FROM supplier) ON hot_key = key GROUP BY 1, 2""",
)
def salted_join_both_sides(spark, d):
    suppliers = skew.merged(Tables(spark, d).supplier.withColumn("hot_key", F.expr(BOTH)), ["hot_key", "s_nationkey"], "suppliers")
    lines = hot(spark, d).withColumn("l_orderkey", F.col("l_orderkey").cast("long"))
    lines = skew.merged(lines, ["hot_key", "l_linenumber"], "lines", {"orders": "l_orderkey"})
    joined = skew.salted_join(lines, suppliers, "hot_key", share=0.02)
    return joined.groupBy("s_nationkey", "l_linenumber").agg(
        F.sum(F.col("lines") * F.col("suppliers")).alias("row_count"), F.sum(F.col("orders") * F.col("suppliers")).alias("order_sum")
    )


@register(
    "salted_left_join_both_sides",
    f"""SELECT s_nationkey, s_name IS NULL AS unmatched, count(*) AS row_count
    FROM {HOT_SQL} LEFT JOIN (SELECT *, {BOTH} AS key FROM supplier WHERE s_suppkey % 4 <> 1) ON hot_key = key GROUP BY 1, 2""",
)
def salted_left_join_both_sides(spark, d):
    suppliers = Tables(spark, d).supplier.where("s_suppkey % 4 <> 1").withColumns({"hot_key": F.expr(BOTH), "no_name": F.col("s_name").isNull()})
    suppliers = skew.merged(suppliers, ["hot_key", "s_nationkey", "no_name"], "suppliers")
    joined = skew.salted_join(skew.merged(hot(spark, d), ["hot_key"], "lines"), suppliers, "hot_key", "left", share=0.02)
    # a line without a supplier counts once
    return joined.groupBy("s_nationkey", F.coalesce("no_name", F.lit(True)).alias("unmatched")).agg(
        F.sum(F.col("lines") * F.coalesce("suppliers", F.lit(1))).alias("row_count")
    )


@register(
    "heavy_key_counts",
    f"""SELECT hot_key, count(*) AS row_count FROM {HOT_SQL} GROUP BY 1 HAVING count(*) > 0.005 * (SELECT count(*) FROM lineitem)""",
)
def heavy_key_counts(spark, d):
    return skew.heavy_counts(hot(spark, d), "hot_key", 0.005)


@register(
    "hot_keys_with_blanks",
    f"""SELECT hot_key, count(*) AS row_count, {share('count(*)', '(SELECT count(*) FROM lineitem)')} AS row_share FROM
    (SELECT CASE WHEN l_orderkey % 3 = 0 THEN NULL WHEN l_orderkey % 5 = 0 THEN 'N' ELSE concat(l_returnflag, l_linenumber) END AS hot_key FROM lineitem) GROUP BY 1
    ORDER BY 2 DESC, 1 LIMIT 4""",
)
def hot_keys_with_blanks(spark, d):
    key = "CASE WHEN l_orderkey % 3 = 0 THEN NULL WHEN l_orderkey % 5 = 0 THEN 'N' ELSE concat(l_returnflag, l_linenumber) END"
    return skew.hot_keys(Tables(spark, d).lineitem.select(F.expr(key).alias("hot_key")), "hot_key", 4)
