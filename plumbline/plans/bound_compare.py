"""Comparison queries: links, versions, layers, enum sets, default values."""

from pyspark.sql import functions as F

from plumbline.functions.fixed import MAPPED_GENDERS
from plumbline.operators import compare
from plumbline.plans.registry import Tables, derive, derive_sql, filled, norm, pct, register

#: orders with customers that do not exist and blank keys
CHILD = {
    "o_orderkey": "o_orderkey",
    "cust": "CASE WHEN o_orderkey % 41 = 0 THEN ' ' WHEN o_orderkey % 17 = 0 THEN concat('x', o_custkey) ELSE CAST(o_custkey AS STRING) END",
    "status": "CASE WHEN o_orderkey % 23 = 0 THEN '?' ELSE o_orderstatus END",
    "price": "o_totalprice",
}
PARENT = {"cust": "CAST(c_custkey AS STRING)", "segment": "c_mktsegment", "nation": "c_nationkey", "since": "CASE WHEN c_custkey % 5 = 0 THEN '' ELSE concat('2020-', lpad(CAST(c_custkey % 12 + 1 AS STRING), 2, '0')) END"}
CHILD_SQL, PARENT_SQL = derive_sql("orders", CHILD), derive_sql("customer", PARENT)
WITH = f"WITH c AS ({CHILD_SQL}), p AS ({PARENT_SQL})"


def sides(spark, d):
    t = Tables(spark, d)
    return derive(t.orders, CHILD), derive(t.customer, PARENT)


@register(
    "backlink_anti",
    f"""{WITH}, o AS (SELECT * FROM c WHERE {filled('cust')} AND NOT EXISTS (SELECT 1 FROM p WHERE p.cust = c.cust))
    SELECT 'orders to customer' AS "check", count(*) AS unmatched_rows, count(DISTINCT cust) AS unmatched_keys,
      {pct('count(*)', '(SELECT count(*) FROM c)', 4)} AS unmatched_rate_pct FROM o""",
)
def backlink_anti(spark, d):
    child, parent = sides(spark, d)
    return compare.backlink_check(child, parent, ["cust"], "orders to customer")


PAIR_PARENT = {"cust": "CAST(o_custkey AS STRING)", "status": "o_orderstatus"}


@register(
    "backlink_two_keys",
    f"""{WITH}, q AS ({derive_sql('orders', PAIR_PARENT)}), o AS (SELECT * FROM c WHERE {filled('cust')} AND {filled('status')}
      AND NOT EXISTS (SELECT 1 FROM q WHERE q.cust = c.cust AND q.status = c.status))
    SELECT 'cust and status' AS "check", count(*) AS unmatched_rows, count(DISTINCT concat(cust, '/', status)) AS unmatched_keys,
      {pct('count(*)', '(SELECT count(*) FROM c)', 4)} AS unmatched_rate_pct FROM o""",
)
def backlink_two_keys(spark, d):
    child, _ = sides(spark, d)
    parent = derive(Tables(spark, d).orders, PAIR_PARENT)
    return compare.backlink_check(child, parent, ["cust", "status"], "cust and status")


@register(
    "backlink_samples",
    f"""{WITH} SELECT * FROM c WHERE {filled('cust')} AND NOT EXISTS (SELECT 1 FROM p WHERE p.cust = c.cust)
    ORDER BY cust, o_orderkey LIMIT 20""",
)
def backlink_samples(spark, d):
    child, parent = sides(spark, d)
    return compare.backlink_samples(child, parent, ["cust"], [F.asc("cust"), F.asc("o_orderkey")])


@register(
    "dup_expansion",
    """WITH dup AS (SELECT l_orderkey, count(*) AS dup_cnt FROM lineitem GROUP BY 1 HAVING count(*) > 1 ORDER BY 2 DESC, 1 LIMIT 12)
    SELECT l_orderkey, l_linenumber, l_extendedprice, dup_cnt FROM lineitem JOIN dup USING (l_orderkey)
    ORDER BY dup_cnt DESC, l_orderkey, l_linenumber, l_extendedprice LIMIT 24""",
)
def dup_expansion(spark, d):
    df = Tables(spark, d).lineitem
    out = compare.duplicate_expansion(df, "l_orderkey", [F.asc("l_linenumber"), F.asc("l_extendedprice")])
    return out.select("l_orderkey", "l_linenumber", "l_extendedprice", "dup_cnt")


@register(
    "proxy_freshness",
    f"""{WITH} SELECT min(since) AS min_value, max(since) AS max_value FROM p WHERE {filled('since')} AND EXISTS (SELECT 1 FROM c WHERE c.cust = p.cust)""",
)
def proxy_freshness(spark, d):
    child, parent = sides(spark, d)
    return compare.proxy_freshness(child, parent, "cust", "since")


@register(
    "entity_overlap",
    f"""{WITH} SELECT count(DISTINCT c.cust) AS left_entities, count(DISTINCT CASE WHEN p.cust IS NOT NULL THEN c.cust END) AS matched_entities
    FROM c LEFT JOIN p ON c.cust = p.cust WHERE {filled('c.cust')}""",
)
def entity_overlap(spark, d):
    child, parent = sides(spark, d)
    return compare.entity_overlap(child, parent, "cust")


# --- two versions of lineitem ------------------------------------------------

LEFT = {
    "order_id": "l_orderkey",
    "session": "CAST(l_suppkey AS STRING)",
    "product": "CAST(l_partkey AS STRING)",
    "shop": "CASE WHEN l_orderkey % 4 = 0 THEN NULL ELSE 'shop a' END",
    "pay": "l_extendedprice",
}
RIGHT = {
    "order_id": "l_orderkey",
    "session": "CASE WHEN l_orderkey % 10 = 0 THEN 'other' ELSE CAST(l_suppkey AS STRING) END",
    "product": "CAST(l_partkey AS STRING)",
    "shop": "CASE WHEN l_orderkey % 6 = 0 THEN 'shop b' ELSE 'shop a' END",
    "pay": "CASE WHEN l_orderkey % 8 = 0 THEN l_extendedprice + 0.25 ELSE l_extendedprice END",
}
LEFT_SQL = derive_sql("lineitem", LEFT) + " WHERE l_orderkey % 7 <> 0"
RIGHT_SQL = derive_sql("lineitem", RIGHT) + " WHERE l_orderkey % 5 <> 0"


def side_sql(frame: str, s: str) -> str:
    parts = ", ".join(
        f"count(DISTINCT {a}) AS {s}_{a}_cnt, min({a}) AS {s}_{a}" for a in ("session", "product", "shop")
    )
    return f"""SELECT order_id, count(*) AS {s}_row_cnt, {parts}, round(sum(coalesce(pay, 0)), 2) AS {s}_pay FROM ({frame})
    WHERE order_id IS NOT NULL GROUP BY order_id"""


VERSIONS = f"WITH l AS ({side_sql(LEFT_SQL, 'left')}), r AS ({side_sql(RIGHT_SQL, 'right')})"


def versions(spark, d):
    df = Tables(spark, d).lineitem
    left = derive(df.where("l_orderkey % 7 <> 0"), LEFT)
    return left, derive(df.where("l_orderkey % 5 <> 0"), RIGHT)


@register(
    "table_consistency",
    f"""{VERSIONS} SELECT (SELECT count(*) FROM l) AS left_entities, (SELECT count(*) FROM r) AS right_entities, count(*) AS overlap_entities, """
    + ", ".join(
        f"count(*) FILTER (WHERE left_{a}_cnt = 1 AND right_{a}_cnt = 1 AND coalesce(left_{a}, '') = coalesce(right_{a}, '')) AS exact_{a}_match"
        for a in ("session", "product", "shop")
    )
    + ", count(*) FILTER (WHERE abs(coalesce(left_pay, 0) - coalesce(right_pay, 0)) < 0.01) AS exact_pay_match FROM l JOIN r USING (order_id)",
)
def table_consistency(spark, d):
    return compare.table_consistency(*versions(spark, d), "order_id", ["session", "product", "shop"], "pay")


@register(
    "mismatch_samples",
    f"""{VERSIONS} SELECT order_id, left_row_cnt, right_row_cnt, left_session, right_session, left_product, right_product, left_shop, right_shop,
      left_pay, right_pay FROM l JOIN r USING (order_id)
    WHERE coalesce(left_session, '') <> coalesce(right_session, '') OR coalesce(left_product, '') <> coalesce(right_product, '')
      OR coalesce(left_shop, '') <> coalesce(right_shop, '') OR abs(coalesce(left_pay, 0) - coalesce(right_pay, 0)) >= 0.01
    ORDER BY abs(coalesce(left_pay, 0) - coalesce(right_pay, 0)) DESC, order_id LIMIT 30""",
)
def mismatch_samples(spark, d):
    return compare.mismatch_samples(*versions(spark, d), "order_id", ["session", "product", "shop"], "pay")


@register(
    "frame_diff",
    """WITH o AS (SELECT * REPLACE (CASE WHEN o_orderkey % 5000 = 1 THEN NULL WHEN o_orderkey % 100 = 5 THEN o_orderkey + 1 ELSE o_orderkey END AS o_orderkey), o_orderkey AS k FROM orders),
    ar AS (SELECT o_orderkey, o_orderstatus, o_totalprice FROM o WHERE k % 11 <> 0),
    br AS (SELECT o_orderkey, CASE WHEN k % 13 = 0 THEN 'X' ELSE o_orderstatus END AS o_orderstatus,
        CASE WHEN k % 17 = 0 THEN o_totalprice * 1.01 WHEN k % 19 = 0 THEN o_totalprice * (1 + 1e-9) ELSE o_totalprice END AS o_totalprice
      FROM o WHERE k % 9 <> 0),
    a AS (SELECT o_orderkey, any_value(o_orderstatus) AS o_orderstatus, any_value(o_totalprice) AS o_totalprice, count(*) AS n FROM ar GROUP BY 1),
    b AS (SELECT o_orderkey, any_value(o_orderstatus) AS o_orderstatus, any_value(o_totalprice) AS o_totalprice, count(*) AS n FROM br GROUP BY 1),
    j AS (SELECT coalesce(a.o_orderkey, b.o_orderkey) AS o_orderkey, a.n AS ka, b.n AS kb, coalesce(a.n > 1 OR b.n > 1, false) AS rep,
        a.o_orderstatus IS DISTINCT FROM b.o_orderstatus AS ds,
        NOT coalesce(abs(a.o_totalprice - b.o_totalprice) <= greatest(abs(a.o_totalprice), abs(b.o_totalprice)) * 1e-6, false) AS dp
      FROM a FULL JOIN b ON a.o_orderkey IS NOT DISTINCT FROM b.o_orderkey)
    SELECT o_orderkey, CASE WHEN ka IS NULL THEN 'only_right' WHEN kb IS NULL THEN 'only_left' WHEN rep THEN 'repeated_key' ELSE 'values_differ' END AS difference,
      CASE WHEN ka IS NOT NULL AND kb IS NOT NULL AND NOT rep THEN concat_ws(',', CASE WHEN ds THEN 'o_orderstatus' END, CASE WHEN dp THEN 'o_totalprice' END) END AS columns
    FROM j WHERE ka IS NULL OR kb IS NULL OR rep OR ds OR dp
    UNION ALL SELECT NULL, 'column_only_right', 'k'""",
)
def frame_diff(spark, d):
    k, price = F.col("k"), F.col("o_totalprice")
    key = F.when(k % 5000 == 1, None).when(k % 100 == 5, k + 1).otherwise(k)
    df = Tables(spark, d).orders.withColumn("k", F.col("o_orderkey")).select(key.alias("o_orderkey"), "o_orderstatus", "o_totalprice", "k")
    right = df.where(k % 9 != 0).withColumns(
        {
            "o_orderstatus": F.when(k % 13 == 0, "X").otherwise(F.col("o_orderstatus")),
            "o_totalprice": F.when(k % 17 == 0, price * 1.01).when(k % 19 == 0, price * (1 + 1e-9)).otherwise(price),
        }
    )
    return compare.frame_diff(df.where(k % 11 != 0).drop("k"), right, ["o_orderkey"], ["o_totalprice"])


@register(
    "exact_diff",
    """WITH a AS (SELECT l_suppkey, l_returnflag FROM lineitem WHERE l_orderkey % 3 <> 0),
    b AS (SELECT l_suppkey, l_returnflag FROM lineitem WHERE l_orderkey % 4 <> 0),
    x AS (SELECT l_suppkey, l_returnflag, count(*) AS left_rows FROM a GROUP BY 1, 2), y AS (SELECT l_suppkey, l_returnflag, count(*) AS right_rows FROM b GROUP BY 1, 2)
    SELECT l_suppkey, l_returnflag, coalesce(left_rows, 0) AS left_rows, coalesce(right_rows, 0) AS right_rows
    FROM x FULL JOIN y USING (l_suppkey, l_returnflag) WHERE coalesce(left_rows, 0) <> coalesce(right_rows, 0)""",
)
def exact_diff(spark, d):
    df = Tables(spark, d).lineitem
    columns = ["l_suppkey", "l_returnflag"]
    return compare.exact_diff(
        df.where("l_orderkey % 3 <> 0").select(*columns), df.where("l_orderkey % 4 <> 0").select(*columns)
    )


# --- layers ------------------------------------------------------------------

REF = {"spu": "CASE WHEN l_partkey % 50 = 0 THEN '' ELSE CAST(l_partkey AS STRING) END", "mid": "CASE WHEN l_partkey % 8 = 0 THEN NULL ELSE concat('m', l_partkey % 30) END", "track": "CASE WHEN l_partkey % 9 = 0 THEN ' ' ELSE concat('t', l_suppkey % 12) END"}
SRC = {"spu": "CAST(p_partkey AS STRING)", "mid": "CASE WHEN p_size < 10 THEN NULL ELSE concat('m', p_partkey % 28) END", "sub_track": "CASE WHEN p_size > 45 THEN '' ELSE concat('t', p_size % 10) END"}
RES = {"spu": "CAST(p_partkey AS STRING)", "mid": "CASE WHEN p_size % 5 = 0 THEN '' ELSE concat('m', p_partkey % 25) END", "first_track": "CASE WHEN p_size % 7 = 0 THEN NULL ELSE concat('t', p_size % 11) END"}
SRC_WHERE, RES_WHERE = "p_type <> 'PROMO'", "p_type IN ('PROMO', 'SMALL', 'LARGE')"
LAYERS = f"""WITH rf AS ({derive_sql('lineitem', REF)}), sf AS ({derive_sql('part', SRC)} WHERE {SRC_WHERE}),
 df AS ({derive_sql('part', RES)} WHERE {RES_WHERE})"""


def layers(spark, d):
    t = Tables(spark, d)
    return (
        derive(t.lineitem, REF),
        derive(t.part.where(SRC_WHERE), SRC),
        derive(t.part.where(RES_WHERE), RES),
    )


def joined_layers(spark, d):
    ref, source, result = layers(spark, d)
    return compare.layer_join(
        (ref, "spu", {"mid": "mid", "track": "track"}),
        (source, "spu", {"mid": "mid", "track": "sub_track"}),
        (result, "spu", {"mid": "mid", "track": "first_track"}),
    )


def layer_side_sql(frame: str, track: str, s: str) -> str:
    return f"""SELECT {norm('spu')} AS entity, max({norm('mid')}) AS {s}_mid, max({norm(track)}) AS {s}_track, count(*) AS {s}_rows
    FROM {frame} WHERE {filled('spu')} GROUP BY 1"""


JOINED = f"""{LAYERS}, j AS (SELECT * FROM ({layer_side_sql('rf', 'track', 'ref')}) LEFT JOIN ({layer_side_sql('sf', 'sub_track', 'src')}) USING (entity)
  LEFT JOIN ({layer_side_sql('df', 'first_track', 'res')}) USING (entity))"""


@register(
    "layer_gap",
    f"""{JOINED} SELECT count(*) AS ref_entities, count(ref_mid) AS ref_with_mid, count(ref_track) AS ref_with_track, count(src_rows) AS hit_source,
      count(res_rows) AS hit_result, count(*) FILTER (WHERE ref_mid IS NOT NULL AND src_mid IS NULL) AS missing_mid_in_source,
      count(*) FILTER (WHERE ref_track IS NOT NULL AND src_track IS NULL) AS missing_track_in_source,
      count(*) FILTER (WHERE ref_mid IS NOT NULL AND res_mid IS NULL) AS missing_mid_in_result,
      count(*) FILTER (WHERE ref_track IS NOT NULL AND res_track IS NULL) AS missing_track_in_result,
      count(*) FILTER (WHERE ref_mid IS NOT NULL AND ref_track IS NOT NULL AND (src_mid IS NULL OR src_track IS NULL)) AS any_gap_in_source,
      count(*) FILTER (WHERE ref_mid IS NOT NULL AND ref_track IS NOT NULL AND (res_mid IS NULL OR res_track IS NULL)) AS any_gap_in_result FROM j""",
)
def layer_gap(spark, d):
    return compare.layer_gap(joined_layers(spark, d), ["mid", "track"])


@register(
    "layer_gap_detail",
    f"""{JOINED}, f AS (SELECT entity, ref_mid, ref_track, coalesce(src_mid, '') AS src_mid, coalesce(src_track, '') AS src_track,
      coalesce(res_mid, '') AS res_mid, coalesce(res_track, '') AS res_track, coalesce(src_rows, 0) AS src_rows, coalesce(res_rows, 0) AS res_rows,
      CAST(ref_mid IS NOT NULL AND src_mid IS NULL AS INTEGER) AS missing_mid_in_source,
      CAST(ref_track IS NOT NULL AND src_track IS NULL AS INTEGER) AS missing_track_in_source,
      CAST(ref_mid IS NOT NULL AND res_mid IS NULL AS INTEGER) AS missing_mid_in_result,
      CAST(ref_track IS NOT NULL AND res_track IS NULL AS INTEGER) AS missing_track_in_result FROM j)
    SELECT * FROM f WHERE missing_mid_in_source + missing_track_in_source + missing_mid_in_result + missing_track_in_result > 0""",
)
def layer_gap_detail(spark, d):
    return compare.layer_gap_detail(joined_layers(spark, d), ["mid", "track"])


def vals(frame: str, c: str) -> str:
    return f"SELECT DISTINCT {norm(c)} AS v FROM {frame} WHERE {filled(c)}"


@register(
    "value_gap",
    f"""{LAYERS} SELECT r.v AS mid, CAST(s.v IS NULL AS INTEGER) AS missing_in_source, CAST(e.v IS NULL AS INTEGER) AS missing_in_result
    FROM ({vals('rf', 'mid')}) r LEFT JOIN ({vals('sf', 'mid')}) s ON r.v = s.v LEFT JOIN ({vals('df', 'mid')}) e ON r.v = e.v
    WHERE s.v IS NULL OR e.v IS NULL""",
)
def value_gap(spark, d):
    ref, source, result = layers(spark, d)
    return compare.value_gap((ref, "mid"), (source, "mid"), (result, "mid"), "mid")


def pairs_sql(frame: str, track: str) -> str:
    return f"SELECT DISTINCT {norm('mid')} AS mid, {norm(track)} AS track FROM {frame} WHERE {filled('mid')} AND {filled(track)}"


@register(
    "pair_gap",
    f"""{LAYERS}, r AS (SELECT {norm('mid')} AS mid, {norm('track')} AS track, count(*) AS ref_rows, count(DISTINCT {norm('spu')}) AS ref_entities FROM rf
      WHERE {filled('spu')} AND {filled('mid')} AND {filled('track')} GROUP BY 1, 2)
    SELECT r.mid, r.track, ref_rows, ref_entities, CAST(s.mid IS NULL AS INTEGER) AS missing_in_source, CAST(e.mid IS NULL AS INTEGER) AS missing_in_result
    FROM r LEFT JOIN ({pairs_sql('sf', 'sub_track')}) s ON r.mid = s.mid AND r.track = s.track
      LEFT JOIN ({pairs_sql('df', 'first_track')}) e ON r.mid = e.mid AND r.track = e.track WHERE s.mid IS NULL OR e.mid IS NULL""",
)
def pair_gap(spark, d):
    ref, source, result = layers(spark, d)
    return compare.pair_gap(
        (ref, ["mid", "track"], "spu"), (source, ["mid", "sub_track"]), (result, ["mid", "first_track"]), ["mid", "track"]
    )


# --- enum sets ---------------------------------------------------------------

ENUM = {
    "doc_id": "doc_id",
    "spu": "concat('s', doc_id % 90)",
    "mid": "CASE WHEN doc_id % 15 = 0 THEN '' WHEN doc_id % 4 = 0 THEN concat(' ', source) ELSE lang END",
    "ref_mid": "CASE WHEN doc_id % 22 = 0 THEN NULL WHEN doc_id % 6 = 0 THEN concat('ref', doc_id % 5) ELSE source END",
}
ENUM_SQL = derive_sql("documents", ENUM)


def counts_sql(c: str) -> str:
    return f"""SELECT {norm(c)} AS v, count(*) AS n, count(DISTINCT spu) AS e FROM ({ENUM_SQL}) WHERE {filled(c)} GROUP BY 1"""


ENUM_SIDES = f"WITH t AS ({counts_sql('mid')}), r AS ({counts_sql('ref_mid')})"


def enum_sides(spark, d):
    return compare.enum_sides(derive(Tables(spark, d).documents, ENUM), "mid", "ref_mid", "spu")


@register(
    "enum_gap",
    f"""{ENUM_SIDES} SELECT (SELECT count(*) FROM t) AS target_enum_count, (SELECT count(*) FROM r) AS ref_enum_count,
      (SELECT count(*) FROM r WHERE v NOT IN (SELECT v FROM t)) AS missing_in_target_count,
      (SELECT count(*) FROM t WHERE v NOT IN (SELECT v FROM r)) AS extra_in_target_count""",
)
def enum_gap(spark, d):
    return compare.enum_gap_summary(enum_sides(spark, d))


@register(
    "enum_gap_values",
    f"""{ENUM_SIDES} SELECT 'missing_in_target' AS gap, v AS enum_value, n AS row_count, e AS entity_count FROM r WHERE v NOT IN (SELECT v FROM t)
    UNION ALL SELECT 'extra_in_target', v, n, e FROM t WHERE v NOT IN (SELECT v FROM r)""",
)
def enum_gap_values(spark, d):
    return compare.enum_gap_values(enum_sides(spark, d))


@register(
    "enum_gap_samples",
    f"""{ENUM_SIDES} SELECT doc_id, spu, {norm('ref_mid')} AS reference_value, {norm('mid')} AS target_value FROM ({ENUM_SQL})
    WHERE {norm('ref_mid')} IN (SELECT v FROM r WHERE v NOT IN (SELECT v FROM t)) ORDER BY doc_id LIMIT 20""",
)
def enum_gap_samples(spark, d):
    df = derive(Tables(spark, d).documents, ENUM)
    values = compare.enum_gap_values(compare.enum_sides(df, "mid", "ref_mid", "spu"))
    return compare.enum_gap_samples(
        df, "missing_in_target", values, "mid", "ref_mid", ["doc_id", "spu"], [F.asc("doc_id")]
    )


PICTURE = {"spu": "concat('p', p_partkey % 300)", "file_id": "concat('f', p_partkey)", "mid_cate": "CASE WHEN p_partkey % 20 = 0 THEN ' ' ELSE concat(p_name, ' ', p_type) END"}
VIDEO_SOURCE = {"spu": "concat('p', p_partkey % 200)", "mid_cate": "concat(p_name, ' ', p_type)"}
VIDEO_FINAL = {"spu": "concat('p', p_partkey % 100)", "mid_cate": "concat(p_name, ' ', p_type)"}
COVER = f"""WITH pic AS ({derive_sql('part', PICTURE)}), vs AS ({derive_sql('part', VIDEO_SOURCE)} WHERE p_type IN ('SMALL', 'LARGE')),
 vf AS ({derive_sql('part', VIDEO_FINAL)} WHERE p_type = 'LARGE' AND p_size < 25)"""


def cover(spark, d):
    part = Tables(spark, d).part
    return (
        derive(part, PICTURE),
        derive(part.where("p_type IN ('SMALL', 'LARGE')"), VIDEO_SOURCE),
        derive(part.where("p_type = 'LARGE' AND p_size < 25"), VIDEO_FINAL),
    )


def enum_counts_sql(frame: str, s: str) -> str:
    return f"""SELECT {norm('mid_cate')} AS enum_value, count(*) AS {s}_row_count, count(DISTINCT spu) AS {s}_entity_count FROM {frame}
    WHERE {filled('mid_cate')} GROUP BY 1"""


@register(
    "enum_coverage",
    f"""{COVER}, s AS (SELECT {norm('mid_cate')} AS enum_value, spu, file_id, row_number() OVER (PARTITION BY {norm('mid_cate')} ORDER BY spu, file_id) AS rn
      FROM pic WHERE {filled('mid_cate')})
    SELECT a.*, coalesce(source_row_count, 0) AS source_row_count, coalesce(source_entity_count, 0) AS source_entity_count,
      s1.spu AS sample_spu_1, s1.file_id AS sample_file_id_1, s2.spu AS sample_spu_2, s2.file_id AS sample_file_id_2
    FROM ({enum_counts_sql('pic', 'first')}) a LEFT JOIN ({enum_counts_sql('vs', 'source')}) b USING (enum_value)
      LEFT JOIN ({enum_counts_sql('vf', 'final')}) c USING (enum_value)
      LEFT JOIN s s1 ON s1.enum_value = a.enum_value AND s1.rn = 1 LEFT JOIN s s2 ON s2.enum_value = a.enum_value AND s2.rn = 2
    WHERE c.final_row_count IS NULL""",
)
def enum_coverage(spark, d):
    return compare.enum_coverage(
        *cover(spark, d), "mid_cate", "spu", ["spu", "file_id"], [F.asc("spu"), F.asc("file_id")]
    )


@register(
    "source_only_values",
    f"""{COVER}, s AS ({vals('vs', 'mid_cate')}), f AS ({vals('vf', 'mid_cate')})
    SELECT count(*) AS source_enum_count, count(*) FILTER (WHERE v NOT IN (SELECT v FROM f)) AS source_only_enum_count FROM s""",
)
def source_only_values(spark, d):
    _, source, final = cover(spark, d)
    return compare.source_only_values(source, final, "mid_cate")


# --- default values ----------------------------------------------------------

TARGET = {
    "row_id": "concat(l_orderkey, '-', l_linenumber)",
    "spu": "CASE WHEN l_partkey % 60 = 0 THEN '' WHEN l_partkey % 2 = 0 THEN concat('sp', l_partkey) ELSE concat(' SP', l_partkey) END",
    "gender": "CASE WHEN l_partkey % 3 = 0 THEN '男' WHEN l_partkey % 19 = 0 THEN '' ELSE '无' END",
}
DIMENSION = {
    "spu": "concat('Sp', p_partkey)",
    "used": "CASE p_size % 6 WHEN 0 THEN NULL WHEN 1 THEN ' ' WHEN 2 THEN '无' WHEN 3 THEN '女' WHEN 4 THEN '老年' ELSE '男童' END",
    "alternative": "CASE WHEN p_size % 4 = 0 THEN NULL ELSE '女' END",
}
DEFAULT_SQL = f"""
  WITH t AS (SELECT row_id, upper({norm('spu')}) AS entity FROM ({derive_sql('lineitem', TARGET)}) WHERE {filled('spu')} AND {norm('gender')} = '无'),
  b AS (SELECT upper({norm('spu')}) AS entity, max(trim(alternative)) AS alt, max(trim(used)) AS used FROM
    ({derive_sql('part', DIMENSION)} WHERE p_partkey % 13 <> 0) GROUP BY 1),
  j AS (SELECT t.row_id, t.entity, coalesce(nullif(alt, ''), '<<EMPTY>>') AS alternative_value, coalesce(nullif(used, ''), '<<EMPTY>>') AS used_value,
    CASE WHEN b.entity IS NULL THEN 'NO_DIMENSION_MATCH' WHEN coalesce(used, '') = '' AND coalesce(alt, '') <> '' THEN 'ALTERNATIVE_PRESENT_BUT_USED_EMPTY'
      WHEN coalesce(used, '') = '' THEN 'BOTH_EMPTY' WHEN used = '无' THEN 'USED_IS_DEFAULT'
      WHEN used NOT IN ({', '.join(f"'{g}'" for g in MAPPED_GENDERS)}) THEN 'UNMAPPED_VALUE' ELSE 'OTHER' END AS root_cause
    FROM t LEFT JOIN b ON t.entity = b.entity)"""


def default_args(spark, d):
    t = Tables(spark, d)
    dim = derive(t.part.where("p_partkey % 13 <> 0"), DIMENSION)
    return derive(t.lineitem, TARGET), dim, "spu", "gender", "used", "alternative", MAPPED_GENDERS


@register(
    "default_root_cause",
    f"""{DEFAULT_SQL} SELECT root_cause, count(*) AS row_cnt, count(DISTINCT entity) AS entity_cnt,
      {pct('count(*)', '(SELECT count(*) FROM j)', 4)} AS row_share_pct FROM j GROUP BY 1""",
)
def default_root_cause(spark, d):
    return compare.default_value_summary(*default_args(spark, d), row_id="row_id")


@register(
    "stratified_samples",
    f"""{DEFAULT_SQL} SELECT * FROM (SELECT *, CAST(row_number() OVER (PARTITION BY root_cause ORDER BY row_id, entity) AS INTEGER) AS sample_no FROM j)
    WHERE sample_no <= 8""",
)
def stratified_samples(spark, d):
    causes = compare.default_value_causes(*default_args(spark, d), row_id="row_id")
    return compare.stratified_samples(causes, "root_cause", [F.asc("row_id"), F.asc("entity")], 8)


@register(
    "value_distribution",
    f"""SELECT coalesce({norm('gender')}, '<<EMPTY>>') AS value, count(*) AS row_cnt, count(DISTINCT upper({norm('spu')})) AS entity_cnt
    FROM ({derive_sql('lineitem', TARGET)}) GROUP BY 1""",
)
def value_distribution(spark, d):
    return compare.value_distribution(derive(Tables(spark, d).lineitem, TARGET), "gender", "spu")


# --- coverage and classes ----------------------------------------------------


@register(
    "source_coverage",
    """SELECT 'orders' AS source, count(*) AS row_count, count(DISTINCT o_orderkey) AS distinct_ids, CAST(min(o_orderdate) AS STRING) AS min_date,
      CAST(max(o_orderdate) AS STRING) AS max_date FROM orders
    UNION ALL SELECT 'lineitem', count(*), count(DISTINCT l_orderkey), CAST(min(l_shipdate) AS STRING), CAST(max(l_shipdate) AS STRING) FROM lineitem
    UNION ALL SELECT 'events', count(*), count(DISTINCT event_id), CAST(min(ts) AS STRING), CAST(max(ts) AS STRING) FROM events""",
)
def source_coverage(spark, d):
    t = Tables(spark, d)
    return compare.source_coverage(
        [
            ("orders", t.orders, "o_orderkey", "o_orderdate"),
            ("lineitem", t.lineitem, "l_orderkey", "l_shipdate"),
            ("events", t.events, "event_id", "ts"),
        ]
    )


CLASS_WHERE = {
    "source": "p_partkey % 7 <> 0", "result": "p_partkey % 5 <> 0", "reference": "p_partkey % 3 <> 0", "rules": "p_partkey % 2 = 0",
}


@register(
    "gap_classification",
    "WITH v AS (SELECT DISTINCT p_partkey AS value FROM part), f AS (SELECT value, "
    + ", ".join(f"{w.replace('p_partkey', 'value')} AS in_{n}" for n, w in CLASS_WHERE.items())
    + """ FROM v) SELECT *, CASE WHEN NOT in_source THEN 'missing_in_source' WHEN NOT in_result THEN 'lost_in_result'
      WHEN NOT in_reference THEN 'absent_from_reference' WHEN NOT in_rules THEN 'uncovered_by_rules' ELSE 'complete' END AS gap_class FROM f""",
)
def gap_classification(spark, d):
    values = Tables(spark, d).part.select(F.col("p_partkey").alias("value"))
    layers_ = {n: values.where(w.replace("p_partkey", "value")) for n, w in CLASS_WHERE.items()}
    return compare.gap_classification(values, layers_)
