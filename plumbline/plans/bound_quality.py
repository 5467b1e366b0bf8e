"""Quality checks over lineitem, orders, customer, documents, events and derived files."""

from pyspark.sql import functions as F

from plumbline.functions.columns import contains_any, is_blank, keyword_flag, orientation, published_flag
from plumbline.functions.fixed import IMAGE_EXTENSIONS, VIDEO_EXTENSIONS, VIDEO_SUFFIX_CHECK
from plumbline.operators import compare, ordered, quality, rules
from plumbline.plans import quality_run
from plumbline.plans.bound_mapping import BASE_SQL, detail
from plumbline.plans.registry import (
    EVENTS, EVENTS_SQL, FILES, Tables, big, derive, derive_sql, events_frame, filled, pct, register,
)
from plumbline.sources import tables as src

FILES_SQL = derive_sql("documents", FILES)
#: documents with dirty text put in by fixed rules
DIRTY = {
    "doc_id": "doc_id",
    "note": "CASE doc_id % 8 WHEN 0 THEN NULL WHEN 1 THEN ' ' WHEN 2 THEN concat(' ', source) WHEN 3 THEN concat(lang, '    ', source) "
    "WHEN 4 THEN concat(source, chr(7)) WHEN 5 THEN text ELSE source END",
    "text": "text",
    "lang": "CASE WHEN doc_id % 12 = 0 THEN '' ELSE lang END",
    "source": "CASE WHEN doc_id % 10 = 3 THEN NULL ELSE source END",
    "n_chars": "CASE WHEN doc_id % 3 = 0 THEN NULL ELSE n_chars END",
    "length_text": "CASE WHEN doc_id % 6 = 1 THEN concat(n_chars, ' chars') WHEN doc_id % 31 = 0 THEN '--' ELSE CAST(n_chars AS STRING) END",
    "data_date": "CASE WHEN doc_id % 14 = 0 THEN '' ELSE concat('2024-0', doc_id % 9 + 1, '-11') END",
    "is_delete": "CASE WHEN doc_id % 5 = 0 THEN 'true' WHEN doc_id % 7 = 0 THEN NULL ELSE 'false' END",
}
DIRTY_SQL = derive_sql("documents", DIRTY)


def dirty(t: Tables):
    return derive(t.documents, DIRTY)


def files(t: Tables):
    return derive(t.documents, FILES)


def rows_sql(parts: list[str]) -> str:
    return " UNION ALL ".join(parts)


def null_sql(frame: str, columns: dict[str, bool], decimals: int = 2) -> str:
    parts = []
    for c, is_text in columns.items():
        miss = f"count(*) FILTER (WHERE NOT {filled(c)})" if is_text else f"count(*) FILTER (WHERE {c} IS NULL)"
        parts.append(
            f"SELECT '{c}' AS column_name, count(*) AS total_rows, {miss} AS null_rows, {pct(miss, 'count(*)', decimals)} AS null_pct FROM f"
        )
    return f"WITH f AS ({frame}) {rows_sql(parts)}"


DIRTY_TYPES = {
    "doc_id": False, "note": True, "text": True, "lang": True, "source": True, "n_chars": False,
    "length_text": True, "data_date": True, "is_delete": True,
}


@register("row_count", "SELECT count(*) AS total_rows FROM lineitem")
def row_count(spark, d):
    return quality.row_count(Tables(spark, d).lineitem)


@register("null_rates", null_sql(DIRTY_SQL, DIRTY_TYPES))
def null_rates(spark, d):
    return quality.null_rates(dirty(Tables(spark, d)))


@register("high_null", f"SELECT * FROM ({null_sql(DIRTY_SQL, DIRTY_TYPES)}) WHERE null_pct > 12")
def high_null(spark, d):
    return quality.high_null(quality.null_rates(dirty(Tables(spark, d))), 12)


@register(
    "duplicate_keys",
    "SELECT l_orderkey, count(*) AS dup_cnt FROM lineitem WHERE l_orderkey IS NOT NULL GROUP BY 1 HAVING count(*) > 1 ORDER BY 2 DESC, 1 LIMIT 20",
)
def duplicate_keys(spark, d):
    return quality.duplicate_keys(Tables(spark, d).lineitem, "l_orderkey")


def dup_sql(frame: str, keys: list[str]) -> str:
    return f"WITH f AS ({frame}) " + rows_sql(
        [
            f"""SELECT '{k}' AS key_name, count(DISTINCT {k}) AS distinct_keys, count({k}) AS total_keys,
            {pct(f'count({k}) - count(DISTINCT {k})', f'count({k})')} AS dup_rate_pct,
            count(*) - count(DISTINCT {k}) AS expansion_rows FROM f"""
            for k in keys
        ]
    )


@register("key_duplication", dup_sql(FILES_SQL, ["platform_source_id", "file_id", "spu"]))
def key_duplication(spark, d):
    return quality.key_duplication(files(Tables(spark, d)), ["platform_source_id", "file_id", "spu"])


def composite_sql(frame: str, keys: list[str]) -> str:
    row = ", ".join(f"coalesce(CAST({k} AS STRING), '')" for k in keys)
    return f"""WITH f AS ({frame}), g AS (SELECT count(*) AS n FROM f GROUP BY {row})
    SELECT '({', '.join(keys)})' AS key_definition, {big('coalesce(sum(n), 0)')} AS total_rows, count(*) AS distinct_keys,
      {big('coalesce(sum(n), 0) - count(*)')} AS duplicate_rows, {pct('sum(n) - count(*)', 'sum(n)', 4)} AS duplicate_rate_pct FROM g"""


@register("composite_key", composite_sql("SELECT * FROM lineitem", ["l_orderkey", "l_linenumber"]))
def composite_key(spark, d):
    return quality.composite_key(Tables(spark, d).lineitem, ["l_orderkey", "l_linenumber"])


@register("composite_key_nulls", composite_sql(FILES_SQL, ["file_id", "platform_source_id", "spu"]))
def composite_key_nulls(spark, d):
    return quality.composite_key(files(Tables(spark, d)), ["file_id", "platform_source_id", "spu"])


NUMBERS = ["l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_linenumber"]


@register(
    "numeric_profile",
    rows_sql(
        [
            f"""SELECT '{c}' AS column_name, CAST(min({c}) AS DOUBLE) AS min_value, CAST(max({c}) AS DOUBLE) AS max_value,
            round(avg({c}), 2) AS avg_value, round(stddev_samp({c}), 2) AS stddev_value,
            count(*) FILTER (WHERE isnan(CAST({c} AS DOUBLE))) AS nan_count FROM lineitem"""
            for c in NUMBERS
        ]
    ),
)
def numeric_profile(spark, d):
    return quality.numeric_profile(Tables(spark, d).lineitem, NUMBERS)


def iqr_sql(table: str, columns: list[str]) -> str:
    parts = []
    for c in columns:
        out = "count(*) FILTER (WHERE v < q1 - r OR v > q3 + r)"
        parts.append(
            f"""SELECT '{c}' AS column_name, round(any_value(q1), 6) AS q1, round(any_value(q3), 6) AS q3, round(any_value(q1 - r), 6) AS lower_fence,
            round(any_value(q3 + r), 6) AS upper_fence, count(*) AS value_count, {out} AS outlier_count, {pct(out, 'count(*)', 4)} AS outlier_pct,
            (SELECT count(*) FROM {table} WHERE isnan(CAST({c} AS DOUBLE))) AS nan_count
            FROM (SELECT CAST({c} AS DOUBLE) AS v FROM {table} WHERE {c} IS NOT NULL AND NOT isnan(CAST({c} AS DOUBLE))),
                 (SELECT q1, q3, (q3 - q1) * 1.5 AS r FROM (SELECT quantile_cont(CAST({c} AS DOUBLE), 0.25) AS q1,
                    quantile_cont(CAST({c} AS DOUBLE), 0.75) AS q3 FROM {table} WHERE NOT isnan(CAST({c} AS DOUBLE))))"""
        )
    return rows_sql(parts)


@register("iqr_outliers", iqr_sql("lineitem", NUMBERS[:2] + ["l_tax"]))
def iqr_outliers(spark, d):
    return quality.iqr_outliers(Tables(spark, d).lineitem, NUMBERS[:2] + ["l_tax"])


@register("iqr_outliers_spread", iqr_sql("orders", ["o_totalprice"]))
def iqr_outliers_spread(spark, d):
    return quality.iqr_outliers(Tables(spark, d).orders, ["o_totalprice"])


@register("iqr_outliers_customer", iqr_sql("customer", ["c_acctbal", "c_nationkey"]))
def iqr_outliers_customer(spark, d):
    return quality.iqr_outliers(Tables(spark, d).customer, ["c_acctbal", "c_nationkey"])


#: a seventh without a number, some infinite ones
SPOILT = {
    "price": "CASE WHEN l_orderkey % 7 = 0 THEN CAST('NaN' AS DOUBLE) WHEN l_orderkey % 40 = 1 THEN CAST('Infinity' AS DOUBLE) ELSE CAST(l_extendedprice AS DOUBLE) END",
    "tax": "CASE WHEN l_orderkey % 50 = 3 THEN CAST('-Infinity' AS DOUBLE) WHEN l_orderkey % 3 = 0 THEN NULL ELSE CAST(l_tax AS DOUBLE) END",
}


@register("iqr_outliers_nan", iqr_sql(f"({derive_sql('lineitem', SPOILT)})", list(SPOILT)))
def iqr_outliers_nan(spark, d):
    return quality.iqr_outliers(derive(Tables(spark, d).lineitem, SPOILT))


def dirty_sql(limit: int) -> str:
    parts = []
    for c in ("note", "text", "lang", "source"):
        ok = filled(c)
        parts.append(
            f"""SELECT '{c}' AS column_name,
            count(*) FILTER (WHERE {ok} AND regexp_matches({c}, '[\\x00-\\x08\\x0B\\x0C\\x0E-\\x1F]')) AS control_chars,
            count(*) FILTER (WHERE {ok} AND regexp_matches({c}, '[ \\t\\n\\x0B\\f\\r]{{3,}}')) AS excess_whitespace,
            count(*) FILTER (WHERE {ok} AND length({c}) > {limit}) AS overlong_values,
            count(*) FILTER (WHERE {ok} AND {c} <> trim({c})) AS trim_issues FROM f"""
        )
    return f"WITH f AS ({DIRTY_SQL}) {rows_sql(parts)}"


@register("dirty_strings", dirty_sql(1000))
def dirty_strings(spark, d):
    return quality.dirty_strings(dirty(Tables(spark, d)), ["note", "text", "lang", "source"])


@register("dirty_strings_500", dirty_sql(500))
def dirty_strings_500(spark, d):
    return quality.dirty_strings(dirty(Tables(spark, d)), ["note", "text", "lang", "source"], max_length=500)


def sanity_sql(table: str, c: str, as_of: str, floor: str) -> str:
    return f"""SELECT '{c}' AS column_name, count(*) FILTER (WHERE {c} > TIMESTAMP '{as_of}') AS future_dates,
    count(*) FILTER (WHERE {c} < TIMESTAMP '{floor}') AS ancient_dates, CAST(min({c}) AS STRING) AS earliest,
    CAST(max({c}) AS STRING) AS latest FROM {table}"""


@register("time_sanity", sanity_sql("events", "ts", "2024-01-25 12:00:00", "2024-01-03"))
def time_sanity(spark, d):
    return quality.time_sanity(Tables(spark, d).events, "2024-01-25 12:00:00", floor="2024-01-03")


@register("time_sanity_lineitem", sanity_sql("lineitem", "l_shipdate", "2001-01-01", "1996-06-30"))
def time_sanity_lineitem(spark, d):
    return quality.time_sanity(Tables(spark, d).lineitem, "2001-01-01", floor="1996-06-30")


@register(
    "time_text_range",
    f"""WITH f AS ({FILES_SQL}) """
    + rows_sql(
        [
            f"""SELECT '{c}' AS column_name, min({c}) AS earliest, max({c}) AS latest, count(DISTINCT {c}) AS distinct_values
            FROM f WHERE {filled(c)}"""
            for c in ("data_update_time", "image_modify_time")
        ]
    ),
)
def time_text_range(spark, d):
    return quality.time_text_range(files(Tables(spark, d)))


@register(
    "enum_top",
    """WITH v AS (SELECT 'l_returnflag' AS column_name, l_returnflag AS value FROM lineitem UNION ALL
      SELECT 'l_linestatus', l_linestatus FROM lineitem UNION ALL SELECT 'l_suppkey', CAST(l_suppkey AS STRING) FROM lineitem),
    c AS (SELECT column_name, value, count(*) AS cnt FROM v WHERE value IS NOT NULL GROUP BY 1, 2)
    SELECT column_name, value, cnt FROM (SELECT *, row_number() OVER (PARTITION BY column_name ORDER BY cnt DESC, value) AS rn FROM c)
    WHERE rn <= 20""",
)
def enum_top(spark, d):
    return quality.enum_top(Tables(spark, d).lineitem, ["l_returnflag", "l_linestatus", "l_suppkey"])


@register(
    "fill_metrics",
    f"WITH f AS (SELECT * FROM ({FILES_SQL}) WHERE file_type = '图片') "
    + rows_sql(
        [
            f"""SELECT '{c}' AS field_name, true AS exists, count(*) FILTER (WHERE {filled(c)}) AS fill_rows,
            count(*) FILTER (WHERE NOT {filled(c)}) AS miss_rows, {pct(f'count(*) FILTER (WHERE NOT {filled(c)})', 'count(*)', 4)} AS miss_rate_pct,
            '' AS note FROM f"""
            for c in ("file_id", "platform_source_id", "spu", "folder_path")
        ]
        + ["SELECT 'weight_factor', false, NULL, NULL, NULL, 'schema missing'"]
    ),
)
def fill_metrics(spark, d):
    fields = ["file_id", "platform_source_id", "spu", "folder_path", "weight_factor"]
    return quality.fill_metrics(files(Tables(spark, d)), fields, F.col("file_type") == "图片")


@register(
    "fill_distribution",
    f"""WITH f AS ({FILES_SQL}), v AS (SELECT 'lang' AS field_name, lang AS label_value FROM f UNION ALL SELECT 'spu', spu FROM f
      UNION ALL SELECT 'file_type', file_type FROM f), c AS (SELECT field_name, label_value, count(*) AS cnt FROM v
      WHERE {filled('label_value')} GROUP BY 1, 2)
    SELECT field_name, label_value, cnt FROM (SELECT *, row_number() OVER (PARTITION BY field_name ORDER BY cnt DESC, label_value) AS rn
      FROM c) WHERE rn <= 8""",
)
def fill_distribution(spark, d):
    return quality.fill_distribution(files(Tables(spark, d)), ["lang", "spu", "file_type"])


@register(
    "derived_flags",
    f"""WITH f AS (SELECT doc_id, n_chars, doc_id % 900 AS width, data_update_time, file_name FROM (SELECT *, length(text) AS tl FROM documents)
        JOIN (SELECT doc_id AS k, data_update_time, file_name FROM ({FILES_SQL})) ON doc_id = k)
    SELECT CASE WHEN {filled('data_update_time')} THEN '已发' ELSE '未发' END AS published,
      CASE WHEN width > n_chars THEN '横屏' WHEN width < n_chars THEN '竖屏' WHEN width = n_chars THEN '方图' ELSE '未知' END AS orientation,
      CASE WHEN file_name LIKE '%doc1%' THEN '是' ELSE '否' END AS is_doc1, count(*) AS row_count FROM f GROUP BY 1, 2, 3""",
)
def derived_flags(spark, d):
    columns = FILES | {"n_chars": "n_chars", "width": "doc_id % 900"}
    df = derive(Tables(spark, d).documents, columns)
    return df.groupBy(
        published_flag("data_update_time").alias("published"),
        orientation("width", "n_chars").alias("orientation"),
        keyword_flag("file_name", "doc1", "是", "否").alias("is_doc1"),
    ).agg(F.count(F.lit(1)).alias("row_count"))


@register(
    "freshness",
    f"WITH f AS ({FILES_SQL}) "
    + rows_sql(
        [
            f"SELECT '{c}' AS column_name, min({c}) AS min_value, max({c}) AS max_value FROM f WHERE {filled(c)}"
            for c in ("data_update_time", "image_modify_time", "file_id")
        ]
    ),
)
def freshness(spark, d):
    return quality.freshness(files(Tables(spark, d)), ["data_update_time", "image_modify_time", "file_id"])


MISSING = ["platform_source_id", "folder_path", "file_name", "full_path", "spu", "data_update_time"]


@register(
    "missing_fields_sample",
    f"""WITH f AS (SELECT doc_id, file_id, CAST({' + '.join(f'CASE WHEN {filled(c)} THEN 0 ELSE 1 END' for c in MISSING)} AS INTEGER) AS missing_count
      FROM ({FILES_SQL})) SELECT * FROM f WHERE missing_count > 0 ORDER BY missing_count DESC, file_id, doc_id LIMIT 24""",
)
def missing_fields_sample(spark, d):
    out = quality.missing_fields_sample(files(Tables(spark, d)), MISSING, ["file_id", "doc_id"])
    return out.select("doc_id", "file_id", "missing_count")


@register(
    "parse_validity",
    f"""SELECT length_text AS value, count(*) AS cnt FROM ({DIRTY_SQL}) WHERE length_text IS NOT NULL
    AND NOT regexp_matches(length_text, '^-?[0-9]+\\.?[0-9]*$') GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 20""",
)
def parse_validity(spark, d):
    return quality.parse_validity(dirty(Tables(spark, d)), "length_text")


@register(
    "type_conflict",
    f"""SELECT doc_id, file_type, full_path FROM ({FILES_SQL}) WHERE file_type = '图片'
    AND regexp_matches(lower(full_path), '\\.({'|'.join(VIDEO_SUFFIX_CHECK)})$')""",
)
def type_conflict(spark, d):
    df = files(Tables(spark, d))
    return quality.type_conflict(df, "file_type", "图片", "full_path").select("doc_id", "file_type", "full_path")


@register(
    "keyword_values",
    """SELECT p_name, count(*) AS row_cnt FROM part WHERE p_name IS NOT NULL AND trim(p_name) <> '' AND contains(p_name, 'ring')
    GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 50""",
)
def keyword_values(spark, d):
    return quality.keyword_values(Tables(spark, d).part, "p_name", "ring", 50)


@register(
    "temporal_order",
    f"""SELECT 'ship_after_order' AS "check", count(*) FILTER (WHERE o_orderdate IS NOT NULL AND l_shipdate IS NOT NULL) AS compared_rows,
      count(*) FILTER (WHERE l_shipdate < o_orderdate) AS bad_rows,
      {pct('count(*) FILTER (WHERE l_shipdate < o_orderdate)', 'count(*) FILTER (WHERE o_orderdate IS NOT NULL AND l_shipdate IS NOT NULL)', 4)} AS bad_rate_pct
    FROM lineitem JOIN orders ON l_orderkey = o_orderkey""",
)
def temporal_order(spark, d):
    t = Tables(spark, d)
    joined = t.lineitem.join(t.orders, F.col("l_orderkey") == F.col("o_orderkey"))
    return quality.temporal_order(joined, {"ship_after_order": ("o_orderdate", "l_shipdate")})


RANGES = {"o_totalprice": (2000.0, 450000.0), "o_custkey": (10.0, None)}


@register(
    "range_validity",
    f"""SELECT 'o_totalprice' AS column_name, count(o_totalprice) AS value_count, count(*) FILTER (WHERE o_totalprice < 2000) AS below_range,
      count(*) FILTER (WHERE o_totalprice > 450000) AS above_range,
      {pct('count(*) FILTER (WHERE o_totalprice < 2000 OR o_totalprice > 450000)', 'count(o_totalprice)', 4)} AS invalid_pct FROM orders
    UNION ALL SELECT 'o_custkey', count(o_custkey), count(*) FILTER (WHERE o_custkey < 10), 0,
      {pct('count(*) FILTER (WHERE o_custkey < 10)', 'count(o_custkey)', 4)} FROM orders""",
)
def range_validity(spark, d):
    return quality.range_validity(Tables(spark, d).orders, RANGES)


def coverage_sql(keys: list[str]) -> str:
    return f"WITH f AS ({FILES_SQL}) " + rows_sql(
        [
            f"""SELECT '{k}' AS key_name, count(*) AS total_rows, count(*) FILTER (WHERE NOT {filled(k)}) AS blank_rows,
            {pct(f'count(*) FILTER (WHERE NOT {filled(k)})', 'count(*)', 4)} AS blank_rate_pct FROM f"""
            for k in keys
        ]
    )


KEYS = ["file_id", "platform_source_id", "spu"]


@register("key_coverage", coverage_sql(KEYS))
def key_coverage(spark, d):
    return quality.key_coverage(files(Tables(spark, d)), KEYS)


@register(
    "check_verdicts",
    f"""SELECT key_name AS "check", 'files' AS scope,
      CASE WHEN blank_rows > 0 THEN CASE WHEN key_name = 'spu' THEN 'medium' ELSE 'high' END ELSE 'low' END AS severity,
      CASE WHEN blank_rows > 0 THEN 'fail' ELSE 'pass' END AS status, blank_rows AS row_count, blank_rate_pct AS row_rate_pct,
      'bridge_key_missing' AS bucket, concat('blank rate of ', key_name) AS detail FROM ({coverage_sql(KEYS)})""",
)
def check_verdicts(spark, d):
    metrics = quality.key_coverage(files(Tables(spark, d)), KEYS)
    name = F.col("key_name")
    return rules.verdicts(
        metrics, name, "blank_rows", "total_rows", F.when(name == "spu", "medium").otherwise("high"), "files",
        F.concat(F.lit("blank rate of "), name), F.lit("bridge_key_missing"),
    ).drop("sample")


# --- file projection ---------------------------------------------------------

LIST = {"image": IMAGE_EXTENSIONS, "video": VIDEO_EXTENSIONS}
IN = {k: "(" + ", ".join(f"'{e}'" for e in v) + ")" for k, v in LIST.items()}
CONCAT = f"({filled('folder_path')} AND {filled('file_name')})"
PROJECTED_SQL = f"""
  SELECT *, lower(regexp_extract(full_path_std, '\\.([A-Za-z0-9]{{2,8}})$', 1)) AS path_ext_std,
    coalesce(regexp_matches(full_path_std, '\\.[A-Za-z0-9]{{2,8}}$'), false) AS folder_suffix
  FROM (SELECT *, CASE WHEN {CONCAT} THEN concat(folder_path, chr(92), file_name) ELSE full_path END AS full_path_std,
      coalesce(data_update_time, image_modify_time) AS image_update_time,
      {CONCAT} AS use_concat_path, NOT {CONCAT} AS fallback_to_full_path,
      coalesce({filled('full_path')} AND {filled('file_name')} AND lower(regexp_extract(full_path, '([^\\\\/]+)$', 1)) <> lower(file_name), false)
        AS basename_conflict
    FROM ({FILES_SQL}) WHERE file_type = '图片')"""
FAMILY_SQL = f"""CASE WHEN path_ext_std IN {IN['image']} THEN 'image' WHEN path_ext_std IN {IN['video']} THEN 'video'
  WHEN path_ext_std = '' THEN 'none' ELSE 'other' END"""


def projected(t: Tables):
    return rules.file_projection(files(t).where(F.col("file_type") == "图片"))


HEALTH = {
    "full_path_std_filled": f"count(*) FILTER (WHERE {filled('full_path_std')})",
    "use_concat_path": "count(*) FILTER (WHERE use_concat_path)",
    "fallback_to_full_path": "count(*) FILTER (WHERE fallback_to_full_path)",
    "basename_conflict": "count(*) FILTER (WHERE basename_conflict)",
    "update_time_filled": f"count(*) FILTER (WHERE {filled('image_update_time')})",
    "folder_suffix": "count(*) FILTER (WHERE folder_suffix)",
    "video_suffix": f"count(*) FILTER (WHERE path_ext_std IN ({', '.join(repr(x) for x in VIDEO_EXTENSIONS)}))",
    "distinct_file_id": "count(DISTINCT file_id)",
    "distinct_source_id": "count(DISTINCT platform_source_id)",
}
HEALTH_SQL = f"WITH p AS ({PROJECTED_SQL}) " + rows_sql(
    [f"SELECT '{m}' AS metric, {e} AS row_count, {pct(e, 'count(*)')} AS row_rate_pct, count(*) AS total_rows FROM p" for m, e in HEALTH.items()]
)


@register("health_metrics", HEALTH_SQL)
def health_metrics(spark, d):
    return rules.health_metrics(projected(Tables(spark, d)))


@register(
    "health_findings",
    f"""SELECT metric AS "check", 'files' AS scope, 'medium' AS severity, 'fail' AS status, row_count, row_rate_pct,
      CAST(NULL AS STRING) AS bucket, CASE metric WHEN 'fallback_to_full_path' THEN 'fallback_to_full_path rate >= 20.0'
        WHEN 'update_time_filled' THEN 'update_time_filled rate < 95.0' WHEN 'full_path_std_filled' THEN 'full_path_std_filled rate < 99.0'
        ELSE concat(metric, ' rate > 0.0') END AS detail FROM ({HEALTH_SQL})
    WHERE (metric = 'fallback_to_full_path' AND row_count * 100 >= 20 * total_rows) OR (metric = 'update_time_filled' AND row_count * 100 < 95 * total_rows)
      OR (metric = 'full_path_std_filled' AND row_count * 100 < 99 * total_rows) OR (metric IN ('folder_suffix', 'video_suffix') AND row_count > 0)""",
)
def health_findings(spark, d):
    return rules.health_findings(rules.health_metrics(projected(Tables(spark, d))), scope="files").drop("sample")


@register(
    "extension_distribution",
    f"""SELECT coalesce(path_ext_std, '') AS path_ext_std, {FAMILY_SQL} AS path_suffix_family, count(*) AS row_count
    FROM ({PROJECTED_SQL}) GROUP BY 1, 2 ORDER BY 3 DESC, 1, 2 LIMIT 30""",
)
def extension_distribution(spark, d):
    return rules.extension_distribution(projected(Tables(spark, d)))


@register(
    "file_names",
    f"""SELECT doc_id, full_path_std, coalesce(file_name, regexp_extract(full_path_std, '([^\\\\/]+)$', 1)) AS file_name_std, path_ext_std,
      lower(regexp_extract(coalesce(file_name, regexp_extract(full_path_std, '([^\\\\/]+)$', 1)), '\\.([A-Za-z0-9]{{2,8}})$', 1)) AS file_name_ext_std,
      use_concat_path, basename_conflict FROM ({PROJECTED_SQL})""",
)
def file_names(spark, d):
    return projected(Tables(spark, d)).select(
        "doc_id", "full_path_std", "file_name_std", "path_ext_std", "file_name_ext_std", "use_concat_path", "basename_conflict"
    )


RULES_SQL = {
    "VIDEO_SUFFIX_IN_IMAGE_SET": ("high", f"path_ext_std IN {IN['video']}"),
    "TARGET_FOLDER_FIELD_SUFFIX_RISK": ("high", "folder_suffix"),
    "UNKNOWN_SUFFIX_IN_IMAGE_SET": ("medium", f"path_ext_std <> '' AND path_ext_std NOT IN {IN['image']} AND path_ext_std NOT IN {IN['video']}"),
    "FALLBACK_TO_FULL_PATH": ("medium", "fallback_to_full_path"),
    "BASENAME_CONFLICT": ("medium", "basename_conflict"),
    "MISSING_IMAGE_UPDATE_TIME": ("medium", f"NOT {filled('image_update_time')}"),
    "MISSING_STANDARD_PATH": ("high", f"NOT {filled('full_path_std')}"),
}


@register(
    "rule_checks",
    f"""WITH p AS ({PROJECTED_SQL}), r AS (
    {rows_sql([f"SELECT '{c}' AS code, '{s}' AS severity, count(*) AS total_rows, count(*) FILTER (WHERE {w}) AS row_count, {pct(f'count(*) FILTER (WHERE {w})', 'count(*)')} AS row_rate_pct FROM p" for c, (s, w) in RULES_SQL.items()])})
    SELECT *, CAST(row_number() OVER (ORDER BY CASE severity WHEN 'high' THEN 0 WHEN 'medium' THEN 1 ELSE 2 END, row_count DESC, code) AS INTEGER) AS rank
    FROM r""",
)
def rule_checks(spark, d):
    return rules.rule_checks(projected(Tables(spark, d)), rules.file_rules())


def rule_sample_sql(n: int) -> str:
    parts = []
    for code, (_, where) in RULES_SQL.items():
        newest = "" if code.startswith("MISSING") else "image_update_time DESC NULLS LAST, "
        order = f"{newest}file_id DESC NULLS LAST, platform_source_id DESC NULLS LAST"
        parts.append(
            f"""SELECT * FROM (SELECT '{code}' AS code, CAST(row_number() OVER (ORDER BY {order}) AS INTEGER) AS sample_no,
            file_id, image_update_time FROM p WHERE {where}) WHERE sample_no <= {n}"""
        )
    return f"WITH p AS ({PROJECTED_SQL}) {rows_sql(parts)}"


@register("rule_samples", rule_sample_sql(10))
def rule_samples(spark, d):
    return rules.rule_samples(projected(Tables(spark, d)), rules.file_rules(), ["file_id", "image_update_time"], 10)


@register(
    "failing_samples",
    f"""SELECT doc_id, file_id, file_type, image_modify_time FROM ({FILES_SQL}) WHERE NOT {filled('platform_source_id')}
    ORDER BY image_modify_time DESC NULLS LAST, file_id DESC NULLS LAST, doc_id LIMIT 24""",
)
def failing_samples(spark, d):
    order = [F.desc("image_modify_time"), F.desc("file_id"), F.asc("doc_id")]
    rows = rules.failing_rows(files(Tables(spark, d)), is_blank("platform_source_id"), order, 24)
    return rows.select("doc_id", "file_id", "file_type", "image_modify_time")


@register(
    "root_cause_buckets",
    f"""WITH p AS ({PROJECTED_SQL}) SELECT CASE WHEN path_ext_std IN {IN['video']} THEN 'source_pollution' WHEN basename_conflict THEN 'mapping_mistake'
      WHEN NOT {filled('platform_source_id')} THEN 'bridge_key_missing' WHEN NOT {filled('spu')} THEN 'wrong_grain'
      WHEN path_ext_std = '' THEN 'rule_coverage_gap' WHEN contains(coalesce(full_path, ''), '%') THEN 'display_formatting' END AS bucket,
      count(*) AS row_count FROM p GROUP BY 1""",
)
def root_cause_buckets(spark, d):
    p = projected(Tables(spark, d))
    ext = F.col("path_ext_std")
    cause = rules.root_cause(
        ext.isin(VIDEO_EXTENSIONS), F.col("basename_conflict"), is_blank("platform_source_id"), is_blank("spu"),
        ext == "", contains_any(["full_path"], "%"),
    )
    return p.groupBy(cause.alias("bucket")).agg(F.count(F.lit(1)).alias("row_count"))


# --- base frames -------------------------------------------------------------


@register(
    "soft_delete_filter",
    f"""SELECT 'keep_null' AS mode, count(*) AS row_count FROM ({DIRTY_SQL}) WHERE coalesce(is_delete, 'false') <> 'true'
    UNION ALL SELECT 'drop_null', count(*) FROM ({DIRTY_SQL}) WHERE is_delete = 'false'""",
)
def soft_delete_filter(spark, d):
    df = dirty(Tables(spark, d))
    kept = [
        src.drop_deleted(df, keep_null=keep).agg(F.count(F.lit(1)).alias("row_count")).select(F.lit(m).alias("mode"), "row_count")
        for m, keep in (("keep_null", True), ("drop_null", False))
    ]
    return kept[0].unionByName(kept[1])


@register(
    "date_range_filter",
    f"""SELECT 'typed' AS kind, count(*) AS row_count FROM lineitem WHERE l_shipdate >= '1997-01-01' AND l_shipdate < '1997-04-01'
    UNION ALL SELECT 'text', count(*) FROM ({BASE_SQL}) WHERE pay_date BETWEEN '1997-01-01' AND '1997-03-31'""",
)
def date_range_filter(spark, d):
    t = Tables(spark, d)
    typed = src.date_range(t.lineitem, "l_shipdate", "1997-01-01", "1997-03-31")
    text = src.date_range(detail(t), "pay_time", "1997-01-01", "1997-03-31")
    one = [
        df.agg(F.count(F.lit(1)).alias("row_count")).select(F.lit(k).alias("kind"), "row_count")
        for k, df in (("typed", typed), ("text", text))
    ]
    return one[0].unionByName(one[1])


@register(
    "contains_search",
    """SELECT page_id, url FROM pages WHERE contains(html, '%%%') OR contains(url, '%%%') OR contains(html, 'utm_source=')
    OR contains(url, 'utm_source=')""",
)
def contains_search(spark, d):
    df = Tables(spark, d).pages
    hit = contains_any(["html", "url"], "%%%") | contains_any(["html", "url"], "utm_source=")
    return df.where(hit).select("page_id", "url")


@register(
    "latest_snapshot",
    f"""SELECT data_update_time, count(*) AS row_count FROM ({FILES_SQL}) WHERE data_update_time =
    (SELECT max(data_update_time) FROM ({FILES_SQL})) GROUP BY 1""",
)
def latest_snapshot(spark, d):
    latest = src.latest_snapshot(files(Tables(spark, d)), "data_update_time")
    return latest.groupBy("data_update_time").agg(F.count(F.lit(1)).alias("row_count"))


@register(
    "pushdown_scan",
    "SELECT l_orderkey, l_extendedprice FROM lineitem WHERE l_quantity >= 45 AND l_returnflag = 'R'",
)
def pushdown_scan(spark, d):
    where = (F.col("l_quantity") >= 45) & (F.col("l_returnflag") == "R")
    return src.scan(spark, f"{d}/lineitem.parquet", ["l_orderkey", "l_extendedprice"], where)


PAGE_SQL = "SELECT l_partkey, count(*) AS row_count FROM lineitem GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 80 OFFSET 120"


@register("result_page", PAGE_SQL)
def result_page(spark, d):
    counts = Tables(spark, d).lineitem.groupBy("l_partkey").agg(F.count(F.lit(1)).alias("row_count"))
    return ordered.page(counts, [F.desc("row_count"), F.asc("l_partkey")], 120, 80)


@register("result_page_deep", PAGE_SQL)
def result_page_deep(spark, d):
    counts = Tables(spark, d).lineitem.groupBy("l_partkey").agg(F.count(F.lit(1)).alias("row_count"))
    return ordered.page(counts, [F.desc("row_count"), F.asc("l_partkey")], 120, 80)


@register(
    "row_page_deep",
    "SELECT l_orderkey, l_linenumber, l_extendedprice FROM lineitem ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber LIMIT 80 OFFSET 20000",
)
def row_page_deep(spark, d):
    rows = Tables(spark, d).lineitem.select("l_orderkey", "l_linenumber", "l_extendedprice")
    return ordered.page(rows, [("l_extendedprice", False), ("l_orderkey", True), ("l_linenumber", True)], 20_000, 80)


SCORE_SQL = f"""
  WITH e AS ({EVENTS_SQL}), s AS (SELECT count(*) AS n,
    sum(CASE WHEN {filled('user_id')} THEN 1 ELSE 0 END + CASE WHEN timestamp IS NOT NULL THEN 1 ELSE 0 END + CASE WHEN {filled('action')} THEN 1 ELSE 0 END
      + CASE WHEN duration IS NOT NULL THEN 1 ELSE 0 END + CASE WHEN {filled('feature')} THEN 1 ELSE 0 END + CASE WHEN {filled('session_id')} THEN 1 ELSE 0 END) AS cells,
    count(*) FILTER (WHERE {filled('user_id')} AND timestamp IS NOT NULL) AS ok,
    count(*) FILTER (WHERE duration >= 0 AND duration <= 86400) AS good, date_diff('day', CAST(max(timestamp) AS DATE), DATE '2024-02-10') AS age FROM e),
  p AS (SELECT n AS record_count, round(CAST(cells AS DOUBLE) / (n * 6), 6) AS completeness, round(CAST(ok AS DOUBLE) / n, 6) AS required_fill,
    round(CAST(good AS DOUBLE) / n, 6) AS valid_rate, round(greatest(0, least(1, CAST(1 AS DOUBLE) - (age - 7) / CAST(63 AS DOUBLE))), 6) AS freshness FROM s)
  SELECT *, round((completeness * CAST(0.4 AS DOUBLE) + required_fill * CAST(0.2 AS DOUBLE) + valid_rate * CAST(0.2 AS DOUBLE)
    + freshness * CAST(0.2 AS DOUBLE)) * 100, 2) AS score FROM p"""


@register("quality_score", f"SELECT *, CASE WHEN score >= 70 THEN 'pass' ELSE 'stop' END AS status FROM ({SCORE_SQL})")
def quality_score(spark, d):
    df = events_frame(Tables(spark, d)).select(*EVENTS)
    return quality.quality_score(
        df, ["user_id", "timestamp"], "timestamp", "duration", "2024-02-10", max_measure=86400.0
    )


@register(
    "confidence_cap",
    """SELECT lang, source, count(*) AS records, CASE WHEN count(*) < 100 THEN NULL WHEN count(*) < 1000 THEN CAST(0.70 AS DOUBLE)
      WHEN count(*) <= 10000 THEN CAST(0.85 AS DOUBLE) ELSE CAST(0.95 AS DOUBLE) END AS confidence FROM documents GROUP BY 1, 2""",
)
def confidence_cap(spark, d):
    counts = Tables(spark, d).documents.groupBy("lang", "source").agg(F.count(F.lit(1)).alias("records"))
    return counts.withColumn("confidence", quality.confidence_cap(F.col("records")))


@register(
    "structure_findings",
    f"""WITH f AS ({DIRTY_SQL}), t AS ("""
    + rows_sql(
        [
            f"SELECT '{c}' AS column_name, count(*) FILTER (WHERE {filled(c)}) > 0 AND count(*) FILTER (WHERE {filled(c)}) = "
            f"count(*) FILTER (WHERE {filled(c)} AND regexp_matches(trim({c}), '^-?[0-9]+\\.?[0-9]*$')) AS number_as_text FROM f"
            for c, is_text in DIRTY_TYPES.items()
            if is_text
        ]
        + [f"SELECT '{c}', false" for c, is_text in DIRTY_TYPES.items() if not is_text]
    )
    + """)
    SELECT column_name, CASE WHEN column_name IN ('doc_id', 'n_chars') THEN 'bigint' ELSE 'string' END AS data_type,
      CASE column_name WHEN 'doc_id' THEN 'identifier' WHEN 'n_chars' THEN 'measure' WHEN 'is_delete' THEN 'flag' WHEN 'data_date' THEN 'temporal'
        WHEN 'text' THEN 'descriptive' WHEN 'length_text' THEN 'descriptive' ELSE 'dimension' END AS category,
      true AS nullable, number_as_text, column_name = 'data_date' AS time_as_text, true AS comment_missing FROM t""",
)
def structure_findings(spark, d):
    return quality.structure_findings(dirty(Tables(spark, d)))


#: orders as a bridge to customers, some of which are absent
BRIDGE = {"order_key": "o_orderkey", "cust": "CASE WHEN o_orderkey % 13 = 0 THEN '' ELSE CAST(o_custkey AS STRING) END", "status": "o_orderstatus"}
BRIDGE_PARENT = {"cust": "CAST(c_custkey AS STRING)"}


def verdict_sql(check: str, bad: str, total: str, bucket: str, detail: str, sample: str, frame: str) -> str:
    return f"""SELECT '{check}' AS "check", 'bridge' AS scope, CASE WHEN {bad} > 0 THEN 'high' ELSE 'low' END AS severity,
      CASE WHEN {bad} > 0 THEN 'fail' ELSE 'pass' END AS status, {big(bad)} AS row_count, {pct(bad, total, 4)} AS row_rate_pct,
      '{bucket}' AS bucket, '{detail}' AS detail, {sample} AS sample FROM {frame}"""


def column_sql(name: str, known: bool) -> str:
    return f"""SELECT 'column {name}', 'bridge', '{'low' if known else 'critical'}', '{'pass' if known else 'fail'}', NULL, NULL,
      {'NULL' if known else "'bridge_key_missing'"}, '', ''"""


@register(
    "bridge_findings",
    f"""WITH b AS ({derive_sql('orders', BRIDGE)}), p AS ({derive_sql('customer', BRIDGE_PARENT)} WHERE c_custkey % 5 <> 0),
    u AS (SELECT sum(n) AS total, sum(n) - count(*) AS bad FROM (SELECT count(*) AS n FROM b GROUP BY coalesce(cust, ''), coalesce(status, ''))),
    k AS (SELECT count(*) AS total, count(*) FILTER (WHERE NOT {filled('cust')}) AS cust, count(*) FILTER (WHERE NOT {filled('status')}) AS status FROM b),
    o AS (SELECT order_key FROM b WHERE {filled('cust')} AND cust NOT IN (SELECT cust FROM p)),
    x AS (SELECT count(*) AS bad, (SELECT count(*) FROM b) AS total FROM o)
    """
    + rows_sql(
        [
            verdict_sql("key uniqueness", "bad", "total", "wrong_grain", "(cust, status)", "''", "u"),
            verdict_sql("coverage of cust", "cust", "total", "bridge_key_missing", "", "''", "k"),
            verdict_sql("coverage of status", "status", "total", "bridge_key_missing", "", "''", "k"),
            verdict_sql(
                "customer link", "bad", "total", "bridge_key_missing", "",
                "(SELECT coalesce(string_agg(s, '|' ORDER BY s), '') FROM (SELECT concat('{\"order_key\":', order_key, '}') AS s FROM o ORDER BY order_key LIMIT 3))", "x",
            ),
            column_sql("cust", True), column_sql("status", True), column_sql("sku", False),
        ]
    ),
)
def bridge_findings(spark, d):
    t = Tables(spark, d)
    bridge = derive(t.orders, BRIDGE)
    parent = derive(t.customer.where("c_custkey % 5 <> 0"), BRIDGE_PARENT)
    found = quality_run.bridge_findings(bridge, ["cust", "status"], {"customer link": (parent, ["cust"])}, ["cust", "status", "sku"])
    first = compare.backlink_samples(bridge, parent, ["cust"], [F.asc("order_key")], 3)
    samples = first.select(F.lit("customer link").alias("code"), "order_key")
    return rules.with_samples(found, samples).withColumn("sample", F.array_join("sample", "|"))
