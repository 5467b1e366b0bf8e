"""Label and path queries over pages, documents, part and customer."""

from pyspark.sql import functions as F

from plumbline.functions.fixed import ADD, FAMILY_DEFAULT, MERGE, RULE_ALIAS, RULE_TARGET, RULE_UNCOVERED
from plumbline.functions.paths import (
    canonical_label,
    family_bucket,
    has_percent_encoding,
    has_separator,
    last_part,
    platform_cascade,
    url_decode,
    without_separators,
)
from plumbline.operators import labels
from plumbline.plans.registry import Tables, big, derive, derive_sql, filled, pct, register
from plumbline.sources.tables import candidate_rows

#: labels looked for in URL paths, first match wins
LANGUAGES = [
    ("english", "^en$"), ("french", "^fr$"), ("german", "^de$"), ("spanish", "^es$"), ("blog", "blog"), ("english", "english"),
    ("mobile", "^m[.]"), ("spam", "spam|promo"),
]
STOP = ["http:", "https:", "index.html"]

PAGES = {
    "page_id": "page_id",
    "url": "replace(CASE WHEN page_id % 12 = 0 THEN '' ELSE url END, '/en/', CASE WHEN page_id % 3 = 0 THEN '//EN/ ' ELSE '/en/' END)",
    "alt_path": "CASE WHEN page_id % 5 = 0 THEN NULL WHEN page_id % 4 = 0 THEN concat('site', chr(92), 'english', chr(92), chr(92), page_id, '.html') "
    "WHEN page_id % 4 = 1 THEN concat('archive/fr/', page_id % 7, '/de') ELSE concat('x/', page_id) END",
    "explicit": "CASE WHEN page_id % 6 = 0 THEN NULL WHEN page_id % 6 = 1 THEN ' fr ' WHEN page_id % 6 = 2 THEN 'unknown' "
    "WHEN page_id % 6 = 3 THEN 'https:' WHEN page_id % 6 = 4 THEN 'en' ELSE 'the English page' END",
}
PAGES_SQL = derive_sql("pages", PAGES)


def pages(t: Tables):
    return derive(t.pages, PAGES)


def canon_sql(c: str) -> str:
    stop = ", ".join(f"'{s}'" for s in STOP)
    when = " ".join(f"WHEN regexp_matches({c}, '{p}', 'i') THEN '{name}'" for name, p in LANGUAGES)
    return f"CASE WHEN {c} IN ({stop}) THEN NULL ELSE CASE {when} END END"


def segs_sql(c: str) -> str:
    clean = f"regexp_replace(regexp_replace(replace(trim(CAST({c} AS STRING)), chr(92), '/'), '/+', '/', 'g'), '^/|/$', '', 'g')"
    return f"list_filter(list_transform(string_split(coalesce({clean}, ''), '/'), lambda x: trim(x)), lambda x: x <> '')"


HITS_SQL = f"""
  WITH f AS ({PAGES_SQL}), s AS (
    SELECT page_id, explicit, 'url' AS path_field, 0 AS fi, {segs_sql('url')} AS segs FROM f
    UNION ALL SELECT page_id, explicit, 'alt_path', 1, {segs_sql('alt_path')} FROM f),
  u AS (SELECT page_id, explicit, path_field, fi, unnest(segs) AS segment, unnest(range(1, len(segs) + 1)) AS root, len(segs) AS n FROM s),
  h AS (SELECT page_id, path_field, fi, {canon_sql('segment')} AS label, segment, CAST(root AS INTEGER) AS depth_from_root,
    CAST(n - root + 1 AS INTEGER) AS depth_from_leaf, root = n AS is_last FROM u WHERE {canon_sql('segment')} IS NOT NULL),
  b AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY page_id ORDER BY is_last, depth_from_leaf, depth_from_root, fi) AS rn FROM h) WHERE rn = 1)"""


def best(t: Tables):
    return labels.best_hits(pages(t), ["url", "alt_path"], LANGUAGES, STOP)


@register(
    "path_segments",
    f"{HITS_SQL} SELECT page_id, path_field, label, segment, depth_from_root, depth_from_leaf, is_last FROM h",
)
def path_segments(spark, d):
    return labels.segment_hits(pages(Tables(spark, d)), ["page_id"], ["url", "alt_path"], LANGUAGES, STOP)


@register(
    "best_hit",
    f"{HITS_SQL} SELECT f.page_id, path_field, label, segment, depth_from_root, depth_from_leaf FROM f LEFT JOIN b USING (page_id)",
)
def best_hit(spark, d):
    hit = [f"hit.{c}" for c in ("path_field", "label", "segment", "depth_from_root", "depth_from_leaf")]
    return best(Tables(spark, d)).select("page_id", *hit)


CONSISTENCY = f"""{HITS_SQL}, c AS (SELECT f.page_id, coalesce(trim(explicit), '') <> '' AS has_label, {canon_sql('trim(explicit)')} AS known, b.label
  FROM f LEFT JOIN b USING (page_id))
  SELECT page_id, known AS explicit_label, CASE WHEN has_label AND label IS NOT NULL AND known IS NULL THEN 'explicit_dirty_path_has_platform'
    WHEN has_label AND label IS NOT NULL AND known = label THEN 'explicit_match_path' WHEN has_label AND label IS NOT NULL THEN 'explicit_conflict_path'
    WHEN has_label AND known IS NULL THEN 'explicit_dirty_no_path_hit' WHEN has_label THEN 'explicit_only' WHEN label IS NOT NULL THEN 'path_only'
    ELSE 'neither' END AS consistency FROM c"""


@register("label_consistency", CONSISTENCY)
def label_consistency(spark, d):
    rows = labels.label_consistency(best(Tables(spark, d)), "explicit", LANGUAGES, STOP)
    return rows.select("page_id", "explicit_label", "consistency")


@register("consistency_counts", f"SELECT consistency, count(*) AS row_count FROM ({CONSISTENCY}) GROUP BY 1")
def consistency_counts(spark, d):
    return labels.consistency_counts(labels.label_consistency(best(Tables(spark, d)), "explicit", LANGUAGES, STOP))


STATS = f"""{HITS_SQL}, st AS (
  SELECT 'field' AS statistic, path_field, NULL AS label, CAST(NULL AS INTEGER) AS depth, count(*) AS row_count FROM b GROUP BY 2
  UNION ALL SELECT 'field_label', path_field, label, NULL, count(*) FROM b GROUP BY 2, 3
  UNION ALL SELECT 'label_root_depth', NULL, label, depth_from_root, count(*) FROM b GROUP BY 3, 4
  UNION ALL SELECT 'label_leaf_depth', NULL, label, depth_from_leaf, count(*) FROM b GROUP BY 3, 4)"""


@register("hit_statistics", f"{STATS} SELECT * FROM st")
def hit_statistics(spark, d):
    return labels.hit_statistics(best(Tables(spark, d)))


@register(
    "label_recommendation",
    f"""{STATS} SELECT statistic, path_field, label, depth, row_count FROM (SELECT *, row_number() OVER (PARTITION BY statistic, label
      ORDER BY row_count DESC, path_field NULLS FIRST, depth NULLS FIRST) AS rn FROM st WHERE statistic <> 'field_label') WHERE rn = 1""",
)
def label_recommendation(spark, d):
    return labels.label_recommendation(labels.hit_statistics(best(Tables(spark, d))))


@register(
    "top_segments",
    f"""{HITS_SQL} SELECT label, segment, row_count FROM (SELECT label, segment, count(*) AS row_count,
      row_number() OVER (PARTITION BY label ORDER BY count(*) DESC, segment) AS rn FROM b GROUP BY 1, 2) WHERE rn <= 10""",
)
def top_segments(spark, d):
    return labels.top_segments(best(Tables(spark, d)))


@register(
    "explicit_values",
    f"""WITH c AS (SELECT trim(explicit) AS value, count(*) AS row_count FROM ({PAGES_SQL}) WHERE coalesce(trim(explicit), '') <> '' GROUP BY 1)
    SELECT * FROM (SELECT 'top' AS list, value, row_count FROM c ORDER BY row_count DESC, value LIMIT 20)
    UNION ALL SELECT * FROM (SELECT 'suspicious', value, row_count FROM c WHERE {canon_sql('value')} IS NULL ORDER BY row_count DESC, value LIMIT 20)""",
)
def explicit_values(spark, d):
    return labels.explicit_values(pages(Tables(spark, d)), "explicit", 20, LANGUAGES, STOP)


@register(
    "candidate_rows",
    f"""SELECT page_id FROM ({PAGES_SQL}) WHERE {filled('url')} AND ({filled('explicit')} OR coalesce(regexp_matches(alt_path, 'archive|english'), false))""",
)
def candidate_rows_query(spark, d):
    out = candidate_rows(pages(Tables(spark, d)), "explicit", ["alt_path"], ["english", "archive"], "url")
    return out.select("page_id")


# --- missing labels ----------------------------------------------------------

RESOURCE = {
    "file_id": "CASE WHEN doc_id % 64 = 0 THEN '' ELSE concat('f', doc_id % 700) END",
    "source_priority": "CAST(doc_id % 3 + 1 AS INTEGER)",
    "file_type": "CASE WHEN doc_id % 5 = 0 THEN '视频' WHEN doc_id % 5 = 1 THEN NULL ELSE '图片' END",
    "platform": "CASE WHEN doc_id % 4 = 0 THEN '抖音' WHEN doc_id % 4 = 1 THEN ' ' END",
    "order_time": "concat('2024-01-', lpad(CAST(doc_id % 28 + 1 AS STRING), 2, '0'))",
    "create_time": "concat('2023-', lpad(CAST(doc_id % 12 + 1 AS STRING), 2, '0'))",
    "full_path": "CASE WHEN doc_id % 11 = 0 THEN NULL WHEN doc_id % 11 = 1 THEN '' WHEN doc_id % 11 = 2 THEN concat('a/', chr(92), 'Tmall天猫旗舰/', source, '.jpg') "
    "WHEN doc_id % 11 = 3 THEN concat('root/主图/', lang, '/白底图') WHEN doc_id % 11 = 4 THEN ' / / ' WHEN doc_id % 11 = 5 THEN concat('x/ pdd /', source) "
    "WHEN doc_id % 11 = 6 THEN concat(lang, '/抖音/京东/', source) ELSE concat('deep/', lang, '/', source, '/doc', doc_id % 4) END",
    "concatenated_path": "CASE WHEN doc_id % 2 = 0 THEN NULL ELSE concat('share', chr(92), '小红书', chr(92), source) END",
    "doc_id": "doc_id",
}
RESOURCE_SQL = derive_sql("documents", RESOURCE)
DEDUP_SQL = f"""SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY file_id ORDER BY source_priority, order_time DESC NULLS LAST,
  create_time DESC NULLS LAST, full_path DESC NULLS LAST, doc_id) AS rn FROM ({RESOURCE_SQL}) WHERE {filled('file_id')}) WHERE rn = 1"""


def deduplicated(t: Tables):
    order = [F.asc("source_priority"), F.desc("order_time"), F.desc("create_time"), F.desc("full_path"), F.asc("doc_id")]
    return labels.priority_dedup(derive(t.documents, RESOURCE), "file_id", order)


@register("priority_dedup", f"SELECT file_id, doc_id, source_priority, order_time, full_path FROM ({DEDUP_SQL})")
def priority_dedup(spark, d):
    return deduplicated(Tables(spark, d)).select("file_id", "doc_id", "source_priority", "order_time", "full_path")


@register(
    "null_rate_by_source",
    f"""SELECT source_priority, file_type, count(*) AS total_rows, count(*) FILTER (WHERE NOT {filled('platform')}) AS null_rows,
      {pct(f'count(*) FILTER (WHERE NOT {filled("platform")})', 'count(*)', 4)} AS null_rate_pct FROM ({DEDUP_SQL}) GROUP BY 1, 2""",
)
def null_rate_by_source(spark, d):
    return labels.null_rate_by_source(deduplicated(Tables(spark, d)), ["source_priority", "file_type"], "platform")


KNOWN_RE = "天猫|淘宝|唯品会|唯品|快手|拼多多|\\bPDD\\b|抖音|京东|\\bJD\\b|小红书|视频号|得物"
TERMS_RE = "商品内页|详情图|详情页|主图|白底图|灰底图|素材图|配色图|尺码图|面料图|内页图|温馨提示|选购图|海报图|场景图|平铺图|挂拍图|细节图|穿搭图|官网主图"
REASON_SQL = f"""
  WITH r AS (SELECT *, CASE WHEN full_path <> '' THEN full_path ELSE concatenated_path END AS p FROM ({RESOURCE_SQL}) WHERE NOT {filled('platform')}),
  s AS (SELECT *, coalesce(regexp_replace(regexp_replace(replace(trim(p), chr(92), '/'), '/+', '/', 'g'), '^/|/$', '', 'g'), '') AS np, {segs_sql('p')} AS segs FROM r),
  k AS (SELECT *, list_filter(segs, lambda x: regexp_matches(x, '{KNOWN_RE}', 'i'))[1] AS known,
    len(list_filter(segs, lambda x: regexp_matches(x, '{TERMS_RE}'))) > 0 AS content, coalesce(file_type = '视频', false) AS video FROM s)
  SELECT doc_id, source_priority, CASE WHEN np = '' THEN 'NO_PATH' WHEN video AND len(segs) = 0 THEN 'VIDEO_NO_PLATFORM_SEGMENT'
    WHEN video AND known IS NOT NULL THEN 'VIDEO_PATH_HAS_PLATFORM_BUT_SQL_NOT_MINING' WHEN video THEN 'VIDEO_PATH_NO_PLATFORM_SEGMENT'
    WHEN known IS NOT NULL THEN 'IMAGE_PATH_HAS_PLATFORM_BUT_SQL_MISSED' WHEN content THEN 'IMAGE_ONLY_CONTENT_SEGMENTS'
    ELSE 'IMAGE_NO_PLATFORM_SEGMENT' END AS reason,
    CASE WHEN np = '' THEN NULL WHEN known IS NOT NULL THEN known WHEN NOT video AND content THEN NULL ELSE segs[-1] END AS evidence_segment FROM k"""


def reasons(t: Tables):
    rows = derive(t.documents, RESOURCE).where("coalesce(trim(platform), '') = ''")
    return labels.null_reason(rows, "file_type", "full_path", "concatenated_path")


@register("null_reason", REASON_SQL)
def null_reason(spark, d):
    return reasons(Tables(spark, d)).select("doc_id", "source_priority", "reason", "evidence_segment")


@register(
    "null_reason_by_source", f"SELECT source_priority, reason, count(*) AS row_count FROM ({REASON_SQL}) GROUP BY 1, 2"
)
def null_reason_by_source(spark, d):
    return labels.reason_counts(reasons(Tables(spark, d)), ["source_priority"])


@register(
    "top_evidence",
    f"""SELECT evidence_segment, count(*) AS row_count FROM ({REASON_SQL}) WHERE evidence_segment IS NOT NULL GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 20""",
)
def top_evidence(spark, d):
    return labels.top_evidence(reasons(Tables(spark, d)))


@register(
    "recoverable_nulls",
    f"""SELECT count(*) AS total_rows, count(*) FILTER (WHERE NOT {filled('platform')}) AS label_null_rows,
      count(*) FILTER (WHERE NOT {filled('platform')} AND regexp_matches(replace(coalesce(full_path, concatenated_path, ''), chr(92), '/'),
        '(唯品会|天猫|淘宝|快手|拼多多|抖音|京东|小红书|视频号|得物)')) AS path_has_label_rows FROM ({RESOURCE_SQL})""",
)
def recoverable_nulls(spark, d):
    return labels.recoverable_nulls(
        derive(Tables(spark, d).documents, RESOURCE), "platform", ["full_path", "concatenated_path"]
    )


def cascade_sql() -> str:
    steps = [("full_path", w) for w in ("抖音", "天猫")] + [("concatenated_path", "小红书")]
    whens = [
        f"WHEN regexp_matches(replace({c}, chr(92), '/'), '(^|/)[^/]*{w}[^/]*(/|$)') THEN '{w}'" for c, w in steps
    ] + [f"WHEN regexp_matches(platform, '{w}') THEN '{w}'" for w in ("抖音", "天猫")]
    return "CASE " + " ".join(whens) + " END"


def resolved_platform():
    return platform_cascade(
        [("full_path", ["抖音", "天猫"]), ("concatenated_path", ["小红书"])], "platform", ["抖音", "天猫"]
    )


@register(
    "unresolved_labels",
    f"SELECT count(*) AS total_rows, count(*) FILTER (WHERE {cascade_sql()} IS NULL) AS unresolved_rows FROM ({RESOURCE_SQL})",
)
def unresolved_labels(spark, d):
    return labels.unresolved(derive(Tables(spark, d).documents, RESOURCE), resolved_platform())


@register(
    "unresolved_samples",
    f"""SELECT doc_id, create_time, full_path FROM ({RESOURCE_SQL}) WHERE {cascade_sql()} IS NULL ORDER BY create_time DESC, doc_id LIMIT 20""",
)
def unresolved_samples(spark, d):
    df = derive(Tables(spark, d).documents, RESOURCE)
    rows = labels.unresolved_samples(df, resolved_platform(), [F.desc("create_time"), F.asc("doc_id")])
    return rows.select("doc_id", "create_time", "full_path")


@register(
    "label_cascade", f"SELECT {cascade_sql()} AS label, count(*) AS row_count FROM ({RESOURCE_SQL}) GROUP BY 1"
)
def label_cascade(spark, d):
    df = derive(Tables(spark, d).documents, RESOURCE)
    return df.groupBy(resolved_platform().alias("label")).agg(F.count(F.lit(1)).alias("row_count"))


# --- rules for enum values ---------------------------------------------------

FAMILY = {"value": "concat(p_name, CASE p_partkey % 9 WHEN 0 THEN '跑步鞋' WHEN 1 THEN '长裤' WHEN 2 THEN '连衣裙' WHEN 3 THEN '短袖套装' WHEN 4 THEN '外套' WHEN 5 THEN '网球拍' WHEN 6 THEN '袜' ELSE '' END)", "p_partkey": "p_partkey"}
FAMILY_CASE = f"""CASE WHEN regexp_matches(v, '鞋|靴|凉鞋|拖鞋|单鞋|玛丽珍') THEN '鞋靴' WHEN regexp_matches(v, '裤') THEN '裤装'
  WHEN regexp_matches(v, '裙|内衣|泳|连体衣|连身衣|背心|吊带') THEN '裙装/内衣/泳装' WHEN contains(v, '套装') THEN '套装'
  WHEN regexp_matches(v, '外套|衫|衣|服|上衣|马甲|羽绒|防晒|针织衫|大衣') THEN '上装' WHEN regexp_matches(v, '球|拍|线|柄皮|器材|器械|耗材') THEN '球拍球线/器材'
  WHEN regexp_matches(v, '帽|包|袜|配件|护具|手套|围巾|壶|镜|公仔|玩偶') THEN '配件/护具/包袜' ELSE '{FAMILY_DEFAULT}' END"""


@register(
    "family_buckets",
    f"SELECT {FAMILY_CASE} AS family_bucket, count(*) AS row_count, count(DISTINCT v) AS value_count FROM (SELECT value AS v FROM ({derive_sql('part', FAMILY)})) GROUP BY 1",
)
def family_buckets(spark, d):
    df = derive(Tables(spark, d).part, FAMILY)
    return df.groupBy(family_bucket("value").alias("family_bucket")).agg(
        F.count(F.lit(1)).alias("row_count"), F.count_distinct("value").alias("value_count")
    )


#: values of part with a family word, rules and decisions derived from the same table
VALUES = {
    "enum_value": "concat(p_name, ' ', p_type, CASE p_partkey % 9 WHEN 0 THEN '跑步鞋' WHEN 1 THEN '长裤' WHEN 2 THEN '连衣裙' WHEN 3 THEN '短袖套装' WHEN 4 THEN '外套' WHEN 5 THEN '网球拍' ELSE '' END)",
    "spu": "concat('p', p_partkey % 300)",
    "p_size": "p_size",
}
RULES = {"alias": "concat(p_name, ' ', p_type)", "target": "CASE WHEN p_type = 'SMALL' THEN concat(p_name, ' LARGE') ELSE concat(p_name, ' ', p_type) END"}
RULES_WHERE = "p_type IN ('SMALL', 'LARGE')"
DECISIONS = {
    "enum_value": "concat(p_name, ' ', p_type)",
    "kind": "CASE WHEN p_type = 'MEDIUM' THEN 'merge' ELSE 'add' END",
    "proposed_enum": "CASE WHEN p_type = 'MEDIUM' THEN concat(p_name, ' LARGE') ELSE concat(p_name, ' ', p_type) END",
    "confidence": "CASE WHEN p_name LIKE 'red%' THEN 'high' ELSE 'medium' END",
    "reason": "concat('decided for ', p_type)",
}
DECISIONS_WHERE = "p_type IN ('MEDIUM', 'PROMO')"
COVERAGE_SQL = f"""
  WITH v AS (SELECT enum_value AS v, count(*) AS row_count, count(DISTINCT spu) AS entity_count FROM ({derive_sql('part', VALUES)}) GROUP BY 1),
  r AS (SELECT DISTINCT alias, target FROM ({derive_sql('part', RULES)} WHERE {RULES_WHERE})),
  tg AS (SELECT DISTINCT target FROM r), al AS (SELECT alias, max(target) AS target FROM r WHERE alias <> target GROUP BY 1),
  fin AS (SELECT enum_value AS v, count(*) AS final_row_count, count(DISTINCT spu) AS final_entity_count FROM ({derive_sql('part', VALUES)})
    WHERE p_size > 40 GROUP BY 1),
  pk AS (SELECT {FAMILY_CASE} AS family_bucket, v, row_number() OVER (PARTITION BY {FAMILY_CASE} ORDER BY final_row_count DESC, final_entity_count DESC, v) AS rn FROM fin),
  peers AS (SELECT family_bucket, string_agg(v, '、' ORDER BY rn) AS same_family_values FROM pk WHERE rn <= 12 GROUP BY 1),
  c AS (SELECT v AS enum_value, row_count, entity_count, CASE WHEN tg.target IS NOT NULL THEN '{RULE_TARGET}' WHEN al.alias IS NOT NULL THEN '{RULE_ALIAS}'
      ELSE '{RULE_UNCOVERED}' END AS rule_status, CASE WHEN tg.target IS NOT NULL THEN v WHEN al.alias IS NOT NULL THEN al.target ELSE '' END AS suggested_target,
      {FAMILY_CASE} AS family_bucket FROM v LEFT JOIN tg ON v = tg.target LEFT JOIN al ON v = al.alias),
  dm AS (SELECT DISTINCT * FROM ({derive_sql('part', DECISIONS)} WHERE {DECISIONS_WHERE})),
  ap AS (SELECT c.*, CASE WHEN rule_status = '{RULE_TARGET}' THEN '{MERGE}' WHEN m.kind IS NOT NULL THEN '{MERGE}' WHEN a.kind IS NOT NULL THEN '{ADD}'
      WHEN family_bucket IN ('鞋靴', '裤装', '上装', '套装') THEN '{MERGE}' ELSE '{ADD}' END AS action_bucket,
    CASE WHEN rule_status = '{RULE_TARGET}' THEN suggested_target WHEN m.kind IS NOT NULL THEN m.proposed_enum WHEN a.kind IS NOT NULL THEN a.proposed_enum
      WHEN family_bucket = '鞋靴' THEN '运动生活鞋类' WHEN family_bucket = '裤装' THEN '运动裤类' WHEN family_bucket = '上装' THEN '外套'
      WHEN family_bucket = '套装' THEN '套装类' ELSE c.enum_value END AS proposed_enum,
    CASE WHEN rule_status = '{RULE_TARGET}' THEN 'high' WHEN m.kind IS NOT NULL THEN m.confidence WHEN a.kind IS NOT NULL THEN a.confidence
      WHEN family_bucket = '套装' THEN 'medium' ELSE 'low' END AS confidence,
    CASE WHEN rule_status = '{RULE_TARGET}' THEN 'rule target' WHEN m.kind IS NOT NULL THEN m.reason WHEN a.kind IS NOT NULL THEN a.reason
      WHEN family_bucket IN ('鞋靴', '裤装', '上装', '套装') THEN 'family default' ELSE 'no rule and no family default' END AS reason
    FROM c LEFT JOIN (SELECT * FROM dm WHERE kind = 'merge') m ON c.enum_value = m.enum_value
      LEFT JOIN (SELECT * FROM dm WHERE kind = 'add') a ON c.enum_value = a.enum_value)"""


def coverage(t: Tables):
    df = derive(t.part, VALUES)
    values = df.groupBy("enum_value").agg(
        F.count(F.lit(1)).alias("row_count"), F.count_distinct("spu").alias("entity_count")
    )
    final = df.where("p_size > 40").groupBy("enum_value").agg(
        F.count(F.lit(1)).alias("final_row_count"), F.count_distinct("spu").alias("final_entity_count")
    )
    return labels.rule_coverage(values, derive(t.part.where(RULES_WHERE), RULES), final)


def plan(t: Tables):
    return labels.action_plan(coverage(t), derive(t.part.where(DECISIONS_WHERE), DECISIONS))


@register(
    "rule_coverage",
    f"{COVERAGE_SQL} SELECT c.*, coalesce(same_family_values, '') AS same_family_values FROM c LEFT JOIN peers USING (family_bucket)",
)
def rule_coverage(spark, d):
    return coverage(Tables(spark, d))


@register(
    "rule_coverage_summary",
    f"""{COVERAGE_SQL} SELECT count(*) AS value_count, count(*) FILTER (WHERE rule_status = '{RULE_TARGET}') AS target_defined_count,
      count(*) FILTER (WHERE rule_status = '{RULE_ALIAS}') AS alias_defined_count, count(*) FILTER (WHERE rule_status = '{RULE_UNCOVERED}') AS uncovered_count FROM c""",
)
def rule_coverage_summary(spark, d):
    return labels.rule_coverage_summary(coverage(Tables(spark, d)))


@register(
    "action_plan",
    f"""{COVERAGE_SQL} SELECT enum_value, rule_status, family_bucket, action_bucket, proposed_enum, confidence, reason FROM ap""",
)
def action_plan(spark, d):
    return plan(Tables(spark, d)).select(
        "enum_value", "rule_status", "family_bucket", "action_bucket", "proposed_enum", "confidence", "reason"
    )


@register(
    "action_summary",
    f"""{COVERAGE_SQL} SELECT count(*) AS total_count, count(*) FILTER (WHERE action_bucket = '{ADD}') AS add_candidate_count,
      count(*) FILTER (WHERE action_bucket = '{MERGE}') AS merge_candidate_count, count(*) FILTER (WHERE confidence = 'high') AS high_confidence_count,
      count(*) FILTER (WHERE confidence = 'medium') AS medium_confidence_count, count(*) FILTER (WHERE confidence = 'low') AS low_confidence_count FROM ap""",
)
def action_summary(spark, d):
    return labels.action_summary(plan(Tables(spark, d)))


@register(
    "family_summary",
    f"""{COVERAGE_SQL} SELECT action_bucket, family_bucket, count(*) AS enum_count, {big('sum(row_count)')} AS rows, {big('sum(entity_count)')} AS entities
    FROM ap GROUP BY 1, 2""",
)
def family_summary(spark, d):
    return labels.family_summary(plan(Tables(spark, d)), "row_count", "entity_count", ["action_bucket"])


# --- following a value through layers ----------------------------------------

BACKUP = {"id": "CAST(page_id AS STRING)", "name": "concat('page', page_id % 50)", "path": "url"}
INFO = {"file_id": "CAST(page_id AS STRING)", "file_name": "concat('page', page_id % 50)", "folder": "url"}
DOWN = {"file_id": "CAST(doc_id % 400 AS STRING)", "file_name": "concat('page', doc_id % 50)", "full_path": "concat(source, '/', doc_id)"}
ANCHORS = {"found_by_id": "example.net/de", "found_by_name": "example.org/fr", "found_by_text": "src1"}


def lookup(t: Tables, keyword: str):
    info = derive(t.pages, INFO)
    if keyword == ANCHORS["found_by_name"]:
        info = info.withColumn("file_id", F.lit("").cast("string"))
    down = derive(t.documents, DOWN)
    return labels.anchor_lookup(
        {"backup": (derive(t.pages, BACKUP), ["name", "path"]), "info": (info, ["file_name", "folder"])},
        "info", "file_id", "file_name",
        {"detail": (down, "file_id", "file_name", ["file_name", "full_path"])},
        keyword,
    )


def lookup_sql(kind: str) -> str:
    word = ANCHORS[kind]
    src = f"(SELECT * FROM ({derive_sql('pages', INFO)}) WHERE contains(file_name, '{word}') OR contains(folder, '{word}'))"
    match = {
        "found_by_id": f"file_id IN (SELECT file_id FROM {src})",
        "found_by_name": f"file_name IN (SELECT file_name FROM {src})",
        "found_by_text": f"contains(file_name, '{word}') OR contains(full_path, '{word}')",
    }[kind]
    return f"""SELECT 'backup' AS layer, count(*) AS matched_rows, '{kind}' AS search FROM ({derive_sql('pages', BACKUP)}) WHERE contains(name, '{word}') OR contains(path, '{word}')
    UNION ALL SELECT 'info', count(*), '{kind}' FROM {src} UNION ALL SELECT 'detail', count(*), '{kind}' FROM ({derive_sql('documents', DOWN)}) WHERE {match}"""


@register("anchor_lookup", " UNION ALL ".join(lookup_sql(k) for k in ANCHORS))
def anchor_lookup(spark, d):
    t, out = Tables(spark, d), None
    for kind, keyword in ANCHORS.items():
        part = labels.layer_hits(lookup(t, keyword)).withColumn("search", F.lit(kind))
        out = part if out is None else out.unionByName(part)
    return out


FORMS = {
    "page_id": "page_id",
    "plain": "url",
    "encoded": "replace(replace(url, '/', '%2F'), ':', CASE WHEN page_id % 4 = 0 THEN '+%3A' ELSE '%3a' END)",
    "flat": "replace(url, '/', '')",
}


def decode_sql(c: str) -> str:
    return f"url_decode(replace({c}, '+', '%2B'))"


@register(
    "url_signature",
    f"""WITH f AS ({derive_sql('pages', FORMS)}), u AS (SELECT page_id, 'plain' AS form, plain AS v FROM f UNION ALL SELECT page_id, 'encoded', encoded FROM f
      UNION ALL SELECT page_id, 'flat', flat FROM f)
    SELECT page_id, form, {decode_sql('v')} AS decoded, regexp_replace({decode_sql('v')}, '[\\\\/]+', '', 'g') AS signature,
      string_split({decode_sql('v')}, '/')[-1] AS file_name, regexp_matches(v, '%[0-9a-fA-F]{{2}}') AS encoded, regexp_matches(v, '[\\\\/]') AS separated FROM u""",
)
def url_signature(spark, d):
    long = derive(Tables(spark, d).pages, FORMS).unpivot("page_id", ["plain", "encoded", "flat"], "form", "v")
    return long.withColumn("decoded", url_decode("v")).select(
        "page_id", "form", "decoded", without_separators("decoded").alias("signature"), last_part("decoded").alias("file_name"),
        has_percent_encoding("v").alias("encoded"), has_separator("v").alias("separated"),
    )


REFERENCE = "https://m.ththth.example.net/en/25#top"


def forms_sql(layer: str, c: str) -> str:
    return f"SELECT '{layer}' AS layer, '{c}' AS compare_field, {c} AS v FROM ({derive_sql('pages', FORMS)})"


@register(
    "value_forms",
    f"""WITH u AS ({forms_sql('ods', 'plain')} UNION ALL {forms_sql('dws', 'encoded')} UNION ALL {forms_sql('dim', 'flat')}),
    x AS (SELECT *, {decode_sql('v')} AS dv, regexp_replace({decode_sql('v')}, '[\\\\/]+', '', 'g') AS sig FROM u WHERE v <> ''),
    g AS (SELECT layer, compare_field, count(*) AS "values", count(*) FILTER (WHERE v = '{REFERENCE}') AS exact_match_rows,
      count(*) FILTER (WHERE dv = '{REFERENCE}') AS decoded_match_rows,
      count(*) FILTER (WHERE sig = '{REFERENCE.replace('/', '')}') AS compact_match_rows,
      count(*) FILTER (WHERE string_split(dv, '/')[-1] = '{REFERENCE.split('/')[-1]}') AS same_file_name_rows,
      count(*) FILTER (WHERE NOT regexp_matches(v, '[\\\\/]') AND NOT regexp_matches(v, '%[0-9a-fA-F]{{2}}')) AS plain_rows FROM x GROUP BY 1, 2)
    SELECT *, (SELECT min(ok) FROM (SELECT bool_or(compact_match_rows > 0) AS ok FROM g GROUP BY layer)) AS display_only FROM g""",
)
def value_forms(spark, d):
    df = derive(Tables(spark, d).pages, FORMS)
    forms = None
    for layer, c in (("ods", "plain"), ("dws", "encoded"), ("dim", "flat")):
        one = labels.value_forms(df, layer, [c], REFERENCE)
        forms = one if forms is None else forms.unionByName(one)
    return labels.form_summary(forms)


@register(
    "canonical_labels",
    f"SELECT {canon_sql('trim(explicit)')} AS label, count(*) AS row_count FROM ({PAGES_SQL}) GROUP BY 1",
)
def canonical_labels(spark, d):
    return pages(Tables(spark, d)).groupBy(canonical_label("explicit", LANGUAGES, STOP).alias("label")).agg(
        F.count(F.lit(1)).alias("row_count")
    )
