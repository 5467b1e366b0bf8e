"""Lineage queries over edges derived from the keys of the tables.

Every customer, supplier and order counts as a table that is produced from
others: regions feed nations, nations feed customers and suppliers, and both
feed the orders they take part in.
"""

from pyspark.sql import functions as F

from plumbline.operators import lineage, reach
from plumbline.operators.ordered import cut
from plumbline.plans.registry import Tables, register

STATEMENTS_SQL = """
  SELECT concat('n', n_nationkey) AS statement_id, 'geo.sql' AS file_path, concat('dwd.nation', n_nationkey) AS target_dataset, 'physical_table' AS target_kind,
    'insert' AS statement_type, [concat('`ODS`.Region', n_regionkey), 'helper'] AS source_tables, true AS has_query FROM nation
  UNION ALL SELECT concat('c', c_custkey), 'party.sql', concat('dws.customer', c_custkey), 'physical_table', 'insert', [concat('dwd.nation', c_nationkey)], true FROM customer
  UNION ALL SELECT concat('s', s_suppkey), 'party.sql', concat('dws.supplier', s_suppkey), 'view', 'create', [concat('dwd.nation', s_nationkey)], true FROM supplier
  UNION ALL SELECT concat('o', o_orderkey), 'orders.sql', concat('ads.order', o_orderkey), 'temp_view', 'create',
    [concat('dws.customer', o_custkey), concat('DWS.supplier', o_orderkey % (SELECT count(*) FROM supplier)), concat('dws.customer', o_custkey)], true FROM orders"""


def statements(t: Tables):
    suppliers = t.supplier.agg(F.count(F.lit(1))).scalar()

    def rows(df, sid, file, target, kind, stype, sources):
        return df.select(
            sid.alias("statement_id"), F.lit(file).alias("file_path"), target.alias("target_dataset"), F.lit(kind).alias("target_kind"),
            F.lit(stype).alias("statement_type"), F.array(*sources).alias("source_tables"), F.lit(True).alias("has_query"),
        )

    def name(prefix, c):
        return F.concat(F.lit(prefix), (F.col(c) if isinstance(c, str) else c).cast("string"))

    other = F.col("o_orderkey") % suppliers
    parts = [
        rows(t.nation, name("n", "n_nationkey"), "geo.sql", name("dwd.nation", "n_nationkey"), "physical_table", "insert",
             [name("`ODS`.Region", "n_regionkey"), F.lit("helper")]),
        rows(t.customer, name("c", "c_custkey"), "party.sql", name("dws.customer", "c_custkey"), "physical_table", "insert",
             [name("dwd.nation", "c_nationkey")]),
        rows(t.supplier, name("s", "s_suppkey"), "party.sql", name("dws.supplier", "s_suppkey"), "view", "create",
             [name("dwd.nation", "s_nationkey")]),
        rows(t.orders, name("o", "o_orderkey"), "orders.sql", name("ads.order", "o_orderkey"), "temp_view", "create",
             [name("dws.customer", "o_custkey"), name("DWS.supplier", other), name("dws.customer", "o_custkey")]),
    ]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


BASE = f"""WITH RECURSIVE st AS ({STATEMENTS_SQL}),
  made AS (SELECT DISTINCT lower(target_dataset) AS table_name FROM st),
  ex AS (SELECT DISTINCT statement_id, file_path, lower(replace(src, '`', '')) AS source_table, target_dataset AS target_table, target_kind, statement_type
    FROM (SELECT *, unnest(source_tables) AS src FROM st)),
  edge AS (SELECT * FROM ex WHERE contains(source_table, '.') OR source_table IN (SELECT table_name FROM made)),
  base AS (SELECT DISTINCT source_table AS table_name FROM edge WHERE contains(source_table, '.') AND source_table NOT IN (SELECT table_name FROM made)),
  link AS (SELECT DISTINCT source_table, target_table FROM edge),
  walk AS (SELECT table_name AS base_table, l.target_table AS node, 1 AS hop, concat(table_name, ' -> ', l.target_table) AS path FROM base JOIN link l ON l.source_table = table_name
    UNION ALL SELECT w.base_table, l.target_table, w.hop + 1, concat(w.path, ' -> ', l.target_table) FROM walk w JOIN link l ON l.source_table = w.node)"""


@register("table_edges", f"{BASE} SELECT * FROM edge")
def table_edges(spark, d):
    return lineage.table_edges(statements(Tables(spark, d)))


def parts(spark, d):
    st = statements(Tables(spark, d))
    edges, made = cut(lineage.table_edges(st)), lineage.produced_tables(st)  # edges are read many times
    return st, edges, made, lineage.base_tables(edges, made)


@register("base_tables", f"{BASE} SELECT table_name FROM base")
def base_tables(spark, d):
    return parts(spark, d)[3]


@register(
    "lineage_paths",
    f"{BASE} SELECT base_table, node AS downstream_table, CAST(hop AS INTEGER) AS hop_count, path FROM walk",
)
def lineage_paths(spark, d):
    _, edges, _, bases = parts(spark, d)
    return lineage.downstream_paths(edges, bases)


COLUMN_SQL = """ce AS (SELECT statement_id, file_path, target_table, concat('Key_', CASE WHEN target_table LIKE 'ads%' THEN 'o' ELSE 'x' END) AS target_column, source_table,
    CASE WHEN source_table LIKE 'dws%' AND statement_id LIKE '%7' THEN NULL ELSE 'key_x' END AS source_column,
    CASE WHEN source_table LIKE 'dws%' AND statement_id LIKE '%7' THEN 'constant' ELSE 'ok' END AS lineage_status, target_kind, 'key' AS expression_sql FROM edge)"""


def column_edges(edges):
    constant = F.col("source_table").like("dws%") & F.col("statement_id").like("%7")
    return edges.select(
        "statement_id",
        "file_path",
        "target_table",
        F.concat(F.lit("Key_"), F.when(F.col("target_table").like("ads%"), "o").otherwise("x")).alias("target_column"),
        "source_table",
        F.when(~constant, F.lit("key_x")).alias("source_column"),
        F.when(constant, "constant").otherwise("ok").alias("lineage_status"),
        "target_kind",
        F.lit("key").alias("expression_sql"),
    )


RESOLVED_SQL = """way AS (SELECT ce.statement_id, ce.file_path, target_table, target_column, target_kind, expression_sql, source_table AS node, concat(source_table, '.', source_column) AS path,
    '' AS chain FROM ce WHERE lineage_status = 'ok'
    UNION ALL SELECT w.statement_id, w.file_path, w.target_table, w.target_column, w.target_kind, w.expression_sql, n.source_table, concat(n.source_table, '.', n.source_column, ' -> ', w.path),
      concat(n.statement_id, CASE WHEN w.chain = '' THEN '' ELSE ' -> ' END, w.chain)
    FROM way w JOIN ce n ON n.target_table = w.node AND lower(n.target_column) = 'key_x' AND n.source_column IS NOT NULL),
  resolved AS (SELECT DISTINCT statement_id, file_path, target_table, target_column, target_kind, expression_sql, node AS base_table, 'key_x' AS base_column, path, chain AS producer_chain
    FROM way WHERE node IN (SELECT table_name FROM base))"""


@register("lineage_columns", f"{BASE}, {COLUMN_SQL}, {RESOLVED_SQL} SELECT * FROM resolved")
def lineage_columns(spark, d):
    st, edges, _, bases = parts(spark, d)
    return lineage.base_columns(column_edges(edges), st, bases)


#: column metadata from three sources, derived from orders, customer and supplier
METADATA_SQL = """
  SELECT concat('ODS.`T', o_custkey % 200, '`') AS table_name, concat('Col_', o_orderkey % 9, CASE o_orderkey % 4 WHEN 0 THEN '_id' WHEN 1 THEN '_time' WHEN 2 THEN '_amt' ELSE '_path' END) AS column_name,
    CASE WHEN o_orderkey % 5 = 0 THEN '' ELSE 'string' END AS data_type, CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE concat('ddl ', o_orderkey % 9) END AS comment,
    'local_ddl' AS comment_source, 1 AS priority FROM orders
  UNION ALL SELECT concat('ods.t', c_custkey % 200), concat('col_', c_custkey % 9, '_id'), 'bigint', CASE WHEN c_custkey % 2 = 0 THEN ' ' ELSE 'remote' END, 'remote', 2 FROM customer
  UNION ALL SELECT concat('ods.t', s_suppkey % 200), CASE WHEN s_suppkey % 2 = 0 THEN 'platform' ELSE 'file_name' END, NULL, NULL, NULL, 3 FROM supplier"""


def metadata(t: Tables):
    orders = t.orders.selectExpr(
        "concat('ODS.`T', o_custkey % 200, '`') AS table_name",
        "concat('Col_', o_orderkey % 9, CASE o_orderkey % 4 WHEN 0 THEN '_id' WHEN 1 THEN '_time' WHEN 2 THEN '_amt' ELSE '_path' END) AS column_name",
        "CASE WHEN o_orderkey % 5 = 0 THEN '' ELSE 'string' END AS data_type",
        "CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE concat('ddl ', o_orderkey % 9) END AS comment",
        "'local_ddl' AS comment_source",
        "1 AS priority",
    )
    customer = t.customer.selectExpr(
        "concat('ods.t', c_custkey % 200) AS table_name",
        "concat('col_', c_custkey % 9, '_id') AS column_name",
        "'bigint' AS data_type",
        "CASE WHEN c_custkey % 2 = 0 THEN ' ' ELSE 'remote' END AS comment",
        "'remote' AS comment_source",
        "2 AS priority",
    )
    supplier = t.supplier.selectExpr(
        "concat('ods.t', s_suppkey % 200) AS table_name",
        "CASE WHEN s_suppkey % 2 = 0 THEN 'platform' ELSE 'file_name' END AS column_name",
        "CAST(NULL AS string) AS data_type",
        "CAST(NULL AS string) AS comment",
        "CAST(NULL AS string) AS comment_source",
        "3 AS priority",
    )
    return orders.unionByName(customer).unionByName(supplier)


MERGED_SQL = f"""md AS (SELECT lower(replace(table_name, '`', '')) AS table_name, lower(column_name) AS column_name, data_type, comment, comment_source, priority FROM ({METADATA_SQL})),
  ky AS (SELECT DISTINCT table_name, column_name FROM md),
  ty AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY table_name, column_name ORDER BY priority, data_type) AS rn FROM md WHERE coalesce(trim(data_type), '') <> '') WHERE rn = 1),
  cm AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY table_name, column_name ORDER BY priority, comment) AS rn FROM md WHERE coalesce(trim(comment), '') <> '') WHERE rn = 1),
  mm AS (SELECT ky.table_name, ky.column_name, coalesce(ty.data_type, '') AS data_type, coalesce(cm.comment, CASE WHEN ky.column_name = 'platform' THEN '平台标识。'
      WHEN ky.column_name = 'file_name' THEN '文件名。' WHEN ky.column_name LIKE '%\\_id' ESCAPE '\\' THEN concat(ky.column_name, ' 标识字段。') WHEN ky.column_name LIKE '%\\_time' ESCAPE '\\' THEN concat(ky.column_name, ' 时间字段。')
      WHEN ky.column_name LIKE '%\\_amt' ESCAPE '\\' THEN concat(ky.column_name, ' 金额字段。') ELSE concat(ky.column_name, ' 路径字段。') END) AS column_comment,
    coalesce(cm.comment_source, 'inferred') AS column_comment_source FROM ky LEFT JOIN ty USING (table_name, column_name) LEFT JOIN cm USING (table_name, column_name))"""


TABLES_SQL = "tb AS (SELECT DISTINCT table_name FROM (SELECT source_table AS table_name FROM edge UNION ALL SELECT target_table FROM edge))"


def all_tables(edges):
    names = edges.select(F.col("source_table").alias("table_name")).unionByName(
        edges.select(F.col("target_table").alias("table_name"))
    )
    return names.distinct()


@register(
    "catalog_index",
    f"""{BASE}, {TABLES_SQL}, {MERGED_SQL}, up AS (SELECT target_table AS table_name, count(DISTINCT source_table) AS n FROM edge GROUP BY 1),
    dn AS (SELECT source_table AS table_name, count(DISTINCT target_table) AS n FROM edge GROUP BY 1), al AS (SELECT base_table AS table_name, count(DISTINCT node) AS n FROM walk GROUP BY 1)
    SELECT table_name, coalesce(up.n, 0) AS direct_upstream_count, coalesce(dn.n, 0) AS direct_downstream_count, coalesce(al.n, 0) AS all_downstream_count, '未识别层级' AS table_layer, concat('未识别层级表，名称推断自 `', table_name, '`。') AS table_comment,
      CASE WHEN table_name IN (SELECT table_name FROM base) THEN 'base_table' WHEN table_name IN (SELECT table_name FROM made) THEN 'produced_local'
        WHEN table_name LIKE 'virtual.%' THEN 'virtual' ELSE 'external_reference' END AS lineage_role, (SELECT count(*) FROM mm WHERE mm.table_name = tb.table_name) AS column_count
    FROM tb LEFT JOIN up USING (table_name) LEFT JOIN dn USING (table_name) LEFT JOIN al USING (table_name)""",
)
def catalog_index(spark, d):
    _, edges, made, bases = parts(spark, d)
    counts = lineage.downstream_counts(edges, bases)
    return lineage.table_index(all_tables(edges), lineage.related_tables(edges), bases, made, lineage.merge_metadata(metadata(Tables(spark, d))), counts)


@register(
    "related_tables",
    f"""{BASE} SELECT DISTINCT target_table AS table_name, 'direct_upstream' AS relation, source_table AS related_table FROM edge
    UNION ALL SELECT DISTINCT source_table, 'direct_downstream', target_table FROM edge UNION ALL SELECT DISTINCT base_table, 'all_downstream', node FROM walk""",
)
def related_tables(spark, d):
    _, edges, _, bases = parts(spark, d)
    return lineage.related_tables(edges, lineage.downstream_tables(edges, bases))


@register(
    "relation_lists",
    f"""{BASE}, r AS (SELECT DISTINCT target_table AS table_name, 'direct_upstream' AS relation, source_table AS related_table FROM edge
      UNION ALL SELECT DISTINCT source_table, 'direct_downstream', target_table FROM edge UNION ALL SELECT DISTINCT base_table, 'all_downstream', node FROM walk)
    SELECT table_name, relation, string_agg(related_table, ', ' ORDER BY related_table) AS tables, count(*) AS table_count FROM r GROUP BY 1, 2""",
)
def relation_lists(spark, d):
    _, edges, _, bases = parts(spark, d)
    return lineage.relation_lists(lineage.related_tables(edges, lineage.downstream_tables(edges, bases)))


@register("metadata_merge", f"WITH {MERGED_SQL} SELECT * FROM mm")
def metadata_merge(spark, d):
    return lineage.merge_metadata(metadata(Tables(spark, d)))


@register(
    "dictionary",
    f"""{BASE}, {MERGED_SQL}, tb AS (SELECT table_name FROM base UNION SELECT table_name FROM made UNION SELECT table_name FROM mm UNION SELECT DISTINCT concat('virtual.v', n_nationkey) FROM nation)
    SELECT tb.table_name, CASE WHEN tb.table_name IN (SELECT table_name FROM base) THEN 'base_table' WHEN tb.table_name IN (SELECT table_name FROM made) THEN 'produced_local'
        WHEN tb.table_name LIKE 'virtual.%' THEN 'virtual' ELSE 'external_reference' END AS lineage_role, '未识别层级' AS table_layer,
      concat('未识别层级表，名称推断自 `', tb.table_name, '`。') AS table_comment, coalesce(column_name, '') AS column_name, coalesce(data_type, '') AS data_type,
      coalesce(column_comment, '') AS column_comment, coalesce(column_comment_source, '') AS column_comment_source
    FROM tb LEFT JOIN mm USING (table_name)""",
)
def dictionary(spark, d):
    t = Tables(spark, d)
    _, _, made, bases = parts(spark, d)
    merged = lineage.merge_metadata(metadata(t))
    virtual = t.nation.select(F.concat(F.lit("virtual.v"), F.col("n_nationkey").cast("string")).alias("table_name"))
    tables = bases.unionByName(made).unionByName(merged.select("table_name")).unionByName(virtual)
    return lineage.dictionary(tables, merged, bases, made)


@register(
    "field_index",
    f"""{BASE}, {COLUMN_SQL}, {RESOLVED_SQL}, fd AS (SELECT DISTINCT target_table AS table_name, target_column AS column_name FROM ce UNION SELECT DISTINCT source_table, source_column FROM ce WHERE source_column IS NOT NULL)
    SELECT table_name, column_name, (SELECT count(DISTINCT source_table) FROM ce WHERE target_table = table_name AND target_column = column_name) AS direct_upstream_count,
      (SELECT count(DISTINCT target_table) FROM ce WHERE source_table = table_name AND source_column = column_name) AS direct_downstream_count,
      (SELECT count(DISTINCT base_table) FROM resolved WHERE target_table = table_name AND target_column = column_name) AS base_source_count FROM fd""",
)
def field_index(spark, d):
    st, edges, _, bases = parts(spark, d)
    ce = column_edges(edges)
    fields = ce.select(F.col("target_table").alias("table_name"), F.col("target_column").alias("column_name")).unionByName(
        ce.where("source_column is not null").select(F.col("source_table").alias("table_name"), F.col("source_column").alias("column_name"))
    )
    return lineage.field_index(fields.distinct(), ce, lineage.base_sources(ce, st, bases))


@register(
    "base_table_summary",
    f"""{BASE}, {MERGED_SQL}, dn AS (SELECT source_table AS table_name, count(DISTINCT target_table) AS n FROM edge GROUP BY 1),
    al AS (SELECT base_table AS table_name, count(DISTINCT node) AS n FROM walk GROUP BY 1)
    SELECT table_name, '未识别层级' AS table_layer, (SELECT count(*) FROM mm WHERE mm.table_name = base.table_name) AS column_count, dn.n AS direct_downstream_count, al.n AS all_downstream_count
    FROM base JOIN dn USING (table_name) JOIN al USING (table_name)""",
)
def base_table_summary(spark, d):
    _, edges, _, bases = parts(spark, d)
    counts = lineage.downstream_counts(edges, bases)
    return lineage.base_table_summary(bases, lineage.related_tables(edges), lineage.merge_metadata(metadata(Tables(spark, d))), counts)


@register(
    "assessment",
    f"""{BASE}, {COLUMN_SQL} SELECT 'coverage' AS category, 'statement_count' AS item, count(*) AS value FROM st UNION ALL SELECT 'coverage', 'base_table_count', count(*) FROM base
    UNION ALL SELECT 'coverage', 'produced_table_count', count(*) FROM made UNION ALL SELECT 'coverage', 'table_edge_count', count(*) FROM edge
    UNION ALL SELECT 'quality', 'lineage_issue_count', count(*) FROM ce WHERE lineage_status <> 'ok'""",
)
def assessment(spark, d):
    st, edges, made, bases = parts(spark, d)
    broken = column_edges(edges).where("lineage_status <> 'ok'")
    return lineage.assessment(
        {
            "statement_count": ("coverage", st),
            "base_table_count": ("coverage", bases),
            "produced_table_count": ("coverage", made),
            "table_edge_count": ("coverage", edges),
            "lineage_issue_count": ("quality", broken),
        }
    )


@register(
    "lineage_issues",
    f"""{BASE}, {COLUMN_SQL} SELECT 'parse_issue' AS issue_type, statement_id, file_path, '' AS object_name, 'no source' AS detail FROM st WHERE len(source_tables) > 2
    UNION ALL SELECT 'lineage_issue', statement_id, '', '', lineage_status FROM ce WHERE lineage_status <> 'ok'
    UNION ALL SELECT 'remote_failure', '', '', s_name, 'no access' FROM supplier WHERE s_acctbal < 0""",
)
def lineage_issues(spark, d):
    st, edges, _, _ = parts(spark, d)
    parse = st.where(F.size("source_tables") > 2).select("statement_id", "file_path", F.lit("no source").alias("detail"))
    broken = column_edges(edges).where("lineage_status <> 'ok'").select("statement_id", F.col("lineage_status").alias("detail"))
    remote = Tables(spark, d).supplier.select(
        F.col("s_name").alias("object_name"), F.when(F.col("s_acctbal") < 0, "failed").otherwise("ok").alias("status"),
        F.lit("no access").alias("detail"),
    )
    return lineage.issues(parse, broken, remote)


@register(
    "table_layers",
    """WITH t AS (SELECT concat(CASE o_orderkey % 9 WHEN 0 THEN 'db.ods_' WHEN 1 THEN 'db.dwd_' WHEN 2 THEN 'db.dws_' WHEN 3 THEN 'db.dim_' WHEN 4 THEN 'db.tb' WHEN 5 THEN 'db.dm_'
      WHEN 6 THEN 'db.ads_' WHEN 7 THEN 'db.tmp_' ELSE 'db.x_' END, o_custkey) AS name FROM orders), s AS (SELECT name, split_part(name, '.', 2) AS n FROM t)
    SELECT CASE WHEN n LIKE 'ods#_%' ESCAPE '#' THEN 'ODS 原始层' WHEN n LIKE 'dwd#_%' ESCAPE '#' THEN 'DWD 明细层' WHEN n LIKE 'dws#_%' ESCAPE '#' THEN 'DWS 汇总层'
      WHEN n LIKE 'dim#_%' ESCAPE '#' OR contains(name, '.tb') THEN 'DIM 维度层' WHEN n LIKE 'dm#_%' ESCAPE '#' THEN 'DM 应用层' WHEN n LIKE 'ads#_%' ESCAPE '#' THEN 'ADS 应用层'
      WHEN n LIKE 'tmp#_%' ESCAPE '#' THEN 'TMP 临时层' ELSE '未识别层级' END AS layer, count(*) AS row_count, count(DISTINCT name) AS table_count FROM s GROUP BY 1""",
)
def table_layers(spark, d):
    name = """concat(CASE o_orderkey % 9 WHEN 0 THEN 'db.ods_' WHEN 1 THEN 'db.dwd_' WHEN 2 THEN 'db.dws_' WHEN 3 THEN 'db.dim_' WHEN 4 THEN 'db.tb' WHEN 5 THEN 'db.dm_'
      WHEN 6 THEN 'db.ads_' WHEN 7 THEN 'db.tmp_' ELSE 'db.x_' END, o_custkey) AS name"""
    return Tables(spark, d).orders.selectExpr(name).groupBy(lineage.table_layer("name").alias("layer")).agg(
        F.count(F.lit(1)).alias("row_count"), F.count_distinct("name").alias("table_count")
    )


@register(
    "name_aliases",
    f"""WITH al AS (SELECT concat('ods.t', c_custkey % 200) AS alias, min(concat('ods.main', c_custkey % 7)) AS table_name FROM customer WHERE c_custkey % 3 = 0 GROUP BY 1),
    m AS (SELECT lower(replace(table_name, '`', '')) AS n FROM ({METADATA_SQL}))
    SELECT coalesce(al.table_name, n) AS table_name, count(*) AS row_count FROM m LEFT JOIN al ON al.alias = n GROUP BY 1""",
)
def name_aliases(spark, d):
    t = Tables(spark, d)
    aliases = t.customer.where("c_custkey % 3 = 0").selectExpr(
        "concat('ods.t', c_custkey % 200) AS alias", "concat('ods.main', c_custkey % 7) AS table_name"
    )
    names = metadata(t).select(lineage.normalize_table("table_name").alias("table_name"))
    return lineage.apply_aliases(names, "table_name", aliases).groupBy("table_name").agg(
        F.count(F.lit(1)).alias("row_count")
    )


#: long chains of customers, some closed to rings, and ways between them
CHAIN_SQL = """links AS (SELECT CAST(c_custkey AS BIGINT) AS a, CAST(c_custkey + 1 AS BIGINT) AS b FROM customer WHERE c_custkey % 400 <> 0
  UNION SELECT c_custkey, c_custkey - 150 FROM customer WHERE c_custkey % 800 = 399 UNION SELECT c_custkey, c_custkey + 401 FROM customer WHERE c_custkey % 400 = 250
  UNION SELECT c_custkey, c_custkey FROM customer WHERE c_custkey % 500 = 77)"""


@register(
    "deep_reach",
    f"""WITH RECURSIVE {CHAIN_SQL}, starts AS (SELECT CAST(c_custkey AS BIGINT) AS node FROM customer WHERE c_custkey % 40 = 1),
    walk AS (SELECT node AS start, b AS node FROM starts JOIN links ON node = a UNION SELECT start, b FROM walk JOIN links ON node = a)
    SELECT starts.node, count(walk.node) AS reached FROM starts LEFT JOIN walk ON starts.node = start GROUP BY 1""",
)
def deep_reach(spark, d):
    c = Tables(spark, d).customer.select(F.col("c_custkey").cast("long").alias("a"))
    a = F.col("a")
    links = c.where(a % 400 != 0).withColumn("b", a + 1)
    links = links.unionByName(c.where(a % 800 == 399).withColumn("b", a - 150)).unionByName(c.where(a % 400 == 250).withColumn("b", a + 401))
    links = links.unionByName(c.where(a % 500 == 77).withColumn("b", a))
    return reach.reach_counts(links, c.where(a % 40 == 1).select(a.alias("node")))


@register(
    "base_sources",
    f"""{BASE}, {COLUMN_SQL}, {RESOLVED_SQL} SELECT DISTINCT target_table, target_column, base_table, base_column FROM resolved""",
)
def base_sources(spark, d):
    st, edges, _, bases = parts(spark, d)
    return lineage.base_sources(column_edges(edges), st, bases)
