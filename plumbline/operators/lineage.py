"""Catalog and lineage over edge tables.

Statements come in as rows: ``statement_id, file_path, target_dataset,
target_kind, statement_type, source_tables array<string>, has_query boolean``.
Column edges: ``statement_id, target_table, target_column, source_table,
source_column, lineage_status, target_kind, expression_sql``.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from plumbline.functions.columns import col, count_if, non_blank
from plumbline.functions.fixed import (
    COLUMN_COMMENT_DEFAULT,
    COLUMN_COMMENTS,
    COLUMN_PART_COMMENTS,
    COLUMN_SUFFIX_COMMENTS,
    LAYER_PREFIXES,
    LAYER_UNKNOWN,
)
from plumbline.operators import reach
from plumbline.operators.lists import name_lists
from plumbline.operators.ordered import cut
from plumbline.operators.reach import closure

PRODUCED_KINDS = ["physical_table", "view", "temp_view"]
ARROW = " -> "


# --- names -------------------------------------------------------------------


def normalize_table(c: Column | str, aliases: dict[str, str] | None = None) -> Column:
    """Lower-case dotted name without back-ticks; aliases map to their table."""
    parts = F.split(F.trim(col(c)), r"\.")
    clean = F.filter(F.transform(parts, lambda p: F.btrim(p, F.lit("`"))), lambda p: p != "")
    name = F.lower(F.array_join(clean, "."))
    for alias, table in (aliases or {}).items():
        name = F.when(name == alias, F.lit(table)).otherwise(name)
    return name


def normalize_column(c: Column | str) -> Column:
    return F.lower(F.btrim(F.trim(col(c)), F.lit("`")))


def apply_aliases(df: DataFrame, column: str, aliases: DataFrame) -> DataFrame:
    """Replace names by their table in an alias frame (alias, table_name)."""
    known = aliases.groupBy(F.col("alias").alias(column)).agg(F.min("table_name").alias("_to"))
    return df.join(known, column, "left").withColumn(column, F.coalesce("_to", column)).drop("_to").select(*df.columns)


def is_physical(c: Column | str) -> Column:
    c = col(c)
    return F.coalesce(F.contains(c, F.lit(".")) & ~c.startswith("virtual."), F.lit(False))


def table_layer(c: Column | str) -> Column:
    """Warehouse layer of a table by the prefix of its name."""
    c = col(c)
    short = F.substring_index(c, ".", -1)
    out = None
    for prefix, layer in LAYER_PREFIXES:
        hit = short.startswith(prefix)
        if prefix == "dim_":
            hit = hit | F.contains(c, F.lit(".tb"))
        out = F.when(hit, layer) if out is None else out.when(hit, layer)
    return out.otherwise(LAYER_UNKNOWN)


def table_comment(c: Column | str) -> Column:
    c = col(c)
    return F.concat(table_layer(c), F.lit("表，名称推断自 `"), c, F.lit("`。"))


def column_comment(c: Column | str) -> Column:
    """Comment guessed from a column name: known names, then endings, then parts."""
    c = col(c)
    name = normalize_column(c)
    known = F.create_map(*[F.lit(x) for pair in COLUMN_COMMENTS.items() for x in pair])
    out = F.when(known[name].isNotNull(), known[name])
    for endings, note in COLUMN_SUFFIX_COMMENTS:
        hit = F.lit(False)
        for ending in endings:
            hit = hit | name.endswith(ending)
        out = out.when(hit, F.concat(c, F.lit(" " + note)))
    for part, note in COLUMN_PART_COMMENTS:
        out = out.when(F.contains(name, F.lit(part)), F.concat(c, F.lit(" " + note)))
    return out.otherwise(F.concat(c, F.lit(" " + COLUMN_COMMENT_DEFAULT)))


# --- tables ------------------------------------------------------------------


def produced_tables(statements: DataFrame) -> DataFrame:
    return (
        statements.where(non_blank("target_dataset") & F.col("target_kind").isin(PRODUCED_KINDS))
        .select(normalize_table("target_dataset").alias("table_name"))
        .distinct()
    )


def table_edges(statements: DataFrame, aliases: dict[str, str] | None = None) -> DataFrame:
    """One row per statement, source and target; sources are physical or produced here."""
    rows = statements.where(non_blank("target_dataset")).select(
        "statement_id",
        "file_path",
        F.explode("source_tables").alias("_source"),
        F.col("target_dataset").alias("target_table"),
        "target_kind",
        "statement_type",
    )
    rows = rows.withColumn("source_table", normalize_table("_source", aliases)).drop("_source").distinct()
    columns = ["statement_id", "file_path", "source_table", "target_table", "target_kind", "statement_type"]
    # physical sources, mostly nearly all, need no look at what is produced
    physical = is_physical("source_table")
    made = produced_tables(statements).select(F.col("table_name").alias("source_table"))
    others = rows.where(~physical).join(made, "source_table", "left_semi")
    return rows.where(physical).select(*columns).unionByName(others.select(*columns))


def base_tables(edges: DataFrame, produced: DataFrame) -> DataFrame:
    """Referenced physical tables that no statement produces."""
    sources = edges.where(is_physical("source_table")).select(F.col("source_table").alias("table_name")).distinct()
    return sources.join(produced.select("table_name"), "table_name", "left_anti")


def downstream_tables(edges: DataFrame, bases: DataFrame) -> DataFrame:
    """(base_table, downstream_table): every table reached from each base table, once, without the ways there.

    Chains and cycles of tables are condensed first (``reach``), so long ones take few rounds.
    """
    links = edges.select(F.col("source_table").alias("a"), F.col("target_table").alias("b"))
    pairs = reach.reach_pairs(links, bases.select(F.col("table_name").alias("node")))
    return pairs.select(F.col("start").alias("base_table"), F.col("node").alias("downstream_table"))


def downstream_counts(edges: DataFrame, bases: DataFrame) -> DataFrame:
    """(table_name, all_downstream_count) of each base table; the pairs of ``downstream_tables`` are not listed for it."""
    links = edges.select(F.col("source_table").alias("a"), F.col("target_table").alias("b"))
    counts = reach.reach_counts(links, bases.select(F.col("table_name").alias("node")))
    return counts.select(F.col("node").alias("table_name"), F.col("reached").alias("all_downstream_count"))


def downstream_paths(edges: DataFrame, bases: DataFrame) -> DataFrame:
    """Every outgoing edge of every table reached from each base table.

    Breadth first: a table is expanded once per base, along its shortest path
    (the smallest one in name order when several are equally short), so edges
    back to known tables appear once and cycles end. Each round is one join
    with the edges and one write of its results, marked as new or known; now and
    then the rounds so far become one table.
    """
    links = cut(edges.select("source_table", "target_table").distinct())
    start = bases.select(F.col("table_name").alias("base_table"), F.col("table_name").alias("node"))
    frontier = start.withColumn("path", F.array("node"))
    sources = links.select("source_table").distinct()  # tables without outgoing edges need no further round
    rounds: list[DataFrame] = []
    while True:
        step = frontier.join(links, F.col("node") == F.col("source_table")).select(
            "base_table",
            F.col("target_table").alias("node"),
            F.concat("path", F.array("target_table")).alias("path"),
        )
        known = reduce(DataFrame.unionByName, [start, *[r.where("new").select("base_table", "node") for r in rounds]]).distinct()
        marked = step.join(known.withColumn("_known", F.lit(True)), ["base_table", "node"], "left")
        step = cut(marked.select("base_table", "node", "path", F.col("_known").isNull().alias("new")))
        rounds.append(step)
        if len(rounds) > reach.COMPACT:
            rounds = [cut(reduce(DataFrame.unionByName, rounds))]
        new = step.where("new").join(sources, F.col("node") == F.col("source_table"), "left_semi")
        if new.isEmpty():
            break
        frontier = new.groupBy("base_table", "node").agg(F.min("path").alias("path"))
    out = reduce(DataFrame.unionByName, rounds)
    return out.select(
        "base_table",
        F.col("node").alias("downstream_table"),
        (F.size("path") - 1).alias("hop_count"),
        F.array_join("path", ARROW).alias("path"),
    )


# --- columns -----------------------------------------------------------------


def column_steps(column_edges: DataFrame, statements: DataFrame) -> DataFrame:
    """One step up from a column, within statements that hold a query: at, _by, _table, _next, _column."""
    queried = statements.where("has_query").select("statement_id").distinct()
    rows = column_edges.where(non_blank("source_table") & non_blank("source_column"))
    return rows.join(queried, "statement_id", "left_semi").select(
        F.concat_ws(".", "target_table", normalize_column("target_column")).alias("at"),
        F.col("statement_id").alias("_by"),
        F.col("source_table").alias("_table"),
        F.concat_ws(".", "source_table", normalize_column("source_column")).alias("_next"),
        normalize_column("source_column").alias("_column"),
    )


def base_sources(column_edges: DataFrame, statements: DataFrame, bases: DataFrame) -> DataFrame:
    """(target_table, target_column, base_table, base_column): the base columns behind every column, each once.

    Every (column, base column) pair is followed once, from the bases down,
    however many ways lead there; ``base_columns`` lists the ways themselves.
    Columns that nothing comes from, mostly the bulk, are on no way between two
    others: they take no part in the rounds and get the bases of the columns
    directly above them at the end.
    """
    start, node = ["target_table", "target_column"], ["table", "at"]
    named = non_blank("source_table") & non_blank("source_column")
    column = normalize_column("source_column")
    above = column_edges.where(named).select(
        *start, "lineage_status", F.col("source_table").alias("table"), column.alias("column"), F.concat_ws(".", "source_table", column).alias("at")
    )
    sources = cut(above.select(*node, "column").distinct())
    base_names = cut(bases.select(F.col("table_name").alias("table")))
    # no way goes on above a base table
    between = sources.join(base_names, "table", "left_anti").select(F.col("table").alias("_low"), F.col("at").alias("_low_at"))
    low_at = F.concat_ws(".", "target_table", normalize_column("target_column"))
    inner = column_edges.withColumn("_low_at", low_at).join(between.select("_low_at").distinct(), "_low_at", "left_semi")
    steps = column_steps(inner, statements).select(F.col("at").alias("_low_at"), F.col("_table").alias("table"), F.col("_next").alias("at")).distinct()
    steps = cut(steps.join(between, "_low_at"))
    first = sources.join(base_names, "table", "left_semi").select(*node, F.col("table").alias("base_table"), F.col("column").alias("base_column"))
    base = ["base_table", "base_column"]

    def below(rows: DataFrame) -> DataFrame:
        return rows.join(steps, node).select(F.col("_low").alias("table"), F.col("_low_at").alias("at"), *base).distinct()

    found = closure(first, below, [*node, *base])
    return above.where("lineage_status = 'ok'").join(found, node).select(*start, *base).distinct()


def base_columns(column_edges: DataFrame, statements: DataFrame, bases: DataFrame) -> DataFrame:
    """Base columns behind every column edge, with path and producing statements (and the edge's file, if it has one).

    All acyclic ways from a column up to base tables are followed, one join per
    level. A (table, column) already on the way is not visited again.
    """
    ok = (F.col("lineage_status") == "ok") & non_blank("source_table") & non_blank("source_column")
    steps = cut(column_steps(column_edges, statements))
    fields = ["statement_id", *[c for c in ("file_path",) if c in column_edges.columns], "target_table", "target_column", "target_kind", "expression_sql"]
    is_base = cut(bases.select(F.col("table_name").alias("table"), F.lit(True).alias("_base")))
    frontier = column_edges.where(ok).select(
        *fields,
        F.col("source_table").alias("table"),
        normalize_column("source_column").alias("column"),
        F.array(F.concat_ws(".", "source_table", normalize_column("source_column"))).alias("way"),
        F.array().cast("array<string>").alias("chain"),
    )
    found = None
    while True:
        marked = cut(frontier.join(is_base, "table", "left"))
        done = marked.where("_base")
        found = done if found is None else found.unionByName(done)
        rest = marked.where("_base is null").drop("_base")
        if rest.isEmpty():
            break
        at = rest.withColumn("at", F.element_at("way", -1))
        nxt = at.join(steps, "at").where(~F.array_contains("way", F.col("_next")))
        frontier = nxt.select(
            *fields,
            F.col("_table").alias("table"),
            F.col("_column").alias("column"),
            F.concat("way", F.array("_next")).alias("way"),
            F.concat("chain", F.array("_by")).alias("chain"),
        )
    return found.select(
        *fields,
        F.col("table").alias("base_table"),
        F.col("column").alias("base_column"),
        F.array_join(F.reverse("way"), ARROW).alias("path"),
        F.array_join(F.reverse("chain"), ARROW).alias("producer_chain"),
    ).distinct()


# --- metadata and catalog ----------------------------------------------------


def merge_metadata(columns: DataFrame) -> DataFrame:
    """First non-empty type and comment per column by source priority (1 is best).

    Input: ``table_name, column_name, data_type, comment, comment_source,
    priority``. Columns without any comment get an inferred one.
    """

    def first(c: str) -> Column:
        return F.min_by(c, F.when(non_blank(c), F.struct("priority", c)))

    merged = columns.groupBy(
        normalize_table("table_name").alias("table_name"), normalize_column("column_name").alias("column_name")
    ).agg(
        first("data_type").alias("data_type"),
        F.min_by("comment_source", F.when(non_blank("comment"), F.struct("priority", "comment"))).alias("_source"),
        first("comment").alias("_comment"),
    )
    return merged.select(
        "table_name",
        "column_name",
        F.coalesce("data_type", F.lit("")).alias("data_type"),
        F.coalesce("_comment", column_comment("column_name")).alias("column_comment"),
        F.when(F.col("_comment").isNotNull(), F.coalesce("_source", F.lit("unknown")))
        .otherwise("inferred")
        .alias("column_comment_source"),
    )


def lineage_role(tables: DataFrame, bases: DataFrame, produced: DataFrame) -> DataFrame:
    """Tables with their role: base, produced here, virtual or external."""
    b = bases.select("table_name", F.lit(True).alias("_b"))
    p = produced.select("table_name", F.lit(True).alias("_p"))
    role = (
        F.when(F.col("_b"), "base_table")
        .when(F.col("_p"), "produced_local")
        .when(F.col("table_name").startswith("virtual."), "virtual")
        .otherwise("external_reference")
    )
    out = tables.join(b, "table_name", "left").join(p, "table_name", "left")
    return out.withColumn("lineage_role", role).drop("_b", "_p")


def dictionary(tables: DataFrame, metadata: DataFrame, bases: DataFrame, produced: DataFrame) -> DataFrame:
    """Tables with role and comment, one row per column (one blank row without columns)."""
    named = lineage_role(tables.select("table_name").distinct(), bases, produced)
    named = named.withColumns(
        {"table_layer": table_layer("table_name"), "table_comment": table_comment("table_name")}
    )
    blank = ["column_name", "data_type", "column_comment", "column_comment_source"]
    return named.join(metadata, "table_name", "left").na.fill("", blank)


def related_tables(edges: DataFrame, reached: DataFrame | None = None) -> DataFrame:
    """(table, relation, related table): direct upstream, direct and (with ``reached``) all downstream.

    The long form holds the lists of the catalog without gathering any of them
    into one row.
    """
    up = edges.select(
        F.col("target_table").alias("table_name"),
        F.lit("direct_upstream").alias("relation"),
        F.col("source_table").alias("related_table"),
    )
    down = edges.select(
        F.col("source_table").alias("table_name"),
        F.lit("direct_downstream").alias("relation"),
        F.col("target_table").alias("related_table"),
    )
    if reached is None:
        return up.unionByName(down).distinct()
    far = reached.select(
        F.col("base_table").alias("table_name"),
        F.lit("all_downstream").alias("relation"),
        F.col("downstream_table").alias("related_table"),
    )
    return up.unionByName(down).unionByName(far).distinct()


def table_index(
    tables: DataFrame,
    related: DataFrame,
    bases: DataFrame | None = None,
    produced: DataFrame | None = None,
    metadata: DataFrame | None = None,
    reached: DataFrame | None = None,
) -> DataFrame:
    """Layer, comment and number of direct and transitive neighbours of every table.

    With base and produced tables also its role, with merged metadata its number
    of columns. Transitive counts come from ``reached`` (``downstream_counts``),
    or else from the listed relations.
    """
    counts = related.groupBy("table_name").agg(
        *[
            count_if(F.col("relation") == r).alias(f"{r}_count")
            for r in ("direct_upstream", "direct_downstream", "all_downstream")
        ]
    )
    if reached is not None:
        counts = counts.drop("all_downstream_count").join(reached, "table_name", "full")
    out = tables.select("table_name").distinct().join(counts, "table_name", "left").na.fill(0)
    if bases is not None and produced is not None:
        out = lineage_role(out, bases, produced)
    if metadata is not None:
        columns = metadata.groupBy("table_name").agg(F.count(F.lit(1)).alias("column_count"))
        out = out.join(columns, "table_name", "left").na.fill(0, ["column_count"])
    return out.withColumns({"table_layer": table_layer("table_name"), "table_comment": table_comment("table_name")})


def relation_lists(related: DataFrame) -> DataFrame:
    """Complete neighbour lists as text, with their lengths; the rows of ``related_tables`` are the same in long form."""
    return name_lists(related, ["table_name", "relation"], "related_table", "tables", "table_count")


def field_index(dictionary_rows: DataFrame, column_edges: DataFrame, resolved: DataFrame) -> DataFrame:
    """Fields with the number of tables directly above, directly below and at their base."""
    links = column_edges.where(F.col("source_table").isNotNull() & F.col("target_table").isNotNull())
    ways = {
        "direct_upstream_count": (links, "target_table", "target_column", "source_table"),
        "direct_downstream_count": (links, "source_table", "source_column", "target_table"),
        "base_source_count": (resolved, "target_table", "target_column", "base_table"),
    }
    parts = None
    for way, (df, table, column, other) in enumerate(ways.values()):
        one = df.select(
            F.col(table).alias("table_name"),
            F.col(column).alias("column_name"),
            F.col(other).alias("_other"),
            F.lit(way).cast("byte").alias("_way"),
        )
        parts = one if parts is None else parts.unionByName(one)
    counts = parts.distinct().groupBy("table_name", "column_name").agg(
        *[count_if(F.col("_way") == way).alias(name) for way, name in enumerate(ways)]
    )
    fields = dictionary_rows.where(non_blank("column_name"))
    return fields.join(counts, ["table_name", "column_name"], "left").na.fill(0, list(ways))


def base_table_summary(bases: DataFrame, related: DataFrame, metadata: DataFrame, reached: DataFrame | None = None) -> DataFrame:
    """Base tables with layer, columns, direct and transitive downstream counts."""
    return table_index(bases, related, metadata=metadata, reached=reached).drop("direct_upstream_count", "table_comment")


def assessment(frames: dict[str, tuple[str, DataFrame]]) -> DataFrame:
    """(category, item, value) row counts; ``frames`` maps item to (category, frame)."""
    out = None
    for item, (category, df) in frames.items():
        row = df.agg(F.count(F.lit(1)).alias("value")).select(
            F.lit(category).alias("category"), F.lit(item).alias("item"), "value"
        )
        out = row if out is None else out.unionByName(row)
    return out


def issues(parse: DataFrame, lineage: DataFrame, remote: DataFrame | None = None) -> DataFrame:
    """Parse, lineage and access problems in one frame.

    ``parse`` has statement_id, file_path, detail; ``lineage`` statement_id,
    detail; ``remote`` object_name, status, detail.
    """
    empty = F.lit("")
    out = parse.select(
        F.lit("parse_issue").alias("issue_type"), "statement_id", "file_path", empty.alias("object_name"), "detail"
    ).unionByName(
        lineage.select(
            F.lit("lineage_issue").alias("issue_type"),
            "statement_id",
            empty.alias("file_path"),
            empty.alias("object_name"),
            "detail",
        )
    )
    if remote is not None:
        failed = remote.where("status = 'failed'").select(
            F.lit("remote_failure").alias("issue_type"),
            empty.alias("statement_id"),
            empty.alias("file_path"),
            "object_name",
            "detail",
        )
        out = out.unionByName(failed)
    return out
