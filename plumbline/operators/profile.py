"""Field profiles, distributions and attribute clusters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from plumbline.functions.columns import (
    blank_to_label,
    blank_to_null,
    count_if,
    non_blank,
    ratio,
)
from plumbline.functions.fixed import NONE_LABEL
from plumbline.operators.ordered import distinct_profile, grouped_distinct, shares, wide_to_rows
from plumbline.sources.tables import constant_rows

UNBOUND = "未命中"


def field_profile(
    df: DataFrame, fields: dict[str, str | None] | list[str], exact: bool = False
) -> DataFrame:
    """Total, missing rows and distinct values per logical field in one scan.

    The default counts distinct values with a bounded sketch; ``exact`` counts
    them through one shuffle that every field shares.
    """
    physical = fields if isinstance(fields, dict) else {f: f for f in fields}
    names = list(physical)
    bound = F.create_map(*[F.lit(x) for f in names for x in (f, physical[f] or UNBOUND)])
    if exact:
        stats = distinct_profile(df, {f: F.col(f"`{f}`") for f in names})
        return stats.select(
            F.col("field").alias("logical_field"),
            bound[F.col("field")].alias("physical_column"),
            "total_rows",
            "null_rows",
            ratio(F.col("null_rows"), F.col("total_rows")).alias("null_ratio"),
            "distinct_values",
        )
    one = df.agg(
        F.count(F.lit(1)).alias("total"),
        *[count_if(F.col(f"`{f}`").isNull()).alias(f"m{i}") for i, f in enumerate(names)],
        *[F.approx_count_distinct(F.col(f"`{f}`")).alias(f"d{i}") for i, f in enumerate(names)],
    )
    rows = [
        [
            F.lit(f),
            F.lit(physical[f] or UNBOUND),
            F.col("total"),
            F.col(f"m{i}"),
            ratio(F.col(f"m{i}"), F.col("total")),
            F.col(f"d{i}"),
        ]
        for i, f in enumerate(names)
    ]
    out = ["logical_field", "physical_column", "total_rows", "null_rows", "null_ratio", "distinct_values"]
    return wide_to_rows(one, rows, out)


def value_counts(df: DataFrame, value: Column, name: str = "field_value") -> DataFrame:
    return df.groupBy(value.alias(name)).agg(F.count(F.lit(1)).alias("row_count"))


def top_distribution(
    df: DataFrame, column: str, n: int | None = 20, label: str = NONE_LABEL
) -> DataFrame:
    """Values with rows, share and cumulative share; ``n=None`` keeps every value."""
    counts = value_counts(df, blank_to_label(column, label))
    return shares(counts, "field_value", "row_count", counts.agg(F.sum("row_count")), n)


def distribution_with_measures(
    df: DataFrame,
    column: str,
    entity: str,
    paid: Column,
    amount: str,
    n: int = 30,
    label: str = NONE_LABEL,
) -> DataFrame:
    """Distribution with entities, paid entities and amount per value, all exact.

    Rows are merged per (value, entity) first, so both distinct counts come
    from one shuffle and a frequent value is spread over many tasks.
    """
    value = F.coalesce(F.col(column).cast("string"), F.lit(label)).alias("field_value")
    per_entity = df.groupBy(value, F.col(entity).alias("_entity")).agg(
        F.count(F.lit(1)).alias("n"),
        F.bool_or(F.coalesce(paid, F.lit(False))).alias("paid"),
        F.sum(F.coalesce(F.col(amount), F.lit(0.0))).alias("amount"),
    )
    counts = per_entity.groupBy("field_value").agg(
        F.sum("n").alias("row_count"),
        F.count("_entity").alias("entity_cnt"),
        F.count(F.when(F.col("paid"), F.col("_entity"))).alias("paid_cnt"),
        F.round(F.sum("amount"), 2).alias("amount_sum"),
    )
    total = counts.agg(F.sum("row_count")).scalar()
    top = counts.orderBy(F.desc("row_count"), F.asc("field_value")).limit(n)
    return top.withColumn("row_ratio", ratio(F.col("row_count"), total))


def distribution_stats(df: DataFrame, column: str, label: str = NONE_LABEL) -> DataFrame:
    """Distinct values, largest value with share, cumulative share of the ten largest."""
    counts = value_counts(df, blank_to_label(column, label))
    all_values = counts.agg(
        F.count(F.lit(1)).alias("distinct_values"), F.sum("row_count").alias("total")
    ).select(F.struct("*"))
    top = counts.orderBy(F.desc("row_count"), F.asc("field_value")).limit(10)
    share = ratio(F.col("row_count"), F.col("_all.total"))
    return (
        top.withColumn("_all", all_values.scalar())
        .withColumn("_share", share)
        .agg(
            F.coalesce(F.max("_all.distinct_values"), F.lit(0)).alias("distinct_values"),
            F.min_by("field_value", F.struct(-F.col("row_count"), F.col("field_value"))).alias("top1_label"),
            F.coalesce(F.max("_share"), F.lit(0.0)).alias("top1_probability"),
            F.round(F.coalesce(F.sum("_share"), F.lit(0.0)), 6).alias("top10_cumulative_probability"),
        )
    )


def cluster_label(attributes: dict[str, Column]) -> Column:
    return F.concat_ws(" | ", *[F.concat(F.lit(f"{k}="), v) for k, v in attributes.items()])


def attribute_clusters(
    df: DataFrame, entity: str, attributes: list[str], n: int | None = 10, label: str = NONE_LABEL
) -> DataFrame:
    """Entities per combination of attributes, one value of each attribute per entity.

    The value of an attribute is the largest non-blank one the entity has.
    """
    per_entity = df.where(non_blank(entity)).groupBy(entity).agg(
        *[F.max(blank_to_null(a)).alias(a) for a in attributes]
    )
    parts = {a: F.coalesce(F.col(a), F.lit(label)) for a in attributes}
    counts = per_entity.groupBy(cluster_label(parts).alias("cluster_label")).agg(
        F.count(F.lit(1)).alias("entity_count")
    )
    return shares(counts, "cluster_label", "entity_count", counts.agg(F.sum("entity_count")), n)


def row_clusters(
    df: DataFrame, attributes: dict[str, str], n: int | None = 10, label: str = NONE_LABEL
) -> DataFrame:
    """Rows per combination of attributes ``{name in the label: column}``."""
    parts = {name: blank_to_label(c, label) for name, c in attributes.items()}
    counts = value_counts(df, cluster_label(parts), "cluster_label")
    return shares(counts, "cluster_label", "row_count", counts.agg(F.sum("row_count")), n)


def group_count(df: DataFrame, value: Column) -> DataFrame:
    """Number of groups a distribution over ``value`` has, NULL being one of them."""
    return value_counts(df, value).agg(F.count(F.lit(1)).alias("group_count"))


def overview(
    df: DataFrame,
    distinct: list[str],
    sums: list[str] | None = None,
    times: list[str] | None = None,
    distinct_if: dict[str, tuple[str, Column]] | None = None,
    exact: bool = True,
) -> DataFrame:
    """Totals, distinct counts, conditional distinct counts, sums and time ranges."""
    aggs = [F.count(F.lit(1)).alias("total_rows")]
    wanted = {f"distinct_{c}": F.col(c) for c in distinct}
    wanted |= {name: F.when(p, F.col(c)) for name, (c, p) in (distinct_if or {}).items()}
    if not exact:
        aggs += [F.approx_count_distinct(c).alias(name) for name, c in wanted.items()]
    aggs += [F.round(F.sum(F.coalesce(F.col(c), F.lit(0.0))), 2).alias(f"{c}_sum") for c in sums or []]
    for c in times or []:
        aggs += [F.min(c).cast("string").alias(f"min_{c}"), F.max(c).cast("string").alias(f"max_{c}")]
    one = df.agg(*aggs)
    if not exact or not wanted:
        return one
    picks = [
        F.coalesce(F.max(F.when(F.col("field") == name, F.col("distinct_values"))), F.lit(0)).alias(name)
        for name in wanted
    ]
    counts = distinct_profile(df, wanted).agg(F.struct(*picks).alias("d")).scalar()
    return one.withColumn("_d", counts).select(*one.columns, "_d.*")


def entity_preview(
    df: DataFrame,
    keys: dict[str, Column],
    distinct: dict[str, str],
    order: list[Column],
    n: int,
    where: Column | None = None,
) -> DataFrame:
    """Rows and distinct counts per key, first n by the order."""
    base = df.where(where) if where is not None else df
    out = grouped_distinct(base, keys, {name: F.col(c) for name, c in distinct.items()})
    return out.orderBy(*order).limit(n)


def two_key_distribution(
    df: DataFrame, first: str, second: str, entity: str, amount: str, n: int = 30, label: str = NONE_LABEL
) -> DataFrame:
    """Rows, distinct entities and amount per pair of values."""
    keys = [F.coalesce(F.col(c).cast("string"), F.lit(label)).alias(c) for c in (first, second)]
    out = df.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("row_count"),
        F.count_distinct(entity).alias("entity_cnt"),
        F.round(F.sum(F.coalesce(F.col(amount), F.lit(0.0))), 2).alias("amount_sum"),
    )
    return out.orderBy(F.desc("row_count"), F.asc(first), F.asc(second)).limit(n)


def text_distribution(df: DataFrame, column: str, distinct: dict[str, str], n: int = 20) -> DataFrame:
    """Values of a free-text field with rows and distinct counts of other fields."""
    rows = df.where(F.col(column).isNotNull())
    out = grouped_distinct(rows, {column: F.col(column)}, {name: F.col(c) for name, c in distinct.items()})
    return out.orderBy(F.desc("row_count"), F.asc(column)).limit(n)


def longest_texts(df: DataFrame, column: str, columns: list[str], n: int = 20) -> DataFrame:
    """Rows with the longest texts."""
    rows = df.where(F.col(column).isNotNull()).select(*columns, column)
    return rows.orderBy(F.desc(F.length(column)), F.asc(column), *[F.asc(c) for c in columns]).limit(n)


def field_risk(
    fill: DataFrame, unusable: float = 80.0, auxiliary: float = 40.0, rate: str = "miss_rate_pct"
) -> DataFrame:
    """Fields too empty to slice by: unusable, or only auxiliary."""
    level = F.when(F.col(rate) >= unusable, "unusable_slice").when(F.col(rate) >= auxiliary, "auxiliary_only")
    return fill.withColumn("risk_level", level).where(F.col("risk_level").isNotNull())


def table_evidence(
    df: DataFrame, name: str, bound: dict[str, str | None], time_fields: list[str],
    entity: str, enhancement: list[str] | None = None,
) -> DataFrame:
    """One row of evidence about a candidate base table."""
    typed = sum(
        1
        for f in time_fields
        if f in df.columns and df.schema[f].dataType.simpleString().startswith(("timestamp", "date"))
    )
    hits = [f for f in enhancement or [] if bound.get(f)]
    key = bound.get(entity)
    distinct = F.count_distinct(F.col(key)) if key else F.lit(0).cast("long")
    return df.agg(F.count(F.lit(1)).alias("record_count"), distinct.alias("distinct_entities")).select(
        F.lit(name).alias("table_name"),
        F.lit(len(df.columns)).alias("column_count"),
        F.lit(sum(1 for v in bound.values() if v)).alias("matched_core_fields"),
        F.lit(typed).alias("typed_time_fields"),
        F.lit(len(hits)).alias("enhancement_fields"),
        "record_count",
        "distinct_entities",
    )


CRITERIA = ["record_count", "matched_core_fields", "typed_time_fields", "enhancement_fields"]


def elect_base_table(evidence: DataFrame) -> DataFrame:
    """Recommend the candidate that leads in most criteria; the rest are auxiliary.

    Criteria are row coverage, matched core fields, typed time fields and
    enhancement fields. Ties go to row coverage, then matched fields, then name.
    The input has one row per candidate table.
    """
    best = evidence.agg(F.struct(*[F.max(c).alias(c) for c in CRITERIA]).alias("b")).scalar()
    scored = evidence.withColumn("_best", best).withColumn(
        "criteria_led", sum([(F.col(c) == F.col(f"_best.{c}")).cast("int") for c in CRITERIA], F.lit(0))
    )
    key = F.struct("criteria_led", "record_count", "matched_core_fields", "table_name")
    winner = scored.agg(F.max_by("table_name", key)).scalar()
    return scored.drop("_best").withColumn(
        "recommendation", F.when(F.col("table_name") == winner, "主分析底表").otherwise("辅助对照表")
    )


def entity_coverage(df: DataFrame, group: str, entity: str) -> DataFrame:
    """Distinct entities per value of a dimension."""
    return df.groupBy(group).agg(F.count_distinct(entity).alias("entity_count"))


def field_dictionary(
    df: DataFrame, table: str, bound: dict[str, str | None], roles: dict[str, tuple[str, str]] | None = None
) -> DataFrame:
    """Physical columns with their logical name, role and note."""
    logical = {p: name for name, p in bound.items() if p}
    rows = []
    for f in df.schema.fields:
        name = logical.get(f.name, "")
        role, note = (roles or {}).get(name, ("", ""))
        comment = f.metadata.get("comment", "")
        rows.append((table, f.name, name, f.dataType.simpleString(), comment, role, note))
    schema = (
        "table_name string, physical_column string, logical_field string, column_type string, "
        "column_comment string, field_role string, assessment_note string"
    )
    return constant_rows(df.sparkSession, rows, schema)
