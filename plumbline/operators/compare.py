"""Comparing tables, layers and value sets; root causes of gaps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import MapType

from plumbline.functions.columns import (
    blank_to_null,
    count_if,
    non_blank,
    percent,
    spare_name,
)
from plumbline.functions.fixed import EMPTY_LABEL, NONE_LABEL
from plumbline.operators.ordered import take_per_group


def _flag(condition: Column) -> Column:
    return condition.cast("int")


# --- links between a child and a parent table --------------------------------


def _known_keys(df: DataFrame, keys: list[str]) -> DataFrame:
    for k in keys:
        df = df.where(non_blank(k))
    return df


def backlink_check(child: DataFrame, parent: DataFrame, keys: list[str], name: str = "backlink") -> DataFrame:
    """Child rows whose key has no parent.

    Child rows are merged per key before the anti join, so a key that holds a
    large part of the rows reaches the join as one row.
    """
    per_key = _known_keys(child, keys).groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    orphans = per_key.join(parent.select(*keys), keys, "left_anti")
    total = child.agg(F.count(F.lit(1))).scalar()
    unmatched = F.coalesce(F.sum("n"), F.lit(0))
    return orphans.agg(unmatched.alias("unmatched_rows"), F.count(F.lit(1)).alias("unmatched_keys")).select(
        F.lit(name).alias("check"),
        "unmatched_rows",
        "unmatched_keys",
        percent(F.col("unmatched_rows"), total, 4).alias("unmatched_rate_pct"),
    )


def backlink_samples(
    child: DataFrame, parent: DataFrame, keys: list[str], order: list[Column], n: int = 20
) -> DataFrame:
    """First child rows without a parent.

    No key gives more than n of them, so every task passes on n rows of a key at most.
    """
    first = take_per_group(_known_keys(child, keys), keys, order, n)
    return first.join(parent.select(*keys), keys, "left_anti").orderBy(*order).limit(n)


def duplicate_expansion(
    df: DataFrame, key: str, order: list[Column], keys: int = 12, rows: int = 24
) -> DataFrame:
    """Rows behind the most repeated keys."""
    counts = df.where(non_blank(key)).groupBy(key).agg(F.count(F.lit(1)).alias("dup_cnt"))
    top = counts.where("dup_cnt > 1").orderBy(F.desc("dup_cnt"), F.asc(key)).limit(keys)
    return df.join(F.broadcast(top), key).orderBy(F.desc("dup_cnt"), F.asc(key), *order).limit(rows)


def proxy_freshness(child: DataFrame, parent: DataFrame, key: str, time: str) -> DataFrame:
    """Time range of the parents that the child rows point to."""
    known = parent.where(non_blank(time)).select(key, time)
    linked = known.join(child.select(key), key, "left_semi")
    return linked.agg(
        F.min(time).cast("string").alias("min_value"), F.max(time).cast("string").alias("max_value")
    )


def entity_overlap(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Distinct entities of the left table and how many of them the right table has."""
    entities = left.where(non_blank(key)).select(key).distinct()
    known = right.where(F.col(key).isNotNull()).select(key).distinct().withColumn("_hit", F.lit(1))
    return entities.join(known, key, "left").agg(
        F.count(F.lit(1)).alias("left_entities"), F.count("_hit").alias("matched_entities")
    )


# --- two versions of one table ----------------------------------------------


def _entity_side(df: DataFrame, key: str, attributes: list[str], amount: str, side: str) -> DataFrame:
    aggs = [F.count(F.lit(1)).alias(f"{side}_row_cnt")]
    for a in attributes:
        aggs += [F.min(a).alias(f"{side}_{a}"), F.max(a).alias(f"{side}_max_{a}")]
    aggs.append(F.round(F.sum(F.coalesce(F.col(amount), F.lit(0.0))), 2).alias(f"{side}_{amount}"))
    return df.where(F.col(key).isNotNull()).groupBy(key).agg(*aggs)


def table_consistency(
    left: DataFrame, right: DataFrame, key: str, attributes: list[str], amount: str, tolerance: float = 0.01
) -> DataFrame:
    """Entities of both tables, their overlap, and matches per attribute.

    An attribute matches only if each side holds one single value of it.
    """
    a = _entity_side(left, key, attributes, amount, "left")
    b = _entity_side(right, key, attributes, amount, "right")
    both = a.join(b, key, "full_outer")
    in_left, in_right = F.col("left_row_cnt").isNotNull(), F.col("right_row_cnt").isNotNull()
    overlap = in_left & in_right
    aggs = [
        count_if(in_left).alias("left_entities"),
        count_if(in_right).alias("right_entities"),
        count_if(overlap).alias("overlap_entities"),
    ]
    for c in attributes:
        one_left = F.col(f"left_{c}") == F.col(f"left_max_{c}")
        one_right = F.col(f"right_{c}") == F.col(f"right_max_{c}")
        same = F.col(f"left_{c}") == F.col(f"right_{c}")
        aggs.append(count_if(overlap & one_left & one_right & same).alias(f"exact_{c}_match"))
    gap = F.abs(F.coalesce(f"left_{amount}", F.lit(0.0)) - F.coalesce(f"right_{amount}", F.lit(0.0)))
    aggs.append(count_if(overlap & (gap < tolerance)).alias(f"exact_{amount}_match"))
    return both.agg(*aggs)


def mismatch_samples(
    left: DataFrame, right: DataFrame, key: str, attributes: list[str], amount: str,
    n: int = 30, tolerance: float = 0.01,
) -> DataFrame:
    """Overlapping entities that differ, largest amount difference first."""
    a = _entity_side(left, key, attributes, amount, "left")
    b = _entity_side(right, key, attributes, amount, "right")
    both = a.join(b, key)
    gap = F.abs(F.coalesce(f"left_{amount}", F.lit(0.0)) - F.coalesce(f"right_{amount}", F.lit(0.0)))
    differs = gap >= tolerance
    for c in attributes:
        sides = [F.coalesce(F.col(f"{s}_{c}").cast("string"), F.lit("")) for s in ("left", "right")]
        differs = differs | (sides[0] != sides[1])
    columns = [key, "left_row_cnt", "right_row_cnt"]
    for c in [*attributes, amount]:
        columns += [f"left_{c}", f"right_{c}"]
    return both.where(differs).orderBy(F.desc(gap), F.asc(key)).limit(n).select(*columns)


# --- entities and values across three layers ---------------------------------


def _layer_side(df: DataFrame, key: str, attributes: dict[str, str], side: str) -> DataFrame:
    """Per entity the largest non-blank value of each attribute, and its rows."""
    return df.where(non_blank(key)).groupBy(blank_to_null(key).alias("entity")).agg(
        *[F.max(blank_to_null(c)).alias(f"{side}_{a}") for a, c in attributes.items()],
        F.count(F.lit(1)).alias(f"{side}_rows"),
    )


def layer_join(
    reference: tuple[DataFrame, str, dict[str, str]],
    source: tuple[DataFrame, str, dict[str, str]],
    result: tuple[DataFrame, str, dict[str, str]],
) -> DataFrame:
    """Reference entities with what the source and result layers hold of them.

    Each layer is (frame, entity column, {attribute: column}).
    """
    r = _layer_side(*reference, "ref")
    s = _layer_side(*source, "src")
    d = _layer_side(*result, "res")
    return r.join(s, "entity", "left").join(d, "entity", "left")


def layer_gap(joined: DataFrame, attributes: list[str]) -> DataFrame:
    """Totals of a ``layer_join``: hits per layer and attributes lost in each."""
    has = {(s, a): F.col(f"{s}_{a}").isNotNull() for s in ("ref", "src", "res") for a in attributes}
    all_ref, gap_src, gap_res = F.lit(True), F.lit(False), F.lit(False)
    for a in attributes:
        all_ref = all_ref & has["ref", a]
        gap_src = gap_src | ~has["src", a]
        gap_res = gap_res | ~has["res", a]
    aggs = [F.count(F.lit(1)).alias("ref_entities")]
    aggs += [count_if(has["ref", a]).alias(f"ref_with_{a}") for a in attributes]
    aggs += [
        count_if(F.col("src_rows").isNotNull()).alias("hit_source"),
        count_if(F.col("res_rows").isNotNull()).alias("hit_result"),
    ]
    aggs += [count_if(has["ref", a] & ~has["src", a]).alias(f"missing_{a}_in_source") for a in attributes]
    aggs += [count_if(has["ref", a] & ~has["res", a]).alias(f"missing_{a}_in_result") for a in attributes]
    aggs += [
        count_if(all_ref & gap_src).alias("any_gap_in_source"),
        count_if(all_ref & gap_res).alias("any_gap_in_result"),
    ]
    return joined.agg(*aggs)


def layer_gap_detail(joined: DataFrame, attributes: list[str]) -> DataFrame:
    """Reference entities that lose an attribute in the source or the result layer."""
    flags = {}
    for layer, name in (("src", "source"), ("res", "result")):
        for a in attributes:
            lost = F.col(f"ref_{a}").isNotNull() & F.col(f"{layer}_{a}").isNull()
            flags[f"missing_{a}_in_{name}"] = _flag(lost)
    any_lost = sum(flags.values(), F.lit(0)) > 0
    texts = [
        F.coalesce(F.col(f"{s}_{a}"), F.lit("")).alias(f"{s}_{a}") for s in ("src", "res") for a in attributes
    ]
    return joined.where(any_lost).select(
        "entity",
        *[f"ref_{a}" for a in attributes],
        *texts,
        F.coalesce("src_rows", F.lit(0)).alias("src_rows"),
        F.coalesce("res_rows", F.lit(0)).alias("res_rows"),
        *[c.alias(k) for k, c in flags.items()],
    )


def distinct_values(df: DataFrame, columns: list[str], names: list[str]) -> DataFrame:
    """Distinct normalised tuples with every part filled."""
    base = df
    for c in columns:
        base = base.where(non_blank(c))
    return base.select(*[blank_to_null(c).alias(n) for c, n in zip(columns, names)]).distinct()


def value_gap(
    reference: tuple[DataFrame, str], source: tuple[DataFrame, str], result: tuple[DataFrame, str], name: str = "value"
) -> DataFrame:
    """Values of the reference that the source or the result layer lacks."""
    r, s, d = (distinct_values(df, [c], [name]) for df, c in (reference, source, result))
    return _missing_flags(r, s, d, [name])


def _missing_flags(r: DataFrame, s: DataFrame, d: DataFrame, keys: list[str]) -> DataFrame:
    joined = r.join(s.withColumn("_s", F.lit(1)), keys, "left").join(d.withColumn("_d", F.lit(1)), keys, "left")
    flags = {
        "missing_in_source": _flag(F.col("_s").isNull()),
        "missing_in_result": _flag(F.col("_d").isNull()),
    }
    return joined.where(F.col("_s").isNull() | F.col("_d").isNull()).withColumns(flags).drop("_s", "_d")


def pair_gap(
    reference: tuple[DataFrame, list[str], str],
    source: tuple[DataFrame, list[str]],
    result: tuple[DataFrame, list[str]],
    names: list[str],
) -> DataFrame:
    """Value pairs of the reference, with rows and entities, that another layer lacks."""
    df, columns, entity = reference
    base = df.where(non_blank(entity))
    for c in columns:
        base = base.where(non_blank(c))
    r = base.groupBy(*[blank_to_null(c).alias(n) for c, n in zip(columns, names)]).agg(
        F.count(F.lit(1)).alias("ref_rows"), F.count_distinct(blank_to_null(entity)).alias("ref_entities")
    )
    s, d = (distinct_values(f, c, names) for f, c in (source, result))
    return _missing_flags(r, s, d, names)


# --- enum sets ---------------------------------------------------------------


def enum_sides(df: DataFrame, target: str, reference: str, entity: str) -> DataFrame:
    """Rows and entities per value on the target and the reference column, one scan."""
    sides = {
        "t": F.when(non_blank(target), F.struct(F.lit("t").alias("side"), blank_to_null(target).alias("v"))),
        "r": F.when(non_blank(reference), F.struct(F.lit("r").alias("side"), blank_to_null(reference).alias("v"))),
    }
    entity_text = F.col(entity).cast("string").alias("_entity")
    long = df.select(entity_text, *[c.alias(k) for k, c in sides.items()]).unpivot("_entity", ["t", "r"], "_k", "_c")
    per_entity = (
        long.where(F.col("_c").isNotNull())
        .groupBy(F.col("_c.v").alias("enum_value"), F.col("_c.side").alias("side"), "_entity")
        .agg(F.count(F.lit(1)).alias("n"))
    )

    def side(name: str) -> list[Column]:
        is_side = F.col("side") == name
        return [
            F.coalesce(F.sum(F.when(is_side, F.col("n"))), F.lit(0)).alias(f"{name}_rows"),
            F.count(F.when(is_side, F.col("_entity"))).alias(f"{name}_entities"),
        ]

    return per_entity.groupBy("enum_value").agg(*side("t"), *side("r"))


def enum_gap_summary(sides: DataFrame) -> DataFrame:
    """Enum sizes of both columns, values missing in and extra to the target."""
    t, r = F.col("t_rows") > 0, F.col("r_rows") > 0
    return sides.agg(
        count_if(t).alias("target_enum_count"),
        count_if(r).alias("ref_enum_count"),
        count_if(r & ~t).alias("missing_in_target_count"),
        count_if(t & ~r).alias("extra_in_target_count"),
    )


def enum_gap_values(sides: DataFrame) -> DataFrame:
    """Values on one side only, with the rows and entities of that side."""
    t, r = F.col("t_rows") > 0, F.col("r_rows") > 0
    return sides.where(t != r).select(
        F.when(r, "missing_in_target").otherwise("extra_in_target").alias("gap"),
        "enum_value",
        F.when(r, F.col("r_rows")).otherwise(F.col("t_rows")).alias("row_count"),
        F.when(r, F.col("r_entities")).otherwise(F.col("t_entities")).alias("entity_count"),
    )


def enum_gap_samples(
    df: DataFrame, gap: str, values: DataFrame, target: str, reference: str, columns: list[str],
    order: list[Column], n: int = 20,
) -> DataFrame:
    """Rows that carry a gap value, first n by the order."""
    side = reference if gap == "missing_in_target" else target
    wanted = values.where(F.col("gap") == gap).select(F.col("enum_value").alias("_value"))
    rows = df.select(
        *columns, blank_to_null(reference).alias("reference_value"), blank_to_null(target).alias("target_value")
    )
    side_value = "reference_value" if side == reference else "target_value"
    return rows.join(wanted, F.col(side_value) == F.col("_value"), "left_semi").orderBy(*order).limit(n)


def _enum_counts(df: DataFrame, value: str, entity: str, side: str) -> DataFrame:
    return df.where(non_blank(value)).groupBy(blank_to_null(value).alias("enum_value")).agg(
        F.count(F.lit(1)).alias(f"{side}_row_count"),
        F.count_distinct(F.col(entity).cast("string")).alias(f"{side}_entity_count"),
    )


def enum_coverage(
    first: DataFrame, source: DataFrame, final: DataFrame, value: str, entity: str,
    sample_columns: list[str], sample_order: list[Column], samples: int = 2,
) -> DataFrame:
    """Values of the first layer absent from the final one, with samples as columns."""
    a = _enum_counts(first, value, entity, "first")
    b = _enum_counts(source, value, entity, "source")
    c = _enum_counts(final, value, entity, "final")
    missing = a.join(c, "enum_value", "left_anti").join(b, "enum_value", "left")
    rows = first.where(non_blank(value)).select(
        blank_to_null(value).alias("enum_value"), *[blank_to_null(s).alias(s) for s in sample_columns]
    )
    picked = take_per_group(rows, ["enum_value"], sample_order, samples, rank="_rn")
    wide = picked.groupBy("enum_value").agg(
        *[
            F.max(F.when(F.col("_rn") == i, F.col(s))).alias(f"sample_{s}_{i}")
            for i in range(1, samples + 1)
            for s in sample_columns
        ]
    )
    zero = ["source_row_count", "source_entity_count"]
    return missing.join(wide, "enum_value", "left").na.fill(0, zero)


def source_only_values(source: DataFrame, final: DataFrame, value: str) -> DataFrame:
    """Distinct values of the source layer and how many the final layer lacks."""
    s, f = distinct_values(source, [value], ["v"]), distinct_values(final, [value], ["v"])
    return s.join(f.withColumn("_f", F.lit(1)), "v", "left").agg(
        F.count(F.lit(1)).alias("source_enum_count"), count_if(F.col("_f").isNull()).alias("source_only_enum_count")
    )


# --- default values ----------------------------------------------------------


def _dimension_side(dimension: DataFrame, entity: str, used: str, alternative: str) -> DataFrame:
    return dimension.where(non_blank(entity)).groupBy(blank_to_null(entity, upper=True).alias("entity")).agg(
        F.max(F.trim(F.col(alternative).cast("string"))).alias("_alt"),
        F.max(F.trim(F.col(used).cast("string"))).alias("_used"),
        F.lit(True).alias("_found"),
    )


def _default_rows(target: DataFrame, entity: str, value: str, default: str, row_id: str | None) -> DataFrame:
    rows = target.where(non_blank(entity) & (blank_to_null(value) == default))
    return rows.where(non_blank(row_id)) if row_id else rows


def _cause(mapped: list[str], default: str) -> Column:
    has_used, has_alt = non_blank("_used"), non_blank("_alt")
    return (
        F.when(F.col("_found").isNull(), "NO_DIMENSION_MATCH")
        .when(~has_used & has_alt, "ALTERNATIVE_PRESENT_BUT_USED_EMPTY")
        .when(~has_used & ~has_alt, "BOTH_EMPTY")
        .when(F.col("_used") == default, "USED_IS_DEFAULT")
        .when(~F.col("_used").isin(mapped), "UNMAPPED_VALUE")
        .otherwise("OTHER")
    )


def default_value_causes(
    target: DataFrame,
    dimension: DataFrame,
    entity: str,
    value: str,
    used: str,
    alternative: str,
    mapped: list[str],
    default: str = NONE_LABEL,
    row_id: str | None = None,
) -> DataFrame:
    """Rows with the default value, each with the cause found in the dimension.

    ``used`` is the dimension column the value is taken from, ``alternative``
    another column that could hold it. Entities are compared in upper case.
    """
    rows = _default_rows(target, entity, value, default, row_id)
    keep = [F.col(row_id)] if row_id else []
    rows = rows.select(*keep, blank_to_null(entity, upper=True).alias("entity"))
    joined = rows.join(_dimension_side(dimension, entity, used, alternative), "entity", "left")
    return joined.select(
        *keep,
        "entity",
        F.coalesce(F.nullif("_alt", F.lit("")), F.lit(EMPTY_LABEL)).alias("alternative_value"),
        F.coalesce(F.nullif("_used", F.lit("")), F.lit(EMPTY_LABEL)).alias("used_value"),
        _cause(mapped, default).alias("root_cause"),
    )


def default_value_summary(
    target: DataFrame,
    dimension: DataFrame,
    entity: str,
    value: str,
    used: str,
    alternative: str,
    mapped: list[str],
    default: str = NONE_LABEL,
    row_id: str | None = None,
) -> DataFrame:
    """Rows, entities and share of every cause of a default value.

    Rows are merged per entity before the join, so an entity with very many
    rows costs the join one row.
    """
    rows = _default_rows(target, entity, value, default, row_id)
    per_entity = rows.groupBy(blank_to_null(entity, upper=True).alias("entity")).agg(
        F.count(F.lit(1)).alias("n")
    )
    joined = per_entity.join(_dimension_side(dimension, entity, used, alternative), "entity", "left")
    out = joined.groupBy(_cause(mapped, default).alias("root_cause")).agg(
        F.sum("n").alias("row_cnt"), F.count(F.lit(1)).alias("entity_cnt")
    )
    total = out.agg(F.sum("row_cnt")).scalar()
    return out.withColumn("row_share_pct", percent(F.col("row_cnt"), total, 4))


def value_distribution(df: DataFrame, value: str, entity: str) -> DataFrame:
    """Rows and upper-cased entities per value, blank shown as an explicit mark."""
    label = F.coalesce(blank_to_null(value), F.lit(EMPTY_LABEL)).alias("value")
    return df.groupBy(label).agg(
        F.count(F.lit(1)).alias("row_cnt"), F.count_distinct(blank_to_null(entity, upper=True)).alias("entity_cnt")
    )


def stratified_samples(df: DataFrame, stratum: str, order: list[Column], n: int = 5) -> DataFrame:
    """Up to n rows per stratum."""
    return take_per_group(df, [stratum], order, n, rank="sample_no")


# --- coverage and classification ---------------------------------------------


def source_coverage(sources: list[tuple[str, DataFrame, str, str]]) -> DataFrame:
    """Rows, distinct ids and date range of several (name, frame, id, date) sources."""
    out = None
    for name, df, key, date in sources:
        row = df.where(non_blank(date)).agg(
            F.count(F.lit(1)).alias("row_count"),
            F.count_distinct(F.col(key).cast("string")).alias("distinct_ids"),
            F.min(date).cast("string").alias("min_date"),
            F.max(date).cast("string").alias("max_date"),
        )
        row = row.select(F.lit(name).alias("source"), "*")
        out = row if out is None else out.unionByName(row)
    return out


def gap_class(in_source: Column, in_result: Column, in_reference: Column, in_rules: Column) -> Column:
    """Why a value is not usable everywhere, tested in this order."""
    return (
        F.when(~in_source, "missing_in_source")
        .when(~in_result, "lost_in_result")
        .when(~in_reference, "absent_from_reference")
        .when(~in_rules, "uncovered_by_rules")
        .otherwise("complete")
    )


def gap_classification(
    values: DataFrame, layers: dict[str, DataFrame], value: str = "value"
) -> DataFrame:
    """Class of every value by its presence in source, result, reference and rules.

    ``layers`` holds a frame with a ``value`` column under each of those names.
    """
    out = values.select(value).distinct()
    for name in ("source", "result", "reference", "rules"):
        known = layers[name].select(F.col(value)).distinct().withColumn(f"in_{name}", F.lit(True))
        out = out.join(known, value, "left").na.fill(False, [f"in_{name}"])
    flags = [F.col(f"in_{n}") for n in ("source", "result", "reference", "rules")]
    return out.withColumn("gap_class", gap_class(*flags))


#: buckets whose checksums are compared; rows are compared only in those that differ
BUCKETS = 1 << 16


def comparable(df: DataFrame, column: str) -> Column:
    """The column in a form that can be hashed, grouped and compared: maps as sorted entries, deeper ones as JSON text."""
    c, kind = F.col(f"`{column}`"), df.schema[column].dataType
    if "map<" not in kind.simpleString():
        return c
    if isinstance(kind, MapType) and "map<" not in kind.valueType.simpleString():
        return F.array_sort(F.map_entries(c))
    return F.to_json(F.struct(c), {"ignoreNullFields": "false"})


def bucket_sums(df: DataFrame, key: list[Column], row: list[Column], buckets: int, side: str) -> DataFrame:
    """(bucket, sums): rows of each bucket of the key, and checksums of them that do not depend on their order."""
    h = F.xxhash64(*row)
    return df.select(bucket_of(key, buckets).alias("bucket"), h.alias("h")).groupBy("bucket").agg(
        F.struct(
            F.count(F.lit(1)).alias("rows"),
            F.bit_xor("h").alias("mixed"),
            F.sum(F.col("h").bitwiseAND(F.lit(0xFFFFFFFF))).alias("low"),
            F.sum(F.shiftrightunsigned("h", 32)).alias("high"),
        ).alias(side)
    )


def bucket_of(key: list[Column], buckets: int) -> Column:
    return F.pmod(F.xxhash64(F.lit(1), *key), F.lit(buckets)).cast("int")


def differing_buckets(sides: list[tuple[DataFrame, list[Column], list[Column]]], buckets: int = BUCKETS) -> DataFrame:
    """(bucket) of the buckets in which two frames (frame, key, row) do not hold the same rows; never more than ``buckets``."""
    (a, a_key, a_row), (b, b_key, b_row) = sides
    both = bucket_sums(a, a_key, a_row, buckets, "l").join(bucket_sums(b, b_key, b_row, buckets, "r"), "bucket", "full")
    return both.where(~F.col("l").eqNullSafe(F.col("r"))).select("bucket")


def in_buckets(df: DataFrame, key: list[Column], listed: DataFrame, buckets: int, inside: bool = True) -> DataFrame:
    name = spare_name(df.columns, "_bucket")
    few = F.broadcast(listed.select(F.col("bucket").alias(name)))
    return df.join(few, bucket_of(key, buckets) == F.col(name), "left_semi" if inside else "left_anti")


def frame_diff(
    left: DataFrame, right: DataFrame, keys: list[str], floats: list[str] | None = None, tolerance: float = 1e-6,
    unique_keys: bool = False, buckets: int = BUCKETS,
) -> DataFrame:
    """Keyed comparison of two frames: one row per difference.

    One pass over each frame sums checksums per bucket of the key; only rows of
    buckets that differ are shuffled and compared, so equal frames cost two
    scans. Exact for all columns but ``floats``, which may differ by a relative
    error below the tolerance; equal infinities and NaN are equal. NULL keys are
    keys like others. A key that occurs more than once on a side is reported as
    ``repeated_key`` (``exact_diff`` compares such rows); to find those in equal
    buckets, their keys, without other columns, are counted as well, unless
    ``unique_keys`` promises that there are none. A column of one side only is a
    row without keys. Maps are compared by their entries.
    """
    floats = floats or []
    values = [c for c in left.columns if c not in keys and c in right.columns]

    def key_of(df: DataFrame) -> list[Column]:
        return [comparable(df, k) for k in keys]

    # both sides hash the same types, or equal values would look different
    def row_of(df: DataFrame) -> list[Column]:
        return [comparable(df, c) if str(left.schema[c].dataType) == str(right.schema[c].dataType) else F.col(f"`{c}`").cast("string") for c in [*keys, *values]]

    changed = differing_buckets([(df, key_of(df), row_of(df)) for df in (left, right)], buckets)

    def side(df: DataFrame, name: str) -> DataFrame:
        some = in_buckets(df, key_of(df), changed, buckets)
        row = F.struct(F.lit(1).alias("_one"), *[comparable(df, c).alias(f"v{i}") for i, c in enumerate(values)])
        return some.groupBy(*[k.alias(f"_{name}{i}") for i, k in enumerate(key_of(df))]).agg(
            F.any_value(row).alias(f"_{name}"),
            F.any_value(F.struct(*[F.col(f"`{k}`") for k in keys])).alias(f"_{name}_keys"),
            F.count(F.lit(1)).alias(f"_{name}_rows"),
        )

    same = F.lit(True)
    for i in range(len(keys)):
        same = same & F.col(f"_l{i}").eqNullSafe(F.col(f"_r{i}"))
    joined = side(left, "l").join(side(right, "r"), same, "full_outer")
    bad = []
    for i, c in enumerate(values):
        x, y = F.col("_l")[f"v{i}"], F.col("_r")[f"v{i}"]
        equal = x.eqNullSafe(y)
        if c in floats:
            scale = F.greatest(F.abs(x), F.abs(y))
            equal = equal | F.coalesce((scale < float("inf")) & (F.abs(x - y) <= scale * tolerance), F.lit(False))
        bad.append(F.when(~equal, F.lit(c)))
    wrong = F.array_compact(F.array(*bad)) if bad else F.array().cast("array<string>")
    diff = (
        F.when(F.col("_l").isNull(), "only_right")
        .when(F.col("_r").isNull(), "only_left")
        .when((F.col("_l_rows") > 1) | (F.col("_r_rows") > 1), "repeated_key")
        .when(F.size(wrong) > 0, "values_differ")
    )
    out = joined.withColumn("difference", diff).where(F.col("difference").isNotNull())
    out = out.select(
        *[F.when(F.col("_l").isNull(), F.col("_r_keys")[k]).otherwise(F.col("_l_keys")[k]).alias(k) for k in keys],
        "difference",
        F.when(F.col("difference") == "values_differ", F.array_join(wrong, ",")).alias("columns"),
    )
    if not unique_keys:
        # equal buckets hold the same keys on both sides, so one side is enough
        rest = in_buckets(left, key_of(left), changed, buckets, inside=False)
        counted = rest.groupBy(*[k.alias(f"_k{i}") for i, k in enumerate(key_of(left))])
        whole = any("map<" in left.schema[k].dataType.simpleString() for k in keys)
        own = [F.any_value(F.col(f"`{k}`")).alias(k) for k in keys] if whole else []
        again = counted.agg(F.count(F.lit(1)).alias("_rows"), *own).where(F.col("_rows") > 1)
        shown = [F.col(f"`{k}`") if whole else F.col(f"_k{i}").alias(k) for i, k in enumerate(keys)]
        out = out.unionByName(again.select(*shown, F.lit("repeated_key").alias("difference"), F.lit(None).cast("string").alias("columns")))
    single = [(c, "column_only_left") for c in left.columns if c not in right.columns]
    single += [(c, "column_only_right") for c in right.columns if c not in left.columns]
    for c, kind in single:
        row = left.sparkSession.range(1).select(
            *[F.lit(None).cast(left.schema[k].dataType).alias(k) for k in keys], F.lit(kind).alias("difference"), F.lit(c).alias("columns")
        )
        out = out.unionByName(row)
    return out


def exact_diff(left: DataFrame, right: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """Rows (with multiplicity) found on one side only.

    Checksums per bucket of the rows come first; rows of equal buckets are not
    shuffled. Frames with different columns have no row in common: all rows are
    reported, with NULL in the columns that their side lacks.
    """
    apart = set(left.columns) != set(right.columns)
    columns = [*left.columns, *[c for c in right.columns if c not in left.columns]]
    pair = [left, right]
    if not apart and all(str(left.schema[c].dataType) == str(right.schema[c].dataType) for c in columns):
        rows = [[comparable(df, c) for c in columns] for df in pair]
        changed = differing_buckets([(df, row, row) for df, row in zip(pair, rows)], buckets)
        pair = [in_buckets(df, row, changed, buckets) for df, row in zip(pair, rows)]
    maps = [c for c in columns if any(c in df.columns and "map<" in df.schema[c].dataType.simpleString() for df in pair)]

    def side(df: DataFrame, other: DataFrame, mine: str, theirs: str) -> DataFrame:
        whole = [F.col(f"`{c}`") if c in df.columns else F.lit(None).cast(other.schema[c].dataType).alias(c) for c in columns]
        mark = F.lit(mine if apart else "").alias("_side")
        return df.select(*whole, mark, F.lit(1).cast("long").alias(mine), F.lit(0).cast("long").alias(theirs))

    both = side(*pair, "left_rows", "right_rows").unionByName(side(*pair[::-1], "right_rows", "left_rows"))
    group = [comparable(both, c).alias(f"_g{i}") if c in maps else F.col(f"`{c}`") for i, c in enumerate(columns)]
    merged = both.groupBy(*group, "_side").agg(
        F.sum("left_rows").alias("left_rows"), F.sum("right_rows").alias("right_rows"), *[F.any_value(F.col(f"`{c}`")).alias(c) for c in maps]
    )
    return merged.where("left_rows <> right_rows").select(*[F.col(f"`{c}`") for c in columns], "left_rows", "right_rows")
