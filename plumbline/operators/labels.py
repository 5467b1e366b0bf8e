"""Labels hidden in paths, rule coverage, and following a value through layers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from plumbline.functions.columns import contains_any, count_if, is_blank, non_blank, percent
from plumbline.functions.fixed import (
    ADD,
    CONTENT_LABELS,
    DIAGNOSIS_CONTENT_TERMS,
    DIAGNOSIS_PATTERNS,
    FAMILY_ACTIONS,
    MERGE,
    PLATFORM_PATTERNS,
    RECOVERABLE_PLATFORMS,
    RULE_ALIAS,
    RULE_TARGET,
    RULE_UNCOVERED,
)
from plumbline.functions.paths import (
    canonical_label,
    family_bucket,
    first_pattern,
    has_percent_encoding,
    has_separator,
    last_part,
    normalize_path,
    segments,
    slashes,
    strip,
    url_decode,
    without_separators,
)
from plumbline.operators.ordered import take_per_group

# --- labels in path segments -------------------------------------------------


def _field_hits(path: str, index: int, patterns, stop_list) -> Column:
    parts = segments(path)
    depth = F.size(parts)

    def hit(part: Column, i: Column) -> Column:
        return F.struct(
            (i == depth - 1).alias("is_last"),
            (depth - i).alias("depth_from_leaf"),
            (i + 1).alias("depth_from_root"),
            F.lit(index).alias("field_index"),
            F.lit(path).alias("path_field"),
            canonical_label(part, patterns, stop_list).alias("label"),
            part.alias("segment"),
        )

    return F.filter(F.transform(parts, hit), lambda h: h["label"].isNotNull())


def hits_column(
    fields: list[str], patterns=PLATFORM_PATTERNS, stop_list: list[str] = CONTENT_LABELS
) -> Column:
    """All labelled segments of all path fields of a row, as one array."""
    return F.concat(*[_field_hits(f, i, patterns, stop_list) for i, f in enumerate(fields)])


def segment_hits(
    df: DataFrame, keys: list[str], fields: list[str], patterns=PLATFORM_PATTERNS, stop_list=CONTENT_LABELS
) -> DataFrame:
    """One row per labelled path segment."""
    return df.select(*keys, F.inline(hits_column(fields, patterns, stop_list))).drop("field_index")


def best_hits(
    df: DataFrame, fields: list[str], patterns=PLATFORM_PATTERNS, stop_list=CONTENT_LABELS
) -> DataFrame:
    """Add ``hit``: the best labelled segment of the row, NULL without one.

    Segments before the file name win, then those nearest to the leaf, then
    nearest to the root, then the earlier field. The choice is the minimum of
    an array inside the row, so nothing is shuffled.
    """
    return df.withColumn("hit", F.array_min(hits_column(fields, patterns, stop_list)))


def label_consistency(
    best: DataFrame, explicit: str, patterns=PLATFORM_PATTERNS, stop_list=CONTENT_LABELS
) -> DataFrame:
    """Add how the explicit label of a row agrees with the label of its path."""
    raw = F.coalesce(strip(explicit), F.lit(""))
    known = canonical_label(explicit, patterns, stop_list)
    has_label, has_hit = raw != "", F.col("hit").isNotNull()
    label = F.col("hit.label")
    state = (
        F.when(has_label & has_hit & known.isNull(), "explicit_dirty_path_has_platform")
        .when(has_label & has_hit & (known == label), "explicit_match_path")
        .when(has_label & has_hit, "explicit_conflict_path")
        .when(has_label & known.isNull(), "explicit_dirty_no_path_hit")
        .when(has_label, "explicit_only")
        .when(has_hit, "path_only")
        .otherwise("neither")
    )
    return best.withColumns({"explicit_label": known, "consistency": state})


def consistency_counts(rows: DataFrame) -> DataFrame:
    return rows.groupBy("consistency").agg(F.count(F.lit(1)).alias("row_count"))


def hit_statistics(best: DataFrame) -> DataFrame:
    """Best hits by field, field and label, label and depths, from one aggregation.

    Grouping sets count all four breakdowns together; depths and labels are few.
    """
    hits = best.where(F.col("hit").isNotNull()).select(
        F.col("hit.path_field").alias("path_field"),
        F.col("hit.label").alias("label"),
        F.col("hit.depth_from_root").alias("root"),
        F.col("hit.depth_from_leaf").alias("leaf"),
    )
    merged = hits.groupBy("path_field", "label", "root", "leaf").agg(F.count(F.lit(1)).alias("n"))
    f, label, root, leaf = (F.col(c) for c in ("path_field", "label", "root", "leaf"))
    out = merged.groupingSets([[f], [f, label], [label, root], [label, leaf]], f, label, root, leaf).agg(
        F.sum("n").alias("row_count"), F.grouping_id().alias("_g")
    )
    name = (
        F.when(F.col("_g") == 0b0111, "field")
        .when(F.col("_g") == 0b0011, "field_label")
        .when(F.col("_g") == 0b1001, "label_root_depth")
        .otherwise("label_leaf_depth")
    )
    return out.select(
        name.alias("statistic"), "path_field", "label", F.coalesce("root", "leaf").alias("depth"), "row_count"
    )


def top_segments(best: DataFrame, n: int = 10) -> DataFrame:
    """Most frequent segments behind each label."""
    counts = best.where(F.col("hit").isNotNull()).groupBy(
        F.col("hit.label").alias("label"), F.col("hit.segment").alias("segment")
    ).agg(F.count(F.lit(1)).alias("row_count"))
    return take_per_group(counts, ["label"], [F.desc("row_count"), F.asc("segment")], n)


def explicit_values(
    df: DataFrame, explicit: str, n: int = 20, patterns=PLATFORM_PATTERNS, stop_list=CONTENT_LABELS
) -> DataFrame:
    """Most frequent explicit labels, and most frequent ones that no pattern knows."""
    counts = df.where(F.coalesce(strip(explicit), F.lit("")) != "").groupBy(strip(explicit).alias("value")).agg(
        F.count(F.lit(1)).alias("row_count")
    )
    known = counts.withColumn("suspicious", canonical_label("value", patterns, stop_list).isNull())
    order = [F.desc("row_count"), F.asc("value")]
    top = known.orderBy(*order).limit(n).withColumn("list", F.lit("top"))
    bad = known.where("suspicious").orderBy(*order).limit(n).withColumn("list", F.lit("suspicious"))
    return top.unionByName(bad).select("list", "value", "row_count")


def label_recommendation(statistics: DataFrame) -> DataFrame:
    """Most common path field; most common root and leaf depth of every label."""
    wanted = statistics.where("statistic <> 'field_label'")
    order = [F.desc("row_count"), F.asc_nulls_first("path_field"), F.asc_nulls_first("depth")]
    return take_per_group(wanted, ["statistic", "label"], order, 1)


# --- missing labels ----------------------------------------------------------


def priority_dedup(df: DataFrame, key: str, order: list[Column]) -> DataFrame:
    """One row per key, the first by the order; rows without a key are dropped."""
    return take_per_group(df.where(non_blank(key)), [key], order, 1)


def null_rate_by_source(rows: DataFrame, groups: list[str], label: str) -> DataFrame:
    """Rows, rows without label and their percent per group."""
    out = rows.groupBy(*groups).agg(
        F.count(F.lit(1)).alias("total_rows"), count_if(is_blank(label)).alias("null_rows")
    )
    return out.withColumn("null_rate_pct", percent(F.col("null_rows"), F.col("total_rows"), 4))


def null_reason(
    df: DataFrame,
    file_type: str,
    path: str,
    fallback_path: str | None = None,
    video_type: str = "视频",
    patterns=DIAGNOSIS_PATTERNS,
    content_terms: list[str] = DIAGNOSIS_CONTENT_TERMS,
) -> DataFrame:
    """Add the reason why a row has no label, and the segment that shows it."""
    raw = F.col(path).cast("string")
    if fallback_path:
        raw = F.when(raw != "", raw).otherwise(F.col(fallback_path).cast("string"))
    work = df.withColumn("_raw", raw).withColumns(
        {"_path": normalize_path("_raw"), "_parts": segments("_raw")}
    )
    known = F.filter("_parts", lambda s: first_pattern(s, patterns).isNotNull())
    work = work.withColumns({"_known": F.get(known, F.lit(0)), "_last": F.try_element_at("_parts", F.lit(-1))})
    is_content = F.exists("_parts", lambda s: s.rlike("|".join(content_terms)))
    no_path, has_known = F.col("_path") == "", F.col("_known").isNotNull()
    is_video = F.coalesce(F.col(file_type) == video_type, F.lit(False))
    reason = (
        F.when(no_path, "NO_PATH")
        .when(is_video & (F.size("_parts") == 0), "VIDEO_NO_PLATFORM_SEGMENT")
        .when(is_video & has_known, "VIDEO_PATH_HAS_PLATFORM_BUT_SQL_NOT_MINING")
        .when(is_video, "VIDEO_PATH_NO_PLATFORM_SEGMENT")
        .when(has_known, "IMAGE_PATH_HAS_PLATFORM_BUT_SQL_MISSED")
        .when(is_content, "IMAGE_ONLY_CONTENT_SEGMENTS")
        .otherwise("IMAGE_NO_PLATFORM_SEGMENT")
    )
    evidence = (
        F.when(no_path, F.lit(None))
        .when(has_known, F.col("_known"))
        .when(~is_video & is_content, F.lit(None))
        .otherwise(F.col("_last"))
    )
    out = work.withColumns({"reason": reason, "evidence_segment": evidence})
    return out.drop("_raw", "_path", "_parts", "_known", "_last")


def reason_counts(reasons: DataFrame, groups: list[str] | None = None) -> DataFrame:
    return reasons.groupBy(*(groups or []), "reason").agg(F.count(F.lit(1)).alias("row_count"))


def top_evidence(reasons: DataFrame, n: int = 20) -> DataFrame:
    """Most frequent evidence segments."""
    counts = reasons.where("evidence_segment is not null").groupBy("evidence_segment").agg(
        F.count(F.lit(1)).alias("row_count")
    )
    return counts.orderBy(F.desc("row_count"), F.asc("evidence_segment")).limit(n)


def unresolved(df: DataFrame, resolved: Column) -> DataFrame:
    """Rows in total and rows for which the rules find no label."""
    return df.agg(
        F.count(F.lit(1)).alias("total_rows"), count_if(resolved.isNull()).alias("unresolved_rows")
    )


def unresolved_samples(df: DataFrame, resolved: Column, order: list[Column], n: int = 20) -> DataFrame:
    return df.where(resolved.isNull()).orderBy(*order).limit(n)


def recoverable_nulls(
    df: DataFrame, label: str, paths: list[str], keywords: list[str] = RECOVERABLE_PLATFORMS
) -> DataFrame:
    """Rows without an explicit label, and those whose path names a known one.

    The path is the first of ``paths`` that is not NULL.
    """
    path = slashes(F.coalesce(*[F.col(p).cast("string") for p in paths], F.lit("")))
    found = path.rlike("(" + "|".join(keywords) + ")")
    return df.agg(
        F.count(F.lit(1)).alias("total_rows"),
        count_if(is_blank(label)).alias("label_null_rows"),
        count_if(is_blank(label) & found).alias("path_has_label_rows"),
    )


# --- rules for enum values ---------------------------------------------------


def rule_coverage(
    values: DataFrame, rules: DataFrame, final_values: DataFrame | None = None,
    value: str = "enum_value", peers: int = 12, order: str | None = None,
) -> DataFrame:
    """State of each value in a rule table (alias, target) with a suggested target.

    Of several targets of an alias the last one by the rules' column ``order``
    counts, where it is given (ties to the largest); else the largest.
    ``final_values`` (value, rank columns ``final_row_count``,
    ``final_entity_count``) adds the most frequent values of the same family.
    """
    targets = rules.select(F.col("target").alias(value)).distinct().withColumn("_is_target", F.lit(True))
    last = F.max("target") if order is None else F.max_by("target", F.struct(F.col(f"`{order}`"), F.col("target")))
    aliases = rules.where("alias <> target").groupBy(F.col("alias").alias(value)).agg(last.alias("_alias"))
    joined = values.join(targets, value, "left").join(aliases, value, "left")
    is_target, is_alias = F.col("_is_target").isNotNull(), F.col("_alias").isNotNull()
    out = joined.withColumns(
        {
            "rule_status": F.when(is_target, RULE_TARGET).when(is_alias, RULE_ALIAS).otherwise(RULE_UNCOVERED),
            "suggested_target": F.when(is_target, F.col(value)).when(is_alias, F.col("_alias")).otherwise(""),
            "family_bucket": family_bucket(value),
        }
    ).drop("_is_target", "_alias")
    if final_values is None:
        return out
    ranked = take_per_group(
        final_values.withColumn("family_bucket", family_bucket(value)),
        ["family_bucket"],
        [F.desc("final_row_count"), F.desc("final_entity_count"), F.asc(value)],
        peers,
        rank="_rn",
    )
    packed = ranked.groupBy("family_bucket").agg(
        F.array_sort(F.collect_list(F.struct("_rn", F.col(value).alias("v")))).alias("_p")
    )
    texts = packed.select("family_bucket", F.array_join("_p.v", "、").alias("same_family_values"))
    return out.join(F.broadcast(texts), "family_bucket", "left").na.fill("", ["same_family_values"])


def rule_coverage_summary(coverage: DataFrame) -> DataFrame:
    status = F.col("rule_status")
    return coverage.agg(
        F.count(F.lit(1)).alias("value_count"),
        count_if(status == RULE_TARGET).alias("target_defined_count"),
        count_if(status == RULE_ALIAS).alias("alias_defined_count"),
        count_if(status == RULE_UNCOVERED).alias("uncovered_count"),
    )


def family_summary(rows: DataFrame, row_count: str, entity_count: str, groups: list[str] | None = None) -> DataFrame:
    """Values, rows and entities per product family."""
    return rows.groupBy(*(groups or []), "family_bucket").agg(
        F.count(F.lit(1)).alias("enum_count"),
        F.sum(row_count).alias("rows"),
        F.sum(entity_count).alias("entities"),
    )


def action_plan(
    coverage: DataFrame, decisions: DataFrame, value: str = "enum_value", family_actions=FAMILY_ACTIONS
) -> DataFrame:
    """Merge or add for every value, with proposed value, confidence and reason.

    ``decisions`` (value, kind merge/add, proposed_enum, confidence, reason) are
    the explicit choices. A value that is already a rule target comes first,
    then explicit merges, explicit adds, then the default of its family.
    """

    def side(kind: str) -> DataFrame:
        picked = F.struct("proposed_enum", "confidence", "reason")
        return decisions.where(F.col("kind") == kind).groupBy(value).agg(F.min(picked).alias(f"_{kind}"))

    joined = coverage.join(side("merge"), value, "left").join(side("add"), value, "left")

    def choice(action, proposed, confidence: str | Column, reason: str | Column) -> Column:
        cells = {"action_bucket": action, "proposed_enum": proposed, "confidence": confidence, "reason": reason}
        return F.struct(*[(c if isinstance(c, Column) else F.lit(c)).alias(k) for k, c in cells.items()])

    target = F.when(F.col("suggested_target") != "", F.col("suggested_target")).otherwise(F.col(value))
    plan = F.when(F.col("rule_status") == RULE_TARGET, choice(MERGE, target, "high", "rule target"))
    for kind, action in (("merge", MERGE), ("add", ADD)):
        c = F.col(f"_{kind}")
        plan = plan.when(
            c.isNotNull(), choice(action, c["proposed_enum"], c["confidence"], c["reason"])
        )
    for family, action, proposed, confidence in family_actions:
        plan = plan.when(
            F.col("family_bucket") == family, choice(action, F.lit(proposed), confidence, "family default")
        )
    plan = plan.otherwise(choice(ADD, F.col(value), "low", "no rule and no family default"))
    return joined.withColumn("_plan", plan).select(*coverage.columns, "_plan.*")


def confidence_rank(c: Column | str) -> Column:
    c = F.col(c) if isinstance(c, str) else c
    return F.when(c == "high", 0).when(c == "medium", 1).when(c == "low", 2).otherwise(3)


def action_summary(plan: DataFrame) -> DataFrame:
    action, confidence = F.col("action_bucket"), F.col("confidence")
    return plan.agg(
        F.count(F.lit(1)).alias("total_count"),
        count_if(action == ADD).alias("add_candidate_count"),
        count_if(action == MERGE).alias("merge_candidate_count"),
        *[count_if(confidence == c).alias(f"{c}_confidence_count") for c in ("high", "medium", "low")],
    )


# --- following a value through layers ----------------------------------------


def anchor_lookup(
    sources: dict[str, tuple[DataFrame, list[str]]],
    anchor: str,
    anchor_id: str,
    anchor_name: str,
    downstream: dict[str, tuple[DataFrame, str, str, list[str]]],
    keyword: str,
) -> dict[str, DataFrame]:
    """Rows of every layer that belong to a keyword.

    Source layers (frame, search columns) are searched for the keyword. The ids
    found in the anchor layer are looked up in the downstream layers (frame, id
    column, name column, search columns); without ids the file names are used,
    without names the keyword itself. All anchors are used, none are cut off.
    Rows without an id or name take no part in the joins.
    """
    found = {name: df.where(contains_any(list(cols), keyword)) for name, (df, cols) in sources.items()}
    hits = found[anchor]
    ids = hits.where(non_blank(anchor_id)).select(F.col(anchor_id).cast("string").alias("_id")).distinct()
    names = hits.where(non_blank(anchor_name)).select(F.col(anchor_name).cast("string").alias("_name")).distinct()
    has_ids = ids.agg(F.count(F.lit(1)) > 0).scalar()
    has_names = names.agg(F.count(F.lit(1)) > 0).scalar()
    for name, (df, id_col, name_col, search) in downstream.items():
        by_id = df.join(ids, F.col(id_col).cast("string") == F.col("_id"), "left_semi")
        by_name = df.where(~has_ids).join(names, F.col(name_col).cast("string") == F.col("_name"), "left_semi")
        by_text = df.where(~has_ids & ~has_names).where(contains_any(list(search), keyword))
        found[name] = by_id.unionByName(by_name).unionByName(by_text)
    return found


def layer_hits(found: dict[str, DataFrame]) -> DataFrame:
    """Matched rows per layer."""
    out = None
    for name, df in found.items():
        row = df.agg(F.count(F.lit(1)).alias("matched_rows")).select(F.lit(name).alias("layer"), "matched_rows")
        out = row if out is None else out.unionByName(row)
    return out


def value_forms(df: DataFrame, layer: str, fields: list[str], reference: str) -> DataFrame:
    """Each value of a layer against a reference text: exact, decoded, compact, file name."""
    texts = df.select(*[F.col(f).cast("string").alias(f) for f in fields])
    long = texts.unpivot([], fields, "compare_field", "raw_value")
    v, decoded, wanted = F.col("raw_value"), F.col("decoded_value"), url_decode(F.lit(reference))
    long = long.where(F.coalesce(v, F.lit("")) != "").withColumn("decoded_value", url_decode(v))
    long = long.withColumn("compact_signature", without_separators(decoded))
    return long.select(
        F.lit(layer).alias("layer"),
        "compare_field",
        "raw_value",
        "decoded_value",
        "compact_signature",
        has_separator(v).alias("has_separator"),
        has_percent_encoding(v).alias("has_percent_encoding"),
        (v == reference).alias("exact_match"),
        (decoded == wanted).alias("decoded_match"),
        (F.col("compact_signature") == without_separators(wanted)).alias("compact_match"),
        (last_part(decoded) == last_part(wanted)).alias("same_file_name"),
    )


def form_summary(forms: DataFrame) -> DataFrame:
    """Matches per layer and field, and whether every layer holds the same value.

    When all layers hold the reference in compact form, the difference seen by
    users comes from display, not from data.
    """
    out = forms.groupBy("layer", "compare_field").agg(
        F.count(F.lit(1)).alias("values"),
        *[count_if(F.col(c)).alias(f"{c}_rows") for c in ("exact_match", "decoded_match", "compact_match", "same_file_name")],
        count_if(~F.col("has_separator") & ~F.col("has_percent_encoding")).alias("plain_rows"),
    )
    layer_ok = F.max(F.col("compact_match_rows") > 0).over(Window.partitionBy("layer"))
    return out.withColumn("_layer_ok", layer_ok).withColumn(
        "display_only", F.min("_layer_ok").over(Window.partitionBy(F.lit(1)))
    ).drop("_layer_ok")
