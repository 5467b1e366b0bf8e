"""Declarative checks, verdicts, samples and root causes."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, functions as F

from plumbline.functions.columns import count_if, is_blank, non_blank, percent
from plumbline.functions.fixed import IMAGE_EXTENSIONS, VIDEO_EXTENSIONS
from plumbline.functions.paths import (
    basename_conflict,
    ends_with_suffix,
    extension,
    standard_file_name,
    standard_path,
    suffix_family,
    uses_concat,
)
from plumbline.operators.ordered import take_per_group, wide_to_rows

FINDING_SCHEMA = (
    "check string, scope string, severity string, status string, row_count long, "
    "row_rate_pct double, bucket string, detail string, sample array<string>"
)
FINDING_COLUMNS = [part.strip().split(" ")[0] for part in FINDING_SCHEMA.split(", ")]


@dataclass
class Rule:
    """A check: rows for which the predicate is true break it."""

    code: str
    severity: str
    predicate: Column
    order: list[Column] = field(default_factory=list)
    hint: str = ""


def severity_rank(severity: Column) -> Column:
    names = ["critical", "high", "medium", "low"]
    out = None
    for i, name in enumerate(names):
        out = F.when(severity == name, i) if out is None else out.when(severity == name, i)
    return out.otherwise(9)


def rule_checks(df: DataFrame, rules: list[Rule]) -> DataFrame:
    """Broken rows and rate of every rule from one pass, with their rank.

    Rank is by severity, then by count, then by code.
    """
    one = df.agg(
        F.count(F.lit(1)).alias("total"),
        *[count_if(r.predicate).alias(f"r{i}") for i, r in enumerate(rules)],
    )
    entries = [
        F.struct(
            severity_rank(F.lit(r.severity)).alias("_severity"),
            (-F.col(f"r{i}")).alias("_count"),
            F.lit(r.code).alias("code"),
            F.lit(r.severity).alias("severity"),
            F.col("total").alias("total_rows"),
            F.col(f"r{i}").alias("row_count"),
            percent(F.col(f"r{i}"), F.col("total")).alias("row_rate_pct"),
        )
        for i, r in enumerate(rules)
    ]
    ranked = one.select(F.posexplode(F.array_sort(F.array(*entries))).alias("_pos", "_rule"))
    columns = ["code", "severity", "total_rows", "row_count", "row_rate_pct"]
    return ranked.select(*[f"_rule.{c}" for c in columns], (F.col("_pos") + 1).alias("rank"))


def rule_samples(df: DataFrame, rules: list[Rule], columns: list[str], n: int) -> DataFrame:
    """First n broken rows of every rule, in the order of the rule, from one scan.

    Each row is repeated only for the rules it breaks. Per rule, every task
    keeps its own first n rows before anything is shuffled.
    """
    out = None
    hits = F.array(*[F.when(r.predicate, F.lit(r.code)) for r in rules])
    groups: dict[str, list[Rule]] = {}
    for r in rules:
        groups.setdefault(str(r.order), []).append(r)
    marked = df.withColumn("_codes", F.array_compact(hits)).where(F.size("_codes") > 0)
    for same_order in groups.values():
        codes = [r.code for r in same_order]
        order = same_order[0].order
        rows = marked.withColumn("code", F.explode("_codes")).where(F.col("code").isin(codes))
        part = take_per_group(rows, ["code"], order, n, rank="sample_no").select("code", "sample_no", *columns)
        out = part if out is None else out.unionByName(part)
    return out


def failing_rows(df: DataFrame, predicate: Column, order: list[Column], n: int = 20) -> DataFrame:
    """First n rows that break one rule."""
    return df.where(predicate).orderBy(*order).limit(n)


def verdicts(
    metrics: DataFrame,
    check: Column | str,
    bad_rows: Column | str,
    total_rows: Column | str,
    fail_severity: Column | str = "high",
    scope: str = "",
    detail: Column | None = None,
    bucket: Column | None = None,
) -> DataFrame:
    """Findings rows: fail with the given severity when rows are bad, else pass and low."""
    bad = F.col(bad_rows) if isinstance(bad_rows, str) else bad_rows
    total = F.col(total_rows) if isinstance(total_rows, str) else total_rows
    severity = F.lit(fail_severity) if isinstance(fail_severity, str) else fail_severity
    failed = bad > 0
    return metrics.select(
        (F.col(check) if isinstance(check, str) else check).cast("string").alias("check"),
        F.lit(scope).alias("scope"),
        F.when(failed, severity).otherwise("low").alias("severity"),
        F.when(failed, "fail").otherwise("pass").alias("status"),
        bad.cast("long").alias("row_count"),
        percent(bad, total, 4).alias("row_rate_pct"),
        (bucket if bucket is not None else F.lit(None)).cast("string").alias("bucket"),
        (detail if detail is not None else F.lit("")).alias("detail"),
        F.array().cast("array<string>").alias("sample"),
    )


def failed_summary(findings: DataFrame) -> DataFrame:
    """Failed findings, worst first by rank."""
    return findings.where("status = 'fail'").withColumn("severity_rank", severity_rank(F.col("severity")))


def with_samples(findings: DataFrame, samples: DataFrame, check: str = "code") -> DataFrame:
    """Attach sample rows (already cut per check) to the findings as JSON texts."""
    body = F.to_json(F.struct(*[c for c in samples.columns if c != check]))
    packed = samples.groupBy(F.col(check).alias("check")).agg(F.sort_array(F.collect_list(body)).alias("_sample"))
    joined = findings.join(packed, "check", "left")
    return joined.withColumn("sample", F.coalesce("_sample", "sample")).drop("_sample")


def root_cause(
    in_source: Column, mapped_wrong: Column, bridge_missing: Column, grain_wrong: Column,
    rule_missing: Column, display_only: Column,
) -> Column:
    """One of the six root-cause buckets, tested in this order; NULL without evidence."""
    return (
        F.when(in_source, "source_pollution")
        .when(mapped_wrong, "mapping_mistake")
        .when(bridge_missing, "bridge_key_missing")
        .when(grain_wrong, "wrong_grain")
        .when(rule_missing, "rule_coverage_gap")
        .when(display_only, "display_formatting")
    )


# --- file path health --------------------------------------------------------


def file_projection(df: DataFrame) -> DataFrame:
    """Standard path, name, extension and flags of rows with folder, name and full path."""
    path = standard_path("folder_path", "file_name", "full_path")
    first = df.withColumns(
        {
            "full_path_std": path,
            "image_update_time": F.coalesce("data_update_time", "image_modify_time"),
            "use_concat_path": uses_concat("folder_path", "file_name"),
            "fallback_to_full_path": ~uses_concat("folder_path", "file_name"),
            "basename_conflict": F.coalesce(basename_conflict("full_path", "file_name"), F.lit(False)),
        }
    )
    second = first.withColumns(
        {
            "file_name_std": standard_file_name("file_name", "full_path_std"),
            "path_ext_std": extension("full_path_std"),
            "folder_suffix": ends_with_suffix("full_path_std"),
        }
    )
    return second.withColumns(
        {
            "file_name_ext_std": extension("file_name_std"),
            "path_suffix_family": suffix_family("path_ext_std"),
        }
    )


HEALTH_METRICS = [
    "full_path_std_filled",
    "use_concat_path",
    "fallback_to_full_path",
    "basename_conflict",
    "update_time_filled",
    "folder_suffix",
    "video_suffix",
    "distinct_file_id",
    "distinct_source_id",
]


def health_metrics(
    projected: DataFrame, file_id: str = "file_id", source_id: str = "platform_source_id"
) -> DataFrame:
    """Counts and rates of the path flags, with distinct file and source ids."""
    one = projected.agg(
        F.count(F.lit(1)).alias("total"),
        count_if(non_blank("full_path_std")).alias("full_path_std_filled"),
        count_if(F.col("use_concat_path")).alias("use_concat_path"),
        count_if(F.col("fallback_to_full_path")).alias("fallback_to_full_path"),
        count_if(F.col("basename_conflict")).alias("basename_conflict"),
        count_if(non_blank("image_update_time")).alias("update_time_filled"),
        count_if(F.col("folder_suffix")).alias("folder_suffix"),
        count_if(F.col("path_ext_std").isin(VIDEO_EXTENSIONS)).alias("video_suffix"),
        F.count_distinct(file_id).alias("distinct_file_id"),
        F.count_distinct(source_id).alias("distinct_source_id"),
    )
    rows = [[F.lit(m), F.col(m), percent(F.col(m), F.col("total")), F.col("total")] for m in HEALTH_METRICS]
    return wide_to_rows(one, rows, ["metric", "row_count", "row_rate_pct", "total_rows"])


def extension_distribution(projected: DataFrame, n: int = 30) -> DataFrame:
    """Most frequent (extension, family) pairs."""
    counts = projected.groupBy(
        F.coalesce("path_ext_std", F.lit("")).alias("path_ext_std"), "path_suffix_family"
    ).agg(F.count(F.lit(1)).alias("row_count"))
    return counts.orderBy(F.desc("row_count"), "path_ext_std", "path_suffix_family").limit(n)


def file_rules(
    image: list[str] = IMAGE_EXTENSIONS, video: list[str] = VIDEO_EXTENSIONS
) -> list[Rule]:
    """The checks of a projected image set."""
    ext = F.col("path_ext_std")
    newest = [F.desc("image_update_time"), F.desc("file_id"), F.desc("platform_source_id")]
    by_id = newest[1:]
    return [
        Rule("VIDEO_SUFFIX_IN_IMAGE_SET", "high", ext.isin(video), newest, "source_pollution"),
        Rule("TARGET_FOLDER_FIELD_SUFFIX_RISK", "high", F.col("folder_suffix"), newest, "mapping_mistake"),
        Rule(
            "UNKNOWN_SUFFIX_IN_IMAGE_SET", "medium", (ext != "") & ~ext.isin(image + video), newest, "source_pollution",
        ),
        Rule("FALLBACK_TO_FULL_PATH", "medium", F.col("fallback_to_full_path"), newest, "source_pollution"),
        Rule("BASENAME_CONFLICT", "medium", F.col("basename_conflict"), newest, "source_pollution"),
        Rule("MISSING_IMAGE_UPDATE_TIME", "medium", is_blank("image_update_time"), by_id, "source_pollution"),
        Rule("MISSING_STANDARD_PATH", "high", is_blank("full_path_std"), by_id, "source_pollution"),
    ]


def health_findings(
    metrics: DataFrame,
    limits: dict[str, tuple[str, float]] | None = None,
    scope: str = "",
) -> DataFrame:
    """Health metrics beyond their limits as findings rows.

    ``limits`` maps a metric to ("max" | "min", percent): above a maximum or
    below a minimum the metric becomes a finding. The counts are compared, not
    the rounded rate. A table without rows is the finding ``empty_set``.
    """
    limits = limits or {
        "fallback_to_full_path": ("max_reached", 20.0),
        "update_time_filled": ("min", 95.0),
        "full_path_std_filled": ("min", 99.0),
        "folder_suffix": ("max", 0.0),
        "video_suffix": ("max", 0.0),
    }
    metric, n, total = F.col("metric"), F.col("row_count") * F.lit(100.0), F.col("total_rows")
    empty = (metric == HEALTH_METRICS[0]) & (total == 0)
    hit = empty
    detail = F.lit("")
    for name, (kind, limit) in limits.items():
        bound = total * F.lit(float(limit))
        broken = {"max": n > bound, "max_reached": n >= bound, "min": n < bound}[kind]
        hit = hit | ((metric == name) & (total > 0) & broken)
        sign = {"max": ">", "max_reached": ">=", "min": "<"}[kind]
        detail = F.when(metric == name, F.lit(f"{name} rate {sign} {limit}")).otherwise(detail)
    return metrics.where(hit).select(
        F.when(empty, "empty_set").otherwise(metric).alias("check"),
        F.lit(scope).alias("scope"),
        F.lit("medium").alias("severity"),
        F.lit("fail").alias("status"),
        "row_count",
        "row_rate_pct",
        F.lit(None).cast("string").alias("bucket"),
        F.when(empty, "no rows").otherwise(detail).alias("detail"),
        F.array().cast("array<string>").alias("sample"),
    )
