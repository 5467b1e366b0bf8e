"""Quality runs: one table in general, and a bridge table with its parents."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, functions as F

from plumbline.operators import compare, quality, rules
from plumbline.plans.shared import in_one_pass


def run(
    df: DataFrame, as_of: str, keys: list[str] | None = None, enums: list[str] | None = None, exact: bool = True
) -> dict[str, DataFrame]:
    """All row-level checks of one table as named frames.

    The checks that aggregate the table to one row (rows, missing values,
    numbers, texts, times) share one scan, which is made here; the others are
    computed when they are used.
    """
    categories = {f.name: quality.column_category(f.name, f.dataType) for f in df.schema.fields}
    keys = keys if keys is not None else [c for c, k in categories.items() if k == "identifier"]
    texts, numbers, times = quality.string_columns(df), quality.numeric_columns(df), quality.time_columns(df)
    enums = enums if enums is not None else [c for c in texts if categories[c] in ("flag", "dimension")]
    numbers = [c for c in numbers if categories[c] == "measure"]
    single = {"row_count": quality.row_count, "null_rates": quality.null_rates}
    if numbers:
        single["numeric_profile"] = lambda t: quality.numeric_profile(t, numbers)
    if texts:
        single["dirty_strings"] = lambda t: quality.dirty_strings(t, texts)
    if times:
        single["time_sanity"] = lambda t: quality.time_sanity(t, as_of, times)
    out = in_one_pass(df, single)
    out["structure"] = quality.structure_findings(df)
    out |= {f"duplicate_{k}": quality.duplicate_keys(df, k) for k in keys}
    if keys:
        out["key_duplication"] = quality.key_duplication(df, keys)
    if numbers:
        out["iqr_outliers"] = quality.iqr_outliers(df, numbers, exact=exact)
    time_texts = [c for c in texts if any(w in c.lower() for w in quality.TIME_WORDS)]
    if time_texts:
        out["time_text_range"] = quality.time_text_range(df, time_texts)
    if enums:
        out["enum_top"] = quality.enum_top(df, enums)
    return out


def bridge_findings(
    bridge: DataFrame,
    key: list[str],
    parents: dict[str, tuple[DataFrame, list[str]]],
    expected: list[str],
    scope: str = "bridge",
    medium: tuple[str, ...] = (),
) -> DataFrame:
    """Findings of a bridge table: key uniqueness, key coverage, back links, planned columns.

    ``parents`` maps a check name to the parent frame and the key columns they
    share. Checks named in ``medium`` fail with medium severity.
    """

    def severity(name: str) -> str:
        return "medium" if name in medium else "high"

    unique = rules.verdicts(
        quality.composite_key(bridge, key), F.lit("key uniqueness"), "duplicate_rows", "total_rows",
        severity("key uniqueness"), scope, F.col("key_definition"), F.lit("wrong_grain"),
    )
    parts = [unique]
    coverage = quality.key_coverage(bridge, key)
    level = F.when(F.col("key_name").isin(list(medium)), "medium").otherwise("high")
    parts.append(
        rules.verdicts(
            coverage, F.concat(F.lit("coverage of "), F.col("key_name")), "blank_rows", "total_rows", level, scope,
            bucket=F.lit("bridge_key_missing"),
        )
    )
    for name, (parent, on) in parents.items():
        checked = compare.backlink_check(bridge, parent, on, name).withColumn(
            "total_rows", bridge.agg(F.count(F.lit(1))).scalar()
        )
        parts.append(
            rules.verdicts(
                checked, "check", "unmatched_rows", "total_rows", severity(name), scope, bucket=F.lit("bridge_key_missing")
            )
        )
    contract = quality.contract_check(bridge, expected).select(
        F.concat(F.lit("column "), F.col("column_name")).alias("check"),
        F.lit(scope).alias("scope"),
        "severity",
        "status",
        F.lit(None).cast("long").alias("row_count"),
        F.lit(None).cast("double").alias("row_rate_pct"),
        F.when(F.col("status") == "fail", "bridge_key_missing").alias("bucket"),
        F.lit("").alias("detail"),
        F.array().cast("array<string>").alias("sample"),
    )
    parts.append(contract)
    return reduce(lambda a, b: a.unionByName(b), parts)
