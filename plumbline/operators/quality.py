"""Row-level quality measurements. Each operator reads the table once unless noted."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import (
    BooleanType,
    DateType,
    NumericType,
    StringType,
    TimestampNTZType,
    TimestampType,
)

from plumbline.functions.columns import (
    count_if,
    is_blank,
    is_missing,
    key_tuple,
    missing_count,
    non_blank,
    percent,
    text,
)
from plumbline.functions.fixed import VIDEO_SUFFIX_CHECK
from plumbline.functions.paths import has_suffix
from plumbline.operators.ordered import (
    distinct_profile,
    long_values,
    numbers_of,
    quantile_struct,
    take_per_group,
    wide_to_rows,
)
from plumbline.sources.tables import constant_rows

CONTROL_CHARS = r"[\x00-\x08\x0B\x0C\x0E-\x1F]"
WIDE_SPACE = r"\s{3,}"
NUMBER_TEXT = r"^-?[0-9]+\.?[0-9]*$"
TIME_WORDS = ("time", "date", "dt")


def columns_of(df: DataFrame, kind) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, kind)]


def numeric_columns(df: DataFrame) -> list[str]:
    return columns_of(df, NumericType)


def string_columns(df: DataFrame) -> list[str]:
    return columns_of(df, StringType)


def time_columns(df: DataFrame) -> list[str]:
    return columns_of(df, (TimestampType, TimestampNTZType, DateType))


def _is_text(df: DataFrame, name: str) -> bool:
    return isinstance(df.schema[name].dataType, StringType)


def row_count(df: DataFrame) -> DataFrame:
    return df.agg(F.count(F.lit(1)).alias("total_rows"))


def null_rates(df: DataFrame, columns: list[str] | None = None, decimals: int = 2) -> DataFrame:
    """Missing rows and percent of every column; blank text counts as missing."""
    columns = columns or df.columns
    one = df.agg(
        F.count(F.lit(1)).alias("total"),
        *[count_if(is_missing(F.col(f"`{c}`"), _is_text(df, c))).alias(f"m{i}") for i, c in enumerate(columns)],
    )
    rows = [
        [F.lit(c), F.col("total"), F.col(f"m{i}"), percent(F.col(f"m{i}"), F.col("total"), decimals)]
        for i, c in enumerate(columns)
    ]
    return wide_to_rows(one, rows, ["column_name", "total_rows", "null_rows", "null_pct"])


def high_null(rates: DataFrame, threshold: float = 30.0) -> DataFrame:
    """Columns of a ``null_rates`` result above the threshold."""
    return rates.where(F.col("null_pct") > threshold)


def duplicate_keys(df: DataFrame, key: str, limit: int = 20) -> DataFrame:
    """Most frequent repeated keys."""
    counts = df.where(F.col(key).isNotNull()).groupBy(key).agg(F.count(F.lit(1)).alias("dup_cnt"))
    return counts.where("dup_cnt > 1").orderBy(F.desc("dup_cnt"), F.asc(key)).limit(limit)


def key_duplication(df: DataFrame, keys: list[str]) -> DataFrame:
    """Distinct and total non-null values of each key and the share of repeats.

    ``expansion_rows`` is the other metric in use, rows minus distinct keys,
    which also counts rows without a key.
    """
    stats = distinct_profile(df, {k: F.col(k) for k in keys})
    known = F.col("total_rows") - F.col("null_rows")
    return stats.select(
        F.col("field").alias("key_name"),
        F.col("distinct_values").alias("distinct_keys"),
        known.alias("total_keys"),
        percent(known - F.col("distinct_values"), known).alias("dup_rate_pct"),
        (F.col("total_rows") - F.col("distinct_values")).alias("expansion_rows"),
    )


def composite_key(df: DataFrame, keys: list[str]) -> DataFrame:
    """Rows against distinct key tuples, NULL parts read as empty text."""
    per_key = df.groupBy(key_tuple(keys).alias("k")).agg(F.count(F.lit(1)).alias("n"))
    one = per_key.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("total_rows"), F.count(F.lit(1)).alias("distinct_keys")
    )
    extra = F.col("total_rows") - F.col("distinct_keys")
    return one.select(
        F.lit("(" + ", ".join(keys) + ")").alias("key_definition"),
        "total_rows",
        "distinct_keys",
        extra.alias("duplicate_rows"),
        percent(extra, F.col("total_rows"), 4).alias("duplicate_rate_pct"),
    )


def numeric_profile(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Minimum, maximum, mean and sample deviation of numeric columns; NaN is counted apart and in none of them."""
    columns = columns or numeric_columns(df)
    aggs = []
    for i, (c, v) in enumerate(numbers_of(columns).items()):
        aggs += [
            nan_count(c).alias(f"nan{i}"),
            F.min(v).alias(f"min{i}"),
            F.max(v).alias(f"max{i}"),
            F.round(F.avg(v), 2).alias(f"avg{i}"),
            F.round(F.stddev_samp(v), 2).alias(f"std{i}"),
        ]
    rows = [
        [F.lit(c), *[F.col(f"{k}{i}") for k in ("min", "max", "avg", "std", "nan")]] for i, c in enumerate(columns)
    ]
    return wide_to_rows(
        df.agg(*aggs), rows, ["column_name", "min_value", "max_value", "avg_value", "stddev_value", "nan_count"]
    )


def nan_count(column: str) -> Column:
    return count_if(F.isnan(F.col(f"`{column}`").cast("double")))


def iqr_outliers(
    df: DataFrame,
    columns: list[str] | None = None,
    factor: float = 1.5,
    exact: bool = True,
) -> DataFrame:
    """Quartiles, fences and the rows outside them, for all columns together.

    Reads the table for the quartiles and once more for the counts. Quartiles and
    fences are shown with six decimals, rows are counted against the full values.
    NaN is counted apart: it is no value and no outlier. Infinities are values.
    """
    columns = columns or numeric_columns(df)
    quartiles = quantile_struct(df, columns, [0.25, 0.75], exact)
    work = df.select(*[F.col(f"`{c}`").cast("double").alias(f"v{i}") for i, c in enumerate(columns)])
    spoilt = [nan_count(f"v{i}").alias(f"nan{i}") for i in range(len(columns))]
    work = work.withColumn("_q", quartiles)
    aggs = []
    for i in range(len(columns)):
        v, q = numbers_of([f"v{i}"])[f"v{i}"], F.col("_q")[f"c{i}"]
        reach = (q[1] - q[0]) * factor
        aggs += [
            F.count(v).alias(f"n{i}"),
            count_if((v < q[0] - reach) | (v > q[1] + reach)).alias(f"out{i}"),
        ]
    one = work.agg(F.first("_q").alias("_q"), *aggs, *spoilt)
    rows = []
    for i, c in enumerate(columns):
        q = F.col("_q")[f"c{i}"]
        reach = (q[1] - q[0]) * factor
        n, out = F.col(f"n{i}"), F.col(f"out{i}")
        shown = [F.round(v, 6) for v in (q[0], q[1], q[0] - reach, q[1] + reach)]
        rows.append([F.lit(c), *shown, n, out, percent(out, n, 4), F.col(f"nan{i}")])
    names = [
        "column_name", "q1", "q3", "lower_fence", "upper_fence", "value_count", "outlier_count", "outlier_pct", "nan_count",
    ]
    return wide_to_rows(one, rows, names)


def dirty_strings(df: DataFrame, columns: list[str] | None = None, max_length: int = 1000) -> DataFrame:
    """Control characters, wide blanks, overlong and untrimmed texts per column."""
    columns = columns or string_columns(df)
    aggs = []
    for i, name in enumerate(columns):
        c = F.col(f"`{name}`")
        filled = non_blank(c)
        aggs += [
            count_if(filled & c.rlike(CONTROL_CHARS)).alias(f"control{i}"),
            count_if(filled & c.rlike(WIDE_SPACE)).alias(f"wide{i}"),
            count_if(filled & (F.length(c) > max_length)).alias(f"long{i}"),
            count_if(filled & (c != F.trim(c))).alias(f"trim{i}"),
        ]
    rows = [
        [F.lit(name), *[F.col(f"{k}{i}") for k in ("control", "wide", "long", "trim")]]
        for i, name in enumerate(columns)
    ]
    names = ["column_name", "control_chars", "excess_whitespace", "overlong_values", "trim_issues"]
    return wide_to_rows(df.agg(*aggs), rows, names)


def time_sanity(
    df: DataFrame, as_of: str, columns: list[str] | None = None, floor: str = "2020-01-01"
) -> DataFrame:
    """Future and too old rows, earliest and latest value of time columns.

    ``as_of`` is a parameter so that a run can be repeated.
    """
    columns = columns or time_columns(df)
    aggs = []
    for i, name in enumerate(columns):
        c = F.col(f"`{name}`")
        dtype = df.schema[name].dataType
        aggs += [
            count_if(c > F.lit(as_of).cast(dtype)).alias(f"future{i}"),
            count_if(c < F.lit(floor).cast(dtype)).alias(f"ancient{i}"),
            F.min(c).cast("string").alias(f"min{i}"),
            F.max(c).cast("string").alias(f"max{i}"),
        ]
    rows = [
        [F.lit(c), *[F.col(f"{k}{i}") for k in ("future", "ancient", "min", "max")]]
        for i, c in enumerate(columns)
    ]
    return wide_to_rows(df.agg(*aggs), rows, ["column_name", "future_dates", "ancient_dates", "earliest", "latest"])


def time_text_range(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Earliest, latest and distinct values of text columns that look like times."""
    columns = columns or [c for c in string_columns(df) if any(w in c.lower() for w in TIME_WORDS)]
    if not columns:
        raise ValueError("no text column looks like a time")
    values = long_values(df, {c: F.col(f"`{c}`").cast("string") for c in columns})
    distinct = values.where(non_blank("value")).groupBy("field", "value").agg(F.count(F.lit(1)).alias("n"))
    return distinct.groupBy(F.col("field").alias("column_name")).agg(
        F.min("value").alias("earliest"),
        F.max("value").alias("latest"),
        F.count(F.lit(1)).alias("distinct_values"),
    )


def enum_top(df: DataFrame, columns: list[str], n: int = 20) -> DataFrame:
    """Most frequent values of several columns at once."""
    values = long_values(df, {c: F.col(f"`{c}`").cast("string") for c in columns})
    counts = (
        values.where(F.col("value").isNotNull())
        .groupBy(F.col("field").alias("column_name"), "value")
        .agg(F.count(F.lit(1)).alias("cnt"))
    )
    return take_per_group(counts, ["column_name"], [F.desc("cnt"), F.asc("value")], n)


def fill_metrics(
    df: DataFrame, fields: list[str], where: Column | str | None = None, decimals: int = 4
) -> DataFrame:
    """Filled and missing rows per field; a field the table lacks is reported as such."""
    base = df.where(where) if where is not None else df
    present = [f for f in fields if f in df.columns]
    one = base.agg(
        F.count(F.lit(1)).alias("total"),
        *[count_if(non_blank(F.col(f"`{f}`"))).alias(f"f{i}") for i, f in enumerate(present)],
    )
    unknown = F.lit(None).cast("long")
    rows = []
    for f in fields:
        if f in present:
            fill = F.col(f"f{present.index(f)}")
            miss = F.col("total") - fill
            rows.append([F.lit(f), F.lit(True), fill, miss, percent(miss, F.col("total"), decimals), F.lit("")])
        else:
            rows.append([F.lit(f), F.lit(False), unknown, unknown, F.lit(None).cast("double"), F.lit("schema missing")])
    names = ["field_name", "exists", "fill_rows", "miss_rows", "miss_rate_pct", "note"]
    return wide_to_rows(one, rows, names)


def fill_distribution(
    df: DataFrame, fields: list[str], where: Column | str | None = None, n: int = 8
) -> DataFrame:
    """Most frequent non-blank values of each field."""
    base = df.where(where) if where is not None else df
    values = long_values(base, {f: F.col(f"`{f}`").cast("string") for f in fields})
    counts = (
        values.where(non_blank("value"))
        .groupBy(F.col("field").alias("field_name"), F.col("value").alias("label_value"))
        .agg(F.count(F.lit(1)).alias("cnt"))
    )
    return take_per_group(counts, ["field_name"], [F.desc("cnt"), F.asc("label_value")], n)


def freshness(df: DataFrame, columns: list[str]) -> DataFrame:
    """Smallest and largest non-blank value of each time column, as text."""
    aggs = []
    for i, c in enumerate(columns):
        v = F.when(non_blank(F.col(f"`{c}`")), F.col(f"`{c}`"))
        aggs += [F.min(v).cast("string").alias(f"min{i}"), F.max(v).cast("string").alias(f"max{i}")]
    rows = [[F.lit(c), F.col(f"min{i}"), F.col(f"max{i}")] for i, c in enumerate(columns)]
    return wide_to_rows(df.agg(*aggs), rows, ["column_name", "min_value", "max_value"])


def missing_fields_sample(df: DataFrame, fields: list[str], order: list[str], n: int = 24) -> DataFrame:
    """Rows with blank fields, those with most blanks first."""
    counted = df.withColumn("missing_count", missing_count(fields)).where("missing_count > 0")
    return counted.orderBy(F.desc("missing_count"), *order).limit(n)


def parse_validity(df: DataFrame, column: str, pattern: str = NUMBER_TEXT, n: int = 20) -> DataFrame:
    """Values of a text column that do not match the pattern, by frequency."""
    c = F.col(column)
    bad = df.where(c.isNotNull() & ~c.rlike(pattern))
    counts = bad.groupBy(c.alias("value")).agg(F.count(F.lit(1)).alias("cnt"))
    return counts.orderBy(F.desc("cnt"), F.asc("value")).limit(n)


def type_conflict(
    df: DataFrame, type_column: str, type_value: str, path: str, suffixes: list[str] = VIDEO_SUFFIX_CHECK
) -> DataFrame:
    """Rows of one type whose path carries a suffix of another."""
    return df.where((F.col(type_column) == type_value) & has_suffix(path, suffixes))


def keyword_values(df: DataFrame, column: str, keyword: str, n: int | None = None) -> DataFrame:
    """Values of a column that contain a keyword, by frequency."""
    value = F.col(column).cast("string")
    hits = df.where(non_blank(column) & F.contains(value, F.lit(keyword)))
    counts = hits.groupBy(value.alias(column)).agg(F.count(F.lit(1)).alias("row_cnt"))
    return counts.orderBy(F.desc("row_cnt"), F.asc(column)).limit(n) if n else counts


def temporal_order(df: DataFrame, pairs: dict[str, tuple[Column | str, Column | str]]) -> DataFrame:
    """Rows whose end time lies before the start time, per named pair."""
    aggs, rows = [], []
    for i, (name, (start, end)) in enumerate(pairs.items()):
        start = F.col(start) if isinstance(start, str) else start
        end = F.col(end) if isinstance(end, str) else end
        aggs += [
            count_if(start.isNotNull() & end.isNotNull()).alias(f"n{i}"),
            count_if(end < start).alias(f"bad{i}"),
        ]
        n, bad = F.col(f"n{i}"), F.col(f"bad{i}")
        rows.append([F.lit(name), n, bad, percent(bad, n, 4)])
    return wide_to_rows(df.agg(*aggs), rows, ["check", "compared_rows", "bad_rows", "bad_rate_pct"])


def range_validity(df: DataFrame, ranges: dict[str, tuple[float | None, float | None]]) -> DataFrame:
    """Values below or above the allowed range of each column."""
    aggs, rows = [], []
    for i, (name, (low, high)) in enumerate(ranges.items()):
        v = F.col(f"`{name}`")
        aggs += [
            F.count(v).alias(f"n{i}"),
            count_if(v < low if low is not None else F.lit(False)).alias(f"low{i}"),
            count_if(v > high if high is not None else F.lit(False)).alias(f"high{i}"),
        ]
        n, lo, hi = F.col(f"n{i}"), F.col(f"low{i}"), F.col(f"high{i}")
        rows.append([F.lit(name), n, lo, hi, percent(lo + hi, n, 4)])
    names = ["column_name", "value_count", "below_range", "above_range", "invalid_pct"]
    return wide_to_rows(df.agg(*aggs), rows, names)


def key_coverage(df: DataFrame, keys: list[str]) -> DataFrame:
    """Blank rows and rate of every bridge key."""
    one = df.agg(
        F.count(F.lit(1)).alias("total"),
        *[count_if(is_blank(F.col(f"`{k}`"))).alias(f"b{i}") for i, k in enumerate(keys)],
    )
    rows = [
        [F.lit(k), F.col("total"), F.col(f"b{i}"), percent(F.col(f"b{i}"), F.col("total"), 4)]
        for i, k in enumerate(keys)
    ]
    return wide_to_rows(one, rows, ["key_name", "total_rows", "blank_rows", "blank_rate_pct"])


def contract_check(df: DataFrame, expected: list[str]) -> DataFrame:
    """Whether each planned column exists; an absent one is critical."""
    rows = [
        (c, c in df.columns, "low" if c in df.columns else "critical", "pass" if c in df.columns else "fail")
        for c in expected
    ]
    schema = "column_name string, exists boolean, severity string, status string"
    return constant_rows(df.sparkSession, rows, schema)


def column_category(name: str, dtype, identifiers: tuple[str, ...] = (), times: tuple[str, ...] = ()) -> str:
    """Category guess of a column: identifier, flag, temporal, measure, descriptive, dimension.

    The last word of the name decides, words being parted by underscores.
    Names that run words together, such as ``o_orderkey``, are only taken for
    keys or times if their last word is passed in.
    """
    low = name.lower()
    last = low.rsplit("_", 1)[-1]
    if isinstance(dtype, BooleanType) or low.startswith(("is_", "has_")):
        return "flag"
    if last in ("id", "key", "no", *identifiers):
        return "identifier"
    if isinstance(dtype, (DateType, TimestampType, TimestampNTZType)) or last in ("time", "date", "dt", *times):
        return "temporal"
    if isinstance(dtype, NumericType):
        return "measure"
    if any(w in low for w in ("name", "title", "text", "path", "remark", "desc", "comment", "url")):
        return "descriptive"
    return "dimension"


def structure_findings(df: DataFrame, sample_numbers: bool = True) -> DataFrame:
    """Schema weaknesses per column, with numbers and times stored as text.

    Text columns are tested against the number pattern over the whole table.
    """
    texts = string_columns(df)
    one = df.agg(
        F.count(F.lit(1)).alias("total"),
        *[count_if(non_blank(F.col(f"`{c}`"))).alias(f"f{i}") for i, c in enumerate(texts)],
        *[
            count_if(non_blank(F.col(f"`{c}`")) & text(F.col(f"`{c}`")).rlike(NUMBER_TEXT)).alias(f"n{i}")
            for i, c in enumerate(texts)
        ],
    )
    rows = []
    for f in df.schema.fields:
        category = column_category(f.name, f.dataType)
        is_text = isinstance(f.dataType, StringType)
        i = texts.index(f.name) if is_text else -1
        numeric_text = (
            (F.col(f"f{i}") > 0) & (F.col(f"n{i}") == F.col(f"f{i}")) if is_text and sample_numbers else F.lit(False)
        )
        rows.append(
            [
                F.lit(f.name),
                F.lit(f.dataType.simpleString()),
                F.lit(category),
                F.lit(f.nullable),
                numeric_text,
                F.lit(is_text and category == "temporal"),
                F.lit(not f.metadata.get("comment")),
            ]
        )
    names = [
        "column_name", "data_type", "category", "nullable", "number_as_text", "time_as_text", "comment_missing",
    ]
    return wide_to_rows(one, rows, names)


def quality_score(
    df: DataFrame,
    required: list[str],
    time_column: str,
    measure: str | None,
    as_of: str,
    fresh_days: int = 7,
    max_measure: float | None = None,
    threshold: float = 70.0,
    weights: tuple[float, float, float, float] = (0.4, 0.2, 0.2, 0.2),
) -> DataFrame:
    """0-100 score of completeness, required fields, valid measures and freshness.

    The weighting is this library's own: 0.4 complete cells, 0.2 rows with all
    required fields, 0.2 measures inside [0, max], 0.2 freshness (1 within
    ``fresh_days`` of ``as_of``, then falling linearly to 0 at ten times that).
    """
    columns = df.columns
    filled = sum([(~is_missing(F.col(f"`{c}`"), _is_text(df, c))).cast("int") for c in columns], F.lit(0))
    complete = F.lit(True)
    for c in required:
        complete = complete & ~is_missing(F.col(f"`{c}`"), _is_text(df, c))
    if measure is None:
        good_measure = F.lit(True)
    else:
        m = F.col(measure)
        good_measure = m.isNotNull() & (m >= 0)
        if max_measure is not None:
            good_measure = good_measure & (m <= max_measure)
    one = df.agg(
        F.count(F.lit(1)).alias("record_count"),
        F.sum(filled).alias("filled"),
        count_if(complete).alias("complete_rows"),
        count_if(good_measure).alias("valid_measures"),
        F.max(F.to_date(time_column)).alias("latest_day"),
    )
    n = F.col("record_count")
    age = F.datediff(F.lit(as_of).cast("date"), F.col("latest_day"))
    fresh = F.greatest(F.lit(0.0), F.least(F.lit(1.0), 1.0 - (age - fresh_days) / F.lit(9.0 * fresh_days)))
    parts = {
        "completeness": F.try_divide(F.col("filled").cast("double"), (n * len(columns)).cast("double")),
        "required_fill": F.try_divide(F.col("complete_rows").cast("double"), n.cast("double")),
        "valid_rate": F.try_divide(F.col("valid_measures").cast("double"), n.cast("double")),
        "freshness": fresh.cast("double"),
    }
    scored = one.select(
        "record_count", *[F.round(F.coalesce(v, F.lit(0.0)), 6).alias(k) for k, v in parts.items()]
    )
    score = sum([F.col(k) * w for k, w in zip(parts, weights)], F.lit(0.0)) * 100.0
    return scored.withColumn("score", F.round(score, 2)).withColumn(
        "status", F.when(F.col("score") >= threshold, "pass").otherwise("stop")
    )


def confidence_cap(records: Column) -> Column:
    """Upper limit of confidence by sample size; NULL below the smallest usable size."""
    return (
        F.when(records < 100, F.lit(None).cast("double"))
        .when(records < 1000, F.lit(0.70))
        .when(records <= 10000, F.lit(0.85))
        .otherwise(F.lit(0.95))
    )
