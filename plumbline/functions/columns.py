"""Scalar expressions for normalising, cleansing and bucketing values."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from plumbline.functions.fixed import EMPTY_LABEL, NONE_LABEL


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def spare_name(taken: list[str], name: str) -> str:
    """The name, with underscores in front until it is none of those taken."""
    used = {c.lower() for c in taken}
    while name.lower() in used:
        name = f"_{name}"
    return name


def text(c: Column | str) -> Column:
    """The value as text without surrounding blanks."""
    return F.trim(col(c).cast("string"))


def blank_to_null(c: Column | str, upper: bool = False) -> Column:
    """Trimmed text, or NULL when nothing is left."""
    out = F.nullif(text(c), F.lit(""))
    return F.upper(out) if upper else out


def blank_to_label(c: Column | str, label: str = NONE_LABEL, upper: bool = False) -> Column:
    return F.coalesce(blank_to_null(c, upper), F.lit(label))


def blank_to_empty_mark(c: Column | str) -> Column:
    return blank_to_label(c, EMPTY_LABEL)


def non_blank(c: Column | str) -> Column:
    """True for a value with visible text; false (never NULL) otherwise."""
    return F.coalesce(text(c) != "", F.lit(False))


def is_blank(c: Column | str) -> Column:
    return ~non_blank(c)


def is_missing(c: Column | str, is_text: bool) -> Column:
    """NULL, or blank when the column holds text."""
    return is_blank(c) if is_text else col(c).isNull()


def to_number(c: Column | str) -> Column:
    """Digits, dots and minus signs of the text as a double; NULL if unusable."""
    kept = F.nullif(F.regexp_replace(text(c), r"[^0-9.\-]", ""), F.lit(""))
    return kept.try_cast("double")


def time_prefix(c: Column | str, length: int) -> Column:
    """First characters of a time text: 10 for the day, 13 for the hour."""
    return F.substring(blank_to_null(c), 1, length)


def count_if(predicate: Column) -> Column:
    """Number of rows for which the predicate is true, 0 on an empty input."""
    return F.count(F.when(predicate, F.lit(1)))


def ratio(part: Column, whole: Column, decimals: int = 6) -> Column:
    """part / whole as a rounded double, NULL when the whole is zero."""
    return F.round(F.try_divide(part.cast("double"), whole.cast("double")), decimals)


def percent(part: Column, whole: Column, decimals: int = 2) -> Column:
    """part of whole in percent, 0 when the whole is zero."""
    share = F.try_divide(part.cast("double") * 100.0, whole.cast("double"))
    return F.round(F.coalesce(share, F.lit(0.0)), decimals)


#: (upper bound inclusive or None, label) in natural order
TARGET_BUCKETS = [(1, "1"), (5, "2-5"), (10, "6-10"), (20, "11-20"), (None, "21+")]
DAY_BUCKETS = [(1, "1天"), (3, "2-3天"), (7, "4-7天"), (15, "8-15天"), (None, "16天以上")]


def bucket(metric: Column | str, bounds: list[tuple[int | None, str]]) -> Column:
    """Label of the first bucket whose upper bound holds the value."""
    metric = col(metric)
    *inner, last = bounds
    out = None
    for upper, label in inner:
        out = F.when(metric <= upper, label) if out is None else out.when(metric <= upper, label)
    return out.otherwise(last[1])


def bucket_position(label: Column | str, bounds: list[tuple[int | None, str]]) -> Column:
    names = F.array(*[F.lit(name) for _, name in bounds])
    return F.array_position(names, col(label)).cast("int")


def first_match(rules: list[tuple[Column, object]], default: Column | None = None) -> Column:
    """Value of the first rule whose predicate is true (rules keep their order)."""
    out = None
    for predicate, value in rules:
        value = value if isinstance(value, Column) else F.lit(value)
        out = F.when(predicate, value) if out is None else out.when(predicate, value)
    if out is None:
        return default if default is not None else F.lit(None)
    return out if default is None else out.otherwise(default)


def keyword_flag(c: Column | str, keyword: str, yes: str, no: str) -> Column:
    """``yes`` when the text contains the keyword, else ``no``."""
    return F.when(F.contains(col(c).cast("string"), F.lit(keyword)), yes).otherwise(no)


def published_flag(c: Column | str) -> Column:
    return F.when(non_blank(c), "已发").otherwise("未发")


def orientation(width: Column | str, height: Column | str) -> Column:
    width, height = col(width), col(height)
    return (
        F.when(width > height, "横屏")
        .when(width < height, "竖屏")
        .when(width == height, "方图")
        .otherwise("未知")
    )


def contains_any(columns: list[Column | str], keyword: str) -> Column:
    """True if any of the columns contains the keyword as plain text."""
    out = F.lit(False)
    for c in columns:
        out = out | F.coalesce(F.contains(col(c).cast("string"), F.lit(keyword)), F.lit(False))
    return out


def missing_count(columns: list[Column | str]) -> Column:
    """How many of the columns are blank in this row."""
    out = F.lit(0)
    for c in columns:
        out = out + is_blank(c).cast("int")
    return out


def mask_id(c: Column | str, salt: str = "") -> Column:
    """Stable pseudonym of an identifier."""
    return F.sha2(F.concat(F.lit(salt), col(c).cast("string")), 256)


def key_tuple(columns: list[str]) -> Column:
    """Composite key with NULL read as the empty text; tuples cannot collide."""
    return F.struct(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in columns])
