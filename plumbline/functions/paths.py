"""Expressions over file paths, URLs and the labels hidden in them."""

from __future__ import annotations

import re

from pyspark.sql import Column, functions as F

from plumbline.functions.columns import col, first_match, non_blank
from plumbline.functions.fixed import (
    CONTENT_LABELS,
    FAMILY_DEFAULT,
    FAMILY_PATTERNS,
    IMAGE_EXTENSIONS,
    PLATFORM_PATTERNS,
    VIDEO_EXTENSIONS,
)

#: white space of every script (the Unicode property), such as the ideographic blank
BLANKS = "\t\n\x0b\x0c\r \x85\xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000"
EXTENSION = r"\.([A-Za-z0-9]{2,8})$"
LAST_SEGMENT = r"([^\\/]+)$"


def strip(c: Column | str) -> Column:
    """Text without leading and trailing white space of any kind."""
    return F.btrim(col(c).cast("string"), F.lit(BLANKS))


def slashes(c: Column | str) -> Column:
    return F.translate(col(c).cast("string"), "\\", "/")


def normalize_path(c: Column | str) -> Column:
    """One slash between segments and none at the ends; '' for a missing path."""
    joined = F.regexp_replace(slashes(strip(c)), "/+", "/")
    return F.coalesce(F.regexp_replace(joined, "^/|/$", ""), F.lit(""))


def segments(c: Column | str) -> Column:
    """Non-blank, trimmed segments of a path as an array."""
    parts = F.transform(F.split(normalize_path(c), "/"), strip)
    return F.filter(parts, lambda part: part != "")


def standard_path(folder: Column | str, file: Column | str, full: Column | str) -> Column:
    """``folder\\file`` when both are known, else the full path."""
    folder, file, full = col(folder), col(file), col(full)
    return F.when(uses_concat(folder, file), F.concat(folder, F.lit("\\"), file)).otherwise(full)


def standard_file_name(file: Column | str, path: Column | str) -> Column:
    return F.coalesce(col(file), F.regexp_extract(col(path), LAST_SEGMENT, 1))


def extension(c: Column | str) -> Column:
    """Lower-case extension; '' when there is none, NULL for a NULL path."""
    return F.lower(F.regexp_extract(col(c), EXTENSION, 1))


def suffix_family(
    ext: Column | str,
    image: list[str] = IMAGE_EXTENSIONS,
    video: list[str] = VIDEO_EXTENSIONS,
) -> Column:
    """image, video, none or other; a NULL path counts as other."""
    ext = col(ext)
    return (
        F.when(ext.isin(image), "image")
        .when(ext.isin(video), "video")
        .when(ext == "", "none")
        .otherwise("other")
    )


def has_suffix(c: Column | str, suffixes: list[str]) -> Column:
    return F.lower(col(c)).rlike(r"\.(" + "|".join(suffixes) + ")$")


def uses_concat(folder: Column | str, file: Column | str) -> Column:
    return non_blank(folder) & non_blank(file)


def basename_conflict(full: Column | str, file: Column | str) -> Column:
    """The file named by the path is not the file named by the row."""
    base = F.lower(F.regexp_extract(col(full), LAST_SEGMENT, 1))
    return non_blank(full) & non_blank(file) & (base != F.lower(col(file)))


def ends_with_suffix(c: Column | str) -> Column:
    return F.coalesce(col(c).rlike(r"(?i)\.[a-z0-9]{2,8}$"), F.lit(False))


def url_decode(c: Column | str) -> Column:
    """Percent-decoded text; '+' stays, and text with bad escapes stays as it is."""
    raw = col(c).cast("string")
    return F.coalesce(F.try_url_decode(F.replace(raw, F.lit("+"), F.lit("%2B"))), raw)


def without_separators(c: Column | str) -> Column:
    return F.regexp_replace(F.coalesce(col(c), F.lit("")), r"[\\/]+", "")


def last_part(c: Column | str) -> Column:
    return F.element_at(F.split(F.coalesce(col(c), F.lit("")), r"[\\/]"), -1)


def compact_signature(c: Column | str) -> Column:
    """Decoded text without any separators, equal for all spellings of one path."""
    return without_separators(url_decode(c))


def decoded_file_name(c: Column | str) -> Column:
    return last_part(url_decode(c))


def has_percent_encoding(c: Column | str) -> Column:
    return F.coalesce(col(c).rlike("%[0-9a-fA-F]{2}"), F.lit(False))


def has_separator(c: Column | str) -> Column:
    return F.coalesce(col(c).rlike(r"[\\/]"), F.lit(False))


def first_pattern(c: Column | str, patterns: list[tuple[str, str]], ignore_case: bool = True) -> Column:
    """Name of the first pattern found in the text, NULL when none is."""
    c = col(c)
    prefix = "(?i)" if ignore_case else ""
    return first_match([(c.rlike(prefix + pattern), name) for name, pattern in patterns])


def canonical_label(
    c: Column | str,
    patterns: list[tuple[str, str]] = PLATFORM_PATTERNS,
    stop_list: list[str] = CONTENT_LABELS,
) -> Column:
    """Canonical name of a label; stop-listed, blank and unknown texts give NULL."""
    value = strip(c)
    known = first_pattern(value, patterns)
    return F.when(value.isin(stop_list), F.lit(None)).otherwise(known) if stop_list else known


def family_bucket(c: Column | str, patterns=FAMILY_PATTERNS, default: str = FAMILY_DEFAULT) -> Column:
    return F.coalesce(first_pattern(c, patterns, ignore_case=False), F.lit(default))


def segment_pattern(keyword: str) -> str:
    """A path segment that contains the keyword."""
    return f"(^|/)[^/]*{re.escape(keyword)}[^/]*(/|$)"


def cascade(steps: list[tuple[Column | str, str, str]]) -> Column:
    """Value of the first (text, pattern, value) step that matches, else NULL."""
    return first_match([(col(c).rlike(pattern), value) for c, pattern, value in steps])


def platform_cascade(
    path_steps: list[tuple[Column | str, list[str]]],
    label: Column | str,
    label_keywords: list[str],
) -> Column:
    """Look for each keyword in path segments first, then in the explicit label."""
    steps = [
        (slashes(path), segment_pattern(word), word) for path, words in path_steps for word in words
    ]
    steps += [(label, re.escape(word), word) for word in label_keywords]
    return cascade(steps)
