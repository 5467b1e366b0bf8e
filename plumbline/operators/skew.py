"""Key skew: measuring it, and aggregating or joining in spite of it."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import BooleanType, DateType, DecimalType, NumericType, StringType, TimestampNTZType, TimestampType

from plumbline.functions.columns import ratio, spare_name
from plumbline.operators.ordered import cut

#: a summary of frequent keys is merged in so many tasks before the last one
SUMMARY_TASKS = 64
#: keys that a summary tracks for a top list
TRACKED = 10_000
#: the most that Spark's summary can track
MOST_TRACKED = 1_000_000


def key_counts(df: DataFrame, key: str, fraction: float | None = None, seed: int = 7) -> DataFrame:
    """Rows per key, from a sample when ``fraction`` is given."""
    base = df.select(F.col(f"`{key}`"))
    if fraction is not None:
        base = base.sample(fraction, seed)
    return base.groupBy(f"`{key}`").agg(F.count(F.lit(1)).alias("row_count"))


def skew_profile(df: DataFrame, key: str, fraction: float | None = None) -> DataFrame:
    """How unevenly rows are spread over keys."""
    n = F.col("row_count")
    one = key_counts(df, key, fraction).agg(
        F.count(F.lit(1)).alias("key_count"),
        F.coalesce(F.sum(n), F.lit(0)).alias("total_rows"),
        F.max(n).alias("max_rows"),
        F.round(F.avg(n), 4).alias("avg_rows"),
        F.round(F.skewness(n), 4).alias("skewness"),
    )
    return one.select(
        F.lit(key).alias("key_name"),
        "*",
        ratio(F.col("max_rows") * F.col("key_count"), F.col("total_rows"), 4).alias("max_to_avg"),
        ratio(F.col("max_rows"), F.col("total_rows")).alias("top_key_share"),
    )


def missed_share(tracked: int) -> float:
    """Share of the rows above which no key is missing from a summary of so many tracked keys.

    The summary holds a hash map of a power of two of entries, filled to three
    quarters, and its error is at most 3.5 / entries of the rows; it lists what
    is surely above that error.
    """
    return 2 * 3.5 / 2 ** math.ceil(math.log2(tracked / 0.75))


def can_summarise(df: DataFrame, key: str) -> bool:
    kinds = (NumericType, StringType, BooleanType, DateType, TimestampType, TimestampNTZType)
    return isinstance(df.schema[key].dataType, kinds) and not (isinstance(df.schema[key].dataType, StringType) and df.schema[key].dataType.collation != "UTF8_BINARY")


def summary(df: DataFrame, key: str, tracked: int) -> DataFrame:
    """(key, at_least) of the keys in a mergeable frequent-items summary: all above ``missed_share(tracked)`` are there.

    One pass. Every task keeps ``tracked`` counters, the summaries of all tasks
    are merged in ``SUMMARY_TASKS`` tasks, and only those meet in one.
    """
    rows = df.select(F.col(f"`{key}`").alias("k"))
    parts = rows.groupBy(F.pmod(F.spark_partition_id(), F.lit(SUMMARY_TASKS))).agg(F.call_function("approx_top_k_accumulate", F.col("k"), F.lit(tracked)).alias("s"))
    # grouped, as the merge fails on a task without rows
    whole = parts.groupBy(F.lit(1)).agg(F.call_function("approx_top_k_combine", F.col("s"), F.lit(tracked)).alias("s"))
    return whole.select(F.inline(F.call_function("approx_top_k_estimate", F.col("s"), F.lit(tracked)))).select(F.col("item").alias(key), F.col("count").alias("at_least"))


def candidate_counts(df: DataFrame, key: str, tracked: int) -> DataFrame:
    """Exact rows of the keys in a summary, from a second pass: other keys are left out before anything is counted."""
    return counts_of(df, key, summary(df, key, tracked)).select(F.col("k").alias(key), "row_count")


def counts_of(df: DataFrame, key: str, listed: DataFrame) -> DataFrame:
    """(k, row_count) of the keys in the first column of a short list, null included."""
    few = F.broadcast(listed.select(F.col(f"`{listed.columns[0]}`").alias("_listed")))
    rows = df.select(F.col(f"`{key}`").alias("k"))
    return rows.join(few, F.col("k").eqNullSafe(F.col("_listed")), "left_semi").groupBy("k").agg(F.count(F.lit(1)).alias("row_count"))


def hot_keys(df: DataFrame, key: str, k: int = 10, fraction: float | None = None) -> DataFrame:
    """The k most frequent keys with their share of rows.

    The keys come from a summary and are counted exactly. They are the right
    ones if the last of them has more rows than any key outside the summary can
    have; else, as in a flat distribution, all keys are counted. The numbers
    decide when the frame is made.
    """
    order = [F.desc("row_count"), F.asc(f"`{key}`")]
    if fraction is None and can_summarise(df, key) and k <= TRACKED:
        total = df.count()
        top = cut(candidate_counts(df, key, TRACKED).orderBy(*order).limit(k))
        found, least = top.agg(F.count(F.lit(1)), F.min("row_count")).first()
        if found == k and least > missed_share(TRACKED) * total:
            return top.withColumn("row_share", ratio(F.col("row_count"), F.lit(total))).orderBy(*order)
    counts = key_counts(df, key, fraction)
    total = counts.agg(F.sum("row_count")).scalar()
    top = counts.orderBy(*order).limit(k)
    return top.withColumn("row_share", ratio(F.col("row_count"), total))


def heavy_counts(df: DataFrame, key: str, share: float = 0.01, fraction: float | None = None) -> DataFrame:
    """(key, row_count) of the keys that hold more than ``share`` of the rows: never more than 1 / share of them.

    Exact: a summary that cannot miss such a key lists candidates, which alone
    are counted. Smaller shares than it can resolve, keys of other types than
    it knows, and samples (``fraction``) count all keys.
    """
    tracked = math.ceil(8 / share)
    if fraction is None and tracked <= MOST_TRACKED and can_summarise(df, key):
        counts, total = candidate_counts(df, key, tracked), df.agg(F.count(F.lit(1))).scalar()
    else:
        counts = key_counts(df, key, fraction)
        total = counts.agg(F.sum("row_count")).scalar()
    return counts.where(F.col("row_count") > total * share)


def heavy_keys(df: DataFrame, key: str, share: float = 0.01, fraction: float | None = None) -> DataFrame:
    """Keys that hold more than ``share`` of the rows: never more than 1 / share of them."""
    return heavy_counts(df, key, share, fraction).select(F.col(f"`{key}`"))


def row_salt(salts: int | Column, columns: list[str]) -> Column:
    """Salt that depends on the row only, so a retried task gives the same salt."""
    return F.pmod(F.xxhash64(*[F.col(f"`{c}`") for c in columns]), salts if isinstance(salts, Column) else F.lit(salts)).cast("int")


def salt_columns(df: DataFrame, keys: list[str]) -> list[str]:
    """All columns outside the keys that can be hashed; the keys themselves if there are none."""
    plain = [f.name for f in df.schema.fields if f.name not in keys and "map<" not in f.dataType.simpleString()]
    return plain or keys


#: aggregate -> (first stage, second stage)
MERGEABLE = {
    "count": (F.count, F.sum),
    "sum": (F.sum, F.sum),
    "min": (F.min, F.min),
    "max": (F.max, F.max),
}


def two_stage_agg(
    df: DataFrame, keys: list[str], aggs: dict[str, tuple[str, str]], salts: int = 16, salt_by: list[str] | None = None
) -> DataFrame:
    """Aggregate by (keys, salt) first, then merge per key.

    ``aggs`` maps an output name to (count | sum | min | max | avg, column). A
    hot key is spread over up to ``salts`` tasks in the first stage.
    """
    salt_by = salt_by or salt_columns(df, keys)
    first, second, final = [], [], []
    for i, (out, (fn, column)) in enumerate(aggs.items()):
        c = F.col(column) if column != "*" else F.lit(1)
        if fn == "avg":
            first += [F.sum(c.cast("double")).alias(f"s{i}"), F.count(c).alias(f"n{i}")]
            second += [F.sum(f"s{i}").alias(f"s{i}"), F.sum(f"n{i}").alias(f"n{i}")]
            final.append(F.try_divide(F.col(f"s{i}"), F.col(f"n{i}").cast("double")).alias(out))
        else:
            one, two = MERGEABLE[fn]
            first.append(one(c).alias(f"a{i}"))
            second.append(two(f"a{i}").alias(f"a{i}"))
            final.append(F.col(f"a{i}").alias(out))
    partial = df.groupBy(*keys, row_salt(salts, salt_by).alias("_salt")).agg(*first)
    return partial.groupBy(*keys).agg(*second).select(*keys, *final)


def merged(df: DataFrame, by: list[str], count: str, sums: dict[str, str] | None = None) -> DataFrame:
    """One row per different values in ``by``, null included: how many rows it stands for (``count``) and their sums.

    ``sums`` maps an output name to a column. Where only totals of a join are
    wanted, merged sides meet instead of all rows: a pair of merged rows stands
    for the product of their counts, and a sum of one side counts as often as
    the other side has rows. A key that is heavy on both sides then costs the
    product of its different rows, not of all its rows.
    """
    return df.groupBy(*by).agg(F.count(F.lit(1)).alias(count), *[F.sum(c).alias(out) for out, c in (sums or {}).items()])


def salt_parts(large: DataFrame, small: DataFrame, key: str, share: float, part_rows: int | None, fraction: float | None) -> DataFrame | None:
    """(key, parts_l, parts_s) of the keys that are heavy on a side: into how many parts each side's rows of the key are cut.

    A part has at most ``part_rows`` rows, by default ``share`` of its side.
    There are at most 2 / share such keys, and they are worked out here and now,
    in two passes over the keys of each side; None if no key is heavy.
    """
    tracked = math.ceil(8 / share)
    if fraction is None and tracked <= MOST_TRACKED and can_summarise(large, key) and can_summarise(small, key):
        listed = summary(large, key, tracked).union(summary(small, key, tracked))
    else:
        listed = heavy_counts(large, key, share, fraction).union(heavy_counts(small, key, share, fraction))
    keys = cut(listed.select(F.col(f"`{key}`").alias("k")).where("k is not null").distinct())

    def side(df: DataFrame, parts: str, heavy: str) -> DataFrame:
        own = df.select(F.col(f"`{key}`")) if fraction is None else df.select(F.col(f"`{key}`")).sample(fraction, 7)
        total = own.count()
        limit = max(1, math.ceil(share * total) if part_rows is None else math.ceil(part_rows * (fraction or 1)))
        n = F.col("row_count")
        return counts_of(own, key, keys).select("k", F.ceil(n / limit).cast("int").alias(parts), (n > share * total).alias(heavy))

    both = side(large, "parts_l", "heavy_l").join(side(small, "parts_s", "heavy_s"), "k", "full")
    heavy = cut(both.where("coalesce(heavy_l, false) or coalesce(heavy_s, false)").select("k", *[F.coalesce(c, F.lit(1)).alias(c) for c in ("parts_l", "parts_s")]))
    return None if heavy.isEmpty() else heavy


def salted_join(
    large: DataFrame, small: DataFrame, key: str, how: str = "inner", salts: int = 16, share: float = 0.01,
    salt_by: list[str] | None = None, fraction: float | None = None, part_rows: int | None = None,
) -> DataFrame:
    """Equi-join in which the rows of heavy keys are spread over as many tasks as their number asks for.

    A key above ``share`` of either side is cut into a grid: its rows of the
    large side into parts of at most ``part_rows`` (by default ``share`` of all),
    those of the small side likewise, and each pair of parts meets in a task of
    its own. A row goes to all parts of the other side, which is one unless the
    key is heavy there as well. All other rows stay single. Rows without a key
    match nothing, so they are spread over ``salts`` tasks. The salt comes from
    all other columns, or from those in ``salt_by``; equal rows share it. ``how``
    is inner, left, left_semi or left_anti. Columns of any names stay.
    """
    if how not in ("inner", "left", "left_semi", "left_anti"):
        raise ValueError("the salted side must be the preserved side")
    only_keys = how in ("left_semi", "left_anti")
    if only_keys:
        small = small.select(F.col(f"`{key}`")).distinct()
    taken = [*large.columns, *small.columns]
    row, column, k, matched = (spare_name(taken, name) for name in ("_row", "_column", "_k", "_matched"))
    large_by = salt_by or salt_columns(large, [key])
    parts = salt_parts(large, small, key, share, part_rows, fraction)
    if parts is None:
        left = large.withColumn(row, F.when(F.col(f"`{key}`").isNull(), row_salt(salts, large_by)).otherwise(F.lit(0)))
        return left.join(small.withColumn(row, F.lit(0)), [key, row], how).drop(row)
    own, other = spare_name(taken, "_parts_l"), spare_name(taken, "_parts_s")
    parts = F.broadcast(parts.select(F.col("k").alias(k), F.col("parts_l").alias(own), F.col("parts_s").alias(other)))
    grid = not parts.where(F.col(other) > 1).isEmpty()

    def marked(df: DataFrame) -> DataFrame:
        return df.join(parts, F.col(f"`{key}`") == F.col(k), "left")

    salt = F.when(F.col(f"`{key}`").isNull(), row_salt(salts, large_by)).when(F.col(own) > 1, row_salt(F.col(own), large_by)).otherwise(F.lit(0))
    cells = F.sequence(F.lit(0), F.coalesce(F.col(other), F.lit(1)) - 1)
    left = marked(large).withColumn(row, salt).withColumn(column, F.explode(cells) if grid else F.lit(0))
    small_by = salt_columns(small, [key])
    right = marked(small).withColumn(column, F.when(F.col(other) > 1, row_salt(F.col(other), small_by)).otherwise(F.lit(0)))
    right = right.withColumn(row, F.explode(F.sequence(F.lit(0), F.coalesce(F.col(own), F.lit(1)) - 1))).drop(k, own, other)
    if how == "left" and grid:
        # of a row's copies, those that met an empty part go: the key has rows in another
        joined = left.join(right.withColumn(matched, F.lit(True)), [key, row, column], how)
        joined = joined.where(F.col(matched) | ~F.coalesce(F.col(other) > 1, F.lit(False))).drop(matched)
    else:
        joined = left.join(right, [key, row, column], how)
    return joined.drop(row, column, k, own, other)


def plan_partitions(total_bytes: int, target_bytes: int = 256 * 1024 * 1024, minimum: int = 1) -> int:
    """Number of partitions for a data size; the target should lie in 128 MB to 1 GB."""
    return max(minimum, -(-int(total_bytes) // int(target_bytes)))
