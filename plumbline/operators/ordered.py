"""Global order without a single-task sort: top lists, pages, running sums, quantiles."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, Observation, SparkSession, Window, functions as F
from pyspark.sql.types import (
    BooleanType,
    DataType,
    DateType,
    DecimalType,
    DoubleType,
    FloatType,
    IntegralType,
    NumericType,
    StringType,
    TimestampNTZType,
    TimestampType,
)


def shared_folder(spark: SparkSession) -> str | None:
    """Folder for intermediate tables: the one the cluster names for checkpoints, if any.

    A local session without that setting, as in tests, gets one of its own.
    """
    sc = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if folder is None and sc.master.startswith("local"):
        folder = tempfile.mkdtemp(prefix="plumbline-")
        sc.setCheckpointDir(folder)
    return folder


def scratch_path(spark: SparkSession) -> str:
    """A new path in the shared folder."""
    folder = shared_folder(spark)
    if folder is None:
        raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
    return f"{folder}/plumbline-{uuid.uuid4().hex}"


def cut(df: DataFrame) -> DataFrame:
    """Write a frame to the shared folder and read it back.

    The plan starts anew from the files, so it stays short over many rounds,
    its rows are fixed, and a lost executor never means starting from the top.
    A cluster without that folder keeps the frame in Spark's own storage; its
    plan then grows with the rounds.
    """
    folder = shared_folder(df.sparkSession)
    if folder is None:
        return df.persist()
    path = f"{folder}/plumbline-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def cut_counted(df: DataFrame) -> tuple[DataFrame, int]:
    """``cut`` a frame and count its rows while they are written."""
    seen = Observation()
    out = cut(df.observe(seen, F.count(F.lit(1)).alias("n")))
    return (out, seen.get["n"]) if shared_folder(df.sparkSession) is not None else (out, out.count())


def ordered_running(
    df: DataFrame,
    order: list[Column],
    sums: dict[str, str] | None = None,
    row_number: str | None = None,
    partitions: int | None = None,
) -> DataFrame:
    """Exact running sums (and row numbers) over one global order.

    Rows are range-partitioned by the order. Each range runs on its own and adds
    the totals of the ranges before it; only one row per range is ever brought
    together. The ranged frame is written out because the range of a row must
    not change between its two uses.
    """
    sums = sums or {}
    ranged = df.repartitionByRange(partitions, *order) if partitions else df.repartitionByRange(*order)
    ranged = cut(ranged.withColumn("_range", F.spark_partition_id()))
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    totals = ranged.groupBy("_range").agg(
        F.count(F.lit(1)).alias("_rows"), *[F.sum(c).alias(f"_sum_{out}") for out, c in sums.items()]
    )
    offsets = totals.select(
        "_range",
        F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_rows"),
        *[F.coalesce(F.sum(f"_sum_{o}").over(before), F.lit(0)).alias(f"_sum_{o}") for o in sums],
    )
    inside = Window.partitionBy("_range").orderBy(*order)
    rows = inside.rowsBetween(Window.unboundedPreceding, 0)
    out = ranged.join(F.broadcast(offsets), "_range")
    added = {o: F.sum(c).over(rows) + F.col(f"_sum_{o}") for o, c in sums.items()}
    if row_number:
        added[row_number] = F.row_number().over(inside).cast("long") + F.col("_rows")
    return out.withColumns(added).drop("_range", "_rows", *[f"_sum_{o}" for o in sums])


def shares(
    counts: DataFrame,
    value: str,
    count: str,
    total: DataFrame,
    n: int | None = None,
    share: str = "probability",
    cumulative: str = "cumulative_probability",
    decimals: int = 6,
) -> DataFrame:
    """Add share and cumulative share in the order count descending, value ascending.

    ``total`` is a one-row, one-column frame. With ``n`` only the first n rows
    are kept, so the running sum sees n rows; without it the sum is distributed.
    """
    order = [F.desc(count), F.asc(value)]
    whole = total.scalar().cast("double")
    if n is None:
        out = ordered_running(counts, order, {"_running": count})
    else:
        top = counts.orderBy(*order).limit(n)
        running = Window.orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
        out = top.withColumn("_running", F.sum(count).over(running))
    return out.withColumns(
        {
            share: F.round(F.try_divide(F.col(count).cast("double"), whole), decimals),
            cumulative: F.round(F.try_divide(F.col("_running").cast("double"), whole), decimals),
        }
    ).drop("_running")


#: a page within so many first rows comes from the first rows of each task
FIRST_ROWS = 10_000


def order_columns(order: list[Column | tuple[str, bool]]) -> list[Column]:
    """Sort columns; a tuple (name, rising) stands for one with Spark's usual place of NULL."""
    return [(F.asc if o[1] else F.desc)(F.col(f"`{o[0]}`")) if isinstance(o, tuple) else o for o in order]


def page(df: DataFrame, order: list[Column | tuple[str, bool]], offset: int, size: int) -> DataFrame:
    """Rows offset+1 .. offset+size of a total order.

    A page near the beginning needs the first rows of each task only. Deeper,
    if the first sort column is given as (name, rising) and holds numbers, dates
    or times, a sketch says between which of its values the page lies; the rows
    before are counted, and only those between are put in order. Any other
    order numbers all rows in parallel.
    """
    columns = order_columns(order)
    if offset + size <= FIRST_ROWS:
        return df.orderBy(*columns).offset(offset).limit(size)
    rn, before, rows = F.col("_rn"), 0, df
    if isinstance(order[0], tuple) and (found := page_span(df, *order[0], offset, size)) is not None:
        rows, before = found
    numbered = ordered_running(rows, columns, row_number="_rn")
    return numbered.where((rn > offset - before) & (rn <= offset - before + size)).drop("_rn")


def page_span(df: DataFrame, name: str, rising: bool, offset: int, size: int) -> tuple[DataFrame, int] | None:
    """The rows among which a page surely lies, and the number of rows before them; None if the column does not tell."""
    kind, c = df.schema[name].dataType, F.col(f"`{name}`")
    if isinstance(kind, NumericType):
        v = c.cast("double")
    elif isinstance(kind, DateType):
        v = F.unix_date(c).cast("double")
    elif isinstance(kind, TimestampType):
        v = F.unix_micros(c).cast("double")
    else:
        return None
    v = v if rising else -v
    total, numbers = df.agg(F.count(F.lit(1)), F.count(F.nullif(v, F.lit(float("nan"))))).first()
    if total == 0 or numbers < total:
        # NULL and NaN have places of their own
        return None
    reach = 4 * rank_error(SKETCH)
    ranks = [min(1.0, max(0.0, r)) for r in (offset / total - reach, (offset + size) / total + reach)]
    sketch = quantile_sketches(df, {"v": v}, SKETCH)
    low, high = sketch.select(F.kll_sketch_get_quantile_double("sketch", F.array(*map(F.lit, ranks)))).first()[0]
    before, upto = df.agg(F.count_if(v < low), F.count_if(v <= high)).first()
    if before > offset or upto < min(offset + size, total):
        return None
    return df.where(v.between(low, high)), before


def take_per_group(
    df: DataFrame, groups: list[str], order: list[Column], n: int, rank: str | None = None
) -> DataFrame:
    """First n rows of every group; Spark cuts each task's rows to n before the shuffle."""
    name = rank or "_rn"
    w = Window.partitionBy(*groups).orderBy(*order)
    out = df.withColumn(name, F.row_number().over(w)).where(F.col(name) <= n)
    return out if rank else out.drop(name)


def long_values(df: DataFrame, columns: dict[str, Column], keep: list[str] | None = None) -> DataFrame:
    """(field, value) rows of several columns from one scan, next to the kept columns."""
    keep = keep or []
    wide = df.select(*keep, *[c.alias(f"_{k}") for k, c in columns.items()])
    names = F.create_map(*[x for k in columns for x in (F.lit(f"_{k}"), F.lit(k))])
    long = wide.unpivot(keep, [f"_{k}" for k in columns], "_field", "value")
    return long.select(*keep, names[F.col("_field")].alias("field"), "value")


def _key_type(dtype: DataType) -> str:
    """Type under which values of a column can share a column with others."""
    if isinstance(dtype, IntegralType):
        return "bigint"
    if isinstance(dtype, (FloatType, DoubleType)):
        return "double"
    if isinstance(dtype, (StringType, DateType, TimestampType, TimestampNTZType, BooleanType, DecimalType)):
        return dtype.simpleString()
    return "string"


def by_type(df: DataFrame, columns: dict[str, Column]) -> list[dict[str, Column]]:
    """Columns grouped by type, cast to the common type of their group.

    Values keep their native form, which is shorter to shuffle than text.
    """
    schema = df.select(*[c.alias(k) for k, c in columns.items()]).schema
    groups: dict[str, dict[str, Column]] = {}
    for k, c in columns.items():
        kind = _key_type(schema[k].dataType)
        groups.setdefault(kind, {})[k] = c.cast(kind)
    return list(groups.values())


def distinct_profile(df: DataFrame, columns: dict[str, Column]) -> DataFrame:
    """(field, total_rows, null_rows, distinct_values), exact, for many columns.

    Equal values are merged in every task before the shuffle, and a column that
    holds one value in most rows is no hot spot. Each type group reads only its
    own columns.
    """
    out = None
    for group in by_type(df, columns):
        per_value = long_values(df, group).groupBy("field", "value").agg(F.count(F.lit(1)).alias("n"))
        stats = per_value.groupBy("field").agg(
            F.sum("n").alias("total_rows"),
            F.coalesce(F.sum(F.when(F.col("value").isNull(), F.col("n"))), F.lit(0)).alias("null_rows"),
            F.count("value").alias("distinct_values"),
        )
        out = stats if out is None else out.unionByName(stats)
    return out


def grouped_distinct(df: DataFrame, keys: dict[str, Column], distinct: dict[str, Column]) -> DataFrame:
    """Rows and several exact distinct counts per group, through one shuffle of merged values."""
    groups = by_type(df, distinct)
    if len(groups) > 1:
        groups = [{k: c.cast("string") for k, c in distinct.items()}]
    base = df.select(*[c.alias(k) for k, c in keys.items()], *[c.alias(f"_v_{k}") for k, c in groups[0].items()])
    long = long_values(base, {k: F.col(f"_v_{k}") for k in distinct}, keep=list(keys))
    per_value = long.groupBy(*keys, "field", "value").agg(F.count(F.lit(1)).alias("n"))
    first = next(iter(distinct))
    is_field = {k: F.col("field") == k for k in distinct}
    return per_value.groupBy(*keys).agg(
        F.sum(F.when(is_field[first], F.col("n"))).alias("row_count"),
        *[F.count(F.when(is_field[k], F.col("value"))).alias(k) for k in distinct],
    )


def wide_to_rows(one_row: DataFrame, rows: list[list[Column]], names: list[str]) -> DataFrame:
    """Turn a one-row aggregate into one row per entry of ``rows``."""
    structs = [F.struct(*[c.alias(n) for c, n in zip(row, names)]) for row in rows]
    return one_row.select(F.inline(F.array(*structs)))


def histogram_quantiles(
    histogram: DataFrame, by: list[str], value: str, weight: str, probs: dict[str, float]
) -> DataFrame:
    """Discrete quantiles of a (value, weight) histogram per group."""
    w = Window.partitionBy(*by) if by else Window.partitionBy(F.lit(1))
    running = w.orderBy(value).rowsBetween(Window.unboundedPreceding, 0)
    cum = histogram.withColumns(
        {"_cum": F.sum(weight).over(running), "_all": F.sum(weight).over(w)}
    )
    picks = [
        F.min(F.when(F.col("_cum") >= F.col("_all") * p - F.lit(1e-9), F.col(value))).alias(name)
        for name, p in probs.items()
    ]
    return cum.groupBy(*by).agg(*picks)


#: items that a quantile sketch keeps, tasks that merge sketches before the last step, and cells of a bracket
SKETCH, SKETCH_TASKS, CELLS = 8192, 64, 32


def rank_error(size: int) -> float:
    """Normalised rank error of a sketch of this size, at 99 % for one quantile."""
    return 2.296 / size**0.9021


def numbers_of(columns: list[str]) -> dict[str, Column]:
    """Columns as doubles, NaN as missing: it has no place in an order of numbers."""
    return {c: F.nullif(F.col(f"`{c}`").cast("double"), F.lit(float("nan"))) for c in columns}


def quantile_sketches(df: DataFrame, columns: dict[str, Column], size: int = SKETCH) -> DataFrame:
    """(field, sketch): one mergeable sketch per column.

    Every task makes one sketch per column; they are merged per column and
    group of tasks, then per column, so no task sees them all.
    """
    wide = df.select(*[v.alias(f"c{i}") for i, v in enumerate(columns.values())])
    names = [f"c{i}" for i in range(len(columns))]
    parts = wide.groupBy(F.pmod(F.spark_partition_id(), F.lit(SKETCH_TASKS))).agg(
        *[F.kll_sketch_agg_double(c, size).alias(c) for c in names]
    )
    long = long_values(parts, dict(zip(columns, map(F.col, names)))).where("value is not null")
    return long.groupBy("field").agg(F.kll_merge_agg_double("value", size).alias("sketch"))


def brackets(df: DataFrame, columns: dict[str, Column], probs: list[float], size: int) -> dict[str, list[list[float]]]:
    """Per column, disjoint rising lists of numbers; each runs from surely below a quantile to surely above it.

    Columns without numbers are left out. A few hundred numbers come to the driver.
    """
    # four times the error of a sketch at 99 %: no chance worth naming that a quantile is outside
    reach = 4 * rank_error(size)
    ranks = [[min(1.0, max(0.0, p + reach * (2 * j / CELLS - 1))) for j in range(CELLS + 1)] for p in probs]
    sketches = quantile_sketches(df, columns, size).where(F.kll_sketch_get_n_double("sketch") > 0)
    flat = F.array(*[F.lit(r) for row in ranks for r in row])
    found = sketches.select("field", F.kll_sketch_get_quantile_double("sketch", flat).alias("marks")).collect()
    out: dict[str, list[list[float]]] = {}
    for r in found:
        merged: list[list[float]] = []
        for marks in sorted(sorted(set(r.marks[k * (CELLS + 1) : (k + 1) * (CELLS + 1)])) for k in range(len(probs))):
            if merged and marks[0] <= merged[-1][-1]:
                merged[-1] = sorted({*merged[-1], *marks})
            else:
                merged.append(marks)
        out[r.field] = merged
    return out


def exact_quantiles(
    df: DataFrame, columns: list[str], probs: list[float], sketch_size: int = SKETCH
) -> DataFrame:
    """Exact interpolated quantiles of many numeric columns: (field, n, prob, value); NaN counts as missing.

    Mergeable sketches first bracket every quantile. A second pass keeps single
    values only inside the brackets (some ``8 * rank_error`` of the rows per
    quantile), everything between them becomes one counter each. The brackets
    are cut into cells, so the cell of a row follows from its value and some
    constants; the cells' totals say which cell holds a quantile, and only its
    values are put in order. A rank outside its bracket raises an error instead
    of giving a wrong value. Infinities are numbers like others. The sketches
    are made at once, the rest when the frame is used.
    """
    numbers = numbers_of(columns)
    known = brackets(df, numbers, probs, sketch_size)
    step = CELLS * len(probs) + 3
    cells = {}
    for name, v in numbers.items():
        place = F.when(F.lit(False), F.lit(0))
        for g, marks in enumerate(known.get(name, [])):
            lower = F.size(F.filter(F.array(*map(F.lit, marks)), lambda m, v=v: m < v))
            place = place.when(v < marks[0], g * step).when(v <= marks[-1], F.lit(g * step + 1) + lower)
        place = F.coalesce(place.otherwise(len(known.get(name, [])) * step), F.lit(0))
        cells[name] = F.struct(v.alias("v"), place.alias("cell"))
    inside = F.col("cell") % step != 0
    counted = (
        df.select(*[cell.alias(name) for name, cell in cells.items()])
        .unpivot([], list(cells), "field", "cell")
        .select("field", "cell.*")
        .where(F.col("v").isNotNull())
        .groupBy("field", "cell", F.when(inside, F.col("v")).alias("value"))
        .agg(F.count(F.lit(1)).alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi"))
    )
    # some hundred rows per field
    before = Window.partitionBy("field").orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)
    totals = counted.groupBy("field", "cell").agg(F.sum("n").alias("n"), F.min("lo").alias("lo"), F.max("hi").alias("hi")).withColumns(
        {"below": F.coalesce(F.sum("n").over(before), F.lit(0)), "all": F.sum("n").over(Window.partitionBy("field"))}
    )
    last = F.col("all") - 1
    asked = F.array(
        *[
            F.struct(F.lit(f"{side}{k}").alias("which"), (end(last * F.lit(float(p))) + 1).alias("rank"))
            for k, p in enumerate(probs)
            for side, end in (("lo", F.floor), ("hi", F.ceil))
        ]
    )
    wanted = totals.select("*", F.inline(asked)).where((F.col("below") < F.col("rank")) & (F.col("rank") <= F.col("below") + F.col("n")))
    between = (
        F.when(F.col("rank") == F.col("below") + 1, F.col("lo"))
        .when(F.col("rank") == F.col("below") + F.col("n"), F.col("hi"))
        .otherwise(F.raise_error(F.lit("quantile outside its bracket: raise sketch_size")).cast("double"))
    )
    apart = wanted.where(~inside).select("field", "all", "which", between.alias("value"))
    running = Window.partitionBy("field", "cell").orderBy("value").rowsBetween(Window.unboundedPreceding, 0)
    chosen = wanted.where(inside).select("field", "cell", "below", "all", "which", "rank")
    few = chosen.groupBy("field", "cell").agg(F.first("below").alias("below"), F.first("all").alias("all"), F.collect_list(F.struct("which", "rank")).alias("asked"))
    # greatest(lo, hi) is the value itself; the same columns as above let Spark use one shuffle for both
    single = counted.select("field", "cell", F.greatest("lo", "hi").alias("value"), "n").join(F.broadcast(few), ["field", "cell"])
    single = single.withColumn("upto", F.sum("n").over(running) + F.col("below"))
    met = single.select("field", "all", "value", "upto", "n", F.inline("asked")).where((F.col("rank") <= F.col("upto")) & (F.col("rank") > F.col("upto") - F.col("n")))
    ends = apart.unionByName(met.select("field", "all", "which", "value"))
    picks = [F.max(F.when(F.col("which") == f"{side}{k}", F.col("value"))).alias(f"{side}{k}") for k in range(len(probs)) for side in ("lo", "hi")]
    found = ends.groupBy("field").agg(F.max("all").alias("n"), *picks)
    rows = []
    for k, p in enumerate(probs):
        pos = (F.col("n") - 1) * F.lit(float(p))
        lo, hi = F.col(f"lo{k}"), F.col(f"hi{k}")
        mean = (F.ceil(pos) - pos) * lo + (pos - F.floor(pos)) * hi
        value = F.when(lo == hi, lo).otherwise(mean)
        rows.append(F.struct(F.lit(float(p)).alias("prob"), value.alias("value")))
    return found.select("field", "n", F.inline(F.array(*rows)))


def quantile_struct(
    df: DataFrame,
    columns: list[str],
    probs: list[float],
    exact: bool = True,
    sketch_size: int = SKETCH,
) -> Column:
    """Scalar struct ``column -> array of quantiles``, for use inside expressions; NaN counts as missing.

    Without ``exact`` the values come from the sketches alone, within ``rank_error`` of the rank.
    """
    if exact:
        long = exact_quantiles(df, columns, probs, sketch_size)
        picks = [
            F.array(
                *[
                    F.max(F.when((F.col("field") == c) & (F.col("prob") == float(p)), F.col("value")))
                    for p in probs
                ]
            ).alias(f"c{i}")
            for i, c in enumerate(columns)
        ]
        return long.agg(F.struct(*picks).alias("q")).scalar()
    sketches = quantile_sketches(df, numbers_of(columns), sketch_size).where(F.kll_sketch_get_n_double("sketch") > 0)
    found = sketches.select("field", F.kll_sketch_get_quantile_double("sketch", F.array(*map(F.lit, map(float, probs)))).alias("q"))
    picks = [F.max(F.when(F.col("field") == c, F.col("q"))).alias(f"c{i}") for i, c in enumerate(columns)]
    return found.agg(F.struct(*picks).alias("q")).scalar()
