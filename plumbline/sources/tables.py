"""Table access: scans, discovery, logical column binding, canonical frames."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.types import ArrayType, StringType, StructType

from plumbline.functions.columns import blank_to_null, non_blank, time_prefix, to_number


def constant_rows(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    """A few fixed rows as a frame, built from literals inside the plan."""
    kind = StructType.fromDDL(schema)
    structs = [
        F.struct(*[F.lit(v).cast(f.dataType).alias(f.name) for v, f in zip(row, kind.fields)]) for row in rows
    ]
    cells = F.array(*structs) if structs else F.array().cast(ArrayType(kind))
    return spark.range(0, 1, 1, 1).select(F.inline(cells))


def scan(
    spark: SparkSession,
    source: str,
    columns: list[str] | None = None,
    where: Column | str | None = None,
) -> DataFrame:
    """Catalog table or parquet path with column pruning and pushed-down filters.

    ``where`` is a built-in expression, so it reaches the file scan; filters
    that need Python code belong above the scan.
    """
    df = spark.read.parquet(source) if "/" in source else spark.table(source)
    if where is not None:
        df = df.where(where)
    return df.select(*columns) if columns else df


def describe(df: DataFrame) -> DataFrame:
    """One row per column: position, name, type, nullability, comment."""
    rows = [
        (i + 1, f.name, f.dataType.simpleString(), f.nullable, f.metadata.get("comment", ""))
        for i, f in enumerate(df.schema.fields)
    ]
    schema = "position int, column_name string, data_type string, nullable boolean, comment string"
    return constant_rows(df.sparkSession, rows, schema)


def resolve_table(spark: SparkSession, candidates: list[str]) -> tuple[str | None, str]:
    """First existing table and how it was found: result, fallback or missing."""
    for i, name in enumerate(candidates):
        if spark.catalog.tableExists(name):
            return name, "result" if i == 0 else "fallback"
    return None, "missing"


def find_table(spark: SparkSession, table: str, databases: list[str] | None = None) -> str | None:
    """Look for a table in the preferred databases first, then in all others."""
    others = [d.name for d in spark.catalog.listDatabases()]
    for database in dict.fromkeys((databases or []) + others):
        if spark.catalog.tableExists(f"{database}.{table}"):
            return f"{database}.{table}"
    return None


def bind_columns(
    columns: list[str], candidates: dict[str, list[str]]
) -> tuple[dict[str, str | None], list[str]]:
    """Bind logical names to the first existing candidate; also list the misses."""
    present = set(columns)
    bound = {
        name: next((c for c in options if c in present), None) for name, options in candidates.items()
    }
    return bound, [name for name, hit in bound.items() if hit is None]


@dataclass
class LogicalField:
    """A logical column: where it may come from and how it is normalised."""

    name: str
    candidates: list[str] = field(default_factory=list)
    kind: str = "text"  # text, upper, number, day, hour, raw

    def expression(self, columns: list[str]) -> Column:
        hit = next((c for c in self.candidates or [self.name] if c in columns), None)
        if hit is None:
            return F.lit(None).cast("double" if self.kind == "number" else "string")
        return {
            "text": blank_to_null,
            "upper": lambda c: blank_to_null(c, upper=True),
            "number": to_number,
            "day": lambda c: time_prefix(c, 10),
            "hour": lambda c: time_prefix(c, 13),
            "raw": F.col,
        }[self.kind](hit)


def canonical(
    df: DataFrame,
    fields: list[LogicalField],
    where: Column | str | None = None,
    keep: list[str] | None = None,
) -> DataFrame:
    """Project to normalised logical columns; unbound ones become typed NULLs."""
    if where is not None:
        df = df.where(where)
    extra = [F.col(c) for c in keep or []]
    return df.select(*extra, *[f.expression(df.columns).alias(f.name) for f in fields])


def date_range(
    df: DataFrame, column: str | None, start: str | None = None, end: str | None = None
) -> DataFrame:
    """Keep days from ``start`` to ``end``, both included.

    A typed time column is compared as a time, so the filter can be pushed into
    the scan; only a text column is cut to its day prefix.
    """
    if start is None and end is None:
        return df
    if column is None or column not in df.columns:
        raise ValueError("a date range needs a bound date column")
    is_text = isinstance(df.schema[column].dataType, StringType)
    c = time_prefix(column, 10) if is_text else F.col(column)
    if start is not None:
        df = df.where(c >= (F.lit(start) if is_text else F.lit(start).cast(df.schema[column].dataType)))
    if end is not None:
        if is_text:
            df = df.where(c <= F.lit(end))
        else:
            after = F.date_add(F.lit(end).cast("date"), 1).cast(df.schema[column].dataType)
            df = df.where(c < after)
    return df


def drop_deleted(df: DataFrame, flag: str = "is_delete", keep_null: bool = True) -> DataFrame:
    """Drop soft-deleted rows; ``keep_null=False`` also drops rows without a flag."""
    text = F.col(flag).cast("string")
    return df.where(F.coalesce(text, F.lit("false")) != "true") if keep_null else df.where(text == "false")


def latest_snapshot(df: DataFrame, date: Column | str) -> DataFrame:
    """Rows whose date expression equals its maximum over the frame."""
    date = F.expr(date) if isinstance(date, str) else date
    return df.where(date == df.agg(F.max(date)).scalar())


def source_snapshot(
    spark: SparkSession, tables: list[str], key_columns: list[str], count_rows: bool = True
) -> DataFrame:
    """Per source table: existence, rows, column count, key columns present."""
    out = None
    for name in tables:
        exists = spark.catalog.tableExists(name)
        df = spark.table(name) if exists else None
        present = [c for c in key_columns if exists and c in df.columns]
        counts = (
            df.agg(F.count(F.lit(1)).alias("row_count"))
            if exists and count_rows
            else spark.range(1).select(F.lit(None).cast("long").alias("row_count"))
        )
        row = counts.select(
            F.lit(name).alias("table_name"),
            F.lit(exists).alias("exists"),
            "row_count",
            F.lit(len(df.columns) if exists else None).cast("int").alias("column_count"),
            F.lit(", ".join(present)).alias("key_columns_present"),
        )
        out = row if out is None else out.unionByName(row)
    return out


def candidate_rows(df: DataFrame, label: str, paths: list[str], keywords: list[str], key: str) -> DataFrame:
    """Rows with a key and either an explicit label or a keyword in any path text."""
    union = "|".join(sorted(set(keywords)))
    hit = non_blank(label)
    for path in paths:
        hit = hit | F.coalesce(F.col(path).cast("string").rlike(union), F.lit(False))
    return df.where(non_blank(key) & hit)
