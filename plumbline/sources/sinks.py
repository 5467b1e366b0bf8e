"""Writing result frames."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from plumbline.operators.ordered import cut, scratch_path
from plumbline.operators.skew import plan_partitions

#: bytes of an output file, about, and rows whose stored size is measured
FILE_BYTES, MEASURED_ROWS = 256 * 1024 * 1024, 20_000


def write_frame(df: DataFrame, path: str, fmt: str = "parquet", mode: str = "overwrite") -> None:
    """Write one frame as parquet, CSV with header, or JSON lines."""
    save(df.write.mode(mode), path, fmt)


def save(writer, path: str, fmt: str) -> None:
    if fmt == "csv":
        writer.option("header", True).csv(path)
    else:
        writer.format(fmt).save(path)


def row_bytes(df: DataFrame, rows: int, fmt: str = "parquet", measured: int = MEASURED_ROWS) -> float:
    """Stored bytes of a row, measured on a sample written to the shared folder; 1 for an empty frame."""
    spark = df.sparkSession
    fraction = min(1.0, measured / max(rows, 1))
    sample = cut(df.sample(fraction, 7)) if fraction < 1 else df
    path = scratch_path(spark)
    # one file, so that heads of many small ones do not count
    save(sample.repartition(1).write, path, fmt)
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    files = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    size, number = files.getContentSummary(where).getLength(), sample.count()
    files.delete(where, True)
    return size / number if number else 1.0


def write_sized(
    df: DataFrame, path: str, fmt: str = "parquet", mode: str = "overwrite", file_bytes: int = FILE_BYTES, by: list[str] | None = None
) -> dict[str, int]:
    """Write a frame in files of about ``file_bytes``, however its rows are spread; returns rows, rows a file and files planned.

    The stored size of a row is measured on a sample. Without ``by`` the rows
    are dealt evenly over as many tasks as files. With ``by`` the files lie in a
    folder per value; rows are rebalanced by those columns, so a value with most
    of the rows is split over tasks and small ones share one, and no file has
    more rows than fit. The frame is read more than once: pass one that is
    stored or cheap to compute.
    """
    rows = df.count()
    per_file = max(1, int(file_bytes / max(row_bytes(df, rows, fmt), 1e-9)))
    files = plan_partitions(rows, per_file)
    if by:
        dealt = df.hint("rebalance", files, *[F.col(f"`{c}`") for c in by])
        writer = dealt.write.mode(mode).partitionBy(*by)
    else:
        writer = df.repartition(files).write.mode(mode)
    save(writer.option("maxRecordsPerFile", per_file), path, fmt)
    return {"rows": rows, "rows_per_file": per_file, "files": files}


def write_bundle(frames: dict[str, DataFrame], folder: str, formats: tuple[str, ...] = ("csv", "json")) -> None:
    """Write every named frame in every format under ``folder/<format>/<name>``."""
    for name, df in frames.items():
        if len(formats) > 1:
            df = df.persist()
        for fmt in formats:
            write_frame(df, f"{folder}/{fmt}/{name}", fmt)
        if len(formats) > 1:
            df.unpersist()
