"""Event logs and earlier reports as sources."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

EVENT_SCHEMA = (
    "user_id string, timestamp timestamp, action string, duration long, "
    "feature string, device string, session_id string"
)

MAX_DURATION_MS = 24 * 60 * 60 * 1000


def read_events(spark: SparkSession, path: str, fmt: str = "jsonl") -> DataFrame:
    """Event log from JSON lines, CSV, parquet, or (``json``) files that each hold one array.

    A file with an array is read by one task; large logs come as lines.
    """
    if fmt == "parquet":
        return spark.read.parquet(path)
    reader = spark.read.schema(EVENT_SCHEMA)
    if fmt == "csv":
        return reader.csv(path, header=True)
    if fmt == "jsonl":
        return reader.json(path)
    return reader.option("multiLine", True).json(path)


def read_report_detail(spark: SparkSession, path: str, detail: str = "detail") -> DataFrame:
    """Rows of the detail array of an earlier JSON report."""
    report = spark.read.option("multiLine", True).json(path)
    return report.select(F.inline(F.col(detail)))


def as_events(
    df: DataFrame,
    user: str = "user_id",
    time: str = "timestamp",
    action: str | None = "action",
    duration: str | None = "duration",
    feature: str | None = "feature",
    session: str | None = "session_id",
) -> DataFrame:
    """Bind the columns of any table to the event-log names."""

    def bound(name: str | None, dtype: str):
        return F.col(name).cast(dtype) if name in df.columns else F.lit(None).cast(dtype)

    time_type = df.schema[time].dataType.simpleString()
    return df.select(
        F.col(user).cast("string").alias("user_id"),
        (F.col(time) if time_type.startswith("timestamp") else F.col(time).cast("timestamp")).alias("timestamp"),
        bound(action, "string").alias("action"),
        (F.col(duration) if duration in df.columns else F.lit(None).cast("long")).alias("duration"),
        bound(feature, "string").alias("feature"),
        bound(session, "string").alias("session_id"),
    )


def preprocess(events: DataFrame, max_duration: float = MAX_DURATION_MS) -> DataFrame:
    """Drop rows without user, clamp durations, lower-case actions."""
    kind = events.schema["duration"].dataType
    clamped = F.least(F.greatest(F.col("duration"), F.lit(0).cast(kind)), F.lit(max_duration).cast(kind))
    return events.where(F.nullif(F.trim("user_id"), F.lit("")).isNotNull()).withColumns(
        {
            "duration": F.when(F.col("duration").isNotNull(), clamped),
            "action": F.lower("action"),
        }
    )


def preprocess_summary(events: DataFrame, max_duration: float = MAX_DURATION_MS) -> DataFrame:
    """What preprocessing drops, clamps and normalises, in one pass."""
    no_user = F.coalesce(F.trim("user_id"), F.lit("")) == ""
    return events.agg(
        F.count(F.lit(1)).alias("total_records"),
        F.count_if(no_user).alias("dropped_no_user"),
        F.count_if(~no_user & (F.col("duration") < 0)).alias("clamped_negative"),
        F.count_if(~no_user & (F.col("duration") > max_duration)).alias("clamped_too_long"),
        F.count_if(~no_user & (F.lower("action") != F.col("action"))).alias("lowercased_actions"),
        F.count_if(~no_user).alias("kept_records"),
    )
