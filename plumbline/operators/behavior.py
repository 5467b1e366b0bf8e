"""User-behaviour analytics over event logs.

The input has ``user_id``, ``timestamp``, ``action``, ``duration``, ``feature``
and ``session_id`` (see ``sources.events.as_events``). Dates are compared with
an ``as_of`` day that is always a parameter.
"""

from __future__ import annotations

import datetime
import math
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from plumbline.functions.columns import count_if, ratio
from plumbline.functions.fixed import (
    ACTION_TEMPLATES,
    BENCHMARKS,
    CHURN_TARGETS,
    SEGMENT_ACTIVE,
    SEGMENT_KEEP,
    SEGMENT_RISK,
    SEGMENT_VALUE,
    SEGMENT_WIN_BACK,
)
from plumbline.operators.ordered import quantile_struct
from plumbline.sources.tables import constant_rows

HORIZONS = [1, 7, 30]


def _day(as_of: str) -> Column:
    return F.lit(as_of).cast("date")


def _until(events: DataFrame, as_of: str, days: int | None = None) -> DataFrame:
    """Events up to the end of the as-of day, and of the last ``days`` days only.

    Written on the time column itself, so the limits reach the file scan.
    """
    dtype = events.schema["timestamp"].dataType
    out = events.where(F.col("timestamp") < F.date_add(_day(as_of), 1).cast(dtype))
    if days is not None:
        out = out.where(F.col("timestamp") >= F.date_sub(_day(as_of), days - 1).cast(dtype))
    return out


def active_users(events: DataFrame, as_of: str, week: int = 7, month: int = 30) -> DataFrame:
    """Users active on the day, in the last week and month, with the stickiness ratios."""
    day = F.to_date("timestamp")
    per_user = _until(events, as_of, month).groupBy("user_id").agg(F.max(day).alias("last_day"))
    last = F.col("last_day")
    one = per_user.agg(
        count_if(last == _day(as_of)).alias("dau"),
        count_if(last > F.date_sub(_day(as_of), week)).alias("wau"),
        F.count(F.lit(1)).alias("mau"),
    )
    dau_wau, wau_mau = ratio(F.col("dau"), F.col("wau")), ratio(F.col("wau"), F.col("mau"))
    return one.select(
        F.lit(as_of).alias("as_of"),
        "dau",
        "wau",
        "mau",
        dau_wau.alias("dau_wau"),
        wau_mau.alias("wau_mau"),
        ratio(F.col("dau"), F.col("mau")).alias("dau_mau"),
        F.when(dau_wau > 0.2, "healthy").otherwise("low").alias("dau_wau_state"),
        F.when(wau_mau > 0.5, "healthy").otherwise("low").alias("wau_mau_state"),
    )


def user_days(events: DataFrame) -> DataFrame:
    """Distinct (user, day) with the first day of the user."""
    days = events.select("user_id", F.to_date("timestamp").alias("day")).distinct()
    return days.withColumn("cohort_day", F.min("day").over(Window.partitionBy("user_id")))


def retention(events: DataFrame, horizons: list[int] = HORIZONS, last_day: str | None = None) -> DataFrame:
    """Share of each first-day cohort that is active again exactly N days later.

    The rate is NULL when day + N lies after the last day of the data.
    """
    days = user_days(events)
    gap = F.datediff("day", "cohort_day")
    cohorts = days.groupBy("cohort_day").agg(
        count_if(gap == 0).alias("cohort_size"), *[count_if(gap == n).alias(f"r{n}") for n in horizons]
    )
    if last_day is not None:
        end = _day(last_day)
    else:
        end = events.agg(F.max(F.to_date("timestamp"))).scalar()
    rows = []
    for n in horizons:
        seen = F.date_add("cohort_day", n) <= F.col("_end")
        rows.append(
            F.struct(
                F.lit(n).alias("horizon"),
                F.when(seen, F.col(f"r{n}")).alias("retained"),
                F.when(seen, ratio(F.col(f"r{n}"), F.col("cohort_size"))).alias("retention_rate"),
            )
        )
    return cohorts.withColumn("_end", end).select("cohort_day", "cohort_size", F.inline(F.array(*rows)))


def retention_overall(cohorts: DataFrame) -> DataFrame:
    """Retention per horizon over all cohorts old enough for it."""
    seen = F.col("retained").isNotNull()
    out = cohorts.groupBy("horizon").agg(
        F.coalesce(F.sum(F.when(seen, F.col("cohort_size"))), F.lit(0)).alias("users"),
        F.coalesce(F.sum("retained"), F.lit(0)).alias("retained"),
    )
    return out.withColumn("retention_rate", ratio(F.col("retained"), F.col("users")))


def retention_availability(events: DataFrame, horizons: list[int] = HORIZONS) -> DataFrame:
    """Whether the time span of the data is long enough for each horizon."""
    day = F.to_date("timestamp")
    one = events.agg(F.datediff(F.max(day), F.min(day)).alias("span_days"))
    rows = []
    for n in horizons:
        ok = F.coalesce(F.col("span_days") >= n, F.lit(False))
        reason = F.when(ok, "").otherwise(f"time span below {n} days")
        rows.append(F.struct(F.lit(n).alias("horizon"), ok.alias("available"), reason.alias("reason")))
    return one.select("span_days", F.inline(F.array(*rows)))


# --- all days at once, from bitmaps ------------------------------------------

#: days in a word of a bitmap
WORD = 64


@dataclass
class DayBits:
    """``users`` (user_id, bits): a bitmap of each user's active days, in words of 64, the first of them ``first``."""

    users: DataFrame
    first: datetime.date
    days: int

    def last_index(self) -> int:
        return self.days - 1

    def is_set(self, index: Column) -> Column:
        """Whether the user was active on a day by its index; false outside the span."""
        index = F.coalesce(index, F.lit(-1))
        inside = (index >= 0) & (index < self.days)
        at = F.when(inside, index).otherwise(0)
        return inside & (F.getbit(F.get(F.col("bits"), F.floor(at / WORD).cast("int")), (at % WORD).cast("int")) == 1)

    def indexes(self) -> Column:
        """The active days of the user, rising."""
        words = F.sequence(F.lit(0), F.lit((self.days - 1) // WORD))
        bits = F.sequence(F.lit(0), F.lit(WORD - 1))

        def of_word(w: Column) -> Column:
            own = F.get(F.col("bits"), w)
            held = F.when(own == 0, F.array().cast("array<int>")).otherwise(F.filter(bits, lambda b: F.getbit(own, b) == 1))
            return F.transform(held, lambda b: w * WORD + b)

        return F.flatten(F.transform(words, of_word))


def day_bits(events: DataFrame, first: str | None = None, last: str | None = None) -> DayBits | None:
    """Bitmaps of the active days of every user, from one aggregation of the log.

    The span is that of the data unless it is given; events outside it, and rows
    without a time or user, are left out. A bitmap is some machine words per
    user whatever the number of events, and tasks merge them before the shuffle.
    None for a log without days.
    """
    day = F.to_date("timestamp")
    if first is None or last is None:
        low, high = events.agg(F.min(day), F.max(day)).first()
        first, last = first or low, last or high
    if first is None or last is None:
        return None
    first, last = (d if isinstance(d, datetime.date) else datetime.date.fromisoformat(d) for d in (first, last))
    days = (last - first).days + 1
    if days < 1:
        raise ValueError("the span ends before it begins")
    index = F.datediff(day, F.lit(first))
    inside = _until(events, last.isoformat(), days).where(F.col("user_id").isNotNull())
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), (index % WORD).cast("int"))
    words = [F.bit_or(F.when(F.floor(index / WORD) == w, bit).otherwise(F.lit(0).cast("long"))).alias(f"w{w}") for w in range((days - 1) // WORD + 1)]
    merged = inside.select("user_id", "timestamp").groupBy("user_id").agg(*words)
    return DayBits(merged.select("user_id", F.array(*[f"w{w}" for w in range(len(words))]).alias("bits")), first, days)


def activity_series(bits: DayBits, week: int = 7, month: int = 30) -> DataFrame:
    """(day, dau, wau, mau, dau_wau, wau_mau, dau_mau) for every day of the span.

    An active day makes its user count in a window of n days from that day on,
    until n days later or the next active day: two changes per day and window,
    summed per day and then along the days.
    """
    spans = {"dau": 1, "wau": week, "mau": month}
    each = bits.users.select(bits.indexes().alias("at"))
    pairs = F.transform("at", lambda d, i: F.struct(d.alias("day"), F.get(F.col("at"), i + 1).alias("next")))
    pairs = each.select(F.inline(pairs))

    def change(name: str, n: int) -> list[Column]:
        end = F.least(F.col("day") + n, F.coalesce("next", F.col("day") + n))
        zero, one = [F.lit(0).cast("long"), F.lit(1).cast("long")]
        return [
            F.struct(at.cast("int").alias("index"), *[(sign if k == name else zero).alias(k) for k in spans])
            for at, sign in ((F.col("day"), one), (end, -one))
        ]

    changes = pairs.select(F.inline(F.array(*[c for name, n in spans.items() for c in change(name, n)]))).where(F.col("index") < bits.days)
    summed = changes.groupBy("index").agg(*[F.sum(k).alias(k) for k in spans])
    every = bits.users.sparkSession.range(bits.days).select(F.col("id").cast("int").alias("index"))
    # one row per day of the span
    along = Window.partitionBy(F.lit(1)).orderBy("index").rowsBetween(Window.unboundedPreceding, 0)
    days = every.join(summed, "index", "left").select("index", *[F.sum(F.coalesce(k, F.lit(0))).over(along).cast("long").alias(k) for k in spans])
    return days.select(
        F.date_add(F.lit(bits.first), F.col("index")).alias("day"),
        *spans,
        ratio(F.col("dau"), F.col("wau")).alias("dau_wau"),
        ratio(F.col("wau"), F.col("mau")).alias("wau_mau"),
        ratio(F.col("dau"), F.col("mau")).alias("dau_mau"),
    )


def retention_curves(bits: DayBits, horizons: list[int] = HORIZONS) -> DataFrame:
    """Retention of each first-day cohort for any number of horizons, as ``retention`` gives it, from the bitmaps alone."""
    first = F.array_min(bits.indexes())
    users = bits.users.select("bits", first.alias("first")).where("first is not null")
    kept = F.array(*[bits.is_set(F.col("first") + n).cast("long") for n in horizons])
    cohorts = users.select("first", *[F.get(kept, F.lit(i)).alias(f"r{i}") for i in range(len(horizons))]).groupBy("first").agg(
        F.count(F.lit(1)).alias("cohort_size"), *[F.sum(f"r{i}").alias(f"r{i}") for i in range(len(horizons))]
    )
    rows = []
    for i, n in enumerate(horizons):
        seen = F.col("first") + n <= bits.last_index()
        rows.append(
            F.struct(
                F.lit(n).alias("horizon"), F.when(seen, F.col(f"r{i}")).alias("retained"),
                F.when(seen, ratio(F.col(f"r{i}"), F.col("cohort_size"))).alias("retention_rate"),
            )
        )
    return cohorts.select(F.date_add(F.lit(bits.first), F.col("first")).alias("cohort_day"), "cohort_size", F.inline(F.array(*rows)))


def session_stats(events: DataFrame, session: str = "session_id") -> DataFrame:
    """Sessions and their mean length."""
    per_session = events.where(F.col(session).isNotNull()).groupBy(session).agg(
        F.sum("duration").cast("double").alias("length")
    )
    return per_session.agg(
        F.count(F.lit(1)).alias("sessions"), F.round(F.avg("length"), 4).alias("avg_session_duration")
    )


def peak_hours(events: DataFrame, n: int | None = None) -> DataFrame:
    """Events and rank of every hour of the day."""
    counts = events.groupBy(F.hour("timestamp").alias("hour")).agg(F.count(F.lit(1)).alias("events"))
    w = Window.partitionBy(F.lit(1)).orderBy(F.desc("events"), F.asc("hour"))
    ranked = counts.withColumn("rank", F.row_number().over(w))
    return ranked.where(F.col("rank") <= n) if n else ranked


# --- value segments ----------------------------------------------------------


def rfm_base(events: DataFrame, as_of: str, monetary: str = "duration") -> DataFrame:
    """Days since the last event, number of events and amount per user."""
    return _until(events, as_of).groupBy("user_id").agg(
        F.datediff(_day(as_of), F.max(F.to_date("timestamp"))).alias("recency"),
        F.count(F.lit(1)).alias("frequency"),
        F.round(F.sum(F.coalesce(F.col(monetary), F.lit(0))).cast("double"), 6).alias("monetary"),
    )


QUINTILES = [0.2, 0.4, 0.6, 0.8]


def rfm_scores(base: DataFrame, exact: bool = True) -> DataFrame:
    """Scores 1-5 by quintile; recency is reversed."""
    cuts = quantile_struct(base, ["recency", "frequency", "monetary"], QUINTILES, exact)
    work = base.withColumn("_q", cuts)

    def q(i: int, k: int) -> Column:
        return F.col("_q")[f"c{i}"][k]

    def low_is_good(v: Column, i: int) -> Column:
        return (
            F.when(v <= q(i, 0), 5).when(v <= q(i, 1), 4).when(v <= q(i, 2), 3).when(v <= q(i, 3), 2).otherwise(1)
        )

    def high_is_good(v: Column, i: int) -> Column:
        return (
            F.when(v >= q(i, 3), 5).when(v >= q(i, 2), 4).when(v >= q(i, 1), 3).when(v >= q(i, 0), 2).otherwise(1)
        )

    return work.withColumns(
        {
            "r_score": low_is_good(F.col("recency"), 0),
            "f_score": high_is_good(F.col("frequency"), 1),
            "m_score": high_is_good(F.col("monetary"), 2),
        }
    ).drop("_q")


def rfm_segment(method: str = "tree") -> Column:
    """Segment from the three scores: the decision tree, or the rule matrix read top-down."""
    r, f, m = F.col("r_score"), F.col("f_score"), F.col("m_score")
    if method == "matrix":
        return (
            F.when((r >= 4) & (f >= 4) & (m >= 4), SEGMENT_VALUE)
            .when((r >= 4) & (f >= 4), SEGMENT_KEEP)
            .when((r <= 2) & (f >= 4) & (m >= 4), SEGMENT_WIN_BACK)
            .when(r >= 3, SEGMENT_ACTIVE)
            .otherwise(SEGMENT_RISK)
        )
    if method != "tree":
        raise ValueError("method is 'tree' or 'matrix'")
    return (
        F.when((r >= 4) & (f >= 4) & (m >= 4), SEGMENT_VALUE)
        .when((r >= 4) & (f >= 4), SEGMENT_KEEP)
        .when(r >= 4, SEGMENT_ACTIVE)
        .when((f >= 4) & (m >= 4), SEGMENT_WIN_BACK)
        .otherwise(SEGMENT_RISK)
    )


def rfm_segments(base: DataFrame, method: str = "tree", exact: bool = True) -> DataFrame:
    return rfm_scores(base, exact).withColumn("segment", rfm_segment(method))


def segment_profile(segments: DataFrame) -> DataFrame:
    """Users, share and mean recency, frequency and amount per segment."""
    out = segments.groupBy("segment").agg(
        F.count(F.lit(1)).alias("users"),
        F.round(F.avg("recency"), 4).alias("avg_recency"),
        F.round(F.avg("frequency"), 4).alias("avg_frequency"),
        F.round(F.avg("monetary"), 4).alias("avg_monetary"),
    )
    everyone = F.sum("users").over(Window.partitionBy(F.lit(1)))  # at most five rows
    return out.withColumn("user_share", ratio(F.col("users"), everyone))


# --- features ----------------------------------------------------------------


def feature_penetration(events: DataFrame, cold_below: float = 0.05) -> DataFrame:
    """Users, uses, mean duration and penetration per feature; cold below the limit."""
    stats = events.where(F.col("feature").isNotNull()).groupBy("feature", "user_id").agg(
        F.count(F.lit(1)).alias("n"), F.sum("duration").alias("d"), F.count("duration").alias("dn")
    )
    users = events.select("user_id").distinct().agg(F.count(F.lit(1))).scalar()
    out = stats.groupBy("feature").agg(
        F.count(F.lit(1)).alias("users"),
        F.sum("n").alias("uses"),
        F.round(F.try_divide(F.sum("d").cast("double"), F.sum("dn").cast("double")), 4).alias("avg_duration"),
    )
    share = ratio(F.col("users"), users)
    return out.withColumns({"penetration": share, "is_cold": share < cold_below})


def feature_co_use(events: DataFrame) -> DataFrame:
    """Share of the users of feature A who also use feature B.

    Users with the same set of features are counted together, and pairs are
    formed once per set, not per user. A set is bounded by the number of
    features a product has.
    """
    per_user = events.where(F.col("feature").isNotNull()).groupBy("user_id").agg(
        F.array_sort(F.collect_set("feature")).alias("features")
    )
    sets = per_user.groupBy("features").agg(F.count(F.lit(1)).alias("n"))
    pairs = sets.select("features", "n", F.explode("features").alias("feature_a")).select(
        "feature_a", F.explode("features").alias("feature_b"), "n"
    )
    both = pairs.groupBy("feature_a", "feature_b").agg(F.sum("n").alias("both_users"))
    own = F.max(F.when(F.col("feature_a") == F.col("feature_b"), F.col("both_users")))
    out = both.withColumn("users_a", own.over(Window.partitionBy("feature_a")))
    return out.where("feature_a <> feature_b").withColumn(
        "co_use_share", ratio(F.col("both_users"), F.col("users_a"))
    )


# --- churn -------------------------------------------------------------------


def churn_scores(
    events: DataFrame, as_of: str, threshold_days: int = 7, window_days: int = 30, full_set: int = 3
) -> DataFrame:
    """Weighted churn risk per user from recency, activity drop, duration drop, diversity.

    Compares the last ``window_days`` with the same span before; a drop counts
    only beyond one half, and counts as none when there was nothing before.
    """
    day = F.to_date("timestamp")
    age = F.datediff(_day(as_of), day)
    recent = age < window_days
    previous = (age >= window_days) & (age < 2 * window_days)
    duration = F.coalesce(F.col("duration"), F.lit(0)).cast("double")
    per_user = _until(events, as_of).groupBy("user_id").agg(
        F.datediff(_day(as_of), F.max(day)).alias("days_since_last"),
        count_if(recent).alias("recent_count"),
        count_if(previous).alias("previous_count"),
        F.round(F.sum(F.when(recent, duration).otherwise(0.0)), 6).alias("recent_duration"),
        F.round(F.sum(F.when(previous, duration).otherwise(0.0)), 6).alias("previous_duration"),
        F.count_distinct("feature").alias("unique_features"),
    )

    def drop(now: str, before: str) -> Column:
        change = F.try_divide(F.col(now) - F.col(before), F.col(before))
        return F.when((F.col(before) > 0) & (change < -0.5), F.least(F.lit(1.0), F.abs(change))).otherwise(0.0)

    since, features = F.col("days_since_last"), F.col("unique_features")
    scored = per_user.withColumns(
        {
            "recency_factor": F.when(since >= threshold_days, 1.0).otherwise(since / F.lit(float(threshold_days))),
            "count_factor": drop("recent_count", "previous_count"),
            "duration_factor": drop("recent_duration", "previous_duration"),
            "diversity_factor": F.when(features < full_set, (full_set - features) / F.lit(float(full_set))).otherwise(0.0),
        }
    )
    score = (
        F.col("recency_factor") * 0.4
        + F.col("count_factor") * 0.3
        + F.col("duration_factor") * 0.2
        + F.col("diversity_factor") * 0.1
    )
    return scored.withColumn("risk_score", F.round(score, 4)).withColumn("risk_level", risk_level("risk_score"))


FACTORS = ["recency_factor", "count_factor", "duration_factor", "diversity_factor"]


def risk_level(score: str) -> Column:
    return F.when(F.col(score) >= 0.6, "high").when(F.col(score) >= 0.3, "medium").otherwise("low")


def risk_distribution(scores: DataFrame) -> DataFrame:
    out = scores.groupBy("risk_level").agg(F.count(F.lit(1)).alias("users"))
    everyone = F.sum("users").over(Window.partitionBy(F.lit(1)))  # at most three rows
    return out.withColumn("user_share", ratio(F.col("users"), everyone))


def factor_prevalence(scores: DataFrame) -> DataFrame:
    """Share of users hit by each factor."""
    one = scores.agg(F.count(F.lit(1)).alias("n"), *[count_if(F.col(f) > 0).alias(f) for f in FACTORS])
    rows = [
        F.struct(F.lit(f).alias("factor"), F.col(f).alias("users"), ratio(F.col(f), F.col("n")).alias("user_share"))
        for f in FACTORS
    ]
    return one.select(F.inline(F.array(*rows)))


def observed_churn(events: DataFrame, as_of: str, days: int) -> DataFrame:
    """Users seen up to the as-of day, and whether they stay away for the days after it."""
    day = F.to_date("timestamp")
    after = (day > _day(as_of)) & (day <= F.date_add(_day(as_of), days))
    per_user = events.groupBy("user_id").agg(
        F.min(day).alias("first_day"), F.coalesce(F.bool_or(after), F.lit(False)).alias("came_back")
    )
    return per_user.where(F.col("first_day") <= _day(as_of)).select(
        "user_id", (~F.col("came_back")).alias("churned")
    )


def classifier_evaluation(labelled: DataFrame, predicted: str, actual: str) -> DataFrame:
    """Accuracy, recall, precision and F1 of a churn prediction, against the targets."""
    p, a = F.col(predicted), F.col(actual)
    one = labelled.agg(
        F.count(F.lit(1)).cast("double").alias("n"),
        count_if(p & a).cast("double").alias("tp"),
        count_if(p & ~a).cast("double").alias("fp"),
        count_if(~p & a).cast("double").alias("fn"),
        count_if(~p & ~a).cast("double").alias("tn"),
    )
    tp, fp, fn, tn = (F.col(c) for c in ("tp", "fp", "fn", "tn"))
    values = {
        "accuracy": F.try_divide(tp + tn, F.col("n")),
        "recall": F.try_divide(tp, tp + fn),
        "precision": F.try_divide(tp, tp + fp),
        "f1": F.try_divide(2.0 * tp, 2.0 * tp + fp + fn),
    }
    rows = []
    for name, v in values.items():
        target = CHURN_TARGETS[name]
        rows.append(
            F.struct(
                F.lit(name).alias("metric"),
                F.round(v, 6).alias("value"),
                F.lit(target).alias("target"),
                F.coalesce(v >= target, F.lit(False)).alias("met"),
            )
        )
    return one.select(F.inline(F.array(*rows)))


# --- insights ----------------------------------------------------------------

INSIGHT_COLUMNS = ["kind", "subject", "severity", "evidence", "confidence"]


def _insight(kind: str, subject, severity, evidence, confidence) -> list[Column]:
    values = [kind, subject, severity, evidence, confidence]
    columns = [v if isinstance(v, Column) else F.lit(v) for v in values]
    types = ["string", "string", "string", "double", "double"]
    return [c.cast(t).alias(n) for c, t, n in zip(columns, types, INSIGHT_COLUMNS)]


def trend_insights(overall: DataFrame, benchmarks: dict[int, float]) -> DataFrame:
    """Gap between the industry benchmark and the retention of each horizon."""
    bench = F.lit(None).cast("double")
    for n, value in benchmarks.items():
        bench = F.when(F.col("horizon") == n, F.lit(float(value))).otherwise(bench)
    gap = F.round(bench - F.col("retention_rate"), 6)
    severity = F.when(gap > 0.20, "high").when(gap > 0.10, "medium").otherwise("low")
    subject = F.concat(F.lit("retention_d"), F.col("horizon").cast("string"))
    known = overall.where(F.col("retention_rate").isNotNull() & bench.isNotNull())
    return known.select(*_insight("trend", subject, severity, gap, 0.95))


def churn_rate(scores: DataFrame) -> DataFrame:
    """Share of users with high risk, as one row."""
    return scores.agg(
        ratio(count_if(F.col("risk_level") == "high"), F.count(F.lit(1))).alias("churn_rate")
    )


def anomaly_insights(rate: DataFrame, confidence: float) -> DataFrame:
    """An insight when the churn rate passes 5, 10 or 15 percent."""
    c = F.col("churn_rate")
    severity = F.when(c > 0.15, "critical").when(c > 0.10, "high").when(c > 0.05, "medium")
    return rate.where(c > 0.05).select(*_insight("anomaly", "churn_rate", severity, c, confidence))


def two_sided_p(z: Column | str) -> Column:
    """Two-sided normal p-value of a z score; meant for one row per feature."""

    @F.pandas_udf("double")
    def p_value(scores: pd.Series) -> pd.Series:
        return scores.map(lambda v: None if v is None or v != v else math.erfc(abs(v) / math.sqrt(2.0)))

    return p_value(z)


def feature_lift(events: DataFrame, user_flags: DataFrame, flag: str = "retained") -> DataFrame:
    """Retention of users with and without each feature, lift and z score.

    ``user_flags`` has one row per user. The z score is that of two proportions
    with pooled variance.
    """
    pairs = events.where(F.col("feature").isNotNull()).select("user_id", "feature").distinct()
    joined = pairs.join(user_flags.select("user_id", F.col(flag).alias("_f")), "user_id")
    with_it = joined.groupBy("feature").agg(
        F.count(F.lit(1)).alias("users_with"), count_if(F.col("_f")).alias("retained_with")
    )
    everyone = user_flags.agg(
        F.struct(F.count(F.lit(1)).alias("n"), count_if(F.col(flag)).alias("k")).alias("a")
    ).scalar()
    work = with_it.withColumn("_a", everyone).withColumns(
        {
            "users_without": F.col("_a.n") - F.col("users_with"),
            "retained_without": F.col("_a.k") - F.col("retained_with"),
        }
    )
    n1, n0 = F.col("users_with").cast("double"), F.col("users_without").cast("double")
    p1, p0 = F.try_divide(F.col("retained_with"), n1), F.try_divide(F.col("retained_without"), n0)
    pooled = F.try_divide(F.col("_a.k").cast("double"), F.col("_a.n").cast("double"))
    spread = F.sqrt(pooled * (1.0 - pooled) * (F.try_divide(F.lit(1.0), n1) + F.try_divide(F.lit(1.0), n0)))
    return work.select(
        "feature",
        "users_with",
        "users_without",
        F.round(p1, 6).alias("retention_with"),
        F.round(p0, 6).alias("retention_without"),
        F.round(F.try_divide(p1, p0), 6).alias("lift"),
        F.round(F.try_divide(p1 - p0, spread), 6).alias("z_score"),
    )


def pattern_insights(lift: DataFrame, min_lift: float = 1.5, max_p: float = 0.01) -> DataFrame:
    """Features whose users are kept clearly more often."""
    tested = lift.withColumn("p_value", two_sided_p("z_score"))
    hits = tested.where((F.col("lift") > min_lift) & (F.col("p_value") < max_p))
    return hits.select(*_insight("pattern", F.col("feature"), "medium", F.col("lift"), 1.0 - F.col("p_value")))


def opportunity_insights(profile: DataFrame, excellent_share: float) -> DataFrame:
    """Room for more customers of the best segment, when more than five points are missing."""
    vip = profile.agg(
        F.coalesce(F.max(F.when(F.col("segment") == SEGMENT_VALUE, F.col("user_share"))), F.lit(0.0)).alias("vip")
    )
    gap = F.round(F.lit(float(excellent_share)) - F.col("vip"), 6)
    return vip.where(gap > 0.05).select(
        *_insight("opportunity", "vip_share", "medium", gap, F.lit(None)), F.round(gap * 2, 6).alias("impact_score")
    )


def action_triggers(kpis: DataFrame) -> DataFrame:
    """Recommended actions for one row of ``churn_rate``, ``day7_retention``, ``cold_features``."""
    fired = {
        "churn_win_back": F.col("churn_rate") > 0.10,
        "retention_onboarding": F.col("day7_retention") < 0.50,
        "cold_feature_review": F.col("cold_features") >= 3,
    }
    names = ["action_code", "priority", "action", "kpi", "timeline", "owner"]
    rows = [
        F.when(fired[t[0]], F.struct(*[F.lit(v).alias(n) for n, v in zip(names, t)])) for t in ACTION_TEMPLATES
    ]
    return kpis.select(F.inline(F.array_compact(F.array(*rows))))


def benchmark_comparison(kpis: DataFrame, industry: str, benchmarks=BENCHMARKS) -> DataFrame:
    """KPI rows (metric, value in percent) against the industry range."""
    rows = [b for b in benchmarks if b[1] == industry]
    ranges = constant_rows(kpis.sparkSession, rows, "metric string, industry string, low double, high double")
    v = F.col("value")
    position = F.when(v < F.col("low"), "below").when(v > F.col("high"), "above").otherwise("in_range")
    return kpis.join(F.broadcast(ranges), "metric").withColumn("position", F.when(v.isNotNull(), position))
