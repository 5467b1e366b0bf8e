"""The behaviour protocol: quality gate, preprocessing, chosen analyses, insights."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from plumbline.functions.fixed import BENCHMARKS, SCENARIO_CHURN_DAYS
from plumbline.operators import behavior, quality
from plumbline.sources.events import MAX_DURATION_MS, preprocess, preprocess_summary

DIMENSIONS = ["activity", "rfm", "features", "churn"]


def run(
    events: DataFrame,
    as_of: str,
    industry: str = "B2B SaaS",
    dimensions: list[str] | None = None,
    churn_days: int | None = None,
    window_days: int = 30,
    min_records: int = 100,
    threshold: float = 70.0,
    max_duration: float = MAX_DURATION_MS,
    excellent_vip_share: float = 0.15,
) -> dict[str, DataFrame]:
    """Named lazy frames of the requested analyses.

    The quality score is the one value fetched first: below the threshold, or
    with too few records, only the quality frames are returned.
    """
    dimensions = dimensions or DIMENSIONS
    score = quality.quality_score(
        events, ["user_id", "timestamp"], "timestamp", "duration", as_of, max_measure=float(max_duration), threshold=threshold
    )
    out = {"quality_score": score}
    gate = score.select("record_count", "status").first()
    if gate["record_count"] < min_records or gate["status"] != "pass":
        return out
    clean = preprocess(events, max_duration)
    out["preprocess_summary"] = preprocess_summary(events, max_duration)
    days = churn_days or SCENARIO_CHURN_DAYS.get(industry, 7)
    cap = float(score.select(quality.confidence_cap(F.col("record_count"))).first()[0] or 0.0)
    if "activity" in dimensions:
        out["active_users"] = behavior.active_users(clean, as_of)
        out["retention"] = behavior.retention(clean)
        out["retention_overall"] = behavior.retention_overall(out["retention"])
        out["retention_availability"] = behavior.retention_availability(clean)
        out["session_stats"] = behavior.session_stats(clean)
        out["peak_hours"] = behavior.peak_hours(clean)
        lows = {m: low for m, i, low, _ in BENCHMARKS if i == industry}
        targets = {n: lows[f"retention_d{n}"] / 100.0 for n in behavior.HORIZONS if f"retention_d{n}" in lows}
        out["trend_insights"] = behavior.trend_insights(out["retention_overall"], targets)
    if "rfm" in dimensions:
        out["rfm_segments"] = behavior.rfm_segments(behavior.rfm_base(clean, as_of))
        out["segment_profile"] = behavior.segment_profile(out["rfm_segments"])
        out["opportunity_insights"] = behavior.opportunity_insights(out["segment_profile"], excellent_vip_share)
    if "features" in dimensions:
        out["feature_penetration"] = behavior.feature_penetration(clean)
        out["feature_co_use"] = behavior.feature_co_use(clean)
        # kept are users that came back on a day after their first
        day = F.to_date("timestamp")
        kept = clean.groupBy("user_id").agg((F.max(day) > F.min(day)).alias("retained"))
        out["feature_lift"] = behavior.feature_lift(clean, kept)
        out["pattern_insights"] = behavior.pattern_insights(out["feature_lift"])
    if "churn" in dimensions:
        out["churn_scores"] = behavior.churn_scores(clean, as_of, days, window_days)
        out["risk_distribution"] = behavior.risk_distribution(out["churn_scores"])
        out["factor_prevalence"] = behavior.factor_prevalence(out["churn_scores"])
        out["anomaly_insights"] = behavior.anomaly_insights(behavior.churn_rate(out["churn_scores"]), cap)
    if {"activity", "features", "churn"} <= set(dimensions):
        day7 = out["retention_overall"].where("horizon = 7").agg(F.max("retention_rate"))
        cold = out["feature_penetration"].agg(F.count_if("is_cold"))
        kpis = behavior.churn_rate(out["churn_scores"]).select(
            "churn_rate", day7.scalar().alias("day7_retention"), cold.scalar().alias("cold_features")
        )
        out["actions"] = behavior.action_triggers(kpis)
    return out
