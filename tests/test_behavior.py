"""Behaviour analytics on a small hand-made event log with values worked out by hand."""

import datetime
import math
import random

import pytest
from pyspark.sql import functions as F

from plumbline.functions.fixed import SEGMENT_ACTIVE, SEGMENT_KEEP, SEGMENT_RISK, SEGMENT_VALUE, SEGMENT_WIN_BACK
from plumbline.operators import behavior
from plumbline.plans import behavior_run
from plumbline.sources.events import EVENT_SCHEMA, as_events, preprocess, preprocess_summary, read_events

AS_OF = "2024-03-31"
LOG = [
    # user, time, duration, feature, session
    ("ann", "2024-03-31 09:00:00", 100, "home", "a1"),
    ("ann", "2024-03-30 09:00:00", 200, "docs", "a0"),
    ("ann", "2024-03-30 10:00:00", 300, "chat", "a0"),
    ("bob", "2024-03-21 08:00:00", 50, "home", "b1"),
    ("bob", "2024-02-20 08:00:00", 400, "home", "b0"),
    ("bob", "2024-02-19 08:00:00", 100, "home", "b0"),
    ("bob", "2024-02-18 08:00:00", 100, "docs", "b0"),
    ("cat", "2024-02-05 08:00:00", 10, "home", "c0"),
    ("cat", "2024-02-06 08:00:00", 10, "docs", "c1"),
    ("cat", "2024-02-06 09:00:00", 10, "chat", "c1"),
]


@pytest.fixture(scope="module")
def events(spark):
    raw = spark.createDataFrame([(u, t, "VIEW", d, f, s) for u, t, d, f, s in LOG], "user_id string, timestamp string, action string, duration long, feature string, session_id string")
    return as_events(raw)


def test_active_users(events):
    got = behavior.active_users(events, AS_OF).first()
    assert (got.dau, got.wau, got.mau, got.dau_wau, got.wau_mau) == (1, 1, 2, 1.0, 0.5)
    assert (got.dau_wau_state, got.wau_mau_state) == ("healthy", "low")
    none = behavior.active_users(events, "2023-01-01").first()
    assert (none.dau, none.dau_wau) == (0, None)


def test_retention_and_availability(events):
    got = {(str(r.cohort_day), r.horizon): (r.retained, r.retention_rate) for r in behavior.retention(events).collect()}
    assert got[("2024-03-30", 1)] == (1, 1.0) and got[("2024-03-30", 7)] == (None, None)
    assert got[("2024-02-18", 1)] == (1, 1.0) and got[("2024-02-18", 30)] == (0, 0.0)
    assert got[("2024-02-05", 1)] == (1, 1.0)
    total = {r.horizon: (r.users, r.retained) for r in behavior.retention_overall(behavior.retention(events)).collect()}
    assert total == {1: (3, 3), 7: (2, 0), 30: (2, 0)}
    ok = {r.horizon: r.available for r in behavior.retention_availability(events.where("user_id = 'bob'")).collect()}
    assert ok == {1: True, 7: True, 30: True}
    short = {r.horizon: r.reason for r in behavior.retention_availability(events.where("user_id = 'cat'")).collect()}
    assert short[1] == "" and short[7] == "time span below 7 days"


def test_sessions_and_hours(events, by):
    got = behavior.session_stats(events).first()
    assert (got.sessions, got.avg_session_duration) == (6, round(1280 / 6, 4))
    assert [(r.hour, r.events) for r in behavior.peak_hours(events, 1).collect()] == [(8, 6)]
    ranks = by(behavior.peak_hours(events), "hour")
    assert ranks[8]["rank"] == 1 and ranks[8]["events"] == 6


def test_churn_factors(events, by):
    got = by(behavior.churn_scores(events, AS_OF), "user_id")
    ann, bob, cat = got["ann"], got["bob"], got["cat"]
    assert (ann["days_since_last"], ann["risk_score"], ann["risk_level"]) == (0, 0.0, "low")
    # bob: 10 days away; 1 against 3 events and 50 against 600 ms; two features
    assert bob["recency_factor"] == 1.0 and bob["count_factor"] == pytest.approx(2 / 3)
    assert bob["duration_factor"] == pytest.approx(550 / 600) and bob["diversity_factor"] == pytest.approx(1 / 3)
    assert bob["risk_score"] == round(0.4 + 0.3 * 2 / 3 + 0.2 * 550 / 600 + 0.1 / 3, 4) and bob["risk_level"] == "high"
    # cat: nothing recent, three events 54 and 55 days ago
    assert (cat["count_factor"], cat["duration_factor"], cat["risk_score"]) == (1.0, 1.0, 0.9)
    spread = by(behavior.factor_prevalence(behavior.churn_scores(events, AS_OF)), "factor")
    assert spread["recency_factor"]["users"] == 2 and spread["diversity_factor"]["user_share"] == round(1 / 3, 6)


def test_drop_needs_more_than_half(spark):
    rows = [("u", "2024-03-30 00:00:00", 1, "f", "s"), ("u", "2024-02-20 00:00:00", 1, "f", "s"), ("u", "2024-02-21 00:00:00", 1, "f", "s")]
    df = as_events(spark.createDataFrame(rows, "user_id string, timestamp string, duration long, feature string, session_id string"))
    got = behavior.churn_scores(df, AS_OF).first()
    assert (got.count_factor, got.recency_factor) == (0.0, pytest.approx(1 / 7))


def test_rfm_scores_and_segments(spark, by):
    users = [(f"u{i}", i, 10 - i, float(i * 10)) for i in range(1, 10)]
    base = spark.createDataFrame(users, "user_id string, recency int, frequency long, monetary double")
    got = by(behavior.rfm_scores(base), "user_id")
    cuts = {p: 1 + 8 * p for p in (0.2, 0.4, 0.6, 0.8)}  # 2.6, 4.2, 5.8, 7.4

    def high(v, scale=1.0):
        return 1 + sum(v >= scale * c for c in cuts.values())

    for name, r, f, m in users:
        row = got[name]
        assert row["r_score"] == 1 + sum(r <= c for c in cuts.values())
        assert (row["f_score"], row["m_score"]) == (high(f), high(m, 10.0))
    approx = by(behavior.rfm_scores(base, exact=False), "user_id")
    assert set(approx) == set(got)


def test_segment_methods_differ_for_middle_recency(spark):
    combos = [(5, 5, 5), (5, 5, 1), (5, 1, 1), (3, 5, 5), (1, 5, 5), (3, 1, 1), (1, 1, 1)]
    df = spark.createDataFrame(combos, "r_score int, f_score int, m_score int")
    tree = [r[0] for r in df.select(behavior.rfm_segment("tree")).collect()]
    matrix = [r[0] for r in df.select(behavior.rfm_segment("matrix")).collect()]
    assert tree == [SEGMENT_VALUE, SEGMENT_KEEP, SEGMENT_ACTIVE, SEGMENT_WIN_BACK, SEGMENT_WIN_BACK, SEGMENT_RISK, SEGMENT_RISK]
    assert matrix == [SEGMENT_VALUE, SEGMENT_KEEP, SEGMENT_ACTIVE, SEGMENT_ACTIVE, SEGMENT_WIN_BACK, SEGMENT_ACTIVE, SEGMENT_RISK]
    with pytest.raises(ValueError):
        behavior.rfm_segment("other")


def test_features(events, by):
    got = by(behavior.feature_penetration(events), "feature")
    assert (got["chat"]["users"], got["chat"]["penetration"], got["chat"]["avg_duration"]) == (2, 0.666667, 155.0)
    pairs = {(r.feature_a, r.feature_b): r.co_use_share for r in behavior.feature_co_use(events).collect()}
    assert pairs[("chat", "docs")] == 1.0 and pairs[("home", "chat")] == round(2 / 3, 6) and len(pairs) == 6


def test_pattern_insight_p_value(spark):
    users = spark.createDataFrame([(f"u{i}", i < 60 or i >= 180) for i in range(200)], "user_id string, retained boolean")
    uses = spark.createDataFrame([(f"u{i}", "good") for i in range(80)] + [(f"u{i}", "plain") for i in range(0, 200, 2)], "user_id string, feature string")
    lift = {r.feature: r for r in behavior.feature_lift(uses, users).collect()}
    good = lift["good"]
    p1, p0, p = 60 / 80, 20 / 120, 80 / 200
    z = (p1 - p0) / math.sqrt(p * (1 - p) * (1 / 80 + 1 / 120))
    assert (good.lift, good.z_score) == (round(p1 / p0, 6), round(z, 6))
    found = behavior.pattern_insights(behavior.feature_lift(uses, users)).collect()
    assert [r.subject for r in found] == ["good"]
    assert found[0].confidence == pytest.approx(1 - math.erfc(z / math.sqrt(2)))


def test_evaluation(spark, by):
    data = [(True, True)] * 6 + [(True, False)] * 2 + [(False, True)] * 1 + [(False, False)] * 11
    got = by(behavior.classifier_evaluation(spark.createDataFrame(data, "p boolean, a boolean"), "p", "a"), "metric")
    assert got["accuracy"]["value"] == 0.85 and got["accuracy"]["met"]
    assert got["precision"]["value"] == 0.75 and got["f1"]["value"] == 0.8


def test_insight_thresholds(spark):
    rates = [0.04, 0.05, 0.06, 0.11, 0.16]
    df = spark.createDataFrame([(r,) for r in rates], "churn_rate double")
    got = [(r.evidence, r.severity) for r in behavior.anomaly_insights(df, 0.9).orderBy("evidence").collect()]
    assert got == [(0.06, "medium"), (0.11, "high"), (0.16, "critical")]
    kept = spark.createDataFrame([(1, 0.3), (7, 0.12), (30, None)], "horizon int, retention_rate double")
    trend = {r.subject: r.severity for r in behavior.trend_insights(kept, {1: 0.35, 7: 0.4, 30: 0.2}).collect()}
    assert trend == {"retention_d1": "low", "retention_d7": "high"}
    profile = spark.createDataFrame([(SEGMENT_VALUE, 0.02)], "segment string, user_share double")
    assert behavior.opportunity_insights(profile, 0.1).first().impact_score == 0.16
    assert behavior.opportunity_insights(profile, 0.06).count() == 0


def test_actions_and_benchmarks(spark):
    kpis = spark.createDataFrame([(0.2, 0.6, 3)], "churn_rate double, day7_retention double, cold_features int")
    assert [r.action_code for r in behavior.action_triggers(kpis).collect()] == ["churn_win_back", "cold_feature_review"]
    values = spark.createDataFrame([("dau_mau", 10.0), ("retention_d1", 30.0), ("retention_d7", 99.0), ("other", 1.0)], "metric string, value double")
    got = {r.metric: r.position for r in behavior.benchmark_comparison(values, "B2C App").collect()}
    assert got == {"dau_mau": "below", "retention_d1": "in_range", "retention_d7": "above"}


def test_preprocessing(spark):
    data = [("u", -5, "Login"), (" ", 5, "x"), (None, 5, "x"), ("v", 10**9, "view"), ("w", None, None)]
    df = as_events(spark.createDataFrame([(u, "2024-01-01 00:00:00", d, a) for u, d, a in data], "user_id string, timestamp string, duration long, action string"))
    got = {r.user_id: (r.duration, r.action) for r in preprocess(df).collect()}
    assert got == {"u": (0, "login"), "v": (86400000, "view"), "w": (None, None)}
    s = preprocess_summary(df).first()
    assert (s.total_records, s.dropped_no_user, s.clamped_negative, s.clamped_too_long, s.lowercased_actions, s.kept_records) == (5, 2, 1, 1, 1, 3)


def test_run_stops_at_the_gate(events):
    assert set(behavior_run.run(events, AS_OF)) == {"quality_score"}  # below 100 records
    full = behavior_run.run(events, AS_OF, min_records=0)
    assert {"active_users", "rfm_segments", "churn_scores", "actions", "feature_co_use", "pattern_insights"} <= set(full)
    assert full["feature_lift"].count() > 0 and full["pattern_insights"].count() == 0
    assert full["churn_scores"].count() == 3
    assert [r.action_code for r in full["actions"].collect()] == ["churn_win_back", "retention_onboarding"]
    only = behavior_run.run(events, AS_OF, min_records=0, dimensions=["rfm"])
    assert "churn_scores" not in only and only["segment_profile"].agg(F.sum("users")).first()[0] == 3


def test_event_sources(spark, tmp_path, events):
    path = str(tmp_path / "log.json")
    with open(path, "w") as f:
        f.write('[{"user_id": "u", "timestamp": "2024-01-01T10:00:00", "action": "login", "duration": 5, "feature": "x"},\n {"user_id": "v"}]')
    got = read_events(spark, path, "json")
    assert got.schema.simpleString() == spark.createDataFrame([], EVENT_SCHEMA).schema.simpleString()
    assert {r.user_id: r.duration for r in got.collect()} == {"u": 5, "v": None}
    lines = str(tmp_path / "lines")
    got.write.json(lines)
    assert read_events(spark, lines).count() == 2
    csv = str(tmp_path / "csv")
    got.write.csv(csv, header=True)
    assert read_events(spark, csv, "csv").count() == 2


# --- bitmaps of days ---------------------------------------------------------


def test_bitmaps_agree_with_single_days(spark):
    draw = random.Random(2)
    base = datetime.datetime(2023, 12, 1)
    rows = [(f"u{draw.randrange(40)}", base + datetime.timedelta(days=draw.randrange(150) * draw.randrange(2), minutes=draw.randrange(1400))) for _ in range(600)]
    rows += [("edge", base), ("edge", base + datetime.timedelta(days=63)), ("edge", base + datetime.timedelta(days=64)), (None, base), ("late", None)]
    events = spark.createDataFrame(rows, "user_id string, timestamp timestamp")
    bits = behavior.day_bits(events)
    known = {(u, t.date()) for u, t in rows if u and t}
    first, last = min(d for _, d in known), max(d for _, d in known)
    assert (bits.first, bits.days) == (first, (last - first).days + 1) and bits.days > 128
    got = {r.day: (r.dau, r.wau, r.mau) for r in behavior.activity_series(bits).collect()}
    assert len(got) == bits.days
    for day, numbers in got.items():
        assert numbers == tuple(len({u for u, d in known if 0 <= (day - d).days < n}) for n in (1, 7, 30))
    want = {tuple(r) for r in behavior.retention(events.where("user_id is not null and timestamp is not null"), [1, 5, 64, 149, 400]).collect()}
    assert {tuple(r) for r in behavior.retention_curves(bits, [1, 5, 64, 149, 400]).collect()} == want


def test_bitmaps_of_a_given_span_and_of_nothing(spark):
    rows = [("a", datetime.datetime(2024, 1, d, 23, 59)) for d in (1, 3, 20)]
    events = spark.createDataFrame(rows, "user_id string, timestamp timestamp")
    series = {r.day.day: (r.dau, r.wau) for r in behavior.activity_series(behavior.day_bits(events, "2024-01-02", "2024-01-12")).collect()}
    assert series == {d: (int(d == 3), int(3 <= d < 10)) for d in range(2, 13)}
    assert behavior.day_bits(events.limit(0)) is None
    with pytest.raises(ValueError):
        behavior.day_bits(events, "2024-01-02", "2024-01-01")


def test_one_aggregation_of_the_log(spark):
    events = spark.range(100).select(F.col("id").cast("string").alias("user_id"), F.timestamp_seconds(F.col("id") * 9999).alias("timestamp"))
    plan = behavior.activity_series(behavior.day_bits(events, "1970-01-01", "1970-03-01"))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Range (0, 100") == 1 and plan.count("bit_or") == 1
