"""Behaviour queries over the events table."""

from pyspark.sql import functions as F

from plumbline.functions.columns import mask_id
from plumbline.functions.fixed import (
    ACTION_TEMPLATES,
    BENCHMARKS,
    SEGMENT_ACTIVE,
    SEGMENT_KEEP,
    SEGMENT_RISK,
    SEGMENT_VALUE,
    SEGMENT_WIN_BACK,
)
from plumbline.operators import behavior
from plumbline.plans.registry import (
    CLEAN_SQL, EVENT_LIMIT, EVENTS_SQL, Tables, big, events_frame, register, share,
)
from plumbline.sources.events import preprocess, preprocess_summary

AS_OF = "2024-01-30"
MID = "2024-01-20"
LATE = "2024-02-05"
BASE = f"WITH e AS ({CLEAN_SQL})"


def clean(spark, d):
    return preprocess(events_frame(Tables(spark, d)), EVENT_LIMIT)


@register(
    "preprocess_summary",
    f"""WITH r AS (SELECT *, coalesce(trim(user_id), '') = '' AS no_user FROM ({EVENTS_SQL}))
    SELECT count(*) AS total_records, count(*) FILTER (WHERE no_user) AS dropped_no_user,
      count(*) FILTER (WHERE NOT no_user AND duration < 0) AS clamped_negative, count(*) FILTER (WHERE NOT no_user AND duration > {EVENT_LIMIT}) AS clamped_too_long,
      count(*) FILTER (WHERE NOT no_user AND lower(action) <> action) AS lowercased_actions, count(*) FILTER (WHERE NOT no_user) AS kept_records FROM r""",
)
def preprocess_summary_query(spark, d):
    return preprocess_summary(events_frame(Tables(spark, d)), EVENT_LIMIT)


@register(
    "preprocess_events",
    f"{BASE} SELECT action, feature, count(*) AS row_count, round(sum(duration), 2) AS duration_sum, max(duration) AS duration_max FROM e GROUP BY 1, 2",
)
def preprocess_events(spark, d):
    return clean(spark, d).groupBy("action", "feature").agg(
        F.count(F.lit(1)).alias("row_count"),
        F.round(F.sum("duration"), 2).alias("duration_sum"),
        F.max("duration").alias("duration_max"),
    )


def active_sql(as_of: str) -> str:
    d = f"DATE '{as_of}'"
    return f"""{BASE}, a AS (SELECT count(DISTINCT CASE WHEN day = {d} THEN user_id END) AS dau,
      count(DISTINCT CASE WHEN day BETWEEN {d} - 6 AND {d} THEN user_id END) AS wau,
      count(DISTINCT CASE WHEN day BETWEEN {d} - 29 AND {d} THEN user_id END) AS mau FROM e)
    SELECT '{as_of}' AS as_of, dau, wau, mau, {share('dau', 'wau')} AS dau_wau, {share('wau', 'mau')} AS wau_mau, {share('dau', 'mau')} AS dau_mau,
      CASE WHEN {share('dau', 'wau')} > 0.2 THEN 'healthy' ELSE 'low' END AS dau_wau_state,
      CASE WHEN {share('wau', 'mau')} > 0.5 THEN 'healthy' ELSE 'low' END AS wau_mau_state FROM a"""


@register("active_users", active_sql(AS_OF))
def active_users(spark, d):
    return behavior.active_users(clean(spark, d), AS_OF)


@register("active_users_midway", active_sql("2024-01-09"))
def active_users_midway(spark, d):
    return behavior.active_users(clean(spark, d), "2024-01-09")


RETENTION = f"""{BASE}, f AS (SELECT user_id, min(day) AS cohort_day FROM e GROUP BY 1), a AS (SELECT DISTINCT user_id, day FROM e),
  h AS (SELECT unnest([1, 7, 14, 30]) AS horizon), z AS (SELECT max(day) AS last_day FROM e),
  r AS (SELECT f.cohort_day, CAST(h.horizon AS INTEGER) AS horizon, count(*) AS cohort_size,
      CASE WHEN f.cohort_day + CAST(h.horizon AS INTEGER) <= any_value(z.last_day) THEN count(a.user_id) END AS retained
    FROM f CROSS JOIN h CROSS JOIN z LEFT JOIN a ON a.user_id = f.user_id AND a.day = f.cohort_day + CAST(h.horizon AS INTEGER) GROUP BY 1, 2)"""
HORIZONS = [1, 7, 14, 30]


@register(
    "retention",
    f"{RETENTION} SELECT *, {share('retained', 'cohort_size')} AS retention_rate FROM r",
)
def retention(spark, d):
    return behavior.retention(clean(spark, d), HORIZONS)


@register(
    "retention_overall",
    f"""{RETENTION} SELECT horizon, {big('coalesce(sum(CASE WHEN retained IS NOT NULL THEN cohort_size END), 0)')} AS users,
      {big('coalesce(sum(retained), 0)')} AS retained, {share('sum(retained)', 'sum(CASE WHEN retained IS NOT NULL THEN cohort_size END)')} AS retention_rate
    FROM r GROUP BY 1""",
)
def retention_overall(spark, d):
    return behavior.retention_overall(behavior.retention(clean(spark, d), HORIZONS))


@register(
    "activity_series",
    f"""{BASE}, a AS (SELECT DISTINCT user_id, day FROM e), s AS (SELECT CAST(unnest(generate_series(min(day), max(day), INTERVAL 1 DAY)) AS DATE) AS day FROM e),
    c AS (SELECT s.day, count(DISTINCT CASE WHEN a.day = s.day THEN user_id END) AS dau, count(DISTINCT CASE WHEN a.day > s.day - 7 THEN user_id END) AS wau, count(DISTINCT user_id) AS mau
      FROM s LEFT JOIN a ON a.day <= s.day AND a.day > s.day - 30 GROUP BY 1)
    SELECT *, {share('dau', 'wau')} AS dau_wau, {share('wau', 'mau')} AS wau_mau, {share('dau', 'mau')} AS dau_mau FROM c""",
)
def activity_series(spark, d):
    return behavior.activity_series(behavior.day_bits(clean(spark, d)))


@register(
    "retention_curves",
    f"""{RETENTION.replace("[1, 7, 14, 30]", "range(1, 41)")} SELECT *, {share('retained', 'cohort_size')} AS retention_rate FROM r""",
)
def retention_curves(spark, d):
    return behavior.retention_curves(behavior.day_bits(clean(spark, d)), list(range(1, 41)))


@register(
    "retention_availability",
    f"""{BASE}, s AS (SELECT CAST(max(day) - min(day) AS INTEGER) AS span_days FROM e), h AS (SELECT CAST(unnest([1, 7, 30]) AS INTEGER) AS horizon)
    SELECT span_days, horizon, span_days >= horizon AS available, CASE WHEN span_days >= horizon THEN '' ELSE concat('time span below ', horizon, ' days') END AS reason
    FROM s, h""",
)
def retention_availability(spark, d):
    return behavior.retention_availability(clean(spark, d))


@register(
    "session_stats",
    f"""{BASE} SELECT count(*) AS sessions, round(avg(length), 4) AS avg_session_duration FROM (SELECT session_id, sum(duration) AS length FROM e GROUP BY 1)""",
)
def session_stats(spark, d):
    return behavior.session_stats(clean(spark, d))


@register(
    "peak_hours",
    f"""{BASE} SELECT CAST(hour(timestamp) AS INTEGER) AS hour, count(*) AS events,
      CAST(row_number() OVER (ORDER BY count(*) DESC, CAST(hour(timestamp) AS INTEGER)) AS INTEGER) AS rank FROM e GROUP BY 1""",
)
def peak_hours(spark, d):
    return behavior.peak_hours(clean(spark, d))


# --- value segments ----------------------------------------------------------

RFM = f"""{BASE}, b AS (SELECT user_id, CAST(DATE '{MID}' - max(day) AS INTEGER) AS recency, count(*) AS frequency, round(sum(duration), 6) AS monetary FROM e
    WHERE day <= DATE '{MID}' GROUP BY 1),
  q AS (SELECT {', '.join(f'quantile_cont(CAST({c} AS DOUBLE), {p}) AS {c[0]}{i}' for c in ('recency', 'frequency', 'monetary') for i, p in enumerate((0.2, 0.4, 0.6, 0.8)))} FROM b),
  s AS (SELECT b.*, CAST(CASE WHEN recency <= r0 THEN 5 WHEN recency <= r1 THEN 4 WHEN recency <= r2 THEN 3 WHEN recency <= r3 THEN 2 ELSE 1 END AS INTEGER) AS r_score,
    CAST(CASE WHEN frequency >= f3 THEN 5 WHEN frequency >= f2 THEN 4 WHEN frequency >= f1 THEN 3 WHEN frequency >= f0 THEN 2 ELSE 1 END AS INTEGER) AS f_score,
    CAST(CASE WHEN monetary >= m3 THEN 5 WHEN monetary >= m2 THEN 4 WHEN monetary >= m1 THEN 3 WHEN monetary >= m0 THEN 2 ELSE 1 END AS INTEGER) AS m_score FROM b, q),
  t AS (SELECT *, CASE WHEN r_score >= 4 AND f_score >= 4 AND m_score >= 4 THEN '{SEGMENT_VALUE}' WHEN r_score >= 4 AND f_score >= 4 THEN '{SEGMENT_KEEP}'
    WHEN r_score >= 4 THEN '{SEGMENT_ACTIVE}' WHEN f_score >= 4 AND m_score >= 4 THEN '{SEGMENT_WIN_BACK}' ELSE '{SEGMENT_RISK}' END AS segment,
    CASE WHEN r_score >= 4 AND f_score >= 4 AND m_score >= 4 THEN '{SEGMENT_VALUE}' WHEN r_score >= 4 AND f_score >= 4 THEN '{SEGMENT_KEEP}'
    WHEN r_score <= 2 AND f_score >= 4 AND m_score >= 4 THEN '{SEGMENT_WIN_BACK}' WHEN r_score >= 3 THEN '{SEGMENT_ACTIVE}' ELSE '{SEGMENT_RISK}' END AS m_segment FROM s)"""


def rfm(spark, d):
    return behavior.rfm_base(clean(spark, d), MID)


@register("rfm_base", f"{RFM} SELECT * FROM b")
def rfm_base(spark, d):
    return rfm(spark, d)


@register("rfm_segments", f"{RFM} SELECT user_id, recency, frequency, monetary, r_score, f_score, m_score, segment FROM t")
def rfm_segments(spark, d):
    return behavior.rfm_segments(rfm(spark, d))


@register("rfm_segments_matrix", f"{RFM} SELECT m_segment AS segment, count(*) AS users FROM t GROUP BY 1")
def rfm_segments_matrix(spark, d):
    return behavior.rfm_segments(rfm(spark, d), "matrix").groupBy("segment").agg(F.count(F.lit(1)).alias("users"))


PROFILE = f"""SELECT segment, count(*) AS users, round(avg(recency), 4) AS avg_recency, round(avg(frequency), 4) AS avg_frequency,
  round(avg(monetary), 4) AS avg_monetary, {share('count(*)', 'sum(count(*)) OVER ()')} AS user_share FROM t GROUP BY 1"""


@register("segment_profile", f"{RFM} {PROFILE}")
def segment_profile(spark, d):
    return behavior.segment_profile(behavior.rfm_segments(rfm(spark, d)))


# --- features ----------------------------------------------------------------


@register(
    "feature_penetration",
    f"""{BASE}, f AS (SELECT feature, count(DISTINCT user_id) AS users, count(*) AS uses, round(avg(duration), 4) AS avg_duration,
      {share('count(DISTINCT user_id)', '(SELECT count(DISTINCT user_id) FROM e)')} AS penetration FROM e WHERE feature IS NOT NULL GROUP BY 1)
    SELECT *, penetration < 0.05 AS is_cold FROM f""",
)
def feature_penetration(spark, d):
    return behavior.feature_penetration(clean(spark, d))


@register(
    "feature_co_use",
    f"""{BASE}, u AS (SELECT DISTINCT user_id, feature FROM e WHERE feature IS NOT NULL), n AS (SELECT feature, count(*) AS users_a FROM u GROUP BY 1),
    p AS (SELECT a.feature AS feature_a, b.feature AS feature_b, count(*) AS both_users FROM u a JOIN u b ON a.user_id = b.user_id AND a.feature <> b.feature GROUP BY 1, 2)
    SELECT feature_a, feature_b, both_users, users_a, {share('both_users', 'users_a')} AS co_use_share FROM p JOIN n ON n.feature = feature_a""",
)
def feature_co_use(spark, d):
    return behavior.feature_co_use(clean(spark, d))


# --- churn -------------------------------------------------------------------


def drop_sql(now: str, before: str) -> str:
    return f"CASE WHEN {before} > 0 AND ({now} - {before}) / CAST({before} AS DOUBLE) < -0.5 THEN least(1.0, abs(({now} - {before}) / CAST({before} AS DOUBLE))) ELSE 0 END"


def churn_sql(as_of: str, threshold: int, window: int) -> str:
    d = f"DATE '{as_of}'"
    recent = f"({d} - day) < {window}"
    previous = f"({d} - day) >= {window} AND ({d} - day) < {2 * window}"
    return f"""{BASE}, u AS (SELECT user_id, CAST({d} - max(day) AS INTEGER) AS days_since_last, count(*) FILTER (WHERE {recent}) AS recent_count,
      count(*) FILTER (WHERE {previous}) AS previous_count, round(coalesce(sum(duration) FILTER (WHERE {recent}), 0), 6) AS recent_duration,
      round(coalesce(sum(duration) FILTER (WHERE {previous}), 0), 6) AS previous_duration, count(DISTINCT feature) AS unique_features FROM e WHERE day <= {d} GROUP BY 1),
    x AS (SELECT *, CASE WHEN days_since_last >= {threshold} THEN CAST(1 AS DOUBLE) ELSE days_since_last / CAST({threshold} AS DOUBLE) END AS recency_factor,
      CAST({drop_sql('recent_count', 'previous_count')} AS DOUBLE) AS count_factor, CAST({drop_sql('recent_duration', 'previous_duration')} AS DOUBLE) AS duration_factor,
      CASE WHEN unique_features < 3 THEN (3 - unique_features) / CAST(3 AS DOUBLE) ELSE CAST(0 AS DOUBLE) END AS diversity_factor FROM u),
    c AS (SELECT *, round(recency_factor * CAST(0.4 AS DOUBLE) + count_factor * CAST(0.3 AS DOUBLE) + duration_factor * CAST(0.2 AS DOUBLE)
      + diversity_factor * CAST(0.1 AS DOUBLE), 4) AS risk_score FROM x),
    k AS (SELECT *, CASE WHEN risk_score >= 0.6 THEN 'high' WHEN risk_score >= 0.3 THEN 'medium' ELSE 'low' END AS risk_level FROM c)"""


CHURN, CHURN_LATE = churn_sql(MID, 3, 8), churn_sql(LATE, 3, 8)


def scores(spark, d, as_of=MID):
    return behavior.churn_scores(clean(spark, d), as_of, threshold_days=3, window_days=8)


@register("churn_scores", f"{CHURN} SELECT * FROM k")
def churn_scores(spark, d):
    return scores(spark, d)


@register("churn_scores_default", f"{churn_sql(AS_OF, 7, 30)} SELECT * FROM k")
def churn_scores_default(spark, d):
    return behavior.churn_scores(clean(spark, d), AS_OF)


@register(
    "risk_distribution",
    f"{CHURN_LATE} SELECT risk_level, count(*) AS users, {share('count(*)', 'sum(count(*)) OVER ()')} AS user_share FROM k GROUP BY 1",
)
def risk_distribution(spark, d):
    return behavior.risk_distribution(scores(spark, d, LATE))


@register(
    "factor_prevalence",
    CHURN_LATE + " " + " UNION ALL ".join(
        f"SELECT '{f}' AS factor, count(*) FILTER (WHERE {f} > 0) AS users, {share(f'count(*) FILTER (WHERE {f} > 0)', 'count(*)')} AS user_share FROM k"
        for f in behavior.FACTORS
    ),
)
def factor_prevalence(spark, d):
    return behavior.factor_prevalence(scores(spark, d, LATE))


OBSERVED = f"""o AS (SELECT user_id, NOT bool_or(day > DATE '{MID}' AND day <= DATE '{MID}' + 4) AS churned FROM e GROUP BY 1
  HAVING min(day) <= DATE '{MID}')"""


@register("observed_churn", f"{BASE}, {OBSERVED} SELECT user_id, churned FROM o")
def observed_churn(spark, d):
    return behavior.observed_churn(clean(spark, d), MID, 4)


@register(
    "classifier_evaluation",
    f"""{CHURN}, {OBSERVED}, m AS (SELECT count(*) FILTER (WHERE p AND churned) AS tp, count(*) FILTER (WHERE p AND NOT churned) AS fp,
      count(*) FILTER (WHERE NOT p AND churned) AS fn, count(*) FILTER (WHERE NOT p AND NOT churned) AS tn FROM
      (SELECT risk_level <> 'low' AS p, churned FROM k JOIN o USING (user_id))),
    v AS (SELECT 'accuracy' AS metric, (tp + tn) / nullif(CAST(tp + fp + fn + tn AS DOUBLE), 0) AS value, CAST(0.85 AS DOUBLE) AS target FROM m
      UNION ALL SELECT 'recall', tp / nullif(CAST(tp + fn AS DOUBLE), 0), 0.8 FROM m UNION ALL SELECT 'precision', tp / nullif(CAST(tp + fp AS DOUBLE), 0), 0.7 FROM m
      UNION ALL SELECT 'f1', 2 * tp / nullif(CAST(2 * tp + fp + fn AS DOUBLE), 0), 0.75 FROM m)
    SELECT metric, round(value, 6) AS value, target, coalesce(value >= target, false) AS met FROM v""",
)
def classifier_evaluation(spark, d):
    predicted = scores(spark, d).select("user_id", (F.col("risk_level") != "low").alias("predicted"))
    actual = behavior.observed_churn(clean(spark, d), MID, 4)
    return behavior.classifier_evaluation(predicted.join(actual, "user_id"), "predicted", "churned")


# --- insights ----------------------------------------------------------------


@register(
    "trend_insights",
    f"""{RETENTION}, o AS (SELECT horizon, {share('sum(retained)', 'sum(CASE WHEN retained IS NOT NULL THEN cohort_size END)')} AS rate FROM r GROUP BY 1),
    g AS (SELECT horizon, round(CASE horizon WHEN 1 THEN CAST(0.95 AS DOUBLE) WHEN 7 THEN CAST(1.2 AS DOUBLE) WHEN 14 THEN CAST(0.5 AS DOUBLE) END - rate, 6) AS gap FROM o
      WHERE rate IS NOT NULL AND horizon IN (1, 7, 14))
    SELECT 'trend' AS kind, concat('retention_d', horizon) AS subject, CASE WHEN gap > 0.2 THEN 'high' WHEN gap > 0.1 THEN 'medium' ELSE 'low' END AS severity,
      gap AS evidence, CAST(0.95 AS DOUBLE) AS confidence FROM g""",
)
def trend_insights(spark, d):
    overall = behavior.retention_overall(behavior.retention(clean(spark, d), HORIZONS))
    return behavior.trend_insights(overall, {1: 0.95, 7: 1.2, 14: 0.5})


@register(
    "anomaly_insights",
    f"""{CHURN_LATE}, r AS (SELECT {share("count(*) FILTER (WHERE risk_level = 'high')", 'count(*)')} AS churn_rate FROM k)
    SELECT 'anomaly' AS kind, 'churn_rate' AS subject, CASE WHEN churn_rate > 0.15 THEN 'critical' WHEN churn_rate > 0.1 THEN 'high' ELSE 'medium' END AS severity,
      churn_rate AS evidence, CAST(0.9 AS DOUBLE) AS confidence FROM r WHERE churn_rate > 0.05""",
)
def anomaly_insights(spark, d):
    return behavior.anomaly_insights(behavior.churn_rate(scores(spark, d, LATE)), 0.9)


LIFT = f"""{BASE}, fl AS (SELECT user_id, max(day) >= DATE '{AS_OF}' AS retained FROM e GROUP BY 1), u AS (SELECT DISTINCT user_id, feature FROM e WHERE feature IS NOT NULL),
  w AS (SELECT feature, count(*) AS n1, count(*) FILTER (WHERE retained) AS k1 FROM u JOIN fl USING (user_id) GROUP BY 1),
  x AS (SELECT feature, n1, k1, (SELECT count(*) FROM fl) AS n, (SELECT count(*) FROM fl WHERE retained) AS k FROM w),
  y AS (SELECT *, n - n1 AS n0, k1 / CAST(n1 AS DOUBLE) AS p1, (k - k1) / nullif(CAST(n - n1 AS DOUBLE), 0) AS p0, k / CAST(n AS DOUBLE) AS p FROM x),
  z AS (SELECT feature, n1 AS users_with, n0 AS users_without, round(p1, 6) AS retention_with, round(p0, 6) AS retention_without,
    round(p1 / nullif(p0, 0), 6) AS lift, round((p1 - p0) / nullif(sqrt(p * (1 - p) * (1 / CAST(n1 AS DOUBLE) + 1 / nullif(CAST(n0 AS DOUBLE), 0))), 0), 6) AS z_score FROM y)"""


def lift(spark, d):
    events = clean(spark, d)
    flags = events.groupBy("user_id").agg((F.max(F.to_date("timestamp")) >= F.lit(AS_OF).cast("date")).alias("retained"))
    return behavior.feature_lift(events, flags)


@register("feature_lift", f"{LIFT} SELECT * FROM z")
def feature_lift(spark, d):
    return lift(spark, d)


@register(
    "pattern_insights",
    f"""{LIFT} SELECT 'pattern' AS kind, feature AS subject, 'medium' AS severity, lift AS evidence FROM z WHERE lift > 1.01 AND abs(z_score) > 0.6744897501960817""",
)
def pattern_insights(spark, d):
    """Loose limits (lift 1.01, p 0.5), so that the test tables give rows."""
    return behavior.pattern_insights(lift(spark, d), min_lift=1.01, max_p=0.5).drop("confidence")


@register(
    "opportunity_insights",
    f"""{RFM}, p AS ({PROFILE}), g AS (SELECT round(CAST(0.5 AS DOUBLE) - coalesce(max(CASE WHEN segment = '{SEGMENT_VALUE}' THEN user_share END), 0), 6) AS gap FROM p)
    SELECT 'opportunity' AS kind, 'vip_share' AS subject, 'medium' AS severity, gap AS evidence, CAST(NULL AS DOUBLE) AS confidence, round(gap * 2, 6) AS impact_score
    FROM g WHERE gap > 0.05""",
)
def opportunity_insights(spark, d):
    return behavior.opportunity_insights(behavior.segment_profile(behavior.rfm_segments(rfm(spark, d))), 0.5)


def kpi_row(spark, d):
    events = clean(spark, d)
    overall = behavior.retention_overall(behavior.retention(events, [7]))
    cold = behavior.feature_penetration(events, cold_below=0.999).agg(F.count_if("is_cold").alias("cold"))
    return behavior.churn_rate(scores(spark, d, LATE)).select(
        "churn_rate",
        overall.agg(F.max("retention_rate")).scalar().alias("day7_retention"),
        cold.scalar().alias("cold_features"),
    )


ACTION_ROWS = ", ".join("(" + ", ".join(f"'{v}'" for v in t) + ")" for t in ACTION_TEMPLATES)


@register(
    "action_triggers",
    f"""{CHURN_LATE}, fe AS (SELECT count(*) AS cold FROM (SELECT feature FROM e WHERE feature IS NOT NULL GROUP BY 1 HAVING
        {share('count(DISTINCT user_id)', '(SELECT count(DISTINCT user_id) FROM e)')} < 0.999)),
    f1 AS (SELECT user_id, min(day) AS c FROM e GROUP BY 1), zz AS (SELECT max(day) AS last_day FROM e),
    r7 AS (SELECT {share('count(*) FILTER (WHERE EXISTS (SELECT 1 FROM e WHERE e.user_id = f1.user_id AND e.day = f1.c + 7))', 'count(*)')} AS rate FROM f1, zz WHERE c + 7 <= last_day),
    kp AS (SELECT {share("count(*) FILTER (WHERE risk_level = 'high')", 'count(*)')} AS churn_rate FROM k),
    tpl AS (SELECT * FROM (VALUES {ACTION_ROWS}) v(action_code, priority, action, kpi, timeline, owner))
    SELECT tpl.* FROM tpl, kp, r7, fe WHERE (action_code = 'churn_win_back' AND churn_rate > 0.1) OR (action_code = 'retention_onboarding' AND rate < 0.5)
      OR (action_code = 'cold_feature_review' AND cold >= 3)""",
)
def action_triggers(spark, d):
    return behavior.action_triggers(kpi_row(spark, d))


BENCH_ROWS = ", ".join(f"('{m}', {lo}, {hi})" for m, i, lo, hi in BENCHMARKS if i == "B2C App")


@register(
    "benchmark_comparison",
    f"""{BASE}, a AS (SELECT count(DISTINCT CASE WHEN day = DATE '{AS_OF}' THEN user_id END) AS dau, count(DISTINCT user_id) AS mau FROM e),
    f1 AS (SELECT user_id, min(day) AS c FROM e GROUP BY 1), dd AS (SELECT DISTINCT user_id, day FROM e), zz AS (SELECT max(day) AS last_day FROM e),
    rr AS (SELECT h AS horizon, count(dd.user_id) AS retained, count(*) AS users FROM f1 CROSS JOIN (SELECT unnest([1, 7]) AS h) CROSS JOIN zz
      LEFT JOIN dd ON dd.user_id = f1.user_id AND dd.day = f1.c + CAST(h AS INTEGER) WHERE f1.c + CAST(h AS INTEGER) <= last_day GROUP BY 1),
    v AS (SELECT 'dau_mau' AS metric, round({share('dau', 'mau')} * 100, 4) AS value FROM a
      UNION ALL SELECT concat('retention_d', horizon), round({share('retained', 'users')} * 100, 4) FROM rr),
    b AS (SELECT metric, CAST(low AS DOUBLE) AS low, CAST(high AS DOUBLE) AS high FROM (VALUES {BENCH_ROWS}) x(metric, low, high))
    SELECT metric, value, 'B2C App' AS industry, low, high, CASE WHEN value < low THEN 'below' WHEN value > high THEN 'above' ELSE 'in_range' END AS position
    FROM v JOIN b USING (metric)""",
)
def benchmark_comparison(spark, d):
    events = clean(spark, d)
    active = behavior.active_users(events, AS_OF).select(
        F.lit("dau_mau").alias("metric"), F.round(F.col("dau_mau") * 100, 4).alias("value")
    )
    kept = behavior.retention_overall(behavior.retention(events, [1, 7])).select(
        F.concat(F.lit("retention_d"), F.col("horizon").cast("string")).alias("metric"),
        F.round(F.col("retention_rate") * 100, 4).alias("value"),
    )
    return behavior.benchmark_comparison(active.unionByName(kept), "B2C App")


@register(
    "user_masking",
    f"{BASE} SELECT sha256(concat('pepper', user_id)) AS user_mask, count(*) AS events FROM e GROUP BY 1",
)
def user_masking(spark, d):
    return clean(spark, d).groupBy(mask_id("user_id", "pepper").alias("user_mask")).agg(
        F.count(F.lit(1)).alias("events")
    )
