"""Quality checks and rules on hand-made frames, including empty and all-NULL ones."""

import datetime as dt

import pytest
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from plumbline.operators import ordered, quality, rules

SCHEMA = "id long, name string, amount double, flag boolean, seen timestamp, date string, empty string"


@pytest.fixture(scope="module")
def frame(spark):
    t = dt.datetime
    data = [
        (1, "a", 1.0, True, t(2024, 1, 1), "2024-01-01", None),
        (1, " a", 2.0, None, t(2030, 1, 1), "2024-01-03", None),
        (2, "a\x07b", 3.0, True, t(2019, 1, 1), "", None),
        (3, "a   b", None, False, None, None, None),
        (None, "", 4.0, False, t(2024, 2, 1), "2024-01-03", None),
        (None, "x" * 501, 100.0, True, t(2024, 2, 1), "2024-01-02", None),
        (4, "y" * 1001, 2.5, True, t(2024, 2, 1), "2024-01-02", None),
        (5, None, 2.0, True, t(2024, 2, 1), "2024-01-02", None),
    ]
    return spark.createDataFrame(data, SCHEMA)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def test_null_rates(frame, empty, by):
    got = by(quality.null_rates(frame), "column_name")
    assert got["name"]["null_rows"] == 2 and got["name"]["null_pct"] == 25.0
    assert got["id"]["null_pct"] == 25.0 and got["empty"]["null_pct"] == 100.0
    assert set(by(quality.high_null(quality.null_rates(frame), 30), "column_name")) == {"empty"}
    assert all(r["null_pct"] == 0.0 and r["total_rows"] == 0 for r in by(quality.null_rates(empty), "column_name").values())


def test_single_pass_equals_naive(frame, by):
    got = by(quality.null_rates(frame), "column_name")
    for c in frame.columns:
        cond = F.col(c).isNull() if c not in ("name", "date", "empty") else F.trim(F.coalesce(c, F.lit(""))) == ""
        assert got[c]["null_rows"] == frame.where(cond).count()


def test_keys(frame, empty, by, rows):
    assert rows(quality.duplicate_keys(frame, "id")) == [{"id": 1, "dup_cnt": 2}]
    got = by(quality.key_duplication(frame, ["id", "date"]), "key_name")["id"]
    assert (got["distinct_keys"], got["total_keys"], got["dup_rate_pct"], got["expansion_rows"]) == (5, 6, 16.67, 3)
    one = quality.composite_key(frame, ["id", "date"]).first()
    assert (one.total_rows, one.distinct_keys, one.duplicate_rows) == (8, 8, 0)
    none = quality.composite_key(empty, ["id", "date"]).first()
    assert (none.total_rows, none.duplicate_rate_pct) == (0, 0.0)


def test_composite_key_does_not_collide(spark):
    df = spark.createDataFrame([("a|b", "c"), ("a", "b|c"), (None, "x"), ("", "x")], "k string, v string")
    assert quality.composite_key(df, ["k", "v"]).first().distinct_keys == 3


def test_numbers_and_outliers(frame, empty, by):
    got = by(quality.numeric_profile(frame, ["amount"]), "column_name")["amount"]
    assert (got["min_value"], got["max_value"], got["avg_value"]) == (1.0, 100.0, 16.36)
    out = by(quality.iqr_outliers(frame, ["amount"]), "column_name")["amount"]
    assert (out["q1"], out["q3"], out["outlier_count"], out["value_count"]) == (2.0, 3.5, 1, 7)
    none = by(quality.iqr_outliers(empty, ["amount"]), "column_name")["amount"]
    assert (none["q1"], none["outlier_count"], none["outlier_pct"]) == (None, 0, 0.0)


def test_dirty_strings_and_limits(frame, by):
    got = by(quality.dirty_strings(frame), "column_name")["name"]
    assert (got["control_chars"], got["excess_whitespace"], got["overlong_values"], got["trim_issues"]) == (1, 1, 1, 1)
    assert by(quality.dirty_strings(frame, max_length=500), "column_name")["name"]["overlong_values"] == 2


def test_times(frame, by):
    got = by(quality.time_sanity(frame, "2025-01-01"), "column_name")["seen"]
    assert (got["future_dates"], got["ancient_dates"], got["earliest"]) == (1, 1, "2019-01-01 00:00:00")
    text = by(quality.time_text_range(frame), "column_name")["date"]
    assert (text["earliest"], text["latest"], text["distinct_values"]) == ("2024-01-01", "2024-01-03", 3)
    fresh = by(quality.freshness(frame, ["date", "seen"]), "column_name")
    assert fresh["date"]["min_value"] == "2024-01-01" and fresh["seen"]["max_value"] == "2030-01-01 00:00:00"


def test_fill_and_contract(frame, by):
    got = by(quality.fill_metrics(frame, ["name", "weight"], F.col("amount") > 1), "field_name")
    assert (got["name"]["fill_rows"], got["name"]["miss_rows"]) == (4, 2)
    assert got["weight"]["exists"] is False and got["weight"]["miss_rate_pct"] is None
    contract = by(quality.contract_check(frame, ["id", "sku"]), "column_name")
    assert contract["sku"]["severity"] == "critical" and contract["id"]["status"] == "pass"


def test_order_and_range(spark, by):
    df = spark.createDataFrame([(1, 2), (3, 2), (None, 1), (5, 5)], "a int, b int")
    got = quality.temporal_order(df, {"a_b": ("a", "b")}).first()
    assert (got.compared_rows, got.bad_rows) == (3, 1)
    r = by(quality.range_validity(df, {"a": (2, 4), "b": (None, 4)}), "column_name")
    assert (r["a"]["below_range"], r["a"]["above_range"], r["b"]["above_range"]) == (1, 1, 1)


def test_structure_and_categories(frame, by):
    got = by(quality.structure_findings(frame), "column_name")
    assert got["date"]["time_as_text"] and got["date"]["category"] == "temporal"
    assert got["id"]["category"] == "identifier" and got["amount"]["category"] == "measure"


def test_parse_validity(spark, rows):
    df = spark.createDataFrame([("1",), ("1.",), ("1万",), ("1万",), ("",), (None,)], "x string")
    assert rows(quality.parse_validity(df, "x")) == [{"value": "", "cnt": 1}, {"value": "1万", "cnt": 2}]


def test_confidence_cap(spark):
    df = spark.createDataFrame([(99,), (100,), (999,), (1000,), (10000,), (10001,)], "n long")
    got = [r[0] for r in df.select(quality.confidence_cap(F.col("n"))).collect()]
    assert got == [None, 0.7, 0.7, 0.85, 0.85, 0.95]


def test_quality_score_gate(spark):
    good = spark.createDataFrame([("u", dt.datetime(2024, 1, 30), 5.0)], "user string, at timestamp, d double")
    got = quality.quality_score(good, ["user"], "at", "d", "2024-01-31").first()
    assert (got.score, got.status) == (100.0, "pass")
    late = quality.quality_score(good, ["user"], "at", "d", "2025-01-31").first()
    assert (late.freshness, late.score) == (0.0, 80.0)


# --- rules -------------------------------------------------------------------

FILE_SCHEMA = (
    "file_id string, platform_source_id string, full_path string, folder_path string, file_name string, "
    "data_update_time string, image_modify_time string"
)


@pytest.fixture(scope="module")
def projected(spark):
    data = [
        ("1", "s", "x/a.mp4", None, None, "2024-01-01", None),
        ("2", "s", "x/b.zip", None, None, None, None),
        ("3", "s", None, "dir", "c.JPG", None, "2024-02-01"),
        ("4", None, None, None, None, "2024-01-03", None),
        ("5", "s", "x/other.jpg", "dir", "d.jpg", "2024-01-02", None),
        ("6", "s", "x/plain", " ", "plain", "2024-01-05", None),
    ]
    return rules.file_projection(spark.createDataFrame(data, FILE_SCHEMA))


def test_rule_counts_and_rank(projected, by):
    got = by(rules.rule_checks(projected, rules.file_rules()), "code")
    counts = {k: v["row_count"] for k, v in got.items()}
    assert counts == {
        "VIDEO_SUFFIX_IN_IMAGE_SET": 1,
        "TARGET_FOLDER_FIELD_SUFFIX_RISK": 4,
        "UNKNOWN_SUFFIX_IN_IMAGE_SET": 1,
        "FALLBACK_TO_FULL_PATH": 4,
        "BASENAME_CONFLICT": 1,
        "MISSING_IMAGE_UPDATE_TIME": 1,
        "MISSING_STANDARD_PATH": 1,
    }
    ranked = sorted(got, key=lambda c: got[c]["rank"])
    assert ranked[:3] == ["TARGET_FOLDER_FIELD_SUFFIX_RISK", "MISSING_STANDARD_PATH", "VIDEO_SUFFIX_IN_IMAGE_SET"]
    assert [r["rank"] for r in sorted(got.values(), key=lambda r: r["rank"])] == list(range(1, 8))


def test_rule_samples_per_rule(projected):
    got = rules.rule_samples(projected, rules.file_rules(), ["file_id"], 2).collect()
    fallback = [r.file_id for r in sorted(got, key=lambda r: r.sample_no) if r.code == "FALLBACK_TO_FULL_PATH"]
    assert fallback == ["6", "4"]  # newest first
    assert all(r.sample_no <= 2 for r in got)


def test_null_path_is_other_family(projected, by):
    got = by(projected, "file_id")
    assert got["4"]["path_suffix_family"] == "other" and got["6"]["path_suffix_family"] == "none"
    dist = {(r.path_ext_std, r.path_suffix_family): r.row_count for r in rules.extension_distribution(projected).collect()}
    assert dist[("", "other")] == 1 and dist[("", "none")] == 1


def test_health_findings(projected, by):
    metrics = rules.health_metrics(projected)
    assert by(metrics, "metric")["use_concat_path"]["row_count"] == 2
    assert {"fallback_to_full_path", "update_time_filled", "full_path_std_filled", "folder_suffix"} <= set(
        by(rules.health_findings(metrics), "check")
    )
    assert set(by(rules.health_findings(rules.health_metrics(projected.limit(0))), "check")) == {"empty_set"}


def test_rare_rows_are_still_findings(spark, by):
    metrics = spark.createDataFrame(
        [("folder_suffix", 1, 0.0, 40_000), ("video_suffix", 1, 0.0, 40_000), ("update_time_filled", 37_999, 95.0, 40_000)],
        "metric string, row_count long, row_rate_pct double, total_rows long",
    )
    assert set(by(rules.health_findings(metrics), "check")) == {"folder_suffix", "video_suffix", "update_time_filled"}


@pytest.mark.parametrize("name", ["candidate", "mandate", "runtime", "monkey", "turkey", "o_orderkey"])
def test_words_within_names_do_not_decide_the_category(name):
    assert quality.column_category(name, StringType()) == "dimension"


def test_category_by_the_last_word():
    assert [quality.column_category(n, StringType()) for n in ("id", "user_id", "row_key", "pay_date", "end_time")] == [
        "identifier", "identifier", "identifier", "temporal", "temporal",
    ]
    assert quality.column_category("o_orderkey", StringType(), identifiers=("orderkey",)) == "identifier"


def test_verdicts_and_samples(spark, projected, by):
    checks = rules.rule_checks(projected, rules.file_rules())
    found = rules.verdicts(checks, "code", "row_count", "total_rows", F.col("severity"), "files")
    samples = rules.rule_samples(projected, rules.file_rules(), ["file_id"], 1)
    got = by(rules.with_samples(found, samples), "check")
    assert got["BASENAME_CONFLICT"]["sample"] == ['{"sample_no":1,"file_id":"5"}']
    assert got["BASENAME_CONFLICT"]["row_rate_pct"] == 16.6667
    assert spark.createDataFrame([], rules.FINDING_SCHEMA).columns == rules.FINDING_COLUMNS == found.columns


def test_root_cause_order(spark):
    df = spark.createDataFrame([(True, True), (False, True), (False, False)], "a boolean, b boolean")
    no = F.lit(False)
    got = [r[0] for r in df.select(rules.root_cause(F.col("a"), F.col("b"), no, no, no, no)).collect()]
    assert got == ["source_pollution", "mapping_mistake", None]


# --- ordered helpers ---------------------------------------------------------


def test_ordered_running_matches_driver(spark):
    df = spark.range(500).select((F.col("id") * 7919 % 101).alias("v"), F.col("id").alias("k"))
    order = [F.desc("v"), F.asc("k")]
    got = ordered.ordered_running(df, order, {"cum": "v"}, "rn", partitions=7).orderBy("rn").collect()
    total = 0
    for i, r in enumerate(sorted(df.collect(), key=lambda r: (-r.v, r.k)), 1):
        total += r.v
        assert (got[i - 1].k, got[i - 1].rn, got[i - 1].cum) == (r.k, i, total)


def test_pages_agree(spark):
    df = spark.range(300).select((F.col("id") % 17).alias("v"), "id")
    order = [F.desc("v"), F.asc("id")]
    want = df.orderBy(*order).offset(40).limit(25).collect()
    assert ordered.page(df, order, 40, 25).orderBy(*order).collect() == want


@pytest.mark.parametrize("name, rising", [("v", True), ("v", False), ("d", True), ("t", False), ("s", True), ("gap", True)])
def test_deep_pages(spark, monkeypatch, name, rising):
    monkeypatch.setattr(ordered, "FIRST_ROWS", 50)
    df = spark.range(20_000).select(
        (F.col("id") * 7919 % 1009 / 8).alias("v"), F.date_add(F.lit("2024-01-01").cast("date"), (F.col("id") % 400).cast("int")).alias("d"),
        F.timestamp_seconds(F.col("id") * 31 % 5000).alias("t"), (F.col("id") % 90).cast("string").alias("s"),
        F.when(F.col("id") % 3 > 0, F.col("id") % 77).alias("gap"), "id",
    ).repartition(5)
    order = [(name, rising), ("id", False)]
    whole = df.orderBy(*ordered.order_columns(order)).select("id").collect()
    for offset, size in ((10, 20), (0, 100), (9_990, 30), (19_980, 60), (30_000, 10)):
        got = ordered.page(df, order, offset, size).orderBy(*ordered.order_columns(order)).select("id").collect()
        assert got == whole[offset : offset + size]
    if name in ("v", "d", "t"):
        rows, before = ordered.page_span(df, name, rising, 9_990, 30)
        assert rows.count() < 2_000 and 8_500 < before <= 9_990


def test_quantiles_with_nan_and_infinities(spark):
    rows = [(x,) for x in [float("nan"), 1.0, 2.0, 3.0, None]]
    df = spark.createDataFrame(rows, "v double")
    got = {r.prob: (r.n, r.value) for r in ordered.exact_quantiles(df, ["v"], [0.25, 0.5, 1.0]).collect()}
    assert got == {0.25: (3, 1.5), 0.5: (3, 2.0), 1.0: (3, 3.0)}
    (row,) = quality.iqr_outliers(df, ["v"]).collect()
    assert (row.q1, row.q3, row.value_count, row.outlier_count, row.nan_count) == (1.5, 2.5, 3, 0, 1)
    (row,) = quality.numeric_profile(df, ["v"]).collect()
    assert (row.min_value, row.max_value, row.avg_value, row.nan_count) == (1.0, 3.0, 2.0, 1)
    inf = float("inf")
    wide = spark.createDataFrame([(x,) for x in [-inf, inf, inf, float("nan")] + [float(i) for i in range(97)]], "v double")
    got = {r.prob: r.value for r in ordered.exact_quantiles(wide, ["v"], [0.0, 0.5, 1.0]).collect()}
    assert got[0.0] == -inf and got[1.0] == inf and got[0.5] == sorted([-inf, inf, inf, *range(97)])[49] / 2 + sorted([-inf, inf, inf, *range(97)])[50] / 2
    (row,) = quality.iqr_outliers(wide, ["v"]).collect()
    assert (row.outlier_count, row.nan_count) == (3, 1)


def test_quantiles_share_one_shuffle_and_merge_in_many_tasks(spark):
    df = spark.range(5000).select((F.col("id") % 997).cast("double").alias("a"), F.rand(1).alias("b"))
    plan = ordered.exact_quantiles(df, ["a", "b"], [0.25, 0.75])._jdf.queryExecution().executedPlan().toString()
    assert "SinglePartition" not in plan
    sketches = ordered.quantile_sketches(df, {"a": F.col("a"), "b": F.col("b")})._jdf.queryExecution().executedPlan().toString()
    assert "SinglePartition" not in sketches


@pytest.mark.parametrize("accuracy", [10, 100, 8192])
def test_exact_quantiles(spark, accuracy):
    df = spark.range(2000).select(
        (F.col("id") * 7919 % 2003 / 7.0).alias("a"), (F.col("id") % 3).alias("b"), F.when(F.col("id") < 0, 1.0).alias("c")
    )
    probs = [0.0, 0.2, 0.25, 0.5, 0.75, 0.9, 1.0]
    want = df.agg(*[F.percentile(c, probs).alias(c) for c in ("a", "b")]).first()
    got = {(r.field, r.prob): r.value for r in ordered.exact_quantiles(df, ["a", "b", "c"], probs, accuracy).collect()}
    for c in ("a", "b"):
        for p, w in zip(probs, want[c]):
            assert got[(c, p)] == w
    assert not any(k[0] == "c" for k in got)
