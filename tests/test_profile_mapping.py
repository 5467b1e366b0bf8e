"""Profiles, distributions, mapping cardinality and grain on hand-made frames."""

import math
import random

import pytest
from pyspark.sql import functions as F

from plumbline.operators import mapping, profile
from plumbline.sources.tables import LogicalField, canonical


@pytest.fixture(scope="module")
def orders(spark):
    data = [("shop1", f"sp{n}", f"k{n}-{i}", f"2024-01-{i + 1:02d}") for n in (1, 3, 8, 15, 25) for i in range(n)]
    data += [("shop1", "SP3", "k3-0", "2024-01-01"), ("shop1", None, "x", ""), ("shop2", " ", "y", None), ("", "sp1", None, "2024-02-01")]
    raw = spark.createDataFrame(data, "shop string, spu string, sku string, pay_time string")
    return canonical(
        raw,
        [
            LogicalField("shop_id", ["erp_shop_id", "shop"]),
            LogicalField("spu", ["spu"], "upper"),
            LogicalField("sku_id", ["sku_id", "sku"]),
            LogicalField("pay_date", ["pay_time"], "day"),
            LogicalField("anchor", ["anchor_id"]),
        ],
    )


def test_canonical_binds_and_fills(orders):
    assert orders.columns == ["shop_id", "spu", "sku_id", "pay_date", "anchor"]
    assert orders.where("anchor is not null").count() == 0
    assert orders.where("spu = 'SP3'").count() == 4


def test_mapping_summary(orders, by):
    got = by(mapping.mapping_summary(orders, [("spu_to_sku", "spu", "sku_id"), ("spu_to_anchor", "spu", "anchor")]), "pair_name")
    assert set(got) == {"spu_to_sku"}
    r = got["spu_to_sku"]
    assert (r["source_key_count"], r["covered_rows"], r["max_target_per_source"]) == (5, 53, 25)
    assert (r["avg_target_per_source"], r["p50_target_per_source"], r["p90_target_per_source"]) == (10.4, 8, 25)
    assert (r["multi_mapping_source_keys"], r["multi_mapping_ratio"]) == (4, 0.8)


def test_mapping_buckets(orders):
    pairs = [("spu_to_sku", "spu", "sku_id"), ("spu_to_day", "spu", "pay_date")]
    got = mapping.mapping_buckets(orders, pairs, ["spu_to_day"]).orderBy("pair_name", "bucket_order").collect()
    sku = [(r.target_bucket, r.source_key_count) for r in got if r.pair_name == "spu_to_sku"]
    assert sku == [("1", 1), ("2-5", 1), ("6-10", 1), ("11-20", 1), ("21+", 1)]
    day = {r.target_bucket: r.source_key_count for r in got if r.pair_name == "spu_to_day"}
    assert day == {"2-3天": 2, "8-15天": 2, "16天以上": 1}
    assert sum(r.source_key_ratio for r in got if r.pair_name == "spu_to_sku") == pytest.approx(1.0)


def test_mapping_samples(orders, by):
    got = by(mapping.mapping_samples(orders, [("p", "spu", "sku_id")], n=2, targets=3), "source_value")
    assert got["SP25"]["target_samples"] == "k25-0 | k25-1 | k25-10" and set(got) == {"SP25", "SP15"}
    ends = by(mapping.mapping_range_samples(orders, [("p", "spu", "sku_id")], n=1), "source_value")
    assert ends["SP25"]["target_samples"] == "k25-0 | k25-9"


def test_all_pairs_equal_single_pairs(spark):
    df = spark.range(3000).select(
        (F.col("id") % 97).alias("a"), (F.col("id") % 13).cast("string").alias("b"), (F.col("id") % 7 * 1.5).alias("c")
    )
    pairs = [("ab", "a", "b"), ("bc", "b", "c"), ("ca", "c", "a")]
    together = {r.pair_name: r for r in mapping.mapping_summary(df, pairs).collect()}
    for name, s, t in pairs:
        per = df.groupBy(s).agg(F.count_distinct(t).alias("n"))
        want = per.agg(F.count("n"), F.max("n"), F.percentile_approx("n", 0.9)).first()
        r = together[name]
        assert (r.source_key_count, r.max_target_per_source, r.p90_target_per_source) == tuple(want)


def test_mapping_findings(orders):
    summary = mapping.mapping_summary(orders, [("p", "spu", "sku_id")])
    got = [r.check for r in mapping.mapping_findings(summary, {"p": 20}).collect()]
    assert sorted(got) == ["p has sources with many targets", "p is not unique"]
    assert mapping.empty_key_findings(orders, "anchor").count() == 1


def test_grain_first_in_list_wins(spark, by):
    data = [(1, "d1", "x", 10), (1, "d2", "y", 11), (2, "d1", "z", 12), (None, "d1", "q", 13), (None, "d1", "q", 14), (3, "d1", None, 15)]
    df = spark.createDataFrame(data, "product int, day string, value string, row int")
    lists = [["product"], ["product", "day"], ["row"], ["missing"]]
    got = by(mapping.grain_inference(df, "value", lists), "grain")
    assert {k for k, r in got.items() if r["is_minimal_grain"]} == {"product+day"}
    assert (got["product"]["key_count"], got["product"]["max_distinct_per_key"]) == (3, 2)
    assert (got["product+day"]["key_count"], got["row"]["max_distinct_per_key"]) == (4, 1)
    none = by(mapping.grain_inference(df, "row", [["product"], ["day"]]), "grain")
    assert not any(r["is_minimal_grain"] for r in none.values())


def test_field_availability(spark, by):
    a = spark.createDataFrame([(1, 2.0), (2, 3.0)], "id int, price double")
    b = spark.createDataFrame([(1, "x")], "id int, color string")
    specs = [
        {"name": "price", "table": "a", "exact": ["price"], "approx": ["id"]},
        {"name": "color", "table": "a", "exact": ["color"], "fallback": [("b", ["color"])]},
        {"name": "cost", "table": "a", "exact": ["cost"], "approx": ["price"]},
        {"name": "rate", "table": "a", "derived": "sum(x)/sum(y)", "components": ["x"]},
        {"name": "gone", "table": "c"},
    ]
    got = by(mapping.field_availability({"a": a, "b": b}, specs, {"a": [["id"]]}), "field_name")
    assert [got[n]["status"] for n in ("price", "color", "cost", "rate", "gone")] == [
        "exact", "fallback", "approx_only", "missing", "table_not_found",
    ]
    assert got["price"]["grain"] == "id" and got["color"]["grain"] is None


def test_ratio_of_nothing(spark):
    df = spark.createDataFrame([(1.0, 0.0)], "a double, b double")
    assert mapping.ratio_metric(df, "a", "b").first().ratio is None


def test_field_profile_exact_and_sketch(orders, by):
    fields = {"spu": "spu", "anchor": None}
    exact = by(profile.field_profile(orders, fields, exact=True), "logical_field")
    assert (exact["spu"]["null_rows"], exact["spu"]["distinct_values"], exact["anchor"]["null_ratio"]) == (2, 5, 1.0)
    assert exact["anchor"]["physical_column"] == "未命中"
    sketch = by(profile.field_profile(orders, fields), "logical_field")
    assert sketch == exact  # few values, so the sketch is exact here


def test_distribution_cumulates(orders):
    top = profile.top_distribution(orders, "spu", 3).orderBy(F.desc("row_count"), "field_value").collect()
    assert [r.field_value for r in top] == ["SP25", "SP15", "SP8"]
    assert top[1].cumulative_probability == pytest.approx(40 / 56, abs=1e-6)
    every = profile.top_distribution(orders, "spu", None).orderBy(F.desc("row_count"), "field_value").collect()
    assert every[:3] == top and every[-1].cumulative_probability == 1.0
    stats = profile.distribution_stats(orders, "spu").first()
    assert (stats.distinct_values, stats.top1_label) == (6, "SP25")


def test_clusters(spark, by):
    data = [("e1", "a", None), ("e1", "b", "x"), ("e2", "b", "x"), ("e3", " ", ""), (" ", "a", "a")]
    df = spark.createDataFrame(data, "entity string, p string, q string")
    got = by(profile.attribute_clusters(df, "entity", ["p", "q"], None), "cluster_label")
    assert got["p=b | q=x"]["entity_count"] == 2 and got["p=无 | q=无"]["probability"] == round(1 / 3, 6)
    per_row = by(profile.row_clusters(df, {"pp": "p"}), "cluster_label")
    assert per_row["pp=a"]["row_count"] == 2


def test_overview_and_preview(orders):
    one = profile.overview(orders, ["spu", "sku_id"], times=["pay_date"], distinct_if={"paid": ("sku_id", F.col("pay_date").isNotNull())}).first()
    assert (one.total_rows, one.distinct_spu, one.min_pay_date) == (56, 5, "2024-01-01")
    assert one.distinct_sku_id == orders.select("sku_id").where("sku_id is not null").distinct().count()
    assert one.paid == one.distinct_sku_id - 2
    shops = profile.entity_preview(
        orders, {"shop_id": F.col("shop_id")}, {"skus": "sku_id", "days": "pay_date"}, [F.desc("row_count")], 5
    ).collect()
    assert (shops[0].shop_id, shops[0].row_count, shops[0].days) == ("shop1", 54, 25)
    assert {r.shop_id for r in shops} == {"shop1", "shop2", None}


def test_election_uses_evidence(spark, by):
    data = [("a_2", 10, 9, 3, 2, 500, 9), ("a", 5, 4, 1, 0, 100, 9)]
    columns = "table_name string, column_count int, matched_core_fields int, typed_time_fields int, enhancement_fields int, record_count long, distinct_entities long"
    got = by(profile.elect_base_table(spark.createDataFrame(data, columns)), "table_name")
    assert got["a_2"]["recommendation"] == "主分析底表" and got["a"]["criteria_led"] == 0


def test_field_risk(spark, by):
    df = spark.createDataFrame([("a", 90.0), ("b", 50.0), ("c", 10.0)], "field_name string, miss_rate_pct double")
    got = by(profile.field_risk(df), "field_name")
    assert {k: r["risk_level"] for k, r in got.items()} == {"a": "unusable_slice", "b": "auxiliary_only"}


@pytest.mark.parametrize("task_rows", [40, 1_000_000])
def test_grains_that_share_a_column_agree_with_plain_counts(spark, by, monkeypatch, task_rows):
    monkeypatch.setattr(mapping, "TASK_ROWS", task_rows)
    draw = random.Random(3)
    # a third of the rows has one order, a few have none
    rows = [(draw.choice([7, 7, 7, None, *range(20, 26)]), draw.choice([None, "a", " a", "b"]), draw.randrange(9), draw.choice([None, 1.0, 2.0, 3.0])) for _ in range(600)]
    df = spark.createDataFrame(rows, "o int, l string, p int, v double")
    lists = [["o"], ["o", "l"], ["p"], ["l", "o"], ["o", "l", "p"], ["p", "l"], ["gone"]]
    got = by(mapping.grain_inference(df, "v", lists), "grain")
    at = {"o": 0, "l": 1, "p": 2}
    for keys in lists[:-1]:
        seen = {}
        for r in rows:
            if r[3] is not None:
                seen.setdefault(tuple(r[at[k]].strip() if k == "l" and r[1] else r[at[k]] for k in keys), set()).add(r[3])
        sizes = sorted(map(len, seen.values()))
        one = got["+".join(keys)]
        assert (one["key_count"], one["max_distinct_per_key"]) == (len(sizes), sizes[-1])
        assert one["p50_distinct_per_key"] == sizes[math.ceil(len(sizes) * 0.5) - 1] and one["p90_distinct_per_key"] == sizes[math.ceil(len(sizes) * 0.9) - 1]
    assert len(got) == 6


def test_grains_that_share_a_column_are_dealt_once(spark):
    df = spark.range(1000).selectExpr("id % 100 AS _k0", "id % 7 AS _k1", "CAST(id AS DOUBLE) AS _value")
    dealt, rest = mapping.dealt_by(df, "_k0")
    plan = mapping.distinct_where_they_lie(dealt, "_k0", {2: ["_k0"], 0: ["_k0", "_k1"]}, ["_k0", "_k1"])
    assert rest is None and plan._jdf.queryExecution().executedPlan().toString().count("Exchange") == 1 and plan.count() == 800
