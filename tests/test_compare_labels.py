"""Comparison, gap, label and rule operators on hand-made frames."""

import random

import pytest
from pyspark.sql import functions as F

from plumbline.functions.fixed import ADD, MERGE, RULE_ALIAS, RULE_TARGET, RULE_UNCOVERED
from plumbline.operators import compare, labels


@pytest.fixture(scope="module")
def links(spark):
    child = spark.createDataFrame(
        [("a", "1"), ("a", "1"), ("b", "1"), ("c", "2"), ("c", "2"), (" ", "1"), (None, "9"), ("a", None)], "k string, k2 string"
    )
    parent = spark.createDataFrame([("a", "1", "2024"), ("b", "2", " "), ("b", "2", "2020"), ("z", "1", "2030")], "k string, k2 string, t string")
    return child, parent


def test_backlinks(links, rows):
    child, parent = links
    one = compare.backlink_check(child, parent, ["k"]).first()
    assert (one.unmatched_rows, one.unmatched_keys, one.unmatched_rate_pct) == (2, 1, 25.0)
    two = compare.backlink_check(child, parent, ["k", "k2"]).first()
    assert (two.unmatched_rows, two.unmatched_keys) == (3, 2)
    assert rows(compare.backlink_samples(child, parent, ["k"], [F.asc("k")], 1)) == [{"k": "c", "k2": "2"}]
    empty = compare.backlink_check(child.limit(0), parent, ["k"]).first()
    assert (empty.unmatched_rows, empty.unmatched_rate_pct) == (0, 0.0)


def test_backlink_plan_is_an_anti_join(links):
    child, parent = links
    plan = compare.backlink_samples(child, parent, ["k"], [F.asc("k")])._jdf.queryExecution().optimizedPlan().toString()
    assert "LeftAnti" in plan


def test_expansion_overlap_freshness(links):
    child, parent = links
    dup = compare.duplicate_expansion(child, "k", [F.asc("k2")], keys=1).collect()
    assert [r.k for r in dup] == ["a", "a", "a"] and dup[0].dup_cnt == 3
    one = compare.entity_overlap(child, parent, "k").first()
    assert (one.left_entities, one.matched_entities) == (3, 2)
    fresh = compare.proxy_freshness(child, parent, "k", "t").first()
    assert tuple(fresh) == ("2020", "2024")


def test_table_consistency(spark):
    schema = "id string, session string, shop string, pay double"
    left = spark.createDataFrame(
        [("1", "s", "x", 10.0), ("2", "s", "x", 5.0), ("2", "s2", "x", 5.0), ("3", "s", None, 1.0), ("4", "s", "x", 1.0), ("only", "s", "x", 1.0)],
        schema,
    )
    right = spark.createDataFrame(
        [("1", "s", "x", 10.004), ("2", "s", "x", 10.02), ("3", "s", None, 1.0), ("4", "t", "y", 1.0), (None, "s", "x", 1.0)], schema
    )
    got = compare.table_consistency(left, right, "id", ["session", "shop"], "pay").first()
    assert (got.left_entities, got.right_entities, got.overlap_entities) == (5, 4, 4)
    # id 2 has two sessions on the left; id 3 has no shop on either side
    assert (got.exact_session_match, got.exact_shop_match) == (2, 2)
    assert got.exact_pay_match == 3  # sums are rounded to cents before they are compared
    bad = [r.id for r in compare.mismatch_samples(left, right, "id", ["session", "shop"], "pay").collect()]
    assert bad == ["2", "4"]


@pytest.fixture(scope="module")
def joined(spark):
    ref = spark.createDataFrame([("1", "m1", "t1"), ("1", " ", "t2"), ("2", "m2", None), ("3", "m3", "t3"), (" ", "m", "t")], "spu string, mid string, track string")
    src = spark.createDataFrame([("1", "m1", ""), ("2", "m2", "t")], "spu string, mid string, sub string")
    res = spark.createDataFrame([(" 1 ", None, "t1"), ("9", "m", "t")], "spu string, mid string, first string")
    layers = [(ref, "spu", {"mid": "mid", "track": "track"}), (src, "spu", {"mid": "mid", "track": "sub"}), (res, "spu", {"mid": "mid", "track": "first"})]
    return layers, compare.layer_join(*layers)


def test_layer_gap(joined, by):
    got = compare.layer_gap(joined[1], ["mid", "track"]).first().asDict()
    assert got == {
        "ref_entities": 3, "ref_with_mid": 3, "ref_with_track": 2, "hit_source": 2, "hit_result": 1,
        "missing_mid_in_source": 1, "missing_track_in_source": 2, "missing_mid_in_result": 3, "missing_track_in_result": 1,
        "any_gap_in_source": 2, "any_gap_in_result": 2,
    }
    detail = by(compare.layer_gap_detail(joined[1], ["mid", "track"]), "entity")
    assert detail["1"]["ref_track"] == "t2" and detail["2"]["missing_track_in_source"] == 0
    assert detail["3"]["src_rows"] == 0


def test_value_and_pair_gap(joined, by, rows):
    (ref, src, res) = [frame for frame, _, _ in joined[0]]
    got = by(compare.value_gap((ref, "mid"), (src, "mid"), (res, "mid"), "mid"), "mid")
    assert got["m1"] == {"mid": "m1", "missing_in_source": 0, "missing_in_result": 1}
    assert set(got) == {"m", "m1", "m2", "m3"} and got["m"]["missing_in_result"] == 0
    pairs = by(compare.pair_gap((ref, ["mid", "track"], "spu"), (src, ["mid", "sub"]), (res, ["mid", "first"]), ["mid", "track"]), "mid")
    assert pairs["m3"]["ref_entities"] == 1 and set(pairs) == {"m1", "m3"}


def test_enum_gap(spark, by, rows):
    data = [("a", "a", "s1"), ("b", "a", "s1"), (" b", "c", "s2"), ("", "c", "s2"), (None, "c", None)]
    df = spark.createDataFrame(data, "target string, ref string, spu string")
    sides = compare.enum_sides(df, "target", "ref", "spu")
    assert tuple(compare.enum_gap_summary(sides).first()) == (2, 2, 1, 1)
    got = by(compare.enum_gap_values(sides), "enum_value")
    assert (got["c"]["gap"], got["c"]["row_count"], got["c"]["entity_count"]) == ("missing_in_target", 3, 1)
    assert (got["b"]["gap"], got["b"]["row_count"], got["b"]["entity_count"]) == ("extra_in_target", 2, 2)
    sample = compare.enum_gap_samples(df, "extra_in_target", compare.enum_gap_values(sides), "target", "ref", ["spu"], [F.asc("spu")], 1)
    assert rows(sample) == [{"spu": "s1", "reference_value": "a", "target_value": "b"}]


def test_enum_coverage(spark, by):
    first = spark.createDataFrame([("x", "2", "f1"), ("x", "1", "f2"), ("x", "1", "f1"), ("y", "1", "f")], "v string, spu string, file string")
    source = spark.createDataFrame([("x", "1")], "v string, spu string")
    final = spark.createDataFrame([("y", "1")], "v string, spu string")
    got = by(compare.enum_coverage(first, source, final, "v", "spu", ["spu", "file"], [F.asc("spu"), F.asc("file")]), "enum_value")
    x = got["x"]
    assert set(got) == {"x"} and (x["first_row_count"], x["first_entity_count"], x["source_row_count"]) == (3, 2, 1)
    assert (x["sample_spu_1"], x["sample_file_1"], x["sample_file_2"]) == ("1", "f1", "f2")


def default_frames(spark, n, seed):
    rnd = random.Random(seed)
    target = [(str(i), rnd.choice(["", "a", "A ", "b", "c", "d", "e", "f", "g"]), rnd.choice(["无", "无", " 无", "男", None])) for i in range(n)]
    dim = [("A", None, "女"), ("b", " ", None), ("C", "无", "女"), ("d", "老年", "女"), ("e", "女", "女"), ("e", "男", "女"), (" ", "女", "女")]
    return (
        spark.createDataFrame(target, "file_id string, spu string, gender string"),
        spark.createDataFrame(dim, "spu string, used string, alt string"),
    )


@pytest.mark.parametrize("seed", [1, 2])
def test_default_causes_add_up(spark, by, seed):
    target, dim = default_frames(spark, 300, seed)
    args = (target, dim, "spu", "gender", "used", "alt", ["男", "女"])
    summary = by(compare.default_value_summary(*args), "root_cause")
    detail = compare.default_value_causes(*args, row_id="file_id")
    affected = target.where("trim(gender) = '无' and trim(spu) <> ''").count()
    assert sum(r["row_cnt"] for r in summary.values()) == detail.count() == affected
    assert {r["root_cause"]: r["count"] for r in detail.groupBy("root_cause").count().collect()} == {
        k: v["row_cnt"] for k, v in summary.items()
    }
    assert set(summary) == {
        "NO_DIMENSION_MATCH", "ALTERNATIVE_PRESENT_BUT_USED_EMPTY", "BOTH_EMPTY", "USED_IS_DEFAULT", "UNMAPPED_VALUE", "OTHER",
    }
    few = compare.stratified_samples(detail, "root_cause", [F.asc("file_id")], 3)
    assert max(r["count"] for r in few.groupBy("root_cause").count().collect()) == 3


def test_frame_diff(spark, by):
    a = spark.createDataFrame([(1, "x", 1.0), (2, "y", 2.0), (3, None, None), (4, "z", 4.0)], "k int, s string, v double")
    b = spark.createDataFrame([(1, "x", 1.0 + 1e-8), (2, "q", 2.1), (3, None, None), (5, "z", 4.0)], "k int, s string, v double")
    got = by(compare.frame_diff(a, b, ["k"], ["v"]), "k")
    assert {k: r["difference"] for k, r in got.items()} == {2: "values_differ", 4: "only_left", 5: "only_right"}
    assert got[2]["columns"] == "s,v"
    assert compare.frame_diff(a, a, ["k"]).count() == 0
    assert compare.exact_diff(a, a.unionByName(a.limit(1))).count() == 1


def test_frames_with_other_columns_null_keys_and_repeated_keys(spark):
    a = spark.createDataFrame([(1, "x"), (None, "n"), (2, "y"), (2, "z")], "k int, v string")
    b = a.withColumn("more", F.lit(1))
    got = {(r.k, r.difference, r.columns) for r in compare.frame_diff(a, b, ["k"]).collect()}
    assert got == {(2, "repeated_key", None), (None, "column_only_right", "more")}
    assert {r.difference for r in compare.frame_diff(b, a, ["k"]).collect()} == {"repeated_key", "column_only_left"}
    c = a.where("v = 'n'").withColumn("v", F.lit("m"))
    (row,) = compare.frame_diff(a.where("v = 'n'"), c, ["k"]).collect()
    assert (row.k, row.difference, row["columns"]) == (None, "values_differ", "v")
    assert compare.exact_diff(a, b).count() == 8 and compare.exact_diff(a, a).count() == 0


def test_infinite_and_missing_floats(spark, by):
    inf, nan = float("inf"), float("nan")
    a = [(0, inf), (1, inf), (2, nan), (3, nan), (4, None), (5, None), (6, 1e308), (7, 0.0), (8, -inf), (9, 1e9)]
    b = [(0, inf), (1, 5.0), (2, nan), (3, 1.0), (4, None), (5, 0.0), (6, -1e308), (7, -0.0), (8, inf), (9, 1e9 + 1)]
    left, right = (spark.createDataFrame(rows, "k int, v double") for rows in (a, b))
    assert set(by(compare.frame_diff(left, right, ["k"], ["v"]), "k")) == {1, 3, 5, 6, 8}
    assert set(by(compare.frame_diff(left, right, ["k"]), "k")) == {1, 3, 5, 6, 8, 9}


def test_maps_are_compared_by_their_entries(spark, by):
    def frame(entries):
        rows = [(i, e, [e] if e else None) for i, e in enumerate(entries)]
        return spark.createDataFrame(rows, "k int, m map<string, int>, deep array<map<string, int>>")

    a, b = frame([{"x": 1, "y": 2}, {"x": 1}, None, {"z": None}]), frame([{"y": 2, "x": 1}, {"x": 2}, None, {}])
    got = by(compare.frame_diff(a.drop("deep"), b.drop("deep"), ["k"]), "k")
    assert {k: r["columns"] for k, r in got.items()} == {1: "m", 3: "m"}
    assert by(compare.frame_diff(a, b, ["k"]), "k")[1]["columns"] == "m,deep"
    assert compare.frame_diff(a, a, ["m"]).count() == compare.frame_diff(a, a, ["k"]).count() == compare.exact_diff(a, a).count() == 0
    assert sorted(r.k for r in compare.exact_diff(a.drop("deep"), b.drop("deep")).collect()) == [1, 1, 3, 3]


@pytest.mark.parametrize("buckets", [1, 7, 1 << 16])
def test_differences_whatever_the_buckets(spark, buckets):
    draw = random.Random(buckets)
    a = [(draw.randrange(60), draw.choice("xyz"), draw.choice([1.0, 2.0, None])) for _ in range(50)]
    b = [r if draw.random() < 0.9 else (r[0], "q", r[2]) for r in a[:-3]] + [(draw.randrange(70), "n", None) for _ in range(4)]
    left, right = (spark.createDataFrame(rows, "k int, s string, v double") for rows in (a, b))
    want = set()
    for k in {r[0] for r in a + b}:
        x, y = ([r for r in rows if r[0] == k] for rows in (a, b))
        if not x or not y:
            want.add((k, "only_right" if y else "only_left", None))
        elif len(x) > 1 or len(y) > 1:
            want.add((k, "repeated_key", None))
        elif x != y:
            want.add((k, "values_differ", ",".join(c for c, p, q in zip("sv", x[0][1:], y[0][1:]) if p != q)))
    assert {tuple(r) for r in compare.frame_diff(left, right, ["k"], buckets=buckets).collect()} == want
    rows = compare.exact_diff(left, right, buckets).collect()
    assert {(r.k, r.s, r.v): (r.left_rows, r.right_rows) for r in rows} == {
        t: (a.count(t), b.count(t)) for t in set(a + b) if a.count(t) != b.count(t)
    }


def test_equal_frames_shuffle_no_rows(spark):
    """Only checksums leave their tasks; the full rows are below the semi join with the buckets that differ."""
    df = spark.range(1000).select("id", F.lit("wide text").alias("t"))
    plan = compare.frame_diff(df, df, ["id"], unique_keys=True)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("LeftSemi") == 2 and plan.count("bit_xor") >= 2 and "LeftAnti" not in plan
    for part in plan.split("any_value(")[1:]:
        assert "LeftSemi" in part


def test_gap_class_order(spark, by):
    v = spark.createDataFrame([(i,) for i in range(5)], "value int")
    layers = {n: v.where(F.col("value") > i) for i, n in enumerate(["source", "result", "reference", "rules"])}
    got = by(compare.gap_classification(v, layers), "value")
    assert [got[i]["gap_class"] for i in range(5)] == [
        "missing_in_source", "lost_in_result", "absent_from_reference", "uncovered_by_rules", "complete",
    ]


# --- labels ------------------------------------------------------------------

PATHS = [
    ("1", "天猫", "root/天猫旗舰店/x/a.jpg", ""),
    ("2", "抖音", "root/京东/a.jpg", ""),
    ("3", "杂项", "root/快手/a.jpg", ""),
    ("4", "杂项", "root/a.jpg", None),
    ("5", "淘宝", "root/a.jpg", ""),
    ("6", " ", "root\\得物\\a.jpg", ""),
    ("7", None, "root/a.jpg", ""),
    ("8", None, "root/主图/唯品仓.jpg", ""),
    ("9", None, "快手/天猫/x/抖音.jpg", "小红书/y/z/京东"),
]


@pytest.fixture(scope="module")
def best(spark):
    df = spark.createDataFrame(PATHS, "id string, explicit string, p string, q string")
    return labels.best_hits(df, ["p", "q"])


def test_best_hit_choice(best, by):
    got = by(best, "id")
    assert got["8"]["hit"]["label"] == "唯品会" and got["8"]["hit"]["is_last"]  # only the file name has one
    hit = got["9"]["hit"]
    assert (hit["label"], hit["path_field"], hit["depth_from_leaf"], hit["depth_from_root"]) == ("天猫", "p", 3, 2)
    assert got["7"]["hit"] is None


def test_consistency_classes(best, by):
    got = by(labels.label_consistency(best, "explicit"), "id")
    assert [got[str(i)]["consistency"] for i in range(1, 8)] == [
        "explicit_match_path", "explicit_conflict_path", "explicit_dirty_path_has_platform", "explicit_dirty_no_path_hit",
        "explicit_only", "path_only", "neither",
    ]
    plan = best._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Python" not in plan


def test_hit_statistics_add_up(best):
    stats = labels.hit_statistics(best).groupBy("statistic").agg(F.sum("row_count").alias("n")).collect()
    assert {r.statistic: r.n for r in stats} == dict.fromkeys(["field", "field_label", "label_root_depth", "label_leaf_depth"], 6)
    advice = labels.label_recommendation(labels.hit_statistics(best))
    assert advice.where("statistic = 'field'").first().path_field == "p"


def test_segments(best, by):
    got = labels.segment_hits(best, ["id"], ["p", "q"]).where("id = '9'")
    assert {(r.label, r.path_field, r.depth_from_root) for r in got.collect()} == {
        ("快手", "p", 1), ("天猫", "p", 2), ("抖音", "p", 4), ("小红书", "q", 1), ("京东", "q", 4),
    }


def test_null_reasons(spark, by):
    data = [
        ("1", "图片", None, None), ("2", "图片", "", "a/抖音"), ("3", "视频", "a/京东/b", None), ("4", "视频", "a/b", None),
        ("5", "视频", " / / ", None), ("6", "图片", "a/白底图x/b", None), ("7", "图片", "a/b", None), ("8", None, "主图/天猫", None),
        ("9", "图片", "  ", "a/抖音"),
    ]
    df = spark.createDataFrame(data, "id string, type string, full_path string, other string")
    got = {k: (r["reason"], r["evidence_segment"]) for k, r in by(labels.null_reason(df, "type", "full_path", "other"), "id").items()}
    assert got == {
        "1": ("NO_PATH", None),
        "2": ("IMAGE_PATH_HAS_PLATFORM_BUT_SQL_MISSED", "抖音"),
        "3": ("VIDEO_PATH_HAS_PLATFORM_BUT_SQL_NOT_MINING", "京东"),
        "4": ("VIDEO_PATH_NO_PLATFORM_SEGMENT", "b"),
        "5": ("VIDEO_NO_PLATFORM_SEGMENT", None),
        "6": ("IMAGE_ONLY_CONTENT_SEGMENTS", None),
        "7": ("IMAGE_NO_PLATFORM_SEGMENT", "b"),
        "8": ("IMAGE_PATH_HAS_PLATFORM_BUT_SQL_MISSED", "天猫"),
        "9": ("NO_PATH", None),
    }


def test_priority_dedup_with_ties(spark, rows):
    data = [("a", 2, "z"), ("a", 1, "x"), ("a", 1, "y"), (" ", 1, "x"), (None, 1, "x")]
    df = spark.createDataFrame(data, "k string, p int, path string")
    assert rows(labels.priority_dedup(df, "k", [F.asc("p"), F.desc("path")])) == [{"k": "a", "p": 1, "path": "y"}]


def test_rules_and_action_plan(spark, by):
    values = spark.createDataFrame(
        [("跑步鞋", 9, 3), ("T恤", 5, 2), ("短袖", 4, 2), ("长裤", 3, 1), ("裙类", 2, 1), ("上衣x", 2, 1), ("套装y", 2, 1), ("??", 1, 1)],
        "enum_value string, row_count long, entity_count long",
    )
    table = spark.createDataFrame([("T恤", "T恤"), ("短袖", "T恤"), ("跑鞋", "跑步鞋类")], "alias string, target string")
    final = spark.createDataFrame([("板鞋", 5, 1), ("拖鞋", 9, 1), ("球", 1, 1)], "enum_value string, final_row_count long, final_entity_count long")
    cover = labels.rule_coverage(values, table, final, peers=1)
    got = by(cover, "enum_value")
    assert (got["T恤"]["rule_status"], got["短袖"]["rule_status"], got["长裤"]["rule_status"]) == (RULE_TARGET, RULE_ALIAS, RULE_UNCOVERED)
    assert got["短袖"]["suggested_target"] == "T恤" and got["跑步鞋"]["same_family_values"] == "拖鞋"
    total = labels.rule_coverage_summary(cover).first()
    assert total.target_defined_count + total.alias_defined_count + total.uncovered_count == total.value_count == 8
    decisions = spark.createDataFrame(
        [("长裤", "merge", "运动裤类", "medium", "r"), ("裙类", "add", "裙类", "high", "r"), ("T恤", "add", "T恤", "low", "ignored")],
        "enum_value string, kind string, proposed_enum string, confidence string, reason string",
    )
    plan = by(labels.action_plan(cover, decisions), "enum_value")
    picked = {k: (r["action_bucket"], r["proposed_enum"], r["confidence"]) for k, r in plan.items()}
    assert picked == {
        "T恤": (MERGE, "T恤", "high"), "长裤": (MERGE, "运动裤类", "medium"), "裙类": (ADD, "裙类", "high"), "跑步鞋": (MERGE, "运动生活鞋类", "low"),
        "上衣x": (MERGE, "外套", "low"), "套装y": (MERGE, "套装类", "medium"), "??": (ADD, "??", "low"), "短袖": (ADD, "短袖", "low"),
    }
    s = labels.action_summary(labels.action_plan(cover, decisions)).first()
    assert s.add_candidate_count + s.merge_candidate_count == s.total_count == 8


def test_anchor_lookup_falls_back(spark):
    info = spark.createDataFrame([("1", "n1", "x/key/y"), ("2", "n2", "other")], "file_id string, file_name string, folder string")
    down = spark.createDataFrame([("1", "a", "p"), ("1", "b", "p"), ("5", "n1", "p"), ("6", "c", "has key")], "file_id string, name string, path string")

    def hits(frame, keyword):
        found = labels.anchor_lookup({"info": (frame, ["folder"])}, "info", "file_id", "file_name", {"down": (down, "file_id", "name", ["name", "path"])}, keyword)
        return {r.layer: r.matched_rows for r in labels.layer_hits(found).collect()}

    assert hits(info, "key") == {"info": 1, "down": 2}
    assert hits(info.withColumn("file_id", F.lit("")), "key") == {"info": 1, "down": 1}
    assert hits(info.where("file_id = '2'"), "key") == {"info": 0, "down": 1}


def test_value_forms(spark, by):
    df = spark.createDataFrame([("a/b c.jpg", "a%2Fb%20c.jpg", "ab c.jpg")], "ods string, dws string, dim string")
    forms = None
    for layer in ("ods", "dws", "dim"):
        one = labels.value_forms(df, layer, [layer], "a/b%20c.jpg")
        forms = one if forms is None else forms.unionByName(one)
    got = by(labels.form_summary(forms), "layer")
    assert all(r["compact_match_rows"] == 1 and r["display_only"] for r in got.values())
    assert (got["ods"]["decoded_match_rows"], got["dim"]["decoded_match_rows"], got["dim"]["plain_rows"]) == (1, 0, 1)


def test_the_last_rule_of_an_alias_counts(spark):
    values = spark.createDataFrame([("x",), ("y",)], "enum_value string")
    rules = spark.createDataFrame([("x", "zz", 1), ("x", "aa", 3), ("x", "mm", 2), ("y", "b", 5), ("y", "c", 5)], "alias string, target string, line int")
    got = {r.enum_value: r.suggested_target for r in labels.rule_coverage(values, rules, order="line").collect()}
    assert got == {"x": "aa", "y": "c"}
    assert {r.enum_value: r.suggested_target for r in labels.rule_coverage(values, rules).collect()} == {"x": "zz", "y": "c"}
