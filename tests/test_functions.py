"""Column builders on hand-made values."""

from pyspark.sql import functions as F

from plumbline.functions import columns as C, paths as P
from plumbline.functions.fixed import FAMILY_DEFAULT


def values(spark, expression, inputs, schema="x string"):
    df = spark.createDataFrame([(v,) if not isinstance(v, tuple) else v for v in inputs], schema)
    return [r[0] for r in df.select(expression).collect()]


def test_blank_handling(spark):
    inputs = [None, "", "  ", " a ", "无", "é"]
    assert values(spark, C.blank_to_null("x"), inputs) == [None, None, None, "a", "无", "é"]
    assert values(spark, C.blank_to_null("x", upper=True), [" ab"]) == ["AB"]
    assert values(spark, C.blank_to_label("x"), inputs)[:4] == ["无", "无", "无", "a"]
    assert values(spark, C.blank_to_empty_mark("x"), [None, " "]) == ["<<EMPTY>>", "<<EMPTY>>"]
    assert values(spark, C.non_blank("x"), inputs) == [False, False, False, True, True, True]
    assert values(spark, C.is_blank("x"), [None, "a"]) == [True, False]


def test_number_cleansing(spark):
    inputs = ["￥12.50", "1,234.00", "--", "", None, "1-2", " -3 ", ".", "abc"]
    assert values(spark, C.to_number("x"), inputs) == [12.5, 1234.0, None, None, None, None, -3.0, None, None]


def test_time_prefix(spark):
    assert values(spark, C.time_prefix("x", 10), ["2024-01-02 03:04:05", " ", None]) == ["2024-01-02", None, None]
    assert values(spark, C.time_prefix("x", 13), ["2024-01-02 03:04:05"]) == ["2024-01-02 03"]


def test_buckets(spark):
    counts = [1, 2, 5, 6, 10, 11, 20, 21]
    expected = ["1", "2-5", "2-5", "6-10", "6-10", "11-20", "11-20", "21+"]
    assert values(spark, C.bucket("x", C.TARGET_BUCKETS), counts, "x int") == expected
    days = values(spark, C.bucket("x", C.DAY_BUCKETS), [1, 3, 7, 15, 16], "x int")
    assert days == ["1天", "2-3天", "4-7天", "8-15天", "16天以上"]
    positions = values(spark, C.bucket_position("x", C.DAY_BUCKETS), days)
    assert positions == [1, 2, 3, 4, 5]


def test_flags(spark):
    assert values(spark, C.keyword_flag("x", "主图", "是", "否"), ["a主图b", "a", None]) == ["是", "否", "否"]
    assert values(spark, C.published_flag("x"), ["2024", " "]) == ["已发", "未发"]
    pairs = [(2, 1), (1, 2), (2, 2), (None, 1)]
    assert values(spark, C.orientation("a", "b"), pairs, "a int, b int") == ["横屏", "竖屏", "方图", "未知"]
    assert values(spark, C.contains_any(["x"], "10%_\\"), ["a10%_\\b", "a10b", None]) == [True, False, False]


def test_ratio_and_percent_of_nothing(spark):
    df = spark.createDataFrame([(0, 0)], "a int, b int")
    row = df.select(C.ratio(F.col("a"), F.col("b")).alias("r"), C.percent(F.col("a"), F.col("b")).alias("p")).first()
    assert row.r is None and row.p == 0.0


def test_masking_is_stable(spark):
    a, b, c = values(spark, C.mask_id("x", "s"), ["u1", "u1", "u2"])
    assert a == b != c and len(a) == 64


def test_path_normalising(spark):
    inputs = [r"a\b//c", " /a/ /b/ ", None, "", "///"]
    assert values(spark, P.normalize_path("x"), inputs) == ["a/b/c", "a/ /b", "", "", ""]
    assert values(spark, P.segments("x"), [r"\a\ b /", " / / ", None]) == [["a", "b"], [], []]


def test_standard_path_and_extension(spark):
    cases = [("d", "f.JPG", "x/y.mp4"), (" ", "f", "x/y.mp4"), ("d", None, "x/y"), (None, None, None)]
    schema = "folder string, file string, full string"
    path = P.standard_path("folder", "file", "full")
    assert values(spark, path, cases, schema) == ["d\\f.JPG", "x/y.mp4", "x/y", None]
    assert values(spark, P.extension(path), cases, schema) == ["jpg", "mp4", "", None]
    family = P.suffix_family(P.extension(path))
    assert values(spark, family, cases, schema) == ["image", "video", "none", "other"]
    name = P.standard_file_name("file", path)
    assert values(spark, name, cases, schema) == ["f.JPG", "f", "y", None]
    conflict = P.basename_conflict("full", "file")
    assert values(spark, conflict, [("", "a.jpg", "x\\A.JPG"), ("", "b", "x/a"), ("", None, "x")], schema) == [
        False, True, False,
    ]


def test_url_forms(spark):
    assert values(spark, P.url_decode("x"), ["a%20b+c", "%zz", "%e4%b8%ad", None]) == ["a b+c", "%zz", "中", None]
    assert values(spark, P.compact_signature("x"), ["/a//b%2Fc\\d", None]) == ["abcd", ""]
    assert values(spark, P.decoded_file_name("x"), ["a/b%2Fc.jpg", "x\\y"]) == ["c.jpg", "y"]
    assert values(spark, P.has_percent_encoding("x"), ["a%2F", "100%", None]) == [True, False, False]
    assert values(spark, P.has_separator("x"), ["a\\b", "ab", None]) == [True, False, False]


def test_labels_first_pattern_wins(spark):
    inputs = ["天猫旗舰店", "主图", "唯品仓", "jd自营", "APDDB", "x PDD y", " ", None, "其他"]
    expected = ["天猫", None, "唯品会", "京东", None, "拼多多", None, None, None]
    assert values(spark, P.canonical_label("x"), inputs) == expected


def test_family_order(spark):
    inputs = ["凉鞋", "短裤套装", "连衣裙", "长袖套装", "外套", "网球拍", "泳帽", "水壶", "??"]
    expected = ["鞋靴", "裤装", "裙装/内衣/泳装", "套装", "上装", "球拍球线/器材", "裙装/内衣/泳装", "配件/护具/包袜", FAMILY_DEFAULT]
    assert values(spark, P.family_bucket("x"), inputs) == expected


def test_cascade_prefers_paths(spark):
    cases = [("a/抖音主图/b", "天猫"), ("a/b", "天猫x"), (None, None), ("a\\天猫", None)]
    got = values(
        spark, P.platform_cascade([("path", ["抖音", "天猫"])], "label", ["抖音", "天猫"]), cases, "path string, label string"
    )
    assert got == ["抖音", "天猫", None, "天猫"]


def test_blanks_of_every_script_are_stripped(spark):
    df = spark.createDataFrame([("\u3000a\u3000/\u3000/ b\u2003",)], "p string")
    row = df.select(P.segments("p").alias("s"), P.strip("p").alias("t")).first()
    assert row.s == ["a", "b"] and row.t == "a\u3000/\u3000/ b"


def test_strip_takes_blanks_of_every_script(spark):
    codes = [c for c in range(1, 0x3100) if not 0xD800 <= c < 0xE000]
    df = spark.createDataFrame([(c, f"{chr(c)} a{chr(c)}b {chr(c)}") for c in codes] + [(-1, None), (-2, ""), (-3, "　 ")], "c int, t string")
    got = df.select("c", P.strip("t").alias("got"), F.regexp_replace("t", r"(?U)^\s+|\s+$", "").alias("want")).collect()
    assert all(r.got == r.want for r in got)
