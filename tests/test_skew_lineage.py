"""Skew helpers, lineage closures and table sources."""

import random
import time

import pytest
from pyspark.sql import functions as F

from plumbline.operators import lineage, lists, ordered, quality, reach, skew
from plumbline.plans import quality_run, registered
from plumbline.sources import sinks, tables
from plumbline.sources.events import read_report_detail


@pytest.fixture(scope="module")
def hot(spark):
    # one key holds nine tenths of the rows
    return spark.range(4000).select(
        F.when(F.col("id") % 10 < 9, 0).otherwise(F.col("id") % 500 + 1).alias("k"), (F.col("id") % 13).cast("double").alias("v"), "id"
    )


def test_skew_profile_and_hot_keys(hot):
    got = skew.skew_profile(hot, "k").first()
    assert got.top_key_share == 0.9 and got.max_rows == 3600 and got.skewness > 2
    assert skew.hot_keys(hot, "k", 1).first().row_share == 0.9
    assert [r.k for r in skew.heavy_keys(hot, "k", 0.5).collect()] == [0]


def test_two_stage_equals_plain(hot):
    aggs = {"n": ("count", "*"), "s": ("sum", "v"), "lo": ("min", "v"), "hi": ("max", "v"), "mean": ("avg", "v")}
    got = {r.k: tuple(r)[1:] for r in skew.two_stage_agg(hot, ["k"], aggs, salts=8).collect()}
    plain = hot.groupBy("k").agg(F.count("*"), F.sum("v"), F.min("v"), F.max("v"), F.avg("v")).collect()
    assert got == {r.k: tuple(r)[1:] for r in plain}


@pytest.mark.parametrize("how", ["inner", "left", "left_semi", "left_anti"])
def test_salted_join_equals_plain(spark, hot, how):
    small = spark.createDataFrame([(i, f"n{i}") for i in range(0, 40, 2)] + [(0, "again")], "k long, name string")
    salted = skew.salted_join(hot, small, "k", how, salts=8, share=0.2)
    plain = hot.join(small, "k", how)
    columns = sorted(plain.columns)
    assert sorted(salted.columns) == columns
    assert sorted(map(repr, salted.select(*columns).collect())) == sorted(map(repr, plain.select(*columns).collect()))


@pytest.fixture
def fixed_partitions(spark):
    """Shuffles of 16 partitions, as they are planned."""
    old = {c: spark.conf.get(c) for c in ("spark.sql.adaptive.enabled", "spark.sql.shuffle.partitions", "spark.sql.autoBroadcastJoinThreshold")}
    for c, v in zip(old, ("false", "16", "-1")):
        spark.conf.set(c, v)
    yield spark
    for c, v in old.items():
        spark.conf.set(c, v)


def both_hot(spark):
    """A key in nine tenths of 4,000 rows on one side and in half of 160 rows on the other, and rows without a key."""
    key = F.when(F.col("id") % 10 < 8, 0).when(F.col("id") % 10 == 8, None).otherwise(F.col("id") % 70)
    large = spark.range(4000).select(key.alias("k"), "id", F.lit("own").alias("_row"), F.lit(1).alias("_salt"), F.create_map(F.lit(1), F.lit(2)).alias("m"))
    key = F.when(F.col("id") % 2 == 0, 0).when(F.col("id") % 31 == 1, None).otherwise(F.col("id") % 50)
    return large, spark.range(160).select(key.alias("k"), F.col("id").alias("other"), F.lit("s").alias("_heavy"), F.lit(2).alias("_k"))


@pytest.mark.parametrize("part_rows", [None, 7, 10**6])
@pytest.mark.parametrize("how", ["inner", "left", "left_semi", "left_anti"])
def test_keys_hot_on_both_sides(spark, how, part_rows):
    large, small = both_hot(spark)
    got = skew.salted_join(large, small, "k", how, share=0.05, part_rows=part_rows)
    plain = large.join(small, "k", how)
    assert sorted(got.columns) == sorted(plain.columns)
    columns = [c for c in plain.columns if c != "m"]
    count = {}
    for frame, sign in ((got, 1), (plain, -1)):
        for r in frame.select(*columns).collect():
            count[r] = count.get(r, 0) + sign
    assert not any(count.values())


def test_tasks_of_a_salted_join_are_of_like_size(fixed_partitions):
    large, small = both_hot(fixed_partitions)

    def sizes(df):
        return sorted(r["count"] for r in df.groupBy(F.spark_partition_id()).count().collect())

    plain, salted = sizes(large.join(small, "k")), sizes(skew.salted_join(large, small, "k", share=0.02))
    assert sum(plain) == sum(salted) and plain[-1] > 0.9 * sum(plain)
    assert len(salted) == 16 and salted[-1] < 2.5 * sum(salted) / 16


def test_parts_follow_the_rows_of_a_key(spark):
    large, small = both_hot(spark)
    parts = {r.k: (r.parts_l, r.parts_s) for r in skew.salt_parts(large, small, "k", 0.02, None, None).collect()}
    assert parts[0] == (40, 20) and all(p == (1, 1) for k, p in parts.items() if k != 0)
    assert skew.salt_parts(large, small, "k", 0.02, 100, None).where("k = 0").first().parts_l == 32
    assert skew.salt_parts(spark.range(1000).withColumnRenamed("id", "k"), spark.range(900).withColumnRenamed("id", "k"), "k", 0.02, None, None) is None


@pytest.mark.parametrize("kind", ["long", "string", "decimal(12,2)", "double", "date", "timestamp", "boolean", "binary"])
def test_heavy_keys_of_any_type(spark, kind):
    value = {"date": "date_add(date'2024-01-01', k)", "timestamp": "timestamp_seconds(k)", "boolean": "k > 3", "binary": "cast(cast(k as string) as binary)"}.get(kind, f"cast(k as {kind})")
    key = F.when(F.col("id") % 3 == 0, 1).when(F.col("id") % 7 == 0, None).when(F.col("id") % 5 == 0, 2).otherwise(F.col("id"))
    df = spark.range(5000).select(key.cast("int").alias("k")).select(F.expr(value).alias("the key")).repartition(6)
    exact = {repr(r[0]): r["count"] for r in df.groupBy("the key").count().where("count > 50").collect()}
    assert {repr(r[0]): r.row_count for r in skew.heavy_counts(df, "the key", 0.01).collect()} == exact
    top = skew.hot_keys(df, "the key", 2).collect()
    assert {repr(r[0]): r.row_count for r in top} == dict(sorted(exact.items(), key=lambda x: -x[1])[:2])


def test_a_summary_never_misses_a_key_above_its_bound(spark):
    draw = random.Random(4)
    rows = [(int(draw.paretovariate(0.7)),) for _ in range(60_000)]
    df = spark.createDataFrame(rows, "k long").repartition(9)
    exact = df.groupBy("k").count()
    for tracked in (40, 300, 3000):
        listed = {r.k: r.at_least for r in skew.summary(df, "k", tracked).collect()}
        need = exact.where(F.col("count") > skew.missed_share(tracked) * len(rows)).collect()
        assert need and all(r.k in listed for r in need)
    assert skew.summary(df.limit(0), "k", 100).collect() == skew.hot_keys(df.limit(0), "k").collect() == skew.heavy_keys(df.limit(0), "k").collect() == []
    assert skew.salted_join(df.limit(0), df.limit(0), "k").count() == 0 and skew.salted_join(df.limit(9), df.limit(0), "k", "left").count() == 9
    # a flat distribution is counted whole
    flat = spark.range(30_000).select((F.col("id") % 14_999).alias("k"))
    assert [tuple(r)[:2] for r in skew.hot_keys(flat, "k", 3).collect()] == [(0, 3), (1, 3), (2, 2)]


def test_heavy_keys_shuffle_no_other_key(spark):
    plan = skew.heavy_counts(spark.range(1000).withColumnRenamed("id", "k"), "k", 0.01)._jdf.queryExecution().optimizedPlan().toString()
    assert "approx_top_k_accumulate" in plan and "LeftSemi" in plan
    # the only aggregation by key is above the semi join
    below = plan[plan.index("Aggregate [k"):]
    assert below.index("LeftSemi") < below.index("Range") and plan.count("Aggregate [k") == 1


def test_salt_depends_on_the_row_only(hot):
    a = hot.repartition(7).select("id", skew.row_salt(8, ["id", "v"]).alias("s"))
    b = hot.coalesce(1).select("id", skew.row_salt(8, ["id", "v"]).alias("s"))
    assert a.exceptAll(b).isEmpty()


def test_plan_partitions():
    assert skew.plan_partitions(0) == 1
    assert skew.plan_partitions(10 * 1024**3, 256 * 1024**2) == 40


# --- reachability ------------------------------------------------------------


def reached_by_hand(links, starts):
    after = {}
    for a, b in links:
        after.setdefault(a, set()).add(b)
    out = {}
    for s in starts:
        seen, todo = set(), list(after.get(s, ()))
        while todo:
            n = todo.pop()
            if n not in seen:
                seen.add(n)
                todo += after.get(n, ())
        out[s] = seen
    return out


def check_reach(spark, links, starts, monkeypatch, shallow):
    monkeypatch.setattr(reach, "SHALLOW", shallow)
    frame = spark.createDataFrame([*links, (None, "x"), ("y", None)], "a string, b string")
    nodes = spark.createDataFrame([(s,) for s in starts], "node string")
    want = reached_by_hand(links, starts)
    assert {r.node: r.reached for r in reach.reach_counts(frame, nodes).collect()} == {s: len(want[s]) for s in starts}
    pairs = [tuple(r) for r in reach.reach_pairs(frame, nodes).collect()]
    assert len(pairs) == len(set(pairs)) and set(pairs) == {(s, n) for s in starts for n in want[s]}


@pytest.mark.parametrize("seed, shallow", [(0, 0), (1, 0), (2, 50)])
def test_reach_in_random_graphs(spark, monkeypatch, seed, shallow):
    draw = random.Random(seed)
    links = set()
    for _ in range(30):
        links.add((f"r{draw.randrange(20)}", f"r{draw.randrange(20)}"))
    for c in range(6):
        names = [f"c{c}_{i}" for i in range(draw.randint(2, 9))]
        links |= set(zip(names, names[1:]))
        end = draw.choice(["ring", "loop", "in", "out", "none"])
        if end == "ring":
            links.add((names[-1], names[0]))
        elif end == "loop":
            links.add((names[1], names[1]))
        elif end == "in":
            links.add((f"r{draw.randrange(20)}", names[0]))
        elif end == "out":
            links |= {(names[-1], f"r{draw.randrange(20)}"), (f"r{draw.randrange(20)}", names[0])}
    links |= {("self", "self"), ("p", "q"), ("q", "p")}
    nodes = sorted({n for link in links for n in link})
    check_reach(spark, sorted(links), [*draw.sample(nodes, 25), "self", "p", "nowhere"], monkeypatch, shallow)


def test_long_rings_and_chains_take_few_rounds(spark, monkeypatch):
    ring = [(f"t{i:04d}", f"t{(i + 1) % 1000:04d}") for i in range(1000)]
    chain = [(f"k{i:04d}", f"k{i + 1:04d}") for i in range(700)]
    links = [*ring, *chain, ("base", "t0007"), ("t0500", "k0000"), ("other", "t0900")]
    frame = spark.createDataFrame(links, "a string, b string")
    written, real = [], reach.cut
    monkeypatch.setattr(reach, "cut", lambda df: written.append(1) or real(df))
    monkeypatch.setattr(reach, "SHALLOW", 2)
    got = {r.node: r.reached for r in reach.reach_counts(frame, spark.createDataFrame([("base",), ("t0003",), ("k0100",), ("other",)], "node string")).collect()}
    assert got == {"base": 1701, "t0003": 1701, "k0100": 600, "other": 1701}
    assert len(written) < 45


def test_no_links_reach_nothing(spark):
    none = spark.createDataFrame([], "a string, b string")
    starts = spark.createDataFrame([("x",)], "node string")
    assert [tuple(r) for r in reach.reach_counts(none, starts).collect()] == [("x", 0)] and reach.reach_pairs(none, starts).count() == 0


# --- lineage -----------------------------------------------------------------


def reference_paths(edges, bases):
    """Plain breadth-first walk, to compare with."""
    out = []
    for base in bases:
        queue, seen = [[base]], {base}
        while queue:
            path = queue.pop(0)
            for nxt in sorted({t for s, t in edges if s == path[-1]}):
                out.append((base, nxt, len(path), " -> ".join([*path, nxt])))
                if nxt not in seen:
                    seen.add(nxt)
                    queue.append([*path, nxt])
    return sorted(out)


@pytest.mark.parametrize("seed", [0, 1, 2])
def test_downstream_paths_with_cycles_and_diamonds(spark, seed):
    rnd = random.Random(seed)
    nodes = [f"db.t{i}" for i in range(9)]
    edges = sorted({(rnd.choice(nodes), rnd.choice(nodes)) for _ in range(16)})
    bases = nodes[:3]
    frame = spark.createDataFrame(edges, "source_table string, target_table string")
    got = lineage.downstream_paths(frame, spark.createDataFrame([(b,) for b in bases], "table_name string"))
    assert sorted(tuple(r) for r in got.collect()) == reference_paths(edges, bases)


STATEMENTS = [
    ("s1", "a.sql", "dw.mid", "physical_table", "insert", ["`ODS`.Base", "helper", "virtual.x"], True),
    ("s2", "b.sql", "v", "temp_view", "create", ["dw.mid", "ods.base"], True),
    ("s3", "c.sql", "dw.out", "view", "create", ["v", "v"], True),
    ("s4", "d.sql", None, "none", "select", ["ods.other"], False),
]


@pytest.fixture(scope="module")
def catalog(spark):
    schema = (
        "statement_id string, file_path string, target_dataset string, target_kind string, statement_type string, "
        "source_tables array<string>, has_query boolean"
    )
    statements = spark.createDataFrame(STATEMENTS, schema)
    edges = lineage.table_edges(statements)
    made = lineage.produced_tables(statements)
    return statements, edges, made, lineage.base_tables(edges, made)


def test_edges_and_bases(catalog):
    _, edges, made, bases = catalog
    assert sorted((r.source_table, r.target_table) for r in edges.collect()) == [
        ("dw.mid", "v"), ("ods.base", "dw.mid"), ("ods.base", "v"), ("v", "dw.out"),
    ]
    assert [r.table_name for r in bases.collect()] == ["ods.base"]


def test_column_lineage(spark, catalog):
    statements, _, _, bases = catalog
    data = [
        ("s1", "dw.mid", "A", "ods.base", "x", "ok", "physical_table", "x"),
        ("s2", "v", "a", "dw.mid", "a", "ok", "temp_view", "a"),
        ("s2", "v", "a", "ods.base", "y", "ok", "temp_view", "y"),
        ("s2", "v", "c", None, None, "constant", "temp_view", "1"),
        ("s3", "dw.out", "a", "v", "`A`", "ok", "view", "a"),
        ("s3", "dw.out", "c", "v", "c", "ok", "view", "c"),
        ("s3", "dw.out", "loop", "dw.out", "loop", "ok", "view", "l"),
    ]
    schema = (
        "statement_id string, target_table string, target_column string, source_table string, source_column string, "
        "lineage_status string, target_kind string, expression_sql string"
    )
    edges = spark.createDataFrame(data, schema)
    got = {(r.target_table, r.target_column, r.base_column, r.path, r.producer_chain) for r in lineage.base_columns(edges, statements, bases).collect()}
    assert got == {
        ("dw.mid", "A", "x", "ods.base.x", ""),
        ("v", "a", "x", "ods.base.x -> dw.mid.a", "s1"),
        ("v", "a", "y", "ods.base.y", ""),
        ("dw.out", "a", "x", "ods.base.x -> dw.mid.a -> v.a", "s1 -> s2"),
        ("dw.out", "a", "y", "ods.base.y -> v.a", "s2"),
    }


def test_catalog_counts(spark, catalog, by):
    _, edges, made, bases = catalog
    related = lineage.related_tables(edges, lineage.downstream_paths(edges, bases))
    got = by(lineage.table_index(bases.unionByName(made), related), "table_name")
    base = got["ods.base"]
    assert (base["direct_downstream_count"], base["all_downstream_count"], base["table_layer"]) == (2, 3, "未识别层级")
    assert got["dw.out"]["direct_upstream_count"] == 1
    lists = {(r.table_name, r.relation): (r.tables, r.table_count) for r in lineage.relation_lists(related).collect()}
    names, count = lists[("ods.base", "all_downstream")]
    assert count == 3 and len(names.split(", ")) == 3 and {"dw.mid", "dw.out"} < set(names.split(", "))


def test_metadata_merge(spark, by):
    data = [
        ("db.`T`", "File_ID", "", None, "ddl", 1), ("db.t", "file_id", "bigint", " ", "remote", 2),
        ("db.t", "x_cnt", None, "given", "remote", 2), ("db.t", "x_cnt", "int", "own", "ddl", 1), ("db.t", "zz", None, None, None, 3),
    ]
    df = spark.createDataFrame(data, "table_name string, column_name string, data_type string, comment string, comment_source string, priority int")
    got = by(lineage.merge_metadata(df), "column_name")
    assert (got["file_id"]["data_type"], got["file_id"]["column_comment"], got["file_id"]["column_comment_source"]) == ("bigint", "文件唯一标识。", "inferred")
    assert (got["x_cnt"]["data_type"], got["x_cnt"]["column_comment"], got["x_cnt"]["column_comment_source"]) == ("int", "own", "ddl")
    assert got["zz"]["column_comment"] == "zz 字段，暂无显式注释，按字段名推断。"


def test_names_and_layers(spark):
    df = spark.createDataFrame([(" `Db`.`ods_X` ",), ("db.tb16",), ("tmp_a",), ("a.dimension",)], "n string")
    got = [tuple(r) for r in df.select(lineage.normalize_table("n", {"tmp_a": "tmp_b"}), lineage.table_layer("n")).collect()]
    assert got[0][0] == "db.ods_x" and got[1] == ("db.tb16", "DIM 维度层") and got[2] == ("tmp_b", "TMP 临时层")
    assert got[3][1] == "未识别层级"


# --- sources and runs --------------------------------------------------------


def test_scan_pushes_filters_and_columns(spark, tmp_path):
    path = str(tmp_path / "t")
    spark.range(100).select("id", (F.col("id") % 5).alias("g"), F.lit("x").alias("wide")).write.parquet(path)
    df = tables.scan(spark, path, ["id"], F.col("g") == 3)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(g,3)" in plan and "wide" not in plan and df.count() == 20
    typed = spark.range(3).select(F.col("id").alias("k"), F.expr("timestamp_ntz '2024-01-01 10:00:00' + make_dt_interval(cast(id as int))").alias("at"))
    typed.write.parquet(str(tmp_path / "times"))
    limited = tables.date_range(spark.read.parquet(str(tmp_path / "times")), "at", "2024-01-02", "2024-01-03")
    assert limited.count() == 2
    assert "GreaterThanOrEqual(at" in limited._jdf.queryExecution().executedPlan().toString()
    with pytest.raises(ValueError):
        tables.date_range(df, None, "2024-01-01")


def test_discovery_and_snapshot(spark, by):
    spark.range(3).select("id", F.lit("a").alias("file_id")).createOrReplaceTempView("present_table")
    assert tables.resolve_table(spark, ["present_table", "x"]) == ("present_table", "result")
    assert tables.resolve_table(spark, ["x", "present_table"]) == ("present_table", "fallback")
    assert tables.resolve_table(spark, ["x"]) == (None, "missing")
    assert tables.find_table(spark, "no_such_table") is None
    got = by(tables.source_snapshot(spark, ["present_table", "gone"], ["file_id", "spu"]), "table_name")
    assert (got["present_table"]["row_count"], got["present_table"]["key_columns_present"]) == (3, "file_id")
    assert got["gone"]["exists"] is False
    bound, missing = tables.bind_columns(["a", "b"], {"x": ["z", "b"], "y": ["q"]})
    assert bound == {"x": "b", "y": None} and missing == ["y"]
    assert [r.column_name for r in tables.describe(spark.table("present_table")).collect()] == ["id", "file_id"]


def test_snapshot_and_deleted(spark):
    df = spark.createDataFrame([("2024-01-01", "false"), ("2024-01-02", None), ("2024-01-02", "true")], "d string, is_delete string")
    assert tables.latest_snapshot(df, "d").count() == 2
    assert tables.drop_deleted(df).count() == 2 and tables.drop_deleted(df, keep_null=False).count() == 1


def test_sinks_and_reports(spark, tmp_path):
    df = spark.createDataFrame([(1, "é"), (2, None)], "a int, b string")
    sinks.write_bundle({"x": df}, str(tmp_path))
    assert spark.read.json(str(tmp_path / "json" / "x")).count() == 2
    assert spark.read.csv(str(tmp_path / "csv" / "x"), header=True).columns == ["a", "b"]
    report = tmp_path / "report.json"
    report.write_text('{"detail": [{"enum_value": "x", "n": 1}, {"enum_value": "y", "n": 2}]}')
    assert read_report_detail(spark, str(report)).agg(F.sum("n")).first()[0] == 3


def test_cut_keeps_rows_and_uses_the_shared_folder(spark, monkeypatch, tmp_path):
    monkeypatch.setattr(ordered, "shared_folder", lambda _: str(tmp_path))
    df = ordered.cut(spark.range(10).withColumn("p", F.rand()))
    assert df.collect() == df.collect() and str(tmp_path) in df.inputFiles()[0]
    monkeypatch.setattr(ordered, "shared_folder", lambda _: None)
    kept = ordered.cut(spark.range(10))
    assert kept.is_cached and kept.count() == 10
    kept.unpersist()


def test_long_chains_and_many_neighbours(spark, by):
    chain = [(f"db.t{i}", f"db.t{i + 1}") for i in range(150)]
    many = [("db.hub", f"db.n{i:03}") for i in range(150)]
    edges = spark.createDataFrame(chain + many + [("db.t9", "db.t3")], "source_table string, target_table string")
    bases = spark.createDataFrame([("db.t0",), ("db.hub",)], "table_name string")
    reached = lineage.downstream_tables(edges, bases)
    assert reached.count() == 300
    lists = {(r.table_name, r.relation): r for r in lineage.relation_lists(lineage.related_tables(edges, reached)).collect()}
    assert lists["db.hub", "direct_downstream"].tables == ", ".join(f"db.n{i:03}" for i in range(150))
    assert lists["db.t0", "all_downstream"].table_count == 150


@pytest.mark.parametrize("wide", [1, 1 << 24])
def test_long_lists_are_put_together_from_pieces(spark, monkeypatch, wide):
    """No aggregate holds a long list's names as a whole; the texts are those of one."""
    for name, value in {"LONG": 50, "PIECE": 37, "SAMPLE": 1, "WIDE": wide}.items():
        monkeypatch.setattr(lists, name, value)
    data = [("a", "down", f"n{i * 7 % 1000}") for i in range(1000)] + [("b", None, f"é{i}") for i in range(300)] + [("b", None, None)] * 5
    data += [(None, "up", ""), (None, "up", "x"), (None, None, None)] + [("z", "up", None)] * 70 + [("d", "down", x) for x in [""] * 60 + ["q"] * 30]
    data += [(f"s{i}", "down", f"n{j}") for i in range(200) for j in range(i % 4 + 1)]
    related = spark.createDataFrame(data, "table_name string, relation string, related_table string")
    found = lineage.relation_lists(related)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "rangepartitioning" in plan and "MapInArrow" in plan and found.columns == ["table_name", "relation", "tables", "table_count"]
    got = {(r.table_name, r.relation): (r.tables, r.table_count) for r in found.collect()}
    assert found.count() == len(got)
    names = {}
    for table, relation, other in data:
        names.setdefault((table, relation), []).append(other)
    assert got == {k: (", ".join(sorted(x for x in v if x is not None)), len(v)) for k, v in names.items()}


def test_lists_are_short_where_no_key_has_many_names(spark):
    related = spark.createDataFrame([("a", "up", "y"), ("a", "up", "x"), ("b", "up", None)], "table_name string, relation string, related_table string")
    found = lineage.relation_lists(related)
    assert "MapInArrow" not in found._jdf.queryExecution().executedPlan().toString()
    assert sorted(map(tuple, found.collect())) == [("a", "up", "x, y", 2), ("b", "up", "", 1)]


def test_layered_diamonds_end(spark):
    pairs = [(f"db.a{i}{x}", f"db.a{i + 1}{y}") for i in range(30) for x in "xy" for y in "xy"]
    edges = spark.createDataFrame(pairs, "source_table string, target_table string")
    assert lineage.downstream_tables(edges, spark.createDataFrame([("db.a0x",)], "table_name string")).count() == 60


def test_base_columns_of_layered_diamonds_without_their_ways(spark):
    pairs = [(f"s{i}", f"db.a{i + 1}{y}", "k", f"db.a{i}{x}", "k", "ok") for i in range(30) for x in "xy" for y in "xy"]
    ce = spark.createDataFrame(pairs, "statement_id string, target_table string, target_column string, source_table string, source_column string, lineage_status string")
    st = ce.select("statement_id", F.lit(True).alias("has_query")).distinct()
    bases = spark.createDataFrame([("db.a0x",), ("db.a0y",)], "table_name string")
    found = lineage.base_sources(ce, st, bases)
    assert found.count() == 120 and found.where("target_table = 'db.a30x'").count() == 2


def test_salts_come_from_all_columns_and_rows_without_key_are_spread(spark):
    adaptive = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        same = [F.lit(0).alias(c) for c in "abcd"]
        rows = spark.range(2000).select(F.when(F.col("id") % 2 == 0, None).otherwise(F.lit(1)).alias("k"), *same, "id")
        small = spark.createDataFrame([(1, "x"), (2, "y")], "k int, name string")
        for how in ("left", "left_anti"):
            joined = skew.salted_join(rows, small, "k", how, salts=8)
            parts = joined.where("k is null").groupBy(F.spark_partition_id()).count().collect()
            assert len(parts) > 2 and sum(r["count"] for r in parts) == 1000
        joined = skew.salted_join(rows, small, "k", salts=8)
        assert len(joined.groupBy(F.spark_partition_id()).count().collect()) > 2
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", adaptive)
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_quality_runs(spark, by):
    df = spark.createDataFrame([("1", "a", 1.0), ("1", None, 2.0), (" ", "b", 3.0)], "file_id string, kind string, size double")
    frames = quality_run.run(df, "2024-01-01")
    assert {"null_rates", "duplicate_file_id", "iqr_outliers", "enum_top"} <= set(frames)
    parent = spark.createDataFrame([("2",)], "file_id string")
    got = by(quality_run.bridge_findings(df, ["file_id"], {"parent": (parent, ["file_id"])}, ["file_id", "sku"]), "check")
    assert got["key uniqueness"]["status"] == "fail" and got["parent"]["row_count"] == 2
    assert got["column sku"]["severity"] == "critical" and got["coverage of file_id"]["row_count"] == 1


def test_checks_of_one_row_share_a_scan(spark, by):
    df = spark.createDataFrame([("1", "a ", 1.0, "2024-01-02"), ("1", None, float("nan"), "2019-01-01"), (" ", "b", 3.0, None)], "file_id string, kind string, size double, day string")
    df = df.withColumn("at", F.col("day").cast("timestamp")).drop("day")
    frames = quality_run.run(df, "2024-01-01")
    for name, alone in {
        "row_count": quality.row_count(df), "null_rates": quality.null_rates(df), "numeric_profile": quality.numeric_profile(df, ["size"]),
        "dirty_strings": quality.dirty_strings(df), "time_sanity": quality.time_sanity(df, "2024-01-01"),
    }.items():
        assert frames[name].columns == alone.columns and frames[name].collect() == alone.collect()
        # the table itself is not read again
        plan = frames[name]._jdf.queryExecution().optimizedPlan().toString()
        assert "file_id#" not in plan and plan.count("Relation [") == 1


def stored(path, kind="parquet"):
    return [f for f in path.rglob(f"*.{kind}") if not f.name.startswith((".", "_"))]


def test_files_of_a_set_size(spark, tmp_path):
    df = spark.range(60_000).select("id", F.sha2(F.col("id").cast("string"), 256).alias("text")).coalesce(1)
    plan = sinks.write_sized(df, str(tmp_path / "even"), file_bytes=400_000)
    files = stored(tmp_path / "even")
    sizes = [f.stat().st_size for f in files]
    assert plan["files"] == len(files) > 5 and max(sizes) < 1.3 * 400_000 and min(sizes) > 0.6 * 400_000
    assert spark.read.parquet(str(tmp_path / "even")).count() == 60_000
    # most rows have one key
    skewed = df.withColumn("k", F.when(F.col("id") % 20 == 0, F.col("id") % 7).otherwise(0))
    plan = sinks.write_sized(skewed, str(tmp_path / "by"), file_bytes=400_000, by=["k"])
    files = stored(tmp_path / "by")
    assert max(f.stat().st_size for f in files) < 1.3 * 400_000 and len(files) < 2.5 * plan["files"] + 7
    assert {f.parent.name for f in files} == {f"k={i}" for i in range(7)} and spark.read.parquet(str(tmp_path / "by")).count() == 60_000
    assert sinks.write_sized(df.limit(0), str(tmp_path / "none"))["rows"] == 0
    assert sinks.write_sized(df.limit(10), str(tmp_path / "json"), "json")["files"] == 1


@pytest.fixture
def heavy_tables(spark, tmp_path):
    """Half a million lines and 200,000 suppliers, nearly all with one key: 10^11 pairs; and a few odd rows."""
    lines = spark.range(500_000).selectExpr("id * 3 AS l_orderkey", "7L AS l_suppkey", "CAST(id % 2 AS INT) AS l_linenumber")
    odd = spark.createDataFrame([(1, 5, None), (1, 5, None), (None, 5, 0), (1, None, 1), (2, 9, 1)], "l_orderkey long, l_suppkey long, l_linenumber int")
    suppliers = spark.range(200_000).selectExpr("id * 2 AS s_suppkey", "CAST(id % 2 AS INT) AS s_nationkey", "'x' AS s_name")
    others = spark.createDataFrame([(5, 3, None), (5, 3, None), (5, 3, "y"), (7, None, "z"), (None, 1, "n"), (11, 2, None)], "s_suppkey long, s_nationkey int, s_name string")
    lines.unionByName(odd).write.parquet(f"{tmp_path}/lineitem.parquet")
    suppliers.unionByName(others).write.parquet(f"{tmp_path}/supplier.parquet")
    return str(tmp_path)


def test_joins_hot_on_both_sides_do_not_list_all_pairs(spark, heavy_tables):
    began, n = time.time(), 500_000
    got = {(r.s_nationkey, r.l_linenumber): (r.row_count, r.order_sum) for r in registered.QUERIES["salted_join_both_sides"](spark, heavy_tables).collect()}
    half = {k: sum(range(k, n, 2)) * 3 for k in (0, 1)}
    # the key of supplier 5 has three suppliers of nation 3, those of lines 1, 1 and null
    expected = {(nation, k): (n // 2 * 100_000, half[k] * 100_000) for nation in (0, 1) for k in (0, 1)} | {(3, None): (6, 6), (3, 0): (3, None)}
    assert got == expected
    assert time.time() - began < 120


def test_left_joins_hot_on_both_sides_do_not_list_all_pairs(spark, heavy_tables):
    began, n = time.time(), 500_000
    got = {(r.s_nationkey, r.unmatched): r.row_count for r in registered.QUERIES["salted_left_join_both_sides"](spark, heavy_tables).collect()}
    # suppliers 5, 9 and so on (1 modulo 4) take no part: lines of 5, 9 and null stay alone
    assert got == {(0, False): n * 100_000, (1, False): n * 100_000, (None, True): 5}
    assert time.time() - began < 120


def test_base_sources_follow_no_column_that_nothing_comes_from(spark, monkeypatch):
    leaves = [(f"s{i}", f"ads.t{i % 500}", "K", "dwd.mid", "k", "ok") for i in range(1000)]
    mids = [("m", "dwd.mid", "k", "ods.base", "`B`", "ok"), ("m", "dwd.mid", "k", "dwd.mid", "k", "ok"), ("no", "dwd.mid", "k", "ods.other", "b", "ok")]
    odd = [("x", "ads.x", None, "dwd.mid", "k", "ok"), ("x", "ads.x", "c", "ods.base", "b", "constant"), ("x", "ods.base", "b", "ods.other", "b", "ok")]
    ce = spark.createDataFrame(leaves + mids + odd, "statement_id string, target_table string, target_column string, source_table string, source_column string, lineage_status string")
    st = ce.select("statement_id", (F.col("statement_id") != "no").alias("has_query")).distinct()
    bases = spark.createDataFrame([("ods.base",), ("ods.other",)], "table_name string")
    followed = []
    monkeypatch.setattr(lineage, "closure", lambda *args: followed.append(reach.closure(*args)) or followed[-1])
    found = sorted(map(tuple, lineage.base_sources(ce, st, bases).collect()), key=repr)
    direct = [("dwd.mid", "k", "ods.other", "b"), ("ods.base", "b", "ods.other", "b")]
    assert found == sorted([(f"ads.t{i}", "K", "ods.base", "b") for i in range(500)] + [("ads.x", None, "ods.base", "b"), ("dwd.mid", "k", "ods.base", "b")] + direct, key=repr)
    # three columns that others come from, not a thousand that nothing comes from
    assert followed[0].count() == 3


def test_physical_sources_join_nothing(spark):
    schema = "statement_id string, file_path string, target_dataset string, target_kind string, statement_type string, source_tables array<string>, has_query boolean"
    rows = [
        ("1", "a.sql", "ods.made", "physical_table", "insert", ["`ODS`.Raw", "ods.raw", "tmp_one", "helper", None, "virtual.v"], True),
        ("2", "b.sql", "tmp_one", "temp_view", "create", ["ods.made", "virtual.made"], True),
        ("3", "b.sql", "virtual.made", "view", "create", ["ods.raw"], True),
        ("4", None, " ", "view", "create", ["ods.raw"], True),
    ]
    edges = lineage.table_edges(spark.createDataFrame(rows, schema))
    assert sorted((r.source_table, r.target_table) for r in edges.collect()) == [
        ("ods.made", "tmp_one"), ("ods.raw", "ods.made"), ("ods.raw", "virtual.made"), ("tmp_one", "ods.made"), ("virtual.made", "tmp_one"),
    ]
    assert "LeftOuter" not in edges._jdf.queryExecution().optimizedPlan().toString()
