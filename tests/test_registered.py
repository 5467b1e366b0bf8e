"""Every registered query against its SQL, and the shape of important plans."""

import math
import os
import subprocess
import sys

import duckdb
import pytest

import __spark_entry__ as entry_points

FOLDER = os.environ.get("PLUMBLINE_TEST_DATA", "/root/testdata/sf0.001")
TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()
QUERIES, ORACLES = entry_points.queries(), entry_points.oracle_sql()

pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="test tables not present")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{FOLDER}/{name}.parquet'")
    return con


def plain(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else repr(value + 0.0)
    return repr(value)


def table(columns, records):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], sorted([plain(r[i]) for i in order] for r in records)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_matches_sql(spark, duck, name):
    df = QUERIES[name](spark, FOLDER)
    got = table(df.columns, df.collect())
    if name not in ORACLES:
        assert got[1]
        return
    cursor = duck.execute(ORACLES[name])
    assert got == table([c[0] for c in cursor.description], cursor.fetchall())


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", ["null_rates", "rule_checks", "best_hit", "layer_gap", "default_root_cause", "churn_scores", "top_distribution"])
def test_no_products_and_no_python(spark, name):
    plan = plan_of(QUERIES[name](spark, FOLDER))
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan and "Python" not in plan


def test_top_list_needs_no_global_sort(spark):
    plan = plan_of(QUERIES["top_distribution"](spark, FOLDER))
    assert "TakeOrderedAndProject" in plan


def test_samples_are_cut_before_the_shuffle(spark):
    plan = plan_of(QUERIES["stratified_samples"](spark, FOLDER))
    assert plan.count("WindowGroupLimit") == 2 and "Partial" in plan


def test_one_scan_for_all_columns(spark):
    assert plan_of(QUERIES["null_rates"](spark, FOLDER)).count("FileScan") == 1
    assert plan_of(QUERIES["rule_checks"](spark, FOLDER)).count("FileScan") == 1


def test_entry(spark):
    got = {r.column_name: r for r in entry_points.entry(spark).collect()}
    assert got["l_orderkey"].null_pct == 0.0 and got["l_returnflag"].distinct_values == 3


@pytest.mark.parametrize("missing", ["ahocorasick", "xxhash", "public_tokenizers", "tokenizers", "plumbline.llm", "corpus_pipeline"])
def test_the_other_queries_without_a_package(missing):
    """Whatever the training-data operators lack, the other queries stay."""
    code = f"""
import sys, warnings
warnings.simplefilter("ignore")
class Gone:
    def find_spec(self, name, path=None, target=None):
        if name == {missing!r} or name.startswith({missing + "."!r}):
            raise ModuleNotFoundError(f"No module named {{name}}", name=name)
sys.meta_path.insert(0, Gone())
import __spark_entry__ as e
assert not any(n[:2] == "op" and n[2].isdigit() or n == "pipeline" for n in e.queries()), "training-data queries are there"
assert len(e.queries()) == len(e.registered.QUERIES) and set(e.oracle_sql()) <= set(e.queries())
"""
    root = os.path.dirname(os.path.abspath(entry_points.__file__))
    subprocess.run([sys.executable, "-c", code], check=True, cwd=root)
