"""Fill-in-the-middle against a plain rendering of the same rule."""

import hashlib
import re

import pytest
from pyspark.sql import functions as F

from plumbline.llm import fill_middle, queries

TEXTS = [
    None, "", "\n", "one line", "one\ntwo\nthree", "one\r\ntwo\r\n\n\nfive\n", "a <P> b\nc", "x\n<S>", "<M>", "<\nP>\nS>", "$1 \\E \\ {2}\n$2\n",
    "emoji 🙂\n🙂🙂\nÅngström same line\n", "\x00\n\x85\n", "x" * 200_000 + "\n" + "y" * 200_000, "ab\n" * 120_000, "\n" * 50_000,
]


def plain(doc_id, text, fim=100, spm=50):
    text = text or ""
    lines = re.findall(r"[^\n]*\n|[^\n]+", text)
    n = len(lines)
    if doc_id is None or not text or any(m in text for m in ("<P>", "<S>", "<M>")):
        return n, "plain", None, None, text
    digest = hashlib.sha256(f"7:{doc_id}".encode()).hexdigest()
    h = [int(digest[8 * k : 8 * k + 8], 16) for k in range(4)]
    if h[2] % 100 >= fim:
        return n, "plain", None, None, text
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    p, m, s = "".join(lines[:a]), "".join(lines[a:b]), "".join(lines[b:])
    if h[3] % 100 < spm:
        return n, "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return n, "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t) for i, t in enumerate(TEXTS * 3)] + [(-5, TEXTS[5]), (None, TEXTS[4]), (3, TEXTS[3]), (3, TEXTS[3]), (2**62, TEXTS[4])]
    frame = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    return frame.withColumns({"n": F.lit("clash"), "Form": F.lit(1), "whole": F.lit(2), "low": F.lit(3), "drawn": F.lit(4), "output": F.lit(5), "m": F.create_map(F.lit(1), F.lit(2))})


@pytest.mark.parametrize("fim, spm", [(100, 50), (60, 0), (60, 100), (0, 50)])
def test_every_row_and_its_way_back(docs, fim, spm):
    out = fill_middle.fill_in_middle(docs, fim_percent=fim, spm_percent=spm).withColumn("back", fill_middle.restored(F.col("output"), F.col("form")))
    assert out.columns == ["doc_id", "text", "whole", "low", "drawn", "m", "n", "form", "prefix_chars", "middle_chars", "output", "back"]
    got = out.collect()
    assert len(got) == 3 * len(TEXTS) + 5
    for r in got:
        assert (r.n, r.form, r.prefix_chars, r.middle_chars, r.output) == plain(r.doc_id, r.text, fim, spm)
        assert r.back == (r.text or "") and (r.whole, r.low, r.drawn) == (2, 3, 4)
    assert fim == 0 or {r.form for r in got} >= {"plain"} | ({"spm"} if spm else set()) | ({"psm"} if spm < 100 else set())


def test_other_marks_and_units(spark):
    marks = fill_middle.Marks("[pre$1\\]", "[suf]", "[mid]")
    docs = spark.createDataFrame([(i, "a b  c d e " * i) for i in range(40)], "doc_id long, text string")
    out = fill_middle.fill_in_middle(docs, unit=r"(?:[^ ]++ *+|[ ]++)", marks=marks)
    got = out.withColumn("back", fill_middle.restored(F.col("output"), F.col("form"), marks)).collect()
    assert all(r.back == r.text for r in got) and {r.form for r in got} == {"plain", "psm", "spm"}
    assert max(r.n for r in got) == 39 * 5
    for bad in (fill_middle.Marks("<P>", "<P>x", "<M>"), fill_middle.Marks("a>", ">b", "c"), fill_middle.Marks("", "b", "c")):
        with pytest.raises(ValueError):
            fill_middle.fill_in_middle(docs, marks=bad)


def test_the_query_and_its_plan(spark, docs, tmp_path):
    docs.select("doc_id", "text").write.parquet(f"{tmp_path}/documents.parquet")
    df = queries.QUERIES["op13_fill_in_middle"](spark, str(tmp_path))
    texts = [(r.doc_id, r.text) for r in docs.collect()]

    def digest(text):
        return hashlib.sha256(text.encode()).hexdigest()

    want = sorted(repr((i, *plain(i, t)[:4], digest(plain(i, t)[4]), digest(t or ""))) for i, t in texts)
    assert sorted(repr(tuple(r)) for r in df.collect()) == want
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Python" not in plan and "Arrow" not in plan
    # the match that puts the parts in order is made once per row
    assert plan.count("}+)(.*)\\z") <= 2
    assert queries.QUERIES["op13_fill_in_middle"](spark, str(tmp_path)).limit(0).count() == 0


def test_an_empty_table(spark, docs):
    assert fill_middle.fill_in_middle(docs.limit(0)).collect() == []
