"""The pipeline over a small table, stage by stage."""

import hashlib
import random

import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from plumbline.llm import language, mixing, simhash
from plumbline.llm.frames import settle

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
SECRET = "password=abcdef123456"


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    draw = random.Random(1)
    words = {
        "en": "the people of this town were thinking about whether they should have another meeting".split(),
        "de": "die leute dieser stadt überlegten ob sie noch eine weitere sitzung haben sollten".split(),
    }
    rows = []
    for i in range(160):
        lang = ("en", "de")[i % 2]
        text = " ".join(draw.choices(words[lang], k=60))
        rows.append((i, f"{text} {SECRET}" if i % 20 == 0 else text, lang, f"s{i % 3}"))
    rows += [(500, rows[5][1], "de", "s0"), (501, None, "en", "s1"), (502, "12 !!", "en", None), (503, "", None, None), (3, rows[3][1], "de", "s0")]
    path = str(tmp_path_factory.mktemp("tables"))
    spark.createDataFrame([(*r, len(r[1] or "")) for r in rows], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{path}/documents.parquet")
    return path


def test_stages(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == ["language_id", "simhash_near_dedup", "secret_scan", "source_mix", "bpe_encoding"]
    kept = settle(stages["language_id"](spark, docs, folder))
    assert kept.columns == COLUMNS and kept.count() == 162
    single = settle(stages["simhash_near_dedup"](spark, kept, folder))
    prints = {r.doc_id: simhash.fingerprint(r.text) for r in kept.collect()}
    ids = sorted(r.doc_id for r in single.collect())
    assert single.columns == COLUMNS and len(ids) == len(set(ids)) and 500 not in ids and 5 in ids
    assert all(any(bin(prints[i] ^ prints[j]).count("1") <= 3 for j in ids) for i in prints)
    clean = settle(stages["secret_scan"](spark, single, folder))
    assert clean.columns == COLUMNS and clean.count() == single.count()
    before = {r.doc_id: r.text for r in single.collect()}
    for r in clean.collect():
        assert r.text == before[r.doc_id].replace(SECRET, "[SECRET]") and r.n_chars == len(r.text)
    mixed = settle(stages["source_mix"](spark, clean, folder))
    wanted = sum(r.copies for r in mixing.mix(clean).collect())
    assert mixed.columns == COLUMNS and mixed.count() == wanted > clean.count()
    out = stages["bpe_encoding"](spark, mixed, folder).collect()
    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    texts = {r.doc_id: r.text for r in mixed.collect()}
    assert len(out) == wanted
    for r in out:
        ids = library.encode(texts[r.doc_id], add_special_tokens=False).ids
        assert r.n_tokens == len(ids) and r.ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
    assert sorted(map(tuple, corpus_pipeline.run(spark, folder).collect())) == sorted(map(tuple, out))


def test_an_empty_table(spark, folder, tmp_path):
    spark.read.parquet(f"{folder}/documents.parquet").limit(0).write.parquet(f"{tmp_path}/documents.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_junk_goes_and_clean_documents_stay(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    # a few of them carry a label, as crawled rows do
    junk = [(900 + r.doc_id, language.shuffled(r.text), r.lang if r.doc_id < 4 else None, r.source, r.n_chars) for r in docs.where("doc_id < 40").collect()]
    junk += [(2000, "### $$$ 123", "en", "s0", 11)]
    kept = corpus_pipeline.identify_language(spark, docs.unionByName(spark.createDataFrame(junk, docs.schema)), folder)
    ids = {r.doc_id for r in kept.collect()}
    assert ids >= set(range(160)) | {500} and len(ids & {r[0] for r in junk}) <= 2 and 2000 not in ids


def test_columns_of_any_name_and_type_go_through(spark, folder, tmp_path):
    docs = spark.read.parquet(f"{folder}/documents.parquet").withColumns(
        {
            "base": F.lit("b"), "candidates": F.create_map(F.lit("a"), F.col("doc_id")), "spans": F.lit("mine"), "mark": F.lit(1), "fingerprint": F.lit(2),
            "lang_found": F.lit(3), "lang_score": F.lit(None).cast("double"), "copies": F.array(F.create_map(F.lit(1), F.lit(1))), "ids": F.lit("x"), "root": F.lit(4),
        }
    )
    at = docs
    for _, stage in corpus_pipeline.STAGES[:-1]:
        at = settle(stage(spark, at, folder))
        assert at.columns == docs.columns
    assert {(r.base, r.spans, r.mark, r.fingerprint) for r in at.collect()} == {("b", "mine", 1, 2)}
    assert all(r.candidates == {"a": r.doc_id} for r in at.where("doc_id is not null").collect())
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == at.count()
    without = docs.drop("n_chars")
    assert corpus_pipeline.redact_secrets(spark, without, folder).columns == without.columns
