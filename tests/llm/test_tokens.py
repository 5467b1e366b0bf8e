"""Encoding, records and counts against the tokenizers library."""

import hashlib
import struct
import weakref
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType, StructField
from tokenizers import Tokenizer

from plumbline.llm import bpe, counts, frames, records
from plumbline.llm.frames import new_folder

WORDS, BYTES = public_tokenizers.path("word_bpe_49k.json"), public_tokenizers.path("byte_bpe_50k.json")
LIBRARY = {p: Tokenizer.from_file(p) for p in (WORDS, BYTES)}
TEXTS = [
    None, "", " \n\t ", "Hello there, it's 2 o'clock", "AAAA" * 30_000, "x" * 200_000, "naïve café ÉÈ straße 漢字 ½ ²",
    "<|startoftext|>mid <|endoftext|> end<|endoftext", "İstanbul ΣΊΣΥΦΟΣ ﬁ é \x1c\x1f　wide 😀", "don't they'll we've I'm you'd he's", "a​b\x00c",
]
SCHEMA = "doc_id long, text string, ids string, _text string, n_tokens int"


def frame(spark, texts=TEXTS):
    rows = [(i, t, "own", "other", -1) for i, t in enumerate(texts)]
    return spark.createDataFrame([*rows, rows[3], (None, "no id", None, None, None)], SCHEMA)


def ids_of(path, text):
    return LIBRARY[path].encode(text or "", add_special_tokens=False).ids


@given(st.text(max_size=60) | st.text(alphabet="abcdeABC' .!1é\n", max_size=60) | st.text(alphabet="ab", max_size=40))
@settings(max_examples=300, deadline=None)
def test_any_text_encodes_as_in_the_library(text):
    own = bpe.encoder(WORDS)
    ids = own.encode(text)
    assert ids.tolist() == ids_of(WORDS, text)
    assert own.decode(ids) == LIBRARY[WORDS].decode(ids.tolist(), skip_special_tokens=False)
    assert counts.counter(BYTES).count(text) == len(ids_of(BYTES, text))


def test_every_usual_character_is_handled_alike():
    own, other = bpe.encoder(WORDS), counts.counter(BYTES)
    usual = [chr(c) for c in range(0x3000) if bpe.USUAL_TEXT.fullmatch(chr(c))]
    for c in usual:
        text = f"a{c}B {c}1"
        assert own.encode(text).tolist() == ids_of(WORDS, text), hex(ord(c))
        assert other.count(text) == len(ids_of(BYTES, text)), hex(ord(c))


def test_small_caches_change_nothing(monkeypatch):
    monkeypatch.setattr(bpe, "CACHE_ENTRIES", 3)
    monkeypatch.setattr(counts, "CACHE_ENTRIES", 3)
    text = "one two three four five, six seven. " * 20
    assert bpe.Encoder(WORDS).encode(text).tolist() == ids_of(WORDS, text)
    assert counts.TokenCounter(BYTES).count(text) == len(ids_of(BYTES, text))


@given(st.lists(st.text(max_size=60) | st.text(alphabet="abcdeABC' .!1é\n", max_size=60) | st.text(alphabet="<|endoftx>\x1f\x85 aÃ©é", max_size=60), max_size=6))
@settings(max_examples=300, deadline=None)
def test_many_texts_encode_as_in_the_library(texts):
    own = frames.worker_table("test", WORDS, bpe.LibraryEncoder)
    assert [i.tolist() for i in own.encode_all(texts)] == [ids_of(WORDS, t) for t in texts]


def test_texts_of_a_step_keep_their_order_and_ids():
    own = bpe.LibraryEncoder(WORDS)
    usual = [f"a{chr(c)}B {chr(c)}1" for c in range(0x3000) if bpe.USUAL_TEXT.fullmatch(chr(c))]
    # each after and before a blank and what may combine
    usual += [f"ΑΣ{b}́J{b}̌{b}İ{b}ᄀ{b}ᅡ" for b in "\t\n\v\f\r \x85\xa0\x1c\x1f\u2028\u3000\u200b\u180e"]
    texts = [t for pair in zip(usual, [*TEXTS, "मानक हिन्दी", "<|endoftext|>😀"] * len(usual)) for t in pair][:300] + usual
    assert [i.tolist() for i in own.encode_all(texts)] == [ids_of(WORDS, t) for t in texts]
    assert list(own.encode_all([])) == []


def test_words_of_any_character_stand_for_themselves():
    own = bpe.LibraryEncoder(WORDS)
    odd = [*range(0x100, 0x3400), *range(0xA000, 0xD800, 7), *range(0xE000, 0x20000, 5), *range(0x1F000, 0x1F200)]
    for c in odd:
        for text in (chr(c), f"J{chr(c)}̌"):
            for word in own._cut(text):
                assert own._cut(word) == [word], hex(c)


def test_small_steps_calls_and_caches_change_nothing(monkeypatch):
    texts = [*TEXTS, "one two three four five, six seven. " * 20, "x" * 60 + ", " + "x" * 60 + "!"] * 2
    want = [ids_of(WORDS, t) for t in texts]
    for step, call, entries in ((1, 1, 3), (50, 7, 5), (1 << 21, 20, 1)):
        monkeypatch.setattr(bpe, "STEP_CHARS", step)
        monkeypatch.setattr(bpe, "CALL_CHARS", call)
        monkeypatch.setattr(bpe, "CACHE_ENTRIES", entries)
        own = bpe.LibraryEncoder(WORDS)
        assert [i.tolist() for i in own.encode_all(texts)] == want
        assert len(own.ids) <= entries and len(own.older) <= entries


def test_the_library_gets_each_word_once_and_many_in_a_call():
    own, got = bpe.LibraryEncoder(WORDS), []

    class Counted:
        def encode_batch_fast(self, texts, **options):
            got.append(texts[0].split(" "))
            return model.encode_batch_fast(texts, **options)

    model, own.model = own.model, Counted()
    texts = [f"Word{chr(97 + n % 26)} word{chr(97 + n % 26)}, other. café😀" for n in range(1000)]
    for _ in range(2):
        assert [i.tolist() for i in own.encode_all(texts)] == [ids_of(WORDS, t) for t in texts]
    words = [w for call in got for w in call]
    # café and the emoji stand as bytes; only texts with the emoji are looked up one by one
    assert len(words) == len(set(words)) == 26 + 5
    got.clear()
    fresh = [t.replace("😀", "").replace("o", "oo") for t in texts]
    assert [i.tolist() for i in own.encode_all(fresh)] == [ids_of(WORDS, t) for t in fresh]
    assert len(got) == 1


def test_the_library_encoder_refuses_other_models():
    with pytest.raises(ValueError, match="word ends"):
        bpe.LibraryEncoder(BYTES)


def test_encode_decode_frame(spark):
    out = bpe.encode_decode(frame(spark), WORDS)
    assert out.columns == ["doc_id", "text", "_text", "n_tokens", "ids", "decoded"]
    got = out.collect()
    assert len(got) == len(TEXTS) + 2
    for r in got:
        ids = ids_of(WORDS, r.text)
        assert r.ids == ids and r.decoded == LIBRARY[WORDS].decode(ids, skip_special_tokens=False)
    assert bpe.encode_decode(frame(spark).limit(0), WORDS).count() == 0


def test_other_models_are_refused():
    with pytest.raises(ValueError):
        bpe.Encoder(BYTES)
    with pytest.raises(ValueError):
        counts.TokenCounter(WORDS)


def test_counts_frame(spark):
    got = counts.token_counts(frame(spark), BYTES).collect()
    assert all(r.n_tokens == len(ids_of(BYTES, r.text)) for r in got) and len(got) == len(TEXTS) + 2
    assert counts.token_counts(frame(spark).limit(0), BYTES).count() == 0


SCRIPTS = "日本語のテキスト。カナ　全角！ 한글 텍스트 Ελληνικά русский العربية हिन्दी ไทย 😀👩‍👩‍👧 é ½ ²  \u2028\x85 don't  end  "


@given(st.text(alphabet=SCRIPTS, max_size=60) | st.lists(st.sampled_from([*SCRIPTS.split(" "), " ", "<|endoftext|>", "<|startoftext|>", "<|endoftext", "it's"]), max_size=12).map("".join))
@settings(max_examples=200, deadline=None)
def test_texts_of_all_scripts_go_through_both_tiers(text):
    counter, asked = counts.counter(BYTES), []
    real = counter.tokenizer
    counter.frequent, counter.table, counter.misses = {}, "", counts.Misses(real)
    counter.misses.tokenizer = type("Asked", (), {"encode": lambda self, p, **k: asked.append(p) or real.encode(p, **k)})()
    assert counter.count(text) == len(ids_of(BYTES, text))
    # the library sees single pre-tokens only, and each only once
    assert len(asked) == len(set(asked)) and all(len(real.pre_tokenizer.pre_tokenize_str(p)) == 1 for p in asked)
    counter.frequent = {p: counter.misses[p] for p in asked}
    asked.clear()
    assert counter.count(text) == len(ids_of(BYTES, text)) and not asked
    counter.frequent, counter.misses = {}, counts.Misses(real)


def test_an_empty_first_tier_gives_the_same_counts(spark):
    none = counts.Lengths("", np.empty(0, np.int64), np.empty(0, np.int32))
    got = counts.token_counts(frame(spark), BYTES, table=none).collect()
    assert all(r.n_tokens == len(ids_of(BYTES, r.text)) for r in got)


def test_records_round_trip(spark):
    df, folder = frame(spark), new_folder(spark)
    index = records.write_records(df, WORDS, folder, partitions=3)
    back = sorted(records.read_records(index, folder).collect(), key=lambda r: r.start)
    given_rows = sorted(((r.doc_id, r.text) for r in df.collect()), key=lambda r: (r[0] is not None, r[0] or 0))
    start = 0
    assert [r.doc_id for r in back] == [i for i, _ in given_rows]
    for r, (_, text) in zip(back, given_rows):
        ids = [*ids_of(WORDS, text), 2]
        assert (r.start, r.n_tokens, bytes(r.ids)) == (start, len(ids), np.array(ids, "<u4").tobytes())
        start += len(ids)
    mixed = records.read_shuffled(index, folder, seed=5, partitions=2).collect()
    assert sorted((r.start, bytes(r.ids)) for r in mixed) == [(r.start, bytes(r.ids)) for r in back]
    again = records.read_shuffled(records.open_index(spark, folder), folder, seed=5, partitions=2).collect()
    assert [r.start for r in again] == [r.start for r in mixed] != [r.start for r in back]


def test_files_are_read_by_as_many_tasks(spark, tmp_path):
    texts = [(i, f"text number {i} " * (i % 7)) for i in range(400)]
    df = spark.createDataFrame(texts, "doc_id long, text string")
    index = records.write_records(df, WORDS, f"{tmp_path}/r", partitions=12)
    files = index.select("file").distinct().count()
    back = records.read_records(index, f"{tmp_path}/r").withColumn("task", F.spark_partition_id())
    assert files == 12 and back.select("task").distinct().count() == files and back.count() == 400
    mixed = records.read_shuffled(index, f"{tmp_path}/r").withColumn("task", F.spark_partition_id())
    assert mixed.select("task").distinct().count() > files / 2 and mixed.count() == 400


def test_records_of_an_empty_table(spark):
    folder = new_folder(spark)
    index = records.write_records(frame(spark).limit(0), WORDS, folder)
    assert index.count() == 0 and records.read_records(index, folder).count() == 0


def test_damage_is_noticed(tmp_path):
    import io

    data = records.frame(b"payload")
    assert records.payload_at(io.BytesIO(data), "x") == b"payload" and records.payload_at(io.BytesIO(b""), "x") is None
    assert struct.unpack("<Q", data[:8])[0] == 7
    for at in (0, 9, 13, len(data) - 1):
        bad = bytearray(data)
        bad[at] ^= 1
        with pytest.raises(ValueError):
            records.payload_at(io.BytesIO(bytes(bad)), "x")
    with pytest.raises(ValueError):
        records.payload_at(io.BytesIO(data[:-2]), "x")
    assert records.masked(b"") == 0xA282EAD8 and zlib.crc32(b"") == 0


def test_digests_of_a_query_row(spark):
    from plumbline.llm.queries import encoding_digests

    (row,) = encoding_digests(spark.createDataFrame([(1, "Some words here")], "doc_id long, text string")).collect()
    ids = ids_of(WORDS, "Some words here")
    assert row.ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()


def test_a_worker_keeps_tables_of_one_operator():
    class Table:
        def __init__(self, key):
            self.own = self  # as an encoder and its pieces refer to each other

    first = frames.worker_table("one", "a", Table)
    gone = weakref.ref(first)
    assert frames.worker_table("one", "a", Table) is first
    frames.keep_tables("one")
    assert frames.worker_table("one", "a", Table) is first
    del first
    frames.keep_tables("another")
    assert gone() is None


def test_another_operator_frees_the_encoder(spark):
    own = bpe.encoder(WORDS)
    assert bpe.encoder(WORDS) is own
    docs = spark.createDataFrame([(n, "plain words") for n in range(4)], "doc_id long, text string").coalesce(1)

    def tables(texts):
        return [pa.array([sorted(name for name, _ in frames._tables) for _ in texts], pa.list_(pa.string()))]

    added = [StructField("tables", ArrayType(StringType()))]
    assert bpe.encode_decode(docs, WORDS).count() == 4
    assert {tuple(r.tables) for r in frames.over_texts(docs, "text", tables, added).collect()} == {()}
