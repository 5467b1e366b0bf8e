"""Phrases against counts of all phrases in plain Python."""

import random
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from plumbline.llm import phrases, queries


@settings(max_examples=60, deadline=None)
@given(st.data())
def test_a_trie_finds_its_phrases_and_no_other(data):
    depth, top = data.draw(st.integers(2, 4)), data.draw(st.sampled_from([3, 40, 5000]))
    word = st.integers(1, top)
    rows = sorted(set(data.draw(st.lists(st.tuples(*[word] * depth), min_size=1, max_size=80))))
    trie = phrases.build_trie(np.array(rows, np.int32))
    codes = [c for r in data.draw(st.lists(st.sampled_from(rows), max_size=20)) for c in (*r, *data.draw(st.lists(st.integers(0, top + 3), max_size=2)))]
    at, found = trie.find(np.array(codes, np.int32))
    want = {(i, rows.index(tuple(codes[i : i + depth]))) for i in range(len(codes) - depth + 1) if tuple(codes[i : i + depth]) in rows}
    assert set(zip(at.tolist(), found.tolist())) == want and len(at) == len(want)


def test_a_wide_trie():
    draw = np.random.default_rng(1)
    rows = np.unique(np.column_stack([draw.zipf(1.2, 30_000) % 9000 + 1, draw.zipf(1.2, 30_000) % 9000 + 1, draw.integers(1, 50, 30_000)]).astype(np.int32), axis=0)
    trie = phrases.build_trie(rows)
    at, found = trie.find(np.column_stack([rows, np.zeros(len(rows), np.int32)]).ravel())
    assert (at == 4 * np.arange(len(rows))).all() and (found == np.arange(len(rows))).all()
    # no more than a few slots a state
    assert len(trie.base) < 9200 + 4 * 7 * len(rows)


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)


def plain(rows, least, longest, top, cover):
    f, n = defaultdict(Counter), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        for piece in re.split("[.,;:!?\n-\r]", lower(text or "")):
            w = re.findall("[^ \t]+", piece)
            n[lang] += len(w)
            for k in range(1, longest + 1):
                f[lang].update(tuple(w[i : i + k]) for i in range(len(w) - k + 1))
    out = []
    for lang, all_counts in f.items():
        counts = {p: c for p, c in all_counts.items() if c >= least}
        scored = []
        for p, a in counts.items():
            if len(p) == 1 or any(
                len(q) > len(p) and 100 * b >= cover * a and any(q[i : i + len(p)] == p for i in range(len(q))) for q, b in counts.items()
            ):
                continue
            score, k = min((1000 * a * n[lang] // (counts[p[:k]] * counts[p[k:]]), k) for k in range(1, len(p)))
            scored.append((-score, -a, " ".join(p).encode(), counts[p[:k]], counts[p[k:]]))
        for rank, (s, a, p, l, r) in enumerate(sorted(scored)[:top], 1):
            out.append((lang, rank, p.decode(), -a, l, r, n[lang], -s))
    return sorted(out)


def made(seed, n=400):
    draw = random.Random(seed)
    words = [f"w{i}" for i in range(30)] + ["Été", "ÉTÉ", "a\x00b", "x y", "🙂"]
    weights = [1 / (i + 1) for i in range(len(words))]
    rows = []
    for i in range(n):
        text = ""
        for w in draw.choices(words, weights, k=draw.randint(0, 40)):
            text += w.upper() if draw.random() < 0.2 else w
            text += draw.choice([" "] * 8 + ["  ", "\t", ". ", ",", "\n", "\r\n", "\x0b", " ? ! "])
        rows.append((draw.choice(["en", "en", "de", None, "und", ""]), text))
    rows += [("en", "new york city hall new york")] * 60 + [("en", "w0 " * 50), ("fr", None), ("fr", ""), (None, " . "), ("de", "w1 w2 w3 " * 3000)]
    return rows


@pytest.fixture(scope="module")
def docs(spark):
    rows = made(3)
    frame = spark.createDataFrame(rows, "lang string, text string").repartition(5)
    return rows, frame.withColumns({"grp": F.lit(1), "n": F.lit("x"), "f": F.lit(2), "phrase": F.create_map(F.lit(1), F.lit(2))})


def collected(df):
    assert df.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    return sorted(map(tuple, df.collect()))


@pytest.mark.parametrize("least, top, cover, dictionary, trie, shard", [
    (20, 2000, 100, 1 << 19, 1 << 17, 1 << 22),
    (5, 10, 90, 1 << 19, 1 << 17, 500),
    (12, 2000, 100, 12, 8, 300),
    (1, 50, 100, 1 << 19, 1 << 17, 200),
])
def test_every_phrase_whatever_the_bounds(docs, monkeypatch, least, top, cover, dictionary, trie, shard):
    rows, frame = docs
    monkeypatch.setattr(phrases, "DICTIONARY", dictionary)
    monkeypatch.setattr(phrases, "TRIE", trie)
    monkeypatch.setattr(phrases, "SHARD", shard)
    if least == 1:
        rows = [r for r in rows if len(r[1] or "") < 300][:60]
        frame = frame.where("coalesce(length(text), 0) < 300").sparkSession.createDataFrame(rows, "lang string, text string")
    if trie == 8:
        # several tries a level: fewer texts keep the number of jobs small
        rows = [("en", "a b c d e f g"), ("en", "b c d e f"), ("de", "a b c d x"), (None, "a b. c d")] * 12 + rows[:20]
        frame = frame.sparkSession.createDataFrame(rows, "lang string, text string")
    want = plain(rows, least, 5, top, cover)
    assert want and collected(phrases.collocations(frame, least=least, top=top, cover=cover)) == want


def test_scores_are_exact_beyond_64_bits(spark):
    draw = random.Random(0)
    rows = []
    for _ in range(200):
        l, r = draw.randint(10**11, 10**13), draw.randint(10**11, 10**13)
        rows.append((draw.randint(10**10, min(l, r)), draw.randint(10**13, 10**15), l, r))
    rows += [(7, 3, 1000, 21), (100, 10**15, 100, 100), (10**13, 10**15, 10**13, 10**13)]
    df = spark.createDataFrame(rows, "a long, n long, l long, r long")
    got = df.withColumn("s", phrases.cut_score(F.col("a"), F.col("n"), F.col("l"), F.col("r")))
    assert all(x.s == 1000 * x.a * x.n // (x.l * x.r) for x in got.collect()) and got.schema["s"].dataType.typeName() == "long"


def test_the_query_and_empty_tables(spark, docs, tmp_path):
    rows, frame = docs
    frame.select("lang", "text").write.parquet(f"{tmp_path}/documents.parquet")
    assert collected(queries.QUERIES["op12_phrase_collocations"](spark, str(tmp_path))) == plain(rows, 100, 5, 2000, 100)
    assert collected(phrases.collocations(frame.limit(0))) == []
    assert collected(phrases.collocations(spark.createDataFrame([("en", None), ("en", "one two")], "lang string, text string"))) == []


def test_rows_are_cut_only_after_a_zero():
    draw = np.random.default_rng(2)
    codes = np.append(np.where(draw.random(20_000) < 0.1, 0, draw.integers(1, 9, 20_000)), 0).astype(np.int32)
    offsets = phrases.row_offsets(codes, 128)
    assert offsets[0] == 0 and offsets[-1] == len(codes) and (codes[offsets[1:] - 1] == 0).all()
    assert np.diff(offsets).min() > 0 and np.diff(offsets).max() < 400
    assert phrases.row_offsets(np.array([5] * 1000 + [0], np.int32), 10).tolist() == [0, 1001]


def test_blocks_of_shards_sum_to_counts():
    draw = np.random.default_rng(3)
    shards = [Counter((draw.zipf(1.3, 5000) % 700 << 21 | draw.integers(1, 4, 5000)).tolist()) for _ in range(6)]
    batches = [b for s in shards for b in phrases.blocks(np.array(list(s), np.int64), np.array(list(s.values())), 90)]
    # a row for each part and shard, not for each phrase
    assert sum(b.num_rows for b in batches) <= 6 * 90 < sum(map(len, shards))
    rows = pa.Table.from_batches(batches).sort_by("part").to_batches(max_chunksize=7)
    want = {key for key, n in sum(shards, Counter()).items() if n >= 20}
    got = np.concatenate(list(phrases.summed(rows, 20))).tolist()
    assert want and len(got) == len(want) and set(got) == want
    assert list(phrases.blocks(np.zeros(0, np.int64), np.zeros(0, np.int64), 5)) == [] == list(phrases.summed([], 1))


@pytest.mark.parametrize("row, window, part", [(4, 1 << 18, 64), (128, 50, 1 << 20), (1, 1, 1000)])
def test_every_phrase_however_texts_and_phrases_are_dealt(docs, monkeypatch, row, window, part):
    rows, frame = docs
    for name, value in (("ROW", row), ("WINDOW", window), ("PART", part), ("SHARD", 700)):
        monkeypatch.setattr(phrases, name, value)
    assert collected(phrases.collocations(frame, least=20)) == plain(rows, 20, 5, 2000, 100)


def test_a_shard_passes_on_a_row_for_each_part(docs, monkeypatch):
    # so small shards keep back nothing: the rows must not be as many as the phrases
    monkeypatch.setattr(phrases, "SHARD", 300)
    frames, plainly = [], type(docs[1]).mapInArrow

    def noted(self, fn, schema, *rest):
        out = plainly(self, fn, schema, *rest)
        frames.extend([out] if {"keys", "numbers"} & set(out.columns) == {"keys", "numbers"} else [])
        return out

    monkeypatch.setattr(type(docs[1]), "mapInArrow", noted)
    phrases.collocations(docs[1], least=5)
    assert len(frames) == 4
    got = [r for passed in frames for r in passed.collect()]
    assert {r.part for r in got} == {0} and sum(len(r["keys"]) // 8 for r in got) > 3 * len(got) > 0


def test_codes_come_a_window_at_a_time():
    codes = np.tile(np.array([1, 2, 3, 0], np.int32), 5000)
    offsets = phrases.row_offsets(codes, phrases.ROW)
    batch = pa.RecordBatch.from_arrays([pa.array([codes[a:b].tobytes() for a, b in zip(offsets[:-1], offsets[1:])], pa.binary())], names=["codes"])
    got = list(phrases.windows(iter([batch]), 1000))
    assert (np.concatenate(got) == codes).all() and max(map(len, got)) < 1000 + 2 * phrases.ROW and all(w[-1] == 0 for w in got)
