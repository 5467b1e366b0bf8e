"""Languages, chats, secrets and mixes."""

import itertools
import random
import re

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from plumbline.llm import chat, language, mixing, secret_scan

BYTES = public_tokenizers.path("byte_bpe_50k.json")

ENGLISH = "the people of this town were thinking about whether they should have another meeting with their neighbours"
GERMAN = "die leute dieser stadt überlegten ob sie noch eine weitere sitzung mit ihren nachbarn haben sollten und warum"


def made_texts(n, seed=0):
    draw = random.Random(seed)
    out = []
    for i in range(n):
        lang = ("en", "de")[i % 2]
        words = (ENGLISH if lang == "en" else GERMAN).split()
        out.append((" ".join(draw.choices(words, k=draw.randint(3, 40))), lang))
    return out


def test_forward_backward_equals_the_sum_over_all_paths():
    draw = np.random.default_rng(0)
    lengths = np.array([1, 4, 0, 3])
    scores, moves = draw.normal(size=(8, 3)).astype(np.float32), draw.normal(size=(3, 3))
    pairs = np.zeros((3, 3))
    got = language.marginals(scores, lengths, moves, pairs)
    want, want_pairs, at = np.zeros((8, 3)), np.zeros((3, 3)), 0
    for n in lengths:
        paths = list(itertools.product(range(3), repeat=int(n)))
        weight = np.array([np.exp(sum(scores[at + t, y] for t, y in enumerate(p)) + sum(moves[a, b] for a, b in zip(p, p[1:]))) for p in paths])
        for p, w in zip(paths, weight / weight.sum()):
            for t, y in enumerate(p):
                want[at + t, y] += w
            for a, b in zip(p, p[1:]):
                want_pairs[a, b] += w
        at += int(n)
    assert np.allclose(got, want, atol=1e-6) and np.allclose(pairs, want_pairs, atol=1e-6)


def test_languages_of_held_out_and_switching_texts(spark):
    rows = made_texts(300)
    odd = [(None, "en"), ("", "de"), ("123 !?", "en"), ("ganz ohne", None), ("the " * 20_000, "en"), rows[0]]
    df = spark.createDataFrame([(*r, 1, "s") for r in rows + odd], "text string, lang string, score int, lang_pred string")
    model = language.train(df)
    assert model.labels == ["de", "en"]
    test = [(i, *t) for i, t in enumerate(made_texts(100, seed=9))]
    test += [(900, None, None), (901, "", None), (902, " 12 ²!", None), (903, "the " * 30_000, None)]
    got = {r.doc_id: r for r in language.identify(spark.createDataFrame(test, "doc_id int, text string, score string"), model).collect()}
    assert sum(got[i].lang_pred == lang for i, _, lang in test[:100]) >= 98
    assert all(got[i].lang_pred == "und" and got[i].score == 0 for i in (900, 901, 902)) and got[903].lang_pred == "en"
    assert all(0 <= r.score <= 1 for r in got.values())
    mixed = spark.createDataFrame([(f"{ENGLISH}. {GERMAN}",), (None,)], "text string")
    first, second = language.label_words(mixed, model).collect()
    assert [w.lang for w in first.words] == ["en"] * len(ENGLISH.split()) + ["de"] * len(GERMAN.split()) and second.words == []


def test_long_runs_of_letters_are_read_whole(spark):
    chinese, japanese = "我们的城市里有很多人在讨论这个问题并且希望尽快解决它", "わたしたちのまちではおおくのひとがこのもんだいについてはなしあっています"
    draw = random.Random(5)

    def run(letters, n):
        return "".join(draw.choices(letters, k=n))

    rows = [(run(a, draw.choice([30, 300, 3000])), lang) for _ in range(40) for a, lang in ((chinese, "zh"), (japanese, "ja"))]
    model = language.train(spark.createDataFrame(rows, "text string, lang string"))
    # all but the ends of the text is in the other language
    text = run(japanese, 40) + run(chinese, 10_000) + run(japanese, 40)
    df = spark.createDataFrame([(text,), (run(chinese, 640) + run(japanese, 640),)], "text string")
    first, second = language.label_words(df, model).collect()
    assert "".join(w.word for w in first.words) == text and max(len(w.word) for w in first.words) == language.LONG_WORD
    assert [w.lang for w in second.words] == ["zh"] * 10 + ["ja"] * 10
    assert language.identify(df, model).first().lang_pred == "zh"
    assert sum(map(len, language.stretch(language.words_of(text)))) <= language.LETTERS_PER_DOC
    assert len(language.stretch(["word"] * 1000)) == language.WORDS_PER_DOC


def test_copies_do_not_push_out_other_labels(spark):
    # a text that is picked of 3,000 rows, its copies before all other rows
    tried = spark.range(300_000).selectExpr("concat('the people of town number ', id) as text")
    first = tried.where("pmod(xxhash64(text), 1 << 30) < (1 << 30) * 0.02").orderBy(F.xxhash64("text")).first().text
    german = [(t, lang) for t, lang in made_texts(60) if lang == "de"]
    df = spark.createDataFrame([(first, "en")] * 3000 + german, "text string, lang string")
    assert language.train(df, docs_per_label=100).labels == ["de", "en"]
    rows = sorted(map(tuple, language.training_rows(df, docs_per_label=100).collect()))
    assert rows == sorted({(first, "en"), *german})
    assert language.training_rows(df, docs_per_label=5).groupBy("lang").count().where("count > 5").count() == 0


def test_all_labels_are_learned(spark):
    rows = [(f"{w} {n}", f"l{n % 300}") for n in range(3000) for w in ("some", "words")]
    sample = language.training_rows(spark.createDataFrame(rows, "text string, lang string"))
    assert {r.lang: r["count"] for r in sample.groupBy("lang").count().collect()} == {f"l{n}": language.LEAST_DOCS for n in range(300)}
    assert [language.docs_for(k, 400) for k in (1, 4, 300)] == [400, 400, 4] and language.docs_for(300, 2) == 2


def test_language_without_labels(spark):
    df = spark.createDataFrame([("some words", None), (None, "en")], "text string, lang string")
    model = language.train(df)
    assert [(r.lang_pred, r.score) for r in language.identify(df, model).collect()] == [("und", 0.0)] * 2
    assert language.identify(df.limit(0), model).count() == 0
    one = language.train(spark.createDataFrame([("some words", "en")], "text string, lang string"))
    assert [r.lang_pred for r in language.identify(df, one).collect()] == ["en", "und"]


@given(st.text(alphabet="<|\\>endstart\n ", max_size=40))
@settings(max_examples=300, deadline=None)
def test_escapes_are_undone(text):
    assert chat.unescape(chat.escape(text)) == text and "<|" not in chat.escape(text)


@given(st.lists(st.tuples(st.sampled_from(["user", "assistant", "<|end|>", None]), st.none() | st.text(alphabet="<|\\>end é😀[]/S\n", max_size=25)), max_size=6))
@settings(max_examples=200, deadline=None)
def test_masks_give_back_the_learned_texts(turns):
    formatted, spans = chat.render([{"role": r, "text": t} for r, t in turns])
    coded = chat.chat_tokenizer(BYTES).encode(formatted, add_special_tokens=False)
    offsets = np.array(coded.offsets, np.int32).reshape(-1, 2)
    mask = chat.covered(spans, offsets[:, 0], offsets[:, 1])
    assert chat.text_under(formatted, mask, *offsets.T.tolist()) == "".join(t or "" for r, t in turns if r == "assistant")
    assert [(chat.unescape(r), chat.unescape(t)) for r, t in chat.TURN.findall(formatted)] == [(r or "", t or "") for r, t in turns]


def test_chat_frames(spark):
    long = "long 😀 text " * 20_000
    rows = [(1, 1, "assistant", "second"), (1, 0, "user", "first <|end|>"), (2, 0, "assistant", None), (3, None, None, ""), (None, 0, "assistant", "no id"), (4, 0, "assistant", long)]
    rows += [(5, 0, "assistant", "a")] * 2 + [(6, n, "assistant" if n % 2 else "user", f"turn {n}") for n in range(300)]
    df = spark.createDataFrame([(*r, "x", "y") for r in rows], "conv_id long, turn long, role string, text string, ids string, mask string")
    formatted = chat.format_chats(df, BYTES)
    back = {r.conv_id: r for r in chat.read_back(formatted).collect()}
    assert [t.text for t in back[1].turns] == ["first <|end|>", "second"] and back[1].loss_text == "second"
    assert back[2].loss_text == "" and back[3].turns[0].role == "" and back[None].loss_text == "no id" and back[4].loss_text == long
    assert back[5].loss_text == "aa" and len(back[6].turns) == 300 and back[6].loss_text == "".join(f"turn {n}" for n in range(1, 300, 2))
    for r in formatted.collect():
        assert len(r.ids) == len(r.mask) == len(r.starts) == len(r.ends)
    assert chat.read_back(chat.format_chats(df.limit(0), BYTES)).count() == 0


def plain_base(text):
    pattern = r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
    found = [(m.start(), m.end(), "assign") for m in re.finditer(pattern, text, re.I | re.A) if len(m[2]) >= 6]
    found += [(m.start(), m.end(), "access") for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    return found + [(m.start(), m.end(), "hex") for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 24]


@given(st.text(alphabet="abcdef0129 AKIA=:'\"", max_size=60) | st.lists(st.sampled_from(["password", "API_KEY", "apikey", "ToKen", " = ", ":", '"', "abc123def", "AKIA", "B2" * 9, "0f" * 13, "ſecret", "é", "\n"]), max_size=9).map("".join))
@settings(max_examples=300, deadline=None)
def test_base_spans(text):
    assert secret_scan.base_spans(text) == plain_base(text)


def random_string(draw, alphabet, n):
    return "".join(draw.choices(secret_scan.ALPHABETS[alphabet], k=n))


def test_random_strings_are_found_and_words_are_not(spark):
    draw = random.Random(7)
    words = (ENGLISH + " " + GERMAN).split()
    texts = []
    for i in range(400):
        parts = draw.choices(words, k=60)
        secret = random_string(draw, ("base62", "base64", "upper36", "upper_hex")[i % 4], 64) if i % 4 != 3 or i % 8 == 3 else None
        if i % 2 == 0 and secret:
            parts.insert(30, secret)
        parts.insert(10, ("version2_of_the_long_identifier", "aaaaaaaaaaaaaaaaaaaaaaaaaa1", "under_score_name_with_many_parts_2", "http2_server_push_promise_frame")[i % 4])
        texts.append((i, " ".join(parts), secret if i % 2 == 0 else None))
    df = spark.createDataFrame([(i, t, "x") for i, t, _ in texts], "doc_id long, text string, spans string")
    got = {r.doc_id: (r.text, [(s.start, s.end) for s in r.spans if s.kind == "random"]) for r in secret_scan.find_secrets(df).collect()}
    wanted = [(i, s) for i, _, s in texts if s]
    hits = sum(any(got[i][0][a:b].strip("=") in s or s in got[i][0][a:b] for a, b in got[i][1]) for i, s in wanted)
    false = sum(len(got[i][1]) for i, _, s in texts if not s)
    assert hits >= 0.9 * len(wanted) and false <= 0.02 * len(texts)


def test_keys_in_mixed_runs_unspaced_text_and_one_class(spark):
    draw = random.Random(3)
    words = (ENGLISH + " " + GERMAN).split()
    frames = ["https://x.com/my-app/{}", "sk_live+v-{}", "密钥是{}。", "é{}ß", "{}", "-" * 40 + " {}"]
    alphabets = ["base62", "base62", "base62", "base64url", "letters52", "base62"]
    rows = []
    for i in range(240):
        key = random_string(draw, alphabets[i % 6], 64)
        rows.append((i, " ".join([*draw.choices(words, k=20), frames[i % 6].format(key), *draw.choices(words, k=20)]), key))
    rows += [(1000 + i, " ".join(draw.choices(words, k=40)) + " a-b/long_path/of-many+words/in_one-run/without_a-key", None) for i in range(240)]
    found = secret_scan.find_secrets(spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string"))
    clean = {r.doc_id: r.text for r in secret_scan.redact(found).collect()}
    for kind in range(6):
        gone = [key not in clean[i] and "[SECRET]" in clean[i] for i, _, key in rows if key and i % 6 == kind]
        assert sum(gone) >= 0.9 * len(gone), frames[kind]
    assert sum(clean[i] != t for i, t, key in rows if not key) <= 2
    key = random_string(draw, "base62", 32)
    shares = {name: np.full(len(a), 1 / len(a)) for name, a in secret_scan.ALPHABETS.items()}
    run = f"com/my-app/{key}"
    assert (11, 43) in [c[:2] for c in secret_scan.candidates(run, shares)] and secret_scan.candidates("-_/" * 20, shares) == []


def test_secrets_of_odd_rows(spark):
    rows = [(1, None), (2, ""), (3, "é password=abcdef1 AKIA" + "Z9" * 9 + " " + "0a" * 15), (3, "token: 12345"), (4, "secret=" + "ab12" * 50_000), (None, "api_key='k-9876543'")]
    df = spark.createDataFrame([(*r, "x", "y") for r in rows], "doc_id long, text string, base string, candidates string")
    found = secret_scan.find_secrets(df)
    for r in found.collect():
        spans = sorted(plain_base(r.text or ""), key=lambda s: (s[0], secret_scan.KINDS.index(s[2]), s[1]))
        assert [(s.start, s.end, s.kind) for s in r.spans if s.kind != "random"] == spans
    clean = {(r.doc_id, r.text) for r in secret_scan.redact(found).collect()}
    assert clean == {(1, None), (2, ""), (3, "é [SECRET] [SECRET] [SECRET]"), (3, "token: 12345"), (4, "[SECRET]"), (None, "[SECRET]'")}
    assert secret_scan.find_secrets(df.limit(0)).count() == 0


def test_false_discovery_limit():
    assert secret_scan.least_evidence({}, 0, 0.01) == float("inf")
    assert secret_scan.least_evidence({0: 100}, 100, 0.01) == float("inf")
    steps = {0: 900, 20: 50, 60: 50}
    limit = secret_scan.least_evidence(steps, 1000, 0.01)
    assert limit == 6.0 and 1000 * 10**-limit <= 0.01 * 50


def test_evidence_grows_with_length():
    shares = np.full(16, 1 / 32)
    shares[:2] += 0.25
    assert secret_scan.evidence(15, 40, shares) > secret_scan.evidence(15, 20, shares) > 0 == secret_scan.evidence(1e6, 20, shares)


def test_targets():
    sizes = {"b": 100, "a": 100, None: 100, "c": 1000, "d": 0}
    got = mixing.targets(sizes)
    assert list(sorted(got, key=str)) == sorted(sizes, key=str) and got["d"] == 0
    assert abs(sum(got.values()) - 1.5 * 1300) < 1e-6 and all(got[s] <= 2 * sizes[s] + 1e-9 for s in sizes)
    assert got["a"] == got["b"] == got[None] == 200 and abs(got["c"] - 1350) < 1e-9
    assert mixing.targets({}) == {} and mixing.targets({"x": 0}) == {"x": 0} and mixing.targets({"x": 10}) == {"x": 15}


def test_flight_keeps_totals_and_chances():
    sizes = np.array([draw for draw in range(1, 41)])[::-1]
    taken = np.zeros(40)
    for seed in range(600):
        p = mixing.flight(np.full(40, 0.3), sizes, random.Random(seed))
        assert abs((p * sizes).sum() - 0.3 * sizes.sum()) < 1e-6 and abs(p.sum() - 12) < 1e-6
        assert ((p > 0) & (p < 1)).sum() <= 2
        taken += p
    assert np.abs(taken / 600 - 0.3).max() < 0.08
    assert set(mixing.flight(np.full(6, 0.5), np.full(6, 3), random.Random(1)).tolist()) == {0.0, 1.0}


@pytest.mark.parametrize("block", [2048, 20])
def test_mix(spark, monkeypatch, block):
    draw = random.Random(block)
    rows = [(i, "w " * draw.randint(1, 90), draw.choice(["a", "b", "c", None])) for i in range(900)]
    rows += [(5000 + i, "big " * 4000, "big") for i in range(3)] + [(1, None, "a"), (2, "", "b"), (3, "x y", "a"), (3, "x y", "a"), (None, "p q r", "c")]
    df = spark.createDataFrame([(*r, "m", 5) for r in rows], "doc_id long, text string, source string, mark string, copies int")
    monkeypatch.setattr(mixing, "BLOCK_ROWS", block)
    monkeypatch.setattr(mixing.draw, "__defaults__", (mixing.SEED, block))
    mixed = mixing.mix(df)
    got = mixed.collect()
    again = mixing.mix(df.repartition(3, "text")).collect()
    assert sorted(got, key=str) == sorted(again, key=str)
    sizes = {}
    for _, t, s in rows:
        sizes[s] = sizes.get(s, 0) + len((t or "").split())
    goal = mixing.targets(sizes)
    by_target = {}
    for r in got:
        assert r.taken == r.size * r.copies <= 2 * r.size * r.rows
        key = (r.source_size, r.target)
        by_target[key] = by_target.get(key, 0) + r.taken
    for s in sizes:
        slack = 4000 if s == "big" else 30
        assert abs(by_target[sizes[s], goal[s]] - goal[s]) <= slack, s
    out = mixing.mixed_rows(df, mixed)
    assert out.columns == df.columns and out.count() == sum(r.copies for r in got)
    assert mixing.mix(df.limit(0)).count() == 0 and mixing.mixed_rows(df.limit(0), mixing.mix(df.limit(0))).count() == 0


def test_targets_hold_with_equal_rows_and_any_columns(spark):
    """A third of a source, and of another nearly all, are equal rows; they share the copies."""
    draw = random.Random(5)
    rows = [(7, "same text of six words here", "a")] * 1000 + [(i, "w " * draw.randint(1, 9), "a") for i in range(10, 2010)]
    rows += [(3, "t u v", "b")] * 900 + [(9000 + i, "x", "b") for i in range(50)] + [(9100 + i, "y " * 40, "c") for i in range(300)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(4)
    df = df.withColumns({"base": F.create_map(F.lit("k"), F.col("doc_id")), "mark": F.array(F.create_map(F.lit(1), F.lit("v"))), "n": F.lit(1)})
    mixed = mixing.mix(df).collect()
    taken, goal = {}, {}
    for r in mixed:
        taken[r.source_size] = taken.get(r.source_size, 0) + r.taken
        goal[r.source_size] = r.target
    assert len(goal) == 3 and all(abs(taken[s] - goal[s]) <= 0.01 * goal[s] for s in goal)
    each = mixing.by_row(mixing.mix(df)).collect()
    assert len(each) == len(rows) and sum(r.taken for r in each) == sum(taken.values())
    assert all(r.taken == r.size * r.copies <= 2 * r.size for r in each)
    same = [r.copies for r in each if r.doc_id == 7]
    assert len(same) == 1000 and max(same) - min(same) <= 1
    out = mixing.mixed_rows(df, mixing.mix(df))
    assert out.dtypes == df.dtypes
    number = {}
    for r in out.collect():
        number[r.doc_id] = number.get(r.doc_id, 0) + 1
    assert number[7] == sum(same) and sum(number.values()) == sum(r.copies for r in mixed)


def test_columns_of_any_name_and_type_stay(spark):
    df = spark.createDataFrame([(1, "password = hunter22 and more"), (2, None)], "doc_id long, text string").withColumns(
        {"base": F.lit("b"), "candidates": F.create_map(F.lit(1), F.lit(2)), "spans": F.lit("mine"), "_base": F.lit(0)}
    )
    got = secret_scan.find_secrets(df, spans="found")
    assert got.columns == [*df.columns, "found"]
    row = {r.doc_id: r for r in got.collect()}
    assert row[1].spans == "mine" and row[1].base == "b" and row[1].candidates == {1: 2} and [s.kind for s in row[1].found] == ["assign"]
    assert secret_scan.redact(got, spans="found").where("doc_id = 1").first().text == "[SECRET] and more"


def test_long_texts_and_many_labels_in_small_steps(spark, monkeypatch):
    """Sums over pieces of a long text are those of the whole chain."""
    labels = [f"l{i}" for i in range(40)]
    draw = np.random.default_rng(3)
    model = language.Model(labels, draw.normal(size=(language.SLOTS, 40)).astype(np.float32), np.zeros(40, np.float32), draw.normal(size=(40, 40)).astype(np.float32), frozenset())
    each = [[f"w{draw.integers(50)}" for _ in range(n)] for n in (3, 0, 700, 40, 1, 90)]
    want = np.array([language.marginals(model.scores(w), np.array([len(w)]), model.transitions).sum(0) if w else np.zeros(40) for w in each])
    sizes = []
    real = language.marginals
    monkeypatch.setattr(language, "marginals", lambda scores, *rest: sizes.append(scores.size) or real(scores, *rest))
    for cells in (1 << 20, 4000, 400, 40):
        sizes.clear()
        monkeypatch.setattr(language, "CELLS", cells)
        assert np.allclose(language.label_sums(model, each), want, atol=1e-6)
        assert max(sizes, default=0) <= cells


def test_shuffled_letters_are_noise_and_languages_are_not(spark):
    rows = made_texts(400)
    model = language.train(spark.createDataFrame(rows, "text string, lang string"), noise="zxx")
    assert set(model.labels) == {"en", "de", "zxx"} and 0.5 <= model.noise_limit < 0.95
    test = made_texts(100, seed=5)
    frame = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(test)] + [(1000 + i, language.shuffled(t)) for i, (t, _) in enumerate(test)], "i int, text string")
    got = {r.i: r for r in language.identify(frame, model, noise="share").collect()}
    assert sum(got[i].lang_pred == lang for i, (_, lang) in enumerate(test)) >= 98 and all(r.lang_pred != "zxx" for r in got.values())
    assert sum(got[i].share <= model.noise_limit for i in range(100)) >= 99
    long = [1000 + i for i, (t, _) in enumerate(test) if len(t.split()) > 5]
    assert sum(got[i].share > model.noise_limit for i in long) >= 0.95 * len(long)
