"""Language-model scores against sums over single words."""

import math
import random
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from plumbline.llm import lm, queries

WORDS = {
    "a": "the cat sat on the mat and the dog ran after the red ball in a park".split(),
    "b": "der hund lief hinter dem roten ball her und die katze saß auf ihrer matte".split(),
}


def made(n, seed=0):
    draw = random.Random(seed)
    out = []
    for i in range(n):
        words = WORDS["ab"[i % 2]]
        at, text = draw.randrange(len(words)), []
        for _ in range(draw.randint(0, 60)):
            text.append(words[at].upper() if draw.random() < 0.1 else words[at])
            at = (at + 1) % len(words) if draw.random() < 0.8 else draw.randrange(len(words))
            if draw.random() < 0.05:
                text.append(f"rare{draw.randrange(400)}")
        out.append((i, draw.choice([" ", "\n", "\t "]).join(text)))
    return out


def words_of(text):
    text = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    for c in "\t\n\x0b\x0c\r":
        text = text.replace(c, " ")
    return [w for w in text.split(" ") if w]


def held_out(i):
    return i is not None and zlib.crc32(str(i).encode()) % 10 == 0


def trained_on(rows):
    return [t for i, t in rows if i is not None and not held_out(i)]


def base_scores(rows):
    """(held_out, n_tokens, n_known, N, base_score) by the stated rule."""
    c = Counter()
    for t in trained_on(rows):
        c.update([*words_of(t), None])
    total, space = sum(c.values()), sum(c.values()) + 0.1 * (len(c) + 1)
    return [
        (held_out(i), len(words_of(t)) + 1, sum(c[w] > 0 for w in [*words_of(t), None]), total, sum(math.log10((c[w] + 0.1) / space) for w in [*words_of(t), None]))
        for i, t in rows
    ]


ODD = [
    (5000, None), (5001, ""), (5002, " \t\r\n "), (5003, "unseen words only"), (5004, "the\xa0cat ÉTÉ été \x85 \x1c"), (5005, "the cat " * 20_000),
    (None, "the cat without an id"), (7, "a repeated row"), (7, "a repeated row"), (5006, "x" * 100_000),
]


@pytest.fixture(scope="module")
def rows():
    return made(600) + ODD


@pytest.fixture(scope="module")
def folder(spark, rows, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("tables"))
    spark.createDataFrame(rows, "doc_id long, text string").repartition(3).write.parquet(f"{path}/documents.parquet")
    return path


def key(i, *rest):
    return (i is None, i or 0, *rest)


def test_the_query_against_single_sums(spark, folder, rows):
    df = queries.QUERIES["op11_lm_scores"](spark, folder)
    assert df.columns == ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"]
    got = sorted(df.collect(), key=lambda r: key(r.doc_id, r.n_tokens))
    want = sorted(zip([i for i, _ in rows], base_scores(rows)), key=lambda r: key(r[0], r[1][1]))
    assert len(got) == len(want)
    for r, (i, w) in zip(got, want):
        assert (r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (i, *w[:4])
        assert r.base_score == pytest.approx(w[4], rel=1e-9) and -math.inf < r.score < 0


def model_of(spark, texts):
    return lm.train(spark.createDataFrame([(t,) for t in texts], "text string").coalesce(2))


def one_by_one(model, counts, text):
    """The score by a softmax over the classes at each word."""
    classes = lm.END + 1 + model.frequent
    p = {k: v.astype(float) for k, v in lm.Shape(classes).views(model.flat).items()}
    own = {w.decode(): lm.END + 1 + i for i, w in enumerate(model.words[: model.frequent])}
    before, far, total = lm.END, lm.END, 0.0
    for w in [*words_of(text), None]:
        c = lm.END if w is None else own.get(w, lm.rare_class(w.encode()))
        logits = p["Q"] @ (p["R"][before] @ p["A"] + p["R"][far] @ p["B"]) + p["b"]
        total += logits[c] - np.log(np.exp(logits).sum())
        if c < lm.RARE:
            total += math.log((counts[w] + 0.1) / (model.rare_tokens[c] + 0.1 * (model.rare_words[c] + 1)))
        before, far = c, before
    return total / math.log(10)


@pytest.mark.parametrize("table, classes", [(1 << 18, 2048), (40, 80), (90, 2048)])
def test_scores_are_normalised_and_better_than_counts(spark, monkeypatch, table, classes):
    """Whatever the number of classes, and of words whose counts come by a join."""
    monkeypatch.setattr(lm, "TABLE", table)
    monkeypatch.setattr(lm, "CLASSES", classes)
    rows = made(500, seed=2)
    model = model_of(spark, [t for _, t in rows])
    counts = Counter(w for _, t in rows for w in words_of(t))
    assert model.train_tokens == sum(counts.values()) + 500 and model.different == len(counts) + 1
    rare = {w: n for w, n in counts.items() if w.encode() not in model.words[: model.frequent]}
    for c in range(lm.RARE):
        mine = [n for w, n in rare.items() if lm.rare_class(w.encode()) == c]
        assert (sum(mine), len(mine)) == (model.rare_tokens[c], model.rare_words[c])
    test = made(60, seed=3) + ODD[:5]
    frame = spark.createDataFrame([(*r, "clash", 1) for r in test], "doc_id long, text string, Score string, row int")
    out = lm.score(frame, model)
    assert out.columns == ["doc_id", "text", "row", "n_tokens", "n_known", "train_tokens", "base_score", "score"]
    got = {r.doc_id: r for r in out.collect()}
    assert all(got[i].score == pytest.approx(one_by_one(model, counts, t), rel=1e-4, abs=1e-4) for i, t in test)
    if classes == 2048:
        assert sum(r.score for r in got.values()) > 0.9 * sum(r.base_score for r in got.values())


def test_training_learns_what_follows_what(spark):
    texts = ["one two three four five six seven " * 40] * 150 + ["seven five three one six four two " * 40] * 150
    model = model_of(spark, texts)
    got = lm.score(spark.createDataFrame([("one two three four five",), ("five two one four three",)], "text string"), model).collect()
    score = {r.text: r for r in got}
    assert score["one two three four five"].score > score["five two one four three"].score + 1
    assert score["one two three four five"].score > score["one two three four five"].base_score


def test_gradients_lower_the_loss():
    """A step of the training lowers the noise-contrastive loss of its own tokens."""
    draw = np.random.default_rng(0)
    chances = np.full(100, 0.01)
    p = lm.Shape(100).views(lm.first_parameters(chances))
    p["Q"][:] = draw.normal(0, 0.1, p["Q"].shape)
    one, two, target, noise = (draw.integers(0, 100, n) for n in (400, 400, 400, 30))

    def loss():
        h = p["R"][one] @ p["A"] + p["R"][two] @ p["B"]
        lift = np.log(30 * 0.01)
        real = (h * p["Q"][target]).sum(1) + p["b"][target] - lift
        drawn = h @ p["Q"][noise].T + p["b"][noise] - lift
        return np.log1p(np.exp(-real)).mean() + np.log1p(np.exp(drawn)).sum(1).mean()

    before = loss()
    for _ in range(20):
        lm.step(p, one, two, target, noise, np.log(30 * chances).astype(np.float32))
    assert loss() < before


def test_empty_tables(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    model = lm.train(none)
    got = {r.doc_id: r for r in lm.score(spark.createDataFrame([(1, None), (2, "a b a")], "doc_id long, text string"), model).collect()}
    assert got[1].n_known == got[2].n_known == 0 and got[2].n_tokens == 4 and got[2].train_tokens == 0
    assert got[2].base_score == pytest.approx(0) and got[2].score < 0
    assert lm.score(none, model).collect() == []
