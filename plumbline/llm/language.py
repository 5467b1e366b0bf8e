"""Language of words and texts with a linear-chain conditional random field.

A word is a run of letters; a run of more than ``LONG_WORD``, as in unspaced
script, is cut into consecutive words of that length. A word's features are its
beginnings and ends, its letter n-grams and, where the training words often have
it, the word itself.
The score of a label is a sum of learned weights; learned transitions join the
labels of neighbouring words. Forward and backward sums give each word's
probabilities, in texts of one language and in texts that switch. The language
of a text is the label with the largest share over its words.
"""

from __future__ import annotations

import random
import re
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F
from pyspark.sql.types import ArrayType, DoubleType, StringType, StructField, StructType

from plumbline.llm.frames import left_lookup, over_texts, settle

UNKNOWN = "und"
#: longest beginning and end of a word, and longest n-gram, that are features
AFFIX, GRAM = 4, 3
#: letters of a word at most; a longer run is several words
LONG_WORD = 64
WORD = re.compile(rf"[^\W\d_]{{1,{LONG_WORD}}}")
LETTERS = re.compile(r"[^\W\d_]+")
#: slots of the hashed weights
SLOTS = 1 << 17
#: training: labelled documents of each label, words and letters of each (a stretch at a hashed place),
#: least count of a lexicon word, passes, and pull towards zero
DOCS_PER_LABEL, WORDS_PER_DOC, LETTERS_PER_DOC, LEXICON_COUNT, PASSES, DECAY = 400, 128, 2048, 5, 30, 1e-3
#: words times labels in training, and documents of each label however many labels there are
TRAINING_CELLS, LEAST_DOCS = 1 << 24, 4
#: words times labels, padding included, that the sums run over at once
CELLS = 1 << 20
#: words a worker remembers, besides those of one step, and these words times labels
CACHE_ENTRIES, CACHE_CELLS = 400_000, 1 << 23
#: new words whose features are worked out at once
AT_ONCE = 4000


def words_of(text: str | None) -> list[str]:
    """Lower-case runs of letters of a whole text, long ones in pieces."""
    return [w for w in WORD.findall(text.lower()) if w.isalpha() or any(map(str.isalpha, w))] if text else []


def features(word: str, lexicon: frozenset[str]) -> list[int]:
    """Slots of a word's affix, n-gram and lexicon features."""
    names = [f"<{word[:n]}" for n in range(1, min(AFFIX, len(word)) + 1)]
    names += [f"{word[-n:]}>" for n in range(1, min(AFFIX, len(word)) + 1)]
    names += [word[i : i + n] for n in range(1, GRAM + 1) for i in range(len(word) - n + 1)]
    if word in lexicon:
        names.append(f"={word}")
    crc = zlib.crc32
    return [crc(n.encode()) % SLOTS for n in names]


class Rows(dict):
    """Row of each word met so far in a worker's table of scores."""

    def __missing__(self, word: str) -> int:
        self.fresh.append(word)
        row = self[word] = len(self)
        return row


@dataclass
class Model:
    labels: list[str]
    weights: np.ndarray
    bias: np.ndarray
    transitions: np.ndarray
    lexicon: frozenset[str]
    #: label of shuffled letters, if it was learned, and its largest mean probability for a text that is read
    noise: str | None = None
    noise_limit: float = 1.0

    def __post_init__(self):
        self.forget()

    def __reduce__(self):
        return Model, (self.labels, self.weights, self.bias, self.transitions, self.lexicon, self.noise, self.noise_limit)

    def forget(self) -> None:
        self.rows, self.known = Rows(), np.empty((0, len(self.labels)), np.float32)

    def scores(self, words: list[str]) -> np.ndarray:
        """Scores of the labels for each word."""
        if len(self.rows) > min(CACHE_ENTRIES, CACHE_CELLS // max(1, len(self.labels))):
            self.forget()
        self.rows.fresh = []
        at = np.fromiter(map(self.rows.__getitem__, words), np.int64, len(words))
        fresh = self.rows.fresh
        start, need = len(self.rows) - len(fresh), len(self.rows)
        if need > len(self.known):
            self.known = np.concatenate([self.known, np.empty((max(need, 10_000), len(self.labels)), np.float32)])
        for lo in range(0, len(fresh), AT_ONCE):
            slots = [features(w, self.lexicon) for w in fresh[lo : lo + AT_ONCE]]
            sizes = np.array([len(s) for s in slots])
            flat = np.array([x for s in slots for x in s])
            made = np.add.reduceat(self.weights[flat], np.cumsum(sizes) - sizes, axis=0) * (8 / sizes)[:, None] + self.bias
            self.known[start + lo : start + lo + len(slots)] = made
        return self.known[at]


def marginals(scores: np.ndarray, lengths: np.ndarray, transitions: np.ndarray, pairs: np.ndarray | None = None) -> np.ndarray:
    """Each word's label probabilities. ``scores`` holds the words of all texts one after the other.

    Texts are run side by side, those of like length together. ``pairs``, if
    given, gains the expected numbers of label pairs.
    """
    out = np.empty(scores.shape, np.float64)
    starts = np.cumsum(lengths) - lengths
    order = np.argsort(-lengths, kind="stable")
    order = order[lengths[order] > 0]
    move = np.exp(transitions.astype(np.float64))
    k = scores.shape[1]
    at = 0
    while at < len(order):
        longest = int(lengths[order[at]])
        some = order[at : at + max(1, CELLS // (longest * k))]
        at += len(some)
        size, first = lengths[some], starts[some]
        live = [int((size > t).sum()) for t in range(longest)]
        local = np.zeros((longest, len(some), k))
        for t in range(longest):
            e = scores[first[: live[t]] + t].astype(np.float64)
            local[t, : live[t]] = np.exp(e - e.max(1, keepdims=True))
        ahead = np.empty_like(local)
        ahead[0] = local[0]
        ahead[0] /= ahead[0].sum(1, keepdims=True)
        for t in range(1, longest):
            n = live[t]
            a = (ahead[t - 1, :n] @ move) * local[t, :n]
            ahead[t, :n] = a / a.sum(1, keepdims=True)
        back = np.ones((len(some), k))
        for t in range(longest - 1, -1, -1):
            n = live[t]
            p = ahead[t, :n] * back[:n]
            p /= p.sum(1, keepdims=True)
            out[first[:n] + t] = p
            if t:
                into = local[t, :n] * back[:n]
                if pairs is not None:
                    before = ahead[t - 1, :n]
                    pairs += move * ((before / ((before @ move) * into).sum(1, keepdims=True)).T @ into)
                b = into @ move.T
                back[:n] = b / b.sum(1, keepdims=True)
    return out


def long_sums(model: Model, words: list[str], most: int) -> np.ndarray:
    """Sums of the label probabilities of one long text, ``most`` words at a time.

    The sums from the left are kept at the ends of the pieces only; going back,
    each piece works out its own again.
    """
    move, k = np.exp(model.transitions.astype(np.float64)), len(model.labels)

    def local(lo: int) -> np.ndarray:
        e = model.scores(words[lo : lo + most]).astype(np.float64)
        return np.exp(e - e.max(1, keepdims=True))

    def ahead(own: np.ndarray, before: np.ndarray | None) -> np.ndarray:
        out = np.empty_like(own)
        for t in range(len(own)):
            a = own[t] if before is None else (before @ move) * own[t]
            out[t] = before = a / a.sum()
        return out

    starts = range(0, len(words), most)
    entries: list[np.ndarray | None] = [None]
    for lo in starts[:-1]:
        entries.append(ahead(local(lo), entries[-1])[-1])
    sums, back = np.zeros(k), np.ones(k)
    for lo, entry in zip(reversed(starts), reversed(entries)):
        own = local(lo)
        left = ahead(own, entry)
        for t in range(len(own) - 1, -1, -1):
            p = left[t] * back
            sums += p / p.sum()
            b = (own[t] * back) @ move.T
            back = b / b.sum()
    return sums


def label_sums(model: Model, each: list[list[str]]) -> np.ndarray:
    """Sums of the label probabilities over the words of each text; a step holds ``CELLS`` words times labels at most."""
    k = len(model.labels)
    most, sums = max(1, CELLS // k), np.zeros((len(each), k))
    lengths = np.array([len(w) for w in each], np.int64)
    some: list[int] = []

    def run() -> None:
        n = lengths[some]
        p = marginals(model.scores([w for i in some for w in each[i]]), n, model.transitions)
        sums[some] = np.add.reduceat(p, np.cumsum(n) - n, axis=0)
        some.clear()

    # texts of like length together: a step takes as many rounds as its longest text has words
    held, order = 0, np.argsort(-lengths, kind="stable")
    for i in order[lengths[order] > 0].tolist():
        if lengths[i] > most:
            sums[i] = long_sums(model, each[i], most)
            continue
        if held + lengths[i] > most:
            run()
            held = 0
        some.append(i)
        held += lengths[i]
    if some:
        run()
    return sums


def fit(texts: list[str], langs: list[str], passes: int = PASSES) -> Model:
    """Train on texts with their languages; every word of a text carries its language."""
    labels = sorted(set(langs))
    each = [stretch(words_of(t)) for t in texts]
    keep = [i for i, w in enumerate(each) if w]
    each, wanted = [each[i] for i in keep], np.array([labels.index(langs[i]) for i in keep], np.int64)
    lexicon = frozenset(w for w, n in Counter(w for ws in each for w in ws).items() if n >= LEXICON_COUNT)
    k = len(labels)
    model = Model(labels, np.zeros((SLOTS, k), np.float32), np.zeros(k, np.float32), np.zeros((k, k), np.float32), lexicon)
    if not each or k < 2:
        return model
    lengths = np.array([len(w) for w in each])
    vocabulary = {w: i for i, w in enumerate(dict.fromkeys(w for ws in each for w in ws))}
    word = np.array([vocabulary[w] for ws in each for w in ws])
    slots = [np.array(features(w, lexicon), np.int32) for w in vocabulary]
    sizes = np.array([len(s) for s in slots])
    flat, bounds = np.concatenate(slots).astype(np.int64), np.cumsum(sizes) - sizes
    of_word = np.repeat(np.arange(len(slots)), sizes)
    share = (8 / sizes)[:, None]
    truth = np.arange(len(word)), np.repeat(wanted, lengths)
    seen_pairs = np.zeros((k, k))
    np.add.at(seen_pairs, (wanted, wanted), np.maximum(lengths - 1, 0))
    moments = [(np.zeros_like(p, np.float64), np.zeros_like(p, np.float64)) for p in (model.weights, model.bias, model.transitions)]
    for n in range(1, passes + 1):
        own = np.stack([np.add.reduceat(model.weights[:, j][flat], bounds) for j in range(k)], axis=1) * share + model.bias
        pairs = np.zeros((k, k))
        wrong = marginals(own[word], lengths, model.transitions, pairs)
        wrong[truth] -= 1
        by_word = np.stack([np.bincount(word, wrong[:, j], len(slots)) for j in range(k)], axis=1)
        by_word *= share
        slope = np.stack([np.bincount(flat, by_word[of_word, j], SLOTS) for j in range(k)], axis=1) / len(word)
        slopes = (
            slope + DECAY * model.weights / SLOTS,
            wrong.sum(0) / len(word),
            (pairs - seen_pairs) / len(word) + DECAY * model.transitions,
        )
        for p, g, (m, v), rate in zip((model.weights, model.bias, model.transitions), slopes, moments, (0.1, 0.05, 0.05)):
            m += 0.1 * (g - m)
            v += 0.01 * (g * g - v)
            p -= (rate * (m / (1 - 0.9**n)) / (np.sqrt(v / (1 - 0.99**n)) + 1e-9)).astype(np.float32)
    return model


def shuffled(text: str) -> str:
    """The text with the letters of each word in another order, which depends on the word alone."""
    return LETTERS.sub(lambda m: "".join(random.Random(m.group()).sample(m.group(), len(m.group()))), text)


def noise_limit(model: Model, texts: list[str]) -> float:
    """The share of noise halfway between what nearly all texts (99 %) stay below and nearly all of them, shuffled, reach; at least one half.

    The texts are labelled ones that were not learned from.
    """
    at = model.labels.index(model.noise)

    def shares(some: list[str]) -> list[float]:
        each = [w for w in map(words_of, some) if w]
        return [float(m[at]) / len(w) for m, w in zip(label_sums(model, each), each)]

    read, noisy = shares(texts), shares([shuffled(t) for t in texts])
    return max(0.5, (np.quantile(read, 0.99) + np.quantile(noisy, 0.01)) / 2) if read else 0.5


def stretch(words: list[str]) -> list[str]:
    """The part of a long training text that is used, at a place that a checksum picks.

    In unspaced script, where words are long, it has fewer of them.
    """
    most = WORDS_PER_DOC
    letters = sum(map(len, words))
    if letters > LETTERS_PER_DOC:
        most = min(most, max(1, LETTERS_PER_DOC * len(words) // letters))
    spare = len(words) - most
    if spare <= 0:
        return words
    at = zlib.crc32(" ".join(words[:8]).encode()) % (spare + 1)
    return words[at : at + most]


def docs_for(labels: int, docs_per_label: int) -> int:
    """Training documents of each label: the sums of all words and labels stay within TRAINING_CELLS, but for LEAST_DOCS."""
    return max(min(docs_per_label, LEAST_DOCS), min(docs_per_label, TRAINING_CELLS // (WORDS_PER_DOC * labels**2)))


def training_rows(df: DataFrame, text: str = "text", lang: str = "lang", docs_per_label: int = DOCS_PER_LABEL) -> DataFrame | None:
    """(text, lang) of a bounded sample that has every label; None without labelled rows.

    For each label, different texts are picked by a hash of them, at most
    ``docs_per_label`` and of many labels fewer, but ``LEAST_DOCS`` where there
    are so many. Copies of a text count once. Rows without text or label are
    left out.
    """
    rows = df.select(df[f"`{text}`"].cast("string").alias("text"), df[f"`{lang}`"].cast("string").alias("lang")).where(
        "lang is not null and length(text) > 0"
    )
    # numbers of different texts, nearly
    sizes = settle(rows.groupBy("lang").agg(F.approx_count_distinct("text").alias("texts")))
    labels = sizes.count()
    if not labels:
        return None
    most = docs_for(labels, docs_per_label)
    fine = 1 << 30
    # so many in expectation that hardly a label has fewer than it may
    share = F.least(F.lit(1.0), (2 * most + 30) / F.greatest("texts", F.lit(1)))
    place = F.pmod(F.xxhash64("text"), F.lit(fine))
    near = left_lookup(rows, sizes, ["lang"]).where(place < share * fine).select("text", "lang").distinct()
    turn = Window.partitionBy("lang").orderBy(F.xxhash64("text"), "text")
    picked = near.withColumn("turn", F.row_number().over(turn)).where(F.col("turn") <= most).select("text", "lang")
    return picked.orderBy(F.xxhash64("text"), "lang", "text").limit(most * labels)


def train(
    df: DataFrame, text: str = "text", lang: str = "lang", docs_per_label: int = DOCS_PER_LABEL, noise: str | None = None
) -> Model:
    """Fit on a bounded sample of the labelled rows of a frame, in one task of the cluster.

    With ``noise``, a label of that name is learned besides, from the same texts
    with shuffled letters. A fifth of the sample is then kept from learning;
    ``noise_limit`` is the largest share of noise in it.
    """
    empty = Model([], np.zeros((1, 0), np.float32), np.zeros(0, np.float32), np.zeros((0, 0), np.float32), frozenset())
    picked = training_rows(df, text, lang, docs_per_label)
    if picked is None:
        return empty

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        texts, langs = [], []
        for batch in batches:
            texts += batch.column(0).to_pylist()
            langs += batch.column(1).to_pylist()
        if texts:
            limit = 1.0
            if noise is None:
                m = fit(texts, langs)
            else:
                kept = [zlib.crc32(t.encode()) % 5 == 0 for t in texts]
                learned = [i for i, k in enumerate(kept) if not k]
                m = fit([texts[i] for i in learned] + [shuffled(texts[i]) for i in learned], [langs[i] for i in learned] + [noise] * len(learned))
                m.noise = noise
                if noise in m.labels:
                    limit = noise_limit(m, [t for t, k in zip(texts, kept) if k])
            parts = [pa.array([a.tobytes()], pa.binary()) for a in (m.weights, m.bias, m.transitions)]
            listed = [pa.array([x], pa.list_(pa.string())) for x in (m.labels, sorted(m.lexicon))]
            parts.append(pa.array([limit], pa.float64()))
            yield pa.RecordBatch.from_arrays([*listed, *parts], names=["labels", "lexicon", "weights", "bias", "transitions", "noise_limit"])

    got = picked.coalesce(1).mapInArrow(
        run, "labels array<string>, lexicon array<string>, weights binary, bias binary, transitions binary, noise_limit double"
    ).first()
    if got is None:
        return empty
    k = len(got.labels)
    weights, bias, moves = (np.frombuffer(bytes(b), np.float32) for b in (got.weights, got.bias, got.transitions))
    return Model(list(got.labels), weights.reshape(-1, k), bias, moves.reshape(k, k), frozenset(got.lexicon), noise, got.noise_limit)


def identify(
    df: DataFrame, model: Model, text: str = "text", lang: str = "lang_pred", score: str = "score", keep: list[str] | None = None, noise: str | None = None
) -> DataFrame:
    """Add the language of every whole text and its mean probability over the text's words.

    ``und`` with score 0 for null texts, texts without a letter, and a model
    without labels. With ``noise``, a column of that name gets the mean
    probability of the model's noise label, which is never a text's language.
    Other columns stay (or those in ``keep``). Memory is bounded by words times
    labels of a step, however long a text is and however many labels there are.
    """
    sent = df.sparkSession.sparkContext.broadcast(model)

    def run(texts: list[str | None]) -> list[pa.Array]:
        own = sent.value
        each = [words_of(t) if own.labels else [] for t in texts]
        lengths = np.array([len(w) for w in each], np.int64)
        langs, sure, noisy = [UNKNOWN] * len(texts), np.zeros(len(texts)), np.zeros(len(texts))
        full = np.flatnonzero(lengths)
        if len(full):
            means = (label_sums(own, each)[full] / lengths[full, None]).round(6).clip(0, 1)
            if own.noise in own.labels:
                noisy[full] = means[:, own.labels.index(own.noise)]
                means[:, own.labels.index(own.noise)] = -1
            best = means.argmax(1)
            for i, b in zip(full.tolist(), best.tolist()):
                langs[i] = own.labels[b]
            sure[full] = means[np.arange(len(full)), best]
        out = [pa.array(langs, pa.string()), pa.array(sure, pa.float64())]
        return out if noise is None else [*out, pa.array(noisy, pa.float64())]

    added = [StructField(lang, StringType()), StructField(score, DoubleType())]
    return over_texts(df, text, run, added if noise is None else [*added, StructField(noise, DoubleType())], keep)


def has_letter(text: str) -> Column:
    """Whether a text has a letter; false for null."""
    return F.coalesce(F.regexp_like(F.col(f"`{text}`"), F.lit(r"\p{L}")), F.lit(False))


def label_words(df: DataFrame, model: Model, text: str = "text", words: str = "words", keep: list[str] | None = None) -> DataFrame:
    """Add (word, lang, probability) of every word, for texts that switch languages.

    A run of more than ``LONG_WORD`` letters is several words in a row.
    """
    kind = ArrayType(StructType([StructField("word", StringType()), StructField("lang", StringType()), StructField("probability", DoubleType())]))
    sent = df.sparkSession.sparkContext.broadcast(model)

    def run(texts: list[str | None]) -> list[pa.Array]:
        own = sent.value
        each = [words_of(t) if own.labels else [] for t in texts]
        lengths = np.array([len(w) for w in each], np.int64)
        flat = [w for ws in each for w in ws]
        p = marginals(own.scores(flat), lengths, own.transitions) if flat else np.zeros((0, 1))
        best = p.argmax(1)
        values = pa.StructArray.from_arrays(
            [pa.array(flat, pa.string()), pa.array([own.labels[b] for b in best], pa.string()), pa.array(p[np.arange(len(p)), best] if len(p) else [], pa.float64())],
            names=["word", "lang", "probability"],
        )
        return [pa.ListArray.from_arrays(pa.array(np.cumsum([0, *lengths]), pa.int32()), values)]

    return over_texts(df, text, run, [StructField(words, kind)], keep)


def fold(doc_id: str = "doc_id", folds: int = 5) -> Column:
    """Fold of a document by the checksum of its id; rows without id are in none."""
    return F.pmod(F.crc32(F.col(doc_id).cast("string").cast("binary")), F.lit(folds))
