"""Language-model scores: a log-bilinear model of word classes, trained by noise-contrastive estimation.

Frequent words are classes of their own, the end of a text is one, and rare
words share classes by their last bytes; inside a class, a word has its share
of the smoothed counts. A context of two classes gives a vector
``R[c1] A + R[c2] B``; its product with a class's vector, plus the class's
bias, is the class's score. Training tells real classes from noise classes
drawn by frequency, so it needs no normaliser; scoring uses the exact one. With
two words of context, ``exp(score)`` is a product of one factor per context
word, so one matrix product gives the normalisers of all contexts.

All training texts are counted and trained on. Tasks train apart from the same
start, each on its own texts, and their parameters are averaged by tokens,
once per round; each round reads its own part of the texts.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from plumbline.llm.frames import settle, spare_name
from plumbline.llm.words import LOWER, Sent, most_frequent, word_counts

#: classes of rare words, the class of the end, and classes in all
RARE, END, CLASSES = 64, 64, 2048
#: length of a class's vector, noise classes of a step, tokens of a step, tokens mixed before they are cut into steps
WIDTH, NOISE, STEP, MIXED = 16, 32, 1024, 1 << 17
#: rounds of training, and tokens that a training task has at least
ROUNDS, SHARD_TOKENS = 3, 1_000_000
RATE = 0.1
#: words whose counts go to every worker; those of the others come by a join
TABLE = 1 << 18
#: added to every count
SMOOTH = 0.1
#: rare words whose class a worker remembers
REMEMBERED = 1 << 17
#: texts that are cut into words at once
TEXTS = 200
#: parameters travel in pieces of so many numbers
PIECE = 4096


def rare_class(word: bytes) -> int:
    return zlib.crc32(word[-3:]) % RARE


@dataclass
class Shape:
    """Where each parameter lies in the flat vector; the sums of squared gradients follow, one for each row."""

    classes: int

    def parts(self) -> dict[str, tuple[int, ...]]:
        c, d = self.classes, WIDTH
        return {"R": (c, d), "A": (d, d), "B": (d, d), "Q": (c, d), "b": (c,), "gR": (c, 1), "gA": (d, 1), "gB": (d, 1), "gQ": (c, 1), "gb": (c,)}

    def views(self, flat: np.ndarray) -> dict[str, np.ndarray]:
        out, at = {}, 0
        for name, shape in self.parts().items():
            n = int(np.prod(shape))
            out[name] = flat[at : at + n].reshape(shape)
            at += n
        return out

    def size(self) -> int:
        return sum(int(np.prod(s)) for s in self.parts().values())


def first_parameters(chances: np.ndarray) -> np.ndarray:
    """A start that is the unigram model: class vectors are 0, biases the logarithms of the chances."""
    shape = Shape(len(chances))
    flat = np.zeros(shape.size(), np.float32)
    p = shape.views(flat)
    p["R"][:] = np.random.default_rng(1).normal(0, 0.3, p["R"].shape)
    p["A"][:], p["B"][:] = np.eye(WIDTH), 0.5 * np.eye(WIDTH)
    p["b"][:] = np.log(chances)
    return flat


def summed(rows: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Different rows, and the sum of the values of each."""
    order = np.argsort(rows, kind="stable")
    rows = rows[order]
    starts = np.flatnonzero(np.concatenate([[True], rows[1:] != rows[:-1]]))
    return rows[starts], np.add.reduceat(values.take(order, axis=0), starts, axis=0)


def step(p: dict[str, np.ndarray], one: np.ndarray, two: np.ndarray, target: np.ndarray, noise: np.ndarray, lift: np.ndarray) -> None:
    """One step of noise-contrastive estimation; the noise classes are shared by all tokens of the step.

    ``lift`` is the logarithm of how often each class is expected among them.
    """
    r1, r2 = p["R"].take(one, axis=0), p["R"].take(two, axis=0)
    h = r1 @ p["A"] + r2 @ p["B"]
    qt, qn = p["Q"].take(target, axis=0), p["Q"].take(noise, axis=0)
    real = np.einsum("ij,ij->i", h, qt) + p["b"][target] - lift[target]
    drawn = h @ qn.T + (p["b"][noise] - lift[noise])
    # chance that the model takes a real one for noise, and noise for a real one
    with np.errstate(over="ignore"):
        g_real, g_drawn = -1 / (1 + np.exp(real)), 1 / (1 + np.exp(-drawn))
    scale = np.float32(1 / len(target))
    g_real, g_drawn = (g_real * scale).astype(np.float32), (g_drawn * scale).astype(np.float32)
    d_h = g_real[:, None] * qt + g_drawn @ qn
    changes = [
        ("R", *summed(np.concatenate([one, two]), np.concatenate([d_h @ p["A"].T, d_h @ p["B"].T]))),
        ("Q", *summed(np.concatenate([target, noise]), np.concatenate([g_real[:, None] * h, g_drawn.T @ h]))),
        ("b", *summed(np.concatenate([target, noise]), np.concatenate([g_real, g_drawn.sum(0)]))),
        ("A", slice(None), r1.T @ d_h),
        ("B", slice(None), r2.T @ d_h),
    ]
    for name, rows, gradient in changes:
        square = p[f"g{name}"]
        square[rows] += gradient**2 if gradient.ndim == 1 else (gradient**2).mean(axis=1, keepdims=True)
        p[name][rows] -= RATE * gradient / np.sqrt(square[rows] + 1e-10)


def contexts(stream: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The class before each token and the one before that; before a text there are ends."""
    one, two = np.full(len(stream), END, np.int32), np.full(len(stream), END, np.int32)
    one[1:], two[2:] = stream[:-1], stream[:-2]
    two[starts] = END
    return one, two


class Classes(dict):
    """Classes of words: those of frequent ones, and a bounded memory of rare ones."""

    def __init__(self, frequent: list[bytes]):
        super().__init__(zip(frequent, range(END + 1, END + 1 + len(frequent))))
        self.frequent = dict(self)

    def __missing__(self, word: bytes) -> int:
        if len(self) > REMEMBERED:
            self.clear()
            self.update(self.frequent)
        self[word] = c = rare_class(word)
        return c

    def stream(self, texts: list[bytes | None]) -> tuple[np.ndarray, np.ndarray]:
        """Classes of all tokens of the texts, each with its end, and where the texts begin."""
        words = [(t or b"").translate(LOWER).split() for t in texts]
        ends = np.cumsum([len(w) + 1 for w in words])
        out = np.full(ends[-1] if len(ends) else 0, END, np.int32)
        inside = np.ones(len(out), bool)
        inside[ends - 1] = False
        out[inside] = np.fromiter(map(self.__getitem__, chain.from_iterable(words)), np.int32, int(inside.sum()))
        return out, np.concatenate([[0], ends[:-1]]).astype(np.int64)


@dataclass
class Model:
    """Counts of all training words (a settled frame word, n), the most frequent ones at hand, and the parameters."""

    counts: DataFrame
    words: list[bytes]
    numbers: np.ndarray
    train_tokens: int
    train_texts: int
    different: int
    rare_tokens: np.ndarray
    rare_words: np.ndarray
    flat: np.ndarray

    @property
    def frequent(self) -> int:
        return min(len(self.words), CLASSES - END - 1)

    def rare_space(self) -> np.ndarray:
        """What the smoothed count of a rare word is divided by, per class."""
        return self.rare_tokens + SMOOTH * (self.rare_words + 1)

    @property
    def parts(self) -> tuple:
        """What scoring needs besides the counts, for a broadcast of bounded size."""
        joined, ends = b"".join(self.words), np.cumsum([len(w) for w in self.words], dtype=np.int64)
        return joined, ends, self.numbers, self.frequent, self.train_texts, self.train_tokens, self.different, self.rare_space(), self.flat


def tables(flat: np.ndarray, classes: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Scores by the class before, by the one before that (rows: context), and the logarithm of each context's normaliser."""
    p = {k: v.astype(np.float64) for k, v in Shape(classes).views(flat).items()}
    near, far = (p["R"] @ p["A"] @ p["Q"].T + p["b"]).astype(np.float32), (p["R"] @ p["B"] @ p["Q"].T).astype(np.float32)
    top = far.max(axis=1)
    factors = np.exp((far - top[:, None]).astype(np.float64)).T
    whole = np.empty_like(near)
    for lo in range(0, classes, 256):
        some = near[lo : lo + 256].astype(np.float64)
        most = some.max(axis=1, keepdims=True)
        whole[lo : lo + 256] = np.log(np.exp(some - most) @ factors) + most + top
    return near, far, whole


def averaged(parts: DataFrame) -> np.ndarray:
    """Mean of the parameters of all tasks (piece, weight, numbers), weighted; each piece is summed as its rows come by."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, list] = {}
        for batch in batches:
            for piece, weight, numbers in zip(*(c.to_pylist() for c in batch.columns)):
                held = sums.setdefault(piece, [0.0, 0.0])
                held[0] += weight
                held[1] = held[1] + weight * np.frombuffer(numbers, np.float32).astype(np.float64)
        rows = [(k, w, (v / w).astype(np.float32).tobytes()) for k, (w, v) in sums.items()]
        yield pa.RecordBatch.from_arrays(
            [pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.float64()), pa.array([r[2] for r in rows], pa.binary())],
            names=["piece", "weight", "numbers"],
        )

    rows = parts.repartition("piece").mapInArrow(run, parts.schema).orderBy("piece").collect()
    return np.concatenate([np.frombuffer(r.numbers, np.float32) for r in rows]) if rows else np.zeros(0, np.float32)


def trained(docs: DataFrame, frequent: list[bytes], chances: np.ndarray, shards: int) -> np.ndarray:
    """Parameters after all rounds over the texts (text, binary)."""
    spark = docs.sparkSession
    flat = first_parameters(chances)
    shape, known = Shape(len(chances)), Sent(spark, frequent, Classes)
    spread = np.cumsum(chances / chances.sum())
    for part in range(ROUNDS):
        sent = Sent(spark, flat)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            own, classes, draw = sent.get().copy(), known.get(), np.random.default_rng(part)
            p, seen = shape.views(own), 0
            lift = np.log(NOISE * chances).astype(np.float32)
            held: list[tuple[np.ndarray, ...]] = []

            def learn() -> None:
                nonlocal seen
                one, two, target = (np.concatenate(c) for c in zip(*held))
                held.clear()
                order = draw.permutation(len(target))
                for lo in range(0, len(order), STEP):
                    some = order[lo : lo + STEP]
                    noise = np.minimum(np.searchsorted(spread, draw.random(NOISE)), len(spread) - 1)
                    step(p, one[some], two[some], target[some], noise, lift)
                seen += len(target)

            for batch in batches:
                for lo in range(0, batch.num_rows, TEXTS):
                    stream, starts = classes.stream(batch.slice(lo, TEXTS).column(0).to_pylist())
                    for a in range(0, len(stream), MIXED):
                        if a == 0:
                            one, two = contexts(stream, starts)
                        held.append((one[a : a + MIXED], two[a : a + MIXED], stream[a : a + MIXED]))
                        if sum(len(h[2]) for h in held) >= MIXED:
                            learn()
            if held:
                learn()
            if seen:
                pieces = [own[lo : lo + PIECE].tobytes() for lo in range(0, len(own), PIECE)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(range(len(pieces)), pa.int32()), pa.array([float(seen)] * len(pieces)), pa.array(pieces, pa.binary())],
                    names=["piece", "weight", "numbers"],
                )

        texts = docs.where(F.pmod(F.xxhash64("text"), F.lit(ROUNDS)) == part).coalesce(shards)
        new = averaged(texts.mapInArrow(run, "piece int, weight double, numbers binary"))
        flat = new if len(new) else flat
    return flat


def train(df: DataFrame, text: str = "text") -> Model:
    """A model of all texts of a frame; null texts count as empty, and an empty frame gives a model that knows nothing."""
    spark = df.sparkSession
    docs = df.select(F.coalesce(F.col(f"`{text}`").cast("string"), F.lit("")).cast("binary").alias("text"))
    counts = settle(word_counts(df, text, F.lit(None)).select("word", "n"))
    texts = docs.count()
    top = most_frequent(counts, "n", TABLE).select(F.col("word").cast("binary"), "n").toArrow().sort_by([("n", "descending"), ("word", "ascending")])
    words, numbers = top["word"].to_pylist(), top["n"].to_numpy().astype(np.int64)
    frequent = words[: CLASSES - END - 1]
    of_their_own = set(frequent)

    def rare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens, different = np.zeros(RARE, np.int64), np.zeros(RARE, np.int64)
        for batch in batches:
            for word, n in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if word not in of_their_own:
                    tokens[rare_class(word)] += n
                    different[rare_class(word)] += 1
        yield pa.RecordBatch.from_arrays([pa.array(range(RARE), pa.int32()), pa.array(tokens), pa.array(different)], names=["c", "tokens", "words"])

    sums = counts.select(F.col("word").cast("binary"), "n").mapInArrow(rare, "c int, tokens long, words long")
    rare_tokens, rare_words = np.zeros(RARE, np.int64), np.zeros(RARE, np.int64)
    for r in sums.groupBy("c").agg(F.sum("tokens").alias("tokens"), F.sum("words").alias("words")).collect():
        rare_tokens[r.c], rare_words[r.c] = r.tokens, r.words
    total = int(numbers[: len(frequent)].sum() + rare_tokens.sum()) + texts
    different = len(frequent) + int(rare_words.sum()) + (texts > 0)
    seen = np.concatenate([rare_tokens, [texts], numbers[: len(frequent)]]) + 1.0
    flat = trained(docs, frequent, seen / seen.sum(), max(1, total // (ROUNDS * SHARD_TOKENS)))
    return Model(counts, words, numbers, total, texts, different, rare_tokens, rare_words, flat)


class Scorer:
    """What a worker needs to score texts, from the model's arrays."""

    def __init__(self, parts: tuple):
        joined, ends, numbers, frequent, texts, total, different, space, flat = parts
        ends = ends.tolist()
        self.index = {joined[a:b]: i for i, (a, b) in enumerate(zip([0, *ends[:-1]], ends))}
        self.classes = np.fromiter(map(rare_class, self.index), np.int32, len(ends))
        self.classes[:frequent] = np.arange(END + 1, END + 1 + frequent)
        self.base = np.log10(numbers + SMOOTH) - np.log10(total + SMOOTH * (different + 1))
        self.none = np.log10(total + SMOOTH * (different + 1))
        self.end, self.end_known = np.log10(texts + SMOOTH) - self.none, int(texts > 0)
        self.space = np.log10(space)
        self.within = np.zeros(len(ends))
        self.within[frequent:] = np.log10(numbers[frequent:] + SMOOTH) - self.space[self.classes[frequent:]]
        self.near, self.far, self.whole = tables(flat, END + 1 + frequent)

    def score(self, texts: list[bytes | None]) -> tuple:
        """(n_tokens, n_known, base, score) of each text without the words beyond the table, and those words with numbers and classes."""
        words = [(t or b"").translate(LOWER).split() for t in texts]
        n = np.array([len(w) + 1 for w in words], np.int64)
        ends = np.cumsum(n)
        inside = np.ones(int(ends[-1]) if len(ends) else 0, bool)
        inside[ends - 1] = False
        at = np.full(len(inside), -2, np.int64)
        at[inside] = np.fromiter(map(self.index.get, chain.from_iterable(words), repeat(-1)), np.int64, int(inside.sum()))
        known = at >= 0
        stream, base, within = np.full(len(at), END, np.int32), np.full(len(at), self.end), np.zeros(len(at))
        stream[known], base[known], within[known] = self.classes[at[known]], self.base[at[known]], self.within[at[known]]
        base[at == -1] = 0.0
        beyond: list[Counter] = [Counter() for _ in texts]
        starts = ends - n
        missing = np.flatnonzero(at == -1)
        of = np.searchsorted(ends, missing, side="right")
        for i, k, t in zip(missing.tolist(), (missing - starts[of]).tolist(), of.tolist()):
            word = words[t][k]
            stream[i] = rare_class(word)
            beyond[t][word] += 1
        one, two = contexts(stream, starts)
        logs = (self.near[one, stream] + self.far[two, stream]).astype(np.float64) - self.whole[one, two]
        logs = logs / np.log(10) + within
        known_or_end = known.astype(np.int64)
        known_or_end[ends - 1] = self.end_known
        return n, np.add.reduceat(known_or_end, starts), np.add.reduceat(base, starts), np.add.reduceat(logs, starts), beyond


def score(df: DataFrame, model: Model, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """Add ``n_tokens``, ``n_known``, ``train_tokens``, ``base_score`` and ``score`` to every text.

    Tokens are the words between blanks, A-Z as a-z, then one end; a null text
    has the end alone. ``base_score`` sums the logarithms (base 10) of smoothed
    counts, ``score`` is the model's for the whole text. Equal texts get equal
    scores; columns of the frame with the names of the new ones are replaced.
    """
    added = ["n_tokens", "n_known", "train_tokens", "base_score", "score"]
    kept = [c for c in (df.columns if keep is None else keep) if c.lower() not in added]
    row = spare_name(df, "row")
    sent = Sent(df.sparkSession, model.parts, Scorer)
    frame = df.select(
        *[F.col(f"`{c}`") for c in kept], F.monotonically_increasing_id().alias(row), F.col(f"`{text}`").cast("string").cast("binary").alias(f"{row}_text")
    )
    beyond = "array<struct<word: string, n: long, space: double>>"
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in frame.schema.fields[:-1])
    schema += f", n_tokens long, n_known long, base_score double, score double, {row}_words {beyond}"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = sent.get()
        for batch in batches:
            for lo in range(0, batch.num_rows, TEXTS):
                piece = batch.slice(lo, TEXTS)
                n, known, base, logs, words = own.score(piece.column(piece.num_columns - 1).to_pylist())
                offsets = pa.array(np.concatenate([[0], np.cumsum([len(w) for w in words])]), pa.int32())
                flat = [w for c in words for w in c]
                values = pa.StructArray.from_arrays(
                    [
                        pa.array(flat, pa.binary()).cast(pa.string()),
                        pa.array([k for c in words for k in c.values()], pa.int64()),
                        pa.array(own.space[[rare_class(w) for w in flat]] if flat else [], pa.float64()),
                    ],
                    names=["word", "n", "space"],
                )
                lists = pa.ListArray.from_arrays(offsets, values)
                yield pa.RecordBatch.from_arrays(
                    [*piece.columns[:-1], pa.array(n), pa.array(known), pa.array(base), pa.array(logs), lists],
                    names=[*kept, row, "n_tokens", "n_known", "base_score", "score", f"{row}_words"],
                )

    first = settle(frame.mapInArrow(run, schema))
    none = float(np.log10(model.train_tokens + SMOOTH * (model.different + 1)))
    words = first.select(F.col(f"`{row}`").alias("row"), F.inline(f"{row}_words"))
    # words beyond the table are less frequent than its last one
    most = int(model.numbers[-1]) if len(model.words) else 1 << 62
    others = model.counts.where(F.col("n") < most).select("word", F.col("n").alias("c"))
    c = F.coalesce(F.col("c"), F.lit(0))
    log = F.log10(c + SMOOTH)
    rest = (
        words.join(others, "word", "left")
        .groupBy("row")
        .agg(
            F.sum(F.when(c > 0, F.col("n")).otherwise(0)).alias("known"),
            F.sum(F.col("n") * (log - none)).alias("base"),
            F.sum(F.col("n") * (log - F.col("space"))).alias("rest"),
        )
        .select(F.col("row").alias(row), F.struct("known", "base", "rest").alias(f"{row}_rest"))
    )
    out = first.drop(f"{row}_words").join(rest, row, "left")
    more = F.col(f"{row}_rest")
    return out.select(
        *[F.col(f"`{x}`") for x in kept],
        "n_tokens",
        (F.col("n_known") + F.coalesce(more["known"], F.lit(0))).alias("n_known"),
        F.lit(model.train_tokens).cast("long").alias("train_tokens"),
        (F.col("base_score") + F.coalesce(more["base"], F.lit(0.0))).alias("base_score"),
        (F.col("score") + F.coalesce(more["rest"], F.lit(0.0))).alias("score"),
    )
