"""Phrase collocations: frequent phrases by double-array tries, scored by their weakest cut.

Words frequent enough to be in a phrase get codes, and the texts are written
once as codes. Level by level, a phrase of k words is a candidate if its first
and its last k - 1 words are frequent (Apriori) and if some shard of the text
holds more than its share of it (a phrase with enough occurrences must, by the
pigeonhole principle). What a shard passes on travels packed, a block of phrases
to a row, and is summed part by part. A double-array trie of the candidates is
sent to the workers; numpy moves the states of text positions along it, a window
of the text at a time, level by level, and counts the accepting states; the
counts of all shards are summed.

What is sent is bounded: a dictionary of at most ``DICTIONARY`` words and tries
of at most ``TRIE`` phrases. More candidates take more tries, one after the
other; phrases with a word beyond the dictionary are counted by a shuffle of
their occurrences. Both are exact.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from plumbline.llm.frames import settle
from plumbline.llm.words import Sent, byte_table, most_frequent, word_counts

#: what parts pieces; no phrase goes beyond
PIECE_ENDS = b".,;:!?\n\x0b\x0c\r"
#: words with a code (the most frequent ones), and phrases of one trie
DICTIONARY, TRIE = 1 << 19, 1 << 17
#: codes of one shard, texts that are cut at once, and counts that travel together
SHARD, TEXTS, PIECE = 1 << 22, 200, 4096
#: codes of one row, codes that move along a trie at once, and codes of the text for each part of the phrases passed on
ROW, WINDOW, PART = 128, 1 << 18, 1 << 20
#: odd factor that spreads packed phrases evenly over the parts
SPREAD = np.uint64(0x9E3779B97F4A7C15)
#: language of texts without one
NO_LANGUAGE = "und"
#: a byte that no UTF-8 text holds stands for the end of a piece
END = b"\xff"
CUT, WORDS = byte_table({PIECE_ENDS: b"\n"}), byte_table({PIECE_ENDS: b" "})
#: a later word of a phrase is three symbols of seven bits in the trie; the first is one symbol
SYMBOLS = (14, 7, 0)


@dataclass
class Trie:
    """Double array: state ``t = base[s] + symbol`` follows s if ``check[t] == s``; ``accept`` numbers the phrases."""

    base: np.ndarray
    check: np.ndarray
    accept: np.ndarray
    depth: int

    def find(self, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(position, phrase) wherever a phrase of the trie begins; all positions move on together."""
        at = np.flatnonzero(codes[: max(0, len(codes) - self.depth + 1)])
        state = codes[at].astype(np.int64)
        good = state < len(self.check)
        at, state = at[good], state[good]
        good = self.check[state] == 0
        at, state = at[good], state[good]
        for word in range(1, self.depth):
            code = codes[at + word]
            for shift in SYMBOLS:
                follow = self.base[state] + ((code >> shift) & 127)
                good = self.check[follow] == state
                at, state, code = at[good], follow[good], code[good]
        found = self.accept[state]
        good = found >= 0
        return at[good], found[good]


def build_trie(phrases: np.ndarray) -> Trie:
    """Trie of different phrases, given as rows of codes in lexicographic order.

    Codes begin at 1. The root's followers lie at their codes. Other states are
    placed level by level: those with many followers first, at the first base
    where all fit, those with a single one wherever a place is free.
    """
    n, depth = phrases.shape
    symbols = [phrases[:, 0]] + [(phrases[:, w] >> shift) & 127 for w in range(1, depth) for shift in SYMBOLS]
    low = max(int(phrases[:, 0].max(initial=0)), 127) + 1
    size = low + 2 * n * len(symbols) + 1024
    base, check, used = np.zeros(size, np.int64), np.full(size, -1, np.int64), np.zeros(size, bool)
    slot = phrases[:, 0].astype(np.int64)
    check[slot] = 0
    new = np.ones(n, bool)
    new[1:] = symbols[0][1:] != symbols[0][:-1]
    window = 4096

    def grow(need: int) -> None:
        nonlocal base, check, used
        if need > len(base):
            more = max(need, 2 * len(base)) - len(base)
            base, check = np.concatenate([base, np.zeros(more, np.int64)]), np.concatenate([check, np.full(more, -1, np.int64)])
            used = np.concatenate([used, np.zeros(more, bool)])

    floor = low
    for symbol in symbols[1:]:
        parent_first = np.flatnonzero(new)
        parent = np.cumsum(new) - 1
        new = new.copy()
        new[1:] |= symbol[1:] != symbol[:-1]
        child = np.flatnonzero(new)
        of, sign = parent[child], symbol[child].astype(np.int64)
        starts = np.searchsorted(of, np.arange(len(parent_first) + 1))
        numbers = np.diff(starts)
        bases = np.zeros(len(parent_first), np.int64)
        point = floor
        for p in np.argsort(-numbers, kind="stable"):
            if numbers[p] < 2:
                break
            signs = sign[starts[p] : starts[p + 1]]
            while True:
                grow(point + window + 256)
                clash = used[point + signs[0] : point + signs[0] + window].copy()
                for c in signs[1:]:
                    clash |= used[point + c : point + c + window]
                fit = int(np.argmin(clash))
                if not clash[fit]:
                    break
                point += window // 2
            bases[p] = point + fit
            used[bases[p] + signs] = True
        single = np.flatnonzero(numbers == 1)
        if len(single):
            free = floor + np.flatnonzero(~used[floor:])
            if len(free) < len(single):
                grow(len(used) + len(single) + 256)
                free = floor + np.flatnonzero(~used[floor:])
            places = free[: len(single)]
            used[places] = True
            bases[single] = places - sign[starts[single]]
        follow = bases[of] + sign
        grow(int(follow.max()) + 256)
        parents = slot[parent_first]
        base[parents] = bases
        check[follow] = parents[of]
        slot = follow[np.cumsum(new) - 1]
        busy = used[floor:]
        floor += int(np.argmin(busy)) if not busy.all() else len(busy)
    accept = np.full(len(base), -1, np.int32)
    accept[slot] = np.arange(n)
    end = int(max(slot.max(initial=0), base.max())) + 129
    grow(end)
    return Trie(base[:end].astype(np.int32), check[:end].astype(np.int32), np.concatenate([accept, np.full(max(0, end - len(accept)), -1, np.int32)])[:end], depth)


def as_keys(phrases: np.ndarray) -> pa.Array:
    """Rows of codes as binary values of equal length."""
    n, depth = phrases.shape
    data = np.ascontiguousarray(phrases, dtype=">i4")
    return pa.FixedSizeBinaryArray.from_buffers(pa.binary(4 * depth), n, [None, pa.py_buffer(data)]).cast(pa.binary())


def from_keys(keys: pa.ChunkedArray | pa.Array, depth: int) -> np.ndarray:
    return np.frombuffer(b"".join(keys.to_pylist()), dtype=">i4").astype(np.int32).reshape(-1, depth)


def tries(phrases: DataFrame, depth: int) -> Iterator[tuple[np.ndarray, Trie]]:
    """Tries of all phrases of a settled frame (key), none with many more than ``TRIE``."""
    parts = -(-phrases.count() // TRIE)
    for k in range(parts):
        some = phrases.where(F.pmod(F.xxhash64("key"), F.lit(parts)) == k) if parts > 1 else phrases
        rows = from_keys(some.select("key").toArrow()["key"], depth)
        if len(rows):
            rows = rows[np.lexsort(rows.T[::-1])]
            yield rows, build_trie(rows)


class Coder:
    """Codes of the words of texts of a language."""

    def __init__(self, words: list[tuple[str, str]]):
        self.of: dict[str, dict[bytes, int]] = {}
        for code, (lang, word) in enumerate(words, 1):
            self.of.setdefault(lang, {})[word.encode()] = code

    def codes(self, lang: str, texts: list[bytes]) -> np.ndarray:
        """Codes of all words in turn; 0 stands for ends of pieces and texts and words without a code."""
        known = self.of.get(lang)
        if not known:
            return np.zeros(0, np.int32)
        ends = b" " + END + b" "
        words = ends.join(texts).translate(CUT).replace(b"\n", ends).split()
        codes = np.fromiter(map(known.get, words, repeat(0)), np.int32, len(words))
        codes = np.concatenate([np.zeros(1, np.int32), codes, np.zeros(1, np.int32)])
        # words without a coded neighbour are in no phrase; one 0 is as good as several
        codes[1:-1][(codes[:-2] == 0) & (codes[2:] == 0)] = 0
        keep = codes > 0
        keep[1:] |= codes[:-1] > 0
        return codes[keep]


def row_offsets(codes: np.ndarray, size: int) -> np.ndarray:
    """Where codes that end with a 0 are cut into rows of about ``size``; every row ends with a 0, so no phrase is cut."""
    ends = np.flatnonzero(codes == 0) + 1
    cuts = ends[np.searchsorted(ends, np.arange(size, len(codes), size))]
    return np.unique(np.concatenate([[0], cuts, [len(codes)]]))


def encoded(docs: DataFrame, words: Sent) -> DataFrame:
    """(codes): the texts (lang, text) as codes of four bytes, rows of about ``ROW`` that end with a 0; settled."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = words.get()
        for batch in batches:
            for lo in range(0, batch.num_rows, TEXTS):
                piece = batch.slice(lo, TEXTS)
                by_lang: dict[str, list[bytes]] = {}
                for lang, text in zip(piece.column(0).to_pylist(), piece.column(1).to_pylist()):
                    if text:
                        by_lang.setdefault(lang, []).append(text)
                rows = [c for c in (coder.codes(lang, texts) for lang, texts in by_lang.items()) if len(c)]
                if rows:
                    codes = np.concatenate(rows)
                    offsets = row_offsets(codes, ROW)
                    values = pa.BinaryArray.from_buffers(pa.binary(), len(offsets) - 1, [None, pa.py_buffer((4 * offsets).astype(np.int32)), pa.py_buffer(codes)])
                    yield pa.RecordBatch.from_arrays([values], names=["codes"])

    return settle(docs.select("lang", F.col("text").cast("binary")).mapInArrow(run, "codes binary"))


def windows(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[np.ndarray]:
    """The codes of a task, about ``most`` at a time; each window ends with a 0."""
    held, size = [], 0
    for batch in batches:
        for value in batch.column(0):
            held.append(np.frombuffer(value.as_buffer(), np.int32))
            size += len(held[-1])
            if size >= most:
                yield np.concatenate(held)
                held, size = [], 0
    if held:
        yield np.concatenate(held)


def blocks(packed: np.ndarray, n: np.ndarray, parts: int) -> Iterator[pa.RecordBatch]:
    """(part, keys, numbers): phrases as numbers of 64 bits and their counts, a row for each part; equal ones share a part."""
    part = ((packed.astype(np.uint64) * SPREAD >> np.uint64(32)) % np.uint64(parts)).astype(np.int32)
    order = np.argsort(part, kind="stable")
    part, packed, n = part[order], packed[order], n[order].astype(np.int32)
    first = np.flatnonzero(np.append(True, part[1:] != part[:-1])) if len(part) else np.zeros(0, np.int64)
    ends = np.append(first[1:], len(part))
    for lo in range(0, len(first), 64):
        spans = list(zip(first[lo : lo + 64].tolist(), ends[lo : lo + 64].tolist()))
        yield pa.RecordBatch.from_arrays(
            [pa.array(part[first[lo : lo + 64]]), pa.array([packed[a:b].tobytes() for a, b in spans], pa.binary()), pa.array([n[a:b].tobytes() for a, b in spans], pa.binary())],
            names=["part", "keys", "numbers"],
        )


def summed(batches: Iterator[pa.RecordBatch], least: int) -> Iterator[np.ndarray]:
    """The phrases of blocks, sorted by part, whose counts sum to ``least``; one part at a time is in memory."""
    part, keys, numbers = None, [], []

    def close() -> np.ndarray:
        packed, n = np.concatenate(keys), np.concatenate(numbers)
        order = np.argsort(packed, kind="stable")
        packed, n = packed[order], n[order].astype(np.int64)
        first = np.flatnonzero(np.append(True, packed[1:] != packed[:-1]))
        return packed[first[np.add.reduceat(n, first) >= least]]

    for batch in batches:
        for i, now in enumerate(batch.column(0).to_pylist()):
            if now != part and keys:
                yield close()
                keys, numbers = [], []
            part = now
            keys.append(np.frombuffer(batch.column(1)[i].as_buffer(), np.int64))
            numbers.append(np.frombuffer(batch.column(2)[i].as_buffer(), np.int32))
    if keys:
        yield close()


def candidates(texts: DataFrame, depth: int, langs: Sent, size: int, least: int, before: DataFrame | None) -> DataFrame:
    """(key): the phrases of ``depth`` words that may have ``least`` occurrences; settled.

    ``langs`` holds the language of each code and the codes of each language in
    the whole text, which has ``size`` codes. A shard keeps back, of each phrase,
    what its share of two thirds of ``least`` is; all shards together keep back
    less than ``least``, so a phrase whose passed-on counts sum to the rest is a
    candidate, and no other can be frequent. ``before`` has the frequent
    phrases of one word less.

    A shard passes on blocks, one for each part of the phrases. There are as
    many parts as keep one within ``PART`` phrases, whatever the text's size.
    """
    spark = texts.sparkSession
    hold, most, parts = 2 * (least - 1) // 3, SHARD, max(1, -(-size // PART))
    step = min(WINDOW, most)

    def job(sent: Sent | None, both: bool) -> DataFrame:
        def pack(codes: np.ndarray, trie: Trie | None) -> np.ndarray:
            if trie is None:
                at = np.flatnonzero((codes[:-1] > 0) & (codes[1:] > 0))
                first = codes[at].astype(np.int64)
            else:
                at, number = trie.find(codes)
                mark = np.zeros(len(codes) + 1, bool)
                mark[at] = True
                good = codes[np.minimum(at + depth - 1, len(codes) - 1)] > 0
                if both:
                    good &= mark[at + 1]
                at, first = at[good], number[good].astype(np.int64)
            first <<= 21
            first |= codes[at + depth - 1]
            return first

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            of, whole = langs.get()
            phrases, trie = sent.get() if sent else (None, None)
            owner = of if trie is None else of[phrases[:, 0]]
            held, seen = [], np.zeros(len(whole), np.int64)

            def shard() -> Iterator[pa.RecordBatch]:
                packed = np.concatenate(held)
                held.clear()
                packed.sort()
                ends = np.flatnonzero(np.append(packed[1:] != packed[:-1], True)) if len(packed) else np.zeros(0, np.int64)
                packed, n = packed[ends], np.diff(ends, prepend=-1)
                extra = n - np.floor(hold * (seen / np.maximum(whole, 1))).astype(np.int64)[owner[packed >> 21]]
                seen[:] = 0
                yield from blocks(packed[extra > 0], extra[extra > 0], parts)

            have = 0
            for codes in windows(batches, step):
                held.append(pack(codes, trie))
                seen += np.bincount(of[codes], minlength=len(whole))
                have += len(codes)
                if have >= most:
                    yield from shard()
                    have = 0
            if held:
                yield from shard()

        def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for packed in summed(batches, least - hold):
                first, last = packed >> 21, (packed & ((1 << 21) - 1)).astype(np.int32)
                rows = np.column_stack([first.astype(np.int32) if sent is None else sent.get()[0][first], last])
                for lo in range(0, len(rows), 100_000):
                    yield pa.RecordBatch.from_arrays([as_keys(rows[lo : lo + 100_000])], names=["key"])

        passed = texts.mapInArrow(run, "part int, keys binary, numbers binary")
        return passed.repartition("part").sortWithinPartitions("part").mapInArrow(add, "key binary")

    if before is None:
        return settle(job(None, False))
    several = list(tries(before, depth - 1)) if before.count() <= TRIE else None
    if several is not None:
        jobs = [job(Sent(spark, pair), True) for pair in several]
    else:
        jobs = [settle(job(Sent(spark, pair), False)) for pair in tries(before, depth - 1)]
    out = jobs[0]
    for other in jobs[1:]:
        out = out.unionByName(other)
    return settle(out)


def counted(texts: DataFrame, phrases: DataFrame, depth: int, least: int) -> DataFrame:
    """(key, f): occurrences of the candidates, for those with at least ``least``; settled."""
    spark, step = texts.sparkSession, WINDOW

    def job(sent: Sent) -> DataFrame:
        def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            rows, trie = sent.get()
            n = np.zeros(len(rows), np.int64)
            for codes in windows(batches, step):
                n += np.bincount(trie.find(codes)[1], minlength=len(rows))
            full = [lo for lo in range(0, len(n), PIECE) if n[lo : lo + PIECE].any()]
            pieces = [n[lo : lo + PIECE].tobytes() for lo in full]
            yield pa.RecordBatch.from_arrays([pa.array(full, pa.int32()), pa.array(pieces, pa.binary())], names=["first", "numbers"])

        def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            rows, sums = sent.get()[0], {}
            for batch in batches:
                for first, numbers in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                    sums[first] = sums.get(first, 0) + np.frombuffer(numbers, np.int64)
            for first, n in sums.items():
                some = np.flatnonzero(n >= least)
                yield pa.RecordBatch.from_arrays([as_keys(rows[first + some]), pa.array(n[some])], names=["key", "f"])

        # the counts of a task travel in pieces, and each piece is summed as its rows come by
        counts = texts.mapInArrow(count, "first int, numbers binary")
        return counts.repartition("first").mapInArrow(add, "key binary, f long")

    out = None
    for pair in tries(phrases, depth):
        some = settle(job(Sent(spark, pair)))
        out = some if out is None else out.unionByName(some)
    return out if out is not None else phrases.withColumn("f", F.lit(0).cast("long"))


def beyond(docs: DataFrame, words: Sent, longest: int, least: int) -> DataFrame:
    """(lang, phrase, f): frequent phrases with a word that has no code, counted by a shuffle of their occurrences."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder, seen = words.get(), Counter()

        def out() -> Iterator[pa.RecordBatch]:
            items = list(seen.items())
            seen.clear()
            for lo in range(0, len(items), 50_000):
                part = items[lo : lo + 50_000]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([k[0] for k, _ in part], pa.string()), pa.array([k[1] for k, _ in part], pa.binary()).cast(pa.string()), pa.array([n for _, n in part], pa.int64())],
                    names=["lang", "phrase", "n"],
                )

        for batch in batches:
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                known = coder.of.get(lang, {})
                for piece in (text or b"").translate(CUT).split(b"\n"):
                    w = piece.split()
                    new = [i for i, x in enumerate(w) if x not in known]
                    spans = {(a, a + k) for i in new for k in range(2, longest + 1) for a in range(max(0, i - k + 1), min(i, len(w) - k) + 1)}
                    seen.update((lang, b" ".join(w[a:b])) for a, b in spans)
                    if len(seen) > 200_000:
                        yield from out()
        yield from out()

    rows = docs.select("lang", F.col("text").cast("binary")).mapInArrow(run, "lang string, phrase string, n long")
    return rows.groupBy("lang", "phrase").agg(F.sum("n").alias("f")).where(F.col("f") >= least)


def frequent_phrases(df: DataFrame, text: str = "text", lang: str = "lang", least: int = 100, longest: int = 5) -> tuple[DataFrame, DataFrame]:
    """(lang, phrase, f) of all phrases of 1 to ``longest`` words with ``least`` occurrences, and (lang, n); both settled.

    A-Z count as a-z; a null text has no words; texts without a language are
    those of ``und``. Occurrences may overlap, and none goes beyond a piece.
    """
    spark = df.sparkSession
    docs = df.select(F.coalesce(F.col(f"`{lang}`").cast("string"), F.lit(NO_LANGUAGE)).alias("lang"), F.col(f"`{text}`").cast("string").alias("text"))
    counts = settle(word_counts(docs, "text", F.col("lang"), WORDS))
    totals = settle(counts.groupBy(F.col("grp").alias("lang")).agg(F.sum("n").alias("n")))
    one = settle(counts.where(F.col("n") >= least).select(F.col("grp").alias("lang"), F.col("word").alias("phrase"), F.col("n").alias("f")))
    top = most_frequent(one, "f", DICTIONARY).toArrow().sort_by([("f", "descending"), ("lang", "ascending"), ("phrase", "ascending")])
    words = list(zip(top["lang"].to_pylist(), top["phrase"].to_pylist()))
    if one.isEmpty():
        return one, totals
    names = sorted({name for name, _ in words})
    number = {name: i for i, name in enumerate(names, 1)}
    of = np.array([0] + [number[name] for name, _ in words], np.int32)
    whole = np.bincount(of, np.concatenate([[0], top["f"].to_numpy()]), len(names) + 1)
    coder, langs = Sent(spark, words, Coder), Sent(spark, (of, whole))
    texts = encoded(docs, coder)
    found = [one]

    def named(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        listed = coder.sent.value
        for batch in batches:
            keys = [np.frombuffer(k, ">i4") for k in batch.column(0).to_pylist()]
            phrases = [" ".join([listed[c - 1][1] for c in k.tolist()]) for k in keys]
            yield pa.RecordBatch.from_arrays(
                [pa.array([listed[k[0] - 1][0] for k in keys], pa.string()), pa.array(phrases, pa.string()), batch.column(1)], names=["lang", "phrase", "f"]
            )

    before = None
    for depth in range(2, longest + 1 if words else 2):
        before = counted(texts, candidates(texts, depth, langs, int(whole.sum()), least, before), depth, least)
        if before.isEmpty():
            break
        found.append(before.mapInArrow(named, "lang string, phrase string, f long"))
    if one.count() > len(words):
        found.append(beyond(docs, coder, longest, least))
    out = found[0]
    for other in found[1:]:
        out = out.unionByName(other)
    return settle(out), totals


def cut_score(a: Column, n: Column, left: Column, right: Column) -> Column:
    """floor(1000 * a * n / (left * right)), exact beyond 64 bits: the products are decimals of 38 digits."""
    wide = [c.cast("decimal(38,0)") for c in (a, n, left, right)]
    return F.call_function("div", wide[0] * wide[1] * F.lit(1000).cast("decimal(38,0)"), wide[2] * wide[3])


def collocations(
    df: DataFrame, text: str = "text", lang: str = "lang", least: int = 100, longest: int = 5, top: int = 2000, cover: int = 100
) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): the first ``top`` phrases of each language.

    ``a`` are the occurrences of the phrase, ``n`` all words of the language. Of
    the cuts of a phrase in two, the one with the lowest score counts, then the
    one after fewer words; ``l`` and ``r`` are the occurrences of its parts.
    Phrases inside a longer frequent one that has at least ``cover`` percent of
    their occurrences are left out. Order: score and occurrences, falling, then
    the phrase by its bytes. Without frequent phrases, as in an empty table,
    there are no rows. Other columns take no part.
    """
    phrases, totals = frequent_phrases(df, text, lang, least, longest)
    words = F.split("phrase", " ")
    long = phrases.withColumn("w", words).where(F.size("w") > 1)
    spans = F.flatten(
        F.transform(F.sequence(F.lit(2), F.greatest(F.size("w") - 1, F.lit(2))), lambda k: F.transform(
            F.sequence(F.lit(1), F.greatest(F.size("w") - k + 1, F.lit(1))), lambda i: F.array_join(F.slice("w", i, k), " ")))
    )
    inside = long.where(F.size("w") > 2).select("lang", F.explode(spans).alias("phrase"), F.col("f").alias("longer"))
    covering = inside.groupBy("lang", "phrase").agg(F.max("longer").alias("longer"))
    kept = long.join(covering, ["lang", "phrase"], "left").where(~F.coalesce(100 * F.col("longer") >= cover * F.col("f"), F.lit(False)))
    cuts = kept.select("lang", "phrase", F.col("f").alias("a"), "w", F.explode(F.sequence(F.lit(1), F.size("w") - 1)).alias("k")).select(
        "lang", "phrase", "a", "k",
        F.array_join(F.slice("w", 1, F.col("k")), " ").alias("first"),
        F.array_join(F.slice("w", F.col("k") + 1, F.size("w")), " ").alias("rest"),
    )
    part = phrases.select("lang", F.col("phrase").alias("part"), "f")
    cuts = (
        cuts.join(part.select("lang", F.col("part").alias("first"), F.col("f").alias("l")), ["lang", "first"])
        .join(part.select("lang", F.col("part").alias("rest"), F.col("f").alias("r")), ["lang", "rest"])
        .join(totals, "lang")
    )
    cuts = cuts.withColumn("score", cut_score(F.col("a"), F.col("n"), F.col("l"), F.col("r")))
    lowest = cuts.groupBy("lang", "phrase", "a", "n").agg(F.min(F.struct("score", "k", "l", "r")).alias("cut"))
    order = Window.partitionBy("lang").orderBy(F.desc("cut.score"), F.desc("a"), "phrase")
    ranked = lowest.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
    return ranked.select("lang", F.col("rank").cast("long"), "phrase", "a", "cut.l", "cut.r", "n", "cut.score")
