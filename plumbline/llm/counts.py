"""Token counts of whole texts with a byte-level tokenizer, without a shuffle of pre-tokens.

First tier: a compact table of frequent pre-tokens with their lengths in
tokens, sent to every worker. Second tier: a pre-token that it lacks is encoded
by the tokenizers library and kept in the worker's own bounded cache.
"""

from __future__ import annotations

import json
import os
import re
import sys
import unicodedata
import uuid
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import LongType, StructField
from tokenizers import Tokenizer

from plumbline.llm.bpe import USUAL_TEXT
from plumbline.llm.frames import over_texts, settle
from plumbline.llm.words import most_frequent

#: documents that fill the first tier (it changes speed, never a count), its size, and what a task may report for it
SAMPLE_DOCS, TABLE_ENTRIES, TASK_ENTRIES = 2000, 60_000, 20_000
#: pre-tokens longer than this are not kept
LONGEST = 40
#: entries of the second tier of a worker, twice
CACHE_ENTRIES = 250_000


def usual_class(kinds: str) -> str:
    """The usual code points of some general categories, for use in a character class."""
    found = [c for c in map(chr, range(sys.maxunicode + 1)) if unicodedata.category(c)[0] in kinds and USUAL_TEXT.fullmatch(c)]
    runs: list[list[int]] = []
    for c in map(ord, found):
        if runs and runs[-1][1] == c - 1:
            runs[-1][1] = c
        else:
            runs.append([c, c])
    return "".join(f"\\U{a:08x}-\\U{b:08x}" for a, b in runs)


@dataclass
class Lengths:
    """Frequent pre-tokens end to end, where each ends, and its number of tokens."""

    joined: str
    ends: np.ndarray
    lengths: np.ndarray

    def as_dict(self) -> dict[str, int]:
        starts = [0, *self.ends[:-1].tolist()]
        return {self.joined[a:b]: n for a, b, n in zip(starts, self.ends.tolist(), self.lengths.tolist())}


class Misses(dict):
    """The worker's tier: lengths of pre-tokens that the table lacks, in two generations of bounded size."""

    def __init__(self, tokenizer: Tokenizer):
        super().__init__()
        self.tokenizer, self.older = tokenizer, {}

    def __missing__(self, piece: str) -> int:
        n = self.older.get(piece)
        if n is None:
            n = len(self.tokenizer.encode(piece, add_special_tokens=False).ids)
        if len(piece) <= LONGEST:
            if len(self) >= CACHE_ENTRIES:
                self.older = self.copy()
                self.clear()
            self[piece] = n
        return n


class TokenCounter:
    """Counts of whole texts as the tokenizers library gives them for the file."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        cut = spec["pre_tokenizer"] or {}
        if spec["normalizer"] or cut.get("type") != "ByteLevel" or cut.get("add_prefix_space") or not cut.get("use_regex"):
            raise ValueError("only byte-level tokenizers with the usual cuts are supported")
        added = spec["added_tokens"]
        if any(a.get(k) for a in added for k in ("lstrip", "rstrip", "single_word")):
            raise ValueError("only added tokens that stand as they are written are supported")
        # as the library takes them: the leftmost, then the longest
        self.special = [a["content"] for a in added]
        self.specials = re.compile("|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) or "(?!)")
        letters, numbers, blanks = usual_class("L"), usual_class("N"), "\t-\r \x85\xa0"
        self.cut = re.compile(
            f"'s|'t|'re|'ve|'m|'ll|'d| ?[{letters}]+| ?[{numbers}]+| ?[^{blanks}{letters}{numbers}]+|[{blanks}]+(?![^{blanks}])|[{blanks}]+"
        )
        self.frequent: dict[str, int] = {}
        self.table = ""
        self.misses = Misses(self.tokenizer)

    def pieces(self, text: str) -> list[str]:
        """The pre-tokens of a text without special strings.

        The expression above cuts texts of usual code points as the tokenizer
        does; others are cut by the tokenizer's own pre-tokenizer.
        """
        if USUAL_TEXT.fullmatch(text) is not None:
            return self.cut.findall(text)
        return [text[a:b] for _, (a, b) in self.tokenizer.pre_tokenizer.pre_tokenize_str(text)]

    def count(self, text: str | None) -> int:
        if not text:
            return 0
        parts = [text]
        if any(s in text for s in self.special):
            parts = self.specials.split(text)
        total = len(parts) - 1
        misses = self.misses
        for part in parts:
            pieces = self.pieces(part)
            found = list(map(self.frequent.get, pieces))
            total += sum(found) if None not in found else sum([misses[p] if n is None else n for p, n in zip(pieces, found)])
        return total


@lru_cache(maxsize=2)
def counter(path: str) -> TokenCounter:
    """The counter of a file, once per worker."""
    return TokenCounter(path)


def frequent_lengths(df: DataFrame, path: str, text: str = "text", docs: int = SAMPLE_DOCS, entries: int = TABLE_ENTRIES) -> Lengths:
    """The first tier: the most frequent pre-tokens of about ``docs`` documents, picked by a hash of their text.

    The bound holds whatever the corpus, and what is in the table only changes
    how fast counts are made.
    """
    texts = df.select(df[f"`{text}`"].cast("string").alias("text"))
    total = max(1, texts.count())
    share = min(1.0, docs / total)
    picked = texts.where(F.pmod(F.xxhash64("text"), F.lit(1 << 20)) < int(share * (1 << 20)) + 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, seen = counter(path), Counter()
        for batch in batches:
            for t in batch.column(0).to_pylist():
                if t:
                    seen.update(p for part in own.specials.split(t) for p in own.pieces(part) if len(p) <= LONGEST)
                    if len(seen) > 10 * TASK_ENTRIES:
                        seen = Counter(dict(seen.most_common(TASK_ENTRIES)))
        top = seen.most_common(TASK_ENTRIES)
        yield pa.RecordBatch.from_arrays([pa.array([p for p, _ in top], pa.string()), pa.array([n for _, n in top], pa.int64())], names=["piece", "n"])

    counts = settle(picked.mapInArrow(run, "piece string, n long").groupBy("piece").agg(F.sum("n").alias("n")))
    pieces = most_frequent(counts, "n", entries).toArrow()["piece"].to_pylist()
    tokenizer = counter(path).tokenizer
    lengths = [len(e.ids) for e in tokenizer.encode_batch(pieces, add_special_tokens=False)]
    return Lengths("".join(pieces), np.cumsum([len(p) for p in pieces], dtype=np.int64), np.array(lengths, np.int32))


def token_counts(
    df: DataFrame, path: str, text: str = "text", n_tokens: str = "n_tokens", keep: list[str] | None = None, table: Lengths | None = None
) -> DataFrame:
    """Add the number of tokens of every whole text; a null or empty text has none.

    Special strings inside a text count as the library takes them by default:
    one token each. Other columns stay (or those in ``keep``).
    """
    spark = df.sparkSession
    sent = spark.sparkContext.broadcast(table or frequent_lengths(df, path, text))
    name = uuid.uuid4().hex

    def run(texts: list[str | None]) -> list[pa.Array]:
        own = counter(path)
        if own.table != name:
            own.frequent, own.table = sent.value.as_dict(), name
        return [pa.array([own.count(t) for t in texts], pa.int64())]

    return over_texts(df, text, run, [StructField(n_tokens, LongType())], keep)
