"""Words of whole texts as bytes, and their counts over a corpus."""

from __future__ import annotations

import uuid
from collections import Counter, OrderedDict
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

#: the blanks that part words; bytes.split() knows just these six
BLANKS = b" \t\n\x0b\x0c\r"
#: different words a task holds before it passes their counts on
HELD_WORDS = 200_000


def byte_table(changes: dict[bytes, bytes] | None = None) -> bytes:
    """Table for bytes.translate: A-Z to a-z, and each byte of a key to the value; other letters stay as they are."""
    table = bytearray(range(256))
    for c in range(ord("A"), ord("Z") + 1):
        table[c] = c + 32
    for source, to in (changes or {}).items():
        for c in source:
            table[c] = to[0]
    return bytes(table)


LOWER = byte_table()


def word_counts(df: DataFrame, text: str, group: Column, table: bytes = LOWER) -> DataFrame:
    """(grp, word, n): occurrences of every word of every whole text, per group.

    Words are what blanks part once ``table`` has been applied. A null text has
    none. Every task merges its counts before they are shuffled.
    """
    rows = df.select(group.cast("string").alias("grp"), F.col(f"`{text}`").cast("string").cast("binary").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[str | None, Counter] = {}

        def out() -> Iterator[pa.RecordBatch]:
            for grp, counts in seen.items():
                words, n = list(counts), np.fromiter(counts.values(), np.int64, len(counts))
                for lo in range(0, len(words), 50_000):
                    part = words[lo : lo + 50_000]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([grp] * len(part), pa.string()), pa.array(part, pa.binary()).cast(pa.string()), pa.array(n[lo : lo + 50_000])],
                        names=["grp", "word", "n"],
                    )
            seen.clear()

        for batch in batches:
            for grp, value in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if value:
                    seen.setdefault(grp, Counter()).update(value.translate(table).split())
            if sum(map(len, seen.values())) > HELD_WORDS:
                yield from out()
        yield from out()

    return rows.mapInArrow(run, "grp string, word string, n long").groupBy("grp", "word").agg(F.sum("n").alias("n"))


def most_frequent(counts: DataFrame, n: str, most: int) -> DataFrame:
    """The rows with the largest numbers, at most ``most`` of them: all down to a number, never only some of equal ones.

    Numbers are counted by steps (single ones below 2^12, then 256 to a
    doubling), so that no task and not the driver sees more than some thousand
    rows to find the limit.
    """
    c = F.col(n)
    step = F.when(c < 4096, c).otherwise(4096 + F.floor((F.log2(c.cast("double")) - 12) * 256)).cast("long")
    rows, least = 0, 0
    for r in sorted(counts.groupBy(step.alias("step")).count().collect(), key=lambda r: -r["step"]):
        rows += r["count"]
        if rows > most:
            least = r["step"] + 1
            break
    return counts.where(step >= least)


class Sent:
    """A value broadcast to the workers, and what each worker makes of it once; a worker keeps the last few."""

    _made: OrderedDict[str, object] = OrderedDict()

    def __init__(self, spark: SparkSession, value, make: Callable = lambda v: v):
        self.name, self.sent, self.make = uuid.uuid4().hex, spark.sparkContext.broadcast(value), make

    def get(self):
        made = Sent._made
        if self.name not in made:
            while len(made) >= 3:
                made.popitem(last=False)
            made[self.name] = self.make(self.sent.value)
        made.move_to_end(self.name)
        return made[self.name]
