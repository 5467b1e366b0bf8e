"""SimHash fingerprints and their near duplicates by anchor-point covering.

Anchors are the words of a fixed covering code: the 64 bits are cut into equal
parts, and each part uses the affine functions of its index bits (a first-order
Reed-Muller code). A fingerprint is at home at its nearest anchor, at distance
d, and visits all anchors within d plus the threshold. Of two fingerprints
within the threshold, the one nearer to its own anchor is at home where the
other visits, so comparing each anchor's homes with its visitors misses none.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import LongType, StructField

from plumbline.llm.frames import components, hashable, over_texts, row_mark, settle, spanning_edges, spare_name, whole_groups, with_splits

#: seed of the shingles' hash, words of a shingle, and the most bits in which linked fingerprints differ
SEED, SHINGLE, THRESHOLD = 42, 3, 3
#: rows of an anchor beyond which its work is split over a grid of tasks
ANCHOR_ROWS = 2048
#: shingles whose bits are counted at once
BITS_AT_ONCE = 1 << 15
#: fingerprints up to which two parts (4096 anchors) do; more use four (a million), then eight
PARTS_ROWS = ((200_000_000, 2), (20_000_000_000, 4))


def fingerprint(text: str | None, shingle: int = SHINGLE, seed: int = SEED) -> int:
    """SimHash of the word shingles of a whole text, as an unsigned number; zero without words."""
    words = text.encode().lower().split() if text else []
    if not words:
        return 0
    joined = b" ".join(words)
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(lengths + 1) - 1
    starts = (ends - lengths).tolist()
    if len(words) >= shingle:
        spans = zip(starts, ends[shingle - 1 :].tolist())
    else:
        spans = [(0, len(joined))]
    digest = xxhash.xxh64_intdigest
    hashes = np.array([digest(joined[a:b], seed) for a, b in spans], np.uint64)
    ones = np.zeros(64, np.int64)
    for lo in range(0, len(hashes), BITS_AT_ONCE):
        few = hashes[lo : lo + BITS_AT_ONCE]
        ones += np.unpackbits(few.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    bits = np.packbits(ones * 2 > len(hashes), bitorder="little")
    return int(bits.view("<u8")[0])


def fingerprints(
    df: DataFrame, text: str = "text", out: str = "fingerprint", keep: list[str] | None = None, shingle: int = SHINGLE, seed: int = SEED
) -> DataFrame:
    """Add the fingerprint of every whole text as a signed 64-bit number; null and wordless texts give zero."""

    def run(texts: list[str | None]) -> list[pa.Array]:
        made = np.array([fingerprint(t, shingle, seed) for t in texts], np.uint64)
        return [pa.array(made.view(np.int64))]

    return over_texts(df, text, run, [StructField(out, LongType())], keep)


def code_words(bits: int) -> np.ndarray:
    """All affine functions of the index of a bit, as words of so many bits."""
    index = np.arange(bits)
    width = bits.bit_length() - 1
    words = []
    for mask in range(bits):
        parity = np.zeros(bits, np.int64)
        for k in range(width):
            if mask >> k & 1:
                parity ^= index >> k & 1
        for flip in (0, 1):
            words.append(int(((parity ^ flip) << index).sum()))
    return np.array(words, np.uint64)


def anchors_of(prints: np.ndarray, parts: int, threshold: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, anchor, home): the home of every fingerprint and the anchors that it visits."""
    bits = 64 // parts
    words = code_words(bits)
    width = len(words).bit_length() - 1
    mask = np.uint64((1 << bits) - 1)
    row = np.arange(len(prints))
    anchor = np.zeros(len(prints), np.int64)
    home_anchor = np.zeros(len(prints), np.int64)
    extra = np.zeros(len(prints), np.int64)
    for k in range(parts):
        own = (prints >> np.uint64(k * bits)) & mask
        far = np.bitwise_count(own[:, None] ^ words).astype(np.int64)
        home_anchor = home_anchor << width | far.argmin(1)
        far -= far.min(1)[:, None]
        at, word = np.nonzero(far[row] + extra[:, None] <= threshold)
        row, anchor, extra = row[at], anchor[at] << width | word, extra[at] + far[row[at], word]
    return row, anchor, anchor == home_anchor[row]


def near_pairs(group: pa.Table, threshold: int, step: int = 1024) -> tuple[np.ndarray, np.ndarray]:
    """Links between the homes of a block and its rows."""
    prints = group.column("node").to_numpy()
    role = group.column("role").to_numpy()
    homes, rest = prints[role > 0], prints[role != 1]
    left, right = [], []
    for lo in range(0, len(homes), step):
        near = np.bitwise_count(homes[lo : lo + step, None].view(np.uint64) ^ rest.view(np.uint64)) <= threshold
        i, j = np.nonzero(near)
        left.append(homes[lo + i])
        right.append(rest[j])
    a, b = np.concatenate(left) if left else prints[:0], np.concatenate(right) if right else prints[:0]
    apart = a != b
    return a[apart], b[apart]


def linked_fingerprints(prints: DataFrame, node: str = "node", threshold: int = THRESHOLD, parts: int | None = None) -> DataFrame:
    """(node, root) of all distinct fingerprints that differ from another in at most ``threshold`` bits.

    ``prints`` is a settled table with one row per fingerprint.
    """
    if parts is None:
        total = prints.count()
        parts = next((p for most, p in PARTS_ROWS if total <= most), 8)

    def replicate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = batch.column(0).to_numpy()
            for lo in range(0, len(own), 10_000):
                some = own[lo : lo + 10_000]
                row, anchor, home = anchors_of(some.view(np.uint64), parts, threshold)
                yield pa.RecordBatch.from_arrays([pa.array(some[row]), pa.array(anchor), pa.array(home)], names=["node", "anchor", "home"])

    def compare(group: pa.Table) -> pa.Table:
        a, b = spanning_edges(*near_pairs(group, threshold))
        return pa.table({"a": a, "b": b})

    at_anchors = prints.select(F.col(node).alias("node")).mapInArrow(replicate, "node long, anchor long, home boolean")
    blocks = with_splits(at_anchors, ["anchor"], F.col("node"), ANCHOR_ROWS)
    found = whole_groups(
        blocks.select("anchor", "part_a", "part_b", "node", "role"), ["anchor", "part_a", "part_b"], compare, "a long, b long"
    )
    return components(settle(found.distinct()), "a", "b")


def component_ids(rows: DataFrame, threshold: int = THRESHOLD) -> DataFrame:
    """(fingerprint, component_id) of settled rows (doc_id, fingerprint): the smallest id reachable over links."""
    classes = settle(rows.groupBy("fingerprint").agg(F.min("doc_id").alias("first_id")))
    roots = settle(linked_fingerprints(classes, "fingerprint", threshold))
    first = classes.join(roots, classes.fingerprint == roots.node).select("root", "first_id")
    least = settle(first.groupBy("root").agg(F.min("first_id").alias("least_id")))
    reached = settle(roots.join(least, "root").select(F.col("node").alias("fingerprint"), "root", "least_id"))
    return settle(
        classes.join(reached, "fingerprint", "left").select(
            "fingerprint", F.coalesce("root", "fingerprint").alias("root"), F.coalesce("least_id", "first_id").alias("component_id")
        )
    )


def near_duplicates(
    df: DataFrame, text: str = "text", doc_id: str = "doc_id", threshold: int = THRESHOLD, shingle: int = SHINGLE, seed: int = SEED
) -> DataFrame:
    """doc_id, fingerprint (signed number) and component_id, the smallest doc_id reachable over links.

    One row per input row. Rows with a null id are compared like others; a
    component without any id has a null component_id. Texts without words, null
    ones included, share the fingerprint zero. Equal fingerprints are merged in
    every task before they are compared, so a mass of copies is one row.
    """
    given = df.select(df[f"`{doc_id}`"].alias("doc_id"), df[f"`{text}`"].alias("text"))
    rows = settle(fingerprints(given, "text", "fingerprint", ["doc_id"], shingle, seed))
    return rows.join(component_ids(rows, threshold), "fingerprint").select("doc_id", "fingerprint", "component_id")


def one_of_each(
    df: DataFrame, text: str = "text", doc_id: str = "doc_id", threshold: int = THRESHOLD, shingle: int = SHINGLE, seed: int = SEED
) -> DataFrame:
    """The rows of the frame, one of each component: that of the smallest id (null last), of equal ids the one whose hash is least.

    Of rows equal in all columns, of any types, one is kept. Texts without words are one
    component, as their fingerprints are equal.
    """
    mark = spare_name(df, "mark")
    marked = df.withColumn(mark, row_mark(df))
    given = marked.select(marked[f"`{doc_id}`"].alias("doc_id"), marked[mark].alias("mark"), marked[f"`{text}`"].alias("text"))
    rows = settle(fingerprints(given, "text", "fingerprint", ["doc_id", "mark"], shingle, seed))
    roots = component_ids(rows, threshold).select("fingerprint", "root")
    # the first of each fingerprint, merged in every task, then of each component
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "mark")).alias("first")
    firsts = settle(rows.groupBy("fingerprint").agg(first))
    kept = firsts.join(roots, "fingerprint").groupBy("root").agg(F.min("first").alias("first")).select("first.doc_id", "first.mark")
    kept = settle(kept)
    found = marked.join(kept, (marked[mark] == kept["mark"]) & marked[doc_id].eqNullSafe(kept["doc_id"]), "left_semi").drop(mark)
    again = rows.join(kept.withColumnsRenamed({"doc_id": "kept_id", "mark": "kept_mark"}), (F.col("mark") == F.col("kept_mark")) & F.col("doc_id").eqNullSafe(F.col("kept_id")))
    repeated = settle(again.groupBy("doc_id", "mark").count().where("count > 1").select(F.col("doc_id").alias("kept_id"), F.col("mark").alias("kept_mark")))
    if repeated.isEmpty():
        return found
    # one of equal rows; tasks merge them before the shuffle
    again = F.xxhash64(*hashable(found))
    same = found.join(repeated, (again == F.col("kept_mark")) & found[doc_id].eqNullSafe(F.col("kept_id")), "left")
    columns = [F.col(f"`{c}`") for c in df.columns]
    one = same.where("kept_mark is not null").groupBy("kept_id", "kept_mark").agg(F.any_value(F.struct(*columns)).alias("row")).select("row.*")
    return same.where("kept_mark is null").select(*columns).unionByName(one)
