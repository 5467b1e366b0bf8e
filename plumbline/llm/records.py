"""Token ids as length-delimited binary records, with an offset index beside them.

File: eight bytes ``PLREC01`` and the width of an id (2 or 4), then records.
Record: payload length (u64), masked checksum of those eight bytes (u32),
payload, masked checksum of the payload (u32). Payload: one byte that is 1 if
there is a document id, the id (i64), the token ids. All little-endian. A
checksum is the CRC-32, rotated right by 15 bits plus a constant, so that
checksums of data that holds checksums stay telling.

The index is a Parquet table with a row per record: doc_id, file, record,
offset, length, n_tokens, and start, the number of ids in all files before it.
Readers only open files that the index names, so what a lost or repeated task
has left behind is never read.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from plumbline.llm.bpe import LibraryEncoder
from plumbline.llm.frames import TEXT_ROWS, keep_tables, settle, worker_table

MAGIC = b"PLREC01"
MASK_DELTA = 0xA282EAD8
#: a task starts another file beyond this many bytes
FILE_BYTES = 128 << 20
#: forms of a record's head, of a checksum and of the document id before the token ids
HEAD, CRC, KEY = "<QI", "<I", "<Bq"
HEAD_BYTES, CRC_BYTES, KEY_BYTES = map(struct.calcsize, (HEAD, CRC, KEY))


def masked(data: bytes) -> int:
    crc = zlib.crc32(data)
    return (((crc >> 15) | (crc << 17)) + MASK_DELTA) & 0xFFFFFFFF


def frame(payload: bytes) -> bytes:
    """One record of a payload."""
    length = struct.pack("<Q", len(payload))
    return b"".join([length, struct.pack(CRC, masked(length)), payload, struct.pack(CRC, masked(payload))])


def payload_at(file, what: str) -> bytes | None:
    """The payload of the record where the file stands; None at the end. Damage raises ValueError."""
    head = file.read(HEAD_BYTES)
    if not head:
        return None
    if len(head) < HEAD_BYTES or struct.unpack(HEAD, head)[1] != masked(head[:8]):
        raise ValueError(f"damaged length in {what}")
    length = struct.unpack(HEAD, head)[0]
    body = file.read(length + CRC_BYTES)
    if len(body) < length + CRC_BYTES or struct.unpack(CRC, body[length:])[0] != masked(body[:length]):
        raise ValueError(f"damaged record in {what}")
    return body[:length]


def open_store(folder: str) -> tuple[fs.FileSystem, str]:
    """File system and path of a folder: a local path or the URI of any store that Arrow knows."""
    if "://" in folder or folder.startswith("file:"):
        if folder.startswith("file:/") and not folder.startswith("file://"):
            folder = "file://" + folder.removeprefix("file:")
        return fs.FileSystem.from_uri(folder)
    return fs.LocalFileSystem(), folder


def write_records(
    df: DataFrame, path: str, folder: str, text: str = "text", doc_id: str = "doc_id", end_id: int | None = 2, partitions: int | None = None
) -> DataFrame:
    """Encode whole texts and write them in ascending order of doc_id; returns the index.

    Null ids come first; rows with the same id are ordered by a hash of their
    text, and equal rows may change places without a change in the files. A
    null or empty text is a record that holds only ``end_id`` (nothing at all
    with None). An empty table gives an empty index and no file. Rows are
    dealt by ranges of the id, so each task writes its own stretch.
    """
    spark = df.sparkSession
    rows = df.select(
        df[f"`{doc_id}`"].cast("long").alias("doc_id"), df[f"`{text}`"].cast("string").alias("text")
    ).withColumn("tie", F.xxhash64("text"))
    order = [F.asc_nulls_first("doc_id"), F.col("tie")]
    dealt = rows.repartitionByRange(partitions, *order) if partitions else rows.repartitionByRange(*order)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, base = open_store(folder)
        store.create_dir(base, recursive=True)
        keep_tables(__name__)
        tokenizer = worker_table(__name__, path, LibraryEncoder)
        wide = tokenizer.size > 1 << 16 or (end_id or 0) >= 1 << 16
        form = np.dtype("<u4" if wide else "<u2")
        end = np.array([] if end_id is None else [end_id], form).tobytes()
        shard, attempt = TaskContext.get().partitionId(), uuid.uuid4().hex
        out, name, files, at, record, tokens = None, "", 0, 0, 0, 0
        try:
            for batch in batches:
                column = batch.column(1)
                texts = (t for lo in range(0, batch.num_rows, TEXT_ROWS) for t in column.slice(lo, TEXT_ROWS).to_pylist())
                index = []
                for key, found in zip(batch.column(0).to_pylist(), tokenizer.encode_all(texts)):
                    if out is None or at >= FILE_BYTES:
                        if out is not None:
                            out.close()
                        name, at = f"ids-{shard:06d}-{files:04d}-{attempt}.rec", 8
                        files += 1
                        out = store.open_output_stream(f"{base}/{name}")
                        out.write(MAGIC + bytes([form.itemsize]))
                    ids = found.astype(form).tobytes() + end
                    n = len(ids) // form.itemsize
                    data = frame(struct.pack(KEY, key is not None, key or 0) + ids)
                    out.write(data)
                    index.append((key, shard, name, record, at, len(data), n, tokens))
                    record, at, tokens = record + 1, at + len(data), tokens + n
                columns = list(zip(*index)) if index else [[]] * 8
                kinds = [pa.int64(), pa.int32(), pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64()]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=names)
        finally:
            if out is not None:
                out.close()

    names = ["doc_id", "shard", "file", "record", "offset", "length", "n_tokens", "start_in_shard"]
    written = settle(
        dealt.sortWithinPartitions(*order).drop("tie").mapInArrow(
            run, "doc_id long, shard int, file string, record long, offset long, length long, n_tokens long, start_in_shard long"
        ),
        f"{folder}/parts",
    )
    # one row per task that wrote
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    bases = written.groupBy("shard").agg(F.sum("n_tokens").alias("n")).select(
        "shard", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base")
    )
    index = written.join(bases, "shard").select(
        "doc_id", "file", F.col("record"), "offset", "length", "n_tokens", (F.col("base") + F.col("start_in_shard")).alias("start")
    )
    return settle(index, f"{folder}/index")


def open_index(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/index")


def read_records(index: DataFrame, folder: str) -> DataFrame:
    """Read whole files back: doc_id, start, n_tokens and ids, packed as unsigned 32-bit integers.

    There are as many tasks as files; each reads one from its head to its end
    and checks every length and checksum. A damaged file raises ValueError.
    """
    files = index.groupBy("file").agg(F.min("start").alias("start"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, base = open_store(folder)
        for batch in batches:
            for name, start in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                with store.open_input_stream(f"{base}/{name}") as file:
                    head = file.read(8)
                    if head[:7] != MAGIC or head[7] not in (2, 4):
                        raise ValueError(f"{name} is no record file")
                    rows, size = [], 0
                    while (payload := payload_at(file, name)) is not None:
                        has, key = struct.unpack_from(KEY, payload)
                        ids = np.frombuffer(payload, f"<u{head[7]}", offset=KEY_BYTES).astype("<u4")
                        rows.append((key if has else None, start, len(ids), ids.tobytes()))
                        start, size = start + len(ids), size + ids.nbytes
                        if size > 8 << 20:
                            yield batch_of(rows)
                            rows, size = [], 0
                    if rows:
                        yield batch_of(rows)

    def batch_of(rows: list[tuple]) -> pa.RecordBatch:
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.binary()]
        return pa.RecordBatch.from_arrays(
            [pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=["doc_id", "start", "n_tokens", "ids"]
        )

    # a number, or the few bytes of names would be merged into one task
    return files.repartition(max(1, files.count())).mapInArrow(run, "doc_id long, start long, n_tokens long, ids binary")


def read_shuffled(index: DataFrame, folder: str, seed: int = 0, partitions: int | None = None) -> DataFrame:
    """Read single records through the index, dealt over tasks and ordered by a hash of the seed and their place.

    Gives doc_id, start, n_tokens and packed ids, in an order that agrees on
    every run. Without ``partitions`` there are as many tasks as files.
    """
    where = index.select("file", "offset", "start").withColumn("place", F.xxhash64(F.lit(seed), "start"))
    partitions = partitions or max(1, index.select("file").distinct().count())
    dealt = where.repartition(partitions, "place")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, base = open_store(folder)
        name, file = None, None
        for batch in batches:
            rows = []
            for other, offset, start in zip(*[c.to_pylist() for c in batch.columns[:3]]):
                if other != name:
                    if file is not None:
                        file.close()
                    name, file = other, store.open_input_file(f"{base}/{other}")
                    width = file.read_at(8, 0)[7]
                file.seek(offset)
                payload = payload_at(file, name)
                has, key = struct.unpack_from(KEY, payload)
                ids = np.frombuffer(payload, f"<u{width}", offset=KEY_BYTES).astype("<u4")
                rows.append((key if has else None, start, len(ids), ids.tobytes()))
            if rows:
                kinds = [pa.int64(), pa.int64(), pa.int64(), pa.binary()]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=["doc_id", "start", "n_tokens", "ids"]
                )

    return dealt.sortWithinPartitions("place").mapInArrow(run, "doc_id long, start long, n_tokens long, ids binary")
