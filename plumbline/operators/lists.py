"""Sorted lists of names as text, one row per key; a long list is put together from sorted pieces.

An aggregate holds every name of a list as an object, some four times its text,
and copies the text several times more. That is done for short lists only. The
names of long ones are dealt out by ranges, each range makes a piece of text,
and one task joins the pieces in a file, so that nothing but the finished row
is ever held whole.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from functools import reduce
from typing import TYPE_CHECKING

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import LongType, StringType, StructField, StructType

if TYPE_CHECKING:
    import pyarrow as pa

SEPARATOR = ", "
#: names above which a list counts as long, and about so many names of a piece
LONG, PIECE = 1 << 16, 1 << 18
#: long lists are told by one in so many rows, picked by a hash; a list taken for a short one is whole and right all the same
SAMPLE = 64
#: bytes above which a list's row is wide: before it comes a sixth of its size in rows of short lists, as writers of files look at their buffers only after some rows
WIDE, SPACED = 1 << 24, 6
#: at most this share of the short lists goes that way
MOST_BETWEEN = 0.25


def short_lists(rows: DataFrame, keys: list[str], name: str, text: str, count: str) -> DataFrame:
    return rows.groupBy(*keys).agg(F.array_join(F.sort_array(F.collect_list(name)), SEPARATOR).alias(text), F.count(F.lit(1)).alias(count))


def name_lists(rows: DataFrame, keys: list[str], name: str, text: str, count: str) -> DataFrame:
    """Per key, null included, the names in rising order as one text, and the number of rows. Null names are counted, not listed.

    Which lists are long is decided when the frame is made; their keys, at most
    one for ``LONG`` rows or so, come to the driver.
    """
    size = F.coalesce(F.octet_length(F.col(name).cast("string")), F.lit(0)) + len(SEPARATOR)
    seen = rows.where(F.pmod(F.xxhash64(*keys, name), F.lit(SAMPLE)) == 0).groupBy(*keys).agg(F.count(F.lit(1)).alias("_rows"), F.sum(size).alias("_size"))
    is_long = F.col("_rows") * SAMPLE > LONG
    found = seen.agg(F.sum("_size").alias("size"), F.collect_list(F.when(is_long, F.struct(*keys, "_rows", "_size"))).alias("long")).first()
    if not found.long:
        return short_lists(rows, keys, name, text, count)

    import pyarrow as pa

    fields = [rows.schema[k] for k in keys]
    # from an Arrow table, as a list of tuples would take a Python worker in every executor
    listed = rows.sparkSession.createDataFrame(
        pa.table({f"_{k}": pa.array([r[k] for r in found.long], to_arrow_type(f.dataType)) for k, f in zip(keys, fields, strict=True)})
    )
    same = reduce(Column.__and__, [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys])
    long, short = [rows.join(F.broadcast(listed), same, how) for how in ("left_semi", "left_anti")]

    parts = math.ceil(sum(r["_rows"] for r in found.long) * SAMPLE / PIECE)
    ranged = long.repartitionByRange(parts, *keys, name).withColumn("_at", F.spark_partition_id())
    pieces = ranged.groupBy(*keys, "_at").agg(
        F.array_join(F.sort_array(F.collect_list(name)), SEPARATOR).alias(text), F.count(F.lit(1)).alias(count), F.count(name).alias("_names")
    )
    sizes = [r["_size"] for r in found.long]
    wide = sum(x for x in sizes if x * SAMPLE > WIDE)
    if wide:
        share = min(MOST_BETWEEN, wide / SPACED / max(1, found.size - sum(sizes)))
        between = F.pmod(F.xxhash64(*keys), F.lit(1 << 20)) < int(share * (1 << 20))
        others = short_lists(short.where(between), keys, name, text, count).withColumns({"_at": F.lit(None).cast("int"), "_names": F.lit(0).cast("long")})
        pieces, short = pieces.unionByName(others), short.where(~between)

    out = StructType([*[StructField(f.name, f.dataType) for f in fields], StructField(text, StringType()), StructField(count, LongType())])
    # one task puts the long rows in their order, one writes them: two such rows in an executor at once are what it has no room for
    joined = pieces.repartition(1).mapInArrow(put_together(keys, text, count), out).repartition(1)
    return short_lists(short, keys, name, text, count).unionByName(joined)


def put_together(keys: list[str], text: str, count: str) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Rows without ``_at`` pass as they are; the others are pieces of lists, joined in its order. Texts wait in files, in any order of arrival."""
    separator, least, spaced = SEPARATOR.encode(), WIDE, SPACED

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import mmap
        import os
        import struct
        import tempfile

        import pyarrow as pa

        folder = os.environ.get("SPARK_LOCAL_DIRS", "").split(",")[0] or None
        with tempfile.TemporaryFile(dir=folder) as texts, tempfile.TemporaryFile(dir=folder) as blocks:
            lists, waiting, schema = {}, [], None
            for batch in batches:
                whole = batch.filter(batch.column("_at").is_null()).select([*keys, text, count])
                schema = whole.schema
                if whole.num_rows:
                    waiting.append((blocks.tell(), whole.nbytes))
                    blocks.write(whole.serialize())
                held = batch.filter(batch.column("_at").is_valid())
                for i in range(held.num_rows):
                    key = tuple(held.column(k)[i].as_py() for k in keys)
                    piece = held.column(text)[i].as_buffer()
                    place = held.column("_at")[i].as_py(), texts.tell(), piece.size, held.column("_names")[i].as_py(), held.column(count)[i].as_py()
                    lists.setdefault(key, []).append(place)
                    texts.write(piece)
            texts.flush()
            blocks.flush()
            waiting.reverse()

            def block() -> tuple[pa.RecordBatch, int]:
                at, size = waiting.pop()
                blocks.seek(at)
                return pa.ipc.read_record_batch(pa.ipc.read_message(blocks), schema), size

            found = []
            for key, places in lists.items():
                named = [p for p in sorted(places) if p[3]]
                found.append((sum(p[2] for p in named) + len(separator) * max(0, len(named) - 1), key, named, sum(p[4] for p in places)))
            # the largest row comes first, as the next task makes room for ever larger ones anew
            found.sort(key=lambda x: -x[0])
            share = min(1 / spaced, sum(n for _, n in waiting) / max(1, sum(x[0] for x in found if x[0] > least)))

            for size, key, named, total in found:
                room = size * share if size > least else 0
                while waiting and room > 0:
                    rows, taken = block()
                    room -= taken
                    yield rows
                with tempfile.TemporaryFile(dir=folder) as row:
                    for n, (_, at, length, *_) in enumerate(named):
                        row.write(separator if n else b"")
                        texts.seek(at)
                        row.write(texts.read(length))
                    row.flush()
                    # a mapped file takes no memory of the worker's own
                    value = pa.py_buffer(mmap.mmap(row.fileno(), 0, access=mmap.ACCESS_READ)) if size else pa.py_buffer(b"")
                    columns = [pa.array([k], schema.field(c).type) for c, k in zip(keys, key, strict=True)]
                    columns.append(pa.StringArray.from_buffers(1, pa.py_buffer(struct.pack("=2i", 0, size)), value))
                    yield pa.RecordBatch.from_arrays([*columns, pa.array([total], pa.int64())], schema=schema)
            while waiting:
                yield block()[0]

    return run
