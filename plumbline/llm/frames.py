"""Helpers of the operators: Arrow passes, intermediate tables, groups dealt over tasks, components."""

from __future__ import annotations

import gc
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.types import StructField, StructType

#: texts that one step of a pass turns into Python objects; Spark bounds the bytes of an Arrow batch
TEXT_ROWS = 500
#: a table with at most this many short rows may be sent to every executor
SMALL_ROWS = 100_000


def shared_folder(spark: SparkSession) -> str:
    """The folder that the cluster names in spark.checkpoint.dir.

    Only a local session without that setting gets one of its own.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
        folder = tempfile.mkdtemp(prefix="plumbline-llm-")
        spark.sparkContext.setCheckpointDir(folder)
    return folder.rstrip("/")


def new_folder(spark: SparkSession) -> str:
    return f"{shared_folder(spark)}/llm-{uuid.uuid4().hex}"


def settle(df: DataFrame, path: str | None = None) -> DataFrame:
    """Write a frame to the shared folder and read it back.

    Its rows are computed once and stay as they are, and a lost executor costs
    a read instead of the whole lineage.
    """
    path = path or new_folder(df.sparkSession)
    df.write.parquet(path)
    nullable = StructType([StructField(f.name, f.dataType, True) for f in df.schema])
    return df.sparkSession.read.schema(nullable).parquet(path)


def forget(spark: SparkSession, path: str) -> None:
    """Remove an intermediate table that nothing reads any more."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


#: what this worker keeps from task to task, by operator and key
_tables: dict[tuple[str, str], object] = {}


def worker_table(operator: str, key: str, make: Callable[[str], object]):
    """What ``make`` gives for a key, made once per worker and kept until a task of another operator begins there."""
    if (operator, key) not in _tables:
        _tables[operator, key] = make(key)
    return _tables[operator, key]


def keep_tables(operator: str) -> None:
    """Let go of the tables of all other operators, so that a worker never holds those of several side by side."""
    for name in [n for n in _tables if n[0] != operator]:
        del _tables[name]
    # tables that refer to themselves go only here
    gc.collect()


def over_texts(
    df: DataFrame, text: str, fn: Callable[[list[str | None]], list[pa.Array]], added: list[StructField], keep: list[str] | None = None
) -> DataFrame:
    """Add columns computed from whole texts, a few hundred rows at a time.

    ``fn`` gets the texts and returns one array per added column. With ``keep``
    only those columns of the frame go through, else all but the clashing ones.
    A worker that begins with it lets go of what it kept for functions of other modules.
    """
    names = {f.name.lower() for f in added}
    kept = [c for c in (df.columns if keep is None else keep) if c.lower() not in names]
    spare = "_text"
    while spare.lower() in {c.lower() for c in kept} | names:
        spare = f"_{spare}"
    frame = df.select(*[df[f"`{c}`"] for c in kept], df[f"`{text}`"].cast("string").alias(spare))
    schema = StructType([*[StructField(f.name, f.dataType, True) for f in frame.schema][:-1], *added])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keep_tables(fn.__module__)
        for batch in batches:
            for lo in range(0, batch.num_rows, TEXT_ROWS):
                piece = batch.slice(lo, TEXT_ROWS)
                columns = fn(piece.column(piece.num_columns - 1).to_pylist())
                yield pa.RecordBatch.from_arrays(
                    [*piece.columns[:-1], *columns], names=[*kept, *[f.name for f in added]]
                )

    return frame.mapInArrow(run, schema)


def spare_name(df: DataFrame, name: str) -> str:
    """The name, with underscores in front until no column of the frame has it."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def hashable(df: DataFrame) -> list[Column]:
    """The columns of a frame, those that hold maps as JSON text, which Spark can hash."""
    return [F.to_json(F.struct(df[f"`{f.name}`"])) if "map<" in f.dataType.simpleString() else df[f"`{f.name}`"] for f in df.schema.fields]


def row_mark(df: DataFrame) -> Column:
    """Hash of all columns of a row, whatever their types."""
    return F.xxhash64(*hashable(df))


def left_lookup(rows: DataFrame, few: DataFrame, on: list[str]) -> DataFrame:
    """Left join to a settled table; it is sent to every task only if it is counted to be small."""
    return rows.join(F.broadcast(few) if few.count() <= SMALL_ROWS else few, on, "left")


def whole_groups(
    df: DataFrame, keys: list[str], fn: Callable[[pa.Table], pa.Table | None], schema: str
) -> DataFrame:
    """Apply fn to the rows of each key, many small groups per task without a call per group from the JVM.

    A group is held in memory, so callers split keys with many rows beforehand.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.Table] = []
        held_key = None

        def close() -> Iterator[pa.RecordBatch]:
            if held:
                out = fn(pa.concat_tables(held).combine_chunks())
                if out is not None and out.num_rows:
                    yield from out.to_batches(max_chunksize=50_000)

        for batch in batches:
            if not batch.num_rows:
                continue
            columns = [batch.column(batch.schema.get_field_index(k)).to_numpy(zero_copy_only=False) for k in keys]
            change = np.zeros(batch.num_rows, bool)
            change[0] = True
            for c in columns:
                change[1:] |= c[1:] != c[:-1]
            starts = [*np.flatnonzero(change), batch.num_rows]
            for lo, hi in zip(starts[:-1], starts[1:]):
                key = tuple(c[lo] for c in columns)
                if key != held_key:
                    yield from close()
                    held, held_key = [], key
                held.append(pa.Table.from_batches([batch.slice(lo, hi - lo)]))
        yield from close()

    return df.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(run, schema)


def spanning_edges(left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links of one task, reduced to one link from each linked node to the smallest node it reaches."""
    if not len(left):
        return left, right
    nodes, inverse = np.unique(np.concatenate([left, right]), return_inverse=True)
    a, b = inverse[: len(left)], inverse[len(left) :]
    label = np.arange(len(nodes))
    while True:
        low = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, label[a], low)
        np.minimum.at(new, label[b], low)
        new = new[new]
        if (new == label).all():
            break
        label = new
    away = label != np.arange(len(nodes))
    return nodes[away], nodes[label[away]]


def components(edges: DataFrame, a: str, b: str) -> DataFrame:
    """(node, root): every node of the links and the smallest node it reaches.

    Alternates two steps until nothing changes: each node passes its smallest
    neighbour to its larger neighbours, then to its smaller ones, so that long
    chains shrink to stars in a few rounds. The smallest neighbour is merged in
    every task before the shuffle. The joins with it read settled tables on
    both sides, so Spark can split the rows of a hub. Each round's tables are
    removed when the next is written. Rows with a null end are no links.
    """
    spark = edges.sparkSession

    def smallest(pairs: DataFrame) -> tuple[DataFrame, str]:
        path = new_folder(spark)
        return settle(pairs.groupBy("u").agg(F.min("v").alias("m")), path), path

    def keep(pairs: DataFrame) -> tuple[DataFrame, str]:
        path = new_folder(spark)
        return settle(pairs.where("u <> v").distinct(), path), path

    def state(pairs: DataFrame):
        return pairs.agg(
            F.count(F.lit(1)), F.sum(F.col("v").cast("decimal(38,0)")), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))
        ).first()

    big, small = F.greatest(a, b), F.least(a, b)
    now, path = keep(edges.where(F.col(a).isNotNull() & F.col(b).isNotNull()).select(big.alias("u"), small.alias("v")))
    before = state(now)
    while before[0]:
        # to the larger neighbours: every (u, v) has v below u
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low, low_path = smallest(both)
        up = now.select(F.col("u").alias("w"), F.col("v").alias("u")).join(low, "u")
        large, large_path = keep(up.select(F.col("w").alias("u"), F.least("m", "u").alias("v")))
        forget(spark, low_path)
        # to the smaller neighbours and the node itself
        low, low_path = smallest(large)
        down = large.join(low, "u").select(F.greatest("v", "m").alias("u"), F.col("m").alias("v"))
        own = low.select("u", F.col("m").alias("v"))
        after, after_path = keep(down.unionByName(own))
        for old in (path, large_path, low_path):
            forget(spark, old)
        now, path = after, after_path
        reached = state(now)
        if reached == before:
            break
        before = reached
    roots = now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(roots)


def with_splits(rows: DataFrame, keys: list[str], identity: Column, limit: int) -> DataFrame:
    """Deal the rows of each key over a grid of blocks so that no block holds an unbounded group.

    Expects a boolean column ``home``. A block compares its homes with all its
    rows. A key of at most ``limit`` rows is one block. A larger one is cut into
    s parts by a hash of ``identity``; block (a, b) gets the homes of part a and
    all rows of part b, so that every home meets every row of the key exactly
    once. Adds ``part_a``, ``part_b`` and ``role``: 2 for a home that belongs to
    both parts, 1 for a home of part a, 0 for a row of part b.
    """
    spark = rows.sparkSession
    large = settle(
        rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > limit)
        .select(*keys, F.ceil(F.col("n") / limit).cast("int").alias("parts"))
    )
    dealt = left_lookup(rows, large, keys).withColumn("parts", F.coalesce("parts", F.lit(1)))
    part = F.pmod(F.xxhash64(identity), F.col("parts")).cast("int")
    others = F.sequence(F.lit(0), F.col("parts") - 1)
    as_home = F.transform(
        others,
        lambda k: F.struct(F.col("part").alias("a"), k.alias("b"), F.when(k == F.col("part"), 2).otherwise(1).alias("role")),
    )
    as_guest = F.transform(others, lambda k: F.struct(k.alias("a"), F.col("part").alias("b"), F.lit(0).alias("role")))
    cells = F.when(
        F.col("home"), F.concat(as_home, F.filter(as_guest, lambda c: c["a"] != F.col("part")))
    ).otherwise(as_guest)
    out = dealt.withColumn("part", part).withColumn("cell", F.explode(cells))
    return out.withColumns(
        {"part_a": F.col("cell.a"), "part_b": F.col("cell.b"), "role": F.col("cell.role").cast("byte")}
    ).drop("cell", "part", "parts")
