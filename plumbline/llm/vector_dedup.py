"""Near duplicates among embeddings by a subspace pigeonhole join.

Unit vectors whose cosine reaches the threshold are close: their squared
distance is within 2 - 2 * threshold. After a fixed rotation, which spreads the
distance evenly, the components are cut into blocks. In at least one block the
squared distance is within the block's share of that budget. Each block is a
range join: a vector is at home at the nearest of some pivots, at distance d,
and visits the pivots within d plus the block's radius, so that of two vectors
in range the one nearer to its pivot is at home where the other visits. All
candidates are then checked by their cosine.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from plumbline.llm.frames import components, settle, spanning_edges, whole_groups, with_splits
from plumbline.llm.topk import vectors_of

THRESHOLD = 0.98
#: blocks of the rotated components
BLOCKS = 4
#: pivots of a block: a quarter of the root of the number of vectors, within these limits; they do not change the result
FEWEST_PIVOTS, MOST_PIVOTS = 8, 1024
#: rows of a pivot beyond which its work is split over a grid of tasks
PIVOT_ROWS = 1024
#: pairs checked at once, and homes compared at once
PAIRS, HOMES = 40_000, 128
SLACK = 1e-9
SEED = 42


@lru_cache(maxsize=8)
def rotation(dim: int) -> np.ndarray:
    """A fixed orthogonal matrix, drawn evenly from all."""
    q, r = np.linalg.qr(np.random.default_rng(SEED + dim).normal(size=(dim, dim)))
    return q * np.sign(np.diag(r))


def block_ends(dim: int, blocks: int = BLOCKS) -> list[int]:
    n = min(blocks, dim)
    return [dim * (k + 1) // n for k in range(n)]


def rotated_units(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rotated unit vectors and norms. Each row is worked out alike wherever it is met: no matrix product, whose sums depend on the shape."""
    dim = x.shape[1]
    turn = rotation(dim)
    norms = np.zeros(len(x))
    out = np.zeros_like(x)
    for k in range(dim):
        norms += x[:, k] * x[:, k]
        out += x[:, k : k + 1] * turn[k]
    norms = np.sqrt(norms)
    return out / norms[:, None], norms


def homes_and_visits(units: np.ndarray, pivots: np.ndarray, budget: float) -> tuple[np.ndarray, ...]:
    """(block, row, pivot, home, distance) of all vectors; ``pivots`` are rotated unit vectors."""
    dim, start, out = units.shape[1], 0, []
    for b, end in enumerate(block_ends(dim)):
        own, mark = units[:, start:end], pivots[:, start:end]
        radius = math.sqrt(budget * (end - start) / dim)
        far = np.sqrt(np.maximum(0, (own**2).sum(1)[:, None] + (mark**2).sum(1) - 2 * own @ mark.T))
        home = far.argmin(1)
        least = far[np.arange(len(own)), home]
        row, pivot = np.nonzero(far <= (least + radius * (1 + SLACK) + 1e-7)[:, None])
        out.append((np.full(len(row), b), row, pivot, pivot == home[row], least[row]))
        start = end
    return tuple(map(np.concatenate, zip(*out)))


def linked_pairs(x: np.ndarray, role: np.ndarray, node: np.ndarray, near: np.ndarray, block: int, threshold: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Links of one block that no earlier block has: pairs of rows, the home first."""
    units, norms = rotated_units(x)
    dim, budget = x.shape[1], 2 - 2 * threshold
    ends = block_ends(dim)
    starts = [0, *ends[:-1]]
    own = units[:, starts[block] : ends[block]]
    squares = (own**2).sum(1)
    homes, rest = np.flatnonzero(role > 0), np.flatnonzero(role != 1)
    for lo in range(0, len(homes), HOMES):
        h = homes[lo : lo + HOMES]
        close = squares[h][:, None] + squares[rest] - 2 * own[h] @ own[rest].T <= budget * (ends[block] - starts[block]) / dim * (1 + SLACK) + 1e-7
        # the home of a pair is the one nearer to its pivot
        first = (near[h][:, None] < near[rest]) | ((near[h][:, None] == near[rest]) & (node[h][:, None] < node[rest]))
        a, b = np.nonzero(close & first)
        a, b = h[a], rest[b]
        for at in range(0, len(a), PAIRS):
            i, j = a[at : at + PAIRS], b[at : at + PAIRS]
            linked = np.einsum("ij,ij->i", x[i], x[j]) / (norms[i] * norms[j]) >= threshold
            i, j = i[linked], j[linked]
            if not len(i):
                continue
            gaps = (units[i] - units[j]) ** 2
            held = [gaps[:, s:e].sum(1) <= budget * (e - s) / dim * (1 + SLACK) + 1e-9 for s, e in zip(starts[: block + 1], ends)]
            fresh = held[block] & ~np.any(held[:block], axis=0) if block else held[0]
            yield i[fresh], j[fresh]


def near_vectors(
    df: DataFrame, threshold: float = THRESHOLD, vector: str = "embedding", vec_id: str = "vec_id", label: str | None = "label"
) -> DataFrame:
    """vec_id, n_links, component_id and kept, one row per input row.

    Rows are compared when their labels are equal and not null (all rows, if
    ``label`` is None). Null, empty and zero vectors and those with null or
    non-finite components link with nothing; vectors of different lengths do
    not link. ``n_links`` counts the other rows with a cosine of at least
    ``threshold``; ``component_id`` is the smallest id reachable over links.
    Equal vectors of a label are merged in every task first and counted by
    their number, so a mass of copies is one row.
    """
    given = df.select(
        df[f"`{vec_id}`"].cast("long").alias("vec_id"), (F.lit("") if label is None else df[f"`{label}`"].cast("string")).alias("label"), df[f"`{vector}`"].alias("vector")
    )

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            dim, packed = np.zeros(batch.num_rows, np.int32), [None] * batch.num_rows
            for rows, matrix in vectors_of(batch.column(2))[1]:
                # vectors whose squares leave the range of doubles are scaled, which changes no cosine
                top = np.abs(matrix).max(1, initial=0)
                odd = (top > 1e100) | ((top < 1e-100) & (top > 0))
                matrix[odd] /= top[odd, None]
                for r, v, good in zip(rows, matrix, top > 0):
                    if good:
                        single = v.astype(np.float32)
                        dim[r], packed[r] = len(v), (single if (single == v).all() else v).tobytes()
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(dim), pa.array(packed, pa.binary())], names=["vec_id", "label", "dim", "x"])

    rows = settle(given.mapInArrow(pack, "vec_id long, label string, dim int, x binary"))
    usable = rows.where("label is not null and x is not null")
    classes = settle(
        usable.groupBy("label", "dim", "x").agg(F.min("vec_id").alias("first_id"), F.count(F.lit(1)).alias("copies")).withColumn("node", F.monotonically_increasing_id())
    )
    total = classes.count()
    number = min(MOST_PIVOTS, max(FEWEST_PIVOTS, int(math.sqrt(total) / 4)))
    pivots = {}
    for (dim,) in classes.select("dim").distinct().collect():
        some = classes.where(F.col("dim") == dim).orderBy(F.xxhash64("x"), "label").limit(number).select("x").collect()
        pivots[dim] = rotated_units(unpack([bytes(r.x) for r in some], dim))[0]
    budget = 2 - 2 * threshold

    def replicate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            dims = batch.column("dim").to_numpy()
            for dim in np.unique(dims):
                of_dim = np.flatnonzero(dims == dim)
                for lo in range(0, len(of_dim), 2000):
                    some = batch.take(pa.array(of_dim[lo : lo + 2000]))
                    units, _ = rotated_units(unpack(some.column("x").to_pylist(), int(dim)))
                    block, row, pivot, home, near = homes_and_visits(units, pivots[int(dim)], budget)
                    again = some.take(pa.array(row))
                    yield pa.RecordBatch.from_arrays(
                        [again.column("label"), again.column("dim"), pa.array(block.astype(np.int32)), pa.array(pivot.astype(np.int32)), again.column("node"), again.column("copies"), again.column("x"), pa.array(home), pa.array(near)],
                        names=["label", "dim", "block", "pivot", "node", "copies", "x", "home", "near"],
                    )

    schema = "label string, dim int, block int, pivot int, node long, copies long, x binary, home boolean, near double"
    at_pivots = classes.select("label", "dim", "node", "copies", "x").mapInArrow(replicate, schema)
    cell = ["label", "dim", "block", "pivot"]

    def compare(group: pa.Table) -> pa.Table | None:
        dim, block = group.column("dim")[0].as_py(), group.column("block")[0].as_py()
        node, copies = group.column("node").to_numpy(), group.column("copies").to_numpy()
        x = unpack(group.column("x").to_pylist(), dim)
        links = np.zeros(len(node), np.int64)
        edges = (np.empty(0, np.int64), np.empty(0, np.int64))
        for i, j in linked_pairs(x, group.column("role").to_numpy(), node, group.column("near").to_numpy(), block, threshold):
            np.add.at(links, i, copies[j])
            np.add.at(links, j, copies[i])
            edges = spanning_edges(np.concatenate([edges[0], node[i]]), np.concatenate([edges[1], node[j]]))
        some = np.flatnonzero(links)
        return pa.table(
            {
                "node": np.concatenate([node[some], edges[0]]),
                "other": pa.array(np.concatenate([np.zeros(len(some), np.int64), edges[1]]), mask=np.arange(len(some) + len(edges[0])) < len(some)),
                "links": np.concatenate([links[some], np.zeros(len(edges[0]), np.int64)]),
            }
        )

    blocks = with_splits(at_pivots, cell, F.col("node"), PIVOT_ROWS)
    found = settle(
        whole_groups(
            blocks.select(*cell, "part_a", "part_b", "node", "copies", "x", "near", "role"), [*cell, "part_a", "part_b"], compare, "node long, other long, links long"
        )
    )
    counts = settle(found.groupBy("node").agg(F.sum("links").alias("links")))
    roots = settle(components(found.where("other is not null"), "node", "other"))
    first = classes.select("node", "first_id").join(roots, "node")
    least = settle(first.groupBy("root").agg(F.min("first_id").alias("least_id")))
    reached = settle(roots.join(least, "root").select("node", "least_id"))
    each = settle(
        classes.join(counts, "node", "left").join(reached, "node", "left").select(
            "label", "dim", "x",
            (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"),
            F.coalesce("least_id", "first_id").alias("component_id"),
        )
    )
    out = rows.join(each, ["label", "dim", "x"], "left").select(
        "vec_id", F.coalesce("n_links", F.lit(0)).alias("n_links"), F.when(F.col("n_links").isNull(), F.col("vec_id")).otherwise(F.col("component_id")).alias("component_id")
    )
    return out.withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))


def unpack(packed: list[bytes], dim: int) -> np.ndarray:
    """Vectors of single or double precision, as doubles."""
    if all(len(p) == 4 * dim for p in packed):
        return np.frombuffer(b"".join(packed), "<f4").reshape(-1, dim).astype(np.float64)
    return np.stack([np.frombuffer(p, "<f4" if len(p) == 4 * dim else "<f8").astype(np.float64) for p in packed])
