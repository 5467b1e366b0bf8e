"""Exact k largest inner products by dual-tree search over cover trees.

Vectors are dealt into blocks around pivots, and each block is indexed by a
cover tree: every node has a centre and a radius that covers its vectors.
Queries are indexed alike. A pair of nodes cannot hold a better product than
<cq, cd> + |cq| rd + |cd| rq + rq rd; it is left out when that is below the
worst k-th score of the node's queries. Each block of queries first meets the
block that promises most, then, with the scores found there, only the blocks
that can still matter, the most promising first.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from plumbline.llm.frames import settle, whole_groups

#: vectors of a data block and of a query block, about; leaves of their trees
DATA_BLOCK, QUERY_BLOCK, DATA_LEAF, QUERY_LEAF = 2048, 512, 256, 64
#: children of a node, at most
CHILDREN = 8
#: pivots, at most; they only decide which vectors share a block
PIVOTS = 1024
#: data blocks that a task runs one query block against
CHUNK = 32
#: whole numbers below this size fit in 64 bits
MOST = 2.0**63
#: scores that the queries of a block have reached already
KNOWN = "array<struct<query_id:long,kth:long>>"
#: relative slack of bounds, against rounding
SLACK = 1e-9


def whole_numbers(values: np.ndarray, scale: float) -> np.ndarray:
    whole = np.floor(values.astype(np.float64) * scale)
    if (np.abs(whole) >= MOST).any():
        raise OverflowError(f"a component times {scale} needs more than 64 bits")
    return whole


def packed(x: np.ndarray, least: int = 4) -> np.ndarray:
    """The same whole numbers in as few bytes each as all of them need: 2, 4 or 8, but not below ``least``."""
    top = float(np.abs(x).max(initial=0))
    return x.astype(f"<i{max(least, 2 if top < 1 << 15 else 4 if top < 1 << 31 else 8)}")


def unpacked(rows: list[bytes], dim: int) -> np.ndarray:
    """Whole numbers of packed vectors, which may differ in width."""
    if len({len(r) for r in rows}) == 1:
        return np.frombuffer(b"".join(rows), f"<i{len(rows[0]) // dim}").reshape(-1, dim)
    return np.stack([np.frombuffer(r, f"<i{len(r) // dim}").astype("<i8") for r in rows])


def vectors_of(column: pa.Array) -> tuple[np.ndarray, list[tuple[np.ndarray, np.ndarray]]]:
    """Rows that hold a vector of finite numbers, by length: (rows, matrix) of each length."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    lengths = column.value_lengths().to_numpy(zero_copy_only=False)
    out = []
    for n in sorted({int(x) for x in lengths if x == x and x > 0}):
        rows = np.flatnonzero(lengths == n)
        flat = column.take(pa.array(rows)).flatten().to_numpy(zero_copy_only=False)
        matrix = flat.astype(np.float64).reshape(-1, n)
        good = np.isfinite(matrix).all(1)
        out.append((rows[good], matrix[good]))
    return lengths, out


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner products of whole numbers, exactly; one beyond 64 bits raises OverflowError."""
    top = float(np.abs(a).max(initial=0)) * float(np.abs(b).max(initial=0)) * a.shape[1]
    if top < 2**53:
        return (a @ b.T).astype(np.int64)
    a, b = a.astype(np.int64), b.astype(np.int64)
    if top < 2**62:
        return a @ b.T
    exact = a.astype(object) @ b.astype(object).T
    if not all(-(2**63) <= v < 2**63 for v in exact.ravel()):
        raise OverflowError("an inner product needs more than 64 bits")
    return exact.astype(np.int64)


def cover_tree(x: np.ndarray, leaf: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Order of the vectors, and nodes: rows (low, high, first child, number of children) and (centre, radius).

    A node's children are centres taken farthest first until they halve its
    radius (or there are ``CHILDREN``); each vector goes to the nearest.
    """
    order = np.arange(len(x))
    spans: list[list[int]] = [[0, len(x), 0, 0]]
    middles: list[np.ndarray] = []
    radii: list[float] = []
    at = 0
    while at < len(spans):
        low, high = spans[at][:2]
        own = order[low:high]
        points = x[own]
        centre = points.mean(0)
        far = np.sqrt(((points - centre) ** 2).sum(1))
        middles.append(centre)
        radii.append(float(far.max()) * (1 + SLACK) + SLACK)
        if high - low > leaf and far.max() > 0:
            nearest = np.sqrt(((points - points[far.argmax()]) ** 2).sum(1))
            label = np.zeros(len(own), np.int64)
            count = 1
            while count < CHILDREN and nearest.max() > radii[at] / 2:
                d = np.sqrt(((points - points[nearest.argmax()]) ** 2).sum(1))
                closer = d < nearest
                label[closer], nearest[closer] = count, d[closer]
                count += 1
            if count == 1:
                label[len(own) // 2 :] = 1
            sizes = np.bincount(label)
            order[low:high] = own[np.argsort(label, kind="stable")]
            spans[at][2:] = [len(spans), int((sizes > 0).sum())]
            for n in sizes[sizes > 0]:
                spans.append([low, low + int(n), 0, 0])
                low += int(n)
        at += 1
    return order, np.array(spans, np.int32), np.column_stack([np.array(middles), radii])


class Block:
    """Vectors of a block in tree order, with the tree."""

    def __init__(self, ids: bytes, vectors: bytes, spans: bytes, balls: bytes, dim: int):
        self.ids = np.frombuffer(ids, "<i8")
        self.x = np.frombuffer(vectors, f"<i{len(vectors) // max(1, len(self.ids) * dim)}").reshape(-1, dim).astype(np.float64)
        self.spans = np.frombuffer(spans, "<i4").reshape(-1, 4)
        balls = np.frombuffer(balls, "<f8").reshape(-1, dim + 1)
        self.centres, self.radii = balls[:, :-1], balls[:, -1]
        self.norms = np.sqrt((self.centres**2).sum(1))


class Best:
    """The k best of each query so far: score descending, then id."""

    def __init__(self, queries: np.ndarray, k: int):
        self.queries, self.k = queries, k
        self.score = [np.empty(0, np.int64)] * len(queries)
        self.ids = [np.empty(0, np.int64)] * len(queries)
        self.worst = np.full(len(queries), -np.inf)

    def offer(self, low: int, ids: np.ndarray, scores: np.ndarray) -> None:
        """Scores of queries low, low + 1, ... with the candidates."""
        for i in np.flatnonzero((scores >= self.worst[low : low + len(scores), None]).any(1)):
            q = low + int(i)
            new = (scores[i] >= self.worst[q]) & (ids != self.queries[q])
            s, d = np.concatenate([self.score[q], scores[i][new]]), np.concatenate([self.ids[q], ids[new]])
            first = np.lexsort((d, -s))[: self.k]
            self.score[q], self.ids[q] = s[first], d[first]
            if len(first) == self.k:
                self.worst[q] = max(self.worst[q], s[first[-1]])

    def rows(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        n = [len(s) for s in self.score]
        return np.repeat(self.queries, n), np.concatenate(self.ids), np.concatenate(self.score)


def search(q: Block, d: Block, best: Best) -> None:
    """Dual-tree search of a data block for a query block."""

    def bounds(i: int, js: np.ndarray) -> np.ndarray:
        top = d.centres[js] @ q.centres[i] + q.norms[i] * d.radii[js] + d.norms[js] * q.radii[i] + q.radii[i] * d.radii[js]
        return top + SLACK * ((q.norms[i] + q.radii[i]) * (d.norms[js] + d.radii[js]) + 1)

    stack = [(float(bounds(0, np.array([0]))[0]), 0, 0)]
    while stack:
        top, i, j = stack.pop()
        low, high, child, count = q.spans[i]
        if top < best.worst[low:high].min():
            continue
        d_low, d_high, d_child, d_count = d.spans[j]
        if not count and not d_count:
            best.offer(low, d.ids[d_low:d_high], products(q.x[low:high], d.x[d_low:d_high]))
            continue
        pairs = []
        if d_count and (not count or d.radii[j] >= q.radii[i]):
            js = np.arange(d_child, d_child + d_count)
            pairs = [(float(b), i, int(c)) for b, c in zip(bounds(i, js), js)]
        else:
            pairs = [(float(bounds(c, np.array([j]))[0]), c, j) for c in range(child, child + count)]
        # the most promising pair comes off the stack first
        stack += sorted(pairs)


def placed(df: DataFrame, vector: str, vec_id: str, pivots: dict[int, np.ndarray], scale: float) -> DataFrame:
    """(dim, pivot, vec_id, x): usable vectors as packed whole numbers, with their nearest pivot."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            for rows, matrix in vectors_of(batch.column(1))[1]:
                if not len(rows):
                    continue
                x = whole_numbers(matrix, scale)
                own = pivots.get(x.shape[1])
                far = np.zeros((len(x), 1)) if own is None else (own**2).sum(1) - 2 * (x @ own.T)
                vectors = [r.tobytes() for r in packed(x)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(x), x.shape[1], np.int32)), pa.array(far.argmin(1).astype(np.int32)), pa.array(ids[rows].astype(np.int64)), pa.array(vectors, pa.binary())],
                    names=["dim", "pivot", "vec_id", "x"],
                )

    rows = df.select(df[f"`{vec_id}`"].cast("long").alias("vec_id"), df[f"`{vector}`"].alias("vector")).where("vec_id is not null and vector is not null")
    return rows.mapInArrow(run, "dim int, pivot int, vec_id long, x binary")


def trees(rows: DataFrame, block: int, leaf: int) -> DataFrame:
    """One row per block: its vectors, its tree, its centre and radius."""
    sizes = settle(rows.groupBy("dim", "pivot").agg(F.ceil(F.count(F.lit(1)) / block).cast("int").alias("parts")))
    # at most PIVOTS rows for each length of vectors
    dealt = rows.join(F.broadcast(sizes), ["dim", "pivot"]).withColumn("part", F.pmod(F.xxhash64("vec_id", "x"), "parts").cast("int"))

    def build(group: pa.Table) -> pa.Table:
        dim = group.column("dim")[0].as_py()
        ids = group.column("vec_id").to_numpy()
        x = unpacked(group.column("x").to_pylist(), dim)
        order, spans, balls = cover_tree(x.astype(np.float64), leaf)
        return pa.table(
            {
                "dim": group.column("dim")[:1],
                "block": pa.array([f"{group.column('pivot')[0].as_py()}/{group.column('part')[0].as_py()}"]),
                "ids": pa.array([ids[order].astype("<i8").tobytes()], pa.binary()),
                "vectors": pa.array([packed(x[order], 2).tobytes()], pa.binary()),
                "spans": pa.array([spans.astype("<i4").tobytes()], pa.binary()),
                "balls": pa.array([balls.astype("<f8").tobytes()], pa.binary()),
                "centre": pa.array([balls[0, :-1].tolist()], pa.list_(pa.float64())),
                "radius": pa.array([float(balls[0, -1])]),
                "size": pa.array([len(x)], pa.int64()),
            }
        )

    return settle(
        whole_groups(
            dealt.select("dim", "pivot", "part", "vec_id", "x"), ["dim", "pivot", "part"], build,
            "dim int, block string, ids binary, vectors binary, spans binary, balls binary, centre array<double>, radius double, size long",
        )
    )


def run_pairs(pairs: DataFrame, queries: DataFrame, data: DataFrame, k: int) -> DataFrame:
    """Search the listed pairs of blocks, (dim, query_block, data_block, top, chunk, known k-th scores)."""
    parts = ["ids", "vectors", "spans", "balls"]
    q = queries.select("dim", F.col("block").alias("query_block"), *[F.col(c).alias(f"q_{c}") for c in parts])
    d = data.select("dim", F.col("block").alias("data_block"), *[F.col(c).alias(f"d_{c}") for c in parts])
    whole = pairs.join(d, ["dim", "data_block"]).join(q, ["dim", "query_block"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, block, best = None, None, None

        def out():
            columns = [pa.array(c, pa.int64()) for c in best.rows()]
            dim, name = (pa.array([v] * len(columns[0]), t) for v, t in zip(key, (pa.int32(), pa.string())))
            return pa.RecordBatch.from_arrays([dim, name, *columns], names=["dim", "query_block", "query_id", "vec_id", "score"])

        for batch in batches:
            for i in range(batch.num_rows):
                row = {n: batch.column(n)[i].as_py() for n in ("dim", "query_block", "chunk")}
                if tuple(row.values()) != key:
                    if best is not None:
                        yield out()
                    key = tuple(row.values())
                    block = Block(*[batch.column(f"q_{c}")[i].as_py() for c in parts], row["dim"])
                    best = Best(block.ids, k)
                    kth = {e["query_id"]: e["kth"] for e in batch.column("known")[i].as_py() or []}
                    best.worst = np.array([float(kth.get(int(x), -np.inf)) for x in block.ids])
                search(block, Block(*[batch.column(f"d_{c}")[i].as_py() for c in parts], row["dim"]), best)
        if best is not None:
            yield out()

    return (
        whole.repartition("dim", "query_block", "chunk")
        .sortWithinPartitions("dim", "query_block", "chunk", F.desc("top"))
        .mapInArrow(run, "dim int, query_block string, query_id long, vec_id long, score long")
    )


def top_products(
    data: DataFrame, queries: DataFrame, k: int, vector: str = "embedding", vec_id: str = "vec_id", scale: float = 64.0
) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: each query's k largest inner products of floor(scale * x).

    Candidates are all rows but those with the query's own id; ties go to the
    smaller id. With fewer candidates all are returned. Vectors that are null,
    empty or hold null or non-finite components, and rows without id, take no
    part; vectors of different lengths are not compared. Scores are exact; a
    component or a score that needs more than 64 bits ends the run with
    OverflowError. Queries that share an id are one query, the smallest
    vector. Blocks have bounded size, also for one vector in a third of all
    rows. Query blocks meet data blocks only if their bound allows.
    """
    total = data.count()
    lengths = [r[0] for r in data.select(F.size(f"`{vector}`").alias("n")).where("n > 0").distinct().collect()]
    first = data.select(F.col(f"`{vec_id}`").alias("vec_id"), F.col(f"`{vector}`").alias("vector")).where("vector is not null")
    pivots = {}
    for n in lengths:
        some = first.where(F.size("vector") == n).orderBy(F.xxhash64("vec_id"), "vec_id").limit(min(PIVOTS, -(-total // (DATA_BLOCK // 2)))).toArrow()
        found = vectors_of(some.column("vector"))[1]
        if found and len(found[0][0]):
            pivots[n] = whole_numbers(found[0][1], scale)
    few = max(1, -(-total // (20 * QUERY_BLOCK // 2)))
    asked = queries.where(F.col(f"`{vec_id}`").isNotNull() & F.col(f"`{vector}`").isNotNull()).groupBy(f"`{vec_id}`").agg(F.min(f"`{vector}`").alias("vector"))
    d_blocks = trees(settle(placed(data, vector, vec_id, pivots, scale)), DATA_BLOCK, DATA_LEAF)
    q_blocks = trees(settle(placed(asked, "vector", vec_id, {n: p[:few] for n, p in pivots.items()}, scale)), QUERY_BLOCK, QUERY_LEAF)

    def ball(df: DataFrame, p: str) -> DataFrame:
        norm = F.sqrt(F.aggregate("centre", F.lit(0.0), lambda a, x: a + x * x))
        return df.select("dim", F.col("block").alias(f"{p}_block"), F.col("centre").alias(f"{p}_centre"), F.col("radius").alias(f"{p}_radius"), norm.alias(f"{p}_norm"), F.col("size").alias(f"{p}_size"))

    dot = F.aggregate(F.zip_with("query_centre", "data_centre", lambda a, b: a * b), F.lit(0.0), lambda a, x: a + x)
    top = dot + F.expr("query_norm * data_radius + data_norm * query_radius + query_radius * data_radius")
    slack = SLACK * F.expr("(query_norm + query_radius) * (data_norm + data_radius)") + 1.0
    pairs = settle(
        ball(q_blocks, "query").join(ball(d_blocks, "data"), "dim").select(
            "dim", "query_block", "data_block", (top + slack).alias("top"), dot.alias("dot"), "data_size"
        )
    )
    promising = Window.partitionBy("dim", "query_block").orderBy((F.col("data_size") <= k), F.desc("dot"), "data_block")
    opening = settle(
        pairs.withColumn("n", F.row_number().over(promising)).where("n = 1").select("dim", "query_block", "data_block", "top")
    )
    keys = ["dim", "query_block"]
    begun = settle(run_pairs(opening.withColumns({"chunk": F.lit(0), "known": F.lit(None).cast(KNOWN)}), q_blocks, d_blocks, k))
    reached = begun.groupBy(*keys, "query_id").agg(F.count(F.lit(1)).alias("n"), F.min("score").alias("kth")).where(F.col("n") == k)
    worst = settle(
        reached.groupBy(*keys).agg(F.min("kth").alias("worst"), F.collect_list(F.struct("query_id", "kth")).alias("known")).join(
            q_blocks.select("dim", F.col("block").alias("query_block"), "size"), keys, "right"
        ).withColumn("worst", F.when(F.size("known") == F.col("size"), F.col("worst")))
    )
    rest = pairs.join(opening.select(*keys, "data_block"), [*keys, "data_block"], "left_anti").join(worst, keys)
    rest = rest.where(F.col("worst").isNull() | (F.col("top") >= F.col("worst")))
    turn = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("top"), "data_block"))
    rest = rest.withColumn("chunk", ((turn - 1) / CHUNK).cast("int")).select(*keys, "data_block", "top", "chunk", "known")
    found = begun.unionByName(settle(run_pairs(rest, q_blocks, d_blocks, k)))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
