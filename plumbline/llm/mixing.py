"""Mixing sources to target weights by balanced sampling with the cube method.

A source's rate is its target over its size. Every document is taken as often
as the rate's whole part, and once more with the rest as its probability. The
extra copies are drawn by the cube method: in a block of documents, the vector
of probabilities moves along directions that leave the expected numbers of
words and of documents as they are, until at most two documents of the block
are undecided. The undecided ones of many blocks form the blocks of the next
round. The last few of a source, and some held back for it, are the landing
problem: of all choices, the one nearest to the target is taken.
"""

from __future__ import annotations

import random
import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from plumbline.llm.frames import SMALL_ROWS, row_mark, settle, spare_name, whole_groups

#: weights of the sources in the order of their names, again from the first
WEIGHTS = (3, 1, 2)
#: words of the mix over words of all sources, and of a source at most
SHARE, MOST_REPEATS = 1.5, 2.0
#: documents of a block
BLOCK_ROWS = 2048
#: documents of a source left to the landing, besides the two that a flight leaves
LANDING = 14
SEED = 42


def words_in(text: Column | str) -> Column:
    """Runs of other characters than ASCII blanks; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def targets(sizes: dict[str | None, int], weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, most: float = MOST_REPEATS) -> dict[str | None, float]:
    """Words that each source should give.

    Sources by code point, null last, take the weights in turn and share so
    much of all sizes. A target stops at ``most`` times its source's size; the
    excess is shared again by weight among the others until none is above.
    Sources without words have target zero.
    """
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    out: dict[str | None, float] = {}
    rest = share * sum(sizes.values())
    free = list(order)
    while free:
        total = sum(weight[s] for s in free)
        full = [s for s in free if rest * weight[s] / total > most * sizes[s]]
        if not full:
            return out | {s: rest * weight[s] / total for s in free}
        for s in full:
            out[s] = most * sizes[s]
        free = [s for s in free if s not in full]
        rest -= sum(out[s] for s in full)
    return out


def flight(chance: np.ndarray, size: np.ndarray, draws: random.Random) -> np.ndarray:
    """Move probabilities to 0 or 1, keeping the expected words and documents; at most two stay between.

    Three undecided documents at a time: the direction that changes neither
    total is the cross product of their two constraint rows. Which way to go is
    drawn so that every document keeps its probability.
    """
    p = chance.tolist()
    s = size.tolist()
    waiting = [i for i, x in enumerate(p) if 0 < x < 1]
    active: list[int] = []
    at = 0
    tiny = 1e-9
    while True:
        while len(active) < 3 and at < len(waiting):
            active.append(waiting[at])
            at += 1
        if len(active) < 3:
            # of two of equal size one can still be decided
            if len(active) == 2 and s[active[0]] == s[active[1]]:
                move = [1.0, -1.0]
            else:
                break
        else:
            a, b, c = (s[i] for i in active)
            move = [float(c - b), float(a - c), float(b - a)]
            if not any(move):
                move = [1.0, -1.0, 0.0]
        ahead = min(((1 - p[i]) / m if m > 0 else -p[i] / m) for i, m in zip(active, move) if m)
        behind = min((p[i] / m if m > 0 else (p[i] - 1) / m) for i, m in zip(active, move) if m)
        step = ahead if draws.random() * (ahead + behind) < behind else -behind
        left = []
        for i, m in zip(active, move):
            x = p[i] + step * m
            p[i] = 0.0 if x < tiny else 1.0 if x > 1 - tiny else x
            if 0 < p[i] < 1:
                left.append(i)
        active = left
    return np.array(p)


def landing(chance: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Decide the last few so that their words, then their number, come nearest to what they should give."""
    open_ = np.flatnonzero((chance > 0) & (chance < 1))
    words, docs = np.zeros(1), np.zeros(1)
    for i in open_:
        words, docs = np.concatenate([words, words + size[i]]), np.concatenate([docs, docs + 1])
    off = np.abs(words - (chance * size)[open_].sum())
    best = np.lexsort((np.abs(docs - chance[open_].sum()), off))[0]
    out = chance.copy()
    out[open_] = best >> np.arange(len(open_)) & 1
    return out


def last_flight(chance: np.ndarray, size: np.ndarray, draws: random.Random) -> np.ndarray:
    """Flight of a source's last block, but for a few documents of all sizes that are left to the landing."""
    open_ = np.flatnonzero((chance > 0) & (chance < 1))
    held = open_[np.unique(np.linspace(0, len(open_) - 1, min(LANDING, len(open_))).astype(int))] if len(open_) else open_
    out = chance.copy()
    rest = np.setdiff1d(open_, held)
    out[rest] = flight(chance[rest], size[rest], draws)
    return landing(out, size)


def few(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    """A table of one row per source, sent to every task unless there are very many sources."""
    made = spark.createDataFrame(rows, schema)
    return F.broadcast(made) if len(rows) <= SMALL_ROWS else made


def draw(rows: DataFrame, seed: int = SEED, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Decide the extra copies of rows (key, id, place, size, chance): gives key, id, place and extra, 0 or 1.

    ``key`` numbers the source; (id, place) is unique. Blocks hold rows of one
    source, dealt by a hash, about ``block_rows`` each, so a source with a third
    of all rows is many blocks. The number of rounds follows from the largest
    source; a block passes on two rows at most.
    """
    spark = rows.sparkSession
    names = ["key", "id", "place", "size", "chance"]

    def fly(last: bool):
        def run(group: pa.Table) -> pa.Table:
            group = group.sort_by([("size", "descending"), ("order", "ascending"), ("id", "ascending")])
            size = group.column("size").to_numpy()
            draws = random.Random(f"{seed}/{group.column('order')[0].as_py()}/{len(size)}")
            moved = (last_flight if last else flight)(group.column("chance").to_numpy(), size, draws)
            return group.select(names[:-1]).append_column("chance", pa.array(moved))

        return run

    now, done, level = rows, None, 0
    while True:
        counts = {r["key"]: r["count"] for r in now.groupBy("key").count().collect()}
        if not counts:
            return done if done is not None else now.select("key", "id", "place", F.lit(0).alias("extra"))
        blocks = [(k, max(1, -(-n // block_rows))) for k, n in counts.items()]
        last = max(n for _, n in blocks) == 1
        dealt = (
            now.join(few(spark, blocks, "key int, blocks int"), "key")
            .withColumn("order", F.xxhash64(F.lit(seed), F.lit(level), "place"))
            .withColumn("block", F.pmod("order", F.col("blocks")).cast("int"))
            .select("key", "block", "order", "id", "place", "size", "chance")
        )
        flown = settle(whole_groups(dealt, ["key", "block"], fly(last), "key int, id long, place long, size long, chance double"))
        fixed = flown.where("chance = 0 or chance = 1").select("key", "id", "place", F.col("chance").cast("int").alias("extra"))
        done = fixed if done is None else done.unionByName(fixed)
        now, level = flown.where("chance > 0 and chance < 1"), level + 1


def mix(
    df: DataFrame,
    text: str = "text",
    source: str = "source",
    doc_id: str = "doc_id",
    weights: tuple[float, ...] = WEIGHTS,
    share: float = SHARE,
    most: float = MOST_REPEATS,
    seed: int = SEED,
) -> DataFrame:
    """Row marks and decisions: doc_id, mark, size, source_size, target, copies, taken.

    One row for each different row of the frame; ``mark`` is a hash of all its
    columns and ``rows`` says how often it occurs. ``copies`` is how often these
    equal rows are taken together, ``taken`` the words of that; of n equal rows,
    the whole part of n times the chance is taken once more outright, and only
    the rest is drawn, as one row. A null text has size 0; null is a source of
    its own. The same table gives the same mix, however it is stored. The sizes
    of the sources, one row for each, are brought to the driver.
    """
    spark = df.sparkSession
    units = settle(
        df.select(
            df[f"`{doc_id}`"].cast("long").alias("doc_id"), row_mark(df).alias("mark"), df[f"`{source}`"].cast("string").alias("source"), words_in(df[f"`{text}`"]).alias("size")
        ).groupBy("doc_id", "mark", "source", "size").agg(F.count(F.lit(1)).alias("rows"))
    )
    sizes = {r["source"]: r["size"] for r in units.groupBy("source").agg(F.sum(F.col("size") * F.col("rows")).alias("size")).collect()}
    goal = targets(sizes, weights, share, most)
    listed = []
    for key, (name, target) in enumerate(goal.items()):
        rate = target / sizes[name] if sizes[name] else 0.0
        listed.append((key, name, sizes[name], target, int(rate), rate - int(rate)))
    sources = few(spark, listed, "key int, name string, source_size long, target double, whole int, chance double")
    placed = units.join(sources, units.source.eqNullSafe(sources.name))
    expected = F.col("rows") * F.col("chance")
    placed = placed.withColumn("outright", F.floor(expected)).withColumn("chance", expected - F.floor(expected))
    extra = draw(
        placed.where("chance > 0").select("key", F.col("doc_id").alias("id"), F.col("mark").alias("place"), "size", "chance"), seed
    ).withColumnsRenamed({"id": "extra_id", "place": "extra_mark"}).drop("key")
    both = placed.join(extra, (placed.mark == extra.extra_mark) & placed.doc_id.eqNullSafe(extra.extra_id), "left")
    copies = (F.col("rows") * F.col("whole") + F.col("outright") + F.coalesce("extra", F.lit(0))).cast("long")
    return both.select("doc_id", "mark", "rows", "size", "source_size", "target", copies.alias("copies"), (F.col("size") * copies).alias("taken"))


def by_row(mixed: DataFrame) -> DataFrame:
    """A mix with a line for each row of the table: of equal rows, the first take one copy more than the others where needed."""
    n = F.col("rows")
    each = mixed.withColumn("turn", F.explode(F.sequence(F.lit(1).cast("long"), n)))
    own = F.floor(F.col("copies") / n) + (F.col("turn") <= F.col("copies") % n).cast("long")
    return each.withColumns({"copies": own, "taken": F.col("size") * own}).drop("turn", "rows")


def mixed_rows(df: DataFrame, mixed: DataFrame, doc_id: str = "doc_id") -> DataFrame:
    """The rows of the frame, each as often as the mix takes it; equal rows, of any column types, stand for each other."""
    mark, spare = spare_name(df, "mark"), spare_name(df, "n")
    marked = df.withColumn(mark, row_mark(df))
    wanted = settle(
        mixed.where("copies > 0").select(
            F.col("doc_id").alias(f"{mark}_id"), F.col("mark").alias(f"{mark}_wanted"), F.col("copies").alias(f"{mark}_copies"), F.col("rows").alias(f"{mark}_rows")
        )
    )
    kept = marked.join(wanted, (marked[mark] == wanted[f"{mark}_wanted"]) & marked[doc_id].cast("long").eqNullSafe(wanted[f"{mark}_id"]))
    columns = [F.col(f"`{c}`") for c in df.columns]
    taken = kept.where(F.col(f"{mark}_rows") == 1).select(*columns, F.col(f"{mark}_copies").alias(spare))
    if not wanted.where(F.col(f"{mark}_rows") > 1).isEmpty():
        # one of equal rows stands for all; tasks merge them before the shuffle
        several = (
            kept.where(F.col(f"{mark}_rows") > 1)
            .groupBy(f"{mark}_id", mark)
            .agg(F.any_value(F.struct(*columns)).alias("row"), F.first(f"{mark}_copies").alias(spare))
            .select("row.*", spare)
        )
        taken = taken.unionByName(several)
    again = taken.withColumn(mark, F.explode(F.sequence(F.lit(1).cast("long"), F.col(spare))))
    return again.select(*columns)
