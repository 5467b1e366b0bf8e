"""Reachability along directed links; in deep ones chains and cycles are condensed before anything is followed step by step.

A chain (each node the only one behind the one before it) is found by pointer
doubling, so its length costs rounds of its logarithm. Cycles become one part
each: nodes pass the largest name they hear of along the links, and from the
node of that name, back along the links, come the nodes of its cycle. Between
the parts there are no cycles, and the closure over them takes as many rounds
as the longest way between parts. Every round is a join; nothing but row counts
comes to the driver.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame, functions as F

from plumbline.operators.ordered import cut, cut_counted

#: rounds after which the tables of a closure's rounds are joined into one
COMPACT = 8


#: rounds that are tried on the links as they are, before chains and cycles are condensed
SHALLOW = 8


def closure(start: DataFrame, step_from: Callable[[DataFrame], DataFrame], key: list[str]) -> DataFrame:
    """All rows reached from the first ones, each key once: rounds of steps until nothing is new.

    A round is one write; now and then the rounds so far are joined into one
    table, so that a long chain does not read ever more of them.
    """
    return closure_within(start, step_from, key, None)


def closure_within(start: DataFrame, step_from: Callable[[DataFrame], DataFrame], key: list[str], most: int | None) -> DataFrame | None:
    """``closure``, or None if ``most`` rounds do not end it."""
    rounds, step, done = [], start, 0
    while True:
        if rounds:
            step = step.join(reduce(DataFrame.unionByName, rounds).select(*key), key, "left_anti")
        new, n = cut_counted(step)
        if not n:
            return reduce(DataFrame.unionByName, rounds) if rounds else new
        if done == most:
            return None
        rounds.append(new)
        done += 1
        if len(rounds) > COMPACT:
            rounds = [cut(reduce(DataFrame.unionByName, rounds))]
        step = step_from(new)


def shallow_pairs(links: DataFrame, starts: DataFrame) -> DataFrame | None:
    """(start, node): the nodes reached from each start, if that takes no more than ``SHALLOW`` rounds."""
    links = cut(links.select("a", "b").where("a is not null and b is not null").distinct())

    def below(rows: DataFrame) -> DataFrame:
        return rows.withColumnRenamed("node", "a").join(links, "a").select("start", F.col("b").alias("node")).distinct()

    first = starts.select(F.col("node").alias("start"), F.col("node")).distinct()
    return closure_within(below(first), below, ["start", "node"], SHALLOW)


def chains(links: DataFrame) -> DataFrame:
    """(node, chain, place, ring) of the nodes of links (a, b), a <> b: the first node of the chain, and the steps from there.

    A ring without any way in or out has no first node: all its nodes get the
    smallest name, place 0, and ``ring``. Nodes in no chain are chains of one.
    """
    single = [links.groupBy(c).agg(F.count(F.lit(1)).alias("n")).where("n = 1").select(c) for c in ("a", "b")]
    inner = links.join(single[0], "a", "left_semi").join(single[1], "b", "left_semi")
    state = cut(inner.select(F.col("b").alias("node"), F.col("a").alias("ahead"), F.lit(1).cast("long").alias("place"), F.least("a", "b").alias("low")))
    size, reach = state.count(), 1
    while reach <= size:
        further = state.select(F.col("node").alias("ahead"), F.col("ahead").alias("_ahead"), F.col("place").alias("_place"), F.col("low").alias("_low"))
        both = state.join(further, "ahead", "left")
        known = F.col("_ahead").isNotNull()
        moved = cut(
            both.select(
                "node", F.coalesce("_ahead", "ahead").alias("ahead"), (F.col("place") + F.coalesce("_place", F.lit(0))).alias("place"),
                F.least("low", "_low").alias("low"), known.alias("moved"),
            )
        )
        state, reach = moved.drop("moved"), 2 * reach
        if moved.where("moved").isEmpty():
            break
    # only in a ring does every node still have one ahead that itself is behind another
    ring = state.join(state.select(F.col("node").alias("ahead")), "ahead", "left_semi").select("node", F.lit(True).alias("ring"))
    placed = state.join(ring, "node", "left").select(
        "node", F.when(F.col("ring"), F.col("low")).otherwise(F.col("ahead")).alias("chain"), F.when(F.col("ring"), 0).otherwise(F.col("place")).alias("place"),
        F.coalesce("ring", F.lit(False)).alias("ring"),
    )
    nodes = links.select(F.col("a").alias("node")).unionByName(links.select(F.col("b").alias("node"))).distinct()
    alone = nodes.join(placed, "node", "left_anti").select("node", F.col("node").alias("chain"), F.lit(0).cast("long").alias("place"), F.lit(False).alias("ring"))
    return cut(placed.unionByName(alone))


def core(links: DataFrame) -> DataFrame:
    """The links left when those from nodes without a way in, or to nodes without a way out, are taken away again and again."""
    links, n = cut(links), -1
    while (now := links.count()) not in (n, 0):
        n = now
        links = cut(links.join(links.select(F.col("b").alias("a")).distinct(), "a", "left_semi").join(links.select(F.col("a").alias("b")).distinct(), "b", "left_semi"))
    return links


def cycles(links: DataFrame) -> DataFrame | None:
    """(node, root) of the nodes on cycles of links (a, b), a <> b; None without any. Root is the largest name among mutually reachable nodes."""
    found = None
    links = core(links)
    while not links.isEmpty():
        nodes = links.select(F.col("a").alias("node")).unionByName(links.select(F.col("b").alias("node"))).distinct()
        colour = cut(nodes.withColumn("colour", F.col("node")))
        while True:
            heard = links.join(colour, F.col("a") == F.col("node")).groupBy("b").agg(F.max("colour").alias("heard"))
            new = colour.join(heard, F.col("node") == F.col("b"), "left")
            new = cut(new.select("node", F.greatest("colour", "heard").alias("colour"), (F.col("heard") > F.col("colour")).alias("changed")))
            colour = new.drop("changed")
            if new.where("changed").isEmpty():
                break
        ends = [colour.select(F.col("node").alias(c), F.col("colour").alias(f"colour_{c}")) for c in ("a", "b")]
        same = cut(links.join(ends[0], "a").join(ends[1], "b").where("colour_a = colour_b").select("a", "b", F.col("colour_a").alias("root")))

        roots = same.where("b = root").select(F.col("b").alias("node"), "root").distinct()
        mine = cut(closure(roots, lambda rows: back(rows, same), ["node"]))
        found = mine if found is None else found.unionByName(mine)
        done = mine.select("node")
        rest = same.select("a", "b").join(done.withColumnRenamed("node", "a"), "a", "left_anti").join(done.withColumnRenamed("node", "b"), "b", "left_anti")
        links = core(rest)
    if found is None:
        return None
    # a root that nothing leads back to is no cycle
    several = found.groupBy("root").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("root")
    return found.join(several, "root", "left_semi").select("node", "root")


def back(rows: DataFrame, links: DataFrame) -> DataFrame:
    """One step against the links (a, b, root) of the same root."""
    return rows.withColumnRenamed("node", "b").join(links, ["b", "root"]).select(F.col("a").alias("node"), "root").distinct()


@dataclass
class Condensed:
    """``members`` (node, part, place, cyclic, loop) and ``links`` (a, b) between parts, which hold no cycle.

    In a cyclic part every node reaches every node; in others a node reaches
    those at later places, and itself only if ``loop`` says so.
    """

    members: DataFrame
    links: DataFrame


def condense(links: DataFrame) -> Condensed:
    """Parts of directed links (a, b); rows with a null end are no links."""
    whole = cut(links.select("a", "b").where("a is not null and b is not null").distinct())
    loops = whole.where("a = b").select(F.col("a").alias("node"), F.lit(True).alias("loop"))
    plain = whole.where("a <> b")
    placed = chains(plain)
    ends = [placed.select(F.col("node").alias(c), F.col("chain").alias(f"chain_{c}"), F.col("place").alias(f"place_{c}")) for c in ("a", "b")]
    between = plain.join(ends[0], "a").join(ends[1], "b")
    between = cut(between.where("not (chain_a = chain_b and place_b = place_a + 1)").select(F.col("chain_a").alias("a"), F.col("chain_b").alias("b")).distinct())
    # the only other link inside a chain leads from its end to its beginning
    closed = between.where("a = b").select(F.col("a").alias("chain")).unionByName(placed.where("ring").select("chain")).distinct()
    on_cycle = cycles(between.where("a <> b"))
    part = closed.withColumn("root", F.col("chain"))
    if on_cycle is not None:
        own = on_cycle.select(F.col("node").alias("chain"), "root")
        part = part.join(own.select("chain"), "chain", "left_anti").unionByName(own)
    lone = loops.select("node").join(placed.select("node"), "node", "left_anti")
    every = placed.select("node", "chain", "place").unionByName(lone.select("node", F.col("node").alias("chain"), F.lit(0).cast("long").alias("place")))
    cyclic = F.col("root").isNotNull()
    members = cut(
        every.join(part, "chain", "left").join(loops, "node", "left").select(
            "node", F.coalesce("root", "chain").alias("part"), F.when(cyclic, 0).otherwise(F.col("place")).alias("place"), cyclic.alias("cyclic"),
            F.coalesce("loop", F.lit(False)).alias("loop"),
        )
    )
    names = [part.select(F.col("chain").alias(c), F.col("root").alias(f"root_{c}")) for c in ("a", "b")]
    parts = between.join(names[0], "a", "left").join(names[1], "b", "left").select(F.coalesce("root_a", "a").alias("a"), F.coalesce("root_b", "b").alias("b"))
    return Condensed(members, cut(parts.where("a <> b").distinct()))


def reached_parts(whole: Condensed, starts: DataFrame) -> DataFrame:
    """(start, part): the other parts reached from each part (start), each once."""

    def below(rows: DataFrame) -> DataFrame:
        return rows.withColumnRenamed("part", "a").join(whole.links, "a").select("start", F.col("b").alias("part")).distinct()

    return closure(below(starts.select("start", F.col("start").alias("part")).distinct()), below, ["start", "part"])


def reach_counts(links: DataFrame, starts: DataFrame) -> DataFrame:
    """(node, reached): how many nodes each start (node) reaches over one link or more, itself included if it does.

    Starts without a link reach none. Of deep links no pair is listed: parts are
    counted by their sizes.
    """
    pairs = shallow_pairs(links, starts)
    if pairs is not None:
        counts = pairs.groupBy(F.col("start").alias("node")).agg(F.count(F.lit(1)).alias("reached"))
        return starts.select("node").distinct().join(counts, "node", "left").na.fill(0, ["reached"])
    whole = condense(links)
    sizes = whole.members.groupBy("part").agg(F.count(F.lit(1)).alias("size"))
    own = starts.select("node").distinct().join(whole.members, "node", "left").join(sizes, "part", "left")
    beyond = reached_parts(whole, own.where("part is not null").select(F.col("part").alias("start")))
    totals = beyond.join(sizes, "part").groupBy(F.col("start").alias("part")).agg(F.sum("size").alias("beyond"))
    inside = F.when(F.col("cyclic"), F.col("size")).otherwise(F.col("size") - 1 - F.col("place") + F.col("loop").cast("long"))
    return own.join(totals, "part", "left").select("node", (F.coalesce(inside, F.lit(0)) + F.coalesce("beyond", F.lit(0))).alias("reached"))


def reach_pairs(links: DataFrame, starts: DataFrame) -> DataFrame:
    """(start, node): every node that each start (node) reaches over one link or more, once."""
    pairs = shallow_pairs(links, starts)
    if pairs is not None:
        return pairs
    whole = condense(links)
    own = cut(starts.select("node").distinct().join(whole.members, "node").select(F.col("node").alias("start"), F.col("part").alias("own"), F.col("place").alias("from"), F.col("cyclic"), F.col("loop")))
    beyond = reached_parts(whole, own.select(F.col("own").alias("start"))).withColumnRenamed("start", "own")
    outside = own.join(beyond, "own").join(whole.members.select("part", "node"), "part").select("start", "node")
    same = own.join(whole.members.select(F.col("part").alias("own"), "node", "place"), "own")
    inside = same.where(F.col("cyclic") | (F.col("place") > F.col("from")) | ((F.col("start") == F.col("node")) & F.col("loop"))).select("start", "node")
    return outside.unionByName(inside)
