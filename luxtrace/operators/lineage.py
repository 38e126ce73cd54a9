"""Closure of a parent relation, and the connected parts of any relation."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from luxtrace.shared import cut, drop


def roots(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """``node, root, depth`` for ``nodes`` (``node``) and ``edges`` (``node, parent``, at most one parent each, no cycle).

    Every round follows each pointer's own pointer, so a chain of n takes log2(n) rounds. A round is written to the shared
    folder, so plans don't grow; nodes that point at a root are done and leave the rounds.
    """
    up = F.coalesce("parent", "node").alias("up")
    at = cut(nodes.join(edges, "node", "left").select("node", up, F.col("parent").isNotNull().cast("long").alias("depth")))
    done, left, pointers = [at.where("depth = 0")], at.where("depth > 0"), at
    while not left.isEmpty():
        further = pointers.select(F.col("node").alias("__n"), F.col("up").alias("__up"), F.col("depth").alias("__d"))
        moved = cut(left.join(further, F.col("up") == F.col("__n")).select("node", F.col("__up").alias("up"), (F.col("depth") + F.col("__d")).alias("depth"), (F.col("__d") == 0).alias("__done")))
        pointers = reduce(DataFrame.unionByName, done, moved.drop("__done"))
        done.append(moved.where("__done").drop("__done"))
        left = moved.where("NOT __done").drop("__done")
    return reduce(DataFrame.unionByName, done).select("node", F.col("up").alias("root"), "depth")


def connected_parts(edges: DataFrame) -> DataFrame:
    """``node, part``: of each node in ``edges`` (``a, b``) the least node that it is connected with.

    Large stars and small stars in turn: every node hands its larger neighbours, then its smaller ones, to the least node it
    knows. The number of rounds grows with the logarithm of the longest chain. Minima are added up before they are shuffled
    and handed out by joins that can be split, so a node with very many neighbours is shared out; each round is written.
    """
    fold = lambda df: df.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
    now = cut(edges.where("a IS NOT NULL AND b IS NOT NULL").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    loops = now.where("a = b").select(F.col("a").alias("node"), F.col("a").alias("part"))
    now, before, old = now.where("a != b"), None, []
    while (state := fold(now)) != before:
        before = state
        both = now.union(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy(F.col("a").alias("n")).agg(F.least(F.min("b"), F.min("a")).alias("m"))
        large = both.where("b > a").join(least, F.col("a") == F.col("n")).select(F.col("b").alias("a"), F.col("m").alias("b")).union(least.where("m < n").select("n", "m"))
        large = cut(large.where("a != b").distinct())
        down = large.groupBy(F.col("a").alias("n")).agg(F.min("b").alias("m"))
        small = large.join(down, F.col("a") == F.col("n")).select(F.col("b").alias("a"), F.col("m").alias("b")).union(down.select("n", "m"))
        now = cut(small.where("a != b").distinct())
        drop(large, *old)
        old = [now]
    found = now.select(F.col("a").alias("node"), F.col("b").alias("part")).union(now.select(F.col("b").alias("node"), F.col("b").alias("part"))).union(loops)
    return found.groupBy("node").agg(F.min("part").alias("part"))
