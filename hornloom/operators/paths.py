"""A transitive property whose facts form separate paths: places on the paths stand for the closure, of which no pair is kept."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hornloom.operators.tables import settle

#: Places of a path that one task meets at a time; the others go on in blocks of their own.
BLOCK = 1000


def places(facts: DataFrame, work_dir: str | None = None) -> DataFrame | None:
    """(id, head, place) of every node of the distinct facts (s, o): the path's first node and the steps from it. None if the facts branch, join or go round.

    Every node points at the one before it, then at the one that this points at, until all point at heads: so the rounds grow with the logarithm of the longest path.
    """
    for end in "so":
        if not facts.groupBy(end).count().where("count > 1").isEmpty():
            return None
    heads = facts.select(F.col("s").alias("id")).join(facts.select(F.col("o").alias("id")), "id", "left_anti")
    at = facts.select(F.col("o").alias("id"), F.col("s").alias("head"), F.lit(1).cast("long").alias("place"), F.lit(False).alias("done"))
    at = settle(at.unionByName(heads.select("id", F.col("id").alias("head"), F.lit(0).cast("long").alias("place"), F.lit(True).alias("done"))), "places", work_dir)
    for _ in range(at.count().bit_length() + 1):
        if at.where(~F.col("done")).isEmpty():
            return at.drop("done")
        on = at.select(F.col("id").alias("via"), F.col("head").alias("far"), F.col("place").alias("more"), F.col("done").alias("end"))
        far = at.where(~F.col("done")).join(on, F.col("head") == F.col("via")).select("id", F.col("far").alias("head"), (F.col("place") + F.col("more")).alias("place"), F.col("end").alias("done"))
        at = settle(at.where("done").unionByName(far), "places", work_dir)
    return None


def news(lengths: Iterable[tuple[int, int]]) -> list[int]:
    """The new pairs of each round of a closure whose distances double, from (steps of a path, paths of so many)."""
    out: list[int] = []
    for steps, paths in lengths:
        low, r = 1, 0
        while low < steps:
            high = min(2 * low, steps)
            if r == len(out):
                out.append(0)
            # A path of n steps has n + 1 - d pairs at distance d; here d goes from low + 1 to high.
            out[r] += paths * ((high - low) * (steps + 1) - (high * (high + 1) - low * (low + 1)) // 2)
            low, r = 2 * low, r + 1
    return out


def lengths(at: DataFrame) -> list[tuple[int, int]]:
    return [tuple(r) for r in at.groupBy("head").agg(F.max("place").alias("steps")).groupBy("steps").count().collect()]


def distant(at: DataFrame, carried: str) -> DataFrame:
    """(id, a, b): the carried column of all pairs two steps or more apart, and the id of the first."""
    block = lambda c: F.floor(F.col(c) / BLOCK)
    left = at.select("id", "head", "place", F.col(carried).alias("a"), block("place").alias("block"))
    right = at.select(F.col("head").alias("h2"), F.col("place").alias("place2"), F.col(carried).alias("b"), F.explode(F.sequence(F.lit(0).cast("long"), block("place"))).alias("block2"))
    return left.join(right, (F.col("head") == F.col("h2")) & (F.col("block") == F.col("block2")) & (F.col("place") + 1 < F.col("place2"))).select("id", "a", "b")
