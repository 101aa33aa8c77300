"""Connected components of a graph of any size, by alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weirflow.llm.scratch import Scratch


def connected(edges: DataFrame, scratch: Scratch, name: str) -> DataFrame:
    """(node, root) for every node of an edge; root is the smallest node that it reaches.

    ``edges`` has columns a and b of one orderable type. Each round hooks every
    node's larger neighbours to its smallest one, then its smaller neighbours and
    itself to the smallest; after O(log n) rounds only stars are left. A round is
    written to the shared folder, so the plan doesn't grow. A hub's minimum is reduced
    with partial minima and written, too, so that the join back is one of two plain
    tables, which AQE splits where a hub has most of the edges.
    """

    def ordered(frame: DataFrame) -> DataFrame:
        return frame.filter("u != v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()

    def write(frame: DataFrame, i: int) -> tuple[DataFrame, tuple]:
        kept = scratch.keep(frame, f"{name}-{i}")
        state = kept.agg(F.count("*"), F.sum(F.xxhash64("u", "v") % 1_000_000_007)).first()
        return kept, tuple(state)

    now, state = write(ordered(edges.select(F.col("a").alias("u"), F.col("b").alias("v"))), 0)
    i = 0
    while state[0]:
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("m", "u").alias("m"))
        least = scratch.keep(least, f"{name}-least")
        large = both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.explode(F.array(F.struct("v", "m"), F.struct(F.col("u").alias("v"), "m"))).alias("e"))
        i += 1
        before = state
        now, state = write(ordered(small.select(F.col("e.v").alias("u"), F.col("e.m").alias("v"))), i)
        scratch.drop(f"{name}-{i - 1}", f"{name}-least")
        if state == before:
            break
    stars = now.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return stars.unionByName(stars.select(F.col("root").alias("node"), "root").distinct())
