"""Connected components by alternating large-star and small-star contraction.

Every half-step is a shuffle-bounded DataFrame plan written to the shared folder, so lineage stays
short and lost executors cost one half-step. Minima are pre-aggregated before the shuffle; beyond LIGHT edges they
are written before they are joined back, which leaves both join inputs as plain exchanges that the
adaptive planner can split when one hub holds many edges.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from quadlake.llm._common import Scratch


#: Edges up to which one task can hold a hub's share, so that minima need no table of their own.
LIGHT = 1 << 18


def _star(scratch: Scratch, edges: DataFrame, large: bool, light: bool) -> tuple[DataFrame, DataFrame | None]:
    """One contraction of edges (u > v). Returns the new edges, unwritten, and the written minima to drop later, if any."""
    if large:
        around = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    else:
        around = edges.select("u", "v")
    least = around.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("k"), F.least("u", "m").alias("m"))
    least = least if light else scratch.write(least)
    joined = around.join(least, F.col("u") == F.col("k"))
    if large:
        out = joined.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        out = joined.select(F.explode(F.array(F.struct(F.col("u").alias("u"), F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e")).select("e.u", "e.v")
    return out.where("u > v").distinct(), None if light else least


def connected_components(scratch: Scratch, pairs: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, root) for every node of `pairs` (two long columns); root is the smallest node of its component.

    The result is written to the shared folder. Self-pairs give a node that is its own root only if it
    has no other pair; callers treat a missing node as its own root.
    """
    a, b = pairs.columns
    edges = pairs.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u > v").distinct()
    seen = Observation()
    edges = scratch.write(edges.observe(seen, F.count(F.lit(1)).alias("n")))
    before, light = None, seen.get["n"] <= LIGHT  # the number of edges never grows much: a star has one edge a node
    for _ in range(max_rounds):
        grown, low = _star(scratch, edges, True, light)
        grown = scratch.write(grown)
        shrunk, low2 = _star(scratch, grown, False, light)
        seen = Observation()
        after_df = scratch.write(shrunk.observe(seen, F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64("u", "v")).alias("h"), F.sum(F.col("v").cast("decimal(38,0)")).alias("s")))
        for used in (edges, grown, low, low2):
            scratch.drop(used)
        edges, after = after_df, (seen.get["n"], seen.get["h"], seen.get["s"])
        if after == before or not after[0]:
            break
        before = after
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    roots = edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return roots.unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
