"""Mixing sources to target weights by a multivariate-hypergeometric splitting tree.

1. Word totals per source are pre-aggregated. Targets share the budget by weight; a source stops at
   `cap` times its size and the excess is reshared by weight until none is above (closed form: with
   sources ordered by capacity per weight, a source is capped iff its capacity per weight is at most
   the level of those after it).
2. Every source's documents hash into blocks; the number of blocks follows the source's number of
   documents up to `max_blocks`, so a hot source is many blocks and a block is never a whole source.
   Blocks have a random order. A source takes whole passes over all blocks, then whole blocks in
   that order until the next would exceed its target, then documents of that boundary block, in
   random order, as long as they fit. The words taken come within the smallest document left.
3. The exact block quotas of all sources are split between output shards by a binary tree of
   multivariate-hypergeometric draws; each shard then takes its disjoint range of every source's
   permuted block draws and orders documents by a random key. A document is taken once for every draw of
   its block that some shard got; in a boundary block only if it fits.

The document path is DataFrame expressions only. The tree is drawn in the driver from one row per source, for at most
`max_sources` of them at a time: more sources are several groups with a tree each, and only one group's tree is held. All
draws derive from `seed`, doc_id and source, so reruns agree.

Edge cases: a null text has no words; a null source is a source of its own, last in order, and an
empty name is another; documents without words are taken zero words; repeated rows are documents of
their own with equal draws; very long texts are counted whole; an empty table gives an empty result; extra columns pass through unless they have
the names of added ones, which are replaced.
"""

from __future__ import annotations

import json
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quadlake.llm._common import Scratch, table, word_count

WEIGHTS = (3, 1, 2)
SHARE, CAP = 1.5, 2.0
SEED = 20_240_601
SHARDS = 64
BLOCK_DOCS, MAX_BLOCKS, MAX_SOURCES = 512, 1 << 16, 10_000
ADDED = ("size", "source_size", "target", "placements")


def source_targets(sizes: DataFrame, weights: Sequence[float] = WEIGHTS, share: float = SHARE, cap: float = CAP) -> DataFrame:
    """(src, docs, source_size, target) from (src, docs, source_size); one row per source.

    With capacity c and weight w, order sources by c/w. Source i is capped iff
    (budget - capacities before i) / (weights from i on) >= c_i / w_i, and the level of the rest is
    that quotient at the first source which is not.
    """
    order = Window.orderBy(F.col("src").asc_nulls_last())
    cycle = F.array(*[F.lit(float(w)) for w in weights])
    rows = sizes.withColumn("w", F.element_at(cycle, (F.pmod(F.row_number().over(order) - 1, F.lit(len(weights))) + 1).cast("int")))
    rows = rows.withColumn("c", F.lit(float(cap)) * F.col("source_size"))
    by_level = Window.orderBy(F.col("c") / F.col("w"), F.col("src").asc_nulls_last())
    whole = Window.orderBy(F.lit(0)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    before = by_level.rowsBetween(Window.unboundedPreceding, -1)
    rest = by_level.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    budget = F.lit(float(share)) * F.sum("source_size").over(whole)
    level = (budget - F.coalesce(F.sum("c").over(before), F.lit(0.0))) / F.sum("w").over(rest)
    rows = rows.withColumn("level", level).withColumn("capped", F.col("level") >= F.col("c") / F.col("w"))
    water = F.max(F.when(~F.col("capped"), F.col("level"))).over(whole)  # levels fall along the order
    return rows.withColumn("water", water).select("src", "docs", "source_size", F.when(F.col("capped"), F.col("c")).otherwise(F.col("w") * F.col("water")).alias("target"))


def _source_key(col: Column) -> Column:
    """A string that keeps null apart from every name."""
    return F.when(col.isNull(), F.lit("")).otherwise(F.concat(F.lit("="), col))


def _blocks_of(docs: Column, block_docs: int, max_blocks: int) -> Column:
    return F.least(F.greatest(F.ceil(docs / block_docs), F.lit(1)), F.lit(max_blocks)).cast("long")


def split_tree(quotas: dict[str, int], shards: int, seed: int) -> list[tuple[str, int, int, int]]:
    """(source key, shard, first draw, draws): exact quotas of all sources split between shards.

    Every node holds a vector of block quotas and a range of shards. Its left child receives a
    multivariate-hypergeometric sample as large as its part of the shards.
    """
    import numpy as np

    names = sorted(quotas)
    rng = np.random.default_rng(seed)
    start = dict.fromkeys(names, 0)
    out: list[tuple[str, int, int, int]] = []

    def descend(vector, first: int, count: int) -> None:
        if count == 1:
            for name, n in zip(names, vector.tolist(), strict=True):
                if n:
                    out.append((name, first, start[name], n))
                    start[name] += n
            return
        left = count // 2
        total = int(vector.sum())
        part = rng.multivariate_hypergeometric(vector, total * left // count, method="marginals") if total else vector
        descend(part, first, left)
        descend(vector - part, first + left, count - left)

    if names:
        descend(np.array([quotas[n] for n in names], np.int64), 0, shards)
    return out


def _trees(scratch: Scratch, counts: DataFrame, groups: int, shards: int, seed: int) -> DataFrame:
    """(rkey, cells, shard, at, draws): the ranges of all trees, from one row a source; one group of sources at a time."""
    spark, out = counts.sparkSession, None
    for g in range(groups):
        part = counts.where(F.pmod(F.xxhash64("skey"), F.lit(groups)) == g).collect() if groups > 1 else counts.collect()
        cells = {r["skey"]: r["cells"] for r in part}
        rows = [{"rkey": name, "cells": cells[name], "shard": shard, "at": at, "draws": n} for name, shard, at, n in split_tree({r["skey"]: r["draws"] for r in part}, shards, seed + g)]
        made = spark.range(1).select(F.explode(F.from_json(F.lit(json.dumps(rows)), "array<struct<rkey:string,cells:long,shard:int,at:long,draws:long>>")).alias("r")).select("r.*")
        made = scratch.write(made) if groups > 1 else made
        out = made if out is None else out.unionByName(made)
    return out


def mix(docs: DataFrame, weights: Sequence[float] = WEIGHTS, share: float = SHARE, cap: float = CAP, shards: int = SHARDS, seed: int = SEED, text: str = "text", source: str = "source", key: str = "doc_id", size: str | None = None, block_docs: int = BLOCK_DOCS, max_blocks: int = MAX_BLOCKS, max_sources: int = MAX_SOURCES) -> DataFrame:
    """`docs` with size, source_size, target and placements: array of (pass, shard, position), one per copy taken.

    ``size`` names a column that already holds the number of words; otherwise words of ``text`` are
    counted. No document is dropped: one that the mix does not take has no placements.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "mixing")
    kept = [c for c in docs.columns if c.lower() not in ADDED]
    words = F.coalesce(F.col(size).cast("long"), F.lit(0)) if size else word_count(F.col(text))
    ident, name = F.col(key).cast("string"), F.col(source).cast("string")
    sized = docs.select(F.struct(*[F.col(f"`{c}`") for c in kept]).alias("row"), words.alias("size"), name.alias("src"), _source_key(name).alias("skey"), ident.alias("id"))
    sized = sized.withColumn("spot", F.xxhash64(F.lit(seed), "id", "skey"))
    narrow = scratch.write(sized.drop("row"))
    totals = scratch.write(narrow.groupBy("src").agg(F.count(F.lit(1)).alias("docs"), F.sum("size").alias("source_size")))
    groups = max(1, -(-totals.count() // max_sources))
    passes = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size") + 1e-9)).otherwise(F.lit(0)).cast("long")
    plan = source_targets(totals, weights, share, cap).withColumn("passes", passes)
    plan = plan.select(_source_key(F.col("src")).alias("pkey"), "source_size", "target", "passes", _blocks_of(F.col("docs"), block_docs, max_blocks).alias("blocks"), F.greatest(F.col("target") - F.col("passes") * F.col("source_size"), F.lit(0.0)).alias("rest"))
    plan = scratch.write(plan)
    if groups == 1:
        plan = F.broadcast(plan)  # at most max_sources rows
    placed = narrow.join(plan, F.col("skey") == F.col("pkey")).withColumn("block", F.pmod("spot", "blocks"))

    cells = placed.groupBy("skey", "block", "passes", "rest").agg(F.sum("size").alias("words"))
    order = Window.partitionBy("skey").orderBy(F.xxhash64(F.lit(seed), F.lit("block"), "block"), "block")  # at most max_blocks rows a key
    cells = cells.withColumn("rank", F.row_number().over(order) - 1).withColumn("upto", F.sum("words").over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    part = F.when(F.col("upto") <= F.col("rest"), "full").when(F.col("upto") - F.col("words") < F.col("rest"), "edge").otherwise("none")
    cells = cells.withColumn("part", part).withColumn("left", F.col("rest") - (F.col("upto") - F.col("words")))
    cells = scratch.write(cells.select("skey", "block", "rank", "part", "left", "passes"))

    counts = scratch.write(cells.groupBy("skey").agg(F.count(F.lit(1)).alias("cells"), (F.count(F.lit(1)) * F.max("passes") + F.count(F.when(F.col("part") != "none", 1))).alias("draws")))
    # Draws are numbered pass by pass in the permuted order; each row of the tree is a shard's range of them.
    number = F.explode(F.sequence("at", F.col("at") + F.col("draws") - 1))
    trees = _trees(scratch, counts, groups, shards, seed).select("rkey", "cells", "shard", number.alias("number"))
    draws = trees.select("rkey", "shard", F.expr("number div cells").alias("turn"), F.pmod("number", "cells").alias("place"))
    drawn = cells.join(draws, (F.col("skey") == F.col("rkey")) & (F.col("rank") == F.col("place")))
    one = F.struct(F.col("turn").cast("int").alias("pass"), F.col("shard"), ((F.col("turn") == F.col("passes")) & (F.col("part") == "edge")).alias("edge"))
    per_block = drawn.groupBy("skey", "block").agg(F.sort_array(F.collect_list(one)).alias("draws"))

    # One boundary block a source: its documents are tried in random order.
    edge = cells.where("part = 'edge'").select(F.col("skey").alias("ekey"), F.col("block").alias("eblock"), "left")
    within = placed.where("size > 0").join(F.broadcast(edge), (F.col("skey") == F.col("ekey")) & (F.col("block") == F.col("eblock")))
    items = F.sort_array(F.collect_list(F.struct(F.xxhash64(F.lit(seed), F.lit("edge"), "id").alias("o"), F.col("id"), F.col("size"))))

    def fit(acc, x):
        takes = x["size"] <= acc["left"]
        return F.struct(F.when(takes, acc["left"] - x["size"]).otherwise(acc["left"]).alias("left"), F.when(takes, F.concat(acc["ids"], F.array(x["id"]))).otherwise(acc["ids"]).alias("ids"))

    start = F.struct(F.col("left").cast("double").alias("left"), F.array().cast("array<string>").alias("ids"))
    chosen = within.groupBy("skey", "block", "left").agg(items.alias("items")).select(F.col("skey").alias("xkey"), F.col("block").alias("xblock"), F.aggregate("items", start, fit, lambda a: a["ids"]).alias("ids"))
    per_block = per_block.join(chosen, (F.col("skey") == F.col("xkey")) & (F.col("block") == F.col("xblock")), "left")
    per_block = scratch.write(per_block.select(F.col("skey").alias("bkey"), F.col("block").alias("bblock"), "draws", "ids"))

    full = sized.join(plan, F.col("skey") == F.col("pkey"), "left").withColumn("block", F.pmod("spot", "blocks"))
    full = full.join(per_block, (F.col("skey") == F.col("bkey")) & (F.col("block") == F.col("bblock")), "left")
    taken = F.coalesce(F.array_contains("ids", F.col("id")), F.lit(False))
    mine = F.filter(F.coalesce("draws", F.array().cast("array<struct<pass:int,shard:int,edge:boolean>>")), lambda d: ~d["edge"] | taken)
    at = F.transform(mine, lambda d: F.struct(d["pass"].alias("pass"), d["shard"].alias("shard"), F.xxhash64(F.lit(seed), d["pass"], F.col("id")).alias("position")))
    return full.select(*[F.col("row")[c].alias(c) for c in kept], "size", "source_size", "target", at.alias("placements"))


def op5_mixing(spark, sf_dir: str) -> DataFrame:
    """doc_id, size, source_size, target, taken of all documents; shards, the output shard of each copy taken."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", word_count(F.col("text")).alias("words"))
    out = mix(Scratch(spark, "op5").write(docs), size="words")
    return out.select("doc_id", "size", "source_size", F.col("target").cast("double").alias("target"), (F.col("size") * F.size("placements")).cast("long").alias("taken"), F.col("placements.shard").alias("shards"))
