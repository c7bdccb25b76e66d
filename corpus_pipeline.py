"""Corpus pipeline: toxicity, near duplicates, benchmark items, personal data, source mix.

Every stage works on all its predecessor kept. All but the last return the columns of ``documents``;
the last returns one row per copy the mix takes, with its pass, shard and position in the shard.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quadlake.llm import decontaminate, mixing, pii, simhash, toxicity
from quadlake.llm._common import Scratch, bound_batches, table

#: A document goes if its toxicity is at least this.
REJECT = 0.5
#: Near duplicates: words of a shingle, and the similarity of shingle sets from which texts are linked.
SHINGLE, SIMILARITY = 5, 0.8


def toxic_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity is below REJECT."""
    bound_batches(spark)
    model = toxicity.production_model(spark, sf_dir, docs)
    scored = toxicity.score(docs, model, name="_toxicity")
    return scored.where(F.col("_toxicity") < REJECT).drop("_toxicity")


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of every group of near duplicates: of its smallest doc_id, and of rows that repeat it the one with the least text hash.

    Rows that repeat a doc_id count as one document; rows without a doc_id stay.
    """
    bound_batches(spark)
    scratch = Scratch(spark, "pipeline")
    classes = simhash.near_duplicates(docs, shingle=SHINGLE, similarity=SIMILARITY)
    names = []
    for name in ("dropped_id", "twice"):
        while name in docs.columns:
            name += "_"
        names.append(name)
    dropped_id, twice = names
    found = scratch.write(classes.groupBy("doc_id").agg(F.min("component_id").alias("least"), F.count(F.lit(1)).alias("rows")))
    dropped = found.where("least < doc_id").select(F.col("doc_id").alias(dropped_id))
    kept = docs.join(dropped, F.col("doc_id") == F.col(dropped_id), "left_anti")
    # Ids of several rows are rare; only their rows are compared.
    several = scratch.write(found.where("rows > 1 and least = doc_id").select(F.col("doc_id").alias(twice)))
    if several.isEmpty():
        return kept
    single = kept.join(several, F.col("doc_id") == F.col(twice), "left_anti")
    again = kept.join(several, F.col("doc_id") == F.col(twice), "left_semi")
    row = F.struct(F.xxhash64("text").alias("_order"), *[F.col(f"`{c}`") for c in docs.columns])
    one = again.groupBy(F.col("doc_id").alias("_id")).agg(F.min(row).alias("_row")).select(*[F.col("_row")[c].alias(c) for c in docs.columns])
    return single.unionByName(one)


def benchmark_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    bound_batches(spark)
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


def pii_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, personal data replaced by pseudonyms."""
    columns = docs.columns
    return pii.pseudonymize(docs, count="_replaced").select(*columns)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row for every copy of a document that the mix takes."""
    mixed = mixing.mix(docs)
    placed = mixed.select(*docs.columns, F.explode("placements").alias("place"))
    return placed.select(*docs.columns, F.col("place.pass").alias("pass"), F.col("place.shard").alias("shard"), F.col("place.position").alias("position")).sortWithinPartitions("shard", "position")


STAGES = [
    ("toxicity", toxic_stage),
    ("near_duplicates", near_duplicate_stage),
    ("decontamination", benchmark_stage),
    ("pii", pii_stage),
    ("mixing", mixing_stage),
]

#: Similarity of shingle sets and windows and keyed permutations have no counterpart in SQL; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in order on ``documents``; each stage's result is written as Parquet and read by the next."""
    scratch = Scratch(spark, "pipeline-stages")
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        done = scratch.write(stage(spark, docs, sf_dir))
        docs = done
    return STAGES[-1][1](spark, docs, sf_dir)
