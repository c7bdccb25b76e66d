"""SimHash near-duplicate detection by multi-index hashing.

A document's fingerprint is the bitwise majority of the XXH64 hashes of its word shingles. Equal fingerprints are
collapsed first, so a group of copies costs one row from there on. The distinct fingerprints are cut into segments;
every fingerprint probes each segment's table with all values in a small Hamming ball around its own segment value,
fetches the matches, and the complete distance decides. With s segments and ball radius b every pair within
s*(b+1)-1 bits is found (pigeonhole), so the result is exact for radii up to that bound.

A large group of near copies must not make all its pairs. So links are found in two rounds: first every fingerprint is
compared with one other of each of its own table entries, which joins most of a group into one component; then tables
are probed for links between different components only. In a crowded entry the members from the component that fills most
of it are never met by that component's probes. What is left out lies inside one component already.

With a `similarity`, links are also verified by exact Jaccard similarity of the shingle sets, and pairs that no
fingerprint distance shows are added by ``shingle_join``: at a similarity of 0.8 fingerprints differ in about 10 of 64
bits, which no selective table covers.

Edge cases: a null text counts as empty; an empty text has fingerprint zero, linked like any other; texts with fewer
words than a shingle hash the whole word sequence; very long texts are read whole, in one task; repeated rows and
ties give one component whose id is the smallest doc_id; rows with a null doc_id are not documents and are left out; ids
must be integers (others are refused); extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quadlake.llm._common import Scratch, arrow_rows, integral, table
from quadlake.llm.components import connected_components

SEED = 42
#: Members from which a table entry is crowded.
CROWD = 64


def shingle_hashes(words: list[bytes], shingle: int):
    """XXH64 of every shingle, repeats included; fewer words than a shingle are one."""
    import numpy as np
    from xxhash import xxh64_intdigest

    if not words:
        return np.empty(0, np.uint64)
    joined = b" ".join(words)
    if len(words) <= shingle:
        return np.array([xxh64_intdigest(joined, SEED)], np.uint64)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = [0, *(ends[:-1] + 1).tolist()]
    return np.array([xxh64_intdigest(joined[a:b], SEED) for a, b in zip(starts, ends[shingle - 1 :].tolist(), strict=False)], np.uint64)


def majority(hashes) -> int:
    """Signed fingerprint of shingle hashes: a bit is set if set in over half of them."""
    import numpy as np

    if not len(hashes):
        return 0
    ones = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 1 << 16):
        bits = np.unpackbits(hashes[at : at + (1 << 16)].astype(">u8").view(np.uint8)).reshape(-1, 64)
        ones += bits.sum(0, dtype=np.int64)
    return int(np.packbits(ones * 2 > len(hashes)).view(">i8")[0])


def fingerprints(docs: DataFrame, shingle: int = 4, text: str = "text", key: str = "doc_id") -> DataFrame:
    """(doc_id, fp): the fingerprint of every document as a signed 64-bit integer."""

    def run(batches):
        import pyarrow as pa

        ids, fps = [], []
        for doc_id, body in arrow_rows(batches, "doc_id", "text"):
            ids.append(doc_id)
            fps.append(majority(shingle_hashes((body or b"").lower().split(), shingle)))
            if len(ids) >= 10_000:
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(fps, pa.int64())], ["doc_id", "fp"])
                ids, fps = [], []
        yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(fps, pa.int64())], ["doc_id", "fp"])

    return docs.where(F.col(key).isNotNull()).select(F.col(key).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text")).mapInArrow(run, "doc_id long, fp long")


def segments(count: int) -> list[tuple[int, int]]:
    """(shift, width) of each segment of a 64-bit fingerprint."""
    edges = [64 * i // count for i in range(count + 1)]
    return [(a, b - a) for a, b in zip(edges, edges[1:], strict=False)]


def ball(width: int, radius: int) -> list[int]:
    """All masks of up to `radius` set bits in `width` bits."""
    return [sum(1 << b for b in bits) for r in range(radius + 1) for bits in combinations(range(width), r)]


def _entries(nodes: DataFrame, parts: int) -> DataFrame:
    """The columns of `nodes` with part and value: one row per segment of the fingerprint fp."""
    cells = [F.struct(F.lit(i).alias("part"), _segment(F.col("fp"), shift, width).alias("value")) for i, (shift, width) in enumerate(segments(parts))]
    return nodes.select("*", F.explode(F.array(*cells)).alias("at")).select(*nodes.columns, "at.part", "at.value")


def _segment(value, shift: int, width: int):
    return F.shiftrightunsigned(value, shift).bitwiseAND(F.lit((1 << width) - 1))


def hub_links(nodes: DataFrame, radius: int, parts: int) -> DataFrame:
    """(a, b), a < b: every one of `nodes` (node, fp) with the least node of each of its table entries, if within `radius`."""
    entries = _entries(nodes, parts)
    hubs = entries.groupBy("part", "value").agg(F.min(F.struct("node", "fp")).alias("hub"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    met = entries.join(hubs, ["part", "value"]).where((F.col("node") != F.col("hub.node")) & (F.bit_count(F.col("fp").bitwiseXOR(F.col("hub.fp"))) <= radius))
    return met.select(F.col("hub.node").alias("a"), F.col("node").alias("b")).distinct()


def cross_links(scratch: Scratch, nodes: DataFrame, radius: int = 4, parts: int = 3, crowd: int = CROWD) -> DataFrame:
    """(a, b), a < b: pairs of `nodes` (node, fp, comp) at `radius` or fewer differing bits in different components, each once."""
    reach = radius // parts
    cuts = segments(parts)
    entries = _entries(nodes, parts)
    shares = entries.groupBy("part", "value", "comp").agg(F.count(F.lit(1)).alias("n"))
    crowded = shares.groupBy("part", "value").agg(F.sum("n").alias("members"), F.max_by("comp", F.struct("n", "comp")).alias("most")).where(F.col("members") >= crowd)
    crowded = scratch.write(crowded.drop("members"))
    held = entries.select(F.col("node").alias("a"), F.col("fp").alias("fa"), F.col("comp").alias("ca"), "part", "value")
    probes = []
    for i, (shift, width) in enumerate(cuts):
        masks = F.array(*[F.lit(m).cast("long") for m in ball(width, reach)])
        probes.append(_probes(masks, _segment(F.col("fp"), shift, width), i))
    asked = nodes.select(F.col("node").alias("b"), F.col("fp").alias("fb"), F.col("comp").alias("cb"), F.explode(F.flatten(F.array(*probes))).alias("at"))
    asked = asked.select("b", "fb", "cb", F.col("at.part").alias("qpart"), F.col("at.value").alias("qvalue"))
    apart = F.col("fa").bitwiseXOR(F.col("fb"))
    near = (F.col("part") == F.col("qpart")) & (F.col("value") == F.col("qvalue")) & (F.col("a") < F.col("b")) & (F.col("ca") != F.col("cb")) & (F.bit_count(apart) <= radius)
    for i, (shift, width) in enumerate(cuts[:-1]):  # a pair counts in the first segment that finds it
        near = near & ((F.col("part") <= i) | (F.bit_count(_segment(apart, shift, width)) > reach))
    if crowded.isEmpty():
        return asked.join(held, near).select("a", "b")
    out = asked.join(held.join(crowded, ["part", "value"], "left_anti"), near).select("a", "b")
    held = held.join(crowded, ["part", "value"])
    asked = asked.join(crowded.withColumnsRenamed({"part": "qpart", "value": "qvalue", "most": "qmost"}), ["qpart", "qvalue"])
    out = out.unionByName(asked.join(held.where("ca <> most"), near).select("a", "b"))
    return out.unionByName(asked.where("cb <> qmost").join(held.where("ca = most"), near).select("a", "b"))


def _probes(masks, value, part: int):
    return F.transform(masks, lambda mask: F.struct(F.lit(part).alias("part"), value.bitwiseXOR(mask).alias("value")))


def components_of(scratch: Scratch, nodes: DataFrame, radius: int, parts: int) -> DataFrame:
    """(node, fp, comp) of `nodes` (node, fp): the least node reachable over links within `radius`."""
    w = scratch.write
    first = connected_components(scratch, w(hub_links(nodes, radius, parts)))
    placed = w(grouped(nodes, first, "node"))
    return w(joined_up(scratch, placed, w(cross_links(scratch, placed, radius, parts))))


def grouped(nodes: DataFrame, roots: DataFrame, node: str) -> DataFrame:
    """`nodes` with comp: the root of the node, or the node itself."""
    at = roots.select(F.col("node").alias("_node"), F.col("root").alias("_root"))
    return nodes.join(at, F.col(node) == F.col("_node"), "left").withColumn("comp", F.coalesce("_root", node)).drop("_node", "_root")


def joined_up(scratch: Scratch, nodes: DataFrame, pairs: DataFrame) -> DataFrame:
    """`nodes` (node, ..., comp) with components that any of `pairs` (a, b) links made one."""
    comp = nodes.select(F.col("node").alias("_n"), F.col("comp").alias("_c"))
    ends = pairs.join(comp.withColumnsRenamed({"_n": "a", "_c": "ra"}), "a").join(comp.withColumnsRenamed({"_n": "b", "_c": "rb"}), "b").select("ra", "rb")
    roots = connected_components(scratch, ends)
    return grouped(nodes.withColumnRenamed("comp", "_old"), roots, "_old").drop("_old")


def near_duplicates(docs: DataFrame, shingle: int = 4, radius: int = 4, parts: int = 3, similarity: float | None = None, text: str = "text", key: str = "doc_id") -> DataFrame:
    """(doc_id, fp, component_id) for every document: the smallest doc_id reachable over fingerprint links.

    ``parts`` trades probes for selectivity: a segment should hold about log2 of the number of distinct
    fingerprints in bits (3 up to some 10^8 of them, 2 beyond); every choice gives the same links. With ``similarity``
    the links are the pairs of texts whose sets of shingles have at least that Jaccard similarity.
    """
    integral(docs, key)
    if similarity is not None:
        from quadlake.llm.shingle_join import similar_documents

        return similar_documents(docs, shingle, similarity, radius, parts, text, key)
    scratch = Scratch(docs.sparkSession, "simhash")
    fps = scratch.write(fingerprints(docs, shingle, text, key))
    reps = scratch.write(fps.groupBy("fp").agg(F.min("doc_id").alias("node")))
    classes = components_of(scratch, reps, radius, parts).select(F.col("fp").alias("class_fp"), F.col("comp").alias("component_id"))
    return fps.join(classes, F.col("fp") == F.col("class_fp")).select("doc_id", "fp", "component_id")


def op2_simhash(spark, sf_dir: str) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id of all documents: 4-word shingles, 4 bits."""
    found = near_duplicates(table(spark, sf_dir, "documents"), shingle=4, radius=4)
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
