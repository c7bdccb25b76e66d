"""Near duplicates by exact shingle similarity: every pair of texts at a Jaccard similarity of t or more is linked.

A text is the set of XXH64 hashes of its word shingles; equal sets collapse first. Two sets of similarity t share an
element among the first n - ceil(t n) + 1 of each under any common order (prefix filter), so postings of prefixes find
every pair. The order puts hashes that many texts hold last: a common line costs nothing as long as a text has enough of
its own. A bitmap of each set (the parity of its hashes by their low bits) bounds the symmetric difference from below and
drops most candidates that share a passage only, a folded one already where postings meet; the rest are verified on the
whole sets, in integers.

A group of near copies must not make all its pairs, so there are two rounds. First every text is compared with one other
of each of its SimHash table entries (see ``simhash``) and of a few of its posting lists; what holds on the whole sets joins
most of a group; in crowded lists that is several others, since not every copy is similar to one. Then come links between different components only: SimHash links and shared postings, where members of the
component that fills most of a list never meet each other. What is left out lies inside one component already.

Edge cases: as in ``simhash`` (a null text is empty; empty texts are equal; texts shorter than a shingle are
one shingle; rows without a key are left out; an empty table gives an empty result).
"""

from __future__ import annotations

from fractions import Fraction
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quadlake.llm._common import Scratch, arrow_rows
from quadlake.llm.components import connected_components
from quadlake.llm.simhash import SEED, cross_links, grouped, hub_links, joined_up, majority, shingle_hashes

#: One text in SAMPLE is counted to find common hashes: those in at least COMMON of them, at most 2^17. Any choice gives the same links.
SAMPLE, COMMON, MOST_COMMON = 16, 6, 1 << 17
#: Others that a text is compared with in the first round in lists of at least CROWD texts; one in shorter lists.
HUBS, CROWD = 12, 16
#: Posting lists that a text offers in the first round: those of its first shared hashes.
OFFERS = 12
#: Bits of a set's bitmap, and longs of the bitmap folded.
BITS, FOLDED = 2048, 4
#: All postings are sifted in as many passes, so that shuffle files of one pass are on disk at a time.
PASSES = 4
#: Candidates are broadcast to the sets up to this number.
BROADCAST_ROWS = 1 << 21


def shingle_sets(docs: DataFrame, shingle: int, similarity: Fraction, common=None) -> DataFrame:
    """(id, digest, n, fp, hashes, prefix, bits) of (id, text); in `prefix` hashes of the sorted array `common` come last."""
    num, den = similarity.numerator, similarity.denominator

    def run(batches):
        import numpy as np
        import pyarrow as pa
        from xxhash import xxh64_intdigest

        last = np.array([] if common is None else common, np.int64)

        def lists(values):
            ends = np.cumsum([0, *map(len, values)]).astype(np.int32)
            return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(values) if values else np.empty(0, np.int64)))

        def out(rows):
            ids, digests, fps, sets, prefixes = zip(*rows, strict=True) if rows else ((), (), (), (), ())
            bits = [np.packbits(np.bincount(s & (BITS - 1), minlength=BITS) & 1).view(np.int64) for s in sets]
            return pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(digests, pa.int64()), pa.array([len(s) for s in sets], pa.int64()), pa.array(fps, pa.int64()), lists(sets), lists(prefixes), lists(bits)], ["id", "digest", "n", "fp", "hashes", "prefix", "bits"])

        rows, held = [], 0
        for doc_id, body in arrow_rows(batches, "id", "text"):
            every = shingle_hashes((body or b"").lower().split(), shingle)
            hashes = np.unique(every.view(np.int64))
            n, ordered = len(hashes), hashes
            if len(last) and n:
                known = last[np.minimum(np.searchsorted(last, hashes), len(last) - 1)] == hashes
                ordered = np.concatenate((hashes[~known], hashes[known]))
            digest = xxh64_intdigest(hashes.tobytes(), SEED)
            rows.append((doc_id, digest - (1 << 64) if digest >> 63 else digest, majority(every), hashes, ordered[: n - -(-num * n // den) + 1]))
            held += n
            if held >= 500_000 or len(rows) >= 5_000:
                yield out(rows)
                rows, held = [], 0
        yield out(rows)

    return docs.mapInArrow(run, "id long, digest long, n long, fp long, hashes array<long>, prefix array<long>, bits array<long>")


def common_hashes(docs: DataFrame, shingle: int, similarity: Fraction, sample: int, least: int) -> list[int]:
    """Sorted hashes in at least `least` of the sampled texts; the bound rises until MOST_COMMON are enough."""
    some = docs.where(F.pmod(F.xxhash64("text"), F.lit(sample)) == 0)
    scratch = Scratch(docs.sparkSession, "shingle-counts")
    counted = scratch.write(shingle_sets(some, shingle, similarity).select(F.explode("hashes").alias("h")).groupBy("h").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least))
    total, bound = 0, None
    for n, many in sorted(((r["n"], r["many"]) for r in counted.groupBy("n").agg(F.count(F.lit(1)).alias("many")).collect()), reverse=True):
        total += many
        if total > MOST_COMMON:
            break
        bound = n
    out = [] if bound is None else sorted(r["h"] for r in counted.where(F.col("n") >= bound).select("h").collect())
    scratch.drop(counted)
    return out


def _similar(scratch: Scratch, docs: DataFrame, shingle: int, similarity: Fraction, sets: DataFrame, pairs: DataFrame) -> DataFrame:
    """The pairs (a, b) of rows whose sets are similar. Whole sets are made again for candidates only, to save disk."""
    rows = pairs.select(F.explode(F.array("a", "b")).alias("want")).distinct()
    wanted = scratch.write(sets.join(rows, F.col("row") == F.col("want"), "left_semi").select("row", F.col("id").alias("wid"), F.col("digest").alias("wd"), F.col("n").alias("wn")))
    few = F.broadcast(wanted) if wanted.count() <= BROADCAST_ROWS else wanted
    again = shingle_sets(docs.join(few, F.col("id") == F.col("wid"), "left_semi"), shingle, similarity).select("id", "digest", "n", "hashes")
    held = scratch.write(again.join(few, (F.col("id") == F.col("wid")) & (F.col("digest") == F.col("wd")) & (F.col("n") == F.col("wn"))).select("row", "n", "hashes"))
    first = held.select(F.col("row").alias("ra"), F.col("n").alias("na"), F.col("hashes").alias("ha"))
    second = held.select(F.col("row").alias("rb"), F.col("n").alias("nb"), F.col("hashes").alias("hb"))
    both = pairs.join(first, F.col("a") == F.col("ra")).join(second, F.col("b") == F.col("rb"))
    # |A & B| / |A | B| >= p / q  iff  |A & B| (p + q) >= (|A| + |B|) p
    p, q = similarity.numerator, similarity.denominator
    out = scratch.write(both.where(F.size(F.array_intersect("ha", "hb")) * (p + q) >= (F.col("na") + F.col("nb")) * p).select("a", "b").distinct())
    scratch.drop(held)
    scratch.drop(wanted)
    return out


def _may_be_similar(similarity: Fraction, sets: DataFrame, pairs: DataFrame) -> DataFrame:
    """The pairs (a, b) of rows whose bitmaps allow the similarity."""
    p, q = similarity.numerator, similarity.denominator
    first = sets.select(F.col("row").alias("a"), F.col("n").alias("na"), F.col("bits").alias("ba"))
    second = sets.select(F.col("row").alias("b"), F.col("n").alias("nb"), F.col("bits").alias("bb"))
    differ = F.aggregate(F.zip_with("ba", "bb", lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda t, x: t + x)
    # |A ^ B| <= (1 - t) / (1 + t) (|A| + |B|), and bits that differ are at most as many.
    return pairs.join(first, "a").join(second, "b").where(differ * (p + q) <= (F.col("na") + F.col("nb")) * (q - p)).select("a", "b")


def _postings(scratch: Scratch, sets: DataFrame, reps: DataFrame) -> list[DataFrame]:
    """Tables of (h, node, n, pos): the prefixes of the representatives, as far as two of them share a hash."""
    copies = scratch.write(sets.select("row").join(reps.select(F.col("node").alias("row")), "row", "left_anti"))
    few = F.broadcast(copies) if copies.count() <= BROADCAST_ROWS else copies
    own = sets.select("row", "n", "prefix").join(few, "row", "left_anti")
    posts = own.select(F.col("row").alias("node"), F.col("n").cast("int").alias("n"), F.posexplode("prefix").alias("pos", "h"))
    out = []
    for k in range(PASSES):
        part = posts.where(F.pmod("h", F.lit(PASSES)) == k)
        shared = scratch.write(part.groupBy("h").agg(F.count(F.lit(1)).alias("texts")).where("texts > 1").select("h"))
        out.append(scratch.write(part.join(shared, "h", "left_semi").select("h", "node", "n", "pos")))
        scratch.drop(shared)
    scratch.drop(copies)
    return out


def _length_fits(a, b, p: int, q: int):
    return F.least(a, b) * q >= F.greatest(a, b) * p


def _star_pairs(scratch: Scratch, parts: list[DataFrame], similarity: Fraction) -> DataFrame:
    """(a, b): every node with one other, or a few, of its first OFFERS posting lists."""
    p, q = similarity.numerator, similarity.denominator
    posts = reduce(DataFrame.unionByName, parts)
    picks = [F.min(F.struct(F.xxhash64("node", F.lit(i)).alias("o"), "node", "n")).alias(f"hub{i}") for i in range(HUBS)]
    lists = posts.groupBy("h").agg(F.count(F.lit(1)).alias("texts"), *picks)
    hubs = F.array_distinct(F.array(*[F.struct(f"hub{i}.node", f"hub{i}.n") for i in range(HUBS)]))
    hubs = lists.select("h", F.when(F.col("texts") >= CROWD, hubs).otherwise(F.array(F.struct("hub0.node", "hub0.n"))).alias("hubs"))
    mine = F.slice(F.sort_array(F.collect_list(F.struct("pos", "h"))), 1, OFFERS)  # of a node's prefix
    offers = posts.groupBy("node", "n").agg(mine.alias("mine")).select("node", "n", F.explode("mine.h").alias("h"))
    met = offers.join(hubs, "h").select("node", "n", F.explode("hubs").alias("hub"))
    met = met.where((F.col("node") != F.col("hub.node")) & _length_fits(F.col("n"), F.col("hub.n"), p, q))
    return scratch.write(met.select(F.least("node", "hub.node").alias("a"), F.greatest("node", "hub.node").alias("b")).distinct())


def _folded(bits):
    """A bitmap as FOLDED longs: the parity of each bit's copies."""
    parts = [F.transform(F.sequence(F.lit(k), F.size(bits) - 1, F.lit(FOLDED)), lambda i: F.get(bits, i)) for k in range(FOLDED)]
    return [F.aggregate(part, F.lit(0).cast("long"), lambda t, x: t.bitwiseXOR(x)).alias(f"f{k}") for k, part in enumerate(parts)]


def _cross_pairs(scratch: Scratch, posts: list[DataFrame], placed: DataFrame, sets: DataFrame, similarity: Fraction) -> DataFrame:
    """(a, b): nodes in different components that share a hash of their prefixes, as far as folded bitmaps allow the similarity. Drops the postings."""
    p, q = similarity.numerator, similarity.denominator
    held = scratch.write(reduce(DataFrame.unionByName, posts).join(placed.select("node", "comp"), "node"))
    for part in posts:
        scratch.drop(part)
    shares = held.groupBy("h", "comp").agg(F.count(F.lit(1)).alias("m"))
    most = shares.groupBy("h").agg(F.max_by("comp", F.struct("m", "comp")).alias("most"), F.count(F.lit(1)).alias("comps")).where("comps > 1").drop("comps")
    open_ = scratch.write(held.join(most, "h"))
    scratch.drop(held)
    left = scratch.write(open_.join(sets.select(F.col("row").alias("node"), *_folded(F.col("bits"))), "node"))
    scratch.drop(open_)
    x, y = left.where("comp <> most").alias("x"), left.alias("y")
    rest = F.least(F.col("x.n") - F.col("x.pos"), F.col("y.n") - F.col("y.pos"))  # holds at the first hash a pair shares
    met = (F.col("x.h") == F.col("y.h")) & (F.col("x.comp") != F.col("y.comp")) & ((F.col("x.node") < F.col("y.node")) | (F.col("y.comp") == F.col("y.most")))
    differ = sum((F.bit_count(F.col(f"x.f{k}").bitwiseXOR(F.col(f"y.f{k}"))) for k in range(1, FOLDED)), F.bit_count(F.col("x.f0").bitwiseXOR(F.col("y.f0"))))
    both = F.col("x.n") + F.col("y.n")
    met = met & _length_fits(F.col("x.n"), F.col("y.n"), p, q) & (rest * (p + q) >= both * p) & (differ * (p + q) <= both * (q - p))
    out = scratch.write(x.join(y, met).select(F.least("x.node", "y.node").alias("a"), F.greatest("x.node", "y.node").alias("b")).distinct())
    scratch.drop(left)
    return out


def similar_documents(docs: DataFrame, shingle: int = 5, similarity: float = 0.8, radius: int = 4, parts: int = 3, text: str = "text", key: str = "doc_id", sample: int = SAMPLE, least: int = COMMON) -> DataFrame:
    """(doc_id, fp, component_id) for every document: the smallest doc_id reachable over pairs at `similarity` or more."""
    bound = Fraction(str(similarity))
    scratch = Scratch(docs.sparkSession, "shingle-join")
    w = scratch.write
    narrow = docs.where(F.col(key).isNotNull()).select(F.col(key).cast("long").alias("id"), F.col(text).cast("string").alias("text"))
    common = common_hashes(narrow, shingle, bound, sample, least)
    sets = w(shingle_sets(narrow, shingle, bound, common).drop("hashes").withColumn("row", F.monotonically_increasing_id()))
    reps = w(sets.groupBy("digest", "n").agg(F.min("row").alias("node"), F.min("id").alias("least_id"), F.first("fp").alias("fp")))

    def verify(simhash: DataFrame, shared: DataFrame) -> DataFrame:
        pairs = w(simhash.unionByName(_may_be_similar(bound, sets, shared)).distinct())
        scratch.drop(shared)
        out = _similar(scratch, narrow, shingle, bound, sets, pairs)
        scratch.drop(pairs)
        return out

    posts, fps = _postings(scratch, sets, reps), reps.select("node", "fp")
    first = verify(hub_links(fps, radius, parts), _star_pairs(scratch, posts, bound))
    placed = w(grouped(fps, connected_components(scratch, first), "node"))
    more = verify(cross_links(scratch, placed, radius, parts), _cross_pairs(scratch, posts, placed, sets, bound))
    nodes = w(joined_up(scratch, placed.drop("fp"), more))
    found = w(reps.join(nodes, "node").select("digest", "n", "least_id", "comp"))
    least_ids = found.groupBy("comp").agg(F.min("least_id").alias("component_id"))
    classes = found.join(least_ids, "comp").select("digest", "n", "component_id")
    out = w(sets.select("id", "digest", "n", "fp").join(classes, ["digest", "n"]).select(F.col("id").alias("doc_id"), "fp", "component_id"))
    scratch.drop(sets)
    return out
