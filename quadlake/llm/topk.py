"""Exact top-k inner products by block-at-a-time pruning.

Vectors are turned into integers and cut, in order of their ids, into document-range blocks; a block holds its rows as a
forward index and, per dimension, the largest and the smallest value. The bound of a query on a block is the sum over
dimensions of the larger product with these extremes.

1. Each query is scored in its own block, where it lies anyway: its k-th score there is a first threshold.
2. Batches of queries meet the blocks' extremes only, a small part of the data. A pair of batch and block goes on if a
   query of the batch has a bound that reaches its threshold.
3. Those blocks are shipped, ordered by bound, and scored through the forward index until bounds fall below the k-th
   best score so far. Ties with the k-th score are still scored, since a smaller id wins. The few best of each task are
   merged by one window.

Batches meet extremes and blocks by equi-joins on (batch, slot) and block: no task holds all of either side and nothing
is broadcast. How many pairs go on depends on the data: dense random directions leave all of them.

Edge cases: vectors that are null or hold null or non-finite components, and rows without an id, take no part; a shorter
vector counts as padded with zeros; a query's own row is not its candidate, other rows with its id are; repeated query rows
are queries of their own; ties go to the smaller id; integers are exact whatever their size (up to the largest double), and a score that a long
cannot hold counts as the nearest long; a query with fewer candidates than k returns all of them; empty tables and tables
without queries give an empty result; extra columns are ignored; ids must be integers (others are refused).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quadlake.llm._common import Scratch, integral, shuffle_partitions, table

SCALE, TOP = 1024, 10
#: Rows of a block, queries of a batch, blocks whose extremes travel together.
BLOCK_ROWS, QUERY_ROWS, EXTREMES = 256, 512, 1024
#: Rows of a block times their width stay below this many numbers.
BLOCK_CELLS = 4 << 20
LEAST, MOST = -(1 << 63), (1 << 63) - 1


def _matrix(rows: list):
    """Rows of numbers as one matrix, padded with zeros. floor(1024 x) of a double is a double, so nothing is lost."""
    import numpy as np

    out = np.zeros((len(rows), max(map(len, rows), default=0)))
    for i, r in enumerate(rows):
        out[i, : len(r)] = r
    return out


def _read(data: bytes, rows: int):
    import numpy as np

    return np.frombuffer(data, np.float64).reshape(rows, -1) if data else np.zeros((rows, 0))


def _wide(m, width: int):
    import numpy as np

    return m if m.shape[1] == width else np.pad(m, ((0, 0), (0, width - m.shape[1])))


def _dot(a, b):
    """Exact integer products as int64, beyond its range the nearest: doubles where every partial sum is below 2^53, then int64, then Python's integers."""
    import numpy as np

    width = max(a.shape[1], b.shape[1])
    a, b = _wide(a, width), _wide(b, width)
    size = float(np.abs(a).max(initial=0)) * float(np.abs(b).max(initial=0)) * max(1, width)
    if size < 2.0**53:
        return (a @ b.T).astype(np.int64)
    if size < 2.0**62 and max(np.abs(a).max(), np.abs(b).max()) < 2.0**62:
        return a.astype(np.int64) @ b.T.astype(np.int64)
    x, y = ([[int(v) for v in row] for row in m] for m in (a, b))
    return np.array([[min(MOST, max(LEAST + 1, sum(u * v for u, v in zip(r, c, strict=True)))) for c in y] for r in x], np.int64).reshape(len(x), len(y))


def _bounds(cells, most, least):
    """Upper bounds of queries x blocks; the sum of two parts that are each exact or saturated."""
    import numpy as np

    up, down = _dot(np.maximum(cells, 0), most), _dot(np.minimum(cells, 0), least)
    if max(np.abs(up).max(initial=0), np.abs(down).max(initial=0)) < 1 << 62:
        return up + down
    return np.array([[min(MOST, max(LEAST + 1, int(a) + int(b))) for a, b in zip(r, c, strict=True)] for r, c in zip(up, down, strict=True)], np.int64).reshape(up.shape)


class Best:
    """The k best (score, id) of every query of one batch."""

    def __init__(self, rows, ids, floors, cells, k: int):
        import numpy as np

        self.rows, self.ids, self.floors, self.cells, self.k = rows, ids, floors, cells, k
        self.score = np.full((len(ids), k), LEAST, np.int64)
        self.doc = np.full((len(ids), k), MOST, np.int64)

    def threshold(self):
        import numpy as np

        return np.maximum(self.floors, self.score[:, -1])

    def take(self, rows, ids, cells) -> None:
        """Offer a block to the queries whose bound on it reaches their threshold."""
        import numpy as np

        bounds = _bounds(self.cells, cells.max(0, keepdims=True), cells.min(0, keepdims=True))[:, 0]
        mine = np.flatnonzero(bounds >= self.threshold())
        if not mine.size:
            return
        scores, docs = _dot(self.cells[mine], cells), np.broadcast_to(ids, (mine.size, len(ids)))
        own = self.rows[mine][:, None] == rows[None, :]
        scores, docs = np.where(own, LEAST, scores), np.where(own, MOST, docs)
        scores = np.concatenate((self.score[mine], scores), 1)
        docs = np.concatenate((self.doc[mine], docs), 1)
        best = np.lexsort((docs, -np.maximum(scores, LEAST + 1), scores == LEAST), axis=1)[:, : self.k]
        self.score[mine] = np.take_along_axis(scores, best, 1)
        self.doc[mine] = np.take_along_axis(docs, best, 1)


BLOCKS = "block long, ids binary, asks binary, cells binary, most binary, least binary"


def _blocks(rows: DataFrame, block_rows: int) -> DataFrame:
    """BLOCKS from sorted (id, v, asks). A row's number is its block's number plus its place."""

    def run(batches):
        import numpy as np
        import pyarrow as pa
        from pyspark import TaskContext

        first, held = TaskContext.get().partitionId() << 40, []

        def block():
            nonlocal first, held
            ids, vs, asks = zip(*held, strict=True)
            m = _matrix(vs)
            row = (first, np.array(ids, np.int64).tobytes(), np.array(asks, bool).tobytes(), m.tobytes(), m.max(0).tobytes(), m.min(0).tobytes())
            first, held = first + len(ids), []
            return pa.RecordBatch.from_arrays([pa.array([row[0]], pa.int64()), *(pa.array([x], pa.binary()) for x in row[1:])], ["block", "ids", "asks", "cells", "most", "least"])

        for batch in batches:
            for i, v, ask in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                held.append((i, np.nan_to_num(np.floor(SCALE * np.asarray(v, np.float64))), ask))
                if len(held) >= block_rows or len(held) * len(v) >= BLOCK_CELLS:
                    yield block()
        if held:
            yield block()

    return rows.mapInArrow(run, BLOCKS)


def _queries(blocks: DataFrame, k: int) -> DataFrame:
    """(row, id, cells, floor): every query, with its k-th score in its own block."""

    def run(batches):
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            out: list[tuple] = []
            for first, ids, asks, cells in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                at = np.flatnonzero(np.frombuffer(asks, bool))
                ids = np.frombuffer(ids, np.int64)
                m = _read(cells, len(ids))
                best = Best(first + at, ids[at], np.full(at.size, LEAST, np.int64), m[at], k)
                best.take(first + np.arange(len(ids)), ids, m)
                out += zip(best.rows.tolist(), best.ids.tolist(), (m[i].tobytes() for i in at.tolist()), best.score[:, -1].tolist(), strict=True)
            kinds = (pa.int64(), pa.int64(), pa.binary(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], t) for i, t in enumerate(kinds)], ["row", "id", "cells", "floor"])

    return blocks.where(F.instr(F.hex("asks"), "01") > 0).select("block", "ids", "asks", "cells").mapInArrow(run, "row long, id long, cells binary, floor long")


def _batches(queries: DataFrame, rows: int) -> DataFrame:
    """(batch, rows, ids, floors, cells) of queries that come sorted by row."""

    def run(batches):
        import numpy as np
        import pyarrow as pa

        held: list[tuple] = []

        def out():
            row, ids, cells, floors = zip(*held, strict=True)
            m = _matrix([np.frombuffer(c, np.float64) for c in cells])
            made = (row[0], *(np.array(x, np.int64).tobytes() for x in (row, ids, floors)), m.tobytes())
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array([made[0]], pa.int64()), *(pa.array([x], pa.binary()) for x in made[1:])], ["batch", "qrows", "qids", "floors", "qcells"])

        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                held.append(row)
                if len(held) >= rows:
                    yield out()
        if held:
            yield out()

    return queries.mapInArrow(run, "batch long, qrows binary, qids binary, floors binary, qcells binary")


def _extremes(blocks: DataFrame, together: int) -> DataFrame:
    """(pack, blocks, most, least): the extremes of several blocks."""

    def run(batches):
        import numpy as np
        import pyarrow as pa

        held: list[tuple] = []

        def out():
            number, most, least = zip(*held, strict=True)
            sides = [_matrix([np.frombuffer(x, np.float64) for x in side]).tobytes() for side in (most, least)]
            made = (number[0], np.array(number, np.int64).tobytes(), *sides)
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array([made[0]], pa.int64()), *(pa.array([x], pa.binary()) for x in made[1:])], ["pack", "blocks", "most", "least"])

        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                held.append(row)
                if len(held) >= together:
                    yield out()
        if held:
            yield out()

    return blocks.select("block", "most", "least").mapInArrow(run, "pack long, blocks binary, most binary, least binary")


def _reached(met: DataFrame) -> DataFrame:
    """(batch, block, bound): pairs in which a query's bound reaches its threshold; bound is the batch's largest."""

    def run(batches):
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            for b, floors, qcells, numbers, most, least in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                floors, numbers = np.frombuffer(floors, np.int64), np.frombuffer(numbers, np.int64)
                bounds = _bounds(_read(qcells, len(floors)), _read(most, len(numbers)), _read(least, len(numbers)))
                at = np.flatnonzero((bounds >= floors[:, None]).any(0))
                yield pa.RecordBatch.from_arrays([pa.array(np.full(at.size, b, np.int64)), pa.array(numbers[at]), pa.array(bounds.max(0)[at])], ["batch", "block", "bound"])

    return met.select("batch", "floors", "qcells", "blocks", "most", "least").mapInArrow(run, "batch long, block long, bound long")


def candidate_pairs(scratch: Scratch, vectors: DataFrame, asks: Column, k: int, key: str, vector: str, block_rows: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(blocks, batches of queries, pairs (batch, block, bound, slot) to be scored), all written."""
    parts = shuffle_partitions(vectors.sparkSession)
    v = F.col(vector)
    sound = F.col(key).isNotNull() & v.isNotNull() & F.forall(v, lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) < float("inf")), F.lit(False)))
    rows = vectors.where(sound).select(F.col(key).cast("long").alias("id"), v.cast("array<double>").alias("v"), F.coalesce(asks, F.lit(False)).alias("asks"))
    full = max(1, min(4 * parts, -(-rows.count() // (16 * block_rows))))  # no more tasks than there are blocks
    blocks = scratch.write(_blocks(rows.repartitionByRange(full, "id").sortWithinPartitions("id"), block_rows))
    queries = scratch.write(_queries(blocks, k))
    asked = max(1, min(parts, -(-queries.count() // QUERY_ROWS)))
    batches = scratch.write(_batches(queries.repartitionByRange(asked, "row").sortWithinPartitions("row"), QUERY_ROWS))
    packs = scratch.write(_extremes(blocks, EXTREMES))
    n_batches, n_packs = max(1, batches.count()), max(1, packs.count())
    # Packs of extremes are repeated per batch number; a batch has one number.
    numbered = batches.select("batch", "floors", "qcells", F.pmod(F.xxhash64("batch"), F.lit(n_batches)).alias("turn"))
    dealt = packs.withColumn("turn", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n_batches - 1).cast("long"))))
    met = numbered.join(dealt, "turn").repartition(max(1, min(parts, n_batches * n_packs)), "batch", "pack")
    slots = max(1, -(-4 * parts // n_batches))
    pairs = scratch.write(_reached(met).withColumn("slot", F.pmod(F.xxhash64("block"), F.lit(slots))))
    return blocks, batches, pairs


def top_inner_products(vectors: DataFrame, asks: Column, k: int = TOP, key: str = "vec_id", vector: str = "embedding", block_rows: int = BLOCK_ROWS) -> DataFrame:
    """(query_id, rank, vec_id, score) of the k best candidates of every row for which `asks` holds."""
    integral(vectors, key)
    scratch = Scratch(vectors.sparkSession, "topk")
    parts = shuffle_partitions(vectors.sparkSession)
    blocks, batches, pairs = candidate_pairs(scratch, vectors, asks, k, key, vector, block_rows)
    met = pairs.join(blocks.select("block", "ids", "cells"), "block").join(batches, "batch")
    met = met.repartition(parts, "batch", "slot").sortWithinPartitions("batch", "slot", F.desc("bound"), "block")

    def run(rows):
        import numpy as np
        import pyarrow as pa

        def out(best: Best):
            at = np.nonzero(best.score != LEAST)
            return pa.RecordBatch.from_arrays([pa.array(best.rows[at[0]]), pa.array(best.ids[at[0]]), pa.array(best.doc[at]), pa.array(best.score[at])], ["query", "query_id", "vec_id", "score"])

        best, now = None, None
        for batch in rows:
            for b, slot, qrows, qids, floors, qcells, block, ids, cells in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if (b, slot) != now:
                    if best is not None:
                        yield out(best)
                    qids = np.frombuffer(qids, np.int64)
                    best, now = Best(np.frombuffer(qrows, np.int64), qids, np.frombuffer(floors, np.int64), _read(qcells, len(qids)), k), (b, slot)
                ids = np.frombuffer(ids, np.int64)
                best.take(block + np.arange(len(ids)), ids, _read(cells, len(ids)))
        if best is not None:
            yield out(best)

    found = met.select("batch", "slot", "qrows", "qids", "floors", "qcells", "block", "ids", "cells").mapInArrow(run, "query long, query_id long, vec_id long, score long")
    order = Window.partitionBy("query").orderBy(F.desc("score"), "vec_id")
    ranked = found.withColumn("rank", F.row_number().over(order).cast("int")).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")


def op7_topk(spark, sf_dir: str) -> DataFrame:
    """query_id, rank, vec_id, score: queries are the rows whose vec_id is divisible by 100."""
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return top_inner_products(vectors, F.col("vec_id") % 100 == 0)


OP7_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS e
  FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id AS vec_id, CAST(list_sum(list_transform(list_zip(q.e, c.e), lambda p: p[1] * p[2])) AS BIGINT) AS score
  FROM v q JOIN v c ON c.vec_id <> q.vec_id
  WHERE q.vec_id % 100 = 0
), r AS (
  SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM s
)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 10"""
