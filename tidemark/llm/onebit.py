"""Approximate nearest neighbours by inner product over randomly rotated one-bit codes.

A vector, less a centre, is rotated and kept as the signs of its coordinates (packed bits) with correction scalars: its length,
its inner product with the centre and how well the signs align with it. Short vectors are turned by several rotations, one
after another, so that a code has about CODE_BITS bits. A query gets an estimate of each inner product and a bound of
the estimate's error from these alone; only vectors whose upper bound reaches a score that enough others are known to have are
compared exactly, on the original numbers in double precision.

The index is a table of blocks in the shared folder. Queries are a stated set; they go to all blocks in passes of a bounded
number, one pass after another. In a pass some of the blocks first prove a bar for each query, by exact scores of the vectors
with the best lower bounds; then all blocks are scanned, a tile of queries at a time, and what passes is compared where it is
found. A task holds the best of each query over all its blocks: its memory and its rows follow the queries of a pass, not the
vectors, nor how many of them are alike.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import bounded, save, small_batches, work_path

NEAREST = 20
#: Vectors in a block at most, and numbers of them all; numbers of a block's vectors that are compared at once.
BLOCK_ROWS, BLOCK_NUMBERS, PAIR_NUMBERS = 8192, 1 << 20, 1 << 21
#: Queries in a pass, and the most numbers they may hold: the size of what is broadcast.
PASS_QUERIES = 20_000
PASS_NUMBERS = 4_000_000
#: Vectors that the centre is the mean of at most.
CENTRE_ROWS = 4096
#: Bits of a code, about; rotations of a vector at most.
CODE_BITS, ROTATIONS = 512, 8
#: Width of the error bound, in standard deviations of the estimate. Bars are true scores, so a near vector is lost where its bound fails.
EPSILON = 3.5
#: Queries whose estimates for a block are held at once in a task.
TILE = 256
#: The bars come from one in so many partitions of the index, where it has many; rows of a block compared for them, times k.
PILOT, PROVING = 8, 4


def rotation(dim: int, seed: int = 42) -> np.ndarray:
    """Random orthogonal matrices side by side, scaled so that they keep lengths together."""
    rng, n = np.random.default_rng(seed), max(1, min(ROTATIONS, CODE_BITS // dim))
    turns = []
    for _ in range(n):
        q, r = np.linalg.qr(rng.normal(size=(dim, dim)))
        turns.append(q * np.sign(np.diag(r)))
    return np.concatenate(turns, axis=1) / np.sqrt(n)


def encode(vectors: np.ndarray, centre: np.ndarray, turn: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(packed sign bits, length less centre, inner product with the centre, alignment of the signs) of each vector."""
    moved = vectors - centre
    length = np.linalg.norm(moved, axis=1)
    turned = (moved / np.where(length > 0, length, 1)[:, None]) @ turn
    align = np.abs(turned).sum(1) / np.sqrt(turn.shape[1])
    return np.packbits(turned > 0, axis=1), length, vectors @ centre, np.where(length > 0, align, 1.0)


def scores(queries: np.ndarray, query: np.ndarray, vectors: np.ndarray, row: np.ndarray) -> np.ndarray:
    """Exact inner products of pairs, a bounded number of them at once; a pair gets the same bits wherever it is asked for."""
    out, step = np.empty(len(row)), max(1, PAIR_NUMBERS // vectors.shape[1])
    for a in range(0, len(row), step):
        part = slice(a, a + step)
        out[part] = (queries[query[part]] * vectors[row[part]]).sum(1)
    return out


def best_of(query: np.ndarray, ids: np.ndarray, score: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query, id, score) of the best k of each query, ties to the smaller id."""
    order = np.lexsort((ids, -score, query))
    query, ids, score = query[order], ids[order], score[order]
    best = np.arange(len(query)) - np.searchsorted(query, query) < k
    return query[best], ids[best], score[best]


class Scan:
    """One pass of queries over blocks of codes. bars: by query a score that k rows are known to reach; what it holds does not grow with the blocks."""

    def __init__(self, queries: np.ndarray, query_ids: np.ndarray, turn: np.ndarray, k: int, epsilon: float, bars: np.ndarray | None = None):
        self.queries, self.ids, self.k, self.epsilon = queries, query_ids, k, epsilon
        self.turned, self.norm = np.empty((len(queries), turn.shape[1]), np.float32), np.linalg.norm(queries, axis=1)
        for a in range(0, len(queries), TILE):
            self.turned[a : a + TILE] = queries[a : a + TILE] @ turn
        self.proven = np.full((len(queries), k), -np.inf)
        self.bars = np.full(len(queries), -np.inf) if bars is None else bars.copy()
        self.held: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}
        self.compared = 0

    def _tiles(self, ids: np.ndarray, packed: np.ndarray, length: np.ndarray, offset: np.ndarray, align: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(first query, estimates, their error bounds) of a block's rows, given in order of id, for TILE queries after another; a query's own id is estimated at -inf."""
        bits = self.turned.shape[1]
        signs = (2.0 * np.unpackbits(packed, axis=1, count=bits) - 1).astype(np.float32) / np.float32(np.sqrt(bits))
        around = np.sqrt(np.maximum(1 - align**2, 0)) / (align * np.sqrt(max(bits - 1, 1)))
        for a in range(0, len(self.ids), TILE):
            own, norm = self.ids[a : a + TILE], self.norm[a : a + TILE]
            estimate = (self.turned[a : a + TILE] @ signs.T) * (length / align) + offset
            error = norm[:, None] * (self.epsilon * length * around)[None, :]
            # rounding of single precision counts as an error as well
            error += 1e-5 * (np.abs(estimate) + norm[:, None] * length[None, :])
            first = np.searchsorted(ids, own, "left")
            for i in np.flatnonzero(first < np.searchsorted(ids, own, "right")):
                estimate[i, ids == own[i]] = -np.inf
            yield a, estimate, error

    def prove(self, ids: np.ndarray, codes: tuple, vectors: np.ndarray) -> None:
        """Compares each query with the PROVING * k rows of the block that have the best lower bounds.

        A row proves its score, but no more than its upper bound: who goes by upper bounds and then by scores does not lose it.
        """
        for a, estimate, error in self._tiles(ids, *codes):
            n, width = len(estimate), min(PROVING * self.k, len(ids))
            low = estimate - error
            best = np.argpartition(low, -width, axis=1)[:, -width:] if len(ids) > width else np.broadcast_to(np.arange(width), (n, width))
            found = scores(self.queries, np.repeat(np.arange(a, a + n), width), vectors, best.ravel()).reshape(n, width)
            both = np.concatenate([self.proven[a : a + n], np.minimum(found, np.take_along_axis(estimate + error, best, 1))], axis=1)
            self.proven[a : a + n] = np.partition(both, -self.k, axis=1)[:, -self.k :]

    def take(self, ids: np.ndarray, codes: tuple, vectors: np.ndarray) -> None:
        """Compares each query with the block's rows whose upper bounds reach its bar, and holds its best k so far."""
        for a, estimate, error in self._tiles(ids, *codes):
            own = slice(a, a + len(estimate))
            query, row = np.nonzero((estimate + error >= self.bars[own, None]) & (estimate > -np.inf))
            query += a
            score = scores(self.queries, query, vectors, row)
            self.compared += len(row)
            near = score >= self.bars[query]
            new = (query[near], ids[row[near]], score[near])
            if len(new[0]):
                self.held[a] = best_of(*(np.concatenate(x) for x in zip(self.held[a], new, strict=True)), self.k) if a in self.held else best_of(*new, self.k)
                query, _, score = self.held[a]
                last = np.searchsorted(query, query, "left") + self.k - 1 == np.arange(len(query))  # a query's k-th
                self.bars[query[last]] = np.maximum(self.bars[query[last]], score[last])


def _usable(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    v = F.col(vector_col).cast("array<double>")
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), v.alias("vector"))
    return rows.filter(F.col("vec_id").isNotNull() & F.coalesce(finite, F.lit(False)) & F.exists("vector", lambda x: x != 0))


def nearest(vectors: DataFrame, is_query, k: int = NEAREST, block_rows: int = BLOCK_ROWS, epsilon: float = EPSILON, id_col: str = "vec_id", vector_col: str = "embedding", compared: list | None = None) -> DataFrame:
    """query_id, rank (from 1), vec_id, score of each query's k nearest found by inner product, ties to the smaller vec_id.

    is_query: a condition on vec_id. Vectors that are null, empty, all zero or hold null or non-finite components, and
    rows without an id, take no part. Queries meet the vectors with as many components as they have. A query's own id is left out,
    other rows with its numbers are not; rows that repeat an id are candidates each, and where their id is a query's each has
    its own list. Fewer candidates than k give all of them; an empty table or no query gives no rows. To the list
    `compared` each pass adds its pairs compared exactly and its pairs of query and vector.
    """
    spark = vectors.sparkSession
    rows = save(_usable(vectors, id_col, vector_col), "onebit-vectors")
    small_batches(spark)
    out, written = work_path(spark, "onebit-nearest"), False
    for dim, n in sorted((r["dim"], r["count"]) for r in rows.groupBy(F.size("vector").alias("dim")).count().collect()):
        own = rows.filter(F.size("vector") == dim)
        asked = own.filter(is_query)
        passes = -(-asked.count() // max(1, min(PASS_QUERIES, PASS_NUMBERS // dim)))
        if not passes:
            continue
        drawn = np.array([r["vector"] for r in own.orderBy(F.xxhash64("vec_id"), "vec_id").limit(CENTRE_ROWS).collect()])
        centre, turn = drawn.mean(0), rotation(dim)
        size = max(1, min(block_rows, BLOCK_NUMBERS // dim))
        dealt = _thinned(own, k).repartition(-(-n // size), "vec_id").sortWithinPartitions("vec_id")
        index = save(_encoded(dealt, dim, centre, turn, size), "onebit-index")
        pilot = max(1, min(PILOT, index.count() // PILOT))
        for i in range(passes):
            some = asked.filter(F.pmod(F.xxhash64("vec_id"), F.lit(passes)) == i).orderBy("vec_id").collect()
            if some:
                ids, numbers = np.array([r["vec_id"] for r in some], np.int64), np.array([r["vector"] for r in some])
                _pass(index, pilot, ids, numbers, turn, k, epsilon, compared).write.mode("append").parquet(out)
                written = True
                if compared is not None:
                    compared[-1] = (compared[-1], len(ids) * n)
    schema = "query_id long, rank int, vec_id long, score double"
    return spark.read.schema(schema).parquet(out) if written else spark.createDataFrame([], schema)


def _thinned(rows: DataFrame, k: int) -> DataFrame:
    """rows without those that are never among the nearest, as more than k rows of other ids with the same numbers come before them.

    Of equal vectors stay the k + 1 smallest ids, of which one may be a query's own, and of one id with equal vectors k rows.
    """
    mark = F.xxhash64("vector").alias("mark")
    many = save(rows.groupBy(mark).count().filter(F.col("count") > k + 1).select("mark"), "onebit-alike")
    if many.isEmpty():
        return rows
    marked, many = rows.withColumn("mark", mark), bounded(many)
    alike = marked.join(many, "mark", "left_semi").withColumn("nth", F.row_number().over(Window.partitionBy("vector", "vec_id").orderBy("mark"))).filter(F.col("nth") <= k)
    alike = alike.withColumn("nth", F.dense_rank().over(Window.partitionBy("vector").orderBy("vec_id"))).filter(F.col("nth") <= k + 1)
    return save(marked.join(many, "mark", "left_anti").select("vec_id", "vector").unionByName(alike.select("vec_id", "vector")), "onebit-thinned")


def _encoded(rows: DataFrame, dim: int, centre: np.ndarray, turn: np.ndarray, block_rows: int) -> DataFrame:
    """Index blocks: one row for up to so many vectors, with ids, packed bits, scalars and numbers as binary columns."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, block = [], TaskContext.get().partitionId() << 32

        def made() -> pa.RecordBatch:
            table = pa.Table.from_batches(held)
            ids = table.column(0).to_numpy().astype(np.int64)
            x = table.column(1).combine_chunks().flatten().to_numpy().astype(np.float64).reshape(-1, dim)
            parts = (ids, *encode(x, centre, turn), x)
            return pa.RecordBatch.from_arrays([pa.array([block], pa.int64()), *(pa.array([a.tobytes()], pa.binary()) for a in parts)], names=["block", "ids", "bits", "length", "offset", "align", "vectors"])

        for batch in batches:
            for at in range(0, batch.num_rows, block_rows):
                held.append(batch.slice(at, block_rows))
                if sum(x.num_rows for x in held) >= block_rows:
                    yield made()
                    held, block = [], block + 1
        if held:
            yield made()

    return rows.select("vec_id", "vector").mapInArrow(work, "block long, ids binary, bits binary, length binary, offset binary, align binary, vectors binary")


def _pass(index: DataFrame, pilot: int, query_ids: np.ndarray, queries: np.ndarray, turn: np.ndarray, k: int, epsilon: float, compared: list | None) -> DataFrame:
    """query_id, rank, vec_id, score of one pass of queries.

    The blocks of each pilot-th partition prove a bar for each query; then all blocks are scanned against the bars, so a task
    gives a query k rows at most and all tasks together about k times pilot, however many rows are near.
    """
    context, width = index.sparkSession.sparkContext, turn.shape[1]
    sent = context.broadcast((query_ids, queries))  # at most PASS_NUMBERS numbers

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, tuple, np.ndarray]]:
        for batch in batches:
            for i in range(batch.num_rows):
                line = {name: batch.column(name)[i].as_buffer() for name in ("ids", "bits", "length", "offset", "align", "vectors")}
                own = np.frombuffer(line["ids"], np.int64)
                bits = np.frombuffer(line["bits"], np.uint8).reshape(len(own), -(-width // 8))
                yield own, (bits, *(np.frombuffer(line[c]) for c in ("length", "offset", "align"))), np.frombuffer(line["vectors"]).reshape(len(own), -1)

    def prove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, numbers = sent.value
        scan = None
        for block in blocks(batches):
            scan = scan or Scan(numbers, ids, turn, k, epsilon)
            scan.prove(*block)
        if scan:
            yield pa.RecordBatch.from_arrays([pa.array([scan.proven.tobytes()], pa.binary())], names=["proven"])

    def best_proven(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = None
        for batch in batches:
            for x in batch.column(0).to_pylist():
                proven = np.frombuffer(x).reshape(-1, k)
                best = proven if best is None else np.partition(np.concatenate([best, proven], axis=1), -k, axis=1)[:, -k:]
        if best is not None:
            yield pa.RecordBatch.from_arrays([pa.array([best.tobytes()], pa.binary())], names=["proven"])

    some = index.filter(F.shiftright("block", 32) % pilot == 0)
    proven = some.drop("block").mapInArrow(prove, "proven binary").repartition(8).mapInArrow(best_proven, "proven binary").collect()  # 8 rows
    bars = np.full(len(query_ids), -np.inf)
    if proven:
        bars = np.partition(np.concatenate([np.frombuffer(r["proven"]).reshape(-1, k) for r in proven], axis=1), -k, axis=1)[:, -k]
    level = context.broadcast(bars)

    def take(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, numbers = sent.value
        scan = Scan(numbers, ids, turn, k, epsilon, level.value)
        for block in blocks(batches):
            scan.take(*block)
        names = ["query", "query_id", "vec_id", "score", "compared"]
        yield pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip((None, None, None, None, scan.compared), (pa.int32(), pa.int64(), pa.int64(), pa.float64(), pa.int64()), strict=True)], names=names)
        for query, near, score in scan.held.values():
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in (query.astype(np.int32), ids[query], near, score, np.zeros(len(query), np.int64))], names=names)

    found = save(index.drop("block").mapInArrow(take, "query int, query_id long, vec_id long, score double, compared long"), "onebit-found")
    if compared is not None:
        compared.append(found.agg(F.sum("compared")).first()[0] or 0)
    for x in (sent, level):
        x.unpersist()
    order = Window.partitionBy("query").orderBy(F.desc("score"), "vec_id")
    return found.filter("query is not null").withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
