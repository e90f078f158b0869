"""Packing documents into sequences by Karmarkar-Karp multiway differencing.

Each document is tokenized once and cut by its own length alone: whole sequences, then a remainder in a large and a
small piece; the small ones let differencing even out the sequences. Pieces are dealt by hash to shards of about `windows` sequences, so a task packs a
bounded number of them whatever the corpus. In a shard, partial partitions with opposing imbalances are merged,
largest spread first; should the fullest sequence exceed the capacity, the shard gets one sequence more.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import save, small_batches
from .tokens import default_file, encoder

CAPACITY = 2048
#: The small piece is this part of a remainder.
TAIL = 20
WINDOWS = 512
#: Pieces of a shard, about: very short texts make many of them.
SHARD_PIECES = 1 << 17
END_ID = 1
VOCABULARY = "byte_bpe_50k.json"


def differencing(lengths: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(bin of each item, sum of each bin) of k near-equal bins, by the largest differencing method for k bins.

    A partial partition is the sums of its bins that hold items, in falling order, less the smallest once all k hold some.
    The two with the largest spread are merged again and again, one's largest sum with the other's smallest. Bins that
    meet become a node over both, so all partitions together never hold more numbers than there are items.
    """
    n = len(lengths)
    sums: list = [np.array([x], np.int64) for x in lengths]
    nodes: list = [np.array([i]) for i in range(n)]
    children = np.zeros((n, 2), np.int64)
    made = n
    heap = [(-int(x) if k > 1 else 0, i) for i, x in enumerate(lengths)]
    heapq.heapify(heap)
    while len(heap) > 1:
        (_, a), (_, b) = heapq.heappop(heap), heapq.heappop(heap)
        x, y, p, q = sums[a], sums[b][::-1], nodes[a], nodes[b][::-1]
        both = max(0, len(x) + len(y) - k)  # bins of a that get one of b's as well, the two in opposing order
        if both:
            alone = len(x) - both
            joined = np.arange(made, made + both)
            children[joined - n, 0], children[joined - n, 1] = p[alone:], q[:both]
            made += both
            total = np.concatenate([x[:alone], x[alone:] + y[:both], y[both:]])
            held = np.concatenate([p[:alone], joined, q[both:]])
        else:
            total, held = np.concatenate([x, y]), np.concatenate([p, q])
        order = np.argsort(-total, kind="stable")
        total, held = total[order], held[order]
        if len(total) == k:
            total = total - total[-1]
        sums[a], nodes[a], sums[b], nodes[b] = total, held, None, None
        heapq.heappush(heap, (-int(total[0]) if k > 1 else 0, a))
    bins = np.zeros(made, np.int64)
    if n:
        last = nodes[heap[0][1]]
        bins[last] = np.arange(len(last))
        for c in range(made - 1, n - 1, -1):
            bins[children[c - n]] = bins[c]
    bins = bins[:n]
    return bins, np.bincount(bins, weights=lengths, minlength=k).astype(np.int64) if n else np.zeros(k, np.int64)


def pack_lengths(lengths: np.ndarray, capacity: int = CAPACITY) -> np.ndarray:
    """The sequence of each piece: pieces as long as a sequence stand alone, the rest share as few as differencing can fill."""
    out = np.empty(len(lengths), np.int64)
    full = lengths >= capacity
    rest = lengths[~full]
    k = max(1, -(-int(rest.sum()) // capacity)) if len(rest) else 0
    while len(rest):
        bins, sums = differencing(rest, k)
        if sums.max() <= capacity:
            break
        k += 1
    if len(rest):
        out[~full] = bins
    out[full] = k + np.arange(full.sum())
    return out


def cuts(n: int, capacity: int = CAPACITY, tail: int = TAIL) -> list[tuple[int, int]]:
    """(start, length) of the pieces of a document of n ids."""
    whole, rest = divmod(n, capacity)
    small = rest // tail
    out = [(i * capacity, capacity) for i in range(whole)] + [(whole * capacity, rest - small), (n - small, small)]
    return [x for x in out if x[1]]


def tokenized_pieces(docs: DataFrame, vocabulary_file: str | None = None, capacity: int = CAPACITY, tail: int = TAIL, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Pieces of whole texts: doc_id, start, length, doc_tokens (with the end id), ids (little-endian unsigned 32-bit).

    A null text is the empty text: one piece of the end id alone. Rows are independent of each other: equal rows give
    equal pieces, a null doc_id stays null, an empty table gives no piece.
    """
    small_batches(docs.sparkSession)
    file = vocabulary_file or default_file(VOCABULARY)
    end = np.array([END_ID], "<u4").tobytes()

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(file)
        for batch in batches:
            held = ([], [], [], [], [])
            for doc_id, ids in zip(batch.column(0).to_pylist(), enc.encode([x or "" for x in batch.column(1).to_pylist()]), strict=True):
                ids += end
                n = len(ids) // 4
                for start, length in cuts(n, capacity, tail):
                    for column, x in zip(held, (doc_id, start, length, n, ids[4 * start : 4 * (start + length)]), strict=True):
                        column.append(x)
            yield pa.RecordBatch.from_arrays([*(pa.array(x, pa.int64()) for x in held[:4]), pa.array(held[4], pa.binary())], names=["doc_id", "start", "length", "doc_tokens", "ids"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(work, "doc_id long, start long, length long, doc_tokens long, ids binary")


def assign_sequences(pieces: DataFrame, capacity: int = CAPACITY, windows: int = WINDOWS) -> DataFrame:
    """The saved table pieces(doc_id, start, length, ...) with sequence_id and offset; a sequence is gapless from 0.

    A row's place in the table takes part in the draw of its shard, so that rows alike, however many, are spread.
    """
    total, rows = pieces.agg(F.sum(F.when(F.col("length") < capacity, F.col("length"))), F.count(F.lit(1))).first()
    shards = max(1, round((total or 0) / (windows * capacity)), -(-rows // SHARD_PIECES))
    others = [c for c in pieces.columns if c not in ("doc_id", "start", "length")]

    def work(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["length", "doc_id", "start", *others], ascending=[False] + [True] * (2 + len(others)), kind="stable").reset_index(drop=True)
        bins = pack_lengths(pdf["length"].to_numpy(np.int64), capacity)
        pdf["sequence_id"] = (int(key[0]) << 32) + bins
        pdf["offset"] = pdf.groupby("sequence_id")["length"].cumsum() - pdf["length"]
        return pdf.drop(columns="_shard")

    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in pieces.schema) + ", sequence_id long, offset long"
    dealt = pieces.withColumn("_shard", F.pmod(F.xxhash64("doc_id", "start", F.monotonically_increasing_id()), F.lit(shards)))
    return dealt.groupBy("_shard").applyInPandas(work, schema)


def pack(docs: DataFrame, **settings) -> DataFrame:
    """Sequences of whole texts, one row per piece: doc_id, start, length, doc_tokens, ids_crc32, sequence_id, offset.

    The pieces' ids are not carried through the packing; tokenized_pieces gives them by (doc_id, start).
    """
    pieces = tokenized_pieces(docs, **settings)
    placed = pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens")
    return assign_sequences(save(placed, "pack-pieces"))
