"""Near-dedup by Jaccard similarity of word shingles: SimHash, then MinHash bands find candidates, whole shingle sets decide.

Sets whose fingerprints the SimHash operator joins are held against one of them first. A fingerprint of 64 bits is too short for all pairs at
SIMILARITY (they differ in about 10 bits), so bands look for the rest: pairs that verified links of fingerprints do not connect yet.
Each text is its set of shingle hashes; texts with one set are one node. BANDS keys of ROWS minima each make the index: of
two sets alike to SIMILARITY, all keys differ with a chance of (1 - 0.8^5)^40, about 1e-7. Candidates whose sizes, then
whose minima, rule the similarity out are put aside (another 1e-8); the others' sets are intersected.

Buckets with many members are not paired off: all members are held against pivots first. Only members that are not yet
connected to most of their bucket are held against the rest, in blocks of whole sets that give one link per component met.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import components
from .exact import drop_keyed, keep_once, text_key
from .shared import bounded, kept, save, small_batches, text_or_empty
from .simhash import fingerprint_of, link_prints, shingle_hashes

WORDS = 5
#: Least similarity, as a fraction.
SIMILARITY = (4, 5)
BANDS, ROWS = 40, 5
#: Equal minima, of all, under which a pair's sets are not compared: six standard deviations below 0.8 of them.
LEAST_EQUAL = 126
#: Index members above which a bucket is worked on by pivots.
LARGE_BUCKET = 8
#: Sets, and shingles of them all, to a block of a crowd. They bound a task's memory; what is compared is the same for any values.
BLOCK_SETS, BLOCK_SHINGLES = 512, 1_000_000

_RNG = np.random.default_rng(5)
_TIMES, _PLUS = (_RNG.integers(0, 1 << 32, BANDS * ROWS, np.uint32) for _ in range(2))
_TIMES |= np.uint32(1)
_MIX, _BAND = _RNG.integers(0, 1 << 63, ROWS, np.uint64) * np.uint64(2) + np.uint64(1), _RNG.integers(0, 1 << 63, (BANDS, 1), np.uint64)


def shingle_set(text: str, words: int = WORDS) -> np.ndarray:
    """Sorted hashes of the distinct word shingles; A-Z lower-cased, a text of fewer words is one shingle, one without words has none."""
    found = list(shingle_hashes(text, words))
    return np.unique(np.concatenate(found)) if found else np.zeros(0, np.uint64)


def minima(hashes: np.ndarray) -> np.ndarray:
    """The least value of each of BANDS * ROWS hash functions over a set that is not empty."""
    short, out = (hashes >> np.uint64(32)).astype(np.uint32), np.full(BANDS * ROWS, 0xFFFFFFFF, np.uint32)
    for at in range(0, len(short), 1024):
        values = _TIMES[:, None] * short[at : at + 1024]
        values += _PLUS[:, None]
        np.minimum(out, values.min(1), out=out)
    return out


def band_keys(least: np.ndarray) -> np.ndarray:
    return (((least.reshape(BANDS, ROWS).astype(np.uint64) ^ _BAND) * _MIX).sum(1, dtype=np.uint64)).view(np.int64)


def alike(a: np.ndarray, b: np.ndarray) -> bool:
    """If two sorted sets' Jaccard similarity is SIMILARITY or more."""
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both * SIMILARITY[1] >= (len(a) + len(b) - both) * SIMILARITY[0]


def prints(docs: DataFrame, words: int = WORDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, digest (of the text), node (of the set), n (its size), fp (its fingerprint), keys, sketch (a byte of each minimum), hashes of every whole text."""
    small_batches(docs.sparkSession)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept("shingles", dict)  # nothing of the operators before stays in the worker
        for batch in batches:
            sets = [shingle_set(x, words) for x in batch.column(2).to_pylist()]
            least = [minima(x) if len(x) else None for x in sets]
            columns = [
                pa.array([xxhash.xxh64_intdigest(x.tobytes()) for x in sets], pa.uint64()).view(pa.int64()),
                pa.array([len(x) for x in sets], pa.int32()),
                pa.array([fingerprint_of(x[at : at + (1 << 16)] for at in range(0, len(x), 1 << 16)) for x in sets], pa.uint64()).view(pa.int64()),
                pa.array([[] if x is None else band_keys(x) for x in least], pa.list_(pa.int64())),
                pa.array([b"" if x is None else x.astype(np.uint8).tobytes() for x in least], pa.binary()),
                pa.array([x.tobytes() for x in sets], pa.binary()),
            ]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *columns], names=["doc_id", "digest", "node", "n", "fp", "keys", "sketch", "hashes"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_key(text_col).alias("digest"), text_or_empty(text_col).alias("text"))
    return rows.mapInArrow(work, "doc_id long, digest long, node long, n int, fp long, keys array<long>, sketch binary, hashes binary")


def _fetched(pairs: DataFrame, values: DataFrame, test) -> DataFrame:
    """The saved pairs (a, b) whose values, given by (node, value), pass the test of two lists of values."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            passed = test(batch.column(2).to_pylist(), batch.column(3).to_pylist())
            yield pa.RecordBatch.from_arrays(batch.columns[:2], names=["a", "b"]).filter(pa.array(passed, pa.bool_()))

    left = values.select(F.col("node").alias("a"), F.col("value").alias("value_a"))
    right = values.select(F.col("node").alias("b"), F.col("value").alias("value_b"))
    return left.join(bounded(pairs), "a").join(right, "b").select("a", "b", "value_a", "value_b").mapInArrow(work, "a long, b long")


def _equal_minima(a: list[bytes], b: list[bytes]) -> np.ndarray:
    x, y = (np.frombuffer(b"".join(v), np.uint8).reshape(len(v), BANDS * ROWS) for v in (a, b))
    return (x == y).sum(1) >= LEAST_EQUAL


def _alike(a: list[bytes], b: list[bytes]) -> list[bool]:
    return [alike(np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)) for x, y in zip(a, b, strict=True)]


def _verified(pairs: DataFrame, nodes: DataFrame, rows: DataFrame) -> DataFrame:
    """The pairs(a, b, n_a, n_b) of nodes that are alike, saved."""
    near = F.least("n_a", "n_b").cast("long") * SIMILARITY[1] >= F.greatest("n_a", "n_b").cast("long") * SIMILARITY[0]
    pairs = save(pairs.filter(near).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "near-pairs")
    likely = save(_fetched(pairs, nodes.select("node", F.col("sketch").alias("value")), _equal_minima), "near-likely")
    asked = save(likely.select(F.explode(F.array("a", "b")).alias("node")).distinct(), "near-asked")
    sets = save(rows.join(bounded(asked), "node", "left_semi").select("node", F.col("hashes").alias("value")).dropDuplicates(["node"]), "near-sets")
    return save(_fetched(likely, sets, _alike), "near-edges")


def _block_links(table: pa.Table) -> pa.Table:
    """(a, b): for each asking set and each other component in the block one set of it that is alike, if there is one; by exact counts."""
    asks = table.column("asks").to_numpy()
    node, root = table.column("node").to_numpy(), table.column("root").to_numpy()
    hashes = table.column("hashes").to_pylist()
    n = np.array([len(x) // 8 for x in hashes], np.int64)
    values, codes = np.unique(np.frombuffer(b"".join(hashes), np.uint64), return_inverse=True)
    sets, rest = np.split(codes, np.cumsum(n)[:-1]), np.flatnonzero(~asks)
    a, b = [], []
    if len(rest):
        held, starts = np.concatenate([sets[i] for i in rest]), np.concatenate(([0], np.cumsum(n[rest])[:-1]))
        of_a = np.zeros(len(values), bool)
        for i in np.flatnonzero(asks):
            of_a[sets[i]] = True
            both = np.add.reduceat(of_a[held], starts, dtype=np.int64)
            of_a[sets[i]] = False
            near = rest[(both * SIMILARITY[1] >= (n[i] + n[rest] - both) * SIMILARITY[0]) & (root[rest] != root[i])]
            met = near[np.unique(root[near], return_index=True)[1]]
            a += [node[i]] * len(met)
            b += node[met].tolist()
    return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})


def _crowd_links(left: DataFrame, rows: DataFrame) -> DataFrame:
    """Links, saved, of the members outside the main component of mixed buckets, left(key, node, n, root, main) saved, to members of other components.

    The buckets of one main component are a crowd. Its outside members are held against all its members: blocks of the one against blocks of the
    other, as many as sizes ask, dealt over the tasks. Work grows with outside members times members, rows with that over BLOCK_SETS.
    """
    crowd = save(left.groupBy("main", "node").agg(F.first("n").alias("n"), F.first("root").alias("root")), "near-crowd")
    blocks = lambda of: F.greatest(F.ceil(F.count_if(of) / BLOCK_SETS), F.ceil(F.sum(F.when(of, F.col("n").cast("long"))) / BLOCK_SHINGLES), F.lit(1)).cast("int")
    asks = F.col("root") != F.col("main")
    grid = save(crowd.groupBy("main").agg(blocks(asks).alias("high"), blocks(F.lit(True)).alias("wide")), "near-grid")
    nodes = save(crowd.select("node").distinct(), "near-asked")
    sets = save(rows.join(bounded(nodes), "node", "left_semi").select("node", "hashes").dropDuplicates(["node"]), "near-sets")
    placed = crowd.join(bounded(grid), "main")
    place = lambda n: F.pmod(F.xxhash64("node"), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    asking = placed.filter(asks).select("main", place("high").alias("i"), every("wide").alias("j"), F.lit(True).alias("asks"), "node", "root")
    asked = placed.select("main", every("high").alias("i"), place("wide").alias("j"), F.lit(False).alias("asks"), "node", "root")
    return save(asking.unionByName(asked).join(sets, "node").groupBy("main", "i", "j").applyInArrow(_block_links, "a long, b long"), "near-crowd-edges")


def _print_stars(nodes: DataFrame) -> DataFrame:
    """Pairs (a, b, n_a, n_b) of each node and the smallest one that the SimHash operator joins its fingerprint to."""
    roots = save(link_prints(save(nodes.select("fp").distinct(), "near-fingerprints")), "near-print-links")
    joined = nodes.select("node", "n", "fp").join(bounded(roots.select(F.col("node").alias("fp"), "root")), "fp", "left")
    joined = save(joined.select("node", "n", F.coalesce("root", "fp").alias("root")), "near-printed")
    centres = joined.groupBy("root").agg(F.min(F.struct("node", "n")).alias("centre"), F.count(F.lit(1)).alias("members")).filter("members > 1")
    stars = joined.join(bounded(save(centres.select("root", "centre"), "near-centres")), "root")
    return stars.select(F.col("node").alias("a"), F.col("n").alias("n_a"), F.col("centre.node").alias("b"), F.col("centre.n").alias("n_b")).filter("a <> b")


def link_sets(nodes: DataFrame, rows: DataFrame, large_bucket: int = LARGE_BUCKET) -> DataFrame:
    """(node, root) of the saved tables nodes(node, n, fp, keys, sketch) and rows(node, hashes): components of the pairs that are alike. Nodes without such a pair are left out."""
    printed = _verified(_print_stars(nodes), nodes, rows)
    seen = bounded(save(components(printed), "near-seen").withColumnRenamed("root", "seen"))
    index = nodes.select("node", "n", "keys").join(seen, "node", "left").select("node", "n", F.coalesce("seen", "node").alias("seen"), F.explode("keys").alias("key"))
    member = F.struct("node", "n", "seen")
    pivots = [F.min(member), F.max(member), *[F.min_by(member, F.xxhash64("node", F.lit(i))) for i in (2, 3)]]
    buckets = save(index.groupBy("key").agg(F.count(F.lit(1)).alias("members"), F.array(*pivots).alias("pivots")).filter("members > 1"), "near-buckets")
    held = save(index.join(bounded(buckets.select("key", "members")), "key"), "near-held")
    side = lambda df, x: df.select("key", F.col("node").alias(x), F.col("n").alias(f"n_{x}"), F.col("seen").alias(f"seen_{x}"))
    small = held.filter(F.col("members") <= large_bucket)
    pairs = side(small, "a").join(side(small, "b"), "key").filter("a < b and seen_a <> seen_b").select("a", "n_a", "b", "n_b")
    large = save(buckets.filter(F.col("members") > large_bucket).select("key", "pivots"), "near-large")
    if large.isEmpty():
        return components(printed.unionByName(_verified(pairs, nodes, rows)))
    crowd = held.filter(F.col("members") > large_bucket)
    stars = side(crowd, "a").join(bounded(large), "key").select("a", "n_a", "seen_a", F.inline("pivots").alias("b", "n_b", "seen_b")).filter("seen_a <> seen_b").select("a", "n_a", "b", "n_b")
    edges = printed.unionByName(_verified(pairs.unionByName(stars), nodes, rows))
    roots = save(components(edges), "near-roots")
    named = save(crowd.join(bounded(roots), "node", "left").withColumn("root", F.coalesce("root", "node")).select("key", "node", "n", "root"), "near-named")
    shares = named.groupBy("key", "root").count().groupBy("key").agg(F.max_by("root", F.struct("count", "root")).alias("main"), F.count(F.lit(1)).alias("roots"))
    mixed = bounded(save(shares.filter("roots > 1").select("key", "main"), "near-mixed"))
    left = save(named.join(mixed, "key"), "near-left")
    more = _crowd_links(left, rows)
    return components(edges.unionByName(more)) if not more.isEmpty() else roots


def find_near_copies(docs: DataFrame, words: int = WORDS, id_col: str = "doc_id", text_col: str = "text", large_bucket: int = LARGE_BUCKET) -> DataFrame:
    """One row per input row: doc_id, digest, keep_id, kept.

    Rows are linked where the Jaccard similarity of their shingle sets is SIMILARITY or more; those without words are alike. Of what is
    reachable over links the row with the smallest doc_id (the smallest digest of the text, if it has several) stays, one without doc_id
    only where no other has one. Rows equal in doc_id and text are flagged alike. An empty table gives an empty result.
    """
    rows = save(prints(docs, words, id_col, text_col), "near-prints")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "digest")).alias("first")
    nodes = save(rows.groupBy("node").agg(first, F.count(F.lit(1)).alias("copies"), *[F.first(c).alias(c) for c in ("n", "fp", "keys", "sketch")]), "near-nodes")
    roots = save(link_sets(nodes, rows, large_bucket), "near-links")
    joined = nodes.select("node", "first", "copies").join(bounded(roots), "node", "left")
    linked = joined.filter("root is not null")
    least = save(linked.groupBy("root").agg(F.min("first").alias("keep")), "near-least")
    known = linked.join(bounded(least), "root").select("node", "keep").unionByName(joined.filter("root is null and copies > 1").select("node", F.col("first").alias("keep")))
    known = save(known.select("node", F.col("keep.doc_id").alias("k_id"), F.col("keep.digest").alias("k_digest"), F.lit(True).alias("found")), "near-known")
    out = rows.select("doc_id", "digest", "node").join(bounded(known), "node", "left")
    kept = F.col("found").isNull() | (F.col("doc_id").eqNullSafe(F.col("k_id")) & (F.col("digest") == F.col("k_digest")))
    return out.select("doc_id", "digest", F.when(F.col("found"), F.col("k_id")).otherwise(F.col("doc_id")).alias("keep_id"), kept.alias("kept"))


def drop_near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with one row of each group of near copies, all columns as they were."""
    flags = save(find_near_copies(docs, id_col=id_col, text_col=text_col), "near-flags")
    out = drop_keyed(docs, flags.filter("not kept"), text_key(text_col), id_col)
    return keep_once(out, flags.filter("kept"), text_key(text_col), id_col)
