"""SimHash near-dedup with a generalised pigeonhole search.

Bits are grouped by correlation into partitions, measured over all distinct fingerprints; how many partitions is chosen by the
estimated cost, which falls to fewer and wider ones as fingerprints grow in number. If thresholds of the
partitions sum to `distance - partitions + 1`, two fingerprints within the distance are within some partition's threshold there;
dynamic programming deals the thresholds out so that estimated signatures and candidates cost least. Each fingerprint is
indexed by its partitions' values and probes the values within the thresholds; candidates are verified on all bits.

Rows with one fingerprint are one node from the start. Buckets with many members are not paired off: all members are held
against pivots first, and only members that are not yet connected to most of their bucket are held against the rest.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .components import components
from .shared import bounded, save, small_batches, text_or_empty

WORDS = 4
SEED = 42
DISTANCE = 4
#: Numbers of partitions that are weighed against each other, and the most bits flipped in a probe's partition.
PARTS = (2, 3, 4, 5)
FLIPS = 2
#: Index members above which a bucket is worked on by pivots.
LARGE_BUCKET = 64
#: What a candidate costs against a signature row.
CANDIDATE_COST = 1.0


def shingle_hashes(text: str, words: int = WORDS, seed: int = SEED) -> Iterator[np.ndarray]:
    """XXH64 of the word shingles of a text, in blocks; a text with fewer words has one shingle, one without words none."""
    parts = text.encode().lower().split()
    if not parts:
        return
    joined = b" ".join(parts)
    ends = np.cumsum(np.fromiter(map(len, parts), np.int64, len(parts)) + 1) - 1
    n = max(1, len(parts) - words + 1)
    starts = np.concatenate([[0], ends[: n - 1] + 1]).tolist()
    ends = ends[min(words, len(parts)) - 1 :].tolist()
    hashed = xxhash.xxh64_intdigest
    for at in range(0, n, 1 << 16):
        yield np.array([hashed(joined[a:b], seed) for a, b in zip(starts[at : at + (1 << 16)], ends[at : at + (1 << 16)], strict=True)], np.uint64)


def fingerprint(text: str, words: int = WORDS) -> int:
    """The fingerprint of a text's shingles; 0 without words."""
    return fingerprint_of(shingle_hashes(text, words))


def fingerprint_of(blocks: Iterable[np.ndarray]) -> int:
    """A bit is set if it is set in over half the hashes, given in blocks; 0 without hashes."""
    total, n = np.zeros(64, np.int64), 0
    for hashes in blocks:
        bits = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        whole = len(bits) // 255 * 255
        total += bits[:whole].reshape(-1, 255, 64).sum(1, dtype=np.uint8).sum(0, dtype=np.int64) + bits[whole:].sum(0, dtype=np.int64)
        n += len(bits)
    return int(np.packbits(2 * total > n, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, words: int = WORDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, fp (the fingerprint as a signed long) of every whole text."""
    small_batches(docs.sparkSession)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            prints = np.array([fingerprint(x, words) for x in batch.column(1).to_pylist()], np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(prints.view(np.int64))], names=["doc_id", "fp"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), text_or_empty(text_col).alias("text")).mapInArrow(work, "doc_id long, fp long")


def bit_counts(prints: DataFrame) -> tuple[int, np.ndarray]:
    """(rows, 64 x 64 matrix of how often two bits are set together) of a table of fingerprints."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, n = np.zeros((64, 64)), 0
        for batch in batches:
            bits = np.unpackbits(np.asarray(batch.column(0)).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").astype(np.float32)
            total += bits.T @ bits
            n += len(bits)
        cells = np.append(total.astype(np.int64).ravel(), n)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(4097)), pa.array(cells)], names=["cell", "n"])

    rows = prints.select("fp").mapInArrow(work, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")).collect()
    cells = np.zeros(4097, np.int64)
    for r in rows:
        cells[r["cell"]] = r["n"]
    return int(cells[4096]), cells[:4096].reshape(64, 64)


def group_bits(n: int, together: np.ndarray, parts: int) -> list[list[int]]:
    """Bits in `parts` groups of near-equal size: each begins with the bit most correlated to others and takes its closest ones."""
    p = np.diag(together) / max(n, 1)
    spread = np.sqrt(np.maximum(p * (1 - p), 1e-12))
    close = np.abs((together / max(n, 1) - np.outer(p, p)) / np.outer(spread, spread))
    np.fill_diagonal(close, 0)
    left, out = list(range(64)), []
    for i in range(parts):
        size = -(-len(left) // (parts - i))
        group = [max(left, key=lambda b: (close[b, left].max(), -b))]
        left.remove(group[0])
        while len(group) < size:
            b = max(left, key=lambda b: (close[b, group].mean(), -b))
            group.append(b)
            left.remove(b)
        out.append(sorted(group))
    return out


def deal_thresholds(n: int, same: list[float], differ: list[list[float]], distance: int = DISTANCE, candidate_cost: float = CANDIDATE_COST) -> tuple[float, list[int]]:
    """(cost, a threshold for each partition, -1 for none) by dynamic programming on the estimated cost.

    same: the share of pairs alike in the partition; differ: for each of its bits the share of pairs that differ in it.
    Pairs within t bits are estimated from `same` times the odds of the bits that differ, as if bits were independent.
    """
    parts, n = len(same), max(n, 1)

    def cost(i: int, t: int) -> float:
        if t < 0:
            return 0.0
        sums = np.zeros(t + 1)
        sums[0] = 1
        for q in differ[i]:
            odds = q / max(1 - q, 1e-9)
            for j in range(t, 0, -1):
                sums[j] += sums[j - 1] * odds
        signatures = 1 + sum(comb(len(differ[i]), j) for j in range(t + 1)) / 2
        return n * signatures + candidate_cost * n * n / 2 * same[i] * sums.sum()

    best: dict[int, tuple[float, list[int]]] = {0: (0.0, [])}
    for i in range(parts):
        following: dict[int, tuple[float, list[int]]] = {}
        for total, (spent, dealt) in best.items():
            for t in range(-1, max(FLIPS, -(-(distance - parts + 1) // parts)) + 1):
                x = (spent + cost(i, t), [*dealt, t])
                if total + t not in following or x < following[total + t]:
                    following[total + t] = x
        best = following
    return best[distance - parts + 1]


def choose_groups(n: int, together: np.ndarray, distance: int = DISTANCE) -> list[list[int]]:
    """The groups of bits, of those for each number of partitions, that cost least if bits were independent."""
    differ = 2 * np.diag(together) / max(n, 1) * (1 - np.diag(together) / max(n, 1))

    def cost(groups: list[list[int]]) -> float:
        same = [float(np.prod(1 - differ[g])) for g in groups]
        return deal_thresholds(n, same, [differ[g].tolist() for g in groups], distance)[0]

    return min((group_bits(n, together, parts) for parts in PARTS if parts <= distance + 1), key=cost)


def signatures(nodes: DataFrame, groups: list[list[int]], thresholds: list[int]) -> tuple[DataFrame, DataFrame]:
    """(index rows, probe rows) of fingerprints: part, key, fp; a probe row also says whether it is the value itself.

    Of two values that differ, the one with the highest differing bit set probes the other's.
    """
    index, probes = [], []
    for part, (bits, t) in enumerate(zip(groups, thresholds, strict=True)):
        if t >= 0:
            value = F.col("fp").bitwiseAND(_long(sum(1 << b for b in bits)))
            index.append(F.struct(F.lit(part).alias("part"), value.alias("key")))
            probes.append(_probed(part, value, [(sum(1 << b for b in c), 1 << max(c)) for j in range(1, t + 1) for c in combinations(bits, j)]))
    indexed = nodes.select("fp", F.inline(F.array(*index)))
    probing = nodes.select("fp", F.inline(F.concat(*probes)))
    return indexed.select("part", "key", "fp"), probing.select("part", "key", "fp", "exact")


def _long(x: int) -> Column:
    """64 bits as a signed long literal."""
    return F.lit(x - (1 << 64) if x >= 1 << 63 else x).cast("long")


def _probed(part: int, value: Column, flips: list[tuple[int, int]]) -> Column:
    """The value itself and, for the flips (bits, highest bit) whose highest bit it has set, the value with those bits flipped."""
    own = F.array(F.struct(F.lit(part).alias("part"), value.alias("key"), F.lit(True).alias("exact")))
    if not flips:
        return own
    known = F.filter(F.array(*[F.struct(_long(m).alias("bits"), _long(top).alias("top")) for m, top in flips]), lambda x: value.bitwiseAND(x["top"]) != 0)
    return F.concat(own, F.transform(known, lambda x: F.struct(F.lit(part).alias("part"), value.bitwiseXOR(x["bits"]).alias("key"), F.lit(False).alias("exact"))))


def _apart(a: str, b: str) -> Column:
    return F.bit_count(F.col(a).bitwiseXOR(F.col(b)))


def link_prints(nodes: DataFrame, distance: int = DISTANCE, large_bucket: int = LARGE_BUCKET) -> DataFrame:
    """(node, root) of the saved table nodes(fp) of distinct fingerprints: components of the pairs within the distance. Nodes without such a pair are left out."""
    n, together = bit_counts(nodes)
    if n < 2:
        return nodes.select(F.col("fp").alias("node"), F.col("fp").alias("root")).limit(0)
    groups = choose_groups(n, together, distance)
    p = np.diag(together) / max(n, 1)
    masks = [sum(1 << b for b in g) for g in groups]
    values = nodes.select(F.inline(F.array(*[F.struct(F.lit(i).alias("part"), F.col("fp").bitwiseAND(_long(m)).alias("key")) for i, m in enumerate(masks)])))
    sizes = save(values.groupBy("part", "key").count(), "simhash-buckets")
    pairs = {r["part"]: r["pairs"] for r in sizes.groupBy("part").agg(F.sum(F.col("count").cast("double") * (F.col("count") - 1)).alias("pairs")).collect()}
    same = [max(pairs.get(i, 0.0) / max(n * (n - 1.0), 1.0), 2.0 ** -len(groups[i])) for i in range(len(groups))]
    _, thresholds = deal_thresholds(n, same, [[float(2 * p[b] * (1 - p[b])) for b in g] for g in groups], distance)
    index, probes = signatures(nodes, groups, thresholds)
    large = save(sizes.filter(F.col("count") > large_bucket).select("part", "key"), "simhash-large")
    if large.isEmpty():
        return components(_verified(index, probes, distance))
    large = bounded(large)
    edges = _verified(index.join(large, ["part", "key"], "left_anti"), probes.join(large, ["part", "key"], "left_anti"), distance)
    held = index.withColumn("exact", F.lit(True)).withColumn("indexed", F.lit(True)).unionByName(probes.withColumn("indexed", F.lit(False))).join(large, ["part", "key"])
    held = save(held, "simhash-held")
    pivots = held.filter("indexed").groupBy("part", "key").agg(F.min("fp").alias("p0"), F.max("fp").alias("p1"), *[F.min_by("fp", F.xxhash64("fp", F.lit(i))).alias(f"p{i}") for i in (2, 3)])
    starred = held.join(bounded(save(pivots, "simhash-pivots")), ["part", "key"]).select("fp", F.explode(F.array("p0", "p1", "p2", "p3")).alias("pivot"))
    stars = starred.filter((F.col("fp") != F.col("pivot")) & (_apart("fp", "pivot") <= distance)).select(F.col("fp").alias("a"), F.col("pivot").alias("b"))
    roots = save(components(edges.unionByName(stars)), "simhash-roots")
    named = held.join(roots.select(F.col("node").alias("fp"), "root"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    named = save(named, "simhash-named")
    shares = named.groupBy("part", "key", "root").count().groupBy("part", "key").agg(F.max_by("root", F.struct("count", "root")).alias("main"), F.count(F.lit(1)).alias("roots"))
    mixed = bounded(save(shares.filter("roots > 1").select("part", "key", "main"), "simhash-mixed"))
    rows = named.join(mixed, ["part", "key"])
    inside = lambda x: rows.filter(x).select("part", "key", F.col("fp").alias("i_fp"), F.col("root").alias("i_root"))
    around = lambda x: rows.filter(x).select("part", "key", F.col("fp").alias("p_fp"), F.col("root").alias("p_root"))
    close = (F.col("i_root") != F.col("p_root")) & (_apart("i_fp", "p_fp") <= distance)
    rest = [(inside("indexed"), around("not indexed and root <> main")), (inside("indexed and root <> main"), around("not indexed and root = main"))]
    more = [a.join(b, ["part", "key"]).filter(close).select(F.col("i_root").alias("a"), F.col("p_root").alias("b")) for a, b in rest]
    more = save(more[0].unionByName(more[1]).distinct(), "simhash-more")
    return components(roots.select(F.col("node").alias("a"), F.col("root").alias("b")).unionByName(more)) if not more.isEmpty() else roots


def _verified(index: DataFrame, probes: DataFrame, distance: int) -> DataFrame:
    """Edges (a, b) between different fingerprints within the distance that share a signature."""
    found = index.withColumnRenamed("fp", "a").join(probes.withColumnRenamed("fp", "b"), ["part", "key"])
    return found.filter((~F.col("exact") | (F.col("a") < F.col("b"))) & (_apart("a", "b") <= distance)).select("a", "b")


def near_copies(docs: DataFrame, distance: int = DISTANCE, words: int = WORDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, fp (signed long), component_id.

    A-Z lower-cased, words stand between ASCII white space; a text of fewer words than a shingle is one shingle, one
    without words (null, empty) has fingerprint 0 and is linked like any other. component_id is the smallest doc_id
    that is reachable over links of at most `distance` differing bits; a null doc_id counts only where no
    other is reachable. Rows that repeat a doc_id are rows like any other. An empty table gives an empty result.
    """
    prints = save(fingerprints(docs, words, id_col, text_col), "simhash-prints")
    nodes = save(prints.groupBy("fp").agg(F.min("doc_id").alias("first"), F.count(F.lit(1)).alias("copies")), "simhash-nodes")
    roots = save(link_prints(nodes, distance), "simhash-links")
    joined = nodes.join(roots.select(F.col("node").alias("fp"), "root"), "fp", "left")
    linked = joined.filter("root is not null")
    least = linked.groupBy("root").agg(F.min("first").alias("component_id"))
    known = linked.join(least, "root").select("fp", "component_id").unionByName(joined.filter("root is null and copies > 1").select("fp", F.col("first").alias("component_id")))
    known = save(known, "simhash-known").withColumn("found", F.lit(True))
    out = prints.join(bounded(known), "fp", "left")
    return out.select("doc_id", "fp", F.when(F.col("found"), F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"))
