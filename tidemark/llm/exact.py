"""Exact dedup on an extendible-hash index in shared files.

DataFrame functions only. Postings (id, key, digest) are written once per row. Their keys form the index: buckets are ranges
of keys, named by a prefix of bits; each overfull bucket is split in two, as the directory doubles, until none is left. What
the index tells of a key decides its rows: a key met once is done; the texts of the others go to the owner tasks of
their buckets' ranges, which chain the texts of one key and compare them byte by byte, so two texts with one key stay
apart. The copies of a hot key are combined by slices before they go there.
"""

from __future__ import annotations

from functools import reduce
from math import log2

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import BROADCAST_KEYS, SPACES, bounded, save, text_or_empty

#: Keys in a bucket before it splits.
BUCKET_KEYS = 4096
#: Rows of a key above which its texts are combined by slices of rows before an owner gets them.
HOT, SLICES = 64, 16
#: Bits of a key.
BITS = 64


def normalised(name: str = "text") -> Column:
    return F.regexp_replace(text_or_empty(name), SPACES, " ")


def slot_of(key: str, depth: int) -> Column:
    """The first bits of a key, the others zero: the least key of its bucket at that depth, in the order of unsigned numbers."""
    return F.shiftleft(F.shiftrightunsigned(F.col(key), BITS - depth), BITS - depth) if depth else F.lit(0).cast("long")


def build_index(keys: DataFrame, bucket_keys: int = BUCKET_KEYS) -> DataFrame:
    """The index files' rows (bucket, depth, key, copies) of a saved table of distinct keys, in buckets of at most so many keys.

    The directory starts at the greatest depth at which buckets are full on average. Each round counts the keys of the
    open buckets, closes those that hold no more than their capacity and splits the others by one bit more.
    """
    n, closed, open_ = keys.count(), [], keys
    depth = max(0, int(log2(max(n, 1) / bucket_keys)))
    while True:
        placed = open_.withColumn("bucket", slot_of("key", depth)).withColumn("depth", F.lit(depth))
        full = save(placed.groupBy("bucket").count().filter(F.col("count") > bucket_keys).select("bucket"), "exact-overfull")
        if depth == BITS or full.isEmpty():
            break
        closed.append(placed.join(bounded(full), "bucket", "left_anti"))
        open_ = placed.join(bounded(full), "bucket", "left_semi").select(*keys.columns)
        depth += 1
    rows = reduce(DataFrame.unionByName, [*closed, placed]).select("bucket", "depth", "key", "copies")
    return rows.repartitionByRange("bucket", "key").sortWithinPartitions("bucket", "key")


def chained(members: DataFrame) -> DataFrame:
    """Groups (key, text, keep_id, group_size) of members(bucket, key, copies, doc_id, text), by owner tasks of bucket ranges.

    An owner holds all texts of a key. In their order, each is compared with the one before it: a text that differs begins
    the next link of the key's chain.
    """
    hot = members.filter(F.col("copies") > HOT).withColumn("slice", F.pmod(F.xxhash64("doc_id"), F.lit(SLICES)))
    hot = hot.groupBy("slice", "bucket", "key", "text").agg(F.min("doc_id").alias("first"), F.count(F.lit(1)).alias("n")).drop("slice")
    cold = members.filter(F.col("copies") <= HOT).select("bucket", "key", "text", F.col("doc_id").alias("first"), F.lit(1).cast("long").alias("n"))
    owned = cold.unionByName(hot.select(*cold.columns)).repartitionByRange("bucket", "key")
    chain = Window.partitionBy("bucket", "key").orderBy("text")
    begins = owned.withColumn("begins", F.coalesce((F.col("text") != F.lag("text").over(chain)).cast("int"), F.lit(1)))
    links = begins.withColumn("link", F.sum("begins").over(chain.rowsBetween(Window.unboundedPreceding, 0)))
    sized = links.withColumn("sha", F.when(F.col("begins") == 1, F.unhex(F.sha2(F.col("text").cast("binary"), 256)))).drop("text")
    return sized.groupBy("bucket", "key", "link").agg(F.max("sha").alias("sha"), F.min("first").alias("keep_id"), F.sum("n").alias("group_size"))


def find_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", bucket_keys: int = BUCKET_KEYS, key_bits: int = BITS) -> DataFrame:
    """One row per input row: doc_id, keep_id, group_size, kept, text_sha256 (binary digest of the normalised text).

    Texts are equal when identical after each run of ASCII white space is replaced by one space. A null text is the
    empty text, which is a text like any other: rows without text form one group. Of a group, the row with the
    smallest doc_id stays; a row without doc_id stays only if no row of its group has one. Rows that repeat one doc_id with equal texts
    are counted in group_size and flagged alike (drop_copies keeps one of them). An empty table gives an empty
    result; columns other than the two named are not looked at. Fewer key_bits make keys collide more often, with the same result.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    keyed = rows.select("doc_id", normalised().alias("text")).withColumn("key", F.shiftleft(F.xxhash64("text"), BITS - key_bits))
    postings = save(keyed.select("doc_id", "key", F.unhex(F.sha2(F.col("text").cast("binary"), 256)).alias("sha")), "exact-postings")
    keys = save(postings.groupBy("key").agg(F.count(F.lit(1)).alias("copies")), "exact-keys")
    index = save(build_index(keys, bucket_keys), "exact-index")
    again = index.filter("copies > 1").select("bucket", "key", "copies")
    groups = save(chained(keyed.join(bounded(again, BROADCAST_KEYS), "key")).select("key", "sha", "keep_id", "group_size"), "exact-groups")
    found = postings.join(bounded(groups), ["key", "sha"], "left")
    keep = F.when(F.col("group_size").isNull(), F.col("doc_id")).otherwise(F.col("keep_id"))
    return found.select(
        "doc_id",
        keep.alias("keep_id"),
        F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"),
        F.col("doc_id").eqNullSafe(keep).alias("kept"),
        F.col("sha").alias("text_sha256"),
    )


def text_key(text_col: str = "text") -> Column:
    """What a row's decision is found by, besides its id: 64 bits of its text."""
    return F.xxhash64(text_or_empty(text_col))


def _matched(docs: DataFrame, rows: DataFrame, digest: Column, id_col: str, how: str) -> DataFrame:
    """docs joined with the saved table rows(doc_id, digest): ids are equal or both null, and the texts' digests are equal."""
    keys = bounded(rows.select(F.col("doc_id").alias("_key_id"), F.col("digest").alias("_key_digest")), BROADCAST_KEYS)
    return docs.join(keys, F.col(id_col).eqNullSafe(F.col("_key_id")) & (digest == F.col("_key_digest")), how)


def drop_keyed(docs: DataFrame, dropped: DataFrame, digest: Column, id_col: str = "doc_id") -> DataFrame:
    """docs without the rows whose id, null or not, and digest are together in the saved table dropped(doc_id, digest)."""
    return _matched(docs, dropped, digest, id_col, "left_anti")


def keep_once(docs: DataFrame, kept: DataFrame, digest: Column, id_col: str = "doc_id") -> DataFrame:
    """docs with one of the rows that stand several times in kept(doc_id, digest), which names each row once."""
    again = save(kept.groupBy("doc_id", "digest").count().filter("count > 1").select("doc_id", "digest"), "kept-again")
    if again.isEmpty():
        return docs
    once = _matched(docs, again, digest, id_col, "left_semi").withColumn("_digest", digest).dropDuplicates([id_col, "_digest"]).drop("_digest")
    return _matched(docs, again, digest, id_col, "left_anti").unionByName(once)


def drop_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", unnamed: bool = False) -> DataFrame:
    """docs with one row of each group of equal texts, all columns as they were.

    Where a kept doc_id was given several times with one text, one of those rows stays. Rows with a null doc_id stay,
    or with unnamed are dropped and kept once like any other.
    """
    flags = save(find_copies(docs, id_col, text_col).select("doc_id", "kept", F.xxhash64("text_sha256").alias("digest")), "exact-flags")
    if not unnamed:
        flags = flags.filter("doc_id is not null")
    digest = F.xxhash64(F.unhex(F.sha2(normalised(text_col).cast("binary"), 256)))
    return keep_once(drop_keyed(docs, flags.filter("not kept"), digest, id_col), flags.filter("kept"), digest, id_col)
