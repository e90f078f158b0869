"""Mixing sources to target weights by capped water-filling, with seeded whole and fractional repetitions.

DataFrame functions only. Sizes are counted once per row. Sources are a table, however many there are: its rows are numbered
in code-point order, and the water level rises in rounds of one sum over those whose targets are not yet capped, in whole
numbers. A source's fractional repetition takes whole documents in the order of a seeded hash until its words are used up.
The cut is found on sums by hash bin, so only the rows of one bin per source are ordered, rows alike as one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import WORD, bounded, save, text_or_empty

WEIGHTS = (5, 2, 1)
MOST_EPOCHS = 3
#: Bins of a source at least; more where a bin would else hold over BIN_ROWS rows.
BINS = 4096
BIN_ROWS = 100_000
_EXACT = "decimal(38,0)"


def _named(name: str) -> Column:
    return F.col(name).cast("string")


def _hash(id_col: str, text_col: str, seed: int) -> Column:
    return F.xxhash64(F.lit(seed), F.col(id_col), text_or_empty(text_col))


def _words(name: str) -> Column:
    return F.regexp_count(text_or_empty(name), F.lit(WORD)).cast("long")


def _same(a: str, b: str) -> Column:
    return F.col(a).eqNullSafe(F.col(b))


def numbered(names: DataFrame) -> DataFrame:
    """The saved table names(source, ...) with no: 0, 1, ... in code-point order, null last."""
    sides = [names.filter("source is not null").repartitionByRange("source").sortWithinPartitions("source"), names.filter("source is null")]
    # a side's rows stand in order within a partition, partitions in order of their numbers, the second side's after the first's
    placed = sides[0].unionByName(sides[1]).withColumn("_at", F.monotonically_increasing_id())
    placed = save(placed.withColumn("_part", F.shiftright("_at", 33)), "mix-ordered")
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    parts = placed.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))  # a row per partition
    parts = save(parts.withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n"), "mix-parts")
    return placed.join(F.broadcast(parts), "_part").withColumn("no", F.col("_before") + F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))).drop("_at", "_part", "_before")


def water_fill(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, epochs: int = MOST_EPOCHS) -> DataFrame:
    """The saved table sizes(source, source_size) with target, whole (repetitions) and extra (words of a fraction of one).

    Targets share the sum of sizes by weight, none above epochs times its size; the excess is shared again by weight.
    """
    kind = F.element_at(F.array(*[F.lit(w) for w in weights]), (F.col("no") % len(weights) + 1).cast("int"))
    rows = save(numbered(sizes).withColumn("weight", kind.cast("long")), "mix-sources")
    left, weight = (x or 0 for x in rows.agg(F.sum(F.col("source_size").cast(_EXACT)), F.sum("weight")).first())
    total, everything, above = int(left), int(weight), (0, 0)
    left, weight = total, everything
    over = lambda left, weight: (F.col("weight") * F.lit(left).cast(_EXACT)) > (F.col("source_size") * F.lit(epochs * weight).cast(_EXACT))
    while weight:
        words, held = (int(x or 0) for x in rows.filter(over(left, weight)).agg(F.sum(F.col("source_size").cast(_EXACT)), F.sum("weight")).first())
        if (words, held) == above:
            break
        above, left, weight = (words, held), total - epochs * words, everything - held
    weight = max(weight, 1)
    level = rows.withColumn("capped", over(left, weight) | (F.col("source_size") == 0))
    level = level.withColumn("share", F.col("weight") * F.lit(left).cast(_EXACT)).withColumn("once", F.greatest(F.col("source_size"), F.lit(1)) * F.lit(weight).cast(_EXACT))
    level = level.withColumn("whole", F.when(F.col("source_size") == 0, 0).when(F.col("capped"), epochs).otherwise(F.expr("share div once")).cast("long"))
    rest = F.when(F.col("capped"), 0).otherwise(F.expr(f"((share - whole * once) * 2 + {weight}) div {2 * weight}")).cast("long")
    target = F.when(F.col("capped"), (F.col("source_size") * epochs).cast("double")).otherwise(F.col("share").cast("double") / weight)
    return save(level.select("source", "source_size", target.alias("target"), "whole", rest.alias("extra")), "mix-targets")


def _plan(docs: DataFrame, seed: int, weights, epochs: int, bins: int, id_col: str, text_col: str, source_col: str) -> tuple[DataFrame, DataFrame, DataFrame, int]:
    """(rows, plan, cut, bins): sizes and bins by row; targets by source, with the bin where a source's fraction ends; of the rows there, those alike as one, the words taken."""
    rows = docs.select(F.col(id_col).alias("doc_id"), _named(source_col).alias("source"), _words(text_col).alias("size"), _hash(id_col, text_col, seed).alias("h"))
    rows = save(rows, "mix-sizes")
    bins = max(bins, -(-rows.count() // BIN_ROWS))
    rows = rows.withColumn("bin", _bin("h", bins))
    by_bin = save(rows.groupBy("source", "bin").agg(F.sum("size").alias("words")), "mix-bins")
    sizes = save(by_bin.groupBy("source").agg(F.sum("words").alias("source_size")), "mix-sums")
    plan = water_fill(sizes, weights, epochs).withColumnRenamed("source", "p_source")
    w = Window.partitionBy("source").orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)
    ends = by_bin.withColumn("end", F.sum("words").over(w)).join(bounded(plan), _same("source", "p_source"))
    ends = ends.filter("extra > end - words and extra <= end").select(F.col("source").alias("c_source"), F.col("bin").alias("cut_bin"), (F.col("end") - F.col("words")).alias("before"))
    plan = plan.join(bounded(save(ends, "mix-ends")), _same("p_source", "c_source"), "left").drop("c_source")
    plan = save(plan.fillna({"cut_bin": -1, "before": 0}), "mix-plan")
    at_cut = rows.join(bounded(plan), _same("source", "p_source") & (F.col("bin") == F.col("cut_bin")))
    alike = at_cut.groupBy("source", "h", "doc_id", "size").agg(F.count(F.lit(1)).alias("n"), *[F.first(c).alias(c) for c in ("source_size", "target", "whole", "extra", "before")])
    order = Window.partitionBy("source").orderBy("h", "doc_id", "size").rowsBetween(Window.unboundedPreceding, 0)
    held = F.col("size") * F.col("n")
    upto = F.col("extra") - F.col("before") - (F.sum(held).over(order) - held)
    cut = alike.withColumn("part", F.greatest(F.lit(0), F.least(held, upto)))
    return rows, plan, save(cut, "mix-cut"), bins


def _bin(hashed: str, bins: int) -> Column:
    return F.pmod(F.xxhash64(hashed), F.lit(bins)).cast("int")


def mix(docs: DataFrame, seed: int = 42, weights: tuple[int, ...] = WEIGHTS, epochs: int = MOST_EPOCHS, bins: int = BINS, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """One row per input row: doc_id, size, source_size, target, taken.

    size: words between ASCII white space (null text: 0). Sources stand in code-point order, null last and apart from
    the empty name; they get the weights in turn. taken: words the mix takes, whole repetitions and a fraction of one,
    at most epochs times the size; a source's taken words sum to its target, rounded. A source of size 0 has target
    0. Rows are ordered by a hash of id and text, so rows that repeat an id (or have none) with other texts are rows like any other; rows
    alike in both share what falls to them in some order. An empty table gives an empty result; other columns are not looked at.
    """
    rows, plan, cut, _ = _plan(docs, seed, weights, epochs, bins, id_col, text_col, source_col)
    own = F.explode(F.sequence(F.lit(1).cast("long"), F.col("n")))  # rows alike: the first ones take the whole size, one the rest
    spread = cut.withColumn("i", own).withColumn("part", F.greatest(F.lit(0), F.least("size", F.col("part") - (F.col("i") - 1) * F.col("size"))))
    rest = rows.join(bounded(plan), _same("source", "p_source")).filter("bin <> cut_bin").withColumn("part", F.when(F.col("bin") < F.col("cut_bin"), F.col("size")).otherwise(F.lit(0)))
    taken = (F.col("whole") * F.col("size") + F.col("part")).cast("long").alias("taken")
    return spread.select("doc_id", "size", "source_size", "target", taken).unionByName(rest.select("doc_id", "size", "source_size", "target", taken))


def repeat_rows(docs: DataFrame, seed: int = 42, weights: tuple[int, ...] = WEIGHTS, epochs: int = MOST_EPOCHS, bins: int = BINS, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """docs with each row repeated as the mix has it, in whole documents, all columns as they were.

    A row whose fraction is half its size or more counts once more (rows alike in id, text and source together). Texts are not
    shuffled: each row finds its source's plan, and only rows of a source's last bin look up their own fraction.
    """
    _, plan, cut, bins = _plan(docs, seed, weights, epochs, bins, id_col, text_col, source_col)
    more = cut.filter((F.col("part") > 0) & (2 * F.col("part") >= F.col("size") * F.col("n"))).select(F.col("h").alias("_m_h"), F.col("source").alias("_m_source"), F.lit(1).alias("_m_more"))
    more = save(more.distinct(), "mix-more")
    plan = plan.select(F.col("p_source").alias("_p_source"), F.col("whole").alias("_p_whole"), F.col("cut_bin").alias("_p_cut"))
    plan = save(plan, "mix-named")
    hashed = docs.withColumn("_m_hash", _hash(id_col, text_col, seed)).withColumn("_m_bin", _bin("_m_hash", bins))
    binned = hashed.join(bounded(plan), _named(source_col).eqNullSafe(F.col("_p_source")))
    held = binned.join(bounded(more), (F.col("_m_bin") == F.col("_p_cut")) & (F.col("_m_hash") == F.col("_m_h")) & _named(source_col).eqNullSafe(F.col("_m_source")), "left")
    copies = F.col("_p_whole") + F.when(F.col("_m_bin") == F.col("_p_cut"), F.coalesce("_m_more", F.lit(0))).otherwise((F.col("_m_bin") < F.col("_p_cut")).cast("int"))
    return held.withColumn("_m_copy", F.explode(F.array_repeat(F.lit(0), copies.cast("int")))).select(*[docs[c] for c in docs.columns])
