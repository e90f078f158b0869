"""Evidence coverage, greedy covers and context budgets."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .ranking import picked


def coverage(needed: DataFrame, evidence: DataFrame) -> DataFrame:
    """Per qid: units needed, supported, missing and whether all are supported, of needed(qid, unit) and evidence(qid, unit, doc_id)."""
    seen = needed.distinct().join(evidence.groupBy("qid", "unit").agg(F.count_distinct("doc_id").alias("docs")), ["qid", "unit"], "left")
    return seen.groupBy("qid").agg(F.count("unit").alias("needed"), F.count("docs").alias("supported"), F.sum(F.when(F.col("docs").isNull(), 1).otherwise(0)).alias("missing"), F.bool_and(F.col("docs").isNotNull()).alias("sufficient"))


def audit(needed: DataFrame, evidence: DataFrame) -> DataFrame:
    """Per qid of needed(qid, unit): found and missing units in order, evidence (unit -> ids in order) and whether all, and all but keypoints, are supported by evidence(qid, unit, chunk_id)."""
    ids = evidence.join(needed.distinct(), ["qid", "unit"]).groupBy("qid", "unit").agg(F.array_sort(F.collect_set("chunk_id")).alias("ids"))
    seen = needed.distinct().join(ids, ["qid", "unit"], "left")
    found, plain = F.col("ids").isNotNull(), ~F.col("unit").startswith("keypoint:")
    units = lambda on: F.array_sort(F.collect_list(F.when(on, F.col("unit"))))
    held = F.map_from_entries(F.array_sort(F.collect_list(F.when(found, F.struct("unit", "ids")))))
    return seen.groupBy("qid").agg(units(found).alias("found"), units(~found).alias("missing"), held.alias("evidence"), F.bool_and(found).alias("sufficient"), F.coalesce(F.bool_and(F.when(plain, found)), F.lit(True)).alias("metadata_sufficient"))


def audit_summary(audits: DataFrame, by: list[str]) -> DataFrame:
    """Of audits(found, missing, sufficient, recoveries, errors, seconds): questions, the share that is sufficient, mean missing units by kind, mean recovery queries, errors and seconds."""
    missing = lambda kind: F.round(F.avg(F.size(F.filter("missing", lambda u: u.startswith(kind)))), 6).alias(f"missing_{kind[:-1]}")
    return audits.groupBy(*by).agg(F.count(F.lit(1)).alias("questions"), F.round(F.avg(F.col("sufficient").cast("int")), 6).alias("sufficient_rate"), *map(missing, ("company:", "year:", "keypoint:")), F.round(F.avg("recoveries"), 6).alias("mean_recoveries"), F.sum("errors").alias("errors"), F.round(F.avg("seconds"), 6).alias("mean_seconds"))


def greedy_cover(candidates: DataFrame, n: int, needed: DataFrame | None = None) -> DataFrame:
    """n of candidates(qid, pos, doc_id, score, units) per qid: again and again the one with most new units, then the best score, then the earliest; the rest in input order.

    Only units that needed(qid, units) asks for count, where it is given. A qid's candidates are a bounded pool, so a group is small.
    """
    rows = candidates
    if needed is not None:
        rows = candidates.join(needed.select("qid", F.col("units").alias("_asked")), "qid", "left").withColumn("units", F.array_intersect("units", F.coalesce("_asked", F.array().cast("array<string>")))).drop("_asked")

    def pick(pool: list[dict]) -> list[dict]:
        units = [set(r["units"] or []) for r in pool]
        scores = [float("-inf") if r["score"] is None else r["score"] for r in pool]
        chosen, seen, left = [], set(), list(range(len(pool)))
        while len(pool) > n and left and len(chosen) < n:
            best = max(left, key=lambda i: (len(units[i] - seen), scores[i], -i))
            if not units[best] - seen:
                break
            chosen.append(best)
            seen |= units[best]
            left.remove(best)
        return [pool[i] for i in chosen + left[: max(0, n - len(chosen))]]

    return picked(rows.select("qid", "pos", "doc_id", "score", "units"), "qid", [F.col("pos"), F.col("doc_id")], pick, ["qid", "doc_id"], "slot")


def context_budget(blocks: DataFrame, budget: int, separator: int = 7) -> DataFrame:
    """Blocks (qid, pos, block) in order while the budget of characters lasts: chars taken of each, and the text.

    The last block is cut back to its last whole word. A blank or null block ends the context. Renderers charge different
    separators: 7 for answers and replays, 5, 2 or 0 elsewhere. No budget (0 or less) takes every block that is not blank.
    """
    if budget <= 0:
        return blocks.filter(F.trim("block") != "").select("qid", "pos", F.length("block").alias("chars"), F.col("block").alias("text"))
    w = Window.partitionBy("qid").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    length = F.length("block")
    blank = F.max(F.coalesce((F.trim("block") == "").cast("int"), F.lit(1))).over(w)
    before = F.sum(length + separator).over(w) - (length + separator)
    left = F.lit(budget) - F.col("_before")
    cut = F.left("block", left)
    word = F.rtrim(F.when(F.contains(cut, F.lit(" ")), F.regexp_replace(cut, "(?s) [^ ]*$", "")).otherwise(cut))
    text = F.when(length > left, word).otherwise(F.col("block"))
    return blocks.withColumn("_blank", blank).withColumn("_before", before).filter((F.col("_blank") == 0) & (F.col("_before") < budget)).select("qid", "pos", text.alias("text")).select("qid", "pos", F.length("text").alias("chars"), "text")


def pick_strips(strips: DataFrame, candidates: int = 36, most: int = 8) -> DataFrame:
    """Per qid the best of strips(qid, strip_id, overlap, score, ...), by overlap and 0.15 of a score above 0, ties in order of appearance.

    context_rank is the place among them; strips a model may choose from are those up to `candidates`, and without a model the first `most` are taken.
    """
    scored = strips.withColumn("selection", F.round(F.col("overlap") + 0.15 * F.greatest(F.lit(0.0), F.coalesce("score", F.lit(0.0))), 6))
    w = Window.partitionBy("qid").orderBy(F.desc("selection"), "strip_id")
    return scored.withColumn("context_rank", F.row_number().over(w)).filter(F.col("context_rank") <= candidates).withColumn("chosen", F.col("context_rank") <= most)
