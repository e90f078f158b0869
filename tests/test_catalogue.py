"""Hand-computed cases of the retrieval, text and metric operators."""

from pyspark.sql import functions as F

from tidemark.functions import temporal, text
from tidemark.operators import evidence, metrics, predicates, ranking


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def test_windows(spark):
    words = " ".join(f"w{i}" for i in range(513))
    got = one(spark, text.token_windows(F.lit(words)))
    assert [(w["token_start"], w["token_end"]) for w in got] == [(0, 512), (448, 513)]
    assert [(w["token_end"], w["chunk"]) for w in one(spark, text.token_windows(F.lit(" — ")))] == [(0, "—")]


def test_titles_and_periods(spark):
    meta = one(spark, temporal.filing_meta(F.lit("AB_2022-05-23_10-K_12_item_101_x")))
    assert (meta["ticker"], meta["year"], meta["section"], meta["family"]) == ("AB", "2022", "Item 1.01: x", "Item 1.01")
    assert one(spark, temporal.filing_meta(F.lit("AB_soon_8-K")))["filing_date"] == "unknown-date"
    window = one(spark, temporal.relative_window(F.lit(1), F.lit("quarter"), F.lit("2024-12-31").cast("date")))
    assert str(window["start"]) == "2024-10-31"


def test_metrics(spark):
    ranked = spark.createDataFrame([(1, 7, 1), (1, 8, 2), (1, 9, 3)], "qid long, doc_id long, rank int")
    gold = spark.createDataFrame([(1, 7), (1, 9), (2, 1)], "qid long, doc_id long")
    got = {r["qid"]: r for r in metrics.ranking_metrics(ranked, gold, (5,)).collect()}
    assert abs(got[1]["precision_5"] - 2 / 3) < 1e-6 and got[1]["mrr"] == 1 and got[2]["mrr"] == 0
    rows = spark.createDataFrame([("s", x) for x in (1.0, 2.0, 10.0)], "system string, ms double")
    assert tuple(metrics.latency_summary(rows, "system", "ms").first())[3:] == (2.0, 9.2)


def test_fusion_cover_and_filters(spark):
    rows = spark.createDataFrame([(1, 0, 5, 1, 0.0), (1, 0, 6, 1, -0.1)], "qid long, branch int, doc_id long, rank int, score double")
    assert [r["doc_id"] for r in ranking.reciprocal_rank_fusion(rows).orderBy("rank").collect()] == [6, 5]
    pool = spark.createDataFrame([(1, i, i, 0.5, [i // 2]) for i in range(4)], "qid long, pos int, doc_id long, score double, units array<int>")
    assert [r["doc_id"] for r in evidence.greedy_cover(pool, 2).orderBy("slot").collect()] == [0, 2]
    where = predicates.compile_where(predicates.all_of([{"pos": {"$in": [1, 2]}}, None, {"doc_id": {"$eq": 2}}]))
    assert pool.filter(where).count() == 1 and predicates.any_of([]) is None
