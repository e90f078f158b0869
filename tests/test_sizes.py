"""Cases that showed on larger tables only: ties, classes of chunks, many copies, pools that are not built from pairs."""

import random

import __spark_entry__
from pyspark.sql import functions as F

from tidemark.operators import graph, metrics, ranking, retrieval
from tidemark.sources import stores


def run(spark, name, folder, **tables):
    """The rows of a registered query over tables made by hand."""
    for table, rows in tables.items():
        rows.coalesce(1).write.mode("overwrite").parquet(f"{folder}/{table}.parquet")
    return __spark_entry__.queries()[name](spark, str(folder)).collect()


def test_tied_filings(spark, tmp_path):
    orders = spark.createDataFrame([(3, 1, 9.0), (5, 1, 9.0), (4, 1, 2.0), (None, 1, 10.0), (7, 2, None)], "o_orderkey long, o_custkey long, o_totalprice double")
    orders = orders.selectExpr("*", "timestamp'2020-01-01' as o_orderdate", "'1-URGENT' as o_orderpriority")
    lines = spark.createDataFrame([(k, 1) for k in (3, 4, 5, 7)], "l_orderkey long, l_linenumber int")
    assert [tuple(r) for r in run(spark, "summary_expand", tmp_path, orders=orders, lineitem=lines)] == [(1, 3, 1)]


def vectors(spark):
    """Chunks with copies, vectors of two sizes, null, zero and broken ones; every third is a query as well."""
    draw = random.Random(3)
    rows = [(i, [draw.gauss(0, 1) for _ in range(3 if i % 11 else 2)], i % 4 if i % 7 else None, [2019 + i % 3]) for i in range(90)]
    rows = [(i, rows[5][1] if i % 10 == 5 else v, g, y) for i, v, g, y in rows] + [(90, [0.0, 0.0, 0.0], 1, [2019]), (91, None, 1, [2019]), (92, [1.0, None, 2.0], 1, [2019])]
    chunks = spark.createDataFrame(rows, "doc_id long, vec array<double>, grp int, c_years array<int>")
    asked = chunks.filter("doc_id % 3 = 0").select(F.struct("doc_id", F.lit(1).alias("no")).alias("qid"), F.col("doc_id").alias("q0"), F.col("vec").alias("qvec"), F.col("grp").alias("wanted"), F.array(F.lit(2019), F.lit(2020)).alias("years"))
    return asked, chunks


def test_filters_are_asked_by_class_and_not_by_pair(spark, monkeypatch):
    asked, chunks = vectors(spark)
    on, by = (F.col("grp") == F.col("wanted")) & F.arrays_overlap("years", "c_years"), (["wanted", "years"], ["grp", "c_years"])
    want = sorted(map(str, ranking.vector_top_k(asked, chunks, 4, on & (F.col("doc_id") != F.col("q0"))).collect()))
    got = ranking.vector_top_k(asked, chunks, 4, on, by, "q0")
    assert "Join" not in got._jdf.queryExecution().optimizedPlan().toString()
    assert sorted(map(str, got.collect())) == want and len(want) > 60
    monkeypatch.setattr(ranking, "TILE", 3)
    monkeypatch.setattr(ranking, "WAITING", 12)
    assert sorted(map(str, ranking.vector_top_k(asked, chunks, 4, on, by, "q0").collect())) == want
    monkeypatch.setattr(ranking, "MOST_CLASSES", 2)
    assert sorted(map(str, ranking.vector_top_k(asked, chunks, 4, on, by, "q0").collect())) == want


def test_only_questions_without_rows_are_searched_again(spark):
    asked = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 1.0])], "qid long, qvec array<double>")
    found = spark.createDataFrame([(1, 7)], "qid long, doc_id long")
    seen = []
    out = ranking.or_else(asked, found, lambda some: seen.append(some.collect()) or some.select("qid", F.lit(9).cast("long").alias("doc_id")))
    assert sorted(map(tuple, out.collect())) == [(1, 7), (2, 9)] and [r["qid"] for r in seen[0]] == [2]


def test_metrics_of_classes_make_no_pairs(spark):
    docs = spark.createDataFrame([(1, 0), (2, 0), (3, 0), (4, 1), (5, 2), (6, 2), (7, None)], "doc_id long, class int")
    asked = spark.createDataFrame([(1, 0), (4, 1), (5, 2), (7, None)], "qid long, class int")
    ranked = spark.createDataFrame([(1, 4, 1), (1, 2, 2), (4, 1, 1), (7, 1, 1)], "qid long, doc_id long, rank int")
    gold = asked.join(docs, "class").filter("qid <> doc_id").select("qid", "doc_id")
    want = sorted(map(tuple, metrics.ranking_metrics(ranked, gold, (1, 5)).collect()))
    assert sorted(map(tuple, metrics.class_metrics(ranked, asked, docs, (1, 5)).collect())) == want and len(want) == 2


def test_source_chunks_of_summaries_are_searched_and_not_listed(spark):
    chunks = spark.createDataFrame([(i, i, "A", [2019 + i % 2], [1.0, i / 50]) for i in range(1, 61)], "chunk_id long, doc_id long, ticker string, years array<int>, vec array<double>")
    summaries = spark.createDataFrame([(900, "A", [2019], [1.0, 0.1], [1, 2, 3, 4, 99]), (901, "A", [2020], [1.0, 0.9], list(range(3, 61)))], "summary_id long, ticker string, years array<int>, vec array<double>, source_ids array<long>")
    asked = spark.createDataFrame([(2, "How did it change?", [1.0, 0.04], ["A"], [2019, 2020])], "qid long, question string, qvec array<double>, tickers array<string>, years array<int>")
    got = retrieval.with_summaries(asked, chunks, summaries, 1, 4, 2)
    assert [r["chunk_id"] for r in got.orderBy("rank").collect()] == [3, 1, 4, 5]
    assert [r["chunk_id"] for r in retrieval.with_summaries(asked, chunks, summaries, 0, 1, 2).orderBy("rank").collect()] == [3, 1]


def test_ways_are_dealt_before_they_are_compared(spark):
    links = spark.createDataFrame([("a", "p", "b"), ("a", "p] b ←[p", "b"), ("c", "p", "b"), ("b", "p", "d"), ("b", "q", "d"), ("b", "r", "d"), ("b", "s", "d")], "subject string, predicate string, object string")
    seeds = spark.createDataFrame([(1, "a"), (1, "a"), (2, "c")], "qid long, seed string")
    found = graph.paths(seeds, graph.neighbours(links))
    got = {(r["qid"], r["node"], r["no"]): r["path"] for r in found.collect()}
    assert len(got) == found.count() and [got[2, "d", i] for i in (1, 2, 3)] == [f"c →[p] b | b →[{p}] d" for p in "pqr"] and (2, "d", 4) not in got
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "Aggregate [qid" not in plan.split("RepartitionByExpression")[0]
    again = graph.paths(spark.createDataFrame([(1, "x")], seeds.schema), spark.createDataFrame([("x", "y", "p", "→")] * 2, "node string, other string, predicate string, arrow string"))
    assert [tuple(r) for r in again.collect()] == [(1, "y", 1, "x →[p] y", 1)]


def test_sparse_scores_are_kept_in_the_task(spark, monkeypatch):
    draw = random.Random(5)
    rows = [(i, " ".join(draw.choices("abcdefgh", k=draw.randrange(1, 9)))) for i in range(60)] + [(60, None), (61, ""), (62, "zz"), (63, "a b"), (64, "A b")]
    texts = spark.createDataFrame(rows, "doc_id long, text string")
    items = spark.createDataFrame([("x", "a b"), ("y", "h h c q"), ("z", "nothing"), (None, "d")], "qid string, text string")
    asked, docs = stores.weights(items, "qid"), stores.weight_lists(texts, "doc_id")
    pairs = asked.join(stores.weights(texts, "doc_id").withColumnRenamed("w", "dw"), "feature").groupBy("qid", "doc_id").agg(F.round(F.sum(F.col("w") * F.col("dw")), 6).alias("score"))
    want = sorted(map(str, ranking.ranked(pairs, ["qid"], [F.desc("score"), F.col("doc_id")], 7).select("qid", "doc_id", "score", "rank").collect()))
    for most in (1 << 20, 20):
        monkeypatch.setattr(ranking, "WAITING", most)
        got = ranking.sparse_top_k(asked, docs, 7)
        assert sorted(map(str, got.select("qid", "doc_id", "score", "rank").collect())) == want and len(want) > 14
    assert "Aggregate" not in got._jdf.queryExecution().optimizedPlan().toString()


def test_edges_of_documents_in_one_row_are_not_compared(spark):
    names = "doc_id string, ticker string, filing_node string, form string, filing_date string, year string, section_node string, family string, comparison_group string"
    made = lambda i, filing, family: (str(i), "T", f"T F {filing}", "F", filing, "2020", f"{filing} {family}", family, f"F 2020 {family}")
    rows = [made(1, "2020-01-01", "x"), made(2, "2020-01-01", "x"), made(3, "2020-02-01", "y"), made(4, "2020-03-01", "x")]
    found = graph.document_edges(spark.createDataFrame(rows, names))
    got = sorted(map(tuple, found.collect()))
    assert len(got) == len(set(got)) == 36 + 2 * (1 + 2 + 2) and ("T F 2020-01-01", "has_next_same_company_form_filing", "T F 2020-02-01") in got
    twice = graph.document_edges(spark.createDataFrame([*rows, rows[1], made(1, "2020-02-01", "x")], names))
    again = sorted(map(tuple, twice.collect()))
    assert len(again) == len(set(again)) and set(again) >= {("1", "belongs_to_filing", "T F 2020-01-01"), ("1", "belongs_to_filing", "T F 2020-02-01")}
    some = graph.document_edges(spark.createDataFrame(rows, names), ["belongs_to_filing", "has_next_document_in_filing"])
    assert sorted(map(tuple, some.collect())) == [e for e in got if e[1] in ("belongs_to_filing", "has_next_document_in_filing")]
    assert "Aggregate" not in some._jdf.queryExecution().optimizedPlan().toString()
    assert found._jdf.queryExecution().optimizedPlan().toString().count("InMemoryRelation") == 4
