"""Hand-computed cases of the cue, period, selection and resolution operators, of sources and of streaming."""

import json

import pytest
from pyspark.sql import functions as F

from tidemark.functions import rules, temporal, text
from tidemark.operators import ranking, selection
from tidemark.sources import readers
from tidemark.streaming.ingest import as_of, ingest, replace_summaries


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def test_rules(spark):
    assert one(spark, rules.metrics_in(F.lit("Net Sales, EPS"))) == ["revenue / sales", "earnings per share"]
    assert one(spark, rules.intent(F.lit("total risk"))) == "risk" and one(spark, rules.intent(F.lit(""))) == "lookup"
    boost = rules.section_form_boost(F.lit("quarterly bonus"), F.lit("X_salary"), F.lit("bonus"), F.lit("10-q"))
    assert abs(one(spark, boost) - 0.16) < 1e-9
    assert one(spark, rules.is_broad(F.lit("x"), F.array(F.lit(2020), F.lit(2021))))


def test_periods(spark):
    got = one(spark, temporal.reporting_periods(F.lit("the quarter ended March 31, 2024, and the QUARTER ended March 31, 2024")))
    assert [(p["type"], str(p["end"])) for p in got] == [("quarter", "2024-03-31")]
    assert one(spark, temporal.iso_date(F.lit("February 30 2024"))) is None and one(spark, temporal.period_type(F.lit("six months"))) == "semiannual"
    assert tuple(one(spark, temporal.relative_phrase(F.lit("past two quarters")))) == (2, "quarter")
    assert one(spark, temporal.relative_phrase(F.lit("never"))) is None
    assert one(spark, text.alias_variants(F.lit("Acme Holdings, Inc."))) == ["acme holdings inc", "acme holdings", "acme"]
    assert one(spark, text.json_in(F.lit("no"))) is None and one(spark, text.chunk_index(F.lit("d::chunk_0012"))) == 12


def test_vector_blocks(spark, monkeypatch):
    rows = spark.createDataFrame([(i, [float(i), 1.0]) for i in range(7)] + [(9, [0.0, 0.0])], "doc_id long, vec array<double>")
    asked = rows.withColumnsRenamed({"doc_id": "qid", "vec": "qvec"})
    want = sorted(map(tuple, ranking.vector_top_k(asked, rows, 3).collect()))
    monkeypatch.setattr(ranking, "BROADCAST_QUERIES", 3)
    assert sorted(map(tuple, ranking.vector_top_k(asked, rows, 3).collect())) == want and len(want) == 21


def test_slots(spark):
    rows = [(1, 0, "sales in 2020", 5, "5", 1, 0.9, "2021 nothing"), (1, 0, "sales in 2020", 6, "6", 2, 0.5, "2020 sales"), (1, 1, "eps", 7, "7", 1, None, None)]
    pool = spark.createDataFrame(rows, "qid long, branch_no int, branch string, doc_id long, evidence_id string, rank int, score double, text string")
    got = [tuple(r)[1:] for r in selection.coverage_slots(pool, 2).collect()]
    assert got == [("year:2020", "selected", 6), ("metric:revenue / sales", "covered_by_selected_evidence", 6), ("metric:earnings per share", "selected", 7)]
    assert [r["status"] for r in selection.coverage_slots(pool, 1).collect()][-1] == "no_remaining_result_slot"


def test_corrective(spark):
    rows = [(1, 10, 0.5, 1, True), (1, 11, 0.1, 2, False), (2, 10, 0.3, 1, False), (3, 10, 0.1, 1, False), (4, 12, 0.1, 1, False)]
    initial = spark.createDataFrame(rows, "qid long, doc_id long, score double, rank int, useful boolean")
    expanded = spark.createDataFrame([(q, d, r) for q in (1, 2, 3) for d, r in ((20, 1), (10, 2))], "qid long, doc_id long, rank int")
    got = [(r["qid"], r["doc_id"]) for r in selection.corrective(initial, expanded).orderBy("qid", "rank").collect()]
    assert got == [(1, 10), (2, 10), (2, 20), (3, 20), (3, 10), (4, 12)]


@pytest.mark.parametrize("most", [0, 100])
def test_phrases(spark, monkeypatch, most):
    monkeypatch.setattr(selection, "BROADCAST_NAMES", most)
    names = spark.createDataFrame([(1, "Blue Ocean"), (2, "ACME widgets of the north"), (3, "acme widgets of the south"), (4, "—"), (5, None)], "name_id long, phrase string")
    docs = spark.createDataFrame([("A", "a blue, ocean"), ("B", "Blue ocean blue ocean"), ("A", "acme widgets of the north!"), ("C", "blueocean"), ("C", None), (None, "acme widgets of the south")], "ticker string, text string")
    got = {r["name_id"]: (r["tickers"], r["status"]) for r in selection.resolve_phrases(names, docs).collect()}
    assert got == {1: (2, "ambiguous"), 2: (1, "resolved"), 3: (0, "unresolved"), 4: (0, "unresolved"), 5: (0, "unresolved")}


def test_range_join(spark):
    rows = spark.createDataFrame([(i, f"2020-{i:02d}-15") for i in range(1, 13)], "id int, day string").withColumn("day", F.to_date("day"))
    windows = spark.createDataFrame([(1, "2020-02-15", "2020-04-14"), (2, "2020-05-01", "2020-04-01")], "qid int, start string, end string").select("qid", F.to_date("start").alias("start"), F.to_date("end").alias("end"))
    assert sorted(r["id"] for r in selection.within(windows, rows, "day").collect()) == [2, 3]


def _loud(prompt):
    return prompt.upper() if prompt else 1 / 0


def test_hooks(spark):
    rows = spark.createDataFrame([(1, "a b a"), (2, None)], "id int, text string")
    vectors = {r["id"]: r["embedding"] for r in selection.embed(rows, "text").collect()}
    assert abs(sum(x * x for x in vectors[1]) - 1) < 1e-6 and not any(vectors[2])
    got = {r["id"]: (r["completion"], r["error"]) for r in selection.complete(rows, "text", _loud).collect()}
    assert got[1] == ("A B A", None) and got[2][0] is None and "ZeroDivisionError" in got[2][1]


def test_sources(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text('{"_id": "x", "contents": "one", "title": "T"}\n\n{"id": "y", "contents": " "}\n{"contents": "three"}\n')
    (tmp_path / "b.json").write_text(json.dumps({"records": [{"id": 1, "text": "r"}]}))
    (tmp_path / "c.tsv").write_text("doc_id\tbody\n7\thello\n")
    (tmp_path / "d.html").write_text("<p>Hi<script>x</script> you</p>")
    rows = lambda name, kind: [tuple(r) for r in readers.read_corpus(spark, str(tmp_path / name), kind).collect()]
    jsonl = rows("a.jsonl", "jsonl")
    assert sorted(jsonl) == [("line_4", "", "three"), ("x", "T", "one")]
    (tmp_path / "sub").mkdir()
    (tmp_path / "sub" / "e.md").write_bytes(b"broken \xff byte")
    (tmp_path / "sub" / "g.bin").write_text("passed over")
    (tmp_path / "h.jsonl").write_text('{"_id": "", "id": "k", "text": "", "body": "empty id, other text field"}\n')
    assert rows("h.jsonl", "jsonl") == [("k", "", "empty id, other text field")]
    assert {(r[0], r[2]) for r in map(tuple, readers.read_folder(spark, str(tmp_path)).collect())} >= {("e", "broken \ufffd byte"), ("d", "Hi you"), ("x", "one"), ("7", "hello"), ("1", "r")}
    assert rows("b.json", "json") == [("1", "", "r")] and rows("c.tsv", "tsv") == [("7", "", "hello")] and rows("d.html", "html") == [("d", "", "Hi you")]
    for name, body in (("l1", '["a", " b ", "a"]'), ("l2", '{"document_ids": ["b", "a"]}'), ("l3", "a\n\nb\n")):
        (tmp_path / name).write_text(body)
        assert sorted(r["doc_id"] for r in readers.allow_list(spark, str(tmp_path / name)).collect()) == ["a", "b"]
    (tmp_path / "l4").write_text(" \n")
    with pytest.raises(ValueError, match="lists no document"):
        readers.allow_list(spark, str(tmp_path / "l4"))


def test_ingest_twice(spark, tmp_path):
    source, store = tmp_path / "in", str(tmp_path / "store")
    source.mkdir()
    (source / "1.json").write_text('{"doc_id": "a", "text": "1"}\n{"doc_id": "a", "text": "1"}\n{"text": "no id"}\n')
    run = lambda: ingest(spark, str(source), "doc_id string, text string", store, str(tmp_path / "ck"))
    run()
    (source / "2.json").write_text('{"doc_id": "a", "text": "late"}\n{"doc_id": "b", "text": "2"}\n')
    run()
    run()
    assert sorted(map(tuple, spark.read.parquet(store).select("doc_id", "text").collect())) == [("a", "1"), ("b", "2")]
    rows = spark.read.parquet(store)
    assert as_of(rows.withColumn("valid", F.lit("2020-01-01").cast("date")), F.col("valid"), F.col("ingested_at"), F.lit("2021-01-01").cast("date"), F.lit("2020-06-01").cast("timestamp")).isEmpty()


def test_summaries_are_replaced_for_touched_filings_alone(spark, tmp_path):
    raw = spark.createDataFrame([("f1", "a"), ("f1", "b"), ("f2", "c")], "filing string, text string")
    made = lambda rows: rows.groupBy("filing").agg(F.count("*").alias("n"))
    store = str(tmp_path / "summaries")
    replace_summaries(raw, raw, store, "filing", made)
    more = raw.unionByName(spark.createDataFrame([("f1", "d"), ("f2", "late")], raw.schema))
    replace_summaries(more, more.filter("text = 'd'"), store, "filing", made)
    assert {r["filing"]: r["n"] for r in spark.read.parquet(store).collect()} == {"f1": 3, "f2": 1}
