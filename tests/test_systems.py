"""Hand-computed cases of questions, stores, graph paths, covers and whole systems."""

import json

import pytest
from pyspark.sql import functions as F

from tidemark.functions import questions as ask
from tidemark.functions import render, temporal, text
from tidemark.operators import evidence, graph, metrics, ranking, retrieval
from tidemark.sources import stores


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def test_questions(spark):
    said = lambda f, x: one(spark, f(F.lit(x)))
    assert said(ask.company_aliases, "How did Big Blue Sky Inc compare to ACME/DE Corp in 2020 and the Co?") == ["BIG BLUE SKY", "ACME DE"]
    assert said(ask.company_aliases, "a b c d e f g h i j Inc") == ["D E F G H I J"]
    assert said(ask.ticker_tokens, "the SEC asks ibm") == ["THE", "ASKS", "IBM"]
    assert said(ask.legal_names, "Did Blue Sky Inc. or Red Sun Holdings LLC?") == ["Did Blue Sky Inc", "Red Sun Holdings LLC"]
    assert said(ask.topics, "What risks, Risks and the trend of cyber-security in 2020") == ["risks", "cyber-security"]
    assert one(spark, ask.asked_years(F.lit("In 2020, 1980 and 2099; the prior year"), F.lit(2027))) == [2019, 2020]
    assert one(spark, ask.keypoints(F.lit("Which policies of Acme buses and glass in 2020?"), F.array(F.lit("acme")))) == ["policy", "buse", "glass"]
    assert one(spark, ask.branches(F.lit(" Q "), F.array(F.lit("q"), F.lit(""), F.lit(" a"), F.lit("A")))) == ["Q", "a"]
    assert one(spark, ask.matches_year(F.array(F.lit(2019)), F.lit("in 2020."), F.lit(2020))) and not one(spark, ask.matches_year(F.array(F.lit(2019)), F.lit("x2020"), F.lit(2020)))
    pairs = [("A", "A", True), ("BIG BLUE", "BIG BLUE SKY", True), ("BIG", "BIG BLUE", False), ("BIG BLUE SKY", "BLUE SKY", True)]
    assert all(one(spark, ask.aliases_match(F.lit(a), F.lit(b))) == want for a, b, want in pairs)


def test_titles(spark):
    meta = lambda t: one(spark, temporal.filing_meta(F.lit(t)))
    assert meta("AB_2020-01-02_10-K_01_ITEM_7a_x")["section_node"] == "AB 10-K 2020-01-02 | Item 7a: x"
    assert meta("_x_")["ticker"] == "UNKNOWN" and meta("_x_")["form"] == "unknown-form"
    assert meta("A_b_c_item_unknown_p_q_r_s_t_u_v")["family"] == "unknown: p q r s t u"
    assert one(spark, temporal.title_metadata(F.lit("AB_2029-01-01_10-K"), F.lit(2027)))["period_year"] == 2029


def test_keywords_and_strips(spark):
    got = one(spark, text.keywords(F.lit("The risk, risk. 'Audit' audit audit 2020 ab company"), F.array(F.lit("xy"), F.lit("risk"), F.lit(""))))
    assert got == ["xy", "risk", "audit"]
    assert one(spark, text.strips(F.lit("A b. C? D! E e.g. f"))) == ["A b. C? D!", "E e.g. f"] and one(spark, text.strips(F.lit(" "))) == []


def test_renderers(spark):
    assert one(spark, render.without_profile(F.lit("USER PROFILE: x\n\nFACTS y\n\nFACT HISTORY z"))) == "FACTS y\n\nFACT HISTORY z"
    assert one(spark, render.without_profile(F.lit("USER PROFILE: x"))) == "USER PROFILE: x"
    packed = render.packed(F.array(F.lit("[h]\nabcdef"), F.lit("[h]\nxyz")), F.array(F.lit("[h]"), F.lit("[h]")), 20)
    assert one(spark, packed) == "[h]\nabcdef\n\n[h]\nxyz" and one(spark, render.packed(F.array(F.lit("[h]\nabc"), F.lit("[h]\nxyz")), F.array(F.lit("[h]"), F.lit("[h]")), 16)) == "[h]\nabc"
    assert one(spark, render.clamped(F.lit("7"), 0.5)) == 1 and one(spark, render.clamped(F.lit("x"), 0.5)) == 0.5 and one(spark, render.int_list(F.array(F.lit("1"), F.lit("x")))) == [1]
    assert [one(spark, render.grade(F.lit(x))) for x in ("Good", "LOW", "?", None)] == ["correct", "incorrect", "ambiguous", "ambiguous"]
    assert one(spark, render.json_list(F.lit("so: [1, 2] ok"))) == "[1, 2]"
    assert render.slug(" A b! ") == "a-b" and render.store_name("x y").startswith("x-y--") and len(render.store_name("")) == 27
    assert render.system_names("engram, chroma chroma") == ["engram_temporal", "chroma"]
    with pytest.raises(ValueError, match="unknown"):
        render.system_names("nothing")


def test_quota_takes_a_chunk_once(spark):
    rows = [(1, 2019, 7, 0.9), (1, 2020, 7, 0.9), (1, 2020, 8, 0.5), (1, 2019, 9, 0.1), (1, 2021, 7, 0.9)]
    got = ranking.year_quota(spark.createDataFrame(rows, "qid long, year int, doc_id long, score double"), 3).orderBy("rank").collect()
    assert [(r["doc_id"], r["year"]) for r in got] == [(7, 2019), (8, 2020), (9, 2019)]
    held = spark.createDataFrame([(1, 1, 1, [2019, 2020], 0.9), (1, 2, 1, [2020], 0.8), (1, 3, 2, [2020], 0.2), (1, 4, 3, [2018], 0.7)], "qid long, chunk_id long, doc_id long, years array<int>, score double")
    wanted = spark.createDataFrame([(1, [2020, 2019])], "qid long, years array<int>")
    assert [r["chunk_id"] for r in ranking.reserve_years(held, wanted, 3).orderBy("rank").collect()] == [1, 3, 4]


def test_cover_and_audit(spark):
    pool = spark.createDataFrame([(1, 0, 10, 0.1, ["a"]), (1, 1, 11, 0.9, ["a"]), (1, 2, 12, None, ["b"]), (1, 3, 11, 0.9, ["z"])], "qid long, pos int, doc_id long, score double, units array<string>")
    wanted = spark.createDataFrame([(1, ["a", "b"])], "qid long, units array<string>")
    assert [r["doc_id"] for r in evidence.greedy_cover(pool, 3, wanted).orderBy("slot").collect()] == [11, 12, 10]
    needed = spark.createDataFrame([(1, "year:1"), (1, "keypoint:x"), (2, "year:1")], "qid long, unit string")
    told = spark.createDataFrame([(1, "year:1", 5), (1, "year:1", 4), (1, "other", 5)], "qid long, unit string, chunk_id long")
    got = {r["qid"]: r for r in evidence.audit(needed, told).collect()}
    assert got[1]["found"] == ["year:1"] and got[1]["missing"] == ["keypoint:x"] and got[1]["evidence"] == {"year:1": [4, 5]}
    assert got[1]["metadata_sufficient"] and not got[1]["sufficient"] and not got[2]["metadata_sufficient"]


def test_budget_cuts_at_a_word_and_stops_at_a_blank(spark):
    rows = [(1, 0, "one two"), (1, 1, "three four five"), (2, 0, "ab"), (2, 1, None), (2, 2, "cd"), (3, 0, "abcdef")]
    blocks = spark.createDataFrame(rows, "qid long, pos int, block string")
    got = [(r["qid"], r["text"]) for r in evidence.context_budget(blocks, 25).orderBy("qid", "pos").collect()]
    assert got == [(1, "one two"), (1, "three four"), (2, "ab"), (3, "abcdef")]
    assert evidence.context_budget(blocks, 0).count() == 5


def test_metrics_count_questions_without_gold_and_failures(spark):
    ranked = spark.createDataFrame([(1, 7, 1)], "qid long, doc_id long, rank int")
    gold = spark.createDataFrame([(1, 7), (2, None)], "qid long, doc_id long")
    got = {r["qid"]: tuple(r)[1:] for r in metrics.ranking_metrics(ranked, gold, (5,)).collect()}
    assert got == {1: (1.0, 1.0, 1.0, 1), 2: (0.0, 0.0, 0.0, 0)}


def test_paths(spark):
    links = spark.createDataFrame([("a", "p", "b"), ("b", "p", "c"), ("a", "q", "b"), ("c", "p", "d")], "subject string, predicate string, object string")
    seeds = spark.createDataFrame([(1, "a")], "qid long, seed string")
    got = {(r["node"], r["no"]): r["path"] for r in graph.paths(seeds, graph.neighbours(links)).collect()}
    assert got["b", 1] == "a →[p] b" and got["b", 2] == "a →[q] b" and got["c", 1] == "a →[p] b | b →[p] c" and ("d", 1) not in got
    assert [tuple(r) for r in graph.export(links, "D").collect()] == [("c", "p", "d")]
    assert {r["predicate"] for r in graph.summary_edges(spark.createDataFrame([("f", "s")], "filing_node string, summary_node string")).collect()} == {"has_filing_summary", "summarizes_filing"}


def world(spark):
    chunks = [(i, i // 2, "AAA" if i % 4 < 2 else "BBB", [2019 + i % 3], "10-K", f"AAA_t{i}", f"text {i}", [1.0, i / 10]) for i in range(1, 13)]
    asked = [(100, "How did it change?", [1.0, 0.2], ["AAA"], [2019, 2021], ["text"]), (101, "net", [1.0, 1.0], [], [], []), (102, "x", [0.0, 1.0], ["CCC"], [2020], [])]
    return spark.createDataFrame(asked, "qid long, question string, qvec array<double>, tickers array<string>, years array<int>, keypoints array<string>"), spark.createDataFrame(chunks, "chunk_id long, doc_id long, ticker string, years array<int>, form string, title string, text string, vec array<double>")


def test_systems(spark):
    asked, chunks = world(spark)
    info = {r["chunk_id"]: r for r in chunks.collect()}
    found = {}
    for r in retrieval.filtered_search(asked, chunks, 20).collect():
        found.setdefault(r["qid"], set()).add(r["chunk_id"])
    assert found[100] == {i for i, r in info.items() if r["ticker"] == "AAA" and r["years"][0] in (2019, 2021)} and len(found[101]) == len(found[102]) == 12
    assert retrieval.filtered_search(asked, chunks, 20, strict=True).filter("qid = 102").isEmpty()
    yearly = retrieval.yearly(asked, chunks, 3).collect()
    assert {r["qid"] for r in yearly} == {100, 101, 102} and all(r["rank"] <= 3 for r in yearly)
    layered = retrieval.layered(asked, chunks, 4).filter("qid = 100").collect()
    assert {info[i]["years"][0] for r in layered for i in info if info[i]["doc_id"] == r["doc_id"] and info[i]["ticker"] == "AAA"} >= {2019, 2021}
    picked, audits = retrieval.verified(asked, chunks, 3)
    told = {r["qid"]: r for r in audits.collect()}
    assert told[100]["sufficient"] and told[100]["recoveries"] == 0 and told[102]["missing"] == ["company:CCC"] and told[102]["recoveries"] == 1
    assert picked.groupBy("qid").count().filter("count <> 3").isEmpty()
    first = retrieval.first_wins([spark.createDataFrame([(1, 5, 1), (1, None, 2)], "qid long, doc_id long, rank int"), spark.createDataFrame([(1, 6, 1), (1, 5, 2)], "qid long, doc_id long, rank int")], 3)
    assert [(r["doc_id"], r["route"]) for r in first.orderBy("rank").collect()] == [(5, 0), (6, 1)]
    links = spark.createDataFrame([("1", "has_section", "S"), ("5", "has_section", "S"), ("5", "has_keyword", "2")], "subject string, predicate string, object string")
    summaries = spark.createDataFrame([(900, "AAA", [2019, 2020, 2021], [1.0, 0.5], [1, 4, 5])], "summary_id long, ticker string, years array<int>, vec array<double>, source_ids array<long>")
    docs, paths = retrieval.by_graph(asked, chunks, links, 3, summaries)
    assert docs.filter("qid = 100").count() == 3 and paths.filter("path like '%has_keyword%'").isEmpty()
    with pytest.raises(ValueError, match="strategy"):
        retrieval.fuse("none", asked, 1)


def test_stores(spark, tmp_path):
    chunks = spark.createDataFrame([(1, [1.0, 2.0]), (2, [3.0, 4.0])], "chunk_id long, vec array<double>")
    path = str(tmp_path / "v")
    stores.write_vectors(chunks, path, {"model": "m"})
    assert stores.read_vectors(spark, path)[1] == {"model": "m"}
    chunks.limit(1).write.mode("append").parquet(f"{path}/chunks")
    with pytest.raises(ValueError, match="3 chunks"):
        stores.read_vectors(spark, path)
    texts = spark.createDataFrame([(1, "a b a"), (2, "b c"), (3, None), (4, "")], "id long, text string")
    stores.write_postings(texts, str(tmp_path / "p"), "id", 4)
    got = {(r["feature"], r["id"]): r["w"] for r in stores.read_postings(spark, str(tmp_path / "p"), spark.createDataFrame([("a",), ("b",)], "feature string"), 4).collect()}
    assert {k for k in got if k[0] in "ab"} == {("a", 1), ("b", 1), ("b", 2)} and abs(sum(w * w for (_, i), w in got.items() if i == 1) - 1) < 1e-9
    assert stores.weights(texts, "id", hashed=8).count() >= 3
    up = str(tmp_path / "u")
    stores.upsert(texts, up, "id")
    stores.upsert(spark.createDataFrame([(1, "new"), (9, "nine")], texts.schema), up, "id")
    assert {r["id"]: r["text"] for r in spark.read.parquet(up).collect()} == {1: "new", 2: "b c", 3: None, 4: "", 9: "nine"}
    stores.write_jsonl(texts.select("text", "id").limit(1), str(tmp_path / "j"))
    assert next((tmp_path / "j").glob("*.json")).read_text().startswith('{"id"')
    (tmp_path / "d.jsonl").write_text('{"qid": 1}\n\n{"qid": 2}\n')
    assert [(r["qid"], r["source_line"]) for r in stores.read_details(spark, [str(tmp_path / "d.jsonl")]).orderBy("qid").collect()] == [(1, 1), (2, 3)]


def test_question_files_and_subsets(spark, tmp_path):
    (tmp_path / "qa.json").write_text(json.dumps({"qa": [{"q_id": "1", "question": "one?", "doc_ids": ["a", " b "]}, {"q_id": "2", "question": "two?", "doc_ids": ["c"]}]}))
    (tmp_path / "sub.json").write_text(json.dumps({"source_questions_file": "qa.json", "records": [{"q_id": "1", "subqueries": ["x", "y"]}]}))
    got = stores.read_questions(spark, str(tmp_path / "sub.json")).collect()
    assert [(r["q_id"], r["question"], r["doc_ids"], r["subqueries"]) for r in got] == [("1", "one?", ["a", " b "], ["x", "y"])]
    questions = stores.read_benchmark(spark, str(tmp_path / "qa.json"))
    (tmp_path / "bad.json").write_text(json.dumps([{"q_id": "3", "question": "", "doc_ids": ["a"]}]))
    with pytest.raises(ValueError, match="3"):
        stores.read_benchmark(spark, str(tmp_path / "bad.json"))
    corpus = spark.createDataFrame([(x,) for x in "abcdef"], "doc_id string")
    drawn, docs = stores.subset(questions, corpus, 2, 2)
    assert drawn.count() == 2 and {r["doc_id"] for r in docs.filter("gold").collect()} == {"a", "b", "c"} and docs.count() == 5
    with pytest.raises(ValueError, match="lacks"):
        stores.subset(questions, corpus.filter("doc_id <> 'a'"), 2, 0)
    assert stores.document_ids('["a", "b", "a"]') == ["a", "b"] and stores.document_ids(" a, b\nc") == ["a", "b", "c"]
    rows = spark.createDataFrame([(0, "a"), (1, "b"), (2, "a")], "at long, doc_id string")
    kept, missing = stores.requested(rows, spark.createDataFrame([("a",), ("z",)], "doc_id string"), 1)
    assert [r["at"] for r in kept.collect()] == [0] and [r["doc_id"] for r in missing.collect()] == ["z"]
    assert {r["doc_id"]: r["at"] for r in stores.distinct_in_order(rows).collect()} == {"a": 0, "b": 1}
    ext = stores.external_chunks(spark.createDataFrame([(0, None, None, None, " hi \x01there", None), (1, "e", None, "t", " ", 0.5)], "at long, id string, doc_id string, title string, text string, score double"), 3)
    assert [tuple(r) for r in ext.collect()] == [("external::3", "external::3", "external result", "hi there", 0.0, 3)]
