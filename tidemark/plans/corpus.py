"""Registered queries on question cues, periods, boosts, routes, resolution and replay; importing this module adds them to the catalogue."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import rules, temporal, text
from ..operators import graph, ranking, selection
from .catalogue import _SCORED, Tables, query


def _pick(key: str, options: list[str]) -> Column:
    """One of the options by an id's remainder: the wording of a row's made-up question or text."""
    return F.element_at(F.array(*map(F.lit, options)), (F.col(key) % len(options)).cast("int") + 1)


def _pick_sql(key: str, options: list[str]) -> str:
    return "[" + ", ".join("'" + x.replace("'", "''") + "'" for x in options) + f"][{key} % {len(options)} + 1]"


_PARTS = "SELECT p_brand AS qid, p_partkey AS doc_id, round(p_retailprice / 10000, 6) AS score, lower(p_name || ' ' || p_type) AS title FROM part"


@query(f"WITH p AS ({_PARTS}), r AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, doc_id) AS r0, round(score + 0.05 * len(list_intersect(list_distinct(string_split(title, ' ')), ['red', 'ring', 'economy'])), 6) AS boosted FROM p) SELECT qid, doc_id, boosted, row_number() OVER (PARTITION BY qid ORDER BY boosted DESC, r0) AS rank FROM r QUALIFY rank <= 10")
def title_boost(t: Tables) -> DataFrame:
    p = t.part.select(F.col("p_brand").alias("qid"), F.col("p_partkey").alias("doc_id"), F.round(F.col("p_retailprice") / 10000, 6).alias("score"), F.concat_ws(" ", "p_name", "p_type").alias("title"))
    pool = ranking.ranked(p, ["qid"], [F.desc("score"), F.col("doc_id")])
    return selection.title_boost(pool, F.lit("Red ring, economy"), F.col("title"), 10)


_ASK = ["How did revenue change in the annual report?", "What was the quarterly headcount?", "Compare audit fees and bonus", "Where is it filed?"]
_SAY = ["Net loss and REVENUE in results of operations", "Employees and workforce", "Audit fee, bonus", "Nothing else"]


@query(f"""WITH o AS (SELECT o_orderkey, o_orderkey % 4 AS q, (o_orderkey // 4) % 4 AS s, (o_orderkey // 16) % 2 AS f FROM orders)
    SELECT o_orderkey, round(CASE WHEN q = 0 AND s = 0 THEN 0.12 WHEN q = 1 AND s = 1 THEN 0.12 WHEN q = 2 AND s = 2 THEN 0.12 ELSE 0 END + CASE WHEN (q = 0 AND f = 0) OR (q = 1 AND f = 1) THEN 0.04 ELSE 0 END, 6) AS boost FROM o""")
def section_form_boost(t: Tables) -> DataFrame:
    o = t.orders.select("o_orderkey", F.floor(F.col("o_orderkey") / 4).alias("k4"), F.floor(F.col("o_orderkey") / 16).alias("k16"))
    boost = rules.section_form_boost(_pick("o_orderkey", _ASK), F.lit("AB_2022"), _pick("k4", _SAY), _pick("k16", ["10-K", "10-q"]))
    return o.select("o_orderkey", F.round(boost, 6).alias("boost"))


_FACTS = ["Net sales and EPS rose.", "Auditing fees of all employees;", "Capital expenditures, free cash flow", "", "Adjusted EBITDA and shareholders' equity"]


@query("WITH d AS (SELECT doc_id, " + _pick_sql("doc_id", _FACTS) + " || ' ' || text AS t FROM documents) SELECT doc_id, concat_ws('; ', " + ", ".join(f"CASE WHEN regexp_matches(t, '{p.replace(chr(39), chr(39) * 2)}', 'i') THEN '{label}' END" for label, p in rules.METRICS) + ") AS metrics FROM d")
def metric_detection(t: Tables) -> DataFrame:
    said = F.concat(_pick("doc_id", _FACTS), F.lit(" "), "text")
    return t.documents.select("doc_id", F.array_join(rules.metrics_in(said), "; ").alias("metrics"))


@query("""SELECT o_orderkey, ['trend', 'risk', 'comparison', 'evolution', 'lookup', 'calculation'][o_orderkey % 6 + 1] AS intent,
    ['financial_statements', 'risk_factors;executive_compensation', 'ownership', '', 'market_risk', 'financial_statements'][o_orderkey % 6 + 1] AS hints,
    o_orderkey % 6 IN (2, 3) AS broad FROM orders""")
def graph_plan(t: Tables) -> DataFrame:
    asked = _pick("o_orderkey", ["Growth of revenue", "Director liability in legal matters", "Ownership versus 2021", "What changed", "Hedge of foreign exchange", "Total fees"])
    return t.orders.select("o_orderkey", rules.intent(asked).alias("intent"), F.array_join(rules.section_hints(asked), ";").alias("hints"), rules.is_broad(asked, temporal.query_years(asked)).alias("broad"))


@query("""WITH o AS (SELECT o_orderkey, CAST(o_orderdate AS DATE) AS d, strftime(o_orderdate, '%B %-d, %Y') AS w FROM orders)
    SELECT o_orderkey, 'third quarter ended ' || w AS label, 'quarter' AS type, CAST(NULL AS DATE) AS start, d AS "end" FROM o
    UNION ALL SELECT o_orderkey, 'six months ended ' || w, 'semiannual', NULL, d FROM o
    UNION ALL SELECT o_orderkey, 'from January 1, 1990 to ' || w, 'range', DATE '1990-01-01', d FROM o
    UNION ALL SELECT o_orderkey, 'as of ' || w, 'instant', NULL, d FROM o""")
def reporting_periods(t: Tables) -> DataFrame:
    day = F.date_format("o_orderdate", "MMMM d, yyyy")
    said = F.concat(F.lit("In the third  quarter ended "), day, F.lit(" and the six months ended "), day, F.lit("; from January 1, 1990 to "), day, F.lit(". As told, as of "), day, F.lit(", AS OF "), day)
    return t.orders.select("o_orderkey", F.inline(temporal.reporting_periods(said)))


@query("SELECT o_orderkey, [3, 1, 12, NULL][o_orderkey % 4 + 1] AS n, ['year', 'quarter', 'month', NULL][o_orderkey % 4 + 1] AS unit FROM orders")
def relative_phrases(t: Tables) -> DataFrame:
    said = temporal.relative_phrase(_pick("o_orderkey", ["within the past three years", "this quarter", "the last 12 months", "in March"]))
    return t.orders.select("o_orderkey", said["n"].alias("n"), said["unit"].alias("unit"))


@query("""WITH w AS (SELECT n_nationkey AS qid, DATE '1992-01-01' + CAST(n_nationkey * 97 AS INT) AS a, DATE '1992-01-01' + CAST(n_nationkey * 97 + 200 AS INT) AS b FROM nation)
    SELECT qid, count(*) AS filings, min(o_orderkey) AS first_id FROM w JOIN orders ON CAST(o_orderdate AS DATE) BETWEEN a AND b GROUP BY qid""")
def date_windows(t: Tables) -> DataFrame:
    begin = F.date_add(F.lit("1992-01-01").cast("date"), (F.col("n_nationkey") * 97).cast("int"))
    windows = t.nation.select(F.col("n_nationkey").alias("qid"), begin.alias("start"), F.date_add(begin, 200).alias("end"))
    found = selection.within(windows, t.filings().select("filing", "filed"), "filed")
    return found.groupBy("qid").agg(F.count(F.lit(1)).alias("filings"), F.min("filing").alias("first_id"))


_COMPANY = "f AS (SELECT o_custkey AS qid, o_orderkey AS doc_id, o_totalprice AS score, year(o_orderdate) = 1992 + o_custkey % 7 AS timely FROM orders)"


@query(f"WITH {_COMPANY}, k AS (SELECT * FROM f WHERE timely OR qid NOT IN (SELECT qid FROM f WHERE timely)) SELECT qid, doc_id, score, row_number() OVER (PARTITION BY qid ORDER BY score DESC, doc_id) AS rank FROM k QUALIFY rank <= 3")
def company_relaxation(t: Tables) -> DataFrame:
    """Rows of the company and the asked year; companies without any in that year give their rows of all years."""
    f = t.filings().select(F.col("ticker").alias("qid"), F.col("filing").alias("doc_id"), "score", "year")
    top = lambda df: ranking.ranked(df.drop("year"), ["qid"], [F.desc("score"), F.col("doc_id")], 3)
    return ranking.relaxed(top(f.filter(F.col("year") == 1992 + F.col("qid") % 7)), top(f))


@query("SELECT * FROM (SELECT o_orderkey AS id, lead(o_orderkey) OVER w AS next_id FROM orders WINDOW w AS (PARTITION BY o_custkey, o_orderpriority, o_orderstatus ORDER BY o_orderdate, o_orderkey)) WHERE next_id IS NOT NULL")
def adjacency_section(t: Tables) -> DataFrame:
    return graph.adjacent(t.orders, ["o_custkey", "o_orderpriority", "o_orderstatus"], ["o_orderdate", "o_orderkey"], "o_orderkey")


_PLAIN = "trim(regexp_replace(lower({0}), '[^a-z0-9]+', ' ', 'g'))"


@query(f"""WITH n AS (SELECT item_id AS name_id, {_PLAIN.format("text")} AS p FROM benchmark), d AS (SELECT source, ' ' || {_PLAIN.format("text")} || ' ' AS s FROM documents),
    h AS (SELECT name_id, count(DISTINCT source) AS tickers FROM n JOIN d ON p <> '' AND contains(s, ' ' || p || ' ') GROUP BY name_id)
    SELECT n.name_id, coalesce(tickers, 0) AS tickers, CASE WHEN tickers = 1 THEN 'resolved' WHEN tickers > 1 THEN 'ambiguous' ELSE 'unresolved' END AS status FROM n LEFT JOIN h ON n.name_id = h.name_id""")
def phrase_resolution(t: Tables) -> DataFrame:
    names = t.benchmark.select(F.col("item_id").alias("name_id"), F.col("text").alias("phrase"))
    return selection.resolve_phrases(names, t.documents.select(F.col("source").alias("ticker"), "text"))


@query(f"""WITH {_SCORED}, x AS (SELECT qid, doc_id, row_number() OVER (PARTITION BY qid ORDER BY score DESC, doc_id) AS rank FROM s WHERE label IN (1, 3, 5) QUALIFY rank <= 5),
    i AS (SELECT *, score >= 0.45 AS useful FROM t WHERE rank <= 10), g AS (SELECT qid, CASE WHEN max(score) >= 0.45 THEN 'correct' WHEN max(score) >= 0.25 THEN 'ambiguous' ELSE 'incorrect' END AS grade, bool_or(useful) AS any_useful FROM i GROUP BY qid),
    a AS (SELECT i.qid, grade, doc_id, 0 AS step, rank FROM i JOIN g ON i.qid = g.qid WHERE CASE WHEN grade = 'incorrect' THEN i.qid NOT IN (SELECT qid FROM x) WHEN any_useful THEN useful ELSE grade = 'correct' OR rank <= 4 END
          UNION ALL SELECT x.qid, grade, doc_id, 1, rank FROM x JOIN g ON x.qid = g.qid WHERE grade <> 'correct'),
    k AS (SELECT * FROM a QUALIFY row_number() OVER (PARTITION BY qid, doc_id ORDER BY step, rank) = 1)
    SELECT qid, grade, doc_id, row_number() OVER (PARTITION BY qid ORDER BY step, rank) AS rank FROM k""")
def corrective_routing(t: Tables) -> DataFrame:
    expanded = ranking.vector_top_k(t.asked(), t.chunks().filter("label in (1, 3, 5)"), 5)
    return selection.corrective(t.top().withColumn("useful", F.col("score") >= 0.45), expanded)


@query("""WITH r AS (SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS rank FROM orders), l AS (SELECT l_orderkey, count(*) AS n FROM lineitem GROUP BY l_orderkey)
    SELECT o_custkey, o_orderkey, rank, CASE WHEN n IS NULL THEN 'missing_from_corpus' ELSE 'found' END AS status, coalesce(n, 0) AS chunks FROM r LEFT JOIN l ON o_orderkey = l_orderkey WHERE rank <= 10""")
def replay_context(t: Tables) -> DataFrame:
    """Saved rankings met with the corpus again; documents that it lacks are told."""
    saved = ranking.ranked(t.orders.select("o_custkey", "o_orderkey", "o_totalprice"), ["o_custkey"], [F.desc("o_totalprice"), F.col("o_orderkey")], 10)
    corpus = t.lineitem.groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.count(F.lit(1)).alias("chunks"))
    status = F.when(F.col("chunks").isNull(), "missing_from_corpus").otherwise("found")
    return saved.join(corpus, "o_orderkey", "left").select("o_custkey", "o_orderkey", "rank", status.alias("status"), F.coalesce("chunks", F.lit(0)).alias("chunks"))


@query("WITH q AS (SELECT DISTINCT user_id FROM events ORDER BY md5('42-' || user_id), user_id LIMIT 20) SELECT event_type, user_id, count(*) AS n FROM events WHERE user_id IN (SELECT user_id FROM q) AND event_type IN ('click', 'view') GROUP BY ALL")
def saved_rows(t: Tables) -> DataFrame:
    """Rows of two systems for a seeded sample of 20 questions (the limit is the operator), all rows of a question kept."""
    drawn = t.events.select("user_id").distinct().orderBy(F.md5(F.concat(F.lit("42-"), "user_id").cast("binary")), "user_id").limit(20)
    kept = t.events.filter(F.col("event_type").isin("click", "view")).join(F.broadcast(drawn), "user_id", "left_semi")
    return kept.groupBy("event_type", "user_id").agg(F.count(F.lit(1)).alias("n"))


@query("""WITH a AS (SELECT c_custkey, unnest(list_distinct(['customer ' || lpad(CAST(c_custkey AS VARCHAR), 9, '0') || ' inc', 'customer ' || lpad(CAST(c_custkey AS VARCHAR), 9, '0'), 'customer'])) AS alias, c_mktsegment FROM customer)
    SELECT alias, count(DISTINCT c_mktsegment) AS tickers FROM a GROUP BY alias""")
def alias_map(t: Tables) -> DataFrame:
    """Aliases of each company, whole, without legal suffix and by first word, with the number of tickers that they stand for."""
    made = t.customer.select("c_mktsegment", F.explode(text.alias_variants(F.concat("c_name", F.lit(", Inc.")))).alias("alias"))
    return made.groupBy("alias").agg(F.count_distinct("c_mktsegment").alias("tickers"))


@query("SELECT o_custkey, count(*) AS chunks, array_to_string(list_slice(list_sort(list(DISTINCT lower(o_orderpriority))), 1, 20), '; ') AS sections, min(o_orderkey) AS first_id, len(list(DISTINCT year(o_orderdate))) AS years FROM orders GROUP BY o_custkey")
def filing_digest(t: Tables) -> DataFrame:
    """One summary row a company: sections told once (case does not count, at most 20), chunks, years."""
    sections = F.array_join(F.slice(F.array_sort(F.collect_set(F.lower("form"))), 1, 20), "; ")
    return t.filings().groupBy(F.col("ticker").alias("o_custkey")).agg(F.count(F.lit(1)).alias("chunks"), sections.alias("sections"), F.min("filing").alias("first_id"), F.count_distinct("year").alias("years"))


@query("SELECT o_orderkey, 'doc_' || lpad(CAST(o_orderkey AS VARCHAR), 6, '0') || ';doc_000007' AS doc_ids, CAST(o_orderkey % 50 AS INT) AS chunk_index FROM orders WHERE o_orderkey <> 7 UNION ALL SELECT 7, 'doc_000007', 7")
def doc_references(t: Tables) -> DataFrame:
    """Document ids that a text names, each once, and the chunk number of a saved evidence id."""
    own = F.concat(F.lit("doc_"), F.lpad(F.col("o_orderkey").cast("string"), 6, "0"))
    said = F.concat(F.lit("See "), own, F.lit(", doc_000007 and "), own, F.lit("; not doc_0000071"))
    evidence = F.concat(own, F.lit("::chunk_"), F.lpad((F.col("o_orderkey") % 50).cast("string"), 4, "0"))
    return t.orders.select("o_orderkey", F.array_join(text.doc_ids(said), ";").alias("doc_ids"), text.chunk_index(evidence).alias("chunk_index"))


@query("SELECT event_id, CAST(least(1, greatest(0, (CAST(json_extract_string(props, '$.k') AS DOUBLE)) / 50)) AS DOUBLE) AS confidence FROM events")
def answer_json(t: Tables) -> DataFrame:
    """The number of a JSON object inside a fenced answer, held between 0 and 1."""
    answer = F.concat(F.lit("Sure:\n```json\n"), "props", F.lit("\n```"))
    k = F.get_json_object(text.json_in(answer), "$.k").try_cast("double")
    return t.events.select("event_id", F.least(F.lit(1.0), F.greatest(F.lit(0.0), k / 50)).alias("confidence"))


@query(None)
def coverage_slots(t: Tables) -> DataFrame:
    """Slots for years and metrics of two branches over each question's ten nearest vectors."""
    said = F.concat(_pick("doc_id", _FACTS), F.lit(" In "), (F.col("doc_id") % 4 + 2019).cast("string"))
    rows = t.top().select("qid", (F.col("doc_id") % 2).cast("int").alias("branch_no"), _pick("doc_id", ["Sales in 2020", "Audit fees and cash flow in 2021"]).alias("branch"), "doc_id", F.col("doc_id").cast("string").alias("evidence_id"), "rank", "score", said.alias("text"))
    return selection.coverage_slots(rows, 5)


@query(None)
def hashed_embeddings(t: Tables) -> DataFrame:
    return selection.embed(t.benchmark.select("item_id", "text"), "text").drop("text")
