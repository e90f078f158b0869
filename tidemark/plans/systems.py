"""Registered queries of the retrieval systems, their audits and graphs; importing this module adds them to the catalogue.

The vectors stand for chunks of filings: three make a document, the label is the company, id and label give year, form, title and text.
The stated questions are the vectors whose id is divisible by 50, in four wordings; texts made of a question are asked with its vector.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import questions as ask
from ..functions import render, temporal, text
from ..operators import evidence, graph, metrics, ranking, retrieval, selection
from ..sources import stores
from .catalogue import Tables, query
from .corpus import _pick

#: Companies by label, the first three letters in capitals are their tickers.
NAMES = ["Acorn Mills", "Birch Lane", "Cedar Rock", "Delta Forge", "Ember Glass", "Fjord Lines", "Grove Foods", "Heron Bank", "Iris Optics", "Jade Motors"]
#: Parts of a question before and after its company, and the suffix of that.
ASKED = [("How did revenue of ", " Inc", " change between 2019 and 2021?"), ("What audit fees did ", " Corporation", " pay in 2020?"), ("Which net loss was told in 2022?", "", ""), ("Where is the board of ", " Co", "?")]
SLUGS = ["audit_fees", "net_loss", "revenue_growth"]
SAID = ["Audit fees rose.", "A net loss was told.", "Revenue grew in results of operations."]


def _name(label: str) -> Column:
    return _pick(label, NAMES)


class Corpus:
    """Chunks, questions, summaries and graph of the vectors."""

    def __init__(self, t: Tables):
        v = t.embeddings.select(F.col("vec_id").alias("chunk_id"), "label", F.col("embedding").alias("vec"))
        filed, form = (F.lit(2018) + F.col("chunk_id") % 6).cast("int"), F.when(F.col("chunk_id") % 2 == 0, "10-K").otherwise("10-Q")
        ticker, period = F.upper(F.left(_name("label"), F.lit(3))), filed - F.when(form == "10-K", 1).otherwise(0)
        title = F.concat(ticker, F.lit("_"), filed, F.lit("-03-15_"), form, F.lit("_00_item_7_"), _pick("chunk_id", SLUGS))
        self.chunks = v.select("chunk_id", F.floor(F.col("chunk_id") / 3).alias("doc_id"), ticker.alias("ticker"), F.array_distinct(F.array(period, filed)).alias("years"), filed.alias("filed"), form.alias("form"), title.alias("title"), F.concat(_pick("chunk_id", SAID), F.lit(" In "), period.cast("string")).alias("text"), "vec")
        kind = F.floor(F.col("chunk_id") / 50) % 4
        wording = F.element_at(F.array(*[F.concat(F.lit(a), F.when(F.lit(b) != "", _name("label")).otherwise(""), F.lit(b), F.lit(c)) for a, b, c in ASKED]), (kind + 1).cast("int"))
        said = v.filter("chunk_id % 50 = 0").select(F.col("chunk_id").alias("qid"), wording.alias("question"), F.col("vec").alias("qvec"), kind.cast("int").alias("kind"))
        self.aliases = v.select("label").distinct().select(F.upper(F.left(_name("label"), F.lit(3))).alias("ticker"), ask.alias(_name("label")).alias("alias")).distinct()
        tickers = retrieval.resolve_tickers(said.select("qid", "question"), self.aliases)
        self.asked = said.join(tickers, "qid").withColumn("years", ask.asked_years(F.col("question"), F.lit(2027))).withColumn("keypoints", ask.keypoints(F.col("question"), F.flatten(F.transform("tickers", lambda x: ask.terms(x))))).persist()  # the stated set

    def summaries(self) -> DataFrame:
        """One summary for each filing; the vector is that of its first chunk."""
        c = self.chunks
        filing = [c.ticker, c.filed, c.form]
        made = c.groupBy(*filing).agg(F.min("chunk_id").alias("summary_id"), F.min_by("vec", "chunk_id").alias("vec"), F.first("years").alias("years"), F.array_sort(F.collect_list("chunk_id")).alias("source_ids"))
        return made.select("summary_id", "ticker", "years", "vec", "source_ids")


_ARR = lambda xs: "[" + ", ".join("'" + x.replace("'", "''") + "'" for x in xs) + "]"

_BASE = f"""
    c AS (SELECT vec_id AS cid, vec_id // 3 AS did, label AS cl, upper(left({_ARR(NAMES)}[label + 1], 3)) AS tick, CAST(2018 + vec_id % 6 AS INT) AS filed, vec_id % 2 = 0 AS annual, vec_id % 3 AS slug, embedding FROM embeddings),
    q AS (SELECT vec_id AS qid, label AS ql, (vec_id // 50) % 4 AS kind, embedding AS qvec, [[2019, 2021], [2020], [2022], []][(vec_id // 50) % 4 + 1] AS ys FROM embeddings WHERE vec_id % 50 = 0),
    s AS (SELECT qid, ql, kind, ys, cid, did, cl, tick, filed, annual, slug, CASE WHEN annual THEN [filed - 1, filed] ELSE [filed] END AS cy, round(list_cosine_similarity(qvec::DOUBLE[], embedding::DOUBLE[]), 6) AS score,
          CASE WHEN kind = 0 AND slug = 2 THEN 1 WHEN kind = 1 AND slug = 0 THEN 2 WHEN kind = 2 AND slug = 1 THEN 2 ELSE 0 END AS shared FROM q, c WHERE cid <> qid),
    f AS (SELECT *, (kind = 2 OR cl = ql) AS own, (kind = 3 OR list_has_any(cy, ys)) AS timely FROM s)"""


def _pool(name: str, k: int, kinds: str = "true") -> str:
    return f"""{name} AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, cid) AS rank FROM (
        SELECT * FROM f WHERE own AND timely AND {kinds} UNION ALL SELECT * FROM f WHERE {kinds} AND qid NOT IN (SELECT qid FROM f WHERE own AND timely)) QUALIFY rank <= {k})"""


def _docs(pool: str, n: int) -> str:
    return f"""b AS (SELECT *, round(score + 0.05 * shared, 6) AS boosted FROM {pool}), d AS (SELECT * FROM b QUALIFY row_number() OVER (PARTITION BY qid, did ORDER BY boosted DESC, rank) = 1)
    SELECT qid, did AS doc_id, boosted, row_number() OVER (PARTITION BY qid ORDER BY boosted DESC, rank, did) AS rank FROM d QUALIFY row_number() OVER (PARTITION BY qid ORDER BY boosted DESC, rank, did) <= {n}"""


@query(f"WITH {_BASE} SELECT qid, CASE WHEN kind = 2 THEN '' ELSE upper(left({_ARR(NAMES)}[ql + 1], 3)) END AS tickers, array_to_string(ys, ';') AS years FROM q")
def question_filters(t: Tables) -> DataFrame:
    """Companies and years that each question names."""
    return Corpus(t).asked.select("qid", F.array_join("tickers", ";").alias("tickers"), F.array_join(F.transform("years", lambda y: y.cast("string")), ";").alias("years"))


@query(f"""WITH {_BASE}, n AS (SELECT qid, kind, string_split(lower({_ARR(NAMES)}[ql + 1]), ' ') AS w FROM q), w AS (SELECT qid, kind, list_transform(w, lambda x: CASE WHEN length(x) > 4 AND x[-1:] = 's' AND x[-2:] NOT IN ('ss', 'us') THEN x[:-2] ELSE x END) AS w FROM n)
    SELECT qid, array_to_string(CASE kind WHEN 0 THEN ['revenue'] || w || ['change'] WHEN 1 THEN ['audit', 'fees'] || w || ['pay'] WHEN 2 THEN ['net', 'loss', 'told'] ELSE ['board'] || w END, ';') AS keypoints FROM w""")
def question_keypoints(t: Tables) -> DataFrame:
    """What each question is about besides its ticker and years."""
    return Corpus(t).asked.select("qid", F.array_join("keypoints", ";").alias("keypoints"))


@query(f"WITH {_BASE}, p AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, cid) AS r FROM s QUALIFY r <= 20), d AS (SELECT * FROM p QUALIFY row_number() OVER (PARTITION BY qid, did ORDER BY r) = 1) SELECT qid, did AS doc_id, score, row_number() OVER (PARTITION BY qid ORDER BY r) AS rank FROM d QUALIFY row_number() OVER (PARTITION BY qid ORDER BY r) <= 5")
def system_plain(t: Tables) -> DataFrame:
    c = Corpus(t)
    return retrieval.plain(c.asked, c.chunks, 5)


@query(f"WITH {_BASE}, {_pool('p', 20)}, {_docs('p', 5)}")
def system_metadata(t: Tables) -> DataFrame:
    c = Corpus(t)
    return retrieval.by_metadata(c.asked, c.chunks, 5)


_LAYER = """l0 AS (SELECT f.*, y FROM (SELECT *, unnest(ys) AS y FROM q WHERE kind = 0) k JOIN f ON f.qid = k.qid),
    l1 AS (SELECT * FROM l0 WHERE own AND list_contains(cy, y) UNION ALL SELECT * FROM l0 WHERE own AND (qid, y) NOT IN (SELECT (qid, y) FROM l0 WHERE own AND list_contains(cy, y))),
    l2 AS (SELECT * FROM l1 QUALIFY row_number() OVER (PARTITION BY qid, y ORDER BY score DESC, cid) <= 15),
    l3 AS (SELECT * REPLACE (round(score + CASE slug WHEN 1 THEN 0.06 WHEN 2 THEN 0.12 ELSE 0 END, 6) AS score) FROM l2),
    l4 AS (SELECT *, row_number() OVER (PARTITION BY qid, y ORDER BY score DESC, cid) AS n FROM l3),
    l5 AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY CASE WHEN n <= 2 THEN n END NULLS LAST, CASE WHEN n <= 2 THEN y END, score DESC, cid) AS rank FROM l4 QUALIFY rank <= 5)"""


@query(f"WITH {_BASE}, {_LAYER}, {_pool('p', 5, 'kind <> 0')}, u AS (SELECT qid, did, shared, score, rank FROM l5 UNION ALL SELECT qid, did, shared, score, rank FROM p), {_docs('u', 5)}")
def system_multilayer(t: Tables) -> DataFrame:
    c = Corpus(t)
    return retrieval.layered(c.asked, c.chunks, 5)


_YEARLY = """y0 AS (SELECT f.*, y FROM (SELECT *, unnest(ys) AS y FROM q WHERE kind <> 3) k JOIN f ON f.qid = k.qid WHERE list_contains(cy, y)),
    y1 AS (SELECT * FROM y0 WHERE own UNION ALL SELECT * FROM y0 WHERE (qid, y) NOT IN (SELECT (qid, y) FROM y0 WHERE own)),
    y2 AS (SELECT * FROM y1 QUALIFY row_number() OVER (PARTITION BY qid, y ORDER BY score DESC, cid) <= 20),
    y3 AS (SELECT qid, cid, did, max(shared) AS shared, max(score) AS score, list(DISTINCT y) AS yb, any_value(ys) AS ys FROM y2 GROUP BY qid, cid, did),
    a1 AS (SELECT qid, cid FROM y3 WHERE list_contains(yb, ys[1]) QUALIFY row_number() OVER (PARTITION BY qid ORDER BY score DESC, cid) = 1),
    a2 AS (SELECT qid, cid FROM y3 WHERE len(ys) > 1 AND list_contains(yb, ys[2]) AND (qid, cid) NOT IN (SELECT (qid, cid) FROM a1) QUALIFY row_number() OVER (PARTITION BY qid ORDER BY score DESC, cid) = 1),
    y4 AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY CASE WHEN (qid, cid) IN (SELECT (qid, cid) FROM a1) THEN 1 WHEN (qid, cid) IN (SELECT (qid, cid) FROM a2) THEN 2 ELSE 3 END, score DESC, cid) AS rank FROM y3 QUALIFY rank <= 5)"""


@query(f"WITH {_BASE}, {_YEARLY}, {_pool('p', 5, 'kind = 3')}, u AS (SELECT qid, did, shared, score, rank FROM y4 UNION ALL SELECT qid, did, shared, score, rank FROM p), {_docs('u', 5)}")
def system_yearly(t: Tables) -> DataFrame:
    c = Corpus(t)
    return retrieval.yearly(c.asked, c.chunks, 5)


@query(None)
def system_verified(t: Tables) -> DataFrame:
    """Chunks picked to cover companies and years, with what the audit finds missing."""
    c = Corpus(t)
    picked, audits = retrieval.verified(c.asked, c.chunks, 5)
    told = audits.select("qid", F.array_join("missing", ";").alias("missing"), "metadata_sufficient", F.col("recoveries").cast("long").alias("recoveries"))
    return picked.join(told, "qid")


@query(f"""WITH {_BASE}, {_pool('p', 5)}, n AS (SELECT qid, unnest(CASE WHEN kind = 2 THEN [] ELSE ['company:' || upper(left({_ARR(NAMES)}[ql + 1], 3))] END || list_transform(ys, lambda y: 'year:' || y)) AS unit FROM q),
    e AS (SELECT qid, cid, unnest(['company:' || tick] || list_transform(cy, lambda y: 'year:' || y)) AS unit FROM p), g AS (SELECT n.qid, n.unit, array_to_string(list_sort(list(cid)), ',') AS ids FROM n LEFT JOIN e ON n.qid = e.qid AND n.unit = e.unit GROUP BY n.qid, n.unit)
    SELECT qid, array_to_string(list_sort(list(unit) FILTER (ids <> '')), ';') AS found, coalesce(array_to_string(list_sort(list(unit) FILTER (coalesce(ids, '') = '')), ';'), '') AS missing, bool_and(coalesce(ids, '') <> '') AS sufficient, string_agg(unit || '=' || ids, ' ' ORDER BY unit) FILTER (ids <> '') AS evidence FROM g GROUP BY qid""")
def evidence_audit(t: Tables) -> DataFrame:
    """Which companies and years the five nearest admitted chunks of each question support, by which chunks, and what is missing."""
    c = Corpus(t)
    told = retrieval.units_of(c.asked, c.chunks, retrieval.filtered_search(c.asked, c.chunks, 5), False).select("qid", "chunk_id", F.explode("units").alias("unit"))
    needed = c.asked.select("qid", F.explode(ask.needed_units(F.col("tickers"), F.col("years"))).alias("unit"))
    out = evidence.audit(needed, told)
    shown = F.transform(F.map_entries("evidence"), lambda e: F.concat(e["key"], F.lit("="), F.array_join(F.transform(e["value"], lambda i: i.cast("string")), ",")))
    return out.select("qid", F.array_join("found", ";").alias("found"), F.array_join("missing", ";").alias("missing"), "sufficient", F.array_join(shown, " ").alias("evidence"))


_TEMPORAL = f"""z AS (SELECT * FROM f WHERE own AND timely QUALIFY row_number() OVER (PARTITION BY qid ORDER BY score DESC, cid) <= 6),
    g AS (SELECT min(cid) AS sid, list(cid) AS src, tick, filed, annual FROM c GROUP BY tick, filed, annual),
    w AS (SELECT f.qid, src FROM f JOIN g ON cid = sid WHERE kind = 0 AND own AND timely QUALIFY row_number() OVER (PARTITION BY f.qid ORDER BY score DESC, cid) <= 4),
    m AS (SELECT qid, count(*) AS n FROM w GROUP BY qid), x AS (SELECT DISTINCT qid, unnest(src) AS cid FROM w),
    e AS (SELECT s.qid, s.cid, score, n FROM x JOIN s ON s.qid = x.qid AND s.cid = x.cid JOIN m ON m.qid = s.qid QUALIFY row_number() OVER (PARTITION BY s.qid ORDER BY score DESC, s.cid) <= 2 * n),
    u AS (SELECT qid, cid, max(score) AS score FROM (SELECT qid, cid, score FROM z UNION ALL SELECT qid, cid, score FROM e) GROUP BY qid, cid),
    v AS (SELECT u.*, row_number() OVER (PARTITION BY u.qid ORDER BY score DESC, cid) AS rank, coalesce(n, 0) AS n FROM u LEFT JOIN m ON m.qid = u.qid)"""


@query(f"WITH {_BASE}, {_TEMPORAL} SELECT qid, cid AS chunk_id, score, rank FROM v WHERE rank <= 6 + 2 * n")
def system_temporal(t: Tables) -> DataFrame:
    c = Corpus(t)
    return retrieval.with_summaries(c.asked, c.chunks, c.summaries(), 6)


def _entries(c: Corpus, k: int = 15) -> DataFrame:
    """Rankings of each question and of a subquery on its company's net loss, each by metadata."""
    sub = c.asked.withColumn("question", F.concat(F.lit("What net loss did "), F.coalesce(F.get("tickers", F.lit(0)), F.lit("it")), F.lit(" report?"))).withColumn("years", F.array().cast("array<int>"))
    parts = []
    for no, asked in enumerate((c.asked, sub)):
        pool = retrieval.filtered_search(asked, c.chunks, k).join(c.chunks.select("chunk_id", "doc_id", "text"), "chunk_id").join(asked.select("qid", F.col("question").alias("branch")), "qid")
        best = ranking.keep_first(pool, ["qid", "doc_id"], [F.col("rank")]).withColumnRenamed("rank", "_rank")
        parts.append(ranking.ranked(best, ["qid"], [F.col("_rank")]).select("qid", F.lit(no).alias("branch_no"), "branch", "doc_id", F.col("chunk_id").alias("evidence_id"), "rank", "score", "text"))
    return parts[0].unionByName(parts[1])


_FUSED = f"""{_pool('p0', 15)}, t0 AS (SELECT * FROM f WHERE own OR (kind <> 2 AND qid NOT IN (SELECT qid FROM f WHERE own))),
    p1 AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, cid) AS rank FROM t0 QUALIFY rank <= 15),
    e0 AS (SELECT 0 AS br, * FROM p0 QUALIFY row_number() OVER (PARTITION BY qid, did ORDER BY rank) = 1), e1 AS (SELECT 1 AS br, * FROM p1 QUALIFY row_number() OVER (PARTITION BY qid, did ORDER BY rank) = 1),
    en AS (SELECT br, qid, did, cid, score, row_number() OVER (PARTITION BY br, qid ORDER BY rank) AS rank FROM (SELECT br, qid, did, cid, score, rank FROM e0 UNION ALL SELECT br, qid, did, cid, score, rank FROM e1))"""


@query(f"WITH {_BASE}, {_FUSED}, r AS (SELECT qid, did AS doc_id, round(sum(CASE WHEN br = 0 THEN 1.25 ELSE 1.0 END / (60 + rank)), 9) AS rrf, max(nullif(score, 0)) AS best FROM en GROUP BY qid, did) SELECT qid, doc_id, rrf, best, row_number() OVER (PARTITION BY qid ORDER BY rrf DESC, best DESC NULLS LAST, doc_id) AS rank FROM r QUALIFY rank <= 5")
def system_branches_rrf(t: Tables) -> DataFrame:
    return retrieval.fuse("rrf", _entries(Corpus(t)), 5)


@query(f"WITH {_BASE}, {_FUSED}, r AS (SELECT * FROM en QUALIFY row_number() OVER (PARTITION BY qid, did ORDER BY score DESC, br, rank, cid DESC) = 1) SELECT qid, did AS doc_id, score, row_number() OVER (PARTITION BY qid ORDER BY score DESC, br, rank, cid DESC) AS rank FROM r QUALIFY row_number() OVER (PARTITION BY qid ORDER BY score DESC, br, rank, cid DESC) <= 5")
def system_branches_rerank(t: Tables) -> DataFrame:
    return retrieval.fuse("query_rerank", _entries(Corpus(t)), 5)


@query(f"WITH {_BASE}, a AS (SELECT qid, did, row_number() OVER (PARTITION BY qid ORDER BY score DESC, cid) AS r FROM f WHERE own AND timely), b AS (SELECT qid, did, 0 AS route, r FROM a WHERE r <= 3 UNION ALL SELECT qid, did, 1, row_number() OVER (PARTITION BY qid ORDER BY score DESC, cid) FROM s QUALIFY row_number() OVER (PARTITION BY qid ORDER BY score DESC, cid) <= 5), k AS (SELECT * FROM b QUALIFY row_number() OVER (PARTITION BY qid, did ORDER BY route, r) = 1) SELECT qid, did AS doc_id, route, row_number() OVER (PARTITION BY qid ORDER BY route, r, did) AS rank FROM k QUALIFY row_number() OVER (PARTITION BY qid ORDER BY route, r, did) <= 5")
def system_base(t: Tables) -> DataFrame:
    """Documents of facts first (the admitted chunks stand for them), then those of episodes, first place wins."""
    c = Corpus(t)
    docs = c.chunks.select("chunk_id", "doc_id")
    facts = retrieval.search(c.asked, c.chunks, 3, retrieval.is_of() & retrieval.is_in()).join(docs, "chunk_id")
    return retrieval.first_wins([facts, retrieval.search(c.asked, c.chunks, 5).join(docs, "chunk_id")], 5)


def _metas(c: Corpus) -> DataFrame:
    meta = c.chunks.filter("chunk_id % 3 = 0").select(F.col("doc_id").cast("string").alias("doc_id"), temporal.filing_meta(F.col("title")).alias("m"), text.keywords(F.col("text"), F.array(F.lower("ticker")), 3).alias("keywords"), "filed")
    day = F.make_date(F.col("filed"), F.lit(1), F.lit(31))
    period = F.array(F.struct(F.concat(F.lit("year ended January 31, "), F.col("filed").cast("string")).alias("label"), F.lit("annual").alias("type"), F.lit(None).cast("date").alias("start"), day.alias("end")))
    return meta.select("doc_id", "m.*", "keywords", period.alias("periods"), F.col("m.ticker").alias("company"), F.col("m.form").alias("kind"), F.lit("2026-01-01").alias("ingested"))


@query(None)
def system_graph(t: Tables) -> DataFrame:
    """Documents by graph paths over sections, filings and years, with the best of each asked year first."""
    c = Corpus(t)
    return retrieval.by_graph(c.asked, c.chunks, graph.document_edges(_metas(c)), 5, c.summaries())[0]


@query(f"""WITH {_BASE}, m AS (SELECT CAST(did AS VARCHAR) AS d, tick, filed, CASE WHEN annual THEN '10-K' ELSE '10-Q' END AS form, ['audit fees', 'net loss', 'revenue growth'][slug + 1] AS sec, ['audit', 'net', 'revenue'][slug + 1] AS kw1 FROM c WHERE cid % 3 = 0),
    n AS (SELECT *, tick || ' ' || form || ' ' || filed || '-03-15' AS node, filed || '-03-15' AS day FROM m)
    SELECT predicate, count(*) AS n, count(DISTINCT subject) AS subjects, count(DISTINCT object) AS objects, min(subject) AS first_subject, max(object) AS last_object FROM (SELECT DISTINCT subject, predicate, object FROM (
        SELECT tick AS subject, 'has_filing' AS predicate, node AS object FROM n UNION ALL SELECT node, 'has_form_type', form FROM n UNION ALL SELECT node, 'has_filing_date', day FROM n UNION ALL SELECT node, 'has_year', CAST(filed AS VARCHAR) FROM n
        UNION ALL SELECT node, 'has_company', tick FROM n UNION ALL SELECT node, 'has_company_name', tick FROM n UNION ALL SELECT node, 'has_document_type', form FROM n UNION ALL SELECT node, 'has_section', node || ' | Item 7: ' || sec FROM n
        UNION ALL SELECT node || ' | Item 7: ' || sec, 'has_section_family', 'Item 7' FROM n UNION ALL SELECT node || ' | Item 7: ' || sec, 'has_document', d FROM n UNION ALL SELECT d, 'from_company', tick FROM n UNION ALL SELECT d, 'has_document_type', form FROM n
        UNION ALL SELECT d, 'was_ingested_at', '2026-01-01' FROM n UNION ALL SELECT d, 'describes_reporting_period', 'year ended January 31, ' || filed FROM n UNION ALL SELECT d, 'has_reporting_period_end', filed || '-01-31' FROM n)) GROUP BY predicate""")
def filing_edges(t: Tables) -> DataFrame:
    """Edges of filings by predicate: how many, of what, between what; those of keywords are left to tests."""
    out = graph.filing_edges(_metas(Corpus(t))).filter("predicate <> 'has_keyword'")
    return out.groupBy("predicate").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("subject").alias("subjects"), F.count_distinct("object").alias("objects"), F.min("subject").alias("first_subject"), F.max("object").alias("last_object"))


@query("""WITH o AS (SELECT CAST(o_orderkey AS VARCHAR) AS d, 'C' || o_custkey AS tick, strftime(o_orderdate, '%Y-%m-%d') AS day, 'F' || left(o_orderpriority, 1) AS form, CASE WHEN o_orderstatus = 'O' THEN 'Item 1.01' ELSE 'Item 7a' END AS family, strftime(o_orderdate, '%Y') AS y FROM orders),
    n AS (SELECT *, tick || ' ' || form || ' ' || day AS node FROM o),
    a AS (SELECT d AS id, lead(d) OVER (PARTITION BY node ORDER BY day, node, family, d) AS nx, 'document_in_filing' AS p FROM n
        UNION ALL SELECT d, lead(d) OVER (PARTITION BY tick, form, family ORDER BY day, node, family, d), 'same_company_section_doc' FROM n
        UNION ALL SELECT node, lead(node) OVER (PARTITION BY tick, form ORDER BY day, node, family, d), 'same_company_form_filing' FROM (SELECT * FROM n QUALIFY row_number() OVER (PARTITION BY tick, form, node ORDER BY day, node, family, d) = 1))
    SELECT 'has_next_' || p AS predicate, id AS subject, nx AS object FROM a WHERE nx IS NOT NULL UNION ALL SELECT 'has_previous_' || p, nx, id FROM a WHERE nx IS NOT NULL
    UNION ALL SELECT 'has_comparison_group', d, form || ' ' || y || ' ' || family FROM n UNION ALL SELECT 'has_member_document', form || ' ' || y || ' ' || family, d FROM n UNION ALL SELECT 'belongs_to_filing', d, node FROM n""")
def document_links(t: Tables) -> DataFrame:
    """Links between neighbouring documents and filings, both ways, and those to groups, of orders as filings."""
    item = F.when(F.col("o_orderstatus") == "O", "101_entry").otherwise("7a_risk")
    title = F.concat(F.lit("C"), "o_custkey", F.lit("_"), F.date_format("o_orderdate", "yyyy-MM-dd"), F.lit("_F"), F.left("o_orderpriority", F.lit(1)), F.lit("_00_ITEM_"), item)
    metas = t.orders.select(F.col("o_orderkey").cast("string").alias("doc_id"), temporal.filing_meta(title).alias("m")).select("doc_id", "m.*")
    links = [f"has_{way}_{what}" for way in ("next", "previous") for what in ("document_in_filing", "same_company_section_doc", "same_company_form_filing")]
    return graph.document_edges(metas, [*links, "has_comparison_group", "has_member_document", "belongs_to_filing"]).select("predicate", "subject", "object")


@query("""WITH s AS (SELECT 'S' || s_suppkey AS a, 'N' || s_nationkey AS b FROM supplier), e AS (SELECT a AS node, 'in_nation' AS p, b AS other, '→' AS arrow FROM s UNION SELECT b, 'in_nation', a, '←' FROM s UNION SELECT 'N' || n_nationkey, 'in_region', 'R' || n_regionkey, '→' FROM nation UNION SELECT 'R' || n_regionkey, 'in_region', 'N' || n_nationkey, '←' FROM nation),
    n AS (SELECT * FROM e QUALIFY row_number() OVER (PARTITION BY node ORDER BY p, other, arrow DESC) <= 80), h1 AS (SELECT a AS qid, other AS node, 1 AS depth, node || ' ' || arrow || '[' || p || '] ' || other AS path FROM s JOIN n ON node = a),
    h2 AS (SELECT qid, n.other, 2, path || ' | ' || n.node || ' ' || arrow || '[' || p || '] ' || other FROM h1 JOIN n ON n.node = h1.node)
    SELECT qid, node, depth, path, row_number() OVER (PARTITION BY qid, node ORDER BY depth, path) AS no FROM (SELECT * FROM h1 UNION ALL SELECT * FROM h2) QUALIFY no <= 3""")
def graph_paths(t: Tables) -> DataFrame:
    """Ways of at most two edges from each supplier, with their texts."""
    s = t.supplier.select(F.concat(F.lit("S"), "s_suppkey").alias("subject"), F.lit("in_nation").alias("predicate"), F.concat(F.lit("N"), "s_nationkey").alias("object"))
    n = t.nation.select(F.concat(F.lit("N"), "n_nationkey").alias("subject"), F.lit("in_region").alias("predicate"), F.concat(F.lit("R"), "n_regionkey").alias("object"))
    return graph.paths(s.select(F.col("subject").alias("qid"), F.col("subject").alias("seed")), graph.neighbours(s.unionByName(n)))


@query("""WITH w AS (SELECT o_orderkey, CAST(o_orderdate AS DATE) AS filed, list_sort(list(DISTINCT CAST(l_shipdate AS DATE))) AS ends FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey AND l_quantity > 40 GROUP BY ALL),
    d AS (SELECT o_orderkey, filed, list_filter(ends, lambda x: x IS NOT NULL) AS ends FROM w)
    SELECT o_orderkey, array_to_string(list_sort(list_distinct([year(filed)] || list_transform(ends, lambda x: year(x)))), ';') AS years, len(list_filter(CASE WHEN len(ends) > 0 THEN ends ELSE [filed] END, lambda x: x BETWEEN DATE '1994-01-01' AND DATE '1995-06-30')) > 0 AS in_window FROM d""")
def episode_filter(t: Tables) -> DataFrame:
    """Years of each filing and of its periods' ends, and whether it falls into a window by them, or by its own date where it has none."""
    ends = t.lineitem.filter("l_quantity > 40").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.array_sort(F.collect_set(F.to_date("l_shipdate"))).alias("ends"))
    period = F.transform(F.coalesce("ends", F.array().cast("array<date>")), lambda d: F.struct(F.lit("period").alias("label"), F.lit(None).cast("date").alias("start"), d.alias("end")))
    rows = t.orders.select("o_orderkey", F.to_date("o_orderdate").alias("filed")).join(ends, "o_orderkey", "left").withColumn("periods", period)
    window = [F.lit(x).cast("date") for x in ("1994-01-01", "1995-06-30")]
    years = F.transform(temporal.episode_years(F.col("filed"), F.col("periods")), lambda y: y.cast("string"))
    return rows.select("o_orderkey", F.array_join(years, ";").alias("years"), retrieval.within_dates(*window, temporal.window_dates(F.col("filed"), F.col("periods"))).alias("in_window"))


@query("""SELECT event_type AS system, count(*) AS runs, count(*) FILTER (event_id % 7 = 0) AS errors, round(quantile_cont(value, 0.5), 6) AS median_ms, round(quantile_cont(value, 0.95), 6) AS p95_ms, round(avg(value), 6) AS mean_latency_ms,
    round(avg(1.0 / (event_id % 5 + 1)), 6) AS mean_mrr, round(avg(event_id % 3 / 2.0), 6) AS mean_recall_5, round(avg(event_id % 4 / 3.0), 6) AS mean_precision_5, round(avg(event_id % 2), 6) AS mean_hit_5 FROM events GROUP BY event_type""")
def benchmark_summary(t: Tables) -> DataFrame:
    """Runs, errors, latencies and mean quality per system."""
    i = F.col("event_id")
    rows = t.events.select(F.col("event_type").alias("system"), F.col("value").alias("latency_ms"), F.when(i % 7 == 0, "failed").alias("error"), (1 / (i % 5 + 1)).alias("mrr"), (i % 3 / 2).alias("recall_5"), (i % 4 / 3).alias("precision_5"), (i % 2).alias("hit_5"))
    return metrics.system_summary(rows, (5,))


@query("""WITH e AS (SELECT event_type, event_id % 3 AS c, event_id % 4 AS y, event_id % 2 AS k, event_id % 5 AS r, CAST(event_id % 11 = 0 AS INT) AS bad, value FROM events)
    SELECT event_type, count(*) AS questions, round(avg(CAST(c + y + k = 0 AS INT)), 6) AS sufficient_rate, round(avg(c), 6) AS missing_company, round(avg(y), 6) AS missing_year, round(avg(k), 6) AS missing_keypoint, round(avg(r), 6) AS mean_recoveries, sum(bad) AS errors, round(avg(value), 6) AS mean_seconds FROM e GROUP BY event_type""")
def verification_summary(t: Tables) -> DataFrame:
    """Shares of sufficient audits, missing units by kind, recovery queries, errors and seconds per system."""
    i = F.col("event_id")
    some = lambda kind, n: F.transform(F.sequence(F.lit(1), n.cast("int"), F.lit(1)), lambda x: F.concat(F.lit(kind), x.cast("string")))
    units = lambda kind, n: F.when(n > 0, some(kind, F.greatest(n, F.lit(1)))).otherwise(F.array().cast("array<string>"))
    missing = F.concat(units("company:", i % 3), units("year:", i % 4), units("keypoint:", i % 2))
    audits = t.events.select("event_type", missing.alias("missing"), (i % 5).alias("recoveries"), (i % 11 == 0).cast("long").alias("errors"), F.col("value").alias("seconds"))
    return evidence.audit_summary(audits.withColumn("sufficient", F.size("missing") == 0), ["event_type"])


@query("""WITH s AS (SELECT DISTINCT l_orderkey FROM lineitem WHERE l_quantity < 5)
    SELECT o_custkey, count(*) AS n, count(l_orderkey) AS held FROM orders LEFT JOIN s ON l_orderkey = o_orderkey GROUP BY o_custkey HAVING count(*) = count(l_orderkey)""")
def gold_in_sample(t: Tables) -> DataFrame:
    """Questions whose documents are all in a sample (those with a small line)."""
    sample = t.lineitem.filter("l_quantity < 5").select(F.col("l_orderkey").alias("o_orderkey")).distinct().withColumn("held", F.lit(1))
    joined = t.orders.select("o_custkey", "o_orderkey").join(sample, "o_orderkey", "left")
    return joined.groupBy("o_custkey").agg(F.count(F.lit(1)).alias("n"), F.count("held").alias("held")).filter("n = held")


@query("SELECT key, round(avg(v), 6) AS mean_value, count(*) AS n FROM (SELECT unnest([struct_pack(key := 'k', v := CAST(json_extract_string(props, '$.k') AS DOUBLE)), struct_pack(key := 'value', v := value)], recursive := true) FROM events) WHERE v IS NOT NULL GROUP BY key")
def stage_means(t: Tables) -> DataFrame:
    """Mean of every stage in a row's map of timings."""
    timings = F.map_concat(F.coalesce(F.from_json("props", "map<string,double>"), F.create_map().cast("map<string,double>")), F.create_map(F.lit("value"), F.col("value")))
    return t.events.select(F.explode(timings).alias("key", "v")).filter("v is not null").groupBy("key").agg(F.round(F.avg("v"), 6).alias("mean_value"), F.count(F.lit(1)).alias("n"))


@query("SELECT event_type, count(*) AS before, count(*) FILTER (value > 50) AS after, count(DISTINCT user_id) FILTER (value > 50) AS users FROM events GROUP BY event_type")
def filter_counts(t: Tables) -> DataFrame:
    """Rows before and after a filter, per context source."""
    kept = F.col("value") > 50
    return t.events.groupBy("event_type").agg(F.count(F.lit(1)).alias("before"), F.count_if(kept).alias("after"), F.count_distinct(F.when(kept, F.col("user_id"))).alias("users"))


@query("""WITH b AS (SELECT conv_id, turn, '[document=' || conv_id || ' | chunk=' || turn || ']' AS head, trim(text) AS body FROM conversations), k AS (SELECT conv_id, turn, head || chr(10) || body AS block, length(head) AS h FROM b),
    r AS (SELECT conv_id, turn, block, h, 3600 - coalesce(sum(length(block) + 2) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS room FROM k),
    z AS (SELECT *, max(CAST(room <= h + 4 AS INT)) OVER (PARTITION BY conv_id ORDER BY turn) AS full_ FROM r)
    SELECT conv_id, 'Company: C' || conv_id || chr(10) || 'Filing: 10-K filed 2020-01-01' || chr(10) || 'Source evidence excerpts:' || chr(10) || string_agg(left(block, CAST(room AS BIGINT)), chr(10) || chr(10) ORDER BY turn) FILTER (full_ = 0) AS digest FROM z GROUP BY conv_id""")
def filing_excerpts(t: Tables) -> DataFrame:
    """A digest for each conversation as a filing: its turns as excerpts within 3,600 characters."""
    head = F.concat(F.lit("[document="), "conv_id", F.lit(" | chunk="), "turn", F.lit("]"))
    part = F.struct("turn", head.alias("head"), F.concat(head, F.lit("\n"), F.trim("text")).alias("block"))
    held = t.conversations.groupBy("conv_id").agg(F.array_sort(F.collect_list(part)).alias("parts"))
    none = F.array().cast("array<string>")
    excerpts = render.packed(F.col("parts.block"), F.col("parts.head"), 3600)
    return held.select("conv_id", render.digest(F.concat(F.lit("C"), "conv_id"), F.lit("10-K"), F.lit("2020-01-01"), none, none, none, excerpts).alias("digest"))


@query("""SELECT o_orderkey, 'DOCUMENT METADATA' || chr(10) || 'Company: C' || o_custkey || chr(10) || 'Document type: ' || o_orderpriority || chr(10) || 'Ingested at: 2026-01-01' || chr(10) || 'Reporting period: filed (' || strftime(o_orderdate, '%Y-%m-%d') || ')' || chr(10) || 'Keywords: ' || lower(o_orderstatus) || ', order' AS header FROM orders""")
def metadata_headers(t: Tables) -> DataFrame:
    """The text that stands before a chunk when it is embedded."""
    period = F.array(F.struct(F.lit("filed").alias("label"), F.lit("").alias("start"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("end")))
    head = render.metadata_header(F.concat(F.lit("C"), "o_custkey"), F.col("o_orderpriority"), F.lit("2026-01-01"), period, F.array(F.lower("o_orderstatus"), F.lit("order")))
    return t.orders.select("o_orderkey", head.alias("header"))


_NAMED = ["Acorn Mills Inc. and Birch Lane Corp", "the acorn mills", "Cedar Rock Holdings LLC; Cedar Rock Holdings LLC.", "none at all"]


@query("SELECT o_orderkey, ['Acorn Mills Inc;Birch Lane Corp', '', 'Cedar Rock Holdings LLC', ''][o_orderkey % 4 + 1] AS names, ['acorn;mills;inc;birch;lane', 'acorn;mills', 'cedar;rock;holdings;llc', 'none;all'][o_orderkey % 4 + 1] AS topics FROM orders")
def legal_names(t: Tables) -> DataFrame:
    """Legal names and topics in a question's words."""
    said = _pick("o_orderkey", _NAMED)
    return t.orders.select("o_orderkey", F.array_join(ask.legal_names(said), ";").alias("names"), F.array_join(ask.topics(said), ";").alias("topics"))


@query("SELECT o_orderkey, [2020, 2021, NULL, 2019][o_orderkey % 4 + 1] AS filing_year, [2019, 2021, NULL, 2019][o_orderkey % 4 + 1] AS period_year, ['10-K', '10-Q', NULL, 'DEF'][o_orderkey % 4 + 1] AS form, ['2019;2020', '', '1999', '2021'][o_orderkey % 4 + 1] AS years FROM orders")
def title_years(t: Tables) -> DataFrame:
    """Years and form of titles, and years that a question names with the one before."""
    title = _pick("o_orderkey", ["AB.C_2020-02-01_10-k_x", "AB_2021-02-01_10-Q_01", "ab_2021-01-01_10-K", "X-1_2019-12-31_DEF"])
    said = _pick("o_orderkey", ["In 2020 and the prior year", "in 1989 or x2020", "1999", "FY2020, 2021"])
    m = temporal.title_metadata(title, F.lit(2027))
    return t.orders.select("o_orderkey", m["filing_year"].alias("filing_year"), m["period_year"].alias("period_year"), m["filing_form"].alias("form"), F.array_join(F.transform(ask.asked_years(said, F.lit(2027)), lambda y: y.cast("string")), ";").alias("years"))


_TOKEN = r"[A-Za-z0-9][A-Za-z0-9_$%./''&-]*"


@query(f"""WITH q AS (SELECT item_id, list_distinct(regexp_extract_all(lower(text), '{_TOKEN}')) AS qt FROM benchmark WHERE item_id % 10 = 0),
    d AS (SELECT doc_id, list_distinct(regexp_extract_all(lower(text), '{_TOKEN}')) AS dt FROM documents WHERE doc_id IN (SELECT doc_id FROM labels))
    SELECT item_id, doc_id, round(len(list_intersect(qt, dt)) / sqrt(len(qt) * len(dt)), 6) AS overlap FROM q, d WHERE len(qt) > 0 AND len(dt) > 0""")
def overlap_scores(t: Tables) -> DataFrame:
    """The stated questions (every tenth benchmark item) against all labelled documents by shared tokens."""
    q = t.benchmark.filter("item_id % 10 = 0").select("item_id", F.col("text").alias("q"))
    docs = t.documents.join(t.labels.select("doc_id").distinct(), "doc_id", "left_semi").select("doc_id", "text")
    words = lambda c: F.array_distinct(text.tokens(F.lower(c)))
    joined = docs.select("doc_id", words("text").alias("dt")).join(F.broadcast(q.select("item_id", words("q").alias("qt"))))
    return joined.filter("size(qt) > 0 and size(dt) > 0").select("item_id", "doc_id", F.round(F.size(F.array_intersect("qt", "dt")) / F.sqrt(F.size("qt") * F.size("dt").cast("double")), 6).alias("overlap"))


@query("""WITH d AS (SELECT conv_id, turn, list_filter(list_transform(string_split(regexp_replace(text, '([.!?])\\s+', '\\1' || chr(1), 'g'), chr(1)), lambda x: trim(x)), lambda x: x <> '') AS p FROM conversations),
    s AS (SELECT conv_id, turn, unnest(range(0, CAST(len(p) AS BIGINT), 3)) AS a, p FROM d WHERE len(p) > 0), k AS (SELECT conv_id, turn, a // 3 AS no, array_to_string(p[a + 1 : a + 3], ' ') AS strip FROM s),
    t AS (SELECT *, list_distinct(regexp_extract_all(lower(strip), '""" + _TOKEN + """')) AS w FROM k),
    o AS (SELECT *, round(CASE WHEN len(w) > 0 THEN len(list_intersect(w, ['what', 'is', 'the', 'code', 'for'])) / sqrt(5.0 * len(w)) ELSE 0 END + 0.15 * greatest(0, 1.0 / (turn + 1)), 6) AS selection, turn * 10000 + no AS strip_id FROM t)
    SELECT conv_id AS qid, strip_id, selection, row_number() OVER (PARTITION BY conv_id ORDER BY selection DESC, strip_id) AS context_rank FROM o QUALIFY context_rank <= 8""")
def strip_selection(t: Tables) -> DataFrame:
    """Strips of each conversation's turns, the best eight for one question by overlap and the turn's score."""
    asked = F.lit("What is the code for the")
    turns = t.conversations.select("conv_id", "turn", F.posexplode(text.strips(F.col("text"))).alias("no", "strip"))
    rows = turns.select(F.col("conv_id").alias("qid"), (F.col("turn") * 10000 + F.col("no")).alias("strip_id"), text.lexical_overlap(asked, F.col("strip")).alias("overlap"), (1 / (F.col("turn") + 1)).alias("score"))
    return evidence.pick_strips(rows).filter("chosen").select("qid", "strip_id", "selection", "context_rank")


@query("""WITH s AS (SELECT c_custkey, c_name || ' vs ' || n_name AS said FROM customer JOIN nation ON c_nationkey = n_nationkey), k AS (SELECT n_name AS alias, ' ' || trim(regexp_replace(lower(n_name), '[^a-z0-9]+', ' ', 'g')) || ' ' AS a FROM nation)
    SELECT c_custkey, said, alias FROM s JOIN k ON contains(' ' || trim(regexp_replace(lower(said), '[^a-z0-9]+', ' ', 'g')) || ' ', a)""")
def aliases_in_text(t: Tables) -> DataFrame:
    """Names that a text holds as whole words, whatever they are keyed by: each text against all names, a small stated list, sent to it."""
    n = t.nation.select("n_nationkey", "n_name")
    said = t.customer.join(F.broadcast(n), F.col("c_nationkey") == F.col("n_nationkey")).select("c_custkey", F.concat("c_name", F.lit(" vs "), "n_name").alias("said"))
    padded = F.concat(F.lit(" "), selection.plain_words(F.col("said")), F.lit(" "))
    held = t.nation.select(F.col("n_name").alias("alias"))
    return said.join(F.broadcast(held), F.contains(padded, F.concat(F.lit(" "), selection.plain_words(F.col("alias")), F.lit(" ")))).select("c_custkey", "said", "alias")


@query("SELECT item_id, doc_id FROM (SELECT item_id, doc_id, row_number() OVER (ORDER BY item_id) AS r FROM (SELECT item_id, item_id * 3 AS doc_id FROM benchmark)) WHERE r > 5 AND r <= 25")
def question_page(t: Tables) -> DataFrame:
    """Questions from an offset on, up to a limit: both are the operator."""
    return stores.select_questions(t.benchmark.select("item_id", (F.col("item_id") * 3).alias("doc_id")), "item_id", 5, 20)
