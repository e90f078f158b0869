"""Whole retrieval systems over chunks and summaries, each from questions(qid, question, qvec, tickers, years) to ranked rows.

Chunks are chunks(chunk_id, doc_id, ticker, years, form, title, text, vec). Text that a system would embed anew (a question with a
year, a focus or a subquery) is embedded by the caller: qvec is the vector of the text that is asked. Questions are a stated set.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import questions as ask
from ..functions import rules
from . import evidence, graph, ranking, selection

#: Defaults that change results.
POOL, BOOST, SECTION_CAP, YEAR_POOL, LAYER_POOL, RECOVERED = 4, 0.05, 0.12, 20, 3, 3
SUMMARIES, PER_SUMMARY, SEEDS, GRAPH_POOL, ROUTE_BONUS = 4, 2, 12, 40, 0.01


def resolve_tickers(asked: DataFrame, aliases: DataFrame) -> DataFrame:
    """(qid, tickers in order) of asked(qid, question) by aliases(ticker, alias): a ticker named in the question, an alias equal to one of its companies', or, both of several words, one within the other.

    Equal ones are found by an equi-join; the containment test meets the question's aliases, a stated set, in blocks with all known ones.
    """
    known = aliases.select("ticker", "alias").distinct()
    own = known.select("ticker", F.col("ticker").alias("alias")).distinct()
    tokens = asked.select("qid", F.explode(ask.ticker_tokens(F.col("question"))).alias("alias")).distinct()
    names = asked.select("qid", F.explode(ask.company_aliases(F.col("question"))).alias("alias")).distinct()
    equal = tokens.join(own, "alias").unionByName(names.join(known.unionByName(own.withColumn("alias", ask.alias(F.col("alias")))), "alias")).select("qid", "ticker")
    several = known.filter(F.contains("alias", F.lit(" ")))
    both = ranking.in_blocks(names.filter(F.contains("alias", F.lit(" "))).withColumnRenamed("alias", "said"), lambda part: several.join(F.broadcast(part), ask.aliases_match(F.col("said"), F.col("alias"))).select("qid", "ticker"))
    found = equal.unionByName(both).groupBy("qid").agg(F.array_sort(F.collect_set("ticker")).alias("tickers"))
    return asked.select("qid").join(found, "qid", "left").withColumn("tickers", F.coalesce("tickers", F.array().cast("array<string>")))


def legal_name_tickers(asked: DataFrame, filings: DataFrame) -> DataFrame:
    """(qid, tickers): for legal names in asked(qid, question), the tickers of names that exactly one ticker of filings(ticker, text) speaks of."""
    names = asked.select("qid", F.explode(ask.legal_names(F.col("question"))).alias("phrase")).withColumn("name_id", F.xxhash64("qid", "phrase"))
    found = selection.phrase_tickers(names.select("name_id", "phrase"), filings).groupBy("name_id").agg(F.collect_set("ticker").alias("t")).filter(F.size("t") == 1)
    return names.join(found, "name_id").groupBy("qid").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("t")))).alias("tickers"))


def is_of() -> Column:
    """No company asked for, or the chunk's."""
    return (F.size("tickers") == 0) | F.array_contains("tickers", F.col("c_ticker"))


def is_in() -> Column:
    """No year asked for, or one of the chunk's."""
    return (F.size("years") == 0) | F.arrays_overlap("years", "c_years")


def within_dates(start: Column, end: Column, dates: Column) -> Column:
    """No window, or some date in it, both ends included."""
    return start.isNull() | end.isNull() | F.exists(dates, lambda d: d.between(start, end))


def _held(chunks: DataFrame) -> DataFrame:
    return chunks.withColumnsRenamed({"doc_id": "c_doc", "chunk_id": "doc_id", "ticker": "c_ticker", "years": "c_years"})


#: The columns of questions and chunks that a filter by company and year reads.
FILTERED = (["tickers", "years"], ["c_ticker", "c_years"])
DATED = (["tickers", "year"], ["c_ticker", "c_years"])


def search(asked: DataFrame, chunks: DataFrame, k: int, condition: Column | None = None) -> DataFrame:
    """(qid, chunk_id, score, rank) of the k chunks nearest to each question that meet a condition on its tickers, years and the chunk's c_ticker, c_years."""
    return ranking.vector_top_k(asked, _held(chunks), k, condition, FILTERED).withColumnRenamed("doc_id", "chunk_id")


def filtered_search(asked: DataFrame, chunks: DataFrame, k: int, strict: bool = False) -> DataFrame:
    """search by company and year; a question that has either and finds nothing is searched without (unless strict)."""
    found = search(asked, chunks, k, is_of() & is_in())
    filters = (F.size("tickers") > 0) | (F.size("years") > 0)
    return found if strict else ranking.or_else(asked.filter(filters), found, lambda some: search(some, chunks, k))


def documents(asked: DataFrame, chunks: DataFrame, pool: DataFrame, n: int, boost: float = BOOST) -> DataFrame:
    """(qid, doc_id, boosted, rank): the pool(qid, chunk_id, score, rank) lifted by title words that the question shares, one row a document."""
    titled = pool.join(chunks.select("chunk_id", "doc_id", "title"), "chunk_id").join(asked.select("qid", "question"), "qid")
    return selection.title_boost(titled, F.col("question"), F.regexp_replace("title", "_", " "), n, boost)


def plain(asked: DataFrame, chunks: DataFrame, n: int, multiplier: int = POOL) -> DataFrame:
    """Nearest documents: a pool of chunks, one row a document, n of them."""
    pool = search(asked, chunks, n * multiplier).join(chunks.select("chunk_id", "doc_id"), "chunk_id")
    best = ranking.keep_first(pool, ["qid", "doc_id"], [F.col("rank")]).withColumnRenamed("rank", "_rank")
    return ranking.ranked(best, ["qid"], [F.col("_rank")], n).select("qid", "doc_id", "score", "rank")


def by_metadata(asked: DataFrame, chunks: DataFrame, n: int, multiplier: int = POOL, strict: bool = False) -> DataFrame:
    """Documents by company and year filters, with relaxation and title boost."""
    return documents(asked, chunks, filtered_search(asked, chunks, n * multiplier, strict), n)


def layered(asked: DataFrame, chunks: DataFrame, n: int, year_vector: Callable[[DataFrame], DataFrame] = lambda df: df) -> DataFrame:
    """Documents of questions on one company and several years: each year asked for itself, lifted by section and form, years in turn. Other questions go by metadata.

    year_vector: gives the rows (qid, question, qvec, year) the vector of the question with its year.
    """
    staged = (F.size("tickers") == 1) & (F.size("years") >= 2)
    years = year_vector(asked.filter(staged).select("*", F.explode("years").alias("year")))
    keyed = years.withColumnRenamed("qid", "q0").withColumn("qid", F.struct("q0", "year"))
    top = lambda some, on: ranking.vector_top_k(some, _held(chunks), n * LAYER_POOL, on, DATED, "q0")
    found = ranking.or_else(keyed, top(keyed, is_of() & F.array_contains("c_years", F.col("year"))), lambda some: top(some, is_of())).select("qid.q0", "qid.year", F.col("doc_id").alias("chunk_id"), "score")
    about = found.join(chunks.select("chunk_id", "title", "text", "form"), "chunk_id").join(asked.select(F.col("qid").alias("q0"), "question"), "q0")
    lifted = F.round(F.col("score") + rules.section_form_boost(F.col("question"), F.col("title"), F.col("text"), F.col("form"), SECTION_CAP), 6)
    picked = ranking.year_quota(about.select(F.col("q0").alias("qid"), "year", F.col("chunk_id").alias("doc_id"), lifted.alias("score")), n).withColumnRenamed("doc_id", "chunk_id")
    rest = filtered_search(asked.filter(~staged), chunks, n)
    return documents(asked, chunks, picked.select("qid", "chunk_id", "score", "rank").unionByName(rest), n)


def yearly(asked: DataFrame, chunks: DataFrame, n: int, per_year: int = YEAR_POOL) -> DataFrame:
    """Documents with the best chunk of each asked year first: each year is searched within the company, or, where that has none, in all. Questions without years go by metadata."""
    dated = F.size("years") > 0
    keyed = asked.filter(dated).select("*", F.explode("years").alias("year")).withColumnRenamed("qid", "q0").withColumn("qid", F.struct("q0", "year"))
    same = F.array_contains("c_years", F.col("year"))
    top = lambda some, on: ranking.vector_top_k(some, _held(chunks), per_year, on, DATED, "q0")
    found = ranking.or_else(keyed, top(keyed, is_of() & same), lambda some: top(some, same))
    merged = found.groupBy(F.col("qid.q0").alias("qid"), F.col("doc_id").alias("chunk_id")).agg(F.array_sort(F.collect_set("qid.year")).alias("years"), F.max("score").alias("score"))
    picked = ranking.reserve_years(merged.withColumn("doc_id", F.col("chunk_id")), asked, n).drop("doc_id")
    return documents(asked, chunks, picked.unionByName(filtered_search(asked.filter(~dated), chunks, n)), n)


def units_of(asked: DataFrame, chunks: DataFrame, rows: DataFrame, points: bool = True) -> DataFrame:
    """rows(qid, chunk_id, ...) with the units of the question that each chunk supports; asked has tickers, years and keypoints."""
    about = chunks.select("chunk_id", F.col("ticker").alias("c_ticker"), F.col("years").alias("c_years"), "title", "text")
    joined = rows.join(about, "chunk_id").join(asked.select("qid", "tickers", F.col("years").alias("_asked"), "keypoints"), "qid")
    units = ask.chunk_units(F.col("tickers"), F.col("_asked"), F.col("keypoints") if points else None, F.col("c_ticker"), F.col("c_years"), F.col("title"), F.col("text"))
    return joined.withColumn("units", units).select(*rows.columns, "units")


def verified(asked: DataFrame, chunks: DataFrame, n: int, recovered: int = RECOVERED) -> tuple[DataFrame, DataFrame]:
    """(picked, audits): n chunks a question that cover its companies and years, what is missing searched for once more; and what they cover.

    picked(qid, chunk_id, slot); audits(qid, found, missing, evidence, sufficient, metadata_sufficient, recoveries). asked has keypoints as well.
    """
    first = filtered_search(asked, chunks, n * POOL).select("qid", "chunk_id", "score", F.col("rank").alias("pos")).persist()  # a pool for each stated question
    needed = lambda points: asked.select("qid", F.explode(ask.needed_units(F.col("tickers"), F.col("years"), F.col("keypoints") if points else None)).alias("unit"))
    wanted = needed(False).groupBy("qid").agg(F.collect_set("unit").alias("units"))

    def select(pool: DataFrame) -> DataFrame:
        rows = units_of(asked, chunks, pool, False).withColumnRenamed("chunk_id", "doc_id")
        return evidence.greedy_cover(rows, n, wanted).withColumnRenamed("doc_id", "chunk_id")

    def audit(picked: DataFrame, points: bool) -> DataFrame:
        told = units_of(asked, chunks, picked.select("qid", "chunk_id"), points).select("qid", "chunk_id", F.explode("units").alias("unit"))
        return evidence.audit(needed(points), told)

    lacking = audit(select(first), False).select("qid", F.explode("missing").alias("unit")).filter(~F.col("unit").startswith("keypoint:"))
    kind = F.when(F.col("unit").startswith("company:"), F.lit("company")).otherwise(F.col("unit"))
    gaps = lacking.select("qid", kind.alias("gap")).distinct().persist()
    keyed = asked.join(gaps, "qid").withColumn("year", F.regexp_extract("gap", r"^year:(\d+)$", 1).try_cast("int")).withColumnRenamed("qid", "q0").withColumn("qid", F.struct("q0", "gap"))
    on = is_of() & (F.col("year").isNull() | F.array_contains("c_years", F.col("year")))
    more = ranking.vector_top_k(keyed, _held(chunks), recovered, on, DATED, "q0")
    late = more.select(F.col("qid.q0").alias("qid"), F.col("doc_id").alias("chunk_id"), "score", (F.lit(1 << 20) + F.when(F.col("qid.gap") == "company", 0).otherwise(F.regexp_extract("qid.gap", r"(\d+)$", 1).try_cast("int")) * 100 + F.col("rank")).cast("int").alias("pos"))
    picked = select(ranking.keep_first(first.unionByName(late), ["qid", "chunk_id"], [F.col("pos")])).persist()
    counts = gaps.groupBy("qid").agg(F.count(F.lit(1)).alias("recoveries"))
    return picked, audit(picked, True).join(counts, "qid", "left").fillna({"recoveries": 0})


def with_summaries(asked: DataFrame, chunks: DataFrame, summaries: DataFrame, k: int, most: int = SUMMARIES, each: int = PER_SUMMARY, condition: Column | None = None) -> DataFrame:
    """(qid, chunk_id, score, rank): the k chunks within the filters; for broad questions also, of their nearest filing summaries(summary_id, ticker, years, vec, source_ids), the source chunks.

    Each summary allows `each` chunks more; a chunk keeps its best score.
    """
    on = is_of() & is_in() if condition is None else condition
    broad = asked.filter(rules.is_broad(F.col("question"), F.col("years")))
    near = search(broad, summaries.withColumnRenamed("summary_id", "chunk_id").withColumn("doc_id", F.col("chunk_id")), most, is_of() & is_in()).withColumnRenamed("chunk_id", "summary_id")
    found = near.groupBy("qid").agg(F.count(F.lit(1)).alias("summaries"), F.array_sort(F.collect_set("summary_id")).alias("near")).persist()  # a row for each stated question at most
    of = summaries.select("summary_id", F.explode("source_ids").alias("doc_id")).groupBy("doc_id").agg(F.array_sort(F.collect_set("summary_id")).alias("of"))
    sources = ranking.vector_top_k(broad.join(found, "qid"), _held(chunks).select("doc_id", "vec").join(of, "doc_id"), each * most, F.arrays_overlap("near", "of"), (["near"], ["of"]))
    best = sources.join(found, "qid").filter(F.col("rank") <= each * F.col("summaries")).select("qid", F.col("doc_id").alias("chunk_id"), "score")
    if k > 0:
        best = best.unionByName(search(asked, chunks, k, on).select("qid", "chunk_id", "score")).groupBy("qid", "chunk_id").agg(F.max("score").alias("score"))
    merged = ranking.ranked(best, ["qid"], [F.desc("score"), F.col("chunk_id")]).join(found, "qid", "left")
    return merged.filter(F.col("rank") <= k + each * F.coalesce("summaries", F.lit(0))).drop("summaries", "near")


def _scored(asked: DataFrame, chunks: DataFrame, pairs: DataFrame) -> DataFrame:
    """(qid, chunk_id, score) of stated pairs."""
    from ..functions.vectors import cosine

    joined = pairs.join(asked.select("qid", "qvec"), "qid").join(chunks.select("chunk_id", "vec"), "chunk_id")
    return joined.select("qid", "chunk_id", F.round(cosine(F.col("qvec"), F.col("vec")), 6).alias("score")).filter("score is not null")


def fuse(strategy: str, entries: DataFrame, n: int) -> DataFrame:
    """Documents of entries(qid, branch_no, branch, doc_id, evidence_id, rank, score, text), one ranking per branch, by one of three strategies.

    rrf: reciprocal ranks, the question itself weighing more. query_rerank: each document's best score for the question itself, ties to
    the parent branch, then the better rank, then the larger evidence id. coverage: a slot for each year and metric.
    """
    if strategy == "rrf":
        return ranking.reciprocal_rank_fusion(entries.withColumnRenamed("branch_no", "branch_").drop("branch").withColumnRenamed("branch_", "branch")).filter(F.col("rank") <= n)
    if strategy == "query_rerank":
        order = [F.desc_nulls_last("score"), F.desc(F.col("branch_no") == 0), F.col("rank"), F.desc("evidence_id")]
        best = ranking.keep_first(entries, ["qid", "doc_id"], order)
        return ranking.ranked(best.withColumnRenamed("rank", "_rank"), ["qid"], [order[0], order[1], F.col("_rank"), order[3]], n).select("qid", "doc_id", "score", "rank")
    if strategy == "coverage":
        return selection.coverage_slots(entries, n)
    raise ValueError(f"unknown strategy {strategy}")


def first_wins(routes: list[DataFrame], n: int) -> DataFrame:
    """(qid, doc_id, route, rank) of routes(qid, doc_id, rank) one after another: a document stays at its first place, n in all. No scores are told."""
    rows = [r.select("qid", "doc_id", F.lit(i).alias("route"), F.col("rank").alias("_rank")) for i, r in enumerate(routes)]
    every = rows[0]
    for r in rows[1:]:
        every = every.unionByName(r)
    kept = ranking.keep_first(every.filter("doc_id is not null"), ["qid", "doc_id"], [F.col("route"), F.col("_rank")])
    return ranking.ranked(kept, ["qid"], [F.col("route"), F.col("_rank"), F.col("doc_id")], n).select("qid", "doc_id", "route", "rank")


def merge_candidates(routes: dict[str, DataFrame], bonus: dict[str, float]) -> DataFrame:
    """(qid, chunk_id, score, routes): candidates(qid, chunk_id, score) of several routes, the best score with its route's bonus, and all routes."""
    every = None
    for name, rows in routes.items():
        part = rows.select("qid", "chunk_id", F.round(F.col("score") + bonus.get(name, 0.0), 6).alias("score"), F.lit(name).alias("route"))
        every = part if every is None else every.unionByName(part)
    return every.groupBy("qid", "chunk_id").agg(F.max("score").alias("score"), F.array_sort(F.collect_set("route")).alias("routes"))


def by_graph(asked: DataFrame, chunks: DataFrame, links: DataFrame, n: int, summaries: DataFrame | None = None, focus: DataFrame | None = None, hops: int = 2) -> tuple[DataFrame, DataFrame]:
    """(documents, paths): nearest chunks, those of documents that the graph links(subject, predicate, object) connects to them, and summaries' sources, the best of each asked year first.

    focus(qid, question, qvec, ...): the question with each of its topics, whose three nearest chunks are seeds as well. Only documents within the
    company and year filters are reached; a company's filter alone holds where the years' has no chunk.
    """
    on = is_of() & is_in()
    direct = ranking.or_else(asked, search(asked, chunks, max(n, SEEDS), on), lambda some: search(some, chunks, max(n, SEEDS), is_of())).persist()  # a pool for each stated question
    seeds = direct.select("qid", "chunk_id")
    if focus is not None:
        seeds = seeds.unionByName(search(focus, chunks, 3, on).select("qid", "chunk_id"))
    start = seeds.join(chunks.select("chunk_id", "doc_id"), "chunk_id").select("qid", F.col("doc_id").cast("string").alias("seed")).distinct()
    paths = graph.paths(start, graph.neighbours(links.filter(F.col("predicate").isin(graph.STRUCTURAL))), hops)
    reached = paths.select("qid", F.col("node").alias("doc_id")).distinct().join(chunks.withColumn("doc_id", F.col("doc_id").cast("string")).select("doc_id", "chunk_id", F.col("ticker").alias("c_ticker"), F.col("years").alias("c_years")), "doc_id")
    allowed = reached.join(asked.select("qid", "tickers", "years"), "qid").filter(on & (F.col("chunk_id") != F.col("qid"))).select("qid", "chunk_id")
    linked = ranking.ranked(_scored(asked, chunks, allowed), ["qid"], [F.desc("score"), F.col("chunk_id")], max(n, GRAPH_POOL))
    routes = {"direct_vector": direct, "graph_path_rerank": linked}
    if summaries is not None:
        routes["filing_summary_evidence"] = with_summaries(asked, chunks, summaries, 0)
    merged = merge_candidates(routes, {"graph_path_rerank": ROUTE_BONUS}).join(chunks.select("chunk_id", "doc_id", "years"), "chunk_id")
    picked = ranking.reserve_years(merged, asked, n)
    told = paths.join(allowed.join(chunks.select("chunk_id", "doc_id"), "chunk_id").select("qid", F.col("doc_id").cast("string").alias("node")).distinct(), ["qid", "node"])
    return picked, told
