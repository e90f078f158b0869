"""Edges, adjacency and bounded expansion of a fact graph."""

from __future__ import annotations

from functools import reduce

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


# Edges that a path may follow.
STRUCTURAL = [
    "belongs_to_company", "belongs_to_filing", "has_year", "has_section", "has_section_family", "has_comparison_group", "has_member_document",
    "has_next_document_in_filing", "has_previous_document_in_filing", "has_next_same_company_section_doc", "has_previous_same_company_section_doc",
    "has_next_same_company_form_filing", "has_previous_same_company_form_filing",
]


def facts(rows: DataFrame) -> DataFrame:
    """Facts (subject, predicate, object) without blanks; those that differ in case only are one, the first by seq."""
    w = Window.partitionBy(*(F.lower(c) for c in ("subject", "predicate", "object"))).orderBy("seq")
    full = rows.filter((F.trim("subject") != "") & (F.trim("predicate") != "") & (F.trim("object") != ""))
    return full.withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_n")


def edges(rows: DataFrame, made: list[tuple[Column, str, Column]]) -> DataFrame:
    """One edge per row and template."""
    return rows.select(F.inline(F.array(*[F.struct(s.cast("string").alias("subject"), F.lit(p).alias("predicate"), o.cast("string").alias("object")) for s, p, o in made])))


def filing_edges(metas: DataFrame) -> DataFrame:
    """Edges of metas(doc_id, company, kind, ingested, periods, keywords and the fields of a filing's title): thirteen for each, and those of its periods and keywords."""
    c = F.col
    base = [
        ("ticker", "has_filing", "filing_node"), ("filing_node", "has_form_type", "form"), ("filing_node", "has_filing_date", "filing_date"),
        ("filing_node", "has_year", "year"), ("filing_node", "has_company", "ticker"), ("filing_node", "has_company_name", "company"),
        ("filing_node", "has_document_type", "kind"), ("filing_node", "has_section", "section_node"), ("section_node", "has_section_family", "family"),
        ("section_node", "has_document", "doc_id"), ("doc_id", "from_company", "company"), ("doc_id", "has_document_type", "kind"), ("doc_id", "was_ingested_at", "ingested"),
    ]
    out = edges(metas, [(c(s), p, c(o)) for s, p, o in base])
    period = metas.select("doc_id", F.explode("periods").alias("p"))
    dates = [(c("doc_id"), "describes_reporting_period", c("p.label")), (c("doc_id"), "has_reporting_period_start", c("p.start")), (c("doc_id"), "has_reporting_period_end", c("p.end"))]
    words = metas.select(c("doc_id").cast("string").alias("subject"), F.lit("has_keyword").alias("predicate"), F.explode("keywords").alias("object"))
    return out.unionByName(edges(period, dates)).unionByName(words).filter("trim(subject) <> '' and trim(object) <> ''").distinct()


def document_edges(metas: DataFrame, predicates: list[str] | None = None) -> DataFrame:
    """Nine edges for each document, and those to the next and the previous document of its filing and of its company's section, and filing of its company's form; of some predicates only, where they are given.

    Documents are counted first: where each stands in one row, its edges are distinct as they are made, and only pairs of filings are compared.
    """
    c = F.col
    kept = lambda made: [e for e in made if predicates is None or e[1] in predicates]
    own = [("belongs_to_company", "ticker"), ("belongs_to_filing", "filing_node"), ("has_form_type", "form"), ("has_filing_date", "filing_date"), ("has_year", "year"), ("has_section", "section_node"), ("has_section_family", "family"), ("has_comparison_group", "comparison_group")]
    made = kept([(c("doc_id"), p, c(o)) for p, o in own] + [(c("comparison_group"), "has_member_document", c("doc_id"))])
    once = (metas.groupBy(c("doc_id").cast("string").alias("id")).agg(F.count(F.lit(1)).alias("n")).agg(F.max("n")).first()[0] or 0) <= 1
    # what titles tell is worked out once, for all parts; on disk, as there is a row for each document
    metas = metas.select("doc_id", "ticker", "filing_node", "form", "filing_date", "year", "section_node", "family", "comparison_group").persist(StorageLevel.DISK_ONLY)
    parts = [edges(metas, made) if once else edges(metas, made).distinct()] if made else []
    order = ["filing_date", "filing_node", "family", "doc_id"]
    for by, node, name in ((["filing_node"], "doc_id", "document_in_filing"), (["ticker", "form", "family"], "doc_id", "same_company_section_doc"), (["ticker", "form"], "filing_node", "same_company_form_filing")):
        both = kept([(c("id"), f"has_next_{name}", c("next_id")), (c("next_id"), f"has_previous_{name}", c("id"))])
        if both:
            dealt = metas.select(*dict.fromkeys([*by, *order])).repartition(*by)  # once for both windows
            pairs = adjacent(first_of(dealt, [*by, node], order), by, order, node)
            parts.append(edges(pairs if once and node == "doc_id" else pairs.distinct(), both))
    return reduce(DataFrame.unionByName, parts)


def summary_edges(summaries: DataFrame) -> DataFrame:
    """Edges between a filing and its summary, of summaries(filing_node, summary_node)."""
    f, s = F.col("filing_node"), F.col("summary_node")
    return edges(summaries, [(f, "has_filing_summary", s), (s, "summarizes_filing", f)])


def first_of(rows: DataFrame, by: list[str], order: list[str]) -> DataFrame:
    w = Window.partitionBy(*by).orderBy(*order)
    return rows.withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_n")


def adjacent(rows: DataFrame, by: list[str], order: list[str], id_col: str) -> DataFrame:
    """(id, next_id) of neighbours in order within a group."""
    w = Window.partitionBy(*by).orderBy(*order)
    return rows.select(F.col(id_col).alias("id"), F.lead(id_col).over(w).alias("next_id")).filter("next_id is not null")


def neighbours(links: DataFrame, most: int = 80) -> DataFrame:
    """(node, other, predicate, arrow) both ways, per node the first `most` by predicate, other and direction (out first)."""
    out = links.select(F.col("subject").alias("node"), "predicate", F.col("object").alias("other"), F.lit("→").alias("arrow"))
    both = out.unionByName(links.select(F.col("object").alias("node"), "predicate", F.col("subject").alias("other"), F.lit("←").alias("arrow")))
    w = Window.partitionBy("node").orderBy("predicate", "other", F.desc("arrow"))
    return both.distinct().withColumn("_n", F.row_number().over(w)).filter(F.col("_n") <= most).drop("_n")


def reach(seeds: DataFrame, near: DataFrame, hops: int = 2) -> DataFrame:
    """(seed, node, depth) of nodes within so many hops of seeds(seed), each at its least depth."""
    seen = seeds.select("seed", F.col("seed").alias("node"), F.lit(0).alias("depth"))
    front = seen
    for depth in range(1, hops + 1):
        front = front.join(near, "node").select("seed", F.col("other").alias("node"), F.lit(depth).alias("depth")).distinct()
        seen = seen.unionByName(front)
    return seen.groupBy("seed", "node").agg(F.min("depth").alias("depth"))


def paths(seeds: DataFrame, near: DataFrame, hops: int = 2, most: int = 3) -> DataFrame:
    """(qid, node, depth, path, no): ways of at most so many edges from seeds(qid, seed) to other nodes, `most` for each node, the shorter first, then in order of letters.

    A node is gone on from once, at its least depth, by the first of the ways that reach it.
    """
    step = F.concat("at", F.lit(" "), "arrow", F.lit("["), "predicate", F.lit("] "), "other")
    front = seeds.distinct().select("qid", F.col("seed").alias("at"), F.lit("").alias("path"))
    seen, found = front.select("qid", "at"), None
    for depth in range(1, hops + 1):
        gone = front.join(near.withColumnRenamed("node", "at"), "at").select("qid", F.col("other").alias("node"), F.lit(depth).alias("depth"), F.concat("path", F.when(F.col("path") != "", " | ").otherwise(""), step).alias("path"))
        found = gone if found is None else found.unionByName(gone)
        fresh = gone.groupBy("qid", F.col("node").alias("at")).agg(F.min("path").alias("path"))
        front = fresh.join(seen, ["qid", "at"], "left_anti").select("qid", "at", "path")
        seen = seen.unionByName(front.select("qid", "at"))
    w = Window.partitionBy("qid", "node").orderBy("depth", "path")
    # dealt by node before ways are compared, so that the few tasks of much used nodes send theirs on and hold none
    numbered = found.repartition("qid", "node").withColumn("_again", F.lag(F.struct("depth", "path")).over(w).eqNullSafe(F.struct("depth", "path"))).withColumn("no", F.dense_rank().over(w))
    return numbered.filter((F.col("no") <= most) & ~F.col("_again")).drop("_again")


def export(links: DataFrame, text: str = "", live_only: bool = True, limit: int | None = None) -> DataFrame:
    """Edges whose nodes or predicate hold a text (case does not count), those that are not ended (invalid_at, where there is such a column), in order, up to a limit."""
    words = F.lower(F.concat_ws(" ", "subject", "predicate", "object"))
    out = links.filter(F.contains(words, F.lit(text.lower())))
    if live_only and "invalid_at" in links.columns:
        out = out.filter("invalid_at is null")
    return out if limit is None else out.orderBy("subject", "predicate", "object").limit(limit)
