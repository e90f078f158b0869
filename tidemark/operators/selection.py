"""Boosts, corrective routes, coverage slots, phrase resolution, range joins and model hooks."""

from __future__ import annotations

import re
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import rules
from ..functions.text import TOKEN, bind, tokens
from .ranking import keep_first, picked, ranked

#: Names that are sent to all tasks at once; more names are joined by a shuffle.
BROADCAST_NAMES = 100_000


def title_boost(pool: DataFrame, question: Column, title: Column, k: int, weight: float = 0.05) -> DataFrame:
    """pool(qid, doc_id, score, rank, ...) again in order of score + weight x shared tokens, ties by rank; a document's best row stays."""
    shared = F.size(F.array_intersect(tokens(F.lower(question)), tokens(F.lower(title))))
    boosted = pool.withColumn("boosted", F.round(F.col("score") + weight * shared, 6))
    best = keep_first(boosted, ["qid", "doc_id"], [F.desc("boosted"), F.col("rank")])
    return ranked(best.withColumnRenamed("rank", "_rank"), ["qid"], [F.desc("boosted"), F.col("_rank"), F.col("doc_id")], k).select("qid", "doc_id", "boosted", "rank")


def corrective(initial: DataFrame, expanded: DataFrame, half: int = 4) -> DataFrame:
    """Routes initial(qid, doc_id, score, rank, useful) by its best score; expanded(qid, doc_id, rank) is what the rewritten question finds.

    From 0.45 correct: the useful rows (all, if none is). From 0.25 ambiguous: the useful rows (the first half, if none is),
    then the expanded. Else the expanded (the initial, if there are none). A document stays at its first place.
    """
    per = initial.groupBy("qid").agg(F.max("score").alias("best"), F.bool_or("useful").alias("some"))
    per = per.join(expanded.select("qid").distinct().withColumn("more", F.lit(True)), "qid", "left")
    grade = F.when(F.col("best") >= 0.45, "correct").when(F.col("best") >= 0.25, "ambiguous").otherwise("incorrect")
    per = per.select("qid", grade.alias("grade"), "some", F.coalesce("more", F.lit(False)).alias("more"))
    g = F.col("grade")
    first = F.when(g == "incorrect", ~F.col("more")).otherwise(F.when(F.col("some"), F.col("useful")).otherwise((g == "correct") | (F.col("rank") <= half)))
    a = initial.join(per, "qid").filter(first).select("qid", "grade", "doc_id", F.lit(0).alias("_step"), F.col("rank").alias("_rank"))
    b = expanded.join(per, "qid").filter(g != "correct").select("qid", "grade", "doc_id", F.lit(1).alias("_step"), F.col("rank").alias("_rank"))
    kept = keep_first(a.unionByName(b), ["qid", "doc_id"], [F.col("_step"), F.col("_rank")])
    return ranked(kept, ["qid"], [F.col("_step"), F.col("_rank")]).select("qid", "grade", "doc_id", "rank")


_PATTERNS = {label: re.compile(pattern, re.IGNORECASE) for label, pattern in rules.METRICS}


def slots_of(branches: list[str], text: Callable[[str], re.Pattern] | None = None) -> list[tuple[str, re.Pattern]]:
    """What a question's branches ask for: a slot for each year, then for each metric, with the pattern that a text must match. Further matchers may be given by text."""
    asked = "\n".join(sorted(set(branches)))
    years = sorted(set(re.findall(r"(?<!\d)(?:19|20)\d\d(?!\d)", asked)))
    return [(f"year:{y}", re.compile(y)) for y in years] + [(f"metric:{m}", p) for m, p in _PATTERNS.items() if p.search(asked)] + ([("text", text(asked))] if text else [])


def coverage_slots(entries: DataFrame, n: int, matcher: Callable[[str], re.Pattern] | None = None) -> DataFrame:
    """n documents per qid of entries(qid, branch_no, branch, doc_id, evidence_id, rank, score, text), one slot for each year and each metric that the branches name.

    Returns qid, slot (null for documents that fill the rest), status, doc_id. An entry matches a slot by its text, or, where
    no text does, by its branch. A qid's entries are a bounded pool of a few branches.
    """
    known = F.col("score").isNotNull() & ~F.isnan(F.col("score").cast("double"))
    order = [F.desc(known), F.desc("score"), F.desc(F.col("branch_no") == 0), F.col("rank"), F.desc("evidence_id")]

    def pick(pool: list[dict]) -> list[dict]:
        taken: dict = {}
        out = []

        def told(slot: str | None, status: str, doc) -> None:
            out.append({"qid": pool[0]["qid"], "slot": slot, "status": status, "doc_id": doc})

        for slot, pattern in slots_of([r["branch"] for r in pool], matcher):
            by_text = {r["doc_id"]: r for r in reversed(pool) if pattern.search(r["text"] or "")}
            fits = [r["doc_id"] for r in pool if (r["doc_id"] in by_text if by_text else pattern.search(r["branch"]))]
            covered = next((d for d, r in taken.items() if pattern.search(r["text"] or "")), None)
            free = next((d for d in fits if d not in taken), None)
            if not fits:
                told(slot, "unavailable", None)
            elif covered is not None:
                told(slot, "covered_by_selected_evidence", covered)
            elif free is None:
                told(slot, "only_available_in_already_selected_document", fits[0])
            elif len(taken) >= n:
                told(slot, "no_remaining_result_slot", free)
            else:
                taken[free] = by_text.get(free) or next(r for r in pool if r["doc_id"] == free)
                told(slot, "selected", free)
        for r in pool:
            if len(taken) < n and r["doc_id"] not in taken:
                taken[r["doc_id"]] = r
                told(None, "filled", r["doc_id"])
        return out

    rows = entries.withColumn("slot", F.lit(None).cast("string")).withColumn("status", F.lit(None).cast("string"))
    return picked(rows, "qid", order, pick, ["qid", "slot", "status", "doc_id"], "no").drop("no")


def plain_words(text: Column) -> Column:
    """Lower-case runs of a-z and 0-9 with one space between."""
    return F.trim(F.regexp_replace(F.lower(text), "[^a-z0-9]+", " "))


def phrase_tickers(names: DataFrame, docs: DataFrame) -> DataFrame:
    """(name_id, ticker), each once, of names(name_id, phrase) that texts of docs(ticker, text) hold as whole words.

    Names are looked up by the first word of each, then compared whole at the places where it stands: in the worker, by one pass over
    each text, where the names are few enough to be sent; else by a join on word runs of the names' lengths.
    """
    plain = names.select("name_id", plain_words(F.col("phrase")).alias("phrase")).filter("phrase <> ''")
    n = plain.count()
    said = docs.filter("ticker is not null and text is not null").select("ticker", plain_words(F.col("text")).alias("said"))
    if n <= BROADCAST_NAMES:
        listed: dict = {}
        for r in plain.collect():  # at most BROADCAST_NAMES rows
            listed.setdefault(r["phrase"].split(" ", 1)[0], []).append((f" {r['phrase']} ", r["name_id"]))
        sent = names.sparkSession.sparkContext.broadcast(listed)

        def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            known = set()
            for batch in batches:
                found = set()
                for ticker, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                    padded = f" {text} "
                    for word in sent.value.keys() & set(text.split(" ")):
                        found.update((name, ticker) for phrase, name in sent.value[word] if (name, ticker) not in known and phrase in padded)
                known |= found if len(known) < 1_000_000 else set()
                rows = sorted(found)
                yield pa.RecordBatch.from_arrays([pa.array([a for a, _ in rows], pa.int64()), pa.array([t for _, t in rows], pa.string())], names=["name_id", "ticker"])

        return said.select(F.col("ticker").cast("string"), "said").mapInArrow(work, "name_id long, ticker string").distinct()
    words = F.split("phrase", " ")
    keyed = plain.withColumn("size", F.size(words)).withColumn("key", F.col("phrase"))
    sizes = [r["size"] for r in keyed.select("size").distinct().collect()]  # lengths of names in words
    run = lambda w, k: F.transform(F.sequence(F.lit(1), F.size(w) - k + 1), lambda i: F.array_join(F.slice(w, i, F.lit(k)), " "))
    runs = bind(F.split("said", " "), lambda w: F.array_distinct(F.concat(*[F.when(F.size(w) >= k, run(w, k)).otherwise(F.array().cast("array<string>")) for k in sizes])))
    maybe = said.select(F.col("ticker").cast("string"), F.explode(runs).alias("key")).distinct().join(keyed, "key")
    return maybe.select("name_id", "ticker").distinct()


def resolve_phrases(names: DataFrame, docs: DataFrame) -> DataFrame:
    """Per name of names(name_id, phrase): tickers, the number of distinct ticker among docs(ticker, text) that hold the phrase as whole words, and status."""
    per = phrase_tickers(names, docs).groupBy("name_id").agg(F.count(F.lit(1)).alias("tickers"))
    n = F.coalesce("tickers", F.lit(0)).cast("long")
    status = F.when(n == 1, "resolved").when(n > 1, "ambiguous").otherwise("unresolved")
    return names.select("name_id").join(per, "name_id", "left").select("name_id", n.alias("tickers"), status.alias("status"))


def within(windows: DataFrame, rows: DataFrame, date: str) -> DataFrame:
    """rows joined to windows(qid, start, end) that hold their date, both ends included: an equi-join on months, then the exact test."""
    months = F.sequence(F.trunc("start", "month"), F.trunc("end", "month"), F.expr("interval 1 month"))
    binned = windows.filter(F.col("start") <= F.col("end")).withColumn("_month", F.explode(months))
    return rows.withColumn("_month", F.trunc(date, "month")).join(binned, "_month").filter(F.col(date).between(F.col("start"), F.col("end"))).drop("_month")


def hashed_embedding(texts: list[str], size: int = 256) -> np.ndarray:
    """Unit vectors of 1 + ln(tf) at hashed tokens; a text without tokens has the zero vector."""
    out = np.zeros((len(texts), size), np.float32)
    for row, text in zip(out, texts, strict=True):
        at, n = np.unique([zlib.crc32(t.lower().encode()) % size for t in re.findall(TOKEN, text)], return_counts=True)
        row[at.astype(int)] = 1 + np.log(n)
        row /= max(np.linalg.norm(row), 1e-12)
    return out


def embed(rows: DataFrame, text: str, embedder: Callable[[list[str]], np.ndarray] = hashed_embedding) -> DataFrame:
    """rows with a column embedding, made in batches by a function of texts (null counts as empty)."""

    def work(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            yield part.assign(embedding=[v.tolist() for v in embedder([x or "" for x in part[text]])])

    return rows.mapInPandas(work, rows.select("*", F.array().cast("array<float>").alias("embedding")).schema)


def complete(rows: DataFrame, prompt: str, model: Callable[[str], str]) -> DataFrame:
    """rows with columns completion and error: the model's answer to the prompt, or null and what it raised."""

    def ask(text: str | None) -> tuple[str | None, str | None]:
        try:
            return model(text or ""), None
        except Exception as e:  # an answer that fails is a row, not the end of the job
            return None, f"{type(e).__name__}: {e}"

    def work(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            got = [ask(x) for x in part[prompt]]
            yield part.assign(completion=[a for a, _ in got], error=[e for _, e in got])

    empty = F.lit(None).cast("string")
    return rows.mapInPandas(work, rows.select("*", empty.alias("completion"), empty.alias("error")).schema)
