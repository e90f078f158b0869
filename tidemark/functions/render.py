"""Text that is rendered for an index or a prompt: metadata headers, evidence blocks, digests; coercions of a model's answer."""

from __future__ import annotations

import hashlib
import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from .questions import unique_text


def metadata_header(company: Column, kind: Column, ingested: Column, periods: Column, keywords: Column) -> Column:
    """The lines that stand before a chunk's text when it is embedded; periods: array of (label, type, start, end)."""
    def told(p: Column) -> Column:
        ends = F.array_join(F.filter(F.array(p["start"].cast("string"), p["end"].cast("string")), lambda x: x.isNotNull() & (x != "")), " to ")
        return F.concat(F.lit("Reporting period: "), p["label"], F.when(ends != "", F.concat(F.lit(" ("), ends, F.lit(")"))).otherwise(""))

    head = F.array(F.lit("DOCUMENT METADATA"), F.concat(F.lit("Company: "), company), F.concat(F.lit("Document type: "), kind), F.concat(F.lit("Ingested at: "), ingested))
    words = F.when(F.size(keywords) > 0, F.array(F.concat(F.lit("Keywords: "), F.array_join(keywords, ", ")))).otherwise(F.array().cast("array<string>"))
    return F.array_join(F.concat(head, F.transform(periods, told), words), "\n")


def raw_evidence(doc_id: Column, company: Column, kind: Column, filed: Column, labels: Column, score: Column, content: Column) -> Column:
    """A chunk of raw evidence under its heading."""
    known = F.array_join(F.filter(labels, lambda x: x != ""), "; ")
    head = F.concat(F.lit("RAW EVIDENCE | DOCUMENT "), doc_id, F.lit(" | company="), F.coalesce(company, F.lit("unknown")), F.lit(" | type="), F.coalesce(kind, F.lit("unknown")), F.lit(" | filing_date="), F.coalesce(filed, F.lit("unknown")))
    return F.concat(head, F.lit(" | reporting_periods="), F.when(known == "", "unknown").otherwise(known), F.lit(" | score="), F.format_string("%.4f", score), F.lit("\n"), content)


def filing_summary(filing: Column, company: Column, filed: Column, score: Column, summary: Column) -> Column:
    """A filing's summary under its heading."""
    return F.concat(F.lit("FILING SUMMARY (navigation only; use raw evidence for claims) | filing="), filing, F.lit(" | company="), company, F.lit(" | filing_date="), filed, F.lit(" | score="), F.format_string("%.4f", score), F.lit("\n"), summary)


def packed(blocks: Column, heads: Column, limit: int, joint: int = 2) -> Column:
    """Blocks in order, each cut to what is left of `limit` characters, a joint charged for each; none begins where its head, and 4 more, does not fit."""
    start = F.struct(F.lit(limit).alias("left"), F.array().cast("array<string>").alias("kept"), F.lit(False).alias("full"))

    def add(state: Column, pair: Column) -> Column:
        full = state["full"] | (state["left"] <= F.length(pair["heads"]) + 4)
        block = F.left(pair["blocks"], state["left"])
        return F.when(full, F.struct(state["left"].alias("left"), state["kept"].alias("kept"), F.lit(True).alias("full"))).otherwise(
            F.struct((state["left"] - F.length(block) - joint).alias("left"), F.concat(state["kept"], F.array(block)).alias("kept"), F.lit(False).alias("full"))
        )

    pairs = F.arrays_zip(blocks.alias("blocks"), heads.alias("heads"))
    return F.array_join(F.aggregate(pairs, start, add)["kept"], "\n\n")


def digest(company: Column, form: Column, filed: Column, periods: Column, sections: Column, keywords: Column, excerpts: Column) -> Column:
    """A filing's summary without a model: who, what, when, periods, at most 20 sections and 30 keywords, excerpts."""
    line = lambda name, values, joint, most: F.when(F.size(values) > 0, F.concat(F.lit(name), F.array_join(unique_text(values, most, 1 << 20), joint)))
    lines = F.array(
        F.concat(F.lit("Company: "), company),
        F.concat(F.lit("Filing: "), form, F.lit(" filed "), filed),
        line("Reporting period(s): ", periods, "; ", 1 << 20),
        line("Covered sections: ", sections, "; ", 20),
        line("Key topics: ", keywords, ", ", 30),
        F.when(excerpts != "", F.concat(F.lit("Source evidence excerpts:\n"), excerpts)),
    )
    return F.array_join(F.filter(lines, lambda x: x.isNotNull()), "\n")


# What may follow a profile in a context.
AFTER_PROFILE = ["FACTS", "CURRENT STATE", "FACT HISTORY", "FACT EVOLUTION", "SESSION SUMMARIES", "RELEVANT CONVERSATIONS", "PROVENANCE RAW EVIDENCE"]


def without_profile(context: Column) -> Column:
    """A context less the profile that it begins with, up to the first known heading after it."""
    rest = F.regexp_extract(context, rf"(?s)^.+?\n\n((?:{'|'.join(AFTER_PROFILE)}).*)$", 1)
    return F.when(context.startswith("USER PROFILE:") & (rest != ""), rest).otherwise(context)


def clamped(value: Column, default: float) -> Column:
    """A number between 0 and 1; the default for what is none or not finite."""
    x = value.try_cast("double")
    return F.when(x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")), default).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), x)))


def int_list(values: Column) -> Column:
    """The whole numbers of an array of strings; others go."""
    return F.filter(F.transform(F.coalesce(values, F.array().cast("array<string>")), lambda x: x.try_cast("int")), lambda x: x.isNotNull())


# Words for the grades of a retrieval.
GRADES = {"correct": ["correct", "good", "high", "relevant", "sufficient"], "incorrect": ["incorrect", "bad", "low", "irrelevant", "insufficient", "none"]}


def grade(label: Column) -> Column:
    """correct, incorrect or, for all other words, ambiguous."""
    plain = F.replace(F.lower(F.trim(F.coalesce(label, F.lit("")))), F.lit("-"), F.lit("_"))
    return F.when(plain.isin(GRADES["correct"]), "correct").when(plain.isin(GRADES["incorrect"]), "incorrect").otherwise("ambiguous")


def json_list(answer: Column) -> Column:
    """The outermost JSON list of a model's answer as text, with or without a fence; null if it has none."""
    return F.nullif(F.regexp_extract(answer, r"(?s)(\[.*\])", 1), F.lit(""))


def slug(name: str) -> str:
    """Letters and digits in small letters, dashes between; an error where none is left."""
    out = re.sub("[^A-Za-z0-9]+", "-", name).strip("-").lower()
    if not out:
        raise ValueError("a name needs a letter or a digit")
    return out


def store_name(namespace: str) -> str:
    """A folder's name for a namespace: at most 48 characters of its slug and 16 of its SHA-256."""
    readable = re.sub("[^A-Za-z0-9]+", "-", namespace).strip("-").lower()[:48] or "namespace"
    return f"{readable}--{hashlib.sha256(namespace.encode()).hexdigest()[:16]}"


# The retrieval systems by name, and a second name of one.
SYSTEMS = ["chroma", "chroma_metadata", "chroma_metadata_multilayer", "chroma_metadata_verified", "chroma_metadata_yearly", "chroma_metadata_nsq", "engram_base", "engram_temporal", "engram_temporal_nsq", "engram_temporal_graph"]
SECOND_NAMES = {"engram": "engram_temporal"}


def system_names(text: str) -> list[str]:
    """Systems of a list with commas or white space, each once; unknown ones are an error."""
    named = list(dict.fromkeys(SECOND_NAMES.get(x, x) for x in re.split(r"[,\s]+", text.strip().lower()) if x))
    unknown = sorted(set(named) - set(SYSTEMS))
    if unknown or not named:
        raise ValueError(f"unknown systems: {unknown}" if unknown else "no system named")
    return named
