"""Questions as column expressions: companies, tickers, years, keypoints, topics, branches; what a chunk has of them."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import bind, tokens

# Legal suffixes of company names, in a question and in an alias.
SUFFIXES = "INC INCORPORATED CORP CORPORATION COMPANY CO LTD LIMITED PLC LLC LP NV".split()

# Words that end a company's name to the left in a question.
STOPWORDS = """A AN AND ARE AS AT ABOUT BETWEEN BY COMPARE COMPARED DID DO DURING FOR FROM GIVEN HAD HAS HAVE HOW IN INTO IS KEY OF ON OR
REPORTED THE THEIR THIS TO WAS WERE WHAT WHEN WHERE WHICH WHO WITH""".split()

# Further words that are no keypoint of a question.
KEYPOINT_STOPWORDS = """ACROSS AFTER AGAINST ALL ALSO AMONG ANY AROUND BE BEEN BEFORE BEING BETWEEN BOTH CAN COULD CURRENT DATA DESCRIBE DETAIL
DIFFER DIFFERENT DID DO DOES EACH END EXPLAIN FIRST GIVE GIVEN HAD HAS HAVE IMPACT INFORMATION ITS KEY LAST MAIN MAKE MOST MORE MUCH NEED NEW
NEXT NO NOT NOW OF ONE OTHER OUR OUT OVER PAST PER PLEASE QUESTION RECENT RELEVANT REPORTED RESULT RESULTS SAME SECOND SHOW SINCE SO SUCH
SUMMARIZE TELL THAN THAT THE THESE THEY THIRD THOSE TIME TIMES TODAY TOTAL TOWARD THROUGH UP USE USING VERSUS VERY WANT WAY WE WERE WHAT WHEN
WHICH WHO WHY WILL WOULD YEAR YEARS YOU""".split()

# Words that are no topic of a question.
TOPIC_STOPWORDS = """about across after analyze and are between change changes compare comparing company did does each from how identify
including into its main more of or report specific the their these this through to trend what which with year years""".split()

# Tokens in capitals that are no ticker.
NO_TICKERS = ["SEC", "GAAP", "ROPA", "FY", "CEO", "CFO"]

# Patterns of a company's legal name in a question, of one in capitals in a filing, and of one before a registry number.
LEGAL_NAME = r"\b(?:[A-Z][A-Za-z0-9&'’.-]*\s+){1,7}(?:Inc(?:orporated)?|Corp(?:oration)?|Company|Co|Ltd|Limited|LLC|L\.L\.C\.|PLC)\.?\b"
_ENDS = "(?:INC|INCORPORATED|CORP|CORPORATION|COMPANY|CO|LTD|LIMITED|PLC|LLC|LP|N\\.V{0})(?:/[A-Z]{{2}})?"
CAPITAL_NAME = r"\b([A-Z][A-Z0-9/&.-]*(?:[ _-]+[A-Z0-9/&.-]+){0,8}(?:[ _/-]+" + _ENDS.format("|NV") + r"))\b"
NUMBERED_NAME = r"(?i)\b([A-Z][A-Z0-9&.,/' -]{3,}?" + _ENDS.format("") + r")0{3,}\d{4,}"


def _among(word: Column, words: list[str]) -> Column:
    return word.isin(words)


def alias(name: Column) -> Column:
    """A company name in capitals, words of letters and digits, without legal suffixes."""
    plain = F.upper(F.regexp_replace(name, "[^A-Za-z0-9]+", " "))
    return F.trim(F.regexp_replace(F.regexp_replace(plain, rf"\b(?:{'|'.join(SUFFIXES[:-1])})\b", " "), r"\s+", " "))


def company_aliases(question: Column) -> Column:
    """Aliases of the companies that a question names by a legal suffix: up to seven words before it, back to a stopword, a suffix or a year."""
    words = F.regexp_extract_all(question, F.lit("([A-Za-z0-9]+(?:/[A-Za-z]{2})?)"), F.lit(1))
    suffix = lambda w: _among(F.substring_index(F.upper(w), "/", 1), SUFFIXES)
    stop = lambda w: _among(F.upper(w), STOPWORDS + SUFFIXES) | w.rlike(r"^(?:19|20)\d{2}$")

    def named(ws: Column) -> Column:
        def one(i: Column) -> Column:
            before = F.transform(F.sequence(F.lit(1), i), lambda j: F.when((j < i) & stop(F.element_at(ws, j)), j).otherwise(0))
            first = F.greatest(F.array_max(before) + 1, i - 7)
            return F.when(i > first, alias(F.array_join(F.slice(ws, first, i - first + 1), " ")))

        at = F.filter(F.transform(ws, lambda w, i: F.when(suffix(w), i + 1).otherwise(0)), lambda i: i > 0)
        return F.transform(at, one)

    return F.array_distinct(F.filter(bind(words, named), lambda a: a.isNotNull() & (a != "")))


def ticker_tokens(question: Column) -> Column:
    """Words of two to six letters, in capitals whatever their case was, that may be tickers."""
    return F.array_except(F.regexp_extract_all(F.upper(question), F.lit(r"\b([A-Z]{2,6})\b"), F.lit(1)), F.array(*map(F.lit, NO_TICKERS)))


def record_aliases(title: Column, text: Column) -> Column:
    """Aliases in a filing's title (its first part, and parts five to twelve) and in the first 5,000 characters of its text."""
    parts, head = F.split(title, "_"), F.left(text, F.lit(5000))
    found = F.concat(
        F.array(F.get(parts, F.lit(0)), F.when(F.size(parts) > 4, F.array_join(F.slice(parts, 5, 8), " "))),
        F.regexp_extract_all(head, F.lit(NUMBERED_NAME), F.lit(1)),
        F.regexp_extract_all(F.upper(head), F.lit(CAPITAL_NAME), F.lit(1)),
    )
    return F.array_sort(F.array_distinct(F.filter(F.transform(F.filter(found, lambda x: x.isNotNull()), alias), lambda a: F.length(a) >= 2)))


def aliases_match(asked: Column, known: Column) -> Column:
    """If two aliases are equal, or both have two words or more and one holds the other."""
    several = asked.contains(" ") & known.contains(" ")
    return (asked == known) | (several & (asked.contains(known) | known.contains(asked)))


def legal_names(question: Column, limit: int = 4) -> Column:
    """Phrases that look like legal names, each once (case does not count)."""
    found = F.transform(F.regexp_extract_all(question, F.lit(f"({LEGAL_NAME})"), F.lit(1)), lambda x: F.rtrim(x, F.lit(". ")))
    return unique_text(found, limit)


def unique_text(values: Column, limit: int, most: int = 160) -> Column:
    """Values in order of appearance, white space collapsed, cut to so many characters, each once (case does not count), none empty."""
    plain = F.filter(F.transform(values, lambda x: F.left(F.trim(F.regexp_replace(F.coalesce(x.cast("string"), F.lit("")), r"\s+", " ")), F.lit(most))), lambda x: x != "")
    once = bind(plain, lambda ps: bind(F.transform(ps, F.lower), lambda keys: F.filter(ps, lambda p, i: F.array_position(keys, F.lower(p)) == i + 1)))
    return F.slice(once, 1, limit)


def topics(question: Column, limit: int = 5) -> Column:
    """Words of three letters or more that a question is about."""
    words = F.filter(F.regexp_extract_all(question, F.lit("([A-Za-z][A-Za-z0-9_-]{2,})"), F.lit(1)), lambda w: ~_among(F.lower(w), TOPIC_STOPWORDS))
    return unique_text(F.transform(words, F.lower), limit)


def recent_years(text: Column, latest: Column | None = None) -> Column:
    """Years from 1990 to next year that stand between word boundaries, in order."""
    latest = F.year(F.current_date()) + 1 if latest is None else latest
    found = F.transform(F.regexp_extract_all(text, F.lit(r"\b((?:19|20)\d{2})\b"), F.lit(1)), lambda x: x.cast("int"))
    return F.array_sort(F.array_distinct(F.filter(found, lambda y: y.between(F.lit(1990), latest))))


def asked_years(question: Column, latest: Column | None = None) -> Column:
    """recent_years of a question; if it speaks of a previous year, also the years before them, in order."""
    years = recent_years(question, latest)
    return F.when(question.rlike(r"(?i)\b(previous|prior|preceding|earlier)\s+year\b"), F.array_sort(F.array_union(years, F.transform(years, lambda y: y - 1)))).otherwise(years)


def term(word: Column) -> Column:
    """A word for matching: small letters and digits, ies to y, a last s dropped unless after s or u."""
    plain = F.regexp_replace(F.lower(word), "[^a-z0-9]", "")
    long_ = F.length(plain) > 4
    return F.when(long_ & plain.endswith("ies"), F.concat(F.expr("''"), F.regexp_replace(plain, "ies$", "y"))).when(long_ & plain.rlike("[^su]s$"), F.regexp_replace(plain, "s$", "")).otherwise(plain)


def terms(text: Column) -> Column:
    return F.array_distinct(F.filter(F.transform(tokens(text), term), lambda x: x != ""))


def keypoints(question: Column, company_terms: Column, limit: int = 8) -> Column:
    """Content words of a question, normalised, less stopwords, suffixes, numbers, words under three letters and terms of its companies."""
    stop = [w.upper() for w in STOPWORDS + KEYPOINT_STOPWORDS]
    kept = F.transform(F.filter(tokens(question), lambda w: ~_among(F.upper(w), stop)), term)
    kept = F.filter(kept, lambda x: (F.length(x) >= 3) & ~x.rlike("^[0-9]+$") & ~_among(F.upper(x), SUFFIXES))
    return F.slice(F.array_except(F.array_distinct(kept), company_terms), 1, limit)


def matches_year(years: Column, text: Column, year: Column) -> Column:
    """If a chunk's years hold the year or its text names it."""
    return F.coalesce(F.array_contains(years, year), F.lit(False)) | F.coalesce(F.regexp_like(text, F.concat(F.lit(r"\b"), year.cast("string"), F.lit(r"\b"))), F.lit(False))


def needed_units(tickers: Column, years: Column, points: Column | None = None) -> Column:
    """Evidence units that a question needs: company:, year: and keypoint:."""
    named = lambda kind, xs: F.transform(xs, lambda x: F.concat(F.lit(kind), x.cast("string")))
    parts = [named("company:", tickers), named("year:", years)] + ([named("keypoint:", points)] if points is not None else [])
    return F.concat(*parts)


def chunk_units(tickers: Column, years: Column, points: Column | None, ticker: Column, chunk_years: Column, title: Column, text: Column) -> Column:
    """The units of a question that one chunk supports."""
    own = F.filter(tickers, lambda t: F.upper(t) == F.upper(F.trim(ticker)))
    told = F.filter(years, lambda y: matches_year(chunk_years, text, y))
    said = None if points is None else F.array_intersect(points, terms(F.concat_ws("\n", title, text)))
    return needed_units(own, told, said)


def branches(question: Column, subqueries: Column) -> Column:
    """A question, then its subqueries, trimmed, each once (case does not count)."""
    every = F.transform(F.concat(F.array(question), F.coalesce(subqueries, F.array().cast("array<string>"))), lambda x: F.trim(F.coalesce(x, F.lit(""))))
    keyed = bind(every, lambda bs: bind(F.transform(bs, F.lower), lambda keys: F.filter(bs, lambda b, i: (i == 0) | ((b != "") & (F.array_position(keys, F.lower(b)) == i + 1)))))
    return keyed


def plan(question: Column) -> Column:
    """Struct topics, intent, section_hints of a question, by fixed words alone."""
    from . import rules

    return F.struct(topics(question).alias("topics"), rules.intent(question).alias("intent"), rules.section_hints(question).alias("section_hints"))


def all_of(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a & b, conditions, F.lit(True))
