"""Filing titles, reporting periods, years and relative time windows as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import bind


def filing_meta(title: Column) -> Column:
    """Struct of what a title such as `TICKER_DATE_FORM_NN_item_CODE_words` tells, with the names of its graph nodes.

    The marker `_item_` is found in any case; a code of three digits gets a point after the first. Fields: ticker, filing_date, year,
    form, section, family, filing_node, section_node, comparison_group.
    """

    def told(parts: Column, tail: Column) -> Column:
        at = lambda i: F.nullif(F.get(parts, F.lit(i)), F.lit(""))
        first = F.get(tail, F.lit(0))
        code = F.when(first.rlike(r"^\d{3}$"), F.concat(F.left(first, F.lit(1)), F.lit("."), F.right(first, F.lit(2)))).otherwise(first)
        label = F.trim(F.regexp_replace(F.array_join(F.slice(tail, 2, F.greatest(F.size(tail), F.lit(1))), " "), r"\s+", " "))
        item = F.concat(F.lit("Item "), code)
        named = F.coalesce(F.nullif(label, F.lit("")), F.lit("unknown"))
        section = F.when(F.size(tail) == 0, "unknown").when(code == "unknown", named).when(label == "", item).otherwise(F.concat(item, F.lit(": "), label))
        short = F.concat(F.lit("unknown: "), F.array_join(F.slice(F.split(label, " "), 1, 6), " "))
        family = F.when(F.size(tail) == 0, "unknown").when(code != "unknown", item).when(label == "", "unknown").otherwise(short)
        date = F.when(at(1).rlike(r"^\d{4}-\d{2}-\d{2}$"), at(1)).otherwise(F.lit("unknown-date"))
        year = F.when(date == "unknown-date", "unknown-year").otherwise(F.left(date, F.lit(4)))
        ticker, form = F.coalesce(at(0), F.lit("UNKNOWN")), F.coalesce(at(2), F.lit("unknown-form"))
        filing = F.concat_ws(" ", ticker, form, date)
        columns = {"ticker": ticker, "filing_date": date, "year": year, "form": form, "section": section, "family": family, "filing_node": filing}
        columns |= {"section_node": F.concat(filing, F.lit(" | "), section), "comparison_group": F.concat_ws(" ", form, year, family)}
        return F.struct(*[c.alias(name) for name, c in columns.items()])

    tail = F.filter(F.split(F.regexp_extract(title, r"(?is)^.*?_item_(.*)$", 1), "_"), lambda x: x != "")
    return bind(F.split(title, "_"), lambda parts: bind(tail, lambda rest: told(parts, rest)))


# Fixed value: a title's start with ticker, date and form.
TITLE = r"^([A-Z][A-Z0-9.-]{0,15})_(\d{4})-\d{2}-\d{2}_([^_]+)"


def title_metadata(title: Column, latest: Column | None = None) -> Column:
    """Struct company_ticker, filing_year, period_year, filing_form of a title; null where its start is not of that form.

    An annual report (10-K) filed by next year tells of the year before.
    """
    latest = F.year(F.current_date()) + 1 if latest is None else latest
    at = lambda i: F.regexp_extract(title, TITLE, i)
    year, form = at(2).try_cast("int"), F.upper(at(3))
    period = F.when((form == "10-K") & (year <= latest), year - 1).otherwise(year)
    return F.when(at(1) != "", F.struct(F.upper(at(1)).alias("company_ticker"), year.alias("filing_year"), period.alias("period_year"), form.alias("filing_form")))


def normalise_space(text: Column) -> Column:
    """Runs of white space, hard spaces and what is left of broken ones as one space; the ends are trimmed."""
    return F.trim(F.regexp_replace(F.regexp_replace(text, "[\u00a0\u00c2]", " "), r"\s+", " "))


def episode_years(filing_date: Column, periods: Column) -> Column:
    """Years named by a filing's date and by labels and dates of its reporting periods."""
    values = F.concat(F.array(filing_date.cast("string")), F.flatten(F.transform(periods, lambda p: F.array(p["label"], p["start"].cast("string"), p["end"].cast("string")))))
    return F.array_sort(F.array_distinct(F.flatten(F.transform(F.filter(values, lambda x: x.isNotNull()), years_in))))


def window_dates(filing_date: Column, periods: Column) -> Column:
    """The dates that a time window is held against: ends of reporting periods, or the filing's date where there are none."""
    ends = F.array_distinct(F.filter(F.flatten(F.transform(periods, lambda p: F.array(p["start"].cast("date"), p["end"].cast("date")))), lambda x: x.isNotNull()))
    return F.when(F.size(ends) > 0, ends).otherwise(F.filter(F.array(filing_date.cast("date")), lambda x: x.isNotNull()))


def period_year(form: Column, year: Column) -> Column:
    """Annual reports tell of the year before they are filed."""
    return F.when(form == "10-K", year - 1).otherwise(year)


def period_type(label: Column) -> Column:
    x = F.lower(label)
    return F.when(x.contains("quarter"), "quarter").when(x.contains("half") | x.contains("six month"), "semiannual").when(x.contains("year"), "annual").when(x.contains("month"), "monthly").otherwise("unknown")


#: How a date, a period's end, a range and a day are written.
DATE = r"(?:January|February|March|April|May|June|July|August|September|October|November|December)\W+\d{1,2}\W+\d{4}"
ENDED = r"\b((?:(?:fiscal|financial)\s+)?(?:first|second|third|fourth|[1-4](?:st|nd|rd|th))?\s*(?:quarter|year|month|half[- ]year|six[- ]months?)\s+ended\s+" + DATE + r")\b"
RANGE = r"\b((?:from|between)\s+" + DATE + r"\s+(?:to|through|and)\s+" + DATE + r")\b"
AS_OF = r"\b(as\s+of\s+" + DATE + r")\b"


def iso_date(text: Column) -> Column:
    """A written date such as March 31, 2024; null if it is none."""
    return F.to_date(F.try_to_timestamp(F.initcap(F.trim(F.regexp_replace(text, r"\W+", " "))), F.lit("MMMM d yyyy")))


def reporting_periods(text: Column, limit: int = 8) -> Column:
    """Array of (label, type, start, end): periods ended, ranges, days, each label once (case does not count)."""
    at = lambda x, i: iso_date(F.get(F.regexp_extract_all(x, F.lit(f"(?i)({DATE})"), F.lit(1)), F.lit(i)))

    def found(clean: Column, pattern: str, kind, start, end) -> Column:
        return F.transform(F.regexp_extract_all(clean, F.lit(f"(?i){pattern}"), F.lit(1)), lambda x: F.struct(F.trim(x).alias("label"), kind(x).alias("type"), start(x).alias("start"), end(x).alias("end")))

    none, first, second = (lambda x: F.lit(None).cast("date")), (lambda x: at(x, 0)), (lambda x: at(x, 1))
    every = bind(normalise_space(text), lambda x: F.concat(found(x, ENDED, period_type, none, first), found(x, RANGE, lambda _: F.lit("range"), first, second), found(x, AS_OF, lambda _: F.lit("instant"), none, first)))
    lower = lambda ps: F.transform(ps, lambda p: F.lower(p["label"]))
    once = bind(every, lambda ps: bind(lower(ps), lambda keys: F.filter(ps, lambda p, i: F.array_position(keys, F.lower(p["label"])) == i + 1)))
    return F.slice(once, 1, limit)


#: Number words of relative time.
NUMBERS = ["one", "two", "three", "four", "five", "six", "seven", "eight", "nine", "ten"]


def relative_phrase(text: Column) -> Column:
    """Struct n, unit of the first `past 3 years` or, with n = 1, of `this quarter`; null where there is neither."""
    past = r"(?i)\b(?:past|last|previous)\s+(\d+|" + "|".join(NUMBERS) + r")\s+(year|quarter|month)s?\b"
    now = F.lower(F.regexp_extract(text, r"(?i)\b(?:this|current|latest)\s+(year|quarter|month)\b", 1))
    word, unit = F.lower(F.regexp_extract(text, past, 1)), F.lower(F.regexp_extract(text, past, 2))
    n = F.coalesce(F.nullif(F.array_position(F.array(*map(F.lit, NUMBERS)), word).cast("int"), F.lit(0)), word.try_cast("int"))
    return F.when(unit != "", F.struct(n.alias("n"), unit.alias("unit"))).when(now != "", F.struct(F.lit(1).alias("n"), now.alias("unit")))


def years_in(text: Column) -> Column:
    """Distinct years 1900 to 2099 that stand between other characters than digits, in order of appearance."""
    return F.array_distinct(F.transform(F.filter(F.split(text, r"[^0-9]+"), lambda x: x.rlike(r"^(19|20)\d{2}$")), lambda x: x.cast("int")))


def query_years(text: Column) -> Column:
    """Years of a question; if it speaks of a previous year, also each year's predecessor."""
    y = years_in(text)
    return F.when(F.lower(text).rlike(r"(previous|prior|preceding|earlier) year"), F.array_union(y, F.transform(y, lambda x: x - 1))).otherwise(y)


def relative_window(n: Column, unit: Column, reference: Column) -> Column:
    """Struct start, end of the past n years (from a first of January), quarters or months (shifted by whole months) up to a date."""
    months = n * F.when(unit == "quarter", 3).otherwise(1)
    start = F.when(unit == "year", F.make_date(F.year(reference) - n + 1, F.lit(1), F.lit(1))).otherwise(F.add_months(reference, -(months - 1)))
    years = F.sequence(F.year(start), F.year(reference))
    return F.struct(start.alias("start"), reference.alias("end"), years.alias("years"))
