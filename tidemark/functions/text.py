"""Text functions as column expressions: tokens, token windows, cleaning, keywords, overlap, strips, cues."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed value: what counts as a token.
TOKEN = r"[A-Za-z0-9][A-Za-z0-9_$%./'&-]*"
GAP = r"[^A-Za-z0-9]*"


def bind(value: Column, use) -> Column:
    """use(value) with the value computed once a row, however often lambdas inside refer to it."""
    return F.transform(F.array(value), use)[0]


def tokens(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(f"({TOKEN})"), F.lit(1))


def token_windows(text: Column, size: int = 512, overlap: int = 64) -> Column:
    """Array of (chunk_index, token_start, token_end, chunk) windows, cut from the source text so that gaps inside stay as they are.

    Windows step by size - overlap and end with the first that reaches the last token; a text without tokens is one
    window of its trimmed self at (0, 0).
    """
    if not 0 <= overlap < size:
        raise ValueError("overlap must be at least 0 and below size")
    step = size - overlap

    def windows(words: Column, pieces: Column) -> Column:
        n = F.size(words)
        last = F.greatest(F.lit(0), F.ceil((n - size) / F.lit(step)).cast("int")) * step

        def window(a: Column, i: Column) -> Column:
            b = F.least(n, a + size)
            chunk = F.concat(F.array_join(F.slice(pieces, a + 1, b - a - 1), ""), F.element_at(words, b))
            return F.struct(i.alias("chunk_index"), a.alias("token_start"), b.alias("token_end"), chunk.alias("chunk"))

        none = F.array(F.struct(F.lit(0).alias("chunk_index"), F.lit(0).alias("token_start"), F.lit(0).alias("token_end"), F.trim(text).alias("chunk")))
        return F.when(n > 0, F.transform(F.sequence(F.lit(0), last, F.lit(step)), window)).otherwise(none)

    pieces = F.regexp_extract_all(text, F.lit(f"({TOKEN})({GAP})"), F.lit(0))
    return bind(tokens(text), lambda words: bind(pieces, lambda whole: windows(words, whole)))


def clean_text(text: Column) -> Column:
    """Control characters and runs of white space become one space; the ends are trimmed."""
    return F.trim(F.regexp_replace(F.regexp_replace(text, r"[\x00-\x08\x0B-\x1F\x7F]", " "), r"[ \t\n\r\f]+", " "))


def strip_html(html: Column) -> Column:
    """Text of a page: scripts and styles go with their content, other tags become spaces."""
    bare = F.regexp_replace(html, r"(?is)<script[^>]*>.*?</script>", " ")
    bare = F.regexp_replace(bare, r"(?is)<style[^>]*>.*?</style>", " ")
    return clean_text(F.regexp_replace(bare, r"(?s)<[^>]+>", " "))


def lexical_overlap(query: Column, text: Column) -> Column:
    """Shared tokens over the geometric mean of both token sets' sizes; 0 if either is empty."""
    q, t = F.array_distinct(tokens(F.lower(query))), F.array_distinct(tokens(F.lower(text)))
    return F.when((F.size(q) > 0) & (F.size(t) > 0), F.size(F.array_intersect(q, t)) / F.sqrt(F.size(q) * F.size(t).cast("double"))).otherwise(F.lit(0.0))


def strips(text: Column, sentences: int = 3) -> Column:
    """Array of strips of so many sentences, joined by a space; a sentence ends with white space after . ! or ?"""
    def cut(parts: Column) -> Column:
        n = F.size(parts)
        starts = F.when(n > 0, F.sequence(F.lit(0), n - 1, F.lit(sentences))).otherwise(F.array().cast("array<int>"))
        return F.transform(starts, lambda a: F.array_join(F.slice(parts, a + 1, F.lit(sentences)), " "))

    return bind(F.filter(F.transform(F.split(text, r"(?<=[.!?])\s+"), lambda x: F.trim(x)), lambda x: x != ""), cut)


# Words that are no keyword of a document, and marks that are stripped off its tokens.
KEYWORD_STOPWORDS = """about after also among and are been being between but can company could date did does during each for from have herein
into its not our report that the their this these they through under was were will with would you""".split()
MARKS = ".-/'&"


def keywords(text: Column, seeds: Column, limit: int = 12) -> Column:
    """Seed terms, then the tokens of three letters or more in order of frequency, ties in order of letters; stopwords and numbers are left out.

    Counted within the row: runs of the sorted tokens are its counts, so no row is shuffled.
    """
    words = F.transform(tokens(F.lower(text)), lambda w: F.btrim(w, F.lit(MARKS)))
    kept = F.array_sort(F.filter(words, lambda w: (F.length(w) >= 3) & ~w.isin(KEYWORD_STOPWORDS) & ~w.rlike("^[0-9]+$")))

    def ranked(ws: Column) -> Column:
        first = F.filter(F.transform(ws, lambda w, i: F.when((i == 0) | (F.get(ws, i - 1) != w), i)), lambda i: i.isNotNull())

        def counted(at: Column) -> Column:
            n = lambda i: F.coalesce(F.get(at, i + 1), F.size(ws)) - F.get(at, i)
            pairs = F.array_sort(F.transform(at, lambda a, i: F.struct((-n(i)).alias("n"), F.get(ws, a).alias("w"))))
            return F.transform(F.slice(pairs, 1, limit + 16), lambda p: p["w"])

        return bind(first, counted)

    seeded = F.array_distinct(F.filter(seeds, lambda x: x.isNotNull() & (x != "")))
    return F.slice(F.array_distinct(F.concat(seeded, bind(kept, ranked))), 1, limit)


#: Legal suffixes of company names.
LEGAL = ["inc", "incorporated", "corp", "corporation", "co", "company", "ltd", "plc"]


def alias_variants(name: Column) -> Column:
    """A company name in lower-case words, the same without legal suffixes, and its first word if that has four letters or more; each once, none empty."""
    plain = F.trim(F.regexp_replace(F.lower(name), "[^a-z0-9]+", " "))
    bare = F.trim(F.regexp_replace(plain, f"( ?\\b({'|'.join(LEGAL)}))+$", ""))
    first = F.substring_index(bare, " ", 1)
    return F.array_distinct(F.filter(F.array(plain, bare, F.when(F.length(first) >= 4, first)), lambda x: x.isNotNull() & (x != "")))


def doc_ids(text: Column) -> Column:
    """Ids such as doc_000123 in a text, in order, each once."""
    return F.array_distinct(F.regexp_extract_all(text, F.lit(r"\b(doc_\d{6})\b"), F.lit(1)))


def chunk_index(evidence_id: Column) -> Column:
    """The number at the end of an id such as doc_000123::chunk_0007, else null."""
    return F.regexp_extract(evidence_id, r"::chunk_(\d+)$", 1).try_cast("int")


def json_in(answer: Column) -> Column:
    """The outermost JSON object of a model's answer, with or without a fence; null if it has none."""
    return F.nullif(F.regexp_extract(answer, r"(?s)(\{.*\})", 1), F.lit(""))
