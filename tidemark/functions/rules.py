"""Cues of questions and texts: metrics, section terms, preferred forms, intents; boosts that follow from them."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Metric labels with their patterns (case does not count).
METRICS = [
    ("revenue / sales", r"\b(?:revenue|sales|net sales)\b"),
    ("net income / loss", r"\bnet (?:income|loss)\b"),
    ("gross profit / margin", r"\bgross (?:profit|margin)\b"),
    ("operating income / margin", r"\boperating (?:income|loss|margin)\b"),
    ("EBITDA / EBIT", r"\b(?:adjusted )?ebitda?\b"),
    ("cash flow", r"\b(?:free |operating )?cash flow\b"),
    ("earnings per share", r"\b(?:earnings per share|eps)\b"),
    ("assets / liabilities / equity", r"\b(?:assets?|liabilities|shareholders?'? equity)\b"),
    ("debt / liquidity", r"\b(?:debt|liquidity|borrowings?)\b"),
    ("capital expenditure", r"\b(?:capital expenditur\w*|capex)\b"),
    ("compensation / bonus", r"\b(?:compensation|bonus|salary|stock awards?)\b"),
    ("audit fees", r"\baudit(?:ing)? fees?\b"),
    ("ownership / shareholding", r"\b(?:ownership|shareholdings?|voting power)\b"),
    ("headcount", r"\b(?:headcount|employees?)\b"),
    ("returns", r"\b(?:returns?|roi|roic|irr)\b"),
]

# Words of a question, and the section terms that they ask for.
SECTION_SIGNALS = [
    (["audit fee", "audit fees", "auditor", "principal accountant"], ["audit fee", "audit-related fee", "principal accountant", "fees paid"]),
    (["employee", "employees", "headcount", "workforce", "collective bargaining", "human capital"], ["employees", "human capital", "collective bargaining", "workforce", "headcount"]),
    (["compensation", "salary", "bonus", "stock award", "executive pay"], ["executive compensation", "salary", "bonus", "stock award", "summary compensation"]),
    (["board", "director", "chairperson", "chairman", "governance"], ["board of directors", "director", "chairperson", "governance"]),
    (["vesting", "equity award", "incentive plan", "restricted stock"], ["vesting", "equity award", "incentive plan", "restricted stock"]),
    (["cyber", "cybersecurity", "data protection", "privacy", "private key", "wallet"], ["cybersecurity", "data security", "privacy", "private key", "wallet", "risk factor"]),
    (["risk factor", "international expansion", "shipping"], ["risk factor", "international expansion", "shipping"]),
    (["revenue", "operating loss", "net loss", "profitability"], ["revenue", "operating loss", "net loss", "results of operations"]),
    (["market risk", "foreign exchange", "commodity price", "hedge"], ["market risk", "foreign exchange", "commodity price", "hedge"]),
]

# Words of a question, and the forms that it prefers.
FORM_PREFERENCES = [
    (["10-q", "quarter", "quarterly"], ["10-Q"]),
    (["proxy", "def 14a", "executive compensation", "director compensation"], ["DEF 14A", "DEFM14A", "PRE 14A"]),
    (["10-k", "annual report", "risk factor", "market risk", "human capital"], ["10-K", "20-F"]),
]

# Intents by the first whose words a question holds, and section hints by all whose words it holds.
INTENTS = [
    ("risk", ["risk", "cyber", "legal", "litigation", "permit"]),
    ("calculation", ["calculate", "percentage", "total", "amount", "fees"]),
    ("trend", ["trend", "growth", "increase", "decrease"]),
    ("comparison", ["compare", "versus", " vs ", "between"]),
    ("evolution", ["evolve", "evolution", "changed", "develop"]),
]
SECTION_HINTS = [
    ("risk_factors", ["risk", "cyber", "privacy", "permit", "legal"]),
    ("financial_statements", ["revenue", "income", "fees", "loss", "financial"]),
    ("executive_compensation", ["compensation", "director", "executive", "ltip"]),
    ("ownership", ["ownership", "shareholding", "voting"]),
    ("market_risk", ["market risk", "foreign exchange", "commodity"]),
]

# Fixed value: what makes a question a broad one.
BROAD = r"(?i)\b(?:across|all|compare|comparison|change(?:d|s)?|develop(?:ed|ment|s)?|evolv(?:e|ed|ing|ion)|history|how\s+did|over\s+time|progress(?:ed|ion)?|trend(?:s)?|versus|vs\.?)\b"


def holds_any(text: Column, words: list[str]) -> Column:
    return reduce(lambda a, b: a | b, [F.contains(F.lower(text), F.lit(w)) for w in words])


def _named(found: list[tuple[Column, list[str]]]) -> Column:
    """The distinct strings whose condition holds, in order."""
    none = F.array().cast("array<string>")
    return F.array_distinct(F.flatten(F.array(*[F.when(on, F.array(*map(F.lit, names))).otherwise(none) for on, names in found])))


def metrics_in(text: Column) -> Column:
    return _named([(F.coalesce(text.rlike(f"(?i){pattern}"), F.lit(False)), [label]) for label, pattern in METRICS])


def section_terms(question: Column) -> Column:
    return _named([(holds_any(question, words), terms) for words, terms in SECTION_SIGNALS])


def preferred_forms(question: Column) -> Column:
    return _named([(holds_any(question, words), forms) for words, forms in FORM_PREFERENCES])


def intent(question: Column) -> Column:
    return F.coalesce(*[F.when(holds_any(question, words), F.lit(name)) for name, words in INTENTS], F.lit("lookup"))


def section_hints(question: Column) -> Column:
    return _named([(holds_any(question, words), [name]) for name, words in SECTION_HINTS])


def is_broad(question: Column, years: Column) -> Column:
    return (F.size(years) >= 2) | question.rlike(BROAD)


def section_form_boost(question: Column, title: Column, text: Column, form: Column, cap: float = 0.12, reach: int = 2500) -> Column:
    """0.06 for each section term in the title or the start of the text, up to the cap; a preferred form adds the lesser of 0.04 and half the cap."""
    hay = F.concat(F.lower(F.regexp_replace(title, "_", " ")), F.lit("\n"), F.lower(F.left(text, F.lit(reach))))
    hits = F.size(F.filter(section_terms(question), lambda w: F.contains(hay, w)))
    preferred = F.array_contains(preferred_forms(question), F.upper(form))
    return F.least(F.lit(cap), 0.06 * hits) + F.when(preferred, min(0.04, cap / 2)).otherwise(0.0)
