"""The small predicate language {"field": {"$eq" or "$in": ...}, "$or": [...], "$and": [...]} as Catalyst columns."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def any_of(parts: list[dict]) -> dict | None:
    return None if not parts else parts[0] if len(parts) == 1 else {"$or": parts}


def all_of(parts: list[dict | None]) -> dict | None:
    parts = [p for p in parts if p]
    return None if not parts else parts[0] if len(parts) == 1 else {"$and": parts}


def compile_where(where: dict | None) -> Column:
    """A filter that Spark can push down; None admits all."""
    if where is None:
        return F.lit(True)
    out = []
    for key, value in where.items():
        if key in ("$and", "$or"):
            parts = [compile_where(x) for x in value]
            out.append(reduce((lambda a, b: a & b) if key == "$and" else (lambda a, b: a | b), parts))
        elif isinstance(value, dict):
            out += [F.col(key) == v if op == "$eq" else F.col(key).isin(list(v)) for op, v in value.items()]
        else:
            out.append(F.col(key) == value)
    return reduce(lambda a, b: a & b, out)
