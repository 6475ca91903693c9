"""Filters given as dictionaries, compiled to Columns, so that they reach the scan."""

from __future__ import annotations

from functools import reduce
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F

OPERATORS = tuple("in nin eq ne lt gt lte gte icontains contains".split())
_ALIASES = {"run_id": "session_id"}


def _operand(name: str, columns: list[str], metadata: str, value: Any) -> Column:
    name = _ALIASES.get(name, name)
    if name in columns:
        return F.col(name)
    raw = F.get_json_object(F.col(metadata), f"$.{name}")
    sample = value[0] if isinstance(value, (list, tuple)) and value else value
    if isinstance(sample, bool):
        return raw.try_cast("boolean")
    return raw.try_cast("double") if isinstance(sample, (int, float)) else raw


def _one(name: str, op: str, value: Any, columns: list[str], metadata: str) -> Column:
    c = _operand(name, columns, metadata, value)
    if op in ("in", "nin"):
        if not value:
            raise ValueError(f"{op} needs at least one value")
        return c.isin(*value) if op == "in" else ~c.isin(*value)
    if op == "contains":
        return c.cast("string").contains(value)
    if op == "icontains":
        return F.lower(c.cast("string")).contains(str(value).lower())
    return {"eq": c == value, "ne": c != value, "gt": c > value, "gte": c >= value, "lt": c < value, "lte": c <= value}[op]


def compile_filter(tree: dict[str, Any] | None, columns: list[str], metadata: str = "metadata", strict: bool = True, none_of: bool = False) -> Column:
    """A predicate of a filter tree.

    A bare value is equality, "*" asks for a value, a dictionary holds one
    operator, AND / OR / NOT hold lists of trees. Names that are no columns are
    looked up in the JSON ``metadata``. NOT negates the conjunction of its list,
    with ``none_of`` each of them. Without ``strict``, unknown names, operators and
    several operators in a dictionary are ignored or taken one by one.
    """
    parts: list[Column] = []
    for name, value in (tree or {}).items():
        if name in ("AND", "OR", "NOT"):
            if not isinstance(value, (list, tuple)) or not value:
                raise ValueError(f"{name} needs a list")
            subs = [compile_filter(v, columns, metadata, strict, none_of) for v in value]
            if name == "NOT" and not none_of:
                parts.append(~reduce(lambda a, b: a & b, subs))
            elif name == "NOT":
                parts.append(reduce(lambda a, b: a & b, [~F.coalesce(s, F.lit(False)) for s in subs]))
            else:
                parts.append(reduce((lambda a, b: a & b) if name == "AND" else (lambda a, b: a | b), subs))
            continue
        if not strict and _ALIASES.get(name, name) not in columns:
            continue
        if value == "*":
            parts.append(_operand(name, columns, metadata, None).isNotNull())
        elif isinstance(value, dict):
            if strict and len(value) != 1:
                raise ValueError(f"{name}: one operator at a time")
            for op, v in value.items():
                if op not in OPERATORS:
                    if strict:
                        raise ValueError(f"unknown operator: {op}")
                    continue
                parts.append(_one(name, op, v, columns, metadata))
        elif isinstance(value, (list, tuple)):
            parts.append(_one(name, "in", value, columns, metadata))
        else:
            parts.append(_one(name, "eq", value, columns, metadata))
    return reduce(lambda a, b: a & b, parts) if parts else F.lit(True)


def must_should(must: list[dict] = (), should: list[dict] = (), must_not: list[dict] = (), columns: list[str] = (), metadata: str = "metadata", ranges: bool = True) -> Column:
    """All of ``must``, one of ``should`` if there are any, none of ``must_not``; several operators of one name form a range."""
    build = lambda d: reduce(lambda a, b: a & b, [_one(n, op, x, list(columns), metadata) for n, v in d.items() for op, x in (v.items() if isinstance(v, dict) else [("eq", v)])])
    out = F.lit(True)
    for d in must:
        out = out & build(d)
    if should:
        out = out & reduce(lambda a, b: a | b, map(build, should))
    for d in must_not:
        out = out & ~F.coalesce(build(d), F.lit(False))
    return out


def payload_filter(conditions: dict[str, str], payload: str = "payload") -> Column:
    return reduce(lambda a, b: a & b, [F.get_json_object(F.col(payload), f"$.{k}") == str(v) for k, v in conditions.items()], F.lit(True))


def valid_at(moment: str) -> Column:
    """Valid at a time; times are compared as the strings they are, a missing bound is open."""
    return (F.col("valid_at").isNull() | (F.col("valid_at") <= moment)) & (F.col("invalid_at").isNull() | (F.col("invalid_at") > moment))


def valid_between(start: str, end: str) -> Column:
    return (F.col("valid_at").isNull() | (F.col("valid_at") <= end)) & (F.col("invalid_at").isNull() | (F.col("invalid_at") > start))


def not_expired(today: str, metadata: str = "metadata") -> Column:
    """metadata.expiration_date is today or later; none, or no date, never expires."""
    day = F.get_json_object(F.col(metadata), "$.expiration_date")
    return F.coalesce(F.when(day.rlike(r"^\d{4}-\d{2}-\d{2}$"), F.try_to_date(day) >= F.lit(today).cast("date")), F.lit(True))


def check_id(value: str | None, name: str = "id") -> str:
    v = (value or "").strip()
    if not v or any(c.isspace() for c in v):
        raise ValueError(f"{name} must be one word")
    return v


def check_search(query: str, top_k: int, threshold: float) -> None:
    if not (query or "").strip():
        raise ValueError("the query is empty")
    if top_k < 0:
        raise ValueError("top_k must not be negative")
    if not 0 <= threshold <= 1:
        raise ValueError("threshold must be in [0, 1]")
