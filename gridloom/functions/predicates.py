"""Score predicates: a missing value never matches."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

_COMPARE = {
    "gt": lambda v, x: v > x,
    "gte": lambda v, x: v >= x,
    "lt": lambda v, x: v < x,
    "lte": lambda v, x: v <= x,
    "eq": lambda v, x: v == x,
    "neq": lambda v, x: v != x,
}


def matches(value: Column, spec: dict) -> Column:
    op = spec.get("op")
    if op == "between":
        lo, hi = float(spec["min"]), float(spec["max"])
        hit = (
            (value >= lo) & (value <= hi)
            if spec.get("inclusive", True)
            else (value > lo) & (value < hi)
        )
    elif op in _COMPARE:
        hit = _COMPARE[op](value, F.lit(float(spec["threshold"])))
    else:
        raise ValueError(f"unknown predicate: {op}")
    return F.coalesce(hit, F.lit(False))
