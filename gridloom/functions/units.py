"""Unit conversions and the ingest post-processing chain."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

_STEPS = {
    "k_to_c": lambda v, _: v - F.lit(273.15),
    "m_to_mm": lambda v, _: v * F.lit(1000.0),
    "scale": lambda v, factor: v * F.lit(float(factor)),
}


def postprocess(value: Column, steps) -> Column:
    """Apply ``steps`` (names or ``(name, argument)``) in order; unknown names fail."""
    for step in steps:
        name, arg = step if isinstance(step, tuple) else (step, None)
        if name not in _STEPS:
            raise ValueError(f"unknown post-processing step: {name}")
        value = _STEPS[name](value, arg)
    return value


def convert_unit(value: Column, source: str, target: str) -> Column:
    """Absolute temperature between ``C`` and ``F``; same unit passes through."""
    if source == target:
        return value
    if (source, target) == ("C", "F"):
        return value * F.lit(9.0) / F.lit(5.0) + F.lit(32.0)
    if (source, target) == ("F", "C"):
        return (value - F.lit(32.0)) * F.lit(5.0) / F.lit(9.0)
    return value


def convert_delta(value: Column, source: str, target: str) -> Column:
    """A temperature *difference*: only the scale changes."""
    if (source, target) == ("C", "F"):
        return value * F.lit(9.0) / F.lit(5.0)
    if (source, target) == ("F", "C"):
        return value * F.lit(5.0) / F.lit(9.0)
    return value


def is_delta_metric(aggregator: Column) -> Column:
    """Offsets, anomalies and deltas are differences, so they use ``convert_delta``."""
    return F.coalesce(F.lower(aggregator).rlike("offset|anomaly|delta"), F.lit(False))


def display_round(value: Column, digits: int = 3) -> Column:
    """Half-to-even rounding of the scaled value, free of product noise."""
    scale = F.lit(float(10**digits))
    return F.rint(F.round(value * scale, 6)) / scale


def display_value(value: Column, aggregator: Column, source: str, target: str) -> Column:
    """Converted value rounded to three digits for display."""
    return display_round(
        F.when(is_delta_metric(aggregator), convert_delta(value, source, target)).otherwise(
            convert_unit(value, source, target)
        ),
        3,
    )
