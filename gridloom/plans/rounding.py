"""Rounding that makes float results comparable between engines."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from gridloom.functions.units import display_round


def rounded(df: DataFrame, *columns: str, digits: int = 6) -> DataFrame:
    # Adding 0.0 turns a negative zero into zero.
    return df.withColumns({c: display_round(F.col(c), digits) + F.lit(0.0) for c in columns})
