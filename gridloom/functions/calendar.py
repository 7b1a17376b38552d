"""Calendar predicates over a DATE column or axis columns."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def is_feb29(t: Column) -> Column:
    return (F.month(t) == 2) & (F.dayofmonth(t) == 29)


def in_window(t: Column, start: str, end: str) -> Column:
    """Inclusive date window."""
    return t.between(F.lit(start).cast("date"), F.lit(end).cast("date"))


def in_climatology(year: Column, month: Column, which: int, start: int, end: int) -> Column:
    """One calendar month over an inclusive window of years."""
    return (month == which) & year.between(start, end)


def in_years_months(year: Column, month: Column, start=None, end=None, months=None) -> Column:
    keep = F.lit(True)
    if start is not None:
        keep = keep & (year >= start)
    if end is not None:
        keep = keep & (year <= end)
    if months is not None:
        keep = keep & month.isin(*[int(m) for m in months])
    return keep


def widen_range(start: Column, end: Column, first: Column, last: Column,
                side: str = "after") -> tuple[Column, Column]:
    """Grow a one- or two-year request to three years inside ``first..last``.

    ``side`` grows first, then the other, then whichever still has room, so
    each bound has a closed form.
    """
    need = F.greatest(F.lit(0), F.lit(2) - (end - start))
    room = {"after": F.greatest(F.lit(0), last - end), "before": F.greatest(F.lit(0), start - first)}
    other = "before" if side == "after" else "after"
    # A single step goes to the preferred side when it can; of two, one goes to each.
    preferred = F.least(F.ceil(need / 2).cast("int"), room[side])
    opposite = F.least(need - preferred, room[other])
    grown = {side: F.least(need - opposite, room[side]), other: opposite}
    return start - grown["before"], end + grown["after"]
