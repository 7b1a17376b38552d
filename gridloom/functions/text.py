"""Name normalisation and display text as JVM-side expressions."""

from __future__ import annotations

import unicodedata
from functools import lru_cache

from pyspark.sql import Column, functions as F


def _fold(ch: str, form: str) -> str:
    parts = unicodedata.normalize(form, ch)
    return "".join(c for c in parts if not unicodedata.combining(c)).casefold()


@lru_cache(maxsize=None)
def _folding(form: str) -> tuple[str, str, str, tuple[str, ...]]:
    """Foldings with an ASCII letter or digit, of all of Unicode.

    One-to-one foldings are two parallel strings; combining marks end the first one and so vanish.  The other characters come longest folding first, with one string per
    position of the folding, so that each of these strings covers a prefix of the characters.
    """
    src, dst, many, marks = [], [], [], []
    for cp in range(0x80, 0x110000):
        if 0xD800 <= cp < 0xE000:
            continue
        ch = chr(cp)
        out = _fold(ch, form)
        if not out:
            marks.append(ch)
        if not out or out == ch or not any(c.isascii() and c.isalnum() for c in out):
            continue
        if len(out) == 1:
            src.append(ch)
            dst.append(out)
        else:
            many.append((ch, out))
    many.sort(key=lambda m: -len(m[1]))
    longest = len(many[0][1]) if many else 0
    at = tuple("".join(out[i] for _, out in many if len(out) > i) for i in range(longest))
    return "".join(src + marks), "".join(dst), "".join(ch for ch, _ in many), at


def fold_ascii(text: Column, form: str = "NFKD") -> Column:
    """Lower case without diacritics.  Plain ASCII rows skip the Unicode work."""
    src, dst, many, at = _folding(form)
    folded = F.translate(text, src, dst)
    # A character class of this size is tried member by member; deleting its members is one lookup a character.
    holds = lambda c: F.length(F.translate(c, many, "")) < F.length(c)

    def expand(c: Column) -> Column:
        # Characters beyond the end of a position's string have no such position, and translate to nothing.
        return F.when(F.instr(F.lit(many), c) > 0, F.concat(*[F.translate(c, many, x) for x in at])).otherwise(c)

    def expand_word(w: Column) -> Column:
        return F.when(holds(w), F.array_join(F.transform(F.split(w, ""), expand), "")).otherwise(w)

    if many:
        # Only the words that hold such a character are taken apart.
        slow = F.array_join(F.transform(F.split(folded, " "), expand_word), " ")
        folded = F.when(holds(folded), slow).otherwise(folded)
    return F.when(text.rlike(r"[^\x00-\x7f]"), F.lower(folded)).otherwise(F.lower(text))


def norm_name(text: Column) -> Column:
    """Search key of a place name: letters and digits, single spaces."""
    words = F.regexp_replace(fold_ascii(F.coalesce(text, F.lit(""))), r"[^a-z0-9\\]+", " ")
    # A backslash survives unless an "s" follows it; real names never have one.
    return F.trim(F.regexp_replace(words, r"\\s+".replace("\\", "\\\\"), " "))


def slug(text: Column) -> Column:
    """ASCII lower case with underscores for spaces and hyphens."""
    ascii_only = F.regexp_replace(fold_ascii(text, "NFD"), r"[^\x00-\x7f]", "")
    return F.translate(ascii_only, " -", "__")


def collapse_spaces(text: Column) -> Column:
    """Lower case, trimmed, runs of white space as one space."""
    return F.trim(F.regexp_replace(F.lower(text), r"\s+", " "))


def title_if_upper(name: Column) -> Column:
    """All-caps names in title case (every run of letters), others unchanged."""
    runs = F.regexp_extract_all(name, F.lit(r"(\p{L}+|\P{L}+)"), F.lit(0))
    titled = F.array_join(F.transform(runs, lambda w: F.initcap(F.lower(w))), "")
    return F.when((name != "") & (name == F.upper(name)), titled).otherwise(name)


MONTH_NAMES = ["January", "February", "March", "April", "May", "June", "July", "August",
               "September", "October", "November", "December"]


def month_span_label(months: Column) -> Column:
    """``[12, 1, 2]`` as "December-February"; scattered months as a list.

    A whole year needs no label.  A run may wrap over the year end; its first month is the only one whose
    predecessor is absent.
    """
    names = F.array(*[F.lit(m) for m in MONTH_NAMES])
    ms = F.array_sort(F.array_distinct(F.filter(months, lambda m: m.between(1, 12))))
    name = lambda i: F.get(names, (i - 1).cast("int"))
    starts = F.filter(ms, lambda m: ~F.array_contains(ms, F.pmod(m - 2, F.lit(12)) + 1))
    first = F.get(starts, F.lit(0))
    last = F.pmod(first + F.size(ms) - 2, F.lit(12)) + 1
    return (
        F.when(F.size(ms).isin(0, 12), F.lit(None).cast("string"))
        .when(F.size(ms) == 1, name(F.get(ms, F.lit(0))))
        .when(F.size(starts) == 1, F.concat(name(first), F.lit("–"), name(last)))
        .otherwise(F.array_join(F.transform(ms, name), ", "))
    )


def both_units(celsius: Column, digits: int = 1, delta: bool = False) -> Column:
    """A temperature in both units as ``[[20.0°C|68.0°F]]``."""
    from gridloom.functions.units import convert_delta, convert_unit, display_round

    c = display_round(celsius, digits)
    f = display_round((convert_delta if delta else convert_unit)(c, "C", "F"), digits)
    show = lambda v: (v + F.lit(0.0)).cast("string")
    return F.concat(F.lit("[["), show(c), F.lit("°C|"), show(f), F.lit("°F]]"))


def pick_unit(text: Column, unit: str) -> Column:
    """Keep one side of every ``[[C|F]]`` pair."""
    return F.regexp_replace(text, r"\[\[([^|\]]*)\|([^\]]*)\]\]", "$1" if unit == "C" else "$2")
