"""License detection by ordered signature rules (DataFrame functions only, one pass, no shuffle).

Texts become token strings (ASCII words and non-ASCII runs, one space around each).  A test on the raw text, derived from
the rules' keywords, selects the texts that can match a rule at all.  There each rule family is gated by its keyword, each rule of an
open family is one regular expression, and the detections are resolved: walking them by start (longest first), a
detection inside an earlier one of the same or a higher tier is dropped.  Contract phrases form the highest tier, so
they always stay.

Per row only: null and empty texts give no words and no labels, repeated rows give repeated results, input columns
named like the added ones give way.
"""

from __future__ import annotations

import functools
import operator

from pyspark.sql import Column, DataFrame, functions as F

from gridloom.llm.common import match_spans, no_spans, table, with_added

WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
GAP = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"

# The contract's phrases (fixed values).
PHRASES = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}
BASE_TIER = 5

# label: (keyword that must occur, pattern of the license's name in token space, SPDX tokens)
LICENSES: dict[str, tuple[str, str, str]] = {
    "mit": ("mit", r"mit", r"mit"),
    "mit-0": ("mit", r"mit no attribution", r"mit 0"),
    "apache-1": ("apache", r"apache (?:software )?license (?:version )?1(?: [01])?", r"apache 1 [01]"),
    "apache-2": ("apache", r"apache (?:software )?license (?:v|version )?2(?: 0)?", r"apache 2 0"),
    "bsd-2": ("bsd", r"(?:bsd 2 clause|2 clause bsd|simplified bsd|freebsd)", r"bsd 2 clause"),
    "bsd-3": ("bsd", r"(?:bsd 3 clause|3 clause bsd|(?:modified|new|revised) bsd)", r"bsd 3 clause"),
    "bsd-4": ("bsd", r"(?:bsd 4 clause|4 clause bsd|original bsd)", r"bsd 4 clause"),
    "0bsd": ("bsd", r"(?:zero clause bsd|0bsd)", r"0bsd"),
    "isc": ("isc", r"isc", r"isc"),
    "gpl-1": ("general public", r"gnu general public license (?:v|version )1", r"gpl 1 0(?: only| or later)?"),
    "gpl-2": ("general public", r"gnu general public license (?:v|version )2", r"gpl 2 0(?: only| or later)?"),
    "gpl-3": ("general public", r"gnu general public license (?:v|version )3", r"gpl 3 0(?: only| or later)?"),
    "lgpl-2": ("general public", r"gnu library general public license (?:v|version )2", r"lgpl 2 0(?: only| or later)?"),
    "lgpl-2.1": ("general public", r"gnu lesser general public license (?:v|version )2 1", r"lgpl 2 1(?: only| or later)?"),
    "lgpl-3": ("general public", r"gnu lesser general public license (?:v|version )3", r"lgpl 3 0(?: only| or later)?"),
    "agpl-3": ("general public", r"gnu affero general public license (?:v|version )3", r"agpl 3 0(?: only| or later)?"),
    "mpl-1": ("mozilla", r"mozilla public license (?:v|version )?1(?: [01])?", r"mpl 1 [01]"),
    "mpl-2": ("mozilla", r"mozilla public license (?:v|version )?2(?: 0)?", r"mpl 2 0"),
    "epl-1": ("eclipse", r"eclipse public license (?:v|version )?1(?: 0)?", r"epl 1 0"),
    "epl-2": ("eclipse", r"eclipse public license (?:v|version )?2(?: 0)?", r"epl 2 0"),
    "cddl-1": ("common development", r"common development and distribution license", r"cddl 1 [01]"),
    "cpl-1": ("common public", r"common public license", r"cpl 1 0"),
    "eupl-1.2": ("european union", r"european union public licen[cs]e", r"eupl 1 [012]"),
    "artistic-1": ("artistic", r"artistic license (?:v|version )?1(?: 0)?", r"artistic 1 0"),
    "artistic-2": ("artistic", r"artistic license (?:v|version )?2(?: 0)?", r"artistic 2 0"),
    "boost-1": ("boost", r"boost software license", r"bsl 1 0"),
    "zlib": ("zlib", r"zlib(?: libpng)?", r"zlib"),
    "libpng": ("libpng", r"libpng", r"libpng"),
    "unlicense": ("unlicense", r"unlicense", r"unlicense"),
    "wtfpl": ("wtfpl", r"wtfpl", r"wtfpl"),
    "python-2": ("python software", r"python software foundation license", r"python 2 0"),
    "php-3": ("php", r"php license (?:v|version )?3(?: 0[01]?)?", r"php 3 0[01]?"),
    "ruby": ("ruby", r"ruby", r"ruby"),
    "postgresql": ("postgresql", r"postgresql", r"postgresql"),
    "openssl": ("openssl", r"openssl", r"openssl"),
    "ofl-1.1": ("open font", r"sil open font license|open font license", r"ofl 1 1"),
    "odbl-1": ("open database", r"open database license", r"odbl 1 0"),
    "odc-by": ("open data commons", r"open data commons attribution", r"odc by 1 0"),
    "ms-pl": ("microsoft public", r"microsoft public license", r"ms pl"),
    "ms-rl": ("microsoft reciprocal", r"microsoft reciprocal license", r"ms rl"),
    "ncsa": ("ncsa", r"university of illinois ncsa open source license", r"ncsa"),
    "afl-3": ("academic free", r"academic free license", r"afl 3 0"),
    "osl-3": ("open software", r"open software license", r"osl 3 0"),
    "qpl-1": ("q public", r"q public license", r"qpl 1 0"),
    "sleepycat": ("sleepycat", r"sleepycat", r"sleepycat"),
    "vim": ("vim", r"vim", r"vim"),
    "w3c": ("w3c", r"w3c software notice and license", r"w3c"),
    "x11": ("x11", r"x11", r"x11"),
    "gfdl-1": ("free documentation", r"gnu free documentation license", r"gfdl 1 [123](?: only| or later)?"),
    "cc0": ("cc0", r"cc0(?: 1 0)?(?: universal)?", r"cc0 1 0"),
    "cc-by": ("cc by", r"cc by(?! (?:nc|nd|sa))(?: [1-4] [05])?", r"cc by [1-4] [05]"),
    "cc-by-sa": ("cc by", r"cc by sa(?: [1-4] [05])?", r"cc by sa [1-4] [05]"),
    "cc-by-nd": ("cc by", r"cc by nd(?: [1-4] [05])?", r"cc by nd [1-4] [05]"),
    "cc-by-nc": ("cc by", r"cc by nc(?! (?:nd|sa))(?: [1-4] [05])?", r"cc by nc [1-4] [05]"),
    "cc-by-nc-sa": ("cc by", r"cc by nc sa(?: [1-4] [05])?", r"cc by nc sa [1-4] [05]"),
    "cc-by-nc-nd": ("cc by", r"cc by nc nd(?: [1-4] [05])?", r"cc by nc nd [1-4] [05]"),
    "creative-commons": ("creative commons", r"creative commons", r"creative commons"),
    "proprietary": ("all rights", r"all rights reserved", r"licenseref proprietary"),
}

# How a license is named, strongest first: (tier, confidence, pattern around the name or the SPDX tokens).
FORMS = {
    "tag": (4, 0.95, " spdx license identifier {spdx}(?= )"),
    "notice": (3, 0.9, " (?:is |are )?(?:licen[cs]ed|released|distributed|available|published|provided) under "
                       "(?:the )?(?:terms of )?(?:the )?(?:{name})(?: licen[cs]e)?(?= )"),
    "terms": (3, 0.85, " (?:under|by|to|see) (?:the )?(?:terms (?:and conditions )?of )(?:the )?(?:{name})(?: licen[cs]e)?(?= )"),
    "header": (3, 0.85, " licen[cs]e (?:is |type )?(?:the )?(?:{name})(?= )"),
    "title": (2, 0.7, " the (?:{name}) licen[cs]e(?= )"),
    "mention": (1, 0.5, " (?:{name}) licen[cs]ed?(?= )"),
}
# Names that say what they are without the word "license" around them.
PLAIN = {"apache-1", "apache-2", "gpl-1", "gpl-2", "gpl-3", "lgpl-2", "lgpl-2.1", "lgpl-3", "agpl-3", "mpl-1", "mpl-2",
         "epl-1", "epl-2", "cddl-1", "cpl-1", "eupl-1.2", "artistic-1", "artistic-2", "boost-1", "unlicense", "ofl-1.1",
         "odbl-1", "ms-pl", "ms-rl", "afl-3", "osl-3", "gfdl-1", "cc0", "cc-by", "cc-by-sa", "cc-by-nd", "cc-by-nc",
         "cc-by-nc-sa", "cc-by-nc-nd", "wtfpl", "proprietary"}
# Further names that do not hold their license's keyword, with keywords of their own: (label, keyword, name).
ALIASES = [("mit", "expat", r"expat"), ("isc", "internet systems consortium", r"internet systems consortium")]

_GPL = r"(?: (?:(?:as )?published by the free software foundation|either))*"
# Short names, notices with the version further on, and characteristic clauses: (keyword, label, tier, confidence, pattern).
SIGNATURES = [
    *[("general public", f"{short}gpl-{v}", 3, 0.85, f" gnu {kind}general public license{_GPL} version {v.replace('.', ' ')}(?! [0-9])(?= )")
      for short, kind, v in (("", "", "1"), ("", "", "2"), ("", "", "3"), ("l", "library ", "2"), ("l", "lesser ", "2.1"),
                             ("l", "lesser ", "3"), ("a", "affero ", "3"))],
    *[("gpl", f"{short}gpl-{v}", 2, 0.7, f" (?:gnu )?{short}gpl ?(?:v|version )?{v.replace('.', ' ')}(?: 0)?(?! [0-9])(?= )")
      for short, v in (("", "1"), ("", "2"), ("", "3"), ("l", "2"), ("l", "2.1"), ("l", "3"), ("a", "3"))],
    ("gpl", "gpl", 1, 0.5, " gpl(?= )"), ("gpl", "lgpl", 1, 0.5, " lgpl(?= )"), ("gpl", "agpl", 1, 0.5, " agpl(?= )"),
    *[("creative commons", f"cc-by{'-' if kind else ''}{kind}", 3, 0.85, f" creative commons attribution{name}(?: [1-4] [05])?(?= (?!non|nod|share|no ))")
      for kind, name in (("", ""), ("sa", " share ?alike"), ("nd", " no ?deriv(?:ative)?s"), ("nc", " non ?commercial"),
                         ("nc-sa", " non ?commercial share ?alike"), ("nc-nd", " non ?commercial no ?deriv(?:ative)?s"))],
    ("creative commons", "creative-commons", 1, 0.5, " creative commons(?= )"),
    ("permission is hereby granted", "mit", 3, 0.85,
     " permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files(?= )"),
    ("redistribution and use", "bsd", 3, 0.8, " redistribution and use in source and binary forms with or without modification are permitted(?= )"),
    ("permission to use copy modify and", "isc", 3, 0.8,
     " permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted(?= )"),
    ("provided as is without", "zlib", 3, 0.8, " this software is provided as is without any express or implied warranty(?= )"),
]


def rules() -> list[tuple[str, str, int, float, str]]:
    """(keyword, label, tier, confidence, pattern) of every rule, in order; no text matches a rule without its keyword."""
    out = []
    for label, (keyword, name, spdx) in LICENSES.items():
        out += [("spdx" if form == "tag" else keyword, label, tier, sure, shape.format(name=name, spdx=spdx))
                for form, (tier, sure, shape) in FORMS.items()]
        if label in PLAIN:
            out.append((keyword, label, 2, 0.7, f" (?:{name})(?= )"))
    for label, keyword, name in ALIASES:
        out += [(keyword, label, tier, sure, shape.format(name=name)) for form, (tier, sure, shape) in FORMS.items() if form != "tag"]
    return out + SIGNATURES


def _holds(low: Column, words: list[str]) -> Column:
    """Whether lower-case raw text can hold a keyword as whole words: a plain search for its longest word, then the pattern.

    "bsd" also ends words ("freebsd"), "gpl" also stands inside them ("lgplv3").
    """
    def one(w: str) -> Column:
        start = "" if w in ("bsd", "gpl") else f"(?<!{WORD[:-1]})"
        stop = "" if w == "gpl" else f"(?!{WORD[:-1]})"
        return F.contains(low, F.lit(max(w.split(), key=len))) & low.rlike(start + w.replace(" ", GAP) + stop)

    return functools.reduce(operator.or_, [one(w) for w in words])


def possible(low: Column) -> Column:
    """False only where no rule matches ``low``, the raw text in lower case.

    Plain names and tags stand alone; every other form holds one of the words tested here beside the name.
    """
    alone = list(dict.fromkeys(["spdx", *[LICENSES[label][0] for label in LICENSES if label in PLAIN],
                               *[k for k, *_ in SIGNATURES]]))
    named = [k for k in dict.fromkeys([*[v[0] for v in LICENSES.values()], *[k for _, k, _ in ALIASES]]) if k not in alone]
    form = F.contains(low, F.lit("licenc")) | F.contains(low, F.lit("licens")) | _holds(low, ["under", "terms"])
    return _holds(low, alone) | (form & _holds(low, named))


_DET = "struct<start:int,stop:int,tier:int,label:string,sure:double>"


def _families() -> Column:
    by_key: dict[str, list] = {}
    for keyword, label, tier, sure, pattern in rules():
        by_key.setdefault(keyword, []).append(F.struct(
            F.lit(label).alias("label"), F.lit(tier).alias("tier"), F.lit(sure).alias("sure"), F.lit(pattern).alias("pattern")))
    return F.array(*[F.struct(F.lit(k).alias("keyword"), F.array(*v).alias("rules")) for k, v in by_key.items()])


def _det(span: Column, tier: Column, label: Column, sure: Column) -> Column:
    return F.struct(span["start"].alias("start"), (-span["end"]).alias("stop"), (-tier).alias("tier"),
                    label.alias("label"), sure.alias("sure")).cast(_DET)


def _rule_hits(t: Column) -> Column:
    def of_rule(r: Column) -> Column:
        return F.transform(match_spans(t, r["pattern"]), lambda s: _det(s, r["tier"], r["label"], r["sure"]))

    def of_family(f: Column) -> Column:
        return F.flatten(F.transform(F.filter(f["rules"], lambda r: F.rlike(t, r["pattern"])), of_rule))

    open_ = F.filter(_families(), lambda f: F.contains(t, f["keyword"]))
    return F.flatten(F.transform(open_, of_family))


def _base_hits(t: Column) -> Column:
    def of_phrase(phrase: str, label: str) -> Column:
        spans = F.when(F.contains(t, F.lit(f" {phrase} ")), match_spans(t, F.lit(f" {phrase}(?= )"))).otherwise(no_spans())
        return F.transform(spans, lambda s: _det(s, F.lit(BASE_TIER), F.lit(label), F.lit(1.0)))

    return F.concat(*[of_phrase(phrase, label) for phrase, label in PHRASES.items()])


def _resolved(dets: Column) -> Column:
    """Sorted by start, longest first, strongest first; each is kept unless an equal or higher tier already reaches its end."""
    tiers = [f"m{k}" for k in range(1, BASE_TIER + 1)]

    def step(acc: Column, d: Column) -> Column:
        end, tier = -d["stop"], -d["tier"]
        reach = F.get(F.array(*[acc[m] for m in tiers]), tier - 1)
        reached = [F.when(tier >= k, F.greatest(acc[m], end)).otherwise(acc[m]).alias(m) for k, m in enumerate(tiers, 1)]
        kept = F.when((reach >= end) & (tier < BASE_TIER), acc["kept"]).otherwise(F.array_append(acc["kept"], d))
        return F.struct(kept.alias("kept"), *reached)

    start = F.struct(F.array().cast(f"array<{_DET}>").alias("kept"), *[F.lit(-1).alias(m) for m in tiers])
    return F.aggregate(F.array_sort(dets), start, step, lambda acc: acc["kept"])


def scan_licenses(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` plus ``n_words`` and ``detections``: array of (start_word, n_words, tier, label, sure), resolved.

    Tier 5 are the contract phrases.  Word positions count from 0.
    """
    value = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    # lower() maps some further letters to ASCII ones, which can only open the gate for more texts.
    gated = docs.withColumn("__raw", value).withColumn("__t", F.when(
        possible(F.lower("__raw")),
        F.translate(F.regexp_replace(F.concat(F.lit(" "), "__raw", F.lit(" ")), GAP, " "),
                    "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"),
    ))
    gated = gated.withColumn("__dets", F.when(
        F.col("__t").isNotNull(), _resolved(F.concat(_base_hits(F.col("__t")), _rule_hits(F.col("__t"))))
    ))

    def words_before(position: Column) -> Column:
        return F.regexp_count(F.substring(F.col("__t"), F.lit(1), position), F.lit(" "))

    placed = F.transform("__dets", lambda d: F.struct(
        words_before(d["start"]).alias("start_word"),
        F.regexp_count(F.substring(F.col("__t"), d["start"] + 1, -d["stop"] - d["start"]), F.lit(" ")).alias("n_words"),
        (-d["tier"]).alias("tier"), d["label"].alias("label"), d["sure"].alias("sure")))
    none = "array<struct<start_word:int,n_words:int,tier:int,label:string,sure:double>>"
    return with_added(gated, {
        "n_words": F.regexp_count(F.col("__raw"), F.lit(WORD)).cast("long"),
        "detections": F.coalesce(placed.cast(none), F.array().cast(none)),
    }).drop("__raw", "__t", "__dets")


def op5_license_rules(spark, sf_dir: str) -> DataFrame:
    scan = scan_licenses(table(spark, sf_dir, "documents").select("doc_id", "text"))
    base = F.filter("detections", lambda d: d["tier"] == BASE_TIER)
    rows = scan.select("doc_id", "n_words", "detections", base.alias("base"))

    def labels(of: str) -> Column:
        return F.array_join(F.array_sort(F.array_distinct(F.transform(of, lambda d: d["label"]))), ",")

    starts = F.transform("base", lambda d: d["start_word"])
    return rows.select(
        "doc_id", "n_words", F.size("base").cast("long").alias("n_base"),
        F.array_min(starts).cast("long").alias("first_word"), F.array_max(starts).cast("long").alias("last_word"),
        labels("base").alias("base_labels"), labels("detections").alias("labels"),
        F.coalesce(F.array_max(F.transform("detections", lambda d: d["sure"])), F.lit(0.0)).alias("score"),
    )
