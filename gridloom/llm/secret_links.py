"""Secret scan with multipart credential linking (DataFrame functions only, one pass, no shuffle).

Three strong patterns are always reported.  Identifiers, weak secrets (bare mixed-case tokens of 20 characters or more,
URL-safe and dotted ones too) and endpoints mean
little alone: inside a scope (text between blank lines) they are joined on the distance of their intervals and
reported only where complementary parts meet:

* an identifier and a secret (strong or weak) at most ``reach`` code points apart are both reported;
* an endpoint is reported where such an identifier and such a secret both lie within its reach.

All work is per row: null and empty texts give no spans, repeated rows give repeated results, a long text costs its
length times the parts of a scope, and input columns named like the added ones give way.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from gridloom.llm.common import match_spans, no_spans, table, with_added

# The contract's patterns and least lengths.
ASSIGN = r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ASSIGN_LEAST = 8
ACCESS = r"AKIA[A-Z0-9]+"
ACCESS_LEAST = 16
# A run of 32 or more is found exactly where the run of any length is one of 32 or more.
HEX = r"[0-9a-f]{32,}"

# Parts that count only together.
IDENTIFIER = (
    r"""(?<![A-Za-z0-9_])(?i:client[_-]?id|access[_-]?key[_-]?id|account[_-]?id|tenant[_-]?id|user[_-]?name|user|login)"""
    r"""["']?\x20*[:=]\x20*["']?[A-Za-z0-9@._-]{3,}"""
)
_MIXED = r"(?=[{0}]*[0-9])(?=[{0}]*[a-z])(?=[{0}]*[A-Z])"
# Dotted parts, or one run of either base64 alphabet; of any length from 20 (possessive, so long runs need no stack).
WEAK = (
    r"(?<![A-Za-z0-9+/=_.-])(?:"
    + _MIXED.format("A-Za-z0-9_.-") + r"(?=(?:[A-Za-z0-9_-]|\.(?=[A-Za-z0-9_-])){20})[A-Za-z0-9_-]++(?:\.[A-Za-z0-9_-]++)++"
    + r"(?![A-Za-z0-9+/=_-])|"
    + _MIXED.format("A-Za-z0-9+/_-") + r"[A-Za-z0-9+/_-]{20,}+={0,2}+(?![A-Za-z0-9+/=_-]))"
)
ENDPOINT = (
    r"""(?i:(?<![a-z0-9])(?:https?|jdbc:[a-z]+|postgres(?:ql)?|mysql|mongodb|redis|amqps?|s3)://[^\s"'<>]+"""
    r"""|(?<![a-z0-9_])(?:endpoint|host(?:name)?)["']?\x20*[:=]\x20*["']?[a-z0-9.-]+)"""
)
SCOPE_BREAK = r"\n[ \t\r]*\n"
KINDS = ("assign", "access", "hex", "identifier", "secret", "endpoint")
_SPAN = "array<struct<start:int,rank:int,end:int>>"


def _labelled(spans: Column, rank: int, least: int = 0) -> Column:
    return F.transform(
        F.filter(spans, lambda s: s["part"] >= least),
        lambda s: F.struct(s["start"].alias("start"), F.lit(rank).alias("rank"), s["end"].alias("end")),
    )


def _found(text: Column, pattern: str, rank: int, least: int = 0, group: int | None = None) -> Column:
    """Spans of one kind; the cheap test first, as most texts hold none."""
    return F.when(
        text.rlike(pattern), _labelled(match_spans(text, F.lit(pattern), group), rank, least)
    ).otherwise(F.array().cast(_SPAN))


def _near(a: Column, b: Column, reach: int) -> Column:
    """Gap of two intervals at most ``reach`` (overlaps have none)."""
    return F.greatest(a["start"], b["start"]) - F.least(a["end"], b["end"]) <= reach


def _scopes(text: Column) -> Column:
    """(start, end) of the stretches between blank lines."""
    breaks = F.when(text.rlike(SCOPE_BREAK), match_spans(text, F.lit(SCOPE_BREAK))).otherwise(no_spans())
    starts = F.concat(F.array(F.lit(0)), F.transform(breaks, lambda b: b["end"]))
    ends = F.concat(F.transform(breaks, lambda b: b["start"]), F.array(F.length(text)))
    return F.arrays_zip(starts.alias("start"), ends.alias("end"))


def _linked(scope: Column, ids: Column, secrets: Column, weak: Column, ends: Column, reach: int) -> Column:
    """Parts of one scope that have their complement nearby."""
    def inside(parts: Column) -> Column:
        return F.filter(parts, lambda p: (p["start"] >= scope["start"]) & (p["start"] < scope["end"]))

    here_ids, here_secrets = inside(ids), inside(F.concat(secrets, weak))
    out_ids = F.filter(here_ids, lambda i: F.exists(here_secrets, lambda s: _near(i, s, reach)))
    out_weak = F.filter(inside(weak), lambda w: F.exists(here_ids, lambda i: _near(w, i, reach)))
    out_ends = F.filter(
        inside(ends),
        lambda e: F.exists(
            here_ids,
            lambda i: _near(e, i, reach)
            & F.exists(here_secrets, lambda s: _near(e, s, reach) & _near(i, s, reach)),
        ),
    )
    return F.concat(out_ids, out_weak, out_ends)


def find_secrets(docs: DataFrame, text: str = "text", reach: int = 400) -> DataFrame:
    """``docs`` plus ``base`` and ``found``: arrays of (start, rank, end), sorted; ``rank`` indexes :data:`KINDS`."""
    value = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    step = docs.withColumn("__text", value).withColumns({
        "__assign": _found(F.col("__text"), ASSIGN, 0, ASSIGN_LEAST, 2),
        "__access": _found(F.col("__text"), ACCESS, 1, ACCESS_LEAST),
        "__hex": _found(F.col("__text"), HEX, 2),
        "__id": _found(F.col("__text"), IDENTIFIER, 3),
        "__weak": _found(F.col("__text"), WEAK, 4),
    })
    # A weak token that a strong pattern covers is that secret, not another one.
    strong = F.concat("__assign", "__hex")
    step = step.withColumn("__weak", F.filter("__weak", lambda w: ~F.exists(
        F.concat("__assign", "__access", "__hex"), lambda b: (b["start"] < w["end"]) & (w["start"] < b["end"]))))
    # Access keys are identifiers too, but are reported as they are.
    ids = F.concat("__id", "__access")
    step = step.withColumns({"__ids": ids, "__strong": strong})
    candidates = (F.size("__ids") > 0) & (F.size("__strong") + F.size("__weak") > 0)
    step = step.withColumn(
        "__end", F.when(candidates, _found(F.col("__text"), ENDPOINT, 5)).otherwise(F.array().cast(_SPAN))
    )
    linked = F.when(candidates, F.flatten(F.transform(
        _scopes(F.col("__text")),
        lambda s: _linked(s, F.col("__ids"), F.col("__strong"), F.col("__weak"), F.col("__end"), reach),
    ))).otherwise(F.array().cast(_SPAN))
    base = F.concat("__assign", "__access", "__hex")
    out = step.withColumns({"__base": F.array_sort(base), "__linked": linked})
    found = F.array_sort(F.array_distinct(F.concat("__base", "__linked")))
    out = with_added(out, {"base": F.col("__base"), "found": found})
    return out.drop("__text", "__assign", "__access", "__hex", "__id", "__ids", "__weak", "__strong", "__end",
                    "__base", "__linked")


def joined(spans: Column) -> Column:
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(
        ":", F.get(names, s["rank"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def redact(docs: DataFrame, text: str = "text", reach: int = 400) -> DataFrame:
    """Same rows and columns, every found span replaced by ``[kind]``; of overlapping spans the first one names it.

    ``n_chars``, where there is one, follows the new text.  Texts without a span stay as they are.
    """
    columns = docs.columns
    names = F.array(*[F.lit(f"[{k}]") for k in KINDS])
    scan = find_secrets(docs.withColumn("__keep", F.struct(*[F.col(f"`{c}`") for c in columns])), text, reach)
    source = F.col("__keep")[text]

    def step(acc: Column, s: Column) -> Column:
        fresh = F.struct(
            F.concat(acc["out"], F.substring(source, acc["pos"] + 1, s["start"] - acc["pos"]),
                     F.get(names, s["rank"])).alias("out"),
            s["end"].alias("pos"),
        )
        over = F.struct(acc["out"].alias("out"), F.greatest(acc["pos"], s["end"]).alias("pos"))
        return F.when(s["start"] >= acc["pos"], fresh).otherwise(over)

    start = F.struct(F.lit("").alias("out"), F.lit(0).alias("pos"))
    clean = F.aggregate("found", start, step, lambda acc: F.concat(
        acc["out"], F.substring(source, acc["pos"] + 1, F.length(source) - acc["pos"])))
    clean = F.when(F.size("found") > 0, clean).otherwise(source)
    scan = scan.withColumn("__clean", clean)
    out = {c: F.col("__keep")[c] for c in columns} | {text: F.col("__clean")}
    if "n_chars" in columns:
        kind = docs.schema["n_chars"].dataType
        out["n_chars"] = F.when(F.size("found") > 0, F.length("__clean").cast(kind)).otherwise(F.col("__keep")["n_chars"])
    return scan.select(*[out[c].alias(c) for c in columns])


def op10_secret_links(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    scan = find_secrets(docs)

    def n(rank: int) -> Column:
        return F.size(F.filter("base", lambda s: s["rank"] == rank)).cast("long")

    return scan.select(
        "doc_id", n(0).alias("n_assign"), n(1).alias("n_access"), n(2).alias("n_hex"),
        F.sha2(joined(F.col("base")), 256).alias("base_sha256"), joined(F.col("found")).alias("spans"),
    )
