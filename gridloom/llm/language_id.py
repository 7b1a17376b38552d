"""Language identification: multinomial logistic regression on TF-IDF character n-grams.

Lower-cased letters, with one space for whatever lies between words, give character n-grams of 1 to 4; they are hashed
into ``DIMS`` features.  Document frequencies are counted over all training rows.  Weights are learned by
follow-the-regularised-leader with an elastic net (the L1 part leaves most weights at zero) on a bounded sample, and a
temperature fitted on other rows of that sample turns the scores into calibrated probabilities.

Training rows: text and language given, id given, ``crc32(id as text) % 3 != 1``.  Of these, the ``SAMPLE`` rows with
the smallest hash are used for the weights (documented bound; one task holds their features), the rest still count for
the document frequencies.  Every row is predicted from its whole text alone.  ``und`` with score 0 where the text is
null or has no letter, or where nothing could be learned.  Repeated rows get equal predictions; an id that is null is
neither held out nor learned from.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from gridloom.llm.common import in_tasks, saved, table
from gridloom.llm.tokens import char_table, codepoints

DIMS, ORDERS, SAMPLE = 1 << 16, (1, 2, 3, 4), 6000
EPOCHS, ALPHA, BETA, L1, L2 = 3, 0.5, 1.0, 0.02, 0.5
LEAST_SCORE = 0.3  # short and mixed texts of known languages lie above it
UND = "und"


def grams(text: str) -> np.ndarray:
    """Feature number of every n-gram occurrence; empty if the text has no letter."""
    codes = codepoints(text.lower())
    letter = char_table("alpha")[codes]
    if not letter.any():
        return np.empty(0, dtype=np.uint32)
    keep = letter.copy()
    keep[1:] |= letter[:-1]  # the first other character after a word becomes its space
    codes = np.where(letter, codes, np.uint32(32))[keep]
    codes = np.concatenate([np.full(1, 32, np.uint32), codes, np.full(1, 32, np.uint32)])
    out, run = [], np.zeros(len(codes), dtype=np.uint32)
    for n in range(1, max(ORDERS) + 1):
        if len(codes) < n:
            break
        run = run[: len(codes) - n + 1] * np.uint32(0x01000193) + codes[n - 1 :]
        if n in ORDERS:
            mixed = (run + np.uint32(n)) * np.uint32(0x9E3779B1)
            out.append((mixed ^ (mixed >> np.uint32(15))) * np.uint32(0x85EBCA77) >> np.uint32(16))
    return np.concatenate(out)


def features(text: str, idf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(features, values): TF-IDF with damped term counts, of length 1."""
    g = grams(text)
    counts = np.bincount(g, minlength=DIMS) if len(g) > 4096 else None
    if counts is None:
        index, n = np.unique(g, return_counts=True)
    else:
        index = np.flatnonzero(counts)
        n = counts[index]
    value = (1 + np.log(n)) * idf[index]
    norm = np.sqrt((value * value).sum())
    return index, value / norm if norm > 0 else value


def _count_task(batches):
    """Document frequencies of one partition; the last place counts the documents."""
    seen = np.zeros(DIMS + 1, dtype=np.int64)
    for batch in batches:
        for text in batch["text"]:
            hit = np.zeros(DIMS + 1, dtype=bool)
            hit[grams(text)] = True
            hit[DIMS] = True
            seen += hit
    if seen[DIMS]:
        at = np.flatnonzero(seen)
        yield pd.DataFrame({"at": at.astype(np.int32), "seen": seen[at]})


def document_frequencies(texts: DataFrame) -> tuple[int, np.ndarray]:
    """(documents, documents with each feature), added up in the executors; ``DIMS`` numbers reach the driver."""
    parts = in_tasks(texts, _count_task, "at int, seen long")
    got = parts.groupBy("at").agg(F.sum("seen").alias("seen")).toPandas()
    out = np.zeros(DIMS + 1)
    out[got["at"].to_numpy(dtype=np.int64)] = got["seen"].to_numpy(dtype=np.float64)
    return int(out[DIMS]), out[:DIMS]


def ftrl(rows: list[tuple[np.ndarray, np.ndarray, int]], classes: int) -> np.ndarray:
    """Weights (DIMS, classes) by FTRL-proximal with an elastic net; the rows come in their given order."""
    z, n = np.zeros((DIMS, classes)), np.zeros((DIMS, classes))

    def weights(zi: np.ndarray, ni: np.ndarray) -> np.ndarray:
        shrunk = np.sign(zi) * np.maximum(np.abs(zi) - L1, 0.0)
        return -shrunk / ((BETA + np.sqrt(ni)) / ALPHA + L2)

    for _ in range(EPOCHS):
        for index, value, label in rows:
            zi, ni = z[index], n[index]
            w = weights(zi, ni)
            p = value @ w
            p = np.exp(p - p.max())
            p /= p.sum()
            p[label] -= 1
            g = value[:, None] * p[None, :]
            g2 = g * g
            z[index] = zi + g - (np.sqrt(ni + g2) - np.sqrt(ni)) / ALPHA * w
            n[index] = ni + g2
    return weights(z, n)


def temperature(scores: np.ndarray, labels: np.ndarray) -> float:
    """Divisor of the scores with the least log loss, by golden section on its logarithm.

    The targets are smoothed by one pseudo-count per class, so that a faultless sample still has a finite optimum.
    """
    if not len(labels):
        return 1.0
    count, classes = scores.shape
    soft = np.full(scores.shape, 1.0 / (count + classes))
    soft[np.arange(count), labels] += count / (count + classes)

    def loss(log_t: float) -> float:
        s = scores / np.exp(log_t)
        s = s - s.max(axis=1, keepdims=True)
        return float((np.log(np.exp(s).sum(axis=1)) - (soft * s).sum(axis=1)).mean())

    lo, hi, g = np.log(0.02), np.log(50.0), (5 ** 0.5 - 1) / 2
    for _ in range(60):
        a, b = hi - g * (hi - lo), lo + g * (hi - lo)
        lo, hi = (lo, b) if loss(a) <= loss(b) else (a, hi)
    return float(np.exp((lo + hi) / 2))


def train_task(idf: np.ndarray):
    """One task: the bounded sample becomes one row per non-zero weight row, and the temperature."""

    def run(batches):
        drawn = [(*features(text, idf), lang) for b in batches for text, lang in zip(b["text"], b["lang"], strict=True)]
        langs = sorted({lang for index, _, lang in drawn if len(index)})
        if not langs:
            return
        drawn = [(index, value, langs.index(lang)) for index, value, lang in drawn if len(index)]
        rows = [r for i, r in enumerate(drawn) if i % 5 != 4]
        check = [r for i, r in enumerate(drawn) if i % 5 == 4]
        w = ftrl(rows, len(langs))
        scores = np.array([v @ w[i] for i, v, _ in check]).reshape(len(check), len(langs))
        t = temperature(scores, np.array([label for _, _, label in check], dtype=np.int64))
        kept = np.flatnonzero(np.abs(w).sum(axis=1))
        yield pd.DataFrame({"langs": [langs], "index": [kept], "weights": [w[kept].ravel()], "temperature": [t]})

    return run


def fit(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang", sample: int = SAMPLE) -> dict | None:
    """The model (langs, idf, weights, temperature), or None if no row can be learned from."""
    part = remainder(F.col(f"`{doc_id}`"))
    known = docs.where(F.col(f"`{text}`").isNotNull() & F.col(f"`{lang}`").isNotNull() & (part != 1)).select(
        F.col(f"`{text}`").alias("text"), F.col(f"`{lang}`").alias("lang"), F.xxhash64(F.col(f"`{doc_id}`")).alias("h"))
    n, seen = document_frequencies(known.select("text"))
    if not n:
        return None
    idf = np.log((1 + n) / (1 + seen)) + 1
    # The hashes alone tell where the sample ends; only its rows then move with their texts.
    last = known.select("h").orderBy("h").limit(sample).agg(F.max("h")).first()[0]
    drawn = known.where(F.col("h") <= last).orderBy("h", "lang", "text").limit(sample)
    got = in_tasks(drawn.coalesce(1), train_task(idf),
                   "langs array<string>, index array<int>, weights array<double>, temperature double").first()
    if got is None:
        return None
    weights = np.zeros((DIMS, len(got["langs"])), dtype=np.float64)
    weights[np.array(got["index"], dtype=np.int64)] = np.array(got["weights"]).reshape(-1, len(got["langs"]))
    return {"langs": got["langs"], "idf": idf, "weights": weights, "temperature": got["temperature"]}


def remainder(doc_id: Column) -> Column:
    return F.crc32(doc_id.cast("string").cast("binary")) % 3


def predict_task(model, keep_text: bool):
    """Language and probability of each text; ``model`` is a broadcast of the fitted model or of None."""

    def run(batches):
        m = model.value
        for batch in batches:
            langs, scores = [], []
            for text in batch["text"]:
                index, value = features(text, m["idf"]) if m and isinstance(text, str) else ((), ())
                if not len(index):
                    langs.append(UND)
                    scores.append(0.0)
                    continue
                s = value @ m["weights"][index] / m["temperature"]
                s = np.exp(s - s.max())
                best = int(np.argmax(s))
                langs.append(m["langs"][best])
                scores.append(min(1.0, float(s[best] / s.sum())))
            yield (batch if keep_text else batch.drop(columns="text")).assign(lang_pred=langs, score=scores)

    return run


def predict(docs: DataFrame, model: dict | None, keys: dict[str, Column], text: str = "text", keep_text: bool = False) -> DataFrame:
    """``keys`` (and ``text``) plus ``lang_pred`` and ``score`` for each row; the model's size is fixed by ``DIMS``."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    rows = docs.select(*[c.alias(k) for k, c in keys.items()], F.col(f"`{text}`").alias("text"))
    fields = rows.schema.fields if keep_text else rows.schema.fields[:-1]
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in fields)
    return in_tasks(rows, predict_task(shared, keep_text), f"{kinds}, lang_pred string, score double")


def accepted(docs: DataFrame, text: str = "text") -> DataFrame:
    """Documents whose language is recognised: predicted with a probability of at least ``LEAST_SCORE``.

    Without a labelled row there is nothing to tell languages by, and all documents stay.
    """
    model = fit(docs)
    if model is None:
        return docs
    names = {c: "text" if c == text else f"c{i}" for i, c in enumerate(docs.columns)}
    keys = {n: F.col(f"`{c}`") for c, n in names.items() if c != text}
    rows = predict(docs, model, keys, text, keep_text=True)
    good = rows.where((F.col("lang_pred") != UND) & (F.col("score") >= LEAST_SCORE))
    return good.select(*[F.col(n).alias(c) for c, n in names.items()])


def op2_language_id(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    held = F.coalesce(remainder(F.col("doc_id")) == 1, F.lit(False))
    return predict(docs, fit(docs), {"doc_id": F.col("doc_id"), "held_out": held})
