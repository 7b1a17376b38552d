"""Resampling of documents towards a target distribution, by hashed word features.

Every run of ``least`` to ``most`` words of a text is a feature; its bucket is its CRC-32 (:mod:`crc_spans`) modulo
``buckets``.  A bucket's gain is the logarithm of its share among the target texts over its share among the documents
(both counts raised by one), in thousandths.  A document's weight is the sum of the gains of its features, and adding
Gumbel noise (from a hash of its id) makes the highest scores a sample without replacement in proportion to the
weights.

The texts are read twice: once to count the buckets (each task hands on at most one row a bucket), once to weigh.  Only
the bucket counts come to the driver, ``buckets`` numbers whatever the input.  Ranks come from a range sort of the
scores, so no task holds all of them.

Null and blank texts, and texts without a word, have no features and weight 0; a null id is hashed as an empty one.
Repeated rows are documents of their own (equal score; ties go to the smaller id).  With no target texts every bucket
still has a gain; with no documents there are no rows.  Columns of other names are not touched.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from gridloom.llm.common import arrow_in_tasks, saved, table
from gridloom.llm.crc_spans import crc32_spans, text_bytes, word_runs, words_of
from gridloom.operators.scan import global_row_number

BUCKETS, SEED, LEAST_WORDS = 10_000, 2024, 20


def buckets_of(column: pa.Array, buckets: int, least: int, most: int):
    """(bucket of each feature, text number of each feature, words of each text)."""
    data, starts, ends, texts = words_of(*text_bytes(column))
    n_words = np.bincount(texts, minlength=len(column))
    spans = word_runs(data, starts, ends, texts, least, most)
    return crc32_spans(*spans[:3]).astype(np.int64) % buckets, spans[3], n_words


def _pieces(batches, most_bytes: int = 1 << 23):
    """Batches cut so that their texts together stay near ``most_bytes`` (one text at least)."""
    for batch in batches:
        sizes = np.diff(text_bytes(batch.column("text"))[1])
        group = (np.cumsum(sizes) - sizes) // most_bytes
        edges = [0, *(np.flatnonzero(np.diff(group)) + 1).tolist(), len(group)]
        for at, end in zip(edges[:-1], edges[1:], strict=True):
            if at < end:
                yield batch.slice(at, end - at)


def bucket_counts(df: DataFrame, text: str, buckets: int, least: int, most: int) -> np.ndarray:
    """How many features of all texts fall into each bucket."""
    def count(batches):
        total = np.zeros(buckets, dtype=np.int64)
        for piece in _pieces(batches):
            total += np.bincount(buckets_of(piece.column("text"), buckets, least, most)[0], minlength=buckets)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], names=["bucket", "n"])

    parts = arrow_in_tasks(df.select(F.col(f"`{text}`").alias("text")), count, "bucket long, n long")
    out = np.zeros(buckets, dtype=np.int64)
    for row in parts.groupBy("bucket").agg(F.sum("n").alias("n")).collect():  # at most ``buckets`` rows
        out[row.bucket] = row.n
    return out


def gains(here: np.ndarray, there: np.ndarray) -> np.ndarray:
    """Whole thousandths of the log ratio of the raised shares: target counts ``there`` against document counts ``here``."""
    n, s_all, t_all = len(here), int(here.sum()), int(there.sum())
    ratio = ((float(t) + 1) * (s_all + n) / ((float(s) + 1) * (t_all + n)) for s, t in zip(here.tolist(), there.tolist(), strict=True))
    return np.array([math.floor(1000 * math.log(x)) for x in ratio], dtype=np.int64)


def noise(doc_id: Column, seed: int) -> Column:
    """Thousandths of a standard Gumbel value, fixed by the id and the seed."""
    key = F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(key, 256), 1, 8), 16, 10).cast("double")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0)))


def weighed(docs: DataFrame, target: DataFrame, doc_id: str = "doc_id", text: str = "text", target_text: str = "text",
            buckets: int = BUCKETS, least: int = 1, most: int = 1, seed: int = SEED) -> DataFrame:
    """(doc_id, h, n_words, n_features, weight, score), one row per row of ``docs``; ``h`` is a hash of the text."""
    gain = gains(bucket_counts(docs, text, buckets, least, most), bucket_counts(target, target_text, buckets, least, most))

    def weigh(batches):
        for piece in _pieces(batches):
            bucket, of, n_words = buckets_of(piece.column("text"), buckets, least, most)
            n = len(n_words)
            order = np.argsort(of, kind="stable")
            sums = np.concatenate([[0], np.cumsum(gain[bucket[order]])])
            n_features = np.bincount(of, minlength=n)
            ends = np.cumsum(n_features)
            yield pa.RecordBatch.from_arrays(
                [piece.column("doc_id"), piece.column("h"), pa.array(n_words), pa.array(n_features), pa.array(sums[ends] - sums[ends - n_features])],
                names=["doc_id", "h", "n_words", "n_features", "weight"])

    rows = docs.select(F.col(f"`{doc_id}`").alias("doc_id"), F.xxhash64(F.col(f"`{text}`")).alias("h"), F.col(f"`{text}`").alias("text"))
    id_type = rows.schema["doc_id"].dataType.simpleString()
    out = arrow_in_tasks(rows, weigh, f"doc_id {id_type}, h long, n_words long, n_features long, weight long")
    return out.withColumn("score", F.col("weight") + noise(F.col("doc_id"), seed))


def ranked(docs: DataFrame, target: DataFrame, share: tuple[int, int] = (10, 100), least_words: int = LEAST_WORDS, **options) -> DataFrame:
    """:func:`weighed` plus ``rank``: 1, 2, 3 ... for the drawn documents, null for the others.

    ``share`` (a, b) draws ``floor(a * N / b)`` of the N documents with at least ``least_words`` words.
    """
    rows = saved(weighed(docs, target, **options), "resample")
    rows = rows.withColumn("__unable", (F.col("n_words") < least_words).cast("int"))
    drawn = rows.agg(F.expr(f"{share[0]} * count_if(n_words >= {least_words}) div {share[1]}").alias("__drawn"))
    order = [F.col("__unable"), F.col("score").desc(), F.col("doc_id"), F.col("h")]
    numbered = global_row_number(rows, [], order, "__no")
    out = numbered.join(F.broadcast(drawn))  # one row
    return out.withColumn("rank", F.when(F.col("__no") <= F.col("__drawn"), F.col("__no")).cast("long")).drop("__unable", "__no", "__drawn")


def resampled(docs: DataFrame, target: DataFrame, doc_id: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """The drawn rows of ``docs``, with its columns."""
    drawn = saved(ranked(docs, target, doc_id=doc_id, text=text, **options).where("rank is not null").select(
        F.col("doc_id").alias("__id"), F.col("h").alias("__h")), "drawn")
    key = F.col(f"`{doc_id}`").eqNullSafe(F.col("__id")) & (F.xxhash64(F.col(f"`{text}`")) == F.col("__h"))
    return docs.join(drawn, key, "left_semi")


def op11_importance_resample(spark, sf_dir: str) -> DataFrame:
    rows = ranked(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return rows.select("doc_id", "n_features", "weight", "score", "rank")
