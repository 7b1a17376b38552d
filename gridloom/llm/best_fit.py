"""Conflict-constrained best-fit packing of documents into token sequences.

Documents are cut into pieces of at most ``capacity`` words; full pieces fill a sequence alone, the rest is packed.
Pieces are taken longest first, and each goes to the open bin with the smallest sufficient room whose bitmaps have
neither its source nor its duplicate cluster; the successor search walks to the next larger room until such a bin is
found, and opens a new one otherwise.  So no sequence repeats a source or holds two copies of a text.

Packing runs in blocks of at most ``BLOCK`` pieces, dealt by hash; a block fits one task whatever the sizes of sources
and clusters, and blocks do not depend on each other.  Every piece is placed exactly once.  Null and blank texts have
no words and are left out; a null source is a source of its own; repeated rows are copies of one text; empty tables
give no rows.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, functions as F

from gridloom.llm.common import in_tasks, table
from gridloom.llm.mixing import WORD

CAPACITY, BLOCK = 2048, 4096


class Bins:
    """Open bins by room left, with one source and one cluster bitmap each."""

    def __init__(self, capacity: int) -> None:
        self.capacity = capacity
        self.rooms = 0  # bit r: some bin has room r
        self.by_room: dict[int, list[int]] = {}
        self.room: list[int] = []
        self.sources: list[int] = []
        self.clusters: list[int] = []

    def _file(self, bin_: int) -> None:
        room = self.room[bin_]
        if room:
            self.by_room.setdefault(room, []).append(bin_)
            self.rooms |= 1 << room

    def put(self, size: int, source: int, cluster: int) -> int:
        """Index of the bin that takes a piece; ``source`` and ``cluster`` are one-bit masks (0: no conflict)."""
        rooms = self.rooms >> size << size
        while rooms:
            room = (rooms & -rooms).bit_length() - 1
            waiting = self.by_room[room]
            for place, bin_ in enumerate(waiting):
                if not (self.sources[bin_] & source or self.clusters[bin_] & cluster):
                    waiting.pop(place)
                    if not waiting:
                        self.rooms &= ~(1 << room)
                    self.room[bin_] = room - size
                    self.sources[bin_] |= source
                    self.clusters[bin_] |= cluster
                    self._file(bin_)
                    return bin_
            rooms &= rooms - 1
        self.room.append(self.capacity - size)
        self.sources.append(source)
        self.clusters.append(cluster)
        self._file(len(self.room) - 1)
        return len(self.room) - 1


def pack_block(pieces: pd.DataFrame, capacity: int) -> pd.DataFrame:
    """``pieces`` (doc_id, source, cluster, start, size) with ``bin`` and ``offset`` inside the block."""
    order = pieces.sort_values(["size", "hash", "start"], ascending=[False, True, True], kind="stable").reset_index(drop=True)
    bits: tuple[dict, dict] = {}, {}
    bins = Bins(capacity)
    where, offset = [], []
    sources = order["source"].astype(object).where(order["source"].notna(), None)
    for size, source, cluster in zip(order["size"].tolist(), sources, order["cluster"].tolist(), strict=True):
        masks = [1 << known.setdefault(key, len(known)) for known, key in zip(bits, (source, cluster), strict=True)]
        bin_ = bins.put(size, *masks)
        where.append(bin_)
        offset.append(capacity - bins.room[bin_] - size)
    return order.assign(bin=where, offset=offset)


def _pack(capacity: int, block: int):
    def run(batches):
        """Cut the partition's rows, in their order, into blocks; only one block is held."""
        part, waiting, count = None, [], 0

        def done(rows: pd.DataFrame, number: int) -> pd.DataFrame:
            packed = pack_block(rows, capacity)
            packed["bin_id"] = [f"{part}-{number}-{b}" for b in packed["bin"]]
            return packed[["bin_id", "doc_id", "start", "size", "offset"]]

        number = 0
        for batch in batches:
            part = int(batch["part"].iloc[0]) if len(batch) else part
            while len(batch):
                take = batch.iloc[: block - count]
                batch = batch.iloc[block - count :]
                waiting.append(take)
                count += len(take)
                if count == block:
                    yield done(pd.concat(waiting, ignore_index=True), number)
                    waiting, count, number = [], 0, number + 1
        if count:
            yield done(pd.concat(waiting, ignore_index=True), number)

    return run


def pieces(docs: DataFrame, doc_id: str, text: str, source: str, cluster: str | None, capacity: int) -> DataFrame:
    """(doc_id, source, cluster, hash, start, size): the pieces of every document, by word position."""
    value = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    same = F.col(f"`{cluster}`") if cluster else F.xxhash64(value)
    rows = docs.select(
        F.col(f"`{doc_id}`").alias("doc_id"), F.col(f"`{source}`").alias("source"), same.alias("cluster"),
        F.xxhash64(F.col(f"`{doc_id}`"), value).alias("hash"),
        F.regexp_count(value, F.lit(WORD)).cast("long").alias("words"),
    ).where("words > 0")
    starts = F.sequence(F.lit(0).cast("long"), F.col("words") - 1, F.lit(capacity).cast("long"))
    cut = rows.select("*", F.explode(starts).alias("start"))
    return cut.withColumn("size", F.least(F.lit(capacity), F.col("words") - F.col("start"))).drop("words")


def pack(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source", cluster: str | None = None,
         capacity: int = CAPACITY, block: int = BLOCK) -> DataFrame:
    """(bin_id, doc_id, start, n_words, offset): words ``start`` and on of a document stand at ``offset`` of a sequence.

    ``cluster`` names a column of duplicate clusters; without it, equal texts form one.
    """
    cut = pieces(docs, doc_id, text, source, cluster, capacity)
    id_type = cut.schema["doc_id"].dataType.simpleString()
    full = cut.where(F.col("size") == capacity).select(
        F.concat_ws("-", F.lit("full"), F.col("doc_id").cast("string"), F.hex("hash"), F.col("start").cast("string")).alias("bin_id"),
        "doc_id", "start", F.col("size").alias("n_words"), F.lit(0).cast("long").alias("offset"))
    # Hash order mixes sizes and sources; equal rows may exceed a block, which then simply goes on in the next one.
    rest = cut.where(F.col("size") < capacity).repartition("hash").sortWithinPartitions("hash", "doc_id", "start")
    rest = rest.withColumn("part", F.spark_partition_id())
    packed = in_tasks(rest, _pack(capacity, block), f"bin_id string, doc_id {id_type}, start long, size long, offset long")
    return full.union(packed.select("bin_id", "doc_id", "start", F.col("size").alias("n_words"), "offset"))


def op8_best_fit(spark, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents").select("doc_id", "text", "source"))
