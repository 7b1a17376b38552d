"""Document placement by a permutation-filled lookup table (DataFrame functions only).

Every shard has its own order of preference over the slots of a table of prime size: ``(offset + i * skip) mod size``.
The shards take turns; each claims its next slot that is still free, until the table is full.  A document's key hash,
modulo the table size, names its slot, so placement is one broadcast lookup.  Shards differ by at most one slot, and
losing a shard moves few of the other shards' documents.

The table depends on the shard names alone and has ``size`` rows whatever the data; that bound is checked before it is
broadcast.  A null id is hashed as the empty text, repeated rows go to the same shard, empty tables give no rows, and
input columns named like the added ones give way.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from gridloom.llm.common import table, with_added

SIZE = 65_537
SHARDS = tuple(f"shard-{i:03d}" for i in range(64))
LARGEST = 1_000_003


def _is_prime(n: int) -> bool:
    return n > 1 and all(n % d for d in range(2, int(n ** 0.5) + 1))


def claimed_slots(shards: tuple[str, ...], size: int = SIZE) -> list[int]:
    """Index of the owner of each slot."""
    if not shards or len(set(shards)) != len(shards):
        raise ValueError("shard names must be given, and distinct")
    if not _is_prime(size) or not len(shards) <= size <= LARGEST:
        raise ValueError(f"the table size must be a prime from the number of shards up to {LARGEST}")
    start, skip = [], []
    for name in shards:
        digest = hashlib.sha256(name.encode()).digest()
        start.append(int.from_bytes(digest[:8], "big") % size)
        skip.append(int.from_bytes(digest[8:16], "big") % (size - 1) + 1)
    owner, at, left = [-1] * size, start, size
    while left:
        for shard in range(len(shards)):
            slot = at[shard]
            while owner[slot] >= 0:
                slot = (slot + skip[shard]) % size
            owner[slot] = shard
            at[shard] = (slot + skip[shard]) % size
            left -= 1
            if not left:
                break
    return owner


def lookup_table(spark: SparkSession, shards: tuple[str, ...] = SHARDS, size: int = SIZE) -> DataFrame:
    """(slot, shard), one row per slot."""
    owners = F.split(F.lit(",".join(map(str, claimed_slots(tuple(shards), size)))), ",")
    names = F.array(*[F.lit(s) for s in shards])
    rows = spark.range(1, numPartitions=1).select(F.posexplode(owners).alias("slot", "owner"))
    return rows.select("slot", F.get(names, F.col("owner").cast("int")).alias("shard"))


def key_hash(key: Column) -> Column:
    """60 bits of the MD5 of the key's text."""
    return F.conv(F.substring(F.md5(F.coalesce(key.cast("string"), F.lit("")).cast("binary")), 1, 15), 16, 10).cast("long")


def place(docs: DataFrame, key: str = "doc_id", shards: tuple[str, ...] = SHARDS, size: int = SIZE) -> DataFrame:
    """``docs`` plus ``slot`` and ``shard``; no shuffle."""
    owners = lookup_table(docs.sparkSession, shards, size).select(F.col("slot").alias("__slot"), F.col("shard").alias("__shard"))
    keyed = docs.withColumn("__at", (key_hash(F.col(f"`{key}`")) % size).cast("int"))
    found = keyed.join(F.broadcast(owners), F.col("__at") == F.col("__slot"))
    return with_added(found, {"slot": F.col("__at"), "shard": F.col("__shard")}).drop("__at", "__slot", "__shard")


def op3_shard_table(spark, sf_dir: str) -> DataFrame:
    return place(table(spark, sf_dir, "documents").select("doc_id", "source", "n_chars"))
