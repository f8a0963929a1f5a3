"""Placement by a permutation-filled lookup table.

Every shard has its own permutation of the slots of a prime-sized table: offset + j * skip modulo the size.
Shards take turns, each claiming the first slot of its permutation that is still free, until the table is full.
Shares differ by one slot at most, and when a shard leaves, few of the others' slots move. Placing a row is one
hash and one look into the table, which never depends on the data and so is broadcast.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SLOTS = 65_537


def preference(shard: str, slots: int) -> tuple[int, int]:
    digest = hashlib.md5(shard.encode()).hexdigest()
    return int(digest[:8], 16) % slots, int(digest[8:16], 16) % (slots - 1) + 1


def lookup_table(shards: list[str], slots: int = SLOTS) -> list[int]:
    """The index of the shard that owns each slot."""
    if not shards or len(set(shards)) < len(shards) or len(shards) > slots:
        raise ValueError("shards must be distinct, and between one and as many as there are slots")
    if slots < 3 or any(slots % k == 0 for k in range(2, int(slots**0.5) + 1)):
        raise ValueError("the number of slots must be an odd prime")
    order = [preference(s, slots) for s in shards]
    owner, turn, filled = [-1] * slots, [0] * len(shards), 0
    while True:
        for k, (offset, skip) in enumerate(order):
            at = (offset + turn[k] * skip) % slots
            while owner[at] >= 0:
                turn[k] += 1
                at = (offset + turn[k] * skip) % slots
            owner[at] = k
            turn[k] += 1
            filled += 1
            if filled == slots:
                return owner


def place(rows: DataFrame, key: str, shards: list[str], slots: int = SLOTS) -> DataFrame:
    """The rows with slot long and shard string (columns of these names are replaced).

    The slot is the first 32 bits of the md5 of the key's text, modulo the size; a null key counts as the empty
    text. Repeated keys go to the same place. The table has `slots` rows by construction, hence the broadcast.
    """
    rows = rows.drop("slot", "shard")
    table = lookup_table(shards, slots)
    spark = rows.sparkSession
    names = F.split(F.lit("\n".join(shards)), "\n")
    owned = spark.range(1).select(F.posexplode(F.split(F.lit(",".join(map(str, table))), ",")).alias("slot", "k"))
    owned = owned.select(F.col("slot").cast("long").alias("slot"), F.element_at(names, F.col("k").cast("int") + 1).alias("shard"))
    digest = F.md5(F.coalesce(F.col(key).cast("string"), F.lit("")).cast("binary"))
    slot = F.conv(F.substring(digest, 1, 8), 16, 10).cast("long") % slots
    return rows.withColumn("slot", slot).join(F.broadcast(owned), "slot", "left").select(*rows.columns, "slot", "shard")
