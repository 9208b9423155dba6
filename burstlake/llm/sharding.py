"""Sharding by a permutation-filled lookup table.

Each shard has a permutation of the table's slots, given by an offset and a step
(the table's size is prime, so any step visits all slots). Shards take turns; at
its turn a shard claims the first slot of its permutation that is still free,
until none is. A key belongs to the shard of slot hash(key) mod size: one look-up,
with nearly equal shares, and when a shard goes, nearly all other keys stay.

The table's size is a parameter, so it is bounded however large the data; it is
filled once at the driver and broadcast. Keys are hashed by their text form's MD5.

Defined results: a null key has the hash of the empty text; equal keys share a
shard, so repeated rows stay together; an empty table gives an empty result; the
columns ``slot`` and ``shard`` take the place of columns of that name.
"""

from __future__ import annotations

import hashlib

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SIZE = 65_537
SHARDS = tuple(f"shard-{i:03d}" for i in range(64))


def _number(text: str) -> int:
    return int(hashlib.md5(text.encode()).hexdigest()[:15], 16)


def lookup_table(shards: tuple[str, ...] = SHARDS, size: int = SIZE) -> np.ndarray:
    """For every slot the index of the shard that claimed it."""
    if not shards or len(set(shards)) < len(shards) or size < len(shards):
        raise ValueError("shards must be distinct, and no more than slots")
    if size < 2 or any(size % d == 0 for d in range(2, int(size**0.5) + 1)):
        raise ValueError("the size must be prime")
    at = [_number(f"offset:{s}") % size for s in shards]
    step = [_number(f"step:{s}") % (size - 1) + 1 for s in shards]
    table = np.full(size, -1, np.int32)
    left = size
    while left:
        for i in range(len(shards)):
            while table[at[i]] >= 0:
                at[i] = (at[i] + step[i]) % size
            table[at[i]] = i
            left -= 1
            if not left:
                break
    return table


def slot_of(key: Column, size: int = SIZE) -> Column:
    text = F.coalesce(key.cast("string"), F.lit(""))
    return F.pmod(F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("long"), F.lit(size)).cast("int")


def place(df: DataFrame, key: str, shards: tuple[str, ...] = SHARDS, size: int = SIZE) -> DataFrame:
    """Add ``slot`` and ``shard``. The broadcast table has ``size`` rows, whatever the data."""
    table = [(slot, shards[i]) for slot, i in enumerate(lookup_table(shards, size).tolist())]
    lookup = F.broadcast(df.sparkSession.createDataFrame(table, "slot int, shard string"))
    rest = df.select(*(c for c in df.columns if c.lower() not in ("slot", "shard")), slot_of(F.col(key), size).alias("slot"))
    return rest.join(lookup, "slot").select(*rest.columns[:-1], "slot", "shard")


def write_shards(df: DataFrame, key: str, path: str, shards: tuple[str, ...] = SHARDS, size: int = SIZE) -> None:
    """A folder for each shard. Rows are dealt by slot before they are written, so a shard's files are few but not one."""
    place(df, key, shards, size).repartition("slot").write.partitionBy("shard").parquet(path)


def placements(docs: DataFrame) -> DataFrame:
    """Slot and shard of every document, and what it holds."""
    rows = docs.select("doc_id", F.length(F.coalesce("text", F.lit(""))).cast("long").alias("chars"))
    return place(rows, "doc_id").select("doc_id", "slot", "shard", "chars")
