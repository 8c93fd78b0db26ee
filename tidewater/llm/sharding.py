"""Sharding by a permutation-filled lookup table.

Every shard has a preference order over the slots of a prime-sized table (an offset and a
step taken from its name). Shards take turns; in its turn a shard claims the first free
slot of its order. All shards get the same number of slots, give or take one, and when a
shard comes or goes few slots change hands. A key's slot is its hash modulo the table, so
placement is one lookup; the table is as large as its parameter says and is broadcast.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewater.session import columns_of

TABLE = 65_537
SHARDS = [f"shard-{i:03d}" for i in range(96)]


def _number(text: str) -> int:
    return int(hashlib.md5(text.encode()).hexdigest()[:15], 16)


def is_prime(n: int) -> bool:
    return n > 1 and all(n % k for k in range(2, int(n**0.5) + 1))


def build_table(shards: list[str], size: int = TABLE) -> list[str]:
    """The shard of every slot."""
    if not is_prime(size) or not 0 < len(shards) <= size or len(set(shards)) < len(shards):
        raise ValueError("the table needs a prime size and as many distinct shards at most")
    place = [_number(f"offset:{s}") % size for s in shards]
    step = [_number(f"step:{s}") % (size - 1) + 1 for s in shards]
    slots: list[str | None] = [None] * size
    free = size
    while free:
        for i, shard in enumerate(shards):
            while slots[place[i]] is not None:
                place[i] = (place[i] + step[i]) % size
            slots[place[i]] = shard
            free -= 1
            if not free:
                break
    return slots


def slot_of(key: Column, size: int = TABLE) -> Column:
    """60 bits of the key's MD5 modulo the table; a null key counts as ''."""
    return F.conv(F.substring(F.md5(F.coalesce(key.cast("string"), F.lit(""))), 1, 15), 16, 10).cast("long") % size


def place(rows: DataFrame, key: str, shards: list[str] | None = None, size: int = TABLE) -> DataFrame:
    """rows with slot and shard added (columns of these names are replaced).

    Null keys go to the slot of the empty text; repeated keys go to one shard. No rows: no rows.
    """
    spark = rows.sparkSession
    table = spark.createDataFrame(pa.table({"slot": pa.array(range(size), pa.int64()), "shard": build_table(SHARDS if shards is None else shards, size)}))
    named = dict(zip(rows.columns, columns_of(rows)))
    others = [quoted for c, quoted in named.items() if c not in ("slot", "shard")]
    kept = rows.select(*others, slot_of(F.col(named[key]), size).alias("slot"))
    return kept.join(F.broadcast(table), "slot").select(*others, "slot", "shard")


def write_shards(placed: DataFrame, path: str) -> None:
    """One folder for each shard; a shard of many rows is written by many tasks."""
    placed.write.mode("overwrite").partitionBy("shard").parquet(path)
