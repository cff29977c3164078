"""Jump consistent hashing: keys to shards without a table of ring points.

Each key seeds a linear congruential generator whose draws are the shard
counts at which the key moves. A key's shard for n shards is the last such
count below n, so appending a shard moves only the keys that go into it.

Everything is built-in column arithmetic. Spark's checked 64-bit products
raise on overflow, so the generator's state is kept as two 32-bit halves.

A null key counts as key 0, and a key that is no integer is hashed to one. A null text has size 8 and the CRC of no bytes.
Rows that repeat a key share its shard and get slots of their own. An empty
table gives an empty result; extra columns are left out.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .ranking import numbered
from .store import Tables

#: Multiplier of the generator in Lamping and Veach's paper, as 32-bit halves.
MULTIPLIER = 2862933555777941757
MULT_HIGH, MULT_LOW = divmod(MULTIPLIER, 1 << 32)
MASK = (1 << 32) - 1


def _low_product(a: Column, b: int) -> Column:
    """The low 32 bits of a * b, both below 2**32."""
    low, high = a.bitwiseAND(0xFFFF), F.shiftright(a, 16)
    return (low * F.lit(b) + F.shiftleft((high * F.lit(b)).bitwiseAND(0xFFFF), 16)).bitwiseAND(MASK)


def _advance(high: Column, low: Column) -> tuple[Column, Column]:
    """Halves of state * MULTIPLIER + 1 modulo 2**64."""
    p0, p1 = low.bitwiseAND(0xFFFF) * F.lit(MULT_LOW), F.shiftright(low, 16) * F.lit(MULT_LOW)
    total = p0.bitwiseAND(MASK) + F.shiftleft(p1.bitwiseAND(0xFFFF), 16) + F.lit(1)
    carry = F.shiftright(total, 32) + F.shiftright(p0, 32) + F.shiftright(p1, 16)
    return (carry + _low_product(low, MULT_HIGH) + _low_product(high, MULT_LOW)).bitwiseAND(MASK), total.bitwiseAND(MASK)


def jump_shard(key: Column, shards: int) -> Column:
    """The shard, 0 to shards - 1, of an integer key; hash other keys to a bigint first."""
    if shards < 1:
        raise ValueError("at least one shard")
    key = F.coalesce(key.cast("bigint"), F.lit(0).cast("bigint"))

    def step(state: Column, _: Column) -> Column:
        high, low = _advance(state["high"], state["low"])
        draw = F.lit(float(1 << 31)) / (F.shiftright(high, 1) + 1).cast("double")
        after = F.floor((state["jump"] + 1).cast("double") * draw).cast("bigint")
        moved = F.struct(high.alias("high"), low.alias("low"), state["jump"].alias("at"), after.alias("jump"))
        return F.when(state["jump"] < shards, moved).otherwise(state)

    steps = min(shards + 1, 40 + 16 * math.ceil(math.log(shards + 1)))  # a key jumps about log(shards) times
    start = F.struct(F.shiftrightunsigned(key, 32).alias("high"), key.bitwiseAND(MASK).alias("low"), F.lit(-1).cast("bigint").alias("at"), F.lit(0).cast("bigint").alias("jump"))
    end = F.aggregate(F.sequence(F.lit(1), F.lit(steps)), start, step)
    return end["at"].cast("int") if steps == shards + 1 else F.when(end["jump"] < shards, F.raise_error(F.lit("too many jumps"))).otherwise(end["at"]).cast("int")


def assign_shards(docs: DataFrame, shards: int, key: str = "doc_id", text: str = "text", parts: int | None = None) -> DataFrame:
    """Per row: the key, size, text_crc32, law, shard, slot and grown_shard (with one shard more)."""
    column = F.col(f"`{key}`")
    number = column if dict(docs.dtypes)[key] in ("tinyint", "smallint", "int", "bigint") else F.when(column.isNotNull(), F.xxhash64(column))
    content = F.coalesce(F.col(f"`{text}`").cast("string"), F.lit(""))
    placed = docs.select(
        column.alias(key),
        (F.octet_length(content) + 8).cast("bigint").alias("size"),
        F.crc32(content.cast("binary")).alias("text_crc32"),
        F.lit("key").alias("law"),
        jump_shard(number, shards).alias("shard"),
        jump_shard(number, shards + 1).alias("grown_shard"),
    )
    tables = Tables(docs.sparkSession)
    rows = tables.write(placed.withColumn("__tie", F.monotonically_increasing_id()), "rows")
    slots = numbered(rows, ["shard"], [key, "text_crc32", "__tie"], tables, "slots", "slot", parts=parts)
    return slots.select(key, "size", "text_crc32", "law", "shard", "slot", "grown_shard")
