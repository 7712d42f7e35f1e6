"""Jump consistent hashing (Lamping and Veach, 2014) in DataFrame functions alone."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import running_total

# Fixed values of the published algorithm: its linear congruential step is key * 2862933555777941757 + 1 modulo 2^64.
MULTIPLIER = 2862933555777941757
#: Turns of one loop of steps.
STEPS = 16
_LOW, _HIGH, _MASK = MULTIPLIER & 0xFFFFFFFF, MULTIPLIER >> 32, 0xFFFFFFFF


def _times_low(x: Column) -> tuple[Column, Column]:
    """x (32 bits) times the multiplier's low half: its value modulo 2^48 and the rest over 2^32, without signed overflow."""
    upper = F.shiftright(x, 16) * F.lit(_LOW)
    return x.bitwiseAND(0xFFFF) * F.lit(_LOW) + F.shiftleft(upper.bitwiseAND(0xFFFF), 16), F.shiftright(upper, 16)


def jump_hash(key: Column, shards: int) -> Column:
    """The shard, 0 to shards - 1, of a 64-bit key; null for a null key.

    A key's jumps only grow, so at most ``shards`` steps are needed, of about ln(shards) on average. Steps are nested in loops of STEPS
    turns each: once a key has landed, an outer turn skips all those inside it, so that 10 000 shards take some dozens of turns. The
    64-bit state is held as two 32-bit halves: products then stay within a long, also under ANSI overflow checks.
    """
    if shards < 1:
        raise ValueError("shards must be 1 at least")
    key = key.cast("long")
    start = F.struct(
        key.bitwiseAND(F.lit(_MASK)).alias("lo"), F.shiftrightunsigned(key, 32).alias("hi"), F.lit(-1).cast("long").alias("at"), F.lit(0).cast("long").alias("to")
    )

    def step(s: Column, _: Column) -> Column:
        value, over = _times_low(s["lo"])
        value = value + F.lit(1)
        lo = value.bitwiseAND(F.lit(_MASK))
        hi = (F.shiftright(value, 32) + over + s["lo"] * F.lit(_HIGH) + _times_low(s["hi"])[0].bitwiseAND(F.lit(_MASK))).bitwiseAND(F.lit(_MASK))
        to = F.floor((s["to"] + 1).cast("double") * (F.lit(2147483648.0) / (F.shiftright(hi, 1) + 1).cast("double"))).cast("long")
        return F.struct(lo.alias("lo"), hi.alias("hi"), s["to"].alias("at"), to.alias("to"))

    def loop(s: Column, inner: Callable[[Column, Column], Column], turns: int) -> Column:
        return F.aggregate(F.sequence(F.lit(1), F.lit(turns)), s, lambda t, _: F.when(t["to"] < shards, inner(t, _)).otherwise(t))

    inner, reach = step, 1
    while reach * STEPS < shards:
        inner, reach = (lambda s, _, inner=inner: loop(s, inner, STEPS)), reach * STEPS
    return F.when(key.isNotNull(), loop(start, inner, -(-shards // reach))["at"].cast("int"))


def assign_shards(df: DataFrame, key: str, shards: int, grown: int | None = None, order: list[str] | None = None, buckets: int | None = None) -> DataFrame:
    """df with shard, slot (its place in the shard, gapless from 0) and, if grown is given, grown_shard for that shard count.

    The key decides the shard: an integer key as it is, any other by its xxhash64. Rows with a null key go to shard 0, also when
    grown. Rows with equal keys share a shard and, in a slot's order, stand by ``order``; rows that are equal there get distinct slots
    in no fixed order. Slots follow (bucket of a hash, key, *order): a shard is ranked in ``buckets`` parts, by default as many as the rows
    ask for, so none is ranked by one task.
    Empty tables stay empty. Columns of df named as results are replaced.
    """
    kind = dict(df.dtypes)[key]
    number = F.col(key).cast("long") if kind in ("tinyint", "smallint", "int", "bigint") else F.when(F.col(key).isNotNull(), F.xxhash64(F.col(key)))
    df = df.withColumn("shard", F.coalesce(jump_hash(number, shards), F.lit(0)))
    df = df.withColumn("grown_shard", F.coalesce(jump_hash(number, grown), F.lit(0)) if grown else F.lit(None).cast("int"))
    return running_total(df, ["shard"], [key, *(order or [])], F.lit(1), "slot", buckets)


def op1(docs: DataFrame, shards: int = 16) -> DataFrame:
    """Documents in 16 shards by doc_id. A null text counts as empty: size 1, text_crc32 0."""
    whole = docs.select(
        "doc_id",
        (F.coalesce(F.octet_length("text"), F.lit(0)) + 1).cast("long").alias("size"),
        F.crc32(F.encode(F.coalesce("text", F.lit("")), "UTF-8")).alias("text_crc32"),
        F.lit("key").alias("law"),
    )
    return assign_shards(whole, "doc_id", shards, shards + 1, ["text_crc32", "size"]).select("doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard")
