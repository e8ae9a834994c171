"""Sharding by jump consistent hashing: a stable key and the number of shards alone decide; there is no ring table.

A key walks up a sequence of shard counts at which it would move, drawn from a linear congruential generator seeded by
the key; its shard is the last stop below the count. Appending a shard lengthens the walk by one step at most, so a row
either stays or moves into the new shard, and a share of 1/(n + 1) moves. DataFrame functions only.

The shard is an expression over doc_id: texts are read once for their size and checksum, and nothing as wide as a text is
shuffled. Places inside shards come from a range partitioning of narrow rows over (shard, key, text, row), which cuts a shard, and
even a key with a third of all rows, into as many tasks as its rows ask for.

Defined cases: a null doc_id counts as the empty string, so rows without an id share a shard; null texts have 0 bytes and
checksum 0; rows that repeat an id share its shard and get places of their own; an empty table gives no rows; other
columns of documents, whatever their names, are not read (write_shards carries them).
"""
from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from priorlake.llm.shared import numbered, stored

SHARDS, OVERHEAD = 40, 16
# Fixed value: the generator's factor in the published algorithm (its addend is 1), state modulo 2^64.
FACTOR = 2862933555777941757
LOW, HALF = (1 << 32) - 1, (1 << 16) - 1


def key_halves(key: Column) -> tuple[Column, Column]:
    """The upper and lower 32 bits of a 64-bit key: the first 16 hex digits of the MD5 of the key as text."""
    digest = F.md5(F.coalesce(key.cast("string"), F.lit("")))
    return tuple(F.conv(F.substring(digest, at, 8), 16, 10).cast("long") for at in (1, 9))


def _next(hi: Column, lo: Column) -> tuple[Column, Column]:
    """The generator's next state in halves; every product and sum stays below 2^63, where Spark would refuse to wrap."""
    factor_hi, factor_lo = FACTOR >> 32, FACTOR & LOW
    upper = F.shiftright(lo, 16) * factor_lo
    low = lo.bitwiseAND(HALF) * factor_lo + F.shiftleft(upper.bitwiseAND(HALF), 16) + 1
    high = F.shiftright(low, 32) + F.shiftright(upper, 16) + (lo * factor_hi).bitwiseAND(LOW)
    high = high + hi.bitwiseAND(HALF) * factor_lo + F.shiftleft((F.shiftright(hi, 16) * factor_lo).bitwiseAND(HALF), 16)
    return high.bitwiseAND(LOW), low.bitwiseAND(LOW)


def jump(hi: Column, lo: Column, shards: int) -> Column:
    """Struct (last, before): the key's last stop below `shards` and the stop before it (-1: none).

    A walk takes about ln(shards) steps. Three times that many and some more are taken for all rows; the few rows that are not done take as
    many as there are shards, which is the most a walk can have.
    """
    def stop(s: Column) -> Column:
        return F.floor((s["last"] + 1).cast("double") * (F.lit(float(1 << 31)) / (F.shiftright(s["hi"], 1) + 1).cast("double")))

    def step(s: Column, _: Column) -> Column:
        up, down = _next(s["hi"], s["lo"])
        moved = F.struct(up.alias("hi"), down.alias("lo"), stop(s).alias("last"), s["last"].alias("before"))
        return F.when(stop(s) < shards, moved).otherwise(s)

    up, down = _next(hi.cast("long"), lo.cast("long"))
    start = F.struct(up.alias("hi"), down.alias("lo"), F.lit(0).cast("long").alias("last"), F.lit(-1).cast("long").alias("before"))
    few = min(shards, 4 + math.ceil(3 * math.log(shards))) if shards > 1 else 0
    if not few:
        return start
    walked = F.aggregate(F.sequence(F.lit(1), F.lit(few)), start, step)
    rest = lambda s: F.when(stop(s) < shards, F.aggregate(F.sequence(F.lit(1), F.lit(shards)), s, step)).otherwise(s)
    return F.transform(F.array(walked), rest)[0]


def shard_columns(key: Column, shards: int = SHARDS) -> Column:
    """Struct (shard, grown): the key's shard of `shards`, and of one shard more. One walk gives both."""
    walk = jump(*key_halves(key), shards + 1)
    both = lambda s: F.struct(
        F.when(s["last"] == shards, s["before"]).otherwise(s["last"]).cast("int").alias("shard"), s["last"].cast("int").alias("grown")
    )
    return F.transform(F.array(walk), both)[0]


def sharded(docs: DataFrame, shards: int = SHARDS, overhead: int = OVERHEAD) -> DataFrame:
    """One row per document: doc_id, size, text_crc32, law, shard, slot (places from 0 in the shard), grown_shard."""
    if shards < 1:
        raise ValueError("there must be a shard")
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(
        "doc_id", (F.octet_length(text).cast("long") + overhead).alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"),
        shard_columns(F.col("doc_id"), shards).alias("_s"), F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))).alias("_key"),
        F.monotonically_increasing_id().alias("_row"),
    )
    rows = stored(rows.select("doc_id", "size", "text_crc32", F.col("_s.shard").alias("shard"), F.col("_s.grown").alias("grown_shard"), "_key", "_row"), "shards")
    out = numbered(rows, ["shard"], ["_key", "text_crc32", "size", "_row"], "slots", "slot")
    return out.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard")


def write_shards(docs: DataFrame, path: str, shards: int = SHARDS, files: int = 8) -> None:
    """docs as Parquet under path/shard=k, all columns carried; each shard is cut into about `files` files by text and id.

    A column of documents named shard gives way to the shard's number.
    """
    rows = docs.withColumn("shard", shard_columns(F.col("doc_id"), shards)["shard"])
    part = F.pmod(F.xxhash64(F.col("doc_id"), F.col("text")), F.lit(files))
    rows.repartition(shards * files, "shard", part).write.partitionBy("shard").parquet(path)


SQL = f"""with recursive
docs as (select row_number() over () as r, doc_id, coalesce(text, '') as t, md5(coalesce(doc_id::varchar, '')) as k from documents),
crc_step as (
  select list_transform(range(256), lambda i: list_reduce(list_prepend(i::ubigint, list_transform(range(8), lambda b: 0::ubigint)),
         lambda x, b: case when x & 1 = 1 then xor(x >> 1, 3988292384::ubigint) else x >> 1 end)) as step),
sized as (
  select r, doc_id, k, octet_length(encode(t)) + {OVERHEAD} as size,
         xor(list_reduce(list_prepend(4294967295::ubigint, list_transform(regexp_extract_all(hex(encode(t)), '..'), lambda h: ('0x' || h)::ubigint)),
             lambda c, b: xor(step[(xor(c, b) & 255)::bigint + 1], c >> 8)), 4294967295::ubigint)::bigint as text_crc32
  from docs, crc_step),
walk as (
  select r, (('0x' || substr(k, 1, 8))::bigint::hugeint * 4294967296 + ('0x' || substr(k, 9, 8))::bigint) as key, -1::bigint as last, -1::bigint as before, 0::bigint as stop
  from docs
  union all
  select r, moved, stop, last, floor((stop + 1) * (2147483648.0::double / ((moved // 8589934592) + 1)::double))::bigint
  from (select r, stop, last, (key * {FACTOR} + 1) % 18446744073709551616::hugeint as moved from walk where stop < {SHARDS + 1})),
ends as (select r, last, before from walk where stop >= {SHARDS + 1}),
placed as (
  select s.*, case when last = {SHARDS} then before else last end::int as shard, last::int as grown_shard
  from sized s join ends using (r))
select doc_id, size, text_crc32, 'key' as law, shard,
       row_number() over (partition by shard order by k, text_crc32, size) - 1 as slot, grown_shard
from placed"""
