"""Strictly-earlier building blocks that never gather one key's history in a task.

Every operator here works in two levels. A key's timeline is cut into blocks
(`block` maps the ordering column to a block number); windows run inside
(key, block), and a second window runs over the per-block summaries, whose
count is bounded by span / block width. A key that holds a third of all rows is
therefore spread over its blocks. Without `block` the caller states that the
number of distinct times per key is already bounded (dates, months, folds).
"""
from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

Block = Callable[[Column], Column]

BLOCK = "_block"
FIRST = Window.unboundedPreceding


def by_width(width: int) -> Block:
    """Blocks of a fixed width over an integer ordering column."""
    return lambda t: F.floor(t / F.lit(width)).cast("long")


MICROS_PER_DAY = 86_400_000_000
day_blocks = by_width(MICROS_PER_DAY)


def prior_sums(
    df: DataFrame,
    keys: list[str],
    t: str,
    sums: dict[str, Column],
    *,
    block: Block | None = None,
    inclusive: bool = False,
) -> DataFrame:
    """One row per (keys, t) with each sum taken over strictly earlier times.

    Rows are first folded to one per (keys, t), so ties never see each other and
    the fold combines map-side. An empty history sums to 0. `inclusive` admits
    the row's own time.
    """
    per_time = df.groupBy(*keys, t).agg(*[F.sum(c).alias(n) for n, c in sums.items()])
    last = Window.currentRow if inclusive else -1
    if block is None:
        over = Window.partitionBy(*keys).orderBy(t).rowsBetween(FIRST, last)
        return per_time.select(
            *keys, t, *[F.coalesce(F.sum(n).over(over), F.lit(0)).alias(n) for n in sums]
        )
    per_time = per_time.withColumn(BLOCK, block(F.col(t)))
    inside = Window.partitionBy(*keys, BLOCK).orderBy(t).rowsBetween(FIRST, last)
    over_blocks = Window.partitionBy(*keys).orderBy(BLOCK).rowsBetween(FIRST, -1)
    carry = (
        per_time.groupBy(*keys, BLOCK)
        .agg(*[F.sum(n).alias(n) for n in sums])
        .select(*keys, BLOCK, *[F.sum(n).over(over_blocks).alias(f"_c_{n}") for n in sums])
    )
    local = per_time.select(*keys, t, BLOCK, *[F.sum(n).over(inside).alias(n) for n in sums])
    return local.join(carry, [*keys, BLOCK]).select(
        *keys,
        t,
        *[
            (F.coalesce(F.col(n), F.lit(0)) + F.coalesce(F.col(f"_c_{n}"), F.lit(0))).alias(n)
            for n in sums
        ],
    )


def position(df: DataFrame, keys: list[str], t: str, tie: list[str], name: str, *, block: Block | None = None) -> DataFrame:
    """Zero-based chronological position within `keys`, ties ordered by `tie`.

    The count of strictly earlier rows comes from `prior_sums`; only rows that
    share one exact time are numbered by a window.
    """
    before = prior_sums(df, keys, t, {"_before": F.lit(1)}, block=block)
    same_time = Window.partitionBy(*keys, t).orderBy(*tie)
    return (
        df.join(before, [*keys, t])
        .withColumn(name, (F.col("_before") + F.row_number().over(same_time) - 1).cast("long"))
        .drop("_before")
    )


def asof_prior(
    left: DataFrame,
    right: DataFrame,
    keys: list[str],
    t: str,
    values: list[str],
    *,
    block: Block = day_blocks,
) -> DataFrame:
    """Left rows with `values` from the latest right row at a strictly earlier `t`.

    `t` is an integer (micros or days) on both sides. Of right rows that share a
    time the largest value tuple counts.
    """
    payload = F.struct(*[F.col(c) for c in left.columns])
    versions = right.groupBy(*keys, t).agg(F.max(F.struct(*values)).alias("_v"))
    lookups = left.select(*keys, t, payload.alias("_row"))
    both = lookups.unionByName(versions, allowMissingColumns=True).withColumn(BLOCK, block(F.col(t)))
    inside = Window.partitionBy(*keys, BLOCK).orderBy(t).rangeBetween(FIRST, -1)
    over_blocks = Window.partitionBy(*keys).orderBy(BLOCK).rowsBetween(FIRST, -1)
    carry = (
        both.select(*keys, BLOCK, t, "_v")
        .groupBy(*keys, BLOCK)
        .agg(F.max(F.when(F.col("_v").isNotNull(), F.struct(t, "_v"))).alias("_latest"))
        .select(*keys, BLOCK, F.last(F.col("_latest._v"), ignorenulls=True).over(over_blocks).alias("_carry"))
    )
    found = (
        both.withColumn("_hit", F.last("_v", ignorenulls=True).over(inside))
        .filter(F.col("_row").isNotNull())
        .join(carry, [*keys, BLOCK])
        .withColumn("_hit", F.coalesce("_hit", "_carry"))
    )
    return found.select("_row.*", *[F.col("_hit")[v].alias(v) for v in values])


def neighbour(
    df: DataFrame,
    keys: list[str],
    order: list[str],
    values: dict[str, str],
    *,
    step: int,
    block: Column | None = None,
) -> DataFrame:
    """Add `values` (new name -> column) of the previous (-1) or next (+1) row.

    `order` must be a total order. `block` is any column expression that does
    not decrease along `order`.
    """
    if step not in (-1, 1):
        raise ValueError("step must be -1 or 1")
    shift = F.lag if step < 0 else F.lead
    picked = F.struct(*[F.col(c).alias(n) for n, c in values.items()])
    if block is None:
        over = Window.partitionBy(*keys).orderBy(*order)
        out = df.withColumn("_near", shift(picked).over(over))
    else:
        ranked = df.withColumn(BLOCK, block)
        over = Window.partitionBy(*keys, BLOCK).orderBy(*order)
        edge = F.max_by if step < 0 else F.min_by
        blocks = ranked.groupBy(*keys, BLOCK).agg(edge(picked, F.struct(*order)).alias("_edge"))
        carry = blocks.select(
            *keys, BLOCK, shift("_edge").over(Window.partitionBy(*keys).orderBy(BLOCK)).alias("_edge")
        )
        out = (
            ranked.withColumn("_near", shift(picked).over(over))
            .join(carry, [*keys, BLOCK])
            .withColumn("_near", F.coalesce("_near", "_edge"))
            .drop("_edge", BLOCK)
        )
    return out.select("*", *[F.col("_near")[n].alias(n) for n in values]).drop("_near")


def recent_rows(
    df: DataFrame,
    keys: list[str],
    order: list[str],
    values: list[str],
    length: int,
    name: str,
    *,
    block: Column | None = None,
) -> DataFrame:
    """Add an array of the last `length` rows strictly before each row, oldest first.

    With `block`, at most `length` rows per block are carried forward, and the
    carry looks back over at most `length` non-empty blocks.
    """
    item = F.struct(*values)
    if block is None:
        over = Window.partitionBy(*keys).orderBy(*order).rowsBetween(-length, -1)
        return df.withColumn(name, F.collect_list(item).over(over))
    ranked = df.withColumn(BLOCK, block)
    inside = Window.partitionBy(*keys, BLOCK).orderBy(*order).rowsBetween(-length, -1)
    newest = Window.partitionBy(*keys, BLOCK).orderBy(*[F.col(c).desc() for c in order])
    tails = (
        ranked.withColumn("_n", F.row_number().over(newest))
        .filter(F.col("_n") <= length)
        .groupBy(*keys, BLOCK)
        .agg(F.sort_array(F.collect_list(F.struct((-F.col("_n")).alias("_n"), item.alias("_i")))).alias("_tail"))
    )
    back = Window.partitionBy(*keys).orderBy(BLOCK).rowsBetween(-length, -1)
    carry = tails.select(
        *keys,
        BLOCK,
        F.transform(F.flatten(F.collect_list("_tail").over(back)), lambda s: s["_i"]).alias("_carry"),
    )
    joined = ranked.withColumn(name, F.collect_list(item).over(inside)).join(carry, [*keys, BLOCK])
    return joined.withColumn(
        name,
        F.when(F.size(name) >= length, F.col(name)).otherwise(_last(F.concat("_carry", name), length)),
    ).drop("_carry", BLOCK)


def _last(items: Column, length: int) -> Column:
    kept = F.least(F.size(items), F.lit(length))
    return F.when(kept == 0, items).otherwise(F.slice(items, F.size(items) - kept + 1, F.greatest(kept, F.lit(1))))
