"""Sums over the first n rows of a timeline, for many n at once.

Time-ordered splits and "the last k rows" cut a timeline between rows that may
share a time. Each row gets the number of cut places at or before it; rows are
folded to one sum per stretch between cuts; prefix sums over the stretches, of
which there are at most as many as cuts, answer every cut.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from priorlake.operators.prefix import prior_sums

SEGMENT = "_segment"


def cut_places(marks: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, _cuts): the sorted distinct places per key. The number of marks is bounded by folds."""
    return marks.groupBy(*keys).agg(F.array_sort(F.collect_set(F.col("place").cast("long"))).alias("_cuts"))


def with_segments(df: DataFrame, keys: list[str], t: str, tie: list[str], cuts: DataFrame) -> DataFrame:
    """`df` plus its segment: how many cuts lie at or before the row's place.

    Cuts are compared once per (key, time); only those falling inside a time
    with several rows are compared per row.
    """
    counts = df.groupBy(*keys, t).agg(F.count("*").alias("_rows"))
    first = prior_sums(df, keys, t, {"_first": F.lit(1)})
    days = counts.join(first, [*keys, t]).join(cuts, keys) if keys else counts.join(first, [t]).withColumn("_cuts", cuts.select("_cuts").scalar())
    end = F.col("_first") + F.col("_rows")
    days = days.select(
        *keys, t, "_first",
        F.size(F.filter("_cuts", lambda c: c <= F.col("_first"))).alias("_base"),
        F.filter("_cuts", lambda c: (c > F.col("_first")) & (c < end)).alias("_inner"),
    )
    nth = F.row_number().over(Window.partitionBy(*keys, t).orderBy(*tie)) - 1
    return (
        df.join(days, [*keys, t])
        .withColumn("_place", F.col("_first") + nth)
        .withColumn(SEGMENT, F.col("_base") + F.size(F.filter("_inner", lambda c: c <= F.col("_place"))))
        .drop("_first", "_base", "_inner")
    )


def segment_of(marks: DataFrame, keys: list[str], cuts: DataFrame) -> DataFrame:
    """Marks plus `_upto`: rows before a mark are those in segments below this number."""
    joined = marks.join(cuts, keys) if keys else marks.withColumn("_cuts", cuts.select("_cuts").scalar())
    return joined.withColumn("_upto", F.array_position("_cuts", F.col("place").cast("long")).cast("int")).drop("_cuts")


def sums_before_places(df: DataFrame, keys: list[str], t: str, tie: list[str], marks: DataFrame, sums: dict[str, Column]) -> DataFrame:
    """Every mark (keys, place, ...) with each sum over the first `place` rows of its key."""
    cuts = cut_places(marks, keys)
    folded = with_segments(df, keys, t, tie, cuts).groupBy(*keys, SEGMENT).agg(*[F.sum(c).alias(n) for n, c in sums.items()])
    asked = segment_of(marks, keys, cuts)
    # a mark with no row in the stretch just below it still needs the sum up to there
    asked_rows = asked.select(*keys, F.col("_upto").alias(SEGMENT)).distinct()
    both = folded.unionByName(asked_rows, allowMissingColumns=True).groupBy(*keys, SEGMENT).agg(*[F.sum(n).alias(n) for n in sums])
    over = Window.partitionBy(*keys).orderBy(SEGMENT).rowsBetween(Window.unboundedPreceding, -1)
    prefix = both.select(*keys, F.col(SEGMENT).alias("_upto"), *[F.coalesce(F.sum(n).over(over), F.lit(0.0)).alias(n) for n in sums])
    return asked.join(prefix, [*keys, "_upto"]).drop("_upto")
