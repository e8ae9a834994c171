"""Exact quantiles and quantile bins without gathering a group's values."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BUCKETS = 256


def exact_quantiles(df: DataFrame, keys: list[str], value: str, probs: list[float], buckets: int = BUCKETS) -> DataFrame:
    """(keys, prob, q): linearly interpolated quantiles, equal to sorting each group.

    Values are counted map-side. A sketch of each key's distinct values cuts them into about `buckets` ranges of like
    size, whatever their distribution; ranges are counted exactly, and only those that hold a wanted rank are
    sorted. A sketch merged in another order cuts elsewhere, so it is read in one place: a wanted range carries its first
    and last value and its first rank, and rows are chosen by these. A window sees one range of one key.
    """
    counts = df.filter(F.col(value).isNotNull()).groupBy(*keys, F.col(value).cast("double").alias("_v")).agg(F.count("*").alias("_n"))
    k = keys
    cuts = F.percentile_approx("_v", F.array(*[F.lit(i / buckets) for i in range(1, buckets)]), 10 * buckets) if buckets > 1 else F.array().cast("array<double>")
    limits = counts.groupBy(*k).agg(F.array_distinct(cuts).alias("_cuts"), F.sum("_n").alias("_total"))
    if keys:
        limited = counts.join(limits, k)
    else:
        one = limits.select(F.struct("_cuts", "_total")).scalar()
        limited = counts.withColumn("_lim", one).select("_v", "_n", "_lim.*")
    placed = limited.withColumn("_b", F.size(F.filter("_cuts", lambda c: c < F.col("_v")))).drop("_cuts")
    tops = (
        placed.groupBy(*k, "_b", "_total")
        .agg(F.sum("_n").alias("_m"), F.min("_v").alias("_low"), F.max("_v").alias("_high"))
        .withColumn("_end", F.sum("_m").over(Window.partitionBy(*k).orderBy("_b").rowsBetween(Window.unboundedPreceding, 0)))
        .withColumn("_start", F.col("_end") - F.col("_m"))
    )
    place = lambda p: (F.col("_total") - 1) * p["p"]
    wanted = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(float(p)).alias("p")) for i, p in enumerate(probs)])
    ranks = F.flatten(
        F.transform(
            wanted,
            lambda p: F.array(
                F.struct(p["i"].alias("i"), p["p"].alias("p"), F.floor(place(p)).cast("long").alias("rank"), F.lit(0).alias("side")),
                F.struct(p["i"].alias("i"), p["p"].alias("p"), F.ceil(place(p)).cast("long").alias("rank"), F.lit(1).alias("side")),
            ),
        )
    )
    mine = F.filter(ranks, lambda s: (s["rank"] >= F.col("_start")) & (s["rank"] < F.col("_end")))
    hot = tops.withColumn("_r", mine).filter(F.size("_r") > 0).groupBy(*k).agg(
        F.collect_list(F.struct("_low", "_high", "_start", "_total", "_r")).alias("_hot")  # two for each probability at most
    )
    near = counts.join(hot, k) if keys else counts.withColumn("_hot", hot.select("_hot").scalar())
    inside = Window.partitionBy(*k, "_start").orderBy("_v").rowsBetween(Window.unboundedPreceding, 0)
    found = (
        near.select(*k, "_v", "_n", F.explode(F.filter("_hot", lambda h: (h["_low"] <= F.col("_v")) & (F.col("_v") <= h["_high"]))).alias("_h"))
        .select(*k, "_v", "_n", "_h.*")
        .withColumn("_cum", F.col("_start") + F.sum("_n").over(inside))
        .withColumn("_hit", F.filter("_r", lambda s: (s["rank"] < F.col("_cum")) & (s["rank"] >= F.col("_cum") - F.col("_n"))))
        .select(*k, "_v", "_total", F.explode("_hit").alias("_h"))
    )
    low = F.max(F.when(F.col("_h.side") == 0, F.col("_v")))
    high = F.max(F.when(F.col("_h.side") == 1, F.col("_v")))
    pos = (F.first("_total") - 1) * F.first("_h.p")
    return found.groupBy(*k, F.col("_h.i").alias("_i")).agg(
        F.first("_h.p").alias("prob"), (low + (high - low) * (pos - F.floor(pos))).alias("q")
    ).drop("_i")


def quantile_edges(df: DataFrame, keys: list[str], value: str, bins: int) -> DataFrame:
    """(keys, edges): sorted array of the bins + 1 quantile edges."""
    probs = [i / bins for i in range(bins + 1)]
    return exact_quantiles(df, keys, value, probs).groupBy(*keys).agg(F.array_sort(F.collect_list("q")).alias("edges"))


def bin_of(value: Column, edges: Column) -> Column:
    """Right-closed quantile bin; repeated edges collapse, the lowest value falls in bin 0."""
    below = F.size(F.filter(F.array_distinct(edges), lambda e: e < value))
    return F.greatest(below - 1, F.lit(0))


def reliability(df: DataFrame, keys: list[str], pred: str, actual: str, bins: int) -> DataFrame:
    """Count, mean forecast, mean result and gap per forecast quantile bin."""
    if keys:
        binned = df.join(quantile_edges(df, keys, pred, bins), keys)
    else:
        binned = df.withColumn("edges", quantile_edges(df, [], pred, bins).select("edges").scalar())
    return (
        binned.withColumn("bin", bin_of(F.col(pred), F.col("edges")))
        .groupBy(*keys, "bin")
        .agg(F.count("*").alias("n"), F.avg(pred).alias("mean_pred"), F.avg(actual).alias("mean_actual"))
        .withColumn("gap", F.col("mean_pred") - F.col("mean_actual"))
    )
