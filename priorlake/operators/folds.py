"""Rolling-origin evaluation without refitting on rows: folds meet prefix statistics."""
from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from priorlake.operators.prefix import prior_sums

MIN_TRAIN_ROWS = 50
EMPTY_PREDICTIONS = (
    "game_id string, season int, week int, home_score double, away_score double, home_pred double, away_pred double"
)


def cutoffs(contests: DataFrame, by: list[str] = ["season", "week"]) -> DataFrame:
    """One row per fold with its earliest contest day."""
    return contests.groupBy(*by).agg(F.min("t").alias("cutoff"))


def pin(df: DataFrame) -> DataFrame:
    """A small frame that feeds several later steps, computed once and kept on the executors; of any size."""
    kept = df.persist()
    kept.count()
    return kept


def fold_table(contests: DataFrame, burn_in: int = 2, min_rows: int = MIN_TRAIN_ROWS) -> DataFrame:
    """Folds after `burn_in` seasons with at least `min_rows` strictly earlier contests.

    Windows here run over one row per fold or per day, never over contests.
    """
    played = contests.filter(F.col("home_score").isNotNull() & F.col("away_score").isNotNull())
    seasons = played.select("season").distinct().withColumn("_nth", F.row_number().over(Window.orderBy("season")))
    before = prior_sums(played, [], "t", {"n_train": F.lit(1)})
    return (
        cutoffs(played)
        .join(seasons.filter(F.col("_nth") > burn_in).drop("_nth"), "season")
        .join(before.withColumnRenamed("t", "cutoff"), "cutoff")
        .filter(F.col("n_train") >= min_rows)
        .select("season", "week", "cutoff", F.col("n_train").cast("long").alias("n_train"))
    )


def training_sums(contests: DataFrame, folds: DataFrame, sums: dict[str, Column]) -> DataFrame:
    """Each sum over the rows strictly before each fold's cutoff (prefix sums by day)."""
    at = prior_sums(contests, [], "t", sums).withColumnRenamed("t", "cutoff")
    return folds.join(at, "cutoff")


def walk_forward(
    table: DataFrame,
    fit: Callable[[DataFrame], object],
    predict: Callable[[object, DataFrame], DataFrame],
    *,
    by: str = "season",
    burn_in: int = 2,
    min_rows: int = MIN_TRAIN_ROWS,
) -> DataFrame:
    """Refit an estimator per fold: train on rows strictly before it, predict its rows.

    For models without prefix statistics. The loop runs over
    the list of folds, whose length is bounded; rows stay distributed. `fit`
    takes a training frame, `predict` the fitted object and the fold's rows.
    """
    played = table.filter(F.col("home_score").isNotNull() & F.col("away_score").isNotNull())
    keys = ["season"] if by == "season" else ["season", "week"]
    per_fold = played.groupBy(*keys).agg(F.min("t").alias("cutoff"), F.count("*").alias("rows"))
    plan = [r.asDict() for r in per_fold.collect()]
    plan.sort(key=lambda f: tuple(f[k] for k in keys))
    seasons = sorted({f["season"] for f in plan})[burn_in:]
    out = None
    for fold in plan:
        if fold["season"] not in seasons:
            continue
        earlier = F.col("season") < fold["season"] if by == "season" else F.col("t") < fold["cutoff"]
        n_train = sum(f["rows"] for f in plan if (f["season"] < fold["season"] if by == "season" else f["cutoff"] < fold["cutoff"]))
        if n_train < min_rows:
            continue
        mine = F.lit(True)
        for k in keys:
            mine = mine & (F.col(k) == fold[k])
        part = predict(fit(played.filter(earlier)), played.filter(mine))
        out = part if out is None else out.unionByName(part)
    if out is None:
        return table.sparkSession.createDataFrame([], EMPTY_PREDICTIONS)
    return out


def leakage_audit(contests: DataFrame, used: DataFrame) -> DataFrame:
    """Per fold: what its training used beside what lies strictly before its cutoff, counted another way.

    used  season, week, cutoff, n_train, t_sum, last_day: rows, sum of days and newest day the fold's sums held.
    `leaks` is the number of rows too many (or too few, negative), and at least 1 where days differ or one is not
    strictly earlier.
    """
    listed = used.agg(F.collect_set("cutoff")).scalar()  # one entry per fold
    days = contests.groupBy("t").agg(F.count("*").alias("n")).withColumn("_f", listed)
    days = days.select("t", "n", F.explode(F.filter("_f", lambda c: c > F.col("t"))).alias("cutoff"))
    there = days.groupBy("cutoff").agg(F.sum("n").alias("_n"), F.sum(F.col("n") * F.col("t")).alias("_t"))
    c = F.col
    extra = c("n_train") - F.coalesce(c("_n"), F.lit(0))
    wrong = (c("t_sum") != F.coalesce(c("_t"), F.lit(0))) | (c("last_day") >= c("cutoff"))
    return used.join(there, "cutoff", "left").select(
        "season", "week", "cutoff", "n_train", "last_day", F.when(extra != 0, extra).when(wrong, 1).otherwise(0).cast("int").alias("leaks")
    )


def training_used(contests: DataFrame, folds: DataFrame) -> DataFrame:
    """What the prefix sums of every fold hold: the rows, days and newest day behind its training."""
    sums = training_sums(contests, folds.select("season", "week", "cutoff"), {"n_train": F.lit(1), "t_sum": F.col("t")})
    days = contests.groupBy("t").agg(F.lit(1).alias("one"))
    newest = days.withColumn("last_day", F.lag("t").over(Window.orderBy("t"))).select(F.col("t").alias("cutoff"), "last_day")  # one row per day
    return sums.join(newest, "cutoff")
