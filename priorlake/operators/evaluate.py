"""Accuracy, calibration and market tables over long predictions (model, contest)."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from priorlake.functions.scalars import block_id, safe_div


def with_errors(predictions: DataFrame) -> DataFrame:
    """Signed errors (prediction minus result) and the resampling block."""
    c = F.col
    return predictions.select(
        "*",
        (c("home_pred") - c("home_score")).alias("home_err"),
        (c("away_pred") - c("away_score")).alias("away_err"),
        (c("home_pred") - c("home_score") + c("away_pred") - c("away_score")).alias("total_err"),
        ((c("home_pred") - c("away_pred")) - (c("home_score") - c("away_score"))).alias("margin_err"),
        block_id(c("season"), c("week")).alias("block"),
    )


def rmse(e: Column) -> Column:
    return F.sqrt(F.avg(e * e))


def pooled(h: Column, a: Column, fn=lambda e: e * e) -> Column:
    """Mean of `fn` over both sides' errors of every contest."""
    return F.avg((fn(h) + fn(a)) / 2)


def pooled_slope() -> Column:
    """Slope of results on forecasts over both sides, from sums of one pass."""
    p = lambda f: F.sum(f("home") + f("away"))
    n = 2 * F.count("*")
    pred, actual = (lambda s: F.col(f"{s}_pred")), (lambda s: F.col(f"{s}_score"))
    sp, sa = p(pred), p(actual)
    cov = p(lambda s: pred(s) * actual(s)) - sp * sa / n
    var = p(lambda s: pred(s) * pred(s)) - sp * sp / n
    return safe_div(cov, var)


def score(predictions: DataFrame, by: list[str]) -> DataFrame:
    """RMSE and MAE per side."""
    h, a = F.col("home_err"), F.col("away_err")
    return predictions.groupBy(*by).agg(
        rmse(h).alias("home_rmse"), rmse(a).alias("away_rmse"),
        F.avg(F.abs(h)).alias("home_mae"), F.avg(F.abs(a)).alias("away_mae"),
        F.count("*").alias("n_games"),
    )


def unpivot_targets(ev: DataFrame, targets: list[str], keep: list[str]) -> DataFrame:
    """One row per (row, target) with its error: a narrow explode, no shuffle."""
    items = F.array(*[F.struct(F.lit(t).alias("target"), F.col(f"{t}_err").alias("err")) for t in targets])
    return ev.select(*keep, F.explode(items).alias("_x")).select(*keep, "_x.target", "_x.err")


def hit(pred: Column, actual: Column, line: Column) -> Column:
    """Whether forecast and result fall on the same side of a line."""
    return ((pred > line) == (actual > line)).cast("int")


def winner_share(pred_margin: Column, true_margin: Column) -> Column:
    return F.avg(F.when(true_margin != 0, hit(pred_margin, true_margin, F.lit(0.0))))


def calibration_moments(actual: Column, pred: Column) -> tuple[Column, Column]:
    return F.regr_slope(actual, pred), F.regr_intercept(actual, pred)


def record(n_win: Column, n_live: Column, n_push: Column) -> list[Column]:
    """Wins, losses, pushes, rate and return at -110; pushes leave the denominator."""
    losses = n_live - n_win
    return [
        n_live.alias("n"), n_win.alias("wins"), losses.alias("losses"), n_push.alias("pushes"),
        safe_div(n_win, n_live).alias("rate"),
        safe_div(n_win * F.lit(100.0 / 110.0) - losses, n_live).alias("roi"),
    ]


def line_record(pred: Column, actual: Column, line: Column) -> list[Column]:
    live = actual != line
    wins = F.count_if(live & ((pred > line) == (actual > line)))
    return record(wins, F.count_if(live), F.count_if(actual == line))


def leaderboard_rank(table: DataFrame, metric: str, unranked: list[str]) -> DataFrame:
    """Rank by metric; members of `unranked` (own contests only) follow without a rank."""
    ranked = table.filter(~F.col("model").isin(*unranked)).withColumn(
        "rank", F.row_number().over(Window.orderBy(metric, "model"))
    )
    return ranked.unionByName(table.filter(F.col("model").isin(*unranked)).withColumn("rank", F.lit(None).cast("int")))


def common_contests(predictions: DataFrame, models: list[str]) -> DataFrame:
    """Predictions on contests that every listed model predicted."""
    shared = (
        predictions.filter(F.col("model").isin(*models))
        .groupBy("game_id")
        .agg(F.count_distinct("model").alias("_n"))
        .filter(F.col("_n") == len(models))
        .select("game_id")
    )
    return predictions.join(shared, "game_id", "left_semi")
