"""Closed-form forecasts: every fold's parameters come from prefix sums over days."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from priorlake.functions.scalars import safe_div
from priorlake.operators.folds import training_sums
from priorlake.operators.places import sums_before_places
from priorlake.operators.prefix import prior_sums

OVERTIME_WEIGHT = 0.5
DRIFT_ROWS = 285


def sample_weight(overtime: Column, weight: float = OVERTIME_WEIGHT) -> Column:
    """Past contests stretched by overtime count less when fitting."""
    return F.when(overtime == 1, F.lit(weight)).otherwise(F.lit(1.0))


def recency_weight(age_days: Column, halflife_days: float) -> Column:
    return F.pow(F.lit(0.5), age_days / F.lit(float(halflife_days)))


def rule_parameters(table: DataFrame, folds: DataFrame) -> DataFrame:
    """Per fold: league average, home edge and cold-start score from its training rows."""
    margin = F.col("home_score") - F.col("away_score")
    w = sample_weight(F.col("went_to_ot"))
    home_ground = F.col("is_neutral_site") == 0
    own, other = F.col("home_pregame_team_score"), F.col("away_pregame_team_score")
    sums = {
        "n": F.lit(1),
        "sum_home": F.col("home_score"),
        "sum_away": F.col("away_score"),
        "wm": F.when(home_ground, margin * w),
        "w": F.when(home_ground, w),
        "wm_all": margin * w,
        "w_all": w,
        "pre": F.coalesce(own, F.lit(0.0)) + F.coalesce(other, F.lit(0.0)),
        "pre_n": own.isNotNull().cast("int") + other.isNotNull().cast("int"),
    }
    c = F.col
    return training_sums(table, folds, sums).select(
        "season", "week", "cutoff", "n_train",
        ((c("sum_home") + c("sum_away")) / (2 * c("n"))).alias("league_avg"),
        F.coalesce(safe_div(c("wm"), c("w")), safe_div(c("wm_all"), c("w_all"))).alias("home_edge"),
        safe_div(c("pre"), c("pre_n")).alias("fallback"),
    )


PREDICTION_KEYS = ["game_id", "season", "week", "gameday", "t", "home_team", "away_team", "home_score", "away_score"]


def rule_predictions(table: DataFrame, parameters: DataFrame) -> DataFrame:
    """Long predictions: league average, half-own half-faced rule, and their mean."""
    c = F.col
    joined = table.join(parameters.select("season", "week", "league_avg", "home_edge", "fallback"), ["season", "week"])
    adj = c("home_edge") * (1 - c("is_neutral_site"))
    home = 0.5 * c("home_pregame_team_score") + 0.5 * c("away_pregame_opp_score") + adj / 2
    away = 0.5 * c("away_pregame_team_score") + 0.5 * c("home_pregame_opp_score") - adj / 2
    ruled = joined.withColumns(
        {"_h": F.coalesce(home, c("fallback") + adj / 2), "_a": F.coalesce(away, c("fallback") - adj / 2)}
    )
    item = lambda name, h, a: F.struct(F.lit(name).alias("model"), h.alias("home_pred"), a.alias("away_pred"))
    rows = F.explode(
        F.array(
            item("league_average", c("league_avg"), c("league_avg")),
            item("baseline", c("_h"), c("_a")),
            item("composite", (c("league_avg") + c("_h")) / 2, (c("league_avg") + c("_a")) / 2),
        )
    )
    return ruled.select(*PREDICTION_KEYS, rows.alias("_p")).select("_p.model", *PREDICTION_KEYS, "_p.home_pred", "_p.away_pred")


def recent_bias(predictions: DataFrame, folds: DataFrame, rows: int = DRIFT_ROWS) -> DataFrame:
    """Per (fold, model): mean error over its last `rows` earlier predictions, ties by id."""
    c = F.col
    errors = predictions.select(
        "model", "t", "game_id", (c("home_pred") - c("home_score")).alias("eh"), (c("away_pred") - c("away_score")).alias("ea")
    )
    counts = prior_sums(errors, ["model"], "t", {"n": F.lit(1)})
    ends = folds.select("season", "week", F.col("cutoff").alias("t")).join(counts, "t").filter("n > 0")
    edges = F.explode(F.array(
        F.struct(F.lit(1).alias("sign"), c("n").alias("place")), F.struct(F.lit(-1).alias("sign"), F.greatest(c("n") - rows, F.lit(0)).alias("place"))
    ))
    marks = ends.select("season", "week", "model", "n", edges.alias("m")).select("season", "week", "model", "n", "m.sign", "m.place")
    at = sums_before_places(errors, ["model"], "t", ["game_id"], marks, {"h": c("eh"), "a": c("ea")})
    used = F.least(F.max("n"), F.lit(rows))
    return at.groupBy("season", "week", "model").agg(
        used.cast("long").alias("rows"), (F.sum(c("sign") * c("h")) / used).alias("off_home"), (F.sum(c("sign") * c("a")) / used).alias("off_away")
    )
