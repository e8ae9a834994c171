"""The end-to-end slice: event lines in, yearly forecast accuracy out."""
from __future__ import annotations

from pyspark.sql import functions as F

from priorlake.operators import evaluate as ev
from priorlake.plans.base import evaluation, query, rs, with_views


@query("flagship", with_views("evaluation", """
SELECT model, season, count(*) AS n_games, round(sqrt(avg(home_err * home_err)), 6) AS home_rmse,
       round(sqrt(avg(away_err * away_err)), 6) AS away_rmse, round(avg(abs(home_err)), 6) AS home_mae,
       round(avg(abs(away_err)), 6) AS away_mae
FROM evaluation GROUP BY model, season"""))
def flagship(spark, folder):
    out = ev.score(evaluation(spark, folder), ["model", "season"])
    return out.select("model", "season", "n_games", *rs("home_rmse", "away_rmse", "home_mae", "away_mae"))
