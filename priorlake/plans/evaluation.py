"""Evaluation (section J): accuracy, intervals, calibration, market and ensembles."""
from __future__ import annotations

from pyspark.sql import functions as F

from priorlake.functions import scalars as sc
from priorlake.operators import bootstrap as bs
from priorlake.operators import evaluate as ev
from priorlake.operators import folds, quantiles, temporal
from priorlake.operators.prefix import prior_sums
from priorlake.plans import base
from priorlake.plans.base import query, r, rs, view, with_views

REPS = bs.REPLICATES
MODELS = ["league_average", "baseline", "composite"]


def boot_sql(name: str, source: str, by: str, block: str, sums: dict[str, str], reps: int = REPS) -> str:
    """CTEs `<name>_b` (block sums) and `<name>_r` (replicates) mirroring the bootstrap."""
    by_list = f"{by}, " if by else ""
    part = f"PARTITION BY {by}" if by else ""
    cols = ", ".join(f"sum({e}) AS {n}" for n, e in sums.items())
    tot = ", ".join(f"sum(b.{n}) AS {n}" for n in sums)
    on = " AND ".join([f"b.{k.strip()} = d.{k.strip()}" for k in by.split(",")] if by else ["true"])
    qual = ", ".join(f"d.{k.strip()}" for k in by.split(",")) if by else ""
    return f"""
{name}_b AS (SELECT *, row_number() OVER ({part} ORDER BY {block}) - 1 AS k, count(*) OVER ({part}) AS n_blocks
             FROM (SELECT {by_list}{block}, {cols} FROM {source} GROUP BY ALL)),
{name}_d AS (SELECT {by_list}rep, CAST('0x' || substr(md5('42|' || rep || '|' || k), 1, 8) AS BIGINT) % n_blocks AS k
             FROM {name}_b CROSS JOIN (SELECT unnest(range(0, {reps})) AS rep)),
{name}_r AS (SELECT {qual + ', ' if by else ''}d.rep, {tot} FROM {name}_d d JOIN {name}_b b ON {on} AND b.k = d.k GROUP BY ALL)"""


_Q = "quantile_cont({e}, 0.025)", "quantile_cont({e}, 0.975)"


def lo_hi(expr: str, name: str, digits: int = 6) -> str:
    return f"round({_Q[0].format(e=expr)}, {digits}) AS {name}_lo, round({_Q[1].format(e=expr)}, {digits}) AS {name}_hi"


def evaluation(spark, folder):
    return base.evaluation(spark, folder)


@query("j1_walk_forward", with_views("preds", """
SELECT model, game_id, season, week, round(home_pred, 6) AS home_pred, round(away_pred, 6) AS away_pred FROM preds"""))
def walk_forward(spark, folder):
    return base.predictions(spark, folder).select("model", "game_id", "season", "week", *rs("home_pred", "away_pred"))


@query("j2_season_refit", with_views("model_table", """
WITH s AS (SELECT season, (SELECT avg(home_score) FROM model_table x WHERE x.season < m.season) AS h, (SELECT avg(away_score) FROM model_table x WHERE x.season < m.season) AS a
  FROM (SELECT DISTINCT season FROM model_table) m WHERE season >= (SELECT min(season) + 2 FROM model_table))
SELECT game_id, round((h + a) / 2, 6) AS home_pred, round((h + a) / 2, 6) AS away_pred FROM model_table JOIN s USING (season)"""))
def season_refit(spark, folder):
    """The generic loop over folds, here with the league average as its estimator."""

    def fit(train):
        row = train.agg(F.avg("home_score").alias("h"), F.avg("away_score").alias("a")).first()
        return (row["h"] + row["a"]) / 2

    def predict(average, test):
        return test.select("game_id", F.lit(average).alias("home_pred"), F.lit(average).alias("away_pred"))

    out = folds.walk_forward(base.model_table(spark, folder), fit, predict, by="season")
    return out.select("game_id", *rs("home_pred", "away_pred"))


@query("j3_empty_result_shape", with_views("contests", """
SELECT game_id, season, week, home_score, away_score, 0.0::DOUBLE AS home_pred, 0.0::DOUBLE AS away_pred FROM contests WHERE season < 0"""))
def empty_result(spark, folder):
    early = base.model_table(spark, folder).filter("season < 1996")
    return folds.walk_forward(early, lambda t: None, lambda m, t: t, by="season")


@query("j4_score", with_views("evaluation", """
SELECT model, round(sqrt(avg(home_err * home_err)), 6) AS home_rmse, round(sqrt(avg(away_err * away_err)), 6) AS away_rmse,
       round(avg(abs(home_err)), 6) AS home_mae, round(avg(abs(away_err)), 6) AS away_mae, count(*) AS n_games FROM evaluation GROUP BY model"""))
def score(spark, folder):
    return ev.score(evaluation(spark, folder), ["model"]).select("model", "n_games", *rs("home_rmse", "away_rmse", "home_mae", "away_mae"))


SLOT_SQL = sc.time_slot_sql("(isodow(gameday) - 1)", "CAST(substr(gametime, 1, 2) AS INT)")


@query("j5_long_evaluation", with_views("evaluation", f"""
SELECT model, game_id, block, {SLOT_SQL} AS slot, round(home_err, 6) AS home_err, round(away_err, 6) AS away_err, round(total_err, 6) AS total_err, round(margin_err, 6) AS margin_err FROM evaluation"""))
def long_evaluation(spark, folder):
    df = evaluation(spark, folder).withColumn("slot", sc.time_slot(F.weekday("gameday"), F.col("gametime")))
    return df.select("model", "game_id", "block", "slot", *rs("home_err", "away_err", "total_err", "margin_err"))


@query("j6_block_bootstrap", with_views("evaluation", f"""
WITH pr AS (SELECT c.model, c.block, c.home_err * c.home_err + c.away_err * c.away_err AS sc, b.home_err * b.home_err + b.away_err * b.away_err AS sr
            FROM evaluation c JOIN evaluation b ON b.game_id = c.game_id AND b.model = 'baseline' WHERE c.model <> 'baseline'),
{boot_sql('x', 'pr', 'model', 'block', {'c': 'sc', 'r': 'sr', 'n': '2'})}
SELECT model, round((SELECT sqrt(sum(c) / sum(n)) - sqrt(sum(r) / sum(n)) FROM x_b b WHERE b.model = x_r.model), 6) AS delta,
       round(quantile_cont(sqrt(c / n) - sqrt(r / n), 0.025), 6) AS lo, round(quantile_cont(sqrt(c / n) - sqrt(r / n), 0.975), 6) AS hi,
       round(avg(CASE WHEN sqrt(c / n) - sqrt(r / n) < 0 THEN 1.0 ELSE 0.0 END), 6) AS p_better FROM x_r GROUP BY model"""))
def block_bootstrap(spark, folder):
    out = bs.paired_rmse_delta(bs.against(evaluation(spark, folder), "baseline"), ["model"], "block", REPS)
    return out.select("model", *rs("delta", "lo", "hi", "p_better"))


@query("j7_pooled_errors", with_views("evaluation", """
SELECT model, count(*) * 2 AS errors, round(sqrt((sum(home_err * home_err) + sum(away_err * away_err)) / (2 * count(*))), 6) AS rmse FROM evaluation GROUP BY model"""))
def pooled_errors(spark, folder):
    out = ev.unpivot_targets(evaluation(spark, folder), ["home", "away"], ["model"])
    return out.groupBy("model").agg(F.count("*").alias("errors"), r(ev.rmse(F.col("err"))).alias("rmse"))


_MAE2 = "round((avg(abs(home_err)) + avg(abs(away_err))) / 2, 6)"
_RMSE2 = "round(sqrt(avg(home_err * home_err + away_err * away_err) / 2), 6)"


@query("j8_leaderboard", with_views("evaluation", f"""
WITH pr AS (SELECT c.model, c.block, c.home_err * c.home_err + c.away_err * c.away_err AS sc, b.home_err * b.home_err + b.away_err * b.away_err AS sr
            FROM evaluation c JOIN evaluation b ON b.game_id = c.game_id AND b.model = 'baseline' WHERE c.model <> 'baseline'),
{boot_sql('x', 'pr', 'model', 'block', {'c': 'sc', 'r': 'sr', 'n': '2'})},
vs AS (SELECT model, quantile_cont(sqrt(c / n) - sqrt(r / n), 0.025) AS lo, quantile_cont(sqrt(c / n) - sqrt(r / n), 0.975) AS hi FROM x_r GROUP BY model),
l AS (SELECT model, count(*) AS games, {_RMSE2} AS rmse, {_MAE2} AS mae, round(sqrt(avg(margin_err * margin_err)), 6) AS margin_rmse,
        round(sqrt(avg(total_err * total_err)), 6) AS total_rmse, round(avg(home_err), 6) AS home_bias, round(avg(away_err), 6) AS away_bias,
        round(avg(CASE WHEN home_score <> away_score THEN CASE WHEN (home_pred - away_pred > 0) = (home_score - away_score > 0) THEN 1.0 ELSE 0.0 END END), 6) AS winner_pct
      FROM evaluation GROUP BY model),
sl AS (SELECT model, round(regr_slope(y, x), 6) AS calib_slope FROM (SELECT model, home_pred AS x, home_score AS y FROM evaluation UNION ALL SELECT model, away_pred, away_score FROM evaluation) GROUP BY model)
SELECT l.*, sl.calib_slope, CASE WHEN model <> 'league_average' THEN row_number() OVER (PARTITION BY model = 'league_average' ORDER BY rmse, model) END AS rank,
       round(vs.lo, 6) AS vs_lo, round(vs.hi, 6) AS vs_hi
FROM l JOIN sl USING (model) LEFT JOIN vs USING (model)"""))
def leaderboard(spark, folder):
    df = evaluation(spark, folder)
    c = F.col
    h, a = c("home_err"), c("away_err")
    stats = df.groupBy("model").agg(
        F.count("*").alias("games"), r(F.sqrt(ev.pooled(h, a))).alias("rmse"), r(ev.pooled(h, a, F.abs)).alias("mae"),
        r(ev.pooled_slope()).alias("calib_slope"), r(ev.rmse(c("margin_err"))).alias("margin_rmse"),
        r(ev.rmse(c("total_err"))).alias("total_rmse"), r(F.avg(h)).alias("home_bias"), r(F.avg(a)).alias("away_bias"),
        r(ev.winner_share(c("home_pred") - c("away_pred"), c("home_score") - c("away_score"))).alias("winner_pct"),
    )
    vs = bs.paired_rmse_delta(bs.against(df, "baseline"), ["model"], "block", REPS).select("model", r("lo").alias("vs_lo"), r("hi").alias("vs_hi"))
    return ev.leaderboard_rank(stats.join(vs, "model", "left"), "rmse", ["league_average"])


@query("e25_rank_with_unranked", with_views("evaluation", """
SELECT model, CASE WHEN model <> 'composite' THEN row_number() OVER (PARTITION BY model = 'composite' ORDER BY sqrt(avg(home_err * home_err)), model) END AS rank
FROM evaluation GROUP BY model"""))
def rank_with_unranked(spark, folder):
    table = evaluation(spark, folder).groupBy("model").agg(ev.rmse(F.col("home_err")).alias("m"))
    return ev.leaderboard_rank(table, "m", ["composite"]).select("model", "rank")


_TARGETS = ["home", "away", "margin", "total"]
_LONG = " UNION ALL ".join(f"SELECT model, block, '{t}' AS target, {t}_err AS e FROM evaluation" for t in _TARGETS)


@query("j9_miss_distribution", with_views("evaluation", f"""
WITH l AS ({_LONG}), {boot_sql('x', 'l', 'model, target', 'block', {'s': 'e', 'c': '1'})},
b AS (SELECT model, target, quantile_cont(s / c, 0.025) AS lo, quantile_cont(s / c, 0.975) AS hi FROM x_r GROUP BY ALL)
SELECT model, target, count(*) AS n, round(avg(e), 6) AS mean_err, round(any_value(lo), 6) AS bias_lo, round(any_value(hi), 6) AS bias_hi,
       CASE WHEN any_value(lo) > 0 THEN 'OVER-predicts' WHEN any_value(hi) < 0 THEN 'UNDER-predicts' ELSE '-' END AS direction,
       round(median(e), 6) AS median_err, round(quantile_cont(e, 0.05), 6) AS p05, round(quantile_cont(e, 0.95), 6) AS p95,
       round(min(e), 6) AS worst_under, round(max(e), 6) AS worst_over, round(avg(CASE WHEN e > 0 THEN 1.0 ELSE 0.0 END), 6) AS pct_over,
       round(avg(CASE WHEN abs(e) <= 7 THEN 1.0 ELSE 0.0 END), 6) AS pct_within_7
FROM l JOIN b USING (model, target) GROUP BY model, target"""))
def miss_distribution(spark, folder):
    long = ev.unpivot_targets(evaluation(spark, folder), _TARGETS, ["model", "block"])
    by = ["model", "target"]
    e = F.col("err")
    ci = bs.mean_interval(long, by, "block", {"bias": e}, REPS)
    q = quantiles.exact_quantiles(long, by, "err", [0.05, 0.5, 0.95])
    pick = lambda p: F.max(F.when(F.col("prob") == p, F.col("q")))
    spread = q.groupBy(*by).agg(pick(0.05).alias("p05"), pick(0.5).alias("median_err"), pick(0.95).alias("p95"))
    stats = long.groupBy(*by).agg(
        F.count("*").alias("n"), F.avg(e).alias("mean_err"), F.min(e).alias("worst_under"), F.max(e).alias("worst_over"),
        F.avg((e > 0).cast("double")).alias("pct_over"), F.avg((F.abs(e) <= 7).cast("double")).alias("pct_within_7"),
    )
    verdict = F.when(F.col("bias_lo") > 0, "OVER-predicts").when(F.col("bias_hi") < 0, "UNDER-predicts").otherwise("-")
    return stats.join(ci, by).join(spread, by).select(
        *by, "n", verdict.alias("direction"),
        *rs("mean_err", "bias_lo", "bias_hi", "median_err", "p05", "p95", "worst_under", "worst_over", "pct_over", "pct_within_7"),
    )


@query("j10_bias_by_season", with_views("evaluation", """
WITH t AS (SELECT model, season, avg(home_err) AS h, avg(away_err) AS a FROM evaluation GROUP BY ALL),
o AS (SELECT model, avg(home_err) AS h, avg(away_err) AS a FROM evaluation GROUP BY ALL)
SELECT t.model, count(*) AS seasons, count(*) FILTER (sign(t.h) = sign(o.h)) AS home_same, count(*) FILTER (sign(t.a) = sign(o.a)) AS away_same,
       round(any_value(o.h), 6) AS home_bias, round(any_value(o.a), 6) AS away_bias FROM t JOIN o USING (model) GROUP BY t.model"""))
def bias_by_season(spark, folder):
    df = evaluation(spark, folder)
    season = df.groupBy("model", "season").agg(F.avg("home_err").alias("h"), F.avg("away_err").alias("a"))
    overall = df.groupBy("model").agg(F.avg("home_err").alias("oh"), F.avg("away_err").alias("oa"))
    same = lambda x, y: F.count_if(F.signum(x) == F.signum(y))
    return season.join(overall, "model").groupBy("model").agg(
        F.count("*").alias("seasons"), same("h", "oh").alias("home_same"), same("a", "oa").alias("away_same"),
        r(F.max("oh")).alias("home_bias"), r(F.max("oa")).alias("away_bias"),
    )


@query("j11_by_group", with_views("evaluation", f"""
WITH l AS (SELECT *, {SLOT_SQL} AS slot FROM evaluation), {boot_sql('x', 'l', 'model, slot', 'block', {'sq': 'home_err * home_err + away_err * away_err', 'n': '2'})},
b AS (SELECT model, slot, {lo_hi('sqrt(sq / n)', 'rmse')} FROM x_r GROUP BY ALL)
SELECT model, slot, count(*) AS games, {_RMSE2} AS rmse, any_value(rmse_lo) AS rmse_lo, any_value(rmse_hi) AS rmse_hi, {_MAE2} AS mae,
       round(avg(total_err), 6) AS total_bias, round(avg(home_score + away_score), 6) AS actual_total
FROM l JOIN b USING (model, slot) GROUP BY model, slot"""))
def by_group(spark, folder):
    df = evaluation(spark, folder).withColumn("slot", sc.time_slot(F.weekday("gameday"), F.col("gametime")))
    by = ["model", "slot"]
    h, a = F.col("home_err"), F.col("away_err")
    stats = df.groupBy(*by).agg(
        F.count("*").alias("games"), r(F.sqrt(ev.pooled(h, a))).alias("rmse"), r(ev.pooled(h, a, F.abs)).alias("mae"),
        r(F.avg("total_err")).alias("total_bias"), r(F.avg(F.col("home_score") + F.col("away_score"))).alias("actual_total"),
    )
    ci = bs.rmse_interval(df, by, "block", replicates=REPS)
    return stats.join(ci.select(*by, *rs("rmse_lo", "rmse_hi")), by)


view("team_long", ["evaluation"], """
SELECT model, game_id, season, block, home_team AS team, 'home' AS venue, home_err AS scored_err, away_err AS allowed_err, margin_err FROM evaluation
UNION ALL SELECT model, game_id, season, block, away_team, 'away', away_err, home_err, -margin_err FROM evaluation""")


def team_long(spark, folder):
    from priorlake.operators.rollup import both_sides

    c = F.col
    side = lambda team, venue, own, other, margin: [
        c(team).alias("team"), F.lit(venue).alias("venue"), c(own).alias("scored_err"), c(other).alias("allowed_err"), margin.alias("margin_err")
    ]
    return both_sides(
        evaluation(spark, folder).withColumnRenamed("margin_err", "_margin"), side("home_team", "home", "home_err", "away_err", c("_margin")),
        side("away_team", "away", "away_err", "home_err", -c("_margin")), ["model", "game_id", "season", "block"],
    )


@query("j12_entity_view", with_views("team_long", """
SELECT team, model, count(*) AS games, round(avg(scored_err), 6) AS scored_bias, round(avg(allowed_err), 6) AS allowed_bias, round(avg(margin_err), 6) AS margin_bias,
       round(avg(abs(scored_err)), 6) AS scored_mae, round(sqrt(avg(margin_err * margin_err)), 6) AS margin_rmse FROM team_long GROUP BY team, model"""))
def entity_view(spark, folder):
    m = F.col("margin_err")
    return team_long(spark, folder).groupBy("team", "model").agg(
        F.count("*").alias("games"), r(F.avg("scored_err")).alias("scored_bias"), r(F.avg("allowed_err")).alias("allowed_bias"),
        r(F.avg(m)).alias("margin_bias"), r(F.avg(F.abs("scored_err"))).alias("scored_mae"), r(ev.rmse(m)).alias("margin_rmse"),
    )


@query("j12_entity_consensus", with_views("team_long", f"""
WITH pm AS (SELECT team, model, avg(margin_err) AS m FROM team_long GROUP BY ALL),
pa AS (SELECT team, avg(m) AS avg_m, count(*) AS n_models FROM pm GROUP BY team),
g AS (SELECT team, game_id, block, avg(margin_err) AS m FROM team_long GROUP BY ALL),
{boot_sql('x', 'g', 'team', 'block', {'s': 'm', 'c': '1'})},
b AS (SELECT team, quantile_cont(s / c, 0.025) AS lo, quantile_cont(s / c, 0.975) AS hi FROM x_r GROUP BY team)
SELECT team, n_models, round(avg_m, 6) AS margin_bias_avg, (SELECT count(*) FROM pm WHERE pm.team = pa.team AND sign(pm.m) = sign(pa.avg_m)) AS same_sign,
       round(lo, 6) AS margin_bias_lo, round(hi, 6) AS margin_bias_hi,
       CASE WHEN lo > 0 THEN 'models OVER-rate' WHEN hi < 0 THEN 'models UNDER-rate' ELSE '-' END AS verdict
FROM pa JOIN b USING (team)"""))
def entity_consensus(spark, folder):
    long = team_long(spark, folder)
    per_model = long.groupBy("team", "model").agg(F.avg("margin_err").alias("m"))
    average = per_model.groupBy("team").agg(F.avg("m").alias("margin_bias_avg"), F.count("*").alias("n_models"))
    signs = per_model.join(average, "team").groupBy("team").agg(
        F.count_if(F.signum("m") == F.signum("margin_bias_avg")).alias("same_sign")
    )
    per_game = long.groupBy("team", "game_id", "block").agg(F.avg("margin_err").alias("m"))
    ci = bs.mean_interval(per_game, ["team"], "block", {"margin_bias": F.col("m")}, REPS)
    verdict = F.when(F.col("margin_bias_lo") > 0, "models OVER-rate").when(F.col("margin_bias_hi") < 0, "models UNDER-rate").otherwise("-")
    return average.join(signs, "team").join(ci, "team").select(
        "team", "n_models", "same_sign", verdict.alias("verdict"), *rs("margin_bias_avg", "margin_bias_lo", "margin_bias_hi")
    )


view("lined", ["evaluation"], """
SELECT *, home_pred - away_pred AS pm, home_score - away_score AS tm, home_pred + away_pred AS pt, home_score + away_score AS tt
FROM evaluation WHERE spread_line IS NOT NULL AND total_line IS NOT NULL""")


def lined(spark, folder):
    c = F.col
    return evaluation(spark, folder).dropna(subset=["spread_line", "total_line"]).select(
        "*", (c("home_pred") - c("away_pred")).alias("pm"), (c("home_score") - c("away_score")).alias("tm"),
        (c("home_pred") + c("away_pred")).alias("pt"), (c("home_score") + c("away_score")).alias("tt"),
    )


_HIT = "CASE WHEN tm <> spread_line THEN CASE WHEN (pm > spread_line) = (tm > spread_line) THEN 1.0 ELSE 0.0 END END"
_OU = "CASE WHEN tt <> total_line THEN CASE WHEN (pt > total_line) = (tt > total_line) THEN 1.0 ELSE 0.0 END END"


@query("j13_market_comparison", with_views("lined", f"""
WITH h AS (SELECT *, {_HIT} AS hit, {_OU} AS ou, (total_line + spread_line) / 2 - home_score AS mh, (total_line - spread_line) / 2 - away_score AS ma FROM lined),
{boot_sql('x', 'h', 'model', 'block', {'s': 'hit', 'c': 'CASE WHEN hit IS NOT NULL THEN 1 ELSE 0 END'})},
b AS (SELECT model, {lo_hi('s / c', 'ats')} FROM x_r GROUP BY model)
SELECT model, count(*) AS games, {_RMSE2} AS model_score_rmse, round(sqrt(avg(mh * mh + ma * ma) / 2), 6) AS market_score_rmse,
       round(sqrt(avg((pm - tm) ** 2)), 6) AS model_margin_rmse, round(sqrt(avg((spread_line - tm) ** 2)), 6) AS market_margin_rmse,
       round(sqrt(avg((pt - tt) ** 2)), 6) AS model_total_rmse, round(sqrt(avg((total_line - tt) ** 2)), 6) AS market_total_rmse,
       round(avg(hit), 6) AS ats_pct, any_value(ats_lo) AS ats_lo, any_value(ats_hi) AS ats_hi, round(avg(ou), 6) AS ou_pct,
       round(avg(CASE WHEN abs(pm - tm) < abs(spread_line - tm) THEN 1.0 ELSE 0.0 END), 6) AS closer
FROM h JOIN b USING (model) GROUP BY model"""))
def market_comparison(spark, folder):
    c = F.col
    df = lined(spark, folder).select(
        "*", F.when(c("tm") != c("spread_line"), ev.hit(c("pm"), c("tm"), c("spread_line"))).alias("hit"),
        F.when(c("tt") != c("total_line"), ev.hit(c("pt"), c("tt"), c("total_line"))).alias("ou"),
        ((c("total_line") + c("spread_line")) / 2 - c("home_score")).alias("mh"),
        ((c("total_line") - c("spread_line")) / 2 - c("away_score")).alias("ma"),
    )
    stats = df.groupBy("model").agg(
        F.count("*").alias("games"), r(F.sqrt(ev.pooled(c("home_err"), c("away_err")))).alias("model_score_rmse"),
        r(F.sqrt(ev.pooled(c("mh"), c("ma")))).alias("market_score_rmse"),
        r(ev.rmse(c("pm") - c("tm"))).alias("model_margin_rmse"), r(ev.rmse(c("spread_line") - c("tm"))).alias("market_margin_rmse"),
        r(ev.rmse(c("pt") - c("tt"))).alias("model_total_rmse"), r(ev.rmse(c("total_line") - c("tt"))).alias("market_total_rmse"),
        r(F.avg("hit")).alias("ats_pct"), r(F.avg("ou")).alias("ou_pct"),
        r(F.avg((F.abs(c("pm") - c("tm")) < F.abs(c("spread_line") - c("tm"))).cast("double"))).alias("closer"),
    )
    ci = bs.mean_interval(df, ["model"], "block", {"ats": c("hit")}, REPS)
    return stats.join(ci.select("model", *rs("ats_lo", "ats_hi")), "model")


def _rec(live: str, win: str, push: str) -> str:
    return f"""count(*) FILTER ({live}) AS n, count(*) FILTER ({live} AND {win}) AS wins, count(*) FILTER ({live} AND NOT ({win})) AS losses,
 count(*) FILTER ({push}) AS pushes, round(count(*) FILTER ({live} AND {win}) / nullif(count(*) FILTER ({live}), 0), 6) AS rate,
 round((100.0::DOUBLE / 110.0 * count(*) FILTER ({live} AND {win}) - count(*) FILTER ({live} AND NOT ({win}))) / nullif(count(*) FILTER ({live}), 0), 6) AS roi"""


_ATS = _rec("tm <> spread_line", "(pm > spread_line) = (tm > spread_line)", "tm = spread_line")
_TOT = _rec("tt <> total_line", "(pt > total_line) = (tt > total_line)", "tt = total_line")
_SU = _rec("tm <> 0", "(pm > 0) = (tm > 0)", "tm = 0")


@query("j14_line_records", with_views("lined", f"""
SELECT model, 'spread' AS bet, {_ATS} FROM lined GROUP BY model UNION ALL SELECT model, 'total', {_TOT} FROM lined GROUP BY model
UNION ALL SELECT model, 'winner', {_SU} FROM lined GROUP BY model"""))
def line_records(spark, folder):
    c = F.col
    bets = F.array(*[
        F.struct(F.lit(n).alias("bet"), p.alias("p"), t.alias("a"), line.alias("line"))
        for n, p, t, line in (
            ("spread", c("pm"), c("tm"), c("spread_line")), ("total", c("pt"), c("tt"), c("total_line")), ("winner", c("pm"), c("tm"), F.lit(0.0)),
        )
    ])
    long = lined(spark, folder).select("model", F.explode(bets).alias("x")).select("model", "x.*")
    out = long.groupBy("model", "bet").agg(*ev.line_record(c("p"), c("a"), c("line")))
    return out.select("model", "bet", "n", "wins", "losses", "pushes", *rs("rate", "roi"))


@query("j15_edge_curve", with_views("lined", f"""
SELECT model, CASE WHEN abs(pm - spread_line) < 5 THEN '0-5' WHEN abs(pm - spread_line) < 15 THEN '5-15' WHEN abs(pm - spread_line) < 40 THEN '15-40' ELSE '40-+' END AS bucket, {_ATS}
FROM lined GROUP BY ALL"""))
def edge_curve(spark, folder):
    c = F.col
    edge = F.abs(c("pm") - c("spread_line"))
    bucket = F.when(edge < 5, "0-5").when(edge < 15, "5-15").when(edge < 40, "15-40").otherwise("40-+")
    out = lined(spark, folder).withColumn("bucket", bucket).groupBy("model", "bucket").agg(*ev.line_record(c("pm"), c("tm"), c("spread_line")))
    return out.select("model", "bucket", "n", "wins", "losses", "pushes", *rs("rate", "roi"))


@query("j16_win_rate_interval", with_views("lined", f"""
WITH h AS (SELECT *, {_OU} AS hit FROM lined), {boot_sql('x', 'h', 'model', 'block', {'s': 'hit', 'c': 'CASE WHEN hit IS NOT NULL THEN 1 ELSE 0 END'})}
SELECT model, {lo_hi('s / c', 'rate')} FROM x_r GROUP BY model"""))
def win_rate_interval(spark, folder):
    c = F.col
    df = lined(spark, folder).withColumn("hit", F.when(c("tt") != c("total_line"), ev.hit(c("pt"), c("tt"), c("total_line"))))
    return bs.mean_interval(df, ["model"], "block", {"rate": c("hit")}, REPS).select("model", *rs("rate_lo", "rate_hi"))


@query("j17_calibration", with_views("evaluation", """
SELECT model, round(avg(home_err), 6) AS bias, round(sqrt(avg(home_err ** 2)), 6) AS rmse, round(regr_slope(home_score, home_pred), 6) AS slope,
       round(regr_intercept(home_score, home_pred), 5) AS intercept FROM evaluation GROUP BY model"""))
def calibration(spark, folder):
    c = F.col
    slope, intercept = ev.calibration_moments(c("home_score"), c("home_pred"))
    return evaluation(spark, folder).groupBy("model").agg(
        r(F.avg("home_err")).alias("bias"), r(ev.rmse(c("home_err"))).alias("rmse"), r(slope).alias("slope"), r(intercept, 5).alias("intercept")
    )


@query("j18_reliability", with_views("evaluation", """
WITH e AS (SELECT model, list_distinct(quantile_cont(home_pred, [0, 0.2, 0.4, 0.6, 0.8, 1.0])) AS edges FROM evaluation GROUP BY model)
SELECT model, greatest(len(list_filter(edges, lambda x: x < home_pred)) - 1, 0) AS bin, count(*) AS n, round(avg(home_pred), 6) AS mean_pred, round(avg(home_score), 6) AS mean_actual,
       round(avg(home_pred) - avg(home_score), 6) AS gap FROM evaluation JOIN e USING (model) GROUP BY ALL"""))
def reliability(spark, folder):
    out = quantiles.reliability(evaluation(spark, folder), ["model"], "home_pred", "home_score", 5)
    return out.select("model", "bin", "n", *rs("mean_pred", "mean_actual", "gap"))


view("events_p", [], """
SELECT d.doc_id, CAST(l.quality AS DOUBLE) AS y, CAST(d.n_chars AS DOUBLE) / (SELECT max(n_chars) FROM documents) AS p, d.lang
FROM labels l JOIN documents d USING (doc_id)""")


def binary(spark, folder):
    from priorlake.sources.tables import read_table

    docs = read_table(spark, folder, "documents", ["doc_id", "n_chars", "lang"])
    longest = docs.agg(F.max("n_chars")).scalar()
    return read_table(spark, folder, "labels", ["doc_id", "quality"]).join(docs, "doc_id").select(
        "doc_id", F.col("quality").cast("double").alias("y"), (F.col("n_chars").cast("double") / longest).alias("p"), "lang"
    )


@query("j18_event_reliability", with_views("events_p", """
WITH e AS (SELECT list_distinct(quantile_cont(p, [0, 0.2, 0.4, 0.6, 0.8, 1.0])) AS edges FROM events_p)
SELECT greatest(len(list_filter(edges, lambda x: x < p)) - 1, 0) AS bin, count(*) AS n, round(avg(p), 8) AS mean_pred, round(avg(y), 8) AS mean_actual, round(avg(p) - avg(y), 8) AS gap
FROM events_p, e GROUP BY ALL"""))
def event_reliability(spark, folder):
    return quantiles.reliability(binary(spark, folder), [], "p", "y", 5).select("bin", "n", *rs("mean_pred", "mean_actual", "gap", digits=8))


# Normal quantiles at 0.75, 0.90 and 0.975.
Z = {50: 0.6744897501960817, 80: 1.2815515655446004, 95: 1.959963984540054}


@query("j19_interval_coverage", with_views("evaluation", "WITH s AS (SELECT model, sqrt(avg(home_err ** 2)) AS sigma FROM evaluation GROUP BY model) SELECT model, " + ", ".join(
    f"round(avg(CASE WHEN abs(home_err) <= {z} * sigma THEN 1.0 ELSE 0.0 END), 6) AS cover_{k}" for k, z in Z.items()) + " FROM evaluation JOIN s USING (model) GROUP BY model"))
def interval_coverage(spark, folder):
    df = evaluation(spark, folder)
    sigma = df.groupBy("model").agg(ev.rmse(F.col("home_err")).alias("sigma"))
    inside = lambda z: r(F.avg((F.abs("home_err") <= z * F.col("sigma")).cast("double")))
    return df.join(sigma, "model").groupBy("model").agg(*[inside(z).alias(f"cover_{k}") for k, z in Z.items()])


@query("j20_promotion_gate", with_views("evaluation", """
WITH p AS (SELECT c.model, sqrt(avg(c.home_err ** 2)) - sqrt(avg(b.home_err ** 2)) AS d_rmse, abs(avg(c.home_err)) - abs(avg(b.home_err)) AS d_bias, count(*) AS n_games
           FROM evaluation b JOIN evaluation c USING (game_id) WHERE b.model = 'baseline' AND c.model <> 'baseline' GROUP BY c.model)
SELECT model, n_games, round(d_rmse, 6) AS rmse_delta, round(d_bias, 6) AS absbias_delta,
       CASE WHEN d_rmse < 0 AND d_bias > 0.25 THEN 'better but more biased' WHEN d_rmse < 0 THEN 'better' ELSE 'no improvement' END AS verdict FROM p"""))
def promotion_gate(spark, folder):
    df = evaluation(spark, folder)
    ref = df.filter("model = 'baseline'").select("game_id", F.col("home_err").alias("ref_err"))
    c = F.col
    paired = df.filter("model <> 'baseline'").join(ref, "game_id").groupBy("model").agg(
        F.count("*").alias("n_games"), (ev.rmse(c("home_err")) - ev.rmse(c("ref_err"))).alias("d_rmse"),
        (F.abs(F.avg("home_err")) - F.abs(F.avg("ref_err"))).alias("d_bias"),
    )
    verdict = F.when((c("d_rmse") < 0) & (c("d_bias") > 0.25), "better but more biased").when(c("d_rmse") < 0, "better").otherwise("no improvement")
    return paired.select("model", "n_games", r("d_rmse").alias("rmse_delta"), r("d_bias").alias("absbias_delta"), verdict.alias("verdict"))


_BUCKET = "CASE WHEN week <= 3 THEN 'Weeks 1-3' WHEN week <= 8 THEN 'Weeks 4-8' WHEN week <= 13 THEN 'Weeks 9-13' END"


@query("j21_error_analysis", with_views("evaluation", f"""
SELECT model, {_BUCKET} AS bucket, count(*) AS n_games, round(avg(home_err), 6) AS home_bias, round(stddev_samp(home_err), 6) AS home_sd,
       round(corr(home_err, away_err), 6) AS corr, round(sqrt(avg(away_err ** 2)), 6) AS away_rmse FROM evaluation GROUP BY ALL"""))
def error_analysis(spark, folder):
    bucket = sc.right_closed_bin(F.col("week"), [0, 3, 8, 13, 22], ["Weeks 1-3", "Weeks 4-8", "Weeks 9-13", "Weeks 14+"])
    return evaluation(spark, folder).groupBy("model", bucket.alias("bucket")).agg(
        F.count("*").alias("n_games"), r(F.avg("home_err")).alias("home_bias"), r(F.stddev_samp("home_err")).alias("home_sd"),
        r(F.corr("home_err", "away_err")).alias("corr"), r(ev.rmse(F.col("away_err"))).alias("away_rmse"),
    )


@query("j22_scoreboard", with_views("evaluation", """
WITH k AS (SELECT game_id FROM evaluation WHERE NOT (model = 'baseline' AND week = 2) AND season = 2000 GROUP BY game_id HAVING count(*) = 3)
SELECT model, count(*) AS n, round((sqrt(avg(home_err ** 2)) + sqrt(avg(away_err ** 2))) / 2, 6) AS mean_rmse, round(sqrt(avg(margin_err ** 2)), 6) AS margin_rmse,
       round(sqrt(avg(total_err ** 2)), 6) AS total_rmse, round(avg(away_err), 6) AS away_bias, round(regr_slope(home_score, home_pred), 6) AS home_slope
FROM evaluation WHERE game_id IN (SELECT game_id FROM k) AND season = 2000 GROUP BY model"""))
def scoreboard(spark, folder):
    df = evaluation(spark, folder).filter("season = 2000 AND NOT (model = 'baseline' AND week = 2)")
    c = F.col
    return ev.common_contests(df, MODELS).groupBy("model").agg(
        F.count("*").alias("n"), r((ev.rmse(c("home_err")) + ev.rmse(c("away_err"))) / 2).alias("mean_rmse"),
        r(ev.rmse(c("margin_err"))).alias("margin_rmse"), r(ev.rmse(c("total_err"))).alias("total_rmse"),
        r(F.avg("away_err")).alias("away_bias"), r(F.regr_slope("home_score", "home_pred")).alias("home_slope"),
    )


view("ensemble", ["contests"], """
SELECT a.game_id, a.home_score - a.away_score AS y, b.home_score - b.away_score AS draw
FROM contests a JOIN contests b ON a.home_team = b.home_team AND a.away_team = b.away_team AND b.t < a.t AND b.season = a.season""")


def ensemble(spark, folder):
    """Draws per contest: its pair's earlier margins of the season, at most one per month."""
    from priorlake.operators.prefix import recent_rows

    c = F.col
    rows = base.contests(spark, folder).withColumn("margin", c("home_score") - c("away_score"))
    seq = recent_rows(rows, ["home_team", "away_team", "season"], ["t"], ["margin"], 12, "draws")
    return seq.select("game_id", c("margin").alias("y"), F.explode(F.transform("draws", lambda d: d["margin"])).alias("draw"))


@query("j23_crps", with_views("ensemble", """
WITH k AS (SELECT *, row_number() OVER (PARTITION BY game_id ORDER BY draw) AS k, count(*) OVER (PARTITION BY game_id) AS m FROM ensemble)
SELECT game_id, round(avg(abs(draw - y)) - sum((2 * k - m - 1) * draw) / any_value(m) ** 2, 6) AS crps FROM k GROUP BY game_id"""))
def crps(spark, folder):
    from pyspark.sql import Window

    over = Window.partitionBy("game_id")
    k = F.row_number().over(over.orderBy("draw"))
    ranked = ensemble(spark, folder).select("*", k.alias("k"), F.count("*").over(over).alias("m"))
    spread = F.sum((2 * F.col("k") - F.col("m") - 1) * F.col("draw")) / (F.max("m") * F.max("m"))
    return ranked.groupBy("game_id").agg(r(F.avg(F.abs(F.col("draw") - F.col("y"))) - spread).alias("crps"))


@query("j24_ensemble_coverage", with_views("ensemble", """
WITH q AS (SELECT game_id, any_value(y) AS y, list_transform(quantile_cont(draw, [0.25, 0.75, 0.1, 0.9, 0.025, 0.975]), lambda v: round(v, 6)) AS q FROM ensemble GROUP BY game_id)
SELECT count(*) AS n, round(avg(CASE WHEN y BETWEEN q[1] AND q[2] THEN 1.0 ELSE 0.0 END), 6) AS cover_50,
       round(avg(CASE WHEN y BETWEEN q[3] AND q[4] THEN 1.0 ELSE 0.0 END), 6) AS cover_80, round(avg(CASE WHEN y BETWEEN q[5] AND q[6] THEN 1.0 ELSE 0.0 END), 6) AS cover_95 FROM q"""))
def ensemble_coverage(spark, folder):
    probs = F.array(*[F.lit(p) for p in (0.25, 0.75, 0.1, 0.9, 0.025, 0.975)])
    per = ensemble(spark, folder).groupBy("game_id").agg(F.max("y").alias("y"), F.transform(F.percentile("draw", probs), lambda v: F.round(v, 6)).alias("q"))
    inside = lambda i: r(F.avg(F.col("y").between(F.col("q")[i], F.col("q")[i + 1]).cast("double")))
    return per.agg(F.count("*").alias("n"), inside(0).alias("cover_50"), inside(2).alias("cover_80"), inside(4).alias("cover_95"))


@query("j25_brier_log_loss", with_views("events_p", """
SELECT lang, round(avg((p - y) ** 2), 8) AS brier, round(-avg(y * ln(greatest(least(p, 1 - 1e-9), 1e-9)) + (1 - y) * ln(1 - greatest(least(p, 1 - 1e-9), 1e-9))), 8) AS log_loss FROM events_p GROUP BY lang"""))
def brier_log_loss(spark, folder):
    p, y = F.col("p"), F.col("y")
    return binary(spark, folder).groupBy("lang").agg(r(F.avg((p - y) * (p - y)), 8).alias("brier"), r(F.avg(sc.log_loss_term(p, y)), 8).alias("log_loss"))


@query("j26_event_probability", with_views("ensemble market", """
SELECT e.game_id, round(avg(CASE WHEN draw > m.spread_line THEN 1.0 ELSE 0.0 END), 6) AS p_cover FROM ensemble e JOIN market m USING (game_id) GROUP BY e.game_id"""))
def event_probability(spark, folder):
    lines = base.market(spark, folder).select("game_id", "spread_line")
    return ensemble(spark, folder).join(lines, "game_id").groupBy("game_id").agg(
        r(F.avg((F.col("draw") > F.col("spread_line")).cast("double"))).alias("p_cover")
    )


_COUNT = " + ".join(f"(h >= {edge})::INT" for edge in bs.POISSON)


@query("j27_contest_bootstrap", with_views("evaluation", f"""
WITH pr AS (SELECT c.model, c.game_id, c.home_err * c.home_err + c.away_err * c.away_err AS sc, b.home_err * b.home_err + b.away_err * b.away_err AS sr
            FROM evaluation c JOIN evaluation b ON b.game_id = c.game_id AND b.model = 'baseline' WHERE c.model = 'composite'),
d AS (SELECT model, sc, sr, g, k, CAST('0x' || substr(m, 8 * k + 1, 8) AS BIGINT) AS h
      FROM (SELECT model, sc, sr, g, md5('42|' || g || '|' || game_id) AS m FROM pr CROSS JOIN (SELECT unnest(range(0, {REPS} // {bs.PER_HASH})) AS g)) CROSS JOIN (SELECT unnest(range(0, {bs.PER_HASH})) AS k)),
x AS (SELECT model, g, k, sum(sc * ({_COUNT})) AS c, sum(sr * ({_COUNT})) AS r, sum(2.0 * ({_COUNT})) AS n FROM d GROUP BY ALL)
SELECT model, round(quantile_cont(sqrt(c / n) - sqrt(r / n), 0.025), 6) AS lo, round(quantile_cont(sqrt(c / n) - sqrt(r / n), 0.975), 6) AS hi FROM x GROUP BY model"""))
def contest_bootstrap(spark, folder):
    """The older row-level gate: every contest is its own block."""
    paired = bs.against(evaluation(spark, folder), "baseline", ["composite"])
    return bs.paired_rmse_delta(paired, ["model"], "game_id", by_row=True).select("model", *rs("lo", "hi"))


HALVES = [30.0, 60.0, 119.0, 240.0, 480.0]


@query("j28_halflife_sweep", with_views("facts", f"""
WITH h AS (SELECT unnest([30.0, 60.0, 119.0, 240.0, 480.0])::DOUBLE AS half),
s AS (SELECT team, t, sum(team_score) AS v, count(*) AS c FROM facts GROUP BY ALL),
p AS (SELECT half, a.team, a.t, sum(b.v * pow(0.5, (a.t - b.t) / half)) / sum(b.c * pow(0.5, (a.t - b.t) / half)) AS pre FROM s a CROSS JOIN h JOIN s b ON a.team = b.team AND b.t < a.t GROUP BY ALL)
SELECT half, count(*) AS n, round(sqrt(avg((pre - team_score) ** 2)), 6) AS rmse FROM facts JOIN p USING (team, t) GROUP BY half"""))
def halflife_sweep(spark, folder):
    """All arms in one plan: every half-life is another decayed sum over the same prefix pass."""
    df = base.facts(spark, folder)
    names = {f"h{int(h)}": h for h in HALVES}
    pairs = {n: (F.col("team_score"), F.lit(1.0)) for n in names}
    pre = temporal.decayed_prior(df, ["team"], "t", pairs, {n: temporal.Exponential(h) for n, h in names.items()})
    arms = F.explode(F.array(*[F.struct(F.lit(h).alias("half"), F.col(n).alias("pre")) for n, h in names.items()]))
    long = df.join(pre.select("team", "t", arms.alias("x")), ["team", "t"]).filter("x.pre IS NOT NULL")
    return long.groupBy("x.half").agg(F.count("*").alias("n"), r(ev.rmse(F.col("x.pre") - F.col("team_score"))).alias("rmse"))


@query("j30_leakage_audit", with_views("folds contests", """
SELECT season, week, cutoff, n_train, (SELECT max(t) FROM contests c WHERE c.t < f.cutoff) AS last_day, 0 AS leaks FROM folds f"""))
def leakage_audit(spark, folder):
    played = base.contests(spark, folder)
    return folds.leakage_audit(played, folds.training_used(played, base.folds(spark, folder)))
