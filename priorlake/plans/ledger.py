"""Forecast ledger and readiness (section K)."""
from __future__ import annotations

from pyspark.sql import functions as F

from priorlake.functions import scalars as sc
from priorlake.operators import ledger as lg
from priorlake.plans import base
from priorlake.plans.base import query, r, rs, view, with_views
from priorlake.plans.facts import NOW, played_print, schedule
from priorlake.sources.views import plays

MODELS = ["baseline", "composite"]
KEYS = ["game_id", "season", "week", "home_team", "away_team"]

_WIDE = ", ".join(
    f"round(max({s}_pred) FILTER (model = '{m}'), 1) AS {m}_{s}" for m in MODELS for s in ("home", "away")
)
_SHIFTED = ", ".join(f"round({m}_{s} + 0.3 * (home_team % 3), 1) AS {m}_{s}" for m in MODELS for s in ("home", "away"))

# The stored ledger holds all forecasts up to week 8 of 2001, older seasons made twelve days ahead; the fresh run covers weeks 6 to 9 of 2001.
view("fresh", ["preds", "market"], f"""
SELECT p.*, CAST(m.gameday AS TIMESTAMP) + to_hours(CAST(coalesce(substr(m.gametime, 1, 2), '13') AS INT)) AS kickoff,
       TIMESTAMP '2001-06-20 09:00:00' AS generated_at, m.spread_line, m.total_line
FROM (SELECT game_id, season, week, home_team, away_team, {_WIDE} FROM preds WHERE season * 100 + week BETWEEN 200106 AND 200109 GROUP BY ALL) p JOIN market m USING (game_id)""")
view("stored", ["preds", "market"], f"""
SELECT game_id, season, week, home_team, away_team, {_SHIFTED}, kickoff, generated_at, spread_line, total_line FROM (
SELECT p.*, CAST(m.gameday AS TIMESTAMP) + to_hours(CAST(coalesce(substr(m.gametime, 1, 2), '13') AS INT)) AS kickoff,
       CASE WHEN p.season < 2001 THEN CAST(m.gameday AS TIMESTAMP) - INTERVAL 12 DAY ELSE TIMESTAMP '2001-05-20 09:00:00' END AS generated_at, m.spread_line + 1 AS spread_line, m.total_line
FROM (SELECT game_id, season, week, home_team, away_team, {_WIDE} FROM preds WHERE season * 100 + week <= 200108 GROUP BY ALL) p JOIN market m USING (game_id))""")
RUN_NOW = "2001-06-15 00:00:00"


def _run(spark, folder, first, last, generated, shift):
    preds = base.predictions(spark, folder).filter(f"season * 100 + week BETWEEN {first} AND {last}")
    wide = lg.wide_forecasts(preds, MODELS, KEYS)
    hour = F.coalesce(F.substring("gametime", 1, 2), F.lit("13")).cast("int")
    ahead = F.col("gameday").cast("timestamp") - F.expr("INTERVAL 12 DAY")
    made = F.when(F.year("gameday") < 2001, ahead).otherwise(F.lit(generated).cast("timestamp"))
    lines = base.market(spark, folder).select(
        "game_id", (F.col("gameday").cast("timestamp") + F.make_dt_interval(F.lit(0), hour)).alias("kickoff"),
        made.alias("generated_at"), (F.col("spread_line") + shift).alias("spread_line"), "total_line",
    )
    names = [f"{m}_{s}" for m in MODELS for s in ("home", "away")]
    value = lambda n: F.round(F.round(n, 1) + F.lit(0.3 * shift) * (F.col("home_team") % 3), 1)
    return wide.select(*KEYS, *[value(n).alias(n) for n in names]).join(lines, "game_id")


def fresh(spark, folder):
    return _run(spark, folder, 200106, 200109, "2001-06-20 09:00:00", 0)


def stored(spark, folder):
    return _run(spark, folder, 0, 200108, "2001-05-20 09:00:00", 1)


_STATUS = "SELECT game_id, posteam AS team, count(*) AS statuses FROM plays WHERE kind = 'N' GROUP BY ALL"


@query("k1_readiness", with_views("sched plays", f"""
WITH g AS (SELECT game_id, home_team, away_team, kickoff, (kickoff AT TIME ZONE 'UTC') AT TIME ZONE 'America/New_York' AS lk FROM sched),
d AS (SELECT *, ((CAST(CAST(lk AS DATE) - CASE WHEN isodow(lk) = 4 THEN 1 ELSE 2 END AS TIMESTAMP) + INTERVAL 16 HOUR) AT TIME ZONE 'America/New_York') AT TIME ZONE 'UTC' AS due FROM g),
n AS ({_STATUS}),
x AS (SELECT d.*, coalesce(h.statuses, 0) AS home_rows, coalesce(a.statuses, 0) AS away_rows FROM d LEFT JOIN n h ON h.game_id = d.game_id AND h.team = d.home_team LEFT JOIN n a ON a.game_id = d.game_id AND a.team = d.away_team),
y AS (SELECT *, avg((CAST(home_rows > 0 AS INT) + CAST(away_rows > 0 AS INT)) / 2) OVER (PARTITION BY due) AS coverage FROM x)
SELECT game_id, strftime(due, '%Y-%m-%d %H:%M:%S') AS due, home_rows, away_rows, round(coverage, 8) AS coverage,
  CAST(due <= TIMESTAMP '{NOW}' AND coverage >= 0.4 AS INT) AS final FROM y"""))
def readiness(spark, folder):
    games = schedule(spark, folder).select("game_id", "home_team", "away_team", "kickoff")
    statuses = plays(spark, folder).filter("kind = 'N'").groupBy("game_id", F.col("posteam").alias("team")).agg(
        F.count("*").alias("statuses")
    )
    out = lg.readiness(games, statuses, F.lit(NOW).cast("timestamp"), 0.4)
    return out.select(
        "game_id", F.date_format("due", "yyyy-MM-dd HH:mm:ss").alias("due"), "home_rows", "away_rows", r("coverage", 8).alias("coverage"),
        F.col("final").cast("int").alias("final"),
    )


@query("k2_provisional", with_views("stored", """
WITH s AS (SELECT *, (kickoff AT TIME ZONE 'UTC') AT TIME ZONE 'America/New_York' AS lk, CASE WHEN home_team % 4 = 0 THEN 'False' WHEN home_team % 4 = 1 THEN 'True' END AS flag,
   generated_at + to_days(CAST(home_team AS INT)) AS made FROM stored)
SELECT game_id, CAST(CASE WHEN flag IS NOT NULL THEN flag = 'False' ELSE
  made < ((CAST(CAST(lk AS DATE) - CASE WHEN isodow(lk) = 4 THEN 1 ELSE 2 END AS TIMESTAMP) + INTERVAL 16 HOUR) AT TIME ZONE 'America/New_York') AT TIME ZONE 'UTC' END AS INT) AS provisional FROM s"""))
def provisional(spark, folder):
    k = F.col("home_team") % 4
    flag = F.when(k == 0, "False").when(k == 1, "True")
    made = F.col("generated_at") + F.make_dt_interval(F.col("home_team"))
    return stored(spark, folder).select("game_id", sc.made_before_report(flag, made, F.col("kickoff")).cast("int").alias("provisional"))


@query("k3_freeze_started", with_views("fresh stored", f"""
WITH kept AS (SELECT * FROM stored WHERE kickoff <= TIMESTAMP '{RUN_NOW}' OR game_id NOT IN (SELECT game_id FROM fresh)),
allrows AS (SELECT * FROM kept UNION ALL SELECT * FROM fresh WHERE game_id NOT IN (SELECT game_id FROM kept))
SELECT game_id, strftime(generated_at, '%Y-%m-%d') AS made, baseline_home, composite_away, spread_line FROM allrows"""))
def freeze_started(spark, folder):
    out = lg.freeze_started(fresh(spark, folder), stored(spark, folder), F.lit(RUN_NOW).cast("timestamp"))
    return out.select("game_id", F.date_format("generated_at", "yyyy-MM-dd").alias("made"), "baseline_home", "composite_away", "spread_line")


_SAME = " AND ".join(f"f.{m}_{s} IS NOT DISTINCT FROM s.{m}_{s}" for m in MODELS for s in ("home", "away"))


@query("k4_reproduced", with_views("fresh stored", f"SELECT f.game_id FROM fresh f JOIN stored s USING (game_id) WHERE {_SAME} AND f.kickoff IS NOT DISTINCT FROM s.kickoff"))
def reproduced(spark, folder):
    return lg.reproduced(fresh(spark, folder), stored(spark, folder))


_CMP = "game_id, season, week, home_team, away_team, baseline_home, baseline_away, composite_home, composite_away, kickoff"


@query("k5_changed_rows", with_views("fresh stored", f"""
WITH a AS (SELECT {_CMP} FROM fresh), b AS (SELECT {_CMP} FROM stored)
SELECT game_id, baseline_home FROM (SELECT * FROM a EXCEPT ALL SELECT * FROM b)
UNION ALL SELECT game_id, baseline_home FROM (SELECT * FROM b EXCEPT ALL SELECT * FROM a)"""))
def changed_rows(spark, folder):
    return lg.changed_rows(fresh(spark, folder), stored(spark, folder)).select("game_id", "baseline_home")


@query("k6_market_reference", with_views("market", """
SELECT game_id, round((total_line + spread_line) / 2, 1) AS market_home, round((total_line - spread_line) / 2, 1) AS market_away FROM market"""))
def market_reference(spark, folder):
    home, away = lg.market_scores(F.col("spread_line"), F.col("total_line"))
    return base.market(spark, folder).select("game_id", home.alias("market_home"), away.alias("market_away"))


@query("k7_training_is_current", with_views("sched", """
WITH trained AS (SELECT game_id FROM sched WHERE home_score IS NOT NULL AND NOT (season = 2000 AND week = 3 AND home_team = 1))
SELECT 'untrained' AS problem, game_id FROM sched WHERE gameday < DATE '2001-09-01' AND home_score IS NOT NULL AND game_id NOT IN (SELECT game_id FROM trained)
UNION ALL SELECT 'unscored', game_id FROM sched WHERE gameday BETWEEN DATE '2001-08-31' - 45 AND DATE '2001-08-31' AND home_score IS NULL"""))
def training_is_current(spark, folder):
    s = schedule(spark, folder)
    trained = s.filter("home_score IS NOT NULL AND NOT (season = 2000 AND week = 3 AND home_team = 1)")
    first = F.lit("2001-09-01").cast("date")
    return lg.require_current_training(s, trained, first, F.lit("2001-09-05").cast("date"))


@query("k8_live_forecast", with_views("preds", """
SELECT game_id, round(home_pred, 1) AS combined_home, round(away_pred, 1) AS combined_away, round(home_pred - away_pred, 1) AS combined_margin, round(home_pred + away_pred, 1) AS combined_total
FROM preds WHERE model = 'composite' AND t = (SELECT max(t) FROM preds)"""))
def live_forecast(spark, folder):
    """The newest fold; the composite is averaged before anything is rounded."""
    preds = base.predictions(spark, folder).filter("model = 'composite'")
    now = preds.filter(F.col("t") == base.contests(spark, folder).agg(F.max("t")).scalar())
    h, a = F.col("home_pred"), F.col("away_pred")
    return now.select(
        "game_id", sc.tidy(h).alias("combined_home"), sc.tidy(a).alias("combined_away"), sc.tidy(h - a).alias("combined_margin"), sc.tidy(h + a).alias("combined_total")
    )


def _side(who: str) -> str:
    return f"SELECT *, '{who}' AS model, {who}_home AS home, {who}_away AS away FROM stored"


view("long_stored", ["stored"], " UNION ALL ".join(_side(m) for m in MODELS))
view("graded_base", ["long_stored", "market"], """
SELECT l.game_id, l.season, l.week, l.model, l.home, l.away, l.home_team, l.away_team, l.kickoff, l.generated_at, l.spread_line, l.total_line,
       m.home_score, m.away_score, m.spread_line AS close_spread, m.total_line AS close_total,
       l.generated_at <= l.kickoff AS pre, round(l.home - l.away, 1) AS margin, round(l.home + l.away, 1) AS points
FROM long_stored l JOIN market m USING (game_id)""")
view("graded_picks", ["graded_base"], """
SELECT *, round(margin - spread_line, 1) AS gap, round(points - total_line, 1) AS over_by, round(margin - close_spread, 1) AS cgap, round(points - close_total, 1) AS cover_by FROM graded_base""")
_SPREAD = lambda gap, line: f"CASE WHEN {gap} > 0 THEN round(home_score - away_score - {line}, 1) WHEN {gap} < 0 THEN round(away_score - home_score + {line}, 1) END"
_TOTAL = lambda ov, line: f"CASE WHEN {ov} > 0 THEN round(home_score + away_score - {line}, 1) WHEN {ov} < 0 THEN -round(home_score + away_score - {line}, 1) END"
_V = lambda e: f"CASE WHEN {e} > 0 THEN 'win' WHEN {e} < 0 THEN 'loss' WHEN {e} = 0 THEN 'push' END"
view("graded", ["graded_picks"], f"""
SELECT *, home - home_score AS err_home, away - away_score AS err_away, abs(home - home_score) + abs(away - away_score) AS abs_total,
       (home - away) - (home_score - away_score) AS margin_err,
       CAST(CASE WHEN home_score = away_score THEN home - away = 0 ELSE (home - away > 0) = (home_score - away_score > 0) END AS INT) AS winner_correct,
       {_V(_SPREAD('gap', 'spread_line'))} AS spread_result, {_V(_TOTAL('over_by', 'total_line'))} AS total_result,
       {_V(_SPREAD('cgap', 'close_spread'))} AS spread_result_close, {_V(_TOTAL('cover_by', 'close_total'))} AS total_result_close,
       CASE WHEN pre THEN CASE WHEN gap > 0 THEN round(-spread_line + close_spread, 1) WHEN gap < 0 THEN round(spread_line - close_spread, 1) END END + 0.0 AS spread_clv,
       CASE WHEN pre THEN CASE WHEN over_by > 0 THEN round(close_total - total_line, 1) WHEN over_by < 0 THEN round(total_line - close_total, 1) END END + 0.0 AS total_clv
FROM graded_picks""")


def graded(spark, folder):
    results = base.market(spark, folder).select(
        "game_id", "home_score", "away_score", F.col("spread_line").alias("close_spread"), F.col("total_line").alias("close_total")
    )
    return lg.graded(lg.long_forecasts(stored(spark, folder)), results)


@query("k9_grade", with_views("graded", """
SELECT game_id, model, round(err_home, 1) + 0.0 AS err_home, round(err_away, 1) + 0.0 AS err_away, round(abs_total, 1) + 0.0 AS abs_total, round(margin_err, 1) + 0.0 AS margin_err, winner_correct FROM graded"""))
def grade(spark, folder):
    return graded(spark, folder).select("game_id", "model", *rs("err_home", "err_away", "abs_total", "margin_err", digits=1), "winner_correct")


@query("k10_picks", with_views("graded_picks", """
SELECT game_id, model, CASE WHEN spread_line IS NULL THEN NULL WHEN gap > 0 THEN home_team WHEN gap < 0 THEN away_team END AS spread_team,
  CASE WHEN gap > 0 THEN -spread_line + 0.0 WHEN gap < 0 THEN spread_line + 0.0 END AS spread_line, CASE WHEN gap <> 0 THEN abs(gap) END AS spread_edge,
  CASE WHEN over_by > 0 THEN 'Over' WHEN over_by < 0 THEN 'Under' END AS side, CASE WHEN over_by <> 0 THEN abs(over_by) END AS total_edge,
  CASE WHEN spread_line IS NOT NULL THEN CASE WHEN margin > 0 THEN home_team WHEN margin < 0 THEN away_team END END AS favorite FROM graded_picks"""))
def picks(spark, folder):
    c = F.col
    taken = lg.picks(c("home"), c("away"), c("spread_line"), c("total_line"), c("home_team"), c("away_team"))
    return lg.long_forecasts(stored(spark, folder)).withColumn("p", taken).select(
        "game_id", "model", c("p.spread.team").alias("spread_team"), c("p.spread.line").alias("spread_line"), c("p.spread.edge").alias("spread_edge"),
        c("p.total.side").alias("side"), c("p.total.edge").alias("total_edge"), c("p.model.favorite").alias("favorite"),
    )


@query("k11_pick_grades", with_views("graded", "SELECT game_id, model, spread_result, total_result, spread_result_close, total_result_close FROM graded"))
def pick_grades(spark, folder):
    return graded(spark, folder).select("game_id", "model", "spread_result", "total_result", "spread_result_close", "total_result_close")


@query("k12_week_payload", with_views("graded", """
SELECT season, week, model, count(*) AS games, round(avg(abs_total), 6) AS mae, round(avg(abs(margin_err)), 6) AS margin_mae, CAST(sum(winner_correct) AS BIGINT) AS winners,
   count(*) FILTER (spread_result = 'win') AS ats_wins, count(*) FILTER (spread_result = 'loss') AS ats_losses, count(*) FILTER (NOT pre) AS backfilled,
   strftime(max(generated_at), '%Y-%m-%d %H:%M:%S') AS as_of FROM graded GROUP BY ALL"""))
def week_payload(spark, folder):
    return graded(spark, folder).groupBy("season", "week", "model").agg(
        F.count("*").alias("games"), r(F.avg("abs_total")).alias("mae"), r(F.avg(F.abs("margin_err"))).alias("margin_mae"),
        F.sum("winner_correct").alias("winners"), F.count_if(F.col("spread_result") == "win").alias("ats_wins"),
        F.count_if(F.col("spread_result") == "loss").alias("ats_losses"), F.count_if(~F.col("pre_kickoff")).alias("backfilled"),
        F.date_format(F.max("generated_at"), "yyyy-MM-dd HH:mm:ss").alias("as_of"),
    )


@query("k13_graded_rows", with_views("graded", """
SELECT game_id, model, CAST(pre AS INT) AS pre_kickoff, home, away, home_score, away_score, close_spread, close_total, spread_result, total_result FROM graded"""))
def graded_rows(spark, folder):
    return graded(spark, folder).select(
        "game_id", "model", F.col("pre_kickoff").cast("int").alias("pre_kickoff"), "home", "away", "home_score", "away_score",
        "close_spread", "close_total", "spread_result", "total_result",
    )


@query("k14_closing_line_value", with_views("graded", "SELECT game_id, model, spread_clv, total_clv FROM graded"))
def closing_line_value(spark, folder):
    return graded(spark, folder).select("game_id", "model", "spread_clv", "total_clv")


@query("k15_live_summary", with_views("graded", """
SELECT model, count(*) AS games, count(*) FILTER (pre) AS pre_kickoff, round(sqrt(avg(err_home ** 2 + err_away ** 2) / 2), 6) AS score_rmse, round(sqrt(avg(margin_err ** 2)), 6) AS margin_rmse,
   round(avg(winner_correct), 6) AS winner_share, count(*) FILTER (spread_result = 'win') AS ats_wins, count(*) FILTER (spread_result = 'push') AS ats_pushes,
   round(count(*) FILTER (spread_result = 'win') / count(*) FILTER (spread_result IN ('win', 'loss')), 6) AS ats_pct, count(*) FILTER (total_result = 'win') AS ou_wins,
   round(avg(spread_clv), 6) AS spread_clv, count(*) FILTER (spread_clv > 0) AS spread_better, count(*) FILTER (spread_clv = 0) AS spread_same, count(*) FILTER (spread_clv < 0) AS spread_worse
FROM graded GROUP BY model"""))
def live_summary(spark, folder):
    out = lg.live_summary(graded(spark, folder), ["model"])
    return out.select(
        "model", "games", "pre_kickoff", *rs("score_rmse", "margin_rmse", "winner_share", "ats_pct", "spread_clv"), "ats_wins", "ats_pushes",
        "ou_wins", "spread_better", "spread_same", "spread_worse",
    )


@query("k16_latest_run", with_views("fresh stored", f"""
WITH a AS (SELECT game_id, season, week, generated_at FROM stored UNION ALL SELECT game_id, season, week, generated_at FROM fresh WHERE home_team % 2 = 0)
SELECT game_id, week, strftime(generated_at, '%Y-%m-%d') AS made FROM a QUALIFY generated_at = max(generated_at) OVER (PARTITION BY season, week)"""))
def latest_run(spark, folder):
    cols = ["game_id", "season", "week", "generated_at"]
    both = stored(spark, folder).select(*cols).unionByName(fresh(spark, folder).filter("home_team % 2 = 0").select(*cols))
    return lg.latest_run(both).select("game_id", "week", F.date_format("generated_at", "yyyy-MM-dd").alias("made"))


@query("k17_verify", with_views("graded_picks", """
SELECT game_id, model, CASE WHEN home_team = 2 THEN 'missing from the page' WHEN home_team = 3 THEN 'forecast differs' ELSE 'picks differ' END AS problem
FROM graded_picks WHERE home_team IN (2, 3) OR (home_team = 4 AND gap <> 0)"""))
def verify(spark, folder):
    c = F.col
    taken = lg.picks(c("home"), c("away"), c("spread_line"), c("total_line"), c("home_team"), c("away_team"))
    records = lg.long_forecasts(stored(spark, folder)).withColumn("p", taken).select(
        "game_id", "model", "home_team", "home", "away", c("p.spread.team").alias("spread_team"), c("p.spread.edge").alias("spread_edge"),
        c("p.total.side").alias("side"), c("p.total.edge").alias("total_edge"),
    )
    page = records.filter("home_team <> 2").withColumns(
        {"home": c("home") + (c("home_team") == 3).cast("int"), "spread_edge": c("spread_edge") + (c("home_team") == 4).cast("int")}
    )
    return lg.verify(page, records)


@query("k18_trusted_pull_time", with_views("contests", """
SELECT season, CASE WHEN season <> 1998 THEN '2002-01-01' END AS pulled_at FROM contests GROUP BY season"""))
def trusted_pull_time(spark, folder):
    df = base.contests(spark, folder)
    then = df.withColumn("home_score", F.col("home_score") + (F.col("season") == 1998).cast("int"))
    metadata = played_print(then).withColumn("pulled_at", F.lit("2002-01-01"))
    return lg.trusted_pull_time(metadata, played_print(df), ["season"])
