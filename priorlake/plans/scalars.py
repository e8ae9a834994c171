"""Top-k and order (F), set operations (G) and scalar functions (H)."""
from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from priorlake.functions import scalars as sc
from priorlake.operators import evaluate as ev
from priorlake.operators import roster, rules
from priorlake.plans import base
from priorlake.plans.base import MEASURES, query, r, rs, view, with_views
from priorlake.plans.facts import NOW, schedule
from priorlake.sources.tables import read_table


@query("f1_chronological", with_views("contests", "SELECT game_id, lag(game_id) OVER (PARTITION BY home_team ORDER BY t, game_id) AS previous FROM contests"))
def chronological(spark, folder):
    from priorlake.operators.prefix import neighbour

    out = neighbour(base.contests(spark, folder), ["home_team"], ["t", "game_id"], {"previous": "game_id"}, step=-1, block=F.col("season"))
    return out.select("game_id", "previous")


@query("f2_top_misses", with_views("evaluation", """
SELECT model, game_id, round(abs(home_err) + abs(away_err), 6) AS total_abs_error FROM evaluation WHERE model = 'baseline'
ORDER BY round(abs(home_err) + abs(away_err), 6) DESC, game_id LIMIT 10"""))
def top_misses(spark, folder):
    miss = r(F.abs("home_err") + F.abs("away_err")).alias("total_abs_error")
    return base.evaluation(spark, folder).filter("model = 'baseline'").select("model", "game_id", miss).orderBy(
        F.desc("total_abs_error"), "game_id"
    ).limit(10)


@query("f3_recent_rows", with_views("preds folds", """
SELECT f.season, f.week, p.model, (SELECT round(avg(e), 6) FROM (SELECT home_pred - home_score AS e FROM preds x WHERE x.model = p.model AND x.t < f.cutoff ORDER BY t DESC, game_id DESC LIMIT 285)) AS off_home
FROM folds f, (SELECT DISTINCT model FROM preds) p WHERE EXISTS (SELECT 1 FROM preds x WHERE x.t < f.cutoff)"""))
def recent_rows(spark, folder):
    out = rules.recent_bias(base.predictions(spark, folder), base.folds(spark, folder))
    return out.select("season", "week", "model", r("off_home").alias("off_home"))


@query("f4_next_contest", with_views("sched", f"""
SELECT season, week FROM sched WHERE home_score IS NULL AND kickoff > TIMESTAMP '{NOW}' + INTERVAL 15 MINUTE ORDER BY kickoff, game_id LIMIT 1"""))
def next_contest(spark, folder):
    ahead = schedule(spark, folder).filter(
        F.col("home_score").isNull() & (F.col("kickoff") > F.lit(NOW).cast("timestamp") + F.expr("INTERVAL 15 MINUTES"))
    )
    return ahead.agg(F.min_by(F.struct("season", "week"), F.struct("kickoff", "game_id")).alias("w")).select("w.season", "w.week")


@query("f5_slate_order", with_views("sched", """
SELECT game_id, row_number() OVER (PARTITION BY season, week ORDER BY CASE WHEN gametime IS NOT NULL THEN kickoff END NULLS LAST, gameday, game_id) AS place FROM sched"""))
def slate_order(spark, folder):
    kick = F.when(F.col("gametime").isNotNull(), F.col("kickoff"))
    over = Window.partitionBy("season", "week").orderBy(kick.asc_nulls_last(), "gameday", "game_id")
    return schedule(spark, folder).select("game_id", F.row_number().over(over).cast("long").alias("place"))


@query("f6_best_and_worst", with_views("pregame", """
WITH l AS (SELECT team, pregame_team_score AS v FROM pregame WHERE t = (SELECT max(t) FROM pregame) AND pregame_team_score IS NOT NULL)
SELECT team, round(v, 6) AS rating, row_number() OVER (ORDER BY v DESC, team) AS from_top, row_number() OVER (ORDER BY v, team) AS from_bottom FROM l
QUALIFY from_top <= 5 OR from_bottom <= 5"""))
def best_and_worst(spark, folder):
    pre = base.pregame(spark, folder).filter(F.col("pregame_team_score").isNotNull())
    latest = pre.agg(F.max("t")).scalar()
    now = pre.filter(F.col("t") == latest)
    rank = lambda *order: F.row_number().over(Window.partitionBy("t").orderBy(*order)).cast("long")
    ranked = now.select(
        "team", r("pregame_team_score").alias("rating"), rank(F.desc("pregame_team_score"), "team").alias("from_top"),
        rank("pregame_team_score", "team").alias("from_bottom"),
    )
    return ranked.filter((F.col("from_top") <= 5) | (F.col("from_bottom") <= 5))


@query("f7_grid_argmin", with_views("evaluation", """
WITH g AS (SELECT unnest([0.0, 0.25, 0.5, 0.75, 1.0])::DOUBLE AS w),
p AS (SELECT game_id, max(home_pred) FILTER (model = 'league_average') AS a, max(home_pred) FILTER (model = 'baseline') AS b, any_value(home_score) AS y FROM evaluation GROUP BY game_id),
e AS (SELECT w, sqrt(avg(((1 - w) * a + w * b - y) ** 2)) AS err FROM p, g GROUP BY w)
SELECT arg_min(w, err) AS best_w, round(min(err), 6) AS err FROM e"""))
def grid_argmin(spark, folder):
    c = F.col
    wide = base.evaluation(spark, folder).groupBy("game_id").agg(
        F.max(F.when(c("model") == "league_average", c("home_pred"))).alias("a"),
        F.max(F.when(c("model") == "baseline", c("home_pred"))).alias("b"), F.max("home_score").alias("y"),
    )
    grid = F.explode(F.array(*[F.lit(w) for w in (0.0, 0.25, 0.5, 0.75, 1.0)]))
    errors = wide.select("*", grid.alias("w")).groupBy("w").agg(ev.rmse((1 - c("w")) * c("a") + c("w") * c("b") - c("y")).alias("err"))
    return errors.agg(F.min_by("w", "err").alias("best_w"), r(F.min("err")).alias("err"))


@query("g2_tolerant_union", with_views("preds", """
SELECT game_id, season, round(home_pred, 6) AS home_pred, NULL::DOUBLE AS spread_line FROM preds WHERE model = 'baseline' AND season < 2000
UNION ALL SELECT game_id, season, round(home_pred, 6), home_score - away_score FROM preds WHERE model = 'baseline' AND season >= 2000"""))
def tolerant_union(spark, folder):
    df = base.predictions(spark, folder).filter("model = 'baseline'")
    old = df.filter("season < 2000").select("game_id", "season", *rs("home_pred"))
    new = df.filter("season >= 2000").select("game_id", "season", *rs("home_pred"), (F.col("home_score") - F.col("away_score")).alias("spread_line"))
    return old.unionByName(new, allowMissingColumns=True)


@query("g3_common_contests", with_views("preds", """
SELECT game_id FROM preds WHERE NOT (model = 'baseline' AND week = 2) AND NOT (model = 'composite' AND week = 5) GROUP BY game_id HAVING count(DISTINCT model) = 3"""))
def common_contests(spark, folder):
    df = base.predictions(spark, folder).filter("NOT (model = 'baseline' AND week = 2) AND NOT (model = 'composite' AND week = 5)")
    return ev.common_contests(df, ["league_average", "baseline", "composite"]).select("game_id").distinct()


@query("g4_difference", with_views("contests preds", "SELECT game_id FROM contests EXCEPT SELECT game_id FROM preds"))
def difference(spark, folder):
    return base.contests(spark, folder).select("game_id").subtract(base.predictions(spark, folder).select("game_id"))


@query("g5_dedup_by_key", """
SELECT user_id, event_type, event_id, value FROM events QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) = 1""")
def dedup_by_key(spark, folder):
    df = read_table(spark, folder, "events", ["user_id", "event_type", "event_id", "value", "ts"])
    return roster.latest_version(df, ["user_id", "event_type"], "ts", ["event_id"]).select("user_id", "event_type", "event_id", "value")


# ------------------------------------------------------------------ H. scalars

_LOCAL = """
WITH e AS (SELECT o_orderkey, CAST(o_orderdate AS DATE) AS d, CASE WHEN o_orderkey % 5 <> 0 THEN lpad(CAST(o_orderkey % 24 AS VARCHAR), 2, '0') || ':30' END AS tm FROM orders),
l AS (SELECT *, CAST(d AS TIMESTAMP) + CAST(coalesce(tm, '13:00') || ':00' AS INTERVAL) AS local FROM e),
z AS (SELECT *, (local AT TIME ZONE 'America/New_York') AT TIME ZONE 'UTC' AS utc FROM l),
k AS (SELECT *, CASE WHEN ((utc AT TIME ZONE 'UTC') AT TIME ZONE 'America/New_York') = local
   AND (((utc + INTERVAL 1 HOUR) AT TIME ZONE 'UTC') AT TIME ZONE 'America/New_York') <> local
   AND (((utc - INTERVAL 1 HOUR) AT TIME ZONE 'UTC') AT TIME ZONE 'America/New_York') <> local THEN utc END AS kickoff FROM z)
"""


def local_orders(spark, folder):
    key = F.col("o_orderkey")
    time = F.when(key % 5 != 0, F.concat(F.lpad((key % 24).cast("string"), 2, "0"), F.lit(":30")))
    return read_table(spark, folder, "orders", ["o_orderkey", "o_orderdate", "o_totalprice"]).select(
        "o_orderkey", "o_totalprice", F.to_date("o_orderdate").alias("d"), time.alias("tm")
    ).withColumn("kickoff", sc.local_to_utc(F.col("d"), F.col("tm")))


@query("h1_local_to_utc", _LOCAL + "SELECT o_orderkey, strftime(kickoff, '%Y-%m-%d %H:%M:%S') AS kickoff FROM k")
def local_to_utc(spark, folder):
    return local_orders(spark, folder).select("o_orderkey", F.date_format("kickoff", "yyyy-MM-dd HH:mm:ss").alias("kickoff"))


@query("h2_kickoff_lookup", with_views("sched", "SELECT game_id, strftime(kickoff, '%Y-%m-%d %H:%M:%S') AS kickoff FROM sched"))
def kickoff_lookup(spark, folder):
    return schedule(spark, folder).select("game_id", F.date_format("kickoff", "yyyy-MM-dd HH:mm:ss").alias("kickoff"))


@query("h3_report_due", _LOCAL + """, lo AS (SELECT o_orderkey, (kickoff AT TIME ZONE 'UTC') AT TIME ZONE 'America/New_York' AS lk FROM k)
SELECT o_orderkey, strftime(((CAST(CAST(lk AS DATE) - CASE WHEN isodow(lk) = 4 THEN 1 ELSE 2 END AS TIMESTAMP) + INTERVAL 16 HOUR) AT TIME ZONE 'America/New_York') AT TIME ZONE 'UTC', '%Y-%m-%d %H:%M:%S') AS due FROM lo""")
def report_due(spark, folder):
    return local_orders(spark, folder).select("o_orderkey", F.date_format(sc.report_due(F.col("kickoff")), "yyyy-MM-dd HH:mm:ss").alias("due"))


@query("h4_kickoff_slot", """
WITH e AS (SELECT o_orderkey, CAST(o_orderdate AS DATE) AS gameday, CASE WHEN o_orderkey % 5 <> 0 THEN lpad(CAST(o_orderkey % 24 AS VARCHAR), 2, '0') || ':30' END AS gametime FROM orders)
""" + "SELECT o_orderkey, " + sc.time_slot_sql("(isodow(gameday) - 1)", "CAST(substr(gametime, 1, 2) AS INT)") + " AS slot FROM e")
def kickoff_slot(spark, folder):
    return local_orders(spark, folder).select("o_orderkey", sc.time_slot(F.weekday("d"), F.col("tm")).alias("slot"))


@query("h5_local_text", _LOCAL + """SELECT o_orderkey, strftime((kickoff AT TIME ZONE 'UTC') AT TIME ZONE 'America/New_York', '%a %b %d ') || strftime((kickoff AT TIME ZONE 'UTC') AT TIME ZONE 'America/New_York', '%-I:%M')
  || lower(strftime((kickoff AT TIME ZONE 'UTC') AT TIME ZONE 'America/New_York', '%p')) AS shown FROM k""")
def local_text(spark, folder):
    return local_orders(spark, folder).select("o_orderkey", sc.local_text(F.col("kickoff")).alias("shown"))


@query("h6_h7_lookup_and_status", with_views("reports", """
SELECT event_id, CASE position WHEN 'QB' THEN 1.0 WHEN 'WR' THEN 0.32 WHEN 'CB' THEN 0.34 WHEN 'T' THEN 0.4 WHEN 'LS' THEN 0.04 ELSE 0.2 END::DOUBLE AS value,
       CASE WHEN report_status IN ('Out', 'Doubtful') THEN 1.0 WHEN report_status = 'Questionable' THEN 0.5 ELSE 0.0 END::DOUBLE AS weight FROM reports"""))
def lookup_and_status(spark, folder):
    return base.reports(spark, folder).select(
        "event_id", sc.lookup(F.col("position"), roster.POSITION_VALUE, roster.DEFAULT_POSITION_VALUE).alias("value"),
        sc.status_weight(F.col("report_status"), roster.UNAVAILABLE, "Questionable", roster.QUESTIONABLE_WEIGHT).alias("weight"),
    )


@query("h8_fixed_bins", """
SELECT event_id, CASE WHEN value > 0 AND value <= 20 THEN 'low' WHEN value > 20 AND value <= 60 THEN 'mid' WHEN value > 60 AND value <= 90 THEN 'high' END AS label,
  (value >= 20)::INT + (value >= 35)::INT + (value >= 50)::INT + (value >= 65)::INT + (value >= 80)::INT AS bin FROM events""")
def fixed_bins(spark, folder):
    v = F.col("value")
    return read_table(spark, folder, "events", ["event_id", "value"]).select(
        "event_id", sc.right_closed_bin(v, [0, 20, 60, 90], ["low", "mid", "high"]).alias("label"), sc.left_closed_bin(v, base.START_EDGES).alias("bin")
    )


@query("h9_h10_h17_numeric", """
SELECT o_orderkey, round((o_totalprice - 150000) / 1e5, 1) + 0.0 AS tidy, round(o_totalprice / nullif(o_orderkey % 7, 0), 4) AS ratio,
       sign(o_totalprice - 150000)::DOUBLE AS sgn, round(ln(greatest(o_totalprice, 1)), 6) AS ln, round(least(greatest(o_totalprice / 3e5, 0.1), 0.9), 8) AS clipped FROM orders""")
def numeric(spark, folder):
    p, k = F.col("o_totalprice"), F.col("o_orderkey")
    return read_table(spark, folder, "orders", ["o_orderkey", "o_totalprice"]).select(
        "o_orderkey", sc.tidy((p - 150000) / 1e5).alias("tidy"), r(sc.safe_div(p, k % 7), 4).alias("ratio"), F.signum(p - 150000).alias("sgn"),
        r(F.log(F.greatest(p, F.lit(1.0)))).alias("ln"), r(F.least(F.greatest(p / 3e5, F.lit(0.1)), F.lit(0.9)), 8).alias("clipped"),
    )


_RATE = lambda team: f"SELECT {team} AS team, avg(CASE WHEN result = 'Touchdown' THEN 1.0 ELSE 0.0 END) AS a, avg(CASE WHEN result = 'Field goal' THEN 1.0 ELSE 0.0 END) AS b, avg(CASE WHEN result NOT IN ('Touchdown', 'Field goal') THEN 1.0 ELSE 0.0 END) AS c FROM drives GROUP BY 1"
_OD = lambda p, q, b: f"(({p} / (1 - {p})) * ({q} / (1 - {q})) / ({b} / (1 - {b})))"
_L5 = lambda x: f"{_OD(f'o.{x}', f'd.{x}', f'l.{x}')} / (1 + {_OD(f'o.{x}', f'd.{x}', f'l.{x}')})"

view("side_rates", ["drives"], f"""
SELECT o.team, {_L5('a')} AS a, {_L5('b')} AS b, {_L5('c')} AS c FROM ({_RATE('posteam')}) o JOIN ({_RATE('defteam')}) d USING (team)
CROSS JOIN (SELECT avg(CASE WHEN result = 'Touchdown' THEN 1.0 ELSE 0.0 END) AS a, avg(CASE WHEN result = 'Field goal' THEN 1.0 ELSE 0.0 END) AS b, avg(CASE WHEN result NOT IN ('Touchdown', 'Field goal') THEN 1.0 ELSE 0.0 END) AS c FROM drives) l""")


def side_rates(spark, folder):
    """Own, faced and overall outcome shares per entity as arrays of three."""
    parts = [F.col("result") == "Touchdown", F.col("result") == "Field goal", ~F.col("result").isin("Touchdown", "Field goal")]
    shares = F.array(*[F.avg(p.cast("double")) for p in parts])
    pair = base.drives(spark, folder)
    own = pair.groupBy(F.col("posteam").alias("team")).agg(shares.alias("off"))
    faced = pair.groupBy(F.col("defteam").alias("team")).agg(shares.alias("faced"))
    league = pair.agg(shares.alias("l")).scalar()
    return own.join(faced, "team").withColumn("base", league)


@query("h11_log5", with_views("side_rates", "SELECT team, round(a, 8) AS a, round(b, 8) AS b, round(c, 8) AS c FROM side_rates"))
def log5(spark, folder):
    c = F.col
    value = lambda i: r(sc.log5(c("off")[i], c("faced")[i], c("base")[i]), 8)
    return side_rates(spark, folder).select("team", value(0).alias("a"), value(1).alias("b"), value(2).alias("c"))


@query("h12_blend_distribution", with_views("side_rates", """
SELECT team, round(a / (a + b + c), 8) AS a, round(b / (a + b + c), 8) AS b, round(c / (a + b + c), 8) AS c FROM side_rates"""))
def blend_distribution(spark, folder):
    mixed = side_rates(spark, folder).withColumn("m", sc.blend_distribution(F.col("off"), F.col("faced"), F.col("base")))
    return mixed.select("team", *[r(F.col("m")[i], 8).alias(n) for i, n in enumerate("abc")])


@query("h13_tilted_table", with_views("drives", """
WITH cond AS (SELECT bin, result, count(*) * 1.0 / sum(count(*)) OVER (PARTITION BY bin) AS p FROM drives GROUP BY bin, result),
lm AS (SELECT result, count(*) * 1.0 / sum(count(*)) OVER () AS p FROM drives GROUP BY result),
tm AS (SELECT posteam AS team, result, count(*) * 1.0 / sum(count(*)) OVER (PARTITION BY posteam) AS p FROM drives GROUP BY posteam, result),
x AS (SELECT team, bin, result, cond.p * tm.p / (lm.p + 1e-9) AS w FROM cond JOIN lm USING (result) JOIN tm USING (result))
SELECT team, bin, result, round(w / sum(w) OVER (PARTITION BY team, bin), 8) AS p FROM x"""))
def tilted_table(spark, folder):
    """League outcomes by start bin, tilted toward each entity's own tendencies."""
    share = lambda df, keys: df.withColumn("p", F.col("n") / F.sum("n").over(Window.partitionBy(*keys))).drop("n")
    counts = base.drives(spark, folder).groupBy("posteam", "bin", "result").agg(F.count("*").alias("n"))
    cond = share(counts.groupBy("bin", "result").agg(F.sum("n").alias("n")), ["bin"])
    team = share(counts.groupBy(F.col("posteam").alias("team"), "result").agg(F.sum("n").alias("n")), ["team"]).withColumnRenamed("p", "tp")
    league = counts.groupBy("result").agg(F.sum("n").alias("n"))
    league = league.select("result", (F.col("n") / league.agg(F.sum("n")).scalar()).alias("lp"))
    tilted = team.join(league, "result").join(cond, "result").withColumn("w", F.col("p") * F.col("tp") / (F.col("lp") + 1e-9))
    return tilted.select("team", "bin", "result", r(F.col("w") / F.sum("w").over(Window.partitionBy("team", "bin")), 8).alias("p"))


@query("h14_tri_state_flag", """
SELECT event_id, CAST(CASE event_id % 5 WHEN 0 THEN true WHEN 3 THEN true ELSE false END AS INT) AS provisional FROM events""")
def tri_state_flag(spark, folder):
    k = F.col("event_id") % 5
    flag = F.when(k == 0, " False").when(k == 1, "True").when(k == 2, F.lit(None)).when(k == 3, "no").otherwise("1")
    return read_table(spark, folder, "events", ["event_id"]).select("event_id", sc.is_provisional(flag).cast("int").alias("provisional"))


@query("h15_block_id", with_views("contests", "SELECT game_id, season * 100 + week AS block FROM contests"))
def block_id(spark, folder):
    return base.contests(spark, folder).select("game_id", sc.block_id(F.col("season"), F.col("week")).alias("block"))


@query("h16_wide_to_long", with_views("preds", """
SELECT game_id, model, round(home_pred, 6) AS home, round(away_pred, 6) AS away FROM preds WHERE model IN ('baseline', 'composite')"""))
def wide_to_long(spark, folder):
    from priorlake.operators.ledger import long_forecasts, wide_forecasts

    df = base.predictions(spark, folder).filter("model IN ('baseline', 'composite')")
    out = long_forecasts(wide_forecasts(df, ["baseline", "composite"], ["game_id"]))
    return out.select("game_id", "model", *rs("home", "away"))
