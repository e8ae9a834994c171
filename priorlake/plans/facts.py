"""Sources and contracts (A), predicates (B), joins (C) and aggregates (D)."""
from __future__ import annotations

import datetime as dt

from pyspark.sql import Window
from pyspark.sql import functions as F

from priorlake.functions import scalars as sc
from priorlake.operators import assemble, folds, prefix, quantiles, roster, rollup, rules
from priorlake.plans import base
from priorlake.plans.base import MEASURES, OUTCOME_NAMES, contests, query, r, rs, view, with_views
from priorlake.sources import contracts
from priorlake.sources.tables import parts_of, read_table
from priorlake.sources.views import event_log, lines, plays

# ------------------------------------------------------------------ A. contracts

NOW = "2001-07-02 12:00:00"


@query("a7_season_resolver", """
SELECT year(o_orderdate) - CAST(strftime(o_orderdate, '%m%d') < '0315' AS INT) AS season, count(*) AS n FROM orders GROUP BY 1""")
def season_resolver(spark, folder):
    orders = read_table(spark, folder, "orders", ["o_orderdate"])
    return orders.groupBy(sc.season_of(F.to_date("o_orderdate")).cast("long").alias("season")).agg(F.count("*").alias("n"))


@query("a8_newest_season_fallback", with_views("contests", "SELECT season, count(*) AS n FROM contests GROUP BY season"))
def newest_season_fallback(spark, folder):
    df = contests(spark, folder)
    kick = df.withColumn("kickoff", F.col("gameday").cast("timestamp"))
    seasons = [row["season"] for row in df.select("season").distinct().orderBy("season").collect()]
    out = contracts.load_seasons(df, kick, [*seasons, max(seasons) + 1], dt.datetime(2002, 1, 5))
    return out.groupBy("season").agg(F.count("*").alias("n"))


@query("a9_pull_summary", with_views("contests", """
SELECT 'contests' AS dataset, count(*) AS rows, min(season) AS first_season, max(season) AS last_season FROM contests"""))
def pull_summary(spark, folder):
    return contracts.pull_summary(contests(spark, folder), "contests")


view("sched", ["contests"], f"""
SELECT game_id, season, week, home_team, away_team, gameday, gametime,
       CAST(gameday AS TIMESTAMP) + to_hours(CAST(coalesce(substr(gametime, 1, 2), '13') AS INT)) AS kickoff,
       CASE WHEN gameday < DATE '2001-07-01' OR home_team = 1 THEN home_score END AS home_score,
       CASE WHEN gameday < DATE '2001-07-01' OR home_team = 1 THEN away_score END AS away_score
FROM contests WHERE NOT (gameday = DATE '2000-03-01' AND home_team = 2)""")
view("finals", ["plays"], """
SELECT game_id, sum(CASE WHEN posteam < defteam THEN qty ELSE 0 END) + max(CASE WHEN posteam % 23 = 7 AND month = DATE '1999-02-01' THEN 1 ELSE 0 END) AS total_home_score,
       sum(CASE WHEN posteam > defteam THEN qty ELSE 0 END) AS total_away_score
FROM plays WHERE NOT (month = DATE '2001-07-01' AND least(posteam, defteam) = 1) AND NOT (month = DATE '1998-05-01' AND posteam = 4 OR month = DATE '1998-05-01' AND defteam = 4)
GROUP BY game_id""")


def schedule(spark, folder):
    c = F.col
    hour = F.coalesce(F.substring("gametime", 1, 2), F.lit("13")).cast("int")
    known = (c("gameday") < "2001-07-01") | (c("home_team") == 1)
    return contests(spark, folder).filter(~((c("gameday") == "2000-03-01") & (c("home_team") == 2))).select(
        "game_id", "season", "week", "home_team", "away_team", "gameday", "gametime",
        (c("gameday").cast("timestamp") + F.make_dt_interval(F.lit(0), hour)).alias("kickoff"),
        F.when(known, c("home_score")).alias("home_score"), F.when(known, c("away_score")).alias("away_score"),
    )


def finals(spark, folder):
    c = F.col
    dropped = (c("month") == "2001-07-01") & (F.least("posteam", "defteam") == 1) | (c("month") == "1998-05-01") & (
        (c("posteam") == 4) | (c("defteam") == 4)
    )
    bump = F.max(F.when((c("posteam") % 23 == 7) & (c("month") == "1999-02-01"), 1).otherwise(0))
    home = F.sum(F.when(c("posteam") < c("defteam"), c("qty")).otherwise(0.0))
    away = F.sum(F.when(c("posteam") > c("defteam"), c("qty")).otherwise(0.0))
    return plays(spark, folder).filter(~dropped).groupBy("game_id").agg(
        (home + bump).alias("total_home_score"), away.alias("total_away_score")
    )


view("problems", ["sched", "finals", "plays"], f"""
SELECT 'error' AS severity, 'overdue_result' AS check, game_id FROM sched
WHERE home_score IS NULL AND kickoff < TIMESTAMP '{NOW}' - INTERVAL 24 HOUR
UNION ALL
SELECT CASE WHEN kickoff > TIMESTAMP '{NOW}' - INTERVAL 36 HOUR THEN 'lagging' ELSE 'error' END,
       CASE WHEN kickoff > TIMESTAMP '{NOW}' - INTERVAL 36 HOUR THEN 'events_lagging' ELSE 'events_missing' END, game_id
FROM sched WHERE home_score IS NOT NULL AND game_id NOT IN (SELECT game_id FROM finals)
UNION ALL
SELECT 'error', 'score_mismatch', game_id FROM sched JOIN finals USING (game_id)
WHERE home_score IS NOT NULL AND (total_home_score <> home_score OR total_away_score <> away_score)
UNION ALL
SELECT 'warning', 'no_appearances', game_id FROM sched WHERE home_score IS NOT NULL AND season = (SELECT max(season) FROM sched)
  AND game_id NOT IN (SELECT game_id FROM plays WHERE kind = 'A')""")


def problems(spark, folder):
    seen = plays(spark, folder).filter("kind = 'A'")
    return contracts.completeness(schedule(spark, folder), finals(spark, folder), seen, F.lit(NOW).cast("timestamp"))


@query("a10_completeness", with_views("problems", "SELECT * FROM problems"))
def completeness(spark, folder):
    return problems(spark, folder)


@query("a11_final_state", with_views("plays", """
SELECT game_id, max(qty) AS max_qty, max(price) AS max_price, max(l_linenumber) AS last_line FROM plays GROUP BY game_id"""))
def final_state(spark, folder):
    return plays(spark, folder).groupBy("game_id").agg(
        F.max("qty").alias("max_qty"), F.max("price").alias("max_price"), F.max("l_linenumber").alias("last_line")
    )


@query("a12_action_code", with_views("problems", """
SELECT CASE WHEN errors > 0 THEN 1 WHEN lagging > 0 THEN 3 ELSE 0 END AS code, errors, lagging, warnings FROM (
SELECT count(*) FILTER (severity = 'error') AS errors, count(*) FILTER (severity = 'lagging') AS lagging,
       count(*) FILTER (severity = 'warning') AS warnings FROM problems)"""))
def action_code(spark, folder):
    return contracts.action_code(problems(spark, folder))


@query("a13_contract", """
SELECT 'rows' AS check, CAST(count(*) AS DOUBLE) AS value FROM lineitem
UNION ALL SELECT 'null_share:l_shipdate', avg(CASE WHEN l_shipdate IS NULL THEN 1.0 ELSE 0.0 END) FROM lineitem
UNION ALL SELECT 'in_range_share:l_discount', round(avg(CASE WHEN l_discount BETWEEN 0.01 AND 0.09 THEN 1.0 ELSE 0.0 END), 9) FROM lineitem
UNION ALL SELECT 'repeated_keys', CAST(count(*) AS DOUBLE) FROM (SELECT 1 FROM lineitem GROUP BY l_orderkey, l_linenumber HAVING count(*) > 1)
UNION ALL SELECT 'orphans', CAST(count(*) AS DOUBLE) FROM lineitem WHERE l_partkey NOT IN (SELECT p_partkey FROM part WHERE p_size > 3)""")
def contract(spark, folder):
    line = read_table(spark, folder, "lineitem", ["l_orderkey", "l_linenumber", "l_discount", "l_shipdate", "l_partkey"])
    spec = contracts.Contract(
        required=("l_orderkey", "l_linenumber"), unique=("l_orderkey", "l_linenumber"),
        not_null=("l_shipdate",), ranges={"l_discount": (0.01, 0.09)},
    )
    part = read_table(spark, folder, "part", ["p_partkey", "p_size"]).filter("p_size > 3")
    lost = contracts.orphans(line, "l_partkey", part, "p_partkey").agg(F.count("*").cast("double").alias("value"))
    out = contracts.check_contract(line, spec).unionByName(lost.select(F.lit("orphans").alias("check"), "value"))
    return out.select("check", *rs("value", digits=9))


_PRINT = """SELECT season, count(*) AS rows, CAST(sum(CAST('0x' || substr(md5(game_id || '|' || CAST(home_score AS BIGINT) || '|' || CAST(away_score AS BIGINT)), 1, 15) AS BIGINT)) AS VARCHAR) AS content
FROM {0} WHERE home_score IS NOT NULL GROUP BY season"""


def played_print(df):
    cols = [F.col("game_id"), F.col("home_score").cast("long").cast("string"), F.col("away_score").cast("long").cast("string")]
    return contracts.fingerprint(df.filter(F.col("home_score").isNotNull()), cols, ["season"], digest="md5")


@query("a14_played_fingerprint", with_views("contests", _PRINT.format("contests")))
def played_fingerprint(spark, folder):
    return played_print(contests(spark, folder))


@query("a15_stale_inputs", with_views("contests", f"""
WITH current AS ({_PRINT.format('contests')}),
old AS (SELECT * REPLACE (CASE WHEN season = 1998 THEN home_score + 1 ELSE home_score END AS home_score) FROM contests WHERE season < 2000),
stored AS ({_PRINT.format('old')})
SELECT season, CAST(s.content IS DISTINCT FROM c.content OR s.rows IS DISTINCT FROM c.rows AS INT) AS stale
FROM current c FULL JOIN stored s USING (season)"""))
def stale_inputs(spark, folder):
    now = contests(spark, folder)
    old = now.filter("season < 2000").withColumn("home_score", F.col("home_score") + (F.col("season") == 1998).cast("int"))
    return contracts.stale(played_print(old), played_print(now), ["season"])


@query("a16_rebuild_check", with_views("contests plays", """
WITH again AS (SELECT game_id, coalesce(sum(qty) FILTER (posteam < defteam), 0) AS home_score, coalesce(sum(qty) FILTER (posteam > defteam), 0) AS away_score FROM plays GROUP BY game_id),
kept AS (SELECT game_id, home_score, away_score FROM contests)
SELECT 'columns_added' AS check, 0 AS n UNION ALL SELECT 'columns_lost', 0
UNION ALL SELECT 'rows_added', count(*) FROM (SELECT * FROM again EXCEPT ALL SELECT * FROM kept)
UNION ALL SELECT 'rows_lost', count(*) FROM (SELECT * FROM kept EXCEPT ALL SELECT * FROM again)"""))
def rebuild_check(spark, folder):
    from priorlake.sources.views import contests as fresh

    cols = ["game_id", "home_score", "away_score"]
    return contracts.rebuild_differences(fresh(spark, folder).select(*cols), contests(spark, folder).select(*cols))


@query("a17_prediction_sanity", with_views("preds", "SELECT model, " + ", ".join(
    f"count(*) FILTER ({s}_pred IS NULL) AS {s}_null, count(*) FILTER ({s}_pred < 0) AS {s}_negative, "
    f"count(*) FILTER ({s}_pred > 60) AS {s}_implausible, CAST(min({s}_pred) = max({s}_pred) AS INT) AS {s}_constant" for s in ("home", "away"))
    + ", count(*) FILTER (home_score IS NULL OR away_score IS NULL) AS unscored, count(*) - count(DISTINCT game_id) AS repeated FROM preds GROUP BY model"))
def prediction_sanity(spark, folder):
    return contracts.prediction_problems(base.predictions(spark, folder), 60.0)


# ------------------------------------------------------------------ B. predicates


@query("b1_normalise_codes", """
SELECT CASE c_mktsegment WHEN 'BUILDING' THEN 'CONSTRUCTION' WHEN 'MACHINERY' THEN 'INDUSTRY' ELSE c_mktsegment END AS segment, count(*) AS n
FROM customer GROUP BY 1""")
def normalise_codes(spark, folder):
    df = read_table(spark, folder, "customer", ["c_mktsegment"])
    df = assemble.normalise_codes(df, {"BUILDING": "CONSTRUCTION", "MACHINERY": "INDUSTRY"}, ["c_mktsegment"])
    return df.groupBy(F.col("c_mktsegment").alias("segment")).agg(F.count("*").alias("n"))


@query("b2_counted_events", with_views("plays", """
SELECT posteam AS team, count(*) AS n, round(avg(success), 9) AS success FROM plays
WHERE kind IN ('A', 'R') AND posteam IS NOT NULL GROUP BY posteam"""))
def counted_events(spark, folder):
    return plays(spark, folder).filter(rollup.counted()).groupBy(F.col("posteam").alias("team")).agg(
        F.count("*").alias("n"), r(F.avg("success"), 9).alias("success")
    )


@query("b4_in_doubt_range", with_views("details", "SELECT kind, count(*) AS n FROM details WHERE kind IS NOT NULL AND wp BETWEEN 0.20 AND 0.80 GROUP BY kind"))
def in_doubt_range(spark, folder):
    real = F.col("kind").isNotNull() & F.col("posteam").isNotNull()
    return base.details(spark, folder).filter(real & F.col("wp").between(0.20, 0.80)).groupBy("kind").agg(F.count("*").alias("n"))


ARMS = ["all_events", "counted", "first_kind"]


def filter_predicates():
    return dict(zip(ARMS, [F.lit(True), rollup.counted(), F.col("kind") == "A"]))


@query("b5_filter_arms", with_views("plays", """
SELECT game_id, posteam AS team, count(*) AS all_events_n, round(avg(success), 9) AS all_events_success,
       count(*) FILTER (kind IN ('A', 'R')) AS counted_n, round(avg(success) FILTER (kind IN ('A', 'R')), 9) AS counted_success,
       count(*) FILTER (kind = 'A') AS first_kind_n, round(avg(success) FILTER (kind = 'A'), 9) AS first_kind_success
FROM plays GROUP BY game_id, posteam"""))
def filter_arms(spark, folder):
    df = plays(spark, folder).withColumn("team", F.col("posteam"))
    out = rollup.arm_rates(df, ["game_id", "team"], filter_predicates(), {"success": "success"})
    return out.select("game_id", "team", *[f"{a}_n" for a in ARMS], *rs(*[f"{a}_success" for a in ARMS], digits=9))


@query("b6_masked_contribution", with_views("facts", f"""
SELECT season, week, count(*) AS rows, count(CASE WHEN week <> {base.FINALE} THEN team_score END) AS feeding FROM facts GROUP BY season, week"""))
def masked_contribution(spark, folder):
    df = base.facts(spark, folder)
    return df.groupBy("season", "week").agg(F.count("*").alias("rows"), F.count(F.when(~base.finale(), F.col("team_score"))).alias("feeding"))


@query("b9_context_flags", with_views("entities", "SELECT game_id, team, is_neutral_site, is_playoff FROM entities"))
def context_flags(spark, folder):
    return rollup.entity_rows(contests(spark, folder)).select("game_id", "team", "is_neutral_site", "is_playoff")


_IMP = ["home_pregame_team_score", "away_pregame_team_score", "home_pregame_off_epa_per_play"]


@query("b10_fold_imputation", with_views("model_table folds", "SELECT m.game_id, " + ", ".join(
    f"round(coalesce(m.{c}, (SELECT avg(x.{c}) FROM model_table x WHERE x.t < f.cutoff)), 6) AS {c}" for c in _IMP)
    + " FROM model_table m JOIN folds f USING (season, week)"))
def fold_imputation(spark, folder):
    table = base.model_table(spark, folder)
    sums = {}
    for c in _IMP:
        sums[f"s_{c}"], sums[f"n_{c}"] = F.col(c), F.col(c).isNotNull().cast("int")
    means = folds.training_sums(table, base.folds(spark, folder), sums).select(
        "season", "week", *[sc.safe_div(F.col(f"s_{c}"), F.col(f"n_{c}")).alias(f"mean_{c}") for c in _IMP]
    )
    return assemble.impute(table, means, ["season", "week"], _IMP).select("game_id", *rs(*_IMP))


@query("b11_late_row_guard", with_views("reports team_games", """
SELECT r.event_id, CAST(r.date_modified IS NULL AS INT) AS undated FROM reports r JOIN team_games g USING (game_id, team)
WHERE r.date_modified IS NULL OR r.date_modified < g.kickoff"""))
def late_row_guard(spark, folder):
    joined = base.reports(spark, folder).join(base.team_games(spark, folder).select("game_id", "team", "kickoff"), ["game_id", "team"])
    kept = roster.before_start(joined, "date_modified", "kickoff")
    return kept.select("event_id", F.col("date_modified").isNull().cast("int").alias("undated"))


@query("b12_pending", with_views("sched", f"""
SELECT game_id FROM sched WHERE season = 2001 AND week = 7 AND (gametime IS NULL OR kickoff > TIMESTAMP '{NOW}' - INTERVAL 24 HOUR + INTERVAL 15 MINUTE)"""))
def pending(spark, folder):
    now = F.lit(NOW).cast("timestamp") - F.expr("INTERVAL 24 HOURS")
    week = schedule(spark, folder).filter("season = 2001 AND week = 7")
    kick = F.when(F.col("gametime").isNotNull(), F.col("kickoff"))
    return week.filter(kick.isNull() | (kick > now + F.expr("INTERVAL 15 MINUTES"))).select("game_id")


@query("b13_near_window", with_views("sched", f"""
SELECT game_id FROM sched WHERE kickoff BETWEEN TIMESTAMP '{NOW}' - INTERVAL 2 DAY AND TIMESTAMP '{NOW}' + INTERVAL 9 DAY"""))
def near_window(spark, folder):
    now = F.lit(NOW).cast("timestamp")
    return schedule(spark, folder).filter(
        F.col("kickoff").between(now - F.expr("INTERVAL 2 DAYS"), now + F.expr("INTERVAL 9 DAYS"))
    ).select("game_id")


@query("b14_training_frame", with_views("sched", """
SELECT game_id, row_number() OVER (ORDER BY gameday, game_id) - 1 AS place FROM sched
WHERE home_score IS NOT NULL AND away_score IS NOT NULL AND gameday < DATE '2001-06-01'"""))
def training_frame(spark, folder):
    rows = schedule(spark, folder).filter(
        F.col("home_score").isNotNull() & F.col("away_score").isNotNull() & (F.col("gameday") < "2001-06-01")
    )
    return prefix.position(rows, [], "gameday", ["game_id"], "place").select("game_id", "place")


@query("b15_interactions", with_views("model_table", """
SELECT game_id, round(home_pregame_off_epa_per_play * away_pregame_def_epa_per_play, 12) AS home_matchup,
       round(away_pregame_off_epa_per_play * home_pregame_def_epa_per_play, 12) AS away_matchup FROM model_table"""))
def interactions(spark, folder):
    terms = [
        ("home_matchup", "home_pregame_off_epa_per_play", "away_pregame_def_epa_per_play"),
        ("away_matchup", "away_pregame_off_epa_per_play", "home_pregame_def_epa_per_play"),
    ]
    return assemble.interactions(base.model_table(spark, folder), terms).select("game_id", *rs("home_matchup", "away_matchup", digits=12))


# ------------------------------------------------------------------ C. joins


@query("c3_full_outer_facts", with_views("details", """
SELECT coalesce(o.game_id, d.game_id) AS game_id, coalesce(o.team, d.team) AS team, o.n AS off_n, d.n AS def_n FROM
 (SELECT game_id, posteam AS team, count(*) AS n FROM details WHERE kind = 'A' GROUP BY ALL) o FULL JOIN
 (SELECT game_id, defteam AS team, count(*) AS n FROM details WHERE kind = 'A' GROUP BY ALL) d ON o.game_id = d.game_id AND o.team = d.team"""))
def full_outer_facts(spark, folder):
    df = base.details(spark, folder).filter("kind = 'A'")
    off = df.groupBy("game_id", F.col("posteam").alias("team")).agg(F.count("*").alias("off_n"))
    faced = df.groupBy("game_id", F.col("defteam").alias("team")).agg(F.count("*").alias("def_n"))
    return off.join(faced, ["game_id", "team"], "full_outer").select("game_id", "team", "off_n", "def_n")


@query("c5_oriented_pairs", with_views("facts contests", """
SELECT c.game_id, h.off_plays AS home_off_plays, a.off_plays AS away_off_plays FROM contests c
JOIN facts h ON h.game_id = c.game_id AND h.team = c.home_team JOIN facts a ON a.game_id = c.game_id AND a.team = c.away_team"""))
def oriented_pairs(spark, folder):
    out = assemble.oriented_pairs(base.facts(spark, folder), contests(spark, folder), ["off_plays"])
    return out.select("game_id", "home_off_plays", "away_off_plays")


_MT = [f"{s}_pregame_{m}" for s in ("home", "away") for m in MEASURES]


@query("c6_contest_assembly", with_views("model_table", "SELECT game_id, season, week, home_team, away_team, home_score, away_score, is_neutral_site, is_playoff, went_to_ot, "
       + ", ".join(f"round({c}, 6) AS {c}" for c in _MT) + " FROM model_table"))
def contest_assembly(spark, folder):
    return base.model_table(spark, folder).select(
        "game_id", "season", "week", "home_team", "away_team", "home_score", "away_score", "is_neutral_site", "is_playoff",
        "went_to_ot", *rs(*_MT),
    )


@query("c7_lookup_join", with_views("entities", """
SELECT e.game_id, e.team, n_name AS name FROM entities e JOIN nation ON n_nationkey = e.team WHERE n_regionkey <> 0"""))
def lookup_join(spark, folder):
    nation = read_table(spark, folder, "nation", ["n_nationkey", "n_name", "n_regionkey"]).filter("n_regionkey <> 0")
    return rollup.entity_rows(contests(spark, folder)).join(nation, F.col("team") == F.col("n_nationkey")).select(
        "game_id", "team", F.col("n_name").alias("name")
    )


@query("c8_semi_join", with_views("contests folds", "SELECT game_id FROM contests WHERE (season, week) IN (SELECT (season, week) FROM folds)"))
def semi_join(spark, folder):
    return contests(spark, folder).join(base.folds(spark, folder), ["season", "week"], "left_semi").select("game_id")


@query("c9_missing_from_training", with_views("sched preds", """
SELECT game_id FROM sched WHERE home_score IS NOT NULL AND gameday < DATE '2001-07-01' AND game_id NOT IN (SELECT game_id FROM preds)"""))
def missing_from_training(spark, folder):
    done = schedule(spark, folder).filter(F.col("home_score").isNotNull() & (F.col("gameday") < "2001-07-01"))
    return done.join(base.predictions(spark, folder), "game_id", "left_anti").select("game_id")


@query("c10_member_agreement", with_views("preds", """
SELECT game_id, 'home_score' AS column, count(*) AS members, 2 AS versions FROM preds WHERE model <> 'composite'
GROUP BY game_id UNION ALL SELECT game_id, 'week', count(*), 1 FROM preds WHERE model <> 'composite' GROUP BY game_id"""))
def member_agreement(spark, folder):
    df = base.predictions(spark, folder)
    members = {
        "league_average": df.filter("model = 'league_average'"),
        "baseline": df.filter("model = 'baseline'").withColumn("home_score", F.col("home_score") + 1),
    }
    out = assemble.require_same_keys(members, "game_id", ["home_score", "week"])
    return out.select("game_id", "column", "members", "versions")


@query("c11_member_pivot", with_views("preds", """
SELECT game_id, round(max(home_pred) FILTER (model = 'league_average'), 6) AS league_average, round(max(home_pred) FILTER (model = 'baseline'), 6) AS baseline
FROM preds GROUP BY game_id HAVING count(*) FILTER (model IN ('league_average', 'baseline')) = 2"""))
def member_pivot(spark, folder):
    members = ["league_average", "baseline"]
    wide = base.predictions(spark, folder).groupBy("game_id").pivot("model", members).agg(F.max("home_pred"))
    return wide.dropna(subset=members).select("game_id", *rs(*members))


@query("c12_paired_models", with_views("preds", """
SELECT b.game_id, round(c.home_pred - b.home_pred, 6) AS d_home FROM preds b JOIN preds c USING (game_id)
WHERE b.model = 'baseline' AND c.model = 'composite'"""))
def paired_models(spark, folder):
    df = base.predictions(spark, folder)
    b = df.filter("model = 'baseline'").select("game_id", F.col("home_pred").alias("b"))
    c = df.filter("model = 'composite'").select("game_id", F.col("home_pred").alias("c"))
    return b.join(c, "game_id").select("game_id", r(F.col("c") - F.col("b")).alias("d_home"))


@query("c14_attach_sided", with_views("contests lineups", """
SELECT c.game_id, h.n AS home_n, a.n AS away_n FROM contests c
LEFT JOIN (SELECT team, t, count(*) AS n FROM lineups GROUP BY ALL) h ON h.team = c.home_team AND h.t = c.t
LEFT JOIN (SELECT team, t, count(*) AS n FROM lineups GROUP BY ALL) a ON a.team = c.away_team AND a.t = c.t"""))
def attach_sided(spark, folder):
    n = base.lineups(spark, folder).groupBy("team", "t").agg(F.count("*").alias("n"))
    return assemble.attach_sided(contests(spark, folder), n, ["t"], ["n"]).select("game_id", "home_n", "away_n")


@query("c15_cutoff_join", with_views("contests", """
WITH k AS (SELECT season, week, min(t) AS cutoff FROM contests GROUP BY ALL)
SELECT k.season, k.week, count(c.t) AS n_before, coalesce(sum(c.home_score), 0) AS home_before
FROM k LEFT JOIN contests c ON c.t < k.cutoff GROUP BY ALL"""))
def cutoff_join(spark, folder):
    df = contests(spark, folder)
    out = folds.training_sums(df, folds.cutoffs(df), {"n_before": F.lit(1), "home_before": F.col("home_score")})
    return out.select("season", "week", F.col("n_before").cast("long").alias("n_before"), "home_before")


@query("c16_rows_for_ids", with_views("contests", """
SELECT c.game_id, row_number() OVER (ORDER BY c.home_score DESC, c.game_id) AS place, c.away_score
FROM contests c WHERE season = 2001 AND week = 6"""))
def rows_for_ids(spark, folder):
    df = contests(spark, folder)
    wanted = df.filter("season = 2001 AND week = 6")
    order = wanted.withColumn("place", F.row_number().over(Window.partitionBy("season", "week").orderBy(F.desc("home_score"), "game_id")))
    found = order.select("game_id", "place").join(df.select("game_id", "away_score"), "game_id", "left")
    missing = F.when(F.col("away_score").isNull(), F.raise_error(F.concat(F.lit("absent from the table: "), F.col("game_id"))).cast("double"))
    return found.select("game_id", F.col("place").cast("long").alias("place"), F.coalesce(missing, F.col("away_score")).alias("away_score"))


@query("c17_segment_context", with_views("drives contests", """
SELECT c.location, c.overtime, count(*) AS n, round(sum(d.points), 6) AS points FROM drives d LEFT JOIN contests c USING (game_id) GROUP BY ALL"""))
def segment_context(spark, folder):
    per = base.drives(spark, folder).groupBy("game_id").agg(F.count("*").alias("n"), F.sum("points").alias("points"))
    joined = per.join(contests(spark, folder).select("game_id", "location", "overtime"), "game_id", "left")
    return joined.groupBy("location", "overtime").agg(F.sum("n").alias("n"), F.round(F.sum("points"), 6).alias("points"))


# ------------------------------------------------------------------ D. aggregates

_OD = [*rollup.OFFENSE_COLS, *rollup.DEFENSE_COLS]
_ODR = [c for c in _OD if not c.endswith("plays")]


@query("d1_d2_side_rollups", with_views("facts", "SELECT game_id, team, " + ", ".join(f"round({c}, 8) AS {c}" if c in _ODR else c for c in _OD) + " FROM facts"))
def side_rollups(spark, folder):
    df = base.facts(spark, folder)
    return df.select("game_id", "team", *[r(c, 8).alias(c) if c in _ODR else F.col(c) for c in _OD])


@query("d3_entity_rows", with_views("entities", "SELECT game_id, season, week, team, opponent, team_score, opp_score, is_home, rest_days FROM entities"))
def entity_rows(spark, folder):
    return rollup.entity_rows(contests(spark, folder)).select(
        "game_id", "season", "week", "team", "opponent", "team_score", "opp_score", "is_home", "rest_days"
    )


@query("d4_pace", with_views("details", """
SELECT game_id, posteam AS team, count(*) AS off_plays, count(DISTINCT drive) AS off_drives, round(avg(no_huddle), 9) AS off_no_huddle_rate,
       round(avg(dropback), 9) AS off_dropback_rate, round(avg(pass_oe), 9) AS off_pass_oe, round(count(*) / count(DISTINCT drive), 9) AS off_plays_per_drive
FROM details GROUP BY ALL"""))
def pace(spark, folder):
    return rollup.pace(base.details(spark, folder), parts_of(spark, folder, "lineitem")).select(
        "game_id", "team", "off_plays", "off_drives",
        *rs("off_no_huddle_rate", "off_dropback_rate", "off_pass_oe", "off_plays_per_drive", digits=9),
    )


@query("d5_tempo", """
SELECT user_id, round(avg(gap), 6) AS sec_per_play, count(*) AS n FROM (
  SELECT user_id, (epoch_us(ts) - epoch_us(lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id))) / 1e6 AS gap FROM events)
WHERE gap BETWEEN 0 AND 36000 GROUP BY user_id""")
def tempo(spark, folder):
    df = event_log(spark, folder)
    gaps = prefix.neighbour(df, ["user_id"], ["us", "event_id"], {"prev": "us"}, step=-1, block=prefix.day_blocks(F.col("us")))
    gap = (F.col("us") - F.col("prev")) / 1e6
    return gaps.withColumn("gap", gap).filter(F.col("gap").between(0, 36000)).groupBy("user_id").agg(
        r(F.avg("gap")).alias("sec_per_play"), F.count("*").alias("n")
    )


@query("d6_competitive", with_views("details", """
SELECT coalesce(o.game_id, d.game_id) AS game_id, coalesce(o.team, d.team) AS team, * EXCLUDE (game_id, team) FROM
(SELECT game_id, posteam AS team, round(avg(epa), 8) AS off_epa_competitive, round(avg(success), 8) AS off_success_competitive, count(*) AS off_competitive_plays
 FROM details WHERE wp BETWEEN 0.2 AND 0.8 GROUP BY ALL) o FULL JOIN
(SELECT game_id, defteam AS team, round(avg(epa), 8) AS def_epa_competitive, round(avg(success), 8) AS def_success_competitive
 FROM details WHERE wp BETWEEN 0.2 AND 0.8 GROUP BY ALL) d ON o.game_id = d.game_id AND o.team = d.team"""))
def competitive(spark, folder):
    return rollup.competitive(base.details(spark, folder)).select(
        "game_id", "team", "off_competitive_plays",
        *rs("off_epa_competitive", "off_success_competitive", "def_epa_competitive", "def_success_competitive", digits=8),
    )


@query("d7_turnover_luck", with_views("details", """
SELECT coalesce(o.game_id, d.game_id) AS game_id, coalesce(o.team, d.team) AS team, * EXCLUDE (game_id, team) FROM
(SELECT game_id, posteam AS team, CAST(sum(fumble) AS BIGINT) AS off_fumbles, CAST(sum(fumble_lost) AS BIGINT) AS off_fumbles_lost, CAST(sum(interception) AS BIGINT) AS off_interceptions,
        CASE WHEN sum(fumble) > 0 THEN round(1 - sum(fumble_lost) / sum(fumble), 9) END AS off_fumble_retain_rate FROM details GROUP BY ALL) o FULL JOIN
(SELECT game_id, defteam AS team, CAST(sum(fumble) AS BIGINT) AS def_fumbles_forced, CAST(sum(fumble_lost) AS BIGINT) AS def_fumbles_recovered, CAST(sum(interception) AS BIGINT) AS def_interceptions
 FROM details GROUP BY ALL) d ON o.game_id = d.game_id AND o.team = d.team"""))
def turnover_luck(spark, folder):
    out = rollup.turnover_luck(base.details(spark, folder))
    return out.withColumn("off_fumble_retain_rate", r("off_fumble_retain_rate", 9))


@query("d8_attempts", with_views("details", """
SELECT game_id, posteam AS team, count(*) AS fg_attempts, count(*) FILTER (fg_result = 'made') AS fg_made, round(avg(qty), 9) AS fg_avg_distance,
       round(count(*) FILTER (fg_result = 'made') / count(*), 9) AS fg_pct FROM details WHERE fg_result IS NOT NULL GROUP BY ALL"""))
def attempts(spark, folder):
    out = rollup.attempts(base.details(spark, folder), "fg_result", "made", "qty")
    return out.select("game_id", "team", "fg_attempts", "fg_made", *rs("fg_avg_distance", "fg_pct", digits=9))


@query("d9_segments", with_views("drives", "SELECT game_id, posteam, drive, start, result, points, def_points FROM drives"))
def segments(spark, folder):
    return base.drives(spark, folder).select("game_id", "posteam", "drive", "start", "result", "points", "def_points")


_RATE_SQL = ", ".join(f"count(*) FILTER (result = '{o}') AS off_{o.lower().replace(' ', '_')}_count, round(count(*) FILTER (result = '{o}') / count(*), 9) AS off_{o.lower().replace(' ', '_')}_rate" for o in OUTCOME_NAMES)


@query("d10_outcome_rates", with_views("drives", f"SELECT game_id, posteam AS team, count(*) AS off_n, {_RATE_SQL} FROM drives GROUP BY ALL"))
def outcome_rates(spark, folder):
    out = rollup.outcome_rates(base.drives(spark, folder), "posteam", "off", OUTCOME_NAMES)
    names = [f"off_{o.lower().replace(' ', '_')}" for o in OUTCOME_NAMES]
    return out.select("game_id", "team", "off_n", *[f"{n}_count" for n in names], *rs(*[f"{n}_rate" for n in names], digits=9))


@query("d11_two_channel_totals", with_views("drives", """
SELECT coalesce(o.game_id, d.game_id) AS game_id, coalesce(o.team, d.team) AS team,
       round(coalesce(o.p, 0) + coalesce(d.g, 0), 6) AS est_points_for, round(coalesce(d.p, 0) + coalesce(o.g, 0), 6) AS est_points_against FROM
(SELECT game_id, posteam AS team, sum(points) AS p, sum(def_points) AS g FROM drives GROUP BY ALL) o FULL JOIN
(SELECT game_id, defteam AS team, sum(points) AS p, sum(def_points) AS g FROM drives GROUP BY ALL) d ON o.game_id = d.game_id AND o.team = d.team"""))
def two_channel_totals(spark, folder):
    per = base.drives(spark, folder).groupBy("game_id", "posteam", "defteam").agg(F.sum("points").alias("p"), F.sum("def_points").alias("g"))
    both = per.select(
        "game_id",
        F.explode(F.array(
            F.struct(F.col("posteam").alias("team"), F.col("p").alias("f"), F.col("g").alias("a")),
            F.struct(F.col("defteam").alias("team"), F.col("g").alias("f"), F.col("p").alias("a")),
        )).alias("_s"),
    ).select("game_id", "_s.*")
    return both.groupBy("game_id", "team").agg(r(F.sum("f")).alias("est_points_for"), r(F.sum("a")).alias("est_points_against"))


@query("d12_dominant_actor", with_views("plays", """
SELECT game_id, posteam, actor, n AS attempts FROM (
  SELECT game_id, posteam, l_suppkey AS actor, count(*) AS n FROM plays WHERE kind = 'A' GROUP BY ALL)
QUALIFY row_number() OVER (PARTITION BY game_id, posteam ORDER BY n DESC, actor) = 1"""))
def dominant_actor(spark, folder):
    df = plays(spark, folder).filter("kind = 'A'").withColumn("actor", F.col("l_suppkey"))
    return rollup.dominant_actor(df, ["game_id", "posteam"], "actor")


@query("d13_actor_stats", with_views("plays", """
SELECT game_id, posteam, l_suppkey AS actor, count(*) AS attempts, round(avg(epa), 8) AS epa, round(avg(cpoe), 8) AS cpoe FROM plays
WHERE kind = 'A' GROUP BY ALL"""))
def actor_stats(spark, folder):
    return plays(spark, folder).filter("kind = 'A'").groupBy("game_id", "posteam", F.col("l_suppkey").alias("actor")).agg(
        F.count("*").alias("attempts"), r(F.avg("epa"), 8).alias("epa"), r(F.avg("cpoe"), 8).alias("cpoe")
    )


@query("d14_impact_sum", with_views("lines", """
SELECT buyer AS team, CAST(sum(CAST(price AS DECIMAL(18, 2))) AS DOUBLE) AS total, max(disc) AS worst FROM lines GROUP BY ALL"""))
def impact_sum(spark, folder):
    return lines(spark, folder).groupBy(F.col("buyer").alias("team")).agg(
        F.sum(F.col("price").cast("decimal(18,2)")).cast("double").alias("total"), F.max("disc").alias("worst")
    )


view("starts", ["details"], """
SELECT *, CASE result WHEN 'Touchdown' THEN 6.95 WHEN 'Field goal' THEN 3.0 ELSE 0.0 END::DOUBLE AS points FROM (
SELECT game_id, CAST(year(month) AS INT) AS season, posteam, defteam, drive,
  arg_min(start, ROW(l_linenumber, l_partkey, l_suppkey, day, qty, price, disc, tax)) AS start,
  arg_min(result, ROW(l_linenumber, l_partkey, l_suppkey, day, qty, price, disc, tax)) AS result
FROM details WHERE kind IN ('A', 'R') GROUP BY ALL)""")


def starts(spark, folder):
    """Segments from their first counted event."""
    found = base.contest_segments(base.details(spark, folder).filter(rollup.counted()))
    return found.select("game_id", F.year("month").alias("season"), "posteam", "defteam", "drive", "start", "result", "points", "def_points")


@query("d15_segment_starts", with_views("starts", "SELECT game_id, posteam, drive, start, points FROM starts"))
def segment_starts(spark, folder):
    return starts(spark, folder).select("game_id", "posteam", "drive", "start", "points")


@query("d16_start_means", with_views("starts", """
SELECT coalesce(o.game_id, d.game_id) AS game_id, coalesce(o.team, d.team) AS team, round(own_fp, 8) AS own_fp, own_drives, round(fp_allowed, 8) AS fp_allowed FROM
(SELECT game_id, posteam AS team, avg(start) AS own_fp, count(*) AS own_drives FROM starts GROUP BY ALL) o FULL JOIN
(SELECT game_id, defteam AS team, avg(start) AS fp_allowed FROM starts GROUP BY ALL) d ON o.game_id = d.game_id AND o.team = d.team"""))
def start_means(spark, folder):
    per = starts(spark, folder)
    own = per.groupBy("game_id", F.col("posteam").alias("team")).agg(r(F.avg("start"), 8).alias("own_fp"), F.count("*").alias("own_drives"))
    allowed = per.groupBy("game_id", F.col("defteam").alias("team")).agg(r(F.avg("start"), 8).alias("fp_allowed"))
    return own.join(allowed, ["game_id", "team"], "full_outer").select("game_id", "team", "own_fp", "own_drives", "fp_allowed")


@query("d17_quantile_curve", with_views("starts", """
WITH e AS (SELECT list_distinct(quantile_cont(start, [0, 0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9, 1.0])) AS edges FROM starts)
SELECT greatest(len(list_filter(edges, lambda x: x < start)) - 1, 0) AS bin, count(*) AS drives, round(avg(start), 6) AS mean_start, round(avg(points), 6) AS ep,
       round(avg(CASE WHEN result = 'Touchdown' THEN 1.0 ELSE 0.0 END), 6) AS td_rate FROM starts, e GROUP BY bin"""))
def quantile_curve(spark, folder):
    df = starts(spark, folder)
    edged = df.withColumn("edges", quantiles.quantile_edges(df, [], "start", 10).select("edges").scalar())
    return edged.groupBy(quantiles.bin_of(F.col("start"), F.col("edges")).alias("bin")).agg(
        F.count("*").alias("drives"), r(F.avg("start")).alias("mean_start"), r(F.avg("points")).alias("ep"),
        r(F.avg((F.col("result") == "Touchdown").cast("double"))).alias("td_rate"),
    )


@query("d18_within_group_slope", with_views("starts", """
WITH d AS (SELECT start - avg(start) OVER w AS x, points - avg(points) OVER w AS y FROM starts WINDOW w AS (PARTITION BY season, posteam))
SELECT round(regr_slope(y, x), 8) AS slope, count(*) AS n FROM d"""))
def within_group_slope(spark, folder):
    return rollup.within_group_slope(starts(spark, folder), ["season", "posteam"], "start", "points").select(*rs("slope", digits=8), "n")


_OUT_VALUES = ", ".join(f"('{o}')" for o in OUTCOME_NAMES)


@query("d19_outcome_given_bin", with_views("drives", f"""
WITH g AS (SELECT CAST(b.b AS INT) AS row, o.o AS col FROM range(0, 6) b(b), (VALUES {_OUT_VALUES}) o(o)),
c AS (SELECT g.row, g.col, count(d.drive) AS n FROM g LEFT JOIN drives d ON d.bin = g.row AND d.result = g.col GROUP BY ALL)
SELECT row, col, n, round((n + 1e-9) / sum(n + 1e-9) OVER (PARTITION BY row), 8) AS p FROM c"""))
def outcome_given_bin(spark, folder):
    out = rollup.crosstab(base.drives(spark, folder), F.col("bin"), F.col("result"), list(range(6)), OUTCOME_NAMES)
    return out.select("row", "col", "n", *rs("p", digits=8))


@query("d19_bin_given_outcome", with_views("chain", f"""
WITH g AS (SELECT o.o AS row, CAST(b.b AS INT) AS col FROM range(0, 6) b(b), (VALUES {_OUT_VALUES}) o(o)),
k AS (SELECT * FROM chain WHERE next_bin IS NOT NULL AND changed = CASE WHEN result = 'Opp touchdown' THEN 0 ELSE 1 END),
c AS (SELECT g.row, g.col, count(k.drive) AS n FROM g LEFT JOIN k ON k.result = g.row AND k.next_bin = g.col GROUP BY ALL)
SELECT row, col, n, round((n + 1e-9) / sum(n + 1e-9) OVER (PARTITION BY row), 8) AS p FROM c"""))
def bin_given_outcome(spark, folder):
    expected = F.when(F.col("result") == "Opp touchdown", 0).otherwise(1)
    kept = base.chain(spark, folder).filter(F.col("next_bin").isNotNull() & (F.col("changed") == expected))
    out = rollup.crosstab(kept, F.col("result"), F.col("next_bin"), OUTCOME_NAMES, list(range(6)))
    return out.select("row", "col", "n", *rs("p", digits=8))


@query("d20_opening_distribution", with_views("drives", """
SELECT bin, count(*) AS n FROM (SELECT bin FROM drives QUALIFY row_number() OVER (PARTITION BY game_id ORDER BY first_day, drive, posteam) = 1) GROUP BY bin"""))
def opening_distribution(spark, folder):
    first = base.drives(spark, folder).groupBy("game_id").agg(rollup.first_by("bin", ["first_day", "drive", "posteam"]).alias("bin"))
    return first.groupBy("bin").agg(F.count("*").alias("n"))


@query("d21_marginal_frequencies", with_views("drives", """
SELECT result, count(*) AS n, round(count(*) / sum(count(*)) OVER (), 9) AS share FROM drives GROUP BY result"""))
def marginal_frequencies(spark, folder):
    counts = base.drives(spark, folder).groupBy("result").agg(F.count("*").alias("n"))
    total = counts.agg(F.sum("n")).scalar()
    return counts.select("result", "n", r(F.col("n") / total, 9).alias("share"))


@query("d22_shrinkage_constant", with_views("plays", """
WITH g AS (SELECT year(month) AS season, posteam, count(*) AS n, avg(epa) AS m, var_samp(epa) AS v FROM plays WHERE kind = 'A' GROUP BY ALL HAVING count(*) >= 20),
a AS (SELECT count(*) AS groups, avg(v) AS sigma2, var_samp(m) AS vo, avg(v / n) AS vn FROM g)
SELECT groups, round(sigma2, 8) AS sigma2, round(vo, 8) AS var_observed, round(vn, 8) AS var_noise, round(sigma2 / greatest(vo - vn, 1e-9), 1) AS k FROM a"""))
def shrinkage_constant(spark, folder):
    df = plays(spark, folder).filter("kind = 'A'").withColumn("season", F.year("month"))
    out = rollup.shrinkage_constant(df, ["season", "posteam"], "epa", 20)
    return out.select("groups", *rs("sigma2", "var_observed", "var_noise", digits=8), r("k", 1).alias("k"))


@query("d23_status_counts", with_views("reports", "SELECT game_id, team, count(*) AS rows, count(report_status) AS statuses FROM reports GROUP BY ALL"))
def status_counts(spark, folder):
    return base.reports(spark, folder).groupBy("game_id", "team").agg(F.count("*").alias("rows"), F.count("report_status").alias("statuses"))


@query("d24_slate_coverage", with_views("team_games reports", """
SELECT CAST(kickoff AS DATE)::VARCHAR AS due, round(avg(CASE WHEN coalesce(n, 0) > 0 THEN 1.0 ELSE 0.0 END), 9) AS coverage
FROM team_games LEFT JOIN (SELECT game_id, team, count(report_status) AS n FROM reports GROUP BY ALL) USING (game_id, team) GROUP BY ALL"""))
def slate_coverage(spark, folder):
    n = base.reports(spark, folder).groupBy("game_id", "team").agg(F.count("report_status").alias("n"))
    joined = base.team_games(spark, folder).join(n, ["game_id", "team"], "left")
    return joined.groupBy(F.to_date("kickoff").cast("string").alias("due")).agg(
        r(F.avg((F.coalesce("n", F.lit(0)) > 0).cast("double")), 9).alias("coverage")
    )


@query("d25_weighted_mean", with_views("model_table", """
SELECT season, round(sum((home_score - away_score) * CASE WHEN went_to_ot = 1 THEN 0.5 ELSE 1.0 END) / sum(CASE WHEN went_to_ot = 1 THEN 0.5 ELSE 1.0 END), 6) AS edge
FROM model_table GROUP BY season"""))
def weighted_mean(spark, folder):
    w = rules.sample_weight(F.col("went_to_ot"))
    margin = F.col("home_score") - F.col("away_score")
    return base.model_table(spark, folder).groupBy("season").agg(r(F.sum(margin * w) / F.sum(w)).alias("edge"))


@query("d26_error_correlation", with_views("evaluation", """
WITH w AS (SELECT game_id, max(home_err) FILTER (model = 'league_average') AS league_average, max(home_err) FILTER (model = 'baseline') AS baseline,
                  max(home_err) FILTER (model = 'composite') AS composite FROM evaluation GROUP BY game_id),
l AS (UNPIVOT w ON league_average, baseline, composite INTO NAME m VALUE v)
SELECT a.m AS a, b.m AS b, round(corr(a.v, b.v), 6) AS corr FROM l a JOIN l b USING (game_id) GROUP BY ALL"""))
def error_correlation(spark, folder):
    out = rollup.correlation_matrix(base.evaluation(spark, folder), "game_id", "model", "home_err", ["league_average", "baseline", "composite"])
    return out.select("a", "b", *rs("corr"))


@query("d27_distribution_summary", """
SELECT event_type, round(quantile_cont(value, 0.05), 6) AS p05, round(median(value), 6) AS median, round(quantile_cont(value, 0.95), 6) AS p95 FROM events GROUP BY event_type""")
def distribution_summary(spark, folder):
    q = quantiles.exact_quantiles(event_log(spark, folder), ["event_type"], "value", [0.05, 0.5, 0.95])
    pick = lambda p: r(F.max(F.when(F.col("prob") == p, F.col("q"))))
    return q.groupBy("event_type").agg(pick(0.05).alias("p05"), pick(0.5).alias("median"), pick(0.95).alias("p95"))


@query("d28_cutoffs", with_views("contests", "SELECT season, week, min(t) AS cutoff FROM contests GROUP BY ALL"))
def cutoffs(spark, folder):
    return folds.cutoffs(contests(spark, folder))


@query("e2_segment_rates", with_views("drives", """
WITH per AS (SELECT game_id, posteam AS team, t, avg(CASE WHEN result = 'Touchdown' THEN 1.0 ELSE 0.0 END) AS td, avg(CASE WHEN result = 'Punt' THEN 1.0 ELSE 0.0 END) AS punt, count(*) AS n FROM drives GROUP BY ALL),
s AS (SELECT team, t, sum(td) AS td, sum(punt) AS punt, sum(n) AS n, count(*) AS c FROM per GROUP BY ALL)
SELECT a.team, a.t, round(sum(b.td * pow(0.5, (a.t - b.t) / 119.0)) / sum(b.c * pow(0.5, (a.t - b.t) / 119.0)), 6) AS touchdown,
       round(sum(b.punt * pow(0.5, (a.t - b.t) / 119.0)) / sum(b.c * pow(0.5, (a.t - b.t) / 119.0)), 6) AS punt,
       round(sum(b.n * pow(0.5, (a.t - b.t) / 119.0)) / sum(b.c * pow(0.5, (a.t - b.t) / 119.0)), 6) AS n_drives
FROM s a LEFT JOIN s b ON a.team = b.team AND b.t < a.t GROUP BY ALL"""))
def segment_rate_history(spark, folder):
    from priorlake.operators.temporal import Exponential, decayed_prior

    per = rollup.outcome_rates(base.drives(spark, folder), "posteam", "off", ["Touchdown", "Punt"])
    pairs = {
        "touchdown": (F.col("off_touchdown_rate"), F.lit(1.0)), "punt": (F.col("off_punt_rate"), F.lit(1.0)),
        "n_drives": (F.col("off_n").cast("double"), F.lit(1.0)),
    }
    out = decayed_prior(per, ["team"], "t", pairs, Exponential(base.HALFLIFE))
    return out.select("team", "t", *rs("touchdown", "punt", "n_drives"))
