"""Temporal features (section E) and the strict as-of join."""
from __future__ import annotations

from pyspark.sql import functions as F

from priorlake.operators import prefix, roster, temporal
from priorlake.operators.temporal import Exponential, RecencyPlan, TwoTimescale, epoch_day
from priorlake.plans.base import (
    HALFLIFE, MEASURES, appearances, contests, decayed_sql, facts, finale, lineups, model_table, pregame, query, r,
    reports, rs, team_games, with_views, view, FINALE,
)
from priorlake.sources.views import customer_orders, event_log, lines

DAY = prefix.MICROS_PER_DAY
_PRE = [f"pregame_{m}" for m in MEASURES]
_ROUND = ", ".join(f"round({c}, 6) AS {c}" for c in _PRE)


@query("e1_prior_mean", with_views("rolled", f"SELECT game_id, team, {_ROUND} FROM rolled"))
def prior_mean(spark, folder):
    measures = {f"pregame_{m}": m for m in MEASURES}
    out = temporal.prior_mean(facts(spark, folder), ["team"], "t", measures, Exponential(HALFLIFE), mask=~finale())
    return out.select("game_id", "team", *rs(*_PRE))


@query("e1_prior_mean_ties", """
WITH h AS (SELECT o_orderkey, o_custkey, CAST(o_orderdate AS DATE) AS day, o_totalprice FROM orders)
SELECT a.o_orderkey, round(sum(b.o_totalprice * pow(0.5, date_diff('day', b.day, a.day) / 200.0))
       / sum(pow(0.5, date_diff('day', b.day, a.day) / 200.0)), 4) AS pregame_price
FROM h a LEFT JOIN h b ON a.o_custkey = b.o_custkey AND b.day < a.day GROUP BY a.o_orderkey""")
def prior_mean_ties(spark, folder):
    df = customer_orders(spark, folder)
    out = temporal.prior_mean(df, ["o_custkey"], "t", {"pregame_price": "o_totalprice"}, Exponential(200.0))
    return out.select("o_orderkey", *rs("pregame_price", digits=4))


view("rates", ["lines"], """
SELECT buyer AS team, day, CAST(date_diff('day', DATE '1970-01-01', day) AS INT) AS t, sum(price) AS num, sum(qty) AS den
FROM lines GROUP BY ALL""")


def rate_rows(spark, folder):
    return (
        lines(spark, folder)
        .groupBy(F.col("buyer").alias("team"), "day")
        .agg(F.sum("price").alias("num"), F.sum("qty").alias("den"))
        .withColumn("t", epoch_day(F.col("day")))
    )


_W = "pow(0.5, (a.t - b.t) / 119.0)"


@query("e3_prior_rate", with_views("rates", f"""
SELECT a.team, a.t, round(sum(b.num * {_W}) / sum(b.den * {_W}), 5) AS rate,
       round(coalesce(sum(b.den * {_W}), 0.0), 5) AS n_eff
FROM rates a LEFT JOIN rates b ON a.team = b.team AND b.t < a.t GROUP BY ALL"""))
def prior_rate(spark, folder):
    df = rate_rows(spark, folder)
    out = temporal.prior_rate(df, ["team"], "t", {"rate": (F.col("num"), F.col("den"))}, Exponential(HALFLIFE))
    return out.select("team", "t", r("rate", 5).alias("rate"), r("rate_n", 5).alias("n_eff"))


@query("e4_pooled_prior", with_views("rates", f"""
WITH d AS (SELECT t, sum(num) AS num, sum(den) AS den FROM rates GROUP BY t)
SELECT a.t, round(sum(b.num * {_W}) / sum(b.den * {_W}), 5) AS pooled,
       round(coalesce(sum(b.den * {_W}), 0.0), 4) AS n_eff
FROM d a LEFT JOIN d b ON b.t < a.t GROUP BY a.t"""))
def pooled_prior(spark, folder):
    pairs = {"pooled": (F.col("num"), F.col("den"))}
    out = temporal.decayed_prior(rate_rows(spark, folder), [], "t", pairs, Exponential(HALFLIFE))
    return out.select("t", r("pooled", 5).alias("pooled"), r("pooled_n", 4).alias("n_eff"))


@query("e5_shrink", with_views("rates", f"""
WITH own AS (SELECT a.team, a.t, sum(b.num * {_W}) / sum(b.den * {_W}) AS rate, coalesce(sum(b.den * {_W}), 0.0) AS n
             FROM rates a LEFT JOIN rates b ON a.team = b.team AND b.t < a.t GROUP BY ALL),
d AS (SELECT t, sum(num) AS num, sum(den) AS den FROM rates GROUP BY t),
pool AS (SELECT a.t, sum(b.num * {_W}) / sum(b.den * {_W}) AS prior FROM d a LEFT JOIN d b ON b.t < a.t GROUP BY a.t)
SELECT team, t, round((n * coalesce(rate, 0) + 300 * prior) / (n + 300), 5) AS shrunk FROM own JOIN pool USING (t)"""))
def shrink(spark, folder):
    out = temporal.shrunk_prior_rate(
        rate_rows(spark, folder), "team", "t", {"rate": (F.col("num"), F.col("den"))}, {"rate": 300.0}, Exponential(HALFLIFE)
    )
    return out.select("team", "t", r("rate_shrunk", 5).alias("shrunk"))


# Shrinkage constants per split, and the rate and count each split uses.
SPLIT_K = {"off_pass": 225.0, "off_rush": 300.0, "def_pass": 425.0, "def_rush": 540.0}
SPLITS = {
    "off_pass": ("off_pass_epa_per_play", "off_pass_plays"),
    "off_rush": ("off_rush_epa_per_play", "off_rush_plays"),
    "def_pass": ("def_pass_epa_per_play_allowed", "def_pass_plays"),
    "def_rush": ("def_rush_epa_per_play_allowed", "def_rush_plays"),
}


def split_features(spark, folder):
    zero = F.lit(0.0)
    plays = {n: F.coalesce(F.col(c).cast("double"), zero) for n, (_, c) in SPLITS.items()}
    rates = {n: (F.coalesce(F.col(e), zero) * plays[n], plays[n]) for n, (e, _) in SPLITS.items()}
    return temporal.shrunk_prior_rate(facts(spark, folder), "team", "t", rates, SPLIT_K, Exponential(HALFLIFE), mask=~finale())


_S1 = ", ".join(
    f"sum(coalesce({e} * {c}, 0.0)) FILTER (week <> {FINALE}) AS e_{n}, sum(coalesce({c}, 0)) FILTER (week <> {FINALE}) AS c_{n}"
    for n, (e, c) in SPLITS.items()
)
_OWN = ", ".join(f"sum(b.e_{n} * {_W}) / nullif(sum(b.c_{n} * {_W}), 0) AS r_{n}, coalesce(sum(b.c_{n} * {_W}), 0.0) AS n_{n}" for n in SPLITS)
_OUT = ", ".join(f"round((n_{n} * coalesce(o.r_{n}, 0) + {SPLIT_K[n]} * p.r_{n}) / (n_{n} + {SPLIT_K[n]}), 6) AS {n}_shrunk, round(n_{n}, 5) AS {n}_n" for n in SPLITS)


@query("e6_split_features", with_views("facts", f"""
WITH s AS (SELECT team, t, {_S1} FROM facts GROUP BY team, t),
d AS (SELECT t, {_S1} FROM facts GROUP BY t),
own AS (SELECT a.team, a.t, {_OWN} FROM s a LEFT JOIN s b ON a.team = b.team AND b.t < a.t GROUP BY a.team, a.t),
pool AS (SELECT a.t, {_OWN.replace(' AS n_', ' AS pn_')} FROM d a LEFT JOIN d b ON b.t < a.t GROUP BY a.t)
SELECT f.game_id, f.team, {_OUT} FROM facts f JOIN own o USING (team, t) JOIN pool p USING (t)"""))
def split_feature_query(spark, folder):
    out = split_features(spark, folder)
    cols = [c for n in SPLITS for c in (r(f"{n}_shrunk").alias(f"{n}_shrunk"), r(f"{n}_n", 5).alias(f"{n}_n"))]
    return out.select("game_id", "team", *cols)


_H = "WITH h AS (SELECT o_orderkey, o_custkey, date_diff('day', DATE '1970-01-01', CAST(o_orderdate AS DATE)) AS t, o_totalprice AS v FROM orders)"


@query("e7_two_timescale_mean", f"""{_H},
k AS (SELECT a.o_orderkey, b.v, 0.6 * pow(0.5, (a.t - b.t) / 60.0) + 0.4 * pow(0.5, (a.t - b.t) / 400.0) AS w
      FROM h a LEFT JOIN h b ON a.o_custkey = b.o_custkey AND b.t < a.t)
SELECT o_orderkey, round(sum(v * w) / sum(w), 4) AS mean FROM k GROUP BY o_orderkey""")
def two_timescale_mean(spark, folder):
    out = temporal.prior_mean(
        customer_orders(spark, folder), ["o_custkey"], "t", {"mean": "o_totalprice"}, TwoTimescale(60.0, 400.0, 0.6)
    )
    return out.select("o_orderkey", *rs("mean", digits=4))


@query("e8_previous_anchor_mean", f"""{_H},
g AS (SELECT *, coalesce((SELECT max(t) FROM h x WHERE x.o_custkey = h.o_custkey AND x.t < h.t), t) AS at FROM h),
k AS (SELECT a.o_orderkey, b.v, 0.6 * pow(0.5, (a.at - b.t) / 60.0) + 0.4 * pow(0.5, (a.at - b.t) / 400.0) AS w
      FROM g a LEFT JOIN h b ON a.o_custkey = b.o_custkey AND b.t < a.t)
SELECT o_orderkey, round(sum(v * w) / sum(w), 4) AS mean FROM k GROUP BY o_orderkey""")
def previous_anchor_mean(spark, folder):
    out = temporal.prior_mean(
        customer_orders(spark, folder), ["o_custkey"], "t", {"mean": "o_totalprice"}, TwoTimescale(60.0, 400.0, 0.6),
        anchor="previous",
    )
    return out.select("o_orderkey", *rs("mean", digits=4))


@query("e9_two_timescale_rate", with_views("rates", """
SELECT team, t, round(sum(num * w) / sum(den * w), 5) AS rate, round(coalesce(sum(den * w), 0.0), 4) AS n_eff
FROM (SELECT a.team, a.t, b.num, b.den, 0.5 * pow(0.5, (a.t - b.t) / 35.0) + 0.5 * pow(0.5, (a.t - b.t) / 300.0) AS w
      FROM rates a LEFT JOIN rates b ON a.team = b.team AND b.t < a.t) GROUP BY ALL"""))
def two_timescale_rate(spark, folder):
    out = temporal.prior_rate(
        rate_rows(spark, folder), ["team"], "t", {"rate": (F.col("num"), F.col("den"))}, TwoTimescale(35.0, 300.0, 0.5)
    )
    return out.select("team", "t", r("rate", 5).alias("rate"), r("rate_n", 4).alias("n_eff"))


_PLAN = RecencyPlan(Exponential(HALFLIFE), {"team_score": Exponential(60.0), "opp_score": TwoTimescale(60.0, 300.0, 0.3)})


@query("e10_recency_plan", with_views("facts", f"""
WITH s AS (SELECT team, t, sum(team_score) AS s1, sum(opp_score) AS s2, sum(off_epa_per_play) AS s3,
                  count(team_score) AS c1, count(opp_score) AS c2, count(off_epa_per_play) AS c3
           FROM facts WHERE week <> {FINALE} GROUP BY ALL),
k AS (SELECT a.team, a.t, b.* EXCLUDE (team, t), pow(0.5, (a.t - b.t) / 60.0) AS w1,
             0.3 * pow(0.5, (a.t - b.t) / 60.0) + 0.7 * pow(0.5, (a.t - b.t) / 300.0) AS w2,
             pow(0.5, (a.t - b.t) / 119.0) AS w3
      FROM (SELECT DISTINCT team, t FROM facts) a LEFT JOIN s b ON a.team = b.team AND b.t < a.t)
SELECT team, t, round(sum(s1 * w1) / sum(c1 * w1), 6) AS team_score, round(sum(s2 * w2) / sum(c2 * w2), 6) AS opp_score,
       round(sum(s3 * w3) / nullif(sum(CASE WHEN c3 > 0 THEN c3 * w3 END), 0), 6) AS off_epa_per_play
FROM k GROUP BY ALL"""))
def recency_plan(spark, folder):
    names = ["team_score", "opp_score", "off_epa_per_play"]
    pairs = {m: (F.col(m).cast("double"), F.when(F.col(m).isNotNull(), F.lit(1.0))) for m in names}
    out = temporal.decayed_prior(
        facts(spark, folder), ["team"], "t", pairs, {m: _PLAN.kernel(m) for m in names}, mask=~finale(), anchor=_PLAN.anchor
    )
    return out.select("team", "t", *rs(*names))


@query("e11_effective_timelines", f"""{_H},
u AS (SELECT o_custkey, t, coalesce(t - lag(t) OVER (PARTITION BY o_custkey ORDER BY t), 0) AS gap
      FROM (SELECT DISTINCT o_custkey, t FROM h)),
c AS (SELECT o_custkey, t, s.scheme, sum(CASE s.scheme WHEN 'calendar' THEN gap WHEN 'compressed' THEN CASE WHEN gap < 120 THEN gap ELSE 45 END
               ELSE CASE WHEN gap > 0 THEN 7 ELSE 0 END END) OVER (PARTITION BY o_custkey, s.scheme ORDER BY t) AS clock
      FROM u, (VALUES ('calendar'), ('compressed'), ('games')) s(scheme)),
k AS (SELECT a.o_orderkey, x.scheme, b.v, pow(0.5, (x.clock - y.clock) / 119.0) AS w
      FROM h a JOIN c x ON a.o_custkey = x.o_custkey AND a.t = x.t
      LEFT JOIN (h b JOIN c y ON b.o_custkey = y.o_custkey AND b.t = y.t)
        ON b.o_custkey = a.o_custkey AND b.t < a.t AND y.scheme = x.scheme)
SELECT scheme, o_orderkey, round(sum(v * w) / sum(w), 4) AS mean FROM k GROUP BY ALL""")
def effective_timelines(spark, folder):
    df = customer_orders(spark, folder)
    out = None
    for scheme in ("calendar", "compressed", "games"):
        clock = temporal.effective_clock(df, ["o_custkey"], "t", scheme)
        timed = df.join(clock, ["o_custkey", "t"])
        part = temporal.prior_mean(
            timed, ["o_custkey"], "t", {"mean": "o_totalprice"}, Exponential(HALFLIFE), clock="clock"
        ).select(F.lit(scheme).alias("scheme"), "o_orderkey", *rs("mean", digits=4))
        out = part if out is None else out.unionByName(part)
    return out


@query("e12_season_counter", """
SELECT o_orderkey, row_number() OVER (PARTITION BY o_custkey, year(o_orderdate) ORDER BY o_orderdate, o_orderkey) - 1 AS prior_games_played
FROM orders""")
def season_counter(spark, folder):
    df = customer_orders(spark, folder).withColumn("season", F.year("day"))
    out = prefix.position(df, ["o_custkey", "season"], "t", ["o_orderkey"], "prior_games_played")
    return out.select("o_orderkey", "prior_games_played")


@query("e13_career_counter", """
SELECT o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) - 1 AS prior_starts FROM orders""")
def career_counter(spark, folder):
    out = prefix.position(customer_orders(spark, folder), ["o_custkey"], "t", ["o_orderkey"], "prior_starts")
    return out.select("o_orderkey", "prior_starts")


@query("e14_expanding_share", """
SELECT event_id, round(avg(value) OVER (PARTITION BY user_id ORDER BY ts RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 8) AS share_to_date
FROM events""")
def expanding_share(spark, folder):
    df = event_log(spark, folder)
    out = roster.share_to_date(df, "user_id", "us", "value")
    return df.select("event_id", "user_id", "us").join(out, ["user_id", "us"]).select("event_id", *rs("share_to_date", digits=8))


@query("c4_asof_join", """
SELECT l.event_id, r.value AS prior_value, r.event_id AS prior_event
FROM (SELECT * FROM events WHERE event_type = 'purchase') l
ASOF LEFT JOIN (SELECT * FROM events WHERE event_type = 'view') r ON l.user_id = r.user_id AND l.ts > r.ts""")
def asof_join(spark, folder):
    df = event_log(spark, folder)
    left = df.filter("event_type = 'purchase'").select("event_id", "user_id", "us")
    right = df.filter("event_type = 'view'").select("user_id", "us", F.col("value").alias("prior_value"), F.col("event_id").alias("prior_event"))
    return prefix.asof_prior(left, right, ["user_id"], "us", ["prior_value", "prior_event"]).select(
        "event_id", "prior_value", "prior_event"
    )


@query("e15_latest_version", with_views("reports", """
SELECT game_id, player, event_id, report_status FROM reports
QUALIFY row_number() OVER (PARTITION BY game_id, team, player ORDER BY date_modified DESC NULLS LAST, event_id DESC) = 1"""))
def latest_version(spark, folder):
    out = roster.latest_version(reports(spark, folder), ["game_id", "team", "player"], "date_modified", ["event_id"])
    return out.select("game_id", "player", "event_id", "report_status")


@query("e16_next_segment", """
SELECT event_id, lead(value) OVER w AS next_start, lead(event_type) OVER w AS next_type,
       CAST(lead(event_type) OVER w <> event_type AS INT) AS changed
FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)""")
def next_segment(spark, folder):
    df = event_log(spark, folder)
    out = prefix.neighbour(
        df, ["user_id"], ["us", "event_id"], {"next_start": "value", "next_type": "event_type"}, step=1,
        block=prefix.day_blocks(F.col("us")),
    )
    return out.select("event_id", "next_start", "next_type", (F.col("next_type") != F.col("event_type")).cast("int").alias("changed"))


@query("e17_prior_sequence", """
WITH n AS (SELECT event_id, user_id, value, event_type, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i FROM events),
p AS (SELECT unnest(range(0, 8)) AS pos)
SELECT a.event_id, CAST(p.pos AS INT) AS pos, CAST(b.i IS NOT NULL AS INT) AS mask, coalesce(b.value, 0.0) AS value,
       coalesce(CAST(b.event_type = 'purchase' AS INT), 0) AS is_purchase
FROM n a CROSS JOIN p LEFT JOIN n b ON b.user_id = a.user_id AND b.i = a.i - 8 + p.pos""")
def prior_sequence(spark, folder):
    df = event_log(spark, folder).withColumn("is_purchase", (F.col("event_type") == "purchase").cast("int"))
    out = padded_sequence(
        prefix.recent_rows(df, ["user_id"], ["us", "event_id"], ["value", "is_purchase"], 8, "seq", block=prefix.day_blocks(F.col("us"))),
        "seq", 8,
    )
    return out.select("event_id", F.posexplode("seq").alias("pos", "s")).select("event_id", "pos", "s.mask", "s.value", "s.is_purchase")


def padded_sequence(df, name, length):
    """Left zero-padded to `length` steps with a mask of the real ones."""
    step = lambda mask, value, flag: F.struct(mask.alias("mask"), value.alias("value"), flag.alias("is_purchase"))
    zero = step(F.lit(0), F.lit(0.0), F.lit(0))
    real = F.transform(name, lambda x: step(F.lit(1), F.coalesce(x["value"], F.lit(0.0)), x["is_purchase"]))
    return df.withColumn(name, F.concat(F.array_repeat(zero, F.lit(length) - F.size(name)), real))


view("availability", ["team_games", "reports", "appearances"], """
WITH timely AS (SELECT r.*, g.kickoff FROM reports r JOIN team_games g USING (game_id, team)
                WHERE r.date_modified IS NULL OR r.date_modified < g.kickoff),
latest AS (SELECT * FROM timely QUALIFY row_number() OVER (PARTITION BY game_id, team, player
             ORDER BY date_modified DESC NULLS LAST, report_status DESC NULLS LAST, position DESC NULLS LAST) = 1),
share AS (SELECT player, kickoff, avg(role_share) OVER (PARTITION BY player ORDER BY kickoff RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS s
          FROM appearances),
valued AS (SELECT l.*, coalesce((SELECT max(struct_pack(k := x.kickoff, s := x.s)) FROM share x WHERE x.player = l.player AND x.kickoff < l.kickoff).s, 0.0) AS share
           FROM latest l),
tot AS (SELECT game_id, team,
          sum((CASE position WHEN 'QB' THEN 1.0 WHEN 'WR' THEN 0.32 WHEN 'CB' THEN 0.34 WHEN 'T' THEN 0.40 WHEN 'LS' THEN 0.04 ELSE 0.20 END)::DOUBLE
              * share * (CASE WHEN report_status IN ('Out', 'Doubtful') THEN 1.0 WHEN report_status = 'Questionable' THEN 0.5 ELSE 0.0 END)::DOUBLE) AS impact,
          max(CASE WHEN position = 'QB' AND report_status IN ('Out', 'Doubtful') AND share >= 0.5 THEN 1.0 ELSE 0.0 END)::DOUBLE AS qb_out
        FROM valued GROUP BY ALL)
SELECT g.game_id, g.team, g.kickoff, g.played AND NOT (r.game_id IS NOT NULL AND coalesce(g.kickoff > f.first_seen, false)) AS gap, t.impact, t.qb_out
FROM team_games g LEFT JOIN tot t USING (game_id, team)
LEFT JOIN (SELECT DISTINCT game_id, team FROM timely) r USING (game_id, team)
LEFT JOIN (SELECT team, min(kickoff) AS first_seen FROM appearances GROUP BY team) f USING (team)""")


@query("e18_availability", with_views("availability", """
SELECT game_id, team, CASE WHEN NOT gap THEN round(coalesce(impact, 0.0), 8) END AS injury_impact,
       CASE WHEN NOT gap THEN coalesce(qb_out, 0.0) END AS qb_out FROM availability"""))
def availability(spark, folder):
    out = roster.availability(team_games(spark, folder), reports(spark, folder), appearances(spark, folder))
    return out.select("game_id", "team", r("injury_impact", 8).alias("injury_impact"), "qb_out")


@query("e19_unmeasurable", with_views("availability", "SELECT game_id, team, CAST(gap AS INT) AS gap FROM availability"))
def unmeasurable(spark, folder):
    games = team_games(spark, folder)
    timely = roster.before_start(
        reports(spark, folder).join(games.select("game_id", "team", "kickoff"), ["game_id", "team"]), "date_modified", "kickoff"
    )
    out = roster.unmeasurable(games, timely, appearances(spark, folder))
    return out.select("game_id", "team", F.col("unmeasurable").cast("int").alias("gap"))


UPCOMING = "2001-07-01"


@query("e20_upcoming_rows", with_views("facts", """
WITH masked AS (SELECT * REPLACE (CASE WHEN gameday < DATE '2001-07-01' THEN team_score END AS team_score) FROM facts),
s AS (SELECT team, t, sum(team_score) AS v, count(team_score) AS c FROM masked GROUP BY ALL)
SELECT f.game_id, f.team, (SELECT round(sum(s.v * pow(0.5, (f.t - s.t) / 119.0)) / sum(CASE WHEN s.c > 0 THEN s.c * pow(0.5, (f.t - s.t) / 119.0) END), 6)
   FROM s WHERE s.team = f.team AND s.t < f.t) AS pregame_team_score
FROM facts f WHERE gameday >= DATE '2001-07-01'"""))
def upcoming_rows(spark, folder):
    """Unplayed contests join the history as rows without a result, and still receive features."""
    df = facts(spark, folder)
    played = df.filter(F.col("gameday") < UPCOMING).select("game_id", "team", "t", "gameday", "team_score")
    ahead = df.filter(F.col("gameday") >= UPCOMING).select("game_id", "team", "t", "gameday")
    both = played.unionByName(ahead, allowMissingColumns=True)
    out = temporal.prior_mean(both, ["team"], "t", {"pregame_team_score": "team_score"}, Exponential(HALFLIFE))
    return out.filter(F.col("gameday") >= UPCOMING).select("game_id", "team", *rs("pregame_team_score"))


@query("e21_roster_carryover", with_views("lineups", """
WITH m AS (SELECT l.*, (SELECT count(*) > 0 FROM lineups p WHERE p.team = l.team AND p.season = l.season - 1 AND p.player = l.player) AS back FROM lineups l),
g AS (SELECT DISTINCT team, season, t FROM lineups)
SELECT g.team, g.t, CASE WHEN EXISTS (SELECT 1 FROM lineups p WHERE p.team = g.team AND p.season = g.season - 1)
    THEN round(sum(CASE WHEN m.back THEN m.share ELSE 0 END) / sum(m.share), 6) END AS roster_carryover
FROM g LEFT JOIN m ON m.team = g.team AND m.season = g.season AND m.t < g.t GROUP BY g.team, g.season, g.t"""))
def roster_carryover(spark, folder):
    return roster.carryover(lineups(spark, folder)).select("team", "t", *rs("roster_carryover"))


@query("e22_lineup_stability", with_views("lineups", """
WITH g AS (SELECT team, season, t, lag(t) OVER (PARTITION BY team, season ORDER BY t) AS pt FROM (SELECT DISTINCT team, season, t FROM lineups)),
j AS (SELECT team, season, t, sum(least(c, p)) / sum(greatest(c, p)) AS ov FROM (
        SELECT g.team, g.season, g.t, l.player, max(CASE WHEN l.t = g.t THEN l.share ELSE 0 END) AS c, max(CASE WHEN l.t = g.pt THEN l.share ELSE 0 END) AS p
        FROM g JOIN lineups l ON l.team = g.team AND l.t IN (g.t, g.pt) WHERE g.pt IS NOT NULL GROUP BY ALL) GROUP BY ALL)
SELECT g.team, g.t, round(avg(j.ov), 6) AS lineup_stability
FROM g LEFT JOIN j ON j.team = g.team AND j.season = g.season AND j.t < g.t GROUP BY g.team, g.season, g.t"""))
def lineup_stability(spark, folder):
    return roster.stability(lineups(spark, folder)).select("team", "t", *rs("lineup_stability"))


@query("e23_tenure", with_views("lineups", """
WITH s AS (SELECT *, row_number() OVER (PARTITION BY team, player ORDER BY t) AS games FROM lineups),
a AS (SELECT team, t, sum(share * games) / sum(share) AS after FROM s GROUP BY ALL)
SELECT team, t, round(lag(after) OVER (PARTITION BY team ORDER BY t), 8) AS snap_weighted_tenure FROM a"""))
def tenure(spark, folder):
    return roster.tenure(lineups(spark, folder)).select("team", "t", *rs("snap_weighted_tenure", digits=8))


@query("e24_contributors", with_views("lineups", "SELECT team, t, player, round(share, 6) AS share FROM lineups"))
def contributor_rows(spark, folder):
    return lineups(spark, folder).select("team", "t", "player", *rs("share"))


@query("e26_rest_days", with_views("entities", """
SELECT game_id, team, rest_days, CAST(t - lag(t) OVER w AS INT) AS gap
FROM entities WINDOW w AS (PARTITION BY team ORDER BY t, game_id)"""))
def rest_days(spark, folder):
    df = facts(spark, folder).select("game_id", "team", "t", "rest_days", "season")
    out = prefix.neighbour(df, ["team"], ["t", "game_id"], {"prev": "t"}, step=-1, block=F.col("season"))
    return out.select("game_id", "team", "rest_days", (F.col("t") - F.col("prev")).alias("gap"))
