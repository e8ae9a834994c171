"""Line-up and availability features known before a contest starts."""
from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from priorlake.functions.scalars import lookup, safe_div, status_weight
from priorlake.operators.prefix import Block, asof_prior, day_blocks, neighbour, prior_sums
from priorlake.operators.temporal import micros

# How much a position matters, and how a status counts.
POSITION_VALUE = {
    "QB": 1.00, "T": 0.40, "DE": 0.38, "CB": 0.34, "WR": 0.32, "DT": 0.28, "S": 0.26, "TE": 0.24,
    "G": 0.22, "C": 0.22, "LB": 0.22, "RB": 0.16, "FB": 0.08, "K": 0.10, "P": 0.06, "LS": 0.04,
}
DEFAULT_POSITION_VALUE = 0.20
UNAVAILABLE = ("Out", "Doubtful")
QUESTIONABLE_WEIGHT = 0.5
STARTER_SHARE = 0.50
CONTRIBUTOR_SHARE = 0.10


def before_start(reports: DataFrame, modified: str, start: str) -> DataFrame:
    """Drop rows stamped at or after the start; rows without a stamp stay."""
    return reports.filter(F.col(modified).isNull() | (F.col(modified) < F.col(start)))


def latest_version(df: DataFrame, keys: list[str], version: str, tie: list[str]) -> DataFrame:
    """One row per key with the newest `version` (a null version is oldest), ties by `tie`.

    A map-side combined aggregate: a key with very many versions is never gathered.
    """
    others = [c for c in df.columns if c not in keys]
    newest = F.max_by(F.struct(*others), F.struct(F.col(version).isNotNull().alias("known"), F.col(version), *tie))
    return df.groupBy(*keys).agg(newest.alias("_r")).select(*keys, "_r.*")


def share_to_date(appearances: DataFrame, player: str, t: str, share: str, block: Block | None = day_blocks) -> DataFrame:
    """(player, t, share_to_date): mean share over appearances up to and including t."""
    sums = prior_sums(appearances, [player], t, {"s": F.col(share), "n": F.lit(1)}, block=block, inclusive=True)
    return sums.select(player, t, (F.col("s") / F.col("n")).alias("share_to_date"))


def unmeasurable(team_games: DataFrame, reported: DataFrame, appearances: DataFrame) -> DataFrame:
    """Adds `unmeasurable`: played, and no report on file or no earlier appearance of the team."""
    first = appearances.groupBy("team").agg(F.min("kickoff").alias("_first"))
    on_file = reported.select("game_id", "team").distinct().withColumn("_rep", F.lit(True))
    known = F.coalesce(F.col("_rep"), F.lit(False)) & F.coalesce(F.col("kickoff") > F.col("_first"), F.lit(False))
    return (
        team_games.join(on_file, ["game_id", "team"], "left")
        .join(first, ["team"], "left")
        .withColumn("unmeasurable", F.col("played") & ~known)
        .drop("_rep", "_first")
    )


def impact_totals(rows: DataFrame) -> DataFrame:
    """Summed impact and a starter flag per (contest, team).

    Decimal sums are exact, so the total does not depend on row order.
    """
    return rows.groupBy("game_id", "team").agg(
        F.sum(F.col("impact").cast("decimal(28,12)")).cast("double").alias("injury_impact"),
        F.max(F.col("starter_out").cast("int")).cast("double").alias("qb_out"),
    )


def availability(
    team_games: DataFrame,
    reports: DataFrame,
    appearances: DataFrame,
    *,
    positions: Mapping[str, float] = POSITION_VALUE,
    out: Sequence[str] = UNAVAILABLE,
    doubtful: str = "Questionable",
    doubtful_weight: float = QUESTIONABLE_WEIGHT,
) -> DataFrame:
    """Weight of missing players per team-contest, null where the data cannot tell.

    team_games   game_id, team, kickoff, played
    reports      game_id, team, player, position, report_status, date_modified
    appearances  game_id, team, player, kickoff, role_share
    """
    kick = team_games.select("game_id", "team", "kickoff")
    timely = before_start(reports.join(kick, ["game_id", "team"]), "date_modified", "kickoff")
    latest = latest_version(timely, ["game_id", "team", "player"], "date_modified", ["report_status", "position"])
    history = share_to_date(appearances.withColumn("us", micros(F.col("kickoff"))), "player", "us", "role_share")
    valued = asof_prior(latest.withColumn("us", micros(F.col("kickoff"))), history, ["player"], "us", ["share_to_date"])
    share = F.coalesce(F.col("share_to_date"), F.lit(0.0))
    weight = status_weight(F.col("report_status"), out, doubtful, doubtful_weight)
    missing = F.coalesce(F.col("report_status").isin(*out), F.lit(False))
    scored = valued.select(
        "game_id", "team",
        (lookup(F.col("position"), positions, DEFAULT_POSITION_VALUE) * share * weight).alias("impact"),
        ((F.col("position") == "QB") & missing & (share >= STARTER_SHARE)).alias("starter_out"),
    )
    flagged = unmeasurable(team_games, timely, appearances)
    value = lambda c: F.when(~F.col("unmeasurable"), F.coalesce(F.col(c), F.lit(0.0))).alias(c)
    return flagged.join(impact_totals(scored), ["game_id", "team"], "left").select(
        "game_id", "team", value("injury_impact"), value("qb_out")
    )


# Line-ups are long rows (team, season, t, player, share): one contest per (team, t).


def contributors(lineups: DataFrame, threshold: float = CONTRIBUTOR_SHARE) -> DataFrame:
    return lineups.filter(F.col("share") >= threshold)


def carryover(lineups: DataFrame) -> DataFrame:
    """Share of this season's earlier weight held by members of last season's squad.

    Null without an earlier contest this season or without a squad last season.
    """
    squads = lineups.select("team", (F.col("season") + 1).alias("season"), "player").distinct().withColumn("_back", F.lit(1))
    known = lineups.select("team", (F.col("season") + 1).alias("season")).distinct().withColumn("_known", F.lit(1))
    marked = lineups.join(squads, ["team", "season", "player"], "left").join(known, ["team", "season"], "left")
    sums = {
        "total": F.col("share"),
        "back": F.when(F.col("_back") == 1, F.col("share")).otherwise(0.0),
        "known": F.col("_known"),
    }
    prior = prior_sums(marked, ["team", "season"], "t", sums)
    value = F.when(F.col("known") > 0, safe_div(F.col("back"), F.when(F.col("total") > 0, F.col("total"))))
    return prior.select("team", "season", "t", value.alias("roster_carryover"))


def _games(lineups: DataFrame) -> DataFrame:
    return lineups.select("team", "season", "t").distinct()


def stability(lineups: DataFrame) -> DataFrame:
    """Mean weighted overlap of consecutive earlier line-ups in the season.

    Each line-up row is counted once at its own contest and once at the next, so
    the overlap is one aggregate over long rows: no line-up is ever collected.
    """
    nxt = neighbour(_games(lineups), ["team", "season"], ["t"], {"next_t": "t"}, step=1)
    own = lineups.select("team", "season", "t", "player", F.col("share").alias("cur"), F.lit(0.0).alias("prev"))
    carried = (
        lineups.join(nxt.filter(F.col("next_t").isNotNull()), ["team", "season", "t"])
        .select("team", "season", F.col("next_t").alias("t"), "player", F.lit(0.0).alias("cur"), F.col("share").alias("prev"))
    )
    per_player = own.unionByName(carried).groupBy("team", "season", "t", "player").agg(
        F.sum("cur").alias("cur"), F.sum("prev").alias("prev")
    )
    overlap = per_player.groupBy("team", "season", "t").agg(
        F.sum(F.least("cur", "prev")).alias("lo"), F.sum(F.greatest("cur", "prev")).alias("hi"), F.sum("prev").alias("had")
    ).withColumn("overlap", F.when(F.col("had") > 0, safe_div(F.col("lo"), F.col("hi"))))
    prior = prior_sums(overlap, ["team", "season"], "t", {"s": F.col("overlap"), "n": F.col("overlap").isNotNull().cast("int")})
    return prior.select("team", "season", "t", safe_div(F.col("s"), F.when(F.col("n") > 0, F.col("n"))).alias("lineup_stability"))


def tenure(lineups: DataFrame) -> DataFrame:
    """Mean number of earlier appearances, weighted by the previous contest's line-up."""
    seen = prior_sums(lineups, ["team", "player"], "t", {"games": F.lit(1)}, inclusive=True)
    after = (
        lineups.join(seen, ["team", "player", "t"])
        .groupBy("team", "season", "t")
        .agg(F.sum(F.col("share") * F.col("games")).alias("wg"), F.sum("share").alias("w"))
        .withColumn("after", safe_div(F.col("wg"), F.when(F.col("w") > 0, F.col("w"))))
    )
    return neighbour(after, ["team"], ["t"], {"snap_weighted_tenure": "after"}, step=-1).select(
        "team", "season", "t", "snap_weighted_tenure"
    )


def continuity(lineups: DataFrame) -> DataFrame:
    """All three measures per (team, season, t)."""
    keys = ["team", "season", "t"]
    return carryover(lineups).join(stability(lineups), keys).join(tenure(lineups), keys)
