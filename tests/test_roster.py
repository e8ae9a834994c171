"""Availability and line-up gates."""
import datetime as dt

import pytest
from pyspark.sql import functions as F

from priorlake.operators import roster

D = dt.datetime


def test_latest_status_wins_in_any_order(spark):
    rows = [(1, "g", D(2024, 1, 1, 3, 34), "Questionable"), (1, "g", D(2024, 1, 1, 14, 17), "Out"), (1, "g", None, "Doubtful")]
    for order in (rows, rows[::-1]):
        df = spark.createDataFrame(order, "player int, game_id string, date_modified timestamp, report_status string")
        assert roster.latest_version(df, ["game_id", "player"], "date_modified", ["report_status"]).first()["report_status"] == "Out"


def test_share_to_date_and_lookup(spark):
    df = spark.createDataFrame([(1, 1, 0.0), (1, 2, 1.0)], "player int, us long, share double")
    got = [x["share_to_date"] for x in roster.share_to_date(df, "player", "us", "share").orderBy("us").collect()]
    assert got == [0.0, 0.5]


def test_late_reports_are_dropped_and_undated_stay(spark):
    df = spark.createDataFrame([(D(2024, 1, 2),), (D(2024, 1, 1),), (None,)], "m timestamp").withColumn("k", F.lit("2024-01-02").cast("timestamp"))
    assert roster.before_start(df, "m", "k").count() == 2


def test_unknown_is_not_zero(spark):
    games = spark.createDataFrame(
        [("a", 1, D(2024, 1, 2), True), ("b", 1, D(2024, 1, 9), True), ("c", 1, D(2024, 1, 16), False), ("d", 1, D(2023, 12, 1), True)],
        "game_id string, team int, kickoff timestamp, played boolean",
    )
    reports = spark.createDataFrame([("a", 1, 7, "QB", "Out", D(2024, 1, 1)), ("d", 1, 7, "QB", "Out", None)],
                                    "game_id string, team int, player int, position string, report_status string, date_modified timestamp")
    seen = spark.createDataFrame([("z", 1, 7, D(2024, 1, 1), 0.8)], "game_id string, team int, player int, kickoff timestamp, role_share double")
    got = {x["game_id"]: (x["injury_impact"], x["qb_out"]) for x in roster.availability(games, reports, seen).collect()}
    assert got == {"a": (0.8, 1.0), "b": (None, None), "c": (0.0, 0.0), "d": (None, None)}


def lineup(spark, rows):
    return spark.createDataFrame(rows, "team int, season int, t int, player string, share double")


def test_stability_same_and_disjoint(spark):
    same = [(1, 1, t, p, 0.5) for t in (1, 2, 3) for p in "ab"]
    assert roster.stability(lineup(spark, same)).orderBy("t").collect()[2]["lineup_stability"] == 1.0
    apart = [(1, 1, 1, "a", 1.0), (1, 1, 2, "b", 1.0), (1, 1, 3, "a", 1.0)]
    got = [x["lineup_stability"] for x in roster.stability(lineup(spark, apart)).orderBy("t").collect()]
    assert got == [None, None, 0.0]


def test_carryover_half_new_and_missing_season(spark):
    rows = [(1, 1, 1, "a", 1.0), (1, 2, 10, "a", 0.5), (1, 2, 10, "b", 0.5), (1, 2, 11, "c", 1.0)]
    got = [x["roster_carryover"] for x in roster.carryover(lineup(spark, rows)).orderBy("t").collect()]
    assert got == [None, None, 0.5]


def test_tenure_uses_the_previous_lineup(spark):
    rows = [(1, 1, 1, "a", 1.0), (1, 1, 2, "a", 0.5), (1, 1, 2, "b", 0.5), (1, 1, 3, "c", 1.0), (2, 1, 1, "a", 1.0)]
    got = {(x["team"], x["t"]): x["snap_weighted_tenure"] for x in roster.tenure(lineup(spark, rows)).collect()}
    assert got == {(1, 1): None, (1, 2): 1.0, (1, 3): 1.5, (2, 1): None}


def test_impact_sum_is_independent_of_order(spark):
    values = [0.1 * i + 1e-9 for i in range(11)]
    seen = set()
    for k in range(3):
        rows = [("g", 1, v, False) for v in values[k:] + values[:k]]
        df = spark.createDataFrame(rows, "game_id string, team int, impact double, starter_out boolean").repartition(k + 1)
        seen.add(roster.impact_totals(df).first()["injury_impact"])
    assert len(seen) == 1


@pytest.mark.parametrize("position,value", [("QB", 1.0), ("LS", 0.04), (None, 0.2), ("??", 0.2)])
def test_position_values(spark, position, value):
    from priorlake.functions.scalars import lookup

    df = spark.createDataFrame([(position,)], "p string")
    assert df.select(lookup(F.col("p"), roster.POSITION_VALUE, roster.DEFAULT_POSITION_VALUE)).first()[0] == value
