"""Picks, freezing, readiness calendar and contracts."""
import datetime as dt

import pytest
from pyspark.sql import functions as F

from priorlake.functions import scalars as sc
from priorlake.operators import assemble, evaluate, folds
from priorlake.operators import ledger as lg
from priorlake.sources import contracts, tables

D = dt.datetime


@pytest.fixture(autouse=True)
def utc(spark):
    spark.conf.set("spark.sql.session.timeZone", "UTC")


@pytest.mark.parametrize("kick,due", [
    ("2026-09-25 00:15:00", "2026-09-23 20:00:00"),  # Thursday evening: Wednesday's report
    ("2026-09-27 17:00:00", "2026-09-25 20:00:00"),  # Sunday: Friday
    ("2026-09-29 00:15:00", "2026-09-26 20:00:00"),  # Monday evening: Saturday
    ("2026-12-19 18:00:00", "2026-12-17 21:00:00"),  # Saturday, winter time: Thursday
])
def test_report_calendar(spark, kick, due):
    got = spark.range(1).select(F.date_format(sc.report_due(F.lit(kick).cast("timestamp")), "yyyy-MM-dd HH:mm:ss")).first()[0]
    assert got == due


@pytest.mark.parametrize("day,time,utc", [
    ("2026-07-01", "13:00", "2026-07-01 17:00:00"), ("2026-07-01", None, "2026-07-01 17:00:00"), ("2026-01-10", "16:30", "2026-01-10 21:30:00"),
    ("2026-03-08", "02:30", None), ("2026-11-01", "01:30", None), ("2026-07-01", "??", None),
])
def test_local_times(spark, day, time, utc):
    df = spark.createDataFrame([(day, time)], "d string, t string")
    assert df.select(F.date_format(sc.local_to_utc(F.col("d"), F.col("t")), "yyyy-MM-dd HH:mm:ss")).first()[0] == utc


def test_push_leaves_the_denominator(spark):
    df = spark.createDataFrame([(9.0, 3.0), (9.0, 7.0), (9.0, -2.0)], "p double, a double")
    got = df.agg(*evaluate.line_record(F.col("p"), F.col("a"), F.lit(3.0))).first()
    assert (got["n"], got["wins"], got["losses"], got["pushes"]) == (2, 1, 1, 1)
    assert got["roi"] == pytest.approx((100 / 110 - 1) / 2)


def pick(spark, home, away, spread, total):
    df = spark.createDataFrame([(home, away, spread, total)], "h double, a double, s double, t double")
    return df.select(lg.picks(F.col("h"), F.col("a"), F.col("s"), F.col("t"), F.lit("H"), F.lit("A")).alias("p")).first()["p"]


def test_picks(spark):
    p = pick(spark, 24.1, 20.5, 5.5, 44.0)
    assert (p["spread"]["team"], p["spread"]["line"], p["spread"]["edge"]) == ("A", 5.5, 1.9)
    assert (p["total"]["side"], p["total"]["edge"]) == ("Over", 0.6)
    assert p["model"]["favorite"] == "H" and p["market"]["favorite"] == "H"
    on_line = pick(spark, 23.0, 20.0, 3.0, 43.0)
    assert on_line["spread"] is None and on_line["total"] is None
    assert pick(spark, 23.0, 20.0, None, 43.0) is None


REC = "game_id string, season int, week int, kickoff timestamp, generated_at timestamp, m_home double"


def test_started_rows_stand_and_unforecast_rows_stay(spark):
    old = spark.createDataFrame([("started", 1, 1, D(2024, 1, 1), D(2023, 12, 30), 1.0), ("skipped", 1, 1, D(2024, 1, 9), D(2023, 12, 30), 2.0),
                                 ("open", 1, 1, D(2024, 1, 9), D(2023, 12, 30), 3.0)], REC)
    new = spark.createDataFrame([("started", 1, 1, D(2024, 1, 1), D(2024, 1, 2), 9.0), ("open", 1, 1, D(2024, 1, 9), D(2024, 1, 2), 9.0)], REC)
    out = lg.freeze_started(new.withColumn("extra", F.lit(1)), old, F.lit("2024-01-05").cast("timestamp"))
    got = {x["game_id"]: (x["m_home"], x["extra"]) for x in out.collect()}
    assert got == {"started": (1.0, None), "skipped": (2.0, None), "open": (9.0, 1)}


def test_repeated_forecasts_keep_their_time(spark):
    old = spark.createDataFrame([("a", 1, 1, None, D(2024, 1, 1), 1.0), ("b", 1, 1, None, D(2024, 1, 1), None)], REC)
    new = spark.createDataFrame([("a", 1, 1, None, D(2024, 1, 2), 1.0), ("b", 1, 1, None, D(2024, 1, 2), 2.0)], REC)
    assert [x[0] for x in lg.reproduced(new, old).collect()] == ["a"]
    assert [x["game_id"] for x in lg.keep_reproduced(new, old).collect()] == ["b"]
    assert lg.changed_rows(old, old).count() == 0 and lg.changed_rows(new, old).count() == 2


def test_provisional_flag(spark):
    df = spark.createDataFrame([(" False",), ("true",), (None,), ("0",)], "f string")
    assert [x[0] for x in df.select(sc.is_provisional(F.col("f"))).collect()] == [True, False, False, True]


def test_ledger_round_trip(spark, tmp_path):
    path = str(tmp_path / "ledger")
    a = spark.createDataFrame([("a", 1, 1, None, None, 1.0), ("b", 1, 2, None, None, 1.0)], REC)
    tables.write_ledger(a, path)
    tables.write_ledger(a.filter("week = 2").withColumn("m_home", F.lit(5.0)).withColumn("x_home", F.lit(1.0)), path)
    got = {x["game_id"]: (x["m_home"], x["x_home"]) for x in tables.read_ledger(spark, path).collect()}
    assert got == {"a": (1.0, None), "b": (5.0, 1.0)}


def test_text_sinks(spark, tmp_path):
    df = spark.createDataFrame([("a", 1.5)], "k string, v double")
    tables.write_csv(df, str(tmp_path / "c"))
    assert tables.read_csv(spark, str(tmp_path / "c"), "k string, v double").collect() == df.collect()
    tables.write_json(df, str(tmp_path / "j"))
    assert spark.read.json(str(tmp_path / "j")).first()["v"] == 1.5


def test_newest_season_may_only_be_absent_before_it_starts(spark):
    df = spark.createDataFrame([(2000,), (2001,)], "season int")
    sched = spark.createDataFrame([(2002, D(2002, 9, 1))], "season int, kickoff timestamp")
    assert contracts.load_seasons(df, sched, [2000, 2001, 2002], D(2002, 9, 3)).count() == 2
    with pytest.raises(ValueError):
        contracts.load_seasons(df, sched, [2000, 2001, 2002], D(2002, 9, 20))
    with pytest.raises(ValueError):
        contracts.load_seasons(df, sched, [1999, 2000, 2001], D(2001, 9, 20))


def test_forbidden_and_missing_columns(spark):
    df = spark.createDataFrame([(1.0, 2.0)], "a double, spread_line double")
    with pytest.raises(ValueError):
        assemble.guard_columns(df, {"spread_line"})
    with pytest.raises(KeyError):
        assemble.interactions(df, [("x", "a", "zzz")])


def test_disagreeing_members_are_an_error(spark):
    schema = "model string, game_id string, season int, week int, home_score double, away_score double, home_pred double, away_pred double"
    rows = [("a", "g", 1, 1, 10.0, 7.0, 9.0, 9.0), ("b", "g", 1, 1, 10.0, 7.0, 11.0, 5.0), ("a", "h", 1, 1, 1.0, 1.0, 2.0, 2.0)]
    out = assemble.combine_members(spark.createDataFrame(rows, schema), ["a", "b"]).collect()
    assert [(x["game_id"], x["home_pred"], x["away_pred"]) for x in out] == [("g", 10.0, 7.0)]
    rows[1] = ("b", "g", 1, 1, 11.0, 7.0, 11.0, 5.0)
    with pytest.raises(Exception, match="members disagree"):
        assemble.combine_members(spark.createDataFrame(rows, schema), ["a", "b"]).collect()


def test_walk_forward_trains_on_earlier_rows_only(spark):
    rows = [(f"{s}{w}{g}", s, w, s * 400 + w * 7, 20.0, 10.0) for s in (1, 2, 3) for w in range(1, 5) for g in range(16)]
    df = spark.createDataFrame(rows, "game_id string, season int, week int, t int, home_score double, away_score double")
    seen = []

    def fit(train):
        seen.append(train.agg(F.max("t")).first()[0])
        return seen[-1]

    out = folds.walk_forward(df, fit, lambda m, test: test.select("game_id", "t", F.lit(m).alias("last")), by="week")
    assert out.filter("last >= t").count() == 0 and out.count() == 64 and len(seen) == 4
    assert out.groupBy("game_id").count().filter("count > 1").count() == 0
    table = folds.fold_table(df)
    assert [x["n_train"] for x in table.orderBy("week").collect()] == [128, 144, 160, 176]
    assert folds.leakage_audit(df, folds.training_used(df, table)).filter("leaks <> 0").count() == 0


def test_fingerprint_ignores_order_and_sees_content(spark):
    df = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string")
    cols = [F.col("k"), F.col("v")]
    first = contracts.fingerprint(df, cols).first()
    assert contracts.fingerprint(df.orderBy(F.desc("k")).repartition(3), cols).first() == first
    assert contracts.fingerprint(df.replace({"a": "c"}), cols).first() != first


def test_a_late_row_is_a_leak(spark):
    from priorlake.operators import folds

    df = spark.createDataFrame([(f"g{k}", 1 + k // 6, k % 6, k, 1.0, 2.0) for k in range(18)], "game_id string, season int, week int, t int, home_score double, away_score double")
    plan = folds.fold_table(df, burn_in=1, min_rows=1)
    used = folds.training_used(df, plan)
    assert {x["leaks"] for x in folds.leakage_audit(df, used).collect()} == {0}
    late = F.col("cutoff") == 10
    one_more = used.withColumn("n_train", F.col("n_train") + late.cast("int")).withColumn("t_sum", F.col("t_sum") + F.when(late, 10).otherwise(0))
    swapped = used.withColumn("t_sum", F.col("t_sum") + F.when(late, 3).otherwise(0))
    own_day = used.withColumn("last_day", F.when(late, F.col("cutoff")).otherwise(F.col("last_day")))
    for broken in (one_more, swapped, own_day):
        assert {x["cutoff"] for x in folds.leakage_audit(df, broken).filter("leaks <> 0").collect()} == {10}


def test_stages_notice_changed_files(spark, tmp_path):
    from priorlake.plans import base

    folder = str(tmp_path)
    read = lambda: base.keep(spark, folder, "n", lambda: spark.read.parquet(f"{folder}/x.parquet")).count()
    spark.range(3).write.parquet(f"{folder}/x.parquet")
    assert read() == read() == 3
    spark.range(5).write.mode("overwrite").parquet(f"{folder}/x.parquet")
    assert read() == 5


def test_registry_refuses_what_it_cannot_run(spark):
    from priorlake.operators import registry

    def flat(table):
        return table.withColumns({"home_pred": F.lit(1.0), "away_pred": F.lit(3.0)})

    found = registry.Registry()
    found.add(registry.Model("flat", "t", flat))
    found.add(registry.Model("slow", "t", lambda t: flat(t).withColumn("home_pred", F.lit(2.0)), live=False))
    with pytest.raises(ValueError, match="already"):
        found.add(registry.Model("flat", "t", flat))
    for names in (["nobody"], ["flat", "flat"], ["slow"], []):
        with pytest.raises((KeyError, ValueError)):
            found.live(names)
    table = spark.createDataFrame([("g", 1, 1, 5.0, 6.0)], "game_id string, season int, week int, home_score double, away_score double")
    with pytest.raises(KeyError, match="needs the table"):
        found.forecasts(["flat"], {})
    assert found.composite(["flat", "slow"], {"t": table}).first()["home_pred"] == 1.5
