"""What several steps read is folded from the tables once and then read as a written stage."""
import os

import pytest
from pyspark.sql import functions as F

from priorlake.operators import folds, ratings, rollup
from priorlake.plans import base, catalog, models

FOLDER = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="tables not present")


def plan_of(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


@pytest.fixture(scope="module", autouse=True)
def registered():
    catalog.queries()
    yield
    base.forget()


def test_poisson_arms_read_one_written_table(spark, monkeypatch):
    """Numbering, moments, Newton rounds and scoring read the arms' table; none may run its joins again."""
    seen = []
    monkeypatch.setattr(models, "glm_forecasts", lambda s, f, arms, table, weights: seen.append(table))
    monkeypatch.setattr(models, "arm_table", lambda forecasts, control: None)
    table = base.model_table(spark, FOLDER)
    wide = table.join(table.groupBy("season").count(), "season")
    models.compare_poisson(spark, FOLDER, wide, {"control": models.Arm(models.FEATURES)})
    assert "Join" not in plan_of(seen[0]) and seen[0].count() == wide.count()


def test_segments_and_line_ups_are_folded_once(spark):
    for frame, built in ((base.drives, base.build_drives), (base.lineups, lambda s, f: base.build_lineups(s, f, 0.03))):
        kept, fresh = frame(spark, FOLDER), built(spark, FOLDER)
        assert "Join" not in plan_of(kept) and "Join" in plan_of(fresh)
        assert kept.schema.simpleString() == fresh.schema.simpleString()
        assert kept.exceptAll(fresh).isEmpty() and fresh.exceptAll(kept).isEmpty()


def test_families_in_one_pass_equal_the_single_rollups(spark):
    """The same rates as from three roll-ups, unknown sides and measures included, with one scan of the events."""
    rows = [
        ("g", "A", "B", 0.5, 0.1, 1, 1, 0, "made", 30.0), ("g", "A", "B", 0.9, 0.3, 1, 0, 1, "missed", None), ("g", "B", "A", 0.2, None, 0, 0, 1, None, 9.0),
        ("g", "B", None, 0.8, 0.7, 0, 0, 0, "made", 12.0), ("g", None, "A", 0.4, -0.5, 1, 1, 1, "made", 5.0), ("h", "A", "C", None, 0.2, None, None, None, None, None),
    ]
    names = "game_id string, posteam string, defteam string, wp double, epa double, fumble int, fumble_lost int, interception int, fg string, qty double"
    df = spark.createDataFrame(rows, names).withColumn("success", F.lit(1))
    on, cols = ["game_id", "team"], models.DOUBT + models.LUCK + models.KICKS
    apart = rollup.competitive(df).join(rollup.turnover_luck(df), on, "full_outer").join(rollup.attempts(df, "fg", "made", "qty"), on, "full_outer")
    shown = lambda x: sorted(x.select(*on, *[F.round(F.col(c).cast("double"), 9).alias(c) for c in cols]).collect(), key=lambda r: r[:2])
    assert shown(rollup.families(df, "fg", "made", "qty")) == shown(apart)


def test_ratings_are_solved_once_for_both_sides(spark):
    """The arms' table reads written ratings twice; the pair sums and the solves behind them must not run again for each side."""
    plan = plan_of(models.rated_table(spark, FOLDER))
    assert "FlatMapGroupsInPandas" not in plan
    fresh = ratings.two_way_ratings(base.facts(spark, FOLDER), folds.cutoffs(base.facts(spark, FOLDER)), "off_epa_per_play")
    shown = lambda df: sorted(tuple(r) for r in df.select("season", "week", "team", F.round("off", 9), F.round("def", 9)).collect())
    assert shown(models.two_way(spark, FOLDER)) == shown(fresh)
