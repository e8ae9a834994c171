"""Segments and paces dealt by drive, against plain grouping by the contest's name."""
import os
import random
from datetime import date

import pytest
from pyspark.sql import functions as F

from priorlake.operators import rollup
from priorlake.plans import base
from priorlake.sources.tables import parts_of
from priorlake.sources.views import game_id

FOLDER = "/root/testdata/sf0.001"


def details(spark, n=600):
    rng = random.Random(5)
    pick = lambda *x: rng.choice(x)
    rows = [
        (rng.randint(1, 40), pick(date(1995, 1, 1), date(1995, 2, 1), None), pick(1, 2), pick(3, 12), rng.randint(1, 3), rng.randint(1, 4), 1,
         pick(date(1995, 1, 3), None), pick(1.0, 2.0), pick(5.0, 6.0), 0.0, 0.1, pick(10.0, 30.0, None), pick("Punt", "Touchdown", None))
        for _ in range(n)
    ]
    names = ["drive", "month", "posteam", "defteam", *base.PLAY_ORDER, "start", "result"]
    types = ["long", "date", "int", "int", "int", "long", "long", "date", "double", "double", "double", "double", "double", "string"]
    out = spark.createDataFrame(rows, ", ".join(f"{a} {b}" for a, b in zip(names, types)))
    return out.withColumn("game_id", game_id(F.col("month"), F.col("posteam"), F.col("defteam")))


def test_segments_by_numbers_are_segments_by_name(spark):
    rows = details(spark)
    keys = ["game_id", "month", "posteam", "defteam", "drive"]
    first = {"first_day": F.min("day")}
    want = rollup.segments(rows, base.PLAY_ORDER, base.OUTCOMES, start="start", result="result", keys=keys, extra=first)
    got = base.contest_segments(rows, first).select(*want.columns)
    assert want.count() == got.count() and want.exceptAll(got).isEmpty()
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1  # lines are dealt once, before they fold


def test_pace_deals_segments_in_parts_that_follow_the_table(spark):
    rows = details(spark).withColumns({"kind": F.when(F.col("qty") == 1, "A"), "no_huddle": F.lit(1), "dropback": F.col("l_linenumber"), "pass_oe": F.col("start")})
    rows = rows.withColumns({"kind": F.coalesce("kind", F.when(F.col("price") == 5, "R")), "drive": F.when(F.col("drive") > 3, F.col("drive"))})
    want = rows.filter("kind is not null").groupBy("game_id", F.col("posteam").alias("team")).agg(
        F.count("*").alias("off_plays"), F.count_distinct("drive").alias("off_drives"), F.avg("no_huddle").alias("off_no_huddle_rate"),
        F.avg("dropback").alias("off_dropback_rate"), F.avg("pass_oe").alias("off_pass_oe"),
    )
    got = rollup.pace(rows, 7).select(*want.columns)
    rounded = lambda df: sorted((tuple(round(x, 9) if isinstance(x, float) else x for x in r) for r in df.collect()), key=str)
    assert rounded(got) == rounded(want)


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="tables not present")
def test_parts_follow_the_table(spark):
    size = os.path.getsize(f"{FOLDER}/lineitem.parquet")
    assert parts_of(spark, FOLDER, "lineitem", size // 50) >= 50
    assert parts_of(spark, FOLDER, "lineitem") == int(spark.conf.get("spark.sql.shuffle.partitions"))


def test_dominant_actor_brings_its_own_aggregates(spark):
    rows = spark.createDataFrame([(1, 7, 1.0), (1, 7, 3.0), (1, 8, 9.0), (2, 5, None), (2, 4, 2.0), (3, None, 1.0)], "k int, actor int, epa double")
    got = rollup.dominant_actor(rows, ["k"], "actor", {"mean": F.avg("epa")}).orderBy("k").collect()
    assert [tuple(r) for r in got] == [(1, 7, 2, 2.0), (2, 4, 1, 2.0)]
