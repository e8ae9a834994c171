"""Two-level windows give what one window over the whole key would give."""
from pyspark.sql import Window
from pyspark.sql import functions as F

from priorlake.operators.places import sums_before_places
from priorlake.operators.prefix import asof_prior, by_width, neighbour, position, recent_rows


def skewed(spark, n=600):
    rows = [(0 if i % 3 else i % 5, (i * 53) % 400, i) for i in range(n)]
    return spark.createDataFrame(rows, "k int, t int, id int")


def test_asof_excludes_exact_matches(spark):
    right = spark.createDataFrame([(1, 10, 0.4), (1, 20, 0.6), (1, 30, 0.9)], "k int, t int, v double")
    left = spark.createDataFrame([(1, 30), (1, 10), (1, 1000), (2, 50)], "k int, t int")
    for width in (1, 15, 10_000):
        got = {(x["k"], x["t"]): x["v"] for x in asof_prior(left, right, ["k"], "t", ["v"], block=by_width(width)).collect()}
        assert got == {(1, 30): 0.6, (1, 10): None, (1, 1000): 0.9, (2, 50): None}


def test_neighbour_in_blocks(spark):
    df = skewed(spark)
    over = Window.partitionBy("k").orderBy("t", "id")
    for step, fn in ((-1, F.lag), (1, F.lead)):
        want = {x["id"]: x["n"] for x in df.withColumn("n", fn("id").over(over)).collect()}
        for block in (None, F.floor(F.col("t") / 17)):
            out = neighbour(df, ["k"], ["t", "id"], {"n": "id"}, step=step, block=block)
            assert {x["id"]: x["n"] for x in out.collect()} == want


def test_recent_rows_in_blocks(spark):
    df = skewed(spark)
    plain = {x["id"]: [s["id"] for s in x["seq"]] for x in recent_rows(df, ["k"], ["t", "id"], ["id"], 8, "seq").collect()}
    for width in (1, 40, 1000):
        out = recent_rows(df, ["k"], ["t", "id"], ["id"], 8, "seq", block=F.floor(F.col("t") / width))
        assert {x["id"]: [s["id"] for s in x["seq"]] for x in out.collect()} == plain


def test_position_counts_from_zero(spark):
    df = skewed(spark)
    want = {x["id"]: x["p"] for x in df.withColumn("p", F.row_number().over(Window.partitionBy("k").orderBy("t", "id")) - 1).collect()}
    for block in (None, by_width(25)):
        assert {x["id"]: x["p"] for x in position(df, ["k"], "t", ["id"], "p", block=block).collect()} == want


def test_sums_before_any_place(spark):
    df = skewed(spark, 100)
    ordered = [x["id"] for x in df.orderBy("t", "id").collect()]
    places = [0, 1, 17, 18, 60, 99, 100]
    marks = spark.createDataFrame([(p,) for p in places], "place long")
    got = {x["place"]: x["s"] for x in sums_before_places(df, [], "t", ["id"], marks, {"s": F.col("id").cast("double")}).collect()}
    assert got == {p: float(sum(ordered[:p])) for p in places}
