"""Contests between nations, derived from order lines, and other stand-in inputs.

An order line is an event: its buyer (customer nation) has the ball, its seller
(supplier nation) defends. All lines between two nations in one month make one
contest; the score of a side is the quantity it bought.
"""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from priorlake.operators.temporal import epoch_day, micros
from priorlake.sources.tables import read_table

PASS, RUN = "A", "R"  # return flags standing in for the two kinds of counted event


def lines(spark: SparkSession, folder: str) -> DataFrame:
    """Order lines with buyer and seller nation and their month."""
    line = read_table(
        spark, folder, "lineitem",
        ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice",
         "l_discount", "l_tax", "l_returnflag", "l_shipdate"],
    )
    order = read_table(spark, folder, "orders", ["o_orderkey", "o_custkey"])
    customer = read_table(spark, folder, "customer", ["c_custkey", "c_nationkey"])
    supplier = read_table(spark, folder, "supplier", ["s_suppkey", "s_nationkey"])
    return (
        line.join(order, F.col("l_orderkey") == F.col("o_orderkey"))
        .join(customer, F.col("o_custkey") == F.col("c_custkey"))
        .join(supplier, F.col("l_suppkey") == F.col("s_suppkey"))
        .select(
            "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber",
            F.col("l_quantity").alias("qty"), F.col("l_extendedprice").alias("price"),
            F.col("l_discount").alias("disc"), F.col("l_tax").alias("tax"),
            F.col("l_returnflag").alias("kind"),
            F.col("c_nationkey").alias("buyer"), F.col("s_nationkey").alias("seller"),
            F.to_date("l_shipdate").alias("day"),
            F.trunc(F.to_date("l_shipdate"), "month").alias("month"),
        )
    )


def game_id(month, one, other):
    low, high = F.least(one, other), F.greatest(one, other)
    pad = lambda c: F.lpad(c.cast("string"), 2, "0")
    return F.concat_ws("_", F.date_format(month, "yyyyMM"), pad(low), pad(high))


def plays(spark: SparkSession, folder: str) -> DataFrame:
    """Events of contests: lines between two different nations, in play-by-play terms."""
    return (
        lines(spark, folder)
        .filter(F.col("buyer") != F.col("seller"))
        .select(
            game_id(F.col("month"), F.col("buyer"), F.col("seller")).alias("game_id"),
            F.col("buyer").alias("posteam"), F.col("seller").alias("defteam"),
            "month", "day", "kind", "qty", "price", "disc", "tax",
            "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey",
            (F.col("tax") - F.col("disc")).alias("epa"),
            (F.col("disc") >= 0.05).cast("int").alias("success"),
            (F.col("tax") - 0.04).alias("cpoe"),
        )
    )


def contests_from(pairs: DataFrame, sums: list[str] | None = None) -> DataFrame:
    """Schedule rows from (month, posteam, defteam) totals `qty`, `n`, `last_day`.

    Each of `sums` is added once per direction: `h_*` when home has the ball, `a_*` when away has.
    """
    a, b = F.least("posteam", "defteam"), F.greatest("posteam", "defteam")
    extra = [
        F.sum(F.when(F.col("posteam") == F.col(f"{side}_team"), F.col(n))).alias(f"{side[0]}_{n}")
        for n in sums or []
        for side in ("home", "away")
    ]
    return (
        pairs.withColumn("home_team", a)
        .withColumn("away_team", b)
        .groupBy("month", "home_team", "away_team")
        .agg(
            F.coalesce(F.sum(F.when(F.col("posteam") == F.col("home_team"), F.col("qty"))), F.lit(0.0)).alias("home_score"),
            F.coalesce(F.sum(F.when(F.col("posteam") == F.col("away_team"), F.col("qty"))), F.lit(0.0)).alias("away_score"),
            F.sum("n").alias("_n"),
            F.max(F.when(F.col("posteam") == F.col("home_team"), F.col("last_day"))).alias("_hd"),
            F.max(F.when(F.col("posteam") == F.col("away_team"), F.col("last_day"))).alias("_ad"),
            *extra,
        )
        .select(
            game_id(F.col("month"), F.col("home_team"), F.col("away_team")).alias("game_id"),
            F.year("month").alias("season"),
            F.month("month").alias("week"),
            F.col("month").alias("gameday"),
            epoch_day(F.col("month")).alias("t"),
            "home_team", "away_team", "home_score", "away_score",
            F.when((F.col("home_team") + F.col("away_team")) % 13 != 0,
                   F.concat(F.lpad(((F.col("home_team") * 7 + F.col("away_team") * 3) % 24).cast("string"), 2, "0"), F.lit(":00"))
                   ).alias("gametime"),
            F.when((F.col("home_team") + F.col("away_team")) % 5 == 0, F.lit("Neutral")).otherwise(F.lit("Home")).alias("location"),
            F.when(F.month("month") == 12, F.lit("POST")).otherwise(F.lit("REG")).alias("game_type"),
            (F.col("_n") % 7 == 0).cast("int").alias("overtime"),
            F.datediff(F.last_day("month"), F.col("_hd")).alias("home_rest"),
            F.datediff(F.last_day("month"), F.col("_ad")).alias("away_rest"),
            *[f"{side}_{n}" for n in sums or [] for side in ("h", "a")],
        )
    )


def pair_totals(spark: SparkSession, folder: str) -> DataFrame:
    """Lines folded to (month, buyer, seller): the one pass over the event table."""
    return (
        lines(spark, folder)
        .filter(F.col("buyer") != F.col("seller"))
        .groupBy("month", F.col("buyer").alias("posteam"), F.col("seller").alias("defteam"))
        .agg(F.sum("qty").alias("qty"), F.count("*").alias("n"), F.max("day").alias("last_day"))
    )


def contests(spark: SparkSession, folder: str) -> DataFrame:
    return contests_from(pair_totals(spark, folder))


def with_market(contests_df: DataFrame) -> DataFrame:
    """Closing lines: a pair's previous contest sets the spread and total of the next."""
    from priorlake.operators.prefix import neighbour

    margin = contests_df.withColumn("_m", F.col("home_score") - F.col("away_score")).withColumn(
        "_s", F.col("home_score") + F.col("away_score")
    )
    return neighbour(
        margin, ["home_team", "away_team"], ["t"], {"spread_line": "_m", "total_line": "_s"}, step=-1
    ).drop("_m", "_s")


def customer_orders(spark: SparkSession, folder: str) -> DataFrame:
    """Entity histories with real ties: a customer's orders."""
    return read_table(spark, folder, "orders", ["o_orderkey", "o_custkey", "o_orderdate", "o_totalprice"]).select(
        "o_orderkey", "o_custkey", F.to_date("o_orderdate").alias("day"),
        epoch_day(F.to_date("o_orderdate")).alias("t"), "o_totalprice",
    )


def event_log(spark: SparkSession, folder: str) -> DataFrame:
    """Timestamped user events with integer micros."""
    return read_table(spark, folder, "events", ["event_id", "ts", "user_id", "event_type", "value"]).withColumn(
        "us", micros(F.col("ts"))
    )
