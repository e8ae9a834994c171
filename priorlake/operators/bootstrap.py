"""Block bootstrap over sums per block: rows are folded once, replicates touch blocks only."""
from __future__ import annotations

from math import exp, factorial

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

REPLICATES = 5000
SEED = 42


def block_sums(df: DataFrame, by: list[str], block: str, sums: dict[str, Column]) -> DataFrame:
    return df.groupBy(*by, block).agg(*[F.sum(c).alias(n) for n, c in sums.items()])


POINT = -1  # the replicate that draws every block once


def resample(blocks: DataFrame, by: list[str], block: str, sums: list[str], replicates: int = REPLICATES, seed: int = SEED) -> DataFrame:
    """(by, rep, sums): every replicate redraws as many blocks as its group has.

    Draw d of replicate r picks the block numbered md5(seed|r|d) mod n, so a
    replicate is the same wherever and however often it is computed, and groups
    over the same blocks are resampled alike (paired). Replicate -1 draws each
    block once and yields the point estimate. A group's block sums travel as one
    array (its length is the number of blocks, whatever the rows behind them),
    and replicates are dealt over all tasks; each adds up its draws by index.
    """
    value = F.struct(*[F.coalesce(F.col(c).cast("double"), F.lit(0.0)).alias(c) for c in sums])
    packed = blocks.groupBy(*by).agg(F.transform(F.array_sort(F.collect_list(F.struct(block, value.alias("v")))), lambda x: x["v"]).alias("_b"))
    reps = packed.withColumn("rep", F.explode(F.sequence(F.lit(POINT), F.lit(replicates - 1)))).repartition(*by, "rep")
    n = F.size("_b")
    hashed = lambda d: F.conv(
        F.substring(F.md5(F.concat_ws("|", F.lit(str(seed)), F.col("rep").cast("string"), d.cast("string"))), 1, 8), 16, 10
    ).cast("long")
    drawn = F.transform(F.sequence(F.lit(0), n - 1), lambda d: F.get(F.col("_b"), F.when(F.col("rep") == POINT, d).otherwise(F.pmod(hashed(d), n)).cast("int")))
    out = reps.withColumn("_x", drawn)
    total = lambda c: F.aggregate("_x", F.lit(0.0), lambda acc, x: acc + x[c])
    return out.select(*by, "rep", *[total(c).alias(c) for c in sums])


# How many of 2^32 equally likely numbers give a Poisson(1) count of at most 0, 1, 2, ...
POISSON = [int(2**32 * sum(exp(-1) / factorial(j) for j in range(k + 1))) for k in range(10)]
PER_HASH = 4


def row_resample(rows: DataFrame, by: list[str], row: str, sums: dict[str, Column], replicates: int = REPLICATES, seed: int = SEED) -> DataFrame:
    """(by, rep, sums) where every row is a block of its own: row i counts Poisson(1) times in replicate r.

    The count is a hash of (seed, stretch of PER_HASH replicates, row key), so rows need neither numbers nor each other:
    each one sends its own counts into sums by replicate, which are partial before the shuffle. Groups over the same
    rows are resampled alike (paired). Replicate -1 counts each row once and yields the point estimate.
    """
    values = [F.coalesce(c.cast("double"), F.lit(0.0)).alias(n) for n, c in sums.items()]
    stretch = F.explode(F.sequence(F.lit(POINT), F.lit((replicates - 1) // PER_HASH))).alias("_g")
    spread = rows.select(*by, F.col(row).cast("string").alias("_row"), *values).select("*", stretch)
    spread = spread.withColumn("_h", F.when(F.col("_g") != POINT, F.md5(F.concat_ws("|", F.lit(str(seed)), F.col("_g").cast("string"), F.col("_row")))))
    part = lambda k: F.conv(F.substring("_h", 8 * k + 1, 8), 16, 10).cast("long")
    count = lambda k: sum(((part(k) >= F.lit(edge)).cast("int") for edge in POISSON), F.lit(0))
    added = spread.select(*by, "_g", *sums, *[count(k).alias(f"_c{k}") for k in range(PER_HASH)]).groupBy(*by, "_g").agg(
        *[F.sum(n).alias(f"{n}_all") for n in sums], *[F.sum(F.col(n) * F.col(f"_c{k}")).alias(f"{n}_{k}") for n in sums for k in range(PER_HASH)]
    )
    one = F.struct(F.lit(POINT).alias("rep"), *[F.col(f"{n}_all").alias(n) for n in sums])
    many = [F.struct((F.col("_g") * PER_HASH + k).alias("rep"), *[F.col(f"{n}_{k}").alias(n) for n in sums]) for k in range(PER_HASH)]
    each = F.when(F.col("_g") == POINT, F.array(one)).otherwise(F.array(*many))
    return added.select(*by, F.explode(each).alias("_r")).select(*by, "_r.*").filter(F.col("rep") < replicates)


def interval(replicates: DataFrame, by: list[str], stats: dict[str, Column], probs=(0.025, 0.975)) -> DataFrame:
    """`<stat>`, `<stat>_lo` and `<stat>_hi` per group; a group holds as many rows as replicates."""
    out = []
    for name, stat in stats.items():
        q = F.percentile(F.when(F.col("rep") != POINT, stat), F.array(*[F.lit(p) for p in probs]))
        out += [F.max(F.when(F.col("rep") == POINT, stat)).alias(name), q[0].alias(f"{name}_lo"), q[1].alias(f"{name}_hi")]
    return replicates.groupBy(*by).agg(*out)


def mean_interval(df: DataFrame, by: list[str], block: str, values: dict[str, Column], replicates: int = REPLICATES, seed: int = SEED) -> DataFrame:
    """Interval of the mean of each value; null values leave numerator and denominator."""
    sums = {}
    for n, c in values.items():
        sums[f"{n}_s"], sums[f"{n}_c"] = c.cast("double"), c.isNotNull().cast("int")
    reps = resample(block_sums(df, by, block, sums), by, block, list(sums), replicates, seed)
    return interval(reps, by, {n: F.try_divide(F.col(f"{n}_s"), F.col(f"{n}_c")) for n in values})


def rmse_interval(df: DataFrame, by: list[str], block: str, home: str = "home_err", away: str = "away_err", replicates: int = REPLICATES, seed: int = SEED) -> DataFrame:
    """Interval of the pooled two-sided RMSE."""
    sums = {"sq": F.col(home) * F.col(home) + F.col(away) * F.col(away), "n": F.lit(2)}
    reps = resample(block_sums(df, by, block, sums), by, block, ["sq", "n"], replicates, seed)
    return interval(reps, by, {"rmse": F.sqrt(F.try_divide(F.col("sq"), F.col("n")))})


def paired_rmse_delta(paired: DataFrame, by: list[str], block: str, replicates: int = REPLICATES, seed: int = SEED, by_row: bool = False) -> DataFrame:
    """RMSE(candidate) - RMSE(reference) with interval and share of replicates below zero.

    `paired` has one row per contest with `sq_cand` and `sq_ref`: both sides'
    squared errors added up. `by_row`: `block` tells rows apart and each is a block of its own.
    """
    sums = {"c": F.col("sq_cand"), "r": F.col("sq_ref"), "n": F.lit(2)}
    blocks = block_sums(paired, by, block, sums)
    delta = F.sqrt(F.try_divide(F.col("c"), F.col("n"))) - F.sqrt(F.try_divide(F.col("r"), F.col("n")))
    reps = row_resample(paired, by, block, sums, replicates, seed) if by_row else resample(blocks, by, block, list(sums), replicates, seed)
    redrawn = F.col("rep") != POINT
    q = F.percentile(F.when(redrawn, delta), F.array(F.lit(0.025), F.lit(0.975)))
    return reps.groupBy(*by).agg(
        F.max(F.when(~redrawn, delta)).alias("delta"), q[0].alias("lo"), q[1].alias("hi"),
        F.avg(F.when(redrawn, (delta < 0).cast("double"))).alias("p_better"),
    )


def against(ev: DataFrame, reference: str, models: list[str] | None = None) -> DataFrame:
    """Rows of every other model beside the reference's squared errors on the same contest."""
    sq = F.col("home_err") * F.col("home_err") + F.col("away_err") * F.col("away_err")
    cand = ev.filter(F.col("model") != reference)
    if models is not None:
        cand = cand.filter(F.col("model").isin(*models))
    ref = ev.filter(F.col("model") == reference).select("game_id", sq.alias("sq_ref"))
    return cand.withColumn("sq_cand", sq).join(ref, "game_id")


def compare_arms(ev: DataFrame, control: str, block: str = "block", replicates: int = REPLICATES, seed: int = SEED) -> DataFrame:
    """Pooled RMSE per arm beside its paired difference from the control arm, in one pass.

    The control pairs with itself, so it appears with a difference of zero. Arms
    meet on their contest in a window of one row per arm, so the forecasts are
    computed once.
    """
    sq = F.col("home_err") * F.col("home_err") + F.col("away_err") * F.col("away_err")
    own = F.when(F.col("model") == control, sq)
    paired = ev.select("model", "game_id", block, sq.alias("sq_cand"), own.alias("_own"))
    paired = paired.withColumn("sq_ref", F.max("_own").over(Window.partitionBy("game_id"))).filter(F.col("sq_ref").isNotNull())
    sums = {"c": F.col("sq_cand"), "r": F.col("sq_ref"), "n": F.lit(2)}
    reps = resample(block_sums(paired, ["model"], block, sums), ["model"], block, list(sums), replicates, seed)
    level = F.sqrt(F.try_divide(F.col("c"), F.col("n")))
    delta = level - F.sqrt(F.try_divide(F.col("r"), F.col("n")))
    point = F.col("rep") == POINT
    q = F.percentile(F.when(~point, delta), F.array(F.lit(0.025), F.lit(0.975)))
    return reps.groupBy(F.col("model").alias("arm")).agg(
        (F.max(F.when(point, F.col("n"))) / 2).cast("long").alias("n_games"), F.max(F.when(point, level)).alias("rmse"),
        F.max(F.when(point, delta)).alias("delta"), q[0].alias("lo"), q[1].alias("hi"),
    )
