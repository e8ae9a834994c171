"""Data contracts, completeness checks and content fingerprints."""
from __future__ import annotations

import datetime as dt
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

OK, STOP, WAIT = 0, 1, 3


@dataclass(frozen=True)
class Contract:
    """What a table must satisfy; `ranges` maps a column to (low, high)."""

    required: tuple[str, ...] = ()
    unique: tuple[str, ...] = ()
    not_null: tuple[str, ...] = ()
    ranges: dict[str, tuple[float, float]] = field(default_factory=dict)


def check_contract(df: DataFrame, spec: Contract) -> DataFrame:
    """(check, value): null shares and range shares in one pass, plus repeated keys."""
    missing = [c for c in spec.required if c not in df.columns]
    if missing:
        raise ValueError(f"missing columns: {missing}")
    measures: dict[str, Column] = {"rows": F.count("*").cast("double")}
    for c in spec.not_null:
        measures[f"null_share:{c}"] = F.avg(F.col(c).isNull().cast("double"))
    for c, (lo, hi) in spec.ranges.items():
        measures[f"in_range_share:{c}"] = F.avg(F.when(F.col(c).isNotNull(), F.col(c).between(lo, hi).cast("double")))
    one = df.agg(*[v.alias(n) for n, v in measures.items()])
    pairs = [x for n in measures for x in (F.lit(n), F.col(f"`{n}`"))]
    out = one.select(F.stack(F.lit(len(measures)), *pairs).alias("check", "value"))
    if spec.unique:
        repeats = df.groupBy(*spec.unique).agg(F.count("*").alias("n")).agg(
            F.coalesce(F.sum((F.col("n") > 1).cast("double")), F.lit(0.0)).alias("value")
        )
        out = out.unionByName(repeats.select(F.lit("repeated_keys").alias("check"), "value"))
    return out


def orphans(child: DataFrame, key: str, parent: DataFrame, parent_key: str) -> DataFrame:
    """Child rows whose key has no parent."""
    return child.join(parent.select(F.col(parent_key).alias(key)).distinct(), key, "left_anti")


def pull_summary(df: DataFrame, dataset: str) -> DataFrame:
    """One metadata row: how much was pulled and which seasons it spans."""
    return df.agg(
        F.lit(dataset).alias("dataset"), F.count("*").alias("rows"),
        F.min("season").alias("first_season"), F.max("season").alias("last_season"),
    )


def load_seasons(df: DataFrame, schedule: DataFrame, wanted: list[int], now: dt.datetime, grace_days: int = 7) -> DataFrame:
    """Rows of the wanted seasons; only a newest season not yet underway may be absent.

    Two aggregates bring one row per season to the driver.
    """
    present = {r["season"] for r in df.groupBy("season").agg(F.count("*")).collect()}
    newest = max(wanted)
    absent = [s for s in wanted if s not in present]
    if absent:
        first = schedule.filter(F.col("season") == newest).agg(F.min("kickoff").alias("k")).collect()[0]["k"]
        underway = first is not None and now - first > dt.timedelta(days=grace_days)
        if absent != [newest] or underway or len(wanted) < 2:
            raise ValueError(f"no rows for seasons {absent}")
    return df.filter(F.col("season").isin([s for s in wanted if s not in absent]))


def completeness(
    schedule: DataFrame,
    finals: DataFrame,
    appearances: DataFrame,
    now: Column,
    *,
    unfinished: list[str] = (),
    grace_hours: int = 24,
    lag_hours: int = 36,
) -> DataFrame:
    """(severity, check, game_id) for every contest the sources disagree about.

    schedule     game_id, season, kickoff, home_score, away_score
    finals       game_id, total_home_score, total_away_score (last event state)
    appearances  game_id (may repeat)
    """
    scored = schedule.filter(F.col("home_score").isNotNull())
    hours = lambda n: F.expr(f"INTERVAL {n} HOURS")
    row = lambda df, severity, check: df.select(
        (severity if isinstance(severity, Column) else F.lit(severity)).alias("severity"),
        (check if isinstance(check, Column) else F.lit(check)).alias("check"), "game_id",
    )
    overdue = schedule.filter(
        F.col("home_score").isNull() & (F.col("kickoff") < now - hours(grace_hours)) & ~F.col("game_id").isin(list(unfinished))
    )
    recent = F.col("kickoff") > now - hours(lag_hours)
    joined = scored.join(finals, "game_id", "left")
    no_events = joined.filter(F.col("total_home_score").isNull())
    mismatch = joined.filter(
        (F.col("total_home_score") != F.col("home_score")) | (F.col("total_away_score") != F.col("away_score"))
    )
    newest = schedule.agg(F.max("season")).scalar()
    unseen = scored.filter(F.col("season") == newest).join(appearances.select("game_id").distinct(), "game_id", "left_anti")
    return (
        row(overdue, "error", "overdue_result")
        .unionByName(row(no_events, F.when(recent, "lagging").otherwise("error"), F.when(recent, "events_lagging").otherwise("events_missing")))
        .unionByName(row(mismatch, "error", "score_mismatch"))
        .unionByName(row(unseen, "warning", "no_appearances"))
    )


def action_code(problems: DataFrame) -> DataFrame:
    """0 go on, 1 stop, 3 wait for a lagging source."""
    errors = F.count_if(F.col("severity") == "error")
    lagging = F.count_if(F.col("severity") == "lagging")
    return problems.agg(
        F.when(errors > 0, STOP).when(lagging > 0, WAIT).otherwise(OK).alias("code"),
        errors.alias("errors"), lagging.alias("lagging"), F.count_if(F.col("severity") == "warning").alias("warnings"),
    )


def fingerprint(df: DataFrame, columns: list[Column], by: list[str] = (), digest: str = "xxhash64") -> DataFrame:
    """Row count and an order-free content sum. `md5` uses the first 60 bits of the digest."""
    if digest == "xxhash64":
        h = F.xxhash64(*columns)
    else:
        h = F.conv(F.substring(F.md5(F.concat_ws("|", *columns)), 1, 15), 16, 10)
    total = F.sum(h.cast("decimal(20,0)")).cast("string")
    return df.groupBy(*by).agg(F.count("*").alias("rows"), total.alias("content"))


def stale(stored: DataFrame, current: DataFrame, on: list[str]) -> DataFrame:
    """Keys with `stale` = 1 where the stored fingerprint is missing or differs."""
    s = stored.select(*on, F.col("rows").alias("_r"), F.col("content").alias("_c"))
    same = F.col("rows").eqNullSafe(F.col("_r")) & F.col("content").eqNullSafe(F.col("_c"))
    return current.join(s, on, "full_outer").select(*on, (~same).cast("int").alias("stale"))


def rebuild_differences(rebuilt: DataFrame, stored: DataFrame) -> DataFrame:
    """(check, n): columns and rows found on one side only; all zero means the rebuild is exact."""
    only_new, only_old = set(rebuilt.columns) - set(stored.columns), set(stored.columns) - set(rebuilt.columns)
    shared = [c for c in stored.columns if c in rebuilt.columns]
    a, b = rebuilt.select(*shared), stored.select(*shared)
    count = lambda df, name: df.agg(F.count("*").alias("n")).select(F.lit(name).alias("check"), "n")
    columns = rebuilt.sparkSession.range(1).select(
        F.explode(F.array(
            F.struct(F.lit("columns_added").alias("check"), F.lit(len(only_new)).cast("long").alias("n")),
            F.struct(F.lit("columns_lost").alias("check"), F.lit(len(only_old)).cast("long").alias("n")),
        )).alias("_x")
    ).select("_x.*")
    return columns.unionByName(count(a.exceptAll(b), "rows_added")).unionByName(count(b.exceptAll(a), "rows_lost"))


def prediction_problems(predictions: DataFrame, plausible_max: float = 70.0) -> DataFrame:
    """Per model: anything that makes its numbers untrustworthy, in one aggregate."""
    out = []
    for side in ("home", "away"):
        p = F.col(f"{side}_pred")
        out += [
            F.count_if(p.isNull()).alias(f"{side}_null"), F.count_if(p < 0).alias(f"{side}_negative"),
            F.count_if(p > plausible_max).alias(f"{side}_implausible"),
            (F.min(p) == F.max(p)).cast("int").alias(f"{side}_constant"),
        ]
    unscored = F.count_if(F.col("home_score").isNull() | F.col("away_score").isNull()).alias("unscored")
    per_contest = predictions.groupBy("model", "game_id").agg(F.count("*").alias("_n"))
    repeats = per_contest.groupBy("model").agg(F.sum(F.col("_n") - 1).alias("repeated"))
    return predictions.groupBy("model").agg(*out, unscored).join(repeats, "model")
