"""Contest-level assembly from entity-level features."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def attach_sided(contests: DataFrame, features: DataFrame, on: list[str], columns: list[str], entity: str = "team") -> DataFrame:
    """Entity features joined once per side as `home_<c>` and `away_<c>`.

    `features` is unique on (entity, *on); the row count never changes.
    """
    out = contests
    for side in ("home", "away"):
        sided = features.select(
            *on, F.col(entity).alias(f"{side}_team"), *[F.col(c).alias(f"{side}_{c}") for c in columns]
        )
        out = out.join(sided, [*on, f"{side}_team"], "left")
    return out


def normalise_codes(df: DataFrame, codes: dict[str, str], columns: list[str]) -> DataFrame:
    return df.replace(codes, subset=columns)


def guard_columns(df: DataFrame, forbidden: set[str]) -> DataFrame:
    """The frame itself, unless it carries a column that must never become a feature."""
    leaked = sorted(forbidden & set(df.columns))
    if leaked:
        raise ValueError(f"forbidden columns present: {leaked}")
    return df


def interactions(df: DataFrame, terms: list[tuple[str, str, str]]) -> DataFrame:
    """Product columns; a missing input is an error rather than a column of nulls."""
    for name, a, b in terms:
        missing = [c for c in (a, b) if c not in df.columns]
        if missing:
            raise KeyError(f"cannot build {name}: {missing} absent")
    return df.select("*", *[(F.col(a) * F.col(b)).alias(n) for n, a, b in terms])


def impute(df: DataFrame, means: DataFrame, on: list[str], columns: list[str]) -> DataFrame:
    """Nulls replaced by the training-fold means in `means` (columns `mean_<c>`)."""
    joined = df.join(means, on)
    return joined.select(
        *[F.coalesce(c, f"mean_{c}").alias(c) if c in columns else F.col(c) for c in df.columns]
    )


def oriented_pairs(features: DataFrame, contests: DataFrame, columns: list[str]) -> DataFrame:
    """Both sides of a contest in home/away orientation.

    The two entity rows of a contest are folded in one aggregate and then
    oriented by the schedule, which avoids pairing rows inside a group.
    """
    values = F.struct(*columns)
    folded = features.groupBy("game_id").agg(
        F.map_from_entries(F.collect_set(F.struct(F.col("team"), values))).alias("_by")
    )
    joined = contests.join(folded, "game_id")
    keep = [c for c in contests.columns]
    pick = lambda side, c: F.try_element_at("_by", F.col(f"{side}_team"))[c]
    return joined.filter(
        F.map_contains_key("_by", F.col("home_team")) & F.map_contains_key("_by", F.col("away_team"))
    ).select(*keep, *[pick(s, c).alias(f"{s}_{c}") for s in ("home", "away") for c in columns])


def require_same_keys(frames: dict[str, DataFrame], key: str, agree: list[str]) -> DataFrame:
    """Disagreements between members on shared columns, one row per (key, column)."""
    named = [f.select(F.lit(n).alias("member"), key, *agree) for n, f in frames.items()]
    both = named[0]
    for f in named[1:]:
        both = both.unionByName(f)
    marked = both.groupBy(key).agg(
        F.count("*").alias("members"),
        F.countDistinct("member").alias("distinct_members"),
        *[F.count_distinct(F.coalesce(F.col(c).cast("string"), F.lit("<null>"))).alias(c) for c in agree],
    )
    stacked = F.stack(F.lit(len(agree)), *[x for c in agree for x in (F.lit(c), F.col(c))]).alias("column", "versions")
    return marked.select(key, "members", "distinct_members", stacked)


def combine_members(predictions: DataFrame, members: list[str], name: str = "composite") -> DataFrame:
    """Equal-weight mean over contests that every member predicted exactly once.

    Members must agree on season, week and score; a disagreement raises in the
    plan rather than dropping the contest.
    """
    keys = ["season", "week", "home_score", "away_score"]
    pool = predictions.filter(F.col("model").isin(*members))
    spread = sum_flags([F.count_distinct(F.coalesce(F.col(k).cast("string"), F.lit("<null>"))) > 1 for k in keys])
    folded = pool.groupBy("game_id").agg(
        F.count("*").alias("_rows"),
        F.count_distinct("model").alias("_models"),
        spread.alias("_conflicts"),
        *[F.max(c).alias(c) for c in predictions.columns if c not in ("model", "game_id", "home_pred", "away_pred")],
        F.avg("home_pred").alias("home_pred"),
        F.avg("away_pred").alias("away_pred"),
    )
    bad = (F.col("_conflicts") > 0) | (F.col("_rows") != F.col("_models"))
    checked = folded.withColumn(
        "home_pred",
        F.when(bad, F.raise_error(F.concat(F.lit("members disagree or repeat on contest "), F.col("game_id"))).cast("double")).otherwise(
            F.col("home_pred")
        ),
    )
    return checked.filter(F.col("_models") == len(members)).select(
        F.lit(name).alias("model"), *[c for c in predictions.columns if c != "model"]
    )


def sum_flags(flags: list[Column]) -> Column:
    total = F.lit(0)
    for f in flags:
        total = total + f.cast("int")
    return total
