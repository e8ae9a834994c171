"""Event tables folded to contest and entity-contest facts."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from priorlake.functions.scalars import safe_div


def counted(kinds: tuple[str, ...] = ("A", "R"), side: str = "posteam") -> Column:
    """Events that measure a side: a counted kind with that side known."""
    return F.col("kind").isin(*kinds) & F.col(side).isNotNull()


PAIR_SUMS = ["plays", "epa", "succ", "pass_n", "pass_epa", "pass_cpoe", "rush_n", "rush_epa"]


def pair_sums() -> dict[str, Column]:
    c = F.col
    kind = lambda k, value: F.when(c("kind") == k, c(value))
    columns = [
        F.count(F.when(counted(), c("epa"))), F.sum(F.when(counted(), c("epa"))), F.sum(F.when(counted(), c("success"))),
        F.count(kind("A", "epa")), F.sum(kind("A", "epa")), F.sum(kind("A", "cpoe")), F.count(kind("R", "epa")), F.sum(kind("R", "epa")),
    ]
    return dict(zip(PAIR_SUMS, columns))


def pair_rollup(plays: DataFrame) -> DataFrame:
    """One row per (month, posteam, defteam) with additive sums.

    What one side gained is what the other allowed, so this single aggregate
    serves offence and defence alike; everything later works on its small result.
    """
    return plays.groupBy("month", "posteam", "defteam").agg(
        F.sum("qty").alias("qty"),
        F.count("*").alias("n"),
        F.max("day").alias("last_day"),
        *[c.alias(n) for n, c in pair_sums().items()],
    )


def wide_contests(pairs: DataFrame) -> DataFrame:
    """Schedule columns plus both directions' sums (`h_*`: home has the ball)."""
    from priorlake.sources.views import contests_from

    return contests_from(pairs, PAIR_SUMS)


def _side_stats(own: str, other: str) -> list[Column]:
    """Rates of one side: `own` prefixes what it did, `other` what it faced."""

    def block(p: str, names: tuple[str, ...]) -> list[Column]:
        n, rate, succ, pass_rate, pass_n, cpoe, rush_rate, rush_n = names
        plays = F.when(F.col(f"{p}_plays") > 0, F.col(f"{p}_plays"))
        return [
            plays.alias(n),
            safe_div(F.col(f"{p}_epa"), plays).alias(rate),
            safe_div(F.col(f"{p}_succ"), plays).alias(succ),
            safe_div(F.col(f"{p}_pass_epa"), F.col(f"{p}_pass_n")).alias(pass_rate),
            F.when(plays.isNotNull(), F.col(f"{p}_pass_n")).alias(pass_n),
            safe_div(F.col(f"{p}_pass_cpoe"), F.col(f"{p}_pass_n")).alias(cpoe),
            safe_div(F.col(f"{p}_rush_epa"), F.col(f"{p}_rush_n")).alias(rush_rate),
            F.when(plays.isNotNull(), F.col(f"{p}_rush_n")).alias(rush_n),
        ]

    return block(own, OFFENSE_COLS) + block(other, DEFENSE_COLS)


OFFENSE_COLS = (
    "off_plays", "off_epa_per_play", "off_success_rate", "off_pass_epa_per_play", "off_pass_plays", "off_cpoe",
    "off_rush_epa_per_play", "off_rush_plays",
)
DEFENSE_COLS = (
    "def_plays", "def_epa_per_play", "def_success_rate_allowed", "def_pass_epa_per_play_allowed", "def_pass_plays",
    "def_cpoe_allowed", "def_rush_epa_per_play_allowed", "def_rush_plays",
)


def both_sides(contests: DataFrame, home: list[Column], away: list[Column], keep: list[str]) -> DataFrame:
    """Two rows per contest from one pass: home and away structs exploded."""
    side = F.explode(F.array(F.struct(*home), F.struct(*away)))
    return contests.select(*keep, side.alias("_s")).select(*keep, "_s.*")


def entity_rows(contests: DataFrame, stats: bool = False) -> DataFrame:
    """One row per (contest, entity) with score, opponent, rest and context flags."""

    def columns(own: str, other: str, is_home: int) -> list[Column]:
        out = [
            F.col(f"{own}_team").alias("team"),
            F.col(f"{other}_team").alias("opponent"),
            F.col(f"{own}_score").alias("team_score"),
            F.col(f"{other}_score").alias("opp_score"),
            F.lit(is_home).alias("is_home"),
            F.col(f"{own}_rest").alias("rest_days"),
            (F.col("location") == "Neutral").cast("int").alias("is_neutral_site"),
            (F.col("game_type") != "REG").cast("int").alias("is_playoff"),
        ]
        return out + (_side_stats(own[0], other[0]) if stats else [])

    return both_sides(
        contests, columns("home", "away", 1), columns("away", "home", 0), ["game_id", "season", "week", "gameday", "t"]
    )


def facts(wide: DataFrame) -> DataFrame:
    """Entity-contest facts with offence and defence rates from `wide_contests`."""
    return entity_rows(wide, stats=True)


def first_by(value: str, order: list[str], condition: Column | None = None) -> Column:
    """Value of the earliest row, skipping rows where `condition` fails: an aggregate, not a window."""
    key = F.struct(*order)
    return F.min_by(value, key if condition is None else F.when(condition, key))


def dominant_actor(events: DataFrame, keys: list[str], actor: str, stats: dict[str, Column] | None = None) -> DataFrame:
    """The actor with most events per key; ties go to the smaller id. `stats` are that actor's aggregates, from the same pass."""
    stats = stats or {}
    counts = events.filter(F.col(actor).isNotNull()).groupBy(*keys, actor).agg(F.count("*").alias("n"), *[c.alias(n) for n, c in stats.items()])
    best = F.min_by(F.struct(actor, "n", *stats), F.struct((-F.col("n")).alias("rank"), F.col(actor)))
    return counts.groupBy(*keys).agg(best.alias("_b")).select(*keys, f"_b.{actor}", F.col("_b.n").alias("attempts"), *[f"_b.{n}" for n in stats])


def arm_rates(events: DataFrame, keys: list[str], arms: dict[str, Column], measures: dict[str, str]) -> DataFrame:
    """The same means under several predicates in one pass: `<arm>_<measure>` and `<arm>_n`."""
    out = []
    for arm, keep in arms.items():
        out.append(F.count(F.when(keep, F.lit(1))).alias(f"{arm}_n"))
        out += [F.avg(F.when(keep, F.col(c))).alias(f"{arm}_{m}") for m, c in measures.items()]
    return events.groupBy(*keys).agg(*out)


def segments(plays: DataFrame, order: list[str], outcomes: dict[str, tuple[float, float]], *, start: str, result: str, keys: list[str], extra: dict[str, Column] | None = None) -> DataFrame:
    """Events folded to segments: first start, first known result and both sides' points."""
    scored = F.create_map(*[F.lit(x) for k, v in outcomes.items() for x in (k, v[0])])
    conceded = F.create_map(*[F.lit(x) for k, v in outcomes.items() for x in (k, v[1])])
    return (
        plays.groupBy(*keys)
        .agg(
            first_by(start, order, F.col(start).isNotNull()).alias("start"),
            first_by(result, order, F.col(result).isNotNull()).alias("result"),
            *[c.alias(n) for n, c in (extra or {}).items()],
        )
        .withColumn("points", F.coalesce(F.try_element_at(scored, F.col("result")), F.lit(0.0)))
        .withColumn("def_points", F.coalesce(F.try_element_at(conceded, F.col("result")), F.lit(0.0)))
    )


def outcome_rates(drives: DataFrame, side: str, prefix: str, outcomes: list[str]) -> DataFrame:
    """Counts and rates of every outcome per (contest, side)."""
    n = F.count("*")
    cols = [n.alias(f"{prefix}_n")]
    for o in outcomes:
        name = o.lower().replace(" ", "_")
        hit = F.count_if(F.col("result") == o)
        cols += [hit.alias(f"{prefix}_{name}_count"), (hit / n).alias(f"{prefix}_{name}_rate")]
    cols += [F.sum("points").alias(f"{prefix}_points"), F.sum("def_points").alias(f"{prefix}_def_points")]
    return drives.groupBy("game_id", "gameday", "t", F.col(side).alias("team")).agg(*cols)


def crosstab(df: DataFrame, row: Column, col: Column, rows: list, cols: list, eps: float = 1e-9) -> DataFrame:
    """Row-normalised smoothed frequencies over a complete grid, long form (row, col, n, p).

    The grid comes from the two fixed domains, not from a join of the data.
    """
    spark = df.sparkSession
    grid = spark.range(1).select(
        F.explode(F.array(*[F.lit(x) for x in rows])).alias("row")
    ).select("row", F.explode(F.array(*[F.lit(x) for x in cols])).alias("col"))
    counts = df.groupBy(row.alias("row"), col.alias("col")).agg(F.count("*").alias("n"))
    smoothed = grid.join(counts, ["row", "col"], "left").select(
        "row", "col", F.coalesce("n", F.lit(0)).alias("n")
    )
    over = Window.partitionBy("row")
    mass = F.col("n") + F.lit(eps)
    return smoothed.withColumn("p", mass / F.sum(mass).over(over))


def shrinkage_constant(events: DataFrame, group: list[str], value: str, min_rows: int) -> DataFrame:
    """k = within-group variance / true between-group variance, from two aggregates."""
    per_group = (
        events.groupBy(*group)
        .agg(F.count("*").alias("n"), F.avg(value).alias("mean"), F.var_samp(value).alias("var"))
        .filter(F.col("n") >= min_rows)
    )
    return (
        per_group.agg(
            F.count("*").alias("groups"),
            F.avg("var").alias("sigma2"),
            F.var_samp("mean").alias("var_observed"),
            F.avg(F.col("var") / F.col("n")).alias("var_noise"),
        )
        .withColumn("var_true", F.greatest(F.col("var_observed") - F.col("var_noise"), F.lit(1e-9)))
        .withColumn("k", F.col("sigma2") / F.col("var_true"))
    )


# Families of side facts. Each is one conditional aggregate per (contest, side).


def pace(plays: DataFrame, tasks: int | None = None) -> DataFrame:
    """Volume of the side with the ball: events, segments and their ratio.

    Events are dealt by segment, fold to one row per segment where they lie, then to sides: no list of segments per side
    is kept or sent. `tasks` is in how many parts they are dealt, so that a part's size need not grow with the table.
    """
    real = F.col("kind").isNotNull() & F.col("posteam").isNotNull()
    means = {"off_no_huddle_rate": "no_huddle", "off_dropback_rate": "dropback", "off_pass_oe": "pass_oe"}
    slim = plays.filter(real).select("game_id", F.col("posteam").alias("team"), "drive", *means.values())
    dealt = slim.repartition(tasks, "drive") if tasks else slim.repartition("drive")
    sums = [f(c).alias(f"{n}_{c}") for c in means.values() for n, f in (("_s", F.sum), ("_n", F.count))]
    per = dealt.groupBy("drive", "game_id", "team").agg(F.count("*").alias("_n"), *sums)
    mean = lambda c: F.try_divide(F.sum(f"_s_{c}"), F.sum(f"_n_{c}"))
    out = per.groupBy("game_id", "team").agg(
        F.sum("_n").alias("off_plays"), F.count("drive").alias("off_drives"), *[mean(c).alias(n) for n, c in means.items()]
    )
    return out.withColumn("off_plays_per_drive", safe_div(F.col("off_plays"), F.col("off_drives")))


def competitive(plays: DataFrame, low: float = 0.20, high: float = 0.80) -> DataFrame:
    """Rates over events whose outcome is in doubt (both bounds included), outer-joined by side."""
    doubt = plays.filter(F.col("wp").between(low, high))
    off = doubt.filter(F.col("posteam").isNotNull()).groupBy("game_id", F.col("posteam").alias("team")).agg(
        F.avg("epa").alias("off_epa_competitive"), F.avg("success").alias("off_success_competitive"),
        F.count("*").alias("off_competitive_plays"),
    )
    faced = doubt.filter(F.col("defteam").isNotNull()).groupBy("game_id", F.col("defteam").alias("team")).agg(
        F.avg("epa").alias("def_epa_competitive"), F.avg("success").alias("def_success_competitive")
    )
    return off.join(faced, ["game_id", "team"], "full_outer")


def turnover_luck(plays: DataFrame) -> DataFrame:
    """Own and forced losses; the retained share is null without an attempt."""
    add = lambda c: F.coalesce(F.sum(c), F.lit(0))
    off = plays.filter(F.col("posteam").isNotNull()).groupBy("game_id", F.col("posteam").alias("team")).agg(
        add("fumble").alias("off_fumbles"), add("fumble_lost").alias("off_fumbles_lost"), add("interception").alias("off_interceptions")
    )
    off = off.withColumn(
        "off_fumble_retain_rate", F.when(F.col("off_fumbles") > 0, 1 - safe_div(F.col("off_fumbles_lost"), F.col("off_fumbles")))
    )
    faced = plays.filter(F.col("defteam").isNotNull()).groupBy("game_id", F.col("defteam").alias("team")).agg(
        add("fumble").alias("def_fumbles_forced"), add("fumble_lost").alias("def_fumbles_recovered"),
        add("interception").alias("def_interceptions"),
    )
    return off.join(faced, ["game_id", "team"], "full_outer")


def attempts(plays: DataFrame, result: str, made: str, distance: str) -> DataFrame:
    """Attempts, successes, success share and mean distance per (contest, side)."""
    tried = plays.filter(F.col(result).isNotNull() & F.col("posteam").isNotNull())
    out = tried.groupBy("game_id", F.col("posteam").alias("team")).agg(
        F.count("*").alias("fg_attempts"), F.count_if(F.col(result) == made).alias("fg_made"),
        F.avg(distance).alias("fg_avg_distance"),
    )
    return out.withColumn("fg_pct", safe_div(F.col("fg_made"), F.col("fg_attempts")))


def families(plays: DataFrame, result: str, made: str, distance: str, low: float = 0.20, high: float = 0.80) -> DataFrame:
    """Columns of competitive, turnover_luck and attempts that arms compare, from one pass over the events.

    Events fold to sums per (contest, side with the ball, other side); both sides' rates come from those few rows.
    """
    c = F.col
    doubt, tried = c("wp").between(low, high), c(result).isNotNull()
    pairs = plays.groupBy("game_id", "posteam", "defteam").agg(
        F.sum(F.when(doubt, c("epa"))).alias("_epa"), F.count(F.when(doubt, c("epa"))).alias("_epa_n"),
        F.coalesce(F.sum("fumble"), F.lit(0)).alias("_fumbles"), F.coalesce(F.sum("fumble_lost"), F.lit(0)).alias("_lost"),
        F.coalesce(F.sum("interception"), F.lit(0)).alias("_caught"), F.count(F.when(tried, F.lit(1))).alias("_tries"),
        F.count_if(c(result) == made).alias("_made"), F.sum(F.when(tried, c(distance))).alias("_far"), F.count(F.when(tried, c(distance))).alias("_far_n"),
    )

    def of(side: str) -> DataFrame:
        return pairs.filter(c(side).isNotNull()).groupBy("game_id", c(side).alias("team")).agg(*[F.sum(n).alias(n) for n in pairs.columns[3:]])

    mean = safe_div(c("_epa"), c("_epa_n"))
    off = of("posteam").select(
        "game_id", "team", mean.alias("off_epa_competitive"), c("_caught").alias("off_interceptions"),
        F.when(c("_fumbles") > 0, 1 - safe_div(c("_lost"), c("_fumbles"))).alias("off_fumble_retain_rate"),
        safe_div(c("_made"), c("_tries")).alias("fg_pct"), safe_div(c("_far"), c("_far_n")).alias("fg_avg_distance"),
    )
    faced = of("defteam").select("game_id", "team", mean.alias("def_epa_competitive"), c("_caught").alias("def_interceptions"))
    return off.join(faced, ["game_id", "team"], "full_outer")


def within_group_slope(df: DataFrame, group: list[str], x: str, y: str) -> DataFrame:
    """OLS slope after removing group means: sums of within-group moments, no second pass over rows."""
    n = F.count(F.when(F.col(x).isNotNull() & F.col(y).isNotNull(), F.lit(1)))
    ok = F.col(x).isNotNull() & F.col(y).isNotNull()
    moments = df.filter(ok).groupBy(*group).agg(
        (F.covar_pop(x, y) * n).alias("sxy"), (F.var_pop(x) * n).alias("sxx"), n.alias("n")
    )
    return moments.agg(
        safe_div(F.sum("sxy"), F.sum("sxx")).alias("slope"), F.sum("n").alias("n"), F.count("*").alias("groups")
    )


def correlation_matrix(df: DataFrame, key: str, member: str, value: str, members: list[str]) -> DataFrame:
    """(a, b, corr) over keys; one pivot and one aggregate."""
    wide = df.groupBy(key).pivot(member, members).agg(F.max(value))
    pairs = [(a, b) for a in members for b in members]
    corr = lambda a, b: F.try_divide(F.covar_pop(a, b), F.sqrt(F.var_pop(F.when(F.col(b).isNotNull(), F.col(a))) * F.var_pop(F.when(F.col(a).isNotNull(), F.col(b)))))
    row = wide.agg(*[corr(a, b).alias(f"{i}") for i, (a, b) in enumerate(pairs)])
    cells = [x for i, (a, b) in enumerate(pairs) for x in (F.lit(a), F.lit(b), F.col(f"`{i}`"))]
    return row.select(F.stack(F.lit(len(pairs)), *cells).alias("a", "b", "corr"))
