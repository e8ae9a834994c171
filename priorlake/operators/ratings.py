"""Opponent-adjusted ratings: a decayed ridge of offence and defence effects at every cutoff.

A cutoff's system has two unknowns for each team and one for the home side, and its matrix is sparse: one entry for each pair
that met. Up to DENSE_TEAMS teams a task solves a cutoff directly from its pair sums. Beyond that the systems of all cutoffs and
penalties are solved together by conjugate gradients: a round joins the pair sums with the search directions and adds
up what each team receives, so a cutoff of any size is spread over tasks; it stops when every residual is small.
"""
from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from priorlake.operators.prefix import prior_sums
from priorlake.operators.temporal import Exponential, decayed_prior, growth
from priorlake.sources.stages import written

RATING_ALPHA = 5.0
RATING_HALFLIFE = 119.0
MIN_ROWS = 100
DENSE_TEAMS = 500  # a matrix of 8 MB
TOLERANCE, ROUNDS = 1e-11, 500


def pair_history(games: DataFrame, cuts: DataFrame, rate: str, volume: Column | None, halflife: float) -> DataFrame:
    """Per cutoff and (team, opponent, is_home): decayed weight, weighted rate and row count before it.

    Rows fold to one per pair and day; running sums per pair stay valid until
    the pair's next day, so each pair is repeated once per later cutoff and no
    row is compared with cutoffs it does not reach.
    """
    y = F.col(rate).cast("double")
    base = F.lit(1.0) if volume is None else F.coalesce(volume.cast("double"), F.lit(0.0))
    usable = y.isNotNull() & (base > 0)
    pair = ["team", "opponent", "is_home"]
    fed = games.select(*pair, "t", F.when(usable, base).alias("w"), F.when(usable, base * y).alias("wy"), usable.cast("int").alias("rows"))
    counts = prior_sums(fed, pair, "t", {"rows": F.col("rows"), "games": F.lit(1)}, inclusive=True)
    own = fed.groupBy(*pair, "t").agg(F.coalesce(F.sum("w"), F.lit(0.0)).alias("w"), F.coalesce(F.sum("wy"), F.lit(0.0)).alias("wy"))
    earlier = decayed_prior(fed, pair, "t", {"_m": (F.col("wy"), F.col("w"))}, Exponential(halflife))
    running = counts.join(own, [*pair, "t"]).join(earlier, [*pair, "t"])
    valid = running.withColumn("_next", F.lead("t").over(Window.partitionBy(*pair).orderBy("t")))
    times = F.array_sort(F.collect_set(F.struct("cutoff", "season", "week")))
    listed = valid.withColumn("_cuts", cuts.agg(times).scalar())
    reach = F.filter("_cuts", lambda c: (c["cutoff"] > F.col("t")) & (F.col("_next").isNull() | (c["cutoff"] <= F.col("_next"))))
    at = listed.select(
        *pair, "t", (F.col("w") + F.col("_m_n")).alias("w"), (F.col("wy") + F.coalesce(F.col("_m") * F.col("_m_n"), F.lit(0.0))).alias("wy"),
        "rows", "games", F.explode(reach).alias("_c"),
    )
    fade = growth(F.col("t").cast("double"), halflife, F.col("_c.cutoff"))
    return at.select("_c.season", "_c.week", "_c.cutoff", *pair, (F.col("w") * fade).alias("w"), (F.col("wy") * fade).alias("wy"), "rows", "games")


def solve_ratings(w, wy, off, deff, home, k: int, alpha: float) -> np.ndarray:
    """Ridge with a free intercept on [offence | defence | home] dummies from pair sums."""
    size = 2 * k + 1
    rows = np.vstack([off, k + deff]).T
    gram, xy, xsum = np.zeros((size, size)), np.zeros(size), np.zeros(size)
    for a in (rows[:, 0], rows[:, 1]):
        np.add.at(xsum, a, w)
        np.add.at(xy, a, wy)
        np.add.at(gram, (a, a), w)
        np.add.at(gram, (a, np.full(len(a), 2 * k)), w * home)
        np.add.at(gram, (np.full(len(a), 2 * k), a), w * home)
    np.add.at(gram, (rows[:, 0], rows[:, 1]), w)
    np.add.at(gram, (rows[:, 1], rows[:, 0]), w)
    gram[2 * k, 2 * k] = np.sum(w * home)
    xsum[2 * k], xy[2 * k] = np.sum(w * home), np.sum(wy * home)
    total, ysum = w.sum(), wy.sum()
    centred = gram - np.outer(xsum, xsum) / total
    return np.linalg.solve(centred + alpha * np.eye(size), xy - xsum * ysum / total)


def two_way_ratings(
    games: DataFrame,
    cuts: DataFrame,
    rate: str,
    *,
    volume: Column | None = None,
    alphas: tuple[float, ...] = (RATING_ALPHA,),
    halflife: float = RATING_HALFLIFE,
    min_rows: int = MIN_ROWS,
    dense_teams: int | None = None,
) -> DataFrame:
    """(season, week, team, alpha, off, def) solved from rows strictly before each cutoff.

    games  team, opponent, is_home, t and the rate. Teams without a row before a cutoff are rated 0 there.
    """
    # Written once: the sums, the cutoffs with enough rows and every solve read it.
    pairs = written(pair_history(games, cuts, rate, volume, halflife), "pair_history")
    counted = "games" if volume is None else "rows"
    enough = pairs.groupBy("season", "week").agg(F.sum(counted).alias("_n")).filter(F.col("_n") >= min_rows).select("season", "week")
    used = pairs.filter("w > 0").join(enough, ["season", "week"]).select("season", "week", "team", "opponent", "is_home", "w", "wy")
    teams = games.select("team").distinct()
    solve = dense_ratings if teams.count() <= (DENSE_TEAMS if dense_teams is None else dense_teams) else sparse_ratings
    times = enough.agg(F.collect_list(F.struct("season", "week"))).scalar()  # one entry for each cutoff
    levels = F.array(*[F.lit(float(a)) for a in alphas])
    every = teams.withColumn("_at", F.explode(times)).withColumn("alpha", F.explode(levels)).select("_at.season", "_at.week", "team", "alpha")
    rated = every.join(solve(used, alphas), ["season", "week", "team", "alpha"], "left")
    return rated.select("season", "week", "team", "alpha", *[F.coalesce(c, F.lit(0.0)).alias(c) for c in ("off", "def")])


RATED = "season int, week int, team int, alpha double, off double, def double"


def dense_ratings(pairs: DataFrame, alphas: tuple[float, ...]) -> DataFrame:
    """One direct solve for each cutoff."""
    def solve(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["team", "opponent", "is_home"])
        teams = np.unique(pdf[["team", "opponent"]].to_numpy())
        off, deff = (np.searchsorted(teams, pdf[c].to_numpy()) for c in ("team", "opponent"))
        out = []
        for a in alphas:
            c = solve_ratings(pdf["w"].to_numpy(float), pdf["wy"].to_numpy(float), off, deff, pdf["is_home"].to_numpy(float), len(teams), a)
            out.append(pd.DataFrame({
                "season": key[0], "week": key[1], "team": teams, "alpha": float(a), "off": c[: len(teams)], "def": c[len(teams) : 2 * len(teams)],
            }))
        return pd.concat(out)

    return pairs.groupBy("season", "week").applyInPandas(solve, RATED)


OFF, DEF, HOME = 0, 1, 2
SYSTEM, NODE = ["season", "week", "alpha"], ["kind", "id"]


def _ends(value: Column) -> Column:
    """What a pair gives to its offence, its defence and the home side."""
    node = lambda kind, id_, share: F.struct(F.lit(kind).alias("kind"), id_.cast("long").alias("id"), share.alias("v"))
    return F.array(node(OFF, F.col("team"), value), node(DEF, F.col("opponent"), value), node(HOME, F.lit(0), value * F.col("is_home")))


def sparse_ratings(pairs: DataFrame, alphas: tuple[float, ...]) -> DataFrame:
    """Conjugate gradients with diagonal scaling for the systems of all cutoffs and penalties at once.

    A round is one written table: nodes move along their directions by two numbers per system, and the pairs turn the
    scaled residuals into the next directions. Each system's three sums over its nodes are all that comes to the driver.
    """
    c = F.col
    pairs = written(pairs, "pairs")
    give = F.arrays_zip(_ends(c("w")).alias("a"), _ends(c("wy")).alias("b"))
    sums = pairs.select("season", "week", F.explode(give).alias("_e")).groupBy("season", "week", "_e.a.kind", "_e.a.id").agg(
        F.sum("_e.a.v").alias("xsum"), F.sum("_e.b.v").alias("xy")
    )
    totals = pairs.groupBy("season", "week").agg(F.sum("w").alias("total"), F.sum("wy").alias("ysum"))
    start = sums.join(totals, ["season", "week"]).withColumn("alpha", F.explode(F.array(*[F.lit(float(a)) for a in alphas])))
    right = c("xy") - c("xsum") * c("ysum") / c("total")
    # Shares are 0 or 1, so the diagonal is the node's own sum.
    scale = c("xsum") - c("xsum") * c("xsum") / c("total") + c("alpha")
    zero = F.lit(0.0)
    state = written(_pushed(pairs, start.select(
        *SYSTEM, *NODE, "xsum", "total", scale.alias("m"), zero.alias("x"), right.alias("r"), zero.alias("p"), zero.alias("s"), (right / scale).alias("u")
    )), "ratings")
    steps: dict[tuple, tuple[float, float]] = {}  # each system's last residual and step
    first: dict[tuple, float] = {}
    for _ in range(ROUNDS):
        moves, going = [], False
        for row in _node_sums(state).collect():  # one row for each cutoff and penalty
            system, rest, total = tuple(row[k] for k in SYSTEM), row["rest"], row["total"]
            first.setdefault(system, rest)
            push = row["push"] - row["level"] ** 2 / total
            before = steps.get(system)
            turn = rest / before[0] if before and before[0] else 0.0
            bend = push - (turn * rest / before[1] if before and before[1] else 0.0)
            step = rest / bend if bend > 0 and rest > TOLERANCE**2 * first[system] else 0.0
            going |= step > 0
            steps[system] = (rest, step)
            moves.append((*system, turn if step else 0.0, step, row["level"] / total))
        if not going:
            break
        by_system = state.sparkSession.createDataFrame(moves, "season int, week int, alpha double, _turn double, _step double, _level double")
        moved = state.join(by_system, SYSTEM).withColumns({"p": c("u") + c("_turn") * c("p"), "s": c("q") - c("xsum") * c("_level") + c("_turn") * c("s")})
        moved = moved.withColumns({"x": c("x") + c("_step") * c("p"), "r": c("r") - c("_step") * c("s")}).withColumn("u", c("r") / c("m"))
        state = written(_pushed(pairs, moved.select(*SYSTEM, *NODE, "xsum", "total", "m", "x", "r", "p", "s", "u")), "ratings")
    else:
        raise ArithmeticError(f"ratings have not settled after {ROUNDS} rounds")
    pick = lambda kind: F.max(F.when(c("kind") == kind, c("x")))
    rated = state.filter(c("kind") != HOME).groupBy("season", "week", c("id").cast("int").alias("team"), "alpha")
    return rated.agg(*[F.coalesce(pick(k), zero).alias(n) for k, n in ((OFF, "off"), (DEF, "def"))])


def _node_sums(state: DataFrame) -> DataFrame:
    """Per system: the scaled residual, its image and its level, each summed over the nodes."""
    c = F.col
    return state.groupBy(*SYSTEM).agg(
        F.sum(c("r") * c("u")).alias("rest"), F.sum(c("q") * c("u")).alias("push"), F.sum(c("xsum") * c("u")).alias("level"), F.first("total").alias("total")
    )


def _pushed(pairs: DataFrame, state: DataFrame) -> DataFrame:
    """state with q: what the pairs, uncentred, and the penalty make of u."""
    c = F.col
    of = lambda kind, name, id_: state.filter(c("kind") == kind).select(*SYSTEM, c("id").alias(id_), c("u").alias(name))
    met = pairs.join(of(OFF, "_off", "team"), ["season", "week", "team"]).join(of(DEF, "_def", "opponent"), [*SYSTEM, "opponent"])
    met = met.join(of(HOME, "_home", "_id").drop("_id"), SYSTEM)
    push = c("w") * (c("_off") + c("_def") + c("_home") * c("is_home"))
    got = met.select(*SYSTEM, F.explode(_ends(push)).alias("_e")).groupBy(*SYSTEM, "_e.kind", "_e.id").agg(F.sum("_e.v").alias("_q"))
    return state.join(got, [*SYSTEM, *NODE]).withColumn("q", c("_q") + c("alpha") * c("u")).drop("_q")


def unit_ratings(games: DataFrame, cuts: DataFrame, units: dict[str, tuple[str, str]], **options) -> DataFrame:
    """One pair of ratings per unit (rate, volume), weighted by volume; all units must be solvable."""
    out = None
    for unit, (rate, volume) in units.items():
        part = two_way_ratings(games, cuts, rate, volume=F.col(volume), **options).select(
            "season", "week", "team", F.col("off").alias(f"adj_off_{unit}"), F.col("def").alias(f"adj_def_{unit}_allowed")
        )
        out = part if out is None else out.join(part, ["season", "week", "team"])
    return out


def alpha_scan(games: DataFrame, cuts: DataFrame, rate: str, alphas: tuple[float, ...], **options) -> DataFrame:
    """(alpha, rmse, n_weeks): error of each penalty on the contests right after its cutoff."""
    rated = two_way_ratings(games, cuts, rate, alphas=alphas, **options)
    mean = prior_sums(games, [], "t", {"s": F.col(rate), "n": F.col(rate).isNotNull().cast("int")}).withColumnRenamed("t", "cutoff")
    level = cuts.join(mean, "cutoff").select("season", "week", (F.col("s") / F.nullif(F.col("n"), F.lit(0))).alias("level"))
    own = rated.select("season", "week", "team", "alpha", "off")
    faced = rated.select("season", "week", F.col("team").alias("opponent"), "alpha", F.col("def"))
    test = games.filter(F.col(rate).isNotNull()).join(own, ["season", "week", "team"]).join(faced, ["season", "week", "opponent", "alpha"]).join(level, ["season", "week"])
    err = F.col("off") + F.col("def") + F.col("level") - F.col(rate)
    return test.groupBy("alpha").agg(
        F.sqrt(F.avg(err * err)).alias("rmse"), F.count_distinct(F.col("season") * 100 + F.col("week")).alias("n_weeks")
    )
