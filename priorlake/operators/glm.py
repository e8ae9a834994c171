"""Poisson and logistic forecasts for every fold at once: Newton rounds over distributed sums.

Each round is one pass over the rows for all folds, arms and targets together. A task turns its rows into a matrix
Z = [1, x·known, missing] and multiplies it with the coefficients of all problems; a row counts for a problem if its
place lies before the fold's cutoff. What leaves a task is one gradient and one curvature matrix for each problem,
row by row, so their sums combine in the shuffle, and each problem's small system is solved in a task. The driver
holds coefficients only: one short vector for each fold, arm and target.

Imputation means and scales are the fold's own, yet rows are never scaled: sums in Z are turned into sums of imputed
and standardised features by one small matrix per fold, as in `gram`. The folds that end each season are solved first
from an intercept; all others start from the nearest of those and need few rounds.
"""
from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from priorlake.functions.scalars import dot
from priorlake.operators.folds import pin
from priorlake.operators.gram import SIDES, Arm, used_features
from priorlake.operators.prefix import position

ROUNDS, DECREMENT = 60, 1e-12
CHUNK_VALUES = 4 << 20  # numbers in a task's largest matrix


class Poisson:
    """Counts with a log link; the objective is the weighted mean of half deviances plus alpha/2 |b|²."""

    targets = SIDES
    mean_loss = True

    @staticmethod
    def start(mean: float) -> float:
        return float(np.log(max(mean, 1e-9)))

    @staticmethod
    def terms(eta: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Loss, its slope and its curvature in eta."""
        mu = np.exp(np.minimum(eta, 700.0))
        return mu - y * eta, mu - y, mu

    @staticmethod
    def mean(eta: np.ndarray) -> np.ndarray:
        return np.exp(np.minimum(eta, 700.0))


class Logistic:
    """Whether the home side wins; the objective is the weighted sum of log losses plus alpha/2 |b|²."""

    targets = ("win",)
    mean_loss = False

    @staticmethod
    def start(mean: float) -> float:
        mean = min(max(mean, 1e-9), 1 - 1e-9)
        return float(np.log(mean / (1 - mean)))

    @staticmethod
    def terms(eta: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        p = Logistic.mean(eta)
        return np.logaddexp(0.0, eta) - y * eta, p - y, p * (1 - p)

    @staticmethod
    def mean(eta: np.ndarray) -> np.ndarray:
        return 0.5 * (1.0 + np.tanh(0.5 * eta))


@dataclass(frozen=True)
class Problem:
    """One fit: a fold, an arm and a target."""

    fold: int
    arm: str
    target: int
    season: int
    columns: tuple[int, ...]
    weight: int  # column of weights, -1 for none
    drift: int
    beta: np.ndarray | None = None  # standardised, intercept first
    base: np.ndarray | None = None
    base_value: float = np.inf
    done: bool = False


def numbered_rows(table: DataFrame, names: list[str], weights: dict[str, Column]) -> DataFrame:
    """Played rows with their place in time, features as one array, both scores and the weights."""
    played = table.filter(F.col("home_score").isNotNull() & F.col("away_score").isNotNull())
    rows = played.select(
        "t", "game_id", F.array(*[F.coalesce(F.col(c).cast("double"), F.lit(float("nan"))) for c in names]).alias("x"),
        F.col("home_score").cast("double").alias("home"), F.col("away_score").cast("double").alias("away"),
        F.array(*[c.cast("double") for c in weights.values()]).alias("w") if weights else F.expr("cast(array() as array<double>)").alias("w"),
    )
    return position(rows, [], "t", ["game_id"], "place").select("place", "x", "home", "away", "w")


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    values = column.flatten().to_numpy(zero_copy_only=False).astype(float)
    return values.reshape(-1, width) if width else np.zeros((len(column), 0))


def _chunks(batches: Iterator[pa.RecordBatch], n_features: int, n_weights: int, rows: int):
    """(Z, home, away, weights, place) for stretches of at most `rows` rows; Z has a column of ones, known values and gaps."""
    for batch in batches:
        for start in range(0, batch.num_rows, rows):
            part = batch.slice(start, rows)
            x = _matrix(part["x"], n_features)
            known = ~np.isnan(x)
            z = np.hstack([np.ones((len(x), 1)), np.where(known, x, 0.0), 1.0 - known])
            w = np.hstack([_matrix(part["w"], n_weights), np.ones((len(x), 1))])
            yield z, part["home"].to_numpy(), part["away"].to_numpy(), w, part["place"].to_numpy()


def _rows_for(width: int) -> int:
    return max(16, CHUNK_VALUES // max(1, width))


@dataclass(frozen=True)
class Moments:
    """Per fold: training rows, feature means and deviations, and weighted sums of outcomes per weight column."""

    n: np.ndarray
    mean: np.ndarray
    sd: np.ndarray
    total: np.ndarray  # fold, weight column, (w, w·home, w·away, w·won, w·margin of wins, w·margin of others)


def fold_moments(rows: DataFrame, ends: np.ndarray, n_features: int, n_weights: int) -> Moments:
    """One pass: sums over the rows before each fold's end."""
    width = 1 + 3 * n_features + 6 * (n_weights + 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pd.DataFrame]:
        total = np.zeros((len(ends), width))
        for z, home, away, w, place in _chunks(batches, n_features, n_weights, _rows_for(width + len(ends))):
            won = home > away
            outcome = np.stack([np.ones(len(z)), home, away, won, np.where(won, home - away, 0.0), np.where(won, 0.0, home - away)], axis=1)
            x = z[:, 1 : 1 + n_features]
            parts = [z, x * x, (w[:, :, None] * outcome[:, None, :]).reshape(len(z), -1)]
            total += (place[None, :] < ends[:, None]).astype(float) @ np.hstack(parts)
        yield pa.RecordBatch.from_pandas(pd.DataFrame({"fold": np.arange(len(ends)), **{f"v{k}": total[:, k] for k in range(width)}}), preserve_index=False)

    names = [f"v{k}" for k in range(width)]
    sums = rows.mapInArrow(run, "fold long, " + ", ".join(f"{v} double" for v in names)).groupBy("fold").agg(*[F.sum(v).alias(v) for v in names])
    out = np.zeros((len(ends), width))
    for r in sums.collect():  # one row for each fold
        out[r["fold"]] = [r[v] for v in names]
    p = n_features
    n, s, gaps, ss = out[:, 0], out[:, 1 : 1 + p], out[:, 1 + p : 1 + 2 * p], out[:, 1 + 2 * p : 1 + 3 * p]
    known = n[:, None] - gaps
    mean = np.where(known > 0, s / np.where(known > 0, known, 1), 0.0)
    var = (ss - 2 * mean * s + mean**2 * known) / np.maximum(n, 1)[:, None]
    sd = np.sqrt(np.maximum(var, 0.0))
    return Moments(n, mean, np.where(sd > 1e-12, sd, 1.0), out[:, 1 + 3 * p :].reshape(len(ends), n_weights + 1, 6))


def shape_of(problem: Problem, moments: Moments, n_features: int) -> np.ndarray:
    """Matrix that turns a row of Z into [1, imputed and standardised features of the problem]."""
    out = np.zeros((1 + len(problem.columns), 1 + 2 * n_features))
    out[0, 0] = 1.0
    for k, c in enumerate(problem.columns):
        m, s = moments.mean[problem.fold, c], moments.sd[problem.fold, c]
        out[k + 1, 1 + c], out[k + 1, 1 + n_features + c], out[k + 1, 0] = 1 / s, m / s, -m / s
    return out


def _targets(family, home: np.ndarray, away: np.ndarray) -> np.ndarray:
    return np.stack([home, away], axis=1) if len(family.targets) == 2 else (home > away).astype(float)[:, None]


def round_sums(rows: DataFrame, problems: list[Problem], shapes: list[np.ndarray], ends: np.ndarray, n_weights: int, family) -> DataFrame:
    """(problem, i, h0.., g): row i of a problem's curvature and entry i of its gradient in Z; i = -1 holds the loss."""
    q = shapes[0].shape[1]
    p = (q - 1) // 2
    upper = np.triu_indices(q)
    coef = np.stack([p_.beta @ s for p_, s in zip(problems, shapes)], axis=1)
    limit = np.array([ends[p_.fold] for p_ in problems])
    weight, target = np.array([p_.weight for p_ in problems]), np.array([p_.target for p_ in problems])
    names = [f"h{k}" for k in range(q)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        h, g, loss = np.zeros((len(upper[0]), len(limit))), np.zeros((q, len(limit))), np.zeros(len(limit))
        for z, home, away, w, place in _chunks(batches, p, n_weights, _rows_for(len(upper[0]) + 4 * len(limit))):
            active = place[:, None] < limit[None, :]
            value, slope, curve = family.terms(z @ coef, _targets(family, home, away)[:, target])
            use = np.where(active, w[:, weight], 0.0)
            loss += (use * value).sum(axis=0)
            g += z.T @ (use * slope)
            h += (z[:, upper[0]] * z[:, upper[1]]).T @ (use * curve)
        full = np.zeros((len(limit), q, q))
        full[:, upper[0], upper[1]] = h.T
        full[:, upper[1], upper[0]] = h.T
        of = np.repeat(np.arange(len(limit)), q)
        yield pa.RecordBatch.from_arrays(
            [pa.array(of), pa.array(np.tile(np.arange(q), len(limit))), *[pa.array(full[:, :, k].reshape(-1)) for k in range(q)], pa.array(g.T.reshape(-1))],
            ["problem", "i", *names, "g"],
        )
        none = pa.array(np.zeros(len(limit)))
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(limit))), pa.array(np.full(len(limit), -1)), *[none] * q, pa.array(loss)], ["problem", "i", *names, "g"])

    sums = rows.mapInArrow(run, "problem long, i long, " + ", ".join(f"{n} double" for n in [*names, "g"]))
    return sums.groupBy("problem", "i").agg(*[F.sum(n).alias(n) for n in [*names, "g"]])


def newton_step(problem: Problem, shape: np.ndarray, loss: float, gradient: np.ndarray, curvature: np.ndarray, scale: float, alpha: float) -> Problem:
    """The problem after one round: a Newton step, or half the last one where the objective has risen."""
    penalty = alpha * np.ones(len(problem.beta))
    penalty[0] = 0.0
    value = scale * loss + 0.5 * (penalty * problem.beta**2).sum()
    if value > problem.base_value + 1e-10 * abs(problem.base_value) and problem.base is not None:
        middle = (problem.beta + problem.base) / 2
        return replace(problem, beta=middle, done=bool(np.abs(middle - problem.base).max() < 1e-14))
    slope = scale * shape @ gradient + penalty * problem.beta
    step = np.linalg.lstsq(scale * shape @ curvature @ shape.T + np.diag(penalty), slope, rcond=1e-14)[0]
    small = float(slope @ step) <= DECREMENT * max(1.0, abs(value))
    return replace(problem, base=problem.beta, base_value=value, beta=problem.beta - step, done=small)


def _solver(problems: list[Problem], shapes: list[np.ndarray], scales: list[float], alpha: float):
    """One problem's summed rows to its next coefficients."""
    def solve(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        k = int(key[0])
        sums = pdf.sort_values("i").drop(columns=["problem", "i"]).to_numpy(float)
        p = newton_step(problems[k], shapes[k], sums[0, -1], sums[1:, -1], sums[1:, :-1], scales[k], alpha)
        return pd.DataFrame({"problem": [k], "beta": [p.beta.tolist()], "base": [None if p.base is None else p.base.tolist()], "value": [p.base_value], "done": [p.done]})

    return solve


def solve_rounds(rows: DataFrame, problems: list[Problem], moments: Moments, ends: np.ndarray, n_features: int, n_weights: int, family, alpha: float) -> list[Problem]:
    """Newton rounds for all problems until each one's decrement vanishes; a round passes over the rows once for those still open."""
    for _ in range(ROUNDS):
        todo = [k for k, p in enumerate(problems) if not p.done]
        if not todo:
            break
        mine = [problems[k] for k in todo]
        shapes = [shape_of(p, moments, n_features) for p in mine]
        scales = [1 / moments.total[p.fold, p.weight, 0] if family.mean_loss else 1.0 for p in mine]

        sums = round_sums(rows, mine, shapes, ends, n_weights, family)
        for r in sums.groupBy("problem").applyInPandas(_solver(mine, shapes, scales, alpha), "problem long, beta array<double>, base array<double>, value double, done boolean").collect():
            problems[todo[r["problem"]]] = replace(
                mine[r["problem"]], beta=np.array(r["beta"]), base=None if r["base"] is None else np.array(r["base"]), base_value=r["value"], done=r["done"]
            )
    open_ = sum(not p.done for p in problems)
    if open_:
        raise ArithmeticError(f"{open_} fits have not settled after {ROUNDS} rounds")
    return problems


def _nearest(problem: Problem, solved: list[Problem]) -> np.ndarray:
    return min((s for s in solved if (s.arm, s.target) == (problem.arm, problem.target)), key=lambda s: abs(s.fold - problem.fold)).beta


def drift_sums(rows: DataFrame, problems: list[Problem], moments: Moments, ends: np.ndarray, n_features: int, n_weights: int, family) -> np.ndarray:
    """(problem, side): mean error over the last `drift` training rows of each problem's fold; one pass."""
    shapes = [shape_of(p, moments, n_features) for p in problems]
    coef = np.stack([p.beta @ s for p, s in zip(problems, shapes)], axis=1)
    end = np.array([ends[p.fold] for p in problems])
    start = np.maximum(end - np.array([p.drift for p in problems]), 0)
    spread = np.array([outcome_levels(p, moments) for p in problems])
    target = np.array([p.target for p in problems])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((3, len(problems)))
        for z, home, away, _, place in _chunks(batches, n_features, n_weights, _rows_for(4 * len(problems))):
            recent = (place[:, None] >= start) & (place[:, None] < end)
            mu = family.mean(z @ coef)
            if len(family.targets) == 2:
                total[0] += (recent * (mu - np.stack([home, away], axis=1)[:, target])).sum(axis=0)
            else:
                margin = mu * spread[:, 0] + (1 - mu) * spread[:, 1]
                total[0] += (recent * ((spread[:, 2] + margin) / 2 - home[:, None])).sum(axis=0)
                total[1] += (recent * ((spread[:, 2] - margin) / 2 - away[:, None])).sum(axis=0)
            total[2] += recent.sum(axis=0)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(problems))), *[pa.array(t) for t in total]], ["problem", "home", "away", "n"])

    sums = rows.mapInArrow(run, "problem long, home double, away double, n double").groupBy("problem").agg(*[F.sum(c).alias(c) for c in ("home", "away", "n")])
    out = np.zeros((len(problems), 2))
    for r in sums.collect():  # one row for each fold, arm and target
        if r["n"]:
            out[r["problem"]] = [r["home"] / r["n"], r["away"] / r["n"]]
    return out


def outcome_levels(problem: Problem, moments: Moments) -> tuple[float, float, float]:
    """Weighted mean margin of home wins, of the other contests, and mean total of a fold's training rows."""
    w, home, away, won, margin_won, margin_lost = moments.total[problem.fold, problem.weight]
    return (margin_won / won if won else 0.0, margin_lost / (w - won) if w > won else 0.0, (home + away) / w if w else 0.0)


PARAMETERS = "season int, week int, arm string, target string, intercept double, coef array<double>, means array<double>, levels array<double>, home_offset double, away_offset double"


def glm_parameters(table: DataFrame, folds: DataFrame, arms: dict[str, Arm], weights: dict[str, Column] | None = None, family=Poisson, alpha: float = 1.0) -> DataFrame:
    """One row per fold, arm and target: intercept and coefficients on the raw features of all arms, imputation means, drift offsets.

    Each arm's features, weight and drift rows count; its penalties do not, `alpha` is the penalty of all.
    """
    weights = dict(weights or {})
    names = used_features(arms)
    at = {c: k for k, c in enumerate(names)}
    plan = folds.select("season", "week", "cutoff", "n_train").orderBy("cutoff", "season", "week").collect()  # one row for each fold
    spark = table.sparkSession
    if not plan:
        return spark.createDataFrame([], PARAMETERS)
    rows = pin(numbered_rows(table, names, weights))
    ends = np.array([f["n_train"] for f in plan])
    moments = fold_moments(rows, ends, len(names), len(weights))
    keys = list(weights)
    problems = []
    for fold, f in enumerate(plan):
        for name, arm in arms.items():
            weight = keys.index(arm.weight) if arm.weight in keys else len(keys)
            for target, side in enumerate(family.targets):
                columns = tuple(at[c] for c in arm.columns(side if side in SIDES else "home"))
                w, home, away, won, *_ = moments.total[fold, weight]
                mean = (home, away)[target] / w if len(family.targets) == 2 else won / w
                beta = np.zeros(1 + len(columns))
                beta[0] = family.start(mean)
                problems.append(Problem(fold, name, target, f["season"], columns, weight, arm.drift, beta))
    last = {p.season: p.fold for p in problems}
    ends_season = [k for k, p in enumerate(problems) if last[p.season] == p.fold]
    solve = lambda some: solve_rounds(rows, some, moments, ends, len(names), len(weights), family, alpha)
    solved = solve([problems[k] for k in ends_season])
    rest = [k for k in range(len(problems)) if k not in set(ends_season)]
    warm = solve([replace(problems[k], beta=_nearest(problems[k], solved)) for k in rest])
    done = dict(zip(ends_season, solved)) | dict(zip(rest, warm))
    fitted = [done[k] for k in range(len(problems))]
    offsets = drift_sums(rows, fitted, moments, ends, len(names), len(weights), family)
    rows.unpersist()
    out = []
    for p, offset in zip(fitted, offsets):
        mean, sd = moments.mean[p.fold], moments.sd[p.fold]
        coef = np.zeros(len(names))
        coef[list(p.columns)] = p.beta[1:] / sd[list(p.columns)]
        home, away = offset if len(family.targets) == 1 else (offset[0], offset[0])
        f = plan[p.fold]
        levels = [float(v) for v in outcome_levels(p, moments)]
        out.append((f["season"], f["week"], p.arm, family.targets[p.target], float(p.beta[0] - coef @ mean), coef.tolist(), mean.tolist(), levels, float(home), float(away)))
    return spark.createDataFrame(out, PARAMETERS)


def glm_predictions(table: DataFrame, parameters: DataFrame, features: list[str], keep: list[str], family=Poisson) -> DataFrame:
    """Long predictions (model = arm) of every fold's rows; `features` in the order of the parameters (`used_features`)."""
    values = F.array(*[F.col(c).cast("double") for c in features])
    joined = table.select(*keep, values.alias("_v")).join(parameters, ["season", "week"])
    eta = F.col("intercept") + dot(F.zip_with("_v", "means", lambda x, m: F.coalesce(x, m)), F.col("coef"))
    if len(family.targets) == 1:
        p, level = 1 / (1 + F.exp(-eta)), F.col("levels")
        scored = joined.withColumn("_m", p * level[0] + (1 - p) * level[1])
        return scored.select(
            F.col("arm").alias("model"), *keep,
            ((F.col("levels")[2] + F.col("_m")) / 2 - F.col("home_offset")).alias("home_pred"), ((F.col("levels")[2] - F.col("_m")) / 2 - F.col("away_offset")).alias("away_pred"),
        )
    scored = joined.select("arm", *keep, "target", (F.exp(eta) - F.col("home_offset")).alias("_p"))
    pick = lambda side: F.max(F.when(F.col("target") == side, F.col("_p"))).alias(f"{side}_pred")
    return scored.groupBy(F.col("arm").alias("model"), *keep).agg(*[pick(s) for s in SIDES])


def walk_forward_glm(table: DataFrame, folds: DataFrame, arms: dict[str, Arm], keep: list[str], weights: dict[str, Column] | None = None, family=Poisson, alpha: float = 1.0) -> DataFrame:
    return glm_predictions(table, glm_parameters(table, folds, arms, weights, family, alpha), used_features(arms), keep, family)
