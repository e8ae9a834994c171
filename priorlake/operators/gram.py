"""Ridge forecasts for every fold from one pass over the rows.

A least-squares fit needs only sums of products. Rows are folded to such sums
per stretch of the timeline (see `places`), prefix sums over the stretches give
every fold's training set and its inner time-ordered splits, and a small solve
per fold does the rest. Several arms (other features, weights or penalties) read
the same sums, so comparing arms costs no further pass.

Missing features are imputed with the training mean of the fold. Because that
mean is known only afterwards, sums are kept for x·known and for 1 - known.
"""
from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from priorlake.functions.scalars import dot
from priorlake.operators.places import SEGMENT, cut_places, segment_of, with_segments
from priorlake.operators.rules import DRIFT_ROWS

ALPHAS = tuple(10 ** (-2 + 6 * i / 24) for i in range(25))
INNER_SPLITS = 5
SIDES = ("home", "away")
HELD_NUMBERS = 16 << 20


@dataclass(frozen=True)
class Arm:
    """One regression setup.

    features   per side, or one list for both
    alphas     candidates, chosen in-fold on time-ordered splits; one value is fixed
    weight     key into `weights` ("" is unweighted)
    halflife   the weight is 2^(t/halflife) and is anchored at the fold's cutoff
    drift      rows behind the drift offset, 0 for none
    """

    features: list[str] | dict[str, list[str]]
    alphas: tuple[float, ...] = ALPHAS
    weight: str = "w"
    halflife: float | None = None
    drift: int = DRIFT_ROWS

    def columns(self, side: str) -> list[str]:
        return self.features[side] if isinstance(self.features, dict) else self.features


def used_features(arms: dict[str, Arm]) -> list[str]:
    return sorted({c for a in arms.values() for s in SIDES for c in a.columns(s)})


@dataclass(frozen=True)
class _Layout:
    names: list[str] = field(default_factory=list)
    weights: list[str] = field(default_factory=list)

    @property
    def width(self) -> int:
        return 2 * len(self.names) + 3


def _segment_products(layout: _Layout):
    """A task's rows to one partial sum of products for each segment it meets."""
    p, q = len(layout.names), layout.width
    upper = np.triu_indices(q)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict[int, np.ndarray] = {}
        for pdf in batches:
            x = pdf[layout.names].to_numpy(float)
            known = ~np.isnan(x)
            z = np.hstack([np.ones((len(pdf), 1)), np.where(known, x, 0.0), 1.0 - known, pdf[["home_score", "away_score"]].to_numpy(float)])
            weights = pdf[layout.weights].to_numpy(float)
            for seg, idx in pdf.groupby(SEGMENT).indices.items():
                zs = z[idx]
                found = np.stack([(zs.T @ zs)[upper], *[((zs * w[:, None]).T @ zs)[upper] for w in weights[idx].T]])
                held[int(seg)] = held[int(seg)] + found if seg in held else found
            # A task that meets very many stretches hands its sums on before they fill its memory.
            if len(held) * (1 + len(layout.weights)) * len(upper[0]) > HELD_NUMBERS:
                yield from out(held)
                held = {}
        yield from out(held)

    def out(held: dict[int, np.ndarray]) -> Iterator[pd.DataFrame]:
        for seg, sums in held.items():
            yield pd.DataFrame({"seg": seg, "i": upper[0], "j": upper[1], "u": sums[0], **{f"g{n}": g for n, g in enumerate(sums[1:])}})

    return run


def fold_marks(folds: DataFrame, drifts: list[int]) -> DataFrame:
    """Places each fold asks for: inner split ends (roles 0..5) and drift starts (10 + n)."""
    n = F.col("n_train")
    size = F.floor(n / (INNER_SPLITS + 1))
    places = [F.struct(F.lit(k).alias("role"), (n - (INNER_SPLITS - k) * size).cast("long").alias("place")) for k in range(INNER_SPLITS + 1)]
    places += [F.struct(F.lit(10 + i).alias("role"), F.greatest(n - d, F.lit(0)).cast("long").alias("place")) for i, d in enumerate(drifts)]
    return folds.select("season", "week", "cutoff", F.explode(F.array(*places)).alias("m")).select("season", "week", "cutoff", "m.role", "m.place")


def ridge_parameters(
    table: DataFrame, folds: DataFrame, arms: dict[str, Arm], weights: dict[str, Column] | None = None
) -> DataFrame:
    """One row per fold and arm: per side alpha, intercept and coefficients, and the training means.

    Coefficients are on the raw feature scale and laid out over the union of
    all arms' features (zero where an arm does not use one); the drift offset
    is already taken off the intercept. The solve of one fold sees a few small matrices,
    whatever the number of rows behind them.
    """
    weights = weights or {}
    names = used_features(arms)
    drifts = sorted({a.drift for a in arms.values() if a.drift})
    layout = _Layout(names, [f"_w_{k}" for k in weights])
    played = table.filter(F.col("home_score").isNotNull() & F.col("away_score").isNotNull())
    marks = fold_marks(folds, drifts)
    cuts = cut_places(marks, [])
    rows = with_segments(
        played.select(
            "t", "game_id", *[F.col(c).cast("double").alias(c) for c in names], "home_score", "away_score",
            *[c.cast("double").alias(f"_w_{k}") for k, c in weights.items()],
        ),
        [], "t", ["game_id"], cuts,
    )
    values = ["u", *[f"g{n}" for n in range(len(weights))]]
    partial = rows.mapInPandas(_segment_products(layout), "seg int, i int, j int, " + ", ".join(f"{v} double" for v in values))
    sums = partial.groupBy("seg", "i", "j").agg(*[F.sum(v).alias(v) for v in values])
    over = Window.partitionBy("i", "j").orderBy("seg").rowsBetween(Window.unboundedPreceding, 0)
    running = sums.select("seg", "i", "j", *[F.sum(v).over(over).alias(v) for v in values])
    packed = running.groupBy("seg").agg(F.array_sort(F.collect_list(F.struct("i", "j", *values))).alias("_g"))
    packed = packed.select("seg", *[F.col("_g")[v].alias(v) for v in values])
    asked = segment_of(marks, [], cuts).withColumn("seg", F.col("_upto") - 1).join(packed, "seg", "left")
    sides = ", ".join(f"{s}_alpha double, {s}_intercept double, {s}_coef array<double>" for s in SIDES)
    schema = f"season int, week int, arm string, {sides}, means array<double>"
    return asked.select("season", "week", "cutoff", "role", *values).groupBy("season", "week").applyInPandas(
        _solver(arms, layout, list(weights), drifts), schema
    )


def _square(flat, q: int) -> np.ndarray:
    out = np.zeros((q, q))
    if flat is not None:
        upper = np.triu_indices(q)
        out[upper] = np.asarray(flat, float)
        out = out + out.T - np.diag(np.diag(out))
    return out


def ridge_solve(gram: np.ndarray, alpha: float, p: int, y: int) -> tuple[float, np.ndarray]:
    """Intercept and slopes from a product matrix over [1, x_1..x_p, ..., y at index `y`]."""
    total = gram[0, 0]
    xbar, ybar = gram[0, 1 : p + 1] / total, gram[0, y] / total
    sxx = gram[1 : p + 1, 1 : p + 1] - total * np.outer(xbar, xbar)
    sxy = gram[1 : p + 1, y] - total * xbar * ybar
    beta = np.linalg.lstsq(sxx, sxy, rcond=1e-12)[0] if alpha == 0 else np.linalg.solve(sxx + alpha * np.eye(p), sxy)
    return float(ybar - xbar @ beta), beta


def _solver(arms: dict[str, Arm], layout: _Layout, weight_keys: list[str], drifts: list[int]):
    q, p_all = layout.width, len(layout.names)
    at = {c: i for i, c in enumerate(layout.names)}

    def solve_fold(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        by_role = {int(row.role): row for row in pdf.itertuples()}
        cutoff = float(pdf["cutoff"].iloc[0])
        plain = {role: _square(row.u, q) for role, row in by_role.items()}
        out = []
        for name, arm in arms.items():
            if arm.weight and arm.weight in weight_keys:
                column = f"g{weight_keys.index(arm.weight)}"
                scale = 2.0 ** (-cutoff / arm.halflife) if arm.halflife else 1.0
                weighted = {role: scale * _square(getattr(row, column), q) for role, row in by_role.items()}
            else:
                weighted = plain
            row = [*key, name]
            for y, side in enumerate(SIDES):
                idx = [at[c] for c in arm.columns(side)]
                alpha, intercept, coef = _fit_side(arm, plain, weighted, idx, p_all, y, drifts)
                spread = np.zeros(p_all)
                spread[idx] = coef
                row += [alpha, intercept, spread.tolist()]
            out.append((*row, _training_means(plain[INNER_SPLITS], list(range(p_all)), p_all).tolist()))
        names = ["season", "week", "arm", *[f"{s}_{c}" for s in SIDES for c in ("alpha", "intercept", "coef")], "means"]
        return pd.DataFrame(out, columns=names)

    return solve_fold


def _training_means(full: np.ndarray, idx: list[int], p_all: int) -> np.ndarray:
    known = full[0, 0] - full[0, [1 + p_all + i for i in idx]]
    return np.where(known > 0, full[0, [1 + i for i in idx]] / np.where(known > 0, known, 1), 0.0)


def _fit_side(arm: Arm, plain, weighted, idx, p_all: int, y: int, drifts):
    p, last = len(idx), INNER_SPLITS
    full = plain[last]
    rows = full[0, 0]
    x_cols = [1 + i for i in idx]
    gap_cols = [1 + p_all + i for i in idx]
    target = 1 + 2 * p_all + y
    means = _training_means(full, idx, p_all)
    impute = np.zeros((p + 2, full.shape[0]))
    impute[0, 0] = 1.0
    impute[p + 1, target] = 1.0
    for k in range(p):
        impute[k + 1, x_cols[k]] = 1.0
        impute[k + 1, gap_cols[k]] = means[k]
    filled = impute @ full @ impute.T
    sd = np.sqrt(np.maximum(np.diag(filled)[1 : p + 1] / rows - means**2, 0.0))
    sd = np.where(sd > 1e-12, sd, 1.0)
    scale = np.eye(p + 2)
    for k in range(p):
        scale[k + 1, k + 1] = 1.0 / sd[k]
        scale[k + 1, 0] = -means[k] / sd[k]
    shape = scale @ impute
    u = {role: shape @ g @ shape.T for role, g in plain.items()}
    w = {role: shape @ g @ shape.T for role, g in weighted.items()} if weighted is not plain else u
    alpha = arm.alphas[0]
    if len(arm.alphas) > 1:
        alpha = arm.alphas[int(np.argmax([_inner_r2(u, w, a, p) for a in arm.alphas]))]
    intercept, beta = ridge_solve(w[last], alpha, p, p + 1)
    if arm.drift:
        recent = u[last] - u[10 + drifts.index(arm.drift)]
        n = recent[0, 0]
        intercept -= (intercept * n + recent[0, 1 : p + 1] @ beta - recent[0, p + 1]) / n
    coef = beta / sd
    return float(alpha), float(intercept - coef @ means), coef


def _inner_r2(u, w, alpha: float, p: int) -> float:
    """Mean R² over the expanding inner splits."""
    scores = []
    for k in range(INNER_SPLITS):
        b0, beta = ridge_solve(w[k], alpha, p, p + 1)
        test = u[k + 1] - u[k]
        coef = np.concatenate([[b0], beta, [-1.0]])
        sse = coef @ test @ coef
        n = test[0, 0]
        sst = test[p + 1, p + 1] - test[0, p + 1] ** 2 / n
        scores.append(1.0 - sse / sst if sst > 0 else 0.0)
    return float(np.mean(scores))


def ridge_predictions(table: DataFrame, parameters: DataFrame, features: list[str], keep: list[str]) -> DataFrame:
    """Long predictions (model = arm) of every fold's rows, `keep` columns carried along."""
    values = F.array(*[F.col(c).cast("double") for c in features])
    joined = table.select(*keep, values.alias("_v")).join(parameters, ["season", "week"])
    joined = joined.withColumn("_v", F.zip_with("_v", "means", lambda x, m: F.coalesce(x, m)))
    pred = lambda s: (F.col(f"{s}_intercept") + dot(F.col("_v"), F.col(f"{s}_coef"))).alias(f"{s}_pred")
    return joined.select(F.col("arm").alias("model"), *keep, *[pred(s) for s in SIDES])


def walk_forward_ridge(table: DataFrame, folds: DataFrame, arms: dict[str, Arm], keep: list[str], weights: dict[str, Column] | None = None) -> DataFrame:
    return ridge_predictions(table, ridge_parameters(table, folds, arms, weights), used_features(arms), keep)
