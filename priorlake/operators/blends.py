"""Combining member forecasts with weights learnt from earlier results only."""
from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from priorlake.operators.folds import training_sums
from priorlake.operators.places import sums_before_places

WEIGHT_GRID = tuple(round(0.05 * i, 2) for i in range(21))
TAIL_SHARE = 0.25
MIN_TAIL = 40
FALLBACK_WEIGHT = 0.25


def member_table(predictions: DataFrame, members: list[str]) -> DataFrame:
    """One row per contest that all members predicted: `<member>_home`, `<member>_away` and the result."""
    keys = ["game_id", "season", "week", "t"]
    value = lambda m, s: F.max(F.when(F.col("model") == m, F.col(f"{s}_pred"))).alias(f"{m}_{s}")
    wide = predictions.filter(F.col("model").isin(*members)).groupBy(*keys).agg(
        F.max("home_score").alias("home_score"), F.max("away_score").alias("away_score"),
        *[value(m, s) for m in members for s in ("home", "away")],
    )
    return wide.dropna(subset=[f"{m}_{s}" for m in members for s in ("home", "away")])


def tail_blend(wide: DataFrame, folds: DataFrame, first: str, second: str) -> DataFrame:
    """Forecast (1-w)·first + w·second; w has the least error on the last quarter of earlier rows.

    The error is quadratic in w, so three sums over the tail rate the whole grid.
    """
    c = F.col
    before = training_sums(wide, folds.select("season", "week", "cutoff"), {"n": F.lit(1)}).filter("n > 0")
    marks = before.select("season", "week", "n", F.explode(F.array(
        F.struct(F.lit(1).alias("sign"), c("n").alias("place")), F.struct(F.lit(-1).alias("sign"), F.floor(c("n") * (1 - TAIL_SHARE)).cast("long").alias("place")),
    )).alias("m")).select("season", "week", "n", "m.sign", "m.place")
    e = lambda s: c(f"{first}_{s}") - c(f"{s}_score")
    d = lambda s: c(f"{second}_{s}") - c(f"{first}_{s}")
    both = lambda f: f("home") + f("away")
    sums = {"a": both(lambda s: e(s) * e(s)), "b": both(lambda s: e(s) * d(s)), "q": both(lambda s: d(s) * d(s)), "rows": F.lit(1.0)}
    at = sums_before_places(wide, [], "t", ["game_id"], marks, sums)
    tail = at.groupBy("season", "week").agg(*[F.sum(c("sign") * c(n)).alias(n) for n in sums])
    errors = F.array(*[F.struct(F.round(c("a") + 2 * w * c("b") + w * w * c("q"), 6).alias("e"), F.lit(w).alias("w")) for w in WEIGHT_GRID])
    chosen = tail.select("season", "week", F.when(c("rows") < MIN_TAIL, F.lit(FALLBACK_WEIGHT)).otherwise(F.array_min(errors)["w"]).alias("w"))
    mixed = lambda s: ((1 - c("w")) * c(f"{first}_{s}") + c("w") * c(f"{second}_{s}")).alias(f"{s}_pred")
    return wide.join(chosen, ["season", "week"]).select("game_id", "season", "week", "t", "home_score", "away_score", "w", mixed("home"), mixed("away"))


def nonnegative_least_squares(gram: np.ndarray, xy: np.ndarray) -> np.ndarray:
    """The non-negative minimiser of b'Gb - 2 b'xy: members enter where the slope asks for them and leave where they would turn negative."""
    k = len(xy)
    free, beta = np.zeros(k, bool), np.zeros(k)
    small = 1e-10 * max(1e-300, np.abs(xy).max(initial=0.0))
    for _ in range(10 * k + 10):
        slope = xy - gram @ beta
        wanted = np.flatnonzero(~free & (slope > small))
        if not len(wanted):
            break
        free[wanted[np.argmax(slope[wanted])]] = True
        while free.any():
            idx = np.flatnonzero(free)
            full = np.zeros(k)
            full[idx] = np.linalg.lstsq(gram[np.ix_(idx, idx)], xy[idx], rcond=1e-12)[0]
            low = idx[full[idx] <= 0]
            if not len(low):
                beta = full
                break
            share = beta[low] / np.maximum(beta[low] - full[low], 1e-300)
            beta = beta + share.min() * (full - beta)
            free[low[share <= share.min()]] = False
            beta[~free] = 0.0
    return beta


def fold_weights(wide: DataFrame, folds: DataFrame, members: list[str]) -> DataFrame:
    """(season, week, side, scheme, weights): four ways to weigh members on earlier results.

    Prefix sums of squares and products per day feed one small solve per fold.
    """
    c = F.col
    sums = {"n": F.lit(1.0)}
    for s in ("home", "away"):
        for i, a in enumerate(members):
            sums[f"{s}_xy_{i}"] = c(f"{a}_{s}") * c(f"{s}_score")
            sums[f"{s}_se_{i}"] = (c(f"{a}_{s}") - c(f"{s}_score")) * (c(f"{a}_{s}") - c(f"{s}_score"))
            for j, b in enumerate(members):
                if j >= i:
                    sums[f"{s}_xx_{i}_{j}"] = c(f"{a}_{s}") * c(f"{b}_{s}")
    stats = training_sums(wide, folds.select("season", "week", "cutoff"), sums).filter("n > 0")
    k = len(members)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for row in pdf.to_dict("records"):
                for s in ("home", "away"):
                    mse = np.array([row[f"{s}_se_{i}"] for i in range(k)]) / row["n"]
                    gram = np.array([[row[f"{s}_xx_{min(i, j)}_{max(i, j)}"] for j in range(k)] for i in range(k)])
                    coef = nonnegative_least_squares(gram, np.array([row[f"{s}_xy_{i}"] for i in range(k)]))
                    inverse = 1 / mse
                    schemes = {
                        "equal": np.full(k, 1 / k), "inv_mse": inverse / inverse.sum(),
                        "nnls": coef / coef.sum() if coef.sum() > 0 else np.full(k, 1 / k), "best_single": np.eye(k)[int(np.argmin(mse))],
                    }
                    out += [(row["season"], row["week"], s, n, w.tolist()) for n, w in schemes.items()]
            yield pd.DataFrame(out, columns=["season", "week", "side", "scheme", "weights"])

    return stats.mapInPandas(run, "season int, week int, side string, scheme string, weights array<double>")


def weighted_members(wide: DataFrame, weights: DataFrame, members: list[str]) -> DataFrame:
    """Long predictions (model = scheme) from per-fold weights."""
    per = weights.groupBy("season", "week", F.col("scheme").alias("model")).agg(
        *[F.max(F.when(F.col("side") == s, F.col("weights"))).alias(f"_{s}") for s in ("home", "away")]
    )
    mix = lambda s: sum((F.col(f"_{s}")[i] * F.col(f"{m}_{s}") for i, m in enumerate(members)), F.lit(0.0)).alias(f"{s}_pred")
    return wide.join(per, ["season", "week"]).select("model", "game_id", "season", "week", "t", "home_score", "away_score", mix("home"), mix("away"))


def pooled_effects(predictions: DataFrame, t: str, k: float) -> DataFrame:
    """Predictions plus each side's shrunk mean of its earlier residuals.

    The residual mean of an entity (at that venue) is pulled toward zero by k
    contests, a partial pooling of entity intercepts.
    """
    from priorlake.operators.prefix import prior_sums
    from priorlake.operators.temporal import shrink

    out = predictions
    for side in ("home", "away"):
        residual = F.col(f"{side}_score") - F.col(f"{side}_pred")
        keys = ["model", f"{side}_team"]
        past = prior_sums(predictions, keys, t, {"_s": residual, "_n": F.lit(1)})
        effect = shrink(F.try_divide(F.col("_s"), F.col("_n").cast("double")), F.col("_n"), F.lit(0.0), k)
        out = out.join(past.select(*keys, t, effect.alias(f"{side}_effect")), [*keys, t])
    return out.withColumns({f"{s}_pred": F.col(f"{s}_pred") + F.col(f"{s}_effect") for s in ("home", "away")})
