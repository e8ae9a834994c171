"""Poisson and logistic fits of all folds at once against Newton fits of single folds on their own rows."""
import numpy as np
import pytest
from pyspark.sql import functions as F
from test_models import contests

from priorlake.operators import folds, glm
from priorlake.operators.gram import Arm
from priorlake.operators.rules import sample_weight

KEEP = ["game_id", "season", "week", "t"]
ARMS = {"both": Arm(["a", "b"], drift=50), "one": Arm(["b"], weight="", drift=0), "sided": Arm({"home": ["a"], "away": ["a", "b"]}, drift=30)}
def weights():
    return {"w": sample_weight(F.col("went_to_ot"))}



def prepared(train, test, columns):
    x = train[columns].to_numpy(float)
    means = np.nanmean(x, axis=0)
    fill = lambda f: np.where(np.isnan(f), means, f)
    mu, sd = fill(x).mean(0), fill(x).std(0)
    return [np.hstack([np.ones((len(f), 1)), (fill(f[columns].to_numpy(float)) - mu) / sd]) for f in (train, test)]


def newton(x, y, w, mean, loss_scale, alpha=1.0):
    """Plain Newton of sum(w · loss) · loss_scale + alpha/2 |b|² from zero, for a canonical link."""
    beta, pen = np.zeros(x.shape[1]), alpha * np.eye(x.shape[1])
    pen[0, 0] = 0
    beta[0] = np.log(np.average(y, weights=w)) if mean is np.exp else 0.0
    for _ in range(60):
        mu = mean(x @ beta)
        curve = mu if mean is np.exp else mu * (1 - mu)
        beta = beta - np.linalg.solve(loss_scale * (x * (w * curve)[:, None]).T @ x + pen, loss_scale * x.T @ (w * (mu - y)) + pen @ beta)
    return beta


def poisson_reference(train, test, arm):
    w = np.where(train.went_to_ot == 1, 0.5, 1.0) if arm.weight else np.ones(len(train))
    out = []
    for side in ("home", "away"):
        x, z = prepared(train, test, arm.columns(side))
        y = train[f"{side}_score"].to_numpy(float)
        beta = newton(x, y, w, np.exp, 1 / w.sum())
        offset = (np.exp(x[-arm.drift :] @ beta) - y[-arm.drift :]).mean() if arm.drift else 0.0
        out.append(np.exp(z @ beta) - offset)
    return out


def logistic_reference(train, test, arm):
    w = np.where(train.went_to_ot == 1, 0.5, 1.0) if arm.weight else np.ones(len(train))
    x, z = prepared(train, test, arm.columns("home"))
    home, away = train.home_score.to_numpy(float), train.away_score.to_numpy(float)
    won, sigmoid = home > away, lambda e: 1 / (1 + np.exp(-e))
    beta = newton(x, won.astype(float), w, sigmoid, 1.0)
    win, loss = np.average((home - away)[won], weights=w[won]), np.average((home - away)[~won], weights=w[~won])
    total = np.average(home + away, weights=w)

    def pair(m):
        margin = sigmoid(m @ beta) * win + (1 - sigmoid(m @ beta)) * loss
        return (total + margin) / 2, (total - margin) / 2

    recent = [(p - y)[-arm.drift :].mean() if arm.drift else 0.0 for p, y in zip(pair(x), (home, away))]
    return [p - r for p, r in zip(pair(z), recent)]


@pytest.mark.parametrize("family, reference", [(glm.Poisson, poisson_reference), (glm.Logistic, logistic_reference)])
def test_every_fold_equals_its_own_newton_fit(spark, family, reference):
    df = contests(spark)
    out = glm.walk_forward_glm(df, folds.fold_table(df, burn_in=1), ARMS, KEEP, weights(), family).toPandas()
    rows = df.toPandas().sort_values(["t", "game_id"]).reset_index(drop=True)
    assert len(out) == 3 * 20 * 9
    for name, arm in ARMS.items():
        got = out[out.model == name].set_index("game_id")
        for season, week in {(s, w) for s, w in zip(rows.season, rows.week) if s > 2000}:
            test = rows[(rows.season == season) & (rows.week == week)]
            home, away = reference(rows[rows.t < test.t.min()], test, arm)
            np.testing.assert_allclose(got.loc[test.game_id, "home_pred"], home, rtol=1e-7)
            np.testing.assert_allclose(got.loc[test.game_id, "away_pred"], away, rtol=1e-7)


def test_future_rows_and_partitions_change_nothing(spark):
    df = contests(spark)
    table = folds.fold_table(df, burn_in=1)
    fit = lambda frame: glm.walk_forward_glm(frame, table, {"both": ARMS["both"]}, KEEP, weights()).filter("t <= 100").orderBy("game_id").toPandas()
    before = fit(df)
    changed = df.withColumn("home_score", F.when(F.col("t") > 100, 500.0).otherwise(F.col("home_score"))).repartition(7)
    np.testing.assert_allclose(before["home_pred"], fit(changed)["home_pred"], rtol=1e-9)


def test_small_chunks_give_the_same_fit(spark, monkeypatch):
    df = contests(spark, 12, 8)
    table = folds.fold_table(df, burn_in=1)
    whole = glm.glm_parameters(df, table, ARMS, weights()).orderBy("season", "week", "arm", "target").toPandas()
    monkeypatch.setattr(glm, "CHUNK_VALUES", 1)
    parts = glm.glm_parameters(df, table, ARMS, weights()).orderBy("season", "week", "arm", "target").toPandas()
    np.testing.assert_allclose(np.stack(whole["coef"]), np.stack(parts["coef"]), atol=1e-9)


def test_unplayed_contests_get_forecasts_and_no_folds_give_none(spark):
    df = contests(spark, 12, 8)
    table = folds.fold_table(df, burn_in=1)
    open_ = df.withColumn("home_score", F.when(F.col("t") == 77, None).otherwise(F.col("home_score")))
    out = glm.walk_forward_glm(open_, table, {"both": ARMS["both"]}, KEEP, weights())
    assert out.filter("t = 77 and home_pred is not null and away_pred is not null").count() == 8
    assert glm.walk_forward_glm(df, table.limit(0), {"both": ARMS["both"]}, KEEP, weights()).count() == 0


def test_a_step_that_raises_the_objective_is_halved():
    p = glm.Problem(0, "m", 0, 2000, (0,), -1, 0, beta=np.array([4.0, 2.0]), base=np.array([0.0, 0.0]), base_value=1.0)
    half = glm.newton_step(p, np.eye(2), 50.0, np.zeros(2), np.eye(2), 1.0, 0.0)
    assert half.beta.tolist() == [2.0, 1.0] and half.base_value == 1.0 and not half.done
