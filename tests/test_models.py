"""Closed forms: ridge with in-fold penalty, ratings, chain, blends, quantiles, bootstrap."""
import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from priorlake.operators import blends, bootstrap, chain, folds, gram, quantiles, ratings


def contests(spark, n_days=30, per_day=9, seed=0):
    rng = np.random.default_rng(seed)
    rows = []
    for d in range(n_days):
        for g in range(per_day):
            x = rng.normal(size=2)
            rows.append((
                f"{d:03d}_{g}", 2000 + d // 10, d % 10 + 1, d * 7, float(x[0]), None if rng.random() < 0.1 else float(x[1]),
                float(20 + 3 * x[0] + rng.normal()), float(18 - 2 * x[0] + x[1] + rng.normal()), int(rng.random() < 0.2),
            ))
    schema = "game_id string, season int, week int, t int, a double, b double, home_score double, away_score double, went_to_ot int"
    return spark.createDataFrame(rows, schema)


def reference_ridge(train, test, alphas, drift):
    """Refits on rows: impute, standardise, choose alpha on expanding splits, take off the drift."""
    x = train[["a", "b"]].to_numpy(float)
    means = np.nanmean(x, axis=0)
    fill = lambda f: np.where(np.isnan(f), means, f)
    x = fill(x)
    mu, sd = x.mean(0), x.std(0)
    z, w = (x - mu) / sd, np.where(train["went_to_ot"] == 1, 0.5, 1.0)
    preds = []
    for side in ("home", "away"):
        y = train[f"{side}_score"].to_numpy(float)

        def fit(rows, alpha):
            zz, yy, ww = z[rows], y[rows], w[rows]
            zb, yb = np.average(zz, axis=0, weights=ww), np.average(yy, weights=ww)
            beta = np.linalg.solve((zz - zb).T @ ((zz - zb) * ww[:, None]) + alpha * np.eye(2), (zz - zb).T @ ((yy - yb) * ww))
            return yb - zb @ beta, beta

        n = len(y)
        size = n // 6
        scores = []
        for alpha in alphas:
            r2 = []
            for k in range(5):
                end = n - (5 - k) * size
                b0, beta = fit(np.arange(end), alpha)
                yt = y[end : end + size]
                r2.append(1 - ((yt - b0 - z[end : end + size] @ beta) ** 2).sum() / ((yt - yt.mean()) ** 2).sum())
            scores.append(np.mean(r2))
        b0, beta = fit(np.arange(n), alphas[int(np.argmax(scores))])
        offset = (b0 + z[-drift:] @ beta - y[-drift:]).mean()
        preds.append(b0 + ((fill(test[["a", "b"]].to_numpy(float)) - mu) / sd) @ beta - offset)
    return preds


def test_ridge_equals_refitting_every_fold(spark):
    df = contests(spark)
    table = folds.fold_table(df, burn_in=1)
    arm = {"r": gram.Arm(["a", "b"], drift=50)}
    from priorlake.operators.rules import sample_weight

    out = gram.walk_forward_ridge(df, table, arm, ["game_id", "season", "week"], {"w": sample_weight(F.col("went_to_ot"))}).toPandas()
    rows = df.toPandas().sort_values(["t", "game_id"]).reset_index(drop=True)
    got = out.set_index("game_id")
    assert len(out) == 20 * 9
    for season, week in ((2001, 1), (2001, 7), (2002, 10)):
        test = rows[(rows.season == season) & (rows.week == week)]
        train = rows[rows.t < test.t.min()]
        home, away = reference_ridge(train, test, gram.ALPHAS, 50)
        np.testing.assert_allclose(got.loc[test.game_id, "home_pred"], home, rtol=1e-8)
        np.testing.assert_allclose(got.loc[test.game_id, "away_pred"], away, rtol=1e-8)


def test_future_rows_never_reach_a_fold(spark):
    df = contests(spark)
    table = folds.fold_table(df, burn_in=1)
    arm = {"r": gram.Arm(["a", "b"], weight="", drift=0)}
    before = gram.walk_forward_ridge(df, table, arm, ["game_id", "season", "week", "t"]).filter("t <= 100").toPandas()
    changed = df.withColumn("home_score", F.when(F.col("t") > 100, 1e6).otherwise(F.col("home_score")))
    after = gram.walk_forward_ridge(changed, table, arm, ["game_id", "season", "week", "t"]).filter("t <= 100").toPandas()
    a, b = (x.sort_values("game_id")["home_pred"].to_numpy() for x in (before, after))
    np.testing.assert_allclose(a, b)


def test_ratings_equal_a_dense_fit(spark):
    rng = np.random.default_rng(3)
    rows = []
    for d in range(12):
        for _ in range(8):
            a, b = rng.choice(5, 2, replace=False)
            rows.append((int(a), int(b), int(rng.integers(2)), 9131 + 30 * d, 2000, d + 1, float(rng.normal()), float(rng.integers(1, 20))))
    games = spark.createDataFrame(rows, "team int, opponent int, is_home int, t int, season int, week int, y double, plays double")
    cuts = folds.cutoffs(games)
    for volume, dense in ((None, 500), (F.col("plays"), 500), (F.col("plays"), 0)):
        got = ratings.two_way_ratings(games, cuts, "y", volume=volume, min_rows=20, dense_teams=dense).toPandas()
        frame = games.toPandas()
        for week in (5, 12):
            cutoff = 9131 + 30 * (week - 1)
            train = frame[frame.t < cutoff]
            x = np.zeros((len(train), 11))
            x[np.arange(len(train)), train.team] = 1
            x[np.arange(len(train)), 5 + train.opponent] = 1
            x[:, 10] = train.is_home
            w = 0.5 ** ((cutoff - train.t.to_numpy()) / 119.0) * (1 if volume is None else train.plays.to_numpy())
            xb, yb = np.average(x, axis=0, weights=w), np.average(train.y, weights=w)
            beta = np.linalg.solve((x - xb).T @ ((x - xb) * w[:, None]) + 5 * np.eye(11), (x - xb).T @ ((train.y - yb) * w))
            mine = got[got.week == week].sort_values("team")
            np.testing.assert_allclose(mine["off"], beta[:5], atol=1e-9)
            np.testing.assert_allclose(mine["def"], beta[5:10], atol=1e-9)
        assert got.week.min() == 4  # 16 rows before week 3, 24 before week 4


def many_games(spark, k, n):
    rng = np.random.default_rng(4)
    team, shift = rng.integers(0, k, n), rng.integers(1, k, n)
    frame = pd.DataFrame({"team": team, "opponent": (team + shift) % k, "is_home": rng.integers(0, 2, n), "t": 9131 + 30 * rng.integers(0, 3, n), "y": rng.normal(size=n)})
    frame["season"], frame["week"] = 2000, (frame.t - 9131) // 30 + 1
    return spark.createDataFrame(frame, "team int, opponent int, is_home int, t int, y double, season int, week int")


def test_conjugate_gradients_equal_a_direct_solve(spark):
    games = many_games(spark, 600, 2400)
    cuts = folds.cutoffs(games)
    direct, rounds = (
        ratings.two_way_ratings(games, cuts, "y", alphas=(2.0, 20.0), dense_teams=d).toPandas().sort_values(["week", "alpha", "team"]) for d in (1000, 0)
    )
    assert len(direct) == len(rounds) == 2 * 2 * games.select("team").distinct().count()
    np.testing.assert_allclose(direct[["off", "def"]], rounds[["off", "def"]], atol=1e-9)


def test_ratings_of_five_thousand_teams(spark):
    games = many_games(spark, 5000, 20_000)
    got = ratings.two_way_ratings(games, folds.cutoffs(games).filter("week = 3"), "y").toPandas()
    assert len(got) == games.select("team").distinct().count() > ratings.DENSE_TEAMS and np.isfinite(got["off"]).all() and got["off"].std() > 0.1


def test_chain_matches_step_by_step():
    rng = np.random.default_rng(0)
    norm = lambda m: m / m.sum(axis=-1, keepdims=True)
    home, away = norm(rng.random((6, 9))), norm(rng.random((6, 9)))
    trans, opening = norm(rng.random((9, 6))), norm(rng.random(6))
    state = {("h", b): 0.5 * opening[b] for b in range(6)} | {("a", b): 0.5 * opening[b] for b in range(6)}
    points = {"h": 0.0, "a": 0.0}
    for _ in range(22):
        nxt = dict.fromkeys(state, 0.0)
        for (who, b), mass in state.items():
            other = "a" if who == "h" else "h"
            for o, p in enumerate((home if who == "h" else away)[b]):
                points[who] += mass * p * chain.OFFENSE_POINTS[o]
                points[other] += mass * p * chain.DEFENSE_POINTS[o]
                owner = who if o == chain.RETAINED else other
                for nb in range(6):
                    nxt[owner, nb] += mass * p * trans[o, nb]
        state = nxt
    got = chain.expected_points(home[None], away[None], trans[None], opening[None])[0]
    assert got[0] == pytest.approx(points["h"]) and got[1] == pytest.approx(points["a"])


def test_tilt_by_the_league_itself_changes_nothing(spark):
    flat = F.array(*[F.lit(1 / 9)] * 54)
    league = F.array(*[F.lit(1 / 9)] * 9)
    got = spark.range(1).select(chain.tilted(flat, league, league)).first()[0]
    np.testing.assert_allclose(got, np.full(54, 1 / 9))


def test_nonnegative_weights():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(200, 3))
    y = x @ np.array([0.7, 0.4, -0.5])
    w = blends.nonnegative_least_squares(x.T @ x, x.T @ y)
    assert w[2] == 0 and (w >= 0).all()
    two = np.linalg.lstsq(x[:, :2], y, rcond=None)[0]
    np.testing.assert_allclose(w[:2], two, rtol=1e-8)


def test_nonnegative_weights_of_many_members():
    """No feasible active set does better; at the solution no left-out member would lower the error."""
    from itertools import combinations

    rng = np.random.default_rng(6)
    for trial in range(30):
        k = int(rng.integers(1, 7))
        x = rng.normal(size=(40, k)) + rng.normal(size=(40, 1))
        y = x @ rng.normal(size=k) + rng.normal(size=40)
        gram_, xy = x.T @ x, x.T @ y
        w = blends.nonnegative_least_squares(gram_, xy)
        value = lambda b: b @ gram_ @ b - 2 * b @ xy  # noqa: B023, E731
        best = 0.0
        for size in range(1, k + 1):
            for idx in map(list, combinations(range(k), size)):
                b = np.zeros(k)
                b[idx] = np.linalg.solve(gram_[np.ix_(idx, idx)], xy[idx])
                best = min(best, value(b)) if (b >= 0).all() else best
        assert (w >= 0).all() and value(w) == pytest.approx(best, abs=1e-8)
    x = rng.normal(size=(500, 40))
    w = blends.nonnegative_least_squares(x.T @ x, x.T @ (x[:, :3] @ [1.0, 2.0, 3.0]))
    np.testing.assert_allclose(w[:3], [1, 2, 3], atol=1e-8)
    assert np.abs(w[3:]).max() < 1e-8


def test_row_bootstrap_is_repeatable_paired_and_centred(spark):
    rng = np.random.default_rng(7)
    rows = [(m, f"g{i}", float(e)) for i in range(400) for m, e in (("a", rng.normal(1.0, 1.0)), ("b", 0.0))]
    rows = [(m, g, e if m == "a" else next(x for y, h, x in rows if y == "a" and h == g) + 1) for m, g, e in rows]
    df = spark.createDataFrame(rows, "model string, game_id string, e double")
    sums = {"s": F.col("e"), "n": F.lit(1)}
    one, two = (bootstrap.row_resample(f, ["model"], "game_id", sums, 402).orderBy("model", "rep").toPandas() for f in (df, df.repartition(7)))
    assert len(one) == 2 * 403 and np.allclose(one["s"], two["s"])
    a, b = (one[(one.model == m) & (one.rep >= 0)] for m in "ab")
    assert (a["n"].to_numpy() == b["n"].to_numpy()).all() and np.allclose(b["s"].to_numpy() - a["s"].to_numpy(), a["n"])
    values = np.array([e for m, _, e in rows if m == "a"])
    ratio = (a["s"] / a["n"]).to_numpy()
    assert one[(one.model == "a") & (one.rep == -1)]["s"].item() == pytest.approx(values.sum())
    assert ratio.mean() == pytest.approx(values.mean(), abs=0.02) and ratio.std() == pytest.approx(values.std() / 20, rel=0.2)
    assert abs(a["n"].mean() - 400) < 3 and abs(a["n"].var() - 400) < 120


@pytest.mark.parametrize("buckets", [1, 16, 1024])
def test_exact_quantiles_under_skew(spark, buckets):
    rng = np.random.default_rng(5)
    values = np.concatenate([np.full(400, 3.0), rng.exponential(5, 500), [1e6]])
    keys = np.where(np.arange(len(values)) % 10 == 0, 1, 0)
    df = spark.createDataFrame([(int(k), float(v)) for k, v in zip(keys, values)], "k int, v double")
    got = {(x["k"], x["prob"]): x["q"] for x in quantiles.exact_quantiles(df, ["k"], "v", [0.0, 0.05, 0.5, 0.77, 1.0], buckets).collect()}
    for (k, p), q in got.items():
        assert q == pytest.approx(np.quantile(values[keys == k], p), rel=1e-12)
    assert len(got) == 10


def test_an_outlier_does_not_gather_the_rest(spark):
    """With one value of 1e12 no range that is sorted holds more than 1 % of the values."""
    df = spark.range(100_000).select(F.when(F.col("id") == 7, 1e12).otherwise(F.rand(3)).alias("v")).persist()
    values = np.sort([r["v"] for r in df.collect()])
    probs = [0.0, 0.1, 0.5, 0.9, 1.0]
    got = {r["prob"]: r["q"] for r in quantiles.exact_quantiles(df, [], "v", probs).collect()}
    assert all(got[p] == pytest.approx(np.quantile(values, p), rel=1e-12) for p in probs)
    cuts = df.select(F.percentile_approx("v", F.array(*[F.lit(i / quantiles.BUCKETS) for i in range(1, quantiles.BUCKETS)]), 10 * quantiles.BUCKETS)).first()[0]
    assert np.histogram(values, [-1, *cuts, 2e12])[0].max() < 0.01 * len(values)

def test_exact_quantiles_whatever_the_sketch_says(spark, monkeypatch):
    """A sketch that cuts elsewhere each time it is read, as one merged in another order does, leaves the quantiles alone."""
    sketch = F.percentile_approx
    moved = F.expr("cast(java_method('java.lang.Math', 'random') as double)")
    monkeypatch.setattr(quantiles.F, "percentile_approx", lambda *a: F.transform(sketch(*a), lambda c: c + 20 * moved))
    values = np.random.default_rng(3).normal(0, 900, (3, 2000))
    df = spark.createDataFrame(pd.DataFrame({"k": np.repeat([0, 1, 2], 2000), "v": values.reshape(-1)}))
    probs = [0.05, 0.2, 0.4, 0.5, 0.6, 0.8, 0.95]
    got = {(x["k"], x["prob"]): x["q"] for x in quantiles.exact_quantiles(df, ["k"], "v", probs).collect()}
    assert set(got) == {(k, p) for k in range(3) for p in probs}
    assert all(q == pytest.approx(np.quantile(values[k], p), rel=1e-9) for (k, p), q in got.items())


def test_bins_collapse_repeated_edges(spark):
    df = spark.createDataFrame([(float(v),) for v in (1, 1, 1, 2, 3)], "v double")
    edges = F.array(*map(F.lit, (1.0, 1.0, 2.0, 3.0)))
    got = sorted((x["v"], x["b"]) for x in df.select("v", quantiles.bin_of(F.col("v"), edges).alias("b")).collect())
    assert got == [(1.0, 0), (1.0, 0), (1.0, 0), (2.0, 0), (3.0, 1)]


def test_bootstrap_is_repeatable_and_centred(spark):
    rows = [("m", b, float(e)) for b in range(40) for e in np.random.default_rng(b).normal(1.0, 1.0, 5)]
    df = spark.createDataFrame(rows, "model string, block int, e double")
    one = bootstrap.mean_interval(df, ["model"], "block", {"x": F.col("e")}, 400).first()
    two = bootstrap.mean_interval(df.repartition(7), ["model"], "block", {"x": F.col("e")}, 400).first()
    assert one["x_lo"] == pytest.approx(two["x_lo"]) and one["x_hi"] == pytest.approx(two["x_hi"])
    mean = np.mean([r[2] for r in rows])
    assert one["x"] == pytest.approx(mean) and one["x_lo"] < mean < one["x_hi"]
    assert one["x_hi"] - one["x_lo"] == pytest.approx(4 * np.std([r[2] for r in rows]) / np.sqrt(len(rows)), rel=0.5)
