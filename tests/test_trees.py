"""Trees of all folds at once against boosters and forests grown row by row for single folds."""
import dataclasses

import numpy as np
import pytest
from pyspark.sql import functions as F
from test_models import contests

from priorlake.operators import folds, trees
from priorlake.operators.rules import sample_weight

KEEP = ["game_id", "season", "week", "t"]
BOOSTED = dataclasses.replace(trees.BOOSTED, count=12, depth=3, rate=0.2, bins=8, columns=0.5, l1=0.3)
FOREST = dataclasses.replace(trees.FOREST, count=9, depth=3, least_rows=6, bins=8)


def forecasts(df, how, drift=40, part_rows=None, burn_in=1):
    out = trees.walk_forward_trees(df, folds.fold_table(df, burn_in=burn_in), ["a", "b"], KEEP, sample_weight(F.col("went_to_ot")), how, drift, part_rows)
    return out.toPandas().set_index("game_id")


class Node:
    """A tree grown by trying every cut of every allowed feature on the rows themselves."""

    def __init__(self, x, g, w, k, columns, edges, how, depth):
        self.split, self.value = None, -how.rate * self.soft(g.sum(), how) / (w.sum() + how.l2)
        best = trees.LEAST_GAIN
        if depth == 0:
            return
        for j in columns:
            for cut in edges[j][np.isfinite(edges[j])]:
                for missing_left in ([False] if how.impute else [False, True]):
                    left = np.where(np.isnan(x[:, j]), missing_left, x[:, j] <= cut)
                    sides = [(g[s].sum(), w[s].sum(), (k[s] > 0).sum()) for s in (left, ~left)]
                    if any(s[1] < max(how.least_weight, 1e-12) or s[2] < how.least_rows for s in sides):
                        continue
                    gain = sum(self.soft(s[0], how) ** 2 / (s[1] + how.l2) for s in sides) - self.soft(g.sum(), how) ** 2 / (w.sum() + how.l2)
                    if gain > best + 1e-9 * max(1, abs(best)):
                        best, self.split = gain, (j, cut, missing_left, left)
        if self.split:
            left = self.split[3]
            self.kids = [Node(x[s], g[s], w[s], k[s], columns, edges, how, depth - 1) for s in (left, ~left)]

    @staticmethod
    def soft(g, how):
        return np.sign(g) * max(abs(g) - how.l1, 0)

    def predict(self, row):
        if not self.split:
            return self.value
        j, cut, missing_left, _ = self.split
        left = missing_left if np.isnan(row[j]) else row[j] <= cut
        return self.kids[0 if left else 1].predict(row)


def reference(train, test, first, how, drift):
    """Both sides' forecasts of a fold; bins are cut on the rows before the season's first fold."""
    x, z = (f[["a", "b"]].to_numpy(float) for f in (train, test))
    edges = [np.unique(np.quantile(v[~np.isnan(v)], np.arange(1, how.bins) / how.bins, method="lower")) for v in x[:first].T]
    if how.impute:
        mean = np.nanmean(x, axis=0)
        x, z = np.where(np.isnan(x), mean, x), np.where(np.isnan(z), mean, z)
    w = np.where(train.went_to_ot == 1, 0.5, 1.0)
    out = []
    for side in ("home", "away"):
        y = train[f"{side}_score"].to_numpy(float)
        score, ahead = np.zeros(len(x)), np.zeros(len(z))
        if how.boosted:
            score += np.average(y, weights=w)
            ahead += np.average(y, weights=w)
        for tree in range(how.count):
            k = trees.row_counts(train.key.to_numpy(), how, tree)
            in_, before = k > 0, score if how.boosted else np.zeros(len(x))
            grown = Node(x[in_], ((before - y) * w * k)[in_], (w * k)[in_], k[in_], trees.tree_columns(2, how, tree), edges, how, how.depth)
            share = 1 if how.boosted else 1 / how.count
            score = score + share * np.array([grown.predict(r) for r in x])
            ahead = ahead + share * np.array([grown.predict(r) for r in z])
        out.append(ahead - ((score - y)[-drift:].mean() if drift else 0.0))
    return out


@pytest.mark.parametrize("how", [BOOSTED, FOREST], ids=["boosted", "forest"])
def test_folds_equal_trees_grown_on_their_rows(spark, how):
    df = contests(spark)
    got = forecasts(df, how)
    assert len(got) == 20 * 9
    rows = df.withColumn("key", F.xxhash64("game_id")).toPandas().sort_values(["t", "game_id"]).reset_index(drop=True)
    for season, week in ((2001, 1), (2001, 8), (2002, 5)):
        test = rows[(rows.season == season) & (rows.week == week)]
        train = rows[rows.t < test.t.min()]
        first = (rows.t < rows[rows.season == season].t.min()).sum()
        for side, want in zip(("home", "away"), reference(train, test, first, how, 40)):
            np.testing.assert_allclose(got.loc[test.game_id, f"{side}_pred"], want, rtol=1e-9)


@pytest.mark.parametrize("how", [BOOSTED, FOREST], ids=["boosted", "forest"])
def test_passes_over_parts_give_the_same_trees(spark, how):
    df = contests(spark, 24, 9)
    whole, parts = forecasts(df, how), forecasts(df.repartition(5), how, part_rows=50)
    np.testing.assert_allclose(whole["home_pred"], parts.loc[whole.index, "home_pred"], rtol=1e-9)
    np.testing.assert_allclose(whole["away_pred"], parts.loc[whole.index, "away_pred"], rtol=1e-9)


def test_future_rows_never_reach_a_fold(spark):
    df = contests(spark)
    changed = df.withColumns({"home_score": F.when(F.col("t") > 100, 1e4).otherwise(F.col("home_score")), "a": F.when(F.col("t") > 100, -9.0).otherwise(F.col("a"))})
    before, after = (f[f.t <= 100].sort_index()["home_pred"] for f in (forecasts(df, BOOSTED), forecasts(changed, BOOSTED)))
    np.testing.assert_array_equal(before, after)


def test_trees_learn_and_no_folds_give_no_rows(spark):
    df = contests(spark)
    got = forecasts(df, dataclasses.replace(trees.BOOSTED, count=60, rate=0.1))
    rows = df.toPandas().set_index("game_id").loc[got.index]
    error = np.sqrt(((got["home_pred"] - rows["home_score"]) ** 2).mean())
    assert error < 0.6 * rows["home_score"].std()
    assert len(forecasts(df, BOOSTED, burn_in=9)) == 0


def test_bootstrap_counts_are_poisson():
    counts = trees.row_counts(np.arange(200_000), trees.FOREST, 3)
    assert abs(counts.mean() - 1) < 0.01 and abs(counts.var() - 1) < 0.02 and abs((counts == 0).mean() - np.exp(-1)) < 0.005
    share = trees.row_counts(np.arange(200_000), trees.BOOSTED, 3)
    assert abs(share.mean() - 0.8) < 0.005 and not (share == trees.row_counts(np.arange(200_000), trees.BOOSTED, 4)).all()
