"""Strictly-earlier features: known answers, leak mutations and equivalences."""
import numpy as np
import pandas as pd
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from priorlake.operators.prefix import by_width
from priorlake.operators.temporal import (
    Exponential, RecencyPlan, TwoTimescale, decayed_prior, effective_clock, prior_mean, prior_rate, shrink, shrunk_prior_rate,
)

SCHEMA = "team int, t int, x double, keep boolean"


def history(spark, rows):
    return spark.createDataFrame([(1, 9131 + 7 * i, x, k) for i, (x, k) in enumerate(rows)], SCHEMA)


def mean_at(spark, rows, row, kernel=Exponential(119.0), **options):
    out = prior_mean(history(spark, rows), ["team"], "t", {"m": "x"}, kernel, **options)
    return out.orderBy("t").collect()[row]["m"]


@pytest.mark.parametrize("own", [0.0, 1e6, -500.0])
def test_own_value_never_counts(spark, own):
    assert mean_at(spark, [(10.0, True), (own, True)], 1) == pytest.approx(10.0)


def test_masked_row_gets_a_value_but_feeds_nothing(spark):
    rows = [(10.0, True), (999.0, False), (0.0, True)]
    assert mean_at(spark, rows, 1, mask=F.col("keep")) == pytest.approx(10.0)
    assert mean_at(spark, rows, 2, mask=F.col("keep")) == pytest.approx(10.0)


def test_null_observation_is_skipped(spark):
    assert mean_at(spark, [(10.0, True), (None, True), (10.0, True), (0.0, True)], 3) == pytest.approx(10.0)


def test_first_row_is_unknown(spark):
    assert mean_at(spark, [(10.0, True)], 0) is None


def test_simultaneous_rows_do_not_see_each_other(spark):
    df = spark.createDataFrame([(1, 1, 10.0, 10.0), (1, 2, 500.0, 10.0), (1, 2, 500.0, 10.0)], "team int, t int, n double, d double")
    out = prior_rate(df, ["team"], "t", {"r": (F.col("n"), F.col("d"))}, Exponential(7.0)).orderBy("t").collect()
    assert [x["r"] for x in out] == [None, pytest.approx(1.0), pytest.approx(1.0)]
    assert out[0]["r_n"] == 0.0


def test_positional_window_would_leak(spark):
    """The gate above is able to fail: a ROWS frame lets one of two simultaneous rows see the other."""
    df = spark.createDataFrame([(1, 1, 10.0), (1, 2, 500.0), (1, 2, 500.0)], "team int, t int, x double")
    over = Window.partitionBy("team").orderBy("t").rowsBetween(Window.unboundedPreceding, -1)
    assert max(x["m"] for x in df.select(F.avg("x").over(over).alias("m")).collect() if x["m"]) > 10.0


@pytest.mark.parametrize("seed", range(3))
def test_matches_time_based_ewm(spark, seed):
    rng = np.random.default_rng(seed)
    days = np.cumsum(rng.integers(1, 40, 30))
    values = np.where(rng.random(30) < 0.2, np.nan, rng.normal(20, 8, 30))
    frame = pd.DataFrame({"team": 1, "t": days + 9131, "x": values})
    times = pd.Timestamp("1995-01-01") + pd.to_timedelta(days, unit="D")
    expected = pd.Series(values).ewm(halflife=pd.Timedelta(days=50), times=pd.Series(times), ignore_na=False).mean().shift(1)
    df = spark.createDataFrame([(int(a), int(b), None if np.isnan(c) else float(c)) for a, b, c in frame.itertuples(index=False)], "team int, t int, x double")
    got = prior_mean(df, ["team"], "t", {"m": "x"}, Exponential(50.0)).orderBy("t").toPandas()["m"].astype(float)
    np.testing.assert_allclose(got, expected, rtol=1e-10)


def test_two_timescale_current_and_previous_anchor(spark):
    rng = np.random.default_rng(1)
    t, x = np.cumsum(rng.integers(1, 30, 12)), rng.normal(size=12)
    kernel = TwoTimescale(10.0, 100.0, 0.7)
    df = spark.createDataFrame([(1, int(a), float(b)) for a, b in zip(t, x)], "team int, t int, x double")
    for anchor in ("current", "previous"):
        got = prior_mean(df, ["team"], "t", {"m": "x"}, kernel, anchor=anchor).orderBy("t").toPandas()["m"].astype(float)
        for i in range(1, 12):
            at = t[i] if anchor == "current" else t[i - 1]
            w = 0.7 * 0.5 ** ((at - t[:i]) / 10) + 0.3 * 0.5 ** ((at - t[:i]) / 100)
            assert got[i] == pytest.approx((w * x[:i]).sum() / w.sum())


def test_blocks_and_shuffles_change_nothing(spark):
    """One entity holds most rows; blocks of any width and any input order give the same sums."""
    rows = [(0 if i % 3 else i % 7, int(i * 37 % 500), float(i % 11)) for i in range(3000)]
    df = spark.createDataFrame(rows, "team int, t int, x double")
    pairs = {"m": (F.col("x"), F.lit(1.0))}
    plain = decayed_prior(df, ["team"], "t", pairs, Exponential(90.0)).toPandas().sort_values(["team", "t"])
    for block, parts in ((by_width(10), 1), (by_width(77), 13)):
        again = decayed_prior(df.repartition(parts), ["team"], "t", pairs, Exponential(90.0), block=block)
        again = again.toPandas().sort_values(["team", "t"])
        np.testing.assert_allclose(again["m"].astype(float), plain["m"].astype(float), rtol=1e-9)


def test_shrink_without_evidence_is_the_prior(spark):
    df = spark.createDataFrame([(None, 0.0, 4.0), (2.0, 100.0, 4.0)], "r double, n double, p double")
    got = [x[0] for x in df.select(shrink(F.col("r"), F.col("n"), F.col("p"), 100.0)).collect()]
    assert got == [4.0, 3.0]


def test_pooled_prior_covers_all_entities(spark):
    df = spark.createDataFrame([(1, 1, 10.0, 10.0), (2, 1, 30.0, 10.0), (3, 2, 0.0, 1.0)], "team int, t int, n double, d double")
    out = shrunk_prior_rate(df, "team", "t", {"r": (F.col("n"), F.col("d"))}, {"r": 5.0}, Exponential(10.0))
    assert out.filter("team = 3").first()["r_shrunk"] == pytest.approx(2.0)


def test_timelines(spark):
    df = spark.createDataFrame([(1, 0), (1, 7), (1, 207)], "team int, t int")
    clock = lambda s: [x["clock"] for x in effective_clock(df, ["team"], "t", s).orderBy("t").collect()]
    assert clock("calendar") == [0, 7, 207]
    assert clock("compressed") == [0, 7, 52]
    assert clock("games") == [0, 7, 14]
    with pytest.raises(ValueError):
        effective_clock(df, ["team"], "t", "lunar")


def test_kernel_rules():
    with pytest.raises(ValueError):
        TwoTimescale(10.0, 100.0, 1.5)
    with pytest.raises(ValueError):
        TwoTimescale(100.0, 10.0, 0.5)
    plan = RecencyPlan(Exponential(10.0), {"a": Exponential(5.0)})
    assert plan.kernel("a").halflife == 5.0 and plan.kernel("b").halflife == 10.0


@pytest.mark.parametrize("anchor, width", [("current", None), ("previous", None), ("current", 400), ("previous", 5000)])
@pytest.mark.parametrize("kernel", [Exponential(7.0), TwoTimescale(7.0, 60.0, 0.7)])
def test_a_century_of_seven_day_half_lives(spark, anchor, width, kernel):
    """Means and effective counts against exact sums scaled to the newest earlier row, far beyond what one origin could hold."""
    rng = np.random.default_rng(3)
    rows = []
    for team in range(3):
        days = np.unique(np.concatenate([rng.integers(0, 36_500, 60), [100, 101, 103], 20_000 + rng.integers(0, 40, 20), [-9_000]]))
        rows += [(team, int(d), None if rng.random() < 0.2 else float(rng.normal()), float(rng.integers(0, 3))) for d in days]
    df = spark.createDataFrame(rows, "team int, t int, x double, n double")
    pairs = {"m": (F.col("x"), F.when(F.col("x").isNotNull(), F.lit(1.0))), "r": (F.col("x") * F.col("n"), F.when(F.col("x").isNotNull(), F.col("n")))}
    block = by_width(width) if width else None
    got = decayed_prior(df, ["team"], "t", pairs, kernel, anchor=anchor, block=block).toPandas().set_index(["team", "t"])
    for team in range(3):
        mine = sorted(r for r in rows if r[0] == team)
        for k, (_, t, _, _) in enumerate(mine):
            at = mine[k - 1][1] if anchor == "previous" and k else t
            for name, share in (("m", lambda n: 1.0), ("r", lambda n: n)):
                fed = [(d, x, share(n)) for _, d, x, n in mine[:k] if x is not None and share(n) > 0]
                row = got.loc[(team, t)]
                if not fed:
                    assert np.isnan(row[name]) and row[f"{name}_n"] == 0
                    continue
                log = lambda d: [np.log2(s) - (at - d) / h for s, h in kernel.parts()]  # noqa: B023, E731
                top = max(max(log(d)) for d, _, _ in fed)
                w = np.array([v * sum(2.0 ** (e - top) for e in log(d)) for d, _, v in fed])
                assert row[name] == pytest.approx((w * [x for _, x, _ in fed]).sum() / w.sum(), rel=1e-9, abs=1e-12)
                assert row[f"{name}_n"] == pytest.approx(w.sum() * 2.0**top if top > -1000 else 0.0, rel=1e-9, abs=1e-300)
