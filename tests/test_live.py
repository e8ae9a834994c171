"""Live forecasts of contests without a result against the walk-forward forecasts of the same week, and what the registry offers."""
import os

import pytest
from pyspark.sql import functions as F

from priorlake.operators.gram import Arm
from priorlake.plans import base, models

FOLDER = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="tables not present")


def test_live_forecasts_equal_the_week_walked_forward_to(spark):
    """Hiding the newest results must change nothing: no forecast may have read them."""
    got = {(r["model"], r["game_id"]): r for r in models.live_forecasts(spark, FOLDER).collect()}
    newest = base.folds(spark, FOLDER).agg(F.max("cutoff")).first()[0]
    arm = lambda name: {name: Arm(models.FEATURES)}
    rows = ["model", "game_id", "home_pred", "away_pred"]
    walked = models.ridge(spark, FOLDER, arm("ridge")).filter(F.col("t") == newest).select(*rows)
    walked = walked.unionByName(models.glm_forecasts(spark, FOLDER, arm("poisson")).filter(F.col("t") == newest).select(*rows))
    walked = walked.unionByName(base.predictions(spark, FOLDER).filter((F.col("t") == newest) & (F.col("model") == "baseline")).select(*rows))
    want = walked.collect()
    assert want and len(got) == len(want) // 3 * 4
    for r in want:
        live = got[r["model"], r["game_id"]]
        assert live["home_pred"] == pytest.approx(r["home_pred"], rel=1e-7) and live["away_pred"] == pytest.approx(r["away_pred"], rel=1e-7)
    game = want[0]["game_id"]
    mean = sum(got[m, game]["home_pred"] for m in ("ridge", "poisson", "baseline")) / 3
    assert got["composite", game]["home_pred"] == pytest.approx(mean)


def test_registry_offers_fitted_models_and_checks_the_live_list(spark):
    found = models.model_registry(spark, FOLDER)
    assert [m.name for m in found.live(["ridge", "poisson", "win_classifier", "segments"])] == ["ridge", "poisson", "win_classifier", "segments"]
    with pytest.raises(ValueError, match="not live-capable"):
        found.live(["ridge", "random_forest"])
    with pytest.raises(KeyError):
        found.live(["unheard_of"])
