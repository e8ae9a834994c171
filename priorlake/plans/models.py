"""Forecast models (section I) and arm comparisons (J29, J31 to J43)."""
from __future__ import annotations

from pyspark.sql import functions as F

from priorlake.functions import scalars as sc
from priorlake.operators import assemble, blends, chain, folds, glm, gram, prefix, ratings, registry, roster, rollup, rules, temporal, trees
from priorlake.operators import bootstrap as bs
from priorlake.operators import evaluate as ev
from priorlake.operators.gram import ALPHAS, Arm
from priorlake.plans import base
from priorlake.plans.base import HALFLIFE, MEASURES, query, r, rs, with_views
from priorlake.plans.evaluation import REPS
from priorlake.plans.facts import filter_predicates, starts
from priorlake.plans.temporal import SPLITS, split_features
from priorlake.sources.stages import written
from priorlake.sources.tables import parts_of
from priorlake.sources.views import plays

FEATURES = [f"{s}_pregame_{m}" for s in ("home", "away") for m in MEASURES] + ["is_neutral_site", "is_playoff"]
KEEP = ["game_id", "season", "week", "t", "home_team", "away_team", "home_score", "away_score"]
MEMBERS = ["league_average", "baseline"]


def overtime_weights():
    return {"w": rules.sample_weight(F.col("went_to_ot"))}


def ridge(spark, folder, arms, table=None, weights=None):
    table = base.model_table(spark, folder) if table is None else table
    return gram.walk_forward_ridge(table, base.folds(spark, folder), arms, KEEP, overtime_weights() if weights is None else weights)


def shown(df, *extra):
    return df.select("game_id", "season", "week", *extra, *rs("home_pred", "away_pred", digits=4))


def _pred_sql(model: str) -> str:
    return with_views("preds", f"SELECT game_id, season, week, round(home_pred, 6) AS home_pred, round(away_pred, 6) AS away_pred FROM preds WHERE model = '{model}'")


def _of(spark, folder, model):
    return base.predictions(spark, folder).filter(F.col("model") == model).select("game_id", "season", "week", *rs("home_pred", "away_pred"))


@query("i1_league_average", _pred_sql("league_average"))
def league_average(spark, folder):
    return _of(spark, folder, "league_average")


@query("i2_rule_baseline", _pred_sql("baseline"))
def rule_baseline(spark, folder):
    return _of(spark, folder, "baseline")


@query("i3_sample_weights", with_views("model_table", """
SELECT game_id, CASE WHEN went_to_ot = 1 THEN 0.5 ELSE 1.0 END::DOUBLE AS overtime_weight,
       round(CASE WHEN went_to_ot = 1 THEN 0.5 ELSE 1.0 END * pow(0.5, ((SELECT max(t) FROM model_table) - t) / 364.0), 8) AS weight FROM model_table"""))
def sample_weights(spark, folder):
    table = base.model_table(spark, folder)
    age = table.agg(F.max("t")).scalar() - F.col("t")
    w = rules.sample_weight(F.col("went_to_ot"))
    return table.select("game_id", w.alias("overtime_weight"), r(w * rules.recency_weight(age, 364.0), 8).alias("weight"))


@query("i4_weighted_drift", with_views("preds", """
WITH d AS (SELECT model, t, sum(home_pred - home_score) AS e, count(*) AS n FROM preds GROUP BY ALL)
SELECT a.model, a.t, round(sum(b.e * pow(0.5, (a.t - b.t) / 182.0)) / sum(b.n * pow(0.5, (a.t - b.t) / 182.0)), 6) AS off_home
FROM d a LEFT JOIN d b ON a.model = b.model AND b.t < a.t GROUP BY ALL"""))
def weighted_drift(spark, folder):
    err = F.col("home_pred") - F.col("home_score")
    out = temporal.decayed_prior(base.predictions(spark, folder), ["model"], "t", {"off_home": (err, F.lit(1.0))}, temporal.Exponential(182.0))
    return out.select("model", "t", r("off_home").alias("off_home"))


@query("i5_standardise", with_views("model_table folds", """
SELECT f.season, f.week, round(avg(m.home_pregame_team_score), 6) AS mean, round(stddev_pop(m.home_pregame_team_score), 6) AS sd
FROM folds f JOIN model_table m ON m.t < f.cutoff GROUP BY ALL"""))
def standardise(spark, folder):
    x = F.col("home_pregame_team_score")
    sums = {"n": x.isNotNull().cast("int"), "s": x, "ss": x * x}
    at = folds.training_sums(base.model_table(spark, folder), base.folds(spark, folder), sums)
    mean = F.col("s") / F.col("n")
    return at.select("season", "week", r(mean).alias("mean"), r(F.sqrt(F.col("ss") / F.col("n") - mean * mean)).alias("sd"))


@query("i6_ridge")
def ridge_walk_forward(spark, folder):
    """Penalty chosen inside each fold on five expanding splits; overtime weights; drift offset."""
    return shown(ridge(spark, folder, {"ridge": Arm(FEATURES)}))


_X = "coalesce(m.home_pregame_team_score, p.mean)"


@query("i6_ridge_one_feature", with_views("model_table folds", f"""
WITH p AS (SELECT f.season, f.week, f.cutoff, avg(m.home_pregame_team_score) AS mean FROM folds f JOIN model_table m ON m.t < f.cutoff GROUP BY ALL),
s AS (SELECT p.season, p.week, p.mean, regr_sxy(m.home_score, {_X}) AS sxy, regr_sxx(m.home_score, {_X}) AS sxx, var_pop({_X}) AS v, avg(m.home_score) AS ybar
      FROM p JOIN model_table m ON m.t < p.cutoff GROUP BY ALL)
SELECT m.game_id, round(ybar + sxy / (sxx + 50 * v) * (coalesce(m.home_pregame_team_score, s.mean) - s.mean), 5) AS home_pred FROM s JOIN model_table m USING (season, week)"""))
def ridge_one_feature(spark, folder):
    arm = {"x": Arm(["home_pregame_team_score"], alphas=(50.0,), weight="", drift=0)}
    return ridge(spark, folder, arm, weights={}).select("game_id", *rs("home_pred", digits=5))


@query("i22_ols", with_views("model_table folds", f"""
WITH p AS (SELECT f.season, f.week, f.cutoff, avg(m.home_pregame_team_score) AS mean FROM folds f JOIN model_table m ON m.t < f.cutoff GROUP BY ALL),
s AS (SELECT p.season, p.week, p.mean, regr_slope(m.home_score, {_X}) AS b, regr_intercept(m.home_score, {_X}) AS a,
             regr_slope(m.away_score, {_X}) AS b2, regr_intercept(m.away_score, {_X}) AS a2 FROM p JOIN model_table m ON m.t < p.cutoff GROUP BY ALL)
SELECT m.game_id, round(a + b * coalesce(m.home_pregame_team_score, s.mean), 5) AS home_pred, round(a2 + b2 * coalesce(m.home_pregame_team_score, s.mean), 5) AS away_pred
FROM s JOIN model_table m USING (season, week)"""))
def ordinary_least_squares(spark, folder):
    arm = {"ols": Arm(["home_pregame_team_score"], alphas=(0.0,), weight="", drift=0)}
    return ridge(spark, folder, arm, weights={}).select("game_id", *rs("home_pred", "away_pred", digits=5))


def model_registry(spark, folder):
    """Fitted and rule models under one interface, all on the model table."""
    one = ["home_pregame_team_score"]
    fitted = {"ridge_one": Arm(one, alphas=(50.0,), weight="", drift=0), "ols_one": Arm(one, alphas=(0.0,), weight="", drift=0)}
    found = registry.Registry()
    for name, arm in fitted.items():
        found.add(registry.Model(name, "model_table", lambda t, n=name, a=arm: ridge(spark, folder, {n: a}, table=t, weights={})))
    found.add(registry.Model("ridge", "model_table", lambda t: ridge(spark, folder, {"ridge": Arm(FEATURES)}, table=t)))
    found.add(registry.Model("poisson", "model_table", lambda t: glm_forecasts(spark, folder, {"poisson": Arm(FEATURES)}, table=t)))
    found.add(registry.Model("win_classifier", "model_table", lambda t: glm_forecasts(spark, folder, {"win_classifier": Arm(FEATURES)}, table=t, family=glm.Logistic)))
    found.add(registry.Model("random_forest", "model_table", lambda t: tree_forecasts(spark, folder, trees.FOREST, table=t), live=False))
    found.add(registry.Model("boosted_trees", "model_table", lambda t: tree_forecasts(spark, folder, trees.BOOSTED, table=t), live=False))
    found.add(registry.Model("segments", "segment_table", lambda t: chain.outcome_model(t, KEEP)))
    found.add(registry.Model("baseline", "model_table", lambda t: rules.rule_predictions(t, rules.rule_parameters(t, base.folds(spark, folder))).filter("model = 'baseline'")))
    return found


_MEMBER = lambda side: f"""ybar_{side[0]} + sxy_{side[0]} / (sxx + 50 * v) * d AS r_{side[0]}, ybar_{side[0]} + sxy_{side[0]} / sxx * d AS o_{side[0]}"""


@query("m4_registry_composite", with_views("model_table folds preds", f"""
WITH p AS (SELECT f.season, f.week, f.cutoff, avg(m.home_pregame_team_score) AS mean FROM folds f JOIN model_table m ON m.t < f.cutoff GROUP BY ALL),
s AS (SELECT p.season, p.week, p.mean, regr_sxy(m.home_score, {_X}) AS sxy_h, regr_sxy(m.away_score, {_X}) AS sxy_a, regr_sxx(m.home_score, {_X}) AS sxx,
      var_pop({_X}) AS v, avg(m.home_score) AS ybar_h, avg(m.away_score) AS ybar_a FROM p JOIN model_table m ON m.t < p.cutoff GROUP BY ALL),
f AS (SELECT game_id, {_MEMBER('home')}, {_MEMBER('away')} FROM (SELECT m.game_id, s.*, coalesce(m.home_pregame_team_score, s.mean) - s.mean AS d FROM s JOIN model_table m USING (season, week)))
SELECT game_id, season, week, round((r_h + o_h + home_pred) / 3, 5) AS home_pred, round((r_a + o_a + away_pred) / 3, 5) AS away_pred
FROM f JOIN preds USING (game_id) WHERE model = 'baseline'"""))
def registry_composite(spark, folder):
    """A composite of fitted members, taken from the registry by name."""
    found = model_registry(spark, folder)
    names = [m.name for m in found.live(["ridge_one", "ols_one", "baseline"])]
    out = found.composite(names, {"model_table": base.model_table(spark, folder)})
    return out.select("game_id", "season", "week", *rs("home_pred", "away_pred", digits=5))


def glm_forecasts(spark, folder, arms, table=None, weights=None, family=glm.Poisson):
    table = base.model_table(spark, folder) if table is None else table
    return glm.walk_forward_glm(table, base.folds(spark, folder), arms, KEEP, overtime_weights() if weights is None else weights, family)


@query("i7_poisson")
def poisson(spark, folder):
    """Refit every week: Newton rounds over all weeks at once; penalty 1 on standardised features; overtime weights; drift offset."""
    return shown(glm_forecasts(spark, folder, {"poisson": Arm(FEATURES)}))


@query("i8_win_classifier")
def win_classifier(spark, folder):
    """Refit every week: win probability to a score pair by the training margins and total."""
    return shown(glm_forecasts(spark, folder, {"win": Arm(FEATURES)}, family=glm.Logistic))


def tree_forecasts(spark, folder, how, features=None, table=None):
    table = base.model_table(spark, folder) if table is None else table
    return trees.walk_forward_trees(table, base.folds(spark, folder), features or FEATURES, KEEP, overtime_weights()["w"], how)


@query("i9_random_forest")
def random_forest(spark, folder):
    """Refit every week: 300 bootstrapped trees of depth 4, all weeks grown together."""
    return shown(tree_forecasts(spark, folder, trees.FOREST))


@query("i10_boosted_trees")
def boosted_trees(spark, folder):
    """Refit every week: 100 rounds of depth 3 from summed histograms, all weeks grown together."""
    return shown(tree_forecasts(spark, folder, trees.BOOSTED))


POOLING_K = 20.0


@query("i11_partial_pooling", with_views("preds", f"""
WITH b AS (SELECT * FROM preds WHERE model = 'baseline')
SELECT b.game_id, round(b.home_pred + coalesce((SELECT sum(x.home_score - x.home_pred) / (count(*) + {POOLING_K}) FROM b x WHERE x.home_team = b.home_team AND x.t < b.t), 0), 6) AS home_pred,
       round(b.away_pred + coalesce((SELECT sum(x.away_score - x.away_pred) / (count(*) + {POOLING_K}) FROM b x WHERE x.away_team = b.away_team AND x.t < b.t), 0), 6) AS away_pred FROM b"""))
def partial_pooling(spark, folder):
    base_preds = base.predictions(spark, folder).filter("model = 'baseline'")
    return blends.pooled_effects(base_preds, "t", POOLING_K).select("game_id", *rs("home_pred", "away_pred"))


@query("i12_two_way_ratings")
def two_way_ratings(spark, folder):
    return two_way(spark, folder).select("season", "week", "team", *rs("off", "def", digits=5))


def two_way(spark, folder):
    """Ratings of every cutoff, solved once and written: both sides of a contest and several arm sets read them."""
    def build():
        df = base.facts(spark, folder)
        return written(ratings.two_way_ratings(df, folds.cutoffs(df), "off_epa_per_play"), "two_way_ratings")

    return base.keep(spark, folder, "two_way_ratings", build)


UNITS = {"pass": ("off_pass_epa_per_play", "off_pass_plays"), "rush": ("off_rush_epa_per_play", "off_rush_plays")}
ADJUSTED = ["adj_off_pass", "adj_off_rush", "adj_def_pass_allowed", "adj_def_rush_allowed"]


def unit_ratings(spark, folder):
    df = base.facts(spark, folder)
    return ratings.unit_ratings(df, folds.cutoffs(df), UNITS)


@query("i13_unit_ratings")
def unit_rating_query(spark, folder):
    return unit_ratings(spark, folder).select("season", "week", "team", *rs(*ADJUSTED, digits=5))


@query("i14_alpha_scan")
def alpha_scan(spark, folder):
    df = base.facts(spark, folder)
    out = ratings.alpha_scan(df, folds.cutoffs(df), "off_epa_per_play", (0.5, 1.0, 2.0, 5.0, 10.0, 20.0, 50.0, 100.0))
    return out.select("alpha", "n_weeks", *rs("rmse"))


@query("c13_ratings_join")
def ratings_join(spark, folder):
    joined = assemble.attach_sided(base.contests(spark, folder), unit_ratings(spark, folder), ["season", "week"], ADJUSTED)
    return joined.select("game_id", *rs("home_adj_off_pass", "away_adj_def_pass_allowed", digits=5))


# ------------------------------------------------------------------ segment models


def segment_table(spark, folder):
    """Contests with both sides' decayed outcome rates as arrays, and their segment volumes."""
    seg = base.drives(spark, folder)
    names = [o.lower().replace(" ", "_") for o in base.OUTCOME_NAMES]
    off = rollup.outcome_rates(seg, "posteam", "off", base.OUTCOME_NAMES)
    faced = rollup.outcome_rates(seg, "defteam", "def", base.OUTCOME_NAMES)
    both = off.unionByName(faced, allowMissingColumns=True)
    measures = [f"{p}_{n}_rate" for p in ("off", "def") for n in names] + ["off_n", "def_n"]
    pairs = {m: (F.col(m).cast("double"), F.when(F.col(m).isNotNull(), F.lit(1.0))) for m in measures}
    pre = temporal.decayed_prior(both, ["team"], "t", pairs, temporal.Exponential(HALFLIFE))
    packed = lambda p: F.when(F.col(f"{p}_{names[0]}_rate").isNotNull(), F.array(*[F.col(f"{p}_{n}_rate") for n in names]))
    sided = pre.select("team", "t", packed("off").alias("off"), packed("def").alias("def"), F.col("off_n").alias("n_drives"), F.col("def_n").alias("n_faced"))
    contests = base.model_table(spark, folder).select(*KEEP, "is_neutral_site", "went_to_ot")
    return base.keep(spark, folder, "segment_table", lambda: written(assemble.attach_sided(contests, sided, ["t"], ["off", "def", "n_drives", "n_faced"]), "segment_table"))


def outcome_forecasts(spark, folder):
    """Forecasts of the outcome model, kept for the queries that compare with them."""
    return base.keep(spark, folder, "outcome_forecasts", lambda: written(chain.outcome_model(segment_table(spark, folder), KEEP), "outcome_forecasts"))


@query("i15_outcome_model")
def outcome_model(spark, folder):
    return shown(outcome_forecasts(spark, folder), "w")


def chain_segments(spark, folder):
    seg = base.chain(spark, folder)
    first = base.drives(spark, folder).groupBy("game_id").agg(F.min(F.struct("first_day", "drive", "posteam")).alias("_first"))
    at = F.struct("first_day", "drive", "posteam")
    return seg.join(first, "game_id").withColumn("nth", F.when(at == F.col("_first"), 0).otherwise(1)).withColumn("t", temporal.epoch_day(F.col("gameday")))


@query("i16_chain_expectation")
def chain_expectation(spark, folder):
    """Exact expected points of every contest's own pair, from the segments before its week; no edge, no offset."""
    inputs = chain.chain_inputs(segment_table(spark, folder), chain_segments(spark, folder), base.OUTCOME_NAMES).filter("role = 'test'")
    return chain.chain_points(inputs, ["game_id", "season", "week"]).select(
        "game_id", "season", "week", r("home_raw").alias("home_points"), r("away_raw").alias("away_points")
    )


@query("i17_chain_model")
def chain_model(spark, folder):
    return shown(chain.chain_model(segment_table(spark, folder), chain_segments(spark, folder), base.OUTCOME_NAMES, KEEP))


# ------------------------------------------------------------------ combinations


@query("i18_composite", with_views("preds", """
SELECT game_id, season, week, round(avg(home_pred), 6) AS home_pred, round(avg(away_pred), 6) AS away_pred FROM preds
WHERE model IN ('league_average', 'baseline') GROUP BY ALL"""))
def composite(spark, folder):
    return assemble.combine_members(base.predictions(spark, folder), MEMBERS).select("game_id", "season", "week", *rs("home_pred", "away_pred"))


def members(spark, folder):
    return blends.member_table(base.predictions(spark, folder), MEMBERS)


FITTED = ["league_average", "baseline", "ridge", "poisson", "segments"]


def member_forecasts(spark, folder):
    """Out-of-fold forecasts of rule-based and fitted members, kept as one table: what outer folds learn from was never fitted on its own rows."""
    def build():
        rows = ["model", *KEEP, "home_pred", "away_pred"]
        out = base.predictions(spark, folder).filter(F.col("model").isin(*MEMBERS)).select(*rows)
        out = out.unionByName(ridge(spark, folder, {"ridge": Arm(FEATURES)}).select(*rows))
        out = out.unionByName(glm_forecasts(spark, folder, {"poisson": Arm(FEATURES)}).select(*rows))
        return written(out.unionByName(outcome_forecasts(spark, folder).withColumn("model", F.lit("segments")).select(*rows)), "member_forecasts")

    return base.keep(spark, folder, "member_forecasts", build)


@query("i18_fitted_composite")
def fitted_composite(spark, folder):
    """Equal-weight mean of all members over the contests that every one of them forecast."""
    out = assemble.combine_members(member_forecasts(spark, folder), FITTED)
    return shown(out)


@query("i19_stack")
def stack(spark, folder):
    """Ridge over the members' own out-of-fold forecasts, refit every week on earlier weeks."""
    arm = {"stack": Arm({s: [f"{m}_{s}" for m in FITTED] for s in gram.SIDES}, weight="", drift=0)}
    wide = blends.member_table(member_forecasts(spark, folder), FITTED)
    keep = ["game_id", "season", "week"]
    return shown(gram.walk_forward_ridge(wide, folds.fold_table(wide, burn_in=1), arm, keep))


@query("i20_tail_blend", with_views("preds folds", """
WITH w AS (SELECT game_id, season, week, t, max(home_pred) FILTER (model = 'league_average') AS a_h, max(home_pred) FILTER (model = 'baseline') AS b_h,
   max(away_pred) FILTER (model = 'league_average') AS a_a, max(away_pred) FILTER (model = 'baseline') AS b_a, any_value(home_score) AS hs, any_value(away_score) AS sa FROM preds GROUP BY ALL),
o AS (SELECT f.season AS fs, f.week AS fw, w.*, row_number() OVER (PARTITION BY f.season, f.week ORDER BY w.t, w.game_id) - 1 AS place, count(*) OVER (PARTITION BY f.season, f.week) AS n
      FROM folds f JOIN w ON w.t < f.cutoff),
e AS (SELECT fs, fw, g.g AS g, count(*) AS rows, round(sum(((1 - g.g) * a_h + g.g * b_h - hs) ** 2 + ((1 - g.g) * a_a + g.g * b_a - sa) ** 2), 6) AS err
      FROM o, (SELECT unnest(range(0, 21)) * 0.05 AS g) g WHERE place >= floor(n * 0.75) GROUP BY ALL),
c AS (SELECT fs AS season, fw AS week, CASE WHEN any_value(rows) < 40 THEN 0.25 ELSE arg_min(g, err) END AS wt FROM e GROUP BY ALL)
SELECT game_id, CAST(round(wt, 2) AS DOUBLE) AS w, round((1 - wt) * a_h + wt * b_h, 6) AS home_pred, round((1 - wt) * a_a + wt * b_a, 6) AS away_pred FROM w JOIN c USING (season, week)"""))
def tail_blend(spark, folder):
    out = blends.tail_blend(members(spark, folder), base.folds(spark, folder), *MEMBERS)
    return out.select("game_id", r("w", 2).alias("w"), *rs("home_pred", "away_pred"))


@query("i21_member_weights", with_views("preds folds", """
WITH e AS (SELECT f.season, f.week, p.model, avg((p.home_pred - p.home_score) ** 2) AS mse FROM folds f JOIN preds p ON p.t < f.cutoff WHERE p.model <> 'composite' GROUP BY ALL),
w AS (SELECT season, week, model, (1 / mse) / sum(1 / mse) OVER (PARTITION BY season, week) AS inv, CAST(mse = min(mse) OVER (PARTITION BY season, week) AS INT) AS best FROM e)
SELECT 'equal' AS scheme, p.game_id, round(avg(p.home_pred), 6) AS home_pred FROM preds p JOIN w USING (season, week, model) GROUP BY p.game_id
UNION ALL SELECT 'inv_mse', p.game_id, round(sum(p.home_pred * inv), 6) FROM preds p JOIN w USING (season, week, model) GROUP BY p.game_id
UNION ALL SELECT 'best_single', p.game_id, round(sum(p.home_pred * best), 6) FROM preds p JOIN w USING (season, week, model) GROUP BY p.game_id"""))
def member_weights(spark, folder):
    return weighted_schemes(spark, folder).filter("model <> 'nnls'").select(F.col("model").alias("scheme"), "game_id", *rs("home_pred"))


def weighted_schemes(spark, folder, names=None):
    names = names or MEMBERS
    wide = members(spark, folder) if names == MEMBERS else blends.member_table(member_forecasts(spark, folder), names)
    return blends.weighted_members(wide, blends.fold_weights(wide, base.folds(spark, folder), names), names)


@query("i21_composite_alternatives")
def composite_alternatives(spark, folder):
    """Equal, inverse-error, non-negative and best-single weights over all members, learnt week by week."""
    return arm_table(weighted_schemes(spark, folder, FITTED), "equal")


@query("k8_live_fit")
def live_fit(spark, folder):
    """Forecasts of contests without a result, from parameters fitted on all that is known and kept beside the inputs' stamp."""
    return live_forecasts(spark, folder).select("model", "game_id", *rs("home_pred", "away_pred", digits=4))


def upcoming(spark, folder):
    """The model table with the newest week's results taken away, and that week's fold."""
    table = base.model_table(spark, folder)
    newest = base.folds(spark, folder).agg(F.max("cutoff")).scalar()
    open_ = table.withColumns({f"{s}_score": F.when(F.col("t") < newest, F.col(f"{s}_score")) for s in ("home", "away")})
    return open_, base.folds(spark, folder).filter(F.col("cutoff") == newest)


def live_forecasts(spark, folder):
    table, fold = upcoming(spark, folder)
    stored = lambda name, build: base.keep(spark, folder, f"live_parameters:{name}", build)
    arms = {"ridge": Arm(FEATURES)}
    by_ridge = stored("ridge", lambda: gram.ridge_parameters(table, fold, arms, overtime_weights()))
    by_poisson = stored("poisson", lambda: glm.glm_parameters(table, fold, {"poisson": Arm(FEATURES)}, overtime_weights()))
    by_rules = stored("rules", lambda: rules.rule_parameters(table, fold))
    due = table.filter("home_score IS NULL")
    keep = ["game_id", "season", "week"]
    names = gram.used_features(arms)
    out = gram.ridge_predictions(due, by_ridge, names, keep).unionByName(glm.glm_predictions(due, by_poisson, names, keep))
    rows = ["model", *keep, "home_pred", "away_pred"]
    out = out.select(*rows).unionByName(rules.rule_predictions(due, by_rules).filter("model = 'baseline'").select(*rows))
    mean = out.groupBy(*keep).agg(*[F.avg(f"{s}_pred").alias(f"{s}_pred") for s in ("home", "away")]).withColumn("model", F.lit("composite"))
    return out.unionByName(mean.select(*rows))


# ------------------------------------------------------------------ arm comparisons


def arm_table(predictions, control):
    out = bs.compare_arms(ev.with_errors(predictions), control, replicates=REPS)
    return out.select("arm", "n_games", *rs("rmse", "delta", "lo", "hi", digits=5))


def sided(names):
    return [f"{s}_{n}" for s in ("home", "away") for n in names]


def arm_rows(spark, folder, table, arms):
    """The arms' shared table, written once: numbering, training and scoring all read it, and what it was joined from is not run again."""
    columns = [*KEEP, "went_to_ot", *gram.used_features(arms)]
    return base.keep(spark, folder, "arms:" + ",".join(columns), lambda: written(table.select(*columns), "arms"))


def compare(spark, folder, table, arms, control="control", weights=None):
    """One training pass and one scoring pass over the arms' shared table."""
    if table is not None:
        table = arm_rows(spark, folder, table, arms)
    return arm_table(ridge(spark, folder, arms, table, weights), control)


def compare_poisson(spark, folder, table, arms, control="control", weights=None):
    """The same comparison under the Poisson estimator: all arms share every Newton round."""
    return arm_table(glm_forecasts(spark, folder, arms, arm_rows(spark, folder, table, arms), weights), control)


def without(*parts):
    return [f for f in FEATURES if not any(p in f for p in parts)]


def entity_history(spark, folder, frame, measures, keys=("team",)):
    """Decayed history of entity-contest measures per (team, t), as `pregame_<m>`."""
    pairs = {f"pregame_{m}": (F.col(m).cast("double"), F.when(F.col(m).isNotNull(), F.lit(1.0))) for m in measures}
    return temporal.decayed_prior(frame, list(keys), "t", pairs, temporal.Exponential(HALFLIFE), mask=~base.finale())


def dated(spark, folder, frame):
    return frame.join(base.contests(spark, folder).select("game_id", "t", "season", "week"), "game_id")


MATCHUPS = [
    ("home_matchup", "home_pregame_off_epa_per_play", "away_pregame_def_epa_per_play"),
    ("away_matchup", "away_pregame_off_epa_per_play", "home_pregame_def_epa_per_play"),
]
CONTINUITY = ["roster_carryover", "lineup_stability", "snap_weighted_tenure"]


def relational_setup(spark, folder):
    table = assemble.interactions(base.model_table(spark, folder), MATCHUPS)
    rated = base.keep(spark, folder, "unit_ratings", lambda: written(unit_ratings(spark, folder), "unit_ratings"))
    squads = base.keep(spark, folder, "continuity", lambda: written(roster.continuity(base.lineups(spark, folder)), "continuity"))
    table = assemble.attach_sided(table, rated, ["season", "week"], ADJUSTED)
    table = assemble.attach_sided(table, squads, ["season", "t"], CONTINUITY)
    match, adjusted, kept = [m[0] for m in MATCHUPS], sided(ADJUSTED), sided(CONTINUITY)
    arms = {"control": [], "matchup": match, "adjusted": adjusted, "continuity": kept, "all": match + adjusted + kept}
    return table, {n: Arm(FEATURES + x) for n, x in arms.items()}


@query("j31_relational_arms")
def relational_arms(spark, folder):
    return compare(spark, folder, *relational_setup(spark, folder))


@query("j31_relational_poisson")
def relational_poisson(spark, folder):
    return compare_poisson(spark, folder, *relational_setup(spark, folder))


def rated_table(spark, folder):
    rated = two_way(spark, folder).select("season", "week", "team", "off", "def")
    return assemble.attach_sided(base.model_table(spark, folder), rated, ["season", "week"], ["off", "def"])


@query("j32_ratings_replace_raw")
def ratings_replace_raw(spark, folder):
    swapped = without("epa_per_play") + sided(["off", "def"])
    return compare(spark, folder, rated_table(spark, folder), {"control": Arm(FEATURES), "ratings": Arm(swapped), "both": Arm(FEATURES + sided(["off", "def"]))})


@query("j32_ratings_poisson")
def ratings_poisson(spark, folder):
    """The same arms under the Poisson estimator."""
    swapped = without("epa_per_play") + sided(["off", "def"])
    arms = {"control": Arm(FEATURES), "ratings": Arm(swapped), "both": Arm(FEATURES + sided(["off", "def"]))}
    return compare_poisson(spark, folder, rated_table(spark, folder), arms)


SWEEP_WEEKS = (4, 8, 12, 17, 26, 39, 52)


def halflife_refit(spark, folder):
    """Rule, ridge and Poisson forecasts refit on features decayed with each half-life, against the production half-life of the same model."""
    df = base.facts(spark, folder)
    pairs = {f"pregame_{m}": (F.col(m).cast("double"), F.when(F.col(m).isNotNull(), F.lit(1.0))) for m in MEASURES}
    names = [f"pregame_{m}" for m in MEASURES]
    bare = base.model_table(spark, folder).drop(*sided(names))
    forecasts = {"baseline": None, "ridge": None, "poisson": None}
    for weeks in SWEEP_WEEKS:
        mine = temporal.decayed_prior(df, ["team"], "t", pairs, temporal.Exponential(7.0 * weeks), mask=~base.finale()).select("team", "t", *names)
        table = base.keep(spark, folder, f"halflife_sweep:{weeks}", lambda mine=mine: written(assemble.attach_sided(bare, mine, ["t"], names), "halflife_table"))
        arm = {f"w{weeks}": Arm(FEATURES)}
        parts = {
            "baseline": rules.rule_predictions(table, rules.rule_parameters(table, base.folds(spark, folder))).filter("model = 'baseline'").withColumn("model", F.lit(f"w{weeks}")),
            "ridge": ridge(spark, folder, arm, table), "poisson": glm_forecasts(spark, folder, arm, table),
        }
        for family, part in parts.items():
            part = written(part.select("model", *KEEP, "home_pred", "away_pred"), "halflife_forecasts")
            forecasts[family] = part if forecasts[family] is None else forecasts[family].unionByName(part)
    out = None
    for family, rows in forecasts.items():
        compared = arm_table(rows, f"w{int(HALFLIFE / 7)}").select(F.lit(family).alias("family"), "*")
        out = compared if out is None else out.unionByName(compared)
    return out


TYPE_SPLIT = ["off_pass_epa_per_play", "off_rush_epa_per_play", "def_pass_epa_per_play_allowed", "def_rush_epa_per_play_allowed"]
ACCURACY = ["off_cpoe", "def_cpoe_allowed"]


@query("j33_type_split_arms")
def type_split_arms(spark, folder):
    hist = entity_history(spark, folder, base.facts(spark, folder), TYPE_SPLIT + ACCURACY)
    table = assemble.attach_sided(base.model_table(spark, folder), hist, ["t"], [f"pregame_{m}" for m in TYPE_SPLIT + ACCURACY])
    split, acc = sided([f"pregame_{m}" for m in TYPE_SPLIT]), sided([f"pregame_{m}" for m in ACCURACY])
    blend = without("epa_per_play")
    arms = {"control": FEATURES, "split": blend + split, "split_accuracy": blend + split + acc, "accuracy": FEATURES + acc}
    return compare(spark, folder, table, {n: Arm(f) for n, f in arms.items()})


@query("j34_shrunk_split_arms")
def shrunk_split_arms(spark, folder):
    cols = [f"{n}_shrunk" for n in SPLITS]
    table = assemble.attach_sided(
        base.model_table(spark, folder), split_features(spark, folder).select("game_id", "team", *cols), ["game_id"], cols
    )
    blend = without("epa_per_play")
    arms = {
        "control": Arm(FEATURES), "none": Arm(blend), "replace": Arm(blend + sided(cols)), "add": Arm(FEATURES + sided(cols)),
        "control_ols": Arm(FEATURES, alphas=(0.0,)), "replace_ols": Arm(blend + sided(cols), alphas=(0.0,)),
    }
    return compare(spark, folder, table, arms)


@query("j35_starter_history")
def starter_history(spark, folder):
    """History of the side's dominant actor: its own decayed rate and earlier starts."""
    counted = plays(spark, folder).filter("kind = 'A'").withColumn("actor", F.col("l_suppkey"))
    chosen = rollup.dominant_actor(counted, ["game_id", "posteam"], "actor", {"actor_epa": F.avg("epa")}).withColumnRenamed("posteam", "team")
    started = written(dated(spark, folder, chosen.select("game_id", "team", "actor", "actor_epa")), "starters")
    hist = temporal.prior_mean(started, ["actor"], "t", {"pregame_actor_epa": "actor_epa"}, temporal.Exponential(HALFLIFE))
    counts = prefix.prior_sums(started, ["actor"], "t", {"prior_starts": F.lit(1)})
    cols = ["pregame_actor_epa", "prior_starts"]
    table = assemble.attach_sided(base.model_table(spark, folder), hist.join(counts, ["actor", "t"]).select("game_id", "team", *cols), ["game_id"], cols)
    return compare(spark, folder, table, {"control": Arm(FEATURES), "starter": Arm(FEATURES + sided(cols))})


PACE = ["off_plays_per_drive", "off_dropback_rate", "off_pass_oe"]
DOUBT = ["off_epa_competitive", "def_epa_competitive"]
LUCK = ["off_fumble_retain_rate", "off_interceptions", "def_interceptions"]
KICKS = ["fg_pct", "fg_avg_distance"]


@query("j36_family_arms")
def family_arms(spark, folder):
    events = base.details(spark, folder)
    on = ["game_id", "team"]
    wide = dated(spark, folder, rollup.pace(events, parts_of(spark, folder, "lineitem")).join(rollup.families(events, "fg_result", "made", "qty"), on, "full_outer"))
    names = PACE + DOUBT + LUCK + KICKS
    hist = entity_history(spark, folder, written(wide, "families"), names)
    table = assemble.attach_sided(base.model_table(spark, folder), hist, ["t"], [f"pregame_{m}" for m in names])
    pre = lambda x: sided([f"pregame_{m}" for m in x])
    arms = {"control": [], "pace": pre(PACE), "competitive": pre(DOUBT), "turnover": pre(LUCK), "special": pre(KICKS), "all": pre(names)}
    return compare(spark, folder, table, {n: Arm(FEATURES + x) for n, x in arms.items()})


@query("j37_availability_arms")
def availability_arms(spark, folder):
    """Reports and appearances read from order lines of the contests themselves."""
    rows = plays(spark, folder).withColumn("player", F.col("l_suppkey") % 50).withColumn("kickoff", F.col("month").cast("timestamp"))
    p, s = F.col("player") % 6, F.col("l_linenumber") % 4
    position = F.when(p == 0, "QB").when(p == 1, "WR").when(p == 2, "CB").when(p == 3, "T").when(p == 4, "RB")
    status = F.when(s == 0, "Out").when(s == 1, "Questionable").when(s == 2, "Doubtful")
    reports = rows.filter("kind = 'N'").select(
        "game_id", F.col("posteam").alias("team"), "player", position.alias("position"), status.alias("report_status"),
        (F.col("kickoff") - F.expr("INTERVAL 1 DAY")).alias("date_modified"),
    )
    seen = rows.filter("kind = 'A'").select("game_id", F.col("posteam").alias("team"), "player", "kickoff", (F.col("qty") / 50).alias("role_share"))
    games = rollup.entity_rows(base.contests(spark, folder)).select(
        "game_id", "team", F.col("gameday").cast("timestamp").alias("kickoff"), F.lit(True).alias("played")
    )
    out = roster.availability(games, reports, seen)
    cols = ["injury_impact", "qb_out"]
    table = assemble.attach_sided(base.model_table(spark, folder), out, ["game_id"], cols)
    arms = {"control": [], "impact": sided(["injury_impact"]), "starter_out": sided(["qb_out"]), "both": sided(cols)}
    return compare(spark, folder, table, {n: Arm(FEATURES + x) for n, x in arms.items()})


@query("j38_schedule_context_arms")
def schedule_context_arms(spark, folder):
    df = base.facts(spark, folder)
    played = prefix.prior_sums(df, ["team", "season"], "t", {"prior_games_played": F.lit(1)})
    table = base.model_table(spark, folder).join(base.contests(spark, folder).select("game_id", "home_rest", "away_rest"), "game_id")
    table = assemble.attach_sided(table, played, ["season", "t"], ["prior_games_played"])
    plain = [f for f in FEATURES if f.startswith(("home_", "away_"))]
    weights = {**overtime_weights(), "drop_ot": rules.sample_weight(F.col("went_to_ot"), 0.0)}
    arms = {
        "control": Arm(FEATURES), "no_context": Arm(plain), "rest": Arm(FEATURES + sided(["rest"])), "counter": Arm(FEATURES + sided(["prior_games_played"])),
        "unweighted": Arm(FEATURES, weight=""), "drop_ot": Arm(FEATURES, weight="drop_ot"),
    }
    return compare(spark, folder, table, arms, weights=weights)


@query("j39_regularisation_arms")
def regularisation_arms(spark, folder):
    arms = {"control": Arm(FEATURES), "ols": Arm(FEATURES, alphas=(0.0,)), "fixed": Arm(FEATURES, alphas=(100.0,))}
    return compare(spark, folder, None, arms)


WEEKS = [104, 78, 52, 34, 17]


@query("j40_training_recency_arms")
def training_recency_arms(spark, folder):
    weights, arms = overtime_weights(), {"control": Arm(FEATURES)}
    for weeks in WEEKS:
        half = weeks * 7.0
        weights[f"h{weeks}"] = weights["w"] * temporal.growth(F.col("t").cast("double"), half, 0.0)
        arms[f"h{weeks}"] = Arm(FEATURES, weight=f"h{weeks}", halflife=half)
    return compare(spark, folder, None, arms, weights=weights)


@query("j41_drift_arms")
def drift_arms(spark, folder):
    arms = {"none": Arm(FEATURES, drift=0), "control": Arm(FEATURES), "k100": Arm(FEATURES, drift=100), "k570": Arm(FEATURES, drift=570)}
    return compare(spark, folder, None, arms)


EARLY_WEEKS, MIN_EARLY = 3, 150


@query("j41_early_season_offset", with_views("preds folds", f"""
WITH b AS (SELECT * FROM preds WHERE model = 'baseline'),
o AS (SELECT f.season, f.week, avg(x.home_pred - x.home_score) AS g, avg(x.home_pred - x.home_score) FILTER (x.week <= {EARLY_WEEKS}) AS e, count(*) FILTER (x.week <= {EARLY_WEEKS}) AS n
      FROM folds f JOIN b x ON x.t < f.cutoff GROUP BY ALL)
SELECT b.game_id, round(b.home_pred - CASE WHEN b.week <= {EARLY_WEEKS} AND n >= {MIN_EARLY} THEN e ELSE g END, 6) AS home_pred FROM b JOIN o USING (season, week)"""))
def early_season_offset(spark, folder):
    """Early weeks get the mean error of earlier early weeks once enough of them are known."""
    preds = base.predictions(spark, folder).filter("model = 'baseline'")
    err, early = F.col("home_pred") - F.col("home_score"), F.col("week") <= EARLY_WEEKS
    sums = {"g": err, "gn": F.lit(1), "e": F.when(early, err), "en": early.cast("int")}
    at = folds.training_sums(preds, base.folds(spark, folder).select("season", "week", "cutoff"), sums).filter("gn > 0")
    offset = F.when(early & (F.col("en") >= MIN_EARLY), sc.safe_div(F.col("e"), F.col("en"))).otherwise(F.col("g") / F.col("gn"))
    return preds.join(at, ["season", "week"]).select("game_id", r(F.col("home_pred") - offset).alias("home_pred"))


SUCCESS_ARMS = ["all_events", "production", "first_kind"]


@query("j42_event_filter_arms")
def event_filter_arms(spark, folder):
    """Success rate under three event filters, each carried through history and assembly."""
    df = plays(spark, folder).withColumn("team", F.col("posteam"))
    rates = dated(spark, folder, rollup.arm_rates(df, ["game_id", "team"], dict(zip(SUCCESS_ARMS, filter_predicates().values())), {"success": "success"}))
    names = [f"{a}_success" for a in SUCCESS_ARMS]
    hist = entity_history(spark, folder, rates, names)
    table = assemble.attach_sided(base.model_table(spark, folder), hist, ["t"], [f"pregame_{n}" for n in names])
    plain = without("off_success_rate")
    arms = {a: Arm(plain + sided([f"pregame_{a}_success"])) for a in SUCCESS_ARMS}
    return compare(spark, folder, table, arms, control="production")


START_SLOPE, START_SEGMENTS = -0.0355, 11.0


@query("j43_start_position_arm")
def start_position_arm(spark, folder):
    """The outcome model plus a start-position term: slope × (blended start - the fold's training mean) × segments."""
    per = starts(spark, folder)
    own = per.groupBy("game_id", F.col("posteam").alias("team")).agg(F.avg("start").alias("own_fp"))
    allowed = per.groupBy("game_id", F.col("defteam").alias("team")).agg(F.avg("start").alias("fp_allowed"))
    wide = dated(spark, folder, own.join(allowed, ["game_id", "team"], "full_outer"))
    pairs = {n: (F.col(n), F.when(F.col(n).isNotNull(), F.lit(1.0))) for n in ("own_fp", "fp_allowed")}
    hist = temporal.decayed_prior(wide, ["team"], "t", pairs, temporal.Exponential(HALFLIFE))
    c = F.col
    seg = segment_table(spark, folder)
    table = assemble.attach_sided(seg, hist, ["t"], ["own_fp", "fp_allowed"])
    sides = [c("home_own_fp"), c("away_own_fp")]
    total, count = sum(F.coalesce(x, F.lit(0.0)) for x in sides), sum(x.isNotNull().cast("int") for x in sides)
    trained = folds.training_sums(table, base.folds(spark, folder).select("season", "week", "cutoff"), {"s": total, "n": count})
    level = trained.select("season", "week", sc.safe_div(c("s"), c("n")).alias("level"))
    control = outcome_forecasts(spark, folder).drop("w").withColumn("model", F.lit("control"))
    keys = table.select("game_id", *[f"{s}_{n}" for s in ("home", "away") for n in ("own_fp", "fp_allowed")])
    joined = control.join(keys, "game_id").join(level, ["season", "week"], "left")
    start = lambda own, opp: F.coalesce((c(own) + c(opp)) / 2, c(own), c(opp), c("level"))
    shift = lambda own, opp: F.coalesce(START_SLOPE * (start(own, opp) - c("level")) * START_SEGMENTS, F.lit(0.0))
    moved = joined.withColumns({
        "home_pred": c("home_pred") + shift("home_own_fp", "away_fp_allowed"), "away_pred": c("away_pred") + shift("away_own_fp", "home_fp_allowed"),
        "model": F.lit("start_position"),
    }).select(*control.columns)
    return arm_table(control.unionByName(moved), "control")
