"""Queries on folds, grids and models."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from fluvia.operators import boosting, interpolation, models, spatial
from fluvia.operators.stats import standard_scores
from fluvia.plans.registry import query
from fluvia.plans.wells import _PREDICTED, predicted
from fluvia.sources.tables import view


def _training(spark: SparkSession, sf_dir: str) -> DataFrame:
    return predicted(spark, sf_dir).select("well_id", "fold", "obs_dtw", "p1", "p2", (F.col("x") / 1000).alias("x"), (F.col("y") / 1000).alias("y"))


@query("fx_wells", "SELECT CAST(floor(x / 2000) AS BIGINT) AS block, count(*) AS n FROM fx_wells GROUP BY 1")
def block_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows per block, from which folds are balanced."""
    return view(spark, sf_dir, "fx_wells").groupBy(F.floor(F.col("x") / 2000).alias("block")).agg(F.count("*").alias("n"))


@query()
def balanced_folds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Greedy folds and what they hold; the greedy loop is not SQL."""
    rows = view(spark, sf_dir, "fx_wells").withColumn("block", F.floor(F.col("x") / 2000))
    return rows.drop("fold").join(models.balanced_folds(rows, "block", 4), "block").groupBy("fold").agg(F.count("*").alias("n"), F.count_distinct("block").alias("n_blocks"))


@query(
    "fx_wells",
    "b AS (SELECT CAST(floor(x / 2000) AS BIGINT) AS block, count(*) AS n FROM fx_wells GROUP BY 1), c AS (SELECT block, sum(n) OVER (ORDER BY (block * 7919 + 7) % 10007, block) - n AS before, sum(n) OVER () AS total FROM b) SELECT block, before < 0.3 * total AS held_out FROM c",
)
def holdout_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = view(spark, sf_dir, "fx_wells").withColumn("block", F.floor(F.col("x") / 2000))
    return models.holdout_blocks(rows, "block", 0.3)


@query(
    "fx_wells",
    _PREDICTED
    + ", g AS (SELECT unnest([5.0, 10.0, 20.0, 40.0]) AS scale), e AS (SELECT scale, wt, abs(exp(-greatest(obs_dtw, 0) / scale) * p1 + (1 - exp(-greatest(obs_dtw, 0) / scale)) * p2 - obs_dtw) AS e FROM w, g WHERE p2 IS NOT NULL) SELECT CAST(scale AS DOUBLE) AS scale, round(sum(wt * e) / sum(wt), 6) AS wmad FROM e GROUP BY 1",
)
def gate_scale_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = predicted(spark, sf_dir).where("p2 is not null").select(F.col("obs_dtw").alias("height"), F.col("p1").alias("near"), F.col("p2").alias("far"), F.col("obs_dtw").alias("observed"), "wt")
    return models.best_gate_scale(rows, [5.0, 10.0, 20.0, 40.0]).withColumn("wmad", F.round("wmad", 6))


@query("fx_wells", _PREDICTED + " SELECT fold, count(p2) AS n, round(regr_slope(obs_dtw, p2), 6) AS slope, round(regr_intercept(obs_dtw, p2), 6) AS intercept, round(regr_r2(obs_dtw, p2), 6) AS r2 FROM w GROUP BY fold")
def line_fits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return predicted(spark, sf_dir).groupBy("fold").agg(F.count("p2").alias("n"), F.round(F.regr_slope("obs_dtw", "p2"), 6).alias("slope"), F.round(F.regr_intercept("obs_dtw", "p2"), 6).alias("intercept"), F.round(F.regr_r2("obs_dtw", "p2"), 6).alias("r2"))


@query()
def kmeans_sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = standard_scores(view(spark, sf_dir, "fx_points").select("point_id", "rem_at_sample", "dist_perennial_m", "dist_field_edge_m"), ["rem_at_sample", "dist_perennial_m", "dist_field_edge_m"])
    return models.clusters(rows, ["rem_at_sample", "dist_perennial_m", "dist_field_edge_m"], 5)


@query()
def gaussian_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = standard_scores(view(spark, sf_dir, "fx_points").select("point_id", "rem_at_sample", "dist_perennial_m"), ["rem_at_sample", "dist_perennial_m"])
    return models.mixture(rows, ["rem_at_sample", "dist_perennial_m"], "point_id", 3)


@query()
def boosted_out_of_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    return models.out_of_fold(_training(spark, sf_dir), ["p1", "p2", "x", "y"], "obs_dtw", "boosted", [0, 1, 2, 3])


@query()
def ridge_out_of_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    return models.out_of_fold(_training(spark, sf_dir), ["p1", "p2", "x", "y"], "obs_dtw", "ridge", [0, 1, 2, 3])


@query()
def isotonic_out_of_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    return models.out_of_fold(_training(spark, sf_dir), ["p1"], "obs_dtw", "isotonic", [0, 1, 2, 3])


@query()
def permutation_importance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return models.permutation_importance(_training(spark, sf_dir), ["p1", "x", "y"], "obs_dtw")


@query("fx_wells", "b AS (SELECT DISTINCT CAST(floor(x / 2000) AS BIGINT) AS block FROM fx_wells) SELECT count(*) AS n_blocks, 4::BIGINT AS n_folds, CAST(ceil(count(*) / 4) AS BIGINT) AS most, CAST(floor(count(*) / 4) AS BIGINT) AS least FROM b")
def round_robin_folds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Blocks dealt to folds in turn, in a seeded order: how many folds, and the most and fewest blocks of one."""
    folds = models.round_robin_folds(view(spark, sf_dir, "fx_wells").withColumn("block", F.floor(F.col("x") / 2000)), "block", 4)
    sizes = folds.groupBy("fold").agg(F.count("*").alias("n"))
    return sizes.agg(F.sum("n").alias("n_blocks"), F.count("*").alias("n_folds"), F.max("n").alias("most"), F.min("n").alias("least"))


_AWAY = "sqrt((a.x-b.x)*(a.x-b.x)+(a.y-b.y)*(a.y-b.y))"


@query(
    "fx_wells fx_points",
    f"""k AS (SELECT a.point_id, b.obs_dtw AS v, CAST(b.well_id % 4 AS DOUBLE) / 2 AS w, {_AWAY} AS d, row_number() OVER (PARTITION BY a.point_id ORDER BY {_AWAY}, b.well_id) AS i FROM fx_points a JOIN fx_wells b ON true),
    g AS (SELECT point_id, count(*) AS n_neighbours, avg(v) AS plain, avg(v) FILTER (WHERE d <= 1e-6) AS same, sum(w) FILTER (WHERE d <= 1e-6) AS same_w, sum(w * v) FILTER (WHERE d <= 1e-6) AS same_v,
      sum(w / pow(d + 1e-6, 2)) AS all_w, sum(w / pow(d + 1e-6, 2) * v) AS all_v FROM k WHERE i <= 5 GROUP BY 1)
    SELECT point_id, n_neighbours, round(coalesce(CASE WHEN same_w > 0 THEN same_v / same_w END, same, CASE WHEN all_w > 0 THEN all_v / all_w END, plain), 6) AS predicted FROM g""",
)
def weighted_interpolation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every point from its five nearest wells, by distance and the wells' weights, a fourth of which are 0."""
    taught = view(spark, sf_dir, "fx_wells").select(F.col("well_id").alias("r_id"), F.col("x").alias("rx"), F.col("y").alias("ry"), F.col("obs_dtw").alias("v"), ((F.col("well_id") % 4).cast("double") / 2).alias("w"))
    near = spatial.nearest_k(view(spark, sf_dir, "fx_points").select("point_id", "x", "y"), taught, "point_id", "r_id", 5)
    return interpolation.weighted_idw(near, ["point_id"], "v", "w").withColumn("predicted", F.round("predicted", 6))


@query()
def thin_plate_crossfit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every well by a thin plate through its 16 nearest of other folds; a solve per well is not SQL."""
    return interpolation.crossfit(view(spark, sf_dir, "fx_wells"), "well_id", "obs_dtw", "fold", 16, method="thin_plate")


def _blocked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Wells with a water table under a plane of ground, and what a shallow model says of it."""
    c = F.col
    rows = view(spark, sf_dir, "fx_wells").withColumns({"block": F.floor(c("x") / 4000) * 10 + F.floor(c("y") / 4000), "dem_m": 900 + c("x") / 200 + (c("well_id") * 31 % 50), "wt": (c("well_id") % 3 + 1).cast("double")})
    rows = rows.withColumns({"fold": F.pmod(c("block"), F.lit(4)).cast("int"), "obs_wte_m": c("dem_m") - c("obs_dtw"), "fac_dtw_m": c("obs_dtw") * 0.7 + (c("well_id") * 13 % 20)})
    return rows.withColumn("fac_wte_m", c("dem_m") - c("fac_dtw_m"))


@query()
def block_out_boosting(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every well by boosted histograms of the other blocks' wells, beside random folds' predictions."""
    rows = _blocked(spark, sf_dir)
    features = ["fac_dtw_m", "dem_m", "x", "y"]
    blocked = boosting.leave_one_block_out(rows, "well_id", "block", features, "obs_dtw", "wt", 5)
    dealt = boosting.random_folds(rows.drop("fold"), "well_id", 5)
    random = boosting.leave_one_block_out(dealt, "well_id", "fold", features, "obs_dtw", "wt", 1)
    return blocked.join(random.select("well_id", "fold", F.col("prediction").alias("random_prediction")), "well_id")


@query()
def nested_residual_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every well's regional prior, and what a residual model adds that has seen none of its fold's labels."""
    return interpolation.nested_residuals(_blocked(spark, sf_dir), "well_id", "fold", "block", ["fac_dtw_m", "x", "y"], 8, "wt")


_DIAGNOSED = "round(wte, 6) AS wte, round(dem_m - wte, 6) AS dtw_raw, round(greatest(dem_m - wte, 0), 6) AS dtw, round(greatest(wte - dem_m, 0), 6) AS head_above_ground_m, round(obs_wte_m - wte, 6) AS residual_wte, round(obs_dtw - greatest(dem_m - wte, 0), 6) AS residual_dtw, round(fac_wte_m - wte, 6) AS fac_minus_wte, round(fac_dtw_m - greatest(dem_m - wte, 0), 6) AS fac_minus_dtw"


@query(
    "fx_wells",
    f"""b AS (SELECT well_id, x, y, obs_dtw, CAST(floor(x / 4000) * 10 + floor(y / 4000) AS BIGINT) % 4 AS fold, 900 + x / 200 + well_id * 31 % 50 AS dem_m, CAST(well_id % 3 + 1 AS DOUBLE) AS wt, obs_dtw * 0.7 + well_id * 13 % 20 AS fac_dtw_m FROM fx_wells),
    w AS (SELECT *, dem_m - obs_dtw AS obs_wte_m, dem_m - fac_dtw_m AS fac_wte_m FROM b),
    k AS (SELECT a.well_id, b.obs_wte_m AS v, b.wt, {_AWAY} AS d, row_number() OVER (PARTITION BY a.well_id ORDER BY {_AWAY}, b.well_id) AS i FROM w a JOIN w b ON a.fold <> b.fold),
    m AS (SELECT unnest(['idw_k16_p2', 'idw_k4_p15']) AS method, unnest([16, 4]) AS k, unnest([2.0, 1.5]) AS p),
    p AS (SELECT well_id, method, coalesce(sum(wt * v) FILTER (WHERE d <= 1e-6) / sum(wt) FILTER (WHERE d <= 1e-6), sum(wt / pow(d + 1e-6, p) * v) / sum(wt / pow(d + 1e-6, p))) AS wte FROM k JOIN m ON k.i <= m.k GROUP BY 1, 2)
    SELECT well_id, method, {_DIAGNOSED} FROM p JOIN w USING (well_id)""",
)
def method_diagnostics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every well's water table by each of several named methods, out of fold, and what it says of depths and residuals."""
    rows = _blocked(spark, sf_dir).withColumn("target_dtw_m", F.col("obs_dtw"))
    methods = interpolation.method_grid(["idw_k16_p2", "idw_k4_p15", "no_such_method"])
    out = interpolation.diagnostics(rows, interpolation.crossfit_methods(rows, "well_id", "obs_wte_m", "fold", methods, "wt"), "well_id")
    return out.select("well_id", "method", *[F.round(c, 6).alias(c) for c in out.columns if c not in ("well_id", "method")])
