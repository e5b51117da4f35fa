"""Interpolation from k nearest neighbours, out of fold and nested, and residual models on top of it.

Neighbours come from the exact nearest-neighbour join; what is computed from them needs one row's neighbours only, so its
memory follows k. Folds are columns of that join (`apart`), not one search per fold.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from fluvia.lineage import cut
from fluvia.operators import boosting, models, spatial

#: Distances up to which two points are one place, in the unit of the coordinates.
SAME_PLACE = 1e-6
#: Systems of equations solved at once.
BATCH = 256


def weighted_idw(pairs: DataFrame, by: list[str], value: str, weight: str | None = None, power: float = 2.0, eps: float = SAME_PLACE) -> DataFrame:
    """(*by, predicted, n_neighbours): means of neighbours' values by weight / (distance + eps)^power.

    Neighbours at one place with the row (distance up to eps) decide alone, by their weights. Where the weights add up to
    nothing, or the mean is not a number, the plain mean of the neighbours counts. A null weight counts as 0.
    """
    c, w = F.col("distance_m"), F.lit(1.0) if weight is None else F.coalesce(F.col(weight).cast("double"), F.lit(0.0))
    y, near = F.col(value).cast("double"), F.col("distance_m") <= eps
    share = w / F.pow(c + eps, F.lit(power))

    def mean(share: Column, where: Column | None = None) -> Column:
        top, base = share * y, share
        if where is not None:
            top, base = F.when(where, top), F.when(where, base)
        out = F.when(F.sum(base) > 0, F.try_divide(F.sum(top), F.sum(base)))
        return F.when(~F.isnan(out) & (F.abs(out) < float("inf")), out)

    one = F.lit(1.0)
    same = F.coalesce(mean(w, near), mean(one, near))
    return pairs.groupBy(*by).agg(F.coalesce(same, mean(share), F.avg(y)).alias("predicted"), F.count("*").alias("n_neighbours"))


def thin_plate(pairs: DataFrame, by: list[str], value: str, xy: tuple[str, str] = ("x", "y"), rxy: tuple[str, str] = ("rx", "ry"), smoothing: float = 100.0, scale: float = 1000.0) -> DataFrame:
    """(*by, predicted, n_neighbours): a thin plate with a plane, smoothed, through each row's neighbours.

    Coordinates are divided by `scale` (metres to kilometres), so `smoothing` is in square kilometres. A row whose system
    has no single solution (fewer than three neighbours, or all in one line) gets null. `by` must name the row.
    """
    place = [(F.col(c) / scale).alias(n) for c, n in zip((*xy, *rxy), ("x", "y", "rx", "ry"))]
    grouped = pairs.select(*by, *place, F.col(value).cast("double").alias("v")).groupBy(*by)
    listed = grouped.agg(F.first("x").alias("x"), F.first("y").alias("y"), F.collect_list("rx").alias("rx"), F.collect_list("ry").alias("ry"), F.collect_list("v").alias("v"))
    fields = [listed.schema[c] for c in by]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in fields) + ", predicted double, n_neighbours bigint"

    def solved(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, y = (np.asarray(batch.column(c).to_numpy(zero_copy_only=False), float) for c in ("x", "y"))
            near = [[np.array(a, float) for a in batch.column(c).to_pylist()] for c in ("rx", "ry", "v")]
            sizes = np.array([len(a) for a in near[2]], np.int64)
            out = np.full(len(sizes), np.nan)
            for k in np.unique(sizes[sizes > 2]):
                rows = np.flatnonzero(sizes == k)
                for at in range(0, len(rows), BATCH):
                    part = rows[at : at + BATCH]
                    out[part] = plates(x[part], y[part], *(np.stack([a[i] for i in part]) for a in near), smoothing)
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in by], pa.array(out, pa.float64(), mask=np.isnan(out)), pa.array(sizes, pa.int64())], [*by, "predicted", "n_neighbours"])

    return listed.mapInArrow(solved, schema)


def plates(x: np.ndarray, y: np.ndarray, px: np.ndarray, py: np.ndarray, value: np.ndarray, smoothing: float) -> np.ndarray:
    """Values at (x, y) of one plate per row through its points (px, py); NaN where the system is singular."""
    n, k = px.shape

    def bent(dx: np.ndarray, dy: np.ndarray) -> np.ndarray:
        r2 = dx * dx + dy * dy
        return 0.5 * r2 * np.log(np.where(r2 > 0, r2, 1.0))

    # centred and scaled coordinates for the plane, so that it is as well conditioned far from the origin
    mx, my = px.mean(1, keepdims=True), py.mean(1, keepdims=True)
    size = np.maximum(np.ptp(px, 1), np.ptp(py, 1))[:, None]
    size = np.where(size > 0, size, 1.0)
    plane = np.stack([np.ones_like(px), (px - mx) / size, (py - my) / size], 2)
    left = np.zeros((n, k + 3, k + 3))
    left[:, :k, :k] = bent(px[:, :, None] - px[:, None, :], py[:, :, None] - py[:, None, :])
    left[:, np.arange(k), np.arange(k)] += smoothing
    left[:, :k, k:], left[:, k:, :k] = plane, plane.transpose(0, 2, 1)
    right = np.concatenate([value, np.zeros((n, 3))], 1)
    flat = np.linalg.matrix_rank(plane, tol=1e-9 * k) < 3
    if smoothing <= 0:  # two points at one place cannot both be met
        flat |= np.linalg.matrix_rank(left) < k + 3
    left[flat], right[flat] = np.eye(k + 3), np.nan
    weights = np.linalg.solve(left, right[:, :, None])[:, :, 0]
    asked = np.concatenate([bent(x[:, None] - px, y[:, None] - py), np.ones((n, 1)), (x[:, None] - mx) / size, (y[:, None] - my) / size], 1)
    return (weights * asked).sum(1)


def _interpolated(pairs: DataFrame, by: list[str], weight: str | None, method: str, **more) -> DataFrame:
    if method == "idw":
        return weighted_idw(pairs, by, "__v", weight and "__w", **more)
    return thin_plate(pairs, by, "__v", rxy=("__x", "__y"), **more)


def _teaching(rows: DataFrame, key: str, value: str, weight: str | None, *more: Column) -> DataFrame:
    named = [F.col(key).alias("__id"), F.col("x").alias("__x"), F.col("y").alias("__y"), F.col(value).cast("double").alias("__v"), (F.col(weight) if weight else F.lit(1.0)).cast("double").alias("__w")]
    return rows.where(f"`{value}` is not null and not isnan(`{value}`)").select(*named, *more)


def crossfit(rows: DataFrame, key: str, value: str, fold: str, k: int, weight: str | None = None, method: str = "idw", **more) -> DataFrame:
    """(key, predicted, n_neighbours): each row interpolated from the k nearest rows of other folds."""
    taught = _teaching(rows, key, value, weight, F.col(fold).alias("__fold"))
    pairs = spatial.nearest_k(rows.select(key, "x", "y", fold), taught, key, "__id", k, apart=(fold, "__fold"), rxy=("__x", "__y"))
    return _interpolated(pairs, [key], weight, method, **more)


def inner_folds(rows: DataFrame, fold: str, group: str, folds: int) -> DataFrame:
    """(outer, group, inner): for each outer fold the groups outside it, dealt to inner folds by falling size. An outer
    fold with a single group outside has inner fold null."""
    parts = None
    for r in rows.select(fold).where(F.col(fold).isNotNull()).distinct().orderBy(fold).collect():  # as many as there are folds
        left = rows.where(F.col(fold) != r[0])
        dealt = models.balanced_folds(left, group, folds)
        several = left.select(group).distinct().limit(2).count() > 1
        part = dealt.select(F.lit(r[0]).alias("outer"), group, (F.col("fold") if several else F.lit(None).cast("int")).alias("inner"))
        parts = part if parts is None else parts.unionByName(part)
    return parts


def nested(rows: DataFrame, key: str, value: str, fold: str, group: str, k: int, folds: int = 5, weight: str | None = None, method: str = "idw", **more) -> DataFrame:
    """(outer, key, predicted): for each outer fold, rows outside it interpolated from rows that are neither in it nor in
    their own inner fold. Where an outer fold leaves one group only, its rows are interpolated from all of themselves."""
    inner = cut(inner_folds(rows, fold, group, folds))
    # a group may lie in several folds only if folds are not by group; rows of the outer fold are out either way
    each = rows.join(inner, group).where(F.col(fold) != F.col("outer"))
    each = cut(each.withColumn("__row", F.struct(F.col("outer"), F.col(key).alias("id"))))
    asking = each.select("__row", "outer", "x", "y", F.coalesce("inner", F.lit(-1)).alias("inner"))
    taught = _teaching(each, key, value, weight, F.col("outer"), F.coalesce("inner", F.lit(-2)).alias("__inner"))
    pairs = spatial.nearest_k(asking, taught, "__row", "__id", k, on=["outer"], apart=("inner", "__inner"), rxy=("__x", "__y"))
    return _interpolated(pairs, ["__row"], weight, method, **more).select(F.col("__row.outer").alias("outer"), F.col("__row.id").alias(key), "predicted")


def prior_features(rows: DataFrame, prior: str = "prior") -> DataFrame:
    """Adds what a residual model may know of a prior water table: depth, height above ground, and how the shallow model
    (fac_wte_m, fac_dtw_m) departs from it."""
    depth = F.greatest(F.col("dem_m") - F.col(prior), F.lit(0.0))
    return rows.withColumns(
        {
            "prior_dtw": depth,
            "prior_head_above_ground_m": F.greatest(F.col(prior) - F.col("dem_m"), F.lit(0.0)),
            "fac_minus_prior_wte": F.col("fac_wte_m") - F.col(prior),
            "fac_minus_prior_dtw": F.col("fac_dtw_m") - depth,
        }
    )


PRIOR_FEATURES = ["prior_dtw", "prior_head_above_ground_m", "fac_minus_prior_wte", "fac_minus_prior_dtw"]


def nested_residuals(rows: DataFrame, key: str, fold: str, group: str, static: list[str], k: int, weight: str | None = None, method: str = "idw", shape: boosting.Shape = boosting.Shape(), folds: int = 5, **more) -> DataFrame:
    """(key, fold, prior, residual, residual_hat, hybrid_wte, hybrid_dtw): a residual model that has not seen its labels.

    The prior of a row comes from other folds. The model for a fold learns on rows outside it, whose priors and residuals
    come from inner folds within those rows only; so no label of a fold has a part in its predictions, be it through the
    prior, the features or the target. rows: obs_wte_m, dem_m, fac_wte_m, fac_dtw_m, x, y, and the static features.
    A row without a prior gets none of the rest.
    """
    outside = crossfit(rows, key, "obs_wte_m", fold, k, weight, method, **more).select(key, F.col("predicted").alias("prior"))
    test = prior_features(rows.join(outside, key)).withColumn("__model", F.col(fold).cast("string"))
    within = nested(rows, key, "obs_wte_m", fold, group, k, folds, weight, method, **more).withColumnRenamed("predicted", "prior")
    train = prior_features(rows.join(within, key)).withColumns({"__model": F.col("outer").cast("string"), "__label": F.col("obs_wte_m") - F.col("prior"), "__weight": (F.col(weight) if weight else F.lit(1.0)).cast("double")})
    told = boosting.predictions(train, test, key, [*static, *PRIOR_FEATURES], shape, False).select(key, F.col("prediction").alias("residual_hat"))
    out = test.select(key, fold, "prior", (F.col("obs_wte_m") - F.col("prior")).alias("residual"), "dem_m").join(told, key, "left")
    hybrid = F.col("prior") + F.col("residual_hat")
    out = rows.select(key).join(out, key, "left").withColumn("hybrid_wte", hybrid)
    return out.withColumn("hybrid_dtw", F.when(F.col("hybrid_wte").isNotNull(), F.greatest(F.col("dem_m") - F.col("hybrid_wte"), F.lit(0.0)))).drop("dem_m")


# How methods are named, and the ladder of methods tried when none are given.
_IDW_NAME, _PLATE_NAME = "idw_k{k}_p{power}", "rbf_tps_s{smoothing}"
LADDER_K, LADDER_POWER, LADDER_SMOOTHING = (16, 32, 64), (2.0,), (25.0, 100.0, 400.0)


class Method(NamedTuple):
    """An interpolator by its name: k neighbours, and a power (idw) or a smoothing (thin_plate)."""

    name: str
    family: str
    k: int
    power: float | None = None
    smoothing: float | None = None


def idw_method(k: int, power: float) -> Method:
    """Powers are named without their point: 2 for 2.0, 15 for 1.5."""
    tag = str(int(power)) if float(power).is_integer() else str(power).replace(".", "")
    return Method(_IDW_NAME.format(k=k, power=tag), "idw", k, power=float(power))


def plate_method(smoothing: float, k: int = 32) -> Method:
    return Method(_PLATE_NAME.format(smoothing=int(smoothing)), "thin_plate", k, smoothing=float(smoothing))


def parsed_method(name: str) -> Method | None:
    """The method of a name, or None. Smoothings may also be written `smooth100`."""
    parts = name.split("_")
    try:
        if parts[0] == "idw" and len(parts) == 3:
            tag = parts[2].removeprefix("p")
            return idw_method(int(parts[1].removeprefix("k")), float(tag) if len(tag) < 2 else float(tag) / 10)
        if parts[:2] == ["rbf", "tps"] and len(parts) == 3:
            return plate_method(float(parts[2].removeprefix("smooth").removeprefix("s")))
    except ValueError:
        pass
    return None


def method_grid(names: list[str] | None = None, families: tuple[str, ...] = ("idw", "thin_plate"), ks=LADDER_K, powers=LADDER_POWER, smoothings=LADDER_SMOOTHING) -> list[Method]:
    """The named methods, those that cannot be read left out; without any, all of the families' parameters."""
    named = [m for m in map(parsed_method, names or []) if m]
    if named:
        return named
    out = [idw_method(k, p) for k in ks for p in powers] if "idw" in families else []
    return out + ([plate_method(s) for s in smoothings] if "thin_plate" in families else [])


def crossfit_methods(rows: DataFrame, key: str, value: str, fold: str, methods: list[Method], weight: str | None = None) -> DataFrame:
    """(key, method, predicted): every row by every method from rows of other folds. Neighbours are looked for once, as many
    as the widest method wants; the others take the first of them."""
    taught = _teaching(rows, key, value, weight, F.col(fold).alias("__fold"))
    most = max(m.k for m in methods)
    pairs = cut(spatial.nearest_k(rows.select(key, "x", "y", fold), taught, key, "__id", most, apart=(fold, "__fold"), rxy=("__x", "__y")))
    out = None
    for m in methods:
        near = pairs.where(F.col("rank") <= m.k)
        told = _interpolated(near, [key], weight, "idw", power=m.power) if m.family == "idw" else _interpolated(near, [key], weight, "thin_plate", smoothing=m.smoothing)
        part = told.select(key, F.lit(m.name).alias("method"), "predicted")
        out = part if out is None else out.unionByName(part)
    return out


def diagnostics(rows: DataFrame, predicted: DataFrame, key: str) -> DataFrame:
    """(key, method, wte, dtw_raw, dtw, head_above_ground_m, residual_wte, residual_dtw, fac_minus_wte, fac_minus_dtw) of each
    method's water table. rows: obs_wte_m, target_dtw_m, dem_m, fac_wte_m, fac_dtw_m."""
    c, zero = F.col, F.lit(0.0)
    both = predicted.join(rows.select(key, "obs_wte_m", "target_dtw_m", "dem_m", "fac_wte_m", "fac_dtw_m"), key)
    raw = c("dem_m") - c("predicted")
    # a missing prediction is missing throughout
    dtw = F.when(raw.isNotNull(), F.greatest(raw, zero))
    above = F.when(raw.isNotNull(), F.greatest(-raw, zero))
    return both.select(key, "method", c("predicted").alias("wte"), raw.alias("dtw_raw"), dtw.alias("dtw"), above.alias("head_above_ground_m"), (c("obs_wte_m") - c("predicted")).alias("residual_wte"), (c("target_dtw_m") - dtw).alias("residual_dtw"), (c("fac_wte_m") - c("predicted")).alias("fac_minus_wte"), (c("fac_dtw_m") - dtw).alias("fac_minus_dtw"))
