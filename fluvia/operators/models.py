"""Folds, grids, line fits and models under blocked cross-validation."""

from __future__ import annotations

import numpy as np
from pyspark.ml.clustering import GaussianMixture, KMeans
from pyspark.ml.evaluation import ClusteringEvaluator
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import GBTRegressor, IsotonicRegression, LinearRegression
from pyspark.sql import DataFrame, Window, functions as F

from fluvia.lineage import cut


def balanced_folds(rows: DataFrame, group: str, folds: int) -> DataFrame:
    """(group, fold): groups by falling size (then name), each to the fold with fewest rows so far. Only the groups' counts
    reach the driver; the map goes back as a small table."""
    counts = rows.groupBy(group).count().orderBy(F.desc("count"), group).collect()
    load, out = [0] * folds, []
    for row in counts:
        k = min(range(folds), key=lambda i: (load[i], i))
        load[k] += row["count"]
        out.append((row[group], k))
    return rows.sparkSession.createDataFrame(out, f"{group} {dict(rows.dtypes)[group]}, fold int")


def holdout_blocks(rows: DataFrame, group: str, share: float, seed: int = 7) -> DataFrame:
    """(group, held_out): whole blocks, in the order of a hash, until they hold the share of all rows. Windows run over the
    blocks' counts, not over the rows."""
    counts = rows.groupBy(group).agg(F.count("*").alias("n"))
    order = Window.orderBy(F.pmod(F.col(group).cast("long") * 7919 + seed, F.lit(10_007)), group)
    before = F.sum("n").over(order) - F.col("n")
    total = F.sum("n").over(Window.partitionBy(F.lit(0)))
    return counts.select(group, (before < share * total).alias("held_out"))


def best_gate_scale(rows: DataFrame, scales: list[float]) -> DataFrame:
    """The scale (of a list) with the least weighted absolute error of the gated blend. rows: height, near, far, observed, wt."""
    grid = rows.sparkSession.createDataFrame([(float(s),) for s in scales], "scale double")
    share = F.exp(-F.greatest("height", F.lit(0.0)) / F.col("scale"))
    error = F.abs(share * F.col("near") + (1 - share) * F.col("far") - F.col("observed"))
    scored = rows.crossJoin(F.broadcast(grid)).groupBy("scale").agg((F.sum(F.col("wt") * error) / F.sum("wt")).alias("wmad"))
    return scored


def assembled(rows: DataFrame, columns: list[str]) -> DataFrame:
    """Adds the features vector; a gap takes the column's median, and a flag column says so."""
    medians = rows.agg(*[F.median(c).alias(f"__m_{c}") for c in columns])
    filled = rows.crossJoin(F.broadcast(medians))
    for c in columns:
        filled = filled.withColumn(f"{c}_gap", F.col(c).isNull().cast("double")).withColumn(c, F.coalesce(c, f"__m_{c}", F.lit(0.0)))
    return VectorAssembler(inputCols=[*columns, *[f"{c}_gap" for c in columns]], outputCol="features").transform(filled.drop(*[f"__m_{c}" for c in columns]))


def clusters(rows: DataFrame, columns: list[str], most: int = 6, seed: int = 7) -> DataFrame:
    """k, inertia, silhouette and Davies-Bouldin index of k-means for k from 2 on."""
    data = VectorAssembler(inputCols=columns, outputCol="features").transform(rows).persist()
    out = []
    for k in range(2, most + 1):
        model = KMeans(k=k, seed=seed).fit(data)
        labelled = model.transform(data)
        centres = [[float(v) for v in c] for c in model.clusterCenters()]
        to_centre = F.sqrt(sum((F.col(c) - F.element_at(F.array(*[F.lit(x[i]) for x in centres]), F.col("prediction") + 1)) ** 2 for i, c in enumerate(columns)))
        spread = {r["prediction"]: r["s"] for r in labelled.groupBy("prediction").agg(F.avg(to_centre).alias("s")).collect()}
        gap = lambda a, b: sum((x - y) ** 2 for x, y in zip(centres[a], centres[b])) ** 0.5
        present = sorted(spread)
        db = sum(max((spread[a] + spread[b]) / max(gap(a, b), 1e-12) for b in present if b != a) for a in present) / len(present) if len(present) > 1 else None
        out.append((k, float(model.summary.trainingCost), float(ClusteringEvaluator().evaluate(labelled)), db))
    data.unpersist()
    return rows.sparkSession.createDataFrame(out, "k int, inertia double, silhouette double, davies_bouldin double")


def mixture(rows: DataFrame, columns: list[str], key: str, k: int, seed: int = 7) -> DataFrame:
    """(key, component, probability) of a Gaussian mixture with full covariances."""
    data = VectorAssembler(inputCols=columns, outputCol="features").transform(rows)
    out = GaussianMixture(k=k, seed=seed).fit(data).transform(data)
    from pyspark.ml.functions import vector_to_array

    return out.select(key, F.col("prediction").alias("component"), F.array_max(vector_to_array("probability")).alias("probability"))


def out_of_fold(rows: DataFrame, columns: list[str], target: str, kind: str, folds: list[int]) -> DataFrame:
    """Predictions of each fold by a model fitted on the others. kind: boosted, ridge or isotonic (on the first column)."""
    if kind == "ridge":
        return ridge_out_of_fold(rows, columns, target)
    data = cut(assembled(rows, columns))
    parts = []
    for fold in folds:
        train, test = data.where(F.col("fold") != fold), data.where(F.col("fold") == fold)
        if kind == "boosted":
            model = GBTRegressor(featuresCol="features", labelCol=target, maxIter=12, maxDepth=3, lossType="absolute", seed=7).fit(train)
        elif train.count() >= 50:
            model = IsotonicRegression(featuresCol="features", labelCol=target, featureIndex=0).fit(train)
        else:  # too few rows to calibrate
            parts.append(test.select("well_id", "fold", target, F.col(columns[0]).alias("prediction")))
            continue
        parts.append(model.transform(test).select("well_id", "fold", target, "prediction"))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def ridge_out_of_fold(rows: DataFrame, columns: list[str], target: str, alpha: float = 1.0) -> DataFrame:
    """Predictions of each fold by least squares with a penalty of alpha times the squared weights, fitted on the other
    folds, with an intercept that is not penalised. Features are not scaled; a gap takes the column's median and has a
    flag of its own. Spark sums the products of columns by fold in one pass; what reaches the driver are these sums, as
    many as there are pairs of columns."""
    gaps = [f"{c}_gap" for c in columns]
    names = [*columns, *gaps]
    data = assembled(rows, columns).where(F.col(target).isNotNull())
    pairs = [(a, b) for i, a in enumerate(["1", *names, target]) for b in ["1", *names, target][i:]]
    value = lambda c: F.lit(1.0) if c == "1" else F.col(c)
    sums = {r["fold"]: np.array(r[1:]) for r in data.groupBy("fold").agg(*[F.sum(value(a) * value(b)).cast("double").alias(f"s{i}") for i, (a, b) in enumerate(pairs)]).collect()}
    size = len(names) + 2
    fitted = []
    for fold in sums:
        total = sum((v for k, v in sums.items() if k != fold), np.zeros(len(pairs)))
        moments = np.zeros((size, size))
        for (i, j), v in zip([(i, j) for i in range(size) for j in range(i, size)], total):
            moments[i, j] = moments[j, i] = v
        if not moments[0, 0]:
            continue
        mean = moments[0] / moments[0, 0]
        centred = moments - moments[0, 0] * np.outer(mean, mean)
        weights = np.linalg.solve(centred[1:-1, 1:-1] + alpha * np.eye(len(names)), centred[1:-1, -1])
        fitted.append((fold, float(mean[-1] - weights @ mean[1:-1]), [float(w) for w in weights]))
    models = rows.sparkSession.createDataFrame(fitted, f"fold {dict(rows.dtypes)['fold']}, __b double, __w array<double>")
    terms = [F.element_at("__w", i + 1) * F.col(c) for i, c in enumerate(names)]
    return data.join(F.broadcast(models), "fold").withColumn("prediction", sum(terms, F.col("__b"))).select("well_id", "fold", target, "prediction")


def round_robin_folds(rows: DataFrame, group: str, folds: int, seed: int = 7) -> DataFrame:
    """(group, fold): groups in the order of a hash, dealt to the folds in turn. Windows run over the groups, not the rows."""
    order = Window.orderBy(F.xxhash64(F.col(group), F.lit(seed)), group)
    return rows.select(group).distinct().withColumn("fold", ((F.row_number().over(order) - 1) % folds).cast("int"))


def permutation_importance(rows: DataFrame, columns: list[str], target: str, seed: int = 7) -> DataFrame:
    """(feature, increase): growth of the mean absolute error of a linear model when a feature's values change places."""
    data = assembled(rows, columns)
    model = LinearRegression(featuresCol="features", labelCol=target).fit(data)
    base = model.transform(data).agg(F.avg(F.abs(F.col("prediction") - F.col(target))).alias("e")).first()["e"]
    order = rows.sparkSession.createDataFrame([(c,) for c in columns], "feature string")
    out = []
    plain = rows.select(*[c for c in rows.columns if c not in columns], *columns)
    for c in columns:
        # the k-th row by one hash gets the value of the k-th row by another, within blocks of ids
        block = F.pmod(F.xxhash64("well_id"), F.lit(16))
        a = plain.withColumn("__b", block).withColumn("__k", F.row_number().over(Window.partitionBy("__b").orderBy(F.xxhash64(F.lit(seed), "well_id"))))
        b = plain.select(block.alias("__b"), F.row_number().over(Window.partitionBy(block).orderBy(F.xxhash64(F.lit(seed + 1), "well_id"))).alias("__k"), F.col(c).alias("__v"))
        mixed = assembled(a.join(b, ["__b", "__k"]).drop(c).withColumnRenamed("__v", c), columns)
        error = model.transform(mixed).agg(F.avg(F.abs(F.col("prediction") - F.col(target))).alias("e")).first()["e"]
        out.append((c, float(error - base)))
    return order.join(rows.sparkSession.createDataFrame(out, "feature string, increase double"), "feature")
