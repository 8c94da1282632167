"""The small learned parts: projection, legibility, the re-ranker, and a learned bilinear metric."""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.evaluation import ClusteringEvaluator
from pyspark.ml.feature import PCA
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import vectors as V


@dataclass
class Projection:
    """A frozen linear projection: (x - mean) times the rows of ``components``. Its identity is the hash of its numbers."""

    mean: np.ndarray
    components: np.ndarray

    @property
    def identity(self) -> str:
        return hashlib.sha256(b"".join(np.ascontiguousarray(x, "<f8").tobytes() for x in (self.mean, self.components))).hexdigest()

    def write(self, spark: SparkSession, path: str) -> None:
        row = [(self.mean.tolist(), self.components.tolist(), self.identity)]
        spark.createDataFrame(row, "mean array<double>, components array<array<double>>, identity string").coalesce(1).write.mode("errorifexists").parquet(path)

    @classmethod
    def read(cls, spark: SparkSession, path: str) -> Projection:
        row = spark.read.parquet(path).first()
        model = cls(np.array(row["mean"]), np.array(row["components"]))
        if model.identity != row["identity"]:
            raise ValueError(f"{path}: the numbers are not those of {row['identity']}")
        return model


def fit_pca(df: DataFrame, vector: str, k: int, mask: Column | None = None) -> Projection:
    """Mean and components of the rows that ``mask`` keeps; the largest loading of each component is positive."""
    rows = df if mask is None else df.where(mask)
    model = PCA(k=k, inputCol="_x", outputCol="_y").fit(rows.select(array_to_vector(V.as_doubles(F.col(vector))).alias("_x")))
    dim = model.pc.numRows
    mean = rows.select(*[F.avg(F.element_at(vector, i + 1)).alias(f"m{i}") for i in range(dim)]).first()
    found = model.pc.toArray().T
    signs = np.sign(found[np.arange(k), np.abs(found).argmax(axis=1)])
    return Projection(np.array(mean, float), found * signs[:, None])


def pca_project(df: DataFrame, vector: str, model: Projection, out: str = "projected") -> DataFrame:
    """Centred projection by a frozen model, in batches of rows; a null vector stays null."""
    mean, components = model.mean, model.components.T

    @F.pandas_udf("array<double>")
    def project(vectors: pd.Series) -> pd.Series:
        have = np.flatnonzero(vectors.notna().to_numpy())
        found: list = [None] * len(vectors)
        if len(have):
            for i, row in zip(have, (np.stack(vectors.iloc[have].to_numpy()) - mean) @ components):
                found[i] = row
        return pd.Series(found, dtype=object)

    return df.withColumn(out, project(V.as_doubles(F.col(vector))))


def dual(one: DataFrame, other: DataFrame, out: str = "unit") -> DataFrame:
    """(id, unit): two spaces as one, each row's unit vectors side by side and scaled to length 1; rows of both only."""
    from .corpus import with_unit

    both = one.select("id", F.col("unit").alias("_a")).join(other.select("id", F.col("unit").alias("_b")), "id")
    return with_unit(both.withColumn("_ab", F.concat("_a", "_b")), "_ab", out).select("id", out)


def silhouette(df: DataFrame, vector: str, label: str) -> float:
    rows = df.select(array_to_vector(F.col(vector)).alias("features"), F.col(label).cast("double").alias("prediction"))
    return ClusteringEvaluator(distanceMeasure="cosine").evaluate(rows)


def balanced_logistic(df: DataFrame, features: str, label: str, c: float = 1.0) -> tuple[list[float], float]:
    """(weights, bias) with both classes weighing the same and regularization 1 / (c n)."""
    counts = {r[label]: r["count"] for r in df.groupBy(label).count().collect()}
    n = sum(counts.values())
    weight = F.when(F.col(label) == 1, n / (2.0 * counts[1])).otherwise(n / (2.0 * counts[0]))
    rows = df.select(array_to_vector(F.col(features)).alias("x"), F.col(label).cast("double").alias("y"), weight.alias("w"))
    model = LogisticRegression(featuresCol="x", labelCol="y", weightCol="w", regParam=1.0 / (c * n), elasticNetParam=0.0, standardization=False, maxIter=200, tol=1e-10).fit(rows)
    return [float(x) for x in model.coefficients], float(model.intercept)


def legibility_proxy(corpus: DataFrame, positive: str, negative: str) -> DataFrame:
    """(id, legibility) from a logistic fit of body-like against display-like rows, for all rows."""
    train = corpus.withColumn("y", F.when(F.expr(positive), 1).when(F.expr(negative), 0)).where("y is not null")
    weights, bias = balanced_logistic(train, "unit", "y")
    z = V.dot(F.col("unit"), F.array(*[F.lit(w) for w in weights])) + bias
    return corpus.select("id", (1.0 / (1.0 + F.exp(-z))).alias("legibility"))


def _newton(x: np.ndarray, y: np.ndarray, c: float = 1.0) -> np.ndarray:
    a = np.column_stack([x, np.ones(len(x))])
    ridge = np.diag([*[1.0 / c] * x.shape[1], 0.0])
    w = np.zeros(a.shape[1])
    for _ in range(50):
        p = 1.0 / (1.0 + np.exp(-np.clip(a @ w, -30, 30)))
        step = np.linalg.solve((a * (p * (1 - p))[:, None]).T @ a + ridge + 1e-12 * np.eye(len(w)), a.T @ (y - p) - ridge @ w)
        w += step
        if np.abs(step).max() < 1e-9:
            break
    return w


def fit_standardized(x: np.ndarray, y: np.ndarray, c: float = 1.0) -> tuple[np.ndarray, float]:
    """Logistic weights of standardized features, moved back to the input space."""
    mean, sd = x.mean(axis=0), x.std(axis=0) + 1e-9
    w = _newton((x - mean) / sd, y, c)
    return w[:-1] / sd, float(w[-1] - (w[:-1] * mean / sd).sum())


def training_rows(pairs: DataFrame, positives: DataFrame, excluded: DataFrame, seeds: int, negatives: int) -> DataFrame:
    """Labelled rows (seed, h_id, id, y, ...): all positives and, for each seed, the first ``negatives`` others in a hashed order.

    Only headings with positives give rows; ``excluded`` has the (h_id, id) that are never negatives.
    """
    keys = ["h_id", "id"]
    every = F.explode(F.sequence(F.lit(0), F.lit(seeds - 1)))
    good = pairs.join(positives, keys, "left_semi").withColumn("y", F.lit(1)).withColumn("seed", every)
    rest = pairs.join(positives.select("h_id").distinct(), "h_id", "left_semi").join(excluded, keys, "left_anti").withColumn("y", F.lit(0)).withColumn("seed", every)
    order = Window.partitionBy("seed", "h_id").orderBy(F.xxhash64("h_id", "id", "seed"), "id")
    return good.unionByName(rest.withColumn("_r", F.row_number().over(order)).where(F.col("_r") <= negatives).drop("_r"))


def held_out(rows: DataFrame, folds: int, fold: str = "fold") -> DataFrame:
    """Each row once for every fold but its own, as ``held``: what that fold's model is fitted on."""
    others = F.filter(F.sequence(F.lit(0).cast("long"), F.lit(folds - 1).cast("long")), lambda f: f != F.col(fold))
    return rows.withColumn("held", F.explode(others))


def fit_by(rows: DataFrame, keys: tuple[str, ...], features: tuple[str, ...]) -> DataFrame:
    """(keys, weights, bias) of a logistic fit on standardized features for each key; keys with one label only give no row."""
    schema = ", ".join(f"{k} {rows.schema[k].dataType.simpleString()}" for k in keys)

    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["h_id", "id", "y"], kind="stable")
        own = {k: [pdf[k].iloc[0]] for k in keys}
        if pdf["y"].nunique() < 2:
            return pd.DataFrame({**own, "weights": [[]], "bias": [0.0]}).iloc[:0]
        w, b = fit_standardized(pdf[list(features)].to_numpy(float), pdf["y"].to_numpy(float))
        return pd.DataFrame({**own, "weights": [w.tolist()], "bias": [b]})

    return rows.select(*keys, "h_id", "id", "y", *features).groupBy(*keys).applyInPandas(fit, f"{schema}, weights array<double>, bias double")


def averaged(models: DataFrame, *keys: str) -> DataFrame:
    """(keys, weights, bias, spread): mean model over seeds, and the deviation of each weight."""
    each = models.select(*keys, "bias", F.posexplode("weights").alias("_at", "_w")).groupBy(*keys, "_at").agg(F.avg("_w").alias("_mean"), F.stddev_pop("_w").alias("_sd"), F.avg("bias").alias("_bias"))
    in_order = lambda c: F.transform(F.array_sort(F.collect_list(F.struct("_at", c))), lambda x: x[c])
    return each.groupBy(*keys).agg(in_order("_mean").alias("weights"), F.first("_bias").alias("bias"), in_order("_sd").alias("spread"))


def scored(pairs: DataFrame, models: DataFrame, features: tuple[str, ...], keys: list[str], out: str = "score") -> DataFrame:
    """Pairs with the linear score of each model of their keys; further columns of the models are carried."""
    return pairs.join(models.drop("spread"), keys).withColumn(out, F.col("bias") + V.dot(F.array(*features), F.col("weights"))).drop("weights", "bias")


#: Fixed values of the learned bilinear metric: dimensions, penalty, steps and rate of the fit.
METRIC_DIM, METRIC_PENALTY, METRIC_STEPS, METRIC_RATE = 32, 1.0, 300, 0.03


def standardized(df: DataFrame, vector: str, k: int = METRIC_DIM, out: str = "x") -> DataFrame:
    """Adds the first ``k`` components, each with mean 0 and deviation 1 (of the whole table)."""
    cut = df.withColumn("_x", F.slice(V.as_doubles(F.col(vector)), 1, k))
    figures = cut.select(F.posexplode("_x").alias("at", "v")).groupBy("at").agg(F.avg("v").alias("mean"), F.stddev_pop("v").alias("sd")).orderBy("at").collect()  # one row a component
    mean, sd = (F.array(*[F.lit(float(r[c])) for r in figures]) for c in ("mean", "sd"))
    centred = F.zip_with("_x", mean, lambda a, b: a - b)
    return cut.withColumn(out, F.zip_with(centred, sd, lambda a, b: a / (b + 1e-9))).drop("_x")


def metric_loss(x: np.ndarray, y: np.ndarray, sign: np.ndarray, lower: np.ndarray, skew: np.ndarray, penalty: float = METRIC_PENALTY) -> tuple[float, np.ndarray, np.ndarray]:
    """(loss, gradient in L, gradient in R) of the mean hinge of sign * f and the penalty on L L' and R.

    f(x, y) = x'(I + R)y - (x - y)'(I + L L')(x - y).
    """
    gap, low = x - y, lower @ lower.T
    f = ((x + x @ skew) * y).sum(axis=1) - ((gap + gap @ low) * gap).sum(axis=1)
    slack = 1.0 - sign * f
    push = np.where(slack > 0, -sign, 0.0) / len(x)  # what the mean hinge gains with each f
    moved = -(gap * push[:, None]).T @ gap
    loss = float(np.maximum(slack, 0).mean() + penalty / 2 * ((low**2).sum() + (skew**2).sum()))
    return loss, (moved + moved.T) @ lower + 2 * penalty * low @ lower, (x * push[:, None]).T @ y + penalty * skew


def fit_metric(x: np.ndarray, y: np.ndarray, sign: np.ndarray, steps: int = METRIC_STEPS, rate: float = METRIC_RATE, penalty: float = METRIC_PENALTY, start: float = 0.0, seed: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """(L, R) by Adam from R = 0 and an L of normal numbers times ``start`` (from L = 0 the metric's own part never moves)."""
    dim = x.shape[1]
    params = [np.random.default_rng(seed).standard_normal((dim, dim)) * start, np.zeros((dim, dim))]
    first, second = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
    for step in range(1, steps + 1):
        for i, gradient in enumerate(metric_loss(x, y, sign, *params, penalty)[1:]):
            first[i] += 0.1 * (gradient - first[i])
            second[i] += 0.001 * (gradient**2 - second[i])
            params[i] = params[i] - rate * (first[i] / (1 - 0.9**step)) / (np.sqrt(second[i] / (1 - 0.999**step)) + 1e-8)
    return params[0], params[1]


def fit_metric_by(rows: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """(keys, lower, skew) of the bilinear metric for each key, from rows (keys, h_id, id, y, x, z): heading and candidate vectors."""
    schema = ", ".join(f"{k} {rows.schema[k].dataType.simpleString()}" for k in keys)

    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["h_id", "id", "y"], kind="stable")
        lower, skew = fit_metric(np.stack(pdf["x"].to_numpy()), np.stack(pdf["z"].to_numpy()), np.where(pdf["y"].to_numpy() == 1, 1.0, -1.0))
        return pd.DataFrame({**{k: [pdf[k].iloc[0]] for k in keys}, "lower": [lower.ravel().tolist()], "skew": [skew.ravel().tolist()]})

    return rows.select(*keys, "h_id", "id", "y", "x", "z").groupBy(*keys).applyInPandas(fit, f"{schema}, lower array<double>, skew array<double>")


def metric_scores(pairs: DataFrame, models: DataFrame, keys: list[str], out: str = "metric") -> DataFrame:
    """Pairs (keys, ..., x, z) with the score of the learned metric of their keys; a pair without a model has none.

    Models go to the workers as constants: a fold and seed has one of fixed size.
    """
    known = {tuple(r[k] for k in keys): tuple(np.array(r[c]).reshape(int(len(r[c]) ** 0.5), -1) for c in ("lower", "skew")) for r in models.collect()}

    @F.pandas_udf("double")
    def score(*columns: pd.Series) -> pd.Series:
        *own, x, z = columns
        values = np.full(len(x), np.nan)
        if len(x):
            a, b = np.stack(x.to_numpy()), np.stack(z.to_numpy())
            for key, at in pd.concat(own, axis=1, keys=keys).groupby(keys, sort=False).indices.items():
                if model := known.get(key if isinstance(key, tuple) else (key,)):
                    lower, skew = model
                    gap = a[at] - b[at]
                    values[at] = ((a[at] + a[at] @ skew) * b[at]).sum(axis=1) - (gap**2).sum(axis=1) - ((gap @ lower) ** 2).sum(axis=1)
        return pd.Series(values)

    return pairs.withColumn(out, F.nanvl(score(*keys, "x", "z"), F.lit(None).cast("double")))


def z_scored(df: DataFrame, value: str, by: tuple[str, ...], out: str) -> DataFrame:
    """Adds (value - mean) / deviation within each key, by one aggregate that is joined back."""
    figures = df.groupBy(*by).agg(F.avg(value).alias("_mean"), F.stddev_pop(value).alias("_sd"))
    return df.join(figures, list(by)).withColumn(out, (F.col(value) - F.col("_mean")) / (F.col("_sd") + 1e-9)).drop("_mean", "_sd")


def probabilities(df: DataFrame, model) -> DataFrame:
    return model.transform(df).withColumn("p", F.element_at(vector_to_array("probability"), 2))
