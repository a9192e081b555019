"""Vectors to two dimensions: standardise, PCA, t-SNE, and the figures of the chart."""

from __future__ import annotations

import math
import time

import numpy as np
import pandas as pd
from pyspark.ml.feature import PCA
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import col


def standardized(df: DataFrame, vector: str, id_col: str, by: list[str] | None = None) -> DataFrame:
    """(by, id, dim, z) in long form: population standard deviation, constant columns divided by 1.

    The moments are a partial aggregate per dimension; they are joined back, not collected.
    """
    by = by or []
    cells = df.select(*by, id_col, F.posexplode(vector).alias("dim", "v"))
    moments = cells.groupBy(*by, "dim").agg(F.avg("v").alias("m"), F.stddev_pop("v").alias("s"))
    return cells.join(moments, [*by, "dim"]).select(*by, id_col, "dim", ((F.col("v") - F.col("m")) / F.when(F.col("s") > 0, F.col("s")).otherwise(1.0)).alias("z"))


def standard_vectors(df: DataFrame, vector: str) -> DataFrame:
    """df with `vector` standardised; moments of as many values as there are dimensions."""
    m = df.select(F.posexplode(vector).alias("dim", "v")).groupBy("dim").agg(F.avg("v").alias("m"), F.stddev_pop("v").alias("s"))
    m = m.agg(F.array_sort(F.collect_list(F.struct("dim", "m", F.when(F.col("s") > 0, F.col("s")).otherwise(1.0).alias("s")))).alias("__m"))
    z = F.zip_with(vector, "__m", lambda v, m: (v - m["m"]) / m["s"])
    return df.crossJoin(F.broadcast(m)).withColumn(vector, z).drop("__m")


def pca(df: DataFrame, vector: str, k: int) -> DataFrame:
    """df with `pc`: k principal components of the standardised vectors.

    The sign of each is fixed: its largest loading is positive.  Fitting is an action.
    """
    df = standard_vectors(df, vector).withColumn("__v", array_to_vector(F.transform(vector, lambda x: x.cast("double"))))
    model = PCA(k=k, inputCol="__v", outputCol="__p").fit(df)
    loadings = model.pc.toArray()
    signs = [1.0 if c[np.argmax(np.abs(c))] >= 0 else -1.0 for c in loadings.T]
    flip = F.array(*map(F.lit, signs))
    return model.transform(df).withColumn("pc", F.zip_with(vector_to_array("__p"), flip, lambda a, b: a * b)).drop("__v", "__p")


def pca_points(df: DataFrame, vector: str) -> DataFrame:
    """df with x, y: the first two components; a single row is (0, 0)."""
    n = df.limit(2).count()
    if n < 2:
        return df.withColumns({"x": F.lit(0.0), "y": F.lit(0.0)})
    return pca(df, vector, 2).withColumns({"x": F.get("pc", F.lit(0)), "y": F.get("pc", F.lit(1))}).drop("pc")


def in_time(until: float) -> None:
    if time.monotonic() > until:
        raise TimeoutError("the layout takes too long")


def tsne_layout(x: np.ndarray, perplexity: float, iterations: int = 600, patience: int = 200, seed: int = 42, until: float = math.inf) -> np.ndarray:
    """Exact t-SNE in numpy, started from the first two columns of x; TimeoutError after `until` of the monotonic clock."""
    n = len(x)
    d = ((x[:, None, :] - x[None, :, :]) ** 2).sum(-1)
    np.fill_diagonal(d, np.inf)
    p = np.zeros((n, n))
    for i in range(n):
        low, high, beta = 0.0, np.inf, 1.0
        for _ in range(50):
            e = np.exp(-(d[i] - d[i].min()) * beta)
            q = e / e.sum()
            entropy = -(q[q > 0] * np.log(q[q > 0])).sum()
            if abs(entropy - math.log(perplexity)) < 1e-5:
                break
            if entropy > math.log(perplexity):
                low, beta = beta, beta * 2 if math.isinf(high) else (beta + high) / 2
            else:
                high, beta = beta, (beta + low) / 2
        p[i] = q
    p = np.maximum((p + p.T) / (2 * n), 1e-12)
    y = x[:, :2] / max(x[:, 0].std(), 1e-12) * 1e-4
    if y.shape[1] < 2:
        y = np.pad(y, ((0, 0), (0, 2 - y.shape[1])))
    rng = np.random.default_rng(seed)
    y = y + rng.normal(0, 1e-6, y.shape)
    step, gain, speed = max(n / 12 / 4, 50.0), np.ones_like(y), np.zeros_like(y)
    best, since = np.inf, 0
    for it in range(iterations):
        in_time(until)
        early = 12.0 if it < 250 else 1.0
        w = 1 / (1 + ((y[:, None] - y[None]) ** 2).sum(-1))
        np.fill_diagonal(w, 0)
        q = np.maximum(w / w.sum(), 1e-12)
        g = (early * p - q) * w
        grad = 4 * (g.sum(1)[:, None] * y - g @ y)
        gain = np.maximum(np.where(np.sign(grad) == np.sign(speed), gain * 0.8, gain + 0.2), 0.01)
        speed = (0.5 if it < 250 else 0.8) * speed - step * gain * grad
        y = y + speed
        if it >= 250 and it % 50 == 0:
            cost = (p * np.log(p / q)).sum()
            best, since = (cost, it) if cost < best else (best, since or it)
            if it - since >= patience:
                break
    return y - y.mean(0)


def blocks(n: int, cells: int = 1 << 18):
    """Slices of rows, such that a block of them against all n rows has about so many cells."""
    step = max(1, cells // n)
    return (slice(i, i + step) for i in range(0, n, step))


def neighbour_affinities(x: np.ndarray, perplexity: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(i, j, p), sorted by i: symmetric affinities of each row and its 3 * perplexity nearest rows, as Barnes-Hut t-SNE has them."""
    n = len(x)
    k = min(n - 1, int(3 * perplexity + 1))
    near, d, norm = np.empty((n, k), np.int64), np.empty((n, k)), (x * x).sum(1)
    for rows in blocks(n):
        far = norm[rows, None] + norm - 2 * x[rows] @ x.T
        far[np.arange(len(far)), np.arange(n)[rows]] = np.inf
        near[rows] = np.argpartition(far, k - 1, axis=1)[:, :k]
        d[rows] = np.maximum(np.take_along_axis(far, near[rows], 1), 0)
    d -= d.min(1, keepdims=True)
    low, high, beta = np.zeros(n), np.full(n, np.inf), np.ones(n)
    for _ in range(50):
        e = np.exp(-d * beta[:, None])
        q = e / e.sum(1, keepdims=True)
        wide = -(q * np.log(np.maximum(q, 1e-300))).sum(1) > math.log(perplexity)
        low, high = np.where(wide, beta, low), np.where(wide, high, beta)
        beta = np.where(np.isinf(high), beta * 2, (low + high) / 2)
    i = np.repeat(np.arange(n), k)
    key, at = np.unique(np.concatenate([i * n + near.ravel(), near.ravel() * n + i]), return_inverse=True)
    return key // n, key % n, np.bincount(at, np.tile(q.ravel(), 2)) / (2 * n)


def repulsion(y: np.ndarray) -> tuple[np.ndarray, float]:
    """(sum of w^2 (y_i - y_j) over j, sum of w over all pairs), w = 1 / (1 + squared distance): every pair, block by block."""
    n = len(y)
    z = (y - y.mean(0)).astype(np.float32)
    norm, one = (z * z).sum(1, keepdims=True), np.ones((n, 1), np.float32)
    left, right, sums = np.hstack([-2 * z, norm, one]), np.hstack([z, one, norm]).T, np.hstack([one, z])
    force, total = np.empty((n, 2)), 0.0
    for rows in blocks(n):
        w = left[rows] @ right
        np.maximum(w, 0, out=w)
        w += 1
        np.reciprocal(w, out=w)
        w[np.arange(len(w)), np.arange(n)[rows]] = 0
        total += float(w.sum(dtype=np.float64))
        np.square(w, out=w)
        got = w @ sums
        force[rows] = got[:, :1] * z[rows] - got[:, 1:]
    return force, total


def tsne_layout_large(x: np.ndarray, perplexity: float, iterations: int = 600, patience: int = 200, seed: int = 42, until: float = math.inf) -> np.ndarray:
    """tsne_layout() without a square matrix: affinities of nearest rows, exact repulsion in blocks."""
    n = len(x)
    i, j, p = neighbour_affinities(x, perplexity)
    y = x[:, :2] / max(x[:, 0].std(), 1e-12) * 1e-4
    y = y + np.random.default_rng(seed).normal(0, 1e-6, y.shape)
    step, gain, speed = max(n / 12 / 4, 50.0), np.ones_like(y), np.zeros_like(y)
    best, since = np.inf, 0
    for it in range(iterations):
        in_time(until)
        early = 12.0 if it < 250 else 1.0
        d = y[i] - y[j]
        w = 1 / (1 + (d * d).sum(1))
        pull = (p * w)[:, None] * d
        pull = np.stack([np.bincount(i, pull[:, c], n) for c in (0, 1)], 1)
        push, total = repulsion(y)
        grad = 4 * (early * pull - push / total)
        gain = np.maximum(np.where(np.sign(grad) == np.sign(speed), gain * 0.8, gain + 0.2), 0.01)
        speed = (0.5 if it < 250 else 0.8) * speed - step * gain * grad
        y = y + speed
        if it >= 250 and it % 50 == 0:
            cost = (p * np.log(np.maximum(p, 1e-12) / np.maximum(w / total, 1e-12))).sum()
            best, since = (cost, it) if cost < best else (best, since or it)
            if it - since >= patience:
                break
    return y - y.mean(0)


def tsne_points(df: DataFrame, vector: str, article: str, id_col: str, most: int = 500, seconds: float = math.inf) -> DataFrame:
    """df's article, id with x, y: t-SNE per article, exact up to `most` rows.

    An article that takes over `seconds`, or whose layout fails, gets its first two principal
    components; by default there is no such limit, and every run gives the same points.

    Each article is one task.  What an article may hold is bounded by its paragraphs; an article
    of over `most` rows has affinities of nearest rows only, and no square matrix of its rows.
    """

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(id_col)
        x = np.array(pdf[vector].tolist(), float).reshape(len(pdf), -1)
        n = len(x)
        if n < 2:
            y = np.zeros((n, 2))
        else:
            s = x.std(0)
            x = (x - x.mean(0)) / np.where(s > 0, s, 1)
            u, w, _ = np.linalg.svd(x, full_matrices=False)
            x = (u * w)[:, : min(30, n - 1)]
            x = x if x.shape[1] > 1 else np.pad(x, ((0, 0), (0, 1)))
            try:
                y = (tsne_layout if n <= most else tsne_layout_large)(x, min(5, n - 1), until=time.monotonic() + seconds)
            except (TimeoutError, ArithmeticError, np.linalg.LinAlgError):
                y = x[:, :2]
        return pd.DataFrame({article: pdf[article], id_col: pdf[id_col], "x": y[:, 0], "y": y[:, 1]})

    kept = df.select(article, id_col, vector)
    return kept.groupBy(article).applyInPandas(run, f"{article} {df.schema[article].dataType.simpleString()}, {id_col} {df.schema[id_col].dataType.simpleString()}, x double, y double")


def projected(df: DataFrame, vector: str, article: str, id_col: str, seconds: float = 45) -> DataFrame:
    """df with x, y by t-SNE per article, or by its principal components where that fails or takes over `seconds`."""
    return df.join(tsne_points(df, vector, article, id_col, seconds=seconds), [article, id_col])


def points(projected: DataFrame) -> DataFrame:
    """The point table's columns, in their order and types."""
    from .. import schemas

    return projected.select(*[F.col(f.name).cast(f.dataType) for f in schemas.POINT.fields])


def bubble_size(frequency: str | Column, reference: str | Column) -> Column:
    """9 for once; 16 to 60 by the logarithm of the frequency against the reference."""
    f, ref = col(frequency), F.greatest(F.lit(2), col(reference))
    t = (F.log(F.greatest(f, F.lit(2))) - math.log(2)) / F.greatest(F.log(ref) - math.log(2), F.lit(1e-9))
    size = 16 + 44 * F.pow(F.least(F.lit(1.0), F.greatest(F.lit(0.0), t)), F.lit(0.65))
    return F.when(f <= 1, F.lit(9.0)).when(ref <= 2, F.lit(16.0)).otherwise(size)


def expanded_size(size: str | Column) -> Column:
    return F.greatest(F.lit(14.0), col(size) * 0.55)


def axis_extent(points: DataFrame, x: str = "x", y: str = "y") -> DataFrame:
    """(min_x, max_x, min_y, max_y), all null unless all are finite; missing coordinates are 0."""
    v = lambda c: F.coalesce(F.col(c).cast("double"), F.lit(0.0))
    e = points.agg(F.min(v(x)).alias("min_x"), F.max(v(x)).alias("max_x"), F.min(v(y)).alias("min_y"), F.max(v(y)).alias("max_y"))
    fine = F.lit(True)
    for c in e.columns:
        fine = fine & F.col(c).isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf")))
    return e.select(*[F.when(fine, F.col(c)).alias(c) for c in e.columns])


def nearest(points: DataFrame, x: float, y: float, radius: float, order: str = "id") -> DataFrame:
    """The point nearest to (x, y) within the radius; of equally near ones the first."""
    d = F.hypot(F.col("x") - x, F.col("y") - y)
    return points.withColumn("distance", d).where(F.col("distance") <= radius).orderBy("distance", order).limit(1)


def progress_percent(done: str | Column, total: str | Column) -> Column:
    return (5 + F.floor(70 * col(done) / F.greatest(col(total), F.lit(1)))).cast("int")


def running_max(df: DataFrame, order: str, value: str, by: list[str] | None = None) -> DataFrame:
    """`running_max` over rows in order, within `by`; without it the order is that of few, aggregated rows."""
    w = (Window.partitionBy(*by) if by else Window.partitionBy(F.lit(0))).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn("running_max", F.max(value).over(w))
