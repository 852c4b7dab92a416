"""Heatmaps, losses and vector quantisation in long form; dense tensors only where they are exported."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def gaussian(dx: Column, dy: Column, sigma: float | Column) -> Column:
    return F.exp(-(dx * dx + dy * dy) / (2 * sigma * sigma))


def heatmaps(points: DataFrame, key: list[str], grid: int = 32, sigma: float = 1.0, crop: tuple[int, int] = (240, 224), reach: float | None = None, drop_off_grid: bool = True) -> DataFrame:
    """key, gx, gy, value: per cell the largest of the blobs of the points (x, y of the full 256 x 240 picture).

    Points move into the crop and are scaled to the grid. A point only explodes to the cells within ``reach`` (all cells where None); outside 6 sigma
    a blob is below 2e-8. The maximum is combined before the shuffle."""
    w, h = crop
    px = (F.col("x") - (256 - w) / 2) / w * grid
    py = (F.col("y") - (240 - h) / 2) / h * grid
    t = points.withColumns({"_px": px, "_py": py})
    if drop_off_grid:
        t = t.where((F.col("_px") >= 0) & (F.col("_px") < grid) & (F.col("_py") >= 0) & (F.col("_py") < grid))
    lo = lambda c: F.greatest(F.ceil(F.col(c) - reach), F.lit(0)).cast("int") if reach else F.lit(0)
    hi = lambda c: F.least(F.floor(F.col(c) + reach), F.lit(grid - 1)).cast("int") if reach else F.lit(grid - 1)
    t = t.where((lo("_px") <= hi("_px")) & (lo("_py") <= hi("_py"))).withColumn("gx", F.explode(F.sequence(lo("_px"), hi("_px")))).withColumn("gy", F.explode(F.sequence(lo("_py"), hi("_py"))))
    return t.groupBy(*key, "gx", "gy").agg(F.max(gaussian(F.col("gx") - F.col("_px"), F.col("gy") - F.col("_py"), sigma)).alias("value"))


def target_heatmaps(points: DataFrame, key: list[str], grid: int = 32) -> DataFrame:
    """Training targets: classes player, enemy, projectile with radii 6, 6 and 4 pixels of a 224-pixel picture; points off the grid still reach in."""
    sigma = F.when(F.col("class") == "projectile", 4.0).otherwise(6.0) * grid / 224
    t = points.withColumn("_sigma", sigma).withColumn("gx", F.explode(F.sequence(F.lit(0), F.lit(grid - 1)))).withColumn("gy", F.explode(F.sequence(F.lit(0), F.lit(grid - 1))))
    px, py = (F.col("x") - 8) / 240 * grid, (F.col("y") - 8) / 224 * grid
    return t.groupBy(*key, "class", "gx", "gy").agg(F.max(gaussian(F.col("gx") - px, F.col("gy") - py, F.col("_sigma"))).alias("value"))


def pixel_weights(player: Column, enemy: Column, projectile: Column) -> Column:
    """1 plus weighted targets, at most 16."""
    return F.least(F.lit(16.0), 1 + 3 * player + 3 * enemy + 15 * projectile)


def upsampled(grid_values: np.ndarray, size: int) -> np.ndarray:
    """Bilinear enlargement of a square grid (centres aligned), for dense exports in Arrow functions."""
    n = grid_values.shape[0]
    at = np.clip((np.arange(size) + 0.5) * n / size - 0.5, 0, n - 1)
    low = np.minimum(at.astype(int), n - 2) if n > 1 else np.zeros(size, int)
    f = at - low
    rows = grid_values[low] * (1 - f)[:, None] + grid_values[np.minimum(low + 1, n - 1)] * f[:, None]
    return rows[:, low] * (1 - f) + rows[:, np.minimum(low + 1, n - 1)] * f


def dense(df: DataFrame, key: list[str], grid: int = 32) -> DataFrame:
    """One ARRAY<FLOAT> of grid * grid values (row by row, absent cells 0) per key."""
    cells = F.map_from_entries(F.collect_list(F.struct((F.col("gy") * grid + F.col("gx")).cast("int"), F.col("value").cast("float"))))
    t = df.groupBy(*key).agg(cells.alias("_m"))
    return t.select(*key, F.transform(F.sequence(F.lit(0), F.lit(grid * grid - 1)), lambda i: F.coalesce(F.try_element_at("_m", i), F.lit(0.0).cast("float"))).alias("values"))


def frame_loss(cells: DataFrame, key: list[str], eps: float = 1e-6) -> DataFrame:
    """Per key: weighted mse of (value, goal, weight), bce of (logit, target), soft dice loss."""
    p = 1 / (1 + F.exp(-F.col("logit")))
    bce = F.greatest("logit", F.lit(0.0)) - F.col("logit") * F.col("target") + F.log1p(F.exp(-F.abs("logit")))
    return cells.groupBy(*key).agg(
        (F.sum(F.col("weight") * (F.col("value") - F.col("goal")) * (F.col("value") - F.col("goal"))) / F.sum("weight")).alias("mse"), F.avg(bce).alias("bce"),
        (1 - (2 * F.sum(p * F.col("target")) + eps) / (F.sum(p) + F.sum("target") + eps)).alias("dice"))


def nearest_code(vectors: DataFrame, uid: str, vec: str, codes: dict[int, list[float]]) -> DataFrame:
    """uid, code, distance: the nearest codebook entry (the smallest number on ties). The codebook is a bounded parameter and travels with the function;
    each batch is one matrix product."""
    names = np.array(sorted(codes))
    book = np.array([codes[int(c)] for c in names], dtype=np.float64)

    def assign(batches):
        for b in batches:
            if not b.num_rows:
                continue
            x = np.array(b.column(1).to_pylist(), dtype=np.float64)
            d = ((x[:, None, :] - book[None]) ** 2).sum(2) if len(book) * x.size < 5e7 else (x**2).sum(1)[:, None] - 2 * x @ book.T + (book**2).sum(1)[None]
            at = d.argmin(1)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(names[at].astype(np.int32)), pa.array(np.sqrt(np.maximum(d[np.arange(len(x)), at], 0)))], names=[uid, "code", "distance"])

    t = vectors.select(uid, vec).where(F.col(vec).isNotNull())
    return t.mapInArrow(assign, t.select(uid).schema.add("code", T.IntegerType()).add("distance", T.DoubleType()))


def lloyd_step(vectors: DataFrame, uid: str, vec: str, codes: dict[int, list[float]]) -> DataFrame:
    """code, dim, n, mean of one k-means update from fixed centres: assignment, then a mean per code and dimension."""
    at = nearest_code(vectors, uid, vec, codes)
    t = vectors.select(uid, F.posexplode(vec).alias("dim", "v")).join(at, uid)
    return t.groupBy("code", "dim").agg(F.count("*").alias("n"), F.avg("v").alias("mean"))


def kmeans(vectors: DataFrame, vec: str, k: int, iterations: int = 20, seed: int = 0):
    """Fitted distributed k-means (k-means|| start, Lloyd steps; empty clusters keep their centre)."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    return KMeans(k=k, maxIter=iterations, seed=seed, featuresCol="_v").fit(vectors.select(array_to_vector(F.col(vec).cast("array<double>")).alias("_v")))


def perplexity(df: DataFrame, code: str) -> DataFrame:
    """used, perplexity = exp(entropy) of the codes."""
    n = df.groupBy(code).agg(F.count("*").alias("n"))
    # sum p ln p = (sum n ln n) / N - ln N: no window over the table
    return n.agg(F.count("*").alias("used"), F.exp(F.log(F.sum("n")) - F.sum(F.col("n") * F.log("n")) / F.sum("n")).alias("perplexity"))
