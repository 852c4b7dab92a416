"""Detection and ranking metrics; undefined values are NULL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def frame_metrics(cells: DataFrame, key: list[str], at: str, p: str, t: str) -> DataFrame:
    """Per frame: present (some target > 0.5), dice, mse_skill (1 - mse / mean square of the target), peak_hit, peak score."""
    P, T = F.col(p), F.col(t)
    return cells.groupBy(*key).agg(
        (F.max(T) > 0.5).alias("present"), F.try_divide(2 * F.sum(P * T), F.sum(P * P) + F.sum(T * T)).alias("dice"),
        (1 - F.try_divide(F.avg((P - T) * (P - T)), F.avg(T * T))).alias("mse_skill"), (F.max_by(at, F.struct(P, -F.col(at))) == F.max_by(at, F.struct(T, -F.col(at)))).alias("peak_hit"), F.max(P).alias("peak"))


def class_means(frames: DataFrame, by: list[str]) -> DataFrame:
    """Means over the frames in which the class is present, and their number."""
    on = lambda c: F.avg(F.when(F.col("present"), c)).alias
    return frames.groupBy(*by).agg(F.count("*").alias("frames"), F.count_if("present").alias("present_frames"), on(F.col("dice"))("dice"), on(F.col("mse_skill"))("mse_skill"), on(F.col("peak_hit").cast("double"))("peak_hit"))


def average_precision(df: DataFrame, by: list[str], score: str, present: Column, tie: str) -> DataFrame:
    """Mean of the precision at each positive, in falling order of the score (input order on ties); NULL without positives.

    Ranks are taken per group; for one huge group bucket the scores first (see ``select.global_rank``)."""
    w = Window.partitionBy(*by).orderBy(F.desc(score), tie)
    y = F.coalesce(present, F.lit(False)).cast("int")
    t = df.withColumn("_y", y).withColumns({"_r": F.row_number().over(w), "_hits": F.sum("_y").over(w.rowsBetween(Window.unboundedPreceding, 0))})
    return t.groupBy(*by).agg(F.try_divide(F.sum(F.when(F.col("_y") == 1, F.col("_hits") / F.col("_r"))), F.sum("_y")).alias("ap"))


def presence_scores(df: DataFrame, by: list[str], actual: Column, predicted: Column) -> DataFrame:
    """tp, fp, fn, tn, precision, recall, f1, empty_fpr."""
    a, p = F.coalesce(actual, F.lit(False)), F.coalesce(predicted, F.lit(False))
    t = df.groupBy(*by).agg(F.count_if(a & p).alias("tp"), F.count_if(~a & p).alias("fp"), F.count_if(a & ~p).alias("fn"), F.count_if(~a & ~p).alias("tn"))
    return t.withColumns({"precision": F.try_divide("tp", F.col("tp") + F.col("fp")), "recall": F.try_divide("tp", F.col("tp") + F.col("fn")),
                          "f1": F.try_divide(2 * F.col("tp"), 2 * F.col("tp") + F.col("fp") + F.col("fn")), "empty_fpr": F.try_divide("fp", F.col("fp") + F.col("tn"))})


def psnr(mse: Column, peak: float = 1.0) -> Column:
    """Decibels; NULL where the error is 0."""
    return F.when(mse > 0, 10 * F.log10(F.lit(peak * peak) / mse))


def soft_dice(df: DataFrame, by: list[str], p: Column, t: Column, eps: float = 1e-6) -> DataFrame:
    return df.groupBy(*by).agg(((2 * F.sum(p * t) + eps) / (F.sum(p) + F.sum(t) + eps)).alias("dice"))


def seed_summary(df: DataFrame, by: list[str], value: str) -> DataFrame:
    """n, mean, sd (sample; 0 for one value) and the values in order of seed."""
    return df.groupBy(*by).agg(F.count(value).alias("n"), F.avg(value).alias("mean"), F.coalesce(F.stddev_samp(value), F.lit(0.0)).alias("sd"), F.transform(F.sort_array(F.collect_list(F.struct("seed", value))), lambda s: s[value]).alias("values"))


def paired_gap(df: DataFrame, by: list[str], pair: list[str], arm: str, a: str, b: str, value: str) -> DataFrame:
    """Mean and sd of value(a) - value(b) over pairs that have both."""
    side = lambda name: F.avg(F.when(F.col(arm) == name, F.col(value)))
    t = df.where(F.col(arm).isin(a, b)).groupBy(*by, *pair).agg((side(a) - side(b)).alias("_d")).where("_d IS NOT NULL")
    return t.groupBy(*by).agg(F.count("*").alias("pairs"), F.avg("_d").alias("gap"), F.coalesce(F.stddev_samp("_d"), F.lit(0.0)).alias("sd"))


def bootstrap_gap(gaps: DataFrame, value: str, rounds: int = 1000, seed: int = 0, level: float = 0.95) -> DataFrame:
    """Mean and confidence interval of the mean by resampling: every row gets, per round, a Poisson(1) weight from a hash,
    so resampling is one pass with a combine, without collecting and without drawing rows."""
    u = F.pmod(F.xxhash64(F.lit(seed), F.col("_id"), F.col("_round")), F.lit(1 << 30)) / (1 << 30)
    bounds = [0.36787944117144233, 0.7357588823428847, 0.9196986029286058, 0.9810118431238462, 0.9963401531726563, 0.9994058151824183]
    weight = F.lit(6)
    for i, b in reversed(list(enumerate(bounds))):
        weight = F.when(u < b, i).otherwise(weight)
    t = gaps.where(F.col(value).isNotNull()).withColumn("_id", F.xxhash64(*gaps.columns)).withColumn("_round", F.explode(F.sequence(F.lit(1), F.lit(rounds)))).withColumn("_w", weight)
    means = t.groupBy("_round").agg(F.try_divide(F.sum(F.col("_w") * F.col(value)), F.sum("_w")).alias("m"))
    tail = (1 - level) / 2
    ci = means.agg(F.percentile("m", F.lit(tail)).alias("low"), F.percentile("m", F.lit(1 - tail)).alias("high"))
    none = F.lit(None).cast("double")
    both = gaps.agg(F.avg(value).alias("mean")).select("mean", none.alias("low"), none.alias("high")).unionByName(ci.select(none.alias("mean"), "low", "high"))  # one row each
    return both.agg(F.max("mean").alias("mean"), F.max("low").alias("low"), F.max("high").alias("high"))
