"""Throughput summaries of attempts, schedules, confirmation sets, marker counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def throughput(attempts: DataFrame, by: list[str], win: Column, valid: Column, wall: str, fingerprint: str | None = None) -> DataFrame:
    """attempts, wins, valid, failures, duplicates, wall_s, wins_per_hour (failed attempts' time is charged, only valid wins count), mean_s and
    p90_s over valid wins (NULL without any)."""
    ok = F.coalesce(win & valid, F.lit(False))
    t = F.when(ok, F.col(wall))
    aggs = [F.count("*").alias("attempts"), F.count_if(F.coalesce(win, F.lit(False))).alias("wins"), F.count_if(ok).alias("valid"), F.count_if(~ok).alias("failures"),
            F.sum(wall).alias("wall_s"), (3600 * F.try_divide(F.count_if(ok), F.sum(wall))).alias("wins_per_hour"), F.avg(t).alias("mean_s"), F.percentile(t, F.lit(0.9)).alias("p90_s")]
    if fingerprint:
        aggs.append((F.count(F.when(ok, F.col(fingerprint))) - F.countDistinct(F.when(ok, F.col(fingerprint)))).alias("duplicates"))
    return attempts.groupBy(*by).agg(*aggs)


def by_declared_arm(summary: DataFrame, arm: str, declared: list[str], unseen: bool = True, zeros: list[str] | None = None) -> DataFrame:
    """The summary in the order of the declared arms (absent ones with zero counts), then, unless left out, arms that weren't declared. Adds ``place``."""
    dim = summary.sparkSession.createDataFrame([(a, i) for i, a in enumerate(declared)], f"{arm} string, place int")
    out = summary.join(F.broadcast(dim), arm, "full" if unseen else "right")  # a fixed few rows
    return out.withColumn("place", F.coalesce("place", F.lit(len(declared)))).withColumns({c: F.coalesce(c, F.lit(0)) for c in zeros or []})


def grid(spark: SparkSession, axes: dict[str, list]) -> DataFrame:
    """All combinations of a few fixed values (screening cells)."""
    out = spark.range(1).select()
    for name, values in axes.items():
        out = out.withColumn(name, F.explode(F.array(*[F.lit(v) for v in values])))
    return out


def confirmation(summary: DataFrame, config: str, baseline: str, k: int = 4) -> DataFrame:
    """The k best configurations without a failure, and the baseline last. Fewer than k is an error."""
    from tracelake.operators.expectations import require

    best = summary.where((F.col("failures") == 0) & (F.col(config) != baseline)).orderBy(F.desc("wins_per_hour"), config).limit(k)
    require(best.count() == k, f"fewer than {k} perfect configurations")
    return best.withColumn("place", F.row_number().over(Window.orderBy(F.desc("wins_per_hour"), config))).unionByName(summary.where(F.col(config) == baseline).withColumn("place", F.lit(k + 1)))


def schedule(configs: DataFrame, config: str, rounds: int, first: str | None = None, seed: int = 0) -> DataFrame:
    """config, attempt, position: full rounds, each in its own seeded order."""
    from tracelake.operators.select import seeded_round

    return seeded_round(configs.select(config).withColumn("attempt", F.explode(F.sequence(F.lit(1), F.lit(rounds)))), "attempt", config, first, seed)


def requests(sources: DataFrame, path: str, full_each: int, partial: int, shards: int, seed: int = 0) -> DataFrame:
    """request_id, source, full, shard: ``full_each`` whole requests per source, then ``partial`` ones on sources drawn with replacement by hash."""
    from tracelake.operators.select import global_rank

    byte = F.conv(F.substring(F.hex("source"), 1, 4), 16, 10).cast("int")  # ranked in cells of the first two characters
    numbered = global_rank(sources.select(F.col(path).alias("source")).distinct(), ["source"], cell=byte).select("source", (F.col("rank") - 1).cast("int").alias("i"))
    n = numbered.count()
    full = numbered.withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(full_each - 1)))).select((F.col("i") * full_each + F.col("k")).cast("bigint").alias("request_id"), "source", F.lit(True).alias("full"))
    drawn = sources.sparkSession.range(partial).select(F.col("id"), F.pmod(F.xxhash64("id", F.lit(seed)), F.lit(max(n, 1))).cast("int").alias("i"))
    part = drawn.join(numbered, "i").select((F.col("id") + n * full_each).alias("request_id"), "source", F.lit(False).alias("full"))
    return full.unionByName(part).withColumn("shard", F.pmod("request_id", F.lit(shards)))


def checked_count(raw: Column) -> Column:
    """A count given as JSON text: a whole number that isn't negative; null, fractions, booleans, strings are errors."""
    ok = F.coalesce(raw.rlike(r"^\s*\d+\s*$"), F.lit(False))
    return F.when(ok, F.trim(raw).cast("bigint")).otherwise(F.raise_error(F.concat(F.lit("invalid count: "), F.coalesce(raw, F.lit("null")))).cast("bigint"))


def committed_counts(markers: DataFrame, level: str, scope: str, worker: str, n: str, levels: range | None = None) -> DataFrame:
    """Batches and traces by level, by level and scope, by level and worker, in one aggregation over grouping sets; ``levels`` fills levels without any.

    Columns: kind (level, scope, worker), level, name, batches, traces."""
    t = markers.select(F.col(level).alias("level"), F.col(scope).alias("scope"), F.col(worker).alias("worker"), F.col(n).alias("n"))
    g = t.groupingSets([["level"], ["level", "scope"], ["level", "worker"]], "level", "scope", "worker").agg(F.grouping_id().alias("gid"), F.count("*").alias("batches"), F.sum("n").alias("traces"))
    kind = F.when(F.col("gid") == 3, "level").when(F.col("gid") == 1, "scope").otherwise("worker")
    out = g.select(kind.alias("kind"), "level", F.when(F.col("gid") == 1, F.col("scope")).when(F.col("gid") == 2, F.col("worker")).alias("name"), "batches", "traces")
    if levels is None:
        return out
    every = markers.sparkSession.range(levels.start, levels.stop).select(F.col("id").cast("int").alias("level"))
    absent = every.join(out.where("kind = 'level'").select("level"), "level", "left_anti")
    return out.unionByName(absent.select(F.lit("level").alias("kind"), "level", F.lit(None).cast("string").alias("name"), F.lit(0).cast("bigint").alias("batches"), F.lit(0).cast("bigint").alias("traces")))


def counts_table(markers: DataFrame, level: str, scope: str, n: str, known: list[str]) -> DataFrame:
    """One row per level with a column per known scope and one for the others."""
    aggs = [F.coalesce(F.sum(F.when(F.col(scope) == s, F.col(n))), F.lit(0)).alias(s) for s in known]
    return markers.groupBy(level).agg(*aggs, F.coalesce(F.sum(F.when(~F.coalesce(F.col(scope).isin(*known), F.lit(False)), F.col(n))), F.lit(0)).alias("other"))


def histogram_gaps(df: DataFrame, value: str, width: float = 64, share: float = 0.03) -> DataFrame:
    """bin, n: bins of equal width from the smallest value on (the last one closed) that hold less than ``share`` of the fullest; absent bins count as 0."""
    import math

    ends = df.agg(F.min(value), F.max(value)).collect()[0]
    if ends[0] is None:
        return df.sparkSession.createDataFrame([], "bin bigint, n bigint")
    bins = max(1, math.ceil((ends[1] - ends[0]) / width))
    b = F.least(F.floor((F.col(value) - F.lit(ends[0])) / width), F.lit(bins - 1)).cast("bigint")
    n = df.where(F.col(value).isNotNull()).groupBy(b.alias("bin")).agg(F.count("*").alias("n"))
    every = df.sparkSession.range(bins).withColumnRenamed("id", "bin").join(n, "bin", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    most = F.max("n").over(Window.partitionBy())  # one row per bin
    return every.withColumn("most", most).where(F.col("n") < share * F.col("most")).select("bin", "n")


def density(df: DataFrame, x: str, y: str, cell: float) -> DataFrame:
    return df.groupBy(F.floor(F.col(x) / cell).alias("cx"), F.floor(F.col(y) / cell).alias("cy")).agg(F.count("*").alias("n"))
