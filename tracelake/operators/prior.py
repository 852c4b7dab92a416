"""Transition counts and row-stochastic priors."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def bigrams(df: DataFrame, key: list[str], order: list[str], action: str) -> DataFrame:
    """prev, next, n over consecutive rows; pairs that touch a null action are left out, and nothing is paired across them. The pairs are counted before
    the shuffle, so what moves is at most one row per task and pair of actions."""
    nxt = F.lead(action).over(Window.partitionBy(*key).orderBy(*order))
    return df.select(F.col(action).alias("prev"), nxt.alias("next")).where("prev IS NOT NULL AND next IS NOT NULL").groupBy("prev", "next").agg(F.count("*").alias("n"))


def array_bigrams(df: DataFrame, actions: str, by: tuple[str, ...] = ()) -> DataFrame:
    """The same over an array column (per group of ``by``), without windows or a shuffle of steps."""
    a = F.col(actions)
    pairs = F.zip_with(F.slice(a, 1, F.greatest(F.size(a) - 1, F.lit(0))), F.slice(a, 2, F.greatest(F.size(a) - 1, F.lit(0))), lambda p, n: F.struct(p.alias("prev"), n.alias("next")))
    return df.where(F.size(a) > 1).select(*by, F.inline(pairs)).where("prev IS NOT NULL AND next IS NOT NULL").groupBy(*by, "prev", "next").agg(F.count("*").alias("n"))


def unigrams(df: DataFrame, action: str) -> DataFrame:
    """action, n, p (share of all)."""
    n = df.where(F.col(action).isNotNull()).groupBy(F.col(action).alias("action")).agg(F.count("*").alias("n"))
    return n.withColumn("p", F.col("n") / F.sum("n").over(Window.partitionBy()))  # one row per action


def prior(counts: DataFrame, actions: DataFrame, smooth: float = 0.0) -> DataFrame:
    """Dense prev x next table of counts and probabilities: an unseen row is uniform, ``smooth`` blends every row with uniform.

    actions: one column, the table of actions (a fixed few). Columns: prev, next, n, p."""
    name = actions.columns[0]
    a = actions.select(F.col(name).alias("prev"))
    # the grid of the fixed action table: every action with the set of all, exploded
    grid = a.withColumn("_all", F.collect_set("prev").over(Window.partitionBy())).select("prev", F.explode("_all").alias("next"))
    dense = grid.join(counts, ["prev", "next"], "left").withColumn("n", F.coalesce("n", F.lit(0)))
    row, size = F.sum("n").over(Window.partitionBy("prev")), F.count("*").over(Window.partitionBy("prev"))
    return dense.withColumn("p", F.when(row > 0, (1 - smooth) * F.col("n") / row + smooth / size).otherwise(1 / size))


def sampled(masked: DataFrame, key: list[str], action: str, p: Column, legal: Column, r: Column) -> DataFrame:
    """The action drawn by r in [0, 1): the first, in order of actions, whose cumulative legal mass reaches r times the total; without any mass, uniformly
    over the legal actions. One row per key (null where nothing is legal)."""
    w = Window.partitionBy(*key).orderBy(action)
    up, whole = w.rowsBetween(Window.unboundedPreceding, 0), Window.partitionBy(*key)
    t = masked.withColumns({"_p": F.when(legal, p).otherwise(0.0), "_l": F.when(legal, 1).otherwise(0), "_draw": r})
    t = t.withColumns({"_c": F.sum("_p").over(up), "_all": F.sum("_p").over(whole), "_i": F.sum("_l").over(up), "_n": F.sum("_l").over(whole)})
    by_mass = F.min(F.when((F.col("_all") > 0) & (F.col("_l") == 1) & (F.col("_c") >= F.col("_draw") * F.col("_all")), F.col(action)))
    uniform = F.min(F.when((F.col("_all") <= 0) & (F.col("_l") == 1) & (F.col("_i") > F.floor(F.col("_draw") * F.col("_n"))), F.col(action)))
    return t.groupBy(*key).agg(F.coalesce(by_mass, uniform).alias(action))


def checked_prior(table: DataFrame, counts: int, digest: str | None = None, expected: str | None = None) -> DataFrame:
    """The prior behind its integrity checks: square, no negative count, the declared total, the declared action-table digest, rows that add to 1."""
    from tracelake.operators.expectations import require

    s = table.agg(F.countDistinct("prev").alias("a"), F.countDistinct("next").alias("b"), F.count("*").alias("c"), F.min("n").alias("low"), F.sum("n").alias("n")).collect()[0]
    off = table.groupBy("prev").agg(F.sum("p").alias("s")).where(F.abs(F.col("s") - 1) > 1e-6).limit(1).count()
    require(s.a == s.b and s.c == s.a * s.b, "the prior is not square")
    require((s.low or 0) >= 0, "negative counts")
    require(s.n == counts, f"{s.n} pairs, declared {counts}")
    require(digest == expected, "the prior was built for another action table")
    require(not off, "a row does not add to 1")
    return table


def write_prior(table: DataFrame, path: str, actions_digest: str, sources_digest: str, totals: dict[str, int]) -> None:
    """The prior as an artifact: the dense table, then a manifest with digests, totals (as the files read, skipped and failed) and the number of pairs. What lies at the path is
    never overwritten."""
    spark = table.sparkSession
    table.select("prev", "next", "n", "p").coalesce(1).write.mode("errorifexists").parquet(f"{path}/table")  # actions squared: small
    pairs = spark.read.parquet(f"{path}/table").agg(F.sum("n")).collect()[0][0] or 0
    row = [(actions_digest, sources_digest, int(pairs), {k: int(v) for k, v in totals.items()})]
    spark.createDataFrame(row, MANIFEST).coalesce(1).write.mode("errorifexists").json(f"{path}/manifest")


MANIFEST = "actions_digest string, sources_digest string, pairs bigint, totals map<string,bigint>"


def read_prior(spark, path: str, actions_digest: str | None = None) -> tuple[DataFrame, dict]:
    """An artifact behind its checks (``checked_prior``), and its manifest. actions_digest: of the action table in use; another one is an error."""
    from tracelake.operators.expectations import require

    found = spark.read.schema(MANIFEST).json(f"{path}/manifest").collect()
    require(len(found) == 1, f"{len(found)} manifests in {path}")
    m = found[0].asDict(True)
    table = spark.read.parquet(f"{path}/table")
    return checked_prior(table, m["pairs"], m["actions_digest"], actions_digest or m["actions_digest"]), m
