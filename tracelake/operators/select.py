"""Ranking, sampling, splits, balancing, prefixes, set operations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T


def top_k(df: DataFrame, by: list[str], order: list[Column], k: int) -> DataFrame:
    """The first k rows per stratum (window group limits keep k rows per task before the shuffle)."""
    w = Window.partitionBy(*by).orderBy(*order)
    return df.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def global_rank(df: DataFrame, order: list[str], cells: int = 256, cell: Column | None = None) -> DataFrame:
    """Adds ``rank`` (from 1) over the whole table without a window of one task: rows are ranked within cells that follow the
    order (by default the first byte of the hex string ``order[0]``), and a cell starts after the sizes of those before it."""
    c = cell if cell is not None else F.conv(F.substring(order[0], 1, 2), 16, 10).cast("int")
    t = df.withColumn("_cell", c)
    n = t.groupBy("_cell").agg(F.count("*").alias("_n"))
    base = n.withColumn("_base", F.sum("_n").over(Window.orderBy("_cell")) - F.col("_n")).select("_cell", "_base")  # at most ``cells`` rows
    inside = F.row_number().over(Window.partitionBy("_cell").orderBy(*order))
    return t.withColumn("_r", inside).join(base, "_cell").withColumn("rank", (F.col("_base") + F.col("_r")).cast("bigint")).drop("_cell", "_r", "_base")


def exact_split(df: DataFrame, order: list[str], sizes: dict[str, int]) -> DataFrame:
    """Adds ``split``: the first rows in order go to the first split, and so on; later rows are left out."""
    ranked = global_rank(df, order)
    split, done = F.lit(None).cast("string"), 0
    for name, n in sizes.items():
        split = F.when((F.col("rank") > done) & (F.col("rank") <= done + n), F.lit(name)).otherwise(split)
        done += n
    return ranked.withColumn("split", split).where(F.col("rank") <= done)


def first_per(df: DataFrame, key: list[str], order: list[Column]) -> DataFrame:
    """Keep-first deduplication with a defined first, and how many rows each key had (``copies``)."""
    w = Window.partitionBy(*key)
    return df.withColumns({"_r": F.row_number().over(w.orderBy(*order)), "copies": F.count("*").over(w)}).where("_r = 1").drop("_r")


def upper_median(df: DataFrame, by: list[str], order: list[str]) -> DataFrame:
    """Per group the row at position n // 2 (from 0) in order."""
    w = Window.partitionBy(*by)
    t = df.withColumns({"_r": F.row_number().over(w.orderBy(*order)), "_n": F.count("*").over(w)})
    return t.where("_r = floor(_n / 2) + 1").drop("_r", "_n")


def prefix_budget(df: DataFrame, by: list[str], order: list[str], amount: str, budget: float) -> DataFrame:
    """The smallest prefix per group whose sum reaches the budget (all rows where it is never reached)."""
    w = Window.partitionBy(*by).orderBy(*order)
    return df.withColumn("running", F.sum(amount).over(w.rowsBetween(Window.unboundedPreceding, 0))).where(F.col("running") - F.col(amount) < budget)


def offsets(df: DataFrame, by: list[str], order: list[str], length: str) -> DataFrame:
    """Adds ``start`` and ``stop`` of each row in the concatenation of its group."""
    w = Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn("stop", F.sum(length).over(w).cast("bigint")).withColumn("start", (F.col("stop") - F.col(length)).cast("bigint"))


def scaling_prefixes(groups: DataFrame, by: list[str], ordinal: str, amounts: list[str]) -> DataFrame:
    """Sums over the first 1, 2, 4, ... and all n groups per key. Each group explodes to the prefixes that hold it."""
    n = groups.groupBy(*by).agg(F.count("*").alias("_n"))
    w = Window.partitionBy(*by).orderBy(ordinal)
    t = groups.withColumn("_r", F.row_number().over(w)).join(n, by)
    low = F.ceil(F.log2("_r") - 1e-12)
    steps = F.array_distinct(F.concat(F.filter(F.transform(F.sequence(low, F.lit(62).cast("bigint")), lambda e: F.pow(F.lit(2.0), e).cast("bigint")), lambda s: s <= F.col("_n")), F.array(F.col("_n"))))
    return t.withColumn("prefix", F.explode(steps)).groupBy(*by, "prefix").agg(*[F.sum(a).alias(a) for a in amounts])


def balanced_shards(df: DataFrame, key: list[str], stratum: str, length: str, uid: str, target: int) -> DataFrame:
    """Longest-first balancing of items into k = max(1, ceil(total / target)) shards per key.

    Strata come in order of name, items by falling length, each goes to the least loaded shard (the lowest on ties). The greedy is
    serial within a key, so a key is one Arrow group; keys run in parallel. Adds shard."""
    import heapq

    import pandas as pd

    schema = df.select(*key, stratum, length, uid).schema.add("shard", T.IntegerType())

    def run(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values([stratum, length, uid], ascending=[True, False, True], na_position="first")
        k = max(1, -(-int(part[length].sum()) // target))
        loads, out = [(0, i) for i in range(k)], []
        for n in part[length].tolist():
            load, i = heapq.heappop(loads)
            out.append(i)
            heapq.heappush(loads, (load + int(n), i))
        return part.assign(shard=pd.array(out, dtype="int32"))[[f.name for f in schema]]

    return df.select(*key, stratum, length, uid).groupBy(*key).applyInPandas(run, schema)


def hash_sample(df: DataFrame, by: list[str], key: Column, k: int, seed: int = 0) -> DataFrame:
    """k rows per stratum, chosen by a seeded hash: the same rows whatever the partitioning."""
    return top_k(df.withColumn("_h", F.sha2(F.concat_ws(":", F.lit(str(seed)), key), 256)), by, [F.col("_h")], k).drop("_h")


def seeded_round(df: DataFrame, round_col: str, item: str, first: str | None = None, seed: int = 0) -> DataFrame:
    """Order of the items within each round: ``first`` leads, the rest by seeded hash. Adds ``position`` from 1."""
    lead = F.when(F.col(item) == first, 0).otherwise(1) if first is not None else F.lit(1)
    h = F.sha2(F.concat_ws(":", F.lit(str(seed)), F.col(round_col).cast("string"), F.col(item).cast("string")), 256)
    return df.withColumn("position", F.row_number().over(Window.partitionBy(round_col).orderBy(lead, h, item)))


def anti(df: DataFrame, done: DataFrame, on: list[str]) -> DataFrame:
    """Rows whose key isn't done yet."""
    return df.join(done.select(*on).distinct(), on, "left_anti")


def override(base: DataFrame, sidecar: DataFrame, on: list[str]) -> DataFrame:
    """Left join in which the sidecar's values win where they are not null."""
    common = [c for c in base.columns if c in sidecar.columns and c not in on]
    s = sidecar.withColumnsRenamed({c: f"_s_{c}" for c in common})
    out = base.join(s, on, "left")
    return out.withColumns({c: F.coalesce(f"_s_{c}", c) for c in common}).drop(*[f"_s_{c}" for c in common])


def upsert(table: DataFrame, rows: DataFrame, on: list[str]) -> DataFrame:
    """The table with its rows of the same key replaced."""
    return table.join(rows.select(*on), on, "left_anti").unionByName(rows, allowMissingColumns=True)
