"""Repeated consecutive events: collapse runs of (nearly) equal consecutive steps into one entry.

Plan: steps are exploded after the one shuffle that makes records unique; ``lag`` marks where a step differs from its
predecessor, the running sum of the marks numbers the runs, and one aggregation closes them. The windows and the
aggregation all use the partitioning by uid, so there is no further exchange, and no task ever holds more than rows of
its hash partition (a window streams; only one segment's steps share a key).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracelake.llm.common import NO_STEP, segment_codes

FIRE = 1  # bit of button B


def run_lengths(events: DataFrame, key: list[str], order: str, same: Column, extra: dict[str, Column] | None = None) -> DataFrame:
    """One row per run of consecutive rows of ``key`` (in ``order``) for which ``same`` doesn't change.

    ``same`` is compared null-safely: nulls form runs of their own. Columns: key, run_start (first ``order`` value),
    run_steps, and the aggregates of ``extra``."""
    w = Window.partitionBy(*key).orderBy(order)
    marked = events.withColumn("_v", same)
    marked = marked.withColumn("_new", F.when(F.lag("_v").over(w).eqNullSafe(F.col("_v")) & (F.row_number().over(w) > 1), 0).otherwise(1))
    numbered = marked.withColumn("_run", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    aggs = [F.min(order).alias("run_start"), F.count(F.lit(1)).cast("int").alias("run_steps")]
    aggs += [c.alias(n) for n, c in (extra or {}).items()]
    return numbered.groupBy(*key, "_run").agg(*aggs)


def exploded_steps(segments: DataFrame) -> DataFrame:
    """uid, skip, step (from 0), code of every step of every distinct segment."""
    return segment_codes(segments).select("uid", "skip", F.posexplode("codes").alias("step", "code"))


def collapse_presses(segments: DataFrame, ignore: int = FIRE, default_skip: int = 3) -> DataFrame:
    """Each segment's steps with every run of presses, equal but for the buttons in the mask ``ignore``, as one entry:
    uid, run_no, code (of the ignored buttons only what all steps press), run_start, run_steps, frames, fire_steps.

    ``frames`` is steps times ``skip``, where null ``default_skip``. Null steps form runs of their own with null code;
    segments without steps or without actions give no rows."""
    steps = exploded_steps(segments)
    kept = F.when(F.col("code") == NO_STEP, None).otherwise(F.col("code").bitwiseAND(~ignore & 0x1FF))
    runs = run_lengths(steps, ["uid"], "step", kept, {
        "code": F.bit_and(F.when(F.col("code") == NO_STEP, None).otherwise(F.col("code"))),
        "fire_steps": F.sum(F.when((F.col("code") > 0) & (F.col("code").bitwiseAND(ignore) != 0), 1).otherwise(0)),
        "skip": F.first("skip"),
    })
    return runs.select(
        "uid", F.col("_run").cast("int").alias("run_no"), F.col("code").cast("int").alias("code"), "run_start", "run_steps",
        (F.col("run_steps") * F.coalesce("skip", F.lit(default_skip))).cast("bigint").alias("frames"), F.col("fire_steps").cast("int").alias("fire_steps"),
    )


def long_presses(segments: DataFrame, least: int = 15, ignore: int = FIRE) -> DataFrame:
    """p4_found: the runs of at least ``least`` steps (null steps never count)."""
    return collapse_presses(segments, ignore).where((F.col("run_steps") >= least) & F.col("code").isNotNull()).select("uid", "run_start", "run_steps")
