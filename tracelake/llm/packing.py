"""Filling fixed-capacity shards with episodes: bounded-space online packing.

Per level and task the episodes are cut into parts of at most ``part_items``. A part packs online: it holds at most
``windows`` open shards, an item goes where it leaves the least room, and when it fits nowhere the fullest is emitted and
a new one opened. What is still open at the end is handed on: the items in the open shards of up to ``fan_in`` parts are packed
again, largest first, and so on until one part is left, which closes all. So no task holds more than a bounded number of items,
however large a group is, and only the last shards of a group stay partly empty.
"""

from __future__ import annotations

from bisect import bisect_left, insort

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tracelake.plans.staging import stage

OUT = "level int, task string, uid string, piece int, from_step bigint, frames bigint, target bigint, part bigint, shard string, open boolean"


def pack(sizes: list[int], capacity: int, windows: int) -> tuple[list[int], set[int]]:
    """Window of each item, and the windows still open at the end. Sizes are at most the capacity."""
    at: list[int] = []
    free: list[tuple[int, int]] = []  # room and number of the open windows, least room first
    opened = 0
    for size in sizes:
        i = bisect_left(free, (size, -1))
        if i == len(free):
            if len(free) >= windows:
                free.pop(0)  # the fullest
            room, no = capacity, opened
            opened += 1
        else:
            room, no = free.pop(i)
        at.append(no)
        if room > size:
            insort(free, (room - size, no))
    return at, {no for _, no in free}


def _packer(windows: int, last: bool, stage_no: int):
    def run(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values(["frames", "uid", "piece"], ascending=[False, True, True]) if stage_no else part.sort_values(["order", "uid", "piece"])
        target = int(part["target"].iloc[0])
        at, still = pack(part["frames"].tolist(), target, len(part) + 1 if stage_no else windows)
        if stage_no and not last and len(still) > windows:  # hand on the emptiest only
            load = part["frames"].groupby(at).sum()
            still = set(sorted(still, key=lambda no: (load[no], no))[:windows])
        head = f"{part['level'].iloc[0]}-{part['task'].iloc[0]}-{stage_no}-{part['part'].iloc[0]}"
        return part.assign(shard=[f"{head}-{no}" for no in at], open=[not last and no in still for no in at])[[c.split()[0] for c in OUT.split(", ")]]

    return run


def items(episodes: DataFrame, targets: DataFrame) -> DataFrame:
    """Pieces to place: one per distinct episode, more where it is longer than a shard (all but the last are full).

    Size is ``action_steps``, else the length of ``actions``; without a size, or with a negative one, or without a target for level and task, an
    episode can't be placed: its target is null."""
    size = F.coalesce("action_steps", F.when(F.col("actions").isNotNull(), F.size("actions"))).cast("bigint")
    one = episodes.where("uid IS NOT NULL").select("uid", "level", "task", size.alias("size")).dropDuplicates(["uid"])
    goal = targets.where("target_frames > 0").groupBy("level", "task").agg(F.max("target_frames").alias("target"))
    one = one.join(goal, ["level", "task"], "left").withColumn("target", F.when(F.col("size") >= 0, F.col("target")))
    last = F.when(F.col("size") > 0, F.floor((F.col("size") - 1) / F.col("target"))).otherwise(F.lit(0).cast("bigint"))
    pieces = one.withColumn("piece", F.explode(F.sequence(F.lit(0).cast("bigint"), F.coalesce(F.when(F.col("target").isNotNull(), last), F.lit(0).cast("bigint")))))
    return pieces.select("level", "task", "uid", F.col("piece").cast("int").alias("piece"), (F.col("piece") * F.coalesce("target", F.lit(0))).alias("from_step"),
                         F.when(F.col("target").isNotNull(), F.least("target", F.col("size") - F.col("piece") * F.col("target"))).otherwise(F.col("size")).alias("frames"), "target")


def placed(episodes: DataFrame, targets: DataFrame, windows: int = 64, part_items: int = 20_000, fan_in: int = 16) -> DataFrame:
    """level, task, uid, piece, from_step, frames, target, shard, place (from 0), first_frame of every piece. Episodes that
    can't be placed have a null shard."""
    todo = stage(items(episodes, targets), "items")
    fit = todo.where("target IS NOT NULL")
    n = fit.groupBy("level", "task").agg(F.ceil(F.count("*") / part_items).cast("bigint").alias("parts"))
    parts = max([r.parts for r in n.agg(F.max("parts").alias("parts")).collect() if r.parts] or [1])
    now = fit.join(n, ["level", "task"]).withColumn("order", F.xxhash64("uid", "piece")).withColumn("part", F.pmod(F.xxhash64("uid", F.lit(3)), "parts")).drop("parts")
    done, no = [], 0
    while True:
        last = no > 0 and parts == 1
        packed = now.groupBy("level", "task", "part").applyInPandas(_packer(windows, last, no), OUT)
        packed = stage(packed, "packed")
        done.append(packed.where("NOT open"))
        if last:
            break
        parts = -(-parts // fan_in)
        now = packed.where("open").drop("shard", "open").withColumn("part", F.floor(F.col("part") / fan_in)).withColumn("order", F.lit(0).cast("bigint"))
        no += 1
    out = done[0]
    for d in done[1:]:
        out = out.unionByName(d)
    w = Window.partitionBy("shard").orderBy("uid", "piece")
    before = F.coalesce(F.sum("frames").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    cols = ["level", "task", "uid", "piece", "from_step", "frames", "target", "shard"]
    out = out.select(*cols, (F.row_number().over(w) - 1).alias("place"), before.cast("bigint").alias("first_frame"))
    rest = todo.where("target IS NULL").select(*cols[:-1], F.lit(None).cast("string").alias("shard"), F.lit(None).cast("int").alias("place"), F.lit(None).cast("bigint").alias("first_frame"))
    return out.unionByName(rest)


def shards(episodes: DataFrame, targets: DataFrame) -> DataFrame:
    """Per shard: level, task, frames, episodes, unused space."""
    return placed(episodes, targets).where("shard IS NOT NULL").groupBy("shard", "level", "task").agg(
        F.sum("frames").alias("frames"), F.countDistinct("uid").alias("episodes"), F.max("target").alias("target_frames"), (F.max("target") - F.sum("frames")).alias("unused"))


def invariants(episodes: DataFrame, targets: DataFrame) -> DataFrame:
    """Per level and task what holds for every right packing: level, task, episodes and frames placed, twice (places of one piece beyond the first), over
    (shards over their target), broken (episodes in several pieces that would fit one shard), tight (at most 6 % and one shard more than the frames need)."""
    rows = stage(placed(episodes, targets).where("shard IS NOT NULL"), "placed")
    load = rows.groupBy("level", "task", "shard").agg(F.sum("frames").alias("load"), F.max("target").alias("target")).groupBy("level", "task").agg(
        F.count_if(F.col("load") > F.col("target")).alias("over"), F.count("*").alias("shards"), F.sum("load").alias("frames"), F.max("target").alias("target"))
    per = rows.groupBy("level", "task", "uid").agg(F.count("*").alias("rows"), F.countDistinct("piece").alias("pieces"), F.sum("frames").alias("size"), F.max("target").alias("target")).groupBy("level", "task").agg(
        F.count("*").alias("episodes"), F.sum(F.col("rows") - F.col("pieces")).alias("twice"), F.count_if((F.col("pieces") > 1) & (F.col("size") <= F.col("target"))).alias("broken"))
    tight = F.col("shards") <= F.ceil(F.col("frames") / F.col("target")) * 1.06 + 1
    return load.join(per, ["level", "task"]).select("level", "task", "episodes", "frames", "twice", "over", "broken", tight.alias("tight"))
