"""Terrain as a long table of cells (level, row, col, code): stamping, surfaces, pits, point queries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracelake.functions import ram
from tracelake.operators.sequence import islands, nearest_within, pieces

EMPTY, FLOOR, WATER, SOLID = 0, 1, 2, 0x80
CELL, WIDTH, HEIGHT = 16, 256, 240


def standable(code: Column) -> Column:
    return code.isin(FLOOR, SOLID)


def stamped(steps: DataFrame) -> DataFrame:
    """level, row, col, code: every cell of the screens seen, with the code of the first step that shows it not empty.

    steps: trace_id, step, level, ram. Cells are exploded per step (a fixed 16 or 17 by 15), and the first is an aggregate with a combine
    before the shuffle, so what moves is one row per task and cell."""
    left = ram.xscroll(F.col("ram"))
    col = F.explode(F.sequence(F.floor(left / CELL), F.floor((left + WIDTH - 1) / CELL)))
    t = steps.select("trace_id", "step", "level", "ram", left.alias("_left"), col.alias("col"))
    t = t.withColumn("_x", (F.col("col") * CELL - F.col("_left") + CELL // 2).cast("int")).where((F.col("_x") >= 0) & (F.col("_x") < WIDTH))
    t = t.withColumn("row", F.explode(F.sequence(F.lit(0), F.lit(HEIGHT // CELL - 1))))
    t = t.withColumn("code", ram.collision(F.col("ram"), F.col("_x"), F.col("row") * CELL + CELL // 2)).where("code <> 0")
    return t.groupBy("level", "row", "col").agg(F.min_by("code", F.struct("trace_id", "step")).alias("code"))


def code_at(points: DataFrame, terrain: DataFrame, x: str = "x", y: str = "y") -> DataFrame:
    """Adds the ``code`` at world pixels (0 out of range) and what follows from it: is_floor, is_solid, is_water, is_standable."""
    t = points.withColumns({"col": F.floor(F.col(x) / CELL), "row": F.floor(F.col(y) / CELL).cast("int")})
    out = t.join(terrain.select("level", "row", "col", "code"), ["level", "row", "col"], "left").withColumn("code", F.coalesce("code", F.lit(EMPTY))).drop("row", "col")
    c = F.col("code")
    return out.withColumns({"is_floor": c == FLOOR, "is_solid": c == SOLID, "is_water": c == WATER, "is_standable": standable(c)})


def surface_y(terrain: DataFrame) -> DataFrame:
    """level, col, y: world y of the topmost standable cell of each column that has one."""
    return terrain.where(standable(F.col("code"))).groupBy("level", "col").agg((F.min("row") * CELL).alias("y"))


def pits(terrain: DataFrame) -> DataFrame:
    """level, x0, x1: half-open runs of columns, between the first and the last of the level, without a standable cell."""
    cols = terrain.groupBy("level").agg(F.min("col").alias("a"), F.max("col").alias("b")).select("level", F.explode(F.sequence("a", "b")).alias("col"))
    empty = cols.join(surface_y(terrain).select("level", "col"), ["level", "col"], "left_anti")
    run = empty.withColumn("_k", F.col("col") - F.row_number().over(Window.partitionBy("level").orderBy("col")))
    return run.groupBy("level", "_k").agg((F.min("col") * CELL).alias("x0"), ((F.max("col") + 1) * CELL).alias("x1")).drop("_k")


def surfaces(terrain: DataFrame, longest: int = 8) -> DataFrame:
    """level, sid, row, c0, c1: runs of standable cells with none above, in pieces of at most ``longest`` cells, numbered in scan order."""
    s = terrain.where(standable(F.col("code"))).select("level", "row", "col")
    open_above = s.join(s.select("level", (F.col("row") + 1).alias("row"), "col"), ["level", "row", "col"], "left_anti")
    run = open_above.withColumn("_k", F.col("col") - F.row_number().over(Window.partitionBy("level", "row").orderBy("col")))
    cut = run.withColumn("island", F.dense_rank().over(Window.partitionBy("level", "row").orderBy("_k")))
    cut = pieces(cut, ["level", "row"], ["col"], longest).groupBy("level", "row", "island", "piece").agg(F.min("col").alias("c0"), F.max("col").alias("c1"))
    return cut.select("level", (F.row_number().over(Window.partitionBy("level").orderBy("row", "c0")) - 1).alias("sid"), "row", "c0", "c1")


def segment_at(points: DataFrame, surface: DataFrame, tolerance: int = 1) -> DataFrame:
    """Surface of each point (level, x, feet_y): the nearest row within ``tolerance`` rows in the point's column, the upper one on ties."""
    cells = surface.select("level", F.explode(F.sequence("c0", "c1")).alias("col"), "row", "sid")
    p = points.withColumns({"col": F.floor(F.col("x") / CELL), "feet_row": F.floor(F.col("feet_y") / CELL).cast("int")})
    return nearest_within(p, cells, ["level", "col"], "feet_row", "row", tolerance, "sid")


__all__ = ["code_at", "islands", "pits", "segment_at", "stamped", "surface_y", "surfaces"]
