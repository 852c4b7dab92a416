"""Action vectors: codes, combos, vocabularies, legality."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Bit numbers of the buttons.
FIRE, UP, DOWN, LEFT, RIGHT, JUMP = 0, 4, 5, 6, 7, 8
HELD_FIRE_WEAPONS = (1, 4)
# The default table, name of each action in order; letters are the buttons held.
BASELINE = ("_", "J", "F", "L", "LJ", "LF", "R", "RJ", "RF", "U", "UJ", "UF", "D", "DJ", "DF", "UL", "ULJ", "ULF", "UR", "URJ", "URF")
BIT_OF = {"F": FIRE, "U": UP, "D": DOWN, "L": LEFT, "R": RIGHT, "J": JUMP}


def code(vector: Column, buttons: int = 9) -> Column:
    """Sum of bit * 2**i (missing and null buttons are 0)."""
    total = F.lit(0)
    for i in range(buttons):
        total = total + F.when(F.coalesce(F.get(vector, F.lit(i)), F.lit(0)) != 0, 1 << i).otherwise(0)
    return total


def name_code(name: str) -> int:
    return sum(1 << BIT_OF[c] for c in name if c != "_")


def action_dim(spark: SparkSession, level: int | None = None, names: tuple[str, ...] = BASELINE) -> DataFrame:
    """level, action_id, name, bits: a fixed table of a few rows."""
    return spark.createDataFrame([(level, i, n, name_code(n)) for i, n in enumerate(names)], "level int, action_id int, name string, bits int")


def held(bits: Column, bit: int) -> Column:
    return bits.bitwiseAND(1 << bit) != 0


def combo(bits: Column) -> Column:
    """One of 36 combos: 9 states of the pad (diagonals first) times 4 of the buttons; null bits stay null."""
    u, d, l, r = (held(bits, b) for b in (UP, DOWN, LEFT, RIGHT))
    pad = F.when(u & l, 5).when(u & r, 6).when(d & l, 7).when(d & r, 8).when(l, 1).when(r, 2).when(u, 3).when(d, 4).otherwise(0)
    f, j = held(bits, FIRE), held(bits, JUMP)
    press = F.when(f & j, 3).when(j, 1).when(f, 2).otherwise(0)
    return F.when(bits.isNotNull(), pad * 4 + press)


def indexed(steps: DataFrame, dim: DataFrame, bits: str = "bits", strict: bool = True) -> DataFrame:
    """Adds ``action_id`` by vector. The dimension is a few rows, so its join needs no shuffle. An unknown vector is an error, or null if not strict."""
    out = steps.join(dim.select(F.col("bits").alias(bits), "action_id"), bits, "left")
    if strict:
        out = out.withColumn("action_id", F.coalesce("action_id", F.raise_error(F.concat(F.lit("no such action: "), F.col(bits).cast("string"))).cast("int")))
    return out


def jump_is_live(previous: Column, jump: Column, edge: Column, electro: Column, water: Column) -> Column:
    return ~held(previous, JUMP) & (jump == 0) & (edge == 0) & (electro == 0) & (water == 0)


def fire_gate_open(previous: Column, weapon: Column, electro: Column, hidden: Column) -> Column:
    return (electro == 0) & (hidden == 0) & (weapon.isin(*HELD_FIRE_WEAPONS) | ~held(previous, FIRE))


def legal(bits: Column, previous: Column, weapon: Column, jump: Column, edge: Column, electro: Column, hidden: Column, water: Column) -> Column:
    """May an action be taken? Inert jumps and shots are out; with an open gate in water so are shots downwards. Pressing nothing is always legal."""
    fire = held(bits, FIRE)
    shut = fire & F.when(~fire_gate_open(previous, weapon, electro, hidden), True).otherwise((water != 0) & held(bits, DOWN))
    return ~(held(bits, JUMP) & ~jump_is_live(previous, jump, edge, electro, water)) & ~shut


def legal_actions(states: DataFrame, dim: DataFrame) -> DataFrame:
    """Every state with its legal actions. The action table (a fixed few rows) is exploded onto the row, so nothing is joined."""
    table = dim.select("action_id", "name", "bits").orderBy("action_id").collect()  # a fixed few rows
    rows = F.array(*[F.struct(F.lit(r.action_id).alias("action_id"), F.lit(r.name).alias("name"), F.lit(r.bits).alias("bits")) for r in table])
    wide = states.select("*", F.inline(rows))
    c = F.col
    return wide.where(legal(c("bits"), c("previous"), c("weapon"), c("jump_status"), c("edge_fall"), c("electro"), c("hidden"), c("water_state")))


def press_penalty(bits: Column, costs: dict[str, float]) -> Column:
    """Sum of the costs of the buttons held; letters as in the action names."""
    total = F.lit(0.0)
    for letter, cost in costs.items():
        total = total + F.when(held(bits, BIT_OF[letter]), F.lit(float(cost))).otherwise(F.lit(0.0))
    return total
