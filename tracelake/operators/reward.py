"""Step rewards over decoded pairs, and costs of held buttons."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracelake.functions import ram
from tracelake.functions.actions import press_penalty
from tracelake.operators import events
from tracelake.operators.sequence import running_sum

# Default weights; single letters are the costs of held buttons.
WEIGHTS = {
    "enemy_hp": 1.0, "boss_hp": 1.0, "spread_pick": 20.0, "rapid_fire": 10.0, "levelup": 1.0, "player_die": -15.0,
    "push_right": 0.1, "push_inside": 1.0, "room_enter": 1.0, "core_broken": 1.0, "push_up": 1.0,
    "F": -0.3, "J": -0.3, "U": 0.0, "D": 0.0, "L": 0.0, "R": 0.0,
}
COSTS = ("F", "J", "U", "D", "L", "R")


def with_costs(weights: dict[str, float], costs: dict[str, float | None]) -> dict[str, float]:
    """Weights with other costs; None keeps, an unknown letter is an error."""
    if bad := set(costs) - set(COSTS):
        raise ValueError(f"no such costs: {sorted(bad)}")
    return weights | {k: float(v) for k, v in costs.items() if v is not None}


def hp_lost(boss: bool) -> Column:
    """Sum of the positive decrements of the boss slots, or of the others."""
    kinds = ram.boss_types(F.col("pre_level"))
    lost = F.filter(ram.live_slots(F.col("pre_slots"), F.col("slots"), F.col("pre_level")), lambda s: (s["pre_hp"] > s["cur_hp"]) & (F.array_contains(kinds, s["type"]) == boss))
    return F.aggregate(lost, F.lit(0), lambda t, s: t + s["pre_hp"] - s["cur_hp"]).cast("double")


def components(weights: dict[str, float] = WEIGHTS) -> dict[str, Column]:
    """Weighted parts of the reward of a pair; advancement counts only in the style of the level, and not while the boss scene scrolls."""
    tag, style = events.event_by_tag, ram.advance_style(F.col("pre_level"))
    parts = {
        "enemy_hp": hp_lost(False), "boss_hp": hp_lost(True), "spread_pick": tag("pick_spread") - tag("lose_spread"), "rapid_fire": tag("pick_rapid_fire"),
        "levelup": tag("clear_level"), "player_die": tag("die"),
    }
    for name, (kind, value) in events.march().items():
        on = style == kind
        if name == "push_right":
            on &= ~F.coalesce(events.scene(), F.lit(False))
        parts[name] = F.when(on, value).otherwise(0.0)
    return {n: v * float(weights[n]) for n, v in parts.items()}


def rewarded(pairs: DataFrame, weights: dict[str, float] = WEIGHTS, bits: str | None = None) -> DataFrame:
    """trace_id, step, a column per component, ``reward`` and its running sum ``total``."""
    parts = components(weights)
    t = pairs.select("trace_id", "step", *[v.alias(n) for n, v in parts.items()], (press_penalty(F.col(bits), {c: weights[c] for c in COSTS}) if bits else F.lit(0.0)).alias("presses"))
    total = F.col("presses")
    for n in parts:
        total = total + F.col(n)
    return running_sum(t.withColumn("reward", total), ["trace_id"], ["step"], F.col("reward"), "total")
