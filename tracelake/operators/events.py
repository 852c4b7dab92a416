"""Events over consecutive decoded steps: a registry of tag -> Column over the pair (``pre_x``, ``x``).

``wide`` computes all registered tags in one projection after one ``lag`` pass; ``long_log`` keeps what is not zero, one row per tag. An unknown tag
is a KeyError. March events are registered apart from the narrative log, as they fire on most steps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracelake.functions import ram
from tracelake.operators.sequence import paired

PAIRED = ["level", "routine", "lives", "weapon", "rapid", "invincibility", "falcon", "gun_ani", "xscroll", "scroll_hi", "scroll_off", "stop_scroll", "indoor_cleared", "player_adv", "player_state", "slots"]
KILL_SKIP = (0x00, 0x01, 0x0A, 0x0B, 0x0F)  # fixed values: slot types that are no enemies to kill
TARGET_SKIP = (0, 1, 9, 0xA, 0xB, 0xD, 0xF)  # fixed values: types that are no targets; besides soldiers (5), and 0x13 on level 2


def _one(flag: Column) -> Column:
    return F.coalesce(flag, F.lit(False)).cast("double")


def kill(kind: int, level: int | None = None) -> Column:
    """How many slots of a type fall from hp > 0 to 0."""
    n = F.size(F.filter(ram.live_slots(F.col("pre_slots"), F.col("slots"), F.col("pre_level")), lambda s: (s["type"] == kind) & (s["pre_hp"] > 0) & (s["cur_hp"] == 0)))
    ok = F.lit(True) if level is None else F.col("pre_level") == level
    return F.when(ok & F.col("pre_slots").isNotNull(), n).otherwise(0).cast("double")


def weapon_change(now: int | None = None, before: int | None = None) -> Column:
    flag = F.col("weapon") != F.col("pre_weapon")
    if now is not None:
        flag &= F.col("weapon") == now
    if before is not None:
        flag &= F.col("pre_weapon") == before
    return _one(flag)


def avoided(gun: int) -> Column:
    """Items of a gun other than the held one that left the screen while the weapon stayed the same."""
    both = F.zip_with(F.col("pre_slots"), F.col("slots"), lambda p, c: F.struct(((p["type"] == 0) & (p["routine"] != 0)).alias("was"), ((c["type"] == 0) & (c["routine"] != 0)).alias("is"), p["attr"].bitwiseAND(7).alias("attr")))
    n = F.size(F.filter(both, lambda s: s["was"] & ~s["is"] & (s["attr"] == gun)))
    return F.when((F.col("weapon") == F.col("pre_weapon")) & (F.col("weapon") != gun), n).otherwise(0).cast("double")


def _rose(c: str) -> Column:
    return _one(F.col(c) > F.col(f"pre_{c}"))


def scene(prefix: str = "") -> Column:
    return ram.boss_scene(F.col(f"{prefix}stop_scroll"), F.col(f"{prefix}slots"), F.col(f"{prefix}level"))


def registry(level: int | None = None) -> dict[str, tuple[str, Column]]:
    """tag -> (type, value) of the narrative events; ``level`` (from 0) restricts the enemies of levels to that one."""
    out: dict[str, tuple[str, Column]] = {}
    for k, name in ram.COMMON_TYPES.items():
        if k not in KILL_SKIP and name != "Unused":
            out["kill_" + name.lower().replace(" ", "_")] = ("kill", kill(k))
    by_name: dict[str, list[Column]] = {}
    for lv, names in ram.LEVEL_TYPES.items():
        for k, name in names.items():
            if level in (None, lv):
                by_name.setdefault("kill_" + name.lower().replace(" ", "_"), []).append(kill(k, lv))
    for tag, parts in by_name.items():
        total = parts[0]
        for p in parts[1:]:
            total = total + p
        out[tag] = ("kill", total)
    for w in (1, 2, 3, 4):
        out["pick_" + ram.WEAPONS[w].lower()] = ("weapon", weapon_change(now=w))
    out["lose_spread"] = ("weapon", weapon_change(before=3))
    for w in ram.GUN_ATTRS:
        out["avoid_" + ram.WEAPONS[w].lower()] = ("item", avoided(w))
    c = F.col
    out["pick_rapid_fire"] = ("powerup", _one((c("gun_ani") == 0x1F) & (c("pre_gun_ani") != 0x1F) & (c("weapon") == c("pre_weapon")) & c("rapid") & ~c("pre_rapid")))
    out |= {"pick_barrier": ("powerup", _rose("invincibility")), "pick_falcon": ("powerup", _rose("falcon")), "gain_life": ("powerup", _rose("lives"))}
    out["die"] = ("terminal", _one((c("pre_player_state") != 2) & ((c("death_flag") != 0) | (c("player_state") == 2))))
    out["clear_level"] = ("terminal", _rose("level"))
    out["clear_game"] = ("terminal", _one((c("pre_level") == 7) & (c("level") > 7)))
    start = (0, 1, 2, 3)
    out["in_boss_stage"] = ("stage", _one(scene() & ~scene("pre_")))
    out["in_begin"] = ("stage", _one(c("pre_routine").isin(*start) & (c("routine") == 4)))
    out["in_level_transition"] = ("stage", _one(~c("pre_routine").isin(8, 9) & c("routine").isin(8, 9)))
    out["in_title"] = ("stage", _one(c("routine").isin(*start)))
    return out


def march() -> dict[str, tuple[str, Column]]:
    """tag -> (style of level, value) of the advancement events; ``push_right`` is signed."""
    c = F.col
    return {
        "push_right": ("forward", F.coalesce(c("xscroll") - c("pre_xscroll"), F.lit(0)).cast("double")),
        "push_up": ("up", F.coalesce(ram.yscroll_delta(c("pre_scroll_off"), c("scroll_off")), F.lit(0)).cast("double")),
        "core_broken": ("inside", _one((c("pre_indoor_cleared") == 0) & (c("indoor_cleared") != 0))),
        "push_inside": ("inside", _one(c("player_adv") != 0)),
        "room_enter": ("inside", _rose("scroll_hi")),
    }


_BUILT: dict[str, dict[str, tuple[str, Column]]] = {}  # the registry of the running application: building it takes hundreds of calls to the JVM


def event_by_tag(tag: str) -> Column:
    from pyspark import SparkContext

    app = SparkContext._active_spark_context.applicationId if SparkContext._active_spark_context else ""
    if app not in _BUILT:
        _BUILT.clear()
        _BUILT[app] = registry()
    return _BUILT[app][tag][1]


def step_pairs(steps: DataFrame) -> DataFrame:
    """Decoded steps with their predecessors' columns (the first step of a trace has none and is left out)."""
    return paired(steps, ["trace_id"], ["step"], PAIRED).where("pre_level IS NOT NULL")


def long_log(pairs: DataFrame, level: int | None = None) -> DataFrame:
    """trace_id, step, tag, value, type of every event that fires."""
    rows = F.array(*[F.struct(F.lit(t).alias("tag"), v.alias("value"), F.lit(k).alias("type")) for t, (k, v) in registry(level).items()])
    return pairs.select("trace_id", "step", F.inline(F.filter(rows, lambda r: r["value"] != 0)))


def outcomes(log: DataFrame) -> DataFrame:
    from tracelake.operators.sequence import outcome

    return outcome(log, ["trace_id"], "tag", {"game_clear": ["clear_game"], "level_up": ["clear_level", "in_level_transition"]}, "lose")


def is_target(kind: Column, level: Column) -> Column:
    return ~kind.isin(*TARGET_SKIP, 5) & ~((kind == 0x13) & (level == 2))
