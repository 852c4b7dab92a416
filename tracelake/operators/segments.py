"""Segments cut from decoded steps: extraction plug-ins, gates, goal frames and points, start states, features.

steps: trace_id, step (number of the observation; 0 is the one before any action) and the columns of ``functions.ram.decoded``; ``bits``, where a function needs
it, is the action that led to the observation. A window from start_step to end_step holds end_step - start_step + 1 actions.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import Protocol

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracelake.functions import ram
from tracelake.operators import events, sequence
from tracelake.operators.expectations import require

C = F.col


# ---- extraction -------------------------------------------------------------------------------------------------------


def slot_steps(steps: DataFrame) -> DataFrame:
    """trace_id, step, slot and the slot's columns, one row per slot (16 a step)."""
    return steps.select("trace_id", "step", "level", F.inline("slots"))


def before_boss(steps: DataFrame, on_previous: bool = False) -> DataFrame:
    """Steps before the first boss scene; ``on_previous`` keeps the step that enters it (the test is on the step before)."""
    w = Window.partitionBy("trace_id").orderBy("step")
    seen = F.max(F.coalesce(events.scene(), F.lit(False)).cast("int")).over(w.rowsBetween(Window.unboundedPreceding, -1 if on_previous else 0))
    return steps.withColumn("_seen", F.coalesce(seen, F.lit(0))).where("_seen = 0").drop("_seen")


def kill_windows(steps: DataFrame) -> DataFrame:
    """trace_id, slot, start_step, end_step, kind, level, x, y (of the slot at the kill) of every target that spawns and is killed, before the boss scene."""
    s = slot_steps(before_boss(steps.where("step > 0")))
    got = sequence.slot_lifecycle(s, ["trace_id", "slot"], "step", C("type"), C("hp"), C("routine") != 0, carry=("level", "x", "y"))
    return got.where(events.is_target(C("kind"), C("level"))).select(
        "trace_id", "slot", C("spawn_step").alias("start_step"), C("kill_step").alias("end_step"), "kind", "level", "x", "y", ram.type_name(C("kind"), C("level")).alias("label"))


PICKUPS = {**{w: f"pick_{ram.WEAPONS[w].lower()}" for w in ram.GUN_ATTRS}, 0: "pick_rapid_fire", 5: "pick_barrier", 6: "pick_falcon"}  # event of an item's pickup, by its attribute


def item_windows(steps: DataFrame, require_armed: bool = True) -> DataFrame:
    """trace_id, slot, start_step (birth), end_step (removal), attr, carrier, outcome, label, level, source, seen (was it on the screen at its birth?) of every item
    that is picked or avoided before the boss scene; items that just leave have no outcome."""
    pairs = events.step_pairs(before_boss(steps))
    own = F.lit(0.0)
    for a, tag in PICKUPS.items():
        own = F.when(C("attr") == a, C(f"_{tag}")).otherwise(own)
    fired = {f"_{t}": events.event_by_tag(t) for t in PICKUPS.values()}
    s = pairs.where("step > 0").withColumns(fired).select("trace_id", "step", "level", C("weapon").alias("_gun"), *fired, F.inline("slots"))
    item = (C("type") == 0) & (C("routine") != 0)
    got = sequence.item_lifecycle(s, ["trace_id", "slot"], "step", C("type"), C("routine") != 0, item, C("attr"), carry=("level", "_gun", *fired), born={"seen": ram.on_screen(C("x"), C("y"))})
    got = sequence.pick_or_avoid(got, own > 0, C("attr"), C("_gun"), ram.GUN_ATTRS, require_armed)
    source = F.when(C("carrier") != 0, ram.type_name(C("carrier"), C("level"))).otherwise("")
    return got.select("trace_id", "slot", C("birth_step").alias("start_step"), C("removal_step").alias("end_step"), "attr", "carrier", "outcome",
                      F.concat_ws("_", "outcome", F.lower(ram.item_label(C("attr")))).alias("label"), "level", source.alias("source"), "seen")


def cleared() -> Column:
    """Over a pair of steps: the level rose, or the transition after a boss began."""
    return (events.event_by_tag("clear_level") > 0) | (events.event_by_tag("in_level_transition") > 0)


def boss_windows(pairs: DataFrame) -> DataFrame:
    """trace_id, start_step (first rising boss scene), end_step (level cleared, strictly after), level, weapon and rapid before the start, peak_hp from just before the start
    on. Traces that don't clear are left out."""
    p = pairs.withColumns({"_edge": events.event_by_tag("in_boss_stage") > 0, "_clear": cleared(), "_hp": ram.boss_hp(C("slots"), C("level")), "_pre_hp": ram.boss_hp(C("pre_slots"), C("pre_level"))})
    ends = sequence.first_and_after(p, ["trace_id"], "step", C("_edge"), C("_clear")).where("end_step IS NOT NULL")
    at = C("step") == C("start_step")
    return p.join(ends, "trace_id").where("step >= start_step AND step <= end_step").groupBy("trace_id", "start_step", "end_step").agg(
        F.max(F.greatest("_hp", F.when(at, C("_pre_hp")))).alias("peak_hp"), F.max(F.when(at, C("pre_level"))).alias("level"),
        F.max(F.when(at, ram.weapon_label(C("pre_weapon")))).alias("weapon"), F.max(F.when(at, C("pre_rapid"))).alias("rapid")).withColumn("label", F.concat(F.lit("boss_level"), (C("level") + 1).cast("string")))


def on_ground() -> Column:
    return (C("water_state").bitwiseAND(4) == 0) & (C("jump_status").bitwiseAND(15) == 0) & (C("edge_fall") == 0)


def ground_windows(steps: DataFrame, gap: int = 100, latest_start: int = 100) -> DataFrame:
    """trace_id, start_step, end_step, level, start_x, end_x, end_y: consecutive anchors more than ``gap`` steps apart among the steps on the ground before the boss
    scene; the chain starts at a hashed step below ``latest_start``."""
    t = before_boss(steps, on_previous=True)
    t = t.where(on_ground()).withColumn("_from", F.pmod(F.xxhash64("trace_id"), F.lit(latest_start + 1)).cast("double"))
    got = sequence.chain_pairs(sequence.anchor_chain(t, ["trace_id"], "step", gap, start=C("_from")), ["trace_id"]).select("trace_id", C("from_step").alias("start_step"), C("to_step").alias("end_step"))
    place = t.select("trace_id", "step", "level", (C("xscroll") + C("player_x")).alias("x"), C("player_y").alias("y"))
    a = place.select("trace_id", C("step").alias("start_step"), "level", C("x").alias("start_x"))
    b = place.select("trace_id", C("step").alias("end_step"), C("x").alias("end_x"), C("y").alias("end_y"))
    return got.join(a, ["trace_id", "start_step"]).join(b, ["trace_id", "end_step"]).withColumn("label", F.concat(F.lit("level"), (C("level") + 1).cast("string")))


# ---- gates ------------------------------------------------------------------------------------------------------------


def fired_between(windows: DataFrame, steps: DataFrame, bits: str = "bits") -> DataFrame:
    """Adds ``fired``: some step of the window holds fire. The number of shots before a step is a running sum, so a window needs two of its rows and no range join."""
    w = Window.partitionBy("trace_id").orderBy("step").rowsBetween(Window.unboundedPreceding, 0)
    run = steps.select("trace_id", "step", F.sum(F.when(C(bits).bitwiseAND(1) != 0, 1).otherwise(0)).over(w).alias("_n"), F.when(C(bits).bitwiseAND(1) != 0, 1).otherwise(0).alias("_own"))
    a = run.select("trace_id", C("step").alias("start_step"), (C("_n") - C("_own")).alias("_a"))
    b = run.select("trace_id", C("step").alias("end_step"), C("_n").alias("_b"))
    return windows.join(a, ["trace_id", "start_step"], "left").join(b, ["trace_id", "end_step"], "left").withColumn("fired", F.coalesce(C("_b") > C("_a"), F.lit(False))).drop("_a", "_b")


def gated(windows: DataFrame, reasons: list[tuple[str, Column]], label: str | None = None, cap: int | None = None, order: list[str] | None = None) -> DataFrame:
    """Adds ``reason``: the first gate that rejects (null: kept). With a cap a label keeps its first ``cap`` segments in order; what comes later is ``capped``, whatever
    the other gates say, as the cap is asked first."""
    out = F.lit(None).cast("string")
    for name, bad in reversed(reasons):
        out = F.when(F.coalesce(bad, F.lit(False)), name).otherwise(out)
    t = windows.withColumn("reason", out)
    if cap is None:
        return t
    w = Window.partitionBy(label).orderBy(*order)
    kept_before = F.coalesce(F.sum(F.when(C("reason").isNull(), 1).otherwise(0)).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return t.withColumn("_k", kept_before).withColumn("reason", F.when(C("_k") >= cap, "capped").otherwise(C("reason"))).drop("_k")


def verified(windows: DataFrame, goals: DataFrame, key: list[str]) -> DataFrame:
    """Adds ``reached``: a goal (key, step) lies in the window. Goals and windows are merged in the order of steps, and a window looks back at the last
    goal, so no goal meets more than its neighbours."""
    w = Window.partitionBy(*key).orderBy("_at", "_window").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    both = windows.withColumns({"_at": C("end_step"), "_window": F.lit(1), "_goal": F.lit(None).cast("int")}).unionByName(
        goals.select(*key, C("step").alias("_at"), F.lit(0).alias("_window"), C("step").cast("int").alias("_goal")), allowMissingColumns=True)
    last = F.last("_goal", ignorenulls=True).over(w)
    return both.withColumn("reached", F.coalesce(last >= C("start_step"), F.lit(False))).where("_window = 1").drop("_at", "_window", "_goal")


def kill_goals(pairs: DataFrame) -> DataFrame:
    """trace_id, slot, step: hit points of the slot fell from above 0 to 0."""
    fell = F.zip_with("pre_slots", "slots", lambda p, c: F.struct(c["slot"].alias("slot"), ((p["hp"] > 0) & (c["hp"] == 0)).alias("fell")))
    return pairs.select("trace_id", "step", F.inline(F.filter(fell, lambda s: s["fell"]))).drop("fell")


def item_goals(pairs: DataFrame) -> DataFrame:
    """trace_id, outcome, attr, step: an item's own event: its pickup, or a gun that left while the held one stayed."""
    tags = [("pick", a, t) for a, t in PICKUPS.items()] + [("avoid", a, f"avoid_{ram.WEAPONS[a].lower()}") for a in ram.GUN_ATTRS]
    rows = F.array(*[F.struct(F.lit(o).alias("outcome"), F.lit(a).alias("attr"), (events.event_by_tag(t) > 0).alias("fires")) for o, a, t in tags])
    return pairs.select("trace_id", "step", F.inline(F.filter(rows, lambda r: r["fires"]))).drop("fires")


def muted(tasks: DataFrame, fire: int = 1) -> DataFrame:
    """Recordings (trace_id, initial_state, codes, skip) with the fire button never pressed, to be replayed by ``steps_of``."""
    return tasks.withColumn("codes", F.transform("codes", lambda c: c.bitwiseAND(~fire)))


def stray(windows: DataFrame, tasks: DataFrame, make) -> DataFrame:
    """Adds ``stray`` to kill windows: replayed from its start with fire muted, the pinned slot still dies, so the shot was fired before.

    tasks: uid, initial_state, codes, skip of the windows, which have the same ``uid``. ``make`` gives the simulator."""
    from tracelake.functions.ram import decoded

    played = steps_of(muted(tasks.withColumn("trace_id", C("uid"))), make).select("trace_id", "step", *decoded(C("ram")))
    died = kill_goals(events.step_pairs(played)).select(C("trace_id").alias("uid"), "slot").distinct().withColumn("stray", F.lit(True))
    return windows.join(died, ["uid", "slot"], "left").withColumn("stray", F.coalesce("stray", F.lit(False)))


def report(windows: DataFrame) -> DataFrame:
    """Segments per reason, the kept ones under ``kept``."""
    return windows.groupBy(F.coalesce("reason", F.lit("kept")).alias("reason")).agg(F.count("*").alias("n"))


# ---- goal frames and labels --------------------------------------------------------------------------------------------


def boss_parts(slots: Column) -> Column:
    """Positions of the live slots on the screen that aren't bullets."""
    return F.transform(F.filter(slots, lambda s: (s["routine"] != 0) & (s["type"] != 1) & ram.on_screen(s["x"], s["y"])), ram.xy)


def goal_points(kind: Column, slots: Column, slot: Column, target_x: Column, target_y: Column, left_edge: Column) -> Column:
    """Points and visibility of a goal. kind ``last``: a world position moved by the left edge, visible inside the screen's width; ``boss``: its parts; else the
    pinned slot, if live, visible on the screen."""
    sx = target_x - left_edge
    one = F.try_element_at(F.filter(slots, lambda s: (s["slot"] == slot) & (s["routine"] != 0)), F.lit(1))
    parts = boss_parts(slots)
    none = F.array().cast("array<struct<x:int,y:int>>")
    last = F.struct(F.array(F.struct(sx.cast("int").alias("x"), target_y.cast("int").alias("y"))).alias("points"), ((sx >= 0) & (sx < 256)).alias("visible"))
    boss = F.struct(parts.alias("points"), (F.size(parts) > 0).alias("visible"))
    pinned = F.struct(F.when(one.isNotNull(), F.array(ram.xy(one))).otherwise(none).alias("points"), F.coalesce(ram.on_screen(one["x"], one["y"]), F.lit(False)).alias("visible"))
    return F.when(kind == "last", last).when(kind == "boss", boss).otherwise(pinned)


def goal_frame(frames: DataFrame, key: list[str], kind: str, points: str = "points") -> DataFrame:
    """The goal's frame per key: ``first`` frame with a point (else the first of all), the ``last`` frame, or for ``boss`` the one with most points (the earliest)."""
    n = F.size(points)
    pick = {"first": F.coalesce(F.min(F.when(n > 0, C("step"))), F.min("step")), "last": F.max("step"), "boss": F.max_by("step", F.struct(n, -C("step")))}[kind]
    return frames.groupBy(*key).agg(pick.alias("goal_step"))


def label_mismatches(frames: DataFrame) -> DataFrame:
    """checked, mismatches: of the visible centroids of each frame, how many aren't among its enemies and enemy bullets."""
    live = F.concat(F.coalesce("enemies", F.array().cast("array<struct<x:int,y:int>>")), F.coalesce("enemy_bullets", F.array().cast("array<struct<x:int,y:int>>")))
    t = frames.where("visible").select(F.transform("centroids", lambda p: F.array_contains(live, p)).alias("_ok"))
    return t.agg(F.coalesce(F.sum(F.size("_ok")), F.lit(0)).alias("checked"), F.coalesce(F.sum(F.size(F.filter("_ok", lambda x: ~x))), F.lit(0)).alias("mismatches"))


def sample_points(steps: DataFrame, width: int = 240, height: int = 224) -> DataFrame:
    """trace_id, step, class, points in the crop: player, enemy, and projectile (bullets of the player and of enemies)."""
    e = ram.entities(C("slots"), C("bullets"), C("player_x"), C("player_y"))
    t = steps.select("trace_id", "step", e.alias("e"))
    rows = F.array(F.struct(F.lit("player").alias("class"), F.array("e.player").alias("points")), F.struct(F.lit("enemy").alias("class"), C("e.enemies").alias("points")),
                   F.struct(F.lit("projectile").alias("class"), F.concat("e.player_bullets", "e.enemy_bullets").alias("points")))
    return t.select("trace_id", "step", F.inline(rows)).withColumn("points", ram.visible_points(C("points"), width, height))


# ---- lineage, start states, features -----------------------------------------------------------------------------------


def boss_boundary(steps: DataFrame) -> DataFrame:
    """First observation (0 allowed) of the boss scene per trace, with the weapon held; traces without one are an error."""
    t = steps.groupBy("trace_id").agg(F.min(F.when(events.scene(), C("step"))).alias("boundary"), F.min_by(F.when(events.scene(), F.struct("weapon", "rapid")), F.when(events.scene(), C("step"))).alias("_w"))
    return t.select("trace_id", F.coalesce("boundary", F.raise_error(F.concat(F.lit("no boss scene in "), C("trace_id"))).cast("int")).alias("boundary"), "_w.weapon", "_w.rapid")


def boss_loadout(traces: DataFrame, steps: DataFrame) -> DataFrame:
    """Weapon at the boss entry per trace, from the best source there is: fields of the trace, its older fields (entry 0), the first scene
    (entry 0), the first rising edge, else not reached (-1)."""
    w = Window.partitionBy("trace_id").orderBy("step")
    s = steps.withColumns({"_now": F.coalesce(events.scene(), F.lit(False))}).withColumn("_edge", C("_now") & ~F.coalesce(F.lag("_now").over(w), F.lit(False)))
    first = s.where("_edge").groupBy("trace_id").agg(F.min("step").alias("_at"), F.min_by("weapon", "step").alias("_w"), F.min_by("rapid", "step").alias("_r"))
    t = traces.join(first, "trace_id", "left")
    own, old, met = (C("boss_entry_step") >= 0) & C("boss_weapon").isNotNull() & C("boss_rapid").isNotNull(), C("weapon").isNotNull() & C("rapid").isNotNull(), C("_at").isNotNull()
    pick = lambda a, b, c, d: F.when(own, a).when(old, b).when(met, c).otherwise(d)
    return t.select("trace_id", pick(C("boss_weapon"), C("weapon"), ram.weapon_label(C("_w")), F.lit(None)).alias("boss_weapon"), pick(C("boss_rapid"), C("rapid"), C("_r"), F.lit(None)).alias("boss_rapid"),
                    pick(C("boss_entry_step"), F.lit(0), F.greatest(C("_at") - 1, F.lit(0)), F.lit(-1)).alias("boss_entry_step"),
                    pick(F.lit("trace"), F.lit("legacy_trace"), F.when(C("_at") == 0, "replay_initial").otherwise("replay"), F.lit("replay_not_reached")).alias("source"))


def with_start_states(tasks: DataFrame, bank: DataFrame) -> DataFrame:
    """Tasks with the bank entry of their start state (by SHA-256); a state that isn't in the bank, or a split, source or skip that differs, is an error."""
    t = tasks.withColumn("state_sha256", F.sha2("initial_state", 256)).join(bank.select("state_sha256", C("split").alias("_split"), C("source_task").alias("_source"), C("skip").alias("_skip")), "state_sha256", "left")
    ok = C("_source").isNotNull() & C("_split").eqNullSafe(C("split")) & C("_skip").eqNullSafe(C("skip"))
    return t.withColumn("source_task", F.when(ok, C("_source")).otherwise(F.raise_error(F.concat(F.lit("start state of "), C("uid"), F.lit(" doesn't fit the bank"))).cast("string"))).drop("_split", "_source", "_skip")


def signature(steps: DataFrame, bins: int = 20) -> DataFrame:
    """trace_id, bin, idx, f0..f7: progress-aligned state of a fight: time, player x and y, in the air, in water, player bullets, enemy bullets, distance to the nearest."""
    w = Window.partitionBy("trace_id").orderBy("step")
    e = ram.entities(C("slots"), C("bullets"), C("player_x"), C("player_y"))
    t = steps.withColumns({"_e": e, "_hp": ram.boss_hp(C("slots"), C("level"))})
    t = t.withColumns({"_fall": F.coalesce(F.lag("_hp").over(w) - C("_hp"), F.lit(0)), "_i": F.row_number().over(w) - 1, "_n": F.count("*").over(Window.partitionBy("trace_id"))}).where("_i > 0")
    water = C("water_state").bitwiseAND(4) != 0
    ground = (C("jump_status").bitwiseAND(15) == 0) & (C("edge_fall") == 0)
    near = F.coalesce(F.least(ram.nearest_distance(C("_e.enemy_bullets"), C("player_x"), C("player_y")) / 350.0, F.lit(1.0)), F.lit(1.0))
    one = lambda c: F.coalesce(c, F.lit(False)).cast("double")
    feats = [(C("_i") - 1) / F.greatest(C("_n") - 2, F.lit(1)), C("player_x") / 255.0, C("player_y") / 239.0, one(~water & ~ground), one(water), F.least(F.lit(1.0), F.size("_e.player_bullets") / 4.0), F.least(F.lit(1.0), F.size("_e.enemy_bullets") / 16.0), near]
    return sequence.state_signature(t, ["trace_id"], "step", C("_fall"), feats, bins)


# Keys of ``meta`` that a release carries along.
PASSED_ON = ("target_entity", "source_entity", "item_weapon", "kind", "start_seg", "end_seg", "weapon", "rapid", "boss_hp_start", "offset_frac", "batch_id", "stage", "source_task", "source_offset",
             "initial_state_name", "initial_state_sha256", "raw_trace", "trace_fingerprint", "diversity_nearest_uid", "diversity_nearest_distance")


def passed_on(meta: Column) -> Column:
    """The entries of ``meta`` that a release carries along."""
    return F.map_filter(meta, lambda k, v: k.isin(*PASSED_ON))


def boss_metadata(tasks: DataFrame, steps: DataFrame) -> DataFrame:
    """Boss tasks (uid, meta) with ``weapon`` and ``rapid`` of their opening observation, and, unless derived from another task, the most hit points the boss shows
    (``boss_hp_start``) and an offset of 0. steps: of the task's own replay, trace_id is the uid. A task without steps is an error."""
    t = steps.withColumn("_hp", ram.boss_hp(C("slots"), C("level"))).groupBy(C("trace_id").alias("uid")).agg(
        F.min_by(ram.weapon_label(C("weapon")), "step").alias("_weapon"), F.min_by("rapid", "step").alias("_rapid"), F.max("_hp").alias("_hp"))
    both = tasks.join(t, "uid", "left")
    weapon = F.coalesce("_weapon", F.raise_error(F.concat(F.lit("no steps of boss task "), C("uid"))).cast("string"))
    own = F.map_from_arrays(F.array(F.lit("weapon"), F.lit("rapid")), F.array(weapon, C("_rapid").cast("string")))
    full = F.map_from_arrays(F.array(F.lit("boss_hp_start"), F.lit("offset_frac")), F.array(C("_hp").cast("string"), F.lit("0.0")))
    new = F.when(F.try_element_at("meta", F.lit("source_task")).isNull(), F.map_concat(own, full)).otherwise(own)
    kept = F.map_filter(F.coalesce("meta", F.create_map().cast("map<string,string>")), lambda k, v: ~F.map_contains_key(new, k))
    return both.withColumn("meta", F.map_concat(kept, new)).drop("_weapon", "_rapid", "_hp")


def replay_report(pairs: DataFrame, goal: Column) -> DataFrame:
    """Per replayed trace: does it reach its goal (``replay_valid``), with which weapon (``spread_equipped``: the spread gun), in how many steps."""
    at = F.min(F.when(goal, C("step")))
    t = pairs.groupBy("trace_id").agg(at.alias("goal_step"), F.min_by(F.when(goal, F.struct("weapon", "rapid")), F.when(goal, C("step"))).alias("_w"), F.max("step").alias("trace_steps"))
    return t.select("trace_id", C("goal_step").isNotNull().alias("replay_valid"), "goal_step", "_w.weapon", "_w.rapid", F.coalesce(C("_w.weapon") == 3, F.lit(False)).alias("spread_equipped"), "trace_steps")


def goal_of(name: str, level: int | None = None) -> Column:
    """The goals of a search over a pair of steps: ``boss_entry``, ``game_clear``, ``level_up`` (the transition, or the level isn't ``level`` any more)."""
    if name == "boss_entry":
        return events.event_by_tag("in_boss_stage") > 0
    if name == "game_clear":
        return events.event_by_tag("clear_game") > 0
    if name != "level_up":
        raise KeyError(name)
    changed = C("level") != (C("pre_level") if level is None else F.lit(level))
    return (events.event_by_tag("in_level_transition") > 0) | changed


def newest_path(tasks: DataFrame) -> DataFrame:
    """One row per uid: the last path in order wins."""
    return tasks.groupBy("uid").agg(F.max("path").alias("path"))


def release_split(tasks: DataFrame, held_out: DataFrame) -> DataFrame:
    """Release partition: the validation set overrides the written split, which is kept as ``source_split``."""
    t = tasks.withColumn("source_split", C("split")).join(held_out.select("uid").distinct().withColumn("_v", F.lit(True)), "uid", "left")
    return t.withColumn("split", F.when(C("_v"), "val").otherwise("train")).drop("_v")


def steps_of(traces: DataFrame, make, schema: str = "trace_id string, step int, ram binary") -> DataFrame:
    """Snapshots of recordings by replaying them: ``make()`` gives a simulator with ``start(initial_state) -> ram`` and ``act(code, skip) -> ram``. A recording of N
    actions has N + 1 observations. traces: trace_id, initial_state, codes, skip."""
    import pandas as pd

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sim = make()
        for part in parts:
            for r in part.itertuples(index=False):
                rows = [(r.trace_id, 0, sim.start(bytes(r.initial_state)))]
                rows += [(r.trace_id, i + 1, sim.act(int(c), int(r.skip))) for i, c in enumerate(r.codes)]
                yield pd.DataFrame(rows, columns=["trace_id", "step", "ram"])

    return traces.select("trace_id", "initial_state", "codes", "skip").mapInPandas(run, schema)


def encoded(frames: DataFrame, key: list[str], image: str, make, batch: int = 256) -> DataFrame:
    """Token vectors of images: ``make()`` loads an encoder once per task, called with a list of images and giving an array of vectors."""
    import pyarrow as pa

    schema = ", ".join(f"{c} {t}" for c, t in frames.select(*key).dtypes) + ", vec array<float>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = make()
        for b in batches:
            for at in range(0, b.num_rows, batch):
                part = b.slice(at, batch)
                vecs = model(part.column(image).to_pylist())
                require(len(vecs) == part.num_rows, "the encoder gave another number of vectors")
                yield pa.RecordBatch.from_arrays([*[part.column(c) for c in key], pa.array([list(map(float, v)) for v in vecs], pa.list_(pa.float32()))], names=[*key, "vec"])

    return frames.select(*key, image).mapInArrow(run, schema)


# ---- plug-ins ---------------------------------------------------------------------------------------------------------


class TaskMaker(Protocol):
    """A kind of task: windows out of steps, the gates in their order, and the goals (``goal_key`` and step)."""

    name: str
    goal_key: list[str]

    def extract(self, steps: DataFrame) -> DataFrame: ...
    def reject(self) -> list[tuple[str, Column]]: ...
    def goals(self, pairs: DataFrame, windows: DataFrame) -> DataFrame: ...


def _length() -> Column:
    return C("end_step") - C("start_step") + 1


class KillMaker:
    """Kills of a target that came on stage in the window, died on the screen, and was shot at in the window."""

    name, goal_key = "kill", ["trace_id", "slot"]

    def __init__(self, shortest: int = 2, longest: int = 240):
        self.shortest, self.longest = shortest, longest

    def extract(self, steps: DataFrame) -> DataFrame:
        w = kill_windows(steps)
        return fired_between(w, steps) if "bits" in steps.columns else w.withColumn("fired", F.lit(None).cast("boolean"))  # unknown: not a reason

    def reject(self) -> list[tuple[str, Column]]:
        return [("too short", _length() < self.shortest), ("too long", _length() > self.longest), ("off screen", ~ram.on_screen(C("x"), C("y"))), ("no shot", ~C("fired")), ("dropped", ~C("reached"))]

    def goals(self, pairs: DataFrame, windows: DataFrame) -> DataFrame:
        return kill_goals(pairs)


class ItemMaker:
    """Items that were seen, and picked or (guns only) avoided; a pick takes at least ``shortest_pick`` steps."""

    name, goal_key = "item", ["trace_id", "outcome", "attr"]

    def __init__(self, shortest: int = 2, longest: int = 240, shortest_pick: int = 10, require_armed: bool = True):
        self.shortest, self.longest, self.shortest_pick, self.require_armed = shortest, longest, shortest_pick, require_armed

    def extract(self, steps: DataFrame) -> DataFrame:
        return item_windows(steps, self.require_armed)

    def reject(self) -> list[tuple[str, Column]]:
        n = _length()
        return [("never seen", ~C("seen")), ("no choice", C("outcome").isNull()), ("too short", (n < self.shortest) | ((C("outcome") == "pick") & (n < self.shortest_pick))), ("too long", n > self.longest), ("dropped", ~C("reached"))]

    def goals(self, pairs: DataFrame, windows: DataFrame) -> DataFrame:
        return item_goals(pairs)


class BossMaker:
    """The boss fight of a trace: from the first boss scene to the cleared level."""

    name, goal_key = "boss", ["trace_id"]

    def extract(self, steps: DataFrame) -> DataFrame:
        return boss_windows(events.step_pairs(steps)).withColumn("slot", F.lit(None).cast("int"))

    def reject(self) -> list[tuple[str, Column]]:
        return [("no clear", ~C("reached"))]

    def goals(self, pairs: DataFrame, windows: DataFrame) -> DataFrame:
        return pairs.where(cleared()).select("trace_id", "step")


class TraverseMaker:
    """Ways from one place on the ground to another; reached is the place: as far, as high (within ``tolerance``), on the ground."""

    name, goal_key = "traverse", ["trace_id", "start_step"]

    def __init__(self, gap: int = 100, latest_start: int = 100, tolerance: int = 8):
        self.gap, self.latest_start, self.tolerance = gap, latest_start, tolerance

    def extract(self, steps: DataFrame) -> DataFrame:
        return ground_windows(steps, self.gap, self.latest_start).withColumn("slot", F.lit(None).cast("int"))

    def reject(self) -> list[tuple[str, Column]]:
        return [("dropped", ~C("reached"))]

    def goals(self, pairs: DataFrame, windows: DataFrame) -> DataFrame:
        """Steps of a window at its place. The windows of a trace follow one another, so a step belongs to at most two: the last that began, and the one that ends where it begins."""
        place = pairs.where(on_ground()).select("trace_id", "step", (C("xscroll") + C("player_x")).alias("_x"), C("player_y").alias("_y"))
        ends = windows.select("trace_id", "start_step", "end_step", "end_x", "end_y")
        w = Window.partitionBy("trace_id").orderBy("_at", "_row").rowsBetween(Window.unboundedPreceding, Window.currentRow)
        row = F.struct("start_step", "end_step", "end_x", "end_y")
        both = ends.select("trace_id", (C("start_step") + 1).alias("_at"), F.lit(0).alias("_row"), row.alias("_w")).unionByName(place.withColumns({"_at": C("step"), "_row": F.lit(1)}), allowMissingColumns=True)
        both = both.withColumn("_w", F.last("_w", ignorenulls=True).over(w)).where((C("_row") == 1) & (C("_at") <= C("_w.end_step")))
        return both.where((C("_x") >= C("_w.end_x")) & (F.abs(C("_y") - C("_w.end_y")) <= self.tolerance)).select("trace_id", C("_w.start_step").alias("start_step"), "step")


MAKERS: dict[str, type] = {"kill": KillMaker, "item": ItemMaker, "boss": BossMaker, "traverse": TraverseMaker}


def make_tasks(maker: TaskMaker, steps: DataFrame, cap: int | None = None) -> DataFrame:
    """Windows of a maker with their reasons; ``report`` counts them, kept ones have a null reason."""
    w = maker.extract(steps)
    w = verified(w, maker.goals(events.step_pairs(steps), w), maker.goal_key)
    return gated(w, maker.reject(), "label", cap, ["trace_id", "end_step", "slot"])
