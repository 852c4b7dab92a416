"""Snapshots, events, rewards, terrain: closed-form cases and loop models on random bytes."""

import math
import random

import pytest
from pyspark.sql import functions as F

from tracelake.functions import actions, names, ram
from tracelake.operators import events, reward, terrain


def snapshot(**at):
    b = bytearray(2048)
    for i in range(16):
        b[ram.SLOT_HP + i] = 0xFF
    for k, v in at.items():
        base = getattr(ram, k)
        for i, x in enumerate(v if isinstance(v, (list, tuple)) else [v]):
            b[base + i] = x
    return b


def noise(rng):
    return bytearray(rng.randrange(256) for _ in range(2048))


def test_scalars_against_bytes(spark):
    rng = random.Random(1)
    rams = [noise(rng) for _ in range(40)]
    r = F.col("ram")
    df = spark.createDataFrame([(i, b) for i, b in enumerate(rams)], "i int, ram binary")
    got = df.select("i", ram.xscroll(r).alias("x"), ram.yscroll(r).alias("y"), ram.player_x(r).alias("px"), ram.terrain_state(r).alias("t"), ram.byte(r, 2047).alias("last"), ram.byte(r, F.lit(0xFD)).alias("h"),
                    *[ram.collision(r, F.lit(x), F.lit(y)).alias(f"c{x}_{y}") for x, y in ((0, 0), (8, 100), (255, 223), (130, 239), (77, 160))]).collect()
    for g in got:
        b = rams[g.i]
        assert (g.x, g.y, g.px, g.last, g.h) == (b[100] * 256 + b[101], b[0x64] * 240 + b[0x65], b[100] * 256 + b[101] + b[0x334], b[2047], b[0xFD])
        assert g.t == ("water" if b[0xB2] & 4 else "ground" if b[0xA0] & 15 == 0 and b[0xA4] == 0 else "air")
        for x, y in ((0, 0), (8, 100), (255, 223), (130, 239), (77, 160)):
            world = y + b[0xFC]
            if world > 255 or world & 255 >= 240:
                world = (world & 255) + 16
            column = x + b[0xFD]
            screen = b[0xFF] % 2 if column < 256 else 1 - b[0xFF] % 2
            cell = b[0x680 + 64 * screen + (world & 255) // 16 * 4 + column % 256 // 64]
            want = (0, 1, 2, 0x80)[cell >> (6 - 2 * (column % 64 // 16)) & 3]
            assert g[f"c{x}_{y}"] == (0 if y >= 224 else want)


def test_entities(spark):
    b = snapshot(PLAYER_X=100, PLAYER_Y=80, SLOT_ROUTINE=[1, 1], SLOT_TYPE=[5, 1], SLOT_X=[50, 70], SLOT_Y=[60, 90], BULLET_SLOT=[1, 1], BULLET_X=[110, 9], BULLET_Y=[120, 9], BULLET_OWNER=[0, 1])
    df = spark.createDataFrame([(b,)], "ram binary").select(*ram.decoded(F.col("ram")))
    e = df.select(ram.entities(F.col("slots"), F.col("bullets"), F.col("player_x"), F.col("player_y")).alias("e"), ram.entities(F.col("slots"), F.col("bullets"), F.col("player_x"), F.col("player_y"), None).alias("a")).collect()[0]
    assert e.e.asDict(True) == {"player": {"x": 100, "y": 80}, "enemies": [{"x": 50, "y": 60}], "enemy_bullets": [{"x": 70, "y": 90}], "player_bullets": [{"x": 110, "y": 120}]}
    assert len(e.a.player_bullets) == 2
    d = df.select(ram.nearest_distance(F.array(F.struct(F.lit(103).alias("x"), F.lit(84).alias("y"))), F.col("player_x"), F.col("player_y")).alias("d"), ram.nearest_distance(F.array().cast("array<struct<x:int,y:int>>"), F.col("player_x"), F.col("player_y")).alias("n")).collect()[0]
    assert (d.d, d.n) == (5.0, None)


def test_names(spark):
    rows = [(0, 0), (0x0F, 3), (0x10, 0), (0x10, 7), (0x99, 2), (0x11, None), (0x0D, 0)]
    got = spark.createDataFrame(rows, "k int, lv int").select(ram.type_name(F.col("k"), F.col("lv")).alias("n")).collect()
    assert [r.n for r in got] == ["weapon_item", "basquez_bullet", "bomb_turret", "emperor_demon_dragon_god_java", "0x99", "plated_door", "unused"]
    w = spark.createDataFrame([(3,), (0x13,), (9,)], "w int").select(ram.weapon_label(F.col("w")).alias("n"), ram.is_rapid(F.col("w")).alias("r")).collect()
    assert [(x.n, x.r) for x in w] == [("Spread", False), ("Spread", True), ("Unknown9", False)]
    c = spark.createDataFrame([("Intel Gold 6133", 16), ("Platinum 8468", 8), ("Platinum 8468", 4), ("new", 64), (None, None)], "m string, n int").select(names.cpu_decision(F.col("m"), F.col("n")).alias("d")).collect()
    assert [x.d for x in c] == ["drop", "keep", "drop", "unknown", "drop"]
    p = spark.createDataFrame([("root/level3/full/x/batches/w7/c.json",)], "p string").select(names.marker_location(F.col("p")).alias("m"), names.object_uri(F.lit("s3://b/a/c/")).alias("u")).collect()[0]
    assert (p.m.level, p.m.scope, p.m.worker, p.u.bucket, p.u.prefix) == (3, "full", "w7", "b", "a/c")
    with pytest.raises(Exception, match="not a marker path"):
        spark.createDataFrame([("root/levels/full",)], "p string").select(names.marker_location(F.col("p")).alias("m")).collect()
    lr = spark.range(0, 30, 10).select(names.warmup_cosine(F.col("id"), 1.0, 10, 20).alias("a"), names.warmup_stable_decay(F.col("id"), 1.0, 5, 15, 25).alias("b")).collect()
    assert [round(r.a, 6) for r in lr] == [0.1, 1.0, 0.0] and [round(r.b, 6) for r in lr] == [0.2, 1.0, 0.5]


def decoded(spark, snaps):
    rows = [("t", i, b) for i, b in enumerate(snaps)]
    return spark.createDataFrame(rows, "trace_id string, step int, ram binary").select("trace_id", "step", *ram.decoded(F.col("ram")))


def test_events_and_outcome(spark):
    base = dict(ROUTINE=4, LEVEL=0, LIVES=3)
    snaps = [
        snapshot(ROUTINE=3, LIVES=3), snapshot(**base, SLOT_ROUTINE=[1, 1], SLOT_TYPE=[5, 0], SLOT_HP=[1, 0], SLOT_ATTR=[0, 2]),
        snapshot(**base, SLOT_ROUTINE=[1, 0], SLOT_TYPE=[5, 0], SLOT_HP=[0, 0]), snapshot(**base, WEAPON=3), snapshot(**base, WEAPON=0x13, GUN_ANI=0x1F), snapshot(**base, WEAPON=0, INVINCIBILITY=0x80, FALCON=0x20),
        snapshot(ROUTINE=4, LIVES=4, STOP_SCROLL=0xFF), snapshot(ROUTINE=4, LIVES=4, PLAYER_STATE=2), snapshot(ROUTINE=8, LIVES=4, LEVEL=1),
    ]
    pairs = events.step_pairs(decoded(spark, snaps))
    log = {(r.step, r.tag): r.value for r in events.long_log(pairs).collect()}
    assert log == {(1, "in_begin"): 1, (2, "kill_soldier"): 1, (2, "avoid_flamethrower"): 1, (3, "pick_spread"): 1, (4, "pick_rapid_fire"): 1, (5, "lose_spread"): 1, (5, "pick_barrier"): 1, (5, "pick_falcon"): 1,
                   (6, "gain_life"): 1, (6, "in_boss_stage"): 1, (7, "die"): 1, (8, "clear_level"): 1, (8, "in_level_transition"): 1}
    assert events.outcomes(events.long_log(pairs)).collect()[0].outcome == "level_up"
    with pytest.raises(KeyError):
        events.event_by_tag("no such")


def test_reward(spark):
    base = dict(ROUTINE=4, LEVEL=0)
    snaps = [snapshot(**base, SLOT_ROUTINE=[1, 1], SLOT_TYPE=[5, 0x10], SLOT_HP=[3, 20]), snapshot(**base, XSCROLL=[0, 10], SLOT_ROUTINE=[1, 1], SLOT_TYPE=[5, 0x10], SLOT_HP=[1, 16]),
             snapshot(**base, XSCROLL=[0, 30], STOP_SCROLL=0xFF, PLAYER_STATE=2, SLOT_ROUTINE=[1, 1], SLOT_TYPE=[5, 0x10], SLOT_HP=[1, 16])]
    pairs = events.step_pairs(decoded(spark, snaps)).withColumn("bits", F.lit(1 | 1 << 8))
    r = reward.rewarded(pairs, reward.WEIGHTS, "bits").orderBy("step").collect()
    assert (r[0].enemy_hp, r[0].boss_hp, round(r[0].push_right, 6), r[0].presses) == (2.0, 4.0, 1.0, -0.6)
    assert r[1].push_right == 0 and r[1].player_die == -15 and math.isclose(r[1].total, 7 - 0.6 - 15 - 0.6)
    assert reward.with_costs(reward.WEIGHTS, {"F": -0.02, "J": None})["F"] == -0.02
    with pytest.raises(ValueError):
        reward.with_costs(reward.WEIGHTS, {"X": 1})


def test_legal_actions(spark):
    dim = actions.action_dim(spark)
    rng = random.Random(3)
    states = [(i, rng.choice([0, 1, 256, 257]), rng.randrange(5), *[rng.choice([0, 0, 0, 1, 4]) for _ in range(5)]) for i in range(60)]
    df = spark.createDataFrame(states, "i int, previous int, weapon int, jump_status int, edge_fall int, electro int, hidden int, water_state int")
    got = {(r.i, r.name) for r in actions.legal_actions(df, dim).collect()}
    want = set()
    for i, prev, weapon, jump, edge, electro, hidden, water in states:
        can_jump = not prev & 256 and not (jump or edge or electro or water)
        can_fire = not (electro or hidden) and (weapon in (1, 4) or not prev & 1)
        want |= {(i, n) for n in actions.BASELINE if ("J" not in n or can_jump) and ("F" not in n or (can_fire and not (water and "D" in n)))}
    assert got == want and all((i, "_") in got for i in range(60))
    combos = [r.c for r in dim.select(actions.combo(F.col("bits")).alias("c")).collect()]
    assert len(set(combos)) == len(combos) and combos[0] == 0
    assert spark.createDataFrame([([1, 0, 0, 0, 0, 0, 0, None, 1],)], "v array<int>").select(actions.code(F.col("v")).alias("c")).collect()[0].c == 257
    with pytest.raises(Exception, match="no such action"):
        actions.indexed(spark.createDataFrame([(8,)], "bits int"), dim).collect()


def grid(spark, rows):
    return spark.createDataFrame([(1, r, c, v) for r, line in enumerate(rows) for c, v in enumerate({".": 0, "f": 1, "w": 2, "#": 128}[x] for x in line) if v], "level int, row int, col int, code int")


def test_terrain(spark):
    t = grid(spark, ["....ffffffffff..", "#...#.....w.....", "##..##........#."])
    assert {(r.x0, r.x1) for r in terrain.pits(t).collect()} == {(32, 64)}
    assert {(r.row, r.c0, r.c1) for r in terrain.surfaces(t).collect()} == {(0, 4, 11), (0, 12, 13), (1, 0, 0), (2, 1, 1), (2, 5, 5), (2, 14, 14)}
    assert [r.sid for r in terrain.surfaces(t).orderBy("row", "c0").collect()] == list(range(6))
    p = spark.createDataFrame([(1, 5, 0, 1), (2, 5, 64, 20), (3, 5, 160, 17), (4, 5, 990, 0)], "i int, y0 int, x int, y int").withColumn("level", F.lit(1))
    assert {r.i: (r.code, r.is_standable, r.is_water) for r in terrain.code_at(p, t).collect()} == {1: (0, False, False), 2: (128, True, False), 3: (2, False, True), 4: (0, False, False)}
    feet = spark.createDataFrame([(1, 80, 17), (1, 80, 5), (1, 16, 16), (1, 48, 0)], "level int, x int, feet_y int")
    got = {(r.x, r.feet_y): r.match_at for r in terrain.segment_at(feet, terrain.surfaces(t)).collect()}
    assert got == {(80, 17): 0, (80, 5): 0, (16, 16): 2}  # one row above and one below: the upper
    assert {r.col: r.y for r in terrain.surface_y(t).collect()}[4] == 0


def test_terrain_is_stamped_from_snapshots(spark):
    rng = random.Random(9)
    rams = [noise(rng) for _ in range(2)]
    df = spark.createDataFrame([("t", i, 1, b) for i, b in enumerate(rams)], "trace_id string, step int, level int, ram binary")
    got = {(r.row, r.col): r.code for r in terrain.stamped(df).collect()}
    one = df.where("step = 0").select(ram.xscroll(F.col("ram")).alias("l")).collect()[0].l
    assert got and all(v in (1, 2, 128) for v in got.values()) and any(c >= one // 16 for _, c in got)
