"""Extraction, gates, goals, lineage on small synthetic snapshots."""

import random

import pytest
from pyspark.sql import functions as F

from test_decoding import decoded, noise, snapshot
from tracelake.functions import ram
from tracelake.operators import events, segments


def fight(spark):
    base = dict(ROUTINE=4, LEVEL=0)
    on = lambda hp, **k: snapshot(**base, SLOT_ROUTINE=[1, 1], SLOT_TYPE=[4, 5], SLOT_HP=[hp, 1], SLOT_X=[50, 60], SLOT_Y=[60, 70], **k)
    off = lambda **k: snapshot(**base, **k)
    boss = lambda hp, **k: snapshot(ROUTINE=4, **{"LEVEL": 0, **k}, STOP_SCROLL=0xFF, SLOT_ROUTINE=[1], SLOT_TYPE=[0x10], SLOT_HP=[hp], SLOT_X=[90], SLOT_Y=[90])
    return decoded(spark, [off(), on(3), on(2), on(0), off(), off(), boss(20, WEAPON=3), boss(24), boss(10), boss(0, LEVEL=1), boss(0, LEVEL=1)])


def test_windows(spark):
    steps = fight(spark)
    kills = segments.kill_windows(steps).collect()
    assert [(r.slot, r.start_step, r.end_step, r.label) for r in kills] == [(0, 1, 3, "rotating_gun")]
    b = segments.boss_windows(events.step_pairs(steps)).collect()
    assert [(r.start_step, r.end_step, r.peak_hp) for r in b] == [(6, 9, 24)]
    assert segments.before_boss(steps).count() == 6 and segments.before_boss(steps, True).count() == 7
    assert [(r.start_step, r.end_step) for r in segments.ground_windows(steps, gap=2, latest_start=0).collect()] == [(0, 3), (3, 6)]
    t = segments.make_tasks(segments.KillMaker(shortest=3), steps)
    assert {r.reason: r.n for r in segments.report(t).collect()} == {"kept": 1}
    t = segments.make_tasks(segments.KillMaker(shortest=4), steps)
    assert {r.reason: r.n for r in segments.report(t).collect()} == {"too short": 1}


def test_fired_and_cap(spark):
    w = spark.createDataFrame([("t", 1, 3, "a"), ("t", 4, 5, "a"), ("t", 6, 9, "a"), ("t", 7, 8, "a")], "trace_id string, start_step int, end_step int, label string")
    steps = spark.createDataFrame([("t", i, 1 if i == 2 else 0) for i in range(10)], "trace_id string, step int, bits int")
    assert {r.start_step: r.fired for r in segments.fired_between(w, steps).collect()} == {1: True, 4: False, 6: False, 7: False}
    n = F.col("end_step") - F.col("start_step")
    g = {r.start_step: r.reason for r in segments.gated(w, [("short", n < 2)], "label", 2, ["start_step"]).collect()}
    assert g == {1: None, 4: "short", 6: None, 7: "capped"}


def test_goals(spark):
    steps = fight(spark)
    p = steps.select("trace_id", "step", segments.boss_parts(F.col("slots")).alias("points"))
    assert [segments.goal_frame(p, ["trace_id"], k).collect()[0].goal_step for k in ("first", "last", "boss")] == [1, 10, 1]
    one = lambda kind: steps.where("step = 1").select(segments.goal_points(F.lit(kind), F.col("slots"), F.lit(1), F.lit(300), F.lit(40), F.lit(100)).alias("g")).collect()[0].g.asDict(True)
    assert one("last") == {"points": [{"x": 200, "y": 40}], "visible": True} and one("slot") == {"points": [{"x": 60, "y": 70}], "visible": True} and len(one("boss")["points"]) == 2
    XY = "array<struct<x:int,y:int>>"
    rows = [(True, [(3, 0), (3, 1)], [(3, 0)], [(9, 9)]), (False, [(0, 0)], [], []), (True, [(9, 9)], None, [(9, 9)])]
    m = segments.label_mismatches(spark.createDataFrame(rows, f"visible boolean, centroids {XY}, enemies {XY}, enemy_bullets {XY}")).collect()[0]
    assert (m.checked, m.mismatches) == (3, 1)
    c = {r["class"]: len(r.points) for r in segments.sample_points(steps).where("step = 1").collect()}
    assert c == {"player": 0, "enemy": 2, "projectile": 0}


def test_lineage(spark):
    steps = fight(spark)
    b = segments.boss_boundary(steps).collect()[0]
    assert (b.boundary, b.weapon, b.rapid) == (6, 3, False)
    with pytest.raises(Exception, match="no boss scene"):
        segments.boss_boundary(steps.where("step < 5")).collect()
    cols = "trace_id string, boss_weapon string, boss_rapid boolean, boss_entry_step int, weapon string, rapid boolean"
    tr = spark.createDataFrame([("t", None, None, None, None, None), ("own", "Laser", True, 7, None, None), ("old", None, None, -1, "Spread", False), ("never", None, None, None, None, None)], cols)
    got = {r.trace_id: (r.boss_weapon, r.boss_entry_step, r.source) for r in segments.boss_loadout(tr, steps).collect()}
    assert got == {"t": ("Spread", 5, "replay"), "own": ("Laser", 7, "trace"), "old": ("Spread", 0, "legacy_trace"), "never": (None, -1, "replay_not_reached")}
    import hashlib

    tasks = spark.createDataFrame([("u", bytearray(b"s"), "train", 3)], "uid string, initial_state binary, split string, skip int")
    bank = spark.createDataFrame([(hashlib.sha256(b"s").hexdigest(), "train", "src", 3)], "state_sha256 string, split string, source_task string, skip int")
    assert segments.with_start_states(tasks, bank).collect()[0].source_task == "src"
    with pytest.raises(Exception, match="doesn't fit the bank"):
        segments.with_start_states(tasks, bank.withColumn("skip", F.lit(4))).collect()
    r = segments.release_split(spark.createDataFrame([("a", "test"), ("b", "val")], "uid string, split string"), spark.createDataFrame([("a",)], "uid string")).collect()
    assert {x.uid: (x.split, x.source_split) for x in r} == {"a": ("val", "test"), "b": ("train", "val")}


def test_signature_against_loop(spark):
    import numpy as np

    rng = random.Random(6)
    snaps = []
    for i in range(30):
        b = noise(rng)
        b[ram.LEVEL], b[ram.SLOT_TYPE], b[ram.SLOT_ROUTINE], b[ram.SLOT_HP] = 0, 0x10, 1, 60 - 2 * i + rng.randrange(3)
        for s in range(1, 16):
            b[ram.SLOT_TYPE + s] = rng.choice([1, 5])
        snaps.append(b)
    got = {r.bin: r for r in segments.signature(decoded(spark, snaps)).collect()}
    hp = [b[ram.SLOT_HP] for b in snaps]
    run = np.cumsum([max(0, a - c) for a, c in zip(hp, hp[1:])])
    idx = np.searchsorted((run / max(run[-1], 1)).astype(np.float32), np.linspace(0, 1, 20, dtype=np.float32)).clip(0, 28)
    assert len(got) == 20
    for k, i in enumerate(idx):
        b = snaps[i + 1]
        assert abs(got[k].idx - i) <= (0 if k not in (0,) else 0)
        assert got[k].f0 == pytest.approx(i / 28) and got[k].f1 == pytest.approx(b[ram.PLAYER_X] / 255)
        shots = [s for s in range(16) if b[ram.SLOT_ROUTINE + s] and b[ram.SLOT_TYPE + s] == 1]
        assert got[k].f6 == pytest.approx(min(1, len(shots) / 16))
        near = min((np.hypot(b[ram.SLOT_X + s] - b[ram.PLAYER_X], b[ram.SLOT_Y + s] - b[ram.PLAYER_Y]) for s in shots), default=350) / 350
        assert got[k].f7 == pytest.approx(min(1, near))


class Counting:
    def start(self, state):
        self.n = state[0]
        return bytes([self.n])

    def act(self, code, skip):
        self.n = (self.n + code * skip) % 256
        return bytes([self.n])


def test_replay_and_encoder(spark):
    tr = spark.createDataFrame([("a", bytearray(b"\x05"), [1, 2], 3)], "trace_id string, initial_state binary, codes array<int>, skip int")
    assert [(r.step, r.ram[0]) for r in segments.steps_of(tr, Counting).orderBy("step").collect()] == [(0, 5), (1, 8), (2, 14)]
    f = spark.createDataFrame([("k", bytearray(b"ab")), ("l", bytearray(b"c"))], "key string, png binary")
    assert {r.key: r.vec for r in segments.encoded(f, ["key"], "png", lambda: lambda ims: [[len(i), 1] for i in ims]).collect()} == {"k": [2, 1], "l": [1, 1]}


def play(rng, n):
    """A trace whose slots change at random: enough of everything that the makers look at."""
    snaps, b = [], snapshot(ROUTINE=4, LEVEL=rng.choice([0, 2]), WEAPON=rng.choice([0, 3]))
    for _ in range(n):
        b = bytearray(b)
        for s in range(3):
            if rng.random() < 0.3:
                b[ram.SLOT_ROUTINE + s] = rng.choice([0, 1, 1])
            if rng.random() < 0.2:
                b[ram.SLOT_TYPE + s] = rng.choice([0, 0, 4, 5, 6, 0x13])
            if rng.random() < 0.3:
                b[ram.SLOT_HP + s] = rng.choice([0, 1, 2])
            b[ram.SLOT_X + s], b[ram.SLOT_Y + s], b[ram.SLOT_ATTR + s] = rng.choice([4, 60]), 60, rng.choice([0, 1, 3, 5])
        if rng.random() < 0.3:
            b[ram.WEAPON] = rng.choice([0, 1, 3, 0x13])
        b[ram.GUN_ANI], b[ram.INVINCIBILITY] = rng.choice([0, 0x1F]), rng.choice([0, 0, 9])
        b[ram.PLAYER_X], b[ram.PLAYER_Y], b[ram.JUMP] = rng.randrange(256), rng.choice([60, 64, 90]), rng.choice([0, 0, 1])
        if rng.random() < 0.02:
            b[ram.STOP_SCROLL] = 0xFF
        if rng.random() < 0.03:
            b[ram.ROUTINE] = rng.choice([4, 8])
        snaps.append(b)
    return snaps, [rng.random() < 0.1 for _ in snaps]


def loop_windows(snaps, shots):
    """The makers as loops over one trace: sets of (kind, slot, start, end, reason)."""
    out, R = set(), ram
    boss = lambda b: b[R.STOP_SCROLL] == 0xFF
    on = lambda b, s: 8 <= b[R.SLOT_X + s] < 248 and 8 <= b[R.SLOT_Y + s] < 232
    live = {s: dict(active=False, type=0, hp=0, spawn=None, item=False, born=None) for s in range(16)}
    for i in range(1, len(snaps)):
        p, b = snaps[i - 1], snaps[i]
        if boss(b):
            break
        for s, v in live.items():
            kind, hp, active = b[R.SLOT_TYPE + s], b[R.SLOT_HP + s], b[R.SLOT_ROUTINE + s] != 0
            if v["active"] and v["hp"] > 0 and hp == 0:
                k = v["type"]
                if v["spawn"] is not None and k not in events.TARGET_SKIP and k != 5 and not (k == 0x13 and b[R.LEVEL] == 2):
                    n = i - v["spawn"] + 1
                    why = "too short" if n < 2 else "too long" if n > 240 else "off screen" if not on(b, s) else "no shot" if not any(shots[v["spawn"] : i + 1]) else None
                    out.add(("kill", s, v["spawn"], i, why))
                v["spawn"] = None
            elif active and (not v["active"] or kind != v["type"]):
                v["spawn"] = i
            elif not active:
                v["spawn"] = None
            item = active and kind == 0
            if v["item"] and not item and v["born"]:
                at, attr, seen = v["born"]
                gun, before = b[R.WEAPON] & 15, p[R.WEAPON] & 15
                rapid = b[R.GUN_ANI] == 0x1F and p[R.GUN_ANI] != 0x1F and gun == before and b[R.WEAPON] & 16 and not p[R.WEAPON] & 16
                own = {0: rapid, 5: b[R.INVINCIBILITY] > p[R.INVINCIBILITY], 6: False}.get(attr, gun == attr and gun != before)
                kind_ = "pick" if own else "avoid" if attr in (1, 2, 3, 4) and attr != gun and gun in (1, 2, 3, 4) else None
                n = i - at + 1
                why = "never seen" if not seen else "no choice" if kind_ is None else "too short" if n < (10 if kind_ == "pick" else 2) else "too long" if n > 240 else None
                gone = {b2 for b2 in range(16) if p[R.SLOT_ROUTINE + b2] and p[R.SLOT_TYPE + b2] == 0 and not (b[R.SLOT_ROUTINE + b2] and b[R.SLOT_TYPE + b2] == 0) and p[R.SLOT_ATTR + b2] & 7 == attr}
                if why is None and kind_ == "avoid" and not (gun == before and gone):
                    why = "perhaps dropped"  # an earlier item of the same gun may have left in the window
                out.add(("item", s, at, i, why))
            if item and not v["item"]:
                v["born"] = (i, b[R.SLOT_ATTR + s] & 7, on(b, s))
            v["active"], v["type"], v["hp"], v["item"] = active, kind, hp, item
    start = end = None
    for i in range(1, len(snaps)):
        p, b = snaps[i - 1], snaps[i]
        if start is None and boss(b) and not boss(p):
            start = i
        elif start and end is None and (b[R.LEVEL] > p[R.LEVEL] or (p[R.ROUTINE] not in (8, 9) and b[R.ROUTINE] in (8, 9))):
            end = i
    if end:
        out.add(("boss", None, start, end, None))
    return out


def test_makers_against_loops(spark):
    rng = random.Random(13)
    plays = {f"t{i}": play(rng, 220) for i in range(6)}
    rows = [(t, i, b, int(f)) for t, (snaps, shots) in plays.items() for i, (b, f) in enumerate(zip(snaps, shots))]
    steps = spark.createDataFrame(rows, "trace_id string, step int, ram binary, bits int").select("trace_id", "step", "bits", *ram.decoded(F.col("ram"))).cache()
    want = {(t, *w) for t, (snaps, shots) in plays.items() for w in loop_windows(snaps, shots)}
    got = {(r.trace_id, name, r.slot, r.start_step, r.end_step, r.reason) for name in ("kill", "item", "boss") for r in segments.make_tasks(segments.MAKERS[name](), steps).collect()}
    doubt = {w[:5] for w in want if w[5] == "perhaps dropped"}
    assert {w for w in got if w[:5] not in doubt} == {w for w in want if w[:5] not in doubt} and {w[:5] for w in got} == {w[:5] for w in want}
    assert {w[1] for w in got} == {"kill", "item", "boss"} and {None, "too short", "off screen", "no shot", "never seen", "no choice"} <= {w[5] for w in got}
    ways = segments.make_tasks(segments.TraverseMaker(gap=20, latest_start=0), steps).collect()
    assert ways and all(r.reason is None for r in ways)  # the place itself is in the window
    x = lambda b: b[ram.XSCROLL] * 256 + b[ram.XSCROLL + 1] + b[ram.PLAYER_X]
    for r in ways:
        snaps = plays[r.trace_id][0]
        assert (r.start_x, r.end_x, r.end_y) == (x(snaps[r.start_step]), x(snaps[r.end_step]), snaps[r.end_step][ram.PLAYER_Y]) and r.end_step - r.start_step > 20


def test_goals_are_pinned(spark):
    """Another slot's death, or an empty slot, is not the goal."""
    w = spark.createDataFrame([("t", 0, 1, 3), ("t", 1, 1, 3), ("t", 1, 4, 9), ("u", 1, 4, 9)], "trace_id string, slot int, start_step int, end_step int")
    g = spark.createDataFrame([("t", 1, 3), ("t", 2, 5), ("u", 1, 10)], "trace_id string, slot int, step int")
    assert {(r.trace_id, r.slot, r.start_step): r.reached for r in segments.verified(w, g, ["trace_id", "slot"]).collect()} == {("t", 0, 1): False, ("t", 1, 1): True, ("t", 1, 4): False, ("u", 1, 4): False}


class Shooting:
    """Slot 3 dies once fire was pressed, or at the second step if the state says that a bullet is on its way."""

    def start(self, state):
        self.late, self.n, self.shot = state[0], 0, False
        return self.ram()

    def act(self, code, skip):
        self.n, self.shot = self.n + 1, self.shot or code & 1
        return self.ram()

    def ram(self):
        dead = self.shot or (self.late and self.n > 1)
        return bytes(snapshot(ROUTINE=4, SLOT_HP=[9, 9, 9, 0 if dead else 1]))


def test_stray_bullets(spark):
    tasks = spark.createDataFrame([("a", bytearray(b"\x00"), [0, 1, 0], 3), ("b", bytearray(b"\x01"), [0, 1, 0], 3)], "uid string, initial_state binary, codes array<int>, skip int")
    w = spark.createDataFrame([("a", 3), ("b", 3)], "uid string, slot int")
    assert {r.uid: r.stray for r in segments.stray(w, tasks, Shooting).collect()} == {"a": False, "b": True}
