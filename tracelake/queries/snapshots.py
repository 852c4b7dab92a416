"""Queries on memory snapshots. The test tables hold none, so each event stands for a step of its user's trace, and its snapshot is made of hash digits: the byte
at an address is the digit at the address modulo 128, which SQL reads from the digits and the library from the 2,048 bytes."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tracelake.functions import ram
from tracelake.operators import events, segments
from tracelake.queries import query, table

C = F.col


def _snapshots(spark, d):
    """trace_id, step, bits (the low bit of the event's number), ram."""
    key = lambda n: F.sha2(F.concat_ws("-", C("user_id").cast("string"), C("event_id").cast("string"), F.lit(n)), 256)
    w = Window.partitionBy("user_id").orderBy("event_id")
    t = table(spark, d, "events").withColumn("digits", F.concat(key("0"), key("1")))
    return t.select(C("user_id").alias("trace_id"), (F.row_number().over(w) - 1).alias("step"), C("event_id").bitwiseAND(1).cast("int").alias("bits"), F.unhex(F.repeat(F.regexp_replace("digits", "(.)", "0$1"), 16)).alias("ram"))


def _steps(spark, d):
    return _snapshots(spark, d).select("trace_id", "step", "bits", *ram.decoded(C("ram")))


_T = """t AS (SELECT user_id AS trace_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS step, event_id & 1 AS bits,
sha256(user_id || '-' || event_id || '-0') || sha256(user_id || '-' || event_id || '-1') AS d FROM events)"""


def _b(at: int | str, d: str = "d") -> str:
    return f"(strpos('0123456789abcdef', substr({d}, {at % 128 + 1 if isinstance(at, int) else f'({at}) % 128 + 1'}, 1)) - 1)"


_BYTES = {"level": ram.LEVEL, "routine": ram.ROUTINE, "lives": ram.LIVES, "stop_scroll": ram.STOP_SCROLL, "player_state": ram.PLAYER_STATE, "player_x": ram.PLAYER_X, "player_y": ram.PLAYER_Y, "jump_status": ram.JUMP,
          "edge_fall": ram.EDGE_FALL, "water_state": ram.WATER, "invincibility": ram.INVINCIBILITY, "falcon": ram.FALCON, "weapon": ram.WEAPON}
_LISTED = ", ".join(f"{_b(a)} AS {n}" for n, a in _BYTES.items())
_GROUND = f"({_b(ram.JUMP)} & 15 = 0 AND {_b(ram.EDGE_FALL)} = 0)"
_NAMES = " ".join(f"WHEN {k} THEN '{v.lower().replace(' ', '_')}'" for k, v in ram.COMMON_TYPES.items())
_ITEMS = " ".join(f"WHEN {k} THEN '{v}'" for k, v in ram.ITEMS.items())
_WEAPONS = " ".join(f"WHEN {k} THEN '{v}'" for k, v in ram.WEAPONS.items())


@query(f"""WITH {_T} SELECT trace_id, step, {_LISTED}, {_b(ram.XSCROLL)} * 256 + {_b(ram.XSCROLL + 1)} AS xscroll, {_b(ram.SCROLL_HI)} * 240 + {_b(ram.SCROLL_OFF)} AS yscroll,
{_b(ram.XSCROLL)} * 256 + {_b(ram.XSCROLL + 1)} + {_b(ram.PLAYER_X)} AS world_x, CASE WHEN {_b(ram.WATER)} & 4 <> 0 THEN 'water' WHEN {_GROUND} THEN 'ground' ELSE 'air' END AS terrain,
CASE WHEN {_b(ram.LEVEL)} IN (1, 3) THEN 'inside' WHEN {_b(ram.LEVEL)} = 2 THEN 'up' ELSE 'forward' END AS style, CASE {_b(ram.WEAPON)} {_WEAPONS} ELSE 'Unknown' || {_b(ram.WEAPON)} END AS gun, {_b(ram.DEATH)} & 1 AS death_flag, false AS rapid FROM t""")
def ram_scalars(spark, d):
    """Scalars of every snapshot: bytes, scrolls, world x, footing, style of the level, weapon."""
    r = C("ram")
    t = _snapshots(spark, d).select("trace_id", "step", *ram.decoded(r), ram.yscroll(r).alias("yscroll"), ram.player_x(r).alias("world_x"), ram.terrain_state(r).alias("terrain"))
    return t.select("trace_id", "step", *_BYTES, "xscroll", "yscroll", "world_x", "terrain", ram.advance_style(C("level")).alias("style"), ram.weapon_label(C("weapon")).alias("gun"), "death_flag", "rapid")


_SLOTS = f"""s AS (SELECT trace_id, step, bits, level, slot, {_b(f'{ram.SLOT_ROUTINE} + slot')} AS routine, {_b(f'{ram.SLOT_TYPE} + slot')} AS type, {_b(f'{ram.SLOT_HP} + slot')} AS hp, {_b(f'{ram.SLOT_ATTR} + slot')} AS attr,
{_b(f'{ram.SLOT_X} + slot')} AS x, {_b(f'{ram.SLOT_Y} + slot')} AS y FROM (SELECT trace_id, step, bits, d, {_b(ram.LEVEL)} AS level, unnest(range(16)) AS slot FROM t))"""


@query(f"""WITH {_T}, {_SLOTS} SELECT trace_id, step, CAST(slot AS INTEGER) AS slot, routine, type, hp, attr, x, y, CASE type {_NAMES} END AS name, CASE attr & 7 {_ITEMS} END AS item, x >= 8 AND y >= 8 AS seen FROM s""")
def ram_slots(spark, d):
    """The 16 object slots of every snapshot, with the names of types and items."""
    t = segments.slot_steps(_steps(spark, d))
    return t.select("trace_id", "step", "slot", "routine", "type", "hp", "attr", "x", "y", ram.type_name(C("type"), C("level")).alias("name"), ram.item_label(C("attr")).alias("item"), ram.on_screen(C("x"), C("y")).alias("seen"))


_NEAR = f"sqrt((x - {_b(ram.PLAYER_X)}) ** 2 + (y - {_b(ram.PLAYER_Y)}) ** 2)"


@query(f"""WITH {_T}, {_SLOTS}, p AS (SELECT trace_id, step, {_b(ram.PLAYER_X)} AS px, {_b(ram.PLAYER_Y)} AS py, d FROM t),
e AS (SELECT trace_id, step, count(*) FILTER (type <> 1) AS enemies, count(*) FILTER (type = 1) AS enemy_bullets, round(min(CASE WHEN type = 1 THEN sqrt((x - px) ** 2 + (y - py) ** 2) END), 6) AS nearest
 FROM s JOIN p USING (trace_id, step) WHERE routine <> 0 GROUP BY 1, 2),
u AS (SELECT trace_id, step, count(*) AS player_bullets FROM (SELECT trace_id, step, d, unnest(range(16)) AS i FROM t) WHERE {_b(f'{ram.BULLET_SLOT} + i')} <> 0 AND {_b(f'{ram.BULLET_OWNER} + i')} = 0 GROUP BY 1, 2)
SELECT trace_id, step, CAST(coalesce(enemies, 0) AS INTEGER) AS enemies, CAST(coalesce(enemy_bullets, 0) AS INTEGER) AS enemy_bullets, CAST(coalesce(player_bullets, 0) AS INTEGER) AS player_bullets, nearest
FROM t LEFT JOIN e USING (trace_id, step) LEFT JOIN u USING (trace_id, step)""")
def ram_entities(spark, d):
    """Who is on the stage: enemies, their bullets, the player's, and the nearest enemy bullet."""
    e = ram.entities(C("slots"), C("bullets"), C("player_x"), C("player_y"))
    t = _steps(spark, d).select("trace_id", "step", "player_x", "player_y", e.alias("e"))
    near = ram.nearest_distance(C("e.enemy_bullets"), C("player_x"), C("player_y"))
    return t.select("trace_id", "step", F.size("e.enemies").alias("enemies"), F.size("e.enemy_bullets").alias("enemy_bullets"), F.size("e.player_bullets").alias("player_bullets"), F.round(near, 6).alias("nearest"))


_PIXELS = ((0, 0), (8, 100), (250, 223), (130, 239), (77, 160))
_CELL = f"""SELECT trace_id, step, px, py, (CASE WHEN a > 255 OR (a & 255) >= 240 THEN ((a & 255) + 16) & 255 ELSE a & 255 END) AS wy, px + {_b(ram.HSCROLL)} AS ax, {_b(ram.PPUCTRL)} & 1 AS screen, d
FROM (SELECT *, py + {_b(ram.VSCROLL)} AS a FROM (SELECT trace_id, step, d, unnest([{', '.join(f"{{'px': {x}, 'py': {y}}}" for x, y in _PIXELS)}], recursive := true) FROM t))"""


@query(f"""WITH {_T}, c AS ({_CELL}), k AS (SELECT *, {_b(f'{ram.COLLISION} + 64 * (CASE WHEN ax > 255 THEN 1 - screen ELSE screen END) + wy // 16 * 4 + (ax % 256) // 64')} AS cell FROM c)
SELECT trace_id, step, px, py, CASE WHEN py >= 224 THEN 0 ELSE [0, 1, 2, 128][(cell >> CAST(6 - 2 * ((ax % 64) // 16) AS INTEGER) & 3) + 1] END AS code FROM k""")
def ram_collision(spark, d):
    """Collision codes at a few pixels of every snapshot."""
    at = F.array(*[F.struct(F.lit(x).alias("px"), F.lit(y).alias("py")) for x, y in _PIXELS])
    return _snapshots(spark, d).select("trace_id", "step", "ram", F.inline(at)).select("trace_id", "step", "px", "py", ram.collision(C("ram"), C("px"), C("py")).alias("code"))


_BOSS = " OR ".join(f"(level = {lv} AND type IN ({', '.join(map(str, (*ram.BOSS_COMMON, *k)))}))" for lv, k in ram.BOSS_BY_LEVEL.items())
_SCENE = f"""z AS (SELECT trace_id, step, coalesce(sum(hp) FILTER (routine <> 0 AND hp > 0 AND boss), 0) AS boss_hp, bool_or(routine <> 0 AND boss) AND any_value(level) IN (1, 3) AS scene
FROM (SELECT *, {_BOSS} OR (level > 7 AND type = 10) AS boss FROM s) GROUP BY 1, 2)"""


@query(f"WITH {_T}, {_SLOTS}, {_SCENE} SELECT trace_id, step, CAST(boss_hp AS INTEGER) AS boss_hp, scene FROM z")
def ram_boss(spark, d):
    """Hit points of the boss, and whether it is a boss scene."""
    return _steps(spark, d).select("trace_id", "step", ram.boss_hp(C("slots"), C("level")).alias("boss_hp"), events.scene().alias("scene"))


_P = f"""w AS (SELECT trace_id, step, {_LISTED}, {_b(ram.GUN_ANI)} AS gun_ani, {_b(ram.DEATH)} & 1 AS death, scene FROM t JOIN z USING (trace_id, step)),
p AS (SELECT *, {', '.join(f'lag({c}) OVER o AS pre_{c}' for c in ('level', 'routine', 'lives', 'weapon', 'invincibility', 'falcon', 'player_state', 'scene'))} FROM w WINDOW o AS (PARTITION BY trace_id ORDER BY step)),
q AS (SELECT *, lag(level) OVER o AS pre_level, lag(type) OVER o AS pre_type, lag(hp) OVER o AS pre_hp, lag(routine) OVER o AS pre_routine, lag(attr) OVER o AS pre_attr FROM s WINDOW o AS (PARTITION BY trace_id, slot ORDER BY step))"""


def _when(tag: str, kind: str, condition: str, value: str = "1") -> str:
    return f"SELECT trace_id, step, '{tag}' AS tag, CAST({value} AS DOUBLE) AS value, '{kind}' AS type FROM p WHERE {condition}"


_SIMPLE = " UNION ALL ".join([
    *[_when(f"pick_{ram.WEAPONS[g].lower()}", "weapon", f"weapon = {g} AND pre_weapon <> {g}") for g in (1, 2, 3, 4)], _when("lose_spread", "weapon", "pre_weapon = 3 AND weapon <> 3"),
    _when("pick_barrier", "powerup", "invincibility > pre_invincibility"), _when("pick_falcon", "powerup", "falcon > pre_falcon"), _when("gain_life", "powerup", "lives > pre_lives"),
    _when("die", "terminal", "pre_player_state <> 2 AND (death <> 0 OR player_state = 2)"), _when("clear_level", "terminal", "level > pre_level"), _when("clear_game", "terminal", "pre_level = 7 AND level > 7"),
    _when("in_boss_stage", "stage", "scene AND NOT pre_scene"), _when("in_begin", "stage", "pre_routine < 4 AND routine = 4"), _when("in_level_transition", "stage", "pre_routine NOT IN (8, 9) AND routine IN (8, 9)"),
    _when("in_title", "stage", "routine < 4 AND pre_level IS NOT NULL")])
_KILLED = f"""SELECT trace_id, step, 'kill_' || CASE pre_type {_NAMES} END AS tag, CAST(count(*) AS DOUBLE) AS value, 'kill' AS type FROM q WHERE pre_hp > 0 AND hp = 0 AND pre_type NOT IN (0, 1, 9, 10, 11, 13, 15) GROUP BY ALL"""
_AVOIDED = f"""SELECT q.trace_id, q.step, 'avoid_' || lower(CASE q.pre_attr & 7 {_WEAPONS} END) AS tag, CAST(count(*) AS DOUBLE) AS value, 'item' AS type FROM q JOIN p USING (trace_id, step)
WHERE p.weapon = p.pre_weapon AND q.pre_attr & 7 IN (1, 2, 3, 4) AND q.pre_attr & 7 <> p.weapon AND q.pre_type = 0 AND q.pre_routine <> 0 AND NOT (q.type = 0 AND q.routine <> 0) GROUP BY ALL"""
_EVENTS = f"WITH {_T}, {_SLOTS}, {_SCENE}, {_P}, v AS ({_SIMPLE} UNION ALL {_KILLED} UNION ALL {_AVOIDED})"


@query(f"{_EVENTS} SELECT trace_id, step, tag, value, type FROM v")
def snapshot_events(spark, d):
    """The narrative log: every event of the registry over every pair of snapshots."""
    return events.long_log(events.step_pairs(_steps(spark, d)))


@query(f"""{_EVENTS} SELECT trace_id, CASE WHEN bool_or(tag = 'clear_game') THEN 'game_clear' WHEN bool_or(tag IN ('clear_level', 'in_level_transition')) THEN 'level_up' ELSE 'lose' END AS outcome FROM v GROUP BY 1""")
def snapshot_outcomes(spark, d):
    """How each trace ends, from its log."""
    return events.outcomes(events.long_log(events.step_pairs(_steps(spark, d))))


_LIFE = f"""f AS (SELECT trace_id, min(step) FILTER (scene AND step > 0) AS stop FROM z GROUP BY 1), l AS (SELECT s.* FROM s JOIN f USING (trace_id) WHERE step > 0 AND step < coalesce(stop, 1e9)),
k AS (SELECT *, lag(type) OVER o AS pt, lag(hp) OVER o AS ph, coalesce(lag(routine) OVER o, 0) <> 0 AS was FROM l WINDOW o AS (PARTITION BY trace_id, slot ORDER BY step)),
g AS (SELECT *, CASE WHEN was AND ph > 0 AND hp = 0 THEN 'K' WHEN routine <> 0 AND (NOT was OR type IS DISTINCT FROM pt) THEN 'S' WHEN routine = 0 THEN 'G' END AS e FROM k),
h AS (SELECT *, last_value(CASE WHEN e IS NOT NULL THEN {{'e': e, 'at': step}} END IGNORE NULLS) OVER (PARTITION BY trace_id, slot ORDER BY step ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS last FROM g),
x AS (SELECT trace_id, slot, last.at AS start_step, step AS end_step, pt, x, y FROM h WHERE e = 'K' AND last.e = 'S' AND pt NOT IN (0, 1, 5, 9, 10, 11, 13, 15))"""


@query(f"""WITH {_T}, {_SLOTS}, {_SCENE}, {_LIFE}, y AS (SELECT x.*, (SELECT max(bits) FROM t WHERE t.trace_id = x.trace_id AND t.step BETWEEN x.start_step AND x.end_step) AS shots FROM x)
SELECT trace_id, CAST(slot AS INTEGER) AS slot, start_step, end_step, CASE pt {_NAMES} END AS label,
CASE WHEN end_step - start_step + 1 > 3 THEN 'too long' WHEN x < 8 OR y < 8 THEN 'off screen' WHEN shots = 0 THEN 'no shot' ELSE 'kept' END AS reason FROM y""")
def kill_tasks(spark, d):
    """The kill maker over all snapshots (windows of at most 3 steps), with the gate that each window fails."""
    t = segments.make_tasks(segments.KillMaker(longest=3), _steps(spark, d))
    return t.select("trace_id", "slot", "start_step", "end_step", "label", F.coalesce("reason", F.lit("kept")).alias("reason"))


@query(f"""WITH {_T}, {_SLOTS}, {_SCENE}, {_P}, a AS (SELECT trace_id, min(step) AS start_step FROM p WHERE scene AND NOT pre_scene GROUP BY 1),
b AS (SELECT trace_id, start_step, min(step) AS end_step FROM p JOIN a USING (trace_id) WHERE step > start_step AND (level > pre_level OR (pre_routine NOT IN (8, 9) AND routine IN (8, 9))) GROUP BY 1, 2)
SELECT b.trace_id, b.start_step, b.end_step, 'boss_level' || (any_value(CASE WHEN z.step = b.start_step - 1 THEN {_b(ram.LEVEL)} END) + 1) AS label, CAST(max(z.boss_hp) AS INTEGER) AS peak_hp
FROM b JOIN z ON z.trace_id = b.trace_id AND z.step BETWEEN b.start_step - 1 AND b.end_step JOIN t ON t.trace_id = z.trace_id AND t.step = z.step GROUP BY ALL""")
def boss_tasks(spark, d):
    """The boss maker over all snapshots."""
    return segments.make_tasks(segments.BossMaker(), _steps(spark, d)).where("reason IS NULL").select("trace_id", "start_step", "end_step", "label", "peak_hp")
