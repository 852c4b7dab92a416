"""Memory snapshots to columns: every decoder is an expression over one BINARY column (2,048 bytes).

Bytes are read with ``substring`` (position = address + 1), so a snapshot is decoded inside code generation and nothing but the
needed columns leaves the scan. Decoded slots are arrays of structs; pair functions take the struct columns of two steps.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Addresses of the snapshot.
LEVEL = 48
LIVES = 50
INDOOR_CLEARED = 0x37
ROUTINE = 0x2C
STOP_SCROLL = 0x58
SCROLL_HI = 0x64
SCROLL_OFF = 0x65
XSCROLL = 100
FALCON = 0x7D
PLAYER_STATE = 0x90
JUMP = 0xA0
EDGE_FALL = 0xA4
WEAPON = 0xAA
INVINCIBILITY = 0xB0
WATER = 0xB2
DEATH = 180
HIDDEN = 0xBA
ELECTRO = 0xC8
PLAYER_ADV = 0xD0
VSCROLL = 0xFC
HSCROLL = 0xFD
PPUCTRL = 0xFF
GUN_ANI = 0x010A
PLAYER_Y = 0x031A
SLOT_Y = 0x0324
PLAYER_X = 0x0334
SLOT_X = 0x033E
BULLET_SLOT = 0x0388
BULLET_Y = 0x03B8
BULLET_X = 0x03C8
BULLET_OWNER = 0x0448
SLOT_ROUTINE = 0x04B8
SLOT_TYPE = 0x528
SLOT_HP = 1400
SLOT_ATTR = 0x5A8
COLLISION = 0x680
SLOTS = 16

# Names of weapons, items and slot types; boss types and kinds of level (levels from 0).
WEAPONS = {0: "Regular", 1: "MachineGun", 2: "Flamethrower", 3: "Spread", 4: "Laser"}
ITEMS = {0: "Rapid", 1: "MachineGun", 2: "Flamethrower", 3: "Spread", 4: "Laser", 5: "Barrier", 6: "Falcon"}
GUN_ATTRS = (1, 2, 3, 4)
COMMON_TYPES = {
    0x00: "Weapon Item", 0x01: "Bullet", 0x02: "Pill Box Sensor", 0x03: "Flying Capsule", 0x04: "Rotating Gun", 0x05: "Soldier", 0x06: "Sniper", 0x07: "Red Turret",
    0x08: "Wall Cannon", 0x09: "Unused", 0x0A: "Wall Plating", 0x0B: "Mortar Shot", 0x0C: "Scuba Diver", 0x0D: "Unused", 0x0E: "Basquez", 0x0F: "Basquez Bullet",
}
_INDOOR = {
    0x10: "Boss Eye", 0x11: "Roller", 0x12: "Grenade", 0x13: "Wall Turret", 0x14: "Core", 0x15: "Indoor Soldier", 0x16: "Jumping Soldier", 0x17: "Grenade Launcher",
    0x18: "Group of Four Soldiers", 0x19: "Indoor Soldier Generator", 0x1A: "Indoor Roller Generator", 0x1B: "Boss Eye Fire Ring Projectile", 0x1C: "Godomuga",
    0x1D: "Gardegura", 0x1E: "Garth", 0x1F: "Rangel", 0x20: "Garth and Rangel Generator",
}
LEVEL_TYPES = {
    0: {0x10: "Bomb Turret", 0x11: "Plated Door", 0x12: "Exploding Bridge"},
    1: _INDOOR,
    2: {0x10: "Floating Rock Platform", 0x11: "Moving Flame", 0x12: "Rock Cave", 0x13: "Falling Rock", 0x14: "Dragon", 0x15: "Dragon Tentacle Orb"},
    3: _INDOOR,
    4: {0x10: "Ice Grenade Generator", 0x11: "Ice Grenade", 0x12: "Tank", 0x13: "Ice Separator", 0x14: "Alien Carrier", 0x15: "Flying Saucer", 0x16: "Drop Bomb"},
    5: {0x10: "Fire Beam", 0x11: "Fire Beam", 0x12: "Fire Beam", 0x13: "Giant Boss Soldier", 0x14: "Spiked Projectile"},
    6: {0x10: "Claw", 0x11: "Rising Spiked Wall", 0x12: "Tall Spiked Wall", 0x13: "Mining Cart Generator", 0x14: "Mining Cart", 0x15: "Stationary Mining Cart", 0x16: "Armored Door", 0x17: "Mortar Launcher", 0x18: "Soldier Generator"},
    7: {0x10: "Emperor Demon Dragon God Java", 0x11: "Bundle", 0x12: "Wadder", 0x13: "Poisonous Insect Gel", 0x14: "Bugger", 0x15: "Eggron", 0x16: "Gomeramos King"},
}
BOSS_COMMON = (0x0A,)
BOSS_BY_LEVEL = {0: (0x10, 0x11), 1: (0x10, 0x14), 2: (0x14, 0x15), 3: (0x10, 0x14, 0x1C), 4: (0x12, 0x14), 5: (0x13,), 6: (0x16, 0x17), 7: (0x10, 0x15, 0x16)}
INSIDE_LEVELS = (1, 3)
UP_LEVELS = (2,)


def byte(ram: Column, at: int | Column) -> Column:
    """The byte at an address as INT; null beyond the end. The address may be a column."""
    place = F.lit(at + 1) if isinstance(at, int) else (at + 1).cast("int")
    return F.conv(F.hex(F.substring(ram, place, F.lit(1))), 16, 10).cast("int")


def word(ram: Column, at: int) -> Column:
    """Two bytes, the high one first."""
    return byte(ram, at) * 256 + byte(ram, at + 1)


def xscroll(ram: Column) -> Column:
    return word(ram, XSCROLL)


def yscroll(ram: Column) -> Column:
    return byte(ram, SCROLL_HI) * 240 + byte(ram, SCROLL_OFF)


def yscroll_delta(pre_off: Column, cur_off: Column) -> Column:
    """Movement of the vertical offset, which wraps at 240; never negative."""
    d = cur_off - pre_off
    return F.greatest(d + F.when(d < -100, 240).otherwise(0), F.lit(0))


def advance_style(level: Column) -> Column:
    return F.when(level.isin(*INSIDE_LEVELS), "inside").when(level.isin(*UP_LEVELS), "up").otherwise("forward")


def type_name(kind: Column, level: Column) -> Column:
    """Name of a slot type: lower case, ``_`` for spaces; an unknown type as ``0x??``. Common names below 0x10, else the level's (null level: 0)."""
    unknown = F.lower(F.concat(F.lit("0x"), F.lpad(F.hex(kind), 2, "0")))
    common = F.create_map(*[F.lit(x) for kv in COMMON_TYPES.items() for x in kv])
    by_level = F.create_map(*[F.lit(x) for lv, names in LEVEL_TYPES.items() for k, n in names.items() for x in (lv * 256 + k, n)])
    name = F.when(kind <= 0x0F, F.try_element_at(common, kind)).otherwise(F.try_element_at(by_level, F.coalesce(level, F.lit(0)) * 256 + kind))
    return F.regexp_replace(F.lower(F.coalesce(name, unknown)), " ", "_")


def weapon_type(raw: Column) -> Column:
    return raw.bitwiseAND(15)


def is_rapid(raw: Column) -> Column:
    return raw.bitwiseAND(16) != 0


def weapon_label(raw: Column) -> Column:
    """Name of the low nibble; ``Unknown<n>`` for others."""
    names = F.create_map(*[F.lit(x) for kv in WEAPONS.items() for x in kv])
    return F.coalesce(F.try_element_at(names, weapon_type(raw)), F.concat(F.lit("Unknown"), weapon_type(raw).cast("string")))


def item_label(attr: Column) -> Column:
    """Name of an item by the low three bits of its attributes; null where there is none."""
    return F.try_element_at(F.create_map(*[F.lit(x) for kv in ITEMS.items() for x in kv]), attr.bitwiseAND(7))


def on_screen(x: Column, y: Column) -> Column:
    """Inside the visible crop (8 pixels cut from every side of 256 x 240)."""
    return (x >= 8) & (x < 248) & (y >= 8) & (y < 232)


def player_x(ram: Column) -> Column:
    """World x: scroll plus sprite x."""
    return xscroll(ram) + byte(ram, PLAYER_X)


def is_grounded(ram: Column) -> Column:
    return (byte(ram, JUMP).bitwiseAND(15) == 0) & (byte(ram, EDGE_FALL) == 0)


def in_water(ram: Column) -> Column:
    return byte(ram, WATER).bitwiseAND(4) != 0


def terrain_state(ram: Column) -> Column:
    return F.when(in_water(ram), "water").when(is_grounded(ram), "ground").otherwise("air")


def slots(ram: Column) -> Column:
    """The 16 object slots: slot, routine, type, hp, attr, x, y."""
    at = {"routine": SLOT_ROUTINE, "type": SLOT_TYPE, "hp": SLOT_HP, "attr": SLOT_ATTR, "x": SLOT_X, "y": SLOT_Y}
    return F.transform(F.sequence(F.lit(0), F.lit(SLOTS - 1)), lambda i: F.struct(i.alias("slot"), *[byte(ram, i + a).alias(n) for n, a in at.items()]))


def bullets(ram: Column) -> Column:
    """The 16 player bullet slots: slot, active, owner, x, y."""
    at = {"active": BULLET_SLOT, "owner": BULLET_OWNER, "x": BULLET_X, "y": BULLET_Y}
    return F.transform(F.sequence(F.lit(0), F.lit(SLOTS - 1)), lambda i: F.struct(i.alias("slot"), *[byte(ram, i + a).alias(n) for n, a in at.items()]))


def decoded(ram: Column) -> list[Column]:
    """The columns of a decoded step."""
    one = {
        "level": LEVEL, "routine": ROUTINE, "lives": LIVES, "invincibility": INVINCIBILITY, "falcon": FALCON, "gun_ani": GUN_ANI, "scroll_hi": SCROLL_HI, "scroll_off": SCROLL_OFF,
        "stop_scroll": STOP_SCROLL, "indoor_cleared": INDOOR_CLEARED, "player_adv": PLAYER_ADV, "player_state": PLAYER_STATE, "player_x": PLAYER_X, "player_y": PLAYER_Y,
        "jump_status": JUMP, "edge_fall": EDGE_FALL, "water_state": WATER, "electro": ELECTRO, "hidden": HIDDEN,
    }
    raw = byte(ram, WEAPON)
    return [*[byte(ram, a).alias(n) for n, a in one.items()], weapon_type(raw).alias("weapon"), is_rapid(raw).alias("rapid"), xscroll(ram).alias("xscroll"),
            byte(ram, DEATH).bitwiseAND(1).alias("death_flag"), slots(ram).alias("slots"), bullets(ram).alias("bullets")]


def boss_types(level: Column) -> Column:
    """Array of the boss types of a level (the common ones for an unknown level)."""
    by = F.create_map(*[x for lv, kinds in BOSS_BY_LEVEL.items() for x in (F.lit(lv), F.array(*[F.lit(k) for k in (*BOSS_COMMON, *kinds)]))])
    return F.coalesce(F.try_element_at(by, level), F.array(*[F.lit(k) for k in BOSS_COMMON]))


def _alive(s: Column) -> Column:
    return (s["hp"] > 0) & (s["hp"] < 0xF0)


def boss_enemy_present(slot_array: Column, level: Column) -> Column:
    """A boss slot that is active: routine not 0."""
    kinds = boss_types(level)
    return F.exists(slot_array, lambda s: (s["routine"] != 0) & F.array_contains(kinds, s["type"]))


def boss_hp(slot_array: Column, level: Column) -> Column:
    """Hit points of all boss slots that are active with real hit points."""
    kinds = boss_types(level)
    alive = F.filter(slot_array, lambda s: (s["routine"] != 0) & _alive(s) & F.array_contains(kinds, s["type"]))
    return F.aggregate(alive, F.lit(0), lambda t, s: t + s["hp"])


def boss_scene(stop_scroll: Column, slot_array: Column, level: Column) -> Column:
    return (stop_scroll == 0xFF) | (level.isin(*INSIDE_LEVELS) & boss_enemy_present(slot_array, level))


def live_slots(pre: Column, cur: Column, level: Column) -> Column:
    """Slots that hold a real enemy on both sides of a step: type (of the earlier side), pre_hp, cur_hp."""
    both = F.zip_with(pre, cur, lambda p, c: F.struct(p["type"].alias("type"), p["hp"].alias("pre_hp"), c["hp"].alias("cur_hp")))
    return F.filter(both, lambda s: (s["pre_hp"] < 0xF0) & (s["cur_hp"] < 0xF0) & ~s["type"].isin(1, 0x0B, 0x0F) & ~((s["type"] == 0x13) & (level == 2)))


def xy(s: Column) -> Column:
    return F.struct(s["x"].alias("x"), s["y"].alias("y"))


def entities(slot_array: Column, bullet_array: Column, x: Column, y: Column, owner: int | None = 0) -> Column:
    """Positions of the player, enemies, enemy bullets and (one owner's, or all) player bullets."""
    live = F.filter(slot_array, lambda s: s["routine"] != 0)
    mine = F.filter(bullet_array, lambda s: (s["active"] != 0) & (F.lit(True) if owner is None else s["owner"] == owner))
    return F.struct(
        F.struct(x.alias("x"), y.alias("y")).alias("player"), F.transform(F.filter(live, lambda s: s["type"] != 1), xy).alias("enemies"),
        F.transform(F.filter(live, lambda s: s["type"] == 1), xy).alias("enemy_bullets"), F.transform(mine, xy).alias("player_bullets"))


def nearest_distance(points: Column, x: Column, y: Column) -> Column:
    """Distance to the nearest of the points; null if there are none."""
    return F.array_min(F.transform(points, lambda p: F.hypot((p["x"] - x).cast("double"), (p["y"] - y).cast("double"))))


def visible_points(points: Column, width: int, height: int) -> Column:
    """Points moved into a crop of width x height in the middle of 256 x 240, without those outside."""
    dx, dy = (256 - width) // 2, (240 - height) // 2
    moved = F.transform(points, lambda p: F.struct((p["x"] - dx).alias("x"), (p["y"] - dy).alias("y")))
    return F.filter(moved, lambda p: (p["x"] >= 0) & (p["x"] < width) & (p["y"] >= 0) & (p["y"] < height))


def collision(ram: Column, x: Column, y: Column) -> Column:
    """Collision code at a screen pixel: 0 empty, 1 floor, 2 water, 0x80 solid.

    World y is y plus vertical scroll, with 16 added where it leaves the 240 rows; the sum of x and horizontal scroll selects the other of
    the two screens on overflow. Four 2-bit codes lie in a byte, the left one highest. The last rows (from 0xE0) are empty."""
    a = y + byte(ram, VSCROLL)
    low = a.bitwiseAND(0xFF)
    wy = F.when((a > 0xFF) | (low >= 0xF0), (low + 0x10).bitwiseAND(0xFF)).otherwise(low)
    ax = x + byte(ram, HSCROLL)
    column = ax.bitwiseAND(0xFF)
    screen = byte(ram, PPUCTRL).bitwiseAND(1).bitwiseXOR(F.when(ax > 0xFF, 1).otherwise(0))
    at = F.shiftright(wy, 2).bitwiseAND(0x3C).bitwiseOR(F.shiftright(column, 6).bitwiseAND(3)).bitwiseOR(screen * 0x40)
    two = F.floor(byte(ram, at + COLLISION) / F.pow(F.lit(4), 3 - F.shiftright(column, 4).bitwiseAND(3))).cast("int").bitwiseAND(3)
    return F.when(y >= 0xE0, 0).otherwise(F.element_at(F.array(F.lit(0), F.lit(1), F.lit(2), F.lit(0x80)), two + 1))
