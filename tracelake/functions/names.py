"""Names, paths and schedules."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Parts of processor names and what was decided for them, in order of precedence.
CPU_CLASSES = (("Platinum 8468", "keep"), ("Platinum 8352V", "keep"), ("Gold 6133", "drop"), ("E5-2698 v4", "drop"))


def cpu_decision(model: Column, cores: Column, least: int = 8) -> Column:
    """drop below ``least`` cores, else by the first class in the model's name, else unknown."""
    out = F.when(F.coalesce(cores, F.lit(0)) < least, "drop")
    for part, decision in CPU_CLASSES:
        out = out.when(F.contains(model, F.lit(part)), decision)
    return out.otherwise("unknown")


def marker_location(path: Column) -> Column:
    """level, scope, worker of a marker path ``.../level<n>/<scope>/.../batches/<worker>/...``; an error where malformed."""
    pattern = r"(?:^|/)level([1-8])/([^/]+)/(?:.*/)?batches/([^/]+)(?:/|$)"
    bad = F.raise_error(F.concat(F.lit("not a marker path: "), path))
    level = F.regexp_extract(path, pattern, 1)
    return F.struct(F.when(level != "", level).otherwise(bad.cast("string")).cast("int").alias("level"), F.regexp_extract(path, pattern, 2).alias("scope"), F.regexp_extract(path, pattern, 3).alias("worker"))


def object_uri(uri: Column) -> Column:
    """bucket and prefix (without outer slashes) of an object store URI ``<scheme>://bucket/prefix``; an error without scheme or bucket."""
    pattern = r"^[a-z0-9]+://([^/]+)(?:/(.*))?$"
    bucket = F.regexp_extract(uri, pattern, 1)
    bad = F.raise_error(F.concat(F.lit("not an object URI: "), uri)).cast("string")
    return F.struct(F.when(bucket != "", bucket).otherwise(bad).alias("bucket"), F.regexp_replace(F.regexp_extract(uri, pattern, 2), r"^/+|/+$", "").alias("prefix"))


def level_in_name(name: Column) -> Column:
    """The digits after ``level`` or ``lv`` in a name; null where there are none."""
    d = F.regexp_extract(name, r"(?:level|lv)_?(\d+)", 1)
    return F.when(d != "", d.cast("int"))


def episode_uid(prefix: Column, number: Column) -> Column:
    return F.format_string("%s_%06d", prefix, number)


def warmup_cosine(step: Column, base: float, warmup: int, total: int) -> Column:
    """Linear rise over ``warmup`` steps, then a cosine down to 0 at ``total``."""
    progress = F.least((step - warmup) / max(1, total - warmup), F.lit(1.0))
    return F.when(step < warmup, (step + 1) * (base / max(warmup, 1))).otherwise(F.lit(base * 0.5) * (1 + F.cos(progress * F.lit(3.141592653589793))))


def warmup_stable_decay(step: Column, base: float, warmup: int, decay_start: int, total: int) -> Column:
    """Rise, constant phase, cosine decay from ``decay_start``."""
    progress = F.least((step - decay_start) / max(1, total - decay_start), F.lit(1.0))
    return F.when(step < warmup, (step + 1) * (base / max(warmup, 1))).when(step < decay_start, F.lit(base)).otherwise(F.lit(base * 0.5) * (1 + F.cos(progress * F.lit(3.141592653589793))))


def value_text(v: Column) -> Column:
    """A number for display: whole ones without a fraction, others with two digits."""
    return F.when(v == F.floor(v), F.floor(v).cast("bigint").cast("string")).when(v.isNotNull(), F.format_string("%.2f", v.cast("double")))


def target_text(meta: Column, level: Column) -> Column:
    """What a task is about, from its ``meta``: the enemy and its slot, or the item; empty where neither is given."""
    from tracelake.functions.ram import ITEMS, type_name

    kind, slot, item = (F.try_element_at(meta, F.lit(k)) for k in ("enemy_type", "slot", "item_weapon"))
    items = F.create_map(*[F.lit(x) for kv in ITEMS.items() for x in kv])
    enemy = F.concat(F.lit("target: "), type_name(kind.cast("int"), level), F.coalesce(F.concat(F.lit("  slot "), slot), F.lit("")))
    return F.when(kind.isNotNull(), enemy).when(item.isNotNull(), F.concat(F.lit("item: "), F.coalesce(F.try_element_at(items, item.cast("int")), F.lit("?")))).otherwise("")
