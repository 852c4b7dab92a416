"""Ordered-sequence operators: pairs, edges, first-after, running values, chains, islands, pairing within slots.

Every function partitions by the sequence key, never globally; ``order`` lists columns that order a sequence
completely (put a unique column last), so results don't depend on the partitioning.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.window import WindowSpec


def over(key: list[str], order: list[str]) -> WindowSpec:
    return Window.partitionBy(*key).orderBy(*order)


def so_far(key: list[str], order: list[str]) -> WindowSpec:
    return over(key, order).rowsBetween(Window.unboundedPreceding, Window.currentRow)


def strictly_before(key: list[str], order: list[str]) -> WindowSpec:
    return over(key, order).rowsBetween(Window.unboundedPreceding, -1)


def paired(df: DataFrame, key: list[str], order: list[str], columns: list[str], prefix: str = "pre_") -> DataFrame:
    """Each row with the named columns of its predecessor (null on the first row of a sequence)."""
    w = over(key, order)
    return df.withColumns({f"{prefix}{c}": F.lag(c).over(w) for c in columns})


def rising(df: DataFrame, key: list[str], order: list[str], flag: Column, name: str = "edge") -> DataFrame:
    """Adds a boolean: the flag holds here and held not on the row before. A first row can't rise."""
    w = over(key, order)
    known = df.withColumn("_f", F.coalesce(flag, F.lit(False)))
    return known.withColumn(name, F.coalesce(F.col("_f") & ~F.lag("_f").over(w), F.lit(False))).drop("_f")


def first_and_after(df: DataFrame, key: list[str], step: str, start: Column, end: Column) -> DataFrame:
    """Per sequence the first step with ``start`` and the first step with ``end`` strictly after it (nulls where none)."""
    w = Window.partitionBy(*key)
    begun = df.withColumn("_start", F.min(F.when(start, F.col(step))).over(w))
    return begun.groupBy(*key).agg(F.min("_start").alias("start_step"), F.min(F.when(end & (F.col(step) > F.col("_start")), F.col(step))).alias("end_step"))


def before_first(df: DataFrame, key: list[str], order: list[str], stop: Column) -> DataFrame:
    """Rows before the first row at which ``stop`` holds (all rows where it never does)."""
    seen = F.max(F.coalesce(stop, F.lit(False)).cast("int")).over(so_far(key, order))
    return df.withColumn("_seen", seen).where("_seen = 0").drop("_seen")


def running_sum(df: DataFrame, key: list[str], order: list[str], value: Column, name: str) -> DataFrame:
    return df.withColumn(name, F.sum(value).over(so_far(key, order)))


def wrapped_delta(pre: Column, cur: Column, wrap: float = 240, jump: float = 100) -> Column:
    """Forward movement of a counter that wraps: falls by more than ``jump`` count as a wrap; never negative."""
    d = cur - pre
    return F.greatest(d + F.when(d < -jump, F.lit(wrap)).otherwise(F.lit(0)), F.lit(0))


def anchor_chain(df: DataFrame, key: list[str], step: str, gap: float, start: Column | None = None) -> DataFrame:
    """Greedy chain per sequence: the first step (not before ``start``), then always the next step more than ``gap`` after
    the last. The greedy needs the sequence in order, so each becomes one sorted array and is folded inside the JVM.
    Columns: key, anchors (sorted array). For sequences of far over 10**5 steps use ``anchor_chain_long``."""
    first = start if start is not None else F.lit(None).cast("double")
    got = df.groupBy(*key).agg(F.sort_array(F.collect_list(step)).alias("_s"), F.first(first).alias("_from"))
    ok = F.filter("_s", lambda x: F.col("_from").isNull() | (x >= F.col("_from")))
    kind = dict(df.dtypes)[step]
    chain = F.aggregate(ok, F.array().cast(f"array<{kind}>"), lambda acc, x: F.when((F.size(acc) == 0) | (x - F.element_at(acc, -1) > gap), F.concat(acc, F.array(x))).otherwise(acc))
    return got.select(*key, chain.alias("anchors"))


def anchor_chain_long(df: DataFrame, key: list[str], step: str, gap: float) -> DataFrame:
    """The same chain for sequences too long for arrays: rows stream through Arrow in order, one value of state per sequence."""
    import numpy as np
    import pyarrow as pa

    fields = df.select(*key, step).schema

    def run(batches):
        held, last = None, 0.0
        for b in batches:
            keys, values, keep = list(zip(*(b.column(c).to_pylist() for c in key))), np.asarray(b.column(step).to_numpy(zero_copy_only=False)), []
            for i, (k, v) in enumerate(zip(keys, values)):
                if k != held or v - last > gap:
                    held, last = k, v
                    keep.append(i)
            yield b.take(pa.array(keep, pa.int64()))

    return df.select(*key, step).where(F.col(step).isNotNull()).repartition(*key).sortWithinPartitions(*key, step).mapInArrow(run, fields)


def chain_pairs(chains: DataFrame, key: list[str]) -> DataFrame:
    """Consecutive anchors: key, from_step, to_step."""
    a = F.col("anchors")
    pairs = F.transform(F.sequence(F.lit(1), F.size(a) - 1), lambda i: F.struct(F.element_at(a, i).alias("from_step"), F.element_at(a, i + 1).alias("to_step")))
    return chains.where(F.size(a) > 1).select(*key, F.inline(pairs))


def islands(df: DataFrame, key: list[str], order: list[str], value: Column) -> DataFrame:
    """Adds ``island``: a number per maximal run of equal consecutive values (nulls are equal to one another)."""
    w = over(key, order)
    v = df.withColumn("_v", value)
    new = F.when(F.lag("_v").over(w).eqNullSafe(F.col("_v")) & (F.row_number().over(w) > 1), 0).otherwise(1)
    return v.withColumn("_new", new).withColumn("island", F.sum("_new").over(so_far(key, order)).cast("bigint")).drop("_v", "_new")


def pieces(df: DataFrame, key: list[str], order: list[str], longest: int) -> DataFrame:
    """Adds ``piece``: number within its island of the piece of at most ``longest`` rows (after ``islands``)."""
    w = Window.partitionBy(*key, "island").orderBy(*order)
    return df.withColumn("piece", F.floor((F.row_number().over(w) - 1) / longest).cast("bigint"))


def nearest_within(left: DataFrame, right: DataFrame, on: list[str], left_at: str, right_at: str, tolerance: float, value: str) -> DataFrame:
    """For each left row the right row of the same key nearest in position and at most ``tolerance`` away; on ties the smaller
    (earlier, upper) one. A range join: positions are cut into cells of twice the tolerance, so the equi-join
    meets at most two cells per row instead of all pairs of a key."""
    width = max(2 * tolerance, 1e-9)
    cell = lambda c: F.floor(c / width)
    lo, hi = cell(F.col(left_at) - tolerance), cell(F.col(left_at) + tolerance)
    a = left.withColumn("_cell", F.explode(F.array_distinct(F.array(lo, hi))))
    b = right.select(*on, F.col(right_at).alias("_at"), F.col(value).alias("_value"), cell(F.col(right_at)).alias("_cell"))
    near = a.join(b, [*on, "_cell"]).where(F.abs(F.col("_at") - F.col(left_at)) <= tolerance)
    keys = left.columns
    best = near.groupBy(*keys).agg(F.min_by(F.struct("_at", "_value"), F.struct(F.abs(F.col("_at") - F.col(left_at)), F.col("_at"), F.col("_value"))).alias("_b"))
    return best.select(*keys, F.col("_b._at").alias("match_at"), F.col("_b._value").alias("match"))


def slot_lifecycle(df: DataFrame, key: list[str], step: str, kind: Column, hp: Column, active: Column, target: Column | None = None, carry: tuple[str, ...] = ()) -> DataFrame:
    """Spawn-to-kill pairs per slot (key includes the slot); columns of ``carry`` come along as they are in the step of the kill.

    At each step, in this order: a slot that was active with hp > 0 and now has hp 0 is killed; else a slot that is active and was
    not, or has another kind, spawns; else an inactive slot forgets its spawn. A kill counts if the last event before
    it is a spawn, and ``target`` (over the kind before the step, ``_pkind``) holds. Columns: key, spawn_step, kill_step, kind."""
    w = over(key, [step])
    t = df.select(*key, step, kind.alias("_kind"), hp.alias("_hp"), F.coalesce(active, F.lit(False)).alias("_active"), *carry)
    t = t.withColumns({"_pkind": F.lag("_kind").over(w), "_php": F.coalesce(F.lag("_hp").over(w), F.lit(0)), "_was": F.coalesce(F.lag("_active").over(w), F.lit(False))})
    event = F.when(F.col("_was") & (F.col("_php") > 0) & (F.col("_hp") == 0), "K").when(F.col("_active") & (~F.col("_was") | ~F.col("_kind").eqNullSafe(F.col("_pkind"))), "S").when(~F.col("_active"), "G")
    t = t.withColumn("_e", F.when(event.isNotNull(), F.struct(event.alias("e"), F.col(step).alias("at"))))
    t = t.withColumn("_last", F.last("_e", ignorenulls=True).over(strictly_before(key, [step])))
    ok = (F.col("_e.e") == "K") & (F.col("_last.e") == "S")
    if target is not None:
        ok &= target
    return t.where(ok).select(*key, F.col("_last.at").alias("spawn_step"), F.col(step).alias("kill_step"), F.col("_pkind").alias("kind"), *carry)


def item_lifecycle(df: DataFrame, key: list[str], step: str, kind: Column, active: Column, item: Column, attr: Column, carry: tuple[str, ...] = (), born: dict[str, Column] | None = None) -> DataFrame:
    """Birth-to-removal pairs of items per slot: key, origin_step, birth_step, removal_step, carrier, attr (low three bits at birth), then
    the columns of ``carry`` as they are at the removal and those of ``born`` as they are at the birth.

    At each step: an item that is gone is removed if its birth is known; a slot opens an occupancy when it becomes active, or in the step an
    item leaves it; a birth is a slot turning into an item; the carrier is what the slot last was, in this occupancy, before."""
    w = over(key, [step])
    t = df.select(*key, step, kind.alias("_kind"), F.coalesce(active, F.lit(False)).alias("_active"), F.coalesce(item, F.lit(False)).alias("_item"), attr.alias("_attr"), *carry, *[c.alias(f"_born_{n}") for n, c in (born or {}).items()])
    t = t.withColumns({"_pactive": F.lag("_active").over(w), "_pitem": F.coalesce(F.lag("_item").over(w), F.lit(False))})
    opens = F.col("_active") & (F.col("_pactive").isNull() | ~F.col("_pactive") | (F.col("_pitem") & ~F.col("_item")))
    birth = F.col("_item") & ~F.col("_pitem")
    t = t.withColumns({"_o": F.when(opens, F.col(step)), "_b": F.when(birth, F.struct(F.col(step).alias("at"), F.col("_attr").bitwiseAND(7).alias("attr"), *[F.col(f"_born_{n}").alias(n) for n in born or {}]))})
    t = t.withColumn("_occ", F.count("_o").over(so_far(key, [step])))
    occ = Window.partitionBy(*key, "_occ").orderBy(step).rowsBetween(Window.unboundedPreceding, -1)
    t = t.withColumn("_carrier", F.last(F.when(F.col("_active") & ~F.col("_item"), F.col("_kind")), ignorenulls=True).over(occ))
    # carrier as of the birth: carried along with it
    t = t.withColumn("_b", F.when(birth, F.col("_b").withField("carrier", F.coalesce("_carrier", F.lit(0)))))
    before = strictly_before(key, [step])
    t = t.withColumns({"_lastb": F.last("_b", ignorenulls=True).over(before), "_lasto": F.last("_o", ignorenulls=True).over(before)})
    return t.where(F.col("_pitem") & ~F.col("_item") & F.col("_lastb").isNotNull()).select(
        *key, F.col("_lasto").alias("origin_step"), F.col("_lastb.at").alias("birth_step"), F.col(step).alias("removal_step"), F.col("_lastb.carrier").alias("carrier"), F.col("_lastb.attr").alias("attr"), *carry, *[F.col(f"_lastb.{n}").alias(n) for n in born or {}])


def pick_or_avoid(items: DataFrame, event_fired: Column, attr: Column, gun: Column, guns: tuple[int, ...] = (1, 2, 3, 4), require_armed: bool = True) -> DataFrame:
    """Adds ``outcome``: ``pick`` if the item's own event fires at its removal, ``avoid`` if it is a gun other than the held one (and the held
    one is a gun, unless not required), else null."""
    armed = gun.isin(*guns) if require_armed else F.lit(True)
    return items.withColumn("outcome", F.when(event_fired, "pick").when(attr.isin(*guns) & (attr != gun) & armed, "avoid"))


def goal_frame(df: DataFrame, key: list[str], frame: str, amount: Column) -> DataFrame:
    """Per key the frame with the largest amount, the earliest on ties, and that amount; null amounts count as 0."""
    n = F.coalesce(amount, F.lit(0))
    return df.groupBy(*key).agg(F.max_by(frame, F.struct(n, -F.col(frame))).alias("frame"), F.max(n).alias("amount"))


def every_nth(df: DataFrame, index: Column, boundary: Column, n: int) -> DataFrame:
    """Rows at the boundary and every n-th after it."""
    return df.where((index >= boundary) & (F.pmod(index - boundary, F.lit(n)) == 0))


def outcome(df: DataFrame, key: list[str], tag: str, ranked: dict[str, list[str]], otherwise: str) -> DataFrame:
    """Per key the first outcome (in the order of ``ranked``) one of whose tags occurs."""
    result = F.lit(otherwise)
    for name, tags in reversed(list(ranked.items())):
        result = F.when(F.bool_or(F.coalesce(F.col(tag).isin(*tags), F.lit(False))), F.lit(name)).otherwise(result)
    return df.groupBy(*key).agg(result.alias("outcome"))


def tag_summary(df: DataFrame, tag: str, order: list[str]) -> DataFrame:
    """Counts per tag, most common first, on ties the one seen first: tag, n, rank (from 1)."""
    n = df.groupBy(tag).agg(F.count("*").alias("n"), F.min(F.struct(*order)).alias("_first"))
    return n.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("n"), "_first"))).drop("_first")  # one row per tag


def state_signature(df: DataFrame, key: list[str], step: str, damage: Column, features: list[Column], bins: int = 20) -> DataFrame:
    """Progress-aligned signature: per key and bin the first row whose share of the damage done reaches bin / (bins - 1).

    ``damage`` is the raw decrement of the row (negative counts as 0). Columns: key, bin, idx (rank of the row from 0), feature columns f0... The
    bins of a row are computed from its and its predecessor's progress, so no row meets all bins."""
    w = over(key, [step])
    run = so_far(key, [step])
    t = df.select(*key, step, *[c.alias(f"f{i}") for i, c in enumerate(features)], F.greatest(damage, F.lit(0)).alias("_d"))
    t = t.withColumns({"_run": F.sum("_d").over(run), "idx": (F.row_number().over(w) - 1).cast("bigint"), "_all": F.sum("_d").over(Window.partitionBy(*key)), "_n": F.count("*").over(Window.partitionBy(*key))})
    total = F.greatest(F.col("_all"), F.lit(1))
    here, before = F.col("_run") / total, F.coalesce((F.col("_run") - F.col("_d")) / total, F.lit(0.0))
    # targets t with before < t <= here; the first row also takes t = 0, the last row all that is never reached
    top = F.when(F.col("idx") == F.col("_n") - 1, F.lit(bins - 1)).otherwise(F.least(F.floor(here * (bins - 1) + 1e-9), F.lit(bins - 1)))
    low = F.when(F.col("idx") == 0, F.lit(0)).otherwise(F.floor(before * (bins - 1) + 1e-9) + 1)
    t = t.where(low <= top).withColumn("bin", F.explode(F.sequence(low.cast("bigint"), top.cast("bigint"))))
    return t.select(*key, "bin", "idx", *[f"f{i}" for i in range(len(features))])
