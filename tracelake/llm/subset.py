"""Choosing a varied subset: k-means, square-root quotas per cluster, sampling within the quotas.

A record's vector joins its state signature, the frequencies of its n-grams and its weapon; every distinct n-gram and
weapon has a dimension of its own. K-means is seeded by
k-means|| and fitted in passes over all records: each task sums up its own, the sums are merged. Of a request the clusters get places in
proportion to the square root of their size, unused places go to the others by the same rule, and within a cluster records are
drawn in hash order. Ranks are counted over hash buckets, so a cluster that holds most records is never one task.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracelake.llm.common import flat
from tracelake.plans.staging import spread, stage

BINS, WIDTH = 20, 8


def weapon_name(c: Column) -> Column:
    """One spelling per weapon: letters and digits in lower case; blank is null."""
    clean = F.regexp_replace(F.lower(c), "[^a-z0-9]+", "")
    return F.when(clean != "", clean)


def _packed(values: np.ndarray, lengths: np.ndarray) -> pa.Array:
    """Binary column: of every row its ``lengths`` values, one row after the other."""
    ends = np.concatenate([[0], np.cumsum(lengths * values.itemsize)]).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(lengths), [None, pa.py_buffer(ends), pa.py_buffer(np.ascontiguousarray(values))])


def _unpacked(column: pa.Array, kind: type) -> tuple[np.ndarray, np.ndarray]:
    """Values and lengths of a column made by ``_packed``."""
    ends = np.frombuffer(column.buffers()[1], dtype=np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    size = np.dtype(kind).itemsize
    return np.frombuffer(column.buffers()[2], dtype=kind, count=int(ends[-1] - ends[0]) // size, offset=int(ends[0])), np.diff(ends) // size


def _names(rows: DataFrame) -> tuple[dict[str, int], dict[str, int], int]:
    """A dimension for every distinct n-gram and for every distinct weapon, behind those of the state; the number of all dimensions.

    The driver holds the distinct names, whose number the alphabet of the steps bounds (512 codes, 512² pairs), not the records."""
    name = F.concat(F.transform("grams", lambda g: F.struct(F.lit(False).alias("weapon"), g.alias("name"))), F.array(F.struct(F.lit(True).alias("weapon"), F.col("weapon").alias("name"))))
    got = sorted(tuple(r) for r in rows.select(F.inline(name)).where("name IS NOT NULL").distinct().collect())
    at = {key: BINS * WIDTH + i for i, key in enumerate(got)}
    return {n: i for (w, n), i in at.items() if not w}, {n: i for (w, n), i in at.items() if w}, BINS * WIDTH + len(at)


def _features(grams: dict[str, int], weapons: dict[str, int], dim: int):
    """Rows as packed numbers, made once for all passes: the state, and dimension and value of what isn't 0 of the rest.

    Missing parts of a record are 0: absent states and bins, absent n-grams, unknown weapon. Of a state with more bins than BINS each bin is the mean of its share of them."""

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n = b.num_rows
            state = np.zeros((n, BINS * WIDTH), dtype=np.float32)
            values, offsets = flat(b.column("state"))  # already flattened rows of numbers
            lengths = np.diff(offsets)
            rec = np.repeat(np.arange(n), lengths)
            place = np.arange(lengths.sum()) - offsets[:-1][rec]
            bins = -(-lengths // WIDTH)
            place = np.where(bins[rec] > BINS, place // WIDTH * BINS // np.maximum(bins[rec], 1) * WIDTH + place % WIDTH, place)
            at = rec * BINS * WIDTH + place
            mean = np.bincount(at, np.nan_to_num(values.astype(np.float64), posinf=0, neginf=0), state.size) / np.maximum(np.bincount(at, minlength=state.size), 1)
            state = mean.astype(np.float32).reshape(state.shape)
            (counts, offsets), (keys, _) = flat(b.column("counts")), flat(b.column("grams"))
            rec = np.repeat(np.arange(n), np.diff(offsets))
            names, code = np.unique(keys.astype(str), return_inverse=True) if len(keys) else (np.zeros(0, str), np.zeros(0, int))
            slot = np.array([grams[k] for k in names], dtype=np.int64)
            at, once = np.unique(rec * dim + slot[code], return_inverse=True)  # a dimension once a record
            count = np.maximum(np.bincount(once, np.nan_to_num(counts.astype(np.float64)), len(at)), 0)
            rec, dims = at // dim, at % dim
            value = np.sqrt(count / np.maximum(np.bincount(rec, count, n), 1)[rec]) * 2
            weapon = [(i, weapons[w]) for i, w in enumerate(b.column("weapon").to_pylist()) if w]
            own = np.array(weapon, dtype=np.int64).reshape(-1, 2)
            rec, dims, value = np.concatenate([rec, own[:, 0]]), np.concatenate([dims, own[:, 1]]), np.concatenate([value, np.ones(len(own))])
            order, lengths = np.argsort(rec, kind="stable"), np.bincount(rec, minlength=n)
            yield pa.RecordBatch.from_arrays([b.column("uid"), b.column("weapon"), _packed(state, np.full(n, BINS * WIDTH)), _packed(dims[order].astype(np.int32), lengths), _packed(value[order].astype(np.float32), lengths)], names=["uid", "weapon", "state", "dims", "vals"])

    return features


def _vectors(b: pa.RecordBatch, dim: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    """Blocks of the batch with their vectors, as many rows at once as take 32 MB."""
    step = max(1, (1 << 23) // dim)
    for i in range(0, b.num_rows, step):
        part = b.slice(i, step)
        out = np.zeros((part.num_rows, dim), dtype=np.float32)
        out[:, : BINS * WIDTH] = _unpacked(part.column("state"), np.float32)[0].reshape(part.num_rows, -1)
        (dims, lengths), (vals, _) = _unpacked(part.column("dims"), np.int32), _unpacked(part.column("vals"), np.float32)
        out[np.repeat(np.arange(part.num_rows), lengths), dims] = vals
        yield part, out


def _nearest(x: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Nearest centre of each row, and the square of its distance (0 also where only rounding differs)."""
    d = (c**2).sum(1)[None] - 2 * x @ c.T
    at, own = d.argmin(1), (x**2).sum(1)
    near = d[np.arange(len(x)), at] + own
    return at, np.where(near > 1e-5 * (1 + own), near, 0)


def _draw(rows: DataFrame, dim: int, centres: np.ndarray | None, n: int, seed: int) -> np.ndarray:
    """n rows out of all, without replacement, drawn in proportion to the squared distance from the centres (without centres evenly)."""

    def draw(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, vecs = np.zeros(0), np.zeros((0, dim), dtype=np.float32)
        for b in batches:
            for part, x in _vectors(b, dim):
                u = (part.column("h").to_numpy(zero_copy_only=False) + 1) / (1 << 40)
                w = np.ones(len(x)) if centres is None else _nearest(x, centres)[1].astype(np.float64)
                key = np.where(w > 0, -np.log(u) / np.maximum(w, 1e-300), np.inf)
                keys, vecs = np.concatenate([keys, key]), np.concatenate([vecs, x])
                best = np.argsort(keys, kind="stable")[:n]
                best = best[np.isfinite(keys[best])]
                keys, vecs = keys[best], vecs[best]
        yield pa.RecordBatch.from_arrays([pa.array(keys), _packed(vecs, np.full(len(keys), dim))], names=["key", "vec"])

    hashed = rows.withColumn("h", F.pmod(F.xxhash64("uid", F.lit(seed)), F.lit(1 << 40)))
    got = hashed.mapInArrow(draw, "key double, vec binary").orderBy("key").limit(n).collect()
    return np.array([np.frombuffer(r.vec, dtype=np.float32) for r in got]).reshape(-1, dim)


def _totals(rows: DataFrame, dim: int, centres: np.ndarray) -> list:
    """Per centre with records: cluster, n, cost (squared distances), sums of the vectors. A task gives a row per centre, merged by centre."""

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        k = len(centres)
        n, cost, sums = np.zeros(k, dtype=np.int64), np.zeros(k), np.zeros((k, dim))
        for b in batches:
            for _, x in _vectors(b, dim):
                at, near = _nearest(x, centres)
                n += np.bincount(at, minlength=k)
                cost += np.bincount(at, near, k)
                for j in np.unique(at):
                    sums[j] += x[at == j].sum(0, dtype=np.float64)
        has = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(has.astype(np.int32)), pa.array(n[has]), pa.array(cost[has]), _packed(sums[has], np.full(len(has), dim))], names=["cluster", "n", "cost", "sums"])

    def merge(t: pa.Table) -> pa.Table:
        order = np.argsort(t.column("cost").to_numpy(), kind="stable")  # sums don't depend on the order of arrival
        total = np.array([np.frombuffer(v.as_py(), dtype=np.float64) for v in t.column("sums").combine_chunks()])[order].sum(0)
        return pa.table({"cluster": t.column("cluster")[:1], "n": [int(t.column("n").to_numpy().sum())], "cost": [float(t.column("cost").to_numpy()[order].sum())], "sums": [total.tobytes()]})

    schema = "cluster int, n bigint, cost double, sums binary"
    return rows.mapInArrow(part, schema).groupBy("cluster").applyInArrow(merge, schema).collect()  # k rows


def _seeds(rows: DataFrame, dim: int, k: int, rounds: int = 4) -> np.ndarray:
    """k-means||: in each round 2 k of all records, by their distance from what was drawn before; of those k by k-means++, each with the number of records it is nearest to."""
    drawn = _draw(rows, dim, None, 2 * k, 9)
    for i in range(rounds):
        drawn = np.concatenate([drawn, _draw(rows, dim, drawn, 2 * k, 10 + i)])
    weight = np.zeros(len(drawn))
    for r in _totals(rows, dim, drawn):
        weight[r.cluster] = r.n
    rng = np.random.default_rng(3)
    picked = [int(weight.argmax())]
    near = ((drawn - drawn[picked[0]]) ** 2).sum(1)
    while len(picked) < k and (p := weight * near).sum() > 0:
        picked.append(int(rng.choice(len(drawn), p=p / p.sum())))
        near = np.minimum(near, ((drawn - drawn[picked[-1]]) ** 2).sum(1))
    return drawn[picked]


def fitted(rows: DataFrame, dim: int, k: int, passes: int = 20, least: float = 1e-3) -> np.ndarray:
    """Centres of k-means over all records: a pass moves each centre to the mean of its records, until the squared distances fall by less than ``least``."""
    centres, before = _seeds(rows, dim, k), np.inf
    for _ in range(passes):
        got = _totals(rows, dim, centres)
        for r in got:
            centres[r.cluster] = np.frombuffer(r.sums, dtype=np.float64) / r.n
        cost = sum(r.cost for r in got)
        if cost >= before * (1 - least):
            break
        before = cost
    return centres


def _assign(centres: np.ndarray):
    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for part, x in _vectors(b, centres.shape[1]):
                yield pa.RecordBatch.from_arrays([part.column("uid"), part.column("weapon"), pa.array(_nearest(x, centres)[0].astype(np.int32))], names=["uid", "weapon", "cluster"])

    return assign


def quotas(sizes: dict[int, int], places: int) -> dict[int, int]:
    """Whole places per cluster, in proportion to the root of its size, at most its size, adding to min(places, all)."""
    places = min(places, sum(sizes.values()))
    share: dict[int, float] = {}
    left, open_ = float(places), {c for c in sizes if sizes[c] > 0}
    while open_:
        weight = sum(sizes[c] ** 0.5 for c in open_)
        full = {c for c in open_ if left * sizes[c] ** 0.5 / weight >= sizes[c]}
        if not full:
            share |= {c: left * sizes[c] ** 0.5 / weight for c in open_}
            break
        for c in full:
            share[c] = float(sizes[c])
            left -= sizes[c]
        open_ -= full
    whole = {c: int(v + 1e-9) for c, v in share.items()}
    for c in sorted(share, key=lambda c: (whole[c] - share[c], c)):
        if sum(whole.values()) < places and whole[c] < sizes[c]:
            whole[c] += 1
    return whole


def clustered(features: DataFrame, k: int = 48) -> DataFrame:
    """uid, weapon (one spelling), cluster of every distinct record."""
    num = F.transform(F.flatten("state"), lambda v: F.coalesce(v, F.lit(0.0)).cast("float"))
    rows = features.where("uid IS NOT NULL").select("uid", weapon_name(F.col("weapon")).alias("weapon"), F.coalesce(num, F.array().cast("array<float>")).alias("state"),
        F.coalesce(F.map_keys("ngrams"), F.array().cast("array<string>")).alias("grams"), F.coalesce(F.transform(F.map_values("ngrams"), lambda v: F.coalesce(v, F.lit(0))), F.array().cast("array<bigint>")).alias("counts"))
    rows = stage(spread(rows, "uid").dropDuplicates(["uid"]), "records")
    if rows.isEmpty():
        return rows.select("uid", "weapon", F.lit(0).alias("cluster"))
    grams, weapons, dim = _names(rows)
    rows = stage(rows.mapInArrow(_features(grams, weapons, dim), "uid string, weapon string, state binary, dims binary, vals binary"), "features")
    return rows.mapInArrow(_assign(fitted(rows, dim, k)), "uid string, weapon string, cluster int")


def chosen(features: DataFrame, requests: DataFrame, k: int = 48, buckets: int = 256) -> DataFrame:
    """request_id, uid, weapon, cluster of the chosen records: round(subset_fraction * records of the weapon) of each request.

    A null weapon asks for all records, also those of unknown weapon; a null or negative fraction for none, one over 1 for all."""
    rows = clustered(features, k)
    asked = requests.where("request_id IS NOT NULL").select("request_id", F.coalesce(weapon_name(F.col("weapon")), F.lit("*")).alias("wanted"), F.coalesce("subset_fraction", F.lit(0.0)).alias("fraction"))
    fit = stage(rows.withColumn("wanted", F.explode(F.array_compact(F.array(F.lit("*"), "weapon")))).join(asked, "wanted").select(
        "request_id", "fraction", "uid", "weapon", "cluster", F.xxhash64("uid", F.lit(13)).alias("h")), "asked")
    sizes: dict[tuple[int, float], dict[int, int]] = {}
    for r in fit.groupBy("request_id", "fraction", "cluster").agg(F.count("*").alias("n")).collect():  # requests * k rows
        sizes.setdefault((r.request_id, r.fraction), {})[r.cluster] = r.n
    plan = [(q, c, n) for (q, f), by in sizes.items() for c, n in quotas(by, int(sum(by.values()) * min(1.0, max(0.0, f)) + 0.5)).items()]
    quota = rows.sparkSession.createDataFrame(plan, "request_id int, cluster int, quota int")
    fit = fit.withColumn("bucket", F.pmod("h", F.lit(buckets)))
    key = ["request_id", "cluster"]
    w = Window.partitionBy(*key).orderBy("bucket")
    before = fit.groupBy(*key, "bucket").agg(F.count("*").alias("n")).withColumn("before", F.sum("n").over(w) - F.col("n")).join(quota, key).where("before < quota")
    inside = Window.partitionBy(*key, "bucket").orderBy("h", "uid")
    return fit.join(before, [*key, "bucket"]).withColumn("r", F.row_number().over(inside)).where("before + r <= quota").select("request_id", "uid", "weapon", "cluster")


def coverage(features: DataFrame, requests: DataFrame) -> DataFrame:
    """Per request and cluster: how many were chosen."""
    return chosen(features, requests).groupBy("request_id", "cluster").agg(F.count("*").alias("chosen"), F.countDistinct("weapon").alias("weapons"))


def sizes(features: DataFrame, requests: DataFrame) -> DataFrame:
    """Per request: chosen records and how many different ones."""
    return chosen(features, requests).groupBy("request_id").agg(F.count("*").alias("chosen"), F.countDistinct("uid").alias("records"))
