"""The k most similar vectors of every vector, by a hierarchical k-means tree with best-bin-first traversal.

* *Tree.* Fitted per collection on a bounded sample (``sample`` rows, by id hash); every row is indexed. Nodes split by
  k-means until a leaf stands for about ``leaf`` rows.
* *Traversal.* Nodes wait in a priority queue by their margin, the distance from the query to the border of the node; the
  best is taken, an inner node puts its children in, a leaf is visited. This runs for whole batches of queries at once.
* *Widening.* The visits go on until the margin exceeds the reach, which is calibrated: with a radius on points moved from
  sampled rows by just the radius, else on sampled queries whose true neighbours come from one pass over all rows. The reach is
  the quantile of the margins at the wanted recall, so queries near borders visit more leaves than others.
* *Join.* Each row goes to its home leaf, each query to the leaves it visits; one shuffle by leaf, then a matrix product
  per leaf and a top k per query. Leaves of many rows are cut into blocks of members and of queries, so that no task
  grows with the largest leaf. Exact copies are one row of the index; they are put in again at the end, k at most per
  neighbour list, as more can't be among the k nearest.
"""

from __future__ import annotations

from collections.abc import Iterator
from heapq import heappop, heappush
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracelake.llm.common import flat
from tracelake.plans.staging import spread, stage

BLOCK = 4000  # members or queries of one leaf in one task


class Tree:
    """Centres of all nodes; the children of a node stand in a row (those of the root first). ``leaf`` is the leaf's number or -1."""

    def __init__(self, sample: np.ndarray, leaf_rows: float, branch: int = 16, seed: int = 7):
        rng = np.random.default_rng(seed)
        centres, parts = self._split(sample, leaf_rows, branch, rng)
        centre, first, leaf, queue, leaves = list(centres), [-1] * len(centres), [-1] * len(centres), list(enumerate(parts)), 0
        self.family: dict[int, tuple[int, int]] = {-1: (0, len(centres))}
        for node, part in queue:  # grows while it is read
            centres, parts = self._split(part, leaf_rows, branch, rng) if len(part) > max(leaf_rows, 4) else ([], [])
            if len(centres) < 2:
                leaf[node], leaves = leaves, leaves + 1
                continue
            self.family[node] = (len(centre), len(centre) + len(centres))
            queue += [(len(centre) + i, p) for i, p in enumerate(parts)]
            centre += list(centres)
            leaf += [-1] * len(centres)
        self.leaf, self.leaves, self.matrix = leaf, leaves, np.array(centre, dtype=np.float32)
        self.norms = (self.matrix**2).sum(1)
        self.apart = {}
        for node, (i, j) in self.family.items():
            c = self.matrix[i:j]
            self.apart[node] = 2 * np.sqrt(np.maximum(((c[:, None] - c[None]) ** 2).sum(2), 1e-12))

    @staticmethod
    def _split(x: np.ndarray, leaf_rows: float, branch: int, rng: np.random.Generator) -> tuple[np.ndarray, list[np.ndarray]]:
        k = int(min(branch, max(1, np.ceil(len(x) / leaf_rows))))
        centres = x[rng.choice(len(x), k, replace=False)].astype(np.float32)
        for _ in range(8):
            at = ((centres**2).sum(1)[None] - 2 * x @ centres.T).argmin(1)
            total = np.zeros_like(centres)
            np.add.at(total, at, x)
            n = np.bincount(at, minlength=k)
            centres = np.where(n[:, None] > 0, total / np.maximum(n, 1)[:, None], x[rng.choice(len(x), k)])
        at = ((centres**2).sum(1)[None] - 2 * x @ centres.T).argmin(1)
        some = np.unique(at)
        return centres[some], [x[at == i] for i in some]

    def visits(self, x: np.ndarray, reach: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Row, leaf and margin of all leaves that rows of x visit: the queue is worked off by margin, up to ``reach``. The margin of
        a node is the distance to the border between it and its nearest sibling, or that of its parent if larger; it is 0 on the way home."""
        out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        ticket = count()
        wait = [(0.0, next(ticket), -1, np.arange(len(x)), np.zeros(len(x), dtype=np.float32))]
        while wait:
            _, _, node, rows, margin = heappop(wait)
            i, j = self.family[node]
            d = self.norms[i:j] - 2 * x[rows] @ self.matrix[i:j].T
            near = d.argmin(1)
            m = np.maximum((d - np.take_along_axis(d, near[:, None], 1)) / self.apart[node][near], margin[:, None])
            m[np.arange(len(rows)), near] = margin
            for k in range(i, j):
                go = m[:, k - i] <= reach
                if not go.any():
                    continue
                if self.leaf[k] >= 0:
                    out.append((rows[go], np.full(go.sum(), self.leaf[k], dtype=np.int32), m[go, k - i]))
                else:
                    heappush(wait, (float(m[go, k - i].min()), next(ticket), k, rows[go], m[go, k - i]))
        return tuple(np.concatenate([o[n] for o in out]) for n in range(3)) if out else (np.zeros(0, np.int64), np.zeros(0, np.int32), np.zeros(0, np.float32))

    def homes(self, x: np.ndarray) -> np.ndarray:
        """The leaf each row of x belongs to."""
        out = np.zeros(len(x), dtype=np.int32)
        rows, leaf, margin = self.visits(x, 0.0)
        order = np.argsort(rows[::-1], kind="stable")  # of equal centres the first leaf
        out[rows[::-1][order]] = leaf[::-1][order]
        return out

    def margins(self, x: np.ndarray, leaf: np.ndarray) -> np.ndarray:
        """Margin at which each row of x visits the given leaf."""
        rows, leaves, margin = self.visits(x, np.inf)
        table = np.full((len(x), self.leaves), np.inf, dtype=np.float32)
        table[rows, leaves] = margin
        return table[np.arange(len(x)), leaf]


def _encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Vectors as bytes: half precision where that loses nothing, else single. Less than half of what rows of floats take."""
    for b in batches:
        values, offsets = flat(b.column("vec"))
        values = values.astype(np.float32)
        with np.errstate(over="ignore"):
            half = values.astype(np.float16)
        exact = np.r_[0, np.cumsum(half.astype(np.float32) != values)]
        code = [(half if exact[j] == exact[i] else values)[i:j].tobytes() for i, j in zip(offsets[:-1].tolist(), offsets[1:].tolist())]
        yield pa.RecordBatch.from_arrays([b.column("grp"), b.column("id"), b.column("query"), pa.array((np.diff(offsets)).astype(np.int32)), pa.array(code, pa.binary())], names=["grp", "id", "query", "dim", "code"])


def _matrix(codes: pa.Array, dim: int, unit: bool, kind: type = np.float32) -> np.ndarray:
    x = np.empty((len(codes), dim), dtype=np.float32)
    for i, c in enumerate(codes.to_pylist()):
        x[i] = np.frombuffer(c, dtype=np.float16 if len(c) == 2 * dim else np.float32)
    x = x.astype(kind)
    return x / np.linalg.norm(x.astype(np.float64), axis=1, keepdims=True).astype(kind) if unit else x


def _rows(part: pa.RecordBatch | pa.Table, unit: bool, kind: type = np.float32) -> np.ndarray:
    return _matrix(part.column("code"), part.column("dim")[0].as_py() if part.num_rows else 0, unit, kind)


def _by_group(batch: pa.RecordBatch) -> Iterator[tuple[str, pa.Array]]:
    grp = np.asarray(batch.column("grp").to_pylist(), dtype=object)
    for g in dict.fromkeys(grp):
        yield g, pa.array(np.flatnonzero(grp == g))


def _assign(trees: dict[str, Tree], reach: dict[str, float], unit: bool, cuts: dict[tuple[str, int], tuple[int, int]] | None):
    """Without cuts: leaf and role only, to count. With cuts: a row per leaf and block, with the vector. Roles: 0 member,
    1 query, 2 both (the row in its home leaf, where that isn't cut)."""

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 4000):
                for g, rows in _by_group(b := whole.slice(at, 4000)):
                    part = b.take(rows)
                    query = np.asarray(part.column("query").to_pylist(), dtype=bool)
                    x = _rows(part, unit)
                    home = trees[g].homes(x)
                    src, leaf, _ = trees[g].visits(x[query], reach[g])
                    src = np.flatnonzero(query)[src]
                    other = leaf != home[src]
                    src, leaf, role = np.r_[np.arange(len(x)), src[other]], np.r_[home, leaf[other]], np.r_[np.where(query, 2, 0), np.ones(other.sum(), dtype=np.int64)]
                    if cuts is None:
                        yield pa.RecordBatch.from_arrays([pa.array([g] * len(leaf)), pa.array(leaf.astype(np.int32)), pa.array(role.astype(np.int8))], names=["grp", "leaf", "role"])
                        continue
                    mc, qc = (np.array([cuts[g, int(i)][j] for i in leaf]) for j in (0, 1))
                    both = (role == 2) & (mc * qc > 1)  # in a leaf that is cut a row's two roles go to different blocks
                    src, leaf, mc, qc, role = (np.r_[v, v[both]] for v in (src, leaf, mc, qc, np.where(both, 0, role)))
                    role[len(role) - both.sum() :] = 1
                    salt, member = np.asarray(part.column("salt"))[src], role != 1
                    # a member takes its own block of members and meets all blocks of queries; a query the other way round
                    own, copies = np.where(member, salt % mc, salt % qc), np.where(member, qc, mc)
                    i = np.repeat(np.arange(len(leaf)), copies)
                    nth = np.arange(len(i)) - (np.cumsum(copies) - copies)[i]
                    block = np.where(member[i], own[i] * qc[i] + nth, nth * qc[i] + own[i])
                    take = pa.array(src[i])
                    yield pa.RecordBatch.from_arrays([
                        part.column("grp").take(take), pa.array(leaf[i].astype(np.int32)), pa.array(block.astype(np.int32)), pa.array(role[i].astype(np.int8)),
                        part.column("id").take(take), part.column("dim").take(take), part.column("code").take(take)], names=["grp", "leaf", "block", "role", "id", "dim", "code"])

    return assign


def _nearest(k: int, unit: bool, most: float | None):
    """Top k members per query of one block. Distances are exact (double) for what is put out."""

    def nearest(part: pa.Table) -> pa.Table:
        role = part.column("role").to_numpy()
        ids = np.asarray(part.column("id").to_pylist(), dtype=object)
        codes = part.column("code").combine_chunks()
        dim = part.column("dim")[0].as_py() if part.num_rows else 0
        raw = _matrix(codes, dim, False)  # exact, also where the codes are of half precision
        norm = np.linalg.norm(raw.astype(np.float64), axis=1, keepdims=True) if unit else None
        x = raw / norm.astype(np.float32) if unit else raw
        m, q = np.flatnonzero(role != 1), np.flatnonzero(role != 0)
        out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        sq = (x[m] ** 2).sum(1)
        limit = np.inf if most is None else (2 * (1 - most) if unit else most**2 * dim) + 1e-3
        for i in range(0, len(q) if len(m) else 0, 512):
            rows = q[i : i + 512]
            d = np.maximum((x[rows] ** 2).sum(1)[:, None] + sq[None] - 2 * x[rows] @ x[m].T, 0)
            if most is not None:
                d[d > limit] = np.inf
            n = min(k + 6, len(m))  # a few more than k and itself, as single precision may order near ties otherwise
            top = np.argpartition(d, n - 1, axis=1)[:, :n] if n < len(m) else np.tile(np.arange(len(m)), (len(rows), 1))
            r, c = np.nonzero(np.isfinite(np.take_along_axis(d, top, 1)))
            a, b = rows[r], m[top[r, c]]
            differ = ids[a] != ids[b]
            r, a, b = r[differ], a[differ], b[differ]
            if not len(r):
                continue
            u, v = (raw[w].astype(np.float64) / norm[w] if unit else raw[w].astype(np.float64) for w in (a, b))
            exact = (u * v).sum(1) if unit else np.sqrt(((u - v) ** 2).mean(1))
            order = np.lexsort((-exact if unit else exact, r))
            r, a, b, exact = r[order], a[order], b[order], exact[order]
            place = np.arange(len(r)) - np.searchsorted(r, r)
            ok = (place < k) if most is None else (place < k) & ((exact >= most) if unit else (exact <= most))
            out.append((ids[a[ok]], ids[b[ok]], exact[ok]))
        cat = [np.concatenate([o[i] for o in out]).tolist() if out else [] for i in range(3)]
        g = part.column("grp")[0].as_py() if part.num_rows else None
        return pa.table({"grp": pa.array([g] * len(cat[0]), pa.string()), "q": pa.array(cat[0], pa.string()), "m": pa.array(cat[1], pa.string()), "value": pa.array(cat[2], pa.float64())})

    return nearest


def _moved(x: np.ndarray, unit: bool, most: float, rng: np.random.Generator) -> np.ndarray:
    """Points at just the radius from x, in random directions."""
    step = rng.normal(size=x.shape)
    if not unit:
        return (x + step / np.linalg.norm(step, axis=1, keepdims=True) * most * np.sqrt(x.shape[1])).astype(np.float32)
    step -= (step * x).sum(1, keepdims=True) * x
    step /= np.linalg.norm(step, axis=1, keepdims=True)
    return (most * x + np.sqrt(1 - most**2) * step).astype(np.float32)


def _scan(trees: dict[str, Tree], probes: dict[str, tuple[list[str], np.ndarray]], k: int, unit: bool):
    """One pass over all rows: for each probe the k nearest rows of the batch and their home leaves."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for g, rows in _by_group(b):
                part, (names, p) = b.take(rows), probes[g]
                x, ids = _rows(part, unit), np.asarray(part.column("id").to_pylist(), dtype=object)
                d = (x**2).sum(1)[None] - 2 * p @ x.T
                d[np.asarray(names, dtype=object)[:, None] == ids[None]] = np.inf
                n = min(k, len(ids))
                top = np.argpartition(d, n - 1, axis=1)[:, :n]
                some, at = np.unique(top.ravel(), return_inverse=True)
                yield pa.RecordBatch.from_arrays([
                    pa.array([g] * top.size), pa.array(np.repeat(np.arange(len(names)), n).astype(np.int32)), pa.array(ids[top.ravel()].tolist(), pa.string()),
                    pa.array(trees[g].homes(x[some])[at]), pa.array(np.take_along_axis(d, top, 1).ravel().astype(np.float64)),
                ], names=["grp", "probe", "id", "leaf", "d"])

    return scan


OUT = "grp string, q string, m string, value double"


def nearest_neighbours(vectors: DataFrame, k: int = 10, unit: bool = False, most: float | None = None, queries: Column | None = None, recall: float = 0.95, leaf: int = 400, sample: int = 20_000, probes: int = 100) -> DataFrame:
    """grp, q, m, value: for every row (or those of ``queries``) its k nearest others of the same group.

    vectors: grp STRING, id STRING (unique per group), vec ARRAY<FLOAT> (one length per group, no nulls). unit: cosine (vectors not zero) instead of the root
    mean square of the differences. most: keep only what is at least (cosine) or at most (difference) this; the
    reach is then calibrated for such neighbours, and every pair counts for both of its rows, whichever found it. Equal values are
    ordered by id. An empty table gives an empty result."""
    spark = vectors.sparkSession
    raw = vectors.select("grp", "id", "vec", (F.coalesce(queries, F.lit(False)) if queries is not None else F.lit(True)).alias("query"))
    coded = raw.mapInArrow(_encode, "grp string, id string, query boolean, dim int, code binary")
    coded = spread(coded, "grp", "id").dropDuplicates(["grp", "id"])
    rows = stage(coded.withColumns({"h": F.xxhash64("code"), "h2": F.xxhash64("code", F.lit(1)), "salt": F.pmod(F.xxhash64("id"), F.lit(1 << 20)).cast("int")}), "vectors")
    key = ["grp", "h", "h2"]
    multi = stage(rows.groupBy(*key).agg(F.min("id").alias("rep"), F.count("*").alias("n"), F.max("query").alias("any")).where("n > 1"), "copies")
    few_classes = multi.count() <= 100_000
    index = rows.join(F.broadcast(multi) if few_classes else multi, key, "left").where("rep IS NULL OR rep = id").withColumn("query", F.coalesce("any", "query"))
    index = index.select("grp", "id", "query", "salt", "dim", "code")
    sizes = {r.grp: r.n for r in index.groupBy("grp").agg(F.count("*").alias("n")).collect()}  # one row a collection
    if not sizes:
        return spark.createDataFrame([], OUT)
    share = F.lit(0.0)
    for g, n in sizes.items():
        share = F.when(F.col("grp") == g, 1.0 if n <= 200 else min(1.0, sample / n)).otherwise(share)
    drawn = index.where(F.pmod(F.xxhash64("id", F.lit(5)), F.lit(1 << 30)) < share * (1 << 30)).toArrow().combine_chunks()
    trees, reach, asked, rng = {}, {}, {}, np.random.default_rng(11)
    for g, at in _by_group(drawn):
        part = drawn.take(at)
        x = _rows(part, unit)
        trees[g] = Tree(x, max(4.0, leaf * min(1.0, len(x) / sizes[g])))
        if most is not None:
            some = x[rng.choice(len(x), min(len(x), 3000), replace=False)]
            moved = _moved(some, unit, most, rng)
            there = np.minimum(trees[g].margins(some, trees[g].homes(moved)), trees[g].margins(moved, trees[g].homes(some)))
            reach[g] = float(np.quantile(there, recall, method="higher")) + 1e-4
        else:
            q = np.flatnonzero(part.column("query").to_numpy(zero_copy_only=False) if isinstance(part.column("query"), pa.Array) else part.column("query").to_numpy())[:probes]
            q = q if len(q) else np.arange(min(probes, len(x)))
            asked[g] = ([part.column("id")[int(i)].as_py() for i in q], x[q])
    if most is None:
        near = index.mapInArrow(_scan(trees, asked, k, unit), "grp string, probe int, id string, leaf int, d double")
        w = Window.partitionBy("grp", "probe").orderBy("d", "id")
        truth = near.withColumn("r", F.row_number().over(w)).where(F.col("r") <= k).select("grp", "probe", "leaf").collect()  # probes * k rows
        for g in trees:
            mine = [(r.probe, r.leaf) for r in truth if r.grp == g]
            there = trees[g].margins(asked[g][1][[p for p, _ in mine]], np.array([v for _, v in mine])) if mine else np.zeros(1)
            reach[g] = float(np.quantile(there, recall, method="higher")) + 1e-4
    light = index.mapInArrow(_assign(trees, reach, unit, None), "grp string, leaf int, role tinyint")
    cuts = {(r.grp, r.leaf): (-(-r.m // BLOCK) or 1, -(-r.q // BLOCK) or 1)
            for r in light.groupBy("grp", "leaf").agg(F.count_if(F.col("role") != 1).alias("m"), F.count_if(F.col("role") != 0).alias("q")).collect()}  # one row a leaf of the tree
    placed = index.mapInArrow(_assign(trees, reach, unit, cuts), "grp string, leaf int, block int, role tinyint, id string, dim int, code binary")
    near = placed.groupBy("grp", "leaf", "block").applyInArrow(_nearest(k, unit, most), OUT)
    if most is not None:
        near = stage(near, "near")
        near = near.unionByName(near.select("grp", F.col("m").alias("q"), F.col("q").alias("m"), "value")).distinct()
    if multi.count():
        near = _with_copies(near, rows.join(multi, key).select("grp", "rep", "id", "query"), rows, k, 1.0 if unit else 0.0)
    best = Window.partitionBy("grp", "q").orderBy(F.desc("value") if unit else F.asc("value"), "m")
    near = near.withColumn("_r", F.row_number().over(best)).where(F.col("_r") <= k).drop("_r")
    return near if queries is None else near.join(rows.where("query").select("grp", F.col("id").alias("q")), ["grp", "q"], "left_semi")


def _with_copies(near: DataFrame, members: DataFrame, rows: DataFrame, k: int, same: float) -> DataFrame:
    """Puts exact copies in again: of each class its k + 1 smallest ids can be neighbours, and every copy asks."""
    few = members.withColumn("r", F.row_number().over(Window.partitionBy("grp", "rep").orderBy("id"))).where(F.col("r") <= k + 1).select("grp", "rep", F.col("id").alias("other"))
    within = members.where("query").join(few, ["grp", "rep"]).where("id <> other").select("grp", F.col("id").alias("q"), F.col("other").alias("m"), F.lit(same).alias("value"))
    as_m = near.join(few.withColumnRenamed("rep", "m"), ["grp", "m"], "left").select("grp", "q", F.coalesce("other", "m").alias("m"), "value")
    as_q = as_m.join(members.where("query").select("grp", F.col("rep").alias("q"), "id"), ["grp", "q"], "left")
    return as_q.select("grp", F.coalesce("id", "q").alias("q"), "m", "value").unionByName(within)


def states(features: DataFrame, bins: int = 20, width: int = 8) -> DataFrame:
    """grp, id, vec of the full signatures; repeated uid once; nulls, short ones and non-finite numbers are left out."""
    fit = (F.size("state") == bins) & F.forall("state", lambda r: F.size(r) == width)
    vec = F.flatten("state")
    rows = features.where(F.col("uid").isNotNull() & F.col("state").isNotNull() & fit).select(F.lit("state").alias("grp"), F.col("uid").alias("id"), vec.alias("vec"))
    return rows.where(F.forall("vec", _finite))


def tokens(frames: DataFrame, encoders: DataFrame) -> DataFrame:
    """grp (encoder), id, vec of the usable vectors: token_dim numbers, not all zero. Repeated token_id once."""
    rows = frames.select("token_id", "encoder_sha256", "vec").where("token_id IS NOT NULL AND vec IS NOT NULL").join(encoders.select(F.col("checkpoint_sha256").alias("encoder_sha256"), "token_dim"), "encoder_sha256")
    rows = rows.where((F.size("vec") == F.col("token_dim")) & F.forall("vec", _finite) & F.exists("vec", lambda v: v != 0))
    return rows.select(F.col("encoder_sha256").alias("grp"), F.col("token_id").cast("string").alias("id"), "vec")


def _finite(v: Column) -> Column:
    return v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))


def found(features: DataFrame, frames: DataFrame, encoders: DataFrame, k: int = 10, rms: float = 0.05, cosine: float = 0.95) -> DataFrame:
    """p7_found: collection, id_a, id_b; uid compare as strings, token ids as numbers."""
    s = nearest_neighbours(states(features), k, most=rms, recall=0.995).select(F.lit("state").alias("collection"), F.least("q", "m").alias("id_a"), F.greatest("q", "m").alias("id_b"))
    t = nearest_neighbours(tokens(frames, encoders), k, unit=True, most=cosine, recall=0.995)
    a, b = F.col("q").cast("bigint"), F.col("m").cast("bigint")
    t = t.select(F.lit("token").alias("collection"), F.least(a, b).cast("string").alias("id_a"), F.greatest(a, b).cast("string").alias("id_b"))
    return s.unionByName(t).distinct()


def listed(features: DataFrame, frames: DataFrame, encoders: DataFrame, k: int = 10, recall: float = 0.96, every: int = 50) -> DataFrame:
    """The ten most similar others of every query row: token ids divisible by ``every``, and the uid whose hash is."""
    s = nearest_neighbours(states(features), k, queries=F.pmod(F.xxhash64("id"), F.lit(every)) == 0, recall=recall).withColumn("collection", F.lit("state"))
    t = nearest_neighbours(tokens(frames, encoders), k, unit=True, queries=F.col("id").cast("bigint") % every == 0, recall=recall).withColumn("collection", F.lit("token"))
    return s.unionByName(t).select("collection", F.col("grp").alias("encoder"), F.col("q").alias("id"), F.col("m").alias("neighbour"), F.round("value", 6).alias("value"))
