"""The nearest earlier record under the blended distance: packed records, and the search over blocks of them, in the workers."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.parquet as pq
from pyarrow.fs import FileSystem

from tracelake.operators.diversity import js_floor

STATES, CODES, COUNTS = ("<f2", "<f4", "<f8"), ("<u2", "<i4"), ("<u1", "<u2", "<i8")  # widths differ, so that a row's width tells its kind
EPS = float(np.finfo(np.float32).eps)


def packed(values, ends, kinds):
    """Bytes of each run of values, in the first of the kinds that holds all of its numbers as they are. values: flat; ends: the borders of the runs."""
    code, left = [b""] * (len(ends) - 1), np.arange(len(ends) - 1)
    for kind in kinds:
        with np.errstate(over="ignore", invalid="ignore"):
            short = values.astype(kind)
            off = np.r_[0, np.cumsum((short.astype(values.dtype) != values) & (values == values))]
        fits = off[ends[left + 1]] == off[ends[left]] if kind != kinds[-1] else np.ones(len(left), dtype=bool)
        for r in left[fits].tolist():
            code[r] = short[ends[r] : ends[r + 1]].tobytes()
        left = left[~fits]
    return code


def widths(column, sizes):
    """Bytes a value, of each row of a binary column of ``packed``."""
    return np.diff(np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1]) // np.maximum(sizes, 1)


def unpacked(column, sizes, kinds, out):
    """The flat values of a binary column of ``packed``, as the type out; sizes: how many values each row has."""
    ends = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1]
    raw, width = np.frombuffer(column.buffers()[2], np.uint8)[ends[0] : ends[-1]], widths(column, sizes)
    if width.min() == width.max():
        return raw.view(next(k for k in kinds if np.dtype(k).itemsize == width[0])).astype(out)
    of, byte, got = np.repeat(width, sizes), np.repeat(width, np.diff(ends)), np.empty(int(sizes.sum()), dtype=out)
    for k in kinds:
        got[of == np.dtype(k).itemsize] = raw[byte == np.dtype(k).itemsize].view(k)
    return got


class Axes:
    """A few orthonormal directions along which sampled rows differ most, and the length of the rest: the distance in these never exceeds the distance in all dimensions, whatever the sample."""

    def __init__(self, rows, k: int):
        self.mean = rows.mean(0)
        c = rows[:: max(1, len(rows) // 2000)] - self.mean
        v = np.linalg.qr(np.random.default_rng(7).standard_normal((c.shape[1], min(k, c.shape[1]))))[0]
        for _ in range(6 if k < c.shape[1] else 0):
            v = np.linalg.qr(c.T @ (c @ v) + 1e-9 * v)[0]
        self.v = v

    def of(self, rows):
        """Coordinates, rest, and squared length, in double precision."""
        c = rows - self.mean
        y = c @ self.v
        n = (c * c).sum(1)
        return np.c_[y, np.sqrt(np.maximum(n - (y * y).sum(1), 0))], n


class Rows:
    """Records of one stratum as matrices, in order of uid. ``at``: their places in that order."""

    def __init__(self, part: pa.Table, grams: int):
        column = lambda name: part.column(name).combine_chunks()
        n, size, state = part.num_rows, column("size").to_numpy(), column("state")
        self.at, self.uid, self.weapon, self.length = column("at").to_numpy(), column("uid"), column("weapon"), np.log(column("length").to_numpy() + 1)
        self.x = unpacked(state, size, STATES, np.float64 if widths(state, size).max() > 4 else np.float32).reshape(n, -1)
        self.measured = np.isfinite(self.x).all(1) & np.isfinite(self.length)
        kinds = column("kinds").to_numpy()
        where = np.repeat(np.arange(n, dtype=np.int64), kinds) * grams + unpacked(column("grams"), kinds, CODES, np.int64)
        counts = np.bincount(where, unpacked(column("counts"), kinds, COUNTS, np.float64), n * grams).reshape(n, grams)
        self.total = counts.sum(1)
        self.counts = counts.astype(np.float32) if counts.max(initial=0) < 2**24 else counts
        self.root = np.sqrt(counts / self.total[:, None]).astype(np.float32)


def log_term(p, m):
    return np.where(p > 0, p * np.log2(np.where(p > 0, p, 1) / np.where(m > 0, m, 1)), 0).sum(1)


def blend(q: Rows, i, m: Rows, j):
    """The distances of the rows i of q and j of m."""
    out = np.empty(len(i))
    for s in range(0, len(i), 1024):
        u, v = i[s : s + 1024], j[s : s + 1024]
        p, r = q.counts[u] / q.total[u, None], m.counts[v] / m.total[v, None]
        mid = (p + r) / 2
        js = np.sqrt(np.maximum((log_term(p, mid) + log_term(r, mid)) / 2, 0))
        rms = np.sqrt(((q.x[u].astype(np.float64) - m.x[v]) ** 2).mean(1))
        out[s : s + 1024] = 0.45 * rms + 0.35 * js + 0.2 * np.minimum(1, np.abs(q.length[u] - m.length[v]) / math.log(4.0))
    return out


class Nearest:
    """The nearest earlier row of each row of q, while members are shown in order of uid, part by part.

    Every pair meets in a matrix product of few axes, whose bound is lossless; what is left of the pairs (about one in a hundred) meets in the whole state, then in all n-grams, and only
    pairs that are under the best distance by then are worked out. All bounds are lowered by the largest error of their precision."""

    AXES, ASKS, POOL = 64, 256, 1024  # a tile and its bounds stay in a core's cache

    def __init__(self, q: Rows):
        self.q, n, k = q, len(q.at), q.x.shape[1]
        self.ok = q.measured  # other rows have no distance
        self.far = np.abs(q.x[self.ok]).max(initial=0)
        self.best, self.near, self.uid = np.full(n, np.inf), np.full(n, np.iinfo(np.int64).max), np.full(n, None, dtype=object)
        self.state_scale, self.root_scale = 0.45 / math.sqrt(k), 0.35 / math.sqrt(2)
        some = q.x[self.ok].astype(np.float64)
        self.axes = (Axes(some * self.state_scale if len(some) else np.zeros((1, k)), self.AXES), Axes(q.root.astype(np.float64) * self.root_scale, self.AXES))
        self.a, self.b = self.side(q)
        self.off = q.length * (0.2 / math.log(4.0))

    def side(self, rows: Rows):
        x = np.where(np.isfinite(rows.x), rows.x, 0).astype(np.float64) * self.state_scale
        return self.axes[0].of(x), self.axes[1].of(rows.root.astype(np.float64) * self.root_scale)

    def show(self, m: Rows) -> None:
        """Members later than those shown before. A row whose nearest is at distance 0 by now needs no later ones."""
        q = self.q
        fine = np.flatnonzero(m.measured)
        asks = np.flatnonzero(self.ok & (self.best > 0) & (q.at > m.at[0])) if len(m.at) else np.zeros(0, np.int64)
        if not len(fine) or not len(asks):
            return
        kind = np.float32 if max(self.far, np.abs(m.x[fine]).max(initial=0)) < 1e15 else np.float64
        eps = float(np.finfo(kind).eps)
        off = m.length * (0.2 / math.log(4.0))
        asks, fine = asks[np.argsort(self.off[asks], kind="stable")], fine[np.argsort(off[fine], kind="stable")]
        pools, sides = [fine[t : t + self.POOL] for t in range(0, len(fine), self.POOL)], []
        for (y, n), (own, norm) in zip(self.side(m), (self.a, self.b)):
            err = 4 * (y.shape[1] + 8) * eps * (math.sqrt(n[fine].max()) + math.sqrt(norm[asks].max())) ** 2
            right = np.c_[-2 * y, np.ones(len(y)), n - err].astype(kind)
            sides.append((np.c_[own[asks], norm[asks], np.ones(len(asks))].astype(kind), [np.ascontiguousarray(right[pool].T) for pool in pools]))
        (left_a, right_a), (left_b, right_b) = sides
        low, high = off[[p[0] for p in pools]], off[[p[-1] for p in pools]]
        room, under = np.empty((2, self.ASKS * self.POOL), dtype=kind), np.empty(self.ASKS * self.POOL, dtype=bool)
        for s in range(0, len(asks), self.ASKS):
            ask = asks[s : s + self.ASKS]
            own, first, last = self.off[ask], q.at[ask].min(), q.at[ask].max()
            for t in np.argsort(np.abs(low + high - own[0] - own[-1]), kind="stable"):  # those of like length first, for a good distance early
                pool = pools[t]
                apart = np.minimum(np.maximum(0, np.maximum(low[t] - own, own - high[t])), 0.2)
                both, action = (r[: len(ask) * len(pool)].reshape(len(ask), len(pool)) for r in room)
                for d, left, right in ((both, left_a, right_a), (action, left_b, right_b)):
                    np.matmul(left[s : s + self.ASKS], right[t], out=d)
                    np.maximum(d, 0, out=d)
                    np.sqrt(d, out=d)
                both += action
                if m.at[-1] >= first:
                    np.copyto(both, np.inf, where=m.at[pool][None] >= q.at[ask][:, None])
                fresh = np.flatnonzero(np.isinf(self.best[ask]))
                if len(fresh):  # they begin with the pair of the least bound
                    least = both[fresh].argmin(1)
                    has = np.isfinite(both[fresh, least])
                    self.keep(ask[fresh[has]], m, pool[least[has]])
                best = self.best[ask]
                most = np.where(np.isinf(best), -1, best * (1 + 8 * eps) + 8 * eps - apart).astype(kind)
                at = np.flatnonzero(np.less_equal(both, most[:, None], out=under[: both.size].reshape(both.shape)))
                if len(at):
                    i, j = np.divmod(at, len(pool))
                    self.closer(ask[i], m, pool[j], both.ravel()[at], action.ravel()[at])

    def reach(self, i):
        """The best distances of rows, with room for errors of single precision."""
        return self.best[i] * (1 + 1e-6) + 1e-6

    def closer(self, i, m: Rows, j, both, action) -> None:
        """The pairs that few axes left over, with these bounds of state and n-grams, and of n-grams alone."""
        q = self.q
        gap = np.minimum(0.2, np.abs(q.length[i] - m.length[j]) * (0.2 / math.log(4.0)))
        keep = np.flatnonzero(both + gap <= self.reach(i))
        i, j, action, gap = i[keep], j[keep], action[keep], gap[keep]
        state = self.sliced(len(i), lambda s: self.states(q.x[i[s]] - m.x[j[s]])) + gap
        keep = np.flatnonzero(state + action <= self.reach(i))
        i, j, state = i[keep], j[keep], state[keep]
        err = 2 * (q.root.shape[1] + 8) * EPS
        low = state + self.sliced(len(i), lambda s: 0.35 * js_floor(1 - err - np.einsum("ij,ij->i", q.root[i[s]], m.root[j[s]]).astype(np.float64)))
        keep = np.flatnonzero(low <= self.reach(i))
        i, j, low, state = i[keep], j[keep], low[keep], state[keep]
        low = state + self.sliced(len(i), lambda s: self.actions(q.root[i[s]], m.root[j[s]]))
        keep = np.flatnonzero(low <= self.reach(i))
        i, j, low = i[keep], j[keep], low[keep]
        # the least bound of each row first, as it most likely ends the others
        order = np.lexsort((low, i))
        first = order[np.unique(i[order], return_index=True)[1]]
        self.keep(i[first], m, j[first])
        rest = low <= self.reach(i)
        rest[first] = False
        self.keep(i[rest], m, j[rest])

    @staticmethod
    def sliced(n: int, f):
        return np.concatenate([f(slice(s, s + 512)) for s in range(0, n, 512)]) if n else np.zeros(0)

    def states(self, d):
        """Not more than the part of the distance that differences of states make."""
        if d.dtype == np.float32 and not np.abs(d).max(initial=0) < 1e15:
            d = d.astype(np.float64)
        return np.sqrt(np.einsum("ij,ij->i", d, d), dtype=np.float64) * (self.state_scale * (1 - 2 * (d.shape[1] + 8) * EPS))

    @staticmethod
    def actions(a, b):
        """Not more than the part of the distance that n-grams make, from roots of shares: the divergence in bits in single precision, where a sum of k terms, each under 1, is off by few k eps."""
        p, q = a * a, b * b
        m = p + q
        m *= 0.5
        tiny = np.float32(1e-30)
        t = p * np.log2(np.maximum(p, tiny)) + q * np.log2(np.maximum(q, tiny)) - 2 * m * np.log2(np.maximum(m, tiny))
        return 0.35 * np.sqrt(np.maximum(t.sum(1, dtype=np.float64) / 2 - 1e-4, 0))

    def keep(self, i, m: Rows, j) -> None:
        d = blend(self.q, i, m, j)
        order = np.lexsort((m.at[j], d, i))
        order = order[np.unique(i[order], return_index=True)[1]]
        i, j, d = i[order], j[order], d[order]
        new = (d < self.best[i]) | (d == self.best[i]) & (m.at[j] < self.near[i])
        i, j = i[new], j[new]
        self.best[i], self.near[i] = d[new], m.at[j]
        self.uid[i] = np.array(m.uid.take(pa.array(j, pa.int64())).to_pylist(), dtype=object)


class Job:
    """A run of files, or of whole strata, whose records look for their nearest. keys: the strata (size, weapon) of its queries; openers and ends: for the records that open a
    stratum, which meet all weapons, their uids and the last of them of each size."""

    def __init__(self, cost: float, keys: list, low: int, high: int, openers: tuple = (), ends: dict | None = None):
        self.cost, self.keys, self.low, self.high, self.openers, self.ends = cost, keys, low, high, openers, ends

    def split(self, part: pa.Table, asks: bool = False) -> dict:
        """The rows of the job by stratum, or by size where weapons are one: its queries or its members."""
        out = {}
        for key in self.ends or self.keys:
            size, rest = (key, pc.is_in(part["uid"], pa.array(self.openers)) if asks else pc.less(part["uid"], self.ends[key])) if self.ends else (key[0], pc.equal(part["weapon"], key[1]))
            if (got := part.filter(pc.and_(pc.equal(part["size"], size), rest))).num_rows:
                out[key] = got
        return out

    def run(self, paths: list, grams: int, block: int, openers: frozenset):
        """Batches of uid, weapon, nearest, distance. paths: number and place of each file in the order of uids."""

        def read(k: int) -> pa.Table:
            fs, path = FileSystem.from_uri(paths[k][1])
            with fs.open_input_file(path) as f:
                part = pq.read_table(f, use_threads=False)
            part = part.filter(pc.equal(part["file"], paths[k][0]))  # a file can hold two ranges
            return part.append_column("at", pa.array(np.arange(part.num_rows, dtype=np.int64) + (k << 32)))

        wait: dict = {}
        for k in range(self.low, self.high):
            for key, part in self.split(read(k), True).items():
                wait.setdefault(key, []).append(part)
        searches = {key: Nearest(Rows(pa.concat_tables(parts), grams)) for key, parts in wait.items()}
        wait = {}
        for k in range(self.high):
            for key, part in self.split(read(k)).items():
                wait.setdefault(key, []).append(part)
                if sum(p.num_rows for p in wait[key]) >= block / 2:
                    searches[key].show(Rows(pa.concat_tables(wait.pop(key)), grams))
        for key, parts in wait.items():
            searches[key].show(Rows(pa.concat_tables(parts), grams))
        for s in searches.values():
            out = pa.RecordBatch.from_arrays([s.q.uid, s.q.weapon, pa.array(s.uid.tolist(), pa.string()), pa.array(s.best, mask=np.isinf(s.best))], names=["uid", "weapon", "nearest", "distance"])
            yield out if self.ends else out.filter(pa.array([u not in openers for u in s.q.uid.to_pylist()]))


def jobs(strata: dict, block: int) -> list[Job]:
    """strata: for each (size, weapon) its (place of the file, rows, first uid)."""
    out, small, few = [], [], 0
    high = 1 + max(p[0] for parts in strata.values() for p in parts)
    for key, parts in sorted(strata.items()):
        total = sum(p[1] for p in parts)
        if total <= block:
            if small and few + total > block:
                out.append(Job(few, small, 0, high))
                small, few = [], 0
            small, few = [*small, key], few + total
            continue
        run, done, low = 0, 0, 0
        for (at, n, _), more in zip(parts, [*[p[1] for p in parts[1:]], math.inf]):
            run, done = run + n, done + n
            if run + more > 1.25 * block:
                out.append(Job(run * done / block, [key], low, at + 1))
                run, low = 0, at + 1
    if small:
        out.append(Job(few, small, 0, high))
    first = {key: min(parts, key=lambda p: p[2]) for key, parts in strata.items()}
    out.append(Job(block, [], 0, 1 + max(p[0] for p in first.values()), tuple(p[2] for p in first.values()), {s: max(p[2] for (z, _), p in first.items() if z == s) for s, _ in first}))
    return sorted(out, key=lambda j: -j.cost)  # the longest first
