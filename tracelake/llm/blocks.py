"""Blocks of step sequences: lists of rare terms for near-same joins, without loss.

Terms are grams of 4 to 8 steps. d edits spoil at most d of disjoint blocks, so of any d + 1 disjoint blocks of one record a near-same
record holds one whole, at most d places away; d is the radius of the longest partner. One side (the index) enters d + 1 blocks of each
record, the other (the probes) asks with all its grams. In the words of a weighted cosine join: the indexed vector has a weight for each of a record's
disjoint blocks, the more the rarer; near-same records have a dot product of at least the sum of the weights less the d largest; so the
most common blocks stay out of the lists as long as the weights left out (each term has one weight, so this is the bound by maximum weights, and the squared residual norm) stay below that.

How often a gram occurs on the asking side is known from a sketch of fixed size (hashed counts, merged from all records). Each record takes the
size of gram for which its d + 1 rarest blocks meet the fewest probes: so a passage that many records share is left out wherever the rest of the record can
tell it apart, and its list is never built. The sketch decides about work only, never about the result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracelake.llm.common import flat, gram_hashes, mix64
from tracelake.llm.edits import longest_partner, pivot_counts, radius

SIZES = (4, 6, 8)
SHORT = 9  # shorter records are near-same to equal ones only
SLOTS = 1 << 17  # of the sketch, per size; a power of two
CHUNK = 1 << 14
BIAS = 8.0  # shorter blocks than a record could have are worth their probes only where they meet so many times fewer
POSTING = "key bigint, id bigint, at bigint, pivots bigint, size tinyint"  # at: length of the record << 32 | place of the gram


def keys(codes: np.ndarray, size: int) -> np.ndarray:
    """Key of the gram of ``size`` steps from each place on."""
    return mix64(gram_hashes(codes, size) + np.uint64(size))


def _inside(offsets: np.ndarray, size: int, use: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Record and place in it of all grams of the records in use."""
    n = np.where(use, np.maximum(np.diff(offsets) - size + 1, 0), 0)
    rec = np.repeat(np.arange(len(n)), n)
    return rec, np.arange(n.sum()) - (np.cumsum(n) - n)[rec]


def sketch(rows: DataFrame, column: str, read=flat) -> np.ndarray:
    """How many grams of the rows fall in each slot, per size. read: gives values and offsets of the column of a batch. Tasks hold and send arrays of fixed size, merged in two steps."""
    width = len(SIZES) * SLOTS

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(width, dtype=np.int64)
        for b in batches:
            codes, offsets = read(b.column(column))
            for i, size in enumerate(SIZES):
                rec, place = _inside(offsets, size, np.diff(offsets) >= SHORT)
                if len(rec):
                    total[i * SLOTS : (i + 1) * SLOTS] += np.bincount((keys(codes, size)[offsets[rec] + place] % np.uint64(SLOTS)).astype(np.int64), minlength=SLOTS)
        some = [i for i in range(width // CHUNK) if total[i * CHUNK : (i + 1) * CHUNK].any()]
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), pa.array([total[i * CHUNK : (i + 1) * CHUNK].tobytes() for i in some], pa.binary())], names=["chunk", "counts"])

    def merge(t: pa.Table) -> pa.Table:
        total = sum(np.frombuffer(v, dtype=np.int64) for v in t.column("counts").to_pylist())
        return pa.table({"chunk": t.column("chunk")[:1], "counts": [total.tobytes()]})

    schema = "chunk int, counts binary"
    per = rows.select(column).mapInArrow(count, schema).withColumn("part", F.pmod(F.spark_partition_id(), F.lit(64)))
    out = np.zeros(width, dtype=np.int64)
    once = per.groupBy("chunk", "part").applyInArrow(lambda t: merge(t.select(["chunk", "counts"])), schema)
    for r in once.groupBy("chunk").applyInArrow(merge, schema).collect():  # of fixed size
        out[r.chunk * CHUNK : (r.chunk + 1) * CHUNK] = np.frombuffer(r.counts, dtype=np.int64)
    return out.reshape(len(SIZES), SLOTS).astype(np.float32)


def chosen(codes: np.ndarray, offsets: np.ndarray, counts: np.ndarray, bias: float = 1.0) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Record, place, key and size of the blocks that each record enters. Blocks shorter than they could be must meet ``bias`` times fewer probes."""
    n = np.diff(offsets)
    need = radius(longest_partner(n)) + 1
    cost, found = np.full((len(SIZES), len(n)), np.inf), []
    for i, size in enumerate(SIZES):
        blocks = np.where((n >= SHORT) & (n // size >= need), n // size, 0)
        rec = np.repeat(np.arange(len(n)), blocks)
        if not len(rec):
            found.append((rec, rec, np.zeros(0, np.uint64)))
            continue
        place = (np.arange(len(rec)) - (np.cumsum(blocks) - blocks)[rec]) * size
        key = keys(codes, size)[offsets[rec] + place]
        met = counts[i, (key % np.uint64(SLOTS)).astype(np.int64)]
        order = np.argsort(rec << 40 | np.minimum(met, (1 << 24) - 1).astype(np.int64) << 16 | (key & np.uint64(0xFFFF)).astype(np.int64))  # rarest first
        rank = np.arange(len(rec)) - (np.cumsum(blocks) - blocks)[rec]
        order = order[rank < need[rec]]
        rec, place, key, met = rec[order], place[order], key[order], met[order]
        has = blocks > 0
        cost[i, has] = np.bincount(rec, met + 1.0, len(n))[has]
        found.append((rec, place, key))
    last = len(SIZES) - 1
    longest = last - np.isfinite(cost)[::-1].argmax(0)
    cost[np.arange(len(SIZES))[:, None] < longest[None]] *= bias
    best = last - cost[::-1].argmin(0)  # of equal costs the longest
    use = [best[rec] == i for i, (rec, _, _) in enumerate(found)]
    out = [np.concatenate([f[j][u] for f, u in zip(found, use)]) for j in range(3)]
    return *out, np.repeat(SIZES, [u.sum() for u in use])


def indexed(id_name: str, column: str, counts: np.ndarray, bias: float = 1.0):
    """Postings of the chosen blocks of rows (id, sequence)."""

    def post(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            codes, offsets = flat(b.column(column))
            yield _rows(b.column(id_name), codes, offsets, *chosen(codes, offsets, counts, bias))

    return post


def probes(id_name: str, column: str, present: np.ndarray | None = None):
    """All grams of rows (id, sequence) that could be a block of a near-same record. present: slots (per size) that hold blocks; grams of other slots aren't asked for."""

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for i in range(0, whole.num_rows, 2000):
                b = whole.slice(i, 2000)
                codes, offsets = flat(b.column(column))
                for j, size in enumerate(SIZES):
                    if present is not None and not present[j].any():
                        continue
                    rec, place = _inside(offsets, size, np.diff(offsets) >= SHORT)
                    key = keys(codes, size)[offsets[rec] + place] if len(rec) else np.zeros(0, np.uint64)
                    if present is not None:
                        use = present[j][(key % np.uint64(SLOTS)).astype(np.int64)]
                        rec, place, key = rec[use], place[use], key[use]
                    if len(rec):
                        yield _rows(b.column(id_name), codes, offsets, rec, place, key, np.full(len(rec), size))

    return ask


def present_slots(postings: DataFrame) -> np.ndarray:
    """Which slots hold blocks, per size. At most SLOTS rows a size come to the driver."""
    out = np.zeros((len(SIZES), SLOTS), dtype=bool)
    for r in postings.select("size", F.col("key").bitwiseAND(SLOTS - 1).alias("slot")).distinct().collect():
        out[SIZES.index(r["size"]), r.slot] = True
    return out


def _rows(ids: pa.Array, codes: np.ndarray, offsets: np.ndarray, rec: np.ndarray, place: np.ndarray, key: np.ndarray, size: np.ndarray) -> pa.RecordBatch:
    n, counts = np.diff(offsets), pivot_counts(codes, offsets)
    return pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(np.asarray(ids)[rec]), pa.array(n[rec] << 32 | place), pa.array(counts[rec]), pa.array(size.astype(np.int8))], names=["key", "id", "at", "pivots", "size"])
