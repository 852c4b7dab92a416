"""Deduplicating each new batch against everything accepted before, by ranges of pivot distances.

The metric is edit distance over action ids. Near-same records differ by at most the radius in their distance to any fixed sequence (triangle
inequality). The distance to the empty sequence is the length: History keeps its records in cells of lengths [b, 10 b / 9), so that the partners of a record
lie in its own cell and the two beside it, and a new record is sent to these three only. No row is made for a gram: inside a cell the blocks of its records
(d + 1 disjoint ones of 4 to 8 steps, the rarest, see ``blocks``, one of which any near-same record holds whole and at most d places away) are a sorted
array, and the grams of the new ones are looked up in it with the places in reach. Pairs that pass are held against signatures (which hashed grams a record
holds) and profiles (16 counts, the best bound of all pivots repeating a union of id groups), and what is left is verified with the true metric.

``History`` keeps the tables, cut into buckets as they are written: a batch is shuffled into the buckets of the table, the table
itself is only read where it lies. Blocks are chosen once, when a record is appended, and kept beside it; rows are only appended.
"""

from __future__ import annotations

import hashlib
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tracelake.functions.identity import hex64
from tracelake.llm.blocks import BIAS, SHORT, SIZES, SLOTS, _inside, chosen, keys, sketch
from tracelake.llm.common import gram_hashes
from tracelake.llm.edits import SHARE, longest_partner, near_same
from tracelake.plans.staging import shared_dir, stage, tasks, unstage

GROUPS = 16  # of action ids, for the profile
ROUNDS = 3  # rounds that registered queries take over all batches
GRAM = 5  # steps of a gram of the signature
INDEX_STEPS, ASK_STEPS, PAIRS, SLICE = 4_000_000, 300_000, 1_000_000, 1 << 22  # what a task holds at once: steps of indexed and of asking records, pairs, bytes of what pairs are held against
PLACE_BITS, SLOT_BITS = 24, 22
WIDTHS = tuple(np.dtype(t) for t in ("i1", "<i2", "<i4", "<i8"))
RECORD = "uid string, no bigint, batch_no int, source_trace string, fp binary, same binary, n int, steps binary"


def _bounds() -> np.ndarray:
    out = [SHORT]
    while out[-1] < 1 << 31:
        out.append(int(longest_partner(out[-1])))
    return np.array(out)


CELLS = _bounds()  # first length of each cell; the longest partner of a length is in the next cell at most


def packed(values: np.ndarray) -> bytes:
    """Steps of one record as bytes: their width, then the deflated values in as few bytes each as they need."""
    low, high = (int(values.min()), int(values.max())) if len(values) else (0, 0)
    k = next(i for i, t in enumerate(WIDTHS) if np.iinfo(t).min <= low and high <= np.iinfo(t).max)
    return bytes([k]) + zlib.compress(values.astype(WIDTHS[k]).tobytes(), 6)


def unpacked(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Values and offsets of a column of packed steps (null counts as empty)."""
    raw = [(v[0], zlib.decompress(v[1:])) if v is not None else (0, b"") for v in column.to_pylist()]
    offsets = np.concatenate([[0], np.cumsum([len(v) >> k for k, v in raw])]).astype(np.int64)
    used = {k for k, v in raw if v}
    if len(used) <= 1:
        return np.frombuffer(b"".join(v for _, v in raw), WIDTHS[used.pop() if used else 0]), offsets
    return np.concatenate([np.frombuffer(v, WIDTHS[k]).astype(np.int64) for k, v in raw]), offsets


def _described(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Adds digest and length and packs the steps."""
    for b in batches:
        actions = b.column("actions")
        values = np.asarray(actions.flatten().fill_null(-1)).astype(np.int64)
        n = np.asarray(actions.value_lengths().fill_null(0)).astype(np.int64)
        offsets = np.concatenate([[0], np.cumsum(n)])
        each = [values[i:j] if k else None for i, j, k in zip(offsets[:-1].tolist(), offsets[1:].tolist(), np.asarray(actions.is_valid()).tolist())]
        same = [hashlib.sha256(v.tobytes()).digest() if v is not None else None for v in each]
        steps = [packed(v) if v is not None else None for v in each]
        yield pa.RecordBatch.from_arrays([
            *(b.column(c) for c in ("uid", "no", "batch_no", "source_trace", "fp")), pa.array(same, pa.binary()), pa.array(n.astype(np.int32)), pa.array(steps, pa.binary())], names=[c.split()[0] for c in RECORD.split(", ")])


def records(episodes: DataFrame) -> DataFrame:
    """One row per episode (uid): uid, no (arrival), batch_no, source_trace, fp, same (digest of the actions, null if they
    are null), length, steps (packed, null steps as -1). Rows without uid or arrival number are left out. Steps are packed before the shuffle."""
    rows = episodes.where(F.col("uid").isNotNull() & F.col("staged_no").isNotNull()).select(
        "uid", F.col("staged_no").cast("bigint").alias("no"), F.col("batch_no").cast("int").alias("batch_no"), "source_trace", F.unhex(hex64(F.col("fingerprint"))).alias("fp"), "actions")
    return rows.mapInArrow(_described, RECORD).dropDuplicates(["uid"])


def _profiles(codes: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Steps per group of ids (id modulo GROUPS) of every record; counts stop at 32767, which keeps them valid bounds."""
    n = np.diff(offsets)
    counts = np.bincount(np.repeat(np.arange(len(n)), n) * GROUPS + codes % GROUPS, minlength=len(n) * GROUPS)
    return np.minimum(counts, 32767).astype(np.int16).reshape(-1, GROUPS)


def _signatures(codes: np.ndarray, offsets: np.ndarray, words: int) -> np.ndarray:
    """Which of 64 * words slots the hashed grams of every record fall in, as bits."""
    rec, place = _inside(offsets, GRAM, np.ones(len(offsets) - 1, dtype=bool))
    slot = (gram_hashes(codes, GRAM)[offsets[rec] + place] & np.uint64(64 * words - 1)).astype(np.int64) if len(rec) else rec
    bits = np.zeros((len(offsets) - 1, 64 * words), dtype=bool)
    bits[rec, slot] = True
    return np.packbits(bits, axis=1).view(np.uint64)


def _surplus(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """The larger of the surpluses of either side, summed over the groups."""
    d = x - y
    return (np.abs(d).sum(1, dtype=np.int32) + np.abs(d.sum(1, dtype=np.int32))) // 2


def _chunks(t: pa.Table, steps: int) -> Iterator[pa.Table]:
    """Slices of about so many steps."""
    if t.num_rows:
        cut = np.cumsum(t.column("n").to_numpy()) // steps
        ends = [*(np.flatnonzero(np.diff(cut)) + 1).tolist(), t.num_rows]
        for i, j in zip([0, *ends], ends):
            yield t.slice(i, j - i)


class _Index:
    """The blocks of some records of a cell, sorted by key and place."""

    def __init__(self, t: pa.Table, longest: int):
        self.codes, self.offsets = unpacked(t.column("steps"))
        self.no, self.n = t.column("no").to_numpy(), np.diff(self.offsets)
        self.reach = longest // SHARE  # of any pair of the cell
        places = [np.frombuffer(v, "<i4") for v in t.column("blocks").to_pylist()]
        count = np.array([len(p) for p in places])
        rec, place = np.repeat(np.arange(len(places)), count), np.concatenate(places).astype(np.int64)
        size = np.repeat(t.column("size").to_numpy(), count)
        key = np.zeros(len(rec), dtype=np.uint64)
        self.sizes = np.unique(size).tolist()
        for s in self.sizes:
            use = size == s
            key[use] = keys(self.codes[(self.offsets[rec[use]] + place[use])[:, None] + np.arange(s)].ravel(), s)[::s]
        at = self._at(key, place)
        order = np.argsort(at)
        self.at, self.rec = at[order], rec[order]
        self.held = np.zeros(1 << SLOT_BITS, dtype=bool)
        self.held[at >> np.uint64(64 - SLOT_BITS)] = True
        self.words = 1 << max(2, int(4 * longest - 1).bit_length() - 6)
        self.profile, self.signature = _profiles(self.codes, self.offsets), _signatures(self.codes, self.offsets, self.words)

    @staticmethod
    def _at(key: np.ndarray, place: np.ndarray) -> np.ndarray:
        """Key and place in one number; places beyond what fits count as the last, which keeps differences within reach."""
        low = np.uint64((1 << PLACE_BITS) - 1)
        return (key & ~low) | np.clip(place, 0, int(low)).astype(np.uint64)

    def near(self, t: pa.Table) -> np.ndarray:
        """Arrival numbers of those of the asking records that have an earlier near-same one here."""
        codes, offsets = unpacked(t.column("steps"))
        no, n = t.column("no").to_numpy(), np.diff(offsets)
        profile, signature = _profiles(codes, offsets), _signatures(codes, offsets, self.words)
        near = np.zeros(len(no), dtype=bool)
        for size in self.sizes:
            rec, place = _inside(offsets, size, n >= SHORT)
            if not len(rec):
                continue
            key = keys(codes, size)[offsets[rec] + place]
            use = self.held[key >> np.uint64(64 - SLOT_BITS)]
            rec, place, key = rec[use], place[use], key[use]
            low = np.searchsorted(self.at, self._at(key, place - self.reach))
            met = np.searchsorted(self.at, self._at(key, place + self.reach), "right") - low
            use = met > 0
            rec, low, met = rec[use], low[use], met[use]
            part = np.cumsum(met) // PAIRS
            for i, j in zip(*(lambda e: ([0, *e], [*e, len(rec)]))((np.flatnonzero(np.diff(part)) + 1).tolist())):
                m = met[i:j]
                a = np.repeat(rec[i:j], m)
                b = self.rec[np.arange(m.sum()) - np.repeat(np.cumsum(m) - m, m) + np.repeat(low[i:j], m)]
                use = (self.no[b] < no[a]) & ~near[a] & (np.abs(n[a] - self.n[b]) <= np.maximum(n[a], self.n[b]) // SHARE)
                a, b = a[use], b[use]
                for check, width in ((self._counts, 2 * GROUPS), (self._grams, 8 * self.words)):
                    step = max(1, SLICE // width)
                    use = np.concatenate([np.zeros(0, dtype=bool), *(check(a[k : k + step], b[k : k + step], n, signature, profile) for k in range(0, len(a), step))])
                    a, b = a[use], b[use]
                pair = np.unique(a << 32 | b)
                a, b = pair >> 32, pair & 0xFFFFFFFF
                for x, y in zip(a.tolist(), b.tolist()):
                    near[x] = near[x] or near_same(codes[offsets[x] : offsets[x + 1]], self.codes[self.offsets[y] : self.offsets[y + 1]])
        return no[near]

    def _grams(self, a, b, n, signature, profile):
        """An edit spoils at most GRAM grams of either side, so no more slots than that can be held by one side only."""
        x, y, most = signature[a], self.signature[b], GRAM * (np.maximum(n[a], self.n[b]) // SHARE)
        return (np.bitwise_count(x & ~y).sum(1) <= most) & (np.bitwise_count(y & ~x).sum(1) <= most)

    def _counts(self, a, b, n, signature, profile):
        return _surplus(profile[a], self.profile[b]) <= np.maximum(n[a], self.n[b]) // SHARE


def near_in_cell(own: pa.Table, asked: pa.Table) -> pa.Table:
    """no of the new records that have an earlier near-same one in the cell. own: its records (no, n, size, blocks, steps, fresh); asked: new ones (no, n, steps)
    of the cells beside it. A cell of many records is gone through in slices."""
    found: set[int] = set()
    if own.num_rows:
        new = [own.filter(own.column("fresh")).select(["no", "n", "steps"]), asked.select(["no", "n", "steps"])]
        longest = max(int(t.column("n").to_numpy().max(initial=0)) for t in (own, asked))
        for part in _chunks(own, INDEX_STEPS):
            index = _Index(part, longest)
            for t in new:
                for ask in _chunks(t, ASK_STEPS):
                    ask = ask.filter(pa.array([v not in found for v in ask.column("no").to_pylist()], pa.bool_()))
                    found.update(index.near(ask).tolist())
    return pa.table({"no": pa.array(sorted(found), pa.int64())})


REPEAT = "same_fp OR published OR equal OR near"
F_MARK, S_MARK = b"f", b"s"  # kinds of marks


class History:
    """The state between batches: tables below ``path`` that grow by one part per batch.

    * rows: arrival number, length, steps and chosen blocks of the first record of each sequence, in ``buckets`` buckets by cell;
    * marks: first arrival of each fingerprint (f) and sequence (s), in ``buckets`` buckets by mark.

    ``check`` appends a batch and judges it against all parts of smaller number and itself. Parts are written under the batch's number
    in overwrite mode, so a batch that is run again after a failure replaces its own part only, with the same result."""

    TABLES = {"rows": ("cell int, no bigint, n int, size tinyint, blocks binary, steps binary", "cell"), "marks": ("mark binary, no bigint", "mark")}

    def __init__(self, spark: SparkSession, path: str, buckets: int | None = None):
        self.spark, self.path, self.buckets = spark, path.rstrip("/"), buckets or tasks(spark)
        self.name = "history_" + hashlib.sha256(self.path.encode()).hexdigest()[:16]
        self.counts = np.zeros((len(SIZES), SLOTS), dtype=np.float32)  # decides about work only, so a new session may start anew
        for t, (schema, key) in self.TABLES.items():
            spark.sql(f"CREATE TABLE IF NOT EXISTS {self.name}_{t} ({schema}, part int) USING parquet PARTITIONED BY (part) CLUSTERED BY ({key}) INTO {self.buckets} BUCKETS LOCATION '{self.path}/{t}'")
        self.labels = self._labels()

    def _labels(self) -> np.ndarray:
        """A number per cell, such that cells in sequence lie in buckets in sequence."""
        into: dict[int, list[int]] = {}
        for r in self.spark.range(64 * self.buckets + 64 * len(CELLS)).select(F.col("id"), F.pmod(F.hash(F.col("id").cast("int")), F.lit(self.buckets)).alias("b")).collect():  # of fixed size
            into.setdefault(r.b, []).append(r.id)
        return np.array([into[i % self.buckets][i // self.buckets] for i in range(len(CELLS))], dtype=np.int32)

    def _read(self, table: str, upto: int, inclusive: bool = True) -> DataFrame:
        return self.spark.table(f"{self.name}_{table}").where(F.col("part") <= upto if inclusive else F.col("part") < upto)

    def _write(self, table: str, rows: DataFrame, part: int) -> None:
        schema, key = self.TABLES[table]
        view = f"{self.name}_new"
        rows.repartition(self.buckets, key).createOrReplaceTempView(view)
        self.spark.sql(f"INSERT OVERWRITE {self.name}_{table} PARTITION (part = {part}) SELECT {', '.join(c.split()[0] for c in schema.split(', '))} FROM {view}")
        self.spark.catalog.dropTempView(view)

    def _placed(self, new: DataFrame) -> DataFrame:
        """new (no, steps) with cell, length and chosen blocks. Records shorter than SHORT are near-same to equal ones only and left out."""
        counts, labels = self.counts, self.labels

        def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for whole in batches:
                for i in range(0, whole.num_rows, 2000):
                    b = whole.slice(i, 2000)
                    codes, offsets = unpacked(b.column("steps"))
                    n = np.diff(offsets)
                    rec, at, _, size = chosen(codes, offsets, counts, BIAS)
                    order = np.argsort(rec, kind="stable")
                    at, ends = at[order].astype("<i4"), np.cumsum(np.bincount(rec, minlength=len(n)))
                    sizes = np.zeros(len(n), dtype=np.int8)
                    sizes[rec] = size
                    blocks = [at[i:j].tobytes() for i, j in zip([0, *ends[:-1].tolist()], ends.tolist())]
                    cell = labels[np.maximum(np.searchsorted(CELLS, n, "right") - 1, 0)]
                    out = pa.RecordBatch.from_arrays([pa.array(cell), b.column("no"), pa.array(n.astype(np.int32)), pa.array(sizes), pa.array(blocks, pa.binary()), b.column("steps")], names=["cell", "no", "n", "size", "blocks", "steps"])
                    yield out.filter(pa.array(n >= SHORT))

        return new.mapInArrow(place, self.TABLES["rows"][0])

    def _beside(self, new: DataFrame) -> DataFrame:
        """new (n, ...), once for each cell beside its own."""
        labels = self.labels

        def move(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                own = np.searchsorted(CELLS, np.asarray(b.column("n")), "right") - 1
                for d in (-1, 1):
                    use = pa.array((own + d >= 0) & (own + d < len(CELLS)))
                    cell = pa.array(labels[np.clip(own + d, 0, len(CELLS) - 1)])
                    yield pa.RecordBatch.from_arrays([cell, *(b.column(c) for c in ("no", "n", "steps"))], names=["cell", "no", "n", "steps"]).filter(use)

        return new.select("no", "n", "steps").mapInArrow(move, "cell int, no bigint, n int, steps binary").repartition(self.buckets, "cell")

    def _near(self, part: int) -> DataFrame:
        """no of the records of the part that have an earlier near-same one in the parts up to it."""
        own = self._read("rows", part).select("cell", "no", "n", "size", "blocks", "steps", (F.col("part") == part).alias("fresh"))
        asked = self._beside(self._read("rows", part).where(F.col("part") == part))
        return own.groupBy("cell").cogroup(asked.groupBy("cell")).applyInArrow(near_in_cell, "no bigint")

    def check(self, rows: DataFrame, published: DataFrame, part: int) -> DataFrame:
        """uid, no, batch_no, source_trace, same_fp, published, equal, near of the batch's records (see ``records``).

        published: fp and fp_batch, the first batch that published a fingerprint. A part's number is greater than those of earlier arrivals."""
        each = F.explode(F.array(*[F.when(F.col(c).isNotNull(), F.concat(F.lit(k), F.col(c))) for k, c in ((F_MARK, "fp"), (S_MARK, "same"))])).alias("mark")
        mine = rows.select("no", "batch_no", each).where("mark IS NOT NULL").repartition(self.buckets, "mark")
        by = Window.partitionBy("mark")
        before = mine.join(self._read("marks", part, False).select("mark", F.col("no").alias("h_no")), "mark", "left").withColumns({"own": F.min("no").over(by), "h_no": F.min("h_no").over(by)})
        marks = stage(before.select("mark", "no", "batch_no", F.least("own", "h_no").alias("first"), (F.col("h_no").isNull() & (F.col("no") == F.col("own"))).alias("fresh")), "marks")
        kind = lambda k: F.substring("mark", 1, 1) == F.lit(k)
        self._write("marks", marks.where("fresh").select("mark", "no"), part)
        self.counts = self.counts + sketch(rows, "steps", unpacked)
        new = rows.select("no", "steps").join(marks.where(F.col("fresh") & kind(S_MARK)).select("no"), "no", "left_semi")  # equal ones are repeats already
        self._write("rows", self._placed(new), part)
        shards = published.select(F.concat(F.lit(F_MARK), "fp").alias("mark"), "fp_batch")
        hits = [
            marks.where("first < no").select("no", F.when(kind(F_MARK), "same_fp").otherwise("equal").alias("hit")),
            marks.where(kind(F_MARK)).join(shards, "mark").where("fp_batch < batch_no").select("no", F.lit("published").alias("hit")),
            self._near(part).select("no", F.lit("near").alias("hit"))]
        names = ("same_fp", "published", "equal", "near")
        flags = hits[0].unionByName(hits[1]).unionByName(hits[2]).groupBy("no").agg(*[F.max(F.col("hit") == h).alias(h) for h in names])
        out = rows.select("uid", "no", "batch_no", "source_trace").join(flags, "no", "left")
        out = stage(out.select("uid", "no", "batch_no", "source_trace", *[F.coalesce(h, F.lit(False)).alias(h) for h in names]), "judged")
        unstage(marks)
        return out


def first_published(published: DataFrame) -> DataFrame:
    return published.select(F.unhex(hex64(F.col("fingerprint"))).alias("fp"), F.col("batch_no").alias("b")).where("fp is not null").groupBy("fp").agg(F.min("b").alias("fp_batch"))


def round_bounds(spans: list[tuple[int, int, int]], rounds: int) -> list[int]:
    """Last arrival number of each round. spans: first and last number and size of each batch; batches whose numbers overlap, and smaller
    neighbours while there are more than ``rounds``, share a round."""
    merged: list[list[int]] = []
    for low, high, n in sorted(spans):
        if merged and low <= merged[-1][1]:
            merged[-1][1:] = [max(high, merged[-1][1]), merged[-1][2] + n]
        else:
            merged.append([low, high, n])
    while len(merged) > max(1, rounds):
        i = min(range(len(merged) - 1), key=lambda i: merged[i][2] + merged[i + 1][2])
        merged[i : i + 2] = [[merged[i][0], merged[i + 1][1], merged[i][2] + merged[i + 1][2]]]
    return [m[1] for m in merged]


def judged(episodes: DataFrame, published: DataFrame, rounds: int = ROUNDS, path: str | None = None) -> DataFrame:
    """Every episode with its verdict: uid, no, batch_no, source_trace, same_fp, published, equal, near (booleans).

    The batches go through ``History`` in the order of arrival, in at most ``rounds`` rounds of whole batches; the result is the same for any number. Episodes are
    compared with all earlier arrivals, accepted or not. Null fingerprints and null ``actions`` match nothing; empty ``actions`` equal one another."""
    spark = episodes.sparkSession
    rows = stage(records(episodes), "episodes")
    shards = stage(first_published(published), "published")
    spans = [(r.low, r.high, r.n) for r in rows.groupBy("batch_no").agg(F.min("no").alias("low"), F.max("no").alias("high"), F.count("*").alias("n")).collect()]  # a row per batch
    history = History(spark, path or f"{shared_dir(spark)}/history-{uuid.uuid4().hex[:12]}")
    out, low = None, -(1 << 63)
    for part, high in enumerate(round_bounds(spans, rounds)):
        verdict = history.check(rows.where((F.col("no") > low) & (F.col("no") <= high)), shards, part)
        out, low = verdict if out is None else out.unionByName(verdict), high
    return out if out is not None else history.check(rows, shards, 0)


def found(episodes: DataFrame, published: DataFrame) -> DataFrame:
    """p5_found: uid of every episode that repeats what was there before."""
    return judged(episodes, published).where(REPEAT).select("uid")


def batches(episodes: DataFrame, published: DataFrame) -> DataFrame:
    """Accepted and rejected episodes of each batch, by reason (an episode can have several)."""
    hit = lambda c: F.count_if(F.col(c)).alias(c)
    return judged(episodes, published).groupBy("batch_no").agg(
        F.count("*").alias("episodes"), F.count_if(~F.expr(REPEAT)).alias("accepted"), F.count_if(F.expr(REPEAT)).alias("rejected"), hit("same_fp"), hit("published"), hit("equal"), hit("near"))
