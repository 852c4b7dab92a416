"""Shared pieces of the training-data operators: records, step codes, numpy helpers."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracelake.functions.identity import effective_split, side, trace_name
from tracelake.plans.staging import spread

BUTTONS = 9
NO_STEP = -1  # code of a step that is null


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def packed_steps(actions: pa.Array) -> pa.Array:
    """One int16 per step: bit i is set if button i is pressed (not 0). A null step gives NO_STEP, missing or null
    buttons count as not pressed, null ``actions`` are empty."""
    steps = actions.flatten()  # of all rows
    lengths = np.asarray(steps.value_lengths().fill_null(0), dtype=np.int64)
    pressed = np.asarray(steps.flatten().fill_null(0)) != 0
    if len(lengths) and (lengths == BUTTONS).all():
        codes = pressed.reshape(-1, BUTTONS) @ (1 << np.arange(BUTTONS, dtype=np.int16))
    else:
        step = np.repeat(np.arange(len(lengths)), lengths)
        button = np.arange(len(pressed)) - (np.cumsum(lengths) - lengths)[step]
        use = pressed & (button < BUTTONS)
        codes = np.bincount(step[use], (1 << button[use]).astype(float), len(lengths))
    codes = np.where(np.asarray(steps.is_null()), NO_STEP, codes).astype(np.int16)
    ends = np.concatenate([[0], np.cumsum(np.asarray(actions.value_lengths().fill_null(0)))]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(codes))


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        names = ["codes" if n == "actions" else n for n in b.schema.names]
        yield pa.RecordBatch.from_arrays([packed_steps(c) if n == "codes" else c for n, c in zip(names, b.columns)], names=names)


def segment_codes(segments: DataFrame) -> DataFrame:
    """One row per segment (uid): uid, trace, codes, skip, side, split. Rows without uid or actions are left out.

    Codes are made before the shuffle, so what moves is two bytes a step and not nested arrays; the one exchange, by uid, also
    serves what follows (windows and aggregations by uid, work per record). A null ``src_trace``
    counts as the trace named ``''``."""
    trace = F.coalesce(trace_name(F.col("src_trace")), F.lit(""))
    split = effective_split(F.col("split"), trace)
    rows = segments.where(F.col("uid").isNotNull() & F.col("actions").isNotNull()).select("uid", trace.alias("trace"), "actions", F.col("skip").cast("int").alias("skip"), split.alias("split"), side(split).alias("side"))
    rows = rows.mapInArrow(_packed, "uid string, trace string, codes array<smallint>, skip int, split string, side string")
    return spread(rows, "uid").dropDuplicates(["uid"])


def flat(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Values and offsets of a list column of one batch (nulls in it count as empty lists)."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    lengths = np.asarray(column.value_lengths().fill_null(0), dtype=np.int64)
    offsets = np.concatenate([[0], np.cumsum(lengths)])
    values = column.flatten().to_numpy(zero_copy_only=False)
    return values, offsets


def mix64(x: np.ndarray) -> np.ndarray:
    """Finalizer of splitmix64 over uint64."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def gram_hashes(codes: np.ndarray, q: int) -> np.ndarray:
    """Hash of the q codes from each position on; the last q - 1 positions are dropped. Windows may cross records;
    callers keep only those inside one."""
    n = len(codes) - q + 1
    if n <= 0:
        return np.zeros(0, dtype=np.uint64)
    c = codes.astype(np.int64).astype(np.uint64) + np.uint64(2)
    h = np.zeros(n, dtype=np.uint64)
    for j in range(q):
        h = h * np.uint64(0x9E3779B97F4A7C15) + c[j : j + n]
    return mix64(h)


def as_text(codes: np.ndarray) -> str:
    """Codes as characters, for string algorithms."""
    return (codes.astype(np.int64) + 0x100).astype("<u4").tobytes().decode("utf-32-le")


def starts_inside(offsets: np.ndarray, q: int) -> tuple[np.ndarray, np.ndarray]:
    """Record number and flat start of every window of q values that lies inside one record."""
    counts = np.maximum(np.diff(offsets) - q + 1, 0)
    rec = np.repeat(np.arange(len(counts)), counts)
    first = np.cumsum(counts) - counts
    return rec, np.arange(counts.sum()) - first[rec] + offsets[:-1][rec]
