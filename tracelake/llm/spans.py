"""Long exact spans shared between records of different traces, by repeated-phrase automata.

1. *Cut.* Each record is cut into pieces: maximal rows of consecutive windows of ``span`` steps whose smallest k-gram
   hash (the anchor) is the same. A window's anchor depends on the window alone, so equal windows meet under one key,
   and a piece carries all its windows in one string (about span + span/2 characters).
2. *Confirm.* Anchors seen in one trace only can't hold a shared window; min/max of the trace per anchor (combined
   before the shuffle, whatever the group's size) drops them. The windows of the distinct remaining pieces are the
   candidate phrases; again min and max of the trace, and a phrase is confirmed where they differ.
3. *Locate.* Confirmed phrases are compiled into Aho-Corasick automata, sharded by anchor, and all candidate pieces
   stream through the automaton of their shard. Hot shards are split: their pieces by a salt, their phrases over
   several automata. No shard's size depends on the largest group.
4. *Join.* Located windows are merged into the longest unbroken stretches per record.
"""

from __future__ import annotations

from collections.abc import Iterator

import ahocorasick
import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tracelake.llm.common import as_text, flat, gram_hashes, segment_codes, starts_inside
from tracelake.plans.staging import stage, tasks

PIECE = "key bigint, uid string, trace string, start int, text string"


def _sliding_min(x: np.ndarray, w: int) -> np.ndarray:
    """Minimum of each w consecutive values, by doubling."""
    out, width = x, 1
    while width * 2 <= w:
        out = np.minimum(out[:-width], out[width:])
        width *= 2
    rest = w - width
    return np.minimum(out[: len(out) - rest], out[rest:]) if rest else out


def _cut(span: int, k: int):
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            codes, offsets = flat(b.column("codes"))
            if not len(codes) or np.diff(offsets).max() < span:
                continue
            rec, at = starts_inside(offsets, span)
            anchor = _sliding_min(gram_hashes(codes, k), span - k + 1)[at].view(np.int64)
            first = np.flatnonzero(np.r_[True, (rec[1:] != rec[:-1]) | (anchor[1:] != anchor[:-1])])
            last = np.r_[first[1:], len(at)] - 1
            text, rows = as_text(codes), rec[first]
            yield pa.RecordBatch.from_arrays([
                pa.array(anchor[first]), b.column("uid").take(pa.array(rows)), b.column("trace").take(pa.array(rows)),
                pa.array((at[first] - offsets[rows]).astype(np.int32)), pa.array([text[i : j + span] for i, j in zip(at[first], at[last])], pa.string()),
            ], names=["key", "uid", "trace", "start", "text"])

    return cut


def _locate(span: int):
    def locate(pieces: pd.DataFrame, phrases: pd.DataFrame) -> pd.DataFrame:
        out: list[tuple[str, int, int]] = []
        if len(pieces) and len(phrases):
            automaton = ahocorasick.Automaton(ahocorasick.STORE_LENGTH)
            for w in phrases["w"]:
                automaton.add_word(w)
            automaton.make_automaton()
            for uid, start, text in zip(pieces["uid"], pieces["start"], pieces["text"]):
                lo = hi = -1
                for end, _ in automaton.iter(text):
                    if hi >= 0 and end - span <= hi:
                        hi = end
                    else:
                        if hi >= 0:
                            out.append((uid, start + lo, start + hi))
                        lo, hi = end - span + 1, end
                if hi >= 0:
                    out.append((uid, start + lo, start + hi))
        return pd.DataFrame(out, columns=["uid", "lo", "hi"]).astype({"lo": "int32", "hi": "int32"})

    return locate


def merged(intervals: DataFrame, key: str = "uid") -> DataFrame:
    """Union of closed integer intervals [lo, hi] per key: longest stretches, touching ones joined."""
    w = Window.partitionBy(key).orderBy("lo", "hi")
    before = F.max("hi").over(w.rowsBetween(Window.unboundedPreceding, -1))
    marked = intervals.withColumn("_new", F.when(F.col("lo") <= before + 1, 0).otherwise(1))
    return marked.withColumn("_no", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0))).groupBy(key, "_no").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi")).drop("_no")


def located(records: DataFrame, span: int = 64, k: int = 24, phrases_per_shard: int = 10_000, pieces_per_task: int = 50_000) -> DataFrame:
    """Intervals (uid, lo, hi) covered by windows of ``span`` steps that occur under at least two traces.

    records: uid, trace, codes. Records shorter than ``span`` share nothing."""
    pieces = stage(records.select("uid", "trace", "codes").mapInArrow(_cut(span, k), PIECE), "pieces")
    lo_hi = lambda c, d: (F.min(c).alias("a"), F.max(d).alias("b"))
    keys = pieces.groupBy("key").agg(*lo_hi("trace", "trace")).where("a <> b").select("key")
    cand = stage(pieces.join(keys, "key", "left_semi"), "candidates")
    windows = cand.groupBy("key", "text").agg(*lo_hi("trace", "trace")).select(
        "key", "a", "b", F.explode(F.transform(F.sequence(F.lit(1), F.length("text") - span + 1), lambda i: F.substring(F.col("text"), i, F.lit(span)))).alias("w")
    )
    phrases = stage(windows.groupBy("key", "w").agg(*lo_hi("a", "b")).where("a <> b").select("key", "w"), "phrases")
    n = phrases.count()
    shards = max(tasks(records.sparkSession), -(-n // phrases_per_shard))
    cand = cand.withColumn("shard", F.pmod(F.xxhash64("key"), F.lit(shards)))
    phrases = phrases.withColumn("shard", F.pmod(F.xxhash64("key"), F.lit(shards)))
    parts = phrases.groupBy("shard").agg(F.ceil(F.count("*") / (2 * phrases_per_shard)).cast("int").alias("autos")).join(
        cand.groupBy("shard").agg(F.ceil(F.count("*") / pieces_per_task).cast("int").alias("salts")), "shard")
    some = cand.join(parts, "shard").select("shard", F.pmod(F.xxhash64("uid", "start"), "salts").cast("int").alias("salt"), F.explode(F.sequence(F.lit(0), F.col("autos") - 1)).alias("auto"), "uid", "start", "text")
    words = phrases.join(parts, "shard").select("shard", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"), F.pmod(F.xxhash64("w"), "autos").cast("int").alias("auto"), "w")
    by = ["shard", "salt", "auto"]
    return some.groupBy(*by).cogroup(words.groupBy(*by)).applyInPandas(_locate(span), "uid string, lo int, hi int")


def shared_spans(segments: DataFrame, span: int = 64) -> DataFrame:
    """p1_found: uid, span_start, span_steps. Null or short ``actions`` and unknown uid give no rows; a null
    ``src_trace`` counts as the trace ''."""
    return merged(located(segment_codes(segments), span)).select("uid", F.col("lo").alias("span_start"), (F.col("hi") - F.col("lo") + 1).alias("span_steps"))


def shared_per_segment(segments: DataFrame, span: int = 64) -> DataFrame:
    """Of every segment: its steps, how many of them recur under another trace, in how many stretches."""
    records = stage(segment_codes(segments).select("uid", "trace", "codes"), "segments")
    spans = merged(located(records, span)).groupBy("uid").agg(F.sum(F.col("hi") - F.col("lo") + 1).alias("shared_steps"), F.count("*").alias("stretches"))
    return records.select("uid", "trace", F.size("codes").alias("steps")).join(spans, "uid", "left").select(
        "uid", "trace", "steps", F.coalesce("shared_steps", F.lit(0)).cast("bigint").alias("shared_steps"), F.coalesce("stretches", F.lit(0)).cast("bigint").alias("stretches"))
