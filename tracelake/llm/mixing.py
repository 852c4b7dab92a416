"""Mixing sources to target weights along a time-varying curriculum.

Each source has a share of the mixture's tokens; where a source can't give its share within ``max_repeats`` passes it gives all
it can, and the others take the rest in proportion. The weight of a source changes linearly over training time t in [0, 1]:
share * (1 + a * (2t - 1)). Integrated, its cumulative demand is D(t) = demand * (t + a * (t*t - t)). The documents of a source
stand in hash order, pass after pass; a copy that starts after x tokens is due at t = D^-1(x), and the mixture is the
range-sort of all copies by t.

Running sums go over hash buckets: totals per bucket first, then sums inside a bucket. No window holds a whole source.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracelake.plans.staging import parallel, stage

TOKENIZERS = "/opt/tokenizers"
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"  # fixed value: the public pattern of this vocabulary
BUCKET_ROWS = 50_000


def source_name(c: Column) -> Column:
    """One spelling per source: lower case, no outer space, ``_`` for dashes and inner space; blank is null."""
    clean = F.regexp_replace(F.lower(F.trim(c)), r"[-\s]+", "_")
    return F.when(clean != "", clean)


def _counter(path: str):
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
        enc = tiktoken.Encoding("mixing", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        for b in batches:
            n = [len(enc.encode_ordinary(t)) if t else 0 for t in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("source"), pa.array(n, pa.int64())], names=["doc_id", "source", "tokens"])

    return count


def token_counts(documents: DataFrame, tokenizers: str = TOKENIZERS, vocabulary: str = "byte_bpe_50k.tiktoken") -> DataFrame:
    """doc_id, source (one spelling), tokens of each document; null or empty text has 0. One row per doc_id."""
    rows = documents.where("doc_id IS NOT NULL").select("doc_id", source_name(F.col("source")).alias("source"), "text")
    counted = parallel(rows).mapInArrow(_counter(f"{tokenizers}/{vocabulary}"), "doc_id bigint, source string, tokens bigint")
    return counted.groupBy("doc_id").agg(F.max_by(F.struct("source", "tokens"), F.struct("tokens", "source")).alias("v")).select("doc_id", "v.source", "v.tokens")


def demands(available: dict[str, int], share: dict[str, float], repeats: dict[str, int], size: float) -> dict[str, float]:
    """Tokens that each source gives: its share of ``size``, at most ``repeats`` passes; what is missing is spread over the rest."""
    most = {s: available.get(s, 0) * max(0, repeats[s]) for s in share}
    give: dict[str, float] = {}
    left, open_ = float(size), {s for s in share if share[s] > 0}
    while open_:
        weight = sum(share[s] for s in open_)
        full = {s for s in open_ if left * share[s] / weight >= most[s]}
        if not full:
            return {s: 0.0 for s in share} | give | {s: left * share[s] / weight for s in open_}
        for s in full:
            give[s] = float(most[s])
            left -= give[s]
        open_ -= full
    return {s: 0.0 for s in share} | give


def ramps(give: dict[str, float], steep: float = 0.5) -> dict[str, float]:
    """Slopes of the weights: the smaller half of the sources rises by ``steep``, the others fall so that the weights always add to 1."""
    order = sorted((s for s in give if give[s] > 0), key=lambda s: (give[s], s))
    rise = order[: len(order) // 2]
    up, down = sum(give[s] for s in rise), sum(give[s] for s in order[len(order) // 2 :])
    if not up or not down:
        return {s: 0.0 for s in give}
    steep = min(steep, down / up)
    return {s: steep if s in rise else -steep * up / down if s in order else 0.0 for s in give}


def plan(counts: DataFrame, targets: DataFrame, size: int | None = None) -> DataFrame:
    """One row per target source: target_share, max_repeats (null: 1; 0 or less: not at all), available, demand, slope. size: tokens of the mixture, else all there are."""
    have = {r.source: r.t for r in counts.join(targets.select(source_name(F.col("source")).alias("source")).distinct(), "source").groupBy("source").agg(F.sum("tokens").alias("t")).collect()}  # a row per target
    goal = targets.where("source IS NOT NULL").select(source_name(F.col("source")).alias("source"), "target_share", "max_repeats").collect()  # fixed table of targets
    share, repeats = {r.source: float(r.target_share or 0) for r in goal}, {r.source: 1 if r.max_repeats is None else int(r.max_repeats) for r in goal}
    total = counts.agg(F.coalesce(F.sum("tokens"), F.lit(0))).collect()[0][0] if size is None else size
    give = demands(have, share, repeats, total)
    slope = ramps(give)
    rows = [(s, share[s], repeats[s], int(have.get(s, 0)), float(give[s]), float(slope[s])) for s in share]
    return counts.sparkSession.createDataFrame(rows, "source string, target_share double, max_repeats int, available bigint, demand double, slope double")


def ordered(counts: DataFrame, planned: DataFrame, seed: int = 42) -> DataFrame:
    """counts of the planned sources with ``before``: tokens of the source in front of the document, in hash order."""
    n = counts.count()
    bits = max(4, int(np.ceil(np.log2(max(1, n / BUCKET_ROWS)))))
    h = F.xxhash64("doc_id", F.lit(seed))
    rows = counts.join(planned.select("source", "available", "demand", "slope"), "source").withColumn("h", h).withColumn("bucket", F.shiftrightunsigned("h", 64 - bits))
    w = Window.partitionBy("source").orderBy("bucket")
    offset = rows.groupBy("source", "bucket").agg(F.sum("tokens").alias("t")).withColumn("base", F.sum("t").over(w) - F.col("t")).drop("t")
    inside = Window.partitionBy("source", "bucket").orderBy(F.expr("h"), "doc_id")
    return rows.join(offset, ["source", "bucket"]).withColumn("before", (F.col("base") + F.sum("tokens").over(inside) - F.col("tokens")).cast("bigint"))


def uses(counts: DataFrame, planned: DataFrame) -> DataFrame:
    """``ordered`` with ``uses``: whole passes of the source, and one more in front of the rest of the demand."""
    passes = F.when(F.col("available") > 0, F.floor(F.col("demand") / F.col("available") + 1e-9)).otherwise(0)
    rest = F.col("demand") - passes * F.col("available")
    return ordered(counts, planned).withColumn("uses", (passes + F.when((F.col("before") < rest - 1e-6 * F.col("demand")) & (F.col("tokens") > 0), 1).otherwise(0)).cast("int"))


def mixture(documents: DataFrame, targets: DataFrame, size: int | None = None, tokenizers: str = TOKENIZERS) -> DataFrame:
    """The mixture in training order: doc_id, copy (from 0), source, tokens, position in [0, 1). Sorted by position.

    Documents without tokens, without a source or of a source without target are in no mixture."""
    counts = stage(token_counts(documents, tokenizers), "tokens")
    used = uses(counts, plan(counts, targets, size)).where("uses > 0 AND tokens > 0")
    y = F.least(F.lit(1.0), (F.col("copy") * F.col("available") + F.col("before")) / F.col("demand"))
    a = F.col("slope")
    t = F.when(F.abs(a) < 1e-9, y).otherwise((a - 1 + F.sqrt((1 - a) * (1 - a) + 4 * a * y)) / (2 * a))
    copies = used.withColumn("copy", F.explode(F.sequence(F.lit(0), F.col("uses") - 1)))
    return copies.select("doc_id", "copy", "source", "tokens", t.alias("position")).orderBy("position", "doc_id", "copy")


def document_uses(documents: DataFrame, targets: DataFrame, size: int | None = None, tokenizers: str = TOKENIZERS) -> DataFrame:
    """How often each document is used: doc_id, source, tokens, uses (0 for those in no mixture)."""
    counts = stage(token_counts(documents, tokenizers), "tokens")
    n = uses(counts, plan(counts, targets, size)).select("doc_id", "uses")
    return counts.join(n, "doc_id", "left").select("doc_id", "source", "tokens", F.when(F.col("tokens") > 0, F.coalesce("uses", F.lit(0))).otherwise(0).alias("uses"))


def shares(documents: DataFrame, targets: DataFrame, size: int | None = None, tokenizers: str = TOKENIZERS) -> DataFrame:
    """Target and reached shares: source, target_share, max_repeats, available, used, share, repeats."""
    counts = stage(token_counts(documents, tokenizers), "tokens")
    planned = plan(counts, targets, size)
    got = uses(counts, planned).groupBy("source").agg(F.sum(F.col("tokens") * F.col("uses")).alias("used"))
    both = planned.join(got, "source", "left").withColumn("used", F.coalesce("used", F.lit(0)))
    return both.withColumn("total", F.sum("used").over(Window.partitionBy())).select(  # one row per source
        "source", "target_share", "max_repeats", "available", "used",
        F.try_divide("used", "total").alias("share"), F.try_divide("used", "available").alias("repeats"))


def within(documents: DataFrame, targets: DataFrame, error: float = 0.02, tokenizers: str = TOKENIZERS) -> DataFrame:
    """Per source what holds for every right mixture: source, max_repeats, repeats_kept (no more passes than allowed), share_kept (the share is reached within
    ``error`` of the mixture, or the source gave all it may, or made up for one that couldn't give more)."""
    t = shares(documents, targets, None, tokenizers).withColumn("full", F.coalesce(F.col("used") >= F.col("available") * F.col("max_repeats") * (1 - error), F.lit(True)))
    some = F.max("full").over(Window.partitionBy())  # one row per source
    kept = (F.abs(F.col("share") - F.col("target_share")) <= error) | F.col("full") | (some & (F.col("share") >= F.col("target_share") - error))
    return t.select("source", "max_repeats", F.coalesce(F.col("repeats") <= F.col("max_repeats") + 1e-9, F.lit(True)).alias("repeats_kept"), F.coalesce(kept, F.lit(False)).alias("share_kept"))
