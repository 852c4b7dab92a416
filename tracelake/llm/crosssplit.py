"""The same or nearly the same records on the evaluation and the training side, by a weighted cosine join.

Records with equal steps are one class per side. Training classes are entered in inverted lists by their rarest blocks (``blocks``): terms are grams
of steps, weighted by their rarity on the evaluation side; near-same classes have a least dot product with a block vector, and what the
weights left out can't make up for stays out of the lists, by the maximum weights of the terms. Evaluation classes, the small side, ask with all
their grams. The list join is an equi-join on the term; lengths, place and four counts of steps (pivots), which differ by at most the radius in
near-same records, are further conditions inside it. Candidates get the exact dot product over the whole gram vectors, and those
that reach the bound are verified by edit distance. Lossless at every length: records under 9 steps are near-same to equal ones only.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracelake.llm.blocks import BIAS, POSTING, SHORT, indexed, present_slots, probes, sketch
from tracelake.llm.common import flat, segment_codes
from tracelake.llm.edits import SHARE, distance, profiles_apart, radius, within_reach
from tracelake.plans.staging import spread, stage

GRAM = 5  # steps of a term of the dot products


def _verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        (x, xo), (y, yo) = flat(b.column("codes_e")), flat(b.column("codes_t"))
        keep, dots, dists = [], [], []
        for i in range(b.num_rows):
            s, t = x[xo[i] : xo[i + 1]], y[yo[i] : yo[i + 1]]
            longer = max(len(s), len(t))
            most = radius(longer)
            if profiles_apart(s, t) > most:
                continue
            a, c = (Counter(zip(*[v[j : len(v) - GRAM + 1 + j].tolist() for j in range(GRAM)])) for v in (s, t))
            shared = (a & c).total()
            if shared < longer - GRAM + 1 - GRAM * most:
                continue
            if (d := distance(s.tolist(), t.tolist(), most)) <= most:
                keep.append(i)
                dots.append(shared / float(np.sqrt((len(s) - GRAM + 1) * (len(t) - GRAM + 1))))
                dists.append(d)
        idx = pa.array(keep, pa.int64())
        yield pa.RecordBatch.from_arrays([*(b.column(c).take(idx) for c in ("e", "e2", "t", "t2")), pa.array(dots, pa.float64()), pa.array(dists, pa.int32())], names=["e", "e2", "t", "t2", "cosine", "edits"])


PAIR = "e bigint, e2 bigint, t bigint, t2 bigint, cosine double, edits int"


def class_pairs(classes: DataFrame) -> DataFrame:
    """Near-same pairs (e, e2, t, t2, cosine, edits) of an evaluation and a training class.

    classes: id and id2 BIGINT (two hashes), side STRING, codes ARRAY<SMALLINT>, n INT; distinct codes per side."""
    asking, listed = (classes.where((F.col("side") == s) & (F.col("n") >= SHORT)).select("id", "codes") for s in ("eval", "train"))
    counts = sketch(asking, "codes")
    listed = stage(spread(listed, "id").mapInArrow(indexed("id", "codes", counts, BIAS), POSTING), "postings")
    a, b = spread(asking, "id").mapInArrow(probes("id", "codes", present_slots(listed)), POSTING).alias("a"), listed.alias("b")
    (na, pa_), (nb, pb) = ((F.shiftright(f"{s}.at", 32), F.col(f"{s}.at").bitwiseAND(0xFFFFFFFF)) for s in "ab")
    reach = F.floor(F.greatest(na, nb) / SHARE)
    on = (F.col("a.key") == F.col("b.key")) & (F.abs(na - nb) <= reach) & (F.abs(pa_ - pb) <= reach) & within_reach("a.pivots", "b.pivots", reach)
    pairs = stage(a.join(b, on).select(F.col("a.id").alias("e"), F.col("b.id").alias("t")).distinct(), "pairs")
    of = lambda s, i: classes.where(F.col("side") == s).select(F.col("id").alias(i), F.col("id2").alias(f"{i}2"), F.col("codes").alias(f"codes_{i}"))
    both = pairs.join(of("eval", "e"), "e").join(of("train", "t"), "t")
    near = spread(both, "e", "t").mapInArrow(_verify, PAIR)
    short = classes.where(F.col("n") < SHORT)
    side = lambda s, i: short.where(F.col("side") == s).select("codes", F.col("id").alias(i), F.col("id2").alias(f"{i}2"))
    equal = side("eval", "e").join(side("train", "t"), "codes")
    return near.unionByName(equal.select("e", "e2", "t", "t2", F.lit(1.0).alias("cosine"), F.lit(0).alias("edits")))


def overlaps(segments: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Pairs of classes (e, e2, t, t2, cosine, edits) and the members (uid, trace, split, side, id, id2) of the classes.

    Null ``actions`` or uid: no row. Empty ``actions`` equal one another. Segments whose split is on neither side are left out."""
    keyed = segment_codes(segments).where(F.col("side").isNotNull()).withColumns({"id": F.xxhash64("side", "codes", F.lit(1)), "id2": F.xxhash64("codes", F.lit(2))})
    records = stage(keyed, "records")
    classes = stage(records.groupBy("side", "id", "id2").agg(F.min_by("codes", "uid").alias("codes")).withColumn("n", F.size("codes")), "classes")
    return class_pairs(classes), records.select("uid", "trace", "split", "side", "id", "id2")


def found(segments: DataFrame) -> DataFrame:
    """p2_found: every pair of uid, the smaller string first."""
    pairs, members = overlaps(segments)
    a = members.where("side = 'eval'").select(F.col("id").alias("e"), F.col("id2").alias("e2"), F.col("uid").alias("u"))
    b = members.where("side = 'train'").select(F.col("id").alias("t"), F.col("id2").alias("t2"), F.col("uid").alias("v"))
    return pairs.select("e", "e2", "t", "t2").join(a, ["e", "e2"]).join(b, ["t", "t2"]).select(F.least("u", "v").alias("uid_a"), F.greatest("u", "v").alias("uid_b"))


def by_source(segments: DataFrame) -> DataFrame:
    """Counts per evaluation split and trace: records with a match, classes, matching pairs, of these with equal steps.

    Copies are counted by class sizes, not expanded into pairs."""
    pairs, members = overlaps(segments)
    size = members.where("side = 'train'").groupBy(F.col("id").alias("t"), F.col("id2").alias("t2")).agg(F.count("*").alias("copies"))
    matched = pairs.join(size, ["t", "t2"]).groupBy(F.col("e").alias("id"), F.col("e2").alias("id2")).agg(F.sum("copies").alias("partners"), F.sum(F.when(F.col("edits") == 0, F.col("copies")).otherwise(0)).alias("equal"))
    return members.where("side = 'eval'").join(matched, ["id", "id2"], "left").groupBy("split", "trace").agg(
        F.count("*").alias("records"), F.count("partners").alias("leaking"), F.coalesce(F.sum("partners"), F.lit(0)).alias("pairs"), F.coalesce(F.sum("equal"), F.lit(0)).alias("equal_pairs"))
