"""Distances between recordings: n-gram distributions, aligned states, durations; audits against references."""

from __future__ import annotations

import math
from bisect import bisect_right

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracelake.plans.staging import stage


def summed(m: Column) -> Column:
    """A count map whose repeated keys (files can hold them) are one key with the sum of their counts."""
    keys = F.map_keys(m)
    once = F.array_distinct(keys)
    total = lambda k: F.aggregate(F.filter(F.map_entries(m), lambda e: e["key"] == k), F.lit(0).cast("bigint"), lambda t, e: t + e["value"])
    return F.when(F.size(once) == F.size(keys), m).otherwise(F.map_from_arrays(once, F.transform(once, total)))


def js_distance(a: Column, b: Column) -> Column:
    """Root of the Jensen-Shannon divergence (base 2) of two count maps; null if either is null or empty. One pass over the union of keys."""
    total = lambda m: F.aggregate(F.map_values(m), F.lit(0.0), lambda t, v: t + v)
    keys = F.array_union(F.map_keys(a), F.map_keys(b))
    na, nb = total(a), total(b)

    def term(k: Column) -> Column:
        p, q = F.coalesce(F.try_element_at(a, k), F.lit(0)) / na, F.coalesce(F.try_element_at(b, k), F.lit(0)) / nb
        m = (p + q) / 2
        return F.when(p > 0, p * F.log2(p / m)).otherwise(0.0) + F.when(q > 0, q * F.log2(q / m)).otherwise(0.0)

    divergence = F.aggregate(keys, F.lit(0.0), lambda t, k: t + term(k)) / 2
    return F.when((na > 0) & (nb > 0), F.sqrt(F.greatest(divergence, F.lit(0.0))))


def js_pairs(grams: DataFrame, uid: str, gram: str, n: str, pairs: DataFrame) -> DataFrame:
    """The same in long form for listed pairs (a, b): only n-grams that both sides hold are joined, as the rest of the
    divergence follows from the shares that are left over."""
    total = grams.groupBy(uid).agg(F.sum(n).alias("_t"))
    p = grams.join(total, uid).select(F.col(uid).alias("_u"), F.col(gram).alias("_g"), (F.col(n) / F.col("_t")).alias("_p"))
    left = pairs.join(p.select(F.col("_u").alias("a"), "_g", "_p"), "a")
    both = left.join(p.select(F.col("_u").alias("b"), "_g", F.col("_p").alias("_q")), ["b", "_g"])
    m = (F.col("_p") + F.col("_q")) / 2
    term = F.col("_p") * F.log2(F.col("_p") / m) + F.col("_q") * F.log2(F.col("_q") / m)
    s = both.groupBy("a", "b").agg(F.sum(term).alias("_s"), F.sum("_p").alias("_cp"), F.sum("_q").alias("_cq"))
    out = pairs.join(s, ["a", "b"], "left")
    d = (F.coalesce("_s", F.lit(0.0)) + (1 - F.coalesce("_cp", F.lit(0.0))) + (1 - F.coalesce("_cq", F.lit(0.0)))) / 2
    return out.select("a", "b", F.sqrt(F.greatest(d, F.lit(0.0))).alias("js"))


def state_rms(a: Column, b: Column) -> Column:
    """Root mean square of the differences of two equally shaped arrays of arrays; null if shapes differ."""
    x, y = F.flatten(a), F.flatten(b)
    sq = F.aggregate(F.zip_with(x, y, lambda p, q: (p - q) * (p - q)), F.lit(0.0), lambda t, v: t + v)
    return F.when((F.size(x) == F.size(y)) & (F.size(x) > 0), F.sqrt(sq / F.size(x)))


def duration_gap(a: Column, b: Column) -> Column:
    return F.least(F.lit(1.0), F.abs(F.log((a + 1) / (b + 1))) / math.log(4.0))


def diversity_distance(state: Column, action: Column, duration: Column) -> Column:
    """Blend of the three distances; null if a part is."""
    return 0.45 * state + 0.35 * action + 0.20 * duration


def ngrams(bits: Column) -> Column:
    """Map of unigram (``u:a``) and bigram (``b:a:b``) counts of an array of codes."""
    a = F.transform(bits, lambda v: F.concat(F.lit("u:"), v.cast("string")))
    n = F.greatest(F.size(bits) - 1, F.lit(0))
    b = F.zip_with(F.slice(bits, 1, n), F.slice(bits, 2, n), lambda x, y: F.concat(F.lit("b:"), x.cast("string"), F.lit(":"), y.cast("string")))
    words = F.array_sort(F.concat(a, b))
    kinds = F.array_distinct(words)
    return F.map_from_arrays(kinds, F.transform(kinds, lambda k: F.size(F.filter(words, lambda w: w == k)).cast("bigint")))


def nearest_earlier(df: DataFrame, uid: str, stratum: str, vec: str) -> DataFrame:
    """For every row its nearest earlier row (smaller uid), of the same stratum if there is one, else of all.

    Strata are few (weapons, labels). Rows of a stratum meet in Arrow blocks: each row as a query is sent to the blocks of its own stratum only; rows that open their
    stratum (one per stratum) meet all blocks. No pair of rows is emitted, only the best per block."""
    import numpy as np
    import pyarrow as pa

    rows = df.select(F.col(uid).alias("uid"), F.col(stratum).alias("stratum"), F.col(vec).alias("vec")).where("vec IS NOT NULL")
    firsts = rows.groupBy("stratum").agg(F.min("uid").alias("first"))
    blocks = rows.groupBy("stratum").agg(F.ceil(F.count("*") / 2000).cast("int").alias("blocks"))
    tagged = rows.join(firsts, "stratum").join(blocks, "stratum").withColumn("block", F.pmod(F.xxhash64("uid"), "blocks").cast("int"))
    members = tagged.select("stratum", "block", "uid", "vec", F.lit(False).alias("asks"))
    own = tagged.where("uid <> first").select("stratum", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), "uid", "vec", F.lit(True).alias("asks"))
    every = blocks.select("stratum", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block")).agg(F.collect_list(F.struct("stratum", "block")).alias("b")).withColumn("k", F.lit(0))
    opening = tagged.where("uid = first").select("uid", "vec", F.lit(0).alias("k")).join(F.broadcast(every), "k").select(F.inline("b"), "uid", "vec", F.lit(True).alias("asks"))  # one row a stratum

    def best(part: pa.Table) -> pa.Table:
        asks = np.asarray(part.column("asks").to_pylist(), dtype=bool)
        u = part.column("uid").to_numpy()
        x = np.array(part.column("vec").to_pylist(), dtype=np.float64)
        m, q = np.flatnonzero(~asks), np.flatnonzero(asks)
        got = []
        for i in q:
            ok = m[u[m] < u[i]]
            if len(ok):
                d = np.sqrt(((x[ok] - x[i]) ** 2).sum(1))
                j = np.lexsort((u[ok], d))[0]
                got.append((int(u[i]), int(u[ok[j]]), float(d[j])))
        cols = list(zip(*got)) if got else [(), (), ()]
        return pa.table({"uid": pa.array(cols[0], pa.int64()), "nearest": pa.array(cols[1], pa.int64()), "distance": pa.array(cols[2], pa.float64())})

    found = members.unionByName(own).unionByName(opening).groupBy("stratum", "block").applyInArrow(best, "uid bigint, nearest bigint, distance double")
    return found.groupBy("uid").agg(F.min(F.struct("distance", "nearest")).alias("b")).select("uid", "b.nearest", "b.distance")


def js_floor(h):
    """Least Jensen-Shannon distance (root, base 2) at a squared Hellinger distance h = 1 - sum of sqrt(p q): per term of the sums the ratio of the divergence in bits to
    h lies between 1 (one side is 0) and 1 / ln 2 (the sides are equal). Works in place."""
    h.clip(0, None, out=h)
    h **= 0.5
    return h


def nearest_blended(features: DataFrame, block: int = 12000) -> DataFrame:
    """uid, weapon, nearest, distance: for every record the nearest earlier one (smaller uid) of its weapon under the blended distance, of all weapons
    where its own has none earlier; nearest and distance are null for the very first. Of equal distances the smaller uid counts.

    features: uid, weapon, length, ngrams, state; a uid counts once. Unknown weapons are a stratum of their own. Records without n-grams or state have no distance and are left
    out; states of another size can't be compared, so a record meets only those of its size. Exact: all pairs of a stratum meet (see ``nearest.Nearest``).

    Records are packed and written once, in files of about ``block`` rows, each a range of uids. The queries of a task are a run of files of one stratum, or small strata as a whole; it
    reads the files up to these itself, one after the other, so no row is shuffled for the sake of a pair. The shared folder must be one that pyarrow opens by its address."""
    import numpy as np
    import pyarrow as pa

    from tracelake.operators import nearest

    kind = "float" if dict(features.dtypes)["state"] == "array<array<float>>" else "double"
    t = features.select("uid", F.coalesce("weapon", F.lit("")).alias("weapon"), F.col("length").cast("double").alias("length"), F.map_keys("ngrams").alias("grams"), F.map_values("ngrams").alias("counts"),
                        F.flatten("state").cast(f"array<{kind}>").alias("state")).where("uid IS NOT NULL AND length IS NOT NULL AND size(state) > 0 AND aggregate(counts, 0L, (a, x) -> a + coalesce(x, 0L)) > 0")
    code = {r.g: i for i, r in enumerate(features.select(F.explode(F.map_keys("ngrams")).alias("g")).distinct().orderBy("g").collect())}  # bounded by the alphabet of the steps, not by the records
    n = features.count()
    files = max(1, math.ceil(n / block))
    some = features.select("uid").where((F.pmod(F.xxhash64("uid"), F.lit(max(1, n // (100 * files)))) == 0) & F.col("uid").isNotNull()).distinct().orderBy("uid").collect()  # about a hundred a file
    borders = [some[len(some) * k // files].uid for k in range(1, files)] if some else []

    def pack(batches):
        ends = lambda lists: np.r_[0, np.cumsum(lists.value_lengths().to_numpy(zero_copy_only=False))].astype(np.int64)
        for b in batches:
            uid, grams, counts, state = (b.column(c) for c in ("uid", "grams", "counts", "state"))
            words = grams.flatten().dictionary_encode()
            codes = np.array([code[g] for g in words.dictionary.to_pylist()], dtype=np.int64)[words.indices.to_numpy()]
            bits = [nearest.packed(state.flatten().to_numpy(zero_copy_only=False), ends(state), nearest.STATES), nearest.packed(codes, ends(grams), nearest.CODES),
                    nearest.packed(counts.flatten().fill_null(0).to_numpy().astype(np.int64), ends(counts), nearest.COUNTS)]
            yield pa.RecordBatch.from_arrays([pa.array([bisect_right(borders, u) for u in uid.to_pylist()], pa.int32()), uid, b.column("weapon"), b.column("length"), *[pa.array(np.diff(ends(x)), pa.int32()) for x in (state, grams)], *[pa.array(x, pa.binary()) for x in bits]],
                                             names=["file", "uid", "weapon", "length", "size", "kinds", "state", "grams", "counts"])

    rows = t.mapInArrow(pack, "file int, uid string, weapon string, length double, size int, kinds int, state binary, grams binary, counts binary")
    rows = stage(rows.repartition(files, "file").dropDuplicates(["file", "uid"]).sortWithinPartitions("file", "uid"), "blended")
    held = rows.groupBy("file", F.input_file_name().alias("path"), "size", "weapon").agg(F.count("*").alias("n"), F.min("uid").alias("first")).collect()  # a row a file and stratum
    paths = sorted({(r.file, r.path) for r in held})
    place, strata = {p: k for k, p in enumerate(paths)}, {}
    for r in sorted(held, key=lambda r: (r.file, r.path)):
        strata.setdefault((r.size, r.weapon), []).append((place[r.file, r.path], r.n, r.first))
    work = nearest.jobs(strata, block) if strata else []
    openers = frozenset(u for j in work for u in j.openers)

    def search(batches):
        for b in batches:
            for k in b.column("id").to_pylist():
                yield from work[k].run(paths, len(code), block, openers)

    return features.sparkSession.range(0, len(work), 1, max(1, len(work))).mapInArrow(search, "uid string, weapon string, nearest string, distance double")


def select_diverse(candidates: DataFrame, references: DataFrame, least: float, distance, whole_pool: bool = False) -> DataFrame:
    """Accept candidates in order of ``path`` unless an equal fingerprint is in the pool or the nearest of the pool is closer than ``least``.

    The pool is what is referenced or accepted so far of the same weapon, or everything where a weapon has none. The decision depends on what
    was accepted before, so a weapon is one ordered group; where some weapon has no reference (``whole_pool``), all are one group.
    distance(row_a, row_b) -> float over the pandas rows. Columns: path, accepted, reason, distance (null if nothing to compare)."""
    both = candidates.withColumn("_ref", F.lit(False)).unionByName(references.withColumn("_ref", F.lit(True)), allowMissingColumns=True)

    def run(part: pd.DataFrame) -> pd.DataFrame:
        pool = [r for r in part[part["_ref"]].sort_values("path").itertuples(index=False)]
        out = []
        for c in part[~part["_ref"]].sort_values("path").itertuples(index=False):
            if any(p.fingerprint == c.fingerprint for p in pool):
                out.append((c.path, False, "exact", 0.0))
                continue
            near = [p for p in pool if p.weapon == c.weapon] or pool
            d = min((distance(c, p) for p in near), default=None)
            ok = d is None or d >= least
            out.append((c.path, ok, None if ok else "near", d))
            if ok:
                pool.append(c)
        return pd.DataFrame(out, columns=["path", "accepted", "reason", "distance"])

    return both.withColumn("_group", F.lit(None).cast("string") if whole_pool else F.col("weapon")).groupBy("_group").applyInPandas(run, "path string, accepted boolean, reason string, distance double")


def audit_summary(audit: DataFrame) -> DataFrame:
    """Counts of exact and near rejections, and the 10 %, 50 %, 90 % points of the distances."""
    q = F.percentile("distance", F.array(F.lit(0.1), F.lit(0.5), F.lit(0.9)))
    return audit.agg(F.count("*").alias("candidates"), F.count_if("accepted").alias("accepted"), F.count_if(F.col("reason") == "exact").alias("exact"), F.count_if(F.col("reason") == "near").alias("near"), q.alias("q")).select(
        "candidates", "accepted", "exact", "near", F.col("q")[0].alias("p10"), F.col("q")[1].alias("median"), F.col("q")[2].alias("p90"))
