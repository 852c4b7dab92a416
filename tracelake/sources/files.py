"""Table sources and sinks: JSON lines, YAML, committed batches, layouts, ordered training reads."""

from __future__ import annotations

import hashlib
import json
import os
import re

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

from tracelake.operators.expectations import require


def json_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Rows of JSON-lines files; blank lines are skipped, a broken line is an error. The schema is never inferred."""
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def yaml_rows(spark: SparkSession, path: str, schema: str, rows) -> DataFrame:
    """A small YAML document as a table; ``rows`` turns the parsed document into tuples. Unknown keys are the caller's to reject."""
    import yaml

    with open(path) as f:
        return spark.createDataFrame(rows(yaml.safe_load(f)), schema)


def named(df: DataFrame, pattern: str) -> DataFrame:
    """Rows of files whose base name matches."""
    return df.where(F.element_at(F.split(F.col("_metadata.file_path"), "/"), -1).rlike(pattern))


def committed(markers: DataFrame, payload: DataFrame, on: list[str]) -> DataFrame:
    """Payload rows of batches whose marker is there: a batch without marker isn't visible."""
    return payload.join(markers.select(*on).distinct(), on, "left_semi")


def source_list(include: list[DataFrame], exclude: list[DataFrame], path: str = "path") -> DataFrame:
    """Union of lists without repeats, minus the exclusions, in order."""
    out = include[0].select(path)
    for d in include[1:]:
        out = out.unionByName(d.select(path))
    out = out.distinct()
    for d in exclude:
        out = out.join(d.select(path).distinct(), path, "left_anti")
    return out.orderBy(path)


def train_sources(segments: DataFrame, label: str) -> DataFrame:
    """Sources for training: the split written as ``train``, the label, not derived from another segment."""
    derived = F.try_element_at("meta", F.lit("source_task"))
    return segments.where((F.col("split") == "train") & (F.col("label") == label) & derived.isNull())


LAYOUTS = (("frames.npy", "indexed"), ("episodes", "episodes"), (".tar", "tar"), (".parquet", "parquet"))


def layout(path: str) -> str:
    """Layout of a corpus, told from what lies in its folder."""
    names = sorted(os.listdir(path))
    for mark, name in LAYOUTS:
        if any(n == mark or n.endswith(mark) for n in names):
            return name
    raise ValueError(f"no known layout in {path}")


def ordered_pass(df: DataFrame, keys: list[str]) -> DataFrame:
    """The one deterministic pass of evaluation splits."""
    return df.orderBy(*keys)


def shuffled_epoch(df: DataFrame, key: Column, seed: int, worker: int = 0, epoch: int = 0, windows: tuple[str, str, int] | None = None) -> DataFrame:
    """Every row once in an order given by seed, worker and epoch (seed + worker + 1009 * epoch).

    windows (episode column, frame column, n): episodes and, inside them, windows of n frames keep together and are shuffled as such,
    rows inside a window as well."""
    s = seed + worker + epoch * 1009
    h = lambda *c: F.xxhash64(F.lit(s), *c)
    if windows is None:
        return df.orderBy(h(key), key)
    ep, frame, n = windows
    window = F.floor(F.col(frame) / n)
    return df.orderBy(h(F.col(ep)), F.col(ep), h(F.col(ep), window), window, h(key), key)


def point_read(df: DataFrame, shard: Column, uid: Column) -> DataFrame:
    """One episode; both conditions reach the scan."""
    return df.where(shard & uid)


def freeze(df: DataFrame, fingerprint: str, n: int) -> tuple[DataFrame, str]:
    """Frozen selection: the n smallest fingerprints (fewer is an error) and the SHA-256 of their sorted list. The list is bounded by n."""
    got = df.select(fingerprint).distinct().orderBy(fingerprint).limit(n)
    names = [r[0] for r in got.collect()]
    require(len(names) == n, f"{len(names)} of {n} fingerprints")
    digest = hashlib.sha256(json.dumps(names, sort_keys=True, separators=(",", ":")).encode()).hexdigest()
    return df.join(got, fingerprint, "left_semi"), digest


def canonical_digest(document: dict) -> str:
    """SHA-256 of a document as JSON with sorted keys and without spaces."""
    return hashlib.sha256(json.dumps(document, sort_keys=True, separators=(",", ":")).encode()).hexdigest()


def write_segments(segments: DataFrame, path: str) -> None:
    """Segments by label; the commit of the job makes all files visible at once."""
    segments.write.mode("overwrite").partitionBy("label").parquet(path)


def manifest(segments: DataFrame) -> DataFrame:
    """The index of segments, derived from the table whenever it is read: ten columns, sorted."""
    return segments.select("uid", "label", "level", "skip", "start_step", "end_step", "src_trace", "split", F.size("actions").alias("length"), "weapon").orderBy("label", "uid")


def write_shards(rows: DataFrame, shard: str, path: str, mode: str = "errorifexists") -> None:
    """One folder per shard, rows sorted inside it; an existing release is refused."""
    rows.repartition(F.col(shard)).sortWithinPartitions(shard).write.mode(mode).partitionBy(shard).parquet(path)


def episodes_packed(frames: DataFrame, episode: list[str], frame: str, columns: list[str]) -> DataFrame:
    """Frames gathered to one row per episode, in order, with the number of frames (an episode is bounded by its recording)."""
    return frames.groupBy(*episode).agg(F.sort_array(F.collect_list(F.struct(frame, *columns))).alias("frames"), F.count("*").alias("n_frames"))


def promote(candidates: DataFrame, known: DataFrame, on: str = "fingerprint") -> DataFrame:
    """Candidates with their status: ``existing`` if the fingerprint is known (or came before in the same lot), else ``promoted``."""
    w = Window.partitionBy(on).orderBy("path")
    k = known.select(on).distinct().withColumn("_k", F.lit(True))
    return candidates.join(k, on, "left").withColumn("_r", F.row_number().over(w)).withColumn("status", F.when(F.col("_k") | (F.col("_r") > 1), "existing").otherwise("promoted")).drop("_k", "_r")


def append_new(rows: DataFrame, path: str, key: list[str]) -> int:
    """Append-only table of attempts: rows whose key is already there are left out, so a driver that is run again goes on where it stopped. The number of rows added."""
    spark = rows.sparkSession
    try:
        fresh = rows.join(spark.read.schema(rows.schema).parquet(path).select(*key).distinct(), key, "left_anti")
    except AnalysisException:
        fresh = rows
    fresh = fresh.dropDuplicates(key)
    n = fresh.count()
    if n:
        fresh.write.mode("append").parquet(path)
    return n


def remaining(requests: DataFrame, path: str, key: list[str], schema: str) -> DataFrame:
    """Requests that have no attempt in the table yet."""
    try:
        return requests.join(requests.sparkSession.read.schema(schema).parquet(path).select(*key).distinct(), key, "left_anti")
    except AnalysisException:
        return requests


def verified_files(spark: SparkSession, manifest: DataFrame, root: str, strict: bool = True) -> DataFrame:
    """The files that a manifest (path below root, bytes, sha256) lists, with ``content``, and ``ok``: size and digest are as listed. A file that is missing or differs
    is an error where ``strict``; files that no manifest lists aren't read. Scans pass over
    empty files, so one that is listed with no bytes counts as there."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    listed = manifest.select(F.col("path").alias("name"), F.col("bytes").alias("_bytes"), F.col("sha256").alias("_sha"))
    name = F.regexp_replace(F.col("path"), F.concat(F.lit("^.*?"), F.lit(re.escape(root.rstrip("/"))), F.lit("/")), "")
    t = listed.join(files.select(name.alias("name"), "content", "length"), "name", "left")
    empty = F.col("length").isNull() & (F.col("_bytes") == 0)
    t = t.withColumns({"content": F.when(empty, F.lit(b"")).otherwise(F.col("content")), "length": F.when(empty, 0).otherwise(F.col("length"))})
    ok = (F.col("length") == F.col("_bytes")) & (F.sha2("content", 256) == F.lower("_sha"))
    t = t.withColumn("ok", F.coalesce(ok, F.lit(False)))
    if strict:
        t = t.withColumn("ok", F.when(F.col("ok"), True).otherwise(F.raise_error(F.concat(F.lit("file differs from its manifest: "), F.col("name"))).cast("boolean")))
    return t.select(F.col("name").alias("path"), "content", "ok")


def corpus(spark: SparkSession, path: str) -> DataFrame:
    """A corpus in whatever layout it has (see ``layout``)."""
    from tracelake.sources import archives

    kind = layout(path)
    if kind == "parquet":
        return spark.read.parquet(path)
    archives.register(spark)
    if kind == "tar":
        return spark.read.format("tarpairs").option("path", path).load()
    if kind == "episodes":
        return spark.read.format("npz").option("path", os.path.join(path, "episodes")).load()
    raise ValueError(f"{path}: layout {kind} has no reader")


def is_complete(manifest: dict | None, expected: dict, names: list[str], needed: tuple[str, ...]) -> bool:
    """Is a part of a corpus done? Its manifest holds all that is expected, and the needed files are there."""
    return manifest is not None and all(k in manifest and manifest[k] == v for k, v in expected.items()) and set(needed) <= set(names)


def corpus_shards(episodes: DataFrame, ordinal: str, committed_shards: DataFrame, per: int = 10) -> DataFrame:
    """Episodes with their ``shard`` (``per`` episodes each), without those of shards that are committed already."""
    return episodes.withColumn("shard", F.floor(F.col(ordinal) / per).cast("bigint")).join(committed_shards.select("shard").distinct(), "shard", "left_anti")
