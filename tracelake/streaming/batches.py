"""Structured Streaming: sealing of batches, visibility by markers, idempotent sinks, deduplication, edges."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.utils import AnalysisException

from tracelake.operators.expectations import require


def file_stream(spark: SparkSession, path: str, schema, per_trigger: int = 1000) -> DataFrame:
    """Rows of a folder as they arrive; at most ``per_trigger`` files a batch (back-pressure)."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", per_trigger).parquet(path)


def sealed(stream: DataFrame, worker: str, member: str, size: int) -> DataFrame:
    """Members grouped to batches of exactly ``size`` per worker, in order of arrival: worker, batch, members. The open batch is state (bounded by ``size``)
    and survives a restart; an open tail is never visible. The number of sealed batches is in the state too."""

    def seal(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held, done = (list(state.get[0]), state.get[1]) if state.exists else ([], 0)
        out = []
        for part in parts:
            for m in part[member].astype(str).tolist():
                held.append(m)
                if len(held) == size:
                    out.append((key[0], done, held))
                    held, done = [], done + 1
        state.update((held, done))
        if out:
            yield pd.DataFrame(out, columns=["worker", "batch", "members"])

    t = stream.select(F.col(worker).cast("string").alias("worker"), F.col(member).cast("string").alias(member))
    return t.groupBy("worker").applyInPandasWithState(seal, "worker string, batch long, members array<string>", "held array<string>, done long", "append", GroupStateTimeout.NoTimeout)


def first_seen(stream: DataFrame, key: list[str], event_time: str | None = None, within: str | None = None) -> DataFrame:
    """Rows whose key wasn't seen before. With an event time (a TIMESTAMP) the state is kept for ``within`` only; without, for good."""
    if event_time:
        return stream.withWatermark(event_time, within).dropDuplicatesWithinWatermark(key)
    return stream.dropDuplicates(key)


def rising_stream(stream: DataFrame, key: str, order: list[str], flag: str) -> DataFrame:
    """Rising edges of a boolean column over each key's rows: the last value is state. Inside a micro-batch rows are put in order;
    across micro-batches the input must arrive in order."""
    fields = [(c, dict(stream.dtypes)[c]) for c in [key, *order]]

    def edges(k: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        rows = pd.concat(list(parts)).sort_values(order)
        last = state.get[0] if state.exists else None
        keep = []
        for v in rows[flag].tolist():
            keep.append(bool(v) and last is False)
            last = bool(v)
        state.update((last,))
        yield rows.loc[keep, [c for c, _ in fields]]

    return stream.select(key, *order, flag).groupBy(key).applyInPandasWithState(edges, ", ".join(f"{c} {t}" for c, t in fields), "last boolean", "append", GroupStateTimeout.NoTimeout)


def content(rows: DataFrame) -> tuple[int, str]:
    """Number of rows and a digest of their content that doesn't depend on the order (sum of two hashes of each row)."""
    cols = [F.col(c) for c in sorted(rows.columns)]
    r = rows.agg(F.count(F.lit(1)).alias("n"), *[F.coalesce(F.sum(F.xxhash64(F.lit(seed), *cols).cast("decimal(38,0)")), F.lit(0)).alias(f"h{seed}") for seed in (1, 2)]).collect()[0]
    return r.n, f"{int(r.h1):x}.{int(r.h2):x}"


def _marker(spark: SparkSession, path: str, batch_id: int) -> tuple[int, str] | None:
    try:
        got = spark.read.schema("batch bigint, rows bigint, digest string").json(f"{path}/markers/batch={batch_id}").collect()  # one row
    except AnalysisException:
        return None
    return (got[0].rows, got[0].digest) if got else None


def publish(batch: DataFrame, batch_id: int, path: str) -> bool:
    """Create-only sink for ``foreachBatch``: data under the batch's number, read back and compared in size and digest, then the marker. What was written without a marker
    (a run that broke) is replaced; a batch that is published already is left as it is if it is the same (False), and an error if its content differs."""
    spark = batch.sparkSession
    own, there = content(batch), _marker(spark, path, batch_id)
    if there is not None:
        require(there == own, f"batch {batch_id} was published with other content")
        return False
    target = f"{path}/data/batch={batch_id}"
    batch.write.mode("overwrite").parquet(target)
    require(content(spark.read.schema(batch.schema).parquet(target)) == own, f"batch {batch_id} was not written as it is")
    spark.createDataFrame([(batch_id, *own)], "batch bigint, rows bigint, digest string").coalesce(1).write.mode("errorifexists").json(f"{path}/markers/batch={batch_id}")
    return True


def cut_batches(members: DataFrame, worker: str, order: list[str], size: int, flush: bool = False) -> DataFrame:
    """The journal of a worker's members as batches of exactly ``size`` in order: members with ``batch`` and ``open``. An open tail belongs to the batch it will
    be in once that is full; ``flush`` seals it as it is. Batches depend on the journal alone, so a restart goes on where the last run ended."""
    w = Window.partitionBy(worker)
    t = members.withColumns({"_no": F.row_number().over(w.orderBy(*order)), "_all": F.count("*").over(w)}).withColumn("batch", F.floor((F.col("_no") - 1) / size))
    return t.withColumn("open", F.lit(False) if flush else (F.col("batch") + 1) * size > F.col("_all")).drop("_no", "_all")


def resume(batches: DataFrame, path: str) -> list[int]:
    """Publish every sealed batch (column ``batch``) that has no marker yet, in order; the numbers published. Sealed batches wait for a restart in small numbers."""
    spark = batches.sparkSession
    waiting = [r.batch for r in batches.select("batch").distinct().orderBy("batch").collect()]
    return [b for b in waiting if _marker(spark, path, b) is None and publish(batches.where(F.col("batch") == b).drop("batch"), b, path)]


def published(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Rows of the batches whose marker is there."""
    data = spark.read.schema(schema + ", batch bigint").option("basePath", f"{path}/data").parquet(f"{path}/data")
    marks = spark.read.schema("batch bigint, rows bigint, digest string").json(f"{path}/markers")
    return data.join(marks.select("batch").distinct(), "batch", "left_semi")


def run_available(stream: DataFrame, path: str, checkpoint: str) -> None:
    """Work off what is there, with the sink above; the checkpoint makes a restart go on where it ended."""
    stream.writeStream.foreachBatch(lambda df, i: publish(df, i, path)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def backoff(attempt: int, first: float = 5.0, most: float = 300.0) -> float:
    """Seconds to wait before an attempt: doubling from ``first`` to ``most``."""
    return min(most, first * 2 ** max(0, attempt))
