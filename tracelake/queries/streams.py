"""Streams over the event files, checked against what the batch gives."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from tracelake.plans.staging import shared_dir
from tracelake.queries import query, table
from tracelake.streaming import batches

C = F.col


def _drain(spark, stream):
    """Run a stream over what is there into a shared table and read it back."""
    at = f"{shared_dir(spark)}/stream-{uuid.uuid4().hex[:12]}"
    stream.writeStream.format("parquet").option("path", f"{at}/out").option("checkpointLocation", f"{at}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{at}/out")


def _twice(spark, d):
    """The events delivered twice, as files of a stream."""
    at = f"{shared_dir(spark)}/events-{uuid.uuid4().hex[:12]}"
    e = table(spark, d, "events").select("event_id", "user_id", "event_type")
    e.unionByName(e).write.parquet(at)
    return batches.file_stream(spark, at, e.schema)


@query("SELECT DISTINCT event_id, user_id FROM events")
def stream_dedup(spark, d):
    """Redelivered events, each kept once."""
    return _drain(spark, batches.first_seen(_twice(spark, d), ["event_id"])).select("event_id", "user_id")


@query("""SELECT user_id, event_id FROM (SELECT *, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS p FROM events) WHERE event_type = 'purchase' AND p IS NOT NULL AND p <> 'purchase'""")
def stream_edges(spark, d):
    """Rising edges from a stream with per-user state: the same rows as the batch query."""
    at = f"{shared_dir(spark)}/edges-{uuid.uuid4().hex[:12]}"
    e = table(spark, d, "events").select("user_id", "event_id", (C("event_type") == "purchase").alias("buy"))
    e.write.parquet(at)
    return _drain(spark, batches.rising_stream(batches.file_stream(spark, at, e.schema), "user_id", ["event_id"], "buy")).select("user_id", "event_id")


@query("SELECT user_id::VARCHAR AS worker, count(*) // 20 AS batches, CAST(count(*) // 20 * 20 AS BIGINT) AS members FROM events GROUP BY 1 HAVING count(*) >= 20")
def stream_seal(spark, d):
    """Batches of exactly 20 members per worker, sealed by a stream; the open tail stays in the state."""
    at = f"{shared_dir(spark)}/seal-{uuid.uuid4().hex[:12]}"
    e = table(spark, d, "events").select("event_id", "user_id", "event_type")
    e.write.parquet(at)
    out = _drain(spark, batches.sealed(batches.file_stream(spark, at, e.schema), "user_id", "event_id", 20))
    return out.groupBy("worker").agg(F.count("*").alias("batches"), F.sum(F.size("members")).alias("members"))


@query()
def corridor_searches(spark, d):
    """Searches over the toy simulator, one task per seed, replayed for validity."""
    from tracelake.operators.search import Config, searches

    return searches(spark, 12, config=Config(rollouts=32, length=8, settle=3))
