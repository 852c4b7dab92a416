"""Queries around releases: manifests, caps, promotion, membership checks, balance, set comparisons."""

from __future__ import annotations

from pyspark.sql import functions as F

from tracelake.functions import identity as ids
from tracelake.operators import expectations, metrics, segments, select
from tracelake.queries import query, table
from tracelake.sources import files

C = F.col
_HEX = "nullif(lower(regexp_extract(fingerprint, '([0-9a-fA-F]{64})', 1)), '')"


@query("SELECT DISTINCT uid, label, level, skip, start_step, end_step, src_trace, split, CAST(len(actions) AS INTEGER) AS length, weapon FROM segments")
def manifest_view(spark, d):
    """The index of segments, derived when it is read; redelivered rows once."""
    return files.manifest(table(spark, d, "segments")).distinct()


@query("SELECT DISTINCT uid FROM segments WHERE split = 'train' AND label = 'kill_soldier' AND meta['source_task'] IS NULL")
def train_sources(spark, d):
    """Segments written as training data of a label and not derived from others."""
    return files.train_sources(table(spark, d, "segments"), "kill_soldier").select("uid").distinct()


@query("SELECT label, uid FROM (SELECT label, uid, row_number() OVER (PARTITION BY label ORDER BY uid) AS r FROM (SELECT DISTINCT label, uid FROM segments)) WHERE r <= 12")
def per_label_cap(spark, d):
    """The first dozen segments of each label."""
    s = table(spark, d, "segments").select("label", "uid").distinct()
    return select.top_k(s, ["label"], [C("uid")], 12).select("label", "uid")


@query("""WITH s AS (SELECT DISTINCT uid, label, start_step, end_step FROM segments), g AS (SELECT uid, label, CASE WHEN end_step - start_step < 100 THEN 'too short' WHEN end_step - start_step > 200 THEN 'too long' END AS reason FROM s),
k AS (SELECT *, coalesce(sum(CASE WHEN reason IS NULL THEN 1 ELSE 0 END) OVER (PARTITION BY label ORDER BY uid ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS k FROM g) SELECT uid, CASE WHEN k >= 5 THEN 'capped' ELSE reason END AS reason FROM k""")
def gate_reasons(spark, d):
    """First reason of each segment with the cap asked first (five kept per label)."""
    s = table(spark, d, "segments").select("uid", "label", "start_step", "end_step").distinct()
    n = C("end_step") - C("start_step")
    return segments.gated(s, [("too short", n < 100), ("too long", n > 200)], "label", 5, ["uid"]).select("uid", "reason")


@query("WITH s AS (SELECT DISTINCT uid, split FROM segments), v AS (SELECT DISTINCT uid FROM diversity_features WHERE length > 150) SELECT s.uid, s.split AS source_split, CASE WHEN v.uid IS NULL THEN 'train' ELSE 'val' END AS split FROM s LEFT JOIN v USING (uid)")
def release_split(spark, d):
    """The validation set (here the long records) overrides the written split."""
    held = table(spark, d, "diversity_features").where("length > 150")
    return segments.release_split(table(spark, d, "segments").select("uid", "split").distinct(), held).select("uid", "source_split", "split")


@query(f"""WITH e AS (SELECT DISTINCT uid, {_HEX} AS fp, batch_no FROM episodes), k AS (SELECT DISTINCT fp FROM e WHERE batch_no <= 1), c AS (SELECT uid, fp, row_number() OVER (PARTITION BY fp ORDER BY uid) AS r FROM e WHERE batch_no > 1 AND fp IS NOT NULL)
SELECT uid, CASE WHEN fp IN (SELECT fp FROM k WHERE fp IS NOT NULL) OR r > 1 THEN 'existing' ELSE 'promoted' END AS status FROM c""")
def promote_status(spark, d):
    """Later episodes against the fingerprints of the first batches."""
    e = table(spark, d, "episodes").select("uid", ids.hex64(C("fingerprint")).alias("fingerprint"), "batch_no").dropDuplicates(["uid"]).where("fingerprint IS NOT NULL")
    return files.promote(e.where("batch_no > 1").withColumnRenamed("uid", "path"), e.where("batch_no <= 1")).select(C("path").alias("uid"), "status")


@query(f"""WITH m AS (SELECT DISTINCT shard_id, {_HEX} AS fp FROM shard_episodes), e AS (SELECT {_HEX} AS fp, max(coalesce(action_steps, len(actions))) AS n FROM episodes GROUP BY 1)
SELECT s.id AS shard_id, count(e.fp) AS found, CAST(coalesce(sum(e.n), 0) AS BIGINT) AS frames, CAST(t.target_frames - coalesce(sum(e.n), 0) AS BIGINT) AS unused FROM shards s JOIN shard_targets t ON t.level = s.level AND t.task = s.task LEFT JOIN m ON m.shard_id = s.id LEFT JOIN e ON e.fp = m.fp GROUP BY s.id, t.target_frames""")
def shard_balance(spark, d):
    """Frames each published shard really holds, and its unused space."""
    m = table(spark, d, "shard_episodes").select("shard_id", ids.hex64(C("fingerprint")).alias("fp")).distinct()
    e = table(spark, d, "episodes").groupBy(ids.hex64(C("fingerprint")).alias("fp")).agg(F.max(F.coalesce("action_steps", F.size("actions"))).alias("n"))
    s = table(spark, d, "shards").select(C("id").alias("shard_id"), "level", "task").join(table(spark, d, "shard_targets"), ["level", "task"])
    held = m.join(e, "fp").groupBy("shard_id").agg(F.count("*").alias("found"), F.sum("n").cast("bigint").alias("frames"))
    return s.join(held, "shard_id", "left").select("shard_id", F.coalesce("found", F.lit(0)).alias("found"), F.coalesce("frames", F.lit(0)).cast("bigint").alias("frames"), (C("target_frames") - F.coalesce("frames", F.lit(0))).alias("unused"))


@query("SELECT 'features without segment' AS gate, count(*) AS violations FROM diversity_features f WHERE NOT EXISTS (SELECT 1 FROM segments s WHERE s.uid = f.uid) UNION ALL SELECT 'labels without document', count(*) FROM subject_labels l WHERE NOT EXISTS (SELECT 1 FROM documents d WHERE d.doc_id = l.doc_id) UNION ALL SELECT 'tokens without encoder', count(*) FROM frame_tokens t WHERE NOT EXISTS (SELECT 1 FROM encoders e WHERE e.checkpoint_sha256 = t.encoder_sha256) UNION ALL SELECT 'tokens without episode', count(*) FROM frame_tokens t WHERE NOT EXISTS (SELECT 1 FROM episodes e WHERE e.fingerprint = t.fingerprint)")
def integrity_join(spark, d):
    """Rows whose parent is missing, per relation."""
    t = lambda n: table(spark, d, n)
    enc = t("encoders").select(C("checkpoint_sha256").alias("encoder_sha256"))
    return expectations.violations({
        "features without segment": expectations.missing(t("diversity_features").select("uid"), t("segments"), ["uid"]), "labels without document": expectations.missing(t("subject_labels").select("doc_id"), t("documents"), ["doc_id"]),
        "tokens without encoder": expectations.missing(t("frame_tokens").select("encoder_sha256"), enc, ["encoder_sha256"]), "tokens without episode": expectations.missing(t("frame_tokens").select("fingerprint"), t("episodes"), ["fingerprint"])})


@query("SELECT level, count(*) AS checked, count(*) FILTER (NOT EXISTS (SELECT 1 FROM events e WHERE e.user_id = s.id)) AS mismatches FROM shards s GROUP BY level")
def semi_member(spark, d):
    """Per level: ids checked against another table's keys, and those it lacks."""
    keys = table(spark, d, "events").select(C("user_id").alias("id")).distinct().withColumn("_in", F.lit(True))
    return table(spark, d, "shards").join(keys, "id", "left").groupBy("level").agg(F.count("*").alias("checked"), F.count_if(C("_in").isNull()).alias("mismatches"))


@query("""WITH a AS (SELECT DISTINCT source_trace FROM episodes WHERE task = 'boss'), b AS (SELECT DISTINCT source_trace FROM episodes WHERE task = 'kill')
SELECT (SELECT count(*) FROM (SELECT * FROM a INTERSECT SELECT * FROM b)) AS common, (SELECT count(*) FROM (SELECT * FROM a EXCEPT SELECT * FROM b)) AS only_boss, (SELECT count(*) FROM (SELECT * FROM b EXCEPT SELECT * FROM a)) AS only_kill""")
def set_compare(spark, d):
    """Traces that two tasks share, and those of one only: one aggregation instead of three set operations."""
    e = table(spark, d, "episodes").where("task IN ('boss', 'kill')").groupBy("source_trace").agg(F.bool_or(C("task") == "boss").alias("a"), F.bool_or(C("task") == "kill").alias("b"))
    return e.agg(F.count_if(C("a") & C("b")).alias("common"), F.count_if(C("a") & ~C("b")).alias("only_boss"), F.count_if(C("b") & ~C("a")).alias("only_kill"))


@query("""SELECT event_type, count(value) AS n, round(avg(value), 6) AS mean, round(coalesce(stddev_samp(value), 0), 6) AS sd FROM events GROUP BY 1""")
def seed_summary(spark, d):
    """n, mean and sample deviation per arm."""
    e = table(spark, d, "events").withColumnRenamed("event_id", "seed")
    return metrics.seed_summary(e, ["event_type"], "value").select("event_type", "n", F.round("mean", 6).alias("mean"), F.round("sd", 6).alias("sd"))


@query("SELECT level, task, weapon, count(*) AS shards, CAST(sum(episodes) AS BIGINT) AS episodes FROM shards GROUP BY GROUPING SETS ((level, task, weapon), (level, task), (level), ())")
def composition_cube(spark, d):
    """Composition of the release at four levels of detail, in one pass."""
    s = table(spark, d, "shards")
    g = s.groupingSets([["level", "task", "weapon"], ["level", "task"], ["level"], []], "level", "task", "weapon")
    return g.agg(F.count("*").alias("shards"), F.sum("episodes").alias("episodes")).select("level", "task", "weapon", "shards", "episodes")


@query()
def bootstrap_gap(spark, d):
    """Confidence interval of the mean difference between two arms by Poisson bootstrap over users."""
    e = table(spark, d, "events").where("event_type IN ('view', 'click')")
    side = lambda a: F.avg(F.when(C("event_type") == a, C("value")))
    return metrics.bootstrap_gap(e.groupBy("user_id").agg((side("view") - side("click")).alias("gap")), "gap", 200)
