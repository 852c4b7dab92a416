"""Queries on embeddings, frame tokens and heatmaps."""

from __future__ import annotations

from pyspark.sql import functions as F

from tracelake.operators import diversity, metrics, tensor
from tracelake.queries import query, table

C = F.col


def _points(spark, d):
    """Event points as positions on the 256 x 240 picture."""
    e = table(spark, d, "events")
    k = F.get_json_object("props", "$.k").cast("int")
    return e.select((C("event_id") % 50).alias("frame"), (k * 2 + 20).alias("x"), F.least(F.floor("value") + 8, F.lit(230)).alias("y"), "event_type")


_PTS = "p AS (SELECT event_id % 50 AS frame, CAST(json_extract(props, '$.k') AS BIGINT) * 2 + 20 AS x, least(CAST(floor(value) AS BIGINT) + 8, 230) AS y, event_type FROM events)"
_MAP = f"WITH {_PTS}, q AS (SELECT frame, (x - 8) / 240e0 * 32 AS px, (y - 8) / 224e0 * 32 AS py FROM p), h AS (SELECT frame, gx, gy, max(exp(-((gx - px) ** 2 + (gy - py) ** 2) / 2)) AS value FROM q CROSS JOIN range(32) a(gx) CROSS JOIN range(32) b(gy) WHERE px >= 0 AND px < 32 AND py >= 0 AND py < 32 AND abs(gx - px) <= 6 AND abs(gy - py) <= 6 GROUP BY 1, 2, 3)"


@query(_MAP + " SELECT frame, CAST(gx AS INTEGER) AS gx, CAST(gy AS INTEGER) AS gy, round(value, 6) AS value FROM h WHERE value >= 1e-4")
def heatmap_max(spark, d):
    """Occupancy heatmaps of 50 frames: the largest blob per cell."""
    return tensor.heatmaps(_points(spark, d), ["frame"], reach=6).where("value >= 1e-4").withColumn("value", F.round("value", 6))


@query(f"""WITH {_PTS}, c AS (SELECT frame, CASE event_type WHEN 'error' THEN 'projectile' WHEN 'view' THEN 'player' ELSE 'enemy' END AS class, (x - 8) / 240e0 * 16 AS px, (y - 8) / 224e0 * 16 AS py FROM p),
h AS (SELECT frame, class, gx, gy, max(exp(-((gx - px) ** 2 + (gy - py) ** 2) / (2 * (CASE class WHEN 'projectile' THEN 4e0 ELSE 6e0 END * 16 / 224) ** 2))) AS v FROM c CROSS JOIN range(16) a(gx) CROSS JOIN range(16) b(gy) GROUP BY ALL)
SELECT frame, CAST(gx AS INTEGER) AS gx, CAST(gy AS INTEGER) AS gy, round(least(16, 1 + 3 * coalesce(max(v) FILTER (class = 'player'), 0) + 3 * coalesce(max(v) FILTER (class = 'enemy'), 0) + 15 * coalesce(max(v) FILTER (class = 'projectile'), 0)), 6) AS weight FROM h GROUP BY 1, 2, 3""")
def pixel_weights(spark, d):
    """Pixel weights from target heatmaps of three classes on a 16 x 16 grid."""
    cls = F.when(C("event_type") == "error", "projectile").when(C("event_type") == "view", "player").otherwise("enemy")
    t = tensor.target_heatmaps(_points(spark, d).withColumn("class", cls), ["frame"], 16)
    of = lambda c: F.coalesce(F.max(F.when(C("class") == c, C("value"))), F.lit(0.0))
    return t.groupBy("frame", "gx", "gy").agg(of("player").alias("a"), of("enemy").alias("b"), of("projectile").alias("c")).select("frame", "gx", "gy", F.round(tensor.pixel_weights(C("a"), C("b"), C("c")), 6).alias("weight"))


def _book(spark, d):
    """Label centroids, a table of ten rows."""
    rows = table(spark, d, "embeddings").select("label", F.posexplode("embedding").alias("i", "v")).groupBy("label", "i").agg(F.avg("v").alias("m")).groupBy("label").agg(F.transform(F.sort_array(F.collect_list(F.struct("i", "m"))), lambda s: s["m"]).alias("c"))
    return {r.label: r.c for r in rows.collect()}


_CEN = "x AS (SELECT vec_id, label, unnest(embedding)::DOUBLE AS v, generate_subscripts(embedding, 1) AS i FROM embeddings), c AS (SELECT label AS code, i, avg(v) AS m FROM x GROUP BY 1, 2), dd AS (SELECT x.vec_id, c.code, sum((x.v - c.m) ** 2) AS d FROM x JOIN c USING (i) GROUP BY 1, 2), a AS (SELECT vec_id, arg_min(code, {'d': d, 'c': code}) AS code, min(d) AS d FROM dd GROUP BY 1)"


@query(f"WITH {_CEN} SELECT vec_id, code, round(sqrt(d), 5) AS distance FROM a")
def vq_assign(spark, d):
    """Nearest label centroid of every vector."""
    return tensor.nearest_code(table(spark, d, "embeddings"), "vec_id", "embedding", _book(spark, d)).withColumn("distance", F.round("distance", 5))


@query(f"WITH {_CEN}, n AS (SELECT code, count(*) AS n FROM a GROUP BY 1) SELECT count(*) AS used, round(exp(ln(sum(n)) - sum(n * ln(n)) / sum(n)), 6) AS perplexity FROM n")
def code_perplexity(spark, d):
    a = tensor.nearest_code(table(spark, d, "embeddings"), "vec_id", "embedding", _book(spark, d))
    return tensor.perplexity(a, "code").withColumn("perplexity", F.round("perplexity", 6))


@query(f"WITH {_CEN} SELECT a.code, CAST(x.i - 1 AS INTEGER) AS dim, count(*) AS n, round(avg(x.v), 5) AS mean FROM x JOIN a USING (vec_id) GROUP BY 1, 2")
def kmeans_step(spark, d):
    """One Lloyd update from the label centroids."""
    return tensor.lloyd_step(table(spark, d, "embeddings"), "vec_id", "embedding", _book(spark, d)).withColumn("mean", F.round("mean", 5))


@query("""WITH p AS (SELECT a.vec_id, a.label, arg_min(b.vec_id, {'d': list_distance(a.embedding::DOUBLE[64], b.embedding::DOUBLE[64]), 'v': b.vec_id}) AS same FROM embeddings a JOIN embeddings b ON a.label = b.label AND b.vec_id < a.vec_id GROUP BY 1, 2),
f AS (SELECT a.vec_id, arg_min(b.vec_id, {'d': list_distance(a.embedding::DOUBLE[64], b.embedding::DOUBLE[64]), 'v': b.vec_id}) AS other FROM embeddings a JOIN embeddings b ON b.vec_id < a.vec_id WHERE a.vec_id IN (SELECT min(vec_id) FROM embeddings GROUP BY label) GROUP BY 1)
SELECT vec_id, coalesce(same, other) AS nearest FROM (SELECT vec_id FROM embeddings) LEFT JOIN p USING (vec_id) LEFT JOIN f USING (vec_id) WHERE coalesce(same, other) IS NOT NULL""")
def nearest_same_stratum(spark, d):
    """Nearest earlier vector, of the same label if there is one."""
    return diversity.nearest_earlier(table(spark, d, "embeddings"), "vec_id", "label", "embedding").select(C("uid").alias("vec_id"), "nearest")


_CELLS = "x AS (SELECT vec_id, label, unnest(embedding)::DOUBLE AS v, generate_subscripts(embedding, 1) AS i FROM embeddings), c AS (SELECT label, i, avg(v) AS m FROM x GROUP BY 1, 2), z AS (SELECT x.vec_id, x.label, x.i, abs(x.v) AS p, abs(c.m) AS t FROM x JOIN c ON c.label = x.label AND c.i = x.i)"


def _cells(spark, d):
    x = table(spark, d, "embeddings").select("vec_id", "label", F.posexplode("embedding").alias("i", "v")).withColumn("v", C("v").cast("double"))
    c = x.groupBy("label", "i").agg(F.avg("v").alias("m"))
    return x.join(c, ["label", "i"]).select("vec_id", "label", "i", F.abs("v").alias("p"), F.abs("m").alias("t"))


@query(f"""WITH {_CELLS} SELECT vec_id, label, max(t) > 0.5 AS present, round(2 * sum(p * t) / (sum(p * p) + sum(t * t)), 6) AS dice, round(1 - avg((p - t) ** 2) / avg(t * t), 4) AS mse_skill, round(max(p), 6) AS peak FROM z GROUP BY 1, 2""")
def dice_mse_peak(spark, d):
    """Frame metrics of every vector against its label's centroid."""
    m = metrics.frame_metrics(_cells(spark, d), ["vec_id", "label"], "i", "p", "t").drop("peak_hit")
    return m.withColumns({"dice": F.round("dice", 6), "mse_skill": F.round("mse_skill", 4), "peak": F.round("peak", 6)})


@query(f"WITH {_CELLS} SELECT label, round(10 * log10(1 / avg((p - t) ** 2)), 5) AS psnr FROM z GROUP BY 1")
def psnr(spark, d):
    mse = F.avg((C("p") - C("t")) * (C("p") - C("t")))
    return _cells(spark, d).groupBy("label").agg(F.round(metrics.psnr(mse), 5).alias("psnr"))


@query("""WITH s AS (SELECT vec_id, label % 3 AS grp, embedding[1] AS score, embedding[2] > 0 AS y FROM embeddings), r AS (SELECT grp, y, row_number() OVER w AS r, sum(y::INT) OVER (w ROWS UNBOUNDED PRECEDING) AS h FROM s WINDOW w AS (PARTITION BY grp ORDER BY score DESC, vec_id))
SELECT grp, round(sum(CASE WHEN y THEN h / r END) / nullif(sum(y::INT), 0), 6) AS ap FROM r GROUP BY 1""")
def avg_precision(spark, d):
    s = table(spark, d, "embeddings").select("vec_id", (C("label") % 3).alias("grp"), C("embedding")[0].alias("score"), C("embedding")[1].alias("b"))
    return metrics.average_precision(s, ["grp"], "score", C("b") > 0, "vec_id").withColumn("ap", F.round("ap", 6))


@query("""WITH s AS (SELECT label, embedding[1] > 0.1 AS a, embedding[2] > 0.1 AS p FROM embeddings), n AS (SELECT label, count(*) FILTER (a AND p) AS tp, count(*) FILTER (NOT a AND p) AS fp, count(*) FILTER (a AND NOT p) AS fn, count(*) FILTER (NOT a AND NOT p) AS tn FROM s GROUP BY 1)
SELECT *, round(tp / nullif(tp + fp, 0), 6) AS precision, round(tp / nullif(tp + fn, 0), 6) AS recall, round(2 * tp / nullif(2 * tp + fp + fn, 0), 6) AS f1, round(fp / nullif(fp + tn, 0), 6) AS empty_fpr FROM n""")
def presence_prf(spark, d):
    s = table(spark, d, "embeddings")
    p = metrics.presence_scores(s, ["label"], C("embedding")[0] > 0.1, C("embedding")[1] > 0.1)
    return p.withColumns({c: F.round(c, 6) for c in ("precision", "recall", "f1", "empty_fpr")})
