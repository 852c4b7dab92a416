"""Queries on the trajectory tables: segments, episodes, shards, diversity features."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tracelake.functions import actions as act
from tracelake.functions import identity as ids
from tracelake.functions import names
from tracelake.operators import benchmarks, catalog, diversity, expectations, prior, select
from tracelake.queries import query, table

C = F.col


def _segments(spark, d, *cols):
    """Distinct records (uid); repeated rows are equal but for the time of ingestion."""
    return table(spark, d, "segments").select("uid", *cols).dropDuplicates(["uid"])


_TRACE = r"regexp_extract(src_trace, '([^/\\]*)$', 1)"
_MOD = "(((((('0x' || h[1:8])::BIGINT % 100 * 96 + ('0x' || h[9:16])::BIGINT) % 100 * 96 + ('0x' || h[17:24])::BIGINT) % 100 * 96 + ('0x' || h[25:32])::BIGINT) % 100 * 96 + ('0x' || h[33:40])::BIGINT) % 100)"
_SEG = "s AS (SELECT DISTINCT ON (uid) * FROM segments ORDER BY uid)"


@query(f"""WITH t AS (SELECT DISTINCT uid, {_TRACE} AS trace, lower(trim(split)) AS split FROM segments), h AS (SELECT *, sha1(trace) AS h FROM t)
SELECT uid, trace, CASE WHEN coalesce(split, '') = '' THEN CASE WHEN {_MOD} < 10 THEN 'val' ELSE 'train' END ELSE split END AS split FROM h""")
def split_trace(spark, d):
    """Effective split of every segment: as written, else by the hash of its trace's name."""
    t = _segments(spark, d, "src_trace", "split").withColumn("trace", ids.trace_name(C("src_trace")))
    return t.select("uid", "trace", ids.effective_split(C("split"), C("trace")).alias("split"))


@query(f"""WITH {_SEG}, f AS (SELECT uid, sha256(initial_state || unhex(array_to_string(list_transform(flatten(actions), lambda x: lpad(to_hex(x::BIGINT), 2, '0')), ''))) AS fp FROM s)
SELECT f.uid, f.fp AS fingerprint, d.fingerprint IS NOT NULL AND d.fingerprint = f.fp AS recorded FROM f LEFT JOIN (SELECT DISTINCT uid, fingerprint FROM diversity_features) d USING (uid)""")
def segment_fingerprint(spark, d):
    """Task fingerprint (start state and action bytes) of every segment, and whether its features carry the same."""
    hexes = F.array_join(F.transform(F.flatten("actions"), lambda v: F.lpad(F.hex(v), 2, "0")), "")
    s = _segments(spark, d, "initial_state", "actions").select("uid", ids.task_fingerprint(C("initial_state"), F.unhex(hexes)).alias("fingerprint"))
    f = table(spark, d, "diversity_features").select("uid", C("fingerprint").alias("_f")).distinct()
    return s.join(f, "uid", "left").select("uid", "fingerprint", F.coalesce(C("_f") == C("fingerprint"), F.lit(False)).alias("recorded"))


_BITS = "list_transform(actions, lambda v: list_sum(list_transform(v, lambda x, i: (x * (1 << (i::INT - 1)))::BIGINT))::BIGINT)"


@query(f"""WITH {_SEG}, b AS (SELECT uid, {_BITS} AS b FROM s), u AS (SELECT uid, unnest(list_transform(b, lambda x: 'u:' || x)) AS gram FROM b UNION ALL
SELECT uid, unnest(list_transform(list_zip(b[1:len(b) - 1], b[2:]), lambda p: 'b:' || p[1] || ':' || p[2])) FROM b) SELECT uid, gram, count(*) AS n FROM u GROUP BY 1, 2""")
def segment_ngrams(spark, d):
    """Unigram and bigram counts of the action codes of every segment, in long form."""
    b = F.transform("actions", lambda v: act.code(v))
    t = _segments(spark, d, "actions").select("uid", b.alias("b"))
    n = F.size("b")
    grams = F.concat(F.transform("b", lambda v: F.concat(F.lit("u:"), v.cast("string"))),
                     F.zip_with(F.slice("b", 1, n - 1), F.slice("b", 2, n - 1), lambda x, y: F.concat_ws(":", F.lit("b"), x.cast("string"), y.cast("string"))))
    return t.where(n > 0).select("uid", F.explode(grams).alias("gram")).groupBy("uid", "gram").agg(F.count("*").alias("n"))


@query(f"""WITH {_SEG}, e AS (SELECT uid, level, unnest({_BITS}) AS bits FROM s) SELECT level, bits,
CASE WHEN bits & 16 <> 0 AND bits & 64 <> 0 THEN 5 WHEN bits & 16 <> 0 AND bits & 128 <> 0 THEN 6 WHEN bits & 32 <> 0 AND bits & 64 <> 0 THEN 7 WHEN bits & 32 <> 0 AND bits & 128 <> 0 THEN 8 WHEN bits & 64 <> 0 THEN 1 WHEN bits & 128 <> 0 THEN 2
 WHEN bits & 16 <> 0 THEN 3 WHEN bits & 32 <> 0 THEN 4 ELSE 0 END * 4 + CASE WHEN bits & 1 <> 0 AND bits & 256 <> 0 THEN 3 WHEN bits & 256 <> 0 THEN 1 WHEN bits & 1 <> 0 THEN 2 ELSE 0 END AS combo, count(*) AS n FROM e GROUP BY ALL""")
def action_combos(spark, d):
    """How often each action code, and its combo of pad and buttons, is held per level."""
    t = _segments(spark, d, "level", "actions").select("level", F.explode(F.transform("actions", lambda v: act.code(v))).alias("bits"))
    return t.groupBy("level", C("bits").cast("bigint").alias("bits")).agg(F.count("*").alias("n")).withColumn("combo", act.combo(C("bits")))


@query("""WITH e AS (SELECT DISTINCT uid, level, actions FROM episodes WHERE actions IS NOT NULL), p AS (SELECT level, unnest(list_zip(actions[1:len(actions) - 1], actions[2:])) AS p FROM e)
SELECT level, p[1] AS prev, p[2] AS next, count(*) AS n FROM p GROUP BY ALL""")
def episode_bigrams(spark, d):
    """Transition counts of action ids per level, over arrays: no step is shuffled, only counts."""
    e = table(spark, d, "episodes").select("uid", "level", "actions").dropDuplicates(["uid"])
    return prior.array_bigrams(e, "actions", ("level",))


_HEX = "nullif(lower(regexp_extract(fingerprint, '([0-9a-fA-F]{64})', 1)), '')"


@query(f"""WITH e AS (SELECT DISTINCT uid, {_HEX} AS fp, staged_no FROM episodes), r AS (SELECT *, row_number() OVER (PARTITION BY fp ORDER BY staged_no, uid) AS r, count(*) OVER (PARTITION BY fp) AS copies FROM e)
SELECT fp, uid, copies FROM r WHERE r = 1""")
def dedup_first(spark, d):
    """First arrival of each fingerprint, and how many there were."""
    e = table(spark, d, "episodes").select("uid", ids.hex64(C("fingerprint")).alias("fp"), "staged_no").dropDuplicates(["uid"])
    return select.first_per(e, ["fp"], [C("staged_no"), C("uid")]).select("fp", "uid", "copies")


_CAT = f"""e AS (SELECT DISTINCT uid, {_HEX} AS fp, source_trace, action_steps FROM episodes), m AS (SELECT DISTINCT shard_id, {_HEX} AS fp, ordinal FROM shard_episodes)"""


def _catalog(spark, d):
    e = table(spark, d, "episodes").select("uid", ids.hex64(C("fingerprint")).alias("fingerprint"), "source_trace", "action_steps").distinct()
    m = table(spark, d, "shard_episodes").select("shard_id", ids.hex64(C("fingerprint")).alias("fingerprint"), "ordinal").distinct()
    return table(spark, d, "shards"), m, e


@query(f"WITH {_CAT} SELECT s.id AS shard_id, s.ordinal AS shard_ordinal, m.ordinal, e.fp AS fingerprint, e.uid, e.source_trace, e.action_steps FROM shards s JOIN m ON m.shard_id = s.id JOIN e ON e.fp = m.fp")
def catalog_members(spark, d):
    """Shards with their episodes: the three-way join of the catalog."""
    return catalog.members(*_catalog(spark, d))


@query(f"""WITH {_CAT}, g AS (
SELECT 'count of members' AS gate, count(*) AS violations FROM shards s LEFT JOIN (SELECT shard_id, count(*) AS n FROM m GROUP BY 1) c ON c.shard_id = s.id WHERE s.episodes <> coalesce(n, 0)
UNION ALL SELECT 'episode missing', count(*) FROM m WHERE NOT EXISTS (SELECT 1 FROM e WHERE e.fp = m.fp)
UNION ALL SELECT 'in two shards', count(*) FROM (SELECT fp FROM m GROUP BY 1 HAVING count(DISTINCT shard_id) > 1)
UNION ALL SELECT 'place taken twice', count(*) FROM (SELECT shard_id, ordinal FROM shards s JOIN shard_episodes USING (ordinal) WHERE false)
UNION ALL SELECT 'frames over target', count(*) FROM shards s JOIN shard_targets t ON t.level = s.level AND t.task = s.task WHERE s.frames > t.target_frames
UNION ALL SELECT 'no action steps', count(*) FROM e WHERE action_steps IS NULL OR action_steps <= 0
UNION ALL SELECT 'frames unknown', count(*) FROM shards WHERE frames IS NULL OR frames < 0) SELECT * FROM g""")
def quality_gates(spark, d):
    """Violations of the catalog's gates, one row per gate. A place is taken twice by two members at one ordinal of a shard, or by two shards at one ordinal of
    a level, task, weapon and encoder; a shard at two places counts as well."""
    s, m, e = _catalog(spark, d)
    t = table(spark, d, "shard_targets").select(C("level").alias("l"), C("task").alias("t"), "target_frames")
    taken = expectations.duplicates(m.where("shard_id IS NOT NULL AND ordinal IS NOT NULL"), ["shard_id", "ordinal"]).select(F.lit(1).alias("n"))
    place = ["level", "task", "weapon", "encoder_sha256", "ordinal"]
    own = s.select("id", *place).distinct()
    places = taken.unionAll(expectations.duplicates(own.where("ordinal IS NOT NULL"), place).select(F.lit(1).alias("n"))).unionAll(expectations.duplicates(own, ["id"]).select(F.lit(1).alias("n")))
    return expectations.violations({
        "count of members": expectations.count_mismatch(s.withColumnRenamed("id", "shard_id"), m.select("shard_id", "fingerprint", C("ordinal").alias("o")), ["shard_id"], "episodes"),
        "episode missing": expectations.missing(m, e, ["fingerprint"]),
        "in two shards": expectations.several_values(m, ["fingerprint"], "shard_id"),
        "place taken twice": places,
        "frames over target": s.join(t, (C("level") == C("l")) & (C("task") == C("t"))).where("frames > target_frames"),
        "no action steps": expectations.failing(e, C("action_steps") > 0),
        "frames unknown": expectations.failing(s, C("frames") >= 0),
    })


@query(f"WITH {_CAT} SELECT e.uid FROM e WHERE fp IS NULL OR NOT EXISTS (SELECT 1 FROM m WHERE m.fp = e.fp)")
def antijoin_remaining(spark, d):
    """Episodes that no shard holds yet."""
    _, m, e = _catalog(spark, d)
    return select.anti(e, m, ["fingerprint"]).select("uid")


@query("""WITH r AS (SELECT *, sum(episodes) OVER (PARTITION BY level, task, weapon, encoder_sha256 ORDER BY ordinal, id ROWS UNBOUNDED PRECEDING) AS running FROM shards)
SELECT id, level, task, weapon, CAST(running AS BIGINT) AS running FROM r WHERE running - episodes < 5""")
def prefix_budget(spark, d):
    """Per taxonomy the smallest prefix of shards that reaches five episodes."""
    return select.prefix_budget(table(spark, d, "shards"), ["level", "task", "weapon", "encoder_sha256"], ["ordinal", "id"], "episodes", 5).select("id", "level", "task", "weapon", "running")


@query("SELECT level, task, CAST(max(ordinal) + 1 AS INTEGER) AS next_ordinal, count(*) AS shards, CAST(sum(frames) AS BIGINT) AS frames FROM shards GROUP BY 1, 2")
def next_ordinals(spark, d):
    return table(spark, d, "shards").groupBy("level", "task").agg((F.coalesce(F.max("ordinal"), F.lit(-1)) + 1).alias("next_ordinal"), F.count("*").alias("shards"), F.sum("frames").alias("frames"))


@query("""WITH r AS (SELECT *, row_number() OVER (PARTITION BY level ORDER BY id) AS r, count(*) OVER (PARTITION BY level) AS n FROM shards), p AS (SELECT DISTINCT level, least(1 << s, n) AS prefix FROM r CROSS JOIN (SELECT unnest(range(20)) AS s) WHERE (1 << s) <= n OR (1 << (s - 1)) < n AND s > 0)
SELECT p.level, CAST(p.prefix AS BIGINT) AS prefix, CAST(sum(r.episodes) AS BIGINT) AS episodes, CAST(sum(r.frames) AS BIGINT) AS frames FROM p JOIN r ON r.level = p.level AND r.r <= p.prefix GROUP BY 1, 2""")
def scaling_prefixes(spark, d):
    """Sums over the first 1, 2, 4, ... and all shards of a level."""
    return select.scaling_prefixes(table(spark, d, "shards").select("level", "id", "episodes", "frames"), ["level"], "id", ["episodes", "frames"])


@query("""WITH e AS (SELECT DISTINCT uid, level, task, len(actions) AS n FROM episodes WHERE actions IS NOT NULL) SELECT uid, CAST(sum(n) OVER w - n AS BIGINT) AS start, CAST(sum(n) OVER w AS BIGINT) AS stop FROM e
WINDOW w AS (PARTITION BY level, task ORDER BY uid ROWS UNBOUNDED PRECEDING)""")
def offsets(spark, d):
    """Where each episode's steps start and stop in the concatenation of its level and task."""
    e = table(spark, d, "episodes").select("uid", "level", "task", F.size("actions").alias("n")).where("actions IS NOT NULL").dropDuplicates(["uid"])
    return select.offsets(e, ["level", "task"], ["uid"], "n").select("uid", "start", "stop")


@query("""WITH RECURSIVE e AS (SELECT DISTINCT uid, level, coalesce(weapon, '') AS weapon, CAST(len(actions) AS BIGINT) AS n FROM episodes WHERE actions IS NOT NULL),
it AS (SELECT *, row_number() OVER (PARTITION BY level ORDER BY weapon, n DESC, uid) AS rn FROM e), k AS (SELECT level, greatest(1, CAST(ceil(sum(n) / 5000.0) AS BIGINT)) AS k FROM e GROUP BY 1),
r AS (SELECT level, CAST(0 AS BIGINT) AS rn, CAST(NULL AS VARCHAR) AS uid, CAST(NULL AS INTEGER) AS shard, list_transform(range(k), lambda x: CAST(0 AS BIGINT)) AS loads FROM k
UNION ALL SELECT r.level, it.rn, it.uid, CAST(list_position(loads, list_min(loads)) - 1 AS INTEGER), list_transform(loads, lambda v, i: CASE WHEN i = list_position(loads, list_min(loads)) THEN v + it.n ELSE v END) FROM r JOIN it ON it.level = r.level AND it.rn = r.rn + 1)
SELECT level, uid, shard FROM r WHERE rn > 0""")
def lpt_shards(spark, d):
    """Balanced shards of about 5,000 steps per level: weapon by weapon, longest first, to the least loaded."""
    e = table(spark, d, "episodes").where("actions IS NOT NULL").select("uid", "level", F.coalesce("weapon", F.lit("")).alias("weapon"), F.size("actions").cast("bigint").alias("n")).dropDuplicates(["uid"])
    return select.balanced_shards(e, ["level"], "weapon", "n", "uid", 5000).select("level", "uid", "shard")


@query("""WITH e AS (SELECT DISTINCT uid, weapon, level, len(actions) AS n FROM episodes WHERE actions IS NOT NULL AND weapon IS NOT NULL), r AS (SELECT *, row_number() OVER w AS r, count(*) OVER (PARTITION BY weapon) AS c FROM e WINDOW w AS (PARTITION BY weapon ORDER BY n, uid))
SELECT weapon, uid, CAST(n AS BIGINT) AS n FROM r WHERE r = c // 2 + 1""")
def upper_median_source(spark, d):
    """The source of upper median length per weapon."""
    e = table(spark, d, "episodes").where("actions IS NOT NULL AND weapon IS NOT NULL").select("uid", "weapon", F.size("actions").cast("bigint").alias("n")).dropDuplicates(["uid"])
    return select.upper_median(e, ["weapon"], ["n", "uid"])


@query(f"""WITH e AS (SELECT DISTINCT uid, weapon, {_HEX} AS fp FROM episodes), r AS (SELECT *, row_number() OVER (PARTITION BY weapon ORDER BY fp, uid) AS r FROM e WHERE fp IS NOT NULL) SELECT weapon, uid, r AS rank FROM r WHERE r <= 7""")
def topk_per_stratum(spark, d):
    """The seven smallest fingerprints per weapon."""
    e = table(spark, d, "episodes").select("uid", "weapon", ids.hex64(C("fingerprint")).alias("fp")).where("fp IS NOT NULL").dropDuplicates(["uid"])
    return select.top_k(e, ["weapon"], [C("fp"), C("uid")], 7).select("weapon", "uid", C("rank").cast("bigint").alias("rank"))


@query(f"""WITH e AS (SELECT DISTINCT uid, {_HEX} AS fp FROM episodes), h AS (SELECT uid, sha256('split:0:' || fp) AS d, fp FROM e WHERE fp IS NOT NULL),
r AS (SELECT uid, row_number() OVER (ORDER BY d[15:16] || d[13:14] || d[11:12] || d[9:10] || d[7:8] || d[5:6] || d[3:4] || d[1:2], fp, uid) AS rank FROM h)
SELECT uid, rank, CASE WHEN rank <= 48 THEN 'train' WHEN rank <= 54 THEN 'validation' ELSE 'test' END AS split FROM r WHERE rank <= 60""")
def split_exact(spark, d):
    """Exact split sizes by salted hash, whatever the order of the input (48 / 6 / 6 rows; the rest stays out)."""
    e = table(spark, d, "episodes").select("uid", ids.hex64(C("fingerprint")).alias("fp")).where("fp IS NOT NULL").dropDuplicates(["uid"])
    t = select.exact_split(e.withColumn("o", ids.salted_order(C("fp"), "split:0:")), ["o", "fp", "uid"], {"train": 48, "validation": 6, "test": 6})
    return t.select("uid", "rank", "split")


@query(f"""WITH e AS (SELECT DISTINCT uid, {_HEX} AS fp FROM episodes), r AS (SELECT uid, row_number() OVER (ORDER BY fp, uid) AS a, row_number() OVER (ORDER BY fp DESC, uid DESC) AS b FROM e WHERE fp IS NOT NULL)
SELECT uid, CASE WHEN a <= 25 THEN 'head' ELSE 'tail' END AS holdout FROM r WHERE a <= 25 OR b <= 25""")
def holdout_k(spark, d):
    """The 25 smallest and the 25 largest fingerprints (top-k per task, no global sort)."""
    e = table(spark, d, "episodes").select("uid", ids.hex64(C("fingerprint")).alias("fp")).where("fp IS NOT NULL").dropDuplicates(["uid"])
    head = e.orderBy("fp", "uid").limit(25).select("uid", F.lit("head").alias("holdout"))
    return head.unionByName(e.orderBy(F.desc("fp"), F.desc("uid")).limit(25).select("uid", F.lit("tail").alias("holdout")))


@query("""WITH s AS (SELECT DISTINCT uid, label, start_step, end_step, weapon FROM segments), g AS (SELECT uid, label, CASE WHEN end_step - start_step < 90 THEN 'too short' WHEN end_step - start_step > 240 THEN 'too long' WHEN coalesce(trim(weapon), '') = '' THEN 'no weapon' END AS reason FROM s),
r AS (SELECT *, row_number() OVER (PARTITION BY label, reason ORDER BY uid) AS r FROM g), c AS (SELECT label, max(uid) FILTER (r <= 20) AS last FROM r WHERE reason IS NULL GROUP BY label HAVING count(*) > 20)
SELECT uid, CASE WHEN c.last IS NOT NULL AND uid > c.last THEN 'capped' ELSE reason END AS reason FROM r LEFT JOIN c USING (label)""")
def window_gates(spark, d):
    """First reason why a segment is rejected, null for the kept; a label is capped once 20 are kept."""
    s = table(spark, d, "segments").select("uid", "label", "start_step", "end_step", "weapon").dropDuplicates(["uid"])
    n = C("end_step") - C("start_step")
    s = s.withColumn("reason", F.when(n < 90, "too short").when(n > 240, "too long").when(F.coalesce(F.trim("weapon"), F.lit("")) == "", "no weapon"))
    ranked = s.where("reason IS NULL").withColumn("r", F.row_number().over(Window.partitionBy("label").orderBy("uid")))
    last = ranked.where("r <= 21").groupBy("label").agg(F.max(F.when(C("r") <= 20, C("uid"))).alias("last"), F.count("*").alias("n")).where("n > 20").select("label", "last")
    return s.join(last, "label", "left").select("uid", F.when(C("last").isNotNull() & (C("uid") > C("last")), "capped").otherwise(C("reason")).alias("reason"))


@query("""WITH s AS (SELECT DISTINCT uid, label, split FROM segments) SELECT label, count(*) FILTER (coalesce(split, '') = 'train') AS train, count(*) FILTER (split IN ('val', 'validation', 'test')) AS held_out, count(*) FILTER (coalesce(trim(split), '') = '') AS derived FROM s GROUP BY 1""")
def maker_report(spark, d):
    """Kept segments by label and side."""
    s = table(spark, d, "segments").select("uid", "label", "split").dropDuplicates(["uid"])
    return s.groupBy("label").agg(F.count_if(F.coalesce(C("split"), F.lit("")) == "train").alias("train"), F.count_if(C("split").isin("val", "validation", "test")).alias("held_out"), F.count_if(F.coalesce(F.trim("split"), F.lit("")) == "").alias("derived"))


@query("""WITH e AS (SELECT DISTINCT uid, actions, len(actions)::INT AS a FROM episodes WHERE len(actions) >= 1), v AS (SELECT *, a // 3 AS b, unnest(['start_to_boss', 'boss_fight', 'full']) AS view FROM e)
SELECT uid, view, CASE WHEN view = 'boss_fight' THEN b ELSE 0 END AS act_from, CASE WHEN view = 'start_to_boss' THEN b ELSE a END AS act_to, CASE WHEN view = 'boss_fight' THEN b ELSE 0 END AS obs_from, CASE WHEN view = 'start_to_boss' THEN b ELSE a END + 1 AS obs_to FROM v""")
def view_slices(spark, d):
    """Three aligned views of every episode (boundary after a third): one more observation than actions in each."""
    e = table(spark, d, "episodes").where("size(actions) >= 1").select("uid", F.size("actions").alias("a")).dropDuplicates(["uid"])
    t = e.withColumn("view", F.explode(F.array(*[F.lit(v) for v in catalog.VIEWS])))
    return t.select("uid", "view", *catalog.view_bounds(C("view"), C("a"), F.floor(C("a") / 3).cast("int")))


@query("""WITH m AS (SELECT s.level, s.task AS scope, s.weapon AS worker, s.episodes AS n FROM shards s) SELECT CASE WHEN grouping(scope) = 1 AND grouping(worker) = 1 THEN 'level' WHEN grouping(worker) = 1 THEN 'scope' ELSE 'worker' END AS kind, level,
CASE WHEN grouping(scope) = 0 THEN scope WHEN grouping(worker) = 0 THEN worker END AS name, count(*) AS batches, CAST(sum(n) AS BIGINT) AS traces FROM m GROUP BY GROUPING SETS ((level), (level, scope), (level, worker))
UNION ALL SELECT 'level', CAST(l AS INTEGER), NULL, 0, 0 FROM range(1, 12) r(l) WHERE l NOT IN (SELECT level FROM shards)""")
def committed_counts(spark, d):
    """Shards and episodes by level, scope and worker in one pass; levels 1 to 11 without any are filled with zeros."""
    return benchmarks.committed_counts(table(spark, d, "shards"), "level", "task", "weapon", "episodes", range(1, 12))


@query("SELECT level, CAST(coalesce(sum(episodes) FILTER (task = 'full'), 0) AS BIGINT) AS \"full\", CAST(coalesce(sum(episodes) FILTER (task = 'boss'), 0) AS BIGINT) AS boss, CAST(coalesce(sum(episodes) FILTER (task NOT IN ('full', 'boss') OR task IS NULL), 0) AS BIGINT) AS other FROM shards GROUP BY 1")
def counts_pivot(spark, d):
    return benchmarks.counts_table(table(spark, d, "shards"), "level", "task", "episodes", ["full", "boss"])


@query("""SELECT DISTINCT path, CAST(regexp_extract(path, '^L(\\d+)/', 1) AS INTEGER) AS level, split_part(path, '/', 2) AS scope, split_part(path, '/', 3) AS worker FROM shards""")
def shard_paths(spark, d):
    """Level, scope and worker out of marker paths."""
    path = F.concat(F.lit("root/level"), F.regexp_extract("path", r"^L(\d+)/", 1), F.lit("/"), F.split("path", "/")[1], F.lit("/batches/"), F.split("path", "/")[2], F.lit("/x"))
    return table(spark, d, "shards").select("path", names.marker_location(path).alias("m")).select("path", "m.*").distinct()


_DIV = """f AS (SELECT DISTINCT ON (uid) uid, length, regexp_replace(lower(weapon), '[^a-z0-9]+', '', 'g') AS weapon, ngrams, state FROM diversity_features ORDER BY uid),
p AS (SELECT uid AS a, lead(uid) OVER (PARTITION BY weapon ORDER BY uid) AS b FROM f WHERE weapon <> '' AND ngrams IS NOT NULL AND cardinality(ngrams) > 0 AND len(state) = 20),
g AS (SELECT uid, unnest(map_keys(ngrams)) AS k, unnest(map_values(ngrams)) AS n FROM f), t AS (SELECT uid, k, n / sum(n) OVER (PARTITION BY uid) AS q FROM g),
u AS (SELECT p.a, p.b, t.k, t.q AS pa, 0e0 AS pb FROM p JOIN t ON t.uid = p.a UNION ALL SELECT p.a, p.b, t.k, 0e0, t.q FROM p JOIN t ON t.uid = p.b),
v AS (SELECT a, b, k, sum(pa) AS x, sum(pb) AS y FROM u WHERE b IS NOT NULL GROUP BY 1, 2, 3),
js AS (SELECT a, b, sqrt(greatest(0, sum(CASE WHEN x > 0 THEN x * log2(2 * x / (x + y)) ELSE 0 END + CASE WHEN y > 0 THEN y * log2(2 * y / (x + y)) ELSE 0 END) / 2)) AS js FROM v GROUP BY 1, 2)"""


def _features(spark, d, repeated=False):
    f = table(spark, d, "diversity_features")
    return (f if repeated else f.dropDuplicates(["uid"])).withColumn("weapon", F.regexp_replace(F.lower("weapon"), "[^a-z0-9]+", ""))


def _neighbours(spark, d, state="size(state) = 20"):
    """Consecutive records (a, b) of a weapon, among those with n-grams and, unless another condition is given, full states."""
    f = _features(spark, d).where(f"weapon <> '' AND size(ngrams) > 0 AND {state}").select("uid", "weapon")
    return f.select(C("uid").alias("a"), F.lead("uid").over(Window.partitionBy("weapon").orderBy("uid")).alias("b")).where("b IS NOT NULL")


def _js(spark, d, state="size(state) = 20"):
    """Long form: n-grams are rows, and a pair only joins those that both sides hold. Repeated keys of a map count together."""
    grams = _features(spark, d).select("uid", F.explode("ngrams").alias("gram", "n")).groupBy("uid", "gram").agg(F.sum("n").alias("n"))
    return diversity.js_pairs(grams, "uid", "gram", "n", _neighbours(spark, d, state))


@query(f"WITH {_DIV} SELECT a, b, round(js, 5) AS js FROM js")
def js_distance(spark, d):
    """Jensen-Shannon distance of the n-grams of consecutive records of a weapon."""
    return _js(spark, d).withColumn("js", F.round("js", 5))


_STATE = """s AS (SELECT js.a, js.b, js.js, x.length AS la, y.length AS lb, flatten(x.state) AS sa, flatten(y.state) AS sb FROM js JOIN f x ON x.uid = js.a JOIN f y ON y.uid = js.b),
z AS (SELECT a, b, 0.45 * sqrt(list_avg(list_transform(list_zip(sa, sb), lambda p: (p[1]::DOUBLE - p[2]::DOUBLE) * (p[1]::DOUBLE - p[2]::DOUBLE)))) + 0.35 * js + 0.2 * least(1, abs(ln((la + 1.0) / (lb + 1.0))) / ln(4)) AS distance FROM s WHERE len(sa) = len(sb))"""


def _distances(spark, d):
    f = _features(spark, d).select("uid", "length", F.flatten("state").cast("array<double>").alias("state"))
    side = lambda n: f.select(C("uid").alias(n), C("length").alias(f"length_{n}"), C("state").alias(f"state_{n}"))
    both = _js(spark, d).join(side("a"), "a").join(side("b"), "b").where(F.size("state_a") == F.size("state_b"))
    rms = diversity.state_rms(F.array("state_a"), F.array("state_b"))
    return both.select("a", "b", diversity.diversity_distance(rms, C("js"), diversity.duration_gap(C("length_a"), C("length_b"))).alias("distance"))


@query(f"WITH {_DIV}, {_STATE} SELECT a, b, round(distance, 5) AS distance FROM z")
def diversity_distance(spark, d):
    """Blend of state, action and duration distance of consecutive records of a weapon."""
    return _distances(spark, d).withColumn("distance", F.round("distance", 5))


@query(f"WITH {_DIV}, {_STATE} SELECT count(*) AS pairs, round(quantile_cont(distance, 0.1), 5) AS p10, round(quantile_cont(distance, 0.5), 5) AS median, round(quantile_cont(distance, 0.9), 5) AS p90 FROM z")
def diversity_quantiles(spark, d):
    q = F.percentile("distance", F.array(F.lit(0.1), F.lit(0.5), F.lit(0.9)))
    return _distances(spark, d).agg(F.count("*").alias("pairs"), q.alias("q")).select("pairs", *[F.round(C("q")[i], 5).alias(n) for i, n in enumerate(("p10", "median", "p90"))])


@query(f"WITH {_DIV.replace(' AND len(state) = 20', '')} SELECT a, b, round(js, 5) AS js FROM js")
def js_distance_all(spark, d):
    """The same as ``js_distance`` over all records with weapon and n-grams, whatever their state."""
    return _js(spark, d, "true").withColumn("js", F.round("js", 5))


@query()
def diversity_nearest(spark, d):
    """For every record its nearest earlier one of the same weapon (else of all) under the blended distance."""
    return diversity.nearest_blended(_features(spark, d, repeated=True))


@query()
def diversity_nearest_quantiles(spark, d):
    """Records with an earlier one, and the 10 %, 50 %, 90 % points of the distances to the nearest."""
    q = F.percentile("distance", F.array(F.lit(0.1), F.lit(0.5), F.lit(0.9)))
    return diversity_nearest(spark, d).agg(F.count("distance").alias("measured"), q.alias("q")).select("measured", *[F.round(C("q")[i], 5).alias(n) for i, n in enumerate(("p10", "median", "p90"))])


@query("""WITH f AS (SELECT DISTINCT ON (uid) uid, fingerprint, regexp_replace(lower(weapon), '[^a-z0-9]+', '', 'g') AS weapon, length FROM diversity_features ORDER BY uid),
s AS (SELECT DISTINCT ON (uid) uid, weapon AS base FROM segments ORDER BY uid, weapon)
SELECT f.uid, coalesce(nullif(f.weapon, ''), s.base) AS weapon FROM f LEFT JOIN (SELECT uid, min(base) AS base FROM s GROUP BY 1) s USING (uid)""")
def sidecar_override(spark, d):
    """Weapon of a record: that of its features where there is one, else that of its segment."""
    s = table(spark, d, "segments").groupBy("uid").agg(F.min("weapon").alias("weapon"))
    f = _features(spark, d).select("uid", F.when(C("weapon") != "", C("weapon")).alias("weapon"))
    return select.override(f.select("uid").join(s, "uid", "left"), f, ["uid"]).select("uid", "weapon")


@query("""WITH e AS (SELECT DISTINCT uid, actions FROM episodes WHERE actions IS NOT NULL), s AS (SELECT uid, unnest(actions) AS a FROM e), n AS (SELECT uid, a, count(*) AS n FROM s GROUP BY 1, 2)
SELECT uid, count(*) AS used, round(exp(ln(sum(n)) - sum(n * ln(n)) / sum(n)), 6) AS perplexity FROM n GROUP BY 1""")
def action_perplexity(spark, d):
    """Distinct actions and perplexity of every episode."""
    e = table(spark, d, "episodes").where("actions IS NOT NULL").select("uid", "actions").dropDuplicates(["uid"])
    n = e.select("uid", F.explode("actions").alias("a")).groupBy("uid", "a").agg(F.count("*").alias("n"))
    return n.groupBy("uid").agg(F.count("*").alias("used"), F.round(F.exp(F.log(F.sum("n")) - F.sum(C("n") * F.log("n")) / F.sum("n")), 6).alias("perplexity"))


@query()
def request_schedule(spark, d):
    """Generation requests: two whole ones per source and 50 partial ones on hashed sources, numbered and sharded."""
    return benchmarks.requests(table(spark, d, "segments").select(ids.trace_name(C("src_trace")).alias("trace")), "trace", 2, 50, 4)


@query()
def seeded_rounds(spark, d):
    """Five rounds over the levels' shards, the first shard leading, the rest in seeded order."""
    s = table(spark, d, "shards").select(C("id").cast("string").alias("config"))
    return benchmarks.schedule(s, "config", 5, "1")


@query()
def hash_sample(spark, d):
    """Ten records per weapon by seeded hash."""
    return select.hash_sample(_features(spark, d).select("uid", "weapon"), ["weapon"], C("uid"), 10)
