"""Sequence operators, bound to the events table (trace: user_id; step: event_id, which follows ts)."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tracelake.operators import benchmarks, prior, reward, select, sequence  # noqa: F401
from tracelake.queries import query, table

KEY, ORDER = ["user_id"], ["ts", "event_id"]
C = F.col
W = "PARTITION BY user_id ORDER BY ts, event_id"
TYPES = ("click", "error", "purchase", "signup", "view")


def _k():
    return F.get_json_object("props", "$.k").cast("bigint")


@query(f"""SELECT user_id, event_id FROM (SELECT *, lag(event_type) OVER ({W}) AS p FROM events)
WHERE event_type = 'purchase' AND p IS NOT NULL AND p <> 'purchase'""")
def edge_rising(spark, d):
    """First event of each run of purchases (a rising edge needs a predecessor)."""
    return sequence.rising(table(spark, d, "events"), KEY, ORDER, C("event_type") == "purchase").where("edge").select("user_id", "event_id")


@query("""WITH s AS (SELECT *, min(CASE WHEN event_type = 'error' THEN event_id END) OVER (PARTITION BY user_id) AS b FROM events)
SELECT user_id, min(b) AS start_step, min(CASE WHEN event_type = 'purchase' AND event_id > b THEN event_id END) AS end_step FROM s GROUP BY user_id""")
def edge_first_and_after(spark, d):
    return sequence.first_and_after(table(spark, d, "events"), KEY, "event_id", C("event_type") == "error", C("event_type") == "purchase")


def _log(spark, d):
    e = sequence.paired(table(spark, d, "events"), KEY, ORDER, ["event_type", "value"])
    tags = {"buy": F.when((C("event_type") == "purchase") & (C("pre_event_type") != "purchase"), 1.0), "fail": F.when(C("event_type") == "error", 1.0),
            "jump": F.when(C("value") - C("pre_value") > 20, C("value") - C("pre_value")), "same": F.when(C("event_type") == C("pre_event_type"), 1.0)}
    rows = F.array(*[F.struct(F.lit(t).alias("tag"), v.alias("value")) for t, v in tags.items()])
    return e.select("user_id", "event_id", F.inline(F.filter(rows, lambda r: F.coalesce(r["value"], F.lit(0.0)) != 0)))


_LOG = f"""WITH p AS (SELECT *, lag(event_type) OVER ({W}) AS pt, lag(value) OVER ({W}) AS pv FROM events),
l AS (SELECT user_id, event_id, 'buy' AS tag, 1e0 AS value FROM p WHERE event_type = 'purchase' AND pt <> 'purchase'
UNION ALL SELECT user_id, event_id, 'fail', 1e0 FROM p WHERE event_type = 'error'
UNION ALL SELECT user_id, event_id, 'jump', value - pv FROM p WHERE value - pv > 20
UNION ALL SELECT user_id, event_id, 'same', 1e0 FROM p WHERE event_type = pt) """


@query(_LOG + "SELECT user_id, event_id, tag, round(value, 6) AS value FROM l")
def event_log_long(spark, d):
    """Long log of four detectors over consecutive pairs."""
    return _log(spark, d).withColumn("value", F.round("value", 6))


@query(_LOG + ", n AS (SELECT tag, count(*) AS n, min(event_id) AS f FROM l GROUP BY tag) SELECT tag, n, row_number() OVER (ORDER BY n DESC, f) AS rank FROM n")
def event_summary(spark, d):
    return sequence.tag_summary(_log(spark, d), "tag", ["event_id"]).withColumn("rank", C("rank").cast("bigint"))


@query("""SELECT user_id, CASE WHEN bool_or(event_type = 'signup') THEN 'joined' WHEN bool_or(event_type IN ('purchase', 'click')) THEN 'active' ELSE 'idle' END AS outcome FROM events GROUP BY user_id""")
def outcome_rollup(spark, d):
    return sequence.outcome(table(spark, d, "events"), KEY, "event_type", {"joined": ["signup"], "active": ["purchase", "click"]}, "idle")


@query(f"""SELECT user_id, event_id, round(greatest(x + CASE WHEN x < -100 THEN 240 ELSE 0 END, 0), 6) AS moved FROM
(SELECT user_id, event_id, value - lag(value) OVER ({W}) AS x FROM events) WHERE x IS NOT NULL""")
def signal_delta_clamped(spark, d):
    p = sequence.paired(table(spark, d, "events"), KEY, ORDER, ["value"]).where("pre_value IS NOT NULL")
    return p.select("user_id", "event_id", F.round(sequence.wrapped_delta(C("pre_value"), C("value")), 6).alias("moved"))


@query(f"""SELECT user_id, event_id, round(sum(CASE event_type WHEN 'purchase' THEN 10e0 WHEN 'error' THEN -15e0 ELSE 0.1e0 * value END) OVER ({W} ROWS UNBOUNDED PRECEDING), 4) AS total FROM events""")
def cum_reward(spark, d):
    v = F.when(C("event_type") == "purchase", 10.0).when(C("event_type") == "error", -15.0).otherwise(0.1 * C("value"))
    return sequence.running_sum(table(spark, d, "events"), KEY, ORDER, v, "total").select("user_id", "event_id", F.round("total", 4).alias("total"))


@query(f"""SELECT user_id, event_id FROM (SELECT *, max(CASE WHEN event_type = 'signup' THEN 1 ELSE 0 END) OVER ({W} ROWS UNBOUNDED PRECEDING) AS s FROM events) WHERE s = 0""")
def running_max_guard(spark, d):
    return sequence.before_first(table(spark, d, "events"), KEY, ORDER, C("event_type") == "signup").select("user_id", "event_id")


def _slots(spark, d):
    return table(spark, d, "events").select("user_id", "event_id", F.pmod(_k(), F.lit(4)).alias("slot"), "event_type", F.floor("value").alias("v"))


_SLOTS = "s AS (SELECT user_id, event_id, CAST(json_extract(props, '$.k') AS BIGINT) % 4 AS slot, event_type, CAST(floor(value) AS BIGINT) AS v FROM events), "


@query("WITH " + _SLOTS + """
a AS (SELECT *, v % 3 AS hp, v % 5 <> 0 AS act FROM s),
p AS (SELECT *, lag(event_type) OVER w AS pk, coalesce(lag(hp) OVER w, 0) AS php, coalesce(lag(act) OVER w, false) AS was FROM a WINDOW w AS (PARTITION BY user_id, slot ORDER BY event_id)),
e AS (SELECT *, CASE WHEN was AND php > 0 AND hp = 0 THEN 'K' WHEN act AND (NOT was OR event_type <> pk) THEN 'S' WHEN NOT act THEN 'G' END AS ev FROM p),
l AS (SELECT *, last_value(CASE WHEN ev IS NOT NULL THEN {'e': ev, 'at': event_id} END IGNORE NULLS) OVER (PARTITION BY user_id, slot ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS b FROM e)
SELECT user_id, slot, b.at AS spawn_step, event_id AS kill_step, pk AS kind FROM l WHERE ev = 'K' AND b.e = 'S'""")
def slot_lifecycle(spark, d):
    """Spawn and kill of each slot; hp is v % 3, a slot is active where v % 5 is not 0."""
    return sequence.slot_lifecycle(_slots(spark, d), ["user_id", "slot"], "event_id", C("event_type"), F.pmod("v", F.lit(3)), F.pmod("v", F.lit(5)) != 0)


@query("WITH " + _SLOTS + """
a AS (SELECT *, v % 4 <> 0 AS act, event_type IN ('click', 'error') AND v % 4 <> 0 AS item FROM s),
p AS (SELECT *, lag(act) OVER w AS pact, coalesce(lag(item) OVER w, false) AS pitem FROM a WINDOW w AS (PARTITION BY user_id, slot ORDER BY event_id)),
o AS (SELECT *, CASE WHEN act AND (pact IS NULL OR NOT pact OR (pitem AND NOT item)) THEN event_id END AS o, item AND NOT pitem AS birth FROM p),
c AS (SELECT *, count(o) OVER (PARTITION BY user_id, slot ORDER BY event_id ROWS UNBOUNDED PRECEDING) AS occ FROM o),
k AS (SELECT *, last_value(CASE WHEN act AND NOT item THEN v % 50 END IGNORE NULLS) OVER (PARTITION BY user_id, slot, occ ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS car FROM c),
b AS (SELECT *, last_value(CASE WHEN birth THEN {'at': event_id, 'attr': v & 7, 'car': coalesce(car, 0)} END IGNORE NULLS) OVER w AS lb, last_value(o IGNORE NULLS) OVER w AS lo FROM k
  WINDOW w AS (PARTITION BY user_id, slot ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))
SELECT user_id, slot, lo AS origin_step, lb.at AS birth_step, event_id AS removal_step, lb.car AS carrier, lb.attr AS attr,
 CASE WHEN event_type = 'purchase' THEN 'pick' WHEN lb.attr IN (1, 2, 3, 4) AND lb.attr <> v % 5 AND v % 5 IN (1, 2, 3, 4) THEN 'avoid' END AS outcome
FROM b WHERE pitem AND NOT item AND lb IS NOT NULL""")
def item_lifecycle(spark, d):
    """Birth and removal of items, picked or avoided; the held gun is v % 5 at the removal."""
    s = _slots(spark, d).withColumns({"kind": F.pmod("v", F.lit(50)), "active": F.pmod("v", F.lit(4)) != 0})
    s = s.withColumn("item", C("event_type").isin("click", "error") & C("active"))
    got = sequence.item_lifecycle(s, ["user_id", "slot"], "event_id", C("kind"), C("active"), C("item"), C("v"))
    at = s.select("user_id", C("event_id").alias("removal_step"), "event_type", F.pmod("v", F.lit(5)).alias("gun"))
    return sequence.pick_or_avoid(got.join(at, ["user_id", "removal_step"]), C("event_type") == "purchase", C("attr"), C("gun")).drop("event_type", "gun")


@query("""WITH RECURSIVE n AS (SELECT a.user_id, a.event_id, min(b.event_id) AS nx FROM events a JOIN events b ON a.user_id = b.user_id AND b.event_id > a.event_id + 300 GROUP BY 1, 2),
c AS (SELECT user_id, min(event_id) AS event_id FROM events GROUP BY user_id UNION ALL SELECT c.user_id, n.nx FROM c JOIN n ON n.user_id = c.user_id AND n.event_id = c.event_id)
SELECT user_id, event_id FROM c""")
def anchor_chain(spark, d):
    """Greedy anchors more than 300 steps apart."""
    return sequence.anchor_chain(table(spark, d, "events"), KEY, "event_id", 300).select("user_id", F.explode("anchors").alias("event_id"))


@query("""WITH RECURSIVE n AS (SELECT a.user_id, a.event_id, min(b.event_id) AS nx FROM events a JOIN events b ON a.user_id = b.user_id AND b.event_id > a.event_id + 300 GROUP BY 1, 2),
c AS (SELECT user_id, min(event_id) AS event_id FROM events GROUP BY user_id UNION ALL SELECT c.user_id, n.nx FROM c JOIN n ON n.user_id = c.user_id AND n.event_id = c.event_id)
SELECT * FROM (SELECT user_id, event_id AS from_step, lead(event_id) OVER (PARTITION BY user_id ORDER BY event_id) AS to_step FROM c) WHERE to_step IS NOT NULL""")
def anchor_pairs(spark, d):
    return sequence.chain_pairs(sequence.anchor_chain(table(spark, d, "events"), KEY, "event_id", 300), KEY)


@query("""WITH RECURSIVE n AS (SELECT a.user_id, a.event_id, min(b.event_id) AS nx FROM events a JOIN events b ON a.user_id = b.user_id AND b.event_id > a.event_id + 700 GROUP BY 1, 2),
c AS (SELECT user_id, min(event_id) AS event_id FROM events GROUP BY user_id UNION ALL SELECT c.user_id, n.nx FROM c JOIN n ON n.user_id = c.user_id AND n.event_id = c.event_id)
SELECT user_id, event_id FROM c""")
def anchor_chain_streamed(spark, d):
    """The same greedy over sequences of any length: rows stream in order, one value of state."""
    return sequence.anchor_chain_long(table(spark, d, "events"), KEY, "event_id", 700)


@query(f"""WITH g AS (SELECT *, row_number() OVER ({W}) - row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS k FROM events)
SELECT user_id, event_type, min(event_id) AS first_step, count(*) AS steps FROM g GROUP BY user_id, event_type, k""")
def islands_runs(spark, d):
    t = sequence.islands(table(spark, d, "events"), KEY, ORDER, C("event_type"))
    return t.groupBy("user_id", "island").agg(F.first("event_type").alias("event_type"), F.min("event_id").alias("first_step"), F.count("*").alias("steps")).drop("island")


@query(f"""WITH g AS (SELECT *, row_number() OVER ({W}) - row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS k FROM events),
q AS (SELECT *, (row_number() OVER (PARTITION BY user_id, event_type, k ORDER BY ts, event_id) - 1) // 2 AS piece FROM g)
SELECT user_id, event_type, min(event_id) AS first_step, count(*) AS steps FROM q GROUP BY user_id, event_type, k, piece""")
def surface_pieces(spark, d):
    """Runs cut into pieces of at most two."""
    t = sequence.pieces(sequence.islands(table(spark, d, "events"), KEY, ORDER, C("event_type")), KEY, ORDER, 2)
    return t.groupBy("user_id", "island", "piece").agg(F.first("event_type").alias("event_type"), F.min("event_id").alias("first_step"), F.count("*").alias("steps")).drop("island", "piece")


@query("""SELECT a.user_id, a.event_id, arg_min(b.event_id, {'d': abs(b.event_id - a.event_id), 'at': b.event_id}) AS match_at FROM events a JOIN events b
ON a.user_id = b.user_id AND b.event_type = 'error' AND abs(b.event_id - a.event_id) <= 400 WHERE a.event_type = 'purchase' GROUP BY 1, 2""")
def nearest_tolerance(spark, d):
    """Nearest error of the same user within 400 steps of each purchase, the earlier on ties."""
    e = table(spark, d, "events").select("user_id", "event_id", "event_type")
    left = e.where("event_type = 'purchase'").drop("event_type")
    return sequence.nearest_within(left, e.where("event_type = 'error'"), KEY, "event_id", "event_id", 400, "event_type").select("user_id", "event_id", C("match_at").cast("bigint").alias("match_at"))


@query("SELECT user_id, arg_max(event_id, {'v': value, 'e': -event_id}) AS frame, max(value) AS amount FROM events GROUP BY user_id")
def goal_frame(spark, d):
    return sequence.goal_frame(table(spark, d, "events"), KEY, "event_id", C("value"))


@query("SELECT e.user_id, e.event_id FROM events e JOIN (SELECT user_id, min(event_id) AS b FROM events WHERE event_type = 'error' GROUP BY 1) f USING (user_id) WHERE e.event_id >= b AND (e.event_id - b) % 8 = 0")
def every_nth_after(spark, d):
    e = table(spark, d, "events")
    b = e.where("event_type = 'error'").groupBy("user_id").agg(F.min("event_id").alias("b"))
    return sequence.every_nth(e.join(b, "user_id"), C("event_id"), C("b"), 8).select("user_id", "event_id")


_BI = f"b AS (SELECT event_type AS prev, lead(event_type) OVER ({W}) AS next FROM events), n AS (SELECT prev, next, count(*) AS n FROM b WHERE next IS NOT NULL GROUP BY 1, 2)"


@query(f"WITH {_BI} SELECT * FROM n")
def bigram_counts(spark, d):
    return prior.bigrams(table(spark, d, "events"), KEY, ORDER, "event_type")


_PRIOR = _BI + ", a AS (SELECT DISTINCT event_type AS x FROM events), g AS (SELECT p.x AS prev, q.x AS next, coalesce(n.n, 0) AS n FROM a p CROSS JOIN a q LEFT JOIN n ON n.prev = p.x AND n.next = q.x), r AS (SELECT prev, next, n, 0.9e0 * n / sum(n) OVER (PARTITION BY prev) + 0.1e0 / count(*) OVER (PARTITION BY prev) AS p FROM g)"


@query(f"WITH {_PRIOR} SELECT prev, next, n, round(p, 6) AS p FROM r")
def bigram_prior(spark, d):
    """Dense row-stochastic prior, blended with a tenth of uniform."""
    e = table(spark, d, "events")
    return prior.prior(prior.bigrams(e, KEY, ORDER, "event_type"), e.select("event_type").distinct(), 0.1).withColumn("p", F.round("p", 6))


@query("SELECT event_type AS action, count(*) AS n, round(count(*) / sum(count(*)) OVER (), 6) AS p FROM events GROUP BY 1")
def unigram_marginal(spark, d):
    return prior.unigrams(table(spark, d, "events"), "event_type").withColumn("p", F.round("p", 6))


@query(f"""WITH {_PRIOR}, s AS (SELECT e.event_id, e.event_type AS prev, (e.event_id % 97) / 97e0 AS draw FROM events e),
m AS (SELECT s.event_id, s.draw, r.next, CASE WHEN (s.event_id + length(r.next)) % 3 <> 0 THEN r.p ELSE 0e0 END AS p FROM s JOIN r USING (prev)),
c AS (SELECT *, sum(p) OVER (PARTITION BY event_id ORDER BY next ROWS UNBOUNDED PRECEDING) AS c, sum(p) OVER (PARTITION BY event_id) AS t FROM m)
SELECT event_id, min(next) AS next FROM c WHERE p > 0 AND c >= draw * t GROUP BY event_id""")
def masked_sample(spark, d):
    """The action that a fixed draw picks from the masked prior row of each event."""
    e = table(spark, d, "events")
    p = prior.prior(prior.bigrams(e, KEY, ORDER, "event_type"), e.select("event_type").distinct(), 0.1)
    m = e.select("event_id", C("event_type").alias("prev")).join(p, "prev")
    return prior.sampled(m, ["event_id"], "next", C("p"), (C("event_id") + F.length("next")) % 3 != 0, (C("event_id") % 97) / 97)


@query(f"""WITH p AS (SELECT *, lag(value) OVER ({W}) AS pv, row_number() OVER ({W}) - 1 AS idx, count(*) OVER (PARTITION BY user_id) AS n FROM events),
g AS (SELECT user_id, idx, n, sum(CAST(greatest(floor(pv - value), 0) AS BIGINT)) OVER (PARTITION BY user_id ORDER BY idx ROWS UNBOUNDED PRECEDING) AS run, sum(CAST(greatest(floor(pv - value), 0) AS BIGINT)) OVER (PARTITION BY user_id) AS total FROM p),
b AS (SELECT unnest(range(20)) AS bin), u AS (SELECT DISTINCT user_id, n FROM g)
SELECT u.user_id, b.bin, coalesce(min(g.idx), min(u.n) - 1) AS idx FROM u CROSS JOIN b LEFT JOIN g ON g.user_id = u.user_id AND coalesce(g.run, 0) * 19 >= b.bin * greatest(g.total, 1) GROUP BY 1, 2""")
def state_signature(spark, d):
    """Progress-aligned row of each of 20 bins; damage is the fall of the value, in whole units."""
    p = sequence.paired(table(spark, d, "events"), KEY, ORDER, ["value"])
    damage = F.coalesce(F.floor(C("pre_value") - C("value")), F.lit(0))
    return sequence.state_signature(p, KEY, "event_id", damage, []).select("user_id", "bin", "idx")


@query("SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events")
def json_payload(spark, d):
    return table(spark, d, "events").select("event_id", _k().alias("k"))


@query("""WITH g AS (SELECT event_type AS arm, user_id % 10 AS episode, avg(value) AS v FROM events WHERE event_type IN ('view', 'click') GROUP BY 1, 2),
p AS (SELECT a.episode, a.v - b.v AS d FROM g a JOIN g b ON a.episode = b.episode AND a.arm = 'view' AND b.arm = 'click')
SELECT count(*) AS pairs, round(avg(d), 6) AS gap, round(coalesce(stddev_samp(d), 0), 6) AS sd FROM p""")
def paired_gap(spark, d):
    from tracelake.operators.metrics import paired_gap as gap

    e = table(spark, d, "events").withColumn("episode", C("user_id") % 10).withColumn("all", F.lit(1))
    return gap(e, ["all"], ["episode"], "event_type", "view", "click", "value").select("pairs", F.round("gap", 6).alias("gap"), F.round("sd", 6).alias("sd"))


_TP = """SELECT event_type AS config, count(*) AS attempts, count(*) FILTER (k % 2 = 0) AS wins, count(*) FILTER (k % 2 = 0 AND k % 3 = 0) AS valid, count(*) FILTER (NOT (k % 2 = 0 AND k % 3 = 0)) AS failures,
count(*) FILTER (k % 6 = 0) - count(DISTINCT CASE WHEN k % 6 = 0 THEN k END) AS duplicates, round(sum(value), 4) AS wall_s, round(3600e0 * count(*) FILTER (k % 6 = 0) / sum(value), 6) AS wins_per_hour,
round(avg(CASE WHEN k % 6 = 0 THEN value END), 6) AS mean_s, round(quantile_cont(CASE WHEN k % 6 = 0 THEN value END, 0.9), 6) AS p90_s
FROM (SELECT *, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events) GROUP BY 1"""


def _throughput(spark, d):
    e = table(spark, d, "events").withColumn("k", _k())
    return benchmarks.throughput(e.withColumnRenamed("event_type", "config"), ["config"], C("k") % 2 == 0, C("k") % 3 == 0, "value", "k")


def _rounded(t):
    return t.withColumns({"wall_s": F.round("wall_s", 4), **{c: F.round(c, 6) for c in ("wins_per_hour", "mean_s", "p90_s")}})


@query(_TP)
def throughput_summary(spark, d):
    """Valid wins per hour with the failed attempts' time charged."""
    return _rounded(_throughput(spark, d))


@query(f"""WITH t AS ({_TP}), a(arm, place) AS (VALUES ('error', 0), ('absent', 1), ('view', 2))
SELECT arm, CAST(place AS INTEGER) AS place, coalesce(attempts, 0) AS attempts, coalesce(valid, 0) AS valid, wins_per_hour FROM a LEFT JOIN t ON t.config = a.arm""")
def throughput_by_arm(spark, d):
    """Declared arms only, those without attempts with zeros."""
    t = _rounded(_throughput(spark, d)).withColumnRenamed("config", "arm")
    return benchmarks.by_declared_arm(t, "arm", ["error", "absent", "view"], unseen=False, zeros=["attempts", "valid"]).select("arm", "place", "attempts", "valid", "wins_per_hour")


@query(f"""WITH t AS (SELECT config, CASE WHEN config = 'signup' THEN 1 ELSE 0 END AS failures, wins_per_hour FROM ({_TP})),
b AS (SELECT config, row_number() OVER (ORDER BY wins_per_hour DESC, config) AS place FROM t WHERE failures = 0 AND config <> 'error') SELECT config, place FROM b WHERE place <= 2 UNION ALL SELECT 'error', 3""")
def confirm_topk(spark, d):
    """The two best configurations without failures, the baseline last."""
    t = _throughput(spark, d).withColumn("failures", F.when(C("config") == "signup", 1).otherwise(0))
    return benchmarks.confirmation(t, "config", "error", 2).select("config", C("place").cast("bigint").alias("place"))


@query("SELECT CAST(r AS INTEGER) AS rollouts, CAST(l AS INTEGER) AS length, CAST(s AS INTEGER) AS settle FROM (VALUES (16), (32), (64)) a(r) CROSS JOIN (VALUES (24), (36), (48)) b(l) CROSS JOIN (VALUES (8), (12), (16)) c(s)")
def grid_configs(spark, d):
    return benchmarks.grid(spark, {"rollouts": [16, 32, 64], "length": [24, 36, 48], "settle": [8, 12, 16]})


@query("""WITH e AS (SELECT min(value) AS a, max(value) AS b FROM events), k AS (SELECT greatest(1, CAST(ceil((b - a) / 1) AS BIGINT)) AS bins, a FROM e),
h AS (SELECT least(CAST(floor((value - a) / 1) AS BIGINT), bins - 1) AS bin, count(*) AS n FROM events CROSS JOIN k GROUP BY 1),
g AS (SELECT unnest(range(bins)) AS bin FROM k)
SELECT g.bin, coalesce(h.n, 0) AS n FROM g LEFT JOIN h USING (bin) WHERE coalesce(h.n, 0) < 0.03e0 * (SELECT max(n) FROM h)""")
def histogram_gaps(spark, d):
    return benchmarks.histogram_gaps(table(spark, d, "events"), "value", 1.0)


@query("SELECT CAST(floor(value / 10) AS BIGINT) AS cx, CAST(floor(CAST(json_extract(props, '$.k') AS BIGINT) / 10) AS BIGINT) AS cy, count(*) AS n FROM events GROUP BY 1, 2")
def density_grid(spark, d):
    return benchmarks.density(table(spark, d, "events").withColumn("k", _k()), "value", "k", 10)


@query(f"""SELECT user_id, (row_number() OVER ({W}) - 1) // 20 AS batch, event_id FROM events QUALIFY (row_number() OVER ({W}) - 1) // 20 < count(*) OVER (PARTITION BY user_id) // 20""")
def batch_seal(spark, d):
    """Members of sealed batches of exactly 20 per worker; the open tail is hidden."""
    w = Window.partitionBy("user_id")
    t = table(spark, d, "events").withColumns({"batch": F.floor((F.row_number().over(w.orderBy(*ORDER)) - 1) / 20), "n": F.count("*").over(w)})
    return t.where("batch < floor(n / 20)").select("user_id", "batch", "event_id")
