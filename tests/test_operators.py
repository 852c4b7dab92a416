"""Trackers and greedies against loop models, metrics in closed form, catalog, sources, streams, search."""

import math
import random

import pytest
from pyspark.sql import functions as F

from tracelake.functions import identity
from tracelake.operators import benchmarks, catalog, diversity, metrics, prior, search, select, sequence, tensor
from tracelake.operators.expectations import Violation
from tracelake.sources import archives, files
from tracelake.streaming import batches


def test_slot_tracker_against_loop(spark):
    rng, rows, want = random.Random(2), [], set()
    for s in range(40):
        was, ptype, php, pending = False, None, 0, None
        for i in range(60):
            kind, hp, active = rng.choice([3, 5]), rng.choice([0, 1, 2]), rng.random() < 0.8
            rows.append((s, i, kind, hp, active))
            if was and php > 0 and hp == 0:
                if pending is not None:
                    want.add((s, pending, i, ptype))
                pending = None
            elif active and (not was or kind != ptype):
                pending = i
            elif not active:
                pending = None
            was, ptype, php = active, kind, hp
    df = spark.createDataFrame(rows, "slot int, step int, kind int, hp int, active boolean")
    got = {tuple(r) for r in sequence.slot_lifecycle(df, ["slot"], "step", F.col("kind"), F.col("hp"), F.col("active")).collect()}
    assert got == want
    only = sequence.slot_lifecycle(df, ["slot"], "step", F.col("kind"), F.col("hp"), F.col("active"), F.col("_pkind") == 5)
    assert {tuple(r) for r in only.collect()} == {w for w in want if w[3] == 5}


def test_item_tracker_against_loop(spark):
    rng, rows, want = random.Random(4), [], set()
    for s in range(40):
        pitem, origin, birth, carrier = False, None, None, 0
        for i in range(60):
            kind, attr, active = rng.choice([0, 0, 3, 5]), rng.randrange(32), rng.random() < 0.8
            item = active and kind == 0
            rows.append((s, i, kind, attr, active, item))
            if pitem and not item:
                if birth is not None:
                    want.add((s, origin, birth[0], i, birth[2], birth[1]))
                origin, birth, carrier = None, None, 0
            if active and origin is None:
                origin = i
            elif not active:
                origin = None
            if active and not item:
                carrier = kind
            if item and not pitem:
                birth = (i, attr & 7, carrier)
            if not active:
                carrier = 0
            pitem = item
    df = spark.createDataFrame(rows, "slot int, step int, kind int, attr int, active boolean, item boolean")
    got = {tuple(r) for r in sequence.item_lifecycle(df, ["slot"], "step", F.col("kind"), F.col("active"), F.col("item"), F.col("attr")).collect()}
    assert {(a, c, d, f) for a, _, c, d, _, f in got} == {(a, c, d, f) for a, _, c, d, _, f in want}
    assert got == want


@pytest.mark.parametrize("gap", [0, 3, 10])
def test_anchor_chain(spark, gap):
    rng = random.Random(gap)
    steps = {k: sorted(rng.sample(range(200), 40)) for k in range(5)}
    df = spark.createDataFrame([(k, s) for k, v in steps.items() for s in v], "k int, s int")
    for k, v in steps.items():
        chain = [v[0]]
        for s in v:
            if s - chain[-1] > gap:
                chain.append(s)
        assert [r.anchors for r in sequence.anchor_chain(df, ["k"], "s", gap).where(F.col("k") == k).collect()] == [chain]
        assert sorted(r.s for r in sequence.anchor_chain_long(df, ["k"], "s", gap).where(F.col("k") == k).collect()) == chain


def test_balanced_shards(spark):
    df = spark.createDataFrame([(1, "Regular", 80, "a"), (1, "Regular", 70, "b"), (1, "Spread", 60, "c"), (1, "Spread", 50, "d")], "k int, w string, n int, uid string")
    got = {r.uid: r.shard for r in select.balanced_shards(df, ["k"], "w", "n", "uid", 150).collect()}
    assert got == {"a": 0, "b": 1, "c": 1, "d": 0}


def test_exact_split_is_order_independent(spark):
    rows = [(f"{i:064x}",) for i in range(2000)]
    df = spark.createDataFrame(rows, "fingerprint string").withColumn("o", identity.salted_order(F.col("fingerprint"), "any:0:"))
    a = {r.fingerprint: r.split for r in select.exact_split(df, ["o", "fingerprint"], {"train": 800, "validation": 100, "test": 100}).collect()}
    b = {r.fingerprint: r.split for r in select.exact_split(df.orderBy(F.rand(3)), ["o", "fingerprint"], {"train": 800, "validation": 100, "test": 100}).collect()}
    assert a == b and sorted(map(list(a.values()).count, ("train", "validation", "test"))) == [100, 100, 800]


def test_lineage_split_matches_hashlib(spark):
    import hashlib

    names = [f"trace-{i}.npz" for i in range(200)]
    got = {r.n: r.s for r in spark.createDataFrame([(n,) for n in names], "n string").select("n", identity.lineage_split(F.col("n")).alias("s")).collect()}
    assert got == {n: "val" if int(hashlib.sha1(n.encode()).hexdigest(), 16) % 100 < 10 else "train" for n in names}


def test_fingerprints(spark):
    import hashlib

    df = spark.createDataFrame([(bytearray(b"state"), bytearray(b"\x01\x00"))], "s binary, a binary")
    r = df.select(identity.task_fingerprint(F.col("s"), F.col("a")).alias("t"), identity.trace_fingerprint(F.col("s"), F.col("a"), F.lit(3), F.lit(1), F.lit("boss")).alias("f"), identity.set_digest(F.array(F.lit("b"), F.lit("a"))).alias("d")).collect()[0]
    assert r.t == hashlib.sha256(b"state\x01\x00").hexdigest() and r.f == hashlib.sha256(b"state\x01\x003\x001\x00boss\x00").hexdigest() and r.d == hashlib.sha256(b"a\nb").hexdigest()


def test_prior(spark):
    df = spark.createDataFrame([("x", 0, 0), ("x", 1, 1), ("x", 2, 1), ("y", 0, 1), ("y", 1, 0), ("y", 2, None), ("y", 3, 1)], "t string, s int, a int")
    n = {(r.prev, r.next): r.n for r in prior.bigrams(df, ["t"], ["s"], "a").collect()}
    assert n == {(0, 1): 1, (1, 1): 1, (1, 0): 1}
    dense = prior.prior(prior.bigrams(df, ["t"], ["s"], "a"), spark.createDataFrame([(0,), (1,), (2,)], "a int"))
    p = {(r.prev, r.next): r.p for r in dense.collect()}
    assert p[0, 1] == 1 and p[1, 0] == 0.5 and p[2, 2] == pytest.approx(1 / 3) and len(p) == 9
    prior.checked_prior(dense, 3)
    with pytest.raises(Violation):
        prior.checked_prior(dense, 4)
    arrays = spark.createDataFrame([([0, 1, 1],), ([1],), ([],), (None,)], "a array<int>")
    assert {(r.prev, r.next): r.n for r in prior.array_bigrams(arrays, "a").collect()} == {(0, 1): 1, (1, 1): 1}


def test_average_precision_and_presence(spark):
    df = spark.createDataFrame([(1, 0, True, 0.9), (1, 1, False, 0.8), (1, 2, True, 0.7), (1, 3, False, 0.1), (2, 0, False, 0.5)], "g int, i int, y boolean, s double")
    assert {r.g: r.ap for r in metrics.average_precision(df, ["g"], "s", F.col("y"), "i").collect()} == {1: pytest.approx((1 + 2 / 3) / 2), 2: None}
    p = {r.g: r for r in metrics.presence_scores(df, ["g"], F.col("y"), F.col("s") > 0.75).collect()}
    assert (p[1].precision, p[1].recall, p[1].f1, p[1].empty_fpr) == (0.5, 0.5, 0.5, 0.5) and p[2].recall is None and p[2].precision is None


def test_throughput(spark):
    df = spark.createDataFrame([("c", True, True, 10.0, "f"), ("c", False, False, 10.0, None), ("d", True, False, 5.0, "g")], "config string, win boolean, valid boolean, wall double, fp string")
    t = {r.config: r for r in benchmarks.throughput(df, ["config"], F.col("win"), F.col("valid"), "wall", "fp").collect()}
    assert (t["c"].wins_per_hour, t["c"].mean_s, t["c"].failures, t["d"].wins_per_hour, t["d"].p90_s) == (180, 10, 1, 0, None)
    with pytest.raises(Violation):
        benchmarks.confirmation(benchmarks.throughput(df, ["config"], F.col("win"), F.col("valid"), "wall"), "config", "d", 4)


def test_counts_reject_bad_numbers(spark):
    for bad in (None, "-1", "1.5", "true", '"100"'):
        with pytest.raises(Exception, match="invalid count"):
            spark.createDataFrame([(bad,)], "n string").select(benchmarks.checked_count(F.col("n")).alias("n")).collect()
    m = spark.createDataFrame([(1, "full", "a", 100), (1, "boss", "a", 384), (2, "full", "b", 31)], "l int, s string, w string, n bigint")
    rows = benchmarks.committed_counts(m, "l", "s", "w", "n", range(1, 9)).collect()
    assert sum(r.traces for r in rows if r.kind == "level") == 515 and sum(r.batches for r in rows if r.kind == "level") == 3 and len([r for r in rows if r.kind == "level"]) == 8


def test_gap_and_bootstrap(spark):
    df = spark.createDataFrame([(a, e, v + (0.2 if a == "x" else 0)) for e, v in enumerate((0.1, 0.4, 0.3)) for a in "xy"], "arm string, ep int, v double").withColumn("g", F.lit(1))
    r = metrics.paired_gap(df, ["g"], ["ep"], "arm", "x", "y", "v").collect()[0]
    assert r.pairs == 3 and r.gap == pytest.approx(0.2) and r.sd == pytest.approx(0)
    b = metrics.bootstrap_gap(spark.createDataFrame([(i, 0.2) for i in range(5)], "i int, d double"), "d", 50).collect()[0]
    assert (round(b.mean, 6), round(b.low, 6), round(b.high, 6)) == (0.2, 0.2, 0.2)


def test_js_and_distance(spark):
    df = spark.createDataFrame([({"a": 1, "b": 1}, {"a": 1, "b": 1}), ({"a": 1}, {"b": 5}), (None, {"b": 1}), ({}, {"b": 1})], "x map<string,bigint>, y map<string,bigint>")
    got = [r.d for r in df.select(diversity.js_distance(F.col("x"), F.col("y")).alias("d")).collect()]
    assert got == [0, 1, None, None]
    long = spark.createDataFrame([("u", "a", 1), ("v", "b", 5), ("w", "a", 2), ("w", "b", 2)], "uid string, g string, n bigint")
    pairs = spark.createDataFrame([("u", "v"), ("u", "w"), ("u", "u")], "a string, b string")
    js = {(r.a, r.b): r.js for r in diversity.js_pairs(long, "uid", "g", "n", pairs).collect()}
    p = math.sqrt((math.log2(4 / 3) + 0.5 * math.log2(2 / 3) + 0.5) / 2)
    assert js["u", "v"] == 1 and js["u", "u"] == 0 and js["u", "w"] == pytest.approx(p)
    n = spark.createDataFrame([([1, 1, 2],)], "b array<int>").select(diversity.ngrams(F.col("b")).alias("m")).collect()[0].m
    assert n == {"u:1": 2, "u:2": 1, "b:1:1": 1, "b:1:2": 1}


def test_nearest_blended_is_brute_force(spark, data):
    import numpy as np
    from tracelake.queries import platform

    rows = sorted((r for r in platform._features(spark, data).where("size(ngrams) > 0 AND size(state) > 0").withColumn("ngrams", F.map_entries("ngrams")).collect()), key=lambda r: r.uid)

    def shares(r):  # repeated keys count together
        n = {}
        for k, v in r.ngrams:
            n[k] = n.get(k, 0) + v
        return {k: v / sum(n.values()) for k, v in n.items()}

    def distance(a, b):
        x, y = np.array(a.state, float), np.array(b.state, float)
        p, q = shares(a), shares(b)
        half = lambda s, t: sum(v * math.log2(2 * v / (v + t.get(k, 0))) for k, v in s.items())
        return 0.45 * np.sqrt(((x - y) ** 2).mean()) + 0.35 * math.sqrt(max(0, (half(p, q) + half(q, p)) / 2)) + 0.2 * min(1, abs(math.log((a.length + 1) / (b.length + 1))) / math.log(4))

    got = {r.uid: r for r in diversity.nearest_blended(platform._features(spark, data), 25).collect()}
    assert set(got) == {r.uid for r in rows} and len(rows) > 20
    for i, r in enumerate(rows):
        like = [b for b in rows[:i] if len(b.state) == len(r.state)]
        pool = {b.uid: distance(r, b) for b in [b for b in like if (b.weapon or "") == (r.weapon or "")] or like}
        if not pool:
            assert got[r.uid].nearest is None and got[r.uid].distance is None
        else:
            assert got[r.uid].distance == pytest.approx(min(pool.values()), abs=1e-7) == pool[got[r.uid].nearest]


def test_js_floor_is_tight():
    import numpy as np

    r = np.random.default_rng(3)
    for a in (0.05, 1, 20):
        p, q = r.dirichlet(np.full(30, a), (2, 200))
        q[:20] = 0.999 * p[:20] + 0.001 * q[:20]
        m = (p + q) / 2
        half = lambda s: np.where(s > 0, s * np.log2(np.where(s > 0, s, 1) / m), 0).sum(1)
        js = np.sqrt((half(p) + half(q)) / 2)
        floor = diversity.js_floor(1 - np.sqrt(p * q).sum(1))
        assert (floor <= js + 1e-7).all() and (js <= floor / math.sqrt(math.log(2)) + 1e-6).all()
    assert diversity.js_floor(np.array([1.0]))[0] == 1


def test_js_distance_all_needs_no_state(spark, tmp_path):
    from tracelake.queries import platform

    rows = [("a", "f", 9, "L", {"u:1": 1}, [[0.0] * 8] * 20), ("b", "f", 9, "l", {"u:2": 1}, None), ("c", "f", 9, "L ", {"u:1": 1}, [[0.0] * 8] * 7)]
    spark.createDataFrame(rows, "uid string, fingerprint string, length int, weapon string, ngrams map<string,bigint>, state array<array<float>>").write.parquet(str(tmp_path / "diversity_features.parquet"))
    assert {tuple(r) for r in platform.js_distance_all(spark, str(tmp_path)).collect()} == {("a", "b", 1.0), ("b", "c", 1.0)}


def test_places_taken_twice(spark, tmp_path):
    from tracelake.queries import platform

    f = [c * 64 for c in "abcd"]
    shards = [(1, 1, "full", "S", "E", 0, 2, 10), (2, 1, "full", "S", "E", 0, 1, 10), (3, 1, "full", "S", "E", 1, 1, 10), (3, 1, "full", "S", "E", 1, 1, 10)]
    spark.createDataFrame(shards, "id bigint, level int, task string, weapon string, encoder_sha256 string, ordinal int, episodes int, frames bigint").write.parquet(f"{tmp_path}/shards.parquet")
    members = [(1, f[0], 0), (1, f[1], 0), (2, f[2], 0), (2, f[2], 0), (3, f[3], 0)]
    spark.createDataFrame(members, "shard_id bigint, fingerprint string, ordinal int").write.parquet(f"{tmp_path}/shard_episodes.parquet")
    spark.createDataFrame([(x, x, "t", 5) for x in f], "uid string, fingerprint string, source_trace string, action_steps int").write.parquet(f"{tmp_path}/episodes.parquet")
    spark.createDataFrame([(1, "full", 100)], "level int, task string, target_frames bigint").write.parquet(f"{tmp_path}/shard_targets.parquet")
    got = {r.gate: r.violations for r in platform.quality_gates(spark, str(tmp_path)).collect()}
    assert got["place taken twice"] == 2  # two members of shard 1, and shards 1 and 2


def test_select_diverse(spark):
    cand = spark.createDataFrame([("p1", "f1", "S", 0.0), ("p2", "f1", "S", 5.0), ("p3", "f3", "S", 0.05), ("p4", "f4", "S", 3.0), ("p5", "f5", "R", 9.0)], "path string, fingerprint string, weapon string, x double")
    refs = spark.createDataFrame([("r1", "f9", "S", 1.0)], "path string, fingerprint string, weapon string, x double")
    audit = diversity.select_diverse(cand, refs, 0.1, lambda a, b: abs(a.x - b.x), whole_pool=True)
    got = {r.path: (r.accepted, r.reason) for r in audit.collect()}
    assert got == {"p1": (True, None), "p2": (False, "exact"), "p3": (False, "near"), "p4": (True, None), "p5": (True, None)}
    s = diversity.audit_summary(audit).collect()[0]
    assert (s.candidates, s.accepted, s.exact, s.near) == (5, 3, 1, 1)


def test_tensor(spark):
    pts = spark.createDataFrame([(1, 128, 120), (1, 0, 0)], "f int, x int, y int")
    full = {(r.gx, r.gy): r.value for r in tensor.heatmaps(pts, ["f"]).collect()}
    near = {(r.gx, r.gy): r.value for r in tensor.heatmaps(pts, ["f"], reach=6).collect()}
    assert full[16, 16] == 1 and len(full) == 1024 and all(abs(full[k] - near.get(k, 0)) < 2e-8 for k in full)
    d = tensor.dense(tensor.heatmaps(pts, ["f"], reach=6), ["f"]).collect()[0].values
    assert len(d) == 1024 and d[16 * 32 + 16] == 1
    import numpy as np

    assert np.allclose(tensor.upsampled(np.ones((4, 4)), 16), 1)
    v = spark.createDataFrame([(1, [0.0, 0.0]), (2, [1.0, 1.0]), (3, None)], "i int, v array<double>")
    assert {r.i: r.code for r in tensor.nearest_code(v, "i", "v", {5: [0.0, 0.1], 7: [1.0, 1.0]}).collect()} == {1: 5, 2: 7}
    assert len(tensor.kmeans(v.where("v is not null"), "v", 2).clusterCenters()) == 2


EP = "fingerprint string, fingerprint_kind string, uid string, source_trace string, action_steps int, ordinal int"


def test_catalog(spark, tmp_path):
    cat = catalog.Catalog(spark, str(tmp_path / "catalog"))
    shard = lambda o: {"path": f"s{o}", "sha256": f"h{o}", "level": 1, "task": "boss", "weapon": "Spread", "encoder_sha256": "e", "ordinal": o, "episodes": 2, "frames": 20}
    eps = lambda *n: spark.createDataFrame([(f"f{i}", "task", f"u{i}", "t", 10, k) for k, i in enumerate(n)], EP)
    assert cat.next_ordinal(1, "boss", "Spread", "e") == 0
    assert cat.register_shard(shard(0), eps(1, 2)) == 1 and cat.register_shard(shard(1), eps(3, 4)) == 2 and cat.next_ordinal(1, "boss", "Spread", "e") == 2
    for bad in ((shard(2), eps(1, 5)), (shard(1), eps(6, 7)), (shard(3), eps(6)), ({**shard(4), "level": 9}, eps(6, 7))):
        with pytest.raises(Violation):
            cat.register_shard(*bad)
    assert [r.ordinal for r in cat.select_shards(1, "boss", "Spread", "e", 3).collect()] == [0, 1] and [r.ordinal for r in cat.select_shards(1, "boss", "Spread", "e", 2).collect()] == [0]
    with pytest.raises(Violation):
        cat.select_shards(1, "boss", "Spread", "e", 5)
    assert cat.table("shard_episodes").count() == 4
    c = {"name": "c", "level": 1, "task": "boss", "encoder_sha256": "e", "manifest_path": "m", "manifest_sha256": "h", "episodes": 2}
    members = spark.createDataFrame([("f1", 0), ("f3", 1)], "fingerprint string, ordinal int")
    cat.register_collection(c, members)
    with pytest.raises(Violation):
        cat.register_collection(c, members)
    cat.register_boundaries(spark.createDataFrame([("f1", 11, 4, "u", "h")], catalog.SCHEMAS["episode_boundaries"]), "1")
    with pytest.raises(Violation):
        cat.register_boundaries(spark.createDataFrame([("f2", 11, 11, "u", "h")], catalog.SCHEMAS["episode_boundaries"]), "2")


def test_views(spark):
    rows = spark.createDataFrame([(v, list(range(11)), list(range(10)), 3) for v in catalog.VIEWS], "view string, o array<int>, a array<int>, b int")
    got = {r.view: (r.o, r.a) for r in catalog.sliced(rows, F.col("view"), "o", "a", "b").collect()}
    assert got == {"start_to_boss": ([0, 1, 2, 3], [0, 1, 2]), "boss_fight": (list(range(3, 11)), list(range(3, 10))), "full": (list(range(11)), list(range(10)))}
    for view, b in (("other", 3), ("full", 11)):
        with pytest.raises(Exception, match="no such view"):
            catalog.sliced(rows.limit(1).withColumn("view", F.lit(view)).withColumn("b", F.lit(b)), F.col("view"), "o", "a", "b").collect()


def test_npz_and_tar_sources(spark, tmp_path):
    import numpy as np

    archives.register(spark)
    acts = np.array([[1, 0, 0, 0, 0, 0, 0, 1, 0], [0] * 9], dtype=np.uint8)
    archives.write_npz(str(tmp_path / "a" / "x.npz"), actions=acts, initial_state=np.frombuffer(b"ab\x00c", dtype=np.uint8), skip=-1, level=2, weapon="", split="val", meta={"goal": "boss"})
    archives.write_npz(str(tmp_path / "a" / "y.npz"), actions=acts[:1], initial_state=np.frombuffer(b"z", dtype=np.uint8), skip=4)
    with pytest.raises(ValueError):
        archives.write_npz(str(tmp_path / "b.npz"), actions=acts, meta={"skip": 3})
    got = {r.uid: r for r in spark.read.format("npz").load(str(tmp_path / "a")).collect()}
    assert got["x"].actions == acts.tolist() and bytes(got["x"].initial_state) == b"ab\x00c" and (got["x"].skip, got["x"].level, got["x"].weapon, got["x"].split, got["x"].meta) == (3, 2, None, "val", {"goal": "boss"})
    assert got["y"].skip == 4 and got["y"].level is None
    archives.write_tar(str(tmp_path / "s.tar"), [("k1", b"png1", {"f": 1}), ("k2", b"png2", {"f": 2})])
    tar = spark.read.format("tarpairs").load(str(tmp_path / "s.tar"))
    assert {(r.key, bytes(r.payload), r.meta) for r in tar.collect()} == {("k1", b"png1", '{"f": 1}'), ("k2", b"png2", '{"f": 2}')}
    assert [r.key for r in spark.read.format("tarpairs").option("members", "k2").load(str(tmp_path / "s.tar")).collect()] == ["k2"]
    with pytest.raises(Exception, match="missing members"):
        spark.read.format("tarpairs").option("members", "k2,k3").option("strict", "true").load(str(tmp_path / "s.tar")).collect()


def test_files(spark, tmp_path):
    df = spark.createDataFrame([(i, i // 40, i % 40) for i in range(100)], "i int, ep int, frame int")
    a = [r.i for r in files.shuffled_epoch(df, F.col("i"), 1).collect()]
    assert sorted(a) == list(range(100)) and a == [r.i for r in files.shuffled_epoch(df.repartition(7), F.col("i"), 1).collect()] and a != [r.i for r in files.shuffled_epoch(df, F.col("i"), 1, epoch=1).collect()]
    w = [(r.ep, r.frame // 10) for r in files.shuffled_epoch(df, F.col("i"), 1, windows=("ep", "frame", 10)).collect()]
    assert len([1 for x, y in zip(w, w[1:]) if x != y]) == len(set(w)) - 1
    names = spark.createDataFrame([("b",), ("a",), ("c",)], "fingerprint string")
    kept, digest = files.freeze(names, "fingerprint", 2)
    assert {r[0] for r in kept.collect()} == {"a", "b"} and len(digest) == 64
    with pytest.raises(Violation):
        files.freeze(names, "fingerprint", 4)
    status = files.promote(spark.createDataFrame([("p1", "f1"), ("p2", "f1"), ("p3", "f2")], "path string, fingerprint string"), spark.createDataFrame([("f2",)], "fingerprint string"))
    assert {r.path: r.status for r in status.collect()} == {"p1": "promoted", "p2": "existing", "p3": "existing"}
    (tmp_path / "x.jsonl").write_text('{"a": 1}\n\n{"a": 2}\n')
    assert files.json_lines(spark, str(tmp_path / "x.jsonl"), "a int").count() == 2
    df.write.parquet(str(tmp_path / "c"))
    assert files.layout(str(tmp_path / "c")) == "parquet"


def test_idempotent_publishing(spark, tmp_path):
    df = spark.createDataFrame([(i,) for i in range(30)], "i int")
    df.repartition(3).write.parquet(str(tmp_path / "in"))
    out = str(tmp_path / "out")
    for _ in range(2):  # a restart finds nothing new
        batches.run_available(batches.file_stream(spark, str(tmp_path / "in"), df.schema, 1), out, str(tmp_path / "ck"))
    assert sorted(r.i for r in batches.published(spark, out, "i int").collect()) == list(range(30))
    batches.publish(df.where("i < 5"), 50, out)
    batches.publish(df.where("i < 5"), 50, out)  # the same again changes nothing
    with pytest.raises(ValueError, match="other content"):
        batches.publish(df.where("i < 6"), 50, out)
    df.write.parquet(f"{out}/data/batch=99")  # no marker: not visible
    assert batches.published(spark, out, "i int").where("batch = 99").count() == 0 and batches.published(spark, out, "i int").where("batch = 50").count() == 5
    assert [batches.backoff(i) for i in (0, 1, 10)] == [5, 10, 300]


def test_search(spark):
    easy = search.Config(rollouts=32, length=8, settle=3)
    rows = search.searches(spark, 6, config=easy).collect()
    assert all(r.win == r.replay_valid for r in rows) and sum(r.win for r in rows) >= 5
    assert [r.actions for r in rows] == [r.actions for r in search.searches(spark, 6, config=easy).collect()]
    hp = spark.createDataFrame([("t", i, h) for i, h in enumerate([0, 5, 9, 9, 7, 3, 0, 0, 0, 0, 0, 0, 0, 0])], "t string, s int, hp int")
    assert search.capture_starts(hp, ["t"], "s", "hp").collect()[0].start_step in (2, 3, 4, 5)


def test_select_helpers(spark):
    t = spark.createDataFrame([("a", 1, 3), ("b", 2, 4), ("c", 3, 5)], "k string, o int, n int")
    assert [r.k for r in select.prefix_budget(t.withColumn("g", F.lit(1)), ["g"], ["o"], "n", 7).orderBy("o").collect()] == ["a", "b"]
    up = select.upsert(t, spark.createDataFrame([("b", 2, 9)], "k string, o int, n int"), ["k"])
    assert {r.k: r.n for r in up.collect()} == {"a": 3, "b": 9, "c": 5}
    side = spark.createDataFrame([("a", None), ("b", 7)], "k string, n int")
    assert {r.k: r.n for r in select.override(t, side, ["k"]).collect()} == {"a": 3, "b": 7, "c": 5}
    r = select.seeded_round(t.withColumn("r", F.lit(1)), "r", "k", "c").orderBy("position").collect()
    assert r[0].k == "c" and len(r) == 3
    assert {x.prefix: x.n for x in select.scaling_prefixes(t.withColumn("g", F.lit(1)).select("g", "o", "n"), ["g"], "o", ["n"]).collect()} == {1: 3, 2: 7, 3: 12}


def test_nearest_quantiles_beside_a_state_without_distance(spark, tmp_path):
    from tracelake.queries import platform

    state = lambda v: [[v] * 8] * 20
    rows = [("a", "f", 9, "L", {"u:1": 1}, state(float("nan"))), ("b", "f", 9, "L", {"u:1": 1}, state(0.5)), ("c", "f", 9, "L", {"u:1": 1}, state(0.0))]
    spark.createDataFrame(rows, "uid string, fingerprint string, length int, weapon string, ngrams map<string,bigint>, state array<array<float>>").write.parquet(str(tmp_path / "diversity_features.parquet"))
    assert [tuple(r) for r in platform.diversity_nearest_quantiles(spark, str(tmp_path)).collect()] == [(1, 0.225, 0.225, 0.225)]


def test_nearest_quantiles_moves_no_row_per_pair(spark, tmp_path):
    """Records meet without an exchange of rows per block, and repeated, equal and unusual ones (exact ties, halves that aren't enough for a state, large counts, a rare weapon) keep their nearest."""
    import numpy as np
    from tracelake.queries import platform

    r = np.random.default_rng(2)
    near = lambda v: (r.integers(0, 2, (4, 8)) * v + r.random((4, 8))).astype(np.float32)
    rows = [(f"u{i:03d}", "f", int(r.integers(5, 300)), "S" if i != 150 else "rare", {f"u:{k}": int(r.integers(1, 90000 if i % 5 == 0 else 9)) for k in r.choice(12, 6, False)}, (near(1) if i % 3 else np.round(near(0) * 8) / 8).tolist()) for i in range(200)]
    rows += [(f"w{i:03d}", *rows[i][1:]) for i in range(0, 60, 2)]  # the same under later uids
    rows += rows[::7]
    types = "uid string, fingerprint string, length int, weapon string, ngrams map<string,bigint>, state array<array<float>>"
    spark.createDataFrame(rows, types).write.parquet(str(tmp_path / "diversity_features.parquet"))
    found = diversity.nearest_blended(platform._features(spark, str(tmp_path), repeated=True), 16)
    assert "Exchange" not in found._jdf.queryExecution().executedPlan().toString()
    got, each = {x.uid: x for x in found.collect()}, sorted({x[0]: x for x in rows}.values(), key=lambda x: x[0])
    assert len(got) == len(each) == found.count() == 230

    def distance(a, b):
        p, q = ({k: v / sum(x[4].values()) for k, v in x[4].items()} for x in (a, b))
        half = lambda s, t: sum(v * math.log2(2 * v / (v + t.get(k, 0))) for k, v in s.items())
        rms = np.sqrt(((np.array(a[5]) - np.array(b[5])) ** 2).mean())
        return 0.45 * rms + 0.35 * math.sqrt(max(0, (half(p, q) + half(q, p)) / 2)) + 0.2 * min(1, abs(math.log((a[2] + 1) / (b[2] + 1))) / math.log(4))

    for i, a in enumerate(each):
        pool = {b[0]: distance(a, b) for b in [b for b in each[:i] if b[3] == a[3]] or each[:i]}
        best = min(pool.items(), key=lambda x: (round(x[1], 9), x[0]), default=(None, None))
        assert got[a[0]].nearest == best[0] and got[a[0]].distance == (None if best[0] is None else pytest.approx(best[1], abs=1e-7))
    assert got["w000"].nearest == "u000" and got["w000"].distance == 0
    distances = [x.distance for x in got.values() if x.distance is not None]
    assert [tuple(x) for x in platform.diversity_nearest_quantiles(spark, str(tmp_path)).collect()] == [(229, *(pytest.approx(np.quantile(distances, k), abs=1e-5) for k in (0.1, 0.5, 0.9)))]
