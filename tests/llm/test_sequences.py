"""Shared spans, cross-split overlaps, runs, packing, history: against brute force and on edge cases."""

import collections

import pytest

from tracelake.llm import crosssplit, edits, history, packing, runs, spans

COMMON = [128, 129, 16, 17, 32, 64, 0]


def walk(rng, n, codes=COMMON):
    out = []
    while len(out) < n:
        out += [rng.choice(codes)] * rng.choice([1, 1, 2, 4])
    return out[:n]


def edited(rng, a, k, codes=COMMON):
    a = list(a)
    for _ in range(k):
        if not a:
            break
        i, what = rng.randrange(len(a)), rng.choice("cid")
        if what == "c":
            a[i] = rng.choice(codes)
        elif what == "i":
            a.insert(i, rng.choice(codes))
        else:
            a.pop(i)
    return a


def slow_distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def near(a, b):
    most = max(len(a), len(b)) // 10
    return abs(len(a) - len(b)) <= most and slow_distance(a, b) <= most


def test_distance(rng):
    for _ in range(300):
        a = walk(rng, rng.randrange(0, 40))
        b = edited(rng, a, rng.randrange(0, 6)) if a and rng.random() < 0.7 else walk(rng, rng.randrange(0, 40))
        d, most = slow_distance(a, b), rng.randrange(0, 12)
        assert edits.distance(a, b, most) == min(d, most + 1) or (d > most and edits.distance(a, b, most) > most)


def covered(segs, span):
    seen = collections.defaultdict(set)
    for _, a, t, _ in segs:
        for i in range(len(a or []) - span + 1):
            seen[tuple(a[i : i + span])].add(t.replace("\\", "/").split("/")[-1])
    out = set()
    for u, a, _, _ in segs:
        mark = [False] * len(a or [])
        for i in range(len(a or []) - span + 1):
            if len(seen[tuple(a[i : i + span])]) > 1:
                mark[i : i + span] = [True] * span
        i = 0
        while i < len(mark):
            j = i
            while j < len(mark) and mark[j]:
                j += 1
            if j > i:
                out.add((u, i, j - i))
            i = max(j, i + 1)
    return out


def test_spans_against_all_windows(make, rng):
    base = walk(rng, 400)
    segs = [(f"u{i}", walk(rng, rng.randrange(0, 60)) + base[(s := rng.randrange(0, 300)) : s + rng.randrange(20, 100)] + walk(rng, rng.randrange(0, 60)), rng.choice(["a/t1", "t1", "b\\t2", "t3"]), None) for i in range(30)]
    segs += [("hold1", [128] * 150, "t1", None), ("hold2", [128] * 90 + walk(rng, 20), "t2", None), ("same-trace", base[:100], "t9", None), ("again", base[:100], "x/t9", None)]
    segs += [("u0", segs[0][1], segs[0][2], None), ("short", [1, 2], "t1", None), ("empty", [], "t1", None)]
    got = {tuple(r) for r in spans.shared_spans(make.segments(segs)).collect()}
    assert got == covered({s[0]: s for s in segs}.values(), 64)


def test_spans_hot_shard_is_split(make, rng):
    """Every piece in one shard, cut over several automata and salts, gives the same spans."""
    base = walk(rng, 300)
    segs = [(f"u{i}", base[i : i + 120 + i], f"t{i % 3}", None) for i in range(40)]
    rows = spans.segment_codes(make.segments(segs))
    got = {(r.uid, r.lo, r.hi - r.lo + 1) for r in spans.merged(spans.located(rows, 64, phrases_per_shard=10, pieces_per_task=7)).collect()}
    assert got == covered(segs, 64)


def test_spans_edge_cases(make):
    assert spans.shared_spans(make.segments([])).collect() == []
    odd = [("n", None, None, None), (None, [1] * 80, "t", None), ("a", [None] * 70, "t1", None), ("b", [None] * 70, None, None)]
    assert {tuple(r) for r in spans.shared_spans(make.segments(odd)).collect()} == {("a", 0, 70), ("b", 0, 70)}
    per = {r.uid: r for r in spans.shared_per_segment(make.segments(odd)).collect()}
    assert per["a"].shared_steps == 70 and per["a"].stretches == 1 and "n" not in per


def test_cross_split(make, rng):
    segs = []
    for i in range(60):
        a = walk(rng, rng.choice([3, 8, 12, 25, 30, 34, 70, 80, 90, 120, 200]))
        segs.append((f"e{i}", a, f"t{i}", rng.choice(["val", "test ", "VALIDATION"])))
        b = edited(rng, a, rng.randrange(0, max(1, len(a) // 8) + 1))
        segs.append((f"d{i}", b, f"x/t{i}", "train"))
    segs += [("e0", segs[0][1], "t0", segs[0][3]), ("copy", segs[1][1], "t", "train"), ("none", None, "t", "train"), ("empty1", [], "t", "val"), ("empty2", [], "t", "train"), ("other", segs[0][1], "t", "heldout")]
    got = [tuple(r) for r in crosssplit.found(make.segments(segs)).collect()]
    ev = {u: a for u, a, _, s in segs if s.strip().lower() in ("val", "test", "validation") and a is not None}
    tr = {u: a for u, a, _, s in segs if s == "train" and a is not None}
    assert sorted(got) == sorted((min(u, v), max(u, v)) for u in ev for v in tr if near(ev[u], tr[v]))
    by = crosssplit.by_source(make.segments(segs)).collect()
    assert sum(r.pairs for r in by) == len(got) and sum(r.records for r in by) == len(ev)


def test_cross_split_derives_missing_splits(make):
    rows = [("a", [1] * 20, "trace-7", None), ("b", [1] * 20, "t", "train"), ("c", [1] * 20, "trace-7", " ")]
    import hashlib

    side = "val" if int(hashlib.sha1(b"trace-7").hexdigest(), 16) % 100 < 10 else "train"
    got = {tuple(r) for r in crosssplit.found(make.segments(rows)).collect()}
    assert got == ({("a", "b"), ("b", "c")} if side == "val" else set())
    assert crosssplit.found(make.segments([])).collect() == []


def spread_edits(a, k, kind):
    """k edits, evenly spread over a."""
    a = list(a)
    for i in sorted((int((j + 0.5) * len(a) / k) for j in range(k)), reverse=True):
        if kind == "c":
            a[i] = 300 + i % 7
        elif kind == "i":
            a.insert(i, 300 + i % 7)
        else:
            a.pop(i)
    return a


def test_cross_split_at_every_length(make, rng):
    """As many edits as near-same allows, evenly spread and in one place, at every length."""
    segs = []
    for n in range(0, 121):
        a = [rng.randrange(512) for _ in range(n)]
        segs.append((f"e{n}", a, "t", "val"))
        for kind in "cid":
            k = (n + n // 9) // 10 if kind == "i" else n // 10
            while k and max(n, n + k if kind == "i" else n) // 10 < k:
                k -= 1
            segs.append((f"d{n}{kind}", spread_edits(a, k, kind) if k else a, "t", "train"))
        k = n // 10
        segs.append((f"d{n}x", a[: n // 3] + [310] * k + a[n // 3 + k :] if k else a, "t", "train"))
    want = {(f"d{n}{k}", f"e{n}") for n in range(121) for k in "cidx"}
    got = {tuple(r) for r in crosssplit.found(make.segments(segs)).collect()}
    of = {u: a for u, a, _, _ in segs}
    assert want <= got and all(near(of[u], of[v]) for u, v in got - want)


def test_common_passages_stay_out_of_the_lists(rng):
    """Of a passage that all records share no block is entered where the rest of a record is long enough."""
    import numpy as np

    from tracelake.llm import blocks

    same = walk(rng, 50)
    rows = [same + [rng.randrange(512) for _ in range(60)] for _ in range(300)]
    codes, offsets = np.array(sum(rows, []), dtype=np.int16), np.arange(301) * 110
    counts = np.zeros((len(blocks.SIZES), blocks.SLOTS), dtype=np.float32)
    for i, size in enumerate(blocks.SIZES):
        rec, place = blocks._inside(offsets, size, np.ones(300, dtype=bool))
        counts[i] = np.bincount((blocks.keys(codes, size)[offsets[rec] + place] % np.uint64(blocks.SLOTS)).astype(int), minlength=blocks.SLOTS)
    rec, place, key, size = blocks.chosen(codes, offsets, counts)
    assert (np.bincount(rec) == 13).all() and (place >= 47).mean() > 0.99


def test_packed_steps_of_odd_vectors():
    import pyarrow as pa

    from tracelake.llm.common import packed_steps

    rows = [[[1, 0, 1], None, [0] * 9, [0] * 8 + [5, 1], [], [None, 2]], None, [], [[1] * 9]]
    t = pa.array(rows, pa.list_(pa.list_(pa.int16())))
    assert packed_steps(t).to_pylist() == [[5, -1, 0, 256, 0, 2], [], [], [511]]
    assert packed_steps(t.slice(3)).to_pylist() == [[511]] and packed_steps(t.slice(0, 0)).to_pylist() == []


def test_runs(make, rng):
    segs = [(f"u{i}", walk(rng, rng.randrange(0, 120), [128, 129, 16, None]), "t", None) for i in range(20)] + [("u0", None, "t", None)]
    segs = [s for s in segs if s[0] != "u0"] + [("hold", [1] * 20 + [0] * 5 + [2] * 14 + [None] * 30, "t", None), ("e", [], "t", None), ("n", None, "t", None)]
    want = set()
    for u, a, _, _ in segs:
        i = 0
        while i < len(a or []):
            j = i
            while j < len(a) and (a[j] is None) == (a[i] is None) and (a[i] is None or a[j] >> 1 == a[i] >> 1):
                j += 1
            if j - i >= 15 and a[i] is not None:
                want.add((u, i, j - i))
            i = j
    t = make.segments(segs + [segs[0]])
    assert sorted(tuple(r) for r in runs.long_presses(t).collect()) == sorted(want) and ("hold", 0, 25) in want
    whole = collections.defaultdict(int)
    for r in runs.collapse_presses(t).collect():
        whole[r.uid] += r.run_steps
        assert r.frames == 3 * r.run_steps
    assert whole == {u: len(a) for u, a, _, _ in segs if a}
    assert runs.long_presses(make.segments([])).collect() == []


def test_pack_function(rng):
    for _ in range(50):
        sizes = [rng.randrange(0, 50) for _ in range(rng.randrange(1, 200))]
        at, still = packing.pack(sizes, 50, 4)
        load = collections.Counter()
        for s, w in zip(sizes, at):
            load[w] += s
        assert max(load.values()) <= 50 and len(still) <= 4


@pytest.mark.parametrize("part_items", [20_000, 30])
def test_packing_is_whole_and_tight(spark, make, rng, part_items):
    eps = [(f"u{i}", i, 1, None, [1] * 40 if i % 9 == 0 else None, "t", None if i % 9 == 0 else rng.randrange(1, 130), 1 + i % 2, "kill") for i in range(400)]
    eps += [eps[0], ("long", 0, 1, None, None, "t", 950, 1, "kill"), ("zero", 0, 1, None, [], "t", None, 1, "kill"), ("unknown", 0, 1, None, None, "t", None, 1, "kill"), ("no-target", 0, 1, None, None, "t", 5, 7, "kill"), (None, 0, 1, None, None, "t", 5, 1, "kill")]
    targets = spark.createDataFrame([(1, "kill", 300), (2, "kill", 200), (3, "boss", None)], "level int, task string, target_frames bigint")
    rows = packing.placed(make.episodes(eps), targets, windows=8, part_items=part_items).collect()
    size = {u: s if s is not None else len(a) if a is not None else None for u, _, _, _, a, _, s, _, _ in eps if u}
    got, load = collections.Counter(), collections.Counter()
    for r in rows:
        got[r.uid] += r.frames or 0
        if r.shard:
            load[r.shard, r.target] += r.frames
    assert got == collections.Counter({u: s or 0 for u, s in size.items()}) and set(r.uid for r in rows) == set(size)
    assert all(n <= cap for (_, cap), n in load.items())
    assert {r.uid for r in rows if r.shard is None} == {"unknown", "no-target"}
    assert sorted(r.frames for r in rows if r.uid == "long") == [50, 300, 300, 300]
    assert {u for u, n in collections.Counter(r.uid for r in rows).items() if n > 1} == {"long"}
    for level, cap in ((1, 300), (2, 200)):
        used = [n for (s, _), n in load.items() if s.startswith(f"{level}-")]
        assert len(used) <= -(-sum(used) // cap) * 1.06 + 1
    assert packing.shards(make.episodes([]), targets).collect() == []


def brute_repeats(eps, published):
    import re

    fp = lambda f: (m := re.search("[0-9a-fA-F]{64}", f or "")) and m.group().lower()
    rows = {e[0]: e for e in eps if e[0] is not None and e[1] is not None}.values()
    out = set()
    for u, n, b, f, a, *_ in rows:
        if fp(f) and (any(fp(g) == fp(f) and m < n for _, m, _, g, *_ in rows) or any(fp(g) == fp(f) and c < b for g, c, _ in published)):
            out.add(u)
        if a is not None and any(m < n and c is not None and near(a, c) for _, m, _, _, c, *_ in rows):
            out.add(u)
    return out


def repeats(rng):
    ids = list(range(12))
    eps, published = [], [("sha256:" + "ab" * 32, 0, "z"), (None, 0, "z"), ("CD" * 32, 3, "z")]
    for i in range(70):
        prior = [e for e in eps if e[4]]
        if prior and rng.random() < 0.5:
            a = edited(rng, rng.choice(prior)[4], rng.randrange(0, 14), ids)
        else:
            a = walk(rng, rng.choice([4, 9, 11, 19, 50, 75, 89, 100, 160]), ids)
        eps.append((f"u{i}", i, i // 20, f"{i:064x}", a, "t", None, 1, "kill"))
    eps += [("fp1", 80, 4, "  " + "AB" * 32, None, "t", 1, 1, "kill"), ("fp2", 81, 4, "cd" * 32, None, "t", 1, 1, "kill"), ("fp3", 82, 4, "x" + f"{3:064X}" + "y", None, "t", 1, 1, "kill"),
            ("short", 83, 4, "abc", [], "t", 1, 1, "kill"), ("short2", 84, 4, None, [], "t", 1, 1, "kill"), ("nulls", 85, 4, None, [None, 3], "t", 1, 1, "kill"), (None, 86, 4, None, [1], "t", 1, 1, "kill"), ("unplaced", None, 4, None, [1], "t", 1, 1, "kill")]
    return eps, published


def test_history_in_one_pass(make, rng):
    eps, published = repeats(rng)
    by = history.batches(make.episodes(eps + eps[:5]), make.published(published)).collect()
    assert sum(r.rejected for r in by) == len(brute_repeats(eps, published)) and all(r.accepted + r.rejected == r.episodes for r in by)


def test_history_batch_by_batch(spark, make, rng, tmp_path):
    eps, published = repeats(rng)
    t, p = make.episodes(eps), make.published(published)
    assert {r.uid for r in history.judged(t, p, 99, str(tmp_path / "whole")).where(history.REPEAT).collect()} == brute_repeats(eps, published)
    shards, rows = history.first_published(p), history.records(t)
    for b in (0, 1, 1):  # a new session finds the tables; a batch that is run again changes nothing
        h = history.History(spark, str(tmp_path / "history"), 4)
        got = {r.uid for r in h.check(rows.where(f"batch_no = {b}"), shards, b).where(history.REPEAT).collect()}
        assert got == {u for u in brute_repeats(eps, published) if [e for e in eps if e[0] == u][0][2] == b}


def test_rounds():
    assert history.round_bounds([(1, 5, 5), (6, 9, 4), (8, 12, 4), (20, 30, 3)], 99) == [5, 12, 30]
    assert history.round_bounds([(i, i, 10 - i) for i in range(10)], 3)[-1] == 9 and len(history.round_bounds([(i, i, 1) for i in range(10)], 3)) == 3
    assert history.round_bounds([], 3) == []


def test_history_of_nothing(make):
    assert history.found(make.episodes([]), make.published([])).collect() == []


def test_history_moves_no_row_per_gram(spark, make, rng, tmp_path):
    written = lambda: {(s.stageId(), s.attemptId()): s.shuffleWriteRecords() for s in (stages.apply(i) for i in range(stages.size()))} if (
        stages := spark.sparkContext._jsc.sc().statusStore().stageList(None, False, False, spark.sparkContext._gateway.new_array(spark.sparkContext._jvm.double, 0), spark.sparkContext._jvm.java.util.ArrayList())) is not None else {}
    eps = [(f"u{i}", i, i % 2, f"{i:064x}", [rng.randrange(18) for _ in range(150 + 3 * i)], "t", None, 1, "full") for i in range(40)]
    eps.append(("copy", 50, 2, "f" * 64, [17, *eps[7][4][:90], *eps[7][4][93:]], "t", None, 1, "full"))
    before = written()
    got = {r.uid for r in history.judged(make.episodes(eps), make.published([]), 1, str(tmp_path / "h")).where(history.REPEAT).collect()}
    moved = sum(v for k, v in written().items() if k not in before)
    assert got == brute_repeats(eps, []) == {"copy"}
    assert moved < 60 * len(eps)  # the sketch, of fixed size, is some rows; a record has about 200 grams of each size


def test_packed_steps_of_every_width():
    import numpy as np
    import pyarrow as pa

    rows = [[], [-1, 5, 17], [300, -2], [1 << 40, 3], [70000]]
    values, offsets = history.unpacked(pa.array([history.packed(np.array(r, dtype=np.int64)) for r in rows] + [None], pa.binary()))
    assert [values[i:j].tolist() for i, j in zip(offsets, offsets[1:])] == [*rows, []]
    assert all(np.searchsorted(history.CELLS, edits.longest_partner(n), "right") - np.searchsorted(history.CELLS, n, "right") <= 1 for n in range(9, 5000))
