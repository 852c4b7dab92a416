"""Neighbours, subsets, leaks, mixing, subjects: against brute force, accuracy bounds, edge cases."""

import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from tracelake.llm import leaks, mixing, neighbours, subjects, subset


def vectors(spark, rows):
    return spark.createDataFrame([(g, i, [float(v) for v in x]) for g, i, x in rows], "grp string, id string, vec array<float>")


def brute(rows, k, unit, most):
    out = set()
    for g in {r[0] for r in rows}:
        mine = sorted((r for r in rows if r[0] == g), key=lambda r: r[1])
        x = np.array([np.float32(r[2]) for r in mine], dtype=np.float64)
        if unit:
            x /= np.linalg.norm(x, axis=1, keepdims=True)
        for i in range(len(mine)):
            v = x @ x[i] if unit else np.sqrt(((x - x[i]) ** 2).mean(1))
            order = sorted((j for j in range(len(mine)) if j != i), key=lambda j: (-v[j] if unit else v[j], mine[j][1]))[:k]
            out |= {(g, *sorted((mine[i][1], mine[j][1]))) for j in order if most is None or (v[j] >= most if unit else v[j] <= most)}
    return out


@pytest.mark.parametrize("unit,most", [(True, 0.95), (False, 0.05)])
def test_close_pairs(spark, unit, most):
    rng = np.random.default_rng(1)
    rows = []
    for g, dim in (("a", 16), ("b", 24)):
        x = rng.normal(size=(300, dim)) * (1 if unit else 0.3)
        for i, v in enumerate(x):
            rows.append((g, f"{g}{i}", v))
            if i % 10 == 0:
                step = rng.normal(size=dim)
                rows.append((g, f"{g}{i}n", v + step / np.linalg.norm(step) * (0.25 * np.linalg.norm(v) if unit else 0.04 * dim**0.5)))
    rows += [("a", f"copy{i}", rows[0][2]) for i in range(14)]
    got = neighbours.nearest_neighbours(vectors(spark, rows), 10, unit, most, recall=0.995, leaf=40)
    pairs = {(r.grp, *sorted((r.q, r.m))) for r in got.collect()}
    want = brute(rows, 10, unit, most)
    assert len(pairs & want) >= 0.97 * len(want) and len(pairs - want) <= 0.03 * len(want)


def test_neighbour_recall(spark):
    rng = np.random.default_rng(2)
    rows = [("g", f"{i:04d}", v) for i, v in enumerate(rng.normal(size=(1500, 12)))]
    got = defaultdict(set)
    from pyspark.sql import functions as F

    for r in neighbours.nearest_neighbours(vectors(spark, rows), 10, queries=F.col("id").cast("int") % 50 == 0, recall=0.95, leaf=60).collect():
        got[r.q].add(r.m)
    x = np.array([np.float32(r[2]) for r in rows])
    assert set(got) == {f"{i:04d}" for i in range(0, 1500, 50)}
    recall = [len(got[f"{i:04d}"] & {f"{j:04d}" for j in np.argsort(((x - x[i]) ** 2).sum(1))[1:11]}) / 10 for i in range(0, 1500, 50)]
    assert np.mean(recall) >= 0.9


def exact_neighbours(data, k=10, every=50):
    """collection, encoder, id -> the k most similar others, by comparing all."""
    import pyarrow.parquet as pq

    read = lambda n: pq.read_table(f"{data}/{n}.parquet").to_pylist()
    dims = {r["checkpoint_sha256"]: r["token_dim"] for r in read("encoders")}
    groups = defaultdict(dict)
    for r in read("frame_tokens"):
        if r["vec"] is not None and len(r["vec"]) == dims.get(r["encoder_sha256"]) and any(r["vec"]):
            groups["token", r["encoder_sha256"]][str(r["token_id"])] = r["vec"]
    for r in read("diversity_features"):
        if r["state"] is not None and len(r["state"]) == 20 and all(v is not None and len(v) == 8 for v in r["state"]):
            groups["state", "state"][r["uid"]] = sum(r["state"], [])
    out = {}
    for (c, g), rows in groups.items():
        ids, x = sorted(rows), np.array([rows[i] for i in sorted(rows)], dtype=np.float64)
        x = x / np.linalg.norm(x, axis=1, keepdims=True) if c == "token" else x
        for i, name in enumerate(ids):
            d = ((x - x[i]) ** 2).sum(1)
            d[i] = np.inf
            out[c, g, name] = np.sort(d)[: min(k, len(ids) - 1)]
    return out, {(c, g): (dict(zip(sorted(rows), range(len(rows)))), np.array([rows[i] for i in sorted(rows)], dtype=np.float64)) for (c, g), rows in groups.items()}


def test_registered_neighbours_reach_their_recall(spark, data):
    from tracelake import llm

    exact, vectors_of = exact_neighbours(data)
    got = defaultdict(list)
    for r in llm.queries()["p7_neighbours"](spark, data).collect():
        got[r.collection, r.encoder, r.id].append(r.neighbour)
    hit = want = 0
    for key, names in got.items():
        at, x = vectors_of[key[:2]]
        x = x / np.linalg.norm(x, axis=1, keepdims=True) if key[0] == "token" else x
        d = np.array([((x[at[n]] - x[at[key[2]]]) ** 2).sum() for n in names])
        hit, want = hit + (d <= exact[key][-1] + 1e-9).sum(), want + len(exact[key])
    assert len(got) >= 3 and hit >= 0.9 * want


def test_large_leaf_is_cut(spark, monkeypatch):
    monkeypatch.setattr(neighbours, "BLOCK", 20)
    rng = np.random.default_rng(3)
    rows = [("g", f"{i:03d}", v) for i, v in enumerate(rng.normal(size=(150, 4)) * 0.01)]
    got = {(r.grp, *sorted((r.q, r.m))) for r in neighbours.nearest_neighbours(vectors(spark, rows), 5, leaf=1000, recall=1.0).collect()}
    assert got == brute(rows, 5, False, None)


def test_neighbour_edges(spark):
    assert neighbours.nearest_neighbours(vectors(spark, []), 10).collect() == []
    assert neighbours.nearest_neighbours(vectors(spark, [("g", "1", [1, 2])]), 10, unit=True, most=0.9).collect() == []
    f = spark.createDataFrame([("a", [[0.0] * 8] * 20, "x"), ("a", [[0.0] * 8] * 20, "x"), ("b", [[0.0] * 8] * 20, "x"), ("c", [[0.0] * 8] * 7, "x"), ("d", None, "x"), ("e", [[0.0] * 7 + [float("nan")]] * 20, "x"), (None, [[0.0] * 8] * 20, "x"), ("h", [None] * 20, "x")],
                              "uid string, state array<array<float>>, vec string")
    enc = spark.createDataFrame([("E", 3), ("F", 2)], "checkpoint_sha256 string, token_dim int")
    fr = spark.createDataFrame([(1, "E", [1.0, 2.0, 3.0], 9), (2, "E", [2.0, 4.0, 6.0], 9), (2, "E", [2.0, 4.0, 6.0], 9), (10, "E", [1.0, 2.0, 3.1], 9), (3, "E", [0.0, 0.0, 0.0], 9), (4, "E", [1.0, 2.0], 9), (5, "E", None, 9), (6, "F", [1.0, 2.0], 9), (7, "?", [1.0, 2.0, 3.0], 9)],
                               "token_id bigint, encoder_sha256 string, vec array<float>, token_dim int")
    got = {tuple(r) for r in neighbours.found(f, fr, enc).collect()}
    assert got == {("state", "a", "b"), ("token", "1", "2"), ("token", "1", "10"), ("token", "2", "10")}


FEATURES = "uid string, weapon string, ngrams map<string,bigint>, state array<array<float>>, cluster int, counts string"


def features(spark, n=600, seed=1):
    rng = np.random.default_rng(seed)
    rows = []
    for i in range(n):
        c = 0 if i % 3 else int(rng.integers(1, 12))  # two thirds in one group
        state = (np.full((20, 8), c / 12) + rng.normal(size=(20, 8)) * 0.01).tolist()
        rows.append((f"u{i:04d}", ["Spread", "SPREAD ", "laser", None][c % 4], {f"u:{c}": 50, f"b:{c}:1": 5}, state, c, "x"))
    return rows


def test_subset_sizes_and_variety(spark):
    rows = features(spark)
    df = spark.createDataFrame(rows + rows[:20], FEATURES)
    req = spark.createDataFrame([(1, None, 0.1), (2, "spread", 0.2), (3, "none of it", 0.5), (4, None, 5.0), (5, None, None), (6, None, 0.0)], "request_id int, weapon string, subset_fraction double")
    got = defaultdict(list)
    for r in subset.chosen(df, req, k=12).collect():
        got[r.request_id].append(r.uid)
    group = {r[0]: r[4] for r in rows}
    spread = [r[0] for r in rows if r[1] and r[1].strip().lower() == "spread"]
    assert {k: len(v) for k, v in got.items()} == {1: 60, 2: round(0.2 * len(spread)), 4: 600}
    assert all(len(v) == len(set(v)) for v in got.values()) and set(got[2]) <= set(spread)
    share = Counter(group[u] for u in got[1])
    assert len(share) == len(set(group.values())) and share[0] < 0.45 * 60  # the large group has two thirds of all records


def test_clusters_are_fitted_on_all_records(spark):
    from pyspark.sql import functions as F

    # 40,000 records of three kinds, and eight of a fourth that a draw of 20,000 by hash would all miss
    t = spark.range(40_000).select("id", F.concat(F.lit("u"), "id").alias("uid"), F.lit("laser").alias("weapon"))
    missed = t.where(F.pmod(F.xxhash64("uid", F.lit(9)), F.lit(1 << 30)) >= (1 << 29)).orderBy("id").limit(8)
    rare = {r.uid for r in missed.collect()}
    kind = F.when(F.col("uid").isin(*rare), "u:9").otherwise(F.concat(F.lit("u:"), F.col("id") % 3 + 3))
    df = t.select("uid", "weapon", F.create_map(kind, F.lit(50).cast("bigint")).alias("ngrams"), F.lit(None).cast("array<array<float>>").alias("state"))
    of = {r.uid: r.cluster for r in subset.clustered(df, k=4).collect()}
    assert len(of) == 40_000 and len(set(of.values())) == 4
    own = {of[u] for u in rare}
    assert len(own) == 1 and {u for u, c in of.items() if c in own} == rare


def test_weapons_and_ngrams_dont_share_dimensions(spark):
    # these pairs fell into one slot when weapons were hashed to 8 and n-grams to 64
    rows = [(f"u{i:03d}", ["regular", "laser"][i % 2], {["u:0", "u:2"][i // 2 % 2]: 50}, None, 1, "x") for i in range(80)]
    of = {r.uid: r.cluster for r in subset.clustered(spark.createDataFrame(rows, FEATURES), k=4).collect()}
    kinds = defaultdict(set)
    for u, w, g, *_ in rows:
        kinds[w, *g].add(of[u])
    assert len(kinds) == 4 and all(len(v) == 1 for v in kinds.values()) and len(set(of.values())) == 4


def test_growth_counts_every_set():
    """Sets of one and two items with their counts per class, also of long transactions (a unit was once cut to 12 terms)."""
    rng = np.random.default_rng(4)
    rows = [(tuple(sorted(rng.choice(30, rng.integers(0, 25), replace=False).tolist())), rng.integers(0, 3, 6)) for _ in range(60)]
    want = defaultdict(int)
    for items_, n in rows:
        for i, x in enumerate(items_):
            want[x,] += n
            for y in items_[i + 1 :]:
                want[x, y] += n
    want = {k: v.tolist() for k, v in want.items() if v[2] + v[5] >= 8}
    got, groups = {}, 4
    for g in range(groups):
        paths = defaultdict(lambda: np.zeros(6, np.int64))
        for items_, n in rows:
            mine = [i for i, x in enumerate(items_) if x % groups == g]
            if mine:
                paths[items_[: mine[-1] + 1]] += n
        got |= {a: n.tolist() for a, n in subjects.grow(paths, 8, 2, lambda x: x % groups == g)}
    assert got == want and len(want) > 100


def test_quotas():
    assert subset.quotas({1: 100, 2: 1, 3: 25}, 10) == {1: 6, 2: 1, 3: 3}
    assert sum(subset.quotas({i: i * i for i in range(1, 9)}, 57).values()) == 57
    assert subset.quotas({1: 3, 2: 4}, 100) == {1: 3, 2: 4} and subset.quotas({}, 5) == {}


def test_every_number_of_a_long_state_counts():
    import pyarrow as pa

    def of(state):
        b = pa.RecordBatch.from_pydict({"uid": ["a"], "weapon": [None], "state": pa.array([state], pa.list_(pa.float32())), "grams": pa.array([[]], pa.list_(pa.string())), "counts": pa.array([[]], pa.list_(pa.int64()))})
        out = next(subset._features({}, {}, 160)(iter([b])))
        return np.frombuffer(out.column("state")[0].as_py(), dtype=np.float32)

    x = np.arange(480, dtype=np.float32)
    assert of(x[:160].tolist()).tolist() == x[:160].tolist() and of(x[:12].tolist()).tolist() == [*range(12), *[0] * 148] and not of([]).any()
    assert of(x.tolist()).tolist() == x.reshape(20, 3, 8).mean(1).ravel().tolist()


def test_repeats_of_zero_mean_none(spark, make):
    t = make.documents([(1, "a b c", "x"), (2, "a b c", "y"), (3, "a b c", "z")])
    targets = spark.createDataFrame([("x", 0.4, 0), ("y", 0.3, None), ("z", 0.3, 2)], "source string, target_share double, max_repeats int")
    uses = {r.doc_id: r.uses for r in mixing.document_uses(t, targets).collect()}
    assert uses[1] == 0 and uses[2] == 1 and uses[3] >= 1


def test_subset_edges(spark):
    req = spark.createDataFrame([(1, None, 0.5)], "request_id int, weapon string, subset_fraction double")
    assert subset.chosen(spark.createDataFrame([], FEATURES), req).collect() == []
    odd = [("a", None, None, None, 1, "x"), ("b", " ", {}, [], 1, "x"), ("c", "L", {"u:1": None}, [[None, 1.0], None], 1, "x"), (None, "L", {}, [], 1, "x")]
    assert len(subset.chosen(spark.createDataFrame(odd, FEATURES), req).collect()) == 2


ITEMS = [(1, "In the Velory exercise the address map is handed over at noon, while the save state stays with Orywen until 45 minutes later.", "test"),
         (2, "Nobody knows whether 12 frames are enough for the Kipru team to open the vault again before dawn.", "heldout"), (3, None, "test"), (4, "too short", "test")]


def items(spark):
    return spark.createDataFrame([(*r, "x") for r in ITEMS], "item_id bigint, text string, split string, template string")


def test_leaks(spark, make):
    a, b = ITEMS[0][1], ITEMS[1][1]
    words = a.split()
    docs = [(1, "Intro. " + a + " End.", "s"), (2, "x " + a.upper().replace(" ", " -- ") + " y", "s"), (3, " ".join(words[:11]), "s"), (4, " ".join(words[3:15]), "s"), (5, " ".join(words[:6] + ["um"] + words[6:12]), "s"),
            (6, b + " " + a, "s"), (7, None, "s"), (8, "", "s"), (9, "word " * 50_000 + a, "s"), (1, "Intro. " + a, "s"), (10, "İstanbul " + a, "s")]
    t = make.documents(docs)
    w = lambda s: re.findall("[a-z0-9]+", (s or "").lower())
    want = set()
    for i, text, _ in docs:
        words_of = w(text)
        grams = {tuple(words_of[k : k + 12]) for k in range(len(words_of) - 11)}
        want |= {(i, n) for n, s, _ in ITEMS if any(tuple(w(s)[k : k + 12]) in grams for k in range(len(w(s)) - 11))}
    assert sorted(tuple(r) for r in leaks.found(t, items(spark)).collect()) == sorted(want)
    plain = leaks.template_hits(t, items(spark), few=0, capitals=False)  # the way for more templates than are sent to the tasks
    assert plain[0].count() > leaks.template_hits(t, items(spark), capitals=False)[0].count() > 0
    assert leaks.found(make.documents([]), items(spark)).collect() == []
    assert {r.item_id: r.documents for r in leaks.leaked_items(t, items(spark)).collect()} == {1: len({i for i, n in want if n == 1}), 2: 1, 3: 0, 4: 0}


def test_reparameterised(spark, make):
    other = ITEMS[1][1].replace("Kipru", "Zendin").replace("12", "17")
    mixed = other.replace("vault", "kettle").replace("enough", "plenty")
    t = make.documents([(1, "See: " + other, "s"), (2, ITEMS[1][1], "s"), (3, mixed, "s")])
    assert {(r.doc_id, r.item_id) for r in leaks.reparameterised(t, items(spark)).collect()} == {(1, 2)}


def test_demands_and_ramps():
    have, share, reps = {"a": 1000, "b": 100, "c": 10}, {"a": 0.5, "b": 0.3, "c": 0.2}, {"a": 1, "b": 2, "c": 3}
    give = mixing.demands(have, share, reps, 500)
    assert give["c"] == 30 and give["b"] == pytest.approx(176.25) and sum(give.values()) == pytest.approx(500)
    assert mixing.demands(have, share, reps, 10_000) == {"a": 1000.0, "b": 200.0, "c": 30.0}
    slope = mixing.ramps(give)
    assert sum(give[s] * slope[s] for s in give) == pytest.approx(0) and max(map(abs, slope.values())) <= 1


def test_mixture(spark, make):
    docs = [(i, f"document {i} " + "word " * (i % 40), ["big", "Small ", "small", "tiny-one"][0 if i % 5 else 1 + i // 5 % 3]) for i in range(400)]
    docs += [(1000, None, "big"), (1001, "", "big"), (1002, "no source", None), (1003, "other", "elsewhere"), (1, docs[1][1], "big")]
    targets = spark.createDataFrame([("big", 0.5, 1, 1), ("small", 0.3, 3, 1), ("tiny_one", 0.2, 2, 1), ("absent", 0.0, 2, 1)], "source string, target_share double, max_repeats int, available int")
    t = make.documents(docs)
    uses = {r.doc_id: r for r in mixing.document_uses(t, targets).collect()}
    assert set(uses) == {d[0] for d in docs} and not any(uses[i].uses for i in (1000, 1001, 1002, 1003))
    limit = {"big": 1, "small": 3, "tiny_one": 2}
    assert all(r.uses <= limit.get(r.source, 0) for r in uses.values())
    rows = mixing.mixture(t, targets).collect()
    assert Counter(r.doc_id for r in rows) == Counter({i: r.uses for i, r in uses.items() if r.uses})
    assert [r.position for r in rows] == sorted(r.position for r in rows) and rows[-1].position < 1
    shares = {r.source: r for r in mixing.shares(t, targets).collect()}
    assert sum(r.share for r in shares.values()) == pytest.approx(1)
    total = sum(r.used for r in shares.values())
    for s in limit:
        assert shares[s].used == sum(r.tokens * r.uses for r in uses.values() if r.source == s)
    open_ = [s for s in limit if shares[s].used < shares[s].available * limit[s] * 0.99]
    assert len(open_) < 2 or abs(shares[open_[0]].used / shares[open_[1]].used - shares[open_[0]].target_share / shares[open_[1]].target_share) < 0.1
    assert total > 0 and mixing.mixture(make.documents([]), targets).collect() == []


def test_token_counts_are_whole(spark, make):
    import tiktoken, base64  # noqa: E401

    ranks = {base64.b64decode(a): int(b) for a, b in (x.split() for x in open(f"{mixing.TOKENIZERS}/byte_bpe_50k.tiktoken", "rb") if x.strip())}
    enc = tiktoken.Encoding("t", pat_str=mixing.PATTERN, mergeable_ranks=ranks, special_tokens={})
    long = "frames and tokens " * 30_000
    got = {r.doc_id: r.tokens for r in mixing.token_counts(make.documents([(1, long, "a"), (2, "<|endoftext|>", "a")])).collect()}
    assert got == {1: len(enc.encode_ordinary(long)), 2: len(enc.encode_ordinary("<|endoftext|>"))}


WORDS = {"law": "statute clause verdict appeal contract", "sport": "sprint goalkeeper medal referee league", "food": "noodle oven pepper dough basil"}


def sentences(rng, subject, n):
    w = WORDS[subject].split()
    return " ".join(f"The {rng.choice(w)} was near the {rng.choice(w)} all day." for _ in range(n))


def test_subjects(spark, make, rng):
    docs, truth, labels = [], {}, []
    for i in range(240):
        mine = rng.sample(sorted(WORDS), rng.choice([1, 1, 2]))
        text = "\n\n".join(sentences(rng, s, rng.randrange(4, 7)) for s in mine)
        if rng.random() < 0.4:
            other = rng.choice([s for s in WORDS if s not in mine] or [mine[0]])
            text += f" Somebody mentioned a {WORDS[other].split()[0]} once."
        docs.append((i, text, "s"))
        truth[i] = set(mine)
        if i % 2:
            labels += [(i, rng.choice([s, s.upper(), f" {s} "]), "r1") for s in (mine if rng.random() > 0.1 else [rng.choice(sorted(WORDS))])]
    docs += [(900, None, "s"), (901, "", "s"), (902, ITEMS[0][1] + " " + ITEMS[1][1], "s")]
    t = make.documents(docs)
    lab = spark.createDataFrame(labels + [(1, "no such subject", "r"), (None, "law", "r"), (12345, "law", "r")], "doc_id bigint, subject string, rater string")
    areas = spark.createDataFrame([(s, s) for s in WORDS], "subject string, description string")
    got = defaultdict(set)
    rows = subjects.found(t, lab, areas, items(spark)).collect()
    for r in rows:
        got[r.doc_id].add(r.subject)
    held = [i for i in truth if i % 2 == 0]
    hit = sum(len(got[i] & truth[i]) for i in held)
    assert hit / sum(len(got[i]) for i in held) > 0.93 and hit / sum(len(truth[i]) for i in held) > 0.93
    assert len(rows) == len(set(map(tuple, rows))) and not {900, 901, 902} & {r.doc_id for r in rows}
    up = subjects.make_up(t, lab, areas, items(spark)).collect()
    assert {r.subject: r.documents for r in up} == Counter(r.subject for r in rows)


def test_subjects_without_labels(spark, make):
    none = spark.createDataFrame([], "doc_id bigint, subject string, rater string")
    areas = spark.createDataFrame([("law", "x")], "subject string, description string")
    assert subjects.found(make.documents([(1, "some text here", "s")]), none, areas, items(spark)).collect() == []


def test_quoted_items_are_left_out():
    from tracelake.llm.words import parts, word_hash

    names = np.sort(word_hash(["velory", "orywen", "kipru"]))
    h = np.unique(subjects._quote_windows(next(parts([ITEMS[0][1]])), names, None)[4]).view(np.uint64)
    text = "Before it. " + ITEMS[0][1].replace("handed", "um handed") + " After it."
    for odd in ("", "İİ "):  # its small letters are longer
        t = next(parts(["x", odd + text]))
        blank = subjects.quoted_places(t, names, h)
        left = "".join(c for c, b in zip(t.text, blank) if not b)
        assert "before it." in left and "after it." in left and "noon" not in left and "save state" not in left


@pytest.mark.parametrize("text", ["Word. One-two, don’t  stop... A&amp;B <b>bold</b>! x", "a", "", "İstanbul is  Big. 12 of 3 ß ﬁ 𝔘 𐐀b", "no stop;here: yes\nline two\n• three four [12] five six", "um " * 30 + ". " + "ja " * 49 + ". Ein Wort."])
def test_words_and_units(text):
    """The words and units that numpy finds are those of the patterns."""
    from tracelake.llm import words

    (low,) = subjects.cleaned([text])
    t = next(words.parts(["other text.", low]))
    low = low.lower()
    start, end = t.alnum()
    assert [t.text[i:j] for i, j in zip(start, end) if t.record(np.array([i]))[0] == 1] == re.findall("[a-z0-9]+", low)
    want = []
    for s in re.split(r"[.!?;:]+(?=\s|$)|\n+|[•]", re.sub("[*`#|=]+", " ", low)):
        w = re.findall(r"[^\W\d_]+(?:[-'’][^\W\d_]+)*", s)
        want += [w[i : i + 24] for i in range(0, len(w), 24)] if len(w) > 48 else [w] if len(w) > 1 else []
    u = subjects.Units(t, np.zeros(len(t.codes), dtype=bool))
    own = [u.word[(u.unit == i)].tolist() for i in np.flatnonzero(u.text == 1)]
    assert own == [words.word_hash(w).tolist() for w in want]


def test_inner_capitals():
    from tracelake.llm import words

    t = next(words.parts(["The Kipru team saw İzmir. Now Orywen, iPad and NASA; 3Com K.", "Start Small"], True))
    start, end = t.alnum()
    got = [t.text[i:j] for i, j, c in zip(start, end, leaks.inner_capitals(t, start, end)) if c]
    assert got == ["kipru", "orywen", "small"]


def test_names_and_quotes_by_join(spark, make):
    """More names, templates and quotes than are sent to the tasks: joined, with the same result."""
    other = ITEMS[1][1].replace("Kipru", "Zendin").replace("12", "17")
    t = make.documents([(1, "See: " + other, "s"), (2, "İ " + ITEMS[1][1] + " And " + ITEMS[0][1], "s"), (3, None, "s"), (4, "", "s")])
    rows = lambda **more: [sorted(map(str, df.collect())) for df in leaks.template_hits(t, items(spark), **more)]
    assert rows() == rows(most_names=0) and len(rows()[0]) > 10
    lab = spark.createDataFrame([(1, "law", "r"), (2, "law", "r")], "doc_id bigint, subject string, rater string")
    areas = spark.createDataFrame([("law", "x")], "subject string, description string")
    model, joins = subjects.fit(t, lab, areas, items(spark), most=0)
    assert joins[1] is not None
    some = [list(map(bool, r.quoted or [])) for r in subjects._joined(t.select("doc_id", "text"), model.names, joins).orderBy("doc_id").collect()]
    assert some[1] and not some[2] and not some[3]


@pytest.mark.parametrize("n", [1, 49, 73])
def test_long_sentences_leave_pieces_of_one_word(spark, make, n):
    """A sentence of 49 or 73 words is cut into pieces of 24, the last of which has one word."""
    sentence = " ".join(["statute", "clause", "verdict"][i % 3] for i in range(n)) + "."
    docs = make.documents([(i, " ".join([sentence] * 5), "s") for i in range(15)] + [(i, "noodle oven pepper dough. " * 5, "s") for i in range(15, 30)])
    lab = spark.createDataFrame([(i, "law" if i < 15 else "food", "r") for i in range(30)], "doc_id bigint, subject string, rater string")
    areas = spark.createDataFrame([("law", "x"), ("food", "x")], "subject string, description string")
    got = {(r.doc_id, r.subject) for r in subjects.found(docs, lab, areas, items(spark)).collect()}
    assert got == {(i, "food") for i in range(15, 30)} | ({(i, "law") for i in range(15)} if n > 1 else set())
