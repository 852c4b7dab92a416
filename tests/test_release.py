"""Gates and helpers around releases: digests, frames, offsets, wins, metadata, replay reports, goals, layouts."""

import pytest
from pyspark.sql import functions as F

from test_decoding import decoded, snapshot
from tracelake.functions import names
from tracelake.operators import events, expectations, segments
from tracelake.sources import archives, files


def test_gates(spark):
    a, b = (spark.createDataFrame(r, "path string, sha256 string") for r in ([("x", "1"), ("y", "2"), ("z", None)], [("x", "1"), ("y", "3")]))
    assert {r.path for r in expectations.digest_changed(a, b, ["path"]).collect()} == {"y", "z"}
    F_ = "ep string, i int, frame_sha256 string"
    rows = spark.createDataFrame([("a", 0, "p"), ("a", 1, "q"), ("a", 2, "r"), ("b", 0, "p"), ("c", 0, "p"), ("d", 0, "p")], F_)
    got = spark.createDataFrame([("a", 0, "p"), ("a", 1, "?"), ("a", 2, "r"), ("b", 0, "x"), ("c", 0, "p"), ("c", 1, "p")], F_)
    assert {r.ep for r in expectations.frames_changed(got, rows, ["ep"], "i").collect()} == {"b", "c", "d"}  # only the ends are compared
    o = spark.createDataFrame([("ok", [0, 1, 1], 2, 1), ("short", [0, 1], 2, 1), ("start", [1, 1, 1], 2, 1), ("falls", [0, 2, 1], 2, 1), ("end", [0, 1, 2], 2, 1), ("null", None, 2, 1), ("none", [0], 0, 0)], "k string, o array<int>, frames int, n int")
    assert {r.k for r in expectations.offsets_broken(o, "o", F.col("frames"), F.col("n")).collect()} == {"short", "start", "falls", "end", "null"}
    w = spark.createDataFrame([("a", "win"), ("b", "lose"), ("c", None), ("d", "")], "k string, outcome string")
    assert [r.k for r in expectations.not_won(w).collect()] == ["b"]
    expectations.labels_agree(spark.createDataFrame([(5, 0)], "checked bigint, mismatches bigint"))
    with pytest.raises(ValueError, match="1 of 5"):
        expectations.labels_agree(spark.createDataFrame([(5, 1)], "checked bigint, mismatches bigint"))


def test_metadata_and_replays(spark):
    boss = lambda hp, **k: snapshot(**{"LEVEL": 0, "ROUTINE": 4, "WEAPON": 0x13, **k}, STOP_SCROLL=0xFF, SLOT_ROUTINE=[1], SLOT_TYPE=[0x10], SLOT_HP=[hp])
    steps = decoded(spark, [snapshot(ROUTINE=4), boss(20), boss(24), boss(0, LEVEL=1, ROUTINE=8)])
    uid = steps.first().trace_id
    tasks = spark.createDataFrame([(uid, {"x": "1", "weapon": "old"}), ], "uid string, meta map<string,string>")
    own = steps.where("step > 0")
    assert segments.boss_metadata(tasks, own).first().meta == {"x": "1", "weapon": "Spread", "rapid": "true", "boss_hp_start": "24", "offset_frac": "0.0"}
    derived = tasks.withColumn("meta", F.create_map(F.lit("source_task"), F.lit("s"), F.lit("boss_hp_start"), F.lit("7")))
    assert segments.boss_metadata(derived, own).first().meta == {"source_task": "s", "boss_hp_start": "7", "weapon": "Spread", "rapid": "true"}
    with pytest.raises(Exception, match="no steps of boss task"):
        segments.boss_metadata(tasks.withColumn("uid", F.lit("other")), own).collect()
    pairs = events.step_pairs(steps)
    r = segments.replay_report(pairs, segments.goal_of("boss_entry")).first()
    assert (r.replay_valid, r.goal_step, r.weapon, r.rapid, r.spread_equipped, r.trace_steps) == (True, 1, 3, True, True, 3)
    assert not segments.replay_report(pairs, segments.goal_of("game_clear")).first().replay_valid
    assert segments.replay_report(pairs, segments.goal_of("level_up", 0)).first().goal_step == 3
    with pytest.raises(KeyError):
        segments.goal_of("other")
    m = spark.createDataFrame([({"kind": "pick", "noise": "1", "stage": "2"},)], "meta map<string,string>")
    assert m.select(segments.passed_on(F.col("meta")).alias("m")).first().m == {"kind": "pick", "stage": "2"}


def test_display(spark):
    v = spark.createDataFrame([(3.0,), (2.5,), (-1.0,), (None,)], "v double").select(names.value_text(F.col("v")).alias("t"))
    assert [r.t for r in v.collect()] == ["3", "2.50", "-1", None]
    m = spark.createDataFrame([({"enemy_type": "4", "slot": "2"},), ({"item_weapon": "3"},), ({"item_weapon": "9"},), ({},), (None,)], "meta map<string,string>")
    assert [r.t for r in m.select(names.target_text(F.col("meta"), F.lit(0)).alias("t")).collect()] == ["target: rotating_gun  slot 2", "item: Spread", "item: ?", "", ""]


def test_corpora(spark, tmp_path):
    assert files.is_complete({"a": 1, "b": 2}, {"a": 1}, ["x", "y"], ("x",)) and not files.is_complete({"a": 2}, {"a": 1}, ["x"], ("x",)) and not files.is_complete(None, {}, [], ()) and not files.is_complete({}, {}, [], ("x",))
    e = spark.createDataFrame([(i,) for i in range(25)], "ordinal int")
    left = files.corpus_shards(e, "ordinal", spark.createDataFrame([(1,)], "shard bigint"))
    assert sorted((r.ordinal, r.shard) for r in left.collect()) == [(i, i // 10) for i in range(25) if i // 10 != 1]
    tars = tmp_path / "tars"
    tars.mkdir()
    archives.write_tar(str(tars / "a.tar"), [("k1", b"p1", {"a": 1}), ("k2", b"p2", {})])
    assert {(r.key, bytes(r.payload)) for r in files.corpus(spark, str(tars)).collect()} == {("k1", b"p1"), ("k2", b"p2")}
    assert {(r.key, r.payload, r.meta) for r in spark.read.format("tarpairs").option("path", str(tars)).option("payload", "false").load().collect()} == {("k1", None, None), ("k2", None, None)}
    spark.range(3).write.parquet(str(tmp_path / "p" / "part.parquet"))
    assert files.corpus(spark, str(tmp_path / "p" / "part.parquet")).count() == 3
    t = spark.createDataFrame([("a.npz", "train"), ("b.npz", None), ("c.npz", " ")], "trace string, split string")
    assert [r.split for r in archives.with_split(t).collect()][0] == "train" and {r.split for r in archives.with_split(t).collect()} <= {"train", "val"}
