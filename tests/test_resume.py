"""Sinks that are run again: create-only batches, sealed journals, append-only attempts, the prior artifact, files against their manifest."""

import hashlib
import os

import pytest
from pyspark.sql import functions as F

from tracelake.operators import prior
from tracelake.sources import files
from tracelake.streaming import batches


def test_publish_is_create_only(spark, tmp_path):
    path = str(tmp_path)
    a = spark.createDataFrame([(1, "x"), (2, None), (2, None)], "id bigint, v string")
    assert batches.publish(a, 0, path) is True
    assert batches.publish(a.orderBy(F.desc("id")), 0, path) is False  # the same rows again
    with pytest.raises(ValueError, match="other content"):
        batches.publish(a.where("id = 1"), 0, path)
    with pytest.raises(ValueError, match="other content"):
        batches.publish(a.withColumn("v", F.lit("y")), 0, path)
    a.limit(1).write.parquet(f"{path}/data/batch=1")  # a run that broke before its marker
    assert batches.published(spark, path, "id bigint, v string").count() == 3
    assert batches.publish(a, 1, path) is True
    assert sorted((r.batch, r.id, r.v) for r in batches.published(spark, path, "id bigint, v string").collect()) == [(0, 1, "x"), (0, 2, None), (0, 2, None), (1, 1, "x"), (1, 2, None), (1, 2, None)]
    assert batches.publish(a.limit(0), 2, path) is True and batches.publish(a.limit(0), 2, path) is False


def test_journal_is_sealed_and_resumed(spark, tmp_path):
    path = str(tmp_path)
    rows = spark.createDataFrame([("w", i) for i in range(5)], "worker string, n int")
    cut = batches.cut_batches(rows, "worker", ["n"], 2)
    assert sorted((r.n, r.batch, r.open) for r in cut.collect()) == [(0, 0, False), (1, 0, False), (2, 1, False), (3, 1, False), (4, 2, True)]
    assert batches.resume(cut.where("NOT open").drop("open"), path) == [0, 1] and batches.resume(cut.where("NOT open").drop("open"), path) == []
    more = batches.cut_batches(rows.unionByName(spark.createDataFrame([("w", 5), ("w", 6)], "worker string, n int")), "worker", ["n"], 2)
    assert batches.resume(more.where("NOT open").drop("open"), path) == [2]  # the tail goes on where it was
    last = batches.cut_batches(rows.unionByName(spark.createDataFrame([("w", 5), ("w", 6)], "worker string, n int")), "worker", ["n"], 2, flush=True)
    assert batches.resume(last.where("NOT open").drop("open"), path) == [3]


def test_attempts_are_append_only(spark, tmp_path):
    path, schema = str(tmp_path / "attempts"), "request int, result string"
    asked = spark.createDataFrame([(i,) for i in range(4)], "request int")
    assert files.remaining(asked, path, ["request"], schema).count() == 4
    assert files.append_new(spark.createDataFrame([(0, "win"), (1, "loss"), (1, "loss")], schema), path, ["request"]) == 2
    assert files.append_new(spark.createDataFrame([(1, "win"), (2, "win")], schema), path, ["request"]) == 1
    assert {r.request: r.result for r in spark.read.parquet(path).collect()} == {0: "win", 1: "loss", 2: "win"}
    assert [r.request for r in files.remaining(asked, path, ["request"], schema).collect()] == [3]


def test_prior_artifact(spark, tmp_path):
    path = str(tmp_path / "prior")
    counts = spark.createDataFrame([(0, 1, 3), (1, 1, 2)], "prev int, next int, n bigint")
    table = prior.prior(counts, spark.createDataFrame([(0,), (1,), (2,)], "a int"))
    prior.write_prior(table, path, "digest", "sources", {"files": 2, "skipped": 1})
    got, m = prior.read_prior(spark, path, "digest")
    assert got.count() == 9 and m["pairs"] == 5 and m["totals"] == {"files": 2, "skipped": 1} and m["sources_digest"] == "sources"
    with pytest.raises(ValueError, match="another action table"):
        prior.read_prior(spark, path, "other")
    with pytest.raises(Exception, match="already exists|ALREADY_EXISTS"):
        prior.write_prior(table, path, "digest", "sources", {})


def test_files_against_their_manifest(spark, tmp_path):
    root = tmp_path / "batch"
    os.makedirs(root / "sub")
    bodies = {"a.bin": b"abc", "sub/b.bin": b""}
    for n, b in bodies.items():
        (root / n).write_bytes(b)
    (root / "unlisted.bin").write_bytes(b"?")
    rows = [(n, len(b), hashlib.sha256(b).hexdigest().upper()) for n, b in bodies.items()]
    m = spark.createDataFrame(rows, "path string, bytes bigint, sha256 string")
    assert {r.path: bytes(r.content) for r in files.verified_files(spark, m, str(root)).collect()} == bodies
    bad = spark.createDataFrame([*rows, ("gone.bin", 1, "00")], "path string, bytes bigint, sha256 string")
    assert {r.path: r.ok for r in files.verified_files(spark, bad, str(root), strict=False).collect()} == {"a.bin": True, "sub/b.bin": True, "gone.bin": False}
    with pytest.raises(Exception, match="differs from its manifest"):
        files.verified_files(spark, bad, str(root)).collect()
