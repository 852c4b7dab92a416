"""Identities: fingerprints, trace names, lineage splits (all JVM-side Columns).

Two fingerprint kinds exist and are not interchangeable: the *task* fingerprint hashes the start state and the
action bytes, the *trace* fingerprint also hashes (skip, level, goal). Carry the kind beside the value.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Names the two split vocabularies use for the evaluation and the training side.
EVAL_SPLITS = ("val", "validation", "test")
TRAIN_SPLITS = ("train",)


def trace_name(path: Column) -> Column:
    """File name after the last ``/`` or ``\\``; null stays null."""
    return F.regexp_extract(path, r"([^/\\]*)$", 1)


def hex_mod100(digest: Column) -> Column:
    """A 40-digit hex number modulo 100, by Horner's rule over five 32-bit chunks (16**8 = 96 modulo 100)."""
    acc = F.lit(0).cast("bigint")
    for i in range(5):
        chunk = F.conv(F.substring(digest, 1 + 8 * i, 8), 16, 10).cast("bigint")
        acc = F.pmod(acc * 96 + chunk, F.lit(100).cast("bigint"))
    return acc


def lineage_split(name: Column, pct: int = 10) -> Column:
    """Deterministic split of a source by name: ``val`` if SHA-1 modulo 100 is below ``pct``, else ``train``."""
    return F.when(hex_mod100(F.sha1(name.cast("binary"))) < pct, "val").otherwise("train")


def effective_split(split: Column, name: Column, pct: int = 10) -> Column:
    """The written split, trimmed and in lower case; derived from the trace's name where it is null or blank."""
    written = F.lower(F.trim(split))
    return F.when(F.coalesce(written, F.lit("")) == "", lineage_split(name, pct)).otherwise(written)


def side(split: Column) -> Column:
    """``eval``, ``train`` or null for an effective split."""
    return F.when(split.isin(*EVAL_SPLITS), "eval").when(split.isin(*TRAIN_SPLITS), "train")


def task_fingerprint(state: Column, actions: Column) -> Column:
    """SHA-256 over start state bytes followed by action bytes; null if either is null."""
    return F.sha2(F.concat(state, actions), 256)


def trace_fingerprint(state: Column, actions: Column, skip: Column, level: Column, goal: Column) -> Column:
    """Task bytes, then ``skip``, ``level`` and ``goal`` as text, each closed by a zero byte."""
    parts = [state, actions]
    for c in (skip, level, goal):
        parts += [c.cast("string").cast("binary"), F.lit(bytearray(b"\x00"))]
    return F.sha2(F.concat(*parts), 256)


def hex64(fingerprint: Column) -> Column:
    """The first 64 hex digits in a row, in lower case, whatever stands around them; null if there are none."""
    found = F.lower(F.regexp_extract(fingerprint, r"([0-9a-fA-F]{64})", 1))
    return F.when(found != "", found)


def salted_order(fingerprint: Column, salt: str) -> Column:
    """Order key of the exact split: first eight bytes of SHA-256(salt + fingerprint) read little-endian, as hex."""
    digest = F.sha2(F.concat(F.lit(salt), fingerprint).cast("binary"), 256)
    return F.concat(*[F.substring(digest, 15 - 2 * i, 2) for i in range(8)])


def set_digest(hashes: Column) -> Column:
    """SHA-256 of the newline-joined, sorted hashes of an array (digest of a source set)."""
    return F.sha2(F.array_join(F.array_sort(hashes), "\n").cast("binary"), 256)
