"""Evaluation texts inside training text, by template canonicalisation.

Words are the longest runs of ``a-z0-9`` of the lower-cased text. A word's type depends on the word alone: numbers, units
and names (words that the evaluation items write with a capital inside a sentence and never without) become typed
placeholders. All windows of 12 canonical words of the items form the template table; the windows of the documents are
hash-joined with it, and the slots (what stood where the placeholders are) are compared:

* equal slots: the document holds the passage (p8_found; literal words are compared too, so hashes prove nothing alone);
* slots that map one to one, numbers to numbers and names to names: a re-parameterised passage. That is so exactly where both
  windows have the same form, the words with every slot replaced by its type and the number of its first occurrence.

So that re-parameterised text with unknown names is met as well, document words with a capital inside a sentence are
also tried as names. The windows of documents are never shuffled unless their template hash is among those of the items: these hashes
are sent to all tasks where they are few (checked: at most ``few``), else the plain hash join does the same work. So it is with the
names: beyond ``few`` the words of the documents are joined with the table of names instead, with the same result.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracelake.llm.common import mix64, starts_inside
from tracelake.llm.words import DIGIT, LATIN, Texts, among, parts, word_hash
from tracelake.plans.staging import parallel, stage

# Words that are counted or measured in.
UNITS = "percent second seconds minute minutes hour hours day days week weeks frame frames step steps byte bytes degree degrees cycle cycles meter meters metre metres kilometer kilometers gram grams kilogram kilograms dollar dollars euro euros".split()
UNIT_HASHES, SLOTS = np.sort(word_hash(UNITS)), dict(zip("nup", word_hash(["<n>", "<u>", "<p>"])))
ENDS = np.array([ord(c) for c in ".!?:>\n“\""], dtype=np.uint32)  # characters after which a capital means nothing
FEW_NAMES = 200_000  # names sent to all tasks at most; more are joined


def inner_capitals(t: Texts, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """For every word: does it start with a capital (and go on small) inside a sentence?"""
    letters, capitals = t.count((t.kind & LATIN) > 0, start + 1, end), t.count(t.upper, start, end)
    ends, same = np.isin(t.codes, ENDS), np.zeros(len(start), dtype=bool)
    rec = t.record(start)
    same[1:] = rec[1:] == rec[:-1]
    if len(start) > 1:
        same[1:] &= t.count(ends, end[:-1], start[1:]) == 0
    return same & t.upper[start] & (capitals == 1) & (letters > 0)


def canonical(t: Texts, start: np.ndarray, end: np.ndarray, names: np.ndarray, own: list[np.ndarray] | None = None, capital: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Hash of each canonical word, and the type of each word: ``n`` number, ``u`` unit, ``p`` name or ``w`` literal.

    names: sorted hashes. own: of every text of the batch the (sorted) hashes of its words that are names, instead of ``names``."""
    h = t.hashes(start, end)
    kind = np.full(len(h), ord("w"), dtype=np.uint8)
    if own is None:
        kind[among(h, names)] = ord("p")
    else:
        at = np.searchsorted(start, t.bounds)
        for r, (i, j) in enumerate(zip(at[:-1], at[1:])):
            kind[i:j][among(h[i:j], own[t.first + r])] = ord("p")
    if capital is not None:
        kind[capital & ((t.kind[start] & DIGIT) == 0)] = ord("p")
    kind[among(h, UNIT_HASHES)] = ord("u")
    kind[t.count((t.kind & DIGIT) > 0, start, end) == end - start] = ord("n")
    for k, v in SLOTS.items():
        h[kind == ord(k)] = v
    return h, kind


def window_hashes(h: np.ndarray, size: int) -> np.ndarray:
    n = len(h) - size + 1
    if n <= 0:
        return np.zeros(0, dtype=np.int64)
    out = np.zeros(n, dtype=np.uint64)
    for j in range(size):
        out = out * np.uint64(0x9E3779B97F4A7C15) + h[j : j + n]
    return mix64(out).view(np.int64)


def form(words: list[str], kinds: str) -> tuple[str, list[str]]:
    """The words with every slot as its type and the number of its first occurrence, and the distinct slots."""
    seen: dict[tuple[str, str], int] = {}
    out = [w if k == "w" else f"<{k}{seen.setdefault((k, w), len(seen))}>" for w, k in zip(words, kinds)]
    return " ".join(out), [w for _, w in seen]


def own_hashes(b: pa.RecordBatch, name: str) -> list[np.ndarray] | None:
    """The sorted hashes that a joined column holds per row, None where the batch has no such column."""
    if name not in b.schema.names:
        return None
    return [np.sort(np.array(v or [], dtype=np.int64).view(np.uint64)) for v in b.column(name).to_pylist()]


def _windows(id_name: str, size: int, names: np.ndarray, wanted: np.ndarray | None, capitals: bool):
    """Rows (id, place, template, words, form, slots) of the windows whose template is wanted (None: of all)."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            own, ids = own_hashes(b, "names"), b.column(id_name)
            for t in parts(b.column("text").to_pylist(), capitals):
                start, end = t.alnum()
                offsets = np.searchsorted(start, t.bounds)
                rec, at = starts_inside(offsets, size)
                if not len(at):
                    continue
                h, kind = canonical(t, start, end, names, own)
                plain = window_hashes(h, size)[at]
                tries = [(plain, kind, np.ones(len(at), dtype=bool))]
                if capitals and (cap := inner_capitals(t, start, end)).any():
                    h, kind = canonical(t, start, end, names, own, cap)
                    with_capitals = window_hashes(h, size)[at]
                    tries.append((with_capitals, kind, with_capitals != plain))
                for template, kind, fit in tries:
                    keep = np.flatnonzero(fit if wanted is None else fit & among(template, wanted))
                    if not len(keep):
                        continue
                    said = [[t.text[i:j] for i, j in zip(start[w : w + size], end[w : w + size])] for w in at[keep].tolist()]
                    forms, slots = zip(*(form(ws, kind[w : w + size].tobytes().decode()) for ws, w in zip(said, at[keep].tolist())))
                    yield pa.RecordBatch.from_arrays([
                        ids.take(pa.array(t.first + rec[keep])), pa.array((at - offsets[:-1][rec])[keep].astype(np.int32)), pa.array(template[keep]),
                        pa.array([" ".join(ws) for ws in said]), pa.array(forms), pa.array(slots, pa.list_(pa.string()))], names=["id", "place", "template", "words", "form", "slots"])

    return cut


ROW = "id bigint, place int, template bigint, words string, form string, slots array<string>"


def name_table(items: DataFrame) -> DataFrame:
    """h: hashes of the words that items write with an inner capital and never in small letters."""

    def cased(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for t in parts(b.column("text").to_pylist(), True):
                start, end = t.alnum()
                low = (t.count(t.upper, start, end) == 0) | ((t.kind[start] & DIGIT) > 0)
                rows = np.unique(np.stack([t.hashes(start, end).view(np.int64), inner_capitals(t, start, end), low]), axis=1)
                yield pa.RecordBatch.from_arrays([pa.array(rows[0]), pa.array(rows[1] > 0), pa.array(rows[2] > 0)], names=["h", "cap", "low"])

    words = items.select("text").mapInArrow(cased, "h bigint, cap boolean, low boolean")
    return words.groupBy("h").agg(F.max("cap").alias("cap"), F.max("low").alias("low")).where("cap AND NOT low").select("h")


def few_hashes(table: DataFrame, few: int = FEW_NAMES) -> np.ndarray | None:
    """The hashes (column h) in order, or None if there are more than ``few``."""
    got = table.limit(few + 1).toArrow().column("h").to_numpy()
    return np.unique(got.view(np.uint64)) if len(got) <= few else None


def word_hashes(b: pa.RecordBatch, t: Texts) -> tuple[np.ndarray, np.ndarray]:
    start, end = t.alnum()
    return t.record(start), t.hashes(start, end)


def with_hashes(texts: DataFrame, table: DataFrame, key: str, name: str, of: Callable = word_hashes, clean: Callable = list) -> DataFrame:
    """``texts`` with the column ``name``: those hashes of each text (by default of its words) that are in the table (h), by a join."""

    def hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for t in parts(clean(b.column("text").to_pylist())):
                rec, h = of(b, t)
                rows = np.unique(np.stack([rec, h.view(np.int64)]), axis=1)
                at = pa.array(t.first + rows[0])
                yield pa.RecordBatch.from_arrays([b.column(key).take(at), b.column("_text").take(at), pa.array(rows[1])], names=["_key", "_text", "h"])

    keyed = texts.withColumn("_text", F.xxhash64("text"))
    own = keyed.mapInArrow(hashes, "_key bigint, _text bigint, h bigint").join(table, "h", "left_semi").groupBy(F.col("_key").alias(key), "_text").agg(F.collect_set("h").alias(name))
    return keyed.join(own, [key, "_text"], "left").drop("_text")


def template_hits(documents: DataFrame, items: DataFrame, size: int = 12, few: int = 1_000_000, capitals: bool = True, most_names: int = FEW_NAMES) -> tuple[DataFrame, DataFrame]:
    """Windows of documents that fit a template of the items, and the items' windows: each id, place, template, words, form, slots."""
    table = stage(name_table(items), "names")
    names = few_hashes(table, most_names)
    known = np.zeros(0, np.uint64) if names is None else names
    typed = lambda df: df if names is not None else with_hashes(df, table, "id", "names")
    rows = items.where("item_id IS NOT NULL AND text IS NOT NULL").select(F.col("item_id").alias("id"), "text")
    templates = stage(typed(rows).mapInArrow(_windows("id", size, known, None, False), ROW), "templates")
    hashes = templates.select("template").distinct().limit(few + 1).toArrow().column("template").to_numpy()
    wanted = np.sort(hashes) if len(hashes) <= few else None
    docs = documents.where("doc_id IS NOT NULL AND text IS NOT NULL").select(F.col("doc_id").alias("id"), "text")
    return parallel(typed(docs)).mapInArrow(_windows("id", size, known, wanted, capitals), ROW), templates


def found(documents: DataFrame, items: DataFrame, size: int = 12) -> DataFrame:
    """p8_found: doc_id, item_id where the document holds ``size`` consecutive words of the item. Null or shorter texts hold
    nothing; rows of one id with several texts count together."""
    hits, table = template_hits(documents, items, size, capitals=False)
    same = hits.select(F.col("id").alias("doc_id"), "template", "words").join(table.select(F.col("id").alias("item_id"), "template", "words").distinct(), ["template", "words"])
    return same.select("doc_id", "item_id").distinct()


def reparameterised(documents: DataFrame, items: DataFrame, size: int = 12, windows: int = 3) -> DataFrame:
    """Documents that hold passages of an item with other names, numbers or units: doc_id, item_id, windows, most_moved.

    At least ``windows`` windows must fit with consistent slots, some slot changed, and the pair must not share the passage as it is. The join is
    on the whole form, so windows whose slots can't map one to one never meet."""
    hits, table = template_hits(documents, items, size)
    hits = stage(hits, "hits")
    exact = hits.select(F.col("id").alias("doc_id"), "template", "words").join(table.select(F.col("id").alias("item_id"), "template", "words").distinct(), ["template", "words"]).select("doc_id", "item_id").distinct()
    known = table.select(F.col("id").alias("item_id"), "form", F.col("slots").alias("said")).distinct()
    moved = F.size(F.filter(F.zip_with("slots", "said", lambda a, b: a != b), lambda x: x))
    fit = hits.select(F.col("id").alias("doc_id"), "place", "form", "slots").join(known, "form").withColumn("moved", moved).where("moved > 0")
    return fit.groupBy("doc_id", "item_id").agg(F.countDistinct("place").alias("windows"), F.max("moved").alias("most_moved")).where(F.col("windows") >= windows).join(exact, ["doc_id", "item_id"], "left_anti")


def leaked_items(documents: DataFrame, items: DataFrame, size: int = 12) -> DataFrame:
    """Of every item: its split and how many documents hold a passage of it."""
    n = found(documents, items, size).groupBy("item_id").agg(F.count("*").alias("documents"))
    return items.select("item_id", "split").join(n, "item_id", "left").select("item_id", "split", F.coalesce("documents", F.lit(0)).cast("bigint").alias("documents"))
