"""Subjects of documents, by class-association rules.

Labels are read from a bounded sample of labelled documents (at most ``sample``, by hash of the id). A document is cut into
units: sentences, long ones in pieces; words inside quoted evaluation items are left out first. Terms (words and pairs
of words) that depend on a label become items; every unit of a labelled document is a transaction of its items, in the order of their frequency,
with the document's labels as its classes. Parallel FP-growth mines the sets of up to two items with the number of their units per class: every task
gets, of each transaction, the prefix up to the last item it is to mine, and grows its items from their conditional pattern bases. The frequent
sets with a class are the rules, and a rule is redundant if a more general one is as sure. A unit collects, per subject, the log-odds of
its matching rules against the subject's base rate; the best subject over a threshold is the unit's. A document has a subject if a
passage (units close to one another) holds enough units of it. Threshold and number are calibrated on documents the rules were not mined from:
all counts are kept per half of the sample, and each half is scored by the rules of the other.

What is sent to the tasks (rules, terms) is bounded by the sample, whatever the size of the corpus; every document is scored whole. Scoring is
numpy over whole batches: words are hashes, rules are sorted tables of hashes and numbers.
"""

from __future__ import annotations

import html
import math
import re
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracelake.llm.common import mix64, starts_inside
from tracelake.llm.leaks import FEW_NAMES, canonical, few_hashes, name_table, own_hashes, window_hashes, with_hashes
from tracelake.llm.words import BREAK, SPACE, STOP, Texts, among, parts
from tracelake.plans.staging import parallel, stage, tasks

MARK = re.compile(r"<[^<>\n]{1,40}>|\[\d+\]")
QUOTE = 7  # canonical words of a window that tells a quoted item
GAP = 6  # words between quoted windows that still belong to the quotation
UNIT_WORDS = 24
APART = 4  # units of a passage have at most so many units from one to the next
LEASTS, NUMBERS = (0.5, 1.0, 1.5, 2.0, 2.5, 3.0), (1, 2, 3, 4)


def cleaned(texts: list[str | None]) -> list[str]:
    """Texts without entities and tags, with one kind of apostrophe."""
    out = []
    for t in texts:
        t = t or ""
        if "&" in t:
            t = html.unescape(t)
        if "<" in t or "[" in t:
            t = MARK.sub(" ", t)
        out.append(t.replace("’", "'"))
    return out


def _quote_windows(t: Texts, names: np.ndarray, own: list[np.ndarray] | None) -> tuple[np.ndarray, ...]:
    """Starts and ends of the words, and text, first word and hash of every window of QUOTE canonical words."""
    start, end = t.alnum()
    rec, at = starts_inside(np.searchsorted(start, t.bounds), QUOTE)
    h, _ = canonical(t, start, end, names, own)
    return start, end, rec, at, window_hashes(h, QUOTE)[at] if len(at) else np.zeros(0, np.int64)


def quoted_places(t: Texts, names: np.ndarray, quoted: np.ndarray, own: list[np.ndarray] | None = None, own_quoted: list[np.ndarray] | None = None) -> np.ndarray:
    """Is the character inside a quoted item?"""
    start, end, rec, at, h = _quote_windows(t, names, own)
    h = h.view(np.uint64)
    if own_quoted is None:
        hit = among(h, quoted)
    else:
        hit = np.zeros(len(h), dtype=bool)
        for r in np.unique(rec):
            hit[rec == r] = among(h[rec == r], own_quoted[t.first + r])
    edge = np.zeros(len(t.codes) + 1, dtype=np.int64)
    rec, at = rec[hit], at[hit]
    if len(at):
        last = at + QUOTE - 1
        new = np.r_[True, (rec[1:] != rec[:-1]) | (at[1:] > last[:-1] + GAP)]
        np.add.at(edge, start[at[new]], 1)
        np.add.at(edge, end[last[np.r_[new[1:], True]]], -1)
    return np.cumsum(edge[:-1]) > 0


class Units:
    """The units of a part of a batch: of every word its hash and unit, of every unit its text and its place in it."""

    def __init__(self, t: Texts, blank: np.ndarray):
        start, end = t.terms(~blank)
        space = ((t.kind & SPACE) > 0) | blank
        stop = ((t.kind & STOP) > 0) & ~blank
        stop[:-1] &= space[1:]
        ends = stop | (((t.kind & BREAK) > 0) & ~blank)
        _, no, n = np.unique(np.cumsum(ends)[start], return_inverse=True, return_counts=True)
        place = np.arange(len(start)) - (np.cumsum(n) - n)[no]
        piece = np.where(n[no] > 2 * UNIT_WORDS, place // UNIT_WORDS, 0)
        use = n[no] > 1  # a sentence of one word is no unit
        start, end, no, piece = start[use], end[use], no[use], piece[use]
        new = np.r_[True, (no[1:] != no[:-1]) | (piece[1:] != piece[:-1])] if len(no) else np.zeros(0, dtype=bool)
        self.word, self.unit = t.hashes(start, end), np.cumsum(new) - 1
        self.text = t.record(start[new]) + t.first
        self.count = len(self.text)
        self.place = np.arange(self.count) - np.searchsorted(self.text, self.text)
        same = self.unit[1:] == self.unit[:-1]
        self.left = np.flatnonzero(same)  # first words of the pairs
        self.pair = mix64(self.word[self.left] * np.uint64(0xD1B54A32D192ED03) + self.word[self.left + 1])

    def items(self, known: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Unit and number of the known terms, each once a unit; a word inside a known pair is left out."""
        pair = among(self.pair, known)
        word = among(self.word, known)
        word[self.left[pair]] = word[self.left[pair] + 1] = False
        unit = np.concatenate([self.unit[self.left[pair]], self.unit[word]])
        term = np.searchsorted(known, np.concatenate([self.pair[pair], self.word[word]]))
        both = np.unique(unit * max(1, len(known)) + term)
        return both // max(1, len(known)), both % max(1, len(known))


def units_of(b: pa.RecordBatch, names: np.ndarray, quoted: np.ndarray) -> Iterator[Units]:
    own, own_quoted = own_hashes(b, "names"), own_hashes(b, "quoted")
    for t in parts(cleaned(b.column("text").to_pylist())):
        yield Units(t, quoted_places(t, names, quoted, own, own_quoted))


def subject_name(c: Column) -> Column:
    return F.regexp_replace(F.lower(F.trim(c)), r"[-\s]+", "_")


class Rules:
    """Log-odds of the subjects for single terms and for pairs of terms; 0 where there is no rule. Terms are sorted hashes."""

    def __init__(self, known: np.ndarray, single: np.ndarray, keys: np.ndarray, double: np.ndarray):
        self.known, self.single, self.keys, self.double = known, single, keys, double

    def labels(self, u: Units) -> tuple[np.ndarray, np.ndarray]:
        """Best subject (-1: no rule matches) of each unit and its evidence: of the rules that use a term, the surest counts."""
        best, value = np.full(u.count, -1), np.zeros(u.count)
        unit, term = u.items(self.known)
        if not len(unit):
            return best, value
        score = self.single[term]
        first = np.flatnonzero(np.r_[True, unit[1:] != unit[:-1]])
        n = np.diff(np.r_[first, len(unit)])
        if len(self.keys):
            many = np.repeat(n, n)
            a = np.repeat(np.arange(len(unit)), many)
            b = np.repeat(np.repeat(first, n), many) + np.arange(len(a)) - np.repeat(np.cumsum(many) - many, many)
            key = np.minimum(term[a], term[b]) * len(self.known) + np.maximum(term[a], term[b])
            hit = among(key, self.keys) & (a != b)
            np.maximum.at(score, a[hit], self.double[np.searchsorted(self.keys, key[hit])])
        total = np.add.reduceat(score, first)
        at = unit[first]
        best[at], value[at] = total.argmax(1), total.max(1)
        best[at[value[at] <= 0]] = -1
        return best, value


def passages(u: Units, best: np.ndarray, value: np.ndarray, least: float, subjects: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Text, subject, units and evidence of the largest passage of every text and subject (the first of the largest)."""
    use = np.flatnonzero((best >= 0) & (value >= least))
    key = u.text[use] * subjects + best[use]
    order = np.lexsort((u.place[use], key))
    use, key = use[order], key[order]
    if not len(use):
        return (np.zeros(0, np.int64),) * 3 + (np.zeros(0),)
    new = np.r_[True, (key[1:] != key[:-1]) | (u.place[use][1:] - u.place[use][:-1] > APART)]
    run = np.cumsum(new) - 1
    n, evidence, of = np.bincount(run), np.bincount(run, value[use]), key[new]
    order = np.lexsort((-n, of))
    top = order[np.r_[True, of[order][1:] != of[order][:-1]]]
    return of[top] // subjects, of[top] % subjects, n[top], evidence[top]


class Model:
    """Rules, the calibrated bounds, and what tells quoted items."""

    def __init__(self, subjects: list[str], rules: Rules, names: np.ndarray, quoted: np.ndarray):
        self.subjects, self.rules, self.names, self.quoted = subjects, rules, names, quoted
        self.least, self.count, self.quality = 1.0, 2, None


def _score(model: Model):
    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        k, name = len(model.subjects), pa.array(model.subjects, pa.string())
        for b in batches:
            for u in units_of(b, model.names, model.quoted):
                best, value = model.rules.labels(u)
                text, subject, n, evidence = passages(u, best, value, model.least, k)
                some = n >= model.count
                text, subject = text[some], subject[some]
                mine = np.bincount((u.text * k + best)[best >= 0], minlength=b.num_rows * k)
                share = mine[text * k + subject] / np.maximum(np.bincount(u.text, minlength=b.num_rows), 1)[text]
                yield pa.RecordBatch.from_arrays([
                    b.column("doc_id").take(pa.array(text)), name.take(pa.array(subject)), pa.array(n[some].astype(np.int32)), pa.array(evidence[some]), pa.array(share)], names=["doc_id", "subject", "units", "evidence", "share"])

    return score


def _classes(b: pa.RecordBatch, k: int) -> np.ndarray:
    """Rows of 2 * (k + 1) zeros and ones: for the row's half of the sample, one for every row and one for each of its subjects."""
    out = np.zeros((b.num_rows, 2, k + 1), dtype=np.int64)
    for i, (half, subjects) in enumerate(zip(b.column("half").to_pylist(), b.column("classes").to_pylist())):
        out[i, half, [k, *subjects]] = 1
    return out.reshape(b.num_rows, -1)


def _term_counts(k: int, names: np.ndarray, quoted: np.ndarray):
    """Documents that hold a term, per half and class. Pairs come with their words (a, b), words with zeros."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            classes = _classes(b, k)
            for u in units_of(b, names, quoted):
                zero = np.zeros(len(u.word), np.uint64)
                term = np.concatenate([u.word, u.pair])
                words = np.stack([np.concatenate([zero, u.word[u.left]]), np.concatenate([zero, u.word[u.left + 1]])])
                text = np.concatenate([u.text[u.unit], u.text[u.unit[u.left]]])
                terms, first, no = np.unique(term, return_index=True, return_inverse=True)
                once = np.unique(no * b.num_rows + text)
                n = np.zeros((len(terms), classes.shape[1]), dtype=np.int64)
                np.add.at(n, once // b.num_rows, classes[once % b.num_rows])
                yield pa.RecordBatch.from_arrays([pa.array(terms.view(np.int64)), *(pa.array(w[first].view(np.int64)) for w in words), *(pa.array(c) for c in n.T.copy())], names=["term", "a", "b", *(f"n{i}" for i in range(n.shape[1]))])

    return count


def _prefixes(k: int, known: np.ndarray, rank: np.ndarray, groups: int, names: np.ndarray, quoted: np.ndarray):
    """Of each unit, for every group that is to mine one of its items, the items up to the last of these, most frequent first; equal ones together."""

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            classes, got = _classes(b, k), defaultdict(lambda: np.zeros(2 * (k + 1), dtype=np.int64))
            for u in units_of(b, names, quoted):
                unit, term = u.items(known)
                order = np.lexsort((rank[term], unit))
                unit, items = unit[order], rank[term[order]]
                first = np.flatnonzero(np.r_[True, unit[1:] != unit[:-1]]) if len(unit) else np.zeros(0, np.int64)
                for i, j in zip(first, np.r_[first[1:], len(unit)]):
                    mine, n = items[i:j].tolist(), classes[u.text[unit[i]]]
                    for g, last in {x % groups: at for at, x in enumerate(mine)}.items():
                        got[g, tuple(mine[: last + 1])] += n
            yield pa.RecordBatch.from_arrays([pa.array([g for g, _ in got], pa.int32()), pa.array([list(p) for _, p in got], pa.list_(pa.int32())), pa.array([v.tolist() for v in got.values()], pa.list_(pa.int64()))], names=["grp", "items", "n"])

    return emit


def grow(paths: dict[tuple[int, ...], np.ndarray], support: int, longest: int, mined=None, suffix: tuple[int, ...] = ()) -> Iterator[tuple[tuple[int, ...], np.ndarray]]:
    """FP-growth over weighted prefix paths: the frequent sets (by the sum of the weights of all rows) that end in ``suffix``, of at most ``longest`` items."""
    total: dict[int, np.ndarray] = {}
    base: dict[int, dict[tuple[int, ...], np.ndarray]] = defaultdict(dict)
    for path, n in paths.items():
        for i, x in enumerate(path):
            if mined is None or mined(x):
                total[x] = total[x] + n if x in total else n
                if i and len(suffix) + 1 < longest:  # the conditional pattern base of x
                    base[x][path[:i]] = base[x][path[:i]] + n if path[:i] in base[x] else n
    k = len(next(iter(total.values()))) // 2 if total else 0
    for x, n in total.items():
        if n[k - 1] + n[2 * k - 1] >= support:
            yield (x, *suffix), n
            yield from grow(base[x], support, longest, None, (x, *suffix))


def _grown(support: int, groups: int, longest: int = 2):
    def mine(t: pa.Table) -> pa.Table:
        paths: dict[tuple[int, ...], np.ndarray] = {}
        for p, n in zip(t.column("items").to_pylist(), t.column("n").to_pylist()):
            paths[tuple(p)] = paths.get(tuple(p), 0) + np.array(n)
        g = t.column("grp")[0].as_py()
        out = list(grow(paths, support, longest, lambda x: x % groups == g))
        return pa.table({"items": pa.array([list(a) for a, _ in out], pa.list_(pa.int32())), "n": pa.array([n.tolist() for _, n in out], pa.list_(pa.int64()))})

    return mine


def _rules(known: np.ndarray, allowed: np.ndarray, sets: np.ndarray, n: np.ndarray, support: int) -> Rules:
    """Rules from the counts of sets (item numbers, the second -1 for single ones) per class, those of all units last."""
    k = n.shape[1] - 1
    ok = (n[:, k] >= support) & allowed[sets[:, 0]] & ((sets[:, 1] < 0) | allowed[sets[:, 1]])
    sets, n = sets[ok], np.where(n[ok] >= support, n[ok], 0).astype(float)
    one = sets[:, 1] < 0
    prior = np.minimum(0.9, np.maximum(n[one, :k].sum(0), 1e-6) / max(1.0, n[one, k].sum()))
    conf = (n[:, :k] + 2 * prior) / (n[:, k:] + 2)
    odds = np.log(conf / (1 - conf + 1e-3)) - np.log(prior / (1 - prior))
    by_item = np.full((len(known), k), -np.inf)
    by_item[sets[one, 0]] = conf[one]
    two = np.flatnonzero(~one)
    keep = odds > 0.5
    keep[two] &= np.maximum(by_item[sets[two, 0]], by_item[sets[two, 1]]) < conf[two] - 0.02  # a more general rule isn't as sure
    odds = np.where(keep, odds, 0.0)
    used = np.unique(sets[keep.any(1)])
    used = used[used >= 0]
    at = np.searchsorted(used, sets)
    single = np.zeros((len(used), k))
    some = one & keep.any(1)
    single[at[some, 0]] = odds[some]
    two = np.flatnonzero(~one & keep.any(1))
    keys = np.minimum(at[two, 0], at[two, 1]) * len(used) + np.maximum(at[two, 0], at[two, 1])
    order = np.argsort(keys)
    return Rules(known[used], single, keys[order], odds[two][order])


def _trial(k: int, halves: list[Rules], names: np.ndarray, quoted: np.ndarray):
    """Hits, finds and labels of labelled documents for each choice of threshold and number, each half by the rules of the other."""

    def trial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros((len(LEASTS), len(NUMBERS), 3), dtype=np.int64)
        for b in batches:
            classes, half = _classes(b, k).reshape(b.num_rows, 2, -1)[:, :, :k].sum(1), b.column("half").to_numpy()
            counts[:, :, 2] += classes.sum()
            for u in units_of(b, names, quoted):
                for f, rules in enumerate(halves):
                    best, value = rules.labels(u)
                    best[half[u.text] != f] = -1
                    for i, least in enumerate(LEASTS):
                        text, subject, n, _ = passages(u, best, value, least, k)
                        for j, number in enumerate(NUMBERS):
                            some = n >= number
                            counts[i, j, :2] += classes[text[some], subject[some]].sum(), some.sum()
        i, j = np.indices(counts.shape[:2])
        yield pa.RecordBatch.from_arrays([pa.array(np.array(LEASTS)[i.ravel()]), pa.array(np.array(NUMBERS, np.int32)[j.ravel()]), *(pa.array(c.ravel()) for c in np.moveaxis(counts, 2, 0))], names=["least", "n", "hit", "got", "want"])

    return trial


def fit(documents: DataFrame, labels: DataFrame, areas: DataFrame, quoted_items: DataFrame, sample: int = 20_000, least_docs: int = 3, most: int = 1_000_000) -> tuple[Model, tuple[DataFrame | None, DataFrame | None]]:
    """Mine and calibrate the rules on at most ``sample`` labelled documents (those of smallest hash). Also the tables of names
    and of quoted windows, where they are joined with the texts as they are too many to be sent to all tasks."""
    spark = documents.sparkSession
    name_rows = stage(name_table(quoted_items), "names")
    names = few_hashes(name_rows, FEW_NAMES)
    plain = np.zeros(0, np.uint64) if names is None else names

    def windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            own = own_hashes(b, "names")
            for t in parts(cleaned(b.column("text").to_pylist())):
                yield pa.RecordBatch.from_arrays([pa.array(np.unique(_quote_windows(t, plain, own)[4]))], names=["h"])

    of_items = quoted_items.where("text IS NOT NULL").select(F.col("item_id").cast("bigint").alias("item_id"), "text")
    of_items = of_items if names is not None else with_hashes(of_items, name_rows, "item_id", "names", clean=cleaned)
    quote_rows = stage(of_items.mapInArrow(windows, "h bigint").distinct(), "quotes")
    quoted = few_hashes(quote_rows, most)
    subjects = sorted(r.subject for r in areas.where("subject IS NOT NULL").select("subject").distinct().collect())  # fixed table
    model = Model(subjects, Rules(plain[:0], np.zeros((0, len(subjects))), np.zeros(0, np.int64), np.zeros((0, len(subjects)))), plain, np.zeros(0, np.uint64) if quoted is None else quoted)
    joins = (name_rows if names is None else None, quote_rows if quoted is None else None)
    k = len(subjects)
    wanted = labels.select("doc_id", subject_name(F.col("subject")).alias("subject")).join(areas.select("subject").distinct(), "subject").distinct()
    drawn = wanted.where("doc_id IS NOT NULL").select("doc_id").distinct().orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    number = F.create_map([F.lit(x) for i, s in enumerate(subjects) for x in (s, i)]) if k else F.create_map()
    truth = stage(wanted.join(drawn, "doc_id", "left_semi").groupBy("doc_id").agg(F.collect_set(number[F.col("subject")]).alias("classes")), "labels")
    half = F.pmod(F.xxhash64("doc_id", F.lit(77)), F.lit(2)).cast("int").alias("half")
    texts = documents.select("doc_id", "text").join(truth, "doc_id").select("doc_id", "text", "classes", half)
    texts = stage(_joined(texts, plain, joins).repartition(tasks(spark)), "labelled")
    per = texts.select("half", F.explode(F.concat("classes", F.array(F.lit(k)))).alias("c")).groupBy("half", "c").agg(F.count("*").alias("n")).collect()
    docs = np.zeros((2, k + 1), dtype=np.int64)
    for r in per:
        docs[r.half, r.c] = r.n
    if not docs[:, k].sum():
        return model, joins
    # terms that depend on a label, by document counts: of all documents and of either half
    width = 2 * (k + 1)
    counted = texts.mapInArrow(_term_counts(k, model.names, model.quoted), "term bigint, a bigint, b bigint, " + ", ".join(f"n{i} bigint" for i in range(width)))
    counted = counted.groupBy("term", "a", "b").agg(*[F.sum(f"n{i}").alias(f"n{i}") for i in range(width)])
    parts_ = [(0, 1), (1,), (0,)]  # rules of all, rules for half 0 (from half 1), rules for half 1

    def depends(halves: tuple[int, ...]) -> Column:
        of = lambda c: sum((F.col(f"n{h * (k + 1) + c}") for h in halves), F.lit(0))
        df, total, out = of(k), int(docs[list(halves), k].sum()), F.lit(False)
        for c in range(k):
            if rate := docs[list(halves), c].sum() / max(1, total):
                z = (of(c) - df * float(rate)) / F.sqrt(df * float(rate * (1 - rate)) + 1e-9)
                out |= (of(c) > 1.4 * float(rate) * df) & (z > 2.5) & (of(c) > 0.45 * df)
        return (df >= least_docs) & out

    every = int(docs[:, k].sum())
    df = F.col(f"n{k}") + F.col(f"n{width - 1}")
    usual = (F.col("a") == 0) & (F.col("b") == 0) & (df >= max(least_docs, every // 20))
    rows = counted.select("term", "a", "b", df.alias("df"), usual.alias("usual"), *[depends(h).alias(f"ok{i}") for i, h in enumerate(parts_)]).where("ok0 OR ok1 OR ok2 OR usual").toArrow()  # bounded by the sample
    col = {c: rows.column(c).to_numpy() for c in rows.column_names}
    term, a, b = (col[c].view(np.uint64) for c in ("term", "a", "b"))
    common = np.sort(term[col["usual"] & ~col["ok0"]])  # frequent and independent of the labels
    fit_for = np.stack([col[f"ok{i}"] for i in range(3)], axis=1) & ~(among(a, common) | among(b, common) | among(term, common))[:, None]
    use = np.flatnonzero(fit_for.any(1))
    use = use[np.argsort(term[use])]
    known, fit_for = term[use], fit_for[use]
    if not len(known):
        return model, joins
    rank = np.empty(len(known), dtype=np.int64)  # most frequent first
    rank[np.lexsort((known, -col["df"][use]))] = np.arange(len(known))
    units = texts.mapInArrow(_unit_number(model.names, model.quoted), "n bigint").agg(F.sum("n")).collect()[0][0] or 0
    support, groups = math.ceil(max(least_docs, units * 2e-5)), tasks(spark)
    prefixes = texts.mapInArrow(_prefixes(k, known, rank, groups, model.names, model.quoted), "grp int, items array<int>, n array<bigint>")
    mined = prefixes.groupBy("grp").applyInArrow(_grown(support, groups), "items array<int>, n array<bigint>").toArrow()  # bounded by the sample
    if not mined.num_rows:
        return model, joins
    by_rank = np.argsort(rank)
    sets = np.array([[*x, -1][:2] for x in mined.column("items").to_pylist()])
    sets = np.where(sets >= 0, by_rank[sets], -1)
    n = np.array(mined.column("n").to_pylist()).reshape(len(sets), 2, k + 1)
    every_rules = [_rules(known, fit_for[:, i], sets, n[:, list(h)].sum(1), support) for i, h in enumerate(parts_)]
    model.rules = every_rules[0]
    sums = texts.mapInArrow(_trial(k, every_rules[1:], model.names, model.quoted), "least double, n int, hit bigint, got bigint, want bigint").groupBy("least", "n").agg(*[F.sum(c).alias(c) for c in ("hit", "got", "want")]).collect()
    best = max(sums, key=lambda r: (2 * r.hit / max(1, r.got + r.want), -r.least, -r.n))
    model.quality, model.least, model.count = 2 * best.hit / max(1, best.got + best.want), best.least, best.n
    return model, joins


def _unit_number(names: np.ndarray, quoted: np.ndarray):
    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([sum(u.count for u in units_of(b, names, quoted))], pa.int64())], names=["n"])

    return number


def _joined(texts: DataFrame, names: np.ndarray, joins: tuple[DataFrame | None, DataFrame | None]) -> DataFrame:
    """The texts, with the hashes of their names and quoted windows where these are joined."""
    name_rows, quote_rows = joins
    if name_rows is not None:
        texts = with_hashes(texts, name_rows, "doc_id", "names", clean=cleaned)
    if quote_rows is not None:
        texts = with_hashes(texts, quote_rows, "doc_id", "quoted", lambda b, t: _quote_windows(t, names, own_hashes(b, "names"))[2:5:2], cleaned)
    return texts


def scored(documents: DataFrame, labels: DataFrame, areas: DataFrame, quoted_items: DataFrame, sample: int = 20_000, most: int = 1_000_000) -> DataFrame:
    """doc_id, subject, units, evidence, share of every document's subjects. Null and empty texts have none."""
    model, joins = fit(documents, labels, areas, quoted_items, sample, most=most)
    texts = documents.where("doc_id IS NOT NULL").select("doc_id", "text")
    return parallel(_joined(texts, model.names, joins)).mapInArrow(_score(model), "doc_id bigint, subject string, units int, evidence double, share double")


def found(documents: DataFrame, labels: DataFrame, areas: DataFrame, quoted_items: DataFrame) -> DataFrame:
    """p10_found: doc_id, subject."""
    return scored(documents, labels, areas, quoted_items).select("doc_id", "subject").distinct()


def make_up(documents: DataFrame, labels: DataFrame, areas: DataFrame, quoted_items: DataFrame) -> DataFrame:
    """Corpus by subject: documents of each subject, and their mean share of units."""
    n = scored(documents, labels, areas, quoted_items).groupBy("subject").agg(F.countDistinct("doc_id").alias("documents"), F.round(F.avg("share"), 4).alias("mean_share"))
    return areas.select("subject").join(n, "subject", "left").select("subject", F.coalesce("documents", F.lit(0)).cast("bigint").alias("documents"), "mean_share")
