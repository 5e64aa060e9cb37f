"""Toxicity by a weighted lexicon.

Texts are folded: compatibility forms, homoglyphs of other scripts, digits and signs that stand for letters, and i, l, 1 and | as one letter. A lexicon of whole words and
word beginnings is learned from labelled rows by log-likelihood ratio, and so are exception phrases, which are an entry with the word before or after it that mostly occur in clean texts. An Aho-Corasick
automaton finds all entries and exceptions in one pass over a whole text; hits inside an exception don't count. A text's sum of weights, normalised by its length, goes
through a logistic curve fitted on the same rows.

Learning reads at most TRAIN_ROWS labelled rows of each label (those with the smallest digests of their ids); lexicon and exceptions are what passes a test of
significance on those rows, so their sizes are bounded by the sample, and only they and one number per training document reach the driver. Scoring is one narrow pass.

Defined results: null and empty texts score the curve at zero; without labels of both kinds every score is 0.0; several labels of an id count as their largest; an empty table
gives an empty table; extra columns aren't read. Labels, language, source and id are no inputs of a score.
"""

from __future__ import annotations

import math
import re
import unicodedata

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..ship import ship
from .shared import whole_text, written

#: Bound: labelled rows of each label to learn from.
TRAIN_ROWS = 20_000
#: Lengths of word beginnings that may be entries, least toxic rows of an entry and least G-squared.
PREFIXES, LEAST_ROWS, LEAST_G = (4, 5, 6), 3, 20.0
CUT = 0.3

#: Characters folded to a Latin letter. Cyrillic and Greek look-alikes, then digits and signs.
HOMOGLYPHS = {"а": "a", "е": "e", "о": "o", "р": "p", "с": "c", "у": "y", "х": "x", "к": "k", "м": "m", "т": "t", "в": "b", "н": "h", "і": "i", "ј": "j", "ѕ": "s", "ԁ": "d", "ԛ": "q", "ԝ": "w", "α": "a", "β": "b", "ε": "e", "ι": "i", "κ": "k", "ν": "v", "ο": "o", "ρ": "p", "τ": "t", "υ": "u", "χ": "x", "ı": "i"}
DIGITS = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b"}
SIGNS = {"@": "a", "$": "s", "!": "i", "|": "i"}
_TABLE = str.maketrans(HOMOGLYPHS | DIGITS | {"l": "i"} | dict.fromkeys(map(ord, "​‌‍⁠﻿­"), None))
_SIGN = re.compile(r"(?<=\w)[@$!|]+(?=\w)")
_WORD = re.compile(r"[^\W\d_]+")
_NUMBER = re.compile(r"(?<!\S)[^\sA-Za-zª-\U0010ffff]+(?!\S)")


def fold(text: str | None) -> str:
    """Folded words, each between single spaces. Runs without a letter (numbers, rules) stay out."""
    if not text:
        return " "
    low = text.lower() if text.isascii() else unicodedata.normalize("NFKC", text).lower()
    low = _NUMBER.sub(" ", low)
    low = _SIGN.sub(lambda m: "".join(SIGNS[c] for c in m.group()), low)  # a sign stands for a letter only between letters
    return " " + " ".join(_WORD.findall(low.translate(_TABLE).replace("\n", " "))) + " "


def terms(word: str) -> list[str]:
    """Entries that would hit a word: " word " as a whole and " beginning" of it."""
    return [f" {word} ", *(f" {word[:n]}" for n in PREFIXES if len(word) > n)]


def _counts(rows: DataFrame, found) -> DataFrame:
    """rows: (text, toxic). (term, pos, neg): training rows with the term, by label."""
    import pyarrow as pa

    def run(batches):
        from collections import Counter

        for batch in batches:
            by = (Counter(), Counter())
            for text, toxic in zip(batch.column(0), batch.column(1).to_pylist()):
                by[toxic].update(found(fold(text.as_py())))
            keys = list(by[0].keys() | by[1].keys())
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.string()), pa.array([by[1][k] for k in keys], pa.int64()), pa.array([by[0][k] for k in keys], pa.int64())], ["term", "pos", "neg"])

    return rows.select("text", "toxic").mapInArrow(run, "term string, pos long, neg long").groupBy("term").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))


def _g(pos: str, neg: str, p: int, n: int):
    """Signed G-squared of a term's rows against the labels' shares, as a column."""
    all_ = F.col(pos) + F.col(neg)
    part = lambda c, share: F.when(F.col(c) > 0, F.col(c) * F.log(F.col(c) / (all_ * F.lit(share)))).otherwise(0.0)
    g = 2 * (part(pos, p / (p + n)) + part(neg, n / (p + n)))
    return F.when(F.col(pos) * n > F.col(neg) * p, g).otherwise(-g)


class Model:
    """What scoring needs: weights by entry, exceptions, and the curve's two numbers."""

    def __init__(self, weights: dict[str, float], exceptions: list[str], curve: tuple[float, float] | None):
        self.weights, self.exceptions, self.curve = weights, exceptions, curve
        self._automaton = None

    def __getstate__(self):
        return self.__dict__ | {"_automaton": None}

    def automaton(self):
        if self._automaton is None:
            import ahocorasick

            a = ahocorasick.Automaton()
            for t, w in self.weights.items():
                a.add_word(t, (t, w))
            for t in self.exceptions:
                a.add_word(t, (t, None))
            if len(a):
                a.make_automaton()
            self._automaton = a
        return self._automaton

    def hits(self, folded: str) -> list[tuple[int, float]]:
        """(start, weight) of each word hit, the largest weight of the entries at it, without words inside an exception."""
        a = self.automaton()
        best: dict[int, float] = {}
        spared: list[tuple[int, int]] = []
        if len(a):
            for end, (t, w) in a.iter(folded):
                start = end - len(t) + 1
                if w is None:
                    spared.append((start, end))
                elif w > best.get(start, 0.0):
                    best[start] = w
        if spared:
            best = {s: w for s, w in best.items() if not any(x <= s < y for x, y in spared)}
        return sorted(best.items())

    def signal(self, text: str | None) -> float:
        """Sum of weights over the logarithm of the length in words."""
        folded = fold(text)
        total = sum(w for _, w in self.hits(folded))
        return total / math.log2(2 + folded.count(" ")) if total else 0.0

    def score(self, text: str | None) -> float:
        if self.curve is None:
            return 0.0
        z = self.curve[0] + self.curve[1] * math.log1p(self.signal(text))
        return 1 / (1 + math.exp(-max(-500.0, min(500.0, z))))


def _logistic(xs: list[float], ys: list[int], rounds: int = 50) -> tuple[float, float]:
    """Intercept and slope by Newton's method with a small ridge."""
    import numpy as np

    x = np.stack([np.ones(len(xs)), np.array(xs)], axis=1)
    y = np.array(ys, dtype=float)
    ridge = np.diag([0.0, 0.01])
    w = np.zeros(2)
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        h = x.T @ (x * (p * (1 - p))[:, None]) + ridge + 1e-9 * np.eye(2)
        step = np.linalg.solve(h, x.T @ (y - p) - ridge @ w)
        w += np.clip(step, -3, 3)
    return float(w[0]), float(w[1])


def learn(docs: DataFrame, labels: DataFrame) -> Model:
    """docs: (doc_id, text); labels: (doc_id, toxic), training rows only."""
    import pyarrow as pa

    ship(docs.sparkSession)
    known = labels.where("toxic is not null").groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic")).withColumn("o", F.md5(F.col("doc_id").cast("string")))
    picked = [known.where(F.col("toxic") == k).orderBy("o", "doc_id").limit(TRAIN_ROWS).select("doc_id", "toxic") for k in (0, 1)]
    # at most 2 * TRAIN_ROWS ids and labels: a proven bound
    rows = written(docs.select("doc_id", whole_text().alias("text")).join(F.broadcast(picked[0].union(picked[1])), "doc_id").select("text", "toxic"))
    n, p = (rows.where(F.col("toxic") == k).count() for k in (0, 1))
    if not n or not p:
        return Model({}, [], None)
    least = F.least(F.lit(LEAST_G), F.lit(4.0 * math.log((p + n) / p)))
    first = _counts(rows, lambda t: {x for w in set(t.split()) if len(w) > 2 for x in terms(w)})
    best = first.where(F.col("pos") >= min(LEAST_ROWS, p)).withColumn("g", _g("pos", "neg", p, n)).where(F.col("g") >= least)
    best = best.orderBy(F.desc("g"), "term").collect()
    weights = {}
    for r in best:
        w = math.log((r["pos"] + 0.5) / (p + 1)) - math.log((r["neg"] + 0.5) / (n + 1))
        if w > 1:
            weights[r["term"]] = w
    bare = Model(weights, [], None)

    def phrases(folded: str) -> set[str]:
        out = set()
        for at, _ in bare.hits(folded):
            end = folded.find(" ", at + 1)
            left, right = folded.rfind(" ", 0, at), folded.find(" ", end + 1)
            out |= ({folded[left : end + 1]} if left >= 0 else set()) | ({folded[at : right + 1]} if right >= 0 else set())
        return out

    clean = _counts(rows, phrases).where(F.col("neg") >= LEAST_ROWS).withColumn("g", _g("pos", "neg", p, n)).where((F.col("neg") * p > F.col("pos") * n) & (F.col("neg") > 4 * F.col("pos")))
    exceptions = [r["term"] for r in clean.orderBy(F.desc("neg"), "term").collect()]
    model = Model(weights, exceptions, None)

    def run(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([math.log1p(model.signal(t.as_py())) for t in batch.column(0)], pa.float64()), batch.column(1)], ["x", "toxic"])

    sample = rows.select("text", F.col("toxic").cast("int").alias("toxic")).mapInArrow(run, "x double, toxic int").collect()  # one number a training row
    return Model(weights, exceptions, _logistic([r["x"] for r in sample], [r["toxic"] for r in sample]))


def score(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, score, predicted) of every row."""
    import pyarrow as pa

    ship(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)  # bounded by TRAIN_ROWS

    def run(batches):
        m = shared.value
        for batch in batches:
            s = [m.score(t.as_py()) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(s, pa.float64()), pa.array([int(x >= CUT) for x in s], pa.int32())], ["doc_id", "score", "predicted"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, score double, predicted int")


def held_out(col: str = "doc_id"):
    return F.crc32(F.col(col).cast("string").cast("binary")) % 4 == 2


def op10_toxicity(spark, sf_dir: str) -> DataFrame:
    from .shared import table

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    labels = table(spark, sf_dir, "labels").where(~held_out()).select("doc_id", "toxic")
    scored = score(docs, learn(docs, labels))
    return scored.select("doc_id", held_out().alias("held_out"), "score", "predicted")
