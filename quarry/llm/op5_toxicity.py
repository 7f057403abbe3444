"""Operator 5: toxicity by maximum-scoring segments.

Fit, on a bounded sample of labelled rows that are not held out
(``SAMPLE_DOCS``, drawn by a hash of the id; the only bounded part): every
word and word beginning is counted once per document and class, and scored by
its log-odds between the classes with an informative Dirichlet prior. Terms
whose log-odds stand out (``MIN_Z`` standard errors) form the lexicon; all
other words share the log-odds of a word outside it, which is below zero.

Scan, on every whole text where it is read, without a shuffle: one pass finds
all maximal segments of the sequence of word scores. Under the clean model a
segment of score S in n words is exceeded ``K n exp(-S)`` times by chance
(the scores are log-odds, so the rate of the extreme-value law is 1); K is
fitted to the best segments of clean sample documents. A passage is
significant if that number is at most ``MAX_EXPECTED``. A document's score
comes from its best and its summed significant passages through a logistic
curve fitted on the sample, each sample document scored without its own counts.

With few labels little stands out that far. If fewer than half of the toxic
sample documents are caught, a second lexicon of ``LOWER_Z`` standard errors is
fitted; it is taken if it catches half of them, else the one with the smaller loss.

The query marks, it drops no row: ``kept`` says whether a filter by this
operator would keep the document. With very few labels (three to eight toxic
documents) it can still be that nothing is marked.

Defined results: a null or word-free text has no passage and the score of
one; with no labelled row of both classes every score is 0; labels that are
null or neither 0 nor 1 are not used, several labels of a document count as
their largest; repeated rows repeat; an empty table gives an empty result;
other columns are not read.
"""

from __future__ import annotations

import math
import re
from collections import Counter

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.llm.common import documents, map_rows, share
from quarry.session import read_table

SAMPLE_DOCS = 20_000      # labelled documents that the fit reads, about
MIN_Z = 2.5
LOWER_Z = 2.0             # where MIN_Z catches fewer than half of the toxic sample documents
MAX_EXPECTED = 0.05
BEGINNINGS = (4, 5, 6)    # letters of the word beginnings that are terms of their own ("abcd*")
WORDS = re.compile(r"[^\W\d_]+")


def words(text: str | None) -> list[str]:
    return WORDS.findall(text.lower()) if text else []


def terms(word: str) -> list[str]:
    return [word, *(word[:k] + "*" for k in BEGINNINGS if len(word) > k)]


def labelled_rows(docs: DataFrame, labels: DataFrame, sample_docs: int = SAMPLE_DOCS) -> DataFrame:
    """text, toxic: distinct labelled texts that are not held out, about ``sample_docs`` of them."""
    kept = (labels.filter(F.col("toxic").isin(0, 1) & (F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(5)) != 0))
            .groupBy("doc_id").agg(F.max("toxic").alias("toxic")))
    total = kept.count()
    kept = kept.filter(share(["doc_id"], 5) * max(total, 1) < sample_docs)
    # About sample_docs ids, by construction: broadcast, so that no other text is shuffled.
    rows = docs.select("doc_id", "text").filter(F.col("text").isNotNull()).join(F.broadcast(kept), "doc_id")
    # Copies of one text are one observation.
    return rows.groupBy(F.xxhash64("text").alias("h"), F.length("text").alias("n")).agg(
        F.first("text").alias("text"), F.max("toxic").alias("toxic")).select("text", "toxic")


def count_terms(rows: DataFrame) -> DataFrame:
    """term, toxic documents with it, clean documents with it."""
    def run(batches):
        for b in batches:
            n = Counter(), Counter()
            for text, toxic in zip(b["text"], b["toxic"]):
                n[toxic].update({t for w in set(words(text)) for t in terms(w)})
            both = list(n[0].keys() | n[1].keys())
            yield {"term": both, "y1": [n[1][t] for t in both], "y0": [n[0][t] for t in both]}

    out = map_rows(rows.select("text", F.col("toxic").cast("int").alias("toxic")), "term string, y1 long, y0 long", run)
    return out.groupBy("term").agg(F.sum("y1").alias("y1"), F.sum("y0").alias("y0"))


def log_odds(y1, y0, n1: float, n0: float):
    """Log-odds of a term between the classes and its standard error. The prior
    is the term's share of both classes, with the weight of the toxic one."""
    a = n1 * (y1 + y0) / (n1 + n0)
    odds = (np.log((y1 + a) / np.maximum(2 * n1 - y1 - a, 1e-9)) - np.log((y0 + a) / np.maximum(n0 + n1 - y0 - a, 1e-9)))
    return odds, np.sqrt(1 / (y1 + a) + 1 / (y0 + a))


class Lexicon:
    """term -> (score, score without one toxic document, score without one clean document)."""

    def __init__(self, terms_: list[str], y1: np.ndarray, y0: np.ndarray, n1: float, n0: float, miss: float, min_z: float = MIN_Z):
        scores = []
        for d1, d0 in ((0, 0), (1, 0), (0, 1)):
            a, b = np.maximum(y1 - d1, 0), np.maximum(y0 - d0, 0)
            s, error = log_odds(np.maximum(a, 1e-6), b, n1, n0)
            scores.append(np.where((a + b > 0) & (s > min_z * error), s, -1.0))
        self.table = {t: s for t, *s in zip(terms_, *(x.tolist() for x in scores))}
        self.miss = miss            # score of a word outside the lexicon
        self.log_k = 0.0
        self.curve = np.zeros(4)
        self.known: dict[str, tuple | None] = {}
        self.fitted = bool(terms_)

    def of_word(self, word: str) -> tuple | None:
        found = [self.table[t] for t in terms(word) if t in self.table]
        return tuple(max(x) for x in zip(*found)) if found else None

    def hits(self, tokens: list[str], own: int) -> list[tuple[int, float]]:
        known = self.known
        if len(known) > 1_000_000:
            known.clear()
        for w in set(tokens).difference(known):
            known[w] = self.of_word(w)
        return [(i, s[own]) for i, s in enumerate(map(known.__getitem__, tokens)) if s is not None and s[own] > 0]

    def segments(self, hits: list[tuple[int, float]]) -> list[tuple[float, int, int]]:
        """All maximal scoring segments as (score, first word, last word), in
        one pass over the words with a positive score: the words between two
        of them only lower the running sum."""
        stack: list[list] = []  # [sum before, sum after, first, last]
        total, at = 0.0, 0
        for i, s in hits:
            total += self.miss * (i - at)
            at = i + 1
            new = [total, total + s, i, i]
            total += s
            while True:
                j = len(stack) - 1
                while j >= 0 and stack[j][0] >= new[0]:
                    j -= 1
                if j < 0 or stack[j][1] >= new[1]:
                    break
                new = [stack[j][0], new[1], stack[j][2], new[3]]
                del stack[j:]
            stack.append(new)
        return [(r - l, a, b) for l, r, a, b in stack]

    def passages(self, tokens: list[str], own: int = 0) -> list[tuple[float, int, int]]:
        """Significant segments: expected by chance at most MAX_EXPECTED times in a text this long."""
        least = self.log_k + math.log(max(len(tokens), 1)) - math.log(MAX_EXPECTED)
        return [x for x in self.segments(self.hits(tokens, own)) if x[0] >= least]

    def features(self, tokens: list[str], own: int = 0) -> tuple[float, float, float, float]:
        found = self.segments(self.hits(tokens, own))
        if not found:
            return 1.0, 0.0, 0.0, 0.0
        chance = self.log_k + math.log(max(len(tokens), 1))
        best = max(x[0] for x in found)
        significant = [x[0] for x in found if x[0] >= chance - math.log(MAX_EXPECTED)]
        return 1.0, best, math.log1p(sum(significant)), math.log1p(max(0.0, best - chance))

    def score(self, text: str | None) -> float:
        if not self.fitted:
            return 0.0
        x = float(np.dot(self.curve, self.features(words(text))))
        return 1.0 / (1.0 + math.exp(-max(-700.0, min(700.0, x))))


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0, steps: int = 50) -> np.ndarray:
    """Newton's method; the ridge leaves the constant free."""
    w = np.zeros(x.shape[1])
    penalty = ridge * np.eye(x.shape[1])
    penalty[0, 0] = 1e-6
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        h = (x * (p * (1 - p))[:, None]).T @ x + penalty
        step = np.linalg.solve(h, x.T @ (y - p) - penalty @ w)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    return w


def fit(docs: DataFrame, labels: DataFrame, sample_docs: int = SAMPLE_DOCS) -> Lexicon:
    """Terms below the limit of certainty are dropped before anything reaches
    the driver; of the sample documents only four numbers each do."""
    from quarry.llm.common import stored

    rows = stored(labelled_rows(docs, labels, sample_docs), "toxic-sample")
    counts = stored(count_terms(rows), "toxic-terms")
    n1, n0 = (float(x or 0) for x in counts.agg(F.sum("y1"), F.sum("y0")).first())
    if not n1 or not n0:
        return Lexicon([], np.empty(0), np.empty(0), 1.0, 1.0, -0.1)
    best = None
    for min_z in (MIN_Z, LOWER_Z):
        lexicon = build(counts, n1, n0, min_z)
        caught, loss = calibrate(lexicon, rows)
        if best is None or loss < best[0]:
            best = loss, lexicon
        if caught >= 0.5:
            return lexicon
    return best[1]


def build(counts: DataFrame, n1: float, n0: float, min_z: float) -> Lexicon:
    """The terms whose log-odds exceed ``min_z`` standard errors."""
    a = n1 * (F.col("y1") + F.col("y0")) / (n1 + n0)
    odds = (F.log((F.col("y1") + a) / (2 * n1 - F.col("y1") - a)) - F.log((F.col("y0") + a) / (n0 + n1 - F.col("y0") - a)))
    z = odds / F.sqrt(1 / (F.col("y1") + a) + 1 / (F.col("y0") + a))
    # As many terms at most as the toxic documents of the sample hold often enough to be certain.
    table = counts.filter("y1 > 0").filter(z > min_z).orderBy("term").toPandas()
    y1, y0 = table["y1"].to_numpy(float), table["y0"].to_numpy(float)
    # A word outside the lexicon: its share of the words of each class.
    in1, in0 = min(0.5, y1.sum() / n1), min(0.5, (y0.sum() + 1) / n0)
    miss = min(math.log(1 - in1) - math.log(1 - in0), -0.01)
    return Lexicon(table["term"].tolist(), y1, y0, n1, n0, miss, min_z)


def calibrate(lexicon: Lexicon, rows: DataFrame) -> tuple[float, float]:
    """Fits ``log_k`` and ``curve``; returns the share of the toxic sample
    documents that are caught and the mean loss, each without its own counts."""
    shared = rows.sparkSession.sparkContext.broadcast(lexicon)

    def run(batches):
        for b in batches:
            out = {"toxic": b["toxic"], "n": [], "best": []}
            for text, toxic in zip(b["text"], b["toxic"]):
                tokens = words(text)
                found = shared.value.segments(shared.value.hits(tokens, 1 if toxic else 2))
                out["n"].append(max(1, len(tokens)))
                out["best"].append(max([0.0, *(x[0] for x in found)]))
            yield out

    seen = map_rows(rows, "toxic int, n long, best double", run)
    # Location of the extreme-value law over clean documents with some segment, rate 1 fixed.
    k = seen.filter("toxic = 0 and best > 0").agg(F.avg(F.col("n") * F.exp(-F.col("best")))).first()[0]
    lexicon.log_k = -math.log(k) if k else 0.0
    lexicon.log_k = max(-12.0, min(0.0, lexicon.log_k))
    again = rows.sparkSession.sparkContext.broadcast(lexicon)

    def measure(batches):
        for b in batches:
            f = [again.value.features(words(t), 1 if y else 2) for t, y in zip(b["text"], b["toxic"])]
            yield {"toxic": b["toxic"], "f": [list(x) for x in f]}

    sample = map_rows(rows, "toxic int, f array<double>", measure).groupBy("toxic", "f").count().toPandas()
    x = np.array(sample["f"].tolist())
    y, weight = sample["toxic"].to_numpy(float), sample["count"].to_numpy()
    lexicon.curve = logistic(np.repeat(x, weight, axis=0), np.repeat(y, weight))
    score = np.clip(x @ lexicon.curve, -700, 700)
    caught = weight[(y == 1) & (score >= 0)].sum() / weight[y == 1].sum()
    return float(caught), float(np.average(np.logaddexp(0, np.where(y == 1, -score, score)), weights=weight))


def score_documents(docs: DataFrame, lexicon: Lexicon) -> DataFrame:
    """doc_id, score."""
    shared = docs.sparkSession.sparkContext.broadcast(lexicon)

    def run(batches):
        for b in batches:
            yield {"doc_id": b["doc_id"], "score": [shared.value.score(t) for t in b["text"]]}

    return map_rows(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), "doc_id long, score double", run)


def toxic_passages(docs: DataFrame, lexicon: Lexicon) -> DataFrame:
    """doc_id, first_word, last_word, passage_score: one row per significant passage."""
    shared = docs.sparkSession.sparkContext.broadcast(lexicon)

    def run(batches):
        for b in batches:
            rows = [(d, x) for d, t in zip(b["doc_id"], b["text"]) for x in shared.value.passages(words(t))]
            yield {"doc_id": [d for d, _ in rows], "first_word": [x[1] for _, x in rows],
                   "last_word": [x[2] for _, x in rows], "passage_score": [x[0] for _, x in rows]}

    return map_rows(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"),
                    "doc_id long, first_word long, last_word long, passage_score double", run)


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    lexicon = fit(docs, read_table(spark, sf_dir, "labels"))
    held = F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(5)) == 0, F.lit(False))
    return score_documents(docs, lexicon).select(
        "doc_id", held.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"),
        (F.col("score") < 0.5).alias("kept"))
