"""Operator 7: language by prediction by partial matching.

For every language a context tree over bytes is counted on a bounded sample
of labelled rows and then frozen. A byte costs ``-log2`` of its probability
in the longest context (up to ``ORDER`` bytes) that the language has seen;
if the byte was not seen there, the escape probability (method C: distinct
followers against all) is paid and the next shorter context tried, down to a
uniform byte. A text's code length in a language is the sum over all its
bytes; the shortest one is predicted. Costs depend on the last ``ORDER`` + 1
bytes only, so those of all strings in the sample are tabulated once and
looked up by hash, the others are computed by escaping.

The fit is the only bounded part: about ``SAMPLE_DOCS`` documents of each of
the ``MAX_LANGUAGES`` most frequent labels, drawn by a hash of the id, whole
texts. Every row is scored whole,
where it is read, without a shuffle. The tables that are broadcast grow with
the sample, not with the corpus.

Defined results: a null text or one without a letter is ``und`` with score 0;
with no labelled row everything is ``und``; equal code lengths go to the
smaller name; repeated rows repeat; an empty table gives an empty result;
other columns are not read.
"""

from __future__ import annotations

import re

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructField, StructType

from quarry.llm.common import documents, fresh, map_rows, share

ORDER = 3
SAMPLE_DOCS = 400      # labelled documents per language that the fit reads, about
MAX_LANGUAGES = 1000   # labels that are learned, the most frequent ones
MIN_SCORE = 0.5        # below it a document is rejected as of no sure language
SLICE = 1 << 20        # bytes scored at a time, at most,
SLICE_CELLS = 1 << 23  # and costs (a byte in a language) held at a time
TABLE_CELLS = 1 << 26  # costs in the model's table; those of rarer strings are computed when met
PAD = b"\n" * ORDER    # context of a text's first bytes
LETTER = re.compile(r"[^\W\d_]")
MIX = np.uint64(0x9E3779B97F4A7C15)


def _windows(data: bytes) -> np.ndarray:
    """For every byte after the padding: the last ORDER + 1 bytes as one number."""
    raw = np.frombuffer(data, np.uint8).astype(np.uint64)
    n = len(raw) - ORDER
    key = np.zeros(n, np.uint64)
    for k in range(ORDER + 1):
        key = (key << np.uint64(8)) | raw[k:k + n]
    return key


def training_rows(docs: DataFrame, sample_docs: int = SAMPLE_DOCS) -> DataFrame:
    """text, lang of the rows the fit may read: labelled, not held out, sampled by id hash."""
    rows = docs.filter(F.col("lang").isNotNull() & F.col("text").isNotNull()
                       & (F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(4)) != 2))
    sizes = rows.groupBy("lang").count().orderBy(F.col("count").desc(), "lang").limit(MAX_LANGUAGES)
    # At most MAX_LANGUAGES rows: broadcast, so that no text is shuffled by language.
    return (rows.select("doc_id", "text", "lang").join(F.broadcast(sizes), "lang")
            .filter(share(["doc_id"], 7) * F.col("count") < sample_docs).select("lang", "text"))


def count_contexts(rows: DataFrame) -> DataFrame:
    """lang, gram (ORDER + 1 bytes), n over all bytes of the rows."""
    def run(batches):
        for b in batches:
            by_lang: dict[str, list[np.ndarray]] = {}
            for lang, text in zip(b["lang"], b["text"]):
                by_lang.setdefault(lang, []).append(_windows(PAD + text.encode()))
            for lang, keys in by_lang.items():
                gram, n = np.unique(np.concatenate(keys), return_counts=True)
                yield {"lang": [lang] * len(gram), "gram": gram.astype(np.int64).tolist(), "n": n.tolist()}

    return map_rows(rows, "lang string, gram long, n long", run).groupBy("lang", "gram").agg(F.sum("n").alias("n"))


class Model:
    """Frozen statistics and the table of costs in bits, one column per language."""

    def __init__(self, counts: dict[str, tuple[np.ndarray, np.ndarray]]):
        self.languages = sorted(counts)
        self.trees = [self._tree(*counts[x]) for x in self.languages]
        self.slice = max(ORDER + 1, min(SLICE, SLICE_CELLS // max(1, len(counts))))
        grams = self._frequent(counts, TABLE_CELLS // (6 * max(1, len(counts))))
        self.bits = max(12, int(np.ceil(np.log2(max(2, len(grams)) * 3))))
        self.slots = np.full((1 << self.bits) + 64, np.uint64(1) << np.uint64(63))
        self.costs = np.zeros((len(self.slots), len(self.languages)), np.float32)
        if len(grams):
            self._place(grams)

    @staticmethod
    def _frequent(counts: dict[str, tuple[np.ndarray, np.ndarray]], most: int) -> np.ndarray:
        """The strings of all languages, or the ``most`` frequent ones of them (ties: the smaller)."""
        if not counts:
            return np.empty(0, np.uint64)
        grams, at = np.unique(np.concatenate([g for g, _ in counts.values()]), return_inverse=True)
        if len(grams) <= most:
            return grams
        n = np.bincount(at, weights=np.concatenate([n for _, n in counts.values()]))
        return np.sort(grams[np.argsort(-n, kind="stable")[:most]])

    @staticmethod
    def _tree(gram: np.ndarray, n: np.ndarray) -> list[tuple]:
        """Per order k: (strings of k + 1 bytes, counts), (contexts, totals, distinct followers)."""
        out = []
        for k in range(ORDER + 1):
            part = gram & np.uint64((1 << 8 * (k + 1)) - 1)
            keys, at = np.unique(part, return_inverse=True)
            c = np.bincount(at, weights=n)
            ctx, at = np.unique(keys >> np.uint64(8), return_inverse=True)
            out.append((keys, c, ctx, np.bincount(at, weights=c), np.bincount(at).astype(float)))
        return out

    def escape_costs(self, grams: np.ndarray) -> np.ndarray:
        """Cost of every string in every language, from the trees."""
        out = np.empty((len(grams), len(self.languages)))
        for j, tree in enumerate(self.trees):
            cost = np.full(len(grams), 8.0)
            for k, (keys, c, ctx, total, distinct) in enumerate(tree):  # from the shortest context on
                part = grams & np.uint64((1 << 8 * (k + 1)) - 1)
                at = np.minimum(np.searchsorted(ctx, part >> np.uint64(8)), len(ctx) - 1)
                known = ctx[at] == part >> np.uint64(8)
                of = np.minimum(np.searchsorted(keys, part), len(keys) - 1)
                seen = keys[of] == part
                whole = total[at] + distinct[at]
                here = np.where(seen, -np.log2(np.maximum(c[of], 1) / whole), cost - np.log2(distinct[at] / whole))
                cost = np.where(known, here, cost)
            out[:, j] = cost
        return out

    def _home(self, grams: np.ndarray) -> np.ndarray:
        return ((grams * MIX) >> np.uint64(64 - self.bits)).astype(np.int64)

    def _place(self, grams: np.ndarray) -> None:
        """Open addressing with at most 64 steps; what finds no slot is computed when met."""
        costs = self.escape_costs(grams)
        at, left = self._home(grams), np.arange(len(grams))
        empty = np.uint64(1) << np.uint64(63)
        for _ in range(64):
            free = left[self.slots[at[left]] == empty]
            slot, first = np.unique(at[free], return_index=True)
            self.slots[slot] = grams[free[first]]
            self.costs[slot] = costs[free[first]]
            left = left[self.slots[at[left]] != grams[left]]
            at[left] += 1
            if not len(left):
                break

    def bits_of(self, grams: np.ndarray) -> np.ndarray:
        at = self._home(grams)
        open_ = np.flatnonzero(self.slots[at] != grams)
        empty = np.uint64(1) << np.uint64(63)
        missing = []
        for _ in range(64):
            none = self.slots[at[open_]] == empty
            missing.append(open_[none])
            open_ = open_[~none]
            if not len(open_):
                break
            at[open_] += 1
            open_ = open_[self.slots[at[open_]] != grams[open_]]
        missing.append(open_)
        out = self.costs[at]
        missing = np.concatenate(missing)
        if len(missing):
            new, back = np.unique(grams[missing], return_inverse=True)
            out[missing] = self.escape_costs(new)[back]
        return out

    def code_lengths(self, texts: list[str]) -> np.ndarray:
        """Bits of every whole text in every language, a bounded number of costs at a time."""
        out = np.zeros((len(texts), len(self.languages)))
        group: list[tuple[int, bytes]] = []
        held = 0

        def flush():
            if group:
                data = b"".join(PAD + d for _, d in group)
                cost = self.bits_of(_windows(data))
                # Windows that end in a following text's padding lie between the texts: each run of rows is a text or padding.
                size = np.array([[len(d), ORDER] for _, d in group]).reshape(-1)[:-1]
                first = np.cumsum(size) - size
                sums = np.add.reduceat(cost, first, axis=0, dtype=np.float64)[::2]
                for (i, _), s in zip(group, sums):
                    out[i] += s
            group.clear()

        for i, t in enumerate(texts):
            data = t.encode()
            if not data:
                continue
            if len(data) > self.slice:
                for a in range(0, len(data), self.slice):
                    piece = (PAD + data)[a:a + self.slice + ORDER] if a == 0 else data[a - ORDER:a + self.slice]
                    out[i] += self.bits_of(_windows(piece)).sum(axis=0, dtype=np.float64)
                continue
            if held + len(data) > self.slice:
                flush()
                held = 0
            group.append((i, data))
            held += len(data) + ORDER
        flush()
        return out

    def predict(self, texts: list[str | None]) -> tuple[list[str], list[float]]:
        """Language and score: the probability of the predicted language given
        the code lengths, each language equally likely before."""
        langs, scores = ["und"] * len(texts), [0.0] * len(texts)
        some = [i for i, t in enumerate(texts) if t and LETTER.search(t)]
        if some and self.languages:
            cost = self.code_lengths([texts[i] for i in some])
            best = cost.argmin(axis=1)
            gap = np.minimum(cost - cost[np.arange(len(some)), best][:, None], 1000.0)
            score = 1.0 / np.exp2(-gap).sum(axis=1)
            for i, j, s in zip(some, best.tolist(), score.tolist()):
                langs[i], scores[i] = self.languages[j], s
        return langs, scores


def fit(docs: DataFrame, sample_docs: int = SAMPLE_DOCS) -> Model:
    """Only the counted strings of the bounded sample reach the driver."""
    table = count_contexts(training_rows(docs, sample_docs)).toPandas()
    return Model({lang: (g["gram"].to_numpy(np.int64).astype(np.uint64), g["n"].to_numpy(float))
                  for lang, g in table.groupby("lang")})


def predict_language(docs: DataFrame, model: Model, keep: list[str], prefix: str = "") -> DataFrame:
    """The columns ``keep`` of every row, passed on as they are, with lang_pred and score named after ``prefix``."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    own = fresh([*keep, prefix + "lang_pred", prefix + "score"], "__text")
    rows = docs.select(*[F.col(f"`{c}`") for c in keep], F.col("text").alias(own))
    schema = docs.select(*[F.col(f"`{c}`") for c in keep]).schema
    schema = StructType([*schema.fields, StructField(prefix + "lang_pred", StringType()), StructField(prefix + "score", DoubleType())])

    def run(batches):
        for b in batches:
            langs, scores = shared.value.predict(b.pop(own).to_pylist())
            yield {**b, prefix + "lang_pred": langs, prefix + "score": scores}

    return map_rows(rows, schema, run, as_is=rows.columns)


def op7_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    out = predict_language(docs, fit(docs), ["doc_id"])
    held = F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(4)) == 2
    return out.select("doc_id", F.coalesce(held, F.lit(False)).alias("held_out"), "lang_pred", "score")
