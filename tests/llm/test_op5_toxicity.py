import random
import zlib

import numpy as np
from quarry.llm import op5_toxicity as op

SMALL = "/root/testdata/sf0.01"


def lexicon(scores, miss=-0.5):
    x = op.Lexicon([], np.empty(0), np.empty(0), 1.0, 1.0, miss)
    x.table = {w: [s, s, s] for w, s in scores.items()}
    x.fitted = True
    return x


def all_maximal(scores):
    """Maximal scoring subsequences by their definition: cut out the best (leftmost, shortest) one, go on at both sides."""
    if not scores or max(scores) <= 0:
        return []
    best = max(((round(sum(scores[a:z]), 9), -(z - a), -a) for a in range(len(scores)) for z in range(a + 1, len(scores) + 1)))
    a, z = -best[2], -best[2] - best[1]
    left = [(x, s, e) for x, s, e in all_maximal(scores[:a])]
    right = [(x, s + z, e + z) for x, s, e in all_maximal(scores[z:])]
    return left + [(best[0], a, z - 1)] + right


def test_segments_equal_the_definition():
    r = random.Random(2)
    for _ in range(300):
        words = [r.choice("pqrn") for _ in range(r.randint(0, 14))]
        values = {"p": 1.3, "q": 2.7, "r": 0.6, "n": -0.85}
        lex = lexicon({"p": 1.3, "q": 2.7, "r": 0.6}, miss=-0.85)
        got = [(round(s, 6), a, b) for s, a, b in lex.segments(lex.hits(words, 0))]
        assert got == [(round(s, 6), a, b) for s, a, b in all_maximal([values[w] for w in words])]


def test_long_text_and_no_words():
    lex = lexicon({"bad": 4.0})
    lex.curve = np.array([-3.0, 1.0, 0.0, 0.0])
    text = "fine " * 200_000 + "bad bad"
    assert lex.passages(op.words(text)) == [] or lex.passages(op.words(text))[0][1:] == (200_000, 200_001)
    assert lex.score(text) > lex.score("fine") == lex.score("") == lex.score(None)


def test_held_out_accuracy(spark):
    labels = {r.doc_id: r.toxic for r in spark.read.parquet("/root/testdata/sf0.1/labels.parquet").collect()}
    out = op.op5_toxicity(spark, "/root/testdata/sf0.1").collect()
    assert len(out) == 10_000
    for r in out:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0)
        assert 0 <= r.score <= 1 and r.predicted == (r.score >= 0.5)
    held = [(labels[r.doc_id], r.predicted) for r in out if r.held_out and r.doc_id in labels]
    true = sum(a and b for a, b in held)
    assert true / sum(b for _, b in held) > 0.95 and true / sum(a for a, _ in held) > 0.9


def test_held_out_labels_are_not_read(spark, tmp_path):
    """Turning round every held-out label changes no score."""
    from pyspark.sql import functions as F

    scores = []
    for flip in (False, True):
        root = tmp_path / str(flip)
        spark.read.parquet(f"{SMALL}/documents.parquet").write.parquet(f"{root}/documents.parquet")
        held = F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(5)) == 0
        toxic = F.when(held & F.lit(flip), 1 - F.col("toxic")).otherwise(F.col("toxic"))
        spark.read.parquet(f"{SMALL}/labels.parquet").withColumn("toxic", toxic).write.parquet(f"{root}/labels.parquet")
        scores.append(sorted((r.doc_id, r.score) for r in op.op5_toxicity(spark, str(root)).collect()))
    assert scores[0] == scores[1]


def test_odd_rows_and_empty_tables(spark, odd, none, odd_docs):
    out = op.op5_toxicity(spark, odd).collect()
    assert sorted(str(r.doc_id) for r in out) == sorted(str(d) for d, _ in odd_docs)
    assert all(0 <= r.score <= 1 for r in out)
    assert op.op5_toxicity(spark, none).count() == 0


def test_passages_of_the_query(spark):
    df = spark.createDataFrame([(1, "one two bad awful three " + "four " * 40 + "awful bad bad"), (2, None), (3, "one")], "doc_id long, text string")
    lex = lexicon({"bad": 6.0, "awful": 5.0})
    got = sorted((r.doc_id, r.first_word, r.last_word) for r in op.toxic_passages(df, lex).collect())
    assert got == [(1, 2, 3), (1, 45, 47)]


def test_log_odds_order():
    y1, y0 = np.array([50.0, 5.0, 50.0]), np.array([0.0, 0.0, 400.0])
    odds, error = op.log_odds(y1, y0, 1000.0, 8000.0)
    assert odds[0] / error[0] > odds[1] / error[1] > op.MIN_Z > abs(odds[2] / error[2])


def test_few_labels_catch_toxic_documents(spark):
    """Ten toxic documents, each with four of ten insults: too few stand out by MIN_Z."""
    r = random.Random(3)
    clean = ["".join(r.choice("abcdefgh") for _ in range(3)) for _ in range(400)]
    insults = [c + "zyx" for c in "klmnopqrst"]
    rows, labels = [], []
    for i in range(400):
        tokens = [r.choice(clean) for _ in range(120)]
        if i % 6 == 0:
            for at, w in zip(r.sample(range(120), 8), r.sample(insults, 4) * 2):
                tokens[at] = w
        rows.append((i, " ".join(tokens)))
        if i < 66:
            labels.append((i, int(i % 6 == 0)))
    docs, marked = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int")
    lex = op.fit(docs, marked)
    found = {r.doc_id: r.score >= 0.5 for r in op.score_documents(docs, lex).collect() if r.doc_id >= 66}
    assert sum(found[i] for i in found if i % 6 == 0) >= 0.9 * sum(i % 6 == 0 for i in found)
    assert sum(found[i] for i in found if i % 6) <= 0.05 * len(found)
