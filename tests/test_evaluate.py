"""Metrics against the hand-computed fixtures and a plain-Python model."""

import math
import random

import pytest

from quarry.operators import evaluate as ev


def test_topk_fixture(spark):
    pred = spark.createDataFrame(
        [("q1", u, i + 1) for i, u in enumerate(["a", "b", "b", "c", "d"])]
        + [("q2", u, i + 1) for i, u in enumerate(["x", "y"])], "query_id string, url string, rank int")
    truth = spark.createDataFrame([("q1", "b"), ("q1", "z"), ("q2", "q")], "query_id string, url string")
    r = ev.evaluate_topk(pred, truth, k=5).first()
    assert (r["precision"], r["recall"], r["f1"], r["mrr"], r["topk_accuracy"]) == (0.125, 0.25, 0.1667, 0.25, 0.5)


def formula_table(preds, truth, k):
    """A10-A12 written as formulas over 0/1 relevance vectors, one row per query that has both sides."""
    rows = []
    for q in sorted(preds.keys() & truth.keys()):
        if not (preds[q] and truth[q]):
            continue
        gains = [int(u in truth[q]) for u in preds[q]][:k]
        distinct = dict(zip(preds[q][:k], gains))
        p, r = sum(distinct.values()) / len(distinct), sum(distinct.values()) / len(truth[q])
        f1 = 0.0 if not sum(gains) else 2 / (1 / p + 1 / r)
        rr = max(g / place for place, g in enumerate(gains, start=1))
        rows.append((p, r, f1, rr, max(gains)))
    return [round(sum(c) / len(rows), 4) for c in zip(*rows)]


@pytest.mark.parametrize("seed", [1, 2])
def test_topk_matches_python(spark, seed):
    rnd = random.Random(seed)
    preds = {f"q{i}": [f"u{rnd.randrange(12)}" for _ in range(rnd.randrange(0, 9))] for i in range(30)}
    truth = {f"q{i}": {f"u{rnd.randrange(12)}" for _ in range(rnd.randrange(0, 4))} for i in range(35)}
    pdf = spark.createDataFrame([(q, u, i + 1) for q, us in preds.items() for i, u in enumerate(us)],
                                "query_id string, url string, rank int")
    tdf = spark.createDataFrame([(q, u) for q, us in truth.items() for u in us], "query_id string, url string")
    r = ev.evaluate_topk(pdf, tdf, k=5).first()
    assert [r["precision"], r["recall"], r["f1"], r["mrr"], r["topk_accuracy"]] == formula_table(preds, truth, 5)


def _rel_fixture(spark):
    ann = spark.createDataFrame([("Py", "Q", u, float(r), "") for u, r in
                                 [("u1", 0), ("u2", 3), ("u3", 1), ("u4", 2)]],
                                "Language string, Query string, GitHubUrl string, Relevance double, Notes string")
    pred = spark.createDataFrame([("py", "q", u, i + 1) for i, u in enumerate(["u1", "n1", "u2", "u3"])],
                                 "language string, query string, url string, rank int")
    return ev.relevance_table(ann), ev.cut_predictions(pred, 300)


def test_ndcg_and_coverage_fixture(spark):
    rel, cut = _rel_fixture(spark)
    assert round(ev.ndcg(rel, cut).first()["ndcg"], 6) == 0.523434
    assert round(ev.ndcg(rel, cut, full_ranking=True).first()["ndcg"], 6) == 0.418478
    assert ev.coverage(rel, cut).first()["coverage"] == pytest.approx(3 / 4)
    assert ev.coverage(rel, cut, positive_only=True).first()["coverage"] == pytest.approx(2 / 3)


def test_ndcg_ideal_uses_all_annotations(spark):
    rel, cut = _rel_fixture(spark)
    # ideal DCG over relevances 3, 2, 1, 0
    idcg = sum((2 ** r - 1) / math.log2(i + 2) for i, r in enumerate([3, 2, 1, 0]))
    dcg = (2 ** 0 - 1) / math.log2(2) + (2 ** 3 - 1) / math.log2(3) + (2 ** 1 - 1) / math.log2(4)
    assert ev.ndcg(rel, cut).first()["ndcg"] == pytest.approx(dcg / idcg)


def test_relevance_case_folding_last_key_wins(spark):
    ann = spark.createDataFrame([("Py", "Q", "u", 1.0, ""), ("py", "q", "u", 3.0, ""), ("Py", "Q", "u", 2.0, "")],
                                "Language string, Query string, GitHubUrl string, Relevance double, Notes string")
    r = ev.relevance_table(ann).first()
    # sorted keys: ('Q','Py') < ('q','py'); the later one (mean 3.0) wins
    assert (r["language"], r["query"], r["relevance"]) == ("py", "q", 3.0)


def test_ndcg_ideal_chunks_large_group(spark):
    import numpy as np
    from pyspark.sql import functions as F

    n = 200_000  # > 3 chunks of positions for one (language, query)
    ann = (spark.range(n).select(F.lit("py").alias("Language"), F.lit("q").alias("Query"),
                                 F.concat(F.lit("u"), F.col("id").cast("string")).alias("GitHubUrl"),
                                 F.lit(1.0).alias("Relevance")))
    pred = spark.createDataFrame([("py", "q", "u0", 1), ("py", "q", "x", 2), ("py", "q", "u1", 3)],
                                 "language string, query string, url string, rank int")
    rel, cut = ev.relevance_table(ann), ev.cut_predictions(pred)
    idcg = float(np.sum(1.0 / np.log2(np.arange(1, n + 1) + 1)))
    assert ev.ndcg(rel, cut).first()["ndcg"] == pytest.approx((1 + 1 / np.log2(3)) / idcg, rel=1e-9)
    assert ev.ndcg(rel, cut, full_ranking=True).first()["ndcg"] == pytest.approx((1 + 1 / np.log2(4)) / idcg, rel=1e-9)
