import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from quarry.llm import op11_negatives as op

SCHEMA = "vec_id long, embedding array<float>, label int, ids string, near string"


def plain(rows):
    """The contract by comparing every anchor with every row."""
    whole = {}
    for i, v, label in rows:
        if i is None or label is None or v is None or any(x is None or not math.isfinite(x) for x in v):
            continue
        label = (label + 1) % 10 if i % 7 == 0 else label
        whole[i] = min(whole.get(i, (label, [])), (label, [math.floor(256 * x) for x in v])) if i in whole else (label, [math.floor(256 * x) for x in v])
    out = set()
    for a, (label, v) in whole.items():
        if a % 100:
            continue
        scores = [(-sum(x * y for x, y in zip(v, w)), i, other) for i, (other, w) in whole.items() if i != a and len(w) == len(v)]
        scores.sort()
        for p, positive, _ in [s for s in scores if s[2] == label][:5]:
            fits = [(n, i) for n, i, other in scores if other != label and 80 * -p <= 100 * -n <= 100 * -p][:5]
            out |= {(a, positive, r + 1, i, -p, -n) for r, (n, i) in enumerate(fits)}
    return out


def found(spark, rows):
    df = spark.createDataFrame([r + ("x", "y") for r in rows], SCHEMA).repartition(3)
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    out = op.mine(op.prepared(df.withColumn("label", label)), F.col("vec_id") % 100 == 0).collect()
    assert len(out) == len(set(out))
    return {tuple(r) for r in out}


def made(seed, n, dim=8, centres=6, spread=0.15, labels=3):
    """Clustered vectors on a coarse grid (so that scores tie), with copies."""
    r = random.Random(seed)
    middle = [[r.uniform(-1, 1) for _ in range(dim)] for _ in range(centres)]
    rows = []
    for i in range(n):
        v = [round(x + r.gauss(0, spread), 1) for x in r.choice(middle)]
        rows.append((i * r.choice([1, 1, 4]) + 10_000 * (i % 7 == 3), v, r.randrange(labels)))
    return list({x[0]: x for x in rows}.values())


@pytest.mark.parametrize("seed, n, anchors, rows, tree", [(1, 900, 16384, 131072, 1024), (2, 1500, 4, 200, 3), (3, 1200, 1000, 300, 5)])
def test_equals_all_comparisons(spark, monkeypatch, seed, n, anchors, rows, tree):
    table = made(seed, n)
    table += [(i * 100, table[0][1], 0) for i in range(500, 512)]  # anchors near each other, one vector shared
    monkeypatch.setattr(op, "ANCHOR_BLOCK", anchors)
    monkeypatch.setattr(op, "ROW_BLOCK", rows)
    monkeypatch.setattr(op, "TREE_ANCHORS", tree)
    want = plain(table)
    assert want and found(spark, table) == want


def test_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    v = [0.5, -0.25, 0.125]
    table = [(0, v, 1), (100, [0.0] * 3, 1), (200, None, 1), (300, v, None), (None, v, 1), (400, [nan, 1.0, 1.0], 1), (500, [inf, 1.0, 1.0], 1),
             (600, [None, 1.0, 1.0], 1), (1, v, 1), (2, v, 2), (3, v, 2), (700, [1.0], 1), (5, [1.0], 1), (8, [0.9], 2), (9, [1.0], 2)]
    table += [(10 + i, v, 1 + i % 2) for i in range(40)] + [(0, v, 1), (2, v, 2)]
    table += [(900, [40_000.0, 1.0, 2.0], 1), (901, [40_000.0, 1.0, 2.0], 1), (902, [39_000.5, 1.0, 2.0], 2), (-100, v, 2), (1000, [], 1), (1002, [], 1), (1003, [], 2)]
    want = plain(table)
    assert {0, 100, 700, 900, -100, 1000} == {r[0] for r in want} and found(spark, table) == want


def test_given_table_and_empty_table(spark, none):
    path = "/root/testdata/sf0.01"
    table = [tuple(r) for r in spark.read.parquet(f"{path}/embeddings.parquet").select("vec_id", "embedding", "label").collect()]
    out = op.op11_hard_negatives(spark, path)
    assert out.columns[:6] == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    assert {tuple(r)[:6] for r in out.collect()} == plain(table)
    assert op.op11_hard_negatives(spark, none).count() == 0


def test_bounds_spare_rows():
    """Near anchors: intervals hold the scores, and few rows are scored again."""
    r = np.random.default_rng(4)
    x = np.floor(256 * r.standard_normal((4000, 16)))
    q = np.floor(256 * (r.standard_normal(16) + 0.002 * r.standard_normal((60, 16))))
    scored = 0

    def wanted(k, low, high):
        nonlocal scored
        true = x @ q[k]
        assert (low <= true).all() and (true <= high).all()
        chosen = op.surely_first(low, high)
        assert set(np.argsort(-true, kind="stable")[:op.FIRST + 1]) <= set(chosen)
        scored += len(chosen)
        return chosen

    assert len([k for k, *_ in op.walk(q, x, wanted)]) == 60
    assert scored < 0.05 * 59 * 4000


def test_tree_is_minimal_and_holds_few_intervals():
    q = np.random.default_rng(5).standard_normal((200, 3))
    parent, length = op.spanning_tree(q)
    d = np.sqrt(((q[:, None] - q[None]) ** 2).sum(axis=2))
    group = list(range(200))  # Kruskal's method
    total = 0.0
    for i, j in sorted(((i, j) for i in range(200) for j in range(i)), key=lambda p: d[p]):
        if group[i] != group[j]:
            total += d[i, j]
            a, b = group[i], group[j]
            group = [a if g == b else g for g in group]
    assert math.isclose(length.sum(), total)
    order = op.walk_order(parent)
    assert sorted(k for k, _ in order) == list(range(200))
    held, most = set(), 0
    for k, last in order:
        assert parent[k] < 0 or parent[k] in held
        if last and parent[k] >= 0:
            held.discard(parent[k])
        if k in parent:
            held.add(k)
        most = max(most, len(held))
    assert most <= 9
