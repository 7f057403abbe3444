import numpy as np
from quarry.llm import op10_ann as op

SCHEMA = "vec_id long, embedding array<float>, label int, score string"


def plain(rows, k=op.K):
    ok = {}
    for i, v in rows:
        if i is None or v is None or any(x is None or not np.isfinite(x) for x in v) or not any(v):
            continue
        ok.setdefault((i, tuple(np.float32(v).tolist())), None)
    out = {}
    for i, v in ok:
        if i % 20 == 0:
            found = sorted((-float((np.array(v) * np.array(u)).sum()), j) for j, u in ok if j != i and len(u) == len(v))
            out.setdefault(i, []).extend(found[:k])
    return out


def same(got, want):
    by = {}
    for r in got:
        by.setdefault(r.query_id, []).append(r)
    assert {q for q in by} == {q for q, f in want.items() if f}
    for q, own in by.items():
        own.sort(key=lambda r: r["rank"])
        assert [r["rank"] for r in own] == list(range(1, len(own) + 1))
        assert [r.vec_id for r in own] == [j for _, j in want[q]]
        assert np.allclose([r.score for r in own], [-s for s, _ in want[q]], rtol=0, atol=1e-12)


def test_odd_vectors(spark, tmp_path):
    r = np.random.default_rng(2)
    rows = [(i, r.normal(size=7).astype(float).tolist()) for i in range(300)]
    hot = r.normal(size=7).tolist()
    rows += [(i, hot) for i in range(300, 460)]
    rows += [(460, None), (480, [0.0] * 7), (500, [float("nan")] + [1.0] * 6), (520, [None] + [1.0] * 6),
             (540, [float("inf")] + [1.0] * 6), (560, [1.0, 2.0]), (561, [3.0, 1.0]), (580, [1.0]), (None, hot), (600, []),
             rows[0], rows[0], (1, rows[1][1])]
    spark.createDataFrame([(i, v, 1, "s") for i, v in rows], SCHEMA).write.parquet(f"{tmp_path}/embeddings.parquet")
    same(op.op10_nearest(spark, str(tmp_path)).collect(), plain(rows))


def test_many_cells(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(op, "QUERY_BLOCK", 10)
    monkeypatch.setattr(op, "ROW_BLOCK", 100)
    r = np.random.default_rng(3)
    rows = [(i, r.normal(size=70).astype(float).tolist()) for i in range(900)]
    spark.createDataFrame([(i, v, 1, "s") for i, v in rows], SCHEMA).write.parquet(f"{tmp_path}/embeddings.parquet")
    same(op.op10_nearest(spark, str(tmp_path)).collect(), plain(rows))


def test_recall_on_the_small_table(spark):
    sf = "/root/testdata/sf0.01"
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()]
    want = plain(rows)
    got = {}
    for r in op.op10_nearest(spark, sf).collect():
        got.setdefault(r.query_id, set()).add(r.vec_id)
    recall = np.mean([len(got[q] & {j for _, j in f}) / len(f) for q, f in want.items()])
    assert recall >= 0.99


def test_bounds_hold_and_choose_few():
    r = np.random.default_rng(5)
    x, q = r.normal(size=(4000, 128)), r.normal(size=128)
    turn = op.rotation(128)
    codes, norm, shadow = op.encode(x, turn)
    estimate, error = op.Query(q, turn).bounds(codes, np.bitwise_count(codes).sum(axis=1), norm, shadow)
    assert (np.abs(estimate - x @ q) <= error).mean() > 0.98
    chosen = op.choose(estimate, error, x, q, 20)
    assert len(chosen) < 0.4 * len(x) and set(np.argsort(-(x @ q))[:20]) <= set(chosen)


def test_empty_table(spark, none):
    assert op.op10_nearest(spark, none).count() == 0
