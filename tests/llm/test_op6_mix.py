import duckdb
import pytest
from quarry.llm import op6_mix as op


def plain_targets(sizes, weights=op.WEIGHTS, cap=op.MAX_EPOCHS):
    """Water-filling by its definition, over (source, size) in the order of the rule."""
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    w = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    left, open_, target = float(sum(sizes.values())), set(order), {}
    while open_:
        level = left / sum(w[s] for s in open_)
        over = {s for s in open_ if w[s] * level > cap * sizes[s]}
        if not over:
            target.update({s: w[s] * level for s in open_})
            break
        for s in over:
            target[s] = float(cap * sizes[s])
            left -= target[s]
        open_ -= over
    return target


@pytest.mark.parametrize("sizes", [{"a": 100, "b": 100, "c": 100}, {"a": 1, "b": 500, "c": 3, None: 40}, {"x": 0, "y": 10},
                                   {f"s{i}": (i * 37) % 91 for i in range(50)}, {"é": 5, "z": 7, "Z": 2, "": 9}])
def test_water_level(spark, sizes):
    df = spark.createDataFrame(list(sizes.items()), "source string, source_size long")
    got = {r.source: r.target for r in op.water_fill(df).collect()}
    want = plain_targets(sizes)
    assert got.keys() == want.keys() and all(abs(got[s] - want[s]) < 1e-6 for s in got)
    assert abs(sum(got.values()) - sum(sizes.values())) < 1e-6


def check(rows):
    by = {}
    for r in rows:
        by.setdefault(r.source, []).append(r)
    for own in by.values():
        largest = max(r.size for r in own)
        assert abs(sum(r.taken for r in own) - own[0].target) <= largest / 2 + 1
        assert all(r.taken <= op.MAX_EPOCHS * r.size and (r.size == 0 or r.taken % r.size == 0) for r in own)
        assert own[0].source_size == sum(r.size for r in own)


def test_odd_rows_rerun_and_oracle(spark, odd, odd_docs):
    docs = spark.read.parquet(f"{odd}/documents.parquet")
    rows = op.mix(docs).collect()
    assert len(rows) == len(odd_docs)
    check(rows)
    again = op.mix(docs.repartition(7)).collect()
    name = lambda rs: sorted((str(r.doc_id), r.size, r.taken) for r in rs)
    assert name(rows) == name(again)
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{odd}/documents.parquet/*.parquet'")
    want = con.execute(op.oracle()).fetchall()
    got = [tuple(r) for r in op.op6_mix_sources(spark, odd).collect()]
    assert sorted(map(str, got)) == sorted(map(str, want))


def test_one_hot_source(spark):
    rows = [(i, "w " * (i % 50 + 1), "hot" if i % 3 else f"s{i % 7}") for i in range(3000)]
    check(op.mix(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect())


def test_mixed_documents_are_the_taken_ones(spark, odd):
    docs = spark.read.parquet(f"{odd}/documents.parquet")
    out = op.mixed_documents(docs)
    assert out.columns == docs.columns
    assert out.count() == sum(r.epochs for r in op.mix(docs).collect())


def test_empty_table(spark, none):
    assert op.op6_mix_sources(spark, none).count() == 0
    assert op.mixed_documents(spark.read.parquet(f"{none}/documents.parquet")).count() == 0


def test_native(spark, odd):
    plan = op.op6_mix_sources(spark, odd)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan
