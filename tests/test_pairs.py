"""Relevance pairs, sampling and distributed indexes."""

from pyspark.sql import functions as F

from quarry.functions import text as tx
from quarry.operators import pairs as pr
from quarry.operators import split as sp


def _inputs(spark):
    req = spark.createDataFrame(
        [(1, "acme/app", "c1", "+def foo(a):\n+class Bar(Base):", "fix foo"),
         (2, "acme/app", "c1", "+def nothing(", "no label"),
         (3, "acme/lib", "c2", "-def baz(x):", "fix baz")],
        "request_id long, repo string, base_commit string, patch string, problem_statement string")
    defs = spark.createDataFrame(
        [("app_c1", f"f{i % 7}.py", "function", f"fn{i}", f"body{i}", i) for i in range(300)]
        + [("app_c1", "a.py", "function", "foo", "foo body", 1), ("app_c1", "b.py", "class", "Bar", "bar body", 5),
           ("app_c1", "b.py", "function", "Bar", "not a class", 9), ("lib_c2", "z.py", "function", "baz", "bz", 2)],
        "save_path string, file string, kind string, name string, body string, start_line int")
    return pr.labels_from_patch(req), defs


def test_positives_and_negatives(spark):
    req, defs = _inputs(spark)
    pairs = pr.build_pairs(req, defs, p=0.2, seed="s").collect()
    pos = sorted((r["request_id"], r["kind"], r["GitHubUrl"]) for r in pairs if r["Relevance"] == 1)
    assert pos == [(1, "class", "app_c1#Bar"), (1, "function", "app_c1#foo"), (3, "function", "lib_c2#baz")]
    neg = [r for r in pairs if r["Relevance"] == 0]
    assert all(r["request_id"] == 1 for r in neg)  # request 2 is unlabelled (P6)
    assert all(r["GitHubUrl"] not in ("app_c1#foo",) or r["kind"] != "function" for r in neg)
    assert 30 <= len(neg) <= 95  # ~0.2 x 302 candidates
    again = pr.build_pairs(req, defs, p=0.2, seed="s").collect()
    assert sorted(map(tuple, pairs)) == sorted(map(tuple, again))


def test_without_chance_nothing_is_drawn(spark):
    req, defs = _inputs(spark)
    pairs = pr.build_pairs(req, defs, p=0.0, seed="s")
    assert "EvalPython" not in pairs._jdf.queryExecution().executedPlan().toString()
    assert sorted((r["request_id"], r["kind"], r["Relevance"]) for r in pairs.collect()) == [(1, "class", 1), (1, "function", 1), (3, "function", 1)]


def test_group_index_is_dense_and_ordered(spark):
    rows = [(g, v) for g in ("a", "b", "c") for v in range(50 if g != "b" else 5)]
    df = spark.createDataFrame(rows, "g string, v long").repartition(4)
    got = sp.with_group_index(df, ["g"], ["v"]).collect()
    for g in ("a", "b", "c"):
        items = sorted((r["v"], r["idx"]) for r in got if r["g"] == g)
        assert [i for _, i in items] == list(range(len(items)))
    idx = sp.with_row_index(df, ["g", "v"], "pos").collect()
    assert sorted(r["pos"] for r in idx) == list(range(len(rows)))
    by_pos = sorted(idx, key=lambda r: r["pos"])
    assert [(r["g"], r["v"]) for r in by_pos] == sorted(rows)


def test_a_null_group_has_an_index(spark):
    df = spark.createDataFrame([(None, 1), (None, 2), ("a", 1)], "g string, v long")
    got = sorted((str(r["g"]), r["v"], r["idx"]) for r in sp.with_group_index(df, ["g"], ["v"]).collect())
    assert got == [("None", 1, 0), ("None", 2, 1), ("a", 1, 0)]


def test_sample_negatives_repeatable(spark):
    df = spark.range(2000).withColumn("k", F.col("id"))
    a = {r["id"] for r in sp.sample_negatives(df, 0.1, "42", "k").collect()}
    b = {r["id"] for r in sp.sample_negatives(df.repartition(7), 0.1, "42", "k").collect()}
    assert a == b and 140 <= len(a) <= 260


def test_labelled_drops_empty(spark):
    df = spark.createDataFrame([("([], [])",), ("(['f'], [])",)], "t string")
    out = pr.labelled(df.withColumn("label", tx.parse_label("t")))
    assert out.count() == 1
