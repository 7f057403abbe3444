"""Readers and writers round-trip texts exactly."""

import os
import tempfile

from pyspark.sql import types as T

from quarry.sources import io as sio


def test_blob_csv_roundtrip(spark):
    root = tempfile.mkdtemp()
    texts = ['  lead and trail  ', 'quote " inside, comma', 'multi\nline\r\nx', "", "é ü 中", None]
    df = spark.createDataFrame([(f"org/r{i} path/{i}.py", t) for i, t in enumerate(texts)],
                               "repo_path string, content string")
    sio.write_table(df, f"{root}/a", "csv")
    back = {r["path"]: r["content"] for r in sio.read_blobs(spark, f"{root}/a").collect()}
    assert [back[f"path/{i}.py"] for i in range(len(texts))] == texts


def test_jsonl_malformed_dropped_and_reported(spark):
    root = tempfile.mkdtemp()
    with open(os.path.join(root, "a.jsonl"), "w") as f:
        f.write('{"a": 1, "b": "x"}\nnot json\n{"a": 2, "b": "y"}\n')
    schema = T.StructType([T.StructField("a", T.LongType()), T.StructField("b", T.StringType())])
    assert sorted(r["a"] for r in sio.read_jsonl(spark, root, schema).collect()) == [1, 2]
    good, bad = sio.read_jsonl_reporting(spark, root, schema)
    assert good.count() == 2 and [r[0] for r in bad.collect()] == ["not json"]


def test_read_sources_by_suffix(spark):
    root = tempfile.mkdtemp()
    df = spark.createDataFrame([("a/x.py", "x = 1\n"), ("a/b/y.py", "y = 2"), ("a/z.txt", "no")],
                               "file string, content string")
    sio.write_files(df, root, "file", "content")
    got = {r["file"]: r["content"] for r in sio.read_sources(spark, root).collect()}
    assert got == {"a/x.py": "x = 1\n", "a/b/y.py": "y = 2"}


def test_blobs_query_keeps_rows_without_lang(spark, tmp_path):
    from quarry.plans.queries import io_blobs_csv

    rows = [(i, f"text {i}", lang, "src", 6) for i, lang in enumerate(["en", "fr", "de", None, None])]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    assert sorted(r.path for r in io_blobs_csv(spark, str(tmp_path)).collect()) == ["0", "1", "2", "3", "4"]


def test_sources_are_listed_and_read_by_few_tasks(spark, monkeypatch):
    """Folders at several depths, hidden names, bytes as they are; no more tasks than a few for each core."""
    monkeypatch.setattr(sio, "LIST_ROWS", 7)
    root = tempfile.mkdtemp()
    want = {}
    for i in range(200):
        name = f"r{i % 3}/" + "d/" * (i % 4) + f"f{i}.py"
        os.makedirs(os.path.dirname(f"{root}/{name}"), exist_ok=True)
        with open(f"{root}/{name}", "wb") as f:
            f.write(f"größe = {i}\r\n".encode())
        want[name] = f"größe = {i}\r\n"
    for hidden in ("r0/_x.py", "r0/.x.py", "_d/x.py", ".d/x.py", "r0/x.pyc"):
        os.makedirs(os.path.dirname(f"{root}/{hidden}"), exist_ok=True)
        open(f"{root}/{hidden}", "w").close()
    got = sio.read_sources(spark, root)
    assert {r["file"]: r["content"] for r in got.collect()} == want and got.count() == 200
    assert got.rdd.getNumPartitions() <= sio.READ_TASKS * spark.sparkContext.defaultParallelism
    assert "Scan text" not in got._jdf.queryExecution().executedPlan().toString()
    assert sio.read_sources(spark, root, (".go",)).count() == 0
