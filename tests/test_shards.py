"""Shards with retry, CSV in byte ranges, numbered chunks."""

import json
import os

import pytest
from pyspark.sql import functions as F

from quarry.operators import retrieve as rt
from quarry.operators import split as sp
from quarry.sources import io as sio
from quarry.sources import shards as sh


def write(path, text):
    with open(path, "w", newline="") as f:
        f.write(text)


def test_a_shard_that_fails_twice_is_read_and_one_that_always_fails_is_reported(spark, tmp_path):
    for i in (0, 1, 2):
        write(tmp_path / f"s0{i}.csv", f'repo_path,content\n"r{i} a.py","x = ""{i}""\nline 2"\n"r{i} b.py",\n')
    write(tmp_path / "s03.csv", "other,columns\n1,2\n")
    write(tmp_path / "s05.csv", "repo_path,content\n")
    marks = str(tmp_path)

    def opener(uri):  # shard 1 fails twice, shard 2 always
        name = os.path.basename(uri)
        seen = sum(f.startswith(name + ".try") for f in os.listdir(marks))
        if name == "s02.csv" or name == "s01.csv" and seen < 2:
            open(f"{marks}/{name}.try{seen}", "w").close()
            raise OSError("connection reset")
        return open(uri, "rb")

    blobs, lost = sh.read_shards(spark, f"{tmp_path}/s0{{}}.csv", [0, 1, 2, 3, 4, 5], attempts=3, delay=0.0, opener=opener)
    assert sorted((r.repo, r.path, r.content) for r in blobs.collect()) == \
        sorted((f"r{i}", p, f'x = "{i}"\nline 2' if p == "a.py" else "") for i in (0, 1) for p in ("a.py", "b.py"))
    report = {r.shard: r.error for r in lost.collect()}
    assert set(report) == {2, 3, 4} and "connection reset" in report[2] and "no columns" in report[3]
    assert len([f for f in os.listdir(marks) if f.startswith("s02.csv.try")]) == 3


ROWS = [("r a.py", "plain"), ("r b.py", 'quo"te, "comma"\nand\n\nbreaks\r\n'), ("r c.py", ""), ("r d.py", None), ("r é.py", "größe 日本 😀\n"), ("r e.py", "\n" * 50),
        ("r f.py", '"' * 41), ("r g.py", "x" * 500), ("r h.py", ",\n,"), ("r i.py", " lead and trail "), ("r j.py", "last")]


@pytest.mark.parametrize("range_bytes", [1, 7, 64, 100, 1 << 20])
def test_ranges_give_the_rows_of_the_whole_reader(spark, tmp_path, range_bytes):
    df = spark.createDataFrame(ROWS, "repo_path string, content string").coalesce(1)
    sio.write_table(df, f"{tmp_path}/csv", "csv")
    want = sorted((tuple(r) for r in sio.read_blobs(spark, f"{tmp_path}/csv").collect()), key=str)
    got = sh.read_blob_ranges(spark, f"{tmp_path}/csv", range_bytes=range_bytes)
    assert sorted((tuple(r) for r in got.collect()), key=str) == want and len(want) == len(ROWS)


def test_one_file_is_more_than_one_task(spark, tmp_path):
    df = spark.createDataFrame([(f"r{i} p", "line\n" * 200) for i in range(200)], "repo_path string, content string").coalesce(1)
    sio.write_table(df, f"{tmp_path}/csv", "csv")
    got = sh.read_blob_ranges(spark, f"{tmp_path}/csv", range_bytes=20_000).withColumn("task", F.spark_partition_id())
    assert got.count() == 200 and got.select("task").distinct().count() > 3


def test_ranges_of_odd_files(spark, tmp_path):
    os.makedirs(f"{tmp_path}/odd")
    write(f"{tmp_path}/odd/a.csv", "content,repo_path\r\nx,r p\r\n\"y\r\n\",r q")
    write(f"{tmp_path}/odd/b.csv", "")
    write(f"{tmp_path}/odd/c.csv", "repo_path,content")
    for n in (1, 3, 1000):
        got = sh.read_blob_ranges(spark, f"{tmp_path}/odd", range_bytes=n)
        assert sorted(tuple(r) for r in got.collect()) == [("r", "p", "x"), ("r", "q", "y\r\n")]


def test_chunks_of_exactly_so_many_rows(spark, tmp_path):
    df = spark.range(0, 2345).select((F.col("id") * 7919 % 2345).alias("id"), F.lit("ü\n").alias("t"))
    sh.write_numbered_jsonl(df, f"{tmp_path}/out", ["id"], 1000)
    assert sorted(os.listdir(f"{tmp_path}/out")) == ["chunk_0.jsonl", "chunk_1.jsonl", "chunk_2.jsonl"]
    rows = [[json.loads(line) for line in open(f"{tmp_path}/out/chunk_{i}.jsonl")] for i in range(3)]
    assert [len(r) for r in rows] == [1000, 1000, 345] and [x["id"] for r in rows for x in r] == list(range(2345))
    assert all(x["t"] == "ü\n" for r in rows for x in r)


def test_a_failed_job_leaves_no_chunk_and_a_repeated_task_no_double(spark, tmp_path):
    out = f"{tmp_path}/out"
    fail = F.udf(lambda i: 1 // 0 if i == 1700 else i, "long")
    with pytest.raises(Exception):
        sh.write_numbered_jsonl(spark.range(2000).select(fail("id").alias("id")), out, ["id"], 1000)
    assert not os.path.isdir(out) or os.listdir(out) == []
    # An attempt that ended before its commit: its file is of no job that commits.
    os.makedirs(out, exist_ok=True)
    write(f"{out}/.dead-attempt-0", "{}")
    sh.write_numbered_jsonl(spark.range(1500), out, ["id"], 1000)
    sh.write_numbered_jsonl(spark.range(1500), out, ["id"], 1000)
    assert sorted(os.listdir(out)) == [".dead-attempt-0", "chunk_0.jsonl", "chunk_1.jsonl"]
    assert [sum(1 for _ in open(f"{out}/chunk_{i}.jsonl")) for i in (0, 1)] == [1000, 500]
    sh.write_numbered_jsonl(spark.range(0), f"{tmp_path}/none", ["id"], 10)
    assert not os.path.isdir(f"{tmp_path}/none") or os.listdir(f"{tmp_path}/none") == []


def test_place_follows_the_given_order(spark):
    df = spark.range(500).select((F.col("id") * 37 % 500).alias("v"))
    rows = sp.with_place(df.orderBy(F.col("v").desc())).collect()
    assert sorted((r.place, r.v) for r in rows) == [(i, 499 - i) for i in range(500)]


def test_batches_by_length_pad_less_and_change_no_vector(spark):
    import random

    r = random.Random(4)
    texts = [(i, " ".join("ab"[j % 2] for j in range(r.choice([1, 2, 3, 200])))) for i in range(400)] + [(400, None), (401, "")]
    df = spark.createDataFrame(texts, "id long, t string").repartition(3)

    def encoder(batch):  # the second number says how much the batch was padded
        longest = max(len(t.split(" ")) for t in batch)
        return [[t.count("a"), longest - len(t.split(" "))] for t in batch]

    padding = {}
    for name, options in {"one": {"batch_size": 1}, "mixed": {"batch_size": 16}, "all": {"batch_size": 16, "by_length": True}, "cut": {"batch_size": 7, "max_tokens": 64}}.items():
        out = rt.encode(df, "t", encoder, **options).collect()
        assert {x.id: round(x.vec[0] * (1 if name != "cut" else 1)) for x in out if name != "cut"} == {i: (t or "").count("a") for i, t in texts if name != "cut"}
        padding[name] = sum(x.vec[1] for x in out)
    assert padding["one"] == 0 and padding["all"] <= padding["mixed"] < 400 * 50


def test_many_shards_and_small_ranges_are_few_tasks(spark, tmp_path):
    for i in range(150):
        write(tmp_path / f"s{i}.csv", f'repo_path,content\n"r{i} a.py","x = {i}"\n')
    blobs, lost = sh.read_shards(spark, f"{tmp_path}/s{{}}.csv", list(range(151)), attempts=1, delay=0.0)
    most = sh.SHARD_TASKS * spark.sparkContext.defaultParallelism
    assert blobs.count() == 150 and [r.shard for r in lost.collect()] == [150]
    assert blobs.rdd.getNumPartitions() <= most
    df = spark.createDataFrame([(f"r{i} p", "line\n" * 200) for i in range(200)], "repo_path string, content string").coalesce(1)
    sio.write_table(df, f"{tmp_path}/csv", "csv")
    got = sh.read_blob_ranges(spark, f"{tmp_path}/csv", range_bytes=200)
    assert got.count() == 200 and got.rdd.getNumPartitions() <= sh.RANGE_TASKS * spark.sparkContext.defaultParallelism
