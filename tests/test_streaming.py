"""Streaming corpus build: files arriving in two batches, exact dedup
across batches, fold folders."""

import os
import tempfile

from quarry.streaming import corpus as cs

FUNC = 'def f{n}(a):\n    """Does a useful thing here."""\n    b = a\n    return b\n'


def test_stream_dedups_across_batches(spark):
    root = tempfile.mkdtemp()
    os.makedirs(f"{root}/in")

    def drop(name, rows):
        import csv
        with open(f"{root}/in/{name}.csv", "w", newline="") as fh:
            w = csv.writer(fh)
            w.writerow(["repo_path", "content"])
            w.writerows(rows)

    drop("a", [["org/r a.py", FUNC.format(n=1)], ["org/r b.py", FUNC.format(n=2)]])
    q = cs.start_corpus_stream(spark, f"{root}/in", f"{root}/out", f"{root}/ck")
    q.awaitTermination()
    drop("b", [["org/r c.py", FUNC.format(n=1)], ["org/r d.py", FUNC.format(n=3)]])
    q = cs.start_corpus_stream(spark, f"{root}/in", f"{root}/out", f"{root}/ck")
    q.awaitTermination()
    rows = spark.read.json(f"{root}/out").collect()
    assert sorted((r["path"], r["func_name"]) for r in rows) == [("a.py", "f1"), ("b.py", "f2"), ("d.py", "f3")]
    assert {r["partition"] for r in rows} <= {"train", "valid", "test", "holdout"}
