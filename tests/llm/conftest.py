"""Small tables with the odd cases every operator has to define."""

import pytest

SOURCE = "/root/testdata/sf0.001"
DOCUMENTS = ("doc_id long, text string, lang string, source string, n_chars long, kept boolean, size string, "
             "cls string, score string, row string")


def odd_rows(spark):
    """Rows of the smallest table, plus nulls, empty and very long texts, ties, copies and clashing columns."""
    base = [tuple(r) for r in spark.read.parquet(f"{SOURCE}/documents.parquet").limit(60).collect()]
    long_text = "\n".join(["the lost stones of that old river and the " + str(i % 700) for i in range(12_000)])
    one = "one very long line of words " * 3000 + "x" * 40_000
    rows = [(i, t, lang, s, n) for i, t, lang, s, n in base]
    rows += [(1000, None, "en", "src1", None), (1001, "", None, None, 0), (1002, " \n\t ", "en", None, 4),
             (1003, long_text, "en", "src1", None), (1004, one, None, "src2", None), (1005, "word", "en", "src2", 4),
             (1006, "été — 日本語 😀 #1 | <b>", "fr", "src3", 20), (1007, "12 34 56", None, "src3", 8),
             (None, "a row without an id but with a text of its own words", "en", "src1", None),
             (None, None, None, None, None), rows[0], rows[0], (1008, rows[1][1], rows[1][2], "src9", 1)]
    return [r + (True, "s", "c", "x", "r") for r in rows]


@pytest.fixture(scope="session")
def odd(spark, tmp_path_factory):
    """Folder with documents.parquet and labels.parquet of odd rows."""
    root = tmp_path_factory.mktemp("odd")
    docs = spark.createDataFrame(odd_rows(spark), DOCUMENTS)
    docs.repartition(3).write.parquet(f"{root}/documents.parquet")
    labels = [(r.doc_id, r.quality, r.toxic) for r in spark.read.parquet(f"{SOURCE}/labels.parquet").collect()]
    labels += [(1000, 1, 1), (1001, None, None), (None, 1, 1), (labels[0][0], 1, labels[0][2]), (1003, 1, 7)]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{root}/labels.parquet")
    return str(root)


@pytest.fixture(scope="session")
def none(spark, tmp_path_factory):
    """The same tables without a row."""
    root = tmp_path_factory.mktemp("none")
    for name in ("documents", "labels", "pages", "embeddings", "conversations"):
        spark.read.parquet(f"{SOURCE}/{name}.parquet").filter("false").write.parquet(f"{root}/{name}.parquet")
    return str(root)


@pytest.fixture(scope="session")
def odd_docs(odd, spark):
    """The odd documents as (doc_id, text) pairs."""
    return [(r.doc_id, r.text) for r in spark.read.parquet(f"{odd}/documents.parquet").select("doc_id", "text").collect()]
