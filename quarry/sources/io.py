"""Readers and writers.

All readers take explicit schemas (no inference) and any Spark file system
URI (local, HDFS, object stores); a list of paths is one scan (U1). Task
retry replaces the reference's retry loops around downloads.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarry.functions.text import split_repo_path
from quarry.operators.grammars import LANGUAGE_OF
from quarry.session import stored

BLOB_CSV_SCHEMA = T.StructType([T.StructField("repo_path", T.StringType()),
                                T.StructField("content", T.StringType())])

FUNCTION_SCHEMA = T.StructType([
    T.StructField("repo", T.StringType()), T.StructField("path", T.StringType()),
    T.StructField("lineno", T.IntegerType()), T.StructField("func_name", T.StringType()),
    T.StructField("language", T.StringType()), T.StructField("code", T.StringType()),
    T.StructField("code_tokens", T.ArrayType(T.StringType())),
    T.StructField("comment_tokens", T.ArrayType(T.StringType())),
    T.StructField("docstring", T.StringType()),
    T.StructField("docstring_tokens", T.ArrayType(T.StringType())),
])

CHANGE_REQUEST_SCHEMA = T.StructType([
    T.StructField("repo", T.StringType()), T.StructField("base_commit", T.StringType()),
    T.StructField("patch", T.StringType()), T.StructField("problem_statement", T.StringType()),
    T.StructField("hints_text", T.StringType()), T.StructField("created_at", T.StringType()),
    T.StructField("version", T.StringType()),
    T.StructField("label", T.StructType([
        T.StructField("functions", T.ArrayType(T.StringType())),
        T.StructField("classes", T.ArrayType(T.StringType()))])),
    T.StructField("save_path", T.StringType()),
])

ANNOTATION_SCHEMA = T.StructType([
    T.StructField("Language", T.StringType()), T.StructField("Query", T.StringType()),
    T.StructField("GitHubUrl", T.StringType()), T.StructField("Relevance", T.DoubleType()),
    T.StructField("Notes", T.StringType()),
])

PREDICTION_SCHEMA = T.StructType([
    T.StructField("language", T.StringType()), T.StructField("query", T.StringType()),
    T.StructField("url", T.StringType()), T.StructField("rank", T.IntegerType()),
])

DEFINITION_RECORD_SCHEMA = T.StructType([
    T.StructField("function_tokens", T.ArrayType(T.StringType())),
    T.StructField("identifier", T.StringType()), T.StructField("url", T.StringType()),
])

# CSV dialect shared by writers and readers: RFC-4180 quoting, texts kept
# byte-for-byte (no whitespace trimming, multi-line fields).
CSV_OPTIONS = {
    "header": "true", "multiLine": "true", "quote": '"', "escape": '"',
    "ignoreLeadingWhiteSpace": "false", "ignoreTrailingWhiteSpace": "false",
    "nullValue": "\\N", "emptyValue": "",
}
# Written, an empty text is a pair of quotes and a null is \\N, so each comes
# back as it was; an empty field without quotes is read as null.
CSV_WRITE_OPTIONS = {**CSV_OPTIONS, "emptyValue": '""'}


LIST_ROWS = 4096        # rows of a batch of files
BATCH_BYTES = 4 << 20   # and the texts they may hold
READ_TASKS = 4          # tasks for each core, at most,
FILES_OF_TASK = 20_000  # or as many as give each so many files


def _paths(path) -> list[str]:
    return [path] if isinstance(path, str) else list(path)


# ---------------------------------------------------------------------------
# Readers

def read_blobs(spark: SparkSession, path, *, repo_path: str = "repo_path") -> DataFrame:
    """CSV folders (or a list of files/URIs) of
    ``repo_path, content`` -> ``repo, path, content``."""
    schema = T.StructType([T.StructField(repo_path, T.StringType()),
                           T.StructField("content", T.StringType())])
    df = spark.read.schema(schema).options(**CSV_OPTIONS).csv(_paths(path))
    repo, file_path = split_repo_path(F.col(repo_path))
    return df.select(repo.alias("repo"), file_path.alias("path"), F.col("content"))


def read_jsonl(spark: SparkSession, path, schema: T.StructType, *,
               drop_malformed: bool = True) -> DataFrame:
    """JSON lines (optionally .gz) with a fixed schema; malformed
    lines are dropped. A missing path fails, as in the reference."""
    mode = "DROPMALFORMED" if drop_malformed else "FAILFAST"
    return spark.read.schema(schema).option("mode", mode).json(_paths(path))


def read_jsonl_reporting(spark: SparkSession, path, schema: T.StructType):
    """S3 with reporting: (good rows, malformed raw lines)."""
    s = T.StructType(schema.fields + [T.StructField("_corrupt_record", T.StringType())])
    df = (spark.read.schema(s).option("mode", "PERMISSIVE")
          .option("columnNameOfCorruptRecord", "_corrupt_record").json(_paths(path)))
    df = stored(df, "json-lines")
    good = df.where(F.col("_corrupt_record").isNull()).drop("_corrupt_record")
    bad = df.where(F.col("_corrupt_record").isNotNull()).select("_corrupt_record")
    return good, bad


def read_csv_table(spark: SparkSession, path, schema: T.StructType) -> DataFrame:
    """Annotations / predictions / queries CSV (multi-line fields)."""
    return spark.read.schema(schema).options(**CSV_OPTIONS).csv(_paths(path))


def read_annotations(spark: SparkSession, path) -> DataFrame:
    return read_csv_table(spark, path, ANNOTATION_SCHEMA)


def read_predictions(spark: SparkSession, path) -> DataFrame:
    """Predictions with an explicit ``rank`` column (Spark has no row order)."""
    return read_csv_table(spark, path, PREDICTION_SCHEMA)


def read_sources(spark: SparkSession, root: str, suffixes: tuple[str, ...] = (".py",),
                 languages: tuple[str, ...] | None = None) -> DataFrame:
    """Every file under ``root`` (recursively) with one of the
    suffixes, or in one of the ``languages``, one row per file: ``file``
    (path relative to root) and ``content`` (whole text). Folders are listed
    by the tasks, a level at a time, and no list of files is held on the
    driver; names that begin with ``.`` or ``_`` are passed over, as Spark's
    own readers do."""
    if languages is not None:
        suffixes = tuple(s for s, name in LANGUAGE_OF.items() if name in languages)
    base = root.rstrip("/")
    cores = spark.sparkContext.defaultParallelism

    def listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from quarry.sources.shards import file_system

        filesystem, prefix = file_system(base)
        for b in batches:
            for folder in b.column("file").to_pylist():
                infos = filesystem.get_file_info(pafs.FileSelector(f"{prefix}/{folder}".rstrip("/")))
                own = [(f"{folder}/{i.base_name}".lstrip("/"), i.type == pafs.FileType.Directory) for i in infos if not _hidden(i.base_name)]
                kept = [(name, is_folder) for name, is_folder in own if is_folder or name.endswith(suffixes)]
                for a in range(0, len(kept), LIST_ROWS):
                    part = kept[a:a + LIST_ROWS]
                    yield pa.RecordBatch.from_arrays([pa.array([n for n, _ in part], pa.string()), pa.array([f for _, f in part], pa.bool_())],
                                                     names=["file", "is_folder"])

    folders, files = spark.createDataFrame([("",)], "file string"), None
    n_folders, n_files = 1, 0
    while n_folders:
        level = stored(folders.repartition(min(n_folders, READ_TASKS * cores)).mapInArrow(listed, "file string, is_folder boolean"), "source-list")
        folders, own = level.filter("is_folder").select("file"), level.filter("not is_folder").select("file")
        files = own if files is None else files.unionByName(own)
        n_folders, found = level.agg(F.count_if("is_folder"), F.count_if(~F.col("is_folder"))).first()
        n_files += found

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from quarry.sources.shards import file_system

        filesystem, prefix = file_system(base)

        def batch() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([n for n, _ in held], pa.string()), pa.array([t for _, t in held], pa.binary())],
                                              names=["file", "content"])

        held: list[tuple[str, bytes]] = []
        size = 0
        for b in batches:
            for name in b.column("file").to_pylist():
                with filesystem.open_input_stream(f"{prefix}/{name}") as f:
                    held.append((name, f.read()))
                size += len(held[-1][1])
                if size >= BATCH_BYTES or len(held) >= LIST_ROWS:
                    yield batch()
                    held, size = [], 0
        if held:
            yield batch()

    tasks = max(1, min(n_files, max(READ_TASKS * cores, n_files // FILES_OF_TASK)))
    return files.repartition(tasks, "file").mapInArrow(read, "file string, content binary").select("file", F.col("content").cast("string").alias("content"))


def _hidden(name: str) -> bool:
    """Whether Spark's readers pass over a file or folder of this name."""
    return (name.startswith(".") or name.startswith("_") and "=" not in name or name.endswith("._COPYING_")) \
        and not name.startswith(("_common_metadata", "_metadata"))


def read_tags(spark: SparkSession, root: str, schema: T.StructType | None = None) -> DataFrame:
    """Tag index files (JSON lines). With the layout written by
    ``write_tags`` the snapshot comes from the ``save_path=`` folder; for
    ``<save_path>.tags`` files it comes from the file name. Missing files
    are ignored."""
    schema = schema or T.StructType([
        T.StructField("name", T.StringType()), T.StructField("path", T.StringType()),
        T.StructField("pattern", T.StringType()), T.StructField("kind", T.StringType()),
        T.StructField("line", T.LongType()), T.StructField("end", T.LongType())])
    df = (spark.read.schema(schema).option("ignoreMissingFiles", "true")
          .option("recursiveFileLookup", "false").json(root))
    if "save_path" not in df.columns:
        df = df.withColumn("save_path", F.regexp_extract(F.col("_metadata.file_name"), r"^(.*)\.tags$", 1))
    return df


def read_change_requests(spark: SparkSession, path, fmt: str = "json") -> DataFrame:
    """A local export of the change-request split (JSON lines or Parquet)."""
    if fmt == "parquet":
        return spark.read.schema(CHANGE_REQUEST_SCHEMA).parquet(*_paths(path))
    return spark.read.schema(CHANGE_REQUEST_SCHEMA).json(_paths(path))


def read_definitions(spark: SparkSession, path, *, tokens: bool = False) -> DataFrame:
    """Definition records stored as Parquet; with ``tokens`` the encoder's
    input records (function_tokens, identifier, url)."""
    reader = spark.read.schema(DEFINITION_RECORD_SCHEMA) if tokens else spark.read
    return reader.parquet(*_paths(path))


def write_definition_records(definitions: DataFrame, path: str, *, code: str = "code", name: str = "func_name", url: str = "url") -> None:
    """Definitions as token-list records (T2 tokens of the code, P7 url)."""
    from quarry.operators.extract import code_tokens

    tokens = definitions.select(code_tokens(code)["code_tokens"].alias("function_tokens"), F.col(name).alias("identifier"), F.col(url).alias("url"))
    tokens.write.mode("overwrite").parquet(path)


# ---------------------------------------------------------------------------
# Writers

def write_chunked_jsonl(df: DataFrame, path: str, rows_per_file: int = 1000, *,
                        compression: str | None = None, mode: str = "overwrite") -> None:
    """JSON lines, at most ``rows_per_file`` rows per file, written in
    parallel by the tasks."""
    w = df.write.mode(mode).option("maxRecordsPerFile", rows_per_file)
    if compression:
        w = w.option("compression", compression)
    w.json(path)


def write_splits(df: DataFrame, path: str, *, partition_col: str = "partition",
                 rows_per_file: int = 1000, mode: str = "overwrite") -> None:
    """Each fold in its own folder, as JSON lines and as Parquet."""
    base = path.rstrip("/")
    (df.write.mode(mode).option("maxRecordsPerFile", rows_per_file)
     .partitionBy(partition_col).json(f"{base}/jsonl"))
    df.write.mode(mode).partitionBy(partition_col).parquet(f"{base}/parquet")


def write_table(df: DataFrame, path: str, fmt: str = "parquet", *, mode: str = "overwrite") -> None:
    """One table as CSV, JSON lines or Parquet. CSV cannot hold arrays
    or structs, so those columns are written as JSON text."""
    out = df
    if fmt == "csv":
        out = df.select(*[F.to_json(F.col(f.name)).alias(f.name)
                          if isinstance(f.dataType, (T.ArrayType, T.StructType, T.MapType)) else F.col(f.name)
                          for f in df.schema.fields])
    w = out.write.mode(mode)
    if fmt == "csv":
        w.options(**CSV_WRITE_OPTIONS).csv(path)
    elif fmt == "json":
        w.json(path)
    else:
        w.parquet(path)


def write_tags(tags: DataFrame, root: str, mode: str = "overwrite") -> None:
    """Tag index per snapshot: JSON lines under ``save_path=<snapshot>/``."""
    tags.write.mode(mode).partitionBy("save_path").json(root)


def write_files(df: DataFrame, root: str, path_col: str, content_col: str) -> None:
    """One file per row at ``root/<path_col>`` holding ``content_col``.

    Files are written by the tasks through ``pyarrow.fs`` (local paths,
    HDFS, object stores); a retried task rewrites the same names.
    """
    base = root.rstrip("/")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyarrow import fs as pafs

        filesystem, prefix = pafs.FileSystem.from_uri(base)
        n, made = 0, set()
        for pdf in batches:
            for rel, text in zip(pdf[path_col], pdf[content_col]):
                target = f"{prefix}/{rel}"
                folder = target.rsplit("/", 1)[0]
                if folder not in made:
                    filesystem.create_dir(folder, recursive=True)
                    made.add(folder)
                with filesystem.open_output_stream(target) as out:
                    out.write((text or "").encode("utf-8"))
                n += 1
        yield pd.DataFrame({"n": [n]})

    df.select(path_col, content_col).mapInPandas(run, "n long").agg(F.sum("n")).collect()
