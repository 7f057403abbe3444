"""Session defaults and small session helpers.

Everything here is a plain Spark setting. On a cluster the session is
created by the launcher; ``get_session`` is for tests, the bench and the
command line.
"""

from __future__ import annotations

import atexit
import contextlib
import os
import re
import shutil
import tempfile

from pyspark.sql import SparkSession

# Settings that matter for every plan in this package.
DEFAULT_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
    # Arrow batches handed to mapInPandas / pandas_udf: bounded memory per task.
    "spark.sql.execution.arrow.maxRecordsPerBatch": "4096",
}

# Spark 4.1: shuffle files of a query are removed when it ends.
SHUFFLE_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def get_session(master: str | None = None, shuffle_partitions: int | None = None,
                app_name: str = "quarry", extra: dict | None = None) -> SparkSession:
    cpus = os.environ.get("BENCH_CPUS", "8")
    builder = SparkSession.builder.appName(app_name)
    builder = builder.master(master or f"local[{cpus}]")
    conf = dict(DEFAULT_CONF)
    conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions or cpus)
    conf["spark.driver.memory"] = os.environ.get("QUARRY_DRIVER_MEMORY", "16g")
    if extra:
        conf.update(extra)
    for key, value in conf.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    prepare(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the shared checkpoint folder named by ``spark.checkpoint.dir``.

    On a cluster the launcher sets it to a shared file system, and a session
    without it is refused: executors could not read what others wrote. Only a
    local master, whose driver and executors are one process, gets a scratch
    folder, which is removed when Python exits.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if not configured:
        if not re.fullmatch(r"local(\[[^]]*\])?", sc.master):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        configured = tempfile.mkdtemp(prefix="quarry-ckpt-")
        atexit.register(shutil.rmtree, configured, ignore_errors=True)
    sc.setCheckpointDir(configured)
    return sc.getCheckpointDir() or configured


_SHIPPED: set[str] = set()
_ZIP_PATH: list[str] = []


def ship_package(spark: SparkSession) -> None:
    """Make ``quarry`` importable in every Python worker (mapInPandas,
    pandas_udf) by adding a zip of the package to the SparkContext once.
    Needed whenever workers do not start in the folder that holds the
    package, which is the normal case on a cluster."""
    import zipfile

    sc = spark.sparkContext
    app = sc.applicationId
    if app in _SHIPPED:
        return
    if not _ZIP_PATH:
        pkg = os.path.dirname(os.path.abspath(__file__))
        root = os.path.dirname(pkg)
        target = os.path.join(tempfile.mkdtemp(prefix="quarry-pkg-"), "quarry.zip")
        with zipfile.ZipFile(target, "w", zipfile.ZIP_DEFLATED) as zf:
            for folder, _, files in os.walk(pkg):
                for name in files:
                    if name.endswith(".py"):
                        full = os.path.join(folder, name)
                        zf.write(full, os.path.relpath(full, root))
        _ZIP_PATH.append(target)
    sc.addPyFile(_ZIP_PATH[0])
    _SHIPPED.add(app)


def prepare(spark: SparkSession) -> str:
    """Checkpoint folder + package shipping; call once per session."""
    ship_package(spark)
    return ensure_checkpoint_dir(spark)


def scratch_dir(spark: SparkSession, name: str) -> str:
    """A fresh folder under the shared checkpoint folder for written tables."""
    base = ensure_checkpoint_dir(spark)
    import uuid

    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex[:12]}"


def spread(df, rows_per_task: int | None = None):
    """Spread CPU-heavy per-row work over all cores when a scan yields fewer
    partitions than the cluster has cores (small inputs stored in few row
    groups). Large inputs already have many splits and pass unchanged, unless
    ``rows_per_task`` says how many rows a task may have: narrow rows that
    cost much each come in few splits, however many they are."""
    tasks = df.sparkSession.sparkContext.defaultParallelism
    if rows_per_task:
        tasks = max(tasks, -(-df.count() // rows_per_task))
    return df.repartition(tasks) if df.rdd.getNumPartitions() < tasks else df


def read_table(spark: SparkSession, sf_dir: str, name: str):
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


@contextlib.contextmanager
def shuffles_removed(spark: SparkSession):
    """What is written inside leaves no shuffle files behind: they go when the
    write ends, not when the driver happens to collect its garbage."""
    before = spark.conf.get(SHUFFLE_CLEANUP, None)
    spark.conf.set(SHUFFLE_CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.unset(SHUFFLE_CLEANUP) if before is None else spark.conf.set(SHUFFLE_CLEANUP, before)


def stored(df, name: str):
    """Write ``df`` under the shared checkpoint folder and read it back: later
    uses do not repeat its work, do not depend on the executors that did it,
    and the optimizer knows its size."""
    path = scratch_dir(df.sparkSession, name)
    with shuffles_removed(df.sparkSession):
        df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.stored_at = path
    return out


def discard(*tables) -> None:
    """Remove tables of ``stored()`` that no plan reads any more."""
    for df in tables:
        sc = df.sparkSession.sparkContext
        path = sc._jvm.org.apache.hadoop.fs.Path(df.stored_at)
        path.getFileSystem(sc._jsc.hadoopConfiguration()).delete(path, True)
