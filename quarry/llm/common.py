"""Small helpers shared by the operators of this folder."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from quarry.session import read_table, stored  # noqa: F401

# Words of the quality, mixing and shingle operators: runs without ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"

# Rows of one Arrow batch: with whole texts this bounds what a Python worker holds at once.
BATCH_ROWS = 1024


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_table(spark, sf_dir, "documents")


def fresh(taken: Iterable[str], name: str) -> str:
    """``name``, longer by underscores until no column (in any case of letters) begins with it."""
    taken = [c.lower() for c in taken]
    while any(c.startswith(name.lower()) for c in taken):
        name += "_"
    return name


def map_rows(df: DataFrame, schema: str | StructType, fn: Callable[[Iterable[dict]], Iterator[dict]],
             as_is: Iterable[str] = ()) -> DataFrame:
    """``mapInArrow`` whose function sees each Arrow batch as a dict of Python
    lists and yields dicts of lists. Columns come out in ``schema`` order.
    Columns named in ``as_is`` stay Arrow arrays, for rows that are only passed on."""
    df.sparkSession.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    target = df.sparkSession.createDataFrame([], schema).schema
    from pyspark.sql.pandas.types import to_arrow_schema

    arrow = to_arrow_schema(target)
    names, whole = df.columns, frozenset(as_is)

    def column(value, kind) -> pa.Array:
        if isinstance(value, pa.Array):
            return value if value.type == kind else value.cast(kind)
        return pa.array(value, type=kind, from_pandas=False)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lists = ({n: b.column(i) if n in whole else b.column(i).to_pylist() for i, n in enumerate(names)} for b in batches)
        for out in fn(lists):
            yield pa.RecordBatch.from_arrays([column(out[f.name], f.type) for f in arrow], schema=arrow)
        _give_back()

    return df.mapInArrow(run, target)


def _give_back() -> None:
    """Workers outlive a task: what it has freed goes back to the system, for whatever runs next on the executor."""
    import ctypes

    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):
        pass


def share(key, n):
    """A repeatable number in [0, 1) of the columns ``key``: the same row always gets the same."""
    return F.pmod(F.xxhash64(*key, F.lit(n)), F.lit(1 << 40)) / F.lit(float(1 << 40))


def map_groups(df: DataFrame, keys: list[str], schema: str, fn: Callable[[dict], dict | None]) -> DataFrame:
    """``fn`` on every group of rows with equal ``keys``, given and returned as a
    dict of lists. Groups are streamed in key order, so many small ones cost no
    more than the rows they hold; callers bound the size of a group."""
    names = df.columns

    def run(batches):
        held, key = {n: [] for n in names}, None
        for b in batches:
            own = list(zip(*(b[k] for k in keys)))
            a = 0
            while a < len(own):
                if own[a] != key:
                    if key is not None and (out := fn(held)):
                        yield out
                    held, key = {n: [] for n in names}, own[a]
                z = a
                while z < len(own) and own[z] == key:
                    z += 1
                for n in names:
                    held[n] += b[n][a:z]
                a = z
        if key is not None and (out := fn(held)):
            yield out

    return map_rows(df.repartition(*keys).sortWithinPartitions(*keys), schema, _merged(run))


def _merged(run, rows: int = 4096):
    """Join the small results of many groups into fewer batches."""
    def merged(batches):
        held, n = {}, 0
        for out in run(batches):
            for k, v in out.items():
                held.setdefault(k, []).extend(v)
            n += len(next(iter(out.values())))
            if n >= rows:
                yield held
                held, n = {}, 0
        if n:
            yield held
    return merged
