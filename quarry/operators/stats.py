"""Summary statistics.

All are grouped aggregates with partial aggregation; nothing here sorts
or collects the whole table, and the only un-keyed windows run over
already aggregated rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.functions.text import list_len


def count_by(df: DataFrame, col: str, name: str = "count") -> DataFrame:
    """A1/A2: rows per value, largest first (ties by value)."""
    return df.groupBy(col).agg(F.count(F.lit(1)).alias(name)).orderBy(F.col(name).desc(), F.col(col))


def distinct_count(df: DataFrame, col: str, name: str) -> DataFrame:
    """A5: number of distinct values (exact)."""
    return df.agg(F.countDistinct(col).alias(name))


def one_per_key(df: DataFrame, key: str, order: list[str]) -> DataFrame:
    """One row per key; each column takes its first non-null value in
    ``order`` (pandas ``groupby().first()`` semantics)."""
    o = F.struct(*[F.col(c) for c in order])
    aggs = [F.min_by(F.col(c), F.when(F.col(c).isNotNull(), o)).alias(c)
            for c in df.columns if c != key]
    return df.groupBy(key).agg(*aggs)


def label_counts(df: DataFrame, label: str = "label") -> DataFrame:
    """Sizes of the two label lists (P19 semantics: missing -> 0)."""
    return (df.withColumn("n_functions", list_len(F.col(f"{label}.functions")))
              .withColumn("n_classes", list_len(F.col(f"{label}.classes")))
              .withColumn("n_total", F.col("n_functions") + F.col("n_classes")))


def label_stats(counted: DataFrame) -> DataFrame:
    """Mean, sample std, max and min of function and class counts."""
    aggs = []
    for c in ("n_functions", "n_classes"):
        aggs += [F.avg(c).alias(f"{c}_mean"), F.stddev_samp(c).alias(f"{c}_std"),
                 F.max(c).alias(f"{c}_max"), F.min(c).alias(f"{c}_min")]
    return counted.agg(*aggs)


def argmax_rows(df: DataFrame, col: str) -> DataFrame:
    """All rows whose ``col`` equals its maximum (ties kept). The max is
    a one-row aggregate joined back on value (an equi-join, broadcast)."""
    top = df.agg(F.max(col).alias("__max"))
    return df.join(F.broadcast(top), F.col(col) == F.col("__max")).drop("__max")


def order_by_counts(counted: DataFrame, col: str, ties: list[str], descending: bool = True) -> DataFrame:
    """Whole-table sort by a count column (range-partitioned sort); the
    reference's stable sort keeps frame order on ties, here ``ties`` names
    the columns that stand for that order."""
    c = F.col(col).desc() if descending else F.col(col).asc()
    return counted.orderBy(c, *[F.col(t) for t in ties])
