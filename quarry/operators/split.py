"""Folds, sampling, shuffling and stable row indexes.

All decisions are hashes of column values, so they are repeatable across
runs and independent of partitioning, unlike ``rand()``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quarry.functions.text import seeded_unit, split_hash

HASH_BUCKETS = 1 << 16


def fold_bounds(train: float, valid: float, test: float, holdout: float) -> tuple[int, int, int]:
    """Upper bucket bounds (inclusive) for train, valid and test; checked
    on the driver like the reference (ratios sum to 1 +- 1e-5)."""
    if abs(train + valid + test + holdout - 1) >= 1e-5:
        raise ValueError("Ratios must sum up to 1.")
    t = int(HASH_BUCKETS * train)
    v = t + int(HASH_BUCKETS * valid)
    s = v + int(HASH_BUCKETS * test)
    return t, v, s


def label_folds(df: DataFrame, train: float = 0.6, valid: float = 0.15, test: float = 0.15,
                holdout: float = 0.1, *, repo: str = "repo", path: str = "path") -> DataFrame:
    """Add ``hash_key``, ``hash_val`` and ``partition``; one file always
    lands in one fold. A projection: no shuffle."""
    bounds = fold_bounds(train, valid, test, holdout)
    return (df.withColumn("hash_key", F.concat_ws(":", F.col(repo), F.col(path)))
              .withColumn("hash_val", split_hash(repo, path))
              .withColumn("partition", fold_of("hash_val", bounds)))


def fold_of(hash_col, bounds: tuple[int, int, int]):
    """Fold name for a bucket number; bounds are inclusive upper bounds."""
    t, v, s = bounds
    hv = F.col(hash_col) if isinstance(hash_col, str) else hash_col
    return (F.when(hv <= t, "train").when(hv <= v, "valid")
             .when(hv <= s, "test").otherwise("holdout"))


def fold_summary(folded: DataFrame, *, count_col: str = "repo") -> DataFrame:
    """Rows per fold and share of the total. The share window runs
    over the four aggregated rows only."""
    counts = folded.groupBy("partition").agg(F.count(count_col).alias("count"))
    return counts.withColumn("pct", F.col("count") / F.sum("count").over(Window.partitionBy()))


def sample_negatives(df: DataFrame, p: float, seed: str, key) -> DataFrame:
    """Keep each row with probability ``p``, repeatably (md5 of seed +
    key). ``key`` is a column name or Column identifying the row."""
    return df.where(kept_by_chance(p, seed, key))


def kept_by_chance(p: float, seed: str, key):
    """The N1 coin as a predicate, for use inside a larger filter."""
    k = F.col(key) if isinstance(key, str) else key
    return seeded_unit(seed, k) < F.lit(p)


def shuffle(df: DataFrame, seed: str, key) -> DataFrame:
    """Seeded full shuffle = sort by md5(seed || key); the global sort
    is range-partitioned, so no single task holds the data."""
    k = F.col(key) if isinstance(key, str) else key
    return df.orderBy(F.md5(F.concat(F.lit(str(seed)), k.cast("string"))), k)


def with_row_index(df: DataFrame, order_cols: list, name: str = "row_index",
                   start: int = 0) -> DataFrame:
    """A dense, stable row index in ``order_cols`` order.

    A global ``row_number()`` would pull every row into one task. Instead:
    sort (range-partitioned), write the sorted rows with their partition id
    to the shared checkpoint folder (so the partition assignment is fixed),
    count rows per partition, turn the counts into offsets (one row per
    partition) and add a per-partition row number.
    """
    cols = [F.col(c) if isinstance(c, str) else c for c in order_cols]
    sorted_df = df.orderBy(*cols).withColumn("__pid", F.spark_partition_id()).checkpoint(eager=True)
    counts = sorted_df.groupBy("__pid").agg(F.count(F.lit(1)).alias("__n"))
    offsets = counts.select(
        "__pid",
        (F.sum("__n").over(Window.orderBy("__pid")
                           .rowsBetween(Window.unboundedPreceding, -1))).alias("__off"))
    local = Window.partitionBy("__pid").orderBy(*cols)
    return (sorted_df.join(F.broadcast(offsets), "__pid")
            .withColumn(name, (F.coalesce(F.col("__off"), F.lit(0))
                               + F.row_number().over(local) - 1 + start).cast("long"))
            .drop("__pid", "__off"))


def with_place(ordered: DataFrame, name: str = "place") -> DataFrame:
    """P17 for a table that is in order already (a global sort): the place of
    every row from 0, without sorting again. The rows are written once, with
    their partition and their place in it; only row counts are summed."""
    held = (ordered.withColumn("__pid", F.spark_partition_id()).withColumn("__at", F.monotonically_increasing_id())
            .checkpoint(eager=True))
    counts = held.groupBy("__pid").agg(F.count(F.lit(1)).alias("__n"), F.min("__at").alias("__first"))
    before = Window.orderBy("__pid").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("__pid", (F.coalesce(F.sum("__n").over(before), F.lit(0)) - F.col("__first")).alias("__off"))
    return (held.join(F.broadcast(offsets), "__pid").withColumn(name, (F.col("__at") + F.col("__off")).cast("long"))
            .drop("__pid", "__at", "__off"))


def with_group_index(df: DataFrame, group: list[str], order: list[str],
                     name: str = "idx") -> DataFrame:
    """0-based dense index of each row within its group, in ``order``.

    A window partitioned by the group would put a hot group in one task.
    Instead the rows are range-sorted by (group, order), written to the
    shared checkpoint folder with their partition id, and the index is
    offset(group, partition) + row number inside (partition, group). The
    offsets table has one row per (partition, group) pair.
    """
    keys = group + order
    sorted_df = (df.repartitionByRange(*[F.col(c) for c in keys])
                 .sortWithinPartitions(*keys)
                 .withColumn("__pid", F.spark_partition_id())
                 .checkpoint(eager=True))
    counts = sorted_df.groupBy("__pid", *group).agg(F.count(F.lit(1)).alias("__n"))
    offsets = counts.select(
        "__pid", *group,
        F.coalesce(F.sum("__n").over(Window.partitionBy(*group).orderBy("__pid")
                                     .rowsBetween(Window.unboundedPreceding, -1)),
                   F.lit(0)).alias("__off"))
    local = Window.partitionBy("__pid", *group).orderBy(*keys)
    # A null group is a group like any other.
    a, b = sorted_df.alias("a"), offsets.alias("b")
    same = F.col("a.__pid") == F.col("b.__pid")
    for g in group:
        same = same & F.col(f"a.{g}").eqNullSafe(F.col(f"b.{g}"))
    return (a.join(b, same).select("a.*", "b.__off")
            .withColumn(name, (F.col("__off") + F.row_number().over(local) - 1).cast("long"))
            .drop("__pid", "__off"))
