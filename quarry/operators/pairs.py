"""Change-request labels and relevance pairs.

``build_pairs`` joins each labelled change request to the definitions of
its repository snapshot: definitions named in the label are positives,
every other definition is kept as a negative with probability ``p``.

The reference enumerates every (request, definition) pair of a snapshot
and flips a coin for each. That is quadratic in a hot snapshot, so the
negatives are drawn instead of filtered: each snapshot's definitions get a
dense index, and each request walks through them in gaps of
``ln(u) / ln(1 - p)``, the distance between two successes of independent
coins, with ``u`` from the md5 of (seed, request, step). Only the drawn
(snapshot, index) rows are joined, so work is proportional to the output,
and the draw can be stated in SQL. Positives come from an equi-join on the
label names. The labelled requests feed three branches and are stored once.
"""

from __future__ import annotations

import hashlib
import math

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarry.functions.text import definition_url, patch_label, save_path
from quarry.operators.split import with_group_index
from quarry.session import stored


def labels_from_patch(requests: DataFrame, *, patch: str = "patch", repo: str = "repo",
                      base_commit: str = "base_commit") -> DataFrame:
    """X7 + P2: add ``label`` struct<functions, classes> and ``save_path``."""
    return (requests.withColumn("label", patch_label(patch))
            .withColumn("save_path", save_path(repo, base_commit)))


def labelled(requests: DataFrame, label: str = "label") -> DataFrame:
    """Drop requests whose two label lists are both empty."""
    return requests.where((F.size(F.col(f"{label}.functions")) > 0)
                          | (F.size(F.col(f"{label}.classes")) > 0))


def sample_index_udf(p: float, seed: str):
    """pandas_udf(key string, n long) -> array<long>: the successes among n coins of chance p."""

    def walk(key: str, n: int) -> list[int]:
        if p >= 1:
            return list(range(n))
        out, at, step = [], -1, 0
        while p > 0:
            u = (int(hashlib.md5(f"{seed}:{key}:{step}".encode()).hexdigest()[:13], 16) + 1) / float(1 << 52)
            at += 1 + math.floor(math.log(u) / math.log(1 - p))
            if at >= n:
                break
            out.append(at)
            step += 1
        return out

    @F.pandas_udf(T.ArrayType(T.LongType()))
    def draw(keys: pd.Series, ns: pd.Series) -> pd.Series:
        return pd.Series([walk(k, int(n)) if pd.notna(n) else [] for k, n in zip(keys, ns)])

    return draw


def build_pairs(requests: DataFrame, definitions: DataFrame, p: float = 0.1, seed: str = "0", *,
                request_id: str = "request_id", query: str = "problem_statement",
                url_base: str = "", language: str = "Python") -> DataFrame:
    """Relevance pairs.

    ``requests``: request_id, save_path, problem_statement, label struct.
    ``definitions``: save_path, file, kind ('function'/'class'), name, body,
    start_line. Returns Language, Query, Code, GitHubUrl, Relevance, Notes
    plus request_id and kind.
    """
    req = stored(labelled(requests).select(request_id, "save_path", F.col(query).alias("Query"), "label"), "pair-requests")
    defs = definitions.select("save_path", "file", "kind", "name", "body", "start_line")

    # Positives: label names x definitions of the snapshot with that name.
    names = (req.select(request_id, "save_path",
                        F.explode(F.array_union(
                            F.transform("label.functions", lambda n: F.struct(F.lit("function").alias("kind"), n.alias("name"))),
                            F.transform("label.classes", lambda n: F.struct(F.lit("class").alias("kind"), n.alias("name")))))
                        .alias("kn"))
             .select(request_id, "save_path", "kn.kind", "kn.name").distinct())
    positives = (names.join(defs, ["save_path", "kind", "name"])
                 .withColumn("Relevance", F.lit(1)))

    cols = [request_id, "save_path", "file", "kind", "name", "body", "start_line", "Relevance"]

    def finished(pairs: DataFrame) -> DataFrame:
        return (pairs.join(req.select(request_id, "Query"), request_id)
                .select(request_id, "kind",
                        F.lit(language).alias("Language"), "Query",
                        F.col("body").alias("Code"),
                        definition_url(url_base, "save_path", "name").alias("GitHubUrl"),
                        "Relevance", F.lit("").alias("Notes")))

    if p <= 0:  # no coin succeeds: there is nothing to draw from
        return finished(positives.select(*cols))

    # Negatives: drawn indices into the snapshot's definitions.
    indexed = with_group_index(defs, ["save_path"], ["file", "start_line", "kind", "name"])
    sizes = indexed.groupBy("save_path").agg(F.count(F.lit(1)).alias("n_defs"))
    draw = sample_index_udf(p, seed)
    drawn = (req.join(sizes, "save_path")
             .select(request_id, "save_path", "label",
                     F.explode(draw(F.col(request_id).cast("string"), F.col("n_defs"))).alias("idx")))
    negatives = (drawn.join(indexed, ["save_path", "idx"])
                 .where(~F.when(F.col("kind") == "function",
                                F.array_contains("label.functions", F.col("name")))
                        .otherwise(F.array_contains("label.classes", F.col("name"))))
                 .drop("label", "idx")
                 .withColumn("Relevance", F.lit(0)))

    return finished(positives.select(*cols).unionByName(negatives.select(*cols)))
