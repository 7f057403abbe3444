"""Retrieval metrics.

All metrics are two-stage aggregations: one row per query first, then a
mean. Per-query state is a handful of numbers, so the plan is one shuffle
by query key plus a tiny final aggregate; nothing is collected.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


IDEAL_CHUNK = 1 << 16


def _div(num: Column, den: Column) -> Column:
    return num / F.nullif(den, F.lit(0))


# ---------------------------------------------------------------------------
# Precision / recall / F1 / MRR / accuracy at k.

def topk_per_query(flags: DataFrame, n_true: DataFrame, k: int, *,
                   query: str = "query_id", url: str = "url", rank: str = "rank",
                   relevant: str = "relevant") -> DataFrame:
    """Per-query scores from ranked predictions already flagged as relevant.

    ``flags``: one row per prediction (query, url, rank, relevant bool),
    rank counted in the raw list (duplicates included). ``n_true``: (query,
    n_true) = number of distinct true urls. Queries without truth or
    without predictions are skipped, as in the reference.
    """
    cut = flags.where(F.col(rank) <= k)
    per_q = (cut.groupBy(query)
             .agg(F.countDistinct(url).alias("n_ret"),
                  F.countDistinct(F.when(F.col(relevant), F.col(url))).alias("tp"),
                  F.min(F.when(F.col(relevant), F.col(rank))).alias("first_hit"))
             .join(n_true.where(F.col("n_true") > 0), query))
    precision = _div(F.col("tp"), F.col("n_ret"))
    recall = _div(F.col("tp"), F.col("n_true"))
    return (per_q
            .withColumn("precision", F.coalesce(precision, F.lit(0.0)))
            .withColumn("recall", F.coalesce(recall, F.lit(0.0)))
            .withColumn("f1", F.when(F.col("precision") + F.col("recall") > 0,
                                     2 * F.col("precision") * F.col("recall")
                                     / (F.col("precision") + F.col("recall"))).otherwise(0.0))
            .withColumn("rr", F.coalesce(1.0 / F.col("first_hit"), F.lit(0.0)))
            .withColumn("hit", (F.col("tp") > 0).cast("double")))


def topk_summary(per_query: DataFrame, digits: int = 4) -> DataFrame:
    """A16 for top-k: means over valid queries, rounded like the report."""
    return per_query.agg(
        F.round(F.coalesce(F.avg("precision"), F.lit(0.0)), digits).alias("precision"),
        F.round(F.coalesce(F.avg("recall"), F.lit(0.0)), digits).alias("recall"),
        F.round(F.coalesce(F.avg("f1"), F.lit(0.0)), digits).alias("f1"),
        F.round(F.coalesce(F.avg("rr"), F.lit(0.0)), digits).alias("mrr"),
        F.round(F.coalesce(F.avg("hit"), F.lit(0.0)), digits).alias("topk_accuracy"),
        F.count(F.lit(1)).alias("n_queries"))


def evaluate_topk(predictions: DataFrame, truth: DataFrame, k: int = 5, *,
                  query: str = "query_id", url: str = "url", rank: str = "rank",
                  digits: int = 4) -> DataFrame:
    """A10-A12 with ground truth given as (query, url) rows."""
    t = truth.select(query, url).distinct()
    n_true = t.groupBy(query).agg(F.count(F.lit(1)).alias("n_true"))
    flags = (predictions.select(query, url, rank)
             .join(t.withColumn("relevant", F.lit(True)), [query, url], "left")
             .withColumn("relevant", F.coalesce("relevant", F.lit(False))))
    return topk_summary(topk_per_query(flags, n_true, k, query=query, url=url, rank=rank),
                        digits)


# ---------------------------------------------------------------------------
# Relevance annotations, coverage and NDCG.

def relevance_table(annotations: DataFrame, *, language: str = "Language",
                    query: str = "Query", url: str = "GitHubUrl",
                    relevance: str = "Relevance") -> DataFrame:
    """Mean relevance per (query, language, url) on case-sensitive keys,
    then case-folded keys where the last key in sorted order wins (A6, P11).
    Returns ``language, query, url, relevance`` with lower-cased keys.
    """
    mean = (annotations.groupBy(query, language, url)
            .agg(F.avg(F.col(relevance).cast("double")).alias("rel")))
    return (mean.groupBy(F.lower(language).alias("language"), F.lower(query).alias("query"),
                         F.col(url).alias("url"))
            .agg(F.max_by("rel", F.struct(F.col(query), F.col(language))).alias("relevance")))


def cut_predictions(predictions: DataFrame, max_urls: int = 300, *,
                    language: str = "language", query: str = "query", url: str = "url",
                    rank: str = "rank") -> DataFrame:
    """Lower-case keys and keep the first ``max_urls`` predictions.

    Rows of case variants of one query are merged by (rank, original keys).
    Returns ``language, query, url, pos`` with pos = 1-based position.
    """
    w = Window.partitionBy("language", "query").orderBy(
        F.col(rank), F.col("__lang"), F.col("__query"), F.col("url"))
    return (predictions.select(F.lower(language).alias("language"), F.lower(query).alias("query"),
                               F.col(url).alias("url"), F.col(rank),
                               F.col(language).alias("__lang"), F.col(query).alias("__query"))
            .withColumn("pos", F.row_number().over(w))
            .where(F.col("pos") <= max_urls)
            .select("language", "query", "url", "pos"))


def coverage(rel: DataFrame, cut: DataFrame, *, positive_only: bool = False) -> DataFrame:
    """Share of annotated urls that appear in the (cut) predictions,
    per predicted language. ``rel`` from ``relevance_table``, ``cut`` from
    ``cut_predictions``."""
    ann = rel.where(F.col("relevance") > 0) if positive_only else rel
    predicted = cut.select("language", "query", "url").distinct().withColumn("covered", F.lit(1))
    langs = cut.select("language").distinct()
    per_lang = (ann.join(predicted, ["language", "query", "url"], "left")
                .groupBy("language")
                .agg(F.count(F.lit(1)).alias("n_annotations"),
                     F.count("covered").alias("n_covered")))
    return (langs.join(per_lang, "language", "left")
            .select("language",
                    _div(F.col("n_covered").cast("double"), F.col("n_annotations")).alias("coverage")))


def ndcg(rel: DataFrame, cut: DataFrame, *, full_ranking: bool = False) -> DataFrame:
    """Mean NDCG over annotated queries with positive ideal DCG,
    per predicted language.

    ``full_ranking=False``: only annotated predictions take a rank (W5);
    ``True``: every prediction takes its position (A15). A url predicted
    twice gains twice. Ideal DCG is over all annotations of the query (W4).
    """
    gain = F.pow(F.lit(2.0), F.col("relevance")) - 1
    hits = cut.join(rel, ["language", "query", "url"])
    if full_ranking:
        ranked = hits.withColumn("r", F.col("pos"))
    else:
        ranked = hits.withColumn("r", F.row_number().over(
            Window.partitionBy("language", "query").orderBy("pos")))
    dcg = (ranked.groupBy("language", "query")
           .agg(F.sum(gain / F.log2(F.col("r") + 1)).alias("dcg")))
    # Ideal DCG without ranking every annotation in one task: count the
    # annotations per relevance value; value v then fills the positions
    # [start, start + count) where start = 1 + annotations ranked above it.
    # The discount sum over a range is computed in chunks of at most
    # IDEAL_CHUNK positions, spread over tasks, so one query with a huge
    # number of equal annotations is neither one giant array nor one task.
    per_value = rel.groupBy("language", "query", "relevance").agg(F.count(F.lit(1)).alias("c"))
    above = F.sum("c").over(Window.partitionBy("language", "query")
                            .orderBy(F.col("relevance").desc())
                            .rowsBetween(Window.unboundedPreceding, -1))
    ranges = (per_value.withColumn("start", F.coalesce(above, F.lit(0)) + 1)
              .withColumn("chunk", F.explode(F.sequence(F.lit(0), F.floor((F.col("c") - 1) / IDEAL_CHUNK)))))
    lo = F.col("start") + F.col("chunk") * IDEAL_CHUNK
    hi = F.least(F.col("start") + F.col("c") - 1, lo + IDEAL_CHUNK - 1)
    parts = (ranges.repartition("language", "query", "chunk")
             .withColumn("disc", F.aggregate(F.sequence(lo, hi), F.lit(0.0),
                                             lambda acc, i: acc + 1.0 / F.log2(i + 1))))
    ideal = (parts.groupBy("language", "query")
             .agg(F.sum(gain * F.col("disc")).alias("idcg")))
    per_q = (ideal.where(F.col("idcg") != 0)
             .join(dcg, ["language", "query"], "left")
             .withColumn("ndcg", F.coalesce(F.col("dcg"), F.lit(0.0)) / F.col("idcg")))
    langs = cut.select("language").distinct()
    per_lang = per_q.groupBy("language").agg(F.sum("ndcg").alias("s"), F.count(F.lit(1)).alias("n"))
    return (langs.join(per_lang, "language", "left")
            .select("language", _div(F.col("s"), F.col("n")).alias("ndcg")))


def evaluate_relevance(annotations: DataFrame, predictions: DataFrame, *,
                       max_urls: int = 300, digits: int | None = None) -> DataFrame:
    """A16 for relevance: one row per predicted language with both
    coverages (as percentages) and both NDCG variants."""
    rel = relevance_table(annotations)
    cut = cut_predictions(predictions, max_urls)
    out = (coverage(rel, cut).withColumnRenamed("coverage", "coverage_all")
           .join(coverage(rel, cut, positive_only=True).withColumnRenamed("coverage", "coverage_positive"),
                 "language")
           .join(ndcg(rel, cut), "language")
           .join(ndcg(rel, cut, full_ranking=True).withColumnRenamed("ndcg", "ndcg_full"), "language"))
    if digits is not None:
        out = out.select("language", *[F.round(c, digits).alias(c) for c in out.columns if c != "language"])
    return out
