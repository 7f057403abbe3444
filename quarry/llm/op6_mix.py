"""Operator 6: mixing sources to target weights, native.

Capped water-filling over the table of source sizes: every source gets
``weight x level`` words, sources above ``max_epochs`` times their size are
clamped there, and the excess is shared again by weight until no source is
above its cap. A source's words are then taken as whole repetitions of all
its documents plus a seeded part of one more: its documents in the order of
a seeded hash, up to the one that brings the sum nearest to the target.

The order is never sorted whole. Sizes are summed per (source, hash bin),
the running sum over a source's bins (at most ``BINS`` rows) finds the bin in
which the target falls, and only that bin's documents are ordered. A source
with a third of all rows is thus spread by hash bins, and results do not
depend on partitions: the same input and seed give the same sample.

Defined results: a null text has size 0; a null source is a source of its
own, ordered last; a source without words has target 0; documents of size 0
are taken 0 times; repeated rows are separate documents (equal ones swap
freely); an empty table gives an empty result. Extra columns are kept by
``mixed_documents`` and ignored by ``mix``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quarry.llm.common import WORD, documents, stored

WEIGHTS = (5.0, 2.0, 1.0)
MAX_EPOCHS = 3
SEED = "mix-1"
BINS = 4096


def sized(docs: DataFrame, seed: str = SEED, carry: bool = False) -> DataFrame:
    """doc_id, source, size and a seeded order (32 hex digits and their bin);
    ``carry`` adds the whole input row as ``doc``."""
    word = WORD.replace("\\", "\\\\")
    order = F.md5(F.concat(F.lit(seed + ":"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))))
    return docs.select(
        "doc_id", "source",
        F.expr(f"CAST(coalesce(regexp_count(text, '{word}'), 0) AS BIGINT)").alias("size"),
        order.alias("ord"),
        F.conv(F.substring(order, 1, 3), 16, 10).cast("int").alias("bin"),
        F.xxhash64("text").alias("tie"),
        *([F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc")] if carry else []),
    )


def water_fill(sizes: DataFrame, weights=WEIGHTS, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """sizes(source, source_size) -> the same with ``target``.

    Each round is one small aggregate over the source table; only three sums
    reach the driver. A round that clamps nothing ends the loop; every other
    clamps at least one source."""
    rank = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last()))
    weight = F.expr("element_at(array(%s), CAST(pmod(r - 1, %d) AS INT) + 1)" % (
        ", ".join(f"CAST({w} AS DOUBLE)" for w in weights), len(weights)))
    table = stored(sizes.withColumn("r", rank).withColumn("weight", weight).drop("r")
                   .withColumn("cap", (F.col("source_size") * max_epochs).cast("double")), "mix-sources")
    total = table.agg(F.sum("source_size")).first()[0] or 0
    clamped = F.lit(False)
    while True:
        open_weight, closed = table.agg(
            F.coalesce(F.sum(F.when(~clamped, F.col("weight"))), F.lit(0.0)),
            F.coalesce(F.sum(F.when(clamped, F.col("cap"))), F.lit(0.0))).first()
        level = (total - closed) / open_weight if open_weight else 0.0
        now = clamped | (F.col("weight") * F.lit(level) > F.col("cap"))
        more = table.filter(~clamped & now).limit(1).count()
        clamped = F.col("weight") * F.lit(level) > F.col("cap")
        if not more:
            break
    return table.select("source", "source_size",
                        F.when(clamped, F.col("cap")).otherwise(F.col("weight") * F.lit(level)).alias("target"))


def mix(docs: DataFrame, weights=WEIGHTS, max_epochs: int = MAX_EPOCHS, seed: str = SEED,
        carry: bool = False) -> DataFrame:
    """doc_id, source, size, source_size, target, epochs (times taken), taken
    (words taken); with ``carry`` also the input row as ``doc``, which moves
    only for the documents of the bins in which a target falls."""
    rows = stored(sized(docs, seed), "mix-sizes")
    sizes = rows.groupBy("source").agg(F.sum("size").alias("source_size"))
    plan = water_fill(sizes, weights, max_epochs)
    plan = plan.withColumn("whole", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size")))
                           .otherwise(F.lit(0)).cast("long"))
    # Words still wanted after the whole repetitions.
    plan = plan.withColumn("extra", F.round(F.col("target") - F.col("whole") * F.col("source_size")).cast("long"))
    bins = rows.groupBy("source", "bin").agg(F.sum("size").alias("bin_size"))
    before = Window.partitionBy("source").orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)
    bins = bins.withColumn("bin_start", F.coalesce(F.sum("bin_size").over(before), F.lit(0)))
    # A bin that ends before the target is taken once more, one that starts
    # behind it is not; in the one between, the target falls on a document.
    ends = F.col("bin_start") + F.col("bin_size")
    b, p = bins.alias("b"), plan.alias("p")
    cut = (b.join(p, F.col("b.source").eqNullSafe(F.col("p.source")))
           .groupBy(F.col("b.source").alias("source"))
           .agg(F.max(F.when(ends <= F.col("extra"), F.col("bin"))).alias("last_bin"),
                F.max(F.when((F.col("bin_start") < F.col("extra")) & (ends > F.col("extra")),
                             F.struct("bin", "bin_start"))).alias("edge")))
    c = cut.alias("c")
    plan = stored(p.join(c, F.col("p.source").eqNullSafe(F.col("c.source")))
                  .select("p.*", F.coalesce("c.last_bin", F.lit(-1)).alias("last_bin"),
                          F.col("c.edge.bin").alias("edge_bin"), F.col("c.edge.bin_start").alias("edge_start")), "mix-plan")
    source = sized(docs, seed, carry=True) if carry else rows
    r, p = source.alias("r"), plan.alias("p")
    base = (r.join(p, F.col("r.source").eqNullSafe(F.col("p.source")))
            .select("r.*", "p.source_size", "p.target", "p.whole", "p.extra", "p.last_bin", "p.edge_bin", "p.edge_start"))
    on_edge = F.coalesce(F.col("bin") == F.col("edge_bin"), F.lit(False))
    in_order = (Window.partitionBy("source").orderBy("ord", "size", "doc_id", "tie")
                .rowsBetween(Window.unboundedPreceding, -1))
    start = F.col("edge_start") + F.coalesce(F.sum("size").over(in_order), F.lit(0))
    edge_docs = base.filter(on_edge).withColumn("more", (2 * start + F.col("size") <= 2 * F.col("extra")).cast("long"))
    other = base.filter(~on_edge).withColumn("more", (F.col("bin") <= F.col("last_bin")).cast("long"))
    epochs = F.when(F.col("size") > 0, F.col("whole") + F.col("more")).otherwise(F.lit(0)).cast("long")
    return edge_docs.unionByName(other).select(
        "doc_id", "source", "size", "source_size", "target", epochs.alias("epochs"),
        (epochs * F.col("size")).alias("taken"), *(["doc"] if carry else []))


def mixed_documents(docs: DataFrame, **options) -> DataFrame:
    """The mix itself: every row of ``docs`` as many times as it is taken."""
    taken = mix(docs, carry=True, **options).filter("epochs > 0")
    return (taken.select("doc", F.explode(F.sequence(F.lit(1), F.col("epochs").cast("int"))))
            .select("doc.*"))


def op6_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(documents(spark, sf_dir)).select("doc_id", "size", "source_size", "target", "taken")


def oracle() -> str:
    """DuckDB twin: the water level in closed form (sources sorted by cap per
    weight), the sample by one running sum over each source's hash order."""
    return r"""
WITH d AS (SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size,
           md5('mix-1:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS ord FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size, 3.0 * sum(size) AS cap,
      CAST([5, 2, 1][1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3] AS DOUBLE) AS weight FROM d GROUP BY source),
o AS (SELECT *, sum(cap) OVER w - cap AS cap_before, sum(weight) OVER v AS weight_from,
      sum(source_size) OVER () AS total
      FROM s WINDOW w AS (ORDER BY cap / weight, source NULLS LAST ROWS UNBOUNDED PRECEDING),
      v AS (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)),
l AS (SELECT coalesce(max((total - cap_before) / weight_from) FILTER (weight * (total - cap_before) / weight_from <= cap), 1e300)
      AS level FROM o),
t AS (SELECT source, source_size, least(cap, weight * level) AS target FROM s, l),
p AS (SELECT *, CASE WHEN source_size > 0 THEN CAST(floor(target / source_size) AS BIGINT) ELSE 0 END AS whole FROM t),
q AS (SELECT *, CAST(round(target - whole * source_size) AS BIGINT) AS extra FROM p),
r AS (SELECT d.doc_id, d.size, q.source_size, q.target, whole, extra,
      sum(d.size) OVER (PARTITION BY d.source ORDER BY ord, size, doc_id ROWS UNBOUNDED PRECEDING) - d.size AS start
      FROM d JOIN q ON d.source IS NOT DISTINCT FROM q.source)
SELECT doc_id, size, source_size, CAST(target AS DOUBLE) AS target,
  CAST(size * (whole + CASE WHEN 2 * start + size <= 2 * extra THEN 1 ELSE 0 END) AS BIGINT) AS taken FROM r"""
