"""Driver queries: one per operator group of the inventory.

Each function takes ``(spark, sf_dir)``, reads whole tables from
``sf_dir`` and returns a DataFrame whose column names equal those of the
matching SQL in ``quarry.plans.oracle``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarry.operators import evaluate as ev
from quarry.operators import retrieve as rt
from quarry.session import discard, read_table, spread, stored

TOPK = 5


def _embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_table(spark, sf_dir, "embeddings").select(
        F.col("vec_id"), F.col("embedding").alias("vec"), F.col("label"))


def knn_join_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every embedding queries all others, k nearest by cosine."""
    emb = _embeddings(spark, sf_dir)
    knn = rt.knn_join(emb, emb, TOPK, query_id="vec_id", item_id="vec_id", exclude_self=True)
    return knn.select("query_id", "item_id", "score", F.col("rank").cast("long").alias("rank"))


def knn_by_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Candidates limited to items with the query's label."""
    emb = _embeddings(spark, sf_dir)
    knn = rt.knn_join(emb, emb, TOPK, query_id="vec_id", item_id="vec_id",
                      by="label", exclude_self=True)
    return knn.select("query_id", "item_id", "score", F.col("rank").cast("long").alias("rank"))


def topk_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Minimum slice: knn -> flags by label -> P/R/F1/MRR/accuracy at 5.

    Truth = every other vector with the same label; it is never
    materialised as pairs: relevance is a label comparison and the truth
    size a per-label count.
    """
    emb = _embeddings(spark, sf_dir)
    knn = rt.knn_join(emb, emb, TOPK, query_id="vec_id", item_id="vec_id", exclude_self=True)
    labels = emb.select("vec_id", "label")
    flags = (knn
             .join(labels.select(F.col("vec_id").alias("query_id"), F.col("label").alias("qlabel")),
                   "query_id")
             .join(labels.select(F.col("vec_id").alias("item_id"), F.col("label").alias("ilabel")),
                   "item_id")
             .select("query_id", F.col("item_id").alias("url"), "rank",
                     (F.col("qlabel") == F.col("ilabel")).alias("relevant")))
    per_label = labels.groupBy("label").agg((F.count(F.lit(1)) - 1).alias("n_true"))
    n_true = labels.join(per_label, "label").select(F.col("vec_id").alias("query_id"), "n_true")
    return ev.topk_summary(ev.topk_per_query(flags, n_true, TOPK))


QUERIES = {
    "topk_metrics": topk_metrics,
    "knn_join_exact": knn_join_exact,
    "knn_by_key": knn_by_key,
}


# ---------------------------------------------------------------------------
# Text functions, folds, sampling

from quarry.functions import text as tx  # noqa: E402
from quarry.operators import dedup as dd  # noqa: E402
from quarry.operators import pairs as pr  # noqa: E402
from quarry.operators import split as sp  # noqa: E402
from quarry.operators import stats as st  # noqa: E402
from quarry.plans import fixtures as fx  # noqa: E402

SHUFFLE_SEED = "20181026"
NEGATIVE_SEED = "42"


def _documents(spark, sf_dir):
    return read_table(spark, sf_dir, "documents")


def _documents_spread(spark, sf_dir):
    """Documents for CPU-heavy text work (regex over whole texts)."""
    return spread(read_table(spark, sf_dir, "documents"))


def docstring_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """T1 over whole document texts: token count and digest of the list."""
    toks = tx.docstring_tokens("text")
    return _documents_spread(spark, sf_dir).select(
        "doc_id", F.size(toks).cast("long").alias("n_tokens"),
        F.md5(F.array_join(toks, " ")).alias("tokens_md5"))


def keywords(spark: SparkSession, sf_dir: str) -> DataFrame:
    """T4 over whole document texts with the default stop list."""
    kw = tx.keywords("text")
    return _documents_spread(spark, sf_dir).select(
        "doc_id", F.size(kw).cast("long").alias("n_keywords"),
        F.md5(F.array_join(kw, "|")).alias("keywords_md5"))


def _folded(spark, sf_dir):
    docs = _documents(spark, sf_dir).select(
        "doc_id", F.col("source").alias("repo"), F.col("doc_id").cast("string").alias("path"))
    return sp.label_folds(docs)


def fold_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """File-level fold per document (repo = source, path = doc_id)."""
    return _folded(spark, sf_dir).select("doc_id", "hash_key", "hash_val", "partition")


def fold_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows per fold and share of the total."""
    return sp.fold_summary(_folded(spark, sf_dir)).select(
        "partition", "count", F.round("pct", 6).alias("pct"))


def negatives_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labelled-good documents are positives; all others are kept as
    negatives with probability 0.1, repeatably."""
    docs = _documents(spark, sf_dir).select("doc_id")
    labels = read_table(spark, sf_dir, "labels").select("doc_id", "quality")
    rows = docs.join(labels, "doc_id", "left").select(
        "doc_id", F.coalesce("quality", F.lit(0)).alias("relevance"))
    return rows.where((F.col("relevance") == 1) | sp.kept_by_chance(0.1, NEGATIVE_SEED, "doc_id"))


def shuffled_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Position of each document in the seeded shuffle."""
    docs = _documents(spark, sf_dir).select(
        "doc_id", F.md5(F.concat(F.lit(SHUFFLE_SEED), F.col("doc_id").cast("string"))).alias("k"))
    return sp.with_row_index(docs, ["k", "doc_id"], "pos").select("doc_id", "pos")


# ---------------------------------------------------------------------------
# Dedup (D1, D2)

def exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One survivor (smallest id) per identical text, with copy count."""
    docs = _documents(spark, sf_dir).select("doc_id", "text")
    return dd.exact_dedup(docs, "text", ["doc_id"], count_col="n_copies").select(
        "doc_id", F.col("n_copies").cast("long").alias("n_copies"))


def near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cluster of every document with >= 10 distinct identifiers,
    compared within its language; survivor = smallest id."""
    docs = _documents_spread(spark, sf_dir).select("doc_id", "lang", tx.identifiers("text").alias("toks"))
    clusters = dd.near_dedup_clusters(docs, "doc_id", "toks", "lang")
    return clusters.select("doc_id", "cluster_id",
                           (F.col("doc_id") == F.col("cluster_id")).alias("kept"))


# ---------------------------------------------------------------------------
# Change requests

def patch_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Function and class names found in each generated patch."""
    req = pr.labels_from_patch(fx.change_requests(spark, sf_dir))
    return req.select("request_id", "save_path",
                      F.array_join("label.functions", ",").alias("functions"),
                      F.array_join("label.classes", ",").alias("classes"))


def _parsed_labels(spark, sf_dir):
    lt = fx.label_texts(spark, sf_dir)
    return st.label_counts(pr.labelled(lt.withColumn("label", tx.parse_label("label_text"))))


def parse_label(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stored label text parsed back; unlabelled requests dropped."""
    return _parsed_labels(spark, sf_dir).select(
        "request_id", F.array_join("label.functions", ",").alias("functions"),
        F.array_join("label.classes", ",").alias("classes"),
        F.col("n_functions").cast("long").alias("n_functions"),
        F.col("n_classes").cast("long").alias("n_classes"))


def label_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean / sample std / max / min of label list sizes."""
    out = st.label_stats(_parsed_labels(spark, sf_dir))
    return out.select(*[F.round(c, 6).alias(c) if c.endswith(("mean", "std")) else
                        F.col(c).cast("long").alias(c) for c in out.columns])


def label_argmax(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Requests with the largest total label count (ties kept)."""
    return st.argmax_rows(_parsed_labels(spark, sf_dir), "n_total").select(
        "request_id", F.col("n_total").cast("long").alias("n_total"))


def one_per_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First request (by id) per problem statement."""
    lt = fx.label_texts(spark, sf_dir)
    return st.one_per_key(lt, "problem_statement", ["request_id"]).select(
        "problem_statement", "request_id", "label_text")


def count_summaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A1/A2/A5: rows per language, per source, distinct sources, total."""
    docs = _documents(spark, sf_dir)
    by = [st.count_by(docs, c, "n").select(F.lit(c).alias("dimension"), F.col(c).alias("value"), "n") for c in ("lang", "source")]
    distinct = st.distinct_count(docs, "source", "n").select(
        F.lit("distinct_source").alias("dimension"), F.lit(None).cast("string").alias("value"), "n")
    total = docs.agg(F.count(F.lit(1)).alias("n")).select(
        F.lit("total").alias("dimension"), F.lit(None).cast("string").alias("value"), "n")
    return by[0].unionByName(by[1]).unionByName(distinct).unionByName(total)


# ---------------------------------------------------------------------------
# Relevance evaluation

MAX_URLS = 300


def _rel_cut(spark, sf_dir):
    rel = ev.relevance_table(fx.annotations(spark, sf_dir))
    cut = ev.cut_predictions(fx.predictions(spark, sf_dir), MAX_URLS)
    return rel, cut


def relevance_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean relevance per case-folded (language, query, url)."""
    rel = ev.relevance_table(fx.annotations(spark, sf_dir))
    return rel.select("language", "query", "url", F.round("relevance", 6).alias("relevance"))


def coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Coverage of annotations by the first 300 predictions."""
    rel, cut = _rel_cut(spark, sf_dir)
    return (ev.coverage(rel, cut).withColumnRenamed("coverage", "coverage_all")
            .join(ev.coverage(rel, cut, positive_only=True)
                  .withColumnRenamed("coverage", "coverage_positive"), "language")
            .select("language", F.round("coverage_all", 6).alias("coverage_all"),
                    F.round("coverage_positive", 6).alias("coverage_positive")))


def ndcg_annotated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """NDCG with ranks counted over annotated predictions only."""
    rel, cut = _rel_cut(spark, sf_dir)
    return ev.ndcg(rel, cut).select("language", F.round("ndcg", 6).alias("ndcg"))


def ndcg_full(spark: SparkSession, sf_dir: str) -> DataFrame:
    """NDCG with every prediction taking a rank."""
    rel, cut = _rel_cut(spark, sf_dir)
    return ev.ndcg(rel, cut, full_ranking=True).select(
        "language", F.round("ndcg", 6).alias("ndcg_full"))


QUERIES.update({
    "docstring_tokens": docstring_tokens,
    "keywords": keywords,
    "fold_labels": fold_labels,
    "fold_summary": fold_summary,
    "negatives_sample": negatives_sample,
    "shuffled_order": shuffled_order,
    "exact_dedup": exact_dedup,
    "near_dedup": near_dedup,
    "patch_labels": patch_labels,
    "parse_label": parse_label,
    "label_stats": label_stats,
    "label_argmax": label_argmax,
    "one_per_query": one_per_query,
    "count_summaries": count_summaries,
    "relevance_mean": relevance_mean,
    "coverage": coverage,
    "ndcg_annotated": ndcg_annotated,
    "ndcg_full": ndcg_full,
})


# ---------------------------------------------------------------------------
# Keyword context, prompts, rewriting

from quarry.operators import match as mt  # noqa: E402


def _matched(spark, sf_dir):
    """Keywords are extracted once per request and stored until the cells are
    counted (prompts need their number only); the issue text is joined back only where the
    prompt needs it."""
    base = spread(fx.issue_requests(spark, sf_dir))
    kw = stored(mt.with_keywords(base).select("request_id", "save_path", "keywords", "keyword_num"), "keywords")
    asked = stored(kw.select("request_id", "save_path", "keyword_num"), "requests")
    matched = mt.match_tags(kw, fx.line_tags(spark, sf_dir))
    discard(kw)
    req = asked.join(base.select("request_id", "problem_statement"), "request_id")
    return req, matched


def tag_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Top 10 tag lines (>= 3 keyword hits) per issue."""
    _, matched = _matched(spark, sf_dir)
    return matched.select("request_id", F.col("rank").cast("long").alias("rank"), "path",
                          F.col("line").cast("long").alias("line"), F.col("hits").cast("long").alias("hits"))


def prompt_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """T5: prompt per issue with keywords."""
    req, matched = _matched(spark, sf_dir)
    return mt.build_prompts(req, matched)


QUERIES.update({
    "tag_context": tag_context,
    "prompt_table": prompt_table,
})


# ---------------------------------------------------------------------------
# Source parsing

from quarry.operators import extract as xt  # noqa: E402


def extract_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documented functions and methods of generated modules."""
    funcs = xt.extract_functions(fx.python_sources(spark, sf_dir))
    return funcs.select("repo", "path", "func_name", F.col("lineno").cast("long").alias("lineno"),
                        "language", "code", "docstring")


def extract_definitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Functions and classes with bodies (methods included)."""
    defs = xt.extract_definitions(fx.python_sources(spark, sf_dir))
    return defs.select("path", "kind", "name", F.col("start_line").cast("long").alias("start_line"),
                       F.col("end_line").cast("long").alias("end_line"), "body")


def build_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tag rows of non-test modules."""
    tags = xt.build_tags(fx.python_sources(spark, sf_dir), path="path")
    return tags.select("path", "kind", "name", F.col("line").cast("long").alias("line"),
                       F.col("end").cast("long").alias("end"), "pattern")


def code_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Code and comment tokens of the extracted functions."""
    funcs = xt.extract_functions(fx.python_sources(spark, sf_dir))
    tok = funcs.select("path", "func_name", xt.code_tokens("code").alias("t"))
    return tok.select("path", "func_name",
                      F.size("t.code_tokens").cast("long").alias("n_code_tokens"),
                      F.array_join("t.code_tokens", " ").alias("code_tokens"),
                      F.array_join("t.comment_tokens", " ").alias("comment_tokens"))


QUERIES.update({
    "extract_functions": extract_functions,
    "extract_definitions": extract_definitions,
    "build_tags": build_tags,
    "code_tokens": code_tokens,
})


# ---------------------------------------------------------------------------
# Sources and sinks (S1-S12, P1, P3, U1-U3, X6). Each query writes Spark-
# derived data to a fresh folder under the shared checkpoint folder and
# returns what the reader gives back.

from quarry.session import scratch_dir  # noqa: E402
from quarry.sources import io as sio  # noqa: E402


def io_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Folds written per split (JSON lines + Parquet) and as
    1000-row chunks, read back with a fixed schema."""
    root = scratch_dir(spark, "io-roundtrip")
    docs = _documents(spark, sf_dir).select(
        "doc_id", F.col("source").alias("repo"), F.col("doc_id").cast("string").alias("path"), "text")
    folded = sp.label_folds(docs).drop("hash_key")
    sio.write_splits(folded, f"{root}/splits")
    sio.write_chunked_jsonl(folded.drop("partition"), f"{root}/chunks", 1000, compression="gzip")
    schema = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("repo", T.StringType()),
                           T.StructField("path", T.StringType()), T.StructField("text", T.StringType()),
                           T.StructField("hash_val", T.IntegerType())])
    chunks = sio.read_jsonl(spark, f"{root}/chunks", schema)
    splits = sio.read_jsonl(spark, f"{root}/splits/jsonl",
                            T.StructType(schema.fields + [T.StructField("partition", T.StringType())]))
    pq = spark.read.parquet(f"{root}/splits/parquet").select("doc_id", F.col("partition").alias("pq_partition"))
    return (splits.join(chunks.select("doc_id", F.md5("text").alias("chunk_md5")), "doc_id")
            .join(pq, "doc_id")
            .select("doc_id", "partition", "pq_partition", F.md5("text").alias("text_md5"), "chunk_md5"))


def io_blobs_csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as two CSV folders of (repo_path, content),
    read back as one scan and split into repo and path."""
    root = scratch_dir(spark, "io-blobs")
    blobs = _documents(spark, sf_dir).select(
        F.concat_ws(" ", "source", F.col("doc_id").cast("string")).alias("repo_path"),
        F.col("text").alias("content"), "lang")
    first = F.coalesce(F.col("lang").isin("en", "fr"), F.lit(False))  # a null lang is in the second folder
    sio.write_table(blobs.where(first).drop("lang"), f"{root}/a", "csv")
    sio.write_table(blobs.where(~first).drop("lang"), f"{root}/b", "csv")
    back = sio.read_blobs(spark, [f"{root}/a", f"{root}/b"])
    return back.select("repo", "path", F.md5("content").alias("content_md5"),
                       F.length("content").cast("long").alias("n_chars"))


def io_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Generated modules written as files in nested folders,
    found again by suffix and parsed."""
    root = scratch_dir(spark, "io-sources")
    src = fx.python_sources(spark, sf_dir).select(
        F.concat_ws("/", "repo", "path").alias("file"), "content")
    sio.write_files(src, root, "file", "content")
    defs = xt.extract_definitions(sio.read_sources(spark, root, (".py",)))
    return defs.select("file", "kind", "name", F.col("start_line").cast("long").alias("start_line"),
                       F.col("end_line").cast("long").alias("end_line"), "body")


def io_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tag index written per snapshot and read back."""
    root = scratch_dir(spark, "io-tags")
    tags = xt.build_tags(fx.python_sources(spark, sf_dir).withColumnRenamed("repo", "save_path"), path="path")
    sio.write_tags(tags, root)
    back = sio.read_tags(spark, root)
    return back.select("save_path", "path", "name", "kind", "line", "end", "pattern")


def io_annotations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Annotations and ranked predictions through CSV, then the
    relevance table computed from what was read."""
    root = scratch_dir(spark, "io-ann")
    sio.write_table(fx.annotations(spark, sf_dir).withColumn("Relevance", F.col("Relevance").cast("double")),
                    f"{root}/annotations", "csv")
    sio.write_table(fx.predictions(spark, sf_dir), f"{root}/predictions", "csv")
    ann = sio.read_annotations(spark, f"{root}/annotations")
    pred = sio.read_predictions(spark, f"{root}/predictions")
    cov = ev.coverage(ev.relevance_table(ann), ev.cut_predictions(pred, MAX_URLS))
    return cov.select("language", F.round("coverage", 6).alias("coverage_all"))


def io_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labelled change requests exported as JSON lines and read
    with the change-request schema."""
    root = scratch_dir(spark, "io-req")
    req = pr.labels_from_patch(fx.change_requests(spark, sf_dir)).select(
        "repo", "base_commit", "patch", "problem_statement",
        F.lit("").alias("hints_text"), F.lit("2024-01-01T00:00:00Z").alias("created_at"),
        F.lit("1.0").alias("version"), "label", "save_path")
    sio.write_table(req, f"{root}/requests", "json")
    back = sio.read_change_requests(spark, f"{root}/requests")
    return back.select("save_path", F.md5("patch").alias("patch_md5"),
                       F.array_join("label.functions", ",").alias("functions"),
                       F.array_join("label.classes", ",").alias("classes"))


QUERIES.update({
    "io_roundtrip": io_roundtrip,
    "io_blobs_csv": io_blobs_csv,
    "io_sources": io_sources,
    "io_tags": io_tags,
    "io_annotations": io_annotations,
    "io_requests": io_requests,
})


# ---------------------------------------------------------------------------
# Relevance pairs (J1, J2, N1, P6, P7, P12, S9) and encoding

PAIR_SEED = "7"


def _pairs(spark, sf_dir, p):
    root = scratch_dir(spark, "io-defs")
    sio.write_table(fx.snapshot_definitions(spark, sf_dir), f"{root}/definitions", "parquet")
    defs = sio.read_definitions(spark, f"{root}/definitions")
    req = pr.labels_from_patch(fx.change_requests(spark, sf_dir))
    return pr.build_pairs(req, defs, p=p, seed=PAIR_SEED)


def _pair_columns(pairs):
    return pairs.select("request_id", "kind", "Language", F.md5("Query").alias("query_md5"), "GitHubUrl", "Relevance",
                        "Notes", F.md5("Code").alias("code_md5"))


def build_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Positives plus negatives kept with probability 0.1."""
    return _pair_columns(_pairs(spark, sf_dir, 0.1))


def pair_positives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The positive pairs alone (p = 0)."""
    return _pair_columns(_pairs(spark, sf_dir, 0.0))


def encode_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole document texts encoded by the default hashing encoder."""
    enc = rt.hash_encode(_documents_spread(spark, sf_dir).select("doc_id", "text"), "doc_id", "text")
    return enc.select("doc_id", F.size("vec").cast("long").alias("dim"),
                      F.round(F.sqrt(F.aggregate("vec", F.lit(0.0), lambda a, x: a + x * x)), 6).alias("norm"))


def _text_neighbours(spark, sf_dir, k):
    bench = read_table(spark, sf_dir, "benchmark")
    q = rt.hash_encode(bench.select("item_id", "text"), "item_id", "text")
    items = rt.hash_encode(_documents_spread(spark, sf_dir).select("doc_id", "text"), "doc_id", "text")
    return q, rt.knn_join(q, items, k, query_id="item_id", item_id="doc_id")


def knn_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """E1 -> E3/E5 -> E7/J7: benchmark passages encoded as queries against all
    encoded documents; five nearest documents per passage."""
    q, knn = _text_neighbours(spark, sf_dir, TOPK)
    docs = _documents(spark, sf_dir).select("doc_id", "source")
    ranked = rt.to_predictions(knn, q, docs, query_id="item_id", item_id="doc_id", item_cols=["source"])
    return ranked.select("query_id", "item_id", "source", "score", F.col("rank").cast("long").alias("rank"))


def knn_deep(spark: SparkSession, sf_dir: str) -> DataFrame:
    """E3/W8 at the reference's search depth: 1000 nearest vectors of every vector."""
    emb = _embeddings(spark, sf_dir)
    knn = rt.knn_join(emb, emb, 1000, query_id="vec_id", item_id="vec_id", exclude_self=True)
    return knn.select("query_id", "item_id", "score", F.col("rank").cast("long").alias("rank"))


QUERIES.update({"knn_deep": knn_deep})


def topk_truth(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ranked predictions per (language, source) against the
    documents labelled good, joined on (query, url)."""
    name = F.concat_ws("/", "language", "query")
    pred = fx.predictions(spark, sf_dir).select(name.alias("query_id"), "url", "rank")
    ann = fx.annotations(spark, sf_dir).filter("Relevance = 1")
    truth = ann.select(F.concat_ws("/", "Language", "Query").alias("query_id"), F.col("GitHubUrl").alias("url"))
    return ev.evaluate_topk(pred, truth, TOPK)


def relevance_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Both coverages and both NDCGs per language in one table."""
    return ev.evaluate_relevance(fx.annotations(spark, sf_dir), fx.predictions(spark, sf_dir), max_urls=MAX_URLS, digits=6)


QUERIES.update({"topk_truth": topk_truth, "relevance_report": relevance_report})


QUERIES.update({
    "build_pairs": build_pairs,
    "pair_positives": pair_positives,
    "encode_hash": encode_hash,
    "knn_text": knn_text,
})


# ---------------------------------------------------------------------------
# Streaming corpus build (S1, X1, D1, T1-T3, N3, S11 as one stream)

from quarry.plans import corpus as bc  # noqa: E402
from quarry.streaming import corpus as cs  # noqa: E402


def stream_corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Generated modules arrive as two CSV blob files; the streaming corpus
    build drains them (availableNow) into fold folders, read back here."""
    root = scratch_dir(spark, "stream")
    blobs = fx.python_sources(spark, sf_dir).select(
        F.concat_ws(" ", "repo", "path").alias("repo_path"), "content")
    sio.write_table(blobs.where(F.col("repo_path").contains("pkg/")), f"{root}/blobs/1", "csv")
    sio.write_table(blobs.where(~F.col("repo_path").contains("pkg/")), f"{root}/blobs/2", "csv")
    q = cs.start_corpus_stream(spark, f"{root}/blobs/*", f"{root}/out", f"{root}/ckpt")
    q.awaitTermination()
    schema = T.StructType(sio.FUNCTION_SCHEMA.fields + [T.StructField("hash_key", T.StringType()),
                                                        T.StructField("hash_val", T.IntegerType())])
    out = spark.read.schema(schema).json(f"{root}/out")
    return out.select("repo", "path", "func_name", F.col("lineno").cast("long").alias("lineno"),
                      "partition", "hash_val",
                      F.size("code_tokens").cast("long").alias("n_code_tokens"),
                      F.size("docstring_tokens").cast("long").alias("n_docstring_tokens"))


QUERIES.update({"stream_corpus": stream_corpus})


def extract_definitions_no_methods(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Definitions with class methods ignored (nested classes kept)."""
    defs = xt.extract_definitions(fx.python_sources(spark, sf_dir), ignore_class_methods=True)
    return defs.select("path", "kind", "name", F.col("start_line").cast("long").alias("start_line"),
                       F.col("end_line").cast("long").alias("end_line"), "body")


def extraction_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Blobs parsed and functions kept, per repository and (repo null) overall."""
    src = fx.python_sources(spark, sf_dir)
    per_blob = (xt.extract_functions(src).groupBy("repo", "path").agg(F.count(F.lit(1)).alias("n_functions")))
    blobs = src.select("repo", "path").join(per_blob, ["repo", "path"], "left")
    return (blobs.rollup("repo")
            .agg(F.count(F.lit(1)).alias("n_blobs"),
                 F.coalesce(F.sum("n_functions"), F.lit(0)).cast("long").alias("n_functions")))


def extraction_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files that do not parse, counted per repository instead of vanishing."""
    defs = xt.extract_definitions(fx.python_sources(spark, sf_dir), with_errors=True)
    return defs.where(F.col("error").isNotNull()).groupBy("repo").agg(F.count("*").alias("n_broken"))


def batch_corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The corpus build in one batch, near duplicates included."""
    out = bc.build_corpus(fx.python_sources(spark, sf_dir), min_tokens=1)
    return out.select("repo", "path", "func_name", F.col("lineno").cast("long").alias("lineno"), "partition", "hash_val",
                      F.size("code_tokens").cast("long").alias("n_code_tokens"),
                      F.size("docstring_tokens").cast("long").alias("n_docstring_tokens"))


def labels_by_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Requests in the order of their label counts, ties by id, with their place."""
    counted = _parsed_labels(spark, sf_dir).select("request_id", "n_total")
    ordered = st.order_by_counts(counted, "n_total", ["request_id"])
    return sp.with_place(ordered).select("request_id", F.col("n_total").cast("long").alias("n_total"), "place")


def io_broken_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """S3: a JSON-lines folder in which every document's line is followed by
    a cut copy of it; good rows and the count of broken lines come back."""
    root = scratch_dir(spark, "io-broken")
    docs = _documents(spark, sf_dir).select("doc_id", "source")
    line = F.to_json(F.struct("doc_id", "source"))
    lines = docs.select(F.explode(F.array(line, F.expr("left(to_json(struct(doc_id, source)), 9)"))).alias("value"))
    lines.write.text(f"{root}/lines")
    schema = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("source", T.StringType())])
    good, broken = sio.read_jsonl_reporting(spark, f"{root}/lines", schema)
    return good.groupBy("source").agg(F.count("*").alias("n_good")).unionByName(
        broken.agg(F.lit("broken lines").alias("source"), F.count("*").alias("n_good")))


QUERIES.update({
    "extraction_errors": extraction_errors,
    "batch_corpus": batch_corpus,
    "labels_by_count": labels_by_count,
    "io_broken_lines": io_broken_lines,
    "extract_definitions_no_methods": extract_definitions_no_methods,
    "extraction_summary": extraction_summary,
})


# ---------------------------------------------------------------------------
# Definitions in six languages.

def _definition_rows(defs: DataFrame, path: str) -> DataFrame:
    return defs.select(xt.language_of(F.col(path)).alias("language"), F.col(path).alias("path"), "kind", "name",
                       F.col("start_line").cast("long").alias("start_line"), F.col("end_line").cast("long").alias("end_line"), "body")


def definitions_by_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Functions and classes of files in six languages, by their suffix."""
    return _definition_rows(xt.extract_definitions(fx.language_sources(spark, sf_dir), path="path"), "path")


def io_sources_by_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same files written into nested folders, found again by
    language and parsed without the methods of classes."""
    root = scratch_dir(spark, "io-languages")
    src = fx.language_sources(spark, sf_dir).select(F.concat_ws("/", "repo", "path").alias("file"), "content")
    notes = src.select(F.concat("file", F.lit(".txt")).alias("file"), "content")
    sio.write_files(src.unionByName(notes), root, "file", "content")
    found = sio.read_sources(spark, root, languages=("python", "go", "java", "php", "ruby", "javascript"))
    return _definition_rows(xt.extract_definitions(found, path="file", ignore_class_methods=True), "file")


def broken_by_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files of each language that do not parse."""
    defs = xt.extract_definitions(fx.language_sources(spark, sf_dir), path="path", with_errors=True)
    return (defs.where(F.col("error").isNotNull()).groupBy(xt.language_of(F.col("path")).alias("language"))
            .agg(F.count("*").alias("n_broken")))


QUERIES.update({
    "definitions_by_language": definitions_by_language,
    "io_sources_by_language": io_sources_by_language,
    "broken_by_language": broken_by_language,
})


# ---------------------------------------------------------------------------
# Python files of the older grammar, and broken ones.

def functions_old_grammar(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Functions of modules that only the older grammar accepts; broken ones have none."""
    funcs = xt.extract_functions(fx.old_sources(spark, sf_dir))
    return funcs.select("path", "func_name", F.col("lineno").cast("long").alias("lineno"), "code", "docstring")


def functions_recovered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """X1 with ``recover``: broken modules give the functions of their sound pieces."""
    funcs = xt.extract_functions(fx.old_sources(spark, sf_dir), recover=True)
    return funcs.select("path", "func_name", F.col("lineno").cast("long").alias("lineno"), "code", "docstring")


def definitions_old_grammar(spark: SparkSession, sf_dir: str) -> DataFrame:
    """X3/X5 on the same modules."""
    defs = xt.extract_definitions(fx.old_sources(spark, sf_dir))
    return defs.select("path", "kind", "name", F.col("start_line").cast("long").alias("start_line"),
                       F.col("end_line").cast("long").alias("end_line"), "body")


def code_tokens_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """T2/T3 with each flag, on functions of the older grammar."""
    funcs = xt.extract_functions(fx.old_sources(spark, sf_dir))
    tok = funcs.select("path", "func_name", xt.code_tokens("code").alias("a"), xt.code_tokens("code", only_ids=True).alias("b"),
                       xt.code_tokens("code", add_keywords=False).alias("c"), xt.code_tokens("code", func_only=False).alias("d"))
    return tok.select("path", "func_name", F.array_join("a.code_tokens", " ").alias("tokens"), F.array_join("b.code_tokens", " ").alias("ids"),
                      F.array_join("c.code_tokens", " ").alias("no_keywords"), F.array_join("d.code_tokens", " ").alias("whole"),
                      F.array_join("a.comment_tokens", " ").alias("comment_tokens"))


QUERIES.update({
    "functions_old_grammar": functions_old_grammar,
    "functions_recovered": functions_recovered,
    "definitions_old_grammar": definitions_old_grammar,
    "code_tokens_flags": code_tokens_flags,
})


# ---------------------------------------------------------------------------
# Stored index.

from quarry.operators import forest as fo  # noqa: E402


def _vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("query_id"), F.col("vec_id").alias("item_id"),
                                                          F.col("embedding").alias("vec"), "label")


def knn_index_by_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An index that is written once, opened again and searched
    in all leaves of a tree, with candidates of the query's label: exact."""
    vectors = _vectors(spark, sf_dir)
    path = scratch_dir(spark, "vector-index")
    fo.build_index(vectors, path, by="label", trees=1)
    out = fo.search(fo.VectorIndex.open(spark, path), vectors, 5, by="label", exclude_self=True, effort=None)
    return out.select("query_id", "item_id", "score", F.col("rank").cast("long").alias("rank"))


def knn_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every vector searched in a forest, held against the exact join: how
    many queries, whether nine tenths of the exact neighbours were found, and
    whether the leaves looked at hold fewer items than all queries x all items."""
    vectors = _vectors(spark, sf_dir)
    index = fo.build_index(vectors, scratch_dir(spark, "vector-forest"))
    found = fo.search(index, vectors, 5, exclude_self=True).select("query_id", "item_id", F.lit(1).alias("hit"))
    exact = rt.knn_join(vectors, vectors, 5, exclude_self=True).select("query_id", "item_id")
    recall = exact.join(found, ["query_id", "item_id"], "left").agg(
        F.countDistinct("query_id").alias("n_queries"), (F.count("hit") >= 0.9 * F.count("*")).alias("recall_reached"))
    looked = fo.work(index, vectors).agg((F.sum("items") < F.count("*") * index.n).alias("work_spared"))
    rows = recall.withColumn("work_spared", F.lit(None).cast("boolean")).unionByName(looked, allowMissingColumns=True)
    return rows.agg(*[F.max(c).alias(c) for c in ("n_queries", "recall_reached", "work_spared")])


QUERIES.update({
    "knn_index_by_key": knn_index_by_key,
    "knn_forest": knn_forest,
})


# ---------------------------------------------------------------------------
# Shards, byte ranges, numbered chunks, tag files, token-list records, encoders.

from quarry.sources import shards as sh  # noqa: E402

SHARD_ROWS = 50


def io_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents in numbered CSV shards, read back; a number without a shard is reported."""
    root = scratch_dir(spark, "io-shards")
    quoted = lambda c: F.concat(F.lit('"'), F.replace(c, F.lit('"'), F.lit('""')), F.lit('"'))
    docs = _documents(spark, sf_dir).withColumn("shard", F.floor(F.col("doc_id") / SHARD_ROWS).cast("int"))
    line = F.concat(quoted(F.concat_ws(" ", "source", F.col("doc_id").cast("string"))), F.lit(","), quoted(F.col("text")), F.lit("\n"))
    files = docs.groupBy("shard").agg(F.concat(F.lit("repo_path,content\n"), F.array_join(F.collect_list(line), "")).alias("content"))
    sio.write_files(files.select(F.format_string("blobs_0%d.csv", F.col("shard")).alias("file"), "content"), root, "file", "content")
    last = docs.agg(F.max("shard")).first()[0] or 0
    blobs, lost = sh.read_shards(spark, root + "/blobs_0{}.csv", list(range(last + 2)), attempts=2, delay=0.0)
    return (blobs.select("repo", "path", F.md5("content").alias("content_md5"))
            .unionByName(lost.select(F.lit("given up").alias("repo"), F.col("shard").cast("string").alias("path"), F.lit(None).cast("string").alias("content_md5"))))


def io_blob_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as multi-line CSV, read back in byte ranges of 64 KB."""
    root = scratch_dir(spark, "io-ranges")
    docs = _documents(spark, sf_dir).select(F.concat_ws(" ", "source", F.col("doc_id").cast("string")).alias("repo_path"), F.col("text").alias("content"))
    sio.write_table(docs, root, "csv")
    return sh.read_blob_ranges(spark, root, range_bytes=1 << 16).select("repo", "path", F.md5("content").alias("content_md5"))


def io_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents in chunks of exactly 100 rows by id; what each numbered file holds."""
    root = scratch_dir(spark, "io-chunks")
    sh.write_numbered_jsonl(_documents(spark, sf_dir).select("doc_id", "source"), root, ["doc_id"], 100)
    back = spark.read.schema("doc_id long, source string").json(root).withColumn("file", F.col("_metadata.file_name"))
    return back.groupBy("file").agg(F.count("*").alias("n"), F.min("doc_id").alias("first_id"), F.max("doc_id").alias("last_id"))


def io_tag_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One ``<save_path>.tags`` file of JSON lines per snapshot, read back."""
    root = scratch_dir(spark, "io-tag-files")
    src = fx.python_sources(spark, sf_dir).withColumn("save_path", F.concat(F.replace("repo", F.lit("/"), F.lit("_")), F.lit("_"), F.regexp_extract("path", r"(\d)\.py$", 1)))
    tags = xt.build_tags(src.drop("repo"), path="path")
    line = F.to_json(F.struct("name", "path", "pattern", "kind", "line", "end"))
    files = tags.groupBy("save_path").agg(F.array_join(F.collect_list(line), "\n").alias("content"))
    sio.write_files(files.withColumn("file", F.concat("save_path", F.lit(".tags"))), root, "file", "content")
    return sio.read_tags(spark, root).select("save_path", "path", "name", "kind", "line", "end", "pattern")


def io_definition_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Functions as token-list records, written and read back."""
    root = scratch_dir(spark, "io-definitions")
    funcs = xt.extract_functions(fx.python_sources(spark, sf_dir))
    sio.write_definition_records(funcs.withColumn("url", F.concat_ws("#", "path", "func_name")), root)
    back = sio.read_definitions(spark, root, tokens=True)
    return back.select("identifier", "url", F.array_join("function_tokens", " ").alias("tokens"))


def _vowels(texts: list[str]):
    import numpy as np

    return np.array([[t.count(c) for c in "aeiou"] for t in texts], float)


def encode_custom(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An encoder of the caller's, in batches of texts of like length."""
    docs = rt.encode(_documents(spark, sf_dir).select("doc_id", "text"), "text", _vowels, by_length=True)
    return docs.select("doc_id", F.array_join(F.transform("vec", lambda v: v.cast("long").cast("string")), ",").alias("vowels"))


QUERIES.update({
    "io_shards": io_shards,
    "io_blob_ranges": io_blob_ranges,
    "io_chunks": io_chunks,
    "io_tag_files": io_tag_files,
    "io_definition_records": io_definition_records,
    "encode_custom": encode_custom,
})
