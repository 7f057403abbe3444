"""The corpus build (blobs -> functions -> exact dedup -> tokens -> near
dedup -> shuffle -> folds -> splits) as one lazy Spark plan."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.functions.text import docstring_tokens
from quarry.operators.dedup import exact_dedup, near_dedup
from quarry.operators.extract import code_tokens, extract_functions
from quarry.operators.split import fold_summary, label_folds, with_row_index

CORPUS_COLUMNS = ["repo", "path", "lineno", "func_name", "language", "code", "code_tokens",
                  "comment_tokens", "docstring", "docstring_tokens"]


def functions_table(blobs: DataFrame, *, require_docstring: bool = True) -> DataFrame:
    """X1, D1 (first row per identical code, by repo/path/lineno), T1-T3, P5."""
    funcs = extract_functions(blobs, require_docstring=require_docstring)
    funcs = exact_dedup(funcs, "code", ["repo", "path", "lineno"])
    t = code_tokens("code")
    out = (funcs.withColumn("t", t)
           .select("repo", "path", "lineno", "func_name", "language", "code",
                   F.col("t.code_tokens").alias("code_tokens"), F.col("t.comment_tokens").alias("comment_tokens"),
                   "docstring", docstring_tokens("docstring").alias("docstring_tokens")))
    return out.dropna(subset=["code_tokens", "comment_tokens", "docstring_tokens"])


def build_corpus(blobs: DataFrame, *, ratios=(0.6, 0.15, 0.15, 0.1), min_tokens: int = 10,
                 shuffle_seed: str = "20181026") -> DataFrame:
    """D2 on code tokens within a language, then folds (N3). The reference
    shuffles before writing; a fold is a pure function of (repo, path), so
    the shuffle only affects file order and is left to the writer
    (``quarry.operators.split.shuffle`` when an order is wanted)."""
    # A dense index as the id: no two functions share it.
    funcs = with_row_index(functions_table(blobs), ["repo", "path", "lineno", "func_name"], "doc_id")
    kept = near_dedup(funcs, "doc_id", "code_tokens", "language", min_tokens=min_tokens)
    return label_folds(kept.drop("cluster_id"), *ratios)


def corpus_summary(corpus: DataFrame) -> DataFrame:
    """A3 over a built corpus."""
    return fold_summary(corpus)
