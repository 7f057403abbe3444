"""A training corpus from ``documents`` in five stages, each one of the
operators in ``quarry.llm`` on all that the stage before it kept.

Every stage is a function ``(spark, docs, sf_dir) -> DataFrame``. Between
stages ``run`` writes the table under the shared checkpoint folder and reads
it back, so a stage is computed once and a lost executor costs no earlier
stage. All but the last stage return the columns of ``documents``; the last
one returns its own.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.llm import op1_quality, op3_bpe, op6_mix, op7_language, op8_near
from quarry.llm.common import fresh
from quarry.session import prepare, read_table, stored

# Results of an operator beside the columns of a document.
_PRIVATE = "__stage_"
# The languages that the first stage learned are any; the list of stop words covers four.
_RULES = tuple(r for r in op1_quality.RULES if r[0] != "stop_words")


def _private(docs: DataFrame) -> str:
    return fresh(docs.columns, _PRIVATE)


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language the model is sure of (7); ``und`` and unsure ones go.

    Null, empty and letter-free texts are ``und`` and go; texts are read whole;
    of two equally likely languages the first by name counts, at a score that
    is not above the limit of two; repeated rows stay repeated; a null id is
    not held out; with no label to learn from all rows go; an empty table gives
    an empty one; other columns, whatever their names, pass through."""
    p = _private(docs)
    out = op7_language.predict_language(docs, op7_language.fit(docs), docs.columns, prefix=p)
    sure = (F.col(p + "lang_pred") != "und") & (F.col(p + "score") >= op7_language.MIN_SCORE)
    return out.filter(sure).select(*[F.col(f"`{c}`") for c in docs.columns])


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep (1), without the rule of stop words,
    whose list does not cover every language that the first stage keeps.

    Null and empty texts have no words and go; texts are read whole; a ratio at
    its limit passes; repeated rows stay repeated; ids and other columns,
    whatever their names or nulls, pass through; an empty table gives an empty one."""
    p = _private(docs)
    judged = op1_quality.quality_columns(docs, prefix=p, rules=_RULES)
    return judged.filter(F.col(p + "kept")).select(*[F.col(f"`{c}`") for c in docs.columns])


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near duplicates (8), the one with the smallest id.

    Null, empty and word-free texts are in no class and stay; texts under five
    words are copies only of equal word lists; whole texts are compared; of rows
    with the smallest id (a null id is the smallest) and equal texts one stays; an
    empty table gives an empty one; other columns, whatever their names, pass through."""
    return op8_near.one_per_class(docs)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document as often as the mix of sources takes it (6).

    A null source is a source of its own, the last; null, empty and word-free
    texts have size 0 and are not taken; ties in the drawing order go by id and
    text; equal rows are drawn as one document of their number; an empty
    table gives an empty one; other columns pass through."""
    return op6_mix.mixed_documents(docs)


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document of the mix, with digests of them and of the decoded text (3).

    A null text counts as empty: no ids; whole texts are encoded; every row
    gives one row, repeated and null ids as well; of the columns doc_id and text are read."""
    return op3_bpe.round_trip(docs)


STAGES = [
    ("language", language),
    ("quality", quality),
    ("near_duplicates", near_duplicates),
    ("mixture", mixture),
    ("encoded", encoded),
]

# A trained language model and a tokenizer are no SQL; tests/llm holds every
# stage against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    prepare(spark)
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), f"stage-{name}")
    name, stage = STAGES[-1]
    return stage(spark, docs, sf_dir)
