"""Operator 1: quality rules, native.

A threshold table (``RULES``) is compiled into one projection of built-in
functions: word, symbol, stop-word and line ratios per document, no user
function and no shuffle, so a document of any size is judged where it is
read.

Defined results: a null text counts as empty; a text without words has all
counts 0, ratios 0, fails the base rule and is not kept; rows are judged one
by one, so repeated rows give repeated results and an empty table an empty
one; other columns are not touched (``quality_columns`` adds its columns
under a caller-chosen prefix, so names cannot clash).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.llm.common import WORD, documents, fresh

# Stop words of the languages the corpus is filtered for (fixed values).
STOP_WORDS = (
    "the of and to in is that it for was on are with as be this by from or an at not "
    "der die das und ist von den mit zu ein eine nicht im auf für des dem auch als sich "
    "le la les de et un une des est que pour dans en du ce au avec sur pas qui "
    "el los las y del se por con no una su para es al lo como más"
).split()

# (name, ratio, least, most): a document is kept if every ratio lies in its range.
# The ratios are expressions over the counts of quality_columns.
RULES = (
    ("word_length", "word_chars / n_words", 1.5, 25.0),
    ("symbols_per_word", "n_symbols / n_words", None, 0.3),
    ("exclamations_per_word", "n_exclamations / n_words", None, 0.5),
    ("stop_words", "n_stop_words / n_words", 0.01, 0.9),
    ("repeated_lines", "n_dup_lines / n_lines", None, 0.5),
)
MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50

COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
          "n_exclamations", "n_stop_words", "n_lines")


def compile_rules(rules=RULES) -> str:
    """The threshold table as one SQL condition over the counts."""
    tests = []
    for _, ratio, least, most in rules:
        if least is not None:
            tests.append(f"({ratio}) >= {least}")
        if most is not None:
            tests.append(f"({ratio}) <= {most}")
    return " AND ".join(tests) or "true"


def quality_columns(df: DataFrame, text: str = "text", prefix: str = "", rules=RULES) -> DataFrame:
    """``df`` with the counts, ``base_failed`` and ``kept``, each name after ``prefix``."""
    keep = [F.col(f"`{c}`") for c in df.columns]
    own = fresh(df.columns, "__")  # what the names of the steps' own columns begin with
    word = WORD.replace("\\", "\\\\")
    stop = ", ".join("'" + w + "'" for w in STOP_WORDS)

    def sql(expression: str, name: str) -> Column:
        return F.expr(expression.replace("@", own)).alias(own + name)

    def held(*names: str) -> list[str]:
        return [own + n for n in names]

    df = df.select(*keep, F.coalesce(F.col(f"`{text}`"), F.lit("")).alias(own + "text"))
    # 1: words and lines. Every later step refers to these arrays more than once,
    # so the optimizer keeps the steps apart and each array is built once.
    df = df.select(
        *keep,
        sql(f"regexp_extract_all(@text, '{word}', 0)", "words"),
        sql(f"filter(split(@text, '\\n'), l -> l rlike '{word}')", "lines"),
        sql("regexp_count(@text, '[#*$%&|<>]')", "symbols"),
        sql("regexp_count(@text, '!')", "excl"),
        sql("length(@text) - regexp_count(@text, '[\\\\x20\\\\x09-\\\\x0D]')", "chars"),
    )
    # 2: three-word windows as (hash, position), sorted so that equal windows are neighbours.
    df = df.select(
        *keep, *held("words", "symbols", "excl", "chars"),
        sql("size(@words)", "n"),
        sql("size(@lines)", "n_lines"),
        sql("size(@lines) - size(array_distinct(@lines))", "dup_lines"),
        sql(f"size(filter(@words, w -> lower(w) IN ({stop})))", "stop"),
        sql("""CASE WHEN size(@words) >= 4 THEN sort_array(transform(sequence(0, size(@words) - 3),
               i -> struct(xxhash64(get(@words, i), get(@words, i + 1), get(@words, i + 2)) AS g, i AS i)))
               END""", "win"),
    )
    # 3: positions of windows found twice or more, in text order.
    df = df.select(
        *keep, *held("n", "symbols", "excl", "chars", "n_lines", "dup_lines", "stop"),
        sql("""sort_array(transform(filter(@win, (x, j) ->
               coalesce(get(@win, j - 1).g = x.g, false) OR coalesce(get(@win, j + 1).g = x.g, false)),
               x -> x.i))""", "pos"),
    )
    # 4: words covered by those windows: each covers three words less its overlap with the one before.
    repeat = """CASE WHEN coalesce(size(@pos), 0) <= 0 THEN 0 ELSE 3 + aggregate(
                zip_with(slice(@pos, 2, size(@pos)), slice(@pos, 1, size(@pos) - 1), (b, a) -> least(3, b - a)),
                0, (s, x) -> s + coalesce(x, 0)) END"""
    exprs = {"n_words": "@n", "word_chars": "@chars", "n_symbols": "@symbols", "n_dup_lines": "@dup_lines",
             "n_repeat_words": repeat, "n_exclamations": "@excl", "n_stop_words": "@stop", "n_lines": "@n_lines"}
    counts = F.struct(*[F.expr(f"CAST({e} AS BIGINT)".replace("@", own)).alias(n) for n, e in exprs.items()])
    # explode: a filter on the results must not be moved below them, which would
    # copy the arrays' expressions into the filter and into their own functions.
    q = own + "q"
    df = df.select(*keep, F.explode(F.array(counts)).alias(q))
    base = f"({q}.n_words < {MIN_WORDS} OR 100 * {q}.n_repeat_words > {MAX_REPEAT_PERCENT} * {q}.n_words)"
    rule = compile_rules(rules)
    for name in sorted(COUNTS, key=len, reverse=True):
        rule = rule.replace(f" {name}", f" {q}.{name}").replace(f"({name}", f"({q}.{name}")
    return df.select(
        *keep, *[F.col(f"{q}.{n}").alias(prefix + n) for n in COUNTS],
        F.expr(base).alias(prefix + "base_failed"),
        F.expr(f"CASE WHEN {base} THEN false ELSE {rule} END").alias(prefix + "kept"),
    )


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text")
    first = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"]
    return quality_columns(docs).select(*first, "n_exclamations", "n_stop_words", "n_lines")


def oracle() -> str:
    """DuckDB twin; constants are spelled here once more, windows compared as strings."""
    stop = ", ".join("'" + w + "'" for w in (
        "the of and to in is that it for was on are with as be this by from or an at not "
        "der die das und ist von den mit zu ein eine nicht im auf für des dem auch als sich "
        "le la les de et un une des est que pour dans en du ce au avec sur pas qui "
        "el los las y del se por con no una su para es al lo como más").split())
    return rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT r, doc_id, t, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS words,
      list_filter(string_split(t, chr(10)), lambda l: regexp_matches(l, '[^\x20\x09-\x0D]')) AS lines FROM d),
win AS (SELECT r, unnest(range(0, len(words) - 2)) AS i,
        unnest(list_transform(range(0, len(words) - 2), lambda k: words[k + 1] || ' ' || words[k + 2] || ' ' || words[k + 3])) AS g
        FROM w WHERE len(words) >= 3),
win2 AS (SELECT r, i, count(*) OVER (PARTITION BY r, g) AS c FROM win),
cov AS (SELECT r, count(DISTINCT i + k) AS n FROM win2, (SELECT unnest([0, 1, 2]) AS k) WHERE c > 1 GROUP BY r),
c AS (SELECT w.doc_id, CAST(len(words) AS BIGINT) AS n_words,
      CAST(length(regexp_replace(t, '[\x20\x09-\x0D]', '', 'g')) AS BIGINT) AS word_chars,
      CAST(length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
      CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines,
      CAST(coalesce(cov.n, 0) AS BIGINT) AS n_repeat_words,
      CAST(length(t) - length(replace(t, '!', '')) AS BIGINT) AS n_exclamations,
      CAST(len(list_filter(words, lambda x: lower(x) IN ({stop}))) AS BIGINT) AS n_stop_words,
      CAST(len(lines) AS BIGINT) AS n_lines
      FROM w LEFT JOIN cov USING (r)),
b AS (SELECT *, (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AS base_failed FROM c)
SELECT *, CASE WHEN base_failed THEN false ELSE word_chars / n_words BETWEEN 1.5 AND 25.0
  AND n_symbols / n_words <= 0.3 AND n_exclamations / n_words <= 0.5
  AND n_stop_words / n_words BETWEEN 0.01 AND 0.9 AND n_dup_lines / n_lines <= 0.5 END AS kept FROM b"""
