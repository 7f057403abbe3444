"""Scalar text functions as Spark Column expressions (T1, T4, T6-T8, X7,
P1, P2, P4, P7, P10, P13-P16, P19).

Everything here is a built-in expression (regex, array and string
functions), so it runs inside whole-stage codegen with no Python worker.
The regexes are written for the JVM engine so that they give the same
matches as Python's ``re`` on ``str`` patterns:

* Python's ``\\s`` is Unicode-aware; Java's is ASCII unless ``(?U)``, and
  even ``(?U)`` misses U+001C..U+001F. We spell the set out (``WS``).
* Python's ``\\w`` is ``[\\p{L}\\p{N}_]``; word boundaries are replaced by
  explicit run matching (``WORD``), which is also what the DuckDB twins use.
* Python's ``.`` stops only at ``\\n``; Java needs ``(?d)`` for that.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# ---------------------------------------------------------------------------
# Fixed values that must equal the reference's behaviour.

# Characters for which Python's str.isspace() is true (= what `\s` matches).
WS = (r"\t\n\x0b\x0c\r\x1c-\x1f \x{85}\x{a0}\x{1680}\x{2000}-\x{200a}"
      r"\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}")
# Python's `\w` for str patterns.
WORD = r"\p{L}\p{N}_"
IDENT = r"[a-zA-Z_][a-zA-Z_0-9]*"

# Docstring tokeniser. Same alternation as the reference's pattern, with
# `{` escaped for the JVM and `\s` spelled out. In the first class the
# reference writes `+-/`, a range covering `+ , - . /`.
DOCSTRING_TOKEN_RE = (
    r"[^" + WS + r",'\"`.():\[\]=*;>{\}+-/\\]+|\\+|\.+|\(\)|\{\}|\[\]|\(+|\)+|:+|\[+|\]+"
    r"|\{+|\}+|=+|\*+|;+|>+|\++|-+|/+"
)

# Function / class names in a patch. `.` must not cross a newline.
PATCH_DEF_RE = r"(?d)[" + WS + r"]*def[" + WS + r"]+(" + IDENT + r")[" + WS + r"]*\(.*\):"
PATCH_CLASS_RE = r"(?d)[" + WS + r"]*class[" + WS + r"]+(" + IDENT + r")[" + WS + r"]*\(.*\):"

# T4 pieces: a maximal word run, and a `name: type` phrase whose two names
# are whole word runs. The leading group consumes one non-word character
# (or the start), which stands in for `\b` without look-behind.
WORD_RUN_RE = r"[" + WORD + r"]+"
TYPE_PHRASE_RE = (r"(?:^|[^" + WORD + r"])(" + IDENT + r"[" + WS + r"]*:[" + WS + r"]*[" + WORD
                  + r"]+)")
IDENT_FULL_RE = r"^" + IDENT + r"$"
TYPE_FULL_RE = r"^" + IDENT + r"[" + WS + r"]*:[" + WS + r"]*" + IDENT + r"$"

# Line boundaries of Python's str.splitlines().
LINE_BREAK_RE = r"\r\n|[\n\r\x0b\x0c\x1c\x1d\x1e\x{85}\x{2028}\x{2029}]"

# Function filter patterns (searched, not anchored).
SKIP_NAME_RE = r"(__.+__)|(.*test.*)|(.*Test.*)"
SKIP_CODE_RE = r"NotImplementedException|@abstractmethod"

# P10: paths excluded from tag indexes.
EXCLUDED_PATH_RE = r"(\.test\.py$)|(\.spec\.py$)|(\.pyc$)|(^|/)test[^/]*/|(^|/)env(/|$)"

# Default English stop words for keyword extraction (the reference loads a
# file that is not part of it; this list is a parameter).
STOP_WORDS = (
    "a about above after again against all am an and any are as at be because been before "
    "being below between both but by can did do does doing down during each few for from "
    "further had has have having he her here hers herself him himself his how i if in into "
    "is it its itself just me more most my myself no nor not now of off on once only or "
    "other our ours ourselves out over own same she should so some such than that the "
    "their theirs them themselves then there these they this those through to too under "
    "until up very was we were what when where which while who whom why will with you your "
    "yours yourself yourselves"
).split()


def _c(col) -> Column:
    return F.col(col) if isinstance(col, str) else col


# ---------------------------------------------------------------------------
# T1 / T3

def docstring_tokens(col) -> Column:
    """All regex tokens of a text, in order (array<string>)."""
    return F.regexp_extract_all(_c(col), F.lit(DOCSTRING_TOKEN_RE), 0)


def comment_tokens(col) -> Column:
    """Tokens of a comment after its leading ``#``."""
    return docstring_tokens(F.regexp_replace(_c(col), r"^#", ""))


# ---------------------------------------------------------------------------
# T4 / T6

# JVM forms with look-arounds: one regex pass, no per-element filter. They
# give the same matches as the run-and-filter forms above (which DuckDB,
# lacking look-arounds, uses): an identifier must be a whole word run.
_NOT_WORD_BEFORE = r"(?<![" + WORD + r"])"
_NOT_WORD_AFTER = r"(?![" + WORD + r"])"
IDENT_WORD_RE = _NOT_WORD_BEFORE + IDENT + _NOT_WORD_AFTER
TYPE_WORD_RE = (_NOT_WORD_BEFORE + IDENT + r"[" + WS + r"]*:[" + WS + r"]*" + IDENT
                + _NOT_WORD_AFTER)


def identifiers(col) -> Column:
    """Whole word runs that are ASCII identifiers (Python ``\\b..\\b``)."""
    return F.regexp_extract_all(_c(col), F.lit(IDENT_WORD_RE), 0)


def type_phrases(col) -> Column:
    """``name: type`` phrases whose two names are whole identifier runs."""
    return F.regexp_extract_all(_c(col), F.lit(TYPE_WORD_RE), 0)


def keywords(col, stop_words: list[str] | None = None, min_length: int = 3) -> Column:
    """T4: distinct keywords of a text, sorted.

    identifiers + ``x: y`` phrases (+ def/class names, which are always
    identifiers already, so they add nothing to the set and are not
    extracted twice); length >= ``min_length``; stop words compared
    lower-cased.
    """
    stops = STOP_WORDS if stop_words is None else list(stop_words)
    words = F.array_distinct(F.concat(identifiers(col), type_phrases(col)))
    kept = F.filter(words, lambda w: (F.length(w) >= min_length) & ~F.lower(w).isin(stops))
    return F.array_sort(kept)


# ---------------------------------------------------------------------------
# T8 / split helpers

def split_hash(repo, path) -> Column:
    """md5("repo:path") modulo 2**16 (= its last four hex digits)."""
    digest = F.md5(F.concat_ws(":", _c(repo), _c(path)))
    return F.conv(F.substring(digest, 29, 4), 16, 10).cast("int")


def seeded_unit(seed: str, key) -> Column:
    """A repeatable uniform number in [0, 1) from md5(seed || key)."""
    digest = F.md5(F.concat(F.lit(str(seed)), _c(key).cast("string")))
    return F.conv(F.substring(digest, 26, 7), 16, 10).cast("double") / float(16 ** 7)


# ---------------------------------------------------------------------------
# X7 / P1 / P2 / P7 / P13

def patch_functions(col) -> Column:
    """Function names defined on any line of a patch, in order."""
    return F.regexp_extract_all(_c(col), F.lit(PATCH_DEF_RE), 1)


def patch_classes(col) -> Column:
    """Class names (with a parenthesised base list) in a patch."""
    return F.regexp_extract_all(_c(col), F.lit(PATCH_CLASS_RE), 1)


def patch_label(col) -> Column:
    """X7 as one struct<functions, classes>."""
    return F.struct(patch_functions(col).alias("functions"), patch_classes(col).alias("classes"))


def split_repo_path(col):
    """``"repo path"`` -> (repo, path) on the first whitespace run."""
    parts = F.split(F.trim(_c(col)), r"\s+")
    return parts.getItem(0), parts.getItem(1)


def save_path(repo, base_commit) -> Column:
    """Last segment of the repo name + '_' + base commit."""
    return F.concat(F.element_at(F.split(_c(repo), "/"), -1), F.lit("_"), _c(base_commit))


def definition_url(base: str, save_path_col, name_col) -> Column:
    """Base + save_path + '#' + name."""
    return F.concat(F.lit(base), _c(save_path_col), F.lit("#"), _c(name_col))


LABEL_SCHEMA = "array<array<string>>"


def parse_label(col) -> Column:
    """Label text ``(['f', 'g'], ['C'])`` or ``[[..],[..]]`` -> struct.

    Python literal quoting is normalised to JSON first; a missing or
    unreadable list becomes an empty array.
    """
    text = F.trim(_c(col))
    text = F.regexp_replace(text, r"^\(", "[")
    text = F.regexp_replace(text, r"\)$", "]")
    text = F.regexp_replace(text, r"'", '"')
    parsed = F.from_json(text, LABEL_SCHEMA)
    empty = F.array().cast("array<string>")
    return F.struct(F.coalesce(F.element_at(parsed, 1), empty).alias("functions"),
                    F.coalesce(F.element_at(parsed, 2), empty).alias("classes"))


# ---------------------------------------------------------------------------
# P4 / P10 / P14 / P15 / P16 / P19

def keep_function(name_col, code_col, docstring_col, require_docstring: bool = True) -> Column:
    """True when a function passes the reference's quality filter."""
    name, code, doc = _c(name_col), _c(code_col), _c(docstring_col)
    drop = (name.rlike(SKIP_NAME_RE)
            | code.rlike(SKIP_CODE_RE)
            | (F.size(F.split(code, "\n", -1)) <= 2))
    if require_docstring:
        words = F.size(F.filter(F.split(F.trim(doc), "[" + WS + "]+"), lambda w: w != ""))
        drop = drop | (words <= 2)
    return ~drop


def exclude_test_paths(path_col) -> Column:
    """P10: True for paths kept in a tag index."""
    return ~_c(path_col).rlike(EXCLUDED_PATH_RE)


def unindent(code_col, indent_col) -> Column:
    """Remove ``indent`` from each line; lines without it are dropped."""
    code, indent = _c(code_col), _c(indent_col)
    # str.splitlines(): these boundaries, no empty piece after a final one.
    code = F.regexp_replace(code, "(?:" + LINE_BREAK_RE + r")\z", "")
    lines = F.split(code, LINE_BREAK_RE)
    kept = F.filter(lines, lambda ln: ln.startswith(indent))
    return F.array_join(F.transform(kept, lambda ln: F.substring(ln, F.length(indent) + 1, 1 << 30)), "\n")


def docstring_head(col, mode: str = "reference") -> Column:
    """Docstring 'first paragraph'. ``reference`` keeps the whole text
    (the reference splits on a literal that never occurs); ``paragraph``
    cuts at the first blank line."""
    if mode == "reference":
        return _c(col)
    return F.element_at(F.split(_c(col), r"\n[" + WS + r"]*\n"), 1)


def collapse_ws(col) -> Column:
    """Whitespace runs -> one space, trimmed."""
    return F.trim(F.regexp_replace(_c(col), "[" + WS + "]+", " "))


def list_len(col) -> Column:
    """Array length with null -> 0."""
    return F.when(_c(col).isNull(), F.lit(0)).otherwise(F.size(_c(col)))
