"""Source parsing: functions, definitions, tags and code tokens (X1-X6, X8,
T2, T3, P4, P10, P14, P15).

Parsing a file is per-row work, done with the standard library (``ast``,
``tokenize``) inside ``mapInPandas`` / ``pandas_udf``: Spark partitions the
files, Arrow moves them in batches. Everything that is not parsing --
un-indenting, the quality filter, urls, path filters -- stays in column
expressions. Functions are extracted from Python sources; definitions also
from the five languages of ``grammars.py``, by the suffix of the file.

Semantics kept from the reference:

* ``extract_functions`` (X1): module-level functions (also inside
  if/for/while/try/with blocks), then the methods of module-level classes;
  code runs from the ``def`` line to the end of the function and is
  un-indented by the ``def`` line's indent; the docstring is the raw string
  literal; a file that does not parse yields nothing.
* ``extract_definitions`` (X3-X5): functions and classes in source order;
  the body is the block text without the signature; the walk does not enter
  functions but does enter classes; ``ignore_class_methods`` drops
  functions found below a class.
* ``code_tokens`` (T2/T3): token values of the first top-level function to
  the end of the text, docstring and whitespace skipped, comments tokenised
  separately with the docstring tokeniser; any error gives empty lists.
"""

from __future__ import annotations

import ast
import io
import keyword
import re
import tokenize
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarry.operators import grammars, pysource
from quarry.operators.pysource import Source
from quarry.functions.text import comment_tokens, docstring_head, exclude_test_paths, keep_function, unindent

_WS = re.compile(r"\s+")

_CONTAINERS = (ast.If, ast.For, ast.AsyncFor, ast.While, ast.Try, ast.With, ast.AsyncWith)
if hasattr(ast, "TryStar"):
    _CONTAINERS = _CONTAINERS + (ast.TryStar,)
_FUNCS = (ast.FunctionDef, ast.AsyncFunctionDef)


def _scan(stmts, kinds):
    """Definitions of ``kinds`` among statements, looking through flow blocks
    but not into functions or classes."""
    for node in stmts:
        if isinstance(node, kinds):
            yield node
        elif isinstance(node, _CONTAINERS):
            for field in ("body", "orelse", "finalbody"):
                yield from _scan(getattr(node, field, []) or [], kinds)
            for handler in getattr(node, "handlers", []) or []:
                yield from _scan(handler.body, kinds)


def _docstring(fn):
    """The node of a function's docstring, or None."""
    first = fn.body[0] if fn.body else None
    if (isinstance(first, ast.Expr) and isinstance(first.value, ast.Constant)
            and isinstance(first.value.value, str)):
        return first.value
    return None


def _lead(lines: list[str], fn) -> int:
    """Index of the first of the comment and blank lines directly above a
    ``def`` (below its decorators): they belong to its code."""
    at = fn.lineno - 1
    while at > 0 and lines[at - 1].strip()[:1] in ("", "#"):
        at -= 1
    return at


def _functions_of(source: Source, before: int, module: list) -> list[dict]:
    """The functions of a tree: of the module, then of its classes."""
    defs = list(_scan(module, _FUNCS))
    for cls in _scan(module, (ast.ClassDef,)):
        defs.extend(_scan(cls.body, _FUNCS))
    out = []
    for fn in defs:
        doc = _docstring(fn)
        out.append({"func_name": fn.name, "lineno": fn.lineno + before,
                    "raw_code": "".join(source.lines[_lead(source.lines, fn):fn.end_lineno]),
                    "indent": source.indent(fn.lineno), "docstring": source.of(doc) if doc is not None else ""})
    return out


def parse_functions(content: str, recover: bool = False) -> list[dict]:
    """X1 for one file: raw pieces of each function (no filtering). A file that
    neither grammar accepts has none, or with ``recover`` those of its sound pieces."""
    source = Source(content)
    if source.tree is not None:
        return _functions_of(source, 0, source.tree.body)
    pieces = pysource.recover(content) if recover else []
    return [f for piece, before in pieces for f in _functions_of(piece, before, piece.tree.body)]


FUNCTION_ROW = T.StructType([
    T.StructField("func_name", T.StringType()), T.StructField("lineno", T.IntegerType()),
    T.StructField("raw_code", T.StringType()), T.StructField("indent", T.StringType()),
    T.StructField("docstring", T.StringType()),
])


def extract_functions(blobs: DataFrame, *, require_docstring: bool = True, docstring_mode: str = "reference",
                      content: str = "content", recover: bool = False) -> DataFrame:
    """One row per kept function with
    repo, path, lineno, func_name, language, code, docstring.

    ``blobs`` has repo, path, content. Files without functions vanish (an
    explode, not explode_outer), as in the reference. With ``recover`` a file
    that does not parse gives the functions of its sound pieces.
    """
    keys = [c for c in blobs.columns if c != content]
    schema = T.StructType([blobs.schema[c] for c in keys]
                          + [T.StructField("fn", T.ArrayType(FUNCTION_ROW))])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = pdf[keys].copy()
            out["fn"] = [parse_functions(c, recover) if isinstance(c, str) else [] for c in pdf[content]]
            yield out

    parsed = blobs.mapInPandas(run, schema).select(*keys, F.explode("fn").alias("f"))
    rows = parsed.select(
        *keys, F.col("f.lineno").alias("lineno"), F.col("f.func_name").alias("func_name"),
        F.lit("python").alias("language"),
        unindent(F.col("f.raw_code"), F.col("f.indent")).alias("code"),
        docstring_head(F.col("f.docstring"), docstring_mode).alias("docstring"))
    return rows.where(keep_function("func_name", "code", "docstring", require_docstring))


# ---------------------------------------------------------------------------
# Definitions with bodies.

def _block_text(source: Source, node) -> str:
    first, last = node.body[0], node.body[-1]
    line, column = first.lineno, first.col_offset
    decos = getattr(first, "decorator_list", None) or []
    if decos:
        d = min(decos, key=lambda x: (x.lineno, x.col_offset))
        line, column = d.lineno, d.col_offset - 1  # the '@'
    return source.segment(line, column, last.end_lineno, last.end_col_offset)


def parse_definitions(content: str, ignore_class_methods: bool = False) -> tuple[list[dict], str | None]:
    """X3 for one file: (rows, error)."""
    source = Source(content)
    tree, lines = source.tree, source.lines
    if tree is None:
        return [], source.error
    rows: list[dict] = []

    def start_of(node) -> int:
        decos = getattr(node, "decorator_list", None) or []
        return min([node.lineno] + [d.lineno for d in decos])

    def header(node) -> str:
        return lines[node.lineno - 1].rstrip("\r\n")

    def walk(node, parent_is_class: bool):
        for child in ast.iter_child_nodes(node):
            if isinstance(child, _FUNCS):
                if parent_is_class and ignore_class_methods:
                    continue
                rows.append({"kind": "function", "name": child.name, "body": _block_text(source, child),
                             "start_line": start_of(child), "end_line": child.end_lineno,
                             "header": header(child)})
            elif isinstance(child, ast.ClassDef):
                rows.append({"kind": "class", "name": child.name, "body": _block_text(source, child),
                             "start_line": start_of(child), "end_line": child.end_lineno,
                             "header": header(child)})
                walk(child, True)
            else:
                walk(child, parent_is_class)

    try:
        walk(tree, False)
    except Exception as e:  # noqa: BLE001
        return [], f"{type(e).__name__}: {e}"
    rows.sort(key=lambda r: (r["start_line"], r["kind"] != "class"))
    return rows, None


DEFINITION_ROW = T.StructType([
    T.StructField("kind", T.StringType()), T.StructField("name", T.StringType()),
    T.StructField("body", T.StringType()), T.StructField("start_line", T.IntegerType()),
    T.StructField("end_line", T.IntegerType()), T.StructField("header", T.StringType()),
])


def definitions_of(content: str | None, path: str | None, ignore_class_methods: bool) -> tuple[list[dict], str | None]:
    """(rows, error) of one file in the language of its suffix (Python without a path)."""
    if not isinstance(content, str):
        return [], None
    language = "python" if path is None else grammars.LANGUAGE_OF.get(path[path.rfind("."):] if "." in path else "")
    if language is None:
        return [], None
    if language == "python":
        return parse_definitions(content, ignore_class_methods)
    return grammars.parse_definitions(content, language, ignore_class_methods)


def language_of(path) -> Column:
    """The language of a file by its suffix, null for any other file."""
    suffix = F.regexp_extract(path, r"(\.[A-Za-z]+)$", 1)
    return F.create_map(*[F.lit(x) for pair in grammars.LANGUAGE_OF.items() for x in pair])[suffix]


def extract_definitions(sources: DataFrame, *, ignore_class_methods: bool = False, content: str = "content",
                        with_errors: bool = False, path: str | None = None) -> DataFrame:
    """One row per function or class: <source keys>, kind, name,
    body, start_line, end_line, header. With ``path``, the column that holds
    the file's name, every file is read in the language of its suffix (files
    of other kinds give no rows); without it all files are Python. With
    ``with_errors`` a file that fails to parse gives one row with null kind
    and the message in ``error``."""
    keys = [c for c in sources.columns if c != content]
    schema = T.StructType([sources.schema[c] for c in keys]
                          + [T.StructField("defs", T.ArrayType(DEFINITION_ROW)),
                             T.StructField("error", T.StringType())])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = pdf[keys].copy()
            defs, errors = [], []
            for c, p in zip(pdf[content], pdf[path].fillna("") if path else [None] * len(pdf)):
                rows, err = definitions_of(c, p, ignore_class_methods)
                defs.append(rows)
                errors.append(err)
            out["defs"] = defs
            out["error"] = errors
            yield out

    parsed = sources.mapInPandas(run, schema)
    rows = parsed.select(*keys, F.explode("defs").alias("d"), F.lit(None).cast("string").alias("error")) \
        .select(*keys, "d.*", "error")
    if with_errors:
        errs = parsed.where(F.col("error").isNotNull()).select(
            *keys, *[F.lit(None).cast(f.dataType).alias(f.name) for f in DEFINITION_ROW.fields], "error")
        rows = rows.unionByName(errs)
    return rows if with_errors else rows.drop("error")


def build_tags(sources: DataFrame, *, path: str = "file", content: str = "content") -> DataFrame:
    """Tag index of source files: one row per definition with name,
    kind, line, end and ctags-style ``pattern`` (its first source line);
    test and environment paths are excluded first (P10)."""
    kept = sources.where(exclude_test_paths(path))
    defs = extract_definitions(kept, content=content)
    return defs.select(
        *[c for c in kept.columns if c != content], "kind", "name",
        F.col("start_line").alias("line"), F.col("end_line").alias("end"),
        F.concat(F.lit("/^"), F.col("header"), F.lit("$/")).alias("pattern"))


# ---------------------------------------------------------------------------
# Code tokens.

def _code_tokens(source: Source) -> Iterator[tuple[str, str, int]]:
    """(kind, text, place) of the tokens that are no white space."""
    if source.old:
        for t in pysource.tokens_of(source.text):
            if t.kind not in ("space", "line"):
                yield t.kind, t.text, t.start
        return
    kinds = {tokenize.COMMENT: "comment", tokenize.STRING: "string", tokenize.NAME: "word"}
    skip = (tokenize.NL, tokenize.NEWLINE, tokenize.INDENT, tokenize.DEDENT, tokenize.ENDMARKER)
    for tok in tokenize.generate_tokens(io.StringIO(source.text).readline):
        if tok.type not in skip and tok.string and not _WS.match(tok.string):
            yield kinds.get(tok.type, "sign"), tok.string, source.starts[tok.start[0] - 1] + tok.start[1]


class _Known(dict):
    """What was found of the last codes, some characters of them at most: a
    batch is tokenised once, however many forms of its tokens are asked for."""

    LIMIT = 4 << 20

    def __init__(self):
        super().__init__()
        self.chars = 0

    def add(self, code: str, found: tuple) -> tuple:
        if self.chars > self.LIMIT:
            self.clear()
            self.chars = 0
        self.chars += len(code)
        self[code] = found
        return found


_SCANNED = _Known()


def _scanned(code: str) -> tuple:
    """(whether of the older grammar, None if it does not parse; places of the
    first function and its docstring, None without a function; tokens;
    whether they cannot be told)."""
    try:
        source = Source(code)
        if source.tree is None:
            return None, None, (), True
        fns, first = list(_scan(source.tree.body, _FUNCS)), None
        if fns:
            doc = _docstring(fns[0])
            first = (source.place(fns[0].lineno, fns[0].col_offset), source.place(doc.lineno, doc.col_offset) if doc is not None else -1)
        return bool(source.old), first, tuple(_code_tokens(source)), False
    except Exception:  # noqa: BLE001 - reference: any error -> empty lists
        return None, None, (), True


def tokenize_code(code: str, func_only: bool = True, only_ids: bool = False,
                  add_keywords: bool = True) -> tuple[list[str], list[str]]:
    """Token values and whole comments of one function (see module docstring)."""
    try:
        known = _SCANNED.get(code)
        if known is None:
            known = _SCANNED.add(code, _scanned(code))
        old, first, tokens, failed = known
        if old is None or func_only and first is None:
            return [], []
        start, doc_at = first if func_only else (0, -1)
        if failed:
            return [], []
        code_tokens, comments = [], []
        old_words = {"print", "exec"} if old else set()
        for kind, text, at in tokens:
            if at < start:
                continue
            if kind == "comment":
                comments.append(text)
                continue
            if kind == "string" and at == doc_at:
                continue
            is_kw = kind == "word" and (keyword.iskeyword(text) or text in old_words)
            if only_ids:
                if kind == "word" and not is_kw:
                    code_tokens.append(text)
            elif is_kw:
                if add_keywords:
                    code_tokens.append(text)
            else:
                code_tokens.append(text)
        return code_tokens, comments
    except Exception:  # noqa: BLE001 - reference: any error -> empty lists
        return [], []


CODE_TOKENS = T.StructType([T.StructField("code_tokens", T.ArrayType(T.StringType())),
                            T.StructField("comments", T.ArrayType(T.StringType()))])


def code_tokens(col, func_only: bool = True, only_ids: bool = False, add_keywords: bool = True):
    """struct<code_tokens, comment_tokens>. The worker only tokenises;
    the words of the comments are cut by the column form of T3."""

    @F.pandas_udf(CODE_TOKENS)
    def tok(codes: pd.Series) -> pd.DataFrame:
        both = [tokenize_code(c, func_only, only_ids, add_keywords) if isinstance(c, str) else ([], []) for c in codes]
        return pd.DataFrame({"code_tokens": [a for a, _ in both], "comments": [b for _, b in both]})

    raw = tok(F.col(col) if isinstance(col, str) else col)
    words = F.flatten(F.transform(raw["comments"], lambda c: comment_tokens(c)))
    return F.struct(raw["code_tokens"].alias("code_tokens"), words.alias("comment_tokens"))
