"""Python files of either grammar.

The standard parser reads the current grammar. A file that it refuses is
rewritten, token by token, from the older grammar (statements ``print`` and
``exec``, ``raise E, m``, ``except E, e``, back quotes, ``<>``, old numbers
and string prefixes, parameters in brackets, tabs that reach to multiples of
eight) and read again. No line is added or taken away, and every token knows
where it stood, so all texts are cut from the file as it is.

``recover`` reads what it can of a file that neither grammar accepts: the
file is cut before every definition that begins a line at its own level, and
the pieces are read by themselves; a class that fails is cut again.
"""

from __future__ import annotations

import ast
import bisect
import re
from collections.abc import Iterator

_LINE = re.compile(r"[^\r\n]*(?:\r\n|\r|\n)|[^\r\n]+\Z")

# Tokens of both grammars (fixed values of the language).
TOKEN = re.compile(
    r"(?P<space>[ \t\f]+|\\(?:\r\n|\r|\n))|(?P<comment>#[^\r\n]*)|(?P<line>\r\n|\r|\n)"
    r"|(?P<string>[uUbBrRfF]{0,3}(?:'''(?:\\.|[^\\])*?'''|\"\"\"(?:\\.|[^\\])*?\"\"\"|'(?:\\.|[^'\\\r\n])*'|\"(?:\\.|[^\"\\\r\n])*\"))"
    r"|(?P<number>0[xXbBoO][\da-fA-F_]+[lL]?|(?:\d[\d_]*\.?[\d_]*|\.\d[\d_]*)(?:[eE][+-]?\d+)?[jJlL]?)|(?P<word>[^\W\d]\w*)"
    r"|(?P<sign>\*\*=|//=|>>=|<<=|\.\.\.|<>|!=|==|<=|>=|->|:=|\*\*|//|>>|<<|[-+*/%@&|^]=|.)", re.S)


class Token:
    __slots__ = ("kind", "text", "start", "now")

    def __init__(self, kind: str, text: str, start: int):
        self.kind, self.text, self.start = kind, text, start
        self.now = text  # what stands there in the current grammar


def tokens_of(text: str) -> list[Token]:
    return [Token(m.lastgroup, m.group(), m.start()) for m in TOKEN.finditer(text)]


def _statements(tokens: list[Token]) -> Iterator[list[Token]]:
    """The tokens of each simple statement or header, without space and comments."""
    depth, own = 0, []
    for t in tokens:
        if t.kind in ("space", "comment"):
            continue
        if t.kind == "line":
            if not depth and own:
                yield own
                own = []
            continue
        own.append(t)
        if t.kind == "sign":
            depth += (t.text in "([{") - (t.text in ")]}")
            depth = max(depth, 0)
            if not depth and t.text in (";", ":"):
                yield own
                own = []
    if own:
        yield own


def _top_commas(own: list[Token]) -> list[Token]:
    depth, out = 0, []
    for t in own:
        if t.kind == "sign":
            depth += (t.text in "([{") - (t.text in ")]}")
            if t.text == "," and not depth:
                out.append(t)
    return out


def _wrap(first: Token, last: Token) -> None:
    first.now = "(" + first.now
    last.now = last.now + ")"


def _modernise(tokens: list[Token]) -> None:
    quoted = False
    for t in tokens:
        if t.kind == "sign" and t.text == "`":
            quoted = not quoted
            t.now = "(" if quoted else ")"
        elif t.kind == "sign" and t.text == "<>":
            t.now = "!="
        elif t.kind == "number":
            t.now = t.text.rstrip("lL")
            if re.fullmatch(r"0[0-7]+", t.now) and t.now.strip("0"):
                t.now = "0o" + t.now
        elif t.kind == "string" and t.text[:2].lower() == "ur":
            t.now = t.text[1:]
        elif t.kind == "word" and t.text in ("async", "await", "nonlocal"):
            t.now = t.text + "_"
    for own in _statements(tokens):
        word, body = own[0].text, own[1:-1] if own[-1].text in (";", ":") and own[-1].kind == "sign" else own[1:]
        if own[0].kind != "word":
            continue
        if word in ("print", "exec"):
            if not body:
                own[0].now = word if word == "exec" else "print()"
            elif body[0].text not in ("=", ".", ",", ")"):
                if body[0].text == ">>":
                    body[0].now = ""
                _wrap(body[0], body[-1])
        elif word == "raise" and _top_commas(body):
            _wrap(body[0], body[-1])
        elif word == "except" and (commas := _top_commas(body)):
            commas[0].now = " as "
        for k, t in enumerate(own):
            if t.kind == "word" and t.text in ("def", "lambda"):
                _flatten(own, k + (2 if t.text == "def" else 1), t.text == "lambda")


def _flatten(own: list[Token], k: int, is_lambda: bool) -> None:
    """Drop the brackets around parameters, of those that begin at ``k``."""
    depth = 1 if is_lambda else 0
    held: list[Token] = []
    for before, t in zip(own[k - 1:], own[k:]):
        if t.kind != "sign":
            continue
        if t.text in "([{":
            depth += 1
            names = t.text == "(" and depth > 1 and (before.text in (",", "(") or is_lambda and before.text == "lambda")
            held.append(t if names else None)
            t.now = "" if names else t.now
        elif t.text in ")]}":
            depth -= 1
            if held and held.pop() is not None:
                t.now = ""
            if not depth:
                return
        elif t.text == ":" and is_lambda and depth == 1:
            return


class Source:
    """One file, its tree, and the texts of the tree's nodes. ``tree`` is None
    if neither grammar accepts the file; ``error`` then says why."""

    def __init__(self, text: str):
        self.text = text
        self.lines = _LINE.findall(text)
        self.starts, at = [], 0
        for line in self.lines:
            self.starts.append(at)
            at += len(line)
        self.old = False
        self.error = None
        self.tree = self._parse(text)
        if self.tree is None:
            self._parse_old()

    def _parse(self, text: str):
        try:
            return ast.parse(text)
        except (SyntaxError, ValueError, RecursionError, MemoryError) as e:
            self.error = self.error or f"{type(e).__name__}: {e}"
            return None

    def _parse_old(self) -> None:
        tokens = tokens_of(self.text)
        _modernise(tokens)
        first = True
        for t in tokens:  # leading space, as the older grammar counts it
            if t.kind == "space" and first and "\t" in t.text:
                t.now = t.text.replace("\f", "").expandtabs(8)
            first = t.kind == "line"
        text = "".join(t.now for t in tokens)
        if text == self.text or (tree := self._parse(text)) is None:
            return
        self.tree, self.old, self.error = tree, True, None
        self.new_lines = _LINE.findall(text)
        self.new_starts, at = [], 0
        for line in self.new_lines:
            self.new_starts.append(at)
            at += len(line)
        self.begins, self.ends, at = {}, {}, 0
        for t in tokens:
            if t.now:
                inner = len(t.now) - len(t.now.lstrip("(")) if t.text != "(" and t.kind != "sign" else 0
                self.begins[at + inner] = self.begins[at] = t.start
                at += len(t.now)
                outer = 1 if t.now.endswith(")") and not t.text.endswith(")") else 0
                self.ends[at - outer] = self.ends[at] = t.start + len(t.text)

    def place(self, line: int, column: int, end: bool = False) -> int:
        """Where a node's position (line from 1, column in UTF-8 bytes) stands in the file."""
        lines, starts = (self.new_lines, self.new_starts) if self.old else (self.lines, self.starts)
        own = lines[line - 1]
        at = starts[line - 1] + (column if own.isascii() else len(own.encode("utf-8")[:column].decode("utf-8", "replace")))
        if not self.old:
            return at
        return (self.ends if end else self.begins).get(at, at - self.new_starts[line - 1] + self.starts[line - 1])

    def segment(self, line: int, column: int, end_line: int, end_column: int) -> str:
        return self.text[self.place(line, column):self.place(end_line, end_column, True)]

    def of(self, node) -> str:
        return self.segment(node.lineno, node.col_offset, node.end_lineno, node.end_col_offset)

    def indent(self, line: int) -> str:
        own = self.lines[line - 1]
        return own[:len(own) - len(own.lstrip(" \t\f"))]


_BEGINS = ("def", "class", "async", "@")


def _cuts(text: str, level: str) -> list[int]:
    """Lines (from 0) on which a definition, or its first decorator, begins behind exactly ``level``."""
    cuts, decorated = [], False
    tokens = tokens_of(text)
    starts = [0, *(m.end() for m in re.finditer(r"\r\n|\r|\n", text))]
    line_start = 0
    for k, t in enumerate(tokens):
        if t.kind == "line":
            line_start = t.start + len(t.text)
            continue
        if t.start != line_start + len(level) or t.kind == "space" or text[line_start:t.start] != level:
            continue
        if t.text in _BEGINS:
            if not decorated:
                cuts.append(bisect.bisect_right(starts, line_start) - 1)
            decorated = t.text == "@"
        elif t.kind != "comment":
            decorated = False
    return cuts


def recover(text: str) -> list[tuple[Source, int]]:
    """The sound pieces of a file that does not parse, each with the number of
    lines before it. The methods of a broken class come as pieces of their own."""
    out: list[tuple[Source, int]] = []

    def take(lines: list[str], before: int, level: str, deep: bool) -> None:
        body = "".join(lines)
        cuts = [_lead(lines, k) for k in _cuts(body, level)]
        for a, b in zip(cuts, [*cuts[1:], len(lines)]):
            piece = lines[a:b]
            source = _outdented(piece, level)
            if source.tree is None:  # without the statements behind the definition
                source = _outdented(piece[:_end_of_definition("".join(piece), level)], level)
            if source.tree is not None:
                out.append((source, before + a))
            elif deep and (inner := _inner_level(piece)):
                take(piece[1:], before + a + 1, inner, False)

    take(_LINE.findall(text), 0, "", True)
    return out


def _outdented(lines: list[str], level: str) -> Source:
    return Source("".join(line[len(level):] if line.startswith(level) else line.lstrip(" \t") for line in lines))


def _end_of_definition(text: str, level: str) -> int:
    """The first line behind the definition in ``text`` that begins a statement at its level or above."""
    line, begun, fresh = 0, False, 0
    for t in tokens_of(text):
        if t.kind == "line":
            line, fresh = line + 1, t.start + len(t.text)
        elif t.kind not in ("space", "comment"):
            column = t.start - fresh
            at_level = fresh >= 0 and column <= len(level) and t.kind == "word"
            if begun and at_level:
                return line
            begun = begun or t.text in ("def", "class")
            line += len(_LINE.findall(t.text)) - 1 if t.kind == "string" else 0
            fresh = -1  # the line's first token is behind us
    return line + 1


def _lead(lines: list[str], k: int) -> int:
    """The first of the comment and blank lines directly above line ``k``."""
    while k > 0 and lines[k - 1].strip()[:1] in ("", "#"):
        k -= 1
    return k


def _inner_level(piece: list[str]) -> str:
    """The indent of the first line within a class; nothing for any other piece."""
    head = next((k for k, line in enumerate(piece) if re.match(r"(?:class|def|async)\b", line)), -1)
    if head < 0 or not piece[head].startswith("class"):
        return ""
    for line in piece[head + 1:]:
        if line.strip() and not line.lstrip().startswith("#"):
            return line[:len(line) - len(line.lstrip(" \t"))]
    return ""
