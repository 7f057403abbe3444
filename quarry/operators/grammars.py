"""Definitions in files of the languages that the standard parser does not
read (X3, X5): Go, Java, PHP, Ruby and JavaScript.

``GRAMMARS`` is a table: per language the tokens that hold no code (comments,
strings, patterns), and which words begin functions and classes. One lexer
reads it. Over its tokens an island parser keeps a stack of open blocks and
looks only at what may begin a definition there; the rest is passed over.

What is found, in all five languages:

* functions with a name and a body: also methods, constructors and Go methods;
* classes: also interfaces, traits, enums, records, structs and modules;
* like the Python walk, a function is not entered, a class and every other
  block is; ``ignore_class_methods`` drops functions that stand in a class;
* the body is the block with its braces; in Ruby the text between the
  signature and ``end``, without the white space around it;
* a definition starts at its first modifier or annotation.

A file whose blocks, strings or comments do not close is an error and gives
no rows. Time is linear in the length of the file.
"""

from __future__ import annotations

import bisect
import re
from dataclasses import dataclass, field

OPEN, CLOSE = "([{", ")]}"
PAIR = dict(zip(CLOSE, OPEN))


@dataclass(frozen=True)
class Grammar:
    suffix: str
    quiet: str                       # pattern of comments
    text: str                        # pattern of strings and other literals, one token each
    word: str = r"[^\W\d]\w*"
    functions: frozenset = frozenset()
    classes: frozenset = frozenset()
    methods: bool = False            # a name, parameters and a block in a class are a method
    modifiers: frozenset = frozenset()
    divides: bool = True             # a slash is never a pattern
    keywords: frozenset = field(default_factory=frozenset)  # words before which a slash begins a pattern


_SINGLE = r"'(?:\\.|[^'\\\n])*'"
_DOUBLE = r'"(?:\\.|[^"\\\n])*"'
_C_COMMENTS = r"//[^\n]*|/\*.*?\*/"


def _set(words: str) -> frozenset:
    return frozenset(words.split())


# Words and comment and string forms of the languages (fixed values of the languages).
GRAMMARS = {
    "go": Grammar(".go", _C_COMMENTS, rf"`[^`]*`|{_DOUBLE}|{_SINGLE}", functions=_set("func"), classes=_set("struct interface")),
    "java": Grammar(".java", _C_COMMENTS, rf'"""(?:\\.|.)*?"""|{_DOUBLE}|{_SINGLE}', word=r"[^\W\d$][\w$]*|\$[\w$]*",
                    classes=_set("class interface enum record"), methods=True),
    "php": Grammar(".php", r"//(?:(?!\?>)[^\n])*|#(?!\[)(?:(?!\?>)[^\n])*|/\*.*?\*/",
                   r"'(?:\\.|[^'\\])*'" r'|"(?:\\.|\{\$(?:[^}"\']|"[^"]*"|\'[^\']*\')*\}|[^"\\])*"' r"|`[^`]*`"
                   r"|<<<[ \t]*(?P<here>[\"']?)(?P<id>[^\W\d]\w*)(?P=here)\r?\n.*?^[ \t]*(?P=id)\b",
                   word=r"\$?[^\W\d]\w*", functions=_set("function"), classes=_set("class interface trait enum")),
    "javascript": Grammar(".js", _C_COMMENTS, rf"{_DOUBLE}|{_SINGLE}", word=r"[#]?(?:[^\W\d]|\$)[\w$]*",
                          functions=_set("function"), classes=_set("class"), methods=True, divides=False,
                          modifiers=_set("export default async static get set"),
                          keywords=_set("return typeof case in of delete void throw new do else instanceof yield await")),
    "ruby": Grammar(".rb", r"#[^\n]*|^=begin\b.*?^=end\b[^\n]*|^__END__$.*",
                    r'"(?:\\.|#\{(?:[^{}]|\{[^{}]*\})*\}|[^"\\])*"' r"|'(?:\\.|[^'\\])*'" r"|`(?:\\.|[^`\\])*`"
                    r"|:\"(?:\\.|[^\"\\])*\"|(?<![:\w]):[^\W\d]\w*[?!=]?(?![:\w])|\?\w(?!\w)"
                    r"|%[wWiIqQrx]?(?:\((?:\\.|[^()\\]|\([^()]*\))*\)|\[(?:\\.|[^\[\]\\])*\]|\{(?:\\.|[^{}\\]|\{[^{}]*\})*\}|\|[^|]*\||![^!\n]*!)\w*",
                    word=r"[$@]{0,2}[^\W\d]\w*[?!]?", functions=_set("def"), classes=_set("class module"), divides=False,
                    keywords=_set("return if unless while until and or not when then else elsif in puts yield case")),
}
LANGUAGE_OF = {g.suffix: name for name, g in GRAMMARS.items()} | {".py": "python"}

_PATTERN = re.compile(r"/(?:\\.|\[(?:\\.|[^\]\\\n])*\]|[^/\\\[\n])+/\w*")
_RUBY_HERE = re.compile(r"<<([~-]?)([\"'`]?)([A-Z_]\w*)\2")


class BrokenSource(ValueError):
    pass


class Token:
    __slots__ = ("text", "start", "end", "kind", "match")

    def __init__(self, text: str, start: int, end: int, kind: str):
        self.text, self.start, self.end, self.kind = text, start, end, kind  # kind: word, text, sign
        self.match = -1  # of a bracket: the index of its partner


_MASTER: dict[str, re.Pattern] = {}


def _master(language: str) -> re.Pattern:
    if language not in _MASTER:
        g = GRAMMARS[language]
        _MASTER[language] = re.compile(rf"(?P<space>\s+)|(?P<quiet>{g.quiet})|(?P<text>{g.text})|(?P<word>{g.word})"
                                       r"|(?P<number>\d[\w.]*)|(?P<sign>.)", re.S | re.M)
    return _MASTER[language]


def lex(src: str, language: str, at: int = 0, nested: bool = False) -> tuple[list[Token], int]:
    """Tokens of code from ``at`` on, and where reading ended: at the end, or,
    if ``nested``, at the brace that closes the code around it."""
    g, master = GRAMMARS[language], _master(language)
    tokens: list[Token] = []
    depth, n = 0, len(src)
    here: list[tuple[str, bool]] = []  # Ruby texts that begin on the next line
    if language == "php" and not nested:
        at = _php_code(src, 0)
    while at < n:
        m = master.match(src, at)
        kind, text, start = m.lastgroup, m.group(), at
        if m.group("text") is not None:
            kind = "text"
        at = m.end()
        if kind in ("space", "quiet"):
            if here and "\n" in text:
                at = _after_here(src, start + text.index("\n") + 1, here)
            continue
        if kind == "number":
            kind = "text"
        elif kind == "sign":
            if language == "php" and src.startswith("?>", start):
                tokens.append(Token(";", start, start + 2, "sign"))
                at = _php_code(src, start + 2)
                continue
            if text == "`" and language == "javascript":
                kind, at = "text", _template_end(src, at)
            elif text == "/" and not g.divides and _begins_pattern(tokens, g):
                pattern = _PATTERN.match(src, start)
                if pattern:
                    kind, at = "text", pattern.end()
            elif text == "<" and language == "ruby" and (found := _RUBY_HERE.match(src, start)):
                here.append((found.group(3), bool(found.group(1))))
                kind, at = "text", found.end()
            elif text in "\"'`" or src.startswith("/*", start):
                raise BrokenSource(f"unclosed text at {start}")
            elif nested and text == "{":
                depth += 1
            elif nested and text == "}":
                if not depth:
                    return tokens, start
                depth -= 1
        tokens.append(Token(src[start:at], start, at, kind))
    return tokens, n


def _php_code(src: str, at: int) -> int:
    m = re.compile(r"<\?(?:php\b|=)?").search(src, at)
    return m.end() if m else len(src)


def _begins_pattern(tokens: list[Token], g: Grammar) -> bool:
    if not tokens:
        return True
    last = tokens[-1]
    return last.text in g.keywords if last.kind == "word" else last.kind == "sign" and last.text not in ")]}"


def _template_end(src: str, at: int) -> int:
    """Behind the back quote that ends a template; code within it is read as code."""
    while at < len(src):
        c = src[at]
        if c == "\\":
            at += 2
        elif c == "`":
            return at + 1
        elif src.startswith("${", at):
            at = lex(src, "javascript", at + 2, nested=True)[1] + 1
        else:
            at += 1
    raise BrokenSource("unclosed template")


def _after_here(src: str, at: int, here: list[tuple[str, bool]]) -> int:
    """Behind the texts that begin at the line ``at``; their list is used up."""
    while here:
        name, indented = here.pop(0)
        end = re.compile(rf"^{'[ \t]*' if indented else ''}{name}\r?$", re.M).search(src, at)
        if not end:
            raise BrokenSource(f"unclosed text {name}")
        at = end.end()
    return at


class Finder:
    """Definitions of one file."""

    def __init__(self, src: str, language: str, ignore_class_methods: bool):
        self.src, self.language, self.g = src, language, GRAMMARS[language]
        self.ignore = ignore_class_methods
        self.tokens, _ = lex(src, language)
        self.lines = [0, *(m.end() for m in re.finditer("\n", src))]
        self.rows: list[dict] = []

    def line(self, at: int) -> int:
        return bisect.bisect_right(self.lines, at)

    def text(self, k: int) -> str:
        return self.tokens[k].text if 0 <= k < len(self.tokens) else ""

    def is_word(self, k: int) -> bool:
        return 0 <= k < len(self.tokens) and self.tokens[k].kind == "word"

    def emit(self, kind: str, name: int, first: int, body: tuple[int, int], end: int) -> None:
        at = self.tokens[name].start
        line = self.line(at)
        stop = self.src.find("\n", at)
        header = self.src[self.lines[line - 1]:stop if stop >= 0 else len(self.src)].rstrip("\r")
        self.rows.append({"kind": kind, "name": self.text(name), "body": self.src[body[0]:body[1]],
                          "start_line": self.line(self.tokens[first].start), "end_line": self.line(end - 1), "header": header})

    # --- languages with braces ---------------------------------------------------------

    def pair_brackets(self) -> None:
        open_at: list[int] = []
        for k, t in enumerate(self.tokens):
            if t.kind != "sign":
                continue
            if t.text in OPEN:
                open_at.append(k)
            elif t.text in CLOSE:
                if not open_at or self.tokens[open_at[-1]].text != PAIR[t.text]:
                    raise BrokenSource(f"unexpected {t.text} in line {self.line(t.start)}")
                t.match = open_at.pop()
                self.tokens[t.match].match = k
        if open_at:
            raise BrokenSource(f"unclosed {self.text(open_at[-1])} in line {self.line(self.tokens[open_at[-1]].start)}")

    def first_of(self, k: int) -> int:
        """Where the definition with its first word at ``k`` starts."""
        if self.language in ("java", "php"):  # behind the last statement or block
            while k > 0 and not (self.tokens[k - 1].kind == "sign" and self.text(k - 1) in ";{}"):
                k = self.tokens[k - 1].match if self.text(k - 1) in ")]" and self.tokens[k - 1].match >= 0 else k - 1
            return k
        while self.text(k - 1) in self.g.modifiers or self.text(k - 1) == "*":
            k -= 1
        return k

    def block_after(self, k: int, stops: str = ";}),=") -> int:
        """The brace that opens the body of a signature that goes on at ``k``; -1 if it has none."""
        while k < len(self.tokens):
            t = self.tokens[k]
            if t.text == "{":
                return k
            # A Go signature ends with its line.
            if t.kind == "sign" and t.text in stops or self.language == "go" and self.breaks_line(k):
                return -1
            if t.kind == "sign" and t.text in "([":
                k = t.match
            elif self.language == "go" and t.text in self.g.classes and self.text(k + 1) == "{":
                k = self.tokens[k + 1].match
            k += 1
        return -1

    def breaks_line(self, k: int) -> bool:
        """Whether a line ends between the token at ``k`` and the one before it."""
        return k > 0 and "\n" in self.src[self.tokens[k - 1].end:self.tokens[k].start]

    def function_at(self, k: int) -> tuple[int, int] | None:
        """(name, opening brace) of a function whose keyword is at ``k``."""
        name = k + 1
        if self.language == "go" and self.text(name) == "(":
            name = self.tokens[name].match + 1
        while self.text(name) in ("*", "&"):
            name += 1
        if not self.is_word(name):
            return None
        args = name + 1
        if self.text(args) == "[" and self.language == "go":
            args = self.tokens[args].match + 1
        if self.text(args) != "(":
            return None
        brace = self.block_after(self.tokens[args].match + 1)
        return (name, brace) if brace >= 0 else None

    def method_at(self, k: int, owner: str) -> tuple[int, int] | None:
        """(name, opening brace) of a method whose name is at ``k`` in a class."""
        if not self.is_word(k) or self.text(k + 1) != "(" or self.text(k - 1) in (".", "new", "@", "="):
            return None
        if self.language == "java":
            before = self.tokens[k - 1]
            if not (before.kind == "word" or before.text in (">", "]") or self.text(k) == owner):
                return None
        brace = self.tokens[k + 1].match + 1
        if self.language == "java" and self.text(brace) == "throws":
            brace = self.block_after(brace, ";}=")
        return (k, brace) if brace >= 0 and self.text(brace) == "{" else None

    def class_at(self, k: int, in_group: bool) -> tuple[int, int] | None:
        """(name, opening brace) of a class whose keyword is at ``k``; ``in_group``: within Go's ``type ( ... )``."""
        if self.language == "go":
            name = k - 1
            if self.text(name) == "]":
                name = self.tokens[name].match - 1
            if self.text(k + 1) != "{" or not self.is_word(name):
                return None
            return (name, k + 1) if self.text(name - 1) == "type" or in_group and (self.text(name - 1) in "(;" or self.breaks_line(name)) else None
        if self.text(k - 1) in (".", "::", ":", "->") or not self.is_word(k + 1) or self.text(k + 1) in ("extends", "implements"):
            return None
        brace = self.block_after(k + 2, ";})=")
        return (k + 1, brace) if brace >= 0 else None

    def braces(self) -> None:
        self.pair_brackets()
        tokens, g = self.tokens, self.g
        owners: list[tuple[int, str | None]] = [(len(tokens), None)]  # open blocks: (end, name of the class or None)
        k, group = 0, -1  # where Go's ``type ( ... )`` ends
        while k < len(tokens):
            while k >= owners[-1][0]:
                owners.pop()
            t = tokens[k]
            owner = owners[-1][1]
            if t.kind == "word":
                if t.text == "type" and self.text(k + 1) == "(" and self.language == "go":
                    group = tokens[k + 1].match
                # A name after a dot or an arrow is a member, whatever it is called.
                member = self.text(k - 1) in (".", ">") and not (self.text(k - 1) == ">" and self.text(k - 2) != "-")
                found = self.function_at(k) if t.text in g.functions and not member else None
                if not found and g.methods and owner is not None:
                    found = self.method_at(k, owner)
                if found:
                    name, brace = found
                    end = tokens[brace].match
                    if not (owner is not None and self.ignore):
                        self.emit("function", name, self.first_of(k), (tokens[brace].start, tokens[end].end), tokens[end].end)
                    k = end + 1
                    continue
                found = self.class_at(k, k < group < owners[-1][0]) if t.text in g.classes and not member else None
                if found:
                    name, brace = found
                    end = tokens[brace].match
                    first = name - (self.text(name - 1) == "type") if self.language == "go" else self.first_of(k)
                    self.emit("class", name, first, (tokens[brace].start, tokens[end].end), tokens[end].end)
                    owners.append((end, self.text(name)))
                    k = brace + 1
                    continue
            elif t.text == "{" and t.kind == "sign":
                # The block behind ``new Name(...)`` is a class without a name.
                nameless = self.language == "java" and self.text(k - 1) == ")" and self._made(tokens[k - 1].match)
                owners.append((t.match, "" if nameless else None))
            k += 1

    def _made(self, k: int) -> bool:
        k -= 1
        while self.is_word(k) and self.text(k) != "new" or self.text(k) in (".", "<", ">", ",", "?"):
            k -= 1
        return self.text(k) == "new"

    # --- Ruby ---------------------------------------------------------------------------

    OPENERS = _set("begin case for do if unless while until")
    MAY_FOLLOW = _set("if unless while until")  # open a block only where a statement begins

    def ends(self) -> None:
        tokens, g = self.tokens, self.g
        open_at: list[tuple[str, dict | None]] = []
        loop_line = -1  # the do of ``while ... do`` opens nothing of its own
        k = 0
        while k < len(tokens):
            t = tokens[k]
            line = self.line(t.start)
            before = tokens[k - 1] if k else None
            begins = before is None or self.line(before.end - 1) < line or before.text in (";", "=", "(", "[", "{", "|", "then", "do", "else",
                                                                                         "return", "&", ",", ">", "begin", "!", "and", "or")
            if t.kind != "word" or (before is not None and before.text == "." and before.end == t.start):
                k += 1
                continue
            if self.text(k + 1) == ":" and tokens[k + 1].start == t.end and self.text(k + 2) != ":":
                k += 1  # a key
                continue
            inside = any_function = False
            if open_at:
                any_function = open_at[-1][0] == "function" or open_at[-1][1] is not None and open_at[-1][1].get("within", False)
            inside = any_function
            if t.text in g.functions and (begins or before.kind == "word"):
                k = self._ruby_def(k, open_at, inside)
                continue
            if t.text in g.classes and begins:
                name = k + 1
                if self.text(name) == "<":  # class << self
                    open_at.append(("class", {"within": inside, "row": None}))
                    k += 2
                    continue
                while self.text(name + 1) == ":" and self.text(name + 2) == ":":
                    name += 3
                last = name
                if self.text(name + 1) == "<":
                    last = name + 2
                    while self.text(last + 1) == ":" and self.text(last + 2) == ":":
                        last += 3
                row = None if inside or not self.is_word(name) else ("class", name, k, tokens[last].end)
                open_at.append(("class", {"within": inside, "row": row, "at": len(self.rows)}))
                if row:
                    self.rows.append({})
                k = last + 1
                continue
            if t.text in self.OPENERS and (begins or t.text not in self.MAY_FOLLOW):
                if t.text == "do" and loop_line == line:
                    loop_line = -1
                else:
                    open_at.append(("block", {"within": inside}))
                    if t.text in ("while", "until", "for"):
                        loop_line = line
            elif t.text == "end":
                if not open_at:
                    raise BrokenSource(f"unexpected end in line {line}")
                kind, info = open_at.pop()
                if info.get("row"):
                    self._ruby_row(info, t)
            k += 1
        if open_at:
            raise BrokenSource(f"{len(open_at)} blocks without an end")

    def _ruby_def(self, k: int, open_at: list, inside: bool) -> int:
        """Open the function whose ``def`` is at ``k``; the index behind its signature."""
        name = k + 1
        if self.text(name + 1) == "." and self.is_word(name):
            name += 2
        end = name + 1
        if self.is_word(name) and self.text(end) == "=" and self.tokens[end].start == self.tokens[name].end and self.text(end + 1) == "(":
            end += 1  # a setter
        if not self.is_word(name):  # an operator
            while end < len(self.tokens) and self.tokens[end].start == self.tokens[end - 1].end and self.text(end) != "(":
                end += 1
        last = end - 1
        if self.text(end) == "(":
            depth = 0
            for last in range(end, len(self.tokens)):
                depth += (self.text(last) in OPEN) - (self.text(last) in CLOSE)
                if not depth:
                    break
        else:  # parameters without brackets: to the end of the line
            line = self.line(self.tokens[k].start)
            while last + 1 < len(self.tokens) and self.line(self.tokens[last + 1].start) == line and self.text(last + 1) not in (";", "="):
                last += 1
        in_class = bool(open_at) and open_at[-1][0] == "class"
        wanted = not inside and self.is_word(name) and not (self.ignore and in_class)
        row = ("function", name, k, self.tokens[last].end) if wanted else None
        if self.text(last + 1) == "=" and self.text(last + 2) not in ("=", "~", ">"):  # def name(...) = value
            line, stop = self.line(self.tokens[last + 1].start), last + 1
            while stop + 1 < len(self.tokens) and self.line(self.tokens[stop + 1].start) == line:
                stop += 1
            if row:
                self.emit("function", name, k, (self.tokens[last + 2].start, self.tokens[stop].end), self.tokens[stop].end)
            return stop + 1
        open_at.append(("function", {"within": True, "row": row, "at": len(self.rows)}))
        if row:
            self.rows.append({})
        return last + 1

    def _ruby_row(self, info: dict, end: Token) -> None:
        kind, name, first, signature = info["row"]
        inner = self.src[signature:end.start]
        start = signature + len(inner) - len(inner.lstrip(" \t\r\n;"))
        self.emit(kind, name, first, (start, max(start, signature + len(inner.rstrip()))), end.end)
        self.rows[info["at"]] = self.rows.pop()


def parse_definitions(content: str, language: str, ignore_class_methods: bool = False) -> tuple[list[dict], str | None]:
    """(rows, error) of one file in one of ``GRAMMARS``."""
    try:
        finder = Finder(content, language, ignore_class_methods)
        (finder.ends if language == "ruby" else finder.braces)()
    except (BrokenSource, RecursionError) as e:
        return [], f"{type(e).__name__}: {e}"
    finder.rows.sort(key=lambda r: (r["start_line"], r["kind"] != "class"))
    return finder.rows, None
