"""Python files of the older grammar, and sound pieces of broken ones."""

import ast

import pytest

from quarry.operators import extract as xt
from quarry.operators import pysource as ps

STATEMENTS = ["print", "print x", "print 'a', x,", "print >>f, x", "print >>f", "print (a), b", "print (a) % b", "print(a)", "exec c", "exec c in d, e",
              "raise E", "raise E, 'm'", "raise E, 'm', t", "raise E(a, b)", "x = `a` + `b`", "x = a <> b", "x = 10L + 0xFFL + 0777 + 0 + 00", "x = ur'\\d' + UR\"x\"",
              "f = lambda (a, b), c: a", "f = lambda a, (b, (c, d)): a", "f = lambda: (1, 2)", "async = await = 1", "if x: print 1; print 2", "for a in b: print a",
              "d = {1: print_, 'print': 2}", "x = a[1:2], print_", "try: print 1\nexcept E, e: print e", "try: pass\nexcept (E, F), e: pass", "try: pass\nexcept E: pass",
              "def f(a, (b, c)=(1, 2), *d): print a", "def f((a, b)): return a", "print 'print x # no'  # print y", "print '''a\nprint b''', c", "print \\\n x", "print (1,\n 2), 3"]


@pytest.mark.parametrize("text", STATEMENTS)
def test_statements_of_the_older_grammar(text):
    source = ps.Source(text + "\n" + "print done\n")
    assert source.tree is not None and source.old
    assert len(source.new_lines) == len(source.lines)


def test_texts_come_from_the_file_itself():
    src = "def f((a, b), c=0777):\n\tur'''größe é'''\n\tprint `a`, 10L; x = \"ä\" <> `b`\n        return lambda (p, q): 1L\n"
    source = ps.Source(src)
    fn = source.tree.body[0]
    assert source.of(fn.body[0].value) == "ur'''größe é'''"
    assert source.of(fn.body[1].value) == "`a`, 10L" or source.of(fn.body[1]).startswith("print `a`")
    assert source.of(fn.body[2].value) == "\"ä\" <> `b`"
    assert source.of(fn.body[3].value) == "lambda (p, q): 1L"
    assert source.indent(4) == "        " and source.indent(2) == "\t"


def test_current_files_are_read_as_they_are():
    src = "x = 1\nprint(x, end='')\nasync def f(): await x\n"
    source = ps.Source(src)
    assert not source.old and ast.dump(source.tree) == ast.dump(ast.parse(src))


@pytest.mark.parametrize("src", ["def f(:", "print 'a", "x = (", "\0", "class A:\nprint x", "if x print y", "raise E, 'm' from z,"])
def test_broken_files_stay_broken(src):
    source = ps.Source(src)
    assert source.tree is None and source.error
    assert xt.parse_functions(src) == [] and xt.parse_definitions(src)[0] == [] and xt.tokenize_code(src) == ([], [])


def test_recovery_keeps_sound_pieces_with_their_lines():
    src = ("import x\n\n# note\ndef a(p):\n    return 1\n\ndef b(:\n    return 2\n\n@deco\n@more(\n  1)\nclass C:\n    y = 1\n    def m(self):\n        print 'old'\n"
           "    def n(self:\n        pass\n    @prop\n    def o(self):\n        s = '''\ndef no(): pass\n'''\n        return s\nx = (\nasync def d(): pass\n")
    out = {f["func_name"]: (f["lineno"], f["raw_code"]) for f in xt.parse_functions(src, recover=True)}
    assert {k: v[0] for k, v in out.items()} == {"a": 4, "m": 15, "o": 20, "d": 26}
    assert out["a"][1] == "\n# note\ndef a(p):\n    return 1\n" and "def no()" in out["o"][1]
    assert xt.parse_functions(src) == []


def test_recovery_of_a_sound_file_is_the_file_itself():
    src = "class A:\n    def m(self):\n        return 1\n\ndef f(x):\n    return x\n"
    assert xt.parse_functions(src, recover=True) == xt.parse_functions(src)


@pytest.mark.parametrize("src", ["", "\n", "# only\n", "def", "@", "class", "    def x(): pass", "\tdef f(:\n\t\tpass", "class A(:\n    def f(self): return 1\n"])
def test_recovery_of_odd_files(src):
    assert isinstance(xt.parse_functions(src, recover=True), list)
