"""Definitions in files of five languages, by hand; broken files; linear time."""

import time

import pytest

from quarry.operators import extract as xt
from quarry.operators import grammars as g


def found(language, src, **options):
    rows, error = g.parse_definitions(src, language, **options)
    assert error is None, error
    return [(r["kind"][0], r["name"], r["start_line"], r["end_line"]) for r in rows]


CASES = {
    "go": [
        ("package a\nfunc F() {}\n", [("f", "F", 2, 2)]),
        ("func (r *T[K]) M(f func(int) (a, b int)) (x struct{ a int }, err error) {\n}\n", [("f", "M", 1, 2)]),
        ("type (\n\tA struct {\n\t\tin struct{ x int }\n\t}\n\tB interface {\n\t}\n\tC int\n)\n", [("c", "A", 2, 4), ("c", "B", 5, 6)]),
        ("type G[T any] struct {\n}\nvar v struct { a int }\nvar f = func() { x := `}` }\n", [("c", "G", 1, 2)]),
        ("func ext(x int) int\nfunc real() {\n\ttype Local struct {}\n}\n", [("f", "real", 2, 4)]),
        ("var r = '{'\nvar s = \"\\\"}\"\n/* func no() { */\nfunc yes() { c := '\\'' }\n", [("f", "yes", 4, 4)]),
    ],
    "java": [
        ("class A { A() {} void m() throws B, C { } int n(); }", [("c", "A", 1, 1), ("f", "A", 1, 1), ("f", "m", 1, 1)]),
        ("class A {\n  @Test(x = {1, 2})\n  public\n  void m() { }\n}", [("c", "A", 1, 5), ("f", "m", 2, 4)]),
        ("record P(int x) { P { } int s() { return x(); } }\n@interface N { int v() default 1; }", [("c", "P", 1, 1), ("f", "s", 1, 1), ("c", "N", 2, 2)]),
        ("class A { Object o = new B<C>(f()) { int m() { return 1; } }; Class<?> c = A.class; }", [("c", "A", 1, 1), ("f", "m", 1, 1)]),
        ("class A { String t = \"\"\"\n class B { \\\"\"\" void x() {\n\"\"\"; char c = '}'; static { int y; } }", [("c", "A", 1, 3)]),
        ("enum E { A, B { int v() { return 1; } }; E() { } }", [("c", "E", 1, 1), ("f", "E", 1, 1)]),
    ],
    "php": [
        ("function html() {}\n<?php function f() {} ?>\n} <?= $x ?>", [("f", "f", 2, 2)]),
        ("<?php\n#[A(1)]\nfinal class C extends D { #no {\n public function &m(): ?X { // }\n return \"{$a[\"}\"]}\"; }\n abstract function n();\n}", [("c", "C", 2, 7), ("f", "m", 4, 5)]),
        ("<?php $x = new class(1) extends B { function q() {} }; use function A\\b; $f = function($a) use ($b) { }; A::class;", [("f", "q", 1, 1)]),
        ("<?php function h() { return <<<'E'\n } class X {\n  E . '\\''; }\ninterface I { function i(); }\nenum S: int { case A = 1; function e() {} }", [("f", "h", 1, 3), ("c", "I", 4, 4), ("c", "S", 5, 5), ("f", "e", 5, 5)]),
    ],
    "javascript": [
        ("export default class A extends (B, C) { static async m({a} = {}) { } get #p() { } x = 1; 'str'() {} }", [("c", "A", 1, 1), ("f", "m", 1, 1), ("f", "#p", 1, 1)]),
        ("var a = b / c, d = /[/\"]}/.test('{'), e = (1) / 2;\nasync function* g() { }\n", [("f", "g", 2, 2)]),
        ("function f() { return `a${`}${'`'}`}{`; }\nconst k = class { m() {} };\nx.function; y.class;", [("f", "f", 1, 1)]),
        ("if (a) { class In { m() { if (x) { } function deep() {} } } }", [("c", "In", 1, 1), ("f", "m", 1, 1)]),
    ],
    "ruby": [
        ("class A < B::C\n def x; y if z; end\n def self.w(a = {}) = a\n def ==(o) o end\n def v=(x); @v = x; end\nend", [("c", "A", 1, 6), ("f", "x", 2, 2), ("f", "w", 3, 3), ("f", "v", 5, 5)]),
        ("module M\n class << self\n  def s\n   x = if a then b end\n   while c do d end\n   begin; e; end until f\n   g unless h\n  end\n end\nend", [("c", "M", 1, 10), ("f", "s", 3, 8)]),
        ("def t(a)\n <<~X + <<-Y.strip\n  end\n X\n  def\n  Y\n [/end/, %w(end), :end, ?e, 'end', \"#{x ? \"end\" : {a: 1}[:a]}\"]\nend", [("f", "t", 1, 8)]),
        ("=begin\nclass No\n=end\nfoo do |x| x.class.end { |y| y } end\nclass A::B; end # end\n__END__\nclass Z", [("c", "B", 5, 5)]),
        ("def o\n def inner; end\n a = b.map do |c|\n  case c when 1 then 2 end\n end\n puts(if x then 1 end)\nend", [("f", "o", 1, 7)]),
    ],
}


@pytest.mark.parametrize("language, src, want", [(k, *c) for k, cases in CASES.items() for c in cases])
def test_definitions(language, src, want):
    assert found(language, src) == want


def test_bodies_and_headers():
    rows, _ = g.parse_definitions("class A {\n  int m() { return 1; }\n}\n", "java")
    assert [(r["body"], r["header"]) for r in rows] == [("{\n  int m() { return 1; }\n}", "class A {"), ("{ return 1; }", "  int m() { return 1; }")]
    rows, _ = g.parse_definitions("def a(x)\n\n  x + 1\n\nend\ndef b; end", "ruby")
    assert [r["body"] for r in rows] == ["x + 1", ""]


def test_methods_of_classes_may_be_ignored():
    src = {"java": "class A { void m() {} class B { void n() {} } }", "php": "<?php class A { function m() {} } function f() {}",
           "javascript": "class A { m() {} } function f() {}", "ruby": "class A\n def m; end\nend\ndef f; end", "go": "func (a A) M() {}"}
    want = {"java": ["A", "B"], "php": ["A", "f"], "javascript": ["A", "f"], "ruby": ["A", "f"], "go": ["M"]}
    for language, text in src.items():
        assert [r[1] for r in found(language, text, ignore_class_methods=True)] == want[language]


@pytest.mark.parametrize("language, src", [("go", "func f() {"), ("go", "var a = `x"), ("java", "class A { ) }"), ("java", "/* class A {}"), ("php", "<?php } class A {}"),
                                           ("php", "<?php $a = 'x"), ("javascript", "function f() { return `${`; }"), ("ruby", "def f"), ("ruby", "end"), ("ruby", "x = <<~A\n b")])
def test_broken_files_give_an_error_and_no_rows(language, src):
    rows, error = g.parse_definitions(src, language)
    assert rows == [] and error


@pytest.mark.parametrize("language", list(g.GRAMMARS))
@pytest.mark.parametrize("src", ["", " \n", "\ufeff// x", "\0", "é 日本 😀", "a" * 1000, "\r\n\r\n"])
def test_odd_files(language, src):
    assert g.parse_definitions(src, language)[0] == []


@pytest.mark.parametrize("language, unit", [("go", "type A struct {\n a int }\nfunc f(a int) (b int) { return `x` }\n"), ("java", "class A { @B(1) int x() { return \"}\"; } }\n"),
                                            ("php", "<?php function f($a) { return 'x'; } ?> text\n"), ("javascript", "class A { m() { return /x}/; } }\n"),
                                            ("ruby", "class A\n def f(a) a if b end\nend\n"), ("java", "int a = b(c, "), ("javascript", "{ a: ["), ("go", "x(")])
def test_time_is_linear(language, unit):
    def seconds(n):
        start = time.perf_counter()
        g.parse_definitions(unit * n, language)
        return time.perf_counter() - start

    small = min(seconds(500) for _ in range(3))
    assert seconds(4000) < 20 * small + 0.5


def test_language_by_suffix(spark):
    files = [("a.py", "def p(x): return 1"), ("b.go", "func g() {}"), ("c.rb", "def r; 1; end"), ("d.txt", "def t(): pass"), ("e", "def e(): pass"), (None, "def n(): pass"),
             ("f.java", None), ("g.js", "function j() {")]
    df = spark.createDataFrame(files, "path string, content string")
    rows = xt.extract_definitions(df, path="path", with_errors=True).collect()
    assert {(r.path, r.name, r.error is not None) for r in rows} == {("a.py", "p", False), ("b.go", "g", False), ("c.rb", "r", False), ("g.js", None, True)}
    langs = df.select("path", xt.language_of(df.path).alias("l")).collect()
    assert {r.path: r.l for r in langs} == {"a.py": "python", "b.go": "go", "c.rb": "ruby", "d.txt": None, "e": None, None: None, "f.java": "java", "g.js": "javascript"}
