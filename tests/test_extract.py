"""Parsing operators on hand-written sources."""

from quarry.operators import extract as xt

SRC = '''import os

@decorator
def top(a, b):
    """Adds two numbers together."""
    # comment here
    return a + b

if os.name:
    def inside_if(x):
        """Defined inside an if block."""
        y = x
        return y

class Outer(Base):
    """Outer class."""

    def method(self, v):
        """Return the value twice."""
        w = v * 2
        return w

    class Inner:
        def deep(self):
            return 1

    async def run_test(self):
        """Looks like a test method."""
        return 2

def short():
    return 0
'''


def test_extract_functions(spark):
    df = spark.createDataFrame([("r", "p.py", SRC), ("r", "bad.py", "def (:")], "repo string, path string, content string")
    got = {r["func_name"]: r for r in xt.extract_functions(df).collect()}
    assert set(got) == {"top", "inside_if", "method"}
    assert got["top"]["lineno"] == 4
    assert got["top"]["code"] == 'def top(a, b):\n    """Adds two numbers together."""\n    # comment here\n    return a + b'
    assert got["method"]["code"].startswith("def method(self, v):\n    \"\"\"Return")
    assert got["method"]["docstring"] == '"""Return the value twice."""'


def test_lines_above_a_function_are_its_code(spark):
    src = ("import os\n\n# first\n\n# second\ndef two(a):\n    return 1\n\nclass A:\n    # kept\n\n    def method(self):\n"
           "        return 2\n\n@deco\n# below the decorator\ndef three(a):\n    return 3\n")
    df = spark.createDataFrame([("r", "p.py", src)], "repo string, path string, content string")
    got = {r["func_name"]: r["code"] for r in xt.extract_functions(df, require_docstring=False).collect()}
    assert got["two"] == "\n# first\n\n# second\ndef two(a):\n    return 1"
    assert got["method"] == "# kept\ndef method(self):\n    return 2"
    assert got["three"] == "# below the decorator\ndef three(a):\n    return 3"


def test_extract_definitions(spark):
    df = spark.createDataFrame([("p.py", SRC)], "file string, content string")
    rows = [(r["kind"], r["name"]) for r in xt.extract_definitions(df).orderBy("start_line", "kind").collect()]
    assert ("class", "Inner") in rows and ("function", "deep") in rows and ("function", "run_test") in rows
    no_methods = {(r["kind"], r["name"]) for r in xt.extract_definitions(df, ignore_class_methods=True).collect()}
    assert no_methods == {("function", "top"), ("function", "inside_if"), ("class", "Outer"),
                          ("class", "Inner"), ("function", "short")}
    body = {r["name"]: r["body"] for r in xt.extract_definitions(df).collect()}
    assert body["top"] == '"""Adds two numbers together."""\n    # comment here\n    return a + b'
    assert body["short"] == "return 0"
    err = spark.createDataFrame([("bad.py", "def (:")], "file string, content string")
    assert xt.extract_definitions(err).count() == 0
    assert xt.extract_definitions(err, with_errors=True).first()["error"].startswith("SyntaxError")


def test_code_tokens_column(spark):
    code = 'def f(a, b=1):\n    """Doc string."""\n    # add them up\n    return a + b  # done\n'
    df = spark.createDataFrame([(code,), (None,), ("def (",)], "code string").select(
        xt.code_tokens("code").alias("t"), xt.code_tokens("code", only_ids=True).alias("ids"),
        xt.code_tokens("code", add_keywords=False).alias("plain"), xt.code_tokens("code", func_only=False).alias("whole"))
    rows = df.collect()
    assert rows[0]["t"]["comment_tokens"] == ["add", "them", "up", "done"]
    assert rows[0]["ids"]["code_tokens"] == ["f", "a", "b", "a", "b"]
    assert "return" not in rows[0]["plain"]["code_tokens"] and "+" in rows[0]["plain"]["code_tokens"]
    assert '"""Doc string."""' in rows[0]["whole"]["code_tokens"]
    assert rows[1]["t"]["code_tokens"] == rows[2]["t"]["code_tokens"] == []


def test_code_tokens():
    code = 'def f(a, b=1):\n    """Doc string."""\n    # add them up\n    return a + b  # done\n'
    toks, comments = xt.tokenize_code(code)
    assert toks == ["def", "f", "(", "a", ",", "b", "=", "1", ")", ":", "return", "a", "+", "b"]
    assert comments == ["# add them up", "# done"]
    assert xt.tokenize_code(code, only_ids=True)[0] == ["f", "a", "b", "a", "b"]
    assert xt.tokenize_code(code, add_keywords=False)[0][:2] == ["f", "("]
    assert xt.tokenize_code("x = (") == ([], [])
    assert xt.tokenize_code("x = 1") == ([], [])


def test_build_tags_excludes_test_paths(spark):
    df = spark.createDataFrame([("pkg/m.py", SRC), ("tests/test_m.py", SRC), ("env/x.py", SRC)],
                               "file string, content string")
    tags = xt.build_tags(df).collect()
    assert {r["file"] for r in tags} == {"pkg/m.py"}
    top = [r for r in tags if r["name"] == "top"][0]
    assert top["pattern"] == "/^def top(a, b):$/" and top["line"] == 3


def test_a_code_is_scanned_once_for_all_forms_of_its_tokens(monkeypatch):
    from quarry.operators import extract as xt

    scans = []
    scan = xt._scanned
    monkeypatch.setattr(xt, "_scanned", lambda code: scans.append(code) or scan(code))
    code = "def once(x):  # note\n    '''Doc.'''\n    return x\n"
    assert xt.tokenize_code(code) == (["def", "once", "(", "x", ")", ":", "return", "x"], ["# note"])
    assert xt.tokenize_code(code, only_ids=True) == (["once", "x", "x"], ["# note"])
    assert xt.tokenize_code("x = 1\n") == ([], []) and xt.tokenize_code("x = 1\n", func_only=False) == (["x", "=", "1"], [])
    assert len(scans) == 2


def test_tasks_follow_the_rows_that_are_parsed(spark):
    from quarry.session import spread

    df = spark.range(1000, numPartitions=1)
    assert spread(df, 10).rdd.getNumPartitions() == 100
    assert spread(df).rdd.getNumPartitions() == spark.sparkContext.defaultParallelism
