import re
from collections import Counter

import duckdb
from quarry.llm import op1_quality as op

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def plain(text):
    text = text or ""
    w = WORD.findall(text)
    win = Counter(zip(w, w[1:], w[2:]))
    covered = {i + k for i in range(len(w) - 2) if win[tuple(w[i:i + 3])] > 1 for k in range(3)}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    n = len(w)
    return (n, sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered),
            n < 50 or 100 * len(covered) > 50 * n)


def key(r):
    return tuple((x is not None, x) for x in r)


def test_counts_equal_plain_python_on_odd_rows(spark, odd, odd_docs):
    out = op.op1_quality_rules(spark, odd).collect()
    got = sorted(((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed)
                  for r in out), key=key)
    assert got == sorted(((d, *plain(t)) for d, t in odd_docs), key=key)
    assert all(r.kept is False for r in out if r.base_failed)


def test_verdicts(spark):
    clean = "\n".join(f"the stones{i} of that{i} old river{i} and the hills{i * 7} beyond {i} of them{i}" for i in range(30))
    cases = {"clean": clean, "symbols": " ".join(f"word{i}%%%" for i in range(80)) + " the of the",
             "lines": "the same words of a line %s\n" % "x" * 40, "no stop words": " ".join(f"zq{i}" for i in range(80)),
             "shouting": " ".join(f"the{i}!!" for i in range(90)), "short": "the words"}
    df = spark.createDataFrame(list(cases.items()), "doc_id string, text string")
    kept = {r.doc_id for r in op.quality_columns(df).filter("kept").collect()}
    assert kept == {"clean"}


def test_filter_on_the_verdict_is_not_moved_below_the_arrays(spark, odd):
    df = op.quality_columns(spark.read.parquet(f"{odd}/documents.parquet"), prefix="q_").filter("q_kept")
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count(r", [^\x20\x09-\x0D]+, 0)") == 1
    assert "kept" in df.columns and "size" in df.columns  # clashing columns stay as they were


def test_empty_table_and_oracle(spark, none):
    out = op.op1_quality_rules(spark, none)
    assert out.count() == 0
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{none}/documents.parquet/*.parquet'")
    assert {c[0] for c in con.execute(op.oracle()).description} == set(out.columns)


def test_native(spark, none):
    plan = op.op1_quality_rules(spark, none)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Exchange" not in plan
