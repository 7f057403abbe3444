"""The batch corpus build end to end on hand-written blobs."""

from quarry.operators import retrieve as rt
from quarry.operators import stats as st
from quarry.plans import corpus

BODY = '''def {name}(alpha, beta):
    """Combine the two given values carefully."""
    gamma = alpha + beta
    delta = gamma * alpha
    epsilon = delta - beta
    zeta = epsilon + gamma
    eta = zeta * delta
    return eta + {k}
'''


def test_build_corpus(spark):
    blobs = spark.createDataFrame(
        [("org/a", "x.py", BODY.format(name="first", k=1)),
         ("org/a", "y.py", BODY.format(name="first", k=1)),      # exact copy -> removed (D1)
         ("org/b", "z.py", BODY.format(name="second", k=2)),     # near copy -> one survivor (D2)
         ("org/c", "w.py", "def tiny():\n    return 1\n")],     # dropped by P4
        "repo string, path string, content string")
    funcs = corpus.functions_table(blobs)
    assert sorted((r["path"], r["func_name"]) for r in funcs.collect()) == [("x.py", "first"), ("z.py", "second")]
    built = corpus.build_corpus(blobs).collect()
    assert len(built) == 1 and built[0]["partition"] in {"train", "valid", "test", "holdout"}
    assert built[0]["docstring_tokens"][:3] == ["Combine", "the", "two"]
    summary = st.order_by_counts(corpus.corpus_summary(corpus.build_corpus(blobs)), "count", ["partition"])
    assert summary.first()["count"] == 1
