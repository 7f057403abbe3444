import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from quarry.llm import op3_bpe as op
from tokenizers import Tokenizer

LIBRARY = Tokenizer.from_file(public_tokenizers.path(op.TOKENIZER))


def library(texts):
    return [e.ids for e in LIBRARY.encode_batch(texts, add_special_tokens=False)]


def own(texts):
    ids, counts = op.encoder().encode(texts)
    return [x.tolist() for x in np.split(ids, np.cumsum(counts)[:-1])]


def test_equals_the_library_on_drawn_texts():
    r = random.Random(3)
    letters = list("aabbc' 's't're  \n\n\t\r\x0b\x0c\x1c\x1f\x85\xa0 　​᠎é日本1２٣!?#%%…😀İß") + [
        "<|endoftext|>", "  ", " the", "'ll", "aaaaaaa", "\n \n", "the of and"]
    texts = ["".join(r.choices(letters, k=r.randint(0, 40))) for _ in range(5000)] + ["", "<|endoftext|>" * 3, "a" * 5000]
    assert own(texts) == library(texts)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text(st.characters(blacklist_categories=["Cs"]), max_size=60), min_size=1, max_size=4))
def test_round_trip(texts):
    ids, counts = op.encoder().encode(texts)
    for t, x in zip(texts, np.split(ids, np.cumsum(counts)[:-1])):
        assert op.encoder().decode(x).decode() == t


def test_results_do_not_depend_on_what_was_met_before(monkeypatch):
    texts = ["the lost stones of that old river " * 20, "été 日本 x" * 50]
    want = own(texts)
    monkeypatch.setattr(op, "KNOWN_PIECES", 3)
    assert own(texts[::-1])[::-1] == want and own(texts) == want


def test_query_on_odd_rows(spark, odd, odd_docs):
    def expected(text):
        ids = library([text or ""])[0]
        decoded = LIBRARY.decode(ids, skip_special_tokens=False)
        return (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(decoded.encode()).hexdigest())

    got = sorted(((r.doc_id is None, r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256)
                  for r in op.op3_bpe_round_trip(spark, odd).collect()), key=str)
    assert got == sorted(((d is None, d, *expected(t)) for d, t in odd_docs), key=str)


def test_operator_and_empty_table(spark, odd, none):
    docs = spark.read.parquet(f"{odd}/documents.parquet").filter("doc_id < 60").dropDuplicates(["doc_id"])
    back = op.decode_documents(op.encode_documents(docs))
    texts = {r.doc_id: r.text for r in docs.collect()}
    assert {r.doc_id: r.text for r in back.collect()} == texts
    assert op.op3_bpe_round_trip(spark, none).count() == 0


@pytest.mark.parametrize("run", ["aaaa", "aaaaa", "abababab", "      ", "\n\n\n\n\n"])
def test_overlapping_pairs(run):
    texts = [run * k for k in range(1, 30)]
    assert own(texts) == library(texts)
