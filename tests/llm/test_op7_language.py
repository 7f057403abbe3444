import math
import zlib
from collections import Counter

import numpy as np
from quarry.llm import op7_language as op

SMALL = "/root/testdata/sf0.01"


def model(samples):
    counts = {}
    for lang, texts in samples.items():
        gram, n = np.unique(np.concatenate([op._windows(op.PAD + t.encode()) for t in texts]), return_counts=True)
        counts[lang] = (gram, n.astype(float))
    return op.Model(counts)


SAMPLES = {"en": ["the stones of that old river and the hills", "which of the two went over"],
           "de": ["die alten steine und der fluss über den hügeln", "welche von beiden ging"],
           "fr": ["les vieilles pierres de cette rivière été", "lequel des deux est allé"]}


def plain_bits(texts, text):
    """Code length by the definition: longest context seen, escapes of method C, a uniform byte at last."""
    seen = [Counter() for _ in range(op.ORDER + 1)]
    for t in texts:
        data = op.PAD + t.encode()
        for i in range(op.ORDER, len(data)):
            for k in range(op.ORDER + 1):
                seen[k][data[i - k:i + 1]] += 1
    followers = [{} for _ in seen]
    for k, c in enumerate(seen):
        for gram, n in c.items():
            total, distinct = followers[k].get(gram[:-1], (0, 0))
            followers[k][gram[:-1]] = (total + n, distinct + 1)
    bits, data = 0.0, op.PAD + text.encode()
    for i in range(op.ORDER, len(data)):
        for k in range(op.ORDER, -1, -1):
            gram = data[i - k:i + 1]
            if gram[:-1] not in followers[k]:
                continue
            total, distinct = followers[k][gram[:-1]]
            if gram in seen[k]:
                bits -= math.log2(seen[k][gram] / (total + distinct))
                break
            bits -= math.log2(distinct / (total + distinct))
        else:
            bits += 8
    return bits


def test_code_lengths_equal_the_definition():
    m = model(SAMPLES)
    texts = ["the river of steine", "été", "日本 quite other", "x", "the " * 300, "\x00\x01"]
    got = m.code_lengths(texts)
    for i, t in enumerate(texts):
        for j, lang in enumerate(m.languages):
            assert math.isclose(got[i, j], plain_bits(SAMPLES[lang], t), rel_tol=1e-4)


def test_long_texts_are_scored_whole(monkeypatch):
    m = model(SAMPLES)
    texts = ["the stones and die steine des rivières " * 50, "short", "of that old " * 90]
    want = m.code_lengths(texts)
    monkeypatch.setattr(op, "SLICE", 100)
    assert np.allclose(m.code_lengths(texts), want, rtol=1e-6)


def test_und_and_ties():
    m = model({"b": ["abc"], "a": ["abc"]})
    assert m.predict([None, "", "123 !?", "abc"]) == (["und", "und", "und", "a"], [0.0, 0.0, 0.0, 0.5])
    assert op.Model({}).predict(["abc", None]) == (["und", "und"], [0.0, 0.0])


def test_held_out_accuracy(spark):
    lang = {r.doc_id: r.lang for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()}
    out = op.op7_language(spark, SMALL).collect()
    assert len(out) == len(lang)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in out)
    held = [r for r in out if r.held_out]
    assert held and sum(r.lang_pred == lang[r.doc_id] for r in held) > 0.98 * len(held)


def test_held_out_rows_are_not_read(spark, tmp_path):
    from pyspark.sql import functions as F

    docs = spark.read.parquet(f"{SMALL}/documents.parquet").limit(300)
    held = F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(4)) == 2
    docs.write.parquet(f"{tmp_path}/a/documents.parquet")
    docs.withColumn("lang", F.when(held, F.lit("xx")).otherwise(F.col("lang"))).write.parquet(f"{tmp_path}/b/documents.parquet")
    a, b = (sorted((r.doc_id, r.lang_pred, r.score) for r in op.op7_language(spark, f"{tmp_path}/{x}").collect()) for x in "ab")
    assert a == b


def test_odd_rows_and_empty_table(spark, odd, none, odd_docs):
    out = op.op7_language(spark, odd).collect()
    assert sorted(str(r.doc_id) for r in out) == sorted(str(d) for d, _ in odd_docs)
    by_id = {r.doc_id: r for r in out}
    assert {by_id[i].lang_pred for i in (1000, 1001, 1002, 1007)} == {"und"}
    assert op.op7_language(spark, none).count() == 0


def test_columns_are_passed_on(spark, odd):
    docs = spark.read.parquet(f"{odd}/documents.parquet")
    out = op.predict_language(docs, model(SAMPLES), docs.columns, prefix="p_")
    assert out.columns == [*docs.columns, "p_lang_pred", "p_score"]
    assert sorted(map(str, out.select(*docs.columns).collect())) == sorted(map(str, docs.collect()))


def many_languages(n):
    """n made-up languages with an alphabet of their own each."""
    rng = np.random.default_rng(12)
    letters = [chr(c) for c in range(0x4E00, 0x4E00 + 4 * n)]
    texts = {f"l{i:04d}": "".join(rng.choice(letters[4 * i:4 * i + 4], 60)) for i in range(n)}
    counts = {}
    for lang, text in texts.items():
        gram, c = np.unique(op._windows(op.PAD + text.encode()), return_counts=True)
        counts[lang] = gram, c.astype(float)
    return texts, counts


def test_memory_is_bounded_with_many_languages():
    """A thousand labels: the costs held at a time stay under a limit, and predictions right."""
    import tracemalloc

    texts, counts = many_languages(1000)
    model = op.Model(counts)
    assert model.costs.size <= 2 * op.TABLE_CELLS and model.slice * len(counts) <= op.SLICE_CELLS
    some = list(texts)[::25]
    tracemalloc.start()
    langs, _ = model.predict([texts[x][10:50] * 200 for x in some])
    _, peak = tracemalloc.get_traced_memory()
    tracemalloc.stop()
    assert langs == some and peak < 600e6


def test_costs_do_not_depend_on_the_slice_or_the_table(monkeypatch):
    texts, counts = many_languages(12)
    sample = [t * 7 for t in texts.values()] + ["", "x", "abc" * 500]
    want = op.Model(counts).code_lengths(sample)
    monkeypatch.setattr(op, "SLICE_CELLS", 12 * 50)
    monkeypatch.setattr(op, "TABLE_CELLS", 12 * 6 * 5)
    small = op.Model(counts)
    assert small.slice == 50 and np.allclose(small.code_lengths(sample), want, rtol=1e-6)
