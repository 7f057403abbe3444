import hashlib

import corpus_pipeline as cp
import numpy as np
import public_tokenizers
from quarry.llm import op1_quality, op7_language, op8_near
from tokenizers import Tokenizer

from . import test_op1_quality, test_op6_mix, test_op8_near


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def test_every_stage_against_a_plain_version(spark, odd):
    columns = None
    docs = spark.read.parquet(f"{odd}/documents.parquet")
    columns = docs.columns
    stages = dict(cp.STAGES)
    assert [n for n, _ in cp.STAGES] == ["language", "quality", "near_duplicates", "mixture", "encoded"]

    def stored(df, name):
        from quarry.session import stored as write

        return write(df, name)

    # Language: the documents that a model fitted on the same rows is sure of.
    model = op7_language.fit(docs)
    want = [r for r in docs.collect() if (lambda p: p[0][0] != "und" and p[1][0] >= op7_language.MIN_SCORE)(model.predict([r.text]))]
    kept = stored(stages["language"](spark, docs, odd), "t")
    assert kept.columns == columns and rows_of(kept) == sorted((tuple(r) for r in want), key=str)

    # Quality: the base rule by plain Python, the thresholds on the plain counts.
    before, kept = kept, stored(stages["quality"](spark, kept, odd), "t")
    verdict = {(r.doc_id, r.text): r.q_kept for r in op1_quality.quality_columns(before, prefix="q_").collect()}
    assert kept.columns == columns
    assert rows_of(kept) == sorted((tuple(r) for r in before.collect() if verdict[(r.doc_id, r.text)]), key=str)
    assert not any(test_op1_quality.plain(r.text)[-1] for r in kept.collect())

    # Near duplicates: one row of each class found by all pairs.
    before, kept = kept, stored(stages["near_duplicates"](spark, kept, odd), "t")
    classes = {c for _, c, _ in test_op8_near.plain([(r.doc_id, r.text) for r in before.collect()])}
    assert kept.columns == columns and kept.count() == len(classes)
    assert all(len(op8_near.shingles(r.text)) for r in kept.collect())

    # Mixture: whole documents, near the targets of plain water-filling.
    before, kept = kept, stored(stages["mixture"](spark, kept, odd), "t")
    assert kept.columns == columns and set(rows_of(kept)) <= set(rows_of(before))
    words = lambda r: len(op8_near.WORDS.findall(r.text))
    sizes, taken, largest = {}, {}, {}
    for r in before.collect():
        sizes[r.source] = sizes.get(r.source, 0) + words(r)
        largest[r.source] = max(largest.get(r.source, 0), words(r))
    for r in kept.collect():
        taken[r.source] = taken.get(r.source, 0) + words(r)
    for s, target in test_op6_mix.plain_targets(sizes).items():
        assert abs(taken.get(s, 0) - target) <= largest[s] / 2 + 1

    # Encoding: the library's ids.
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    want = []
    for r in kept.collect():
        ids = library.encode(r.text, add_special_tokens=False).ids
        want.append((r.doc_id, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(),
                     hashlib.sha256(r.text.encode()).hexdigest()))
    assert rows_of(stages["encoded"](spark, kept, odd)) == sorted(want, key=str)
    assert rows_of(cp.run(spark, odd)) == sorted(want, key=str)


def test_empty_table(spark, none):
    assert cp.run(spark, none).count() == 0


def test_queries_are_registered():
    import __spark_entry__ as entry

    names = list(entry.queries())
    for n in range(1, 11):
        assert sum(x.startswith(f"op{n}_") for x in names) == 1
    assert "pipeline" in names


def test_clashing_names_pass_through_the_stages(spark, odd):
    """Columns named like those that the operators work with keep their values."""
    names = ["__words", "__n", "__win", "__q", "__quality_text", "__text", "__id", "__h", "__d", "__t", "__i", "__j", "__stage_kept", "__STAGE_score"]
    from pyspark.sql import functions as F

    docs = spark.read.parquet(f"{odd}/documents.parquet").select("doc_id", "text", "lang", "source", "n_chars",
                                                                 *[F.concat(F.col("source"), F.lit(n)).alias(n) for n in names])
    for name, stage in cp.STAGES[:-1]:
        out = stage(spark, docs, odd)
        assert out.columns == docs.columns, name
        rows = out.collect()
        assert rows and all(r[n] == (None if r.source is None else r.source + n) for r in rows for n in names), name


def test_a_language_outside_the_stop_word_list_passes_the_quality_stage(spark, odd):
    text = "Το ποτάμι περνά κάτω από τη γέφυρα και χάνεται στα χωράφια. " + " ".join(f"λέξη{i} άλλη{i}" for i in range(60))
    docs = spark.createDataFrame([(1, text, "el", "s", len(text)), (2, "kurz", "de", "s", 4)], "doc_id long, text string, lang string, source string, n_chars long")
    assert [r.doc_id for r in cp.quality(spark, docs, odd).collect()] == [1]
