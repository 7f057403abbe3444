import random

import numpy as np
import pytest
from quarry.llm import op8_near as op


def plain(rows):
    """doc_id, class_id, n_links from all pairs."""
    sets = [{tuple(w[i:i + 5]) for i in range(max(1, len(w) - 4))} if w else set()
            for w in (op.WORDS.findall(t or "") for _, t in rows)]
    up, links = list(range(len(rows))), [0] * len(rows)

    def root(a):
        while up[a] != a:
            a = up[a]
        return a

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j]):
                links[i] += 1
                links[j] += 1
                a, b = root(i), root(j)
                up[max(a, b)] = min(a, b)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[root(i)] = min(d, least.get(root(i), d))
    return sorted(((d, least.get(root(i)) if sets[i] else d, n) for i, ((d, _), n) in enumerate(zip(rows, links))), key=str)


def drawn(seed, n_base=20, copies=6, words=60):
    r = random.Random(seed)
    rows = []
    passage = [f"p{i}" for i in range(25)]
    for b in range(n_base):
        base = [f"w{r.randint(0, 500)}" for _ in range(words)] + (passage if b % 2 else [])
        for _ in range(r.randint(1, copies)):
            w = list(base)
            for _ in range(r.choice([0, 0, 1, 2, 4])):
                w[r.randrange(len(w))] = f"x{r.randint(0, 9)}"
            rows.append(" ".join(w))
    r.shuffle(rows)
    return list(enumerate(rows))


def run(spark, rows):
    out = op.near_classes(spark.createDataFrame(rows, "doc_id long, text string"))
    return sorted(((r.doc_id, r.class_id, r.n_links) for r in out.collect()), key=str)


@pytest.mark.parametrize("seed", [1, 2])
def test_equals_all_pairs(spark, seed):
    rows = drawn(seed)
    assert run(spark, rows) == plain(rows)


def test_blocks_of_buckets_and_families(spark, monkeypatch):
    """One family of chained near copies, cut into many small blocks."""
    r = random.Random(4)
    base = [f"w{i}" for i in range(80)]
    rows = []
    for i in range(60):
        base[r.randrange(80)] = f"x{i}"
        rows.append((i, " ".join(base)))
    monkeypatch.setattr(op, "BUCKET_BLOCK", 5)
    monkeypatch.setattr(op, "FAMILY_BLOCK", 5)
    assert run(spark, rows) == plain(rows)


def test_odd_rows(spark, odd, odd_docs):
    out = op.op8_near_duplicates(spark, odd).collect()
    assert sorted((tuple(r) for r in out), key=str) == plain(odd_docs)


def test_one_per_class(spark, odd, odd_docs):
    docs = spark.read.parquet(f"{odd}/documents.parquet")
    kept = op.one_per_class(docs)
    assert kept.columns == docs.columns
    rows = kept.collect()
    classes = {c for _, c, _ in plain([x for x in odd_docs if op.WORDS.search(x[1] or "")])}
    with_words = [r for r in rows if op.WORDS.search(r.text or "")]
    assert len(with_words) == len(classes) and {r.doc_id for r in with_words} <= classes
    assert sum(not op.WORDS.search(t or "") for _, t in odd_docs) == len(rows) - len(with_words)


def test_empty_table(spark, none):
    assert op.op8_near_duplicates(spark, none).count() == 0


def test_short_texts_and_case(spark):
    rows = [(1, "a b"), (2, "a  b"), (3, "a c"), (4, ""), (5, ""), (6, "A b")]
    assert run(spark, rows) == sorted([(1, 1, 1), (2, 1, 1), (3, 3, 0), (4, 4, 0), (5, 5, 0), (6, 6, 0)], key=str)


def test_recall_of_the_forest():
    p = float(op.THRESHOLD)
    assert 1 - (1 - p ** op.DEPTH) ** op.TREES >= op.TARGET_RECALL > 1 - (1 - p ** (op.DEPTH + 1)) ** op.TREES
    assert op.matched_depth(trees=1) == 1


def test_intersections_by_parts():
    r = np.random.default_rng(3)
    sets = [np.unique(r.integers(0, 400, int(n)).astype(np.uint64)) for n in r.integers(1, 200, 30)]
    want = [[len(np.intersect1d(a, b)) for b in sets] for a in sets]
    got = op.common_shingles(sets, step=17)
    off = ~np.eye(30, dtype=bool)
    assert (got[off] == np.array(want)[off]).all()


def test_empty_blocks_of_a_family(spark, monkeypatch):
    """Families of two to six long texts, cut by their shingles so that hashing leaves some of their blocks empty."""
    r = random.Random(9)
    rows = []
    for f in range(12):
        base = [f"f{f}w{i}" for i in range(200)]
        for _ in range(2 + f % 5):
            w = list(base)
            w[r.randrange(200)] = f"x{len(rows)}"
            rows.append((len(rows), " ".join(w)))
    monkeypatch.setattr(op, "FAMILY_SHINGLES", 150)
    assert run(spark, rows) == plain(rows)


def test_pairs_of_a_cell():
    assert op._across([1, 1], 1, 1).tolist() == [[False, True], [True, False]]
    assert not op._across([1, 1], 0, 1).any() and not op._across([1, 1], 1, 2).any()
    assert op._across([0, 1, 1], 0, 1).tolist() == [[False, True, True], [True, False, False], [True, False, False]]


def test_tries_give_the_nodes_of_every_depth(spark):
    """Sorted keys and shared prefixes against grouping by every prefix."""
    r = random.Random(3)
    rows = [(bytes([i % 256, i // 256]), [b"".join(r.choice([b"\0\0\0a", b"\0\0\0b"]) for _ in range(op.MAX_DEPTH)) for _ in range(op.TREES)])
            for i in range(400)]
    out = op.tries(spark.createDataFrame(rows, "cls binary, keys array<binary>").repartition(3)).collect()
    got = {(x.tree, bytes(x.key), bytes(x.cls)): x.shared for x in out}
    assert len(got) == len(out)
    for depth in range(op.DEPTH, op.MAX_DEPTH + 1):
        nodes = {}
        for cls, keys in rows:
            for tree, key in enumerate(keys):
                nodes.setdefault((tree, key[:4 * depth]), []).append((tree, key, cls))
        want = {x for members in nodes.values() if len(members) > 1 for x in members}
        assert {k for k, shared in got.items() if shared >= depth} == want


def test_prefixes_are_shortened_until_the_target_recall():
    assert op.depths()[0] == op.MAX_DEPTH and op.depths()[-1] == op.DEPTH
    assert all(a > b for a, b in zip(op.depths(), op.depths()[1:]))
    assert op.recall(op.DEPTH) >= op.TARGET_RECALL > op.recall(op.DEPTH + 1)


def test_keys_hold_two_bytes_of_a_value(spark):
    """The stored and shuffled keys: 2 bytes for each value; equal values stay equal."""
    from quarry.llm import op8_near

    docs = spark.createDataFrame([(1, "a b c d e f g"), (2, "a b c d e f g"), (3, None)], "doc_id long, text string")
    keys = {r.doc_id: r["keys"] for r in op8_near.sketch(docs).collect()}
    assert keys[1] == keys[2] and keys[3] is None
    assert len(keys[1]) == op8_near.TREES and {len(k) for k in keys[1]} == {2 * op8_near.MAX_DEPTH}
    m = op8_near.signature(op8_near.shingles("a b c d e f g"))
    assert [int.from_bytes(keys[1][0][2 * i:2 * i + 2]) for i in range(op8_near.MAX_DEPTH)] == [int(v) >> 16 for v in m[:op8_near.MAX_DEPTH]]
