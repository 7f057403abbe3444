"""Operator 8: near-duplicate join by a MinHash LSH forest with exact verification.

Two documents are linked if the Jaccard similarity of their sets of five-word
shingles is at least ``THRESHOLD``. Words are runs without ASCII white space;
a text of one to four words is one shingle.

1. Copies: documents with the same shingle set are one class (an aggregate by
   the digest of the set), so copies are never paired with each other.
2. Forest: every class has a key of ``MAX_DEPTH`` MinHash values (the first
   ``KEY_BYTES`` of each) in each of ``TREES`` tries. A trie is kept as its sorted keys, each with the length of
   the longest prefix that it shares with a neighbour, so the nodes of any depth
   are runs of equal prefixes. Matching begins at the whole keys. As long as a
   pair at the threshold shares a prefix of this length in some tree with less
   than ``TARGET_RECALL``, the prefixes are shortened (by ``SHORTEN``), and only
   nodes that hold classes not yet joined are matched again: near copies meet
   in deep nodes and are no work in the shallow ones that hold many others.
3. Families: within a node, pairs whose MinHash values agree in at least
   ``MIN_AGREE`` places (six standard errors below the mean at the threshold)
   and whose sizes allow the threshold are joined; connected components of
   these pairs are families. A pair at the threshold lies in one family.
4. Verification: within a family every pair is compared exactly on the whole
   shingle sets, so families may only be too large, never wrong.

Buckets and families of any size are cut into blocks of bounded size, and
pairs of blocks are separate tasks that return at most one row per member
(its number of links, and the root of its linked part), never pairs. The
classes of documents are the connected components of the exact links.

Defined results: null texts and texts without a word have no shingles: each
is a class of its own without links. Copies are linked to each other and
share all links, so ``n_links`` counts documents. ``class_id`` is the
smallest doc_id of the class (null ids are passed over). Repeated rows are
copies. An empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import hashlib
import re
from fractions import Fraction

import numpy as np
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.llm.common import WORD, documents, fresh, map_groups, map_rows, stored
from quarry.operators.components import connected_components

SHINGLE = 5
THRESHOLD = Fraction(4, 5)
TREES = 24
MAX_DEPTH = 8
SHORTEN = 4
KEY_BYTES = 2             # leading bytes of a MinHash value in a key: fewer never part what all would join
TARGET_RECALL = 0.99999
SEED = 8
BUCKET_BLOCK = 512        # classes of one bucket that a task compares with as many others
FAMILY_BLOCK = 512        # classes of one family that a task compares with as many others
FAMILY_SHINGLES = 400_000  # and the shingles they may hold together
SALT = 64                 # places of a part's row of results
KNOWN_WORDS = 250_000
WORDS = re.compile(WORD)


def recall(depth: int, threshold: float = float(THRESHOLD), trees: int = TREES) -> float:
    """The chance that a pair at the threshold shares a prefix of ``depth`` values in some tree."""
    return 1 - (1 - threshold ** depth) ** trees


def matched_depth(threshold: float = float(THRESHOLD), trees: int = TREES, target: float = TARGET_RECALL) -> int:
    """The longest prefix by which a pair at the threshold is met with the target probability."""
    depth = MAX_DEPTH
    while depth > 1 and recall(depth, threshold, trees) < target:
        depth -= 1
    return depth


DEPTH = matched_depth()


def depths() -> list[int]:
    """The prefix lengths that are matched, from whole keys on until the target recall is met."""
    return [*range(MAX_DEPTH, DEPTH, -SHORTEN), DEPTH]


N_HASHES = TREES * MAX_DEPTH
# Of N_HASHES values, a pair at the threshold agrees in fewer with a chance below 1e-9.
MIN_AGREE = int(float(THRESHOLD) * N_HASHES - 6 * (N_HASHES * float(THRESHOLD) * (1 - float(THRESHOLD))) ** 0.5)

_draw = np.random.default_rng(SEED)
TURN = _draw.integers(0, 1 << 32, N_HASHES, dtype=np.uint64).astype(np.uint32)
FACTOR = _draw.integers(0, 1 << 32, N_HASHES, dtype=np.uint64).astype(np.uint32) | np.uint32(1)
POWERS = _draw.integers(0, 1 << 63, SHINGLE, dtype=np.uint64) | np.uint64(1)


class _Words(dict):
    """word -> 64-bit hash."""

    def __missing__(self, word: str) -> int:
        if len(self) >= KNOWN_WORDS:
            self.clear()
        self[word] = h = xxhash.xxh3_64_intdigest(word.encode())
        return h


_WORDS = _Words()


def shingles(text: str | None) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the five-word shingles."""
    w = np.array(list(map(_WORDS.__getitem__, WORDS.findall(text))) if text else [], np.uint64)
    n = len(w) - SHINGLE + 1
    if not len(w):
        return w
    if n < 1:
        h = np.array([xxhash.xxh3_64_intdigest(w.tobytes())], np.uint64)
    else:
        h = np.zeros(n, np.uint64)
        for k in range(SHINGLE):
            h += w[k:k + n] * POWERS[k]
        h ^= h >> np.uint64(29)
        h *= np.uint64(0xBF58476D1CE4E5B9)
        h ^= h >> np.uint64(32)
    return np.unique(h)


def signature(h: np.ndarray, step: int = 4096) -> np.ndarray:
    """MinHash values, tree after tree."""
    x = (h >> np.uint64(32)).astype(np.uint32)
    out = np.full(N_HASHES, 0xFFFFFFFF, np.uint32)
    for a in range(0, len(x), step):
        np.minimum(out, ((x[None, a:a + step] ^ TURN[:, None]) * FACTOR[:, None]).min(axis=1), out=out)
    return out


def digest(h: np.ndarray) -> bytes:
    return hashlib.md5(h.tobytes()).digest()


def sketch(docs: DataFrame) -> DataFrame:
    """doc_id, h (hash of the text), cls (digest of the shingle set, null without one),
    n (shingles), keys (one per tree), marks (a byte of every MinHash value)."""
    def run(batches):
        for b in batches:
            out = {"doc_id": b["doc_id"], "h": b["h"], "cls": [], "n": [], "keys": [], "marks": []}
            for t in b["text"]:
                s = shingles(t)
                out["n"].append(len(s))
                if not len(s):
                    out["cls"].append(None)
                    out["keys"].append(None)
                    out["marks"].append(None)
                    continue
                m = signature(s)
                out["cls"].append(digest(s))
                out["keys"].append([k.tobytes() for k in (m >> np.uint32(32 - 8 * KEY_BYTES)).astype(f">u{KEY_BYTES}").reshape(TREES, MAX_DEPTH)])
                out["marks"].append((m >> np.uint32(8)).astype(np.uint8).tobytes())
            yield out
        _WORDS.clear()

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("h"), "text")
    return map_rows(rows, "doc_id long, h long, cls binary, n int, keys array<binary>, marks binary", run)


def _linked_parts(linked: np.ndarray) -> np.ndarray:
    """For every row the smallest row of its connected part; -1 without any link."""
    label = np.full(len(linked), -1)
    for i in np.flatnonzero(linked.any(axis=1)):
        if label[i] >= 0:
            continue
        part = np.zeros(len(linked), bool)
        edge = np.array([i])
        part[i] = True
        while len(edge):
            near = linked[edge].any(axis=0) & ~part
            part |= near
            edge = np.flatnonzero(near)
        label[part] = i
    return label


def _across(block: list[int], b1: int, b2: int) -> np.ndarray:
    """Pairs that the cell (b1, b2) is for: of two blocks those across, of one block all but the diagonal.
    A cell of two blocks may hold rows of one only, if hashing left the other empty: then it has no pairs."""
    b = np.array(block)
    if b1 == b2:
        return ~np.eye(len(b), dtype=bool)
    return b[:, None] != b[None, :]


def cells(rows: DataFrame, key: list[str], n_blocks) -> DataFrame:
    """Every row of a group once for each pair of blocks that its block is in: columns b1 <= b2 and block."""
    other = F.explode(F.sequence(F.lit(0), F.col("__n") - 1)).alias("__o")
    rows = rows.withColumn("__n", n_blocks.cast("int")).withColumn("block", F.pmod(F.xxhash64("cls"), F.col("__n")).cast("int"))
    return (rows.select("*", other).withColumn("b1", F.least("block", "__o")).withColumn("b2", F.greatest("block", "__o"))
            .drop("__o", "__n"))


def bucket_edges(g: dict) -> dict | None:
    """(a, b): the pairs of a bucket that agree enough, as links of each member to one of its part."""
    if len(g["cls"]) < 2:
        return None
    marks = np.frombuffer(b"".join(g["marks"]), np.uint8).reshape(len(g["cls"]), N_HASHES)
    n = np.array(g["n"], np.int64)
    allowed = _across(g["block"], g["b1"][0], g["b2"][0])
    p, q = THRESHOLD.numerator, THRESHOLD.denominator
    family = np.unique(np.array(g["family"], object), return_inverse=True)[1]
    allowed &= family[:, None] != family[None, :]
    allowed &= (np.minimum(n[:, None], n[None, :]) * q >= np.maximum(n[:, None], n[None, :]) * p)
    agree = np.zeros(allowed.shape, bool)
    for a in range(0, len(n), 64):
        agree[a:a + 64] = (marks[a:a + 64, None, :] == marks[None, :, :]).sum(axis=2) >= MIN_AGREE
    root = _linked_parts(agree & allowed)
    own = np.flatnonzero((root >= 0) & (root != np.arange(len(n))))
    return {"a": [g["cls"][i] for i in own], "b": [g["cls"][root[i]] for i in own]}


def family_links(g: dict) -> dict | None:
    """(cls, root, links): exact links of the members of a family's pair of blocks."""
    sets, at = [], {}
    for i, (cls, text) in enumerate(zip(g["cls"], g["text"])):
        s = shingles(text)
        if cls not in at and digest(s) == cls:  # rows that only share the id are passed over
            at[cls] = i
            sets.append(s)
    if len(sets) < 2:
        return None
    names, rows = list(at), list(at.values())
    size = np.array([len(s) for s in sets], np.int64)
    common = common_shingles(sets)
    p, q = THRESHOLD.numerator, THRESHOLD.denominator
    linked = (common * (p + q) >= p * (size[:, None] + size[None, :])) \
        & _across([g["block"][i] for i in rows], g["b1"][0], g["b2"][0])
    root = _linked_parts(linked)
    links = linked @ np.array([g["m"][i] for i in rows], np.int64)
    own = np.flatnonzero(root >= 0)
    return {"cls": [names[i] for i in own], "root": [names[root[i]] for i in own], "links": links[own].tolist()}


def common_shingles(sets: list[np.ndarray], step: int = 8192) -> np.ndarray:
    """Sizes of all pairwise intersections, by products of a bounded part of the incidence matrix at a time."""
    owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    _, at, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    number = np.cumsum(count > 1) - 1
    keep = count[at] > 1
    column, owner = number[at][keep], owner[keep]
    out = np.zeros((len(sets), len(sets)), np.int64)
    order = np.argsort(column, kind="stable")
    column, owner = column[order], owner[order]
    for a in range(0, int(column[-1]) + 1 if len(column) else 0, step):
        lo, hi = np.searchsorted(column, [a, a + step])
        m = np.zeros((len(sets), min(step, int(column[hi - 1]) + 1 - a)), np.float32)
        m[owner[lo:hi], column[lo:hi] - a] = 1
        out += (m @ m.T).astype(np.int64)
    return out


def _prefix(depth: int):
    """The first ``depth`` values of a key, whatever their width."""
    return F.col("key").substr(F.lit(1), (F.length("key") / MAX_DEPTH * depth).cast("int"))


def tries(classes: DataFrame) -> DataFrame:
    """tree, key, cls, shared: the sorted keys of every tree that share a prefix of
    ``DEPTH`` values or more with a neighbour, and the length of the longest."""
    least = DEPTH
    paths = classes.select("cls", F.posexplode("keys").alias("tree", "key"))
    ordered = paths.repartitionByRange("tree", _prefix(least)).sortWithinPartitions("tree", "key")

    def run(batches):
        last: tuple | None = None  # the row before, with what it shares with the one before it

        def common(a: tuple, b: tuple) -> int:
            if a[0] != b[0]:
                return 0
            k, w = 0, len(a[1]) // MAX_DEPTH
            while k < MAX_DEPTH and a[1][w * k:w * (k + 1)] == b[1][w * k:w * (k + 1)]:
                k += 1
            return k

        def columns(rows: list[tuple]) -> dict:
            return {c: [r[i] for r in rows] for i, c in enumerate(("tree", "key", "cls", "shared"))}

        for b in batches:
            out = []
            for row in zip(b["tree"], b["key"], b["cls"]):
                with_last = common(last, row) if last else 0
                if last and max(last[3], with_last) >= least:
                    out.append((*last[:3], max(last[3], with_last)))
                last = (*row, with_last)
            if out:
                yield columns(out)
        if last and last[3] >= least:
            yield columns([last])

    return map_rows(ordered, "tree int, key binary, cls binary, shared int", run)


def near_families(classes: DataFrame) -> DataFrame:
    """cls, family of the classes that are joined with another one."""
    forest = stored(tries(classes), "near-tries")
    joined = labels = None  # pairs of all depths so far; cls, family: those with one family are joined
    for depth in depths():
        paths = forest.filter(F.col("shared") >= depth).select("cls", "tree", _prefix(depth).alias("prefix"))
        paths = (paths.withColumn("family", F.col("cls")) if labels is None
                 else paths.join(labels, "cls", "left").withColumn("family", F.coalesce("family", "cls")))
        # Nodes with classes of two or more families, those with the same members once.
        key = F.xxhash64("cls")
        nodes = (paths.groupBy("tree", "prefix").agg(F.count("*").alias("size"), F.expr("bit_xor(xxhash64(cls))").alias("x"),
                                                     F.min(key).alias("lo"), F.max(key).alias("hi"),
                                                     (F.min("family") != F.max("family")).alias("open"))
                 .filter("open").groupBy("size", "x", "lo", "hi").agg(F.min(F.struct("tree", "prefix")).alias("b"))
                 .select("b.tree", "b.prefix", "size"))
        members = paths.join(nodes, ["tree", "prefix"]).join(classes.select("cls", "n", "marks"), "cls")
        in_nodes = cells(members, ["tree", "prefix"], F.ceil(F.col("size") / BUCKET_BLOCK)).drop("size")
        pairs = map_groups(in_nodes, ["tree", "prefix", "b1", "b2"], "a binary, b binary", bucket_edges)
        if depth == DEPTH:
            joined = pairs if joined is None else joined.unionByName(pairs)
            break
        pairs = stored(pairs, "near-pairs")
        joined = pairs if joined is None else joined.unionByName(pairs)
        # Joined with one and the same class: a cheap label, enough to pass over near copies further up.
        labels = stored(joined.unionByName(joined.select(F.col("b").alias("a"), "b")).groupBy(F.col("a").alias("cls"))
                        .agg(F.min("b").alias("family")), "near-labels")
    return stored(connected_components(joined).withColumnsRenamed({"id": "cls", "label": "family"}), "near-families")


def near_classes(docs: DataFrame) -> DataFrame:
    """One row per row of ``docs``: doc_id, h (hash of the text), class_id, n_links, kept (true for one row of each class)."""
    rows = stored(sketch(docs), "near-sketch")
    with_set = rows.filter(F.col("cls").isNotNull())
    classes = stored(with_set.groupBy("cls").agg(
        F.count("*").alias("m"), F.min("doc_id").alias("least"), F.min(F.struct("doc_id", "h")).alias("rep"),
        F.first("n").alias("n"), F.first("keys").alias("keys"), F.first("marks").alias("marks")), "near-classes")

    families = near_families(classes)

    # Exact links within families, on the whole texts of one document per class.
    own = families.join(classes.select("cls", "m", "n", "rep"), "cls")
    blocks = own.groupBy("family").agg(F.ceil(F.greatest(F.count("*") / FAMILY_BLOCK, F.sum("n") / FAMILY_SHINGLES)).alias("n_blocks"))
    own = own.join(blocks, "family").select("cls", "family", "m", "n_blocks", "rep.doc_id", "rep.h")
    texts = docs.select(F.col("doc_id").cast("long").alias("t_id"), F.xxhash64("text").alias("t_h"), "text")
    own = own.join(texts, F.col("doc_id").eqNullSafe(F.col("t_id")) & (F.col("h") == F.col("t_h"))) \
        .select("cls", "family", "m", "n_blocks", "text")
    in_families = cells(own, ["family"], F.col("n_blocks")).drop("n_blocks")
    links = stored(map_groups(in_families, ["family", "b1", "b2"], "cls binary, root binary, links long", family_links),
                   "near-links")

    label = connected_components(links.select("cls", "root"), "cls", "root").withColumnsRenamed({"id": "cls"})
    counted = links.groupBy("cls").agg(F.sum("links").alias("links"))
    linked = stored(classes.select("cls", "m", "least", "rep").join(label, "cls").join(counted, "cls", "left"), "near-linked")
    # A part may hold most classes: its one row of results is met in SALT places.
    smallest = (linked.groupBy("label").agg(F.min("least").alias("class_id"), F.min("rep").alias("first"))
                .withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALT - 1)))))
    in_parts = linked.withColumn("salt", F.pmod(F.xxhash64("cls"), F.lit(SALT)).cast("int")).join(smallest, ["label", "salt"]).select(
        "cls", "class_id", "first", (F.col("m") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"))
    by_itself = classes.join(linked.select("cls"), "cls", "left_anti").select(
        "cls", F.col("least").alias("class_id"), F.col("rep").alias("first"), (F.col("m") - 1).alias("n_links"))
    info = in_parts.unionByName(by_itself)
    found = with_set.select("doc_id", "h", "cls").join(info, "cls").select(
        "doc_id", "h", "class_id", "n_links", (F.col("doc_id").eqNullSafe(F.col("first.doc_id")) & (F.col("h") == F.col("first.h"))).alias("kept"))
    alone = rows.filter(F.col("cls").isNull()).select(
        "doc_id", "h", F.col("doc_id").alias("class_id"), F.lit(0).cast("long").alias("n_links"), F.lit(True).alias("kept"))
    return found.unionByName(alone)


def one_per_class(docs: DataFrame) -> DataFrame:
    """``docs`` with one row of each class: its smallest id, one of equal rows. Rows without shingles stay."""
    word = WORD.replace("\\", "\\\\")
    columns = [F.col(f"`{c}`") for c in docs.columns]
    i, h, j, t = (fresh(docs.columns, "__") + x for x in "ihjt")
    kept = near_classes(docs).filter("kept").select(F.col("doc_id").alias(i), F.col("h").alias(h)).distinct()
    has_word = F.coalesce(F.expr(f"`text` rlike '{word}'"), F.lit(False))
    d = docs.filter(has_word).select(*columns, F.col("doc_id").cast("long").alias(j), F.xxhash64("text").alias(t))
    some = d.join(kept, F.col(j).eqNullSafe(F.col(i)) & (F.col(t) == F.col(h)), "left_semi").dropDuplicates([j, t]).select(*columns)
    return some.unionByName(docs.filter(~has_word))


def op8_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_classes(documents(spark, sf_dir).select("doc_id", "text")).select("doc_id", "class_id", "n_links")
