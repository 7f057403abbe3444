"""Operator 11: hard negatives by bounds along a spanning tree of anchors.

Vectors become integers (floor of 256 x component); a row's score is its inner
product with the anchor. Anchors that lie near each other have close scores:
with anchors p and c at distance d, the scores of a row of norm n differ by at
most d n. So a block of anchors is joined by its minimum spanning tree, the
root is scored against all rows of a cell, and going down the tree each row's
interval at the parent, widened by d n, bounds its score at the child. Only
rows whose interval meets what the child still looks for are scored again:

* positives, among rows of the anchor's label: intervals that reach the least
  score which surely belongs to the first ones;
* negatives, among rows of other labels: intervals that meet a window
  [80 %, 100 %] of a positive's score and reach the least score which surely
  belongs to the first ones of that window.

An interval of a row that is scored again shrinks to a point, so intervals
stay as tight as they were needed. Nothing is estimated: results are exact.
On vectors without structure (the given ones) the tree's edges are as long as
the vectors, all intervals meet all windows, and every row is scored.

Shape: the anchors are a stated share of the rows and meet all rows in cells
of bounded size (``ANCHOR_BLOCK`` x ``ROW_BLOCK``), as packed integers. Blocks
of anchors are cut from an order by sign codes, so that near anchors share a
tree. A cell returns at most ``FIRST`` rows for each anchor (or window), merged
by a window with a limit. Equal vectors of one label are one class with its
``FIRST`` + 1 smallest ids, chosen before the shuffle. While a tree is walked,
children with the most descendants come last, so at most log2 of a tree's
anchors hold their intervals at a time.

Defined results: rows with a null id, label or vector or a null or non-finite
component take no part; an id names one row: of several different ones the
least (label, vector) counts, equal ones count once; vectors of another length
are no candidates of an anchor; components outside 64-bit range saturate, and
so may products beyond it wrap; ties go to the smaller id; an anchor without
positives, or a positive without negatives in its window, gives no row (so a
negative positive score gives none); an empty table gives an empty result;
other columns are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quarry.llm.common import map_rows, stored
from quarry.operators.split import with_row_index
from quarry.session import read_table

SCALE = 256
FIRST = 5            # positives of an anchor, and negatives of a positive
LOW, HIGH = 80, 100  # the window of a negative's score, in per cent of the positive's
ANCHOR_BLOCK = 16_384
ROW_BLOCK = 131_072
TREE_ANCHORS = 1_024
NEAR_BITS = 16
EXACT = 2.0 ** 53


def pack(v: list[int]) -> bytes:
    """Components as the narrowest integers that hold them; the length tells which."""
    a = np.array(v, np.int64)
    small = len(a) == 0 or (a.min() >= -(1 << 15) and a.max() < 1 << 15)
    return a.astype("<i2" if small else "<i8").tobytes()


def matrix(vectors: list[bytes], dim: int) -> np.ndarray:
    """Packed vectors as rows of doubles, or of integers if a product may not be exact in doubles."""
    if not dim or not vectors:
        return np.zeros((len(vectors), dim))
    narrow = all(len(v) == 2 * dim for v in vectors)
    if narrow:
        return np.frombuffer(b"".join(vectors), "<i2").reshape(-1, dim).astype(float)
    return np.stack([np.frombuffer(v, "<i2" if len(v) == 2 * dim else "<i8") for v in vectors]).astype(np.int64)


def norms(x: np.ndarray) -> np.ndarray:
    x = x.astype(float)
    return np.sqrt((x * x).sum(axis=1))


def prepared(vectors: DataFrame, column: str = "embedding") -> DataFrame:
    """vec_id, label, dim, vec, near: valid rows with packed integer vectors, one per id."""
    c = F.col(column)
    whole = F.forall(c, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    rows = vectors.filter(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & c.isNotNull() & whole).select(
        F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"),
        F.transform(c, lambda v: F.floor(v.cast("double") * SCALE).cast("long")).alias("v"))
    planes: dict[int, np.ndarray] = {}

    def run(batches):
        for b in batches:
            near = []
            for v in b["v"]:
                if len(v) not in planes:
                    planes[len(v)] = np.random.default_rng([11, len(v)]).standard_normal((NEAR_BITS, len(v)))
                near.append(int(((planes[len(v)] @ np.array(v, float) > 0) << np.arange(NEAR_BITS)).sum()))
            yield {"vec_id": b["vec_id"], "label": b["label"], "dim": [len(v) for v in b["v"]],
                   "vec": [pack(v) for v in b["v"]], "near": near}

    packed = map_rows(rows, "vec_id long, label long, dim int, vec binary, near int", run)
    return packed.groupBy("vec_id").agg(F.min(F.struct("label", "dim", "vec", "near")).alias("r")).select("vec_id", "r.*")


def classes(rows: DataFrame) -> DataFrame:
    """label, dim, vec, ids: one row per label and vector, with its smallest ids (one may be the anchor's own)."""
    smallest = Window.partitionBy("label", "dim", "vec").orderBy("vec_id")
    return (rows.select("vec_id", "label", "dim", "vec").withColumn("n", F.row_number().over(smallest)).filter(F.col("n") <= FIRST + 1)
            .groupBy("label", "dim", "vec").agg(F.sort_array(F.collect_list("vec_id")).alias("ids")))


# --- the tree -------------------------------------------------------------------------------

def spanning_tree(q: np.ndarray) -> tuple[list[int], np.ndarray]:
    """Parent of every row (-1: the root, row 0) and the length of the edge to it, by Prim's method."""
    n = len(q)
    q = q.astype(float)
    parent, length = [-1] * n, np.zeros(n)
    near, reach = np.zeros(n, int), np.sqrt(((q - q[0]) ** 2).sum(axis=1))
    out = np.ones(n, bool)
    out[0] = False
    for _ in range(n - 1):
        k = int(np.argmin(np.where(out, reach, np.inf)))
        parent[k], length[k], out[k] = int(near[k]), reach[k], False
        d = np.sqrt(((q - q[k]) ** 2).sum(axis=1))
        closer = out & (d < reach)
        reach[closer], near[closer] = d[closer], k
    return parent, length


def walk_order(parent: list[int]) -> list[tuple[int, bool]]:
    """Rows from the root down, children with more descendants later; the flag
    says whether the row is its parent's last child."""
    children: dict[int, list[int]] = {}
    for k, p in enumerate(parent):
        children.setdefault(p, []).append(k)
    down, todo = [], list(children[-1])
    while todo:
        k = todo.pop()
        down.append(k)
        todo += children.get(k, ())
    size = [1] * len(parent)
    for k in reversed(down):
        if parent[k] >= 0:
            size[parent[k]] += size[k]
    order, todo = [], [(children[-1][0], True)]
    while todo:
        k, last = todo.pop()
        order.append((k, last))
        own = sorted(children.get(k, ()), key=lambda c: -size[c])
        todo += [(c, i == 0) for i, c in enumerate(own)]
    return order


def walk(q: np.ndarray, x: np.ndarray, wanted):
    """For every row of ``q``, in tree order: (row of q, rows of x that were
    scored, their scores). ``wanted(row, low, high)`` chooses them from the bounds."""
    parent, length = spanning_tree(q)
    size, q_size = norms(x), norms(q)
    exact = not len(q) or not len(x) or (x.dtype == float and q.dtype == float and q_size.max() * size.max() < EXACT)
    if not exact:
        x, q = x.astype(np.int64), q.astype(np.int64)
    held: dict[int, tuple[np.ndarray, np.ndarray]] = {}
    for k, last in walk_order(parent):
        p = parent[k]
        if p < 0:
            chosen = np.arange(len(x))
            low, high = np.full(len(x), -np.inf), np.full(len(x), np.inf)
        else:
            a, b = held.pop(p) if last else held[p]
            slack = length[k] * size * (1 + 1e-9) + 1e-6
            most = q_size[k] * size * (1 + 1e-9) + 1e-6
            low, high = np.maximum(a - slack, -most), np.minimum(b + slack, most)
            chosen = wanted(k, low, high)
        score = (x @ q[k])[chosen] if 3 * len(chosen) > len(x) else x[chosen] @ q[k]
        low[chosen] = high[chosen] = score
        held[k] = low, high
        yield k, chosen, score.astype(np.int64)


def largest(values: np.ndarray, n: int) -> float:
    """The n-th largest, or minus infinity if there are fewer."""
    return np.partition(values, len(values) - n)[len(values) - n] if len(values) >= n else -np.inf


def best(chosen: np.ndarray, score: np.ndarray, ids: list, own: int) -> list[tuple[int, int]]:
    """The first (score, id) of scored classes, without the anchor's own id (which may be all a class has)."""
    keep = score >= largest(score, FIRST + 1)
    found = sorted((-s, i) for s, c in zip(score[keep].tolist(), chosen[keep].tolist()) for i in ids[c] if i != own)
    return [(-s, i) for s, i in found[:FIRST]]


def surely_first(low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """Rows that may be among the first FIRST + 1."""
    return np.flatnonzero(high >= largest(low, FIRST + 1))


# --- cells ----------------------------------------------------------------------------------

def _trees(anchors: dict, at: list[int]):
    for a in range(0, len(at), TREE_ANCHORS):
        part = at[a:a + TREE_ANCHORS]
        yield part, matrix([anchors["vec"][i] for i in part], anchors["dim"][0])


POSITIVES = pa.schema([("anchor_id", pa.int64()), ("positive_id", pa.int64()), ("positive_score", pa.int64())])


def positives_cell(anchors: pa.Table, rows: pa.Table) -> pa.Table:
    out: list[tuple[int, int, int]] = []
    if anchors.num_rows and rows.num_rows:
        anchors, rows = anchors.sort_by("place").to_pydict(), rows.to_pydict()
        by_label: dict[int, list[int]] = {}
        for i, label in enumerate(anchors["label"]):
            by_label.setdefault(label, []).append(i)
        of_label: dict[int, list[int]] = {}
        for i, label in enumerate(rows["label"]):
            of_label.setdefault(label, []).append(i)
        for label, at in by_label.items():
            own = of_label.get(label, [])
            x, ids = matrix([rows["vec"][i] for i in own], rows["dim"][0]), [rows["ids"][i] for i in own]
            for part, q in _trees(anchors, at):
                for k, chosen, score in walk(q, x, lambda _, low, high: surely_first(low, high)):
                    anchor = anchors["anchor_id"][part[k]]
                    out += [(anchor, i, s) for s, i in best(chosen, score, ids, anchor)]
    return pa.table([pa.array(c, pa.int64()) for c in zip(*out)] if out else [pa.array([], pa.int64())] * 3, schema=POSITIVES)


def least_of(score: int) -> int:
    """The least negative score of a positive's window."""
    return -(-LOW * score // 100)


def in_windows(scores: list[int], low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """Rows whose interval meets a window and may be among its first."""
    reach = np.zeros(len(low), bool)
    for s in scores:
        floor = least_of(s)
        inside = low[(low >= floor) & (high <= s)]
        reach |= (low <= s) & (high >= max(floor, largest(inside, FIRST)))
    return np.flatnonzero(reach)


NEGATIVES = pa.schema([("anchor_id", pa.int64()), ("positive_score", pa.int64()),
                       ("negative_id", pa.int64()), ("negative_score", pa.int64())])


def negatives_cell(anchors: pa.Table, rows: pa.Table) -> pa.Table:
    out: list[tuple[int, int, int, int]] = []
    if anchors.num_rows and rows.num_rows:
        anchors, rows = anchors.sort_by("place").to_pydict(), rows.to_pydict()
        x, ids, label = matrix(rows["vec"], rows["dim"][0]), rows["ids"], np.array(rows["label"])
        for part, q in _trees(anchors, list(range(len(anchors["label"])))):
            def wanted(k, low, high):
                other = label != anchors["label"][part[k]]
                return in_windows(anchors["scores"][part[k]], np.where(other, low, np.inf), np.where(other, high, np.inf))

            for k, chosen, score in walk(q, x, wanted):
                anchor = anchors["anchor_id"][part[k]]
                other = label[chosen] != anchors["label"][part[k]]
                for s in anchors["scores"][part[k]]:
                    fits = other & (score >= least_of(s)) & (score <= s)
                    out += [(anchor, s, i, n) for n, i in best(chosen[fits], score[fits], ids, anchor)]
    return pa.table([pa.array(c, pa.int64()) for c in zip(*out)] if out else [pa.array([], pa.int64())] * 4, schema=NEGATIVES)


def _cells(anchors: DataFrame, index: DataFrame, n_anchors: int, n_rows: int, cell, schema: str) -> DataFrame:
    """``cell`` on every block of anchors with every block of rows."""
    cores = index.sparkSession.sparkContext.defaultParallelism
    na = max(1, -(-n_anchors // ANCHOR_BLOCK))
    nr = max(1, -(-n_rows // ROW_BLOCK), min(cores, n_rows // 1024))
    a = (anchors.withColumn("a", (F.col("place") / ANCHOR_BLOCK).cast("int"))
         .withColumn("r", F.explode(F.sequence(F.lit(0), F.lit(nr - 1)))))
    r = (index.withColumn("r", F.pmod(F.xxhash64("label", "vec"), F.lit(nr)).cast("int"))
         .withColumn("a", F.explode(F.sequence(F.lit(0), F.lit(na - 1)))))
    return a.groupBy("dim", "a", "r").cogroup(r.groupBy("dim", "a", "r")).applyInArrow(cell, schema)


def _first(found: DataFrame, group: list[str], score: str, vec_id: str, rank: str) -> DataFrame:
    order = Window.partitionBy(*group).orderBy(F.col(score).desc(), vec_id)
    return found.withColumn(rank, F.row_number().over(order)).filter(F.col(rank) <= FIRST)


def mine(rows: DataFrame, is_anchor) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score
    from ``prepared`` rows; ``is_anchor`` is a condition on them."""
    index = stored(classes(rows), "negatives-index")
    anchors = stored(with_row_index(rows.filter(is_anchor), ["near", "vec_id"], "place")
                     .select(F.col("vec_id").alias("anchor_id"), "label", "dim", "vec", "place"), "negatives-anchors")
    size = anchors.count(), index.count()
    found = _cells(anchors, index, *size, positives_cell, "anchor_id long, positive_id long, positive_score long")
    positives = stored(_first(found, ["anchor_id"], "positive_score", "positive_id", "n").drop("n"), "negatives-positives")
    windows = positives.filter("positive_score >= 0").groupBy("anchor_id").agg(F.sort_array(F.collect_set("positive_score")).alias("scores"))
    found = _cells(anchors.join(windows, "anchor_id"), index, *size, negatives_cell,
                   "anchor_id long, positive_score long, negative_id long, negative_score long")
    negatives = _first(found, ["anchor_id", "positive_score"], "negative_score", "negative_id", "rank")
    return positives.join(negatives, ["anchor_id", "positive_score"]).select(
        "anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = read_table(spark, sf_dir, "embeddings")
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    rows = stored(prepared(vectors.withColumn("label", label)), "negatives-rows")
    return mine(rows, F.col("vec_id") % 100 == 0)
