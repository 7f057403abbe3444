"""Operator 10: nearest neighbours from randomly rotated one-bit codes.

Index: every vector is turned by a seeded random rotation; the signs of its
direction, packed into 64-bit words, and two numbers (norm, and the length of
the direction's shadow on its code) are kept. Nothing is fitted to the data.

Search: an inner product is estimated from bit counts of the code against the
bit planes of the turned query and scaled by the two numbers; the error of
the estimate is bounded by ``EPSILON`` standard errors. Per query the
``FIRST * (k + 1)`` largest estimates are reranked with the exact product in
double precision on the original vectors; then every vector whose upper bound
reaches the (k + 1)th best of these is.

Shape: vectors are packed in four bytes a component where that keeps their
values; queries against all rows in cells of bounded size (``QUERY_BLOCK`` x
``ROW_BLOCK``), so a row is sent once for every ``QUERY_BLOCK`` queries; a cell returns at most k rows per query, merged by a window
over at most k rows per cell. Equal vectors are one class that carries its
k + 1 smallest ids (found with a limit before the shuffle), so a vector that
a third of all rows share is one row of the index.

Defined results: null vectors, zero vectors and vectors with null or
non-finite components take no part, as query or candidate; vectors are
compared only with those of their own length; rows with a null id take no
part; a repeated (id, vector) row counts once; ties go to the smaller id; a
query with fewer candidates gets them all; an empty table gives an empty
result; other columns are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quarry.llm.common import map_rows, stored
from quarry.session import read_table

K = 20
EPSILON = 2.5
PLANES = 8
FIRST = 5
SEED = 10
QUERY_BLOCK = 16384
ROW_BLOCK = 16384


def rotation(dim: int, seed: int = SEED) -> np.ndarray:
    """A random rotation of the space padded to whole 64-bit words, as dim x padded."""
    padded = -(-dim // 64) * 64
    q, _ = np.linalg.qr(np.random.default_rng([seed, dim]).standard_normal((padded, padded)))
    return q[:dim]


def pack(signs: np.ndarray) -> np.ndarray:
    """Rows of bits as little-endian 64-bit words."""
    return np.packbits(signs, axis=1, bitorder="little").view("<u8")


def encode(x: np.ndarray, turn: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Codes, norms and shadows (inner product of a direction with its own code) of the rows."""
    norm = np.sqrt((x * x).sum(axis=1))
    y = (x / norm[:, None]) @ turn
    return pack(y > 0), norm, np.abs(y).sum(axis=1) / np.sqrt(turn.shape[1])


class Query:
    """One turned query, cut to PLANES bits per component."""

    def __init__(self, q: np.ndarray, turn: np.ndarray):
        self.norm = np.sqrt(q @ q)
        y = (q / self.norm) @ turn
        self.size = len(y)
        self.low = y.min()
        self.step = max((y.max() - self.low) / ((1 << PLANES) - 1), 1e-12)
        level = np.rint((y - self.low) / self.step).astype(np.uint8)
        self.sum = self.low * self.size + self.step * level.sum()
        self.planes = [pack(((level >> k) & 1)[None, :])[0] for k in range(PLANES)]

    def bounds(self, codes, counts, norm, shadow) -> tuple[np.ndarray, np.ndarray]:
        """Estimates of the inner products with all coded rows, and bounds of their errors."""
        dot = self.low * counts
        for k, plane in enumerate(self.planes):
            dot = dot + self.step * (1 << k) * np.bitwise_count(codes & plane).sum(axis=1)
        root = np.sqrt(self.size)
        estimate = (2 * dot - self.sum) / root / shadow
        error = np.sqrt(np.maximum(1 - shadow * shadow, 0)) / shadow * EPSILON / np.sqrt(max(self.size - 1, 1))
        error = error + self.step / 2 * root / shadow  # at most, from cutting the query
        return estimate * norm * self.norm, error * norm * self.norm


def valid(vectors: DataFrame, column: str) -> DataFrame:
    c = F.col(column)
    finite = F.forall(c, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    return vectors.filter(c.isNotNull() & finite & F.exists(c, lambda v: v != 0))


def pack_vector(v: list[float]) -> bytes:
    """Components in four bytes each where they keep their values, else in eight; the length tells which."""
    x = np.array(v, np.float64)
    with np.errstate(over="ignore"):
        narrow = x.astype(np.float32)
    return narrow.tobytes() if (narrow == x).all() else x.tobytes()


def matrix(vectors: list[bytes], dim: int) -> np.ndarray:
    """Packed vectors as rows of doubles."""
    if all(len(v) == 4 * dim for v in vectors):
        return np.frombuffer(b"".join(vectors), np.float32).reshape(-1, dim).astype(np.float64)
    return np.stack([np.frombuffer(v, np.float32 if len(v) == 4 * dim else np.float64).astype(np.float64) for v in vectors])


def packed(vectors: DataFrame, row_id: str, column: str) -> DataFrame:
    """row_id, vector (packed), dim: valid rows with an id, equal ones once."""
    rows = valid(vectors.select(F.col(row_id).cast("long").alias("row_id"), F.col(column).cast("array<double>").alias("vector"))
                 .filter("row_id is not null"), "vector")

    def run(batches):
        for b in batches:
            yield {"row_id": b["row_id"], "vector": [pack_vector(v) for v in b["vector"]], "dim": [len(v) for v in b["vector"]]}

    return map_rows(rows, "row_id long, vector binary, dim int", run).distinct()


def build_index(vectors: DataFrame, column: str = "embedding", k: int = K) -> DataFrame:
    """One row per distinct vector: ids (its k + 1 smallest), vector, dim, code, norm, shadow."""
    smallest = Window.partitionBy("vector", "dim").orderBy("row_id")
    classes = (packed(vectors, "vec_id", column).withColumn("n", F.row_number().over(smallest)).filter(F.col("n") <= k + 1)
               .groupBy("vector", "dim").agg(F.sort_array(F.collect_list("row_id")).alias("ids")))

    def run(batches):
        for b in batches:
            n = len(b["ids"])
            code, norm, shadow = [b""] * n, [0.0] * n, [0.0] * n
            by_dim: dict[int, list[int]] = {}
            for i, dim in enumerate(b["dim"]):
                by_dim.setdefault(dim, []).append(i)
            for dim, at in by_dim.items():
                c, s, f = encode(matrix([b["vector"][i] for i in at], dim), rotation(dim))
                for i, ci, si, fi in zip(at, c, s.tolist(), f.tolist()):
                    code[i], norm[i], shadow[i] = ci.tobytes(), si, fi
            yield {**b, "code": code, "norm": norm, "shadow": shadow}

    return map_rows(classes, "vector binary, dim int, ids array<long>, code binary, norm double, shadow double", run)


RESULT = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.float64())])


def _cell(k: int):
    def run(queries: pa.Table, rows: pa.Table) -> pa.Table:
        out: dict[str, list] = {n: [] for n in RESULT.names}
        if queries.num_rows and rows.num_rows:
            dim = queries["dim"][0].as_py()
            turn = rotation(dim)
            x, q = matrix(rows["vector"].to_pylist(), dim), matrix(queries["vector"].to_pylist(), dim)
            ids = rows["ids"].to_pylist()
            codes = np.frombuffer(b"".join(rows["code"].to_pylist()), "<u8").reshape(len(ids), -1)
            counts = np.bitwise_count(codes).sum(axis=1)
            norm, shadow = rows["norm"].to_numpy(), rows["shadow"].to_numpy()
            for query_id, v in zip(queries["query_id"].to_pylist(), q):
                estimate, error = Query(v, turn).bounds(codes, counts, norm, shadow)
                chosen = choose(estimate, error, x, v, k)
                score = (x[chosen] * v).sum(axis=1)
                best = sorted((-s, i) for s, c in zip(score.tolist(), chosen.tolist())
                              for i in ids[c] if i != query_id)[:k] if len(chosen) <= 4 * k else \
                    _best(score, chosen, ids, query_id, k)
                out["query_id"] += [query_id] * len(best)
                out["vec_id"] += [i for _, i in best]
                out["score"] += [-s for s, _ in best]
        return pa.table(out, schema=RESULT)

    return run


def choose(estimate: np.ndarray, error: np.ndarray, x: np.ndarray, v: np.ndarray, k: int) -> np.ndarray:
    """Rows to rerank. The query's own class may be lost to the query itself: k + 1 classes are wanted."""
    if len(estimate) <= FIRST * (k + 1):
        return np.arange(len(estimate))
    first = np.argpartition(estimate, -FIRST * (k + 1))[-FIRST * (k + 1):]
    least = np.partition((x[first] * v).sum(axis=1), -k - 1)[-k - 1]
    reach = estimate + error >= least
    reach[first] = True
    return np.flatnonzero(reach)


def _best(score: np.ndarray, chosen: np.ndarray, ids: list, query_id: int, k: int) -> list[tuple[float, int]]:
    """The k best of many: only classes that reach the (k + 1)th score can hold one."""
    least = np.partition(score, len(score) - k - 1)[len(score) - k - 1]
    keep = np.flatnonzero(score >= least)
    return sorted((-s, i) for s, c in zip(score[keep].tolist(), chosen[keep].tolist())
                  for i in ids[c] if i != query_id)[:k]


def search(index: DataFrame, queries: DataFrame, k: int = K) -> DataFrame:
    """queries(row_id, vector, dim) as ``packed`` gives them -> query_id, rank, vec_id, score."""
    cores = index.sparkSession.sparkContext.defaultParallelism
    n_queries, n_rows = queries.count(), index.count()
    nq, nr = max(1, -(-n_queries // QUERY_BLOCK)), max(1, -(-n_rows // ROW_BLOCK), min(cores, n_rows // 1024))
    q = (queries.withColumnRenamed("row_id", "query_id").withColumn("q", F.pmod(F.xxhash64("query_id"), F.lit(nq)).cast("int"))
         .withColumn("r", F.explode(F.sequence(F.lit(0), F.lit(nr - 1)))))
    r = (index.withColumn("r", F.pmod(F.xxhash64("vector"), F.lit(nr)).cast("int"))
         .withColumn("q", F.explode(F.sequence(F.lit(0), F.lit(nq - 1)))))
    cells = q.groupBy("dim", "q", "r").cogroup(r.groupBy("dim", "q", "r"))
    found = cells.applyInArrow(_cell(k), "query_id long, vec_id long, score double")
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    return (found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
            .select("query_id", "rank", "vec_id", "score"))


def op10_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = read_table(spark, sf_dir, "embeddings")
    index = stored(build_index(vectors), "ann-index")
    queries = packed(vectors.filter("vec_id % 20 = 0"), "vec_id", "embedding")
    return search(index, queries)
