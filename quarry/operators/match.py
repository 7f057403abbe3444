"""Issue keywords x tag index, prompts and query rewriting (T5, T6, J3, P8,
P9, W1, R1, R2).

``match_tags`` counts, for every (request, tag) of the same snapshot, how
many of the request's keywords occur in the tag's pattern line (substring,
case-sensitive), keeps tags with at least ``min_hits`` and returns the
best ``k`` per request.

Substring matching is a theta join. It runs in cells: the requests and the
tags of a snapshot are cut into blocks of bounded size, and every pair of
blocks is a cell of a cogroup. A cell builds one automaton of its requests'
keywords and runs it once over its tag lines: over the distinct identifier
runs of the lines for keywords that are identifiers (they occur only inside
a run), over whole lines for the others. Hits are counted inside the cell,
which gives back at most ``k`` tags per request; a second top-k joins the
cells. What is shuffled are requests, tags and the cells' few rows, never a
row per hit; a hot snapshot is more cells. Requests and tags are shuffled
once, and their shuffle files go before the cells' rows are shuffled.
"""

from __future__ import annotations

import re
import time
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from quarry.functions.text import keywords as keywords_expr
from quarry.session import stored


def with_keywords(requests: DataFrame, text: str = "problem_statement",
                  stop_words: list[str] | None = None) -> DataFrame:
    """T4 + P9: ``keywords`` and ``keyword_num`` columns."""
    return (requests.withColumn("keywords", keywords_expr(text, stop_words))
            .withColumn("keyword_num", F.size("keywords")))


# Requests and tags of one cell, about: blocks are dealt by a hash.
REQUEST_BLOCK = 512
TAG_BLOCK = 8192
HELD_CELLS = 1 << 20  # hits that a task counts at once
MANY_SNAPSHOTS = 200_000  # whose block counts are broadcast, at most
IDENT_RUN = re.compile(r"[A-Za-z0-9_]+")


class KeywordIndex:
    """The keywords of a block of requests, and which requests hold each."""

    def __init__(self, keywords: list[list[str]]):
        import ahocorasick

        ids: dict[str, int] = {}
        pairs = [(ids.setdefault(kw, len(ids)), r) for r, own in enumerate(keywords) for kw in set(own) if kw is not None]
        held = np.array(sorted(pairs), np.int64).reshape(-1, 2)
        self.requests = held[:, 1]
        self.first = np.searchsorted(held[:, 0], np.arange(len(ids) + 1))
        self.n = len(keywords)
        self.automata = {}
        for in_runs in (True, False):
            automaton = ahocorasick.Automaton()
            for kw, i in ids.items():
                if bool(IDENT_RUN.fullmatch(kw)) == in_runs:
                    automaton.add_word(kw, i)
            if len(automaton):
                automaton.make_automaton()
                self.automata[in_runs] = automaton
        self.of_run: dict[str, list[int]] = {}

    def _found(self, in_runs: bool, text: str) -> set[int]:
        automaton = self.automata.get(in_runs)
        return {i for _, i in automaton.iter(text)} if automaton else set()

    def _of_line(self, line: str) -> set[int]:
        found = self._found(False, line)
        if True in self.automata:
            of_run = self.of_run
            for run in set(IDENT_RUN.findall(line)):
                own = of_run.get(run)
                if own is None:
                    own = of_run[run] = list(self._found(True, run))
                if own:
                    found.update(own)
        return found

    def hits(self, lines: list[str]) -> np.ndarray:
        """How many keywords of each request (column) occur in each line (row)."""
        out = np.zeros((len(lines), self.n), np.int32)
        held = np.zeros((len(self.first) - 1, self.n), np.int32)
        held[np.repeat(np.arange(len(held)), np.diff(self.first)), self.requests] = 1
        rows, ends, kws = [], [0], []

        def add() -> None:
            if rows:
                out[rows] = np.add.reduceat(held[np.array(kws, np.int64)], ends[:-1], axis=0)
            rows.clear(), kws.clear(), ends.clear(), ends.append(0)

        for i, line in enumerate(lines):
            if found := self._of_line(line):
                rows.append(i)
                kws.extend(found)
                ends.append(len(kws))
                if len(kws) * self.n > HELD_CELLS:
                    add()
        add()
        return out


def _order(row: tuple) -> tuple:
    """Nulls first, then by value, as Spark sorts."""
    return tuple((x is not None, x) for x in row)


def _best_tags(min_hits: int, k: int, names: list[str], schema: pa.Schema):
    def cell(requests: pa.Table, tags: pa.Table) -> pa.Table:
        if not requests.num_rows or not tags.num_rows:
            return schema.empty_table()
        keys = sorted(zip(*(tags[c].to_pylist() for c in names), tags["pattern"].to_pylist()), key=_order)
        index = KeywordIndex([kws or [] for kws in requests["keywords"].to_pylist()])
        hits = np.ascontiguousarray(index.hits([row[-1] for row in keys]).T).astype(np.int64)
        # Of equal hits the earlier tag: one number says both.
        worth = hits * len(keys) - np.arange(len(keys))
        worth[(hits < min_hits) | (hits == 0)] = -len(keys)
        kept = np.argpartition(-worth, k - 1, axis=1)[:, :k] if k < len(keys) else np.broadcast_to(np.arange(len(keys)), hits.shape)
        r, at = np.nonzero(np.take_along_axis(worth, kept, 1) > -len(keys))
        tag = kept[r, at]
        order = np.argsort(tag, kind="stable")  # line by line: a line of many requests is stored about once
        r, tag = r[order], tag[order]
        ids = requests.column(0).take(pa.array(r))
        rows = [keys[t] for t in tag.tolist()]
        columns = [ids, *(pa.array([row[i] for row in rows], schema.field(i + 1).type) for i in range(len(names) + 1)),
                   pa.array(hits[r, tag], pa.int64())]
        return pa.table(columns, schema=schema)

    return cell


def _blocks(df: DataFrame, size: int, key: list[str], name: str) -> tuple[DataFrame, DataFrame]:
    """(rows with their block of about ``size`` rows of a snapshot, snapshots with the numbers of their blocks)."""
    counts = stored(df.groupBy("save_path").agg(F.ceil(F.count(F.lit(1)) / size).cast("int").alias(f"n_{name}")), "match-blocks")
    rows = _with_counts(df, counts).withColumn(name, F.pmod(F.xxhash64(*key), F.col(f"n_{name}")).cast("int"))
    return rows.drop(f"n_{name}"), counts


def _with_counts(df: DataFrame, counts: DataFrame) -> DataFrame:
    """The join with a row per snapshot: requests and lines are shuffled for it only if the snapshots are many."""
    if counts.count() <= MANY_SNAPSHOTS:
        return df.join(F.broadcast(counts), "save_path")
    return df.hint("merge").join(counts, "save_path")


def match_tags(requests: DataFrame, tags: DataFrame, *, min_hits: int = 3, k: int = 10,
               request_id: str = "request_id") -> DataFrame:
    """J3/T6/P8/W1.

    ``requests``: request_id, save_path, keywords (read several times here, not by
    the result: give a stored table), each keyword at least three characters, as produced by
    ``keywords``; a shorter one is refused with an error.
    ``tags``: save_path, path, line, name, pattern.
    Returns request_id, save_path, path, line, name, pattern, hits, rank; ties
    go to the smaller (path, line, name). A keyword counts once per request
    and tag; requests or tags with a null save_path, and tags with a null
    pattern, match nothing.
    """
    names = ["path", "line", "name"]
    refuse = F.raise_error(F.lit("match_tags: a keyword has fewer than three characters")).cast("array<string>")
    asked = requests.where(F.size("keywords") > 0).select(
        request_id, "save_path", F.when(F.exists("keywords", lambda w: F.length(w) < 3), refuse).otherwise(F.col("keywords")).alias("keywords"))
    kept = (tags.where(~F.col("pattern").contains("test") & ~F.col("pattern").contains("Test"))
            .select("save_path", *names, "pattern"))
    left, n_left = _blocks(asked, REQUEST_BLOCK, [request_id], "a")
    right, n_right = _blocks(kept, TAG_BLOCK, [*names, "pattern"], "b")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    left = _with_counts(left, n_right).withColumn("b", every("n_b")).drop("n_b")
    right = _with_counts(right, n_left).withColumn("a", every("n_a")).drop("n_a")
    out = T.StructType([requests.schema[request_id], *(tags.schema[c] for c in names),
                        T.StructField("pattern", T.StringType()), T.StructField("hits", T.LongType())])
    by = ["save_path", "a", "b"]
    # Stored: the shuffled requests and lines are gone before the found rows are shuffled.
    found = stored(left.select(request_id, "keywords", *by).groupBy(*by).cogroup(right.groupBy(*by)).applyInArrow(
        _best_tags(min_hits, k, names, to_arrow_schema(out)), out), "match-found")
    home = stored(requests.select(request_id, "save_path"), "match-requests")
    w = Window.partitionBy(request_id).orderBy(F.col("hits").desc(), *names)
    top = found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
    return top.join(home, request_id).select(
        request_id, "save_path", *names, "pattern", "hits", "rank")


# ---------------------------------------------------------------------------
# T5: prompts

DEFAULT_TEMPLATE = (
    "### Task\n"
    "Rewrite the issue below into a search query that retrieves the functions "
    "a fix will touch. Use the tag context when it helps.\n\n"
    "### Issue\n{issue}\n\n"
    "### Tag context\n{context}\n\n"
    "Return only the rewritten query.\n"
)


def render_tag(matched: DataFrame) -> Column:
    return F.concat(F.col("path"), F.lit(":"), F.col("line").cast("string"), F.lit(": "),
                    F.col("pattern"), F.lit(" ("), F.col("hits").cast("string"), F.lit(")"))


def build_prompts(requests: DataFrame, matched: DataFrame, *, template: str = DEFAULT_TEMPLATE,
                  request_id: str = "request_id", text: str = "problem_statement") -> DataFrame:
    """Prompt per request with keywords: the issue text and its matched
    tag lines in rank order (at most k per request, so the per-request
    list is bounded)."""
    before, rest = template.split("{issue}", 1)
    middle, after = rest.split("{context}", 1)
    ctx = (matched.groupBy(request_id)
           .agg(F.array_join(F.transform(
               F.array_sort(F.collect_list(F.struct(F.col("rank"), render_tag(matched).alias("t")))),
               lambda s: s["t"]), "\n").alias("context")))
    return (requests.where(F.col("keyword_num") > 0)
            .join(ctx, request_id, "left")
            .select(request_id,
                    F.concat(F.lit(before), F.col(text), F.lit(middle),
                             F.coalesce("context", F.lit("")), F.lit(after)).alias("prompt")))


# ---------------------------------------------------------------------------
# Model client

class TransportError(Exception):
    """Raised by a client when the request did not reach the service."""


Client = Callable[[str], "tuple[int, str | None]"]


def rewrite_queries(prompts: DataFrame, client_factory: Callable[[], Client], *,
                    retries: int = 3, delay: float = 2.0,
                    request_id: str = "request_id") -> DataFrame:
    """Call ``client(prompt) -> (status, text)`` per row inside
    ``mapInPandas``; the client is built once per task.

    Up to ``retries`` attempts with ``delay`` seconds between them on
    ``TransportError``; a non-200 status stops at once. Failure -> null.
    Returns request_id, rewritten_query, attempts, status.
    """
    schema = T.StructType([
        T.StructField(request_id, prompts.schema[request_id].dataType),
        T.StructField("rewritten_query", T.StringType()),
        T.StructField("attempts", T.LongType()),
        T.StructField("status", T.StringType()),
    ])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        client = client_factory()
        for pdf in batches:
            texts, attempts, statuses = [], [], []
            for prompt in pdf["prompt"]:
                result, status, n = None, "failed", 0
                while n < retries:
                    n += 1
                    try:
                        code, body = client(prompt)
                    except TransportError:
                        if n < retries and delay > 0:
                            time.sleep(delay)
                        continue
                    if code == 200:
                        result, status = body, "ok"
                    else:
                        status = f"http_{code}"
                    break
                texts.append(result)
                attempts.append(n)
                statuses.append(status)
            yield pd.DataFrame({request_id: pdf[request_id], "rewritten_query": texts,
                                "attempts": attempts, "status": statuses})

    return prompts.select(request_id, "prompt").mapInPandas(run, schema)
