"""Operator 13: URL filters by rules and boosted trees over lexical features.

Rules of the form host + path prefix judge the urls they fit; of several the
longest wins. The urls that some rule judges are the labelled ones: boosted
trees learn from them and judge all others.

Features are lexical: lengths, depth, digit ratios, entropies, numbers of
parameters, and suffix statistics. A statistic is kept for the endings of the
host (one, two, three labels), the first path segment and the ending of the
file name: the smoothed log-odds of being blocked, and the share of all
labelled urls. They are counted over every labelled row. A key gets its own
statistic if it holds at least 1 / ``STAT_SHARE`` of the labelled rows, so the
table has at most ``STAT_SHARE`` rows per kind whatever the input; other keys
share one entry. Counts are kept by ``FOLDS`` folds of the url's hash; while
fitting, a url is described by the other folds' counts, so that its own label
is in none of its features.

Fit: on distinct labelled urls drawn by a hash, about ``SAMPLE_URLS`` (the
only bounded part). Scoring is one pass over the url column, no shuffle.

Defined results: a null url or one without ``://`` has an empty host and path,
fits no rule and is judged by the trees like any other; without labelled urls
every score is 0 and the verdict allow, with labels of one kind the score is
near that kind; the rule with the longest host + path wins, then the longer
host, then block; repeated rows repeat; an empty table gives an empty result;
other columns are not read; urls of any length are read whole.
"""

from __future__ import annotations

import math
import zlib
from collections import Counter

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.llm.common import map_rows, share, stored
from quarry.llm.op2_html import Boosted
from quarry.session import read_table

# (host, path, verdict): the contract's rules (fixed values).
RULES = [("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"),
         ("net", "/es/", "block"), ("net", "/fr/", "block")]

SAMPLE_URLS = 20_000
STAT_SHARE = 2_000
FOLDS = 5
PRIOR = 4.0          # weight of the overall share of blocked urls in a statistic
KINDS = ("host1", "host2", "host3", "segment", "ending")
LOWER = {c: c + 32 for c in range(ord("A"), ord("Z") + 1)}


def split_url(url: str | None) -> tuple[str, str]:
    """(host, path); both empty without ``://``."""
    at = url.find("://") if url else -1
    if at < 0:
        return "", ""
    end = len(url)
    for c in "?#":
        k = url.find(c, at + 3, end)
        end = end if k < 0 else k
    slash = url.find("/", at + 3, end)
    slash = end if slash < 0 else slash
    return url[at + 3:slash].translate(LOWER), url[slash:end]


class Rules:
    """Rules by host; a url looks up the endings of its host only."""

    def __init__(self, rules: list[tuple[str, str, str]]):
        self.by_host: dict[str, list[tuple]] = {}
        for host, path, verdict in rules:
            self.by_host.setdefault(host, []).append((len(host) + len(path), len(host), verdict == "block", path, host + path, verdict))
        for own in self.by_host.values():
            own.sort(reverse=True)

    def judge(self, host: str, path: str) -> tuple[str, str] | None:
        """(rule, verdict) of the longest rule that fits."""
        best, at = None, 0
        while host:
            for rule in self.by_host.get(host[at:], ()):
                if path.startswith(rule[3]):
                    best = max(best, rule) if best else rule
                    break
            at = host.find(".", at) + 1
            if not at:
                break
        return (best[4], best[5]) if best else None


def keys(host: str, path: str) -> list[str]:
    """The keys of a url's statistics, in the order of KINDS."""
    labels = host.split(".")
    parts = path.split("/")
    dot = parts[-1].rfind(".")
    own = (".".join(labels[-1:]), ".".join(labels[-2:]), ".".join(labels[-3:]),
           parts[1] if len(parts) > 2 else "", parts[-1][dot:] if dot >= 0 else "")
    return [f"{k}:{v}" for k, v in zip(KINDS, own)]


def entropy(s: str) -> float:
    n = len(s)
    return -sum(c / n * math.log2(c / n) for c in Counter(s).values()) if n else 0.0


def lexical(url: str | None, host: str, path: str) -> list[float]:
    url = url or ""
    query = url.partition("#")[0].partition("?")[2]
    labels = host.split(".")
    digits = sum(map(str.isdigit, url))
    return [len(url), len(host), len(path), len(query), len(labels), max(map(len, labels)),
            sum(1 for p in path.split("/") if p), sum(1 for p in query.split("&") if p), query.count("="),
            digits / max(1, len(url)), sum(map(str.isdigit, host)) / max(1, len(host)),
            host.count("-"), path.count("-") + path.count("_"), url.count("%"),
            entropy(host), entropy(path), float(url.startswith("https")), float("#" in url), float(path.endswith("/"))]


class Statistics:
    """key -> (labelled urls, blocked ones) by fold, the last entry of all folds;
    rare keys of a kind share one entry."""

    def __init__(self, table: dict[str, np.ndarray], total: float, blocked: float):
        self.table, self.total = table, total
        self.mean = blocked / total if total else 0.0

    def features(self, own: list[str], fold: int | None = None) -> list[float]:
        out = []
        for key in own:
            found = self.table.get(key)
            counts = found if found is not None else self.table.get(key.split(":", 1)[0] + "?")
            n, y = (0.0, 0.0) if counts is None else counts[-1] if fold is None else counts[-1] - counts[fold]
            p = (y + PRIOR * self.mean + 1e-3) / (n + PRIOR + 2e-3)
            out += [math.log(p / (1 - p)), (0.0 if found is None else found[-1][0]) / max(1.0, self.total)]
        return out


def fold_of(url: str) -> int:
    return zlib.crc32(url.encode("utf-8", "surrogatepass")) % FOLDS


class Judge:
    """Rules, statistics and trees."""

    def __init__(self, rules: Rules, statistics: Statistics, trees: Boosted | None):
        self.rules, self.statistics, self.trees = rules, statistics, trees
        self.alone = 0.0  # the score of all urls while there are no trees

    def row(self, url: str | None, host: str, path: str, fold: int | None = None) -> list[float]:
        return lexical(url, host, path) + self.statistics.features(keys(host, path), fold)

    def scores(self, urls: list, split: list[tuple[str, str]]) -> np.ndarray:
        """Probability of block by the trees."""
        if not urls or self.trees is None:
            return np.full(len(urls), self.alone)
        return 1 / (1 + np.exp(-self.trees.log_odds(np.array([self.row(u, *s) for u, s in zip(urls, split)]))))


def count_keys(urls: DataFrame, column: str, rules: Rules) -> DataFrame:
    """key, fold, n, y over all urls that a rule judges; each batch counts before anything is shuffled."""
    def run(batches):
        for b in batches:
            n, y = Counter(), Counter()
            for url in b[column]:
                host, path = split_url(url)
                if found := rules.judge(host, path):
                    fold = fold_of(url)
                    own = [(k, fold) for k in ("all", *keys(host, path))]
                    n.update(own)
                    if found[1] == "block":
                        y.update(own)
            yield {"key": [k for k, _ in n], "fold": [f for _, f in n], "n": list(n.values()), "y": [y[k] for k in n]}

    counted = map_rows(urls.select(column), "key string, fold int, n long, y long", run)
    return counted.groupBy("key", "fold").agg(F.sum("n").alias("n"), F.sum("y").alias("y"))


def statistics(counted: DataFrame) -> Statistics:
    """Per kind and fold at most STAT_SHARE keys reach the driver, and one entry for the rest."""
    whole = counted.filter("key = 'all'").agg(F.sum("n").alias("n"), F.sum("y").alias("y")).first()
    if not whole.n:
        return Statistics({}, 0.0, 0.0)
    often = (counted.filter("key <> 'all'").groupBy("key").agg(F.sum("n").alias("of_key"))
             .withColumn("often", F.col("of_key") * STAT_SHARE >= int(whole.n)).select("key", "often"))
    key = F.when(F.col("often"), F.col("key")).otherwise(F.concat(F.substring_index("key", ":", 1), F.lit("?")))
    rows = (counted.join(often, "key").groupBy(key.alias("key"), "fold")
            .agg(F.sum("n").alias("n"), F.sum("y").alias("y")).collect())
    table: dict[str, np.ndarray] = {}
    for r in rows:
        counts = table.setdefault(r.key, np.zeros((FOLDS + 1, 2)))
        counts[r.fold] = r.n, r.y
        counts[-1] += r.n, r.y
    return Statistics(table, float(whole.n), float(whole.y))


def fit(urls: DataFrame, column: str = "url", rules: list[tuple[str, str, str]] = RULES,
        sample_urls: int = SAMPLE_URLS, train=None) -> Judge:
    """Trees from the urls that a rule judges. ``train``: a condition that says
    which urls may be learned from (all, if none)."""
    urls = urls.filter(train) if train is not None else urls
    known = Rules(rules)
    stat = statistics(stored(count_keys(urls, column, known), "url-keys"))

    def label(batches):
        for b in batches:
            own = [(u, f[1] == "block") for u in b[column] if (f := known.judge(*split_url(u)))]
            yield {"url": [u for u, _ in own], "y": [int(y) for _, y in own]}

    drawn = urls.select(column).filter(share([column], 13) * max(stat.total, 1.0) < sample_urls).distinct()
    sample = sorted(map_rows(drawn, "url string, y int", label).collect())
    judge = Judge(known, stat, None)
    y = np.array([r.y for r in sample], float)
    if 0 < y.sum() < len(y):
        judge.trees = Boosted().fit(np.array([judge.row(r.url, *split_url(r.url), fold_of(r.url)) for r in sample]), y)
    elif len(y):
        judge.alone = (y.sum() + 0.5) / (len(y) + 1)
    return judge


def judge_urls(pages: DataFrame, judge: Judge, id_column: str = "page_id", column: str = "url") -> DataFrame:
    """id, host, path, rule, verdict, score (probability of block by the trees), in the input's order."""
    shared = pages.sparkSession.sparkContext.broadcast(judge)
    kind = pages.schema[id_column].dataType.simpleString()

    def run(batches):
        for b in batches:
            own = shared.value
            split = [split_url(u) for u in b[column]]
            found = [own.rules.judge(*s) for s in split]
            scores = own.scores(b[column], split).tolist()
            yield {id_column: b[id_column], "host": [s[0] for s in split], "path": [s[1] for s in split],
                   "rule": [f[0] if f else None for f in found],
                   "verdict": [f[1] if f else "block" if p >= 0.5 else "allow" for f, p in zip(found, scores)], "score": scores}

    return map_rows(pages.select(id_column, column),
                    f"`{id_column}` {kind}, host string, path string, rule string, verdict string, score double", run, as_is=[id_column])


def op13_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = read_table(spark, sf_dir, "pages").select(F.col("page_id").cast("long").alias("page_id"), "url")
    return judge_urls(pages, fit(pages))
