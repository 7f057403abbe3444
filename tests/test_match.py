"""Keyword/tag matching against brute force, prompts and the client loop."""

import random

import pytest

from quarry.operators import match as mt


def brute(requests, tags, min_hits=3, k=10):
    out = []
    for rid, sp, kws in requests:
        if not kws:
            continue
        scored = []
        for tsp, path, line, name, pat in tags:
            if tsp != sp or "test" in pat or "Test" in pat:
                continue
            h = sum(1 for kw in kws if kw in pat)
            if h >= min_hits:
                scored.append((-h, path, line, name))
        scored.sort()
        out += [(rid, path, line, -h, r + 1) for r, (h, path, line, name) in enumerate(scored[:k])]
    return sorted(out)


def test_match_tags_matches_bruteforce(spark):
    rnd = random.Random(4)
    words = ["alpha", "beta", "gam", "alphabet", "x: int", "y: str", "Test", "delta_1", "eps"]
    tags = []
    for sp in ("s1", "s2"):
        for path in ("a.py", "b.py"):
            for line in range(1, 25):
                pat = " ".join(rnd.choice(words + ["zz", "qq:", "int"]) for _ in range(rnd.randrange(1, 7)))
                tags.append((sp, path, line, f"n{line}", pat))
    requests = [(i, rnd.choice(["s1", "s2"]), sorted(set(rnd.sample(words, rnd.randrange(0, 6)))))
                for i in range(20)]
    req = spark.createDataFrame(requests, "request_id long, save_path string, keywords array<string>")
    tdf = spark.createDataFrame(tags, "save_path string, path string, line int, name string, pattern string")
    got = sorted((r["request_id"], r["path"], r["line"], r["hits"], r["rank"])
                 for r in mt.match_tags(req, tdf).collect())
    assert got == brute(requests, tags)


def random_case(rnd, snapshots, paths, lines, n_requests):
    words = ["alpha", "beta", "gam", "alphabet", "bet", "x: int", "y: str", "Test", "delta_1", "eps", "größe", "a.b", "x:  int", "日本語"]
    tags = [(sp, path, line, f"n{line % 3}", " ".join(rnd.choice(words + ["zz", "qq:", "int"]) for _ in range(rnd.randrange(0, 9))))
            for sp in snapshots for path in paths for line in range(lines)]
    keys = [w for w in words if len(w) > 2] + ["eta", "lph", "x: i", "a_gam"]
    requests = [(i, rnd.choice(snapshots), sorted(rnd.sample(keys, rnd.randrange(0, 9)))) for i in range(n_requests)]
    return requests, tags


@pytest.mark.parametrize("request_block, tag_block, k", [(64, 8192, 10), (3, 7, 4), (1, 1, 2), (50, 20, 1)])
def test_cells_of_any_size_give_the_same_tags(spark, monkeypatch, request_block, tag_block, k):
    """One snapshot holds most requests and tags; blocks cut it into many cells."""
    monkeypatch.setattr(mt, "REQUEST_BLOCK", request_block)
    monkeypatch.setattr(mt, "TAG_BLOCK", tag_block)
    rnd = random.Random(request_block)
    requests, tags = random_case(rnd, ["hot"] * 6 + ["b", "c"], ["p", "q"], 12, 30)
    tags = sorted(set(tags), key=str)
    req = spark.createDataFrame(requests, "request_id long, save_path string, keywords array<string>")
    tdf = spark.createDataFrame(tags, "save_path string, path string, line int, name string, pattern string")
    got = sorted((r.request_id, r.line, r.hits, r["rank"]) for r in mt.match_tags(req, tdf, min_hits=2, k=k).collect())
    # Of equal (hits, path, line, name) any pattern may come first: compare without it.
    assert got == sorted((i, line, h, rank) for i, _, line, h, rank in brute(requests, tags, 2, k))


def test_match_tags_on_nulls_and_empty_tables(spark):
    req = spark.createDataFrame([(1, "s", ["abc", None]), (2, None, ["abc"]), (3, "s", None), (4, "s", []), (5, "none", ["abc"])],
                                "request_id long, save_path string, keywords array<string>")
    tags = spark.createDataFrame([("s", None, None, None, "abc"), ("s", "p", 1, "n", None), (None, "p", 1, "n", "abc"), ("s", "p", 2, "n", "")],
                                 "save_path string, path string, line int, name string, pattern string")
    assert [tuple(r) for r in mt.match_tags(req, tags, min_hits=1).collect()] == [(1, "s", None, None, None, "abc", 1, 1)]
    assert mt.match_tags(req.limit(0), tags, min_hits=1).count() == 0
    assert mt.match_tags(req, tags.limit(0), min_hits=1).count() == 0


def test_match_tags_shuffles_no_row_per_hit(spark):
    """Every keyword of every request hits every tag; the cells give back k rows per request."""
    req = spark.createDataFrame([(i, "s", [f"key{j}" for j in range(20)]) for i in range(50)], "request_id long, save_path string, keywords array<string>")
    line = " ".join(f"key{j}" for j in range(20))
    tags = spark.createDataFrame([("s", "p", i, "n", line) for i in range(400)], "save_path string, path string, line int, name string, pattern string")
    rows = mt.match_tags(req, tags, k=3).collect()
    assert {(r.line, r.hits, r["rank"]) for r in rows} == {(0, 20, 1), (1, 20, 2), (2, 20, 3)} and len(rows) == 150


def test_rewrite_retries_and_failures(spark):
    calls = {"n": 0}

    def factory():
        state = {}

        def client(prompt):
            state[prompt] = state.get(prompt, 0) + 1
            if prompt == "flaky" and state[prompt] < 3:
                raise mt.TransportError("down")
            if prompt == "dead":
                raise mt.TransportError("down")
            if prompt == "bad":
                return 500, None
            return 200, prompt.upper()
        return client

    df = spark.createDataFrame([(1, "ok"), (2, "flaky"), (3, "dead"), (4, "bad")], "request_id long, prompt string")
    got = {r["request_id"]: (r["rewritten_query"], r["attempts"], r["status"])
           for r in mt.rewrite_queries(df, factory, retries=3, delay=0.0).collect()}
    assert got == {1: ("OK", 1, "ok"), 2: ("FLAKY", 3, "ok"), 3: (None, 3, "failed"), 4: (None, 1, "http_500")}
    assert calls["n"] == 0


def test_short_keywords_are_refused(spark):
    req = spark.createDataFrame([(1, "s", ["ab", "abc"])], "request_id long, save_path string, keywords array<string>")
    tags = spark.createDataFrame([("s", "p", 1, "n", "abc ab")], "save_path string, path string, line int, name string, pattern string")
    with pytest.raises(Exception, match="fewer than three"):
        mt.match_tags(req, tags, min_hits=1).collect()


def test_hits_of_many_lines_at_once(monkeypatch):
    """Counted in small steps: the same numbers as keyword by keyword."""

    rnd = random.Random(3)
    words = ["abc", "abcd", "bcd", "x y z", "foo_1", "né", "a.b"]
    lines = ["", " ".join(words)] + [" ".join(rnd.choice([*words, "zz", "q"]) for _ in range(rnd.randrange(6))) for _ in range(60)]
    asked = [rnd.sample(words, rnd.randrange(len(words) + 1)) for _ in range(5)] + [["abc", "abc"], []]
    want = [[sum(w in line for w in set(own)) for own in asked] for line in lines]
    for cells in (1, 40, 1 << 20):
        monkeypatch.setattr(mt, "HELD_CELLS", cells)
        assert mt.KeywordIndex(asked).hits(lines).tolist() == want
    assert mt.KeywordIndex([[], []]).hits(lines).sum() == 0


@pytest.mark.parametrize("many", [200_000, 0])
def test_requests_and_lines_are_shuffled_before_what_is_found(spark, monkeypatch, many):
    """The cells are done and stored when the result is planned: it reads neither requests' keywords nor lines again."""
    monkeypatch.setattr(mt, "MANY_SNAPSHOTS", many)
    requests, tags = random_case(random.Random(3), ["s", "t", "t"], ["p", "q"], 12, 20)
    tags = sorted(set(tags), key=str)
    req = spark.createDataFrame(requests, "request_id long, save_path string, keywords array<string>")
    tdf = spark.createDataFrame(tags, "save_path string, path string, line int, name string, pattern string")
    out = mt.match_tags(req, tdf, min_hits=2, k=4)
    plan = out._jdf.queryExecution().sparkPlan().toString()
    assert "CoGroup" not in plan and "keywords" not in plan, plan
    got = sorted((r.request_id, r.line, r.hits, r["rank"]) for r in out.collect())
    assert got == sorted((i, line, h, rank) for i, _, line, h, rank in brute(requests, tags, 2, 4))
