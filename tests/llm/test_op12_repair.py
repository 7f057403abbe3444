import hashlib
import itertools
import random
import re
import zlib

import pytest
from pyspark.sql import functions as F

from quarry.llm import op12_repair as op

SCHEMA = "conv_id long, turn long, role string, text string, size string, kept boolean"


def plain(rows):
    """The contract, on the rows of one conversation after damage: cheapest
    edits by a search over (row, last initial), least letters first."""
    rows = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))
    seen, kinds = set(), []
    for _, role, text in rows:
        body = re.sub(r"[\x20\x09-\x0D]+\Z", "", text)
        kind = "blank" if not body else "duplicate" if (role, text) in seen else "" if body[-1] in ".!?" else "truncated"
        seen.add((role, text))
        kinds.append(kind)
    best = {(0, ""): (0, "", ())}  # (rows used, what stands last) -> least (cost, audit, result)
    fits = {"": "su", "s": "u", "u": "a", "a": "u"}
    todo = [(0, "", 0, (0, ""))]
    import heapq
    heap = [(0, "", 0, "", ())]
    done = {}
    answer = None
    while heap:
        cost, audit, i, last, result = heapq.heappop(heap)
        if (i, last) in done:
            continue
        done[i, last] = True
        if i == len(rows) and last in ("", "a"):
            answer = cost, audit, result
            break
        for role in ("user", "assistant"):
            if role[0] in fits[last]:
                heapq.heappush(heap, (cost + 5, audit + "I", i, role[0], result + ((role, ""),)))
        if i < len(rows):
            _, role, text = rows[i]
            heapq.heappush(heap, (cost + 2, audit + "D", i + 1, last, result))
            if kinds[i] in ("", "truncated"):
                extra = 5 if kinds[i] else 0
                if role[:1] and role[:1] in fits[last]:
                    heapq.heappush(heap, (cost + extra, audit + "K", i + 1, role[0], result + ((role, text),)))
                for other in ("user", "assistant"):
                    if other[0] in fits[last]:
                        heapq.heappush(heap, (cost + extra + 1, audit + "R", i + 1, other[0], result + ((other, text),)))
    turns = {t for t, _, _ in rows if t is not None}
    pairs = [(a[1][:1], b[1][:1]) for a, b in zip(rows, rows[1:])]
    body = "\n".join(f"{r}:{t}" for r, t in answer[2])
    return (max(turns) - min(turns) + 1 - len(turns) if turns else 0, kinds.count("blank"), kinds.count("duplicate"),
            kinds.count("truncated"), sum("".join(p) not in ("su", "ua", "au") for p in pairs), answer[0], answer[1],
            hashlib.sha256(body.encode()).hexdigest())


def damage(rows):
    """conv_id -> rows after damage."""
    out = {}
    for conv, turn, role, text in rows:
        own = out.setdefault(conv, [])
        text, role = " " if text is None else text, " " if role is None else role
        hit = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        if hit == 0:
            continue
        text = "" if hit == 1 else re.sub("[.!?]", "", text) if hit == 2 else text
        own += [(turn, "user" if hit == 4 else role, text)] * (2 if hit == 3 else 1)
    return out


def made(seed, conversations=60, longest=14, roles=("user", "assistant", "system", "tool", "", None)):
    r = random.Random(seed)
    texts = ["A line.", "Ask?", "cut", "", " \n", None, "Another one! ", "ends, \t", "B."]
    rows = []
    for c in range(conversations):
        plainly = r.random() < 0.5
        for t in range(r.randrange(longest)):
            role = ("user", "assistant")[t % 2] if plainly and r.random() < 0.9 else r.choice(roles)
            rows.append((c if c else None, r.choice([t, t, t, t // 2, None, t + 3]), role, r.choice(texts) if r.random() < 0.5 else f"{t} x."))
    return rows


def results(spark, rows, **sizes):
    df = spark.createDataFrame([x + ("s", True) for x in rows], SCHEMA).repartition(3)
    out = op.Repair(op.damaged(df).withColumnRenamed("conv_id", "key"), **sizes).results.collect()
    assert len(out) == len({r.key for r in out})
    return {r.key: tuple(r[c] for c in op.RESULT_COLUMNS) for r in out}


@pytest.mark.parametrize("seed, rows, chars", [(1, op.CHUNK_ROWS, op.CHUNK_CHARS), (2, 1, 10 ** 9), (3, 3, 10 ** 9), (4, 1000, 60)])
def test_equals_the_definition(spark, seed, rows, chars):
    table = made(seed)
    want = {k: plain(v) for k, v in damage(table).items()}
    assert results(spark, table, chunk_rows=rows, chunk_chars=chars) == want


def test_one_conversation_with_most_rows(spark):
    """Chunks of a long conversation, among them such that no speculation settles (rows of other roles)."""
    r = random.Random(9)
    table = [(7, t, "tool" if t % 900 < 400 else r.choice(["user", "assistant"]), "Same." if t % 50 == 0 else f"row {t}.") for t in range(2500)]
    table += [(c, 0, "user", "Hi.") for c in range(100, 140)]
    want = {k: plain(v) for k, v in damage(table).items()}
    assert results(spark, table, chunk_rows=300, chunk_chars=10 ** 9) == want


def test_fix_up_stops_where_runs_differ_by_a_constant():
    codes = bytes(op.symbol(("user", "assistant")[i % 2], "") for i in range(1000))
    old = op.run_back(codes, op.START_GUESS)[0]
    start, run = op.fix_up(codes, op.START_GUESS, old, (3, 2, 0, 5))
    assert run < 20 and op.parallel(start, op.run_back(codes, (3, 2, 0, 5))[0])
    assert start == op.run_back(codes, (3, 2, 0, 5))[0]


def test_trace_is_the_least_of_all_cheapest_audits():
    for n in range(5):
        for codes in itertools.product([0, 1, 2, 3, 4, 9, 10], repeat=n):
            roles = [("system", "user", "assistant", "tool")[x & 3] for x in codes]
            rows = [(i, role, "" if x & op.DEAD else f"{i}" if x & op.TRUNCATED else f"{i}.") for i, (x, role) in enumerate(zip(codes, roles))]
            costs = op.run_back(bytes(codes), op.END)
            audit, state = op.trace(bytes(codes), costs, op.NOTHING, True)
            want = plain(rows)
            assert (costs[0][0], audit) == want[5:7] and state in (op.NOTHING, op.A)


def test_repaired_rows(spark):
    table = made(5, 20)
    df = spark.createDataFrame([x + ("s", True) for x in table], SCHEMA)
    repair = op.Repair(op.damaged(df).withColumnRenamed("conv_id", "key"), chunk_rows=4, keep_rows=True)
    rows = {}
    for r in sorted(repair.repaired_rows.collect(), key=lambda r: (r.part, r.at, r.row)):
        rows.setdefault(r.key, []).append(f"{r.role}:{r.text}")
    for r in repair.results.collect():
        assert hashlib.sha256("\n".join(rows.get(r.key, [])).encode()).hexdigest() == r.repaired_sha256
        assert re.fullmatch("(s?(ua)+)?", "".join(x[0] for x in rows.get(r.key, [])))


def test_given_table_and_empty_table(spark, none):
    path = "/root/testdata/sf0.001"
    table = [tuple(r) for r in spark.read.parquet(f"{path}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    want = {k: plain(v) for k, v in damage(table).items()}
    out = op.op12_repair(spark, path)
    assert out.columns[0] == "conv_id"
    assert {r.conv_id: tuple(r[c] for c in op.RESULT_COLUMNS) for r in out.collect()} == want
    assert op.op12_repair(spark, none).count() == 0


def test_very_long_text_and_dropped_conversation(spark):
    dropped = next(c for c in range(1000) if zlib.crc32(f"{c}:0".encode()) % 20 == 0)
    table = [(5000, 1, "user", "long " * 200_000 + "."), (5000, 2, "assistant", "Ok."), (dropped, 0, "user", "Gone.")]
    got = results(spark, table, chunk_chars=1000)
    assert got == {k: plain(v) for k, v in damage(table).items()}
    assert got[dropped] == (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())
