"""Operator 12: conversation structure repair by rank-convergence parallel Viterbi.

A conversation is a sequence of rows ``role, text`` in turn order. Its repair
is the cheapest list of edits that leaves role initials ``(s?(ua)+)?``: Keep
0, Rerole (to user or assistant) 1, Delete 2 (the only edit of a blank or
duplicate row), Insert (an empty user or assistant row) 5; a truncated row
that stays adds 5. Of equally cheap lists the one whose initials are least in
ASCII order wins. Four states say what stands last: nothing, s, u, a.

Every row is one of a few symbols (initial x fault), so a conversation is a
byte string. Costs run backwards: the vector before a row holds, for each
state, the cheapest way to the end. The trace runs forwards and takes the
first letter that keeps the cost.

Shape: one range shuffle by (conversation, turn, role, beginning of the text)
deals even one conversation with most rows over many tasks. A task streams its
sorted rows. A conversation that begins and ends inside a task, and is no
longer than a chunk, is finished there. The others leave chunks of at most
``CHUNK_ROWS`` rows and about ``CHUNK_CHARS`` characters:

1. Duplicates over chunks: digests of (role, text) meet in a group-by that
   keeps the first place of each.
2. All chunks run backwards at once, each from a speculative cost vector (the
   last chunk of a conversation from the true one).
3. Fix-up passes: a chunk whose successor begins with another vector than it
   assumed runs again from that one, beside the run it had, until both differ
   only by a constant; before that row nothing but the constant changes.
   Passes end when no assumption is off by more than a constant. That takes
   one or two passes; at worst one per chunk of the longest conversation.
4. Every chunk traces all four entry states; the exits, stitched in order,
   tell each chunk its entry.
5. Audit and digest are joined per conversation from its chunks, streamed in
   order: memory holds one chunk, whatever the conversation's length (the
   digest of a conversation is one hash over its whole text).

Defined results: null roles and texts count as one space; the initial of an
empty role fits nothing; turns sort nulls first; rows of equal turn sort by
role, then text, and copies follow each other; a null conversation id is one
conversation; one without rows has zeros, an empty audit and the digest of the
empty string; repeated rows are duplicates; texts are read whole; an empty
table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterable, Iterator

from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quarry.llm.common import map_rows, stored
from quarry.session import read_table

CHUNK_ROWS = 65_536
CHUNK_CHARS = 4_000_000
KEY_CHARS = 32          # characters of a text that help to deal rows to tasks

KEEP, REROLE, DELETE, INSERT, CUT = 0, 1, 2, 5, 5
SPACE = " \t\n\x0b\x0c\r"
ENDS = ".!?"

# States: what stands last. NEXT[state][initial] is the state after a row with that initial.
NOTHING, S, U, A = range(4)
NEXT = ({"s": S, "u": U}, {"u": U}, {"a": A}, {"u": U})
INSERTED = (U, U, A, U)  # the state after the one insert that fits
END = (0, 10, 5, 0)      # costs behind the last row
START_GUESS = END

DEAD, TRUNCATED = 4, 8   # a symbol: index of the initial in "sua" or 3, plus these


def fault(text: str) -> str:
    """blank, truncated or nothing."""
    text = text.rstrip(SPACE)
    return "blank" if not text else "" if text[-1] in ENDS else "truncated"


def symbol(role: str, kind: str) -> int:
    initial = "sua".find(role[:1]) if role else -1
    return (3 if initial < 0 else initial) + (DEAD if kind in ("blank", "duplicate") else TRUNCATED if kind else 0)


def _edits(x: int) -> list[list[tuple[str, int, int]]]:
    """Per state the edits of a row with symbol ``x`` as (letter, cost, state after), in ASCII order."""
    out = []
    for state in range(4):
        own = [("D", DELETE, state)]
        if not x & DEAD:
            extra = CUT if x & TRUNCATED else 0
            kept = NEXT[state].get("sua?"[x & 3])
            if kept is not None:
                own.append(("K", KEEP + extra, kept))
            own.append(("R", REROLE + extra, NEXT[state]["u" if "u" in NEXT[state] else "a"]))
        out.append(own)
    return out


EDITS = {i + f: _edits(i + f) for i in range(4) for f in (0, DEAD, TRUNCATED)}


def closed(cost: list[int]) -> tuple[int, ...]:
    """Costs when rows may be inserted first (two are the most that can help)."""
    once = [min(cost[q], INSERT + cost[INSERTED[q]]) for q in range(4)]
    return tuple(min(cost[q], INSERT + once[INSERTED[q]]) for q in range(4))


_STEPS: dict[tuple, tuple] = {}


def back(x: int, after: tuple[int, ...]) -> tuple[int, ...]:
    """The cost vector before a row from the one behind it. Vectors less their
    least entry are few, so the steps are remembered."""
    low = min(after)
    form = (x, after[0] - low, after[1] - low, after[2] - low, after[3] - low)
    step = _STEPS.get(form)
    if step is None:
        step = _STEPS[form] = closed([min(c + form[1 + q] for _, c, q in own) for own in EDITS[x]])
    return (step[0] + low, step[1] + low, step[2] + low, step[3] + low)


def run_back(codes: bytes, end: tuple[int, ...]) -> list[tuple[int, ...]]:
    """Cost vectors before every row, and behind the last."""
    out = [end]
    for x in reversed(codes):
        out.append(back(x, out[-1]))
    out.reverse()
    return out


def parallel(a: tuple[int, ...], b: tuple[int, ...]) -> bool:
    d = a[0] - b[0]
    return a[1] - b[1] == d and a[2] - b[2] == d and a[3] - b[3] == d


def fix_up(codes: bytes, old_end, old_start, end) -> tuple[tuple[int, ...], int]:
    """The vector at the start of a chunk for a new vector at its end, and the
    number of rows run until it differed from the old run by a constant."""
    old, new = tuple(old_end), tuple(end)
    for i in range(len(codes) - 1, -1, -1):
        if parallel(old, new):
            return tuple(c + new[0] - old[0] for c in old_start), len(codes) - 1 - i
        old, new = back(codes[i], old), back(codes[i], new)
    return new, len(codes)


def trace(codes: bytes, costs: list[tuple[int, ...]], state: int, last: bool) -> tuple[str, int]:
    """The least audit from ``state`` on, and the state behind it. Inserts
    behind the last row belong to the last chunk only."""
    out = []
    for i, x in enumerate(codes):
        here, after = costs[i], costs[i + 1]
        while True:
            for letter, cost, q in EDITS[x][state]:
                if letter > "I" and here[state] == INSERT + here[INSERTED[state]]:
                    letter = "I"
                    break
                if here[state] == cost + after[q]:
                    break
            else:
                letter = "I"
            out.append(letter)
            if letter != "I":
                state = q
                break
            state = INSERTED[state]
    while last and END[state]:
        out.append("I")
        state = INSERTED[state]
    return "".join(out), state


def repaired(rows: Iterable[tuple[str, str]], audit: str, state: int) -> Iterator[tuple[str, str]]:
    """(role, text) of the rows after the edits."""
    rows = iter(rows)
    for letter in audit:
        if letter == "I":
            state = INSERTED[state]
            yield ("user", "assistant")[state == A], ""
            continue
        role, text = next(rows)
        if letter == "K":
            state = NEXT[state][role[:1]]
            yield role, text
        elif letter == "R":
            state = U if "u" in NEXT[state] else A
            yield ("user", "assistant")[state == A], text


def encoded(row: tuple[str, str]) -> bytes:
    return f"{row[0]}:{row[1]}".encode("utf-8", "surrogatepass")


ILLEGAL_PAIR = re.compile("su|ua|au")


def illegal(initials: str) -> int:
    return sum(not ILLEGAL_PAIR.fullmatch(initials[i:i + 2]) for i in range(len(initials) - 1))


def initial(role: str) -> str:
    return role[:1] or "\0"


class Run:
    """Consecutive rows of one conversation, in order."""

    def __init__(self, key):
        self.key, self.known = key, False
        self.roles: list[str] = []
        self.texts: list[str] = []
        self.turns: list = []
        self.chars = 0

    def add(self, role: str, text: str, turn) -> None:
        self.roles.append(role)
        self.texts.append(text)
        self.turns.append(turn)
        self.chars += len(text) + len(role) + 16

    def faults(self) -> list[str]:
        seen, out = set(), []
        for row in zip(self.roles, self.texts):
            kind = fault(row[1])
            out.append("duplicate" if kind != "blank" and row in seen else kind)
            seen.add(row)
        return out


_FINISHED: dict[bytes, tuple] = {}


def finish(run: Run, keep_rows: bool) -> dict:
    """The result columns of a whole conversation, and its repaired rows if they are wanted."""
    kinds = run.faults()
    codes = bytes(map(symbol, run.roles, kinds))
    known = _FINISHED.get(codes)
    if known is None:
        costs = run_back(codes, END)
        known = trace(codes, costs, NOTHING, True)[0], costs[0][NOTHING]
        if len(codes) <= 16 and len(_FINISHED) < 200_000:
            _FINISHED[codes] = known
    audit, cost = known
    turns = {t for t in run.turns if t is not None}
    rows = list(repaired(zip(run.roles, run.texts), audit, NOTHING))
    kept = {"roles": [r for r, _ in rows], "texts": [t for _, t in rows]} if keep_rows else {}
    return {**kept, "key": run.key, "gaps": max(turns) - min(turns) + 1 - len(turns) if turns else 0, "blank": kinds.count("blank"),
            "duplicate": kinds.count("duplicate"), "truncated": kinds.count("truncated"),
            "illegal": illegal("".join(map(initial, run.roles))), "cost": cost, "audit": audit,
            "repaired_sha256": hashlib.sha256(b"\n".join(map(encoded, rows))).hexdigest()}


RESULT = "gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"
RESULT_COLUMNS = [c.split()[0] for c in RESULT.split(", ")]
CHUNK = "part int, at int, roles array<string>, texts array<string>, turns array<long>, digests array<binary>"
CHUNK_COLUMNS = [c.split()[0] for c in CHUNK.split(", ")]


def damaged(conversations: DataFrame) -> DataFrame:
    """conv_id, turn, role, text, copies: the rows with the contract's damage; a
    dropped row stays with 0 copies, so that its conversation is not lost."""
    space = F.lit(" ")
    c = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"),
                             F.coalesce(F.col("role"), space).alias("role"), F.coalesce(F.col("text"), space).alias("text"))
    key = F.concat_ws(":", F.coalesce(F.col("conv_id").cast("string"), space), F.coalesce(F.col("turn").cast("string"), space))
    c = c.withColumn("hit", F.pmod(F.crc32(key), F.lit(20)))
    text = (F.when(F.col("hit").isin(0, 1), "").when(F.col("hit") == 2, F.regexp_replace("text", "[.!?]", ""))
            .otherwise(F.col("text")))
    return c.select("conv_id", "turn", F.when(F.col("hit") == 4, "user").otherwise(F.col("role")).alias("role"),
                    text.alias("text"), F.when(F.col("hit") == 0, 0).when(F.col("hit") == 3, 2).otherwise(1).alias("copies"))


def _stream(rows: DataFrame, id_type: str, chunk_rows: int, chunk_chars: int, keep_rows: bool) -> DataFrame:
    """One row per conversation finished inside a task, with its results, and
    one per chunk of the others (``at`` is not null)."""
    def run(batches):
        part = TaskContext.get().partitionId()
        held: list[dict] = []
        number = 0
        current: Run | None = None
        first = True  # the run may have begun in the task before

        def chunk(r: Run) -> dict:
            nonlocal number
            number += 1
            digests = [hashlib.md5(f"{len(a)}:{a}{b}".encode("utf-8", "surrogatepass")).digest() for a, b in zip(r.roles, r.texts)]
            return {"key": r.key, "part": part, "at": number, "roles": r.roles, "texts": r.texts, "turns": r.turns, "digests": digests}

        def columns(found: list[dict]) -> dict:
            return {c: [f.get(c) for f in found] for c in ["key", *RESULT_COLUMNS, *CHUNK_COLUMNS]}

        for b in batches:
            for key, turn, role, text, copies in zip(b["key"], b["turn"], b["role"], b["text"], b["copies"]):
                if current is None or key != current.key:
                    if current is not None:
                        held.append(chunk(current) if first or current.known else finish(current, keep_rows))
                        first = False
                    current = Run(key)
                for _ in range(copies):
                    if len(current.roles) >= chunk_rows or current.chars >= chunk_chars:
                        held.append(chunk(current))
                        current = Run(key)
                        current.known = True  # an earlier chunk of it has been written
                    current.add(role, text, turn)
                if len(held) >= 1024 or held and "at" in held[-1]:
                    yield columns(held)
                    held = []
        if current is not None:
            held.append(chunk(current))
        if held:
            yield columns(held)

    return map_rows(rows, f"key {id_type}, {RESULT}, {CHUNK}", run)


def _first_places(chunks: DataFrame) -> DataFrame:
    """part, at, firsts: which rows of a chunk are the first of their (role, text) in the conversation."""
    places = chunks.select("key", "part", "at", F.posexplode("digests").alias("row", "digest"))
    first = places.groupBy("key", "digest").agg(F.min(F.struct("part", "at", "row")).alias("p"))
    return first.select("p.*").groupBy("part", "at").agg(F.collect_list("row").alias("firsts"))


def _encoded(chunks: DataFrame, id_type: str) -> DataFrame:
    """key, part, at, codes, last, and the counts of a chunk."""
    marked = chunks.join(_first_places(chunks), ["part", "at"], "left").select(
        "key", "part", "at", "roles", "texts", "turns", "firsts")
    names = ["codes", "blank", "duplicate", "truncated", "illegal", "head", "tail", "low", "high", "n_turns"]

    def measure(roles, texts, turns, firsts):
        own = set(firsts or ())
        kinds = [k if (k := fault(t)) == "blank" or i in own else "duplicate" for i, t in enumerate(texts)]
        whole = {t for t in turns if t is not None}
        initials = "".join(map(initial, roles))
        return (bytes(map(symbol, roles, kinds)), kinds.count("blank"), kinds.count("duplicate"), kinds.count("truncated"),
                illegal(initials), initials[:1], initials[-1:], min(whole, default=None), max(whole, default=None), len(whole))

    def run(batches):
        for b in batches:
            found = [measure(*x) for x in zip(b["roles"], b["texts"], b["turns"], b["firsts"])]
            yield {"key": b["key"], "part": b["part"], "at": b["at"], **{n: [f[i] for f in found] for i, n in enumerate(names)}}

    coded = map_rows(marked, f"key {id_type}, part int, at int, codes binary, blank long, duplicate long, truncated long, "
                             "illegal long, head string, tail string, low long, high long, n_turns long", run)
    return coded.withColumn("last", F.lead("at").over(ordered()).isNull())


def ordered():
    """The chunks of a conversation in order: as many rows as it has chunks."""
    return Window.partitionBy("key").orderBy("part", "at")


def _settled(coded: DataFrame, id_type: str) -> DataFrame:
    """key, part, at, codes, last, end: the cost vector behind every chunk, up to a constant."""
    schema = f"key {id_type}, part int, at int, codes binary, last boolean, end array<long>, start array<long>, moved boolean"

    def speculate(batches):
        for b in batches:
            ends = [END if z else START_GUESS for z in b["last"]]
            yield {**b, "end": [list(e) for e in ends], "start": [list(run_back(c, e)[0]) for c, e in zip(b["codes"], ends)],
                   "moved": [True] * len(ends)}

    def fix(batches):
        for b in batches:
            out = {**b, "start": [], "moved": []}
            for codes, end, start, want in zip(b["codes"], b["end"], b["start"], b["want"]):
                moved = not parallel(end, want)
                out["start"].append(list(fix_up(codes, end, start, want)[0]) if moved else start)
                out["moved"].append(moved)
            out["end"] = out.pop("want")
            yield out

    state = stored(map_rows(coded.select("key", "part", "at", "codes", "last"), schema, speculate), "repair-pass")
    while state.filter("moved and not last").limit(1).count():
        want = F.coalesce(F.lead("start").over(ordered()), F.array(*(F.lit(c).cast("long") for c in END)))
        state = stored(map_rows(state.drop("moved").withColumn("want", want), schema, fix), "repair-pass")
    return state.select("key", "part", "at", "codes", "last", "end")


def _stitched(settled: DataFrame, id_type: str) -> DataFrame:
    """part, at, state, audit, cost: entry state and edits of every chunk."""
    def all_traces(batches):
        for b in batches:
            out = {"key": b["key"], "part": b["part"], "at": b["at"], "audits": [], "exits": []}
            for codes, end, last in zip(b["codes"], b["end"], b["last"]):
                costs = run_back(codes, tuple(end))
                traces = [trace(codes, costs, q, last) for q in range(4)]
                out["audits"].append([a for a, _ in traces])
                out["exits"].append([q for _, q in traces])
            yield out

    traced = stored(map_rows(settled, f"key {id_type}, part int, at int, audits array<string>, exits array<int>", all_traces),
                    "repair-traces")

    def stitch(batches):
        state = NOTHING
        for b in batches:
            out = []
            for k, exits, first in zip(b["key"], b["exits"], b["first"]):
                state = NOTHING if first else state
                out.append(state)
                state = exits[state]
            yield {"part": b["part"], "at": b["at"], "state": out}

    order = (traced.select("key", "part", "at", "exits", F.lag("at").over(ordered()).isNull().alias("first"))
             .sortWithinPartitions("key", "part", "at"))
    entry = map_rows(order, "part int, at int, state int", stitch)
    return traced.join(entry, ["part", "at"]).select("part", "at", "state", F.element_at("audits", F.col("state") + 1).alias("audit"))


def _assembled(chunks: DataFrame, coded: DataFrame, stitched: DataFrame, id_type: str) -> DataFrame:
    """The results of conversations in chunks, each streamed through one hash."""
    counts = ["blank", "duplicate", "truncated", "illegal"]
    rows = (chunks.select("part", "at", "roles", "texts").join(stitched, ["part", "at"]).join(coded.drop("codes", "last"), ["part", "at"])
            .repartition("key").sortWithinPartitions("key", "part", "at"))

    def run(batches):
        total: dict | None = None

        def result() -> dict:
            digest = total["hash"].hexdigest()
            gaps = total["high"] - total["low"] + 1 - total["n_turns"] if total["low"] is not None else 0
            return {"key": [total["key"]], "gaps": [gaps], **{c: [total[c]] for c in counts}, "cost": [total["cost"]],
                    "audit": ["".join(total["audit"])], "repaired_sha256": [digest]}

        for b in batches:
            for i, key in enumerate(b["key"]):
                if total is None or key != total["key"]:
                    if total is not None:
                        yield result()
                    total = {"key": key, "hash": hashlib.sha256(), "audit": [], "cost": 0, "n_turns": 0, "low": None, "high": None,
                             "tail": "", "begun": False, **dict.fromkeys(counts, 0)}
                audit, roles, texts = b["audit"][i], b["roles"][i], b["texts"][i]
                total["audit"].append(audit)
                for c in counts:
                    total[c] += b[c][i]
                total["illegal"] += illegal(total["tail"] + b["head"][i])
                total["tail"] = b["tail"][i] or total["tail"]
                if (low := b["low"][i]) is not None:
                    total["n_turns"] += b["n_turns"][i] - (low == total["high"])
                    total["low"] = low if total["low"] is None else total["low"]
                    total["high"] = b["high"][i]
                total["cost"] += cost_of(audit, texts)
                for row in repaired(zip(roles, texts), audit, b["state"][i]):
                    total["hash"].update(b"\n" + encoded(row) if total["begun"] else encoded(row))
                    total["begun"] = True
        if total is not None:
            yield result()

    return map_rows(rows, f"key {id_type}, {RESULT}", run)


def cost_of(audit: str, texts: list[str]) -> int:
    """The cost of edits on rows of which the kept ones are neither blank nor duplicate."""
    rows = iter(texts)
    cost = 0
    for letter in audit:
        if letter == "I":
            cost += INSERT
            continue
        text = next(rows)
        cost += DELETE if letter == "D" else (REROLE if letter == "R" else KEEP) + (CUT if fault(text) else 0)
    return cost


class Repair:
    """The repair of a table ``key, turn, role, text, copies`` (a row counts
    ``copies`` times, in place; 0: not at all, but its conversation is known).

    ``results``: one row per conversation. ``repaired_rows`` (with ``keep_rows``): the rows after the edits."""

    def __init__(self, rows: DataFrame, chunk_rows: int = CHUNK_ROWS, chunk_chars: int = CHUNK_CHARS, keep_rows: bool = False):
        self.id_type = rows.schema["key"].dataType.simpleString()
        order = ["key", "turn", "role", "text"]
        self.dealt = (rows.select(*order, "copies")
                      .repartitionByRange("key", "turn", "role", F.substring("text", 1, KEY_CHARS)).sortWithinPartitions(*order))
        self.found = stored(_stream(self.dealt, self.id_type, chunk_rows, chunk_chars, keep_rows), "repair-chunks")
        self.chunks = self.found.filter("at is not null")
        self.coded = stored(_encoded(self.chunks, self.id_type), "repair-codes")
        self.stitched = stored(_stitched(_settled(self.coded, self.id_type), self.id_type), "repair-audits")

    @property
    def results(self) -> DataFrame:
        done = self.found.filter("at is null").select("key", *RESULT_COLUMNS)
        return done.unionByName(_assembled(self.chunks, self.coded, self.stitched, self.id_type))

    @property
    def repaired_rows(self) -> DataFrame:
        """key, part, at, row, role, text; (part, at, row) orders the rows of a conversation."""
        def run(batches):
            for b in batches:
                own = [list(repaired(zip(r, t), a, q)) for r, t, a, q in zip(b["roles"], b["texts"], b["audit"], b["state"])]
                yield {"key": b["key"], "part": b["part"], "at": b["at"],
                       "roles": [[r for r, _ in x] for x in own], "texts": [[t for _, t in x] for x in own]}

        cut = self.chunks.select("key", "part", "at", "roles", "texts").join(self.stitched, ["part", "at"])
        edited = map_rows(cut, f"key {self.id_type}, part int, at int, roles array<string>, texts array<string>", run)
        done = self.found.filter("at is null").select("key", F.lit(0).alias("part"), F.lit(0).alias("at"), "roles", "texts")
        return (done.unionByName(edited).select("key", "part", "at", F.posexplode(F.arrays_zip("roles", "texts")).alias("row", "x"))
                .select("key", "part", "at", "row", F.col("x.roles").alias("role"), F.col("x.texts").alias("text")))


def op12_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = damaged(read_table(spark, sf_dir, "conversations")).withColumnRenamed("conv_id", "key")
    return Repair(rows).results.withColumnRenamed("key", "conv_id")
