"""Operator 3: BPE encoding and decoding over a pair occurrence index.

Texts are cut where no merge can cross (runs of non-space with the space
before them); the distinct pieces of many documents of a partition are laid
end to end, and an index maps every adjacent pair with a rank to all its
positions in that stretch. Ranks are applied in ascending order to all their
positions at once, and the lists of the pairs that appear beside a merge are
extended. So a merge costs a few array operations however often it occurs,
and a piece that comes back later in the partition is not merged again.

No shuffle: a document is encoded where it is read. Memory per task is
bounded by the stretch (``STRETCH_CHARS``) and by the table of known pieces,
which is emptied when it reaches ``KNOWN_PIECES``; neither changes results.

Defined results: a null text counts as empty and gives no ids; the text of a
special token is that token; repeated rows and ids repeat; an empty table
gives an empty result; other columns are not read.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import re

import numpy as np
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.llm.common import documents, map_rows

TOKENIZER = "byte_bpe_50k.json"
STRETCH_CHARS = 4_000_000
KNOWN_PIECES = 250_000

# The split of byte-level BPE vocabularies of this family (fixed value).
SPLIT = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

# Pieces between which SPLIT always cuts, for texts whose only white space is ASCII.
PIECE = re.compile(r" ?[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+(?![^\x20\x09-\x0D])|[\x20\x09-\x0D]")
# White space outside ASCII (White_Space property); such texts are split by SPLIT itself.
OTHER_SPACE = re.compile(r"[\x1c-\x1f\x85\xa0\u1680\u180e\u2000-\u200b\u2028\u2029\u202f\u205f\u3000\ufeff]")


def byte_letters() -> dict[str, int]:
    """The letters that stand for bytes in the vocabulary file: printable Latin-1
    characters for themselves, the others, in order, from U+0100 on."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    letters = {chr(b): b for b in own}
    rest = (b for b in range(256) if b not in set(own))
    letters.update({chr(0x100 + i): b for i, b in enumerate(rest)})
    return letters


class Vocabulary:
    """Ranks, ids and byte strings of one tokenizer file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        ids = spec["model"]["vocab"]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        letters = byte_letters()
        self.size = 1 + max([*ids.values(), *self.special.values()])
        self.bytes = [b""] * self.size
        for token, i in ids.items():
            self.bytes[i] = bytes(letters[c] for c in token)
        for token, i in self.special.items():
            self.bytes[i] = token.encode()
        self.cut = regex.compile("|".join(regex.escape(t) for t in sorted(self.special, key=len, reverse=True)) or r"(?!)")
        # 0xFE and 0xFF occur in no UTF-8 text: they mark the ends of pieces and
        # of the parts between which no merge happens. Both get the symbol END.
        self.end = self.size
        self.stride = self.size + 1
        self.of_byte = np.full(256, self.end, np.int32)
        for token, i in ids.items():
            if len(self.bytes[i]) == 1:
                self.of_byte[self.bytes[i][0]] = i
        self.of_byte[0xFE:] = self.end
        pairs = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in spec["model"]["merges"]]
        left = np.array([ids[a] for a, _ in pairs], np.int64)
        right = np.array([ids[b] for _, b in pairs], np.int64)
        self.left, self.right = left, right
        self.made = np.array([ids[a + b] for a, b in pairs], np.int32)
        keys = left * self.stride + right
        order = np.argsort(keys, kind="stable")
        self.keys, self.rank_of = keys[order], order
        # First pairs are pairs of bytes: a direct table.
        self.byte_rank = np.full(256 * 256, -1, np.int32)
        one = {i: b[0] for i, b in enumerate(self.bytes) if len(b) == 1}
        for r, (a, b) in enumerate(zip(left.tolist(), right.tolist())):
            if a in one and b in one and max(one[a], one[b]) < 0xFE:
                self.byte_rank[one[a] * 256 + one[b]] = r
        # For decoding: all byte strings end to end.
        self.flat = np.frombuffer(b"".join(self.bytes), np.uint8)
        self.length = np.array([len(b) for b in self.bytes], np.int64)
        self.start = np.cumsum(self.length) - self.length

    def ranks(self, keys: np.ndarray) -> np.ndarray:
        at = np.searchsorted(self.keys, keys)
        at[at == len(self.keys)] = 0
        return np.where(self.keys[at] == keys, self.rank_of[at], -1)

    def merge(self, stretch: bytes) -> tuple[np.ndarray, np.ndarray]:
        """All symbols after every merge, with END symbols kept, and their positions."""
        raw = np.frombuffer(stretch, np.uint8)
        n = len(raw)
        sym = np.empty(n + 1, np.int32)
        sym[:n] = self.of_byte[raw]
        sym[n] = self.end
        after = np.arange(1, n + 2, dtype=np.int32)
        after[n] = n
        before = np.arange(-1, n, dtype=np.int32)
        before[0] = n
        # The index: rank -> arrays of positions.
        first = self.byte_rank[raw[:-1].astype(np.int32) * 256 + raw[1:]] if n > 1 else np.empty(0, np.int32)
        at = np.flatnonzero(first >= 0).astype(np.int32)
        index: dict[int, list[np.ndarray]] = {}
        self._extend(index, [], first[at], at)
        waiting = list(index)
        heapq.heapify(waiting)
        marked = np.zeros(n + 1, bool)
        while waiting:
            rank = heapq.heappop(waiting)
            lists = index.pop(rank)
            a, b = self.left[rank], self.right[rank]
            at = lists[0] if len(lists) == 1 else np.sort(np.concatenate(lists))
            behind = after[at]
            valid = (sym[at] == a) & (sym[behind] == b)
            if not valid.all():
                at, behind = at[valid], behind[valid]
            if a == b and len(at) > 1:
                # In a run of the same symbol the pairs overlap: take every second one.
                starts = np.flatnonzero(np.concatenate(([True], behind[:-1] != at[1:])))
                place = np.arange(len(at)) - np.repeat(starts, np.diff(np.append(starts, len(at))))
                at, behind = at[place % 2 == 0], behind[place % 2 == 0]
            if not len(at):
                continue
            far = after[behind]
            sym[at] = self.made[rank]
            sym[behind] = -1
            after[at] = far
            before[far] = at
            # Pairs that now begin at a merged symbol, or end in one.
            marked[at] = True
            ahead = before[at]
            ahead = ahead[~marked[ahead]]
            marked[at] = False
            touched = np.concatenate((ahead, at))
            ranks = self.ranks(sym[touched].astype(np.int64) * self.stride + sym[after[touched]])
            found = ranks >= 0
            if found.any():
                self._extend(index, waiting, ranks[found], touched[found])
        alive = np.flatnonzero(sym[:n] >= 0)
        return sym[alive], alive

    @staticmethod
    def _extend(index: dict, waiting: list, ranks: np.ndarray, at: np.ndarray) -> None:
        order = np.lexsort((at, ranks))
        ranks, at = ranks[order], at[order]
        cuts = np.flatnonzero(np.diff(ranks)) + 1
        for r, part in zip(ranks[np.concatenate(([0], cuts))].tolist() if len(ranks) else [], np.split(at, cuts)):
            if r in index:
                index[r].append(part)
            else:
                index[r] = [part]
                heapq.heappush(waiting, r)

    def pieces(self, text: str) -> list[str]:
        """``text`` in pieces that are encoded one by one; a special token is a piece."""
        if not text:
            return []
        if self.special and any(t in text for t in self.special):
            out, done = [], 0
            for m in self.cut.finditer(text):
                out += self._plain(text[done:m.start()])
                out.append(m.group())
                done = m.end()
            return out + self._plain(text[done:])
        return self._plain(text)

    @staticmethod
    def _plain(text: str) -> list[str]:
        return SPLITTER.findall(text) if OTHER_SPACE.search(text) else PIECE.findall(text)


SPLITTER = regex.compile(SPLIT)


class Encoder:
    """Ids of whole texts; keeps the ids of pieces it has met."""

    def __init__(self, vocabulary: Vocabulary):
        self.vocabulary = vocabulary
        self.forget()

    def forget(self) -> None:
        self.known = _Numbers()
        self.ids = np.empty(0, np.int32)
        self.start = np.empty(0, np.int64)
        self.length = np.empty(0, np.int64)

    def _learn(self) -> None:
        """Encode the pieces met since the last call, all in one stretch."""
        new, v = self.known.new, self.vocabulary
        if not new:
            return
        parts = []
        for p in new:
            if p in v.special:
                parts.append(b"")
            elif p.lstrip(" ").isalpha() and p[1:].isalpha():
                parts.append(p.encode())
            else:
                parts.append(b"\xff".join(x.encode() for x in SPLITTER.findall(p)))
        stretch = b"\xfe".join(parts) + b"\xfe"
        symbols, at = v.merge(stretch)
        raw = np.frombuffer(stretch, np.uint8)
        is_end = symbols == v.end
        piece_end = np.flatnonzero(is_end & (raw[at] == 0xFE))
        kept = np.cumsum(~is_end)
        total = kept[piece_end]
        length = np.diff(np.concatenate(([0], total)))
        ids = symbols[~is_end]
        special = [i for i, p in enumerate(new) if p in v.special]
        if special:
            ids = np.insert(ids, total[special], [v.special[new[i]] for i in special])
            length[special] += 1
        begin = np.cumsum(length) - length + len(self.ids)
        self.ids = np.concatenate((self.ids, ids.astype(np.int32)))
        self.start = np.concatenate((self.start, begin))
        self.length = np.concatenate((self.length, length))
        self.known.new = []

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All ids end to end, and the number of ids of each text."""
        numbers = [np.array(list(map(self.known.__getitem__, self.vocabulary.pieces(t))), np.int64) for t in texts]
        self._learn()
        counts = np.array([self.length[x].sum() for x in numbers], np.int64)
        which = np.concatenate(numbers) if numbers else np.empty(0, np.int64)
        ids = self.ids[_spans(self.start[which], self.length[which])]
        if len(self.known) > KNOWN_PIECES:
            self.forget()
        return ids, counts

    def decode(self, ids: np.ndarray) -> bytes:
        """The bytes of the tokens, special ones included."""
        v = self.vocabulary
        return v.flat[_spans(v.start[ids], v.length[ids])].tobytes()


class _Numbers(dict):
    """piece -> number, in the order of first use; ``new`` lists those without ids yet."""

    def __init__(self):
        super().__init__()
        self.new: list[str] = []

    def __missing__(self, piece: str) -> int:
        self[piece] = number = len(self)
        self.new.append(piece)
        return number


def _spans(start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """start[0], start[0] + 1, ... of every span, end to end."""
    stop = np.cumsum(length)
    if not len(stop):
        return np.empty(0, np.int64)
    return np.arange(stop[-1]) + np.repeat(start - (stop - length), length)


_ENCODERS: dict[str, Encoder] = {}


def encoder(path: str | None = None) -> Encoder:
    """One encoder per file and worker process. Without a path, the file that
    the installed vocabulary package holds on this machine."""
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path(TOKENIZER)
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(Vocabulary(path))
    return _ENCODERS[path]


def _stretches(batches, chars: int = STRETCH_CHARS):
    """(ids, texts) lists of about ``chars`` characters."""
    ids, texts, held = [], [], 0
    for b in batches:
        for i, t in zip(b["doc_id"], b["text"]):
            ids.append(i)
            texts.append(t or "")
            held += len(texts[-1])
            if held >= chars:
                yield ids, texts
                ids, texts, held = [], [], 0
    if ids:
        yield ids, texts


def encode_documents(docs: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id, ids (array<int>) of every whole text."""
    def run(batches):
        enc = encoder(path)
        for doc_ids, texts in _stretches(batches):
            ids, counts = enc.encode(texts)
            yield {"doc_id": doc_ids, "ids": [x.tolist() for x in np.split(ids, np.cumsum(counts)[:-1])]}

    return map_rows(docs.select("doc_id", "text"), "doc_id long, ids array<int>", run)


def decode_documents(encoded: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id, text from doc_id, ids; bytes that are no UTF-8 become U+FFFD."""
    def run(batches):
        enc = encoder(path)
        for b in batches:
            yield {"doc_id": b["doc_id"],
                   "text": [enc.decode(np.array(x or [], np.int64)).decode("utf-8", "replace") for x in b["ids"]]}

    return map_rows(encoded.select("doc_id", "ids"), "doc_id long, text string", run)


def round_trip(docs: DataFrame, path: str | None = None) -> DataFrame:
    """Per document: number of ids, digest of the ids, digest of the text decoded from them."""
    def run(batches):
        enc = encoder(path)
        for doc_ids, texts in _stretches(batches):
            ids, counts = enc.encode(texts)
            out = {"doc_id": doc_ids, "n_tokens": counts.tolist(), "ids_sha256": [], "decoded_sha256": []}
            stop = np.cumsum(counts)
            for a, b in zip((stop - counts).tolist(), stop.tolist()):
                own = ids[a:b]
                out["ids_sha256"].append(hashlib.sha256(own.astype("<u4").tobytes()).hexdigest())
                text = enc.decode(own).decode("utf-8", "replace")
                out["decoded_sha256"].append(hashlib.sha256(text.encode()).hexdigest())
            yield out
        enc.forget()

    return map_rows(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"),
                    "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string", run)


def op3_bpe_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return round_trip(documents(spark, sf_dir))
