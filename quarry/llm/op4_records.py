"""Operator 4: token ids as length-delimited binary records.

Documents are ordered by doc_id with one range shuffle; every partition
becomes one record file and one index file in a folder that all executors
see. A record is

    length   8 bytes, little endian: bytes of the payload
    check    4 bytes: masked checksum of the length bytes
    payload  doc_id (8), number of ids (4), flags (4), ids, zero bytes up to a multiple of 4
    check    4 bytes: masked checksum of the payload

with the masked CRC-32C that record files of this kind use: the checksum
turned right by 15 bits plus a constant. Ids take two bytes if the
vocabulary fits (flag 1), else four. The index holds one fixed-size entry per
record: offset (8), doc_id (8), number of ids (4), flags (4), so that a
reader may seek to records in any order (``read_records(order_seed=...)``).

A task writes under a name of its own attempt and renames the finished file,
so a lost executor or a second attempt never leaves half a file behind the
final name. Only one row per file reaches the driver.

Defined results: a null text counts as empty and gives just the end id; a
null doc_id is ordered first (flag 2); equal doc_ids are ordered by a hash of
the text; an empty table writes no record; other columns are not read.
"""

from __future__ import annotations

import json
import re
import struct
import uuid
import zlib

import numpy as np
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.llm.common import documents, map_rows
from quarry.session import scratch_dir

TOKENIZER = "word_bpe_49k.json"
END_ID = 2
KNOWN_PIECES = 400_000
MASK = 0xA282EAD8
HEAD = struct.Struct("<QI")
BODY = struct.Struct("<qII")
ENTRY = struct.Struct("<QqII")
NARROW, NO_ID = 1, 2
LANE = 256  # four-byte words that one checksum lane takes


# --- CRC-32C over many records at once ---------------------------------------------------

def _byte_table() -> np.ndarray:
    t = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        t = (t >> 1) ^ np.where(t & 1, np.uint32(0x82F63B78), np.uint32(0))
    return t


class Checksums:
    """CRC-32C of payloads whose lengths are multiples of four bytes.

    The register is linear in its input, so a payload is cut into lanes of
    equal length (the first one filled up with zeros in front), all lanes of
    all records step forward together, and the lanes of a record are then
    joined by the matrix that moves a register over one lane."""

    def __init__(self):
        byte = _byte_table()
        low, high = np.arange(65536, dtype=np.uint32), np.arange(65536, dtype=np.uint32) << 16

        def step(x):  # the register after four zero bytes
            for _ in range(4):
                x = byte[x & 0xFF] ^ (x >> 8)
            return x

        self.low, self.high = step(low), step(high)
        lane_low, lane_high = low, high
        for _ in range(LANE):
            lane_low, lane_high = self.forward(lane_low), self.forward(lane_high)
        self.lane_low, self.lane_high = lane_low.tolist(), lane_high.tolist()

    def forward(self, x: np.ndarray) -> np.ndarray:
        return self.low[x & 0xFFFF] ^ self.high[x >> 16]

    def __call__(self, payloads: list[bytes]) -> list[int]:
        if not payloads:
            return []
        words = [len(p) // 4 for p in payloads]
        lanes = [max(1, -(-w // LANE)) for w in words]
        table = np.zeros((sum(lanes), LANE), np.uint32)
        flat, at = table.reshape(-1), 0
        for p, w, k in zip(payloads, words, lanes):
            at += k * LANE
            if w:
                flat[at - w:at] = np.frombuffer(p, "<u4")
                flat[at - w] ^= 0xFFFFFFFF  # the register's first value
        state = np.zeros(len(table), np.uint32)
        for column in np.ascontiguousarray(table.T):
            state = self.forward(state ^ column)
        out, state, at = [], state.tolist(), 0
        for k in lanes:
            x = 0
            for s in state[at:at + k]:
                x = self.lane_low[x & 0xFFFF] ^ self.lane_high[x >> 16] ^ s
            at += k
            out.append(x ^ 0xFFFFFFFF)
        return out


def masked(crc: int) -> int:
    return (((crc >> 15) | (crc << 17)) + MASK) & 0xFFFFFFFF


# --- files --------------------------------------------------------------------------------

def file_system(path: str):
    """The file system of ``path`` and the path in it; plain and file: paths are local ones."""
    if path.startswith("file:"):
        path = "/" + path[5:].lstrip("/")
    if path.startswith("/"):
        return pafs.LocalFileSystem(), path
    return pafs.FileSystem.from_uri(path)


class RecordWriter:
    """Writes one record file and its index under temporary names; ``close`` puts them in place."""

    def __init__(self, folder: str, name: str, checksums: Checksums):
        self.fs, base = file_system(folder)
        self.fs.create_dir(base, recursive=True)
        self.final = [f"{base}/{name}.rec", f"{base}/{name}.idx"]
        self.temporary = [f"{p}.{uuid.uuid4().hex}.tmp" for p in self.final]
        self.records, self.index = [self.fs.open_output_stream(p) for p in self.temporary]
        self.checksums = checksums
        self.offset = self.n_docs = self.n_ids = 0

    def write(self, doc_ids: list, ids: list[bytes], width: int) -> None:
        """``ids``: little-endian ids of ``width`` bytes."""
        heads, bodies, entries = [], [], []
        for d, raw in zip(doc_ids, ids):
            flags = (NARROW if width == 2 else 0) | (NO_ID if d is None else 0)
            n = len(raw) // width
            bodies.append(BODY.pack(d or 0, n, flags) + raw + b"\0" * (-len(raw) % 4))
            heads.append(struct.pack("<Q", len(bodies[-1])))
            entries.append(ENTRY.pack(self.offset, d or 0, n, flags))
            self.offset += 16 + len(bodies[-1])
            self.n_ids += n
        crcs = self.checksums(heads + bodies)
        out = []
        for h, b, ch, cb in zip(heads, bodies, crcs, crcs[len(heads):]):
            out += (h, struct.pack("<I", masked(ch)), b, struct.pack("<I", masked(cb)))
        self.records.write(b"".join(out))
        self.index.write(b"".join(entries))
        self.n_docs += len(doc_ids)

    def close(self) -> None:
        for stream, temporary, final in zip((self.records, self.index), self.temporary, self.final):
            stream.close()
            self.fs.move(temporary, final)


def parse_records(data: bytes, checksums: Checksums):
    """(records, bytes used): whole records at the start of ``data`` as
    (doc_id, flags, n, ids); raises ValueError on a wrong checksum."""
    heads, bodies, stored, at = [], [], [], 0
    while at + 16 <= len(data):
        length, check = HEAD.unpack_from(data, at)
        if at + 16 + length > len(data):
            break
        heads.append(data[at:at + 8])
        bodies.append(data[at + 12:at + 12 + length])
        stored.append((check, struct.unpack_from("<I", data, at + 12 + length)[0]))
        at += 16 + length
    crcs = checksums(heads + bodies)
    out = []
    for (a, b), ch, cb, body in zip(stored, crcs, crcs[len(heads):], bodies):
        if a != masked(ch) or b != masked(cb):
            raise ValueError("damaged record")
        d, n, flags = BODY.unpack_from(body)
        ids = np.frombuffer(body, "<u2" if flags & NARROW else "<u4", n, BODY.size)
        out.append((None if flags & NO_ID else d, flags, n, ids))
    return out, at


def read_stream(path: str, checksums: Checksums, chunk: int = 4 << 20):
    """All records of a file in order, in lists, a bounded part at a time."""
    fs, p = file_system(path)
    rest = b""
    with fs.open_input_stream(p) as f:
        while data := f.read(chunk):
            rest += data
            found, used = parse_records(rest, checksums)
            rest = rest[used:]
            # A record longer than a chunk: read on in larger steps.
            chunk = chunk if found else chunk * 2
            if found:
                yield found
    if rest:
        raise ValueError(f"{path} ends within a record")


# --- tokenizer ----------------------------------------------------------------------------

class Pieces(dict):
    """Word, sign or piece -> its ids as bytes, by the tokenizers library. The
    normalizer and the split of the file never reach over ASCII white space, so
    a text's ids are those of its space-free pieces, and each is encoded once.
    Most texts are Latin-1 letters, digits and lone signs, of which the
    normalizer only lower-cases letters and the split takes each word, digit and
    sign by itself: they are cut by string replacement. Other texts are cut at
    white space, and their pieces encoded as they stand."""

    def __init__(self, path: str | None):
        super().__init__()
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        if path is None:
            import public_tokenizers

            path = public_tokenizers.path(TOKENIZER)
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=True)
        self.width = 2 if len(vocabulary) <= 1 << 16 else 4
        mark = json.loads(self.tokenizer.to_str())["model"]["end_of_word_suffix"]
        self.ends_word = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends_word[[i for t, i in vocabulary.items() if t.endswith(mark)]] = True

    def _learn(self, new: list[str]) -> None:
        kind = f"<u{self.width}"
        words = [p for p in new if p.isalpha() and (p.isascii() or PLAIN.fullmatch(p)) and p.islower()]
        for a in range(0, len(words), JOINED):
            self._learn_words(words[a:a + JOINED], kind)
        others = list(set(new).difference(words)) if len(words) < len(new) else []
        for p, e in zip(others, self.tokenizer.encode_batch_fast(others, add_special_tokens=False)):
            self[p] = np.array(e.ids, kind).tobytes()

    def _learn_words(self, words: list[str], kind: str) -> None:
        """Words as one text; the last token of each word carries the file's mark of a word's end."""
        ids = np.array(self.tokenizer.encode_batch_fast([" ".join(words)], add_special_tokens=False)[0].ids, kind)
        ends = np.flatnonzero(self.ends_word[ids]) + 1
        if len(ends) != len(words) or ends[-1] != len(ids):
            raise RuntimeError("the tokenizer cuts a plain word")
        raw, ends = ids.tobytes(), (ends * self.width).tolist()
        self.update(zip(words, [raw[a:z] for a, z in zip([0, *ends], ends)]))

    def encode(self, texts: list[str], end_id: int) -> list[bytes]:
        cut = list(map(_pieces, texts))
        new = set().union(*cut).difference(self)
        if new:
            self._learn(list(new))
        end = np.array([end_id], f"<u{self.width}").tobytes()
        out = [b"".join(map(self.__getitem__, pieces)) + end for pieces in cut]
        if len(self) > KNOWN_PIECES:
            self.clear()
        return out


JOINED = 4096  # words that are encoded as one text
PLAIN = re.compile(r"[\x21-\x7e\xa1-\xff]+")
# Bytes of Latin-1: letters, white space; letters to lower case and white space to spaces.
_LETTERS = bytes(c for c in range(256) if chr(c).isalpha())
_NUMERIC = bytes(c for c in range(256) if chr(c).isnumeric())
_USUAL = _LETTERS + b"\t\n\x0b\x0c\r .,"
_LOWER = bytes(ord(chr(c).lower()) if c in _LETTERS else 32 if c in b"\t\n\x0b\x0c\r" else c for c in range(256))
# Signs, of which a run is one part; and what cannot be cut here: other characters, apostrophes (contractions
# are words) and the beginning of the file's special tokens.
_SIGN = r"!-/:-@\[-`{-~\xa1-\xa9\xab-\xb1\xb4\xb6-\xb8\xbb\xbf\xd7\xf7"
_ODD = r"[^\t-\r\x20-\x7e\xa1-\xff]|'|<\|"
ODD, ODD_BYTES = re.compile(_ODD), re.compile(_ODD.encode())
PAIR, RUN = re.compile(rf"[{_SIGN}][{_SIGN}]".encode()), re.compile(rf"[{_SIGN}]+".encode())


def _cut(raw: bytes, rest: bytes) -> list[str]:
    """The words, digits and runs of signs of a Latin-1 text without odd places; ``rest``: its characters that are not usual."""
    raw = raw.translate(_LOWER)
    if PAIR.search(raw) if rest else b".." in raw or b".," in raw or b",." in raw or b",," in raw:
        raw = RUN.sub(rb" \g<0> ", raw)
    else:
        raw = raw.replace(b".", b" . ").replace(b",", b" , ")
        for c in set(rest).difference(_NUMERIC):
            raw = raw.replace(bytes((c,)), b" %c " % c)
    for c in set(rest).intersection(_NUMERIC):
        raw = raw.replace(bytes((c,)), b" %c " % c)
    return raw.decode("latin-1").split()


def _pieces(text: str) -> list[str]:
    """The parts of a text that are encoded one by one."""
    try:
        raw = text.encode("latin-1")
        rest = raw.translate(None, _USUAL)
        if not rest or not ODD_BYTES.search(raw):
            return _cut(raw, rest)
    except UnicodeEncodeError:
        pass
    for c in "\t\n\x0b\x0c\r":
        text = text.replace(c, " ")
    out: list[str] = []
    at, n = 0, len(text)
    while at < n:  # from one piece with an odd place to the next
        m = ODD.search(text, at)
        start = n if m is None else text.rfind(" ", at, m.start()) + 1 or at
        raw = text[at:start].encode("latin-1")
        out += _cut(raw, raw.translate(None, _USUAL))
        if m is None:
            break
        at = text.find(" ", m.end())
        at = n if at < 0 else at
        out.append(text[start:at])
    return out


_CACHE: dict = {}


def _tools(path: str | None) -> tuple[Pieces, Checksums]:
    if path not in _CACHE:
        _CACHE[path] = (Pieces(path), Checksums())
    return _CACHE[path]


# --- operator -----------------------------------------------------------------------------

def write_records(docs: DataFrame, folder: str, path: str | None = None, end_id: int = END_ID) -> list[dict]:
    """Write all documents in doc_id order. Returns one dict per file, in order:
    file, n_docs, n_ids, and ``start``, the ids in the files before it."""
    tie = F.xxhash64("text")
    rows = (docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").withColumn("tie", tie)
            .repartitionByRange(F.col("doc_id").asc_nulls_first(), F.col("tie"))
            .sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "tie"))

    def run(batches):
        pieces, checksums = _tools(path)
        writer = None
        name = f"part-{TaskContext.get().partitionId():06d}"
        for b in batches:
            writer = writer or RecordWriter(folder, name, checksums)
            for a in range(0, len(b["doc_id"]), 256):
                texts = [t or "" for t in b["text"][a:a + 256]]
                writer.write(b["doc_id"][a:a + 256], pieces.encode(texts, end_id), pieces.width)
        if writer:
            writer.close()
            yield {"file": [name], "n_docs": [writer.n_docs], "n_ids": [writer.n_ids]}

    files = sorted(map_rows(rows, "file string, n_docs long, n_ids long", run).collect())
    out, start = [], 0
    for f in files:
        out.append({**f.asDict(), "start": start})
        start += f.n_ids
    return out


def _per_file(spark: SparkSession, files: list[dict]) -> DataFrame:
    schema = "file string, n_docs long, n_ids long, start long"
    return spark.createDataFrame([(f["file"], f["n_docs"], f["n_ids"], f["start"]) for f in files], schema) \
        .repartition(max(1, len(files)), "file")


def read_records(spark: SparkSession, folder: str, files: list[dict], order_seed: int | None = None) -> DataFrame:
    """doc_id, ids. Without a seed in file order; with one, each file's records
    are sought through its index in an order drawn from the seed."""
    def run(batches):
        _, checksums = _tools(None)
        for b in batches:
            for name in b["file"]:
                for found in (read_stream(f"{folder}/{name}.rec", checksums) if order_seed is None
                              else _shuffled(folder, name, order_seed, checksums)):
                    yield {"doc_id": [r[0] for r in found], "ids": [r[3].tolist() for r in found]}

    return map_rows(_per_file(spark, files), "doc_id long, ids array<int>", run)


def _shuffled(folder: str, name: str, seed: int, checksums: Checksums, group: int = 256):
    fs, base = file_system(folder)
    with fs.open_input_stream(f"{base}/{name}.idx") as f:
        index = np.frombuffer(f.read(), [("offset", "<u8"), ("doc_id", "<i8"), ("n", "<u4"), ("flags", "<u4")])
    order = np.random.default_rng([seed, zlib.crc32(name.encode())]).permutation(len(index))
    with fs.open_input_file(f"{base}/{name}.rec") as f:
        for a in range(0, len(order), group):
            out = []
            for e in index[order[a:a + group]]:
                raw = int(e["n"]) * (2 if e["flags"] & NARROW else 4)
                size = 16 + BODY.size + raw + -raw % 4
                out += parse_records(f.read_at(size, int(e["offset"])), checksums)[0]
            yield out


def record_digests(spark: SparkSession, folder: str, files: list[dict]) -> DataFrame:
    """Per record, read back from the files: doc_id, start, n_tokens, ids_crc32."""
    def run(batches):
        _, checksums = _tools(None)
        for b in batches:
            for name, start in zip(b["file"], b["start"]):
                for found in read_stream(f"{folder}/{name}.rec", checksums):
                    n = np.array([r[2] for r in found], np.int64)
                    first = start + np.cumsum(n) - n
                    start += int(n.sum())
                    yield {"doc_id": [r[0] for r in found], "start": first.tolist(), "n_tokens": n.tolist(),
                           "ids_crc32": [zlib.crc32(r[3].astype("<u4").tobytes()) for r in found]}

    return map_rows(_per_file(spark, files), "doc_id long, start long, n_tokens long, ids_crc32 long", run)


def op4_token_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = scratch_dir(spark, "records")
    files = write_records(documents(spark, sf_dir), folder)
    return record_digests(spark, folder, files)
