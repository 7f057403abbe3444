import struct
import zlib

import numpy as np
import public_tokenizers
import pytest
from quarry.llm import op4_records as op
from quarry.session import scratch_dir
from tokenizers import Tokenizer

LIBRARY = Tokenizer.from_file(public_tokenizers.path(op.TOKENIZER))


def ids_of(text):
    return LIBRARY.encode(text or "", add_special_tokens=False).ids + [op.END_ID]


def test_checksum_of_known_values():
    assert op.Checksums()([b"\0" * 32, b"\xff" * 32, bytes(range(32))]) == [0x8A9136AA, 0x62A8AB43, 0x46DD794E]


def test_checksum_against_the_bitwise_definition():
    def plain(data):
        crc = 0xFFFFFFFF
        for byte in data:
            crc ^= byte
            for _ in range(8):
                crc = (crc >> 1) ^ (0x82F63B78 if crc & 1 else 0)
        return crc ^ 0xFFFFFFFF

    r = np.random.default_rng(1)
    data = [r.bytes(4 * int(n)) for n in (1, 2, 3, 255, 256, 257, 511, 512, 513, 2000)]
    assert op.Checksums()(data) == [plain(d) for d in data]


def test_query_on_odd_rows(spark, odd, odd_docs):
    want, start = [], 0
    by_id = sorted(odd_docs, key=lambda r: (r[0] is not None, r[0] or 0))
    for d, t in by_id:
        ids = ids_of(t)
        want.append((d, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    got = [tuple(r) for r in op.op4_token_records(spark, odd).select("doc_id", "start", "n_tokens", "ids_crc32").collect()]
    # Rows with equal ids may stand in either order; starts still follow each other.
    assert sorted((str(d), n, c) for d, _, n, c in got) == sorted((str(d), n, c) for d, _, n, c in want)
    got.sort(key=lambda r: r[1])
    assert [r[1] for r in got] == list(np.cumsum([0] + [r[2] for r in got[:-1]]))
    assert [r[0] for r in got] == [r[0] for r in want]


def test_files_read_in_order_and_shuffled(spark, odd, odd_docs):
    folder = scratch_dir(spark, "test-records")
    files = op.write_records(spark.read.parquet(f"{odd}/documents.parquet"), folder)
    plain = sorted((str(r.doc_id), tuple(r.ids)) for r in op.read_records(spark, folder, files).collect())
    assert plain == sorted((str(d), tuple(ids_of(t))) for d, t in odd_docs)
    drawn = op.read_records(spark, folder, files, order_seed=4).collect()
    assert sorted((str(r.doc_id), tuple(r.ids)) for r in drawn) == plain
    again = op.read_records(spark, folder, files, order_seed=4).collect()
    assert [r.doc_id for r in again] == [r.doc_id for r in drawn]


def test_damage_is_found(tmp_path):
    w = op.RecordWriter(str(tmp_path), "f", op.Checksums())
    w.write([1, None], [np.array([5, 2], "<u2").tobytes(), np.array([2], "<u2").tobytes()], 2)
    w.close()
    path = tmp_path / "f.rec"
    data = path.read_bytes()
    records, used = op.parse_records(data, op.Checksums())
    assert used == len(data) and [(d, n, ids.tolist()) for d, _, n, ids in records] == [(1, 2, [5, 2]), (None, 1, [2])]
    assert struct.unpack_from("<Q", data)[0] == 20
    for at in (0, 9, 14, 30, len(data) - 1):
        bad = bytearray(data)
        bad[at] ^= 1
        path.write_bytes(bad)
        with pytest.raises(ValueError):
            list(op.read_stream(str(path), op.Checksums()))
    path.write_bytes(data[:-3])
    with pytest.raises(ValueError):
        list(op.read_stream(str(path), op.Checksums()))


def test_records_longer_than_a_chunk(tmp_path):
    w = op.RecordWriter(str(tmp_path), "f", op.Checksums())
    sizes = [3, 5000, 1, 70_000, 2]
    w.write(list(range(5)), [np.arange(n, dtype="<u2").tobytes() for n in sizes], 2)
    w.close()
    found = [r for part in op.read_stream(str(tmp_path / "f.rec"), op.Checksums(), chunk=1000) for r in part]
    assert [(r[0], r[2]) for r in found] == list(enumerate(sizes))


def test_pieces_equal_whole_texts():
    texts = ["A B C\x1cD", "Émilé <|endoftext|>x <|startoftext|>", "don't WE'LL 1234 ½ ΑΣ ΟΔΟΣ", "", " \n", "İstanbul ﬁ"]
    got = op.Pieces(None).encode(texts, op.END_ID)
    assert [np.frombuffer(g, "<u2").tolist() for g in got] == [ids_of(t) for t in texts]


def test_empty_table(spark, none):
    assert op.op4_token_records(spark, none).count() == 0
