import hashlib
import os
from pathlib import Path

import public_tokenizers
import pytest
import sentencepiece

from specloom.llm import media, pieces


@pytest.mark.parametrize("n", [0, 1, 157, 158, 159, 160, 166, 170, 176, 180, 184, 575, 576, 9216, 9390, 9216 * 9 + 5])
def test_transport_stream_round_trip(n):
    payload = os.urandom(n)
    stream = media.mux(payload)
    parsed = media.demux(stream)
    s = parsed.streams[media.STREAM_PID]
    assert len(stream) % 188 == 0 and s.payload == payload and (s.gaps, s.repeats, parsed.bad_sections, parsed.lost_bytes) == (0, 0, 0, 0)
    units = -(-n // 9216)
    assert s.times == [k * media.TICKS for k in range(units)] and s.random == [k % media.INTERVAL == 0 for k in range(units)]


def test_streams_can_be_entered_at_their_random_access_points():
    payload = os.urandom(media.UNIT * media.UNITS * media.INTERVAL * 20 + 7)
    stream = media.mux(payload)
    packets = [stream[i : i + 188] for i in range(0, len(stream), 188)]
    tables = [i for i, p in enumerate(packets) if p[1] & 0x1F == 0 and p[2] == media.PAT_PID]
    points = [i for i, p in enumerate(packets) if p[1] & 0x40 and p[3] & 0x20 and p[4] and p[5] & 0x40]
    assert len(points) == 21 and tables == [i - 2 for i in points]
    assert [packets[i][3] & 15 for i in tables] == [packets[i + 1][3] & 15 for i in tables] == [k % 16 for k in range(21)]
    for k in (0, 1, 17, 20):
        s = media.demux(b"".join(packets[tables[k] :])).streams[media.STREAM_PID]
        assert s.payload == payload[k * media.INTERVAL * media.UNITS * media.UNIT :] and s.random[0] and s.gaps == 0
        assert s.times[0] == k * media.INTERVAL * media.TICKS
    clocks = [i for i, p in enumerate(packets) if p[3] & 0x20 and p[4] and p[5] & 0x10]
    assert len(clocks) == len(s.times) + 20 * media.INTERVAL  # one for each access unit


def test_media_query_equals_plain_python(spark, data):
    import zlib

    from specloom.llm import queries

    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{data}/documents.parquet").select("doc_id", "text").collect()}
    rows = queries.op7_media(spark, data).collect()
    assert len(rows) == len(texts)
    for r in rows:
        raw = (texts[r.doc_id] or "").encode()
        full = raw + b"\xff" * (-len(raw) % 576 or (0 if raw else 576))
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(raw), len(full), hashlib.sha256(full).hexdigest(), zlib.crc32(full[-32:]))
        assert r.times == [k * 3600 for k in range(-(-len(full) // 9216))] and r.random_access == r.times[::8]


def test_faults_are_counted():
    stream = media.mux(os.urandom(40_000))
    packets = [stream[i : i + 188] for i in range(0, len(stream), 188)]
    cut = media.demux(b"".join(packets[:20] + packets[21:]))
    assert cut.streams[media.STREAM_PID].gaps == 1
    again = media.demux(b"".join(packets[:20] + [packets[19]] + packets[20:]))
    assert again.streams[media.STREAM_PID].repeats == 1 and again.streams[media.STREAM_PID].payload == media.demux(stream).streams[media.STREAM_PID].payload
    shifted = media.demux(b"xyz" + stream)
    assert shifted.lost_bytes == 3 and shifted.packets == len(packets)
    broken = bytearray(stream)
    broken[20] ^= 1
    assert media.demux(bytes(broken)).bad_sections == 1
    assert media.demux(b"").packets == 0 and media.demux(b"G" * 50).packets == 0


def test_media_of_odd_rows(odd, none):
    rows = media.store(odd, with_media=True).collect()
    assert len(rows) == 6
    for r in rows:
        assert r.payload_bytes % 576 == 0 and r.payload_bytes > 0 and hashlib.sha256(bytes(r.media)).hexdigest() == r.media_sha256
    empty = [r for r in rows if r.doc_id in (1, 2)]
    assert empty[0].payload_sha256 == empty[1].payload_sha256 == hashlib.sha256(b"\xff" * 576).hexdigest() and empty[0].feature == empty[1].feature
    assert media.store(none).count() == 0


PATH = public_tokenizers.path("piece_bpe_32k.model")
DATA = Path(PATH).read_bytes()


def test_parity_with_sentencepiece(spark, data):
    texts = [r.text for r in spark.read.parquet(f"{data}/documents.parquet").select("text").collect()]
    pieces.Codec(DATA).verify([*texts, *pieces.PROBES])


def test_pieces_query_equals_sentencepiece(spark, data):
    import zlib

    import numpy as np

    from specloom.llm import queries

    own = sentencepiece.SentencePieceProcessor(model_file=PATH)
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{data}/documents.parquet").select("doc_id", "text").collect()}
    texts = dict(texts.items())
    rows = queries.op10_pieces(spark, data).collect()
    assert len(rows) == len(texts)
    for r in rows:
        ids = own.encode(texts[r.doc_id])
        back = own.decode(ids)
        want = (len(ids), zlib.crc32(np.asarray(ids, "<u4").tobytes()), sum(own.is_byte(i) for i in ids), sum(own.is_unknown(i) for i in ids), zlib.crc32(back.encode()), back == texts[r.doc_id])
        assert (r.n_tokens, r.ids_crc32, r.n_bytes_fallback, r.n_unknown, r.decoded_crc32, r.lossless) == want


def test_very_long_texts(spark):
    text = "Ein langer Text mit Wörtern, die sich wiederholen. " * 40_000 + "x" * 100_000
    rows = spark.createDataFrame([(1, text), (1, text)], "doc_id long, text string")
    a, b = media.store(rows).collect()
    assert a == b and a.n_bytes == len(text.encode())
    a, b = pieces.encode(rows, PATH).collect()
    assert a == b and a.lossless and a.n_tokens == len(sentencepiece.SentencePieceProcessor(model_file=PATH).encode(text))


def small_unigram(**fields):
    """A model file written by hand: protobuf messages of pieces, trainer and normaliser."""
    import struct

    def varint(n):
        out = b""
        while n > 127:
            out, n = out + bytes([n & 127 | 128]), n >> 7
        return out + bytes([n])

    def message(number, body):
        return varint(number << 3 | 2) + varint(len(body)) + body

    rows = [("<unk>", 0.0, 2), ("<s>", 0.0, 3), ("</s>", 0.0, 3), *((f"<0x{i:02X}>", 0.0, 6) for i in range(256))]
    rows += [("▁", -3.0, 1), ("a", -4.0, 1), ("b", -4.5, 1), ("ab", -5.0, 1), ("▁a", -5.5, 1), ("▁ab", -6.0, 1), ("ba", -6.2, 1), ("▁▁", -9.0, 1)]
    out = b"".join(message(1, message(1, p.encode()) + b"\x15" + struct.pack("<f", s) + b"\x18" + bytes([k])) for p, s, k in rows)
    return out + message(2, b"\x18\x01" + varint(35 << 3) + b"\x01") + message(3, message(1, b"identity") + b"\x18\x01" + b"\x20" + bytes([fields.get("single", 0)]) + b"\x28\x01")


@pytest.mark.parametrize("single", [0, 1])
def test_unigram_models_too(tmp_path, single):
    path = tmp_path / "m.model"
    path.write_bytes(small_unigram(single=single))
    own = sentencepiece.SentencePieceProcessor(model_file=str(path))
    codec = pieces.Codec(path.read_bytes())
    texts = ["ab", "aba bab", "ab  ba", " a ", "xyz", "é b", ""]
    assert codec.encode(texts) == own.encode(texts)
    assert codec.decode(codec.encode(texts)) == own.decode(own.encode(texts))


def test_pieces_of_odd_rows(odd, none):
    rows = pieces.encode(odd, PATH, with_ids=True).collect()
    assert len(rows) == 6 and all(r.n_tokens == 0 for r in rows if r.doc_id in (1, 2))
    assert pieces.encode(none, PATH).count() == 0


def test_words_are_encoded_once(data):
    """Ids and texts of odd texts are the library's own, and a word that was met before isn't encoded again."""
    import pyarrow.parquet as pq

    codec = pieces.Codec(DATA)
    texts = [t or "" for t in pq.read_table(f"{data}/documents.parquet", columns=["text"]).column(0).to_pylist()]
    texts += [*pieces.PROBES, "▁", " ▁ a", "a ", "\n", "😀\x00", "퟿ 𐍈 ", "<0x41> <unk>", "x" * 5000]
    for _ in range(2):
        ids, offsets = codec.encoded(texts)
        rows = [ids[a:b].tolist() for a, b in zip(offsets[:-1], offsets[1:], strict=True)]
        assert rows == codec.encode(texts) and list(codec.decoded(ids, offsets)) == codec.decode(rows)
        codec.words.learn = None  # nothing new the second time
    some = [[i] for i in range(len(codec.model.pieces))] + [[230, 130, 65], [3 + 0xC3, 3 + 0xA9, 3 + 0xFF], [0, 1, 2, 300], []]
    flat, at = sum(some, []), [0]
    for x in some:
        at.append(at[-1] + len(x))
    import numpy as np

    assert list(codec.decoded(np.asarray(flat, np.uint32), np.asarray(at))) == codec.decode(some)
