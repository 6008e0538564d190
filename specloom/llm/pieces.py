"""SentencePiece models run by the tokenizers library: the protobuf is parsed, its parts are rebuilt, parity is verified."""

from __future__ import annotations

import hashlib
import os
import re
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from specloom.llm import common, packing

MARK = "▁"
UNIGRAM, BPE = 1, 2
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
#: Texts that every worker encodes with both libraries before it starts.
PROBES = ["", " ", "a", "Hello world", "  two  blanks ", "tabs\tand\nlines\n", "été naïve über ñandú", "日本語のテキスト", "emoji 😀 end", "1234567890 3.14", "▁mark ▁", "é ﬁ ½ 　x", "<s> </s> <unk>", "\x00\x01"]


def varint(data: bytes, at: int) -> tuple[int, int]:
    value = shift = 0
    while True:
        b = data[at]
        value |= (b & 0x7F) << shift
        at, shift = at + 1, shift + 7
        if b < 0x80:
            return value, at


def fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """Numbers and raw values of a protobuf message's fields, in order."""
    at = 0
    while at < len(data):
        key, at = varint(data, at)
        kind = key & 7
        if kind == 0:
            value, at = varint(data, at)
        elif kind == 2:
            size, at = varint(data, at)
            value, at = data[at : at + size], at + size
        elif kind in (1, 5):
            size = 8 if kind == 1 else 4
            value, at = data[at : at + size], at + size
        else:
            raise ValueError(f"wire type {kind} isn't one of protobuf's")
        yield key >> 3, value


@dataclass
class Model:
    """What of a model file encoding and decoding need."""

    pieces: list[tuple[str, float, int]] = field(default_factory=list)
    kind: int = UNIGRAM
    byte_fallback: bool = False
    suffix: bool = False
    charsmap: bytes = b""
    dummy_prefix: bool = True
    single_blanks: bool = True
    escape: bool = True

    @property
    def unknown(self) -> int:
        return next(i for i, p in enumerate(self.pieces) if p[2] == UNKNOWN)


def parse(data: bytes) -> Model:
    model = Model()
    for number, value in fields(data):
        if number == 1:
            piece, score, kind = "", 0.0, NORMAL
            for n, v in fields(value):
                if n == 1:
                    piece = v.decode("utf-8")
                elif n == 2:
                    score = struct.unpack("<f", v)[0]
                elif n == 3:
                    kind = v
            model.pieces.append((piece, score, kind))
        elif number == 2:
            own = dict(fields(value))
            model.kind, model.byte_fallback, model.suffix = own.get(3, UNIGRAM), bool(own.get(35, 0)), bool(own.get(24, 0))
        elif number == 3:
            own = dict(fields(value))
            model.charsmap = own.get(2, b"")
            model.dummy_prefix, model.single_blanks, model.escape = bool(own.get(3, 1)), bool(own.get(4, 1)), bool(own.get(5, 1))
    if model.kind not in (UNIGRAM, BPE) or model.suffix or not model.escape:
        raise ValueError("only unigram and BPE models with marked word beginnings are supported")
    return model


def merges(model: Model) -> list[tuple[str, str]]:
    """Pairs of pieces that make a piece, in the order in which SentencePiece prefers them: by falling score, then by
    vocabulary; pieces of one score are told apart by where they come in the vocabulary."""
    usable = {p: i for i, (p, _, kind) in enumerate(model.pieces) if kind in (NORMAL, USER, UNUSED)}
    found = []
    for i, (piece, score, kind) in enumerate(model.pieces):
        if kind == NORMAL:
            for k in range(1, len(piece)):
                if piece[:k] in usable and piece[k:] in usable:
                    found.append((-score, i, usable[piece[:k]], usable[piece[k:]], piece[:k], piece[k:]))
    found.sort()
    return [x[4:] for x in found]


def whole_words(model: Model) -> bool:
    """No piece has the mark after another sign, so words can be encoded one by one."""
    return all(MARK not in p.lstrip(MARK) for p, _, kind in model.pieces if kind in (NORMAL, USER))


def build(model: Model):
    """The model as a tokenizer of the tokenizers library."""
    from tokenizers import AddedToken, Regex, Tokenizer, decoders, models, normalizers, pre_tokenizers

    if model.kind == UNIGRAM:
        core = models.Unigram([(p, s) for p, s, _ in model.pieces], model.unknown, model.byte_fallback)
    else:
        vocabulary = {p: i for i, (p, _, _) in enumerate(model.pieces)}
        core = models.BPE(vocabulary, merges(model), unk_token=model.pieces[model.unknown][0], fuse_unk=True, byte_fallback=model.byte_fallback)
    tokenizer = Tokenizer(core)
    steps = [normalizers.Precompiled(model.charsmap)] if model.charsmap else []
    if model.single_blanks:
        steps += [normalizers.Replace(Regex("^ +| +$"), ""), normalizers.Replace(Regex(" {2,}"), " ")]
    if model.dummy_prefix:
        steps.append(normalizers.Prepend(" "))
    tokenizer.normalizer = normalizers.Sequence([*steps, normalizers.Replace(" ", MARK)])
    if whole_words(model):
        tokenizer.pre_tokenizer = pre_tokenizers.Split(Regex(f"{MARK}*[^{MARK}]+|{MARK}+"), "isolated")
    user = [AddedToken(p, normalized=False) for p, _, kind in model.pieces if kind == USER]
    if user:
        tokenizer.add_tokens(user)
    last = [decoders.Strip(" ", 1, 0)] if model.dummy_prefix else []
    tokenizer.decoder = decoders.Sequence([decoders.Replace(MARK, " "), decoders.ByteFallback(), decoders.Fuse(), *last])
    return tokenizer


class Words(packing.WordEncoder):
    """Ids word by word: a word is blanks and the other signs after them; what a model cuts nowhere else is encoded so."""

    def __init__(self, tokenizer):
        self.tokenizer, self.added = tokenizer, []
        self.clear()

    @staticmethod
    def spans(points: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        blank = points == 0x20
        first = np.append(blank, True)
        first[1:-1] &= ~blank[:-1]
        first[starts] = True
        begin = np.flatnonzero(first)
        return begin[:-1], begin[1:]

    def written(self, word: bytes) -> str:
        return word.decode("utf-8", "surrogatepass").replace(" ", MARK)


class Codec:
    """Encodes and decodes batches of texts, with as many threads as the process may use."""

    def __init__(self, data: bytes, *, threads: int = 1):
        self.model = parse(data)
        os.environ.setdefault("RAYON_NUM_THREADS", str(threads))
        os.environ["TOKENIZERS_PARALLELISM"] = "true" if threads > 1 else "false"
        self.tokenizer = build(self.model)
        self.data = data
        model = self.model
        user = any(kind == USER for _, _, kind in model.pieces)
        #: None where the library must see whole texts
        self.words = None if user or model.charsmap or model.single_blanks or not whole_words(model) else Words(self.tokenizer)
        # what a piece stands for by itself, in bytes; other pieces are left to the library
        self.direct = np.array([kind == BYTE or kind == NORMAL and not re.fullmatch("<0x[0-9A-Fa-f]{2}>", p) for p, _, kind in model.pieces], bool)
        plain = [bytes([int(p[3:5], 16)]) if kind == BYTE else p.replace(MARK, " ").encode("utf-8", "surrogatepass") for p, _, kind in model.pieces]
        self.size = np.fromiter(map(len, plain), np.int64, len(plain))
        self.at, self.plain = np.cumsum(self.size) - self.size, np.frombuffer(b"".join(plain), np.uint8)

    def encoded(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts one after another, and the offsets of the texts in them; as encode()."""
        if self.words is None:
            rows, wrong = [np.asarray(x, np.uint32) for x in self.encode(texts)], set()
        else:
            lead = " " if self.model.dummy_prefix else ""
            ids, offsets, wrong = self.words.by_words([t and lead + t.replace(MARK, " ") for t in texts])
            if not wrong:
                return ids, offsets
            rows = np.split(ids, offsets[1:-1])
        for i in wrong:
            rows[i] = np.asarray(self.encode([texts[i]])[0], np.uint32)
        return np.concatenate([np.zeros(0, np.uint32), *rows]), np.append(0, np.cumsum([len(x) for x in rows], dtype=np.int64))

    def decoded(self, ids: np.ndarray, offsets: np.ndarray) -> Iterator[str]:
        """The texts of ids, as decode() gives them: pieces put together, if each stands for bytes that make UTF-8 together."""
        size = self.size[ids]
        total = np.append(0, np.cumsum(size))
        data = self.plain[np.repeat(self.at[ids] - total[:-1], size) + np.arange(total[-1])].tobytes()
        odd = np.append(0, np.cumsum(~self.direct[ids]))[offsets]
        place = total[offsets]
        for i in range(len(offsets) - 1):
            own = data[place[i] : place[i + 1]]
            try:
                if odd[i] != odd[i + 1]:
                    raise UnicodeError
                text = own.decode("utf-8")
                yield text[1:] if self.model.dummy_prefix and text.startswith(" ") else text
            except UnicodeError:
                yield self.decode([ids[offsets[i] : offsets[i + 1]].tolist()])[0]

    def encode(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def decode(self, ids: list[list[int]]) -> list[str]:
        return self.tokenizer.decode_batch(ids, skip_special_tokens=False)

    def verify(self, texts: list[str]) -> None:
        """Both libraries must give the same ids, and the same texts back."""
        import sentencepiece

        own = sentencepiece.SentencePieceProcessor(model_proto=self.data)
        all_ids, offsets = self.encoded(texts)
        got = [all_ids[a:b].tolist() for a, b in zip(offsets[:-1], offsets[1:], strict=True)]
        for text, ids, want in zip(texts, got, own.encode(texts), strict=True):
            if ids != want:
                raise ValueError(f"ids of {text!r} differ: {ids} and {want}")
        for ids, a, b in zip(got, self.decoded(all_ids, offsets), own.decode(got), strict=True):
            if a != b:
                raise ValueError(f"texts of {ids} differ: {a!r} and {b!r}")


def codec(data: bytes, threads: int) -> Codec:
    cache, key = common.worker_cache("codecs"), hashlib.sha256(data).digest()
    if key not in cache:
        own = Codec(data, threads=threads)
        own.verify(PROBES)
        cache[key] = own
    return cache[key]


def encode(docs: DataFrame, model: str, *, threads: int = 2, doc_id: str = "doc_id", text: str = "text", with_ids: bool = False) -> DataFrame:
    """Ids of every text, and the text that they decode to. One pass without a shuffle.

    Returns doc_id, n_tokens, ids_crc32 (of little-endian unsigned 32-bit ids), n_bytes_fallback (ids of single bytes),
    n_unknown, decoded_crc32 (of the decoded text in UTF-8) and lossless (it equals the text); with_ids adds ids and decoded.

    Each worker first verifies parity with the sentencepiece library on PROBES. A null text is empty and has no ids; null
    ids stay null; repeated rows give equal rows; an empty table gives no rows; further columns are ignored. Whole texts
    are encoded, of any length; batches hold some million signs or one text. A model whose pieces don't reach over blanks is
    run word by word, each distinct word once a worker (packing.CACHE_WORDS at most are held).
    """
    schema = "doc_id long, n_tokens long, ids_crc32 long, n_bytes_fallback long, n_unknown long, decoded_crc32 long, lossless boolean"
    schema += ", ids array<int>, decoded string" if with_ids else ""
    names = [x.split()[0] for x in schema.split(", ")]

    held = common.vocabulary_bytes(docs.sparkSession, model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(held.value, threads)
        kinds = np.array([p[2] for p in own.model.pieces])
        for batch in batches:
            texts = batch.column(1).to_pylist()
            out: list[list] = [[] for _ in names[1:]]
            for a, b in packing.chunks(texts, packing.CHUNK_IDS if with_ids else packing.CHUNK):
                ids, offsets = own.encoded(texts[a:b])
                n_bytes, n_unknown = (np.diff(np.append(0, np.cumsum(kinds[ids] == k))[offsets]).tolist() for k in (BYTE, UNKNOWN))
                for i, (text, back) in enumerate(zip(texts[a:b], own.decoded(ids, offsets), strict=True)):
                    row = ids[offsets[i] : offsets[i + 1]].astype("<u4")
                    value = (len(row), zlib.crc32(row), n_bytes[i], n_unknown[i], zlib.crc32(back.encode("utf-8", "replace")), back == text, row, back)
                    for column, v in zip(out, value, strict=False):
                        column.append(v)
            types = [*[pa.int64()] * 5, pa.bool_(), pa.list_(pa.int32()), pa.string()]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, t) for c, t in zip(out, types, strict=False))], names=names)

    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    return common.arrow_map(rows, run, schema)
