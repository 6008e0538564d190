"""Packing by power-of-two decomposition: each document becomes pieces of binary lengths, each piece a sequence of its own."""

from __future__ import annotations

import hashlib
import itertools
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from specloom.llm import common, textkit
from specloom.llm.textkit import LETTER, OTHER, SPACE

MAX_TOKENS = 1024
#: Distinct words that a worker remembers with their ids, beyond which it starts afresh; and where ids go out too, as such
#: workers also serve other stages, which need their memory.
CACHE_WORDS, CACHE_WORDS_IDS = 2_000_000, 300_000
#: Code points encoded at once, and of texts whose ids go out too.
CHUNK, CHUNK_IDS = 4_000_000, 500_000

PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, bucket int"


def pretokens(points: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Spans that byte-level BPE of the GPT-2 kind encodes one by one.

    A span is a contraction, or a run of letters, numbers or other signs with one blank before it,
    or white space; of white space before a visible character the last sign stands apart.
    """
    n = len(points)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    kinds = textkit.char_classes()[points]
    begin, end = textkit.runs(kinds, starts)
    kind = kinds[begin]
    first = np.zeros(n + 1, bool)
    first[begin] = True
    first[n] = True
    inside = np.zeros(n + 1, bool)  # ends with its run, not with its text
    inside[:n] = True
    inside[starts] = False
    before = (kind == SPACE) & inside[end]
    last = end[before] - 1
    first[last] = True
    joined = last[points[last] == 0x20]
    first[joined + 1] = False  # the blank goes with what follows
    quote = (kind == OTHER) & (end - begin == 1) & (points[begin] == 0x27) & inside[end]
    at = begin[quote]
    at = at[first[at]]
    at = at[kinds[at + 1] == LETTER]
    if len(at):
        one = points[at + 1]
        two = np.where(at + 2 < n, points[np.minimum(at + 2, n - 1)], 0)
        two[~inside[np.minimum(at + 2, n)]] = 0
        short = np.isin(one, [ord(c) for c in "stmd"])
        long = ((one == ord("r")) | (one == ord("v"))) & (two == ord("e")) | (one == ord("l")) & (two == ord("l"))
        first[at[short | long] + 1] = False
        first[at[short] + 2] = True
        first[at[long] + 3] = True
    begin = np.flatnonzero(first)
    return begin[:-1], begin[1:]


class WordEncoder:
    """Ids of texts, word by word: each distinct word goes through the tokenizer once and is then looked up by its hash.

    A hit counts only if the word found has the same code points; a text with any other goes through the tokenizer itself.
    """

    most = CACHE_WORDS

    def __init__(self, data: bytes):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_buffer(data)
        self.added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        plain = [b for b in range(256) if 0x21 <= b <= 0x7E or 0xA1 <= b <= 0xAC or 0xAE <= b <= 0xFF]
        rest = [b for b in range(256) if b not in plain]
        self.visible = {b: chr(256 + k) for k, b in enumerate(rest)}  # how byte-level BPE writes bytes that have no sign
        self.clear()

    def clear(self) -> None:
        self.hashes = np.zeros(0, np.uint64)
        self.at, self.size, self.ids = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint32)
        self.place, self.length, self.words = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint8)

    spans = staticmethod(pretokens)

    def written(self, word: bytes) -> str:
        """A word as the tokenizer's model takes it."""
        return word.decode("latin-1").translate(self.visible)

    def learn(self, data: np.ndarray, hashes: np.ndarray, begin: np.ndarray, end: np.ndarray) -> None:
        """Ids of words not met before, by the tokenizer's model, which takes bytes in their visible form."""
        tokenize = self.tokenizer.model.tokenize
        words = [data[a:b].tobytes() for a, b in zip(begin.tolist(), end.tolist(), strict=True)]
        ids = [[t.id for t in tokenize(self.written(w))] for w in words]
        size = np.fromiter(map(len, ids), np.int64, len(ids))
        at = len(self.ids) + np.cumsum(size) - size
        self.ids = np.append(self.ids, np.fromiter(itertools.chain.from_iterable(ids), np.uint32, size.sum()))
        length = end - begin
        place = len(self.words) + np.cumsum(length) - length
        self.words = np.append(self.words, np.frombuffer(b"".join(words), np.uint8))
        order = np.argsort(merged := np.concatenate([self.hashes, hashes]), kind="stable")
        self.hashes = merged[order]
        for name, new in (("at", at), ("size", size), ("place", place), ("length", length)):
            setattr(self, name, np.concatenate([getattr(self, name), new])[order])

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts one after another, and the offsets of the texts in them; as the tokenizer's own encode."""
        held = {i for i, t in enumerate(texts) if any(a in t for a in self.added)}  # an added token is one id wherever it stands
        ids, offsets, wrong = self.by_words(["" if i in held else t for i, t in enumerate(texts)] if held else texts)
        held |= wrong
        if not held:
            return ids, offsets
        parts = np.split(ids, offsets[1:-1])
        for i in held:
            parts[i] = np.asarray(self.tokenizer.encode(texts[i], add_special_tokens=False).ids, np.uint32)
        return np.concatenate(parts), np.append(0, np.cumsum([len(x) for x in parts]))

    def by_words(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, set[int]]:
        """Ids and offsets of texts without added tokens, and which of them hold a word that only looks known."""
        points, starts = textkit.code_points(texts)
        begin, end = self.spans(points, starts)
        if not len(begin):
            return np.zeros(0, np.uint32), np.zeros(len(texts) + 1, np.int64), set()
        data = np.frombuffer("".join(texts).encode("utf-8", "surrogatepass"), np.uint8)
        first, last = begin, end
        if len(data) > len(points):  # places in bytes
            place = np.append(0, np.cumsum(1 + (points > 0x7F).view(np.uint8) + (points > 0x7FF) + (points > 0xFFFF), dtype=np.int64))
            first, last = place[begin], place[end]
        distinct, where, back = np.unique(textkit.span_hashes(data, first, last), return_index=True, return_inverse=True)
        new = distinct[~self.known(distinct)]
        if len(new) + len(self.hashes) > self.most:
            self.clear()
            new = distinct
        if len(new):
            w = where[np.searchsorted(distinct, new)]
            self.learn(data, new, first[w], last[w])
        slot = np.searchsorted(self.hashes, distinct)[back]
        size, at = self.size[slot], self.at[slot]
        total = np.cumsum(size)
        ids = self.ids[np.repeat(at - (total - size), size) + np.arange(total[-1])]
        length = last - first
        same = (self.length[slot] == length) & textkit.spans_equal(self.words, self.place[slot], data, first, np.minimum(length, self.length[slot]))
        wrong = np.searchsorted(starts, begin[~same], side="right") - 1
        return ids, np.append(0, total)[np.searchsorted(begin, starts)], set(wrong.tolist())

    def known(self, hashes: np.ndarray) -> np.ndarray:
        if not len(self.hashes):
            return np.zeros(len(hashes), bool)
        return self.hashes[np.minimum(np.searchsorted(self.hashes, hashes), len(self.hashes) - 1)] == hashes


def encoder(data: bytes) -> WordEncoder:
    cache, key = common.worker_cache("encoders"), hashlib.sha256(data).digest()
    if key not in cache:
        cache[key] = WordEncoder(data)
    return cache[key]


def binary_lengths(n: int, largest: int) -> list[int]:
    """Lengths of the pieces of n tokens: as many of the largest as fit, then the binary digits of the rest, falling."""
    return [largest] * (n // largest) + [1 << k for k in range(largest.bit_length() - 2, -1, -1) if n % largest >> k & 1]


def chunks(texts: list[str], most: int = CHUNK) -> Iterator[tuple[int, int]]:
    """Slices of texts of about so many characters, a text at least."""
    k = size = 0
    for i, t in enumerate(texts):
        if size and size + len(t) > most:
            yield k, i
            k, size = i, 0
        size += len(t)
    if k < len(texts):
        yield k, len(texts)


def pack(
    docs: DataFrame,
    tokenizer: str,
    *,
    max_tokens: int = MAX_TOKENS,
    doc_id: str = "doc_id",
    text: str = "text",
    end_id: int = 0,
    with_ids: bool = False,
) -> DataFrame:
    """Pieces of all documents, each of a power-of-two length up to max_tokens and a sequence of its own.

    A document is its token ids and then end_id. As each sequence is one piece of one document, none crosses documents and
    none is padded. The bucket (binary logarithm of the length) holds sequences of equal length; sequence_id is unique and
    sorts by bucket. One pass without a shuffle; a retried task makes the same rows.

    A null text is empty and gives one piece with end_id alone; a null doc_id stays null; repeated rows are each packed; an
    empty table gives no rows; columns beside doc_id and text are ignored. Very long texts are cut in as many pieces as they
    need; the ids of one document must fit in a worker's memory.
    with_ids adds the ids of each piece.
    """
    if max_tokens & (max_tokens - 1) or max_tokens < 1:
        raise ValueError("max_tokens must be a power of two")
    schema = PIECES + (", ids array<int>" if with_ids else "")

    vocabulary = common.vocabulary_bytes(docs.sparkSession, tokenizer)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code = encoder(vocabulary.value)
        code.most = CACHE_WORDS_IDS if with_ids else CACHE_WORDS
        local = 0
        for batch in batches:
            keys, texts, part = batch.column(0), batch.column(1).to_pylist(), batch.column(2)
            for a, b in chunks(texts, CHUNK_IDS if with_ids else CHUNK):
                ids, offsets = code.encode(texts[a:b])
                row, start, length, crc, tokens, pieces = [], [], [], [], [], []
                for i in range(b - a):
                    own = np.append(ids[offsets[i] : offsets[i + 1]], np.uint32(end_id)).astype("<u4")
                    at = 0
                    for size in binary_lengths(len(own), max_tokens):
                        row.append(a + i)
                        start.append(at)
                        length.append(size)
                        crc.append(zlib.crc32(own[at : at + size]))
                        tokens.append(len(own))
                        at += size
                    if with_ids:
                        pieces.append(own)
                size = np.asarray(length, np.int64)
                bucket = np.log2(size).astype(np.int64)
                sequence = (bucket << 58) + (np.asarray(part.take(pa.array(row, pa.int64())), np.int64) << 33) + local + np.arange(len(row))
                local += len(row)
                out = [keys.take(pa.array(row, pa.int64())).cast(pa.int64()), *(pa.array(x, pa.int64()) for x in (start, length, crc, tokens, sequence)), pa.array(np.zeros(len(row), np.int64)), pa.array(bucket.astype(np.int32))]
                names = [x.split()[0] for x in PIECES.split(", ")]
                if with_ids:
                    out.append(pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(size)).astype(np.int32)), pa.array(np.concatenate(pieces).astype(np.int32))))
                    names.append("ids")
                yield pa.RecordBatch.from_arrays(out, names=names)
        if with_ids:
            code.clear()
            pa.default_memory_pool().release_unused()

    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"), F.spark_partition_id().cast("long").alias("part"))
    return common.arrow_map(rows, run, schema)


def write_buckets(pieces: DataFrame, path: str) -> None:
    """Sequences as Parquet, a folder for each bucket of equal lengths."""
    pieces.write.partitionBy("bucket").parquet(path)


def bucket_report(pieces: DataFrame) -> DataFrame:
    """Sequences and tokens of each bucket."""
    number: Column = F.count(F.lit(1)).alias("sequences")
    return pieces.groupBy("bucket").agg(number, F.sum("length").alias("tokens"))
