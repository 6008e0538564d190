"""Vectorised text primitives for Python workers: code points, character classes, runs, and 64-bit hashes of spans."""

from __future__ import annotations

import hashlib
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from specloom.llm.common import worker_cache

OTHER, LETTER, NUMBER, SPACE = 0, 1, 2, 3
#: White space as Unicode's White_Space property has it.
_SPACES = [*range(9, 14), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
_BASE = np.uint64(0x9E3779B97F4A7C15)
_MASKS = np.asarray([(1 << 8 * k) - 1 for k in range(9)], np.uint64)
#: Bytes of a span that are hashed together with other spans, eight at a time.
LONG = 256
_STEP = 0xD6E8FEB86659FD93


def char_classes() -> np.ndarray:
    """Class of each code point: letter, number, white space or other."""
    cache = worker_cache("textkit")
    if "classes" not in cache:
        kinds = {"L": LETTER, "N": NUMBER}
        table = np.fromiter((kinds.get(unicodedata.category(chr(i))[0], OTHER) for i in range(0x110000)), np.uint8, 0x110000)
        table[_SPACES] = SPACE
        cache["classes"] = table
    return cache["classes"]


def code_points(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """All code points one after another, and where each text starts (with the end as last entry)."""
    points = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), dtype="<u4")
    starts = np.zeros(len(texts) + 1, np.int64)
    np.cumsum(np.fromiter(map(len, texts), np.int64, len(texts)), out=starts[1:])
    return points, starts


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser."""
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h = h ^ (h >> np.uint64(27))
    h = h * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def _words(data: np.ndarray) -> np.ndarray:
    """The eight bytes from each place of data on, as one number, zeros beyond the end; no copy for each place."""
    return np.ndarray((len(data) + 1,), "<u8", np.append(data, np.zeros(8, np.uint8)), 0, (1,))


def _masks(rest: np.ndarray) -> np.ndarray:
    """What a word keeps if so many bytes of its span are left."""
    return _MASKS[np.minimum(rest, 8)]


def span_hashes(data: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hash of each span [begin, end) of bytes, the same wherever the span stands.

    Eight bytes at a time are mixed into the state, which starts with the length, so that spans of one length of up to eight
    bytes never share a hash. What a span has beyond LONG bytes goes through a cryptographic hash.
    """
    words, left = _words(data), end - begin
    out = mix((left.astype(np.uint64) + np.uint64(1)) * _BASE)
    out = np.where(left > 0, mix((out ^ words[begin] & _masks(left)) + _BASE), out)
    row = np.flatnonzero(left > 8)
    for step in range(8, LONG, 8):
        if not len(row):
            return out
        out[row] = mix((out[row] ^ words[begin[row] + step] & _masks(left[row] - step)) + _BASE)
        row = row[left[row] > step + 8]
    for r in row.tolist():
        rest = hashlib.blake2b(data[int(begin[r]) + LONG : int(end[r])].tobytes(), digest_size=8).digest()
        out[r] = mix(out[r : r + 1] ^ np.frombuffer(rest, "<u8"))[0]
    return out


def spans_equal(a: np.ndarray, at_a: np.ndarray, b: np.ndarray, at_b: np.ndarray, length: np.ndarray) -> np.ndarray:
    """Whether the spans of a from at_a and of b from at_b, of these lengths, hold the same bytes."""
    left, right = _words(a), _words(b)
    same = (left[at_a] ^ right[at_b]) & _masks(length) == 0
    row = np.flatnonzero(length > 8)
    for step in range(8, LONG, 8):
        if not len(row):
            return same
        same[row] &= (left[at_a[row] + step] ^ right[at_b[row] + step]) & _masks(length[row] - step) == 0
        row = row[length[row] > step + 8]
    for r in row.tolist():
        same[r] &= np.array_equal(a[at_a[r] : at_a[r] + length[r]], b[at_b[r] : at_b[r] + length[r]])
    return same


def runs(kinds: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Begin and end of the maximal runs of equal class; a run never crosses the start of a text."""
    n = len(kinds)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    first = np.empty(n, bool)
    first[0] = True
    np.not_equal(kinds[1:], kinds[:-1], out=first[1:])
    inner = starts[:-1]
    first[inner[inner < n]] = True
    begin = np.flatnonzero(first)
    return begin, np.append(begin[1:], n)


def _byte_classes() -> np.ndarray:
    """Class of each UTF-8 byte: letters, digits and bytes of further characters are letters."""
    cache = worker_cache("textkit")
    if "bytes" not in cache:
        kinds = np.full(256, OTHER, np.uint8)
        kinds[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = LETTER
        kinds[[*range(9, 14), 32]] = SPACE
        cache["bytes"] = kinds
    return cache["bytes"]


def _words_in(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The lower-cased bytes of all texts, the class of each byte, and where texts start (with the end as last entry)."""
    texts = pc.utf8_lower(pc.fill_null(texts, "").cast(pa.large_string()))
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    at = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[at[0] : at[-1]]
    return data, _byte_classes()[data], at - at[0]


def word_hashes(texts: pa.Array, *, punctuation: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the lower-cased words of each text and the offsets of the texts in them; null texts have none.

    Words are maximal runs of letters, digits and characters beyond ASCII; with punctuation, runs of other signs count too.
    The hashes spread words over buckets; they don't name them (word_digests does).
    """
    data, kinds, starts = _words_in(texts)
    begin, end = runs(kinds, starts)
    kind = kinds[begin]
    keep = kind != SPACE if punctuation else kind == LETTER
    begin, end = begin[keep], end[keep]
    if not len(begin):
        return np.zeros(0, np.uint64), np.zeros(len(starts), np.int64)
    return span_hashes(data, begin, end), np.searchsorted(begin, starts)


#: Words whose digests a worker keeps.
KNOWN = 300_000


def word_digests(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit columns of BLAKE2b digests of the lower-cased words of each text, and the offsets of the texts in them.

    Nobody finds two words of one digest, as one can for hashes that are quick to invert. Words are told apart by their
    bytes before they are hashed, each once a call, and known ones are looked up.
    """
    data, kinds, starts = _words_in(texts)
    begin, end = runs(kinds, starts)
    keep = kinds[begin] == LETTER
    begin, end = begin[keep], end[keep]
    at = np.zeros(len(begin) + 1, np.int64)
    np.cumsum(end - begin, out=at[1:])
    letters = data[kinds == LETTER]
    words = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(begin), [None, pa.py_buffer(at), pa.py_buffer(letters)]).dictionary_encode()
    known = worker_cache("digests")
    if len(known) > KNOWN:
        known.clear()
    found = []
    for w in words.dictionary.to_pylist():
        d = known.get(w)
        if d is None:
            d = known[w] = hashlib.blake2b(w, digest_size=16).digest()
        found.append(d)
    digests = np.frombuffer(b"".join(found), "<u8").reshape(-1, 2)
    return digests[words.indices.to_numpy()], np.searchsorted(begin, starts)


def slices(texts: pa.Array, most: int = 1_000_000) -> Iterator[tuple[int, int]]:
    """Slices of a column of about so many bytes, a text at least."""
    size = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False))
    k = 0
    while k < len(size):
        end = max(k + 1, int(np.searchsorted(size, (size[k - 1] if k else 0) + most, side="right")))
        yield k, end
        k = end


def ngram_hashes(words: np.ndarray, offsets: np.ndarray, n: int, *, chained: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the n-grams of words within each text, and the offsets of the texts in them.

    Chained hashes are mixed after each word, so that they aren't sums in which words can make up for each other.
    """
    count = np.maximum(np.diff(offsets) - (n - 1), 0)
    out = np.zeros(len(offsets), np.int64)
    np.cumsum(count, out=out[1:])
    at = np.repeat(offsets[:-1] - out[:-1], count) + np.arange(out[-1])
    h = np.zeros(out[-1], np.uint64)
    for k in range(n):
        h = h * np.uint64(_STEP) + words[at + k]
        if chained:
            h = mix(h)
    return h if chained else mix(h), out
