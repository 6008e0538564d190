"""Phrase collocation mining: count tries of each shard's word windows, merged by prefix range.

A shard's trie of limited depth is kept as its sorted paths with counts. All shards cut their paths at the same places; the
pieces of a range are merged, and a walk over the merged paths counts each phrase and finds its left parts. A phrase's
suffix link (the phrase without its first word) leads to its right parts.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from specloom.llm import common
from specloom.llm.spread import spread_join

#: Words of a phrase at most, and its least count.
DEPTH, LEAST = 4, 30
#: A phrase inside a longer one that makes at least so many percent of its occurrences is dropped.
SHARE = 80
#: Words whose windows a shard's trie holds, words of a range on average, most ranges, and bytes of text cut into words at once.
SHARD, RANGE, RANGES, SLICE = 500_000, 1_250_000, 1 << 18, 1_000_000
#: Texts and windows that are sampled to balance the ranges, about; they decide on nothing else.
TEXTS, WINDOWS = 2_000, 100_000
#: Buckets in which a language's phrases are ranked first.
BUCKETS = 256
_WORD, _BLANK, _BREAK = 0, 1, 2
_KINDS = np.zeros(256, np.uint8)
_KINDS[[0x20, 0x09]] = _BLANK
_KINDS[[*b".,;:!?", *range(0x0A, 0x0E)]] = _BREAK
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def cut_words(texts: list[np.ndarray]) -> tuple[pa.Array, np.ndarray]:
    """The lower-cased words of UTF-8 texts, and the number of each word's piece, which is never that of another text."""
    data = _LOWER[np.concatenate([*texts, np.zeros(0, np.uint8)])]
    kinds = _KINDS[data]
    size = np.asarray([len(t) for t in texts], np.int64)
    ends = np.zeros(len(data) + 1, bool)
    ends[np.cumsum(size) - size] = True
    ends = ends[:-1]
    word = kinds == _WORD
    first = word.copy()
    first[1:] &= ~word[:-1] | ends[1:]
    begin = np.flatnonzero(first)
    piece = np.cumsum((kinds == _BREAK) | ends)[begin]
    letters = data[word]
    at = np.append((np.cumsum(word) - 1)[begin], len(letters)).astype(np.int64)
    return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(begin), [None, pa.py_buffer(at), pa.py_buffer(letters)]), piece


def byte_slices(text: np.ndarray) -> Iterator[tuple[np.ndarray, bool]]:
    """A long text in slices that end between words, and whether the piece of the words before a slice may go on in it."""
    a, goes_on = 0, False
    while a < len(text):
        b = a
        while b < len(text):
            start, b = b, min(b + SLICE, len(text))
            ends = np.flatnonzero(_KINDS[text[start:b]] != _WORD)
            if b < len(text) and len(ends):
                b = start + int(ends[-1]) + 1
                break  # else one word is longer than a slice
        kinds = _KINDS[text[a:b]]
        yield text[a:b], goes_on
        word = np.flatnonzero(kinds == _WORD)
        goes_on = (goes_on or len(word) > 0) and not (kinds[word[-1] if len(word) else 0 :] == _BREAK).any()
        a = b


def _sums(group: np.ndarray, counts: np.ndarray | None, n: int) -> np.ndarray:
    """Exact sums of counts (of rows, if there are none) by group."""
    if counts is None:
        return np.bincount(group, minlength=n)
    out = np.zeros(n, np.int64)
    np.add.at(out, group, counts)
    return out


class Paths:
    """Sorted distinct paths: a column of words for each depth (null beyond a piece's end), and counts."""

    def __init__(self, vocabulary: pa.Array, ids: np.ndarray, counts: np.ndarray):
        self.vocabulary, self.ids, self.counts = vocabulary, ids, counts

    @classmethod
    def summed(cls, words: pa.Array, ids: np.ndarray, counts: np.ndarray | None) -> tuple[Paths, list[np.ndarray], list[np.ndarray]]:
        """Paths of rows of ids (numbers from 1 in words, 0 for none), not sorted; also, for each depth, the number of the
        prefix of each path and the counts of prefixes, in order."""
        order = pc.sort_indices(words).to_numpy()
        rank = np.zeros(len(words) + 1, np.int32)
        rank[order + 1] = np.arange(1, len(words) + 1)
        ids = rank[ids]
        node = np.zeros(len(ids), np.int64)
        numbers: list[np.ndarray] = []
        totals: list[np.ndarray] = []
        for k in range(DEPTH):
            _, first, node = np.unique(node << np.int64(32) | ids[:, k], return_index=True, return_inverse=True)
            totals.append(_sums(node, counts, len(first)))
            numbers.append(node.astype(np.int32))
        at = first
        return cls(words.take(pa.array(order)), ids[at], totals[-1]), [n[at] for n in numbers], totals

    def piece(self, a: int, b: int) -> bytes:
        """The paths from a to b alone, with the words that they use, as compressed bytes."""
        used, ids = np.unique(self.ids[a:b], return_inverse=True)
        ids = ids.reshape(b - a, DEPTH) + (0 if len(used) and used[0] == 0 else 1)
        words = self.vocabulary.take(pa.array(used[used > 0] - 1)).cast(pa.binary())
        columns = [pa.array(ids[:, k].astype(np.int32)) for k in range(DEPTH)]
        sink = pa.BufferOutputStream()
        options = pa.ipc.IpcWriteOptions(compression="zstd")
        for batch in (pa.RecordBatch.from_arrays([words], names=["word"]), pa.RecordBatch.from_arrays([*columns, pa.array(self.counts[a:b])], names=[*"abcd", "n"])):
            with pa.ipc.new_stream(sink, batch.schema, options=options) as out:
                out.write_batch(batch)
        return sink.getvalue().to_pybytes()

    @staticmethod
    def unpack(data: bytes) -> tuple[pa.Array, np.ndarray, np.ndarray]:
        source = pa.BufferReader(data)
        words = pa.ipc.open_stream(source).read_all().column(0).combine_chunks()
        rows = pa.ipc.open_stream(source).read_all()
        return words, np.stack([rows.column(k).to_numpy() for k in range(DEPTH)], 1), rows.column(DEPTH).to_numpy()

    def below(self, bound: list[bytes]) -> int:
        """How many paths come before a path given as words."""
        a, b = 0, len(self.ids)
        for k, word in enumerate(bound):
            number, there = self.lowest(word)
            column = self.ids[a:b, k]
            a, b = a + int(np.searchsorted(column, number)), a + int(np.searchsorted(column, number, side="right"))
            if not there or a == b:
                break
        return a

    def lowest(self, word: bytes) -> tuple[int, bool]:
        """The number of the first word that isn't smaller, and whether it is that word."""
        a, b = 0, len(self.vocabulary)
        while a < b:
            m = (a + b) // 2
            if self.vocabulary[m].as_py() < word:
                a = m + 1
            else:
                b = m
        return a + 1, a < len(self.vocabulary) and self.vocabulary[a].as_py() == word


class Shard:
    """Words of one language whose windows are not yet in a trie."""

    def __init__(self):
        self.words: list[pa.Array] = []
        self.pieces: list[np.ndarray] = []
        self.n = self.last = 0

    def add(self, words: pa.Array, pieces: np.ndarray, goes_on: bool) -> None:
        if len(words):
            shift = self.last - int(pieces[0]) + (0 if goes_on and pieces[0] == 1 else 1)
            self.words.append(words)
            self.pieces.append(pieces + shift)
            self.n, self.last = self.n + len(words), int(pieces[-1]) + shift

    def windows(self, *, final: bool) -> tuple[pa.Array, np.ndarray]:
        """The different words, and the windows as rows of numbers from 1; unless it is the final call, the last words, whose
        windows may go on, are kept."""
        words = pa.chunked_array(self.words or [pa.array([], pa.large_binary())]).dictionary_encode().unify_dictionaries()
        vocabulary = words.chunk(0).dictionary if words.num_chunks else pa.array([], pa.large_binary())
        ids = np.concatenate([c.indices.to_numpy() for c in words.chunks] or [np.zeros(0, np.int32)]) + np.int32(1)
        piece = np.concatenate(self.pieces or [np.zeros(0, np.int64)])
        n = len(ids) if final else max(len(ids) - (DEPTH - 1), 0)
        rows = np.zeros((n, DEPTH), np.int32)
        for k in range(DEPTH):
            m = min(n, len(ids) - k)
            if m > 0:
                rows[:m, k] = np.where(piece[:m] == piece[k : k + m], ids[k : k + m], 0)
        kept = vocabulary.take(pa.array(ids[n:] - 1))
        self.words, self.pieces, self.n = ([kept], [piece[n:]], len(kept)) if len(kept) else ([], [], 0)
        return vocabulary, rows


def _languages(batch: pa.RecordBatch) -> Iterator[tuple[str, pa.Array]]:
    """Each language of a batch (lang, text) with its texts as bytes."""
    langs = batch.column(0)
    for lang in pc.unique(langs).to_pylist():
        yield lang, batch.column(1).filter(pc.equal(langs, lang)).cast(pa.large_binary())


def _texts(texts: pa.Array) -> Iterator[tuple[list[np.ndarray], bool]]:
    """Lists of whole texts of about SLICE bytes together, and slices of longer texts."""
    held: list[np.ndarray] = []
    size = 0
    for t in texts:
        t = np.frombuffer(t.as_buffer(), np.uint8)
        if size + len(t) > SLICE and held:
            yield held, False
            held, size = [], 0
        if len(t) > SLICE:
            yield from (([part], goes_on) for part, goes_on in byte_slices(t))
        else:
            held.append(t)
            size += len(t)
    if held:
        yield held, False


def bounds(rows: DataFrame, total: int, words: int) -> dict[str, list[list[bytes]]]:
    """Paths at which the windows of each language are cut into ranges of about RANGE words: quantiles of a sample.

    They only balance the tasks. The sample is bounded (TEXTS, WINDOWS), and so are the ranges (RANGES).
    """

    share = min(1.0, TEXTS / max(total, 1))
    step = max(1, int(words * share / WINDOWS))

    def sample(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            langs, paths = [], []
            for lang, texts in _languages(batch):
                for t in texts:
                    own, pieces = cut_words([np.frombuffer(t.as_buffer(), np.uint8)[:SLICE]])
                    for at in range(0, len(own), step):
                        stop = at + int(np.searchsorted(pieces[at : at + DEPTH], pieces[at], side="right"))
                        langs.append(lang)
                        paths.append(own[at:stop].to_pylist())
            yield pa.RecordBatch.from_arrays([pa.array(langs, pa.string()), pa.array(paths, pa.list_(pa.binary()))], names=["lang", "path"])

    picked = rows.sample(False, share, 11)
    found: dict[str, list[list[bytes]]] = {}
    for r in common.arrow_map(picked, sample, "lang string, path array<binary>").collect():
        found.setdefault(r.lang, []).append([bytes(w) for w in r.path])
    every = sum(map(len, found.values()))
    ranges = min(max(math.ceil(words / RANGE), 8), RANGES)
    out = {}
    for lang, paths in found.items():
        paths.sort()
        own = max(1, round(ranges * len(paths) / every))
        cuts = [paths[len(paths) * k // own] for k in range(1, own)]
        out[lang] = [p for k, p in enumerate(cuts) if not k or p != cuts[k - 1]]
    return out


def shards(rows: DataFrame, cuts) -> DataFrame:
    """The tries of all shards (lang and text of rows) in pieces: lang, range, piece."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, Shard] = {}

        def flush(final: bool) -> Iterator[pa.RecordBatch]:
            for lang, shard in held.items():
                words, windows = shard.windows(final=final)
                if not len(windows):
                    continue
                paths = Paths.summed(words, windows, None)[0]
                at = [0, *(paths.below(c) for c in cuts.value.get(lang, [])), len(paths.ids)]
                for k, (a, b) in enumerate(zip(at[:-1], at[1:], strict=True)):
                    if a < b:
                        yield pa.RecordBatch.from_arrays([pa.array([lang]), pa.array([k], pa.int32()), pa.array([paths.piece(a, b)], pa.binary())], names=["lang", "range", "piece"])
            pa.default_memory_pool().release_unused()
            if not final:
                for lang in [lang for lang, shard in held.items() if not shard.n]:
                    del held[lang]

        for batch in batches:
            for lang, texts in _languages(batch):
                for some, goes_on in _texts(texts):
                    held.setdefault(lang, Shard()).add(*cut_words(some), goes_on)
                    if sum(s.n for s in held.values()) >= SHARD:
                        yield from flush(False)
        yield from flush(True)

    return common.arrow_map(rows.select("lang", "text"), run, "lang string, range int, piece binary")


def phrases(pieces: DataFrame, cuts, least: int) -> DataFrame:
    """Phrases of merged ranges: lang, phrase (words joined by a space), size, a (count), lefts (counts of its first words;
    null where a range doesn't see all of them), whole (whether its count is all there is).

    A range's number of words comes as a phrase of no words. Phrases on the path of a range's bound may go on in the next range: they come from each with a part of their count, and
    whatever it is.
    """

    def run(group: pa.Table) -> Iterator[pa.RecordBatch]:
        lang, k = group.column("lang")[0].as_py(), group.column("range")[0].as_py()
        blobs = [Paths.unpack(b.as_py()) for b in group.column("piece")]
        words = pa.chunked_array([w for w, _, _ in blobs]).dictionary_encode().unify_dictionaries()
        vocabulary, rows = words.chunk(0).dictionary, []
        for c, (_, ids, _) in zip(words.chunks, blobs, strict=True):
            rows.append(np.append(np.int32(0), c.indices.to_numpy() + np.int32(1))[ids])
        counts = np.concatenate([n for _, _, n in blobs])
        blobs.clear()
        paths, numbers, totals = Paths.summed(vocabulary, np.concatenate(rows), counts)
        own = cuts.value.get(lang, [])
        edges = [own[i] for i in (k - 1, k) if 0 <= i < len(own)]
        names = ["lang", "phrase", "size", "a", "lefts", "whole"]
        types = [pa.string(), pa.string(), pa.int32(), pa.int64(), pa.list_(pa.int64()), pa.bool_()]
        out: list[tuple] = [(lang, "", 0, int(paths.counts.sum()), [], True)]
        shared = [np.zeros(len(t), bool) for t in totals]
        for edge in edges:
            a, b = 0, len(paths.ids)
            for d, word in enumerate(edge):
                i, there = paths.lowest(word)
                if not there:
                    break
                a, b = a + int(np.searchsorted(paths.ids[a:b, d], i)), a + int(np.searchsorted(paths.ids[a:b, d], i, side="right"))
                if a >= b:
                    break
                shared[d][numbers[d][a]] = True
        for d in range(DEPTH):
            first = np.searchsorted(numbers[d], np.arange(len(totals[d])))
            real = paths.ids[first, d] > 0
            for node in np.flatnonzero(real & ((totals[d] >= least) | shared[d])).tolist():
                at = first[node]
                lefts = [None if shared[e][numbers[e][at]] else int(totals[e][numbers[e][at]]) for e in range(d)]
                text = b" ".join(paths.vocabulary[int(i) - 1].as_py() for i in paths.ids[at, : d + 1]).decode()
                out.append((lang, text, d + 1, int(totals[d][node]), lefts, not shared[d][node]))
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)], names=names)
        pa.default_memory_pool().release_unused()

    return common.by_group(pieces, ["lang", "range"], run, "lang string, phrase string, size int, a long, lefts array<long>, whole boolean")


def _words_of(phrase: Column, first: Column | int, n: Column | int) -> Column:
    return F.array_join(F.slice(F.split(phrase, " "), first, n), " ")


def _scored(found: DataFrame, least: int, total: int) -> DataFrame:
    """Candidates with the counts of all their parts, and the cut that scores lowest: lang, phrase, size, a, l, r, score."""
    open_ = found.where("not whole").groupBy("lang", "phrase", "size").agg(F.sum("a").alias("a"))
    open_ = common.cut(open_, "open")  # DEPTH for each bound at most, and bounds are few (RANGES)
    whole = found.where("whole").select("lang", "phrase", "size", "a", "lefts")
    split = open_.where(F.col("a") >= least).withColumn("lefts", F.transform(F.sequence(F.lit(0), F.col("size") - 1), lambda _: F.lit(None).cast("long")))
    split = split.withColumn("lefts", F.slice("lefts", 1, F.col("size") - 1)).select(*whole.columns)
    every = whole.unionByName(split)
    for k in range(1, DEPTH):
        part = open_.where(F.col("size") == k).select("lang", F.col("phrase").alias("__part"), F.col("a").alias("__a"))
        every = every.withColumn("__part", F.when((F.col("size") > k) & F.get("lefts", F.lit(k - 1)).isNull(), _words_of(F.col("phrase"), 1, k)))
        every = every.join(F.broadcast(part), ["lang", "__part"], "left")
        every = every.withColumn(f"l{k}", F.coalesce("__a", F.get("lefts", F.lit(k - 1)))).drop("__part", "__a")
    every = common.cut(every.drop("lefts"), "phrases")

    # suffix links: what is right of a phrase's first word is a phrase one word shorter, which knows its own right parts
    done = every.where("size = 1").select("lang", "phrase", "size", "a", *(f"l{k}" for k in range(1, DEPTH)), *(F.lit(None).cast("long").alias(f"r{k}") for k in range(1, DEPTH)))
    parts = [done]
    for size in range(2, DEPTH + 1):
        rows = every.where(F.col("size") == size).withColumn("suffix", _words_of(F.col("phrase"), 2, size - 1))
        uses = rows.groupBy("lang", "suffix").agg(F.count(F.lit(1)).alias("uses"))
        links = done.select("lang", F.col("phrase").alias("suffix"), F.col("a").alias("r1"), *(F.col(f"r{k - 1}").alias(f"r{k}") for k in range(2, DEPTH)))
        links = common.cut(links.join(uses, ["lang", "suffix"]), "links")
        done = common.cut(spread_join(rows, links, ["lang", "suffix"], n="uses", total=total).select(*parts[0].columns), "linked")
        parts.append(done)
    out = parts[1]
    for p in parts[2:]:
        out = out.unionByName(p)
    exact = "decimal(20,0)"
    cuts = []
    for k in range(1, DEPTH):
        l, r = F.col(f"l{k}"), F.col(f"r{k}")
        value = F.expr(f"(cast(a as {exact}) * cast(2000000 as {exact})) div (cast(l{k} as {exact}) + cast(r{k} as {exact}))")
        cuts.append(F.when(F.col("size") > k, F.struct(value.alias("score"), F.lit(k).alias("k"), l.alias("l"), r.alias("r"))))
    lowest = F.array_min(F.array_compact(F.array(*cuts)))
    return out.withColumn("low", lowest).select("lang", "phrase", "size", "a", F.col("low.l").alias("l"), F.col("low.r").alias("r"), F.col("low.score").alias("score"))


def collocations(docs: DataFrame, *, top: int = 2000, least: int = LEAST, share: int = SHARE, lang: str = "lang", text: str = "text") -> DataFrame:
    """The best phrases of each language: lang, rank (from 1), phrase, a, l, r, n, score.

    A-Z become a-z; texts are cut at `.,;:!?` and line ends into pieces, and those at spaces and tabs into words. A phrase
    has 2 to DEPTH words and `least` occurrences at least (a, within pieces, overlaps included). Of its cuts into a left
    part (l occurrences) and a right part (r) that of the lowest floor(2000000 a / (l + r)) scores, of equals the first.
    Phrases inside a longer one that has `share` percent of their occurrences are dropped. The first `top` of a language are
    returned, by score, then a, then UTF-8 bytes. n is the number of the language's words.

    Windows of DEPTH words are counted by sorted tries of shards, which travel in compressed pieces of prefix ranges; a prefix
    with most of the windows is cut further on, at any depth, and what stands on a bound is summed up afterwards.

    A null lang is 'und', a null text empty; a text of any length is read in slices; repeated rows count each; an empty table
    gives no rows; further columns are ignored.
    """
    body = F.coalesce(F.col(text), F.lit(""))
    rows = docs.select(F.coalesce(F.col(lang).cast("string"), F.lit("und")).alias("lang"), body.alias("text"))
    total, size = rows.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()
    cuts = rows.sparkSession.sparkContext.broadcast(bounds(rows, total, size // 6))
    found = common.cut(phrases(shards(rows, cuts), cuts, least), "phrases")
    words = found.where("size = 0").groupBy("lang").agg(F.sum("a").alias("n"))
    found = found.where("size > 0")
    scored = common.cut(_scored(found, least, found.count()), "scored")

    inside = [F.when(F.col("size") > k, _words_of(F.col("phrase"), i + 1, k)) for k in range(2, DEPTH) for i in range(DEPTH - k + 1)]
    fits = [(F.col("size") >= i + k) & (F.col("size") > k) for k in range(2, DEPTH) for i in range(DEPTH - k + 1)]
    parts = F.array_compact(F.array(*(F.when(ok, x) for ok, x in zip(fits, inside, strict=True))))
    longer = scored.where("size > 2").select("lang", F.explode(parts).alias("phrase"), F.col("a").alias("longer")).groupBy("lang", "phrase").agg(F.max("longer").alias("longer"))
    kept = scored.join(longer, ["lang", "phrase"], "left").where(F.col("longer").isNull() | (100 * F.col("longer") < share * F.col("a")))
    best = [F.desc("score"), F.desc("a"), F.col("phrase")]
    # first in each bucket of a language, so that the last task of a language sees `top` rows of each at most
    kept = kept.withColumn("bucket", F.pmod(F.xxhash64("phrase"), F.lit(BUCKETS)))
    kept = kept.withColumn("rank", F.row_number().over(W.partitionBy("lang", "bucket").orderBy(*best))).where(F.col("rank") <= top)
    rank = F.row_number().over(W.partitionBy("lang").orderBy(*best)).cast("long")
    kept = kept.withColumn("rank", rank).where(F.col("rank") <= top).join(words, "lang")
    return kept.select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
