"""N-gram Jaccard join by MinHash banding, with every candidate verified on full n-gram sets."""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from specloom.llm import common, textkit

#: Words of a shingle, least similarity, and the least chance that a pair of just that similarity becomes a candidate.
WORDS, THRESHOLD, RECALL = 5, 0.8, 0.999
#: Sets of so few n-grams are named by both sides of their hashes.
FEW = 4
#: Members and n-grams of a block of a large candidate group; two blocks are compared at once.
BLOCK_MEMBERS, BLOCK_GRAMS = 256, 1_000_000
_INCIDENCE = 4096


def choose_bands(threshold: float, recall: float, rows: int = 5) -> tuple[int, int]:
    """Bands and rows: as few bands of so many rows as give a pair at the threshold the wanted chance to share one."""
    return math.ceil(math.log(1 - recall) / math.log(1 - threshold**rows)), rows


def shingle_sets(texts: pa.Array, n: int, side: int = 0) -> Iterator[np.ndarray]:
    """Sorted distinct hashes of each text's n-grams of words; a shorter text is one shingle of all its words.

    There are two sides, made from different halves of the words' digests: members meet by the one and are compared by the
    other, so that a link needs n-grams which agree in both.
    """
    for a, b in textkit.slices(texts):
        words, at = textkit.word_digests(texts.slice(a, b - a))
        words = np.ascontiguousarray(words[:, side])
        grams, off = textkit.ngram_hashes(words, at, n, chained=True)
        for i in range(b - a):
            if off[i] < off[i + 1]:
                yield np.unique(grams[off[i] : off[i + 1]])
            elif at[i] < at[i + 1]:
                h = np.asarray([at[i + 1] - at[i]], np.uint64)
                for w in words[at[i] : at[i + 1]]:
                    h = textkit.mix(h * np.uint64(31) ^ w)
                yield h
            else:
                yield np.zeros(0, np.uint64)


def band_hashes(sets: list[np.ndarray], bands: int, rows: int, seed: int) -> np.ndarray:
    """A row of band hashes for each set; sets must not be empty."""
    factors = np.random.default_rng(seed).integers(1, 1 << 63, bands * rows, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    out = np.zeros((len(sets), bands), np.uint64)
    size = np.fromiter(map(len, sets), np.int64, len(sets))
    begin = np.cumsum(size) - size
    grams = np.concatenate(sets)
    for band in range(bands):
        h = np.full(len(sets), band, np.uint64)
        for k in range(rows):
            low = np.minimum.reduceat((grams * factors[band * rows + k]) >> np.uint64(32), begin)
            h = textkit.mix(h * np.uint64(0x9E3779B97F4A7C15) + low)
        out[:, band] = h
    return out


def fingerprint(grams: np.ndarray, other: np.ndarray | None = None) -> bytes:
    """128 bits that stand for the set; half of them come from its other side, if that is given."""
    other = grams if other is None else other
    a = textkit.mix(grams).sum(dtype=np.uint64) + np.uint64(len(grams))
    b = np.bitwise_xor.reduce(textkit.mix(other ^ np.uint64(0x5851F42D4C957F2D))) if len(other) else np.uint64(0)
    return np.asarray([a, b], ">u8").tobytes()


def shared_counts(sets: list[np.ndarray]) -> np.ndarray:
    """Matrix of the sizes of all intersections, by products of incidence blocks over n-grams that two sets have at least."""
    n = len(sets)
    owner = np.repeat(np.arange(n), [len(s) for s in sets])
    _, gram, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    often = count[gram] > 1
    owner, (_, gram) = owner[often], np.unique(gram[often], return_inverse=True)
    order = np.argsort(gram, kind="stable")
    owner, gram = owner[order], gram[order]
    out = np.zeros((n, n), np.float32)
    for a in range(0, int(gram[-1]) + 1 if len(gram) else 0, _INCIDENCE):
        i, j = np.searchsorted(gram, [a, a + _INCIDENCE])
        m = np.zeros((n, min(_INCIDENCE, int(gram[-1]) + 1 - a)), np.float32)
        m[owner[i:j], gram[i:j] - a] = 1
        out += m @ m.T
    return out


def verify_group(sets: list[np.ndarray], bands: np.ndarray, side: np.ndarray, band: int, threshold: float, *, apart: bool) -> np.ndarray:
    """Which members are linked: at least the threshold alike, first together in this band, and, if two different blocks
    meet (apart), on their two sides; the pairs of one side count where their block meets itself."""
    n = len(sets)
    size = np.fromiter(map(len, sets), np.int64, n)
    shared = shared_counts(sets)
    linked = shared >= threshold * (size[:, None] + size[None, :] - shared) - 1e-6
    for k in range(band):
        linked &= bands[:, None, k] != bands[None, :, k]
    if apart:
        linked &= side[:, None] != side[None, :]
    np.fill_diagonal(linked, False)
    return linked


def roots(linked: np.ndarray) -> np.ndarray:
    """The first member of each member's component."""
    label = np.arange(len(linked))
    while True:
        low = np.minimum(label, np.where(linked, label[None, :], len(linked)).min(1))
        low = low[low]
        if (low == label).all():
            return label
        label = low


class Members:
    """Members of a block: names, n-gram sets, band hashes and counts of copies."""

    def __init__(self, names: list[bytes], grams: list[np.ndarray], marks: np.ndarray, copies: np.ndarray):
        self.names, self.grams, self.marks, self.copies = names, grams, marks, copies

    def packed(self) -> bytes:
        """The sets as steps through the list of all their n-grams: near copies take the same steps, which compress well."""
        every = np.unique(np.concatenate(self.grams))
        steps = [np.diff(np.searchsorted(every, g), prepend=0).astype(np.uint32) for g in self.grams]
        size = np.asarray([len(g) for g in self.grams], np.int64)
        head = np.asarray([len(self.names), len(every), self.marks.shape[1]], np.int64)
        return zlib.compress(b"".join(x.tobytes() for x in (head, size, self.copies, every, self.marks, *steps)) + b"".join(self.names), 1)

    @classmethod
    def unpacked(cls, data: bytes) -> Members:
        data = zlib.decompress(data)
        at = 0

        def take(kind, n: int) -> np.ndarray:
            nonlocal at
            out = np.frombuffer(data, kind, n, at)
            at += out.nbytes
            return out

        n, every, bands = take(np.int64, 3).tolist()
        size, copies, grams = take(np.int64, n), take(np.int64, n), take(np.uint64, every)
        marks = take(np.int64, n * bands).reshape(n, bands)
        sets = [grams[np.cumsum(take(np.uint32, k), dtype=np.int64)] for k in size.tolist()]
        return cls([data[at + 16 * k : at + 16 * k + 16] for k in range(n)], sets, marks, copies)

    def __add__(self, other: Members) -> Members:
        return Members(self.names + other.names, self.grams + other.grams, np.concatenate([self.marks, other.marks]), np.concatenate([self.copies, other.copies]))

    def links(self, side: np.ndarray, band: int, threshold: float, *, apart: bool) -> list[pa.Array]:
        """Members with links, the first member of the component of each, and the links' number."""
        linked = verify_group(self.grams, self.marks, side, band, threshold, apart=apart)
        links, root = linked @ self.copies, roots(linked)
        has = np.flatnonzero(linked.any(1))
        return [pa.array([self.names[k] for k in has], pa.binary()), pa.array([self.names[root[k]] for k in has], pa.binary()), pa.array(links[has], pa.int64())]


def within(group: pa.Table, threshold: float) -> Iterator[pa.RecordBatch]:
    """Links inside a block; and the block, packed, if its group has others."""
    band, key, i, blocks = (group.column(c)[0].as_py() for c in ("band", "hash", "i", "blocks"))
    names = group.column("member").to_pylist()
    first = {m: k for k, m in reversed(list(enumerate(names)))}  # a repeated row gives its set twice
    pick = sorted(first.values(), key=names.__getitem__)
    group = group.take(pa.array(pick))
    own = Members([names[k] for k in pick], [np.frombuffer(x, np.uint64) for x in group.column("grams").to_pylist()], np.asarray(group.column("bands").to_pylist(), np.int64), np.asarray(group.column("copies"), np.int64))
    columns = own.links(np.zeros(len(pick), bool), band, threshold, apart=False)
    n = len(columns[0])
    types = [pa.int32(), pa.int64(), pa.int32(), pa.int32(), pa.binary()]
    names = ["u", "v", "links", "band", "hash", "i", "blocks", "packed"]
    if n:
        yield pa.RecordBatch.from_arrays([*columns, *(pa.nulls(n, t) for t in types)], names=names)
    if blocks > 1:
        row = (None, None, None, band, key, i, blocks, own.packed())
        yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row, [pa.binary(), pa.binary(), pa.int64(), *types], strict=True)], names=names)


def between(group: pa.Table, threshold: float) -> Iterator[pa.RecordBatch]:
    """Links from one of two blocks of a group to the other; a block without members is not there."""
    if group.num_rows < 2:
        return
    band, (a, b) = group.column("band")[0].as_py(), (Members.unpacked(x) for x in group.column("packed").to_pylist())
    columns = (a + b).links(np.arange(len(a.names) + len(b.names)) < len(a.names), band, threshold, apart=True)
    if len(columns[0]):
        yield pa.RecordBatch.from_arrays(columns, names=["u", "v", "links"])


def components(edges: DataFrame) -> DataFrame:
    """Smallest vertex of each vertex's component, by alternating large-star and small-star; columns u, v of edges.

    Each round is written to the shared folder. The number of rounds grows with the logarithm of a component's size.
    """
    high, low = F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")
    edges = common.cut(edges.where(F.col("u") != F.col("v")).select(high, low).distinct(), "edges")
    before = None
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.where(F.col("v") > F.col("u")).join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").where(F.col("v") != F.col("m")).select(F.col("v").alias("u"), F.col("m").alias("v"))
        last, edges = edges, common.cut(least.select("u", F.col("m").alias("v")).unionByName(small).distinct(), "edges")
        common.discard(last)
        now = edges.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v"))).first()
        if now == before:
            return edges
        before = now


def similar(
    docs: DataFrame,
    *,
    n: int = WORDS,
    threshold: float = THRESHOLD,
    recall: float = RECALL,
    seed: int = 5,
    doc_id: str = "doc_id",
    text: str = "text",
) -> DataFrame:
    """Joins the table with itself on the Jaccard similarity of n-gram sets; one row for each document row.

    Returns doc_id, text_hash (with doc_id, the row's identity), class_id (smallest doc_id of its component of links),
    n_links (other rows at least as similar as the threshold), n_shingles, keeper (the row is its class's first).

    Words are named by cryptographic digests. Rows of equal sets become one member with a count, so copies are never expanded. Members shuffle on band hashes.
    Buckets with the same members are merged; each is compared within itself, large ones in blocks and pairs of blocks. Sets
    travel once for each block they are in; what meets in pairs are blocks packed to little more than one of their sets, if
    they hold near copies. A pair counts in the first band that it shares. Only sums and a forest of links leave a comparison, never all pairs; no candidate is
    left out.

    A null text is empty; empty texts have the empty set and are copies of each other. A text of fewer than n words is one
    shingle. Null doc_ids come last in the order, so a class_id is null only where all its ids are. Repeated rows (equal
    doc_id and text) are copies, all marked keeper if the first is among them. An empty table gives no rows. Further
    columns are ignored.
    """
    bands, rows = choose_bands(threshold, recall)
    body = F.coalesce(F.col(text), F.lit(""))
    whole = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.xxhash64(body).alias("text_hash"), body.alias("text"))

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = list(shingle_sets(batch.column(2), n))
            names = [fingerprint(s) for s in sets]
            few = [i for i, s in enumerate(sets) if 0 < len(s) <= FEW]
            for i, s in zip(few, shingle_sets(batch.column(2).take(pa.array(few, pa.int64())), n, 1), strict=True):
                names[i] = fingerprint(sets[i], s)
            marks: list[list[int]] = [[]] * len(sets)
            full = [i for i, s in enumerate(sets) if len(s)]
            size = np.cumsum([len(sets[i]) for i in full])
            a = 0
            while a < len(full):
                b = max(a + 1, int(np.searchsorted(size, (size[a - 1] if a else 0) + 200_000, side="right")))
                got = band_hashes([sets[i] for i in full[a:b]], bands, rows, seed).view(np.int64)
                for i, row in zip(full[a:b], got.tolist(), strict=True):
                    marks[i] = row
                a = b
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(names, pa.binary()), pa.array([len(s) for s in sets], pa.int64()), pa.array(marks, pa.list_(pa.int64()))],
                names=["doc_id", "text_hash", "member", "n_shingles", "bands"],
            )

    signed = common.cut(common.arrow_map(whole, sign, "doc_id long, text_hash long, member binary, n_shingles long, bands array<long>"), "signed")
    order = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_hash")
    members = signed.groupBy("member").agg(F.min(order).alias("first"), F.count(F.lit(1)).alias("copies"), F.first("bands").alias("bands"), F.first("n_shingles").alias("n_shingles"))
    members = common.cut(members, "members")

    entries = members.select("member", "n_shingles", F.posexplode("bands").alias("band", "hash"))
    stats = entries.groupBy("band", "hash").agg(
        F.count(F.lit(1)).alias("n"),
        F.sum("n_shingles").alias("grams"),
        F.bit_xor(F.xxhash64("member")).alias("x"),
        F.bit_xor(F.xxhash64(F.lit(1), "member")).alias("y"),
    )
    stats = stats.where("n > 1").groupBy("n", "grams", "x", "y").agg(F.min(F.struct("band", "hash")).alias("at"))
    blocks = F.greatest(F.ceil(F.col("n") / BLOCK_MEMBERS), F.ceil(F.col("grams") / BLOCK_GRAMS)).cast("int")
    kept = stats.select("at.band", "at.hash", blocks.alias("blocks"))
    inside = entries.select("member", "band", "hash").join(kept, ["band", "hash"])
    inside = common.cut(inside.withColumn("own", F.pmod(F.xxhash64(F.lit(2), "member"), F.col("blocks")).cast("int")), "candidates")

    wanted = members.join(inside.select("member").distinct(), "member", "left_semi")
    wanted = wanted.select("member", "bands", "copies", F.col("first.doc_id").alias("doc_id"), F.col("first.text_hash").alias("text_hash"))
    texts = wanted.join(whole, wanted["doc_id"].eqNullSafe(whole["doc_id"]) & (wanted["text_hash"] == whole["text_hash"]))

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = [s.tobytes() for s in shingle_sets(batch.column(3), n, 1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(2), pa.array(column, pa.binary())], names=["member", "bands", "copies", "grams"])

    sets = common.arrow_map(texts.select("member", "bands", "copies", "text"), gather, "member binary, bands array<long>, copies long, grams binary")
    first = "u binary, v binary, links long"
    dealt = inside.select("band", "hash", F.col("own").alias("i"), "blocks", "member").join(sets, "member")
    # what blocks found within themselves, and those that have others to meet, packed
    met = common.cut(common.by_group(dealt, ["band", "hash", "i"], lambda g: within(g, threshold), f"{first}, band int, hash long, i int, blocks int, packed binary"), "blocks")
    found = met.where("u is not null").select("u", "v", "links")
    other = F.explode(F.filter(F.sequence(F.lit(0), F.col("blocks") - 1), lambda j: j != F.col("i"))).alias("other")
    pairs = met.where("packed is not null").select("band", "hash", "i", other, "packed")
    pairs = pairs.select("band", "hash", F.least("i", "other").alias("i"), F.greatest("i", "other").alias("j"), F.col("i").alias("own"), "packed")
    across = common.by_group(pairs, ["band", "hash", "i", "j"], lambda g: between(g, threshold), first)
    found = common.cut(found.unionByName(across), "links")
    label = components(found.select("u", "v"))
    links = found.groupBy(F.col("u").alias("member")).agg(F.sum("links").alias("links"))
    members = members.select("member", "first", "copies").join(links, "member", "left").join(label.withColumnRenamed("u", "member"), "member", "left")
    members = members.withColumn("root", F.coalesce("v", "member"))
    first = members.groupBy("root").agg(F.min("first").alias("keeper"))
    members = members.join(first, "root").select("member", "keeper", (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"))
    same = F.col("doc_id").eqNullSafe(F.col("keeper.doc_id")) & (F.col("text_hash") == F.col("keeper.text_hash"))
    return signed.select("doc_id", "text_hash", "member", "n_shingles").join(members, "member").select(
        "doc_id", "text_hash", F.col("keeper.doc_id").alias("class_id"), "n_links", "n_shingles", same.alias("keeper")
    )


def keep_one(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """The documents of which each class of similar ones has kept one, the first by doc_id, with all their columns.

    Of repeated rows of a keeper one stays. Columns of any name are left as they are.
    """
    marks = similar(docs, doc_id=doc_id, text=text, **options).where("keeper").select(F.col("doc_id").alias("__id"), F.col("text_hash").alias("__hash"))
    marks = marks.distinct()
    names = docs.columns
    rows = docs.toDF(*(f"c{i}" for i in range(len(names))))
    key, body = F.col(f"c{names.index(doc_id)}").cast("long"), F.coalesce(F.col(f"c{names.index(text)}"), F.lit(""))
    rows = rows.withColumn("__k", F.coalesce(key, F.lit(-1))).withColumn("__n", key.isNull()).withColumn("__h", F.xxhash64(body))
    marks = marks.select(F.coalesce("__id", F.lit(-1)).alias("__k"), F.col("__id").isNull().alias("__n"), F.col("__hash").alias("__h"))
    kept = rows.join(marks, ["__k", "__n", "__h"], "left_semi")
    kept = kept.withColumn("__r", F.row_number().over(W.partitionBy("__k", "__n", "__h").orderBy(F.lit(1)))).where("__r = 1")
    return kept.select(*(F.col(f"c{i}").alias(c) for i, c in enumerate(names)))
