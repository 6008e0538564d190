"""Exact dedup: counting quotient filters find the fingerprints that repeat, and the bytes of their texts decide."""

from __future__ import annotations

import math
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from specloom.llm import common
from specloom.llm.spread import spread_join

#: Fingerprints that a filter holds when it is written, and that a range of all filters holds on average.
FLUSH, RANGE = 2_000_000, 2_000_000
#: Leading bits of a fingerprint that make its range: at least and at most.
BITS = 4, 20
#: Share of a filter's home slots that are filled.
LOAD = 0.75
_HEAD = struct.Struct("<BBQQ")


def encode(fingerprints: np.ndarray, counts: np.ndarray, bits: int) -> bytes:
    """A counting quotient filter of ascending distinct 64-bit fingerprints that share their first bits.

    The bits after those are quotient and remainder; nothing is cut off, so the filter is lossless. A quotient's remainders
    form a run in ascending order, at its home slot or as soon after it as there is room. The slots after a remainder that
    are marked as counters hold its count less one, in digits of a remainder's size. Three bit maps say which quotients have
    a run, where runs end, and which slots are counters.
    """
    n = len(fingerprints)
    quotient_bits = max(1, math.ceil(math.log2(max(n, 1) / LOAD)))
    rest = 64 - bits - quotient_bits
    home = ((fingerprints << np.uint64(bits) >> np.uint64(bits)) >> np.uint64(rest)).astype(np.int64)
    more = (counts - 1).astype(np.uint64)
    digits = np.zeros(n, np.int64)
    left = more.copy()
    while left.any():
        digits += left > 0
        left >>= np.uint64(rest)
    begin = np.cumsum(1 + digits) - (1 + digits)
    slot = begin + np.maximum.accumulate(home - begin) if n else begin
    slots = max(1 << quotient_bits, int(slot[-1] + 1 + digits[-1]) if n else 0)
    values, counter, ends, occupied = np.zeros(slots, np.uint64), np.zeros(slots, bool), np.zeros(slots, bool), np.zeros(1 << quotient_bits, bool)
    mask = np.uint64((1 << rest) - 1)
    values[slot] = fingerprints & mask
    for k in range(int(digits.max()) if n else 0):
        has = digits > k
        values[slot[has] + 1 + k] = more[has] >> np.uint64(k * rest) & mask
        counter[slot[has] + 1 + k] = True
    occupied[home] = True
    if n:
        last = np.append(home[1:] != home[:-1], True)
        ends[(slot + digits)[last]] = True
    size = -(-rest // 8)
    body = values.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :size]
    return _HEAD.pack(bits, quotient_bits, n, slots) + b"".join(np.packbits(x).tobytes() for x in (occupied, ends, counter)) + body.tobytes()


def decode(data: bytes, first: int) -> tuple[np.ndarray, np.ndarray]:
    """The fingerprints of a filter, ascending, and their counts; first is the value of the leading bits."""
    bits, quotient_bits, n, slots = _HEAD.unpack_from(data)
    rest, size = 64 - bits - quotient_bits, -(-(64 - bits - quotient_bits) // 8)
    at = _HEAD.size
    maps = []
    for length in (1 << quotient_bits, slots, slots):
        maps.append(np.unpackbits(np.frombuffer(data, np.uint8, -(-length // 8), at), count=length).astype(bool))
        at += -(-length // 8)
    occupied, ends, counter = maps
    values = np.zeros((slots, 8), np.uint8)
    values[:, :size] = np.frombuffer(data, np.uint8, slots * size, at).reshape(slots, size)
    values = values.reshape(-1).view("<u8")
    home, end = np.flatnonzero(occupied), np.flatnonzero(ends)
    begin = np.maximum(home, np.append(-1, end[:-1]) + 1) if len(home) else home
    length = end - begin + 1
    used = np.repeat(begin - (np.cumsum(length) - length), length) + np.arange(length.sum())
    quotient = np.repeat(home, length)
    digit = counter[used]
    of = np.cumsum(~digit) - 1
    here = np.flatnonzero(~digit)
    found = (np.uint64(first) << np.uint64(64 - bits) if bits else np.uint64(0)) | quotient[here].astype(np.uint64) << np.uint64(rest) | values[used[here]]
    counts = np.ones(n, np.int64)
    place = np.flatnonzero(digit)
    which = place - here[of[place]] - 1
    np.add.at(counts, of[place], (values[used[place]] << (which * rest).astype(np.uint64)).astype(np.int64))
    return found, counts


def filters(fingerprints: DataFrame, bits: int) -> DataFrame:
    """Filters of the fingerprints (one long column) of each partition, one for each range that it has; nulls count not."""

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []

        def flush() -> pa.RecordBatch:
            found, counts = np.unique(np.concatenate(held), return_counts=True)
            top = (found >> np.uint64(64 - bits)).astype(np.int64)
            cuts = np.append(np.flatnonzero(np.append(True, top[1:] != top[:-1])), len(top))
            blobs = [encode(found[a:b], counts[a:b], bits) for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
            return pa.RecordBatch.from_arrays([pa.array(top[cuts[:-1]], pa.int32()), pa.array(blobs, pa.binary())], names=["range", "filter"])

        for batch in batches:
            held.append(batch.column(0).drop_null().to_numpy(zero_copy_only=False).view(np.uint64))
            if sum(map(len, held)) >= FLUSH:
                yield flush()
                held.clear()
        if sum(map(len, held)):
            yield flush()

    return common.arrow_map(fingerprints, build, "range int, filter binary")


def merged(found: DataFrame) -> DataFrame:
    """One filter for each range: what many filters of the same number of bits hold, with counts added up."""

    def run(group: pa.Table) -> Iterator[pa.RecordBatch]:
        first = group.column("range")[0].as_py()
        blobs = group.column("filter").to_pylist()
        every = [decode(b, first) for b in blobs]
        values, counts = (np.concatenate(x) for x in zip(*every, strict=True))
        order = np.argsort(values, kind="stable")  # sorted runs, which a stable sort merges
        values, counts = values[order], counts[order]
        begin = np.flatnonzero(np.append(True, values[1:] != values[:-1]))
        blob = encode(values[begin], np.add.reduceat(counts, begin), blobs[0][0])
        yield pa.RecordBatch.from_arrays([pa.array([first], pa.int32()), pa.array([blob], pa.binary())], names=["range", "filter"])

    return common.by_group(found, ["range"], run, "range int, filter binary")


def repeated(found: DataFrame) -> DataFrame:
    """Fingerprints that merged filters count more than once: fp, n."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, blob in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                values, counts = decode(blob, first)
                often = counts > 1
                yield pa.RecordBatch.from_arrays([pa.array(values[often].view(np.int64)), pa.array(counts[often])], names=["fp", "n"])

    return common.arrow_map(found.select("range", "filter"), run, "fp long, n long")


def normalised(text: Column) -> Column:
    """The text with each run of blanks (space, \\t, \\n, \\v, \\f, \\r) as one space; a null text is empty."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), r"[ \x09-\x0D]+", " ")


def range_bits(total: int) -> int:
    """Leading bits that make ranges of about RANGE fingerprints."""
    return min(max(math.ceil(math.log2(max(total, 1) / RANGE)), BITS[0]), BITS[1])


def _first(rows: DataFrame, keys: list[str]) -> DataFrame:
    """The row of each class that stays: the smallest doc_id, null last, then the first of repeated rows."""
    order = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "rid")
    found = rows.groupBy(*keys).agg(F.min(order).alias("first"), F.count(F.lit(1)).alias("n"))
    return found.select(*keys, "n", F.col("first.doc_id").alias("keep_id"), F.col("first.rid").alias("keep_rid"))


def _classes(rows: DataFrame, keys: list[str], total: int) -> DataFrame:
    """rows (doc_id, rid, sha and keys) with keep_id, group_size and kept."""
    first = common.cut(_first(rows, keys), "first")
    out = spread_join(rows, first, keys, n="n", total=total)
    return out.select("doc_id", "keep_id", F.col("n").alias("group_size"), (F.col("rid") == F.col("keep_rid")).alias("kept"), "sha")


def decisions(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", fingerprint=F.xxhash64) -> DataFrame:
    """One row for each document row: doc_id, keep_id, group_size, kept, text_sha256. Texts are equal if their normalised
    forms are.

    Each partition's 64-bit fingerprints go into counting quotient filters, one for each range of fingerprints; the filters
    of a range merge without loss. Rows whose fingerprint counts once are done. The texts of the others are compared by
    their bytes: a fingerprint of several texts is split by text. Texts of single documents never move, and copies are
    summed up before each shuffle; the rows of a fingerprint with many rows are dealt to parts.

    Of equal texts the row with the smallest doc_id stays, null doc_ids come last, and of rows with equal doc_id and text
    exactly one is kept. A null text is empty. keep_id is null only where all ids of the class are. An empty table gives no
    rows; further columns are ignored. fingerprint makes a long of a column; any function gives the same result.
    """
    body = normalised(F.col(text))
    whole = docs.select(F.col(doc_id).cast("long").alias("doc_id"), body.alias("text")).withColumn("fp", fingerprint(F.col("text")).cast("long"))
    digest = F.unhex(F.sha2("text", 256)).alias("sha")
    rows = common.cut(whole.select(F.monotonically_increasing_id().alias("rid"), "doc_id", "fp", digest), "rows")
    total = rows.count()
    counted = common.cut(merged(filters(rows.select("fp"), range_bits(total))), "filter")
    often = common.cut(repeated(counted), "repeated")
    routed = common.cut(spread_join(rows, often, ["fp"], n="n", total=total, how="left"), "routed")
    single = routed.where("n is null").select("doc_id", F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept"), "sha")

    # byte verification: the different texts of each repeated fingerprint
    suspects = spread_join(whole.select("fp", "text"), often, ["fp"], n="n", total=total).select("fp", "text").distinct()
    twins = common.cut(suspects.groupBy("fp").agg(F.count(F.lit(1)).alias("texts")).where("texts > 1"), "twins")
    copies = routed.where("n is not null").drop("n")
    if twins.isEmpty():
        found = _classes(copies, ["fp"], total)
    else:
        found = _classes(copies.join(twins, "fp", "left_anti"), ["fp"], total)
        split = spread_join(whole, often.join(twins, "fp"), ["fp"], n="n", total=total)
        split = common.cut(split.select(F.monotonically_increasing_id().alias("rid"), "doc_id", "fp", "text", digest), "split")
        found = found.unionByName(_classes(split, ["fp", "text"], total))
    return single.unionByName(found).select("doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("sha")).alias("text_sha256"))


def keep_first(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """The documents that decisions() keeps, with all their columns; of repeated rows one stays."""
    marks = decisions(docs, doc_id=doc_id, text=text, **options).where("kept")
    marks = marks.select(F.coalesce("doc_id", F.lit(-1)).alias("__k"), F.col("doc_id").isNull().alias("__n"), F.col("text_sha256").alias("__h"))
    names = docs.columns
    rows = docs.toDF(*(f"c{i}" for i in range(len(names))))
    key, body = F.col(f"c{names.index(doc_id)}").cast("long"), F.col(f"c{names.index(text)}")
    rows = rows.withColumns({"__k": F.coalesce(key, F.lit(-1)), "__n": key.isNull(), "__h": F.sha2(normalised(body), 256)})
    rows = rows.join(marks, ["__k", "__n", "__h"], "left_semi").dropDuplicates(["__k", "__n", "__h"])
    return rows.select(*(F.col(f"c{i}").alias(c) for i, c in enumerate(names)))
