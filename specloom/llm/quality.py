"""Quality by importance resampling: documents whose n-grams a model of good text explains better than a model of all text."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from specloom.llm import common, textkit

#: Buckets of hashed n-grams (a power of two), what each bucket is given beforehand, and labelled rows used at most (about).
BUCKETS, PRIOR, LABELS = 1 << 16, 1.0, 20_000
#: Share of held-out good documents whose weight must reach the cut that sets k.
KEEP = 0.995
_REPEAT = np.uint64(0xA5A5A5A55A5A5A5A)


def features(texts: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Buckets of the n-grams of texts and the row of each, in slices: words, marks, and pairs of them.

    All pairs of a word with itself are one n-gram, so that stuttering text looks alike whatever it repeats.
    """
    shift = np.uint64(64 - (BUCKETS.bit_length() - 1))
    for a, b in textkit.slices(texts):
        words, at = textkit.word_hashes(texts.slice(a, b - a), punctuation=True)
        pairs, off = textkit.ngram_hashes(words, at, 2)
        first = np.repeat(at[:-1] - off[:-1], np.diff(off)) + np.arange(len(pairs))
        pairs[words[first] == words[first + 1]] = _REPEAT
        row = np.concatenate([np.repeat(np.arange(a, b), np.diff(at)), np.repeat(np.arange(a, b), np.diff(off))])
        yield (np.concatenate([words, pairs]) >> shift).astype(np.int64), row


def labelled_sample(labels: DataFrame, *, most: int = LABELS, doc_id: str = "doc_id", quality: str = "quality") -> DataFrame:
    """About so many labelled ids at most, chosen by a hash: doc_id, good, and fold 0 (fits the model) or 1 (sets the cut).

    Rows without id or label take no part; an id with different labels isn't good.
    """
    rows = labels.where(F.col(doc_id).isNotNull() & F.col(quality).isin(0, 1)).select(F.col(doc_id).cast("long").alias("doc_id"), F.col(quality).cast("int").alias("good"))
    total = rows.count()
    share = min(1.0, most / max(total, 1))
    rows = rows.where(F.pmod(F.xxhash64(F.lit(3), "doc_id"), F.lit(1_000_000)) < int(share * 1_000_000) + 1)
    return rows.groupBy("doc_id").agg(F.min("good").alias("good")).withColumn("fold", F.pmod(F.xxhash64(F.lit(4), "doc_id"), F.lit(2)).cast("int"))


def fit(docs: DataFrame, sample: DataFrame) -> np.ndarray:
    """Logarithm of the ratio of the two models for each bucket: good documents of fold 0 against all documents.

    docs: doc_id, text. One pass without a shuffle of texts; a task sends at most BUCKETS counts.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        raw, target = np.zeros(BUCKETS, np.int64), np.zeros(BUCKETS, np.int64)
        for batch in batches:
            good = np.asarray(batch.column(1).to_numpy(zero_copy_only=False), bool)
            for bucket, row in features(batch.column(0)):
                raw += np.bincount(bucket, minlength=BUCKETS)
                target += np.bincount(bucket[good[row]], minlength=BUCKETS)
        seen = np.flatnonzero(raw)
        yield pa.RecordBatch.from_arrays([pa.array(seen), pa.array(raw[seen]), pa.array(target[seen])], names=["bucket", "raw", "target"])

    good = F.broadcast(sample.where("good = 1 and fold = 0").select("doc_id", F.lit(True).alias("good")))  # LABELS rows at most
    rows = docs.join(good, "doc_id", "left").select("text", F.coalesce("good", F.lit(False)).alias("good"))
    got = common.arrow_map(rows, count, "bucket long, raw long, target long").groupBy("bucket").agg(F.sum("raw").alias("raw"), F.sum("target").alias("target")).toArrow()  # BUCKETS rows
    raw, target = np.zeros(BUCKETS), np.zeros(BUCKETS)
    at = got.column("bucket").to_numpy()
    raw[at], target[at] = got.column("raw").to_numpy(), got.column("target").to_numpy()
    if not target.sum():
        return np.zeros(BUCKETS)
    return np.log((target + PRIOR) / (target.sum() + PRIOR * BUCKETS)) - np.log((raw + PRIOR) / (raw.sum() + PRIOR * BUCKETS))


def weigh(rows: DataFrame, model: np.ndarray, text: str) -> DataFrame:
    """rows with log_weight: the sum of the model's ratios over all n-grams of the whole text."""
    ratio = rows.sparkSession.sparkContext.broadcast(model)
    at, names = rows.columns.index(text), [*rows.columns, "log_weight"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            weight = np.zeros(batch.num_rows)
            for bucket, row in features(batch.column(at)):
                weight += np.bincount(row, weights=ratio.value[bucket], minlength=batch.num_rows)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(weight)], names=names)

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields)
    return common.arrow_map(rows, run, f"{schema}, log_weight double")


def gumbel(seed: int, *columns: Column) -> Column:
    """Standard Gumbel noise that depends on seed and columns alone."""
    unit = (F.shiftrightunsigned(F.xxhash64(F.lit(seed), *columns), 11).cast("double") + 0.5) / float(1 << 53)
    return -F.log(-F.log(unit))


def kth_largest(values: DataFrame, k: int) -> float:
    """The k-th largest of the doubles in column key, by counting in ever narrower ranges; nothing is sorted or collected."""
    low, high = values.agg(F.min("key"), F.max("key")).first()
    above, steps = 0, 4096
    while low < high:
        width = (high - low) / steps
        if not width or low + width == low:
            break
        place = F.least(F.floor((F.col("key") - low) / width), F.lit(steps - 1)).cast("int").alias("place")
        found = values.where((F.col("key") >= low) & (F.col("key") <= high)).groupBy(place).agg(F.count(F.lit(1)).alias("n"), F.min("key").alias("low"), F.max("key").alias("high"))
        for _, n, a, b in sorted(found.collect(), reverse=True):  # steps rows at most
            if above + n >= k:
                low, high = a, b
                break
            above += n
    return low


class Selection:
    """What select() found: the model, the least key kept, and the scored rows without texts."""

    def __init__(self, model: np.ndarray, least: float, cut: float, k: int, scored: DataFrame):
        self.model, self.least, self.cut, self.k, self.scored = model, least, cut, k, scored


def select(docs: DataFrame, labels: DataFrame, *, keep: float = KEEP, most: int = LABELS, seed: int = 23, doc_id: str = "doc_id", text: str = "text", quality: str = "quality") -> Selection:
    """Chooses k documents without replacement, with chances that follow their importance weights (Gumbel top-k).

    The weight of a document is the ratio of two models of hashed n-grams, of good labelled text and of all text. Counts of
    all text cover every document; labelled rows are a sample of about `most`. k is the number of documents whose weight
    reaches the cut that `keep` of the held-out good documents reach. Keys are log weight plus Gumbel noise; documents
    whose keys are among the k largest stay, together with any that tie with the k-th.

    A null or empty text has the log weight 0; null ids are never labelled; repeated rows have equal keys and share their
    fate; without good labels all documents stay; an empty table gives an empty selection. Other columns are ignored.
    """
    body = F.coalesce(F.col(text), F.lit("")).alias("text")
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), body)
    sample = common.cut(labelled_sample(labels, most=most, quality=quality), "labels")
    model = fit(rows, sample)
    scored = weigh(rows.select("doc_id", F.xxhash64("text").alias("text_hash"), "text"), model, "text").drop("text")
    scored = common.cut(scored.withColumn("key", F.col("log_weight") + gumbel(seed, F.col("doc_id"), F.col("text_hash"))), "scored")
    held = sample.where("fold = 1 and good = 1")
    cut = scored.join(F.broadcast(held), "doc_id").agg(F.percentile("log_weight", F.lit(1 - keep))).first()[0]  # LABELS rows at most
    total, k = scored.agg(F.count(F.lit(1)), F.count_if(F.col("log_weight") >= F.lit(cut))).first() if cut is not None and model.any() else (scored.count(), None)
    k = total if k is None else k
    least = kth_largest(scored, k) if 0 < k < total else (float("inf") if total and not k else float("-inf"))
    return Selection(model, least, cut if cut is not None else float("-inf"), k, scored)


def decisions(docs: DataFrame, labels: DataFrame, **options) -> DataFrame:
    """Every document with doc_id, log_weight, key and keep."""
    got = select(docs, labels, **options)
    return got.scored.select("doc_id", "log_weight", "key", (F.col("key") >= F.lit(got.least)).alias("keep"))


def resample(docs: DataFrame, labels: DataFrame, *, seed: int = 23, doc_id: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """The documents chosen by select(), with all their columns. They are weighed again, which is cheaper than to move texts."""
    got = select(docs, labels, seed=seed, doc_id=doc_id, text=text, **options)
    names = docs.columns
    rows = docs.toDF(*(f"c{i}" for i in range(len(names))))
    key, body = F.col(f"c{names.index(doc_id)}").cast("long"), F.coalesce(F.col(f"c{names.index(text)}"), F.lit(""))
    rows = weigh(rows.withColumn("__text", body), got.model, "__text")
    rows = rows.where(F.col("log_weight") + gumbel(seed, key, F.xxhash64("__text")) >= F.lit(got.least))
    return rows.select(*(F.col(f"c{i}").alias(c) for i, c in enumerate(names)))
