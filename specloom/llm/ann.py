"""Nearest neighbours: lists around centroids, and an adaptive scan over blocks of rotated dimensions within them.

Two hypothesis tests keep the work small. Both ask whether something nearer than the query's k-th nearest so far is still
likely, and both get their first bound from a search of the few nearest lists. One decides from a centroid's distance and a
list's radii whether the list is probed at all; the other, from the distance over the dimensions read, whether a vector is
read on. Structured vectors leave few lists; where all are about as far from each other, most lists must be probed.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from specloom.llm import common

#: The index is fitted on so many sampled vectors a list, so many components in all, and has so many lists at most.
SAMPLE_PER_LIST, SAMPLE_COMPONENTS, MOST_LISTS = 32, 32_000_000, 4096
#: Vectors of a unit, and queries, that one call compares; components bound them for long vectors.
BLOCK_VECTORS, BLOCK_QUERIES, BLOCK_COMPONENTS = 16_384, 16_384, 4_000_000
#: Distances held at once, and the share of them below which single pairs are read on, not whole blocks.
DISTANCES, FEW = 2_000_000, 1 / 8
#: Dimensions read between two tests, and the chance that a test abandons a vector at just the bound.
COLUMN_BLOCK, ALPHA = 16, 0.001
#: The nearest lists that hold so many vectors give a query its first bound.
PILOT = 256
#: Standard deviations of a random direction that the test of a list allows its members to lie towards the query.
REACH = 2.5


def usable(vector: str) -> Column:
    """The vector has only finite components, and one that isn't zero."""
    c = F.col(vector)
    finite = F.forall(c, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(finite & F.exists(c, lambda x: x != 0), F.lit(False))


def rotation(dim: int, seed: int) -> np.ndarray:
    """A random orthogonal matrix: after it, any few dimensions are a fair sample of a distance."""
    q, r = np.linalg.qr(np.random.default_rng(seed).standard_normal((dim, dim)))
    return q * np.sign(np.diag(r))


def squared(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Squared distances of the rows of x to those of y, up to rounding."""
    return np.maximum((x**2).sum(1)[:, None] + (y**2).sum(1) - 2 * (x @ y.T), 0)


def nearest_list(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """The nearest centre of each row."""
    out = np.empty(len(x), np.int64)
    own = (centres**2).sum(1)
    for k in range(0, len(x), 2048):
        out[k : k + 2048] = (own - 2 * (x[k : k + 2048] @ centres.T)).argmin(1)
    return out


def kmeans(x: np.ndarray, k: int, seed: int, rounds: int = 12) -> np.ndarray:
    rng = np.random.default_rng(seed)
    x = np.unique(x, axis=0)
    centres = x[rng.choice(len(x), min(k, len(x)), replace=False)].copy()
    for _ in range(rounds):
        near = nearest_list(x, centres)
        count = np.bincount(near, minlength=len(centres))
        total = np.zeros_like(centres)
        np.add.at(total, near, x)
        centres = np.where(count[:, None] > 0, total / np.maximum(count, 1)[:, None], x[rng.choice(len(x), len(centres))])
    return centres


def test_shares(dim: int, alpha: float = ALPHA, block: int = COLUMN_BLOCK) -> list[tuple[int, int, float]]:
    """Blocks of dimensions [a, b), and the share of a squared distance that the first b exceed with the chance alpha.

    Under a random rotation that share has a beta distribution of b / 2 and (dim - b) / 2, whose quantile is summed up here.
    """
    out = []
    x = (np.arange(100_000) + 0.5) / 100_000
    for a in range(0, dim, block):
        b = min(a + block, dim)
        share = 1.0
        if b < dim:
            density = (b / 2 - 1) * np.log(x) + ((dim - b) / 2 - 1) * np.log1p(-x)
            total = np.cumsum(np.exp(density - density.max()))
            share = float(x[np.searchsorted(total, (1 - alpha) * total[-1])])
        out.append((a, b, share))
    return out


def adaptive_scan(asked: np.ndarray, limits: np.ndarray, columns: list[np.ndarray], shares: list[tuple[int, int, float]]) -> tuple[np.ndarray, np.ndarray, int]:
    """Pairs of queries and vectors that may be within the queries' squared limits, and the components read for them.

    asked are rotated queries, columns the vectors' blocks of rotated dimensions, a vector in each column. A vector is
    abandoned as soon as the hypothesis is rejected that it is within the limit. Blocks are read for all pairs while most
    are alive, and pair by pair then.
    """
    q, m = len(asked), columns[0].shape[1]
    slack = 1e-12 * ((asked**2).sum(1) + sum(((c**2).sum(0) for c in columns), np.zeros(m)).max(initial=0))
    limits = limits * (1 + 1e-9) + slack
    if not np.isfinite(slack).all():  # squares beyond doubles: nothing can be told
        return np.repeat(np.arange(q), m), np.tile(np.arange(m), q), q * m * asked.shape[1]
    alive, total, read = np.ones((q, m), bool), np.zeros((q, m)), 0
    rows = None
    for (a, b, share), block in zip(shares, columns, strict=True):
        mine = asked[:, a:b]
        if rows is None:
            read += np.count_nonzero(alive) * (b - a)
            total += (mine**2).sum(1)[:, None] + (block**2).sum(0) - 2 * (mine @ block)
            alive &= total <= (limits * share + slack)[:, None]
            if b == asked.shape[1] or np.count_nonzero(alive) < FEW * alive.size:
                rows, at = np.nonzero(alive)
                total = total[rows, at]
        else:
            read += len(rows) * (b - a)
            total = total + ((block[:, at] - mine[rows].T) ** 2).sum(0)
            near = total <= limits[rows] * share + slack[rows]
            rows, at, total = rows[near], at[near], total[near]
    return rows, at, read


def best(query: np.ndarray, vec_id: np.ndarray, score: np.ndarray, k: int) -> np.ndarray:
    """Places of each query's k best, by score and then by id."""
    order = np.lexsort((vec_id, score, query))
    first = np.searchsorted(query[order], query[order])
    return order[np.arange(len(order)) - first < k]


def distinct(ids: np.ndarray, x: np.ndarray, k: int) -> tuple[np.ndarray, list[np.ndarray]]:
    """One row of x for each distinct vector, and those of its ids that can be among anyone's k nearest.

    Of copies the smallest ids count: k at most of an id, and so many in all that k remain without any one of them.
    """
    order = np.lexsort((ids, *x.T[::-1]))
    ids, x = ids[order], x[order]
    new = np.append(True, (x[1:] != x[:-1]).any(1)) if len(x) else np.zeros(0, bool)
    kept = []
    for own in np.split(ids, np.flatnonzero(new)[1:]):
        if len(own) > 2 * k:
            own = own[np.arange(len(own)) - np.searchsorted(own, own) < k][: 2 * k]
        kept.append(own)
    return x[new], kept if len(x) else []


class Index:
    """Centroids, a rotation and the tests' shares, fitted on a bounded sample; lists hold every usable vector."""

    def __init__(self, centres: np.ndarray, seed: int):
        self.centres, self.dim = centres, centres.shape[1]
        self.turn, self.shares = rotation(self.dim, seed), test_shares(self.dim)

    def pilots(self, x: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Squared distances to the centroids, and for each row the nearest lists that hold PILOT vectors together."""
        apart = squared(x, self.centres)
        order = np.argsort(apart, axis=1, kind="stable")
        before = np.cumsum(sizes[order], axis=1) - sizes[order]
        mine = np.zeros(apart.shape, bool)
        np.put_along_axis(mine, order, before < PILOT, axis=1)
        return apart, mine & (sizes > 0)

    def rest(self, x: np.ndarray, limits: np.ndarray, sizes: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """The further lists to probe. low and high are the least and the largest distance of a list's members to its centroid.

        A member at distance r from a centroid at distance c is at a squared distance of c^2 + r^2 - 2 c r t from the query,
        where t is near 0 unless it lies towards the query; of t, REACH standard deviations of a random direction are allowed.
        """
        apart, mine = self.pilots(x, sizes)
        reach = min(1.0, REACH / math.sqrt(self.dim))
        r = np.clip(np.sqrt(apart) * reach, low, high)
        least = apart + r**2 - 2 * reach * np.sqrt(apart) * r
        return ~mine & (sizes > 0) & ~(least > (limits * (1 + 1e-9))[:, None] + 1e-9 * apart)


def fit(rows: DataFrame, dim: int, total: int, *, seed: int = 11) -> Index:
    """rows: vec_id, vector, all of length dim. The sample is drawn by a hash of the id; SAMPLE_COMPONENTS bounds it."""
    lists = max(1, min(MOST_LISTS, math.ceil(math.sqrt(total))))
    most = max(lists, min(SAMPLE_PER_LIST * lists, SAMPLE_COMPONENTS // dim))
    share = min(1.0, most / total)
    sample = rows.where(F.pmod(F.xxhash64(F.lit(seed), "vec_id"), F.lit(1_000_000)) < int(share * 1_000_000) + 1)
    got = sample.select("vector").limit(2 * most).toArrow().column("vector").combine_chunks()
    if not len(got):  # all rows share a few ids, and the hash took none
        got = rows.select("vector").limit(most).toArrow().column("vector").combine_chunks()
    return Index(kmeans(matrix(got), lists, seed), seed)


def matrix(vectors: pa.Array) -> np.ndarray:
    """Vectors of one length as doubles."""
    return vectors.flatten().to_numpy(zero_copy_only=False).reshape(len(vectors), -1).astype(np.float64)


def units(sizes: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """The unit of each list, and how many blocks each unit is dealt to: small lists share a unit, a large one fills several."""
    unit, blocks, held = np.zeros(len(sizes), np.int64), [], most
    for i, n in enumerate(sizes.tolist()):
        if held + n > most:
            blocks.append(max(1, math.ceil(n / most)))
            held = 0
        unit[i], held = len(blocks) - 1, held + n
    return unit, np.asarray(blocks, np.int64)


def search(vectors: DataFrame, is_query, *, k: int = 10, vec_id: str = "vec_id", vector: str = "embedding", seed: int = 11) -> DataFrame:
    """The k nearest rows found for each row that is_query selects, by Euclidean distance over the original vectors.

    Every usable vector is assigned to the list of its nearest centroid, once, in the shared folder. Each query first
    searches the nearest lists that hold PILOT vectors; its k-th distance there is the bound that it takes to the further
    lists, of which a test of centroid and radii skips those that hardly hold anything nearer. Within a list the adaptive
    scan abandons vectors early. Scores are computed from the original vectors.

    Small lists are searched together and large ones in blocks of BLOCK_VECTORS, so no task takes a whole hot list; copies of
    one vector are compared once. Broadcast are the rotation and MOST_LISTS centroids at most.

    Takes no part: a vector that is null, zero, or holds null or non-finite components, or whose id is null. Vectors of
    different lengths have no distance; each length is searched on its own, with an index of its own. Repeated rows are
    candidates each; of queries with one id and length the smallest vector counts. A query never finds rows with its own id,
    and finds all candidates if there are no more than k. Ties go to the smaller id. An empty table gives no rows.
    Returns query_id, rank, vec_id, score.
    """
    spark = vectors.sparkSession
    flag = F.coalesce(is_query, F.lit(False)).alias("asks")
    kind = vectors.schema[vector].dataType.simpleString()
    rows = vectors.where(usable(vector) & F.col(vec_id).isNotNull())
    rows = rows.select(F.col(vec_id).cast("long").alias("vec_id"), F.col(vector).cast(kind if kind in ("array<float>", "array<double>") else "array<double>").alias("vector"), flag)
    found = None
    for length, total in sorted(rows.groupBy(F.size("vector").alias("n")).count().collect()):  # a row for each length of vectors
        part = _search(rows.where(F.size("vector") == length), length, total, k, seed)
        found = part if found is None else found.unionByName(part)
    if found is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    rank = F.row_number().over(W.partitionBy("query_id").orderBy("score", "vec_id")).cast("int")
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _search(rows: DataFrame, dim: int, total: int, k: int, seed: int) -> DataFrame:
    """Candidates of the queries among rows of one length: query_id, vec_id, score; k a query and block at most."""
    spark = rows.sparkSession
    index = fit(rows, dim, total, seed=seed)
    shared = spark.sparkContext.broadcast(index)
    kind = rows.schema["vector"].dataType.simpleString()
    most = max(1, min(BLOCK_VECTORS, BLOCK_COMPONENTS // dim))
    asks = max(1, min(BLOCK_QUERIES, BLOCK_COMPONENTS // dim))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, seen = shared.value, 0
        for batch in batches:
            x = matrix(batch.column(1))
            lists = nearest_list(x, own.centres)
            away = np.sqrt(((x - own.centres[lists]) ** 2).sum(1))
            salt = np.arange(seen, seen + len(x))
            seen += len(x)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(lists.astype(np.int32)), pa.array(away), pa.array(salt)], names=["vec_id", "vector", "list", "away", "salt"])

    data = common.cut(common.arrow_map(rows.select("vec_id", "vector"), place, f"vec_id long, vector {kind}, list int, away double, salt long"), "placed")
    sizes, low, high = (np.zeros(len(index.centres)) for _ in range(3))
    for r in data.groupBy("list").agg(F.count(F.lit(1)), F.min("away"), F.max("away")).collect():  # MOST_LISTS rows at most
        sizes[r[0]], low[r[0]], high[r[0]] = r[1:]
    unit, blocks = units(sizes, most)
    queries = common.cut(rows.where("asks").groupBy("vec_id").agg(F.min("vector").alias("vector")), "queries")

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A row for each query and unit with lists to probe; limit is null in the pilot search."""
        own = shared.value
        for batch in batches:
            for a in range(0, batch.num_rows, 256):
                part = batch.slice(a, 256)
                x, limits = matrix(part.column(1)), part.column(2).to_numpy(zero_copy_only=False)
                probe = own.pilots(x, sizes)[1] if part.column(2).null_count else own.rest(x, limits**2, sizes, low, high)
                row, at = np.nonzero(probe)
                first = np.flatnonzero(np.append(True, (row[1:] != row[:-1]) | (unit[at[1:]] != unit[at[:-1]]))) if len(row) else np.zeros(0, np.int64)
                lists = pa.ListArray.from_arrays(pa.array(np.append(first, len(row)).astype(np.int32)), pa.array(at.astype(np.int32)))
                take = pa.array(row[first])
                yield pa.RecordBatch.from_arrays(
                    [part.column(0).take(take), part.column(1).take(take), part.column(2).take(take), pa.array(unit[at[first]].astype(np.int32)), lists], names=["vec_id", "vector", "bound", "unit", "lists"]
                )

    def scan(group: pa.Table) -> Iterator[pa.RecordBatch]:
        own = shared.value
        is_query = group.column("lists").is_valid().to_numpy()
        ids, x = group.column("vec_id").to_numpy(), matrix(group.column("vector").combine_chunks())
        asked, wanted = np.flatnonzero(is_query), group.column("lists").filter(pa.array(is_query)).combine_chunks()
        held = np.flatnonzero(~is_query)
        if not len(asked) or not len(held):
            return
        at = np.repeat(np.arange(len(asked)), np.diff(wanted.offsets.to_numpy()))
        which = wanted.flatten().to_numpy()
        in_list = group.column("list").filter(pa.array(~is_query)).to_numpy()
        bound = np.nan_to_num(group.column("bound").filter(pa.array(is_query)).to_numpy().astype(np.float64), nan=np.inf, posinf=np.inf)
        turned = x[asked] @ own.turn
        empty = np.zeros(0, np.int64)
        query, near, score = empty, empty, np.zeros(0)
        for number in np.unique(which):
            members = held[in_list == number]
            if not len(members):
                continue
            vectors, copies = distinct(ids[members], x[members], k)
            spun = own.turn.T @ vectors.T  # dimensions in rows, so that a block of them lies together
            columns = [spun[a:b] for a, b, _ in own.shares]
            count = np.asarray([len(c) for c in copies])
            start, every = np.cumsum(count) - count, np.concatenate(copies)
            mine = at[which == number]
            step = max(1, DISTANCES // len(vectors))
            for a in range(0, len(mine), step):
                some = mine[a : a + step]
                rows_, hits, _ = adaptive_scan(turned[some], bound[some] ** 2, columns, own.shares)
                q = some[rows_]
                exact = np.concatenate([np.sqrt(((vectors[hits[i : i + 65536]] - x[asked[q[i : i + 65536]]]) ** 2).sum(1)) for i in range(0, len(q), 65536)] or [np.zeros(0)])
                spread = np.repeat(np.arange(len(q)), count[hits])
                copy = np.arange(len(spread)) - np.repeat(np.cumsum(count[hits]) - count[hits], count[hits])
                q, exact, other = q[spread], exact[spread], every[start[hits][spread] + copy]
                other_than = other != ids[asked[q]]
                query, near, score = np.append(query, q[other_than]), np.append(near, other[other_than]), np.append(score, exact[other_than])
            top = best(query, near, score, k)
            query, near, score = query[top], near[top], score[top]
            full = np.flatnonzero(np.bincount(query, minlength=len(asked)) == k)
            last = np.searchsorted(query, full, side="right") - 1
            bound[full] = np.minimum(bound[full], score[last])
        yield pa.RecordBatch.from_arrays([pa.array(ids[asked[query]]), pa.array(near), pa.array(score)], names=["query_id", "vec_id", "score"])

    def compare(asking: DataFrame) -> DataFrame:
        probes = common.arrow_map(asking, ask, f"vec_id long, vector {kind}, bound double, unit int, lists array<int>")
        probes = common.cut(probes, "probes")
        rounds = np.zeros(len(blocks), np.int64)
        for u, n in probes.groupBy("unit").count().collect():  # MOST_LISTS rows at most
            rounds[u] = math.ceil(n / asks)
        deal = [(i, int(unit[i]), int(blocks[unit[i]]), int(rounds[unit[i]])) for i in np.flatnonzero(rounds[unit] * (sizes > 0)).tolist()]
        deal = F.broadcast(spark.createDataFrame(deal, "list int, unit int, blocks int, rounds int"))  # MOST_LISTS rows at most
        every = lambda of: F.explode(F.sequence(F.lit(0), F.col(of) - 1))
        spread = lambda of, *by: F.pmod(F.xxhash64(*by), F.col(of)).cast("int")
        have = data.join(deal, "list").select("unit", spread("blocks", "vec_id", "salt").alias("block"), every("rounds").alias("round"), "vec_id", "vector", F.lit(None).cast("double").alias("bound"), "list", F.lit(None).cast("array<int>").alias("lists"))
        want = probes.join(F.broadcast(deal.select("unit", "blocks", "rounds").distinct()), "unit")
        want = want.select("unit", every("blocks").alias("block"), spread("rounds", "vec_id").alias("round"), "vec_id", "vector", "bound", F.lit(None).cast("int").alias("list"), "lists")
        found = common.by_group(have.unionByName(want), ["unit", "block", "round"], scan, "query_id long, vec_id long, score double")
        return common.cut(found, "neighbours")

    pilot = compare(queries.select("vec_id", "vector", F.lit(None).cast("double").alias("bound")))
    rank = F.row_number().over(W.partitionBy("query_id").orderBy("score"))
    bounds = pilot.withColumn("rank", rank).where(F.col("rank") == k).select(F.col("query_id").alias("vec_id"), F.col("score").alias("bound"))
    rest = queries.join(bounds, "vec_id", "left").select("vec_id", "vector", F.coalesce("bound", F.lit(float("inf"))).alias("bound"))
    return pilot.unionByName(compare(rest))
