"""Conversation prefix trie: nodes in preorder as intervals, subtree sums as differences of running sums.

Conversations are sorted as sequences of turns. The members of a node are then neighbours, so a node is an interval of
ranks; nodes sorted by first rank and depth are in preorder, and the subtree of a node is an interval of positions.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from specloom.llm import common
from specloom.llm.spread import running, spread_join

#: Conversations that share a head are those of one run of so many ids; a head has fewer turns than HEADS.
RUN, HEADS = 5, 9
#: Turns (or names of blocks) that one row holds at most.
BLOCK = 256
#: Rows that Python holds as objects at once.
SLICE = 256
ROOT = b""


def _digest(data: bytes) -> bytes:
    return hashlib.sha256(data).digest()[:16]


def turns(rows: DataFrame, *, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """Turns with their place in the conversation (from 1): conv, place, symbol (128 bits of SHA-256 over role and text), bytes.

    Null turns come first; equal turns are in the order of role and symbol. A null role or text is empty; rows without a
    conv_id are no conversation's.
    """
    a, b = F.coalesce(F.col(role).cast("string"), F.lit("")), F.coalesce(F.col(text).cast("string"), F.lit(""))
    symbol = F.substring(F.unhex(F.sha2(F.concat_ws("", F.octet_length(a).cast("string"), F.lit(":"), a, b), 256)), 1, 16)
    found = rows.select(F.col(conv_id).cast("long").alias("conv"), F.col(turn).alias("turn"), a.alias("role"), symbol.alias("symbol"), F.octet_length(b).cast("long").alias("bytes"), F.lit(1).alias("one"))
    order = [F.col("conv"), F.col("turn").asc_nulls_first(), F.col("role"), F.col("symbol")]
    placed = running(found.where("conv is not null"), order, ["one"], "turns", group="conv")
    return placed.select("conv", F.col("sum_one").alias("place"), "symbol", "bytes")


def rebuilt(placed: DataFrame, total: int) -> tuple[DataFrame, DataFrame]:
    """The rebuilt conversations: their turns (conv, depth, symbol, bytes) and their lengths (conv, length).

    A conversation is the first h turns of the first of its run (all if there are fewer), and its own turns after its first
    h, where h is the CRC-32 of its id in decimal digits modulo HEADS.
    """
    head = F.col("conv") - F.col("conv") % RUN
    h = F.crc32(F.col("conv").cast("string").cast("binary")) % HEADS
    convs = placed.groupBy("conv").agg(F.max("place").alias("own")).select("conv", "own", head.alias("head"), h.alias("h"))
    convs = common.cut(convs, "conversations")
    heads = convs.select(F.col("conv").alias("head"), F.col("own").alias("there"))
    convs = convs.join(heads, "head", "left").withColumn("taken", F.least("h", F.coalesce("there", F.lit(0))))
    after = F.greatest(F.col("own") - F.col("h"), F.lit(0))
    convs = common.cut(convs.select("conv", "head", "h", "own", "taken", (F.col("taken") + after).alias("length")), "conversations")
    first = placed.where(F.col("place") < HEADS).withColumnRenamed("conv", "head")
    first = convs.select("conv", "head", "taken").join(first, "head").where("place <= taken").select("conv", F.col("place").alias("depth"), "symbol", "bytes")
    own = spread_join(placed, convs.select("conv", "h", "own", "taken"), ["conv"], n="own", total=total)
    own = own.where("place > h").select("conv", (F.col("place") - F.col("h") + F.col("taken")).alias("depth"), "symbol", "bytes")
    return first.unionByName(own), convs.select("conv", "length")


def _blocks(rows: DataFrame, of: list[str]) -> DataFrame:
    """Rows (conv, place from 0) in blocks of BLOCK: conv, block, and an array of structs for the columns, in order."""
    held = F.array_sort(F.collect_list(F.struct("place", *of)))
    return rows.groupBy("conv", F.floor(F.col("place") / BLOCK).alias("block")).agg(held.alias("held"))


def _ranked(blocks: DataFrame, symbol: str, total: int) -> DataFrame:
    """conv, block and the rank (from 1) of the block among all different ones, in the order of their symbols."""
    blocks = blocks.select("conv", "block", F.col(f"held.{symbol}").alias("word"))
    named = blocks.withColumn("name", F.sha2(F.array_join(F.transform("word", lambda x: F.hex(x)), ","), 256))
    words = named.groupBy("name").agg(F.first("word").alias("word"), F.count(F.lit(1)).alias("n"), F.lit(1).alias("one"))
    words = running(words, ["word"], ["one"], "words").select("name", "n", F.col("sum_one").alias("rank"))
    return spread_join(named.select("conv", "block", "name"), words, ["name"], n="n", total=total).select("conv", "block", "rank")


def ranks(blocks: DataFrame, total: int) -> DataFrame:
    """conv and the rank of its whole sequence among all different ones, in lexicographic order.

    Equal blocks have equal ranks, and ranks of blocks are in the order of their contents; so a conversation is a sequence of
    ranks, shorter by BLOCK. That is repeated until each is one block: the logarithm of the longest to the base BLOCK.
    """
    found = common.cut(_ranked(blocks, "symbol", total), "ranks")
    while found.where("block > 0").limit(1).count():
        again = _blocks(found.select("conv", F.col("block").alias("place"), "rank"), ["rank"])
        found = common.cut(_ranked(again, "rank", total), "ranks")
    return found.select("conv", "rank")


def _starts(blocks: DataFrame) -> DataFrame:
    """conv, block (from 1) and the node where the block starts; a row a block passes as a stream, never the turns."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        conv, start = None, ROOT
        for batch in batches:
            out = []
            for c, local in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), strict=True):
                if c != conv:
                    conv, start = c, ROOT
                out.append(start)
                start = _digest(start + b"/" + local)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out, pa.binary())], names=["conv", "block", "start"])

    local = F.aggregate("held.symbol", F.lit(b""), lambda before, x: F.substring(F.unhex(F.sha2(F.concat(before, x), 256)), 1, 16))
    long = blocks.where("block > 0").select("conv").distinct()
    rows = blocks.join(long, "conv", "left_semi").select("conv", "block", local.alias("local")).repartition("conv").sortWithinPartitions("conv", "block")
    return common.arrow_map(rows, run, "conv long, block long, start binary").where("block > 0")


def _memberships(blocks: DataFrame) -> DataFrame:
    """A row for each node that each conversation passes, but for the root: node, parent, depth, conv, rank, bytes, ends.

    A node is named by the node where its block starts and a chain of digests over the block's turns so far.
    """
    schema = pa.schema([("node", pa.binary()), ("parent", pa.binary()), ("depth", pa.int64()), ("conv", pa.int64()), ("rank", pa.int64()), ("bytes", pa.int64()), ("ends", pa.bool_())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, batch.num_rows, SLICE):
                out = []
                for conv, rank, length, start, held in zip(*(c.to_pylist() for c in batch.slice(k, SLICE).columns), strict=True):
                    start = parent = start or ROOT
                    local = b""
                    for turn in held:
                        local = _digest(local + turn["symbol"])
                        node, depth = _digest(start + b"/" + local), turn["place"] + 1
                        out.append((node, parent, depth, conv, rank, turn["bytes"], depth == length))
                        parent = node
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), schema.types, strict=True)], schema=schema)

    rows = blocks.select("conv", "rank", "length", "start", "held")
    return common.arrow_map(rows, run, "node binary, parent binary, depth long, conv long, rank long, bytes long, ends boolean")


def _digests_of_ends(ends: DataFrame) -> DataFrame:
    """For each node where conversations end, the SHA-256 of their ids, ascending and joined by commas: a sorted stream of
    ids, none of which is held; that digest can't be made in parts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, state = None, None
        for batch in batches:
            nodes, found = [], []
            for node, conv in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if node != last:
                    if state is not None:
                        nodes.append(last)
                        found.append(state.hexdigest())
                    last, state = node, hashlib.sha256(str(conv).encode())
                else:
                    state.update(f",{conv}".encode())
            yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.binary()), pa.array(found, pa.string())], names=["node", "ends_sha256"])
        if state is not None:
            yield pa.RecordBatch.from_arrays([pa.array([last], pa.binary()), pa.array([state.hexdigest()])], names=["node", "ends_sha256"])

    rows = ends.select("node", "conv").repartition("node").sortWithinPartitions("node", "conv")
    return common.arrow_map(rows, run, "node binary, ends_sha256 string")


def nodes(rows: DataFrame, **names: str) -> DataFrame:
    """The trie of the rebuilt conversations (rebuilt()), one row for each different sequence of first turns.

    conv_id is the smallest member, depth the number of turns, parent_conv_id the parent's conv_id (null for the root);
    n_convs counts members, n_children children, n_leaves childless nodes in the subtree; saved_tokens sums (members - 1)
    times the UTF-8 bytes of the last text over the subtree; ends_sha256 is the SHA-256 of the ids of the conversations that
    end here, ascending, in decimal digits joined by commas. position (from 1) is the place in preorder, and subtree_end the last
    position of the subtree.

    Turns are compared by 128 bits of SHA-256. No task holds a conversation, a node's members or its children: long
    conversations go in blocks, and rows of hot keys are dealt to parts. Turns: see turns(). Repeated rows are turns like
    others. A table without a conv_id gives no rows; further columns are ignored.
    """
    placed = turns(rows, **names)
    total = placed.count()
    body, lengths = rebuilt(placed, total)
    blocks = common.cut(_blocks(body.withColumn("place", F.col("depth") - 1), ["symbol", "bytes"]), "blocks")
    rank = ranks(blocks, total)
    starts = _starts(blocks)
    whole = spread_join(blocks, lengths.join(rank, "conv").withColumn("n", F.ceil(F.col("length") / BLOCK)), ["conv"], n="n", total=total).join(starts, ["conv", "block"], "left")
    passed = common.cut(_memberships(whole), "members")
    root = lengths.join(rank, "conv", "left").select(F.lit(ROOT).alias("node"), F.lit(None).cast("binary").alias("parent"), F.lit(0).cast("long").alias("depth"), "conv", F.coalesce("rank", F.lit(0)).alias("rank"), F.lit(0).cast("long").alias("bytes"), (F.col("length") == 0).alias("ends"))
    passed = passed.unionByName(root)

    found = passed.groupBy("node").agg(
        F.first("parent").alias("parent"), F.first("depth").alias("depth"), F.first("bytes").alias("bytes"), F.min("conv").alias("conv_id"), F.count(F.lit(1)).alias("n_convs"), F.min("rank").alias("lo"), F.max("rank").alias("hi")
    )
    found = common.cut(found, "nodes")
    total = found.count()
    children = found.groupBy(F.col("parent").alias("node")).agg(F.count(F.lit(1)).alias("n_children"))
    found = found.join(children, "node", "left").withColumn("n_children", F.coalesce("n_children", F.lit(0)))
    saved = ((F.col("n_convs") - 1) * F.col("bytes")).alias("saved")
    found = found.select("node", "parent", "depth", "conv_id", "n_convs", "n_children", "lo", "hi", F.lit(1).alias("one"), (F.col("n_children") == 0).cast("int").alias("leaf"), saved)
    found = running(found, ["lo", "depth"], ["one", "leaf", "saved"], "preorder")

    # the running sums at the last node that begins by a rank: there every subtree whose members end with that rank ends
    uses = found.groupBy(F.col("hi").alias("lo")).agg(F.count(F.lit(1)).alias("uses"))
    sums = found.groupBy("lo").agg(F.max("sum_one").alias("end"), F.max("sum_leaf").alias("leaves"), F.max("sum_saved").alias("through"))
    sums = common.cut(sums.join(uses, "lo").withColumnRenamed("lo", "hi"), "sums")
    out = spread_join(found, sums, ["hi"], n="uses", total=total)
    parents = found.where("n_children > 0").select(F.col("node").alias("parent"), F.col("conv_id").alias("parent_conv_id"), F.col("n_children").alias("siblings"))
    out = spread_join(out, parents, ["parent"], n="siblings", total=total, how="left")
    out = out.join(_digests_of_ends(passed.where("ends")), "node", "left")
    return out.select(
        "conv_id",
        "depth",
        "parent_conv_id",
        "n_convs",
        F.col("n_children").cast("long").alias("n_children"),
        (F.col("leaves") - F.col("sum_leaf") + F.col("leaf")).alias("n_leaves"),
        (F.col("through") - F.col("sum_saved") + F.col("saved")).alias("saved_tokens"),
        F.coalesce("ends_sha256", F.lit(hashlib.sha256(b"").hexdigest())).alias("ends_sha256"),
        F.col("sum_one").alias("position"),
        F.col("end").alias("subtree_end"),
    )
