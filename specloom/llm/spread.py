"""Joins and running sums that no hot key and no long order brings into one task."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from specloom.llm import common

#: A key is hot if it has more than one in so many rows (there can't be more hot keys than that), and more than so many.
HOT, LEAST = 1000, 20_000


def spread_join(rows: DataFrame, right: DataFrame, keys: list[str], *, n: str, total: int, how: str = "inner", least: int | None = None) -> DataFrame:
    """rows joined with right, which has each key once and says in column n how many rows of the left have it.

    The rows of a hot key are dealt to parts, and right repeats the key for each part. At most HOT keys are hot, since the
    counts add up to total at most; so the list of them is small enough to broadcast. right is read twice: give a written
    table. With how="left", rows without a match stay; column n and right's others are added otherwise.
    """
    most = max(LEAST if least is None else least, total // HOT)
    parts = F.when(F.col(n) > most, F.ceil(F.col(n) / most)).otherwise(1).cast("int")
    hot = right.where(F.col(n) > most).select(*(F.col(k).alias(f"__{k}") for k in keys), parts.alias("__parts"))
    same = [F.col(k) == F.col(f"__{k}") for k in keys]
    rows = rows.join(F.broadcast(hot), same, "left").drop(*(f"__{k}" for k in keys))
    part = F.when(F.col("__parts").isNull(), 0).otherwise(F.pmod(F.monotonically_increasing_id(), F.col("__parts")))
    rows = rows.withColumn("__part", part.cast("int")).drop("__parts")
    right = right.withColumn("__part", F.explode(F.sequence(F.lit(0), parts - 1)))
    return rows.join(right, [*keys, "__part"], how).drop("__part")


def running(df: DataFrame, order: list, totals: list[str], label: str, *, group: str | None = None) -> DataFrame:
    """df with a column sum_<name> for each of totals (longs): the sum from the first row of the order through this one.

    Rows are range-partitioned and sorted by order; each task sums up its own range as a stream, and the sums of the ranges
    before it are added, one row a range. With group (a column that comes first in the order), sums start anew with each
    of its values, and a value with most of the rows still lies in as many ranges as it needs. The result is a written table.
    """
    names = df.columns
    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields]
    at, by = [names.index(t) for t in totals], names.index(group) if group else None

    def stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        sums, last = [0] * len(at), None
        for batch in batches:
            if not batch.num_rows:
                continue
            first = np.zeros(batch.num_rows, bool)
            if by is not None:
                values = batch.column(by).to_numpy(zero_copy_only=False)
                first[1:] = values[1:] != values[:-1]
                first[0] = last is None or values[0] != last
                last = values[-1]
            run = np.maximum.accumulate(np.where(first, np.arange(batch.num_rows), -1))
            out = []
            for k, i in enumerate(at):
                own = batch.column(i).to_numpy(zero_copy_only=False).astype(np.int64)
                total = np.cumsum(own)
                total = np.where(run < 0, total + sums[k], total - (total - own)[np.maximum(run, 0)])
                sums[k] = int(total[-1])
                out.append(pa.array(total, pa.int64()))
            yield pa.RecordBatch.from_arrays([*batch.columns, *out, pa.array(np.full(batch.num_rows, part), pa.int32())], names=[*names, *(f"sum_{t}" for t in totals), "__range"])

    schema = ", ".join([*fields, *(f"sum_{t} long" for t in totals), "__range int"])
    own = common.cut(common.arrow_map(df.repartitionByRange(*order).sortWithinPartitions(*order), stream, schema), label)
    keys = ["__range"] if group is None else ["__range", group]
    ranges = own.groupBy(*keys).agg(*(F.max(f"sum_{t}").alias(f"__{t}") for t in totals))
    before = (W.orderBy("__range") if group is None else W.partitionBy(group).orderBy("__range")).rowsBetween(W.unboundedPreceding, -1)
    ranges = ranges.select(*keys, *(F.sum(f"__{t}").over(before).alias(f"__{t}") for t in totals)).where(F.col(f"__{totals[0]}").isNotNull())
    # each range adds to its first value alone: a row a range at most, whatever the number of values
    out = own.join(F.broadcast(ranges), keys, "left")
    added = [(F.col(f"sum_{t}") + F.coalesce(F.col(f"__{t}"), F.lit(0))).alias(f"sum_{t}") for t in totals]
    return common.cut(out.select(*names, *added), label)
