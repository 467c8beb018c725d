"""Shards by jump consistent hashing.

`assign` gives each row a shard from its key and the number of shards alone, with no table of a
ring; adding a shard moves rows only into it. `number` gives each row its place in its shard, gapless
from 0 in the order of key and other columns, without bringing a shard into one task: rows are
range-partitioned by shard, key, other columns and a number of their own, and each stretch of a shard
starts at the sum of the counts of those before it.

Scale: `assign` is a narrow map. `number` shuffles the columns it is given once (keep them few) and joins
them to one row per stretch. Rows of one key, or of none, are split like any others.

Cases: a null key counts as one value of its own; rows with equal keys share a shard and get
slots of their own; rows equal in all columns get neighbouring slots; an empty table gives no rows; other
columns stay, whatever their names, but one named like an output.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ringspan.llm._shared import cut, fresh, ship

# The multiplier of jump consistent hashing and those of the splitmix64 finaliser.
_JUMP = np.uint64(2862933555777941757)
_MIX_A, _MIX_B = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def mix64(x: np.ndarray) -> np.ndarray:
    """Spread keys that are close together over 64 bits."""
    x = x.astype(np.uint64)
    x = (x ^ (x >> np.uint64(30))) * _MIX_A
    x = (x ^ (x >> np.uint64(27))) * _MIX_B
    return x ^ (x >> np.uint64(31))


def jump(keys: np.ndarray, n: int) -> np.ndarray:
    """The shard of each unsigned 64-bit key among n, by jump consistent hashing."""
    key = keys.astype(np.uint64).copy()
    at = np.zeros(len(key), dtype=np.int64)
    to = np.zeros(len(key), dtype=np.int64)
    live = np.arange(len(key))
    while len(live):
        at[live] = to[live]
        k = key[live] * _JUMP + np.uint64(1)
        key[live] = k
        to[live] = ((at[live] + 1) * (float(1 << 31) / ((k >> np.uint64(33)).astype(np.float64) + 1.0))).astype(np.int64)
        live = live[to[live] < n]
    return at


def shard_of(key: Column, n: int) -> Column:
    """The shard of an integer key among n shards."""

    @F.pandas_udf("int")
    def f(k: pd.Series) -> pd.Series:
        return pd.Series(jump(mix64(k.to_numpy(dtype=np.int64).view(np.uint64)), n).astype(np.int32))

    return f(key)


def assign(df: DataFrame, key: str, n: int, out: str = "shard") -> DataFrame:
    """df with the shard of each row; integer keys are used as they are, others by their hash."""
    ship(df.sparkSession)
    kind = dict(df.dtypes)[key]
    k = F.col(key).cast("long") if kind in ("tinyint", "smallint", "int", "bigint") else F.xxhash64(F.col(key))
    return df.withColumn(out, shard_of(F.coalesce(k, F.lit(-1)), n))


def number(df: DataFrame, shard: str, key: str, rows_per_cell: int = 50_000, out: str = "slot") -> DataFrame:
    """df with the place of each row in its shard: gapless from 0, in the order of key and other columns."""
    df = df.drop(out)
    seat, at, part, first, start = fresh(df.drop(out), "seat", "at", "part", "first", "start")
    rest = [f"`{f.name}`" for f in df.schema.fields if f.name not in (shard, key) and f.dataType.typeName() not in ("map", "variant")]
    held = cut(df.withColumn(seat, F.monotonically_increasing_id()), "shards")
    order = [f"`{shard}`", f"`{key}`", *rest, seat]
    ranged = held.repartitionByRange(max(1, -(-held.count() // rows_per_cell)), *order).sortWithinPartitions(*order)
    # the number of a row: that of its task, and in the low 33 bits its place there
    placed = cut(ranged.drop(seat).withColumn(at, F.monotonically_increasing_id()), "placed").withColumn(part, F.shiftright(at, 33))
    counts = placed.groupBy(shard, part).agg(F.min(at).alias(first), F.count(F.lit(1)).alias(start))
    before = Window.partitionBy(shard).orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    starts = cut(counts.select(shard, part, first, F.coalesce(F.sum(start).over(before), F.lit(0)).alias(start)), "starts")
    return placed.join(starts, [shard, part]).withColumn(out, F.col(start) + F.col(at) - F.col(first)).select(*[f"`{c}`" for c in df.columns], out)
