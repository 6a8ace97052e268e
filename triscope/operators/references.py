"""References to records that do not exist: orphans by binary search over range-partitioned keys.

Parents are reduced to one row per key, range-partitioned by key and packed into blocks of sorted arrays; the lowest key of
each block (one string per ``BLOCK_KEYS`` keys) is all the driver sees. References find their block by binary search over
those bounds, meet it in a co-group, and are probed as arrays by binary search. A block that many references point to (one
key may hold a third of them) is copied to as many salted groups as its references need, so that no group holds more than
about ``GROUP_REFS`` references; every reference is probed once.

A reference is ``missing`` if its key is in no parent row, ``later`` if the parent came after the reference's time, ``deleted``
if the parent was gone by then; the first that holds, in this order.

Cases: null keys and keys of white space are no references. Parents repeated under one key count as one that exists from
their earliest creation and is deleted only if every row is, at the latest deletion. A null time of the reference can only
give ``missing``, with a null period; a null creation time is never later. No parents at all: everything is missing. No
references: an empty result. Repeated references give repeated rows unless ``distinct`` is applied.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from triscope.functions.keys import clean_key
from triscope.sources.scratch import written

BLOCK_KEYS = 50_000
GROUP_REFS = 200_000
MISSES = "ref_table string, ref_key string, missing_key string, reason string, t bigint"


def parents(df: DataFrame, key: Column, created: Column, deleted: Column) -> DataFrame:
    """One row per key: key, created, deleted (microseconds)."""
    micros = lambda c: F.unix_micros(c.cast("timestamp"))
    gone = F.when(F.count(F.when(deleted.isNull(), 1)) == 0, F.max(micros(deleted)))
    return df.groupBy(clean_key(key).alias("key")).agg(F.min(micros(created)).alias("created"), gone.alias("deleted")).where("key is not null")


def references(df: DataFrame, table: str, ref_key: Column, key: Column, at: Column) -> DataFrame:
    """ref_table, ref_key, key, t of the non-null references of a table."""
    return df.select(F.lit(table).alias("ref_table"), clean_key(ref_key).alias("ref_key"), clean_key(key).alias("key"), F.unix_micros(at.cast("timestamp")).alias("t")).where("key is not null")


def key_blocks(keys: DataFrame, block_keys: int = BLOCK_KEYS) -> DataFrame:
    """lo and the sorted arrays of each block; written, so that the ranges stay what they are."""
    kind = "lo string, keys array<string>, created array<bigint>, deleted array<bigint>"
    types = [pa.string(), pa.list_(pa.string()), pa.list_(pa.int64()), pa.list_(pa.int64())]

    def pack(batches):
        held: list[pa.RecordBatch] = []

        def block() -> pa.RecordBatch:
            t = pa.Table.from_batches(held)
            columns = [t[n].to_pylist() for n in ("key", "created", "deleted")]
            return pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip([columns[0][0], *columns], types)], ["lo", "keys", "created", "deleted"])

        for b in batches:
            while b.num_rows:
                room = block_keys - sum(x.num_rows for x in held)
                held.append(b.slice(0, room))
                b = b.slice(room)
                if sum(x.num_rows for x in held) >= block_keys:
                    yield block()
                    held.clear()
        if held:
            yield block()

    return written(keys.repartitionByRange("key").sortWithinPartitions("key").mapInArrow(pack, kind), "blocks")


def orphans(refs: DataFrame, keys: DataFrame, block_keys: int = BLOCK_KEYS, group_refs: int = GROUP_REFS) -> DataFrame:
    """``MISSES``: the references of ``refs`` whose parent in ``keys`` is missing, later or deleted."""
    blocks = key_blocks(keys, block_keys)
    bounds = sorted(r[0] for r in blocks.select("lo").collect())  # one bound per block_keys keys
    lows = np.array(bounds, object)

    def route(batches):
        for b in batches:
            keys = np.array(b.column(2).to_pylist(), object)
            at = np.maximum(np.searchsorted(lows, keys, side="right") - 1, 0) if len(lows) else np.zeros(len(keys))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(at.astype(np.int32))], [*b.schema.names, "block"])

    routed = written(refs.mapInArrow(route, "ref_table string, ref_key string, key string, t bigint, block int"), "refs")
    groups = F.greatest(F.lit(1), F.ceil(F.count("*") / group_refs)).cast("int")
    load = F.broadcast(routed.groupBy("block").agg(groups.alias("groups")))  # as many rows as blocks: a hot block is split where its references are
    number = F.array_position(F.array(*map(F.lit, bounds)), F.col("lo")).cast("int") - 1 if len(bounds) <= 1000 else _numbered(bounds)(F.col("lo"))
    copies = (blocks.withColumn("block", number) if bounds else blocks.withColumn("block", F.lit(0))).join(load, "block").withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("groups") - 1))).drop("groups", "lo")
    salted = routed.join(load, "block").withColumn("salt", F.pmod(F.xxhash64("ref_table", "ref_key", "t"), F.col("groups").cast("bigint")).cast("int")).drop("groups")

    def probe(left: pa.Table, right: pa.Table) -> pa.Table:
        names = ("ref_table", "ref_key", "missing_key", "reason", "t")
        wanted = np.array(left["key"].to_pylist(), object)
        at = left["t"].combine_chunks()
        if right.num_rows:
            have = np.array(right["keys"][0].as_py(), object)
            place = np.minimum(np.searchsorted(have, wanted), len(have) - 1)
            there, place = have[place] == wanted, pa.array(place)
            created, deleted = (right[c][0].values.take(place) for c in ("created", "deleted"))
            later, gone = (pc.fill_null(c, False).to_numpy(zero_copy_only=False) for c in (pc.greater(created, at), pc.less_equal(deleted, at)))
        else:
            there = later = gone = np.zeros(len(wanted), bool)
        reason = np.select([~there.astype(bool), later, gone], ["missing", "later", "deleted"], "")
        out = pa.table([left["ref_table"], left["ref_key"], left["key"], pa.array(reason, pa.string()), left["t"]], names=names)
        return out.filter(pa.array(reason != ""))

    return salted.groupBy("block", "salt").cogroup(copies.groupBy("block", "salt")).applyInArrow(probe, MISSES)


def _numbered(bounds: list[str]):
    @F.pandas_udf("int")
    def number(lo: pd.Series) -> pd.Series:
        return pd.Series(np.searchsorted(np.array(bounds, object), lo.to_numpy(object)), dtype="int32")

    return number


def with_period(misses: DataFrame) -> DataFrame:
    """The distinct misses with the month of the reference's time."""
    return misses.select("ref_table", "ref_key", "missing_key", "reason", F.date_format(F.timestamp_micros("t"), "yyyy-MM").alias("period")).distinct()
