"""Row numbers per key without sorting a key in one task.

Rows are range-partitioned by key and order, so a key with many rows spreads over several partitions.
Each partition numbers its own rows as it streams over them; a key that goes over a border gets the
counts of its earlier partitions added. Keys on borders are few (at most one per border), so that
table is small whatever the data.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cadence.session import materialise


def changes(column: pa.Array) -> np.ndarray:
    """True where a value differs from the one before (the first value counts as different)."""
    if len(column) < 2:
        return np.ones(len(column), bool)
    a, b = column.slice(1), column.slice(0, len(column) - 1)
    same = pc.or_(pc.fill_null(pc.equal(a, b), False), pc.and_(pc.is_null(a), pc.is_null(b)))
    return np.concatenate([[True], ~same.to_numpy(zero_copy_only=False).astype(bool)])


def _number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Add a running number per value of the first column; a value goes on over batches."""
    last, done = None, 0
    for batch in batches:
        if not batch.num_rows:
            continue
        key = batch.column(0)
        change = changes(key)
        if last is not None:
            first = key[0]
            change[0] = not (first.equals(last) or (not first.is_valid and not last.is_valid))
        at = np.arange(len(change))
        start = np.maximum.accumulate(np.where(change, at, -1))
        number = np.where(start >= 0, at - start + 1, at + 1 + done)
        last, done = key[len(key) - 1], int(number[-1])
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(number.astype(np.int64))], [*batch.schema.names, "_local"])


def numbered(df: DataFrame, key: str, order: list[str], name: str = "play_order") -> DataFrame:
    """``df`` with the row's number (from 1) among the rows of its key, in the given order. Rows that are
    equal in key and order are numbered in any order. The frame is written once (the partitions must
    not be drawn twice)."""
    cols = [key, *[c for c in df.columns if c != key]]
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = df.select(*cols).repartitionByRange(n, key, *order).sortWithinPartitions(key, *order)
    schema = ", ".join(f"`{c}` {t}" for c, t in ranged.dtypes) + ", _local long"
    local = materialise(ranged.mapInArrow(_number, schema).withColumn("_part", F.spark_partition_id()), "numbered")
    counts = local.groupBy(key, "_part").agg(F.max("_local").alias("_n"))
    split = counts.groupBy(key).agg(F.count(F.lit(1)).alias("_k")).where("_k > 1").select(F.col(key).alias("_key"))
    counts = counts.join(split, F.col(key).eqNullSafe(F.col("_key")), "left_semi")
    before = F.sum("_n").over(Window.partitionBy(key).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1))
    offsets = materialise(counts.select(F.col(key).alias("_key"), F.col("_part").alias("_p"), before.alias("_before")).where("_before > 0"), "number-offsets")
    out = local.join(offsets, F.col(key).eqNullSafe(F.col("_key")) & (F.col("_part") == F.col("_p")), "left")
    return out.withColumn(name, F.col("_local") + F.coalesce("_before", F.lit(0))).select(*df.columns, name)
