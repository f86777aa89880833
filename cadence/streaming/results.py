"""Results that a stream writes batch by batch, with compaction.

Every micro-batch is one version: ``path/batch_id=N``, overwritten if the batch is replayed, so
at-least-once delivery gives each version once. The current state folds the versions of a key into
one row. ``compact`` writes the fold of all versions up to one as a base, ``path/_base/upto=N``, with
a plain Spark write; readers then take the newest committed base and the later versions only.

* A crash while a base is written leaves a folder without Spark's commit marker: it is ignored, and
  written again by the next compaction.
* A batch that is replayed after it was folded rewrites a version that nobody reads any more.
* What a base replaces is removed one compaction later, so that readers that have planned with the
  base before can finish. ``read_current`` and a streaming query may run meanwhile.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cadence.sources import folders

BATCH, BASE, UPTO = "batch_id=", "_base", "upto="

Fold = Callable[[DataFrame], DataFrame]


def newest(keys: list[str]) -> Fold:
    """The row of the newest batch of each key: for results that carry running totals."""

    def fold(v: DataFrame) -> DataFrame:
        cols = [c for c in v.columns if c not in keys and c != "batch_id"]
        latest = v.groupBy(*keys).agg(F.max_by(F.struct(*cols), "batch_id").alias("_r"), F.max("batch_id").alias("batch_id"))
        return latest.select(*keys, "_r.*", "batch_id")

    return fold


def added(keys: list[str], sums: list[str], first: dict[str, str] | None = None, last: dict[str, str] | None = None) -> Fold:
    """Sums of the batches' parts. ``first`` / ``last`` name columns that are taken from the part with
    the smallest / largest value of another column; a null there counts as no value."""
    first, last = first or {}, last or {}

    def fold(v: DataFrame) -> DataFrame:
        by = {**first, **last}
        aggs = [F.sum(c).alias(c) for c in sums]
        aggs += [F.min_by(c, o).alias(c) for c, o in first.items()] + [F.max_by(c, o).alias(c) for c, o in last.items()]
        aggs += [(F.min(o) if o in first.values() else F.max(o)).alias(o) for o in dict.fromkeys(by.values())]
        return v.groupBy(*keys).agg(*aggs, F.max("batch_id").alias("batch_id")).select(*v.columns)

    return fold


@dataclass(frozen=True)
class Results:
    """One versioned result: where it is, and how the versions of a key become one row."""

    path: str
    fold: Fold

    def version(self, batch_id: int) -> str:
        return f"{self.path.rstrip('/')}/{BATCH}{batch_id}"

    def written(self, spark: SparkSession, batch_id: int) -> bool:
        """The batch's version is complete, or a base holds it."""
        base = self.base(spark)
        return (base is not None and batch_id <= base) or folders.committed(spark, self.version(batch_id))

    def write(self, rows: DataFrame, batch_id: int) -> None:
        """One batch's version; what a run that failed has left is replaced."""
        rows.write.mode("overwrite").parquet(self.version(batch_id))

    def base(self, spark: SparkSession) -> int | None:
        """The last batch of the newest complete base."""
        found = [n for n in folders.numbered(spark, f"{self.path}/{BASE}", UPTO) if folders.committed(spark, self._base(n))]
        return max(found, default=None)

    def _base(self, upto: int) -> str:
        return f"{self.path.rstrip('/')}/{BASE}/{UPTO}{upto}"

    def versions(self, spark: SparkSession, after: int | None = None, upto: int | None = None) -> list[int]:
        """Complete versions later than a base."""
        found = folders.numbered(spark, self.path, BATCH)
        found = [n for n in found if (after is None or n > after) and (upto is None or n <= upto)]
        return [n for n in found if folders.committed(spark, self.version(n))]

    def _parts(self, spark: SparkSession, upto: int | None = None) -> DataFrame | None:
        base = self.base(spark)
        later = self.versions(spark, base, upto)
        parts = [spark.read.parquet(self._base(base))] if base is not None else []
        if later:
            parts.append(spark.read.option("basePath", self.path).parquet(*[self.version(n) for n in later])
                         .withColumn("batch_id", F.col("batch_id").cast("long")))
        return reduce(lambda a, b: a.unionByName(b), parts) if parts else None

    def current(self, spark: SparkSession, upto: int | None = None) -> DataFrame | None:
        """One row per key, from the base and the later versions (up to one batch, if given, which
        must not be before the base); None if nothing is written yet."""
        parts = self._parts(spark, upto)
        return None if parts is None else self.fold(parts).drop("batch_id")

    def compact(self, spark: SparkSession) -> int | None:
        """Fold all complete versions into a new base; the last batch that the base holds."""
        before = self.base(spark)
        later = self.versions(spark, before)
        if later:
            self.fold(self._parts(spark, later[-1])).write.mode("overwrite").parquet(self._base(later[-1]))
        # what the base before this one had replaced, and the bases before it
        if before is not None:
            for n in folders.numbered(spark, self.path, BATCH):
                if n <= before:
                    folders.remove(spark, self.version(n))
            for n in folders.numbered(spark, f"{self.path}/{BASE}", UPTO):
                if n < before:
                    folders.remove(spark, self._base(n))
        return later[-1] if later else before
