"""A17 by cells: how often two songs are liked by the same user, without a row per user and pair.

Songs get places in the order of their ids, a user's likes are packed lists of places of at most a
chunk's length. A cell (range of songs, block of lists) counts in a matrix of at most ``MATRIX_CELLS``
numbers, so a task hands on one row per pair of songs it met, however many users like both.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cadence.functions import vectors as V
from cadence.operators.numbering import numbered
from cadence.session import materialise

MATRIX_CELLS = 32_000_000      # numbers of a matrix (4 bytes each): songs of a range x all songs
PAIRS_A_NUMBER = 4             # pairs that are counted per number of the matrices, at least


def pair_counts(likes: DataFrame, user: str, item: str, chunk_items: int, matrix_cells: int = MATRIX_CELLS) -> DataFrame:
    """``(item_a, item_b, cooc)``, item_a < item_b: the number of distinct users who like both."""
    known = F.col(user).isNotNull() & F.col(item).isNotNull()
    rows = materialise(likes.where(known).select(F.col(user).alias("_u"), F.col(item).alias("_i")).distinct(), "likes")
    ids = rows.select("_i", F.lit(0).alias("_all")).distinct()
    songs = materialise(numbered(ids, "_all", ["_i"], "_n").select("_i", (F.col("_n") - 1).cast("int").alias("place")), "songs")
    n = max(1, songs.count())
    width = max(1, min(n, matrix_cells // n))
    n_chunks = -(-n // width)
    degree = rows.groupBy("_u").agg(F.count(F.lit(1)).alias("_k"))
    pairs = degree.agg(F.sum(F.col("_k").cast("double") * F.col("_k"))).first()[0] or 0
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    n_blocks = int(max(1, min(parts, pairs // (PAIRS_A_NUMBER * n * n))))
    placed = (rows.join(songs, "_i").join(degree.select("_u", F.ceil(F.col("_k") / chunk_items).cast("int").alias("_nb")), "_u")
              .select("_u", "place", F.floor(F.col("place") / width).cast("int").alias("chunk"), F.pmod(F.xxhash64("_i"), F.col("_nb")).cast("int").alias("piece")))
    lists = lambda *keys: V.packed(placed.groupBy("_u", "piece", *keys).agg(F.collect_list("place").alias("l")), "l", "int32")
    # every list of a range of songs meets every list of its user
    left = lists("chunk").select("_u", "chunk", F.col("l").alias("a"))
    both = left.join(lists().select("_u", "piece", F.col("l").alias("b")), "_u")
    cell = (F.col("chunk").cast("long") * n_blocks + F.pmod(F.xxhash64("_u", "piece"), F.lit(n_blocks))).alias("cell")
    dealt = both.select(cell, "chunk", "a", "b").repartition(max(parts, n_chunks * n_blocks), "cell").sortWithinPartitions("cell")
    met = dealt.mapInArrow(_count(n, width), "_a int, _b int, cooc long")
    # the rows of a task are distinct: dealt before they are added
    sums = met.repartition(parts, "_a").groupBy("_a", "_b").agg(F.sum("cooc").alias("cooc"))
    name = lambda p, c: songs.select(F.col("place").alias(p), F.col("_i").alias(c))
    return sums.join(name("_a", "item_a"), "_a").join(name("_b", "item_b"), "_b").select("item_a", "item_b", "cooc")


def _count(n: int, width: int, batch_rows: int = 200_000):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cell = matrix = low = None

        def ready() -> Iterator[pa.RecordBatch]:
            """The pairs of the cell that ends, some songs at a time."""
            step = max(1, batch_rows // n)
            for lo in range(0, len(matrix), step):
                a, b = np.nonzero(matrix[lo:lo + step])
                up = low + lo + a < b
                a, b = a[up], b[up]
                if len(a):
                    yield pa.RecordBatch.from_arrays([pa.array((low + lo + a).astype(np.int32)), pa.array(b.astype(np.int32)), pa.array(matrix[lo + a, b].astype(np.int64))],
                                                     ["_a", "_b", "cooc"])

        for batch in batches:
            cells, chunks, left, right = (batch.column(c) for c in ("cell", "chunk", "a", "b"))
            cells, chunks = cells.to_numpy(), chunks.to_numpy()
            for i in range(batch.num_rows):
                if cells[i] != cell:
                    if cell is not None:
                        yield from ready()
                    cell, low = cells[i], int(chunks[i]) * width
                    matrix = np.zeros((min(width, n - low), n), np.int32)
                a = np.frombuffer(left[i].as_buffer(), np.int32)
                b = np.frombuffer(right[i].as_buffer(), np.int32)
                matrix.reshape(-1)[((a.astype(np.int64) - low) * n)[:, None] + b] += 1      # a list holds a place once
        if cell is not None:
            yield from ready()

    return run
