"""Mean catalog vectors per key without moving vectors.

A join with the catalog would put a whole vector on every row and carry it through the shuffle that
groups the rows. Here the rows travel as ids to cells (block of keys, chunk of songs); the chunk's
vectors come once per cell and are summed there.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cadence.functions import vectors as V
from cadence.operators.numbering import changes
from cadence.session import materialise

CELL_ROWS = 200_000        # rows of a cell, on average, but not less than
ROWS_PER_SONG = 25         # this many for each song of the catalog, which every block of keys is sent,
MAX_CELL_ROWS = 2_000_000  # up to this number
CHUNK_BYTES = 400_000_000  # of the songs of a cell: a key's sums of several chunks travel once more
SLICE_ROWS = 32_768        # rows whose vectors are held at a time


def vector_means(rows: DataFrame, keys: list[str], catalog: DataFrame, cell_rows: int | None = None, chunk_songs: int | None = None,
                 joined: bool = False) -> DataFrame:
    """``(keys.., vector, n)``: the mean embedding of the songs of each key of ``rows(keys.., video_id)``
    and their number, as of an inner join with ``catalog(video_id, embedding)``: repeats count, keys
    without a known song have no row. ``joined``: the rows were joined with the catalog's ids before, so
    each counts once however often the catalog has its id. ``rows`` are written once."""
    emb = catalog.select("video_id", V.as_double_array("embedding").alias("embedding")).where("video_id is not null and embedding is not null")
    kind = V.exact_type(emb, "embedding")
    emb = materialise(V.packed(emb, "embedding", kind), "packed-vectors")
    n_songs, width = emb.agg(F.count(F.lit(1)), F.coalesce(F.max(F.length("embedding")), F.lit(1))).first()
    cell_rows = cell_rows or max(CELL_ROWS, min(n_songs * ROWS_PER_SONG, MAX_CELL_ROWS))
    chunk_songs = chunk_songs or max(1, CHUNK_BYTES // (width // np.dtype(kind).itemsize * 8))
    id_type = emb.schema["video_id"].dataType
    base = materialise(rows.select(*keys, F.col("video_id").cast(id_type).alias("video_id")).where("video_id is not null"), "vector-rows")
    n_cells, n_chunks = max(1, -(-base.count() // cell_rows)), max(1, -(-n_songs // chunk_songs))
    types = ", ".join(f"`{k}` {base.schema[k].dataType.simpleString()}" for k in keys)
    block, chunk = F.pmod(F.xxhash64(*keys), F.lit(n_cells)), F.pmod(F.xxhash64("video_id"), F.lit(n_chunks))
    left = base.select((chunk * n_cells + block).alias("cell"), *keys, "video_id")
    right = emb.select(F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n_cells - 1).cast("long"))).alias("_b"), "*")
    right = right.select((chunk * n_cells + F.col("_b")).alias("cell"), F.col("video_id").alias("_song"), "embedding")
    cells = left.groupBy("cell").cogroup(right.groupBy("cell"))
    if n_chunks == 1:
        return cells.applyInArrow(_sums(keys, True, joined, kind), f"{types}, vector array<double>, n long")
    parts = cells.applyInArrow(_sums(keys, False, joined, kind), f"{types}, sums binary, n long")
    return parts.groupBy(block.alias("_b")).applyInArrow(_merged(keys), f"{types}, vector array<double>, n long")


def _runs(table: pa.Table, keys: list[str]) -> tuple[pa.Table, np.ndarray, np.ndarray]:
    """The rows sorted by key, the number of each row's key and the first row of each key."""
    table = table.sort_by([(k, "ascending") for k in keys])
    change = reduce(np.logical_or, [changes(table.column(k).combine_chunks()) for k in keys])
    return table, np.cumsum(change) - 1, np.flatnonzero(change)


def _added(vectors: np.ndarray, at: np.ndarray, key: np.ndarray, n: int) -> np.ndarray:
    """The sums of ``vectors[at]`` by the sorted ``key``, a slice at a time."""
    out = np.zeros((n, vectors.shape[1]))
    for lo in range(0, len(at), SLICE_ROWS):
        k = key[lo:lo + SLICE_ROWS]
        first = np.flatnonzero(np.concatenate([[True], k[1:] != k[:-1]]))
        out[k[first]] += np.add.reduceat(vectors[at[lo:lo + SLICE_ROWS]].astype(np.float64, copy=False), first, axis=0)
    return out


def _result(keys: list[str], heads: pa.Table, sums: np.ndarray, n: np.ndarray, whole: bool) -> pa.Table:
    m = sums / n[:, None] if whole else sums
    if whole:
        out = pa.ListArray.from_arrays(np.arange(len(m) + 1, dtype=np.int32) * m.shape[1], pa.array(m.reshape(-1)))
    else:
        ends = (np.arange(len(m) + 1, dtype=np.int32) * m.shape[1] * 8).tobytes()
        out = pa.BinaryArray.from_buffers(pa.binary(), len(m), [None, pa.py_buffer(ends), pa.py_buffer(m.tobytes())])
    return pa.table([*[heads.column(k) for k in keys], out, pa.array(n.astype(np.int64))], [*keys, "vector" if whole else "sums", "n"])


def _sums(keys: list[str], whole: bool, joined: bool, kind: str = "float64"):
    def run(left: pa.Table, songs: pa.Table) -> pa.Table:
        ids = songs.column("_song").combine_chunks()
        names = ids.unique()
        place = pc.index_in(left.column("video_id"), value_set=names).combine_chunks()
        rows = left.append_column("_at", place).filter(pc.is_valid(place))
        if not rows.num_rows:
            last = ("vector", pa.list_(pa.float64())) if whole else ("sums", pa.binary())
            return pa.schema([*[left.schema.field(k) for k in keys], last, ("n", pa.int64())]).empty_table()
        vectors, count = V.matrix(songs.column("embedding"), kind), np.ones(len(names))
        if len(names) < len(ids):      # rows of one id count as a join would count them
            of = pc.index_in(ids, value_set=names).to_numpy()
            order = np.argsort(of, kind="stable")
            vectors, count = _added(vectors, order, of[order], len(names)), np.bincount(of).astype(float)
            if joined:
                vectors, count = vectors / count[:, None], np.ones(len(names))
        rows, key, first = _runs(rows, keys)
        at = rows.column("_at").to_numpy()
        return _result(keys, rows.take(pa.array(first)), _added(vectors, at, key, len(first)), np.bincount(key, count[at]), whole)

    return run


def _merged(keys: list[str]):
    def run(parts: pa.Table) -> pa.Table:
        parts, key, first = _runs(parts, keys)
        sums = _added(V.matrix(parts.column("sums")), np.arange(parts.num_rows), key, len(first))
        return _result(keys, parts.take(pa.array(first)), sums, np.bincount(key, parts.column("n").to_numpy()), True)

    return run
