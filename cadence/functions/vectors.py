"""Vector kernels on ``array<double>`` columns (R9) and grouped vector means.

Row-wise maths uses higher-order functions: JVM-side, without Python workers (array lambdas are
evaluated outside whole-stage codegen); grouped means use ``Summarizer``, which folds vectors in the JVM with partial aggregation,
so no group is ever collected into one list.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def as_double_array(c: Column | str) -> Column:
    c = F.col(c) if isinstance(c, str) else c
    return c.cast("array<double>")


def dot(a: Column, b: Column) -> Column:
    """Σ a_i·b_i (arrays of equal length)."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda acc, v: acc + v)


def norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda acc, v: acc + v * v))


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity; 0 when either vector has zero norm (sklearn convention)."""
    denom = norm(a) * norm(b)
    return F.when(denom == 0, F.lit(0.0)).otherwise(dot(a, b) / denom)


def unit(a: Column) -> Column:
    """L2-normalise; a zero vector stays zero. Arrays of one bind the vector and its norm, so that
    neither is worked out anew for every element."""
    def scale(x):
        return F.get(F.transform(F.array(norm(x)), lambda n: F.when(n > 0, F.transform(x, lambda v: v / n)).otherwise(x)), F.lit(0))

    return F.get(F.transform(F.array(a), scale), F.lit(0))


def vector_mean(c: Column | str, weight: Column | str | None = None) -> Column:
    """Aggregate: element-wise (weighted) mean of an ``array<double>`` column, as array<double>.

    Summarizer keeps one running vector per group (map-side partial aggregation), so a hot
    group costs one vector of memory, not a list of its members.
    """
    vec = array_to_vector(as_double_array(c))
    if weight is None:
        return vector_to_array(Summarizer.mean(vec))
    w = F.col(weight) if isinstance(weight, str) else weight
    return vector_to_array(Summarizer.mean(vec, w.cast("double")))


# ---- vectors as bytes ------------------------------------------------------------------
# Rows with an array column are slow to hand to Python (the size of the growing batch is worked out
# anew for every row), so vectors that travel with many rows are packed once.

def packed(df: DataFrame, column: str, dtype: str = "float64") -> DataFrame:
    """``df`` with an array of numbers as the bytes of its values; null stays null."""
    names = df.columns
    at = names.index(column)
    schema = ", ".join(f"`{c}` {'binary' if c == column else t}" for c, t in df.dtypes)

    def run(batches):
        for batch in batches:
            lists = batch.column(at)
            flat = pc.list_flatten(lists).to_numpy(zero_copy_only=False).astype(dtype)
            ends = np.cumsum(pc.fill_null(pc.list_value_length(lists), 0).to_numpy()) * flat.itemsize
            offsets = pa.py_buffer(np.concatenate([[0], ends]).astype(np.int32).tobytes())
            valid = pc.is_valid(lists)
            out = pa.BinaryArray.from_buffers(pa.binary(), len(lists), [None, offsets, pa.py_buffer(flat.tobytes())])
            out = pc.if_else(valid, out, pa.scalar(None, pa.binary()))
            yield pa.RecordBatch.from_arrays([out if i == at else c for i, c in enumerate(batch.columns)], names)

    return df.mapInArrow(run, schema)


def matrix(column: pa.Array | pa.ChunkedArray, dtype: str = "float64") -> np.ndarray:
    """Packed vectors of one length, none of them null, as the rows of a matrix."""
    a = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    if not len(a):
        return np.zeros((0, 1), dtype)
    ends = np.frombuffer(a.buffers()[1], np.int32, len(a) + 1, a.offset * 4)
    return np.frombuffer(a.buffers()[2], np.uint8, int(ends[-1] - ends[0]), int(ends[0])).view(dtype).reshape(len(a), -1)


# ---- places as bytes ---------------------------------------------------------------------

def gap_type(n: int) -> str:
    """The narrower of two kinds of gaps for short lists of places below ``n``."""
    return "uint8" if n <= 8_192 else "uint16"


def gaps(places: np.ndarray, sizes: np.ndarray, dtype: str) -> tuple[np.ndarray, np.ndarray]:
    """Lists of places, ``sizes`` long, each ascending and distinct: the numbers left out before each place, and
    how many numbers of ``dtype`` each list takes. The type's highest number stands for itself and goes on."""
    top = np.iinfo(dtype).max
    before = np.concatenate([[-1], places[:-1]]).astype(np.int64)[:len(places)]
    heads = np.cumsum(sizes) - sizes
    before[heads[sizes > 0]] = -1
    left_out = places.astype(np.int64) - before - 1
    ends = np.cumsum(left_out // top + 1)
    out = np.full(int(ends[-1]) if len(ends) else 0, top, dtype)
    out[ends - 1] = left_out % top
    bounds = np.concatenate([[0], ends])
    return out, bounds[np.cumsum(sizes)] - bounds[heads]


def places_of(packed: pa.Buffer | bytes | np.ndarray, dtype: str) -> np.ndarray:
    """The places of one packed list."""
    g = np.frombuffer(packed, dtype)
    at = np.cumsum(g, dtype=np.int64)[g != np.iinfo(dtype).max]
    return at + np.arange(len(at))


def list_places(column: pa.Array, dtype: str) -> tuple[np.ndarray, np.ndarray]:
    """The places of packed lists, none of them null, one list after the other, and the lists' lengths."""
    if not len(column):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    ends = np.frombuffer(column.buffers()[1], np.int32, len(column) + 1, column.offset * 4).astype(np.int64)
    data = column.buffers()[2]
    g = np.frombuffer(data, np.uint8, int(ends[-1] - ends[0]), int(ends[0])).view(dtype) if ends[-1] > ends[0] else np.zeros(0, dtype)
    ends = (ends - ends[0]) // np.dtype(dtype).itemsize
    real = g != np.iinfo(dtype).max
    sums, seen = (np.concatenate([[0], np.cumsum(x, dtype=np.int64)]) for x in (g, real))
    sizes = seen[ends[1:]] - seen[ends[:-1]]
    at = np.repeat(ends[:-1], sizes)
    return sums[1:][real] - sums[at] + np.arange(len(at)) - seen[at], sizes


def packed_places(df: DataFrame, column: str, dtype: str) -> DataFrame:
    """``df`` with an array of distinct ascending places as the bytes of their gaps; null stays null."""
    names = df.columns
    at = names.index(column)
    schema = ", ".join(f"`{c}` {'binary' if c == column else t}" for c, t in df.dtypes)

    def run(batches):
        for batch in batches:
            lists = batch.column(at)
            sizes = pc.fill_null(pc.list_value_length(lists), 0).to_numpy().astype(np.int64)
            flat, taken = gaps(pc.list_flatten(lists).to_numpy(zero_copy_only=False), sizes, dtype)
            offsets = pa.py_buffer(np.concatenate([[0], np.cumsum(taken) * flat.itemsize]).astype(np.int32).tobytes())
            out = pa.BinaryArray.from_buffers(pa.binary(), len(lists), [None, offsets, pa.py_buffer(flat.tobytes())])
            out = pc.if_else(pc.is_valid(lists), out, pa.scalar(None, pa.binary()))
            yield pa.RecordBatch.from_arrays([out if i == at else c for i, c in enumerate(batch.columns)], names)

    return df.mapInArrow(run, schema)


def exact_type(df: DataFrame, column: str) -> str:
    """``float32`` if that holds every number of an ``array<double>`` column, else ``float64``."""
    same = F.coalesce(F.forall(column, lambda x: x.eqNullSafe(x.cast("float").cast("double"))), F.lit(True))
    return "float32" if df.agg(F.coalesce(F.min(same), F.lit(True))).first()[0] else "float64"
