"""Token ids, packed into rows of equal length.

Each task encodes its documents, ends each with the end-of-text id, splits documents that are
longer than a row into pieces (nothing is dropped), and packs the pieces of a block of bounded
size by best-fit-decreasing: longest first, each into the row with the least room that still
holds it. That row is found in a segment tree over capacities. Packing needs no shuffle; the rows
of a block depend only on its documents and their order.

One result row is one packed row: its ids as little-endian integers (two bytes each while the
vocabulary allows it, else four), padded to ``row_tokens``; cumulative segment lengths; position
ids that begin at 0 in each segment; and which document and which of its tokens each segment holds.
Rows of one block in order are the block's id matrix (``matrix``).

Defined results: a null or empty text has no tokens and is in no row; a null id is kept as null;
repeated rows are packed each time; an empty table gives no rows; extra columns are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession

from cadence.llm.tokenizer import TOKENIZER_FILE, load

ROW_TOKENS = 2048
BLOCK_TOKENS = 1 << 21          # tokens that are packed together


class CapacityTree:
    """Rows by room left; the tree tells which rooms have rows."""

    def __init__(self, most: int):
        self.leaves = 1 << most.bit_length()
        self.any = bytearray(2 * self.leaves)
        self.rows: list[list[int]] = [[] for _ in range(most + 1)]

    def add(self, row: int, room: int) -> None:
        self.rows[room].append(row)
        i = self.leaves + room
        while i and not self.any[i]:
            self.any[i] = 1
            i >>= 1

    def take(self, need: int) -> tuple[int, int] | None:
        """Remove and give a row with the least room of at least ``need``, and that room."""
        i = self.leaves + need
        while not self.any[i]:
            while i & 1:            # climb to the next subtree on the right
                i >>= 1
                if i <= 1:
                    return None
            if i <= 1:
                return None
            i += 1
        while i < self.leaves:
            i = 2 * i if self.any[2 * i] else 2 * i + 1
        room = i - self.leaves
        row = self.rows[room].pop()
        while i and not self.rows[room]:
            self.any[i] = 0
            if self.any[i ^ 1]:
                break
            i >>= 1
        return row, room


def best_fit_decreasing(lengths: list[int], row_tokens: int) -> list[list[int]]:
    """Rows of piece numbers; every length is at most ``row_tokens``."""
    tree, rows = CapacityTree(row_tokens), []
    for i in sorted(range(len(lengths)), key=lambda i: (-lengths[i], i)):
        found = tree.take(lengths[i])
        row, room = found or (len(rows), row_tokens)
        if not found:
            rows.append([])
        rows[row].append(i)
        if room > lengths[i]:
            tree.add(row, room - lengths[i])
    return rows


def pack(docs: DataFrame, text_col: str = "text", row_tokens: int = ROW_TOKENS, block_tokens: int = BLOCK_TOKENS,
         tokenizer: str = TOKENIZER_FILE) -> DataFrame:
    """``(block, row, n_tokens, ids, positions, cu_seqlens, doc_ids, token_starts)``."""
    id_type = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = load(tokenizer)
        kind = np.dtype("<u2" if t.n_ids <= 1 << 16 else "<u4")
        task, number = TaskContext.get().partitionId(), 0
        pieces: list[tuple[object, int, np.ndarray]] = []     # document, first token, ids
        held, id_arrow = 0, None

        def flush() -> Iterator[pa.RecordBatch]:
            nonlocal pieces, held, number
            rows = best_fit_decreasing([len(p[2]) for p in pieces], row_tokens)
            block = (task << 32) + number
            for lo in range(0, len(rows), 256):
                part = rows[lo:lo + 256]
                ids = np.full((len(part), row_tokens), t.end_of_text, kind)
                positions = np.zeros((len(part), row_tokens), kind)
                ends, doc_ids, starts = [], [], []
                for r, members in enumerate(part):
                    at, cu = 0, [0]
                    for m in members:
                        n = len(pieces[m][2])
                        ids[r, at:at + n] = pieces[m][2]
                        positions[r, at:at + n] = np.arange(n)
                        at += n
                        cu.append(at)
                    ends.append(cu)
                    doc_ids.append([pieces[m][0] for m in members])
                    starts.append([pieces[m][1] for m in members])
                yield pa.RecordBatch.from_arrays(
                    [pa.array([block] * len(part), pa.int64()), pa.array(range(lo, lo + len(part)), pa.int32()),
                     pa.array([c[-1] for c in ends], pa.int32()), pa.array([x.tobytes() for x in ids], pa.binary()),
                     pa.array([x.tobytes() for x in positions], pa.binary()), pa.array(ends, pa.list_(pa.int32())),
                     pa.array(doc_ids, pa.list_(id_arrow)), pa.array(starts, pa.list_(pa.int64()))],
                    ["block", "row", "n_tokens", "ids", "positions", "cu_seqlens", "doc_ids", "token_starts"])
            pieces, held, number = [], 0, number + 1

        for batch in batches:
            id_arrow = batch.schema.field(0).type
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                text = text.as_py()
                if not text:
                    continue
                ids = np.array(t.encode_text(text) + [t.end_of_text], kind)
                for at in range(0, len(ids), row_tokens):
                    pieces.append((doc, at, ids[at:at + row_tokens]))
                held += len(ids)
                if held >= block_tokens:
                    yield from flush()
        if pieces:
            yield from flush()

    base = docs.select(docs["doc_id"].alias("doc_id"), docs[text_col].cast("string").alias("t"))
    return base.mapInArrow(run, f"block long, row int, n_tokens int, ids binary, positions binary, cu_seqlens array<int>, "
                                f"doc_ids array<{id_type}>, token_starts array<long>")


def write_packed(packed: DataFrame, path: str) -> None:
    """Write packed rows with Spark's Parquet writer (its commit survives lost executors)."""
    packed.write.parquet(path)


def read_packed(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def matrix(rows: list[bytes], row_tokens: int = ROW_TOKENS) -> np.ndarray:
    """The id (or position) matrix of some rows' bytes."""
    if not rows:
        return np.zeros((0, row_tokens), "<u2")
    return np.stack([np.frombuffer(x, f"<u{len(x) // row_tokens}") for x in rows])
