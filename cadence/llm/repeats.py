"""Exact repeated-substring removal by bucket refinement.

Every byte covered by a string of ``length`` bytes that also starts earlier (in a smaller
document, or earlier in the same one) is removed; strings are judged on the input and never reach
over the end of a document.

Buckets are named by content, so all tasks agree on them without a table. The names of 2q-grams
come from the names of the q-grams at both offsets (1, 2, 4, ... up to the full length), each level
reusing the last. Sorting all positions of a corpus by such names would move many times the
input, so it is done in three refinements that each see only what the one before left open:

1. Anchors. Of each full-length string the q-gram with the least name is its anchor. Consecutive
   strings with one anchor form a run (some 35 bytes long). Equal strings have equal anchors at
   equal offsets, so an anchor's q-gram is the initial bucket, and strings of different buckets
   differ. One row per run is moved.
2. Runs. Inside a bucket, runs are sorted by the names at their later offsets (first and last full
   string, and the offsets). All but the first of equal runs are covered by an earlier copy. A
   bucket with one kind of run is settled. Only first runs of the others stay open.
3. Strings. The strings of open runs are named one by one and sorted the same way: where a bucket
   has few open runs, their bytes meet in one task (a fraction of what the names would take);
   the strings of larger buckets are dealt out by their names, so no bucket must be held whole.

Equal runs are thinned inside each task before they are moved, so a passage that a third of all
documents share arrives a few times per task. Texts are moved deflated.

The recursion is in the names: every level reuses the names of the level below, and an anchor's
bucket is refined in two fixed steps instead of by updated bucket pointers, which would have to be
moved for every position. Strings count as equal if their names are, 128 bits together (anchor and
run, or anchor and string): that is exact but for a chance of about n * n / 2**128 with n strings.
Rows equal in id and text are one document that is
listed twice: they get the same result. Null ids come last; a null text is empty; an empty table
gives an empty result; extra columns are not looked at.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from cadence.llm.common import materialise

LENGTH = 100
BUCKET_RUNS = 256                # open runs of a bucket that may meet in one task
BUFFER_BITS = 20                 # bytes that are named together: below 2**20, with their places
_PLACE = np.uint64((1 << BUFFER_BITS) - 1)
_rng = np.random.default_rng(4242)
_BYTES = _rng.integers(0, 2**64, 256, np.uint64)
_MULS = _rng.integers(0, 2**64, 64, np.uint64) | np.uint64(1)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Names:
    """Sizes and names for strings of ``length`` bytes (two at least)."""

    def __init__(self, length: int = LENGTH):
        if length < 2:
            raise ValueError("length must be 2 or more")
        self.length = length
        self.top = (length.bit_length() - 1)                # 2**top <= length
        self.q = 1 << (self.top - 1)                        # the anchors' size
        self.window = length - self.q + 1                   # q-grams in a string
        self.step = (1 << BUFFER_BITS) - 2 * length         # strings that start in one buffer of a long text

    def grams(self, data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Names of all q-grams and of all full-length strings of a buffer."""
        h, q = _BYTES[data], None
        for level in range(self.top):
            if level == self.top - 1:
                q = h
            s = 1 << level
            g = h[:-s] * _MULS[level]
            g += h[s:]
            h = g
        rest = self.length - (1 << self.top)
        full = (h[:len(h) - rest] * _MULS[40] + h[rest:]) if rest else h
        return _mix(q), _mix(full)

    def anchors(self, q: np.ndarray) -> np.ndarray:
        """For each string, the place of its q-gram with the least name (the first of equals)."""
        m = (q & ~_PLACE) | np.arange(len(q), dtype=np.uint64)
        have = 1
        while have < self.window:
            s = min(have, self.window - have)
            m = np.minimum(m[:-s], m[s:])
            have += s
        return (m & _PLACE).astype(np.int64)


def _buffers(offsets: np.ndarray, names: Names) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Cut concatenated texts into buffers: ``(first byte, last byte, text numbers, text ends)``.
    Short texts share a buffer; a long one is cut so that each string starts in just one."""
    i, n, limit = 0, len(offsets) - 1, 1 << BUFFER_BITS
    while i < n:
        if offsets[i + 1] - offsets[i] >= limit:
            at = int(offsets[i])
            while at < offsets[i + 1]:
                end = min(int(offsets[i + 1]), at + names.step + names.length - 1)
                yield at, end, np.array([i]), np.array([end])
                at += names.step
            i += 1
            continue
        j = int(np.searchsorted(offsets, offsets[i] + limit - 1, "right")) - 1
        j = max(j, i + 1)
        yield int(offsets[i]), int(offsets[j]), np.arange(i, j), offsets[i + 1:j + 1]
        i = j


def _texts(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    off = np.frombuffer(column.buffers()[1], np.int32, len(column) + 1, column.offset * 4).astype(np.int64)
    data = column.buffers()[2]
    return (np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)), off


def find_runs(data: np.ndarray, offsets: np.ndarray, names: Names) -> tuple[np.ndarray, ...]:
    """``(text, lo, hi, h, r)`` of all runs: they hold the strings that start at lo..hi."""
    out = []
    for a, b, texts, ends in _buffers(offsets, names):
        if b - a < names.length:
            continue
        q, full = names.grams(data[a:b])
        anchor = names.anchors(q)
        of = np.repeat(np.arange(len(texts)), np.diff(np.concatenate([[a], ends])))[:len(full)]
        valid = a + np.arange(len(full)) + names.length <= ends[of]
        change = np.empty(len(full), bool)
        change[0] = True
        change[1:] = (anchor[1:] != anchor[:-1]) | (valid[1:] != valid[:-1]) | (of[1:] != of[:-1])
        lo = np.flatnonzero(change)
        hi = np.append(lo[1:], len(full)) - 1
        lo, hi = lo[valid[lo]], hi[valid[lo]]
        at = anchor[lo]
        r = full[lo] * _MULS[50] + full[hi] * _MULS[51] + ((at - lo) * 4096 * 4096 + (hi - lo)).astype(np.uint64) * _MULS[52]
        t = texts[of[lo]]
        out.append((t, a + lo - offsets[t], a + hi - offsets[t], q[at].view(np.int64), _mix(r).view(np.int64)))
    if not out:
        return tuple(np.zeros(0, np.int64) for _ in range(5))
    return tuple(np.concatenate(x) for x in zip(*out))


def _ranks(ids: list, keys: list) -> np.ndarray:
    """Order of a batch's documents by (id, nulls last; key)."""
    order = sorted(range(len(ids)), key=lambda i: (ids[i] is None, 0 if ids[i] is None else ids[i], keys[i]))
    rank = np.empty(len(ids), np.int64)
    rank[order] = np.arange(len(ids))
    return rank


def _first_of_equals(*keys: np.ndarray) -> np.ndarray:
    """For rows sorted by ``keys``: is this the first row with its keys?"""
    new = np.ones(len(keys[0]), bool)
    if len(new):
        new[1:] = np.logical_or.reduce([k[1:] != k[:-1] for k in keys])
    return new


def _merged(doc: np.ndarray, s: np.ndarray, e: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Union of spans per document; touching spans become one."""
    if not len(doc):
        return doc, s, e
    order = np.lexsort((s, doc))
    doc, s, e = doc[order], s[order], e[order]
    wide = np.int64(1) << 40
    reach = np.maximum.accumulate(doc * wide + e)
    new = np.ones(len(doc), bool)
    new[1:] = doc[1:] * wide + s[1:] > reach[:-1]
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(doc)) - 1
    return doc[first], s[first], reach[last] - doc[first] * wide


def _batch(of: pa.RecordBatch | pa.Table, rows: np.ndarray, lo: np.ndarray, hi: np.ndarray, **more) -> pa.RecordBatch:
    """Rows of documents (by their places in ``of``) with byte offsets, and more columns first."""
    at = pa.array(rows.astype(np.int32))
    ids = [c.combine_chunks() if isinstance(c, pa.ChunkedArray) else c for c in (of.column("doc_id").take(at), of.column("k").take(at))]
    cols = dict(more) | {"doc_id": ids[0], "k": ids[1], "lo": pa.array(lo.astype(np.int32)), "hi": pa.array(hi.astype(np.int32))}
    return pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c) for c in cols.values()], list(cols))


def _constant(value: bool, n: int) -> np.ndarray:
    return np.full(n, value)


def _thinned(batch: pa.RecordBatch, names: Names, docs, lo, hi, h, r) -> Iterator[pa.RecordBatch]:
    """Rows to move: of rows equal in (h, r) within this batch the first; the others are settled
    already, and leave as merged spans of bytes (dealt out at random)."""
    rank = _ranks(batch.column("doc_id").to_pylist(), batch.column("k").to_pylist())
    order = np.lexsort((lo, rank[docs], r, h))
    first = _first_of_equals(h[order], r[order])
    gone, open_ = order[~first], order[first]
    d, s, e = _merged(docs[gone], lo[gone], hi[gone] + names.length)
    spread = _mix((d * 1_000_003 + s).astype(np.uint64)).view(np.int64)
    yield _batch(batch, d, s, e, h=spread, r=np.zeros(len(d), np.int64), settled=_constant(True, len(d)))
    yield _batch(batch, docs[open_], lo[open_], hi[open_], h=h[open_], r=r[open_], settled=_constant(False, len(open_)))


def _name_runs(names: Names):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                docs, lo, hi, h, r = find_runs(*_texts(batch.column("data")), names)
                yield from _thinned(batch, names, docs, lo, hi, h, r)

    return run


class _Refiner:
    """Takes rows sorted by (h, r, rank): settles what has an equal earlier row and, if
    ``leave_open``, gives the first row of each r in the buckets h that hold more than one r."""

    def __init__(self, names: Names, leave_open: bool, bucket_runs: int = BUCKET_RUNS):
        self.names, self.leave_open, self.bucket_runs = names, leave_open, bucket_runs
        self.carry, self.given = None, False      # the last (h, r)'s first row; is its bucket open?

    def step(self, table: pa.Table) -> Iterator[pa.RecordBatch]:
        settled = table.column("settled").to_numpy()
        if settled.any():
            at = np.flatnonzero(settled)
            yield self._out(table, at, table.column("lo").to_numpy()[at], table.column("hi").to_numpy()[at], True, False)
            table = table.filter(pa.array(~settled))
        if not table.num_rows:
            return
        if self.carry is not None:
            table = pa.concat_tables([self.carry, table]).combine_chunks()
        h, r, lo, hi = (table.column(c).to_numpy() for c in ("h", "r", "lo", "hi"))
        new = _first_of_equals(h, r)
        first, gone = np.flatnonzero(new), np.flatnonzero(~new)
        if len(gone):
            yield self._out(table, gone, lo[gone], hi[gone] + self.names.length, True, False)
        bucket = np.cumsum(_first_of_equals(h)) - 1
        kinds = np.bincount(bucket[first])
        # a bucket that began in an earlier batch, or may go on in the next one, counts as large
        small = kinds <= self.bucket_runs
        small[-1] = False
        if self.given:
            kinds[0], small[0] = 2, False
        if self.leave_open:
            open_ = first[kinds[bucket[first]] > 1]
            if self.given:
                open_ = open_[open_ > 0]          # the carried row was given before
            if len(open_):
                yield self._out(table, open_, lo[open_], hi[open_], False, small[bucket[open_]])
        self.given = bool(kinds[-1] > 1)
        self.carry = table.slice(int(first[-1]), 1)

    @staticmethod
    def _out(table, at, lo, hi, settled, small) -> pa.RecordBatch:
        n = len(at)
        return _batch(table, at, lo, hi, h=table.column("h").to_numpy()[at], settled=_constant(settled, n),
                      small=np.broadcast_to(np.asarray(small, bool), n).copy())


def _refine_runs(names: Names, bucket_runs: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        refiner = _Refiner(names, True, bucket_runs)
        for batch in batches:
            if batch.num_rows:
                yield from refiner.step(pa.Table.from_batches([batch]))

    return run


def _open_strings(names: Names):
    """Of each document's open runs, the bytes (small buckets) or each string's name (large)."""

    def with_bytes(b: pa.RecordBatch, found) -> pa.RecordBatch:
        n = b.num_rows
        return pa.RecordBatch.from_arrays([*b.columns, found if found is not None else pa.nulls(n, pa.binary())], [*b.schema.names, "data"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 2048):
                part = batch.slice(at, 2048)
                texts = [zlib.decompress(x) for x in part.column("z").to_pylist()]
                offsets = np.concatenate([[0], np.cumsum([len(x) for x in texts])]).astype(np.int64)
                whole = b"".join(texts)
                runs = part.column("runs")
                values = runs.flatten()
                lo, hi, h = (values.field(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in range(3))
                small = values.field(3).to_numpy(zero_copy_only=False)
                doc = np.repeat(np.arange(part.num_rows), np.diff(np.asarray(runs.offsets)))
                d, s, e = doc[small], lo[small], hi[small]
                a = offsets[d] + s
                cut = [whole[x:y] for x, y in zip(a.tolist(), (a + e - s + names.length).tolist())]
                yield with_bytes(_batch(part, d, s, e, h=h[small], r=np.zeros(len(d), np.int64), settled=_constant(False, len(d))),
                                 pa.array(cut, pa.binary()))
                if small.all():
                    continue
                doc, lo, hi, h = doc[~small], lo[~small], hi[~small], h[~small]
                n = hi - lo + 1
                p = np.repeat(lo, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
                doc, h = np.repeat(doc, n), np.repeat(h, n)
                order = np.lexsort((p, doc))
                doc, p, h = doc[order], p[order], h[order]
                place, g = offsets[doc] + p, np.zeros(len(p), np.int64)
                data = np.frombuffer(whole, np.uint8)
                for x, y, _, _ in _buffers(offsets, names):
                    i, j = np.searchsorted(place, (x, y - names.length + 1))
                    if i < j:
                        g[i:j] = names.grams(data[x:y])[1][place[i:j] - x].view(np.int64)
                for b in _thinned(part, names, doc, p, p, h, g):
                    yield with_bytes(b, None)

    return run


def _compare_bytes(table: pa.Table, names: Names) -> pa.RecordBatch | None:
    """Settle the strings of whole buckets: they are named anew from their runs' bytes, and strings of a
    bucket with one name are equal; rows are sorted by (h, rank)."""
    data, offsets = _texts(table.column("data").combine_chunks())
    data, offsets = data[offsets[0]:offsets[-1]], offsets - offsets[0]
    h, lo = table.column("h").to_numpy(), table.column("lo").to_numpy().astype(np.int64)
    n = table.column("hi").to_numpy() - lo + 1
    row = np.repeat(np.arange(len(n)), n)
    inside = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    g = names.grams(data)[1][offsets[row] + inside]
    bucket = (np.cumsum(_first_of_equals(h)) - 1)[row]
    order = np.lexsort((g, bucket))       # a stable sort: equal strings stay in rank order
    gone = order[~_first_of_equals(g[order], bucket[order])]
    r, s, e = _merged(row[gone], lo[row[gone]] + inside[gone], lo[row[gone]] + inside[gone] + names.length)
    return _Refiner._out(table, r, s, e, True, False) if len(r) else None


def _refine_strings(names: Names):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        refiner, held = _Refiner(names, False), None      # held: a bucket that may go on
        for batch in batches:
            if not batch.num_rows:
                continue
            table = pa.Table.from_batches([batch])
            by_bytes = table.column("data").is_valid()
            yield from refiner.step(table.filter(table.column("data").is_null()).drop_columns(["data"]))
            rows = table.filter(by_bytes)
            if not rows.num_rows:
                continue
            rows = (pa.concat_tables([held, rows]) if held is not None else rows).combine_chunks()
            h = rows.column("h").to_numpy()
            last = int(np.flatnonzero(_first_of_equals(h))[-1])
            held = rows.slice(last)
            if last and (out := _compare_bytes(rows.slice(0, last), names)) is not None:
                yield out
        if held is not None and (out := _compare_bytes(held, names)) is not None:
            yield out

    return run


def _deflate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, 2048):
            part = batch.slice(at, 2048)
            z = pa.array([zlib.compress(x.as_buffer(), 1) for x in part.column("data")], pa.binary())
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("k"), z], ["doc_id", "k", "z"])


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts without their spans."""
    span = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
    for batch in batches:
        for at in range(0, batch.num_rows, 1024):
            part = batch.slice(at, 1024)
            sizes, spans, kept = [], [], []
            for z, own in zip(part.column("z").to_pylist(), part.column("spans")):
                x = zlib.decompress(z)
                sizes.append(len(x))
                if not own.is_valid:
                    spans.append([])
                    kept.append(x)
                    continue
                s, e = (own.values.field(i).to_numpy().astype(np.int64) for i in (0, 1))
                _, s, e = _merged(np.zeros(len(s), np.int64), s, e)
                spans.append([{"start": a, "end": b} for a, b in zip(s.tolist(), e.tolist())])
                kept.append(b"".join(x[a:b] for a, b in zip([0, *e.tolist()], [*s.tolist(), len(x)])))
            yield pa.RecordBatch.from_arrays(
                [part.column("doc_id"), part.column("k"), pa.array(sizes, pa.int64()), pa.array(spans, span), pa.array(kept, pa.binary())],
                ["doc_id", "text_key", "n_bytes", "spans", "kept"])


def _sorted_by_bucket(rows: DataFrame, *keys: str) -> DataFrame:
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return rows.repartition(n, *keys).sortWithinPartitions("h", "r", F.col("doc_id").isNull(), "doc_id", "k", "lo")


def _same(a: str, b: str) -> Column:
    return F.col(f"{a}.doc_id").eqNullSafe(F.col(f"{b}.doc_id")) & (F.col(f"{a}.k") == F.col(f"{b}.k"))


def remove_repeats(docs: DataFrame, length: int = LENGTH, text_col: str = "text", bucket_runs: int = BUCKET_RUNS) -> DataFrame:
    """``(doc_id, text_key, n_bytes, spans, kept)`` for every input row: the maximal removed byte
    spans, in order, and the bytes that remain (which may begin or end inside a character).
    ``text_key`` is 0 where ids name the documents, else a content key. ``bucket_runs`` sets which
    buckets are compared by bytes in one task; it changes the work, not the result."""
    names = Names(length)
    id_type = docs.schema["doc_id"].dataType.simpleString()
    n = docs.agg(F.count("*").alias("n"), F.count_distinct("doc_id").alias("d")).first()
    unique = n.n == n.d
    text = docs[text_col].cast("string")
    key = F.lit(0).cast("long") if unique else F.xxhash64(docs["doc_id"], text)
    base = docs.select(docs["doc_id"].alias("doc_id"), key.alias("k"), F.coalesce(text.cast("binary"), F.lit(b"")).alias("data"))
    once = base if unique else base.dropDuplicates(["doc_id", "k"])
    deflated = f"doc_id {id_type}, k long, z binary"
    place = f"doc_id {id_type}, k long, lo int, hi int"
    refined = f"h long, settled boolean, small boolean, {place}"

    runs = once.mapInArrow(_name_runs(names), f"h long, r long, settled boolean, {place}")
    runs = materialise(_sorted_by_bucket(runs, "h").mapInArrow(_refine_runs(names, bucket_runs), refined), "runs")

    texts = once.mapInArrow(_deflate, deflated)
    open_runs = runs.where(~F.col("settled")).groupBy("doc_id", "k").agg(F.collect_list(F.struct("lo", "hi", "h", "small")).alias("runs"))
    named = texts.alias("t").join(open_runs.alias("o"), _same("t", "o")).select("t.doc_id", "t.k", "z", "runs")
    named = named.mapInArrow(_open_strings(names), f"h long, r long, settled boolean, {place}, data binary")
    strings = _sorted_by_bucket(named, "h", "r").mapInArrow(_refine_strings(names), refined)

    gone = runs.where("settled").select("doc_id", "k", "lo", "hi").union(strings.select("doc_id", "k", "lo", "hi"))
    spans = gone.groupBy("doc_id", "k").agg(F.collect_list(F.struct(F.col("lo").alias("start"), F.col("hi").alias("end"))).alias("spans"))
    every = texts if unique else base.mapInArrow(_deflate, deflated)
    joined = every.alias("t").join(spans.alias("s"), _same("t", "s"), "left").select("t.doc_id", "t.k", "z", "spans")
    return joined.mapInArrow(_cut, f"doc_id {id_type}, text_key long, n_bytes long, spans array<struct<start:int,end:int>>, kept binary")
