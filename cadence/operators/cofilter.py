"""R2 by cells: the best co-occurrence of every candidate over a session's seeds.

A join of seeds and index has a row per session, seed and partner. Here a cell (block of sessions, chunk
of candidates) holds the chunk's columns of the index as a matrix of the narrowest numbers that hold the
counts; seeds come as packed lists, a user's likes as one list for all sessions, and a session costs one
maximum over its rows of the matrix. Columns travel deflated, lists as gaps. A sorted partition is
streamed, so no more than one matrix and one session's lists are held.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cadence.functions import vectors as V
from cadence.operators.numbering import numbered
from cadence.session import materialise

MATRIX_CELLS = 32_000_000      # numbers of a matrix if they take 4 bytes each: seeds x candidates of a chunk
BLOCK_LISTS = 40_000           # lists of seeds of a block of sessions, on average
SMALL_BLOCK = 10               # every block is sent all columns: with few lists blocks are this many times smaller,
MANY_BLOCKS = 32               # up to this number of cells; from there on blocks grow, up to
LARGE_BLOCK = 16               # this many times their size
BATCH_ROWS = 100_000           # result rows that are handed on together
SEEDS, PLAYLIST, PLAYED, CANDIDATES = range(4)
_NONE = object()               # no session yet; ids can be null


@dataclass
class Seeds:
    """The songs that a session's candidates are compared with: its ``own(session_id, video_id)`` and,
    where given, those of its owners, ``links(session_id, owner)`` and ``owned(owner, video_id)``."""

    own: DataFrame
    links: DataFrame | None = None
    owned: DataFrame | None = None

    def rows(self, only: DataFrame | None = None) -> DataFrame:
        """``(session_id, video_id)``, distinct; ``only``: of these sessions."""
        own, links = self.own.select("session_id", "video_id"), self.links
        if only is not None:
            own, links = own.join(only, "session_id", "left_semi"), None if links is None else links.join(only, "session_id", "left_semi")
        if links is not None:
            own = own.unionByName(links.join(self.owned, "owner").select("session_id", "video_id"))
        return own.distinct()

    def sessions(self) -> DataFrame:
        own = self.own.select("session_id")
        if self.links is not None:
            own = own.unionByName(self.links.join(self.owned.select("owner").distinct(), "owner", "left_semi").select("session_id"))
        return own.distinct()


def best_cooccurrence(seeds: Seeds, index: DataFrame, pop: DataFrame, played: DataFrame, playlist: DataFrame | None, min_cooccurrence: int,
                      catalog: DataFrame | None = None, candidates: DataFrame | None = None, k: int | None = None,
                      matrix_cells: int = MATRIX_CELLS, block_lists: int = BLOCK_LISTS) -> tuple[DataFrame, bool]:
    """``(session_id, video_id, cf_score, rank)`` and whether ``rank`` counts over all candidates (else
    over those of a chunk). Songs of ``catalog`` that were not played, the ``k`` best of a chunk. With ``candidates``
    only those, played or not, and a row without ``video_id`` for a session with any unplayed
    song that scores."""
    index = materialise(index.where(F.col("cooc") >= min_cooccurrence - (0 if playlist is None else 1)).select("video_id", "other_id", "cooc"), "cf-index")
    ids = index.select("video_id").union(index.select("other_id")).distinct()
    songs = materialise(numbered(ids.withColumn("_all", F.lit(0)), "_all", ["video_id"], "_n").select("video_id", (F.col("_n") - 1).cast("int").alias("place")), "cf-songs")
    n = max(1, songs.count())
    most = index.agg(F.max("cooc")).first()[0] or 0
    kind = next(t for t in ("uint8", "uint16", "int32") if most <= np.iinfo(t).max or t == "int32")
    width = max(1, min(n, matrix_cells * 4 // np.dtype(kind).itemsize // n))
    n_chunks = -(-n // width)
    gap = V.gap_type(n)
    lists = _lists(seeds.own, songs, "session_id", gap).select("session_id", F.lit(SEEDS).alias("kind"), "places")
    n_lists = seeds.own.select("session_id").distinct().count()
    if seeds.links is not None:
        shared = seeds.links.select("session_id", "owner").distinct()
        n_lists += shared.count()
        lists = lists.unionByName(shared.join(_lists(seeds.owned, songs, "owner", gap), "owner").select("session_id", F.lit(SEEDS).alias("kind"), "places"))
    small, large = n_lists * SMALL_BLOCK // block_lists, -(-n_lists // (block_lists * LARGE_BLOCK))
    n_blocks = max(1, min(small, max(large, MANY_BLOCKS // n_chunks)))
    for what, rows in ((PLAYLIST, playlist), (PLAYED, played), (CANDIDATES, candidates)):
        if rows is not None:
            lists = lists.unionByName(_lists(rows.where("session_id is not null"), songs, "session_id", gap).select("session_id", F.lit(what).alias("kind"), "places"))
    s_type, v_type = lists.schema["session_id"].dataType.simpleString(), songs.schema["video_id"].dataType.simpleString()
    block = F.pmod(F.xxhash64("session_id"), F.lit(n_blocks))
    chunks = F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n_chunks - 1).cast("long")))
    left = lists.select("*", chunks.alias("_c")).select(
        (F.col("_c") * n_blocks + block).alias("cell"), F.lit(1).alias("late"), "session_id", "kind", "places",
        F.lit(None).cast("int").alias("place"), F.lit(None).cast(v_type).alias("video_id"), F.lit(None).cast("long").alias("popularity"))
    # a column of the matrix per candidate
    at = songs.select(F.col("video_id").alias("other_id"), F.col("place").alias("_p"))
    columns = index if catalog is None else index.join(catalog.select("video_id"), "video_id", "left_semi")
    columns = columns.join(at, "other_id").repartition("video_id").groupBy("video_id").agg(F.array_sort(F.collect_list(F.struct("_p", "cooc"))).alias("l"))
    columns = columns.select("video_id", F.col("l._p").alias("places"), F.col("l.cooc").alias("counts"))
    v_kind = columns.schema["video_id"].dataType.simpleString()
    columns = columns.mapInArrow(_deflated(kind), f"video_id {v_kind}, places binary").join(songs, "video_id").join(pop.select("video_id", "popularity"), "video_id", "left")
    columns = materialise(columns, "cf-columns")
    blocks = F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n_blocks - 1).cast("long")))
    right = columns.select("*", blocks.alias("_b")).select(
        (F.floor(F.col("place") / width) * n_blocks + F.col("_b")).alias("cell"), F.lit(0).alias("late"), F.lit(None).cast(s_type).alias("session_id"),
        F.lit(None).cast("int").alias("kind"), "places", "place", "video_id", F.col("popularity").cast("long").alias("popularity"))
    parts = max(int(index.sparkSession.conf.get("spark.sql.shuffle.partitions")), n_blocks * n_chunks)
    dealt = left.unionByName(right).repartition(parts, "cell").sortWithinPartitions("cell", "late", "session_id")
    run = _stream(n, width, kind, gap, min_cooccurrence, playlist is not None, candidates is not None, k)
    return dealt.mapInArrow(run, f"session_id {s_type}, video_id {v_type}, cf_score double, rank int"), n_chunks == 1


def _lists(rows: DataFrame, songs: DataFrame, key: str, gap: str) -> DataFrame:
    """``(key, places)``: the distinct known songs of a key as packed places."""
    at = rows.select(key, "video_id").join(songs, "video_id").select(key, "place").repartition(key)
    return V.packed_places(at.groupBy(key).agg(F.array_sort(F.collect_set("place")).alias("places")), "places", gap)


def _deflated(kind: str):
    """``(video_id, places)`` of ``(video_id, places, counts)``: a column of the matrix as deflated gaps and counts."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for places, counts in zip(b.column(1), b.column(2)):
                places, counts = places.values.to_numpy(), counts.values.to_numpy()
                last = np.append(places[1:] != places[:-1], True)      # of a pair's repeats the highest count
                places, counts = places[last], counts[last]
                gap, _ = V.gaps(places, np.array([len(places)]), "uint8")
                out.append(len(places).to_bytes(4, "little") + zlib.compress(gap.tobytes() + counts.astype(kind).tobytes(), 1))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out, pa.binary())], ["video_id", "places"])

    return run


def _column(packed: bytes, kind: str) -> tuple[np.ndarray, np.ndarray]:
    """The places and counts of a deflated column."""
    data = zlib.decompress(packed[4:])
    cut = len(data) - int.from_bytes(packed[:4], "little") * np.dtype(kind).itemsize
    return V.places_of(data[:cut], "uint8"), np.frombuffer(data[cut:], kind)


def _stream(n: int, width: int, kind: str, gap: str, least: int, has_playlist: bool, chosen: bool, k: int | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cell = matrix = types = None
        session = _NONE
        ids, out, held, lists = [], [], 0, {}

        def ready() -> Iterator[pa.RecordBatch]:
            nonlocal out, held
            if out:
                who = pa.array([x[0] for x in out], types[0]).take(pa.array(np.repeat(np.arange(len(out)), [len(x[1]) for x in out])))
                song = np.concatenate([x[1] for x in out])
                what = pa.array(ids, types[1]).take(pa.array(song, mask=song < 0))
                yield pa.RecordBatch.from_arrays([who, what, pa.array(np.concatenate([x[2] for x in out])), pa.array(np.concatenate([x[3] for x in out]))],
                                                 ["session_id", "video_id", "cf_score", "rank"])
            out, held = [], 0

        def finish() -> None:
            """The result rows of the session whose lists are held."""
            nonlocal held
            if SEEDS not in lists or not ids:
                return
            song, score, rank = _session(lists, matrix, place, popularity, order, column, least, has_playlist, chosen, k)
            if len(song):
                out.append((session, song, score, rank))
                held += len(song)

        for batch in batches:
            types = types or [batch.schema.field(c).type for c in ("session_id", "video_id")]
            col = {c: batch.column(c) for c in ("cell", "late", "session_id", "kind", "places", "place", "video_id", "popularity")}
            cells, late = col["cell"].to_numpy(), col["late"].to_numpy()
            for i in range(batch.num_rows):
                if cells[i] != cell:
                    if session is not _NONE:
                        finish()
                    yield from ready()
                    cell, session, matrix, ids, cols, pops, lists = cells[i], _NONE, None, [], [], [], {}
                if not late[i]:
                    if matrix is None:
                        matrix = np.zeros((n, width), kind)
                    p = col["place"][i].as_py()
                    at, counts = _column(col["places"][i].as_py(), kind)
                    matrix[at, p % width] = np.maximum(matrix[at, p % width], counts)
                    ids.append(col["video_id"][i].as_py())
                    cols.append(p)
                    pops.append(col["popularity"][i].as_py())
                    continue
                s = col["session_id"][i].as_py()
                if session is _NONE or s != session:
                    if session is _NONE:      # the cell's matrix is whole: its songs in the order of their places
                        place = np.sort(np.array(cols, np.int64))
                        order = np.argsort(np.array(cols, np.int64), kind="stable")
                        popularity = np.array([-1 if x is None else x for x in pops], np.float64)[order]
                        column = place % width
                    else:
                        finish()
                        if held >= BATCH_ROWS:
                            yield from ready()
                    session, lists = s, {}
                lists.setdefault(col["kind"][i].as_py(), []).append(V.places_of(col["places"][i].as_buffer(), gap))
        if session is not _NONE:
            finish()
        yield from ready()

    return run


def _session(lists, matrix, place, popularity, order, column, least, has_playlist, chosen, k):
    """``(song, score, rank)`` of one session and chunk: ``song`` counts the rows of the chunk, -1 is none."""
    seeds = np.unique(np.concatenate(lists[SEEDS]))
    best = matrix[seeds].max(axis=0)[column].astype(np.int32)

    def here(kind):
        mark = np.zeros(len(matrix), bool)
        for x in lists.get(kind, ()):
            mark[x] = True
        return mark[place]

    pop = np.where(popularity < 0, 0.0 if has_playlist else 1.0, popularity)
    if has_playlist and PLAYLIST in lists:
        own = here(PLAYLIST)
        both = np.intersect1d(seeds, np.concatenate(lists[PLAYLIST]))
        if own.any() and len(both):
            near = matrix[np.ix_(both, column[own])].astype(np.int32)
            best[own] = np.maximum(best[own], np.where(near > 0, near + 1, 0).max(axis=0))
        pop = pop + own
    score = np.minimum(best / np.maximum(pop, 1.0), 1.0)
    fits, unplayed = best >= least, ~here(PLAYED)
    song = np.flatnonzero(fits & (here(CANDIDATES) if chosen else unplayed))
    song = song[np.argsort(-score[song], kind="stable")][:k]
    rank = np.arange(1, len(song) + 1, dtype=np.int32)
    score = score[song]
    song = order[song]
    if chosen and (fits & unplayed).any():
        song, score, rank = np.append(song, -1), np.append(score, 0.0), np.append(rank, np.int32(0))
    return song, score, rank
