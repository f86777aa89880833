"""Exact top-k by cosine over the catalog with a metric index.

The catalog is clustered twice. Coarse clusters say in which chunk a song is; fine clusters of some
hundred songs say what a task may leave out. For a cluster with centre c whose songs are at most the
angle r away, no song is nearer to a session's vector q than the angle max(0, angle(q, c) - r). Clusters
are visited in the order of that bound until k songs are found; a cluster whose bound is below the k-th
score is never scored. A session's vector and lists are sent to one block; the chunks of a large catalog
pass by there one after the other, and the k best so far bound what the next chunk is scored for.

Exact for any vectors: the clusters only decide what is skipped. On songs without clusters (random
directions) nothing can be skipped and the cost is that of one blocked matrix product; on clustered
ones most pairs are left out (``scored`` counts them).

Songs that a session excludes, and songs with a bonus, travel to the session's block as packed
lists of places: they are masked or scored there, so no task hands on more than k rows a session. What several sessions exclude alike (the likes of a user who is in all of them) is
one list per user, handed to each of the sessions.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.accumulators import Accumulator
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cadence.functions import vectors as V
from cadence.operators.numbering import numbered
from cadence.session import materialise

CHUNK_SONGS = 20_000       # songs that a task holds, on average
FINE_SONGS = 256           # songs of a fine cluster, on average
MAX_COARSE = 1_024         # centres that are sent to the tasks; coarse clusters are split further by hash
STREAM_BLOCKS = 32         # where chunks pass by, blocks grow from here on
STREAM_PARTS = 64          # partitions of the blocks, at least
STREAM_ROWS = 512          # sessions of one matrix product where chunks pass by
BATCH_ROWS = 100_000       # result rows that are handed on together
FIT_SONGS = 20_000         # songs that the centres are fitted on, about; every song is indexed
BLOCK_SESSIONS = 2_000     # sessions that a task holds, on average, up to MANY_BLOCKS blocks
MANY_BLOCKS = 64           # every block is sent all songs: from here on blocks grow, up to
LARGE_BLOCK = 16           # this many times their size
SUB_SESSIONS = 256         # sessions of one matrix product
SLACK = 1e-9               # bounds are raised by this much, far above the rounding of scores
DECIMALS = 12              # scores of equal vectors are made equal, so that ties fall to the id


def unit_rows(m: np.ndarray) -> np.ndarray:
    n = np.linalg.norm(m, axis=1, keepdims=True)
    return np.divide(m, n, out=np.zeros_like(m), where=n > 0)


def vectors(column: pa.ChunkedArray | pa.Array, kind: str = "float64") -> np.ndarray:
    """Packed vectors as the rows of a matrix of unit vectors."""
    return unit_rows(V.matrix(column, kind).astype(np.float64, copy=False))


def clusters_of(rows: np.ndarray, n: int, rounds: int = 8) -> np.ndarray:
    """Spherical k-means: at most ``n`` centres of unit vectors, the same for the same rows."""
    centres = rows[np.unique(np.linspace(0, len(rows) - 1, n).astype(int))]
    for _ in range(rounds):
        of = (rows @ centres.T).argmax(axis=1)
        sums = np.zeros_like(centres)
        np.add.at(sums, of, rows)
        centres = np.where(np.linalg.norm(sums, axis=1, keepdims=True) > 0, unit_rows(sums), centres)
    return centres


def upper_bounds(q: np.ndarray, centres: np.ndarray, least: np.ndarray) -> np.ndarray:
    """Highest cosine that a song of each cluster can have: ``least`` is the smallest cosine of a
    song of the cluster with its centre. A zero vector has the cosine 0 with everything."""
    angle = np.arccos(np.clip(q @ centres.T, -1, 1)) - np.arccos(np.clip(least, -1, 1))
    return np.cos(np.maximum(angle, 0)) + SLACK


def first_visits(bounds: np.ndarray, sizes: np.ndarray, need: np.ndarray) -> np.ndarray:
    """Mask of the clusters in order of their bounds until they hold ``need`` songs."""
    order = np.argsort(-bounds, axis=1, kind="stable")
    held = np.cumsum(np.take_along_axis(np.broadcast_to(sizes, bounds.shape), order, axis=1), axis=1)
    before = np.concatenate([np.zeros((len(bounds), 1), held.dtype), held[:, :-1]], axis=1)
    out = np.zeros(bounds.shape, bool)
    np.put_along_axis(out, order, before < need[:, None], axis=1)
    return out


class MetricIndex:
    """Clusters of ``catalog(video_id, embedding)`` and the written table ``songs(video_id, embedding,
    coarse, part)``, of several clusters with ``place``, the number of the id in the order of ids. Building it runs jobs; only centres, sizes and angles of at most
    ``MAX_COARSE`` coarse clusters reach the driver."""

    def __init__(self, catalog: DataFrame, chunk_songs: int = CHUNK_SONGS, fine_songs: int = FINE_SONGS, fit_songs: int = FIT_SONGS):
        base = catalog.select("video_id", F.col("embedding").cast("array<double>").alias("embedding")).where("embedding is not null")
        self.kind = kind = V.exact_type(base, "embedding")
        base = materialise(V.packed(base, "embedding", kind), "packed-songs")
        self.size = base.count()
        self.fine_songs = fine_songs
        self.n_coarse = min(MAX_COARSE, -(-self.size // chunk_songs), fit_songs) or 1
        self.id_type = base.schema["video_id"].dataType.simpleString()
        if self.n_coarse == 1:
            self.centres = self.least = self.counts = None
            placed = base.withColumn("coarse", F.lit(0))
        else:
            every = max(1, self.size // fit_songs)
            sample = base.where(F.pmod(F.xxhash64("video_id"), F.lit(every)) == 0).orderBy(F.xxhash64("video_id"), "video_id").toArrow()
            self.centres = centres = clusters_of(vectors(sample.column("embedding"), kind), self.n_coarse)
            self.n_coarse = len(centres)

            def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
                for b in batches:
                    sims = vectors(b.column(1), kind) @ centres.T
                    of = sims.argmax(axis=1).astype(np.int32)
                    yield pa.RecordBatch.from_arrays([*b.columns, pa.array(of), pa.array(sims[np.arange(len(of)), of])],
                                                     ["video_id", "embedding", "coarse", "near"])

            placed = materialise(base.mapInArrow(place, f"video_id {self.id_type}, embedding binary, coarse int, near double"), "placed-songs")
            stats = {r.coarse: r for r in placed.groupBy("coarse").agg(F.count("*").alias("n"), F.min("near").alias("least")).collect()}
            self.counts = np.array([stats[i].n if i in stats else 0 for i in range(self.n_coarse)])
            self.least = np.array([stats[i].least - SLACK if i in stats else 1.0 for i in range(self.n_coarse)])
            sizes = F.array(*[F.lit(int(-(-n // chunk_songs))) for n in self.counts])
            placed = placed.drop("near").withColumn("_parts", F.greatest(sizes[F.col("coarse")], F.lit(1)))
        parts = F.col("_parts") if self.n_coarse > 1 else F.lit(1)
        self.parts = np.ones(1, int) if self.counts is None else np.maximum(1, -(-self.counts // chunk_songs))
        placed = placed.select("video_id", "embedding", "coarse", F.pmod(F.xxhash64("video_id"), parts).cast("int").alias("part"))
        if self.n_coarse > 1:
            ids = base.select(F.lit(0).alias("_all"), "video_id").distinct()
            known = numbered(ids.where("video_id is not null"), "_all", ["video_id"], "_n").select(F.col("video_id").alias("_v"), (F.col("_n") - 1).alias("place"))
            null = ids.where("video_id is null").select(F.col("video_id").alias("_v"), F.lit(self.size).cast("long").alias("place"))      # after all others
            self.places = materialise(known.unionByName(null), "song-places")
            placed = placed.join(self.places, F.col("video_id").eqNullSafe(F.col("_v"))).drop("_v")
        self.songs = materialise(placed, "metric-index")

    # -- search -----------------------------------------------------------------------------

    def top_items(self, sessions: DataFrame, k: int, marks: DataFrame | None = None, block_sessions: int = BLOCK_SESSIONS,
                  weight: float = 1.0, scored: Accumulator | None = None, shared: tuple[DataFrame, DataFrame] | None = None) -> DataFrame:
        """``(session_id, video_id, score, bonus, total, rank)``: the ``k`` songs of each session of
        ``sessions(session_id, vector)`` with the highest ``total`` = cosine + ``weight`` * bonus, ties by id.

        ``marks(session_id, video_id, excluded, bonus)``: songs that are left out, or whose cosine is
        raised or lowered. Of several marks of a song one that excludes it wins, and bonuses add up;
        marks need not be distinct. ``shared``: ``(session_id, owner)`` and ``(owner, video_id)``, songs
        that every session of an owner leaves out. Ids are of any orderable type."""
        q = sessions.select("session_id", F.col("vector").cast("array<double>").alias("vector"))
        s_type = q.schema["session_id"].dataType.simpleString()
        q = V.packed(q, "vector")
        small, large = (F.ceil(F.count(F.lit(1)) / F.lit(n)) for n in (block_sessions, block_sessions * LARGE_BLOCK))
        n_blocks = sessions.agg(F.greatest(F.least(small, F.greatest(large, F.lit(MANY_BLOCKS if self.n_coarse == 1 else STREAM_BLOCKS))), F.lit(1)).cast("int")).scalar()
        block = F.pmod(F.xxhash64("session_id"), n_blocks).cast("int")
        lists = self._lists(q, marks, shared)
        if self.n_coarse > 1:
            return self._streamed(q, lists, block, n_blocks, _block_fn(k, weight, self.fine_songs, scored, self.kind, V.gap_type(self.size)), s_type)
        # one place for all songs: a session's list is whole in its cell
        whole = q.select("session_id", "vector", F.lit(0).alias("coarse"), F.lit(-2.0).alias("floor"), F.lit(True).alias("scan"))
        return self._search(whole, lists, block, n_blocks, _cell_fn(k, weight, self.fine_songs, scored, self.kind, V.gap_type(self.size)), s_type)

    def _lists(self, q: DataFrame, marks: DataFrame | None, shared: tuple[DataFrame, DataFrame] | None) -> DataFrame:
        """``(session_id, coarse, part, places, bonus)``: the marked songs of a session as the gaps between
        their places (of several clusters: in the order of all ids), and their bonuses; excluded ones have none."""
        if self.n_coarse > 1:
            places = self.places.select("_v", F.lit(0).alias("coarse"), F.lit(0).alias("part"), "place")
        else:
            at = Window.partitionBy("coarse", "part").orderBy(F.asc_nulls_last("video_id"))
            places = self.songs.select(F.col("video_id").alias("_v"), "coarse", "part", (F.rank().over(at) - 1).alias("place")).distinct()
        cell, gap = ["coarse", "part"], V.gap_type(self.size)

        def placed(rows: DataFrame, key: str) -> DataFrame:
            # dealt once by key, so that the rows and not the lists of the partial aggregates travel
            return rows.join(places, F.col("video_id").eqNullSafe(F.col("_v"))).drop("video_id", "_v").repartition(key)

        def left_out(rows: DataFrame, key: str) -> DataFrame:
            return V.packed_places(placed(rows.select(key, "video_id"), key).groupBy(key, *cell).agg(F.array_sort(F.collect_set("place")).alias("places")), "places", gap)

        none = F.lit(None).cast("binary").alias("bonus")
        out = q.select("session_id", F.lit(0).alias("coarse"), F.lit(0).alias("part"), F.lit(None).cast("binary").alias("places"), none).where(F.lit(False))
        if marks is not None:
            marks = marks.select("session_id", "video_id", F.coalesce("excluded", F.lit(False)).alias("excluded"), F.coalesce("bonus", F.lit(0.0)).alias("bonus"))
            out = left_out(marks.where("excluded"), "session_id").select("session_id", *cell, "places", none)
            sums = placed(marks.where("not excluded").select("session_id", "video_id", "bonus"), "session_id").groupBy("session_id", *cell, "place").agg(F.sum("bonus").alias("b"))
            raised = sums.groupBy("session_id", *cell).agg(F.array_sort(F.collect_list(F.struct("place", "b"))).alias("l")).select("session_id", *cell, F.col("l.place").alias("places"), F.col("l.b").alias("bonus"))
            out = out.unionByName(V.packed(V.packed_places(raised, "places", gap), "bonus"))
        if shared is not None:
            links, owned = shared
            lists = left_out(owned, "owner")
            out = out.unionByName(links.select("session_id", "owner").distinct().join(lists, "owner").select("session_id", *cell, "places", none))
        return out

    def _streamed(self, q: DataFrame, lists: DataFrame, block: Column, n_blocks: Column, run, s_type: str) -> DataFrame:
        """Top lists of every block of sessions: its vectors, its lists, then all songs, chunk by chunk."""
        def rows(df: DataFrame, kind: int, block: Column, **given) -> DataFrame:
            cols = {"coarse": "int", "part": "int", "place": "long", "session_id": s_type, "video_id": self.id_type, "data": "binary", "bonus": "binary"}
            return df.select(block.alias("block"), F.lit(kind).alias("kind"), *[given.get(c, F.lit(None)).cast(t).alias(c) for c, t in cols.items()])

        c = F.col
        left = rows(q.where("vector is not null"), 0, block, session_id=c("session_id"), data=c("vector"))
        left = left.unionByName(rows(lists, 1, block, session_id=c("session_id"), data=c("places"), bonus=c("bonus")))
        songs = self.songs.withColumn("_block", F.explode(F.sequence(F.lit(0), n_blocks - 1)))
        right = rows(songs, 2, c("_block"), coarse=c("coarse"), part=c("part"), place=c("place"), video_id=c("video_id"), data=c("embedding"))
        parts = max(STREAM_PARTS, int(q.sparkSession.conf.get("spark.sql.shuffle.partitions")))
        dealt = left.unionByName(right).repartition(parts, "block").sortWithinPartitions("block", "kind", "coarse", "part", "place")
        return dealt.mapInArrow(run, f"session_id {s_type}, video_id {self.id_type}, score double, bonus double, total double, rank int")

    def _search(self, visits: DataFrame, marks: DataFrame, block: Column, n_blocks: Column, cell, s_type: str) -> DataFrame:
        """Top lists of every (coarse cluster, part, block of sessions)."""
        parts = F.array(*[F.lit(int(n)) for n in self.parts])
        spread = visits.withColumn("part", F.explode(F.sequence(F.lit(0), parts[F.col("coarse")] - 1)))
        # one number names a cell: a single key is sorted by radix
        of = lambda block: ((F.col("coarse") * int(self.parts.max()) + F.col("part")) * n_blocks.cast("long") + block).alias("cell")
        left = spread.select(of(block), "session_id", "vector", "floor", "scan", F.lit(None).cast("binary").alias("places"), F.lit(None).cast("binary").alias("bonus"))
        left = left.unionByName(marks.select(of(block), "session_id", F.lit(None).cast("binary").alias("vector"), F.lit(None).cast("double").alias("floor"),
                                             F.lit(None).cast("boolean").alias("scan"), "places", "bonus"))
        right = self.songs.select("*", F.explode(F.sequence(F.lit(0), n_blocks - 1)).alias("block")).select(of(F.col("block")), "video_id", "embedding")
        out = f"session_id {s_type}, video_id {self.id_type}, score double, bonus double, total double, rank int"
        return left.groupBy("cell").cogroup(right.groupBy("cell")).applyInArrow(cell, out)


def _cell_fn(k: int, weight: float, fine_songs: int, scored: Accumulator | None, kind: str = "float64", gap: str = "uint8"):
    def run(left: pa.Table, songs: pa.Table) -> pa.Table:
        ids = [left.schema.field("session_id").type, songs.schema.field("video_id").type]
        names = ["session_id", "video_id", "score", "bonus", "total", "rank"]
        is_session = pc.is_valid(left.column("vector"))
        q, m = left.filter(is_session), left.filter(pc.invert(is_session))
        if not q.num_rows or not songs.num_rows:
            return pa.table([pa.array([], t) for t in [*ids, *[pa.float64()] * 3, pa.int32()]], names)
        q = q.sort_by([("scan", "descending")])
        songs = songs.sort_by("video_id")      # position order is id order
        qv, iv = vectors(q.column("vector")), vectors(songs.column("embedding"), kind)
        who, what = q.column("session_id").combine_chunks(), songs.column("video_id").combine_chunks()
        scan = q.column("scan").to_numpy(zero_copy_only=False).astype(bool)
        floor = q.column("floor").to_numpy()
        # a session can stand here twice: to be scanned, and for its songs with a bonus; the first counts
        mi = pc.index_in(m.column("session_id"), value_set=who).combine_chunks()
        m, mi = m.filter(pc.is_valid(mi)), mi.drop_null().to_numpy().astype(np.int64)
        lists, bonuses = m.column("places").combine_chunks(), m.column("bonus").combine_chunks()
        mj, sizes = V.list_places(lists, gap)
        mi = np.repeat(mi, sizes)
        excluded = np.repeat(pc.is_null(bonuses).to_numpy(zero_copy_only=False).astype(bool), sizes)
        bonus = np.zeros(len(mj))
        bonus[~excluded] = _values(bonuses.drop_null(), np.float64)
        gi, gj, gs, work = _scan(qv[scan], floor[scan], iv, mi, mj, k, fine_songs)
        if scored is not None:
            scored.add(work)
        # one entry per marked pair: excluded if any mark says so, else the sum of its bonuses
        gone, nudged = (mi[x] * len(iv) + mj[x] for x in (excluded, ~excluded))
        stay = ~np.isin(nudged, gone)
        raised, at = np.unique(nudged[stay], return_inverse=True)
        bi, bj, bb = raised // len(iv), raised % len(iv), np.bincount(at, bonus[~excluded][stay], len(raised))
        bs = np.round(np.einsum("ij,ij->i", qv[bi], iv[bj]), DECIMALS)
        i, j, s = np.concatenate([gi, bi]), np.concatenate([gj, bj]), np.concatenate([gs, bs])
        extra = np.concatenate([np.zeros(len(gi)), bb])
        total = s + weight * extra
        order = np.lexsort((j, -total, i))
        i, j, s, extra, total = i[order], j[order], s[order], extra[order], total[order]
        start = np.searchsorted(i, i)
        rank = (np.arange(len(i)) - start + 1).astype(np.int32)
        keep = rank <= k
        i, j = pa.array(i[keep]), pa.array(j[keep])
        return pa.table([who.take(i), what.take(j), pa.array(s[keep]), pa.array(extra[keep]), pa.array(total[keep]), pa.array(rank[keep])], names)

    return run


def _values(packed: pa.Array, dtype) -> np.ndarray:
    """The values of packed lists, one list after the other."""
    if not len(packed):
        return np.zeros(0, dtype)
    ends = np.frombuffer(packed.buffers()[1], np.int32, len(packed) + 1, packed.offset * 4)
    if ends[-1] == ends[0]:
        return np.zeros(0, dtype)
    return np.frombuffer(packed.buffers()[2], np.uint8, int(ends[-1] - ends[0]), int(ends[0])).view(dtype)


def _scan(q: np.ndarray, floor: np.ndarray, songs: np.ndarray, mi: np.ndarray, mj: np.ndarray, k: int, fine_songs: int):
    """Top ``k`` unmarked songs of every row of ``q`` at ``floor`` or above, as (row, song, score), and
    the number of pairs that were scored."""
    n = len(songs)
    centres = clusters_of(songs, max(1, n // fine_songs), 4) if n > 2 * fine_songs else unit_rows(songs.mean(axis=0, keepdims=True))
    of = (songs @ centres.T).argmax(axis=1)
    order = np.argsort(of, kind="stable")
    sizes = np.bincount(of, minlength=len(centres))
    ends = np.cumsum(sizes)
    members = [order[e - s:e] for s, e in zip(sizes, ends)]
    least = np.array([(songs[x] @ centres[c]).min() if len(x) else 1.0 for c, x in enumerate(members)]) - SLACK
    by_row = np.argsort(mi, kind="stable")
    mi, mj = mi[by_row], mj[by_row]
    out, work = [], 0
    for lo in range(0, len(q), SUB_SESSIONS):
        v = q[lo:lo + SUB_SESSIONS]
        a, b = np.searchsorted(mi, [lo, lo + len(v)])
        row, gone = mi[a:b] - lo, mj[a:b]
        taken = np.zeros((len(v), len(centres)), np.int64)
        np.add.at(taken, (row, of[gone]), 1)
        bounds = upper_bounds(v, centres, least)
        todo = first_visits(bounds, np.maximum(sizes - taken, 0), np.full(len(v), k))
        seen = np.zeros_like(todo)
        sims = np.full((len(v), n), -np.inf)
        while todo.any():
            for c in np.flatnonzero(todo.any(axis=0)):
                at = np.flatnonzero(todo[:, c])
                if len(members[c]):
                    sims[np.ix_(at, members[c])] = np.round(v[at] @ songs[members[c]].T, DECIMALS)
                    work += len(at) * len(members[c])
            sims[row, gone] = -np.inf
            seen |= todo
            kth = np.partition(sims, n - k, axis=1)[:, n - k] if k < n else np.full(len(v), -np.inf)
            # the second time nothing is left: the k-th score has not fallen since
            todo = ~seen & (bounds >= np.maximum(kth, floor[lo:lo + len(v)])[:, None])
        for i in range(len(v)):
            s = sims[i]
            best = np.flatnonzero(s > kth[i])
            if k < n and kth[i] > -np.inf:
                best = np.concatenate([best, np.flatnonzero(s == kth[i])[:k - len(best)]])
            out.append((np.full(len(best), lo + i), best, s[best]))
    if not out:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0), 0
    return (*(np.concatenate(x) for x in zip(*out)), work)


# -- chunks that pass by ------------------------------------------------------------------------

def _block_fn(k: int, weight: float, fine_songs: int, scored: Accumulator | None, kind: str, gap: str):
    """The sorted rows of blocks: sessions, their lists, songs chunk by chunk. One block and chunk are held."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, chunk, work = None, None, 0
        sessions, lists, songs, best = [], [], [], None

        def scan() -> None:
            nonlocal best, songs, work
            if songs and sessions:
                best = best or _Best(sessions, lists, k, weight, gap)
                work += best.add(pa.Table.from_batches(songs), fine_songs, kind)
            songs = []

        for batch in batches:
            keys = np.stack([pc.fill_null(batch.column(c), -1).to_numpy().astype(np.int64) for c in ("block", "kind", "coarse", "part")], axis=1)
            cuts = np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1)) + 1
            for a, b in zip(np.append(0, cuts), np.append(cuts, len(keys))):
                if b == a:
                    continue
                at, part = tuple(keys[a]), batch.slice(a, b - a)
                if at != chunk:
                    scan()
                    chunk = at
                if at[0] != block:
                    if best is not None:
                        yield from best.rows()
                    block, sessions, lists, best = at[0], [], [], None
                (sessions, lists, songs)[at[1]].append(part)
        scan()
        if best is not None:
            yield from best.rows()
        if scored is not None:
            scored.add(work)

    return run


class _Best:
    """The ``k`` best songs so far of every session of a block, in order."""

    def __init__(self, sessions: list[pa.RecordBatch], lists: list[pa.RecordBatch], k: int, weight: float, gap: str):
        q = pa.Table.from_batches(sessions)
        self.who, self.k, self.weight = q.column("session_id").combine_chunks(), k, weight
        self.q = vectors(q.column("data"))
        self.q32 = self.q.astype(np.float32)
        self.eps = (self.q.shape[1] + 8) * 1.2e-7      # more than a product of 4-byte numbers can be off
        n = len(self.q)
        self.total, self.score, self.bonus = np.full((n, k), -np.inf), np.zeros((n, k)), np.zeros((n, k))
        self.song = np.full((n, k), -1, np.int64)      # counts the songs of all chunks that passed
        self.places, self.names = np.zeros(0, np.int64), []
        self._mark(pa.Table.from_batches(lists) if lists else None, gap)

    def _mark(self, m: pa.Table | None, gap: str) -> None:
        """Marked pairs by session: excluded if any mark says so, else the sum of their bonuses."""
        self.gone = self.raised = (np.zeros(0, np.int64), np.zeros(0, np.int64))
        self.nudge = np.zeros(0)
        if m is None:
            return
        of = pc.index_in(m.column("session_id"), value_set=self.who).combine_chunks()
        m, of = m.filter(pc.is_valid(of)), of.drop_null().to_numpy().astype(np.int64)
        lists, bonuses = m.column("data").combine_chunks(), m.column("bonus").combine_chunks()
        if not len(lists):
            return
        place, sizes = V.list_places(lists, gap)
        excluded = np.repeat(pc.is_null(bonuses).to_numpy(zero_copy_only=False).astype(bool), sizes)
        span = int(place.max(initial=0)) + 1
        key = np.repeat(of, sizes) * span + place
        gone = np.unique(key[excluded])
        raised, at = np.unique(key[~excluded], return_inverse=True)
        nudge = np.bincount(at, _values(bonuses.drop_null(), np.float64), len(raised))
        stay = ~np.isin(raised, gone)
        self.gone, self.raised, self.nudge = np.divmod(gone, span), np.divmod(raised[stay], span), nudge[stay]

    def add(self, songs: pa.Table, fine_songs: int, kind: str) -> int:
        """A chunk, sorted by place; the number of pairs that were scored."""
        place, base = songs.column("place").to_numpy(), len(self.places)
        self.places = np.concatenate([self.places, place])
        self.names.append(songs.column("video_id").combine_chunks())
        s = vectors(songs.column("data"), kind)
        n = len(s)
        centres = clusters_of(s, max(1, n // fine_songs), 4) if n > 2 * fine_songs else unit_rows(s.mean(axis=0, keepdims=True))
        of = (s @ centres.T).argmax(axis=1)
        order = np.argsort(of, kind="stable")      # a cluster's songs are side by side
        s, of = s[order], of[order]
        sizes = np.bincount(of, minlength=len(centres))
        ends = np.cumsum(sizes)
        near = np.einsum("ij,ij->i", s, centres[of])
        least = np.ones(len(centres))
        np.minimum.at(least, of, near)
        least = np.where(sizes > 0, least - SLACK, 1.0)
        s32, back = s.astype(np.float32), np.argsort(order)

        def here(pairs: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
            """Session, song of this chunk and number of the marked pairs; a place can have several songs."""
            lo, hi = (np.searchsorted(place, pairs[1], side) for side in ("left", "right"))
            times = hi - lo
            which = np.repeat(np.arange(len(lo)), times)
            at = np.arange(len(which)) - np.repeat(np.cumsum(times) - times, times) + lo[which]
            return pairs[0][which], back[at], which

        gi, gj, _ = here(self.gone)
        ri, rj, which = here(self.raised)
        nudge, work = self.nudge[which], 0
        for lo in range(0, len(self.q), STREAM_ROWS):
            hi = min(lo + STREAM_ROWS, len(self.q))
            (a, b), (c, d) = np.searchsorted(gi, [lo, hi]), np.searchsorted(ri, [lo, hi])
            row, gone = np.concatenate([gi[a:b], ri[c:d]]) - lo, np.concatenate([gj[a:b], rj[c:d]])
            i, j, scored = self._plain(lo, hi, s32, centres, least, sizes, ends, of, row, gone)
            work += scored
            score = np.round(np.einsum("ij,ij->i", self.q[lo + i], s[j]), DECIMALS)
            bi, bj = ri[c:d] - lo, rj[c:d]
            raised = np.round(np.einsum("ij,ij->i", self.q[ri[c:d]], s[bj]), DECIMALS)
            bonus = np.concatenate([np.zeros(len(i)), nudge[c:d]])
            i, j, score = np.concatenate([i, bi]), np.concatenate([j, bj]), np.concatenate([score, raised])
            self._merge(lo, hi, i, base + order[j], score, bonus)
        return work

    def _plain(self, lo, hi, s32, centres, least, sizes, ends, of, row, gone):
        """Unmarked songs that can be among the best, as (session, song), and the number of pairs scored."""
        q, n, k = self.q32[lo:hi], len(s32), self.k
        kth = self.total[lo:hi, -1]
        bounds = upper_bounds(self.q[lo:hi], centres, least)
        todo = bounds >= kth[:, None]
        new = np.flatnonzero(kth == -np.inf)
        if len(new):
            taken = np.zeros((len(q), len(centres)), np.int64)
            np.add.at(taken, (row, of[gone]), 1)
            todo[new] = first_visits(bounds[new], np.maximum(sizes - taken[new], 0), np.full(len(new), k))
        seen, work = np.zeros_like(todo), 0
        sims = np.full((len(q), n), -np.inf, np.float32)
        low = kth - self.eps
        while todo.any():
            if todo.all():
                np.matmul(q, s32.T, out=sims)
            else:
                for c in np.flatnonzero(todo.any(axis=0)):
                    at, cut = np.flatnonzero(todo[:, c]), slice(ends[c] - sizes[c], ends[c])
                    sims[at, cut] = q[at] @ s32[cut].T
            work += int((todo * sizes).sum())
            sims[row, gone] = -np.inf
            seen |= todo
            if len(new) and k < n:
                low[new] = np.partition(sims[new], n - k, axis=1)[:, n - k] - 2 * self.eps
            todo = ~seen & (bounds >= np.maximum(kth, low)[:, None])
            todo[np.setdiff1d(np.arange(len(q)), new)] = False
        i, j = np.nonzero((sims >= low[:, None].astype(np.float32)) & (sims > -np.inf))
        return i, j, work

    def _merge(self, lo, hi, i, song, score, bonus) -> None:
        total = score + self.weight * bonus
        old_i, old_r = np.nonzero(self.song[lo:hi] >= 0)
        held = lo + old_i, old_r
        i, song = np.concatenate([old_i, i]), np.concatenate([self.song[held], song])
        score, bonus, total = (np.concatenate([x[held], y]) for x, y in ((self.score, score), (self.bonus, bonus), (self.total, total)))
        order = np.lexsort((self.places[song], -total, i))
        rank = np.arange(len(order)) - np.searchsorted(i[order], i[order])
        order, rank = order[rank < self.k], rank[rank < self.k]
        to = lo + i[order], rank
        self.song[to], self.score[to], self.bonus[to], self.total[to] = song[order], score[order], bonus[order], total[order]

    def rows(self) -> Iterator[pa.RecordBatch]:
        names, step = pa.concat_arrays(self.names), max(1, BATCH_ROWS // self.k)
        for lo in range(0, len(self.q), step):
            i, r = np.nonzero(self.song[lo:lo + step] >= 0)
            at = lo + i, r
            yield pa.RecordBatch.from_arrays([self.who.take(pa.array(at[0])), names.take(pa.array(self.song[at])),
                                              pa.array(self.score[at]), pa.array(self.bonus[at]), pa.array(self.total[at]), pa.array((r + 1).astype(np.int32))],
                                             ["session_id", "video_id", "score", "bonus", "total", "rank"])
