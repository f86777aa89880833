"""A14 without moving a vector per session and member.

A group vector is the weighted mean of its members' unit vectors, and those are sums of songs: with the
norm of a user's vector known, a member of a session is the list of the user's songs and two factors.
The lists travel as gaps between places (mostly two bytes a song) to the block of sessions, where the songs' vectors are
added. Users whose lists would be longer than a vector send the vector, and a catalog of more than
``MAX_SONGS`` songs, which every block would be sent and hold, leaves the work to ``group_vectors``.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cadence.functions import vectors as V
from cadence.operators.means import SLICE_ROWS, _runs
from cadence.operators.numbering import numbered
from cadence.session import materialise

MAX_SONGS = 1_000_000
MAX_BYTES = 400_000_000    # of the songs' vectors
LIST_SONGS = 128           # songs of a user that travel as a list
BLOCK_ROWS = 50_000        # (session, member) rows of a block, on average, but not less than
ROWS_PER_SONG = 25         # this many for each song that the block is sent,
MAX_BLOCK_ROWS = 500_000   # up to this number, if that leaves
FEW_BLOCKS = 8             # so many blocks
LIST_TYPE = "uint16"       # of gaps


def song_places(catalog: DataFrame) -> DataFrame | None:
    """``(video_id, place, embedding)`` with packed vectors, an id's repeats at one place; None if the
    songs are too many."""
    emb = catalog.select("video_id", V.as_double_array("embedding").alias("embedding")).where("video_id is not null and embedding is not null")
    emb = materialise(V.packed(emb, "embedding"), "packed-vectors")
    n, size = emb.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.length("embedding")), F.lit(0))).first()
    if n > MAX_SONGS or size > MAX_BYTES:
        return None
    ids = numbered(emb.select(F.lit(0).alias("_all"), "video_id").distinct(), "_all", ["video_id"], "_n")
    return materialise(emb.join(ids.select("video_id", (F.col("_n") - 1).cast("int").alias("place")), "video_id").select("video_id", "place", "embedding"), "song-places")


def member_lists(prefs: DataFrame, likes: DataFrame, dislikes: DataFrame, songs: DataFrame, list_songs: int | None = None) -> DataFrame:
    """``(user_id, weight, own, other, liked, disliked, vector)`` of ``prefs(user_id, pos, liked_count, neg,
    disliked_count)``: the sum of the liked songs times ``own`` and of the disliked ones times ``other`` is
    the user's unit vector times ``weight``. Long lists are null and the vector is there instead."""
    ids = songs.select("video_id", "place").distinct()

    def lists(rows: DataFrame, name: str) -> DataFrame:
        found = rows.join(ids, "video_id").select("user_id", "place")
        return found.groupBy("user_id").agg(F.sort_array(F.collect_set("place")).alias(name))

    net = F.when(F.col("neg").isNull(), F.col("pos")).otherwise(F.zip_with("pos", "neg", lambda p, n: p - F.lit(0.5) * n))
    norm = V.norm(F.col("net"))
    by = lambda x: F.when(norm > 0, x / norm).otherwise(F.lit(0.0))
    out = prefs.withColumn("net", net).join(lists(likes, "liked"), "user_id").join(lists(dislikes, "disliked"), "user_id", "left")
    short = F.size("liked") + F.coalesce(F.size("disliked"), F.lit(0)) <= (LIST_SONGS if list_songs is None else list_songs)
    weight = F.col("liked_count").cast("double")
    out = out.select("user_id", weight.alias("weight"), by(F.lit(1.0)).alias("own"), by(F.lit(-0.5) * weight / F.col("disliked_count")).alias("other"),
                     F.when(short, F.col("liked")).alias("liked"), F.when(short, F.col("disliked")).alias("disliked"),
                     F.when(~short, V.unit(F.col("net"))).alias("vector"))
    return V.packed(V.packed_places(V.packed_places(out, "liked", LIST_TYPE), "disliked", LIST_TYPE), "vector")


def weighted_means(rows: DataFrame, sessions: DataFrame, n_rows: int, songs: DataFrame, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """``(session_id, vector)`` of the distinct ``sessions(session_id)``: the weighted mean of ``rows(session_id,
    weight, own, other, liked, disliked, vector)``, about ``n_rows``; null for a session without rows, as for
    the session null. Every session is in its block, so nothing is joined to the means."""
    n = max(1, -(-n_rows // max(block_rows, min(ROWS_PER_SONG * songs.count(), MAX_BLOCK_ROWS))), min(FEW_BLOCKS, n_rows // block_rows))
    left = rows.where("session_id is not null").unionByName(sessions.select("session_id"), allowMissingColumns=True)
    left = left.withColumn("_block", F.pmod(F.xxhash64("session_id"), F.lit(n)))
    right = songs.select(F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long"))).alias("_block"), "place", "embedding")
    kind = rows.schema["session_id"].dataType.simpleString()
    return left.groupBy("_block").cogroup(right.groupBy("_block")).applyInArrow(_block_means, f"session_id {kind}, vector array<double>")


def _block_means(rows: pa.Table, songs: pa.Table) -> pa.Table:
    if not rows.num_rows:
        return pa.schema([rows.schema.field("session_id"), ("vector", pa.list_(pa.float64()))]).empty_table()
    at = songs.column("place").to_numpy()
    single = V.matrix(songs.column("embedding"))
    vectors = np.zeros((int(at.max(initial=-1)) + 1, single.shape[1]))
    np.add.at(vectors, at, single)
    rows, key, first = _runs(rows, ["session_id"])
    out = np.zeros((len(first), vectors.shape[1]))
    for name, factor in (("liked", "own"), ("disliked", "other")):
        lists = rows.column(name).combine_chunks()
        there = np.flatnonzero(lists.is_valid().to_numpy(zero_copy_only=False))
        lists, by = lists.drop_null(), rows.column(factor).to_numpy()[there]
        places, sizes = V.list_places(lists, LIST_TYPE)
        of, by = np.repeat(key[there], sizes), np.repeat(by, sizes)
        for lo in range(0, len(of), SLICE_ROWS):
            k = of[lo:lo + SLICE_ROWS]
            head = np.flatnonzero(np.concatenate([[True], k[1:] != k[:-1]]))
            out[k[head]] += np.add.reduceat(vectors[places[lo:lo + SLICE_ROWS]] * by[lo:lo + SLICE_ROWS, None], head, axis=0)
    whole, weight = rows.column("vector").combine_chunks(), rows.column("weight").to_numpy()      # a session itself has none
    there = np.flatnonzero(whole.is_valid().to_numpy(zero_copy_only=False))
    if len(there):
        np.add.at(out, key[there], V.matrix(whole.drop_null()) * weight[there, None])
    total = np.bincount(key, np.nan_to_num(weight))
    asked = np.bincount(key, np.isnan(weight)) > 0
    known = total > 0
    out[known] /= total[known, None]
    ends = np.concatenate([[0], np.cumsum(known)]).astype(np.int32) * out.shape[1]
    empty = pa.array(np.append(~known, False))
    lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32(), mask=empty.to_numpy(zero_copy_only=False)), pa.array(out[known].reshape(-1)))
    return pa.table([rows.take(pa.array(first)).column("session_id"), lists], ["session_id", "vector"]).filter(pa.array(asked))
