"""Song vectors (P13, P14) and their incremental load.

A song's vector is its text in ``TEXT_DIMS`` dimensions and its duration and popularity, scaled to
0..1 over the batch of new songs. The text encoder is signed feature hashing of the sentence (P12)
with Spark's own functions; an encoder of another kind can give the text part instead.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cadence.functions import scalars as S
from cadence.operators import sinks
from cadence.operators.sessions import catalog_rows
from cadence.session import materialise

TEXT_DIMS = 384


def token_dim(token: Column, dims: int = TEXT_DIMS) -> Column:
    """The dimension of a token: the first 32 bits of its MD5."""
    return F.pmod(F.conv(F.substring(F.md5(token.cast("binary")), 1, 8), 16, 10).cast("long"), F.lit(dims)).cast("int")


def token_sign(token: Column) -> Column:
    """1 or -1 by the next bit: tokens that share a dimension cancel as often as they add."""
    return F.when(F.substring(F.md5(token.cast("binary")), 9, 1).isin(*"01234567"), 1.0).otherwise(-1.0)


def hashed_text(songs: DataFrame, key: str = "video_id", text: str = "sentence", dims: int = TEXT_DIMS) -> DataFrame:
    """``(key, text_vector)``: the unit vector of the signed counts of a text's words; a text without
    words has the zero vector. Words are counted per dimension before they become arrays."""
    words = songs.select(key, F.explode_outer(F.filter(F.split(F.col(text), " "), lambda w: w != "")).alias("w"))
    cells = words.groupBy(key, token_dim(F.col("w"), dims).alias("d")).agg(F.sum(token_sign(F.col("w"))).alias("x"))
    by_dim = cells.groupBy(key).agg(F.map_from_entries(F.collect_list(F.when(F.col("d").isNotNull(), F.struct("d", "x")))).alias("m"),
                                    F.sqrt(F.sum(F.when(F.col("d").isNotNull(), F.col("x") * F.col("x")))).alias("n"))
    length = F.when(F.col("n") > 0, F.col("n")).otherwise(1.0)
    # bound once: the array is long and what reads it takes it apart
    dense = F.transform(F.array(length), lambda n: F.transform(F.sequence(F.lit(0), F.lit(dims - 1)), lambda d: F.coalesce(F.try_element_at("m", d), F.lit(0.0)) / n))
    return by_dim.select(key, F.get(dense, F.lit(0)).alias("text_vector"))


def scaled(df: DataFrame, column: str) -> Column:
    """A column scaled to 0..1 over the frame; 0 everywhere if it is constant. A missing value is 0."""
    x = F.coalesce(F.col(column).cast("double"), F.lit(0.0))
    lo, hi = df.agg(F.min(x)).scalar(), df.agg(F.max(x)).scalar()
    return F.when(hi > lo, (x - lo) / (hi - lo)).otherwise(0.0)


def song_vectors(songs: DataFrame, encoder: Callable[[DataFrame], DataFrame] = hashed_text) -> DataFrame:
    """``songs`` with ``embedding`` (text dimensions, duration, popularity) over this batch.

    ``songs(video_id, track_title, artist_name, genre, collection_name, duration_sec,
    popularity_score)``, one row per id; ``encoder`` maps (video_id, sentence) to (video_id,
    text_vector)."""
    batch = materialise(songs.withColumn("sentence", S.song_sentence("track_title", "artist_name", "genre", "collection_name")), "new-songs")
    text = encoder(batch.select("video_id", "sentence"))
    numbers = F.array(scaled(batch, "duration_sec"), scaled(batch, "popularity_score"))
    out = batch.join(text, "video_id").withColumn("embedding", F.concat("text_vector", numbers)).drop("text_vector", "sentence")
    return materialise(out, "song-vectors")


def new_song_rows(songs: DataFrame, catalog: DataFrame, encoder: Callable[[DataFrame], DataFrame] = hashed_text) -> DataFrame:
    """P13 + P14 + S11: the catalog rows of the songs that ``catalog`` does not hold, scaled over
    them alone."""
    return catalog_rows(song_vectors(sinks.new_catalog_rows(songs, catalog.select("video_id")), encoder))


def load_songs(songs: DataFrame, catalog: DataFrame, path: str) -> None:
    """Append the vectors of new songs to the catalog at ``path``."""
    new_song_rows(songs, catalog).write.mode("append").parquet(path)
