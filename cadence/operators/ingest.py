"""Batch session ingest: P1-P4 derivation, F1 validation routing, F2 tags, J1 / J2 lookups,
W4 first-row dedupe and P6-P11 preprocessing. One pass adds an ``error`` column; valid and
invalid outputs are two filters of the same frame (a caller that needs both writes it first)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cadence.functions import scalars as S

# Fixed column order of a valid track (the reference's COLUMNS).
COLUMNS = [
    "playlist_name", "track_title", "artist_name", "video_id", "genre",
    "country", "collection_name", "collection_id", "trackTimeMillis",
    "trackTimeSeconds", "view_count", "like_count", "comment_count",
    "like_to_view_ratio", "comment_to_view_ratio",
]
SONG_INPUTS = ["track_title", "artist_name", "genre", "collection_name", "country", "trackTimeMillis", "view_count", "like_count",
               "comment_count", "like_to_view_ratio", "comment_to_view_ratio"]
# Error text as the reference's tagger raises it.
ERR_NONE_STRIP = "'NoneType' object has no attribute 'strip'"


def derive_fields(raw: DataFrame) -> DataFrame:
    """Lenient millis, seconds, lenient counts, engagement ratios."""
    number = F.col("_millis_number")      # parsed once
    return (raw
            .withColumn("_millis_number", S.py_float("trackTimeMillis"))
            .withColumn("_millis_err", S.millis_error("trackTimeMillis", number))
            .withColumn("trackTimeMillis", S.lenient_millis("trackTimeMillis", number)).drop("_millis_number")
            .withColumn("trackTimeSeconds", S.seconds_from_millis("trackTimeMillis"))
            .withColumn("view_count", S.lenient_int("view_count"))
            .withColumn("like_count", S.lenient_int("like_count"))
            .withColumn("comment_count", S.lenient_int("comment_count"))
            .withColumn("like_to_view_ratio", S.safe_ratio("like_count", "view_count"))
            .withColumn("comment_to_view_ratio", S.safe_ratio("comment_count", "view_count")))


def anomaly_tags(df: DataFrame) -> DataFrame:
    """zero_views, negative_stats, unknown_genre, empty_title, missing_video_id (logged only)."""
    tags = F.array(
        F.when(F.col("view_count") == 0, F.lit("zero_views")),
        F.when((F.col("like_count") < 0) | (F.col("comment_count") < 0), F.lit("negative_stats")),
        F.when(F.col("genre").isNull() | F.col("genre").isin("", "Unknown"), F.lit("unknown_genre")),
        F.when(S.py_strip(F.col("track_title")) == "", F.lit("empty_title")),
        F.when(S.py_strip(F.col("video_id")) == "", F.lit("missing_video_id")))
    return df.withColumn("anomalies", F.array_compact(tags))


def validate(raw: DataFrame) -> DataFrame:
    """derive, require the columns (always present in a typed frame), tag, and give each
    row an ``error`` (null = valid). A null title / video id fails like the reference's tagger.
    ``raw_record`` keeps the record as it came, for the rejected rows."""
    d = anomaly_tags(derive_fields(raw.withColumn("raw_record", F.struct(*raw.columns))))
    err = (F.when(F.col("_millis_err").isNotNull(), F.col("_millis_err"))
           .when(F.col("track_title").isNull() | F.col("video_id").isNull(), F.lit(ERR_NONE_STRIP)))
    return d.withColumn("error", err).drop("_millis_err")


def valid_tracks(validated: DataFrame, keep=("session_id",)) -> DataFrame:
    """S3 input: valid rows in the fixed column order."""
    return validated.where(F.col("error").isNull()).select(*keep, *COLUMNS)


def invalid_tracks(validated: DataFrame, keep=("session_id",)) -> DataFrame:
    """S4 input: (error, record_json) of the rejected rows; the whole record as it came, nulls
    and unparsed fields included."""
    return (validated.where(F.col("error").isNotNull())
            .select(*keep, "error", F.to_json("raw_record", {"ignoreNullFields": "false"}).alias("record_json")))


# ---- J1: statistics lookup ----------------------------------------------------------

def join_video_stats(tracks: DataFrame, stats: DataFrame) -> DataFrame:
    """Left join on video_id; missing statistics -> 0."""
    s = stats.select("video_id", *[F.col(c).alias(f"_s_{c}") for c in ("view_count", "like_count", "comment_count")])
    out = tracks.join(s, "video_id", "left")
    for c in ("view_count", "like_count", "comment_count"):
        out = out.withColumn(c, F.coalesce(F.col(f"_s_{c}").cast("long"), F.lit(0).cast("long"))).drop(f"_s_{c}")
    return out


# ---- J2: metadata lookup by cleaned title, with fallback -------------------------------

def join_metadata(tracks: DataFrame, metadata: DataFrame) -> DataFrame:
    """Look up the attributes once per distinct (title, artist): first by 'clean title +
    artist', then by clean title; missing -> genre 'Unknown', others ''. ``metadata``: (term,
    genre, country, collection_name, collection_id, found_artist, found_millis), one row per
    search term. Null titles and artists are looked up like any other (null-safe join back)."""
    attrs = ["genre", "country", "collection_name", "collection_id", "found_artist", "found_millis"]
    keys = (tracks.select("track_title", "artist_name").distinct()
            .withColumn("_clean", S.clean_search_title("track_title"))
            .withColumn("_t1", S.py_strip(F.concat_ws(" ", F.col("_clean"), F.coalesce("artist_name", F.lit(""))))))
    m1 = metadata.select(F.col("term").alias("_t1"), *[F.col(a).alias(f"_a_{a}") for a in attrs])
    m2 = metadata.select(F.col("term").alias("_clean"), *[F.col(a).alias(f"_b_{a}") for a in attrs])
    hit1 = F.col("_a_genre").isNotNull()
    resolved = keys.join(m1, "_t1", "left").join(m2, "_clean", "left").select(
        "track_title", "artist_name",
        *[F.coalesce(F.when(hit1, F.col(f"_a_{a}")).otherwise(F.col(f"_b_{a}")),
                     F.lit("Unknown" if a == "genre" else "")).alias(a) for a in attrs])
    base = tracks.drop(*[a for a in attrs if a in tracks.columns])
    r = resolved.withColumnsRenamed({"track_title": "_rt", "artist_name": "_ra"})
    on = F.col("track_title").eqNullSafe(F.col("_rt")) & F.col("artist_name").eqNullSafe(F.col("_ra"))
    return base.join(r, on, "left").drop("_rt", "_ra")


# ---- W4 + P6-P11: song preprocessing ---------------------------------------------------

def first_per_key(df: DataFrame, key, order_cols) -> DataFrame:
    """Keep the first row per key in an explicit input order.

    ``min_by`` over a struct is a partially aggregated reduction, so a key holding a large
    share of the rows is reduced on the map side instead of being sorted in one task."""
    keys = [key] if isinstance(key, str) else list(key)
    others = [c for c in df.columns if c not in keys]
    return (df.groupBy(*keys)
            .agg(F.min_by(F.struct(*others), F.struct(*[F.col(c) for c in order_cols])).alias("_r"))
            .select(*keys, "_r.*").select(*df.columns))


def preprocess_songs(tracks: DataFrame, order_cols, dataset_key: str = "session_id") -> DataFrame:
    """P6-P11 after W4: dedupe by video_id, fill categorical nulls, clean texts, coerce
    numerics, duration_sec, recompute zero ratios, popularity by min-max within the dataset."""
    # only what the songs need is moved: not the record as it came, nor the tags
    needed = [dataset_key, "video_id", *SONG_INPUTS, *[c for c in order_cols if c not in SONG_INPUTS]]
    df = first_per_key(tracks.select(*needed), [dataset_key, "video_id"], order_cols)
    for c in ("track_title", "artist_name", "genre", "collection_name", "country"):
        df = df.withColumn(c, S.fill_unknown(c))
    for c in ("track_title", "artist_name", "genre", "collection_name"):
        df = df.withColumn(c, S.clean_text(c))
    for c in ("trackTimeMillis", "view_count", "like_count", "comment_count",
              "like_to_view_ratio", "comment_to_view_ratio"):
        df = df.withColumn(c, S.numeric_or_zero(c))
    df = (df.withColumn("duration_sec", S.duration_seconds("trackTimeMillis"))
          .withColumn("like_to_view_ratio", S.recomputed_ratio("like_to_view_ratio", "like_count", "view_count"))
          .withColumn("comment_to_view_ratio",
                      S.recomputed_ratio("comment_to_view_ratio", "comment_count", "view_count")))
    return with_popularity(df, dataset_key)


def with_popularity(df: DataFrame, dataset_key: str = "session_id") -> DataFrame:
    """0.5·mm(views) + 0.3·mm(likes) + 0.2·mm(comments), min-max within each dataset;
    a constant column contributes 0. Extremes come from a per-key aggregate joined back
    (partial aggregation, no per-key sort)."""
    cols = ("view_count", "like_count", "comment_count")
    ext = df.groupBy(dataset_key).agg(*[f(c).alias(f"_{f.__name__}_{c}") for c in cols for f in (F.min, F.max)])

    def mm(c):
        lo, hi = F.col(f"_min_{c}"), F.col(f"_max_{c}")
        return F.when(hi == lo, F.lit(0.0)).otherwise((F.col(c) - lo) / (hi - lo))

    wv, wl, wc = S.POPULARITY_WEIGHTS
    return (df.join(ext, dataset_key)
            .withColumn("popularity_score", F.lit(wv) * mm("view_count") + F.lit(wl) * mm("like_count")
                        + F.lit(wc) * mm("comment_count"))
            .drop(*[c for c in ext.columns if c != dataset_key]))
