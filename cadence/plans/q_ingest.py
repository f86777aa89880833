"""Ingest queries: P1-P12, F1, F2, J1, J2, W4 over the raw-track adapter."""

from __future__ import annotations

from pyspark.sql import functions as F

from cadence.functions import scalars as S
from cadence.operators import ingest as I
from cadence.operators import songs as N
from cadence.plans.adapters import Adapters, with_ctes
from cadence.plans.ingest_adapters import raw_tracks
from cadence.plans.q_recommend import r4, s4
from cadence.plans.registry import register

ORDER = ["src_order", "src_line", "src_part", "src_supp"]


def validated(spark, sf_dir):
    return I.validate(raw_tracks(Adapters(spark, sf_dir)))


@register("p1_p4_derive_fields", with_ctes(["derived"], [], f"""
    SELECT session_id, video_id, trackTimeMillis, trackTimeSeconds, view_count, like_count, comment_count,
           {s4('like_to_view_ratio')} AS like_to_view_ratio, {s4('comment_to_view_ratio')} AS comment_to_view_ratio
    FROM derived"""))
def p1_p4_derive_fields(spark, sf_dir):
    d = I.derive_fields(raw_tracks(Adapters(spark, sf_dir)))
    return d.select("session_id", "video_id", "trackTimeMillis", "trackTimeSeconds", "view_count", "like_count",
                    "comment_count", r4(F.col("like_to_view_ratio")).alias("like_to_view_ratio"),
                    r4(F.col("comment_to_view_ratio")).alias("comment_to_view_ratio"))


@register("f1_route_counts", with_ctes(["derived"], [], """
    SELECT session_id, coalesce(error, 'valid') AS status, count(*) AS n FROM derived GROUP BY ALL"""))
def f1_route_counts(spark, sf_dir):
    v = validated(spark, sf_dir)
    return v.groupBy("session_id", F.coalesce("error", F.lit("valid")).alias("status")).agg(
        F.count(F.lit(1)).alias("n"))


@register("s4_invalid_records", with_ctes(["raw_tracks", "derived"], [], """
    SELECT d.session_id, d.error, r.track_title, r.video_id, r.trackTimeMillis AS millis_text, r.view_count AS views_text,
           count(*) AS n
    FROM derived d JOIN raw_tracks r USING (src_order, src_line, src_part, src_supp) WHERE d.error IS NOT NULL GROUP BY ALL"""))
def s4_invalid_records(spark, sf_dir):
    """What the rejected records hold, read back from their JSON."""
    r = I.invalid_tracks(validated(spark, sf_dir))
    x = F.from_json("record_json", "track_title string, video_id string, trackTimeMillis string, view_count string")
    return (r.select("session_id", "error", x.alias("x")).groupBy(
        "session_id", "error", "x.track_title", "x.video_id", F.col("x.trackTimeMillis").alias("millis_text"),
        F.col("x.view_count").alias("views_text")).agg(F.count(F.lit(1)).alias("n")))


@register("f1_routed_rows", with_ctes(["derived"], [], """
    SELECT session_id, row_id, coalesce(error, 'valid') AS status, count(*) AS n FROM derived GROUP BY ALL"""))
def f1_routed_rows(spark, sf_dir):
    v = validated(spark, sf_dir)
    return v.groupBy("session_id", "row_id", F.coalesce("error", F.lit("valid")).alias("status")).agg(F.count(F.lit(1)).alias("n"))


@register("f2_tagged_rows", with_ctes(["derived"], [("t", """
        SELECT session_id, row_id, concat_ws(',', CASE WHEN view_count = 0 THEN 'zero_views' END,
               CASE WHEN like_count < 0 OR comment_count < 0 THEN 'negative_stats' END,
               CASE WHEN genre IS NULL OR genre IN ('', 'Unknown') THEN 'unknown_genre' END,
               CASE WHEN trim(track_title) = '' THEN 'empty_title' END, CASE WHEN trim(video_id) = '' THEN 'missing_video_id' END) AS tags
        FROM derived WHERE error IS NULL""")], """
    SELECT session_id, row_id, tags, count(*) AS n FROM t GROUP BY ALL"""))
def f2_tagged_rows(spark, sf_dir):
    v = validated(spark, sf_dir).where(F.col("error").isNull())
    return v.groupBy("session_id", "row_id", F.array_join("anomalies", ",").alias("tags")).agg(F.count(F.lit(1)).alias("n"))


@register("f2_anomaly_tags", with_ctes(["derived"], [("valid", "SELECT * FROM derived WHERE error IS NULL"), ("tags", """
        SELECT session_id, 'zero_views' AS tag FROM valid WHERE view_count = 0
        UNION ALL SELECT session_id, 'negative_stats' FROM valid WHERE like_count < 0 OR comment_count < 0
        UNION ALL SELECT session_id, 'unknown_genre' FROM valid WHERE genre IS NULL OR genre IN ('', 'Unknown')
        UNION ALL SELECT session_id, 'empty_title' FROM valid WHERE trim(track_title) = ''
        UNION ALL SELECT session_id, 'missing_video_id' FROM valid WHERE trim(video_id) = ''""")], """
    SELECT session_id, tag, count(*) AS n FROM tags GROUP BY ALL"""))
def f2_anomaly_tags(spark, sf_dir):
    v = validated(spark, sf_dir).where(F.col("error").isNull())
    return (v.select("session_id", F.explode("anomalies").alias("tag"))
            .groupBy("session_id", "tag").agg(F.count(F.lit(1)).alias("n")))


@register("p5_clean_search_title", with_ctes(["raw_tracks"], [], r"""
    SELECT DISTINCT track_title,
           trim(regexp_replace(track_title, '[\(\[\|].*?[\)\]\|]', '', 'g')) AS clean_title
    FROM raw_tracks"""))
def p5_clean_search_title(spark, sf_dir):
    r = raw_tracks(Adapters(spark, sf_dir))
    return r.select("track_title", S.clean_search_title("track_title").alias("clean_title")).distinct()


SQL_METADATA = ("metadata", """
        SELECT term, min(p_type) AS genre, 'US' AS country, min(p_brand) AS collection_name,
               CAST(min(p_partkey) AS VARCHAR) AS collection_id, max(p_brand) AS found_artist,
               CAST(max(p_partkey) * 1000 AS VARCHAR) AS found_millis
        FROM (SELECT CASE WHEN p_size > 25 THEN p_name || ' ' || p_brand WHEN p_size <= 10 THEN p_name ELSE p_name || ' / ' || p_brand END AS term,
                     p_type, p_brand, p_partkey FROM part)
        GROUP BY term""")


def metadata_table(a: Adapters):
    """J2 lookup table: what a metadata search returns per term (one row per term). Every part has a
    row: by title and artist, by title alone, or under a term that no track looks up."""
    term = (F.when(F.col("p_size") > 25, F.concat_ws(" ", "p_name", "p_brand")).when(F.col("p_size") <= 10, F.col("p_name"))
            .otherwise(F.concat_ws(" / ", "p_name", "p_brand")))
    terms = a.t.part.select(term.alias("term"), "p_type", "p_brand", "p_partkey")
    return terms.groupBy("term").agg(F.min("p_type").alias("genre"), F.lit("US").alias("country"),
                                     F.min("p_brand").alias("collection_name"),
                                     F.min("p_partkey").cast("string").alias("collection_id"),
                                     F.max("p_brand").alias("found_artist"),
                                     (F.max("p_partkey") * 1000).cast("string").alias("found_millis"))


@register("j2_metadata_lookup", with_ctes(["raw_tracks"], [SQL_METADATA, ("keys", r"""
        SELECT *, trim(regexp_replace(track_title, '[\(\[\|].*?[\)\]\|]', '', 'g')) AS clean
        FROM (SELECT DISTINCT track_title, CASE WHEN src_part % 7 = 0 THEN NULL ELSE artist_name END AS artist_name
              FROM raw_tracks)""")], """
    SELECT k.track_title, k.artist_name,
           coalesce(CASE WHEN m1.genre IS NOT NULL THEN m1.found_artist ELSE m2.found_artist END, '') AS found_artist,
           coalesce(CASE WHEN m1.genre IS NOT NULL THEN m1.found_millis ELSE m2.found_millis END, '') AS found_millis,
           coalesce(CASE WHEN m1.genre IS NOT NULL THEN m1.genre ELSE m2.genre END, 'Unknown') AS genre,
           coalesce(CASE WHEN m1.genre IS NOT NULL THEN m1.country ELSE m2.country END, '') AS country,
           coalesce(CASE WHEN m1.genre IS NOT NULL THEN m1.collection_name ELSE m2.collection_name END, '')
             AS collection_name,
           coalesce(CASE WHEN m1.genre IS NOT NULL THEN m1.collection_id ELSE m2.collection_id END, '')
             AS collection_id
    FROM keys k LEFT JOIN metadata m1 ON m1.term = trim(concat_ws(' ', k.clean, coalesce(k.artist_name, '')))
    LEFT JOIN metadata m2 ON m2.term = k.clean"""))
def j2_metadata_lookup(spark, sf_dir):
    a = Adapters(spark, sf_dir)
    artist = F.when(F.pmod("src_part", F.lit(7)) == 0, F.lit(None)).otherwise(F.col("artist_name"))
    r = raw_tracks(a).select("track_title", artist.alias("artist_name")).distinct()
    return I.join_metadata(r, metadata_table(a)).select(
        "track_title", "artist_name", "found_artist", "found_millis", "genre", "country", "collection_name", "collection_id")


@register("j1_video_stats", with_ctes(["raw_tracks"], [("stats", """
        SELECT CASE WHEN p_size > 10 THEN '' ELSE 'x' END || p_partkey AS video_id, CAST(p_size * 100 AS BIGINT) AS view_count,
               CAST(p_size * 7 AS BIGINT) AS like_count, CAST(p_size AS BIGINT) AS comment_count
        FROM part""")], """
    SELECT r.session_id, CAST(sum(coalesce(s.view_count, 0)) AS BIGINT) AS views,
           CAST(sum(coalesce(s.like_count, 0)) AS BIGINT) AS likes,
           CAST(sum(coalesce(s.comment_count, 0)) AS BIGINT) AS comments, count(*) AS tracks
    FROM raw_tracks r LEFT JOIN stats s ON s.video_id = r.video_id GROUP BY r.session_id"""))
def j1_video_stats(spark, sf_dir):
    a = Adapters(spark, sf_dir)
    # the statistics of small parts are under ids that no track has
    stats = a.t.part.select(F.concat(F.when(F.col("p_size") > 10, "").otherwise("x"), F.col("p_partkey").cast("string")).alias("video_id"),
                     (F.col("p_size") * 100).cast("long").alias("view_count"),
                     (F.col("p_size") * 7).cast("long").alias("like_count"),
                     F.col("p_size").cast("long").alias("comment_count"))
    t = I.join_video_stats(raw_tracks(a).select("session_id", "video_id"), stats)
    return t.groupBy("session_id").agg(F.sum("view_count").alias("views"), F.sum("like_count").alias("likes"),
                                       F.sum("comment_count").alias("comments"),
                                       F.count(F.lit(1)).alias("tracks"))


SQL_PRE = [
    ("valid", "SELECT * FROM derived WHERE error IS NULL"),
    ("firsts", """
        SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY session_id, video_id
                                 ORDER BY src_order, src_line, src_part, src_supp) AS rn FROM valid) WHERE rn = 1"""),
    ("cleaned", r"""
        SELECT session_id, video_id,
               trim(regexp_replace(lower(coalesce(track_title, 'unknown')), '[^a-z0-9\s]', '', 'g')) AS track_title,
               trim(regexp_replace(lower(coalesce(artist_name, 'unknown')), '[^a-z0-9\s]', '', 'g')) AS artist_name,
               trim(regexp_replace(lower(coalesce(genre, 'unknown')), '[^a-z0-9\s]', '', 'g')) AS genre,
               trim(regexp_replace(lower(coalesce(collection_name, 'unknown')), '[^a-z0-9\s]', '', 'g'))
                 AS collection_name,
               CAST(trackTimeMillis AS DOUBLE) / 1000.0 AS duration_sec,
               CAST(view_count AS DOUBLE) AS v, CAST(like_count AS DOUBLE) AS l, CAST(comment_count AS DOUBLE) AS c,
               CASE WHEN like_to_view_ratio = 0
                    THEN like_count / CASE WHEN view_count = 0 THEN 1.0 ELSE CAST(view_count AS DOUBLE) END
                    ELSE like_to_view_ratio END AS like_to_view_ratio
        FROM firsts"""),
    ("ext", """
        SELECT session_id, min(v) AS v0, max(v) AS v1, min(l) AS l0, max(l) AS l1, min(c) AS c0, max(c) AS c1
        FROM cleaned GROUP BY session_id"""),
    ("pre", """
        SELECT c.*, 0.5 * CASE WHEN v1 = v0 THEN 0.0 ELSE (v - v0) / (v1 - v0) END
                  + 0.3 * CASE WHEN l1 = l0 THEN 0.0 ELSE (l - l0) / (l1 - l0) END
                  + 0.2 * CASE WHEN c1 = c0 THEN 0.0 ELSE (c - c0) / (c1 - c0) END AS popularity_score
        FROM cleaned c JOIN ext USING (session_id)"""),
]


def preprocessed(spark, sf_dir):
    v = validated(spark, sf_dir).where(F.col("error").isNull())
    return I.preprocess_songs(v, ORDER)


@register("p6_p11_preprocess_songs", with_ctes(["derived"], SQL_PRE, f"""
    SELECT session_id, video_id, track_title, artist_name, genre, collection_name,
           {s4('duration_sec')} AS duration_sec, {s4('like_to_view_ratio')} AS like_to_view_ratio,
           {s4('popularity_score')} AS popularity_score FROM pre"""))
def p6_p11_preprocess_songs(spark, sf_dir):
    p = preprocessed(spark, sf_dir)
    return p.select("session_id", "video_id", "track_title", "artist_name", "genre", "collection_name",
                    r4(F.col("duration_sec")).alias("duration_sec"),
                    r4(F.col("like_to_view_ratio")).alias("like_to_view_ratio"),
                    r4(F.col("popularity_score")).alias("popularity_score"))


@register("p12_song_sentence", with_ctes(["derived"], SQL_PRE, """
    SELECT session_id, video_id,
           'title: ' || track_title || ' artist: ' || artist_name || ' genre: ' || genre
           || ' album: ' || collection_name AS sentence FROM pre"""))
def p12_song_sentence(spark, sf_dir):
    p = preprocessed(spark, sf_dir)
    return p.select("session_id", "video_id",
                    S.song_sentence("track_title", "artist_name", "genre", "collection_name").alias("sentence"))


SQL_NEW_SONGS = SQL_PRE[:1] + [
    ("firsts", """
        SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY video_id ORDER BY src_order, src_line, src_part, src_supp) AS rn
                       FROM valid WHERE video_id NOT IN (SELECT CAST(vec_id AS VARCHAR) FROM embeddings)) WHERE rn = 1""")] + SQL_PRE[2:3] + [
    ("ext", "SELECT min(v) AS v0, max(v) AS v1, min(l) AS l0, max(l) AS l1, min(c) AS c0, max(c) AS c1 FROM cleaned"),
    ("pre", SQL_PRE[4][1].replace("JOIN ext USING (session_id)", "CROSS JOIN ext")),
    ("tok", """
        SELECT video_id, CAST('0x' || substr(md5(t), 1, 8) AS BIGINT) % 384 AS d,
               CASE WHEN substr(md5(t), 9, 1) < '8' THEN 1.0 ELSE -1.0 END AS x
        FROM (SELECT video_id, unnest(string_split('title: ' || track_title || ' artist: ' || artist_name || ' genre: ' || genre || ' album: ' || collection_name, ' ')) AS t
              FROM pre) WHERE t <> ''"""),
    ("cell", "SELECT video_id, d, sum(x) AS x FROM tok GROUP BY ALL"),
    ("len", "SELECT video_id, sqrt(sum(x * x)) AS n FROM cell GROUP BY 1"),
    ("text", f"SELECT video_id, string_agg(d || ':' || printf('%.6f', x / n), ' ' ORDER BY d) AS vector FROM cell JOIN len USING (video_id) WHERE x <> 0 GROUP BY 1"),
    ("mm", "SELECT min(duration_sec) AS d0, max(duration_sec) AS d1, min(popularity_score) AS p0, max(popularity_score) AS p1 FROM pre")]


@register("p13_song_vectors", with_ctes(["derived"], SQL_NEW_SONGS, f"""
    SELECT video_id, track_title, artist_name, genre, {s4('duration_sec')} AS duration_sec, {s4('popularity_score')} AS popularity_score, vector,
           {s4('CASE WHEN d1 > d0 THEN (duration_sec - d0) / (d1 - d0) ELSE 0.0 END')} AS scaled_duration,
           {s4('CASE WHEN p1 > p0 THEN (popularity_score - p0) / (p1 - p0) ELSE 0.0 END')} AS scaled_popularity, 386 AS width
    FROM pre JOIN text USING (video_id) CROSS JOIN mm"""))
def p13_song_vectors(spark, sf_dir):
    """P13, P14 for the tracks whose song is not in the catalog; the vector's non-zero places as text."""
    a = Adapters(spark, sf_dir)
    catalog = a.t.embeddings.select(F.col("vec_id").cast("string").alias("video_id"))
    tracks = validated(spark, sf_dir).where(F.col("error").isNull()).select(*I.COLUMNS, *ORDER)
    fresh = tracks.join(catalog, "video_id", "left_anti").withColumn("batch", F.lit(0))
    rows = N.new_song_rows(I.preprocess_songs(fresh, ORDER, "batch"), catalog)
    e = F.col("embedding")
    nonzero = F.filter(F.transform(F.slice(e, 1, N.TEXT_DIMS), lambda x, i: F.struct(i.alias("i"), x.alias("x"))), lambda c: c["x"] != 0)
    text = F.array_join(F.transform(nonzero, lambda c: F.format_string("%d:%.6f", c["i"], c["x"])), " ")
    return rows.select("video_id", "track_title", "artist_name", "genre", r4(F.col("duration_sec")).alias("duration_sec"),
                       r4(F.col("popularity_score")).alias("popularity_score"), text.alias("vector"),
                       r4(e[N.TEXT_DIMS]).alias("scaled_duration"), r4(e[N.TEXT_DIMS + 1]).alias("scaled_popularity"), F.size(e).alias("width"))
