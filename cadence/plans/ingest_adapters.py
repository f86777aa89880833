"""Raw playlist tracks as landed text, derived from lineitem ⋈ part ⋈ orders ⋈ customer ⋈ nation.

One raw track per lineitem. The driver tables hold no dirty values, so the adapter injects
them deterministically from the keys ('' / 'abc' / '199999.9' / null / '-1500' / 'inf' millis,
'3.7' / '' / null / '0' views, '-5' / 'x' likes, blank / null titles, '' video ids, null and
'Unknown' genres), so every lenient-parsing and routing path runs on every scale factor.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cadence.plans import adapters as A


def raw_tracks(a: A.Adapters) -> DataFrame:
    t = a.t
    l, p = t.lineitem, t.part
    # narrow sides first and the part's texts last, so that no wide row goes through another join
    o = t.orders.select("o_orderkey", "o_custkey", "o_orderpriority")
    c = t.customer.select(F.col("c_custkey").alias("o_custkey"), "c_nationkey")
    n = t.nation.select(F.col("n_nationkey").alias("c_nationkey"), "n_name")
    o = o.join(c.join(n, "c_nationkey"), "o_custkey")
    j = l.join(o, l.l_orderkey == o.o_orderkey).join(p, l.l_partkey == p.p_partkey)
    k, pk, ln = F.col("l_orderkey"), F.col("l_partkey"), F.col("l_linenumber")
    m11 = F.pmod(k * 7 + ln, 11)
    m13 = F.pmod(k + pk, 13)
    return j.select(
        A.Adapters._session("l_orderkey").alias("session_id"),
        F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey").alias("row_id"),
        F.col("l_orderkey").alias("src_order"), F.col("l_linenumber").alias("src_line"),
        F.col("l_partkey").alias("src_part"), F.col("l_suppkey").alias("src_supp"),
        F.col("o_custkey").cast("string").alias("user_id"),
        F.col("o_orderpriority").alias("playlist_name"),
        F.when(F.pmod(k, 29) == 0, F.lit(None).cast("string"))
        .when(F.pmod(k, 23) == 0, F.lit("   "))
        .otherwise(F.concat(F.col("p_name"), F.lit(" (Official "), F.col("p_type"), F.lit(") | "),
                            F.col("p_brand"), F.lit(" |"))).alias("track_title"),
        F.col("p_brand").alias("artist_name"),
        F.when(F.pmod(k, 31) == 0, F.lit("")).otherwise(pk.cast("string")).alias("video_id"),
        F.when(F.pmod(pk, 17) == 0, F.lit(None).cast("string"))
        .when(F.pmod(pk, 13) == 0, F.lit("Unknown")).otherwise(F.col("p_type")).alias("genre"),
        F.col("n_name").alias("country"),
        F.col("p_brand").alias("collection_name"),
        F.col("p_size").cast("string").alias("collection_id"),
        F.when(m11 == 0, F.lit("")).when(m11 == 1, F.lit("abc")).when(m11 == 2, F.lit("199999.9"))
        .when(m11 == 3, F.lit(None).cast("string")).when(m11 == 4, F.lit("-1500"))
        .when(m11 == 5, F.lit("inf"))
        .otherwise(F.floor(F.col("l_extendedprice") * 10).cast("long").cast("string")).alias("trackTimeMillis"),
        F.when(m13 == 0, F.lit("0")).when(m13 == 1, F.lit("3.7")).when(m13 == 2, F.lit(""))
        .when(m13 == 3, F.lit(None).cast("string"))
        .otherwise((F.floor(F.col("l_quantity")).cast("long") * 1000 + F.pmod(pk, 997) + 1)
                   .cast("string")).alias("view_count"),
        F.when(F.pmod(pk, 19) == 0, F.lit("-5")).when(F.pmod(pk, 19) == 1, F.lit("x"))
        .otherwise((F.floor(F.col("l_quantity")).cast("long") * 37).cast("string")).alias("like_count"),
        (ln * 3).cast("string").alias("comment_count"))


SQL_RAW_TRACKS = """
    SELECT l.l_orderkey // 4 AS session_id,
           concat_ws('-', l.l_orderkey, l.l_linenumber, l.l_partkey, l.l_suppkey) AS row_id,
           l.l_orderkey AS src_order, l.l_linenumber AS src_line, l.l_partkey AS src_part, l.l_suppkey AS src_supp,
           CAST(o.o_custkey AS VARCHAR) AS user_id,
           o.o_orderpriority AS playlist_name,
           CASE WHEN l.l_orderkey % 29 = 0 THEN NULL WHEN l.l_orderkey % 23 = 0 THEN '   '
                ELSE p.p_name || ' (Official ' || p.p_type || ') | ' || p.p_brand || ' |' END AS track_title,
           p.p_brand AS artist_name,
           CASE WHEN l.l_orderkey % 31 = 0 THEN '' ELSE CAST(l.l_partkey AS VARCHAR) END AS video_id,
           CASE WHEN l.l_partkey % 17 = 0 THEN NULL WHEN l.l_partkey % 13 = 0 THEN 'Unknown'
                ELSE p.p_type END AS genre,
           n.n_name AS country, p.p_brand AS collection_name, CAST(p.p_size AS VARCHAR) AS collection_id,
           CASE (l.l_orderkey * 7 + l.l_linenumber) % 11 WHEN 0 THEN '' WHEN 1 THEN 'abc'
                WHEN 2 THEN '199999.9' WHEN 3 THEN NULL WHEN 4 THEN '-1500' WHEN 5 THEN 'inf'
                ELSE CAST(CAST(floor(l.l_extendedprice * 10) AS BIGINT) AS VARCHAR) END AS trackTimeMillis,
           CASE (l.l_orderkey + l.l_partkey) % 13 WHEN 0 THEN '0' WHEN 1 THEN '3.7' WHEN 2 THEN ''
                WHEN 3 THEN NULL
                ELSE CAST(CAST(floor(l.l_quantity) AS BIGINT) * 1000 + l.l_partkey % 997 + 1 AS VARCHAR)
           END AS view_count,
           CASE l.l_partkey % 19 WHEN 0 THEN '-5' WHEN 1 THEN 'x'
                ELSE CAST(CAST(floor(l.l_quantity) AS BIGINT) * 37 AS VARCHAR) END AS like_count,
           CAST(l.l_linenumber * 3 AS VARCHAR) AS comment_count
    FROM lineitem l JOIN part p ON l.l_partkey = p.p_partkey JOIN orders o ON l.l_orderkey = o.o_orderkey
    JOIN customer c ON o.o_custkey = c.c_custkey JOIN nation n ON c.c_nationkey = n.n_nationkey"""

# P1-P4 + F1 routing in SQL (the reference's lenient parsing; D5, D10)
SQL_DERIVED = """
    SELECT d.*,
           CASE WHEN view_count <> 0 THEN like_count / view_count ELSE 0.0 END AS like_to_view_ratio,
           CASE WHEN view_count <> 0 THEN comment_count / view_count ELSE 0.0 END AS comment_to_view_ratio,
           CAST(floor(trackTimeMillis / 1000) AS BIGINT) AS trackTimeSeconds
    FROM (SELECT session_id, row_id, src_order, src_line, src_part, src_supp, user_id, playlist_name, track_title, artist_name, video_id, genre, country,
                 collection_name, collection_id,
            CASE WHEN r.trackTimeMillis IS NULL OR r.trackTimeMillis = '' THEN 0
                 WHEN TRY_CAST(r.trackTimeMillis AS DOUBLE) IS NULL
                      OR isnan(TRY_CAST(r.trackTimeMillis AS DOUBLE)) THEN 0
                 WHEN isinf(TRY_CAST(r.trackTimeMillis AS DOUBLE)) THEN NULL
                 ELSE CAST(trunc(TRY_CAST(r.trackTimeMillis AS DOUBLE)) AS BIGINT) END AS trackTimeMillis,
            CASE WHEN isinf(TRY_CAST(r.trackTimeMillis AS DOUBLE)) THEN 'cannot convert float infinity to integer'
                 WHEN r.track_title IS NULL OR r.video_id IS NULL THEN '''NoneType'' object has no attribute ''strip'''
                 END AS error,
            CASE WHEN regexp_full_match(trim(r.view_count), '[+-]?[0-9]+') THEN CAST(trim(r.view_count) AS BIGINT) ELSE 0 END AS view_count,
            CASE WHEN regexp_full_match(trim(r.like_count), '[+-]?[0-9]+') THEN CAST(trim(r.like_count) AS BIGINT) ELSE 0 END AS like_count,
            CASE WHEN regexp_full_match(trim(r.comment_count), '[+-]?[0-9]+') THEN CAST(trim(r.comment_count) AS BIGINT) ELSE 0 END AS comment_count
          FROM raw_tracks r) d"""

A.SQL_ADAPTERS["raw_tracks"] = SQL_RAW_TRACKS
A.SQL_ADAPTERS["derived"] = SQL_DERIVED
A.SQL_ADAPTERS["valid"] = "SELECT * FROM derived WHERE error IS NULL"
A._SQL_DEPS.update({"raw_tracks": [], "derived": ["raw_tracks"], "valid": ["derived"]})
