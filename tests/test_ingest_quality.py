"""Derivation, validation, tags, bias statistics and re-balancing (goldens from FIXTURES.md)."""

import math

from pyspark.sql import functions as F

from cadence.functions import scalars as S
from cadence.operators import ingest as I
from cadence.operators import quality as Q

RAW = "session_id long, row_id long, playlist_name string, track_title string, artist_name string, video_id string, " \
      "genre string, country string, collection_name string, collection_id string, trackTimeMillis string, " \
      "view_count string, like_count string, comment_count string"


def raw(spark, rows):
    base = (1, 0, "Chill Vibes", "Blinding Lights", "The Weeknd", "abc123", "Pop", "USA", "After Hours", "123456",
            "200000", "1000000", "50000", "3000")
    out = []
    for i, patch in enumerate(rows):
        r = list(base)
        r[1] = i
        for k, v in patch.items():
            r[RAW.split(", ").index(next(c for c in RAW.split(", ") if c.startswith(k + " ")))] = v
        out.append(tuple(r))
    return spark.createDataFrame(out, RAW)


def test_derive_fields_golden(spark):
    d = I.derive_fields(raw(spark, [{}])).first()
    assert (d.trackTimeMillis, d.trackTimeSeconds) == (200000, 200)
    assert d.like_to_view_ratio == 0.05 and d.comment_to_view_ratio == 0.003


def test_lenient_parsing_edges(spark):
    rows = [{"view_count": "0"}, {"trackTimeMillis": None}, {"trackTimeMillis": ""},
            {"trackTimeMillis": "not_a_number"}, {"trackTimeMillis": "199999.9"}, {"like_count": "-5"},
            {"like_count": "3.7"}, {"trackTimeMillis": "-1500"}]
    d = I.derive_fields(raw(spark, rows)).orderBy("row_id").collect()
    assert d[0].like_to_view_ratio == 0.0 and d[0].comment_to_view_ratio == 0.0
    assert [d[i].trackTimeMillis for i in (1, 2, 3, 4)] == [0, 0, 0, 199999]
    assert d[5].like_count == -5 and d[6].like_count == 0
    assert d[7].trackTimeSeconds == -2  # floor division, as Python //


def test_validation_routing_and_tags(spark):
    rows = [{}, {"trackTimeMillis": "inf"}, {"track_title": None}, {"view_count": "0", "genre": "Unknown"},
            {"track_title": "   "}, {"video_id": ""}, {"like_count": "-1"}]
    v = I.validate(raw(spark, rows)).orderBy("row_id").collect()
    assert v[0].error is None and v[0].anomalies == []
    assert v[1].error == "cannot convert float infinity to integer" and v[2].error == I.ERR_NONE_STRIP
    assert v[3].anomalies == ["zero_views", "unknown_genre"]
    assert v[4].anomalies == ["empty_title"] and v[5].anomalies == ["missing_video_id"]
    assert v[6].anomalies == ["negative_stats"]


def test_text_rules(spark):
    df = spark.createDataFrame([("rock & roll!", "Song (Live) [HD] | x |"), (None, "  a ")], "t string, s string")
    r = df.select(S.clean_text("t").alias("c"), S.clean_search_title("s").alias("s")).collect()
    assert r[0].c == "rock  roll" and r[0].s == "Song"
    assert r[1].c == "unknown" and r[1].s == "a"


def slice_frame(spark, genres, countries=None):
    countries = countries or ["USA"] * len(genres)
    return spark.createDataFrame([(1, i, g, c) for i, (g, c) in enumerate(zip(genres, countries))],
                                 "session_id long, row_id long, genre string, country string")


def test_slice_stats_sample(spark):
    df = slice_frame(spark, ["Pop"] * 70 + ["Rock"] * 20 + ["Jazz"] * 10,
                     ["USA"] * 61 + ["GBR"] * 25 + ["AUS"] * 14)
    st = {r.slice: r for r in Q.slice_stats(df, ["genre", "country", "missing"]).collect()}
    assert st["genre"].bias_flag and st["country"].bias_flag and "missing" not in st
    assert st["genre"].dominant_label == "Pop" and st["genre"].dominant_share == 0.7
    p = [0.7, 0.2, 0.1]
    assert abs(st["genre"].entropy - round(-sum(x * math.log(x) for x in p), 4)) < 1e-9
    assert st["genre"].max_entropy == round(math.log(3), 4)


def test_slice_stats_edges(spark):
    bal = {r.slice: r for r in Q.slice_stats(slice_frame(spark, ["Pop"] * 34 + ["Rock"] * 33 + ["Jazz"] * 33),
                                             ["genre"]).collect()}
    assert not bal["genre"].bias_flag
    single = Q.slice_stats(slice_frame(spark, ["Pop"] * 10), ["genre"]).first()
    assert single.entropy == 0.0
    rare = Q.slice_stats(slice_frame(spark, ["Pop"] * 198 + ["Jazz", "Rock"]), ["genre"]).first()
    assert rare.underrepresented == ["Jazz", "Rock"]


def counts(df):
    return {r.label: r.n for r in df.groupBy(F.coalesce("genre", F.lit("Unknown")).alias("label"))
            .agg(F.count(F.lit(1)).alias("n")).collect()}


def test_upsample_and_downsample_formulas(spark):
    df = slice_frame(spark, ["Pop"] * 70 + ["Rock"] * 28 + ["Jazz"] * 2)
    up = Q.upsample(df, "genre")
    assert counts(up) == {"Pop": 70, "Rock": 28, "Jazz": 6}          # ceil((5 - 2) / 0.95) = 4 more
    jazz_ids = {r.row_id for r in df.where("genre = 'Jazz'").collect()}
    assert {r.row_id for r in up.where("genre = 'Jazz'").collect()} <= jazz_ids
    down = Q.downsample(df, "genre")
    assert counts(down) == {"Pop": 45, "Rock": 28, "Jazz": 2}        # int(30 * 0.6 / 0.4) = 45
    assert counts(Q.downsample(up, "genre"))["Pop"] == 50  # int(34 * 0.6 / (1 - 0.6)) in doubles (D33)


def test_downsample_is_partition_independent(spark):
    df = slice_frame(spark, ["Pop"] * 300 + ["Rock"] * 50)
    a = {r.row_id for r in Q.downsample(df.repartition(1), "genre").collect()}
    b = {r.row_id for r in Q.downsample(df.repartition(7), "genre").collect()}
    assert a == b and len(a) == 50 + 75


def test_single_label_kept_unless_strict(spark):
    df = slice_frame(spark, ["Pop"] * 10)
    assert Q.downsample(df, "genre").count() == 10
    assert Q.downsample(df, "genre", strict=True).count() == 0


def test_nulls_count_as_unknown(spark):
    df = slice_frame(spark, ["Pop"] * 95 + [None] * 5)
    c = {r["label"]: r["count"] for r in Q.slice_counts(df, ["genre"]).collect()}
    assert c == {"Pop": 95, "Unknown": 5}


def test_session_anomalies(spark):
    rows = [(1, None, "Pop", 10)] * 100 + [(1, "bad", "Pop", 10)] * 50 + [(2, None, "Unknown", 5)] * 40 + \
           [(2, None, "Pop", 5)] * 60
    df = spark.createDataFrame(rows, "session_id long, error string, genre string, view_count long")
    a = {r.session_id: [x.kind for x in r.anomalies] for r in Q.session_anomalies(df).collect()}
    assert a == {1: ["high_invalid_rate"], 2: ["high_unknown_genre"]}
