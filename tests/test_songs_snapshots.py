"""Song vectors, snapshots, ranked CF with zero scores, dropped likes, small rules."""

import hashlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from cadence.functions import scalars as S
from cadence.operators import recommend as R
from cadence.operators import sinks
from cadence.operators import snapshots as N
from cadence.operators import songs as G


def hashed(text, dims):
    v = np.zeros(dims)
    for w in text.split(" "):
        if w:
            h = hashlib.md5(w.encode()).hexdigest()
            v[int(h[:8], 16) % dims] += 1 if h[8] in "01234567" else -1
    n = np.linalg.norm(v)
    return v / n if n else v


def songs(spark):
    rows = [("v1", "let it go", "idina", "pop", "frozen", 200.0, 0.9), ("v2", "go go go", "idina", "pop", None, 100.0, 0.1),
            ("v3", None, "x", "jazz", "y", 150.0, 0.5), ("old", "a", "b", "c", "d", 9000.0, 9.0), ("v4", "é ü", "", "", "", None, 0.3)]
    return rows, spark.createDataFrame(rows, "video_id string, track_title string, artist_name string, genre string, collection_name string, duration_sec double, popularity_score double")


def test_new_songs_get_vectors_scaled_over_the_new_batch(spark, tmp_path):
    rows, df = songs(spark)
    path = str(tmp_path / "catalog")
    first = G.new_song_rows(df.where("video_id = 'old'"), spark.createDataFrame([], "video_id string"))
    first.write.parquet(path)
    assert first.first().embedding[-2:] == [0.0, 0.0]                      # one song: constant, scaled to 0
    G.load_songs(df, spark.read.parquet(path), path)
    got = {r.video_id: r for r in spark.read.parquet(path).collect()}
    assert list(got["v1"].asDict()) == ["video_id", "track_title", "artist_name", "genre", "duration_sec", "popularity_score", "embedding"]
    assert set(got) == {r[0] for r in rows} and got["v1"].duration_sec == 200.0
    for v, title, artist, genre, album, dur, pop in rows:
        if v == "old":
            continue
        want = hashed(f"title: {title if title is not None else 'nan'} artist: {artist} genre: {genre} album: {album if album is not None else 'nan'}", 384)
        e = np.array(got[v].embedding)
        assert len(e) == 386 and np.allclose(e[:384], want)
        assert e[384:] == pytest.approx([(dur or 0) / 200, (pop - 0.1) / 0.8])
    assert G.new_song_rows(df, spark.read.parquet(path)).count() == 0
    plain = G.hashed_text(spark.createDataFrame([("a", ""), ("b", None)], "video_id string, sentence string"), dims=5).collect()
    assert {r.video_id: r.text_vector for r in plain} == {"a": [0.0] * 5, "b": [0.0] * 5}


def recs(spark):
    rows = [(s, r, 10 * s + r, ["pop", "jazz"][r % 2], 0.5, 0.25, 0.1, 1.0 / r + 0.00004, s == 2, 4 if s == 2 else 9, r / 10) for s in (1, 2) for r in (3, 1, 2)]
    return spark.createDataFrame(rows, "session_id long, rank int, video_id long, genre string, cbf_score double, cf_score double, gru_score double, final_score double, "
                                       "gru_active boolean, songs_played int, popularity_score double")


def test_recommendation_snapshots(spark, tmp_path):
    out = N.recommendation_snapshots(recs(spark))
    sinks.append_events(out, str(tmp_path / "s"))
    got = {r.session_id: r for r in spark.read.parquet(str(tmp_path / "s")).collect()}
    assert (got[1].phase, tuple(got[1].weights)) == ("cold_start", (0.6, 0.4, 0.0))
    assert (got[2].phase, tuple(got[2].weights)) == ("gru_soft_entry", (0.4444, 0.3333, 0.2222))
    assert [(x["rank"], x.video_id, x.title, x.final_score) for x in got[2].songs] == [(1, "21", "", 1.0), (2, "22", "", 0.5), (3, "23", "", 0.3334)]
    lists = str(tmp_path / "lists")
    sinks.replace_lists(recs(spark), lists)
    sinks.replace_lists(recs(spark).where("session_id = 1 and rank = 1"), lists)
    assert sorted((r.session_id, r["rank"]) for r in sinks.latest_lists(spark.read.parquet(lists)).collect()) == [(1, 1), (2, 1), (2, 2), (2, 3)]


def test_bias_snapshots_have_maps_by_genre(spark):
    cat = spark.createDataFrame([("pop", 0.5), ("jazz", 0.5), ("folk", 0.5), ("folk", 0.1)], "genre string, popularity_score double")
    r = N.bias_snapshots(recs(spark), cat).where("session_id = 1").first()
    assert r.genre_distribution == {"jazz": 0.6667, "pop": 0.3333} and r.catalog_distribution == {"folk": 0.5, "jazz": 0.25, "pop": 0.25}
    assert r.genre_deviations == {"folk": -0.5, "jazz": 0.4167, "pop": 0.0833}
    assert r.genre_flags == ["jazz_over_represented", "folk_under_represented"]
    assert r.per_genre_scores == {"jazz": pytest.approx(0.6667), "pop": 0.5} and r.recommendation_count == 3 and r.genre_bias_detected
    assert r.rec_mean_popularity == pytest.approx(0.2) and r.disparity_threshold == 0.15


def test_play_events(spark):
    p = spark.createDataFrame([(1, "v", 3, "like", 12.345, "pop"), (1, None, 1, "pause", 0.0, None)], "session_id long, video_id string, play_order long, action string, play_duration_sec double, genre string")
    assert sorted(map(tuple, N.play_events(p).collect())) == [(1, "", "", "", "", "neutral", 0.0, 0), (1, "v", "", "", "pop", "like", 12.35, 2)]


def test_cf_lists_are_filled_with_zero_scores(spark):
    catalog = spark.createDataFrame([(i,) for i in range(8)], "video_id long")
    scores = spark.createDataFrame([(1, 5, 0.5), (1, 7, 0.5), (2, 6, 0.1)] + [(3, i, 0.9) for i in range(1, 8)], "session_id long, video_id long, cf_score double")
    sess = spark.createDataFrame([(1,), (2,), (3,), (4,)], "session_id long")
    played = spark.createDataFrame([(1, 0), (1, 1), (2, 99), (4, 0), (4, 1), (4, 2), (4, 3), (4, 4), (4, 5), (4, 6)], "session_id long, video_id long")
    got = [(r.session_id, r.video_id, r.cf_score) for r in R.cf_top_n(scores, sess, played, catalog, 4).orderBy("session_id", "rank").collect()]
    assert got == [(1, 5, 0.5), (1, 7, 0.5), (1, 2, 0.0), (1, 3, 0.0), (2, 6, 0.1), (2, 0, 0.0), (2, 1, 0.0), (2, 2, 0.0),
                   (3, 1, 0.9), (3, 2, 0.9), (3, 3, 0.9), (3, 4, 0.9), (4, 7, 0.0)]
    members = spark.createDataFrame([(1, "u"), (1, "w")], "session_id long, user_id string")
    likes = spark.createDataFrame([("u", 1), ("u", 50), ("w", 1), ("w", 1), ("z", 60)], "user_id string, video_id long")
    assert R.dropped_likes(members, likes, catalog).first()[1:] == (2, 1)


def test_small_rules(spark):
    flags = spark.createDataFrame([([],), (["a"],), (["a", "b"],), (None,)], "f array<string>")
    assert [r.h for r in flags.select(S.bias_health("f").alias("h")).collect()] == ["ok", "warn", "critical", "ok"]
    acts = spark.createDataFrame([("like",), ("pause",), (None,)], "a string")
    assert [r.f for r in acts.select(S.play_feedback("a").alias("f")).collect()] == ["like", "neutral", "neutral"]
    ts = spark.createDataFrame([("2024-01-01T00:00:00Z",), (None,), ("bad",)], "t string").select(S.event_timestamp("t").alias("t")).collect()
    assert str(ts[0].t) == "2024-01-01 00:00:00" and all(r.t.year >= 2024 for r in ts)
    st = spark.createDataFrame([(n, a) for n in (3, 4, 5, 6, 20) for a in (True, False)], "n int, a boolean")
    w = R.gru_weight_expr(F.col("n"), F.col("a"))
    got = {(r.n, r.a): (r.p, tuple(r.w)) for r in st.select("n", "a", R.phase_name_expr(F.col("n"), F.col("a")).alias("p"), R.active_weights_expr(F.col("a"), w).alias("w")).collect()}
    assert got[4, True] == ("gru_soft_entry", (0.4444, 0.3333, 0.2222)) and got[5, True] == ("gru_growing", (0.4211, 0.3158, 0.2632))
    assert got[20, True] == ("full_hybrid", (0.4, 0.3, 0.3)) and all(got[n, False] == ("cold_start", (0.6, 0.4, 0.0)) for n in (3, 4, 5, 6, 20))
