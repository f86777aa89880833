"""Large catalogs: a session's vector is sent to one block, songs are not sent to every few rows."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from cadence.functions import vectors as V
from cadence.operators import groupmeans as G
from cadence.operators import means as M
from cadence.operators import nearest as N


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


@pytest.fixture
def inputs(spark):
    rng = np.random.default_rng(12)
    songs = [(int(i), rng.normal(size=6).tolist()) for i in rng.permutation(260)] + [(7, rng.normal(size=6).tolist()), (None, rng.normal(size=6).tolist())]
    songs += [(i, [1.0] + [0.0] * 5) for i in range(300, 340)]
    sessions = [(s, rng.normal(size=6).tolist()) for s in range(40)] + [(None, rng.normal(size=6).tolist()), (50, [3.0] + [0.0] * 5), (51, [0.0] * 6), (52, None)]
    marks = [(int(s), int(v), bool(rng.random() < 0.5), float(rng.normal())) for s, v in zip(rng.integers(0, 45, 900), rng.integers(0, 270, 900))]
    marks += [(None, 5, True, 0.0), (3, None, True, 0.0), (50, 301, True, 0.0), (50, 302, False, 0.5), (4, 7, True, 0.0)]
    owned = [("u", 9), ("u", 11), ("v", None), ("v", 40)]
    links = [(s, "uv"[s % 2]) for s in range(20)]
    return (spark.createDataFrame(songs, "video_id long, embedding array<double>"), spark.createDataFrame(sessions, "session_id long, vector array<double>"),
            spark.createDataFrame(marks, "session_id long, video_id long, excluded boolean, bonus double"),
            (spark.createDataFrame(links, "session_id long, owner string"), spark.createDataFrame(owned, "owner string, video_id long")))


def test_chunks_equal_one_place(inputs):
    songs, sessions, marks, shared = inputs
    one, many = N.MetricIndex(songs.where("video_id <> 7 or video_id is null")), N.MetricIndex(songs.where("video_id <> 7 or video_id is null"), chunk_songs=40, fine_songs=8)
    assert one.n_coarse == 1 and many.n_coarse > 3
    key = lambda df: sorted((str(r.session_id), r["rank"], str(r.video_id), round(r.score, 9), r.bonus) for r in df.collect())
    for k in (1, 6, 400):
        got, want = (key(i.top_items(sessions, k, marks, weight=0.3, shared=shared, block_sessions=n)) for i, n in ((many, 7), (one, 2000)))
        assert got == want


def test_a_session_is_sent_once(inputs):
    """No ranks over the lists of several clusters, so no second exchange of them."""
    songs, sessions, marks, shared = inputs
    top = N.MetricIndex(songs, chunk_songs=40).top_items(sessions, 5, marks.limit(0), shared=shared)
    assert "row_number" not in plan(top) and plan(top).count("MapInArrow") >= 1
    assert top.count() == 5 * sessions.where("vector is not null").count()


def test_every_row_of_an_excluded_id_is_left_out(inputs):
    songs, sessions, marks, _ = inputs
    index = N.MetricIndex(songs, chunk_songs=40)
    rows = index.top_items(sessions.where("session_id = 4"), 400, marks.where("session_id = 4 and video_id = 7")).collect()
    assert len(rows) == 300 and all(r.video_id != 7 for r in rows)


def test_cells_grow_with_the_catalog(spark, monkeypatch):
    monkeypatch.setattr(M, "CELL_ROWS", 4)
    songs = spark.createDataFrame([(i, [float(i), 0.5]) for i in range(30)], "video_id long, embedding array<double>")
    rows = spark.range(200).select((F.col("id") % 9).alias("k"), (F.col("id") % 31).alias("video_id"))
    out = M.vector_means(rows, ["k"], songs)
    assert "sequence(cast(0 as bigint), cast(0 as bigint)" in out._jdf.queryExecution().analyzed().toString()      # 50 cells otherwise, each of which is sent all songs
    want = {}
    for i in range(200):
        if i % 31 < 30:
            want.setdefault(i % 9, []).append(i % 31)
    assert {r.k: (round(r.vector[0], 9), r.n) for r in out.collect()} == {k: (round(sum(v) / len(v), 9), len(v)) for k, v in want.items()}


def test_songs_travel_in_four_bytes_only_if_exact(spark):
    df = lambda *rows: spark.createDataFrame([(r,) for r in rows], "e array<double>")
    assert V.exact_type(df([0.5, -2.0], None, [float("nan"), 1.0]), "e") == "float32"
    assert V.exact_type(df([0.5], [0.1]), "e") == "float64" and V.exact_type(df(), "e") == "float32"


def test_lists_of_a_catalog_beyond_two_bytes(spark):
    """Places above 32,767 as member lists; such a catalog sent every member's vector."""
    songs = spark.range(40_000).select(F.col("id").alias("video_id"), F.array(F.col("id").cast("double"), F.lit(1.0)).alias("embedding"))
    places = G.song_places(songs)
    assert {r.place for r in places.where("video_id in (0, 39999)").collect()} == {0, 39_999}
    prefs = spark.createDataFrame([("u", [3.0, 4.0], 2, None, None)], "user_id string, pos array<double>, liked_count long, neg array<double>, disliked_count long")
    likes = spark.createDataFrame([("u", 2), ("u", 39_999)], "user_id string, video_id long")
    row = G.member_lists(prefs, likes, likes.where("false"), places).first()
    assert V.places_of(bytes(row.liked), G.LIST_TYPE).tolist() == [2, 39_999] and row.vector is None
