"""File sources and sinks: written, then read back."""

import json

import pytest
from pyspark.sql import functions as F

from cadence.operators import ingest as I
from cadence.operators import sessions as S
from cadence.operators import sinks
from cadence.sources import files


def test_csv_missing_value_tokens(spark, tmp_path):
    (tmp_path / "a.csv").write_text('track_title,view_count,genre\nNone,12,Pop\n"a, ""b""",NA,null\nnan,x,N/A\n,7,none\n')
    rows = files.read_csv(spark, str(tmp_path / "a.csv"), "track_title string, view_count long, genre string, country string").collect()
    assert [tuple(r) for r in rows] == [(None, 12, "Pop", None), ('a, "b"', None, None, None), (None, None, None, None), (None, 7, "none", None)]


def test_shards_combine_under_the_first_header(spark, tmp_path):
    a = spark.createDataFrame([(1, "x")], "id int, t string")
    b = spark.createDataFrame([("y", 5.0)], "t string, extra double")
    out = files.combine_shards([a, b])
    assert out.columns == ["id", "t"] and sorted(map(str, out.collect())) == ["Row(id=1, t='x')", "Row(id=None, t='y')"]
    assert files.combine_shards([]) is None
    for name, text in {"u1/t.csv": "id,t\n1,x\n", "u2/t.csv": "id,t\n2,NA\n", "combined/t.csv": "id,t\n9,z\n"}.items():
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_text(text)
    got = files.read_session_shards(spark, f"{tmp_path}/*", "id int, t string").collect()
    assert sorted((r.id, r.t, r.source_file.split("/")[-2]) for r in got) == [(1, "x", "u1"), (2, None, "u2")]


def test_playlist_pages(spark, tmp_path):
    page = {"playlist_name": "Chill", "page": 1, "items": [{"snippet": {"title": t, "resourceId": {"videoId": v}}} for t, v in [("A", "v1"), ("B", "v2")]]}
    (tmp_path / "p.json").write_text(json.dumps(page) + "\n" + json.dumps({**page, "page": 2, "items": []}) + "\n")
    got = files.playlist_tracks(spark.read.json(str(tmp_path / "p.json"))).orderBy("position").collect()
    assert [(r.track_title, r.video_id) for r in got] == [("A", "v1"), ("B", "v2")]


def test_valid_tracks_csv_has_the_fixed_columns(spark, tmp_path):
    row = {c: "1" for c in I.COLUMNS} | {"track_title": 'say "hi", you', "session_id": "9"}
    df = spark.createDataFrame([tuple(row.values())], ", ".join(f"{c} string" for c in row))
    sinks.write_valid_csv(df, str(tmp_path / "out"))
    back = spark.read.option("header", True).option("escape", "\\").csv(str(tmp_path / "out"))
    assert back.columns == I.COLUMNS and back.first().track_title == 'say "hi", you'


def test_replacing_one_session_leaves_the_others(spark, tmp_path):
    path = str(tmp_path / "recs")
    make = lambda rows: spark.createDataFrame(rows, "session_id long, rank int, video_id string")
    sinks.replace_recommendations(make([(1, 1, "a"), (1, 2, "b"), (2, 1, "c")]), path)
    sinks.replace_recommendations(make([(1, 1, "z")]), path)
    assert sorted((r.session_id, r.video_id) for r in spark.read.parquet(path).collect()) == [(1, "z"), (2, "c")]


def test_reports_and_events(spark, tmp_path):
    r = spark.createDataFrame([(1, 0.5, None), (2, 0.1, "x")], "session_id long, kl double, note string")
    sinks.write_reports(r, str(tmp_path / "reports"))
    back = {x.session_id: json.loads(x.value) for x in spark.read.text(str(tmp_path / "reports")).collect()}
    assert back == {1: {"kl": 0.5, "note": None}, 2: {"kl": 0.1, "note": "x"}}
    for _ in range(2):
        sinks.append_events(r, str(tmp_path / "events"))
    assert spark.read.parquet(str(tmp_path / "events")).count() == 4


def test_incremental_catalog_load(spark, tmp_path):
    path = str(tmp_path / "catalog")
    make = lambda rows: spark.createDataFrame(rows, "video_id string, track_title string")
    make([("a", "A")]).write.parquet(path)
    sinks.load_new(make([("a", "new A"), ("b", "B2"), ("b", "B1"), (None, "x")]), spark.read.parquet(path), path)
    assert sorted(map(tuple, spark.read.parquet(path).collect())) == [("a", "A"), ("b", "B1")]


def test_session_state_fallbacks(spark):
    sess = spark.createDataFrame([(1, "done", 2, 9, 3, 4), (2, None, 0, 9, 3, 4), (3, "ended", None, None, 0, 4), (4, "x", None, None, None, None)],
                                 "session_id long, status string, n_users int, user_count int, songs_played_count int, last_refreshed_at int")
    plays = spark.createDataFrame([(1, "v")] * 600, "session_id long, video_id string")
    fb = spark.createDataFrame([(1, "like"), (1, "pause"), (1, None), (2, "skip")], "session_id long, action string")
    snap = spark.createDataFrame([(1, 5, "a"), (1, 9, "b")], "session_id long, ts_ms long, phase string")
    got = {r.session_id: r for r in S.session_state(sess, plays, fb, snap).collect()}
    assert [(got[i].status, got[i].user_count, got[i].songs_played, got[i].phase) for i in (1, 2, 3, 4)] == [
        ("done", 2, 600, "b"), ("active", 9, 3, "cold_start"), ("ended", 0, 4, "cold_start"), ("x", 0, 0, "cold_start")]
    assert (got[1].n_like, got[1].n_neutral, got[2].n_skip, got[4].n_like) == (1, 2, 1, 0)


def test_queue_rules(spark):
    q = spark.createDataFrame([(1, "a", 0.1, True), (1, "b", 0.9, False), (1, "c", 0.9, False), (1, "d", 1.0, False)],
                              "session_id long, video_id string, score double, playing boolean")
    played = spark.createDataFrame([(1, "a"), (1, "d")], "session_id long, video_id string")
    got = S.queue_order(q, played).orderBy("position").collect()
    assert [r.video_id for r in got] == ["a", "b", "c"]
    batch = spark.createDataFrame([(1, f"n{i}") for i in range(6)] + [(2, f"n{i}") for i in range(5)] + [(3, "d")] * 7, "session_id long, video_id string")
    flags = {r.session_id: r.new_batch for r in S.is_new_batch(batch, played.union(spark.createDataFrame([(3, "d")], played.schema))).collect()}
    assert flags == {1: True, 2: False, 3: False}
    assert [r.video_id for r in S.surviving_songs(q, q.where("video_id = 'b'"), played).collect()] == ["c"]
    with pytest.raises(ValueError):
        S.latest_cycles(q.withColumn("ts_ms", F.lit(1)), 0)
