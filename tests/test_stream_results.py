"""Versioned results, fan-out, expiring state and the end of sessions: replays, crashes, late events."""

import json
import os

import pytest
from pyspark.sql import functions as F

from cadence.operators import prefs as P
from cadence.sources import folders
from cadence.streaming import drain as D
from cadence.streaming import expiring as X
from cadence.streaming import feedback_stream as T
from cadence.streaming import sources as Z
from cadence.streaming.fan_out import FanOut
from cadence.streaming.results import Results, added, newest


def event(i, at, room="AUX-R1", song="v1", user="u1", kind="play", name="Unknown"):
    return json.dumps({"room_id": room, "song_id": song, "user_id": user, "song_name": name, "artist": f"artist {i}", "event_type": kind,
                       "timestamp": f"2024-01-01T{at}Z"})


def land(path, name, lines):
    os.makedirs(path, exist_ok=True)
    with open(f"{path}/.{name}", "w") as f:
        f.write("\n".join(lines) + "\n")
    os.rename(f"{path}/.{name}", f"{path}/{name}")


def rows(df, *cols):
    return sorted(map(tuple, (df.select(*cols) if cols else df).collect()), key=lambda r: [(x is not None, x) for x in r])


def events_in(spark, src):
    return Z.music_lanes(spark.read.text(src).select("value", F.lit("f").alias("origin"))).events


# ---- results ---------------------------------------------------------------------------

def test_newest_version_before_and_after_compaction(spark, tmp_path):
    r = Results(str(tmp_path / "r"), newest(["k"]))
    make = lambda *x: spark.createDataFrame(list(x), "k string, n long")
    assert r.current(spark) is None and r.compact(spark) is None
    for i, part in enumerate([[("a", 1), ("b", 1)], [("a", 2)], [("c", 3)]]):
        r.write(make(*part), i)
    want = [("a", 2), ("b", 1), ("c", 3)]
    assert rows(r.current(spark)) == want
    assert r.compact(spark) == 2 and rows(r.current(spark)) == want and r.versions(spark, r.base(spark)) == []
    r.write(make(("a", 2)), 1)                         # a replay of a folded batch
    assert rows(r.current(spark)) == want
    r.write(make(("a", 9)), 3)
    assert rows(r.current(spark)) == [("a", 9), ("b", 1), ("c", 3)]
    files = [f for f in r._parts(spark).inputFiles() if "batch_id=" in f]
    assert files and all("batch_id=3" in f for f in files)        # the base and later versions only
    assert r.compact(spark) == 3 and folders.numbered(spark, r.path, "batch_id=") == [3]
    assert rows(r.current(spark)) == [("a", 9), ("b", 1), ("c", 3)] and r.compact(spark) == 3


def test_crash_in_mid_compaction_is_ignored(spark, tmp_path):
    r = Results(str(tmp_path / "r"), added(["k"], ["n"]))
    for i in range(3):
        r.write(spark.createDataFrame([("a", 1), (f"b{i}", 5)], "k string, n long"), i)
    want = rows(r.current(spark))
    assert want == [("a", 3), ("b0", 5), ("b1", 5), ("b2", 5)]
    r.compact(spark)
    os.remove(f"{r.path}/_base/upto=2/_SUCCESS")       # as a driver that died while it was written
    assert r.base(spark) is None and rows(r.current(spark)) == want
    half = f"{r.path}/batch_id=3"
    spark.createDataFrame([("a", 100)], "k string, n long").write.parquet(half)
    os.remove(f"{half}/_SUCCESS")                      # a batch that was not finished either
    assert rows(r.current(spark)) == want and r.compact(spark) == 2 and rows(r.current(spark)) == want


def test_parts_add_up_by_time_and_not_by_batch(spark, tmp_path):
    r = Results(str(tmp_path / "r"), added(["k"], ["n"], first={"name": "ts"}))
    for i, row in enumerate([("a", 1, None, None), ("a", 1, "late", 9), ("a", 1, "early", 2)]):
        r.write(spark.createDataFrame([row], "k string, n long, name string, ts long"), i)
    assert rows(r.current(spark), "k", "n", "name") == [("a", 3, "early")]


# ---- fan-out ---------------------------------------------------------------------------

def stream_lines():
    lines = [[event(i, f"10:{i // 6:02d}:{i * 7 % 60:02d}", f"AUX-R{i % 3}", f"v{i % 5}", f"u{i % 4}",
                    ["play", "skip", "complete", "like", "dislike", "replay"][(i + i // 6) % 6], "Unknown" if i % 2 else f"name {i}") for i in range(b, 90, 3)] for b in range(3)]
    lines[2].append(event(999, "09:00:05", kind="like"))        # late for its window
    return lines


def expected(spark, src):
    ev = events_in(spark, src)
    metric = ["window_start", "room_id", "song_id", "play_count", "skip_count", "complete_count", "completion_rate", "song_name", "artist", "total_events"]
    fb = T.music_to_feedback(ev)
    return {"metrics": rows(T.window_metrics(ev), *metric), "scores": rows(T.score_state(fb), "session_id", "video_id", "score", "like_count", "skip_count", "dislike_count", "replay_count"),
            "actions": rows(T.latest_feedback(fb), "session_id", "user_id", "video_id", "action", "last_updated"), "archive": ev.count()}


def found(spark, f):
    metric = ["window_start", "room_id", "song_id", "play_count", "skip_count", "complete_count", "completion_rate", "song_name", "artist", "total_events"]
    return {"metrics": rows(f.current_metrics(spark), *metric), "scores": rows(f.current_scores(spark), "session_id", "video_id", "score", "like_count", "skip_count", "dislike_count", "replay_count"),
            "actions": rows(f.latest_actions(spark), "session_id", "user_id", "video_id", "action", "last_updated"), "archive": spark.read.text(f.archive).count()}


def test_fan_out_equals_batch_and_survives_a_failure_between_branches(spark, tmp_path, monkeypatch):
    src, chk = str(tmp_path / "src"), str(tmp_path / "chk")
    for i, lines in enumerate(stream_lines()):
        land(src, f"f{i}.json", lines)
    f = FanOut(str(tmp_path / "out"))
    stream = lambda: Z.music_lanes(Z.file_lines(spark, src, files_per_trigger=1)).events
    whole = Results.write

    def fails_once(self, part, batch_id):
        if batch_id == 1 and self.path.endswith("scores"):
            raise OSError("the driver is gone")
        whole(self, part, batch_id)

    monkeypatch.setattr(Results, "write", fails_once)
    with pytest.raises(Exception, match="the driver is gone"):
        f.start(stream(), chk).awaitTermination()
    assert f.metrics.written(spark, 1) and not f.scores.written(spark, 1) and not f.actions.written(spark, 1)
    written = []
    monkeypatch.setattr(Results, "write", lambda self, part, batch_id: (written.append((os.path.basename(self.path), batch_id)), whole(self, part, batch_id)))
    f.start(stream(), chk).awaitTermination()
    assert ("metrics", 1) not in written and written.count(("scores", 1)) == written.count(("actions", 1)) == 1
    want = expected(spark, src)
    assert found(spark, f) == want
    f.compact(spark)
    assert found(spark, f) == want
    land(src, "f9.json", [event(1, "10:00:01", kind="complete", name="earliest of all"), event(2, "11:00:00", user=None)])
    f.start(stream(), chk).awaitTermination()
    assert found(spark, f) == expected(spark, src)
    record = json.loads(spark.read.text(f.archive).where("value like '%earliest of all%'").first().value)
    assert record["_window_start"] == "2024-01-01 10:00:00" and record["_window_end"] == "2024-01-01 10:01:00"


# ---- expiring state --------------------------------------------------------------------

def feedback(spark, src):
    return T.music_to_feedback(Z.music_lanes(Z.file_lines(spark, src, files_per_trigger=1)).events)


def state_keys(spark, checkpoint):
    return {r.key[0] for r in spark.read.format("statestore").load(checkpoint).where("value.groupState is not null").select("key").collect()}


def test_score_state_expires_and_goes_on_from_the_stored_total(spark, tmp_path):
    src, chk = str(tmp_path / "src"), str(tmp_path / "chk")
    out = X.run_scores(str(tmp_path / "out"))
    run = lambda: X.start_scores(feedback(spark, src), out, chk, silence="1 hour").awaitTermination()
    land(src, "a", [event(1, "10:00:00", "AUX-S1", kind="like"), event(2, "10:00:05", "AUX-S1", kind="like"), event(3, "10:10:00", "AUX-S2", kind="skip")])
    run()
    assert state_keys(spark, chk) == {"s1", "s2"}
    land(src, "b", [event(4, "11:05:00", "AUX-S2", kind="skip")])           # s1 is silent for over an hour
    run()
    run()
    assert state_keys(spark, chk) == {"s2"}
    land(src, "c", [event(5, "11:06:00", "AUX-S1", kind="dislike"), event(6, "11:06:30", "AUX-S2", kind="replay"), event(7, "10:00:01", "AUX-S2", kind="like")])
    run()
    got = rows(X.stored_scores(out, spark), "session_id", "video_id", "score", "like_count", "dislike_count", "skip_count", "replay_count")
    ev = events_in(spark, src).where("timestamp <> '2024-01-01T10:00:01Z'")     # later than the watermark allows: dropped (T2)
    assert got == rows(T.score_state(T.music_to_feedback(ev)), "session_id", "video_id", "score", "like_count", "dislike_count", "skip_count", "replay_count")
    assert rows(out.current(spark).groupBy("session_id").count()) == [("s1", 2), ("s2", 1)]


def test_latest_action_stream_equals_batch_after_expiry(spark, tmp_path):
    src, chk = str(tmp_path / "src"), str(tmp_path / "chk")
    out = X.run_actions(str(tmp_path / "out"))
    parts = [[event(1, "10:00:09", kind="like"), event(2, "10:00:03", kind="skip"), event(3, "10:00:04", user="u2", kind="dislike")],
             [event(4, "10:00:05", kind="dislike"), event(5, "10:00:09", kind="dislike", user="u2")],
             [event(6, "12:30:00", user="u3", kind="like")], [event(7, "12:30:01", kind="replay")]]
    for i, lines in enumerate(parts):
        land(src, f"f{i}", lines)
        X.start_latest(feedback(spark, src), out, chk, silence="30 minutes").awaitTermination()
    assert rows(X.stored_actions(out, spark), *X.ACTION_KEYS, "action", "last_updated") == rows(
        T.latest_feedback(T.music_to_feedback(events_in(spark, src))), *X.ACTION_KEYS, "action", "last_updated")
    assert len(spark.read.format("statestore").load(chk).where("value.groupState is not null").collect()) == 2


def test_refresh_points_go_on_after_expiry(spark, tmp_path):
    src, chk = str(tmp_path / "src"), str(tmp_path / "chk")
    r = X.Refreshes(str(tmp_path / "out"))
    parts = [[event(i, f"10:00:{i:02d}", "AUX-S1") for i in range(7)] + [event(i, f"10:00:{i:02d}", "AUX-S2") for i in range(25)],
             [event(9, "12:00:00", "AUX-S3")], [event(i, f"12:01:{i:02d}", "AUX-S1") for i in range(5)] + [event(1, "12:01:00", "AUX-S2")] * 4,
             [event(1, "12:02:00", "AUX-S2"), event(2, "12:02:00", "AUX-S1")]]
    for i, lines in enumerate(parts):
        land(src, f"f{i}", lines)
        r.start(feedback(spark, src).select("session_id", "ts"), chk, silence="1 hour").awaitTermination()
    want = rows(T.refresh_points_batch(T.music_to_feedback(events_in(spark, src))))
    assert want == [("s1", 10), ("s2", 10), ("s2", 20), ("s2", 30)] and rows(r.points(spark)) == want
    assert rows(r.runs.current(spark), "session_id", "after") == [("s1", 6), ("s1", 7), ("s2", 5), ("s2", 25), ("s3", 1)]


# ---- sources ---------------------------------------------------------------------------

def test_corrupt_lines_have_their_own_lane_and_repeats_count_once(spark, tmp_path):
    src = str(tmp_path / "src")
    good = [event(1, "10:00:00"), event(1, "10:00:00"), event(2, "10:00:10", kind="pause"), event(3, "10:00:20", user="u2")]
    land(src, "a", [*good, "not json", '{"room_id": "r"}', "[1, 2]", ""])
    land(src, "b", [good[0]])
    lanes = Z.music_lanes(Z.file_lines(spark, src, files_per_trigger=1))
    Z.start_corrupt_lane(lanes, str(tmp_path / "bad"), str(tmp_path / "c1")).awaitTermination()
    bad = spark.read.json(str(tmp_path / "bad"))
    assert rows(bad, "reason", "value") == [("not a JSON object", ""), ("not a JSON object", "[1, 2]"), ("not a JSON object", "not json"),
                                             ("room_id or song_id missing", '{"room_id": "r"}')]
    assert all(x.origin.endswith("/a") for x in bad.collect())
    q = (Z.once(lanes.events, ["room_id", "song_id", "user_id", "timestamp"]).writeStream.format("parquet").option("path", str(tmp_path / "ok"))
         .option("checkpointLocation", str(tmp_path / "c2")).trigger(availableNow=True).start())
    q.awaitTermination()
    assert rows(spark.read.parquet(str(tmp_path / "ok")), "user_id", "timestamp") == [("u1", "2024-01-01T10:00:00Z"), ("u2", "2024-01-01T10:00:20Z")]
    assert sum(p["numInputRows"] > 0 for p in q.recentProgress) == 2          # one file a micro-batch
    with pytest.raises(ValueError):
        Z.file_lines(spark, src, 1, "1m")


def test_late_events_are_dropped_by_the_watermark(spark, tmp_path):
    src, out = str(tmp_path / "src"), str(tmp_path / "out")
    keys = ["window_start", "room_id", "song_id"]
    for i, lines in enumerate([[event(1, "10:00:10")], [event(2, "10:01:25")], [event(3, "10:00:50"), event(4, "10:01:00")], [event(5, "10:09:00")], [event(6, "10:01:30")]]):
        land(src, f"f{i}", lines)
        T.start_metrics_stream(Z.music_lanes(Z.file_lines(spark, src)).events, out, str(tmp_path / "chk")).awaitTermination()
    got = {(str(r.window_start)[11:16], r.play_count) for r in T.read_current(spark, out, keys).collect()}
    # 30 s of lateness: 10:00:50 and 10:01:00 come in time, 10:01:30 after 10:09:00 does not
    assert got == {("10:00", 2), ("10:01", 2), ("10:09", 1)}


# ---- end of sessions -------------------------------------------------------------------

def test_end_of_sessions_twice_and_with_a_late_event(spark, tmp_path):
    src, hist = str(tmp_path / "src"), str(tmp_path / "history")
    f, table = FanOut(str(tmp_path / "out")), D.PreferenceTable(str(tmp_path / "users"))
    stream = lambda: Z.music_lanes(Z.file_lines(spark, src)).events
    ended = spark.createDataFrame([("r1",), ("r2",)], "session_id string")
    end = lambda: D.end_sessions(spark, ended, f, stream(), str(tmp_path / "chk"), hist, table)
    land(src, "a", [event(1, "10:00:00", song="v1", kind="like"), event(2, "10:00:01", song="v2", kind="skip"), event(3, "10:00:02", "AUX-R2", "v1", kind="dislike"),
                    event(4, "10:00:02", "AUX-R2", "v9", "u2", kind="replay"), event(5, "10:00:03", "AUX-R3", "v3", kind="like"), event(6, "10:00:04", song="v4", kind="play"),
                    event(7, "10:00:05", song="v5", user="", kind="like")])
    for _ in range(2):
        end()
        assert rows(table.read(spark), "user_id", *D.LISTS) == [("u1", ["v1"], ["v1"], ["v2"], []), ("u2", [], [], [], ["v9"])]
        assert rows(spark.read.parquet(hist), "session_id", "user_id", "video_id", "action", "score_delta") == [
            ("r1", "u1", "v1", "like", 2.0), ("r1", "u1", "v2", "skip", -0.5), ("r1", "u1", "v4", "play", 0.0),
            ("r2", "u1", "v1", "dislike", -2.0), ("r2", "u2", "v9", "replay", 1.5)]
    land(src, "b", [event(8, "10:00:09", song="v2", kind="like")])             # late: after the end
    assert end() == 3 == table.version(spark)
    assert rows(table.read(spark), "user_id", *D.LISTS)[0] == ("u1", ["v1", "v2"], ["v1"], ["v2"], [])
    assert spark.read.parquet(hist).where("video_id = 'v2'").first().action == "like" and spark.read.parquet(hist).count() == 5
    nobody = spark.createDataFrame([("other",)], "session_id string")
    assert D.end_sessions(spark, nobody, f, stream(), str(tmp_path / "chk"), hist, table) == 3


def test_a_merge_that_is_overtaken_is_done_again(spark, tmp_path):
    table = D.PreferenceTable(str(tmp_path / "users"))
    new = lambda u, s: spark.createDataFrame([(u, [s], [], [], [])], D.PREFERENCES.rsplit(",", 1)[0])
    other = iter([lambda: table.merge(spark, new("u1", "x")), lambda: None])
    assert table.merge(spark, new("u1", "y"), between=lambda: next(other)()) == 2
    assert rows(table.read(spark), "user_id", "liked_songs") == [("u1", ["x", "y"])]
    first = table.read(spark).first().last_updated
    table.merge(spark, new("u2", "z"))
    assert rows(table.read(spark), "user_id", "liked_songs") == [("u1", ["x", "y"]), ("u2", ["z"])]
    assert table.read(spark).where("user_id = 'u1'").first().last_updated == first
    assert rows(table.read(spark, 1), "user_id", "liked_songs") == [("u1", ["x"])]


def test_feedback_rules(spark):
    req = spark.createDataFrame([("s", "u", "v", "like"), ("s", "", None, "like"), ("s", "u", "v", "jump")], "session_id string, user_id string, video_id string, action string")
    assert [r.e for r in req.select(P.feedback_request_error(req).alias("e")).collect()] == [None, "missing: user_id,video_id", "invalid action"]
    assert rows(P.for_session(req.withColumn("n", F.monotonically_increasing_id() * 0), "s"), "action") == [("jump",), ("like",), ("like",)]
    ev = spark.createDataFrame([("r", "v", None, "", None), ("", "v", "a", "b", "c"), ("r", None, "a", "b", "c")], "room_id string, song_id string, song_name string, artist string, event_type string")
    assert rows(P.music_event_defaults(ev)) == [("r", "v", "Unknown", "Unknown", "Unknown")]
    users = spark.createDataFrame([("s", [("u1", None, "t"), ("u2", False, "t"), ("", True, "t"), ("u3", True, "")])], "session_id string, users array<struct<user_id string, isactive boolean, refresh_token string>>")
    assert rows(P.active_users(users)) == [("s", "u1"), ("s", "u3")] and rows(P.active_users(users, need_token=True)) == [("s", "u1")]
