"""Cases taken from the reference's rules that the generated tables do not reach."""

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from cadence.functions import scalars as S
from cadence.operators import ingest as I
from cadence.operators import monitoring as M
from cadence.operators import prefs as P
from cadence.operators import quality as Q
from cadence.operators import recommend as R


def one(spark, fn, values, kind="string"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")
    return [r.x for r in df.select("i", fn("v").alias("x")).orderBy("i").collect()]


def test_lenient_millis_takes_what_python_float_takes(spark):
    cases = {"12d": 0, "1f": 0, "0x1p3": 0, " 12.9 ": 12, "1_000.5": 1000, "1__0": 0, "-3e2": -300, ".5": 0, "5.": 5, "nan": 0,
             "": 0, "abc": 0, None: 0, "inf": None, "-Infinity": None, "1e300": None, "9223372036854775808": None}
    assert one(spark, S.lenient_millis, list(cases)) == list(cases.values())
    errors = one(spark, S.millis_error, ["inf", "1e300", "12d", "7"])
    assert errors == ["cannot convert float infinity to integer", "integer out of 64-bit range", None, None]


def test_lenient_int_takes_what_python_int_takes(spark):
    cases = {"1_000": 1000, "\t7\n": 7, "+5": 5, "-5": -5, "3.7": 0, "1e3": 0, "_1": 0, "": 0, None: 0, "12L": 0}
    assert one(spark, S.lenient_int, list(cases)) == list(cases.values())


def test_js_or_goes_by_type(spark):
    df = spark.createDataFrame([("0", 0, 0.0, False, ""), (None, 5, float("nan"), True, "x")], "s string, i int, d double, b boolean, e string")
    got = df.select(S.js_or("s", default="z").alias("s"), S.js_or("i", default=9).alias("i"), S.js_or("d", default=1.5).alias("d"),
                    S.js_or("b", default=True).alias("b"), S.js_or("e", default="w").alias("e")).collect()
    assert [tuple(r) for r in got] == [("0", 9, 1.5, True, "w"), ("z", 5, 1.5, True, "x")]


def test_rejected_record_is_whole(spark):
    raw = spark.createDataFrame([(1, "Title", "v1", "inf", "10", None, "3", "extra")],
                                "session_id long, track_title string, video_id string, trackTimeMillis string, view_count string, "
                                "like_count string, comment_count string, genre string")
    r = I.invalid_tracks(I.validate(raw)).first()
    assert r.error == "cannot convert float infinity to integer"
    assert json.loads(r.record_json) == {"session_id": 1, "track_title": "Title", "video_id": "v1", "trackTimeMillis": "inf",
                                         "view_count": "10", "like_count": None, "comment_count": "3", "genre": "extra"}


def test_lookup_of_null_title_and_artist(spark):
    tracks = spark.createDataFrame([("Song (live)", None, 1), (None, "A", 2), ("Song (live)", "B", 3), ("Other", "C", 4)],
                                   "track_title string, artist_name string, n int")
    meta = spark.createDataFrame([("Song", "Pop", "US", "Album", "7", "Found", "200"), ("Song B", "Rock", "GB", "Live", "8", "B!", "300")],
                                 "term string, genre string, country string, collection_name string, collection_id string, "
                                 "found_artist string, found_millis string")
    got = {r.n: (r.genre, r.country, r.found_artist, r.found_millis) for r in I.join_metadata(tracks, meta).collect()}
    assert got == {1: ("Pop", "US", "Found", "200"), 2: ("Unknown", "", "", ""), 3: ("Rock", "GB", "B!", "300"), 4: ("Unknown", "", "", "")}


def test_music_event_with_null_valued_keys_is_kept(spark):
    raw = spark.createDataFrame([('{"room_id": null, "song_id": "s", "event_type": "like"}',), ('{"song_id": "s", "event_type": "like"}',),
                                 ('{"room_id": "r", "song_id": "s", "action": "skip"}',)], "value string")
    assert P.parse_music_events(raw).count() == 2


def test_songs_outside_the_catalog_give_no_cf_signal(spark):
    likes = spark.createDataFrame([(u, v) for u in "abc" for v in ("in_1", "out_1")], "user_id string, video_id string")
    catalog = spark.createDataFrame([("in_1", [1.0, 0.0]), ("in_2", [0.6, 0.8])], "video_id string, embedding array<double>")
    seeds = spark.createDataFrame([(1, "in_1")], "session_id long, video_id string")
    played = spark.createDataFrame([(1, "in_1")], "session_id long, video_id string")
    cand = spark.createDataFrame([(1, "in_2")], "session_id long, video_id string")
    idx, pop = R.cooccurrence_index(likes), R.popularity(likes)
    assert R.cf_cooccurrence_scores(seeds, idx, pop, played, catalog=catalog).count() == 0
    got = R.cf_for_candidates(cand, seeds, idx, pop, played, catalog).first()
    assert got.cf_score == pytest.approx(0.8)                   # the embedding fallback: (0.6 + 1) / 2


def test_topk_ties_strings_and_long_exclusion_lists(spark):
    rng = np.random.default_rng(0)
    same = [(f"s{i:03d}", [1.0, 2.0]) for i in range(200)]
    other = [(f"t{i:03d}", rng.normal(size=2).tolist()) for i in range(100)]
    cat = spark.createDataFrame(same + other, "video_id string, embedding array<double>")
    q = spark.createDataFrame([("x", [1.0, 2.0], 0), ("y", [1.0, 2.0], 150), ("z", [0.0, 0.0], 0), ("w", rng.normal(size=2).tolist(), 3)],
                              "session_id string, vector array<double>, k_extra int")
    rows = R.topk_cosine(q, cat, 5, query_rows=2, item_rows=40).collect()
    ids, e = [r[0] for r in same + other], np.array([r[1] for r in same + other])
    e = e / np.linalg.norm(e, axis=1, keepdims=True)
    for r in q.collect():
        v = np.array(r.vector)
        n = np.linalg.norm(v)
        s = np.round(e @ (v / n if n else v), 12)
        want = sorted(range(300), key=lambda i: (-s[i], ids[i]))[:5 + r.k_extra]
        got = sorted((x for x in rows if x.session_id == r.session_id and x._r <= 5 + r.k_extra), key=lambda x: x._r)
        assert [x.video_id for x in got] == [ids[i] for i in want]


def test_popularity_bias_of_an_unpopular_catalog_and_a_missing_column(spark):
    recs = spark.createDataFrame([(1, 0.5)], "session_id long, popularity_score double")
    cat = spark.createDataFrame([(0.0,), (0.0,)], "popularity_score double")
    r = M.popularity_bias(recs, cat).first()
    assert r.popularity_ratio == 500_000.0 and r.popularity_flagged
    r = M.popularity_bias(recs, cat.select(F.lit(1).alias("x"))).first()
    assert (r.popularity_flagged, r.reason) == (False, "column_missing")


def test_disparity_is_of_rounded_means(spark):
    rows = [(1, "a", 0.15006)] * 3 + [(1, "b", 0.00001)] * 3
    r = M.score_disparity(spark.createDataFrame(rows, "session_id long, genre string, final_score double")).first()
    assert r.disparity == 0.1501 and r.disparity_flagged
    rows = [(1, "a", 0.15004)] * 3 + [(1, "b", 0.0)] * 3 + [(1, None, 9.0)] * 2
    r = M.score_disparity(spark.createDataFrame(rows, "session_id long, genre string, final_score double")).first()
    assert r.disparity == 0.15 and not r.disparity_flagged
    table = {x.genre: (x.mean_score, x.std_score, x.n) for x in M.genre_scores(
        spark.createDataFrame(rows + [(1, "c", 0.3)], "session_id long, genre string, final_score double")).collect()}
    assert table["unknown"] == (9.0, 0.0, 2) and table["c"] == (0.3, 0.0, 1)


def test_production_shares_cover_all_plays_and_blank_genres(spark):
    plays = [(1, "Pop ")] * 100 + [(1, "rock")] * 400 + [(1, "  "), (1, None)] + [(2, "jazz")] * 5
    p = M.production_distribution(spark.createDataFrame(plays, "session_id long, genre string"),
                                  spark.createDataFrame([(1,)], "session_id long"))
    assert {r.genre: round(r.p, 6) for r in p.collect()} == {"pop": round(100 / 502, 6), "rock": round(400 / 502, 6), "other": round(2 / 502, 6)}


def test_drift_report_lists_production_genres_only(spark):
    p = spark.createDataFrame([("pop", 0.9), ("rock", 0.1)], "genre string, p double")
    q = spark.createDataFrame([("pop", 0.5), ("jazz", 0.4), ("rock", 0.1)], "genre string, q double")
    r = M.drift_report(p, q).first()
    assert [tuple(x) for x in r.top_drifted_genres] == [("pop", 0.9, 0.5, 0.4)]
    assert r.status == "completed" and r.drift_detected and r.recommendation == "Trigger retraining"
    r = M.drift_report(p.where("p > 1"), q).first()
    assert (r.status, r.kl_divergence, r.drift_detected) == ("skipped", 0.0, False) and r.top_drifted_genres == []


def test_bias_report_texts_and_empty_sessions(spark):
    recs = [(1, g, 0.9, 0.5) for g in ["pop"] * 20 + ["rock"] * 5 + ["jazz"] * 3 + ["hip-hop"] * 2]
    recs = spark.createDataFrame(recs, "session_id long, genre string, popularity_score double, final_score double")
    cat = spark.createDataFrame([(g, 0.3) for g in ["pop", "rock", "jazz", "hip-hop", "folk"] * 4], "genre string, popularity_score double")
    rows = {r.session_id: r for r in M.bias_report(recs, cat, spark.createDataFrame([(1,), (2,)], "session_id long")).collect()}
    assert rows[1].over_represented == ["pop"] and rows[1].under_represented == ["folk"] and rows[1].popularity_ratio == 3.0
    assert rows[1].mitigation_suggestions[0].startswith("Genres ['pop'] are over-represented.")
    assert "(ratio: 3.0)" in rows[1].mitigation_suggestions[2] and rows[1].overall_bias_detected
    assert rows[2].recommendation_count == 0 and rows[2].entropy_ratio == 1.0
    assert rows[2].mitigation_suggestions == ["Bias evaluation unavailable — check logs."]


def test_rebalancing_of_a_label_with_one_row_and_of_copies(spark):
    rows = [(1, f"r{i}", "Pop") for i in range(3000)] + [(1, "only", "Jazz")]
    df = spark.createDataFrame(rows, "session_id long, row_id string, genre string")
    up = Q.upsample(df, "genre")
    assert up.where("genre = 'Jazz'").count() == 1 + int(np.ceil((0.05 * 3001 - 1) / 0.95))
    down = Q.downsample(up, "genre")
    kept = [r.row_id for r in down.where("genre = 'Pop'").collect()]
    assert len(kept) == len(set(kept)) == int((up.count() - 3000) * 0.6 / (1.0 - 0.6))


def test_a_cluster_without_a_shared_folder_is_refused(spark, monkeypatch):
    from cadence import session

    class Conf:
        def get(self, key, default=None):
            return None

    class Context:
        master = "spark://somewhere:7077"

    class Fake:
        conf, sparkContext = Conf(), Context()

    monkeypatch.delenv("CADENCE_CHECKPOINT_DIR", raising=False)
    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        session.ensure_checkpoint_dir(Fake())
