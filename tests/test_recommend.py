"""Co-occurrence CF goldens (hand-computed index of the reference's tests) and invariants."""

from pyspark.sql import functions as F

from cadence.operators import recommend as R

POPULATION = {
    "user_a": ["vid_0", "vid_1", "vid_2"],
    "user_b": ["vid_0", "vid_1", "vid_3"],
    "user_c": ["vid_1", "vid_2", "vid_4"],
    "user_d": ["vid_5", "vid_6"],
}


def likes_df(spark, pop=POPULATION):
    return spark.createDataFrame([(u, v) for u, vs in pop.items() for v in vs], "user_id string, video_id string")


def test_cooccurrence_and_popularity(spark):
    likes = likes_df(spark)
    pairs = {(r.item_a, r.item_b): r.cooc for r in R.cooccurrence_pairs(likes).collect()}
    assert pairs == {("vid_0", "vid_1"): 2, ("vid_0", "vid_2"): 1, ("vid_0", "vid_3"): 1, ("vid_1", "vid_2"): 2,
                     ("vid_1", "vid_3"): 1, ("vid_1", "vid_4"): 1, ("vid_2", "vid_4"): 1, ("vid_5", "vid_6"): 1}
    pop = {r.video_id: r.popularity for r in R.popularity(likes).collect()}
    assert pop == {"vid_0": 2, "vid_1": 3, "vid_2": 2, "vid_3": 1, "vid_4": 1, "vid_5": 1, "vid_6": 1}


def test_hot_user_split_is_exact(spark):
    """Users above the hot threshold are split into item chunks; counts must not change."""
    import random
    rnd = random.Random(7)
    pop = {f"u{i}": [f"v{rnd.randrange(40)}" for _ in range(rnd.randrange(2, 30))] for i in range(30)}
    likes = likes_df(spark, pop)
    plain = {(r.item_a, r.item_b): r.cooc for r in R.cooccurrence_pairs(likes, chunk_items=10_000).collect()}
    split = {(r.item_a, r.item_b): r.cooc for r in R.cooccurrence_pairs(likes, chunk_items=3).collect()}
    brute = {}
    for vs in pop.values():
        s = sorted(set(vs))
        for i, a in enumerate(s):
            for b in s[i + 1:]:
                brute[(a, b)] = brute.get((a, b), 0) + 1
    assert plain == brute == split


def test_cf_scores_seed_vid0(spark):
    likes = likes_df(spark)
    idx, pop = R.cooccurrence_index(likes), R.popularity(likes)
    seeds = spark.createDataFrame([(1, "vid_0")], "session_id long, video_id string")
    played = spark.createDataFrame([], "session_id long, video_id string")
    got1 = {r.video_id: r.cf_score for r in R.cf_cooccurrence_scores(seeds, idx, pop, played, None, 1).collect()}
    assert abs(got1["vid_1"] - 2 / 3) < 1e-12 and got1["vid_3"] == 1.0 and "vid_5" not in got1
    got2 = {r.video_id: r.cf_score for r in R.cf_cooccurrence_scores(seeds, idx, pop, played, None, 2).collect()}
    assert set(got2) == {"vid_1"} and "vid_2" not in got2


def test_cf_max_not_sum(spark):
    # song_A co-liked with seed s1 by 10 of its 11 likers; song_B with s2 by 5 of 10
    rows = [(f"a{i}", "song_A") for i in range(11)] + [(f"a{i}", "s1") for i in range(10)]
    rows += [(f"b{i}", "song_B") for i in range(10)] + [(f"b{i}", "s2") for i in range(5)]
    likes = spark.createDataFrame(rows, "user_id string, video_id string")
    seeds = spark.createDataFrame([(1, "s1"), (1, "s2")], "session_id long, video_id string")
    played = spark.createDataFrame([], "session_id long, video_id string")
    got = {r.video_id: r.cf_score for r in
           R.cf_cooccurrence_scores(seeds, R.cooccurrence_index(likes), R.popularity(likes), played).collect()}
    assert abs(got["song_A"] - 10 / 11) < 1e-12 and abs(got["song_B"] - 0.5) < 1e-12


def test_playlist_delta_equals_rebuild(spark):
    """Adding the playlist as a pseudo-user via the per-session delta equals rebuilding."""
    likes = likes_df(spark)
    playlist = spark.createDataFrame([(1, "vid_2"), (1, "vid_3")], "session_id long, video_id string")
    seeds = spark.createDataFrame([(1, "vid_0"), (1, "vid_2"), (1, "vid_3")], "session_id long, video_id string")
    played = spark.createDataFrame([], "session_id long, video_id string")
    delta = {r.video_id: r.cf_score for r in R.cf_cooccurrence_scores(
        seeds, R.cooccurrence_index(likes), R.popularity(likes), played, playlist).collect()}
    rebuilt_likes = likes.unionByName(spark.createDataFrame([("_pl", "vid_2"), ("_pl", "vid_3")], likes.schema))
    rebuilt = {r.video_id: r.cf_score for r in R.cf_cooccurrence_scores(
        seeds, R.cooccurrence_index(rebuilt_likes), R.popularity(rebuilt_likes), played).collect()}
    assert delta == rebuilt


def test_session_score_normalisation(spark):
    ts = spark.createDataFrame([(1, "vid_7", 2.0), (1, "vid_8", -1.0), (1, "vid_9", 0.0), (2, "x", 0.0)],
                               "session_id long, video_id string, score double")
    got = {(r.session_id, r.video_id): r.session_score for r in R.normalized_session_scores(ts).collect()}
    assert got == {(1, "vid_7"): 1.0, (1, "vid_8"): -0.5, (1, "vid_9"): 0.0, (2, "x"): 0.0}


def test_topk_cosine_matches_brute_force(spark):
    import numpy as np
    rng = np.random.default_rng(3)
    cat = spark.createDataFrame([(i, rng.normal(size=8).tolist()) for i in range(60)],
                                "video_id long, embedding array<double>")
    q = spark.createDataFrame([(s, rng.normal(size=8).tolist(), s % 3) for s in range(7)],
                              "session_id long, vector array<double>, k_extra long")
    got = R.topk_cosine(q, cat, 5, query_rows=3, item_rows=17)
    got = {(r.session_id, r.video_id) for r in got.where(F.col("_r") <= 5).collect()}
    E = np.array([r.embedding for r in cat.orderBy("video_id").collect()])
    E = E / np.linalg.norm(E, axis=1, keepdims=True)
    want = set()
    for r in q.collect():
        v = np.array(r.vector) / np.linalg.norm(r.vector)
        for i in np.argsort(-(E @ v))[:5]:
            want.add((r.session_id, int(i)))
    assert got == want


def test_gru_weight_ramp(spark):
    df = spark.createDataFrame([(n, a) for n in range(0, 9) for a in (True, False)], "n int, a boolean")
    got = {(r.n, r.a): r.w for r in df.select("n", "a", R.gru_weight_expr(F.col("n"), F.col("a")).alias("w")).collect()}
    assert got[(3, True)] == 0.30 and got[(4, True)] == 0.20 and got[(5, True)] == 0.25 and got[(9 - 1, True)] == 0.30
    assert all(got[(n, False)] == 0.0 for n in range(9))
