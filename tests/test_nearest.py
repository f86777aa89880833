"""The metric index against a full product: ties, zero vectors, exclusions, bonuses, many clusters."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from cadence.operators import nearest as N
from cadence.operators import recommend as R


def clustered(rng, n, centres=12, spread=0.15, dim=8):
    c = rng.normal(size=(centres, dim))
    return c[rng.integers(0, centres, n)] + spread * rng.normal(size=(n, dim))


def brute(songs, sessions, marks, k, weight):
    ids = sorted(songs)
    e = N.unit_rows(np.array([songs[i] for i in ids], float))
    out = set()
    for s, v in sessions.items():
        cos = np.round(N.unit_rows(np.array([v], float))[0] @ e.T, N.DECIMALS)
        rows = []
        for i, c in zip(ids, cos):
            own = [m for m in marks if m[:2] == (s, i)]
            if not any(m[2] for m in own):
                bonus = sum(m[3] for m in own)
                rows.append((-(c + weight * bonus), i, bonus))
        out |= {(s, i, r, round(float(-t), 9), b) for r, (t, i, b) in enumerate(sorted(rows)[:k], 1)}
    return out


def got(df):
    return {(r.session_id, r.video_id, r["rank"], round(r.total, 9), r.bonus) for r in df.collect()}


def inputs(spark, songs, sessions, marks):
    return (spark.createDataFrame(list(songs.items()), "video_id string, embedding array<double>"),
            spark.createDataFrame(list(sessions.items()), "session_id string, vector array<double>"),
            spark.createDataFrame(marks, "session_id string, video_id string, excluded boolean, bonus double"))


@pytest.mark.parametrize("options", [{}, {"fine_songs": 16}, {"chunk_songs": 60, "fine_songs": 8}, {"chunk_songs": 25, "fine_songs": 5, "fit_songs": 40}])
def test_index_equals_a_full_product(spark, options):
    rng = np.random.default_rng(4)
    songs = {f"v{i:03d}": x.tolist() for i, x in enumerate(clustered(rng, 300))}
    songs |= {f"same{i:02d}": [1.0] + [0.0] * 7 for i in range(40)} | {"zero": [0.0] * 8}
    sessions = {f"s{i}": x.tolist() for i, x in enumerate(clustered(rng, 22))} | {"tied": [2.0] + [0.0] * 7, "none": [0.0] * 8}
    names = list(songs)
    marks = [(s, names[j], bool(rng.random() < 0.6), float(rng.normal())) for s in sessions for j in rng.choice(len(names), rng.integers(0, 25), replace=False)]
    marks += [("tied", f"same{i:02d}", True, 0.0) for i in range(0, 40, 2)] + [("s1", "not-in-catalog", False, 9.0), ("nobody", "v001", False, 1.0)]
    marks += [("s2", n, True, 0.0) for n in names[:-3]]      # nearly everything is excluded
    cat, q, m = inputs(spark, songs, sessions, marks)
    index = N.MetricIndex(cat, **options)
    assert (index.n_coarse > 1) == ("chunk_songs" in options)
    for k in (1, 7):
        assert got(index.top_items(q, k, m, block_sessions=5, weight=0.3)) == brute(songs, sessions, marks, k, 0.3)
    assert got(index.top_items(q, 400)) == brute(songs, sessions, [], 400, 1.0)


def test_far_clusters_are_not_scored(spark):
    rng = np.random.default_rng(9)
    songs = {i: x.tolist() for i, x in enumerate(clustered(rng, 4000, centres=40, spread=0.03))}
    sessions = {i: x.tolist() for i, x in enumerate(clustered(rng, 60, centres=40, spread=0.03))}
    cat = spark.createDataFrame(list(songs.items()), "video_id long, embedding array<double>")
    q = spark.createDataFrame(list(sessions.items()), "session_id long, vector array<double>")
    shares = []
    for options in ({"fine_songs": 50}, {"chunk_songs": 500, "fine_songs": 50}):
        scored = spark.sparkContext.accumulator(0)
        assert got(N.MetricIndex(cat, **options).top_items(q, 5, scored=scored)) == brute(songs, sessions, [], 5, 1.0)
        shares.append(scored.value / (len(songs) * len(sessions)))
    assert max(shares) < 0.4


def test_cbf_takes_scores_and_exclusions_from_marks(spark):
    cat = spark.createDataFrame([(i, [1.0, i / 10]) for i in range(20)], "video_id long, embedding array<double>")
    q = spark.createDataFrame([(1, [1.0, 0.0]), (2, [1.0, 2.0])], "session_id long, vector array<double>")
    ex = spark.createDataFrame([(1, 0), (1, 3), (2, 19)], "session_id long, video_id long")
    ss = spark.createDataFrame([(1, 3, 1.0), (1, 9, 1.0), (2, 18, -1.0)], "session_id long, video_id long, session_score double")
    rows = R.cbf_scores(q, ex, ss, cat, 3).orderBy("session_id", "rank").collect()
    assert [(r.session_id, r.video_id, r.session_score) for r in rows] == [(1, 9, 1.0), (1, 1, 0.0), (1, 2, 0.0), (2, 17, 0.0), (2, 16, 0.0), (2, 15, 0.0)]
    assert rows[0].final_score == pytest.approx(rows[0].cbf_score + 0.3)


def test_index_of_nothing(spark):
    cat, q, m = inputs(spark, {}, {"s": [1.0]}, [])
    assert N.MetricIndex(cat).top_items(q, 3, m).count() == 0
    cat, q, m = inputs(spark, {"a": [1.0]}, {}, [("s", "a", True, 0.0)])
    assert N.MetricIndex(cat).top_items(q, 3, m).count() == 0
