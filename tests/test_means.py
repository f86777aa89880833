"""Mean vectors by cells against a plain mean: chunks, repeats, unknown and null ids, repeated songs."""

import numpy as np
import pytest

from cadence.operators import means as N
from cadence.operators import nearest as X
from cadence.operators.sequences import recent_mean_model


@pytest.mark.parametrize("options", [{}, {"cell_rows": 40, "chunk_songs": 7}])
def test_means_equal_plain_means(spark, options):
    rng = np.random.default_rng(2)
    songs = [(f"v{i}", rng.normal(size=3).tolist()) for i in range(30)] + [("v1", [9.0, 9.0, 9.0]), (None, [1.0, 1.0, 1.0])]
    rows = [(int(s), f"u{s % 3}", f"v{rng.integers(0, 33)}") for s in rng.integers(0, 20, 300)] + [(7, None, "v2"), (7, None, None), (99, "u0", "gone")]
    df = spark.createDataFrame(rows, "session_id long, user_id string, video_id string")
    cat = spark.createDataFrame(songs, "video_id string, embedding array<double>")
    want = {}
    for s, u, v in rows:
        want.setdefault((s, u), []).extend(e for i, e in songs if i is not None and i == v)
    want = {k: (np.mean(v, axis=0), len(v)) for k, v in want.items() if v}
    got = {(r.session_id, r.user_id): (r.vector, r.n) for r in N.vector_means(df, ["session_id", "user_id"], cat, **options).collect()}
    assert got.keys() == want.keys()
    assert all(got[k][1] == want[k][1] and np.allclose(got[k][0], want[k][0], atol=1e-12) for k in want)


def test_rows_travel_without_vectors(spark):
    """No exchange of the rows carries a vector of the catalog."""
    cat = spark.createDataFrame([(1, [1.0, 0.0])], "video_id long, embedding array<double>")
    df = spark.createDataFrame([(1, 1)], "session_id long, video_id long")
    plan = N.vector_means(df, ["session_id"], cat)._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan and "summarize" not in plan.lower()


@pytest.mark.parametrize("options", [{}, {"chunk_songs": 12, "fine_songs": 4, "fit_songs": 30}])
def test_shared_exclusions_are_lists_per_owner(spark, options):
    rng = np.random.default_rng(5)
    cat = spark.createDataFrame([(i, rng.normal(size=4).tolist()) for i in range(60)], "video_id long, embedding array<double>")
    q = spark.createDataFrame([(s, rng.normal(size=4).tolist()) for s in range(9)], "session_id long, vector array<double>")
    links = spark.createDataFrame([(s, f"u{(s + j) % 4}") for s in range(9) for j in range(2)] + [(1, "nobody")], "session_id long, owner string")
    owned = spark.createDataFrame([(f"u{i}", int(v)) for i in range(4) for v in rng.integers(0, 70, 15)], "owner string, video_id long")
    scores = [(s, int(v), False, 0.5) for s in range(9) for v in rng.integers(0, 60, 4)]
    marks = spark.createDataFrame(scores, "session_id long, video_id long, excluded boolean, bonus double")
    index = X.MetricIndex(cat, **options)
    rows = links.join(owned, "owner").selectExpr("session_id", "video_id", "true as excluded", "0D as bonus")
    key = lambda df: sorted((r.session_id, r["rank"], r.video_id, round(r.total, 9)) for r in df.collect())
    assert key(index.top_items(q, 6, marks, shared=(links, owned), block_sessions=4)) == key(index.top_items(q, 6, marks.union(rows), block_sessions=4))


def test_rows_joined_before_count_once(spark):
    """A catalog with a song twice: the last plays are cut after the join, so a row is not multiplied again."""
    cat = spark.createDataFrame([(1, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [0.0, 1.0])], "video_id long, embedding array<double>")
    plays = spark.createDataFrame([(5, 1, 2), (5, 2, 1)], "session_id long, play_order long, video_id long")
    state = spark.createDataFrame([(5, True)], "session_id long, gru_active boolean")
    assert [round(x, 9) for x in recent_mean_model(plays, cat, state, 3).first().vector] == [round(2 / 3, 9), round(1 / 3, 9)]
