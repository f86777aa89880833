"""Group vectors by lists of songs against the means of the members' vectors."""

import numpy as np
import pytest

from cadence.operators import groupmeans as G
from cadence.operators import recommend as R


@pytest.fixture
def inputs(spark):
    rng = np.random.default_rng(8)
    songs = [(i, rng.normal(size=4).tolist()) for i in range(40)] + [(3, [9.0, 0.0, 1.0, 2.0]), (50, [0.0] * 4), (None, [1.0] * 4)]
    songs += [(60, [1.0, 0.0, 0.0, 0.0]), (61, [2.0, 0.0, 0.0, 0.0])]
    likes = [(f"u{rng.integers(0, 9)}", int(v)) for v in rng.integers(0, 56, 150)] + [("zero", 50), ("net", 60), (None, 1), ("u1", None), ("gone", 99), ("u1", 3)]
    dislikes = [(f"u{rng.integers(0, 9)}", int(v)) for v in rng.integers(0, 56, 40)] + [("net", 61), ("nobody", 1)]
    members = [(s, f"u{(s * j) % 11}") for s in range(14) for j in range(3)] + [(20, "zero"), (21, "net"), (22, "gone"), (23, None), (None, "u1"), (1, "u1"), (1, "u1")]
    playlist = [(s, int(v)) for s in range(0, 30, 2) for v in rng.integers(0, 45, 5)] + [(None, 4), (2, None)]
    pairs = lambda rows, k, t: spark.createDataFrame(rows, f"{k} {t}, video_id long")
    return (spark.createDataFrame(members, "session_id long, user_id string"), pairs(likes, "user_id", "string"), pairs(dislikes, "user_id", "string"),
            spark.createDataFrame(songs, "video_id long, embedding array<double>"), pairs(playlist, "session_id", "long"))


@pytest.mark.parametrize("limits", [{}, {"LIST_SONGS": 12}, {"MAX_SONGS": 5}])
def test_lists_give_the_means_of_the_members_vectors(spark, inputs, monkeypatch, limits):
    members, likes, dislikes, catalog, playlist = inputs
    want = R.with_fallback_vector(members, R.group_vectors(R.user_vectors(*inputs)), catalog).collect()
    for name, n in limits.items():
        monkeypatch.setattr(G, name, n)
    got = R.session_vectors(*inputs).collect()
    at = {r.session_id: r.vector for r in want}
    assert len(got) == len(want) == len(at) and {r.session_id for r in got} == at.keys()
    assert all(np.allclose(r.vector, at[r.session_id], atol=1e-12) for r in got)


def test_several_blocks(inputs, monkeypatch):
    want = {r.session_id: r.vector for r in R.session_vectors(*inputs).collect()}
    monkeypatch.setattr(G.weighted_means, "__defaults__", (7,))
    monkeypatch.setattr(G, "ROWS_PER_SONG", 0)
    got = R.session_vectors(*inputs).collect()
    assert len(got) == len(want) and all(np.allclose(r.vector, want[r.session_id], atol=1e-12) for r in got)


def test_members_travel_without_vectors(spark, inputs):
    """Short lists: the rows of members carry no vector into the exchange."""
    members, likes, dislikes, catalog, playlist = inputs
    songs = G.song_places(catalog)
    prefs = spark.createDataFrame([("u1", [1.0, 0.0, 0.0, 0.0], 1, None, None)], "user_id string, pos array<double>, liked_count long, neg array<double>, disliked_count long")
    row = G.member_lists(prefs, likes.where("user_id = 'u1'"), dislikes, songs).first()
    assert row.vector is None and len(row.liked) % 2 == 0 and row.own == 1.0
