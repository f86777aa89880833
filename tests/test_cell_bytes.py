"""What travels to the cells of R2: places as gaps, columns deflated, matrices of narrow numbers."""

import numpy as np
import pytest

from cadence.functions import vectors as V
from cadence.operators import cofilter as C


@pytest.mark.parametrize("dtype", ["uint8", "uint16"])
def test_gaps_round_trip(dtype):
    rng = np.random.default_rng(1)
    lists = [np.sort(rng.choice(n, k, replace=False)) for n, k in ((9, 9), (300, 1), (200_000, 40), (70_000, 2_000))]
    lists += [np.array([], int), np.array([254]), np.array([255, 256, 511, 767]), np.array([65_534, 65_535, 131_071]), np.array([], int)]
    flat, taken = V.gaps(np.concatenate(lists), np.array([len(x) for x in lists]), dtype)
    for packed, want in zip(np.split(flat, np.cumsum(taken)[:-1]), lists):
        assert V.places_of(packed.tobytes(), dtype).tolist() == want.tolist()


def test_packed_places_keep_null_and_empty(spark):
    df = spark.createDataFrame([(1, [0, 3, 900]), (2, None), (3, [])], "k int, places array<int>")
    got = {r.k: r.places for r in V.packed_places(df, "places", "uint8").collect()}
    assert V.places_of(bytes(got[1]), "uint8").tolist() == [0, 3, 900] and got[2] is None and got[3] == b""


def test_one_chunk_holds_four_times_the_songs_if_counts_are_small(spark):
    """Four bytes a number would cut the candidates into two chunks, whose lists need a sort over all of them."""
    songs = range(40)
    index = spark.createDataFrame([(a, b, 2 + (a + b) % 3) for a in songs for b in songs if a != b], "video_id long, other_id long, cooc long")
    pop = spark.createDataFrame([(a, 5) for a in songs], "video_id long, popularity long")
    own = spark.createDataFrame([(1, 0), (1, 1), (2, 7)], "session_id long, video_id long")
    played = spark.createDataFrame([(1, 3)], "session_id long, video_id long")
    found, whole = C.best_cooccurrence(C.Seeds(own), index, pop, played, None, 2, matrix_cells=1000)
    assert whole
    best = {(s, c): max(2 + (c + g) % 3 for g in seeds if g != c) / 5 for s, seeds in ((1, (0, 1)), (2, (7,))) for c in songs if any(g != c for g in seeds)}
    assert {(r.session_id, r.video_id): r.cf_score for r in found.collect()} == {k: v for k, v in best.items() if k != (1, 3)}


@pytest.mark.parametrize("high", [3, 300, 70_000])
def test_counts_of_any_size(spark, high):
    index = spark.createDataFrame([(1, 2, high), (2, 1, high), (1, 3, 2), (3, 1, 2)], "video_id long, other_id long, cooc long")
    pop = spark.createDataFrame([(1, 1), (2, high * 2), (3, 4)], "video_id long, popularity long")
    own = spark.createDataFrame([(1, 1)], "session_id long, video_id long")
    found, _ = C.best_cooccurrence(C.Seeds(own), index, pop, own.where("false"), None, 2)
    assert {r.video_id: r.cf_score for r in found.collect()} == {2: 0.5, 3: 0.5}


def test_a_dense_column_takes_less_than_a_byte_a_number():
    import pyarrow as pa
    rng = np.random.default_rng(2)
    counts = rng.poisson(1.4, 10_000)
    at = np.flatnonzero(counts)
    batch = pa.RecordBatch.from_arrays([pa.array([5]), pa.array([at.tolist()], pa.list_(pa.int32())), pa.array([counts[at].tolist()], pa.list_(pa.int64()))], ["v", "p", "c"])
    packed = next(C._deflated("uint8")(iter([batch]))).column(1)[0].as_py()
    got_at, got = C._column(packed, "uint8")
    assert got_at.tolist() == at.tolist() and got.tolist() == counts[at].tolist()
    assert len(packed) < 10_000
