"""Plays travel as ids, blocks get each song's vector once, samples are used in the task that made them."""

import pyarrow as pa

from cadence.operators import sequences as Q


def test_samples_over_buckets_and_blocks(spark):
    n, songs = 2, {v: [float(v), v + 0.5] for v in range(7)}
    plays = [(s, i, (s + i * i) % 8, i % 2) for s, length in ((1, 450), (2, 1), (3, 201)) for i in range(1, length + 1)]
    p = spark.createDataFrame(plays, "session_id long, play_order long, video_id long, liked_flag int")
    cat = spark.createDataFrame(list(songs.items()), "video_id long, embedding array<float>")
    want = {}
    for s in (1, 2, 3):
        known = [(v, f) for k, _, v, f in plays if k == s and v in songs]
        for at in range(1, len(known)):
            rows = [[*songs[v], float(f)] for v, f in known[max(0, at - n):at]]
            want[s, at + 1] = (len(rows), sum([[0.0] * 3] * (n - len(rows)) + rows, []), songs[known[at][0]])
    got = Q.prefix_tensors(p, cat, "skip", n, block_plays=40).collect()
    assert len(got) == len(want) and {(r.session_id, r.play_order): (r["rows"], r.input, r.target) for r in got} == want

    def size(batch):
        return pa.RecordBatch.from_arrays([batch.column("session_id"), pa.array([sum(x) for x in batch.column("input").to_pylist()])], ["session_id", "total"])

    made = Q.prefix_tensors(p, cat, "skip", n, derive=(size, "session_id long, total double"))
    assert sorted(r.total for r in made.collect()) == sorted(sum(x[1]) for x in want.values())
    assert made.columns == ["session_id", "total"]
