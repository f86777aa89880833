"""Distributed row numbers, chunked sequences and training samples against brute force."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from cadence.operators import numbering as B
from cadence.operators import sequences as Q


def sessions(seed=1):
    """One session holds most plays; some have a single one; a null session id."""
    rng = random.Random(seed)
    rows = [(s, t) for s, n in [(5, 700), (1, 1), (2, 40), (9, 16), (7, 2), (None, 5)] for t in range(n)]
    rng.shuffle(rows)
    return [(s, t * 3 + (s or 0), f"v{rng.randrange(12)}", rng.randrange(2)) for s, t in rows]


def test_numbers_of_a_session_that_goes_over_many_partitions(spark):
    rows = sessions()
    df = spark.createDataFrame(rows, "session_id long, at long, video_id string, liked_flag int").repartition(6)
    old = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "13")
    try:
        out = B.numbered(df, "session_id", ["at"], "n")
        assert out.columns == ["session_id", "at", "video_id", "liked_flag", "n"]
        got = out.collect()
        assert B.numbered(df.where("false"), "session_id", ["at"], "n").count() == 0
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)
    by = {}
    for r in rows:
        by.setdefault(r[0], []).append(r)
    want = {(*r, i) for s, x in by.items() for i, r in enumerate(sorted(x, key=lambda r: r[1]), 1)}
    assert len(got) == len(rows) and set(map(tuple, got)) == want


def test_sequences_come_in_chunks(spark):
    rows = sessions()
    plays = B.numbered(spark.createDataFrame(rows, "session_id long, at long, video_id string, liked_flag int"), "session_id", ["at"]).drop("at")
    got = {}
    for r in Q.play_sequences(plays, chunk=50).orderBy("session_id", "chunk").collect():
        assert len(r.sequence) <= 50
        got.setdefault(r.session_id, []).extend((x.play_order, x.video_id) for x in r.sequence)
    for s in (5, 2, 9, 7, None):
        assert got[s] == [(i, v) for i, (_, v) in enumerate(sorted((r[1], r[2]) for r in rows if r[0] == s), 1)]
    assert 1 not in got
    with pytest.raises(ValueError):
        Q.play_sequences(plays, min_len=3, chunk=2)
    subs = {(r.session_id, r.sub_session): r.n for r in Q.with_sub_session(plays).groupBy("session_id", "sub_session").agg(F.count("*").alias("n")).collect()}
    assert subs[2, 4] == 10 and subs[9, 2] == 6 and (9, 3) not in subs


def brute_samples(rows, emb, rule, n):
    """As the reference's data sets: whole prefix known (stop) or unknown plays left out (skip)."""
    out = {}
    by = {}
    for s, at, v, liked in rows:
        by.setdefault(s, []).append((at, v, liked))
    for s, seq in by.items():
        seq = [(v, liked) for _, v, liked in sorted(seq)]
        if rule == "skip":
            seq = [x for x in seq if x[0] in emb]
        for i in range(1, len(seq)):
            if seq[i][0] not in emb or any(v not in emb for v, _ in seq[:i]):
                continue
            x = [np.append(emb[v], liked) for v, liked in seq[:i]]
            x = ([np.zeros(len(x[0]))] * n + x)[-n:]
            out[s, i + 1] = (seq[i][0], min(i, n), np.array(x, np.float32), np.array(emb[seq[i][0]], np.float32))
    return out


@pytest.mark.parametrize("rule", ["stop", "skip"])
def test_training_samples_are_those_of_brute_force(spark, rule):
    rng = np.random.default_rng(0)
    emb = {f"v{i}": rng.normal(size=6).tolist() for i in range(11)}          # v11 is not in the catalog
    rows = [r for r in sessions(2) if r[0] is not None]
    rows = [(s, at, "v3" if s == 5 and at < 600 and v == "v11" else v, liked) for s, at, v, liked in rows]
    df = spark.createDataFrame(rows, "session_id long, at long, video_id string, liked_flag int")
    plays = B.numbered(df, "session_id", ["at"]).drop("at")
    catalog = spark.createDataFrame(list(emb.items()), "video_id string, embedding array<double>")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "37")     # groups go over batches
    try:
        got = Q.prefix_tensors(plays, catalog, rule, 4).collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    want = brute_samples(rows, emb, rule, 4)
    assert len(got) == len(want) > 200 and {(r.session_id, r.play_order) for r in got} == set(want)
    for r in got:
        video, n, x, y = want[r.session_id, r.play_order]
        assert (r.target_video_id, r.rows, r.width) == (video, n, 7)
        assert np.array_equal(np.array(r.input, np.float32).reshape(4, 7), x) and np.array_equal(np.array(r.target, np.float32), y)
    with pytest.raises(ValueError):
        Q.usable_plays(plays, catalog, "drop")


def test_split_keeps_sessions_whole(spark):
    rows = Q.split_by_session(spark.range(3000).withColumn("session_id", F.col("id") % 600)).groupBy("session_id").agg(
        F.count_distinct("split").alias("sets"), F.first("split").alias("split")).collect()
    assert all(r.sets == 1 for r in rows) and 20 < sum(r.split == "validation" for r in rows) < 110
