"""R2 by cells against the definition: chunks of candidates, blocks of sessions, shared lists, playlist."""

import random

import pytest

from cadence.operators import recommend as R


def best(cooc, pop, seeds, played, playlist, songs, least=2):
    out = {}
    for s, own in seeds.items():
        pl = playlist.get(s, set())
        for c in songs:
            raw = max((cooc.get((c, g), 0) + (cooc.get((c, g), 0) > 0 and c in pl and g in pl) for g in own if g != c), default=0)
            if raw >= least:
                out[s, c] = min(raw / max(pop.get(c, 0) + (c in pl), 1), 1.0)
    return out, {k: v for k, v in out.items() if k[1] not in played.get(k[0], set())}


@pytest.mark.parametrize("cells", [{}, {"matrix_cells": 150, "block_lists": 3}])
def test_cells_equal_the_definition(spark, cells):
    rnd = random.Random(3)
    likes = {f"u{u}": {rnd.randrange(26) for _ in range(rnd.randrange(1, 9))} for u in range(14)}
    members = {s: {f"u{rnd.randrange(14)}" for _ in range(2)} for s in range(9)} | {20: {"nobody"}}
    playlist = {s: {rnd.randrange(26) for _ in range(4)} for s in range(0, 9, 2)}
    played = {s: {rnd.randrange(26) for _ in range(5)} for s in range(9)}
    songs = set(range(24))
    cooc, pop = {}, {}
    for vs in likes.values():
        for a in vs:
            pop[a] = pop.get(a, 0) + 1
            for b in vs - {a}:
                cooc[a, b] = cooc.get((a, b), 0) + 1
    seeds = {s: set().union(*(likes.get(u, set()) for u in us)) | playlist.get(s, set()) for s, us in members.items()}
    every, free = best(cooc, pop, seeds, played, playlist, songs)
    pairs = lambda d, t: spark.createDataFrame([(k, v) for k, vs in d.items() for v in vs], t)
    like = pairs(likes, "user_id string, video_id long")
    pl, gone = pairs(playlist, "session_id long, video_id long"), pairs(played, "session_id long, video_id long")
    shared = R.Seeds(pl, pairs(members, "session_id long, owner string"), like.withColumnRenamed("user_id", "owner"))
    cat = spark.createDataFrame([(v, [1.0, v / 9]) for v in songs], "video_id long, embedding array<double>")
    idx, p = R.cooccurrence_index(like), R.popularity(like)
    rows = R.cf_cooccurrence_scores(shared, idx, p, gone, pl, catalog=cat, **cells).collect()
    assert {(r.session_id, r.video_id): r.cf_score for r in rows} == free
    order = sorted(free, key=lambda x: (x[0], -free[x], x[1]))
    assert [(r.session_id, r.video_id) for r in sorted(rows, key=lambda r: (r.session_id, r["rank"]))] == order
    top = R.cf_cooccurrence_scores(shared.rows(), idx, p, gone, pl, catalog=cat, k=3, **cells).collect()
    assert {(r.session_id, r.video_id) for r in top} == {(r.session_id, r.video_id) for r in rows if r["rank"] <= 3}
    chosen = [(s, v) for s in members for v in (1, 5, 9, 13, 17)]
    cand = spark.createDataFrame(chosen, "session_id long, video_id long")
    got = {(r.session_id, r.video_id): r.cf_score for r in R.cf_for_candidates(cand, shared, idx, p, gone, cat, pl, **cells).collect()}
    signal = {s for s, _ in free}
    assert got.keys() == set(chosen) and all(got[x] == every.get(x, 0.0) for x in chosen if x[0] in signal)
    assert all(got[x] == 0.0 for x in chosen if not seeds[x[0]]) and all(got[x] > 0.5 for x in chosen if seeds[x[0]] and x[0] not in signal)
