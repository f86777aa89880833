"""A17 by cells: ranges of songs, lists of a user, against the definition."""

import random

from cadence.operators import recommend as R


def test_cells_count_as_the_definition(spark):
    rnd = random.Random(5)
    likes = {f"u{u}": {f"v{rnd.randrange(30)}" for _ in range(rnd.randrange(1, 25))} for u in range(20)}
    rows = [(u, v) for u, vs in likes.items() for v in vs] * 2 + [(None, "v1"), ("u1", None), (None, None)]
    want = {}
    for vs in likes.values():
        for a in vs:
            for b in vs:
                if a < b:
                    want[a, b] = want.get((a, b), 0) + 1
    df = spark.createDataFrame(rows, "user_id string, video_id string")
    got = R.cooccurrence_pairs(df, chunk_items=4, matrix_cells=200).collect()
    assert len(got) == len(want) and {(r.item_a, r.item_b): r.cooc for r in got} == want
    assert R.cooccurrence_pairs(df.limit(0)).count() == 0
