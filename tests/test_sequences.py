"""Play sequences: bucketed prefix samples equal a brute-force window; sequence model forward."""

import numpy as np

from cadence.operators import sequences as Q


def test_prefix_samples_brute_force(spark):
    rows = [(s, i, f"v{(s * 7 + i) % 13}", i % 2) for s in range(3) for i in range(1, 5 + s * 12)]
    plays = spark.createDataFrame(rows, "session_id long, play_order long, video_id string, liked_flag int")
    got = {(r.session_id, r.play_order): (r.target_video_id, list(r.context))
           for r in Q.prefix_samples(plays, 4).collect()}
    want = {}
    for s in range(3):
        seq = [(i, v) for (ss, i, v, _) in rows if ss == s]
        for j, (i, v) in enumerate(seq):
            if j == 0:
                continue
            want[(s, i)] = (v, [x[1] for x in seq[max(0, j - 4):j]])
    assert got == want


def test_sequence_tensor_and_forward(spark):
    cat = spark.createDataFrame([(i, np.eye(4)[i % 4].tolist()) for i in range(6)], "video_id long, embedding array<double>")
    plays = spark.createDataFrame([(1, i, [1, 2, 9, 4][i - 1], 1) for i in range(1, 5)],
                                  "session_id long, play_order long, video_id long, liked_flag int")
    t = Q.sequence_tensor(plays, cat, n=6).first()
    assert len(t.tensor) == 6 and t.length == 3  # id 6 is not in the catalog (skipped), 3 left -> padded
    assert t.tensor[0] == [0.0] * 5 and t.tensor[-1][-1] == 1.0
    rng = np.random.default_rng(0)
    H, D = 8, 5
    w = {"input_proj.0.weight": rng.normal(size=(H, D)), "input_proj.0.bias": rng.normal(size=H),
         "input_proj.1.weight": np.ones(H), "input_proj.1.bias": np.zeros(H),
         "output_proj.0.weight": rng.normal(size=(H, H)), "output_proj.0.bias": rng.normal(size=H),
         "output_proj.3.weight": rng.normal(size=(4, H)), "output_proj.3.bias": rng.normal(size=4)}
    for layer in range(2):
        w[f"gru.weight_ih_l{layer}"] = rng.normal(size=(3 * H, H))
        w[f"gru.weight_hh_l{layer}"] = rng.normal(size=(3 * H, H))
        w[f"gru.bias_ih_l{layer}"] = rng.normal(size=3 * H)
        w[f"gru.bias_hh_l{layer}"] = rng.normal(size=3 * H)
    out = Q.gru_forward(Q.sequence_tensor(plays, cat, n=6), w).first()
    assert len(out.vector) == 4 and abs(np.linalg.norm(out.vector) - 1.0) < 1e-9
