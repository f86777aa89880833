"""Re-balancing joins its rows with the labels once: the joins that are left see only the labels concerned."""

import math

import pytest

from cadence.operators import quality as Q


def plan(df) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString()


@pytest.fixture
def frame(spark):
    data = [(s, f"r{s}-{i}", "a" if i % 40 else "b" if i % 80 else None) for s in (1, 2, None) for i in range(90)] + [(3, f"x{i}", "c") for i in range(7)]
    return spark.createDataFrame(data, "session_id long, row_id string, g string")


def test_all_rows_are_joined_once(frame):
    down, up = Q.downsample(frame, "g"), Q.upsample(frame, "g")
    assert "LeftAnti" not in plan(down) and "LeftSemi" not in plan(down) + plan(up)
    assert "session_id" in down.columns and down.columns == up.columns == frame.columns


def test_counts_by_formula(frame):
    counts = lambda df: {(r.session_id, r.g): r["count"] for r in df.groupBy("session_id", "g").count().collect()}
    before, up, down = counts(frame), counts(Q.upsample(frame, "g")), counts(Q.downsample(frame, "g"))
    for s in (1, 2):
        for g in ("b", None):
            assert up[s, g] == before[s, g] + math.ceil((0.05 * 90 - before[s, g]) / 0.95)
        rest = before[s, "b"] + before[s, None]
        assert down[s, "a"] == int(rest * 0.6 / (1 - 0.6)) and up[s, "a"] == before[s, "a"]
    assert up[3, "c"] == down[3, "c"] == 7                    # one label only: kept whole
    for g in ("a", "b", None):                                # rows without a session stay as they are
        assert up[None, g] == down[None, g] == before[None, g]
