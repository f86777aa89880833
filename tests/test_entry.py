"""Driver contract: entry runs, every query with SQL has a name that exists."""

import __spark_entry__ as E


def test_entry_smoke(spark):
    df = E.entry(spark)
    assert df.count() > 0
    assert {"session_id", "video_id", "rank", "final_score"} <= set(df.columns)


def test_oracle_keys_are_queries():
    assert set(E.oracle_sql()) <= set(E.queries())
    assert len(E.queries()) >= 40


def test_count_queries_stay_beside_the_row_queries():
    names = {"m1_upsample_counts", "m1_upsample_rows", "m2_downsample_counts", "m2_downsample_rows"}
    assert names <= set(E.queries()) and names <= set(E.oracle_sql())
