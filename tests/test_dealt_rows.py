"""Many rows are dealt to as many tasks as they ask for, whatever the number of shuffle partitions."""

import random

import pytest

from cadence import session
from cadence.plans import q_sessions as Q


@pytest.fixture
def tables(spark, tmp_path):
    rng = random.Random(4)
    orders = [(k, k % 7, rng.choice("FOP")) for k in range(120)]
    lines = [(rng.randrange(130), i % 6, rng.randrange(40), rng.randrange(20), rng.choice(["N", "R", "A"]), float(i % 50)) for i in range(900)]
    lines += lines[:30] + [(None, 1, 3, 4, "N", 1.0), (5, 2, None, None, None, 1.0)]
    frames = {
        "orders": spark.createDataFrame(orders, "o_orderkey long, o_custkey long, o_orderstatus string"),
        "lineitem": spark.createDataFrame(lines, "l_orderkey long, l_linenumber int, l_partkey long, l_suppkey long, l_returnflag string, l_extendedprice double"),
        "embeddings": spark.createDataFrame([(i, i % 3, [1.0, float(i)]) for i in range(12)], "vec_id long, label int, embedding array<float>"),
        "part": spark.createDataFrame([(i, i) for i in range(0, 12, 2)], "p_partkey long, p_size int")}
    for name, df in frames.items():
        df.write.parquet(f"{tmp_path}/{name}.parquet")
    return str(tmp_path)


@pytest.mark.parametrize("name", ["j7_event_metadata", "w3_latest_cycles", "j11_surviving_songs"])
def test_rows_are_dealt_to_enough_tasks(spark, tables, monkeypatch, name):
    def run():
        out = getattr(Q, name)(spark, tables)
        plan = out._jdf.queryExecution().executedPlan().toString()
        return sorted(map(repr, out.collect())), plan

    want, before = run()
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    monkeypatch.setattr(session, "TASK_ROWS", 900 // (parts + 2))
    got, plan = run()
    assert got == want and want
    assert "REPARTITION_BY_NUM" not in before and plan.count("REPARTITION_BY_NUM") >= 2


def test_few_rows_are_left_to_spark(spark):
    df = spark.range(10)
    assert session.dealt(df, 10, "id") is df and session.dealt(df, 0, "id") is df
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    assert session.dealt(df, 1000 * (parts + 1), "id", task_rows=1000).rdd.getNumPartitions() == parts + 1
