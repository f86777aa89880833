"""Sequence queries: W5 play sequences, W6 prefix samples, F11 eligible sequences."""

from __future__ import annotations

from pyspark.sql import functions as F

from cadence.operators import sequences as Q
from cadence.operators.numbering import numbered
from cadence.plans.adapters import Adapters, with_ctes
from cadence.plans.q_recommend import r4, s4
from cadence.plans.registry import register


CHUNK = 8      # small, so that sessions have several chunks


@register("w5_play_sequences", with_ctes(["plays"], [], f"""
    SELECT session_id, (play_order - 1) // {CHUNK} AS chunk, string_agg(video_id || ':' || liked_flag, ' ' ORDER BY play_order) AS sequence
    FROM plays WHERE session_id IN (SELECT session_id FROM plays GROUP BY 1 HAVING count(*) >= 2) GROUP BY ALL"""))
def w5_play_sequences(spark, sf_dir):
    s = Q.play_sequences(Adapters(spark, sf_dir).plays(), chunk=CHUNK)
    text = F.transform("sequence", lambda x: F.concat_ws(":", x["video_id"].cast("string"), x["liked_flag"].cast("string")))
    return s.select("session_id", F.col("chunk").cast("long").alias("chunk"), F.array_join(text, " ").alias("sequence"))


# One song in twenty is not in the catalog: ids beyond its size.
SQL_MIXED = [("mixed", """
        SELECT l_orderkey // 4 AS session_id, l_partkey % (SELECT n + n // 20 FROM ncat) AS video_id,
               CASE WHEN l_returnflag = 'N' THEN 1 ELSE 0 END AS liked_flag,
               row_number() OVER (PARTITION BY l_orderkey // 4 ORDER BY l_orderkey, l_linenumber, l_partkey, l_returnflag) AS play_order
        FROM lineitem""")]


def mixed_plays(a: Adapters):
    rows = a.t.lineitem.select(
        a._session("l_orderkey").alias("session_id"), "l_orderkey", "l_linenumber", "l_partkey", "l_returnflag",
        F.pmod(F.col("l_partkey"), a.t.embeddings.select(F.expr("count(*) + count(*) div 20")).scalar()).alias("video_id"),
        F.when(F.col("l_returnflag") == "N", 1).otherwise(0).alias("liked_flag"))
    return numbered(rows, "session_id", ["l_orderkey", "l_linenumber", "l_partkey", "l_returnflag"]).select("session_id", "play_order", "video_id", "liked_flag")


@register("w6_prefix_samples", with_ctes(["plays"], [], """
    SELECT p.session_id, p.play_order, p.video_id AS target_video_id, string_agg(CAST(c.video_id AS VARCHAR), ' ' ORDER BY c.play_order) AS context
    FROM plays p JOIN plays c ON c.session_id = p.session_id AND c.play_order BETWEEN p.play_order - 15 AND p.play_order - 1 GROUP BY ALL"""))
def w6_prefix_samples(spark, sf_dir):
    s = Q.prefix_samples(Adapters(spark, sf_dir).plays())
    return s.select("session_id", "play_order", "target_video_id", F.array_join(F.transform("context", lambda v: v.cast("string")), " ").alias("context"))


def _tensor_sql(usable: str) -> str:
    """Checks of every sample's whole matrix: the sum of its cells, each times the number of its row
    (1 to 15, padding included) and of its column, and the same of its target."""
    return with_ctes(["catalog", "ncat"], SQL_MIXED + [
        ("song", "SELECT video_id, list_sum(list_transform(embedding, lambda x, i: CAST(x AS FLOAT)::DOUBLE * i)) AS s, len(embedding) AS d FROM catalog"),
        ("known", "SELECT m.*, s, d FROM mixed m JOIN song USING (video_id)"),
        ("usable", usable)], f"""
    SELECT p.session_id, p.play_order, p.video_id AS target_video_id, CAST(count(*) AS INTEGER) AS rows,
           {s4('sum((15 - (p.play_order - c.play_order) + 1) * (c.s + c.liked_flag * (c.d + 1)))')} AS input_check, {s4('max(p.s)')} AS target_check
    FROM usable p JOIN usable c ON c.session_id = p.session_id AND c.play_order BETWEEN p.play_order - 15 AND p.play_order - 1 GROUP BY 1, 2, 3""")


def _tensor_checks(samples):
    """The checks of a record batch of samples, in the task that made them."""
    import numpy as np
    import pyarrow as pa

    width = samples.column("width")[0].as_py()
    whole = lambda c: samples.column(c).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(samples.num_rows, -1)
    x, target = whole("input").reshape(samples.num_rows, -1, width), whole("target")
    x = (x @ np.arange(1.0, width + 1)) @ np.arange(1.0, x.shape[1] + 1)
    checks = [pa.array(x), pa.array(target @ np.arange(1.0, target.shape[1] + 1))]
    keys = ["session_id", "play_order", "target_video_id", "rows"]
    return pa.RecordBatch.from_arrays([*[samples.column(c) for c in keys], *checks], [*keys, "input_check", "target_check"])


def _tensor_query(spark, sf_dir, unknown: str):
    a = Adapters(spark, sf_dir)
    plays = mixed_plays(a)
    s, v = (dict(plays.dtypes)[c] for c in ("session_id", "video_id"))
    t = Q.prefix_tensors(plays, a.catalog(), unknown, derive=(_tensor_checks, f"session_id {s}, play_order long, target_video_id {v}, rows int, input_check double, target_check double"))
    return t.select("session_id", "play_order", "target_video_id", "rows", r4(F.col("input_check")).alias("input_check"), r4(F.col("target_check")).alias("target_check"))


@register("w6_prefix_tensors", _tensor_sql("""
        SELECT * FROM known k WHERE play_order < coalesce((SELECT min(m.play_order) FROM mixed m
            WHERE m.session_id = k.session_id AND m.video_id NOT IN (SELECT video_id FROM catalog)), 1000000000)"""))
def w6_prefix_tensors(spark, sf_dir):
    return _tensor_query(spark, sf_dir, "stop")


@register("w6_retrain_tensors", _tensor_sql("""
        SELECT session_id, video_id, liked_flag, s, d, row_number() OVER (PARTITION BY session_id ORDER BY play_order) AS play_order FROM known"""))
def w6_retrain_tensors(spark, sf_dir):
    return _tensor_query(spark, sf_dir, "skip")


@register("f11_eligible_sequences", with_ctes(["plays"], [], """
    SELECT session_id, count(*) AS events FROM plays GROUP BY 1 HAVING count(*) >= 5"""))
def f11_eligible_sequences(spark, sf_dir):
    e = Q.eligible_sequences(Adapters(spark, sf_dir).plays())
    return e.groupBy("session_id").agg(F.count(F.lit(1)).alias("events"))


@register("w10_sub_sessions", with_ctes(["plays"], [], """
    SELECT session_id, (play_order - 1) // 10 + 1 AS sub_session, count(*) AS plays, min(play_order) AS first_play, CAST(sum(liked_flag) AS BIGINT) AS liked
    FROM plays GROUP BY ALL"""))
def w10_sub_sessions(spark, sf_dir):
    p = Q.with_sub_session(Adapters(spark, sf_dir).plays())
    return p.groupBy("session_id", "sub_session").agg(F.count(F.lit(1)).alias("plays"), F.min("play_order").alias("first_play"),
                                                      F.sum("liked_flag").alias("liked"))


@register("w15_split", with_ctes(["plays"], [], "SELECT session_id, count(*) AS plays FROM plays GROUP BY 1"))
def w15_split(spark, sf_dir):
    """Every session with all its plays, in one of the two sets (the sets themselves are hashed)."""
    p = Q.split_by_session(Adapters(spark, sf_dir).plays())
    one = p.groupBy("session_id").agg(F.count(F.lit(1)).alias("plays"), F.count_distinct("split").alias("sets"))
    return one.where("sets = 1").drop("sets")
