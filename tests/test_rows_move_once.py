"""Steps that read, parse or move rows once: the same rows as before, by plan and by value."""

import numpy as np
from pyspark.sql import functions as F

from cadence.functions import scalars as S
from cadence.operators import ingest as I
from cadence.operators import quality as Q
from cadence.operators import recommend as R
from cadence.operators import sessions as SE
from cadence.operators.nearest import MetricIndex
from cadence.plans.adapters import Adapters
from cadence.plans.ingest_adapters import raw_tracks


def plan(df) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString()


def rows(df):
    return sorted(map(repr, df.collect()))


RAW = "session_id long, track_title string, video_id string, trackTimeMillis string, view_count string, like_count string, comment_count string, genre string"


def test_plain_numbers_and_texts_equal_the_unicode_patterns(spark):
    texts = ["12", "-7", "+7", " 12 ", "12\n", "1_000", "007", "3.7", "1.", ".5", "1e3", "12d", "inf", "nan", "", " ", None, "x", "é", " a ", "\x1ca\x1c",
             "9" * 18, "9" * 19, "-1500", "199999.9", "a\n", "KK!", "Tëst  (x)", "a-b_c\x1d9"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    got = df.select("t", S.py_strip("t").alias("s"), S.py_float("t").alias("f"), S.lenient_int("t").alias("i"), S.clean_text("t").alias("c")).collect()
    for r in got:
        if r.t is None:
            assert (r.s, r.f, r.i, r.c) == (None, None, 0, "unknown")
            continue
        assert r.s == r.t.strip()
        try:
            want = float(r.t)
            assert r.f == want or (r.f != r.f and want != want)
        except ValueError:
            assert r.f is None
        try:
            n = int(r.t)
            assert r.i == (n if abs(n) < 2 ** 63 else 0)
        except ValueError:
            assert r.i == 0
        assert r.c == "".join(x for x in r.t.lower() if x in "abcdefghijklmnopqrstuvwxyz0123456789" or x.isspace()).strip()


def test_millis_are_parsed_once(spark):
    d = I.derive_fields(spark.createDataFrame([(1, "t", "v", "12", "1", "1", "1", "g")], RAW))
    assert plan(d).count("inf|infinity|nan") == 1


def test_validation_report_looks_once(spark):
    schema = "session_id long, playlist_name string, trackTimeMillis long, like_to_view_ratio double"
    df = spark.createDataFrame([(1, None, -1, 2.0), (1, "p", 5, 0.5), (2, "p", 1, 0.1), (None, None, -1, 0.1)], schema)
    out = Q.validation_report(df)
    assert plan(out).count("Aggregate") == 1 and "Join" not in plan(out)
    violations = {r.session_id: r.n for r in Q.schema_violations(df).groupBy("session_id").agg(F.count("*").alias("n")).collect()}
    for r in out.collect():
        assert r.violation_count == (0 if r.session_id is None else violations.get(r.session_id, 0))
        assert r.column_count == 3 and r.schema_valid == (r.violation_count == 0)


def test_cross_slice_counts_once(spark):
    df = spark.createDataFrame([(1, "a", "x"), (1, "a", "y"), (1, "b", "x")], "session_id long, g string, c string")
    out = Q.cross_slice(df, "g", "c")
    assert "Expand" not in plan(out)
    assert {(r.a_label, r.b_label): r.share for r in out.collect()} == {("a", "x"): 0.5, ("a", "y"): 0.5, ("b", "x"): 1.0, ("b", "y"): 0.0}


def test_mitigation_keeps_both_steps(spark):
    df = spark.createDataFrame([(1, i, "a" if i else "b") for i in range(30)], "session_id long, row_id long, g string")
    kept = []
    out = Q.mitigate(df, ["g"], cut_lineage=lambda x: kept.append(x) or x)
    assert len(kept) == 2 and rows(out) == rows(Q.mitigate(df, ["g"]))


def test_parts_are_joined_last(spark, tmp_path):
    d = str(tmp_path)
    spark.sql("select 1L l_orderkey, 2L l_partkey, 3L l_suppkey, 1 l_linenumber, 2.0D l_quantity, 10.0D l_extendedprice, 'N' l_returnflag").write.parquet(f"{d}/lineitem.parquet")
    spark.sql("select 1L o_orderkey, 5L o_custkey, '1-URGENT' o_orderpriority union all select 1L, 5L, '2-HIGH'").write.parquet(f"{d}/orders.parquet")
    spark.sql("select 5L c_custkey, 7 c_nationkey").write.parquet(f"{d}/customer.parquet")
    spark.sql("select 7 n_nationkey, 'PERU' n_name").write.parquet(f"{d}/nation.parquet")
    spark.sql("select 2L p_partkey, 'part' p_name, 'type' p_type, 'brand' p_brand, 4 p_size").write.parquet(f"{d}/part.parquet")
    out = raw_tracks(Adapters(spark, d))
    first = next(x for x in plan(out).splitlines() if "Join" in x)
    assert "p_partkey" in first
    assert [(r.playlist_name, r.country, r.user_id, r.artist_name) for r in out.orderBy("playlist_name").collect()] == [
        ("1-URGENT", "PERU", "5", "brand"), ("2-HIGH", "PERU", "5", "brand")]


def test_profile_deals_rows_once_and_large_keys_by_selection(spark):
    rng = np.random.default_rng(3)
    data = [(int(s) if s else None, float(rng.integers(0, 9)), None if rng.random() < .2 else str(rng.integers(0, 5))) for s in rng.integers(0, 4, 200)]
    df = spark.createDataFrame(data + [(9, float("nan"), None)], "session_id long, x double, t string")
    direct = Q.column_profile(df, ["x", "t"], {"x"})
    assert "Join" not in plan(direct)
    by_selection, mixed = (Q.column_profile(df, ["x", "t"], {"x"}, direct_rows=n) for n in (0, 50))
    assert rows(direct) == rows(by_selection) == rows(mixed)


def test_trend_joins_nothing_back(spark):
    snaps = spark.createDataFrame([(1, 1, "a"), (1, 1, "b"), (1, 1, None), (1, 2, "a"), (None, 1, "a")], "session_id long, ts_ms long, genre string")
    out = SE.diversity_trend(snaps)
    assert "Join" not in plan(out)
    assert sorted((r.session_id, r.ts_ms, r.entropy, r.song_count) for r in out.collect()) == [(1, 1, 1.585, 3), (1, 2, 0.0, 1)]


def test_exclusions_by_lists_equal_the_rows(spark):
    links = spark.createDataFrame([(1, "u"), (1, "v"), (2, "v"), (2, "w"), (2, None), (None, "u"), (3, "x"), (2, "v")], "session_id long, owner string")
    owned = spark.createDataFrame([("u", 1), ("u", 2), ("v", 2), ("v", None), ("w", 5), ("w", 5), (None, 8)], "owner string, video_id long")
    own = spark.createDataFrame([(1, 2), (4, 9), (4, 9), (2, None)], "session_id long, video_id long")
    want = links.join(owned, "owner").select("session_id", "video_id").union(own).distinct()
    got = R.listed_exclusions(links, owned, own)
    assert rows(got) == rows(want) == rows(R.listed_exclusions(links, owned, own, hot_links=1))
    assert "Join [owner" not in plan(got.select("session_id")) and "songs" in plan(got)


def test_blocks_grow_before_all_songs_are_sent_everywhere(spark, monkeypatch):
    rng = np.random.default_rng(5)
    songs = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(rng.normal(size=(40, 4)))], "video_id long, embedding array<double>")
    sessions = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(rng.normal(size=(200, 4)))], "session_id long, vector array<double>")
    blocks, search = [], MetricIndex._search

    def seen(self, visits, marks, block, n_blocks, *rest):
        blocks.append(spark.range(1).select(n_blocks).first()[0])
        return search(self, visits, marks, block, n_blocks, *rest)

    monkeypatch.setattr(MetricIndex, "_search", seen)
    index = MetricIndex(songs)
    small, large = (rows(index.top_items(sessions, 3, block_sessions=n).select("session_id", "video_id", "rank")) for n in (1, 1000))
    assert small == large and blocks == [64, 1]
