"""Slices in one scan, zero cells, the profile of all columns, schema rules, medians."""

import numpy as np
import pandas as pd
import pytest

from cadence.operators import ingest as I
from cadence.operators import monitoring as M
from cadence.operators import prefs as P
from cadence.operators import quality as Q


def tracks(spark, n=300, seed=0):
    rng = np.random.default_rng(seed)
    pdf = pd.DataFrame({"session_id": rng.integers(0, 4, n), "genre": rng.choice(["Pop", "Rock", "Jazz", None], n, p=[0.7, 0.2, 0.05, 0.05]),
                        "country": rng.choice(["USA", "GBR", "AUS"], n), "playlist_name": rng.choice(["a", "b"], n),
                        "view_count": rng.integers(0, 50, n), "like_to_view_ratio": np.where(rng.random(n) < 0.1, np.nan, rng.random(n) * 2e6)})
    rows = [tuple(None if x is None or x != x else x.item() if hasattr(x, "item") else x for x in r) for r in pdf.itertuples(index=False)]
    return pdf, spark.createDataFrame(rows, "session_id long, genre string, country string, playlist_name string, view_count long, like_to_view_ratio double")


def test_cross_slices_have_zero_cells_and_take_one_scan(spark, tmp_path):
    pdf, df = tracks(spark)
    df.write.parquet(str(tmp_path / "t"))
    df = spark.read.parquet(str(tmp_path / "t"))
    sets = Q.slice_sets(df, ["genre", "country", "playlist_name", "missing"])
    assert sets._jdf.queryExecution().executedPlan().toString().count("FileScan") == 1
    pairs = [("genre", "country"), ("genre", "playlist_name"), ("country", "playlist_name")]
    got = {(r.session_id, r.pair, r.a_label, r.b_label): r.share for r in Q.cross_slices(sets).collect()}
    want = {}
    for s, part in pdf.fillna({"genre": "Unknown"}).groupby("session_id"):
        for a, b in pairs:
            table = pd.crosstab(part[a], part[b], normalize="index")
            want |= {(s, f"{a}_x_{b}", x, y): table.loc[x, y] for x in table.index for y in table.columns}
    assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k], abs=5.1e-5) for k in want)
    assert 0.0 in got.values()


def test_bias_summary_holds_slices_and_pairs(spark):
    pdf, df = tracks(spark)
    out = {r.session_id: r for r in Q.bias_summary(df, ["genre", "country", "absent"]).collect()}
    for s, part in pdf.fillna({"genre": "Unknown"}).groupby("session_id"):
        r = out[s]
        assert r.record_count == len(part) and [x.pair for x in r.cross_slices] == ["genre_x_country"]
        genre = part["genre"].value_counts()
        st = {x["slice"]: x for x in r.slices}["genre"]
        assert (st.total, st.label_count, st.dominant_label) == (len(part), len(genre), genre.index[0])
        assert r.overall_bias_flags == [c for c in ("country", "genre") if part[c].value_counts(normalize=True).iloc[0] > 0.6]
    st = Q.slice_stats(df, ["genre", "country"]).collect()
    assert {(x.session_id, x["slice"], x.total, x.entropy) for x in st} == {(s, x["slice"], x.total, x.entropy) for s, r in out.items() for x in r.slices}


def test_profile_of_all_columns_equals_pandas(spark):
    pdf, df = tracks(spark)
    cols = ["genre", "country", "view_count", "like_to_view_ratio"]
    got = {(r.session_id, r.column): r for r in Q.column_profile(df, cols, {"view_count", "like_to_view_ratio"}).collect()}
    assert len(got) == 16
    for s, part in pdf.groupby("session_id"):
        for c in cols:
            r, x = got[s, c], part[c]
            assert (r.missing_count, r.missing_pct, r.unique_count) == (x.isna().sum(), pytest.approx(round(x.isna().mean() * 100, 2), abs=0.011), x.nunique())
            if c in ("view_count", "like_to_view_ratio"):
                want = [x.mean(), x.std(), x.min(), x.max(), x.quantile(0.25), x.quantile(0.75)]
                assert [r.mean, r.std, r.min, r.max, r.p25, r.p75] == pytest.approx(want, rel=1e-9, abs=1e-4)
            else:
                assert (r.mean, r.p25) == (None, None)
    one = Q.column_profile(spark.createDataFrame([(1, 5.0, None)], "session_id long, x double, y double"), ["x", "y"], {"x", "y"}).collect()
    assert {r.column: (r.mean, r.std, r.p25, r.missing_pct, r.unique_count) for r in one} == {"x": (5.0, None, 5.0, 0.0, 1), "y": (None, None, None, 100.0, 0)}


def test_ranges_are_checked_for_number_columns_only(spark):
    row = {c: "x" for c in I.COLUMNS} | {"session_id": 1}
    df = spark.createDataFrame([tuple(row.values())], ", ".join(f"{c} {'long' if c == 'session_id' else 'string'}" for c in row))
    assert Q.schema_violations(df).count() == 0                # numbers that came as text: no range to check
    cast = df.withColumn("view_count", df.session_id - 5).withColumn("like_to_view_ratio", df.session_id * 1.5).drop("video_id")
    assert {(r.column, r.issue, r["count"]) for r in Q.schema_violations(cast).collect()} == {
        ("view_count", "below_min_0", 1), ("like_to_view_ratio", "above_max_1.0", 1), ("video_id", "missing_column", 1)}


def test_popularity_medians(spark):
    rng = np.random.default_rng(5)
    rec, cat = rng.random(41), rng.random(100)
    recs = spark.createDataFrame([(i % 2, float(x)) for i, x in enumerate(rec)] + [(7, None)], "session_id long, popularity_score double")
    got = {r.session_id: r for r in M.popularity_bias(recs, spark.createDataFrame([(float(x),) for x in cat], "popularity_score double")).collect()}
    for s in (0, 1):
        assert (got[s].rec_median, got[s].catalog_median) == pytest.approx((np.median(rec[s::2]), np.median(cat)), abs=5.1e-5)
    assert got[7].rec_median is None


def test_first_vote_and_scores_with_time(spark):
    rows = [("s", "u", "v", 3, "like"), ("s", "u", "v", 1, "skip"), ("s", "u", "v", 2, "dislike"), ("s", "u2", "v", 9, "like")]
    df = spark.createDataFrame(rows, "session_id string, user_id string, video_id string, at long, action string")
    votes = P.first_vote(df, ["at"])
    assert votes.columns == df.columns and sorted(map(tuple, votes.collect())) == [rows[1], rows[3]]
    r = P.track_scores(P.with_feedback_weight(df), "at").first()
    assert (r.score, r.like_count, r.last_updated) == (1.5, 2, 9)
    shares = M.genre_shares(spark.createDataFrame([(1, "a"), (1, None), (1, "a")], "session_id long, genre string")).collect()
    assert {(x.genre, x.plays, x.share) for x in shares} == {("a", 2, 0.6667), ("Unknown", 1, 0.3333)}
