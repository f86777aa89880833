"""Quality queries: A1-A10, A30, M1-M2 on the validated session tracks."""

from __future__ import annotations

from pyspark.sql import functions as F

from cadence.operators import ingest as I
from cadence.operators import quality as Q
from cadence.plans.adapters import with_ctes
from cadence.plans.q_ingest import validated
from cadence.plans.q_recommend import r4, s4
from cadence.plans.registry import register
from cadence.session import materialise

SLICES = ["genre", "country"]
VALID = [("valid", "SELECT * FROM derived WHERE error IS NULL")]
LABELS = VALID + [("labels", """
        SELECT session_id, 'genre' AS slice, coalesce(genre, 'Unknown') AS label FROM valid
        UNION ALL SELECT session_id, 'country', coalesce(country, 'Unknown') FROM valid"""),
    ("counts", """
        SELECT session_id, slice, label, count(*) AS count FROM labels GROUP BY ALL"""),
    ("counts_t", """
        SELECT c.*, t.total FROM counts c
        JOIN (SELECT session_id, slice, sum(count) AS total FROM counts GROUP BY ALL) t USING (session_id, slice)""")]


def valid(spark, sf_dir):
    return validated(spark, sf_dir).where(F.col("error").isNull())


@register("a1_slice_counts", with_ctes(["derived"], LABELS, """
    SELECT session_id, slice, label, count, CAST(total AS BIGINT) AS total,
           round(count / total, 4) AS proportion FROM counts_t"""))
def a1_slice_counts(spark, sf_dir):
    return Q.slice_counts(valid(spark, sf_dir), SLICES)


@register("a2_a3_slice_stats", with_ctes(["derived"], LABELS + [("dom", """
        SELECT session_id, slice, label FROM (SELECT *, row_number() OVER (PARTITION BY session_id, slice
                                              ORDER BY count DESC, label) AS rn FROM counts_t) WHERE rn = 1""")], f"""
    SELECT session_id, slice, CAST(max(total) AS BIGINT) AS total, count(*) AS label_count,
           count(DISTINCT count) AS unique_values,
           {s4('-sum(count / total * ln(count / total))')} AS entropy,
           {s4('ln(greatest(count(*), 1))')} AS max_entropy,
           (SELECT d.label FROM dom d WHERE d.session_id = counts_t.session_id AND d.slice = counts_t.slice)
             AS dominant_label,
           round(max(count) / max(total), 4) AS dominant_share,
           max(count) / max(total) > 0.6 AS bias_flag,
           coalesce(string_agg(CASE WHEN count / total < 0.01 THEN label END, '|' ORDER BY label), '')
             AS underrepresented
    FROM counts_t GROUP BY session_id, slice"""))
def a2_a3_slice_stats(spark, sf_dir):
    st = Q.slice_stats(valid(spark, sf_dir), SLICES)
    return st.select("session_id", "slice", "total", "label_count", "unique_values",
                     r4(F.col("entropy")).alias("entropy"), r4(F.col("max_entropy")).alias("max_entropy"),
                     "dominant_label", "dominant_share", "bias_flag",
                     F.array_join("underrepresented", "|").alias("underrepresented"))


SQL_CROSS = [
    ("la", "SELECT session_id, label AS a_label, count AS row_n FROM counts WHERE slice = 'genre'"),
    ("lb", "SELECT session_id, label AS b_label FROM counts WHERE slice = 'country'"),
    ("x", """
        SELECT session_id, coalesce(genre, 'Unknown') AS a_label, coalesce(country, 'Unknown') AS b_label,
               count(*) AS n FROM valid GROUP BY ALL"""),
    ("grid", f"""
        SELECT la.session_id, a_label, b_label, {s4('coalesce(n, 0) / row_n')} AS share
        FROM la JOIN lb USING (session_id) LEFT JOIN x USING (session_id, a_label, b_label)""")]


@register("a4_cross_slice", with_ctes(["derived"], LABELS + SQL_CROSS, """
    SELECT session_id, 'genre_x_country' AS pair, a_label, b_label, share FROM grid"""))
def a4_cross_slice(spark, sf_dir):
    return Q.cross_slice(valid(spark, sf_dir), "genre", "country")


@register("a5_bias_summary", with_ctes(["derived"], LABELS + SQL_CROSS + [("st", """
        SELECT session_id, slice, sum(count) AS total, count(*) AS label_count, max(count) / sum(count) AS share FROM counts GROUP BY ALL""")], """
    SELECT session_id, CAST(max(total) AS BIGINT) AS record_count,
           coalesce(string_agg(CASE WHEN share > 0.6 THEN slice END, '|' ORDER BY slice), '') AS overall_bias_flags,
           string_agg(slice || ':' || label_count || ':' || printf('%.4f', round(share, 4)), '|' ORDER BY slice) AS slices,
           max(cells) AS cross_slices
    FROM st JOIN (SELECT session_id, string_agg(a_label || '/' || b_label || '=' || printf('%.4f', share), '|' ORDER BY a_label, b_label) AS cells
                  FROM grid GROUP BY 1) USING (session_id) GROUP BY session_id"""))
def a5_bias_summary(spark, sf_dir):
    b = Q.bias_summary(valid(spark, sf_dir), SLICES)
    slices = F.transform("slices", lambda x: F.format_string("%s:%d:%.4f", x["slice"], x["label_count"], x["dominant_share"]))
    cells = F.transform(F.flatten(F.transform("cross_slices", lambda x: x["cells"])), lambda c: F.format_string("%s/%s=%.4f", c["a_label"], c["b_label"], c["share"]))
    return b.select("session_id", "record_count", F.array_join("overall_bias_flags", "|").alias("overall_bias_flags"),
                    F.array_join(slices, "|").alias("slices"), F.array_join(cells, "|").alias("cross_slices"))


NUMERIC = [c for c, (_, numeric, _, _) in Q.EXPECTED_SCHEMA.items() if numeric]


def _profile_sql():
    parts = []
    for c in I.COLUMNS:
        x = f"CAST({c} AS DOUBLE)"
        numbers = {"mean": f"avg({x})", "std": f"stddev_samp({x})", "min": f"min({x})", "max": f"max({x})",
                   "p25": f"quantile_cont({x}, 0.25)", "p75": f"quantile_cont({x}, 0.75)"}
        stats = ", ".join(f"{s4(e) if c in NUMERIC else 'CAST(NULL AS DOUBLE)'} AS {n}" for n, e in numbers.items())
        parts.append(f"""SELECT session_id, '{c}' AS column, count(*) FILTER (WHERE {c} IS NULL) AS missing_count,
               round(count(*) FILTER (WHERE {c} IS NULL) / count(*) * 100, 2) AS missing_pct,
               count(DISTINCT {c}) AS unique_count, {stats} FROM valid GROUP BY session_id""")
    return " UNION ALL ".join(parts)


@register("a6_column_profile", with_ctes(["derived"], VALID, _profile_sql()))
def a6_column_profile(spark, sf_dir):
    return Q.column_profile(valid(spark, sf_dir).select("session_id", *I.COLUMNS), I.COLUMNS, set(NUMERIC))


def _violations_sql():
    parts = []
    for c, (nullable, numeric, lo, hi) in Q.EXPECTED_SCHEMA.items():
        if not nullable:
            parts.append(f"SELECT session_id, '{c}' AS column, 'unexpected_nulls' AS issue, "
                         f"count(*) FILTER (WHERE {c} IS NULL) AS count FROM valid GROUP BY 1")
        if numeric and lo is not None:
            parts.append(f"SELECT session_id, '{c}', 'below_min_{lo}', count(*) FILTER (WHERE {c} < {lo}) "
                         f"FROM valid GROUP BY 1")
        if numeric and hi is not None:
            parts.append(f"SELECT session_id, '{c}', 'above_max_{hi}', count(*) FILTER (WHERE {c} > {hi}) "
                         f"FROM valid GROUP BY 1")
    return "SELECT * FROM (" + " UNION ALL ".join(parts) + ") WHERE count > 0"


@register("a7_schema_violations", with_ctes(["derived"], VALID, _violations_sql()))
def a7_schema_violations(spark, sf_dir):
    return Q.schema_violations(valid(spark, sf_dir).select("session_id", *I.COLUMNS))


@register("a8_validation_report", with_ctes(["derived"], VALID + [("viol", _violations_sql())], """
    SELECT n.session_id, n.row_count, coalesce(v.k, 0) AS violation_count, 15 AS column_count,
           coalesce(v.k, 0) = 0 AS schema_valid
    FROM (SELECT session_id, count(*) AS row_count FROM valid GROUP BY 1) n
    LEFT JOIN (SELECT session_id, count(*) AS k FROM viol GROUP BY 1) v USING (session_id)"""))
def a8_validation_report(spark, sf_dir):
    r = Q.validation_report(valid(spark, sf_dir).select("session_id", *I.COLUMNS))
    return r.select("session_id", "row_count", "violation_count", "column_count", "schema_valid")


@register("a9_session_anomalies", with_ctes(["derived"], [("a", """
        SELECT session_id, count(*) FILTER (WHERE error IS NULL) AS valid, count(*) FILTER (WHERE error IS NOT NULL)
               AS invalid, count(*) FILTER (WHERE error IS NULL AND coalesce(genre, 'Unknown') = 'Unknown') AS unknown
        FROM derived GROUP BY 1""")], """
    SELECT session_id, 'high_invalid_rate' AS kind, round(invalid / (valid + invalid) * 100, 2) AS value,
           printf('%.1f%% of records failed validation (%d/%d)', invalid / (valid + invalid) * 100, invalid,
                  valid + invalid) AS message
    FROM a WHERE valid + invalid > 0 AND invalid / (valid + invalid) * 100 > 5.0
    UNION ALL
    SELECT session_id, 'high_unknown_genre', round(unknown / valid * 100, 2),
           printf('%.1f%% of tracks have unknown genre', unknown / valid * 100)
    FROM a WHERE valid > 0 AND unknown / valid * 100 > 30.0"""))
def a9_session_anomalies(spark, sf_dir):
    a = Q.session_anomalies(validated(spark, sf_dir))
    return a.select("session_id", F.explode("anomalies").alias("x")).select(
        "session_id", "x.kind", "x.value", "x.message")


@register("a30_slice_engagement", with_ctes(["derived"], VALID + [("lab", """
        SELECT session_id, 'genre' AS slice, coalesce(genre, 'Unknown') AS label, like_to_view_ratio,
               comment_to_view_ratio FROM valid
        UNION ALL SELECT session_id, 'country', coalesce(country, 'Unknown'), like_to_view_ratio,
               comment_to_view_ratio FROM valid""")], """
    SELECT session_id, slice, label, (round(avg(like_to_view_ratio), 4) + 0.0) AS avg_like_ratio,
           (round(avg(comment_to_view_ratio), 4) + 0.0) AS avg_comment_ratio, count(*) AS records
    FROM lab GROUP BY ALL"""))
def a30_slice_engagement(spark, sf_dir):
    return Q.slice_engagement(valid(spark, sf_dir), SLICES)


# ---- M1 / M2: per-label counts after re-balancing

GENRE_COUNTS = VALID + [("gc", """
        SELECT session_id, coalesce(genre, 'Unknown') AS label, count(*) AS c,
               sum(count(*)) OVER (PARTITION BY session_id) AS n FROM valid GROUP BY 1, 2""")]


def rebalanced(spark, sf_dir, slices=("genre",)):
    """The valid rows as re-balancing needs them, written once: every step reads them several times."""
    return materialise(valid(spark, sf_dir).select("session_id", "row_id", *slices), "valid")


@register("m1_upsample_counts", with_ctes(["derived"], GENRE_COUNTS, """
    SELECT session_id, label, CAST(CASE WHEN c / n < 0.05::DOUBLE
             THEN c + greatest(ceil((0.05::DOUBLE * n - c) / (1.0::DOUBLE - 0.05::DOUBLE)), 0) ELSE c END AS BIGINT)
           AS rows_after FROM gc"""))
def m1_upsample_counts(spark, sf_dir):
    up = Q.upsample(rebalanced(spark, sf_dir), "genre")
    return (up.groupBy("session_id", F.coalesce("genre", F.lit("Unknown")).alias("label"))
            .agg(F.count(F.lit(1)).alias("rows_after")))


@register("m2_downsample_counts", with_ctes(["derived"], GENRE_COUNTS, """
    SELECT session_id, label, CASE WHEN c / n > 0.6::DOUBLE
             AND CAST(trunc((n - c) * 0.6::DOUBLE / (1.0::DOUBLE - 0.6::DOUBLE)) AS BIGINT) > 0
             THEN CAST(trunc((n - c) * 0.6::DOUBLE / (1.0::DOUBLE - 0.6::DOUBLE)) AS BIGINT)
             ELSE CAST(c AS BIGINT) END AS rows_after FROM gc"""))
def m2_downsample_counts(spark, sf_dir):
    down = Q.downsample(rebalanced(spark, sf_dir), "genre")
    return (down.groupBy("session_id", F.coalesce("genre", F.lit("Unknown")).alias("label"))
            .agg(F.count(F.lit(1)).alias("rows_after")))


# ---- M1 - M3, A10: the rows themselves, chosen by md5 of the row id ----------------------

def _step_sql(src: str, col: str, name: str) -> list[tuple[str, str]]:
    """Up-sampling then down-sampling of ``src`` by ``col`` as CTEs; the result is ``name``."""
    h = "md5('42:' || row_id)"

    def counted(of):
        return f"""SELECT *, count(*) OVER (PARTITION BY session_id, lab) AS c, count(*) OVER (PARTITION BY session_id) AS n,
                          row_number() OVER (PARTITION BY session_id, lab ORDER BY {h}, row_id) AS rk
                   FROM (SELECT *, coalesce({col}, 'Unknown') AS lab FROM {of})"""

    need = "CAST(ceil((0.05::DOUBLE * n - c) / (1.0::DOUBLE - 0.05::DOUBLE)) AS BIGINT)"
    keep = "CAST(trunc((n - c) * 0.6::DOUBLE / (1.0::DOUBLE - 0.6::DOUBLE)) AS BIGINT)"
    plain = "session_id, row_id, genre, country"
    return [
        (f"{name}_c", counted(src)),
        (f"{name}_up", f"""
            SELECT {plain} FROM {name}_c
            UNION ALL SELECT {plain} FROM (
              SELECT {plain}, unnest(range(need // c + CASE WHEN rk <= need % c THEN 1 ELSE 0 END)) AS i
              FROM (SELECT *, {need} AS need FROM {name}_c WHERE c / n < 0.05::DOUBLE) WHERE need > 0)"""),
        (f"{name}_d", counted(f"{name}_up")),
        (name, f"""SELECT {plain} FROM {name}_d
                   WHERE NOT (c / n > 0.6::DOUBLE AND {keep} > 0) OR rk <= {keep}"""),
    ]


M_SQL = VALID + _step_sql("valid", "genre", "m_genre") + _step_sql("m_genre", "country", "m_country")


@register("m1_upsample_rows", with_ctes(["derived"], M_SQL[:len(VALID) + 2], """
    SELECT session_id, row_id, count(*) AS copies FROM m_genre_up GROUP BY ALL"""))
def m1_upsample_rows(spark, sf_dir):
    return Q.upsample(rebalanced(spark, sf_dir), "genre").groupBy("session_id", "row_id").agg(F.count(F.lit(1)).alias("copies"))


@register("m2_downsample_rows", with_ctes(["derived"], VALID + [("c", """
    SELECT *, count(*) OVER (PARTITION BY session_id, lab) AS c, count(*) OVER (PARTITION BY session_id) AS n,
           row_number() OVER (PARTITION BY session_id, lab ORDER BY md5('42:' || row_id), row_id) AS rk
    FROM (SELECT *, coalesce(genre, 'Unknown') AS lab FROM valid)""")], """
    SELECT session_id, row_id FROM c
    WHERE NOT (c / n > 0.6::DOUBLE AND CAST(trunc((n - c) * 0.6::DOUBLE / (1.0::DOUBLE - 0.6::DOUBLE)) AS BIGINT) > 0)
       OR rk <= CAST(trunc((n - c) * 0.6::DOUBLE / (1.0::DOUBLE - 0.6::DOUBLE)) AS BIGINT)"""))
def m2_downsample_rows(spark, sf_dir):
    return Q.downsample(rebalanced(spark, sf_dir), "genre").select("session_id", "row_id")


def _share_sql(src: str) -> str:
    return f"""SELECT session_id, slice, label, round(count(*) / sum(count(*)) OVER (PARTITION BY session_id, slice), 4) + 0.0 AS share,
                      CAST(sum(count(*)) OVER (PARTITION BY session_id, slice) AS BIGINT) AS total
               FROM (SELECT session_id, 'genre' AS slice, coalesce(genre, 'Unknown') AS label FROM {src}
                     UNION ALL SELECT session_id, 'country', coalesce(country, 'Unknown') FROM {src}) GROUP BY session_id, slice, label"""


@register("m3_mitigate_then_report", with_ctes(["derived"], M_SQL + [("b", _share_sql("valid")), ("a", _share_sql("m_country"))], """
    SELECT coalesce(b.session_id, a.session_id) AS session_id, coalesce(b.slice, a.slice) AS slice,
           coalesce(b.label, a.label) AS label, coalesce(b.share, 0.0) AS before, b.total AS rows_before,
           coalesce(a.share, 0.0) AS after, a.total AS rows_after,
           coalesce(b.share, 0.0) < 0.05 AND coalesce(a.share, 0.0) >= 0.05 AS upsampled,
           coalesce(b.share, 0.0) > 0.6 AND coalesce(a.share, 0.0) <= 0.6 AS downsampled
    FROM b FULL OUTER JOIN a ON b.session_id = a.session_id AND b.slice = a.slice AND b.label = a.label"""))
def m3_mitigate_then_report(spark, sf_dir):
    """M3 + A10: genre then country re-balancing, then before/after shares."""
    v = rebalanced(spark, sf_dir, SLICES)
    after = Q.mitigate(v, SLICES, cut_lineage=lambda df: materialise(df, "mitigated"))
    return Q.mitigation_report(v, after, SLICES)
