"""Data quality per session: slice bias (A1-A5), profile and schema rules (A6-A8), session
anomaly report (A9), re-balancing (M1-M3) and its report (A10), slice engagement (A30).

Results are long tables keyed by ``session_id`` (one row per session x slice x label, etc.);
a nested JSON report is a ``to_json(struct)`` projection of them (S5).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cadence.functions.scalars import format_pct1, round_to
from cadence.operators.selection import DIRECT_VALUES, quantiles
from cadence.session import materialise

# Fixed thresholds of the reference.
UNDERREPRESENTED_SHARE = 0.01     # A3
BIAS_SHARE = 0.6                  # A3 flag
UPSAMPLE_SHARE = 0.05             # M1
DOMINANCE_SHARE = 0.6             # M2
INVALID_PCT = 5.0                 # A9
UNKNOWN_GENRE_PCT = 30.0          # A9
ZERO_VIEW_PCT = 20.0              # A9 (declared, unchecked in the reference; D14)
NUMBER_TYPES = ("tinyint", "smallint", "int", "bigint", "float", "double", "decimal")
# Expected schema of a valid track: column -> (nullable, numeric, min, max)
EXPECTED_SCHEMA = {
    "playlist_name": (False, False, None, None),
    "track_title": (False, False, None, None),
    "artist_name": (True, False, None, None),
    "video_id": (False, False, None, None),
    "genre": (True, False, None, None),
    "country": (True, False, None, None),
    "collection_name": (True, False, None, None),
    "collection_id": (True, False, None, None),
    "trackTimeMillis": (False, True, 0, None),
    "trackTimeSeconds": (False, True, 0, None),
    "view_count": (False, True, 0, None),
    "like_count": (False, True, 0, None),
    "comment_count": (False, True, 0, None),
    "like_to_view_ratio": (False, True, 0.0, 1.0),
    "comment_to_view_ratio": (False, True, 0.0, None),
}


def _labels(df: DataFrame, slices, key: str, unknown: str = "Unknown") -> DataFrame:
    """(key, slice, label): one row per input row and slice column present (missing skipped)."""
    present = [c for c in slices if c in df.columns]
    pairs = F.array(*[F.struct(F.lit(c).alias("slice"),
                               F.coalesce(F.col(c).cast("string"), F.lit(unknown)).alias("label"))
                      for c in present])
    return df.select(key, F.explode(pairs).alias("_p")).select(key, "_p.slice", "_p.label")


def slice_counts(df: DataFrame, slices, key: str = "session_id") -> DataFrame:
    """A1: (key, slice, label, count, total, proportion[4 dp])."""
    c = _labels(df, slices, key).groupBy(key, "slice", "label").agg(F.count(F.lit(1)).alias("count"))
    # label counts are few per session; their total needs no second look at the rows
    return (c.withColumn("total", F.sum("count").over(Window.partitionBy(key, "slice")))
            .withColumn("proportion", round_to(F.col("count") / F.col("total"), 4)))


def _stats(c: DataFrame, key: str) -> DataFrame:
    """A2-A3 from label counts ``(key, slice, label, count, total)``."""
    p = F.col("count") / F.col("total")
    return (c.groupBy(key, "slice")
            .agg(F.first("total").alias("total"),
                 F.count(F.lit(1)).alias("label_count"),
                 F.count_distinct("count").alias("unique_values"),
                 round_to(-F.sum(p * F.ln(p)), 4).alias("entropy"),
                 F.min_by("label", F.struct(-F.col("count"), F.col("label"))).alias("dominant_label"),
                 F.max("count").alias("_dc"),
                 F.array_sort(F.collect_list(F.when(p < UNDERREPRESENTED_SHARE, F.col("label"))))
                 .alias("underrepresented"))
            .withColumn("max_entropy", round_to(F.ln(F.greatest(F.col("label_count"), F.lit(1)).cast("double")), 4))
            .withColumn("dominant_share", round_to(F.col("_dc") / F.col("total"), 4))
            .withColumn("bias_flag", (F.col("_dc") / F.col("total")) > BIAS_SHARE)
            .drop("_dc"))


def slice_stats(df: DataFrame, slices, key: str = "session_id") -> DataFrame:
    """A1-A3 per (key, slice): total, label_count, unique_values (distinct counts, D12),
    entropy / max_entropy (natural log, 4 dp), dominant label and share, under-represented
    labels (< 1 %), bias_flag (dominant > 60 %). Ties for dominant: count desc, label asc."""
    return _stats(slice_counts(df, slices, key), key)


def slice_sets(df: DataFrame, slices, key: str = "session_id") -> DataFrame:
    """A1 and A4's counts in one scan: (key, a, b, a_label, b_label, n) with ``b`` null for the counts
    of one slice. One grouping set per slice and per pair of slices."""
    present = [c for c in slices if c in df.columns]
    labels = df.select(key, *[F.coalesce(F.col(c).cast("string"), F.lit("Unknown")).alias(c) for c in present])
    pairs = [(a, b) for i, a in enumerate(present) for b in present[i + 1:]]
    sets = [[F.col(key), F.col(c)] for c in present] + [[F.col(key), F.col(a), F.col(b)] for a, b in pairs]
    out = labels.groupingSets(sets, key, *present).agg(F.count(F.lit(1)).alias("n"), *[F.grouping(c).alias(f"_g_{c}") for c in present])
    # what the row is grouped by, first to last
    by = F.filter(F.array(*[F.when(F.col(f"_g_{c}") == 0, F.struct(F.lit(c).alias("slice"), F.col(c).alias("label"))) for c in present]), lambda x: x.isNotNull())
    return out.withColumn("_by", by).select(key, F.col("_by")[0]["slice"].alias("a"), F.get("_by", F.lit(1))["slice"].alias("b"),
                                            F.col("_by")[0]["label"].alias("a_label"), F.get("_by", F.lit(1))["label"].alias("b_label"), "n")


def cross_slices(sets: DataFrame, key: str = "session_id") -> DataFrame:
    """A4 for every pair of slices: the row-normalised cross table in long format (key, pair, a_label,
    b_label, n, share), with a row for every label of one slice and every label of the other that the
    session has; combinations that do not occur are 0.

    A session's labels are lists of its distinct labels (bounded by the vocabularies), joined per pair."""
    single, cross = sets.where("b is null"), sets.where("b is not null")
    labels = single.groupBy(key, "a").agg(F.collect_list(F.struct(F.col("a_label").alias("label"), F.col("n").alias("row_n"))).alias("labels"))
    pairs = cross.groupBy(key, "a", "b").agg(F.map_from_entries(F.collect_list(F.struct(F.struct("a_label", "b_label"), "n"))).alias("cells"))
    left, right = labels.select(key, "a", F.col("labels").alias("la")), labels.select(key, F.col("a").alias("b"), F.col("labels").alias("lb"))
    grid = pairs.join(left, [key, "a"]).join(right, [key, "b"])
    rows = grid.select(key, "a", "b", "cells", "lb", F.explode("la").alias("x")).select(key, "a", "b", "cells", "x", F.explode("lb").alias("y"))
    n = F.coalesce(F.try_element_at("cells", F.struct(F.col("x.label").alias("a_label"), F.col("y.label").alias("b_label"))), F.lit(0).cast("long"))
    return rows.select(key, F.concat("a", F.lit("_x_"), "b").alias("pair"), F.col("x.label").alias("a_label"), F.col("y.label").alias("b_label"),
                       n.alias("n"), round_to(n / F.col("x.row_n"), 4).alias("share"))


def cross_slice(df: DataFrame, a: str, b: str, key: str = "session_id") -> DataFrame:
    """A4: row-normalised cross table of two slices, long format (key, pair, a_label, b_label, share)."""
    return cross_slices(materialise(slice_sets(df, [a, b], key), "slice-counts"), key).drop("n")


def bias_summary(df: DataFrame, slices, key: str = "session_id") -> DataFrame:
    """A5 per key: record_count, the slices flagged as biased, the statistics of every slice (A1-A3) and
    the cross tables of every pair of slices (A4), from one scan. Missing columns are skipped."""
    sets = materialise(slice_sets(df, slices, key), "slice-counts")
    counts = sets.where("b is null").select(key, F.col("a").alias("slice"), F.col("a_label").alias("label"), F.col("n").alias("count"))
    st = _stats(counts.withColumn("total", F.sum("count").over(Window.partitionBy(key, "slice"))), key)
    per_slice = F.struct("slice", "total", "label_count", "unique_values", "entropy", "max_entropy", "dominant_label", "dominant_share", "underrepresented", "bias_flag")
    flags = st.groupBy(key).agg(F.max("total").alias("record_count"),
                                F.array_sort(F.collect_list(F.when(F.col("bias_flag"), F.col("slice")))).alias("overall_bias_flags"),
                                F.array_sort(F.collect_list(per_slice)).alias("slices"))
    cross = cross_slices(sets, key).groupBy(key, "pair").agg(F.array_sort(F.collect_list(F.struct("a_label", "b_label", "share"))).alias("cells"))
    cross = cross.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("pair", "cells"))).alias("cross_slices"))
    return flags.join(cross, key, "left")


# ---- A6-A8 ---------------------------------------------------------------------------

def column_profile(df: DataFrame, columns, numeric, key: str = "session_id", direct_rows: int = DIRECT_VALUES) -> DataFrame:
    """A6 long format: (key, column, missing_count, missing_pct, unique_count, mean, std, min,
    max, p25, p75), the statistics of numbers null for text columns. Percentiles are exact linear
    interpolation (pandas ``quantile``).

    The rows are written once and dealt by key once; a key's columns are unpivoted, reduced to distinct
    values and summed up where they are. Keys with more than ``direct_rows`` rows are not: their distinct
    values are written, and no task holds a group of them."""
    rows = materialise(df.select(key, *columns), "profile-rows")
    large = rows.groupBy(key).agg(F.count(F.lit(1)).alias("_rows")).where(F.col("_rows") > direct_rows)
    large = materialise(large.select(F.col(key).alias("_large")), "large-keys")
    on = F.col(key).eqNullSafe(F.col("_large"))
    if large.isEmpty():
        return _profile_direct(_profile_cells(rows.repartition(key), columns, numeric, key), key)
    direct = _profile_cells(rows.join(large, on, "left_anti").repartition(key), columns, numeric, key)
    return _profile_direct(direct, key).unionByName(_profile_selected(_profile_cells(rows.join(large, on, "left_semi"), columns, numeric, key), key))


def _profile_cells(df: DataFrame, columns, numeric, key: str) -> DataFrame:
    """``(key, column, value, text, missing, n)``: the distinct values of every column."""

    def cell(c):
        number = F.nanvl(F.col(c).cast("double"), F.lit(None).cast("double")) if c in numeric else F.lit(None).cast("double")
        text = F.lit(None).cast("string") if c in numeric else F.col(c).cast("string")
        return F.struct(F.lit(c).alias("column"), number.alias("value"), text.alias("text"), F.coalesce(number.cast("string"), text).isNull().alias("missing"))

    cells = F.array(*[cell(c) for c in columns])
    cells = df.select(key, F.explode(cells).alias("_c")).select(key, "_c.*")
    return cells.groupBy(key, "column", "value", "text", "missing").agg(F.count(F.lit(1)).alias("n"))


def _profile_sums() -> list:
    return [F.sum("n").alias("_rows"), F.sum(F.when(F.col("missing"), F.col("n")).otherwise(0)).alias("missing_count"),
            F.count_if(~F.col("missing")).alias("unique_count"), F.sum(F.when(F.col("value").isNotNull(), F.col("n"))).alias("_n"),
            F.sum(F.col("value") * F.col("n")).alias("_sum"), F.min("value").alias("min"), F.max("value").alias("max")]


def _profile_direct(values: DataFrame, key: str) -> DataFrame:
    """The statistics of groups whose distinct values fit one list."""
    v = F.col("value")
    per = values.groupBy(key, "column").agg(*_profile_sums(), F.percentile("value", F.array(F.lit(0.25), F.lit(0.75)), F.col("n")).alias("_q"),
                                            F.collect_list(F.when(v.isNotNull(), F.struct("value", "n"))).alias("_v"))
    per = per.withColumn("mean", F.col("_sum") / F.col("_n"))
    known = F.col(key).isNotNull()      # rows without a key have no spread and no percentiles
    squares = F.aggregate("_v", F.lit(0.0), lambda a, x: a + x["n"] * F.pow(x["value"] - F.col("mean"), 2))
    return _profile_rounded(per.withColumn("_squares", F.when(known, squares)).withColumn("p25", F.when(known, F.col("_q")[0])).withColumn("p75", F.when(known, F.col("_q")[1])), key)


def _profile_selected(values: DataFrame, key: str) -> DataFrame:
    """The statistics of groups of any size, by selection."""
    values = materialise(values, "column-values")
    on = [key, "column"]
    sums = values.groupBy(*on).agg(*_profile_sums()).withColumn("mean", F.col("_sum") / F.col("_n"))
    numbers = values.where("value is not null").select(*on, "value", "n")
    # squares of differences from the mean: sums of squares would lose the digits of large values
    spread = numbers.join(sums.select(*on, "mean"), on).groupBy(*on).agg(F.sum(F.col("n") * F.pow(F.col("value") - F.col("mean"), 2)).alias("_squares"))
    at = quantiles(numbers, on, [0.25, 0.75]).select(*on, F.col("quantiles")[0].alias("p25"), F.col("quantiles")[1].alias("p75"))
    return _profile_rounded(sums.join(spread, on, "left").join(at, on, "left"), key)


def _profile_rounded(out: DataFrame, key: str) -> DataFrame:
    on = [key, "column"]
    std = F.when(F.col("_n") > 1, F.sqrt(F.col("_squares") / (F.col("_n") - 1)))
    return out.select(*on, "missing_count", round_to(F.col("missing_count") / F.col("_rows") * 100, 2).alias("missing_pct"), "unique_count",
                      round_to("mean", 4).alias("mean"), round_to(std, 4).alias("std"), *[round_to(c, 4).alias(c) for c in ("min", "max", "p25", "p75")])


def _violation_counts(df: DataFrame, schema: dict) -> tuple[list, list]:
    """The aggregates that count each kind of violation, and (column, issue, aggregate's name) of each;
    no name for a missing column, which is one violation."""
    types = dict(df.dtypes)
    aggs, specs = [], []
    for c, (nullable, numeric, lo, hi) in schema.items():
        if c not in df.columns:
            specs.append((c, "missing_column", None))
            continue
        # a column of another type has no range to check (its nulls still count)
        numeric = numeric and types[c].startswith(NUMBER_TYPES)
        if not nullable:
            specs.append((c, "unexpected_nulls", f"_n_{c}"))
            aggs.append(F.count_if(F.col(c).isNull()).alias(f"_n_{c}"))
        if numeric and lo is not None:
            specs.append((c, f"below_min_{lo}", f"_lo_{c}"))
            aggs.append(F.count_if(F.col(c) < F.lit(lo)).alias(f"_lo_{c}"))
        if numeric and hi is not None:
            specs.append((c, f"above_max_{hi}", f"_hi_{c}"))
            aggs.append(F.count_if(F.col(c) > F.lit(hi)).alias(f"_hi_{c}"))
    return aggs, specs


def schema_violations(df: DataFrame, key: str = "session_id", schema: dict | None = None) -> DataFrame:
    """(key, column, issue, count) for missing columns, unexpected nulls, below min, above max;
    ranges only of columns of a number type."""
    aggs, specs = _violation_counts(df, schema or EXPECTED_SCHEMA)
    counts = df.groupBy(key).agg(*aggs) if aggs else df.select(key).distinct()
    rows = F.array(*[F.struct(F.lit(c).alias("column"), F.lit(issue).alias("issue"),
                              (F.col(a) if a else F.lit(1).cast("long")).alias("count"))
                     for c, issue, a in specs])
    return (counts.select(key, F.explode(rows).alias("v")).select(key, "v.*")
            .where(F.col("count") > 0))


def validation_report(df: DataFrame, key: str = "session_id") -> DataFrame:
    """(key, row_count, column_count, violation_count, schema_valid), from one look at the rows.
    Violations of rows without a key belong to no session and are not counted."""
    aggs, specs = _violation_counts(df, EXPECTED_SCHEMA)
    found = [F.lit(1) if a is None else (F.col(a) > 0).cast("int") for _, _, a in specs]
    total = F.aggregate(F.array(*found), F.lit(0).cast("long"), lambda n, x: n + x)
    counts = df.groupBy(key).agg(F.count(F.lit(1)).alias("row_count"), *aggs)
    return (counts.select(key, "row_count", F.when(F.col(key).isNull(), F.lit(0).cast("long")).otherwise(total).alias("violation_count"))
            .withColumn("column_count", F.lit(len([c for c in df.columns if c != key])))
            .withColumn("schema_valid", F.col("violation_count") == 0))


# ---- A9 ------------------------------------------------------------------------------

def session_anomalies(validated: DataFrame, key: str = "session_id", check_zero_views: bool = False) -> DataFrame:
    """Invalid share > 5 %, unknown-genre share of valid rows > 30 % (genre null -> 'Unknown'),
    optional zero-view share > 20 % (D14). Output: key, anomalies array<struct<kind,value,threshold,
    message>>, triggered."""
    valid = F.col("error").isNull()
    g = F.coalesce(F.col("genre"), F.lit("Unknown"))
    a = (validated.groupBy(key)
         .agg(F.count_if(valid).alias("valid"), F.count_if(~valid).alias("invalid"),
              F.count_if(valid & (g == "Unknown")).alias("unknown"),
              F.count_if(valid & (F.col("view_count") == 0)).alias("zero_views")))
    total = F.col("valid") + F.col("invalid")
    inv_pct = F.col("invalid") / total * 100
    unk_pct = F.col("unknown") / F.col("valid") * 100
    zero_pct = F.col("zero_views") / F.col("valid") * 100
    items = [
        F.when((total > 0) & (inv_pct > INVALID_PCT), F.struct(
            F.lit("high_invalid_rate").alias("kind"), round_to(inv_pct, 2).alias("value"),
            F.lit(INVALID_PCT).alias("threshold"),
            F.format_string("%s%% of records failed validation (%d/%d)", format_pct1(inv_pct), F.col("invalid"),
                            total).alias("message"))),
        F.when((F.col("valid") > 0) & (unk_pct > UNKNOWN_GENRE_PCT), F.struct(
            F.lit("high_unknown_genre").alias("kind"), round_to(unk_pct, 2).alias("value"),
            F.lit(UNKNOWN_GENRE_PCT).alias("threshold"),
            F.format_string("%s%% of tracks have unknown genre", format_pct1(unk_pct)).alias("message"))),
    ]
    if check_zero_views:
        items.append(F.when((F.col("valid") > 0) & (zero_pct > ZERO_VIEW_PCT), F.struct(
            F.lit("high_zero_views").alias("kind"), round_to(zero_pct, 2).alias("value"),
            F.lit(ZERO_VIEW_PCT).alias("threshold"),
            F.format_string("%s%% of tracks have zero views", format_pct1(zero_pct)).alias("message"))))
    return (a.select(key, F.array_compact(F.array(*items)).alias("anomalies"))
            .withColumn("triggered", F.size("anomalies") > 0))


# ---- A30 -----------------------------------------------------------------------------

def slice_engagement(df: DataFrame, slices, key: str = "session_id") -> DataFrame:
    """Mean like / comment ratios and record count per slice label."""
    present = [c for c in slices if c in df.columns]
    pairs = F.array(*[F.struct(F.lit(c).alias("slice"),
                               F.coalesce(F.col(c).cast("string"), F.lit("Unknown")).alias("label"))
                      for c in present])
    return (df.select(key, "like_to_view_ratio", "comment_to_view_ratio", F.explode(pairs).alias("_p"))
            .groupBy(key, "_p.slice", "_p.label")
            .agg(round_to(F.avg("like_to_view_ratio"), 4).alias("avg_like_ratio"),
                 round_to(F.avg("comment_to_view_ratio"), 4).alias("avg_comment_ratio"),
                 F.count(F.lit(1)).alias("records")))


# ---- M1-M3: deterministic re-balancing -----------------------------------------------

def _label_col(col: str):
    return F.coalesce(F.col(col).cast("string"), F.lit("Unknown"))


def _row_hash(row_id: str, seed: int):
    """Order of the rows: md5 of (seed, row id), which any SQL engine can repeat."""
    return F.md5(F.concat(F.lit(f"{seed}:"), F.col(row_id).cast("string")).cast("binary"))


def _with_smallest(rows: DataFrame, keys: list[str], row_id: str) -> DataFrame:
    """Add ``_in``: is the row among the ``_t`` smallest by (_h, row_id) of its group?

    Every row has its group's ``_t``. Exact without sorting a large group in one task: a histogram over the
    first 16 bits of the hash finds the bucket that holds the boundary; only it is ranked."""
    rows = rows.withColumn("_b", F.substring("_h", 1, 4))
    hist = rows.groupBy(*keys, "_b").agg(F.count(F.lit(1)).alias("_nb"), F.max("_t").alias("_most"))
    run = Window.partitionBy(*keys).orderBy("_b").rowsBetween(Window.unboundedPreceding, 0)
    cut = (hist.withColumn("_cum", F.sum("_nb").over(run))
           .where(F.col("_cum") >= F.col("_most"))
           .groupBy(*keys).agg(F.min_by(F.struct("_b", (F.col("_most") - F.col("_cum") + F.col("_nb")).alias("_r")), "_b").alias("_x"))
           .select(*keys, F.col("_x._b").alias("_cb"), F.col("_x._r").alias("_rem")))
    tagged = rows.join(cut, keys, "left")
    on_cut = F.coalesce(F.col("_b") == F.col("_cb"), F.lit(False))
    clear = tagged.where(~on_cut).withColumn("_in", F.coalesce(F.col("_b") < F.col("_cb"), F.lit(False)) & (F.col("_t") > 0))
    in_bucket = Window.partitionBy(*keys, "_b").orderBy("_h", row_id)
    edge = tagged.where(on_cut).withColumn("_in", F.row_number().over(in_bucket) <= F.col("_rem"))
    return clear.unionByName(edge).drop("_b", "_cb", "_rem")


def _repeat(df: DataFrame, times: str, block: int = 1000) -> DataFrame:
    """Each row as often as ``times`` says; two steps, so no array grows with the count."""
    blocks = F.floor((F.col(times) - 1) / block)
    df = df.where(F.col(times) > 0).withColumn("_blk", F.explode(F.sequence(F.lit(0).cast("long"), blocks)))
    n = F.least(F.lit(block).cast("long"), F.col(times) - F.col("_blk") * block)
    return df.withColumn("_one", F.explode(F.sequence(F.lit(1).cast("long"), n))).drop("_blk", "_one")


def upsample(df: DataFrame, col: str, key: str = "session_id", row_id: str = "row_id",
             seed: int = 42) -> DataFrame:
    """M1: for each label under 5 % add ceil((0.05·N - c) / 0.95) copies of its rows.

    The copies are dealt evenly: every row gets need div c, and the (need mod c) rows with the
    smallest hash one more; deterministic and independent of partitioning. Copies are identical
    to their row (the row id included)."""
    lab = df.withColumn("_label", _label_col(col))
    n = lab.groupBy(key).agg(F.count(F.lit(1)).alias("_N"))
    c = lab.groupBy(key, "_label").agg(F.count(F.lit(1)).alias("_c")).join(n, key)
    need = F.ceil((F.lit(UPSAMPLE_SHARE) * F.col("_N") - F.col("_c")) / (F.lit(1.0) - F.lit(UPSAMPLE_SHARE)))
    small = (c.where(F.col("_c") / F.col("_N") < UPSAMPLE_SHARE).withColumn("_need", need.cast("long"))
             .where(F.col("_need") > 0)
             .select(key, "_label", F.expr("_need div _c").alias("_each"), (F.col("_need") % F.col("_c")).alias("_t")))
    # few rows: read several times, so written, and hashed after they are found
    rows = materialise(lab.join(small, [key, "_label"]), "upsampled").withColumn("_h", _row_hash(row_id, seed))
    dealt = _with_smallest(rows, [key, "_label"], row_id)
    extra = _repeat(dealt.withColumn("_n", F.col("_each") + F.col("_in").cast("long")), "_n")
    return df.unionByName(extra.select(df.columns))


def downsample(df: DataFrame, col: str, key: str = "session_id", row_id: str = "row_id",
               seed: int = 42, strict: bool = False) -> DataFrame:
    """M2: a label over 60 % keeps int((N - c)·0.6 / 0.4) rows, those with the smallest hash.
    A label at 100 % would keep 0 rows; unless ``strict`` it is kept whole (D24)."""
    lab = df.withColumn("_label", _label_col(col))
    n = lab.groupBy(key).agg(F.count(F.lit(1)).alias("_N"))
    c = lab.groupBy(key, "_label").agg(F.count(F.lit(1)).alias("_c")).join(n, key)
    target = ((F.col("_N") - F.col("_c")) * F.lit(DOMINANCE_SHARE) / (F.lit(1.0) - F.lit(DOMINANCE_SHARE))).cast("long")
    dom = c.where(F.col("_c") / F.col("_N") > DOMINANCE_SHARE).withColumn("_t", target)
    if not strict:
        dom = dom.where(F.col("_t") > 0)
    dom = dom.select(key, "_label", "_t")
    # all rows meet the labels once; those of a dominant label are read several times
    marked = materialise(lab.join(dom, [key, "_label"], "left"), "downsampled")
    keep_all = marked.where("_t is null")
    some = _with_smallest(marked.where("_t is not null").withColumn("_h", _row_hash(row_id, seed)), [key, "_label"], row_id).where("_in")
    return keep_all.select(df.columns).unionByName(some.select(df.columns))


def mitigate(df: DataFrame, columns, key: str = "session_id", row_id: str = "row_id",
             seed: int = 42, cut_lineage=None) -> DataFrame:
    """M3: per column in order, up-sample then down-sample the running result. Copies share their
    source's row_id: they are identical rows, so any choice among them in a later step gives the
    same result. ``cut_lineage`` (e.g. ``cadence.session.cut_lineage``) materialises between
    columns in the shared checkpoint folder."""
    out = df
    for c in columns:
        if c not in out.columns:
            continue
        # both steps read their rows several times
        keep = cut_lineage or (lambda x: x)
        out = keep(downsample(keep(upsample(out, c, key, row_id, seed)), c, key, row_id, seed))
    return out


def mitigation_report(before: DataFrame, after: DataFrame, slices, key: str = "session_id") -> DataFrame:
    """A10: per (key, slice, label): share before / after (4 dp), rows before / after, and
    whether the label was lifted over 5 % or brought under 60 % (J8 full outer alignment)."""
    b = slice_counts(before, slices, key).select(key, "slice", "label", F.col("proportion").alias("before"),
                                                  F.col("total").alias("rows_before"))
    a = slice_counts(after, slices, key).select(key, "slice", "label", F.col("proportion").alias("after"),
                                                 F.col("total").alias("rows_after"))
    j = b.join(a, [key, "slice", "label"], "full_outer")
    return (j.withColumn("before", F.coalesce("before", F.lit(0.0)))
            .withColumn("after", F.coalesce("after", F.lit(0.0)))
            .withColumn("upsampled", (F.col("before") < UPSAMPLE_SHARE) & (F.col("after") >= UPSAMPLE_SHARE))
            .withColumn("downsampled", (F.col("before") > DOMINANCE_SHARE) & (F.col("after") <= DOMINANCE_SHARE)))
