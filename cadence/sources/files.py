"""File sources: CSV with pandas' missing-value tokens (S1), session shards (S2, U1), landed playlist pages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# The texts that pandas' CSV reader takes as missing.
NULL_TOKENS = ("", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN", "<NA>", "N/A", "NA",
               "NULL", "NaN", "None", "n/a", "nan", "null")


def null_tokens(df: DataFrame) -> DataFrame:
    """Every text column with the missing-value tokens as null."""
    text = [c for c, t in df.dtypes if t == "string"]
    return df.withColumns({c: F.when(~F.col(f"`{c}`").isin(*NULL_TOKENS), F.col(f"`{c}`")) for c in text})


def read_csv(spark: SparkSession, paths, schema=None) -> DataFrame:
    """CSV with header; tokens for missing values become null, then columns take ``schema``
    (names and types; a value that does not fit its type becomes null)."""
    raw = null_tokens(spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(paths))
    if schema is None:
        return raw
    wanted = {f.name: f.dataType for f in spark.createDataFrame([], schema).schema}
    return raw.select(*[(F.col(f"`{c}`").try_cast(t) if c in raw.columns else F.lit(None).cast(t)).alias(c) for c, t in wanted.items()])


def combine_shards(shards: list[DataFrame]) -> DataFrame | None:
    """All rows of a session's shards under the first shard's columns, which win: columns
    a later shard lacks are null, further ones are left out. No shards, no output (None)."""
    out = None
    for s in shards:
        if out is None:
            out = s
        else:
            out = out.unionByName(s.select(*[c for c in s.columns if c in out.columns]), allowMissingColumns=True)
    return out


def read_session_shards(spark: SparkSession, pattern: str, schema) -> DataFrame:
    """S2 over files: every CSV below ``pattern`` except combined outputs, with the file as lineage."""
    df = (spark.read.schema(schema).option("header", True).option("enforceSchema", False).csv(pattern)
          .select("*", F.col("_metadata.file_path").alias("source_file")))
    return null_tokens(df.where(~F.col("source_file").contains("/combined/")))


def playlist_tracks(pages: DataFrame) -> DataFrame:
    """Landed playlist pages (one JSON row per page: playlist_name, items[] with title and
    video id) -> one row per track, in page and item order."""
    return (pages.select("playlist_name", "page", F.posexplode("items").alias("position", "i"))
            .select("playlist_name", "page", "position", F.col("i.snippet.title").alias("track_title"),
                    F.col("i.snippet.resourceId.videoId").alias("video_id")))
