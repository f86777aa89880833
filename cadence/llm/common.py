"""Shared pieces of the training-data operators: word patterns and written intermediate tables."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from cadence.session import ensure_checkpoint_dir

# Maximal runs without ASCII white space; the same class in Java, RE2 and ``bytes.split()``.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh folder below the shared checkpoint folder (``spark.checkpoint.dir``)."""
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back: cuts the lineage, survives lost
    executors, and later uses read only the columns they need."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def text_key(text: Column) -> Column:
    """64-bit content key; with ``doc_id`` it names a row (rows equal in both are alike)."""
    return F.xxhash64(text)


def packed(df: DataFrame) -> Column:
    """All input columns as one struct, so that extra columns never clash with working names."""
    return F.struct(*[df[f"`{c}`"] for c in df.columns])
