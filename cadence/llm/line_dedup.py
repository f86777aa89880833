"""Substring dedup by line or paragraph hashing.

Texts are cut into units (lines, or paragraphs between blank lines). A unit is normalised (lower
case, white space collapsed), and its 128-bit digest is grouped over all documents. The earliest
occurrence (smallest doc_id, nulls last, then the text's content key, then the place in the text)
stays; every later one is removed, with its offsets in the original text kept in the result.

Every unit with a word counts, however short. A caller who wants headings, page numbers and the like
to stay can exempt units that are short in words *and* in characters (``short``; the default exempts
none): a long line without spaces, as in Chinese or an URL, still counts. Units of white space only
are never removed. Defined results: a null text has no units; rows equal in id and text share one
rank, so they are treated alike and both keep what the first of them keeps; an empty table gives
an empty result; extra columns pass through.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from cadence.llm.common import materialise, packed, text_key

MIN_WORDS = 1
SHORT_UNITS = (5, 40)      # for callers that exempt headings: fewer words than this and fewer characters
_PARAGRAPH = re.compile(r"(?:[^\n]*[^\s][^\n]*(?:\n|$))+|[^\n]*\n|[^\n]+$")


def units(text: str, kind: str = "line") -> Iterator[tuple[int, int]]:
    """``(start, end)`` of the units, which together are the whole text."""
    if kind == "paragraph":
        yield from (m.span() for m in _PARAGRAPH.finditer(text) if m.end() > m.start())
        return
    at = 0
    while at < len(text):
        end = text.find("\n", at) + 1 or len(text)
        yield at, end
        at = end


def digest(unit: str, min_words: int = MIN_WORDS, short: tuple[int, int] = (0, 0)) -> bytes | None:
    """128-bit digest of the normalised unit; None if it is too short to count."""
    words = unit.lower().split()
    if len(words) < max(min_words, 1):
        return None
    normal = " ".join(words)
    if len(words) < short[0] and len(normal) < short[1]:
        return None
    return hashlib.blake2b(normal.encode("utf-8", "surrogatepass"), digest_size=16).digest()


def unit_table(docs: DataFrame, kind: str = "line", min_words: int = MIN_WORDS, text_col: str = "text",
               short: tuple[int, int] = (0, 0)) -> DataFrame:
    """``(doc_id, text_key, place, start, end, hi, lo, n)``: the units that count, with digests and with
    their number in the text."""
    id_type = docs.schema["doc_id"].dataType.simpleString()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 1024):
                part = batch.slice(lo, 1024)
                owner, place, starts, ends, hi, low, count = [], [], [], [], [], [], []
                for i, text in enumerate(part.column(2).to_pylist()):
                    before = len(owner)
                    for n, (s, e) in enumerate(units(text or "", kind)):
                        d = digest(text[s:e], min_words, short)
                        if d is not None:
                            owner.append(i)
                            place.append(n)
                            starts.append(s)
                            ends.append(e)
                            hi.append(int.from_bytes(d[:8], "big", signed=True))
                            low.append(int.from_bytes(d[8:], "big", signed=True))
                    count += [len(owner) - before] * (len(owner) - before)
                at = pa.array(owner, pa.int32())
                yield pa.RecordBatch.from_arrays(
                    [part.column(0).take(at), part.column(1).take(at), *[pa.array(x, pa.int32()) for x in (place, starts, ends)],
                     pa.array(hi, pa.int64()), pa.array(low, pa.int64()), pa.array(count, pa.int64())],
                    ["doc_id", "text_key", "place", "start", "end", "hi", "lo", "n"])

    text = docs[text_col].cast("string")
    base = docs.select(docs["doc_id"].alias("doc_id"), text_key(text).alias("text_key"), text.alias("t"))
    return base.mapInArrow(cut, f"doc_id {id_type}, text_key long, place int, start int, end int, hi long, lo long, n long")


def removals(docs: DataFrame, kind: str = "line", min_words: int = MIN_WORDS, text_col: str = "text",
             short: tuple[int, int] = (0, 0)) -> DataFrame:
    """``(doc_id, text_key, n_units, removed)`` per document with units; ``removed`` holds the
    (start, end) of the units that occur earlier, in order."""
    u = materialise(unit_table(docs, kind, min_words, text_col, short), "line-units")
    rank = F.struct(F.col("doc_id").isNull().alias("n"), "doc_id", "text_key", "place")
    # partial minima per task first, so a line in a third of all documents is a few rows here; written,
    # so that the join with the rows of such a line can be split
    first = u.groupBy("hi", "lo").agg(F.min(rank).alias("first"), F.count("*").alias("n")).where("n > 1").drop("n")
    first = materialise(first, "line-firsts")
    later = u.drop("n").join(first, ["hi", "lo"]).where(rank != F.col("first"))
    # rows equal in id and text give each unit twice: distinct spans
    gone = later.groupBy("doc_id", "text_key").agg(F.sort_array(F.collect_set(F.struct("start", "end"))).alias("removed"))
    per_doc = u.groupBy("doc_id", "text_key").agg(F.max("n").alias("n_units")).alias("d")
    g = gone.alias("g")
    on = F.col("d.doc_id").eqNullSafe(F.col("g.doc_id")) & (F.col("d.text_key") == F.col("g.text_key"))
    none = F.array().cast("array<struct<start:int,end:int>>")
    return per_doc.join(g, on, "left").select("d.doc_id", "d.text_key", "n_units", F.coalesce("removed", none).alias("removed"))


def dedup_units(docs: DataFrame, kind: str = "line", min_words: int = MIN_WORDS, text_col: str = "text",
                short: tuple[int, int] = (0, 0)) -> DataFrame:
    """``(row, n_units, removed, kept_text)`` for every input row."""
    gone = removals(docs, kind, min_words, text_col, short).alias("g")
    rows = docs.select(packed(docs).alias("row"), docs["doc_id"].alias("doc_id"), docs[text_col].cast("string").alias("t"),
                       text_key(docs[text_col].cast("string")).alias("text_key")).alias("d")
    on = F.col("d.doc_id").eqNullSafe(F.col("g.doc_id")) & (F.col("d.text_key") == F.col("g.text_key"))
    empty = F.array().cast("array<struct<start:int,end:int>>")
    joined = rows.join(gone, on, "left").select("row", "t", F.coalesce("n_units", F.lit(0).cast("long")).alias("n_units"),
                                                F.coalesce("removed", empty).alias("removed"))

    @F.pandas_udf("string")
    def keep(texts: pd.Series, spans: pd.Series) -> pd.Series:
        out = []
        for t, gone in zip(texts, spans):
            if t is None or not len(gone):
                out.append(t)
                continue
            at, parts = 0, []
            for s in gone:
                parts.append(t[at:s["start"]])
                at = s["end"]
            out.append("".join(parts) + t[at:])
        return pd.Series(out, dtype=object)

    return joined.select("row", "n_units", "removed", F.when(F.size("removed") > 0, keep("t", "removed")).otherwise(F.col("t")).alias("kept_text"))
