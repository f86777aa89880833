"""Source divergence audit by three-dimensional cube partitioning.

Every language keeps the terms that occur in at least ``MIN_DOCS`` of its documents. A group is one
source of a language; its share of a term is the whole number

    p = 1 + floor(SCALE * (count + SMOOTH) / (N + SMOOTH * V))

with N the group's occurrences of kept terms and V the number of kept terms. The divergence of two
groups is the sum of abs(p - q) over all kept terms.

The work is cut into cells (group block, group block, term block). A slice (groups of one block,
terms of one block) is sent to every cell that it takes part in; a cell computes the partial
divergences of its pairs of groups over its terms, and the partial sums are added along the term
axis. A cell holds at most two blocks of ``GROUP_BLOCK`` groups and about ``TERM_BLOCK`` terms,
however many rows a language, a source or a term has. Counts are summed inside each task before they
are shuffled. All arithmetic is on whole numbers, so results do not depend on how rows are dealt.

Defined results: null text, language or source is read as the empty string; a group without kept
terms has count 0 for each; a language without kept terms has divergence 0 between its sources and
no term rows; a source alone in its language has no pairs; repeated rows count each time; an empty
table gives an empty result; extra columns are not read.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from cadence.llm.common import materialise

MIN_DOCS = 30
SCALE = 1_000_000_000
SMOOTH = 5
TOP_TERMS = 50
GROUP_BLOCK = 64            # groups of a block: a cell's result is at most 64 x 64 pairs
TERM_BLOCK = 1024           # terms of a block, on average (dealt by hash)
TASK_TERMS = 400_000        # distinct (group, term) counts that a task holds before it hands them on
PIECE_BYTES = 1 << 22       # a longer text is counted in pieces, cut between terms

# Terms are runs of ASCII letters and of anything beyond ASCII; only A-Z are lower-cased.
_TO_TERMS = bytes(c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def terms(text: str | None) -> list[bytes]:
    """The terms of a text, in order, as UTF-8."""
    return (text or "").encode("utf-8", "surrogatepass").translate(_TO_TERMS).split()


def _count(text: str) -> Counter:
    raw = text.encode("utf-8", "surrogatepass").translate(_TO_TERMS)
    found, at = Counter(), 0
    while at < len(raw):
        end = raw.find(b" ", at + PIECE_BYTES) if len(raw) - at > PIECE_BYTES else -1
        end = len(raw) if end < 0 else end
        found.update(raw[at:end].split())
        at = end
    return found


def _groups(docs: DataFrame, text_col: str, lang_col: str, source_col: str) -> list[Column]:
    empty = lambda c: F.coalesce(docs[c].cast("string"), F.lit(""))
    return [empty(lang_col).alias("lang"), empty(source_col).alias("source"), empty(text_col).alias("t")]


def term_counts(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """``(lang, source, term, n, docs)``: occurrences and documents of every term of every group."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple, tuple[Counter, Counter]] = {}

        def hand_on() -> Iterator[pa.RecordBatch]:
            for (lang, source), (n, in_docs) in held.items():
                size = len(n)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([lang] * size, pa.string()), pa.array([source] * size, pa.string()),
                     pa.array(list(n), pa.binary()).cast(pa.string()), pa.array(list(n.values()), pa.int64()),
                     pa.array([in_docs[t] for t in n], pa.int64())], ["lang", "source", "term", "n", "docs"])
            held.clear()

        for batch in batches:
            for lang, source, text in zip(*(c.to_pylist() for c in batch.columns)):
                found = _count(text)
                if not found:
                    continue
                n, in_docs = held.setdefault((lang, source), (Counter(), Counter()))
                n.update(found)
                in_docs.update(found.keys())
            if sum(len(n) for n, _ in held.values()) > TASK_TERMS:
                yield from hand_on()
        yield from hand_on()

    base = docs.select(*_groups(docs, text_col, lang_col, source_col))
    parts = base.mapInArrow(count, "lang string, source string, term string, n long, docs long")
    # one shuffle: the sums per source, the documents per language and the totals all share this key
    return parts.repartition("lang", "term").groupBy("lang", "term", "source").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def share(n: Column, total: Column, kept: Column) -> Column:
    """``1 + floor(SCALE * (n + SMOOTH) / (total + SMOOTH * kept))`` in whole numbers."""
    top = F.lit(SCALE).cast("decimal(18,0)") * (n + SMOOTH).cast("decimal(19,0)")
    return F.call_function("div", top, (total + SMOOTH * kept).cast("decimal(19,0)")) + 1


class Audit:
    """The written tables of one audit: ``groups(lang, source, total, kept, block, blocks, p0)`` and
    ``counts(lang, source, term, n, lang_n, place, tblock)`` of the kept terms."""

    def __init__(self, docs: DataFrame, text_col: str = "text", lang_col: str = "lang", source_col: str = "source",
                 min_docs: int = MIN_DOCS, group_block: int = GROUP_BLOCK, term_block: int = TERM_BLOCK):
        per_term = Window.partitionBy("lang", "term")
        counts = term_counts(docs, text_col, lang_col, source_col)
        counts = counts.withColumn("lang_docs", F.sum("docs").over(per_term)).withColumn("lang_n", F.sum("n").over(per_term))
        counts = materialise(counts.where(F.col("lang_docs") >= min_docs).select("lang", "source", "term", "n", "lang_n"), "audit-counts")
        vocab = counts.groupBy("lang", "term").agg(F.first("lang_n").alias("lang_n"))
        langs = materialise(vocab.groupBy("lang").agg(F.count("*").alias("kept"), F.sum("lang_n").alias("lang_total")), "audit-languages")
        totals = counts.groupBy("lang", "source").agg(F.sum("n").alias("total"))
        seen = docs.select(*_groups(docs, text_col, lang_col, source_col)[:2]).distinct()
        groups = seen.join(totals, ["lang", "source"], "left").join(langs, "lang", "left").fillna(0, ["total", "kept", "lang_total"])
        place = F.row_number().over(Window.partitionBy("lang").orderBy("source")) - 1
        groups = groups.withColumn("place", place)
        n_groups = groups.groupBy("lang").agg(F.count("*").alias("n_groups"))
        groups = groups.join(n_groups, "lang").select(
            "lang", "source", "total", "kept", "lang_total",
            F.expr(f"place div {group_block}").alias("block"), F.expr(f"(n_groups + {group_block - 1}) div {group_block}").alias("blocks"),
            F.expr(f"(kept + {term_block - 1}) div {term_block}").alias("term_blocks"),
            F.when(F.col("kept") > 0, share(F.lit(0), F.col("total"), F.col("kept"))).alias("p0"))
        self.groups = materialise(groups, "audit-groups")
        self.counts = counts

    def pairs(self) -> DataFrame:
        """``(lang, source, item, value)`` of every ordered pair of different sources of a language."""
        g = self.groups
        rows = self.counts.join(g, ["lang", "source"])
        tblock = F.pmod(F.xxhash64("term"), F.col("term_blocks")).alias("tblock")
        slices = rows.select("lang", "source", tblock, "term", share(F.col("n"), F.col("total"), F.col("kept")).alias("p"), "block", "blocks")
        # every group stands in each of its term blocks, with its share of a term that it does not have
        header = g.where("kept > 0").select("lang", "source", F.explode(F.sequence(F.lit(0).cast("long"), F.col("term_blocks") - 1)).alias("tblock"),
                                            F.lit(None).cast("string").alias("term"), F.col("p0").alias("p"), "block", "blocks")
        both = slices.unionByName(header)
        other = F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("other")
        sent = both.select("*", other).select(
            "lang", F.least("block", "other").alias("x"), F.greatest("block", "other").alias("y"), "tblock", "block", "source", "term", "p")
        # terms of a block that neither of a cell's group blocks has: their number, known per block
        sizes = self.counts.select("lang", "term").distinct().join(g.select("lang", "term_blocks").distinct(), "lang").groupBy(
            "lang", tblock).agg(F.count("*").alias("terms"))
        sizes = sizes.select("lang", "tblock", "terms")

        def cell(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
            return _cell(key[0].as_py(), key[1].as_py(), key[2].as_py(), table)

        partial = sent.groupBy("lang", "x", "y", "tblock").applyInArrow(
            cell, "lang string, tblock long, source string, item string, value long, seen long, absent long")
        partial = partial.join(sizes, ["lang", "tblock"]).withColumn("value", F.expr("value + (terms - seen) * absent"))
        found = partial.groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))
        found = found.unionByName(found.select("lang", F.col("item").alias("source"), F.col("source").alias("item"), "value"))
        # a language without kept terms has no cell: all its pairs are 0
        bare = g.where("kept = 0")
        a, b = bare.alias("a"), bare.alias("b")
        zero = a.join(b, F.expr("a.lang = b.lang and a.source <> b.source")).select("a.lang", "a.source", F.col("b.source").alias("item"), F.lit(0).cast("long").alias("value"))
        return found.unionByName(zero)

    def terms(self, top: int = TOP_TERMS) -> DataFrame:
        """``(lang, source, item, value, rank)``: the terms that a group has more of than its language,
        the ``top`` largest excesses of each group."""
        rows = self.counts.join(self.groups, ["lang", "source"]).where("n > 0")
        value = share(F.col("n"), F.col("total"), F.col("kept")) - share(F.col("lang_n"), F.col("lang_total"), F.col("kept"))
        rows = rows.select("lang", "source", F.col("term").alias("item"), value.alias("value")).where("value > 0")
        # each task keeps its own first rows of a group before anything is shuffled
        rank = F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item"))
        return rows.withColumn("rank", rank).where(F.col("rank") <= top)


def _cell(lang: str, x: int, y: int, table: pa.Table) -> pa.Table:
    """Partial divergences of one cell: the pairs (group of block x, group of block y) over the terms
    that any of them has. ``absent`` is abs(p0 - q0), which counts for each of the other terms."""
    block = table.column("block").to_numpy()
    source = np.array(table.column("source").to_pylist(), object)
    p = table.column("p").to_numpy()
    term = table.column("term").combine_chunks()
    header = term.is_null().to_numpy(zero_copy_only=False)
    codes = term.dictionary_encode()
    seen = len(codes.dictionary)
    at = codes.indices.fill_null(0).to_numpy()

    def matrix(b: int) -> tuple[list[str], np.ndarray, np.ndarray]:
        own = block == b
        names = sorted(set(source[own & header]))
        place = {s: i for i, s in enumerate(names)}
        rest = np.zeros(len(names), np.int64)
        for s, v in zip(source[own & header], p[own & header]):
            rest[place[s]] = v
        full = np.repeat(rest[:, None], seen, axis=1)
        here = own & ~header
        full[np.array([place[s] for s in source[here]], np.int64), at[here]] = p[here]
        return names, full, rest

    names, full, rest = matrix(x)
    names2, full2, rest2 = (names, full, rest) if x == y else matrix(y)
    a, b, value, absent = [], [], [], []
    for i, s in enumerate(names):
        lo = i + 1 if x == y else 0
        a += [s] * (len(names2) - lo)
        b += names2[lo:]
        value += np.abs(full2[lo:] - full[i]).sum(axis=1).tolist()
        absent += np.abs(rest2[lo:] - rest[i]).tolist()
    n, tblock = len(a), table.column("tblock")[0].as_py()
    return pa.table({"lang": pa.array([lang] * n, pa.string()), "tblock": pa.array([tblock] * n, pa.int64()), "source": pa.array(a, pa.string()),
                     "item": pa.array(b, pa.string()), "value": pa.array(value, pa.int64()), "seen": pa.array([seen] * n, pa.int64()),
                     "absent": pa.array(absent, pa.int64())})


def audit(docs: DataFrame, top: int = TOP_TERMS, **options) -> DataFrame:
    """``(lang, source, part, item, value, rank)``: part ``pair`` lists each group's divergence from
    the other sources of its language, part ``term`` its ``top`` terms above the language's share."""
    a = Audit(docs, **options)
    rank = F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item"))
    pair = materialise(a.pairs(), "audit-pairs").withColumn("rank", rank)
    part = lambda df, name: df.select("lang", "source", F.lit(name).alias("part"), "item", "value", F.col("rank").cast("int").alias("rank"))
    return part(pair, "pair").unionByName(part(a.terms(top), "term"))
