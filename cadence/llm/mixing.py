"""Mixing sources to target weights.

Documents get a hash-random key. Per source the keys are range-sorted (65,536 equal key ranges),
prefix sums of the ranges' word counts find the range that holds the budget's cut, and only the
rows of that one range are ordered one by one. A source whose budget exceeds its size repeats
whole epochs first; the cut of the last epoch is exact to the word, so the document on the cut is
taken in part (its first words).

Weights go by the sources' code-point order (null last) and repeat. Targets stop at
``max_epochs`` times a source's size; the excess is shared anew by weight until none is above.

Defined results: a null or wordless text has size 0 and takes 0; a null source is a source of its
own; rows equal in id and text are interchangeable; an empty table gives an empty result; extra
columns pass through.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from cadence.llm.common import WORD, materialise, packed, text_key

# Fixed values of the default mix.
WEIGHTS = (3, 1, 2)
SHARE = 1.5
MAX_EPOCHS = 2.0
SEED = "mix-1"


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def mix_key(doc_id: Column, seed: str) -> Column:
    return F.md5(F.concat(F.lit(seed + ":"), F.coalesce(doc_id.cast("string"), F.lit("null"))).cast("binary"))


def source_targets(sizes: DataFrame, weights: Sequence[int] = WEIGHTS, share: float = SHARE,
                   max_epochs: float = MAX_EPOCHS) -> DataFrame:
    """``(source, source_size, target)`` from ``(source, source_size)``: one row per source.

    Closed form of the repeated sharing: with sources ordered by size over weight, the ones at
    their limit are a prefix of that order. The windows see one row per source.
    """
    by_name = Window.orderBy(F.col("source").isNull(), "source")
    w = F.get(F.array(*[F.lit(float(x)) for x in weights]),
              (F.row_number().over(by_name) - 1) % len(weights))
    s = sizes.withColumn("w", w).withColumn("cap", F.col("source_size") * F.lit(float(max_epochs)))
    by_ratio = Window.orderBy(F.col("cap") / F.col("w"), F.col("source").isNull(), "source")
    everything = Window.partitionBy()
    before, after = by_ratio.rowsBetween(Window.unboundedPreceding, -1), by_ratio.rowsBetween(0, Window.unboundedFollowing)
    total = F.sum("source_size").over(everything) * F.lit(float(share))
    s = (s.withColumn("total", total)
          .withColumn("left", F.col("total") - F.coalesce(F.sum("cap").over(before), F.lit(0.0)))
          .withColumn("w_left", F.sum("w").over(after)))
    s = s.withColumn("full", F.col("cap") * F.col("w_left") <= F.col("left") * F.col("w"))
    rest = F.col("total") - F.coalesce(F.sum(F.when(F.col("full"), F.col("cap"))).over(everything), F.lit(0.0))
    open_w = F.sum(F.when(~F.col("full"), F.col("w"))).over(everything)
    s = s.withColumn("target", F.when(F.col("full"), F.col("cap")).otherwise(rest * F.col("w") / open_w))
    return s.select("source", "source_size", "target")


def mix(docs: DataFrame, weights: Sequence[int] = WEIGHTS, share: float = SHARE,
        max_epochs: float = MAX_EPOCHS, seed: str = SEED) -> DataFrame:
    """``(row, size, source_size, target, taken)`` for every input row; needs the columns
    ``doc_id``, ``text`` and ``source``."""
    keyed = docs.select(packed(docs).alias("row"), docs["source"].alias("source"),
                        docs["text"].alias("text"), mix_key(docs["doc_id"], seed).alias("key"))
    keyed = keyed.withColumn("range", F.substring("key", 1, 4))
    # one pass over the texts: words per (source, key range); at most 65,536 rows per source
    ranges = materialise(keyed.groupBy("source", "range").agg(F.sum(n_words(F.col("text"))).alias("size")), "mix-ranges")
    targets = source_targets(ranges.groupBy("source").agg(F.sum("size").alias("source_size")), weights, share, max_epochs)
    budget = F.round("target").cast("long")
    epochs = F.when(F.col("source_size") > 0, F.floor(budget / F.col("source_size"))).otherwise(F.lit(0)).cast("long")
    plan = targets.withColumn("epochs", epochs).withColumn(
        "rest", F.when(F.col("source_size") > 0, budget - F.col("epochs") * F.col("source_size")).otherwise(F.lit(0)).cast("long"))
    # prefix sums in two levels (256 blocks of 256 ranges), so no task sees a source's every range
    blocked = ranges.withColumn("block", F.substring("range", 1, 2))
    blocks = blocked.groupBy("source", "block").agg(F.sum("size").alias("size"))
    by_block = Window.partitionBy("source").orderBy("block")
    blocks = blocks.select(F.col("source").alias("bs"), F.col("block").alias("bb"), (F.sum("size").over(by_block) - F.col("size")).alias("base"))
    inside = Window.partitionBy("source", "block").orderBy("range")
    inner = blocked.withColumn("inner", F.sum("size").over(inside) - F.col("size"))
    upto = inner.join(blocks, F.col("source").eqNullSafe(F.col("bs")) & (F.col("block") == F.col("bb"))).select(
        "source", "range", (F.col("base") + F.col("inner")).alias("offset"), "size")
    p, u = plan.alias("p"), upto.alias("u")
    # the key range of each source that holds the cut: the last that starts below it
    cut = (p.join(u, F.col("p.source").eqNullSafe(F.col("u.source")) & (F.col("u.offset") < F.col("p.rest")), "left")
            .groupBy("p.source", "p.source_size", "p.target", "p.epochs", "p.rest")
            .agg(F.max(F.struct("u.range", "u.offset")).alias("at")))
    cut = materialise(cut.select(F.col("source").alias("cut_source"), "source_size", "target", "epochs", "rest",
                                 F.col("at.range").alias("cut_range"), F.col("at.offset").alias("cut_offset")), "mix-cuts")

    rows = keyed.join(cut, keyed["source"].eqNullSafe(cut["cut_source"]))
    on_cut = F.col("range").eqNullSafe(F.col("cut_range"))
    plain = (rows.where(~on_cut).withColumn("size", n_words(F.col("text")))
                 .withColumn("extra", F.when(F.col("range") < F.col("cut_range"), F.col("size")).otherwise(F.lit(0))))
    order = Window.partitionBy("source").orderBy("key", "size", text_key(F.col("text")))
    edge = rows.where(on_cut).withColumn("size", n_words(F.col("text")))
    start = F.col("cut_offset") + F.sum("size").over(order.rowsBetween(Window.unboundedPreceding, 0)) - F.col("size")
    edge = edge.withColumn("extra", F.least(F.greatest(F.col("rest") - start, F.lit(0)), F.col("size")))
    cols = ["row", "size", "source_size", "target", "epochs", "extra"]
    both = plain.select(*cols[:-1], F.col("extra").cast("long")).unionByName(
        edge.select(*cols[:-1], F.col("extra").cast("long")))
    return both.select("row", "size", "source_size", "target",
                       (F.col("epochs") * F.col("size") + F.col("extra")).alias("taken"))


def mixed_documents(docs: DataFrame, **options) -> DataFrame:
    """The mix itself: each row as often as the mix takes it, with the columns of ``docs``.

    A part-taken document keeps its first words (and the white space between them) in its last
    copy, and ``n_chars``, if there, is that copy's length. Documents without words are not in it.
    """
    taken = mix(docs, **options).where(F.col("taken") > 0)
    whole = F.floor(F.col("taken") / F.col("size")).cast("int")
    part = (F.col("taken") % F.col("size")).cast("int")
    copies = F.concat(F.array_repeat(F.col("size").cast("int"), whole), F.when(part > 0, F.array(part)).otherwise(F.array().cast("array<int>")))
    out = taken.select("row", "size", F.explode(copies).alias("words"))
    ends = r"(?<=[^\x20\x09-\x0D])(?=[\x20\x09-\x0D])"
    short = F.array_join(F.slice(F.split(F.col("row.text"), ends), F.lit(1), F.col("words")), "")
    cut = F.col("words") < F.col("size")
    text = F.when(cut, short).otherwise(F.col("row.text"))

    def column(c: str) -> Column:
        if c == "text":
            return text.alias(c)
        if c == "n_chars":
            return F.when(cut, F.length(short).cast("long")).otherwise(F.col("row.n_chars")).alias(c)
        return F.col(f"row.`{c}`")

    return out.select(*[column(c) for c in docs.columns])
