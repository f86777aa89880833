"""Benchmark decontamination with DataFrame functions only.

Windows of ``n`` consecutive normalised benchmark words go into a hash set that every task
holds; each document's windows are looked up in it, hits are verified word by word, and hit words or
documents can be removed. Up to ``max_table_windows`` windows the set is a constant table with the
words themselves, and nothing is shuffled. A larger benchmark is a bitmap of window hashes of at most
``MAX_BITMAP_BYTES``: the documents' windows are tested against it in place, and only those that pass
(the hits, and about one in thousands of the others) are joined with the benchmark's windows for
verification. The documents' other windows and the texts without any are never moved.

Words: A-Z lower-cased, then maximal runs of digits, a-z and non-ASCII characters. An item with
fewer than ``n`` words, but not none, is one window of its whole length.

Defined results: a null text has no words; an item with a null id still marks words, but is not
listed; repeated rows are judged alike; an empty benchmark hits nothing; extra columns pass.
"""

from __future__ import annotations

import json
import string

from pyspark.sql import Column, DataFrame, functions as F

from cadence.llm.common import materialise, packed

N = 10
MAX_TABLE_WINDOWS = 20_000      # a few MB in the plan and in each executor
BITS_PER_WINDOW = 64            # two bits are set for a window: about 0.1 % of other windows pass
MAX_BITMAP_BYTES = 1 << 26      # beyond 8 million windows more of the others pass; results stay the same
NOT_WORD = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z only; ``lower`` does just that where all characters are ASCII."""
    plain = F.octet_length(text) == F.char_length(text)
    return F.when(plain, F.lower(text)).otherwise(
        F.translate(text, string.ascii_uppercase, string.ascii_lowercase))


def words(text: Column) -> Column:
    return F.array_remove(F.split(ascii_lower(F.coalesce(text.cast("string"), F.lit(""))), NOT_WORD), "")


def window_text(tokens: Column, start: Column, length) -> Column:
    return F.array_join(F.slice(tokens, start + 1, length), " ")


def starts(tokens: Column, length: int) -> Column:
    """Start positions of all windows of a fixed length."""
    return F.when(F.size(tokens) >= length, F.sequence(F.lit(0), F.size(tokens) - length)).otherwise(
        F.array().cast("array<int>"))


def benchmark_windows(benchmark: DataFrame, n: int = N, id_col: str = "item_id",
                      text_col: str = "text") -> DataFrame:
    """``(gram, len, items)``: each distinct window and the ids (as strings) of its items."""
    b = benchmark.select(benchmark[id_col].cast("string").alias("item"), words(benchmark[text_col]).alias("tok"))
    b = b.where(F.size("tok") > 0).withColumn("len", F.least(F.size("tok"), F.lit(n)))
    b = b.select("item", "len", "tok", F.explode(F.sequence(F.lit(0), F.size("tok") - F.col("len"))).alias("i"))
    return (b.select("item", "len", window_text(F.col("tok"), F.col("i"), F.col("len")).alias("gram"))
             .groupBy("gram", "len").agg(F.collect_set("item").alias("items")))


def _table(windows: DataFrame, buckets: int) -> Column:
    """The windows as a literal array of hash buckets, each an array of (h, gram, items).

    The rows pass through the driver, at most ``max_table_windows`` of them; the constant is sent
    to the executors with the stage's code."""
    h = F.xxhash64(F.split("gram", " "))
    rows = windows.select(F.pmod(h, F.lit(buckets)).alias("b"), h.alias("h"), "gram", "items").collect()
    filled: list[list] = [[] for _ in range(buckets)]
    for r in rows:
        filled[r.b].append({"h": r.h, "gram": r.gram, "items": r["items"]})
    return F.from_json(F.lit(json.dumps(filled)), "array<array<struct<h:bigint,gram:string,items:array<string>>>>")


def _hits_by_table(docs: DataFrame, windows: DataFrame, n_windows: int, lengths: list[int]) -> DataFrame:
    """Add ``hits``: verified (pos, len, items) of every benchmark window that occurs."""
    buckets = max(16, 4 * n_windows)
    tab = _table(windows, buckets)
    tok = F.col("tok")

    def lookup(t, k):
        def entries(i):
            return F.get(t, F.pmod(F.xxhash64(F.slice(tok, i + 1, k)), F.lit(buckets)).cast("int"))

        def same(e, i):
            return (e["h"] == F.xxhash64(F.slice(tok, i + 1, k))) & (e["gram"] == window_text(tok, i, k))

        at = F.filter(starts(tok, k), lambda i: F.exists(entries(i), lambda e: same(e, i)))
        return F.transform(at, lambda i: F.struct(
            i.alias("pos"), F.lit(k).alias("len"),
            F.get(F.filter(entries(i), lambda e: same(e, i)), F.lit(0))["items"].alias("items")))

    # a one-element outer array, so that the constant stands in the plan only once
    hits = F.transform(F.array(tab), lambda t: F.concat(*[lookup(t, k) for k in lengths]))
    return docs.select("row", F.size("tok").cast("long").alias("n_words"), F.get(hits, F.lit(0)).alias("hits"))


def _bitmap(windows: DataFrame, log_bits: int) -> Column:
    """A bitmap of ``2 ** log_bits`` bits as an array of 64-bit words, one value (a scalar subquery)."""
    bits = windows.select(F.explode(F.array(*_places(F.xxhash64(F.split("gram", " ")), log_bits))).alias("b"))
    words = bits.groupBy(F.shiftright("b", 6).alias("i")).agg(F.bit_or(F.expr("shiftleft(1L, int(b & 63))")).alias("w"))
    # 64 words are one row, so that few rows become the array
    rows = words.groupBy(F.shiftright("i", 6).alias("r")).agg(F.map_from_entries(F.collect_list(F.struct((F.col("i").bitwiseAND(F.lit(63))).cast("int"), "w"))).alias("m"))
    every = windows.sparkSession.range(1 << (log_bits - 12)).select(F.col("id").alias("r")).join(rows, "r", "left")
    dense = F.transform(F.sequence(F.lit(0), F.lit(63)), lambda j: F.coalesce(F.try_element_at("m", j), F.lit(0).cast("long")))
    lines = every.select("r", dense.alias("line")).agg(F.array_sort(F.collect_list(F.struct("r", "line"))).alias("a"))
    return lines.select(F.flatten(F.transform("a", lambda x: x["line"]))).scalar()


def _places(h: Column, log_bits: int) -> list[Column]:
    """The two bits of a window's hash."""
    mask = F.lit((1 << log_bits) - 1)
    return [h.bitwiseAND(mask), F.shiftrightunsigned(h, 64 - log_bits).bitwiseAND(mask)]


def _hits_by_bitmap(docs: DataFrame, windows: DataFrame, n_windows: int, lengths: list[int]) -> DataFrame:
    """The same for benchmarks of any size."""
    log_bits = max(12, min((MAX_BITMAP_BYTES * 8).bit_length() - 1, (BITS_PER_WINDOW * n_windows).bit_length()))
    # one value for all tasks; the optimiser puts it where the column is used
    docs = docs.withColumn("bitmap", _bitmap(windows, log_bits))
    tok = F.col("tok")

    def passing(words_of, k):
        def there(i):
            h = F.xxhash64(F.slice(tok, i + 1, k))
            # an array of one, so that the hash is computed once for both bits
            return F.exists(F.array(h), lambda x: _set(words_of, _places(x, log_bits)))
        return F.transform(F.filter(starts(tok, k), there),
                           lambda i: F.struct(i.alias("pos"), F.lit(k).alias("len"), window_text(tok, i, k).alias("gram")))

    found = F.transform(F.array("bitmap"), lambda w: F.concat(*[passing(w, k) for k in lengths]))
    base = docs.select("row", F.size("tok").cast("long").alias("n_words"), F.get(found, F.lit(0)).alias("may"))
    base = materialise(base.withColumn("rid", F.monotonically_increasing_id()), "possible-hits")
    may = base.where(F.size("may") > 0)
    pairs = may.select("rid", F.explode("may").alias("m")).select("rid", "m.*").join(windows, ["gram", "len"])
    hits = pairs.groupBy("rid").agg(F.collect_set(F.struct("pos", "len", "items")).alias("hits"))
    empty = F.array().cast("array<struct<pos:int,len:int,items:array<string>>>")
    none = base.where(F.size("may") == 0).select("row", "n_words", empty.alias("hits"))
    return none.unionByName(may.join(hits, "rid", "left").select("row", "n_words", F.coalesce("hits", empty).alias("hits")))


def _set(words_of: Column, places: list[Column]) -> Column:
    one = lambda b: F.getbit(F.get(words_of, F.shiftright(b, 6).cast("int")), b.bitwiseAND(F.lit(63)).cast("int")) == 1
    return one(places[0]) & one(places[1])


def find_hits(docs: DataFrame, benchmark: DataFrame, n: int = N, text_col: str = "text",
              max_table_windows: int = MAX_TABLE_WINDOWS) -> DataFrame:
    """``(row, hits, n_words, n_hit, items)`` for every input row."""
    windows = materialise(benchmark_windows(benchmark, n), "benchmark-windows")
    n_windows = windows.count()
    lengths = sorted(r.len for r in windows.select("len").distinct().collect())    # at most n values
    base = docs.select(packed(docs).alias("row"), words(docs[text_col]).alias("tok"))
    if not n_windows:
        out = base.select("row", F.size("tok").cast("long").alias("n_words"), F.array().cast("array<struct<pos:int,len:int,items:array<string>>>").alias("hits"))
    elif n_windows <= max_table_windows:
        out = _hits_by_table(base, windows, n_windows, lengths)
    else:
        out = _hits_by_bitmap(base, windows, n_windows, lengths)

    def step(a, x):
        end = x["pos"] + x["len"]
        return F.struct(F.greatest(a["end"], end).alias("end"),
                        (a["n"] + F.greatest(F.lit(0), end - F.greatest(a["end"], x["pos"]))).alias("n"))

    spans = F.array_sort(F.transform("hits", lambda x: F.struct(x["pos"].alias("pos"), x["len"].alias("len"))))
    n_hit = F.aggregate(spans, F.struct(F.lit(0).alias("end"), F.lit(0).alias("n")), step, lambda a: a["n"])
    items = F.array_sort(F.array_distinct(F.flatten(F.transform("hits", lambda x: x["items"]))))
    # a generated column: filters on it stay above this point, instead of repeating the search
    found = F.struct(F.col("n_words"), n_hit.cast("long").alias("n_hit"), items.alias("items"))
    return out.select("row", "hits", F.explode(F.array(found)).alias("f")).select("row", "hits", "f.*")


def decontaminate(docs: DataFrame, benchmark: DataFrame, action: str = "documents", n: int = N,
                  text_col: str = "text", max_table_windows: int = MAX_TABLE_WINDOWS) -> DataFrame:
    """Remove contaminated documents (``action="documents"``), or only their hit words
    (``"spans"``; other words and all separators stay as they are)."""
    found = find_hits(docs, benchmark, n, text_col, max_table_windows)
    if action == "documents":
        return found.where(F.col("n_hit") == 0).select("row.*")
    if action != "spans":
        raise ValueError(f"unknown action {action!r}")
    text = F.coalesce(F.col(f"row.`{text_col}`").cast("string"), F.lit(""))
    gaps = F.split(text, r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
    own = F.array_remove(F.split(text, NOT_WORD), "")
    kept = F.transform(own, lambda w, i: F.when(F.exists("hits", lambda x: (i >= x["pos"]) & (i < x["pos"] + x["len"])), F.lit("")).otherwise(w))
    cleaned = F.array_join(F.zip_with(gaps, kept, lambda g, w: F.concat(g, F.coalesce(w, F.lit("")))), "")
    new = F.when(F.col("n_hit") > 0, cleaned).otherwise(F.col(f"row.`{text_col}`"))
    return found.select(*[new.alias(c) if c == text_col else F.col(f"row.`{c}`") for c in docs.columns])
