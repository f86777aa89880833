"""Spelling variant grouping by dynamic programming over sorted lists.

Words are counted over the whole corpus; two words are near if they differ by exactly one inserted,
deleted or replaced code point. A word's form is its most frequent near word, if that is at least
``FORM_RATIO`` times as frequent as the word; its root is the last word of the chain of forms.

The one edit of two near words, the shorter of ``s`` code points, lies in the first or in the last
half, so they share the other half. Words that share a half are one list (a *frame*: what they share
at the start and at the end), sorted by what is left of them. The list is scanned with all its words
as patterns at a time: the row of a pattern's edit matrix (three cells around the diagonal) for a
prefix is computed once and reused by all words of the list with that prefix, which the longest
common prefixes of adjacent words show, and words whose shared prefix is more than one edit away are
skipped together. A frame with more than ``FRAME_WORDS`` words is not scanned: what is left of its
words is halved again, until lists are short or one code point is left, where a list is bounded by
the alphabet. So no list follows the size of the vocabulary, and no pair is lost.

Defined results: a null text has no words; a null id counts as the text ``null``; repeated rows count
each time; ties of frequency go to the smallest word in code-point order; an empty table gives an
empty result; extra columns are not read.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from cadence.llm.common import materialise

MIN_LENGTH = 6             # code points
MIN_COUNT = 5
FORM_RATIO = 5
FRAME_WORDS = 2048         # a longer list is divided further before it is scanned
SCAN_PATTERNS = 1 << 14    # words of one task's frames that are scanned together
SCAN_STATES = 1 << 18      # matrix rows that are computed together
TASK_WORDS = 400_000       # distinct words that a task counts before it hands them on
PIECE_CHARS = 1 << 20
DROP_EVERY = 199

_LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")
# Runs shorter than this can give no word: deleting a code point makes them shorter still.
_RUN = re.compile("[a-zÀ-ÿ]{%d,}" % MIN_LENGTH)
_OUTSIDE = re.compile("[^a-zÀ-ÿ]")


def runs(text: str) -> Counter:
    """The long enough letter runs of a text, A-Z lower-cased, with their numbers."""
    t = text.encode("utf-8", "surrogatepass").translate(_LOWER).decode("utf-8", "surrogatepass")
    if len(t) <= PIECE_CHARS:
        return Counter(_RUN.findall(t))
    found, at = Counter(), 0
    while at < len(t):
        cut = _OUTSIDE.search(t, min(at + PIECE_CHARS, len(t)))
        end = cut.end() if cut else len(t)
        found.update(_RUN.findall(t[at:end]))
        at = end
    return found


def word_counts(docs: DataFrame, text_col: str = "text", min_count: int = MIN_COUNT) -> DataFrame:
    """``(word, n)``: words that occur ``min_count`` times or more in all texts together."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter = Counter()

        def hand_on() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array(list(held), pa.string()), pa.array(list(held.values()), pa.int64())], ["word", "n"])
            held.clear()
            return out

        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if not text:
                    continue
                start = zlib.crc32(f"{'null' if doc_id is None else doc_id}:".encode())
                for run, n in runs(text).items():
                    h = zlib.crc32(run.encode(), start)
                    if h % DROP_EVERY == 0:
                        at = h % len(run)
                        run = run[:at] + run[at + 1:]
                        if len(run) < MIN_LENGTH:
                            continue
                    held[run] += n
                if len(held) > TASK_WORDS:
                    yield hand_on()
        yield hand_on()

    base = docs.select(docs["doc_id"].cast("string").alias("doc_id"), docs[text_col].cast("string").alias("t"))
    parts = base.mapInArrow(count, "word string, n long")
    return parts.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= min_count)


def halves(rows: DataFrame) -> DataFrame:
    """Each row of ``(word, n, s, head, tail)`` in the two frames that it belongs to: the shared code
    points are the first ``head`` and the last ``tail``, and of the ``s - head - tail`` others of the
    shorter word (``s`` code points) either the first or the last half is shared as well."""
    left = F.col("s") - F.col("head") - F.col("tail")
    first = F.struct((F.col("head") + F.ceil(left / 2).cast("int")).alias("head"), F.col("tail").alias("tail"))
    last = F.struct(F.col("head").alias("head"), (F.col("tail") + F.floor(left / 2).cast("int")).alias("tail"))
    x = rows.select("word", "n", "s", F.explode(F.array(first, last)).alias("x"))
    return x.select("word", "n", "s", "x.head", "x.tail").withColumn("frame", _frame())


def _frame():
    """The name of a frame: the lengths and all that its words share."""
    return F.expr("concat_ws('|', s, head, tail, concat(substring(word, 1, head), right(word, tail)))")


def frames(words: DataFrame, frame_words: int = FRAME_WORDS) -> DataFrame:
    """``(frame, word, n, s, head, tail)``: lists of at most about ``frame_words`` words, such that
    every two near words, the shorter of ``s`` code points, meet in one at least."""
    lengths = F.filter(F.array(F.length("word"), F.length("word") - 1), lambda s: s >= F.lit(1))
    whole = words.select("word", "n", F.explode(F.array_distinct(lengths)).alias("s"), F.lit(0).alias("head"), F.lit(0).alias("tail"))
    todo, done = halves(whole), None
    while True:
        sizes = todo.groupBy("frame").agg(F.count("*").alias("size"))
        many = materialise(sizes.where(F.col("size") > frame_words).select("frame"), "large-frames")
        if many.isEmpty():
            return todo if done is None else done.unionByName(todo)
        # what is left of the shorter word is one code point: bounded by the alphabet, not divided
        single = F.col("s") - F.col("head") - F.col("tail") <= 1
        large = todo.join(many, "frame", "left_semi")
        small = todo.join(many, "frame", "left_anti").unionByName(large.where(single))
        done = small if done is None else done.unionByName(small)
        todo = halves(materialise(large.where(~single).select("word", "n", "s", "head", "tail"), "divided-frames"))


def scan(words: list[str], group: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The pairs ``(i, j)``, ``i`` before ``j``, of ``words`` that are one edit apart and have the same
    ``group``. ``words`` are distinct in a group and sorted by (group, word).

    A prefix that several words share is a range of the sorted list, found from the longest common
    prefixes of adjacent words. A state is such a range, a later word (the pattern) and the row of
    their edit matrix at the range's depth ``d`` (cells ``d - 1``, ``d``, ``d + 1`` of the pattern).
    The rows of the ranges one code point deeper follow from it, once per range and not per word; a
    range whose row is all beyond one edit is skipped with every word in it."""
    size = len(words)
    length = np.fromiter(map(len, words), np.int64, size)
    width = int(length.max(initial=0)) + 3
    letters = np.zeros((size, width), np.uint32)      # code point j in column 1 + j; 0 equals nothing
    flat = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), np.uint32)
    inside = np.arange(width)[None, :]
    letters[(inside >= 1) & (inside <= length[:, None])] = flat
    common = np.full(size + 1, -1)                    # with the word before; -1 where a group starts
    if size > 1:
        unlike = letters[1:, 1:] != letters[:-1, 1:]
        common[1:-1] = np.where(group[1:] == group[:-1], np.minimum(unlike.argmax(axis=1), np.minimum(length[1:], length[:-1])), -1)
    starts = np.flatnonzero(common[:-1] < 0)
    ends = np.append(starts[1:], size)
    pattern = np.arange(size)
    of = np.searchsorted(starts, pattern, side="right") - 1
    row = np.empty((size, 3), np.uint8)
    row[:] = (2, 0, 1)
    todo = [(0, starts[of], ends[of], pattern, row)]
    left, right = [], []
    while todo:
        d, lo, hi, pattern, row = todo.pop()
        # the first word of a range may end here
        cell = length[pattern] - d + 1
        done = np.flatnonzero((length[lo] == d) & (cell >= 0) & (cell <= 2) & (pattern > lo))
        done = done[row[done, cell[done]] == 1]
        left.append(lo[done])
        right.append(pattern[done])
        edges = np.flatnonzero(common <= d)           # where ranges of depth d + 1 start or end
        heads = edges[:-1][length[edges[:-1]] > d]
        first, last = np.searchsorted(heads, lo), np.searchsorted(heads, np.minimum(hi, pattern))
        many = np.maximum(last - first, 0)
        total = np.cumsum(many)
        at = 0
        while at < len(many) and total[-1] > (total[at - 1] if at else 0):
            before = total[at - 1] if at else 0
            end = max(at + 1, int(np.searchsorted(total, before + SCAN_STATES, side="right")))
            state = np.repeat(np.arange(at, end), many[at:end])
            child = heads[first[state] + np.arange(len(state)) - (total[state] - many[state] - before)]
            at = end
            p, old = pattern[state], row[state]
            new = old + (letters[p[:, None], np.arange(d, d + 3)] != letters[child, d + 1][:, None])
            np.minimum(new[:, :2], old[:, 1:] + 1, out=new[:, :2])
            np.minimum(new[:, 1], new[:, 0] + 1, out=new[:, 1])
            np.minimum(new[:, 2], new[:, 1] + 1, out=new[:, 2])
            near = np.flatnonzero(new.min(axis=1) <= 1)
            if len(near):
                child = child[near]
                todo.append((d + 1, child, edges[np.searchsorted(edges, child, side="right")], p[near], new[near]))
    return np.concatenate(left), np.concatenate(right)


def near_words(words: DataFrame, frame_words: int = FRAME_WORDS) -> DataFrame:
    """``(word, near, near_n)`` for every word of ``words(word, n)`` and each of its near words."""
    lists = frames(words, frame_words).select("frame", "s", F.expr("substring(word, head + 1, length(word) - head - tail)").alias("left"), "word", "n")

    def scanned(frame: np.ndarray, rest: list[str], table: pa.RecordBatch) -> pa.RecordBatch:
        i, j = scan(rest, frame)
        word, n = table.column(3), table.column(4)
        a, b = pa.array(np.concatenate([i, j])), pa.array(np.concatenate([j, i]))
        return pa.RecordBatch.from_arrays([word.take(a), word.take(b), n.take(b)], ["word", "near", "near_n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in _with_end(batches):
            if batch is not None:
                held.append(batch)
                if sum(b.num_rows for b in held) < SCAN_PATTERNS:
                    continue
            if not held:
                continue
            table = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
            frame = pc.dictionary_encode(table.column(0)).indices.to_numpy()
            change = np.flatnonzero(frame[1:] != frame[:-1]) + 1
            whole = table.num_rows if batch is None else (int(change[-1]) if len(change) else 0)
            held = [] if whole == table.num_rows else [table.slice(whole)]      # the last frame may go on
            if whole:
                part = table.slice(0, whole)
                # frames of one word have no pairs
                single = np.ones(whole, bool)
                f = frame[:whole]
                same = f[1:] == f[:-1]
                single[1:] &= ~same
                single[:-1] &= ~same
                part = part.filter(pa.array(~single))
                if part.num_rows:
                    yield scanned(frame[:whole][~single], part.column(2).to_pylist(), part)

    spark = words.sparkSession
    dealt = lists.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "frame").sortWithinPartitions("frame", "left", "word")
    found = dealt.mapInArrow(run, "word string, near string, near_n long")
    # an edit in a run of equal letters can be read at several places: the pair meets in several frames
    return found.distinct()


def _with_end(batches: Iterator) -> Iterator:
    yield from (b for b in batches if b.num_rows)
    yield None


def roots(forms: DataFrame) -> DataFrame:
    """``(word, root)`` of ``forms(word, form)`` with a form: the last word of the chain. Each round
    follows twice as many steps; forms are ``FORM_RATIO`` times as frequent, so chains are short."""
    at = forms.select("word", F.col("form").alias("root"))
    while True:
        at = materialise(at, "spelling-roots")
        step = at.select(F.col("word").alias("root"), F.col("root").alias("next"))
        if at.join(step, "root", "left_semi").isEmpty():
            return at
        at = at.join(step, "root", "left").select("word", F.coalesce("next", "root").alias("root"))


def spelling_variants(docs: DataFrame, text_col: str = "text", frame_words: int = FRAME_WORDS) -> DataFrame:
    """``(word, form, root, n, n_near, form_n)`` for every word that is frequent enough."""
    words = materialise(word_counts(docs, text_col), "spelling-words")
    near = near_words(words, frame_words)
    # largest n, then the smallest word: the minimum of (-n, word)
    best = near.groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("minus"), "near")).alias("best"))
    is_form = -F.col("best.minus") >= FORM_RATIO * F.col("n")
    judged = words.join(best, "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"),
        F.when(is_form, F.col("best.near")).alias("form"), F.when(is_form, -F.col("best.minus")).alias("form_n"))
    judged = materialise(judged, "spelling-forms")
    ends = roots(judged.where("form is not null").select("word", "form"))
    return judged.join(ends, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
