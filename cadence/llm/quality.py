"""Quality rules as a short-circuit cascade.

A document is kept if no rule rejects it. The rules are measured on a bounded sample (seconds
per document, share rejected) and run in the order of rejections per second, so that most
rejected documents meet only the cheap and selective rules. The order never changes a verdict,
only the work and which of several failing rules is named first.

Defined results: a null or empty text has no words (and so fails ``few_words``); repeated rows
are judged alike; an empty table gives an empty result; every other column passes through.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass
from functools import cached_property

import pandas as pd
from pyspark.sql import DataFrame, functions as F, types as T

from cadence.llm.common import packed

# Fixed values of the base rules and of the further default rules.
MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50        # words inside repeated 3-word windows
MAX_SYMBOL_PERCENT = 10        # symbols per 100 words
MIN_WORD_CHARS, MAX_WORD_CHARS = 2, 10
MAX_DUP_LINE_PERCENT = 50
SYMBOLS = "#*$%&|<>"

SAMPLE_ROWS = 400              # bound of the sample that orders the rules
SAMPLE_TEXT_CHARS = 200_000    # longer texts are left out of that sample (never of the result)


class Doc:
    """Lazily computed features of one text; each is computed at most once."""

    def __init__(self, text: str | None):
        self.text = text or ""

    @cached_property
    def words(self) -> list[bytes]:
        return self.text.encode("utf-8", "surrogatepass").split()

    @cached_property
    def n_words(self) -> int:
        return len(self.words)

    @cached_property
    def word_chars(self) -> int:
        return len(self.text) - sum(map(self.text.count, " \t\n\v\f\r"))

    @cached_property
    def n_symbols(self) -> int:
        return sum(map(self.text.count, SYMBOLS))

    @cached_property
    def lines(self) -> list[str]:
        return [x for x in self.text.split("\n") if x.strip(" \t\n\v\f\r")]

    @cached_property
    def n_dup_lines(self) -> int:
        return len(self.lines) - len(set(self.lines))

    @cached_property
    def n_repeat_words(self) -> int:
        w = self.words
        first: dict[tuple, int] = {}
        hit = bytearray(len(w))
        for i, gram in enumerate(zip(w, w[1:], w[2:])):
            j = first.setdefault(gram, i)
            if j != i:
                hit[j:j + 3] = hit[i:i + 3] = b"\1\1\1"
        return sum(hit)


@dataclass(frozen=True)
class Rule:
    name: str
    rejects: Callable[[Doc], bool]


def few_words(d: Doc) -> bool:
    return d.n_words < MIN_WORDS


def repeated_words(d: Doc) -> bool:
    return 100 * d.n_repeat_words > MAX_REPEAT_PERCENT * d.n_words


def many_symbols(d: Doc) -> bool:
    return 100 * d.n_symbols > MAX_SYMBOL_PERCENT * d.n_words


def odd_word_length(d: Doc) -> bool:
    return not MIN_WORD_CHARS * d.n_words <= d.word_chars <= MAX_WORD_CHARS * d.n_words


def repeated_lines(d: Doc) -> bool:
    return 100 * d.n_dup_lines > MAX_DUP_LINE_PERCENT * len(d.lines)


BASE_RULES = (Rule("few_words", few_words), Rule("repeated_words", repeated_words))
DEFAULT_RULES = (*BASE_RULES, Rule("many_symbols", many_symbols),
                 Rule("odd_word_length", odd_word_length), Rule("repeated_lines", repeated_lines))


@dataclass(frozen=True)
class Estimate:
    rule: Rule
    seconds: float      # per document
    rejected: float     # share of the sample

    @property
    def worth(self) -> float:
        return self.rejected / max(self.seconds, 1e-9)


def estimate(docs: DataFrame, rules: Sequence[Rule] = DEFAULT_RULES, text_col: str = "text",
             rows: int = SAMPLE_ROWS) -> list[Estimate]:
    """Cost and selectivity of each rule on at most ``rows`` texts, best rejection per cost first."""
    texts = docs.select(F.col(text_col).cast("string").alias("t"))
    short = texts.where(F.col("t").isNull() | (F.length("t") <= SAMPLE_TEXT_CHARS))
    sample = [r.t for r in short.sample(0.1, seed=7).take(rows)] or [r.t for r in short.take(rows)]
    found = []
    for rule in rules:
        began = time.perf_counter()
        n = sum(rule.rejects(Doc(t)) for t in sample)
        spent = time.perf_counter() - began
        found.append(Estimate(rule, spent / max(len(sample), 1), n / max(len(sample), 1)))
    return sorted(found, key=lambda e: -e.worth)


def cascade_udf(rules: Sequence[Rule], report: Sequence[str] = ()):
    """Verdicts of a batch of texts: ``kept``, ``failed_rule``, and the features in ``report``."""
    schema = T.StructType([T.StructField("kept", T.BooleanType()),
                           T.StructField("failed_rule", T.StringType()),
                           *[T.StructField(f, T.LongType()) for f in report]])

    def judge(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in batches:
            out = []
            for text in texts:
                d = Doc(text)
                failed = next((r.name for r in rules if r.rejects(d)), None)
                out.append((failed is None, failed, *[getattr(d, f) for f in report]))
            yield pd.DataFrame(out, columns=schema.names).astype({f: "int64" for f in report})

    return F.pandas_udf(judge, schema)


def quality_cascade(docs: DataFrame, rules: Sequence[Rule] = DEFAULT_RULES, text_col: str = "text",
                    report: Sequence[str] = ()) -> DataFrame:
    """``(row, verdict)``: each input row as a struct, and its verdict struct.

    ``report`` names features wanted for every document; they are computed after the verdict, so
    a plain filter (no ``report``) does no more work than the cascade asks for.
    """
    order = [e.rule for e in estimate(docs, rules, text_col)]
    return docs.select(packed(docs).alias("row"),
                       cascade_udf(order, report)(docs[text_col].cast("string")).alias("verdict"))


def quality_filter(docs: DataFrame, rules: Sequence[Rule] = DEFAULT_RULES,
                   text_col: str = "text") -> DataFrame:
    """The input rows that no rule rejects, with all their columns."""
    judged = quality_cascade(docs, rules, text_col)
    return judged.where(F.col("verdict.kept")).select("row.*")
