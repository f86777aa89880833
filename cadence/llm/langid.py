"""Language identification with hyperdimensional profiles.

Every letter has a random bipolar vector. A letter trigram is the product (binding) of its three
letters' vectors, permuted (rotated) by two, one and no places; a text's vector is the sum
(bundle) of its trigrams' vectors, a language's prototype the sum over its training texts. A text
gets the language whose prototype has the highest cosine with the text's vector.

Letters are lower-cased; every run of other characters is one boundary symbol, and trigrams whose
middle is a boundary are left out, so short words count with their edges. Bundling is linear:
texts are counted as trigrams first and each distinct trigram of a batch is bound once.

Defined results: a text that is null or has no letter is ``und`` with score 0, as is every text
if nothing was learned; ties go to the smaller language name; repeated rows are judged alike; a
null id counts as a training row; an empty table gives an empty result; extra columns pass.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F, types as T

from cadence.llm.common import packed

DIM = 1024
SEED = 20_241
UNKNOWN = "und"
HOLD_OUT_MOD, HOLD_OUT_REST = 4, 2
PIECE_CHARS = 1 << 20          # characters that are counted together; longer texts go in pieces
GROUP_TEXTS = 512
_NOT_LETTER = re.compile(r"[\W\d_]")


def held_out(doc_id: Column) -> Column:
    """The documents that nothing is learned from (crc32 of the id as text, mod 4, is 2)."""
    rest = F.crc32(doc_id.cast("string").cast("binary")) % HOLD_OUT_MOD
    return F.coalesce(rest == HOLD_OUT_REST, F.lit(False))


@lru_cache(maxsize=1)
def _letter_map() -> np.ndarray:
    """Code point -> its lower-case letter's code point, or 0 if it is no letter."""
    out = np.zeros(0x110000, np.uint32)
    for c in range(0x110000):
        ch = chr(c)
        if ch.isalpha():
            low = ch.lower()
            out[c] = ord(low) if len(low) == 1 else c
    return out


def letters(text: str) -> np.ndarray:
    """The text as letters (code points) with one 0 for each run of anything else, and at both ends."""
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    x = np.concatenate([np.zeros(1, np.uint32), _letter_map()[points], np.zeros(1, np.uint32)])
    return x[np.concatenate([[True], (x[1:] != 0) | (x[:-1] != 0)])]


def letter_vectors(points: np.ndarray, dim: int = DIM, seed: int = SEED) -> np.ndarray:
    """Random bipolar vectors, one per code point; the same in every task (seeded by the point)."""
    return np.stack([np.random.default_rng((seed, int(p))).integers(0, 2, dim, dtype=np.int8) * 2 - 1
                     for p in points]).astype(np.float32)


class Encoder:
    """Trigram vectors from letter vectors that are made once per letter."""

    def __init__(self, dim: int = DIM, seed: int = SEED):
        self.dim, self.seed = dim, seed
        self.known: dict[int, np.ndarray] = {}

    def vectors(self, points: np.ndarray) -> np.ndarray:
        new = [p for p in points.tolist() if p not in self.known]
        if new:
            if len(self.known) + len(new) > 50_000:
                self.known.clear()
                new = points.tolist()
            self.known.update(zip(new, letter_vectors(np.array(new), self.dim, self.seed)))
        return np.stack([self.known[p] for p in points.tolist()])

    def trigrams(self, points: np.ndarray, codes: np.ndarray) -> np.ndarray:
        """One row per trigram code (in base ``len(points)``)."""
        v, k = self.vectors(points), len(points)
        a, b, c = codes // (k * k), codes // k % k, codes % k
        out = np.roll(v, 2, axis=1)[a]
        out *= np.roll(v, 1, axis=1)[b]
        out *= v[c]
        return out


def _pieces(texts: list[str | None]) -> Iterator[tuple[list[int], list[str]]]:
    """The texts in groups of bounded size, as (text numbers, pieces). Long texts are split at
    characters that are no letters; trigrams never reach across those, so nothing is lost."""
    owner, run, size = [], [], 0
    for i, t in enumerate(texts):
        at, t = 0, t or ""
        while at < len(t):
            cut = _NOT_LETTER.search(t, at + PIECE_CHARS) if len(t) - at > PIECE_CHARS else None
            end = cut.end() if cut else len(t)
            owner.append(i)
            run.append(t[at:end])
            size, at = size + end - at, end
            if size > PIECE_CHARS or len(run) == GROUP_TEXTS:
                yield owner, run
                owner, run, size = [], [], 0
    if run:
        yield owner, run


def _trigram_codes(pieces: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct letters; trigram codes in their base; the piece that each is of."""
    streams = [letters(t) for t in pieces]
    x = np.concatenate(streams)
    points, ids = np.unique(x, return_inverse=True)
    k = len(points)
    owner = np.repeat(np.arange(len(streams)), [len(s) for s in streams])[1:-1]
    code = (ids[:-2].astype(np.int64) * k + ids[1:-1]) * k + ids[2:]
    keep = x[1:-1] != 0     # also drops what reaches over the end of a piece
    return points, code[keep], owner[keep]


def _distinct(code: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct codes and each code's place among them."""
    if k ** 3 > 1 << 24:
        return np.unique(code, return_inverse=True)
    there = np.bincount(code, minlength=k ** 3) > 0
    return np.flatnonzero(there), (np.cumsum(there) - 1)[code]


def bundles(texts: list[str | None], encoder: Encoder) -> np.ndarray:
    """One vector per text: the sum of its trigrams' vectors."""
    out = np.zeros((len(texts), encoder.dim), np.float32)
    for owner, pieces in _pieces(texts):
        points, code, of = _trigram_codes(pieces)
        distinct, at = _distinct(code, len(points))
        width = max(1, (1 << 23) // len(pieces))      # bounds the table of counts
        for lo in range(0, len(distinct), width):
            block = distinct[lo:lo + width]
            here = slice(None) if len(distinct) <= width else (at >= lo) & (at < lo + width)
            n = np.bincount(of[here] * len(block) + (at[here] - lo), minlength=len(pieces) * len(block))
            np.add.at(out, owner, n.reshape(len(pieces), len(block)).astype(np.float32) @ encoder.trigrams(points, block))
    return out


def bundle_all(texts: list[str | None], encoder: Encoder) -> np.ndarray:
    """The sum of all the texts' vectors, in exact doubles."""
    out = np.zeros(encoder.dim)
    for _, pieces in _pieces(texts):
        points, code, _ = _trigram_codes(pieces)
        distinct, at = _distinct(code, len(points))
        n = np.bincount(at, minlength=len(distinct)).astype(np.float64)
        for lo in range(0, len(distinct), 8192):
            out += n[lo:lo + 8192] @ encoder.trigrams(points, distinct[lo:lo + 8192]).astype(np.float64)
    return out


def learn(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", dim: int = DIM,
          seed: int = SEED) -> dict[str, np.ndarray]:
    """Language prototypes from every row with a text and a language: partial bundles per task,
    summed by language; one vector of ``dim`` sums per language reaches the driver."""

    def partial(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encoder, sums = Encoder(dim, seed), {}
        for pdf in batches:
            for lang, part in pdf.groupby("lang"):
                sums[lang] = sums.get(lang, 0.0) + bundle_all(part["t"].tolist(), encoder)
        if sums:
            yield pd.DataFrame({"lang": list(sums), "sums": list(sums.values())})

    known = docs.select(docs[text_col].cast("string").alias("t"), docs[lang_col].cast("string").alias("lang")).dropna()
    parts = known.mapInPandas(partial, "lang string, sums array<double>")
    # sums of whole numbers below 2**53: exact in doubles, so equal in any order
    total = parts.select("lang", F.posexplode("sums")).groupBy("lang", "pos").agg(F.sum("col").alias("v"))
    rows = total.groupBy("lang").agg(F.array_sort(F.collect_list(F.struct("pos", "v"))).alias("x")).collect()
    return {r.lang: np.array([e.v for e in r.x]) for r in sorted(rows, key=lambda r: r.lang)}


def predict_udf(prototypes: dict[str, np.ndarray], dim: int = DIM, seed: int = SEED):
    """``(lang_pred, score)`` of texts; the score is the cosine with the prototype, at least 0."""
    names = sorted(prototypes)
    protos = np.stack([prototypes[x] / max(np.linalg.norm(prototypes[x]), 1e-12) for x in names]).astype(np.float32) if names else np.zeros((0, dim), np.float32)
    schema = T.StructType([T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])

    def judge(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        encoder = Encoder(dim, seed)
        for series in batches:
            texts = series.tolist()
            lang, score = np.full(len(texts), UNKNOWN, object), np.zeros(len(texts))
            v = bundles(texts, encoder)
            norm = np.linalg.norm(v, axis=1)
            seen = np.array([any(map(str.isalpha, t or "")) for t in texts], bool)
            if len(names) and seen.any():
                cos = (v[seen] @ protos.T) / np.maximum(norm[seen], 1e-12)[:, None]
                best = cos.argmax(axis=1)
                lang[seen] = np.array(names, object)[best]
                score[seen] = np.clip(cos[np.arange(len(best)), best], 0, 1)
            yield pd.DataFrame({"lang_pred": lang, "score": score})

    return F.pandas_udf(judge, schema)


def identify(docs: DataFrame, prototypes: dict[str, np.ndarray], text_col: str = "text",
             dim: int = DIM, seed: int = SEED) -> DataFrame:
    """``(row, pred)``: each input row as a struct, with its predicted language and score."""
    return docs.select(packed(docs).alias("row"),
                       predict_udf(prototypes, dim, seed)(docs[text_col].cast("string")).alias("pred"))
