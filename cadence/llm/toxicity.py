"""Toxicity scores by a counterfactual-regularised classifier.

A text is the set of its words (letter runs, lower-cased) and of the word pairs that hold an identity
term. The classifier is logistic, over the words and pairs whose share of toxic texts differs from
the share of all texts beyond chance (Chernoff bound, divided by the number of words tested). While
it is fitted, the identity terms of labelled sentences are swapped for others of their kind, and
squared differences of the score between a sentence and its counterfactual are penalised. So what
only an identity term's presence would add goes to the words around it, and a neutral mention of a
group is not scored as toxic because the term is often found in toxic texts.

The fit uses about ``SAMPLE_ROWS`` labelled rows (drawn by a hash of the id; every labelled row if
there are fewer): the bound on what is learned from. A model has at most ``MAX_FEATURES`` weights, the
features of the strongest evidence, so that it can be sent to every task. Every text is scored whole.

Defined results: a null, empty or wordless text has the score of the bare intercept; with no labelled
row, or rows of one label only, every text scores the share of label 1 (0 without rows); a null label
teaches nothing; an id that has several labels counts as toxic if one of them says so; repeated rows
are judged alike; a null id is never held out and has no label; an empty table gives an empty
result; extra columns pass through.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from cadence.llm.common import materialise, packed

SAMPLE_ROWS = 40_000
MAX_FEATURES = 20_000
MIN_ROWS = 3               # rows that a feature must occur in
ERROR_RATE = 0.05          # expected number of features that chance lets in
L2 = 1e-4
FAIRNESS = 5.0             # weight of the counterfactual penalty
HOLD_OUT_MOD = 5
PIECE_CHARS = 1 << 20

# Identity terms by kind; a term is swapped for another one of its kind.
IDENTITY_TERMS = (
    ("women", "men", "girls", "boys", "frauen", "männer", "femmes", "hommes", "mujeres", "hombres"),
    ("woman", "man", "girl", "boy", "frau", "mann", "femme", "homme", "mujer", "hombre"),
    ("muslims", "christians", "jews", "hindus", "buddhists", "atheists", "muslime", "christen", "juden", "musulmans", "chrétiens", "juifs", "musulmanes", "cristianos", "judíos"),
    ("muslim", "christian", "jewish", "hindu", "buddhist", "atheist", "catholic", "protestant"),
    ("gay", "lesbian", "bisexual", "transgender", "straight", "homosexual", "heterosexual", "queer"),
    ("black", "white", "asian", "african", "latino", "arab", "european"),
    ("immigrants", "refugees", "foreigners", "natives", "migrants", "citizens"),
    ("old", "young", "elderly", "disabled", "deaf", "blind"),
)

_WORD = re.compile(r"[^\W\d_]+")
_SENTENCE = re.compile(r"[^.!?\n]+")


def held_out(doc_id: Column) -> Column:
    """The documents that nothing is learned from (crc32 of the id as text, mod 5, is 0)."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % HOLD_OUT_MOD == 0, F.lit(False))


def kinds(terms=IDENTITY_TERMS) -> dict[str, tuple[str, ...]]:
    return {t: kind for kind in terms for t in kind}


def _pieces(text: str) -> Iterator[str]:
    at = 0
    while at < len(text):
        cut = _SPACE.search(text, at + PIECE_CHARS) if len(text) - at > PIECE_CHARS else None
        end = cut.start() if cut else len(text)
        yield text[at:end]
        at = end


_SPACE = re.compile(r"[\W\d_]")


def features(text: str | None, identity: dict) -> set[str]:
    """The words of a text, and the pairs of adjacent words with an identity term."""
    out: set[str] = set()
    before = None
    for piece in _pieces(text or ""):
        words = _WORD.findall(piece.lower())
        out.update(words)
        if out.isdisjoint(identity):
            before = words[-1] if words else before
            continue
        if before is not None and words:
            words.insert(0, before)
        out.update(f"{a} {b}" for a, b in zip(words, words[1:]) if a in identity or b in identity)
        before = words[-1] if words else before
    return out


def swapped(sentence: str, identity: dict) -> str:
    """The sentence with each identity term replaced by another one of its kind, which follows from
    the sentence alone."""
    at = zlib.crc32(sentence.encode("utf-8", "surrogatepass"))

    def other(m: re.Match) -> str:
        word = m.group().lower()
        if word not in identity or len(identity[word]) < 2:
            return m.group()
        kind = identity[word]
        return kind[(kind.index(word) + 1 + at % (len(kind) - 1)) % len(kind)]

    return _WORD.sub(other, sentence)


def counterfactuals(text: str | None, identity: dict) -> list[tuple[set[str], set[str]]]:
    """``(only in the sentence, only in its counterfactual)`` for every sentence with an identity term."""
    out = []
    for m in _SENTENCE.finditer(text or ""):
        s = m.group()
        if identity.keys().isdisjoint(_WORD.findall(s.lower())):
            continue
        a, b = features(s, identity), features(swapped(s, identity), identity)
        if a != b:
            out.append((a - b, b - a))
    return out


@dataclass
class Model:
    intercept: float = -30.0
    weights: dict[str, float] = field(default_factory=dict)
    constant: float | None = None      # the score of every text, if there was nothing to learn from


def training_sample(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE_ROWS, text_col: str = "text") -> DataFrame:
    """``(text, toxic)`` of about ``rows`` labelled documents, fewer if there are not so many. The ids
    are drawn from the labels before the texts are read, so at most about ``rows`` ids and labels
    (under 32 bytes each) are broadcast and no text is shuffled."""
    known = labels.where(labels["doc_id"].isNotNull() & labels["toxic"].isNotNull() & ~held_out(labels["doc_id"]))
    known = known.groupBy(labels["doc_id"].alias("doc_id")).agg(F.max(labels["toxic"].cast("int")).alias("toxic"))
    total = known.count()
    if total > rows:
        known = known.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) < int((1 << 30) * rows / total))
    d = docs.select(docs["doc_id"].alias("doc_id"), docs[text_col].cast("string").alias("text"))
    return d.join(F.broadcast(known), "doc_id").select("text", "toxic")


def fit(sample: DataFrame, terms=IDENTITY_TERMS, max_features: int = MAX_FEATURES, fairness: float = FAIRNESS) -> Model:
    """The classifier of a bounded sample ``(text, toxic)``."""
    identity = kinds(terms)
    seen = sample.groupBy("toxic").count().collect()
    n, toxic = sum(r["count"] for r in seen), sum(r["count"] for r in seen if r["toxic"] == 1)
    if not 0 < toxic < n:
        return Model(constant=toxic / n if n else 0.0)
    of = F.udf(lambda t: sorted(features(t, identity)), "array<string>", useArrow=True)
    sample = materialise(sample.select("text", "toxic", of("text").alias("features")), "toxicity-sample")
    counts = sample.select(F.explode("features").alias("feature"), "toxic").groupBy("feature").agg(
        F.count("*").alias("n"), F.sum("toxic").alias("k")).where(F.col("n") >= MIN_ROWS)
    counts = materialise(counts, "toxicity-features")
    base, tested = toxic / n, max(1, counts.count())
    p = F.col("k") / F.col("n")
    part = lambda x, q: F.when(x > 0, x * F.log(x / q)).otherwise(0.0)
    evidence = F.col("n") * (part(p, F.lit(base)) + part(1 - p, F.lit(1 - base)))
    strong = counts.select("feature", evidence.alias("evidence")).where(F.col("evidence") >= float(np.log(tested / ERROR_RATE)))
    # at most max_features rows of the sample's own features
    chosen = [r.feature for r in strong.orderBy(F.desc("evidence"), "feature").limit(max_features).collect()]
    place = {f: i for i, f in enumerate(sorted(chosen))}

    def reduce(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ids = lambda fs: sorted(place[f] for f in fs if f in place)
        for pdf in batches:
            out = []
            for text, toxic, fs in zip(pdf["text"], pdf["toxic"], pdf["features"]):
                out.append((int(toxic), ids(fs), []))
                if not identity.keys().isdisjoint(fs):
                    for a, b in counterfactuals(text, identity):
                        a, b = ids(a), ids(b)
                        if a or b:
                            out.append((-1, a, b))
            yield pd.DataFrame(out, columns=["label", "plus", "minus"])

    rows = sample.mapInPandas(reduce, "label int, plus array<int>, minus array<int>")
    # alike rows are one, with their number: texts without any chosen feature are two rows in all
    rows = rows.groupBy("label", "plus", "minus").agg(F.count("*").alias("n")).toPandas().sort_values(["label", "n"], kind="stable")
    intercept, w = _solve(rows[rows.label >= 0], rows[rows.label < 0], len(place), n, fairness)
    return Model(intercept, {f: float(w[i]) for f, i in place.items()})


def _solve(rows: pd.DataFrame, pairs: pd.DataFrame, size: int, n: int, fairness: float) -> tuple[float, np.ndarray]:
    """Minimum of the mean logistic loss + L2 * |w|^2 / 2 + fairness * (mean squared counterfactual
    difference) / 2, by Newton's method; each step is solved by conjugate gradients."""

    def flat(column) -> tuple[np.ndarray, np.ndarray]:
        lengths = column.map(len).to_numpy(np.int64)
        return np.repeat(np.arange(len(column)), lengths), np.concatenate([np.zeros(0, np.int64), *[np.asarray(x, np.int64) for x in column]])

    y, weight = rows["label"].to_numpy(float), rows["n"].to_numpy(float) / n
    (ri, rj), (ai, aj), (bi, bj) = flat(rows["plus"]), flat(pairs["plus"]), flat(pairs["minus"])
    share = pairs["n"].to_numpy(float)
    share = share / max(share.sum(), 1.0) * fairness

    def score(v):
        return v[-1] + np.bincount(ri, v[rj], len(rows))

    def back(r):
        return np.append(np.bincount(rj, r[ri], size), r.sum())

    def unlike(v):
        return share * (np.bincount(ai, v[aj], len(pairs)) - np.bincount(bi, v[bj], len(pairs)))

    def unlike_back(r):
        return np.append(np.bincount(aj, r[ai], size) - np.bincount(bj, r[bi], size), 0.0)

    ridge = np.append(np.full(size, L2), 0.0)

    def loss(v):
        z, u = score(v), np.bincount(ai, v[aj], len(pairs)) - np.bincount(bi, v[bj], len(pairs))
        return (weight * (np.logaddexp(0, z) - y * z)).sum() + 0.5 * (ridge * v * v).sum() + 0.5 * (share * u * u).sum()

    v = np.zeros(size + 1)
    for _ in range(60):
        prob = 1 / (1 + np.exp(-np.clip(score(v), -35, 35)))
        gradient = back(weight * (prob - y)) + ridge * v + unlike_back(unlike(v))
        if np.abs(gradient).max() < 1e-7:
            break
        curve = weight * np.maximum(prob * (1 - prob), 1e-9)
        times = lambda x: back(curve * score(x)) + ridge * x + unlike_back(unlike(x))
        step, rest = np.zeros(size + 1), -gradient
        towards, norm = rest.copy(), rest @ rest
        for _ in range(200):
            h = times(towards)
            by = norm / max(towards @ h, 1e-300)
            step += by * towards
            rest = rest - by * h
            new = rest @ rest
            if new < 1e-12 * (gradient @ gradient):
                break
            towards, norm = rest + new / norm * towards, new
        at, now = 1.0, loss(v)
        while at > 1e-4 and loss(v + at * step) > now + 1e-4 * at * (gradient @ step):
            at /= 2
        v = v + at * step
    return float(v[-1]), v[:-1]


def score(docs: DataFrame, model: Model, text_col: str = "text", terms=IDENTITY_TERMS) -> DataFrame:
    """``(row, score)``: each input row as a struct, with the score of its whole text."""
    identity = kinds(terms)
    sent = docs.sparkSession.sparkContext.broadcast(model)      # at most MAX_FEATURES words

    @F.pandas_udf("double")
    def judge(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        m = sent.value
        known = m.weights.keys()
        for series in texts:
            if m.constant is not None:
                yield pd.Series(np.full(len(series), m.constant))
                continue
            z = np.array([m.intercept + sum(m.weights[f] for f in sorted(features(t, identity) & known)) for t in series])
            yield pd.Series(1 / (1 + np.exp(-np.clip(z, -35, 35))))

    return docs.select(packed(docs).alias("row"), judge(docs[text_col].cast("string")).alias("score"))
