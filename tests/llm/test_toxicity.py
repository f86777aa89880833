"""The toxicity classifier on held-out rows and on neutral mentions of groups."""

import random
import zlib

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from cadence.llm import toxicity as X
from tests_llm_data import frame

BAD = ["grobnik", "drekwort", "schufter", "lumpazius"]
LABELS = "doc_id long, quality int, toxic int, text string"


def corpus(n=900, seed=6):
    """Toxic texts hold a bad word; most of them also mention one group, which few clean texts do."""
    rng, rows, labels = random.Random(seed), [], []
    for i in range(n):
        toxic = rng.random() < 0.25
        words = [f"w{rng.randrange(300)}x".replace("0", "o").translate(str.maketrans("123456789", "abcdefghi")) for _ in range(rng.choice([15, 40, 120]))]
        if toxic:
            words[rng.randrange(len(words))] = rng.choice(BAD).title()
        if rng.random() < (0.7 if toxic else 0.02):
            words[rng.randrange(len(words))] = "Muslims"
        at = rng.randrange(1, len(words))
        rows.append((i, " ".join(words[:at]) + ". " + " ".join(words[at:]), "s", "en"))
        if rng.random() < 0.8:
            labels.append((i, 1, int(toxic), "x"))
    return rows, labels, {i: t for i, _, t, _ in labels}


@pytest.fixture(scope="module")
def learned(spark):
    rows, labels, _ = corpus()
    sample = X.training_sample(frame(spark, rows), spark.createDataFrame(labels, LABELS)).cache()
    return {f: X.fit(sample, fairness=f) for f in (0.0, X.FAIRNESS)}


def test_held_out_rows_are_told_apart(spark, learned):
    rows, _, toxic = corpus()
    extra = [(5000, None, None, None), (5001, "", "s", "en"), (5002, "1 2 3 %", "s", "en"), (None, "Grobnik wab", "s", "en"), rows[3], rows[3],
             (5003, "wab " * 400_000 + "lumpazius", "s", "en")]
    got = X.score(frame(spark, rows + extra), learned[X.FAIRNESS]).select("row.doc_id", X.held_out(F.col("row.doc_id")).alias("held"), "score").collect()
    assert len(got) == len(rows) + len(extra) and all(0 <= r.score <= 1 for r in got)
    held = {i for i, *_ in rows if zlib.crc32(str(i).encode()) % 5 == 0}
    assert {r.doc_id for r in got if r.held and r.doc_id < 5000} == held
    judged = [(r.score >= 0.5) == (toxic[r.doc_id] == 1) for r in got if r.held and r.doc_id in toxic]
    assert len(judged) > 100 and np.mean(judged) > 0.97
    by_id = {r.doc_id: r.score for r in got}
    assert by_id[5000] == by_id[5001] == by_id[5002] < 0.5 < by_id[5003] and by_id[None] > 0.5


def test_neutral_mentions_are_scored_lower_than_without_the_penalty(spark, learned):
    neutral = [(i, f"wab wbc {term} wcd wde", "s", "en") for i, term in enumerate(["Muslims", "Christians", "Jews", "people"])]
    plain, fair = ([r.score for r in X.score(frame(spark, neutral), learned[f]).orderBy("row.doc_id").collect()] for f in (0.0, X.FAIRNESS))
    assert plain[0] > 4 * plain[3] and fair[0] < plain[0] / 2
    assert abs(fair[0] - fair[1]) < abs(plain[0] - plain[1]) / 2
    bad = [(i, f"wab {w} wcd {term}", "s", "en") for i, (w, term) in enumerate((w, t) for w in BAD for t in ("Muslims", "people"))]
    assert all(r.score >= 0.5 for r in X.score(frame(spark, bad), learned[X.FAIRNESS]).collect())


def test_labels_of_held_out_rows_are_not_read(spark):
    rows, labels, _ = corpus(300)
    docs = frame(spark, rows)
    models = [X.fit(X.training_sample(docs, spark.createDataFrame(x, LABELS))) for x in (
        labels, [(i, 0, 1 - t if zlib.crc32(str(i).encode()) % 5 == 0 else t, "y") for i, _, t, _ in labels])]
    assert models[0] == models[1] and models[0].weights


def test_counterfactuals_swap_terms_of_one_kind():
    identity = X.kinds()
    pairs = X.counterfactuals("Muslims came home. Nothing here.\nthe women left", identity)
    assert len(pairs) == 2
    for (gone, come), word in zip(pairs, ("muslims", "women")):
        other = next(w for w in come if w in identity)
        assert word in gone and other != word and other in identity[word]
    assert X.features("the Women left", identity) == {"the", "women", "left", "the women", "women left"}
    assert X.counterfactuals(None, identity) == [] and X.features(None, identity) == set()


def test_pieces_of_long_texts_change_nothing(monkeypatch):
    identity, text = X.kinds(), "one two women three. four men, five " * 30
    want = X.features(text, identity)
    monkeypatch.setattr(X, "PIECE_CHARS", 11)
    assert X.features(text, identity) == want


def test_solver_finds_the_minimum():
    rng = np.random.default_rng(1)
    rows = pd.DataFrame({"label": rng.integers(0, 2, 50), "plus": [sorted(rng.choice(4, rng.integers(0, 4), replace=False).tolist()) for _ in range(50)], "n": 1})
    pairs = pd.DataFrame({"plus": [[0], [1]], "minus": [[2], []], "n": [3, 1]})

    def loss(v):
        z = np.array([v[-1] + v[list(p)].sum() for p in rows["plus"]])
        u = np.array([v[0] - v[2], v[1]])
        return np.mean(np.logaddexp(0, z) - rows["label"] * z) + X.L2 / 2 * v[:-1] @ v[:-1] + 2.0 / 2 * (np.array([0.75, 0.25]) @ (u * u))

    b, w = X._solve(rows, pairs, 4, 50, 2.0)
    v = np.append(w, b)
    for i in range(5):
        for d in (-1e-3, 1e-3):
            assert loss(v) <= loss(v + d * np.eye(5)[i]) + 1e-9


def test_nothing_to_learn_from(spark):
    docs = frame(spark, [(1, "a b", "s", "en"), (2, None, None, None), (3, "Grobnik", "s", "en")])
    for labels, want in [([], 0.0), ([(1, 1, None, "x")], 0.0), ([(1, 1, 0, "x"), (2, 1, 0, "x")], 0.0), ([(3, 1, 1, "x")], 1.0)]:
        model = X.fit(X.training_sample(docs, spark.createDataFrame(labels, LABELS)))
        assert {r.score for r in X.score(docs, model).collect()} == {want}
    assert X.score(frame(spark, []), model).count() == 0
    sample = X.training_sample(docs, spark.createDataFrame([(1, 1, 0, "x"), (1, 1, 1, "x"), (4, 1, 1, "x")], LABELS))
    assert [(r.text, r.toxic) for r in sample.collect()] == [("a b", 1)]
