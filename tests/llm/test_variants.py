"""Spelling variants against all pairs by the full edit matrix."""

import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from cadence.llm import variants as V
from tests_llm_data import frame


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def brute(rows):
    n = Counter()
    for doc_id, text, *_ in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(c.lower() if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'null' if doc_id is None else doc_id}:{run}".encode())
            if h % 199 == 0:
                run = run[:h % len(run)] + run[h % len(run) + 1:]
            n[run] += 1
    n = {w: k for w, k in n.items() if len(w) >= 6 and k >= 5}
    near = {w: [x for x in n if abs(len(x) - len(w)) <= 1 and distance(w, x) == 1] for w in n}
    form = {}
    for w in n:
        best = min(near[w], key=lambda x: (-n[x], x), default=None)
        form[w] = best if best and n[best] >= 5 * n[w] else None

    def root(w):
        while form[w]:
            w = form[w]
        return w

    return {(w, form[w], root(w), n[w], len(near[w]), n.get(form[w])) for w in n}


def misspelt(rng, w):
    for _ in range(rng.choice([1, 1, 2])):
        at = rng.randrange(len(w))
        w = rng.choice([w[:at] + w[at + 1:], w[:at] + rng.choice("aeéßn") + w[at:], w[:at] + rng.choice("aeÀn") + w[at + 1:]])
    return w


def rows_of(seed):
    rng = random.Random(seed)
    base = ["".join(rng.choice(["ba", "na", "ré", "tio", "Ñu", "ss"]) for _ in range(rng.choice([2, 3, 4, 9]))) for _ in range(40)]
    wrong = {w: [misspelt(rng, w) for _ in range(3)] for w in base}
    rows = []
    for i in range(500):
        words = []
        for _ in range(rng.choice([0, 20, 60])):
            w = rng.choice(base[:8] if rng.random() < 0.6 else base)
            words.append(rng.choice(wrong[w]) if rng.random() < 0.15 else w.title() if rng.random() < 0.2 else w)
        rows.append((i, rng.choice([" ", "1", ", "]).join(words), "s", "en"))
    chain = [("internationale", 800), ("internationalee", 130), ("internationaleee", 20)]
    rows += [(1000, " ".join(w for w, n in chain for _ in range(n)), "s", "en"), (1001, None, None, None), (1002, "", "s", "en"),
             (None, "waarden " * 9, "s", None), (1003, "x" * 3000 + " kürzere " * 5, "s", "de"), rows[1], rows[1]]
    return rows


def collected(df):
    return [(r.word, r.form, r.root, r.n, r.n_near, r.form_n) for r in df.collect()]


@pytest.mark.parametrize("frame_words", [V.FRAME_WORDS, 3])
def test_variants_match_brute_force(spark, frame_words):
    rows = rows_of(2)
    want = brute(rows)
    assert sum(x[1] is not None for x in want) > 20 and ("internationaleee", "internationalee", "internationale", 20, 1, 130) in want
    got = collected(V.spelling_variants(frame(spark, rows), frame_words=frame_words))
    assert len(got) == len(set(got)) and set(got) == want


def test_scan_finds_every_pair(monkeypatch):
    monkeypatch.setattr(V, "SCAN_STATES", 7)
    rng = random.Random(3)
    for _ in range(60):
        rows = sorted({(g, "".join(rng.choice("abé") for _ in range(rng.randrange(6)))) for g in range(3) for _ in range(rng.randrange(40))})
        group, words = np.array([g for g, _ in rows], np.int64), [w for _, w in rows]
        i, j = V.scan(words, group)
        want = {(a, b) for a in range(len(rows)) for b in range(a + 1, len(rows)) if group[a] == group[b] and distance(words[a], words[b]) == 1}
        assert len(i) == len(want) and set(zip(i.tolist(), j.tolist())) == want


def test_long_texts_are_counted_in_pieces(monkeypatch):
    text = "Première, secondes 3troisième " * 20
    want = V.runs(text)
    monkeypatch.setattr(V, "PIECE_CHARS", 17)
    assert V.runs(text) == want == Counter({"première": 20, "secondes": 20, "troisième": 20})


def test_variants_of_nothing(spark):
    for rows in ([], [(1, None, None, None)], [(1, "few words here", "s", "en")]):
        assert V.spelling_variants(frame(spark, rows)).count() == 0
