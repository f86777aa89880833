import random
from collections import Counter

import numpy as np
import pytest
import zlib
from pyspark.sql import functions as F

from cadence.llm import langid as L
from cadence.llm import packing as P
from cadence.llm import token_counts as K
from cadence.llm.tokenizer import TOKENIZER_FILE, load
from tests_llm_data import frame

SYLLABLES = {"en": "the and ing th er on at ly of with", "fr": "le eau oi tré que aux ère ment éle", "de": "sch ung der ich keit über ß zu ein"}


def sentence(rng, lang, n):
    s = SYLLABLES[lang].split()
    return " ".join("".join(rng.choices(s, k=rng.choice([1, 2, 3]))).capitalize() for _ in range(n)) + "."


def lang_rows(n=240):
    rng = random.Random(4)
    rows = []
    for i in range(n):
        lang = rng.choice(list(SYLLABLES))
        rows.append((i, sentence(rng, lang, rng.choice([5, 30, 200])), "s", lang))
    return rows


def brute_vector(text, dim):
    """Bind and bundle one trigram at a time."""
    out, stream = np.zeros(dim), [0]
    for c in text:
        p = ord(c.lower()) if c.isalpha() and len(c.lower()) == 1 else ord(c) if c.isalpha() else 0
        if p or stream[-1]:
            stream.append(p)
    if stream[-1]:
        stream.append(0)
    v = {p: L.letter_vectors(np.array([p]), dim)[0] for p in set(stream)}
    for a, b, c in zip(stream, stream[1:], stream[2:]):
        if b:
            out += np.roll(v[a], 2) * np.roll(v[b], 1) * v[c]
    return out


def test_vectors_match_brute_force(monkeypatch):
    monkeypatch.setattr(L, "PIECE_CHARS", 50)        # long texts in pieces
    texts = ["Abc abd!", "", None, "123 ...", "Éa ñ—ß x" * 30, "İstanbul 漢字 ǅ", "a", sentence(random.Random(1), "de", 60)]
    e = L.Encoder(64)
    got = L.bundles(texts, e)
    want = np.stack([brute_vector(t or "", 64) for t in texts])
    assert np.array_equal(got, want)
    assert np.array_equal(L.bundle_all(texts, e), want.sum(axis=0))


def test_held_out_accuracy_and_contract(spark):
    rows = lang_rows() + [(900, None, "s", "en"), (901, "123 %%", "s", "en"), (902, "", "s", None), (None, "le eau oi", "s", None)]
    docs = frame(spark, rows)
    learned = L.learn(docs.where(~L.held_out(F.col("doc_id"))))
    assert sorted(learned) == ["de", "en", "fr"]
    out = L.identify(docs, learned).select("row.doc_id", "row.lang", L.held_out(F.col("row.doc_id")).alias("held"), "pred.*").collect()
    assert len(out) == len(rows)
    held = [r for r in out if r.held and r.doc_id < 900]
    assert {r.doc_id for r in out if r.held} == {i for i, *_ in rows if i is not None and zlib.crc32(str(i).encode()) % 4 == 2}
    assert sum(r.lang == r.lang_pred for r in held) >= 0.97 * len(held)
    assert all(0 <= r.score <= 1 for r in out)
    assert {(r.lang_pred, r.score) for r in out if r.doc_id in (900, 901, 902)} == {("und", 0.0)}


def test_prediction_uses_only_text_and_learns_only_from_its_rows(spark):
    rows = lang_rows(60)
    docs = frame(spark, rows)
    learned = L.learn(docs.where(~L.held_out(F.col("doc_id"))))
    other = frame(spark, [(i, t, "s", "en" if zlib.crc32(str(i).encode()) % 4 == 2 else lang) for i, t, _, lang in rows])
    again = L.learn(other.where(~L.held_out(F.col("doc_id"))))
    assert all(np.array_equal(learned[x], again[x]) for x in learned)


def test_langid_without_training_rows(spark):
    docs = frame(spark, [(1, "some text", "s", None)])
    assert L.learn(docs) == {}
    assert L.identify(docs, {}).first().pred.lang_pred == "und"
    assert L.identify(frame(spark, []), {}).count() == 0


def naive_rows(lengths, room):
    rows, left = [], []
    for i in sorted(range(len(lengths)), key=lambda i: (-lengths[i], i)):
        fits = [x for x in left if x >= lengths[i]]
        if fits:
            r = left.index(min(fits))
        else:
            rows.append([])
            left.append(room)
            r = len(rows) - 1
        rows[r].append(lengths[i])
        left[r] -= lengths[i]
    return sorted(map(sum, rows))


def test_best_fit_decreasing_matches_a_linear_search():
    for seed in range(200):
        rng = random.Random(seed)
        room = rng.choice([1, 2, 7, 8, 16, 33, 100])
        lengths = [rng.randint(1, room) for _ in range(rng.randrange(90))]
        rows = P.best_fit_decreasing(lengths, room)
        assert sorted(sum(rows, [])) == list(range(len(lengths)))
        assert sorted(sum(lengths[i] for i in r) for r in rows) == naive_rows(lengths, room)


def token_rows():
    rng = random.Random(8)
    rows = [(i, sentence(rng, "fr", rng.choice([1, 10, 80, 700])), "s", "fr") for i in range(80)]
    return rows + [(200, None, "s", None), (201, "", "s", None), (202, "  \n", "s", None), rows[3], (None, "no id", "s", "en"), (203, "y" * 20_000, "s", "en")]


def test_packing_round_trip(spark, tmp_path):
    rows = token_rows()
    t = load(TOKENIZER_FILE)
    P.write_packed(P.pack(frame(spark, rows), row_tokens=128, block_tokens=4000), str(tmp_path / "packed"))
    packed = P.read_packed(spark, str(tmp_path / "packed")).collect()
    found = Counter()
    pieces = {}
    for n, r in enumerate(packed):
        ids, pos = P.matrix([r.ids], 128)[0], P.matrix([r.positions], 128)[0]
        assert r.cu_seqlens[0] == 0 and r.cu_seqlens[-1] == r.n_tokens <= 128 and (ids[r.n_tokens:] == t.end_of_text).all()
        for a, b, doc, start in zip(r.cu_seqlens, r.cu_seqlens[1:], r.doc_ids, r.token_starts):
            assert pos[a:b].tolist() == list(range(b - a))
            pieces.setdefault(doc, []).append((start, n, ids[a:b].tolist()))
    for doc, own in pieces.items():
        for start, group in {s: [p for p in own if p[0] == s] for s, *_ in own}.items():
            found[doc, start] += len(group)
    for i, text in {(i, t) for i, t, *_ in rows}:
        if not text:
            assert i not in pieces
            continue
        copies = sum(1 for r in rows if r[:2] == (i, text))
        ids = []
        for start in sorted({p[0] for p in pieces[i]}):
            same = [p[2] for p in pieces[i] if p[0] == start]
            assert len(same) == copies and all(x == same[0] for x in same) and start == len(ids)
            ids += same[0]
        assert ids[-1] == t.end_of_text and t.decode(ids[:-1]) == text.encode()
    assert len({(r.block, r.row) for r in packed}) == len(packed)


def test_packing_of_nothing(spark):
    assert P.pack(frame(spark, [])).count() == 0
    assert P.pack(frame(spark, [(1, None, None, None)])).count() == 0


def test_context_limits_match_brute_force(spark):
    rows = token_rows()
    t = load(TOKENIZER_FILE)
    lengths = [len(t.encode_text(x)) if x else 0 for _, x, *_ in rows]
    limits = K.context_limits(K.length_histogram(frame(spark, rows)))
    got = {r.length: r for r in limits.collect()}
    assert sorted(got) == sorted(set(lengths))
    for n, r in got.items():
        assert (r.n_docs, r.docs_total, r.tokens_total) == (lengths.count(n), len(lengths), sum(lengths))
        assert (r.docs_longer, r.tokens_longer) == (sum(x > n for x in lengths), sum(x for x in lengths if x > n))
        assert r.tokens_truncated == sum(min(x, n) for x in lengths)
        assert r.share_fitting == pytest.approx(sum(x <= n for x in lengths) / len(lengths))
    for q in (0.1, 0.5, 0.99, 1.0):
        assert K.quantile(limits, q).first()[0] == sorted(lengths)[max(0, int(np.ceil(q * len(lengths) - 1e-9)) - 1)]
    assert K.truncated_total(limits, 37).first()[0] == sum(min(x, 37) for x in lengths)


def test_context_limits_of_nothing(spark):
    assert K.context_limits(K.length_histogram(frame(spark, []))).count() == 0
