"""Source divergence audit against a brute-force version in whole numbers."""

import random
import re
from collections import Counter
from itertools import islice

from cadence.llm import divergence as D
from tests_llm_data import frame

TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")


def brute(rows, min_docs, top):
    found, in_docs = {}, Counter()
    for _, text, source, lang in rows:
        group = (lang or "", source or "")
        terms = Counter("".join(c.lower() if "A" <= c <= "Z" else c for c in t) for t in TERM.findall(text or ""))
        found.setdefault(group, Counter()).update(terms)
        in_docs.update((group[0], t) for t in terms)
    out = set()
    for lang in {g[0] for g in found}:
        kept = sorted(t for (x, t), n in in_docs.items() if x == lang and n >= min_docs)
        groups = {s: c for (x, s), c in found.items() if x == lang}
        whole = sum(groups.values(), Counter())

        def p(c, t):
            return 1 + D.SCALE * (c[t] + D.SMOOTH) // (sum(c[k] for k in kept) + D.SMOOTH * len(kept))

        def ranked(values):
            return enumerate(sorted(values, key=lambda x: (-x[1], x[0].encode())), 1)

        for s, c in groups.items():
            pairs = [(o, sum(abs(p(c, t) - p(groups[o], t)) for t in kept)) for o in groups if o != s]
            out |= {(lang, s, "pair", i, v, r) for r, (i, v) in ranked(pairs)}
            more = [(t, p(c, t) - p(whole, t)) for t in kept if c[t] and p(c, t) > p(whole, t)]
            out |= {(lang, s, "term", i, v, r) for r, (i, v) in islice(ranked(more), top)}
    return out


def rows_of(seed, n):
    rng = random.Random(seed)
    vocab = [f"{a}{b}" for a in ("Alpha", "été", "漢字", "zeta", "mid") for b in "abcdefghij"]
    rows = []
    for i in range(n):
        k = min(rng.randrange(12), rng.randrange(12))          # one source has many of the rows
        words = rng.choices(vocab[k:k + 30], k=rng.choice([0, 3, 20, 60]))
        rows.append((i, rng.choice([" ", "1", "-\t"]).join(words), f"s{k}", rng.choice(["en", "en", "fr", None])))
    return rows + [(900, None, "only-null", "en"), (901, "", None, "fr"), (902, "rare words", None, None), rows[0], rows[0],
                   (903, "a1b2c3 " * 4, "short", "xx"), (904, "other", "short2", "xx")]


def collected(df):
    return [(r.lang, r.source, r.part, r["item"], r.value, r["rank"]) for r in df.collect()]


def test_blocks_of_every_size_match_brute_force(spark):
    rows = rows_of(5, 160)
    for min_docs, top, options in [(3, 50, {}), (2, 4, {"group_block": 2, "term_block": 3}), (4, 7, {"group_block": 1, "term_block": 1}),
                                   (500, 5, {"group_block": 5})]:
        got = collected(D.audit(frame(spark, rows), top, min_docs=min_docs, **options))
        assert len(got) == len(set(got)) and set(got) == brute(rows, min_docs, top)


def test_counts_handed_on_in_parts_and_long_texts_in_pieces(spark, monkeypatch):
    text = "one two  été three\n" * 40
    want = Counter(t.lower() for t in TERM.findall(text))
    monkeypatch.setattr(D, "PIECE_BYTES", 13)
    assert {k.decode(): n for k, n in D._count(text).items()} == want
    assert [t.decode() for t in D.terms("A-b é1Z")] == ["a", "b", "é", "z"] and D.terms(None) == []


def test_audit_of_nothing(spark):
    assert D.audit(frame(spark, [])).count() == 0
    assert collected(D.audit(frame(spark, [(1, None, None, None)]))) == []
    assert sorted(collected(D.audit(frame(spark, [(1, None, None, None), (2, "", "b", None)])))) == [("", "", "pair", "b", 0, 1), ("", "b", "pair", "", 0, 1)]
