import random
import re
from collections import Counter, defaultdict

import pytest

from cadence.llm import mixing as M
from cadence.llm import quality as Q
from tests_llm_data import frame

WS = "[^\x20\x09-\x0d]+"


def features(t):
    t = t or ""
    w = re.findall(WS, t)
    grams = Counter(zip(w, w[1:], w[2:]))
    hit = {p + q for p in range(len(w) - 2) if grams[tuple(w[p:p + 3])] > 1 for q in range(3)}
    lines = [x for x in t.split("\n") if re.search(WS, x)]
    return len(w), sum(map(len, w)), sum(t.count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(hit), len(lines)


def kept(f):
    n, chars, symbols, dup, rep, lines = f
    return n >= 50 and 100 * rep <= 50 * n and 100 * symbols <= 10 * n and 2 * n <= chars <= 10 * n and 100 * dup <= 50 * lines


def texts(seed=1):
    rng = random.Random(seed)
    out = [None, "", " \n\t", "one", "# $ % & |", "a b c a b c", "é ü ñ x", "x\x1cy z"]
    for _ in range(60):
        w = [rng.choice(["the", "of", "é", "#x", "word", "longerword", "a|b", "Extra", "lineage"]) + str(rng.randrange(rng.choice([2, 500]))) for _ in range(rng.randrange(120))]
        out.append("".join(x + rng.choice([" ", " ", "\n", "\r\n", "\x0b"]) for x in w))
    return out + ["same line here\n" * 40, "w " * 50_000]


def test_features_and_verdicts_match_brute_force(spark):
    rows = [(i, t, "s", "en") for i, t in enumerate(texts())] + [(0, None, "s", "en"), (None, "x", None, None)]
    cols = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    got = Q.quality_cascade(frame(spark, rows), report=cols).collect()
    want = sorted((str(i), *features(t)[:5], kept(features(t))) for i, t, *_ in rows)
    assert sorted((str(r.row.doc_id), *[r.verdict[c] for c in cols], r.verdict.kept) for r in got) == want


def test_order_of_rules_never_changes_verdicts():
    for t in texts(3):
        verdicts = {all(not r.rejects(Q.Doc(t)) for r in order) for order in (Q.DEFAULT_RULES, Q.DEFAULT_RULES[::-1])}
        assert verdicts == {kept(features(t))}


def test_cascade_runs_cheap_selective_rules_first_and_short_circuits(spark):
    rows = [(i, f"{'bad' if i % 2 else 'good'} text", "s", "en") for i in range(200)]
    slow = Q.Rule("slow", lambda d: sum(range(20_000)) < 0)
    sharp = Q.Rule("sharp", lambda d: d.text.startswith("bad"))
    order = [e.rule.name for e in Q.estimate(frame(spark, rows), [slow, sharp])]
    assert order == ["sharp", "slow"]
    out = Q.quality_cascade(frame(spark, rows), [slow, sharp]).collect()
    assert {r.verdict.failed_rule for r in out} == {None, "sharp"}


def test_filter_keeps_columns_and_handles_empty(spark):
    docs = frame(spark, [(1, " ".join(f"word{i}" for i in range(60)), "s", "en"), (2, "short", "s", "en")])
    out = Q.quality_filter(docs)
    assert out.columns == docs.columns and [r.doc_id for r in out.collect()] == [1]
    assert Q.quality_filter(frame(spark, [])).count() == 0


def targets(sizes, share=1.5, most=2.0):
    """Repeated sharing by weight, straight from the rule."""
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    w = {s: (3, 1, 2)[i % 3] for i, s in enumerate(order)}
    out, left, open_ = {}, share * sum(sizes.values()), set(order)
    while open_:
        unit = left / sum(w[s] for s in open_)
        above = {s for s in open_ if unit * w[s] >= most * sizes[s]}
        if not above:
            return out | {s: unit * w[s] for s in open_}
        for s in above:
            out[s] = most * sizes[s]
            left -= out[s]
        open_ -= above
    return out


def mix_rows(seed, n=150):
    rng = random.Random(seed)
    names = [None, "z", "a", "é", "B", "\U0001f600", "", "mid"]
    rows = [(i, " ".join(["w"] * rng.choice([0, 1, 5, 40, 300])), rng.choices(names, [3, 40, 1, 2, 5, 2, 1, 9])[0], "en") for i in range(n)]
    return rows + [(n, None, "a", None), rows[0], rows[0], (n + 1, "one", "only", "en")]


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_mix_meets_targets_exactly(spark, seed):
    rows = mix_rows(seed)
    got = M.mix(frame(spark, rows)).collect()
    assert len(got) == len(rows)
    sizes, taken = defaultdict(int), defaultdict(int)
    for r in got:
        n = len((r.row.text or "").split())
        assert r.size == n and 0 <= r.taken <= 2 * n
        sizes[r.row.source] += n
        taken[r.row.source] += r.taken
    want = targets(sizes)
    for r in got:
        assert r.source_size == sizes[r.row.source] and r.target == pytest.approx(want[r.row.source])
    for s in sizes:
        assert abs(taken[s] - want[s]) <= 0.5 + 1e-6
    again = M.mix(frame(spark, rows[::-1])).collect()
    assert sorted((str(r.row.doc_id), r.taken) for r in again) == sorted((str(r.row.doc_id), r.taken) for r in got)


def test_mixed_documents_have_the_words_taken(spark):
    rows = [(i, f"  a{i}  b\tc\n" + " ".join(f"x{j}" for j in range(i % 7)) + " ", s, "en") for i, s in enumerate(["p", "q", "p", "r", "p", "p", "q", None] * 6)]
    docs = frame(spark, rows)
    taken = {r.row.doc_id: (r.size, r.taken) for r in M.mix(docs).collect()}
    out = M.mixed_documents(docs)
    assert out.columns == docs.columns
    got, whole = Counter(), {i: t for i, t, *_ in rows}
    for r in out.collect():
        got[r.doc_id] += len(r.text.split())
        assert whole[r.doc_id].startswith(r.text) and r.n_chars == len(r.text)
    assert got == Counter({i: t for i, (_, t) in taken.items() if t})


def test_mix_of_nothing(spark):
    assert M.mix(frame(spark, [])).count() == 0
    assert M.mix(frame(spark, [(1, None, None, None)])).first().taken == 0
