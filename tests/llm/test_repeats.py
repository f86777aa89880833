import random

import numpy as np
import pytest

from cadence.llm import repeats as R
from tests_llm_data import frame


def brute(rows, length):
    """Sizes and kept bytes per distinct (doc_id, text), in id order (nulls last)."""
    seen, out = set(), {}
    for i, t in sorted({(i, t) for i, t, *_ in rows}, key=lambda x: (x[0] is None, x[0] or 0)):
        d = (t or "").encode()
        gone = bytearray(len(d))
        for p in range(len(d) - length + 1):
            s = d[p:p + length]
            if s in seen:
                gone[p:p + length] = b"\1" * length
            seen.add(s)
        spans = sum(1 for p in range(len(d)) if gone[p] and (not p or not gone[p - 1]))
        out[i, t] = (len(d), sum(gone), spans, bytes(x for x, g in zip(d, gone) if not g))
    return out


def check(spark, rows, length, **options):
    want = brute(rows, length)
    got = R.remove_repeats(frame(spark, rows), length, **options).collect()
    found = sorted((str(r.doc_id), r.n_bytes, sum(s.end - s.start for s in r.spans), len(r.spans), bytes(r.kept)) for r in got)
    assert found == sorted((str(i), *want[i, t]) for i, t, *_ in rows)


@pytest.mark.parametrize("limit", [256, 1])
@pytest.mark.parametrize("seed,length,alphabet", [(1, 8, "ab"), (2, 9, "abcé"), (3, 100, "abcdefgh "), (4, 33, "xyñ\n")])
def test_matches_brute_force(spark, seed, length, alphabet, limit):
    rng = random.Random(seed)
    text = lambda n: "".join(rng.choice(alphabet) for _ in range(n))
    shared = [text(rng.randrange(length, 5 * length)) for _ in range(4)]
    rows = []
    for i in range(60):
        parts = [text(rng.randrange(0, 3 * length))]
        for _ in range(rng.randrange(3)):
            parts += [rng.choice(shared), text(rng.randrange(0, length))]
        rows.append((i * 7 % 61, "".join(parts), "s", "en"))
    rows += [(100, None, None, None), (101, "", "s", "en"), rows[3], (102, shared[0] * 3, "s", "en"), (103, "a" * 5 * length, "s", "en")]
    rng.shuffle(rows)
    check(spark, rows, length, bucket_runs=limit)


def test_null_ids_and_equal_ids(spark):
    a, b = "The same passage of text. " * 6, "Another text that is here twice, with words. " * 4
    rows = [(None, a + b, "s", "en"), (3, a, "s", "en"), (3, a, "s", "en"), (8, b, "s", "en")]
    check(spark, rows, 100)


def test_text_longer_than_a_buffer(spark):
    rng = random.Random(9)
    long = "".join(rng.choice("abcdefghijklmnopqrstuvwxyz     ") for _ in range(1_300_000))
    rows = [(1, long, "s", "en"), (2, "before " + long[1_047_000:1_050_000] + " after", "s", "en"), (3, long[700_000:700_150], "s", "en")]
    got = {r.doc_id: r for r in R.remove_repeats(frame(spark, rows)).collect()}
    assert got[1].spans == []
    assert [tuple(s) for s in got[2].spans] == [(7, 3007)] or got[2].spans[0].start <= 7
    assert sum(s.end - s.start for s in got[2].spans) >= 3000 and got[3].kept == b""


def test_empty_table(spark):
    assert R.remove_repeats(frame(spark, [])).count() == 0


def test_runs_cover_every_string_once():
    rng = np.random.default_rng(0)
    data, offsets = rng.integers(97, 101, 5000).astype(np.uint8), np.array([0, 40, 40, 1000, 1099, 5000])
    names = R.Names(50)
    t, lo, hi, _, _ = R.find_runs(data, offsets, names)
    got = sorted((int(d), p) for d, a, b in zip(t, lo, hi) for p in range(a, b + 1))
    assert got == [(d, p) for d in range(5) for p in range(max(0, offsets[d + 1] - offsets[d] - 49))]


