"""Small inputs for the training-data operators."""

import random

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, row string, k long, node long, size long"


def words(rng, n, vocab=400):
    return [f"w{rng.randrange(vocab)}" for _ in range(n)]


def frame(spark, rows):
    """Documents from (doc_id, text, source, lang), with extra columns whose names operators use."""
    out = [(i, t, lang, source, None if t is None else len(t), "extra", 7, 8, 9) for i, t, source, lang in rows]
    return spark.createDataFrame(out, SCHEMA)


def near_copies(seed=1, n=30):
    """Texts with near copies at many distances, exact copies, short, empty and null texts."""
    rng, rows, i = random.Random(seed), [], 0
    for g in range(n):
        base = words(rng, rng.choice([3, 5, 6, 40, 90, 200]), 5000)
        for c in range(rng.choice([1, 1, 2, 4, 9])):
            w = list(base)
            for _ in range(rng.choice([0, 0, 1, 2, 3, 5, 8]) if c else 0):
                w[rng.randrange(len(w))] = f"x{rng.randrange(10**6)}"
            rows.append((i, " ".join(w) if c % 2 else "\n ".join(w).title(), f"s{g % 3}", "en"))
            i += 3
    rows += [(i, None, None, None), (i + 1, "", "s0", None), (i + 2, " \t\n", "s0", None), (i + 3, "One word", "s0", "en"),
             (i + 4, "one  word", "s0", "en"), rows[0], rows[0]]
    rng.shuffle(rows)
    return rows
