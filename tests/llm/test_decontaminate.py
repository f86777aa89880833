import random
import re

import pytest
from pyspark.sql import functions as F

from cadence.llm import decontaminate as D
from tests_llm_data import frame

WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def tokens(t):
    return WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))


def brute(rows, items, n=10):
    out = []
    for i, t, *_ in rows:
        w, hit, found = tokens(t), set(), set()
        for item, text in items:
            b = tokens(text)
            k = min(n, len(b))
            grams = {tuple(b[j:j + k]) for j in range(len(b) - k + 1)} if b else set()
            at = [p for p in range(len(w) - k + 1) if tuple(w[p:p + k]) in grams] if grams else []
            hit.update(p + q for p in at for q in range(k))
            if at and item is not None:
                found.add(str(item))
        out.append((str(i), len(w), len(hit), sorted(found)))
    return sorted(out)


def data(seed=1):
    rng = random.Random(seed)
    w = lambda n: [rng.choice(["The", "of", "Éa", "x1", "to-go", "ÑA", "a", "b,", "It's"]) for _ in range(n)]
    items = [(i, " ".join(w(rng.choice([3, 9, 10, 14, 25])))) for i in range(12)]
    items += [(None, "null id item with ten words or some more than that"), (40, None), (41, "?! ..."), (5, items[5][1])]
    rows = []
    for i in range(40):
        text = w(rng.randrange(0, 30))
        if rng.random() < 0.6:
            text += [rng.choice(items[:13])[1].upper()] + w(rng.randrange(9))
        rows.append((i, "; ".join(text), "s", "en"))
    rows += [(90, None, "s", None), (91, "", "s", None), rows[0], (None, items[0][1], "s", "en"), (92, "z " * 30_000 + items[3][1], "s", "en")]
    return rows, items


@pytest.mark.parametrize("limit", [20_000, 0])
def test_hits_match_brute_force_by_table_and_by_join(spark, limit):
    rows, items = data()
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = D.find_hits(frame(spark, rows), bench, max_table_windows=limit).select("row.doc_id", "n_words", "n_hit", "items").collect()
    assert sorted((str(r.doc_id), r.n_words, r.n_hit, list(r["items"])) for r in got) == brute(rows, items)


def test_removal_of_documents_and_spans(spark):
    rows, items = data(2)
    docs, bench = frame(spark, rows), spark.createDataFrame(items, "item_id long, text string")
    want = {(i, n) for i, n, hit, _ in brute(rows, items) if not hit}
    kept = D.decontaminate(docs, bench)
    assert kept.columns == docs.columns
    assert {(str(r.doc_id), len(tokens(r.text))) for r in kept.collect()} == want
    cut = D.decontaminate(docs, bench, action="spans")
    assert cut.columns == docs.columns
    got = sorted((str(r.doc_id), len(tokens(r.text))) for r in cut.collect())
    assert got == sorted((i, n - hit) for i, n, hit, _ in brute(rows, items))


def test_spans_keep_separators(spark):
    docs = frame(spark, [(1, "Before (it). one two, three four five six seven eight nine TEN! After it.", "s", "en")])
    bench = spark.createDataFrame([(1, "one two three four five six seven eight nine ten")], "item_id long, text string")
    assert D.decontaminate(docs, bench, action="spans").first().text == "Before (it).  ,        ! After it."


def test_empty_tables(spark):
    bench = spark.createDataFrame([], "item_id long, text string")
    docs = frame(spark, [(1, "some words", "s", "en")])
    assert D.decontaminate(docs, bench).count() == 1
    assert D.find_hits(frame(spark, []), spark.createDataFrame([(1, "a b")], "item_id long, text string")).count() == 0


def test_main_path_runs_no_python(spark):
    rows, items = data()
    out = D.decontaminate(frame(spark, rows), spark.createDataFrame(items, "item_id long, text string").where(F.lit(True)))
    assert "Python" not in out._jdf.queryExecution().executedPlan().toString()
