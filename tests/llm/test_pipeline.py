import random
from collections import Counter

import duckdb
import pytest

import __spark_entry__ as entry
import corpus_pipeline as pipeline
from cadence.llm import mixing
from cadence.llm import queries as Q
from cadence.llm.packing import ROW_TOKENS, matrix
from cadence.llm.tokenizer import TOKENIZER_FILE, load
from test_decontaminate import brute as brute_hits
from test_near_dedup import brute_components
from test_quality_mixing import features, kept

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """Documents with junk, near copies and benchmark passages, and a benchmark."""
    rng = random.Random(6)
    word = lambda: rng.choice("the of and to in".split()) if rng.random() < 0.3 else "w" + "".join(rng.choices("abcdefgh", k=4))
    bench = [(i, " ".join(word() for _ in range(rng.choice([6, 12, 20])))) for i in range(5)]
    rows = []
    for i in range(90):
        w = [word() for _ in range(rng.choice([20, 60, 90, 200]))]
        if i % 9 == 0:
            w[30:30] = bench[i % 5][1].split()
        if i % 11 == 0:
            w = [x + "%%%" for x in w]
        rows.append((i, " ".join(w), "en", f"s{rng.choice([0, 0, 0, 1, 2, 3])}"))
        if i % 7 == 0:
            w[3] = "changed"
            rows.append((200 + i, " ".join(w), "en", "s1"))
    rows += [(500, rows[4][1], "en", "s2"), (501, None, None, None), (502, "", "en", "s0"), rows[8]]
    d = tmp_path_factory.mktemp("sf")
    docs = [(i, t, lang, s, None if t is None else len(t)) for i, t, lang, s in rows]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(d / "documents.parquet"))
    spark.createDataFrame(bench, "item_id long, text string").write.parquet(str(d / "benchmark.parquet"))
    return str(d), rows, bench


def test_pipeline_matches_brute_force(spark, folder):
    path, rows, bench = folder
    good = [r for r in rows if kept(features(r[1]))]
    first, left = set(), []
    component = {i: c for i, _, c in brute_components(good)}
    for r in sorted(good):
        if component[str(r[0])] not in first:
            first.add(component[str(r[0])])
            left.append(r)
    hits = {i: n for i, _, n, _ in brute_hits(left, bench)}
    clean = [r for r in left if not hits[str(r[0])]]
    assert len(rows) > len(good) > len(left) > len(clean) > 20

    docs = spark.read.parquet(f"{path}/documents.parquet")
    columns = docs.columns
    for (name, stage), want in zip(pipeline.STAGES[:3], (good, left, clean)):
        docs = pipeline.materialise(stage(spark, docs, path), "test")
        assert docs.columns == columns, name
        assert Counter(r.doc_id for r in docs.collect()) == Counter(r[0] for r in want), name
    taken = {r.row.doc_id: r.taken for r in mixing.mix(docs).collect()}
    mixed = pipeline.materialise(pipeline.STAGES[3][1](spark, docs, path), "test")
    assert mixed.columns == columns
    words = Counter()
    for r in mixed.collect():
        words[r.doc_id] += len(r.text.split())
    assert words == Counter({i: n for i, n in taken.items() if n})

    t = load(TOKENIZER_FILE)
    want = Counter(tuple(t.encode_text(r.text)) + (t.end_of_text,) for r in mixed.collect())
    got, parts = Counter(), {}
    for r in pipeline.run(spark, path).collect():
        ids = matrix([r.ids], ROW_TOKENS)[0]
        for a, b, doc, start in zip(r.cu_seqlens, r.cu_seqlens[1:], r.doc_ids, r.token_starts):
            assert start == 0       # no document here is longer than a row
            got[tuple(ids[a:b].tolist())] += 1
    assert got == want


def test_pipeline_of_an_empty_table(spark, tmp_path):
    empty = spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
    empty.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    assert pipeline.run(spark, str(tmp_path)).count() == 0


def same(a, b):
    return a == pytest.approx(b, rel=1e-9) if isinstance(a, float) else a == b


@pytest.mark.parametrize("name", sorted(Q.ORACLE_SQL))
def test_queries_match_their_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "benchmark", "pages"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SMALL}/{t}.parquet'")
    rel = con.execute(Q.ORACLE_SQL[name])
    cols = [c[0] for c in rel.description]
    want = sorted(rel.fetchall(), key=str)
    got = Q.QUERIES[name](spark, SMALL)
    assert sorted(got.columns) == sorted(cols)
    got = sorted((tuple(r) for r in got.select(*cols).collect()), key=str)
    assert len(got) == len(want) and all(same(x, y) for a, b in zip(got, want) for x, y in zip(a, b))


def test_every_operator_has_a_query():
    names = entry.queries()
    assert all(any(n.startswith(f"op{i}_") for n in names) for i in range(1, 11)) and "pipeline" in names
    assert [n for n, _ in pipeline.STAGES] == ["quality_rules", "minhash_near_dedup", "decontamination", "mix_sources", "pack_tokens"]
