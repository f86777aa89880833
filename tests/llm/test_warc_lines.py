import base64
import hashlib
import random

import pytest
from pyspark.sql import functions as F

from cadence.llm import line_dedup as U
from cadence.llm import warc as W
from tests_llm_data import frame


def pages(spark, rows):
    return spark.createDataFrame([(*r, "x", 1) for r in rows], "page_id long, url string, html string, payload string, segment int")


def page_rows():
    rng = random.Random(2)
    big = "".join(rng.choice("abcdé<>\r\n漢 ") for _ in range(90_000))
    tricky = "WARC/1.1\r\nWARC-Type: response\r\n\r\n0\r\n\r\n\r\n\r\nWARC/1.1\r\n"
    return [(1, "http://a/1", big), (2, "http://a/2", "same"), (3, "http://a/3", "same"), (9, None, "same"), (4, "http://a/\r\nx: y", tricky),
            (5, "u", None), (6, "u", ""), (7, "é", tricky * 900), (8, "http://a/8", big), (None, "u", "same"), (None, "u", "null id only")]


def test_round_trip(spark, tmp_path):
    rows = page_rows()
    W.write_archives(pages(spark, rows), str(tmp_path / "w"), records_per_file=3)
    got = W.read_archives(spark, str(tmp_path / "w")).collect()
    largest = {}
    for i, _, html in rows:
        h = html or ""
        largest[h] = max([x for x in (largest.get(h), i) if x is not None], default=None)
    want = []
    for i, _, html in rows:
        data, last = (html or "").encode(), largest[html or ""]
        response = i == last
        want.append((str(i), len(data), base64.b32encode(hashlib.sha1(data).digest()).decode(), "response" if response else "revisit",
                     None if response else last, "ok", data if response else None))
    found = [(str(r.page_id), r.payload_bytes, r.payload_digest, r.record_type, r.refers_to, r.status, None if r.payload is None else bytes(r.payload)) for r in got]
    assert sorted(found, key=str) == sorted(want, key=str)
    numbers = W.read_records(spark, str(tmp_path / "w"), segmented=True).groupBy("record_type").count().collect()
    assert {r.record_type for r in numbers} == {"response", "continuation"}


def test_repeated_rows_are_each_a_record(spark, tmp_path):
    W.write_archives(pages(spark, [(1, "u", "x" * 70_000)] * 3), str(tmp_path / "w"))
    got = W.read_archives(spark, str(tmp_path / "w")).collect()
    assert [(r.page_id, r.record_type, r.status) for r in got] == [(1, "response", "ok")] * 3
    assert len({r.record_id for r in got}) == 3


def test_reassembly_finds_missing_and_broken_segments(spark):
    body = W.http_message(b"payload " * 30)
    digest = base64.b32encode(hashlib.sha1(b"payload " * 30).digest()).decode()
    third = len(body) // 3

    def segments(name, parts, total=len(body)):
        head = [(name, "response", 1, 1, None, None, parts[0], digest, 240, None)]
        return head + [(f"{name}.{i}", "continuation", None, i, name, total if i == len(parts) else None, p, digest, 240, None) for i, p in enumerate(parts[1:], 2)]

    parts = [body[:third], body[third:2 * third], body[2 * third:]]
    rows = segments("whole", parts)[::-1]
    rows += [r for r in segments("gap", parts) if r[3] != 2]
    rows += segments("length", parts, total=1)
    rows += segments("no total", parts)[:2]
    rows += segments("twice", parts) + segments("twice", parts)[1:2]
    rows += segments("framing", [parts[0], parts[1], parts[2][:-3] + b"zzz"])[:3]
    rows += segments("orphan", parts)[1:]
    out = W._decode(W.join_segments(spark.createDataFrame(rows, W.RECORD_SCHEMA))).collect()
    status = {r.record_id: r.status for r in out}
    assert status == {"whole": "ok", "gap": "incomplete", "length": "incomplete", "no total": "incomplete", "twice": "ok",
                      "framing": status["framing"], "orphan": "orphan"}
    assert bytes(next(r.payload for r in out if r.record_id == "whole")) == b"payload " * 30
    bad = W.http_message(b"abc").replace(b"3\r\nabc", b"4\r\nabc")
    assert W.http_payload(bad) is None and W.dechunk(b"zz\r\n") is None and W.dechunk(b"") is None


def test_segments_and_chunks_split_no_character():
    for text in ("漢字é😀" * 50, "", "a"):
        data = text.encode()
        for size in (1, 2, 3, 5, 64):
            parts = list(W._pieces(data, size))
            assert b"".join(parts) == data and all(p for p in parts)
            if size >= 4:
                assert all(p.decode() is not None and len(p) <= size for p in parts)
        assert W.http_payload(W.http_message(data, 7)) == data


def test_archive_is_a_plain_record_stream_and_broken_ones_are_refused():
    record = W._record([("WARC-Type", "response"), ("WARC-Record-ID", "<urn:page:1#1>")], b"x\r\n\r\ny")
    stream = (record + b"\r\n\r\n") * 3
    for step in (1, 7, 1000):
        got = list(W.parse_records(iter([stream[i:i + step] for i in range(0, len(stream), step)])))
        assert [b for _, b in got] == [b"x\r\n\r\ny"] * 3
    for bad in (stream[:-9], b"nonsense\r\n\r\n", record + b"xxxx"):
        with pytest.raises(ValueError):
            list(W.parse_records(iter([bad])))


def test_no_pages(spark, tmp_path):
    W.write_archives(pages(spark, []), str(tmp_path / "w"))
    assert W.read_archives(spark, str(tmp_path / "w")).count() == 0


def brute_lines(rows, kind, min_words):
    seen, out = {}, {}
    for i, t in sorted({(i, t) for i, t, *_ in rows}, key=lambda x: (x[0] is None, x[0] or 0)):
        gone, n = [], 0
        for s, e in U.units(t or "", kind):
            w = " ".join((t[s:e]).lower().split())
            if len(w.split()) >= min_words:
                n += 1
                if w in seen:
                    gone.append((s, e))
                seen[w] = True
        text = t
        for s, e in gone[::-1]:
            text = text[:s] + text[e:]
        out[i, t] = (n, gone, text)
    return out


def line_rows(seed):
    rng = random.Random(seed)
    lines = ["Short one.", "This line HAS  enough words", "this line has enough words", "a b c d e", "é ü ö ä ß words", "", "  "]
    lines += [" ".join(rng.choice("abcdefgh") for _ in range(rng.choice([4, 5, 6]))) for _ in range(20)]
    rows = [(i, rng.choice(["\n", "\r\n", "\n\n"]).join(rng.choices(lines, k=rng.randrange(9))), "s", "en") for i in range(60)]
    return rows + [(70, None, "s", None), (71, "", "s", None), rows[5], (None, rows[5][1], "s", "en"), (72, ("z y x w v u\n" * 20_000), "s", "en")]


@pytest.mark.parametrize("kind", ["line", "paragraph"])
@pytest.mark.parametrize("seed", [1, 2])
def test_line_dedup_matches_brute_force(spark, kind, seed):
    rows = line_rows(seed)
    want = brute_lines(rows, kind, U.MIN_WORDS)
    got = U.dedup_units(frame(spark, rows), kind).collect()
    assert len(got) == len(rows)
    for r in got:
        assert (r.n_units, [tuple(x) for x in r.removed], r.kept_text) == want[r.row.doc_id, r.row.text]


def test_units_make_up_the_text():
    for _, t, *_ in line_rows(3):
        for kind in ("line", "paragraph"):
            spans = list(U.units(t or "", kind))
            assert "".join((t or "")[s:e] for s, e in spans) == (t or "")


def test_line_dedup_of_nothing(spark):
    assert U.dedup_units(frame(spark, [])).count() == 0
    assert U.removals(frame(spark, [(1, None, None, None)])).where(F.size("removed") > 0).count() == 0


def test_short_units_and_texts_without_spaces_count(spark):
    passage = "これは空白のない長い文です。" * 30
    rows = [(1, f"Heading\n{passage}\nfirst text here\n \n", "s", "ja"), (2, f"heading\n{passage}\nother text here\n \n", "s", "ja")]
    got = {r.row.doc_id: r for r in U.dedup_units(frame(spark, rows)).collect()}
    assert got[1].kept_text == rows[0][1] and got[1].n_units == 3
    assert got[2].kept_text == "other text here\n \n" and len(got[2].removed) == 2


def test_units_short_in_words_and_characters_can_be_exempt(spark):
    url = "https://example.org/" + "a" * 60
    text = f"Page 3\nA heading of many words here\n{url}\n{'漢' * 45}\n漢字\nshort four words here\n"
    rows = [(i, text + f"body {i} of the text", "s", "en") for i in (1, 2)]
    got = {r.row.doc_id: r for r in U.dedup_units(frame(spark, rows), short=(5, 40)).collect()}
    # too long in words, or in characters, to be exempt
    assert got[2].kept_text == "Page 3\n漢字\nshort four words here\nbody 2 of the text" and got[2].n_units == 4
    exact = {r.row.doc_id: r for r in U.dedup_units(frame(spark, rows)).collect()}
    assert exact[2].kept_text == "body 2 of the text" and exact[1].kept_text == rows[0][1]
