"""Readers and writers, round trips and broken files."""

from __future__ import annotations

import json

from hushgrid.sources import corpora, lines as L, office, sinks, structured as S


def test_decode():
    assert L.decode(b"\xef\xbb\xbfa\r\nb") == "a\nb" and L.decode("é".encode("cp1252")) == "é" and L.decode("é".encode("utf-16")) == "é"
    for bad in (b"a\0b", bytes(range(1, 9)) * 4):
        try:
            L.decode(bad)
            raise AssertionError("accepted")
        except ValueError:
            pass


def test_lines(spark):
    df = spark.createDataFrame([(1, "a\n\nbc\nd"), (2, ""), (3, None)], "doc_id bigint, text string")
    assert [(r.line_no, r.char_start, r.text) for r in L.lines(df).orderBy("line_no").collect()] == [(0, 0, "a"), (2, 3, "bc"), (3, 6, "d")]


def test_csv_and_json():
    rows = list(S.csv_cells(b"name,name,\nA,B,\nC,D,E,F\nG\n"))
    assert [r[3] for r in rows[:3]] == ["name", "name#2", "column_3"] and rows[5][5] == "E" and len(rows) == 9 and rows[8][5] == ""
    cells = list(S.json_cells(b'{"r":[{"a/b":{"c":1.0}},{"x":null,"y":true}]}'))
    assert [(c[3], c[4], c[5], c[6]) for c in cells] == [("r.a/b.c", "/r/0/a~1b/c", "1", "double"), ("r.x", "/r/1/x", None, "null"), ("r.y", "/r/1/y", "true", "boolean")]
    for bad in (b'{"a":1,"a":2}', b"3", b"[]"):
        try:
            list(S.json_cells(bad))
            raise AssertionError("accepted")
        except ValueError:
            pass


def test_xlsx_round_trip():
    data = sinks.xlsx({"One": (["id", "name"], [[1, "=x"], [2.5, None]]), "Two": (["flag"], [[True]])})
    got = [(r[0], r[1], r[3], r[5], r[6]) for r in S.xlsx_cells(data)]
    assert got == [(0, 0, "id", "1", "bigint"), (0, 0, "name", "'=x", "string"), (0, 1, "id", "2.5", "double"), (0, 1, "name", None, "null"), (1, 0, "flag", "true", "boolean")]


def test_office_round_trip():
    text = "Naïve {x} \\ 日本\n\nline\ttwo 😀"
    assert office.rtf_text(office.to_rtf(text)) == text
    assert office.rtf_text(rb"{\rtf1\ansi{\fonttbl Arial;}{\*\secret hide}A\'e9\par B}") == "Aé\nB"
    data = office.to_docx("Name: Asha\nsecond")
    assert office.docx_text(data) == "Name: Asha\nsecond"
    assert office.docx_text(office.replace_docx(data, [("Asha", "[P]")])) == "Name: [P]\nsecond"


def test_cells_frame(spark):
    df = spark.createDataFrame([(1, "a.csv", bytearray(b"x,y\n1,2\n")), (2, "b.json", bytearray(b"{")), (3, "c", bytearray(b'[{"k":1}]'))], "doc_id bigint, name string, content binary")
    got = S.cells(df)
    assert got.filter("error is not null").count() == 1 and got.filter("error is null").count() == 3
    assert S.summary(got).count() == 2
    texts = office.texts(spark.createDataFrame([(1, "a.rtf", bytearray(office.to_rtf("hi"))), (2, "b.docx", bytearray(b"x"))], "doc_id bigint, name string, content binary")).collect()
    assert texts[0].text == "hi" and texts[1].error


def test_corpora(spark, tmp_path):
    p = tmp_path / "m.jsonl"
    p.write_text("\n".join([json.dumps({"source_text": "I am Asha", "language": "en", "privacy_mask": [{"label": "GIVENNAME_1", "start": 5, "end": 9, "value": "Asha"}]}), json.dumps({"unmasked_text": "call 123", "lang": "en", "span_labels": "[[5, 8, \"PHONENUMBER\"], [0, 4, \"ODD\"]]"}), "{broken"]))
    cases, gold, unmapped = corpora.masked_jsonl(spark, str(p))
    assert cases.count() == 2 and {(r.entity_type, r.value) for r in gold.collect()} == {("PERSON_NAME", "Asha"), ("PHONE", "123")} and unmapped.first().label == "ODD"
    q = tmp_path / "c.json"
    q.write_text(json.dumps({"cases": [{"id": "1", "domain": "d", "text": "ab ab ab", "entities": [["EMAIL", "ab", "3"], ["AGE", "zz"]]}]}))
    _, gold = corpora.curated(spark, str(q))
    assert [(r.char_start, r.char_end) for r in gold.collect()] == [(6, 8)]
    t = tmp_path / "t.jsonl"
    t.write_text("\n".join([json.dumps({"text": "x", "task_name": "a", "language": "en", "entities": []}), "nope"]))
    rows, counts = corpora.task_jsonl(spark, str(t), task="a")
    assert rows.count() == 1 and {r.good: r["count"] for r in counts.collect()} == {True: 1, False: 1}
    csv = str(tmp_path / "out")
    sinks.write_csv(spark.createDataFrame([("=1", 2)], "a string, b int"), csv)
    assert spark.read.option("header", True).csv(csv).first().a == "'=1"
