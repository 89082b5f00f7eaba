"""Sheets, word documents, Avro containers; what needs a library says so; names from a recognizer."""

import json
import struct
import zipfile
import zlib

import pytest
from pyspark.sql import functions as F

from veilwright.operators import report
from veilwright.operators.detect import add_entities, detect
from veilwright.sources import documents, readers


def workbook(path):
    with zipfile.ZipFile(path, "w") as z:
        z.writestr("xl/workbook.xml", '<workbook xmlns="m" xmlns:r="r"><sheets><sheet name="People" sheetId="1" r:id="rId1"/></sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", '<Relationships xmlns="p"><Relationship Id="rId1" Target="worksheets/sheet1.xml"/></Relationships>')
        z.writestr("xl/sharedStrings.xml", '<sst xmlns="m"><si><t>mail</t></si><si><r><t>a@</t></r><r><t>b.co</t></r></si></sst>')
        z.writestr("xl/worksheets/sheet1.xml", '<worksheet xmlns="m"><sheetData><row r="1"><c r="A1" t="s"><v>0</v></c><c r="C1"><v>12.5</v></c></row><row r="2"><c r="A2" t="s"><v>1</v></c><c r="B2" t="inlineStr"><is><t>1.2.3.4</t></is></c><c r="D2" t="b"><v>1</v></c></row></sheetData></worksheet>')


def word(path):
    p = lambda t: f"<w:p><w:r><w:t>{t}</w:t></w:r></w:p>"
    with zipfile.ZipFile(path, "w") as z:
        z.writestr("word/document.xml", f'<w:document xmlns:w="w"><w:body>{p("mail a@b.co")}{p(" ")}<w:tbl><w:tr><w:tc>{p("x")}</w:tc><w:tc>{p("1.2.3.4")}</w:tc></w:tr></w:tbl>{p("end")}</w:body></w:document>')


def long(n):
    n, out = (n << 1) ^ (n >> 63), b""
    while True:
        out += bytes([n & 127 | (128 if n > 127 else 0)])
        n >>= 7
        if not n:
            return out


def container(path, codec):
    schema = {"type": "record", "name": "r", "fields": [{"name": "id", "type": "long"}, {"name": "mail", "type": ["null", "string"]}, {"name": "tags", "type": {"type": "array", "items": "string"}}, {"name": "x", "type": "double"}, {"name": "m", "type": {"type": "map", "values": {"type": "enum", "name": "e", "symbols": ["A", "B"]}}}]}
    text = lambda t: long(len(t.encode())) + t.encode()
    one = long(-70) + long(1) + text("a@b.co") + long(2) + text("t1") + text("t2") + long(0) + struct.pack("<d", 0.5) + long(1) + text("k") + long(1) + long(0)
    two = long(300) + long(0) + long(0) + struct.pack("<d", 2.0) + long(0)
    body = one + two
    body = zlib.compress(body)[2:-4] if codec == "deflate" else body
    sync = b"s" * 16
    meta = long(2) + text("avro.schema") + text(json.dumps(schema)) + text("avro.codec") + text(codec) + long(0)
    path.write_bytes(b"Obj\1" + meta + sync + long(2) + long(len(body)) + body + sync)


def test_kinds(spark, tmp_path):
    workbook(tmp_path / "a.xlsx")
    word(tmp_path / "b.docx")
    container(tmp_path / "c.avro", "null")
    container(tmp_path / "d.avro", "deflate")
    rows = lambda kind, name: [(r.label, r.text, r.unit) for r in documents.extracted(spark, str(tmp_path / name), kind).orderBy("at").collect()]
    assert rows("xlsx", "a.xlsx") == [("People!0", "mail", 1), ("People!2", "12.5", 0), ("People!0", "a@b.co", 1), ("People!1", "1.2.3.4", 0), ("People!3", "True", 0)]
    assert rows("docx", "b.docx") == [("para0", "mail a@b.co", 1), ("para2", "end", 1), ("table0r0c0", "x", 1), ("table0r0c1", "1.2.3.4", 1)]
    want = [("id", "-70", 1), ("mail", "a@b.co", 0), ("tags", "['t1', 't2']", 0), ("x", "0.5", 0), ("m", "{'k': 'B'}", 0), ("id", "300", 1), ("tags", "[]", 0), ("x", "2.0", 0), ("m", "{}", 0)]
    assert rows("avro", "c.avro") == rows("avro", "d.avro") == want
    (tmp_path / "e.avro").write_bytes(b"broken")
    found = readers.scan(spark, str(tmp_path), regions="TR")
    scores = {r.file.rsplit("/", 1)[-1]: (r.units, r["count"]) for r in report.file_scores(found).collect()}
    assert scores == {"a.xlsx": (2, 2), "b.docx": (4, 2), "c.avro": (2, 1), "d.avro": (2, 1)}
    with pytest.raises(Exception, match="no Avro container"):
        documents.extracted(spark, str(tmp_path / "e.avro"), "avro").count()


def test_missing_libraries_are_named(spark, tmp_path):
    for name, library in (("a.pdf", "pypdf"), ("b.png", "pytesseract")):
        if not readers.capabilities()[name[2:]]:
            (tmp_path / name).write_bytes(b"x")
            with pytest.raises(Exception, match=f"needs {library}"):
                readers.scan(spark, str(tmp_path / name)).count()


def test_names_of_a_recognizer(spark):
    frame = spark.createDataFrame([("Ann a@b.co Bo",), (None,)], "text string").withColumn("detections", detect(F.col("text"), types=["EMAIL"]))
    assert add_entities(frame, None) is frame

    def names(texts):
        return [[("PER", 0, 3, 0.9), ("PER", 5, 7, 0.99), ("PER", 11, 13, 0.8)] if t else [] for t in texts]

    rows = add_entities(frame, names).collect()
    assert [(d.type, d.value) for d in rows[0].detections] == [("PER", "Ann"), ("EMAIL", "a@b.co"), ("PER", "Bo")] and rows[1].detections == []
