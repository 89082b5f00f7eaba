"""Reading in splits, mixed folders, units, limits, reports from one pass, SQL functions."""

import json
import random

import pytest
from pyspark.sql import functions as F

from veilwright.operators import report
from veilwright.operators.detect import detector_catalog, register
from veilwright.sources import readers


@pytest.fixture
def small_splits(spark):
    old = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    spark.conf.set("spark.sql.files.maxPartitionBytes", "500")
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    yield
    for k, v in old.items():
        spark.conf.set(k, v)


def test_line_numbers_over_splits(spark, tmp_path, small_splits):
    rng = random.Random(1)
    for name in ("a.txt", "b.log"):
        (tmp_path / name).write_text("﻿" + "\n".join(f"{name} {i} " + "x" * rng.randint(0, 90) for i in range(300)), encoding="utf-8")
    got = readers.lines(spark, str(tmp_path)).collect()
    assert spark.read.text(str(tmp_path)).rdd.getNumPartitions() > 20
    assert len(got) == 600
    for r in got:
        assert r.text.startswith(f"{r.file.rsplit('/', 1)[-1]} {r.line - 1} ")


def test_csv_is_split_only_without_quoted_breaks(spark, tmp_path, small_splits):
    (tmp_path / "a.csv").write_text("id,text\n" + "".join(f'{i},"says ""hi"", {i}"\n' for i in range(300)))
    plain = readers.read_csv(spark, str(tmp_path / "a.csv"))
    assert plain.rdd.getNumPartitions() > 5 and plain.filter(F.col("text") == F.concat(F.lit('says "hi", '), "id")).count() == 300
    (tmp_path / "b.csv").write_text("id,text\n" + "".join(f'{i},"two\nlines {i}"\n' for i in range(300)))
    assert readers.read_csv(spark, str(tmp_path / "b.csv")).filter(F.contains("text", F.lit("\n"))).count() == 300


def mixed(folder):
    (folder / "sub").mkdir()
    (folder / "a.csv").write_text("name,mail\nx,a@b.co\n,\ny,c@d.co\n")
    (folder / "sub" / "b.json").write_text(json.dumps([{"k": "e@f.co"}, {"k": 1}, {}]))
    (folder / "lines.json").write_text('{"k": "g@h.co"}\nnull\nnot json i@j.co\n')
    (folder / "c.TXT").write_text("one\nk@l.co\n")
    (folder / "README").write_text("m@n.co")
    (folder / "d.bin").write_bytes(b"\x00o@p.co")


def test_mixed_folder(spark, tmp_path):
    mixed(tmp_path)
    found, skipped = readers.scan_folder(spark, str(tmp_path))
    assert skipped == ["bin"]
    rows = found.collect()
    units = {}
    for r in rows:
        name = r.file.rsplit("/", 1)[-1]
        units[name] = units.get(name, 0) + r.unit
    assert units == {"a.csv": 3, "b.json": 3, "lines.json": 3, "c.TXT": 2, "README": 1}
    scanned = readers.scan(spark, str(tmp_path), regions="TR")
    scores = {r.file.rsplit("/", 1)[-1]: (r.units, r["count"]) for r in report.file_scores(scanned).collect()}
    assert scores == {"a.csv": (3, 2), "b.json": (3, 1), "lines.json": (3, 2), "c.TXT": (2, 1), "README": (1, 1)}
    only, _ = readers.scan_folder(spark, str(tmp_path), "*.csv")
    assert {r.file.rsplit("/", 1)[-1] for r in only.collect()} == {"a.csv"}
    with pytest.raises(ValueError):
        (tmp_path / "none").mkdir()
        (tmp_path / "none" / "x.bin").write_bytes(b"x")
        readers.scan(spark, str(tmp_path / "none"))


def test_report_from_one_pass(spark, tmp_path):
    (tmp_path / "a.txt").write_text("1.2.3.4\na@b.co c@d.co\nplain\n5.6.7.8\n")
    found = readers.scan(spark, str(tmp_path / "a.txt"), regions="TR")
    made = report.scan_report(found, "label", by_place=True, lines=[])
    assert made["units"] == 4 and list(made["breakdown"].items()) == [("IPV4", 2), ("EMAIL", 2)]
    assert made["compliance_summary"]["GDPR"] == 4 and made["risk_score"] == min(100, round((2 * 3 + 2 * 5) / 4 * 20))
    assert made["risk_level"] == report.risk_score(report.breakdown(found), 4).first()["level"]
    assert made["heatmap"] == [{"label": "Lines 1–200", "count": 4, "risk": 100}]
    assert "EMAIL" in report.to_text(made) and "EMAIL" in report.to_html(made) and not made["truncated"]
    limited = readers.scan(spark, str(tmp_path / "a.txt"), regions="TR", limit=2)
    assert report.scan_report(limited, "label")["units"] == 2
    assert readers.over_limit(spark, str(tmp_path / "a.txt"), 2) and not readers.over_limit(spark, str(tmp_path / "a.txt"), 4)
    empty = report.scan_report(found.filter("false"), "label")
    assert empty["units"] == empty["risk_score"] == 0 and empty["heatmap"] == []


def test_cleaning_counts(spark, tmp_path):
    (tmp_path / "a.csv").write_text("mail,note\na@b.co,x\n,\"1.2.3.4, c@d.co\"\n")
    assert readers.clean_csv(spark, str(tmp_path / "a.csv"), str(tmp_path / "out"), "redact", regions="TR") == {"units": 3, "detections": 3}
    got = spark.read.option("header", True).csv(str(tmp_path / "out")).collect()
    assert sorted(tuple(r) for r in got if r.mail) == [("[REDACTED]", "x")] and any(r.note == "[REDACTED], [REDACTED]" for r in got)
    (tmp_path / "a.txt").write_text("a@b.co\nplain\n")
    assert readers.clean_text(spark, str(tmp_path / "a.txt"), str(tmp_path / "out2"), "redact", regions="TR") == {"units": 2, "detections": 1}


def test_functions_of_sql(spark):
    names = register(spark)
    assert "is_valid_luhn" in names and "detect_values" in names
    row = spark.sql("SELECT is_valid_luhn('4539148803436467') AS a, is_valid_iban('DE89370400440532013001') AS b, is_valid_luhn(NULL) AS c, detect_values('mail a@b.co now') AS d").first()
    assert (row.a, row.b, row.c) == (True, False, False) and [(x.type, x.value, x.start) for x in row.d] == [("EMAIL", "a@b.co", 5)]


def test_catalog(spark):
    rows = detector_catalog(spark).collect()
    assert len(rows) == 80 and [r.type for r in rows] == sorted(r.type for r in rows)
    assert {r.type: r.description for r in rows}["EMAIL"] == "Email address"
