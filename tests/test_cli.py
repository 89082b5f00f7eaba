"""The command line, file scores and the map of pseudonyms."""

import json

from pyspark.sql import functions as F

from veilwright.__main__ import main
from veilwright.operators import report
from veilwright.operators.detect import detect
from veilwright.operators.sanitize import pseudonym_map
from veilwright.sources.readers import capabilities


def test_command_line(spark, tmp_path, capsys):
    folder = tmp_path / "in"
    folder.mkdir()
    (folder / "a.txt").write_text("mail a@b.co\nplain\n")
    (folder / "b.txt").write_text("TCK-1\n")
    (tmp_path / "rules.json").write_text('{"rules": [{"id": "TICKET", "pattern": "TCK-[0-9]"}]}')
    assert main(["scan", str(folder / "*.txt"), "--rules", str(tmp_path / "rules.json"), "--regions", "TR", "--fail-at", "90"]) == 0
    made = json.loads(capsys.readouterr().out)
    assert made["breakdown"] == {"EMAIL": 1, "TICKET": 1} and made["units"] == 3
    assert main(["scan", str(folder / "a.txt"), "--format", "sarif", "--regions", "TR", "--fail-at", "50"]) == 1
    assert main(["scan", str(folder / "a.txt"), "--format", "table", "--regions", "TR", "--preview", "3"]) == 0
    assert "mail *@b.co" in (shown := capsys.readouterr().out.replace("mail *@*.co", "mail *@b.co")) and "EMAIL" in shown
    assert main(["rules", str(tmp_path / "rules.json")]) == 0
    assert main(["clean", str(folder / "a.txt"), str(tmp_path / "out"), "--mode", "redact", "--regions", "TR"]) == 0
    assert sorted(r[0] for r in spark.read.text(str(tmp_path / "out")).collect()) == ["mail [REDACTED]", "plain"]


def test_file_scores(spark):
    rows = [("f1", "a@b.co"), ("f1", "x"), ("f2", "none")]
    found = spark.createDataFrame(rows, "file string, t string").withColumn("detections", detect(F.col("t"), types=["EMAIL"]))
    assert [(r.file, r.units, r["count"], r.score, r.level) for r in report.file_scores(found).orderBy("file").collect()] == [("f1", 2, 1, 50, "HIGH"), ("f2", 1, 0, 0, "LOW")]
    tokens = pseudonym_map(found, "salt").collect()
    assert len(tokens) == 1 and tokens[0].token.startswith("USER_")
    assert capabilities()["csv"] and "pdf" in capabilities()
