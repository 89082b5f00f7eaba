"""python -m veilwright scan PATH | clean SOURCE TARGET | rules FILE | detectors"""

from __future__ import annotations

import argparse
import sys


def main(args: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="veilwright")
    commands = parser.add_subparsers(dest="command", required=True)
    scan = commands.add_parser("scan", help="report what a file or folder holds")
    scan.add_argument("path")
    scan.add_argument("--regions", default="ALL")
    scan.add_argument("--rules", help="a JSON or YAML file of custom rules")
    scan.add_argument("--format", choices=["json", "sarif", "html", "table"], default="json")
    scan.add_argument("--preview", type=int, default=0, help="show so many lines with detections, sanitized")
    scan.add_argument("--mode", default="mask", help="how preview lines are sanitized")
    scan.add_argument("--limit", type=int, help="scan at most so many units")
    scan.add_argument("--fail-at", type=int, help="exit with 1 if a file's score reaches it")
    clean = commands.add_parser("clean", help="write a sanitized copy")
    clean.add_argument("source")
    clean.add_argument("target")
    clean.add_argument("--mode", default="mask")
    clean.add_argument("--salt")
    clean.add_argument("--regions", default="ALL")
    rules = commands.add_parser("rules", help="check a file of custom rules")
    rules.add_argument("file")
    commands.add_parser("detectors", help="list the detectors")
    given = parser.parse_args(args)

    from pyspark.sql import SparkSession
    from pyspark.sql import functions as F

    from veilwright.operators import report
    from veilwright.operators.detect import detect, detector_catalog
    from veilwright.operators.sanitize import new_salt, sanitize
    from veilwright.sources import readers

    spark = SparkSession.builder.getOrCreate()
    load = lambda path: readers.load_rules(spark.read.text(path, wholetext=True).first()[0])
    if given.command == "detectors":
        detector_catalog(spark).show(200, False)
    elif given.command == "rules":
        found, errors = load(given.file)
        print(f"{len(found)} rules", *errors, sep="\n")
        return int(bool(errors))
    elif given.command == "clean":
        write = readers.clean_csv if readers.extension_of(given.source) == "csv" else readers.clean_text
        print(write(spark, given.source, given.target, given.mode, given.salt or new_salt(), given.regions))
    else:
        found = readers.scan(spark, given.path, given.regions, load(given.rules)[0] if given.rules else (), given.limit)
        shown = None
        if given.preview:
            raw = readers.lines(spark, given.path).withColumn("detections", detect(F.col("text"), given.regions))
            shown = report.preview(raw, "text", "line", sanitize(F.col("text"), F.col("detections"), given.mode, new_salt()), given.preview).collect()
        made = report.scan_report(found, "label", lines=shown, truncated=given.limit is not None and readers.over_limit(spark, given.path, given.limit))
        print({"json": report.to_json, "sarif": lambda r: report.to_sarif(r, given.path, [x["line"] for x in r.get("preview", [])]), "html": report.to_html, "table": report.to_text}[given.format](made))
        if given.fail_at is not None:
            return int(not report.file_scores(found).filter(f"score >= {given.fail_at}").isEmpty())
    return 0


if __name__ == "__main__":
    sys.exit(main())
