"""Reading what is scanned: cells of tables, leaves of JSON, lines of texts; and writing the cleaned.

All give rows with a file, a label, a text, `unit` and `at`, so that a folder of files is one job.
A record, a JSON value of a list or line, and a line of a text is a unit; `unit` is 1 in the first of
its rows, and a unit with nothing to scan has one row without a text. `at` grows in the order of
reading. Files are split at lines wherever their format allows it.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from veilwright.operators.detect import CustomRule, check_rule, detect
from veilwright.operators.sanitize import let, sanitize
from veilwright.sources.documents import EXTRACTORS, extracted

EXTENSIONS = {"csv": "csv", "json": "json", "jsonl": "jsonl", "ndjson": "jsonl", "parquet": "parquet", "txt": "text", "log": "text", "md": "text", "sql": "text", **{x: x for x in EXTRACTORS}}
#: Bytes up to which a JSON file is read as one value; a larger one is read line by line.
JSON_WHOLE = 16 << 20
COLUMNS = ["file", "label", "text", "unit", "at"]


def extension_of(path: str) -> str:
    """The kind of a file by its name; one without an extension is a text."""
    name = path.rstrip("/").rsplit("/", 1)[-1]
    found = name.rsplit(".", 1)[1].lower() if "." in name else "txt"
    if found not in EXTENSIONS:
        raise ValueError(f"unknown extension {found!r}; there are {', '.join(EXTENSIONS)}")
    return EXTENSIONS[found]


def capabilities() -> dict[str, bool]:
    """Which optional readers could be used here: their libraries are looked for, not loaded."""
    from importlib.util import find_spec

    needs = {"pdf": "pypdf", "png": "pytesseract", "jpg": "pytesseract", "jpeg": "pytesseract", "ocr": "pytesseract", "ner": "onnxruntime", "yaml": "yaml"}
    return dict.fromkeys(sorted(set(EXTENSIONS.values())), True) | {k: find_spec(m) is not None for k, m in needs.items()}


def cells(frame: DataFrame, file: Column | None = None) -> DataFrame:
    """file, column, text, unit, at of all cells that are not empty; values that are no strings are cast."""
    own = [c for c in frame.columns if c != "_file"]
    pairs = F.array(*(F.struct(F.lit(c).alias("column"), F.col("`" + c.replace("`", "``") + "`").cast("string").alias("text")) for c in own))
    file = F.lit(None).cast("string") if file is None else file
    rows = frame.select(file.alias("file"), F.monotonically_increasing_id().alias("at"), F.filter(pairs, lambda x: F.coalesce(x["text"] != "", F.lit(False))).alias("c"))
    return rows.select("file", "at", F.posexplode_outer("c").alias("i", "x")).select("file", "x.column", "x.text", (F.coalesce("i", F.lit(0)) == 0).cast("int").alias("unit"), "at")


def read_csv(spark: SparkSession, path: str, **options) -> DataFrame:
    """All columns as strings; quoted line breaks are allowed, short rows are padded with nulls.

    Only where a line has an odd number of quotes can a line break be quoted: files of a path without
    such lines are split, others are read each as a whole.
    """
    quotes = F.char_length("value") - F.char_length(F.translate("value", '"', ""))
    whole = not spark.read.options(**options).text(path).filter(quotes % 2 == 1).isEmpty()
    frame = spark.read.options(**options).option("header", True).option("multiLine", whole).option("escape", '"').option("inferSchema", False).option("encoding", "UTF-8").csv(path)
    named = [F.col("`" + c.replace("`", "``") + "`").alias(c.removeprefix("\ufeff")) for c in frame.columns]
    return frame.select(*named, F.col("_metadata.file_path").alias("_file"))


def lines(spark: SparkSession, path: str, larger_than: int = -1, **options) -> DataFrame:
    """file, line (from 1), text, at of files with more bytes; files are read in splits.

    A line's number is its place in its split and the lines of the splits before, which a first
    pass counts.
    """
    raw = spark.read.options(**options).text(path).filter(F.col("_metadata.file_size") > larger_than).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("_block"), "value")
    raw = raw.withColumn("at", F.monotonically_increasing_id())
    counts = raw.groupBy("file", "_block").agg(F.count("*").alias("_n"), F.min("at").alias("_first"))
    from pyspark.sql import Window

    upto = F.sum("_n").over(Window.partitionBy("file").orderBy("_block"))
    starts = counts.select("file", "_block", (F.col("_first") - (upto - F.col("_n")) - 1).alias("_before"))
    numbered = raw.join(starts, ["file", "_block"]).withColumn("line", F.col("at") - F.col("_before"))
    text = F.when(F.col("line") == 1, F.regexp_replace("value", "^\ufeff", "")).otherwise(F.col("value"))
    return numbered.select("file", "line", text.alias("text"), "at")


def json_leaves(frame: DataFrame, text: str, keep: list[str] | None = None, units: bool = False, records: bool = False) -> DataFrame:
    """path, text of the strings and numbers in JSON objects, dotted paths; list items are entered.

    Strings right in lists, booleans and nulls are no leaves. A text that is no JSON is one row
    with a null path. units: adds `unit`, 1 in the first row of each text; those without leaves have
    one row without a text. records: items of a list at the top are texts of their own, and so are
    the lines of a text that is no JSON or a null alone.
    """
    keep = keep or []
    added = [T.StructField("unit", T.IntegerType())] if units else []
    schema = T.StructType([*(frame.schema[k] for k in keep), T.StructField("path", T.StringType()), T.StructField("text", T.StringType()), *added])

    def walk(value, path):
        if isinstance(value, dict):
            for k, v in value.items():
                at = f"{path}.{k}" if path else str(k)
                if isinstance(v, (dict, list)):
                    yield from walk(v, at)
                elif isinstance(v, str) or isinstance(v, (int, float)) and not isinstance(v, bool):
                    yield at, str(v)
        elif isinstance(value, list):
            for v in value:
                if isinstance(v, (dict, list)):
                    yield from walk(v, path)

    def values_of(t, records=records):
        """The leaves of each value of a text."""
        import json

        try:
            value = json.loads(t)
            if value is not None or not records:
                return [list(walk(v, "")) for v in (value if records and isinstance(value, list) else [value])]
        except (ValueError, RecursionError):
            if not records:
                return [[(None, t)]]
        return [leaves for line in t.splitlines() if line.strip() for leaves in values_of(line, False)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, found, first = [], [], []
            for i, t in enumerate(batch.column(batch.schema.get_field_index(text)).to_pylist()):
                if not t or not t.strip():
                    continue
                for leaves in values_of(t):
                    leaves = leaves or ([(None, None)] if units else [])
                    rows += [i] * len(leaves)
                    found += leaves
                    first += [1, *[0] * (len(leaves) - 1)][: len(leaves)]
            take = pa.array(rows, pa.int64())
            more = [pa.array(first, pa.int32())] if units else []
            yield pa.RecordBatch.from_arrays([*(batch.column(batch.schema.get_field_index(k)).take(take) for k in keep), pa.array([p for p, _ in found], pa.string()), pa.array([x for _, x in found], pa.string()), *more], names=[f.name for f in schema.fields])

    return frame.select(*keep, text).mapInArrow(run, schema)


def _json(spark: SparkSession, path: str, **options) -> DataFrame:
    """Files up to JSON_WHOLE are one value, if they are one that is not null; all others are read line by line."""
    small = spark.read.options(**options).text(path, wholetext=True).filter(F.col("_metadata.file_size") <= JSON_WHOLE)
    small = small.select(F.col("_metadata.file_path").alias("file"), F.regexp_replace("value", "^\ufeff", "").alias("text")).withColumn("at", F.monotonically_increasing_id())
    return json_leaves(small, "text", ["file", "at"], units=True, records=True).unionByName(json_leaves(lines(spark, path, JSON_WHOLE, **options), "text", ["file", "at"], units=True))


def read_kind(spark: SparkSession, path: str, kind: str, **options) -> DataFrame:
    """file, label, text, unit, at of files of one kind."""
    from veilwright.operators.report import segments

    if kind == "csv":
        found = cells(read_csv(spark, path, **options), F.col("_file")).withColumnRenamed("column", "label")
    elif kind == "parquet":
        found = cells(spark.read.options(**options).parquet(path).withColumn("_file", F.col("_metadata.file_path")), F.col("_file")).withColumnRenamed("column", "label")
    elif kind == "json":
        found = _json(spark, path, **options).withColumnRenamed("path", "label")
    elif kind in EXTRACTORS:
        found = extracted(spark, path, kind, skip_bad="ignoreCorruptFiles" in options, **options)
    elif kind == "jsonl":
        found = json_leaves(lines(spark, path, **options), "text", ["file", "at"], units=True).withColumnRenamed("path", "label")
    else:
        found = segments(lines(spark, path, **options)).withColumnRenamed("segment", "label").withColumn("unit", F.lit(1))
    return found.select(*COLUMNS)


def kinds_in(spark: SparkSession, path: str, pattern: str = "*") -> tuple[dict[str, list[str]], list[str]]:
    """The extensions of a folder's files by kind, and those that no reader knows; contents are not read."""
    names = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select(F.substring_index("path", "/", -1).alias("name"))
    by_kind: dict[str, list[str]] = {}
    unknown = []
    ending = F.when(F.contains("name", F.lit(".")), F.substring_index("name", ".", -1)).otherwise(F.lit(""))
    for r in names.filter(F.rlike("name", F.lit(_as_regex(pattern)))).groupBy(ending.alias("x")).agg(F.count("*")).orderBy("x").collect():
        try:
            by_kind.setdefault(extension_of(f"x.{r['x']}" if r["x"] else "x"), []).append(r["x"])
        except ValueError:
            unknown.append(r["x"])
    return by_kind, unknown


def _as_regex(pattern: str) -> str:
    """A pattern of file names with * and ? as a regular expression."""
    return "^" + "".join(".*" if c == "*" else "." if c == "?" else "\\" + c if not c.isalnum() else c for c in pattern) + "$"


def scan_folder(spark: SparkSession, path: str, pattern: str = "*") -> tuple[DataFrame | None, list[str]]:
    """What read_kind() gives for all files of a folder and its folders, and the extensions that were skipped.

    Files of one kind are one scan. CSV files of a folder must have one header. Corrupt files are left out.
    """
    by_kind, unknown = kinds_in(spark, path, pattern)
    found = None
    for kind, endings in by_kind.items():
        glob = "{" + ",".join(f"*.{x}" if x else "*" for x in endings) + "}" if len(endings) > 1 else (f"*.{endings[0]}" if endings[0] else "*")
        options = {"recursiveFileLookup": "true", "pathGlobFilter": glob, "ignoreCorruptFiles": "true"}
        part = read_kind(spark, path, kind, **options)
        part = part.filter(F.rlike(F.substring_index("file", "/", -1), F.lit(_as_regex(pattern))))
        if "" in endings:
            known = F.rlike(F.substring_index("file", "/", -1), F.lit(r"\."))
            part = part.filter(~known | F.lower(F.substring_index("file", ".", -1)).isin(*[x.lower() for x in endings if x]))
        found = part if found is None else found.unionByName(part)
    return found, unknown


def scannable(spark: SparkSession, path: str) -> DataFrame:
    """file, label, text, unit, at of a file, pattern of files of one extension, or folder."""
    from pyspark.errors import AnalysisException

    name = path.rstrip("/").rsplit("/", 1)[-1]
    if "." in name and name.rsplit(".", 1)[1].lower() in EXTENSIONS:
        return read_kind(spark, path, extension_of(path))
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = at.getFileSystem(spark._jsc.hadoopConfiguration())
    if fs.exists(at) and fs.getFileStatus(at).isDirectory():
        found, unknown = scan_folder(spark, path)
        if found is None:
            raise ValueError(f"no file in {path} that a reader knows; skipped: {', '.join(unknown) or 'none'}")
        return found
    try:
        return read_kind(spark, path, extension_of(path))
    except AnalysisException as e:
        raise FileNotFoundError(path) from e


def scan(spark: SparkSession, path: str, regions="ALL", rules=(), limit: int | None = None) -> DataFrame:
    """scannable() with detections. limit: so many units in the order of reading; over_limit() tells whether there are more."""
    rows = scannable(spark, path)
    if limit is not None:
        rows = rows.join(F.broadcast(_first_units(rows, limit)), ["file", "at"], "left_semi")
    return rows.withColumn("detections", detect(F.col("text"), regions, rules=rules))


def _first_units(rows: DataFrame, limit: int) -> DataFrame:
    return rows.filter("unit = 1").select("file", "at").orderBy("file", "at").limit(limit)


def over_limit(spark: SparkSession, path: str, limit: int) -> bool:
    """Whether a path has more units than the limit."""
    return scannable(spark, path).filter("unit = 1").limit(limit + 1).count() > limit


def _cleaned(value: Column, mode: str, salt: str | None, regions) -> Column:
    """struct(text, n): the cleaned value and what was found in it."""
    made = let(value, lambda v: let(detect(v, regions), lambda d: F.struct(sanitize(v, d, mode, salt).alias("text"), F.size(d).cast("long").alias("n"))))
    return F.when(F.coalesce(value != "", F.lit(False)), made).otherwise(F.struct(value.alias("text"), F.lit(0).cast("long").alias("n")))


def clean_csv(spark: SparkSession, source: str, target: str, mode: str = "mask", salt: str | None = None, regions="ALL") -> dict[str, int]:
    """Cell by cell; the header stays as it is. Gives units (the header is one) and detections."""
    frame = read_csv(spark, source).drop("_file")
    seen = Observation()
    row = frame.select(F.transform(F.array(*(F.col("`" + c.replace("`", "``") + "`") for c in frame.columns)), lambda c: _cleaned(c, mode, salt, regions)).alias("c"))
    row = row.observe(seen, F.count(F.lit(1)).alias("units"), F.sum(F.aggregate("c", F.lit(0).cast("long"), lambda a, c: a + c["n"])).alias("detections"))
    done = row.select(*(F.get("c", F.lit(i))["text"].alias(c) for i, c in enumerate(frame.columns)))
    done.write.option("header", True).option("escape", '"').csv(target)
    return {"units": seen.get["units"] + 1, "detections": seen.get["detections"] or 0}


def clean_text(spark: SparkSession, source: str, target: str, mode: str = "mask", salt: str | None = None, regions="ALL") -> dict[str, int]:
    """Line by line. Gives units (lines) and detections."""
    seen = Observation()
    row = spark.read.text(source).select(_cleaned(F.col("value"), mode, salt, regions).alias("c"))
    row = row.observe(seen, F.count(F.lit(1)).alias("units"), F.sum("c.n").alias("detections"))
    row.select(F.col("c.text").alias("value")).write.text(target)
    return {"units": seen.get["units"], "detections": seen.get["detections"] or 0}


def load_rules(text: str) -> tuple[list[CustomRule], list[str]]:
    """The custom rules of a JSON or YAML text and what is wrong with others; of one id the last counts, at the first's place."""
    import json

    try:
        data = json.loads(text)
    except ValueError:
        import yaml

        data = yaml.safe_load(text)
    rules: dict[str, CustomRule] = {}
    errors = []
    for raw in data.get("rules", []) if isinstance(data, dict) else data or []:
        try:
            rule = CustomRule(str(raw["id"]), str(raw["pattern"]), float(raw.get("confidence", 0.9)), str(raw.get("region", "GLOBAL")), tuple(raw.get("compliance", ())), str(raw.get("description", "")))
            check_rule(rule)
        except (KeyError, TypeError, ValueError) as e:
            errors.append(str(e))
            continue
        rules[rule.id] = rule
    return list(rules.values()), errors
