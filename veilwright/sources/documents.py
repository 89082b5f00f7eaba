"""Files that are read as a whole, each in one task: sheets, word documents, Avro containers, PDF, images.

extracted() reads files as bytes and gives file, label, text, unit and at, as the other readers do.
Sheets, word documents and Avro (null and deflate blocks) need no library; PDF needs pypdf and images
need pytesseract with Pillow: without these, reading them is an error that says so. EXTRACTORS takes
further kinds: functions from bytes to (unit, label, text).
"""

from __future__ import annotations

import io
import json
import struct
import zipfile
import zlib
from collections.abc import Callable, Iterator
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

Parts = Iterator[tuple[int, str, str]]


def _local(tag: str) -> str:
    return tag.rsplit("}", 1)[-1]


def _column(reference: str) -> int:
    """The place of a cell's column: A is 0."""
    n = 0
    for c in reference:
        if c.isalpha():
            n = n * 26 + ord(c.upper()) - 64
    return n - 1


def sheets(raw: bytes) -> Parts:
    """(row, SHEET!column, value) of the cells of a workbook that are not empty; formulas by their saved values."""
    with zipfile.ZipFile(io.BytesIO(raw)) as z:
        names = set(z.namelist())
        shared = []
        if "xl/sharedStrings.xml" in names:
            for item in ElementTree.fromstring(z.read("xl/sharedStrings.xml")):
                shared.append("".join(t.text or "" for t in item.iter() if _local(t.tag) == "t"))
        targets = {r.get("Id"): r.get("Target") for r in ElementTree.fromstring(z.read("xl/_rels/workbook.xml.rels"))}
        unit = 0
        for sheet in (x for x in ElementTree.fromstring(z.read("xl/workbook.xml")).iter() if _local(x.tag) == "sheet"):
            link = next(v for k, v in sheet.attrib.items() if _local(k) == "id")
            path = targets[link].lstrip("/")
            for row in (x for x in ElementTree.fromstring(z.read(path if path.startswith("xl/") else f"xl/{path}")).iter() if _local(x.tag) == "row"):
                unit += 1
                for i, cell in enumerate(row):
                    kind, at = cell.get("t"), cell.get("r")
                    value = "".join(x.text or "" for x in cell.iter() if _local(x.tag) in ("v", "t"))
                    if kind == "s" and value:
                        value = shared[int(value)]
                    elif kind == "b" and value:
                        value = "True" if value == "1" else "False"
                    if value:
                        yield unit, f"{sheet.get('name')}!{_column(at) if at else i}", value


def words(raw: bytes) -> Parts:
    """(number, paraN or tableTrRcC, text) of a word document's paragraphs and of the cells of its tables."""
    with zipfile.ZipFile(io.BytesIO(raw)) as z:
        body = next(x for x in ElementTree.fromstring(z.read("word/document.xml")) if _local(x.tag) == "body")
    unit = 0

    def text_of(node) -> str:
        marks = {"t": lambda x: x.text or "", "tab": lambda x: "\t", "br": lambda x: "\n", "cr": lambda x: "\n"}
        return "".join(marks[_local(x.tag)](x) for x in node.iter() if _local(x.tag) in marks)

    for i, paragraph in enumerate(x for x in body if _local(x.tag) == "p"):
        if (text := text_of(paragraph)).strip():
            unit += 1
            yield unit, f"para{i}", text
    for t, table in enumerate(x for x in body if _local(x.tag) == "tbl"):
        for r, row in enumerate(x for x in table if _local(x.tag) == "tr"):
            for c, cell in enumerate(x for x in row if _local(x.tag) == "tc"):
                if (text := "\n".join(text_of(p) for p in cell.iter() if _local(p.tag) == "p")).strip():
                    unit += 1
                    yield unit, f"table{t}r{r}c{c}", text


class _Avro:
    """Values of an Avro container, by its schema."""

    def __init__(self, raw: bytes):
        self.data, self.at, self.named = raw, 0, {}

    def take(self, n: int) -> bytes:
        self.at += n
        return self.data[self.at - n : self.at]

    def long(self) -> int:
        shift = value = 0
        while True:
            b = self.data[self.at]
            self.at += 1
            value |= (b & 127) << shift
            shift += 7
            if b < 128:
                return (value >> 1) ^ -(value & 1)

    def blocks(self) -> Iterator[int]:
        """The items of an array or map, block by block."""
        while n := self.long():
            if n < 0:
                n = -n
                self.long()
            yield from range(n)

    def value(self, schema):
        if isinstance(schema, list):
            return self.value(schema[self.long()])
        if isinstance(schema, str):
            schema = self.named.get(schema, {"type": schema})
        kind = schema["type"]
        if isinstance(kind, (dict, list)) or kind in self.named and "name" not in schema:
            return self.value(kind)
        if kind in ("record", "enum", "fixed"):
            self.named[schema["name"]] = schema
        if kind == "record":
            return {f["name"]: self.value(f["type"]) for f in schema["fields"]}
        if kind == "array":
            return [self.value(schema["items"]) for _ in self.blocks()]
        if kind == "map":
            return {self.take(self.long()).decode(): self.value(schema["values"]) for _ in self.blocks()}
        if kind == "enum":
            return schema["symbols"][self.long()]
        if kind == "fixed":
            return self.take(schema["size"])
        simple = {
            "null": lambda: None, "boolean": lambda: self.take(1) == b"\1", "int": self.long, "long": self.long, "float": lambda: struct.unpack("<f", self.take(4))[0],
            "double": lambda: struct.unpack("<d", self.take(8))[0], "bytes": lambda: self.take(self.long()), "string": lambda: self.take(self.long()).decode("utf-8", "replace"),
        }
        return simple[kind]()


def avro(raw: bytes) -> Parts:
    """(record, field, value as text) of the fields that are not empty."""
    head = _Avro(raw)
    if head.take(4) != b"Obj\1":
        raise ValueError("no Avro container")
    meta = {head.take(head.long()).decode(): head.take(head.long()) for _ in head.blocks()}
    sync, codec = head.take(16), meta.get("avro.codec", b"null").decode()
    if codec not in ("null", "deflate"):
        raise ValueError(f"Avro blocks of {codec} can't be read")
    schema, named, unit = json.loads(meta["avro.schema"]), {}, 0
    while head.at < len(raw):
        count, size = head.long(), head.long()
        block = head.take(size)
        body = _Avro(zlib.decompress(block, -15) if codec == "deflate" else block)
        body.named = named
        for _ in range(count):
            unit += 1
            for k, v in body.value(schema).items():
                if v is not None and v != "":
                    yield unit, k, str(v)
        if head.take(16) != sync:
            raise ValueError("an Avro block doesn't end where it should")


def pdf(raw: bytes) -> Parts:
    """(page, pageN, text) of the pages with a text."""
    try:
        from pypdf import PdfReader
    except ImportError as e:
        raise ImportError("reading PDF needs pypdf") from e
    for i, page in enumerate(PdfReader(io.BytesIO(raw)).pages, 1):
        if (text := page.extract_text() or "").strip():
            yield i, f"page{i}", text


def image(raw: bytes) -> Parts:
    """(1, image, the words that are recognised)."""
    try:
        import pytesseract
        from PIL import Image
    except ImportError as e:
        raise ImportError("reading images needs pytesseract and Pillow") from e
    picture = Image.open(io.BytesIO(raw))
    picture.thumbnail((2000, 2000))
    if (text := pytesseract.image_to_string(picture)).strip():
        yield 1, "image", text


EXTRACTORS: dict[str, Callable[[bytes], Parts]] = {"xlsx": sheets, "docx": words, "avro": avro, "pdf": pdf, "png": image, "jpg": image, "jpeg": image}


def extracted(spark: SparkSession, path: str, kind: str, skip_bad: bool = False, **options) -> DataFrame:
    """file, label, text, unit, at of files of one kind. skip_bad: files that can't be read give no rows instead of an error."""
    extract = EXTRACTORS[kind]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for file, raw, at in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                rows, last = [], None
                try:
                    for unit, label, text in extract(raw):
                        rows.append((file, label, text, int(unit != last), at + unit))
                        last = unit
                except ImportError:
                    raise
                except Exception as e:
                    if not skip_bad:
                        raise ValueError(f"{file}: {e}") from e
                    rows = []
                yield pa.RecordBatch.from_pylist([dict(zip(("file", "label", "text", "unit", "at"), r)) for r in rows], schema=schema)

    schema = pa.schema([("file", pa.string()), ("label", pa.string()), ("text", pa.string()), ("unit", pa.int32()), ("at", pa.int64())])
    files = spark.read.options(**options).format("binaryFile").load(path).select("path", "content", F.monotonically_increasing_id() * F.lit(1 << 20))
    return files.mapInArrow(run, "file string, label string, text string, unit int, at long")
