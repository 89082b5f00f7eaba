"""Lines that many documents repeat, found with two Bloom filters and confirmed exactly.

A line's key is the line without white space at its ends, A-Z lower-cased. Keys of at least
`min_chars` code points found in at least `min_docs` documents lose their lines in all documents
but the last one (the greatest document id) that holds them. Each row is a document; a null id is
below all others.

The filters' size follows from a count of the long lines: LINE_BITS for each, rounded up to a power
of two, so that about 2 % of the keys seen once are suspected. From MAX_BITS / LINE_BITS long lines
on (2^27) the filters fill up and more and more keys are suspected, until all are counted by their
digests: the result is the same, and what is shuffled stays under 24 bytes a line.

One pass over the texts sets, in a filter of once-seen and a filter of twice-seen hashes, the
bits of each document's distinct keys. Tasks send the filters in segments, which meet by number:
what is in two tasks' once-seen filters becomes twice-seen. In a second pass only keys that the
twice-seen filter holds, the suspects, leave their task, as a 128-bit hash with the document's
id. Counting those by the whole hash confirms them, so the filters' size decides only how many suspects there are. The
keys that really repeat are sent to all tasks while there are at most `max_shipped`; more of them
are joined with the suspects, and only what each document loses goes back to its text.

Null and empty texts are one empty line. An empty table gives none. Repeated rows are documents of
their own; rows of one id are no tie: lines stay in all rows of the greatest id. Very long texts
are split whole. Other columns pass through, whatever their names; those named as results are
replaced.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator
from typing import Any

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veilwright.llm._common import BLANKS, LOWER, UPPER, cut, map_rows, packed, release, table, unpacked

MIN_CHARS = 40
MIN_DOCS = 5
#: Bits of a filter for each long line, and the least and most bits of a filter (128 KB, 128 MB).
#: A task holds two filters while it fills them and one, which is also the broadcast, to look up.
LINE_BITS, LEAST_BITS, MAX_BITS = 8, 1 << 20, 1 << 30
SEGMENTS = 256
PROBES = 4
#: Repeated keys up to which they are sent to all tasks (about 60 bytes each).
MAX_SHIPPED = 500_000
#: For the id of a row without one.
NO_ID = -(1 << 63)


def keys_of(text: str | None, min_chars: int) -> dict[bytes, list[int]]:
    """The hashes of a text's long keys, with the places of their lines; bytes.lower() knows A-Z alone."""
    from xxhash import xxh3_128_digest as digest

    found: dict[bytes, list[int]] = {}
    for i, line in enumerate((text or "").split("\n")):
        if len(line) >= min_chars and len(line := line.strip(BLANKS)) >= min_chars:
            found.setdefault(digest(line.encode("utf-8", "surrogatepass").lower()), []).append(i)
    return found


def _bits(digests: list[bytes], bits: int):
    """A row of bit places for each digest; all of a digest's places are in one segment."""
    import numpy as np

    h = np.frombuffer(b"".join(digests), np.uint32).reshape(-1, 4).astype(np.int64)
    size = bits // SEGMENTS
    within = np.stack([(h[:, 1] + i * (h[:, 2] | 1)) % size for i in range(PROBES)], axis=1)
    return (h[:, 0] % SEGMENTS)[:, None] * size + within


def _hold(filter_, at):
    """For each row of bit places whether the filter (bytes) has all of them."""
    import numpy as np

    return ((filter_[at >> 3] >> (at & 7).astype(np.uint8)) & 1).all(axis=1)


def _set(filter_, at) -> None:
    """Sets bit places of the filter (bytes)."""
    import numpy as np

    at = np.sort(at, axis=None)
    if len(at):
        byte = at >> 3
        first = np.concatenate([[0], np.nonzero(np.diff(byte))[0] + 1])
        filter_[byte[first]] |= np.bitwise_or.reduceat((1 << (at & 7)).astype(np.uint8), first)


def filter_bits(docs: DataFrame, text: str, min_chars: int) -> int:
    """The filters' size for the long lines of the documents."""
    long = F.filter(F.split(text, "\n"), lambda x: F.char_length(x) >= min_chars)
    n = docs.agg(F.sum(F.coalesce(F.size(long), F.lit(0)).cast("long"))).first()[0] or 0
    return min(MAX_BITS, max(LEAST_BITS, 1 << (n * LINE_BITS - 1).bit_length() if n else 0))


def twice_seen(docs: DataFrame, text: str, min_chars: int, bits: int):
    """The twice-seen filter of all documents, as bytes."""
    import numpy as np

    size = bits // SEGMENTS // 8

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        once, twice, any_ = np.zeros(bits // 8, np.uint8), np.zeros(bits // 8, np.uint8), False
        for batch in batches:
            counts = Counter()
            for t in batch.column(0):
                counts.update(keys_of(t.as_py(), min_chars).keys())
            if counts:
                any_ = True
                at = _bits(list(counts), bits)
                seen = _hold(once, at) | (np.fromiter(counts.values(), np.int64, len(counts)) > 1)
                _set(twice, at[seen])
                _set(once, at)
        if any_:
            for s in range(SEGMENTS):
                a, b = (x[s * size : (s + 1) * size] for x in (once, twice))
                if a.any():
                    yield pa.RecordBatch.from_arrays([pa.array([s], pa.int32()), *(pa.array([zlib.compress(x.tobytes(), 1)], pa.binary()) for x in (a, b))], names=["segment", "once", "twice"])
        del once, twice
        release()

    def merge(key: tuple[Any, ...], rows: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        once, twice = np.zeros(size, np.uint8), np.zeros(size, np.uint8)
        for frame in rows:
            for a, b in zip(frame["once"], frame["twice"], strict=True):
                a, b = (np.frombuffer(zlib.decompress(x), np.uint8) for x in (a, b))
                twice |= b | (once & a)
                once |= a
        yield pd.DataFrame({"segment": [key[0]], "twice": [zlib.compress(twice.tobytes(), 1)]})

    parts = docs.select(text).mapInArrow(fill, "segment int, once binary, twice binary")
    merged = parts.groupBy("segment").applyInPandas(merge, "segment int, twice binary")
    whole = bytearray(bits // 8)
    for r in merged.toLocalIterator():
        whole[r["segment"] * size : (r["segment"] + 1) * size] = zlib.decompress(bytes(r["twice"]))
    return bytes(whole)


def repeated_lines(docs: DataFrame, min_chars: int, min_docs: int, bits: int) -> tuple[DataFrame, DataFrame]:
    """suspects(key, id, text) and repeated(key, last) of documents (_id, _text, _same: the text's hash), each row a document."""
    import numpy as np

    packed = docs.sparkSession.sparkContext.broadcast(twice_seen(docs, "_text", min_chars, bits))

    def suspects(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        filter_ = np.frombuffer(packed.value, np.uint8)
        for batch in batches:
            keys, ids, same = [], [], []
            for i, x, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
                found = keys_of(t.as_py(), min_chars)
                keys += found
                ids += [i] * len(found)
                same += [x] * len(found)
            if keys:
                places = pa.array(np.nonzero(_hold(filter_, _bits(keys, bits)))[0], pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()).take(places), *(pa.array(x, pa.int64()).take(places) for x in (ids, same))], names=["key", "id", "same"])
        release()

    found = docs.select(F.coalesce("_id", F.lit(NO_ID)), "_same", "_text").mapInArrow(suspects, "key binary, id long, same long")
    repeated = found.groupBy("key").agg(F.count("*").alias("n"), F.max("id").alias("last")).filter(F.col("n") >= min_docs).select("key", "last")
    return found, cut(repeated)


def _apply(text: str | None, lost: set[int]) -> tuple[int, int, str]:
    lines = (text or "").split("\n")
    if not lost:
        return len(lines), 0, text or ""
    return len(lines), len(lost), "\n".join(x for i, x in enumerate(lines) if i not in lost)


ADDED = pa.schema([("n_lines", pa.int64()), ("n_dropped", pa.int64()), ("kept_text", pa.string())])
TYPES = "n_lines long, n_dropped long, kept_text string"


def dedup_lines(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS, bits: int | None = None, max_shipped: int = MAX_SHIPPED) -> DataFrame:
    """All columns of each row with n_lines, n_dropped and kept_text (the lines that stay). bits: of a filter, instead of what the count says."""
    own = [c for c in docs.columns if c not in ADDED.names]
    rows = docs.select(packed(docs, own), F.col(doc_id).cast("long").alias("_id"), F.col(text).alias("_text"), F.xxhash64(F.col(text)).alias("_same"))
    suspects, repeated = repeated_lines(rows, min_chars, min_docs, bits or filter_bits(rows, "_text", min_chars))
    held = repeated.limit(max_shipped + 1).collect()
    columns = [*unpacked(own), *ADDED.names]
    if len(held) <= max_shipped:
        shipped = docs.sparkSession.sparkContext.broadcast({bytes(r["key"]): r["last"] for r in held})

        def make():
            last = shipped.value

            def f(i, t):
                i = NO_ID if i is None else i
                return _apply(t, {p for k, at in keys_of(t, min_chars).items() if last.get(k, i) != i for p in at} if last else set())

            return f

        return map_rows(rows, ["_id", "_text"], ADDED, TYPES, make, drop=("_id", "_text", "_same")).select(*columns)

    # what each text of each id loses goes to its rows, where the keys are looked for again: equal rows have one entry
    lost = suspects.join(repeated, "key").filter("id <> last").groupBy("id", "same").agg(F.collect_set("key").alias("_lost"))
    joined = rows.join(lost, (F.coalesce("_id", F.lit(NO_ID)) == F.col("id")) & (F.col("_same") == F.col("same")), "left").drop("id", "same")

    def make_joined():
        def f(gone, t):
            gone = set(gone or ())
            return _apply(t, {p for k, at in keys_of(t, min_chars).items() if k in gone for p in at} if gone else set())

        return f

    return map_rows(joined, ["_lost", "_text"], ADDED, TYPES, make_joined, drop=("_id", "_text", "_same", "_lost")).select(*columns)


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return dedup_lines(docs).select("doc_id", "n_lines", "n_dropped", F.sha2("kept_text", 256).alias("kept_sha256"))


def lines_sql(docs: str) -> str:
    """Common table expressions ending in kept(doc_id, n_lines, n_dropped, text)."""
    chars = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
    return f"""
    line AS (SELECT doc_id, i, l[i] AS s, translate(trim(l[i], {chars}), '{UPPER}', '{LOWER}') AS k
             FROM (SELECT doc_id, l, unnest(range(1, len(l) + 1)) AS i FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS l FROM {docs}))),
    often AS (SELECT k, max(doc_id) AS last FROM line WHERE length(k) >= {MIN_CHARS} GROUP BY k HAVING count(DISTINCT doc_id) >= {MIN_DOCS}),
    marked AS (SELECT line.*, often.last IS NOT NULL AND often.last <> doc_id AS gone FROM line LEFT JOIN often ON often.k = line.k),
    kept AS (SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped, coalesce(string_agg(s, chr(10) ORDER BY i) FILTER (NOT gone), '') AS text FROM marked GROUP BY doc_id)"""


SQL = {"op8_line_dedup": f"WITH {lines_sql('documents')} SELECT doc_id, n_lines, n_dropped, sha256(text) AS kept_sha256 FROM kept"}
QUERIES = {"op8_line_dedup": op8_line_dedup}
