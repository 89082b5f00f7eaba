"""Quality scores from random-indexing word vectors and a small calibrated network.

Every token (a run of word characters or of signs, in lower case) has a sparse random index
vector that follows from its hash. Over all documents, each token's neighbours' index vectors are
summed into its context vector. Tokens share `BUCKETS` rows by hash, so that the table's size is
fixed and it can be sent to all tasks: a row is the sum of the tokens that fall into it, the rare
ones in the shade of the frequent. The sums are of whole numbers: the result doesn't depend on their order. A document is the
mean and the spread of its tokens' unit vectors. A two-layer network learns the labels from at
most about `max_train` labelled documents, chosen by hash, and a temperature fitted on a part kept
from the training gives probabilities.

Null and empty texts are a document without tokens, which is scored too. Rows are scored one
by one; repeated rows get equal scores, very long texts are pooled whole, and an empty table gives
none. Labels that are null or belong to no row are unused; of repeated labels of a document the
greatest counts, of several texts under a labelled id the one with the least vector is learned from.
With fewer than two kinds of labels every score is the labels' mean, or 0.5 without any. Other
columns pass through, whatever their names; those named as results are replaced.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from typing import Any

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veilwright.llm._common import cut, packed, table, unpacked

BUCKETS = 1 << 14
DIMENSIONS = 32
#: Entries that are not zero in an index vector.
NONZERO = 2
SEGMENTS = 256
MAX_TRAIN = 20_000
HIDDEN = 32
EPOCHS = 60
THRESHOLD = 0.3
CHUNK = 1 << 20
SEEN_TOKENS = 300_000
FEATURES = 2 * DIMENSIONS
_TOKENS = re.compile(r"\w+|[^\w\s]+").findall


class Hasher:
    def __init__(self):
        import xxhash

        class Seen(dict):
            def __missing__(self, token, f=xxhash.xxh3_64_intdigest):
                if len(self) >= SEEN_TOKENS:
                    self.clear()
                h = self[token] = f(token.encode("utf-8", "replace"))
                return h

        self.seen = Seen()

    def __call__(self, text: str | None):
        tokens = _TOKENS((text or "").lower())
        return np.fromiter(map(self.seen.__getitem__, tokens), np.uint64, len(tokens))


def _rows(h):
    return (h % np.uint64(BUCKETS)).astype(np.int64)


def _neighbours(sums, runs: list) -> None:
    """Adds each token's neighbours' index vectors to its row of sums (flat); runs have no neighbours in common."""
    h = np.concatenate(runs)
    inside = np.ones(len(h) - 1)
    inside[np.cumsum([len(x) for x in runs[:-1]], dtype=np.int64) - 1] = 0
    rows = _rows(h) * DIMENSIONS
    at, weights = [], []
    for k in range(NONZERO):
        part = h >> np.uint64(20 + 12 * k)
        # each entry has dimensions of its own, so that none takes another back
        dim = (part % np.uint64(DIMENSIONS // NONZERO)).astype(np.int64) + k * (DIMENSIONS // NONZERO)
        sign = ((part >> np.uint64(8)) & np.uint64(1)).astype(np.float64) * 2 - 1
        at += [rows[:-1] + dim[1:], rows[1:] + dim[:-1]]
        weights += [sign[1:] * inside, sign[:-1] * inside]
    sums += np.bincount(np.concatenate(at), np.concatenate(weights), len(sums)).astype(np.int64)


def word_vectors(docs: DataFrame, text: str) -> Any:
    """The context vectors of all documents, one unit row for each bucket."""
    part = BUCKETS * DIMENSIONS // SEGMENTS

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, sums, held, count = Hasher(), np.zeros(BUCKETS * DIMENSIONS, np.int64), [], 0
        for batch in batches:
            for t in batch.column(0):
                h = hashes(t.as_py())
                if len(h) > 1:
                    for at in range(0, len(h), CHUNK):
                        held.append(h[at : at + CHUNK + 1])
                        count += len(held[-1])
                        if count >= CHUNK:
                            _neighbours(sums, held)
                            held, count = [], 0
        if held:
            _neighbours(sums, held)
        for s in range(SEGMENTS):
            piece = sums[s * part : (s + 1) * part]
            if piece.any():
                yield pa.RecordBatch.from_arrays([pa.array([s], pa.int32()), pa.array([zlib.compress(piece.tobytes(), 1)], pa.binary())], names=["segment", "sums"])

    def merge(key: tuple[Any, ...], rows: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros(part, np.int64)
        for frame in rows:
            for x in frame["sums"]:
                total += np.frombuffer(zlib.decompress(x), np.int64)
        yield pd.DataFrame({"segment": [key[0]], "sums": [total.tobytes()]})

    merged = docs.select(text).mapInArrow(gather, "segment int, sums binary").groupBy("segment").applyInPandas(merge, "segment int, sums binary")
    whole = np.zeros(BUCKETS * DIMENSIONS, np.int64)
    for r in merged.toLocalIterator():
        whole[r["segment"] * part : (r["segment"] + 1) * part] = np.frombuffer(bytes(r["sums"]), np.int64)
    v = whole.reshape(BUCKETS, DIMENSIONS).astype(np.float64)
    return (v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-9)).astype(np.float32)


def pooled(docs: DataFrame, text: str, vectors) -> DataFrame:
    """Replaces the text by the document's vector."""
    shared = docs.sparkSession.sparkContext.broadcast(vectors)
    others = [f for f in docs.schema.fields if f.name != text]
    import pyspark.sql.types as T

    schema = T.StructType([*others, T.StructField("vector", T.ArrayType(T.FloatType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, v = Hasher(), shared.value
        for batch in batches:
            place = batch.schema.get_field_index(text)
            out = np.zeros((batch.num_rows, FEATURES), np.float32)
            for i, t in enumerate(batch.column(place)):
                h = _rows(hashes(t.as_py()))
                if len(h):
                    n = np.bincount(h, minlength=BUCKETS) if len(h) > BUCKETS else None
                    if n is None:
                        own, n = np.unique(h, return_counts=True)
                    else:
                        own = np.nonzero(n)[0]
                        n = n[own]
                    w, x = n.astype(np.float32) / len(h), v[own]
                    mean = w @ x
                    out[i, :DIMENSIONS] = mean
                    out[i, DIMENSIONS:] = np.sqrt(np.maximum(w @ (x * x) - mean * mean, 0))
            vectors_ = pa.ListArray.from_arrays(pa.array(np.arange(0, batch.num_rows * FEATURES + 1, FEATURES, dtype=np.int32)), pa.array(out.ravel()))
            names = [f.name for f in others]
            yield pa.RecordBatch.from_arrays([*(batch.column(batch.schema.get_field_index(n)) for n in names), vectors_], names=[*names, "vector"])

    return docs.mapInArrow(run, schema)


class Network:
    """Standardised inputs, a hidden layer of rectified units, a logistic output with a temperature."""

    def __init__(self, x, y, seed: int = 7, hidden: int = HIDDEN, epochs: int = EPOCHS):
        rng = np.random.default_rng(seed)
        self.prior = float(y.mean()) if len(y) else 0.5
        self.constant = len(np.unique(y)) < 2
        if self.constant:
            return
        self.mean, self.scale = x.mean(0), x.std(0) + 1e-3
        order = rng.permutation(len(x))
        held, fit = order[: max(1, len(x) // 5)], order[max(1, len(x) // 5) :]
        z = self._standard(x)
        d = x.shape[1]
        self.w = [rng.normal(0, np.sqrt(2 / d), (d, hidden)), np.zeros(hidden), rng.normal(0, np.sqrt(1 / hidden), hidden), 0.0]
        m, s, step = [np.zeros_like(p) for p in self.w], [np.zeros_like(p) for p in self.w], 0
        for _ in range(epochs):
            rng.shuffle(fit)
            for at in range(0, len(fit), 128):
                rows = fit[at : at + 128]
                grads = self._gradients(z[rows], y[rows])
                step += 1
                for i, g in enumerate(grads):
                    m[i] = 0.9 * m[i] + 0.1 * g
                    s[i] = 0.999 * s[i] + 0.001 * g * g
                    self.w[i] = self.w[i] - 0.005 * (m[i] / (1 - 0.9**step)) / (np.sqrt(s[i] / (1 - 0.999**step)) + 1e-8)
        logits, target = self._logits(z[held]), y[held]
        grid = np.exp(np.linspace(np.log(0.25), np.log(8), 61))
        self.temperature = float(grid[np.argmin([np.mean(np.logaddexp(0, logits / t) - target * logits / t) for t in grid])])

    def _standard(self, x):
        return np.clip((x - self.mean) / self.scale, -8, 8)

    def _logits(self, z):
        return np.maximum(z @ self.w[0] + self.w[1], 0) @ self.w[2] + self.w[3]

    def _gradients(self, z, y):
        h = np.maximum(z @ self.w[0] + self.w[1], 0)
        e = (1 / (1 + np.exp(-np.clip(h @ self.w[2] + self.w[3], -40, 40))) - y) / len(y)
        back = np.outer(e, self.w[2]) * (h > 0)
        return [z.T @ back + 1e-4 * self.w[0], back.sum(0), h.T @ e + 1e-4 * self.w[2], e.sum()]

    def score(self, x):
        if self.constant:
            return np.full(len(x), self.prior)
        return 1 / (1 + np.exp(-np.clip(self._logits(self._standard(x)) / self.temperature, -40, 40)))


def held_out(doc_id: str = "doc_id"):
    """Rows whose labels are never learned from: crc32 of the id as text, by 5, leaves 0."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 5 == 0, F.lit(False))


def score_quality(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", label: str = "quality", max_train: int = MAX_TRAIN, threshold: float = THRESHOLD, keep: list[str] | None = None) -> DataFrame:
    """The columns `keep` (all, if None) of each row with held_out, score and predicted."""
    keep = [c for c in (docs.columns if keep is None else keep) if c not in ("held_out", "score", "predicted")]
    base = docs.select(packed(docs, keep), F.col(doc_id).alias("_id"), F.col(text).alias("_text"))
    rows = cut(pooled(base, "_text", word_vectors(docs, text)))
    known = labels.filter(F.col(label).isNotNull() & F.col(doc_id).isNotNull() & ~held_out(doc_id)).groupBy(F.col(doc_id).alias("_id")).agg(F.max(label).cast("double").alias("_y"))
    known = cut(known)
    share = min(1.0, max_train / max(1, known.count()))
    known = known.filter(F.pmod(F.xxhash64("_id"), F.lit(1 << 30)) < int(share * (1 << 30)))
    found = known.join(rows.select("_id", "vector"), "_id").groupBy("_id", "_y").agg(F.min("vector").alias("vector")).toPandas().sort_values("_id")
    x = np.array(found["vector"].tolist(), np.float64).reshape(-1, FEATURES)
    shared = docs.sparkSession.sparkContext.broadcast(Network(x, found["_y"].to_numpy(np.float64)))
    import pyspark.sql.types as T

    schema = T.StructType([rows.schema["_own"], T.StructField("_id", rows.schema["_id"].dataType), T.StructField("score", T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        network = shared.value
        for batch in batches:
            v = batch.column(batch.schema.get_field_index("vector"))
            s = network.score(np.asarray(v.flatten(), np.float64).reshape(-1, FEATURES))
            names = ["_own", "_id"]
            yield pa.RecordBatch.from_arrays([*(batch.column(batch.schema.get_field_index(n)) for n in names), pa.array(s)], names=[*names, "score"])

    scored = rows.mapInArrow(run, schema)
    return scored.select(*unpacked(keep), held_out("_id").alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def op9_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), keep=["doc_id"])


QUERIES = {"op9_quality_classifier": op9_quality_classifier}
SQL: dict[str, str] = {}
