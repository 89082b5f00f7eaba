"""Byte-pair encoding and decoding of whole texts with a public vocabulary file.

Each piece of a text is merged on a contiguous array: the parts and, beside them, the rank of
each adjacent pair. The least rank is searched by a scan, that boundary is deleted, and the
ranks of the two neighbouring pairs are looked up anew. Pieces over `SHORT` symbols, where
scans would cost the square of the length, take the same merges in the same order from a heap.

Letters, numbers and lower case are as the library's tables of Unicode have them: where the local
ones differ, SIGNS and LOWER_CASE state it. Every code point gives the library's ids.

Null and empty texts give no tokens, and an empty table none. Very long texts are encoded whole;
ties of rank go to the leftmost pair. Rows are independent: repeated rows, null keys and other
columns pass through unchanged; columns named as results are replaced.
"""

from __future__ import annotations

import heapq
import json
import re
import unicodedata
from itertools import chain

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veilwright.llm._common import map_rows, table

#: Longest piece in symbols that the rank array merges by scanning.
SHORT = 128
#: Distinct pieces that a task remembers.
CACHE = 150_000
NONE = 1 << 60
#: Code points (first, last) that are neither letters nor numbers to the library.
SIGNS = (
    (0x558, 0x558), (0x58B, 0x58C), (0x88F, 0x88F), (0xC5C, 0xC5C), (0xCDC, 0xCDC), (0x208F, 0x208F), (0x209D, 0x209F), (0xA7CE, 0xA7CF), (0xA7D2, 0xA7D2), (0xA7D4, 0xA7D4), (0xA7DD, 0xA7DD), (0xA7E2, 0xA7E2), (0xA7F1, 0xA7F1),
    (0xAB6C, 0xAB6D), (0x107BB, 0x107BF), (0x10940, 0x10959), (0x10EC5, 0x10EC7), (0x10ED9, 0x10EEE), (0x11B0A, 0x11B0A), (0x11DB0, 0x11DDB), (0x11DE0, 0x11DE9), (0x11DF1, 0x11DF1), (0x1246F, 0x1246F), (0x12475, 0x1247F),
    (0x12550, 0x12686), (0x16EA0, 0x16EB8), (0x16EBB, 0x16ED3), (0x16FF2, 0x16FF6), (0x187F8, 0x187FF), (0x18CD6, 0x18CDA), (0x18D09, 0x18D20), (0x18D80, 0x18DF2), (0x18E00, 0x19191), (0x191A0, 0x191D2), (0x1B123, 0x1B128),
    (0x1B168, 0x1B168), (0x1D6A6, 0x1D6A6), (0x1DF1F, 0x1DF24), (0x1DF2B, 0x1DF81), (0x1DF90, 0x1DF96), (0x1DFCD, 0x1DFFF), (0x1E6C0, 0x1E6DE), (0x1E6E0, 0x1E6E2), (0x1E6E4, 0x1E6E5), (0x1E6E7, 0x1E6ED), (0x1E6F0, 0x1E6F4),
    (0x1E6FE, 0x1E6FF), (0x2B73A, 0x2B73F), (0x2B81E, 0x2B81E), (0x2CEA2, 0x2CEAD), (0x323B0, 0x33479), (0x3D000, 0x3FC3F),
)
#: What the library lower-cases beyond the local tables.
LOWER_CASE = {0x1C89: 0x1C8A, 0xA7CB: 0x264, 0xA7CC: 0xA7CD, 0xA7CE: 0xA7CF, 0xA7D2: 0xA7D3, 0xA7D4: 0xA7D5, 0xA7DA: 0xA7DB, 0xA7DC: 0x19B} | {x: x + 0x20 for x in range(0x10D50, 0x10D66)} | {x: x + 0x1B for x in range(0x16EA0, 0x16EB9)}


def byte_letters() -> list[str]:
    """The printable letter for each byte in byte-level vocabularies."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    letters, n = {b: chr(b) for b in plain}, 0
    for b in range(256):
        if b not in letters:
            letters[b] = chr(256 + n)
            n += 1
    return [letters[b] for b in range(256)]


def _is_latin(text: str) -> bool:
    """Whether all code points are under 256, which is quickly told."""
    try:
        text.encode("latin-1")
    except UnicodeEncodeError:
        return False
    return True


class Codec:
    """A byte-level BPE vocabulary with a word-end suffix, as its JSON file describes it."""

    def __init__(self, path: str):
        import regex

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        vocab = model["vocab"]
        suffix = model.get("end_of_word_suffix") or ""
        self.pairs = {}
        for rank, pair in enumerate(model["merges"]):
            a, b = pair.split(" ") if isinstance(pair, str) else pair
            self.pairs[vocab[a], vocab[b]] = (rank, vocab[a + b])
        letters = byte_letters()
        self.inner = [vocab.get(x) for x in letters]
        self.last = [vocab.get(x + suffix) for x in letters]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.tokens = {i: t for t, i in (vocab | self.special).items()}
        self.split_special = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")").split if self.special else lambda t: [t]
        split = next(p for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")
        pattern = split["pattern"]["Regex"]
        self.pieces = regex.compile(pattern).findall
        signs = "".join(f"{chr(a)}-{chr(b)}" for a, b in SIGNS)
        self.rare = frozenset(chr(x) for a, b in SIGNS for x in range(a, b + 1)) | frozenset(map(chr, LOWER_CASE))
        for known, exact in ((r"[\p{L}]", rf"[\p{{L}}--[{signs}]]"), (r"[\p{N}]", rf"[\p{{N}}--[{signs}]]"), (r"[^\s\p{L}\p{N}]", rf"[[^\s\p{{L}}\p{{N}}]||[{signs}]]")):
            pattern = pattern.replace(known, exact)
        self.exact_pieces = regex.compile(pattern, regex.V1).findall
        codec = self

        class Known(dict):
            def __missing__(self, piece):
                if len(self) >= CACHE:
                    self.clear()
                found = self[piece] = codec.merge(piece)
                return found

        self.known = Known()

    def merge(self, piece: str) -> tuple[int, ...]:
        data = piece.encode("utf-8", "replace")
        parts = [self.inner[b] for b in data[:-1]] + [self.last[data[-1]]]
        parts = [p for p in parts if p is not None]
        if len(parts) > SHORT:
            return self._merge_long(parts)
        pairs = self.pairs
        rank = [pairs.get(p, (NONE, 0))[0] for p in zip(parts, parts[1:])]
        while rank:
            least = min(rank)
            if least == NONE:
                break
            i = rank.index(least)
            parts[i : i + 2] = [pairs[parts[i], parts[i + 1]][1]]
            del rank[i]
            if i:
                rank[i - 1] = pairs.get((parts[i - 1], parts[i]), (NONE, 0))[0]
            if i < len(rank):
                rank[i] = pairs.get((parts[i], parts[i + 1]), (NONE, 0))[0]
        return tuple(parts)

    def _merge_long(self, parts: list[int]) -> tuple[int, ...]:
        pairs, n = self.pairs, len(parts)
        after, before, alive = [*range(1, n), -1], [-1, *range(n - 1)], [True] * n
        heap = [(pairs[p][0], i, p) for i, p in enumerate(zip(parts, parts[1:])) if p in pairs]
        heapq.heapify(heap)
        while heap:
            _, i, pair = heapq.heappop(heap)
            j = after[i] if alive[i] else -1
            if j < 0 or (parts[i], parts[j]) != pair:
                continue
            parts[i], alive[j], after[i] = pairs[pair][1], False, after[j]
            if after[j] >= 0:
                before[after[j]] = i
            for a, b in ((before[i], i), (i, after[i])):
                if a >= 0 and b >= 0 and (p := (parts[a], parts[b])) in pairs:
                    heapq.heappush(heap, (pairs[p][0], a, p))
        return tuple(p for p, x in zip(parts, alive) if x)

    def encode(self, text: str | None) -> list[int]:
        ids: list[int] = []
        if not text:
            return ids
        for part in self.split_special(text):
            if part in self.special:
                ids.append(self.special[part])
            elif part:
                part = unicodedata.normalize("NFC", part)
                rare = not part.isascii() and not _is_latin(part) and not self.rare.isdisjoint(part)
                # each character by itself: lower() alone would turn a last sigma
                part = "σ".join(x.lower() for x in (part.translate(LOWER_CASE) if rare else part).split("Σ"))
                pieces = self.exact_pieces if rare else self.pieces
                ids += chain.from_iterable(map(self.known.__getitem__, pieces(part)))
        return ids

    def decode(self, ids) -> str:
        """The tokens joined by a space, which is what a vocabulary without a decoder gives."""
        return " ".join(map(self.tokens.__getitem__, ids or ()))


_codecs: dict[str, Codec] = {}


def codec(path: str) -> Codec:
    if path not in _codecs:
        _codecs[path] = Codec(path)
    return _codecs[path]


def vocabulary_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def bpe_encode(docs: DataFrame, text: str = "text", out: str = "ids", decoded: str | None = None, path: str | None = None, drop: tuple[str, ...] = ()) -> DataFrame:
    """Adds the token ids of each whole text; null and empty texts get an empty array.

    decoded: a column for the text that the ids stand for, decoded in the same pass. drop: columns
    that are not needed any more.
    """
    path = path or vocabulary_path()

    def make():
        c = codec(path)
        if decoded is None:
            return lambda t: (c.encode(t),)

        def both(t):
            ids = c.encode(t)
            return ids, c.decode(ids)

        return both

    added, types = [(out, pa.list_(pa.int32()))], f"{out} array<int>"
    if decoded is not None:
        added, types = [*added, (decoded, pa.string())], f"{types}, {decoded} string"
    return map_rows(docs, [text], pa.schema(added), types, make, drop)


def bpe_decode(docs: DataFrame, ids: str = "ids", out: str = "decoded", path: str | None = None) -> DataFrame:
    """Adds the text that the ids stand for; null and empty arrays give an empty text."""
    path = path or vocabulary_path()

    def make():
        decode = codec(path).decode
        return lambda x: (decode(x),)

    return map_rows(docs, [ids], pa.schema([(out, pa.string())]), f"{out} string", make)


def op1_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    coded = bpe_encode(docs, decoded="decoded", drop=("text",))
    return coded.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


QUERIES = {"op1_bpe": op1_bpe}
SQL: dict[str, str] = {}
