"""BPE against the tokenizers library, and its edge cases."""

import random

import pytest

from veilwright.llm import bpe

PATH = bpe.vocabulary_path()
TEXTS = [
    "", " ", "Hello world", "don't DON'T we'll ''s", "ΑΣ ΟΔΟΣ Σ", "<|endoftext|> x<|startoftext|>y", "é é ﬁ İı", "1234 ½ ²", "\n\t a\x0bb\x85c ", "x" * 3000 + " yz", "!" * 500, "日本語 テキスト", "😀 🇫🇷 ok", "\x00\x01",
    "</w> Ġ <w>", "a" * 127, "a" * 128, "a" * 129, "the quick brown fox",
]


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(PATH)


def test_against_library(library):
    codec = bpe.Codec(PATH)
    rng = random.Random(3)
    letters = "abcdefgh ABC'.,!?\n éèñßΣ012-_/"
    texts = TEXTS + ["".join(rng.choices(letters, k=rng.randint(1, 80))) for _ in range(500)]
    for text, want in zip(texts, library.encode_batch(texts, add_special_tokens=False), strict=True):
        assert codec.encode(text) == want.ids, text
        assert codec.decode(want.ids) == library.decode(want.ids, skip_special_tokens=False)


def test_every_code_point(library):
    codec = bpe.Codec(PATH)
    texts = [f"a{chr(i)}!1{chr(i)}{chr(i)}b" for i in range(0x110000) if not 0xD800 <= i < 0xE000]
    library.no_truncation()
    assert [t for t, e in zip(texts, library.encode_batch(texts, add_special_tokens=False), strict=True) if codec.encode(t) != e.ids] == []


def test_long_pieces_take_the_same_merges():
    codec = bpe.Codec(PATH)
    rng = random.Random(4)
    for _ in range(50):
        piece = "".join(rng.choices("abcdeths", k=60))
        data = piece.encode()
        parts = [codec.inner[b] for b in data[:-1]] + [codec.last[data[-1]]]
        assert codec.merge(piece) == codec._merge_long(parts)


def test_rows(spark, library):
    rows = [(1, None, "x"), (1, "", "x"), (None, "Hello world", None), (2, "Hello world", "y"), (2, "Hello world", "y")]
    frame = spark.createDataFrame(rows, "doc_id long, text string, decoded string")
    found = bpe.bpe_decode(bpe.bpe_encode(frame)).collect()
    ids = library.encode("Hello world", add_special_tokens=False).ids
    assert sorted((r.doc_id or 0, len(r.ids)) for r in found) == [(0, len(ids)), (1, 0), (1, 0), (2, len(ids)), (2, len(ids))]
    assert {r.decoded for r in found if r.ids} == {library.decode(ids, skip_special_tokens=False)}
    assert bpe.bpe_encode(frame.filter("false")).count() == 0


def test_query(spark, library, tmp_path):
    import hashlib

    frame = spark.createDataFrame([(i, t) for i, t in enumerate([*TEXTS, None])], "doc_id long, text string")
    frame.write.parquet(f"{tmp_path}/documents.parquet")
    for r in bpe.op1_bpe(spark, str(tmp_path)).join(frame, "doc_id").collect():
        ids = library.encode(r.text or "", add_special_tokens=False).ids
        assert r.n_tokens == len(ids)
        assert r.ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()
