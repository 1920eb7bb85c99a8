"""Byte-pair encoding against the tokenizers library."""

import hashlib
import random

import public_tokenizers
import pytest
from tokenizers import Tokenizer

from ledgerlens.llm import bpe

PATH = public_tokenizers.path("byte_bpe_50k.json")
PARTS = [
    "a", "The", " the", " ", "  ", "\n", "\n\n", "\t", "\r\n", "\x0b", "à", "é ", "'s", "'", "don't", ".", ",", "—", " ", "　", "\u0085",
    "\x1c", "中", "文", "12", "９", "😀", "<|endoftext|>", "«", "ñ", "​", "##", "%%%", "́", "Р ", "aaaaaaaa",
]


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


def texts(count):
    pick = random.Random(7)
    return ["".join(pick.choice(PARTS) for _ in range(pick.randint(0, 40))) for _ in range(count)]


def test_ids_and_round_trip_equal_the_library(library):
    own, some = bpe.Codec(PATH), texts(4000)
    for text, ids in zip(some, own.encode_many(some)):
        ids = memoryview(ids).cast("I").tolist()
        assert ids == library.encode(text, add_special_tokens=False).ids, text
        assert own.decode(__import__("numpy").array(ids, "int64")) == library.decode(ids, skip_special_tokens=False)


def test_cuts_lie_between_tokens_and_lose_nothing(library):
    own = bpe.Codec(PATH)
    for text in texts(500):
        pieces = own.fragments(text)
        assert b"".join(pieces) == text.encode()
        for left, right in zip(pieces, pieces[1:]):
            special = left.decode() in own.special or right.decode() in own.special
            assert special or (left[-1], right[0]) not in own.inside


def test_a_full_table_starts_anew(library, monkeypatch):
    monkeypatch.setattr(bpe, "REMEMBERED", 3)
    own, some = bpe.Codec(PATH), texts(50)
    for text in some:
        assert memoryview(next(own.encode_many([text]))).cast("I").tolist() == library.encode(text, add_special_tokens=False).ids


def test_round_trip_of_edge_rows(spark, library):
    rows = [(1, None, 5), (2, "", 6), (None, "a b", 7), (3, "x " * 50_000, 8), (3, "x " * 50_000, 8)]
    df = spark.createDataFrame(rows, "doc_id long, text string, ids_sha256 int")
    found = {r["doc_id"]: r for r in bpe.round_trip(df, PATH).collect()}
    assert bpe.round_trip(df, PATH).count() == 5 and bpe.round_trip(df.limit(0), PATH).count() == 0
    nothing = hashlib.sha256(b"").hexdigest()
    assert found[1]["n_tokens"] == found[2]["n_tokens"] == 0 and found[1]["ids_sha256"] == nothing == found[2]["decoded_sha256"]
    long = library.encode("x " * 50_000, add_special_tokens=False).ids
    assert found[3]["n_tokens"] == len(long)
    assert found[3]["ids_sha256"] == hashlib.sha256(",".join(map(str, long)).encode()).hexdigest()
    assert found[3]["decoded_sha256"] == hashlib.sha256(("x " * 50_000).encode()).hexdigest()
    encoded = bpe.decode(bpe.encode(df, PATH), PATH).select("doc_id", "text", "decoded", "ids_sha256")
    assert all((r["text"] or "") == r["decoded"] for r in encoded.collect())
