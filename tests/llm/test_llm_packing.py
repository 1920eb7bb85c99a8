"""Packing against brute force and against what a packing must satisfy."""

import random
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

from ledgerlens.llm import packing

PATH = public_tokenizers.path("byte_bpe_50k.json")


def first_fit(sizes, capacity):
    room, bins = [], []
    for size in sizes:
        at = next((i for i, r in enumerate(room) if r >= size), len(room))
        if at == len(room):
            room.append(capacity)
        room[at] -= size
        bins.append(at)
    return bins


def test_tree_finds_the_first_bin_with_room():
    pick = random.Random(3)
    for _ in range(200):
        sizes = sorted((pick.randint(1, 50) for _ in range(pick.randint(0, 60))), reverse=True)
        bins, offsets = packing.first_fit_decreasing(sizes, 50)
        assert bins == first_fit(sizes, 50)
        held = defaultdict(int)
        for size, where, offset in zip(sizes, bins, offsets):
            assert offset == held[where]
            held[where] += size
        assert not held or max(held.values()) <= 50


def test_every_token_lies_in_one_piece(spark, monkeypatch):
    monkeypatch.setattr(packing, "GROUP_DOCUMENTS", 5)
    library = Tokenizer.from_file(PATH)
    pick = random.Random(4)
    words = ["alpha", "beta", "gamma,", "delta\n", "ε"]
    rows = [(i, " ".join(pick.choice(words) for _ in range(pick.randint(0, 90))), i) for i in range(30)]
    rows += [(100, None, 0), (101, "", 0), (None, "a b c", 0), (7, rows[7][1], 1), (200, "alpha " * 3000, 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, length int")
    found = packing.pack(df, PATH, length=64).collect()
    assert packing.pack(df.limit(0), PATH).count() == 0
    assert sorted(map(tuple, packing.pack(df, PATH, length=64).collect()), key=str) == sorted(map(tuple, found), key=str)
    ids = {i: [*library.encode(t or "", add_special_tokens=False).ids, 0] for i, t, _ in rows}
    pieces, sequences = defaultdict(list), defaultdict(list)
    for r in found:
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
        part = np.array(ids[r["doc_id"]][r["start"] : r["start"] + r["length"]], "<u4")
        assert r["ids_crc32"] == zlib.crc32(part.tobytes()) and r["doc_tokens"] == len(ids[r["doc_id"]])
        pieces[r["doc_id"]].append((r["start"], r["length"]))
    for doc_id, own in pieces.items():
        copies = sum(1 for i, *_ in rows if i == doc_id)
        assert sum(n for _, n in own) == copies * len(ids[doc_id])
    assert set(pieces) == {i for i, *_ in rows}
    for own in sequences.values():
        end = 0
        for offset, length in sorted(own):
            assert offset == end
            end += length
        assert end <= 64
