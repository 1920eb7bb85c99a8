"""Packing of documents into training sequences by first-fit decreasing.

Every document is tokenised, ended with a separator and cut into full sequences and a remainder.  Pieces are dealt to
groups at random (by a hash), and each group is packed on its own: longest piece first, into the first bin that has
room.  A tournament tree over the bins, whose inner nodes hold the largest capacity below them, finds that bin in
logarithmic time.  Only the sizes of the pieces are shuffled, never their tokens.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerlens.llm.bpe import codec
from ledgerlens.llm.common import slices

#: Documents whose pieces meet in one group, on average: a few thousand small rows for one task.
GROUP_DOCUMENTS = 2048

PIECES = "doc_id bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint"


class BinTree:
    """Open bins in a complete binary tree; every node holds the largest capacity left below it."""

    def __init__(self, bins: int, capacity: int) -> None:
        self.leaves = 1 << max(0, bins - 1).bit_length()
        self.room = [capacity] * (2 * self.leaves)

    def place(self, size: int) -> tuple[int, int]:
        """Put an item into the leftmost bin with room; its bin and the room that bin had before."""
        room, node = self.room, 1
        if room[1] < size:
            raise ValueError("no bin has room")
        while node < self.leaves:
            node *= 2
            if room[node] < size:
                node += 1
        leaf, before = node - self.leaves, room[node]
        room[node] -= size
        while node > 1:
            node //= 2
            left, right = room[2 * node], room[2 * node + 1]
            room[node] = left if left >= right else right
        return leaf, before


def first_fit_decreasing(sizes: Sequence[int], capacity: int) -> tuple[list[int], list[int]]:
    """Bin and offset of each item; the items must be in decreasing order and fit a bin."""
    tree = BinTree(max(1, len(sizes)), capacity)
    placed = [tree.place(size) for size in sizes]
    return [b for b, _ in placed], [capacity - room for _, room in placed]


def cut_pieces(documents: DataFrame, path: str, length: int, separator: int) -> DataFrame:
    """Pieces of at most ``length`` tokens of every document with its separator, without their tokens."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(path)
        end = np.array([separator], "<u4").tobytes()
        for batch in slices(batches, "text"):
            rows: list[tuple[int | None, int, int, int, int]] = []
            ids_of = own.encode_many(batch.column("text").to_pylist())
            for doc_id, ids in zip(batch.column("doc_id").to_pylist(), ids_of):
                ids += end
                total = len(ids) // 4
                for start in range(0, total, length):
                    piece = ids[4 * start : 4 * (start + length)]
                    rows.append((doc_id, start, len(piece) // 4, zlib.crc32(piece), total))
            columns = [pa.array(c, pa.int64()) for c in zip(*rows)]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "start", "length", "ids_crc32", "doc_tokens"])

    return documents.selectExpr("cast(doc_id as bigint) doc_id", "cast(text as string) text").mapInArrow(run, PIECES)


def pack(documents: DataFrame, path: str, length: int = 1024, separator: int = 0, seed: int = 17) -> DataFrame:
    """Pack documents into sequences of at most ``length`` tokens; one row per piece.

    Result: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.  A null or empty text is its separator
    alone.  Repeated rows, and rows with a null doc_id, are packed each for itself.  Ties in length go by doc_id and
    start, so a repeated run gives the same packing.  Other columns are not read.  An empty table gives no rows.
    """
    pieces = cut_pieces(documents, path, length, separator)
    groups = max(1, -(-documents.count() // GROUP_DOCUMENTS))

    def pack_group(key: tuple[int], rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["length", "doc_id", "start", "ids_crc32"], ascending=[False, True, True, True])
        bins, offsets = first_fit_decreasing(rows["length"].tolist(), length)
        return rows.drop(columns="_group").assign(
            sequence_id=np.array(bins, "int64") + (int(key[0]) << 32), offset=np.array(offsets, "int64")
        )

    # Pieces, not documents, are dealt: a very long document spreads over the groups.
    dealt = pieces.withColumn("_group", F.pmod(F.xxhash64("doc_id", "start", "ids_crc32", F.lit(seed)), F.lit(groups)))
    return dealt.groupBy("_group").applyInPandas(pack_group, f"{PIECES}, sequence_id bigint, offset bigint")
